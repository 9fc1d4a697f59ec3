import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions import pixels as px
from quadrille.sources import synthetic

P = synthetic.patches(64, 64, 42)


def test_flat_patches_measure_zero():
    for name in ("flat_black", "flat_gray"):
        got = px.measured(P[name], ("entropy", "variance", "edge_density", "laplacian_variance", "lbp_entropy", "lbp_non_uniform_ratio"))
        assert got == [0, 0, 0, 0, 0, 0]


def test_noise_and_edges_measure_more():
    flat, noise, edge = P["flat_gray"], P["random_noise"], P["clean_vertical_edge"]
    for name in ("entropy", "variance", "edge_density", "laplacian_variance", "lbp_entropy", "lbp_non_uniform_ratio"):
        assert px.MEASURES[name].run(noise) > px.MEASURES[name].run(flat)
    assert px.edge_density(edge) > 0 and px.variance(edge) > 0
    assert px.edges(edge).sum(axis=0).max() == 64 and 1 <= (px.edges(edge).sum(axis=0) > 0).sum() <= 2
    assert px.entropy(P["checkerboard"]) == pytest.approx(1) and px.entropy(noise) > 7.9


def test_embedding_is_seeded_and_counted():
    g = P["random_noise"]
    a, b, c = (px.embed(g, 0.40, s) for s in (123, 123, 456))
    assert (a.stego == b.stego).all() and (a.stego != c.stego).any()
    assert a.selected == round(0.4 * g.size) and ((a.stego ^ g) <= 1).all() and a.changed == (a.stego != g).sum()
    assert px.embed(g, 0, 1).changed == 0 and px.embed(np.zeros((1, 5), np.uint8), 0.5, 1).selected == 2
    with pytest.raises(ValueError):
        px.embed(g, 1.5, 1)


def test_distortions():
    g = P["random_noise"]
    s = px.embed(g, 0.4, 7).stego
    e = px.mse(g, s)
    assert 0 < e < 1 and px.psnr(g, s) == pytest.approx(10 * np.log10(65025 / e)) and px.psnr(g, g, 99) == 99
    for f in (px.ssim, px.ms_ssim):
        assert f(g, g) == pytest.approx(1) and 0.9 < f(g, s) < 1 and f(g, P["flat_gray"]) < 0.5
    assert px.ssim_window((8, 8)) == 7 and px.ssim_window((4, 9)) == 3
    with pytest.raises(ValueError):
        px.ms_ssim(g[:8, :8], g[:8, :8])
    with pytest.raises(ValueError):
        px.ssim(g[:2, :2], g[:2, :2])


def test_patterns_by_hand():
    g = np.zeros((8, 8), np.uint8)
    g[3:, :] = 10
    codes = px.lbp_codes(g)
    assert codes.shape == (6, 6) and set(np.unique(codes)) <= set(range(10)) and (codes[0] == 8).all()
    assert codes[2, 2] == 5
    spot = np.zeros((9, 9), np.uint8)
    spot[4, 4] = 255
    x = px.correlate(spot / 255.0, px.LAPLACE[3].astype(float))
    assert x[4, 4] == -8 and x[3, 3] == 2 and x[3, 4] == 0
    assert px.laplacian_variance(spot) == pytest.approx(x.var(), rel=1e-6)


def test_a_pattern_needs_its_circle_and_a_patch_its_shape():
    with pytest.raises(ValueError):
        px.lbp_codes(np.zeros((2, 9), np.uint8))
    for bad in (np.zeros((8, 8)), np.zeros((7, 8), np.uint8), np.zeros((8, 8, 3), np.uint8)):
        with pytest.raises(ValueError):
            px.measured(bad, ("entropy",))
    with pytest.raises(ValueError, match="unknown"):
        px.measured(P["flat_gray"], ("no_such",))


def test_luma():
    assert px.to_gray(np.array([[[0, 0, 255], [0, 255, 0], [255, 0, 0], [255, 255, 255]]], np.uint8)).tolist() == [[76, 150, 29, 255]]


def test_lattice_equals_arrays(spark):
    rows = synthetic.lattice(spark, 64, 64).collect()
    for r in rows:
        assert P[r.patch_name][r.y, r.x] == r.value
    assert len(rows) == 6 * 4096
    frame = synthetic.patch_frame(spark).where(F.length("pixels") == 4096)
    assert frame.count() == 8


def test_all_measures_are_finite():
    for p in P.values():
        assert np.isfinite(px.measured(p, tuple(px.MEASURES), 0.4, 42)).all()
