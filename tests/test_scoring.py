import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.config import LOWER, Bounds, ConfigError, Feature, Flags, Fusion, Grid, Group, Settings, check, load, resolve_path, threshold_candidates
from quadrille.functions import hashing, scoring
from quadrille.operators import grids, quality
from quadrille.operators import normalization as nz
from quadrille.operators import statistics as st
from quadrille.sources import labels as lb

FIVE = [Feature(n) for n in ("entropy", "variance", "edge_density", "laplacian_variance", "lbp_non_uniform_ratio")]
THREE = Fusion(
    (
        Group("intensity", {"entropy": 0.5, "variance": 0.5}),
        Group("spatial", {"edge_density": 0.5, "laplacian_variance": 0.5}),
        Group("pattern", {"lbp_non_uniform_ratio": 1.0}),
    )
)


def test_values_outside_the_bounds_are_clipped(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (5.0, 0.1), (10.0, 0.2)], "entropy double, variance double")
    fitted = nz.fit_bounds(rows, ["entropy", "variance"], Bounds(0, 100))
    fusion = Fusion((Group("g", {"entropy": 0.5, "variance": 0.5}),))
    out = nz.score(spark.createDataFrame([(20.0, -1.0)], rows.schema), fitted, [Feature("entropy"), Feature("variance")], fusion).first()
    assert (out.norm_entropy, out.norm_variance, out.combined_score) == (1.0, 0.0, 0.5)


def test_lower_is_better_is_turned_round(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,)], "mse double")
    fitted = nz.fit_bounds(rows, ["mse"], Bounds(0, 100))
    out = nz.score(rows, fitted, [Feature("mse", LOWER)], Fusion((Group("g", {"mse": 1.0}),))).orderBy("mse").collect()
    assert [r.norm_mse for r in out] == [1.0, 0.0]
    with pytest.raises(ValueError):
        scoring.normalise(F.lit(1.0), F.lit(0.0), F.lit(1.0), "sideways")


def test_groups_weigh_the_same(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0, 0.0, 0.5)], ", ".join(f"{f.name} double" for f in FIVE))
    out = df.select(*[c.alias(n) for n, c in scoring.fuse({f.name: F.col(f.name) for f in FIVE}, THREE).items()]).first()
    assert tuple(out) == (1.0, 0.0, 0.5, 0.5)


def test_raw_maps_within_unit_bounds_stay(spark):
    rng = np.random.default_rng(0)
    rows = [(i // 2, i % 2, *(float(np.float32(x)) for x in rng.random(5))) for i in range(4)]
    rows[0] = (0, 0, 1.0, 1.0, 0.0, 0.0, 0.5)
    df = spark.createDataFrame(rows, "row int, col int, " + ", ".join(f"{f.name} float" for f in FIVE))
    names = tuple(f.name for f in FIVE)
    artifact = nz.Artifact("f", "train", 1, 4, names, (0.0,) * 5, (1.0,) * 5, 1, 99)
    out = nz.score(df, artifact.frame(spark), FIVE, THREE, single=True).orderBy("row", "col").collect()
    assert all(r[f"norm_{n}"] == r[n] for r in out for n in names)
    assert all(0 <= r.combined_score <= 1 for r in out) and out[0].combined_score == 0.5
    assert dict(nz.score(df, artifact.frame(spark), FIVE, THREE, single=True).dtypes)["combined_score"] == "float"


def test_a_narrow_span_is_widened(spark):
    fitted = nz.fit_bounds(spark.createDataFrame([(3.0,)] * 4, "x double"), ["x"], Bounds(epsilon=0.5)).first()
    assert (fitted.lower_x, fitted.upper_x) == (3.0, 3.5)


@pytest.mark.parametrize("accuracy", [20, 100_000])
def test_exact_quantiles_equal_numpy(spark, accuracy):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=3001), rng.integers(0, 5, 3001).astype(float)
    df = spark.createDataFrame([(float(x), float(y) if k % 4 else None) for k, (x, y) in enumerate(zip(a, b, strict=True))], "a double, b double")
    kept = np.array([y for k, y in enumerate(b) if k % 4])
    shares = [0.0, 0.01, 0.0123, 0.3, 0.5, 0.7777, 0.99, 1.0]
    got = {(r.feature, r.share): r.value for r in nz.exact_quantiles(df, ["a", "b"], shares, accuracy).collect()}
    for name, x in (("a", a), ("b", kept)):
        assert np.allclose([got[name, s] for s in shares], np.quantile(x, shares))
    assert nz.exact_quantiles(df.limit(0), ["a"], shares).collect() == []


def test_artifact_round_trip_and_errors(spark, tmp_path):
    good = nz.Artifact("f", "train", 2, 50, ("a",), (0.0,), (1.0,), 1, 99)
    path = str(tmp_path / "x" / "bounds.json")
    lb.save_artifact(good, path)
    assert lb.load_artifact(path, "f", ("a",)) == good
    with pytest.raises(ValueError, match="fingerprint"):
        lb.load_artifact(path, "other")
    bad = nz.Artifact("f", "test", 0, 0, ("a", "b"), (0.0, 1.0), (math.inf, 1.0), 1, 99)
    assert len(bad.errors(names=("b", "a"))) == 5
    with pytest.raises(ValueError):
        lb.save_artifact(bad, path)


def test_statistics_of_odd_values(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,), (3.0,), (3.0,)], "x double")
    r = st.feature_statistics(df, ["x"]).first()
    assert (r.n, r.finite_count, r.minimum, r.maximum, r.median, r.distinct_values) == (6, 3, 1.0, 3.0, 3.0, 2)
    const = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    got = {(r.a, r.b): r.correlation for r in st.correlations(const, ["a", "b"]).collect()}
    assert got["a", "b"] is None and got["b", "b"] == pytest.approx(1)
    ranks = st.average_rank(spark.createDataFrame([(5,), (5,), (1,), (9,)], "v int"), "v", "r").orderBy("v").collect()
    assert [x.r for x in ranks] == [1.0, 2.5, 2.5, 4.0]


def test_distances_equal_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=300).round(2), rng.normal(0.3, 1, 200).round(2)
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "s string, v double")
    r = st.distances(df, "s", "v", [("a", "b")]).first()
    grid = np.unique(np.concatenate([a, b]))
    gap = np.abs(np.searchsorted(np.sort(a), grid, "right") / 300 - np.searchsorted(np.sort(b), grid, "right") / 200)
    assert r.ks_statistic == pytest.approx(gap.max())
    assert r.wasserstein == pytest.approx((gap[:-1] * np.diff(grid)).sum())
    assert r.mean_difference == pytest.approx(a.mean() - b.mean())
    assert st.ks_p_value(0.0, 10, 10) == 1.0 and st.ks_p_value(1.0, 500, 500) < 1e-9
    assert st.ks_p_value(1.18 / math.sqrt(50), 100, 100) == pytest.approx(st.ks_p_value(1.1799999 / math.sqrt(50), 100, 100), abs=1e-6)


def test_coverage_of_overlapping_windows(spark):
    df = spark.createDataFrame([("i", 0, 0, 2, 2, 0.0), ("i", 1, 0, 2, 2, 1.0)], "k string, x int, y int, width int, height int, score double")
    grid = Grid(3, 2, 2, 2, 1, 1)
    out = grids.coverage(df, ["k"], grid)
    assert {(r.px, r.py): r.score for r in out.collect()} == {(0, y): 0.0 for y in (0, 1)} | {(1, y): 0.5 for y in (0, 1)} | {(2, y): 1.0 for y in (0, 1)}
    assert grids.uncovered(out, ["k"], grid).count() == 0
    assert grids.uncovered(grids.coverage(df.where("x = 0"), ["k"], grid), ["k"], grid).first().pixels == 4


def _flags(spark, score, groups=(None, None, None), **limits):
    rows = [("i", r, c, float(score[r, c]), *(float(score[r, c] if g is None else g) for g in groups)) for r in range(25) for c in range(25)]
    df = spark.createDataFrame(rows, "image_key string, row int, col int, score float, g1 float, g2 float, g3 float")
    record = st.score_record(df, ["image_key"], "score", [0.5])
    means = df.groupBy("image_key").agg(*[F.avg(F.col(g).cast("double")).alias(g) for g in ("g1", "g2", "g3")])
    peaks = quality.peak_share(df, ["image_key"], "row", "col", "score", 25, 25, 0.35)
    return quality.suspicious(record.join(means, "image_key").join(peaks, "image_key"), ["g1", "g2", "g3"], Flags(**limits)).first().flags.split("|")


def test_suspicious_maps(spark):
    flat = np.full((25, 25), 0.5)
    assert _flags(spark, flat) == ["CONSTANT_OR_NEAR_CONSTANT_MAP"]
    zeros = _flags(spark, flat * 0)
    assert {"EXCESSIVE_EXACT_ZEROS", "ALMOST_ALL_SCORES_LOW"} <= set(zeros)
    assert "LARGE_GROUP_DISAGREEMENT" in _flags(spark, flat, (0, 0.5, 1))
    noisy = np.random.default_rng(42).uniform(0.2, 0.8, (25, 25))
    assert "CONSTANT_OR_NEAR_CONSTANT_MAP" not in _flags(spark, noisy)
    peaks = flat.copy()
    peaks[2::6, 2::6] = 1.0
    assert "ISOLATED_SCORE_PEAKS" in _flags(spark, peaks)


def test_grid_and_thresholds(spark):
    rows = grids.windows(spark, Grid()).orderBy("row", "col").collect()
    assert len(rows) == 625 == Grid().windows and tuple(rows[0])[2:] == (0, 0, 64, 64) and tuple(rows[-1])[2:] == (192, 192, 64, 64)
    assert threshold_candidates()[0] == 0.5 and threshold_candidates()[-1] == 0.66 and len(threshold_candidates()) == 17
    with pytest.raises(ValueError):
        grids.windows(spark, Grid(stride_x=7))


def test_settings_collect_all_errors(tmp_path):
    good = Settings(features=tuple(FIVE), fusion=THREE)
    assert check(good, (25, 25)) is good
    bad = Settings(
        grid=Grid(stride_x=7),
        features=(Feature("a", "odd"), Feature("b", weight=0.0), Feature("c", enabled=False)),
        fusion=Fusion((Group("g", {"a": 1.0, "zz": -1.0, "c": 1.0}), Group("h", {"a": 1.0}, 0.0), Group("e", {})), 1.0, 0.0, "mean"),
        bounds=Bounds(50, 50, 0.0),
        color_mode="rgb",
        channels=1,
    )
    with pytest.raises(ConfigError) as e:
        check(bad)
    assert len(e.value.errors) >= 12
    path = tmp_path / "c.yaml"
    path.write_text(json.dumps({"features": [{"name": "a"}], "fusion": {"groups": [{"name": "g", "members": {"a": 1}}]}}))
    assert load(str(path)).enabled == ("a",)
    path.write_text("grid: {nonsense: 1}")
    with pytest.raises(ConfigError):
        load(str(path))
    assert str(resolve_path("a/b", "/r")) == "/r/a/b"
    for odd in ("${NO_SUCH_VARIABLE}/x", "C:\\x"):
        with pytest.raises(ValueError):
            resolve_path(odd, "/r")


def test_keys_and_seeds(spark):
    assert hashing.stable_seed(1, "a") == hashing.stable_seed(1, "a") != hashing.stable_seed(1, "b") < 2**32
    assert hashing.canonical_hash({"b": 1, "a": "é"}) == hashing.canonical_hash({"a": "é", "b": 1})
    df = spark.createDataFrame([("a/b c.é.png",), (".hidden",)], "p string")
    keys = [r[0] for r in df.select(hashing.image_key(F.col("p"))).collect()]
    assert keys[0].startswith("b_c_é__") and len(keys[0]) == 7 + 16 and keys[1].startswith("_hidden__")
    got = df.limit(1).select(hashing.stable_seed_column(F.lit(7), F.col("p"))).first()[0]
    assert got == hashing.stable_seed(7, "a/b c.é.png")
    assert hashing.threshold_column(0.5) == "fraction_ge_0_50"


def test_selection_skips_without_replacing(spark):
    rows = [(k, k / 10, 0.5 - k / 100, 1.0 if k == 9 else 0.0, 0.0) for k in range(10)]
    df = spark.createDataFrame(rows, "k int, mean double, std double, zero_fraction double, one_fraction double")
    out = grids.select_records(df, "k", 2, 7, 1).orderBy("place").collect()
    assert [(r.k, r.category) for r in out[:4]] == [(0, "lowest_mean"), (1, "lowest_mean"), (9, "highest_mean"), (8, "highest_mean")]
    assert len(out) == 7 and len({r.k for r in out}) == 7 and out[4].category == "median_mean"
    assert grids.sample_rows(df, 1, ["k"], 3).count() == 3 and grids.sample_rows(df, 1, ["k"], 30).count() == 10
