import hashlib
"""Image files are written here by a small PNG encoder; no image library is needed."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.config import Bounds, Feature, Fusion, Grid, Group
from quadrille.functions import hashing, pixels
from quadrille.operators import grids, quality
from quadrille.plans import labeling
from quadrille.sources import images as im
from quadrille.sources import labels as lb


def png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def flat(color, size=16):
    return np.broadcast_to(np.array(color, np.uint8), (size, size, 3)).copy()


def tree(tmp_path, colors=((10, 20, 30), (40, 50, 60), (70, 80, 90)), size=16):
    folders = {}
    for split, c in zip(("train", "validation", "test"), colors, strict=True):
        png(tmp_path / split / f"image {split}.PNG", flat(c, size))
        folders[split] = str(tmp_path / split)
    return folders


def issues(spark, folders, expected=None):
    images = im.read_splits(spark, folders).withColumn("path", F.col("relative_path"))
    found = quality.issues_of(images, quality.image_checks(16, 16, 3), ["split", "path"]).select("severity", "code", "split", "path")
    found = found.unionByName(quality.duplicate_issues(images.where("readable"), F.col("content_hash"), "CONTENT"))
    return images, sorted(r.code for r in found.collect())


def test_a_sound_tree_has_no_issues(spark, tmp_path):
    images, codes = issues(spark, tree(tmp_path))
    rows = images.orderBy("split").collect()
    assert codes == [] and len(rows) == 3 and all(r.readable for r in rows)
    assert [(r.width, r.height, r.mode, r.channels, r.extension) for r in rows] == [(16, 16, "RGB", 3, ".png")] * 3
    assert rows[0].relative_path == "image test.PNG" and rows[0].image_id == "image test"
    assert rows[0].image_key.startswith("image_test__")
    assert bytes(rows[0].pixels[:3]) == bytes((90, 80, 70))
    assert rows[0].content_hash == hashlib.sha256(b"RGB16x16" + bytes((70, 80, 90)) * 256).hexdigest()


def test_size_duplicates_broken_files_and_counts(spark, tmp_path):
    folders = tree(tmp_path, ((1, 2, 3), (1, 2, 3), (7, 8, 9)))
    png(tmp_path / "train" / "sub" / "large.png", flat((5, 5, 5), 32))
    (tmp_path / "test" / "broken.jpg").write_bytes(b"this is text")
    (tmp_path / "test" / "notes.txt").write_text("x")
    images, codes = issues(spark, folders)
    assert codes == ["DUPLICATE_CONTENT_ACROSS_SPLITS"] * 2 + ["INVALID_IMAGE_DIMENSIONS", "UNREADABLE_IMAGE"]
    assert images.where("not readable").count() == 1
    expected = spark.createDataFrame([("train", 2), ("validation", 2), ("test", None)], "split string, expected int")
    assert [r.split for r in quality.count_mismatch(images, expected).collect()] == ["validation"]
    assert im.unsupported(im.list_files(spark, folders["test"])).first().filename == "notes.txt"
    assert im.read_images(spark, folders["train"], recursive=False).count() == 1


GRID = Grid(16, 16, 8, 8, 4, 4)
FEATURES = (Feature("entropy"), Feature("variance"), Feature("psnr", enabled=False))
FUSION = Fusion((Group("all", {"entropy": 0.5, "variance": 0.5}),))


def noisy(tmp_path, n=3):
    rng = np.random.default_rng(0)
    folders = {}
    for split in ("train", "validation"):
        for k in range(n):
            png(tmp_path / split / f"i{k}.png", rng.integers(0, 60 * (k + 1), (16, 16, 3), dtype=np.uint8))
        folders[split] = str(tmp_path / split)
    return folders


def test_window_features_equal_the_kernels(spark, tmp_path):
    images = im.read_splits(spark, noisy(tmp_path, 1))
    rows = im.window_features(images, GRID, ("entropy", "psnr"), 0.4, 9).collect()
    assert len(rows) == 2 * GRID.windows
    one = images.where("split = 'train'").first()
    g = pixels.to_gray(np.frombuffer(one.pixels, np.uint8).reshape(16, 16, 3))
    for r in rows:
        if r.split == "train":
            y, x = 4 * r.row, 4 * r.col
            want = pixels.measured(np.ascontiguousarray(g[y : y + 8, x : x + 8]), ("entropy", "psnr"), 0.4, hashing.stable_seed(9, "train", "i0.png", r.row, r.col, x, y))
            assert [r.entropy, r.psnr] == [np.float32(v) for v in want]


def test_labels_are_made_kept_and_checked(spark, tmp_path):
    images = im.read_splits(spark, noisy(tmp_path))
    path = str(tmp_path / "bounds.json")
    artifact = labeling.fit(images, GRID, FEATURES, Bounds(), path)
    assert artifact.rows == 3 * GRID.windows and artifact.images == 3
    again = labeling.fit(images.limit(0), GRID, FEATURES, Bounds(), path)
    assert again == artifact
    labels = labeling.generate(images, artifact, GRID, FEATURES, FUSION)
    out = str(tmp_path / "labels")
    lb.write_labels(labels, out)
    with pytest.raises(Exception, match="exists"):
        lb.write_labels(labels, out)
    back = lb.read_labels(spark, out).cache()
    assert back.count() == 6 and back.columns == lb.LABEL.fieldNames()
    required = ["score_map", "raw_feature_maps", "normalized_feature_maps", "group_score_maps", "window_coordinates"]
    checks = quality.array_checks(required, ["entropy", "variance"], ["all"], 3, 3)
    assert quality.issues_of(back, checks, ["image_key"]).count() == 0
    wrong = quality.array_checks(required, ["entropy", "variance"], ["all"], 4, 3)
    assert {r.code for r in quality.issues_of(back, wrong, ["image_key"]).collect()} >= {"INVALID_SCORE_MAP_SHAPE", "INVALID_COORDINATE_SHAPE"}
    row = back.first()
    assert row.window_coordinates[1][2] == [8, 4, 8, 8] and json.loads(row.metadata_json)["label_fingerprint"]
    fingerprint = json.loads(row.metadata_json)["label_fingerprint"]
    sources = images.select("split", F.col("relative_path").alias("source_relative_path"))
    kept = back.withColumn("fp", lb.metadata_field("label_fingerprint")).where("image_key <> 'none'")
    status = lb.reuse(sources.where("split = 'train'"), kept.where("split = 'train'").limit(2), "source_relative_path", "fp", fingerprint)
    assert sorted(r.status for r in status.collect()) == ["generated", "reused", "reused"]


def test_labels_are_used_again(spark, tmp_path):
    images = im.read_splits(spark, noisy(tmp_path))
    artifact = labeling.fit(images, GRID, FEATURES, Bounds())
    out = str(tmp_path / "labels")

    def made(some, artifact=artifact, **options):
        rows = labeling.generate_into(some, artifact, GRID, FEATURES, FUSION, out, **options)
        assert rows.columns == labeling.MANIFEST
        rows = rows.collect()
        assert len({(r.split, r.image_key) for r in rows}) == len(rows) == lb.read_labels(spark, out).count()
        return sorted((r.split, r.source_relative_path, r.status) for r in rows), rows

    first, _ = made(images.where("split = 'train'"))
    assert [r[2] for r in first] == ["generated"] * 3
    second, rows = made(images)
    assert [r[2] for r in second] == ["reused"] * 3 + ["generated"] * 3
    labels = {(r.split, r.image_key): r for r in lb.read_labels(spark, out).collect()}
    for r in rows:
        label = labels[r.split, r.image_key]
        s = np.array(label.score_map, np.float64)
        got = [r.score_min, r.score_max, r.score_mean, r.score_standard_deviation, r.score_sum, r.score_squared_sum]
        assert np.allclose(got, [s.min(), s.max(), s.mean(), s.std(), s.sum(), (s * s).sum()], atol=1e-12)
        assert (r.score_count, r.grid_height, r.grid_width) == (9, 3, 3)
        meta = json.loads(label.metadata_json)
        assert (meta["split"], meta["source_relative_path"]) == (r.split, r.source_relative_path)
        assert meta["source_state"]["file_size_bytes"] > 0 and meta["feature_names"] == ["entropy", "variance"]
    assert [r[2] for r in made(images)[0]] == ["reused"] * 6
    # Other settings, or a demand, make all anew.
    other = labeling.fit(images, GRID, FEATURES, Bounds(5.0, 95.0))
    assert [r[2] for r in made(images, other)[0]] == ["generated"] * 6
    assert [r[2] for r in made(images, other, overwrite=True)[0]] == ["generated"] * 6


def test_a_bad_number_is_an_issue(spark):
    good = [[0.5] * 3] * 3
    rows = []
    for k, score in enumerate(([[float("nan")] + [0.5] * 2] + good[1:], [[-0.1] * 3] * 3, [[1.1] * 3] * 3, good)):
        rows.append(("train", str(k), str(k), 1, score, [good], [good], [good], [[[0, 0, 8, 8]] * 3] * 3, ["f"], ["g"], "{}"))
    df = spark.createDataFrame(rows, lb.LABEL)
    found = quality.issues_of(df, quality.array_checks(["score_map"], ["f"], ["g"], 3, 3), ["image_key"])
    assert sorted((r.image_key, r.code) for r in found.collect()) == [("0", "NON_FINITE_VALUES"), ("1", "VALUE_BELOW_ZERO"), ("2", "VALUE_ABOVE_ONE")]


def test_approval_gate(tmp_path):
    good = {"errors": 0, "warnings": 0, "galleries": 4}
    record = labeling.approve(good, 3, "someone", str(tmp_path / "approval.json"))
    assert record["approved"] and json.loads((tmp_path / "approval.json").read_text())["reviewed"] == 3
    for report, reviewed in (({**good, "errors": 1}, 3), ({**good, "galleries": 0}, 0), (good, 0), (good, 5)):
        with pytest.raises(ValueError):
            labeling.approve(report, reviewed, "someone", str(tmp_path / "no.json"))
    assert labeling.reset_approval(str(tmp_path / "approval.json"))["approved"] is False


def test_reports_and_unions(spark, tmp_path):
    a, b = spark.createDataFrame([(1, None)], "k int, x string"), spark.createDataFrame([(2, 3.0)], "k int, y double")
    out = lb.stacked([a, b])
    assert out.columns == ["k", "x", "y"] and out.count() == 2
    lb.write_report(out.coalesce(1), str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 2
    with pytest.raises(FileExistsError):
        lb.write_json({}, str(tmp_path / "x.json")) or lb.write_json({}, str(tmp_path / "x.json"), overwrite=False)


def test_merged_statistics_as_a_stream(spark, tmp_path):
    from quadrille.streaming import statistics as stream

    rows = [("train", f"i{k % 3}", float(k) / 10) for k in range(30)]
    src = tmp_path / "in"
    df = spark.createDataFrame(rows, "split string, image_key string, score double")
    df.repartition(3).write.parquet(str(src))
    query = stream.run(spark, str(src), df.schema, str(tmp_path / "partial"), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    got = stream.summary(spark, str(tmp_path / "partial")).first()
    assert got.n == 30 and abs(got.mean - 1.45) < 1e-9 and (got.minimum, got.maximum) == (0.0, 2.9)


def test_windows_join_images_without_pixels(spark):
    images = spark.createDataFrame([("a",), ("b",)], "k string")
    assert grids.image_windows(images, GRID).count() == 18
