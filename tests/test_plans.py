import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille import __main__ as cli
from quadrille.config import Bounds, Grid
from quadrille.plans import inspection, labeling, review, validation
from quadrille.sources import images as im
from quadrille.sources import labels as lb
from tests.test_sources import FEATURES, FUSION, GRID, flat, noisy, png, tree


def test_validation_of_a_broken_tree(spark, tmp_path):
    folders = tree(tmp_path, ((1, 2, 3), (1, 2, 3), (7, 8, 9)))
    png(tmp_path / "train" / "copy.png", flat((1, 2, 3)))
    (tmp_path / "test" / "broken.jpg").write_bytes(b"text")
    (tmp_path / "test" / "notes.txt").write_text("x")
    folders["holdout"] = str(tmp_path / "none")
    out = validation.validate(spark, folders, GRID, expected={"train": 5, "test": None}, expected_grid=(9, 3), severity={"IMAGE_COUNT_MISMATCH": "warning"})
    codes = {(r.severity, r.code): r["count"] for r in out.issues.groupBy("severity", "code").count().collect()}
    assert codes == {
        ("error", "MISSING_SPLIT_DIRECTORY"): 1,
        ("error", "INVALID_WINDOW_GRID_WIDTH"): 1,
        ("error", "INVALID_WINDOWS_PER_IMAGE"): 1,
        ("warning", "UNSUPPORTED_FILE"): 1,
        ("error", "UNREADABLE_IMAGE"): 1,
        ("warning", "IMAGE_COUNT_MISMATCH"): 1,
        ("error", "DUPLICATE_CONTENT_ACROSS_SPLITS"): 3,
    }
    rows = {r.filename: r.codes for r in out.manifest.collect()}
    assert rows["broken.jpg"] == "UNREADABLE_IMAGE" and rows["copy.png"] == "DUPLICATE_CONTENT_ACROSS_SPLITS"
    assert out.manifest.columns == list(validation.MANIFEST) and not out.valid()
    written = validation.write(out, str(tmp_path / "report"))
    assert written == json.loads((tmp_path / "report" / "summary.json").read_text()) and written["severity"]["warning"] == 2
    with pytest.raises(ValueError):
        validation.validate(spark, folders, GRID, severity={"X": "fatal"})


def test_inspection_finds_what_is_wrong(spark, tmp_path):
    images = im.read_splits(spark, noisy(tmp_path)).persist()
    artifact = labeling.fit(images, GRID, FEATURES, Bounds())
    labels = labeling.generate(images, artifact, GRID, FEATURES, FUSION).persist()
    sources = images.select("split", F.col("relative_path").alias("source_relative_path"))
    # The keys of i0, i1 and i2 are the same in both splits.
    keys = sorted(r.image_key for r in labels.where("split = 'train'").collect())
    other = F.when(F.col("split") == "train", "none.png").otherwise("i2.png")
    broken = labels.where(F.col("image_key") != keys[0]).withColumns(
        {
            "source_relative_path": F.when(F.col("image_key") == keys[1], other).otherwise(F.col("source_relative_path")),
            "feature_names": F.when((F.col("image_key") == keys[2]) & (F.col("split") == "train"), F.array(F.lit("x"))).otherwise(F.col("feature_names")),
        }
    )
    found = inspection.inspect(broken, sources, GRID, ["entropy", "variance"], ["all"], {"train": 3, "validation": 3, "test": None}, artifact.fingerprint)
    codes = {r.code: r["count"] for r in found.issues.groupBy("code").count().collect()}
    assert codes["FEATURE_NAME_MISMATCH"] == 1 and codes["ORPHAN_LABEL"] == 1 and codes["DUPLICATE_SOURCE_LABEL"] == 1
    assert codes["MISSING_LABEL_FOR_SOURCE"] == 5 and codes["LABEL_FILE_COUNT_MISMATCH"] == 2 and codes["NO_VALID_LABEL_SCORES"] == 1
    good = inspection.inspect(labels, sources, GRID, ["entropy", "variance"], ["all"], normalization=artifact.fingerprint)
    assert {r.code for r in good.issues.collect()} == {"NO_VALID_LABEL_SCORES"}
    assert good.records.count() == 6 and good.splits.count() == 2 and good.groups.count() == 2 and good.clipping.count() == 4
    assert [(r.first_split, r.second_split) for r in good.distances.collect()] == [("train", "validation")]
    out = inspection.write(good, str(tmp_path / "inspection"))
    assert out["errors"] == 1 and out["galleries"] == 6
    assert labeling.read_approval(str(tmp_path / "inspection" / "approval.json"))["approved"] is False
    moved = inspection.inspect(labels, sources, Grid(16, 16, 8, 8, 4, 4), ["entropy", "variance"], ["all"], normalization="other")
    assert moved.issues.where("code = 'NORMALIZATION_FINGERPRINT_MISMATCH'").count() == 6
    assert inspection.image_windows(inspection.score_rows(labels), keys[0], 2).count() == 8
    assert lb.LABEL.fieldNames() == labels.columns


def test_review_of_a_sample(spark, tmp_path):
    images = im.read_splits(spark, noisy(tmp_path, 2))
    out = review.review(images, GRID, FEATURES, FUSION, Bounds(), n_images=3, n_windows=4)
    assert out.rows.count() == 12 and out.synthetic.count() == 8 and out.statistics.count() == 3
    assert out.rows.where("combined_score between 0 and 1").count() == 12
    wide = review.matrix_rows(out.pearson, ["entropy", "variance", "psnr"]).collect()
    assert len(wide) == 3 and all(abs(r[r.feature] - 1) < 1e-6 for r in wide)


def test_command_line(spark, tmp_path, capsys):
    noisy(tmp_path / "data", 2)
    rng = np.random.default_rng(1)
    png(tmp_path / "data" / "test" / "t.png", rng.integers(0, 255, (16, 16, 3), dtype=np.uint8))
    spec = {
        "grid": {"image_width": 16, "image_height": 16, "width": 8, "height": 8, "stride_x": 4, "stride_y": 4},
        "features": [{"name": "entropy"}, {"name": "variance"}],
        "fusion": {"groups": [{"name": "all", "members": {"entropy": 0.5, "variance": 0.5}}]},
    }
    path, data, out = tmp_path / "c.yaml", str(tmp_path / "data"), str(tmp_path / "out")
    path.write_text(json.dumps(spec))
    assert cli.main(["validate-config", str(path)]) == 0
    for command in ("validate-dataset", "review", "generate", "inspect"):
        assert cli.main([command, str(path), "--data", data, "--out", out if command != "review" else f"{out}/review"]) in (0, 1)
    report = json.loads((tmp_path / "out" / "inspection" / "integrity.json").read_text())
    assert report["errors"] == 0 and report["galleries"] == 5
    assert cli.main(["approve", "--out", f"{out}/inspection", "--reviewed", "2", "--by", "x"]) == 0
    path.write_text("features: []")
    assert cli.main(["validate-config", str(path)]) == 1
