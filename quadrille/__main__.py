"""Command line: validate-config, validate-dataset, review, generate, inspect, approve."""

from __future__ import annotations

import argparse
import json
import sys

from quadrille import config


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quadrille", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("validate-config", "validate-dataset", "review", "generate", "inspect"):
        p = commands.add_parser(name)
        p.add_argument("config")
        if name != "validate-config":
            p.add_argument("--data", required=True, help="folder with a folder for each split")
            p.add_argument("--out", required=True)
    commands.choices["generate"].add_argument("--force", action="store_true", help="fit the bounds and make all labels anew")
    p = commands.add_parser("approve")
    p.add_argument("--out", required=True)
    p.add_argument("--reviewed", type=int, required=True)
    p.add_argument("--by", required=True)
    a = parser.parse_args(args)
    from quadrille.plans import inspection, labeling, review, validation
    from quadrille.sources import images as im
    from quadrille.sources import labels as lb

    if a.command == "approve":
        with open(f"{a.out}/integrity.json", encoding="utf-8") as f:
            print(json.dumps(labeling.approve(json.load(f), a.reviewed, a.by, f"{a.out}/approval.json")))
        return 0
    try:
        settings = config.load(a.config)
    except config.ConfigError as e:
        print(e, file=sys.stderr)
        return 1
    if a.command == "validate-config":
        print(f"{len(settings.enabled)} features, {settings.grid.windows} windows an image")
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.builder.appName(f"quadrille {a.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    folders = {s: f"{a.data}/{s}" for s in config.SPLITS}
    if a.command == "validate-dataset":
        out = validation.write(validation.validate(spark, folders, settings.grid, settings.channels), a.out)
        print(json.dumps(out))
        return 0 if out["valid"] else 1
    images = im.read_splits(spark, folders)
    if a.command == "review":
        found = review.review(images, settings.grid, settings.features, settings.fusion, settings.bounds)
        for name in ("rows", "synthetic", "statistics", "pearson", "spearman", "high"):
            lb.write_report(getattr(found, name), f"{a.out}/{name}")
    elif a.command == "generate":
        artifact = labeling.fit(images, settings.grid, settings.features, settings.bounds, f"{a.out}/bounds.json", a.force)
        made = labeling.generate_into(images, artifact, settings.grid, settings.features, settings.fusion, f"{a.out}/labels", a.force)
        lb.write_report(made, f"{a.out}/manifest")
    else:
        sources = images.select("split", F.col("relative_path").alias("source_relative_path"))
        groups = [g.name for g in settings.fusion.groups]
        found = inspection.inspect(lb.read_labels(spark, f"{a.out}/labels"), sources, settings.grid, list(settings.enabled), groups, limits=settings.flags)
        print(json.dumps(inspection.write(found, f"{a.out}/inspection")))
    return 0


if __name__ == "__main__":
    sys.exit(main())
