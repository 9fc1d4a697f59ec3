"""Checks of datasets and labels: issues, duplicates, reconciliation, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.config import Flags
from quadrille.functions.scoring import with_float
from quadrille.operators.statistics import share


def issues_of(df: DataFrame, checks: list[tuple[Column, str, str, Column]], keys: list[str]) -> DataFrame:
    """One row for each failed check: ``keys``, severity, code, message.

    A check is (condition that fails, severity, code, message); those of
    severity ``ignore`` are dropped.
    """
    cells = [
        F.when(bad, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message")))
        for bad, severity, code, message in checks
        if severity != "ignore"
    ]
    return df.select(*keys, F.explode(F.array_compact(F.array(*cells))).alias("i")).select(*keys, "i.*")


def image_checks(width: int, height: int, channels: int, severity: dict[str, str] | None = None) -> list:
    """The checks of an image row; an unreadable image fails that one only."""
    of = lambda code: (severity or {}).get(code, "error")
    readable = F.col("readable")
    size = F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))
    return [
        (~readable, of("UNREADABLE_IMAGE"), "UNREADABLE_IMAGE", F.lit("the image cannot be decoded")),
        (
            readable & ((F.col("width") != width) | (F.col("height") != height)),
            of("INVALID_IMAGE_DIMENSIONS"),
            "INVALID_IMAGE_DIMENSIONS",
            F.concat(F.lit(f"expected {width}x{height}, found "), size),
        ),
        (
            readable & ~F.col("mode").eqNullSafe(F.lit("RGB" if channels == 3 else "L")),
            of("INVALID_COLOR_MODE"),
            "INVALID_COLOR_MODE",
            F.concat(F.lit("unexpected mode "), F.coalesce("mode", F.lit("none"))),
        ),
        (
            readable & ~F.col("channels").eqNullSafe(F.lit(channels)),
            of("INVALID_CHANNEL_COUNT"),
            "INVALID_CHANNEL_COUNT",
            F.concat(F.lit(f"expected {channels}, found "), F.coalesce(F.col("channels").cast("string"), F.lit("none"))),
        ),
    ]


def duplicates(df: DataFrame, key: Column, kind: str, path: str = "path", split: str = "split") -> DataFrame:
    """Groups of rows with one key: kind, key, code, n, splits.

    Null and empty keys never match. A group over several splits is of the
    ACROSS kind, else WITHIN. Members are counted, not collected.
    """
    keyed = df.select(key.alias("key"), split).where((F.col("key") != "") & F.col("key").isNotNull())
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(split)).alias("splits")).where("n > 1")
    where = F.when(F.size("splits") > 1, "ACROSS_SPLITS").otherwise("WITHIN_SPLIT")
    return groups.select(F.lit(kind.lower()).alias("kind"), "key", F.concat(F.lit(f"DUPLICATE_{kind}_"), where).alias("code"), "n", "splits")


def duplicate_issues(
    df: DataFrame, key: Column, kind: str, across: str = "error", within: str = "warning", path: str = "path", split: str = "split"
) -> DataFrame:
    """One issue for each member of each group: severity, code, split, path."""
    found = duplicates(df, key, kind, path, split).select("key", "code")
    rows = df.select(key.alias("key"), split, path).join(found, "key")
    severity = F.when(F.col("code").endswith("ACROSS_SPLITS"), across).otherwise(within)
    return rows.select(severity.alias("severity"), "code", F.col(split).alias("split"), F.col(path).alias("path")).where("severity <> 'ignore'")


def with_codes(df: DataFrame, issues: DataFrame, path: str = "path") -> DataFrame:
    """``df`` with ``codes``: the distinct codes of its path, sorted, joined by ``|``."""
    codes = issues.groupBy(path).agg(F.array_join(F.array_sort(F.collect_set("code")), "|").alias("codes"))
    return df.join(codes, path, "left").withColumn("codes", F.coalesce("codes", F.lit("")))


def issue_summary(issues: DataFrame) -> DataFrame:
    """Counts for each split, each severity and each code, in one pass: (scope, name, n)."""
    cells = F.array(*[F.struct(F.lit(c).alias("scope"), F.col(c).alias("name")) for c in ("split", "severity", "code")])
    return issues.select(F.explode(cells).alias("c")).groupBy("c.scope", "c.name").agg(F.count("*").alias("n"))


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key ``right`` lacks; a null or empty key is not looked for."""
    return left.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).join(right.select(key).distinct(), key, "left_anti")


def later_occurrences(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """All rows of a key but the first in order; the empty key is a key too."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("occurrence", F.row_number().over(w)).where("occurrence > 1")


def count_mismatch(df: DataFrame, expected: DataFrame, split: str = "split") -> DataFrame:
    """Splits with other counts than expected; a null expectation is not checked.

    ``expected`` has a row for each split, so it is small by nature.
    """
    counts = df.groupBy(split).agg(F.count("*").alias("found"))
    out = expected.join(counts, split, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.where(F.col("expected").isNotNull() & (F.col("expected") != F.col("found")))


def empty_splits(df: DataFrame, splits: DataFrame, split: str = "split") -> DataFrame:
    return splits.join(df.select(split).distinct(), split, "left_anti")


def fingerprints(df: DataFrame, keys: list[str], fingerprint: str) -> DataFrame:
    """Distinct non-empty fingerprints of each group; consistent if there is exactly one."""
    named = F.nullif(F.col(fingerprint), F.lit(""))
    out = df.groupBy(*keys).agg(F.count_distinct(named).alias("fingerprints"), F.count("*").alias("n"))
    return out.withColumn("consistent", F.col("fingerprints") == 1)


def array_checks(required: list[str], names: list[str], groups: list[str], rows: int, cols: int, tolerance: float = 1e-6) -> list:
    """The checks of a label row; codes as in the report."""
    shape = lambda a, r, c: (F.size(a) != r) | F.exists(a, lambda x: F.size(x) != c)
    cube = lambda a, n: (F.size(a) != n) | F.exists(a, lambda m: shape(m, rows, cols))
    listed = lambda wanted: F.array(*[F.lit(n) for n in wanted]).cast("array<string>")
    flat3 = lambda c: F.flatten(F.flatten(F.col(c)))
    values = {"score_map": F.flatten(F.col("score_map")), "normalized_feature_maps": flat3("normalized_feature_maps"), "group_score_maps": flat3("group_score_maps")}
    odd = lambda a: F.exists(a, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    finite = [values[k] for k in values] + [flat3("raw_feature_maps")]
    clean = {k: ~F.exists(v, lambda x: F.isnan(x)) for k, v in values.items()}
    below = [clean[k] & (F.array_min(v).cast("double") < -tolerance) for k, v in values.items()]
    above = [clean[k] & (F.array_max(v).cast("double") > 1 + tolerance) for k, v in values.items()]
    any_ = lambda cs: F.coalesce(_or(cs), F.lit(False))
    structural = [
        (shape(F.col("score_map"), rows, cols), "INVALID_SCORE_MAP_SHAPE"),
        (cube(F.col("raw_feature_maps"), len(names)), "INVALID_RAW_FEATURE_SHAPE"),
        (cube(F.col("normalized_feature_maps"), len(names)), "INVALID_NORMALIZED_FEATURE_SHAPE"),
        (cube(F.col("group_score_maps"), len(groups)), "INVALID_GROUP_MAP_SHAPE"),
        ((F.size("window_coordinates") != rows) | F.exists("window_coordinates", lambda r: F.size(r) != cols), "INVALID_COORDINATE_SHAPE"),
        (~F.col("feature_names").eqNullSafe(listed(names)), "FEATURE_NAME_MISMATCH"),
        (~F.col("group_names").eqNullSafe(listed(groups)), "GROUP_NAME_MISMATCH"),
    ]
    lacking = _or([F.col(c).isNull() for c in required])
    version = ~F.col("label_file_version").eqNullSafe(F.lit(1))
    sound = ~lacking & ~version
    bad = any_([c for c, _ in structural])
    out = [(lacking, "MISSING_REQUIRED_ARRAYS"), (~lacking & version, "INVALID_LABEL_VERSION")]
    out += [(sound & F.coalesce(c, F.lit(True)), code) for c, code in structural]
    out += [(sound & ~bad & any_([odd(v) for v in finite]), "NON_FINITE_VALUES")]
    out += [(sound & ~bad & any_(below), "VALUE_BELOW_ZERO"), (sound & ~bad & any_(above), "VALUE_ABOVE_ONE")]
    return [(c, "error", code, F.lit(code.lower().replace("_", " "))) for c, code in out]


def _or(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


#: The codes after which a label row takes no further part.
REJECTED = (
    "MISSING_REQUIRED_ARRAYS",
    "INVALID_LABEL_VERSION",
    "UNREADABLE_LABEL_FILE",
    "INVALID_SCORE_MAP_SHAPE",
    "INVALID_RAW_FEATURE_SHAPE",
    "INVALID_NORMALIZED_FEATURE_SHAPE",
    "INVALID_GROUP_MAP_SHAPE",
    "INVALID_COORDINATE_SHAPE",
    "FEATURE_NAME_MISMATCH",
    "GROUP_NAME_MISMATCH",
)


def peak_share(scores: DataFrame, keys: list[str], row: str, col: str, score: str, rows: int, cols: int, least: float) -> DataFrame:
    """Share of cells that exceed the 3 x 3 median around them by ``least``; edges are repeated."""
    around = median3x3(scores, keys, row, col, score, rows, cols)
    gap = F.col(score) - F.col("around").cast("float")
    return around.groupBy(*keys).agg(share(gap >= with_float(least)).alias("peak_fraction"))


def median3x3(scores: DataFrame, keys: list[str], row: str, col: str, score: str, rows: int, cols: int) -> DataFrame:
    """``keys``, ``row``, ``col``, ``score`` and ``around``: the median of the 3 x 3 cells, edges repeated.

    Each map is put in one row (a map has rows x cols cells by definition), so
    neighbours are found without a join.
    """
    cell = F.struct(F.col(row).cast("int").alias("r"), F.col(col).cast("int").alias("c"), F.col(score).alias("s"))
    maps = scores.groupBy(*keys).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    clamp = lambda x, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), x))

    def middle(cell: Column) -> Column:
        near = F.array(
            *[
                F.get("cells", clamp(cell["r"] + i, rows) * cols + clamp(cell["c"] + j, cols))["s"]
                for i in (-1, 0, 1)
                for j in (-1, 0, 1)
            ]
        )
        return F.get(F.sort_array(near), F.lit(4))

    out = maps.select(
        *keys, F.explode(F.transform("cells", lambda x: F.struct(x["r"], x["c"], x["s"], middle(x).alias("m")))).alias("x")
    )
    return out.select(*keys, F.col("x.r").alias(row), F.col("x.c").alias(col), F.col("x.s").alias(score), F.col("x.m").alias("around"))


def suspicious(record: DataFrame, groups: list[str], limits: Flags) -> DataFrame:
    """``record`` with ``flags`` (in report order, joined by ``|``) and ``flag_count``.

    ``record`` has std, zero/one/low/high fractions, peak_fraction and a mean
    for each group.
    """
    c = F.col
    gap = F.greatest(*[c(g) for g in groups]) - F.least(*[c(g) for g in groups]) if len(groups) > 1 else F.lit(0.0)
    rules = [
        F.when(c("std") <= limits.constant_std, "CONSTANT_OR_NEAR_CONSTANT_MAP").when(c("std") <= limits.low_std, "LOW_MAP_VARIATION"),
        F.when(c("std") >= limits.high_std, "HIGH_MAP_VARIATION"),
        F.when(c("low_fraction") >= limits.most_low, "ALMOST_ALL_SCORES_LOW"),
        F.when(c("high_fraction") >= limits.most_high, "ALMOST_ALL_SCORES_HIGH"),
        F.when(c("zero_fraction") >= limits.most_zero, "EXCESSIVE_EXACT_ZEROS"),
        F.when(c("one_fraction") >= limits.most_one, "EXCESSIVE_EXACT_ONES"),
        F.when(gap >= limits.group_gap, "LARGE_GROUP_DISAGREEMENT"),
        F.when(c("peak_fraction") >= limits.most_peaks, "ISOLATED_SCORE_PEAKS"),
    ]
    found = F.array_compact(F.array(*rules))
    return record.withColumns({"flags": F.array_join(found, "|"), "flag_count": F.size(found)})
