"""Exact percentile bounds, and scoring with them."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.config import Bounds, Feature, Fusion
from quadrille.functions import scoring

#: Accuracy of the sketch that brackets a quantile: its rank is off by at most 1 / ACCURACY of the rows.
ACCURACY = 100_000


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """(``feature``, ``share``, ``value``): exact quantiles, linearly interpolated.

    The built-in exact percentile holds every distinct value of a column in one
    reducer. Here a sketch brackets each quantile, one pass counts what lies
    below the bracket and groups the values inside, and only those (about
    4 / accuracy of the rows) are put in order.
    """
    # One pass: sizes, extremes and the sketch. Up to a few times ACCURACY values are ordered as they are.
    x = {c: F.col(c).cast("double") for c in columns}
    slack = 3.0 / accuracy
    around = [min(1.0, max(0.0, s + d)) for s in shares for d in (-slack, slack)]
    seen = df.agg(
        F.lit(0),
        *[F.count(x[c]).alias(f"n_{c}") for c in columns],
        *[F.array(F.min(x[c]), F.max(x[c])).alias(f"ends_{c}") for c in columns],
        *[F.percentile_approx(x[c], around, accuracy).alias(c) for c in columns],
    ).first()
    columns = [c for c in columns if seen[f"n_{c}"]]
    counts = {c: seen[f"n_{c}"] for c in columns}
    sketch = {c: seen[c] if counts[c] > 3 * accuracy else seen[f"ends_{c}"] * len(shares) for c in columns}
    cells = []
    for c in columns:
        for k, s in enumerate(shares):
            low, high = sketch[c][2 * k : 2 * k + 2]
            x = F.col(c).cast("double")
            # Below the bracket only the number matters; above it nothing does.
            cells.append(
                F.when(
                    x <= high,
                    F.struct(
                        F.lit(c).alias("feature"),
                        F.lit(s).alias("share"),
                        F.lit(counts[c]).alias("n"),
                        F.when(x >= low, x).alias("value"),
                    ),
                )
            )
    if not cells:
        return df.sparkSession.createDataFrame([], "feature string, share double, value double")
    grouped = (
        df.select(F.explode(F.array_compact(F.array(*cells))).alias("c"))
        .groupBy("c.feature", "c.share", "c.n", "c.value")
        .agg(F.count("*").alias("m"))
    )
    w = Window.partitionBy("feature", "share").orderBy(F.col("value").asc_nulls_first())
    place = F.col("share") * (F.col("n") - 1)
    ranked = grouped.withColumn("before", F.sum("m").over(w) - F.col("m")).where("value is not null")
    at = lambda rank: F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("m")), F.col("value")))
    ends = ranked.groupBy("feature", "share", "n").agg(at(F.floor(place)).alias("a"), at(F.ceil(place)).alias("b"))
    return ends.select("feature", "share", (F.col("a") + (F.col("b") - F.col("a")) * (place - F.floor(place))).alias("value"))


def fit_bounds(df: DataFrame, features: list[str], bounds: Bounds, accuracy: int = ACCURACY) -> DataFrame:
    """One row: ``lower_f`` and ``upper_f`` of each feature; a span under epsilon is widened to it.

    By :func:`exact_quantiles`, in memory that does not grow with the rows.
    """
    shares = [bounds.low / 100, bounds.high / 100]
    q = exact_quantiles(df, features, shares, accuracy)
    at = lambda f, s: F.max(F.when((F.col("feature") == f) & (F.col("share") == s), F.col("value")))
    wide = q.agg(*[at(f, s).alias(f"{n}_{f}") for f in features for n, s in zip("lh", shares, strict=True)])
    return wide.select(*[c for f in features for c in _pair(f, F.col(f"l_{f}"), F.col(f"h_{f}"), bounds)])


def _pair(f: str, low, high, bounds: Bounds) -> list:
    wide = F.when(high - low < bounds.epsilon, low + bounds.epsilon).otherwise(high)
    return [low.alias(f"lower_{f}"), wide.alias(f"upper_{f}")]


def score(df: DataFrame, fitted: DataFrame, features: list[Feature], fusion: Fusion, single: bool = False) -> DataFrame:
    """``df`` with ``norm_f``, ``group_g`` and ``combined_score``.

    ``fitted`` has one row, so the broadcast cannot grow. ``single``: stored
    normalised values, groups and scores are single precision, while the
    combined score is made of unrounded groups.
    """
    joined = df.crossJoin(F.broadcast(fitted))
    norm = {
        f.name: scoring.normalise(F.col(f.name), F.col(f"lower_{f.name}"), F.col(f"upper_{f.name}"), f.direction)
        for f in features
        if f.enabled
    }
    if single:
        norm = {n: c.cast("float") for n, c in norm.items()}
    joined = joined.withColumns({f"norm_{n}": c for n, c in norm.items()}).drop(*fitted.columns)
    values = {n: F.col(f"norm_{n}") for n in norm}
    if single:
        weights = {m: w for g in fusion.groups for m, w in g.members.items()}
        # A product with a weight rounds to single precision; sums do not.
        values = {n: (c * F.lit(float(weights[n])).cast("float")).cast("double") / float(weights[n]) for n, c in values.items()}
    fused = scoring.fuse(values, fusion)
    return joined.withColumns({n: c.cast("float") if single else c for n, c in fused.items()})


@dataclass(frozen=True)
class Artifact:
    """Fitted bounds as they are kept between runs."""

    fingerprint: str
    fit_split: str
    images: int
    rows: int
    names: tuple[str, ...]
    lower: tuple[float, ...]
    upper: tuple[float, ...]
    low: float
    high: float
    version: int = 1

    def errors(self, fingerprint: str | None = None, names: tuple[str, ...] | None = None) -> list[str]:
        out = []
        if self.version != 1:
            out.append("unknown version")
        if self.fit_split != "train":
            out.append("bounds must be fitted on the training split")
        if fingerprint is not None and fingerprint != self.fingerprint:
            out.append("fingerprint differs")
        if names is not None and tuple(names) != tuple(self.names):
            out.append("feature names differ")
        if len(self.names) != len(self.lower) or len(self.names) != len(self.upper):
            out.append("one pair of bounds is needed for each feature")
        if self.images <= 0 or self.rows <= 0:
            out.append("counts must be positive")
        for n, a, b in zip(self.names, self.lower, self.upper, strict=False):
            if not (abs(a) < float("inf") and abs(b) < float("inf") and b > a):
                out.append(f"bounds of {n} must be finite and ascending")
        return out

    def dict(self) -> dict:
        return asdict(self)

    def frame(self, spark) -> DataFrame:
        """The one-row DataFrame that :func:`score` takes."""
        row = [v for pair in zip(self.lower, self.upper, strict=True) for v in pair]
        names = [f"{s}_{n}" for n in self.names for s in ("lower", "upper")]
        return spark.createDataFrame([row], ", ".join(f"`{n}` double" for n in names))
