"""Queries: bounds, normalisation, fusion, statistics, correlations, distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.config import LOWER, Bounds
from quadrille.functions import scoring
from quadrille.operators import normalization as nz
from quadrille.operators import statistics as st
from quadrille.plans.views import CELLS, FEATURES, FUSION, GROUPS, LINES, NAMES, cells, lines, rounded, split_of, split_sql, table

ENABLED = [f.name for f in FEATURES if f.enabled]
THRESHOLDS = [0.5, 0.55, 0.65]
SQL: dict[str, str] = {}


def fit_bounds(spark, sf):
    train = lines(spark, sf).where("split = 'train'")
    return rounded(nz.fit_bounds(train, NAMES, Bounds()))


SQL["fit_bounds"] = f"with {LINES}, t as (select * from lines where split = 'train') select " + ", ".join(
    f"round(quantile_cont({n}, 0.01), 6) as lower_{n}, round(case when quantile_cont({n}, 0.99) - quantile_cont({n}, 0.01) < 1e-8 "
    f"then quantile_cont({n}, 0.01) + 1e-8 else quantile_cont({n}, 0.99) end, 6) as upper_{n}"
    for n in NAMES
) + " from t"


def fit_bounds_large(spark, sf):
    """As fit_bounds, with brackets so narrow that small inputs take the way of large ones."""
    train = lines(spark, sf).where("split = 'train'")
    return rounded(nz.fit_bounds(train, NAMES, Bounds(), accuracy=2000))


SQL["fit_bounds_large"] = SQL["fit_bounds"]


def robust_minmax_fusion(spark, sf):
    df = lines(spark, sf)
    fitted = nz.fit_bounds(df.where("split = 'train'"), ENABLED, Bounds())
    out = nz.score(df, fitted, list(FEATURES), FUSION)
    return rounded(out.select("k", "n", "group_amount", "group_terms", "combined_score"))


_B = """b as (select quantile_cont(quantity, 0.01) as ql, quantile_cont(quantity, 0.99) as qh, quantile_cont(price, 0.01) as pl,
  quantile_cont(price, 0.99) as ph, quantile_cont(discount, 0.01) as dl, quantile_cont(discount, 0.99) as dh from lines where split = 'train')"""
_Z = """z as (select k, n, split, greatest(0.0::double, least(1.0::double, (quantity - ql) / greatest(qh - ql, 1e-8))) as nq,
  greatest(0.0::double, least(1.0::double, (price - pl) / greatest(ph - pl, 1e-8))) as np,
  1.0::double - greatest(0.0::double, least(1.0::double, (discount - dl) / greatest(dh - dl, 1e-8))) as nd from lines cross join b)"""
SQL["robust_minmax_fusion"] = f"""with {LINES}, {_B}, {_Z} select k, n, round((nq * 0.5::double + np * 0.5::double), 6) as group_amount,
  round(nd, 6) as group_terms, round(((nq * 0.5::double + np * 0.5::double) + nd) / 2.0::double, 6) as combined_score from z"""


def normalize_minmax(spark, sf):
    df = lines(spark, sf)
    fitted = nz.fit_bounds(df.where("split = 'train'"), ENABLED, Bounds())
    return rounded(nz.score(df, fitted, list(FEATURES), FUSION).select("k", "n", *[f"norm_{f}" for f in ENABLED]))


SQL["normalize_minmax"] = f"with {LINES}, {_B}, {_Z} select k, n, round(nq, 6) as norm_quantity, round(np, 6) as norm_price, round(nd, 6) as norm_discount from z"


def normalize_lower_inverted(spark, sf):
    p = table(spark, sf, "part")
    x = scoring.normalise(F.col("p_size").cast("double"), F.lit(1.0), F.lit(50.0), LOWER)
    return rounded(p.select("p_partkey", x.alias("normalised")))


SQL["normalize_lower_inverted"] = "select p_partkey, round(1.0::double - greatest(0.0::double, least(1.0::double, (p_size - 1.0::double) / 49.0::double)), 6) as normalised from part"


def fuse_grouped(spark, sf):
    c = cells(spark, sf)
    values = {"a": F.col("group_a").cast("double"), "b": F.col("group_b").cast("double"), "c": F.col("group_c").cast("double")}
    from quadrille.config import Fusion, Group

    fused = scoring.fuse(values, Fusion((Group("x", {"a": 1.0, "b": 3.0}), Group("y", {"c": 2.0}, 0.5))))
    return rounded(c.select("vec_id", "row", "col", *[v.alias(n) for n, v in fused.items()]))


SQL["fuse_grouped"] = f"""with {CELLS}, f as (select vec_id, row, col, greatest(0.0, least(1.0::double, (cast(group_a as double) + cast(group_b as double) * 3.0::double) / 4.0::double)) as x,
  greatest(0.0, least(1.0::double, cast(group_c as double))) as y from cells)
select vec_id, row, col, round(x, 6) as group_x, round(y, 6) as group_y, round((x + y * 0.5::double) / 1.5::double, 6) as combined_score from f"""


def score_maps_single(spark, sf):
    """Stored precision: normalised values and groups in single precision."""
    df = cells(spark, sf).withColumnsRenamed({"v": "quantity", "score": "price", "group_c": "discount"}).drop("group_a", "group_b")
    fitted = nz.fit_bounds(df.where("split = 'train'"), ENABLED, Bounds())
    out = nz.score(df, fitted, list(FEATURES), FUSION, single=True)
    return out.select("vec_id", "row", "col", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("group_amount", "group_terms", "combined_score")])


SQL["score_maps_single"] = f"""with {CELLS}, lines as (select vec_id as k, row * 8 + col as n, split, v as quantity, cast(score as double) as price,
  cast(group_c as double) as discount from cells), {_B}, {_Z}
select k as vec_id, cast(n // 8 as integer) as row, cast(n % 8 as integer) as col,
  round(cast(cast(cast(cast(nq as float) as double) * 0.5::double + cast(cast(np as float) as double) * 0.5::double as float) as double), 5) as group_amount,
  round(cast(cast(nd as float) as double), 5) as group_terms,
  round(cast(cast((cast(cast(nq as float) as double) * 0.5::double + cast(cast(np as float) as double) * 0.5::double + cast(cast(nd as float) as double)) / 2.0::double as float) as double), 5) as combined_score from z"""


def feature_statistics(spark, sf):
    out = st.feature_statistics(lines(spark, sf), NAMES)
    # Means of decimals may lie just between two roundings; both engines add the same hair.
    return rounded(out.withColumns({"mean": F.col("mean") + 1e-9, "std": F.col("std") + 1e-9}))


_Q = ((0.01, "q01"), (0.25, "q25"), (0.5, "median"), (0.75, "q75"), (0.99, "q99"))


def _quantiles(x: str) -> str:
    return ", ".join(f"round(quantile_cont({x}, {p}), 6) as {n}" for p, n in _Q)


_UNPIVOT = "u as (" + " union all ".join(f"select split, '{n}' as feature, {n} as value from lines" for n in NAMES) + ")"
SQL["feature_statistics"] = f"""with {LINES}, {_UNPIVOT} select feature, count(*) as n, count(value) as finite_count, round(min(value), 6) as minimum, {_quantiles('value')},
  round(avg(value) + 1e-9, 6) as mean, round(max(value), 6) as maximum, round(stddev_pop(value) + 1e-9, 6) as std, count(distinct value) as distinct_values from u group by feature"""


def corr_pearson(spark, sf):
    return rounded(st.correlations(lines(spark, sf), NAMES))


def _corr_sql(source: str) -> str:
    pairs = " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as correlation from {source}" for a in NAMES for b in NAMES)
    return pairs


SQL["corr_pearson"] = f"with {LINES} {_corr_sql('lines')}"


def corr_spearman(spark, sf):
    return rounded(st.spearman(lines(spark, sf), NAMES))


_RANKS = "ranks as (select " + ", ".join(f"rank() over (order by {n}) + (count(*) over (partition by {n}) - 1) / 2.0::double as {n}" for n in NAMES) + " from lines)"
SQL["corr_spearman"] = f"with {LINES}, {_RANKS} {_corr_sql('ranks')}"


def high_corr_pairs(spark, sf):
    return rounded(st.high_pairs(st.correlations(lines(spark, sf), NAMES), NAMES, 0.005))


SQL["high_corr_pairs"] = f"with {LINES}, m as ({_corr_sql('lines')}), i(name, nr) as (values " + ", ".join(f"('{n}', {k})" for k, n in enumerate(NAMES)) + ") select a, b, correlation from m join i x on x.name = a join i y on y.name = b where x.nr < y.nr and abs(correlation) >= 0.005"


def average_rank(spark, sf):
    return st.average_rank(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", "rank")


SQL["average_rank"] = "select p_partkey, p_size, rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0::double as rank from part"


def label_statistics(spark, sf):
    return rounded(st.partial_statistics(cells(spark, sf), ["split", "vec_id"], "score"))


_X = "cast(score as double)"
SQL["label_statistics"] = f"""with {CELLS} select split, vec_id, round(min({_X}), 6) as minimum, round(max({_X}), 6) as maximum, round(avg({_X}), 6) as mean, round(stddev_pop({_X}), 6) as std,
  round(sum({_X}), 6) as total, round(sum({_X} * {_X}), 6) as total_squares, count(*) as n from cells group by all"""


def split_summary(spark, sf):
    return rounded(st.merged_statistics(st.partial_statistics(cells(spark, sf), ["split", "vec_id"], "score"), ["split"]))


SQL["split_summary"] = f"""with {CELLS} select split, count(distinct vec_id) as parts, count(*) as n, round(avg({_X}), 6) as mean,
  round(sqrt(greatest(sum({_X} * {_X}) / count(*) - avg({_X}) * avg({_X}), 0)), 6) as std, round(min({_X}), 6) as minimum, round(max({_X}), 6) as maximum from cells group by split"""


def group_running_stats(spark, sf):
    named = F.array(*[F.struct(F.lit(g).alias("group"), F.col(g).alias("value")) for g in GROUPS])
    long = cells(spark, sf).select("split", "vec_id", F.explode(named).alias("c")).select("split", "vec_id", F.col("c.group").alias("group_name"), F.col("c.value").alias("value"))
    return rounded(st.merged_statistics(st.partial_statistics(long, ["split", "group_name", "vec_id"], "value"), ["split", "group_name"]))


SQL["group_running_stats"] = f"with {CELLS}, u as (" + " union all ".join(f"select split, vec_id, '{g}' as group_name, cast({g} as double) as x from cells" for g in GROUPS) + """)
select split, group_name, count(distinct vec_id) as parts, count(*) as n, round(avg(x), 6) as mean, round(sqrt(greatest(sum(x * x) / count(*) - avg(x) * avg(x), 0)), 6) as std,
  round(min(x), 6) as minimum, round(max(x), 6) as maximum from u group by all"""


def clipping_stats(spark, sf):
    df = lines(spark, sf)
    fitted = nz.fit_bounds(df.where("split = 'train'"), ENABLED, Bounds())
    scored = nz.score(df, fitted, list(FEATURES), FUSION)
    return rounded(st.clipping(scored, ["split"], [f"norm_{f}" for f in ENABLED]))


SQL["clipping_stats"] = f"""with {LINES}, {_B}, {_Z}, u as (select split, 'norm_quantity' as feature, nq as x from z union all select split, 'norm_price', np from z union all select split, 'norm_discount', nd from z)
select split, feature, count(x) as n, count_if(x <= 1e-6) as at_zero, count_if(x >= 1 - 1e-6) as at_one, round(count_if(x <= 1e-6) / count(x), 6) as zero_fraction,
  round(count_if(x >= 1 - 1e-6) / count(x), 6) as one_fraction from u group by all"""


def _share(condition: str) -> str:
    return f"round(avg(case when {condition} then 1.0::double else 0.0::double end), 6)"


_RECORD = f"""count(*) as n, round(min({_X}), 6) as minimum, {_quantiles(_X)}, round(avg({_X}), 6) as mean, round(max({_X}), 6) as maximum, round(stddev_pop({_X}), 6) as std,
  {_share('score <= 1e-6::float')} as zero_fraction, {_share('score >= (1 - 1e-6)::float')} as one_fraction, {_share('score <= 0.10::float')} as low_fraction, {_share('score >= 0.90::float')} as high_fraction, """ + ", ".join(
    f"{_share(f'score >= {t}::float')} as fraction_ge_{t:.2f}".replace("fraction_ge_0.", "fraction_ge_0_") for t in THRESHOLDS
)
# Shares of a few hundred rows have up to eight places, and must not be rounded at a tie.
_RECORD = _RECORD.replace(", 6)", ", 9)")


def image_record(spark, sf):
    return rounded(st.score_record(cells(spark, sf), ["split", "vec_id"], "score", THRESHOLDS), 9)


SQL["image_record"] = f"with {CELLS} select split, vec_id, {_RECORD} from cells group by split, vec_id"


def split_record(spark, sf):
    return rounded(st.score_record(cells(spark, sf), ["split"], "score", THRESHOLDS, few=True), 9)


SQL["split_record"] = f"with {CELLS} select split, {_RECORD} from cells group by split"


def threshold_fractions(spark, sf):
    """Share of scores at or over each candidate threshold, by split."""
    from quadrille.config import threshold_candidates

    c = cells(spark, sf)
    t = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), (F.col("score") >= scoring.with_float(t)).alias("over")) for t in threshold_candidates()]))
    return rounded(c.select("split", t.alias("x")).groupBy("split", F.col("x.t").alias("threshold")).agg(st.share(F.col("x.over")).alias("fraction")), 9)


SQL["threshold_fractions"] = f"""with {CELLS}, t as (select round(0.5::double + i * 0.01::double, 10) as threshold from range(17) r(i))
select split, round(threshold, 9) as threshold, {_share('score >= threshold::float').replace(', 6)', ', 9)')} as fraction from cells cross join t group by split, threshold"""


def threshold_candidates(spark, sf):
    from quadrille.config import threshold_candidates as grid

    return spark.createDataFrame([(k, t) for k, t in enumerate(grid())], "place int, threshold double")


SQL["threshold_candidates"] = "select cast(i as integer) as place, round(0.5::double + i * 0.01::double, 10) as threshold from range(17) r(i)"


def histogram_density(spark, sf):
    return rounded(st.histogram(cells(spark, sf), ["split"], "score"))


SQL["histogram_density"] = f"""with {CELLS}, h as (select split, cast(least(floor(({_X} - 0.0::double) / 0.02::double), 49) as integer) as bin, count(*) as n from cells group by all)
select split, bin, n, round(n / (sum(n) over (partition by split) * 0.02::double), 6) as density from h"""

_PAIRS = [("train", "validation"), ("train", "test"), ("validation", "test")]


def distribution_distances(spark, sf):
    return rounded(st.distances(cells(spark, sf), "split", "score", _PAIRS))


_DIST = """d as (select a as first_split, b as second_split, v, count_if(s = a) as na, count_if(s = b) as nb from vals join pairs on s = a or s = b group by all),
f as (select *, sum(na) over w / sum(na) over p - sum(nb) over w / sum(nb) over p as gap, lead(v) over w - v as width from d
  window p as (partition by first_split, second_split), w as (partition by first_split, second_split order by v))
select first_split, second_split, cast(sum(na) as bigint) as first_count, cast(sum(nb) as bigint) as second_count, round(max(abs(gap)), 6) as ks_statistic,
  round(sum(abs(gap) * coalesce(width, 0.0::double)), 6) as wasserstein, round(sum(v * na) / sum(na) - sum(v * nb) / sum(nb), 6) as mean_difference from f group by all"""
_VALUES = "pairs(a, b) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in _PAIRS) + ")"
SQL["distribution_distances"] = f"with {CELLS}, {_VALUES}, vals as (select split as s, {_X} as v from cells), {_DIST}"


def ks_statistic(spark, sf):
    e = table(spark, sf, "events").select("event_type", "value")
    return rounded(st.distances(e, "event_type", "value", [("click", "view"), ("click", "error")]))


SQL["ks_statistic"] = f"with pairs(a, b) as (values ('click', 'view'), ('click', 'error')), vals as (select event_type as s, value as v from events where value is not null), {_DIST}"


def ks_with_p_value(spark, sf):
    """The statistic with its asymptotic p-value, one row for each pair."""
    rows = ks_statistic(spark, sf).collect()
    out = [(r.first_split, r.second_split, r.ks_statistic, st.ks_p_value(r.ks_statistic, r.first_count, r.second_count)) for r in rows]
    return spark.createDataFrame(out, "first_split string, second_split string, ks_statistic double, p_value double")


def mean_difference(spark, sf):
    e = table(spark, sf, "events")
    mean = lambda s: F.avg(F.when(F.col("event_type") == s, F.col("value")))
    return rounded(e.agg((mean("click") - mean("view")).alias("mean_difference")))


SQL["mean_difference"] = "select round(avg(value) filter (where event_type = 'click') - avg(value) filter (where event_type = 'view'), 6) as mean_difference from events"


def median_of_means(spark, sf):
    means = cells(spark, sf).groupBy("vec_id").agg(F.avg(F.col("score").cast("double")).alias("mean"))
    return rounded(nz.exact_quantiles(means, ["mean"], [0.5]).select(F.col("value").alias("median_mean")))


SQL["median_of_means"] = f"with {CELLS}, m as (select avg({_X}) as mean from cells group by vec_id) select round(median(mean), 6) as median_mean from m"


def empty_statistics(spark, sf):
    """Statistics of events that never happen: sums are zero, extremes null, in each type's group of no values."""
    none = table(spark, sf, "events").select("event_type", F.when(F.col("value") < -1e12, F.col("value")).alias("v"))
    merged = st.merged_statistics(st.partial_statistics(none, ["event_type"], "v"), ["event_type"])
    return rounded(merged.select("event_type", "parts", F.coalesce("n", F.lit(0)).alias("n"), "mean", "std", "minimum", "maximum"))


SQL["empty_statistics"] = """select event_type, cast(1 as bigint) as parts, count(v) as n, coalesce(avg(v), 0.0) as mean, coalesce(stddev_pop(v), 0.0) as std,
min(v) as minimum, max(v) as maximum from (select event_type, case when value < -1e12 then value end as v from events) group by event_type"""
del split_of, split_sql
