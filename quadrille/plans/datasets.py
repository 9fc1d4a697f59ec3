"""Queries: dataset checks, duplicates, reconciliation, reports, keys."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quadrille.config import SPLITS
from quadrille.functions import hashing
from quadrille.operators import quality
from quadrille.plans.views import FEATURES, FILES, FUSION, cells, files, rounded, split_of, split_sql, table
from quadrille.sources import labels as lb

SQL: dict[str, str] = {}


def _labels(spark, sf):
    l = table(spark, sf, "labels")  # noqa: E741
    return l.select("doc_id", F.concat(F.lit("label_"), F.col("doc_id").cast("string"), F.lit(".npz")).alias("label_name"), "quality", "toxic")


def missing_labels(spark, sf):
    """Sources without a label, in order."""
    return quality.missing(files(spark, sf).select("doc_id", "path"), _labels(spark, sf), "doc_id").orderBy("path")


SQL["missing_labels"] = f"with {FILES} select doc_id, path from files where doc_id not in (select doc_id from labels)"


def orphan_labels(spark, sf):
    """Labels whose source is not a document of the training split."""
    train = files(spark, sf).where("split = 'train'").select("doc_id")
    return quality.missing(_labels(spark, sf).select("doc_id", "label_name"), train, "doc_id")


SQL["orphan_labels"] = f"with {FILES} select doc_id, concat('label_', doc_id, '.npz') as label_name from labels where doc_id not in (select doc_id from files where split = 'train')"


def duplicate_source_labels(spark, sf):
    """Second and later labels of one source (documents of equal content share it), in file order."""
    l = _labels(spark, sf).join(files(spark, sf).select("doc_id", "content_hash"), "doc_id")  # noqa: E741
    out = quality.later_occurrences(l, "content_hash", [F.lower("label_name"), F.col("label_name")])
    return out.select("doc_id", "content_hash", F.col("occurrence").cast("bigint").alias("occurrence"))


SQL["duplicate_source_labels"] = f"with {FILES}, r as (select doc_id, content_hash, row_number() over (partition by content_hash order by concat('label_', doc_id, '.npz')) as occurrence from labels join files using (doc_id)) select * from r where occurrence > 1"

_KINDS = (("FILENAME", "filename"), ("CONTENT", "content_hash"))


def duplicate_content(spark, sf):
    f = files(spark, sf)
    out = quality.duplicates(f, F.col("content_hash"), "CONTENT")
    return out.select("kind", "key", "code", "n", F.array_join("splits", ",").alias("splits"))


def _duplicates_sql(kind: str, key: str) -> str:
    return f"""select '{kind.lower()}' as kind, {key} as key, 'DUPLICATE_{kind}_' || case when count(distinct split) > 1 then 'ACROSS_SPLITS' else 'WITHIN_SPLIT' end as code, count(*) as n,
  string_agg(distinct split, ',' order by split) as splits from files where {key} is not null and {key} <> '' group by {key} having count(*) > 1"""


SQL["duplicate_content"] = f"with {FILES} {_duplicates_sql('CONTENT', 'content_hash')}"


def duplicate_filename(spark, sf):
    """File names that differ in case only are equal."""
    f = files(spark, sf).withColumn("filename", F.when(F.col("doc_id") % 2 == 0, F.upper("filename")).otherwise(F.col("filename")))
    out = quality.duplicates(f, hashing.folded(F.col("filename")), "FILENAME")
    return out.select("kind", "key", "code", "n", F.array_join("splits", ",").alias("splits"))


SQL["duplicate_filename"] = f"with {FILES} {_duplicates_sql('FILENAME', 'lower(filename)')}"


def duplicate_severity(spark, sf):
    """One issue for each member of a group of equal contents."""
    return quality.duplicate_issues(files(spark, sf), F.col("content_hash"), "CONTENT")


_DUP_ISSUES = """dup as (select content_hash, count(distinct split) as s from files group by content_hash having count(*) > 1),
di as (select case when s > 1 then 'error' else 'warning' end as severity, 'DUPLICATE_CONTENT_' || case when s > 1 then 'ACROSS_SPLITS' else 'WITHIN_SPLIT' end as code, split, path from files join dup using (content_hash))"""
SQL["duplicate_severity"] = f"with {FILES}, {_DUP_ISSUES} select * from di"


def _rows(spark, sf):
    """Files with the attributes that the row checks read."""
    f = files(spark, sf)
    return f.select(
        "doc_id",
        "split",
        "path",
        (F.col("height") > 60).alias("readable"),
        F.pmod("width", F.lit(3)).alias("width"),
        F.lit(1).cast("bigint").alias("height"),
        F.when(F.col("mode") == "EN", "RGB").otherwise(F.col("mode")).alias("mode"),
        F.when(F.col("doc_id") % 11 == 0, 4).otherwise(3).alias("channels"),
    )


def row_issues(spark, sf):
    checks = quality.image_checks(1, 1, 3, {"INVALID_COLOR_MODE": "warning"})
    return quality.issues_of(_rows(spark, sf), checks, ["doc_id", "split", "path"]).select("doc_id", "split", "severity", "code", "message")


_ROWS = f"""{FILES}, r as (select doc_id, split, path, height > 60 as readable, width % 3 as width, case when mode = 'EN' then 'RGB' else mode end as mode, case when doc_id % 11 = 0 then 4 else 3 end as channels from files),
ri as (select doc_id, split, path, 'error' as severity, 'UNREADABLE_IMAGE' as code, 'the image cannot be decoded' as message from r where not readable
 union all select doc_id, split, path, 'error', 'INVALID_IMAGE_DIMENSIONS', concat('expected 1x1, found ', width, 'x1') from r where readable and width <> 1
 union all select doc_id, split, path, 'warning', 'INVALID_COLOR_MODE', 'unexpected mode ' || mode from r where readable and mode <> 'RGB'
 union all select doc_id, split, path, 'error', 'INVALID_CHANNEL_COUNT', concat('expected 3, found ', channels) from r where readable and channels <> 3)"""
SQL["row_issues"] = f"with {_ROWS} select doc_id, split, severity, code, message from ri"


def ignored_issues(spark, sf):
    """A check of severity ignore leaves no issue."""
    ignore = {c: "ignore" for c in ("INVALID_COLOR_MODE", "INVALID_IMAGE_DIMENSIONS")}
    out = quality.issues_of(_rows(spark, sf), quality.image_checks(1, 1, 3, ignore), ["doc_id"])
    return out.groupBy("code").agg(F.count("*").alias("n"))


SQL["ignored_issues"] = f"with {_ROWS} select code, count(*) as n from ri where code in ('UNREADABLE_IMAGE', 'INVALID_CHANNEL_COUNT') group by code"


def _issues(spark, sf):
    rows = quality.issues_of(_rows(spark, sf), quality.image_checks(1, 1, 3, {"INVALID_COLOR_MODE": "warning"}), ["split", "path"])
    return rows.select("severity", "code", "split", "path").unionByName(duplicate_severity(spark, sf))


_ALL = f"{_ROWS}, {_DUP_ISSUES}, ai as (select severity, code, split, path from ri union all select severity, code, split, path from di)"


def issue_counts(spark, sf):
    return quality.issue_summary(_issues(spark, sf))


SQL["issue_counts"] = f"with {_ALL} select 'split' as scope, split as name, count(*) as n from ai group by split union all select 'severity', severity, count(*) from ai group by severity union all select 'code', code, count(*) from ai group by code"


def split_issue_stats(spark, sf):
    i = _issues(spark, sf)
    return i.groupBy("split").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_distinct("path").alias("paths"),
    )


SQL["split_issue_stats"] = f"with {_ALL} select split, count_if(severity = 'error') as errors, count_if(severity = 'warning') as warnings, count(distinct path) as paths from ai group by split"


def issue_codes(spark, sf):
    """Each file with its distinct codes, sorted."""
    return quality.with_codes(files(spark, sf).select("doc_id", "path"), _issues(spark, sf)).select("doc_id", "codes")


SQL["issue_codes"] = f"with {_ALL}, c as (select path, string_agg(distinct code, '|' order by code) as codes from ai group by path) select doc_id, coalesce(codes, '') as codes from files left join c using (path)"


def expected_count_mismatch(spark, sf):
    expected = spark.createDataFrame([("train", 1), ("validation", None), ("test", 7), ("extra", 3)], "split string, expected bigint")
    return quality.count_mismatch(files(spark, sf), expected)


SQL["expected_count_mismatch"] = f"""with {FILES}, e(split, expected) as (values ('train', 1::bigint), ('validation', null), ('test', 7), ('extra', 3)), f as (select split, count(*) as found from files group by split)
select split, expected, coalesce(found, 0) as found from e left join f using (split) where expected is not null and expected <> coalesce(found, 0)"""


def empty_split(spark, sf):
    splits = spark.createDataFrame([(s,) for s in (*SPLITS, "holdout")], "split string")
    return quality.empty_splits(files(spark, sf), splits)


SQL["empty_split"] = f"with {FILES}, s(split) as (values ('train'), ('validation'), ('test'), ('holdout')) select split from s where split not in (select split from files)"


def fingerprint_consistency(spark, sf):
    f = table(spark, sf, "orders").select(split_of(F.col("o_orderkey")).alias("split"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("fingerprint"))
    return quality.fingerprints(f, ["split"], "fingerprint")


SQL["fingerprint_consistency"] = f"""with f as (select {split_sql('o_orderkey')} as split, case when o_orderkey % 3 = 0 then '' else o_orderstatus end as fp from orders)
select split, count(distinct nullif(fp, '')) as fingerprints, count(*) as n, count(distinct nullif(fp, '')) = 1 as consistent from f group by split"""


def content_sha256(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hashing.content_sha256(F.col("text").cast("binary")).alias("digest"))


SQL["content_sha256"] = "select doc_id, sha256(text) as digest from documents"


def pixel_digest(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", hashing.pixel_sha256(F.lit("RGB"), F.col("n_chars"), F.col("doc_id"), F.col("text").cast("binary")).alias("digest"))


SQL["pixel_digest"] = "select doc_id, sha256(concat('RGB', n_chars, 'x', doc_id, text)) as digest from documents"


def image_key(spark, sf):
    return files(spark, sf).select("doc_id", hashing.image_key(F.concat("path", F.lit(" é.x"))).alias("image_key"))


SQL["image_key"] = rf"""with {FILES}, p as (select doc_id, path || ' é.x' as p from files)
select doc_id, regexp_replace(regexp_replace(regexp_extract(p, '[^/]*$'), '\.[^.]*$', ''), '[^\p{{L}}\p{{N}}_-]', '_', 'g') || '__' || substr(sha256(p), 1, 16) as image_key from p"""


def stable_seed(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", hashing.stable_seed_column(F.lit(42), F.col("n_name")).alias("seed"))


def file_attributes(spark, sf):
    """Name, stem, extension and order key of each path; unsupported extensions apart."""
    f = files(spark, sf)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return f.select("doc_id", F.regexp_replace("filename", r"(?<=.)\.[^.]*$", "").alias("image_id"), ext.alias("extension"), F.lower("path").alias("order_key"), ext.isin(".txt").alias("supported"))


SQL["file_attributes"] = rf"with {FILES} select doc_id, regexp_replace(filename, '\.[^.]*$', '') as image_id, lower(regexp_extract(path, '(\.[^./]+)$', 1)) as extension, lower(path) as order_key, true as supported from files"


def metadata_json(spark, sf):
    """JSON built and read back."""
    e = table(spark, sf, "events")
    out = e.select("event_id", F.to_json(F.struct("event_type", "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))).alias("metadata_json"))
    return out.select("event_id", lb.metadata_field("event_type").alias("event_type"), lb.metadata_field("user_id").cast("bigint").alias("user_id"), lb.metadata_field("k").cast("int").alias("k"))


SQL["metadata_json"] = "select event_id, event_type, user_id, cast(json_extract_string(props, '$.k') as integer) as k from events"


def metadata_mismatch(spark, sf):
    """Labels whose recorded split or fingerprint is not the expected one, null-safe."""
    e = table(spark, sf, "events").withColumn("expected", F.when(F.col("event_id") % 4 == 0, "k").otherwise(F.get_json_object("props", "$.k")))
    found = F.get_json_object("props", "$.k")
    return e.where(~found.eqNullSafe(F.col("expected"))).groupBy("event_type").agg(F.count("*").alias("mismatches"))


SQL["metadata_mismatch"] = "select event_type, count(*) as mismatches from events where event_id % 4 = 0 group by event_type"


def unknown_features(spark, sf):
    """Set differences between grouped and known features, as rows."""
    grouped = F.array(*[F.lit(m) for g in FUSION.groups for m in (*g.members, "blur")])
    known = F.array(*[F.lit(f.name) for f in FEATURES])
    enabled = F.array(*[F.lit(f.name) for f in FEATURES if f.enabled])
    out = spark.range(1).select(
        F.array_except(grouped, known).alias("unknown"), F.array_except(enabled, grouped).alias("missing"), F.array_except(F.array_intersect(grouped, known), enabled).alias("disabled")
    )
    return out.select(*[F.array_join(c, ",").alias(c) for c in out.columns])


_GROUPED = ", ".join(f"('{m}')" for g in FUSION.groups for m in (*g.members, "blur"))
_KNOWN = ", ".join(f"('{f.name}', {str(f.enabled).lower()})" for f in FEATURES)
SQL["unknown_features"] = f"""with g as (select distinct m from (values {_GROUPED}) t(m)), k as (select * from (values {_KNOWN}) t(f, on_))
select coalesce((select string_agg(m, ',') from g where m not in (select f from k)), '') as unknown,
 coalesce((select string_agg(f, ',') from k where on_ and f not in (select m from g)), '') as missing,
 coalesce((select string_agg(m, ',') from g join k on f = m where not on_), '') as disabled"""


def incremental_reuse(spark, sf):
    """Sources whose label has the fingerprint in force are reused."""
    docs = table(spark, sf, "documents").select("doc_id")
    have = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("fingerprint"))
    return lb.reuse(docs, have, "doc_id", "fingerprint", "1")


SQL["incremental_reuse"] = "select doc_id, case when doc_id in (select doc_id from labels where quality = 1) then 'reused' else 'generated' end as status from documents"


def cache_misses(spark, sf):
    """Sources that the cache lacks as they are now: other size, time or fingerprint."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("relative_path"), F.col("n_chars").alias("file_size_bytes"), F.lit(0).cast("bigint").alias("modified_time_ns"))
    cache = docs.withColumns({"fingerprint": F.when(F.pmod(F.col("relative_path").cast("bigint"), F.lit(5)) == 0, "old").otherwise("new"), "file_size_bytes": F.when(F.col("file_size_bytes") > 3000, 0).otherwise(F.col("file_size_bytes"))})
    return lb.stale(docs, cache, "new").select("relative_path", "file_size_bytes")


SQL["cache_misses"] = "select cast(doc_id as varchar) as relative_path, n_chars as file_size_bytes from documents where doc_id % 5 = 0 or n_chars > 3000"


def column_union(spark, sf):
    """Rows of tables with different columns."""
    a = table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("region"))
    b = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("nation"))
    return lb.stacked([a, b])


SQL["column_union"] = "select r_regionkey as k, r_name as region, null as nation from region union all select n_nationkey, null, n_name from nation"


def label_integrity(spark, sf):
    """Label rows written with the fixed schema and checked: one row for each issue."""
    labels = _label_rows(spark, sf)
    broken = labels.withColumns(
        {
            "feature_names": F.when(_key() % 5 == 0, F.array(F.lit("x"))).otherwise(F.col("feature_names")),
            "label_file_version": F.when(_key() % 7 == 0, F.lit(2)).otherwise(F.col("label_file_version")),
            "score_map": F.when(_key() % 11 == 0, F.lit(None)).otherwise(F.col("score_map")),
            "normalized_feature_maps": F.when(_key() % 13 == 0, F.transform("normalized_feature_maps", lambda m: F.transform(m, lambda r: F.transform(r, lambda x: (x + 1.5).cast("float"))))).otherwise(F.col("normalized_feature_maps")),
        }
    )
    required = ["score_map", "raw_feature_maps", "normalized_feature_maps", "group_score_maps", "window_coordinates"]
    checks = quality.array_checks(required, ["v"], ["a"], 8, 8)
    return quality.issues_of(broken, checks, ["split", "image_key"]).select("split", "image_key", "severity", "code")


def _key():
    return F.col("image_key").cast("bigint")


def _label_rows(spark, sf):
    scores = cells(spark, sf).select(
        "split",
        F.col("vec_id").cast("string").alias("image_key"),
        F.col("vec_id").cast("string").alias("source_relative_path"),
        "row",
        "col",
        F.col("col").alias("x"),
        F.col("row").alias("y"),
        F.lit(1).alias("width"),
        F.lit(1).alias("height"),
        "v",
        F.col("score").alias("norm_v"),
        "group_a",
        F.col("score").alias("combined_score"),
    )
    return lb.label_rows(scores, ["v"], ["a"], {"fingerprint": "f"})


SQL["label_integrity"] = f"""with k as (select vec_id, {split_sql('vec_id')} as split from embeddings), i as (
select split, vec_id, 'MISSING_REQUIRED_ARRAYS' as code from k where vec_id % 11 = 0
union all select split, vec_id, 'INVALID_LABEL_VERSION' from k where vec_id % 11 <> 0 and vec_id % 7 = 0
union all select split, vec_id, 'FEATURE_NAME_MISMATCH' from k where vec_id % 11 <> 0 and vec_id % 7 <> 0 and vec_id % 5 = 0
union all select split, vec_id, 'VALUE_ABOVE_ONE' from k where vec_id % 11 <> 0 and vec_id % 7 <> 0 and vec_id % 5 <> 0 and vec_id % 13 = 0)
select split, cast(vec_id as varchar) as image_key, 'error' as severity, code from i"""


def label_round_trip(spark, sf):
    """Statistics of the nested score maps, read back from the label rows."""
    flat = _label_rows(spark, sf).select("split", "image_key", F.explode(F.flatten("score_map")).alias("s"))
    x = F.col("s").cast("double")
    return rounded(flat.groupBy("split", "image_key").agg(F.count("*").alias("n"), F.min(x).alias("minimum"), F.max(x).alias("maximum"), F.avg(x).alias("mean")))


SQL["label_round_trip"] = f"""with e as (select vec_id, {split_sql('vec_id')} as split, unnest(embedding) as f from embeddings), s as (select vec_id, split, cast(cast(greatest(0.0::double, least(1.0::double, cast(f as double) * 2 + 0.5)) as float) as double) as x from e)
select split, cast(vec_id as varchar) as image_key, count(*) as n, round(min(x), 6) as minimum, round(max(x), 6) as maximum, round(avg(x), 6) as mean from s group by all"""


def label_manifest(spark, sf):
    """The manifest: one row for each image with its statistics and status."""
    stats = label_round_trip(spark, sf)
    have = table(spark, sf, "embeddings").where("label < 3").select(F.col("vec_id").cast("string").alias("image_key"), F.lit("f").alias("fingerprint"))
    return lb.reuse(stats, have, "image_key", "fingerprint", "f").select("split", "image_key", "status", "n", "mean")


SQL["label_manifest"] = SQL["label_round_trip"].replace("select split, cast(vec_id", "select split, cast(s.vec_id").replace(
    "count(*) as n, round(min(x), 6) as minimum, round(max(x), 6) as maximum, round(avg(x), 6) as mean from s group by all",
    "case when max(m.label) < 3 then 'reused' else 'generated' end as status, count(*) as n, round(avg(x), 6) as mean from s join embeddings m on m.vec_id = s.vec_id group by split, s.vec_id",
)


def running_offset(spark, sf):
    """Rows before each image in the order of keys, from counts only."""
    n = table(spark, sf, "lineitem").groupBy(F.expr("l_orderkey div 1000").alias("block")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)))


SQL["running_offset"] = "with n as (select l_orderkey // 1000 as block, count(*) as n from lineitem group by 1) select block, n, cast(coalesce(sum(n) over (order by block rows between unbounded preceding and 1 preceding), 0) as bigint) as offset from n".replace(" as offset from", ' as "offset" from')
