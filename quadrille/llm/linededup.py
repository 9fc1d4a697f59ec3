"""Removal of repeated lines by the digests of normalised units.

A text is cut into units (lines, paragraphs, or the sentences of lines, which
catch a passage set into the middle of a line); units of several kinds may be
asked for at once, each kind with digests of its own. A unit's normal form has
its white space closed up, ASCII letters in lower case, and no edges. Digests of
the normal forms are grouped over all documents; the occurrence first in rank
(smallest document id, then position) stays, every later one goes, in the same
document too. Offsets are those of the original text.

Units go to the digest groups as (digest, document, position), are reduced to
the first occurrence on the map side, and come back through a join in which
hot digests are salted. Texts are shuffled once, to the spans of their own
document.

Defined cases: a null text is empty; units shorter than the least length of
their kind in normal form are never removed (blank lines, headings); rows that repeat a
document id are told apart by a hash of their text, and equal rows are the
same document, which keeps what the first of them keeps; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import cut, hot_keys, lookup, short_batches, stored, table, whole_text

#: What ends units: the patterns of lines, paragraphs and sentences.
LINES, PARAGRAPHS, SENTENCES = r"\n", r"\n\n", r"[.!?]\s+|\n"
#: Characters that a unit's normal form has at least, to be removed: of a line, and of a sentence.
LEAST, LEAST_SENTENCE = 20, 40


def units(text: str, by: str = LINES) -> Iterator[tuple[int, int]]:
    """(start, stop) of each unit, the separator after it included, in code points."""
    at = 0
    for m in re.finditer(by, text):
        yield at, m.end()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def normal(unit: str) -> str:
    return re.sub(r"[A-Z]+", lambda m: m[0].lower(), " ".join(unit.split()))


def unit_digests(docs: DataFrame, kinds: tuple[tuple[str, int], ...]) -> DataFrame:
    """(doc, tie, start, stop, digest) of the units long enough; digest has 128 bits."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            ids, ties, texts = (batch.column(k).to_pylist() for k in range(3))
            for d, t, text in zip(ids, ties, texts, strict=True):
                for k, (by, least) in enumerate(kinds):
                    for a, b in units(text, by):
                        unit = normal(text[a:b])
                        if len(unit) >= least:
                            digest = hashlib.md5(b"%d " % k + unit.encode("utf-8", "surrogatepass")).digest()
                            for c, v in zip(cols, (d, t, a, b, digest), strict=True):
                                c.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, types, strict=True)],
                names=["doc", "tie", "start", "stop", "digest"],
            )

    return docs.select("doc", "tie", "text").mapInArrow(
        run, "doc bigint, tie bigint, start bigint, stop bigint, digest binary"
    )


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kinds: tuple[tuple[str, int], ...] = ((LINES, LEAST),)
) -> DataFrame:
    """(``doc_id``, ``text``, ``removed``): whole texts and the units to leave out, by start.

    ``kinds``: pairs of what ends a unit and the least length of its normal
    form. Units of different kinds may overlap.
    """
    whole = whole_text(text)
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.xxhash64(whole).alias("tie"), whole.alias("text"))
    found = stored(unit_digests(docs, kinds))
    place = F.struct(F.col("doc").alias("doc"), F.col("tie").alias("tie"), F.col("start").alias("start"))
    groups = cut(
        found.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    )
    total = groups.agg(F.sum("n")).first()[0] or 0
    later = lookup(found, groups.drop("n"), "digest", hot_keys(groups, "digest", "n", total)).where(
        ~(F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("tie") == F.col("first.tie")) & (F.col("start") == F.col("first.start")))
    )
    spans = later.groupBy("doc", "tie").agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("removed")
    )
    spans = spans.select(F.col("doc").alias("_doc"), F.col("tie").alias("_tie"), "removed")
    return docs.join(spans, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_tie")), "left").select(
        F.col("doc").alias(doc_id), F.col("text").alias(text), "removed"
    )


def kept_texts(found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, ``text``, ``removed``, ``kept``) from the result of :func:`remove_repeats`.

    ``removed`` now has the maximal removed spans.
    """
    short_batches(found.sparkSession)
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                runs: list[dict] = []
                for s in spans or ():
                    if runs and s["start"] <= runs[-1]["stop"]:
                        runs[-1]["stop"] = max(runs[-1]["stop"], s["stop"])
                    else:
                        runs.append(dict(s))
                edges = [0, *(x for r in runs for x in (r["start"], r["stop"])), len(t)]
                kept.append("".join([t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]))
                removed.append(runs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, span), pa.array(kept, pa.string())],
                names=[doc_id, text, "removed", "kept"],
            )

    spans = T.ArrayType(T.StructType().add("start", "long").add("stop", "long"))
    shape = T.StructType().add(doc_id, "long").add(text, "string").add("removed", spans).add("kept", "string")
    return found.select(doc_id, text, "removed").mapInArrow(run, shape)


#: What the query removes: repeated lines, and repeated sentences of lines.
KINDS = ((LINES, LEAST), (SENTENCES, LEAST_SENTENCE))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines and sentences that an earlier place holds."""
    found = kept_texts(remove_repeats(table(spark, sf_dir, "documents"), kinds=KINDS))
    spans = F.col("removed")
    shown = F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string")))
    return found.select(
        "doc_id",
        F.char_length("text").cast("bigint").alias("n_chars"),
        F.size(spans).cast("bigint").alias("n_removed"),
        (F.char_length("text") - F.char_length("kept")).cast("bigint").alias("chars_removed"),
        F.sha2(F.array_join(shown, ","), 256).alias("removed_sha256"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP3_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
c as (select doc_id, 0 as kind, 20 as least, string_split(regexp_replace(text, '(\n)', '\1' || chr(1), 'g'), chr(1)) as a from d
      union all select doc_id, 1, 40, string_split(regexp_replace(text, '([.!?]\s+|\n)', '\1' || chr(1), 'g'), chr(1)) from d),
u as (select doc_id, kind, least, unnest(a) as unit, generate_subscripts(a, 1) as i from c),
p as (select *, cast(sum(length(unit)) over (partition by doc_id, kind order by i) as bigint) as stop,
             translate(trim(regexp_replace(unit, '\s+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from u where unit <> ''),
r as (select doc_id, stop - length(unit) as start, stop, length(norm) >= least and row_number() over (partition by kind, norm order by doc_id, i) > 1 as gone from p),
g as (select doc_id, start, stop, max(stop) over (partition by doc_id order by start, stop rows between unbounded preceding and 1 preceding) as before from (select distinct doc_id, start, stop from r where gone)),
h as (select *, sum(case when before is null or start > before then 1 else 0 end) over (partition by doc_id order by start, stop rows unbounded preceding) as run from g),
m as (select doc_id, run, min(start) as start, max(stop) as stop from h group by all),
k as (select *, coalesce(lag(stop) over (partition by doc_id order by start), 0) as since from m),
s as (select doc_id, count(*) as n, cast(sum(stop - start) as bigint) as chars, string_agg(start || ':' || stop, ',' order by start) as shown,
             string_agg(substr(text, cast(since as bigint) + 1, cast(start - since as bigint)), '' order by start) as head, max(stop) as last from k join d using (doc_id) group by doc_id)
select d.doc_id, length(text) as n_chars, coalesce(n, 0) as n_removed, coalesce(chars, 0) as chars_removed, sha256(coalesce(shown, '')) as removed_sha256,
       sha256(coalesce(head, '') || substr(text, cast(coalesce(last, 0) as bigint) + 1)) as kept_sha256
from d left join s using (doc_id)
"""
