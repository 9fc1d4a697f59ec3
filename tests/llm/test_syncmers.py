import hashlib
import re

from pyspark.sql import functions as F

from quadrille.llm import syncmers as sm
from tests.llm.data import odd_documents


def hashes(spark, values):
    """Spark's 64-bit hash of tuples of longs or strings."""
    out = {}
    for n in {len(v) for v in values}:
        some = [v for v in values if len(v) == n]
        kind = "string" if isinstance(some[0][0], str) else "bigint"
        df = spark.createDataFrame(some, ", ".join(f"c{k} {kind}" for k in range(n)))
        out.update({tuple(r)[:n]: r.h for r in df.withColumn("h", F.xxhash64(*df.columns)).collect()})
    return out


def slow_anchors(spark, texts):
    """For each text the (hash, place) of its closed syncmers, by plain loops."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    h = hashes(spark, list({(w,) for ws in words for w in ws}))
    codes = [[h[(w,)] for w in ws] for ws in words]
    pairs = hashes(spark, list({(a, b) for c in codes for a, b in zip(c, c[1:], strict=False)}))
    runs = hashes(spark, list({tuple(c[i : i + 5]) for c in codes for i in range(len(c) - 4)}))
    out = []
    for c in codes:
        found = []
        for i in range(len(c) - 4):
            inner = [pairs[c[j], c[j + 1]] for j in range(i, i + 4)]
            if min(inner) in (inner[0], inner[-1]):
                found.append((runs[tuple(c[i : i + 5])], i))
        out.append(found)
    return out


def test_anchors_and_fingerprint_against_loops(spark, sf):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    texts += ["a b c d e", "a b c d", "", "x " * 300, "p q r s t u v " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = sorted(df.select("i", sm.anchors(F.col("text")).alias("a"), sm.fingerprint(sm.cells(F.col("text"))).alias("f")).collect())
    for r, want, text in zip(got, slow_anchors(spark, texts), texts, strict=True):
        if len(text.split()) < 5:
            assert len(r.a) == 1 and len(r.f) == 8
            continue
        assert [(a.hash, a.place) for a in r.a] == want
        cells = [(h % 2**64) >> 32 for h, _ in want]
        assert r.f == "-".join(f"{c:08x}" for c in cells)


def test_anchors_are_free_of_context(spark):
    passage = " ".join(f"w{i * i}" for i in range(60))
    df = spark.createDataFrame([(0, passage), (1, f"before it {passage} and after")], "i int, text string")
    a, b = ({(x.hash, x.place) for x in r.a} for r in df.orderBy("i").select(sm.anchors(F.col("text")).alias("a")).collect())
    assert {(h, p + 2) for h, p in a} <= b


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda d: -d.doc_id)
    got = {r.doc_id: r for r in sm.op9_syncmers(spark, sf).collect()}
    assert len(got) == len(docs)
    by_text = {}
    for k, d in enumerate(docs):
        following, r = docs[(k + 1) % len(docs)], got[d.doc_id]
        half = len(d.text) // 2
        edited = d.text[: len(d.text) - half] + following.text[:half]
        assert r.n_chars == len(d.text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(d.text, r.fingerprint) == r.fingerprint
        a, b, c = (set(x.split("-")) for x in (r.fingerprint, r.edited_fingerprint, got[following.doc_id].fingerprint))
        near = lambda x, y: len(x & y) / len(x | y)
        assert (r.near_edited, r.near_next) == (near(a, b), near(a, c))
        assert (d.text == following.text) <= (r.near_next == 1)
    long = [r for r in got.values() if r.n_chars > 600]
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)


def test_odd_rows_and_many_ranges(spark, monkeypatch):
    df = odd_documents(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = [(r.doc_id, r.text, r.next_text) for r in sm.with_next(df, "doc_id", ["text"]).collect()]
    assert len(out) == df.count() and sorted(t for _, t, _ in out) == sorted(t for _, _, t in out)
    ends = {i: t for i, _, t in out}
    assert ends[7].startswith("word word") and ends[1].startswith("token:") and ends[None] == " \n\t "
    assert sm.with_next(df.limit(0), "doc_id", ["text"]).collect() == []
    monkeypatch.setattr(sm, "RANGE_ROWS", 3)
    ids = [5 * k * k for k in range(500)]
    many = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id bigint, text string")
    got = {r.doc_id: int(r.next_text) for r in sm.with_next(many, "doc_id", ["text"]).collect()}
    down = sorted(ids, reverse=True)
    assert got == dict(zip(down, down[1:] + down[:1], strict=True))


def test_texts_without_syncmers_have_fingerprints_of_their_own(spark):
    texts = [f"alpha{k} beta{k} gamma{k} delta{k} epsilon{k}" for k in range(60)]
    bare = [t for t, found in zip(texts, slow_anchors(spark, texts), strict=True) if not found]
    assert len(bare) > 1
    df = spark.createDataFrame([(a, b) for a in bare for b in bare], "a string, b string")
    fa, fb = sm.cells(F.col("a")), sm.cells(F.col("b"))
    for r in df.select("a", "b", sm.fingerprint(fa).alias("fa"), sm.likeness(fa, fb).alias("near")).collect():
        assert len(r.fa) == 8 and r.near == (r.a == r.b)


def test_late_edits_of_very_long_texts_show(spark):
    words = [f"w{i * i}" for i in range(20_000)]
    texts = [" ".join(words), " ".join([*words[:-6], "edited", *words[-5:]])]
    df = spark.createDataFrame([tuple(texts)], "a string, b string").select(sm.cells(F.col("a")).alias("a"), sm.cells(F.col("b")).alias("b"))
    r = df.select("a", "b", sm.likeness(F.col("a"), F.col("b")).alias("near")).first()
    assert len(r.a) > 5_000 and r.a != r.b and 0.999 < r.near < 1
