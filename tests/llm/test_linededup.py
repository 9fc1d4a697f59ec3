import hashlib
import re

from quadrille.llm import linededup as ld
from tests.llm.data import odd_documents


def slow(rows, kinds=ld.KINDS):
    """{(id, text): maximal removed spans}; rows sorted by id."""
    seen, gone = {}, {r: set() for r in rows}
    for k, (by, least) in enumerate(kinds):
        for i, text in rows:
            ends = [m.end() for m in re.finditer(by, text)]
            for a, b in zip([0, *ends], [*ends, len(text)], strict=True):
                unit = " ".join(text[a:b].split())
                unit = "".join(c.lower() if "A" <= c <= "Z" else c for c in unit)
                if len(unit) >= least and seen.setdefault((k, unit), (i, text, a)) != (i, text, a):
                    gone[i, text].update(range(a, b))
    return {r: _spans(g) for r, g in gone.items()}


def _spans(places):
    edges = sorted(p for p in places if p - 1 not in places), sorted(p + 1 for p in places if p + 1 not in places)
    return list(zip(*edges, strict=True))


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = sorted((d.doc_id, d.text or "") for d in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want = {i: (t, s) for (i, t), s in slow(rows).items()}
    got = ld.op3_line_dedup(spark, sf).collect()
    assert len(got) == len(rows) and sum(r.n_removed for r in got) > 0
    for r in got:
        text, spans = want[r.doc_id]
        kept, at = "", 0
        for a, b in spans:
            kept, at = kept + text[at:a], b
        kept += text[at:]
        shown = ",".join(f"{a}:{b}" for a, b in spans)
        assert (r.n_chars, r.n_removed, r.chars_removed) == (len(text), len(spans), len(text) - len(kept))
        assert r.removed_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_hot_line_paragraphs_and_odd_rows(spark):
    line = "the same long line everywhere"
    df = spark.createDataFrame([(i, f"own line number {i} is here\n{line}\n\n{line}  ") for i in range(400)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in ld.kept_texts(ld.remove_repeats(df)).collect()}
    assert len(got[0].removed) == 1 and all(len(got[i].removed) == 2 for i in range(1, 400))
    assert got[7].kept == "own line number 7 is here\n\n"
    paragraphs = {r.doc_id: r.removed for r in ld.remove_repeats(df, kinds=((ld.PARAGRAPHS, 20),)).collect()}
    assert paragraphs[0] is None and len(paragraphs[9]) == 1
    odd = odd_documents(spark)
    out = ld.kept_texts(ld.remove_repeats(odd)).collect()
    assert len(out) == odd.count()
    by_id = {r.doc_id: r for r in out}
    assert by_id[1].kept == "" and by_id[4].kept == "" and by_id[3].kept.startswith("One")
    assert ld.kept_texts(ld.remove_repeats(odd.limit(0))).collect() == []


def test_a_passage_inside_a_line_is_found(spark):
    passage = " ".join(f"Sentence number {k} has words enough to be told from the others." for k in range(8))
    df = spark.createDataFrame([(i, f"host {i} begins and then {passage} ends {i} here.") for i in range(5)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in ld.kept_texts(ld.remove_repeats(df, kinds=ld.KINDS)).collect()}
    assert got[0].removed == [] and all(len(got[i].removed) == 1 and len(got[i].kept) < 150 for i in range(1, 5))
