import re

import pytest
from tokenizers import Tokenizer

from quadrille.llm import bpe, mixing, secrets, toxicity
from tests.llm.data import odd_documents
from tests.llm.test_nearcopies import slow_kept
from tests.llm.test_secrets import slow as slow_secrets

pipeline = pytest.importorskip("corpus_pipeline")


def plain_redact(text):
    spans = [s.rsplit(":", 2) for s in slow_secrets(text)]
    out, at = "", 0
    for kind, a, b in spans:
        if int(a) >= at:
            out += text[at : int(a)] + f"[{kind}]"
        at = max(at, int(b))
    return out + text[at:] if spans else text


def test_run_against_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    usual = model.thresholds[None]
    rows = {d.doc_id: d for d in docs.collect()}
    left = {i: d.text for i, d in rows.items() if scorer.score(d.text or "") < model.thresholds.get(d.lang, usual)}
    assert 0 < len(left) < len(rows)
    left = {i: left[i] for i in slow_kept(list(left.items()))}
    left = {i: plain_redact(t) for i, t in left.items()}
    lib = Tokenizer.from_file(bpe.tokenizer_path())
    got = pipeline.run(spark, sf).collect()
    taken = {}
    for r in got:
        ids = lib.encode(left[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert max(taken.values()) <= 2
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in left.items()}
    per, have = {}, {}
    for i in left:
        s = rows[i].source
        per[s] = per.get(s, 0) + size[i]
        have[s] = have.get(s, 0) + size[i] * taken.get(i, 0)
    want = mixing.targets(per, mixing.WEIGHTS, mixing.SHARE, mixing.MOST)
    largest = {s: max(size[i] for i in left if rows[i].source == s) for s in per}
    assert all(abs(have[s] - want[s]) <= largest[s] / 2 + 1 for s in per)
    assert sorted(map(tuple, got)) == sorted(map(tuple, pipeline.run(spark, sf).collect()))


def test_each_stage_takes_odd_rows(spark, sf):
    df = odd_documents(spark)
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, df, sf)
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == df.columns, name
        rows = out.collect()
        if name == "near_duplicates":
            # 1, 2 (twice) and 7 have no words; 3 and 4 are equal.
            assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 3, 5]
        if name == "secrets":
            assert len(rows) == df.count() and all(r.n_chars == len(r.text) for r in rows if r.text is not None)
        if name == "mix":
            assert {1, 2, 7} <= {r.doc_id for r in rows}
        assert stage(spark, df.limit(0), sf).collect() == [], name
    assert secrets.RULES
