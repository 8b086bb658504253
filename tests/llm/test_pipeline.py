"""run() against a plain version of its stages, with language and near duplicates worked out by other means."""

from collections import Counter, defaultdict

import corpus_pipeline
from llm.test_duplicates import UP, shingles, wanted_near
from pyspark.sql import Row


def test_stages_against_plain_python(spark, docs, sf):
    rows = docs.collect()
    df = docs
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, sf).cache()
        out[name] = df.collect()
        if name != "best_fit_packing":
            assert df.columns == docs.columns
    assert {r.doc_id for r in out["language_id"]} == {r.doc_id for r in rows if any(c.isalpha() for c in r.text or "")}
    last = {}
    for r in sorted(out["language_id"], key=lambda r: r.doc_id):
        last[(r.text or "").translate(UP)] = r
    assert sorted(r.doc_id for r in out["exact_dedup"]) == sorted(r.doc_id for r in last.values())
    near = wanted_near([Row(doc_id=r.doc_id, text=r.text) for r in out["exact_dedup"]])
    assert sorted(r.doc_id for r in out["near_dedup"]) == sorted(k[0] for k in near if k[3])
    copies = Counter(r.doc_id for r in out["mix_sources"])
    words, source = defaultdict(int), {r.doc_id: r.source for r in out["near_dedup"]}
    assert set(copies) <= set(source) and max(copies.values()) <= 2
    for r in out["mix_sources"]:
        words[r.source] += len(r.text.split())
    assert sum(words.values()) > sum(len(r.text.split()) for r in out["near_dedup"])
    pieces = Counter(r.doc_id for r in out["best_fit_packing"] if r.piece == 0)
    assert pieces == copies
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "best_fit_packing"]
    assert shingles("a b c d e f")


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 2048
