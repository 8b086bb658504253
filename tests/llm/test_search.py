"""Ranked search against a plain version of its formula."""

import math
import random
import re
from collections import Counter

import pytest

from pagelens.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        rows = []
        for doc_id, c in held:
            if c:
                m = 10 + 90 * sum(c.values()) * n_docs // n_terms
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if c[t])
                rows += [(-score, doc_id is None, doc_id or 0)] if score > 0 else []
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "x", "x") for i, t in docs], "doc_id long, text string, rank string, term string")
    i = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, score string")
    index = search.build_index(d.repartition(3), block_bytes=options.pop("block_bytes", search.BLOCK_BYTES))
    return sorted(map(tuple, search.search(index, i, **options).collect()), key=str)


def test_terms_are_runs_of_letters_and_digits():
    text = "Über ÄÖ don't 3.14 x\x1cy a_b 漢字、漢 \x00z\x7f{q} ÀB"
    assert [t.decode() for t in search.terms(text)] == plain_terms(text)


@pytest.mark.parametrize("seed", range(3))
def test_small_blocks_and_leaves_give_the_plain_result(spark, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(rng.choices(words, [1 / (k + 1) for k in range(40)], k=n))
    docs = [(rng.randrange(300), text(rng.randrange(0, 60))) for _ in range(250)] + [(k, "w0 w1 w2 w3") for k in range(500, 560)] + [(-5, "w0 w39"), (None, "w39 w38"), (1 << 62, "w39 w38")]
    items = [(k, text(12)) for k in range(12)] + [(77, "w0 w1"), (78, "unknown words"), (79, "W39, w38!")]
    want = plain(docs, items)
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, block_bytes=4_000, leaf=8) == want
    assert found(spark, docs, items, block_bytes=4_000, leaf=0, chunk_bytes=60) == want


def test_nulls_repeats_and_empty_tables(spark):
    docs = [(1, None), (2, ""), (3, " .,!"), (4, "alpha beta"), (4, "alpha beta"), (None, "alpha beta"), (None, "alpha"), (5, "gamma " * 20_000)]
    items = [(None, "alpha"), (7, "alpha"), (7, "gamma beta"), (8, None), (9, ""), (None, None)]
    assert found(spark, docs, items) == plain(docs, items)
    assert found(spark, docs, []) == []
    assert found(spark, [(1, None), (2, " ")], items) == []
    none = spark.createDataFrame([], "doc_id long, text string")
    assert search.search(search.build_index(none), spark.createDataFrame(items, "item_id long, text string")).collect() == []


def test_a_treap_keeps_both_orders():
    import numpy as np

    rng = np.random.default_rng(1)
    t = search.Treap(np.sort(rng.choice(10_000, 500, replace=False)), rng.integers(0, 30, 500))

    def walk(lo, hi, above):
        if lo < hi:
            k, doc, impact = t.root(lo, hi)
            assert impact <= above and doc == t.docs[k] and t.impact[lo:hi].max() == impact
            return 1 + walk(lo, k, impact) + walk(k + 1, hi, impact)
        return 0

    assert walk(0, 500, 1 << 60) == 500


def test_a_traversal_leaves_out_what_cannot_enter(monkeypatch):
    import numpy as np

    n = 20_000
    treap = search.Treap(np.arange(n), np.where(np.arange(n) % 2_000 == 7, 1_000, 1 + np.arange(n) % 5))
    best = search.Best(10)
    search.traverse([treap], list(range(n)), best, leaf=16)
    assert best.rows == [(-1_000, k) for k in range(7, n, 2_000)]
    assert len(treap.made) < 200
