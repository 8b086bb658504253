import math
import zlib

import numpy as np
import pytest
from llm.conftest import make
from pyspark.sql import functions as F

from pagelens.llm import crosspoly, langid, mixing, quality
from pagelens.llm.common import tokenizer_path

VOCABULARY = tokenizer_path("piece_bpe_32k.model")


# Language ID


def brute(v, word, p):
    s = langid.MARK + word

    def go(i):
        if i == len(s):
            return 1.0
        total, single = 0.0, False
        for j in range(i + 1, len(s) + 1):
            k = v.number.get(s[i:j])
            if k:
                total += p[k] * go(j)
                single = single or j == i + 1
        return total + (0 if single else p[0] * go(i + 1))

    return math.log(go(0))


def test_forward_sums_all_segmentations():
    v = langid.pieces(VOCABULARY)
    p = np.random.default_rng(0).random((len(v.number), 2)) * 1e-2
    scaled = p * langid.PER_CHAR ** np.array([max(1, len(x)) for x in v.number])[:, None]
    words = ["hello", "straße", "日鿃語", "a", "theread"]
    assert np.allclose(v.forward(words, scaled), [[brute(v, w, p[:, k]) for k in (0, 1)] for w in words])
    assert np.isfinite(v.forward(["x" * langid.LONGEST, "鿃" * langid.LONGEST], scaled)).all()


def test_words():
    assert langid.words_of("Don't 12 ÉTÉ_x 漢字!") == ["don", "t", "été", "x", "漢字"]
    assert list(map(len, langid.words_of("a" * 250))) == [250]


def test_long_words_are_summed_whole(monkeypatch):
    """A word's sum does not depend on which way it goes, and no length is too much."""
    v = langid.pieces(VOCABULARY)
    p = np.random.default_rng(1).random((len(v.number), 3)) * 1e-2
    scaled = p * langid.PER_CHAR ** np.array([max(1, len(x)) for x in v.number])[:, None]
    words = ["thereadingofthe" * 6, "hello", "鿃straße" * 9, "a", "interested" * 9]
    want = v.forward(words, scaled)
    monkeypatch.setattr(langid, "LONGEST", 2)
    assert np.allclose(v.forward(words, scaled), want)
    assert np.isfinite(v.forward(["x" * 20_000, "鿃" * 500], scaled)).all()


def test_more_languages_than_a_few_hundred(spark):
    rows = [(k, "some words " * 3, f"l{k}") for k in range(450)]
    langs, _ = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), VOCABULARY, 10)
    assert len(langs) == len(rows)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs, langid.training_rows(docs), VOCABULARY).join(docs.select("doc_id", "lang"), "doc_id").filter(langid.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 200 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, edge, empty):
    got = langid.identify(edge, langid.training_rows(edge), VOCABULARY).collect()
    assert len(got) == edge.count()
    for r in got:
        if r.doc_id in (1, 2, 3, 9):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "fr", "de") and 0 < r.score <= 1
    assert langid.identify(empty, empty, VOCABULARY).count() == 0
    assert {r.lang_pred for r in langid.identify(edge, empty, VOCABULARY).collect()} == {"und"}
    kept = langid.accepted_documents(edge, VOCABULARY)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 3, 9})


# Quality


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    learn = labels.filter(~quality.held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    rows = quality.score_quality(docs, learn).join(labels, "doc_id").filter(quality.held_out(F.col("doc_id"))).collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert sum(s >= 0.3 for s in good) / len(good) > 0.97 and sum(s < 0.3 for s in bad) / len(bad) > 0.8


def test_quality_sums_and_isotonic():
    rng = np.random.default_rng(1)
    z, y = np.hstack([rng.normal(size=(500, 6)), np.ones((500, 1))]), rng.random(500)
    w = quality.solve(quality._sums(z[:200], y[:200]) + quality._sums(z[200:], y[200:]), 0.5)
    reg = np.diag([0.5] * 6 + [1e-9])
    assert np.allclose(w, np.linalg.solve(z.T @ z + reg, z.T @ y))
    n, p = rng.integers(0, 5, 60).astype(float), None
    p = np.minimum(n, rng.integers(0, 5, 60))
    fit = quality.isotonic(n, p)
    assert (np.diff(fit) >= -1e-12).all() and abs((fit * n).sum() - p.sum()) < 1e-9
    assert set(quality.isotonic(np.zeros(4), np.zeros(4))) == {0.5}
    x = rng.normal(size=(40, 3))
    f = quality.Features(np.zeros(3), np.ones(3), 4000, 2.0, 0)(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 2.0**2))
    assert np.abs(f @ f.T - kernel).max() < 0.1


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(4, 1.0), (4, 0.0), (6, 1.0), (9, 0.0), (10, None), (None, 1.0)], "doc_id long, label double")
    got = quality.score_quality(edge, labels).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score_quality(edge, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(empty, labels).count() == 0
    assert all(np.isfinite(quality.statistics(t)).all() and len(quality.statistics(t)) == len(quality.STATISTICS) for t in ("", " ", "\n", "a", "ß\n\n漢"))


# Mixing


@pytest.mark.parametrize("seed", range(20))
def test_sainte_lague_against_single_seats(seed):
    rng = np.random.default_rng(seed)
    w = rng.integers(0, 50, 8).astype(float)
    most = rng.integers(0, 30, 8)
    seats = int(rng.integers(0, 120))
    got = [0] * 8
    for _ in range(seats):
        q = [(-w[i] / (2 * got[i] + 1), i) for i in range(8) if got[i] < most[i] and w[i] > 0]
        if not q:
            break
        got[min(q)[1]] += 1
    assert mixing.sainte_lague(w, seats, most) == got


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 1.5, 2) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([10, 1000], [3, 1], 1.5, 2) == [20.0, 1495.0] and mixing.targets([], [], 1.5, 2) == [] and mixing.targets([0, 0], [3, 1], 1.5, 2) == [0, 0]


def test_mix(spark, docs, edge, empty):
    for df in (docs, edge, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count() and sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))
        by = {}
        for r in rows:
            assert 0 <= r.taken <= 2 * r["size"]
            by.setdefault(r.source, []).append(r)
        order = sorted(by, key=lambda s: (s is None, s or ""))
        want = mixing.targets([sum(r["size"] for r in by[s]) for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2)
        block = max(1, min(256, int(min((t for t in want if t > 0), default=0) // 64)))
        for s, t in zip(order, want):
            assert all(r.target == pytest.approx(t) for r in by[s]) and abs(sum(r.taken for r in by[s]) - t) <= block / 2 + 1e-6 and {r.source_size for r in by[s]} == {sum(r["size"] for r in by[s])}
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed_documents(edge)
    assert mixed.columns == edge.columns and mixed.count() > 0


def test_blocks_go_to_the_sources_by_highest_quotients(spark):
    """Single blocks dealt one at a time to the highest quotient, as long as that reaches half a block; and rows that are all alike."""
    rng = np.random.default_rng(8)
    rows = [(k, "w " * int(rng.integers(50, 900)), "en", f"s{k % 5}") for k in range(300)] + [(9_999, "same words " * 40, "en", "s9")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(df).collect()
    size = {s: sum(len(t.split()) for _, t, _, x in rows if x == s) for s in ("s0", "s1", "s2", "s3", "s4", "s9")}
    targets = mixing.targets(list(size.values()), [3, 1, 2, 3, 1, 2], 1.5, 2)
    block = max(1, min(256, int(min(targets) // 64)))
    seats = [0] * 6
    while (best := max((t / (2 * n + 1), -i) for i, (t, n) in enumerate(zip(targets, seats)))) and best[0] >= block / 2:
        seats[-best[1]] += 1
    want = {s: min(n * block, 2 * size[s]) for s, n in zip(size, seats)}
    assert {s: sum(r.taken for r in got if r.source == s) for s in size} == want
    assert len({r.taken for r in got if r.source == "s9"}) <= 80 * 2 + 1 and max(r.taken for r in got if r.source == "s9") <= 160
    dealt = mixing.numbered_copies(spark.createDataFrame([(9, 1)] * 50 + [(8, 1), (None, 1), (None, 1)], "doc_id long, text_hash long")).collect()
    assert sorted(r.copy for r in dealt if r.doc_id == 9) == list(range(50)) and [r.copy for r in dealt if r.doc_id == 8] == [0] and sorted(r.copy for r in dealt if r.doc_id is None) == [0, 1]


# Nearest neighbours


def test_neighbours_of_very_large_and_small_numbers(spark):
    rows = [(0, [2.0**700, 2.0**700]), (1, [2.0**700, 2.0**701]), (2, [2.0**-700, 2.0**-699]), (3, [5e-324, 0.0]), (4, [1.0, 1.0]), (5, [-1.0, 0.5])]
    got = [(r.vec_id, r.score) for r in crosspoly.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=5).orderBy("rank").collect()]
    want = [(4, 1.0), (1, 3 / np.sqrt(10)), (2, 3 / np.sqrt(10)), (3, 1 / np.sqrt(2)), (5, -0.5 / np.sqrt(2.5))]
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], rtol=1e-15)


def exact(ids, x, query, k):
    s = (x * x[query]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[query] ** 2).sum()))
    order = [i for i in np.lexsort((ids, -s)) if i != query][:k]
    return [(int(ids[i]), float(s[i])) for i in order]


def test_neighbours_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in crosspoly.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append(r)
    hit = 0
    for q in np.flatnonzero(ids % 50 == 0):
        mine, true = sorted(got[ids[q]], key=lambda r: r.rank), dict(exact(ids, x, q, 5))
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hit += sum(r.vec_id in true and abs(true[r.vec_id] - r.score) < 1e-15 for r in mine)
    assert hit / (5 * len(got)) >= 0.9


def test_neighbours_edges(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same, 0) for i in range(0, 120)] + [(200, None, 0), (250, [], 0), (300, [0.0, 0.0, 0.0], 0), (350, [1.0, None, 2.0], 0), (400, [1.0, float("nan"), 2.0], 0), (450, [1.0, float("inf"), 2.0], 0), (500, [1.0, 2.0], 0), (None, same, 0), (50, same, 1), (550, [-1.0, 0.5, 0.1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in crosspoly.nearest(df, F.col("vec_id") % 50 == 0, tables=8, probes=8).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert sorted(got) == [0, 50, 100, 550] and [v for _, v in sorted(got[0])] == [1, 2, 3, 4, 5] and [v for _, v in sorted(got[100])] == [0, 1, 2, 3, 4]
    two = crosspoly.nearest(df.filter("vec_id in (0, 1)"), F.col("vec_id") == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in two] == [(0, 1, 1)] and two[0].score == pytest.approx(1)
    assert crosspoly.nearest(df.filter("vec_id = 200"), F.col("vec_id") == 0).count() == 0 and crosspoly.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert make is not None


def test_neighbours_are_complete(spark):
    """Few vectors, and a far query beside one cone of vectors: all k rows, or all others, and exact where cells are empty."""
    rng = np.random.default_rng(1)
    few = rng.normal(size=(6, 64))
    cone = np.vstack([-np.ones((1, 64)), 1 + 0.01 * rng.normal(size=(400, 64))])
    for x in (few, cone, few[:3]):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        asked = F.col("vec_id") % 200 == 0 if len(x) > 6 else F.lit(True)
        got = {}
        for r in crosspoly.nearest(df, asked).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        ids = np.arange(len(x))
        assert set(got) == ({0, 200, 400} if len(x) > 6 else set(range(len(x))))
        for q in got if len(x) <= 6 else [0]:
            true = exact(ids, x, q, 5)
            assert [i for i, _ in got[q]] == [i for i, _ in true] and [s for _, s in got[q]] == pytest.approx([s for _, s in true])
        assert all(len(v) == min(5, len(x) - 1) for v in got.values())
