"""Stages and operators on odd tables: clashing names, nulls, repeats, nothing at all; and plain versions of op3, op4 and op10."""

import itertools
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from llm.conftest import EDGE, make
from llm.test_models import VOCABULARY, brute
from pyspark.sql import functions as F

from pagelens.llm import blocknames, crosspoly, langid, licences, mixing, neardup, quality
from pagelens.llm.common import free_names

#: Names that stages have used for columns of their own, now or before, in several cases.
INTERNAL = (
    "lang_pred score fit own_id own_digest own_hash keep_id keep_digest keep_hash keep_rows took_id took_hash copies copy _lang_pred _lang_score _keep_id _keep_hash _dup_id _near_id _mix_id "
    "_mix_hash _mix_copies _took_id SCORE_ Own_Id_ d q n want words part parts shard quota order digest levels name group_size kept component_id n_shingles set_key text_hash"
).split()


@pytest.fixture(scope="module")
def clashing(spark):
    names = list(dict.fromkeys(n.lower() for n in INTERNAL))
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(i, t, la, so, None, *(f"{n}-{i}" for n in names)) for i, t, la, so in EDGE + [(20, "Grüße an die ganze Welt von hier", "de", "b")] * 2]
    return spark.createDataFrame(rows, schema).cache()


def test_free_names(clashing):
    got = free_names(clashing, "score", "Fresh", "FRESH")
    assert got == ["score__", "Fresh", "FRESH_"]  # score and score_ are taken
    assert len({c.lower() for c in [*clashing.columns, *got]}) == len(clashing.columns) + 3


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_leave_columns_of_any_name_alone(spark, clashing, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, clashing, "")
    if name == "best_fit_packing":
        assert {r.doc_id for r in out.collect()} == {r.doc_id for r in clashing.collect()} and stage(spark, clashing.limit(0), "").count() == 0
        return
    assert out.columns == clashing.columns and out.schema == clashing.schema
    own = Counter(map(str, clashing.collect()))
    got = Counter(map(str, out.collect()))
    assert got and set(got) <= set(own) and all(n <= own[r] * (2 if name == "mix_sources" else 1) for r, n in got.items())
    nothing = stage(spark, clashing.limit(0), "")
    assert nothing.columns == clashing.columns and nothing.count() == 0


def test_stages_on_repeats(spark, clashing):
    texts = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    exact = texts(blocknames.kept_documents(clashing))
    assert exact[(20, "Grüße an die ganze Welt von hier")] == 1 and exact[(5, "hello world, this is a text.")] == 1 and (4, "Hello World, this is a text.") not in exact
    near = texts(neardup.kept_documents(clashing))
    assert near[(2, "")] == 1 and near[(20, "Grüße an die ganze Welt von hier")] == 2  # of rows that are alike in all all stay or go


@pytest.mark.parametrize("rows", [EDGE, []])
def test_run_on_odd_tables(spark, tmp_path, rows):
    make(spark, rows + rows).drop("row").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert bool(got) == bool(rows) and all(0 < r.length <= 2048 for r in got)
    assert {r.doc_id for r in got} <= {i for i, t, _, _ in EDGE if t and any(map(str.isalpha, t))}
    assert len({(r.row, r.piece) for r in got}) == len(got)


# Language ID


@pytest.mark.parametrize("text", ["½ ½", "² ³", "Ⅷ ①", "12 34", "___", "!?", "", "٣٤ ፩"])
def test_texts_without_letters(spark, text):
    train = spark.createDataFrame([(1, "the cat and the dog", "en"), (3, "der hund und die katze", "de")], "doc_id long, text string, lang string")
    r = langid.identify(spark.createDataFrame([(9, text)], "doc_id long, text string"), train, VOCABULARY).first()
    assert (r.lang_pred, r.score, r.fit) == ("und", 0.0, None) and langid.words_of(text) == []
    assert langid.words_of(f"x{text}Éy" if text.strip() else "x Éy")[0][0] == "x"


def test_language_by_brute_force(spark):
    train = [("en", "the cat sat on the mat and the dog"), ("en", "a cat and a hat"), ("de", "der hund und die katze"), ("de", "ein hut und das haus")]
    tests = ["the hund", "katze x² cat", "Das Haus", "mat"]
    df = spark.createDataFrame([(i, t, la) for i, (la, t) in enumerate(train)], "doc_id long, text string, lang string")
    got = {r.text: (r.lang_pred, r.score) for r in langid.with_language(spark.createDataFrame([(t,) for t in tests], "text string"), df, VOCABULARY, max_docs=10).selectExpr("text", "lang_pred", "score").collect()}
    v = langid.pieces(VOCABULARY)
    langs, counts = ["de", "en"], np.zeros((len(v.number), 2))
    for la, t in train:
        for w in t.split():
            for piece in v.sp.encode(w, out_type=str):
                counts[v.number[piece], langs.index(la)] += 1
    p = langid.probabilities(counts, np.zeros(len(v.number)))
    for t in tests:
        words = [w for w in re.findall(r"[a-zäöüß]+", t.lower())]
        mean = np.array([[brute(v, w, p[:, k]) for k in (0, 1)] for w in words]).mean(0)
        share = np.exp(mean - mean.max())
        assert got[t][0] == langs[int(mean.argmax())] and got[t][1] == pytest.approx(float(1 / share.sum()), rel=1e-6)


def test_accepted_documents_decide(spark):
    rows = [(i, t, la, "s") for i, (t, la) in enumerate([("the cat sat on the mat with the other cat", "en"), ("der hund und die katze sind im haus", "de")] * 8)]
    odd = [(100, "съешь же ещё этих мягких французских булок", None, "s"), (101, "漢字仮名交じり文", None, "s"), (102, "12 34", "en", "s"), (103, None, "en", "s")]
    kept = langid.accepted_documents(make(spark, rows + odd), VOCABULARY)
    assert {r.doc_id for r in kept.collect()} == set(range(16))


# Quality


def test_quality_by_brute_force(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    got = {r.doc_id: r.score for r in quality.score_quality(docs, labels, dim=24).collect()}
    rows = {r.doc_id: np.array(quality.statistics(r.text or "")) for r in docs.collect()}
    x = np.stack(list(rows.values()))
    feats = quality.Features(x.mean(0), x.std(0), 24, 4.0, 5)
    fold = {r.doc_id: r.f for r in labels.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(quality.FOLDS)).alias("f")).collect()}
    train = [(r.doc_id, r.label) for r in labels.collect() if r.doc_id in rows]
    reg = np.diag([0.3] * 24 + [1e-9])

    def ridge(chosen):
        z, y = feats(np.stack([rows[i] for i, _ in chosen])), np.array([la for _, la in chosen], float)
        return np.linalg.solve(z.T @ z + reg, z.T @ y)

    def cell(i, w):
        return float(np.clip((feats(rows[i][None])[0] @ w + 0.5) / 2 * quality.GRID, 0, quality.GRID - 1))

    weight, positive = np.zeros(quality.GRID), np.zeros(quality.GRID)
    for f in range(quality.FOLDS):
        w = ridge([t for t in train if fold[t[0]] != f])
        for i, la in train:
            if fold[i] == f:
                weight[int(cell(i, w))] += 1
                positive[int(cell(i, w))] += la
    curve, w = quality.isotonic(weight, positive), ridge(train)
    want = {i: float(np.interp(cell(i, w), np.arange(quality.GRID), curve)) for i in rows}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 0.02


# Mixing


def single_seats(words, want, block, repeats):
    """Whole blocks one by one to the highest quotient, then partial blocks from what has most left."""
    most = [repeats * w // block for w in words]
    got = [0] * len(words)
    for _ in range(min(want // block, sum(m for m, w in zip(most, words) if w))):
        q = [(-w / (2 * k + 1), i) for i, (w, k, m) in enumerate(zip(words, got, most)) if k < m]
        got[min(q)[1]] += 1
    got = [k * block for k in got]
    rest = want - sum(got)
    for i in sorted(range(len(words)), key=lambda i: -(repeats * words[i] - got[i])):
        more = min(rest, repeats * words[i] - got[i])
        got[i] += max(0, more)
        rest -= max(0, more)
    return got


@pytest.mark.parametrize(("shard_docs", "block"), [(128, 256), (3, 7)])
def test_mix_by_brute_force(docs, monkeypatch, shard_docs, block):
    monkeypatch.setattr(mixing, "SHARD_DOCS", shard_docs)
    got = {r.doc_id: r for r in mixing.mix(docs, block=block).collect()}
    text = F.coalesce("text", F.lit(""))
    order = F.xxhash64("doc_id", F.xxhash64(text), F.lit(0).cast("long"), F.lit(7))  # no row has an equal
    rows = docs.select("doc_id", "source", F.regexp_count(text, F.lit(r"\S+")).alias("size"), order.alias("order"), F.xxhash64(order, F.lit(8)).alias("deal")).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    sources = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    targets = mixing.targets([sum(r["size"] for r in by[s]) for s in sources], [(3, 1, 2)[i % 3] for i in range(len(sources))], 1.5, 2)
    block = max(1, min(block, int(min(t for t in targets if t > 0) // 64)))
    wants = [min(int(np.floor(t / block + 0.5)) * block, 2 * sum(r["size"] for r in by[s])) for s, t in zip(sources, targets)]
    for s, t, want in zip(sources, targets, wants):
        shards = -(-len(by[s]) // shard_docs)
        parts = int(np.ceil(np.sqrt(shards)))
        shard = defaultdict(list)
        for r in sorted(by[s], key=lambda r: r.order):
            shard[r.deal % shards].append(r)
        words = {k: sum(r["size"] for r in v) for k, v in shard.items()}
        in_part = {p: sorted(k for k in words if k % parts == p) for p in sorted({k % parts for k in words})}
        quota = dict(zip(in_part, single_seats([sum(words[k] for k in ks) for ks in in_part.values()], want, block, 2)))
        for p, ks in in_part.items():
            for k, q in zip(ks, single_seats([words[k] for k in ks], quota[p], block, 2)):
                at = 0
                for r in shard[k]:
                    taken = sum(max(0, min(at + r["size"], q - turn * words[k]) - at) for turn in (0, 1))
                    assert got[r.doc_id].taken == taken and got[r.doc_id].target == pytest.approx(t)
                    at += r["size"]


# Neighbours


def test_neighbours_of_several_lengths_and_of_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(crosspoly, "PART_ROWS", 20)
    monkeypatch.setattr(crosspoly, "PART_QUERIES", 10)
    rng = np.random.default_rng(4)
    short, long = rng.normal(size=(30, 4)), 1 + 0.1 * rng.normal(size=(300, 16))  # all of the long ones in one direction
    rows = [(i, v.tolist()) for i, v in enumerate(itertools.chain(short, long))]
    got = defaultdict(dict)
    for r in crosspoly.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True)).collect():
        got[r.query_id][r.vec_id] = r.score
    hit = total = 0
    for first, x in ((0, short), (30, long)):
        u = x / np.linalg.norm(x, axis=1)[:, None]
        s = u @ u.T - 2 * np.eye(len(x))
        for q in range(len(x)):
            best = set((first + np.argsort(-s[q])[:5]).tolist())
            assert len(got[first + q]) == 5 and all(first <= i < first + len(x) and abs(v - s[q][i - first]) < 1e-12 for i, v in got[first + q].items())
            hit, total = hit + len(best & set(got[first + q])), total + 5
    assert hit / total >= 0.9


# Licences


def test_licence_blocks_and_versions(spark):
    mit = (licences.TEXTS / "MIT.txt").read_text()
    body = "My library\n\nSome words.\n-----\n" + mit + "\n=====\nMore words."
    rows = [(1, body), (2, mit.replace("\n", " \n ")), (3, "conversion 2 of it"), (4, "----"), (5, "x\n***\nReleased under the MIT Licence.\n***\ny"), (6, "Licensed under the Apache License,\nVersion 2.0.")]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].text_license, got[1].n_license_blocks, got[1].block_licenses) == (None, 1, "MIT") and got[2].text_license == "MIT"
    assert got[3].text_license is None and got[4].n_license_blocks == 0 and (got[5].n_license_lines, got[5].n_license_blocks) == (1, 1) and got[6].text_license == "Apache-2.0"
