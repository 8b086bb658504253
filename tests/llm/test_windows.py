"""Packing by least squares: whole ids, places without gaps, no padding."""

import zlib
from collections import defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pytest

from pagelens.llm import windows
from pagelens.llm.common import tokenizer_path

WORDS = tokenizer_path("word_bpe_49k.json")


def held_against_the_library(df, rows, capacity=4096):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    want = sorted((-1 if i is None else i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t in rows) if len({i for i, _ in rows}) == len(rows) else None
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in windows.pack(df, WORDS, 2, capacity).collect():
        docs[r.row].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.length > 0
    assert len(docs) == len(rows)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0
    got = []
    for parts in docs.values():
        parts.sort(key=lambda r: r.start)
        at = 0
        for r in parts:
            assert r.start == at
            at += r.length
        assert {(r.doc_id, r.doc_tokens) for r in parts} == {(parts[0].doc_id, at)}
        got.append((-1 if parts[0].doc_id is None else parts[0].doc_id, [(r.start, r.length, r.ids_crc32) for r in parts]))
    if want is not None:
        for (i, ids), (j, parts) in zip(want, sorted(got), strict=True):
            assert i == j and len(ids) == sum(n for _, n, _ in parts)
            assert all(zlib.crc32(ids[a : a + n].tobytes()) == crc for a, n, crc in parts)
    return sequences, docs


def test_documents(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sequences, pieces = held_against_the_library(docs, rows)
    tokens = sum(n for s in sequences.values() for _, n in s)
    assert len(sequences) <= tokens // 4096 + 12
    assert sum(len(p) for p in pieces.values()) <= len(rows) + tokens // 4096 + 12


def test_edges(spark, edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    held_against_the_library(edge, rows)
    assert windows.pack(empty, WORDS, 2).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_ids_of_pieces_across_an_end(spark, n):
    rows = [(k, "some plain words here, " * (k % 7 * 9)) for k in range(n)]
    held_against_the_library(spark.createDataFrame(rows, "doc_id long, text string"), rows, capacity=64)


def test_many_pieces_across_an_end_are_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(windows, "FEW", 0)
    rows = [(k, "some plain words here, " * (k % 7 * 9)) for k in range(40)]
    held_against_the_library(spark.createDataFrame(rows, "doc_id long, text string"), rows, capacity=64)


def test_combinations_are_all_shallow_ways_to_fill_a_window():
    lengths = [1, 2, 3, 5, 8, 12, 16, 20, 27, 31, 32]
    w, parts = windows.combinations(np.array(lengths), 32)
    got = sorted((int(a), tuple(sorted(x for x in p if x))) for a, p in zip(w, parts.tolist()))
    want = sorted((a, c) for a in (32, 16, 8, 4, 2, 1) for d in (1, 2, 3) for c in combinations_with_replacement(lengths, d) if sum(c) == a)
    assert got == want


def test_least_squares_meets_the_conditions_of_an_optimum():
    rng = np.random.default_rng(3)
    counts = np.zeros(65)
    counts[1:] = rng.integers(0, 50, 64)
    _, parts = windows.combinations(np.flatnonzero(counts), 64)
    x = windows.least_squares(parts, counts, rounds=20_000)
    a = np.zeros((65, len(parts)))
    for k, p in enumerate(parts.tolist()):
        for s in p:
            a[s, k] += s > 0
    weight = np.sqrt(np.arange(65) / 64)
    grad = (a * weight[:, None]).T @ (weight * (a @ x - counts))
    assert (x >= 0).all() and grad.min() > -1e-3 and abs(grad @ x) < 1e-2 * (weight * counts).sum()


def test_a_plan_uses_no_more_than_there_is():
    rng = np.random.default_rng(4)
    counts = np.bincount(np.clip(rng.lognormal(4, 1, 20_000).astype(int), 1, 512), minlength=513)
    plan, rest = windows.solve(counts, 512)
    used = np.zeros(513, np.int64)
    for window, lengths, times in plan:
        assert sum(lengths) == window and times > 0
        for s in lengths:
            used[s] += times
    assert (rest >= 0).all() and (used + rest == counts).all()
    assert rest @ np.arange(513) < 0.05 * (counts @ np.arange(513))


def test_the_last_tokens_lie_in_powers_of_two():
    for total in (0, 1, 63, 64, 65, 127, 200):
        last = windows.ends(total, 64)
        assert last[0] == total // 64 * 64 and last[-1] == total
        assert all(n & (n - 1) == 0 for n in np.diff(last).tolist())
