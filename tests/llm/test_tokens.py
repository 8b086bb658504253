import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagelens.llm import packing, records, tokencount
from pagelens.llm.common import WordEncoder, tokenizer_path

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aAbé ÉßΣİ\n\t\x1c '.,1<|>endoftx漢̈-"), max_size=40))
def test_words_encode_as_the_library_does(text):
    enc = _enc()
    assert list(next(iter(enc.encode([text])))) == enc.tok.encode(text, add_special_tokens=False).ids


_kept = []


def _enc():
    if not _kept:
        _kept.append(WordEncoder(WORD, limit=50))
    return _kept[0]


def wanted_records(word, rows):
    order = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode()))
    out, start = [], 0
    for r in order:
        ids = [*word.encode(r.text or "", add_special_tokens=False).ids, 2]
        out.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_records_round_trip(spark, docs, edge, word):
    for df in (docs, edge):
        got = [tuple(r) for r in records.token_records(df, WORD, 2).collect()]
        assert sorted(got, key=str) == sorted(wanted_records(word, df.collect()), key=str)


def test_records_shuffled_reads_and_damage(spark, docs, tmp_path, word):
    out = f"file://{tmp_path}"
    shards = records.write_records(docs, out, WORD, 2)
    assert sum(n for _, n, _ in shards) == docs.count()
    shard, n, _ = shards[0]
    straight = list(records.scan_shard(out, shard))
    order = list(range(n))[::-3]
    for k, (i, ids) in zip(order, records.read_shuffled(out, shard, order)):
        assert i == straight[k][0] and (ids == straight[k][1]).all()
    f = tmp_path / f"shard-{shard:05d}.rec"
    data = bytearray(f.read_bytes())
    data[30] ^= 1
    f.write_bytes(data)
    with pytest.raises(ValueError):
        list(records.scan_shard(out, shard))


def test_records_of_nothing(empty):
    assert records.token_records(empty, WORD, 2).count() == 0


def test_counts_are_the_librarys(docs, edge, empty):
    tok = Tokenizer.from_file(BYTE)
    for df, block in ((docs, 10_000), (edge, 10**9), (edge, 1)):
        got = sorted(map(str, (tuple(r) for r in tokencount.count_tokens(df, BYTE, block).collect())))
        want = sorted(str((r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False)))) for r in df.collect())
        assert got == want
    assert tokencount.count_tokens(empty, BYTE).count() == 0


def test_count_needs_a_byte_level_tokenizer():
    with pytest.raises(ValueError):
        tokencount.PreTokens(WORD)


def test_packed_arrays():
    arrays = [np.array([1, 2]), np.array([], int), np.array([70_000]), np.array([1 << 40])]
    assert all((a == b).all() for a, b in zip(tokencount.unpack_arrays(tokencount.pack_arrays(*arrays)), arrays))


def best_possible(items, capacity):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {*bins}:
            if room + items[i] <= capacity:
                k = bins.index(room)
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_dominance_keeps_an_optimal_packing():
    rng = random.Random(3)
    fixed_items = 0
    for _ in range(400):
        capacity = rng.choice([10, 20, 50])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        fixed, rest = packing.reduce_counts(Counter(items), capacity)
        left = list(Counter(rest).elements())
        fixed_items += len(items) - len(left)
        assert sum(n for _, n in fixed) + best_possible(left, capacity) == best_possible(items, capacity)
        patterns = packing.plan(Counter(items), capacity)
        assert Counter(x for p, n in patterns for x in p * n) == Counter(items) and all(sum(p) <= capacity for p, _ in patterns)
    assert fixed_items > 1000


def check_packing(rows, want, capacity):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter(want)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(docs, edge, word, capacity):
    for df in (docs, edge):
        want, total = [], 0
        for r in df.collect():
            ids = [*word.encode(r.text or "", add_special_tokens=False).ids, 0]
            want += [(r.doc_id, k, a, len(ids[a : a + capacity]), crc(ids[a : a + capacity])) for k, a in enumerate(range(0, len(ids), capacity))]
            total += len(ids)
        n = check_packing(packing.pack(df, WORD, 0, capacity).collect(), want, capacity)
        assert n <= 1.05 * total / capacity + 2


def test_packing_with_ids_and_of_nothing(edge, empty):
    rows = packing.pack(edge, WORD, 0, 64, with_ids=True).collect()
    assert all(crc(r.ids) == r.ids_crc32 and len(r.ids) == r.length for r in rows)
    assert packing.pack(empty, WORD, 0).count() == 0
