"""Alignment of two tokenizers against a plain version on the libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagelens.llm import alignment
from pagelens.llm.common import byte_letters, tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    back = {c: b for b, c in byte_letters().items()}
    piece = lambda k: bytes([int(sp.id_to_piece(k)[3:-1], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode()
    found, held = [], Counter()
    for doc_id, text in rows:
        full = " " + (text or "")
        a = tok.encode(full, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        ab, bb = [bytes(back[c] for c in tok.id_to_token(k)) for k in a], [piece(k) for k in b]
        if not text or b"".join(ab) != full.encode() or b"".join(bb) != full.encode():
            found.append((doc_id, [], [], [], ""))
            continue
        ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
        ea, eb = ends(ab), ends(bb)
        pairs, i, j = [], 0, 0
        while i < len(ea) and j < len(eb):
            pairs.append((a[i], b[j]))
            i, j = i + (ea[i] <= eb[j]), j + (eb[j] <= ea[i])
        groups, i, j = [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            p, q = i, j
            while i < len(ea) and ea[i] <= end:
                i += 1
            while j < len(eb) and eb[j] <= end:
                j += 1
            groups.append((a[p:i], b[q:j]))
        held.update(set(pairs))
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found.append((doc_id, (len(a), len(b), len(groups)), pairs, groups, hashlib.sha256(text.encode()).hexdigest()))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return sorted(((i, *(n or (0, 0, 0)), len(p), sum(held[q] == top[q[0]] for q in p), sum(held[q] for q in p), sha) for i, n, p, _, sha in found), key=str)


def found(df, **options):
    return sorted(map(tuple, alignment.align(df, A, B, **options).collect()), key=str)


def test_documents(spark, docs):
    assert found(docs) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_small_blocks_give_the_same(spark, docs, monkeypatch):
    some = docs.filter("doc_id < 60")
    monkeypatch.setattr(alignment, "GROUP_CHARS", 3_000)
    assert found(some.repartition(3), block_chars=20_000) == plain([(r.doc_id, r.text) for r in some.collect()])


def test_edges(spark, edge, empty):
    assert found(edge) == plain([(r.doc_id, r.text) for r in edge.collect()])
    assert found(empty) == []


AWKWARD = ["", " ", "  ", "a ", " a", "a  b   ", "▁", "a▁b c", "<s> </s> <unk> <0x0A>", "<|endoftext|>", "a<|endoftext|> b", "x\ny\t\tz\r\n", "　 x", "éé", "퟿\U0010ffff", "a\x00b", "漢字 \U0001f600\U0001f600", "don't we'll", "1234567", "ال दे", "   ", "ﬁ ① ｆ", "​ ‍", "\x85\x1c", "a" * 300 + " " + "é" * 300]


def test_awkward_texts(spark):
    rng = random.Random(5)
    letters = "".join(AWKWARD)
    rows = [*enumerate(AWKWARD), (None, "null id"), (None, None), (3, "a "), (3, "a ")] + [(1_000 + k, "".join(rng.choices(letters, k=rng.randrange(30)))) for k in range(300)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, code string, block string")
    assert found(df) == plain(rows)


@pytest.mark.parametrize("seed", range(5))
def test_overlaps_are_those_of_brute_force(seed):
    rng = np.random.default_rng(seed)
    cut = lambda: np.unique(np.append(rng.choice(np.arange(1, 100), rng.integers(1, 60), replace=False), 100))
    a, b = cut(), cut()
    first, stop = alignment.overlaps(a, b)
    i, j = alignment.links(first, stop)
    start = lambda e, k: e[k - 1] if k else 0
    assert [*zip(i.tolist(), j.tolist())] == [(x, y) for x in range(len(a)) for y in range(len(b)) if start(a, x) < b[y] and start(b, y) < a[x]]
    assert a[alignment.closes(first, stop)].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
