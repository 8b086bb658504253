"""Language identification by unigrams of pieces, with all segmentations summed.

The pieces of a fixed public vocabulary have a probability in each language. A word may be cut into pieces in many ways;
its probability is the sum over all of them, which the forward algorithm finds: alpha(i) = sum of alpha(j) * p(piece from
j to i). Words are runs of letters, lower-cased, with the vocabulary's mark of a word's start before them; runs of over
`LONGEST` letters go through the same sum one at a time, with few places kept. A text's log-probability is the sum over its words, and each distinct
word is scored once for all its uses. Letters are the characters of Unicode's letter categories alone: digits, fractions,
Roman numerals and other number signs are none.

Piece probabilities are learned from training rows: texts of which the language is known. At most about `max_docs` rows
of each language, drawn by a seeded hash of doc_id, are used; the words are cut by the vocabulary's own rule and the pieces counted, with the counts of all languages together as prior.
Nothing but the text enters a prediction.

A text is accepted if its language is plain (the best language holds at least the share `least`) and is one of those
learned (`fit`, the log-probability of a character under the best language, is at least `least_fit`).

Rows: a null text, or one without letters, is `und` with score 0 and is not accepted. Where no training row exists all rows are `und`. Rows
with null doc_id are no training rows and count as not held out. Ties go to the first language by code point. Extra
columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from pagelens.llm.common import _groups, free_names, slices

#: Letters of words that are worked on together; longer ones are worked on alone.
LONGEST, MARK = 100, "▁"
#: Probability of a character outside the vocabulary, in every language; and a factor for each character, which keeps products within doubles.
UNKNOWN, PER_CHAR = 1e-4, 20.0
#: Weight of the prior in counts, and the least share of a piece in it.
PRIOR, FLOOR = 200.0, 1e-7
#: Word characters that are neither letters nor decimal digits, such as fractions and Roman numerals.
_NUMBERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
WORDS, LETTERS = re.compile(r"[^\W\d_]+"), re.compile(rf"[^\W\d_{_NUMBERS}]+")


class Pieces:
    """The vocabulary of a sentencepiece model as a trie. Piece 0 is the unknown character."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.number = {"": 0}
        for i in range(self.sp.get_piece_size()):
            p = self.sp.id_to_piece(i)
            if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i)):
                self.number.setdefault(p, len(self.number))
        self.trie: dict = {}
        for p, i in self.number.items():
            if p:
                at = self.trie
                for ch in p:
                    at = at.setdefault(ch, {})
                at[""] = i

    def count(self, words: Counter) -> Counter:
        """Pieces of the words as the vocabulary's own rule cuts them."""
        out: Counter = Counter()
        for w, cut in zip(words, self.sp.encode(list(words), out_type=str, num_threads=1)):
            for p in cut:
                if i := self.number.get(p, 0):
                    out[i] += words[w]
        return out

    def edges(self, word: str) -> list[tuple[int, int, int]]:
        """All (start, end, piece) of a word; a character that is no piece itself is unknown."""
        s = MARK + word
        out = []
        for i in range(len(s)):
            at = self.trie
            single = False
            for j in range(i, len(s)):
                at = at.get(s[j])
                if at is None:
                    break
                if "" in at:
                    out.append((i, j + 1, at[""]))
                    single = single or j == i
            if not single:
                out.append((i, i + 1, 0))
        return out

    def forward(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """log P(word) in each language, summed over all segmentations: words x languages. probs: pieces x languages, scaled by PER_CHAR to the power of a piece's length."""
        if long := [k for k, w in enumerate(words) if len(w) > LONGEST]:
            out = np.zeros((len(words), probs.shape[1]))
            short = [k for k, w in enumerate(words) if len(w) <= LONGEST]
            if short:
                out[short] = self.forward([words[k] for k in short], probs)
            for k in long:
                out[k] = self._forward_long(words[k], probs)
            return out
        sizes = np.array([len(w) + 1 for w in words])
        wide = int(sizes.max()) + 1
        es = [self.edges(w) for w in words]
        which = np.repeat(np.arange(len(words)), [len(e) for e in es])
        start, end, piece = np.array([x for e in es for x in e], np.int64).T
        order = np.argsort(end, kind="stable")  # by end, then by word
        which, start, end, piece = which[order], start[order], end[order], piece[order]
        alpha = np.zeros((len(words), wide, probs.shape[1]))
        alpha[:, 0] = 1
        cuts = np.searchsorted(end, np.arange(1, wide + 1))
        for e in range(1, wide):
            a, b = cuts[e - 1], cuts[e]
            if a == b:
                continue
            w = which[a:b]
            first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            alpha[w[first], e] = np.add.reduceat(alpha[w, start[a:b]] * probs[piece[a:b]], first, axis=0)
        return np.log(np.maximum(alpha[np.arange(len(words)), sizes], 1e-300)) - sizes[:, None] * np.log(PER_CHAR)


    def _forward_long(self, word: str, probs: np.ndarray) -> np.ndarray:
        """forward() of one word of any length: only as many places are kept as a piece reaches over, and they are brought near 1
        whenever they have become small."""
        s, reach = MARK + word, max(map(len, self.number))
        alpha = np.zeros((len(s) + 1 if len(s) <= reach else reach + 1, probs.shape[1]))  # a ring of places
        n = len(alpha)
        alpha[0] = 1
        log = np.zeros(probs.shape[1])
        for i in range(len(s)):
            here = alpha[i % n].copy()
            alpha[i % n] = 0  # the place is free for i + n
            if i % 16 == 0:
                top = np.maximum(here, alpha.max(0))
                top = np.where(top > 0, top, 1)
                log += np.log(top)
                here /= top
                alpha /= top
            at, single = self.trie, False
            for j in range(i, min(i + reach, len(s))):
                at = at.get(s[j])
                if at is None:
                    break
                if "" in at:
                    alpha[(j + 1) % n] += here * probs[at[""]]
                    single = single or j == i
            if not single:
                alpha[(i + 1) % n] += here * probs[0]
        return np.log(np.maximum(alpha[len(s) % n], 1e-300)) + log - len(s) * np.log(PER_CHAR)


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def words_of(text: str) -> list[str]:
    return _letters(WORDS.findall(text.lower()))


def _letters(words: list[str]) -> list[str]:
    """The words without number signs; they are seldom, and the pattern of letters alone is slow."""
    return words if all(map(str.isalpha, words)) else [x for w in words for x in ([w] if w.isalpha() else LETTERS.findall(w))]


def probabilities(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Piece probabilities from counts (pieces x languages), smoothed towards all languages, with PER_CHAR for each character."""
    every = counts.sum(1)
    prior = np.maximum(every / max(every.sum(), 1), FLOOR)
    p = (counts + PRIOR * (prior / prior.sum())[:, None]) / (counts.sum(0) + PRIOR)
    p[0] = UNKNOWN
    return p * PER_CHAR ** lengths[:, None]


def learn(rows: DataFrame, vocabulary: str, max_docs: int, seed: int = 11) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities from training rows `(doc_id, text, lang)`."""
    rows = rows.filter("lang is not null and text is not null")
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    langs = sorted(per)
    if not langs:
        return [], np.zeros((0, 0))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, max_docs / per[k]))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(vocabulary)
        seen: dict[str, Counter] = {}
        for b in slices(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in seen.items():
            c = v.count(words)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(c), pa.string()), "piece": pa.array(list(c), pa.int32()), "n": pa.array(list(c.values()), pa.int64())})

    drawn = rows.filter(draw < share[F.col("lang")]).select("text", "lang")
    found = drawn.mapInArrow(count, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
    v = pieces(vocabulary)
    counts = np.zeros((len(v.number), len(langs)))
    for r in found:
        counts[r.piece, langs.index(r.lang)] = r.n
    return langs, probabilities(counts, np.array([max(1, len(p)) for p in v.number]))


def with_language(docs: DataFrame, train: DataFrame, vocabulary: str, max_docs: int = 2000, names: Sequence[str] = ("lang_pred", "score", "fit")) -> DataFrame:
    """`docs` with three more columns, called `names`: the language, the share of the best language in the likelihood of an
    average word, and the log-probability of an average character under that language."""
    langs, probs = learn(train, vocabulary, max_docs)
    model = docs.sparkSession.sparkContext.broadcast((langs, probs))
    text_at = docs.columns.index("text")

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, probs = model.value
        v = pieces(vocabulary)
        known: dict[str, int] = {}
        table, chars = np.zeros((0, len(langs))), np.zeros(0)
        for b in slices(batches):
            preds, scores, fits = [], [], []
            texts = ["" if t is None else t for t in b.column(text_at).to_pylist()]
            for group in _groups(texts, 1_000_000):
                words = [WORDS.findall(t.lower()) if langs else [] for t in group]
                if len(known) > 300_000:
                    known, table, chars = {}, table[:0], chars[:0]
                new = list(set().union(*words) - known.keys())
                if not all(map(str.isalpha, new)):  # what is known is letters
                    words = [_letters(ws) for ws in words]
                    new = list(set().union(*words) - known.keys())
                if new:
                    known.update((w, len(table) + k) for k, w in enumerate(new))
                    chars = np.concatenate([chars, [len(w) + 1 for w in new]])
                    table = np.concatenate([table, *(v.forward(new[k : k + 2000], probs) for k in range(0, len(new), 2000))])
                for ws in words:
                    if not ws:
                        preds.append("und")
                        scores.append(0.0)
                        fits.append(None)
                        continue
                    at = np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))
                    mean = table[at].mean(0)
                    k = int(mean.argmax())
                    preds.append(langs[k])
                    scores.append(float(1 / np.exp(mean - mean[k]).sum()))
                    fits.append(float(mean[k] * len(ws) / chars[at].sum()))
            found = [pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *found], [*b.schema.names, *names])

    return docs.mapInArrow(predict, StructType([*docs.schema.fields, *(StructField(n, t) for n, t in zip(names, (StringType(), DoubleType(), DoubleType())))]))


def identify(docs: DataFrame, train: DataFrame, vocabulary: str, max_docs: int = 2000) -> DataFrame:
    """`doc_id, lang_pred, score, fit` for each row of `docs(doc_id, text)`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_language(rows, train, vocabulary, max_docs).drop("text")


def accepted_documents(docs: DataFrame, vocabulary: str, least: float = 0.5, least_fit: float = -4.0, max_docs: int = 2000) -> DataFrame:
    """The accepted rows of `docs`, with all its columns."""
    pred, score, fit = names = free_names(docs, "lang_pred", "score", "fit")
    found = with_language(docs, training_rows(docs), vocabulary, max_docs, names)
    return found.filter((F.col(pred) != "und") & (F.col(score) >= least) & (F.col(fit) >= least_fit)).select(*docs.columns)


def held_out(doc_id):
    """Whether a doc_id is kept from training: crc32 of its digits mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
