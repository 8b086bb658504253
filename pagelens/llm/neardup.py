"""Near duplicates by b-bit MinHash.

A document's set holds its distinct shingles of `words` words (A-Z lower-cased; a shorter text is one shingle). Its
signature keeps the smallest values of `hashes` hash functions over the set. Bands of `rows` minima give candidate
buckets; of each minimum only the lowest `bits` are kept and packed. Two packed signatures agree in some positions; of
those a share 2^-bits agrees by chance, and the estimate (agreed - chance) / (1 - chance) is corrected for that. Candidates
whose estimate is far below the threshold (`SLACK` standard deviations) go; all others are confirmed on the full sets.

With 128 hashes in 32 bands of 4, a pair at similarity 0.75 shares no bucket with probability 5e-6.

Equal sets are one class, however many rows share it, and everything after works on classes. A bucket does not give all
its pairs. First its members are compared with its smallest and its largest member only. Where that leaves a bucket in
several components, members outside its largest component are compared with all others of the bucket, in blocks, so that
no link between different components is lost. Pairs inside a component need no comparison: they cannot change it.

Rows: null and empty texts, and texts of white space, have empty sets and are linked with nothing. Rows that share a
doc_id are rows of their own. Null doc_ids are linked like others; a component of null doc_ids alone has a null id.
Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import free_names, n_partitions, slices, written
from pagelens.llm.components import components

HASHES, BAND_ROWS, BITS, SLACK = 128, 4, 4, 7.5
#: Members of a family in a block of the second comparison.
BLOCK = 500
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingles as sorted 64-bit hashes. Each distinct word is hashed once and remembered."""

    def __init__(self, words: int, limit: int = 400_000):
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest
        self.words, self.limit = words, limit
        self.weights = _mixed(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
        self.known: dict[bytes, int] = {}
        self.hashes = np.zeros(1 << 16, np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.limit:
            known.clear()
        n = len(known)
        at = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        if len(known) > n:
            if len(known) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros(max(len(self.hashes), len(known)), np.uint64)])
            new = at[at >= n]
            k, first = np.unique(new, return_index=True)
            where = np.flatnonzero(at >= n)[first]
            self.hashes[k] = [self.hash(words[i]) for i in where]
        h = self.hashes[at]
        if len(h) < self.words:
            out = np.uint64(len(h))
            for x in h:
                out = _mixed(np.array([out ^ x]))[0]
            return np.array([out])
        s = np.zeros(len(h) - self.words + 1, np.uint64)
        for i in range(self.words):
            s += h[i : len(h) - self.words + 1 + i] * self.weights[i]
        return np.unique(_mixed(s))


class Signer:
    """Minima of `hashes` functions over a set, in bands, and their packed low bits."""

    def __init__(self, hashes: int = HASHES, rows: int = BAND_ROWS, bits: int = BITS, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 32, hashes, np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 1 << 32, hashes, np.uint64).astype(np.uint32)[:, None]
        self.bands, self.rows, self.bits = hashes // rows, rows, bits
        self.weights = rng.integers(0, 1 << 63, rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = rng.integers(0, 1 << 63, self.bands, np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)[None, :]
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for k in range(0, x.shape[1], 512):
            y = self.a * x[:, k : k + 512] + self.b
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            np.minimum(out, y.min(1), out=out)
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band; bands never share keys by intent."""
        v = minima.astype(np.uint64).reshape(self.bands, self.rows)
        return _mixed((v * self.weights).sum(1, dtype=np.uint64) ^ self.salts).view(np.int64)

    def pack(self, minima: np.ndarray) -> bytes:
        """Bit i of every minimum side by side, plane after plane."""
        return b"".join(np.packbits((minima >> np.uint32(i)) & np.uint32(1) == 1).tobytes() for i in range(self.bits))


def agreed(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """How many minima agree in all kept bits, from rows of packed signatures (uint8)."""
    x = a ^ b
    n = x.shape[-1] // bits
    planes = x.reshape(*x.shape[:-1], bits, n)
    return 8 * n - np.bitwise_count(np.bitwise_or.reduce(planes, axis=-2)).sum(-1, dtype=np.int64)


def estimate(agree: np.ndarray, hashes: int = HASHES, bits: int = BITS) -> np.ndarray:
    """Similarity from agreements, corrected for those by chance."""
    chance = 2.0**-bits
    return (agree / hashes - chance) / (1 - chance)


def least_agreed(threshold: float, hashes: int = HASHES, bits: int = BITS) -> int:
    """Agreements below which a pair at the threshold falls with the probability of SLACK standard deviations only."""
    p = threshold + (1 - threshold) * 2.0**-bits
    return int(np.floor(hashes * p - SLACK * np.sqrt(hashes * p * (1 - p))))


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """`doc_id, text_hash, set_key, n_shingles, sig, keys`: set_key stands for the set itself, and is null for empty sets."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingle, signer = Shingler(words), Signer()
        for part in slices(batches):
            cols: list[list] = [[], [], [], []]
            for text in part.column(2).to_pylist():
                s = shingle(text)
                m = signer.minima(s) if len(s) else None
                cols[0].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                cols[1].append(len(s))
                cols[2].append(signer.pack(m) if len(s) else None)
                cols[3].append(signer.keys(m) if len(s) else None)
            types = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", "text_hash", "set_key", "n_shingles", "sig", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(sign, "doc_id long, text_hash long, set_key binary, n_shingles long, sig binary, keys array<long>")


def _text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`c, text`: the whole text of one row of each class in `wanted(c, rep_id, rep_hash)`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), _text_hash().alias("_hash"), F.col("text").cast("string").alias("text"))
    return rows.join(wanted, F.col("_id").eqNullSafe(F.col("rep_id")) & (F.col("_hash") == F.col("rep_hash"))).groupBy("c").agg(F.first("text").alias("text"))


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of `pairs(a, b)` of classes whose full sets are similar."""
    left, right = (texts.select(F.col("c").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in slices(batches):
            last, sets, ok = None, np.zeros(0, np.uint64), []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if ta != last:
                    last, sets = ta, shingle(ta)
                ok.append(_linked(sets, shingle(tb), percent))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(check, "a long, b long")


def _likely(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Those of `pairs(a, b)` whose packed signatures agree often enough."""
    a, b = (classes.select(F.col("c").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sa, sb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
                ok = pa.array(agreed(sa, sb) >= least)
                yield pa.RecordBatch.from_arrays([c.filter(ok) for c in batch.columns[:2]], ["a", "b"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(keep, "a long, b long")


def _families(members: DataFrame) -> DataFrame:
    """`main, c, root, outside` from `members(key, n, c, root)` for buckets (of `n` members) that hold several components: a
    bucket belongs to the component with most members in it. Members of one bucket meet its row in parts of about BLOCK."""
    by_root = members.groupBy("key", "root").agg(F.count("*").alias("own"), F.max("n").alias("n"))
    main = by_root.groupBy("key").agg(F.max_by("root", F.struct("own", "root")).alias("main"), F.count("*").alias("roots"), F.max("n").alias("n")).filter("roots > 1")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    main = main.select("key", "main", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    rows = members.withColumn("part", F.pmod(F.xxhash64("c"), parts).cast("int")).join(main, ["key", "part"]).select("main", "c", "root").distinct()
    return rows.withColumn("outside", F.col("root") != F.col("main"))


def _rest(families: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links across components inside families: at most one for each outsider and component in a block.

    A block of outsiders meets each block of members; a member is sent to each block of outsiders.
    """
    sizes = families.groupBy("main").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count(F.when(F.col("outside"), 1)) / BLOCK).cast("int").alias("out_blocks"))
    rows = families.join(sizes, "main").withColumn("deal", F.xxhash64("c")).join(texts, "c")
    cols = ["main", "i", "j", "asks", "c", "root", "text", "to"]
    parts = n_partitions(families.sparkSession)
    # pairs of blocks of a family are numbered and dealt in turn, so that none of its tasks gets many more than another
    to = F.pmod(F.pmod(F.xxhash64("main"), F.lit(parts)) + F.col("i").cast("long") * F.col("blocks") + F.col("j"), F.lit(parts)).cast("int")
    asking = rows.filter("outside").withColumns({"i": F.pmod("deal", "out_blocks").cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "asks": F.lit(True)}).withColumn("to", to)
    asked = rows.withColumns({"j": F.pmod("deal", "blocks").cast("int"), "i": F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1)), "asks": F.lit(False)}).withColumn("to", to)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, so one pair of blocks is in memory at a time."""
        shingle = Shingler(words)
        block, rows = None, []
        for batch in batches:
            for main, i, j, asks, c, root, text in zip(*(x.to_pylist() for x in batch.columns[:7])):
                if (main, i, j) != block:
                    yield from links(rows)
                    block, rows = (main, i, j), []
                rows.append((asks, c, root, shingle(text)))
        yield from links(rows)

    def links(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        own = [r for r in rows if not r[0]]
        asking = [r for r in rows if r[0]]
        if not own or not asking:
            return
        sizes = np.array([len(r[3]) for r in own])
        values, owner = np.concatenate([r[3] for r in own]), np.repeat(np.arange(len(own)), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        c, root = np.array([r[1] for r in own]), np.array([r[2] for r in own])
        a, b = [], []
        for _, asker, its_root, its_set in asking:
            lo, hi = np.searchsorted(values, its_set, "left"), np.searchsorted(values, its_set, "right")
            n = hi - lo
            at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
            both = np.bincount(owner[at], minlength=len(own))
            hit = np.flatnonzero((100 * both >= percent * (sizes + len(its_set) - both)) & (root != its_root))
            first = hit[np.unique(root[hit], return_index=True)[1]]
            a += [asker] * len(first)
            b += c[first].tolist()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    both = asking.select(*cols).unionByName(asked.select(*cols))
    return both.repartitionById(parts, "to").sortWithinPartitions("main", "i", "j").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """`doc_id, text_hash, n_shingles, component_id, kept` for each row of `docs(doc_id, text)`."""
    signed = written(signatures(docs, words), "signatures")
    grouped = signed.filter("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("low_id"), F.min_by(F.struct("doc_id", "text_hash"), F.struct("doc_id", "text_hash")).alias("rep"), F.first("sig").alias("sig"), F.first("keys").alias("keys")
    )
    classes = written(grouped.select("set_key", "low_id", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"), "sig", "keys").withColumn("c", F.monotonically_increasing_id()), "classes")
    least = least_agreed(percent / 100)

    in_buckets = classes.select("c", F.explode("keys").alias("key"))
    shared = written(in_buckets.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).filter("n > 1"), "shared")
    members = written(in_buckets.join(shared, "key"), "buckets")
    stars = members.filter("c <> low").select(F.col("low").alias("a"), F.col("c").alias("b")).unionByName(members.filter("c <> high").select(F.col("c").alias("a"), F.col("high").alias("b")))
    first = written(_likely(stars.distinct(), classes, least), "pairs")
    crowded = members.filter("n > 3").select("key", "n", "c")  # in a bucket of three, smallest and largest member see all pairs
    ends = first.select(F.col("a").alias("c")).unionByName(first.select(F.col("b").alias("c"))).unionByName(crowded.select("c")).distinct()
    wanted = classes.join(ends, "c", "left_semi").select("c", "rep_id", "rep_hash")
    texts = written(_texts(docs, wanted), "texts")
    links = written(_confirm(first, texts, words, percent), "links")
    roots = written(components(links), "roots")

    rooted = written(crowded.join(roots, F.col("c") == F.col("node"), "left").select("key", "n", "c", F.coalesce("root", "c").alias("root")), "rooted")
    families = written(_families(rooted), "families")
    more = written(_rest(families, texts, words, percent), "links")
    if not more.isEmpty():
        roots = written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "roots")

    ids = classes.join(roots, F.col("c") == F.col("node"), "left").select("set_key", "low_id", F.coalesce("root", "c").alias("root"))
    lowest = ids.groupBy("root").agg(F.min("low_id").alias("component_id"))
    named = ids.join(lowest, "root").select("set_key", "component_id")
    linked = signed.filter("set_key is not null").join(named, "set_key")
    alone = signed.filter("set_key is null").withColumn("component_id", F.col("doc_id"))
    cols = ["doc_id", "text_hash", "n_shingles", "component_id"]
    out = linked.select(*cols).unionByName(alone.select(*cols))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that stay, with all its columns."""
    own_id, own_hash, keep_id, keep_hash = free_names(docs, "own_id", "own_hash", "keep_id", "keep_hash")
    keyed = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_hash: _text_hash()})
    staying = near_duplicates(docs, **options).filter("kept").select(F.col("doc_id").alias(keep_id), F.col("text_hash").alias(keep_hash)).distinct()
    return keyed.join(staying, F.col(own_id).eqNullSafe(F.col(keep_id)) & (F.col(own_hash) == F.col(keep_hash)), "left_semi").select(*docs.columns)
