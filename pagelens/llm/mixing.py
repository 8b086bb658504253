"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source is laid out as a row of words: its documents go to shards by a seeded hash and stand there in seeded
order. A shard is cut into blocks of `block` words each. Sainte-Laguë's rule (the highest quotients words / (2 k + 1))
gives whole numbers of blocks to parts, which hold about as many shards as a source has parts, and then to the shards of
each part. So no apportionment handles more rows than the square root of a source's shards. A shard takes its quota of
blocks from the front of its seeded order; a quota of more blocks than the shard has goes round once more.

Between sources the same rule deals the blocks of the mix, with targets for shares: blocks go to the highest quotients target /
(2 k + 1) as long as these reach half a block, which gives a source target / block blocks, rounded, whatever the number of
sources is. Blocks are small enough that the smallest target has 64 of them. A source that has too few words for its blocks
ends with a part of one.

Rows: null and empty texts have size 0 and are never taken. A null source is a source of its own, last in the order of
weights. Rows that share a doc_id are rows of their own. Extra columns are ignored. Empty tables give no rows. Of the
mixed documents, one of which less than half of its words is taken goes: copies are whole, and their number is rounded.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.common import WORD, free_names, written
from pagelens.operators.ordered import rank, running_total
from pagelens.operators.politeness import numbered

#: Documents that a shard holds on average; sources up to which their table is broadcast (some 100 bytes each).
SHARD_DOCS, FEW_SOURCES = 128, 10_000


def sainte_lague(shares: Sequence[float], seats: int, most: Sequence[int] | None = None) -> list[int]:
    """Whole numbers that sum to `seats` by highest quotients share / (2 k + 1); none above `most`. Ties go to the first.

    The quotients below the final divisor are found at once: with divisor d a share has floor(share / d + 1 / 2) seats.
    Only the last few seats (at most one for each share) are dealt singly.
    """
    w = np.asarray(shares, float)
    cap = np.full(len(w), np.iinfo(np.int64).max, np.int64) if most is None else np.asarray(most, np.int64)
    cap = np.where(w > 0, cap, 0)
    seats = int(min(seats, sum(map(int, cap))))
    got = np.zeros(len(w), np.int64)
    if seats <= 0:
        return got.tolist()
    lo, hi = 0.0, 4 * w.max() + 1  # many seats at lo, none at hi
    for _ in range(200):
        d = (lo + hi) / 2
        if d <= 0 or d in (lo, hi):
            break
        k = np.minimum(np.floor(np.minimum(w / d + 0.5, 2.0**62)).astype(np.int64), cap)
        if int(k.sum()) <= seats:
            hi, got = d, k
        else:
            lo = d
    heap = [(-w[i] / (2 * int(got[i]) + 1), i) for i in range(len(w)) if got[i] < cap[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < cap[i]:
            heapq.heappush(heap, (-w[i] / (2 * int(got[i]) + 1), i))
    return got.tolist()


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, repeats: float) -> list[float]:
    """Shares `share` times all sizes by weight; a target stops at `repeats` times its size and the excess is shared anew."""
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > repeats * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, repeats: int) -> DataFrame:
    """`sources(source, n, source_size)` with the `target` of each, as targets() has them, for any number of sources.

    In the order of size / weight the sources that stop at `repeats` times their size come first. A source stops if what
    those before it leave would give it more; the others share what is left by weight.
    """
    placed = rank(sources.withColumn("last", F.col("source").isNull()), ["last", "source"], "place")
    weighed = placed.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")))
    most = F.lit(repeats) * F.col("source_size")
    filled = weighed.withColumn("full", most / F.col("weight"))
    filled = running_total(filled, ["full", "place"], most, "full_before")
    filled = written(running_total(filled, ["full", "place"], F.col("weight"), "weight_before"), "sources")
    every = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weight = float(every[0] or 0) * share, float(every[1] or 0)
    filled = filled.withColumn("level", (F.lit(total) - F.col("full_before")) / (F.lit(weight) - F.col("weight_before")))
    stops = F.col("full") <= F.col("level")
    level = filled.filter(~stops).agg(F.max("level")).first()[0] or 0.0
    return filled.select("source", "n", "source_size", F.when(stops, most.cast("double")).otherwise(F.col("weight") * level).alias("target"))


def numbered_copies(sized: DataFrame) -> DataFrame:
    """Adds `copy`: 0 for a row that is alone with its doc_id and text, else its number among its equals, so that these do not stay
    together. Equals may change numbers freely; the rows of all together are the same."""
    repeated = written(sized.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "repeated")
    if repeated.isEmpty():
        return sized.withColumn("copy", F.lit(0).cast("long"))
    same = lambda a, b: a.doc_id.eqNullSafe(b.doc_id) & (a.text_hash == b.text_hash)
    alone = sized.join(repeated, same(sized, repeated), "left_anti").withColumn("copy", F.lit(0).cast("long"))
    own = sized.join(repeated, same(sized, repeated), "left_semi").withColumns({"key": F.xxhash64("doc_id", "text_hash"), "row": F.monotonically_increasing_id()})
    return alone.unionByName(numbered(own, "key", ["row"], "copy").drop("key", "row"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 7, block: int = 256) -> DataFrame:
    """`doc_id, text_hash, source, size, source_size, target, taken` for each row of `docs(doc_id, text, source)`.

    `taken` counts the words that the mix takes of the document, those taken twice twice. `text_hash` (xxhash64 of the
    text) tells rows apart that share a doc_id.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.xxhash64(text).alias("text_hash"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        ),
        "sizes",
    )
    per_source = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    shards = F.ceil(F.col("n") / SHARD_DOCS).cast("long")
    sources = written(source_targets(per_source, weights, share, repeats).withColumns({"shards": shards, "parts": F.ceil(F.sqrt(shards)).cast("long")}), "targets")

    least = sources.filter("target > 0").agg(F.min("target")).first()[0]
    block = max(1, min(block, int((least or 0) // 64)))
    sources = sources.withColumn("want", F.least(F.floor(F.col("target") / block + 0.5).cast("long") * block, repeats * F.col("source_size")))
    sized = numbered_copies(sized)
    order = F.xxhash64("doc_id", "text_hash", "copy", F.lit(seed))
    few = sources.count() <= FEW_SOURCES
    dealt = sized.withColumn("order", order).join(F.broadcast(sources) if few else sources, sized.source.eqNullSafe(sources.source)).drop(sources.source)
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("order", F.lit(seed + 1)), "shards")).withColumn("part", F.col("shard") % F.col("parts"))

    def apportion(words: np.ndarray, want: int) -> np.ndarray:
        """`want` words from shards (or parts) of so many: whole blocks by the rule, then partial ones from those that have most left."""
        most = repeats * words
        got = np.array(sainte_lague(words, want // block, most // block), np.int64) * block
        rest = want - int(got.sum())
        for i in np.argsort(-(most - got), kind="stable"):
            more = int(min(rest, most[i] - got[i]))
            if more <= 0:
                break
            got[i] += more
            rest -= more
        return got

    def quotas(by: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(by)
            return pdf.assign(quota=apportion(pdf.words.to_numpy(np.int64), int(pdf.want.iloc[0])))[["source", by, "words", "quota"]]

        return run

    per_shard = dealt.groupBy("source", "part", "shard").agg(F.sum("size").alias("words"), F.first("want").alias("want"))
    per_shard = written(per_shard, "shards")
    per_part = per_shard.groupBy("source", "part").agg(F.sum("words").alias("words"), F.first("want").alias("want"))
    of_parts = per_part.groupBy("source").applyInPandas(quotas("part"), "source string, part long, words long, quota long")
    of_parts = of_parts.select(F.col("source").alias("p_source"), F.col("part").alias("p_part"), F.col("quota").alias("want"))
    of_shards = per_shard.drop("want").join(of_parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part"))).select("source", "part", "shard", "words", "want")
    of_shards = of_shards.groupBy("source", "part").applyInPandas(quotas("shard"), "source string, shard long, words long, quota long")

    seeded = Window.partitionBy("source", "shard").orderBy("order", "doc_id", "text_hash", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = dealt.withColumn("to", F.sum("size").over(seeded)).withColumn("from", F.col("to") - F.col("size")).alias("d")
    q = of_shards.alias("q")
    joined = at.join(q, F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard")))
    taken = F.lit(0).cast("long")
    for k in range(repeats):
        edge = F.col("quota") - k * F.col("words")
        taken = taken + F.greatest(F.lit(0), F.least(F.col("to"), edge) - F.col("from"))
    return joined.select("doc_id", "text_hash", F.col("d.source").alias("source"), "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with the columns of `docs`: each comes as often as its words are taken, rounded to whole copies."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own_id, own_hash, took_id, took_hash, copies, copy = free_names(docs, "own_id", "own_hash", "took_id", "took_hash", "copies", "copy")
    key = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_hash: F.xxhash64(text)})
    took = mix(docs, **options).filter("taken > 0").groupBy("doc_id", "text_hash").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    took = took.select(F.col("doc_id").alias(took_id), F.col("text_hash").alias(took_hash), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias(copies)).filter(F.col(copies) > 0)
    kept = key.join(took, F.col(own_id).eqNullSafe(F.col(took_id)) & (F.col(own_hash) == F.col(took_hash)))
    return kept.withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)
