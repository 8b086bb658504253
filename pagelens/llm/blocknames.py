"""Exact duplicates by deterministic block naming, with DataFrame functions only.

A text (A-Z lower-cased) is cut into blocks of a fixed number of characters. The distinct blocks are sorted, and a
block's place in that order is its name: equal blocks have equal names and different blocks different ones. Then pairs of
neighbouring names are named in the same way, level by level, until each document has one name. Two documents are equal
if and only if they needed as many levels and ended with the same name; no hash decides that.

Sorting runs in buckets: a block's bucket comes from a hash, and the name is the bucket with the rank inside it, so no
task sorts more than its buckets. Distinct blocks are found before (partly on the map side), so a block that a third of
all rows share is sorted once. Blocks travel to their names by a 64-bit key; keys that two different blocks share are
noticed in the sort, and those blocks travel whole.

Rows: null text counts as empty. Rows that share a doc_id are rows of their own, fully repeated rows too: of those all
stay or go alike. Null doc_ids are smaller than all others. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.common import ascii_lower, forget, free_names, written

BLOCK_CHARS, BUCKETS, RANK_BITS = 8192, 1 << 16, 40


def _blocks(docs: DataFrame, block_chars: int) -> DataFrame:
    """`doc_id, digest, pos, n_blocks, block, key` of every block."""
    text = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    cut = F.when(F.length("text") <= block_chars, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))
    rows = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), cut.alias("blocks"))
    rows = rows.select("doc_id", "digest", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("pos", "block"))
    return rows.withColumn("key", F.xxhash64("block"))


def _named(distinct: DataFrame, by: list[str], key) -> DataFrame:
    """Names for distinct rows: bucket and rank by the values themselves."""
    bucket = F.pmod(F.shiftright(key, 20), F.lit(BUCKETS))
    w = Window.partitionBy("bucket").orderBy(*by)
    rank = F.row_number().over(w).cast("long")
    return distinct.withColumn("bucket", bucket).withColumn("name", F.shiftleft(F.col("bucket"), RANK_BITS) + rank)


def name_documents(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`doc_id, digest, rows, levels, name`: one row for each doc_id and text, `rows` of the table; equal texts have equal (levels, name)."""
    blocks = _blocks(docs, block_chars)
    named = _named(blocks.select("block", "key").distinct(), ["block"], F.col("key"))
    same_key = Window.partitionBy("bucket", "key")
    names = written(named.withColumn("shared", F.count("*").over(same_key) > 1).select("key", "name", "shared", F.when(F.col("shared"), F.col("block")).alias("block")), "names")
    at = blocks.select("doc_id", "digest", "pos", "n_blocks", "key").join(names.filter("not shared").select("key", "name"), "key")
    at = at.select("doc_id", "digest", "pos", "n_blocks", "name")
    if not names.filter("shared").isEmpty():
        clash = names.filter("shared").select("key", "block", "name")
        at = at.unionByName(blocks.join(clash, ["key", "block"]).select("doc_id", "digest", "pos", "n_blocks", "name"))
    at = written(at.groupBy("doc_id", "digest", "pos", "n_blocks", "name").agg(F.count("*").alias("rows")), "level")
    done, level = [], 0
    while True:
        done.append(at.filter("n_blocks = 1").select("doc_id", "digest", "rows", F.lit(level).alias("levels"), "name"))
        at = at.filter("n_blocks > 1")
        if at.isEmpty():
            break
        halves = at.groupBy("doc_id", "digest", "rows", F.expr("pos div 2").cast("int").alias("pos"), F.expr("(n_blocks + 1) div 2").cast("int").alias("n_blocks")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left_name"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).alias("right_name")
        )
        halves = written(halves, "pairs")
        pairs = _named(halves.select("left_name", "right_name").distinct(), ["left_name", "right_name"], F.xxhash64("left_name", "right_name"))
        at = written(halves.join(pairs.select("left_name", "right_name", "name"), ["left_name", "right_name"]).select("doc_id", "digest", "pos", "n_blocks", "rows", "name"), "level")
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    forget(names)
    return out


def exact_duplicates(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`doc_id, digest, keep_id, group_size, kept` for each row of `docs(doc_id, text)`; of equal texts the row with the largest doc_id stays."""
    ids = written(name_documents(docs, block_chars), "identities")
    groups = written(ids.groupBy("levels", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("rows").alias("group_size")), "groups")
    out = ids.join(groups, ["levels", "name"])
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return out.select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def kept_documents(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `docs` that stay, with all its columns; of rows with one doc_id and equal texts one stays."""
    text = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    own_id, own_digest, keep_id, keep_digest, n_rows = free_names(docs, "own_id", "own_digest", "keep_id", "keep_digest", "keep_rows")
    keyed = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_digest: F.unhex(F.sha2(text, 256))})
    staying = exact_duplicates(docs, block_chars).filter("kept").groupBy(F.col("doc_id").alias(keep_id), F.col("digest").alias(keep_digest)).agg(F.count("*").alias(n_rows))
    staying = written(staying, "staying")

    def rows(which: DataFrame) -> DataFrame:
        return keyed.join(which, F.col(own_id).eqNullSafe(F.col(keep_id)) & (F.col(own_digest) == F.col(keep_digest)), "left_semi")

    kept = rows(staying.filter(F.col(n_rows) == 1)).select(*docs.columns)
    repeated = staying.filter(F.col(n_rows) > 1)
    if not repeated.isEmpty():
        kept = kept.unionByName(rows(repeated).dropDuplicates([own_id, own_digest]).select(*docs.columns))
    return kept
