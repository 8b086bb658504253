"""The registered queries: their columns, what they derive, and their SQL."""

import zlib
from collections import Counter

import duckdb
import pytest

from pagelens.llm import entries


def rows_of(spark, sf, name):
    return entries.queries()[name](spark, sf).collect()


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_queries_equal_their_sql(spark, sf, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    r = c.execute(entries.oracle_sql()[name])
    names = [d[0] for d in r.description]
    df = entries.queries()[name](spark, sf)
    assert sorted(names) == sorted(df.columns)
    assert Counter(str(tuple(x)) for x in df.select(*names).collect()) == Counter(map(str, r.fetchall()))


def test_ends_limits_and_splits(spark, sf, docs):
    ids = {r.doc_id for r in docs.collect()}
    one = rows_of(spark, sf, "op1_token_records")
    assert {r.doc_id for r in one} == ids and min(r.n_tokens for r in one) >= 1 and sum(r.n_tokens for r in one) == max(r.start + r.n_tokens for r in one)
    five = rows_of(spark, sf, "op5_token_counts")
    assert all(r.over_limit == (r.n_tokens > 512) for r in five) and {r.over_limit for r in five} == {True, False}
    three = rows_of(spark, sf, "op3_quality_classifier")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in three) and {r.doc_id for r in three} == ids
    ten = rows_of(spark, sf, "op10_language_id")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in ten) and {r.doc_id for r in ten} == ids
    nine = rows_of(spark, sf, "op9_best_fit_packing")
    assert max(r.offset + r.length for r in nine) <= 2048 and {r.doc_id for r in nine} == ids


def test_queries_of_op8(spark, sf):
    wanted = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.vec_id % 50 == 0}
    got = Counter(r.query_id for r in rows_of(spark, sf, "op8_cross_polytope_neighbours"))
    assert set(got) == wanted and set(got.values()) == {5}
