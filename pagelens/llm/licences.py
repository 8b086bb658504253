"""Licence scans by canonical digests, with DataFrame functions only.

A unit of text is made canonical: lower-cased and made one line, copyright notices dropped, licences spelled one way, and
everything but letters and digits turned into single spaces. A notice may stand anywhere; it reaches to the words with which
a known text opens, or to the end of the unit, and where neither is near it stays, so that nothing else goes with it.
The digest of the whole canonical unit meets the digests of known licence texts and
notices in a hash join: the notices of KNOWN and the whole texts in the folder licence_texts, each with and without its
title and appendix. Units are the whole document, each of its lines, and its blocks: what stands between lines that hold
nothing but a rule (three or more of one of - = * _ # ~). Nothing is matched in part. In a document or block it does not
matter where lines are wrapped. Lines and blocks are joined only if their length is that of a known text, so few are.

Rows: null text counts as empty and has no licence. Lines and blocks without letters or digits are no units, and a
document without rules has no blocks. Rows that share a doc_id are rows of their own. Extra columns are ignored. Empty
tables give no rows.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import ascii_lower, written

#: Notices and short licence texts, by their public identifiers.
KNOWN = (
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("FSFAP", "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved. This file is offered as-is, without any warranty."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
)

#: Spellings that stand for one word, from left to right, applied in this order to lower-cased text.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("share-alike", "sharealike"),
    (" version ", " v"),
    (" v. ", " v"),
    ("copyright holder", "copyright owner"),
    ("https://", "http://"),
    ("favour", "favor"),
)

_YEAR = r"[<\[{]?(?:[0-9]{4}|year|yyyy)"

#: How a copyright notice begins: a sign or a year follows, so that sentences and list items `(c)` stay.
BEGINS = rf"(?:copyright[ :]*(?:\(c\)|©|{_YEAR})|\(c\) ?(?:copyright|{_YEAR})|© ?(?:copyright|{_YEAR})|all rights reserved)"

#: The words with which what may follow a notice opens, in lower case.
OPENINGS = (
    "permission is (?:hereby )?granted", "permission to use", "redistribution and use", "licen[cs]ed under", "released under", "everyone is permitted", "this program is", "this library is", "this work is",
    "this source code", "this licen[cs]e", "copying and distribution", "do what the", "the mit licen[cs]e", "mit licen[cs]e", "isc licen[cs]e", "bsd [23]-clause", "apache licen[cs]e", "mozilla public", "gnu (?:lesser |library |affero )?general",
)

#: One or more notices up to what follows them, and a notice that ends a text. A notice that neither ends stays in the text.
NOTICES = rf"(?:^| )(?:{BEGINS}.{{0,250}}?)+?( (?:{'|'.join(OPENINGS)}))"
LAST_NOTICE = rf"(?:^| ){BEGINS}[^;!?]{{0,100}}$"

#: A line that parts blocks.
RULE = r"^[\x20\x09]*(?:-{3,}|={3,}|\*{3,}|_{3,}|#{3,}|~{3,})[\x20\x09]*$"

TEXTS = Path(__file__).parent / "licence_texts"


def whole_texts() -> list[tuple[str, str]]:
    """The licences of the folder by their identifiers, each whole, without its title, and both without what follows its terms."""
    out = []
    for path in sorted(TEXTS.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        for t in (text, re.split(r"\n[ \t]*\n", text, maxsplit=1)[1]):
            out += [(path.stem.split("+")[0], x) for x in {t, re.split(r"(?<=END OF TERMS AND CONDITIONS)\n", t)[0], re.split(r"\n[ \t]*END OF TERMS AND CONDITIONS\n", t)[0]}]
    return out


def canonical_lines(text):
    """A text's canonical lines, parted by line feeds."""
    return F.regexp_replace(_spelled(text), r"[^a-z0-9\n]+", " ")


def canonical(text):
    """The canonical form of a whole unit, in lower case. It is made one line first, so that it does not matter where lines end;
    a unit of nothing but notices keeps them."""
    joined = F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))
    bare = F.trim(F.regexp_replace(F.regexp_replace(joined, NOTICES, "$1"), LAST_NOTICE, ""))
    return F.trim(F.regexp_replace(_spelled(F.when(bare == "", joined).otherwise(bare)), r"[^a-z0-9]+", " "))


def _spelled(col):
    for a, b in SPELLINGS:
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def known_texts() -> list[tuple[str, str]]:
    """All known notices and texts with their identifiers."""
    return [*KNOWN, *whole_texts()]


def known_digests(spark: SparkSession, known) -> DataFrame:
    """`digest, license_id, size` of the known texts; at most as many rows as the table has texts."""
    texts = spark.createDataFrame(list(known), "license_id string, text string").select("license_id", canonical(ascii_lower(F.col("text"))).alias("text"))
    return texts.select(F.sha2("text", 256).alias("digest"), "license_id", F.length("text").alias("size")).groupBy("digest").agg(F.min("license_id").alias("license_id"), F.max("size").alias("size"))


def scan_licences(docs: DataFrame, known=None) -> DataFrame:
    """`doc_id, text_digest, text_license, n_license_lines, line_licenses, n_license_blocks, block_licenses` for each row of `docs(doc_id, text)`."""
    spark = docs.sparkSession
    table = written(known_digests(spark, known_texts() if known is None else known), "licences")
    sizes = sorted(r["size"] for r in table.select("size").distinct().collect())  # at most as many as known texts
    table = table.select(F.col("digest").alias("known"), "license_id")

    def digests(units):
        return F.transform(F.filter(units, lambda x: F.length(x).isin(sizes)), lambda x: F.sha2(x, 256))

    lower = F.regexp_replace(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"\r\n?", "\n")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower.alias("lower"))
    lines = F.transform(F.split(canonical_lines(F.col("lower")), "\n"), lambda x: F.trim(x))
    blocks = F.when(F.col("lower").rlike(f"(?md){RULE}"), F.transform(F.split("lower", f"(?md){RULE}"), canonical)).otherwise(F.array().cast("array<string>"))
    units = texts.select("doc_id", F.sha2(canonical(F.col("lower")), 256).alias("text_digest"), digests(lines).alias("lines"), digests(blocks).alias("blocks"))
    units = written(units.withColumn("row", F.monotonically_increasing_id()), "units")

    def found(column: str, kind: str) -> DataFrame:
        hits = units.select(F.col("row").alias(f"{kind}_row"), F.explode(column).alias("digest")).join(F.broadcast(table), F.col("digest") == F.col("known"))
        ids = F.array_join(F.array_sort(F.collect_set("license_id")), ",")  # a set of known identifiers, so bounded
        return hits.groupBy(f"{kind}_row").agg(F.count("*").alias(f"n_license_{column}"), ids.alias(f"{kind}_licenses"))

    out = units.join(F.broadcast(table), F.col("text_digest") == F.col("known"), "left")
    for column, kind in (("lines", "line"), ("blocks", "block")):
        out = out.join(found(column, kind), F.col("row") == F.col(f"{kind}_row"), "left")
    counts = [x for c, k in (("lines", "line"), ("blocks", "block")) for x in (F.coalesce(f"n_license_{c}", F.lit(0)).cast("long").alias(f"n_license_{c}"), F.coalesce(f"{k}_licenses", F.lit("")).alias(f"{k}_licenses"))]
    return out.select("doc_id", "text_digest", F.col("license_id").alias("text_license"), *counts)


def scan_sql(known=None) -> str:
    """DuckDB's SQL for scan_licences over `documents`, with the same known texts."""

    def lower(expr: str) -> str:
        return f"regexp_replace(translate({expr}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\r\\n?', chr(10), 'g')"

    def spelled(expr: str) -> str:
        for a, b in SPELLINGS:
            expr = f"replace({expr}, '{a}', '{b}')"
        return expr

    def whole(expr: str) -> str:
        joined = f"trim(regexp_replace({expr}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"
        bare = f"trim(regexp_replace(regexp_replace({joined}, '{NOTICES}', '\\1', 'g'), '{LAST_NOTICE}', '', 'g'))"
        kept = spelled(f"coalesce(nullif({bare}, ''), {joined})")
        return f"trim(regexp_replace({kept}, '[^a-z0-9]+', ' ', 'g'))"

    lined = "regexp_replace({}, '[^a-z0-9\\n]+', ' ', 'g')".format(spelled("lower"))
    texts = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in (known_texts() if known is None else known))
    return f"""
        WITH v(license_id, text) AS (VALUES {texts}),
        known AS (SELECT sha256({whole(lower('text'))}) AS digest, min(license_id) AS license_id FROM v GROUP BY 1),
        docs AS (SELECT row_number() OVER () AS row_id, doc_id, {lower("coalesce(text, '')")} AS lower FROM documents),
        lines AS (SELECT row_id, sha256(trim(unnest(string_split({lined}, chr(10))))) AS digest FROM docs),
        blocks AS (SELECT row_id, unnest(regexp_split_to_array(lower, '(?m){RULE}')) AS block FROM docs WHERE regexp_matches(lower, '(?m){RULE}')),
        digests AS (SELECT row_id, sha256({whole('block')}) AS digest FROM blocks),
        by_line AS (SELECT row_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM lines JOIN known USING (digest) GROUP BY 1),
        by_block AS (SELECT row_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM digests JOIN known USING (digest) GROUP BY 1)
        SELECT doc_id, sha256({whole('lower')}) AS text_digest, license_id AS text_license, coalesce(by_line.n, 0) AS n_license_lines, coalesce(by_line.ids, '') AS line_licenses,
               coalesce(by_block.n, 0) AS n_license_blocks, coalesce(by_block.ids, '') AS block_licenses
        FROM docs LEFT JOIN by_line USING (row_id) LEFT JOIN by_block USING (row_id) LEFT JOIN known ON known.digest = sha256({whole('lower')})
    """
