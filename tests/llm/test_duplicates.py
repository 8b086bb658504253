import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
from llm.conftest import make

from pagelens.llm import blocknames, entries, licences, neardup
from pagelens.llm.components import components

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def wanted_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r.text or "").translate(UP)].append(r.doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return Counter(out)


def test_exact(docs, edge, empty):
    for df in (docs, edge):
        for block in (3, 8192):
            if df is docs and block == 3:
                continue
            got = blocknames.exact_duplicates(df, block).collect()
            assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in got) == wanted_exact(df.collect())
    assert blocknames.exact_duplicates(empty).count() == 0


def test_exact_tells_like_texts_apart(spark):
    """Texts that share blocks, lengths and halves, and differ somewhere."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice([4, 5, 8, 16, 17]))) for _ in range(300)]
    df = make(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = blocknames.exact_duplicates(df, 2).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in got) == wanted_exact(df.collect())


def test_exact_with_shared_keys(spark, monkeypatch):
    """Blocks whose 64-bit keys collide still get names of their own."""
    from pyspark.sql import functions as F

    real = blocknames._blocks
    monkeypatch.setattr(blocknames, "_blocks", lambda d, n: real(d, n).withColumn("key", F.lit(7).cast("long") + F.length("block") % 2))
    df = make(spark, [(i, t, "en", "s") for i, t in enumerate(["aa", "bb", "AA", "abc", "abd", "aabb", "aabb", ""])])
    got = blocknames.exact_duplicates(df, 2).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in got) == wanted_exact(df.collect())


def test_kept_documents_have_no_equal_texts(edge):
    kept = blocknames.kept_documents(edge)
    texts = [(r.text or "").translate(UP) for r in kept.collect()]
    assert kept.columns == edge.columns and len(texts) == len(set(texts)) == len({(r.text or "").translate(UP) for r in edge.collect()})


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(UP).encode())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def wanted_near(rows):
    sets = [shingles(r.text) for r in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    held = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            held[x].append(i)
    both = Counter((v[b], v[a]) for v in held.values() for a in range(len(v)) for b in range(a))
    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            group[find(a)] = find(b)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            ids[find(i)].append(r.doc_id)
    low = {k: min(v) for k, v in ids.items()}
    return Counter((r.doc_id, len(sets[i]), low.get(find(i)), r.doc_id == low.get(find(i))) for i, r in enumerate(rows))


def near(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect())


def test_near(docs, edge, empty):
    assert near(docs) == wanted_near(docs.collect())
    assert near(edge) == wanted_near(edge.collect())
    assert neardup.near_duplicates(empty).count() == 0


def test_near_families_lose_no_link(spark):
    """Copies with more and more words changed: buckets hold several components, and far copies hang on a few others."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(150)] = f"r{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(words), "en", "s"))
    df = make(spark, rows)
    monkey, neardup.BLOCK = neardup.BLOCK, 50
    try:
        got = near(df)
    finally:
        neardup.BLOCK = monkey
    assert got == wanted_near(df.collect())


def test_estimates():
    rng = np.random.default_rng(0)
    sign = neardup.Signer()
    for share in (0.5, 0.75, 0.9):
        est = []
        for _ in range(30):
            both, n = rng.integers(0, 1 << 63, 600, np.uint64), int(600 * (1 - share) / (2 * share))
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, n, np.uint64)])) for _ in range(2))
            pa, pb = (np.frombuffer(sign.pack(sign.minima(x)), np.uint8) for x in (a, b))
            est.append(neardup.estimate(neardup.agreed(pa, pb)))
        assert abs(np.mean(est) - share) < 0.03


def test_shingles_are_kept_by_word():
    s = neardup.Shingler(5, limit=10)
    texts = ["a b c d e f", "A B\tC\nD E F", "f e d c b a", "a b", "a  b", "b a", "", None, "x " * 50]
    got = [s(t).tolist() for t in texts]
    assert got[0] == got[1] != got[2] and got[3] == got[4] != got[5] and got[6] == got[7] == [] and len(got[8]) == 1 and len(got[0]) == 2


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(200, 100 + i) for i in range(1, 60)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    group = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    assert got == {x: r for x, r in group.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_licences(spark, docs, edge, empty):
    rows = [(1, "Copyright (c) 2020 Me\nReleased under the MIT Licence!", "en", "s"), (2, "text\nLicensed under the Apache License, Version 2.0.\nmore", "en", "s"), (3, "We like the MIT License.", "en", "s"), (4, None, None, None)]
    got = {r.doc_id: r for r in licences.scan_licences(make(spark, rows)).collect()}
    assert (got[1].text_license, got[1].line_licenses) == ("MIT", "MIT") and (got[2].text_license, got[2].line_licenses, got[2].n_license_lines) == (None, "Apache-2.0", 1)
    assert got[3].text_license is None and got[3].n_license_lines == 0 and got[4].text_license is None
    assert licences.scan_licences(empty).count() == 0
    for df in (docs, edge):
        c = duckdb.connect()
        documents = df.select("doc_id", "text").toPandas()
        documents["doc_id"] = documents["doc_id"].astype("Int64")
        c.register("documents", documents)
        cols = "doc_id, text_digest, text_license, n_license_lines, line_licenses"
        want = Counter(map(str, c.execute(f"SELECT {cols} FROM ({licences.scan_sql()})").fetchall()))
        assert Counter(str(tuple(r)) for r in licences.scan_licences(df).selectExpr(*cols.split(", ")).collect()) == want
    assert set(entries.oracle_sql()) <= set(entries.queries())


def test_notices_take_nothing_else_with_them(spark):
    """Texts that only share a notice, or begin with one, keep their own digests."""
    texts = ["", "© 2020 Jane Doe", "© 2020 Jane Doe\nA poem of mine; it goes on for a while", "© 2020 a poem; of one line", "Copyright (c) 2020 Jane Doe and then a long text. " + "It goes on. " * 40, "It goes on. " * 40, "copyright holders may (c) do so", "All rights reserved"]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    got = [r.text_digest for r in sorted(licences.scan_licences(make(spark, rows)).collect(), key=lambda r: r.doc_id)]
    assert len(set(got)) == len(texts)
    mit = " ".join((licences.TEXTS / "MIT.txt").read_text().split())
    one = [mit, mit.replace("MIT License ", ""), "Copyright (c) 2019 A. B. Copyright (c) 2020 C Corp., all rights reserved. " + mit[mit.index("Permission") :], mit + " and more"]
    assert [r.text_license for r in sorted(licences.scan_licences(make(spark, [(k, t, "en", "s") for k, t in enumerate(one)])).collect(), key=lambda r: r.doc_id)] == ["MIT", "MIT", "MIT", None]


def test_whole_licences(spark):
    """Whole texts, as they are, unwrapped and wrapped anew, with notices of their own, and texts that differ by a sentence."""
    import re
    import textwrap
    from itertools import groupby

    rows, want = [], {}
    for path in sorted(licences.TEXTS.glob("*.txt")):
        text = re.sub(r"(?im)^([ \t]*copyright \(c\)).*$", r"\1 2020 Some One", path.read_text())
        _, body = re.split(r"\n[ \t]*\n", text, maxsplit=1)
        notice = re.compile(r"(?i).*copyright (\(c\)|\[yyyy)")  # such lines stay lines

        def again(part, width):
            lines = [x for k, g in groupby(part.split("\n"), lambda x: bool(notice.match(x))) for x in (g if k else [" ".join(" ".join(g).split())])]
            return "\n".join(x if notice.match(x) else textwrap.fill(x, width, break_long_words=False, break_on_hyphens=False) for x in lines)

        flat = " ".join(text.split())
        rows_of = [flat, " ".join(body.split()), text.replace("\n", "\r\n"), text.replace("\n", "\r"), f"Copyright 2021 Jane Q. Doe, Inc.\n{body}"]
        forms = [text, body, *rows_of[: 5 if re.match(r"\s*(copyright \(c\)|permission|redistribution)", body, re.I) else 4], *("\n\n".join(again(p, n) for p in re.split(r"\n[ \t]*\n", text)) for n in (30, 57, 79, 10**6))]
        for form in forms:
            rows.append((len(rows), form, "en", "s"))
            want[len(want)] = path.stem.split("+")[0]
        rows.append((len(rows), text + "\nbut not for you", "en", "s"))
        want[len(want)] = None
    got = {r.doc_id: r.text_license for r in licences.scan_licences(make(spark, rows)).collect()}
    assert {i: (got[i], want[i], rows[i][1][:200]) for i in want if got[i] != want[i]} == {}
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "WTFPL"} <= set(want.values())
