"""URL algebra: columns and the kernel of extractors agree, on cases of our own and on drawn ones."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelens.extract import kernel
from pagelens.functions import url as U
from pagelens.functions.glob import glob_regex, match_any, matches_any

NORMAL = [
    ("hTTps://Fruit.TEST/Pear?Kind=A", "https://fruit.test/Pear?Kind=A"), ("http://fruit.test:0080", "http://fruit.test/"), ("https://fruit.test:80/", "https://fruit.test:80/"),
    ("https://me@fruit.test/", "https://fruit.test/"), ("https://a:b@c@fruit.test/x", "https://fruit.test/x"), ("  https://fruit.test/a\tb\nc  ", "https://fruit.test/abc"),
    ("https://fruit.test/x/y/../../z/./", "https://fruit.test/z/"), ("https://fruit.test/../a", "https://fruit.test/a"), ("https://fruit.test/a/..", "https://fruit.test/"), ("https://fruit.test/a//../b", "https://fruit.test/a/b"),
    ("https://fruit.test/...", "https://fruit.test/..."), ("https://fruit.test/?a/../b", "https://fruit.test/?a/../b"), ("https://fruit.test?x=1", "https://fruit.test/?x=1"), ("https://fruit.test/a?#b", "https://fruit.test/a"),
    ("https://fruit.test/crème brûlée", "https://fruit.test/cr%C3%A8me%20br%C3%BBl%C3%A9e"), ("https://fruit.test/\"<>`", "https://fruit.test/%22%3C%3E%60"), ("https://fruit.test/?q=a b|c", "https://fruit.test/?q=a%20b%7Cc"),
    ("https://fruit.test/100%", "https://fruit.test/100%"), ("https://münchen.test/", "https://xn--mnchen-3ya.test/"), ("http://[2001:DB8::1]/x", "http://[2001:db8::1]/x"), ("http://[2001:db8::1]:80/", "http://[2001:db8::1]/"),
    ("http://[x/", None), ("http://x]/", None), ("http://[]/", None), ("http://:80/", None), ("https:/fruit.test/", None), ("//fruit.test/", None), ("mailto:a@fruit.test", None), ("http://fruit.test:x/", None), ("http://fruit.test:65536/", None), ("", None),
]
BASE = "https://fruit.test/box/green/list.html?page=4"
RELATIVE = [
    ("pear.png", "https://fruit.test/box/green/pear.png"), ("../red/", "https://fruit.test/box/red/"), ("/top?x=1&y=%20", "https://fruit.test/top?x=1&y=%20"), ("/a/../b", "https://fruit.test/b"), ("//img.test/p.png", "https://img.test/p.png"),
    ("?page=5", "https://fruit.test/box/green/list.html?page=5"), (".", "https://fruit.test/box/green/"), ("../../../../up", "https://fruit.test/up"), ("http://other.test", "http://other.test/"), ("x//y", "https://fruit.test/box/green/x/y"),
    ("/kiwi gold", "https://fruit.test/kiwi%20gold"), (" pear\n.png ", "https://fruit.test/box/green/pear.png"), ("pear.png#part", "https://fruit.test/box/green/pear.png"),
    ("#part", None), ("javascript:x()", None), ("tel:123", None), ("blob:1", None), ("about:blank", None), ("data:,x", None), ("http://[x/", None), (" ", None),
]


def test_normal_forms_both_ways(spark):
    got = [tuple(r) for r in spark.createDataFrame(NORMAL, "u string, e string").select("u", U.normalize(F.col("u"))).collect()]
    assert got == NORMAL == [(u, kernel.normalize(u)) for u, _ in NORMAL]


def test_references_both_ways(spark):
    got = [tuple(r) for r in spark.createDataFrame(RELATIVE, "u string, e string").select("u", U.resolve(F.lit(BASE), F.col("u"))).collect()]
    assert got == RELATIVE == [(u, kernel.resolve(BASE, u)) for u, _ in RELATIVE]


def test_tracking_parameters_go(spark):
    url, globs = "https://fruit.test/p?utm_id=1&kind=pear&&ref=z&utm%5Fx=2&flag", ("utm_*", "ref")
    assert spark.range(1).select(U.normalize(F.lit(url), globs)).first()[0] == "https://fruit.test/p?kind=pear&flag" == kernel.normalize(url, globs)
    plain = "https://fruit.test/p?ref=z"
    assert spark.range(1).select(U.normalize(F.lit(plain), globs)).first()[0] == "https://fruit.test/p" == kernel.normalize(plain, globs)


STEPS = st.lists(st.sampled_from(["a", "b.c", ".", "..", "...", "", "é", "%41", "x y", "~", "?q", "Z"]), max_size=7)


@given(STEPS)
def test_normal_forms_stay(steps):
    once = kernel.normalize("http://E.test/" + "/".join(steps))
    assert kernel.normalize(once) == once


def test_quick_forms_agree_with_the_kernel(spark):
    drawn = []
    given(STEPS)(lambda s: drawn.append("/" + "/".join(s)))()
    df = spark.createDataFrame([(d, BASE) for d in sorted(set(drawn))], "p string, b string")
    for r in df.select("p", U.normalize(F.concat(F.lit("https://e.test"), "p")).alias("n"), U.resolve(F.col("b"), F.col("p")).alias("r"), U.normalize(F.concat(F.lit("https://e.test"), "p"), ["q*"]).alias("s")).collect():
        assert (r.n, r.r, r.s) == (kernel.normalize("https://e.test" + r.p), kernel.resolve(BASE, r.p), kernel.normalize("https://e.test" + r.p, ("q*",))), r.p


def test_shapes_and_parts(spark):
    rows = [
        ("https://fruit.test/2023/11/box7/pear", "fruit.test/N/N/boxN/pear"), ("https://fruit.test/find?b=2&a=1&b=3&c", "fruit.test/find?a&b&c"), ("https://fruit.test/p/0123456789abcdef", "fruit.test/p/X"),
        ("https://fruit.test/p/AbcdefghijKlmnopqrstuvwx", "fruit.test/p/X"), ("http://[::2]:8080/v2", "::2/vN"),
    ]
    got = spark.createDataFrame(rows, "u string, e string").select("u", U.url_pattern(F.col("u"))).collect()
    assert [tuple(r) for r in got] == rows == [(u, kernel.pattern(u)) for u, _ in rows]
    u = F.lit("http://Fruit.Test:81/b%20x/Pear+1.WebP?z#q")
    r = spark.range(1).select(U.host_of(u), U.origin_of(u), U.path_and_query(u), U.url_filename(u), U.looks_like_image(u), U.looks_like_non_page(F.lit("https://fruit.test/list.csv")), U.host_dir(F.lit(".Fruit!.test"))).first()
    assert tuple(r) == ("fruit.test", "http://Fruit.Test:81", "/b%20x/Pear+1.WebP?z", "Pear+1.WebP", True, True, "fruit_.test")
    names = {"inline; filename=pear.png": "pear.png", 'attachment; filename="two words.png"': "two words.png"}
    for header, name in names.items():
        assert spark.range(1).select(U.disposition_filename(F.lit(header))).first()[0] == name


@pytest.mark.parametrize(("glob", "text", "hit"), [("*.png", "/a/pear.png", True), ("*.png", "/a/pear.png?x", False), ("/box?", "/box7", True), ("/box?", "/box", False), ("[a-c]*", "bx", True), ("[!a-c]*", "bx", False), ("[", "[", True), ("a+b", "aab", False)])
def test_globs(spark, glob, text, hit):
    assert match_any(text, [glob]) is hit
    assert spark.range(1).select(matches_any(F.lit(text), [glob])).first()[0] is hit
    assert glob_regex(glob).startswith("(?s)^")
