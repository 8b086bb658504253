"""Readers of markup, style sheets and site files, on documents of our own."""

import gzip
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pagelens.extract import columns as X
from pagelens.extract import css, html, kernel, rewrite, robots, site_files, srcset
from pagelens.extract.jsonld import jsonld_images
from pagelens.functions import binary as B
from pagelens.functions import url as U

AT = "https://shop.test/fruit/apple.html"
HERE = "https://shop.test/fruit/"


def found(markup, *options):
    return html.read(markup, AT, *options)


def images(markup, *options):
    return [(r.kind.removeprefix("html:"), r.url.removeprefix(HERE)) for r in found(markup, *options).images]


# srcset


def test_candidates_and_their_choice(spark):
    c = srcset.candidates("red.webp 640w, green.webp 320w,blue.webp 960w")
    assert [(x.url, x.width) for x in c] == [("red.webp", 640), ("green.webp", 320), ("blue.webp", 960)]
    assert srcset.choose(c, "largest") == ["blue.webp"] and srcset.choose(c, "all") == ["red.webp", "green.webp", "blue.webp"]
    assert srcset.choose(srcset.candidates("one.gif, three.gif 3x, two.gif 2.0x"), "largest") == ["three.gif"]
    assert srcset.choose(srcset.candidates("twin.png 2x, other.png 2x"), "largest") == ["twin.png"]
    assert srcset.choose(srcset.candidates("dense.png 9x, wide.png 10w"), "largest") == ["wide.png"]
    assert srcset.candidates("") == srcset.candidates(" , ,") == [] and srcset.choose([], "all") == []
    assert srcset.described("u", "288dpi").density == 3.0 and srcset.described("u", "3dppx").density == 1.0 and srcset.described("u", "tall w").width == 0
    steps = "https://img.test/resize(4,3)/pear,ripe.png 100w, https://img.test/resize(8,6)/pear,ripe.png 200w"
    assert srcset.choose(srcset.candidates(steps), "largest") == ["https://img.test/resize(8,6)/pear,ripe.png"]
    assert spark.range(1).select(srcset.largest(F.lit(steps))).first()[0] == "https://img.test/resize(8,6)/pear,ripe.png"


# CSS

SHEET = """
@charset "utf-8"; @import url("reset.css"); @import 'print.css' print; @import bare.css;
h1 { background: #fff url( leaf.svg ) no-repeat } h2 { cursor: url(hand.cur), auto; list-style: url("dot.gif") }
/* h3 { background: url(never.png) } */
h4 { background-image: image-set("small.jpg" 1x, "large.jpg" 3x) } h5 { background: -webkit-image-set(url(n.webp) 1x, url(m.webp) 2x) }
@font-face { font-family: Pear; src: url(pear.woff2), url(pear.png) } h6 { filter: url(#blur); behavior: url(x.htc) }
p { background: url(data:image/gif;base64,R0lG) } b { background: url(data:text/plain,no) } i { background: url(style.css?v=2) }
"""


def test_style_sheets(spark):
    sets, urls, imports = css.scan(SHEET)
    assert imports == ["reset.css", "print.css", "bare.css"] and sets == ["large.jpg", "m.webp"]
    assert urls == ["leaf.svg", "dot.gif", "data:image/gif;base64,R0lG"]
    assert css.scan(SHEET, "all")[0] == ["small.jpg", "large.jpg", "n.webp", "m.webp"]
    assert css.images("a{background:url(x.png)}", prefix="html:style") == [("x.png", "html:style:url")]
    got = spark.range(1).select(X.css_refs(F.lit(SHEET)).alias("c")).first().c
    assert [(r.url, r.kind) for r in got.images] == [(u, "css:image-set") for u in sets] + [(u, "css:url") for u in urls] and got.imports == imports


@pytest.mark.parametrize("text, urls", [
    ("/* a */* url(x.png) */ url(y.png)", ["x.png", "y.png"]), ("url(a.png /* b */ )", ["a.png"]), ("url(", []), ("url(a b) url( 'c d' )", ["c d"]), ("URL(\"e(f).png\")url(g(h)", ["e(f).png", "g(h"]),
    ("url('open) url(k.png)", ["k.png"]), ("/* open url(m.png)", ["m.png"]), ("image-set(url(n.png) 1x", ["n.png"]), ("@font-face {src:url(o.png)", ["o.png"]), ("url(p.woff2#x) url(q.png?a.css) url(r.css.png)", ["r.css.png"]), ("url() url('') url(#s)", []),
])
def test_awkward_sheets(text, urls):
    sets, found, _ = css.scan(text)
    assert sets + found == urls


@pytest.mark.parametrize("open_ended", ["url(" * 2_500_000, "image-set(" * 200_000, "@font-face{" * 200_000, "url('" * 200_000, "url(\"x" * 200_000, "/*" * 200_000, "@import " * 200_000, "@import url(" * 200_000])
def test_open_ended_sheets_take_no_long_time(open_ended):
    began = time.perf_counter()
    css.scan(open_ended)
    assert time.perf_counter() - began < 30


# HTML


def test_every_rule_of_elements():
    got = images(
        """<head><link rel="Apple-Touch-Icon" href=t.png sizes=180x180><link rel=preload as=Image href=p.png imagesrcset="p1.png 1x, p2.png 2x"><link rel=preload as=image href=q.png>
        <link rel=preload as=font href=f.woff><link rel=image_src href=s.png><meta name="Twitter:Image" content=tw.png><meta itemprop=image content=it.png><meta name=other content=no.png></head>
        <body background=paper.png><picture><source srcset="in.avif 2x"></picture><source srcset=out.avif><video poster=film.jpg></video><input type=IMAGE src=go.png><input type=text src=no.png>
        <svg><image xlink:href=vec.png /><feImage href=fx.png /></svg><image src=old.png><object data=o.png></object><object data=o.swf></object><embed src=e.gif>
        <style>td{background:url(cell.png)}</style><script type="application/ld+json">{"logo":"ld.png"}</script><td background=td.png style="background:image-set(url(a.png) 1x, url(b.png) 2x)">"""
    )
    assert got == [
        ("link@icon", "t.png"), ("link@preload", "p2.png"), ("link@preload", "q.png"), ("link@image_src", "s.png"), ("meta@twitter:image", "tw.png"), ("meta@image", "it.png"), ("body@background", "paper.png"),
        ("source@srcset", "in.avif"), ("video@poster", "film.jpg"), ("input@src", "go.png"), ("svg-image@href", "vec.png"), ("svg-image@href", "fx.png"), ("img@src", "old.png"), ("object@data", "o.png"),
        ("embed@data", "e.gif"), ("style:url", "cell.png"), ("json-ld", "ld.png"), ("td@background", "td.png"), ("style-attr:image-set", "b.png"),
    ]


def test_images_with_candidates_and_lazy_attributes():
    assert images('<img src=a.png srcset="b.png 2x">') == [("img@srcset", "b.png")] and images('<img src=a.png data-srcset="b.png 2x">') == [("img@src", "a.png"), ("img@data-srcset", "b.png")][1:]
    assert images('<img src=a.png srcset="b.png 1x, c.png 2x">', html.Options(srcset="all")) == [("img@srcset", "b.png"), ("img@srcset", "c.png"), ("img@src", "a.png")]
    assert images("<img src=grey.gif data-original=real.png><i data-any=x.webp data-two='y z.png' data-no=y.txt>") == [("img@src", "grey.gif"), ("img@data-original", "real.png"), ("i@data-*", "x.webp")]
    assert images("<img data-hero=h.txt>", html.Options(frozenset(["data-hero"]))) == [("img@data-hero", "h.txt")]
    twice = found("<img src=a.png alt='first  \n one'><img src=a.png alt=second><a href=a.png>third</a>")
    assert [(r.kind, r.context) for r in twice.images] == [("html:img@src", "first one"), ("html:a@href", "third")]
    assert images("<img src='data:image/png;base64,AA'><img src='data:text/plain,x'>") == [("img@src", "data:image/png;base64,AA")] and images("<img src='data:image/png,x'>", html.Options(data_uris=False)) == []


def test_links_and_site_files():
    f = found(
        "<base href=/veg/><base href=/no/><a href=leek>l</a><area href=//cdn.test/map><a href=list.pdf>p</a><a href='tel:1'>t</a><iframe src=frame></iframe>"
        "<link rel=next href=2><link rel=alternate type=application/rss+xml href=feed><link rel='stylesheet x' href=a.css><link rel=manifest href=m.json><meta name=msapplication-config content=b.xml>"
        "<div id=__next></div><div id=main></div><noscript>Please turn on JavaScript</noscript>"
    )
    veg = "https://shop.test/veg/"
    assert f.base == veg and f.links == [veg + "leek", "https://cdn.test/map", veg + "frame", veg + "2"] and f.stylesheets == [veg + "a.css"]
    assert f.manifests == [veg + "m.json"] and f.browserconfigs == [veg + "b.xml"] and f.mount_nodes == ["__next"] and f.noscript_js
    none = found("<link rel=stylesheet href=a.css><link rel=manifest href=m.json>", html.Options(css=False, manifest=False))
    assert none.stylesheets == none.manifests == []


AWKWARD = [
    ('<a data-href="/wrong" href="/right">', ["/right"]), ("<a href=/x?a=1&amp;b=2>", ["/x?a=1&b=2"]), ("<a href='/x?copy=1&copy=2'>", ["/x?copy=1&copy=2"]), ("<!-- <a href=/no> --><a href=/yes>", ["/yes"]),
    ("<script>'<a href=/no>'</script><a href=/yes>", ["/yes"]), ("<title><a href=/no></title><a href=/yes>", ["/yes"]), ("<a title='>' href=/yes>", ["/yes"]), ("<A HREF = '/yes'>", ["/yes"]), ("<a href=/one href=/two>", ["/one"]),
    ("<a href>x</a><a href=''>y</a>", []), ("<a href='/open", []), ("<a href=/a<b>", ["/a%3Cb"]), ("< a href=/no>", []), ("<abbr href=/no>", []), ("<a/href=/yes>", ["/yes"]), ("<textarea><a href=/no>", []),
]


@pytest.mark.parametrize(("markup", "links"), AWKWARD)
def test_awkward_markup(markup, links):
    assert [u.removeprefix("https://shop.test") for u in found(markup).links] == links


def test_implied_ends_and_text():
    f = found("<html><head><title>not counted</title></head><body><ul><li><a href=a.png>one<li><a href=b.png>two</ul><table><tr><td><a href=c.png>three<td>four</table></body>")
    assert [(r.url.removeprefix(HERE), r.context) for r in f.images] == [("a.png", "one"), ("b.png", "two"), ("c.png", "three")] and f.text_chars == len("onetwothreefour")
    assert found("bare text").text_chars == 8 and found("").text_chars == 0 and found("<p>a<script>bc</script>").text_chars == 3


@pytest.mark.parametrize("part", ["<ul><li><a href=x>y", "<p><b><div>", "<table><td><p><b>", "</p></x>", "<a href='", "<!--", "<![x[", "<svg><g>", "<noscript>", "&", "<button><a href=a.png>"])
def test_time_grows_with_length_alone(part):
    began = time.perf_counter()
    found(part * 20_000)
    assert time.perf_counter() - began < 20


def test_charsets():
    assert html.charset("naïve".encode("cp1252"), "text/html; charset=windows-1252") == "naïve" and html.charset("żółw".encode("iso-8859-2"), "text/html; charset = ISO-8859-2") == "żółw"
    assert html.charset(b'<meta http-equiv=x content="text/html; charset=shift_jis">' + "梨".encode("shift_jis"), "text/html").endswith("梨")
    assert html.charset(b"<meta charset = 'koi8-r'>\xc4\xc1", None).endswith("да") and html.charset(b"\xc3\xa9\xff", None) == "é�"
    for odd in ("idna", "undefined", "base64", "nonsense", "rot13"):
        assert html.charset(b"pear\xff", f"text/html; charset={odd}") == "pear�"


# Site files


def test_sitemaps():
    plain = site_files.sitemap(b"\xef\xbb\xbf# list\nhttps://a.test/1\n  http://a.test/2  \nftp://a.test/3\n")
    assert plain.pages == ["https://a.test/1", "http://a.test/2"]
    maps = b"<?xml version='1.0'?><sitemapindex xmlns='x'><sitemap><loc>\n https://a.test/m1.xml </loc></sitemap><sitemap><loc/></sitemap></sitemapindex>"
    assert site_files.sitemap(gzip.compress(maps)).sitemaps == ["https://a.test/m1.xml"]
    mixed = b"<u:urlset xmlns:u='x' xmlns:image='y'><u:url><u:loc>https://a.test/p?x=1&amp;y=2</u:loc><image:image><image:loc><![CDATA[https://a.test/i.png]]></image:loc></image:image></u:url></u:urlset>"
    assert site_files.sitemap(mixed) == ([], ["https://a.test/p?x=1&y=2"], ["https://a.test/i.png"])


def test_broken_sitemaps_are_recovered():
    rows = b"<url><loc>https://a.test/?a=1&b=2</loc></url><url><loc>https://a.test/two</loc></url>"
    want = ["https://a.test/?a=1&b=2", "https://a.test/two"]
    for body in (b"<urlset>" + rows, b"<?xml version='1.0' encoding='nope'?><urlset>" + rows + b"</urlset>", b"<urlset><x>" + rows + b"</y></urlset>", b"<urlset>" + rows + b"<url><loc>"):
        assert site_files.sitemap(body).pages == want, body
    wide = "<?xml version='1.0' encoding='gbk'?><urlset><url><loc>https://a.test/梨</loc></url></urlset>".encode("gbk")
    assert site_files.sitemap(wide).pages == ["https://a.test/梨"]
    outside = b'<!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/passwd">]><urlset><url><loc>https://a.test/&e;</loc></url></urlset>'
    assert all("root:" not in u for u in site_files.sitemap(outside).pages)
    with pytest.raises(ValueError, match="unfolds"):
        site_files.unzipped(gzip.compress(bytes(5000)), 4999)
    with pytest.raises(ValueError, match="damaged"):
        site_files.unzipped(b"\x1f\x8b\xff\xff")


def test_manifests_and_linked_data():
    m = b'{"icons":[{"src":"a.png"},{"src":7},8],"screenshots":[{"src":"b.png"}],"shortcuts":[{"icons":[{"src":"c.png"}]},{"icons":{}}]}'
    assert site_files.manifest_images(m) == [("a.png", "manifest:icon"), ("b.png", "manifest:screenshot"), ("c.png", "manifest:shortcut-icon")]
    for odd in (b"{", b"[]", b"3", b'{"icons":3}', b'{"shortcuts":3}', b'{"shortcuts":[3,{"icons":4}]}', b"\xff", b"[" * 100_000):
        assert site_files.manifest_images(odd) == []
    assert site_files.browserconfig_images(b"<browserconfig><tile><big src='t.png'/><small src=''/></tile></browserconfig>") == ["t.png"]
    ld = '[{"photo":{"url":"p.png","caption":"no.png"},"url":"no.html"},{"thumbnail":["t.png",{"contentUrl":"u.png"},["v.png"]]},{"@graph":[{"image":"p.png"}]}]'
    assert jsonld_images(ld) == ["p.png", "t.png", "u.png", "v.png"] and jsonld_images("{") == [] and jsonld_images("[" * 100_000) == []


# Faults stay in their rows


def test_one_bad_body_spoils_no_other(spark, monkeypatch):
    real = html.read
    bodies = [("good", "<a href=/x>"), ("odd", "<![foo[ y"), ("bad", "<boom>"), ("null", None)]
    df = spark.createDataFrame(bodies, "k string, t string").coalesce(1)
    assert {r.k: r.h.links for r in df.select("k", X.html_refs(F.col("t"), F.lit(AT)).alias("h")).collect()} == {"good": ["https://shop.test/x"], "odd": [], "bad": [], "null": []}
    assert X._guarded(lambda t: 1 / 0, "x")["error"].startswith("ZeroDivisionError")
    maps = spark.createDataFrame([("bomb", bytearray(b"\x1f\x8b\xff\xff")), ("map", bytearray(b"https://a.test/")), ("none", None)], "k string, b binary")
    got = {r.k: r.m for r in maps.select("k", X.sitemap_refs(F.col("b")).alias("m")).collect()}
    assert "damaged" in got["bomb"].error and got["bomb"].pages == [] and got["map"].pages == ["https://a.test/"] and got["map"].error is None and got["none"].pages == []
    assert real is html.read


# Rewriting


def test_rewriting(spark):
    mine = rewrite.Rule("mine", r"^(.*)/mini/(.*)$", r"\1/maxi/\2")
    rows = [
        ("https://b.test/wp-content/uploads/2023/pear-1024x768.jpeg", ["https://b.test/wp-content/uploads/2023/pear.jpeg"]), ("https://b.test/wp-content/uploads/pear-10x10.png?v=3", ["https://b.test/wp-content/uploads/pear.png?v=3"]),
        ("https://b.test/uploads/pear-10x10.png", []), ("https://b.test/wp-content/uploads/pear-10x.png", []), ("https://b.test/wp-content/uploads/a-1x1/pear.png", []),
        ("https://b.test/p.png?width=5&q=80", ["https://b.test/p.png"]), ("https://b.test/p.png?w=5&", ["https://b.test/p.png"]), ("https://b.test/p.png?w=5&id=2", []), ("https://b.test/p.png?w", []), ("https://b.test/p.png", []),
        ("https://c.test/x/image/upload/q_auto,f_webp/c_fit/v77/dir/p.png", ["https://c.test/x/image/upload/v77/dir/p.png"]), ("https://c.test/x/image/upload/v77/p.png", []), ("https://c.test/image/upload/w_1/p.png", []), ("https://c.test/image/upload/long_1/v7/p.png", []),
        ("https://cdn.shopify.com/s/pear_grande.png", ["https://cdn.shopify.com/s/pear.png"]), ("https://cdn.shopify.com/s/pear_x200@2x.png?v=9", ["https://cdn.shopify.com/s/pear.png?v=9"]), ("https://cdn.shopify.com/s/pear_huge.png", []),
        ("https://cdn.shopify.com/s/pear_x.png", []), ("https://d.test/mini/p.png", ["https://d.test/maxi/p.png"]), (None, []),
    ]
    got = spark.createDataFrame(rows, "u string, e array<string>").select("u", "e", rewrite.variants(F.col("u"), rewrite.rules(["all"], [mine])).alias("v")).collect()
    assert [r for r in got if r.e != r.v] == []
    assert rewrite.rules(["cloudinary"]) == ["cloudinary"] and spark.range(1).select(rewrite.variants(F.lit("x"), [])).first()[0] == []
    with pytest.raises(ValueError, match="unknown"):
        rewrite.rules(["none such"])


def test_robots():
    r = robots.parse("# c\nUser-Agent: other\nDisallow: /\n\nUser-agent: PageLens\nuser-agent: x\nAllow: /$\nDisallow: /admin*\nCrawl-delay: 3\nSitemap: https://a.test/m.xml\n", "pagelens")
    assert (r.delay, r.sitemaps, [x.allow for x in r.rules]) == (3.0, ["https://a.test/m.xml"], [True, False])
    assert robots.for_response(410, None, "x") == robots.ALLOW_ALL and robots.for_response(500, "User-agent: *", "x") == robots.DENY_ALL == robots.for_response(None, None, "x")


# SQL


def test_sql_functions(spark):
    X.register(spark)
    urls = ["HTTPS://A.Test:443/x/../y z?q=1#f", "http://[::1]:81/a1/", "nonsense", "https://a.test/2024/05/abcdefabcdefabcdef?b=1&a=2&b=3", None, "http://[x/"]
    bodies = [bytes.fromhex(h) for h in ("FFD8FF00", "474946383961", "424D", "0000001C667479706176696600000000617669666D696631", "3C737667202F3E", "00000100010010")]
    df = spark.createDataFrame([Row(u=u, b=bytearray(b)) for u, b in zip(urls, bodies)])
    df.createOrReplaceTempView("sql_in")
    got = spark.sql("SELECT url_normalize(u), url_pattern(u), url_host(u), sniff_format(b), url_resolve('https://a.test/d/', u) FROM sql_in").collect()
    want = df.select(U.normalize(F.col("u")), U.url_pattern(F.col("u")), U.host_of(F.col("u")), B.sniff(F.col("b")), U.resolve(F.lit("https://a.test/d/"), F.col("u"))).collect()
    assert "Python" not in spark.sql("SELECT url_normalize(u), url_pattern(u), url_host(u), url_origin(u), url_filename(u), sniff_format(b), url_resolve(u, '../x'), collapse_text(u) FROM sql_in")._jdf.queryExecution().toString()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and kernel.normalize(urls[0]) == "https://a.test/y%20z?q=1"
    spark.createDataFrame([("<img src=a.png><img src=b.png>",)], "h string").createOrReplaceTempView("docs_h")
    assert [r.url for r in spark.sql("SELECT t.url FROM docs_h, LATERAL html_refs(h, 'https://a.test/') t").collect()] == ["https://a.test/a.png", "https://a.test/b.png"]
    assert spark.sql("SELECT * FROM srcset('a 1x, b 2x')").count() == 2


def test_bodies_are_objects_for_a_megabyte_at_a_time(monkeypatch):
    """However many rows a batch has, what is found goes back to Arrow after each megabyte of bodies; rows and nulls keep their places."""
    import pyarrow as pa

    from pagelens.extract import columns

    held, made = [], columns._structs
    monkeypatch.setattr(columns, "_structs", lambda rows, kind: held.append(len(rows)) or made(rows, kind))
    texts = pa.array([None if i == 7 else f"{i:06d}" + "x" * 300_000 for i in range(20)])
    got = columns._each(lambda t: {"imports": [] if t is None else [t[:6]], "error": None}, columns.CSS, texts)
    assert max(held) <= 5 and sum(held) == 20
    assert [r["imports"] for r in got.to_pylist()] == [[] if i == 7 else [f"{i:06d}"] for i in range(20)]
    assert len(columns._each(lambda t: {}, columns.CSS, texts[:0])) == 0
