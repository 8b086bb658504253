"""A small site from end to end: what is saved, what is not and why, and that a run broken off and resumed ends the same."""

import json

import pytest
from pyspark.sql import functions as F

from pagelens import export
from pagelens.config import Config, ConfigError, build
from pagelens.schema import RESPONSE
from pagelens.session import Session

PNG = b"\x89PNG\r\n\x1a\n"


def image(name: str, size: int = 3000) -> bytes:
    return (PNG + name.encode()).ljust(size, b"x")


def site() -> dict[str, tuple]:
    """URL: (status, content type, body, location)"""
    s: dict[str, tuple] = {}

    def add(url, body, kind="text/html", status=200, location=None):
        s[url] = (status, kind, body if isinstance(body, bytes) else body.encode(), location)

    w = "https://site.test"
    add(w + "/robots.txt", "User-agent: *\nDisallow: /private\nSitemap: https://site.test/map.xml\n", "text/plain")
    add(w + "/map.xml", f"<urlset><url><loc>{w}/from-map</loc></url></urlset>", "application/xml")
    add(w + "/from-map", '<img src="/map.png">')
    add(
        w + "/",
        '<link rel="stylesheet" href="/m.css"><img src="/a.png"><img src="https://cdn.test/b.png"><img src="https://evil.test/c.png"><img src="/tiny.png"><img src="/gone.png">'
        '<img src="/copy.png"><img src="/not.png"><a href="/two">2</a><a href="/private/x">p</a><a href="/moved">m</a><a href="/out">o</a><a href="/direct">d</a><a href="/cal/1">c</a><img src="data:image/png;base64,iVBORw0KGgo=">',
    )
    add(w + "/two", '<a href="/">home</a><img src="/a.png" alt="again">')
    add(w + "/m.css", ".a{background:url(css.png)}", "text/css")
    add(w + "/moved", "", status=302, location="/landed")
    add(w + "/landed", '<img src="/landed.png">')
    add(w + "/out", "", status=302, location="https://evil.test/")
    add(w + "/direct", image("direct"), "image/png")
    for i in range(1, 6):
        add(f"{w}/cal/{i}", f'<a href="/cal/{i + 1}">next</a>')
    for n in ("a", "map", "css", "landed"):
        add(f"{w}/{n}.png", image(n), "image/png")
    add(w + "/copy.png", image("a"), "image/png")
    add("https://cdn.test/b.png", image("b"), "image/png")
    add(w + "/tiny.png", image("t", 100), "image/png")
    add(w + "/not.png", b"<html>no</html>".ljust(5000), "image/png")
    return s


def snapshot(spark):
    rows = [(u, st, loc, ct, None, None, bytearray(b), None, None, None, None) for u, (st, ct, b, loc) in site().items()]
    return spark.createDataFrame(rows, RESPONSE).cache()


def config(out) -> Config:
    return build(Config, {"seeds": ["https://site.test/"], "out": f"file://{out}", "scope": {"images": {"hosts": ["cdn.test"]}}, "limits": {"max_pages_per_pattern": 3}, "render": {"mode": "never"}}).settle()


def outcome(store):
    images = {r.url: (r.state, r.skip_reason or r.error, r.sha256) for r in store.table("image_url").collect()}
    pages = {r.url: (r.state, r.skip_reason or r.error) for r in store.table("page").collect()}
    return pages, images


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("whole")
    s = Session(spark, config(out))
    return s, s.crawl(snapshot(spark), friendly=True), out


def test_what_is_saved_and_what_is_not(finished):
    s, (status, code), out = finished
    pages, images = outcome(s.store)
    w = "https://site.test/"
    assert status == "finished" and code == 0
    saved = {u for u, (state, _, _) in images.items() if state == "done"}
    assert saved == {w + n for n in ("a.png", "copy.png", "css.png", "landed.png", "map.png", "direct")} | {"https://cdn.test/b.png"}
    assert images[w + "a.png"][2] == images[w + "copy.png"][2] and s.store.table("file").count() == 6
    assert images["https://evil.test/c.png"][:2] == ("skipped", "scope") and images[w + "tiny.png"][:2] == ("skipped", "filter_size") and images[w + "not.png"][:2] == ("skipped", "not_image")
    assert images[w + "gone.png"][:2] == ("failed", "no response")
    assert [u for u in images if u.startswith("data:")] and all(images[u][:2] == ("skipped", "filter_size") for u in images if u.startswith("data:"))
    assert pages[w + "private/x"] == ("skipped", "robots") and pages[w + "out"] == ("skipped", "scope:redirect") and pages[w + "landed"] == ("skipped", "duplicate:redirect")
    assert sorted(pages[f"{w}cal/{i}"][0] for i in range(1, 5)) == ["done", "done", "done", "skipped"] and pages[w + "cal/4"][1] == "pattern_limit"
    for r in s.store.table("file").collect():
        assert (out / r.path).stat().st_size == r.bytes
    assert not [u for u in pages if "evil" in u]


def test_exports_and_status(spark, finished):
    s, _, out = finished
    rows = spark.read.csv(f"file://{out}/manifest.csv", header=True).collect()
    assert {(r.image_url, r.page_url) for r in rows} >= {("https://site.test/a.png", "https://site.test/"), ("https://site.test/a.png", "https://site.test/two")}
    document = json.loads("".join(p.read_text() for p in sorted((out / "manifest.json").glob("part-*"))))
    docs = document["files"]
    assert document["target"] == ["https://site.test/"] and document["status"] == "finished" and len(docs) == 6 and sum(len(d["urls"]) for d in docs) == 7
    t = s.store.tables()
    want = {r.file: r.asDict(recursive=True) for r in export.nested(export.manifest(t["page"], t["image_url"], t["file"], t["occurrence"])).collect()}
    assert {d["file"]: sorted((u["url"], sorted(map(str, u["referenced_by"]))) for u in d["urls"]) for d in docs} == {f: sorted((u["url"], sorted(map(str, u["referenced_by"]))) for u in d["urls"]) for f, d in want.items()}
    assert spark.read.csv(f"file://{out}/urls.csv", header=True).count() == s.store.table("image_url").count()
    st = s.status()
    n = st["statistics"]
    assert (n["pages_failed"], n["images_saved"], n["images_duplicate"], n["images_failed"], n["pages_queued"]) == (0, 6, 1, 1, 0) and n["bytes_saved"] == 18000
    assert st["images"]["done"] == 7 and st["files"]["files"] == 6 and st["top_hosts"][0][0] == "site.test" and ("https://site.test/gone.png", "no response") in st["errors"]
    assert (out / "friendly/site.test/a.png").exists() and (out / "friendly/site.test/direct.png").exists()


def test_broken_off_and_resumed_is_the_same(spark, finished, tmp_path):
    s = Session(spark, config(tmp_path / "r"))
    asked = iter([False, True, True])
    assert s.crawl(snapshot(spark), stop=lambda: next(asked)) == ("interrupted", 130) and s.status()["statistics"]["pages"] == 0
    assert s.crawl(snapshot(spark), max_rounds=2)[0] == "interrupted"
    assert s.crawl(snapshot(spark))[0] == "finished"
    assert outcome(s.store) == outcome(finished[0].store)
    with pytest.raises(ConfigError, match="another scope"):
        other = config(tmp_path / "r")
        other.scope.pages.exclude = ["/x*"]
        Session(spark, other).crawl(snapshot(spark))
    assert "_state" in s.purge() and not (tmp_path / "r").exists()


def test_lists_and_archive(spark, tmp_path):
    s = Session(spark, config(tmp_path / "l"))
    s.crawl(snapshot(spark), images_only=spark.createDataFrame([("https://site.test/a.png",), ("nonsense",)], "url string"))
    assert [r.url for r in s.store.table("image_url").collect()] == ["https://site.test/a.png"] and s.store.table("file").count() == 1
    from pagelens.sources import readers

    cdx = readers.cdx_rows(spark.createDataFrame([('[["original","timestamp","mimetype"],["site.test/a.png","2020","image/png"],["http://cdn.test/b.png","2021","image/png"],["http://evil.test/c.png","2021","image/png"]]',)], "json string"))
    assert s.queue_archive(cdx, "site.test") == (2, 1)


def test_manifests_as_one_file_each(spark, finished):
    """The files say what the folders say, and each form takes the place of the other."""
    s, _, out = finished

    def said():
        table = [sorted(map(str, spark.read.csv(f"file://{out}/{n}", header=True).collect())) for n in ("manifest.csv", "urls.csv")]
        parts = [out / "manifest.json"] if (out / "manifest.json").is_file() else sorted((out / "manifest.json").glob("part-*"))
        return *table, json.loads("".join(p.read_text() for p in parts))

    s.export()
    folders = said()
    for _ in range(2):
        s.export(one_file=True)
        assert all((out / n).is_file() for n in ("manifest.csv", "manifest.json", "urls.csv")) and said() == folders
    assert not [p for p in out.iterdir() if p.name.startswith(".")]
    s.export()
    assert (out / "manifest.json").is_dir() and said() == folders
