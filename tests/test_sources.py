import json
import logging
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from pagelens import logs
from pagelens.__main__ import main
from pagelens.config import Config, build
from pagelens.schema import RESPONSE
from pagelens.sources import live, readers
from pagelens.streaming import discover


def test_lists_and_json(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# note\n\nhttps://e.com/a.png\n  https://e.com/b.png \n")
    assert [r.url for r in readers.url_list(spark, f"file://{tmp_path}/urls.txt").collect()] == ["https://e.com/a.png", "https://e.com/b.png"]
    body = r'{"a":"https:\/\/e.com\/x.png?w=1","b":"no image","c":"/y.webp","d":"x y.png"}'
    assert spark.range(1).select(readers.json_images(F.lit(body))).first()[0] == ["https://e.com/x.png?w=1", "/y.webp"]
    r = spark.range(1).select(readers.capped_body(F.lit(b"abc"), F.lit(None).cast("long"), 2).alias("a"), readers.capped_body(F.lit(b"ab"), F.lit(2), 2).alias("b")).first()
    assert (r.a.body, r.a.error, bytes(r.b.body), r.b.error) == (None, "BodyTooLarge", b"ab", None)


def test_files_as_responses(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/p.html").write_text("<img src=a.png>")
    (tmp_path / "big.bin").write_bytes(b"x" * 5000)
    rows = readers.responses_from_files(spark, f"file://{tmp_path}", "https://e.com", 1000).collect()
    assert [(r.url, r.content_type, r.status) for r in rows] == [("https://e.com/d/p.html", "text/html", 200)]


def test_archive_in_both_modes(spark):
    cdx = readers.cdx_rows(spark.createDataFrame([('[["timestamp","original","mimetype"],["1","e.com/a.png","image/png"],["2","e.com:80/a.png","image/png"],["3","ftp://x","image/png"]]',), ("[]",)], "json string"))
    cfg = build(Config, {"scope": {"pages": {"hosts": ["e.com"]}}})
    rows = sorted(readers.queue_archive(cdx, cfg, "E.com").collect(), key=lambda r: r.pos)
    assert [(r.url, r.outcome, r.context) for r in rows] == [("http://e.com/a.png", "added", "1 e.com"), ("http://e.com/a.png", "skipped", "2 e.com"), (None, "skipped", "3 e.com")]
    cfg.wayback.mode = "archive"
    rows = sorted(readers.queue_archive(cdx, cfg, "e.com").collect(), key=lambda r: r.pos)
    assert rows[0].url == "https://web.archive.org/web/1id_/http://e.com/a.png" and rows[0].source == "wayback-archive"


class _Site(BaseHTTPRequestHandler):
    tries = 0

    def do_GET(self):
        if self.path == "/busy":
            type(self).tries += 1
        status = 503 if self.path == "/busy" and self.tries < 2 else 302 if self.path == "/moved" else 200
        body = b"x" * 50 if self.path == "/big" else b"hello"
        self.send_response(status)
        for k, v in (("Content-Type", "text/plain"), ("Content-Length", str(len(body))), *([("Location", "/busy")] if status == 302 else []), *([("Retry-After", "0")] if status == 503 else [])):
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_live(spark, tmp_path, monkeypatch):
    server = HTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    cfg = build(Config, {"seeds": [base + "/"], "rate": {"per_host": 1000.0}, "http": {"timeout": 5.0, "retries": 2}}).settle()
    urls = spark.createDataFrame([(base + p,) for p in ("/busy", "/moved", "/big")] + [("http://evil.test/x",)], "url string")
    got = {r.url: r for r in live.fetch(urls, cfg, most_bytes=20).collect()}
    server.shutdown()
    assert set(got) == {base + p for p in ("/busy", "/moved", "/big")}
    assert (got[base + "/busy"].status, bytes(got[base + "/busy"].body)) == (200, b"hello")
    assert (got[base + "/moved"].status, got[base + "/moved"].location) == (302, "/busy") and got[base + "/big"].body is None and got[base + "/big"].content_length == 50
    (tmp_path / "c.json").write_text('[{"name":"a","value":"b","domain":".e.com"}]')
    assert [c.name for c in live.load_cookies(str(tmp_path / "c.json"))] == ["a"]
    monkeypatch.setenv("H", '{"X-A": 1}')
    assert live.extra_headers("H") == {"X-A": "1"} and live.extra_headers("NONE") == {}
    monkeypatch.setenv("H", "[]")
    with pytest.raises(ValueError):
        live.extra_headers("H")


@pytest.mark.parametrize("at_once", [1, 3])
def test_requests_of_a_host_side_by_side(at_once):
    """So many are under way at a time, rows come in order, and starts keep the pace of the host."""
    lock, now, most, starts = threading.Lock(), [0], [0], []

    class Slow(BaseHTTPRequestHandler):
        def do_GET(self):
            with lock:
                starts.append(time.monotonic())
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.15)
            with lock:
                now[0] -= 1
            self.send_response(200)
            self.end_headers()
            self.wfile.write(self.path.encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Slow)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    cfg = build(Config, {"seeds": [base + "/"], "rate": {"per_host": 50.0, "jitter": 0.0}, "http": {"timeout": 5.0}}).settle()
    rows = list(live._side_by_side(live.Client(cfg, "page", 100), "127.0.0.1", [f"{base}/{i}" for i in range(9)], at_once))
    server.shutdown()
    assert [bytes(r["body"]) for r in rows] == [f"/{i}".encode() for i in range(9)] and most[0] == at_once
    assert starts[-1] - starts[0] >= 8 * 0.02 - 0.015


def test_stream_matches_batch_and_repeats_add_nothing(spark, tmp_path):
    rows = [(f"https://e.com/{i}", 200, None, "text/html", None, None, bytearray(f'<img src="/{i % 3}.png"><img src="https://evil.com/x.png">'.encode()), None, None, None, None) for i in range(6)]
    df = spark.createDataFrame(rows, RESPONSE)
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    df.filter("url < 'https://e.com/3'").write.parquet(src)
    scope = build(Config, {"seeds": ["https://e.com/"]}).settle().scope
    for _ in range(2):
        discover.run_available(discover.image_refs(discover.responses(spark, src), scope), out, f"file://{tmp_path}/cp")
    df.filter("url >= 'https://e.com/3'").write.mode("append").parquet(src)
    discover.run_available(discover.image_refs(discover.responses(spark, src), scope), out, f"file://{tmp_path}/cp")
    got = sorted((r.url, r.skip_reason) for r in spark.read.parquet(out).collect())
    assert got == sorted({(r.url, r.skip_reason) for r in discover.image_refs(df, scope).collect()}) and len(got) == 4


def test_line_sources(spark, tmp_path):
    """Any ranges give every line once; filters are applied while reading; a stream goes on where files have grown."""
    from pagelens.sources import lines

    lines.register(spark)
    (tmp_path / "l").mkdir()
    urls = [f"https://a.test/{'x' * (i % 40)}{i}" for i in range(300)]
    (tmp_path / "l" / "a.txt").write_text("\n".join(f"{u}\n#{u}\n" for u in urls[:200]))
    (tmp_path / "l" / "b.txt").write_text("\r\n".join(urls[200:]) + "\n")
    (tmp_path / "l" / "c.txt").write_text("")
    for n in (1, 7, 64, 1 << 20):
        assert sorted(r.url for r in spark.read.format("urls").option("path", f"file://{tmp_path}/l").option("bytes", max(n, 500 if n < 64 else n)).load().collect()) == sorted(urls)
    own = lines._Files(f"file://{tmp_path}/l")
    for path, size in own.sizes().items():
        for n in (1, 2, 3, 50):
            cut = [x for a in range(0, size, n) for x in own.lines(path, a, min(a + n, size))]
            assert cut == list(own.lines(path, 0, size))
    rows = [["urlkey", "timestamp", "original", "mimetype"], ["k", "2020", "a.test/1.png", "image/png"], ["k", "2021", "a.test/2", "text/html"], ["k"], ["k", None, "a.test/3.png", "image/png"]]
    (tmp_path / "i.json").write_text("[" + ",\n".join(map(json.dumps, rows)) + "]\n")
    (tmp_path / "j.json").write_text(json.dumps([rows[0]]) + "\nnonsense\n")
    read = lambda name: spark.read.format("cdx").option("path", f"file://{tmp_path}/{name}").load()
    assert [(r.original, r.timestamp, r.mimetype) for r in read("i.json").orderBy("pos").collect()] == [("a.test/1.png", "2020", "image/png"), ("a.test/2", "2021", "text/html"), (None, None, None), ("a.test/3.png", None, "image/png")]
    assert read("j.json").collect() == []
    got = read("i.json").filter("mimetype = 'image/png' and original like '%3.png' and pos > 0")
    assert [r.original for r in got.collect()] == ["a.test/3.png"]
    stream = lambda: spark.readStream.format("urls").option("path", f"file://{tmp_path}/l").load().writeStream.format("parquet").option("path", f"file://{tmp_path}/got").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    stream()
    first = spark.read.parquet(f"file://{tmp_path}/got").count()
    with (tmp_path / "l" / "b.txt").open("a") as f:
        f.write("https://a.test/new\nhttps://a.test/half")
    (tmp_path / "l" / "d.txt").write_text("https://a.test/d\n")
    stream()
    after = sorted(r.url for r in spark.read.parquet(f"file://{tmp_path}/got").collect())
    assert len(after) == first + 2 and {"https://a.test/new", "https://a.test/d"} <= set(after) and len(set(after)) == len(after)


def test_streamed_streaks(spark, tmp_path):
    """Three micro-batches of the events, one of them late for its neighbours, give what the batch form gives."""
    from pagelens.operators import politeness

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    log = events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("host"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").cast("long").alias("seq"), F.when(F.col("event_type") == "error", 429).otherwise(200).alias("status"))
    ends = log.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    third = (ends.b - ends.a) / 3
    late = F.col("seq") % 50 == 0
    part = F.when((F.col("at") < ends.a + third) & ~late, 0).when(F.col("at") < ends.a + 2 * third, 1).otherwise(2)
    last = spark.createDataFrame([("end", ends.b + third * 4, -1, 200)], log.schema)
    for k in range(3):
        log.filter(part == k).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/log")
        time.sleep(1.1)  # files are taken in the order of their times
    last.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/log")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/log").withWatermark("at", f"{int(third.total_seconds() * 2)} seconds")
        q = discover.host_streaks(stream, 4, slot=3600.0).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp").start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").select("host", "seq", "streak", "interval", "blocked").collect())
    want = politeness.bad_streaks(log, "host", ["at", "seq"], F.col("status") == 429, 1.0, 4).select("host", "seq", F.col("streak").cast("int"), "interval", "blocked").collect()
    assert got == sorted(tuple(r) for r in want) and len(got) > 500


def test_commands(spark, tmp_path, capsys):
    assert main(["init", str(tmp_path / "c.toml")]) == 0 and main(["init", str(tmp_path / "c.toml")]) == 1
    assert main(["status", f"file://{tmp_path}/none"]) == 1
    log = logs.setup(str(tmp_path / "log"))
    log.info("started", extra={"data": {"url": "u"}})
    logging.shutdown()
    row = json.loads((tmp_path / "log").read_text())
    assert (row["event"], row["url"], row["level"]) == ("started", "u", "info")
