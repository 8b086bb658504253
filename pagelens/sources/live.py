"""Live acquisition: fetches URLs into rows of a snapshot. Off unless called; everything else works on captured data.

All URLs of a host go to one task, which has at most `concurrency.per_host` requests of it under way and starts them at the configured
rate; at most `concurrency.global` hosts run side by side. Nothing outside the scope is asked for. Redirects are not followed here: they become rows with a `location`, which the crawl follows hop by hop.
"""

from __future__ import annotations

import http.cookiejar
import json
import os
import random
import threading
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens import __version__
from pagelens.config import Config
from pagelens.functions import url as U
from pagelens.operators import policy
from pagelens.operators.politeness import BAD_STATUSES, RETRIED
from pagelens.schema import RESPONSE

#: What is asked for by kind of request.
ACCEPT = {"page": "text/html,application/xhtml+xml,*/*;q=0.8", "image": "image/avif,image/webp,image/*,*/*;q=0.8", "asset": "*/*"}


class _NoRedirects(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def user_agent(cfg: Config) -> str:
    contact = cfg.engagement.contact
    return cfg.http.user_agent or f"pagelens/{__version__}" + (f" (+{contact})" if contact else "")


def extra_headers(variable: str) -> dict[str, str]:
    """Headers from a JSON object in an environment variable."""
    data = json.loads(os.environ.get(variable) or "{}")
    if not isinstance(data, dict):
        raise ValueError(f"${variable} must hold a JSON object")
    return {str(k): str(v) for k, v in data.items()}


def load_cookies(path: str) -> http.cookiejar.CookieJar:
    """A Netscape cookie file, or a JSON list of `{name, value, domain, path?, secure?}`."""
    text = open(path).read()
    if text.lstrip()[:1] not in ("[", "{"):
        jar = http.cookiejar.MozillaCookieJar()
        jar.load(path, ignore_discard=True, ignore_expires=True)
        return jar
    data = json.loads(text)
    jar = http.cookiejar.CookieJar()
    for c in data if isinstance(data, list) else data.get("cookies", []):
        jar.set_cookie(
            http.cookiejar.Cookie(
                version=0, name=c["name"], value=c["value"], port=None, port_specified=False, domain=c["domain"], domain_specified=True, domain_initial_dot=c["domain"].startswith("."),
                path=c.get("path", "/"), path_specified=True, secure=bool(c.get("secure")), expires=None, discard=False, comment=None, comment_url=None, rest={},
            )
        )
    return jar


class Client:
    """One task's client: an opener and a pace for each host. Several threads may ask at a time."""

    def __init__(self, cfg: Config, kind: str, most_bytes: int):
        handlers: list = [_NoRedirects()]
        if cfg.auth.cookies_file:
            handlers.append(urllib.request.HTTPCookieProcessor(load_cookies(cfg.auth.cookies_file)))
        if cfg.http.proxy:
            handlers.append(urllib.request.ProxyHandler({"http": cfg.http.proxy, "https": cfg.http.proxy}))
        self.opener = urllib.request.build_opener(*handlers)
        self.headers = {"User-Agent": user_agent(cfg), "Accept": ACCEPT[kind]} | extra_headers(cfg.auth.headers_env)
        self.cfg, self.most = cfg, most_bytes
        self.next: dict[str, float] = {}
        self.every: dict[str, float] = {}
        self.streak: dict[str, int] = {}
        self.lock = threading.Lock()

    def _turn(self, host: str) -> None:
        """Takes the host's next turn and waits for it: turns are spaced, whoever takes them."""
        jitter = self.cfg.rate.jitter
        with self.lock:
            turn = max(time.monotonic(), self.next.get(host, 0.0))
            self.next[host] = turn + self.every.get(host, 1 / self.cfg.rate.per_host) * (1 + jitter * (2 * random.random() - 1))
        time.sleep(max(0.0, turn - time.monotonic()))

    def _note(self, host: str, status: int | None) -> None:
        with self.lock:
            self.streak[host] = self.streak.get(host, 0) + 1 if status in BAD_STATUSES else 0
            if self.streak[host] and self.streak[host] % 3 == 0:
                self.every[host] = min(60.0, 2 * self.every.get(host, 1 / self.cfg.rate.per_host))

    def get(self, host: str, url: str) -> dict:
        """A row of the snapshot; a null status is a transport error, a null body one that is too large."""
        row: dict = {"url": url, "status": None}
        for attempt in range(self.cfg.http.retries + 1):
            if self.streak.get(host, 0) >= self.cfg.http.max_bad_streak:
                break
            self._turn(host)
            wait = None
            try:
                r = self.opener.open(urllib.request.Request(url, headers=self.headers), timeout=self.cfg.http.timeout)
            except urllib.error.HTTPError as e:
                r = e
            except (OSError, ValueError):
                r = None
            if r is not None:
                with r:
                    try:
                        body = r.read(self.most + 1)
                    except OSError:
                        body = None
                head = {k.lower(): v for k, v in r.headers.items()}
                length = head.get("content-length", "")
                row |= {"status": r.status, "location": head.get("location"), "content_type": head.get("content-type"), "content_length": int(length) if length.isdigit() else None, "headers": head, "body": body if body is None or len(body) <= self.most else None}
                wait = float(head["retry-after"]) if head.get("retry-after", "").isdigit() else None
            self._note(host, row["status"])
            if row["status"] is not None and row["status"] not in RETRIED:
                break
            if attempt < self.cfg.http.retries:
                time.sleep(min(wait, 300.0) if wait is not None else min(30.0, 2.0 * 2**attempt) * (0.5 + random.random() / 2))
        return row


def _side_by_side(client: Client, host: str, urls: Iterable[str], at_once: int) -> Iterator[dict]:
    """Rows of one host's URLs in their order, with so many requests under way and no more rows held."""
    with ThreadPoolExecutor(at_once) as pool:
        under_way: deque = deque()
        for url in urls:
            under_way.append(pool.submit(client.get, host, url))
            if len(under_way) == at_once:
                yield under_way.popleft().result()
        while under_way:
            yield under_way.popleft().result()


def fetch(urls: DataFrame, cfg: Config, kind: str = "page", most_bytes: int | None = None) -> DataFrame:
    """Rows of a snapshot for `urls(url)` inside the scope. Write the result once: each evaluation asks again."""
    spark = urls.sparkSession
    most = most_bytes or (cfg.limits.max_file_bytes if kind == "image" else cfg.limits.max_page_bytes)
    names = [f.name for f in spark.createDataFrame([], RESPONSE).schema]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = Client(cfg, kind, most)
        for t in batches:
            for host, asked in groupby(zip(t.host, t.url), lambda pair: pair[0]):
                for row in _side_by_side(client, host, (url for _, url in asked), cfg.concurrency.per_host):
                    row |= {"fetched_at": pd.Timestamp.now("UTC").tz_localize(None)}
                    yield pd.DataFrame({n: pd.Series([row.get(n)], dtype=object if n != "fetched_at" else None) for n in names})

    inside = urls.select(U.normalize(F.col("url")).alias("url")).filter(F.col("url").isNotNull() & policy.asset_reason(F.col("url"), cfg.scope).isNull()).distinct()
    by_host = inside.withColumn("host", U.host_of(F.col("url"))).repartition(cfg.concurrency.global_, "host").sortWithinPartitions("host", "url")
    return by_host.mapInPandas(run, RESPONSE)
