"""The extractors as columns, and registered for SQL.

`html_refs` and its kin return structs of arrays from vectorised functions. Explode their fields with `explode_outer` and
filter the nulls: an inner `explode` of a named column would run the function twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from pagelens.extract import css, html, jsonld, site_files, srcset
from pagelens.functions import binary as B
from pagelens.functions import text as T
from pagelens.functions import url as U

_TEXT, _TEXTS, _URLS = pa.string(), pa.list_(pa.string()), pa.list_(pa.struct({"url": pa.string(), "kind": pa.string()}))
HTML = pa.struct({
    "base": _TEXT, "images": pa.list_(pa.struct({"url": _TEXT, "kind": _TEXT, "context": _TEXT})), "links": _TEXTS, "stylesheets": _TEXTS, "manifests": _TEXTS, "browserconfigs": _TEXTS,
    "text_chars": pa.int64(), "mount_nodes": _TEXTS, "noscript_js": pa.bool_(), "error": _TEXT,
})
CSS = pa.struct({"images": _URLS, "imports": _TEXTS, "error": _TEXT})
SITEMAP = pa.struct({"sitemaps": _TEXTS, "pages": _TEXTS, "images": _TEXTS, "error": _TEXT})


def _guarded(kernel_fn: Callable, *args) -> dict:
    """What a kernel finds in one row, or its error: a body that cannot be read spoils no other row."""
    try:
        return kernel_fn(*args) | {"error": None}
    except Exception as e:
        return {"error": f"{type(e).__name__}: {e}"[:500]}


def _structs(rows: list[dict], kind: pa.StructType) -> pa.Array:
    """Rows as structs; lists that a row lacks are empty."""
    lists = [f.name for f in kind if pa.types.is_list(f.type)]
    for r in rows:
        for n in lists:
            if r.get(n) is None:
                r[n] = []
    return pa.array(rows, kind)


#: Characters or bytes of input whose Python objects, and those made of them, are held at a time.
_HELD = 1 << 20


def _each(kernel_fn: Callable, kind: pa.DataType, *arrays: pa.Array) -> pa.Array:
    """What a kernel makes of each row. A batch has up to ten thousand bodies: they become Python objects one by one, and what
    is found in them goes back to Arrow after each megabyte of them, so that a worker never holds a batch as objects."""
    made, rows, held = [], [], 0
    as_array = _structs if pa.types.is_struct(kind) else pa.array
    for scalars in zip(*arrays):
        values = [v.as_py() for v in scalars]
        rows.append(kernel_fn(*values))
        held += 1024 + sum(len(v) for v in values if v is not None)
        if held > _HELD:
            made.append(as_array(rows, kind))
            rows, held = [], 0
    return pa.concat_arrays([*made, as_array(rows, kind)])


def html_refs(body: Column, page_url: Column, options: html.Options = html.Options()) -> Column:
    """Everything that a document refers to, as one struct."""

    def one(text: str | None, url: str | None) -> dict:
        f = html.read(text or "", url or "", options)
        return vars(f) | {"images": [r._asdict() for r in f.images]}

    @F.arrow_udf(from_arrow_type(HTML))
    def run(bodies: pa.Array, urls: pa.Array) -> pa.Array:
        return _each(lambda t, u: _guarded(one, t, u), HTML, bodies, urls)

    return run(body, page_url)


def html_links(body: Column, page_url: Column) -> Column:
    """Where the anchors and frames of a document lead, by the same reader."""
    options = html.Options(frozenset(), css=False, jsonld=False)

    @F.arrow_udf("array<string>")
    def run(bodies: pa.Array, urls: pa.Array) -> pa.Array:
        return _each(lambda t, u: _guarded(lambda: {"links": html.read(t or "", u or "", options).links}).get("links"), _TEXTS, bodies, urls)

    return run(body, page_url)


def css_refs(text: Column, mode: str = "largest", prefix: str = "css") -> Column:
    def one(t: str | None) -> dict:
        sets, urls, imports = css.scan(t or "", mode)
        return {"images": [{"url": u, "kind": f"{prefix}:{k}"} for k, us in (("image-set", sets), ("url", urls)) for u in us], "imports": imports}

    @F.arrow_udf(from_arrow_type(CSS))
    def run(texts: pa.Array) -> pa.Array:
        return _each(lambda t: _guarded(one, t), CSS, texts)

    return run(text)


def sitemap_refs(body: Column) -> Column:
    """What a sitemap lists; `error` is set where it is damaged or unfolds to too much."""

    @F.arrow_udf(from_arrow_type(SITEMAP))
    def run(bodies: pa.Array) -> pa.Array:
        return _each(lambda b: _guarded(lambda: site_files.sitemap(b or b"")._asdict()), SITEMAP, bodies)

    return run(body)


def _values(kernel_fn: Callable, kind: pa.DataType = _TEXTS):
    """Null for null, and for what cannot be read."""

    @F.arrow_udf(from_arrow_type(kind))
    def run(values: pa.Array) -> pa.Array:
        return _each(lambda v: None if v is None else _guarded(lambda: {"value": kernel_fn(v)}).get("value"), kind, values)

    return run


def srcset_urls(value: Column, mode: str = "largest") -> Column:
    return _values(lambda v: srcset.choose(srcset.candidates(v), mode))(value)


def jsonld_refs(text: Column) -> Column:
    return _values(jsonld.jsonld_images)(text)


def manifest_refs(body: Column) -> Column:
    return _values(lambda b: [{"url": u, "kind": k} for u, k in site_files.manifest_images(b)], _URLS)(body)


def browserconfig_refs(body: Column) -> Column:
    return _values(site_files.browserconfig_images)(body)


def gunzip(body: Column) -> Column:
    """The body, unzipped if it is gzip; null where it unfolds to too much or is damaged."""
    return _values(site_files.unzipped, pa.binary())(body)


def decode(body: Column, content_type: Column) -> Column:
    """A body as text by its declared charset."""

    @F.arrow_udf("string")
    def run(bodies: pa.Array, types: pa.Array) -> pa.Array:
        read = lambda b, t: {"text": html.charset(b, t).encode("utf-8", "replace").decode()}
        return _each(lambda b, t: None if b is None else _guarded(read, b, t).get("text"), _TEXT, bodies, types)

    return run(body, content_type)


class _HtmlRefs:
    def eval(self, text: str, url: str):
        for r in _guarded(lambda: {"refs": list(html.refs(text, url))}).get("refs") or ():
            yield tuple(r)


class _CssRefs:
    def eval(self, text: str):
        yield from _guarded(lambda: {"refs": css.images(text or "")}).get("refs") or ()


class _Srcset:
    def eval(self, value: str):
        for c in srcset.candidates(value or ""):
            yield tuple(c)


class _Sitemap:
    def eval(self, body: bytes):
        found = _guarded(lambda: site_files.sitemap(bytes(body or b""))._asdict())
        for kind, name in (("sitemap", "sitemaps"), ("page", "pages"), ("image", "images")):
            for u in found.get(name) or ():
                yield kind, u


class _Jsonld:
    def eval(self, text: str):
        for u in _guarded(lambda: {"refs": jsonld.jsonld_images(text or "")}).get("refs") or ():
            yield (u,)


_OPERATOR = re.compile(r"'(?:[^'\\]|\\.)*'|(\b(?:and|or|not|in)|[=!<>+\-*/%&|^~]+)\(", re.S)


def sql_text(column: Column) -> str:
    """A column expression as SQL. It writes operators as functions, whose names are quoted for that."""
    return _OPERATOR.sub(lambda m: m[0] if m[1] is None else f"`{m[1]}`(", column._jc.node().sql())


#: The scalar functions of SQL: their parameters and what they stand for.
SCALARS = {
    "url_normalize": ("url STRING", "STRING", lambda: U.normalize(F.col("url"))), "url_resolve": ("base STRING, ref STRING", "STRING", lambda: U.resolve(F.col("base"), F.col("ref"))),
    "url_pattern": ("url STRING", "STRING", lambda: U.url_pattern(F.col("url"))), "url_host": ("url STRING", "STRING", lambda: U.host_of(F.col("url"))), "url_origin": ("url STRING", "STRING", lambda: U.origin_of(F.col("url"))),
    "url_filename": ("url STRING", "STRING", lambda: U.url_filename(F.col("url"))), "sniff_format": ("body BINARY", "STRING", lambda: B.sniff(F.col("body"))), "collapse_text": ("value STRING", "STRING", lambda: T.collapse(F.col("value"))),
}


def register(spark: SparkSession) -> None:
    """For SQL: the scalar functions of SCALARS, which are SQL themselves and stay in the JVM, and the table functions `html_refs`,
    `css_refs`, `srcset`, `sitemap_locs`, `jsonld_images`."""
    for name, (parameters, kind, made) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN ({sql_text(made())})")
    for name, cls, schema in (
        ("html_refs", _HtmlRefs, "url string, kind string, context string"),
        ("css_refs", _CssRefs, "url string, kind string"),
        ("srcset", _Srcset, "url string, width double, density double"),
        ("sitemap_locs", _Sitemap, "kind string, url string"),
        ("jsonld_images", _Jsonld, "url string"),
    ):
        spark.udtf.register(name, F.udtf(cls, returnType=schema))
