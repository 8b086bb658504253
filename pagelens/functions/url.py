"""URL algebra as column expressions.

Every function takes and returns columns and needs no Python worker. `normalize` gives the canonical form that is used as
key: lower-case scheme and host (IDNA), no default port, user or fragment, dot segments resolved, unsafe characters
percent-encoded, the query as it is. What is no http(s) URL becomes null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions.glob import matches_any

#: File extensions of images, and of files that are no pages.
IMAGE_EXTENSIONS = "jpg jpeg jfif pjpeg png apng gif webp avif svg svgz ico cur bmp tif tiff heic heif jxl".split()
OTHER_EXTENSIONS = (
    "pdf zip gz tgz rar 7z tar dmg exe msi apk iso doc docx xls xlsx ppt pptx odt ods csv rtf "
    "mp3 mp4 m4a m4v mov avi mkv webm wav ogg flac woff woff2 ttf otf eot js mjs css json map wasm"
).split()
#: Characters that stay as they are in a path; in a query `?` does too. Letters, digits and `_.-~` always stay.
SAFE_PATH = "/%:@!$&'()*+,;=~-._"
#: References that lead to no resource.
NO_RESOURCE = ("#", "javascript:", "mailto:", "tel:", "data:", "blob:", "about:")

_IMAGE = r"(?i)\.(?:" + "|".join(IMAGE_EXTENSIONS) + ")$"
_NON_PAGE = r"(?i)\.(?:" + "|".join(IMAGE_EXTENSIONS + OTHER_EXTENSIONS) + ")$"
#: scheme, authority with slashes, authority, path, query with mark, query
_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(?:#.*)?$"
#: Plain ASCII forms that normalize() and resolve() leave as they are: no port, no dot segment, nothing to encode, no empty query.
_SAFE_CLASS = "A-Za-z0-9" + "".join("\\" + c for c in SAFE_PATH)
_NO_DOTS = r"(?![^?]*/\.{1,2}(?:/|\?|\z))"
_NORMAL_PATH = rf"^https?://[a-z0-9-]+(?:\.[a-z0-9-]+)*{_NO_DOTS}/[{_SAFE_CLASS}]*\z"
_NORMAL = rf"{_NORMAL_PATH[:-2]}(?:\?[{_SAFE_CLASS}?]+)?\z"
_PLAIN_PATH = rf"^{_NO_DOTS}/(?!/)[{_SAFE_CLASS}]*\z"
_PLAIN_REF = rf"{_PLAIN_PATH[:-2]}(?:\?[{_SAFE_CLASS}?]+)?\z"
#: Path parts that are tokens.
TOKEN = r"^[0-9a-f-]{16,}$|^[A-Za-z0-9_-]{24,}$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once, however often `use` mentions it; the expression stays small."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def _part(col: Column, group: int) -> Column:
    return F.regexp_extract(col, _SPLIT, group)


def _char_class(safe: str) -> str:
    return "A-Za-z0-9" + "".join("\\" + c for c in sorted(set(safe + "_.-~")))


def percent_encode(value: Column, safe: str) -> Column:
    """UTF-8 percent-encoding of all characters outside `safe`. Values that are safe already are left alone."""
    keep = _char_class(safe)

    def encode(col: Column) -> Column:
        coded = F.transform(
            F.regexp_extract_all(col, F.lit("(?s)."), F.lit(0)),
            lambda c: F.when(c.rlike(f"^[{keep}]$"), c).otherwise(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))),
        )
        return F.when(col.rlike(f"^[{keep}]*$"), col).otherwise(F.array_join(coded, ""))

    return let(value, encode)


def percent_decode(col: Column) -> Column:
    """Percent-decoding that leaves plus signs; what cannot be decoded stays."""
    return F.coalesce(F.try_url_decode(F.replace(col, F.lit("+"), F.lit("%2B"))), col)


def clean(col: Column) -> Column:
    """Without white space at the ends and without tabs and line ends inside."""
    return F.regexp_replace(F.regexp_replace(col, r"^[\s\x00-\x20]+|\s+$", ""), r"[\t\n\r]", "")


def remove_dot_segments(value: Column) -> Column:
    """`.` and `..` resolved; the root stays, double slashes stay, and a final dot segment leaves a slash."""

    def walk(steps: Column) -> Column:
        return F.aggregate(
            steps,
            F.slice(steps, 1, 0),
            lambda acc, s: F.when(s == ".", acc)
            .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
            .otherwise(F.concat(acc, F.array(s))),
        )

    def straight(path: Column) -> Column:
        ends = F.when(path.rlike(r"(^|/)\.{1,2}$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        joined = F.array_join(F.concat(let(F.split(path, "/"), walk), ends), "/")
        return F.when(path.contains("."), F.regexp_replace(joined, "^(?!/)", "/")).otherwise(path)

    return let(value, straight)


def strip_query(query: Column, globs: Iterable[str]) -> Column:
    """A query without empty parts and without those whose decoded key matches a glob."""
    globs = list(globs)
    if not globs:
        return query

    def stays(part: Column) -> Column:
        key = F.substring_index(part, "=", 1)
        return (part != "") & ~matches_any(F.coalesce(F.try_url_decode(key), key), globs)

    return F.array_join(F.filter(F.split(query, "&"), stays), "&")


def normalize(url: Column, strip_params: Iterable[str] = ()) -> Column:
    strip_params = tuple(strip_params)

    def split(u: Column) -> Column:
        return F.struct(F.lower(_part(u, 1)).alias("scheme"), F.regexp_replace(_part(u, 3), r"^.*@", "").alias("where"), _part(u, 4).alias("path"), _part(u, 6).alias("query"))

    def site(p: Column) -> Column:
        """The parts with host and port apart; an IPv6 host keeps its brackets."""
        host = F.lower(F.regexp_extract(p.where, r"^(\[[^\]]*\]|[^:]*)", 1))
        port = F.regexp_extract(p.where, r"^(?:\[[^\]]*\]|[^:\[]*):(.*)$", 1)
        return F.struct(p.scheme.alias("scheme"), host.alias("host"), port.alias("port"), F.when(port.rlike(r"^[0-9]{1,9}$"), port.cast("int")).alias("number"), p.path.alias("path"), p.query.alias("query"))

    def build(p: Column) -> Column:
        host = F.when(p.host.rlike(r"^[\x00-\x7F]*$"), p.host).otherwise(_idna(p.host))
        plain = (p.port == "") | (p.number == F.when(p.scheme == "http", 80).otherwise(443))
        path = percent_encode(remove_dot_segments(F.when(p.path == "", "/").otherwise(p.path)), SAFE_PATH)
        query = percent_encode(strip_query(p.query, strip_params), SAFE_PATH + "?=&")
        whole = F.concat(p.scheme, F.lit("://"), host, F.when(plain, "").otherwise(F.concat(F.lit(":"), p.number.cast("string"))), path, let(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))
        valid = p.scheme.isin("http", "https") & ~p.host.isin("", "[]") & ~p.host.rlike(r"^[^\[].*[\[\]]|^\[.*[^\]]$|^\[$") & ((p.port == "") | p.number.between(0, 65535))
        return F.when(valid, whole)

    normal = url.rlike(_NORMAL_PATH if strip_params else _NORMAL)
    return F.when(normal, url).otherwise(let(clean(url), lambda u: let(split(u), lambda p: let(site(p), build))))


def _idna(host: Column) -> Column:
    """IDNA 2003 by the JVM's own library; null for hosts it rejects."""
    return F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host)


def resolve(base: Column, ref: Column, strip_params: Iterable[str] = ()) -> Column:
    """A reference made absolute against a normalised base, in canonical form; null where it leads to no resource."""

    def split(r: Column, b: Column) -> Column:
        return F.struct(
            r.alias("ref"), _part(r, 1).alias("scheme"), _part(r, 2).alias("site"), _part(r, 4).alias("path"), _part(r, 5).alias("mark"),
            origin_of(b).alias("origin"), _part(b, 4).alias("base_path"), _part(b, 5).alias("base_mark"),
        )

    def join(p: Column) -> Column:
        merged = F.regexp_replace(F.concat(F.regexp_replace(p.base_path, r"[^/]*$", ""), p.path), r"(?<=.)/{2,}(?=.)", "/")
        nowhere = p.ref.rlike("^(?:$|" + "|".join(NO_RESOURCE) + ")")
        joined = (
            F.when(p.scheme != "", p.ref)
            .when(p.site != "", F.concat(F.substring_index(p.origin, ":", 1), F.lit(":"), p.ref))
            .when(p.path.startswith("/"), F.concat(p.origin, p.path, p.mark))
            .when(p.path == "", F.concat(p.origin, p.base_path, F.when(p.mark != "", p.mark).otherwise(p.base_mark)))
            .otherwise(F.concat(p.origin, merged, p.mark))
        )
        return F.when(~nowhere, joined)

    pair = F.struct(clean(ref).alias("r"), base.alias("b"))
    whole = let(let(pair, lambda x: let(split(x.r, x.b), join)), lambda j: normalize(j, strip_params))
    plain = base.rlike(_NORMAL) & ref.rlike(_PLAIN_PATH if strip_params else _PLAIN_REF)
    return F.when(plain, F.concat(F.regexp_extract(base, "^[a-z]+://[^/]+", 0), ref)).otherwise(whole)


def host_of(url: Column) -> Column:
    """The lower-case host, or an empty string."""
    return F.lower(F.regexp_extract(F.regexp_replace(_part(url, 3), r"^.*@", ""), r"^\[?((?<=\[)[^\]]*|(?<!\[)[^:]*)", 1))


def origin_of(url: Column) -> Column:
    return F.concat(_part(url, 1), F.lit("://"), _part(url, 3))


def path_of(url: Column) -> Column:
    return _part(url, 4)


def path_and_query(url: Column) -> Column:
    path, query = _part(url, 4), _part(url, 6)
    return F.concat(F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def looks_like_image(url: Column) -> Column:
    return path_of(url).rlike(_IMAGE)


def looks_like_non_page(url: Column) -> Column:
    return path_of(url).rlike(_NON_PAGE)


def url_filename(url: Column) -> Column:
    """The decoded last part of the path, at most 255 characters."""
    return F.substring(percent_decode(F.substring_index(path_of(url), "/", -1)), 1, 255)


def url_pattern(url: Column) -> Column:
    """A coarse shape: token-like path parts as X, runs of digits as N, and the sorted names of query parameters."""
    parts = F.transform(F.split(path_of(url), "/"), lambda s: F.when(s.rlike(TOKEN), "X").otherwise(F.regexp_replace(s, r"\d+", "N")))
    query = _part(url, 6)
    keys = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.substring_index(p, "=", 1))
    names = F.array_join(F.array_sort(F.array_distinct(keys)), "&")
    return F.concat(host_of(url), F.array_join(parts, "/"), F.when(query != "", F.concat(F.lit("?"), names)).otherwise(""))


def host_dir(host: Column, port: Column | None = None) -> Column:
    """A folder name for a host, with its port behind where there is one."""
    name = F.regexp_replace(F.regexp_replace(F.lower(host), "[^a-z0-9.-]", "_"), r"^\.+|\.+$", "")
    return name if port is None else F.concat(name, F.when(port.isNotNull(), F.concat(F.lit("_"), port.cast("string"))).otherwise(""))


def disposition_filename(header: Column) -> Column:
    """The file name that a Content-Disposition header gives, or an empty string."""
    return F.trim(F.regexp_extract(header, r"""(?i)filename\*?=(?:UTF-8'')?"?([^";]+)"?""", 1))
