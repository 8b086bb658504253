"""URL algebra for single values, for the extractors that run inside Python workers. It agrees with functions/url.py."""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import quote, unquote_plus

from pagelens.functions import binary
from pagelens.functions.glob import match_any
from pagelens.functions.url import IMAGE_EXTENSIONS, NO_RESOURCE, OTHER_EXTENSIONS, SAFE_PATH, TOKEN

_PARTS = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?", re.S)
_WHERE = re.compile(r"(?:\[(?P<six>[^\]]*)\]|(?P<name>[^:]*))(?::(?P<port>.*))?", re.S)
_IMAGE = re.compile(r"\.(?:%s)$" % "|".join(IMAGE_EXTENSIONS), re.I)
_OTHER = re.compile(r"\.(?:%s)$" % "|".join(OTHER_EXTENSIONS), re.I)
_DROP = str.maketrans("", "", "\t\n\r")
_PORT = re.compile("[0-9]{1,9}")
_TOKEN, _DIGITS = re.compile(TOKEN), re.compile("[0-9]+")
#: First bytes that tell a format.
_HEADS = (
    (b"\xff\xd8\xff", "jpeg"), (b"\x89PNG\r\n\x1a\n", "png"), (b"GIF87a", "gif"), (b"GIF89a", "gif"), (b"II*\0", "tiff"), (b"MM\0*", "tiff"), (b"\xff\x0a", "jxl"), (b"\0\0\0\x0cJXL \r\n\x87\n", "jxl"),
)
_PORTS = {"http": "80", "https": "443"}


def parts(url: str) -> tuple[str, str | None, str, str | None]:
    """scheme, authority, path and query; authority and query are None where they are absent."""
    scheme, where, path, query = _PARTS.fullmatch(url).groups()
    return (scheme or "").lower(), where, path, query


def clean(url: str) -> str:
    return url.strip().lstrip("".join(map(chr, range(33)))).translate(_DROP)


def _site(scheme: str, where: str) -> str | None:
    m = _WHERE.fullmatch(where.rpartition("@")[2])
    if m is None:
        return None
    host = (m["six"] if m["six"] is not None else m["name"]).lower()
    port = m["port"] or ""
    if not host or (m["six"] is None and ("[" in host or "]" in host)) or (port and not (_PORT.fullmatch(port) and int(port) < 65536)):
        return None
    try:
        host = host if host.isascii() else host.encode("idna").decode()
    except UnicodeError:
        return None
    host = f"[{host}]" if m["six"] is not None else host
    return host if not port or str(int(port)) == _PORTS[scheme] else f"{host}:{int(port)}"


def straighten(path: str) -> str:
    """Dot segments resolved."""
    if "." not in path:
        return path
    out: list[str] = []
    steps = path.split("/")
    for s in steps:
        if s == "..":
            del out[max(1, len(out) - 1) :]  # the root stays
        elif s != ".":
            out.append(s)
    if steps[-1] in (".", ".."):
        out.append("")
    joined = "/".join(out)
    return joined if joined[:1] == "/" else "/" + joined


def _build(scheme: str, where: str | None, path: str, query: str | None, strip: tuple[str, ...]) -> str | None:
    if scheme not in _PORTS or where is None or (site := _site(scheme, where)) is None:
        return None
    if query and strip:
        query = "&".join(p for p in query.split("&") if p and not match_any(unquote_plus(p.partition("=")[0]), strip))
    path = quote(straighten(path or "/"), safe=SAFE_PATH)
    return f"{scheme}://{site}{path}" + (f"?{quote(query, safe=SAFE_PATH + '?=&')}" if query else "")


def normalize(url: str, strip: tuple[str, ...] = ()) -> str | None:
    return _build(*parts(clean(url)), strip)


def resolve(base: str, ref: str, strip: tuple[str, ...] = ()) -> str | None:
    ref = clean(ref)
    if not ref or ref.startswith(NO_RESOURCE):
        return None
    scheme, where, path, query = parts(ref)
    b_scheme, b_where, b_path, b_query = _base(base)
    if scheme:
        return _build(scheme, where, path, query, strip)
    if where is None:
        where = b_where
        if not path:
            path, query = b_path, b_query if query is None else query
        elif path[0] != "/":
            folder = [s for s in b_path.split("/")[1:-1] if s]
            steps = path.split("/")
            path = "/" + "/".join([*folder, *(s for s in steps[:-1] if s), steps[-1]])
    return _build(b_scheme, where, path, query, strip)


@lru_cache(1024)
def _base(url: str) -> tuple[str, str | None, str, str | None]:
    return parts(url)


def is_image(url: str) -> bool:
    return bool(_IMAGE.search(parts(url)[2]))


def is_no_page(url: str) -> bool:
    return bool(_OTHER.search(parts(url)[2])) or is_image(url)


def host(url: str) -> str:
    where = (parts(url)[1] or "").rpartition("@")[2]
    m = _WHERE.fullmatch(where)
    return ((m["six"] if m["six"] is not None else m["name"].removeprefix("[")) if m else where).lower()


def pattern(url: str) -> str:
    """A URL's coarse shape, as functions/url.url_pattern() has it."""
    _, _, path, query = parts(url)
    steps = ["X" if _TOKEN.search(s) else _DIGITS.sub("N", s) for s in path.split("/")]
    names = sorted({p.partition("=")[0] for p in (query or "").split("&") if p})
    return host(url) + "/".join(steps) + (f"?{'&'.join(names)}" if query else "")


def sniff(body: bytes) -> str | None:
    """The image format of a body, as functions/binary.sniff() has it."""
    head = body[: binary.HEAD_BYTES]
    for start, name in _HEADS:
        if head.startswith(start):
            return name
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return "webp"
    if head[4:8] == b"ftyp":
        last = min(int.from_bytes(head[:4]), len(head)) - 4
        brands = {head[8:12], *(head[k : k + 4] for k in range(16, last + 1, 4))}
        return next((f for f, known in (("avif", binary.AVIF_BRANDS), ("heic", binary.HEIF_BRANDS)) if brands & {b.encode() for b in known}), None)
    if head[:4] in (b"\0\0\1\0", b"\0\0\2\0") and len(head) >= 6 and head[4:6] != b"\0\0":
        return "ico"
    if head[:2] == b"BM" and len(head) >= 14:
        return "bmp"
    text = head.decode("utf-8", "replace").lstrip("\ufeff \t\r\n").lower()
    if text.startswith(("<?xml", "<!--", "<svg", "<!doctype svg")) and "<svg" in text and not 0 <= text.find("<html") < text.find("<svg"):
        return "svg"
    return None
