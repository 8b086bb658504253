"""Image types from magic bytes, content hashes and data URIs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions.url import percent_decode

#: Known formats and the extension of each.
EXTENSIONS = {
    "jpeg": "jpg", "png": "png", "gif": "gif", "webp": "webp", "avif": "avif", "svg": "svg",
    "ico": "ico", "bmp": "bmp", "tiff": "tiff", "heic": "heic", "jxl": "jxl",
}
FORMATS = tuple(EXTENSIONS)
#: Brands of ISO media files.
AVIF_BRANDS = ("avif", "avis")
HEIF_BRANDS = ("heic", "heix", "hevc", "hevx", "heim", "heis", "mif1", "msf1")
#: Bytes that decide every format.
HEAD_BYTES = 4096


def _hex(col: Column, start: int, length: int) -> Column:
    """Bytes from `start` (0-based) as upper-case hex; shorter at the end."""
    return F.hex(F.substring(col, start + 1, length))


def _brands(head: Column) -> Column:
    """The major brand and the compatible ones, four bytes each, inside the first box."""
    size = F.conv(_hex(head, 0, 4), 16, 10).cast("long")
    last = F.least(size, F.length(head).cast("long")).cast("int") - 4
    places = F.when(last >= 16, F.sequence(F.lit(16), last, F.lit(4))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(_hex(head, 8, 4)), F.transform(places, lambda i: F.hex(F.substring(head, i + 1, F.lit(4)))))


def _any_brand(head: Column, brands) -> Column:
    return F.arrays_overlap(_brands(head), F.array(*[F.lit(b.encode().hex().upper()) for b in brands]))


def _looks_like_svg(head: Column) -> Column:
    text = F.lower(F.regexp_replace(F.make_valid_utf8(F.substring(head, 1, HEAD_BYTES)), r"^[\x{FEFF} \t\r\n]+", ""))
    svg, html = F.instr(text, "<svg"), F.instr(text, "<html")
    starts = F.lit(False)
    for p in ("<?xml", "<!--", "<svg", "<!doctype svg"):
        starts = starts | text.startswith(p)
    return starts & (svg > 0) & ((html == 0) | (svg < html))


def sniff(body: Column) -> Column:
    """The image format of a binary column, or null."""
    head = F.substring(body, 1, HEAD_BYTES)
    first4 = _hex(head, 0, 4)
    ftyp = F.when(_any_brand(head, AVIF_BRANDS), "avif").when(_any_brand(head, HEIF_BRANDS), "heic")
    return (
        F.when(_hex(head, 0, 3) == "FFD8FF", "jpeg")
        .when(_hex(head, 0, 8) == "89504E470D0A1A0A", "png")
        .when(_hex(head, 0, 6).isin("474946383761", "474946383961"), "gif")
        .when((first4 == "52494646") & (_hex(head, 8, 4) == "57454250"), "webp")
        .when(_hex(head, 4, 4) == "66747970", ftyp)
        .when(first4.isin("00000100", "00000200") & (F.length(head) >= 6) & (_hex(head, 4, 2) != "0000"), "ico")
        .when((_hex(head, 0, 2) == "424D") & (F.length(head) >= 14), "bmp")
        .when(first4.isin("49492A00", "4D4D002A"), "tiff")
        .when((_hex(head, 0, 2) == "FF0A") | (_hex(head, 0, 12) == "0000000C4A584C200D0A870A"), "jxl")
        .when(_looks_like_svg(head), "svg")
    )


def extension(fmt: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[fmt]


def content_digest(body: Column) -> Column:
    return F.sha2(body, 256)


_DATA_URI = r"(?s)^data:([^;,]*)((?:;[^;,]*)*+),(.*)$"


def decode_data_uri(uri: Column) -> Column:
    """`struct(mime, data)` of a data URI; null if malformed."""
    u = F.trim(uri)
    ok = u.rlike(_DATA_URI)
    mime, params, payload = F.lower(F.regexp_extract(u, _DATA_URI, 1)), F.lower(F.regexp_extract(u, _DATA_URI, 2)), F.regexp_extract(u, _DATA_URI, 3)
    packed = F.regexp_replace(percent_decode(payload), r"\s+", "")
    data = F.when(params.contains(";base64"), F.try_to_binary(packed, F.lit("base64"))).otherwise(F.encode(percent_decode(payload), "UTF-8"))
    return F.when(ok & data.isNotNull(), F.struct(mime.alias("mime"), data.alias("data")))


def data_uri_key(mime: Column, data: Column) -> Column:
    """A short key that stands for a data URI."""
    kind = F.when(F.coalesce(mime, F.lit("")) == "", "application/octet-stream").otherwise(mime)
    return F.concat(F.lit("data:"), kind, F.lit(";sha256="), F.sha2(data, 256))
