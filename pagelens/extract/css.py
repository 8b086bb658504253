"""Image addresses and imports of style sheets, read from left to right in time linear in the text."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pagelens.extract.srcset import Candidate, choose, comma, described

#: File extensions that a `url()` may name without being an image.
NOT_IMAGES = frozenset("woff woff2 ttf otf eot css js htc cur".split())

#: Where something of interest may begin.
_BEGIN = re.compile(r"@(?:import(?=\s)|font-face(?=\s*\{))|(?:image-set|url)\(", re.I)
_SPACE = re.compile(r"\s*")
_PARENTHESIS = re.compile(r"[()]")
#: What ends an address without quotes, in `url()` and behind `@import`.
_ENDS = {"url": re.compile(r"[\s'\")]"), "import": re.compile(r"[\s'\"();]"), '"': re.compile('"'), "'": re.compile("'"), ";": re.compile(";"), "}": re.compile(r"\}")}


def names_an_image(address: str) -> bool:
    """Whether an address may be an image's: no fragment, no data of another type, no file of a type that is never one."""
    head, colon, rest = address.partition(":")
    if colon and head == "data":
        return rest[:6].lower() == "image/"
    for part in re.split("[?#]", address):
        if "." in part and part.rpartition(".")[2].lower() in NOT_IMAGES:
            return False
    return address != "" and address[0] != "#"


def _without_comments(text: str) -> str:
    """A blank for each comment; one that nothing closes is text."""
    parts, at = [], 0
    while (start := text.find("/*", at)) >= 0 and (end := text.find("*/", start + 2)) >= 0:
        parts.append(text[at:start])
        at = end + 2
    return " ".join([*parts, text[at:]])


class _Reader:
    """Places in a text, found from left to right: each search goes on where the one before it ended, so all of them together
    pass over the text once for each thing that is looked for."""

    def __init__(self, text: str):
        self.text = text
        self.next: dict[str, int] = {}
        self.pairs: dict[int, int] | None = None

    def place(self, what: str, at: int) -> int:
        """The first place of something at or behind `at`; the end of the text and more if there is none."""
        if self.next.get(what, -1) < at:
            m = _ENDS[what].search(self.text, at)
            self.next[what] = m.start() if m else len(self.text) + 1
        return self.next[what]

    def skip(self, at: int) -> int:
        return _SPACE.match(self.text, at).end()

    def string(self, at: int) -> tuple[str, int] | None:
        """(content, end) of the quoted string that begins here."""
        quote = self.text[at : at + 1]
        if quote not in ("'", '"') or (end := self.place(quote, at + 1)) > len(self.text):
            return None
        return self.text[at + 1 : end].strip(), end + 1

    def bare(self, at: int, what: str) -> tuple[str, int]:
        end = min(self.place(what, at), len(self.text))
        return self.text[at:end], end

    def url(self, at: int) -> tuple[str, int] | None:
        """(address, end) of the `url(` that has just been opened, if it is closed behind one address."""
        at = self.skip(at)
        quoted = self.string(at)
        end = self.skip(quoted[1] if quoted else min(self.place("url", at), len(self.text)))
        if self.text[end : end + 1] != ")":
            return None  # nothing is cut out of an address that never ends
        return (quoted or self.bare(at, "url"))[0], end + 1

    def closing(self, at: int) -> int | None:
        """Where the parenthesis that was opened just before `at` is closed."""
        if self.pairs is None:
            self.pairs, open_ = {}, []
            for m in _PARENTHESIS.finditer(self.text):
                if m[0] == "(":
                    open_.append(m.end())
                elif open_:
                    self.pairs[open_.pop()] = m.start()
        return self.pairs.get(at)

    def behind(self, what: str, at: int) -> int | None:
        end = self.place(what, at)
        return end + 1 if end <= len(self.text) else None


def _set(body: str) -> Iterator[Candidate]:
    """The candidates of an `image-set()`: each has its address first, then its descriptor."""
    at = 0
    while at <= len(body):
        end = comma(body, at)
        item = body[at:end].strip()
        reader = _Reader(item)
        found = reader.url(4) if item[:4].lower() == "url(" else reader.string(0)
        if found and names_an_image(found[0]):
            yield described(found[0], item[found[1] :])
        at = end + 1


def scan(text: str, mode: str = "largest") -> tuple[list[str], list[str], list[str]]:
    """Image sets (one choice each), addresses and imports of a style sheet, each in order."""
    sheet = _Reader(_without_comments(text))
    sets: list[str] = []
    urls: list[str] = []
    imports: list[str] = []
    at = 0
    while m := _BEGIN.search(sheet.text, at):
        at, word = m.end(), m[0].lower()
        if word == "url(":
            if found := sheet.url(at):
                at = found[1]
                if names_an_image(found[0]):
                    urls.append(found[0])
        elif word == "image-set(":
            if (end := sheet.closing(at)) is not None:
                sets += choose(list(_set(sheet.text[at:end])), mode)
                at = end + 1
        elif word == "@import":
            start = sheet.skip(at)
            called = sheet.text[start : start + 4].lower() == "url("
            address, end = (sheet.url(start + 4) if called else None) or sheet.string(start) or sheet.bare(start, "import")
            if address:
                imports.append(address)
                at = sheet.behind(";", end) or len(sheet.text)
        else:  # nothing that a font face holds is an image
            at = sheet.behind("}", at) or at
    return sets, urls, imports


def images(text: str, mode: str = "largest", prefix: str = "css") -> list[tuple[str, str]]:
    sets, urls, _ = scan(text, mode)
    return [(u, f"{prefix}:image-set") for u in sets] + [(u, f"{prefix}:url") for u in urls]
