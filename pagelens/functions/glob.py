"""Shell-style globs as regular expressions: `*` any run (slashes too), `?` one character, `[...]` and `[!...]` sets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """A pattern for whole strings that Java, Python and RE2 read alike."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            end = glob.find("]", i + (2 if glob[i : i + 1] == "!" else 1))
            if end < 0:
                out.append(r"\[")
                continue
            body = glob[i:end].replace("\\", r"\\").replace("[", r"\[")
            body = "^" + body[1:] if body[0] == "!" else (r"\^" + body[1:] if body[0] == "^" else body)
            out.append(f"[{body}]")
            i = end + 1
        else:
            out.append(ch if ch.isalnum() or ch in "_/ -=%:@,;~" else "\\" + ch)
    return "(?s)^" + "".join(out) + "$"


def matches_any(col: Column, globs) -> Column:
    """Whether a column matches one of the globs; false for none."""
    globs = list(globs)
    if not globs:
        return F.lit(False)
    return F.coalesce(col.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)), F.lit(False))


def match_any(text: str, globs) -> bool:
    return any(re.search(glob_regex(g), text) for g in globs)
