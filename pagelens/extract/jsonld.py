"""Image URLs of JSON-LD."""

from __future__ import annotations

import json

#: Properties whose values are images.
IMAGE_KEYS = frozenset("image logo thumbnailUrl thumbnail contentUrl photo primaryImageOfPage".split())
#: Properties of an image that hold its address.
ADDRESS_KEYS = IMAGE_KEYS | {"url"}
DEPTH = 50


def jsonld_images(text: str) -> list[str]:
    """Strings below image properties, once each, in order; what is no JSON gives none."""
    try:
        todo = [(json.loads(text), False, 0)]
    except (ValueError, RecursionError):
        return []
    found: dict[str, None] = {}
    while todo:
        node, image, depth = todo.pop()
        if depth > DEPTH:
            continue
        if isinstance(node, str):
            if image:
                found[node] = None
        elif isinstance(node, list):
            todo += [(x, image, depth + 1) for x in reversed(node)]
        elif isinstance(node, dict):
            below = [(v, k in (ADDRESS_KEYS if image else IMAGE_KEYS), depth + 1) for k, v in node.items()]
            todo += reversed(below)
    return list(found)
