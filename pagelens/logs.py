"""Events as JSON lines."""

from __future__ import annotations

import json
import logging

from pagelens.state import now


class JsonLines(logging.Formatter):
    """`ts, level, event` and what the record carries as `data`."""

    def format(self, record: logging.LogRecord) -> str:
        row = {"ts": now(), "level": record.levelname.lower(), "event": record.getMessage(), **getattr(record, "data", {})}
        if record.exc_info:
            row["error"] = self.formatException(record.exc_info)
        return json.dumps(row, default=str)


def setup(path: str | None = None, level: int = logging.INFO) -> logging.Logger:
    log = logging.getLogger("pagelens")
    handler = logging.FileHandler(path) if path else logging.StreamHandler()
    handler.setFormatter(JsonLines())
    log.handlers[:] = [handler]
    log.setLevel(level)
    log.propagate = False
    return log
