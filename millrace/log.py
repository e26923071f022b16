"""Log lines as one JSON object each, for the driver and for tasks."""

from __future__ import annotations

import json
import logging
import sys
from datetime import datetime, timezone
from typing import TextIO

_PLAIN = set(vars(logging.makeLogRecord({}))) | {"message", "asctime"}


class JsonLines(logging.Formatter):
    """Time in UTC, level, logger, message, the fields given as ``extra``, and the error if there is one."""

    def format(self, record: logging.LogRecord) -> str:
        out = {"ts": datetime.fromtimestamp(record.created, timezone.utc).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        out |= {k: v for k, v in vars(record).items() if k not in _PLAIN}
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out, default=str, ensure_ascii=False)


def logger(name: str = "millrace", level: str = "INFO", stream: TextIO | None = None) -> logging.Logger:
    """A logger that writes JSON lines; asking again for the same name adds no second handler."""
    out = logging.getLogger(name)
    out.setLevel(level)
    if not any(isinstance(h.formatter, JsonLines) for h in out.handlers):
        handler = logging.StreamHandler(stream or sys.stderr)
        handler.setFormatter(JsonLines())
        out.addHandler(handler)
        out.propagate = False
    return out
