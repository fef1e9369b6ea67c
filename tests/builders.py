"""Small transcript entries."""

from __future__ import annotations

import json


def assistant(ts="2026-06-01T10:00:00Z", model="claude-opus-4-8", content=None, usage=None, **extra):
    message = {"role": "assistant", "model": model, "content": content or [{"type": "text", "text": "ok"}]}
    if usage is not None:
        message["usage"] = usage
    return {"type": "assistant", "timestamp": ts, "sessionId": "s1", "message": message, **extra}


def user(content="hello", ts="2026-06-01T10:00:00Z", **extra):
    return {"type": "user", "timestamp": ts, "sessionId": "s1", "message": {"role": "user", "content": content}, **extra}


def lines(spark, entries, path="/archive/l/x_s1/s1.jsonl"):
    rows = [(path, i + 1, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, "path string, line_no bigint, raw string")
