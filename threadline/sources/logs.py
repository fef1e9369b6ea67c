"""Append-only logs, prompt history and per-folder JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.functions import times
from threadline.functions import variants as V
from threadline.functions.once import computed_once
from threadline.sources.transcripts import parse_lines, parsed_line


def log_records(lines: DataFrame) -> DataFrame:
    """Event records of a capture or hook log; a malformed line is no record.

    ``lines`` is ``line_no, raw``; the stamp is taken from ``at`` or ``ts``.
    """
    v = F.col("v")
    parsed = parse_lines(lines).where("v is not null")
    stamp = F.coalesce(V.text(v, "$.at"), V.text(v, "$.ts"))
    fields = ["status", "session", "session_uuid", "message", "source", "detail"]
    texts = {f: V.text(v, f"$.{f}") for f in fields}
    typed = computed_once(parsed, {**texts, "at": stamp}, keep=["line_no"])
    return computed_once(typed, {"ts": times.parse_instant(F.col("at"))})


def history_rows(lines: DataFrame) -> DataFrame:
    """Prompt-history rows with a session id; the raw line is kept as it was written."""
    v = F.col("v")
    stamp = F.coalesce(V.integer(v, "$.timestamp"), F.try_variant_get(v, "$.timestamp", "bigint"))
    is_number = V.kind(v, "$.timestamp").rlike("^(BIGINT|DOUBLE|DECIMAL)")
    rows = parse_lines(lines).where("v is not null")
    typed = {
        "session_uuid": V.present(v, "$.sessionId"),
        "ts": F.when(is_number, F.timestamp_millis(stamp)),
        "display": V.text(v, "$.display"),
        "pasted": V.fields(v, "$.pastedContents"),
    }
    return computed_once(rows, typed, keep=["line_no", "raw"]).where("session_uuid is not null")


def paste_references(history: DataFrame) -> DataFrame:
    """Distinct ``session_uuid, content_hash`` of pastes whose text lives outside the history."""
    entry = history.where("pasted is not null").select("session_uuid", F.explode("pasted").alias("_k", "_e"))
    found = entry.select("session_uuid", V.present(F.col("_e"), "$.contentHash").alias("content_hash"))
    return found.where("content_hash is not null").distinct()


def manifests(documents: DataFrame) -> DataFrame:
    """Readable manifests as ``folder, source_hash, v``; unreadable ones are absent."""
    v = F.col("v")
    parsed = computed_once(documents, {"v": parsed_line(F.col("raw"))}).where("v is not null")
    return parsed.select(
        F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"),
        V.present(v, "$.source_hash").alias("source_hash"),
        V.is_true(v, "$.prompts.present").alias("has_prompts"),
        F.coalesce(F.size(V.items(v, "$.pastes")), F.lit(0)).alias("n_pastes"),
        v,
    )


def manifest_children(manifest: DataFrame, key: str, name_field: str) -> DataFrame:
    """Child records a manifest lists under ``key``: ``folder, name, sha256, bytes``."""
    items = V.items(F.col("v"), f"$.{key}")
    spread = manifest.select("folder", F.explode(items).alias("_c"))
    c = F.col("_c")
    return spread.select(
        "folder",
        V.text(c, f"$.{name_field}").alias("name"),
        V.present(c, "$.sha256").alias("sha256"),
        V.integer(c, "$.bytes").alias("bytes"),
    )


def sidecar_notices(documents: DataFrame) -> DataFrame:
    """Names each folder's notice says nothing has copied: ``folder, name``."""
    v = F.col("v")
    parsed = computed_once(documents, {"v": parsed_line(F.col("raw"))}).where("v is not null")
    names = F.concat(
        *[
            F.coalesce(F.transform(V.items(v, f"$.{k}"), lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>"))
            for k in ("unarchived", "unknown_inside_subagents", "refused")
        ]
    )
    return parsed.select(
        F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.explode(names).alias("name")
    )


def project_sidecars(documents: DataFrame) -> DataFrame:
    """Aliases a ``project.json`` records: ``folder, label, alias``."""
    v = F.col("v")
    parsed = computed_once(documents, {"v": parsed_line(F.col("raw"))}).where("v is not null")
    aliases = F.transform(V.items(v, "$.aliases"), lambda a: F.coalesce(V.present(a, "$.path"), V.present(a, "$")))
    return parsed.select(
        F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"),
        V.present(v, "$.label").alias("label"),
        F.explode(aliases).alias("alias"),
    )


def stores_by_session(files: DataFrame) -> DataFrame:
    """External store files by session: ``store, session_uuid, files``.

    ``file-history/<uuid>/...`` and ``todos/<uuid>-*.json`` carry the session in their path.
    """
    path = F.col("path")
    history = F.regexp_extract(path, r"/file-history/([0-9a-f-]{36})/", 1)
    todo = F.regexp_extract(path, r"/todos/([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})-[^/]*\.json$", 1)
    named = files.select(
        F.when(history != "", "file-history").when(todo != "", "todos").alias("store"),
        F.coalesce(F.nullif(history, F.lit("")), F.nullif(todo, F.lit(""))).alias("session_uuid"),
    )
    return named.where("store is not null").groupBy("store", "session_uuid").agg(F.count(F.lit(1)).alias("files"))


def unrouted_store_files(files: DataFrame) -> DataFrame:
    """Files of the external stores whose name leads to no session."""
    path = F.col("path")
    inside = path.rlike("/(file-history|todos)/")
    routed = path.rlike(r"/file-history/[0-9a-f-]{36}/") | path.rlike(
        r"/todos/[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}-[^/]*\.json$"
    )
    return files.where(inside & ~routed)


def stored_objects(binaries: DataFrame) -> DataFrame:
    """Hash check of a content-addressed store: ``address, actual``.

    Only names shaped ``<hh>/<64 hex>.<ext>`` whose folder is the hash prefix count.
    """
    address = F.regexp_extract("path", r"/[0-9a-f]{2}/([0-9a-f]{64})\.[^/]+$", 1)
    folder = F.regexp_extract("path", r"/([0-9a-f]{2})/[0-9a-f]{64}\.[^/]+$", 1)
    shaped = binaries.where(address != "").where(folder == F.substring(address, 1, 2))
    return shaped.select(address.alias("address"), F.sha2("content", 256).alias("actual"))
