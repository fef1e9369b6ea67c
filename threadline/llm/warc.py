"""Not-modified revisit resolution for web archives.

A server answers a conditional request with "not modified" and no body. Such a
revisit record is resolved by an as-of join: the latest earlier full response
with the same canonical URL, if its validators agree. The resolved record has
the earlier payload and its headers, updated by those headers of the revisit
that such an answer may update.

The join looks at validators and ids only; payloads stay where they are and are
referred to by record. A URL with a third of all captures is not one group: it
is cut into time chunks, windows run per (URL, chunk), and the latest response
of all earlier chunks is carried in from one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadline.functions.once import computed_once

#: Headers that a not-modified answer may update (fixed values, RFC 9110 section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that do not change the resource.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|sessionid|ref)="
#: Seconds of a time chunk.
CHUNK_SECONDS = 86_400


def canonical_url(url: Column) -> Column:
    """Scheme and fragment dropped, host in lower case without ``www.`` and default port, tracking
    parameters dropped and the others sorted, one trailing slash dropped. Null or host-less: null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"(?s)#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/$", "")
    query = F.regexp_extract(bare, r"(?s)\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(host != "", F.concat(host, path, tail))


def _tag(value: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(value, r"^W/", "")


def resolve_revisits(records: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """One row per record: its columns (without payload) and ``canonical``, ``outcome``, ``base_id``, ``merged``.

    ``records`` has ``record_id`` BIGINT, ``url``, ``at`` (epoch seconds),
    ``status`` INT and ``headers`` MAP with lower-case names. Status 200 is a full
    response and 304 a revisit. ``outcome``:

    * ``response``: a full response; ``base_id`` is itself.
    * ``resolved``: the validators agree. Entity tags are compared if both have
      one, else modification dates if both have one; null and empty count as absent.
    * ``mismatch`` / ``unvalidated``: they differ, or there is no pair to compare.
    * ``no_base``: no earlier full response of that URL, or URL or time is null.
    * ``other``: any other status, null included.

    "Earlier" is a strictly smaller time; among responses of one second the
    largest ``record_id`` is the latest. ``merged`` is null unless resolved or
    a full response. A record without an id is resolved but never a base. Repeated
    records give as many rows; of responses that share an id and a URL the latest
    one's headers answer.
    """
    full, revisit = F.col("status") == 200, F.col("status") == 304
    own = F.struct(*[F.col(f"`{c}`") for c in records.columns if c not in ("payload", "html", "body")])
    # Behind a generator, or every filter below would spell the URL out again.
    spelled = computed_once(
        records.select(own.alias("row"), F.col("record_id").alias("id"), "url", "at", "status", "headers"), {"canonical": canonical_url(F.col("url"))}
    )
    rows = spelled.select(
        "row",
        "id",
        "canonical",
        F.col("at").cast("bigint").alias("at"),
        F.coalesce(full, F.lit(False)).alias("full"),
        F.coalesce(revisit, F.lit(False)).alias("revisit"),
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
    )
    base = F.when(F.col("full") & F.col("id").isNotNull(), F.struct(F.col("at").alias("at"), F.col("id").alias("id")))
    timed = rows.withColumn("chunk", F.floor(F.col("at") / chunk_seconds)).withColumn("base", base)
    keys = ["canonical", "chunk"]
    usable = timed.where("canonical is not null and at is not null and (full or revisit)").select("id", "canonical", "at", "chunk", "base", "full", "revisit", "row", "headers")
    last = usable.groupBy(*keys).agg(F.max("base").alias("last"))
    before = Window.partitionBy("canonical").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("carried", F.max("last").over(before)).select(*keys, "carried")
    inside = Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    # Only revisits need the carry, so the join is as small as they are.
    placed = usable.withColumn("local", F.max("base").over(inside)).where("revisit").join(carried, keys)
    asked = placed.select("row", "canonical", "headers", F.coalesce("local", "carried")["id"].alias("base_id"))
    # One row per id and URL, or a repeated response would repeat every revisit that it answers.
    latest = F.max_by("headers", F.struct("at", F.to_json("headers")))
    responses = rows.where("full and id is not null").groupBy(F.col("id").alias("base_id"), "canonical").agg(latest.alias("base_headers"))
    met = asked.join(responses, ["base_id", "canonical"], "left")
    value = lambda side, name: F.nullif(F.get(F.transform(F.array(F.col(side)), lambda m: F.try_element_at(m, F.lit(name))), F.lit(0)), F.lit(""))
    tags = _tag(value("headers", "etag")), _tag(value("base_headers", "etag"))
    dates = value("headers", "last-modified"), value("base_headers", "last-modified")
    agree = F.when(tags[0].isNotNull() & tags[1].isNotNull(), tags[0] == tags[1]).otherwise(dates[0] == dates[1])
    outcome = (
        F.when(F.col("base_id").isNull(), "no_base").when(agree.isNull(), "unvalidated").when(agree, "resolved").otherwise("mismatch")
    )
    updates = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    kept = F.map_filter("base_headers", lambda k, v: ~F.array_contains(F.map_keys(updates), k))
    found = met.withColumn("outcome", outcome).select(
        "row", "canonical", "outcome", "base_id", F.when(F.col("outcome") == "resolved", F.map_concat(kept, updates)).alias("merged")
    )
    plain = rows.where("full or not revisit or canonical is null or at is null")
    rest = plain.select(
        "row",
        "canonical",
        F.when(F.col("full"), "response").when(F.col("revisit"), "no_base").otherwise("other").alias("outcome"),
        F.when(F.col("full"), F.col("id")).alias("base_id"),
        F.when(F.col("full"), F.col("headers")).alias("merged"),
    )
    named = [c for c in own_names(records) if c not in ("canonical", "outcome", "base_id", "merged")]
    return found.unionByName(rest).select(*[F.col(f"row.`{c}`") for c in named], "canonical", "outcome", "base_id", "merged")


def own_names(records: DataFrame) -> list[str]:
    return [c for c in records.columns if c not in ("payload", "html", "body")]
