"""The operators over their whole tables, as registered queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadline.functions.once import computed_once
from threadline.llm import chat, decontaminate, license_scan, lm_score
from threadline.llm import line_dedup as lines
from threadline.llm import mixing as M
from threadline.llm import prefix_trie, quality, repair, simhash, substring, warc, wrapper
from threadline.runtime import new_run_dir, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op6_quality_ledger(spark, sf_dir):
    book = quality.ledger(table(spark, sf_dir, "documents"))
    return book.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality.passes("base")).alias("base_failed"),
        quality.passes("v2").alias("kept"),
        "failed",
    )


ORACLE["op6_quality_ledger"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS body,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
tri AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM rep, (VALUES (0), (1), (2)) v(d) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_text_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
f AS (SELECT *,
  (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_text_lines AND n_dup_lines >= 3 THEN 8 ELSE 0 END)
  + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed % 4) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""


@query
def op10_line_dedup(spark, sf_dir):
    done = lines.line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE["op10_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, i, lines[i] AS line,
    translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
r AS (SELECT k, min(doc_id) AS keeper FROM x WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
y AS (SELECT x.*, r.keeper IS NOT NULL AND x.doc_id <> r.keeper AS gone FROM x LEFT JOIN r ON x.k = r.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM y GROUP BY doc_id
"""


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): 2 where labelled good, a half where labelled bad; labels of one id are averaged."""
    rated = labels.where("doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("q"))
    return rated.select("doc_id", F.when(F.col("q") >= 0.5, 2.0).when(F.col("q") < 0.5, 0.5).otherwise(1.0).alias("weight"))


@query
def op4_source_mixing(spark, sf_dir):
    weights = quality_weights(table(spark, sf_dir, "labels"))
    return M.mix(table(spark, sf_dir, "documents"), weights).select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op4_source_mixing"] = r"""
WITH q AS (SELECT doc_id, avg(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT d.doc_id, d.source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CASE WHEN q.q >= 0.5 THEN 2.0::DOUBLE WHEN q.q < 0.5 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w,
    (('0x' || substr(md5('7:' || CAST(d.doc_id AS VARCHAR)), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS lim, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS own FROM r),
o AS (SELECT own AS level FROM l WHERE own * weight < lim ORDER BY lim / weight, own LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT level FROM o) IS NULL THEN lim::DOUBLE ELSE least(lim::DOUBLE, (SELECT level FROM o) * weight) END AS target FROM l),
k AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / w, d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN epochs < 3 AND upto - size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM k
"""


@query
def op9_simhash_near_dedup(spark, sf_dir):
    done = simhash.simhash(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_benchmark_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], rows.schema)
    chats = chat.format_chat(rows.union(extra))
    read = computed_once(
        chats, {"turns": chat.read_back(F.col("formatted")), "loss": chat.under_mask(F.col("formatted"), F.col("loss_spans"))}, ["conv_id", "formatted"]
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLE["op2_chat_formatting"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
e AS (
  SELECT *, length(text) + length(text) - length(replace(replace(text, '<', ''), '[', '')) AS size,
    length(role) + length(role) - length(replace(replace(role, '<', ''), '[', '')) AS role_size,
    coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS goes_on FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size + CASE WHEN goes_on THEN 7 ELSE role_size + 14 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op7_substring_dedup(spark, sf_dir):
    done = substring.substring_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op7_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 19], ' ')) AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM rep, range(0, 20) r(o)),
w AS (SELECT doc_id, i, words[i] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d)),
k AS (SELECT w.doc_id, count(*) AS n_words, count(gone.i) AS n_removed,
    string_agg(CASE WHEN gone.i IS NULL THEN word END, ' ' ORDER BY w.i) AS kept
  FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


@query
def op8_lm_score(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


@query
def op3_license_scan(spark, sf_dir):
    return license_scan.license_labels(spark, table(spark, sf_dir, "documents"))


def captures(pages: DataFrame) -> DataFrame:
    """Archive records of every page: its response, and three later conditional requests.

    The first revisit spells the URL in another way and has the response's tag
    in its weak form, the second has only the date, and the third another tag.
    """
    day, minute = 86_400, 60
    seen = pages.select(
        "page_id", "url", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.length(F.coalesce("html", F.lit(""))).alias("size")
    )
    at = F.lit(1_700_000_000) + F.col("page_id") * minute
    date = F.concat(F.lit("day "), F.floor(F.col("page_id") / 1000).cast("string"))
    kinds = F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("kind")
    rows = seen.select("*", kinds)
    pick = lambda *values: F.get(F.array(*values), F.col("kind"))
    text = lambda value: F.lit(value).cast("string")
    headers = F.map_from_arrays(
        F.array(*[F.lit(n) for n in ("etag", "last-modified", "date", "content-length", "cache-control")]),
        F.array(
            pick("digest", F.concat(F.lit("W/"), F.col("digest")), text(None), F.reverse("digest")),
            pick(date, text(None), date, date),
            F.concat(F.lit("t"), (at + F.col("kind") * day).cast("string")),
            F.when(F.col("kind") == 0, F.col("size")).otherwise(0).cast("string"),
            pick(text("max-age=1"), text("max-age=2"), text(None), text("max-age=4")),
        ),
    )
    spelled = F.concat(F.regexp_replace(F.col("url"), "^https?://", "HTTP://WWW."), F.lit("#again"))
    return rows.select(
        (F.col("page_id") * 4 + F.col("kind")).alias("record_id"),
        "page_id",
        pick(F.col("url"), spelled, F.col("url"), F.col("url")).alias("url"),
        (at + F.col("kind") * day).alias("at"),
        F.when(F.col("kind") == 0, 200).otherwise(304).alias("status"),
        headers.alias("headers"),
    )


@query
def op1_revisit_resolution(spark, sf_dir):
    done = warc.resolve_revisits(captures(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries(F.map_filter("merged", lambda k, v: v.isNotNull()))), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return done.select(
        "record_id", "page_id", "canonical", "outcome", "base_id", F.floor(F.col("base_id") / 4).alias("base_page_id"), F.array_join(lines, ";").alias("merged")
    )


ORACLE["op1_revisit_resolution"] = r"""
WITH r AS (
  SELECT page_id * 4 + kind AS record_id, page_id, kind, 1700000000 + page_id * 60 + kind * 86400 AS ts,
    CASE WHEN kind = 1 THEN regexp_replace(url, '^https?://', 'HTTP://WWW.') || '#again' ELSE url END AS url,
    CASE kind WHEN 0 THEN md5(coalesce(html, '')) WHEN 1 THEN 'W/' || md5(coalesce(html, '')) WHEN 3 THEN reverse(md5(coalesce(html, ''))) END AS etag,
    CASE WHEN kind <> 1 THEN 'day ' || CAST(page_id // 1000 AS VARCHAR) END AS modified,
    CASE WHEN kind = 0 THEN length(coalesce(html, '')) ELSE 0 END AS size,
    CASE kind WHEN 0 THEN 'max-age=1' WHEN 1 THEN 'max-age=2' WHEN 3 THEN 'max-age=4' END AS cache
  FROM pages, (VALUES (0), (1), (2), (3)) k(kind)),
b AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', '', 's'), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM r),
p AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), ':(80|443)$', ''), '^www\.', '')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/$', '') AS front,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|gclid|fbclid|sessionid|ref)='))) AS params FROM b),
c AS (SELECT *, front || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical FROM p),
f AS (SELECT canonical, ts, max(record_id) AS base_id FROM c WHERE kind = 0 GROUP BY canonical, ts),
j AS (SELECT c.*, f.base_id FROM c ASOF LEFT JOIN f ON c.canonical = f.canonical AND c.ts > f.ts WHERE c.kind > 0),
v AS (SELECT j.*, b.etag AS b_etag, b.modified AS b_modified, b.size AS b_size, b.ts AS b_at, b.cache AS b_cache,
    CASE WHEN j.etag IS NOT NULL AND b.etag IS NOT NULL THEN regexp_replace(j.etag, '^W/', '') = b.etag ELSE j.modified = b.modified END AS agree
  FROM j LEFT JOIN c b ON j.base_id = b.record_id)
SELECT record_id, page_id, canonical, 'response' AS outcome, record_id AS base_id, page_id AS base_page_id,
  'cache-control:' || cache || ';content-length:' || size || ';date:t' || ts || ';etag:' || etag || ';last-modified:' || modified AS merged
FROM c WHERE kind = 0
UNION ALL
SELECT record_id, page_id, canonical, CASE WHEN base_id IS NULL THEN 'no_base' WHEN agree IS NULL THEN 'unvalidated' WHEN agree THEN 'resolved' ELSE 'mismatch' END,
  base_id, base_id // 4,
  CASE WHEN agree THEN 'cache-control:' || coalesce(cache, b_cache) || ';content-length:' || b_size || ';date:t' || ts || ';etag:' || coalesce(etag, b_etag)
    || ';last-modified:' || b_modified END
FROM v
"""


def _notice_sql() -> str:
    """The template k-grams as SQL rows: template, label, base, whole, tpos, n_grams, size, gram."""
    rows = []
    for whole_text, label, base in [(p, x, True) for p, x in license_scan.PHRASES.items()] + [(t, x, False) for x, t in license_scan.NOTICES.items()]:
        words = license_scan.template_words(whole_text)
        whole = base or len(words) <= license_scan.TEXT_GRAM
        k = license_scan.PHRASE_GRAM if whole else license_scan.TEXT_GRAM
        n = len(words) - k + 1
        rows += [f"('{label}{base}{len(words)}{words[0]}', '{label}', {base}, {whole}, {i}, {n}, {len(words)}, '{' '.join(words[i : i + k])}')" for i in range(n)]
    return ", ".join(rows)


ORACLE["op3_license_scan"] = rf"""
WITH t(template, label, base, whole, tpos, n_grams, size, gram) AS (VALUES {_notice_sql()}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d),
g AS (SELECT doc_id, i - 1 AS pos, array_to_string(words[i : i + k - 1], ' ') AS gram FROM p, (VALUES (2), (4)) n(k) WHERE i + k - 1 <= len(words)),
h AS (SELECT doc_id, template, label, base, whole, n_grams, size, tpos, pos, pos - tpos AS diagonal FROM g JOIN t USING (gram)),
v AS (SELECT doc_id, template, label, base, whole, n_grams, size, diagonal, list(DISTINCT tpos) AS held, min(pos) AS first, max(pos) AS last
  FROM h GROUP BY ALL),
a AS (SELECT *, CASE WHEN NOT whole AND diagonal - lag(diagonal) OVER w <= {license_scan.BAND} THEN 0 ELSE 1 END AS apart
  FROM v WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)),
c AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS place FROM a),
m AS (SELECT doc_id, template, label, base, whole, n_grams, size, place, len(list_distinct(flatten(list(held)))) AS n_held, min(first) AS start, max(last) AS last
  FROM c GROUP BY ALL),
s AS (SELECT *, n_held / n_grams AS coverage FROM m WHERE CASE WHEN whole THEN n_held = n_grams
    ELSE n_held / n_grams >= {license_scan.COVERAGE} AND last + {license_scan.TEXT_GRAM} - start <= 1.5 * size + {license_scan.BAND} END)
SELECT d.doc_id, max(len(words)) AS n_words, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word,
  max(start) FILTER (WHERE base) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(coverage), 0.0)::DOUBLE AS score
FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of conversation c - c % 5, then c's own turns after its first h; h = crc32(c) % 9.

    The at most nine conversations with one base are in one partition, so a base's turns reach them without a join.
    """
    base = F.col("conv_id").cast("bigint") - F.col("conv_id").cast("bigint") % 5
    own = prefix_trie.keyed_turns(conversations, base)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    head = F.first(F.when(F.col("conv_id") == F.col("near"), F.slice("turns", 1, 8)), ignorenulls=True).over(
        Window.partitionBy("near").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    own = own.select("conv_id", "turns", h.alias("h"), F.coalesce(head, F.slice("turns", 1, 0)).alias("head"))
    return own.select("conv_id", F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


@query
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(rebuilt_paths(table(spark, sf_dir, "conversations"))).drop("turn_key")


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string in SQL: a byte, then eight shifts (-1) each, folded over one list."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    shift = "(c >> 1) # (CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)".replace("#", ", ")
    return f"xor(list_reduce(list_concat([4294967295], {bits}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor({shift}) END), 4294967295)"


ORACLE["op11_prefix_trie"] = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, role, strlen(text) AS bytes, substr(sha256(length(role) || ':' || role || text), 1, 32) AS key FROM t),
o AS (SELECT conv_id, list({{'key': key, 'bytes': bytes}} ORDER BY turn NULLS FIRST, role, key) AS turns,
    CAST({crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS BIGINT) AS h FROM k GROUP BY conv_id),
r AS (SELECT o.conv_id, list_concat(coalesce(b.turns[1 : o.h], []), o.turns[o.h + 1 : len(o.turns)]) AS path
  FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 5),
p AS (SELECT conv_id, d, len(path) = d AS ends, CASE WHEN d > 0 THEN path[d].bytes ELSE 0 END AS bytes,
    md5(array_to_string(list_transform(path[1 : d], lambda x: x.key), ',')) AS node,
    CASE WHEN d > 0 THEN md5(array_to_string(list_transform(path[1 : d - 1], lambda x: x.key), ',')) END AS parent
  FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM r)),
n AS (SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, max(parent) AS parent,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY node, d),
c AS (SELECT parent, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
v AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children, up.conv_id AS parent_conv_id
  FROM n LEFT JOIN c ON n.node = c.parent LEFT JOIN n up ON n.parent = up.node),
s AS (SELECT a.node, CAST(sum((v.n_convs - 1) * v.bytes) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves
  FROM v JOIN p a ON a.conv_id = v.conv_id AND a.d <= v.depth GROUP BY a.node)
SELECT v.conv_id, v.depth, v.parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256 FROM v JOIN s ON v.node = s.node
"""


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given the user's role by crc32(conv_id:turn) % 20; nulls are one space."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", known("conv_id"), known("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), kind.alias("kind")).where("kind > 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("n"))


@query
def op12_structure_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    rows = damaged(conversations)
    found = stage(repair.audits(rows), new_run_dir(spark, "repair-audits"))
    sums = repair.digests(repair.repaired(rows, found)).withColumnRenamed("conv_id", "sum_id")
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    done = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").join(sums, F.col("id").eqNullSafe(F.col("sum_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return done.select(
        F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


def _repair_sql() -> str:
    """The DP forwards in SQL, a (cost, audit) struct per grammar state; the least struct is the cheapest, then ASCII-least."""
    far = 1 << 40
    sound, pen = "r.fault NOT IN (1, 2)", "CASE WHEN r.fault = 3 THEN 5 ELSE 0 END"
    go = lambda s, cost, letter, when="true": f"{{'c': CASE WHEN {when} THEN f.{s}.c + {cost} ELSE {far} END, 'a': f.{s}.a || '{letter}'}}"
    keep = lambda s, initial: go(s, pen, "K", f"{sound} AND r.initial = '{initial}'")
    rerole = lambda s: go(s, f"1 + {pen}", "R", sound)
    least = lambda *x: f"list_sort([{', '.join(x)}])[1]"
    put = lambda s, n: f"{{'c': {s}.c + {5 * n}, 'a': {s}.a || '{'I' * n}'}}"
    return f"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS n FROM d WHERE kind > 0),
k AS (SELECT *, left(role, 1) AS initial, md5(length(role) || ':' || role || text) AS key,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, key) AS i FROM k),
r AS (SELECT *, CASE WHEN tail = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, key ORDER BY i) > 1 THEN 2
    WHEN tail NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM g),
m AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
    count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
    count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
f AS (
  SELECT conv_id, 0::BIGINT AS i, n, {{'c': 0::BIGINT, 'a': ''}} AS b, {{'c': {far}::BIGINT, 'a': ''}} AS s, {{'c': 5::BIGINT, 'a': 'I'}} AS u, {{'c': 10::BIGINT, 'a': 'II'}} AS a FROM m
  UNION ALL
  SELECT conv_id, i, n, b, s, {least("u", put("b", 1), put("s", 1), put("a", 1))} AS u, {least("a", put("u", 1), put("b", 2), put("s", 2))} AS a
  FROM (SELECT f.conv_id, f.i + 1 AS i, f.n, {go("b", 2, "D")} AS b, {least(go("s", 2, "D"), keep("b", "s"))} AS s,
      {least(go("u", 2, "D"), keep("b", "u"), keep("s", "u"), keep("a", "u"), rerole("b"), rerole("s"), rerole("a"))} AS u,
      {least(go("a", 2, "D"), keep("u", "a"), rerole("u"))} AS a
    FROM f JOIN r ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = f.i + 1)),
z AS (SELECT conv_id, list_sort([b, a])[1] AS best FROM f WHERE i = n),
l AS (SELECT conv_id, spot, substr(best.a, CAST(spot AS INTEGER), 1) AS letter FROM (SELECT *, unnest(range(1, length(best.a) + 1)) AS spot FROM z)),
p AS (SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER (PARTITION BY conv_id ORDER BY spot) AS i FROM l),
q AS (SELECT p.conv_id, p.spot, p.letter, CASE WHEN p.letter <> 'I' THEN r.text ELSE '' END AS text, CASE WHEN p.letter = 'K' THEN r.role END AS kept,
    row_number() OVER (PARTITION BY p.conv_id ORDER BY p.spot) AS pos
  FROM p LEFT JOIN r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND p.i = r.i AND p.letter <> 'I' WHERE p.letter <> 'D'),
t AS (SELECT *, CASE WHEN first_value(left(kept, 1)) OVER (PARTITION BY conv_id ORDER BY pos) = 's' THEN 1 ELSE 0 END AS ahead FROM q),
h AS (SELECT conv_id, sha256(string_agg(coalesce(kept, CASE WHEN (pos - ahead) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY pos)) AS sha
  FROM t GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN m ON o.conv_id IS NOT DISTINCT FROM m.conv_id
  LEFT JOIN z ON o.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN h ON o.conv_id IS NOT DISTINCT FROM h.conv_id
"""


ORACLE["op12_structure_repair"] = _repair_sql()


@query
def op13_html_extraction(spark, sf_dir):
    done = wrapper.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


#: The pages of the given tables keep their text in one ``article`` of headings and paragraphs.
ORACLE["op13_html_extraction"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1) AS body FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS plain FROM a),
d AS (SELECT page_id, url, regexp_replace(replace(replace(regexp_replace(plain, '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS plain FROM t)
SELECT page_id, url, trim(regexp_replace(plain, '\s+', ' ', 'g')) AS text, CAST(length(trim(regexp_replace(plain, '\s+', ' ', 'g'))) AS BIGINT) AS n_chars FROM d
"""
