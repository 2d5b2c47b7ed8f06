"""Registered queries of the operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratabranch.llm import decontam, exact_dedup, html_mincut, langid, line_dedup, mixing, packing, quality, simhash, warc
from stratabranch.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_table(table(spark, sf_dir, "documents")).drop("slot")


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    places = F.array_join(F.transform("matches", lambda m: F.concat_ws("+", m["at"].cast("string"), m["length"].cast("string"))), ",")
    return found.withColumn("n_matches", F.size("matches").cast("long")).withColumn("matches", places)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mincut.extract(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents")).drop("bitmap")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(langid.sample_windows(docs)))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_decontam": op3_decontam,
    "op4_simhash": op4_simhash,
    "op5_html": op5_html,
    "op6_mixing": op6_mixing,
    "op7_line_dedup": op7_line_dedup,
    "op8_packing": op8_packing,
    "op9_langid": op9_langid,
    "op10_warc": op10_warc,
}

ORACLES: dict[str, str] = {
    "op10_warc": r"""
WITH n AS (SELECT greatest(1, CAST(ceil(count(*) / 2000.0) AS BIGINT)) AS files FROM pages),
p AS (
  SELECT page_id, coalesce(html, '') AS body, coalesce(url, '') AS url,
         CAST('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS num FROM pages
), r AS (
  SELECT page_id, num, CAST(num % files AS INTEGER) AS file,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
         || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'null') || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Date: 2026-01-01T00:00:00Z' || chr(13) || chr(10)
         || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body) || chr(13) || chr(10)
         || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM p, n
), a AS (
  SELECT page_id, num, file, strlen(record) AS length, sha256(record) AS sha256 FROM r
), o AS (
  SELECT *, row_number() OVER w - 1 AS ordinal, CAST(sum(length) OVER w AS BIGINT) - length AS offset,
         CAST(sum(CASE WHEN num % 16001 = 8920 THEN 0 ELSE length END) OVER w AS BIGINT) - length AS replica
  FROM a WINDOW w AS (PARTITION BY file ORDER BY page_id NULLS FIRST, sha256 ROWS UNBOUNDED PRECEDING)
)
SELECT page_id, file, ordinal, "offset", length, sha256,
       CASE WHEN num % 16001 = 8920 THEN 'missing' WHEN num % 251 = 75 THEN 'corrupt'
            WHEN replica <> "offset" THEN 'moved' ELSE 'ok' END AS status
FROM o
""",
    "op2_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), half AS (SELECT (min(doc_id) + max(doc_id)) // 2 AS mid FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256,
       coalesce(bool_or(doc_id <= (SELECT mid FROM half)) OVER w, false) AS in_history
FROM d WINDOW w AS (PARTITION BY text_sha256)
""",
    "op3_decontam": r"""
WITH lower_a_to_z AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), pos AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM lower_a_to_z
), found AS (
  SELECT p.doc_id, p.i, g.n, win.item_id
  FROM (SELECT DISTINCT n FROM win) g JOIN pos p ON p.i + g.n - 1 <= len(p.w)
  JOIN win ON win.n = g.n AND win.s = array_to_string(p.w[p.i : p.i + g.n - 1], ' ')
), hits AS (
  SELECT doc_id, count(DISTINCT h) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS h FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id
), same AS (
  SELECT doc_id, item_id, r, p.i AS p, q.i AS q
  FROM (SELECT doc_id, i, array_to_string(w[i : i + 3], ' ') AS s FROM pos WHERE i + 3 <= len(w)) p
  JOIN (SELECT item_id, r, i, array_to_string(w[i : i + 3], ' ') AS s
        FROM (SELECT item_id, r, w, unnest(range(1, len(w) - 2)) AS i
              FROM (SELECT CAST(item_id AS VARCHAR) AS item_id, row_number() OVER () AS r, w FROM b WHERE len(w) >= 4))) q ON p.s = q.s
), runs AS (
  SELECT *, p - row_number() OVER (PARTITION BY doc_id, r, p - q ORDER BY p) AS run FROM same
), far AS (
  SELECT doc_id, item_id, p, q, max(p) OVER (PARTITION BY doc_id, r, p - q, run) - p + 4 AS n FROM runs
), best AS (
  SELECT doc_id, item_id, p, q, n FROM far QUALIFY row_number() OVER (PARTITION BY doc_id, p ORDER BY n DESC, item_id, q) = 1
), maximal AS (
  SELECT * FROM best
  QUALIFY NOT coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) = p - 1 AND lag(n) OVER (PARTITION BY doc_id ORDER BY p) > n, false)
), top AS (
  SELECT doc_id, max(n) AS longest, arg_min(p, (-n, p)) - 1 AS longest_at, arg_min(item_id, (-n, p)) AS longest_item,
         arg_min(q, (-n, p)) - 1 AS longest_item_at, count(*) AS n_matches, string_agg((p - 1) || '+' || n, ',' ORDER BY p) AS matches
  FROM maximal GROUP BY doc_id
)
SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated,
       coalesce(longest, 0) AS longest, longest_at, longest_item, longest_item_at, coalesce(n_matches, 0) AS n_matches, coalesce(matches, '') AS matches
FROM lower_a_to_z l LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN top USING (doc_id)
""",
    "op7_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d
), k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT k.doc_id, pos, line, coalesce(f.first <> k.doc_id, false) AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
}
