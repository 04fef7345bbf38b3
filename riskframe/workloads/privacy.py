"""Masking and restoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.operators import tokens
from riskframe.workloads import views
from riskframe.workloads.registry import query


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as notes that hold one value of every category, partly inside each other."""
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    number = F.col("page_id")
    text = F.concat(
        F.lit("Bearer "), F.md5(host), F.lit(" opened "), F.col("url"),
        F.lit(" then https://x.example.com/cb?token="), F.md5(F.concat(F.lit("k"), host)),
        F.lit(" mail ops"), (number % 50).cast("string"), F.lit("@"), host,
        F.lit(" from 10.0."), (number % 7).cast("string"), F.lit("."),
        (number % 11).cast("string"), F.lit(" call +1 (017) 555-"),
        F.lpad((number % 100).cast("string"), 4, "0"),
    )
    return views.table(spark, sf_dir, "pages").select(number.alias("key"), text.alias("text"))


_NOTES = """
notes AS (
  SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages),
found AS (
  SELECT page_id, 0 AS spot, 'TOKEN' AS category, 'Bearer ' || md5(host) AS value FROM notes
  UNION ALL SELECT page_id, 0, 'APIKEY', md5('k' || host) FROM notes
  UNION ALL SELECT page_id, 0, 'URL', url FROM notes
  UNION ALL SELECT page_id, 1, 'URL', 'https://x.example.com/cb?token=' || md5('k' || host) FROM notes
  UNION ALL SELECT page_id, 0, 'EMAIL', 'ops' || page_id % 50 || '@' || host FROM notes
  UNION ALL SELECT page_id, 0, 'IP', '10.0.' || page_id % 7 || '.' || page_id % 11 FROM notes
  UNION ALL SELECT page_id, 0, 'PHONE', '+1 (017) 555-' || lpad(CAST(page_id % 100 AS VARCHAR), 4, '0')
    FROM notes),
firsts AS (SELECT category, value, min(page_id * 2 + spot) AS seen FROM found GROUP BY 1, 2),
numbered AS (
  SELECT category, value, row_number() OVER (PARTITION BY category ORDER BY seen) AS seq FROM firsts),
tokens AS (
  SELECT category, value, seq, '[' || category || '_' || CASE WHEN seq < 1000
         THEN lpad(CAST(seq AS VARCHAR), 3, '0') ELSE CAST(seq AS VARCHAR) END || ']' AS token
  FROM numbered)"""


@query(
    "w7_tokens",
    f"""WITH {_NOTES}, keys AS (SELECT value, token FROM tokens WHERE category = 'APIKEY')
    SELECT CASE WHEN t.value LIKE 'https://x.example.com/cb?token=%'
                THEN 'https://x.example.com/cb?token=' || keys.token ELSE t.value END AS original,
           t.token, t.category, t.seq
    FROM tokens t LEFT JOIN keys ON keys.value = right(t.value, 32) AND t.category = 'URL'""",
)
def token_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens in order of first appearance, nested ones included."""
    return tokens.mask_table(_notes(spark, sf_dir), ["text"])[1]


@query(
    "c10_masked",
    f"""WITH {_NOTES}, lists AS (
      SELECT n.page_id AS key,
             max(CASE WHEN f.category = 'TOKEN' THEN token END) AS bearer,
             max(CASE WHEN f.category = 'URL' AND f.spot = 0 THEN token END) AS url,
             max(CASE WHEN f.category = 'URL' AND f.spot = 1 THEN token END) AS callback,
             max(CASE WHEN f.category = 'EMAIL' THEN token END) AS email,
             max(CASE WHEN f.category = 'IP' THEN token END) AS ip,
             max(CASE WHEN f.category = 'PHONE' THEN token END) AS phone
      FROM notes n JOIN found f USING (page_id) JOIN tokens t USING (category, value) GROUP BY 1)
    SELECT key, bearer || ' opened ' || url || ' then ' || callback || ' mail ' || email || ' from '
           || ip || ' call ' || phone AS text
    FROM lists""",
)
def masked_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked notes."""
    return tokens.mask_table(_notes(spark, sf_dir), ["text"])[0]


@query(
    "c10_hits",
    r"""WITH t0 AS (SELECT doc_id, text FROM documents),
    urls AS (SELECT doc_id, len(regexp_extract_all(text, 'https?://[^\s<>"'']+')) AS n,
                    regexp_replace(text, 'https?://[^\s<>"'']+', '|', 'g') AS text FROM t0),
    mails AS (SELECT doc_id, len(regexp_extract_all(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+')) AS n,
                     regexp_replace(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+', '|', 'g') AS text FROM urls),
    ips AS (SELECT doc_id, len(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b')) AS n,
                   regexp_replace(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b', '|', 'g') AS text FROM mails),
    phones AS (SELECT doc_id, len(regexp_extract_all(text,
        '(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{2,4}\b')) AS n FROM ips),
    hits AS (SELECT 'URL' AS category, doc_id, n FROM urls UNION ALL SELECT 'EMAIL', doc_id, n FROM mails
             UNION ALL SELECT 'IP', doc_id, n FROM ips UNION ALL SELECT 'PHONE', doc_id, n FROM phones)
    SELECT doc_id, category, n AS hits FROM hits WHERE n > 0""",
)
def document_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits per document and category in the raw texts."""
    documents = views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"), "text"
    )
    return tokens.count_hits(documents, ["text"]).select(
        F.col("row").alias("doc_id"), "category", "hits"
    )


@query("p9_mask_documents", "SELECT count(*) AS documents, 0 AS still_visible FROM documents")
def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9 over all documents; nothing the strict patterns know stays visible."""
    documents = views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"), "text"
    )
    masked, _ = tokens.mask_table(documents, ["text"])
    left = tokens.count_hits(masked, ["text"]).agg(F.count("*"))
    return masked.agg(F.count("*").alias("documents")).select(
        "documents", left.scalar().alias("still_visible")
    )


@query("j14_restore", "SELECT doc_id AS key, md5(text) AS digest FROM documents")
def restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masking and restoring gives the texts back."""
    documents = views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"), "text"
    )
    masked, entries = tokens.mask_table(documents, ["text"])
    back = tokens.restore_texts(masked, "text", entries)
    return back.select("key", F.md5("text").alias("digest"))


@query(
    "j14_restore_nested",
    """WITH notes AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages)
    SELECT page_id AS key, 'Bearer ' || md5(host) || ' opened ' || url
           || ' then https://x.example.com/cb?token=' || md5('k' || host) || ' mail ops' || page_id % 50
           || '@' || host || ' from 10.0.' || page_id % 7 || '.' || page_id % 11
           || ' call +1 (017) 555-' || lpad(CAST(page_id % 100 AS VARCHAR), 4, '0') AS text
    FROM notes""",
)
def restored_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14 with tokens inside restored values."""
    masked, entries = tokens.mask_table(_notes(spark, sf_dir), ["text"])
    return tokens.restore_texts(masked, "text", entries)


@query(
    "c11_mask_record",
    """WITH hashed AS (SELECT page_id, '[URL_' || left(sha256(url), 8) || ']' AS token FROM pages)
    SELECT page_id AS key, token AS first_link, 'plain' AS second_link, token AS home, 'plain' AS note
    FROM hashed""",
)
def masked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: plain, list and map columns of one record."""
    pages = views.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("key"),
        F.array("url", F.lit("plain")).alias("links"),
        F.create_map(F.lit("home"), F.col("url"), F.lit("note"), F.lit("plain")).alias("extra"),
    )
    masked, _ = tokens.mask_table(pages, ["links", "extra"], tokens="hash")
    return masked.select(
        "key",
        F.get("links", F.lit(0)).alias("first_link"),
        F.get("links", F.lit(1)).alias("second_link"),
        F.col("extra.home").alias("home"),
        F.col("extra.note").alias("note"),
    )


@query(
    "c10_hash_tokens",
    """WITH notes AS (SELECT page_id, url FROM pages)
    SELECT page_id AS key, 'see [URL_' || left(sha256(url), 8) || ']' AS text FROM notes""",
)
def hash_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10 with digests instead of numbers."""
    pages = views.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("key"), F.concat(F.lit("see "), F.col("url")).alias("text")
    )
    return tokens.mask_table(pages, ["text"], tokens="hash")[0]


