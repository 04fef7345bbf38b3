"""The registered queries of the operators of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_suffix_array_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.llm.suffix_dedup import dedup_bytes

    return dedup_bytes(table(spark, sf_dir, "documents"), with_kept=False)


@query("op11_tokenizer_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.llm.alignment import align_documents

    return align_documents(table(spark, sf_dir, "documents"))


@query("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.llm.sentencepiece_sampling import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), with_ids=False)


@query("op2_embedding_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.llm.embedding_dedup import embedding_links

    return embedding_links(table(spark, sf_dir, "embeddings"))


@query("op3_lm_scoring")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.llm.language_model import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def _cut(found: DataFrame) -> DataFrame:
    """Digest of documents whose text was cut."""
    return found.select(
        "doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"),
    )


@query("op5_line_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.llm.line_dedup import dedup_lines

    return _cut(dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op6_ngram_jaccard_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.llm.ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"))


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.llm.quality import fit_quality, judged

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, fit_quality(docs, table(spark, sf_dir, "labels"))).drop("text")


OP8_SQL = """
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(rule_host, rule_path, what) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fitting AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(what, length(rule_host || rule_path)) AS what
  FROM parts, rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT page_id, host, path, rule,
       coalesce(what, CASE WHEN list_has_any(string_split_regex(host, '[.-]'),
         ['ads', 'spam', 'casino', 'adult', 'pills', 'bets']) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fitting USING (page_id)
"""


@query("op8_url_filters", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.llm.url_filters import judged_urls

    return judged_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


@query("op9_substring_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.llm.paragraph_dedup import dedup_paragraphs

    return _cut(dedup_paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text")))


OP12_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id) AS h
  FROM documents),
numbers AS (
  SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS one,
         ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS two,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
cut AS (
  SELECT *, least(one, two) AS a, greatest(one, two) AS b FROM numbers)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
         WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
         ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a)
         END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""


@query("op12_fill_in_middle", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.llm.fill_in_middle import fill_in_middle, restored

    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
        F.sha2("fim.output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("fim.output"), F.col("fim.form")), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH RECURSIVE sized AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(sha256('13:=' || doc_id || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS place
  FROM documents),
sources AS MATERIALIZED (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM sized GROUP BY source),
levels(round, level, n) AS (
  SELECT 0, (SELECT sum(source_size)::DOUBLE / sum(weight) FROM sources), 0::BIGINT
  UNION ALL
  SELECT * FROM (
    SELECT round + 1,
           ((SELECT sum(source_size) FROM sources)::DOUBLE
             - sum(CASE WHEN 3.0 * source_size <= level * weight THEN 3.0 * source_size ELSE 0 END)::DOUBLE)
           / sum(CASE WHEN 3.0 * source_size <= level * weight THEN 0 ELSE weight END)::DOUBLE,
           count(*) FILTER (WHERE 3.0 * source_size <= level * weight) AS clamped
    FROM levels, sources GROUP BY round, level, n
    HAVING count(*) FILTER (WHERE 3.0 * source_size <= level * weight) > n
       AND sum(CASE WHEN 3.0 * source_size <= level * weight THEN 0 ELSE weight END) > 0)),
targets AS MATERIALIZED (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, weight * (SELECT arg_max(level, round) FROM levels)) AS target
  FROM sources),
parts AS MATERIALIZED (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
entries AS MATERIALIZED (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY place, doc_id) AS k
  FROM sized WHERE size > 0),
scan(source, k, doc_id, size, room, misfit, fits) AS (
  SELECT source, 0::BIGINT, NULL::BIGINT, 0::BIGINT, target - whole * source_size, NULL::BIGINT, false FROM parts
  UNION ALL
  SELECT e.source, e.k, e.doc_id, e.size, CASE WHEN e.size <= s.room THEN s.room - e.size ELSE s.room END,
         CASE WHEN e.size > s.room THEN coalesce(s.misfit, e.k) ELSE s.misfit END, e.size <= s.room
  FROM scan s JOIN entries e ON e.source IS NOT DISTINCT FROM s.source AND e.k = s.k + 1
  WHERE s.misfit IS NULL OR e.k <= s.misfit + 500),
ends AS (
  SELECT source, min(room) AS room, max(misfit) AS misfit,
         max(CASE WHEN k = misfit THEN size - room END) AS excess FROM scan GROUP BY source),
chosen AS (
  SELECT scan.doc_id FROM scan JOIN ends ON scan.source IS NOT DISTINCT FROM ends.source
  WHERE k > 0 AND CASE WHEN excess < ends.room THEN k <= ends.misfit ELSE fits END)
SELECT sized.doc_id, sized.size, parts.source_size, parts.target,
       sized.size * (parts.whole + CASE WHEN chosen.doc_id IS NULL THEN 0 ELSE 1 END) AS taken
FROM sized JOIN parts ON sized.source IS NOT DISTINCT FROM parts.source LEFT JOIN chosen USING (doc_id)
"""


@query("op13_source_mixing", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.llm.mixing import mixture

    found = mixture(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE
