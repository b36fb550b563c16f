"""The registered queries of this subpackage, each over whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickmart.llm import (
    collocations,
    curriculum,
    decontaminate,
    lexical_search,
    license_scan,
    line_dedup,
    lm_interpolation,
    packing,
    quality_rules,
    repeats,
    simhash_dedup,
    sql,
    token_counts,
    url_lists,
)


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lm_scores_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_interpolation.interpolated_scores(_table(spark, sf_dir, "documents"))


def listed_hosts(pages: DataFrame) -> DataFrame:
    """List entries for the hosts of ``pages``: which host is listed where and when follows from the digits of its MD5."""
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    digits = lambda start, n: F.conv(F.substring(F.md5(F.col("host").cast("binary")), start, n), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    kinds = hosts.select("host", (digits(1, 2) % 6).alias("k"), (digits(3, 3) % 300).alias("d"), (digits(6, 2) % 50 + 5).alias("length"))
    junk = F.col("host").contains("spam-farm") | F.col("host").contains("cheap-pills")
    below = F.substring_index("host", ".", -3)
    entry = lambda name, kind, key, action, on: F.struct(
        F.lit(name).alias("list"), F.lit(kind).alias("kind"), key.alias("key"), F.lit(action).alias("action"), day(on).alias("day")
    )
    d, again = F.col("d"), F.col("d") + 2 * F.col("length")
    k = F.col("k")
    entries = (
        F.when(junk, F.array(entry("spam", "host", F.col("host"), "add", F.lit(0))))
        .when(
            k == 0,
            F.array(
                entry("spam", "host", F.col("host"), "add", d),
                entry("spam", "host", F.col("host"), "remove", d + F.col("length")),
                entry("spam", "host", F.col("host"), "add", again),
            ),
        )
        .when(k == 1, F.array(entry("adult", "domain", below, "add", d), entry("adult", "domain", below, "remove", again)))
        .when(k == 2, F.array(entry("phish", "path", F.concat("host", F.lit("/en")), "add", d)))
        .when(k == 3, F.array(entry("spam", "domain", F.col("host"), "add", d), entry("allow", "host", F.col("host"), "add", again)))
    )
    return kinds.select(F.explode(entries).alias("e")).select("e.*")


def url_lists_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture of the day that its id gives, against the lists of hosts."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int"))
    captures = pages.withColumn("fetched_on", day)
    judged = url_lists.on_lists(captures, listed_hosts(pages), "url", "fetched_on")
    return judged.select("page_id", "fetched_on", "host", F.array_join("lists", ",").alias("lists"), "blocked")


URL_LISTS_SQL = r"""
WITH pages_ AS (
  SELECT page_id, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched_on,
    regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.+$', '') AS host,
    lower(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '')) AS path
  FROM pages),
hosts AS (
  SELECT host, CAST('0x' || substr(md5(host), 1, 2) AS INTEGER) % 6 AS k, CAST('0x' || substr(md5(host), 3, 3) AS INTEGER) % 300 AS d,
    CAST('0x' || substr(md5(host), 6, 2) AS INTEGER) % 50 + 5 AS n,
    host LIKE '%spam-farm%' OR host LIKE '%cheap-pills%' AS junk,
    array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') AS below
  FROM (SELECT DISTINCT host FROM pages_ WHERE host <> '')),
entries AS (
  SELECT 'spam' AS list, 'host' AS kind, host AS key, true AS adds, 0 AS day FROM hosts WHERE junk
  UNION ALL SELECT 'spam', 'host', host, true, d FROM hosts WHERE NOT junk AND k = 0
  UNION ALL SELECT 'spam', 'host', host, false, d + n FROM hosts WHERE NOT junk AND k = 0
  UNION ALL SELECT 'spam', 'host', host, true, d + 2 * n FROM hosts WHERE NOT junk AND k = 0
  UNION ALL SELECT 'adult', 'domain', below, true, d FROM hosts WHERE NOT junk AND k = 1
  UNION ALL SELECT 'adult', 'domain', below, false, d + 2 * n FROM hosts WHERE NOT junk AND k = 1
  UNION ALL SELECT 'phish', 'path', host || '/en', true, d FROM hosts WHERE NOT junk AND k = 2
  UNION ALL SELECT 'spam', 'domain', host, true, d FROM hosts WHERE NOT junk AND k = 3
  UNION ALL SELECT 'allow', 'host', host, true, d + 2 * n FROM hosts WHERE NOT junk AND k = 3),
latest AS (
  SELECT p.page_id, e.list, e.kind, e.key, max(e.day) AS day
  FROM pages_ p JOIN entries e ON DATE '2024-01-01' + CAST(e.day AS INTEGER) <= p.fetched_on AND p.host <> ''
    AND ((e.kind = 'host' AND p.host = e.key)
      OR (e.kind = 'domain' AND (p.host = e.key OR ends_with(p.host, '.' || e.key)))
      OR (e.kind = 'path' AND (p.host || p.path = e.key OR starts_with(p.host || p.path, e.key || '/'))))
  GROUP BY ALL),
active AS (
  SELECT DISTINCT l.page_id, l.list FROM latest l
  JOIN (SELECT list, kind, key, day, bool_and(adds) AS adds FROM entries GROUP BY ALL) e USING (list, kind, key, day) WHERE e.adds),
listed AS (SELECT page_id, string_agg(list, ',' ORDER BY list) AS lists, bool_or(list = 'allow') AS excepted FROM active GROUP BY 1)
SELECT p.page_id, p.fetched_on, p.host, coalesce(l.lists, '') AS lists, coalesce(NOT l.excepted, false) AS blocked
FROM pages_ p LEFT JOIN listed l USING (page_id)
"""


def license_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("detections")


def token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def substring_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(_table(spark, sf_dir, "documents"))


def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts="counts")
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return done.select("doc_id", "counts.n_lines", "counts.n_dropped", kept.alias("kept_sha256"))


def quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).drop("rejected_by", "rules_tried")


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json")))


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), length=3, limit=2)


def decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), short=True)
    return found.select("doc_id", "item_id", "coverage", F.size("tiles").alias("n_tiles"))


def schedules_of(docs: DataFrame) -> DataFrame:
    """Schedules for the sources in the order of their code points: mean weights 1, 2, 3, repeating; the first kind falls,
    the second rises, the third does both."""
    sources = docs.select("source").distinct()
    number = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    point = lambda at, weight: F.struct(F.lit(at).alias("at"), F.lit(weight).alias("weight"))
    kinds = (
        F.when(F.col("k") == 0, F.array(point(0.0, 1.5), point(1.0, 0.5)))
        .when(F.col("k") == 1, F.array(point(0.0, 1.0), point(1.0, 3.0)))
        .otherwise(F.array(point(0.0, 1.5), point(0.5, 4.5), point(1.0, 1.5)))
    )
    return sources.withColumn("k", number % 3).select("source", F.explode(kinds).alias("p")).select("source", "p.*")


def curriculum_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first_place is the training time of a document's first copy, in billionths of the training; -1 if none is taken."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = curriculum.mixture(docs, schedules_of(docs))
    place = F.coalesce(F.floor(F.get("copies", F.lit(0))["position"] * 1e9), F.lit(-1))
    mixed = mixed.select("doc_id", "size", "source_size", "target", "taken", place.alias("first_place"))
    return mixed.orderBy("first_place", "doc_id")


def collocations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def lexical_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_lm_scoring": lm_scores_query,
        "op2_url_filters": url_lists_query,
        "op3_line_dedup": line_dedup_query,
        "op4_quality_rules": quality_rules_query,
        "op5_license_scan": license_scan_query,
        "op6_token_counts": token_counts_query,
        "op7_best_fit_packing": packing_query,
        "op8_simhash_near_dedup": simhash_query,
        "op9_substring_dedup": substring_dedup_query,
        "op10_benchmark_decontamination": decontaminate_query,
        "op11_curriculum_mix": curriculum_query,
        "op12_phrase_collocations": collocations_query,
        "op13_lexical_search": lexical_search_query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filters": URL_LISTS_SQL,
        "op3_line_dedup": sql.LINE_DEDUP,
        "op4_quality_rules": sql.QUALITY_RULES,
        "op11_curriculum_mix": sql.CURRICULUM,
        "op12_phrase_collocations": sql.COLLOCATIONS,
        "op13_lexical_search": sql.LEXICAL_SEARCH,
    }
