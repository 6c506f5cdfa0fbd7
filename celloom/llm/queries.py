"""The queries of this subpackage and, where SQL can express them, the same results in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celloom.llm import decontamination, html, ngram_join, packing, pii, quality, sharding, spotsigs, urls, warc
from celloom.session import scratch_path, stored, table


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    )
    placed = sharding.shard(docs, "doc_id", [1.0] * 40, order=["text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", sharding.rendezvous(F.col("doc_id"), [1.0] * 41).alias("grown_shard"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = spotsigs.with_edits(table(spark, sf_dir, "documents")).withColumn("edited_found", spotsigs.signatures(F.col("edited")))
    found, edited, following = F.col("found"), F.col("edited_found"), F.col("next_found")
    return edits.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), spotsigs.as_text(found).alias("fingerprint"), spotsigs.as_text(edited).alias("edited_fingerprint"),
        spotsigs.likeness(found, edited).alias("near_edited"), spotsigs.likeness(found, following).alias("near_next"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    scheme = folder.partition("://")[0] + "://" if "://" in folder else "file://"
    written = stored(warc.write(warc.plan_records(table(spark, sf_dir, "pages")), folder), "warc-files")
    files = written.select(F.concat(F.lit(scheme), "file").alias("file")).repartition(max(1, min(written.count(), 10_000)))
    records = written.agg(F.sum("records")).first()[0] or 0
    back = warc.checked(warc.read(spark, files, payloads=False), records, scratch_path(spark, "warc-check"))
    return back.select("page_id", F.col("full_bytes").alias("payload_bytes"), "payload_digest", F.col("kind").alias("record_type"), warc.urn_page(F.col("refers_to")).alias("refers_to"))


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_shard, op2_ngram_join, op3_html, op4_decontaminate, op5_pack, op6_pii, op7_spotsigs, op8_warc, op9_urls, op10_quality)}


_OP8 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS keeper FROM d)
SELECT page_id, payload_bytes,
  list_reduce(list_transform(range(0, 8), lambda g: list_reduce(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * g, 5))::INTEGER >> s) & 31)::INTEGER, 1)), lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM k
"""

_OP9 = """
WITH rules(r_host, r_path, r_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
u AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
m AS (SELECT page_id, r_host || r_path AS rule, r_verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(r_host) DESC, length(r_path) DESC) AS k
  FROM u JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT u.page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM u LEFT JOIN m ON m.page_id = u.page_id AND k = 1
"""


_SHINGLES = """
  SELECT {key}, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE
    list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
  FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') AS w FROM {table})
"""

_OP4 = f"""
WITH d AS ({_SHINGLES.format(key="doc_id", table="documents")}), i AS ({_SHINGLES.format(key="item_id", table="benchmark")}),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared::DOUBLE / n_item AS containment FROM m JOIN n USING (item_id) WHERE n_shared >= 0.8::DOUBLE * n_item - 1e-9
"""


_OP2 = f"""
WITH RECURSIVE t AS (SELECT text, min(doc_id) AS doc_id, count(*) AS weight FROM documents GROUP BY text),
s AS MATERIALIZED ({_SHINGLES.format(key="doc_id", table="t")}), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8::DOUBLE * (x.n + y.n - c) - 1e-9),
r AS (SELECT doc_id AS a, doc_id AS root FROM t UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.a),
g AS (SELECT a, min(root) AS class_id FROM r GROUP BY a), k AS (SELECT a, sum(weight)::BIGINT AS links FROM l JOIN t ON t.doc_id = b GROUP BY a)
SELECT d.doc_id AS doc_id, t.doc_id AS copy_of, class_id, (coalesce(links, 0) + weight - 1)::BIGINT AS n_links
FROM documents d JOIN t ON t.text = d.text JOIN g ON g.a = t.doc_id LEFT JOIN k ON k.a = t.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": _OP2, "op4_decontaminate": _OP4, "op8_warc": _OP8, "op9_urls": _OP9}
