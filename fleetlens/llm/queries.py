"""Registered queries of the package: each operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import (
    embeddedup, gnat, langid, linededup, mixing, neighbours, packing, pii, reversed_search, secret_scan, sharding, simhash, warc)
from fleetlens.llm.common import small_batches, table
from fleetlens.session import prepare, written

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(small_batches(prepare(spark)), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_cube_mixing")
def cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.decide(table(spark, sf_dir, "documents")))


@query("op2_jump_sharding")
def jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_slots(table(spark, sf_dir, "documents"), 24)


@query("op3_line_dedup")
def deduped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(table(spark, sf_dir, "documents"))


@query("op4_language_id")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op5_simhash_dedup")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.clusters(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op6_secret_scan")
def secrets_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_documents(table(spark, sf_dir, "documents"))

    def of(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id", *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secret_scan.listed(of("assign", "access", "hex")).cast("binary"), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"), F.size(of("literal")).cast("long").alias("n_literal"))


@query("op7_prefix_forest")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select(F.col("query_id").cast("long").alias("query_id"), F.col("rank").cast("int").alias("rank"),
                        "vec_id", "score")


@query("op8_embedding_dedup")
def embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddedup.clusters(table(spark, sf_dir, "embeddings"))


@query("op9_retrieval_packing")
def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


@query("op10_warc_packages", sql="""
    WITH own AS (
      SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
      FROM pages),
    firsts AS (SELECT payload_digest, min(page_id) AS first FROM own WHERE payload_bytes >= 100 GROUP BY payload_digest)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
      CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN page_id > first THEN first END AS refers_to
    FROM own LEFT JOIN firsts USING (payload_digest)""")
def warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return records.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
                          "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def _codes_sql() -> str:
    """Six rounds over ``x`` (vector, part, position, number) and codebooks ``b0`` to ``b6``, spelled out."""
    steps = ["""
    kept AS MATERIALIZED (
      SELECT vec_id, label, [floor(4096 * c::DOUBLE)::BIGINT for c in embedding] AS v, len(embedding) // 8 AS width
      FROM embeddings WHERE embedding IS NOT NULL AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0),
    x AS MATERIALIZED (
      SELECT vec_id, (i - 1) // width AS p, (i - 1) % width AS i, c
      FROM (SELECT vec_id, width, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM kept)),
    b0 AS MATERIALIZED (
      SELECT p, e, i, c AS y FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) USING (vec_id)
      WHERE e < 16)"""]
    for r in range(7):
        steps.append(f"""
    d{r} AS MATERIALIZED (
      SELECT vec_id, p, e, sum((c - y) * (c - y))::BIGINT AS d FROM x JOIN b{r} USING (p, i) GROUP BY vec_id, p, e),
    a{r} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, d * 16 + e) AS e, min(d) AS d FROM d{r} GROUP BY vec_id, p)""")
        if r < 6:
            steps.append(f"""
    b{r + 1} AS MATERIALIZED (
      SELECT p, e, i, coalesce(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END, y)::BIGINT AS y
      FROM b{r} LEFT JOIN (SELECT p, e, i, sum(c)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id, p) GROUP BY p, e, i)
        USING (p, e, i))""")
    return "WITH" + ",".join(steps) + """,
    coded AS (
      SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY vec_id)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
      (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, e, i)) FROM b6) AS codebooks_sha256
    FROM coded JOIN kept USING (vec_id)"""


@query("op11_gnat_codes", sql=_codes_sql())
def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = gnat.learn(vectors)
    coded = gnat.encode(vectors, books).select(
        F.col("row.vec_id").cast("long").alias("vec_id"), F.col("row.label").alias("label"), "code", "error")
    told = gnat.with_label_error(written(coded, "codes"))
    return told.select("vec_id", "code", "error", "label_error",
                       F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


@query("op12_reversed_search", sql=r"""
    WITH cut AS (
      SELECT doc_id, row_number() OVER () AS r,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
      FROM documents),
    held AS MATERIALIZED (SELECT r, doc_id, terms, len(terms) AS n FROM cut WHERE len(terms) > 0),
    total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM held),
    tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM held) GROUP BY r, term),
    w AS (
      SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
    asked AS (
      SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
      GROUP BY item_id, term),
    m AS (SELECT r, doc_id, 75 + (25 * n * docs) // words AS m FROM held, total),
    sums AS (
      SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id),
    best AS (
      SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
      FROM sums WHERE score > 0)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM best WHERE rank <= 20""")
def ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reversed_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_char_tagger_pii")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan_documents(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["by"] == "pattern")

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"),
                        pii.listed(F.col("spans")).alias("spans"))
