"""Queries of the training-data operators: one per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, media_sniff, mixing, quality_gam, secret_scan, simhash, spot_signatures, substring_dedup, token_store, url_rules, warc_store, word_runs
from .common import materialise, table

#: The rules of op6 (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def tokenizer_path() -> str:
    """Place of the public byte-level BPE file; callers of the operator pass their own."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that repeat earlier text, one row each; documents without repeats give none."""
    spans = substring_dedup.repeated_spans(table(spark, sf_dir, "documents"), whole_lines=True)
    return spans.select(F.col("id").alias("doc_id"), F.col("start").alias("start_char"), F.col("stop").alias("stop_char"), F.col("words").alias("n_words"), "n_units", F.col("kept_id").alias("kept_doc_id"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, one row each; clean documents give none."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.measured(table(spark, sf_dir, "documents")))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_gam.score(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), quality_gam.is_held_out("id").alias("held_out"), "score", "predicted")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_sniff.media_features(media_sniff.stored_media(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return url_rules.judged(table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", F.col("listed").alias("spans"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = token_store.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
    return token_store.read_documents(blocks).withColumnRenamed("id", "doc_id")


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, payloads = warc_store.archive(table(spark, sf_dir, "pages"))
    digests = materialise(warc_store.restored_payloads(records, payloads), "warc-read")
    read = warc_store.record_fields(records).select("id", "digest", "record_type", "refers_to").join(digests, "digest")
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spot_signatures.edited_copies(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("signatures", "").alias("fingerprint"),
        F.array_join("edited_signatures", "").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """Text of one document in ten with its words from ``a`` on replaced by those of the first ``p`` of them over and over."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    places = F.sequence(F.lit(0), F.size("w") - 1)

    def cycled(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        picked = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")))
        return F.when(n > 0, F.array_join(picked, " "))

    spelled = F.array(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    return docs.withColumn("text", F.when(F.pmod(h, F.lit(10)) == 0, F.get(F.transform(spelled, cycled), F.lit(0))).otherwise(F.col("text")))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs.word_runs(_with_planted_periods(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))
    found = found.withColumn("longest", F.get(F.sort_array(ranked), F.lit(0)))
    length, period = -F.col("longest.shorter"), F.col("longest.period")
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = centroids.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, 64)
    found, final = centroids.clusters(vectors, k=16, rounds=3, seed="1:")
    told = centroids.with_inertia(found).withColumn("centroid_sha256", centroids.digests(final))
    return told.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_benchmark_decontamination, op3_source_mixing, op4_quality_classifier, op5_media_columns,
        op6_url_filters, op7_secret_scan, op8_token_output, op9_warc_archive, op10_simhash_near_dedup,
        op11_document_fingerprints, op12_word_runs, op13_centroid_clustering,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), o AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight FROM s
), r AS (
  SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS k,
         sum(source_size) OVER () AS total FROM o
), f AS (
  SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM r
), g AS (
  SELECT *, (total - capped) * weight > 3 * source_size * open_weight AS is_full FROM f
), l AS (
  SELECT min(k) AS first_open FROM g WHERE NOT is_full
), t AS (
  SELECT g.source, g.source_size,
         CASE WHEN first_open IS NULL OR g.k < first_open THEN (3 * g.source_size)::DOUBLE
              ELSE ((w.total - w.capped) * g.weight)::DOUBLE / w.open_weight::DOUBLE END AS target
  FROM g CROSS JOIN l LEFT JOIN g w ON w.k = l.first_open
), q AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(3, floor(target)::BIGINT // source_size) END AS whole FROM t
), x AS (
  SELECT *, CASE WHEN whole < 3 THEN floor(target)::BIGINT - whole * source_size ELSE 0 END AS extra FROM q
), n AS (
  SELECT d.doc_id, d.size, x.source_size, x.target, x.whole, x.extra,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix-1/' || d.doc_id::VARCHAR), d.doc_id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
  FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN extra > 0 AND 2 * before + size <= 2 * extra THEN 1 ELSE 0 END))::BIGINT AS taken
FROM n
""",
    "op11_document_fingerprints": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), n AS (
  SELECT doc_id, t, coalesce(lead(t) OVER w, first(t) OVER w) AS next_t FROM d
  WINDOW w AS (ORDER BY doc_id, t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), e AS (
  SELECT *, length(t) - length(t) // 4 AS stays,
         substr(t, 1, length(t) - length(t) // 4) || substr(next_t, 1, length(t) // 4) AS edited FROM n
), x AS (
  SELECT DISTINCT unnest([t, edited, next_t]) AS t FROM e
), p AS (
  SELECT t, string_split(rtrim(regexp_replace(array_to_string([
      CASE WHEN w IN (ANCHORS) THEN w || '^' ELSE w || ' ' END
      FOR w IN string_split_regex(lower(t), '[^\p{L}\p{M}\p{N}]+') IF w <> ''], ''), '[^ ]*$', '')), ' ') AS p FROM x
), c AS (
  SELECT t, p, [struct_pack(spot := contains(z, '^'), chain := array_to_string(list_prepend(regexp_extract(z, '([^^]*\^)?[^^]*$', 0),
      [regexp_extract(y, '[^^]*$', 0) FOR y IN p[i + 1:i + 2]]), ' ')) FOR z, i IN p] AS c FROM p
), s AS (
  SELECT t, list_sort(list_distinct([substr(md5(y), 1, 16) FOR y IN
      CASE WHEN p[1] = '' THEN ['^^' || t]
           WHEN len([1 FOR z IN c IF z.spot]) > 0 THEN [z.chain FOR z IN c IF z.spot]
           ELSE [z.chain FOR z IN c] END])) AS s FROM c
)
SELECT doc_id, length(e.t)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a.s, '') AS fingerprint,
       array_to_string(b.s, '') AS edited_fingerprint,
       len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS near_edited,
       len(list_intersect(a.s, o.s))::DOUBLE / (len(a.s) + len(o.s) - len(list_intersect(a.s, o.s))) AS near_next
FROM e JOIN s a ON a.t = e.t JOIN s b ON b.t = e.edited JOIN s o ON o.t = e.next_t
""".replace("ANCHORS", ", ".join(f"'{w}'" for w in dict.fromkeys(spot_signatures.ANCHORS))),
    "op13_centroid_clustering": r"""
WITH v AS (
  SELECT vec_id, [floor(64 * y::DOUBLE)::BIGINT FOR y IN embedding] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len([y FOR y IN embedding IF y IS NOT NULL AND isfinite(y)]) = 64
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), x) - 1 AS c, x FROM v QUALIFY c < 16
), a0 AS (
  SELECT vec_id, any_value(v.x) AS x, min((list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.x, c.x)])::BIGINT, c)) AS near
  FROM v CROSS JOIN c0 c GROUP BY vec_id
), c1 AS (
  SELECT c0.c, coalesce(m.x, c0.x) AS x FROM c0 LEFT JOIN (
    SELECT c, list(floor_mean ORDER BY i) AS x FROM (
      SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS floor_mean FROM (
        SELECT near[2] AS c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a0, range(1, 65) t(i) GROUP BY ALL)) GROUP BY c) m ON m.c = c0.c
), a1 AS (
  SELECT vec_id, any_value(v.x) AS x, min((list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.x, c.x)])::BIGINT, c)) AS near
  FROM v CROSS JOIN c1 c GROUP BY vec_id
), c2 AS (
  SELECT c1.c, coalesce(m.x, c1.x) AS x FROM c1 LEFT JOIN (
    SELECT c, list(floor_mean ORDER BY i) AS x FROM (
      SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS floor_mean FROM (
        SELECT near[2] AS c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a1, range(1, 65) t(i) GROUP BY ALL)) GROUP BY c) m ON m.c = c1.c
), a2 AS (
  SELECT vec_id, any_value(v.x) AS x, min((list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.x, c.x)])::BIGINT, c)) AS near
  FROM v CROSS JOIN c2 c GROUP BY vec_id
), c3 AS (
  SELECT c2.c, coalesce(m.x, c2.x) AS x FROM c2 LEFT JOIN (
    SELECT c, list(floor_mean ORDER BY i) AS x FROM (
      SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS floor_mean FROM (
        SELECT near[2] AS c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a2, range(1, 65) t(i) GROUP BY ALL)) GROUP BY c) m ON m.c = c2.c
), f AS (
  SELECT vec_id, min((list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.x, c.x)])::BIGINT, c)) AS near
  FROM v CROSS JOIN c3 c GROUP BY vec_id
)
SELECT vec_id, near[2]::INTEGER AS cluster, near[1] AS distance, sum(near[1]) OVER (PARTITION BY near[2])::BIGINT AS cluster_inertia,
       sum(near[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM f JOIN c3 ON c3.c = near[2]
""",
    "op6_url_filters": r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), r(rhost, rpath, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), m AS (
  SELECT p.*, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
""",
}
