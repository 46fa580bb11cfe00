"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import (
    align, exact_dedup, html_cut, mixing, near_dup, packing, pii, quality, sharding, token_counts, topk, toxicity, whitening,
)
from gleaner.llm.common import table, text_of


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document, and whether it is rejected."""
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit_severity(documents, table(spark, sf_dir, "labels"))
    scored = documents.select("doc_id", toxicity.severity(F.col("text"), model).alias("told"))
    return scored.select("doc_id", "told.*", (F.col("told.p_toxic") >= 0.5).alias("rejected"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.fit_quality(documents, table(spark, sf_dir, "labels"))
    return documents.select(
        "doc_id", quality.is_held_out().alias("held_out"), quality.quality_score(F.col("text"), model).alias("score"),
    ).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    stream = exact_dedup.table_stream(spark, f"{sf_dir}/documents.parquet", documents)
    told = exact_dedup.deduplicate(documents, exact_dedup.keyed(stream, locator=exact_dedup.where()))
    return told.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.exact_top_k(rows, rows.filter(F.col("vec_id") % 20 == 0))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    digests = documents.select(
        "doc_id", sharding.size_of(F.col("text")).alias("size"),
        F.crc32(text_of(F.col("text")).cast("binary")).alias("text_crc32"), F.md5(text_of(F.col("text"))).alias("tie"))
    return sharding.shard(digests, 8, tie=F.col("tie")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    weights = html_cut.fit_blocks(pages)
    return pages.select("page_id", "url", html_cut.extracted(F.col("html"), weights).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = documents.select("doc_id", pii.personal_spans(F.col("text"), pii.fit_spans(documents)).alias("found"))
    base = F.filter("found", lambda span: span["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda span: span["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(kind) for kind in pii.KINDS], F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"),
                        pii.joined(F.col("found")).alias("spans"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "loss_tokens")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.path("piece_bpe_32k.model"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_of(F.col("text"))
    count = token_counts.token_count(spark, F.col("text"), public_tokenizers.path("byte_bpe_50k.json"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), count.alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > 1024)


QUERIES = {query.__name__: query for query in (
    op1_toxicity, op2_mixing, op3_quality, op4_exact_dedup, op5_topk, op6_sharding, op7_near_dedup, op8_html, op9_pii,
    op10_packing, op11_whitening, op12_alignment, op13_token_counts)}

_OP2 = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS whole,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
keyed AS (
  SELECT doc_id, source, size, md5(whole) AS tie,
    -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(whole)), 1, 13))::BIGINT::DOUBLE + 0.5)
        / 4503599627370496.0)
    / CASE WHEN length(whole) = 0 THEN 0.05 ELSE greatest(0.05,
        length(translate(whole, '#$%&*!|@^~<>=+_/\{}[]ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))::DOUBLE / length(whole)) END AS key
  FROM docs),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS source_no FROM keyed GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][source_no % 3 + 1]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, cap / weight AS level,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
    sum(weight) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
    (sum(source_size) OVER ())::DOUBLE AS total FROM weighed),
first AS (
  SELECT level, source_no, stopped, free FROM levels WHERE cap > weight * ((total - stopped) / free)
  ORDER BY level, source_no LIMIT 1),
targets AS (
  SELECT l.source, l.source_no, l.source_size,
    CASE WHEN f.level IS NULL OR (l.level, l.source_no) < (f.level, f.source_no) THEN l.cap
      ELSE l.weight * (l.total - f.stopped) / f.free END AS target
  FROM levels l LEFT JOIN first f ON true),
ranked AS (
  SELECT k.*, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
    sum(k.size) OVER (PARTITION BY t.source_no ORDER BY k.key, k.doc_id, k.tie ROWS UNBOUNDED PRECEDING) - k.size AS before
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN size > 0 AND epochs < 3
    AND before + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked
"""

_OP4 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents),
g AS (
  SELECT content, count(*)::BIGINT AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY content)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (content)
"""

_OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""

_OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingles FROM w),
n AS (SELECT doc_id, len(shingles)::BIGINT AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
p AS (
  SELECT a.doc_id AS one, b.doc_id AS two, count(*) AS common FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY ALL),
l AS (
  SELECT one, two FROM p JOIN n x ON x.doc_id = one JOIN n y ON y.doc_id = two
  WHERE 100 * common >= 75 * (x.n_shingles + y.n_shingles - common)),
both_ways AS (SELECT one, two FROM l UNION SELECT two, one FROM l),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, b.two FROM reach r JOIN both_ways b ON b.one = r.seen),
c AS (SELECT node AS doc_id, min(seen) AS component_id FROM reach GROUP BY node)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""

ORACLES = {"op2_mixing": _OP2, "op4_exact_dedup": _OP4, "op5_topk": _OP5, "op7_near_dedup": _OP7}
