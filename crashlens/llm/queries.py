"""Registered queries of the text operators: each applies one operator, with its
production parameters, to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.llm import exact, lines, manifest, near, oracles, packing, periodic, pieces, pii, quality, scoring, search, substrings, toxicity
from crashlens.llm.common import crc_mod, documents, labels, tokenizer_path


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.remove_repeats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(documents(spark, sf_dir), labels(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_score")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact.deduplicate(spark, f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(documents(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    rows = pieces.decode(pieces.encode(documents(spark, sf_dir), path), path)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.remove_repeats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(documents(spark, sf_dir)).drop("digest")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.when(crc_mod(F.col("doc_id"), 3) == 0, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    rows = manifest.prove(documents(spark, sf_dir), claims={"text": tampered})
    rows = rows.withColumn("folded_root", manifest.fold(F.col("claimed"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def repeating(docs: DataFrame) -> DataFrame:
    """The documents; of those whose id's crc32 ends in 0, the words from one on repeat a stretch."""
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("words")
    a = F.pmod(g, F.greatest(n, F.lit(1)))
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))))
    rows = docs.withColumn("words", F.when(h % 10 == 0, words)).withColumn("a", a).withColumn("p", p)
    return rows.select("doc_id", F.when(F.size("words") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic.collapse(repeating(documents(spark, sf_dir)))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return rows.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), "longest.length", (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_pii, op3_line_dedup, op4_quality_rules, op5_exact_dedup, op6_lm_scoring, op7_sentencepiece,
    op8_substring_dedup, op9_toxicity, op10_near_dedup, op11_manifest, op12_periodic, op13_top_k,
)}


ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
worded AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
pairs AS (
  SELECT *, lead(line) OVER d AS next_line, lead(pos) OVER d AS next_pos FROM worded
  WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
copies AS (
  SELECT *, row_number() OVER (PARTITION BY line, next_line ORDER BY doc_id, i) AS nth
  FROM pairs WHERE next_line IS NOT NULL),
islands AS (
  SELECT doc_id, pos, next_pos, sum(apart) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
    SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 2 THEN 0 ELSE 1 END AS apart
    FROM copies WHERE nth > 1)),
runs AS (SELECT doc_id, run, min(pos) AS first, max(next_pos) AS last FROM islands GROUP BY doc_id, run),
kept AS (
  SELECT l.*, NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = l.doc_id AND l.pos BETWEEN r.first AND r.last) AS stays FROM lines l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM kept GROUP BY doc_id""",
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    **oracles.SQL,
}
