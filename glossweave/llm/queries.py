"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat_format, decontam, html_extract, line_dedup, mixing, pii, quality, simhash, token_store
from .common import read_table

#: Weights of all tokens that the mix aims at, by language.
MIX_TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, domain: the language of the labelled documents of good quality."""
    good = labels.where("quality = 1 and toxic = 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("domain")).join(good, "doc_id", "left_semi")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(read_table(spark, sf_dir, "pages"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, rate, copies and the posteriors of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labelled = labelled_domains(docs, read_table(spark, sf_dir, "labels"))
    found = mixing.rated(docs.select("doc_id", "text"), labelled, MIX_TARGETS)
    return found.select("doc_id", F.col("__n").cast("long").alias("n_tokens"), F.transform("__p", lambda x: F.round(x, 6)).alias("posteriors"), F.col("__rate").alias("rate"), F.col("__copies").alias("copies"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = token_store.token_table(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return token_store.checksums(stored)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without later repeated runs (of lines, and of words inside them), n_lines, n_deleted."""
    return line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), inside_lines=True)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.with_control_case(read_table(spark, sf_dir, "conversations"))
    return chat_format.digest(chat_format.format_conversations(chat_format.as_log(turns)))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade, p_ge1, p_ge2, selected."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, quality.graded(read_table(spark, sf_dir, "labels")))
    return quality.score(docs, model).drop("text")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("items")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_source_mixing,
        op3_token_output,
        op4_line_dedup,
        op5_chat_formatting,
        op6_nearest_neighbours,
        op7_pii,
        op8_quality,
        op9_simhash,
        op10_decontamination,
        pipeline,
    )
}

ORACLES = {
    "op5_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), spelled AS (
  SELECT *, regexp_replace(replace(replace(role, '\', '\b'), chr(10), '\n'), '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>)', '\1\\\2\3', 'g') AS role_out,
    regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>)', '\1\\\2\3', 'g') AS text_out
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length('<|turn|>') + length(role_out) + 1 + length(text_out) + length('<|end|>'))::BIGINT AS formatted_chars
FROM spelled GROUP BY conv_id
""",
}
