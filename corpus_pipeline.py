"""Corpus preparation: identify languages, drop near copies, redact, mix, tokenize.

Each stage takes the documents its predecessor kept and returns a DataFrame,
which is written as Parquet and read again as the next stage's input. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import bpe, langid, mixing, neardup, pii
from riskweave.llm.common import Workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language is undetermined or less likely than this are rejected.
LEAST_SCORE = 0.4


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``; whatever else a table carries ends here."""
    return docs.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a determined language.

    The network learns from the stage's own rows. Rejected: null texts, texts
    without a letter, and predictions below ``LEAST_SCORE``. Repeated rows are
    judged alike.
    """
    model = langid.learn(docs.select("doc_id", "text", "lang"), F.lit(True))
    judged = langid.identify(_columns(docs), model, drop_text=False)
    kept = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return _columns(judged.where(kept))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of every group, by shingles of five words at 0.8.

    Documents without an id are kept; of repeated rows of one id one stays.
    """
    kept = neardup.near_duplicates(docs, size=5, percent=80).where("kept AND doc_id IS NOT NULL").select(
        F.col("doc_id").alias("kept_id")).distinct()
    work = Workspace(spark, "pipeline")
    kept = work.save(kept, "kept")
    rows = _columns(docs)
    single = rows.join(kept, F.col("doc_id") == F.col("kept_id"), "left_semi").dropDuplicates(["doc_id"])
    return single.unionByName(rows.where("doc_id IS NULL"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind; ``n_chars`` follows the new text.

    A null text stays null. Every document is kept.
    """
    rows = _columns(docs)
    found = pii.find(rows, pii.learn(rows))
    clean = found.withColumn("text", pii.redacted(F.col("text"), F.col("spans")))
    length = F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return _columns(clean.withColumn("n_chars", length))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their target weights.

    A document stands as often as the mix takes it. Rows alike in id, source
    and size share the copies that these have together, rounded up.
    """
    rows = _columns(docs)
    counts = Workspace(spark, "pipeline").save(mixing.mix(rows).groupBy(
        F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size")).agg(
        F.ceil(F.sum("copies") / F.count(F.lit(1))).cast("int").alias("times")).where("times > 0"), "copies")
    joined = rows.withColumn("size", mixing.word_count(F.col("text"))).join(
        counts, F.col("doc_id").eqNullSafe(F.col("m_id")) & F.col("source").eqNullSafe(F.col("m_source")) & (
            F.col("size") == F.col("m_size")))
    return _columns(joined.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times")))))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and the digests of ids and decoded bytes, in place of the text."""
    import public_tokenizers

    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_texts(_columns(docs), tokens, public_tokenizers.PATTERN)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("personal_data", redact),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: Learned models and MinHash are not expressible in SQL; tests/llm has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return result
        docs = work.save(result, name)
        if i:
            work.drop(STAGES[i - 1][0])
    return docs
