"""A corpus pipeline from the ten operators: documents in, token ids out.

quality classifier -> language ID -> n-gram Jaccard join -> mixing sources -> SentencePiece.

Every stage gets (spark, docs, sf_dir), where docs are the rows that its predecessor kept, and returns the columns of
documents (the last: doc_id, source, token ids and the hash of the decoded text). Models are learnt from the whole tables in sf_dir, never from held-out
rows; every decision is on the rows given. Rows without an id stay in; of near duplicates one with an id stays, if there is one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import jaccard, language, mixing, pieces, quality, tables
from tracewell.session import share_code

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    share_code(spark)
    known = tables.read(spark, sf_dir, "documents").select("doc_id", "text").filter(tables.trainable())
    model = quality.train(known, tables.read(spark, sf_dir, "labels").filter(tables.trainable()))
    scored = quality.predict(docs, model, score_as="__score")
    return scored.filter(F.col("__score") >= quality.GOOD).select(*docs.columns)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and whose language is told with a probability of at least LEAST_SURE."""
    share_code(spark)
    known = tables.read(spark, sf_dir, "documents").select("doc_id", "text", "lang").filter(tables.trainable())
    found = language.predict(docs, language.train(known), lang_as="__lang", score_as="__sure")
    return found.filter((F.col("__lang") != language.UNKNOWN) & (F.col("__sure") >= LEAST_SURE)).select(*docs.columns)


#: Below this calibrated probability a document's language counts as unknown. With four languages no text can be below 0.25.
LEAST_SURE = 0.35


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the document with the smallest id."""
    share_code(spark)
    return jaccard.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of training, each as often as its source's weight asks for."""
    share_code(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the end id, and the SHA-256 of the text that they decode to."""
    import public_tokenizers

    share_code(spark)
    coded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id", "source"], decoded_as="decoded")
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_good),
    ("language_id", keep_known_language),
    ("ngram_jaccard_join", keep_one_of_each_class),
    ("mixing_sources", mix_sources),
    ("sentencepiece", encode),
]

#: The trained stages have no SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written in the shared folder, read by the next and then removed (the last's stay)."""
    docs, before = tables.read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            where = tables.scratch(spark, name)
            docs.write.parquet(where)
            docs = spark.read.parquet(where)
            if before:
                tables.remove(spark, before)
            before = where
    return docs
