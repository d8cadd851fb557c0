"""A corpus pipeline over ``documents``: each stage applies one operator to what its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the
documents it keeps, with the columns of ``documents`` (the last returns token ids).
``run`` writes every stage's result to the session's shared folder and reads it again, so
a lost executor repeats part of one stage at most.

Null texts have no language and go in the first stage; empty tables pass through all
stages; extra columns of ``documents`` are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitscope.llm import langid, mixing, pieces, quality, simhash
from splitscope.llm.common import crc_mod, materialize
from splitscope.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rejects documents without a letter, those no language is sure of (score
    below one half), and those that their language's trees code longer than the text itself.

    A byte takes 8 bits as it stands, so trees that spend more on a text know nothing of
    it: noise, or a language not learned. Very short texts get 64 bits more, about what an
    odd name or key in them costs. The others carry the language found."""
    model = langid.train(docs, learn=crc_mod(F.col("doc_id"), 4) != 2)
    found = langid.with_language(docs, model, to="_lang", score="_score", bits="_bits")
    size = F.octet_length("text")
    own = (F.col("_lang") != langid.UNKNOWN) & (F.col("_score") >= 0.5) & (F.col("_bits") * size <= 8 * size + 64)
    return found.filter(own).withColumn("lang", F.col("_lang")).select(*docs.columns)


def clean_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: rejects documents that score below one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, learn=crc_mod(F.col("doc_id"), 3) != 1)
    return quality.with_quality(docs, model, to="_score").filter("_score >= 0.5").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays, that of the smallest doc_id."""
    return simhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents in the amounts their sources' target weights call for, a row for
    each pass over its source that takes words of the document, with the words taken."""
    return mixing.mixed_documents(docs)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding: each document's best piece ids, and the scores of its four best."""
    found = pieces.with_pieces(docs, tokenizer_path("piece_bpe_32k.model"), n=4)
    return found.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("pieces.ids") / 4).cast("long").alias("n_pieces"),
        F.col("pieces.ids").alias("ids"),
        F.expr("transform(pieces.nbest, x -> x.score)").alias("scores"),
    )


STAGES = [
    ("language", language),
    ("quality", clean_text),
    ("near-duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("pieces", segment),
]

# Trained models, pseudorandom draws and piece lattices: no SQL states these rows; tests
# hold each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
