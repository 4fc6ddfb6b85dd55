"""From raw documents to piece ids: five stages, each on all that the one before kept."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaya.llm import language_id, mixing, near_dedup, secret_scans, sentencepiece_codec
from assaya.shared import scratch_path, table

TOKENIZERS = os.environ.get("ASSAYA_TOKENIZERS", "/opt/tokenizers")
#: Target weights of the domains; the clean one keeps its tokens, the others shrink to these proportions of it.
WEIGHTS = {"clean": 0.96, "low": 0.03, "toxic": 0.01}


#: What goes to a Python worker at once, at most. Spark takes it from the session when a stage runs, so a stage that is
#: called alone leaves it set; ``run`` puts it back.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def _bounded(spark: SparkSession) -> None:
    for setting, value in BATCH.items():
        spark.conf.set(setting, value)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told (``und``: no text, or no letter in it); ``lang`` is what was found."""
    _bounded(spark)
    model = language_id.fit(docs.select("text", "lang", language_id.held_out("doc_id").alias("held")).filter("not held"))
    rows = docs.select("doc_id", "text", F.struct("*").alias("row"))
    named = language_id.predict(rows, model, keep=("row",)).filter("lang_pred <> 'und'")
    return named.select(*[F.col("lang_pred" if c == "lang" else f"row.`{c}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least doc_id."""
    _bounded(spark)
    return near_dedup.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a secret have it replaced by its kind; n_chars is measured again."""
    return secret_scans.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say. One that is most probably clean has a rate of 1 or a little more, so it stays."""
    return mixing.mixed(docs, mixing.label_domains(table(spark, sf_dir, "labels")), WEIGHTS, anchor="clean", keep_anchor=True)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the piece ids of its text."""
    _bounded(spark)
    return sentencepiece_codec.encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_domains),
    ("pieces", encode_pieces),
]

#: A network, iterated components and fitted rates have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = {setting: spark.conf.get(setting) for setting in BATCH}
    try:
        for name, stage in STAGES:
            path = scratch_path(spark, f"stage-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        for setting, value in before.items():
            spark.conf.set(setting, value)
    return docs
