"""The streaming checks run over events as a stream of files, to their end; their SQL is that of the batch forms."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaya.plans import ledgers
from assaya.plans.bindings import MANIFESTS_SQL, audit_events, manifests
from assaya.shared import cut, scratch_path, table
from assaya.streaming import checks


def _batches(rows: DataFrame, early: Column, start) -> None:
    """Stores the early rows and runs the stream to its end, then the others and the stream again, from its checkpoint: several
    micro-batches and a restart. ``start`` gives the writer for a stream."""
    spark = rows.sparkSession
    source, state = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-state")
    rows = cut(rows.withColumn("_early", early))
    for part in (True, False):
        rows.filter(F.col("_early") == part).drop("_early").write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.drop("_early").schema).parquet(source)
        start(stream).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def _streamed(rows: DataFrame, check, columns: list[str], early: Column) -> DataFrame:
    """The result table of ``check``. A key's rows of one micro-batch are put in order by it; earlier ones came before."""
    sink = scratch_path(rows.sparkSession, "stream-out")
    _batches(rows, early, lambda stream: check(stream).writeStream.format("parquet").option("path", sink).outputMode("append"))
    return rows.sparkSession.read.parquet(sink).select(*columns)


def _stored(rows: DataFrame, sink, schema: str, early: Column) -> DataFrame:
    """What ``sink(path)`` has stored; rows come in any order."""
    path = scratch_path(rows.sparkSession, "store")

    _batches(rows, early, lambda stream: stream.writeStream.foreachBatch(sink(path)))
    return checks.read_store(rows.sparkSession, path, schema)


def _arrivals(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("stream").orderBy("arrival")
    rows = manifests(spark, sf_dir)
    return rows.select("manifest_id", "stream", "nonce", "sequence", F.row_number().over(order).alias("arrival"))


def stream_sequence_anomalies(spark, sf_dir) -> DataFrame:
    return _streamed(_arrivals(spark, sf_dir), checks.sequence_anomalies, ["manifest_id", "anomaly", "gap_size"], F.col("arrival") <= 20)


def stream_nonce_reuse(spark, sf_dir) -> DataFrame:
    with checks.state_store(spark):
        return _streamed(_arrivals(spark, sf_dir), checks.nonce_reuse, ["manifest_id", "first_manifest"], F.col("arrival") <= 20)


def stream_chain_failures(spark, sf_dir) -> DataFrame:
    rows = audit_events(spark, sf_dir).drop("payload")
    return _streamed(rows, checks.chain_failures, ["chain_id", "position", "failure_type"], F.col("seq") < 20)


def stream_ingested_contents(spark, sf_dir) -> DataFrame:
    """Texts that come as documents, each kept once."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select(F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("size"))
    return _stored(docs, checks.ingest_new, "sha256 string, size int", F.col("size") % 2 == 0).select("sha256", "size", F.col("part").alias("prefix"))


def stream_admitted_manifests(spark, sf_dir) -> DataFrame:
    """Manifests that come twice, verified or not."""
    rows = manifests(spark, sf_dir).select("manifest_id", (F.col("manifest_id") % 19 != 0).alias("verified"), F.explode(F.array(F.lit(True), F.col("manifest_id") % 2 == 0)).alias("early"))
    return _stored(rows.select("manifest_id", "verified"), checks.admit_verified, "manifest_id long, verified boolean", F.col("manifest_id") % 2 == 0).select("manifest_id", "verified")


QUERIES = {f.__name__: f for f in (stream_sequence_anomalies, stream_nonce_reuse, stream_chain_failures, stream_ingested_contents, stream_admitted_manifests)}
ORACLES = {
    "stream_sequence_anomalies": ledgers.ORACLES["sequence_anomalies"],
    "stream_nonce_reuse": ledgers.ORACLES["nonce_reuse"],
    "stream_chain_failures": f"SELECT chain_id, first_failure AS position, failure_type FROM ({ledgers.ORACLES['audit_chain_verification']}) WHERE NOT valid",
    "stream_ingested_contents": "SELECT DISTINCT sha256(text) AS sha256, octet_length(encode(text))::INT AS size, left(sha256(text), 2) AS prefix FROM documents WHERE text IS NOT NULL",
    "stream_admitted_manifests": f"WITH {MANIFESTS_SQL} SELECT DISTINCT manifest_id, true AS verified FROM manifests WHERE manifest_id % 19 <> 0",
}
