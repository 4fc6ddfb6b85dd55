"""Hash chains of audit events: building, and verification in ranges."""

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from assaya.operators.ranges import running
from assaya.shared import cut

#: Fixed value: what the first event of a chain names as its predecessor.
GENESIS = "0" * 64
#: The hashed fields in the order of their names, which is that of the canonical text.
FIELDS = ("actor", "assessment_id", "event_id", "event_type", "payload_digest", "previous_hash", "timestamp_utc")


def event_hash(fields: dict[str, Column] | None = None) -> Column:
    """SHA-256 of the fields as JSON with sorted keys and no spaces; nulls are written as null."""
    fields = fields or {}
    record = F.struct(*[fields.get(f, F.col(f)).alias(f) for f in FIELDS])
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def build_chain(events: DataFrame, key: str = "chain_id") -> DataFrame:
    """Adds ``seq`` from 0, ``previous_hash`` and ``current_hash`` to events (key, position, and the fields but the
    previous hash). One chain is serial, so it is walked in one task, in order and batch by batch; what is held is the last
    hash and the count. Chains are independent."""
    own = [f for f in FIELDS if f != "previous_hash"]
    at = FIELDS.index("previous_hash")
    # the record's text up to the previous hash and after it, so that both ways of hashing write the same JSON
    head, tail = (F.to_json(F.struct(*part), {"ignoreNullFields": "false"}) for part in (FIELDS[:at], FIELDS[at + 1 :]))
    dealt = events.select(key, "position", *own).repartition(key).sortWithinPartitions(key, "position", *own)
    rows = dealt.select(key, *own, head.alias("_head"), tail.alias("_tail"))
    texts = [StructField(f, StringType()) for f in ("previous_hash", "current_hash")]
    schema = StructType([rows.schema[key], StructField("seq", LongType()), *[rows.schema[f] for f in own], *texts])

    def walk(batches):
        chain, last, seq = None, GENESIS, 0
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            seqs, previous, current = [], [], []
            for k, before, after in zip(*[column[c].to_pylist() for c in (key, "_head", "_tail")]):
                if k != chain:
                    chain, last, seq = k, GENESIS, 0
                seqs.append(seq)
                previous.append(last)
                last = hashlib.sha256(f'{before[:-1]},"previous_hash":"{last}",{after[1:]}'.encode()).hexdigest()
                current.append(last)
                seq += 1
            kind = column["_head"].type
            arrays = [column[key], pa.array(seqs, pa.int64()), *[column[f] for f in own], pa.array(previous, kind), pa.array(current, kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(walk, schema)


def _checked(events: DataFrame, key: str, *more: Column) -> DataFrame:
    """(key, position, failure, more): each event with its place from 0 and what is wrong with it, if anything. A chain is
    checked in ranges of its order, each handed the last hash of the range before."""
    rows = events.select(key, "seq", "previous_hash", "current_hash", (event_hash() != F.col("current_hash")).alias("_forged"), *more)
    rows = running(rows, [key], ["seq"], sums={"position": F.lit(1).cast("long")}, lasts={"_last": F.col("current_hash")})
    expected = F.when(F.col("_last").isNull(), GENESIS).otherwise(F.col("_last.v"))
    failure = F.when(F.col("_forged"), "hash_mismatch").when(~F.col("previous_hash").eqNullSafe(expected), "linkage_broken")
    return rows.withColumn("failure", failure).drop("seq", "previous_hash", "current_hash", "_forged", "_last")


def verify_chain(events: DataFrame, key: str = "chain_id") -> DataFrame:
    """One row per chain: events_checked, valid, first_failure (its position from 0), failure_type.

    At each event a wrong hash is tested before a wrong link; the first failure ends the chain's check.
    """
    first = F.min(F.when(F.col("failure").isNotNull(), F.struct("position", "failure")))
    return _checked(events, key).groupBy(key).agg(F.count("*").alias("events_checked"), first.alias("_f")).select(
        key, "events_checked", F.col("_f").isNull().alias("valid"), F.col("_f.position").alias("first_failure"), F.col("_f.failure").alias("failure_type")
    )


def payload_failures(events: DataFrame, key: str = "chain_id") -> DataFrame:
    """(key, position) of events whose payload doesn't have its digest, before the chain's first break or, where that
    chain has none, anywhere. Needs a ``payload`` column of canonical text."""
    rows = cut(_checked(events, key, (F.sha2("payload", 256) != F.col("payload_digest")).alias("_payload")))
    stops = rows.filter("failure is not null").groupBy(key).agg(F.min("position").alias("_stop")).withColumnRenamed(key, "_key")
    forged = rows.filter("_payload").join(stops, F.col(key).eqNullSafe(F.col("_key")), "left")
    return forged.filter("_stop is null or position < _stop").select(key, "position")


def verify_subset(events: DataFrame, key: str = "assessment_id") -> DataFrame:
    """Per assessment: events, wrong hashes and wrong payloads, without links and without an early end."""
    return events.groupBy(key).agg(
        F.count("*").alias("events_checked"),
        F.count_if(event_hash() != F.col("current_hash")).alias("hash_failures"),
        F.count_if(F.sha2("payload", 256) != F.col("payload_digest")).alias("payload_failures"),
    )


def chain_ends(events: DataFrame, key: str = "chain_id") -> DataFrame:
    """First and last event and hash of each chain, its length and the next sequence number."""
    return events.groupBy(key).agg(
        F.min_by("event_id", "seq").alias("first_event"),
        F.min_by("current_hash", "seq").alias("first_hash"),
        F.max_by("event_id", "seq").alias("last_event"),
        F.max_by("current_hash", "seq").alias("last_hash"),
        F.count("*").alias("length"),
    )


def first_events(events: DataFrame, key: str = "assessment_id", most: int = 20) -> DataFrame:
    """The first ``most`` events of each key in the order of ``seq``, with their ``position`` from 0."""
    return running(events, [key], ["seq"], sums={"position": F.lit(1).cast("long")}).filter(F.col("position") < most)
