"""The stateful checks on streams. Each orders by arrival, never by sequence or time of the record, so that a late or
reordered record shows as an anomaly, as it does in the batch form beside it (``assaya.operators``).

For sequences and chains the rows that a micro-batch has of one key are put in order in one worker, with the few columns that
the check reads. Where one stream has most rows, the source's limit on a micro-batch (``maxFilesPerTrigger`` or
``maxBytesPerTrigger``) bounds them. Reuse of nonces needs no order but the first, so its rows aren't joined.
"""

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType

from assaya.operators.ledger import GENESIS, event_hash


#: ``nonce_reuse`` keeps several states for a key, which this state store alone can.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Within it, streams that are started keep their state in ``STATE_STORE``; then the session's setting is put back."""
    name, value = STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _NonceReuse(StatefulProcessor):
    """Remembers the first manifest of each nonce of a bucket, in a list that has a record for each micro-batch with new ones.
    A known nonce's arrivals pass as they come. Those of new ones wait, frame by frame, until all are seen and the first
    of each is known: the last frame here, others in the state. So frames aren't joined."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.firsts = handle.getListState("firsts", "nonces array<string>, manifests array<long>", self.ttl_ms)
        self.waiting = handle.getListState("waiting", "nonces array<string>, arrivals array<long>, manifests array<long>", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for nonces, manifests in self.firsts.get():
            known.update(zip(nonces, manifests))
        least: dict[str, tuple[int, int]] = {}
        seen, last, stored = set(), [], False
        for pdf in rows:
            arrived = list(zip(*(pdf[c].tolist() for c in ("nonce", "arrival", "manifest_id"))))
            again = [(m, known[n]) for n, _, m in arrived if n in known]
            if again:
                yield self._reused(again)
                if self.ttl_ms:
                    seen.update(n for n, _, _ in arrived if n in known)
            new = [r for r in arrived if r[0] not in known]
            for n, *at in new:
                least[n] = min(least.get(n, at), at)
            if new and last:
                self.waiting.appendValue(tuple(map(list, zip(*last))))
                stored = True
            last = new or last
        passed: set[str] = set()
        for frame in chain((zip(*columns) for columns in self.waiting.get()) if stored else (), [last]):
            others = []
            for n, *at in frame:
                if n not in passed and at == least[n]:
                    passed.add(n)
                else:
                    others.append((at[1], least[n][1]))
            if others:
                yield self._reused(others)
        if stored:
            self.waiting.clear()
        if least:
            self.firsts.appendValue((list(least), [m for _, m in least.values()]))
        if seen:  # seen now, for their time to live
            self.firsts.appendValue((list(seen), [known[n] for n in seen]))

    def _reused(self, pairs: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame(pairs, columns=["manifest_id", "first_manifest"], dtype="int64")

    def close(self) -> None:
        pass


#: Buckets that nonces are dealt to, each with a list of its nonces in the state. A micro-batch calls Python once for each bucket
#: that it touches and reads its list: many more make short micro-batches cheaper where there are very many nonces.
BUCKETS = 1 << 12


def nonce_reuse(arrivals: DataFrame, ttl_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(manifest_id, first_manifest) for each arrival (manifest_id, nonce, arrival) whose nonce came before; of equal arrivals
    the least manifest_id is first. Arrivals without an id or an order are left out; a null nonce is one. State is each
    nonce with its first manifest, in lists by ``buckets``, which a stream has to keep; ``ttl_ms`` drops a nonce that
    wasn't seen for so long, and with it the memory of it. The query that reads it has to be started with ``STATE_STORE``,
    as within ``state_store``. ``ttl_ms`` is for streams that go on: a run under ``trigger(availableNow=True)`` with it
    didn't end when tried, and no test covers it."""
    nonce = F.col("nonce") if isinstance(arrivals.schema["nonce"].dataType, StringType) else F.to_json(F.struct("nonce"), {"ignoreNullFields": "true"})
    nonce = F.when(F.col("nonce").isNull(), "").otherwise(F.concat(F.lit("="), nonce))
    rows = arrivals.select(nonce.alias("nonce"), F.col("arrival").cast("long"), F.col("manifest_id").cast("long")).filter("manifest_id is not null and arrival is not null")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("nonce"), F.lit(buckets)).cast("int"))
    mode = "processingTime" if ttl_ms else "none"
    return rows.groupBy("bucket").transformWithStateInPandas(_NonceReuse(ttl_ms), "manifest_id long, first_manifest long", "append", mode)


def sequence_anomalies(arrivals: DataFrame) -> DataFrame:
    """(manifest_id, anomaly, gap_size) for arrivals (stream, manifest_id, sequence, arrival). State is the largest sequence
    of each stream."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        most = state.get[0] if state.exists else None
        found = []
        rows = pd.concat(list(batches)).sort_values("arrival", kind="stable")
        for m, s in zip(rows["manifest_id"], rows["sequence"]):
            if pd.isna(s):
                continue
            if most is not None and s != most + 1:
                found.append((int(m), "sequence_regression" if s < most + 1 else "sequence_gap", int(s - most - 1) if s > most + 1 else None))
            most = int(s) if most is None else max(most, int(s))
        if most is not None:
            state.update((most,))
        yield pd.DataFrame(found, columns=["manifest_id", "anomaly", "gap_size"]).astype({"manifest_id": "int64", "gap_size": "Int64"})

    rows = arrivals.select("stream", "manifest_id", "sequence", "arrival")
    return rows.groupBy("stream").applyInPandasWithState(step, "manifest_id long, anomaly string, gap_size long", "most long", "append", GroupStateTimeout.NoTimeout)


def chain_failures(events: DataFrame) -> DataFrame:
    """(chain_id, position, failure_type): the first failure of each chain of events (the hashed fields, current_hash, seq).
    State is the last hash, the position and whether the chain is broken; a broken chain isn't looked at further. The hash
    itself is an expression, worked out before the state."""
    rows = events.select("chain_id", "seq", "previous_hash", "current_hash", (event_hash() != F.col("current_hash")).alias("wrong"))

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        last, at, broken = state.get if state.exists else (GENESIS, 0, False)
        found = []
        for r in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples():
            if not broken and (r.wrong or r.previous_hash != last):
                broken = True
                found.append((key[0], at, "hash_mismatch" if r.wrong else "linkage_broken"))
            last, at = r.current_hash, at + 1
        state.update((last, at, broken))
        yield pd.DataFrame(found, columns=["chain_id", "position", "failure_type"])

    return rows.groupBy("chain_id").applyInPandasWithState(step, "chain_id string, position long, failure_type string", "last string, at long, broken boolean", "append", GroupStateTimeout.NoTimeout)


#: Parts of a store of which a batch reads those that its own keys fall into.
PARTS = 256


def ingest_new(path: str, digest: str = "sha256") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: adds the contents that the Parquet table at ``path`` doesn't have, of equal ones in a batch the
    least row as JSON. See ``_added_once``; ``part`` is the first two digits of the digest."""
    return _added_once(path, digest, F.substring(digest, 1, 2), lambda batch: batch)


def admit_verified(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: adds verified manifests whose id the registry at ``path`` doesn't have. See ``_added_once``."""
    part = F.pmod(F.xxhash64("manifest_id"), F.lit(PARTS)).cast("string")
    return _added_once(path, "manifest_id", part, lambda batch: batch.filter("verified"))


def _added_once(path: str, key: str, part: Column, wanted: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Adds the wanted rows of a batch whose key isn't stored, one for each key, in folders ``part=../batch=..``.

    The batch's number is the ledger: rows count as stored if another batch wrote them, and a batch replaces its own
    folders. So one that was stopped half way, or is run again, leaves what a single run leaves. Only the parts that
    the batch's keys fall into are read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = wanted(batch)
        first = F.min_by(F.struct("*"), F.to_json(F.struct("*")))
        fresh = batch.groupBy(F.col(key).alias("_key")).agg(first.alias("_row")).select("_row.*").withColumn("part", part).persist()
        parts = [r["part"] for r in fresh.select("part").distinct().collect()]  # some hundreds at most
        schema = fresh.select(key, "part").schema.add("batch", "long")
        try:
            stored = batch.sparkSession.read.schema(schema).parquet(path).filter(F.col("part").isin(parts) & (F.col("batch") != batch_id))
            fresh_rows = fresh.join(stored.select(F.col(key).alias("_stored")).distinct(), F.col(key) == F.col("_stored"), "left_anti")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            fresh_rows = fresh
        fresh_rows.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(path)
        fresh.unpersist()

    return write


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that were added at ``path``, with ``part`` and ``batch``."""
    return spark.read.schema(f"{schema}, part string, batch long").parquet(path)
