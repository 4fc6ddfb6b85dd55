"""Streams of files through the sinks and the stateful checks."""

import pytest
from pyspark.sql import functions as F

from assaya.streaming import checks


def run(spark, rows, schema, folder, name, check=None, sink=None):
    """One more file in the stream, then a run to its end with the state of the runs before."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
    writer = (check(stream) if check else stream).writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer = writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", f"{folder}/out").outputMode("append")
    writer.start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_contents_are_stored_once(spark, tmp_path):
    sink = checks.ingest_new(f"{tmp_path}/out")
    args = ("sha256 string, name string", str(tmp_path), "x")
    run(spark, [("aa1", "x"), ("aa1", "y"), ("bb2", "z")], *args, sink=sink)
    out = run(spark, [("bb2", "again"), ("cc3", "w")], *args, sink=sink)
    assert sorted(r["sha256"] for r in out.collect()) == ["aa1", "bb2", "cc3"]
    sink(spark.createDataFrame([("cc3", "w")], args[0]), 99)  # what another batch has
    stored = checks.read_store(spark, f"{tmp_path}/out", args[0])
    assert stored.count() == 3
    assert {(r["sha256"], r["name"]) for r in stored.collect()} == {("aa1", "x"), ("bb2", "z"), ("cc3", "w")}


def test_a_batch_run_again_adds_nothing_twice(spark, tmp_path):
    """Stopped half way, a batch has written some of its folders; run again it replaces them. Only its parts are read."""
    sink, schema = checks.ingest_new(f"{tmp_path}/out"), "sha256 string, name string"
    batch = spark.createDataFrame([("aa1", "x"), ("bb2", "y"), ("bb2", "y")], schema)
    sink(batch.filter("sha256 = 'aa1'"), 0)  # what was written before the stop
    for _ in range(2):
        sink(batch, 0)
        assert sorted(map(tuple, checks.read_store(spark, f"{tmp_path}/out", schema).collect())) == [("aa1", "x", "aa", 0), ("bb2", "y", "bb", 0)]
    sink(spark.createDataFrame([("aa1", "again"), ("cc3", "z")], schema), 1)
    sink(batch, 0)
    assert sorted(r["sha256"] for r in checks.read_store(spark, f"{tmp_path}/out", schema).collect()) == ["aa1", "bb2", "cc3"]
    (tmp_path / "out" / "part=zz" / "batch=7").mkdir(parents=True)
    (tmp_path / "out" / "part=zz" / "batch=7" / "part-0.parquet").write_bytes(b"not a file that can be read")
    sink(spark.createDataFrame([("cc3", "z"), ("dd4", "w")], schema), 2)  # reads no part but its own


def test_only_verified_manifests_are_admitted(spark, tmp_path):
    sink = checks.admit_verified(f"{tmp_path}/out")
    args = ("manifest_id long, verified boolean", str(tmp_path), "x")
    run(spark, [(1, True), (2, False)], *args, sink=sink)
    out = run(spark, [(1, True), (2, True), (3, False)], *args, sink=sink)
    assert sorted(r["manifest_id"] for r in out.collect()) == [1, 2]
    checks.admit_verified(f"{tmp_path}/out")(spark.createDataFrame([(3, True), (1, True)], args[0]), 5)
    assert sorted(r["manifest_id"] for r in checks.read_store(spark, f"{tmp_path}/out", args[0]).collect()) == [1, 2, 3]


def test_state_outlives_a_restart(spark, tmp_path):
    schema = "stream string, manifest_id long, sequence long, arrival long"
    run(spark, [("s", 1, 0, 1), ("s", 2, 1, 2)], schema, str(tmp_path), "x", checks.sequence_anomalies)
    out = run(spark, [("s", 3, 5, 3), ("s", 4, 2, 4)], schema, str(tmp_path), "x", checks.sequence_anomalies)
    assert {tuple(r) for r in out.select("manifest_id", "anomaly", "gap_size").collect()} == {(3, "sequence_gap", 3), (4, "sequence_regression", None)}


@pytest.fixture
def few_rows(spark, request):
    """So many rows to a frame, in two partitions."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(request.param), "spark.sql.shuffle.partitions": "2"}
    before = {name: spark.conf.get(name) for name in wanted}
    for settings in (wanted, before):
        for name, value in settings.items():
            spark.conf.set(name, value)
        if settings is wanted:
            yield


@pytest.mark.parametrize("few_rows", [1, 1000], indirect=True)
def test_a_nonce_is_remembered(spark, tmp_path, few_rows):
    """Known from a batch before, and first seen with several arrivals in one batch, in any order; one row comes twice."""
    schema = "nonce string, manifest_id long, arrival long"
    before = spark.conf.get(checks.STATE_STORE[0])
    with checks.state_store(spark):
        run(spark, [("n", 1, 1), ("m", 2, 2), ("r", None, 0)], schema, str(tmp_path), "x", checks.nonce_reuse)
        rows = [("n", 3, 3), ("k", 4, 4), ("r", 7, 9), ("r", 6, 5), ("r", 5, 6), ("r", 6, 5), ("q", 9, 8), ("q", 8, 8), (None, 10, 10), (None, 11, 11)]
        out = run(spark, rows, schema, str(tmp_path), "x", checks.nonce_reuse)
    assert sorted(map(tuple, out.select("manifest_id", "first_manifest").collect())) == [(3, 1), (5, 6), (6, 6), (7, 6), (9, 8), (11, 10)]
    assert spark.conf.get(checks.STATE_STORE[0]) == before


@pytest.mark.parametrize("few_rows", [7, 1000], indirect=True)
def test_many_nonces_share_a_key_of_the_state(spark, tmp_path, few_rows):
    """The state is called for each bucket, not for each nonce; over batches and frames the firsts are each nonce's own."""
    import random

    rng, schema = random.Random(3), "nonce string, manifest_id long, arrival long"
    batches = [[(f"n{rng.randrange(60)}" if rng.random() < 0.9 else rng.choice((None, "")), 100 * b + i, 100 * b + rng.randrange(40)) for i in range(100)] for b in range(3)]
    first, want = {}, []
    with checks.state_store(spark):
        for rows in batches:
            out = run(spark, rows, schema, str(tmp_path), "x", lambda stream: checks.nonce_reuse(stream, buckets=3))
            for nonce, manifest, _ in sorted(rows, key=lambda r: (r[2], r[1])):
                if nonce in first:
                    want.append((manifest, first[nonce]))
                first.setdefault(nonce, manifest)
    assert sorted(map(tuple, out.select("manifest_id", "first_manifest").collect())) == sorted(want)
