"""Ids and digests that follow from contents, and verdicts on signatures, over events as manifests."""

import hashlib
import hmac

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaya.functions.canonical import manifest_digest
from assaya.functions.text import deterministic_id
from assaya.operators import ledger, provenance
from assaya.plans.bindings import MANIFESTS_SQL, manifests
from assaya.shared import table

#: A namespace of sixteen bytes.
NAMESPACE = b"assaya-namespace"


def deterministic_ids(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.sha2("props", 256).alias("sha"), F.col("user_id").cast("string").alias("of"), "event_type")
    return rows.select("event_id", deterministic_id(F.col("sha"), F.col("of"), F.col("event_type"), NAMESPACE.hex()).alias("id"))


def manifest_digests(spark, sf_dir) -> DataFrame:
    """Manifests with blanks, keys in any order and a field that isn't signed."""
    e = F.col("event_id").cast("string")
    text = F.concat(
        F.lit('{ "signature": "s'), e, F.lit('", "timestamp_utc": "t", "sequence": '), e, F.lit(', "nonce": "n'), e, F.lit('",\n "input_sha256": "é", "preprocessing_config": {"b": 2, "a": [1, null]}, "maker_version": "1"}'),
    )
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 13 == 0, "not json").otherwise(text).alias("manifest"))
    return rows.select("event_id", manifest_digest(F.col("manifest"), "maker_version").alias("digest"))


def _keys(spark) -> DataFrame:
    """The keys of four of five users' groups."""
    return spark.createDataFrame([(i, f"key {i}") for i in range(4)], "key_id int, key string")


def _hmac(key: str, digest: str) -> str:
    return hmac.new(key.encode(), digest.encode(), hashlib.sha256).hexdigest()


def manifest_signatures(spark, sf_dir) -> DataFrame:
    """Manifests signed with their group's key; every 17th isn't signed, every 19th of the others has another's signature."""
    signed = F.pandas_udf(lambda key, digest: pd.Series(map(_hmac, key, digest)), "string")
    rows = manifests(spark, sf_dir).select("manifest_id", F.col("output_sha256").alias("digest"), (F.col("stream") % 5).cast("int").alias("key_id"))
    signature = signed(F.concat(F.lit("key "), F.when(F.col("manifest_id") % 19 == 0, 9).otherwise(F.col("key_id"))), "digest")
    rows = rows.withColumn("signature", F.when(F.col("manifest_id") % 17 != 0, signature))

    def verify(digest: pd.Series, signature: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([hmac.compare_digest(_hmac(k, d), s) for d, s, k in zip(digest, signature, key)])

    return provenance.signature_verdicts(rows, _keys(spark), verify)


def first_events(spark, sf_dir) -> DataFrame:
    """The first twenty events of each user."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("seq"))
    return ledger.first_events(rows, "user_id").select("user_id", "position", "event_id")


QUERIES = {f.__name__: f for f in (deterministic_ids, manifest_digests, manifest_signatures, first_events)}
ORACLES = {
    "deterministic_ids": f"""WITH h AS (SELECT event_id, sha1('{NAMESPACE.decode()}' || sha256(props) || ':' || user_id || ':' || event_type) AS h FROM events)
SELECT event_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', 1 + ('0x' || h[17])::INT % 4, 1) || h[18:20] || '-' || h[21:32] AS id FROM h""",
    "manifest_digests": """SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN sha256('{"input_sha256":"é","maker_version":"1","nonce":"n' || event_id || '","preprocessing_config":{"a":[1,null],"b":2},"sequence":' || event_id || ',"timestamp_utc":"t"}') END AS digest FROM events""",
    "manifest_signatures": f"WITH {MANIFESTS_SQL} SELECT manifest_id, CASE WHEN manifest_id % 17 <> 0 AND stream % 5 <> 4 THEN manifest_id % 19 <> 0 END AS signature_valid FROM manifests",
    "first_events": "SELECT user_id, row_number() OVER w - 1 AS position, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY row_number() OVER w <= 20",
}
