"""Manifests: bindings to artifacts, replay and sequence checks, admission and verdicts."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaya.operators.ranges import running


def replays(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """(manifest_id, anomaly): ``duplicate_manifest`` if the id is known, ``duplicate_nonce`` if another known manifest has
    the nonce. Both frames: manifest_id, nonce. A row that is itself known is not compared with itself by nonce."""
    ids = known.select("manifest_id").distinct()
    again = candidates.join(ids, "manifest_id", "left_semi").select("manifest_id", F.lit("duplicate_manifest").alias("anomaly"))
    nonces = known.groupBy("nonce").agg(F.min("manifest_id").alias("lo"), F.max("manifest_id").alias("hi"))
    reused = candidates.join(nonces, "nonce").filter("lo <> manifest_id or hi <> manifest_id")
    return again.union(reused.select("manifest_id", F.lit("duplicate_nonce").alias("anomaly"))).distinct()


def sequence_anomalies(arrivals: DataFrame) -> DataFrame:
    """(manifest_id, anomaly, gap_size) over arrivals (stream, arrival, sequence, manifest_id): in order of arrival each is
    held against 1 plus the largest sequence before it; below is ``sequence_regression``, above ``sequence_gap``. The
    first arrival of a stream, and one without a sequence, is neither."""
    rows = running(arrivals.select("stream", "arrival", "sequence", "manifest_id"), ["stream"], ["arrival"], maxima={"_most": F.col("sequence")})
    rows = rows.withColumn("_expected", F.col("_most") + 1)
    kind = F.when(F.col("sequence") < F.col("_expected"), "sequence_regression").when(F.col("sequence") > F.col("_expected"), "sequence_gap")
    gap = F.when(F.col("sequence") > F.col("_expected"), F.col("sequence") - F.col("_expected"))
    return rows.select("manifest_id", kind.alias("anomaly"), gap.alias("gap_size")).filter("anomaly is not null")


def nonce_reuse(arrivals: DataFrame) -> DataFrame:
    """(manifest_id, first_manifest) of arrivals whose nonce an earlier one had."""
    rows = running(arrivals.select("nonce", "arrival", "manifest_id"), ["nonce"], ["arrival"], firsts={"_first": F.col("manifest_id")})
    return rows.filter("_first is not null").select("manifest_id", F.col("_first.v").alias("first_manifest"))


def bindings(manifests: DataFrame, actual: DataFrame) -> DataFrame:
    """Per manifest: failed and missing bindings of input, model and output. ``actual`` has the digests found, null where
    there was none to look at; that is a gap, not a pass."""
    kinds = ("input_sha256", "model_sha256", "output_sha256")
    found = actual.select("manifest_id", *[F.col(k).alias(f"_{k}") for k in kinds])
    rows = manifests.join(found, "manifest_id", "left")
    failed = F.array_compact(F.array(*[F.when(F.col(f"_{k}") != F.col(k), F.lit(k)) for k in kinds]))
    missing = F.array_compact(F.array(*[F.when(F.col(f"_{k}").isNull(), F.lit(k)) for k in kinds]))
    return rows.select("manifest_id", failed.alias("failed"), missing.alias("missing"))


def verdicts(manifests: DataFrame, bound: DataFrame, anomalies: DataFrame, signatures: DataFrame) -> DataFrame:
    """Per manifest: risk HIGH for a failed signature or binding, MEDIUM for a replay or sequence anomaly, else NONE;
    confidence LOW at two gaps or more, MODERATE at one, else HIGH. ``signatures``: manifest_id and a nullable
    ``signature_valid``; an unchecked one is a gap."""
    odd = anomalies.groupBy("manifest_id").agg(F.count("*").alias("n_anomalies"))
    signed = signatures.select("manifest_id", "signature_valid")
    rows = manifests.select("manifest_id").join(bound, "manifest_id", "left").join(odd, "manifest_id", "left").join(signed, "manifest_id", "left")
    wrong = (F.coalesce(F.size("failed"), F.lit(0)) > 0) | F.coalesce(~F.col("signature_valid"), F.lit(False))
    gaps = F.coalesce(F.size("missing"), F.lit(3)) + F.col("signature_valid").isNull().cast("int")
    return rows.select(
        "manifest_id",
        F.when(wrong, "HIGH").when(F.coalesce("n_anomalies", F.lit(0)) > 0, "MEDIUM").otherwise("NONE").alias("risk"),
        F.when(gaps >= 2, "LOW").when(gaps == 1, "MODERATE").otherwise("HIGH").alias("confidence"),
    )


def signature_verdicts(manifests: DataFrame, keys: DataFrame, verify: Callable[[pd.Series, pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """(manifest_id, signature_valid) by the caller's verifier: ``verify(digest, signature, key)`` gives a boolean, or null for
    what it can't judge, for each of a batch of rows that have all three. ``manifests``: manifest_id, digest, signature,
    key_id; ``keys``: key_id, key. Without a signature or a known key the verdict is null, a gap and no pass."""

    @F.pandas_udf("boolean")
    def judged(digest: pd.Series, signature: pd.Series, key: pd.Series) -> pd.Series:
        whole = digest.notna() & signature.notna() & key.notna()
        out = pd.Series(pd.NA, index=digest.index, dtype="boolean")
        if whole.any():
            out[whole] = pd.array(list(verify(digest[whole], signature[whole], key[whole])), dtype="boolean")
        return out

    known = keys.select(F.col("key_id").alias("_key_id"), "key")
    rows = manifests.select("manifest_id", "digest", "signature", "key_id").join(known, F.col("key_id") == F.col("_key_id"), "left")
    return rows.select("manifest_id", judged("digest", "signature", "key").alias("signature_valid"))


def admit(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """The verified candidates that the registry doesn't have yet, each id once."""
    return candidates.filter("verified").join(registry.select("manifest_id"), "manifest_id", "left_anti").dropDuplicates(["manifest_id"])
