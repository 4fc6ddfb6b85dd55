"""Audit chains and manifests, over events."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaya.operators import ledger, provenance
from assaya.plans.bindings import MANIFESTS_SQL, artifacts, audit_events, manifests
from assaya.shared import cut, table


def audit_chain_verification(spark, sf_dir) -> DataFrame:
    return ledger.verify_chain(cut(audit_events(spark, sf_dir)))


def audit_payload_failures(spark, sf_dir) -> DataFrame:
    return ledger.payload_failures(cut(audit_events(spark, sf_dir)))


def audit_assessment_verification(spark, sf_dir) -> DataFrame:
    return ledger.verify_subset(cut(audit_events(spark, sf_dir)))


def audit_chain_ends(spark, sf_dir) -> DataFrame:
    return ledger.chain_ends(cut(audit_events(spark, sf_dir))).select("chain_id", "first_event", "last_event", "length", (F.col("first_hash") == F.col("last_hash")).alias("single"))


def replay_anomalies(spark, sf_dir) -> DataFrame:
    """Every manifest held against all."""
    rows = cut(manifests(spark, sf_dir).select("manifest_id", "nonce"))
    return provenance.replays(rows, rows)


def sequence_anomalies(spark, sf_dir) -> DataFrame:
    return provenance.sequence_anomalies(manifests(spark, sf_dir))


def nonce_reuse(spark, sf_dir) -> DataFrame:
    return provenance.nonce_reuse(manifests(spark, sf_dir))


def manifest_bindings(spark, sf_dir) -> DataFrame:
    found = provenance.bindings(manifests(spark, sf_dir), artifacts(spark, sf_dir)).filter("size(failed) > 0 or size(missing) > 0")
    return found.select("manifest_id", F.array_join("failed", ",").alias("failed"), F.array_join("missing", ",").alias("missing"))


def signatures(manifests: DataFrame) -> DataFrame:
    """Verdicts on signatures: none for every 17th manifest, false for every 19th of the others."""
    return manifests.select("manifest_id", F.when(F.col("manifest_id") % 17 != 0, F.col("manifest_id") % 19 != 0).alias("signature_valid"))


def manifest_verdicts(spark, sf_dir) -> DataFrame:
    rows = cut(manifests(spark, sf_dir))
    odd = provenance.sequence_anomalies(rows).select("manifest_id").union(provenance.nonce_reuse(rows).select("manifest_id"))
    signed = signatures(rows)
    bound = provenance.bindings(rows, artifacts(spark, sf_dir))
    return provenance.verdicts(rows, bound, odd, signed).groupBy("risk", "confidence").agg(F.count("*").alias("n"), F.min("manifest_id").alias("first"))


def manifest_admission(spark, sf_dir) -> DataFrame:
    rows = manifests(spark, sf_dir).withColumn("verified", F.col("manifest_id") % 19 != 0)
    return provenance.admit(rows, rows.filter("manifest_id % 3 = 0")).select("manifest_id", "nonce")


def next_sequence(spark, sf_dir) -> DataFrame:
    """The largest sequence of each user's stream, -1 where no event could be numbered."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream")).distinct()
    most = manifests(spark, sf_dir).groupBy("stream").agg(F.max("sequence").alias("m"))
    return users.join(most, "stream", "left").select("stream", F.coalesce("m", F.lit(-1)).alias("max_sequence"))


SEQ = f"""{MANIFESTS_SQL},
expected AS (SELECT manifest_id, sequence, 1 + max(sequence) OVER (PARTITION BY stream ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM manifests),
seq AS (SELECT manifest_id, CASE WHEN sequence < e THEN 'sequence_regression' ELSE 'sequence_gap' END AS anomaly, CASE WHEN sequence > e THEN sequence - e END AS gap_size FROM expected WHERE sequence <> e),
nonces AS (SELECT manifest_id, row_number() OVER w AS n, first_value(manifest_id) OVER w AS first_manifest FROM manifests WINDOW w AS (PARTITION BY nonce ORDER BY ts, event_id))"""
BOUND = """
bound AS (SELECT manifest_id, list_filter([CASE WHEN manifest_id % 11 = 0 AND sha256('other') <> input_sha256 THEN 'input_sha256' END], lambda x: x IS NOT NULL) AS failed,
 list_filter([CASE WHEN manifest_id % 13 = 0 THEN 'output_sha256' END], lambda x: x IS NOT NULL) AS missing FROM manifests)"""
#: A chain in SQL: recursion by position, hashing the same canonical text.
CHAIN = """
base AS (SELECT user_id::VARCHAR AS chain_id, event_id, event_type, ts, props, sha256(props) AS payload_digest, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp_utc,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events),
chain AS (SELECT b.*, repeat('0', 64) AS previous_hash, sha256('{"actor":"service","assessment_id":"' || chain_id || '","event_id":"' || event_id || '","event_type":"' || event_type || '","payload_digest":"' || payload_digest || '","previous_hash":"' || repeat('0', 64) || '","timestamp_utc":"' || timestamp_utc || '"}') AS current_hash FROM base b WHERE seq = 0
 UNION ALL SELECT b.*, c.current_hash, sha256('{"actor":"service","assessment_id":"' || b.chain_id || '","event_id":"' || b.event_id || '","event_type":"' || b.event_type || '","payload_digest":"' || b.payload_digest || '","previous_hash":"' || c.current_hash || '","timestamp_utc":"' || b.timestamp_utc || '"}') FROM chain c JOIN base b ON b.chain_id = c.chain_id AND b.seq = c.seq + 1),
broken AS (SELECT *, event_id % 97 = 0 AS hash_bad, event_id % 89 = 0 AS payload_bad, lag(current_hash, 1, repeat('0', 64)) OVER (PARTITION BY chain_id ORDER BY seq) <> previous_hash AS link_bad FROM chain)"""

QUERIES = {f.__name__: f for f in (audit_chain_verification, audit_payload_failures, audit_assessment_verification, audit_chain_ends, replay_anomalies, sequence_anomalies, nonce_reuse, manifest_bindings, manifest_verdicts, manifest_admission, next_sequence)}
ORACLES = {
    "audit_chain_verification": f"""WITH RECURSIVE {CHAIN}, f AS (SELECT chain_id, min(CASE WHEN hash_bad OR link_bad THEN seq END) AS p, count(*) AS n FROM broken GROUP BY 1)
SELECT f.chain_id, n AS events_checked, p IS NULL AS valid, p AS first_failure, CASE WHEN b.hash_bad THEN 'hash_mismatch' WHEN b.link_bad THEN 'linkage_broken' END AS failure_type FROM f LEFT JOIN broken b ON b.chain_id = f.chain_id AND b.seq = f.p""",
    "audit_payload_failures": f"""WITH RECURSIVE {CHAIN}, f AS (SELECT chain_id, min(CASE WHEN hash_bad OR link_bad THEN seq END) AS p FROM broken GROUP BY 1)
SELECT chain_id, seq AS position FROM broken JOIN f USING (chain_id) WHERE payload_bad AND (p IS NULL OR seq < p)""",
    "audit_assessment_verification": f"WITH RECURSIVE {CHAIN} SELECT chain_id AS assessment_id, count(*) AS events_checked, count_if(hash_bad) AS hash_failures, count_if(payload_bad) AS payload_failures FROM broken GROUP BY 1",
    "audit_chain_ends": "SELECT user_id::VARCHAR AS chain_id, arg_min(event_id, (ts, event_id))::VARCHAR AS first_event, arg_max(event_id, (ts, event_id))::VARCHAR AS last_event, count(*) AS length, count(*) = 1 AS single FROM events GROUP BY 1",
    "replay_anomalies": f"""WITH {MANIFESTS_SQL} SELECT manifest_id, 'duplicate_manifest' AS anomaly FROM manifests
UNION SELECT a.manifest_id, 'duplicate_nonce' FROM manifests a WHERE EXISTS (SELECT 1 FROM manifests b WHERE b.nonce = a.nonce AND b.manifest_id <> a.manifest_id)""",
    "sequence_anomalies": f"WITH {SEQ} SELECT manifest_id, anomaly, gap_size FROM seq",
    "nonce_reuse": f"WITH {SEQ} SELECT manifest_id, first_manifest FROM nonces WHERE n > 1",
    "manifest_bindings": f"WITH {MANIFESTS_SQL}, {BOUND} SELECT manifest_id, array_to_string(failed, ',') AS failed, array_to_string(missing, ',') AS missing FROM bound WHERE len(failed) > 0 OR len(missing) > 0",
    "manifest_verdicts": f"""WITH {SEQ}, {BOUND}, odd AS (SELECT manifest_id FROM seq UNION SELECT manifest_id FROM nonces WHERE n > 1),
v AS (SELECT b.manifest_id, CASE WHEN len(failed) > 0 OR (b.manifest_id % 17 <> 0 AND b.manifest_id % 19 = 0) THEN 'HIGH' WHEN o.manifest_id IS NOT NULL THEN 'MEDIUM' ELSE 'NONE' END AS risk,
 len(missing) + CASE WHEN b.manifest_id % 17 = 0 THEN 1 ELSE 0 END AS gaps FROM bound b LEFT JOIN odd o ON o.manifest_id = b.manifest_id)
SELECT risk, CASE WHEN gaps >= 2 THEN 'LOW' WHEN gaps = 1 THEN 'MODERATE' ELSE 'HIGH' END AS confidence, count(*) AS n, min(manifest_id) AS first FROM v GROUP BY 1, 2""",
    "manifest_admission": f"WITH {MANIFESTS_SQL} SELECT manifest_id, nonce FROM manifests WHERE manifest_id % 19 <> 0 AND manifest_id % 3 <> 0",
    "next_sequence": f"WITH {MANIFESTS_SQL} SELECT u.stream, coalesce(max(m.sequence), -1) AS max_sequence FROM (SELECT DISTINCT user_id AS stream FROM events) u LEFT JOIN manifests m USING (stream) GROUP BY 1",
}
