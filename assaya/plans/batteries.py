"""The whole battery over the given tables: documents as data, lineitem, events and embeddings as models, events as manifests."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaya.functions.canonical import canonical, payload_digest
from assaya.operators import battery
from assaya.plans import duplicates, ledgers, statistics
from assaya.plans.bindings import artifacts, features, manifests, outputs, patches, samples, tensors
from assaya.shared import cut, table


def _frames(spark, sf_dir, names: set[str]) -> dict[str, DataFrame]:
    """Those of the battery's frames that are named; no other is worked out."""
    kept = {
        "samples": lambda: battery.kept(samples(spark, sf_dir), "samples"),
        "features": lambda: battery.kept(features(spark, sf_dir), "features"),
        "patches": lambda: battery.kept(patches(spark, sf_dir), "patches"),
        "fingerprints": lambda: statistics.known_models(spark, sf_dir),
        "fingerprint_fields": lambda: statistics.fingerprint_fields(spark, sf_dir, 1),
        "reference_fields": lambda: statistics.fingerprint_fields(spark, sf_dir, 0),
        "tensors": lambda: tensors(spark, sf_dir),
        "activations": lambda: statistics.activations(spark, sf_dir),
        "outputs": lambda: cut(outputs(spark, sf_dir)),
    }
    found = {name: make() for name, make in kept.items() if name in names}
    if "model_files" in names:
        found |= dict(zip(("model_files", "reference_files", "output_errors"), statistics.model_files(spark, sf_dir)))
    if "manifests" in names:
        rows = battery.kept(manifests(spark, sf_dir), "manifests")
        found |= {"manifests": rows, "artifacts": artifacts(spark, sf_dir, rows), "signatures": ledgers.signatures(rows)}
    return found


def _run(spark, sf_dir, codes: tuple[str, ...] = tuple(battery.REGISTRY)):
    return battery.run_battery(spark, _frames(spark, sf_dir, battery.needed(codes)), checks={code: battery.REGISTRY[code] for code in codes})


def battery_verdicts(spark, sf_dir) -> DataFrame:
    return _run(spark, sf_dir)[2].drop("started_at", "duration_ms")


def battery_gaps(spark, sf_dir) -> DataFrame:
    """An assessment of samples alone: what can't be checked."""
    frames = {"samples": table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.lit(None).cast("string").alias("contributor"), F.array().cast("array<string>").alias("labels"))}
    return battery.coverage_gaps(battery.run_battery(spark, frames, checks={c: x for c, x in battery.REGISTRY.items() if c != "DI-01"})[2])


def battery_export(spark, sf_dir) -> DataFrame:
    """The documents of the export, counted by check and part, with the samples that they name."""
    findings, evidence, results = _run(spark, sf_dir, ("DI-01", "DI-02", "DI-05", "PI-01"))
    rows = battery.export(results, findings, evidence)
    sound = F.get_json_object("document", "$.part") == F.col("part")
    return rows.groupBy("detector_id", "part").agg(F.count_if(sound).alias("n"), F.countDistinct("finding_id").alias("findings"), F.sum("sample_id").alias("samples"))


def battery_context(spark, sf_dir) -> DataFrame:
    findings, evidence, _ = _run(spark, sf_dir, ("DI-01", "PI-01"))
    return battery.context_text(findings, evidence)


def payload_digests(spark, sf_dir) -> DataFrame:
    """Payloads with the properties of events in canonical form, and their digest."""
    n = F.get_json_object("props", "$.k")
    payload = F.concat(F.lit('{"z": {"y": [2, "é"], "x": null}, "n": '), n, F.lit('.50, "e": "'), "event_type", F.lit('"}'))
    return table(spark, sf_dir, "events").select("event_id", canonical(payload).alias("canonical"), payload_digest(payload).alias("digest"))


QUERIES = {f.__name__: f for f in (battery_verdicts, battery_gaps, battery_export, battery_context, payload_digests)}

_OF = {**duplicates.ORACLES, **statistics.ORACLES, **ledgers.ORACLES}
_of = lambda name: f"({_OF[name]})"
_PATTERNS = f"""(WITH RECURSIVE {duplicates.LED}, f AS (SELECT location, leader, CASE WHEN count(DISTINCT class) >= 2 OR count(*) >= 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM placed GROUP BY ALL
 HAVING count(DISTINCT sha256) >= greatest(3, floor(0.15 * (SELECT count(DISTINCT seq) FROM patches))))
SELECT location, leader, severity, seq FROM placed JOIN f USING (location, leader) QUALIFY row_number() OVER (PARTITION BY location, leader ORDER BY seq) <= 10)"""
#: (code, sample, issue) of what the first checks flag.
_EXACT = "(SELECT doc_id AS seq, sha256(text) AS sha, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents WHERE text IS NOT NULL QUALIFY count(*) OVER (PARTITION BY sha256(text)) > 1)"
_NEAR = f"(WITH RECURSIVE {duplicates.CLUSTERS} SELECT s.seq, o.root FROM samples s JOIN of_hash o USING (bits))"
_FLAGGED = {
    "DI-01": f"SELECT seq, 'exact_duplicates' AS issue FROM {_EXACT} UNION ALL SELECT seq, 'near_duplicates' FROM {_NEAR}",
    "DI-02": f"SELECT unnest([seq_a, seq_b]) AS seq, 'label_conflict' AS issue FROM {_of('label_conflicts')} UNION ALL SELECT seq, 'label_outlier' FROM {_of('outliers_by_label')}",
    "DI-03": f"SELECT seq, 'trigger_injection' AS issue FROM {_PATTERNS}",
    "DI-04": f"SELECT seq, 'sample_distribution_outlier' AS issue FROM {_of('distribution_outliers')}",
}


def _contributors(codes: tuple[str, ...]) -> str:
    flagged = " UNION ALL ".join(f"({_FLAGGED[c]})" for c in codes)
    return f"""(WITH f AS ({flagged}), c AS (SELECT coalesce(nullif(trim(source), ''), 'unattributed') AS c, count(DISTINCT doc_id) AS total, count(DISTINCT f.seq) AS flagged FROM documents LEFT JOIN f ON f.seq = doc_id GROUP BY 1)
SELECT c, CASE WHEN flagged / total >= 0.5 AND flagged >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM c WHERE c <> 'unattributed' AND flagged >= 2 AND flagged / total >= 0.3)"""


_RANK = "['NONE', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL']"
_SURE = "['LOW', 'MODERATE', 'HIGH']"


def _worst(column: str) -> str:
    return f"coalesce({_RANK}[max(list_position({_RANK}, {column}))], 'NONE')"


def _row(code: str, rows: str, risk: str, sure: str, findings: str = "count(*)", status: str = "'SUCCESS'") -> str:
    """The verdict of a check over ``rows``; each of its findings has evidence."""
    return f"""SELECT '{code}' AS detector_id, {status} AS status, {risk} AS risk_level, {sure} AS confidence_level, true AS applicable, NULL::VARCHAR AS reason, ({findings})::BIGINT AS findings_count, ({findings})::BIGINT AS evidence_count FROM ({rows})"""


def _data(code: str, rows: str) -> str:
    """A check whose confidence follows from the worst ``severity`` of its rows."""
    known = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in battery.CONFIDENCE[code].items())
    return _row(code, rows, _worst("severity"), f"CASE {_worst('severity')} {known} ELSE 'HIGH' END")


def _model(code: str, rows: str, findings: str = "count(*)", status: str = "'SUCCESS'") -> str:
    return _row(code, rows, _worst("risk"), f"{_SURE}[min(list_position({_SURE}, confidence))]", findings, status)


_PARTIAL = "CASE WHEN bool_or(status = 'PARTIAL') THEN 'PARTIAL' ELSE 'SUCCESS' END"
_PROVENANCE = f"""(WITH {ledgers.SEQ}, {ledgers.BOUND} SELECT 'replay_detected' AS k, manifest_id AS m, manifest_id || '-' || anomaly AS key, anomaly AS what FROM seq
 UNION ALL SELECT 'replay_detected', manifest_id, manifest_id || '-duplicate_nonce', 'duplicate_nonce' FROM nonces WHERE n > 1 UNION ALL SELECT 'input_mismatch', manifest_id, manifest_id::VARCHAR, 'input_sha256' FROM bound WHERE len(failed) > 0
 UNION ALL SELECT 'coverage_gap', manifest_id, manifest_id::VARCHAR, 'output_sha256' FROM bound WHERE len(missing) > 0
 UNION ALL SELECT CASE WHEN manifest_id % 19 = 0 THEN 'signature_invalid' ELSE 'provenance_valid' END, manifest_id, manifest_id::VARCHAR, '' FROM bound WHERE manifest_id % 17 <> 0)"""
_DI01 = f"""(SELECT 'exact_duplicates' AS k, first AS seq, 'MEDIUM' AS severity, count(*) || ' identical samples' AS title, '{{"sha256":"' || sha || '","n":' || count(*) || '}}' AS data FROM {_EXACT} GROUP BY first, sha
 UNION ALL SELECT 'near_duplicates', cluster, 'LOW', size || ' samples within ' || max_distance || ' bits', '{{"size":' || size || ',"max_distance":' || max_distance || '}}' FROM {_of('near_duplicate_clusters')})"""
_PI01 = f"""(SELECT k, m, key, CASE k WHEN 'replay_detected' THEN 'MEDIUM' WHEN 'coverage_gap' THEN 'INFO' WHEN 'provenance_valid' THEN 'INFO' ELSE 'HIGH' END AS severity,
 CASE k WHEN 'replay_detected' THEN replace(what, '_', ' ') WHEN 'coverage_gap' THEN 'not verified: ' || what WHEN 'provenance_valid' THEN 'signature verified' WHEN 'signature_invalid' THEN 'invalid signature' ELSE what || ' differs' END AS title,
 CASE k WHEN 'replay_detected' THEN '{{"manifest_id":' || m || ',"anomaly":"' || what || '"}}' WHEN 'coverage_gap' THEN '{{"manifest_id":' || m || ',"missing":["' || what || '"]}}' WHEN 'input_mismatch' THEN '{{"manifest_id":' || m || ',"what":"' || what || '"}}' ELSE '{{"manifest_id":' || m || '}}' END AS data FROM {_PROVENANCE})"""


def _context(code: str, rows: str) -> str:
    """``rows``: seq, id, severity, title, data."""
    return f"""SELECT '{code}' AS detector_id, CASE WHEN length(t) > 7500 THEN substr(t, 1, 7485) || '... [truncated]' ELSE t END AS context FROM (WITH r AS ({rows}),
 l AS ((SELECT 0 AS part, seq, '[' || severity || '] ' || title AS line FROM r ORDER BY seq, id LIMIT 25) UNION ALL (SELECT 1, seq, substr(data, 1, 800) FROM r ORDER BY seq, id LIMIT 8)) SELECT string_agg(line, chr(10) ORDER BY part, seq, line) AS t FROM l)"""


ORACLES = {
    "payload_digests": """WITH c AS (SELECT event_id, '{"e":"' || event_type || '","n":' || (props->>'k') || '.5,"z":{"x":null,"y":[2,"é"]}}' AS canonical FROM events) SELECT event_id, canonical, sha256(canonical) AS digest FROM c""",
    "battery_gaps": """SELECT code AS detector_id, code || ': skipped: ' || reason AS gap FROM (VALUES ('DI-02', 'fewer than two labelled samples'), ('DI-03', 'fewer than three samples with patches'), ('DI-04', 'fewer than five samples with features'), ('DI-05', 'no contributor'),
 ('MI-01', 'no model'), ('MI-02', 'no tensors'), ('MI-03', 'no activations'), ('MI-04', 'no model file'), ('MI-05', 'no outputs of perturbed probes'), ('PI-01', 'no manifest')) t(code, reason)""",
    "battery_verdicts": " UNION ALL ".join(
        f"({part})"
        for part in (
            _row("DI-01", _of("duplicate_verdict"), "risk", "confidence", "exact_clusters + near_clusters", "status"),
            _data("DI-02", f"SELECT 'HIGH' AS severity FROM {_of('label_conflicts')} UNION ALL SELECT 'MEDIUM' FROM {_of('outliers_by_label')}"),
            _data("DI-03", f"SELECT DISTINCT location, leader, severity FROM {_PATTERNS}"),
            _data("DI-04", _of("distribution_outliers")),
            _data("DI-05", _contributors(tuple(_FLAGGED))),
            _model("MI-01", _of("fingerprint_verdicts"), "count(*) + count_if(n_diffs > 0)", _PARTIAL),
            _model("MI-02", _of("parameter_verdicts"), "count(*) + count_if(risk <> 'NONE')"),
            _model("MI-03", _of("activation_verdicts"), "count(*) + count_if(risk <> 'NONE')"),
            _model("MI-04", _of("file_comparisons")),
            _model("MI-05", _of("trigger_verdicts"), status=_PARTIAL),
            _model("PI-01", _of("manifest_verdicts"), f"SELECT count(*) FROM {_PROVENANCE}"),
        )
    ),
    "battery_export": " UNION ALL ".join(
        f"({part})"
        for part in (
            "SELECT c AS detector_id, 'verdict' AS part, 1::BIGINT AS n, 0::BIGINT AS findings, NULL::BIGINT AS samples FROM (VALUES ('DI-01'), ('DI-02'), ('DI-05'), ('PI-01')) t(c)",
            f"SELECT 'DI-01', 'finding', count(*), count(*), NULL FROM {_DI01}",
            f"SELECT 'DI-01', 'evidence', count(*), count(DISTINCT (issue, root)), sum(seq)::BIGINT FROM (SELECT seq, first AS root, 'e' AS issue FROM {_EXACT} UNION ALL SELECT seq, root, 'n' FROM {_NEAR})",
            f"SELECT 'DI-02', 'finding', count(*), count(*), NULL FROM (SELECT 1 FROM {_of('label_conflicts')} UNION ALL SELECT 1 FROM {_of('outliers_by_label')}) HAVING count(*) > 0",
            f"SELECT 'DI-02', 'evidence', sum(n)::BIGINT, count(*), sum(s)::BIGINT FROM (SELECT 2 AS n, seq_a + seq_b AS s FROM {_of('label_conflicts')} UNION ALL SELECT 1, seq FROM {_of('outliers_by_label')}) HAVING count(*) > 0",
            f"SELECT 'DI-05', p, count(*), count(*), NULL FROM {_contributors(('DI-01', 'DI-02'))}, (VALUES ('finding'), ('evidence')) t(p) GROUP BY p",
            f"SELECT 'PI-01', p, count(*), count(*), NULL FROM {_PROVENANCE}, (VALUES ('finding'), ('evidence')) t(p) GROUP BY p",
        )
    ),
    "battery_context": f"""({_context("DI-01", f"SELECT seq, sha256('DI-01|' || k || '|' || seq) AS id, severity, title, data FROM {_DI01}")}) UNION ALL
({_context("PI-01", f"SELECT m AS seq, sha256('PI-01|' || k || '|' || key) AS id, severity, title, data FROM {_PI01}")})""",
}
