"""Plans, gaps, provenance, exports and what is shown of an assessment: orders as assessments, their lines as results,
findings and evidence; and annotation files built from them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaya.functions.canonical import canonical
from assaya.operators import evidence as ev
from assaya.operators import reports, search, similarity, statistics, verdicts
from assaya.plans import ledgers
from assaya.plans.bindings import TENSORS_SQL, audit_events, tensors
from assaya.plans.statistics import flags
from assaya.shared import cut, table
from assaya.sources import annotations as an


def detector_plan(spark, sf_dir) -> DataFrame:
    """Assessments by what they have: how many each check applies to, and why not to the others."""
    k = F.col("o_orderkey")
    assets = table(spark, sf_dir, "orders").select(k.alias("assessment_id"), (k % 2 == 0).alias("has_dataset"), (k % 3 != 0).alias("has_model"), (k % 5 == 0).alias("has_reference_model"), (k % 7 != 1).alias("has_provenance_manifest"))
    return reports.plan(assets).groupBy("position", "code", "applicable", "reason").agg(F.count("*").alias("n"))


def results(spark, sf_dir) -> DataFrame:
    """Lines as results of the first checks."""
    codes = F.array(*[F.lit(c[0]) for c in reports.CHECKS])
    status = F.when(F.col("l_returnflag") == "R", "SKIPPED").when(F.col("l_returnflag") == "A", F.when(F.col("l_suppkey") % 2 == 0, "UNAVAILABLE").otherwise("FAILED")).otherwise(F.when(F.col("l_suppkey") % 3 == 0, "PARTIAL").otherwise("SUCCESS"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("assessment_id"), F.get(codes, F.col("l_linenumber") - 1).alias("code"), status.alias("status"), (F.col("l_partkey") % 9 != 0).alias("applicable"),
        F.when(F.col("l_partkey") % 4 == 0, "no such file").alias("error"), F.when(F.col("l_tax") > 0.05, "LOW").otherwise("HIGH").alias("confidence_level"),
    )


def coverage_gap_rows(spark, sf_dir) -> DataFrame:
    return reports.gaps(results(spark, sf_dir))


def limiting_factors(spark, sf_dir) -> DataFrame:
    return reports.limiting_factors(results(spark, sf_dir))


def provenance_statuses(spark, sf_dir) -> DataFrame:
    kinds = F.array(*map(F.lit, ("provenance_valid", "signature_invalid", "replay_detected", "input_mismatch", "output_mismatch", "coverage_gap", "provenance_valid")))
    rows = table(spark, sf_dir, "lineitem").filter("l_discount > 0.07").select(F.col("l_orderkey").alias("assessment_id"), F.get(kinds, F.col("l_linenumber") - 1).alias("subcategory"))
    return reports.provenance_status(rows)


def manifests_shown(spark, sf_dir) -> DataFrame:
    """Returned lines as an order's own manifests; other lines name the manifest of the order with their supplier's number."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("assessment_id"))
    own = items.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("assessment_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("manifest_id"), F.col("l_quantity").alias("sequence"))
    named = items.filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("assessment_id"), F.col("l_linenumber").alias("seq"), (F.col("l_suppkey") * 10 + 1).alias("manifest_id"))
    return reports.manifest_shown(orders, own, named)


def contributor_overview(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.concat_ws("/", "source", "lang").alias("contributor"))
    marked = cut(flags(spark, sf_dir))
    rates = statistics.contributor_rates(docs, marked).withColumn("anomalous", F.col("flagged") >= 2)
    return reports.contributor_overview(rates, marked, docs).select("contributors", "samples", "flagged", F.round("rate", 6).alias("rate"))


def audit_export(spark, sf_dir) -> DataFrame:
    events = cut(audit_events(spark, sf_dir))
    return reports.audit_export(events, canonical(F.col("payload")))


def assessment_export(spark, sf_dir) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    key = F.col("l_orderkey").alias("assessment_id")
    findings = items.select(key, F.col("l_linenumber").alias("seq"), F.concat(F.lit("/home/u/"), "l_partkey", F.lit(".png")).alias("title"), F.lit("s").alias("api_key"), F.col("l_linestatus").alias("severity"))
    seen = items.filter("l_linenumber = 1").select(key, F.col("l_linenumber").alias("seq"), F.array("l_partkey", "l_suppkey").alias("data"), F.concat(F.lit("Bearer "), "l_linestatus").alias("note"))
    head = orders.select(F.col("o_orderkey").alias("assessment_id"), F.lit(0).alias("seq"), F.col("o_orderpriority").alias("title"), F.col("o_custkey").alias("owner"))
    return reports.assessment_export({"assessment": head, "finding": findings, "evidence": seen})


def findings_by_run(spark, sf_dir) -> DataFrame:
    """Findings whose check ran at low confidence and wasn't told to be done; some have no run."""
    items = table(spark, sf_dir, "lineitem")
    findings = items.select(F.col("l_orderkey").alias("assessment_id"), F.concat(F.lit("di-0"), "l_linenumber").alias("detector_id"))
    ran = items.filter("l_linenumber < 4").groupBy(F.col("l_orderkey").alias("assessment_id"), F.concat(F.lit("DI-0"), "l_linenumber").alias("detector_id")).agg(F.max("l_tax").alias("t"))
    runs = ran.select("assessment_id", "detector_id", F.lit("NONE").alias("risk_level"), F.when(F.col("t") > 0.04, "LOW").otherwise("HIGH").alias("confidence_level"), F.lit("").alias("status"))
    return search.run_facets(findings, runs, {"risk": "None", "confidence": "low", "status": "all"})


def keyed_events(spark, sf_dir) -> DataFrame:
    """Clicks of one user in order."""
    return search.keyed(table(spark, sf_dir, "events"), {"user_id": 7, "event_type": "click"}, ["ts", "event_id"]).select("event_id", "user_id", "value")


def recent_uploads(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.col("o_orderkey").alias("_k"))
    return search.newest(rows, "upload", "_k", 50, ["o_orderkey"], most=50)


def evidence_in_order(spark, sf_dir) -> DataFrame:
    """Lines of the most urgent orders, as evidence of these."""
    findings = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("finding_id"), F.col("o_orderdate").alias("created_at"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding_id"), F.col("l_linenumber").alias("seq"), "l_partkey")
    return ev.evidence_of(findings, rows).drop("created_at")


def severities(spark, sf_dir) -> DataFrame:
    levels = F.array(*map(F.lit, ("NONE", "low", "MEDIUM", "HIGH", "CRITICAL", "odd")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.get(levels, (F.col("l_partkey") % 6).cast("int")).alias("risk"))
    return rows.groupBy("risk").agg(F.count("*").alias("n"), F.max(verdicts.severity_of(F.col("risk"))).alias("severity"))


def tensors_shown(spark, sf_dir) -> DataFrame:
    """The first 2 tensors of each model in its evidence."""
    stats = statistics.value_statistics(tensors(spark, sf_dir), ["model_id", "tensor_name"])
    return similarity.first_per_key(stats, ["model_id"], ["tensor_name"], 2).select("model_id", "tensor_name", "numel")


def sidecar_records(spark, sf_dir) -> DataFrame:
    """Each order's lines in one of the shapes of a sidecar."""
    items = table(spark, sf_dir, "lineitem").filter("l_linenumber < 3")
    f, who, label = F.concat(F.lit("f"), "l_partkey"), F.concat(F.lit("c"), "l_suppkey"), F.col("l_returnflag")
    shapes = (
        F.to_json(F.struct(F.create_map(f, who).alias("contributors"), F.create_map(f, F.array(label, label)).alias("labels"))),
        F.to_json(F.struct(F.create_map(f, label).alias("labels"))),
        F.to_json(F.struct(F.array(F.struct(f.alias("file_name"), who.alias("source"), label.alias("label"))).alias("samples"))),
        F.to_json(F.create_map(f, who)),
        F.lit("{broken"),
    )
    n = F.col("l_orderkey") % 5
    text = shapes[4]
    for i in range(4):
        text = F.when(n == i, shapes[i]).otherwise(text)
    found = an.sidecar_records(items.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("precedence"), text.alias("value")))
    return found.select("file_name", "precedence", "contributor", F.array_join("labels", ",").alias("labels"))


def annotation_keys(spark, sf_dir) -> DataFrame:
    """Orders as annotation files that lack a list or have something else in its place."""
    n = F.col("o_orderkey")
    lists = lambda i, name: F.when(n % i == 1, F.lit(None).cast("string")).when(n % i == 2, F.lit(f'"{name}": 5')).otherwise(F.lit(f'"{name}": []'))
    text = F.when(n % 11 == 0, F.lit("{")).otherwise(F.concat(F.lit("{"), F.concat_ws(", ", lists(3, "images"), lists(4, "annotations"), lists(5, "categories")), F.lit("}")))
    found = an.missing_keys(table(spark, sf_dir, "orders").select(n.alias("file"), text.alias("value")))
    return found.groupBy("code", "key").agg(F.count("*").alias("n"), F.min("file").alias("first"))


def class_names(spark, sf_dir) -> DataFrame:
    """Lines as label files of their orders, with names for the first classes."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("stem"), (F.col("l_linenumber") % 4).cast("long").alias("class_no"))
    names = table(spark, sf_dir, "region").filter("r_regionkey < 3").select(F.col("r_regionkey").cast("long").alias("class_no"), F.lower("r_name").alias("name"))
    return an.class_names(items, names).select("stem", F.array_join("labels", ",").alias("labels"))


QUERIES = {
    f.__name__: f
    for f in (
        detector_plan, coverage_gap_rows, limiting_factors, provenance_statuses, manifests_shown, contributor_overview, audit_export, assessment_export, findings_by_run, keyed_events,
        recent_uploads, evidence_in_order, severities, tensors_shown, sidecar_records, annotation_keys, class_names,
    )
}

_q = lambda text: "'" + text.replace("'", "''") + "'"
CHECKS_SQL = "(VALUES " + ", ".join(f"({i}, {_q(c)}, {_q(req)}, {_q(imp)}, {_q(act)})" for i, (c, _, req, imp, act) in enumerate(reports.CHECKS)) + ") t(position, code, required, impact, action)"
_RESULTS = """r AS (SELECT l_orderkey AS assessment_id, l_linenumber - 1 AS position, CASE l_returnflag WHEN 'R' THEN 'SKIPPED' WHEN 'A' THEN CASE WHEN l_suppkey % 2 = 0 THEN 'UNAVAILABLE' ELSE 'FAILED' END ELSE CASE WHEN l_suppkey % 3 = 0 THEN 'PARTIAL' ELSE 'SUCCESS' END END AS status,
 l_partkey % 9 <> 0 AS applicable, CASE WHEN l_partkey % 4 = 0 THEN 'no such file' END AS error, l_tax > 0.05 AS low FROM lineitem)"""
GAPS_SQL = f"""{_RESULTS}, g AS (SELECT assessment_id, position, code, CASE status WHEN 'SKIPPED' THEN 'detector_skipped' ELSE 'detector_unavailable' END AS reason, required, error, impact, action FROM r JOIN {CHECKS_SQL} USING (position) WHERE applicable AND status IN ('SKIPPED', 'UNAVAILABLE'))"""
ORACLES = {
    "detector_plan": f"""WITH o AS (SELECT o_orderkey % 2 = 0 AS d, o_orderkey % 3 <> 0 AS m, o_orderkey % 5 = 0 AS ref, o_orderkey % 7 <> 1 AS p FROM orders),
x AS (SELECT position, code, CASE WHEN code LIKE 'DI%' THEN d WHEN code = 'MI-04' THEN m AND ref WHEN code LIKE 'MI%' THEN m ELSE p END AS applicable,
 CASE WHEN code LIKE 'DI%' THEN 'no_dataset_provided' WHEN code = 'PI-01' THEN 'no_provenance_manifest_provided' WHEN code = 'MI-04' AND m THEN 'no_reference_model_provided' ELSE 'no_model_provided' END AS reason FROM o, {CHECKS_SQL})
SELECT position, code, applicable, CASE WHEN NOT applicable THEN reason END AS reason, count(*) AS n FROM x GROUP BY ALL""",
    "coverage_gap_rows": f"WITH {GAPS_SQL} SELECT assessment_id, code, reason, required, coalesce(error, reason) AS observed, impact, action FROM g",
    "limiting_factors": f"""WITH {GAPS_SQL}, s AS (SELECT assessment_id, count_if(status NOT IN ('SKIPPED', 'UNAVAILABLE')) AS ran, count_if(status = 'PARTIAL') AS p, count_if(status = 'FAILED') AS f, count_if(status NOT IN ('SKIPPED', 'UNAVAILABLE') AND low) AS l FROM r GROUP BY 1)
SELECT assessment_id, 0 AS source, 0 AS seq, 'All applicable detectors were unavailable or skipped.' AS text FROM s WHERE ran = 0
UNION ALL SELECT assessment_id, 1, position + 1, CASE WHEN ran = 0 THEN code || ': ' || reason ELSE code || ' could not run (' || reason || '): ' || impact END FROM g JOIN s USING (assessment_id)
UNION ALL SELECT assessment_id, 2, 0, 'One or more detectors completed with partial coverage (framework limitations or missing optional capabilities).' FROM s WHERE ran > 0 AND p > 0
UNION ALL SELECT assessment_id, 3, 0, 'One or more detectors failed during execution.' FROM s WHERE ran > 0 AND f > 0
UNION ALL SELECT assessment_id, 4, 0, l || ' detector(s) reported LOW confidence (insufficient data or analysis limitations).' FROM s WHERE ran > 0 AND l > 0""",
    "provenance_statuses": """SELECT l_orderkey AS assessment_id, CASE WHEN bool_or(l_linenumber = 2) THEN 'FAILED' ELSE 'VERIFIED' END AS signature, CASE WHEN bool_or(l_linenumber = 3) THEN 'REPLAY_DETECTED' ELSE 'CLEAN' END AS replay,
 CASE WHEN bool_or(l_linenumber IN (4, 5)) THEN 'MISMATCH' ELSE 'BOUND' END AS binding FROM lineitem WHERE l_discount > 0.07 GROUP BY 1""",
    "manifests_shown": """WITH m AS (SELECT l_orderkey AS a, l_orderkey * 10 + l_linenumber AS m, l_quantity AS q FROM lineitem WHERE l_returnflag = 'R'), o AS (SELECT a, arg_min(m, (q, m)) AS m FROM m GROUP BY 1),
n AS (SELECT l_orderkey AS a, arg_min(l_suppkey * 10 + 1, (l_linenumber, l_suppkey)) AS m FROM lineitem WHERE l_returnflag <> 'R' AND l_suppkey * 10 + 1 IN (SELECT m FROM m) GROUP BY 1)
SELECT o_orderkey AS assessment_id, coalesce(o.m, n.m) AS manifest_id FROM orders LEFT JOIN o ON o.a = o_orderkey LEFT JOIN n ON n.a = o_orderkey""",
    "contributor_overview": """WITH f AS (SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1), c AS (SELECT concat_ws('/', source, lang) AS c, count(f.doc_id) AS n FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY 1),
o AS (SELECT (SELECT count(*) FROM c) AS contributors, (SELECT count(DISTINCT doc_id) FROM documents) AS samples, (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id IN (SELECT doc_id FROM f)) AS flagged WHERE (SELECT max(n) FROM c) >= 2) SELECT *, round(flagged / samples, 6) AS rate FROM o""",
    "audit_export": f"""WITH RECURSIVE {ledgers.CHAIN}, e AS (SELECT chain_id AS assessment_id, seq + 1 AS sequence, event_id, hash_bad, seq, current_hash, previous_hash, '{{"actor":"' || CASE WHEN hash_bad THEN 'intruder' ELSE 'service' END || '","current_hash":"' || current_hash || '","event_id":"' || event_id || '","event_type":"' || event_type || '","payload":'
 || replace(props, ' ', '') || ',"payload_digest":"' || payload_digest || '","previous_hash":"' || previous_hash || '","sequence":' || (seq + 1) || ',"timestamp_utc":"' || timestamp_utc || '"}}' AS document FROM broken)
SELECT assessment_id, sequence, 'event' AS part, document FROM e UNION ALL
SELECT assessment_id, 0, 'summary', '{{"failure_count":' || count_if(hash_bad) || ',"first_event_hash":"' || arg_min(current_hash, seq) || '","first_event_id":"' || arg_min(event_id, seq) || '","first_event_genesis_linked":true,"last_event_hash":"' || arg_max(current_hash, seq) || '","last_event_id":"' || arg_max(event_id, seq) || '","total_events":' || count(*) || '}}' FROM e GROUP BY 1""",
    "assessment_export": """SELECT o_orderkey AS assessment_id, 0 AS position, 'assessment' AS part, 0::BIGINT AS seq, '{"owner":' || o_custkey || ',"title":"' || o_orderpriority || '"}' AS document FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT l_orderkey, 1, 'finding', l_linenumber, '{"severity":"' || l_linestatus || '","title":"' || l_partkey || '.png"}' FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT l_orderkey, 2, 'evidence', l_linenumber, '{"data":[' || l_partkey || ',' || l_suppkey || '],"note":"[REDACTED_SECRET]"}' FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1""",
    "findings_by_run": "SELECT l_orderkey AS assessment_id, 'di-0' || l_linenumber AS detector_id FROM lineitem QUALIFY l_linenumber >= 4 OR max(l_tax) OVER (PARTITION BY l_orderkey, l_linenumber) > 0.04",
    "keyed_events": "SELECT event_id, user_id, value FROM events WHERE user_id = 7 AND event_type = 'click'",
    "recent_uploads": "SELECT 'upload' AS category, o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 50",
    "evidence_in_order": "SELECT l_orderkey AS finding_id, l_linenumber AS seq, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'",
    "severities": "SELECT ['NONE', 'low', 'MEDIUM', 'HIGH', 'CRITICAL', 'odd'][1 + l_partkey % 6] AS risk, count(*) AS n, ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL', 'MEDIUM'][1 + l_partkey % 6] AS severity FROM lineitem GROUP BY ALL",
    "tensors_shown": f"WITH {TENSORS_SQL} SELECT model_id, tensor_name, count(*) AS numel FROM tensors GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY tensor_name) <= 2",
    "sidecar_records": """WITH i AS (SELECT *, l_orderkey % 5 AS n, 'f' || l_partkey AS f, 'c' || l_suppkey AS w, l_orderkey * 10 + l_linenumber AS p FROM lineitem WHERE l_linenumber < 3)
SELECT f AS file_name, p AS precedence, w AS contributor, CASE WHEN n = 2 THEN l_returnflag ELSE '' END AS labels FROM i WHERE n IN (0, 2, 3) UNION ALL SELECT f, p, NULL, CASE WHEN n = 0 THEN l_returnflag || ',' || l_returnflag ELSE l_returnflag END FROM i WHERE n IN (0, 1)""",
    "annotation_keys": """WITH o AS (SELECT o_orderkey AS n, unnest([3, 4, 5]) AS i, unnest(['images', 'annotations', 'categories']) AS key FROM orders WHERE o_orderkey % 11 <> 0),
x AS (SELECT n, CASE n % i WHEN 1 THEN 'missing_key' WHEN 2 THEN 'not_a_list' END AS code, key FROM o UNION ALL SELECT o_orderkey, 'not_json', NULL FROM orders WHERE o_orderkey % 11 = 0)
SELECT code, key, count(*) AS n, min(n) AS first FROM x WHERE code IS NOT NULL GROUP BY 1, 2""",
    "class_names": "SELECT l_orderkey AS stem, string_agg(DISTINCT coalesce(lower(r_name), 'class_' || (l_linenumber % 4)), ',' ORDER BY coalesce(lower(r_name), 'class_' || (l_linenumber % 4))) AS labels FROM lineitem LEFT JOIN region ON r_regionkey = l_linenumber % 4 AND r_regionkey < 3 GROUP BY 1",
}
