"""Evidence, applicability, listings, scores and facets, over orders and their lines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaya.functions import text as tx
from assaya.functions.hashes import hamming
from assaya.operators import evidence as ev
from assaya.operators import search, similarity, verdicts
from assaya.operators.ranges import running
from assaya.plans.bindings import HASHES_SQL, samples
from assaya.shared import cut, table


#: What each line's payload is, by its number: strings, numbers and objects under the same keys.
_PAYLOAD_SQL = """CASE l_linenumber % 7
 WHEN 0 THEN '{"sample_ids":["' || l_partkey || '",' || l_suppkey || ',{"sample_id":"' || l_partkey || '"}]}'
 WHEN 1 THEN '{"sample_id":"' || l_partkey || '"}'
 WHEN 2 THEN '{"sample_1":{"sample_id":"' || l_partkey || '","label":"x"},"sample_2":{"sample_id":' || l_suppkey || '},"file_names":["f' || l_suppkey || '"]}'
 WHEN 3 THEN '{"affected_samples":[{"sample_id":"s' || l_suppkey || '","file_name":"f' || l_suppkey || '"},{"file_name":"f' || l_partkey || '"},"' || l_partkey || '"],"sample_id":"' || l_suppkey || '"}'
 WHEN 4 THEN '{"file_names":["f' || l_partkey || '","none","f' || l_suppkey || '"],"affected_samples":[{"sample_id":' || l_suppkey || '}]}'
 WHEN 5 THEN '{"sample_ids":["none"],"file_names":["none"],"affected_samples":{"sample_id":"1"},"sample_id":' || l_partkey || '}'
 ELSE '{"sample_1":"' || l_partkey || '","affected_samples":["' || l_suppkey || '"],"sample_ids":["none"],"sample_id":"' || l_suppkey || '"}' END"""


def payloads(spark, sf_dir) -> DataFrame:
    """Lines as evidence, in a set of parts."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.expr(_PAYLOAD_SQL).alias("data_json"))
    code = F.concat(F.lit("DI-0"), F.col("l_linenumber") % 5 + 1)
    return rows.select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"), (F.col("l_suppkey") % 3).alias("dataset_id"), code.alias("detector_id"), "data_json")


def flagged_samples(spark, sf_dir) -> DataFrame:
    """Parts that evidence refers to, by check."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("sample_id"))
    return ev.flagged_samples(payloads(spark, sf_dir), parts)


def evidence_shown(spark, sf_dir) -> DataFrame:
    """All that payloads offer to show."""
    return payloads(spark, sf_dir).select("evidence_id", F.inline(ev.shown(F.col("data_json"))))


def evidence_samples(spark, sf_dir) -> DataFrame:
    """What payloads show, as parts: by key, or by file name in the supplier's set."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("sample_id"), (F.col("p_partkey") % 3).alias("dataset_id"), F.concat(F.lit("f"), "p_partkey").alias("file_name"))
    return ev.shown_samples(payloads(spark, sf_dir), parts)


def detector_applicability(spark, sf_dir) -> DataFrame:
    """Sources of documents as datasets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    counts = docs.groupBy(F.concat_ws("/", "source", "lang").alias("dataset")).agg(F.count("*").alias("n_samples"), F.count("quality").alias("n_labelled"), F.count(F.nullif(F.trim("source"), F.lit(""))).alias("n_contributors"))
    return ev.applicability(counts, "dataset")


def scenario_scores(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    expected = items.select(F.col("l_orderkey").alias("scenario"), F.col("l_linenumber").alias("detector"), (F.col("l_returnflag") == "R").alias("expected"), (F.col("l_tax") > 0.06).alias("allowed"))
    expected = expected.groupBy("scenario", "detector").agg(F.max("expected").alias("expected"), F.max("allowed").alias("allowed"))
    actual = items.filter("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("scenario"), F.col("l_linenumber").alias("detector")).agg(F.max(F.col("l_discount") > 0.01).alias("found"))
    return ev.scenario_scores(expected, actual)


def assessment_list(spark, sf_dir) -> DataFrame:
    """Orders, newest first: lines are findings and evidence, the status an event."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    findings = items.filter("l_discount > 0.05").select(F.col("l_orderkey").alias("assessment_id"), F.when(F.col("l_tax") > 0.06, "HIGH").when(F.col("l_tax") > 0.03, "MEDIUM").otherwise("LOW").alias("severity"))
    events = orders.filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("assessment_id"), F.lit("completed").alias("event_type"), F.lit("LOW").alias("risk"), F.lit(0).alias("seq"))
    rows = orders.select(F.col("o_orderkey").alias("assessment_id"), F.col("o_orderdate").alias("created_at"))
    return ev.listing(rows, findings, items.select(F.col("l_orderkey").alias("assessment_id")), events).drop("created_at")


def limitation_lists(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    rows = items.select(F.col("l_suppkey").alias("assessment_id"), F.col("l_linenumber").alias("source"), F.col("l_orderkey").alias("seq"), F.concat(F.lit("limit "), F.col("l_partkey") % 7).alias("text"))
    return verdicts.limitations(rows).select("assessment_id", F.array_join("limitations", ";").alias("limitations"))


def finding_facets(spark, sf_dir) -> DataFrame:
    """Returned lines of open orders that have a term in their parts' names."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = search.facet(rows, {"l_returnflag": "R", "l_linestatus": "all", "p_brand": None})
    return rows.filter(search.contains_any([F.col("p_name"), F.col("p_type")], "RE")).select("l_orderkey", "l_linenumber", "p_name")


def first_rows_per_key(spark, sf_dir) -> DataFrame:
    """The 3 dearest lines of each supplier."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return similarity.first_per_key(items, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3)


def hash_distances(spark, sf_dir) -> DataFrame:
    """Bits between each document and the one before it of its source."""
    rows = samples(spark, sf_dir)
    before = F.lag("h").over(Window.partitionBy("contributor").orderBy("seq"))
    return rows.select("seq", hamming(F.col("h"), before, 999).cast("long").alias("distance"))


def event_positions(spark, sf_dir) -> DataFrame:
    """Position from 0, sequence from 1 and whether it is the first, of each user's events."""
    rows = running(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], sums={"position": F.lit(1).cast("long")})
    return rows.select("event_id", "position", (F.col("position") + 1).alias("sequence"), (F.col("position") == 0).alias("genesis"))


def contributor_overlap(spark, sf_dir) -> DataFrame:
    """Documents of each source that are labelled toxic: the intersection of two sets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return docs.join(toxic, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def model_files(spark, sf_dir) -> DataFrame:
    """Parts as model files: framework and access level by suffix."""
    suffixes = F.array(*map(F.lit, (".onnx", ".pt", ".PTH", ".ts", ".torchscript", ".bin", "")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("m"), "p_partkey", F.get(suffixes, (F.col("p_partkey") % 7).cast("int"))).alias("path"))
    return rows.select("p_partkey", tx.framework(F.col("path")).alias("framework"), tx.access_level(F.col("path")).alias("access_level"))


def geometry_features(spark, sf_dir) -> DataFrame:
    """Lines as images: width from quantity, height from line number, some missing."""
    width = F.when(F.col("l_suppkey") % 5 != 0, F.col("l_quantity").cast("long"))
    aspect, density = tx.geometry(width, (F.col("l_linenumber") - 1).cast("long"), F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", aspect.alias("aspect"), density.alias("density"))


QUERIES = {f.__name__: f for f in (flagged_samples, evidence_shown, evidence_samples, detector_applicability, scenario_scores, assessment_list, limitation_lists, finding_facets, first_rows_per_key, hash_distances, event_positions, contributor_overlap, model_files, geometry_features)}
_EVIDENCE = f"e AS (SELECT l_orderkey * 10 + l_linenumber AS evidence_id, l_suppkey % 3 AS dataset_id, 'DI-0' || (l_linenumber % 5 + 1) AS issue, ({_PAYLOAD_SQL})::JSON AS d FROM lineitem)"
_OFFERS = f"""{_EVIDENCE}, o AS (SELECT *, CASE WHEN json_type(d, '$.sample_ids') = 'ARRAY' THEN (d -> '$.sample_ids[*]')[:8] END AS a0, CASE WHEN json_type(d, '$.file_names') = 'ARRAY' THEN (d -> '$.file_names[*]')[:8] END AS a1, CASE WHEN json_type(d, '$.affected_samples') = 'ARRAY' THEN (d -> '$.affected_samples[*]')[:8] END AS a2 FROM e),
c AS (SELECT evidence_id, dataset_id, 0 AS shape, unnest(range(len(a0)))::INT AS position, unnest(a0) ->> '$' AS id, NULL AS file FROM o UNION ALL SELECT evidence_id, dataset_id, 1, unnest(range(len(a1)))::INT, NULL, unnest(a1) ->> '$' FROM o
 UNION ALL SELECT evidence_id, dataset_id, 2, position, x ->> '$.sample_id', x ->> '$.file_name' FROM (SELECT *, unnest(range(len(a2)))::INT AS position, unnest(a2) AS x FROM o) UNION ALL SELECT evidence_id, dataset_id, 3, 0, d ->> '$.sample_id', NULL FROM o WHERE json_type(d, '$.sample_id') = 'VARCHAR')"""
ORACLES = {
    "flagged_samples": f"""WITH {_EVIDENCE}, r AS (SELECT issue, CASE WHEN json_type(d, '$.sample_ids') = 'ARRAY' THEN unnest(d ->> '$.sample_ids[*]') END AS id FROM e UNION ALL SELECT issue, d ->> '$.sample_id' FROM e UNION ALL SELECT issue, d ->> '$.sample_1.sample_id' FROM e UNION ALL SELECT issue, d ->> '$.sample_2.sample_id' FROM e
 UNION ALL SELECT issue, unnest(d ->> '$.affected_samples[*].sample_id') FROM e)
SELECT DISTINCT id AS sample_id, issue FROM r WHERE issue <> 'DI-05' AND id IN (SELECT p_partkey::VARCHAR FROM part)""",
    "evidence_shown": f"WITH {_OFFERS} SELECT evidence_id, shape, position, id, file FROM c",
    "evidence_samples": f"""WITH {_OFFERS}, f AS (SELECT evidence_id, shape, position, coalesce(a.p_partkey, b.p_partkey)::VARCHAR AS sample_id FROM c LEFT JOIN part a ON a.p_partkey::VARCHAR = id LEFT JOIN part b ON 'f' || b.p_partkey = file AND b.p_partkey % 3 = dataset_id)
SELECT evidence_id, ['sample_ids', 'file_names', 'affected_samples', 'sample_id'][1 + shape] AS shape, position, sample_id FROM f WHERE sample_id IS NOT NULL QUALIFY shape = min(shape) OVER (PARTITION BY evidence_id)""",
    "detector_applicability": """WITH c AS (SELECT concat_ws('/', source, lang) AS dataset, count(*) AS s, count(quality) AS l, count(nullif(trim(source), '')) AS c FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT dataset, 'DI-01' AS code, s >= 1 AS applicable, CASE WHEN s < 1 THEN 'no samples' END AS reason FROM c UNION ALL SELECT dataset, 'DI-02', l >= 2, CASE WHEN l < 2 THEN 'fewer than 2 labelled samples' END FROM c
UNION ALL SELECT dataset, 'DI-03', s >= 3, CASE WHEN s < 3 THEN 'fewer than 3 samples' END FROM c UNION ALL SELECT dataset, 'DI-04', s >= 5, CASE WHEN s < 5 THEN 'fewer than 5 samples' END FROM c
UNION ALL SELECT dataset, 'DI-05', c >= 1, CASE WHEN c < 1 THEN 'no contributor' END FROM c""",
    "scenario_scores": """WITH e AS (SELECT l_orderkey AS scenario, l_linenumber AS d, bool_or(l_returnflag = 'R') AS expected, bool_or(l_tax > 0.06) AS allowed, coalesce(bool_or(l_discount > 0.01) FILTER (l_linestatus = 'F'), false) AS found FROM lineitem GROUP BY 1, 2),
r AS (SELECT scenario, CASE WHEN expected THEN found ELSE NOT found OR allowed END AS ok FROM e)
SELECT scenario, bool_and(ok) AS passed, count_if(NOT ok) AS wrong FROM r GROUP BY 1""",
    "assessment_list": """WITH f AS (SELECT l_orderkey, count(*) AS n, max(CASE WHEN l_tax > 0.06 THEN 2 WHEN l_tax > 0.03 THEN 1 ELSE 0 END) AS s FROM lineitem WHERE l_discount > 0.05 GROUP BY 1), e AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey AS assessment_id, coalesce(f.n, 0) AS n_findings, coalesce(e.n, 0) AS n_evidence, CASE WHEN o_orderstatus <> 'O' THEN 'LOW' WHEN s = 2 THEN 'HIGH' WHEN s = 1 THEN 'MEDIUM' ELSE 'NONE' END AS risk
FROM orders LEFT JOIN f ON f.l_orderkey = o_orderkey LEFT JOIN e ON e.l_orderkey = o_orderkey""",
    "limitation_lists": """WITH t AS (SELECT l_suppkey AS a, 'limit ' || (l_partkey % 7) AS t, min((l_linenumber, l_orderkey)) AS pos FROM lineitem GROUP BY 1, 2)
SELECT a AS assessment_id, string_agg(t, ';' ORDER BY pos, t) AS limitations FROM t GROUP BY 1""",
    "finding_facets": "SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND (contains(lower(p_name), 're') OR contains(lower(p_type), 're'))",
    "first_rows_per_key": "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3",
    "hash_distances": f"WITH {HASHES_SQL} SELECT seq, coalesce(bit_count(xor(bits::BIT, lag(bits) OVER (PARTITION BY contributor ORDER BY seq)::BIT)), 999)::BIGINT AS distance FROM samples",
    "event_positions": "SELECT event_id, row_number() OVER w - 1 AS position, row_number() OVER w AS sequence, row_number() OVER w = 1 AS genesis FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "contributor_overlap": "SELECT source, count(*) AS n, min(doc_id) AS first FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1",
    "model_files": "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'onnx' WHEN 1 THEN 'pytorch' WHEN 2 THEN 'pytorch' WHEN 3 THEN 'torchscript' ELSE 'unknown' END AS framework, CASE WHEN p_partkey % 7 IN (0, 3, 4) THEN 'white_box' ELSE 'metadata_only' END AS access_level FROM part",
    "geometry_features": """WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice, coalesce(nullif(CASE WHEN l_suppkey % 5 <> 0 THEN l_quantity::BIGINT END, 0), 256) AS w, coalesce(nullif(l_linenumber - 1, 0), 256) AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, w / greatest(1, h) AS aspect, l_extendedprice / greatest(1, w * h) AS density FROM x""",
}
