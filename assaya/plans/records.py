"""Names, paths, texts, annotations, contents and searches."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaya.functions import text as tx
from assaya.functions.canonical import sanitized
from assaya.operators import search
from assaya.sources import annotations as an
from assaya.shared import cut, table


def path_codes(spark, sf_dir) -> DataFrame:
    """Page urls, and variants of them, as declared file names."""
    url = F.col("url")
    variants = F.explode(F.array(
        url, F.regexp_replace(url, "^[a-z]+://", ""), F.concat(F.lit("../"), F.col("page_id")), F.concat(F.lit("C:\\"), F.col("page_id")),
        F.concat(F.lit("a\\..\\"), F.col("page_id")), F.concat(F.lit("con."), F.col("page_id")), F.concat(F.lit("dir/img_"), F.col("page_id"), F.lit(".png")),
    )).alias("name")
    return table(spark, sf_dir, "pages").select("page_id", variants).select("page_id", "name", tx.path_code(F.col("name")).alias("code"))


def upload_names(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.upload_name(F.col("url")).alias("name"))


def _with_paths(spark, sf_dir) -> DataFrame:
    """Turns of conversations with paths put in: of both kinds, long and short, some with a separator at their end."""
    n = F.col("conv_id")
    paths = F.array(
        F.concat(F.lit("/home/u"), n, F.lit("/x.csv C:\\d\\f"), "turn", F.lit(".bin")), F.concat(F.lit("/tmp/s"), n, F.lit(".txt")), F.concat(F.lit("/var/a/b"), n, F.lit("/")),
        F.concat(F.lit("D:\\n"), n), F.concat(F.lit("/root/x"), n, F.lit(" /usr//y")),
    )
    which = F.get(paths, ((n + F.col("turn")) % 5).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("\n", "text", which).alias("t"))


def censored_texts(spark, sf_dir) -> DataFrame:
    return _with_paths(spark, sf_dir).select("conv_id", "turn", F.md5(tx.censor_paths(F.col("t"))).alias("censored"))


def redacted_paths(spark, sf_dir) -> DataFrame:
    return _with_paths(spark, sf_dir).select("conv_id", "turn", F.md5(tx.redact(F.col("t"))).alias("redacted"))


def redacted_texts(spark, sf_dir) -> DataFrame:
    """Digests of whole documents with secrets masked, and how many were."""
    out = tx.redact(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", out.alias("r"))
    return rows.select("doc_id", F.md5("r").alias("redacted"), ((F.length("r") - F.length(F.replace("r", F.lit("[REDACTED_SECRET]"), F.lit("")))) / 17).cast("long").alias("n_masked"))


def sanitized_exports(spark, sf_dir) -> DataFrame:
    """Events as JSON trees with secrets, digests and paths in them, sanitized."""
    i = F.col("event_id").cast("string")
    tree = F.struct(
        F.concat(F.lit("/home/u/"), i, F.lit(".csv")).alias("path"), F.lit("x").alias("api_key"), F.lit("y").alias("Authorization"), F.sha2("props", 256).alias("sha256"),
        F.array(F.concat(F.lit("use Bearer t."), i, F.lit(" now")), F.concat(F.lit("sk-"), F.lpad(i, 20, "0"))).alias("notes"), F.struct(F.lit(1).alias("secret_n"), F.col("event_type").alias("kind")).alias("inner"),
    )
    return table(spark, sf_dir, "events").select("event_id", sanitized(F.to_json(tree)).alias("clean"))


def coco_violations(spark, sf_dir) -> DataFrame:
    """Orders as images, parts as categories and lineitems as annotations; a tenth of the orders and parts are missing."""
    orders = table(spark, sf_dir, "orders").filter("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("id"))
    images = orders.union(orders.filter("id % 100 = 1"))
    parts = table(spark, sf_dir, "part").filter("p_partkey % 10 <> 7").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 50 == 0, " ").otherwise(F.col("p_name")).alias("name"))
    items = table(spark, sf_dir, "lineitem")
    box = F.array(F.col("l_tax"), F.col("l_discount"), F.col("l_quantity") - 2, F.col("l_extendedprice"))
    notes = items.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("category_id"), box.alias("bbox"))
    return an.coco_violations(images, parts, notes).groupBy("code").agg(F.count("*").alias("n"), F.min("ref").alias("first"), F.sum("ref").alias("total"))


def yolo_codes(spark, sf_dir) -> DataFrame:
    """Lineitems written as label lines."""
    items = table(spark, sf_dir, "lineitem")
    line = F.concat_ws(
        " ", F.when(F.col("l_linenumber") == 7, "x").otherwise((F.col("l_linenumber") - 2).cast("string")), F.round(F.col("l_discount") * 12, 2).cast("string"), F.round(F.col("l_tax") * 10, 2).cast("string"),
        F.round(F.col("l_quantity") / 45, 2).cast("string"), F.when(F.col("l_suppkey") % 20 == 0, "nan").when(F.col("l_suppkey") % 20 != 1, "0.5"),
    )
    return items.select(an.yolo_code(line, F.lit(4)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def content_store(spark, sf_dir) -> DataFrame:
    """Texts of odd documents that no even one has, per prefix of their digest."""
    docs = cut(table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256")))
    fresh = an.new_contents(docs.filter("doc_id % 2 = 1").select("sha256"), docs.filter("doc_id % 2 = 0").select("sha256"))
    return fresh.groupBy("prefix").agg(F.count("*").alias("n"), F.min("sha256").alias("first"))


def sidecar_merge(spark, sf_dir) -> DataFrame:
    """Lineitems as sidecar records of parts, in order of line number."""
    items = table(spark, sf_dir, "lineitem")
    rows = items.select(
        F.col("l_partkey").alias("file_name"), (F.col("l_linenumber") * 100000000 + F.col("l_orderkey")).alias("precedence"),
        F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey").cast("string")).otherwise(" ").alias("contributor"),
        F.when(F.col("l_returnflag") != "N", F.array("l_returnflag")).otherwise(F.array().cast("array<string>")).alias("labels"),
    )
    # one record for each precedence
    rows = rows.groupBy("file_name", "precedence").agg(F.max("contributor").alias("contributor"), F.max("labels").alias("labels"))
    return an.merge_sidecars(rows).select("file_name", "contributor", F.array_join("labels", ",").alias("labels"))


def ingestion_summary(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    code = F.when(F.col("n_chars") > 8000, "too_large").when(F.col("n_chars") < 200, "too_small")
    found = an.ingestion_summary(docs.select("source", code.alias("code")), "source", "code")
    return found.select("source", "ingested", "skipped", F.array_join("codes", ",").alias("codes"))


def search_everything(spark, sf_dir) -> DataFrame:
    """The newest of customers, orders and parts that have a term, 10 of each."""
    customers = table(spark, sf_dir, "customer").filter(search.contains_any([F.col("c_name"), F.col("c_mktsegment")], " aUtO "))
    orders = table(spark, sf_dir, "orders").filter(search.contains_any([F.col("o_orderpriority"), F.col("o_orderstatus")], "URGENT"))
    parts = table(spark, sf_dir, "part").filter(search.contains_any([F.col("p_type"), F.col("p_brand")], "b%"))
    pick = lambda df, cat, key, order: search.newest(df.select(F.col(key).alias("id"), F.col(order).cast("string").alias("at"), F.col(order).alias("_o")), cat, "_o", 10, ["id", "at"])
    return pick(customers, "customer", "c_custkey", "c_custkey").union(pick(orders, "order", "o_orderkey", "o_orderkey")).union(pick(parts, "part", "p_partkey", "p_partkey"))


def search_counts(spark, sf_dir) -> DataFrame:
    return search_everything(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


def battery(spark, sf_dir) -> DataFrame:
    """Line numbers as checks of an order's battery, counted by status."""
    codes = F.array(*map(F.lit, search.BATTERY))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("assessment_id"), F.get(codes, F.col("l_linenumber") - 1).alias("code"), F.when(F.col("l_linestatus") == "F", "FAILED").otherwise("SUCCESS").alias("status"))
    results = items.groupBy("assessment_id", "code").agg(F.min("status").alias("status"))
    return search.battery_status(results).groupBy("position", "code", "status").agg(F.count("*").alias("n"))


def _findings(spark, sf_dir) -> DataFrame:
    """Lines as findings: (finding_id, category, detector_id, severity)."""
    items = table(spark, sf_dir, "lineitem")
    severity = F.when(F.col("l_discount") > 0.08, "HIGH").when(F.col("l_discount") > 0.05, "MEDIUM").otherwise("LOW")
    categories = F.array(*map(F.lit, ("audit ledger", "Model data", "inference", "drift", "other", None)))
    detectors = F.array(*map(F.lit, ("data.integrity.di1", "mi-01", "PI-07", "at-01", "x", "inference.ai012", "")))
    return items.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("finding_id"), F.get(categories, (F.col("l_partkey") % 6).cast("int")).alias("category"),
        F.get(detectors, (F.col("l_suppkey") % 7).cast("int")).alias("detector_id"), severity.alias("severity"),
    )


def finding_groups(spark, sf_dir) -> DataFrame:
    rows = _findings(spark, sf_dir).withColumn("layer", search.layer(F.col("category"), F.col("detector_id")))
    return search.grouped(rows, "layer", search.layer_order(F.col("layer")))


def detector_codes(spark, sf_dir) -> DataFrame:
    """Findings by the code that their detector shows."""
    return _findings(spark, sf_dir).groupBy(search.detector_code(F.col("detector_id")).alias("code")).agg(F.count("*").alias("n"), F.min("finding_id").alias("first"))


def finding_search(spark, sf_dir) -> DataFrame:
    """Findings that a typed code means or that have it as a text."""
    ids = {"inference.ai012": "AI-12", "data.integrity.di1": "DI-01"}
    wanted = search.finding_matches([F.col("category")], F.col("detector_id"), " Ai 12 ", ids)
    return _findings(spark, sf_dir).filter(wanted | search.finding_matches([F.col("category")], F.col("detector_id"), "LEDGER", ids)).select("finding_id", "category", "detector_id")


QUERIES = {f.__name__: f for f in (path_codes, upload_names, censored_texts, redacted_paths, redacted_texts, sanitized_exports, coco_violations, yolo_codes, content_store, sidecar_merge, ingestion_summary, search_everything, search_counts, battery, finding_groups, detector_codes, finding_search)}

_SEARCH = """s AS ((SELECT 'customer' AS category, c_custkey AS id, c_custkey::VARCHAR AS at FROM customer WHERE lower(c_name) LIKE '%auto%' OR lower(c_mktsegment) LIKE '%auto%' ORDER BY c_custkey DESC LIMIT 10)
UNION ALL (SELECT 'order', o_orderkey, o_orderkey::VARCHAR FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%' OR lower(o_orderstatus) LIKE '%urgent%' ORDER BY o_orderkey DESC LIMIT 10)
UNION ALL (SELECT 'part', p_partkey, p_partkey::VARCHAR FROM part WHERE contains(lower(p_type), 'b%') OR contains(lower(p_brand), 'b%') ORDER BY p_partkey DESC LIMIT 10))"""
_FINDINGS = "f AS (SELECT l_orderkey * 10 + l_linenumber AS finding_id, l_partkey, l_suppkey % 7 AS s, CASE WHEN l_discount > 0.08 THEN 3 WHEN l_discount > 0.05 THEN 2 ELSE 1 END AS w FROM lineitem)"
ORACLES = {
    "path_codes": r"""WITH v AS (SELECT page_id, unnest([url, regexp_replace(url, '^[a-z]+://', ''), '../' || page_id, 'C:\' || page_id, 'a\..\' || page_id, 'con.' || page_id, 'dir/img_' || page_id || '.png']) AS name FROM pages),
s AS (SELECT *, replace(name, '\', '/') AS sl, regexp_extract(rtrim(name, '/'), '([^/]*)$', 1) AS bare FROM v)
SELECT page_id, name, CASE WHEN starts_with(trim(name), '/') OR substr(trim(name), 2, 1) = ':' OR starts_with(trim(name), '\\') THEN 'ABSOLUTE_PATH' WHEN list_contains(string_split(sl, '/'), '..') OR contains(sl, '../') OR starts_with(sl, '..') THEN 'PATH_TRAVERSAL'
WHEN trim(bare) = '' OR regexp_matches(bare, '[/\\<>:"|?*]') OR upper(regexp_replace(bare, '\.[^.]*$', '')) IN ('CON', 'PRN', 'AUX', 'NUL') THEN 'UNSAFE_FILENAME' ELSE 'OK' END AS code FROM s""",
    "upload_names": r"""WITH n AS (SELECT page_id, regexp_extract(rtrim(url, '/'), '([^/]*)$', 1) AS b FROM pages), s AS (SELECT *, regexp_extract(b, '[^.](\.[^.]+)$', 1) AS suffix FROM n)
SELECT page_id, CASE WHEN b = '' THEN 'upload.bin' WHEN regexp_matches(b, '^[a-zA-Z0-9_.-]+$') THEN b ELSE substr(regexp_replace(substr(b, 1, length(b) - length(suffix)), '[^a-zA-Z0-9_-]', '_', 'g'), 1, 64) || substr(regexp_replace(lower(suffix), '[^a-zA-Z0-9_.]', '', 'g'), 1, 10) END AS name FROM s""",
    "censored_texts": r"SELECT conv_id, turn, md5(concat_ws(chr(10), text, CASE (conv_id + turn) % 5 WHEN 0 THEN 'x.csv f' || turn || '.bin' WHEN 1 THEN 's' || conv_id || '.txt' WHEN 2 THEN 'local_file' WHEN 3 THEN 'n' || conv_id ELSE '/root/x' || conv_id || ' y' END)) AS censored FROM conversations",
    "redacted_paths": r"""SELECT conv_id, turn, md5(concat_ws(chr(10), text, CASE (conv_id + turn) % 5 WHEN 0 THEN '[artifact: u' || conv_id || '/x.csv] [artifact: d/f' || turn || '.bin]' WHEN 1 THEN '[artifact: tmp/s' || conv_id || '.txt]' WHEN 2 THEN '[artifact: a/b' || conv_id || ']'
 WHEN 3 THEN '[artifact: D:/n' || conv_id || ']' ELSE '[artifact: root/x' || conv_id || '] /usr//y' END)) AS redacted FROM conversations""",
    "sanitized_exports": """SELECT event_id, '{"inner":{"kind":"' || event_type || '"},"notes":["use [REDACTED_SECRET] now","[REDACTED_SECRET]"],"path":"' || event_id || '.csv","sha256":"' || sha256(props) || '"}' AS clean FROM events""",
    "redacted_texts": r"""WITH r AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '(?i)(?:api[_-]?key|secret|token|password)["'']?\s*[:=]\s*["'']?[a-z0-9_\-.]{16,}["'']?', 'secret=[REDACTED_SECRET]', 'g') AS r FROM documents)
SELECT doc_id, md5(r) AS redacted, ((length(r) - length(replace(r, '[REDACTED_SECRET]', ''))) // 17)::BIGINT AS n_masked FROM r""",
    "coco_violations": """WITH i AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 <> 3), c AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 10 <> 7),
v AS (SELECT 'duplicate_image' AS code, id AS ref FROM i WHERE id % 100 = 1 UNION ALL SELECT 'blank_name', id FROM c WHERE id % 50 = 0
UNION ALL SELECT 'unknown_image', l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM i) UNION ALL SELECT 'unknown_category', l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT id FROM c)
UNION ALL SELECT 'bad_box', l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_tax < 0 OR l_discount < 0 OR l_quantity - 2 <= 0 OR l_extendedprice <= 0)
SELECT code, count(*) AS n, min(ref) AS first, sum(ref)::BIGINT AS total FROM v GROUP BY 1""",
    "yolo_codes": """WITH x AS (SELECT l_linenumber - 2 AS c, l_linenumber = 7 AS badc, round(l_discount * 12, 2) AS xc, round(l_tax * 10, 2) AS yc, round(l_quantity / 45, 2) AS w, l_suppkey % 20 AS k FROM lineitem)
SELECT CASE WHEN k = 1 THEN 'too_few_tokens' WHEN badc THEN 'bad_class' WHEN c < 0 THEN 'negative_class' WHEN c >= 4 THEN 'unknown_class' WHEN k = 0 THEN 'not_finite' WHEN xc > 1 OR yc > 1 OR xc < 0 OR yc < 0 THEN 'centre_out_of_bounds' WHEN w <= 0 OR w > 1 THEN 'size_out_of_bounds' END AS code, count(*) AS n FROM x GROUP BY 1""",
    "content_store": "SELECT substr(h, 1, 2) AS prefix, count(*) AS n, min(h) AS first FROM (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 2 = 1 AND text IS NOT NULL) WHERE h NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL) GROUP BY 1",
    "sidecar_merge": """WITH r AS (SELECT l_partkey AS file_name, l_linenumber::BIGINT * 100000000 + l_orderkey AS precedence, max(CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey::VARCHAR END) AS contributor, max(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END) AS label FROM lineitem GROUP BY 1, 2)
SELECT file_name, arg_max(contributor, precedence) FILTER (contributor IS NOT NULL) AS contributor, arg_max(label, precedence) FILTER (label IS NOT NULL) AS labels FROM r GROUP BY 1""",
    "ingestion_summary": """WITH c AS (SELECT source, CASE WHEN n_chars > 8000 THEN 'too_large' WHEN n_chars < 200 THEN 'too_small' END AS code FROM documents)
SELECT source, count_if(code IS NULL) AS ingested, count_if(code IS NOT NULL) AS skipped, coalesce(array_to_string(list_sort(list(DISTINCT code) FILTER (code IS NOT NULL)), ','), '') AS codes FROM c GROUP BY 1""",
    "search_everything": f"WITH {_SEARCH} SELECT * FROM s",
    "search_counts": f"WITH {_SEARCH} SELECT category, count(*) AS n FROM s GROUP BY 1",
    "battery": """WITH b AS (SELECT unnest(['DI-01', 'DI-02', 'DI-03', 'DI-04', 'DI-05', 'MI-01', 'MI-02', 'MI-03', 'MI-04', 'MI-05', 'PI-01']) AS code, unnest(range(11)) AS position),
r AS (SELECT l_orderkey, l_linenumber - 1 AS position, min(CASE WHEN l_linestatus = 'F' THEN 'FAILED' ELSE 'SUCCESS' END) AS status FROM lineitem GROUP BY 1, 2)
SELECT b.position::INT AS position, b.code, coalesce(r.status, 'NOT_RUN') AS status, count(*) AS n FROM (SELECT DISTINCT l_orderkey FROM lineitem) a CROSS JOIN b LEFT JOIN r ON r.l_orderkey = a.l_orderkey AND r.position = b.position GROUP BY ALL""",
    "finding_groups": f"""WITH {_FINDINGS}, l AS (SELECT CASE l_partkey % 6 WHEN 1 THEN 'model_integrity' WHEN 2 THEN CASE WHEN s = 1 THEN 'model_integrity' ELSE 'inference_provenance' END ELSE
 CASE WHEN s = 1 THEN 'model_integrity' WHEN s IN (2, 5) THEN 'inference_provenance' WHEN l_partkey % 6 = 0 OR s = 3 THEN 'audit_integrity' ELSE 'data_integrity' END END AS layer, w FROM f)
SELECT layer, count(*) AS n, max(w)::INT AS worst FROM l GROUP BY 1""",
    "detector_codes": f"WITH {_FINDINGS} SELECT CASE s WHEN 0 THEN 'DI-01' WHEN 1 THEN 'MI-01' WHEN 2 THEN 'PI-07' WHEN 3 THEN 'AT-01' WHEN 4 THEN 'X' WHEN 5 THEN 'AI-12' ELSE 'UNKNOWN' END AS code, count(*) AS n, min(finding_id) AS first FROM f GROUP BY 1",
    "finding_search": f"""WITH {_FINDINGS} SELECT finding_id, CASE l_partkey % 6 WHEN 0 THEN 'audit ledger' WHEN 1 THEN 'Model data' WHEN 2 THEN 'inference' WHEN 3 THEN 'drift' WHEN 4 THEN 'other' END AS category,
 ['data.integrity.di1', 'mi-01', 'PI-07', 'at-01', 'x', 'inference.ai012', ''][s + 1] AS detector_id FROM f WHERE s = 5 OR l_partkey % 6 = 0""",
}
