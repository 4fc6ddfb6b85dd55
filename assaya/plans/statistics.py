"""Tensor, activation and output statistics, drift, outliers and contributor rates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaya.operators import models
from assaya.operators import statistics as st
from assaya.operators import verdicts
from assaya.plans.bindings import FEATURES_SQL, OUTPUTS_SQL, TENSORS_SQL, features, outputs, tensors
from assaya.shared import cut, table

_R6 = lambda *names: [F.round(n, 6).alias(n) for n in names]


def tensor_statistics(spark, sf_dir) -> DataFrame:
    stats = st.value_statistics(tensors(spark, sf_dir), ["model_id", "tensor_name"])
    return stats.select("model_id", "tensor_name", "numel", "nan_count", "inf_count", *_R6("zero_fraction", "min_value", "max_value", "mean_value"), F.round("std_value", 4).alias("std_value"))


def parameter_verdicts(spark, sf_dir) -> DataFrame:
    return st.parameter_verdict(st.value_statistics(tensors(spark, sf_dir), ["model_id", "tensor_name"]))


def parameter_totals(spark, sf_dir) -> DataFrame:
    found = st.parameter_totals(st.value_statistics(tensors(spark, sf_dir), ["model_id", "tensor_name"]))
    return found.select("model_id", "parameters", "tensors", "non_finite", *_R6("sparsity", "min_value", "max_value"), F.round("mean_value", 4).alias("mean_value"), F.round("std_value", 3).alias("std_value"))


def tensor_types(spark, sf_dir) -> DataFrame:
    """Quantities stand for whole numbers."""
    dtype = F.when(F.col("tensor_name") == "l_quantity", "int8").when(F.col("tensor_name") == "l_extendedprice", "float64").otherwise("float32")
    return st.dtype_counts(tensors(spark, sf_dir).withColumn("dtype", dtype))


def activations(spark, sf_dir) -> DataFrame:
    """Event values: a type is a layer, a user's last digit a probe, values under 1 count as 0."""
    events = table(spark, sf_dir, "events")
    value = F.when(F.abs("value") < 1, 0.0).otherwise(F.col("value"))
    return events.select(F.lit("m").alias("model_id"), F.col("event_type").alias("layer_name"), (F.col("user_id") % 10).cast("string").alias("probe_name"), value.alias("value"))


def activation_verdicts(spark, sf_dir) -> DataFrame:
    return st.activation_verdict(st.value_statistics(activations(spark, sf_dir), ["model_id", "layer_name", "probe_name"]))


def _long(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws(":", "model", "probe").alias("probe"), F.posexplode("out").alias("idx", "value"))


def output_comparison(spark, sf_dir) -> DataFrame:
    rows = cut(outputs(spark, sf_dir))
    found = st.output_comparison(_long(rows.filter("perturbation = 1")), _long(rows.filter("perturbation = 0")))
    return found.select("probe", "same_shape", *_R6("mse", "max_diff", "cosine"))


def comparison_verdict(spark, sf_dir) -> DataFrame:
    rows = cut(outputs(spark, sf_dir))
    found = st.comparison_verdict(st.output_comparison(_long(rows.filter("perturbation = 1")), _long(rows.filter("perturbation = 0"))))
    return found.select(*_R6("mean_mse", "max_diff", "mean_cosine"), "outcome")


def output_diversity(spark, sf_dir) -> DataFrame:
    found = st.diversity(outputs(spark, sf_dir), ["model", "perturbation"])
    return found.select("model", "perturbation", *_R6("diversity"))


def _evaluations(spark, sf_dir) -> DataFrame:
    """Perturbation 0 of a model is clean, 1 the control."""
    rows = cut(outputs(spark, sf_dir))
    return models.trigger_evaluations(rows, cut(st.diversity(rows, ["model", "perturbation"])), st.convergence, F.lit(0), F.lit(1))


def trigger_evaluations(spark, sf_dir) -> DataFrame:
    return _evaluations(spark, sf_dir).select("model", "perturbation", *_R6("clean", "ratio", "shift"), "suspicious")


def trigger_verdicts(spark, sf_dir) -> DataFrame:
    return models.trigger_verdict(_evaluations(spark, sf_dir)).select("model", *_R6("min_ratio"), "n_suspicious", "status", "risk", "confidence")


def structural_fingerprint(spark, sf_dir) -> DataFrame:
    """Parameters, tensors, their types and the first 100 names of each model."""
    rows = tensors(spark, sf_dir).groupBy("model_id", "tensor_name").agg(F.count("*").alias("numel"))
    rows = rows.withColumn("dtype", F.when(F.col("tensor_name") == "l_tax", "float16").otherwise("float64"))
    found = models.structural_fingerprint(rows)
    kinds = F.array_join(F.transform("dtypes", lambda d: F.concat_ws(":", d["dtype"], d["n"])), ",")
    return found.select("model_id", "parameters", "tensors", kinds.alias("dtypes"), F.array_join("names", ",").alias("names"))


def behavioural_fingerprint(spark, sf_dir) -> DataFrame:
    found = models.behavioural_fingerprint(outputs(spark, sf_dir), ["model", "perturbation", "probe"])
    return found.select("model", "perturbation", "probe", "length", "digest", *_R6("mean", "std", "min", "max"))


def fingerprint_fields(spark, sf_dir, side: int) -> DataFrame:
    """Nations as models: fields of half of their customers, in sections; what some nations don't have is null."""
    rows = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 2 == side)
    sums = rows.groupBy(F.col("c_nationkey").alias("model_id")).agg(F.count("*").alias("artifact.rows"), F.countDistinct("c_mktsegment").alias("structural.segments"), F.max("c_mktsegment").alias("behavioral.last"))
    known = lambda c: F.when(F.col("model_id") % (4 if c.startswith("b") else 5) != 0, F.col(f"`{c}`").cast("string"))
    names = ["artifact.rows", "structural.segments", "behavioral.last"]
    long = sums.select("model_id", F.explode(F.array(*[F.struct(F.lit(c.split(".")[0]).alias("section"), F.lit(c.split(".")[1]).alias("field"), (F.col(f"`{c}`").cast("string") if c.startswith("a") else known(c)).alias("value")) for c in names])).alias("x"))
    return long.select("model_id", "x.*")


def fingerprint_diff(spark, sf_dir) -> DataFrame:
    """This half of the customers' accounts of a nation against the other; equal and missing fields are left out."""
    return models.fingerprint_diff(fingerprint_fields(spark, sf_dir, 1), fingerprint_fields(spark, sf_dir, 0))


def known_models(spark, sf_dir) -> DataFrame:
    """Nations as models: what is known of each."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.alias("model_id"), (n % 7 != 0).alias("has_reference"), (n % 5 != 0).alias("structural"), (n % 4 != 0).alias("behavioral"))


def fingerprint_verdicts(spark, sf_dir) -> DataFrame:
    return models.fingerprint_verdict(known_models(spark, sf_dir), fingerprint_diff(spark, sf_dir))


def model_files(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, references and errors: parts as model files, held against the part before; what they cost by suppliers stands for the error of outputs."""
    suffixes = F.array(*map(F.lit, (".onnx", ".ONNX", ".pt", None)))
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model_id"), F.md5("p_brand").alias("sha256"), F.get(suffixes, (F.col("p_size") % 3).cast("int")).alias("suffix"))
    before = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("model_id"), F.md5("p_brand").alias("sha256"), F.get(suffixes, (F.col("p_size") % 4).cast("int")).alias("suffix"))
    errors = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model_id"), F.when(F.col("p_partkey") % 3 == 0, 1e-7).when(F.col("p_partkey") % 3 == 1, F.col("p_size") / 10).alias("mse"))
    return files, before, errors


def file_comparisons(spark, sf_dir) -> DataFrame:
    return models.file_comparison(*model_files(spark, sf_dir))


def feature_profiles(spark, sf_dir) -> DataFrame:
    return st.feature_profile(features(spark, sf_dir)).select("feature", *_R6("median", "iqr"))


def language_drift(spark, sf_dir) -> DataFrame:
    """All other languages against English."""
    rows = cut(features(spark, sf_dir))
    found = st.drift(rows.filter("lang <> 'en'"), rows.filter("lang = 'en'"), ["digit_share", "upper_share", "space_share"])
    return found.select(*_R6("overall_shift", "outlier_share"), "n_outliers", F.array_join("affected", ",").alias("affected"), "classification", "severity", "risk", "confidence")


def outside_shares(spark, sf_dir) -> DataFrame:
    """Per feature, documents in other languages outside the envelope of English ones."""
    rows = cut(features(spark, sf_dir))
    found = st.outside_shares(rows.filter("lang <> 'en'"), st.feature_profile(rows.filter("lang = 'en'")))
    return found.select("feature", "n_outside", *_R6("share"))


def reference_outliers(spark, sf_dir) -> DataFrame:
    """The 10 documents in other languages furthest from English ones."""
    rows = cut(features(spark, sf_dir))
    found = st.reference_outliers(rows.filter("lang <> 'en'"), rows.filter("lang = 'en'"))
    return found.select("seq", *_R6("distance"), F.array_join("dims", ",").alias("dims"))


def distribution_outliers(spark, sf_dir) -> DataFrame:
    found = st.robust_outliers(cut(features(spark, sf_dir)), cap=15)
    return found.select("seq", *_R6("distance"), F.array_join("dims", ",").alias("dims"), "severity")


def flags(spark, sf_dir) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    low = labels.filter("quality = 0").select(F.col("doc_id").alias("sample_id"), F.lit("low_quality").alias("issue"))
    return low.union(labels.filter("toxic = 1").select("doc_id", F.lit("toxic")))


def contributor_rates(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("contributor"))
    found = st.contributor_rates(docs, flags(spark, sf_dir))
    return found.select("contributor", "total", "flagged", *_R6("rate"), F.array_join("issues", ",").alias("issues"), "anomalous", "severity")


def assessment_summaries(spark, sf_dir) -> DataFrame:
    """Orders as assessments and their lines as results of checks."""
    items = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", F.when(F.col("l_linenumber") % 2 == 0, "FAILED").otherwise("NOT_APPLICABLE")).when(F.col("l_linestatus") == "F", "PARTIAL").otherwise("SUCCESS")
    risk = F.when(F.col("l_discount") > 0.08, "HIGH").when(F.col("l_discount") > 0.05, "MEDIUM").when(F.col("l_discount") > 0.02, "LOW").otherwise("NONE")
    confidence = F.when(F.col("l_tax") > 0.07, "LOW").otherwise("HIGH")
    rows = items.select(F.col("l_orderkey").alias("assessment_id"), status.alias("status"), risk.alias("risk_level"), confidence.alias("confidence_level"), (status != "NOT_APPLICABLE").alias("applicable"))
    sums = verdicts.assessment_summary(rows)
    advice = verdicts.disposition(F.col("overall_risk"), F.col("overall_confidence"), F.col("coverage"), F.col("assessment_id") % 50 != 0)
    return sums.select("assessment_id", "overall_risk", "applicable", "executed", *_R6("coverage"), "overall_confidence", advice.alias("disposition"))


QUERIES = {f.__name__: f for f in (tensor_statistics, parameter_verdicts, parameter_totals, tensor_types, activation_verdicts, output_comparison, comparison_verdict, output_diversity, trigger_evaluations, trigger_verdicts, structural_fingerprint, behavioural_fingerprint, fingerprint_diff, fingerprint_verdicts, file_comparisons, feature_profiles, language_drift, outside_shares, reference_outliers, distribution_outliers, contributor_rates, assessment_summaries)}

_STATS = f"""{TENSORS_SQL},
stats AS (SELECT model_id, tensor_name, count(value) AS numel, count_if(isnan(value)) AS nan_count, count_if(isinf(value)) AS inf_count, count_if(value = 0) / count(value) AS zero_fraction,
 min(value) AS min_value, max(value) AS max_value, avg(value) AS mean_value, stddev_pop(value) AS std_value FROM tensors GROUP BY 1, 2)"""
_COMPARED = f"""{OUTPUTS_SQL},
long AS (SELECT model || ':' || probe AS probe, perturbation, unnest(out) AS value, unnest(range(len(out))) AS idx FROM outputs),
per AS (SELECT a.probe, avg((a.value - b.value) ** 2) AS mse, max(abs(a.value - b.value)) AS max_diff, sum(a.value * b.value) / (sqrt(sum(a.value * a.value)) * sqrt(sum(b.value * b.value))) AS cosine
 FROM long a JOIN long b ON a.probe = b.probe AND a.idx = b.idx AND a.perturbation = 1 AND b.perturbation = 0 GROUP BY 1)"""
_DIV = f"""{OUTPUTS_SQL},
spread AS (SELECT o.model, o.perturbation, coalesce(any_value(p.d), 0) AS diversity FROM outputs o LEFT JOIN
 (SELECT a.model, a.perturbation, avg(list_distance(a.out, b.out)) AS d FROM outputs a JOIN outputs b ON a.model = b.model AND a.perturbation = b.perturbation AND a.probe < b.probe GROUP BY 1, 2) p
 ON p.model = o.model AND p.perturbation = o.perturbation GROUP BY 1, 2)"""
_TRIED = f"""{_DIV}, shifts AS (SELECT o.model, o.perturbation, avg(list_distance(o.out, c.out)) AS shift FROM outputs o JOIN outputs c ON o.model = c.model AND o.probe = c.probe AND c.perturbation = 0 GROUP BY 1, 2),
e AS (SELECT s.model, s.perturbation, k.diversity AS clean, s.diversity / (k.diversity + 1e-7) AS ratio, h.shift, k.diversity >= 0.05 AND s.diversity / (k.diversity + 1e-7) < 0.15 AND h.shift > 2 * greatest(coalesce(c.shift, 0), 0.01) AS suspicious
 FROM spread s JOIN shifts h ON s.model = h.model AND s.perturbation = h.perturbation JOIN spread k ON k.model = s.model AND k.perturbation = 0 LEFT JOIN shifts c ON c.model = s.model AND c.perturbation = 1 WHERE s.perturbation > 1)"""
_DIFF = """s AS (SELECT c_custkey % 2 AS side, c_nationkey AS m, count(*)::VARCHAR AS rows, CASE WHEN c_nationkey % 5 <> 0 THEN count(DISTINCT c_mktsegment)::VARCHAR END AS segments, CASE WHEN c_nationkey % 4 <> 0 THEN max(c_mktsegment) END AS last FROM customer GROUP BY c_custkey % 2, c_nationkey),
l AS (SELECT side, m, 'artifact' AS section, 'rows' AS field, rows AS v FROM s UNION ALL SELECT side, m, 'structural', 'segments', segments FROM s UNION ALL SELECT side, m, 'behavioral', 'last', last FROM s),
d AS (SELECT a.m AS model_id, a.section, a.field, a.v AS reference, b.v AS observed FROM l a JOIN l b ON a.m = b.m AND a.field = b.field AND a.side = 0 AND b.side = 1 WHERE a.v <> b.v)"""
_PROFILE = "SELECT feature, quantile_cont(value, 0.5) AS median, CASE WHEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) <= 1e-4 THEN 1.0 ELSE quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END AS iqr FROM"
ORACLES = {
    "tensor_statistics": f"WITH {_STATS} SELECT model_id, tensor_name, numel, nan_count, inf_count, round(zero_fraction, 6) AS zero_fraction, round(min_value, 6) AS min_value, round(max_value, 6) AS max_value, round(mean_value, 6) AS mean_value, round(std_value, 4) AS std_value FROM stats",
    "tensor_types": f"""WITH {TENSORS_SQL} SELECT model_id, CASE tensor_name WHEN 'l_quantity' THEN 'int8' WHEN 'l_extendedprice' THEN 'float64' ELSE 'float32' END AS dtype, count(DISTINCT tensor_name) AS tensors, count(*) AS parameters FROM tensors GROUP BY 1, 2""",
    "parameter_totals": f"""WITH {TENSORS_SQL} SELECT model_id, count(value) AS parameters, count(DISTINCT tensor_name) AS tensors, count_if(isnan(value) OR isinf(value)) AS non_finite, round(count_if(value = 0) / count(value), 6) AS sparsity,
 round(min(value), 6) AS min_value, round(max(value), 6) AS max_value, round(avg(value), 4) AS mean_value, round(stddev_pop(value), 3) AS std_value FROM tensors GROUP BY 1""",
    "parameter_verdicts": f"""WITH {_STATS}, s AS (SELECT model_id, count_if(numel >= 1000 AND zero_fraction >= 0.999) AS sparse_tensors FROM stats GROUP BY 1),
m AS (SELECT model_id, count(value) AS parameters, count(DISTINCT tensor_name) AS tensors, count_if(isnan(value) OR isinf(value)) AS non_finite, abs(min(value)) > 1e4 OR abs(max(value)) > 1e4 OR stddev_pop(value) > 1e3 AS x FROM tensors GROUP BY 1),
r AS (SELECT *, CASE WHEN non_finite >= 100 THEN 'CRITICAL' WHEN non_finite > 0 THEN 'HIGH' WHEN x THEN 'MEDIUM' WHEN sparse_tensors > 0 THEN 'LOW' ELSE 'NONE' END AS risk FROM m JOIN s USING (model_id))
SELECT model_id, parameters, tensors, non_finite, sparse_tensors, risk, nullif(risk, 'NONE') AS severity, CASE WHEN risk IN ('MEDIUM', 'LOW') THEN 'MODERATE' ELSE 'HIGH' END AS confidence FROM r""",
    "activation_verdicts": """WITH v AS (SELECT event_type, user_id % 10 AS probe, count(value) AS n, count_if(abs(value) < 1) AS z FROM events GROUP BY 1, 2),
l AS (SELECT event_type, count_if(z / n >= 0.98) AS dead FROM v GROUP BY 1)
SELECT 'm' AS model_id, count(*) AS layers, 0::BIGINT AS non_finite, count_if(dead >= 3) AS dead_layers, CASE WHEN count_if(dead >= 3) > 0 THEN 'MEDIUM' ELSE 'NONE' END AS risk, CASE WHEN count_if(dead >= 3) > 0 THEN 'MODERATE' ELSE 'HIGH' END AS confidence FROM l""",
    "output_comparison": f"WITH {_COMPARED} SELECT probe, true AS same_shape, round(mse, 6) AS mse, round(max_diff, 6) AS max_diff, round(cosine, 6) AS cosine FROM per",
    "comparison_verdict": f"WITH {_COMPARED} SELECT round(avg(mse), 6) AS mean_mse, round(max(max_diff), 6) AS max_diff, round(avg(cosine), 6) AS mean_cosine, CASE WHEN avg(mse) <= 1e-6 THEN 'equivalent' ELSE 'divergent' END AS outcome FROM per",
    "output_diversity": f"WITH {_DIV} SELECT model, perturbation, round(diversity, 6) AS diversity FROM spread",
    "trigger_evaluations": f"WITH {_TRIED} SELECT model, perturbation, round(clean, 6) AS clean, round(ratio, 6) AS ratio, round(shift, 6) AS shift, suspicious FROM e",
    "trigger_verdicts": f"""WITH {_TRIED} SELECT model, round(min(ratio), 6) AS min_ratio, count_if(suspicious) AS n_suspicious, CASE WHEN min(clean) < 0.05 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status,
 CASE WHEN bool_or(suspicious) AND min(clean) >= 0.05 THEN 'HIGH' ELSE 'NONE' END AS risk, CASE WHEN min(clean) < 0.05 THEN 'LOW' ELSE 'HIGH' END AS confidence FROM e GROUP BY 1""",
    "structural_fingerprint": f"""WITH {TENSORS_SQL}, t AS (SELECT model_id, tensor_name, count(*) AS numel, CASE WHEN tensor_name = 'l_tax' THEN 'float16' ELSE 'float64' END AS dtype FROM tensors GROUP BY 1, 2),
k AS (SELECT model_id, dtype, count(*) AS n FROM t GROUP BY 1, 2)
SELECT model_id, sum(numel)::BIGINT AS parameters, count(*) AS tensors, (SELECT string_agg(dtype || ':' || n, ',' ORDER BY dtype) FROM k WHERE k.model_id = t.model_id) AS dtypes, array_to_string(list_sort(list(tensor_name))[1:100], ',') AS names FROM t GROUP BY 1""",
    "behavioural_fingerprint": f"""WITH {OUTPUTS_SQL} SELECT model, perturbation, probe, len(out) AS length, sha256(array_to_string(list_transform(out, lambda v: v::DECIMAL(38,9)::VARCHAR), ',')) AS digest,
 round(list_avg(out), 6) AS mean, round(list_stddev_pop(out), 6) AS std, round(list_min(out), 6) AS min, round(list_max(out), 6) AS max FROM outputs""",
    "fingerprint_diff": f"WITH {_DIFF} SELECT model_id, section, field, reference, observed FROM d",
    "fingerprint_verdicts": f"""WITH {_DIFF}, m AS (SELECT n_nationkey AS model_id, n_nationkey % 7 <> 0 AS r, n_nationkey % 5 <> 0 AS s, n_nationkey % 4 <> 0 AS b FROM nation),
c AS (SELECT m.*, CASE WHEN r THEN count(d.field) ELSE 0 END AS n_diffs, coalesce(bool_or(d.section <> 'artifact'), false) AS deep FROM m LEFT JOIN d ON d.model_id = m.model_id GROUP BY m.model_id, r, s, b)
SELECT model_id, n_diffs::BIGINT AS n_diffs, CASE WHEN n_diffs = 0 THEN 'NONE' WHEN deep THEN 'MEDIUM' ELSE 'LOW' END AS risk,
 CASE WHEN NOT r THEN CASE WHEN s OR b THEN 'HIGH' ELSE 'LOW' END WHEN n_diffs = 0 THEN CASE WHEN b THEN 'HIGH' ELSE 'MODERATE' END WHEN s THEN 'MODERATE' ELSE 'LOW' END AS confidence,
 CASE WHEN s AND b THEN 'SUCCESS' ELSE 'PARTIAL' END AS status FROM c""",
    "file_comparisons": """WITH x AS (SELECT a.p_partkey AS model_id, md5(a.p_brand) = md5(b.p_brand) AS same, CASE WHEN b.p_size % 4 = 3 THEN NULL WHEN b.p_size % 4 = 2 THEN '.pt' ELSE '.onnx' END AS ref, CASE WHEN a.p_size % 3 = 2 THEN '.pt' ELSE '.onnx' END AS own,
 CASE a.p_partkey % 3 WHEN 0 THEN 1e-7 WHEN 1 THEN a.p_size / 10 END::DOUBLE AS mse FROM part a JOIN part b ON a.p_partkey = b.p_partkey + 1),
o AS (SELECT *, CASE WHEN same THEN 'reference_exact_match' WHEN ref IS NULL THEN 'fingerprint_mismatch' WHEN own <> ref THEN 'model_format_substitution' WHEN mse <= 1e-6 THEN 'behavioral_equivalent' WHEN mse > 1e-6 THEN 'behavioral_divergence' ELSE 'artifact_mismatch' END AS outcome FROM x)
SELECT model_id, mse, outcome, CASE WHEN outcome IN ('reference_exact_match', 'behavioral_equivalent') THEN 'NONE' WHEN outcome = 'model_format_substitution' THEN 'HIGH' ELSE 'MEDIUM' END AS risk,
 CASE WHEN outcome IN ('fingerprint_mismatch', 'artifact_mismatch') THEN 'MODERATE' ELSE 'HIGH' END AS confidence FROM o""",
    "feature_profiles": f"WITH {FEATURES_SQL}, p AS ({_PROFILE} features GROUP BY 1) SELECT feature, round(median, 6) AS median, round(iqr, 6) AS iqr FROM p",
    "language_drift": f"""WITH {FEATURES_SQL}, r AS ({_PROFILE} features WHERE lang = 'en' GROUP BY 1), e AS ({_PROFILE} features WHERE lang <> 'en' GROUP BY 1),
s AS (SELECT feature, abs(e.median - r.median) / r.iqr AS shift FROM e JOIN r USING (feature)),
o AS (SELECT seq, bool_or(abs(value - r.median) > 3 * r.iqr) AS out FROM features f JOIN r USING (feature) WHERE lang <> 'en' GROUP BY 1),
x AS (SELECT sqrt((SELECT avg(shift * shift) FROM s)) AS sh, (SELECT avg(out::INT::DOUBLE) FROM o) AS p, (SELECT count_if(out) FROM o) AS n, coalesce((SELECT list_sort(list(feature)) FROM s WHERE shift > 1.5), []) AS a)
SELECT round(sh, 6) AS overall_shift, round(p, 6) AS outlier_share, n AS n_outliers, array_to_string(a, ',') AS affected, CASE WHEN sh <= 1 AND p < 0.1 THEN 'CONFORMING_DISTRIBUTION' WHEN p >= 0.4 OR (list_has_any(a, ['digit_share', 'upper_share', 'space_share']) AND p >= 0.25) THEN 'OPERATIONAL_DRIFT_INDICATOR' WHEN n > 0 THEN 'SUSPICIOUS_ANOMALY_CLUSTER' ELSE 'DISTRIBUTION_SHIFT' END AS classification,
 CASE classification WHEN 'OPERATIONAL_DRIFT_INDICATOR' THEN CASE WHEN sh > 2.5 THEN 'MEDIUM' ELSE 'LOW' END WHEN 'SUSPICIOUS_ANOMALY_CLUSTER' THEN CASE WHEN sh > 3 THEN 'HIGH' ELSE 'MEDIUM' END WHEN 'DISTRIBUTION_SHIFT' THEN 'LOW' END AS severity,
 CASE classification WHEN 'CONFORMING_DISTRIBUTION' THEN 'NONE' WHEN 'SUSPICIOUS_ANOMALY_CLUSTER' THEN 'MEDIUM' WHEN 'DISTRIBUTION_SHIFT' THEN 'LOW' ELSE CASE WHEN sh > 3 THEN 'MEDIUM' ELSE 'LOW' END END AS risk,
 CASE WHEN classification IN ('CONFORMING_DISTRIBUTION', 'OPERATIONAL_DRIFT_INDICATOR') THEN 'HIGH' ELSE 'MODERATE' END AS confidence FROM x""",
    "outside_shares": f"""WITH {FEATURES_SQL}, r AS ({_PROFILE} features WHERE lang = 'en' GROUP BY 1)
SELECT feature, count_if(abs(value - median) / iqr > 3) AS n_outside, round(avg((abs(value - median) / iqr > 3)::INT), 6) AS share FROM features JOIN r USING (feature) WHERE lang <> 'en' GROUP BY 1""",
    "reference_outliers": f"""WITH {FEATURES_SQL}, r AS ({_PROFILE} features WHERE lang = 'en' GROUP BY 1), z AS (SELECT seq, feature, abs(value - median) / iqr AS score FROM features JOIN r USING (feature) WHERE lang <> 'en'),
d AS (SELECT seq, sqrt(sum(score * score)) AS distance, string_agg(feature, ',' ORDER BY feature) FILTER (score > 3) AS dims FROM z GROUP BY 1)
SELECT seq, round(d.distance, 6) AS distance, dims FROM d WHERE dims IS NOT NULL ORDER BY d.distance DESC, seq LIMIT 10""",
    "distribution_outliers": f"""WITH {FEATURES_SQL}, r AS ({_PROFILE} features GROUP BY 1), z AS (SELECT seq, feature, abs(value - median) / iqr AS score FROM features JOIN r USING (feature)),
d AS (SELECT seq, sqrt(sum(score * score)) AS distance, coalesce(array_to_string(list_sort(list(feature) FILTER (score > 2.8)), ','), '') AS dims FROM z GROUP BY 1),
t AS (SELECT greatest(3.5, quantile_cont(distance, 0.5) + 3 * greatest(0.5, quantile_cont(distance, 0.75) - quantile_cont(distance, 0.25))) AS threshold FROM d)
SELECT seq, round(distance, 6) AS distance, dims, CASE WHEN distance > 1.5 * threshold THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM d, t WHERE distance > threshold ORDER BY d.distance DESC, seq LIMIT 15""",
    "contributor_rates": """WITH f AS (SELECT doc_id, 'low_quality' AS issue FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1),
c AS (SELECT coalesce(source, 'unattributed') AS contributor, count(DISTINCT d.doc_id) AS total, count(DISTINCT f.doc_id) AS flagged, coalesce(array_to_string(list_sort(list(DISTINCT f.issue) FILTER (f.issue IS NOT NULL)), ','), '') AS issues FROM documents d LEFT JOIN f USING (doc_id) GROUP BY 1)
SELECT contributor, total, flagged, round(flagged / total, 6) AS rate, issues, contributor <> 'unattributed' AND flagged >= 2 AND flagged / total >= 0.3 AS anomalous,
CASE WHEN contributor <> 'unattributed' AND flagged >= 2 AND flagged / total >= 0.3 THEN CASE WHEN flagged / total >= 0.5 AND flagged >= 3 THEN 'HIGH' ELSE 'MEDIUM' END END AS severity FROM c""",
    "assessment_summaries": """WITH r AS (SELECT l_orderkey AS assessment_id, CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'FAILED' ELSE 'NOT_APPLICABLE' END WHEN l_linestatus = 'F' THEN 'PARTIAL' ELSE 'SUCCESS' END AS status,
 CASE WHEN l_discount > 0.08 THEN 3 WHEN l_discount > 0.05 THEN 2 WHEN l_discount > 0.02 THEN 1 ELSE 0 END AS risk, l_tax > 0.07 AS low FROM lineitem),
s AS (SELECT assessment_id, max(CASE WHEN status IN ('SUCCESS', 'PARTIAL') THEN risk END) AS risk, count_if(status <> 'NOT_APPLICABLE') AS applicable, count_if(status IN ('SUCCESS', 'PARTIAL')) AS executed, bool_or(status = 'FAILED') AS failed, bool_or(status = 'PARTIAL') AS part, bool_or(status IN ('SUCCESS', 'PARTIAL') AND low) AS low, count_if(status NOT IN ('SKIPPED', 'NOT_APPLICABLE', 'UNAVAILABLE')) AS ran FROM r GROUP BY 1),
c AS (SELECT *, CASE WHEN applicable = 0 THEN 1.0 ELSE executed / applicable END AS coverage FROM s),
v AS (SELECT *, CASE WHEN ran = 0 THEN 'LOW' WHEN coverage = 1 AND NOT failed AND NOT low AND NOT part THEN 'HIGH' WHEN coverage > 0.5 AND NOT failed AND NOT low THEN 'MODERATE' ELSE 'LOW' END AS conf FROM c)
SELECT assessment_id, CASE risk WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' WHEN 0 THEN 'NONE' END AS overall_risk, applicable, executed, round(coverage, 6) AS coverage, conf AS overall_confidence,
CASE WHEN assessment_id % 50 = 0 THEN 'REJECT / AUDIT CHAIN COMPROMISED' WHEN risk = 3 THEN 'QUARANTINE / REJECT ARTIFACT' WHEN risk = 2 THEN 'INVESTIGATE / ANALYST REVIEW REQUIRED' WHEN risk = 1 THEN 'ACCEPT WITH MONITORING' WHEN coverage < 0.6 OR conf IN ('LOW', 'MODERATE') THEN 'PROVISIONAL ACCEPTANCE / INCOMPLETE COVERAGE' ELSE 'ACCEPT / NO INTEGRITY ANOMALY DETECTED' END AS disposition FROM v""",
}
