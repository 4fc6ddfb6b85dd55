"""The checks as one function each, and the run of all of them.

A check takes frames by name and a set of parameters and returns findings, evidence and one verdict row; nothing is run
until the caller writes or reads them. A check that can't run says why, and one that fails becomes a verdict row, never a
pass.
"""

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaya.operators import models, provenance, similarity, statistics, verdicts
from assaya.shared import cut, stored

FINDINGS = "finding_id string, detector_id string, category string, subcategory string, severity string, title string, seq long"
#: A row for each sample of a finding; a null one where a finding has none.
EVIDENCE = "finding_id string, detector_id string, sample_id long, data_json string, seq long"
VERDICT = "detector_id string, status string, risk_level string, confidence_level string, applicable boolean, reason string, findings_count long, evidence_count long, started_at timestamp, duration_ms long"
#: The category of a check's findings.
CATEGORIES = {"DI": "data_integrity", "MI": "model_integrity", "PI": "inference_provenance"}


@dataclass(frozen=True)
class Params:
    near_bits: int = 10
    conflict_bits: int = 4
    conflict_cap: int | None = 20
    outlier_cap: int | None = 15
    reference_cap: int | None = 10
    pattern_share: float = 0.15
    pattern_samples: int | None = 10
    tensors_shown: int | None = 50
    layers_shown: int | None = 30
    #: Features that light changes; a shift in them is rather drift.
    photometric: tuple[str, ...] = ("red_channel_mean", "green_channel_mean", "blue_channel_mean", "luminance_variance")


@dataclass
class Result:
    """``verdict``: one row (risk, confidence) or (risk, confidence, status)."""

    findings: DataFrame
    evidence: DataFrame
    verdict: DataFrame | None = None


@dataclass(frozen=True)
class Check:
    """``needs``: frame to (least rows, reason where there are fewer)."""

    code: str
    run: Callable[[dict[str, DataFrame], Params], Result]
    needs: dict[str, tuple[int, str]] = field(default_factory=dict)


def _found(rows: DataFrame, code: str, subcategory: str | Column, key: str | Column, severity, title, data, samples: Column | None = None, members: tuple[str, DataFrame] | None = None) -> Result:
    """Findings and evidence of rows, with ids from the check and the row's key, so that a second run gives the same. They
    are ordered by the number that the key begins with, else by its hash. The samples of a finding are the array ``samples`` or, where they can be many, ``members``: a column of the rows, and
    (column, sample_id); without either there is one row of evidence. ``data``: the evidence, or null for none."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    key = F.col(key) if isinstance(key, str) else key
    named = rows.select("*", as_column(subcategory).alias("_sub"), key.cast("string").alias("_key")).withColumn("finding_id", F.sha2(F.concat_ws("|", F.lit(code), "_sub", "_key"), 256))
    category = "distribution_drift" if code == "DI-04" else CATEGORIES[code[:2]]
    first = F.regexp_extract("_key", r"^(\d{1,18})(?:-|$)", 1)
    seq = F.coalesce(first.try_cast("long"), F.xxhash64("_key"))
    findings = named.select("finding_id", F.lit(code).alias("detector_id"), F.lit(category).alias("category"), F.col("_sub").alias("subcategory"), as_column(severity).alias("severity"), title.alias("title"), seq.alias("seq"))
    record = ["finding_id", F.lit(code).alias("detector_id"), F.to_json(data).alias("data_json"), seq.alias("seq")]
    if members is not None:
        evidence = named.select(*record, F.col(members[0]).alias("_on")).join(members[1].withColumnRenamed(members[0], "_on"), "_on")
    else:
        evidence = named.select(*record, F.explode_outer(F.array().cast("array<bigint>") if samples is None else samples).alias("sample_id"))
    return Result(findings, evidence.select("finding_id", "detector_id", F.col("sample_id").cast("long").alias("sample_id"), "data_json", "seq"))


def _all(*results: Result, verdict: DataFrame | None = None) -> Result:
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    return Result(union([r.findings for r in results]), union([r.evidence for r in results]), verdict)


def _worst(rows: DataFrame) -> DataFrame:
    """One verdict of several (risk, confidence[, status]): the highest risk, the least confidence, PARTIAL if any is."""
    place = F.array_position(F.array(*map(F.lit, ("LOW", "MODERATE", "HIGH"))), F.col("confidence"))
    status = F.bool_or(F.col("status") == "PARTIAL") if "status" in rows.columns else F.lit(False)
    return rows.agg(verdicts.worst(F.col("risk")).alias("risk"), F.min_by("confidence", place).alias("confidence"), F.when(status, "PARTIAL").otherwise("SUCCESS").alias("status"))


def duplicates(frames: dict[str, DataFrame], params: Params) -> Result:
    rows = frames["samples"]
    exact = rows.filter("sha256 is not null").groupBy("sha256").agg(F.count("*").alias("n"), F.min("seq").alias("first")).filter("n >= 2")
    a = _found(exact, "DI-01", "exact_duplicates", "first", "MEDIUM", F.format_string("%d identical samples", "n"), F.struct("sha256", "n"), members=("sha256", rows.select("sha256", F.col("seq").alias("sample_id"))))
    near, members = similarity.near_groups(rows, params.near_bits)
    near = cut(near)
    b = _found(near, "DI-01", "near_duplicates", "cluster", "LOW", F.format_string("%d samples within %d bits", "size", "max_distance"), F.struct("size", "max_distance"), members=("cluster", members))
    return _all(a, b, verdict=verdicts.duplicates(rows, near).select("risk", "confidence", "status"))


def labels(frames: dict[str, DataFrame], params: Params) -> Result:
    rows = frames["samples"]
    conflicts = similarity.label_conflicts(rows, params.conflict_bits, params.conflict_cap)
    a = _found(conflicts, "DI-02", "label_conflict", F.concat_ws("-", "seq_a", "seq_b"), "HIGH", F.format_string("labels of %d and %d differ", "seq_a", "seq_b"), F.struct("distance"), F.array("seq_a", "seq_b"))
    odd = similarity.label_outliers(similarity.per_label(rows))
    b = _found(odd, "DI-02", "label_outlier", F.concat_ws("-", "seq", "class"), "MEDIUM", F.concat(F.lit("unlike class "), "class"), F.struct("class", "distance", "other_distance"), F.array("seq"))
    return _all(a, b)


def patterns(frames: dict[str, DataFrame], params: Params) -> Result:
    found, members = similarity.pattern_groups(frames["patches"], share=params.pattern_share)
    first = similarity.first_per_key(members, ["location", "leader"], ["seq"], params.pattern_samples)
    on = F.concat_ws(":", "location", "leader")
    of_leader = first.select(on.alias("_pattern"), F.col("seq").alias("sample_id"))
    title = F.concat(F.lit("recurring pattern at "), "location")
    return _found(found.withColumn("_pattern", on), "DI-03", "trigger_injection", on, F.col("severity"), title, F.struct("location", "n_members", "n_contents", "n_classes"), members=("_pattern", of_leader))


def distribution(frames: dict[str, DataFrame], params: Params) -> Result:
    """Against ``reference_features`` where there are any, else within the samples."""
    rows, reference = frames["features"], frames.get("reference_features")
    if reference is None:
        odd = statistics.robust_outliers(rows, params.outlier_cap)
        return _found(odd, "DI-04", "sample_distribution_outlier", "seq", F.col("severity"), F.concat(F.lit("far in "), F.array_join("dims", ", ")), F.struct("distance", "dims"), F.array("seq"))
    shift = cut(statistics.drift(rows, reference, list(params.photometric)))
    shifted = shift.filter("classification <> 'CONFORMING_DISTRIBUTION'")
    a = _found(shifted, "DI-04", F.lower("classification"), F.lit("0"), F.col("severity"), F.concat(F.lit("shift in "), F.array_join("affected", ", ")), F.struct("overall_shift", "affected", "outlier_share"))
    odd = statistics.reference_outliers(rows, reference, params.reference_cap).join(shifted.select("classification"))
    b = _found(odd, "DI-04", "sample_distribution_outlier", "seq", "LOW", F.concat(F.lit("outside the reference in "), F.array_join("dims", ", ")), F.struct("distance", "dims"), F.array("seq"))
    return _all(a, b, verdict=shift.select("risk", "confidence"))


def contributors(frames: dict[str, DataFrame], params: Params) -> Result:
    """Reads the evidence of the checks on data before it."""
    issues = frames["findings"].select("finding_id", F.coalesce("subcategory", "category").alias("issue"))
    flagged = frames["evidence"].filter("sample_id is not null and detector_id like 'DI-%'").join(issues, "finding_id").select("sample_id", "issue").distinct()
    rates = statistics.contributor_rates(frames["samples"].select(F.col("seq").alias("sample_id"), F.nullif(F.trim("contributor"), F.lit("")).alias("contributor")), flagged).filter("anomalous")
    return _found(rates, "DI-05", "contributor_risk", "contributor", F.col("severity"), F.concat(F.lit("defects concentrate on "), "contributor"), F.struct("contributor", "total", "flagged", "rate", "issues"))


def fingerprints(frames: dict[str, DataFrame], params: Params) -> Result:
    diffs = cut(models.fingerprint_diff(frames["fingerprint_fields"], frames["reference_fields"]))
    found = cut(models.fingerprint_verdict(frames["fingerprints"], diffs))
    a = _found(found, "MI-01", "fingerprint_recorded", "model_id", "INFO", F.lit("model fingerprint recorded"), F.struct("model_id", "n_diffs"))
    differ = found.filter("n_diffs > 0")
    b = _found(differ, "MI-01", "integrity_mismatch", "model_id", verdicts.severity_of(F.col("risk")), F.format_string("%d fields differ from the reference", "n_diffs"), F.struct("model_id", "n_diffs"))
    own = b.evidence.select("finding_id", F.get_json_object("data_json", "$.model_id").alias("_m"), "seq")
    rows = diffs.join(own, F.col("model_id").cast("string") == F.col("_m"))
    record = F.to_json(F.struct(F.concat_ws(".", "section", "field").alias("field"), F.col("reference").alias("reference_value"), F.col("observed").alias("observed_value")))
    b.evidence = rows.select("finding_id", F.lit("MI-01").alias("detector_id"), F.lit(None).cast("long").alias("sample_id"), record.alias("data_json"), "seq")
    return _all(a, b, verdict=_worst(found))


def parameters(frames: dict[str, DataFrame], params: Params) -> Result:
    stats = cut(statistics.value_statistics(frames["tensors"], ["model_id", "tensor_name"]))
    found = cut(statistics.parameter_verdict(stats))
    kind = F.when(F.col("non_finite") > 0, "parameter_corruption").when(F.col("risk") == "MEDIUM", "weight_distribution_anomaly").otherwise("extreme_sparsity_anomaly")
    a = _found(found.filter("risk <> 'NONE'"), "MI-02", kind, "model_id", F.col("severity"), F.format_string("%d values aren't finite, %d tensors are zeros", "non_finite", "sparse_tensors"), F.struct("model_id", "non_finite"))
    b = _found(found, "MI-02", "parameter_stats_recorded", "model_id", "INFO", F.format_string("%d parameters in %d tensors", "parameters", "tensors"), F.struct("model_id"))
    first = similarity.first_per_key(stats, ["model_id"], ["tensor_name"], params.tensors_shown)
    return _shown(_all(a, b, verdict=_worst(found)), b, first, "MI-02")


def _shown(result: Result, baseline: Result, rows: DataFrame, code: str) -> Result:
    """The result with a row of evidence for each of the baseline's ``rows`` (model_id and measures)."""
    own = baseline.evidence.select("finding_id", F.get_json_object("data_json", "$.model_id").alias("_m"), "seq")
    rows = rows.join(own, F.col("model_id").cast("string") == F.col("_m"))
    data = F.to_json(F.struct(*[c for c in rows.columns if c not in ("finding_id", "_m", "seq")]))
    more = rows.select("finding_id", F.lit(code).alias("detector_id"), F.lit(None).cast("long").alias("sample_id"), data.alias("data_json"), "seq")
    return Result(result.findings, result.evidence.unionByName(more), result.verdict)


def activations(frames: dict[str, DataFrame], params: Params) -> Result:
    stats = cut(statistics.value_statistics(frames["activations"], ["model_id", "layer_name", "probe_name"]))
    found = cut(statistics.activation_verdict(stats))
    kind = F.when(F.col("non_finite") > 0, "activation_numerical_instability").otherwise("activation_collapse")
    a = _found(found.filter("risk <> 'NONE'"), "MI-03", kind, "model_id", F.col("risk"), F.format_string("%d activations aren't finite, %d layers are dead", "non_finite", "dead_layers"), F.struct("model_id", "non_finite", "dead_layers"))
    b = _found(found, "MI-03", "activation_profile_recorded", "model_id", "INFO", F.format_string("%d layers", "layers"), F.struct("model_id"))
    first = similarity.first_per_key(stats, ["model_id"], ["layer_name", "probe_name"], params.layers_shown)
    return _shown(_all(a, b, verdict=_worst(found)), b, first, "MI-03")


def comparison(frames: dict[str, DataFrame], params: Params) -> Result:
    found = cut(models.file_comparison(frames["model_files"], frames["reference_files"], frames["output_errors"]))
    rows = _found(found, "MI-04", F.col("outcome"), "model_id", verdicts.severity_of(F.col("risk")), F.replace("outcome", F.lit("_"), F.lit(" ")), F.struct("model_id", "mse"))
    return _all(rows, verdict=_worst(found))


def triggers(frames: dict[str, DataFrame], params: Params) -> Result:
    outputs = frames["outputs"]
    spread = cut(statistics.diversity(outputs, ["model", "perturbation"]))
    tried = cut(models.trigger_evaluations(outputs, spread, statistics.convergence, F.lit(0), F.lit(1)))
    found = cut(models.trigger_verdict(tried))
    kind = F.when(F.col("status") == "PARTIAL", "trigger_analysis_insufficient_diversity").when(F.col("risk") == "HIGH", "suspicious_trigger_convergence").otherwise("trigger_search_completed")
    rows = _found(found, "MI-05", kind, "model", verdicts.severity_of(F.col("risk")), F.format_string("%d suspicious perturbations", "n_suspicious"), F.struct("model", "min_ratio"))
    return _all(rows, verdict=_worst(found))


def inference(frames: dict[str, DataFrame], params: Params) -> Result:
    manifests, signed = frames["manifests"], frames["signatures"]
    bound = kept(provenance.bindings(manifests, frames["artifacts"]), "bound")
    odd = provenance.sequence_anomalies(manifests).select("manifest_id", "anomaly").union(provenance.nonce_reuse(manifests).select("manifest_id", F.lit("duplicate_nonce")))
    odd = kept(odd, "odd")
    found = provenance.verdicts(manifests, bound, odd, signed)
    key, about = "manifest_id", F.struct("manifest_id")
    forged = _found(signed.filter("not signature_valid"), "PI-01", "signature_invalid", key, "HIGH", F.lit("invalid signature"), about)
    sound = _found(signed.filter("signature_valid"), "PI-01", "provenance_valid", key, "INFO", F.lit("signature verified"), about)
    failed = bound.select(key, F.explode("failed").alias("what"))
    mismatch = _found(failed, "PI-01", F.concat(F.regexp_replace("what", "_sha256$", ""), F.lit("_mismatch")), key, "HIGH", F.concat(F.col("what"), F.lit(" differs")), F.struct(key, "what"))
    replays = _found(odd, "PI-01", "replay_detected", F.concat_ws("-", key, "anomaly"), "MEDIUM", F.replace("anomaly", F.lit("_"), F.lit(" ")), F.struct(key, "anomaly"))
    open_ = _found(bound.filter("size(missing) > 0"), "PI-01", "coverage_gap", key, "INFO", F.concat(F.lit("not verified: "), F.array_join("missing", ", ")), F.struct(key, "missing"))
    return _all(forged, mismatch, replays, open_, sound, verdict=_worst(found))


#: The confidence in a check's verdict by its worst severity, where nothing else sets it.
CONFIDENCE = {
    "DI-02": {"HIGH": "HIGH", "MEDIUM": "MODERATE", "LOW": "MODERATE"},
    "DI-03": {"HIGH": "HIGH", "MEDIUM": "MODERATE"},
    "DI-04": {"MEDIUM": "MODERATE", "LOW": "LOW"},
    "DI-05": {"HIGH": "HIGH", "MEDIUM": "HIGH"},
}
REGISTRY = {
    c.code: c
    for c in (
        Check("DI-01", duplicates, {"samples": (1, "no samples")}),
        Check("DI-02", labels, {"labelled": (2, "fewer than two labelled samples")}),
        Check("DI-03", patterns, {"patches": (3, "fewer than three samples with patches")}),
        Check("DI-04", distribution, {"features": (5, "fewer than five samples with features")}),
        Check("DI-05", contributors, {"contributed": (1, "no contributor")}),
        Check("MI-01", fingerprints, {"fingerprints": (1, "no model"), "fingerprint_fields": (0, "no fingerprint"), "reference_fields": (0, "no reference")}),
        Check("MI-02", parameters, {"tensors": (1, "no tensors")}),
        Check("MI-03", activations, {"activations": (1, "no activations")}),
        Check("MI-04", comparison, {"model_files": (1, "no model file"), "reference_files": (1, "no reference model"), "output_errors": (0, "no outputs")}),
        Check("MI-05", triggers, {"outputs": (1, "no outputs of perturbed probes")}),
        Check("PI-01", inference, {"manifests": (1, "no manifest"), "signatures": (1, "no signature"), "artifacts": (0, "no artifacts")}),
    )
}


def kept(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a check, one or more for each record that it looks at, in columns that pack well: in a checkpoint they take
    some times the disk."""
    return stored(rows, name, "zstd")


def needed(codes: Iterable[str]) -> set[str]:
    """The frames that these checks read, but for those that checks hand on."""
    parts = {"labelled": "samples", "contributed": "samples"}
    return {parts.get(name, name) for code in codes for name in REGISTRY[code].needs}


def _counted(df: DataFrame, least: int) -> bool:
    return least == 0 or df.limit(least).count() >= least


def _frames(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The frames with the parts of ``samples`` that checks ask for."""
    if "samples" not in frames:
        return frames
    rows = frames["samples"]
    return {"labelled": rows.filter("size(labels) > 0").select("seq"), "contributed": rows.filter("trim(contributor) <> ''").select("seq")} | frames


def run_battery(spark: SparkSession, frames: dict[str, DataFrame], params: Params = Params(), checks: dict[str, Check] = REGISTRY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings, evidence and verdicts of all checks, in the order of the registry. Findings and evidence of a check are
    written down before the next reads them. A check's risk and confidence are its own verdict's or follow from its worst finding;
    one without findings has none, at high confidence."""
    findings, evidence = spark.createDataFrame([], FINDINGS), spark.createDataFrame([], EVIDENCE)
    frames, rows = _frames(frames), []
    for code, check in checks.items():
        began = datetime.now(timezone.utc)
        spent = lambda: (datetime.now(timezone.utc) - began) // timedelta(milliseconds=1)  # noqa: E731,B023
        missing = next((reason for name, (least, reason) in check.needs.items() if name not in frames or not _counted(frames[name], least)), None)
        if missing:
            rows.append((code, "SKIPPED", None, "LOW", False, missing, 0, 0, began, spent()))
            continue
        try:
            result = check.run({**frames, "findings": findings, "evidence": evidence}, params)
            own, seen = kept(result.findings.select(findings.columns), "findings"), kept(result.evidence.select(evidence.columns), "evidence")
            verdict = result.verdict.first().asDict() if result.verdict is not None else {}
        except Exception as failure:  # a failed check is reported, whatever failed it
            rows.append((code, "FAILED", None, "LOW", True, str(failure)[:300], 0, 0, began, spent()))
            continue
        worst = own.agg(F.count("*").alias("n"), verdicts.worst(F.col("severity")).alias("risk")).first()
        risk = verdict.get("risk") or worst["risk"] or "NONE"
        sure = verdict.get("confidence") or CONFIDENCE.get(code, {}).get(risk, "HIGH")
        held = seen.agg(F.countDistinct("finding_id")).first()[0]
        rows.append((code, verdict.get("status") or "SUCCESS", risk, sure, True, None, worst["n"], held, began, spent()))
        findings, evidence = findings.unionByName(own), evidence.unionByName(seen)
    return findings, evidence, spark.createDataFrame(rows, VERDICT)


def coverage_gaps(results: DataFrame) -> DataFrame:
    """(detector_id, gap): what was skipped or failed, and why."""
    return results.filter(F.col("status").isin("SKIPPED", "FAILED")).select("detector_id", F.concat_ws(": ", "detector_id", F.lower("status"), "reason").alias("gap"))


def export(results: DataFrame, findings: DataFrame, evidence: DataFrame, most_evidence: int | None = None) -> DataFrame:
    """(detector_id, seq, finding_id, part, sample_id, document): one JSON document for each verdict, each finding and each
    row of evidence, sorted so that a check's verdict comes first and a finding before its evidence. No group is collected.
    """
    if most_evidence is not None:
        evidence = similarity.first_per_key(evidence, ["finding_id"], ["seq", "sample_id"], most_evidence)

    def written(rows: DataFrame, part: str, **keys) -> DataFrame:
        document = F.to_json(F.struct(*sorted(rows.columns), F.lit(part).alias("part")), {"ignoreNullFields": "false"})
        keys = {"seq": F.col("seq"), "finding_id": F.col("finding_id"), "sample_id": F.lit(None).cast("long")} | keys
        return rows.select("detector_id", keys["seq"].alias("seq"), keys["finding_id"].alias("finding_id"), F.lit(part).alias("part"), keys["sample_id"].alias("sample_id"), document.alias("document"))

    verdict = written(results, "verdict", seq=F.lit(None).cast("long"), finding_id=F.lit(None).cast("string"))
    rows = verdict.unionByName(written(findings, "finding")).unionByName(written(evidence, "evidence", sample_id=F.col("sample_id")))
    return rows.orderBy("detector_id", "seq", "finding_id", F.desc("part"), "sample_id")


def context_text(findings: DataFrame, evidence: DataFrame, most_findings: int = 25, most_evidence: int = 8, most_item: int = 800, most: int = 7500) -> DataFrame:
    """(detector_id, context): a bounded text of a check's first findings and evidence, redacted."""
    from assaya.functions.text import redact

    first = similarity.first_per_key(findings, ["detector_id"], [F.col("seq"), F.col("finding_id")], most_findings)
    lines = first.select("detector_id", F.lit(0).alias("part"), "seq", F.concat_ws(" ", F.concat(F.lit("["), "severity", F.lit("]")), "title").alias("line"))
    records = evidence.select("detector_id", "finding_id", "seq", "data_json").distinct()
    items = similarity.first_per_key(records, ["detector_id"], [F.col("seq"), F.col("finding_id")], most_evidence)
    lines = lines.unionByName(items.select("detector_id", F.lit(1).alias("part"), "seq", F.substring("data_json", 1, most_item).alias("line")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "line"))), lambda x: x["line"]), "\n")
    rows = lines.groupBy("detector_id").agg(text.alias("t")).select("detector_id", redact(F.col("t")).alias("t"))
    mark = "... [truncated]"
    return rows.select("detector_id", F.when(F.length("t") > most, F.concat(F.substring("t", 1, most - len(mark)), F.lit(mark))).otherwise(F.col("t")).alias("context"))
