"""What an assessment shows and exports: its plan, gaps, limits, provenance, audit trail and documents.

Exports are rows, one JSON document for each part, sorted so that a reader meets them in order: no group is collected.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaya.functions.canonical import sanitized
from assaya.operators.ledger import GENESIS, event_hash
from assaya.operators.ranges import running
from assaya.shared import cut

#: For each check in the order of its plan, the asset that it needs, then what a gap in it says: the capability
#: it asks for, what isn't assessed without it, and what to do.
CHECKS = (
    ("DI-01", "dataset", "dataset with ingested samples and fingerprints", "duplicate_flooding_not_assessed", "provide a dataset and run ingestion before assessment"),
    ("DI-02", "dataset", "dataset with annotated class labels (>= 2 labeled samples)", "label_flipping_and_mislabelling_not_assessed", "provide a dataset with annotations (COCO format or label metadata) to evaluate label integrity"),
    ("DI-03", "dataset", "dataset with >= 3 image samples for recurring spatial patch analysis", "trigger_injection_and_backdoor_patterns_not_assessed", "provide at least 3 samples to evaluate spatial trigger anomalies"),
    ("DI-04", "dataset", "dataset with >= 5 image samples for statistical distribution analysis", "out_of_distribution_and_anomalous_samples_not_assessed", "provide at least 5 samples to establish distribution baseline"),
    ("DI-05", "dataset", "dataset with contributor/source attribution metadata on samples", "contributor_source_risk_not_assessed", "include contributor/source attribution in dataset metadata or directory structure"),
    ("MI-01", "model", "compatible model file (.onnx/.pt/.pth/.ts) and model_path in request", "model_integrity_not_assessed", "provide a compatible model file (ONNX preferred for full analysis)"),
    ("MI-02", "model", "compatible model file (.onnx/.pt/.pth/.ts) with inspectable parameter tensors", "parameter_statistics_and_weight_integrity_not_assessed", "provide a compatible model file to inspect parameter distributions and corruption"),
    ("MI-03", "model", "executable model graph (.onnx or .ts) for intermediate activation tracing", "internal_representation_and_activation_health_not_assessed", "provide an executable ONNX or TorchScript model to evaluate activation health"),
    ("MI-05", "model", "executable model (.onnx or .ts) for behavioral perturbation testing", "trigger_sensitivity_and_backdoor_convergence_not_assessed", "provide an executable ONNX or TorchScript model to test candidate trigger perturbations"),
    ("MI-04", "reference_model", "baseline reference model file or stored reference fingerprint profile", "reference_model_comparison_and_drift_not_assessed", "supply a reference model artifact or reference fingerprint for comparative battery"),
    ("PI-01", "provenance_manifest", "signed ProvenanceManifest and Ed25519 public key", "inference_provenance_not_verified", "provide a signed manifest and the corresponding verification key"),
)
#: The reason of a gap by the status of its run.
REASONS = (("SKIPPED", "detector_skipped"), ("UNAVAILABLE", "detector_unavailable"), ("NOT_APPLICABLE", "not_applicable"))
SKIPPED = tuple(status for status, _ in REASONS)


def plan(assets: DataFrame, key: str = "assessment_id") -> DataFrame:
    """(key, position, code, applicable, reason) over assets (key, has_dataset, has_model, has_reference_model,
    has_provenance_manifest): which checks apply, and what those that don't lack. A comparison needs the model first."""
    rows = []
    for i, (code, needs, *_) in enumerate(CHECKS):
        has = F.col(f"has_{needs}")
        has, lacks = (has & F.col("has_model"), F.when(F.col("has_model"), f"no_{needs}_provided").otherwise("no_model_provided")) if needs == "reference_model" else (has, F.lit(f"no_{needs}_provided"))
        rows.append(F.struct(F.lit(i).alias("position"), F.lit(code).alias("code"), has.alias("applicable"), F.when(~has, lacks).alias("reason")))
    return assets.select(key, F.explode(F.array(*rows)).alias("x")).select(key, "x.*")


def gaps(results: DataFrame, key: str = "assessment_id") -> DataFrame:
    """(key, code, reason, required, observed, impact, action) of applicable checks that didn't run. ``results``: key, code,
    status, applicable, error."""
    reason = F.lit("detector_could_not_run")
    for status, name in reversed(REASONS):
        reason = F.when(F.col("status") == status, name).otherwise(reason)
    said = [F.create_map(*[F.lit(x) for check in CHECKS for x in (check[0], check[at])]) for at in (2, 3, 4)]
    required, impact, action = (F.coalesce(F.try_element_at(m, F.col("code")), F.lit(other)) for m, other in zip(said, ("unknown", "unknown_impact", "contact support")))
    open_ = results.filter(F.col("applicable") & F.col("status").isin(*SKIPPED)).withColumn("reason", reason)
    return open_.select(key, "code", "reason", required.alias("required"), F.coalesce("error", "reason").alias("observed"), impact.alias("impact"), action.alias("action"))


def limiting_factors(results: DataFrame, key: str = "assessment_id") -> DataFrame:
    """(key, source, seq, text): why an assessment's confidence is limited, in order: that nothing ran, or else each gap, a
    partial run, a failed one and how many were of low confidence."""
    ran = ~F.col("status").isin(*SKIPPED)
    sums = results.groupBy(key).agg(
        F.count_if(ran).alias("_ran"), F.count_if(F.col("status") == "PARTIAL").alias("_partial"), F.count_if(F.col("status") == "FAILED").alias("_failed"), F.count_if(ran & (F.col("confidence_level") == "LOW")).alias("_low")
    )
    fixed = F.array(
        F.struct(F.lit(0).alias("source"), F.when(F.col("_ran") == 0, "All applicable detectors were unavailable or skipped.").alias("text")),
        F.struct(F.lit(2).alias("source"), F.when((F.col("_ran") > 0) & (F.col("_partial") > 0), "One or more detectors completed with partial coverage (framework limitations or missing optional capabilities).").alias("text")),
        F.struct(F.lit(3).alias("source"), F.when((F.col("_ran") > 0) & (F.col("_failed") > 0), "One or more detectors failed during execution.").alias("text")),
        F.struct(F.lit(4).alias("source"), F.when((F.col("_ran") > 0) & (F.col("_low") > 0), F.concat(F.col("_low"), F.lit(" detector(s) reported LOW confidence (insufficient data or analysis limitations)."))).alias("text")),
    )
    whole = sums.select(key, F.explode(fixed).alias("x")).select(key, "x.source", F.lit(0).alias("seq"), "x.text")
    order = F.array_position(F.array(*[F.lit(c[0]) for c in CHECKS]), F.col("code")).cast("int")
    said = F.when(F.col("_ran") == 0, F.concat_ws(": ", "code", "reason")).otherwise(F.concat(F.col("code"), F.lit(" could not run ("), "reason", F.lit("): "), "impact"))
    own = gaps(results, key).join(sums, key).select(key, F.lit(1).alias("source"), order.alias("seq"), said.alias("text"))
    return whole.filter("text is not null").unionByName(own)


def provenance_status(findings: DataFrame, key: str = "assessment_id") -> DataFrame:
    """(key, signature, replay, binding) from the subcategories of an assessment's provenance findings."""
    has = lambda *names: F.bool_or(F.col("subcategory").isin(*names))
    sums = findings.groupBy(key).agg(has("signature_invalid").alias("s"), has("replay_detected").alias("r"), has("input_mismatch", "model_mismatch", "output_mismatch").alias("b"))
    say = lambda c, yes, no: F.when(F.coalesce(c, F.lit(False)), yes).otherwise(no)
    return sums.select(key, say(F.col("s"), "FAILED", "VERIFIED").alias("signature"), say(F.col("r"), "REPLAY_DETECTED", "CLEAN").alias("replay"), say(F.col("b"), "MISMATCH", "BOUND").alias("binding"))


def manifest_shown(assessments: DataFrame, manifests: DataFrame, named: DataFrame, key: str = "assessment_id") -> DataFrame:
    """(key, manifest_id): the first by sequence of an assessment's own manifests (key, manifest_id, sequence), else the first
    known one that its evidence names (``named``: key, seq, manifest_id); null without either."""
    own = manifests.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("sequence", "manifest_id")).alias("_own"))
    known = named.join(manifests.select("manifest_id").distinct(), "manifest_id", "left_semi")
    told = known.groupBy(key).agg(F.min(F.struct("seq", "manifest_id")).alias("_told"))
    rows = assessments.select(key).join(own, key, "left").join(told, key, "left")
    return rows.select(key, F.coalesce("_own.manifest_id", "_told.manifest_id").alias("manifest_id"))


def contributor_overview(rates: DataFrame, flagged: DataFrame, samples: DataFrame) -> DataFrame:
    """One row: contributors, samples, flagged samples and their share of all; none unless a contributor is anomalous. The
    figures of each contributor are the rows of ``rates`` (see ``contributor_rates``)."""
    of = rates.agg(F.count("*").alias("contributors"), F.bool_or("anomalous").alias("_any"))
    every = samples.agg(F.countDistinct("sample_id").alias("samples"))
    marked = flagged.join(samples.select("sample_id"), "sample_id", "left_semi").agg(F.countDistinct("sample_id").alias("flagged"))
    rows = of.join(every).join(marked).filter(F.coalesce("_any", F.lit(False)))
    return rows.select("contributors", "samples", "flagged", F.coalesce(F.try_divide("flagged", "samples"), F.lit(0.0)).alias("rate"))


def signature_status(unsigned_digest: Column, payload: Column, verdict: Column) -> Column:
    """``unsigned`` where the payload lacks one of the three signing keys; else ``verified`` if the event's hash, with the
    digest of the payload without its internal keys, is the one that was signed and the verdict on the signature is true,
    else ``invalid``."""
    of = lambda name: F.nullif(F.get_json_object(payload, f"$.__{name}"), F.lit(""))
    signed = of("signature").isNotNull() & of("pre_sig_hash").isNotNull() & of("signing_key_id").isNotNull()
    same = event_hash({"payload_digest": unsigned_digest}) == of("pre_sig_hash")
    return F.when(~signed, "unsigned").when(F.coalesce(same & verdict, F.lit(False)), "verified").otherwise("invalid")


def audit_export(events: DataFrame, payload: Column, key: str = "assessment_id") -> DataFrame:
    """(key, sequence, part, document): per assessment a ``summary`` with sequence 0, and each event with its sequence from 1,
    all sanitized. ``events``: key, seq, the hashed fields and current_hash; ``payload``: each one's as JSON text, null for
    none."""
    fields = ["event_id", "event_type", "timestamp_utc", "actor", "current_hash", "previous_hash", "payload_digest"]
    rows = events.select(key, *[f for f in fields if f != key], "seq", payload.alias("payload"), (event_hash() != F.col("current_hash")).alias("_bad"))
    rows = cut(running(rows, [key], ["seq"], sums={"_before": F.lit(1).cast("long")})).withColumn("sequence", F.col("_before") + 1)
    plain = F.to_json(F.struct(*sorted([*fields, "sequence"])), {"ignoreNullFields": "false"})
    document = F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), F.lit(',"payload":'), F.coalesce("payload", F.lit("null")), F.lit("}"))
    each = rows.select(key, "sequence", F.lit("event").alias("part"), sanitized(document).alias("document"))
    ends = rows.groupBy(key).agg(
        F.count_if("_bad").alias("failure_count"), F.min_by("current_hash", "seq").alias("first_event_hash"), F.min_by("event_id", "seq").alias("first_event_id"),
        (F.min_by("previous_hash", "seq") == GENESIS).alias("first_event_genesis_linked"), F.max_by("current_hash", "seq").alias("last_event_hash"), F.max_by("event_id", "seq").alias("last_event_id"), F.count("*").alias("total_events"),
    )
    head = F.to_json(F.struct(*[c for c in ends.columns if c != key]), {"ignoreNullFields": "false"})
    return each.unionByName(ends.select(key, F.lit(0).cast("long").alias("sequence"), F.lit("summary").alias("part"), head.alias("document"))).orderBy(key, "sequence")


def assessment_export(parts: dict[str, DataFrame], key: str = "assessment_id") -> DataFrame:
    """(key, position, part, seq, document): a sanitized JSON document for each row of each part, such as assessment, assets,
    battery, gaps, findings, evidence, provenance and audit, in the order of ``parts``. Every frame has the key and a
    ``seq`` that orders its rows; the other columns are the document's fields."""
    out = None
    for i, (part, rows) in enumerate(parts.items()):
        fields = sorted(c for c in rows.columns if c not in (key, "seq"))
        document = sanitized(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
        own = rows.select(key, F.lit(i).alias("position"), F.lit(part).alias("part"), F.col("seq").cast("long").alias("seq"), document.alias("document"))
        out = own if out is None else out.unionByName(own)
    return out.orderBy(key, "position", "seq")
