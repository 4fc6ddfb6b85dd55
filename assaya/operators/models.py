"""Models: fingerprints and their differences, comparison with a reference, trigger search."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaya.operators.similarity import first_per_key


def structural_fingerprint(tensors: DataFrame, key: str = "model_id", most_names: int = 100) -> DataFrame:
    """Per model over (key, tensor_name, dtype, numel), one row for each tensor: parameters, tensors, ``dtypes`` (an ordered
    array of (dtype, n)) and the first ``most_names`` tensor names in order."""
    kinds = tensors.groupBy(key, "dtype").agg(F.count("*").alias("n"), F.sum("numel").alias("numel"))
    sums = kinds.groupBy(key).agg(F.sum("numel").alias("parameters"), F.sum("n").alias("tensors"), F.array_sort(F.collect_list(F.struct("dtype", "n"))).alias("dtypes"))
    first = first_per_key(tensors.select(key, "tensor_name").distinct(), [key], ["tensor_name"], most_names)
    names = first.groupBy(key).agg(F.array_sort(F.collect_list("tensor_name")).alias("names"))
    return sums.join(names, key)


def behavioural_fingerprint(outputs: DataFrame, keys: list[str], digits: int = 9) -> DataFrame:
    """Per output row (keys, out: array of double): its length, the SHA-256 of its values in order, written with ``digits``
    decimals, and their mean, population deviation, minimum and maximum. An empty output has null moments."""
    written = F.concat_ws(",", F.transform("out", lambda v: v.cast(f"decimal(38,{digits})").cast("string")))
    n, add = F.size("out"), lambda f: F.aggregate("out", F.lit(0.0), lambda s, v: s + f(v))
    rows = outputs.select(*keys, "out", n.cast("long").alias("length"), F.sha2(written, 256).alias("digest"), F.try_divide(add(lambda v: v), n).alias("mean"))
    squares = F.aggregate("out", F.lit(0.0), lambda s, v: s + (v - F.col("mean")) * (v - F.col("mean")))
    return rows.select(*keys, "length", "digest", "mean", F.sqrt(F.try_divide(squares, F.size("out"))).alias("std"), F.array_min("out").alias("min"), F.array_max("out").alias("max"))


def fingerprint_diff(observed: DataFrame, reference: DataFrame, key: str = "model_id") -> DataFrame:
    """(key, section, field, reference, observed) of fields that differ. Both: key, section, field, value; a null value, and
    a section that one side doesn't have, can't be compared and are no difference."""
    a = reference.select(key, "section", "field", F.col("value").alias("reference"))
    b = observed.select(key, "section", "field", F.col("value").alias("observed"))
    return a.join(b, [key, "section", "field"]).filter("reference <> observed")


def fingerprint_verdict(models: DataFrame, diffs: DataFrame, key: str = "model_id") -> DataFrame:
    """Per model of ``models`` (key, has_reference, structural, behavioral: what was available): risk MEDIUM where behaviour
    or structure differs, LOW where only the artifact does, else NONE. Confidence follows from what was available, and is
    never HIGH with differences. Status is PARTIAL unless both fingerprints were available."""
    sections = diffs.groupBy(key).agg(F.count("*").alias("n"), F.bool_or(F.col("section").isin("behavioral", "structural")).alias("deep"))
    rows = models.join(sections, key, "left").withColumn("n_diffs", F.when(F.col("has_reference"), F.coalesce("n", F.lit(0))).otherwise(0))
    risk = F.when(F.col("n_diffs") == 0, "NONE").when(F.col("deep"), "MEDIUM").otherwise("LOW")
    confidence = (
        F.when(~F.col("has_reference"), F.when(F.col("structural") | F.col("behavioral"), "HIGH").otherwise("LOW"))
        .when(F.col("n_diffs") == 0, F.when(F.col("behavioral"), "HIGH").otherwise("MODERATE"))
        .otherwise(F.when(F.col("structural"), "MODERATE").otherwise("LOW"))
    )
    status = F.when(F.col("structural") & F.col("behavioral"), "SUCCESS").otherwise("PARTIAL")
    return rows.select(key, F.col("n_diffs").cast("long").alias("n_diffs"), risk.alias("risk"), confidence.alias("confidence"), status.alias("status"))


def file_comparison(candidates: DataFrame, references: DataFrame, behaviour: DataFrame, key: str = "model_id") -> DataFrame:
    """Per candidate with a reference (both: key, sha256, suffix), the first that holds: the same file, another format,
    behaviour within a mean squared error of 1e-6 or beyond it, another file. ``behaviour``: key and ``mse``, null where
    outputs couldn't be compared. A reference without a suffix is a stored profile: only digests are compared."""
    a = candidates.select(key, "sha256", F.lower("suffix").alias("suffix"))
    b = references.select(key, F.col("sha256").alias("_sha256"), F.lower("suffix").alias("_suffix"))
    rows = a.join(b, key).join(behaviour.select(key, "mse"), key, "left")
    outcome = (
        F.when(F.col("sha256") == F.col("_sha256"), "reference_exact_match")
        .when(F.col("_suffix").isNull(), "fingerprint_mismatch")
        .when(~F.col("suffix").eqNullSafe(F.col("_suffix")), "model_format_substitution")
        .when(F.col("mse") <= 1e-6, "behavioral_equivalent")
        .when(F.col("mse") > 1e-6, "behavioral_divergence")
        .otherwise("artifact_mismatch")
    )
    rows = rows.select(key, "mse", outcome.alias("outcome"))
    risk = F.when(F.col("outcome").isin("reference_exact_match", "behavioral_equivalent"), "NONE").when(F.col("outcome") == "model_format_substitution", "HIGH").otherwise("MEDIUM")
    confidence = F.when(F.col("outcome").isin("fingerprint_mismatch", "artifact_mismatch"), "MODERATE").otherwise("HIGH")
    return rows.select("*", risk.alias("risk"), confidence.alias("confidence"))


def trigger_evaluations(outputs: DataFrame, spread: DataFrame, convergence, clean: Column, control: Column, key: str = "model") -> DataFrame:
    """Per model and perturbation that is neither clean nor control: the clean diversity, convergence ratio, mean shift from
    the clean output of the same probe, and if it is suspicious. ``outputs``: key, perturbation, probe, out; ``spread``:
    key, perturbation, diversity; ``clean`` and ``control`` name perturbations."""
    base = outputs.filter(F.col("perturbation") == clean).select(key, "probe", F.col("out").alias("_c"))
    squares = F.aggregate(F.zip_with("out", "_c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    shifts = outputs.join(base, [key, "probe"]).groupBy(key, "perturbation").agg(F.avg(F.sqrt(squares)).alias("shift"))
    own = spread.filter(F.col("perturbation") == clean).select(key, F.col("diversity").alias("clean"))
    held = shifts.filter(F.col("perturbation") == control).select(key, F.col("shift").alias("_control"))
    tried = spread.filter((F.col("perturbation") != clean) & (F.col("perturbation") != control))
    rows = tried.join(shifts, [key, "perturbation"]).join(own, key).join(held, key, "left")
    ratio, suspicious = convergence(F.col("clean"), F.col("diversity"), F.col("shift"), F.coalesce("_control", F.lit(0.0)))
    return rows.select(key, "perturbation", "clean", ratio.alias("ratio"), "shift", suspicious.alias("suspicious"))


def trigger_verdict(evaluations: DataFrame, key: str = "model", least: float = 0.05) -> DataFrame:
    """Per model: too little clean diversity to tell (PARTIAL, NONE, LOW), a suspicious perturbation (HIGH, HIGH), else NONE
    at HIGH confidence; with the smallest convergence ratio."""
    sums = evaluations.groupBy(key).agg(F.min("clean").alias("_clean"), F.min("ratio").alias("min_ratio"), F.count_if("suspicious").alias("n_suspicious"))
    flat = F.col("_clean") < least
    return sums.select(
        key, "min_ratio", "n_suspicious", F.when(flat, "PARTIAL").otherwise("SUCCESS").alias("status"),
        F.when(~flat & (F.col("n_suspicious") > 0), "HIGH").otherwise("NONE").alias("risk"), F.when(flat, "LOW").otherwise("HIGH").alias("confidence"),
    )
