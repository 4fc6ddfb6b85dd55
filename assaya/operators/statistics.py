"""Tensor, activation and output statistics, drift and outliers, contributor rates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaya.shared import cut

INF = float("inf")


def is_nan(c: Column) -> Column:
    return F.coalesce(F.isnan(c), F.lit(False))


def is_inf(c: Column) -> Column:
    return F.coalesce(F.abs(c) == F.lit(INF), F.lit(False))


def value_statistics(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Per key: numel, nan_count, inf_count, zero_fraction, and minimum, maximum, mean and population deviation of the
    finite values. Nulls aren't elements. One pass with partial sums."""
    v = F.col(value)
    finite = F.when(v.isNotNull() & ~F.isnan(v) & ~is_inf(v), v)
    return values.groupBy(*keys).agg(
        F.count(v).alias("numel"),
        F.count_if(is_nan(v)).alias("nan_count"),
        F.count_if(is_inf(v)).alias("inf_count"),
        F.try_divide(F.count_if(v == 0), F.count(v)).alias("zero_fraction"),
        F.min(finite).alias("min_value"),
        F.max(finite).alias("max_value"),
        F.avg(finite).alias("mean_value"),
        F.stddev_pop(finite).alias("std_value"),
    )


def parameter_totals(stats: DataFrame, key: str = "model_id") -> DataFrame:
    """Per model over the rows of ``value_statistics``, one for each tensor: parameters, tensors, non_finite, sparsity (the
    share of zeros), and minimum, maximum, mean and population deviation of all finite values, exact from the tensors' sums."""
    finite = F.col("numel") - F.col("nan_count") - F.col("inf_count")
    total, squares = F.sum(finite * F.col("mean_value")), F.sum(finite * (F.col("std_value") * F.col("std_value") + F.col("mean_value") * F.col("mean_value")))
    sums = stats.groupBy(key).agg(
        F.sum("numel").alias("parameters"), F.count("*").alias("tensors"), F.sum(F.col("nan_count") + F.col("inf_count")).alias("non_finite"),
        F.coalesce(F.try_divide(F.sum(F.col("zero_fraction") * F.col("numel")), F.sum("numel")), F.lit(0.0)).alias("sparsity"),
        F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.try_divide(total, F.sum(finite)).alias("mean_value"), F.try_divide(squares, F.sum(finite)).alias("_squares"),
    )
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("_squares") - F.col("mean_value") * F.col("mean_value")))
    return sums.withColumn("std_value", F.when(F.col("_squares").isNotNull(), deviation)).drop("_squares")


def dtype_counts(values: DataFrame, key: str = "model_id") -> DataFrame:
    """(key, dtype, tensors, parameters) beside a model's totals, over values (key, tensor_name, dtype). Tensors are counted
    after their values are summed up, so a large one is no burden."""
    per_tensor = values.groupBy(key, "tensor_name", "dtype").agg(F.count("*").alias("_n"))
    return per_tensor.groupBy(key, "dtype").agg(F.count("*").alias("tensors"), F.sum("_n").alias("parameters"))


def parameter_verdict(stats: DataFrame, key: str = "model_id") -> DataFrame:
    """Per model the first that holds: non-finite values (HIGH, CRITICAL from 100), extreme ones (bounds of all values beyond
    1e4 or their deviation beyond 1e3; MEDIUM), a tensor of 1000 elements or more with zeros from 0.999 (LOW), NONE. The
    severity is the risk, and confidence is MODERATE for what may be intended."""
    sparse = stats.groupBy(key).agg(F.count_if((F.col("numel") >= 1000) & (F.col("zero_fraction") >= 0.999)).alias("sparse_tensors"))
    rows = parameter_totals(stats, key).join(sparse, key)
    extreme = F.coalesce((F.abs("min_value") > 1e4) | (F.abs("max_value") > 1e4) | (F.col("std_value") > 1e3), F.lit(False))
    bad = F.col("non_finite")
    risk = F.when(bad >= 100, "CRITICAL").when(bad > 0, "HIGH").when(extreme, "MEDIUM").when(F.col("sparse_tensors") > 0, "LOW").otherwise("NONE")
    confidence = F.when(F.col("risk").isin("MEDIUM", "LOW"), "MODERATE").otherwise("HIGH")
    rows = rows.withColumn("risk", risk)
    return rows.select(key, "parameters", "tensors", "non_finite", "sparse_tensors", "risk", F.nullif("risk", F.lit("NONE")).alias("severity"), confidence.alias("confidence"))


def activation_verdict(stats: DataFrame, key: str = "model_id", intermediate: bool = True) -> DataFrame:
    """Per model: any non-finite activation is HIGH; a layer dead (zeros from 0.98) on three probes or more that aren't the
    zero probe is MEDIUM. Confidence is MODERATE for dead layers and wherever only outputs were captured, not
    ``intermediate`` layers. ``stats``: model, layer_name, probe_name and the columns of ``value_statistics``."""
    dead = F.count_if((F.col("zero_fraction") >= 0.98) & (F.col("probe_name") != "zeros"))
    layers = stats.groupBy(key, "layer_name").agg(dead.alias("dead_probes"), F.sum(F.col("nan_count") + F.col("inf_count")).alias("bad"))
    sums = layers.groupBy(key).agg(F.count("*").alias("layers"), F.sum("bad").alias("non_finite"), F.count_if(F.col("dead_probes") >= 3).alias("dead_layers"))
    risk = F.when(F.col("non_finite") > 0, "HIGH").when(F.col("dead_layers") > 0, "MEDIUM").otherwise("NONE")
    sure = F.when((F.col("risk") == "MEDIUM") | F.lit(not intermediate), "MODERATE").otherwise("HIGH")
    return sums.withColumn("risk", risk).withColumn("confidence", sure)


def output_comparison(candidate: DataFrame, reference: DataFrame) -> DataFrame:
    """Per probe over long outputs (probe, idx, value): mse, max_diff and cosine (0 norms: 1 if all are close, else 0); a
    probe whose sizes differ is reported with nulls."""
    a = candidate.select("probe", "idx", F.col("value").alias("a"))
    b = reference.select("probe", "idx", F.col("value").alias("b"))
    sizes = a.groupBy("probe").agg(F.count("*").alias("na")).join(b.groupBy("probe").agg(F.count("*").alias("nb")), "probe")
    both = a.join(b, ["probe", "idx"])
    d = F.col("a") - F.col("b")
    sums = both.groupBy("probe").agg(
        F.avg(d * d).alias("mse"), F.max(F.abs(d)).alias("max_diff"), F.sum(F.col("a") * F.col("b")).alias("dot"),
        F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("norm_a"), F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("norm_b"),
        F.min(F.abs(d) <= 1e-8 + 1e-5 * F.abs("b")).alias("close"),
    )
    cosine = F.when((F.col("norm_a") == 0) | (F.col("norm_b") == 0), F.when(F.col("close"), 1.0).otherwise(0.0)).otherwise(F.col("dot") / (F.col("norm_a") * F.col("norm_b")))
    same = F.col("na") == F.col("nb")
    return sizes.join(sums, "probe", "left").select("probe", same.alias("same_shape"), *[F.when(same, x).alias(n) for n, x in (("mse", F.col("mse")), ("max_diff", F.col("max_diff")), ("cosine", cosine))])


def comparison_verdict(per_probe: DataFrame) -> DataFrame:
    """Mean mse and cosine, largest difference; equivalent if the mean mse is at most 1e-6, ``not_comparable`` where the sizes
    of a probe differ or there is no probe."""
    return per_probe.agg(
        F.avg("mse").alias("mean_mse"), F.max("max_diff").alias("max_diff"), F.avg("cosine").alias("mean_cosine"),
        F.when(~F.coalesce(F.min("same_shape"), F.lit(False)), "not_comparable").when(F.avg("mse") <= 1e-6, "equivalent").otherwise("divergent").alias("outcome"),
    )


def diversity(outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean L2 distance over pairs of probes within a key; 0 with fewer than two. ``outputs``: keys, probe, out (array).
    The probes of one model and perturbation are a small fixed battery."""
    a = outputs.select(*keys, F.col("probe").alias("pa"), F.col("out").alias("oa"))
    b = outputs.select(*keys, F.col("probe").alias("pb"), F.col("out").alias("ob"))
    squares = F.aggregate(F.zip_with("oa", "ob", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    pairs = a.join(b, keys).filter("pa < pb").groupBy(*keys).agg(F.avg(F.sqrt(squares)).alias("d"))
    return outputs.select(*keys).distinct().join(pairs, keys, "left").select(*keys, F.coalesce("d", F.lit(0.0)).alias("diversity"))


def convergence(clean_diversity: Column, perturbed_diversity: Column, shift: Column, control_shift: Column) -> tuple[Column, Column]:
    """The ratio div / (clean + 1e-7), and if it is suspicious: clean from 0.05, ratio under 0.15, and a shift above twice
    the larger of the control's and 0.01."""
    ratio = perturbed_diversity / (clean_diversity + 1e-7)
    return ratio, (clean_diversity >= 0.05) & (ratio < 0.15) & (shift > 2 * F.greatest(control_shift, F.lit(0.01)))


def quantiles(rows: DataFrame, key: str, value: str, shares: tuple[float, ...], between: bool = True) -> DataFrame:
    """(key, q0, q1, ...): exact quantiles of each key's non-null values, with linear interpolation between ranks, or
    (not ``between``) the least value that has at least the share of all at or below it.

    Equal values are counted first, then ranges of (key, value) are dealt over tasks; the ranges' totals, a row for each key
    in each, give every range its first rank. No task holds a key's values but those of its range.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    ranged = cut(counted.repartitionByRange("_k", "_v").withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_k", "_range").agg(F.sum("_n").alias("_s"))
    per_key = Window.partitionBy("_k")
    before = F.coalesce(F.sum("_s").over(per_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("_k").alias("_k2"), F.col("_range").alias("_range2"), before.alias("_before"), F.sum("_s").over(per_key).alias("_total"))
    placed = ranged.join(sums, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_range") == F.col("_range2")))
    within = Window.partitionBy("_k", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.select("_k", "_v", "_n", "_total", (F.col("_before") + F.sum("_n").over(within)).alias("_upto"))

    def at(rank):
        return F.max(F.when((F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto")), F.col("_v")))

    ranks = [F.lit(q) * (F.col("_total") - 1) if between else F.greatest(F.ceil(F.lit(q) * F.col("_total")) - 1, F.lit(0)) for q in shares]
    found = placed.groupBy("_k").agg(F.max("_total").alias("_total"), *[x for i, r in enumerate(ranks) for x in (at(F.floor(r)).alias(f"_lo{i}"), at(F.ceil(r)).alias(f"_hi{i}"))])
    values = [F.col(f"_lo{i}") + (r - F.floor(r)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}")) for i, r in enumerate(ranks)]
    return found.select(F.col("_k").alias(key), *[v.alias(f"q{i}") for i, v in enumerate(values)])


QUARTILES = (0.25, 0.5, 0.75)


def feature_profile(long: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Per feature of (feature, value): median and interquartile range (1 where that is 1e-4 or less), exact with linear
    interpolation; ``accuracy`` switches to sketches."""
    if accuracy is None:
        rows = quantiles(long, "feature", "value", QUARTILES)
    else:
        sketched = long.groupBy("feature").agg(F.percentile_approx("value", F.array(*map(F.lit, QUARTILES)), F.lit(accuracy)).alias("_q"))
        rows = sketched.select("feature", *[F.col("_q")[i].alias(f"q{i}") for i in range(3)])
    spread = F.col("q2") - F.col("q0")
    return rows.select("feature", F.col("q1").alias("median"), F.when(spread <= 1e-4, 1.0).otherwise(spread).alias("iqr"))


def _scored(long: DataFrame, profile: DataFrame) -> DataFrame:
    """(seq, feature, score): how many interquartile ranges a value lies from its feature's median."""
    return long.join(profile, "feature").select("seq", "feature", (F.abs(F.col("value") - F.col("median")) / F.col("iqr")).alias("score"))


def _distance() -> Column:
    return F.sqrt(F.sum(F.col("score") * F.col("score")))


def outside_shares(evaluated: DataFrame, profile: DataFrame, width: float = 3.0) -> DataFrame:
    """(feature, n_outside, share): per feature the values more than ``width`` interquartile ranges from the median."""
    out = F.col("score") > width
    return _scored(evaluated, profile).groupBy("feature").agg(F.count_if(out).alias("n_outside"), F.avg(out.cast("double")).alias("share"))


def drift(evaluated: DataFrame, reference: DataFrame, photometric: list[str]) -> DataFrame:
    """One row: overall shift (root mean square over features of |median difference| / reference IQR), the features above
    1.5, the share of samples with any feature outside median +- 3 IQR, the class of the shift, and the severity, risk and
    confidence that follow. Both: (seq, feature, value)."""
    profile = cut(feature_profile(reference))
    own = feature_profile(evaluated).select("feature", F.col("median").alias("_own"))
    shifts = own.join(profile, "feature").select("feature", (F.abs(F.col("_own") - F.col("median")) / F.col("iqr")).alias("shift"))
    overall = shifts.agg(F.sqrt(F.avg(F.col("shift") * F.col("shift"))).alias("overall_shift"), F.array_sort(F.collect_list(F.when(F.col("shift") > 1.5, F.col("feature")))).alias("affected"))
    outside = _scored(evaluated, profile).groupBy("seq").agg(F.max(F.col("score") > 3).alias("out"))
    rows = overall.join(outside.agg(F.avg(F.col("out").cast("double")).alias("outlier_share"), F.count_if("out").alias("n_outliers")))
    light = F.arrays_overlap("affected", F.array(*map(F.lit, photometric)))
    diffuse = (F.col("outlier_share") >= 0.4) | (light & (F.col("outlier_share") >= 0.25))
    kind = (
        F.when((F.col("overall_shift") <= 1) & (F.col("outlier_share") < 0.1), "CONFORMING_DISTRIBUTION")
        .when(diffuse, "OPERATIONAL_DRIFT_INDICATOR")
        .when(F.col("n_outliers") > 0, "SUSPICIOUS_ANOMALY_CLUSTER")
        .otherwise("DISTRIBUTION_SHIFT")
    )
    rows = rows.select("overall_shift", "affected", "outlier_share", "n_outliers", kind.alias("classification"))
    kind, shift = F.col("classification"), F.col("overall_shift")
    conforming, drifted, cluster = (kind == x for x in ("CONFORMING_DISTRIBUTION", "OPERATIONAL_DRIFT_INDICATOR", "SUSPICIOUS_ANOMALY_CLUSTER"))
    severity = F.when(drifted, F.when(shift > 2.5, "MEDIUM").otherwise("LOW")).when(cluster, F.when(shift > 3, "HIGH").otherwise("MEDIUM")).when(~conforming, "LOW")
    risk = F.when(conforming, "NONE").when(cluster | (drifted & (shift > 3)), "MEDIUM").otherwise("LOW")
    return rows.select("*", severity.alias("severity"), risk.alias("risk"), F.when(conforming | drifted, "HIGH").otherwise("MODERATE").alias("confidence"))


def reference_outliers(evaluated: DataFrame, reference: DataFrame, cap: int | None = 10, width: float = 3.0) -> DataFrame:
    """(seq, distance, dims): samples with a feature outside the reference's median +- ``width`` interquartile ranges, their
    robust distance from it and those features; the furthest ``cap``."""
    scored = _scored(evaluated, feature_profile(reference))
    rows = scored.groupBy("seq").agg(_distance().alias("distance"), F.array_sort(F.collect_list(F.when(F.col("score") > width, F.col("feature")))).alias("dims")).filter(F.size("dims") > 0)
    return rows if cap is None else rows.orderBy(F.desc("distance"), "seq").limit(cap)


def robust_outliers(long: DataFrame, cap: int | None = 15, accuracy: int | None = None) -> DataFrame:
    """(seq, distance, dims, severity): root of the sum over features of squared |value - median| / IQR, where above
    max(3.5, median + 3 * max(0.5, IQR)) of all distances; dims are features with a score above 2.8. The furthest ``cap``.
    """
    scored = _scored(long, feature_profile(long, accuracy))
    distances = cut(scored.groupBy("seq").agg(_distance().alias("distance"), F.array_sort(F.collect_list(F.when(F.col("score") > 2.8, F.col("feature")))).alias("dims")))
    all_of = quantiles(distances.withColumn("_all", F.lit(0)), "_all", "distance", QUARTILES)
    limit = all_of.select(F.greatest(F.lit(3.5), F.col("q1") + 3 * F.greatest(F.lit(0.5), F.col("q2") - F.col("q0"))).alias("threshold")).first()
    threshold = F.lit(limit["threshold"] if limit else float("inf"))
    out = distances.filter(F.col("distance") > threshold)
    out = out.select("seq", "distance", "dims", F.when(F.col("distance") > 1.5 * threshold, "MEDIUM").otherwise("LOW").alias("severity"))
    return out if cap is None else out.orderBy(F.desc("distance"), "seq").limit(cap)


def contributor_rates(samples: DataFrame, flagged: DataFrame) -> DataFrame:
    """Per contributor: total, flagged, rate, issues, anomalous, severity. ``samples``: sample_id, contributor (null:
    ``unattributed``, never anomalous); ``flagged``: sample_id, issue. Anomalous from two flagged and a rate of 0.3; HIGH
    from a rate of 0.5 and three flagged, else MEDIUM."""
    marks = flagged.groupBy("sample_id").agg(F.collect_set("issue").alias("issues"))
    rows = samples.select("sample_id", F.coalesce("contributor", F.lit("unattributed")).alias("contributor")).join(marks, "sample_id", "left")
    sums = rows.groupBy("contributor").agg(
        F.countDistinct("sample_id").alias("total"),
        F.countDistinct(F.when(F.col("issues").isNotNull(), F.col("sample_id"))).alias("flagged"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("issues")))).alias("issues"),
    )
    rate = F.col("flagged") / F.col("total")
    odd = (F.col("contributor") != "unattributed") & (F.col("flagged") >= 2) & (rate >= 0.3)
    return sums.select("*", rate.alias("rate"), odd.alias("anomalous"), F.when(odd, F.when((rate >= 0.5) & (F.col("flagged") >= 3), "HIGH").otherwise("MEDIUM")).alias("severity"))
