"""Search, facets, listings and the join of results to a fixed battery."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaya.functions.text import escape_like
from assaya.operators.verdicts import ordinal

#: The battery in its order.
BATTERY = ("DI-01", "DI-02", "DI-03", "DI-04", "DI-05", "MI-01", "MI-02", "MI-03", "MI-04", "MI-05", "PI-01")


def term_of(raw: str) -> str:
    """The term as searched: NULs out, trimmed, 200 characters at most."""
    return raw.replace("\0", "").strip()[:200]


def contains_any(columns: list[Column], raw: str) -> Column:
    """A case-insensitive LIKE over any of the columns; a blank term matches nothing."""
    term = term_of(raw)
    if not term:
        return F.lit(False)
    pattern = F.concat(F.lit("%"), escape_like(F.lower(F.lit(term))), F.lit("%"))
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.like(F.lower(c), pattern, F.lit("\\")), F.lit(False))
    return out


def newest(rows: DataFrame, category: str, order: str, limit: int, columns: list[str], most: int = 30) -> DataFrame:
    """The newest ``limit`` rows, 1 to ``most``, of one category; a distributed top-k."""
    limit = max(1, min(most, limit))
    return rows.orderBy(F.desc(order), columns[0]).limit(limit).select(F.lit(category).alias("category"), *columns)


def facet(rows: DataFrame, wanted: dict[str, str | None]) -> DataFrame:
    """Rows that agree with each facet given; null and ``all`` ask nothing."""
    for column, value in wanted.items():
        if value not in (None, "", "all"):
            rows = rows.filter(F.col(column) == value)
    return rows


def assessment_facets(rows: DataFrame, term: str = "", risk: str = "all", status: str = "all") -> DataFrame:
    """Assessments (title, assessment_id, status, overall_risk, ...) whose title, id or status has the term, in any case, and
    whose risk (none where there is none) and status are the wanted ones; a blank term and ``all`` ask nothing."""
    if term_of(term):
        rows = rows.filter(contains_any([F.col("title"), F.col("assessment_id").cast("string"), F.col("status")], term))
    if risk != "all":
        rows = rows.filter(F.coalesce(F.nullif(F.lower("overall_risk"), F.lit("")), F.lit("none")) == risk)
    return rows if status == "all" else rows.filter(F.lower("status") == status)


def keyed(rows: DataFrame, key: dict, order: list) -> DataFrame:
    """The rows with these values, in order; a null value asks for null. Filters on them reach the files."""
    for column, value in key.items():
        rows = rows.filter(F.col(column).eqNullSafe(F.lit(value)))
    return rows.orderBy(*order)


def run_facets(findings: DataFrame, runs: DataFrame, wanted: dict[str, str | None], key: str = "assessment_id") -> DataFrame:
    """Findings whose check's run has the wanted ``risk``, ``confidence`` and ``status``, in any case; null and ``all`` ask
    nothing. A finding without a run counts as risk none, confidence low and an empty status. ``runs``: key, detector_id,
    risk_level, confidence_level, status; a run is its check's also where that is written in capitals."""
    found = runs.select(key, F.upper("detector_id").alias("_code"), F.lower("risk_level").alias("_r"), F.lower("confidence_level").alias("_c"), F.lower("status").alias("_s"))
    rows = findings.join(found, (findings[key] == found[key]) & (F.upper("detector_id") == F.col("_code")), "left").drop(found[key])
    of = {"risk": F.coalesce("_r", F.lit("none")), "confidence": F.coalesce("_c", F.lit("low")), "status": F.coalesce("_s", F.lit(""))}
    for facet_of, value in wanted.items():
        if value not in (None, "", "all"):
            rows = rows.filter(of[facet_of] == value.lower())
    return rows.select(*findings.columns)


#: The assurance layers in the order in which they are shown.
LAYERS = ("data_integrity", "model_integrity", "inference_provenance", "audit_integrity")


def layer(category: Column, detector: Column) -> Column:
    """The assurance layer: model, then provenance, then audit, by a word in category or detector or by how the detector
    begins; else data."""
    c, d = F.lower(F.coalesce(category, F.lit(""))), F.lower(F.coalesce(detector, F.lit("")))
    return (
        F.when(c.contains("model") | d.contains("model") | d.startswith("mi"), LAYERS[1])
        .when(c.contains("provenance") | c.contains("inference") | d.contains("provenance") | d.contains("inference") | d.startswith("pi"), LAYERS[2])
        .when(c.contains("audit") | c.contains("ledger") | d.contains("audit") | d.startswith("at"), LAYERS[3])
        .otherwise(LAYERS[0])
    )


def layer_order(layer: Column) -> Column:
    """The place of a layer among all."""
    return F.array_position(F.array(*map(F.lit, LAYERS)), layer)


def detector_code(detector: Column) -> Column:
    """The short code in an id or code, such as ``DI-01`` for ``di1`` or ``data.integrity.di01_duplicates``; without one the
    id in upper case; ``UNKNOWN`` for null or empty."""
    pattern = r"(?i)(di|mi|pi|ai)0?(\d+)"
    number = F.regexp_extract(detector, pattern, 2)
    padded = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
    code = F.concat_ws("-", F.upper(F.regexp_extract(detector, pattern, 1)), padded)
    return F.when(F.coalesce(detector, F.lit("")) == "", "UNKNOWN").when(detector.rlike(pattern), code).otherwise(F.upper(detector))


def by_code(term: str, detectors: dict[str, str]) -> str | None:
    """The detector id that a typed code means, with or without its hyphen and spaces, in either case. ``detectors``: id to
    code."""
    known = {code.lower(): i for i, code in detectors.items()} | {code.lower().replace("-", ""): i for i, code in detectors.items()}
    low = term_of(term).lower()
    return known.get(low) or known.get(low.replace("-", "").replace(" ", ""))


def finding_matches(columns: list[Column], detector: Column, raw: str, detectors: dict[str, str]) -> Column:
    """A search over findings: the term in any of the columns or, in the detector's id, without hyphens and spaces, or the
    id that the term is the code of."""
    out = contains_any([*columns, detector], raw)
    plain, meant = term_of(raw).replace("-", "").replace(" ", ""), by_code(raw, detectors)
    return out | contains_any([detector], plain) | (contains_any([detector], meant) if meant else F.lit(False))


def grouped(findings: DataFrame, by: str, order: Column) -> DataFrame:
    """Counts by a column in a fixed order; groups without rows don't appear."""
    return findings.groupBy(by).agg(F.count("*").alias("n"), F.max(ordinal(F.col("severity"))).alias("worst"), F.min(order).alias("_o")).orderBy("_o").drop("_o")


def battery_status(results: DataFrame, key: str = "assessment_id") -> DataFrame:
    """Per assessment and check of the battery: its status, or ``NOT_RUN``."""
    spark = results.sparkSession
    checks = spark.createDataFrame([(i, code) for i, code in enumerate(BATTERY)], "position int, code string")
    every = results.select(key).distinct().join(F.broadcast(checks))
    return every.join(results.select(key, "code", "status"), [key, "code"], "left").select(key, "position", "code", F.coalesce("status", F.lit("NOT_RUN")).alias("status"))
