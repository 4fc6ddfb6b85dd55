"""Evidence payloads and what they refer to; applicability, listings and scores."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The shapes of a payload in which samples are shown, in the order in which they are tried.
SHAPES = ("sample_ids", "file_names", "affected_samples", "sample_id")


def _items(payload: Column, key: str) -> Column:
    """The elements of a list, as variants; none where the key holds anything else."""
    return F.coalesce(F.try_variant_get(payload, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))


def _text(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "string")


def referenced(data_json: Column) -> Column:
    """The distinct sample ids that a payload names, in the order of its shapes: all of ``sample_ids``, ``sample_id``, and
    those inside the objects ``sample_1``, ``sample_2`` and of ``affected_samples``. Ids may be strings or numbers; a payload
    that isn't JSON names none."""
    p = F.try_parse_json(data_json)
    single = F.array(_text(p, "$.sample_id"), _text(p, "$.sample_1.sample_id"), _text(p, "$.sample_2.sample_id"))
    listed = F.transform(_items(p, "sample_ids"), lambda x: _text(x))
    affected = F.transform(_items(p, "affected_samples"), lambda x: _text(x, "$.sample_id"))
    return F.array_distinct(F.array_compact(F.concat(listed, single, affected)))


def shown(data_json: Column, most: int = 8) -> Column:
    """What a payload offers to show, ``most`` of each shape, in order: (shape, position, id, file). ``file_names`` has names
    only, ``sample_id`` counts if it is a string, and an affected sample may have both an id and a name."""
    p = F.try_parse_json(data_json)

    def offers(shape: int, items: Column, sample, file) -> Column:
        row = lambda x, i: F.struct(F.lit(shape).alias("shape"), i.alias("position"), sample(x).alias("id"), file(x).alias("file"))
        return F.transform(F.slice(items, 1, most), row)

    none = lambda x: F.lit(None).cast("string")
    own = F.try_variant_get(p, "$.sample_id", "variant")
    alone = F.when(F.schema_of_variant(own) == "STRING", F.array(own)).otherwise(F.array().cast("array<variant>"))
    return F.concat(
        offers(0, _items(p, "sample_ids"), _text, none),
        offers(1, _items(p, "file_names"), none, _text),
        offers(2, _items(p, "affected_samples"), lambda x: F.nullif(_text(x, "$.sample_id"), F.lit("")), lambda x: _text(x, "$.file_name")),
        offers(3, alone, _text, none),
    )


def shown_samples(evidence: DataFrame, samples: DataFrame, most: int = 8) -> DataFrame:
    """(evidence_id, shape, position, sample_id): the samples that each piece of evidence shows, in order. They are those of
    the first shape of which any is found: by id or, failing that, by file name in the evidence's dataset (the least such
    id). ``evidence``: evidence_id, dataset_id, data_json; ``samples``: sample_id, dataset_id, file_name."""
    offers = evidence.select("evidence_id", "dataset_id", F.inline(F.coalesce(shown(F.col("data_json"), most), F.array().cast("array<struct<shape:int,position:int,id:string,file:string>>"))))
    by_id = samples.select(F.col("sample_id").alias("_id")).distinct()
    by_file = samples.groupBy(F.col("dataset_id").alias("_d"), F.col("file_name").alias("_f")).agg(F.min("sample_id").alias("_file_id"))
    rows = offers.join(by_id, F.col("id") == F.col("_id"), "left").join(by_file, (F.col("dataset_id") == F.col("_d")) & (F.col("file") == F.col("_f")), "left")
    found = rows.select("evidence_id", "shape", "position", F.coalesce("_id", "_file_id").alias("sample_id")).filter("sample_id is not null")
    first = F.min("shape").over(Window.partitionBy("evidence_id"))  # a piece of evidence has few offers
    names = F.array(*map(F.lit, SHAPES))
    return found.withColumn("_first", first).filter("shape = _first").select("evidence_id", F.get(names, "shape").alias("shape"), "position", "sample_id")


def evidence_of(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence (finding_id, seq, ...) of findings (finding_id, created_at), the oldest finding's first, each in its order."""
    rows = evidence.join(findings.select("finding_id", "created_at"), "finding_id")
    return rows.orderBy("created_at", "finding_id", "seq")


def flagged_samples(evidence: DataFrame, samples: DataFrame, own: str = "DI-05") -> DataFrame:
    """(sample_id, issue) of samples that evidence of other checks refers to, each pair once."""
    refs = evidence.filter(F.col("detector_id") != own).select(F.explode(referenced(F.col("data_json"))).alias("sample_id"), F.col("detector_id").alias("issue"))
    return refs.join(samples.select("sample_id"), "sample_id", "left_semi").distinct()


#: What each check needs at least, and the reason where it isn't there.
NEEDS = (
    ("DI-01", "n_samples", 1, "no samples"),
    ("DI-02", "n_labelled", 2, "fewer than 2 labelled samples"),
    ("DI-03", "n_samples", 3, "fewer than 3 samples"),
    ("DI-04", "n_samples", 5, "fewer than 5 samples"),
    ("DI-05", "n_contributors", 1, "no contributor"),
)


def applicability(counts: DataFrame, key: str) -> DataFrame:
    """Per dataset and check over its counts: applicable, and the reason where not."""
    rows = F.array(*[F.struct(F.lit(code).alias("code"), (F.col(what) >= least).alias("applicable"), F.when(F.col(what) < least, reason).alias("reason")) for code, what, least, reason in NEEDS])
    return counts.select(key, F.explode(rows).alias("x")).select(key, "x.*")


def scenario_scores(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per scenario: passed if every expected finding is there and none beyond those expected or ``allowed``.
    ``expected``: scenario, detector, expected, allowed; ``actual``: scenario, detector, found."""
    rows = expected.join(actual, ["scenario", "detector"], "left").select("scenario", "expected", "allowed", F.coalesce("found", F.lit(False)).alias("found"))
    right = F.when(F.col("expected"), F.col("found")).otherwise(~F.col("found") | F.col("allowed"))
    return rows.groupBy("scenario").agg(F.bool_and(right).alias("passed"), F.count_if(~right).alias("wrong"))


def listing(assessments: DataFrame, findings: DataFrame, evidence: DataFrame, events: DataFrame, limit: int | None = None) -> DataFrame:
    """Assessments, newest first, with counts of findings and evidence and the risk of their last completion event, else
    that of their severities (critical or high HIGH, medium MEDIUM, else NONE)."""
    n_findings = findings.groupBy("assessment_id").agg(F.count("*").alias("n_findings"), F.max(F.when(F.col("severity").isin("CRITICAL", "HIGH"), 2).when(F.col("severity") == "MEDIUM", 1).otherwise(0)).alias("_s"))
    n_evidence = evidence.groupBy("assessment_id").agg(F.count("*").alias("n_evidence"))
    last = events.filter(F.col("event_type").isin("completed", "failed")).groupBy("assessment_id").agg(F.max_by("risk", "seq").alias("_r"))
    rows = assessments.join(n_findings, "assessment_id", "left").join(n_evidence, "assessment_id", "left").join(last, "assessment_id", "left")
    derived = F.when(F.col("_s") == 2, "HIGH").when(F.col("_s") == 1, "MEDIUM").otherwise("NONE")
    rows = rows.select("assessment_id", "created_at", F.coalesce("n_findings", F.lit(0)).alias("n_findings"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.coalesce("_r", derived).alias("risk"))
    rows = rows.orderBy(F.desc("created_at"), "assessment_id")
    return rows if limit is None else rows.limit(limit)
