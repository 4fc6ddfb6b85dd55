"""Annotation files and sidecars: readers and integrity rules, one row for each violation."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

COCO = (
    "info struct<contributor:string>, images array<struct<id:bigint,file_name:string,width:bigint,height:bigint,contributor:string,source:string,user_id:string,annotator:string>>, "
    "categories array<struct<id:bigint,name:string>>, annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>>>"
)


def read_coco(spark: SparkSession, path: str, skip: bool = False) -> dict[str, DataFrame]:
    """``images``, ``categories`` and ``annotations`` of COCO files, each with its ``file``, and ``errors`` (file, code): a file
    that isn't JSON (``not_json``) or has a field of another type (``bad_field``). Fails closed: without ``skip`` the first
    error raises; with it such files give no rows."""
    read = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True)
    return _coco_frames(read.schema(f"{COCO}, _corrupt string").json(path).withColumn("file", F.col("_metadata.file_path")), skip)


def coco_documents(documents: DataFrame, content: str = "value", skip: bool = False) -> dict[str, DataFrame]:
    """As ``read_coco``, of COCO files that are kept as texts (file, ``content``) of a table, as very many small ones are: a
    file of its own, and a folder, cost each more than its reading. A null or blank text is ``not_json``."""
    parsed = F.from_json(content, f"{COCO}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = documents.select("file", F.when(F.trim(content) != "", parsed).alias("x"))
    fields = [F.col(f"x.{c}").alias(c) for c in ("info", "images", "categories", "annotations")]
    return _coco_frames(rows.select("file", *fields, F.when(F.col("x").isNull(), "").otherwise(F.col("x._corrupt")).alias("_corrupt")), skip)


def _coco_frames(every: DataFrame, skip: bool) -> dict[str, DataFrame]:
    code = F.when(F.col("_corrupt").isNotNull(), F.when(F.col("images").isNull() & F.col("annotations").isNull() & F.col("categories").isNull(), "not_json").otherwise("bad_field"))
    raw, errors = split_valid(every.withColumn("code", code), "code", skip)
    image = raw.select("file", F.col("info.contributor").alias("_info"), F.explode("images").alias("x")).select("file", "_info", "x.*")
    first = [F.nullif(F.trim(c), F.lit("")) for c in ("contributor", "source", "user_id", "annotator", "_info")]
    return {
        "images": image.select("file", "id", "file_name", "width", "height", F.coalesce(*first).alias("contributor")),
        "categories": raw.select("file", F.explode("categories").alias("x")).select("file", "x.*"),
        "annotations": raw.select("file", F.explode("annotations").alias("x")).select("file", "x.*"),
        "errors": errors.select("file", "code"),
    }


def coco_violations(images: DataFrame, categories: DataFrame, annotations: DataFrame) -> DataFrame:
    """(code, ref): duplicate ids, unknown references, boxes that aren't 4 numbers from 0 with a positive size, blank names.
    ``ref`` is the id; null ids are ``not_integer``."""
    twice = lambda df, code: df.groupBy("id").count().filter("count > 1 and id is not null").select(F.lit(code).alias("code"), F.col("id").alias("ref"))
    where = lambda df, cond, code: df.filter(cond).select(F.lit(code).alias("code"), F.col("id").alias("ref"))
    box = F.col("bbox")
    bad_box = box.isNotNull() & ((F.size(box) != 4) | F.exists(box, lambda v: v.isNull() | (v < 0)) | (F.get(box, F.lit(2)) <= 0) | (F.get(box, F.lit(3)) <= 0))
    ids = lambda df, name: df.select(F.col("id").alias(name)).distinct()
    parts = [
        twice(images, "duplicate_image"),
        twice(categories, "duplicate_category"),
        where(images, "id is null", "not_integer"),
        where(categories, "trim(coalesce(name, '')) = ''", "blank_name"),
        where(annotations.filter("image_id is not null").join(ids(images, "image_id"), "image_id", "left_anti"), F.lit(True), "unknown_image"),
        where(annotations.filter("category_id is not null").join(ids(categories, "category_id"), "category_id", "left_anti"), F.lit(True), "unknown_category"),
        where(annotations, bad_box, "bad_box"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def missing_keys(documents: DataFrame, content: str = "value") -> DataFrame:
    """(file, code, key) over annotation files as texts (file, ``content``): ``not_json``, or ``missing_key`` for each of the
    three lists that isn't there, and ``not_a_list`` where it is something else."""
    keys = ("images", "annotations", "categories")
    parsed = F.try_parse_json(content)
    of = lambda k: F.try_variant_get(parsed, f"$.{k}", "variant")
    code = lambda k: F.when(of(k).isNull(), "missing_key").when(~F.schema_of_variant(of(k)).startswith("ARRAY"), "not_a_list")
    found = F.array(*[F.struct(code(k).alias("code"), F.lit(k).alias("key")) for k in keys])
    rows = F.when(parsed.isNull(), F.array(F.struct(F.lit("not_json").alias("code"), F.lit(None).cast("string").alias("key")))).otherwise(found)
    return documents.select("file", F.explode(rows).alias("x")).select("file", "x.*").filter("code is not null")


def coco_labels(images: DataFrame, categories: DataFrame, annotations: DataFrame) -> DataFrame:
    """(id, labels): each image's category names without repeats, in the order of its annotations' ids."""
    named = annotations.join(categories.select(F.col("id").alias("category_id"), "name"), "category_id")
    ordered = named.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("l"))
    labels = ordered.select(F.col("image_id").alias("id"), F.array_distinct(F.transform("l", lambda x: x["name"])).alias("labels"))
    return images.select("id").join(labels, "id", "left").select("id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def yolo_code(line: Column, n_classes: Column | None = None) -> Column:
    """The rule that a label line breaks: ``too_few_tokens``, ``bad_class``, ``negative_class``, ``unknown_class``,
    ``bad_number``, ``not_finite``, ``centre_out_of_bounds``, ``size_out_of_bounds``; null for a good, blank or ``#``
    line."""
    t = F.split(F.trim(line), r"\s+")
    at = lambda i: F.get(t, F.lit(i))
    cls = F.when(at(0).rlike(r"^[+-]?\d{1,18}$"), at(0).try_cast("long"))
    nums = [at(i) for i in range(1, 5)]
    number = r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"
    odd = r"(?i)^[+-]?(nan|inf|infinity)$"
    v = [F.when(x.rlike(number), x.try_cast("double")) for x in nums]
    any_of = lambda f: f(nums[0]) | f(nums[1]) | f(nums[2]) | f(nums[3])
    out = (
        F.when((F.trim(line) == "") | F.trim(line).startswith("#"), F.lit(None))
        .when(F.size(t) < 5, "too_few_tokens")
        .when(cls.isNull(), "bad_class")
        .when(cls < 0, "negative_class")
    )
    if n_classes is not None:
        out = out.when((n_classes > 0) & (cls >= n_classes), "unknown_class")
    return (
        out.when(any_of(lambda x: ~x.rlike(number) & ~x.rlike(odd)), "bad_number")
        .when(any_of(lambda x: x.rlike(odd)), "not_finite")
        .when(~v[0].between(0, 1) | ~v[1].between(0, 1), "centre_out_of_bounds")
        .when((v[2] <= 0) | (v[2] > 1) | (v[3] <= 0) | (v[3] > 1), "size_out_of_bounds")
    )


def read_yolo(spark: SparkSession, labels_path: str) -> DataFrame:
    """(stem, line_no, line) of label files; Spark reads them whole, as a file is at most 10 MB by rule."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(labels_path, wholetext=True)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1)
    return raw.select(stem.alias("stem"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def class_names(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(stem, labels): each label file's distinct class names in order. ``labels``: stem, class_no; ``names``: class_no, name,
    as ``read_class_names`` gives; a number without a name is ``class_<number>``."""
    named = labels.join(names, "class_no", "left").select("stem", F.coalesce("name", F.concat(F.lit("class_"), "class_no")).alias("name"))
    return named.groupBy("stem").agg(F.array_sort(F.collect_set("name")).alias("labels"))


def read_class_names(spark: SparkSession, path: str) -> DataFrame:
    """(class_no, name) of a ``classes.txt``: its lines that aren't blank, numbered from 0."""
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.transform(F.split("value", r"\r?\n"), F.trim), lambda x: x != "").alias("l"))
    return lines.select(F.posexplode("l").alias("class_no", "name")).withColumn("class_no", F.col("class_no").cast("long"))


def sidecar_records(documents: DataFrame, content: str = "value") -> DataFrame:
    """(file_name, precedence, contributor, labels) of sidecars as texts (precedence, ``content``): maps ``contributors`` and
    ``labels`` (one or a list) by file, records in ``samples`` or ``images``; without any of them the document is a map from
    file to contributor. What isn't JSON gives nothing."""
    text = F.col(content)
    of = lambda k: F.get_json_object(text, f"$.{k}")
    strings, lists = "map<string,string>", F.array().cast("array<string>")
    as_list = lambda v: F.when(v.startswith("["), F.from_json(v, "array<string>")).when(F.trim(v) != "", F.array(v))
    record = lambda name, who, labels: F.struct(name.alias("file_name"), who.alias("contributor"), F.coalesce(labels, lists).alias("labels"))
    none = F.lit(None).cast("string")
    entries = lambda k, make: F.transform(F.map_entries(F.coalesce(F.from_json(of(k), strings), F.create_map().cast(strings))), make)
    one = "array<struct<file_name:string,contributor:string,source:string,label:string,labels:string>>"
    listed = F.transform(
        F.concat(*[F.coalesce(F.from_json(of(k), one), F.array().cast(one)) for k in ("samples", "images")]),
        lambda r: record(r["file_name"], F.coalesce(r["contributor"], r["source"]), F.coalesce(as_list(r["labels"]), as_list(r["label"]))),
    )
    shaped = F.concat(entries("contributors", lambda e: record(e["key"], e["value"], lists)), entries("labels", lambda e: record(e["key"], none, as_list(e["value"]))), listed)
    flat = F.transform(F.map_entries(F.coalesce(F.from_json(text, strings), F.create_map().cast(strings))), lambda e: record(e["key"], e["value"], lists))
    plain = F.greatest(*[of(k).isNotNull().cast("int") for k in ("contributors", "labels", "samples", "images")]) == 0
    rows = documents.select("precedence", F.explode(F.when(plain, flat).otherwise(shaped)).alias("x")).select("x.file_name", "precedence", "x.contributor", "x.labels")
    return rows.filter("file_name is not null")


#: Parts of a store of samples that its datasets are dealt to. Datasets can be many and small: a folder for each, and in it
#: a file from every task, is as many files as samples.
PARTS = 64


def append_samples(rows: DataFrame, path: str, dataset: str = "dataset_id") -> None:
    """Adds samples to the store in ``path``, a folder ``part=..`` for each of ``PARTS`` parts of the datasets. A part is
    written by one task, or by some if it is large, and sorted, so that a dataset's rows lie together."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(dataset), F.lit(PARTS)).cast("int")).hint("rebalance", "part")
    dealt.sortWithinPartitions("part", dataset).write.mode("append").partitionBy("part").parquet(path)


def read_samples(spark: SparkSession, path: str, schema: StructType | str, dataset: str = "dataset_id", only: Column | None = None) -> DataFrame:
    """The samples of the store in ``path``; of the one dataset ``only``, its part alone is read."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = spark.read.schema(StructType([*schema, StructField("part", IntegerType())])).parquet(path)
    if only is not None:
        only = only.cast(schema[dataset].dataType)
        rows = rows.filter((F.col("part") == F.pmod(F.xxhash64(only), F.lit(PARTS))) & F.col(dataset).eqNullSafe(only))
    return rows.drop("part")


def merge_sidecars(records: DataFrame) -> DataFrame:
    """(file_name, contributor, labels) from rows (file_name, precedence, contributor, labels): of each field the value of
    the highest precedence that has one; blank contributors count as none."""
    who = F.nullif(F.trim("contributor"), F.lit(""))
    return records.groupBy("file_name").agg(
        F.max_by(who, F.when(who.isNotNull(), F.col("precedence"))).alias("contributor"),
        F.max_by("labels", F.when(F.size("labels") > 0, F.col("precedence"))).alias("labels"),
    )


def contributor_of(sidecar: Column, relative_path: Column, known: list[Column] = ()) -> Column:
    """The sidecar's, else the first of ``known`` that isn't blank, else the first folder of the path, if it has one."""
    parts = F.split(relative_path, "/")
    folder = F.when(F.size(parts) > 1, F.get(parts, F.lit(0)))
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (sidecar, *known, folder)])


def split_valid(rows: DataFrame, code: str, skip: bool = False) -> tuple[DataFrame, DataFrame]:
    """Valid rows and errors. Fails closed: without ``skip`` any error raises."""
    valid, errors = rows.filter(F.col(code).isNull()).drop(code), rows.filter(F.col(code).isNotNull())
    if not skip and (first := errors.limit(1).collect()):
        raise ValueError(f"invalid record: {first[0].asDict()}")
    return valid, errors


def ingestion_summary(rows: DataFrame, key: str, code: str) -> DataFrame:
    """Per dataset: ingested, skipped, and the codes seen."""
    return rows.groupBy(key).agg(F.count_if(F.col(code).isNull()).alias("ingested"), F.count_if(F.col(code).isNotNull()).alias("skipped"), F.array_sort(F.collect_set(code)).alias("codes"))


def new_contents(incoming: DataFrame, stored: DataFrame, digest: str = "sha256") -> DataFrame:
    """Each digest once, of those not stored yet, with the prefix that partitions the store."""
    fresh = incoming.dropDuplicates([digest]).join(stored.select(digest), digest, "left_anti")
    return fresh.withColumn("prefix", F.substring(digest, 1, 2))
