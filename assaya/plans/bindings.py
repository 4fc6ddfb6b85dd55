"""The logical tables of the checks, bound to the given ones: as DataFrames, and as DuckDB views for the SQL beside them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaya.functions.hashes import simhash
from assaya.operators.ledger import build_chain
from assaya.operators.ranges import running
from assaya.shared import cut, table


def samples(spark, sf_dir) -> DataFrame:
    """(seq, sha256, h, labels, class, contributor, file_size_bytes): documents, hashed by their tokens."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.array(F.concat(F.lit("q"), "quality"), F.concat(F.lit("t"), "toxic")).alias("labels"))
    rows = docs.select("doc_id", F.sha2("text", 256).alias("sha256"), "lang", "source", F.octet_length("text").alias("file_size_bytes"), "text")
    rows = simhash(rows, "text", ["doc_id", "sha256", "lang", "source", "file_size_bytes"]).join(labels, "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("seq"), "sha256", F.col("simhash").alias("h"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"),
        F.col("lang").alias("class"), F.col("source").alias("contributor"), "file_size_bytes",
    )


#: ``bits`` is the hash as 64 characters, the highest bit first.
HASHES_SQL = r"""
tok AS (SELECT DISTINCT doc_id, t FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '\s+')) AS t FROM documents) WHERE t <> ''),
tokh AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 16))::UBIGINT AS v FROM tok),
bitsum AS (SELECT doc_id, i, sum(CASE WHEN (v >> (63 - i)) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM tokh, (SELECT unnest(range(64))::UBIGINT AS i) GROUP BY doc_id, i),
hashes AS (SELECT doc_id, string_agg(CASE WHEN s > 0 THEN '1' ELSE '0' END, '' ORDER BY i) AS bits FROM bitsum GROUP BY doc_id),
samples AS (SELECT d.doc_id AS seq, sha256(d.text) AS sha256, h.bits, d.lang AS class, d.source AS contributor, octet_length(encode(d.text)) AS file_size_bytes,
  CASE WHEN l.doc_id IS NULL THEN [] ELSE ['q' || l.quality, 't' || l.toxic] END AS labels
  FROM documents d LEFT JOIN hashes h USING (doc_id) LEFT JOIN labels l USING (doc_id))"""


def patches(spark, sf_dir) -> DataFrame:
    """(location, seq, sha256, class, h, variance): a document's corners are its first and last line; the number of distinct
    tokens stands for the variance."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    lines = F.split("text", "\n")
    corner = lambda name, line: F.struct(F.lit(name).alias("location"), line.alias("line"))
    corners = F.explode(F.array(corner("first", F.get(lines, F.lit(0))), corner("last", F.element_at(lines, -1)))).alias("c")
    rows = docs.select("doc_id", F.sha2("text", 256).alias("sha256"), "lang", corners).select("doc_id", "sha256", "lang", "c.*")
    rows = rows.withColumn("variance", F.size(F.array_distinct(F.split("line", " "))).cast("double"))
    rows = simhash(rows, "line", ["doc_id", "location", "sha256", "lang", "variance"]).filter("simhash is not null")
    return rows.select("location", F.col("doc_id").alias("seq"), "sha256", F.col("lang").alias("class"), F.col("simhash").alias("h"), "variance")


PATCHES_SQL = r"""
lines AS (SELECT doc_id, sha256(text) AS sha256, lang, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
corners AS (SELECT doc_id, sha256, lang, 'first' AS location, ls[1] AS line FROM lines UNION ALL SELECT doc_id, sha256, lang, 'last', ls[-1] FROM lines),
ctok AS (SELECT DISTINCT doc_id, location, t FROM (SELECT doc_id, location, unnest(string_split_regex(lower(line), '\s+')) AS t FROM corners) WHERE t <> ''),
csum AS (SELECT doc_id, location, i, sum(CASE WHEN (v >> (63 - i)) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM (SELECT doc_id, location, ('0x' || substr(md5(t), 1, 16))::UBIGINT AS v FROM ctok), (SELECT unnest(range(64))::UBIGINT AS i) GROUP BY ALL),
cbits AS (SELECT doc_id, location, string_agg(CASE WHEN s > 0 THEN '1' ELSE '0' END, '' ORDER BY i) AS bits FROM csum GROUP BY ALL),
patches AS (SELECT location, doc_id AS seq, sha256, lang AS class, bits, len(list_distinct(string_split(line, ' ')))::DOUBLE AS variance FROM corners JOIN cbits USING (doc_id, location))"""


def features(spark, sf_dir) -> DataFrame:
    """(seq, lang, feature, value): six measures of a document's text."""
    docs = table(spark, sf_dir, "documents")
    n = F.greatest(F.length("text"), F.lit(1)).cast("double")
    share = lambda pattern: (F.length("text") - F.length(F.regexp_replace("text", pattern, ""))) / n
    values = {
        "n_chars": F.length("text").cast("double"),
        "bytes_per_char": F.octet_length("text") / n,
        "space_share": share(" "),
        "digit_share": share("[0-9]"),
        "upper_share": share("[A-Z]"),
        "line_share": share("\n"),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in values.items()])).alias("x")
    return docs.filter("text is not null").select(F.col("doc_id").alias("seq"), "lang", pairs).select("seq", "lang", "x.*")


FEATURES_SQL = r"""
wide AS (SELECT doc_id AS seq, lang, length(text)::DOUBLE AS n_chars, octet_length(encode(text)) / greatest(length(text), 1)::DOUBLE AS bytes_per_char,
  (length(text) - length(replace(text, ' ', ''))) / greatest(length(text), 1)::DOUBLE AS space_share,
  (length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) / greatest(length(text), 1)::DOUBLE AS digit_share,
  (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) / greatest(length(text), 1)::DOUBLE AS upper_share,
  (length(text) - length(replace(text, chr(10), ''))) / greatest(length(text), 1)::DOUBLE AS line_share FROM documents WHERE text IS NOT NULL),
features AS (UNPIVOT wide ON n_chars, bytes_per_char, space_share, digit_share, upper_share, line_share INTO NAME feature VALUE value)"""


def manifests(spark, sf_dir) -> DataFrame:
    """(manifest_id, stream, arrival, nonce, sequence, three digests): events; ``error`` events aren't numbered, so their
    neighbours show gaps."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "props")
    rows = running(events, ["user_id"], ["ts", "event_id"], sums={"_before": F.lit(1).cast("long")}).withColumn("_n", F.col("_before") + 1)
    return rows.filter("event_type <> 'error'").select(
        F.col("event_id").alias("manifest_id"), F.col("user_id").alias("stream"), F.struct("ts", "event_id").alias("arrival"),
        F.md5(F.concat_ws("|", "user_id", "props")).alias("nonce"), F.col("_n").cast("long").alias("sequence"),
        F.sha2(F.col("props"), 256).alias("input_sha256"), F.sha2(F.col("event_type"), 256).alias("model_sha256"), F.sha2(F.concat_ws("|", "event_type", "props"), 256).alias("output_sha256"),
    )


MANIFESTS_SQL = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
manifests AS (SELECT event_id AS manifest_id, user_id AS stream, ts, event_id, md5(concat_ws('|', user_id, props)) AS nonce, n AS sequence,
  sha256(props) AS input_sha256, sha256(event_type) AS model_sha256, sha256(concat_ws('|', event_type, props)) AS output_sha256
  FROM numbered WHERE event_type <> 'error')"""


def artifacts(spark, sf_dir, rows: DataFrame | None = None) -> DataFrame:
    """What was found for each manifest, of ``rows`` if they are at hand: every 11th input differs, every 13th output wasn't
    there."""
    rows = manifests(spark, sf_dir) if rows is None else rows
    return rows.select(
        "manifest_id",
        F.when(F.col("manifest_id") % 11 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("input_sha256")).alias("input_sha256"),
        "model_sha256",
        F.when(F.col("manifest_id") % 13 != 0, F.col("output_sha256")).alias("output_sha256"),
    )


def audit_events(spark, sf_dir) -> DataFrame:
    """A chain for each user of events: built, then tampered with where the event id is a multiple of 97."""
    events = table(spark, sf_dir, "events")
    rows = events.select(
        F.col("user_id").cast("string").alias("chain_id"), F.struct("ts", "event_id").alias("position"), F.lit("service").alias("actor"),
        F.col("user_id").cast("string").alias("assessment_id"), F.col("event_id").cast("string").alias("event_id"), "event_type",
        F.sha2("props", 256).alias("payload_digest"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp_utc"),
    )
    chained = build_chain(rows)
    payloads = events.select(F.col("event_id").cast("string").alias("event_id"), F.col("props").alias("payload"))
    tampered = F.col("event_id").cast("long") % 97 == 0
    rows = chained.join(payloads, "event_id")
    return rows.withColumn("actor", F.when(tampered, "intruder").otherwise(F.col("actor"))).withColumn(
        "payload", F.when(F.col("event_id").cast("long") % 89 == 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))
    )


def tensors(spark, sf_dir) -> DataFrame:
    """(model_id, tensor_name, value): numbers of lineitem, with the zeros of a rounded discount."""
    items = table(spark, sf_dir, "lineitem")
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("tensor_name"), F.col(c).cast("double").alias("value")) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])).alias("x")
    return items.select(F.concat("l_returnflag", "l_linestatus").alias("model_id"), named).select("model_id", "x.*")


TENSORS_SQL = """
tensors AS (SELECT l_returnflag || l_linestatus AS model_id, tensor_name, value FROM
  (UNPIVOT (SELECT l_returnflag, l_linestatus, l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax FROM lineitem)
   ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME tensor_name VALUE value))"""


def outputs(spark, sf_dir) -> DataFrame:
    """(model, perturbation, probe, out): embeddings; a block of 64 ids is a model, its 16 ids of one remainder the probes of
    a perturbation, 0 being clean and 1 the control."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(
        F.floor(F.col("vec_id") / 64).alias("model"), (F.col("vec_id") % 4).alias("perturbation"), F.floor((F.col("vec_id") % 64) / 4).alias("probe"),
        F.transform("embedding", lambda v: v.cast("double")).alias("out"),
    )


OUTPUTS_SQL = "outputs AS (SELECT vec_id // 64 AS model, vec_id % 4 AS perturbation, (vec_id % 64) // 4 AS probe, embedding::DOUBLE[] AS out FROM embeddings)"
