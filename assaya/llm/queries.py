"""The registered queries of this package, each over whole tables, and their SQL where SQL can say it."""

import os

from pyspark.sql import functions as F

from assaya.llm import alignment, ann, bpe_codec, language_id, mixing, near_dedup, periodic_runs, quality_rules, secret_scans, sentencepiece_codec, token_counts, url_filters, warc
from assaya.shared import table

#: Where the public vocabulary files lie; a library folder on every machine.
TOKENIZERS = os.environ.get("ASSAYA_TOKENIZERS", "/opt/tokenizers")


def op1_url_filters(spark, sf_dir):
    """A page's label is that of the document whose number ends its url's path."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(url_filters.path_of(F.col("url")), r"(\d{1,18})(?:\.[a-z]+)?/?$", 1).try_cast("long")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0).alias("good"))
    labelled = pages.select("url", number.alias("doc_id")).join(labels, "doc_id")
    return url_filters.judge(pages, labelled)


#: The split before the merges of the rank file, as its library publishes it.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def op2_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count(docs, f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken", SPLIT, eod=50256)


def op3_near_dedup(spark, sf_dir):
    return near_dedup.group(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.judge(docs, table(spark, sf_dir, "labels"))


def op5_secret_scans(spark, sf_dir):
    return secret_scans.digest(secret_scans.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = mixing.label_domains(table(spark, sf_dir, "labels"))
    return mixing.mix(docs, labels, {"clean": 0.9, "low": 0.06, "toxic": 0.04})


def op7_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"), least=0)


def op8_ann(spark, sf_dir):
    """Queries: the rows whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op9_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.round_trip(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


def op11_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")


def op12_periodic_runs(spark, sf_dir):
    """Runs in the documents' words, a tenth of the documents made periodic first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.digest(docs, text=periodic_runs.planted())


def op13_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_codec.round_trip(docs, f"{TOKENIZERS}/byte_bpe_50k.json")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_token_counts, op3_near_dedup, op4_quality_rules, op5_secret_scans, op6_mixing, op7_warc, op8_ann, op9_language_id, op10_sentencepiece, op11_alignment, op12_periodic_runs, op13_bpe, pipeline)}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLES = {
    "op3_near_dedup": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(r.root, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(r.root, s.doc_id)) AS kept FROM s LEFT JOIN roots r ON r.a = s.doc_id""",
    "op7_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages), m AS (SELECT h, max(page_id) AS last FROM p GROUP BY 1)
SELECT p.page_id, octet_length(encode(p.h))::BIGINT AS payload_bytes,
 array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, 1 + 5 * (j // 4), 5))::BIGINT >> (15 - 5 * (j % 4))) & 31), 1)), '') AS payload_digest,
 CASE WHEN p.page_id = m.last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id <> m.last THEN m.last END AS refers_to FROM p JOIN m USING (h)""",
}
