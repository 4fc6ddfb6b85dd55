"""The classifier of op6_mixing against a plain computation, over a whole table."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assaya.llm import mixing

SF = "/root/testdata/sf0.001"


def _binned(share):
    return min(mixing.BINS - 1, math.floor(math.sqrt(share or 0.0) * mixing.BINS))


def _features(text, lexicons):
    import regex

    text = text or ""
    words = [w for w in re.split(r"[ \t-\r]+", text.lower()) if w]
    share = lambda pattern: sum(len(m) for m in regex.findall(pattern, text)) / len(text) if text else None
    values = [_binned(share(r"[#*$%&|<>]")), _binned(share(r"\p{Lu}")), _binned(share(r"[!?]")), _binned(len(set(words)) / len(words) if words else None)]
    return len(words), [*values, *(min(mixing.BINS - 1, len(set(words) & set(v))) for v in lexicons.values())]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    marks = mixing.label_domains(spark.read.parquet(f"{SF}/labels.parquet")).filter("domain is not null").select(F.col("doc_id").alias("_id"), "domain")
    edge = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n\t "), (-4, "ÉA é!? #"), (-5, "x " * 500)], "_id long, _text string")
    return docs.union(edge), marks


def test_lexicons_features_and_posteriors(tables):
    docs, marks = tables
    texts, domain = ({r[0]: r[1] for r in df.collect()} for df in tables)
    found = mixing.lexicon(docs, marks, 8, 3)
    sizes, having = Counter(domain.values()), {d: Counter() for d in set(domain.values())}
    for i, d in domain.items():
        if i in texts:
            having[d].update({w for w in re.split(r"[ \t-\r]+", (texts[i] or "").lower()) if w})
    for d, listed in found.items():
        inside, outside = sizes[d], max(1, sum(sizes.values()) - sizes[d])

        def z(word):
            a, b = having[d][word], sum(having[o][word] for o in having if o != d)
            pooled = (a + b) / (inside + outside)
            spread = math.sqrt(pooled * (1 - pooled) * (1 / inside + 1 / outside))
            return (a / inside - b / outside) / spread if spread else -math.inf

        ranked = sorted(((-z(w), w) for w, n in having[d].items() if n >= 3 and z(w) > 4))
        assert listed == [w for _, w in ranked[:8]]
    lexicons = {d: found.get(d) or ["the", "and"] for d in ("clean", "low", "toxic")}
    rows = mixing.features(docs, lexicons).checkpoint()
    plain = {i: _features(t, lexicons) for i, t in texts.items()}
    assert {r["_id"]: (r["n_tokens"], list(r)[2:]) for r in rows.collect()} == plain
    domains = ["clean", "low", "toxic"]
    counts = {(d, f, b): 1 for d in domains for f in range(7) for b in range(mixing.BINS)}
    for i, d in domain.items():
        for f, b in enumerate(plain[i][1] if i in plain else []):
            counts[d, f, b] += 1
    total = lambda d, f: sum(counts[d, f, b] for b in range(mixing.BINS))
    for r in mixing.posteriors(rows, marks, domains).collect():
        scores = [math.log(total(d, 0) / sum(total(o, 0) for o in domains)) + sum(math.log(counts[d, f, b] / total(d, f)) for f, b in enumerate(plain[r["_id"]][1])) for d in domains]
        exps = [math.exp(s - max(scores)) for s in scores]
        assert r["p"] == pytest.approx([e / sum(exps) for e in exps], rel=1e-9)
