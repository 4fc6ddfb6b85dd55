"""Cross-tokenizer alignment against a plain walk over both token lists."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaya.llm import alignment
from assaya.llm.queries import QUERIES, TOKENIZERS

A, B, SF = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model", "/root/testdata/sf0.001"
EDGE = [
    None, "", " ", " a", "a ", "a  ", "\n", " \n a", "a\n b \n\n c ", "<|endoftext|> </s><unk>", "x" * 3000, "日本" * 400, "é" * 200 + " " + "🧿" * 50,
    "a  b", "a\x1c b", "a \x1cb", "a\xa0 b", "naïve 日本語 🧿 x  y", "▁x", "a ▁ b", "\x00\x85", "the cat sat", "the cat sat",
]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A, B)


def _walk(aligner, text):
    """(n_a, n_b, groups' text, pairs) by whole texts, with decoded bytes only."""
    if not text:
        return 0, 0, "", []
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    a_bytes, b_bytes = ([table[i] for i in ids] for table, ids in ((aligner.a_bytes, a), (aligner.b_bytes, b)))
    if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return 0, 0, "", []
    a_ends, b_ends = (np.cumsum([len(x) for x in own]).tolist() for own in (a_bytes, b_bytes))
    i = j = 0
    groups, pairs, own = [], [], ([], [])
    while i < len(a):
        pairs.append((a[i], b[j]))
        at_a, at_b = a_ends[i], b_ends[j]
        if at_a <= at_b:
            own[0].append(a[i])
            i += 1
        if at_b <= at_a:
            own[1].append(b[j])
            j += 1
        if at_a == at_b:
            groups.append("|".join(",".join(map(str, x)) for x in own))
            own = ([], [])
    return len(a), len(b), ";".join(groups), pairs


def _expected(aligner, rows):
    walked = [(i, _walk(aligner, t)) for i, t in rows]
    counts = Counter(pair for _, w in walked for pair in set(w[3]))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    for i, (n_a, n_b, groups, pairs) in walked:
        n_best = sum(counts[p] == best[p[0]] for p in pairs)
        digest = hashlib.sha256(groups.encode()).hexdigest() if pairs else ""
        yield (i, n_a, n_b, groups.count(";") + 1 if pairs else 0, len(pairs), n_best, sum(counts[p] for p in pairs), digest)


def test_spans_are_refined():
    """Three tokens share a character of four bytes; byte pieces have empty spans before the last."""
    of = lambda *x: alignment.edges(*map(np.array, x)).tolist()
    assert of([0, 3, 3, 3, 7], [3, 7, 7, 7, 8], [3, 1, 1, 2, 1]) == [0, 3, 4, 5, 7]
    assert of([0, 3, 3, 3, 7], [3, 3, 3, 7, 8], [3, 1, 1, 2, 1]) == [0, 3, 4, 5, 7]
    assert of([0, 3, 7, 7, 7], [3, 7, 7, 7, 8], [3, 1, 1, 2, 1]) == [0, 3, 4, 5, 7]
    assert of([], [], []) == []


def test_groups_and_links(aligner):
    rng = random.Random(2)
    pool = "aab  \n\t'sreé日本x1२🧿▁<s>\x00\x1c\x85​﷽½"
    texts = [t or "" for t in EDGE] + ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(1500)]
    some = 0
    for lo in range(0, len(texts), 400):
        for text, (n_a, n_b, n_groups, links, groups) in zip(texts[lo : lo + 400], aligner.align(texts[lo : lo + 400])):
            want = _walk(aligner, text)
            assert (n_a, n_b, groups) == want[:3], text
            assert [divmod(x, aligner.n_b) for x in np.frombuffer(links, "<i8").tolist()] == want[3]
            assert n_groups == (want[2].count(";") + 1 if want[3] else 0) and len(want[3]) == n_a + n_b - n_groups
            some += n_a > 0
    assert some > 500


def test_units_and_whole_texts_agree(aligner, monkeypatch):
    texts = [t or "" for t in EDGE] * 2
    want = aligner.align(texts)
    monkeypatch.setattr(alignment, "_REMEMBERED", 3)
    assert [aligner.align([t])[0] for t in texts] == want
    monkeypatch.setattr(aligner, "units", None)
    assert alignment.Aligner.align(aligner, texts) == want


def test_query(spark, aligner):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = [tuple(r) for r in QUERIES["op11_alignment"](spark, SF).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
    assert sorted(out) == sorted(_expected(aligner, rows))


def test_edge_rows(spark, aligner, monkeypatch):
    """Nulls, repeated rows, clashing names and an empty table; many blocks give what one gives."""
    rows = [*enumerate(EDGE), (21, "the cat sat"), (21, "other text"), (None, "a b"), (None, None)]
    extra = [F.lit(1).alias(c) for c in ("_0", "_doc", "block", "at", "n_a", "pairs")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *extra).repartition(3)
    want = sorted(_expected(aligner, rows), key=str)
    assert sorted((tuple(r) for r in alignment.align(df, A, B).collect()), key=str) == want
    monkeypatch.setattr(alignment, "BLOCK", 20)
    assert sorted((tuple(r) for r in alignment.align(df, A, B).collect()), key=str) == want
    assert alignment.align(df.limit(0), A, B).collect() == []
