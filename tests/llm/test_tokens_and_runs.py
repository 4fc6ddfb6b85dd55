"""BPE by prefixes and periodic runs, against the library and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaya.llm import bpe_codec, periodic_runs
from assaya.llm.queries import QUERIES, TOKENIZERS

BPE = f"{TOKENIZERS}/byte_bpe_50k.json"
SF = "/root/testdata/sf0.001"
EDGE = [None, "", " ", "  \n\t ", "a", "a" * 3000, "ab" * 900, " " * 500 + "x", "日本語の" * 300, "é́ naïve x²½ 🧿🧿", "<|endoftext|>", "a<|endoftext|> <|endoftext|>\n<|endoftext|>b", "it's we'll 'S don't", "\x00\x01\x1c\x85 ", "word " * 400]


def _texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def _odd(spark):
    """Edge texts with repeated rows, null ids and columns whose names clash."""
    rows = [(i, t) for i, t in enumerate(EDGE)] + [(4, "a"), (4, "b c"), (None, "a b"), (None, None)]
    extra = [F.lit("x").alias(c) for c in ("_0", "_1", "id", "ids", "words", "start", "n_tokens", "n_runs")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").select("*", *extra).repartition(3)


@pytest.fixture(scope="module")
def codec():
    return bpe_codec.Codec(BPE)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_character_classes_agree(codec, library):
    """Where texts are split by pattern here, each character is classed as by the library."""
    import regex

    kinds = [regex.compile(p) for p in (r"\p{L}", r"\p{N}", r"\s")]
    for c in range(0x10000):
        ch = chr(c)
        if not 0xD800 <= c < 0xE000 and bpe_codec.SETTLED.fullmatch(ch):
            want = [len(library.pre_tokenizer.pre_tokenize_str(p + ch)) == 1 for p in ("a", "1", "!")]
            assert [bool(kinds[0].match(ch)), bool(kinds[1].match(ch)), not any(k.match(ch) for k in kinds)] == want, hex(c)


def test_ids_are_the_library_s(codec, library):
    rng = random.Random(1)
    drawn = ["".join(rng.choices("aaab  \n\t'sreé日本x1２🧿՘​", k=rng.randint(0, 60))) for _ in range(2000)]
    drawn += ["".join(chr(rng.choice((rng.randrange(32, 0x600), rng.randrange(0x2000, 0xD7FF), rng.randrange(0x10000, 0x20000)))) for _ in range(40)) for _ in range(500)]
    texts = [t or "" for t in EDGE] + drawn
    for own, theirs in zip(codec.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert own.tolist() == theirs.ids
        assert codec.decode(own.tolist()) == library.decode(theirs.ids, skip_special_tokens=False)
    plain = bpe_codec.Codec(BPE, special=False)
    library.encode_special_tokens = True
    assert [x.tolist() for x in plain.encode(texts[:15])] == [e.ids for e in library.encode_batch(texts[:15], add_special_tokens=False)]
    library.encode_special_tokens = False
    assert codec.decode([0, 241, 50256]) == library.decode([0, 241, 50256], skip_special_tokens=False)  # a byte that isn't UTF-8


def test_forgetting_changes_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(bpe_codec, "_REMEMBERED", 40)
    texts = [f"word{i} and{i * 7} <|endoftext|> more{i}" for i in range(60)]
    for lo in range(0, 60, 7):
        assert [x.tolist() for x in codec.encode(texts[lo : lo + 7])] == [e.ids for e in library.encode_batch(texts[lo : lo + 7], add_special_tokens=False)]


def _bpe_row(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_bpe_query(spark, library):
    texts = _texts(spark)
    out = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_bpe"](spark, SF).collect()}
    assert out == {k: _bpe_row(library, t) for k, t in texts.items()}


def test_bpe_on_edge_rows(spark, library):
    rows, df = _odd(spark)
    out = [tuple(r) for r in bpe_codec.round_trip(df, BPE).collect()]
    assert sorted(out, key=str) == sorted(((i, *_bpe_row(library, t)) for i, t in rows), key=str)
    assert bpe_codec.round_trip(df.limit(0), BPE).collect() == []
    back = bpe_codec.decode(bpe_codec.encode(df, BPE), BPE).collect()
    assert sorted(map(str, map(tuple, back))) == sorted(map(str, rows))


def _brute(words):
    """Every run, by a walk along each lag and a test of all smaller periods."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            run = words[i : j + q]
            if len(run) >= max(6, 4 * q) and not any(run[d:] == run[:-d] for d in range(1, q)):
                out.append((i, len(run), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def _runs_row(words):
    found = _brute(words)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def _planted(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    a = (h // 10) % len(words)
    p = 1 + (len(words) - a) // (3 + (h // 10) % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_runs_are_all_found():
    rng = random.Random(3)
    docs = []
    for _ in range(3000):
        k, n = rng.choice((2, 2, 3, 5, 50)), rng.randint(0, 70)
        words = [rng.randrange(k) for _ in range(n)]
        if n > 5 and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + rng.randrange((n - a) // 4 + 1)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        docs.append(words)
    base = [rng.randrange(2) for _ in range(150)]
    docs += [[1, 2] * 600, [1] * 1000 + [2] + [1] * 1000, base * 5 + [7] + base * 4, (base[:20] + [9]) * 4 + base[:20]]
    found = periodic_runs.find(np.array([w for d in docs for w in d]), np.array([len(d) for d in docs]))
    assert found == [_brute(d) for d in docs]


def test_one_word_over_and_over_is_linear():
    found = periodic_runs.find(np.zeros(400_000, np.int64), np.array([399_990, 10]))
    assert found == [[(0, 399_990, 1)], [(0, 10, 1)]]


def test_runs_query(spark):
    texts = _texts(spark)
    out = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert out == {k: _runs_row(_planted(k, (t or "").encode().split())) for k, t in texts.items()}


def test_runs_on_edge_rows(spark):
    rows, df = _odd(spark)
    out = [tuple(r) for r in periodic_runs.digest(df, text=periodic_runs.planted()).collect()]
    assert sorted(out, key=str) == sorted(((i, *_runs_row(_planted(i, (t or "").encode().split()))) for i, t in rows), key=str)
    assert periodic_runs.digest(df.limit(0)).collect() == [] and periodic_runs.runs(df.limit(0)).collect() == []
    listed = {tuple(r) for r in periodic_runs.runs(df).collect()}
    assert listed == {(i, *run) for i, t in rows for run in _brute((t or "").encode().split())}
    kept = [tuple(r) for r in periodic_runs.collapse(df).filter("doc_id in (0, 3, 14)").collect()]
    assert sorted(kept, key=str) == [(0, None), (14, "word"), (3, "")]
