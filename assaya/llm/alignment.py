"""Alignment of two tokenizers' tokens, and how often token pairs go together over a corpus.

Spans say where a token lies: the character offsets of the first library, the byte spans of the second's mapping (those of
its protos, as one list). They are coarse. A token that holds a part of a character has the whole character's span, and byte pieces before a character's last
have none. So spans count only where no token before reaches further and neither side is empty; between such cuts the
decoded bytes of the tokens say where each begins.

Texts are worked on in units, cut before a blank that follows a mark: no merge of either tokenizer crosses there, so a
unit's tokens don't depend on its neighbours, and the same unit is aligned once per task while it is remembered. Where a
vocabulary has pieces with inner blanks, or the first tokenizer splits in another way, the whole text is the unit.
"""

import hashlib
import json
import os
import re
from itertools import chain, count, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from assaya.llm.bpe_codec import byte_alphabet
from assaya.llm.slices import by_slice
from assaya.shared import stored

#: Units that a task remembers, and the most characters of one.
_REMEMBERED, _SHORT = 300_000, 64
#: Characters of units that are encoded in one call.
_CALL = 1 << 16
#: Bytes of the texts of a block, whose pairs are counted together.
BLOCK = 4 << 20
#: A blank after whitespace begins no unit, as patterns take whitespace in runs.
_UNITS = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*)?|\s+")


def edges(starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The byte at which each token begins, from coarse spans in bytes and the sizes of their decoded bytes."""
    n = np.arange(len(starts))
    reach = np.append(0, np.maximum.accumulate(ends)[:-1])
    wide = ends > starts
    sure = (starts >= reach) & wide & np.append(True, wide[:-1])
    sure[:1] = True
    last = np.maximum.accumulate(np.where(sure, n, 0))
    before = np.cumsum(sizes) - sizes
    return np.where(last > 0, starts[last], 0) + before - before[last]


class Aligner:
    """A byte-level BPE file (A) and a SentencePiece model with byte pieces (B), side by side."""

    def __init__(self, bpe_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs in parallel
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bpe_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        n = self.b.get_piece_size()
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.n_b = n
        self.blank = self.b.piece_to_id("▁")
        with open(bpe_path, encoding="utf-8") as f:
            split = json.load(f)["pre_tokenizer"] or {}
        inner = any(b" " in x.lstrip(b" ") for x in self.b_bytes)
        self.units = None if inner or split.get("type") != "ByteLevel" or not split.get("use_regex") else _UNITS
        self._texts = [[f"{i}{end}" for i in range(max(n, len(self.a_bytes)))] for end in ",|;"]
        self._text_size = np.fromiter(map(len, self._texts[0]), np.int64, len(self._texts[0]))
        self._forget()

    def _forget(self) -> None:
        """``number`` of each known unit; by number its group text, packed links, and n_a, n_b, n_groups, sound (1 or 0)."""
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.links: list[bytes] = []
        self.counts = np.zeros((0, 4), np.int64)
        self._more: list[np.ndarray] = []
        self.again: set[str] = set()

    def _forget_most(self) -> None:
        """Keeps the units that came again, if they aren't many themselves."""
        kept = [(u, k) for u, k in self.number.items() if u in self.again]
        old = self.groups, self.links, self.counts
        self._forget()
        if len(kept) <= _REMEMBERED // 2:
            self.number = {u: i for i, (u, _) in enumerate(kept)}
            at = [k for _, k in kept]
            self.groups, self.links, self.counts = [old[0][k] for k in at], [old[1][k] for k in at], old[2][at]

    def _tokens_a(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = self.a.encode(text, add_special_tokens=False)
        ids = np.array(found.ids, np.int64)
        spans = np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
        if not text.isascii():
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            at = np.append(0, np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)))
            spans = at[spans]
        return ids, edges(spans[:, 0], spans[:, 1], self.a_size[ids])

    def _tokens_b(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """B puts the first blank itself, and its spans don't count it."""
        if text == " ":
            return np.array([self.blank]), np.array([0])
        found = self.b.encode(text[1:], return_type="offset_mapping", return_bytes=True)
        ids = np.array(found["ids"], np.int64)
        spans = np.fromiter(chain.from_iterable(found["offsets"]), np.int64, 2 * len(ids)).reshape(-1, 2) + 1
        spans[:1, 0] = 0
        return ids, edges(spans[:, 0], spans[:, 1], self.b_size[ids])

    def _align(self, units: list[str]) -> None:
        """Adds units that can stand side by side: no one but the last ends in whitespace."""
        text = "".join(units)
        data = text.encode()
        (a, a_at), (b, b_at) = self._tokens_a(text), self._tokens_b(text)
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != data or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != data:
            if len(units) > 1:
                for unit in units:
                    self._align([unit])
                return
            self._add(units, [""], [b""])
            self._more.append(np.zeros((1, 4), np.int64))
            return
        sizes = [len(u) for u in units] if len(data) == len(text) else [len(u.encode()) for u in units]
        bases = np.append(0, np.cumsum(sizes))
        in_a, in_b = np.zeros(len(data), bool), np.zeros(len(data), bool)
        in_a[a_at], in_b[b_at] = True, True
        upto_a, upto_b, upto_both, upto_any = (np.append(0, np.cumsum(x)) for x in (in_a, in_b, in_a & in_b, in_a | in_b))
        parts = np.flatnonzero(in_a | in_b) + 1
        packed = (a[upto_a[parts] - 1] * self.n_b + b[upto_b[parts] - 1]).astype("<i8").tobytes()
        listed, ends = self._group_texts(a, b, upto_both[a_at + 1], upto_both[b_at + 1])
        to = np.stack([upto_a[bases], upto_b[bases], upto_both[bases]], axis=1)
        self._more.append(np.append(np.diff(to, axis=0), np.ones((len(units), 1), np.int64), axis=1))
        texts_to, links_to = ends[to[:, 0] + to[:, 1]].tolist(), (8 * upto_any[bases]).tolist()
        self._add(units, [listed[i:j] for i, j in pairwise(texts_to)], [packed[i:j] for i, j in pairwise(links_to)])

    def _group_texts(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> tuple[str, np.ndarray]:
        """The decimal ids in the order of the groups, A's before B's, each with what follows it; and where they end."""
        group = np.append(a_group, b_group)
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(2 * group + side, kind="stable")
        key = (2 * group + side)[order]
        ends = np.append(key[1:] != key[:-1], True)
        after = np.where(ends, 1 + side[order], 0)
        ids = np.append(a, b)[order]
        texts = [self._texts[k][i] for k, i in zip(after.tolist(), ids.tolist())]
        return "".join(texts), np.append(0, np.cumsum(self._text_size[ids]))

    def _add(self, units: list[str], listed: list[str], links: list[bytes]) -> None:
        self.number.update(zip(units, count(len(self.groups))))
        self.groups += listed
        self.links += links

    def _settle(self) -> None:
        self.counts, self._more = np.concatenate([self.counts, *self._more]), []

    def _learn(self, units: set[str]) -> None:
        new = units - self.number.keys()
        self.again |= units - new
        if len(self.groups) + len(new) > _REMEMBERED:
            self._forget_most()
            new = units - self.number.keys()
        held, size = [], 0
        for unit in new:
            if unit[-1].isspace() or len(unit) > _CALL:
                self._align([unit])
                continue
            held.append(unit)
            size += len(unit)
            if size > _CALL:
                self._align(held)
                held, size = [], 0
        if held:
            self._align(held)
        self._settle()

    def align(self, texts: list[str]) -> list[tuple[int, int, int, bytes, str]]:
        """Per text n_a, n_b, n_groups, the packed links (A id times the number of B's pieces, plus B id) in order, and the
        groups' text. All zero and empty without text, and where the tokens don't give the text back."""
        split = [(self.units.findall(" " + t) if self.units else [" " + t]) if t else [] for t in texts]
        distinct = set().union(*split)
        self._learn(distinct)
        every = list(map(self.number.__getitem__, chain.from_iterable(split)))
        ends = np.append(0, np.cumsum([len(units) for units in split], dtype=np.int64))
        sums = np.diff(np.append(np.zeros((1, 4), np.int64), np.cumsum(self.counts[every], axis=0), axis=0)[ends], axis=0).tolist()
        out, passing = [], []
        for text, units, (lo, hi), (*counts, sound) in zip(texts, split, pairwise(ends.tolist()), sums):
            known = every[lo:hi]
            if sound < len(units):
                if len(units) > 1:  # parts differ; the whole might yet be the same
                    self._align([" " + text])
                    self._settle()
                    known = [self.number.pop(" " + text)]
                    passing += known
                known = known if self.counts[known[0], 3] else []
                counts = self.counts[known, :3].sum(axis=0).tolist()
            out.append((*counts, b"".join(map(self.links.__getitem__, known)), "".join(map(self.groups.__getitem__, known))[:-1]))
        passing += [self.number.pop(u) for u in distinct if len(u) > _SHORT]
        for k in passing:
            self.groups[k], self.links[k] = "", b""
        return out


_OWN = [*(StructField(c, LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")), StructField("groups_sha256", StringType())]


def blocks(docs: DataFrame, bpe_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each text, and one for each block of neighbouring texts. A text has the id, n_a, n_b, n_groups, n_links,
    groups_sha256, and its distinct pairs as places in its block (``at``) with how often it holds each (``times``). A
    block has its distinct ``pairs`` and how many of its ``docs`` hold each, so counts are summed up before they are
    shuffled."""
    schema = StructType([
        StructField("block", LongType()), StructField("_doc", docs.schema[id_col].dataType), *_OWN,
        StructField("at", ArrayType(IntegerType())), StructField("times", ArrayType(IntegerType())),
        StructField("pairs", ArrayType(LongType())), StructField("docs", ArrayType(IntegerType())),
    ])

    def make():
        aligner, number = Aligner(bpe_path, piece_path), TaskContext.get().partitionId() << 32

        def work(ids, texts):
            nonlocal number
            number += 1
            found = aligner.align([t or "" for t in texts.to_pylist()])
            links = np.frombuffer(b"".join(f[3] for f in found), "<i8")
            n_links = np.array([len(f[3]) // 8 for f in found], np.int64)
            coded = pa.array(links).dictionary_encode()
            pairs, place = coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)
            own, times = np.unique(np.repeat(np.arange(len(found)), n_links) * max(1, len(pairs)) + place, return_counts=True)
            doc, at = np.divmod(own, max(1, len(pairs)))
            offsets = pa.array(np.append(np.searchsorted(doc, np.arange(len(found) + 1)), len(own)).astype(np.int32))
            hashes = [hashlib.sha256(f[4].encode()).hexdigest() if f[3] else "" for f in found]
            column = lambda values: pa.array([*values, None], pa.int64())
            lists = lambda values, kind: pa.ListArray.from_arrays(offsets, pa.array(values.astype(kind)))
            alone = lambda values, kind: pa.array([None] * len(found) + [values.astype(kind)], pa.list_(pa.from_numpy_dtype(kind)))
            return [
                pa.array(np.full(len(found) + 1, number)), pa.concat_arrays([ids, pa.nulls(1, ids.type)]),
                *(column(f[k] for f in found) for k in range(3)), column(n_links.tolist()), pa.array([*hashes, None], pa.string()),
                lists(at, np.int32), lists(times, np.int32), alone(pairs, np.int64), alone(np.bincount(at, minlength=len(pairs)), np.int32),
            ]

        return work

    return by_slice(docs, {"id": F.col(id_col), "text": F.col(text_col)}, 1, schema, make, BLOCK)


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): in how many documents of the corpus the pair is linked, and whether no pair of its A id is in more.
    An A id has at most as many pairs as B has pieces."""
    parts = aligned.filter("pairs is not null").select(F.inline(F.arrays_zip("pairs", "docs")))
    counts = parts.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / n_b))))


def align(docs: DataFrame, bpe_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_a, n_b (tokens), n_groups (stretches between places where tokens of both end), n_links
    (A and B tokens that overlap), n_best (links whose pair is in as many documents as any of its A id), count_sum (of the
    links' numbers of documents) and groups_sha256 (of ``a1,a2|b1;a3|b2``; empty without tokens).

    A is the BPE file's encoding of a blank and the text, its special tokens' strings being text; B the piece model's of
    the text, to which it puts the blank. Texts that are null or empty, or that either's tokens don't give back (such as
    those with U+2581), have no tokens. Rows that repeat an id are documents of their own.

    The texts are read once; what comes of them is written to the shared folder, so a lost executor doesn't number blocks
    anew. Then only a block's distinct pairs are looked up, and come back to it.
    """
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
    aligned = stored(blocks(docs, bpe_path, piece_path, id_col, text_col), "aligned")
    looked = aligned.filter("pairs is not null").select("block", F.posexplode("pairs").alias("at", "pair"))
    known = looked.join(pair_counts(aligned, n_b), "pair").select(F.col("block").alias("of"), "at", "n", "best")
    texts = aligned.filter("pairs is null").select("block", "_doc", *[f.name for f in _OWN], "at", "times")
    own = [f for f in _OWN if f.name != "groups_sha256"]
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), *own, StructField("n_best", LongType()), StructField("count_sum", LongType()), _OWN[-1]])

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known["at"].to_numpy())
        n, best = known["n"].to_numpy()[order], known["best"].to_numpy()[order].astype(np.int64)
        column = {c: texts[c].combine_chunks() for c in texts.column_names}
        sizes = np.diff(column["at"].offsets.to_numpy())
        at, times = column["at"].flatten().to_numpy(), column["times"].flatten().to_numpy().astype(np.int64)
        ends = np.append(0, np.cumsum(sizes))
        total = lambda values: np.diff(np.append(0, np.cumsum(values))[ends])
        sums = {"n_best": total(best[at] * times), "count_sum": total(n[at] * times)}
        return pa.table([column["_doc"], *(column[f.name] for f in own), *(pa.array(v, pa.int64()) for v in sums.values()), column["groups_sha256"]], names=schema.names)

    return texts.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(score, schema)
