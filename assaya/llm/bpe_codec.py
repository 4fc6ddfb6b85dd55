"""BPE encoding and decoding by dynamic programming over prefixes.

Every prefix of a word has one encoding, and the encoding of a prefix without its last token is that of the shorter
prefix. So one token for each prefix says it all: the last one. An automaton over the tokens lists those that are suffixes
of the prefix; the one that is compatible with the last token of the prefix before it is the last one here. Two tokens
are compatible if merging their joined bytes gives the two back: no merge across their border comes before the merges that
made them. Back-pointers from a word's end give its ids, those of merging by rank.

Words of a batch are stepped through together, a byte of all of them at a time; the same word is encoded once per task
while it is remembered. A task builds its tables for itself.
"""

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from assaya.llm.automaton import Automaton
from assaya.llm.slices import by_slice

#: Words that a task remembers, and the most characters of one.
_REMEMBERED, _SHORT = 200_000, 64
#: Cells (words times bytes) and words that are stepped through together at most, and the fewest for which that pays.
_CELLS, _TOGETHER, _FEW = 1 << 20, 1 << 13, 32
#: Fixed value: the published split before merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for ASCII text, where the standard library's patterns serve and are faster.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Characters that both pattern libraries class alike; a text with others is split by the tokenizer file's own splitter.
SETTLED = re.compile("[\x00-՗֐-࡟₠-Ꟊ가-퟿-￿]*")
_FAR = np.int64(1) << 40


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in the token strings: itself if printable, else one from 256 up, in order."""
    shown = [unicodedata.category(chr(b))[0] not in "CZ" and b != 173 for b in range(256)]
    spare = iter(range(256, 512))
    return [chr(b) if shown[b] else chr(next(spare)) for b in range(256)]


class Codec:
    """A byte-level BPE tokenizer file: its merges, and an automaton over its tokens. With ``special`` the added tokens'
    strings in a text are those tokens (marks), else they are text like any other."""

    def __init__(self, path: str, special: bool = True):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model.get("type") != "BPE" or not plain or spec["normalizer"] or (split.get("type"), split.get("use_regex"), split.get("add_prefix_space")) != ("ByteLevel", True, False):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        added = spec["added_tokens"]
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added):
            raise ValueError(f"{path}: added tokens with conditions aren't supported")
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items()}
        self.added = {a["content"]: a["id"] for a in added}
        n = 1 + max(*vocab.values(), *self.added.values(), 0)
        self.bytes_of: list[bytes] = [b""] * n
        for token, i in [*vocab.items(), *((k.encode(), i) for k, i in self.added.items())]:
            self.bytes_of[i] = token
        self.text_of = [str(i) for i in range(n)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([[model["vocab"][a], model["vocab"][b], model["vocab"][a + b]] for a, b in merges], np.int64).reshape(-1, 3)
        made = pairs[:, 2]
        if len(np.unique(made)) < len(made):
            raise ValueError(f"{path}: a token made by two merges")
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.rank[made], self.left[made], self.right[made] = np.arange(len(made)), pairs[:, 0], pairs[:, 1]
        if (self.rank[pairs[:, :2]].max(axis=1, initial=-1) >= np.arange(len(made))).any():
            raise ValueError(f"{path}: a merge before those that make its parts")
        self.n = n
        self._hash_merges(pairs[:, 0] * n + pairs[:, 1])
        sound = self._sound(pairs)
        numbers = np.array([i for i in vocab.values() if sound[i]])
        self.automaton = Automaton([self.bytes_of[i] for i in numbers], numbers)
        self.size = np.fromiter(map(len, self.bytes_of), np.int64, n)
        self._words, self._splitter = regex.compile(SPLIT), Tokenizer.from_file(path).pre_tokenizer
        longest_first = sorted(filter(None, self.added), key=len, reverse=True)
        self._at_marks = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first and special else None
        #: The packed ids of words; those of marks stay, as no word is spelled like a mark where marks are looked for.
        self.marks = {k: np.array([i], "<i4").tobytes() for k, i in self.added.items()} if special else {}
        self.memory = dict(self.marks)
        self._pairs_seen: dict[int, bool] = {}

    def _hash_merges(self, keys: np.ndarray) -> None:
        """The merges' pairs in an open table, ten slots to each."""
        self._bits = max(4, int(10 * len(keys)).bit_length())
        self._slots, self._slot_ranks = np.full(1 << self._bits, -1, np.int64), np.full(1 << self._bits, _FAR, np.int64)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self._slots[at] < 0
            put, first = np.unique(at[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self._slots[put], self._slot_ranks[put] = keys[left[placed]], left[placed]
            stay = np.ones(len(left), bool)
            stay[placed] = False
            left, at = left[stay], (at[stay] + 1) & ((1 << self._bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _merge_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank of the merge of x and y; far beyond all where there is none."""
        keys = x * self.n + y
        at = self._slot(keys)
        held = self._slots[at]
        out = np.where(held == keys, self._slot_ranks[at], _FAR)
        other = np.flatnonzero((held != keys) & (held >= 0))
        at = at[other]
        while len(other):
            at = (at + 1) & ((1 << self._bits) - 1)
            held = self._slots[at]
            hit = held == keys[other]
            out[other[hit]] = self._slot_ranks[at[hit]]
            more = ~hit & (held >= 0)
            at, other = at[more], other[more]
        return out

    def _sound(self, pairs: np.ndarray) -> np.ndarray:
        """Which tokens merging gives back from their own bytes: single bytes, and those whose halves are sound and meet
        nothing across their border before their own merge."""
        sound = self.rank < 0
        meets = self.compatible(pairs[:, 0], pairs[:, 1], np.arange(len(pairs)))
        for (a, b, made), good in zip(pairs.tolist(), meets.tolist()):
            sound[made] = good and sound[a] and sound[b]
        return sound

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether tokens a and b, side by side, stay apart (until merge number ``before``).

        Both are undone, the later half first; x and y are what meets at the border meanwhile. Their own merge comes if
        its rank is below that of the merge that takes x away, and not above that which takes y away: of equal merges the
        left one comes first.
        """
        good = np.ones(len(a), bool)
        live, x, y = np.arange(len(a)), np.asarray(a, np.int64), np.asarray(b, np.int64)
        x_until = np.full(len(a), _FAR, np.int64) if before is None else np.asarray(before, np.int64)
        y_until = x_until
        while len(live):
            merge = self._merge_rank(x, y)
            met = (merge < x_until) & (merge <= y_until) & (merge < _FAR)
            good[live[met]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            undo_x = rank_x > rank_y
            x_until, y_until = np.where(undo_x, rank_x, x_until), np.where(undo_x, y_until, rank_y)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            more = ~met & (np.maximum(rank_x, rank_y) >= 0)
            live, x, y, x_until, y_until = live[more], x[more], y[more], x_until[more], y_until[more]
        return good

    def _compatible_one(self, a: int, b: int) -> bool:
        key = a * self.n + b
        seen = self._pairs_seen.get(key)
        if seen is None:
            if len(self._pairs_seen) >= _REMEMBERED:
                self._pairs_seen.clear()
            seen = self._pairs_seen[key] = bool(self.compatible(np.array([a]), np.array([b]))[0])
        return seen

    def _rows(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of words of similar length, a byte of all of them at a time."""
        n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
        longest = int(sizes.max())
        data = np.zeros((n, longest), np.uint8)
        data[np.arange(longest)[None, :] < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        last = np.full((longest + 1, n), -1, np.int32)
        auto, state, everyone = self.automaton, np.zeros(n, np.int32), np.arange(n)
        for t in range(longest):
            state = auto.moves[auto.row[state], data[:, t]]
            at, rows = auto.longest[state], everyone[t < sizes]
            at = at[rows]
            while len(rows):
                token = auto.pattern[at]
                before = last[t + 1 - self.size[token], rows]
                fits = before < 0
                fits[~fits] = self.compatible(before[~fits], token[~fits])
                last[t + 1, rows[fits]] = token[fits]
                at, rows = auto.shorter[at[~fits]], rows[~fits]
        return self._walk_back(last, sizes)

    def _walk_back(self, last: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The packed ids of all words, from the last token of each prefix."""
        at, rows, steps = sizes.copy(), np.arange(len(sizes)), []
        counts = np.zeros(len(sizes), np.int64)
        while len(rows):
            token = last[at[rows], rows]
            steps.append((rows, token))
            counts[rows] += 1
            at[rows] -= self.size[token]
            rows = rows[at[rows] > 0]
        ends = np.cumsum(counts)
        flat = np.empty(int(ends[-1]), "<i4")
        for k, (rows, token) in enumerate(steps):
            flat[ends[rows] - 1 - k] = token
        packed = flat.tobytes()
        return [packed[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist())]

    def _one(self, word: bytes) -> bytes:
        """One word: the same steps, a byte at a time."""
        auto, state, last = self.automaton, 0, [-1]
        moves, row, longest, shorter, pattern, size = auto.moves, auto.row, auto.longest, auto.shorter, auto.pattern, self.size
        for t, b in enumerate(word):
            state = moves[row[state], b]
            at = longest[state]
            while True:
                token = int(pattern[at])
                before = last[t + 1 - int(size[token])]
                if before < 0 or self._compatible_one(before, token):
                    break
                at = shorter[at]
            last.append(token)
        out, t = [], len(word)
        while t:
            out.append(last[t])
            t -= int(size[last[t]])
        return np.array(out[::-1], "<i4").tobytes()

    def _split(self, text: str) -> list[str]:
        if text.isascii():
            return _ASCII_WORDS.findall(text)
        if SETTLED.fullmatch(text):
            return self._words.findall(text)
        return [text[a:b] for _, (a, b) in self._splitter.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        """The text in pieces that merges don't cross, marks among them."""
        if not self._at_marks or not self._at_marks.search(text):
            return self._split(text)
        parts = self._at_marks.split(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self._split(part))]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        order = np.argsort(np.fromiter(map(len, data), np.int64, len(data)), kind="stable").tolist()
        found, at = [b""] * len(data), 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and (stop - at) * len(data[order[stop]]) <= _CELLS and stop - at < _TOGETHER:
                stop += 1
            part = order[at:stop]
            packed = self._rows([data[i] for i in part]) if len(part) >= _FEW else [self._one(data[i]) for i in part]
            for i, ids in zip(part, packed):
                found[i] = ids
            at = stop
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text."""
        split_texts, known = [self.words(t) for t in texts], self.memory
        new = list(set().union(*split_texts).difference(known))
        if len(known) + len(new) > _REMEMBERED:
            known.clear()
            known.update(self.marks)
            new = list(set().union(*split_texts).difference(known))
        known.update(zip(new, self._encode_words(new)))
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4") for words in split_texts]
        for word in [w for w in new if len(w) > _SHORT]:
            del known[word]
        return out

    def decode(self, ids) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD. An encoded text comes back whole."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", special: bool = True) -> DataFrame:
    """One row per input row, in no order: id and ``ids`` (array of int). A null text has null, an empty one no ids.

    The file is read by each task, so its path has to exist on every machine, as a library's files do.
    """
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("ids", ArrayType(IntegerType()))])

    def make():
        codec = Codec(path, special)

        def work(ids, texts):
            found = codec.encode([t or "" for t in texts.to_pylist()])
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
            return [ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=texts.is_null())]

        return work

    return by_slice(docs, {"id": F.col(id_col), "text": F.col(text_col)}, 1, schema, make)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id and ``text``. Null ids have a null text."""
    schema = StructType([StructField(id_col, encoded.schema[id_col].dataType), StructField("text", StringType())])

    def run(batches):
        codec = Codec(path)
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.names)

    return encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256 (of the decimal ids, joined by commas) and decoded_sha256 (of the text
    that the ids decode to). A null text counts as empty; rows that repeat an id are rows of their own."""
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), *fields])

    def make():
        codec = Codec(path)

        def work(ids, texts):
            counts, listed, decoded = [], [], []
            for found in codec.encode([t or "" for t in texts.to_pylist()]):
                own = found.tolist()
                counts.append(len(own))
                listed.append(hashlib.sha256(",".join(map(codec.text_of.__getitem__, own)).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(own).encode()).hexdigest())
            return [ids, pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())]

        return work

    return by_slice(docs, {"id": F.col(id_col), "text": F.col(text_col)}, 1, schema, make)
