"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads the UTF-8 bytes of a text. At each position the chain of output links from its state lists every
piece that ends there, and each relaxes the best score of that position. Texts are cut where no piece can cross, and the
same run of bytes is segmented once per slice of texts; runs are stepped through together, as rows of arrays.

A task builds the automaton for itself and lets it go when it ends, so workers that serve other work next don't keep it.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

_SPACE = "▁"
#: Bytes of a run beyond which it is segmented on its own.
_LONG = 192
#: Segmented runs that a task remembers.
_REMEMBERED = 100_000
#: Bytes of neighbouring texts that are encoded together.
_SLICE = 1 << 20


class Codec:
    """Pieces and scores of a model file, and their automaton. Bytes that no piece covers become byte pieces."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.byte_ids = np.full(256, -1, dtype=np.int64)
        normal = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                normal.append(i)
                self.bytes_of.append(piece.replace(_SPACE, " ").encode())
        if (self.byte_ids < 0).any():
            raise ValueError(f"{model_path}: without byte pieces not every text can be encoded")
        scores = np.array([model.get_score(i) for i in range(n)])
        #: A byte piece costs more than any piece, so it serves only where none fits.
        self.byte_score = float(scores[normal].min()) - 10.0
        self._build(normal, scores)
        crossing = {b for i in normal if len(self.bytes_of[i]) > 1 for b in self.bytes_of[i]}
        alone = bytes(b for b in range(128) if b not in crossing)  # each such byte is a run of its own
        inner = any(b" " in self.bytes_of[i].lstrip(b" ") for i in normal)
        lone = b"".join(re.escape(bytes([b])) for b in alone)
        single = b"[" + lone + b"]|" if lone else b""
        self.cut = None if inner else re.compile(single + b" +[^ " + lone + b"]*|[^ " + lone + b"]+")
        self.memory: dict[bytes, list[int]] = {}
        #: One object for each id, so that remembered runs hold references only.
        self.ids = list(range(n))

    def _build(self, normal: list[int], scores: np.ndarray) -> None:
        """States by levels: ``go`` with failures folded in, and per state the piece that ends in it and the next state
        of its output chain. A level's states are the distinct prefixes of its length."""
        sizes = np.array([len(self.bytes_of[i]) for i in normal])
        longest = int(sizes.max(initial=0))
        data = np.array([self.bytes_of[i] for i in normal], dtype=f"S{max(1, longest)}").view(np.uint8).reshape(len(normal), -1)
        at, levels, n = np.zeros(len(normal), dtype=np.int64), [], 1
        for depth in range(longest):
            live = sizes > depth
            steps, which = np.unique(at[live] * 256 + data[live, depth], return_inverse=True)
            levels.append((steps >> 8, steps & 255, np.arange(n, n + len(steps))))
            at[live] = n + which
            n += len(steps)
        self.piece = np.full(n, -1, dtype=np.int32)
        self.piece[at] = normal
        self.go = np.zeros((n, 256), dtype=np.uint16 if n <= 1 << 16 else np.uint32)
        fail, self.chain = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int32)
        for depth, (above, byte, state) in enumerate(levels):
            if depth:
                fail[state] = self.go[fail[above], byte]
            self.go[above, byte] = state
            own = fail[state]
            self.go[state] = self.go[own]
            self.chain[state] = np.where(self.piece[own] >= 0, own, self.chain[own])
        self.first = np.where(self.piece >= 0, np.arange(n), self.chain).astype(np.int32)
        lengths = np.array([len(x) for x in self.bytes_of])
        self.size = np.where(self.piece >= 0, lengths[self.piece], 0)
        self.score = np.where(self.piece >= 0, scores[self.piece], 0.0)

    def _rows(self, runs: list[bytes]) -> list[list[int]]:
        """Segments runs of similar length, a byte of all of them at a time."""
        n, longest = len(runs), max(map(len, runs))
        data = np.zeros((n, longest), dtype=np.uint8)
        lengths = np.array([len(r) for r in runs])
        data[np.arange(longest)[None, :] < lengths[:, None]] = np.frombuffer(b"".join(runs), dtype=np.uint8)
        best = np.full((longest + 1, n), -np.inf)
        took = np.zeros((longest + 1, n), dtype=np.int32)  # the state of the piece that ends here; 0 for a byte piece
        best[0] = 0
        state = np.zeros(n, dtype=np.int32)
        for t in range(longest):
            state = self.go[state, data[:, t]]
            best[t + 1] = best[t] + self.byte_score
            at, rows = self.first[state], np.arange(n)
            while True:
                live = at > 0
                if not live.all():
                    at, rows = at[live], rows[live]
                if not len(at):
                    break
                reach = best[t + 1 - self.size[at], rows] + self.score[at]
                better = reach > best[t + 1, rows]
                if better.any():
                    best[t + 1, rows[better]] = reach[better]
                    took[t + 1, rows[better]] = at[better]
                at = self.chain[at]
        return [self._walk_back(took[:, i], runs[i]) for i in range(n)]

    def _walk_back(self, took, run: bytes) -> list[int]:
        out, t = [], len(run)
        while t > 0:
            state = took[t]
            if state:
                out.append(self.ids[self.piece[state]])
                t -= int(self.size[state])
            else:
                out.append(self.ids[self.byte_ids[run[t - 1]]])
                t -= 1
        return out[::-1]

    def _long(self, run: bytes) -> list[int]:
        """One long run: the same steps, a byte at a time."""
        best, took, state = [0.0], [0], 0
        go, first, chain, size, score = self.go, self.first, self.chain, self.size, self.score
        for t, b in enumerate(run):
            state = int(go[state, b])
            top, by = best[t] + self.byte_score, 0
            at = int(first[state])
            while at:
                reach = best[t + 1 - int(size[at])] + float(score[at])
                if reach > top:
                    top, by = reach, at
                at = int(chain[at])
            best.append(top)
            took.append(by)
        return self._walk_back(took, run)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Piece ids of each whole text, a space put before it. An empty text has none."""
        runs_of = []
        for text in texts:
            data = (" " + text).encode("utf-8", "surrogatepass") if text else b""
            runs_of.append(self.cut.findall(data) if self.cut and data else [data] if data else [])
        new = set().union(*runs_of) - self.memory.keys()
        if len(self.memory) + len(new) > _REMEMBERED:
            self.memory.clear()
            new = set().union(*runs_of)
        known = self.memory
        if len(new) > _REMEMBERED:
            known = {}
        short = sorted((r for r in new if len(r) <= _LONG), key=len)
        for lo in range(0, len(short), 4096):
            part = short[lo : lo + 4096]
            known.update(zip(part, self._rows(part)))
        for run in new:
            if len(run) > _LONG:
                known[run] = self._long(run)
        out = []
        for runs in runs_of:
            ids: list[int] = []
            for run in runs:
                ids += known[run]
            out.append(ids)
        return out

    def decode(self, ids) -> str:
        """The text: an encoded one comes back whole. Control pieces say nothing."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return data.decode("utf-8", "surrogatepass")[1:] if data.startswith(b" ") else data.decode("utf-8", "surrogatepass")


def _slices(sizes: list[int], most: int = _SLICE):
    """Neighbours of together about ``most``."""
    at = 0
    while at < len(sizes):
        stop, held = at, 0
        while stop < len(sizes) and (stop == at or held + sizes[stop] <= most):
            held += sizes[stop]
            stop += 1
        yield at, stop
        at = stop


def _by_slice(rows: DataFrame, id_col: str, value_col: str, fields: list[StructField], model_path: str, work) -> DataFrame:
    """(id, ``fields``): ``work(codec, values)`` gives the fields' arrays for a few neighbouring rows."""
    schema = StructType([StructField(id_col, rows.schema[id_col].dataType), *fields])

    def run(batches):
        codec = Codec(model_path)
        for batch in batches:
            ids, values = batch.column(0), batch.column(1)
            sized = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
            for lo, hi in _slices(pc.fill_null(sized, 0).to_pylist()):
                arrays = [ids.slice(lo, hi - lo), *work(codec, values.slice(lo, hi - lo))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.select(F.col(id_col).alias("_id"), F.col(value_col).alias("_value")).mapInArrow(run, schema)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``piece_ids`` (array of int). A null text has null, an empty one no ids.

    The model file is read by each task, so its path has to exist on every machine, as a library's files do.
    """

    def ids_of(codec, texts):
        found = codec.encode([t or "" for t in texts.to_pylist()])
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        flat = np.fromiter((i for ids in found for i in ids), dtype=np.int32, count=int(offsets[-1]))
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=texts.is_null())]

    return _by_slice(docs, id_col, text_col, [StructField("piece_ids", ArrayType(IntegerType()))], model_path, ids_of)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "piece_ids") -> DataFrame:
    """One row per input row: id and ``text``. Null ids have a null text."""

    def text_of(codec, ids):
        return [pa.array([None if x is None else codec.decode(x) for x in ids.to_pylist()], pa.string())]

    return _by_slice(encoded, id_col, ids_col, [StructField("text", StringType())], model_path, text_of)


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_pieces, n_byte_pieces, ids_sha256 (of the ids as little-endian 32-bit integers) and
    decoded_sha256 (of the decoded text, which is that of the text itself). A null text counts as empty."""
    fields = [*(StructField(f, LongType()) for f in ("n_pieces", "n_byte_pieces")), *(StructField(f, StringType()) for f in ("ids_sha256", "decoded_sha256"))]

    def digest(codec, texts):
        is_byte = np.zeros(len(codec.bytes_of), bool)
        is_byte[codec.byte_ids] = True
        rows = []
        for ids in codec.encode([t or "" for t in texts.to_pylist()]):
            packed = np.array(ids, dtype="<i4")
            text = codec.decode(ids).encode("utf-8", "surrogatepass")
            rows.append((len(ids), int(is_byte[packed].sum()), hashlib.sha256(packed.tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]

    return _by_slice(docs, id_col, text_col, fields, model_path, digest)
