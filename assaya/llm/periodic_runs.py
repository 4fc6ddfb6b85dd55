"""Periodic runs of words: seeds on diagonals, extended.

A run is a stretch of consecutive words in which words q apart are identical, q its smallest period, of at least
``LEAST`` words and ``TIMES`` periods, that can't be made longer on either side. On the diagonal of lag q its overlap with
itself has at least as many words as the window of its class of lags, so the window at its start comes again q words on,
and not sooner: an earlier one would make a smaller period. It is enough, then, to pair each window with its next
occurrence in the document, once for each class of lags (1, 2 to 3, 4 to 7, ...), and to extend pairs whose lag is of the
class. A table of how far each lag is covered keeps a run from being extended once for each of its windows.

Windows are named exactly: two are equal if their halves have equal names. Five-word windows that don't come again in
their document (told by a hash, which may let some stay) start no run and are left out from then on, so later classes
look at few positions.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from assaya.llm.slices import by_slice

#: The shortest run: words, and periods.
LEAST, TIMES = 6, 4
#: The window of lag 1; that of lags from 2^j (j > 0) is ``(TIMES - 1) * 2^j``, never shorter than half the class's lags.
_FIRST = LEAST - 1


def _named(*parts: np.ndarray) -> np.ndarray:
    """A number for each distinct row of the parts."""
    out = np.zeros(len(parts[0]), np.int64)
    for part in parts:
        step = int(part.max(initial=0)) + 1
        _, out = np.unique(out * step + part, return_inverse=True)
    return out


def _again(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Positions whose first window lies in its document and, as far as a hash tells, comes there more than once."""
    n = len(words) - _FIRST + 1
    if n < 2:
        return np.zeros(0, np.int64)
    whole = np.flatnonzero(doc[:n] == doc[_FIRST - 1 :])
    mix = doc[whole].astype(np.uint64)
    for k in range(_FIRST):
        mix = (mix ^ words[whole + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
    order = np.argsort(mix)
    same = mix[order[1:]] == mix[order[:-1]]
    twice = np.zeros(len(whole), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return whole[twice]


def _next_in(names: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, lag) of each window that has a next occurrence in its document; ``at`` rises."""
    order = np.lexsort((at, names))
    a, b = order[:-1], order[1:]
    follows = (names[a] == names[b]) & (doc[at[a]] == doc[at[b]])
    return at[a[follows]], (at[b] - at[a])[follows]


def _reach(words: np.ndarray, at: int, stop: int, lag: int, step: int) -> int:
    """How many words on from ``at``, in the direction of ``step`` and within ``stop``, equal the one ``lag`` after them."""
    gone, chunk = 0, 32
    left = abs(stop - at)
    while gone < left:
        n = min(chunk, left - gone)
        lo = at + gone if step > 0 else at - gone - n + 1
        differ = words[lo : lo + n] != words[lo + lag : lo + lag + n]
        hit = np.flatnonzero(differ)
        if len(hit):
            return gone + int(hit[0] if step > 0 else n - 1 - hit[-1])
        gone, chunk = gone + n, chunk * 2
    return gone


def find(words: np.ndarray, sizes: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Per document its runs (start, length, period), by start, then period. ``words``: numbers that tell words apart, of
    all documents after one another; ``sizes``: words of each."""
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(sizes))]
    at = _again(words, doc)
    if not len(at):
        return runs
    names = _named(*[words[at + k] for k in range(_FIRST)])
    covered: dict[tuple[int, int], int] = {}
    low, window = 1, _FIRST
    while len(at):
        where, lags = _next_in(names, at, doc)
        fit = (lags >= low) & (lags < 2 * low)
        order = np.lexsort((where[fit], lags[fit]))
        for i, lag in zip(where[fit][order].tolist(), lags[fit][order].tolist()):
            d = int(doc[i])
            if i < covered.get((d, lag), -1):
                continue
            first, last = int(ends[d] - sizes[d]), int(ends[d])
            right = i + window + _reach(words, i + window, last - lag, lag, 1)
            left = i - _reach(words, i - 1, first - 1, lag, -1)
            covered[d, lag] = right
            length = right - left + lag
            if length >= max(LEAST, TIMES * lag):
                runs[d].append((left - first, length, lag))
        # the next class's windows: two of this one's, the second a word (then a window) on
        shift, low = (1 if low == 1 else window), 2 * low
        here = np.searchsorted(at, at + shift)
        pairs = np.flatnonzero((here < len(at)) & (at[np.minimum(here, len(at) - 1)] == at + shift))
        pairs = pairs[doc[at[pairs]] == doc[at[pairs] + shift + window - 1]]
        names, at = _named(names[pairs], names[here[pairs]]) if len(pairs) else names[:0], at[pairs]
        window += shift
    for found in runs:
        found.sort(key=lambda r: (r[0], r[2]))
    return runs


def _numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, a number for each word, and how many a text has. Words are split as ``bytes.split`` does, which
    is at blanks and the five control characters from tab to return."""
    split = [t.split() for t in texts]
    number: dict[bytes, int] = {}
    flat = [number.setdefault(w, len(number)) for words in split for w in words]
    return split, np.array(flat, np.int64), np.fromiter(map(len, split), np.int64, len(split))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats: all of it after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]


def _output(fields: list[StructField], docs: DataFrame, id_col: str) -> StructType:
    return StructType([StructField(id_col, docs.schema[id_col].dataType), *fields])


def runs(docs: DataFrame, id_col: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """A row (id, start, length, period) for each run of each text. Rows that repeat an id are texts of their own, and a
    null or empty text has no runs."""
    schema = _output([StructField(c, LongType()) for c in ("start", "length", "period")], docs, id_col)

    def make():
        def work(ids, texts):
            _, words, sizes = _numbered([(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()])
            found = find(words, sizes)
            flat = [r for own in found for r in own]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(own) for own in found]), pa.int64())
            return [ids.take(rows), *(pa.array([r[k] for r in flat], pa.int64()) for k in range(3))]

        return work

    return by_slice(docs, {"id": F.col(id_col), "text": F.col(text) if isinstance(text, str) else text}, 1, schema, make)


def collapse(docs: DataFrame, id_col: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """One row per input row: id and ``text``, its words joined by one blank, without those that runs repeat. A null text
    stays null."""
    schema = _output([StructField("text", StringType())], docs, id_col)

    def make():
        def work(ids, texts):
            split, words, sizes = _numbered([(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()])
            kept = [b" ".join(_collapsed(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(split, find(words, sizes))]
            return [ids, pa.array(kept, pa.string(), mask=np.array(texts.is_null()))]

        return work

    return by_slice(docs, {"id": F.col(id_col), "text": F.col(text) if isinstance(text, str) else text}, 1, schema, make)


def digest(docs: DataFrame, id_col: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """One row per input row: id, n_runs, the longest run (ties: least start, then period; nulls without one) as start,
    length, period and exponent_milli, runs_sha256 (of all runs' ``start,length,period`` lines) and collapsed_sha256 (of
    the collapsed text). A null text has no words."""
    numbers = [StructField(c, LongType()) for c in ("n_runs", "start", "length", "period", "exponent_milli")]
    schema = _output([*numbers, StructField("runs_sha256", StringType()), StructField("collapsed_sha256", StringType())], docs, id_col)

    def make():
        def work(ids, texts):
            split, words, sizes = _numbered([(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()])
            rows = []
            for own, found in zip(split, find(words, sizes)):
                top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
                best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
                rows.append((len(found), *best, hashlib.sha256(lines).hexdigest(), hashlib.sha256(b" ".join(_collapsed(own, found))).hexdigest()))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            return [ids, *(pa.array(column, kind) for column, kind in zip(zip(*rows), kinds))]

        return work

    return by_slice(docs, {"id": F.col(id_col), "text": F.col(text) if isinstance(text, str) else text}, 1, schema, make)


def planted(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, in a tenth of the documents with its words made periodic from some word on: with h the CRC-32 of the decimal
    id and g = h div 10, where h is divisible by 10 word i >= a becomes word a + (i - a) mod p, a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8). Other texts, and those without words or id, are as they were."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(h % 10 == 0, F.aggregate(F.array(F.struct(words.alias("w"), F.floor(h / 10).alias("g"))), F.col(text_col), _periodic)).otherwise(F.col(text_col))


def _periodic(text: Column, x: Column) -> Column:
    words, g = x["w"], x["g"]
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = F.lit(1) + F.floor((n - a) / (3 + g % 8)).cast("int")
    return F.when(n > 0, F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")).otherwise(text)
