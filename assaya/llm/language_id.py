"""Language identification by a byte convolutional network.

A window of bytes passes through filters of several widths over byte embeddings, a rectifier, the maximum over the
window, and a softmax. Training is numpy on a bounded sample of labelled windows, on the driver; prediction runs over
every window of every text, and a text's probabilities are the mean of its windows', weighted by their letters.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaya.llm.sampling import spread_by_hash

WIDTHS = (2, 3, 4)
#: Bytes in a window.
WINDOW = 256
_PAD = 32


@dataclass
class Model:
    """``tables[w][k]``: what byte b at offset k adds to each filter of width w, that is embedding times filter."""

    languages: list[str]
    tables: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Softmax rows for (n, WINDOW) bytes; windows are worked on in groups that fit a cache."""
        out = np.empty((len(windows), len(self.languages)), dtype=np.float32)
        for lo in range(0, len(windows), 64):
            part = windows[lo : lo + 64]
            pooled = []
            for table, bias in zip(self.tables, self.biases):
                n = part.shape[1] - len(table) + 1
                acts = table[0][part[:, :n]]
                for k in range(1, len(table)):
                    acts += table[k][part[:, k : k + n]]
                pooled.append(np.maximum(acts.max(axis=1) + bias, 0))
            logits = np.concatenate(pooled, axis=1) @ self.dense + self.offset
            logits = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[lo : lo + 64] = logits / logits.sum(axis=1, keepdims=True)
        return out


def as_windows(data: bytes, window: int = WINDOW) -> np.ndarray:
    """The bytes in rows of one window each, the last filled up with spaces; at least one row."""
    n = max(1, -(-len(data) // window))
    out = np.full(n * window, _PAD, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(n, window)


def train(windows: np.ndarray, labels: list[str], filters: int = 8, embedding: int = 8, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Model:
    """Adam on the cross-entropy. Languages are the labels found, in order. With one language it is always predicted."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)
    params = {"e": normal(256, embedding), "d": normal(filters * len(WIDTHS), len(languages)), "o": np.zeros(len(languages), np.float32)}
    for w in WIDTHS:
        params[f"f{w}"] = normal(w * embedding, filters)
        params[f"b{w}"] = np.zeros(filters, np.float32)
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            at = order[lo : lo + batch]
            step += 1
            for k, g in _gradients(params, windows[at], y[at], embedding).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    split = lambda w: params[f"f{w}"].reshape(w, embedding, -1)
    tables = [np.stack([params["e"] @ split(w)[k] for k in range(w)]).astype(np.float32) for w in WIDTHS]
    return Model(languages, tables, [params[f"b{w}"] for w in WIDTHS], params["d"], params["o"])


def _gradients(params: dict, x: np.ndarray, y: np.ndarray, embedding: int) -> dict:
    vectors = params["e"][x]
    rows = np.arange(len(x))[:, None]
    pooled, best, patches = [], [], []
    for w in WIDTHS:
        views = np.concatenate([vectors[:, k : x.shape[1] - w + 1 + k] for k in range(w)], axis=2)
        acts = views @ params[f"f{w}"] + params[f"b{w}"]
        top = acts.argmax(axis=1)
        best.append(top)
        patches.append(views[rows, top])
        pooled.append(np.take_along_axis(acts, top[:, None, :], axis=1)[:, 0])
    raw = np.concatenate(pooled, axis=1)
    hidden = np.maximum(raw, 0)
    logits = hidden @ params["d"] + params["o"]
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    grads = {"d": hidden.T @ p, "o": p.sum(axis=0), "e": np.zeros_like(params["e"])}
    back = (p @ params["d"].T) * (raw > 0)
    at = 0
    for w, top, patch in zip(WIDTHS, best, patches):
        n = top.shape[1]
        g = back[:, at : at + n]
        at += n
        grads[f"f{w}"] = np.einsum("bfv,bf->vf", patch, g)
        grads[f"b{w}"] = g.sum(axis=0)
        to_patch = g[:, :, None] * params[f"f{w}"].T[None]
        for k in range(w):
            np.add.at(grads["e"], x[rows, top + k], to_patch[:, :, k * embedding : (k + 1) * embedding])
    return grads


def sample(docs: DataFrame, text_col: str, lang_col: str, most: int) -> tuple[np.ndarray, list[str]]:
    """At most ``most`` labelled windows, one of each distinct text and in equal parts for the languages, picked by a hash
    of the text; where a text is longer than a window, the hash picks the place too. Texts without a letter are left out."""
    mixed = F.xxhash64(text_col)
    room = F.greatest(F.length(text_col) - WINDOW, F.lit(0)) + 1
    piece = F.substring(F.col(text_col), F.pmod(mixed, room).cast("int") + 1, F.lit(WINDOW))
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = spread_by_hash(labelled.select(piece.alias("piece"), F.col(lang_col).alias("lang"), mixed.alias("mixed")), "mixed", "lang", most)
    windows = [as_windows(r["piece"].encode()[:WINDOW])[0] for r in rows]
    return np.array(windows, dtype=np.uint8).reshape(-1, WINDOW), [r["lang"] for r in rows]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 6000, **settings) -> Model | None:
    """None without a labelled row."""
    windows, labels = sample(docs, text_col, lang_col, most)
    return train(windows, labels, **settings) if labels else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs``' id and ``keep`` columns with ``lang_pred`` and ``score``, the probability of that language.

    A null text, one without a letter (Unicode L), or any text without a model gives ``und`` and 0. Only texts are read.
    """

    def judged(text: str | None):
        if text is None or model is None or not any(map(str.isalpha, text)):
            return "und", 0.0
        data = text.encode("utf-8", "replace")
        total = np.zeros(len(model.languages))
        for lo in range(0, len(data), WINDOW * 4096):
            windows = as_windows(data[lo : lo + WINDOW * 4096])
            letters = _LETTER[windows].sum(axis=1)
            total += letters @ model.probabilities(windows)
        total /= max(total.sum(), 1e-12)
        best = int(total.argmax())
        return model.languages[best], float(min(1.0, total[best]))

    def many(texts: pd.Series) -> pd.DataFrame:
        """Short texts share one call of the network."""
        out: list = [None] * len(texts)
        rows, owners = [], []
        for i, text in enumerate(texts):
            if text is None or model is None or len(text) > 1 << 16 or not any(map(str.isalpha, text)):
                out[i] = judged(text)
            else:
                rows.append(as_windows(text.encode("utf-8", "replace")))
                owners.append(i)
        for lo in range(0, len(rows), 256):
            part = np.concatenate(rows[lo : lo + 256])
            weighted = model.probabilities(part) * _LETTER[part].sum(axis=1, keepdims=True)
            starts = np.cumsum([0] + [len(r) for r in rows[lo : lo + 256]])[:-1]
            totals = np.add.reduceat(weighted, starts, axis=0)
            totals /= np.maximum(totals.sum(axis=1, keepdims=True), 1e-12)
            for i, t in zip(owners[lo : lo + 256], totals):
                out[i] = (model.languages[int(t.argmax())], float(min(1.0, t.max())))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        parts = [many(texts.iloc[lo : lo + 512]) for lo in range(0, len(texts), 512)]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang_pred": [], "score": []})

    named = docs.select(F.struct(F.col(id_col), *keep).alias("_kept"), guess(F.col(text_col)).alias("_g"))
    return named.select("_kept.*", "_g.lang_pred", "_g.score")


#: ASCII letters and bytes of longer characters.
_LETTER = np.array([(65 <= b <= 90) or (97 <= b <= 122) or b >= 128 for b in range(256)], dtype=np.float32)


def held_out(id_col: str = "doc_id"):
    """A fixed quarter of the rows: those whose CRC-32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **settings) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score. Rows held out aren't learned from."""
    rows = docs.select(F.col(id_col), F.col(text_col), F.col(lang_col), held_out(id_col).alias("held_out"))
    model = fit(rows.filter("not held_out"), text_col, lang_col, **settings)
    out = predict(rows, model, id_col, text_col, ("held_out",))
    return out.select(id_col, "held_out", "lang_pred", "score")
