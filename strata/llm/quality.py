"""Quality classifier (operator 9): attention-based multiple-instance learning.

Every text is cut into passages. Each passage becomes a vector: shares of byte classes, a hashed histogram of byte
trigrams, and how well it compresses. A hidden layer encodes the vector; gated attention, tanh(Vh) * sigmoid(Uh), gives
each passage of a text a weight; the weighted mean of the encodings gives the score of the text. Only labels of whole
documents are learned from, so the weights tell which passages decide.

Learning takes a bounded sample: the `sample` labelled rows of smallest hash that aren't held out, and of each at most BAG
passages, evenly spaced over the text (documented parameters; at most 200 MB of features reach the driver). Scoring takes
whole texts. The model is a few thousand numbers and travels in the task closure.

Cases: null text counts as empty; an empty text is one passage of zeros and gets a score like any other; labels other
than 0 and 1, or null, aren't learned from; with no label at all every score is 0.5, with one class its value; several
labels of one document count as several rows; repeated rows are scored each by itself; an empty table gives an empty
table; other columns take no part; of rows that repeat a labelled doc_id the least text is learned from.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import held_out, keyed_text, map_rows, slices

PASSAGE = 1024
TRIGRAMS = 224
CLASSES = 28
WIDTH = CLASSES + TRIGRAMS + 4
SAMPLE = 6000
BAG = 32  # passages of a text that are learned from, evenly spaced
THRESHOLD = 0.7


def _byte_classes() -> np.ndarray:
    """A class for each byte: kinds of letters, digits, spaces, and each common sign by itself."""
    out = np.full(256, 27, np.int64)
    out[97:123], out[65:91], out[48:58], out[128:] = 0, 1, 2, 3
    for i, c in enumerate(b" \n\t\r.,;:!?'\"-_()[]{}#*$", 4):
        out[c] = min(i, 26)
    for c in b"%&|<>/\\=+@~^`":
        out[c] = 26
    return out


BYTE_CLASS = _byte_classes()


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage, and where each text's passages begin."""
    datas = [t.encode("utf-8", "replace") for t in texts]
    counts = np.array([max(1, -(-len(d) // PASSAGE)) for d in datas])
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    total = int(counts.sum())
    flat = np.frombuffer(b"".join(datas), np.uint8)
    sizes = np.array([len(d) for d in datas])
    begin = np.cumsum(sizes) - sizes
    rows = np.repeat(first - 0, sizes) + (np.arange(len(flat)) - np.repeat(begin, sizes)) // PASSAGE
    length = np.bincount(rows, minlength=total).astype(np.float32) if len(flat) else np.zeros(total, np.float32)
    out = np.zeros((total, WIDTH), np.float32)
    if len(flat):
        out[:, :CLASSES] = np.bincount(rows * CLASSES + BYTE_CLASS[flat], minlength=total * CLASSES).reshape(total, CLASSES)
        wide = flat.astype(np.uint32)
        if len(flat) > 2:
            gram = ((wide[:-2] * np.uint32(0x9E3779B1) ^ wide[1:-1] * np.uint32(0x85EBCA6B) ^ wide[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(7)) % np.uint32(TRIGRAMS)
            inner = rows[:-2] == rows[2:]
            out[:, CLASSES : CLASSES + TRIGRAMS] = np.bincount(rows[:-2][inner] * TRIGRAMS + gram[inner], minlength=total * TRIGRAMS).reshape(total, TRIGRAMS)
        norm = np.maximum(length, 1)[:, None]
        out[:, : CLASSES + TRIGRAMS] = np.sqrt(out[:, : CLASSES + TRIGRAMS] / norm)
    packer = zstandard.ZstdCompressor(level=1)
    ratio = np.array([len(p) / len(packer.compress(p)) if p else 0.0 for d in datas for p in ([d[i : i + PASSAGE] for i in range(0, len(d), PASSAGE)] or [b""])], np.float32)
    out[:, -4] = np.log1p(length) / 7
    out[:, -3] = np.log1p(ratio)
    out[:, -2] = np.maximum(ratio - 2.2, 0) / 4
    out[:, -1] = length == 0
    return out, first


@dataclasses.dataclass
class Attention:
    """Weights of the encoder (w, b), of the gated attention (v, u, a) and of the score (c, d)."""

    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    d: np.ndarray

    def _forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        sizes = np.diff(np.append(first, len(x)))
        doc = np.repeat(np.arange(len(first)), sizes)
        h = np.tanh(x @ self.w + self.b)
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        e = (t * g) @ self.a
        e = np.exp(e - np.maximum.reduceat(e, first)[doc])
        alpha = e / np.add.reduceat(e, first)[doc]
        z = np.add.reduceat(alpha[:, None] * h, first)
        p = 1 / (1 + np.exp(-np.clip(z @ self.c + self.d, -30, 30)))
        return {"doc": doc, "h": h, "t": t, "g": g, "alpha": alpha, "z": z, "p": p}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self._forward(x, first)["p"]

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy, by the chain rule from the score back to the encoder."""
        f = self._forward(x, first)
        doc, h, t, g, alpha = f["doc"], f["h"], f["t"], f["g"], f["alpha"]
        dl = (f["p"] - y) / len(y)
        dz = dl[:, None] * self.c
        dalpha = (dz[doc] * h).sum(1)
        de = alpha * (dalpha - np.add.reduceat(alpha * dalpha, first)[doc])
        dt, dg = de[:, None] * self.a * g * (1 - t * t), de[:, None] * self.a * t * g * (1 - g)
        dh = alpha[:, None] * dz[doc] + dt @ self.v.T + dg @ self.u.T
        dpre = dh * (1 - h * h)
        return {"w": x.T @ dpre, "b": dpre.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": f["z"].T @ dl, "d": dl.sum()}


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 60, batch: int = 256, rate: float = 0.01, seed: int = 7) -> Attention:
    """Adam over shuffled batches of documents, weight decay on the matrices; the order is fixed by the seed."""
    rng = np.random.default_rng(seed)
    m = Attention(
        rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.2, (hidden, gate)), rng.normal(0, 0.2, (hidden, gate)), rng.normal(0, 0.2, gate), rng.normal(0, 0.2, hidden), np.zeros(())
    )
    names = [f.name for f in dataclasses.fields(m)]
    mean, square = {k: 0.0 for k in names}, {k: 0.0 for k in names}
    sizes = np.diff(np.append(first, len(x)))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(first))
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            rows = np.concatenate([np.arange(first[k], first[k] + sizes[k]) for k in part])
            grads = m.gradients(x[rows], np.concatenate([[0], np.cumsum(sizes[part])[:-1]]), y[part])
            step += 1
            for k in names:
                grad = grads[k] + (1e-4 * getattr(m, k) if k in "wvu" else 0)
                mean[k] = 0.9 * mean[k] + 0.1 * grad
                square[k] = 0.999 * square[k] + 0.001 * grad * grad
                move = rate * (1 - epoch / (epochs + 1)) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
                setattr(m, k, getattr(m, k) - move)
    return m


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Attention | float:
    """The model of the bounded sample; without two classes, the constant score."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    texts = keyed_text(docs, id_col, text_col).join(F.broadcast(marks.distinct()), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # one row for each, however often a doc_id repeats

    def make(b: pa.RecordBatch) -> dict:
        x, first = passages(b.column(2).to_pylist())
        ends = np.append(first[1:], len(x))
        bags = [x[s + np.unique(np.linspace(0, e - s - 1, BAG).astype(int))].tobytes() for s, e in zip(first, ends, strict=True)]
        return {"doc_id": b.column(0).cast(pa.string()), "label": b.column(1), "x": pa.array(bags, pa.binary())}

    rows = sorted((r.doc_id, r.label, bytes(r.x)) for r in map_rows(texts, make, "doc_id string, label int, x binary", 200).collect())
    y = np.array([r[1] for r in rows], float)
    if len(set(y)) < 2:
        return float(y[0]) if len(y) else 0.5
    parts = [np.frombuffer(r[2], np.float32).reshape(-1, WIDTH) for r in rows]
    return fit(np.concatenate(parts).astype(float), np.cumsum([0, *(len(p) for p in parts[:-1])]), y)


def scores(texts: list[str], model: Attention | float) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(texts), model)
    x, first = passages(texts)
    return np.round(model.score(x, first), 6)


def score_documents(docs: DataFrame, model: Attention | float, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted; one row for each row. No shuffle."""
    kind = dict(docs.dtypes)[id_col]

    def make(b: pa.RecordBatch) -> dict:
        s = scores(b.column(1).to_pylist(), model)
        return {"doc_id": b.column(0), "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))}

    return map_rows(keyed_text(docs, id_col, text_col), make, f"doc_id {kind}, score double, predicted int", 500)


def keep_good(docs: DataFrame, model: Attention | float, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose text scores at least the threshold."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in slices(batches, 500):
            yield b.filter(pa.array(scores([t or "" for t in b.column(at).to_pylist()], model) >= threshold))

    return docs.mapInArrow(run, docs.schema)
