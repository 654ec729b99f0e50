"""Language identification (operator 10): string kernels.

Two passages are as alike as the sets of byte n-grams (one to four bytes) they hold: a blended-spectrum presence kernel
over hashed slots, normalised to 1 for equal sets. The kernel is approximated from landmarks (Nyström): a few training
passages of each language. One-versus-rest kernel ridge regression on the kernel values to the landmarks gives a value
for each language; a text's values are the means over all its passages. A batch of texts is scored by two matrix
products.

Learning takes a bounded sample: of the LANGUAGES most frequent languages the `per_language` rows of smallest hash that
aren't held out, of each at most BAG passages, evenly spaced, and of those `landmarks` by hash, from as many documents as
there are, as landmarks (documented parameters). With many languages each has an equal part of LEARNED rows and MARKS
landmarks, so that the driver's memory is bounded: at most 2 KB for each passage, and sums over SCORED passages at a time.
Scoring takes whole texts, SCORED passages at a time.

A text is unlike every learned language if too few of its n-grams, beyond those that hash there by chance, are found in
the landmarks of any one language. The share doesn't fall with the length of a text, so short texts stay. The limit is
calibrated on learned passages that aren't landmarks: STRAY times the share that all but a hundredth of them reach; without
such passages it is 0.

Cases: null text, and text without a letter, is `und` with score 0, as is all text if there is nothing to learn from;
rows with null language aren't learned from; ties go to the language first by name; very long texts are scored in
passages; repeated rows are scored each by itself, and learned from once; an empty table gives an empty table; other columns take no part.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import held_out, map_rows, slices

SLOTS = 1 << 14
PASSAGE = 1536
PER_LANGUAGE = 200
LANDMARKS = 32
LANGUAGES = 500
LEARNED = 8000  # rows learned from, over all languages
MARKS = 2048  # landmarks, over all languages
BAG = 32  # passages of a text that are learned from, evenly spaced
SCORED = 512  # passages scored at once
RIDGE = 1e-3
STRAY = 0.6
LETTER = regex.compile(r"\p{L}")


def presence(texts: list[str] | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of normalised n-gram presence for each passage, and where each text's passages begin; bytes are of lower-cased text."""
    datas = [t if isinstance(t, bytes) else t.lower().encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(d) for d in datas])
    counts = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    total = int(counts.sum())
    flat = np.frombuffer(b"".join(datas), np.uint8).astype(np.uint32)
    begin = np.cumsum(sizes) - sizes
    rows = np.repeat(first, sizes) + (np.arange(len(flat)) - np.repeat(begin, sizes)) // PASSAGE
    out = np.zeros((total, SLOTS), np.float32)
    cells = out.reshape(-1)
    h = np.zeros(len(flat), np.uint32)
    for n in range(1, 5):
        if len(flat) < n:
            break
        h = (h[: len(flat) - n + 1] * np.uint32(0x01000193)) ^ (flat[n - 1 :] + np.uint32(n))
        slot = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOTS.bit_length() + 1)
        at = rows[: len(slot)]
        inner = at == rows[n - 1 :]
        cells[at[inner] * SLOTS + slot[inner]] = 1
    return normalised(out), first


def spread(packed: np.ndarray) -> np.ndarray:
    """Normalised presence from packed bits, a row for each passage."""
    return normalised(np.unpackbits(packed, axis=1))


def normalised(bits: np.ndarray) -> np.ndarray:
    """Presence scaled so that the product of equal rows is 1."""
    out = bits.astype(np.float32)
    return out / np.maximum(np.sqrt(out.sum(1, keepdims=True)), 1)


@dataclasses.dataclass
class Kernel:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    owner: np.ndarray  # the language of each landmark
    least: float = 0.0  # likeness below which a text is in none of the languages

    def __getstate__(self) -> dict:
        """Tasks get the landmarks as bits."""
        return self.__dict__ | {"landmarks": np.packbits(self.landmarks > 0, axis=1)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, landmarks=spread(state["landmarks"]))

    def values(self, texts: list[str]) -> np.ndarray:
        """A value for each text and language, by two matrix products over the passages."""
        return self.told(texts)[0]

    def told(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The values, and each text's likeness to the language it is most like."""
        sums = [np.zeros((len(texts), len(self.languages))) for _ in range(2)]
        count = np.zeros((len(texts), 1))
        for of, parts in portions(texts):
            phi, first = presence(parts)
            kernel = phi @ self.landmarks.T
            for total, x in zip(sums, (kernel @ self.weights, likeness(phi, kernel, self.landmarks, self.owner)), strict=True):
                np.add.at(total, of, np.add.reduceat(x, first))
            np.add.at(count, of, np.diff(np.append(first, len(phi)))[:, None])
        return sums[0] / count, (sums[1] / count).max(1)


def portions(texts: list[str]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Whole texts, and parts of long ones cut between passages, that together hold at most about SCORED passages; with the number of the text of each."""
    of, parts, held = [], [], 0
    for i, t in enumerate(texts):
        data = t.lower().encode("utf-8", "replace")
        for at in range(0, max(1, len(data)), SCORED * PASSAGE):
            part = data[at : at + SCORED * PASSAGE]
            if held and held + len(part) > SCORED * PASSAGE:
                yield of, parts
                of, parts, held = [], [], 0
            of, parts, held = [*of, i], [*parts, part], held + max(len(part), PASSAGE)
    if of:
        yield of, parts


def likeness(phi: np.ndarray, kernel: np.ndarray, landmarks: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each passage and language the mean share of the passage's n-grams in a landmark, scaled so that chance gives 0 and all of them 1."""
    held, own = (landmarks > 0).sum(1), np.maximum((phi > 0).sum(1), 1)
    chance = np.minimum(held / SLOTS, 0.999)
    share = (kernel * np.sqrt(held) / np.sqrt(own)[:, None] - chance) / (1 - chance)
    return np.stack([share[:, owner == k].mean(1) for k in range(owner.max() + 1)], 1)


def fit(bits: np.ndarray, y: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Kernel:
    """Nyström ridge regression: (CᵀC + n·ridge·K) w = CᵀY with C the kernel to the landmarks and K among them, from packed passages.

    C has a row for each passage and is never held: both products are summed over SCORED passages at a time.
    """
    landmarks = max(1, min(landmarks, MARKS // len(languages)))
    chosen = np.concatenate([np.flatnonzero(y == k)[:landmarks] for k in range(len(languages))])
    marks, owner = spread(bits[chosen]), y[chosen]
    # passages of the sample that are no landmarks; where there is none, nothing tells a limit, and none holds
    spare = np.ones(len(y), bool)
    spare[chosen] = False
    weight = 1 / (len(languages) * np.bincount(y, minlength=len(languages)) / len(y))  # languages count alike, however many rows they have
    left, right, like = np.zeros((len(marks), len(marks))), np.zeros((len(marks), len(languages))), [np.zeros(0)]
    for at in range(0, len(y), SCORED):
        part = slice(at, at + SCORED)
        phi, own, rest = spread(bits[part]), y[part], spare[part]
        c = (phi @ marks.T).astype(float)
        weighted = weight[own][:, None] * c
        left += c.T @ weighted
        right += weighted.T @ np.where(own[:, None] == np.arange(len(languages)), 1.0, -1.0)
        if rest.any():
            like.append(likeness(phi[rest], c[rest], marks, owner)[np.arange(rest.sum()), own[rest]])
    k = (marks @ marks.T).astype(float)
    w = np.linalg.solve(left + len(y) * ridge * k + 1e-6 * np.eye(len(k)), right)
    least = STRAY * float(np.quantile(np.concatenate(like), 0.01)) if spare.any() else 0.0
    return Kernel(languages, marks, w.astype(np.float32), owner, max(0.0, least))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Kernel | None:
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    df = df.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    frequent = [r.lang for r in df.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    if not frequent:
        return None
    df, per_language = df.where(F.col("lang").isin(frequent)), max(1, min(per_language, LEARNED // len(frequent)))
    by_hash = Window.partitionBy("lang").orderBy("h", "doc_id")
    # only ids compete for the places in the sample; the texts of the chosen are fetched by a join with that bounded list
    chosen = df.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("r", F.dense_rank().over(by_hash)).where(F.col("r") <= per_language).select("doc_id", "lang").distinct()
    picked = df.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("doc_id", "text", "lang")

    def make(b: pa.RecordBatch) -> dict:
        texts = b.column(1).to_pylist()
        phi, first = presence(texts)
        ends = np.append(first[1:], len(phi))
        bits = np.packbits(phi > 0, axis=1)
        spaced = [(first[i] + np.unique(np.linspace(0, ends[i] - first[i] - 1, BAG).astype(int))) if LETTER.search(t) else [] for i, t in enumerate(texts)]
        keep, rows = np.repeat(np.arange(len(texts)), [len(k) for k in spaced]), [k for ks in spaced for k in ks]
        return {"doc_id": b.column(0).cast(pa.string()).take(keep), "lang": b.column(2).take(keep), "x": pa.array([bits[k].tobytes() for k in rows], pa.binary())}

    rows = sorted(((zlib.crc32(r.x), r.doc_id, r.lang, bytes(r.x)) for r in map_rows(picked, make, "doc_id string, lang string, x binary", 20).collect()))
    if not rows:
        return None
    # landmarks are the first rows of a language: one passage of each document first
    seen: set[str] = set()
    rows = [r[1:] for r in sorted(rows, key=lambda r: r[1] in seen or seen.add(r[1]) or False)]
    languages = sorted({r[1] for r in rows})
    bits = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
    return fit(bits, np.array([languages.index(r[1]) for r in rows]), languages)


def told(texts: list[str | None], model: Kernel | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The language, its score, (value + 1) / 2 cut to 0..1, and the likeness of each text."""
    spoken = [i for i, t in enumerate(texts) if model and t and LETTER.search(t)]
    out, score, like = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    for i in range(0, len(spoken), 200):
        part = spoken[i : i + 200]
        values, like[part] = model.told([texts[k] for k in part])
        best = values.argmax(1)
        for k, b, v in zip(part, best, values[np.arange(len(best)), best], strict=True):
            out[k] = model.languages[b]
            score[k] = round(float(np.clip((v + 1) / 2, 0, 1)), 6)
    return out, score, like


def predict(texts: list[str | None], model: Kernel | None) -> tuple[list[str], np.ndarray]:
    """The language and its score of each text."""
    return told(texts, model)[:2]


def identify(docs: DataFrame, model: Kernel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score; one row for each row. No shuffle."""
    kind = dict(docs.dtypes)[id_col]

    def make(b: pa.RecordBatch) -> dict:
        lang, score = predict(b.column(1).to_pylist(), model)
        return {"doc_id": b.column(0), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score)}

    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Kernel | None, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows, with all their columns, whose language is told with at least that score and that are like it; without a model, all rows with a letter."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in slices(batches, 500):
            texts = b.column(at).to_pylist()
            lang, score, like = told(texts, model)
            keep = [(x != "und" and s >= least and q >= model.least) if model else bool(t and LETTER.search(t)) for t, x, s, q in zip(texts, lang, score, like, strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
