"""URL filters (operator 2): rules by host and path, and for the rest a ratio of two character language models.

Urls that a rule allows and urls that a rule blocks each train a variable-order Markov model over the characters of host
and path: the chance of a character after its last 0 to 4 characters, each order smoothed by the next lower one. The
verdict compares the difference of the two log-likelihoods, divided by the length, with a threshold. The threshold is
calibrated on a fourth of the ruled urls that trained nothing: it makes the mean error of both kinds least.

The counts cover every ruled url and are exact: a row for each n-gram and each context, whose bytes are the key, so the
model grows with what the ruled urls hold. It is joined, so no task needs to hold all of it: urls are scored in batches,
each with the rows of the model that its own n-grams ask for.

Cases: null url, and url without ://, has an empty host and path, fits no rule and scores 0; a url scores 0 where one of
the two kinds has no url to learn from, and the threshold is then 0; a score equal to the threshold allows; very long
urls are scored whole; repeated rows are judged each by itself; an empty table gives an empty table; other columns take
no part.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import held_out, slices
from strata.session import written

ORDERS = 5
BATCH = 11  # bits: urls scored together
SMOOTH = 2.0
BINS = 1024

#: (verdict, host, path) of the rules in force.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    host = rest[: slash if slash >= 0 else end]
    return host.translate(_LOWER), rest[len(host) : end]


def index(rules: tuple[tuple[str, str, str], ...]) -> dict[str, list[tuple[str, str]]]:
    """Rules by host, so a url looks up its own host and the hosts above it, however many rules there are."""
    out: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, path in rules:
        out.setdefault(host, []).append((path, verdict))
    return out


def matched(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits; of equal length, the one with the longer host, then block."""
    best = None
    while host:
        for prefix, verdict in rules.get(host, ()):
            if path.startswith(prefix):
                key = (len(host) + len(prefix), len(host), verdict == "block", host + prefix, verdict)
                best = max(best, key) if best else key
        host = host.partition(".")[2]
    return best and (best[3], best[4])


def grams(urls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each order the key of each character with its context and of the context alone; and the url of each character.

    A key is the order and kind of n-gram above 40 bits, and below them its bytes, the last of the context first.
    """
    datas = [u.encode("utf-8", "replace") for u in urls]
    pad = bytes(ORDERS - 1)
    flat = np.frombuffer(b"".join(pad + d for d in datas), np.uint8).astype(np.int64)
    sizes = np.array([len(d) for d in datas], np.int64)
    owner = np.repeat(np.arange(len(datas)), sizes)
    at = np.arange(int(sizes.sum())) + (ORDERS - 1) * (owner + 1)
    joint, context = np.empty((ORDERS, len(at)), np.int64), np.empty((ORDERS, len(at)), np.int64)
    before = np.zeros(len(at), np.int64)
    for k in range(ORDERS):
        if k:
            before = before | flat[at - k] << 8 * (k - 1)
        context[k] = before | 2 * k << 40
        joint[k] = before << 8 | flat[at] | 2 * k + 1 << 40
    return joint, context, owner


def score(urls: list[str], keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean over the characters of log p(allowed) - log p(blocked), from the counts by kind of all n-grams that the urls hold, keys sorted."""
    joint, context, owner = grams(urls)
    keys, counts = np.append(keys, np.int64(1) << 62), np.append(counts, np.zeros((2, 1), np.int64), 1)

    def found(x: np.ndarray) -> np.ndarray:
        i = np.searchsorted(keys, x)
        return np.where(keys[i] == x, counts[:, i], 0)

    p = np.full((2, joint.shape[1]), 1 / 256)
    for k in range(ORDERS):
        p = (found(joint[k]) + SMOOTH * p) / (found(context[k]) + SMOOTH)
    logs = np.log(p)
    total = np.bincount(owner, logs[0] - logs[1], len(urls))
    return total / np.maximum(np.bincount(owner, minlength=len(urls)), 1)


@dataclasses.dataclass
class Ratio:
    """key, allowed, blocked: how often urls of either kind hold an n-gram or context. None where one kind has no url to learn from."""

    counts: DataFrame | None
    threshold: float = 0.0


def parsed(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, ruled (allow, block or null)."""
    kind = dict(pages.dtypes)[id_col]
    found = index(rules)

    def run(batches):
        for b in slices(batches, 5000):
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            hits = [matched(*p, found) for p in parts]
            columns = [[p[0] for p in parts], [p[1] for p in parts], [h and h[0] for h in hits], [h and h[1] for h in hits]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in columns)], names=["page_id", "host", "path", "rule", "ruled"])

    df = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    return df.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, ruled string")


def train(urls: DataFrame) -> Ratio:
    """The two models from every ruled url outside the calibration fold, and the threshold from that fold."""
    ruled = urls.where(F.col("ruled").isNotNull()).select("host", "path", (F.col("ruled") == "block").cast("int").alias("kind"), held_out("page_id").alias("fold"))

    def count(batches):
        for b in slices(batches, 5000):
            joint, context, owner = grams([h + p for h, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])
            keys, at = np.unique(np.concatenate([joint, context]), return_inverse=True)
            blocked = np.bincount(at.ravel(), np.tile(b.column(2).to_numpy()[owner], 2 * ORDERS), len(keys)).astype(np.int64)
            every = np.bincount(at.ravel(), minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(every - blocked), pa.array(blocked)], names=["key", "allowed", "blocked"])

    counted = ruled.where("not fold").mapInArrow(count, "key long, allowed long, blocked long")
    counts = written(counted.groupBy("key").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")), "url_grams")
    if not counts.where("key = 0 and allowed > 0 and blocked > 0").count():  # key 0: the empty context
        return Ratio(None)
    return Ratio(counts, calibrated(scored(ruled.where("fold"), Ratio(counts), ["kind"])))


def scored(urls: DataFrame, model: Ratio, keep: list[str]) -> DataFrame:
    """The columns to keep, and score."""
    df = urls.select("host", "path", *keep)
    if model.counts is None:
        return df.withColumn("score", F.lit(0.0))
    # written, so that the numbers of the batches are fixed
    rows = written(df.withColumn("batch", F.shiftright(F.monotonically_increasing_id(), BATCH)), "urls")

    def texts(b) -> list[str]:
        return [h + p for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]

    def needed(batches):
        for b in slices(batches, 5000):
            joint, context, owner = grams(texts(b))
            batch = b.column("batch").to_numpy()
            for k in np.unique(batch):
                of = batch[owner] == k
                keys = np.unique(np.concatenate([joint[:, of], context[:, of]]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k)), pa.array(keys)], names=["batch", "key"])

    def judged(mine: pa.Table, grams_: pa.Table) -> pa.Table:
        keys = grams_.column("key").to_numpy()
        order = np.argsort(keys)
        counts = np.array([grams_.column(c).to_numpy()[order] for c in ("allowed", "blocked")])
        return mine.drop_columns(["batch"]).append_column("score", pa.array(score(texts(mine), keys[order], counts)))

    asked = rows.select("host", "path", "batch").mapInArrow(needed, "batch long, key long").join(model.counts, "key").select("batch", "key", "allowed", "blocked")
    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", score double"
    return rows.groupBy("batch").cogroup(asked.groupBy("batch")).applyInArrow(judged, schema)


def calibrated(scores: DataFrame) -> float:
    """The bin border with the least mean error of both kinds; of several the one nearest to 0. At most 2 * BINS rows reach the driver."""
    bins = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + 4) * (BINS / 8)).cast("int")))
    rows = scores.groupBy("kind", bins.alias("bin")).count().collect()
    hist = np.zeros((2, BINS))
    for r in rows:
        hist[r.kind, r.bin] = r["count"]
    if not (hist.sum(1) > 0).all():
        return 0.0
    allowed_under, blocked_over = np.append(0, np.cumsum(hist[0])) / hist[0].sum(), 1 - np.append(0, np.cumsum(hist[1])) / hist[1].sum()
    error, border = allowed_under + blocked_over, np.arange(BINS + 1) * 8 / BINS - 4
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(border[best[np.argmin(np.abs(border[best]))]])


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score; one row for each row."""
    urls = parsed(pages, rules, id_col, url_col)
    model = train(urls)
    df = scored(urls, model, ["page_id", "rule", "ruled"])
    verdict = F.coalesce("ruled", F.when(F.col("score") >= model.threshold, "allow").otherwise("block"))
    return df.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
