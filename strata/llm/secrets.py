"""Secret scans (operator 8): plain patterns, and credentials whose parts are linked across a scope.

Plain patterns are reported wherever they match. Identifiers, bare secrets and endpoints are weak: alone they are
ordinary text. They are joined as intervals: two parts meet if no more than `scope` characters lie between them. A weak
identifier is reported if it meets a secret, a weak secret if it meets an identifier or an endpoint, an endpoint if it
meets both an identifier and a secret. Access identifiers and assignments that the plain patterns found take part as
identifiers and secrets, and keep their own spans.

Cases: null text counts as empty and has no spans; texts of any length are scanned whole; equal spans of one kind appear
once; repeated rows are scanned each by itself; an empty table gives an empty table; other columns take no part.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import keyed_text, map_rows, slices

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
SCOPE = 240

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the greedy run after AKIA, dropped if short: no later match can begin inside a dropped one
HEX = re.compile(r"[0-9a-f]{24,}")
IDENTIFIER = re.compile(r"""(?:user(?:name)?|login|account|client_?id|access_?(?:key_?)?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.ASCII | re.IGNORECASE)
IDENTIFIER_HINTS = ("user", "login", "account", "client", "access")
ENDPOINT = re.compile(r"""https?://[^\s"'<>]+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::[0-9]+)?""", re.ASCII | re.IGNORECASE)
ENDPOINT_HINTS = ("://", "host", "endpoint", "server")
BARE = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")

Span = tuple[int, int, int]


def plain_spans(text: str, low: str) -> list[Span]:
    """(start, kind, end) of the plain patterns, each kind leftmost and without overlaps."""
    found: list[Span] = []
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def looks_random(run: str) -> bool:
    return any(c.isdigit() for c in run) and any(c.islower() for c in run) and any(c.isupper() for c in run)


def meets(spans: list[tuple[int, int]], others: list[tuple[int, int]], scope: int) -> list[bool]:
    """Interval join by sorted starts: which spans have another with no more than `scope` characters between (-1: with a character in common).

    The others are widened by the scope, and merged, first.
    """
    merged: list[list[int]] = []
    for s, e in sorted(others):
        if merged and s - scope <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e + scope)
        else:
            merged.append([s - scope, e + scope])
    starts = [m[0] for m in merged]
    out = []
    for s, e in spans:
        k = bisect_right(starts, e) - 1
        out.append(k >= 0 and merged[k][1] >= s)
    return out


def linked_spans(text: str, low: str, plain: list[Span], scope: int = SCOPE) -> list[Span]:
    """The weak parts that complementary parts in their scope confirm."""
    access = [(s, e) for s, k, e in plain if k == 1]
    known = [(s, e) for s, k, e in plain if k != 1]
    weak_ids = [m.span() for m in IDENTIFIER.finditer(text)] if any(h in low for h in IDENTIFIER_HINTS) else []
    ends = [m.span() for m in ENDPOINT.finditer(text)] if any(h in low for h in ENDPOINT_HINTS) else []
    if not (access or weak_ids or ends):
        return []
    taken = [(s, e) for s, _, e in plain] + ends
    bare = [m.span() for m in BARE.finditer(text) if looks_random(m[0])]
    inside = meets(bare, taken, -1)
    bare = [b for b, hit in zip(bare, inside, strict=True) if not hit]
    ids, secrets = access + weak_ids, known + bare
    near = lambda a, b: meets(a, b, scope)
    found = [(s, 3, e) for (s, e), hit in zip(weak_ids, near(weak_ids, secrets), strict=True) if hit]
    found += [(s, 4, e) for (s, e), hit in zip(bare, near(bare, ids + ends), strict=True) if hit]
    found += [(s, 5, e) for (s, e), a, b in zip(ends, near(ends, ids), near(ends, secrets), strict=True) if a and b]
    return found


def scan(text: str, scope: int = SCOPE) -> tuple[list[Span], list[Span]]:
    """The plain spans, and all spans, each by start and kind."""
    low = text.lower()
    plain = plain_spans(text, low)
    return plain, sorted({*plain, *linked_spans(text, low, plain, scope)})


def written_out(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, n_<kind> for the plain kinds, base_spans, spans; offsets in code points, ends exclusive. No shuffle."""
    kind = dict(docs.dtypes)[id_col]

    def make(b: pa.RecordBatch) -> dict:
        got = [scan(t, scope) for t in b.column(1).to_pylist()]
        out = {"doc_id": b.column(0)}
        for k in range(3):
            out[f"n_{KINDS[k]}"] = pa.array([sum(x[1] == k for x in plain) for plain, _ in got], pa.int64())
        return out | {"base_spans": pa.array([written_out(p) for p, _ in got], pa.string()), "spans": pa.array([written_out(a) for _, a in got], pa.string())}

    return map_rows(keyed_text(docs, id_col, text_col), make, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_spans string, spans string")


def redacted(text: str, mark: str = "[secret]", scope: int = SCOPE) -> str:
    """The text with every reported span, overlapping ones as one, replaced by a mark. Endpoints stay: they are no secret."""
    out, at = [], 0
    for s, k, e in scan(text, scope)[1]:
        if k != 5 and e > at:
            out += [text[at : max(s, at)], mark if s >= at else ""]
            at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, secrets in the text replaced. Null text stays null."""

    at = docs.columns.index(text_col)

    def run(batches):
        for b in slices(batches):
            texts = [t if t is None else redacted(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, docs.schema)
