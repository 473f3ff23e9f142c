"""Secret scans with multipart credential linking.

Strong patterns are reported wherever they match. Weak candidates (a bare
random string, an account name, an endpoint address) mean little alone: they
are reported only when a part that completes them lies in the same scope, that
is within SCOPE code points. The join of parts by scope is an interval join: parts
are sorted by place and each weak one looks for its nearest complement, so a
text with many parts costs n log n and no pairs are listed.

Nulls and odd input: a null or empty text has no spans; rows are independent,
so repeated rows, repeated ids and null ids are scanned as they stand; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points between two parts of one credential, at most.
SCOPE = 200

# Fixed patterns: (kind, expression, group whose length counts, least length).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
WEAK_ID = re.compile(r"""(?<![A-Za-z0-9])(?:client_?id|user(?:name)?|login|account|access_?key_?id)["']?[ ]{0,3}[:=][ ]{0,3}["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""\b(?:https?|s3|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis)://[^\s"'<>]+""", re.I | re.A)

KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
ORDER = {k: i for i, k in enumerate(KINDS)}
BASE = KINDS[:3]
#: The roles whose presence in scope completes a weak kind.
IDENTIFIER, SECRET = ("access", "weak_id"), ("assign", "hex", "weak_secret")
COMPLEMENT = {"weak_id": SECRET, "weak_secret": IDENTIFIER}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def _random_looking(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s)


def weak_candidates(text: str) -> list[tuple[str, int, int]]:
    out = [("weak_id", m.start(), m.end()) for m in WEAK_ID.finditer(text)]
    out += [("weak_secret", m.start(), m.end()) for m in WEAK_SECRET.finditer(text) if _random_looking(m[0])]
    if "://" in text:
        out += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    return out


class _Parts:
    """Spans sorted by place, asked for the nearest one to a span."""

    def __init__(self, spans):
        spans = sorted((s, e) for _, s, e in spans)
        self.starts = [s for s, _ in spans]
        self.reach = []  # largest end so far
        for _, e in spans:
            self.reach.append(max(e, self.reach[-1]) if self.reach else e)

    def near(self, start: int, end: int, scope: int) -> bool:
        last = bisect_right(self.starts, end + scope) - 1  # starts in scope or before the span
        return last >= 0 and self.reach[last] >= start - scope


def link(strong, weak, scope: int = SCOPE) -> list[tuple[str, int, int]]:
    """The weak spans that a complement in scope completes; none that overlaps a strong span."""
    if not weak:
        return []
    held = sorted((s, e) for _, s, e in strong)
    starts = [s for s, _ in held]
    reach = []
    for _, e in held:
        reach.append(max(e, reach[-1]) if reach else e)

    def free(start, end):
        i = bisect_left(starts, end) - 1
        return i < 0 or reach[i] <= start

    weak = [w for w in weak if free(w[1], w[2])]
    every = [*strong, *weak]
    by_role = {role: _Parts([x for x in every if x[0] in role]) for role in (IDENTIFIER, SECRET)}
    kept = [w for w in weak if w[0] in COMPLEMENT and by_role[COMPLEMENT[w[0]]].near(w[1], w[2], scope)]
    credentials = _Parts([*(x for x in strong), *kept])
    return kept + [w for w in weak if w[0] == "endpoint" and credentials.near(w[1], w[2], scope)]


def scan(text: str, scope: int = SCOPE) -> list[tuple[str, int, int]]:
    """All reported spans of a text in order of start, then kind."""
    strong = base_spans(text)
    return sorted(strong + link(strong, weak_candidates(text), scope), key=lambda x: (x[1], ORDER[x[0]], x[2]))


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """(id, spans): the spans of each row's text in code points, end exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t or "", scope)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW)], names=[id_column, "spans"])

    source = docs.select(id_column, F.col("text").cast("string").alias("text"))
    kind = source.schema[id_column].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_column}` {kind}, spans {SPANS}")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, scope: int = SCOPE, mask: str = "[SECRET]") -> DataFrame:
    """docs with every reported span of text replaced by mask; other columns stay, and null stays null."""
    fields = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                pieces, last = [], 0
                for _, s, e in scan(text, scope) if text else ():
                    if s >= last:
                        pieces += [text[last:s], mask]
                    last = max(last, e)
                out.append("".join(pieces) + text[last:] if pieces else text)
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, fields)
