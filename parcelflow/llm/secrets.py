"""Secret scans with multipart credential linking.

Base kinds (assign, access, hex) are reported wherever they match. Weak candidates, which alone are too common to
report, are a short assigned value (`weak`), a web address (`endpoint`), a long value assigned to a name that goes on after
its keyword (`named`), a bare token of high entropy (`bare`) and a short access identifier (`id`). Per document, the
spans of identifiers, secrets and endpoints are interval-joined on their positions, widened by SCOPE code points: a
weak candidate is reported only when a complementary part lies in its scope, that is, identifier with
secret, secret with endpoint, identifier with endpoint. Short assigned values link to identifiers alone. A sorted sweep
does the join, so a text with many spans costs n log n.

Null and empty texts have no spans; null ids stay. Offsets are code points, ends exclusive; spans that start together are told in
the order of kinds. Repeated rows repeat. scan reads only doc_id and text; redact keeps all columns, whatever their names. A text
must fit in a task; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slabs, table

SCOPE = 200
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
SPACE = re.compile(r"\s")
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]+")
# The weak patterns: names like secret_access_key, and tokens that may be secrets.
NAMED = re.compile(r"""(?:password|passwd|secret|token|api_?key)[A-Za-z0-9_-]{1,40}["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
SOLID = re.compile(r"[A-Za-z0-9]{20,}")
CLASSES = [re.compile(p) for p in ("[a-z]", "[A-Z]", "[0-9]")]
KINDS = ("assign", "access", "hex", "weak", "endpoint", "named", "bare", "id")
# Kinds in whose scope a weak kind is reported.
COMPLEMENTS = {3: (1, 7), 4: (0, 1, 2, 5, 6, 7), 5: (1, 4, 7), 6: (1, 4, 7), 7: (0, 2, 3, 4, 5, 6)}


def _entropy(token: str) -> float:
    """Bits a character."""
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values())


def _random(token: str, in_url: bool) -> bool:
    """Letters and digits mixed in one run; or, outside a web address, with marks between but both cases."""
    for run in SOLID.findall(token):
        if CLASSES[2].search(run) and not run.isdigit() and _entropy(run) >= 3.5:
            return True
    return not in_url and all(c.search(token) for c in CLASSES) and _entropy(token) >= 4


def _weak(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Named values, and bare tokens of which no other span holds the whole."""
    known = {e for _, k, e in base if k in (0, 3)}
    named = [(m.start(), 5 if m.end(1) - m.start(1) >= 12 else 3, m.end()) for m in NAMED.finditer(text) if m.end() not in known]
    spans = sorted(base + named)
    starts, ends = [s[0] for s in spans], list(accumulate((s[2] for s in spans), max))
    out, at, after = named, 0, False
    for a, b in [(s[0], s[2]) for s in spans if s[1] == 4] + [(len(text), len(text))]:
        # Of an address, what follows the host up to white space.
        space = SPACE.search(text, at, max(at, a)) if after else None
        stop = at if not after else space.start() if space else max(at, a)
        for m in TOKEN.finditer(text, at, max(at, a)):
            k = bisect.bisect_right(starts, m.start()) - 1
            if (k < 0 or ends[k] < m.end()) and _random(m[0], m.start() < stop):
                out.append((m.start(), 6, m.end()))
        at, after = max(at, b), True
    return out


def find(text: str | None, scope: int = SCOPE) -> list[tuple[int, int, int]]:
    """Spans (start, kind as an index of KINDS, end), sorted."""
    if not text:
        return []
    base, weak = [], []
    for m in ASSIGN.finditer(text):
        (base if m.end(2) - m.start(2) >= 12 else weak).append((m.start(), 0 if m.end(2) - m.start(2) >= 12 else 3, m.end()))
    for m in ACCESS.finditer(text):
        (base if m.end() - m.start() >= 18 else weak).append((m.start(), 1 if m.end() - m.start() >= 18 else 7, m.end()))
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    weak += [(m.start(), 4, m.end()) for m in ENDPOINT.finditer(text)]
    # Without an identifier or an endpoint there is nothing that complements.
    if not any(s[1] in (1, 4, 7) for s in base + weak):
        return sorted(base)
    weak += _weak(text, base + weak)
    index = {}
    for k, kinds in COMPLEMENTS.items():
        spans = sorted(s for s in base + weak if s[1] in kinds)
        index[k] = ([s[0] for s in spans], list(accumulate((s[2] for s in spans), max)))
    linked = []
    for s in weak:
        starts, ends = index[s[1]]
        at = bisect.bisect_right(starts, s[2] + scope) - 1
        if at >= 0 and ends[at] >= s[0] - scope:
            linked.append(s)
    return sorted(base + linked)


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, all spans."""

    def row(text):
        spans = find(text, scope)
        told = lambda ss: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in ss)
        n = [sum(s[1] == k for s in spans) for k in range(len(KINDS))]
        return (*n[:3], hashlib.sha256(told([s for s in spans if s[1] < 3]).encode()).hexdigest(), told(spans), sum(n[3:]))

    def run(batches):
        for b in slabs(batches):
            got = [row(t) for t in b["text"].to_pylist()]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array([g[i] for g in got], t) for i, t in enumerate(types))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = "<SECRET>") -> DataFrame:
    """The documents with every span replaced by a mark; n_chars, where present, follows the text."""
    at = docs.columns.index("text")

    def hide(text):
        out, end = [], 0
        for a, _, b in find(text, scope):
            if b <= end:
                continue
            if a >= end:
                out += [text[end:a], mark]
            end = b
        return text if not out else "".join(out) + text[end:]

    def run(batches):
        for b in slabs(batches):
            yield b.set_column(at, "text", pa.array([hide(t) for t in b["text"].to_pylist()], pa.string()))

    out = mapped(docs, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
