"""Secrets in whole texts: fixed patterns plus sliding-window entropy.

Fixed patterns give the kinds ``assign``, ``access`` and ``hex``. Candidate
strings are what runs of the key alphabet hold outside those spans. Over each
candidate a window of fixed width slides for every character class (hex digits,
letters, letters with digits and marks): a class's window lives as long as its
characters last, and its Shannon entropy is kept by incremental counts. A stretch
with a window that reaches its class's limit makes the candidate an ``entropy``
span, unless an allow-list pattern covers the stretch or the whole candidate; of
a candidate that is allowed as a whole, such as a path with a word of the
allow-list, each part between slashes is tested by itself.

Defined cases: a null text is empty; equal rows give equal rows; an empty table
gives an empty result; columns other than ``doc_id`` and ``text`` are ignored by
the scan, whatever their names; positions count code points, ends exclusive.
Texts are scanned whole, one at a time, in time linear in their length and spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

#: The patterns and least lengths of the base kinds, in listed order.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Window width, and per character class the bits of entropy that a window must reach.
WINDOW = 20
LIMITS = {"hex": 3.0, "letters": 4.1, "mixed": 3.9}
#: Runs that are no secrets: UUIDs, repeated marks, paths and slugs of plain, capital or camel-case words,
#: examples, numbers.
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z"),
    re.compile(r"[^A-Za-z0-9]+\Z"),
    re.compile(r"[A-Z]?[a-z]+(?:[-_/=][A-Z]?[a-z]*)*\Z"),
    re.compile(r"[A-Z]+(?:[-_/=][A-Z]*)*\Z"),
    re.compile(r"[a-z]*(?:[A-Z]{1,3}[a-z]{2,})+[A-Z]{0,3}\Z"),
    re.compile(r".*(?:example|sample|dummy|placeholder)", re.IGNORECASE | re.ASCII),
    re.compile(r"[0-9+/_=-]+\Z"),
)

#: x * log2(x) for the counts that a window can hold.
_XLOG = [0.0] + [x * math.log2(x) for x in range(1, WINDOW + 1)]
_HEX, _LETTERS = frozenset("0123456789abcdefABCDEF"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: Class and alphabet; None: every character of a candidate.
CLASSES = (("hex", _HEX), ("letters", _LETTERS), ("mixed", None))


def window_entropy(run: str, width: int = WINDOW) -> float:
    """The highest Shannon entropy, in bits, of any window; one step a character."""
    xlog = _XLOG if width <= WINDOW else [0.0] + [x * math.log2(x) for x in range(1, width + 1)]
    width = min(width, len(run))
    counts: dict[str, int] = {}
    total = best = 0.0
    for i, c in enumerate(run):
        if i >= width:
            k = counts[run[i - width]]
            total += xlog[k - 1] - xlog[k]
            counts[run[i - width]] = k - 1
        k = counts.get(c, 0)
        total += xlog[k + 1] - xlog[k]
        counts[c] = k + 1
        if i >= width - 1:
            best = max(best, math.log2(width) - total / width)
    return best


def stretches(run: str) -> Iterator[tuple[str, str]]:
    """(class, stretch) of each stretch of a class's alphabet that is as long as a window."""
    for name, alphabet in CLASSES:
        start = 0
        for end in range(len(run) + 1):
            if end == len(run) or alphabet is not None and run[end] not in alphabet:
                if end - start >= WINDOW:
                    yield name, run[start:end]
                start = end + 1
            elif alphabet is None:
                yield name, run
                break


def allowed(run: str) -> bool:
    return any(p.match(run) for p in ALLOW)


def is_random(run: str) -> bool:
    """Whether a stretch of the candidate is too random to be allowed."""
    if len(run) < WINDOW or allowed(run):
        return False
    for name, stretch in stretches(run):
        if name == "mixed" and not (any(c.isdigit() for c in stretch) and any(c.isalpha() for c in stretch)):
            continue
        if not allowed(stretch) and window_entropy(stretch) >= LIMITS[name]:
            return True
    return False


def random_parts(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """The spans that a candidate gives: itself, or its parts between slashes if it is allowed as a whole."""
    run = text[a:b]
    if is_random(run):
        yield a, b
    elif "/" in run and allowed(run):
        for part in run.split("/"):
            if is_random(part):
                yield a, a + len(part)
            a += len(part) + 1


def joined(spans: list[tuple[int, int, int]]) -> list[list[int]]:
    """[start, end] of what sorted spans cover, each stretch once."""
    out: list[list[int]] = []
    for a, _, b in spans:
        if out and a < out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, sorted."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    if runs:
        for a, b in runs:
            found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b)]
        taken = joined(sorted(found))
        k = 0
        for a, b in runs:  # both lists are sorted: walk them together
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            j = k
            while j < len(taken) and taken[j][0] < b:
                found += [(x, 3, y) for x, y in random_parts(text, a, taken[j][0])]
                a = taken[j][1]
                j += 1
            k = max(j - 1, k)
            found += [(x, 3, y) for x, y in random_parts(text, a, b)]
    return sorted(found)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every stretch that spans cover replaced by the mark."""
    out, done = [], 0
    for a, b in joined(find(text)):
        out += [text[done:a], mark]
        done = b
    return "".join([*out, text[done:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = [[], [], []]
        digests, spans = [], []
        for text in batch.column("text"):
            found = find(text.as_py() or "")
            for k in range(3):
                counts[k].append(sum(x[1] == k for x in found))
            digests.append(hashlib.sha256(spelled([x for x in found if x[1] < 3]).encode()).hexdigest())
            spans.append(spelled(found))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Counts and spans of every document; rows stay in their partitions."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), F.col("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _redacted(batches: Iterator[pa.RecordBatch], size: str | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        old = batch.column("text").to_pylist()
        new = [x and redact(x) for x in old]
        batch = batch.set_column(batch.schema.names.index("text"), "text", pa.array(new, pa.string()))
        at = batch.schema.get_field_index(size) if size else -1
        if at >= 0 and pa.types.is_integer(batch.schema.field(at).type):
            sizes = [n if x == y else len(y) for n, x, y in zip(batch.column(at).to_pylist(), old, new, strict=True)]
            batch = batch.set_column(at, size, pa.array(sizes, batch.schema.field(at).type))
        yield batch


def redact_secrets(docs: DataFrame, size: str | None = "n_chars") -> DataFrame:
    """The documents with secrets replaced by a mark; an integer column ``size`` follows changed texts."""
    text_batches(docs.sparkSession)
    return docs.mapInArrow(lambda batches: _redacted(batches, size), docs.schema)
