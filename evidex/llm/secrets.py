"""Secret scans: fixed patterns, plus sliding-window Shannon entropy by character class.

Base kinds are leftmost, non-overlapping pattern matches that pass a length
test.  The entropy method then looks at candidate strings (long runs of key
characters that mix letters and digits), slides a window of fixed length over
each, keeps the window's entropy up to date from incremental character counts
and reports the parts of the candidate (cut after ``=``) that hold a window above
the threshold of its character class.  Runs of a narrower class inside a candidate
(a hex key after a name or path) are tested by that class and reported whole.
Candidates and runs that an allow-list pattern covers are left out, and so are all without
a digit: words of any language run together look the same.  Of random keys of 20 letters and
digits some 6 per cent have too little entropy or no digit and are not found, of 32 under 1 per cent.

Cases: a null or empty text has no spans; repeated rows each get their own row;
texts of any length are scanned whole, in one pass per pattern; an empty table
gives an empty result with the same columns; other columns of the input are
not read.  Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from evidex.llm.common import bounded_batches, table

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGIT = re.compile(r"[0-9]")
#: A name or a value of a candidate; hits of its windows are widened to the whole of it.
_PART = re.compile(r"[^=]+=*|=+")
#: Character classes of candidates: name, full-match pattern, window, bits per character needed.
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]+"), 16, 2.8),
    ("base32", re.compile(r"[A-Z2-7=]+"), 20, 3.4),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 20, 3.7),
)
#: Strings that look random but are no secrets: UUIDs, dates, numbers, words joined by separators.
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"\d{4}-\d{2}-\d{2}[-T_0-9]*",
    r"[-+/_=0-9]+",
    r"[-A-Za-z+/_=]+\d{0,4}",
    r"(?:[A-Za-z]+|\d{1,4})(?:[-+/_=](?:[A-Za-z]+|\d{1,4}))+",
)
#: Byte classes used to tell quickly that a text holds no long run of hex digits.
_HEX_MAP = bytes(120 if chr(b) in "0123456789abcdef" else 46 for b in range(256))


def windows_above(s: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Union of the windows of ``s`` whose Shannon entropy is ``bits`` or more, from incremental counts."""
    window = min(window, len(s))
    if not window:
        return []
    gain = [0.0] + [k * math.log2(k) for k in range(1, window + 1)]
    counts: dict[str, int] = {}
    total = 0.0  # sum of k log k over the characters of the window
    spans: list[tuple[int, int]] = []
    for i, ch in enumerate(s):
        if i >= window:
            k = counts[s[i - window]]
            total -= gain[k] - gain[k - 1]
            counts[s[i - window]] = k - 1
        k = counts.get(ch, 0)
        total += gain[k + 1] - gain[k]
        counts[ch] = k + 1
        if i + 1 >= window and math.log2(window) - total / window >= bits:
            start = i + 1 - window
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


class Scanner:
    """Finds the spans of one text; compiled once per task."""

    def __init__(self, allow: tuple[str, ...] = ALLOW, classes=CLASSES):
        self.allow = [re.compile(a) for a in allow]
        self.classes = classes

    def entropy_spans(self, text: str) -> list[tuple[int, int]]:
        found = []
        for m in _CANDIDATE.finditer(text):
            s = m.group()
            if self._plain(s):
                continue
            spans = []
            for _, pattern, window, bits in self.classes:
                if pattern.fullmatch(s):
                    hits = windows_above(s, window, bits)
                    if hits:
                        spans += [p.span() for p in _PART.finditer(s) if any(a < p.end() and p.start() < b for a, b in hits)]
                    break
                # a name or path before a key of a narrower class does not change the key's class
                spans += [r.span() for r in re.finditer(pattern.pattern, s) if r.end() - r.start() >= 20 and not self._plain(r.group()) and windows_above(r.group(), window, bits)]
            done = -1
            for a, b in sorted(spans):
                if a <= done:
                    found[-1] = (found[-1][0], max(found[-1][1], m.start() + b))
                else:
                    found.append((m.start() + a, m.start() + b))
                done = max(done, b)
        return found

    def _plain(self, s: str) -> bool:
        return not _DIGIT.search(s) or s.isdigit() or any(a.fullmatch(s) for a in self.allow)

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, kind index, end), sorted."""
        if not text:
            return []
        found = []
        if ":" in text or "=" in text:
            found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
        if b"x" * 24 in text.encode("utf-8", "surrogatepass").translate(_HEX_MAP):
            found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        if _DIGIT.search(text):
            found += [(a, 3, b) for a, b in self.entropy_spans(text)]
        return sorted(found)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Per row: id and ``secrets`` array<struct<kind,start,end>>, by start then kind order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(allow)
        for batch in batches:
            out = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scanner.spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(SPAN))], ["id", "secrets"])

    picked = bounded_batches(docs).select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(scan, f"id {kind}, secrets array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """All columns of ``docs``; overlapping or touching spans of a text become one ``mark``."""
    columns = docs.columns
    at = columns.index(text_col)

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(allow)
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                spans = scanner.spans(text)
                if spans:
                    parts, done = [], 0
                    for a, _, b in spans:
                        if a > done or not parts:
                            parts += [text[done:a], mark]
                        done = max(done, b)
                    text = "".join([*parts, text[done:]])
                out.append(text)
            arrays = list(batch.columns)
            arrays[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return bounded_batches(docs).mapInArrow(redact, docs.schema)


def digest_rows(docs: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of the base spans and all spans as text, from :func:`find_secrets`."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            sha, texts = [], []
            for spans in batch.column(1).to_pylist():
                named = [(f"{s['kind']}:{s['start']}:{s['end']}", s["kind"]) for s in spans]
                for k in range(3):
                    counts[k].append(sum(kind == KINDS[k] for _, kind in named))
                sha.append(hashlib.sha256(",".join(x for x, kind in named if kind != "entropy").encode()).hexdigest())
                texts.append(",".join(x for x, _ in named))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return find_secrets(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text")).mapInArrow(digests, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    return digest_rows(table(spark, sf_dir, "documents"))
