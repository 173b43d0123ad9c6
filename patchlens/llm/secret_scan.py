"""Secret scan: patterned secrets, and high-entropy strings found by a sliding window.

Edge cases: a null text counts as empty; a text without findings gives zero counts, an empty `spans` and the digest
of the empty string; repeated rows each give their row; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
KEYWORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "entropy")

#: Least bits a character over a window, by the characters that the window holds.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8, "letters": 4.1}
WINDOW = 20
#: Whole candidates that look random and are none: identifiers by rule, paths of short parts, a documentation sample.
#: No two ways lead through any of them, so a match takes time in proportion to the string.
ALLOWED = (
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r"/?[a-z_-]{1,15}\d{0,3}(?:/[a-z_-]{1,15}\d{0,3})*/?",
    r"[A-Z]?[a-z]+(?:[A-Z][a-z]+)*\d{0,4}",
    r"[+/_=-]+",
    r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",
)
#: Alphabets and placeholders: no window reaches over one, the rest of the candidate is looked at.
SAMPLES = re.compile(
    r"(?i:abcdefghijkl(?:mnopqrstuvwxyz)?|0123456789(?:abcdef)?|example|placeholder|changeme|x{6,})")

SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
          "n_entropy long")


def char_class(lower: int, upper: int, digits: int, hexes: int, size: int) -> str | None:
    """Class of a window by its counts; None where prose would look the same."""
    if hexes == size and digits >= 4 and (lower + upper) >= 2:
        return "hex"
    symbols = size - lower - upper - digits
    if digits >= 2 and lower + upper >= 4:
        return "base64" if symbols or (lower and upper) else "alnum"
    return "letters" if lower >= 5 and upper >= 5 else None


def entropy_spans(text: str, start: int, end: int, window: int, thresholds: dict[str, float]):
    """Merged spans of the windows of text[start:end] whose entropy reaches their class's threshold.

    One pass: a character that enters or leaves changes its count, the sum of c*log2(c) and the class counts.
    """
    n_log = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    kinds = [0, 0, 0, 0]  # lower, upper, digits, hexadecimal
    top = math.log2(window)
    spans: list[list[int]] = []

    def shift(c: str, by: int) -> None:
        nonlocal total
        had = counts.get(c, 0)
        counts[c] = had + by
        total += n_log[had + by] - n_log[had]
        kinds[0] += by * ("a" <= c <= "z")
        kinds[1] += by * ("A" <= c <= "Z")
        kinds[2] += by * ("0" <= c <= "9")
        kinds[3] += by * (c in "0123456789abcdefABCDEF")

    for i in range(start, end):
        if i - start >= window:
            shift(text[i - window], -1)
        shift(text[i], 1)
        if i - start + 1 < window:
            continue
        kind = char_class(*kinds, window)
        if kind and top - total / window >= thresholds[kind] - 1e-12:
            if spans and i - window + 1 <= spans[-1][1]:
                spans[-1][1] = i + 1
            else:
                spans.append([i - window + 1, i + 1])
    return spans


def scan(text: str, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS, allowed=None):
    """(base findings, added findings) of one text, each (start, kind number, end)."""
    allowed = allowed or re.compile("|".join(f"(?:{x})" for x in ALLOWED))
    base = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    added = []
    for m in CANDIDATE.finditer(text):
        cuts = [m.start(), *(m.start() + x for hit in SAMPLES.finditer(m[0]) for x in hit.span()), m.end()]
        if allowed.fullmatch(m[0]):
            continue
        for i, j in zip(cuts[::2], cuts[1::2]):
            # letters of one case alone belong to no class: nothing to look at
            s = text[i:j]
            if len(s) < window or s.isalpha() and (s[1:].islower() or s.isupper()) or allowed.fullmatch(s):
                continue
            for a, b in entropy_spans(text, i, j, window, thresholds):
                if not any(x <= a and b <= y for x, _, y in base):
                    added.append((a, 3, b))
    return base, added


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 thresholds: dict[str, float] | None = None, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """One row per document: counts by kind, a digest of the patterned spans, and all spans.

    `allowed`: patterns of whole candidate strings that are never reported for their entropy alone; patterned
    findings always stay. Each row is worked on alone, so nothing is shuffled.
    """
    limits = THRESHOLDS | (thresholds or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip = re.compile("|".join(f"(?:{x})" for x in allowed)) if allowed else re.compile(r"(?!)")
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                base, added = scan(text.as_py() or "", window, limits, skip)
                kinds = [k for _, k, _ in base]
                row = (key, *(kinds.count(k) for k in range(3)), hashlib.sha256(_joined(base).encode()).hexdigest(),
                       _joined(sorted(base + added)), len(added))
                for to, value in zip(out, row):
                    to.append(value)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)
