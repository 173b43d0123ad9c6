"""License scan: fixed phrases, and ordered signature rules behind a keyword prefilter.

A text's words are matched against the keywords of all rules at once; only rules whose keywords all occur are searched.
Of the detections those of a rule that stands earlier win: what lies inside an accepted detection is suppressed.

Edge cases: a null text counts as empty; a text without words or findings has zero counts, null places, empty labels
and score 0; equal spans go to the rule that stands first; repeated rows each give their row; an empty table gives no
rows; other columns are ignored.
"""
from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.license_rules import BASE, NAME, RULES, Rule

#: Bytes that are no part of a word become spaces, capital letters small ones.
TABLE = bytes(32 if c < 0x30 or 0x3A <= c < 0x41 or 0x5B <= c < 0x61 or 0x7B <= c < 0x80
              else c + 32 if 0x41 <= c < 0x5B else c for c in range(256))
SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double")


@functools.cache
def compiled(pattern: str) -> re.Pattern:
    """Whole words only; the space after a match may begin the next."""
    return re.compile(b"(?<= )(?:%s)(?= )" % re.sub(" +", " ", pattern).encode())


class Scanner:
    """Rules found by one of their keywords; a pattern is compiled when a text first asks for it."""

    def __init__(self, rules: list[Rule] = RULES, base: tuple[tuple[str, str], ...] = BASE):
        self.base = [(label, phrase.encode().split(), compiled(phrase)) for label, phrase in base]
        self.rules, self.by_word = [], {}
        for i, (label, keywords, pattern, weight) in enumerate(rules):
            keys = frozenset(k.encode() for k in keywords)
            self.rules.append((label, keys, pattern, weight))
            self.by_word.setdefault(max(keys, key=lambda k: (len(k), k)), []).append(i)
        self.keywords = frozenset().union(*(keys for _, keys, _, _ in self.rules), *(set(w) for _, w, _ in self.base))

    def scan(self, text: str):
        """(number of words, base places, detections) of a text; both are lists of (start, end, label, weight), with
        words counted from 0."""
        words = text.encode("utf-8", "surrogatepass").translate(TABLE).split()
        present = self.keywords.intersection(words)
        if not present:
            return len(words), [], []
        line = b" " + b" ".join(words) + b" "
        base = [(m.start(), m.end(), label, NAME) for label, phrase, pattern in self.base if present.issuperset(phrase)
                for m in pattern.finditer(line)]
        found = []
        for word in present:
            for i in self.by_word.get(word, ()):
                label, keys, pattern, weight = self.rules[i]
                if keys <= present:
                    found += [(i, m.start(), m.end(), label, weight) for m in compiled(pattern).finditer(line)]
        return len(words), numbered(base, line), numbered([x[1:] for x in suppressed(found)], line)


def suppressed(found: list[tuple]) -> list[tuple]:
    """Detections (priority, start, end, ...) that lie inside no accepted one of higher priority.

    Accepted spans that cover one another are kept as a staircase: starts and ends both rise, so of those that start
    early enough the last one reaches furthest.
    """
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for hit in sorted(found, key=lambda x: (x[0], x[1], -x[2])):
        start, end = hit[1:3]
        i = bisect_right(starts, start)
        if i and ends[i - 1] >= end:
            continue
        kept.append(hit)
        i, j = bisect_left(starts, start), bisect_right(ends, end)
        if i < j:  # covered by the new one
            del starts[i:j], ends[i:j]
        starts.insert(i, start)
        ends.insert(i, end)
    return sorted(kept, key=lambda x: x[1:3])


def numbered(spans: list[tuple], line: bytes) -> list[tuple]:
    """Byte places as numbers of words; each byte is counted once."""
    out, at, word = [], 1, 0
    for start, end, label, weight in sorted(spans):
        word += line.count(b" ", at, start)
        at = start
        out.append((word, word + line.count(b" ", start, end) + 1, label, weight))
    return out


def confidence(hits: list[tuple]) -> float:
    """1 less the chance that all labels err, each as sure as its best detection."""
    best: dict[str, float] = {}
    for _, _, label, weight in hits:
        best[label] = max(best.get(label, 0.0), weight)
    miss = 1.0
    for weight in best.values():
        miss *= 1.0 - weight
    return 1.0 - miss


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None,
                  base: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """One row per document: words, places of the fixed phrases, labels and a score. Nothing is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(RULES if rules is None else rules, base)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, places, hits = scanner.scan(text.as_py() or "")
                labels = {x[2] for x in places}
                row = (key, n, len(places), min((x[0] for x in places), default=None),
                       max((x[0] for x in places), default=None), ",".join(sorted(labels)),
                       ",".join(sorted(labels | {x[2] for x in hits})), confidence(places + hits))
                for to, value in zip(out, row):
                    to.append(value)
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)],
                                             [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rules: list[Rule] | None = None) -> DataFrame:
    """One row per detection that stands: label, first word, word after the last, weight."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(RULES if rules is None else rules)
        for batch in batches:
            rows = [(key, label, start, end, weight)
                    for key, text in zip(batch.column(0).to_pylist(), batch.column(1))
                    for start, end, label, weight in scanner.scan(text.as_py() or "")[2]]
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)],
                                             ["doc_id", "label", "first_word", "end_word", "weight"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        run, "doc_id long, label string, first_word long, end_word long, weight double")
