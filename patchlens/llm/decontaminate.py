"""Benchmark decontamination by spaced seeds.

A seed hashes the words that a fixed mask selects from a window, so words at ignored places may differ. Documents
whose seeds meet those of a test item are aligned with it at the hits, and a stretch of the item that is long enough
and nearly the same is reported.

Edge cases: null or empty texts on either side match nothing; items of fewer than `MIN_WORDS` words are no evidence
and match nothing, items shorter than `SPAN` words have masks of their own; repeated documents and items give the same
rows once; empty tables give no rows; a document without an id cannot be reported and stays; other columns are
ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.words import PLACE, U, Words, mix, slices

#: Selected places of each mask: six words out of up to ten. Some mask meets every ten words with two changed ones and
#: every fifteen with three, so every stretch of ten words or more with one changed word in five: a stretch of 10 to 14,
#: or 16 to 19, holds one of those, and a longer one parts into such.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 3, 6, 7), (0, 1, 3, 4, 5, 6), (0, 1, 3, 5, 7, 8), (0, 1, 4, 5, 7, 8))
SPAN = 10
MIN_WORDS = 5
#: A stretch counts from so many words on (a shorter item: whole), with so large a share of equal words.
STRETCH = 12
IDENTITY = 0.8
#: Bits of the filter of test seeds that travels to the documents: its size is fixed, whatever the test set's size.
FILTER_BITS = 24
PROBES = 4


def _seed(w: Words, places: tuple[int, ...], tag: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the windows inside one text."""
    span = places[-1] + 1
    n = len(w.hash) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    with np.errstate(over="ignore"):
        total = np.full(n, tag, U)
        for j, p in enumerate(places):
            total += w.hash[p:n + p] * PLACE[j]
        at = np.flatnonzero(w.text[:n] == w.text[span - 1:])
        return at, mix(total[at])


def _short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks of items of n words, of which one may be changed: each leaves out one of few equal parts of the item."""
    width = max(1, n - max(MIN_WORDS, n // 2 + 1))
    return [tuple(p for p in range(n) if not i <= p < i + width) for i in range(0, n, width)]


def _all_masks(short: list[int]) -> list[tuple[tuple[int, ...], int]]:
    """(mask, length of the items it is for: 0 for all)."""
    return [*((m, 0) for m in MASKS), *((m, n) for n in short for m in _short_masks(n))]


def _probe(hashes: np.ndarray, k: int) -> np.ndarray:
    return (hashes >> U(k * 10)) & U((1 << FILTER_BITS) - 1)


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, n, words) of each test item: its word hashes, as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, counts, blobs = b.column(0).to_pylist(), [], []
            for w in slices(b.column(1)):
                counts += w.counts.tolist()
                blobs += [w.hash[w.at[i]:w.at[i + 1]].tobytes() for i in range(w.last - w.first)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())],
                ["item_id", "n", "words"])

    return items.select(F.col(id_col).cast("long"), text_col).mapInArrow(
        run, "item_id long, n long, words binary").where(f"n >= {MIN_WORDS} and item_id is not null")


def _item_seeds(items: DataFrame, short: list[int], id_col: str, text_col: str) -> DataFrame:
    """(seed, item_id, place): the seeds of every item under every mask; masks of short items at their beginning only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.array(b.column(0).to_pylist(), np.int64)
            for w in slices(b.column(1)):
                for tag, (places, size) in enumerate(_all_masks(short)):
                    at, h = _seed(w, places, tag)
                    text = w.text[at]
                    if size:
                        own = (w.counts[text] == size) & (at == w.at[text])
                        at, h, text = at[own], h[own], text[own]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(ids[w.first + text]), pa.array(at - w.at[text])],
                        ["seed", "item_id", "place"])

    return items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).mapInArrow(
        run, "seed long, item_id long, place long").distinct()


def _filter(seeds: DataFrame) -> np.ndarray:
    """Bloom filter of the seeds: a few tasks each make one of the fixed size, and these are joined."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for b in batches:
            h = np.asarray(b.column(0)).view(U)
            for k in range(PROBES):
                bits[_probe(h, k)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    total = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in seeds.select("seed").coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(bytes(row.bits), np.uint8)
    return total


def _hits(docs: DataFrame, bits: np.ndarray, short: list[int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, words, hits) of documents with seeds that pass the filter; hits: (seed, place) pairs as bytes."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(sent.value).view(bool)
        for b in batches:
            ids = b.column(0)
            for w in slices(b.column(1)):
                places, seeds = [], []
                for tag, (mask, _) in enumerate(_all_masks(short)):
                    at, h = _seed(w, mask, tag)
                    for k in range(PROBES):
                        keep = known[_probe(h, k)]
                        at, h = at[keep], h[keep]
                    places.append(at)
                    seeds.append(h)
                at, h = np.concatenate(places), np.concatenate(seeds)
                if not len(at):
                    continue
                text = w.text[at]
                order = np.argsort(text, kind="stable")
                at, h, text = at[order], h[order], text[order]
                found = np.unique(text)
                cuts = np.searchsorted(text, np.append(found, text[-1] + 1))
                rows = [(w.hash[w.at[t]:w.at[t + 1]].tobytes(), h[i:j].view(np.int64), at[i:j] - w.at[t])
                        for t, i, j in zip(found, cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(w.first + found)), pa.array([r[0] for r in rows], pa.binary()),
                     pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                     pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["doc_id", "words", "seeds", "places"])

    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).mapInArrow(
        run, "doc_id long, words binary, seeds array<long>, places array<long>")


def best_stretch(doc: np.ndarray, item: np.ndarray, shift: int, least: int, identity: float):
    """(equal words, length, first word of the document) of the longest stretch of the item, laid at `shift`, with at
    least that share of equal words; None if none is long enough."""
    a, b = max(0, shift), min(len(doc), shift + len(item))
    if b - a < least:
        return None
    same = doc[a:b] == item[a - shift:b - shift]
    total = np.concatenate([[0.0], np.cumsum(same - identity)])
    # longest [i, j) with total[j] >= total[i]: against the lowest total so far
    low = np.minimum.accumulate(total)
    first = np.searchsorted(-low, -total - 1e-9)  # first i whose lowest total is no more than total[j]
    length = np.arange(len(total)) - first
    j = int(np.argmax(length))
    i, size = int(first[j]), int(length[j])
    if size < least:
        return None
    return int(same[i:j].sum()), size, a + i


def find_contaminated(docs: DataFrame, items: DataFrame, scratch, id_col: str = "doc_id", text_col: str = "text",
                      item_id: str = "item_id", item_text: str = "text", stretch: int = STRETCH,
                      identity: float = IDENTITY) -> DataFrame:
    """One row per document and test item that it repeats: doc_id, item_id, n_equal, n_words, first_word, share.

    Documents meet items by an equality join of seeds. Of a document that passes the filter one row of word hashes
    moves; item words move to the pairs found.
    """
    words = scratch.settle(item_words(items, item_id, item_text).dropDuplicates(["item_id", "words"]), "items")
    short = [r.n for r in words.where(f"n < {SPAN}").select("n").distinct().collect()]  # at most SPAN - MIN_WORDS
    seeds = scratch.settle(_item_seeds(items, sorted(short), item_id, item_text), "seeds")
    hits = scratch.settle(_hits(docs, _filter(seeds), sorted(short), id_col, text_col), "hits")
    pairs = (hits.select("doc_id", F.explode(F.arrays_zip("seeds", "places")).alias("h"))
             .select("doc_id", F.col("h.seeds").alias("seed"), F.col("h.places").alias("at"))
             .join(seeds, "seed").select("doc_id", "item_id", (F.col("at") - F.col("place")).alias("shift")).distinct()
             .groupBy("doc_id", "item_id").agg(F.collect_list("shift").alias("shifts")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, i, shifts, mine, theirs in zip(*(b.column(k).to_pylist() for k in range(5))):
                doc, item = np.frombuffer(mine, U), np.frombuffer(theirs, U)
                least = min(stretch, len(item))
                found = [s for s in (best_stretch(doc, item, x, least, identity) for x in sorted(shifts)) if s]
                if found:
                    same, size, first = max(found)
                    out.append((d, i, same, size, first, same / len(item)))
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.float64())],
                ["doc_id", "item_id", "n_equal", "n_words", "first_word", "share"])

    schema = "doc_id long, item_id long, n_equal long, n_words long, first_word long, share double"
    found = (pairs.join(hits.select("doc_id", "words"), "doc_id")
             .join(words.select("item_id", F.col("words").alias("item")), "item_id")
             .select("doc_id", "item_id", "shifts", "words", "item").mapInArrow(run, schema))
    return found.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("n_equal", "n_words", "first_word", "share")).alias("m")).select("doc_id", "item_id", "m.*")


def drop_contaminated(docs: DataFrame, items: DataFrame, scratch, **settings) -> DataFrame:
    """Documents, with all their columns, that repeat no test item."""
    bad = find_contaminated(docs, items, scratch, **settings).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["__bad"], "left_anti")
