"""Token ids in coded blocks: tokenise whole texts, write them in ascending order of their documents, read them back.

A file is a table of blocks: part and block number them in order, `code` holds a block's ids (see `rangecoder`),
`ordinals`, `doc_ids` and `counts` say which documents its ids belong to. Blocks are filled to the same length, so that
many are coded at once; a document may go on in the next block.

Edge cases: a null or empty text has the end id alone; a null doc_id comes first; rows that share a doc_id follow each
other in the order of their texts; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchlens.llm.rangecoder import decode_blocks, encode_blocks
from patchlens.llm.words import SLICE, U, piece_hashes

END = 2
BLOCK = 2048
LANES = 2048  # blocks coded together
BATCH_BYTES = 1 << 20  # of texts encoded together; a longer text is encoded alone
KNOWN = 1_500_000  # word pieces remembered at once

#: Texts of these characters alone are cut into pieces here, as the vocabulary's own rule cuts them.
_LATIN = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA1, 0x100)])
#: Letters that stand for bytes in the vocabulary: printable bytes are themselves, the rest follow from 256 on.
_PLAIN = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
_LETTER = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(
    b for b in range(256) if b not in set(_PLAIN))}


#: Kind of each Latin-1 byte: 0 space, 1 letter, 2 digit, 3 other. A piece is a run of letters, a digit, or a run of others.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzªµº"] + [c for c in range(0xDF, 0x100) if c != 0xF7]] = 1
_KIND[[ord(c) for c in "0123456789²³¹¼½¾"]] = 2
SLOTS = 22  # bits of the table of known pieces
PROBES = 8


def _runs(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Pieces in runs of about SLICE bytes."""
    cuts = [0]
    while cuts[-1] < len(start):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(end, start[cuts[-1]] + SLICE, "right"))))
    return list(zip(cuts, cuts[1:]))


class Encoder:
    """Ids of texts by a tokenizer whose words do not depend on each other: each distinct piece is encoded once and
    remembered under a hash of 64 bits, within a bound. A text that the cutting rule here does not cover is encoded
    whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros((1 << SLOTS) + PROBES, U)
        self.numbers = np.zeros((1 << SLOTS) + PROBES, np.int32)
        self.flat, self.start, self.size = np.zeros(1 << 16, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.filled = 0
        self.odd: dict[int, int] = {}

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Ids of new pieces, from the tokenizer's model: a piece is one word to it."""
        model = self.tokenizer.model
        ids = [[t.id for t in model.tokenize(
            p if p.isascii() else "".join(_LETTER[b] for b in p.encode()))] for p in pieces]
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((y for x in ids for y in x), np.uint16, int(size.sum()))
        while self.filled + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint16)])
        self.flat[self.filled:self.filled + len(flat)] = flat
        first = len(self.start)
        self.start = np.append(self.start, self.filled + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.filled += len(flat)
        for i, (h, at) in enumerate(zip(hashes.tolist(), (hashes >> U(64 - SLOTS)).astype(np.int64).tolist())):
            for slot in range(at, at + PROBES):
                if not self.keys[slot]:
                    self.keys[slot], self.numbers[slot] = h, first + i
                    break
            else:
                self.odd[h] = first + i

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each piece, places of those not known)."""
        out = np.zeros(len(hashes), np.int64)
        todo, slot, new = np.arange(len(hashes)), (hashes >> U(64 - SLOTS)).astype(np.int64), []
        for _ in range(PROBES):
            found = self.keys.take(slot)
            hit = found == hashes[todo]
            out[todo[hit]] = self.numbers.take(slot[hit])
            new.append(todo[found == 0])
            on = ~hit & (found != 0)
            todo, slot = todo[on], slot[on] + 1
        for i in todo.tolist():  # a run of taken slots
            known = self.odd.get(int(hashes[i]))
            if known is None:
                new.append(np.array([i]))
            else:
                out[i] = known
        return out, np.concatenate(new)

    def _cut(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of lowered Latin-1 texts, over their bytes at once."""
        raw = np.frombuffer("\n".join(texts).encode("latin-1"), np.uint8)
        if not len(raw):
            return [np.zeros(0, np.uint16) for _ in texts]
        kind = _KIND[raw]
        change = np.ones(len(raw) + 1, bool)
        change[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        inside = kind != 0
        start, end = np.flatnonzero(change[:-1] & inside), np.flatnonzero(change[1:] & inside) + 1
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        hashes = np.concatenate([piece_hashes(raw, start[i:j], end[i:j]) for i, j in _runs(start, end)] or [np.zeros(0, U)])
        flats, sizes = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        data = None
        for i in range(0, len(hashes), KNOWN):  # so many pieces can be known at once, however they differ
            part = hashes[i:i + KNOWN]
            which, new = self._find(part)
            if len(new):
                own, at = np.unique(part[new], return_index=True)
                at = new[at]
                if len(self.start) + len(own) > KNOWN:
                    self.forget()
                    own, at = np.unique(part, return_index=True)
                data = data or raw.tobytes()
                self._learn(own, [data[start[x]:end[x]].decode("latin-1") for x in (at + i).tolist()])
                which, _ = self._find(part)
            size = self.size[which]
            ends = np.cumsum(size)
            flats.append(self.flat[np.repeat(self.start[which] - ends + size, size) + np.arange(size.sum())])
            sizes.append(size)
        flat, ends = np.concatenate(flats), np.cumsum(np.concatenate([[0], *sizes]))
        cuts = ends[np.searchsorted(start, bounds)]
        return [flat[i:j] for i, j in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without an end id."""
        cut, whole = [], []
        for i, text in enumerate(texts):
            try:
                # the rule has cases for an apostrophe that a run of characters does not show
                plain = not text.encode("latin-1").translate(None, _LATIN) and "<|" not in text and "'" not in text
            except UnicodeEncodeError:
                plain = False
            (cut if plain else whole).append(i)
        out: list = [None] * len(texts)
        for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = ids
        for i, ids in zip(cut, self._cut([texts[i].lower() for i in cut])):
            out[i] = ids
        return out

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint16) for ids in self._encode(texts)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


BLOCKS = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("code", pa.binary()),
                    ("ordinals", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())),
                    ("counts", pa.list_(pa.int64()))])
BLOCKS_DDL = "part long, block long, code binary, ordinals array<long>, doc_ids array<long>, counts array<long>"


class _Packer:
    """Deals the ids of documents, one after the other, into blocks of equal length."""

    def __init__(self, block: int):
        self.size, self.full, self.block = block, [], 0
        self.new()

    def new(self) -> None:
        self.ids, self.docs, self.held = [], [], 0

    def close(self) -> None:
        if self.ids:
            self.full.append((self.block, np.concatenate(self.ids), self.docs))
            self.block += 1
            self.new()

    def put(self, ordinal: int, key, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            part = ids[at:at + self.size - self.held]
            self.ids.append(part)
            self.docs.append((ordinal, key, len(part)))
            self.held += len(part)
            at += len(part)
            if self.held == self.size:
                self.close()

    def take(self) -> pa.RecordBatch:
        part = TaskContext.get().partitionId()
        rows, self.full = self.full, []
        codes = encode_blocks([ids for _, ids, _ in rows])
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(rows), pa.int64()), pa.array([b for b, _, _ in rows], pa.int64()),
             pa.array(codes, pa.binary()),
             *(pa.array([[d[i] for d in docs] for _, _, docs in rows], pa.list_(pa.int64())) for i in range(3))],
            schema=BLOCKS)


def _batches(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts have BATCH_BYTES together, or one row with more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + BATCH_BYTES, "right"))))
        yield batch.slice(at, to - at)
        at = to


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int = END, block: int = BLOCK,
                 lanes: int = LANES) -> None:
    """Tokenise, add the end id and write coded blocks. Documents are dealt out by ranges of doc_id; a task codes
    `lanes` blocks together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, packer, ordinal = encoder(vocabulary), _Packer(block), 0
        for b in batches:
            for part in _batches(b):
                keys, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
                for key, ids in zip(keys, code.encode(texts)):
                    packer.put(ordinal, key, np.append(ids, np.uint16(end)))
                    ordinal += 1
                if len(packer.full) >= lanes:
                    yield packer.take()
        packer.close()
        if packer.full:
            yield packer.take()

    (docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id")
     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
     .mapInArrow(run, BLOCKS_DDL).write.parquet(path))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch], lanes: int = LANES) -> Iterator[list[tuple]]:
    """(part, block, ids, ordinals, doc_ids, counts) of many blocks at a time."""
    rows: list[tuple] = []

    def flush():
        return [(p, k, ids, o, d, c) for (p, k, _, o, d, c), ids in zip(rows, decode_blocks([r[2] for r in rows]))]

    for b in batches:
        rows += zip(*(b.column(i).to_pylist() for i in range(6)))
        while len(rows) >= lanes:
            rows, rest = rows[:lanes], rows[lanes:]
            yield flush()
            rows = rest
    if rows:
        yield flush()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(part, ordinal, block, doc_id, ids) of each document, or of each of its cuts, from the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _decoded(batches):
            for part, block, ids, ordinals, keys, counts in group:
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(keys), pa.int64()), pa.array(ordinals, pa.int64()),
                     pa.array([block] * len(keys), pa.int64()), pa.array(keys, pa.int64()),
                     pa.array([ids[e - c:e].astype(np.int64) for e, c in zip(ends, counts)], pa.list_(pa.int64()))],
                    ["part", "ordinal", "block", "doc_id", "ids"])

    return read_blocks(spark, path).mapInArrow(
        run, "part long, ordinal long, block long, doc_id long, ids array<long>")


def _times(matrix: list[int], vector: int) -> int:
    total, i = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[i]
        vector >>= 1
        i += 1
    return total


@functools.cache
def _zeros(power: int) -> list[int]:
    """The matrix that runs a CRC-32 through 2**power zero bits; that of one bit has the polynomial, a fixed value."""
    if not power:
        return [0xEDB88320] + [1 << i for i in range(31)]
    half = _zeros(power - 1)
    return [_times(half, x) for x in half]


def crc_joined(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings joined, from theirs and the second's length."""
    power = 3
    while length:
        if length & 1:
            first = _times(_zeros(power), first)
        length >>= 1
        power += 1
    return first ^ second


def digests(spark: SparkSession, path: str, lanes: int = LANES) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _decoded(batches, lanes):
            out = []
            for part, block, ids, ordinals, keys, counts in group:
                data, at = memoryview(ids.astype("<u4").tobytes()), 0
                for o, d, c in zip(ordinals, keys, counts):
                    out.append((part, o, d, block, c, zlib.crc32(data[4 * at:4 * (at + c)])))
                    at += c
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                             ["part", "ordinal", "doc_id", "block", "n", "crc"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs = []
            for cuts in b.column(4).to_pylist():
                cuts = sorted((c["block"], c["n"], c["crc"]) for c in cuts)
                crc = cuts[0][2]
                for _, n, more in cuts[1:]:
                    crc = crc_joined(crc, more, 4 * n)
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(crcs, pa.int64())],
                                             ["part", "ordinal", "doc_id", "n_tokens", "ids_crc32"])

    cuts = read_blocks(spark, path).mapInArrow(
        parts, "part long, ordinal long, doc_id long, block long, n long, crc long")
    docs = cuts.groupBy("part", "ordinal", "doc_id").agg(
        F.sum("n").alias("n_tokens"), F.collect_list(F.struct("block", "n", "crc")).alias("cuts"))
    docs = docs.mapInArrow(joined, "part long, ordinal long, doc_id long, n_tokens long, ids_crc32 long")
    # ids of all parts before: one row a part
    sizes = read_blocks(spark, path).select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias(
        "n")).groupBy("part").agg(F.sum("n").alias("n"))
    base = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return docs.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(base, "part").select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def encoded(docs: DataFrame, path: str, vocabulary: str | None = None, lanes: int = LANES) -> DataFrame:
    """Write the documents' ids to a folder and give what the files say of each document. Fewer `lanes` take less
    memory and more time; the files are the same."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    write_tokens(docs, path, vocabulary, lanes=lanes)
    return digests(docs.sparkSession, path, lanes)
