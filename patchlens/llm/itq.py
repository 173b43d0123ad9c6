"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact cosines.

A rotation learned on a bounded sample balances binary codes. Codes are cut into chunks with a table each; vectors of
one label that share a chunk are compared by exact cosine, in blocks. Equal vectors are one class, compared once.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components, and those without a label, link
with nothing; vectors of different lengths link with nothing; repeated rows are vectors of their own; an empty table
gives no rows; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import components

BITS = 64
CHUNK = 8  # bits of a chunk: two codes less than BITS / CHUNK bits apart share one
LEAST = 0.93
#: Vectors that the rotation is fitted on, at most: those of the smallest hashed ids. All vectors are indexed.
MAX_FIT = 20_000
BLOCK = 512  # vectors of a bucket that meet at once


def fit_rotation(x: np.ndarray, bits: int = BITS, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal directions, turned until signs and coordinates agree best."""
    mean = x.mean(axis=0)
    _, axes = np.linalg.eigh((x - mean).T @ (x - mean))
    axes = axes[:, ::-1][:, :bits]
    v = (x - mean) @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(7).normal(size=(axes.shape[1],) * 2))
    for _ in range(rounds):
        signs = np.where(v @ turn >= 0, 1.0, -1.0)
        a, _, b = np.linalg.svd(signs.T @ v)
        turn = (a @ b).T
    return mean, axes @ turn


def codes_of(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Codes as 64-bit numbers; shorter vectors give fewer bits."""
    bits = ((x - mean) @ turn >= 0).astype(np.uint64)
    return (bits << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, blob): comparable vectors as doubles, -0.0 as 0.0; blob null otherwise."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = []
            for label, x in zip(b.column(1).to_pylist(), b.column(2)):
                v = None
                if label is not None and x.is_valid and len(x) and not x.values.null_count:
                    v = np.asarray(x.values, np.float64) + 0.0
                    v = v if np.isfinite(v).all() and v.any() else None
                blobs.append(None if v is None else v.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(blobs, pa.binary())],
                                             ["vec_id", "label", "blob"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"),
                          F.col("embedding").cast("array<double>")).mapInArrow(
        run, "vec_id long, label string, blob binary")


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def _fit(classes: DataFrame, bits: int, most: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rotation by length of the vectors; fitted in one task on at most `most` classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((len(x), x) for b in batches for x in b.column(0).to_pylist())
        out = []
        for size in sorted({n for n, _ in rows}):
            mean, turn = fit_rotation(_unit(_matrix([x for n, x in rows if n == size])), bits)
            out.append((size, mean.tobytes(), turn.tobytes()))
        cols = list(zip(*out)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()),
                                          pa.array(cols[2], pa.binary())], ["size", "mean", "turn"])

    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(most).select("blob").coalesce(1)
    out = {}
    for r in sample.mapInArrow(run, "size long, mean binary, turn binary").collect():
        mean = np.frombuffer(bytes(r["mean"]))
        out[r["size"]] = mean, np.frombuffer(bytes(r["turn"])).reshape(len(mean), -1)
    return out


def _coded(classes: DataFrame, rotations: dict) -> DataFrame:
    """Classes with their codes. A length that the sample lacks has code 0: its vectors share every chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column(1).to_pylist()
            code = np.zeros(len(blobs), np.uint64)
            sizes = np.array([len(x) for x in blobs])
            for size in np.unique(sizes):
                if int(size) in rotations:
                    at = np.flatnonzero(sizes == size)
                    code[at] = codes_of(_unit(_matrix([blobs[i] for i in at])), *rotations[int(size)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code.view(np.int64))],
                                             ["label", "blob", "rep", "times", "code"])

    return classes.select("label", "blob", "rep", "times").mapInArrow(
        run, "label string, blob binary, rep long, times long, code long")


def _spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what a symmetric matrix of links joins, as few as can be."""
    n = len(links)
    new, edges = np.ones(n, bool), []
    for root in range(n):
        if not new[root]:
            continue
        new[root] = False
        todo = [root]
        while todo:
            i = todo.pop()
            found = np.flatnonzero(links[i] & new)
            new[found] = False
            edges += [(i, int(j)) for j in found]
            todo += found.tolist()
    return edges


def compare_block(rep, times, code, side, blobs, chunk: int, same: bool, least: float, width: int = CHUNK):
    """([(rep, links)], [(rep, rep)]): links of the vectors of two blocks (`same`: of one) that share this chunk and
    no earlier one, so that a pair counts in one table only."""
    links = np.zeros((len(rep), len(rep)), bool)
    sizes = np.array([len(x) for x in blobs])
    for size in np.unique(sizes):
        a = np.flatnonzero((sizes == size) & (side <= 0))
        b = a if same else np.flatnonzero((sizes == size) & (side == 1))
        if not len(a) or not len(b):
            continue
        x, y = _matrix([blobs[i] for i in a]), _matrix([blobs[i] for i in b])
        cos = x @ y.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
        i, j = np.nonzero(cos >= least)
        i, j = a[i], b[j]
        apart = i != j
        differ = code[i] ^ code[j]
        for c in range(chunk):
            apart &= (differ >> np.uint64(c * width)) & np.uint64((1 << width) - 1) != 0
        links[i[apart], j[apart]] = True
        links[j[apart], i[apart]] = True
    degree = links @ times
    return [(int(r), int(d)) for r, d in zip(rep, degree) if d], [
        (int(rep[i]), int(rep[j])) for i, j in _spanning(links)]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first columns, over the borders of batches."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _links(coded: DataFrame, scratch, least: float, bits: int, width: int, block: int) -> DataFrame:
    """(a, b, links): links > 0 counts those of class a; else a and b are joined."""
    tables = bits // width
    entries = coded.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))).withColumn(
        "value", F.expr(f"shiftrightunsigned(code, chunk * {width}) & {(1 << width) - 1}"))
    sizes = entries.groupBy("label", "chunk", "value").count().where("count > 1").withColumn(
        "blocks", F.ceil(F.col("count") / block).cast("int")).drop("count")
    placed = entries.join(sizes, ["label", "chunk", "value"]).withColumn(
        "own", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "chunk", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))).alias("side"),
        "rep", "times", "code", "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for (_, chunk, _, i, j), rows in _groups(batches, 5):
            if len(rows) < 2:
                continue
            side, rep, times, code, blobs = zip(*rows)
            counts, edges = compare_block(np.array(rep), np.array(times), np.array(code).view(np.uint64),
                                          np.array(side), blobs, chunk, i == j, least, width)
            out += [(r, r, d) for r, d in counts] + [(a, b, 0) for a, b in edges]
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "links"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "links"])

    key = ["label", "chunk", "value", "i", "j"]
    return met.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long, links long")


def near_vectors(vectors: DataFrame, scratch, least: float = LEAST, bits: int = BITS, width: int = CHUNK,
                 max_fit: int = MAX_FIT, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = scratch.settle(_valid(vectors).withColumn("h", F.md5("blob")), "vectors")
    classes = scratch.settle(rows.where("blob is not null").groupBy("label", "blob").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("times"), F.first("h").alias("h")), "classes")
    rotations = _fit(classes, bits, max_fit)
    found = scratch.settle(_links(_coded(classes, rotations), scratch, least, bits, width, block), "links")
    degree = found.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("others"))
    joined = components(scratch, found.where("links = 0").select("a", "b"))
    known = classes.select("label", "h", "rep", "times").join(degree, "rep", "left").join(
        joined, F.col("rep") == F.col("node"), "left").select(
        F.col("label").alias("l"), F.col("h").alias("c"),
        (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", "label", "h").join(
        known, (F.col("label") == F.col("l")) & (F.col("h") == F.col("c")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
