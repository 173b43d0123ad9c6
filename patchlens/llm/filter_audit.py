"""What each filter of a chain does, in every order of the chain: a Gray-code walk over the subsets of filters.

A document's failures are a mask; a part of the corpus is one count a mask. The walk turns one filter on or off at a
time, keeps for each mask the number of active filters that it fails, and moves a mask's documents out of or back into
the survivors when that number leaves or reaches 0. The survivors of all 2^k subsets are stored; any step of any
order is a difference of two of them. Work on texts is column expressions; only the walk over counts is Python.

Edge cases: a null text counts as empty and equals other empty ones; a null part is the empty string; rows without an
id are nobody's copy, have no copies and no labels; rows with equal ids are not copies of one another and share their
labels; of several label rows of one id, one that says 1 suffices; repeated rows count each; an empty table gives no
rows; other columns of the documents and labels are ignored.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Failure = Callable[[Column, Column], Column]  # of a text and its words

WORD = r"[^\x20\x09-\x0D]+"
#: Failure conditions that a text alone decides, by name.
FILTERS: dict[str, Failure] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
    "C": lambda text, words: F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 2,
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
#: Name of the condition that the table decides: the text stands under a smaller id.
COPY = "E"
MEASURES = ("n", "good", "toxic")
PARTS = 64  # parts walked and put out at once


def failures(docs: DataFrame, scratch, filters: dict[str, Failure] = FILTERS, id_col: str = "doc_id",
             text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask, n): documents by id, part and failures; bit i of the mask is the i-th filter, the last bit
    tells copies. Texts are read once and go no further than their digest; rows that are alike are counted before
    they are dealt, and copies meet their first document by (digest, id), so a text with many copies is no hot key."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                      text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    mask = sum((F.when(fails(F.col("text"), F.col("words")), 1 << i).otherwise(0)
                for i, fails in enumerate(filters.values())), F.lit(0))
    rows = own.select("id", "part", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), mask.alias("mask"))
    rows = rows.withColumn("spread", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)))
    rows = scratch.settle(rows.groupBy("id", "spread", "part", "digest", "mask").agg(F.count("*").alias("n")), "failures")
    first = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).select(
        "digest", "id", F.lit(0).cast("long").alias("spread"), F.lit(True).alias("first"))
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["digest", "id", "spread"], "left").select(
        "id", "spread", "part", (F.col("mask") + F.when(copy, 1 << len(filters)).otherwise(0)).alias("mask"), "n")


def mask_cells(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, cells): documents, good and toxic ones of a part by mask; at most one cell a mask."""
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")).withColumn("spread", F.lit(0).cast("long"))
    counts = [F.sum("n").alias("n"), *(F.sum(F.col("n") * F.coalesce(x, F.lit(0))).alias(x) for x in MEASURES[1:])]
    cells = failed.join(marks, ["id", "spread"], "left").groupBy("part", "mask").agg(*counts)
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))


def subset_states(cells: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters: [subset, part, measure] from [part, mask, measure].

    Subsets are visited in Gray-code order, so each step toggles one filter.
    """
    size = cells.shape[1]
    masks = np.arange(size)
    active = np.zeros(size, int)  # active filters that documents of a mask fail
    alive = cells.sum(axis=1)
    states = np.empty((size, *alive.shape), cells.dtype)
    states[0] = alive
    subset = 0
    for step in range(1, size):
        bit = step & -step
        subset ^= bit
        fails = (masks & bit) > 0
        if subset & bit:
            active[fails] += 1
            alive = alive - cells[:, fails & (active == 1)].sum(axis=1)
        else:
            active[fails] -= 1
            alive = alive + cells[:, fails & (active == 0)].sum(axis=1)
        states[subset] = alive
    return states


def audit_orders(cells: DataFrame, names: str) -> DataFrame:
    """A row per part, order of the filters and step, from the counts by mask."""
    k = len(names)
    orders = list(permutations(range(k)))
    chosen = np.array(orders).reshape(-1)  # filter of each (order, step)
    bits = 1 << chosen
    after = np.cumsum(bits.reshape(-1, k), axis=1).reshape(-1)
    before, full = after - bits, (1 << k) - 1
    label = pa.array(["".join(names[i] for i in o) for o in orders for _ in o])
    number = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)))
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                part = batch.slice(at, PARTS)
                lists = part.column(1).to_pylist()
                counts = np.zeros((len(lists), full + 1, len(MEASURES)), np.int64)
                for i, own in enumerate(lists):
                    for cell in own:
                        counts[i, cell["mask"]] = [cell[m] for m in MEASURES]
                states = subset_states(counts)
                lost = states[before] - states[after]  # [order and step, part, measure]
                fails = states[0] - states[1 << np.arange(k)]
                alone = states[full ^ (1 << np.arange(k))] - states[full]
                worth = np.zeros((k, len(lists)), np.int64)
                np.add.at(worth, chosen, lost[:, :, 0])
                found = [states[after][:, :, 0], lost[:, :, 0], fails[chosen][:, :, 0] - lost[:, :, 0],
                         alone[chosen][:, :, 0], lost[:, :, 1], lost[:, :, 2], worth[chosen]]
                rows = np.repeat(np.arange(len(lists)), len(chosen))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.concat_arrays([label] * len(lists)),
                     pa.concat_arrays([number] * len(lists)), *(pa.array(x.T.reshape(-1)) for x in found)],
                    ["part", "filter_order", "step", *columns])

    return cells.mapInArrow(walk, "part string, filter_order string, step int, "
                            + ", ".join(f"{c} long" for c in columns))


def audit(docs: DataFrame, labels: DataFrame, scratch, filters: dict[str, Failure] = FILTERS) -> DataFrame:
    """Effect of each filter at each step of every order, by part; one-letter names in `filters`, copies last."""
    return audit_orders(mask_cells(failures(docs, scratch, filters), labels), "".join(filters) + COPY)


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
    max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
flags AS (
  SELECT doc_id, part,
    {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
     'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
     'D': regexp_matches(t, '[#$%&*|]'),
     'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS f
  FROM texts),
cells AS (
  SELECT part, f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad
  FROM flags LEFT JOIN marks USING (doc_id) GROUP BY part, f),
long_cells AS (
  SELECT part, row_number() OVER () AS cell, n, good, bad, f['A'] AS fa, f['B'] AS fb, f['C'] AS fc, f['D'] AS fd,
    f['E'] AS fe FROM cells),
fails AS (
  SELECT part, cell, n, good, bad, unnest(list_filter(
    [CASE WHEN fa THEN 'A' END, CASE WHEN fb THEN 'B' END, CASE WHEN fc THEN 'C' END, CASE WHEN fd THEN 'D' END,
     CASE WHEN fe THEN 'E' END], lambda x: x IS NOT NULL)) AS letter,
    fa::INT + fb::INT + fc::INT + fd::INT + fe::INT AS n_fails FROM long_cells),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
first_fail AS (
  SELECT part, cell, n, good, bad, o, min(strpos(o, letter)) AS place FROM fails, orders GROUP BY ALL),
gone AS (
  SELECT part, o, place, sum(n) AS n, sum(good) AS good, sum(bad) AS bad FROM first_fail GROUP BY ALL),
whole AS (SELECT part, sum(n) AS n FROM cells GROUP BY part),
by_filter AS (
  SELECT part, letter, sum(n) AS n, sum(CASE WHEN n_fails = 1 THEN n ELSE 0 END) AS alone FROM fails GROUP BY ALL),
steps AS (
  SELECT w.part, o, s.place, substr(o, s.place, 1) AS letter, w.n AS total
  FROM whole w, orders, (SELECT unnest(range(1, 6)) AS place) s),
joined AS (
  SELECT s.part, s.o, s.place, s.letter, total, coalesce(g.n, 0) AS removed, coalesce(g.good, 0) AS good_lost,
    coalesce(g.bad, 0) AS toxic_lost, coalesce(b.n, 0) AS fails, coalesce(b.alone, 0) AS alone
  FROM steps s LEFT JOIN gone g ON g.part = s.part AND g.o = s.o AND g.place = s.place
  LEFT JOIN by_filter b ON b.part = s.part AND b.letter = s.letter)
SELECT part, o AS filter_order, CAST(place AS INTEGER) AS step,
  CAST(total - sum(removed) OVER (PARTITION BY part, o ORDER BY place) AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(fails - removed AS BIGINT) AS redundant, CAST(alone AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM joined
"""
