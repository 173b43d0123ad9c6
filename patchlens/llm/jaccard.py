"""Exact similarity join of documents by the Jaccard coefficient of their word shingles.

Equal sets are one class. Tokens have one order for all: rare ones by hash, then frequent ones by frequency. A document
whose first tokens are frequent has a longer prefix, by what its candidates are estimated to cost, and a pair must then
share as many more tokens of the shorter extension before it is verified.

Documents that share a token of their prefixes meet in buckets. In a small bucket all pairs are candidates. In a large
one all documents are compared with one, the hub. Two documents of which not both are near the hub can only be similar
if their differences from it overlap; so these differences, without all that is common to the bucket, are joined by
prefixes of their own, in buckets of the hub and a token. Only documents linked to the hub need no comparison.

With K = (100 - T) / (100 + T), sets a and b are linked if |a ^ b| <= K * (|a| + |b|). Let A and B be the differences
of a and b from hub h, b not linked to h: |A & B| > (1 - K) * |A| / 2, and if a is not linked either, the same holds
with B. A is linked and b is not only if |B| is within the sum of two such bounds. And |A & B| >= |A| - |a ^ b| always, where
|a ^ b| <= (100 - T) / T * |a|; so no prefix of a difference is longer than that and one. What a hub alone has or lacks is
in the differences of all its documents, so their tokens are ordered by their number of times in these differences.

Edge cases: documents without words or without text are in no pair and are their own component; a document of fewer
words than a shingle has its whole sequence as one; repeated rows are in one class; rows without an id count in no
component and are returned; an empty table gives no rows; other columns are ignored. Rows that share an id with
different texts: an id stands for one document in the links; `keep_one` takes them as documents of their own.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlens.llm.common import Scratch, components, free_name
from patchlens.llm.words import PLACE, U, mix, slices
from patchlens.operators.grouping import spread_row_number

#: A token is frequent if more classes than this hold it in their first prefix. At most MOST_FREQUENT tokens are sent to
#: the tasks: where there are more, the number of classes that makes a token frequent is raised until there are not.
FREQUENT = 2
MOST_FREQUENT = 1 << 20
LONGEST = 8  # tokens that a pair may have to share
SMALL = 16  # documents of a bucket in which all pairs are candidates
SMALL_WITHIN = 256  # the same for buckets of a hub and a token, whose documents are alike in more than the token
LEVELS = 4  # of buckets; in those of the last all pairs are candidates
VERIFY = 8.0  # cost of a candidate's verification, in rows of a bucket
FILTER_BITS = 25


def base_prefix(n: np.ndarray | int, t: int):
    """Tokens of n of which a similar set must hold one."""
    return n - (t * n + 99) // 100 + 1


def _sets(docs: DataFrame, k: int, take, schema: str, names: list[str]) -> DataFrame:
    """Rows that `take` makes of a document's id and set, or none."""
    types = [pa.int64(), pa.int64(), *[pa.binary()] * (len(names) - 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for w in slices(b.column(1)):  # a batch for each slice: no more than that is held
                rows = [take(ids[i], own) for i, own in w.shingle_sets(k)]
                cols = list(zip(*(r for r in rows if r is not None))) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _set_key(own: np.ndarray) -> bytes:
    """128 bits of a sorted set."""
    with np.errstate(over="ignore"):
        return np.array([np.sum(mix(own), dtype=U), np.bitwise_xor.reduce(mix(own * PLACE[5] + U(1)), initial=U(0))]).tobytes()


def _frequent(first: DataFrame, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(sorted tokens, counts) of the frequent tokens of the classes' first prefixes."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64)
            for i in range(0, len(flat), 1 << 20):
                token, times = np.unique(flat[i:i + (1 << 20)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(times)], ["token", "times"])

    counts = scratch.settle(first.select("prefix").mapInArrow(explode, "token long, times long").groupBy("token").agg(
        F.sum("times").alias("times")).where(F.col("times") > FREQUENT), "counts")
    # tokens by their count: a row for each count there is, of which there are no more than its square root allows
    above, least = 0, FREQUENT
    for times, n in counts.groupBy("times").count().orderBy(F.col("times").desc()).toLocalIterator():
        above += n
        if above > MOST_FREQUENT:
            least = times
            break
    rows = counts.where(F.col("times") > least).toArrow()
    scratch.free(counts)
    token, times = np.asarray(rows.column("token"), np.int64).view(U), np.asarray(rows.column("times"), np.int64)
    order = np.argsort(token)
    return token[order], times[order]


def _costs(own: np.ndarray, frequent: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Times of each token, 0 where it is not among the sorted frequent ones."""
    if not len(frequent):
        return np.zeros(len(own), np.int64)
    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
    return np.where(frequent[at] == own, times[at], 0)


def adapted_prefix(own: np.ndarray, frequent: np.ndarray, times: np.ndarray, t: int) -> tuple[int, int, np.ndarray]:
    """(tokens to share, rare tokens of the prefix, prefix) of a sorted set, in the order of all tokens."""
    n = len(own)
    cost = _costs(own, frequent, times)
    p = base_prefix(n, t)
    if not cost[:p].any():
        return 1, p, own[:p]
    order = np.argsort(cost, kind="stable")
    total = np.cumsum(cost[order])
    ways = np.arange(1, min(LONGEST, n - p + 1) + 1)
    scanned = total[p + ways - 2]
    ell = int(ways[np.argmin(scanned + VERIFY * scanned / ways)])
    chosen = order[:p + ell - 1]
    return ell, int((cost[chosen] == 0).sum()), own[chosen]


def _bits_of(ids: DataFrame) -> np.ndarray:
    """Filter of document ids, of a fixed size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for b in batches:
            h = mix(np.asarray(b.column(0), np.int64).view(U))
            for k in range(2):
                bits[(h >> U(k * 25)) & U((1 << FILTER_BITS) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    total = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in ids.coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(bytes(row.bits), np.uint8)
    return total


def _pack(own: np.ndarray) -> bytes:
    """Six bytes a token: in a pair two tokens agree by chance once in 2**48."""
    return np.ascontiguousarray((np.unique(own >> U(16))).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    six = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view(U).ravel()


def _in_sorted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a are in sorted b."""
    if not len(b):
        return np.zeros(len(a), bool)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return b[at] == a


def _verify(batches: Iterator[pa.RecordBatch], t: int) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, star, sets of both): kind 0 links a and b; of a star's pairs, with b's difference from hub a, as
    tokens of the hub, kind 1 for a linked and 2 for an unlinked b, and 3 for an unlinked one that may meet a linked one
    as well. `have` is the size of the difference, `ahead` that of its prefix."""
    out: list[tuple] = []
    k = (100 - t) / (100 + t)
    last, mine = None, None
    for batch in batches:
        for a, b, star, one, two in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if a != last:
                last, mine = a, _unpack(one)
            other = _unpack(two)
            common = _in_sorted(other, mine)
            inter = int(common.sum())
            linked = 100 * inter >= t * (len(mine) + len(other) - inter)
            if linked:
                out.append((0, a, b, b"", 0, 0, 0))
            if not star:
                continue
            added = other[~common]
            gone = mine[~_in_sorted(mine, other)]
            diff = mix(np.concatenate([added, gone]) ^ mix(np.array([a], np.int64).view(U)))
            # tokens that a link asks for: more than half of |A| + k (|hub| - |a|)
            least = ((100 + t) * len(diff) + (100 - t) * (len(mine) - len(other))) // (2 * (100 + t)) + 1
            ahead = max(0, min(len(diff) - least + 1, len(diff), (100 - t) * len(other) // t + 1))
            far = k * (len(mine) * 100 / t + len(other)) + k * (len(mine) + len(mine) * 100 / t)
            kind = 1 if linked else 3 if len(diff) <= far else 2
            out.append((kind, a, b, diff.tobytes(), len(diff), ahead, len(other)))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, x) for c, x in zip(zip(*out), [pa.int32(), pa.int64(), pa.int64(), pa.binary(),
                                                            pa.int64(), pa.int64(), pa.int64()])],
                ["kind", "a", "b", "diff", "have", "ahead", "n"])
            out = []


def _prefixes(batches: Iterator[pa.RecordBatch], t: int, frequent: np.ndarray, times: np.ndarray
              ) -> Iterator[pa.RecordBatch]:
    """Of differences as `_verify` has them: kind 1 and 2 with the prefix tokens of a linked and an unlinked document, and
    3 with those by which an unlinked one may meet a linked one. The order of tokens is one for all documents of a hub,
    rare ones first."""
    for batch in batches:
        out: list[tuple] = []
        for kind, b, blob, have, ahead, n in zip(*(batch.column(i).to_pylist() for i in range(6))):
            diff = np.sort(np.frombuffer(blob, U))
            diff = diff[np.argsort(_costs(diff, frequent, times), kind="stable")].view(np.int64)
            out.append((min(kind, 2), b, diff[:ahead].tolist(), have, have - ahead, n))
            if kind == 3:
                # a linked one may be of any size, so the overlap is at least |B| - |a ^ b| and no more is known
                ahead = min(have, (100 - t) * n // t + 1)
                out.append((3, b, diff[:ahead].tolist(), have, have - ahead, n))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, x) for c, x in zip(zip(*out), [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(),
                                                            pa.int64(), pa.int64()])],
                ["kind", "doc", "tokens", "have", "rest", "n"])


def _met(rows: DataFrame, even: bool) -> DataFrame:
    """Rows (token, doc, size) of the buckets of two documents and more, with the number of these and the smallest.
    even: no bucket is large, so one window serves; otherwise counts are aggregated first and joined."""
    if even:
        whole = Window.partitionBy("token")
        return rows.withColumns({"members": F.count("*").over(whole), "hub": F.min("doc").over(whole)}).where(
            "members > 1")
    counts = rows.groupBy("token").agg(F.count("*").alias("members"), F.min("doc").alias("hub")).where("members > 1")
    return rows.join(counts, "token")


def _candidates(met: DataFrame, t: int, last: bool, most: int) -> DataFrame:
    """(a, b, star, ell) of the pairs to verify of buckets: all of a small bucket that sizes allow; of a large one its
    smallest document, the hub, with every other. ell: tokens that a pair has to share."""
    small = F.lit(True) if last else F.col("members") <= most
    one = met.where(small).select("token", F.col("doc").alias("a"), F.col("size").alias("na"))
    two = met.where(small).select("token", F.col("doc").alias("b"), F.col("size").alias("nb"))
    na, nb = F.floor(F.col("na") / 16), F.floor(F.col("nb") / 16)
    pairs = one.join(two, "token").where(
        (F.col("a") < F.col("b")) & (100 * F.least(na, nb) >= t * F.greatest(na, nb))).select(
        "a", "b", F.lit(False).alias("star"), F.least(F.col("na") % 16, F.col("nb") % 16).alias("ell"))
    if not last:
        pairs = pairs.union(met.where(~small & (F.col("doc") != F.col("hub"))).select(
            F.col("hub").alias("a"), F.col("doc").alias("b"), F.lit(True).alias("star"), F.lit(1).alias("ell")))
    return pairs.groupBy("a", "b").agg(F.max("star").alias("star"), F.max("ell").alias("ell"))


def _multi_match(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Pairs that share as many prefix tokens as the less extended of the two documents asks for."""
    one = prefixes.select(F.col("doc").alias("a"), (F.col("size") % 16).alias("l1"), F.col("tokens").alias("t1"))
    two = prefixes.select(F.col("doc").alias("b"), (F.col("size") % 16).alias("l2"), F.col("tokens").alias("t2"))
    ell = F.col("ell")

    def ahead(tokens: str, own: str):  # the prefix extended by ell - 1
        return F.slice(tokens, F.lit(1), (F.size(tokens) - F.col(own) + ell).cast("int"))

    # pairs of a bucket share one token; a star's pairs tell where others lie, and are compared whatever they share
    return pairs.where("star or ell = 1").select("a", "b", "star").union(
        pairs.where("not star and ell > 1").join(one, "a").join(two, "b")
        .where(F.size(F.array_intersect(ahead("t1", "l1"), ahead("t2", "l2"))) >= ell).select("a", "b", "star"))


def link_documents(docs: DataFrame, scratch: Scratch, shingle: int = 5, t: int = 80):
    """(rows, links): rows: doc_id, n, rep of every document; links: pairs (a, b) of class representatives that are
    linked, none missing that joins two components. t: least similarity in percent."""
    first = scratch.settle(_sets(
        docs, shingle, lambda i, own: (i, len(own), _set_key(own), own[:base_prefix(len(own), t)].tobytes()),
        "doc_id long, n long, key binary, prefix binary", ["doc_id", "n", "key", "prefix"]), "sets")
    classes = scratch.settle(first.where("n > 0 and doc_id is not null").groupBy("key", "n").agg(
        F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix")), "classes")
    frequent, times = _frequent(classes, scratch)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((frequent, times))  # at most MOST_FREQUENT tokens

    def adapt(i, own):
        if not len(own) or i is None:
            return None
        ell, rare, prefix = adapted_prefix(own, *sent.value, t)
        return i, len(own) * 16 + ell, _set_key(own), prefix.tobytes(), rare.to_bytes(8, "little")

    adapted = _sets(docs, shingle, adapt, "doc long, size long, key binary, prefix binary, rare binary",
                    ["doc", "size", "key", "prefix", "rare"])
    reps = classes.select(F.col("rep").alias("doc"), F.col("key").alias("k"))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([int.from_bytes(x, "little") for x in b.column(3).to_pylist()]),
                 pa.array(tokens, pa.list_(pa.int64()))], ["doc", "size", "rare", "tokens"])

    prefixes = scratch.settle(
        adapted.join(reps, "doc").where("key = k").dropDuplicates(["doc"]).select("doc", "size", "prefix", "rare").mapInArrow(
            numbers, "doc long, size long, rare long, tokens array<long>"), "prefixes")
    rows = scratch.settle(first.join(classes.select(F.col("key").alias("k"), "rep"), F.col("key") == F.col("k"), "left")
                          .select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), "rows")
    repeated = first.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    scratch.free(first)

    buckets = prefixes.select(F.posexplode("tokens").alias("at", "token"), "doc", "size", "rare")
    rare = _met(buckets.where("at < rare").select("token", "doc", "size"), True)
    frequent_rows = _met(buckets.where("at >= rare").select("token", "doc", "size"), False)
    met = scratch.settle(rare.union(frequent_rows), "met")
    candidates = scratch.settle(_candidates(met, t, False, SMALL), "candidates")
    scratch.free(met)
    pairs = scratch.settle(_multi_match(candidates, prefixes), "pairs")
    scratch.free(candidates, prefixes)
    sent_ids = spark.sparkContext.broadcast(_bits_of(pairs.select("a").union(pairs.select("b"))))

    def packed(i, own):
        if i is None or not len(own):
            return None
        h = mix(np.array([i], np.int64).view(U))
        for k in range(2):
            at = int((h[0] >> U(k * 25)) & U((1 << FILTER_BITS) - 1))
            if not sent_ids.value[at >> 3] >> (7 - (at & 7)) & 1:
                return None
        return i, len(own), _set_key(own), _pack(own)

    # rows that share an id may have several sets here; that of the class is meant
    sets = scratch.settle(
        _sets(docs, shingle, packed, "doc long, n long, key binary, packed binary", ["doc", "n", "key", "packed"])
        .select("doc", "key", "packed"), "packed")
    if repeated:
        all_sets = sets
        own = sets.join(classes.select(F.col("rep").alias("doc"), F.col("key").alias("k")), "doc").where("key = k")
        sets = scratch.settle(own.dropDuplicates(["doc"]).select("doc", "packed"), "packed")
        scratch.free(all_sets)
    scratch.free(classes)
    found = None
    for level in range(LEVELS):
        checked = scratch.settle(
            pairs.join(sets.select(F.col("doc").alias("b"), F.col("packed").alias("two")), "b")
            .join(sets.select(F.col("doc").alias("a"), F.col("packed").alias("one")), "a")
            .select("a", "b", "star", "one", "two").mapInArrow(
                lambda x: _verify(x, t), "kind int, a long, b long, diff binary, have long, ahead long, n long"),
            "checked")
        scratch.free(pairs)
        links = scratch.settle(checked.where("kind = 0").select("a", "b"), "linked")
        found = links if found is None else found.union(links)
        diffs = checked.where("kind > 0")
        if level == LEVELS - 1 or not diffs.limit(1).count():
            break
        own = spark.sparkContext.broadcast(_frequent(diffs.select(F.col("diff").alias("prefix")), scratch))
        spread = scratch.settle(diffs.select("kind", "b", "diff", "have", "ahead", "n").mapInArrow(
            lambda x, own=own: _prefixes(x, t, *own.value),
            "kind int, doc long, tokens array<long>, have long, rest long, n long"), "spread")
        own.destroy()
        tokens = spread.select("kind", "doc", F.explode("tokens").alias("token"), "have", "rest", "n")
        near = tokens.where("kind = 1").select("token", F.col("doc").alias("p"), F.col("have").alias("have1"),
                                               F.col("rest").alias("rest1"), F.col("n").alias("n1"))
        apart = tokens.where("kind = 3").select("token", F.col("doc").alias("q"), F.col("have").alias("have2"),
                                                F.col("rest").alias("rest2"), F.col("n").alias("n2"))
        # common tokens that are still possible behind the prefixes, against those that a link needs; no more tokens than
        # a link allows to differ can be in one of two differences alone
        differ = (100 - t) * (F.col("n1") + F.col("n2"))
        bound = (F.col("have1") + F.col("have2") - differ / (100 + t)) / 2
        mixed = (near.join(apart, "token").where(
                    (100 * F.least("n1", "n2") >= t * F.greatest("n1", "n2"))
                    & ((100 + t) * F.abs(F.col("have1") - F.col("have2")) <= differ))
                 .groupBy("p", "q", "have1", "have2", "rest1", "rest2", "n1", "n2").count()
                 .where(F.col("count") + F.greatest("rest1", "rest2") >= bound - 1e-6)
                 .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.lit(False).alias("star")))
        both = tokens.where("kind = 2").select("token", "doc", (F.col("n") * 16 + 1).alias("size"))
        met = scratch.settle(_met(both.distinct(), False), "met")
        again = _candidates(met, t, level == LEVELS - 2, SMALL_WITHIN).select("a", "b", "star")
        pairs = scratch.settle(again.union(mixed).groupBy("a", "b").agg(F.max("star").alias("star")), "pairs")
        scratch.free(met, spread, checked)
    scratch.free(checked, sets)
    return rows, found


def near_duplicates(docs: DataFrame, scratch: Scratch, shingle: int = 5, t: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id."""
    rows, links = link_documents(docs, scratch, shingle, t)
    joined = components(scratch, links)
    return rows.join(joined, F.col("rep") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"),
        F.coalesce("rep", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, scratch: Scratch, shingle: int = 5, t: int = 80) -> DataFrame:
    """Documents with all their columns, of each component the one of the smallest id; rows without an id stay.

    A document is an id and a text: where an id has several texts, documents are numbered in the order of (id, hash of
    the text) and compared by number; of rows with the same id and text one stays.
    """
    number = free_name(docs, "number")
    tag = F.xxhash64("text")
    keys = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), tag.alias("tag"))
    several = keys.groupBy("id").agg(F.min("tag").alias("low"), F.max("tag").alias("high")).where("low <> high")
    numbered = docs.withColumn(number, F.col("doc_id").cast("long"))
    if several.limit(1).count():
        ranges = scratch.settle(keys.distinct().repartitionByRange("id", "tag").withColumn(
            "range", F.spark_partition_id()), "ranges")
        order = [F.col("id"), F.col("tag")]
        numbers = spread_row_number(ranges, [], F.col("range"), order, "place").select("id", "tag", "place")
        numbered = scratch.settle(
            docs.join(numbers, (docs["doc_id"].cast("long") == numbers["id"]) & (tag == numbers["tag"]), "left").select(
                *(docs[c] for c in docs.columns), numbers["place"].alias(number)), "numbered")
    drop = near_duplicates(numbered.select(F.col(number).alias("doc_id"), "text"), scratch, shingle, t).where(
        "doc_id <> component_id").select(F.col("doc_id").alias(free_name(numbered, "gone"))).distinct()
    left = numbered.join(drop, numbered[number] == drop[drop.columns[0]], "left_anti")
    kept = left.where(F.col(number).isNotNull()).dropDuplicates([number])
    return left.where(F.col(number).isNull()).unionByName(kept).select(*docs.columns)
