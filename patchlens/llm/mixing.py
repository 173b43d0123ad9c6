"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in the order of a hash, are one long stream of words, run through up to twice and cut into
blocks of equal length. Golden-ratio points pick a source for every slot; the k-th slot of a source takes its k-th
block.

Edge cases: a null text has size 0; a source without words has target 0; null is a source of its own, the last;
documents of size 0 take nothing; repeated rows, and rows that share an id, are documents of their own; an empty table
gives no rows; other columns stay as they are, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlens.operators.grouping import spread_row_number

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK = 2048
GOLDEN = 0.6180339887498949  # fixed value: fractional part of the golden ratio
LOW = 1 << 20
GOLDEN_HIGH = (LOW * GOLDEN) % 1.0
CHUNK = 4096


def with_size(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """(source, rank, source_size, weight, target): targets by weight, none above `most` times the source's size.

    Sources are sorted by the level at which they are full; the common level is then a matter of running sums over
    one row a source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("double")).withColumn(
        "full", most * F.col("source_size") / F.col("weight"))
    everything = Window.partitionBy()
    order = Window.orderBy("full", "rank")
    before = F.coalesce(F.sum(most * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (share * F.sum("source_size").over(everything) - before) / left)
    level = F.max(F.when(F.col("level") <= F.col("full"), F.col("level"))).over(everything)
    return per.withColumn("target", F.least(F.col("weight") * F.coalesce(level, F.col("full")),
                                            most * F.col("source_size"))).select(
        "source", "rank", "source_size", "weight", "target")


def _shuffled(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(seed)))


def streams(sized: DataFrame, targets: DataFrame, seed: str = "mix") -> DataFrame:
    """Documents with their place in their source's shuffled stream: start is the words before them.

    A source's running sum is taken in bins of the hash: sums of whole bins first, then inside each bin.
    """
    d = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select(
        "doc_id", sized["source"].alias("source"), "size", "tag", "rank", "source_size", "target",
        _shuffled(F.col("doc_id"), seed).alias("h")).withColumn("bin", F.substring("h", 1, 3))
    sums = d.groupBy("rank", "bin").agg(F.sum("size").alias("words"))
    sums = sums.select(F.col("rank").alias("r"), F.col("bin").alias("b"), F.coalesce(F.sum("words").over(
        Window.partitionBy("rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("rank", "bin").orderBy("h", "doc_id", "size", "tag").rowsBetween(
        Window.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return d.join(sums, (d["rank"] == sums["r"]) & (d["bin"] == sums["b"])).select(
        "doc_id", "source", "size", "tag", "rank", "source_size", "target", (F.col("base") + F.col("inside")).alias("start"))


def quota(target: Column, source_size: Column, most: int = 2) -> Column:
    """Whole words that a source gives."""
    return F.least(F.floor(target + 0.5).cast("long"), most * source_size)


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, rank, block): every block of every source's quota in one slot, sources interleaved evenly.

    Slots are golden-ratio points in cells as wide as each source's number of blocks. A source's slots are ranked in
    chunks of slots. The few slots that a source gets beyond its blocks go to sources that are short of as many.
    """
    need = targets.select("rank", F.ceil(quota(F.col("target"), F.col("source_size")) / F.lit(block)).cast(
        "long").alias("need")).where("need > 0")
    need = need.withColumn("to", F.sum("need").over(Window.orderBy("rank"))).withColumn(
        "from", F.col("to") - F.col("need"))
    total, sources = need.agg(F.max("to"), F.count("*")).first()
    spark = targets.sparkSession
    if not total:
        return spark.createDataFrame([], "slot long, rank int, block long")
    bins = 1024 + 4 * sources
    cells = need.withColumn("bin", F.explode(F.sequence(
        F.floor(F.col("from") * bins / total), F.floor((F.col("to") - 1e-9) * bins / total))))
    i = F.col("slot")
    u = F.floor(i / LOW) * GOLDEN_HIGH
    u = (u - F.floor(u)) + (i % LOW) * GOLDEN
    u = (u - F.floor(u)) * F.lit(float(total))
    points = spark.range(total).withColumnRenamed("id", "slot").withColumn("u", u).withColumn(
        "bin", F.floor(F.col("u") * bins / total)).withColumn("chunk", F.floor(i / CHUNK))
    dealt = points.join(cells, "bin").where("u >= from and u < to").select("slot", "chunk", "rank", "need")
    sums = dealt.groupBy("rank", "chunk").agg(F.count("*").alias("n")).select(
        "rank", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("rank").orderBy("chunk").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("rank", "chunk").orderBy("slot")) - 1
    ranked = dealt.withColumn("inside", inside).join(sums, ["rank", "chunk"]).select(
        "slot", "rank", "need", (F.col("base") + F.col("inside")).alias("block"))
    used = ranked.where("block < need").select("slot", "rank", "block")
    # a handful a source: the discrepancy of the points
    spare = ranked.where("block >= need").select("slot", F.row_number().over(Window.orderBy("slot")).alias("n"))
    got = dealt.groupBy("rank").agg(F.count("*").alias("got"))
    short = need.join(got, "rank", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    short = short.select("rank", F.explode(F.sequence("got", F.col("need") - 1)).alias("block"))
    short = short.withColumn("n", F.row_number().over(Window.orderBy("rank", "block")))
    return used.union(spare.join(short, "n").select("slot", "rank", "block"))


def mix(docs: DataFrame, scratch, block: int = BLOCK, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS):
    """(pieces, streams). pieces: slot, doc_id, source, rank, start, size, pass, from_word, n_words - the mix in the
    order of its slots; streams: all documents with their sizes and targets."""
    sized = scratch.settle(with_size(docs).select("doc_id", "source", "size", F.xxhash64("text").alias("tag")), "sizes")
    targets = scratch.settle(source_targets(sized, weights), "targets")
    placed = scratch.settle(streams(sized, targets, seed), "streams")
    q = quota(F.col("target"), F.col("source_size"))
    runs = (placed.where("size > 0").withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
            .withColumn("at", F.col("start") + F.col("pass") * F.col("source_size"))
            .withColumn("end", F.least(F.col("at") + F.col("size"), q)).where("at < end")
            .withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block),
                                                      F.floor((F.col("end") - 1) / block)))))
    first = F.greatest(F.col("at"), F.col("block") * block)
    pieces = runs.select(
        "doc_id", "source", "rank", "start", "size", "pass", "block", (first - F.col("at")).alias("from_word"),
        (F.least(F.col("end"), (F.col("block") + 1) * block) - first).alias("n_words"))
    return pieces.join(schedule(targets, block), ["rank", "block"]), placed


def placed_words(docs: DataFrame, scratch, **settings) -> DataFrame:
    """Each document with its place in its source's stream, its source's target and the words that the mix takes from
    it, repeats counted; tag is a hash of its text."""
    pieces, placed = mix(docs, scratch, **settings)
    taken = pieces.groupBy("rank", "start").agg(F.sum("n_words").alias("taken"))
    cols = ["doc_id", "source", "tag", "start", "size", "source_size", F.col("target").cast("double").alias("target")]
    some = placed.where("size > 0").join(taken, ["rank", "start"], "left")
    return some.select(*cols, F.coalesce("taken", F.lit(0)).cast("long").alias("taken")).union(
        placed.where("size = 0").select(*cols, F.lit(0).cast("long")))


def taken_words(docs: DataFrame, scratch, **settings) -> DataFrame:
    """Each document with its source's target and the words that the mix takes from it, repeats counted."""
    return placed_words(docs, scratch, **settings).drop("source", "tag", "start")


def _identity(doc_id: Column, source: Column, tag: Column) -> Column:
    """One string for an id, a source and a text; nulls differ from all values."""
    return F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("-")), tag,
                       F.coalesce(F.concat(F.lit("="), source), F.lit("-")))


def mixed_documents(docs: DataFrame, scratch, **settings) -> DataFrame:
    """The documents of the mix with all their columns: the words taken, a second pass after the first; a document
    of which nothing is taken goes. Copies of one id, source and text stand one behind the other in the stream; each
    row takes one of their places."""
    places = scratch.settle(placed_words(docs, scratch, **settings).where("size > 0").select(
        _identity(F.col("doc_id"), F.col("source"), F.col("tag")).alias("key"), "start", "size", "taken"), "places")
    groups = places.groupBy("key").agg(F.count("*").alias("copies"), F.min("start").alias("first"))
    parts = places.join(groups, "key").where("taken > 0").select(
        "key", ((F.col("start") - F.col("first")) / F.col("size")).cast("long").alias("copy"), "size", "taken")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row")).withColumn("key", _identity(
        F.col("row.doc_id"), F.col("row.source"), F.xxhash64("row.text")))
    many = groups.where("copies > 1").select("key")
    numbered = rows.withColumn("copy", F.lit(0).cast("long"))
    if many.limit(1).count():
        # written with the number of the task that wrote them, so that a group is counted by parts
        repeated = scratch.settle(rows.join(many, "key", "left_semi").withColumn("part", F.spark_partition_id()), "repeats")
        counted = spread_row_number(repeated, ["key"], F.col("part"), [F.xxhash64("row")], "copy")
        numbered = numbered.join(many, "key", "left_anti").unionByName(
            counted.select("row", "key", (F.col("copy") - 1).cast("long").alias("copy")))

    def first_words(text: Column, n: Column) -> Column:
        """The text up to the end of its n-th word and the gap after it."""
        body = F.regexp_replace(text, r"^[\x20\x09-\x0D]+", "")
        parts = F.split(body, r"[\x20\x09-\x0D]+", F.greatest(n, F.lit(1)).cast("int") + 1)
        rest = F.when(F.size(parts) > n, F.char_length(F.element_at(parts, -1))).otherwise(0)
        return F.when(n <= 0, F.lit("")).otherwise(F.substring(body, F.lit(1), F.char_length(body) - rest))

    size, n, whole = F.col("size"), F.col("taken"), F.col("row.text")
    text = (F.when(n == size, whole)
            .when(n == 2 * size, F.concat(whole, F.lit("\n"), whole))
            .when(n < size, first_words(whole, n))
            .otherwise(F.concat(whole, F.lit("\n"), first_words(whole, n - size))))
    d = numbered.join(parts, ["key", "copy"]).withColumn("text", text)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return d.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST(CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM per),
lev AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS filled FROM weighed),
levels AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
    - coalesce(sum(2.0::DOUBLE * source_size) OVER (
        ORDER BY filled, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY filled, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM lev),
targets AS (
  SELECT source, rank, source_size,
    least(weight * max(CASE WHEN level <= filled THEN level END) OVER (), 2.0::DOUBLE * source_size) AS target
  FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target, least(CAST(floor(target + 0.5) AS BIGINT), 2 * source_size) AS quota,
    coalesce(CAST(sum(size) OVER (PARTITION BY rank ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || 'mix'),
      doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(start + size, quota) - start)
    + greatest(0, least(start + size, quota - source_size) - start) AS BIGINT) AS taken
FROM placed
"""
