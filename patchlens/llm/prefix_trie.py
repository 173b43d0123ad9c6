"""Trie of conversation prefixes by van Emde Boas recursion.

Sequences of turns are cut at half of the depth. The cut prefixes get names; what lies above the cut is one upper trie,
what follows each name is a lower trie of a forest. Both halves are cut again, all blocks of one size in the same
Spark jobs, so a trie of depth D takes log2(D) rounds. A name is the digest of its block root's name and of the items
between, so equal prefixes get equal names without meeting. Totals are grafted upward in the same rounds: a block's
lower tries hand the totals of their roots to the nodes above them in the block, and to no others.

Depth d is the cut of one block alone: that of size 2 * low(d) around it, low(d) being the lowest bit of d; the block
begins at d - low(d). Turns stay rows: no conversation, node or subtree is held as one value or one task's group.

Edge cases: rows without a conversation id are left out; a null role or text is empty; equal turns of a conversation
stand in order of role, then text; repeated rows are turns of their own; a conversation without turns after the
rebuild ends in the root; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlens.llm.common import has_columns

ROOT = hashlib.sha256(b"root").digest()
LANES = 3  # 64-bit words that make up the digest of a run of items
PIECE = 1 << 16  # bytes of joined ids that travel as one row
HEAVY = 10_000  # at most so many nodes are told to all tasks


def item(role: Column, text: Column) -> Column:
    """Digest of a turn; the length keeps role and text apart."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def ordered_turns(turns: DataFrame, scratch, conv_col: str = "conv_id") -> DataFrame:
    """(conv, pos, item, size) of every turn, positions from 1.

    The table is sorted as a whole by ranges, so a very long conversation spreads over tasks. What a range holds of a
    conversation is counted, and only these counts are summed up in order.
    """
    has_columns(turns, conv_col, "turn", "role", "text")
    whole = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = scratch.settle(
        whole.repartitionByRange(*order).sortWithinPartitions(*order).select(
            "conv", item(F.col("role"), F.col("text")).alias("item"), F.length("text").cast("long").alias("size"),
            F.monotonically_increasing_id().alias("at")).withColumn("range", F.shiftright("at", 33)), "turns")
    parts = rows.groupBy("conv", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("conv").orderBy("range")
    offsets = parts.select("conv", "range", (F.sum("n").over(before) - F.col("n") - F.col("first") + 1).alias("shift"))
    return rows.join(offsets, ["conv", "range"]).select("conv", (F.col("at") + F.col("shift")).alias("pos"), "item", "size")


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) with each conversation's first h turns taken from the first of its hundred; h < `most`."""
    head = F.crc32(F.col("conv").cast("string")) % most
    base = F.col("conv") - F.col("conv") % every
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumn("h", head).withColumn("base", base)
    own = turns.where((F.col("pos") > head) | (base == F.col("conv")))
    heads = turns.where(F.col("pos") < most).select(F.col("conv").alias("base"), "pos", "item", "size")
    taken = convs.where("base <> conv AND h > 0").join(heads, "base").where("pos <= h").select("conv", "pos", "item", "size")
    # where the base has fewer turns than h, the conversation's own turns follow at once
    got = taken.groupBy("conv").agg(F.count("*").alias("got"))
    convs = convs.join(got, "conv", "left").select(
        "conv", "n", F.when(F.col("base") == F.col("conv"), 0).otherwise(F.col("h")).alias("h"),
        F.when(F.col("base") == F.col("conv"), 0).otherwise(F.coalesce("got", F.lit(0))).alias("got"))
    moved = own.join(convs.where("got < h").select("conv", (F.col("h") - F.col("got")).alias("gap")), "conv", "left")
    moved = moved.select("conv", (F.col("pos") - F.coalesce("gap", F.lit(0))).alias("pos"), "item", "size")
    ends = convs.select("conv", (F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth"))
    return moved.unionByName(taken), ends


def low(depth: Column) -> Column:
    return depth.bitwiseAND(-depth)


def prefix_names(turns: DataFrame, scratch) -> DataFrame:
    """(conv, depth, name, size): the node of every prefix of every conversation, and the size of its last item.

    The largest block is cut first. In each round all blocks of one size are cut at half: the run of items between a
    block's root and the cut is folded by (conversation, cut) and named together with the root's name.
    """
    deepest = turns.agg(F.max("pos")).first()[0] or 0
    named = None
    for level in reversed(range(deepest.bit_length())):
        half = 1 << level
        at = F.col("pos") - 1
        runs = turns.where(F.shiftright(at, level) % 2 == 0).withColumn(
            "depth", F.shiftleft(F.shiftright(at, level), level) + half)
        lanes = [F.bit_xor(F.xxhash64(F.lit(i), F.col("item"), F.col("pos"))).alias(f"lane{i}") for i in range(LANES)]
        whole = runs.groupBy("conv", "depth").agg(
            F.count("*").alias("n"), F.max(F.when(F.col("pos") == F.col("depth"), F.col("size"))).alias("size"),
            *lanes).where(F.col("n") == half)
        above = F.col("depth") - half
        if named is None:
            whole = whole.withColumn("root", F.lit(ROOT))
        else:
            roots = named.select("conv", F.col("depth").alias("above"), F.col("name").alias("root"))
            whole = whole.withColumn("above", above).join(roots, ["conv", "above"], "left").withColumn(
                "root", F.when(F.col("above") == 0, F.lit(ROOT)).otherwise(F.col("root")))
        parts = [F.hex("root"), F.col("depth").cast("string"), *(F.col(f"lane{i}").cast("string") for i in range(LANES))]
        cut = scratch.settle(whole.select("conv", "depth", F.unhex(F.sha2(F.concat_ws("|", *parts), 256)).alias("name"),
                                          "size"), "names")
        named = cut if named is None else named.unionByName(cut)
    return named


def trie_nodes(named: DataFrame | None, ends: DataFrame) -> DataFrame:
    """(name, depth, conv, n_convs, size) of every node with a member; conv is the smallest member."""
    root = ends.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv")).where("n_convs > 0").select(
        F.lit(ROOT).alias("name"), F.lit(0).cast("long").alias("depth"), "conv", "n_convs", F.lit(0).cast("long").alias("size"))
    if named is None:
        return root
    return named.groupBy("name").agg(
        F.min("depth").alias("depth"), F.min("conv").alias("conv"), F.count("*").alias("n_convs"),
        F.min("size").alias("size")).unionByName(root)


def ancestors(nodes: DataFrame, named: DataFrame) -> DataFrame:
    """(name, depth, above, over): each node with the nodes above it in the block that it cuts, its parent among
    them. The path is read from the node's smallest member; (member, depth) is no hot key."""
    d = F.col("depth")
    steps = nodes.where("depth > 0").select("name", "depth", "conv", F.explode(
        F.sequence(d - low(d), d - 1)).alias("above"))
    paths = named.select("conv", F.col("depth").alias("above"), F.col("name").alias("over"))
    inner = steps.where("above > 0").join(paths, ["conv", "above"])
    return inner.select("name", "depth", "above", "over").unionByName(
        steps.where("above = 0").select("name", "depth", "above", F.lit(ROOT).alias("over")))


def grafted(nodes: DataFrame, links: DataFrame, scratch, deepest: int) -> DataFrame:
    """(name, n_leaves, saved_tokens): totals over subtrees, from the nodes' own values (leaf, saved).

    The smallest blocks come first. A node that cuts a block has its total over the lower half by then; the nodes
    above it in the block add it to theirs.
    """
    totals = nodes.select("name", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    for level in range(deepest.bit_length()):
        cut = links.where(low(F.col("depth")) == 1 << level).select("name", "over")
        handed = cut.join(totals, "name").groupBy(F.col("over").alias("name")).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        totals = scratch.settle(totals.join(handed, "name", "left").select(
            "name", (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens")), "totals")
    return totals


def parents_of(links: DataFrame, nodes: DataFrame, children: DataFrame) -> DataFrame:
    """(name, parent): the smallest member of each node's parent.

    Of `n` nodes at most HEAVY have n / HEAVY children or more: these go to all tasks, so that no key that is dealt
    has more than such a share of the rows.
    """
    least = max(1000, nodes.count() // HEAVY)
    known = nodes.select(F.col("name").alias("over"), F.col("conv").alias("parent"))
    heavy = children.where(F.col("n_children") > least).join(known, "over").select("over", F.col("parent").alias("told"))
    light = known.select(F.col("over").alias("meet"), "parent")
    up = links.where("above = depth - 1").select("name", "over").join(F.broadcast(heavy), "over", "left")
    up = up.withColumn("meet", F.when(F.col("told").isNull(), F.col("over")).otherwise(F.col("name")))
    return up.join(light, "meet", "left").select("name", F.coalesce("told", "parent").alias("parent"))


def joined_ids(ends: DataFrame, scratch) -> DataFrame:
    """(name, ends_sha256): digest of the ascending ids of the conversations that end in a node, joined by commas.

    Ids are sorted over the whole table by ranges and joined there to pieces of bounded size. A digest needs its bytes
    in order, so the pieces of one node pass through one task, one at a time, and are not kept.
    """
    order = ["name", "conv"]
    ranged = ends.select("name", "conv").repartitionByRange(*order).sortWithinPartitions(*order)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first, held, size = None, 0, [], 0
        out: list[tuple] = []
        for batch in batches:
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != name or size > PIECE:
                    if held:
                        out.append((name, first, ",".join(held)))
                    name, first, held, size = key, conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            yield _batch(out, PIECES)
            out = []
        if held:
            yield _batch([(name, first, ",".join(held))], PIECES)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            out = []
            for key, piece in zip(batch.column(0).to_pylist(), batch.column(2)):
                if key != name:
                    if state:
                        out.append((name, state.hexdigest()))
                    name, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.as_py().encode())
            yield _batch(out, DIGESTS)
        if state:
            yield _batch([(name, state.hexdigest())], DIGESTS)

    pieces = scratch.settle(ranged.mapInArrow(join, "name binary, first long, piece string"), "ends")
    return pieces.repartition("name").sortWithinPartitions("name", "first").mapInArrow(
        digest, "name binary, ends_sha256 string")


PIECES = pa.schema([("name", pa.binary()), ("first", pa.int64()), ("piece", pa.string())])
DIGESTS = pa.schema([("name", pa.binary()), ("ends_sha256", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)


def prefix_trie(turns: DataFrame, ends: DataFrame, scratch) -> DataFrame:
    """One row per node of the trie of the sequences `turns` (conv, pos, item, size); `ends` (conv, depth) has every
    sequence's length, those without turns among them."""
    turns = scratch.settle(turns, "sequences")
    ends = scratch.settle(ends, "lengths")
    named = prefix_names(turns, scratch)
    nodes = scratch.settle(trie_nodes(named, ends), "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    stop = ends.where("depth = 0").select(F.lit(ROOT).alias("name"), "conv")
    if named is None:
        links = None
        tree = nodes.select("*", F.lit(0).cast("long").alias("n_children"), F.lit(None).cast("long").alias("parent"))
    else:
        links = scratch.settle(ancestors(nodes, named), "ancestors")
        children = scratch.settle(
            links.where("above = depth - 1").groupBy("over").agg(F.count("*").alias("n_children")), "children")
        parents = parents_of(links, nodes, children)
        tree = nodes.join(children.withColumnRenamed("over", "name"), "name", "left").join(parents, "name", "left").select(
            *nodes.columns, F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "parent")
        stop = stop.unionByName(named.join(ends, ["conv", "depth"]).select("name", "conv"))
    tree = scratch.settle(tree.withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")).withColumn(
        "saved", (F.col("n_convs") - 1) * F.col("size")), "tree")
    totals = tree.select("name", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    if links is not None:
        totals = grafted(tree, links, scratch, deepest)
    none = hashlib.sha256(b"").hexdigest()
    return tree.join(totals, "name").join(joined_ids(stop, scratch), "name", "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, scratch) -> DataFrame:
    """Trie of the rebuilt conversations."""
    return prefix_trie(*rebuilt(scratch.settle(ordered_turns(conversations, scratch), "positions")), scratch)


ORACLE = r"""
WITH numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
crc_bits AS (
  SELECT c AS byte, list_reduce([c] || range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)
    AS code FROM (SELECT unnest(range(256)) AS c)),
crc_table AS (SELECT list(code ORDER BY byte) AS codes FROM crc_bits),
convs AS (
  SELECT conv_id, xor(list_reduce(
      [4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
      lambda a, b: xor(a >> 8, codes[1 + (xor(a, b) & 255)])), 4294967295) % 6 AS h, conv_id - conv_id % 100 AS base
  FROM (SELECT DISTINCT conv_id FROM numbered), crc_table),
picked AS (
  SELECT c.conv_id AS c, 0 AS part, n.pos, n.role, n.text FROM convs c JOIN numbered n ON n.conv_id = c.base AND n.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, n.pos, n.role, n.text FROM convs c JOIN numbered n ON n.conv_id = c.conv_id AND n.pos > c.h),
seq AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, role, text FROM picked),
paths AS (
  SELECT c, d, sha256(CAST(list([sha256(role), sha256(text)]) OVER (PARTITION BY c ORDER BY d) AS VARCHAR)) AS name,
    length(text) AS size FROM seq
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
nodes AS (
  SELECT name, d, min(c) AS m, count(*) AS n, (count(*) - 1) * any_value(size) AS saved FROM paths GROUP BY name, d),
up AS (
  SELECT y.name AS below, y.d AS below_d, y.saved, p.name AS name, p.d AS d FROM nodes y JOIN paths p ON p.c = y.m AND p.d <= y.d),
kids AS (SELECT name, d, count(*) AS k FROM up WHERE below_d = d + 1 GROUP BY name, d),
sums AS (
  SELECT u.name, u.d, sum(u.saved) AS saved, count(*) FILTER (k.k IS NULL) AS leaves
  FROM up u LEFT JOIN kids k ON k.name = u.below AND k.d = u.below_d GROUP BY u.name, u.d),
lengths AS (SELECT c, max(d) AS d FROM paths GROUP BY c),
ends AS (
  SELECT name, d, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS digest
  FROM paths JOIN lengths USING (c, d) GROUP BY name, d),
parents AS (
  SELECT y.name, y.d, n.m FROM nodes y JOIN paths p ON p.c = y.m AND p.d = y.d - 1 JOIN nodes n ON n.name = p.name AND n.d = p.d)
SELECT CAST(n.m AS BIGINT) AS conv_id, CAST(n.d AS BIGINT) AS depth, CAST(p.m AS BIGINT) AS parent_conv_id,
  CAST(n.n AS BIGINT) AS n_convs, CAST(coalesce(k.k, 0) AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.digest, sha256('')) AS ends_sha256
FROM nodes n JOIN sums s USING (name, d) LEFT JOIN kids k USING (name, d) LEFT JOIN ends e USING (name, d)
LEFT JOIN parents p USING (name, d)
"""
