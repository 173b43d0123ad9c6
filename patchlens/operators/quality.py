"""Row filters, label repair and audits of a pair table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlens.functions import labels as lx
from patchlens.functions import text as fx
from patchlens.functions import vectors as vx
from patchlens.functions.patterns import found, squeeze
from patchlens.operators.grouping import SALTS, first_per_group, range_bins, with_group_count
from patchlens.rules import lexicon as L


def keep_fix_commits(commits: DataFrame, message: str = "message") -> DataFrame:
    return commits.where(lx.is_fix_commit(F.col(message)))


def drop_blocked_owners(df: DataFrame, repository: str = "repository",
                        blocked: list[str] = L.BLOCKED_OWNERS,
                        owner_type: str | None = None) -> DataFrame:
    """Drop repositories of listed owners, and of organisations when the type column is given."""
    owner = F.lower(F.substring_index(F.col(repository), "/", 1))
    keep = ~owner.isin(blocked)
    if owner_type is not None:
        keep &= F.coalesce(F.col(owner_type) != "Organization", F.lit(True))
    return df.where(keep)


def patch_size_filter(df: DataFrame, path: str = "filename", limit: int = 35) -> DataFrame:
    changes = F.coalesce(F.col("additions"), F.lit(0)) + F.coalesce(F.col("deletions"), F.lit(0))
    return df.where(
        F.lower(fx.extension(F.col(path))).isin(L.SOURCE_EXTENSIONS)
        & changes.between(1, limit) & (F.col("patch") != ""))


def is_source_file(path: Column, ignored: list[str] = L.IGNORED_DIRS,
                   extensions: list[str] = L.SOURCE_EXTENSIONS) -> Column:
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.split(clean, "/")
    dirs = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), F.lower)
    name = F.element_at(parts, -1)
    return (F.substring_index(name, ".", -1).isin(extensions)
            & ~F.arrays_overlap(dirs, F.array(*map(F.lit, ignored)))
            & ~name.rlike("(?i)" + "|".join(f"(?:{p})" for p in L.IGNORED_NAMES)))


def reliable_tier(tier: Column) -> Column:
    return F.coalesce(tier.startswith("tier_1") | tier.startswith("tier_2"), F.lit(False))


def joint_tier(before: Column, after: Column) -> Column:
    good = reliable_tier(before) & reliable_tier(after)
    return F.when(good, before).otherwise(
        F.concat(F.lit("unreliable:"), before, F.lit("|"), after))


def accept_label(df: DataFrame, label: str = "label", minimum: float = 0.80) -> DataFrame:
    r = F.col(label)
    return df.where((r["decision"] == "accept") & r["bug_type"].isin(L.APPROVED_TYPES)
                    & (r["confidence"] >= minimum))


def quality_filter(df: DataFrame, key: str, before: str = "buggy_code", after: str = "fixed_code",
                   label: str = "bug_type", shortest: int = 15) -> DataFrame:
    """Complete, changed, long enough, and one row per (code, label): the one with lowest key."""
    rows = df.where(
        F.col(before).isNotNull() & F.col(after).isNotNull() & F.col(label).isNotNull()
        & (squeeze(F.col(before)) != squeeze(F.col(after)))
        & (F.length(before) >= shortest))
    keyed = rows.withColumn("_code", F.sha2(F.col(before), 256))
    return first_per_group(keyed, ["_code", label], [F.col(key)]).drop("_code")


def drop_rare_classes(df: DataFrame, label: str, least: int) -> DataFrame:
    return with_group_count(df, [label], "_n").where(F.col("_n") >= least).drop("_n")


def dedupe_pairs(df: DataFrame, commit: list[str], before: str, after: str,
                 order: list[Column]) -> DataFrame:
    """Within a commit keep the first of equal (before, after)."""
    digest = F.sha2(F.concat_ws("\x00", F.length(before).cast("string"), before, after), 256)
    keyed = df.withColumn("_pair", digest)
    return first_per_group(keyed, [*commit, "_pair"], order).drop("_pair")


def code_digest(code: str) -> Column:
    return F.sha2(F.col(code), 256)


def majority_label(df: DataFrame, code: str, label: str) -> DataFrame:
    """Most frequent label per snippet digest; ties go to the smallest label."""
    counts = (df.where(F.col(label).isNotNull())
              .groupBy(code_digest(code).alias("code_key"), F.col(label).alias("_l"))
              .agg(F.count(F.lit(1)).alias("_n")))
    return counts.groupBy("code_key").agg(
        F.min(F.struct((-F.col("_n")).alias("k"), F.col("_l").alias("l"))).alias("best")
    ).select("code_key", F.col("best.l").alias("majority"))


def map_back_majority(df: DataFrame, code: str, label: str) -> DataFrame:
    """Every row takes the majority label of its snippet."""
    best = majority_label(df, code, label)
    # a snippet that is copied everywhere is one key: its rows are dealt over salts, and so is its label
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")
    salted = best.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (df.withColumns({"code_key": code_digest(code), "_salt": salt}).join(salted, ["code_key", "_salt"])
            .drop("code_key", "_salt", label).withColumnRenamed("majority", label))


def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and their share per column, in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pieces = ", ".join(f"'{c}', `{c}`" for c in columns)
    return one.selectExpr("n", f"stack({len(columns)}, {pieces}) AS (column_name, nulls)").select(
        "column_name", "nulls", (F.col("nulls") * 100.0 / F.col("n")).alias("pct"))


def vector_audit(df: DataFrame, before: str, after: str, n: int = 64) -> DataFrame:
    """Malformed vectors, and all-zero ones among rows where both sides parse."""
    def parsed(c):
        v = F.from_json(F.col(c), "array<double>")
        return v.isNotNull() & (F.size(v) == n) & ~F.exists(v, lambda x: x.isNull())

    both = parsed(before) & parsed(after)

    def all_zero(c):
        return both & ~vx.is_nonzero(vx.parse_vector(F.col(c), n))

    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(~both).alias("malformed"),
                  F.count_if(all_zero(before)).alias("zero_before"),
                  F.count_if(all_zero(after)).alias("zero_after"))


def duplicate_audit(df: DataFrame, code: str) -> DataFrame:
    """Rows in duplicate groups and rows beyond the first. Counts are combined before the shuffle,
    so a snippet copied everywhere is no hot spot."""
    groups = df.groupBy(code_digest(code).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    many = F.when(F.col("n") > 1, F.col("n")).otherwise(0)
    return groups.agg(F.coalesce(F.sum(many), F.lit(0)).alias("in_duplicate_groups"),
                      F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("beyond_first"))


def label_conflicts(df: DataFrame, code: str, label: str) -> DataFrame:
    """Number of snippets that carry more than one label."""
    kinds = (df.groupBy(code_digest(code).alias("k"), F.col(label).alias("l"))
             .agg(F.count(F.lit(1)).alias("n")).where("l IS NOT NULL")
             .groupBy("k").agg(F.count(F.lit(1)).alias("kinds")))
    return kinds.where("kinds > 1").agg(F.count(F.lit(1)).alias("conflicts"))


def numeric_profile(df: DataFrame, column: str) -> DataFrame:
    """Mean, least, greatest and exact median. Values are counted first; the median is found by
    running counts over ranges of the distinct values, of which only their totals meet."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(
        F.count(F.lit(1)).alias("n"))
    ranged = range_bins(counts, [F.col("v")])
    totals = ranged.groupBy(F.col("_range").alias("_r")).agg(F.sum("n").alias("_t"))
    everything = Window.partitionBy()  # one row a range
    totals = totals.withColumns({
        "_before": F.sum("_t").over(everything.orderBy("_r")) - F.col("_t"), "_all": F.sum("_t").over(everything)})
    inside = F.sum("n").over(Window.partitionBy("_range").orderBy("v")) - F.col("n")
    placed = ranged.withColumn("_in", inside).join(totals, F.col("_range") == F.col("_r"))
    at = F.col("_before") + F.col("_in")

    def holds(place):
        return F.when((at <= place) & (place < at + F.col("n")), F.col("v"))

    middle = F.max(holds(F.floor((F.col("_all") - 1) / 2))) + F.max(holds(F.floor(F.col("_all") / 2)))
    return placed.agg(
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("v").alias("least"), F.max("v").alias("greatest"), (middle / 2).alias("median"))


def audit_pairs(df: DataFrame, before: str = "buggy_code", after: str = "fixed_code",
                before_vector: str = "buggy_ast_vector", after_vector: str = "fixed_ast_vector",
                label: str = "bug_type", n: int = 64) -> DataFrame:
    """One (metric, value) table from the separate audits."""
    def tall(one: DataFrame, prefix: str = "") -> DataFrame:
        cols = one.columns
        pieces = ", ".join(f"'{prefix}{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
        return one.selectExpr(f"stack({len(cols)}, {pieces}) AS (metric, value)")

    nulls = null_audit(df, [before, after, label]).select(
        F.concat(F.lit("nulls_"), "column_name").alias("metric"),
        F.col("nulls").cast("double").alias("value"))
    pairs = df.agg(F.count_if(F.col(before) == F.col(after)).alias("identical_pairs"),
                   F.count_if(F.length(F.coalesce(F.col(before), F.lit(""))) < 20)
                   .alias("short_snippets"))
    lengths = df.select(F.length(F.coalesce(F.col(before), F.lit(""))).alias("length"))
    parts = [nulls, tall(vector_audit(df, before_vector, after_vector, n), "vectors_"),
             tall(duplicate_audit(df, before)), tall(pairs),
             tall(label_conflicts(df, before, label), "label_"),
             tall(numeric_profile(lengths, "length"), "length_")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
