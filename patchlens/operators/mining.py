"""Mining operators: seen-commit guards, category ranking, caps and record building."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlens.functions import labels as lx
from patchlens.functions import text as fx
from patchlens.functions import vectors as vx
from patchlens.functions.patterns import squeeze
from patchlens.operators.grouping import first_per_group, range_bins, top_per_group
from patchlens.rules import lexicon as L
from patchlens.rules.categories import TOPIC_HINTS
from patchlens.session import discard, settle


def existing_counts(pairs: DataFrame) -> dict[str, DataFrame]:
    """What a prior output already holds: rows per type, rows per repository, seen commits."""
    def counts(c):
        return (pairs.where((F.col(c) != "") & F.col(c).isNotNull())
                .groupBy(c).agg(F.count(F.lit(1)).alias("n")))

    return {"types": counts("bug_type"), "repositories": counts("repository"),
            "commits": pairs.select("commit_hash").where("commit_hash <> ''").distinct()}


def skip_known_commits(commits: DataFrame, known: DataFrame, key: str = "commit_hash"
                       ) -> DataFrame:
    return commits.join(known.select(key), key, "left_anti")


def match_known_repo(url: Column, known: list[tuple[str, str]]) -> Column:
    """Name of the first known (name, url) that equals the URL or whose name is part of it, for a short list."""
    hits = [F.when((url == u) | url.contains(name), F.lit(name)) for name, u in known]
    return F.coalesce(*hits)


GRAM = 4  # characters of the keys by which names and URLs meet


def _grams(text: Column, n: int) -> Column:
    """Distinct substrings of n characters; none where the text is shorter."""
    last = F.length(text) - n + 1
    return F.when(last > 0, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(n))))).otherwise(
        F.array().cast("array<string>"))


def match_known_repos(rows: DataFrame, known: DataFrame, url: str = "url", name: str = "known_repo") -> DataFrame:
    """Add the name of the first known repository (position, name, url) whose URL equals the row's or whose name is part
    of it; null where there is none.

    A name meets the URLs that hold its rarest gram and is then looked for in them, so the work follows the matches and
    not names x URLs. A name shorter than a gram is its own key; an empty name is part of every URL. Each distinct URL is
    looked up once.
    """
    urls = settle(rows.select(F.col(url).alias("_url")).where("_url IS NOT NULL").distinct(), "urls")
    known = settle(known.select("position", "name", F.col("url").alias("_url")), "known")
    named = known.where("name <> ''").groupBy("name").agg(F.min("position").alias("position")).withColumn(
        "_size", F.least(F.length("name"), F.lit(GRAM)))
    sizes = [r[0] for r in named.select("_size").distinct().collect()]  # GRAM at most
    none = F.array().cast("array<string>")
    in_urls = urls.select("_url", F.explode(F.concat(none, *(_grams(F.col("_url"), n) for n in sizes))).alias("gram"))
    often = in_urls.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    of_size = reduce(lambda c, n: c.when(F.col("_size") == n, _grams(F.col("name"), n)), sizes, F.when(F.lit(False), none))
    keys = named.select("name", "position", F.explode(of_size).alias("gram")).join(often, "gram", "left").groupBy(
        "name", "position").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
    keys = keys.where("rarest.n > 0").select("name", "position", F.col("rarest.gram").alias("gram"))
    # the planner takes the exploded URLs for as small as the file they come from and would send them to every task
    inside = in_urls.hint("merge").join(keys, "gram").where(F.contains("_url", "name"))
    equal = urls.join(known.where("name IS NOT NULL"), "_url")
    first = F.min(F.struct("position", "name")).alias("first")
    found = inside.select("_url", "position", "name").unionByName(equal.select("_url", "position", "name")).groupBy(
        "_url").agg(first)
    # one row: the first empty name, which every URL holds
    empty = known.agg(F.min(F.when(F.col("name") == "", F.col("position"))).alias("_empty"))
    best = urls.join(found, "_url", "left").crossJoin(F.broadcast(empty)).select(
        "_url", F.when(F.col("_empty") <= F.coalesce("first.position", F.col("_empty")), "").otherwise(
            F.col("first.name")).alias("_name"))
    return rows.join(best.where("_name IS NOT NULL"), F.col(url) == F.col("_url"), "left").withColumn(
        name, F.col("_name")).drop("_url", "_name")


def first_fix_commits(commits: DataFrame, latest: int = 30, keep: int = 5) -> DataFrame:
    """First fix commits among the latest of each repository, by position."""
    recent = top_per_group(commits, ["repository"], [F.col("position")], latest, ["position"],
                           "_recent")
    fixes = recent.where(lx.is_fix_commit(F.col("message")))
    w = Window.partitionBy("repository").orderBy("position")  # at most `latest` rows per key
    return (fixes.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep)
            .drop("_rn", "_recent"))


def category_room(counts: DataFrame, caps: dict[str, int] = L.CATEGORY_CAPS,
                  label: str = "bug_type") -> DataFrame:
    """Room per category: cap less what is there, never below 0. One row per category."""
    spark = counts.sparkSession
    dims = spark.createDataFrame([(c, i, n) for i, (c, n) in enumerate(caps.items())],
                                 f"{label} string, position int, cap int")
    return dims.join(counts, label, "left").select(
        label, "position",
        F.greatest(F.lit(0), F.col("cap") - F.coalesce("n", F.lit(0))).alias("room"))


def category_need(counts: DataFrame, caps: dict[str, int] = L.CATEGORY_CAPS,
                  label: str = "bug_type") -> DataFrame:
    """Categories with room, most room first; ties in the caps' order."""
    return category_room(counts, caps, label).where("room > 0").orderBy(
        F.col("room").desc(), "position")


def search_plan(need: DataFrame, label: str = "bug_type") -> DataFrame:
    """Topics of needy categories by need, then the generic ones; each topic once."""
    spark = need.sparkSession
    hints = spark.createDataFrame(
        [(c, i, t) for c, topics in TOPIC_HINTS.items() for i, t in enumerate(topics)],
        f"{label} string, place int, topic string")
    generic = spark.createDataFrame(
        [(i, t) for i, t in enumerate(L.GENERIC_TOPICS)], "place int, topic string")
    wanted = (need.join(hints, label)
              .select("topic", F.struct(F.lit(0).alias("part"), (-F.col("room")).alias("need"),
                                        "position", "place").alias("at")))
    rest = generic.select("topic", F.struct(
        F.lit(1).alias("part"), F.lit(0).alias("need"), F.lit(0).alias("position"),
        "place").alias("at"))
    firsts = wanted.unionByName(rest).groupBy("topic").agg(F.min("at").alias("at"))
    # topic lists are rule data: about a hundred rows
    return firsts.select("topic", F.row_number().over(Window.orderBy("at")).alias("place"))


def best_category_by_need(scores: Column, room: dict[str, int],
                          default: str = "logic_error") -> Column:
    """Top score; ties go to the category with most room, then to rule order."""
    rooms = F.create_map(*[F.lit(x) for kv in room.items() for x in kv])
    keyed = F.transform(F.filter(scores, lambda s: s["score"] > 0), lambda s: F.struct(
        (-s["score"]).alias("a"), (-F.coalesce(F.try_element_at(rooms, s["category"]), F.lit(0)))
        .alias("b"), s["rank"].alias("c"), s["category"].alias("category")))
    return F.coalesce(F.array_min(keyed)["category"], F.lit(default))


def cap_per_group(df: DataFrame, category: str, repository: str, order: list[str],
                  caps: dict[str, int] = L.CATEGORY_CAPS,
                  default_cap: int = L.DEFAULT_CATEGORY_CAP,
                  per_repository: int = L.DEFAULT_PER_REPOSITORY,
                  repository_counts: DataFrame | None = None,
                  category_counts: DataFrame | None = None,
                  target: int | None = None) -> DataFrame:
    """At most k rows per repository, then at most cap rows per category, in `order`.

    Rows already in the output (counts with column n) reduce the room. Both ranks are cut in
    salted parts first, so no hot repository or category sits in one task.
    """
    by = [F.col(c) for c in order]
    rows = top_per_group(df, [repository], by, per_repository, order, "_repo_rank")
    if repository_counts is not None:
        had = repository_counts.select(repository, F.col("n").alias("_had"))
        rows = rows.join(had, repository, "left").where(
            F.col("_repo_rank") <= per_repository - F.coalesce("_had", F.lit(0))).drop("_had")
    most = max([default_cap, *caps.values()])
    rows = top_per_group(rows, [category], by, most, order, "_category_rank")
    cap = reduce(lambda c, kv: c.when(F.col(category) == kv[0], kv[1]), caps.items(),
                 F.when(F.lit(False), 0)).otherwise(default_cap)
    if category_counts is not None:
        had = category_counts.select(category, F.col("n").alias("_had"))
        rows = rows.join(had, category, "left")
        cap = cap - F.coalesce("_had", F.lit(0))
    rows = rows.where(F.col("_category_rank") <= cap).drop("_had", "_repo_rank", "_category_rank")
    return rows.orderBy(*by).limit(target) if target is not None else rows


def _counts_before(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """Admitted and open rows before each row of its group. Ranges of the order are counted first, so a group's rows
    are only ordered inside a range."""
    by = [key, "_range"]
    flags = {f"{name}_in": F.col("_in").cast("int"), f"{name}_open": (~F.col("_in")).cast("int")}
    sums = rows.groupBy(*by).agg(*(F.sum(x).alias(n) for n, x in flags.items()))
    so_far = Window.partitionBy(key).orderBy("_range")
    offsets = sums.select(*by, *((F.sum(n).over(so_far) - F.col(n)).alias(f"{n}_0") for n in flags))
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(offsets, by).select("*", *((F.col(f"{n}_0") + F.coalesce(F.sum(x).over(inside), F.lit(0))).alias(n)
                                                for n, x in flags.items())).drop(*(f"{n}_0" for n in flags))


def cap_per_group_greedy(df: DataFrame, category: str, repository: str, order: list[str],
                         caps: dict[str, int], per_repository: int, default_cap: int = 0,
                         repository_counts: DataFrame | None = None, category_counts: DataFrame | None = None,
                         target: int | None = None) -> DataFrame:
    """Row-by-row admission in `order`: a row refused by its category leaves its repository's room alone.

    Counts only grow, so the rows admitted for one (category, repository) are a prefix of at most `per_repository`
    rows; that prefix is taken first. Then rounds settle what is certain: a row is admitted once the admitted and the
    still open rows before it leave room in both groups, and refused once the admitted ones alone fill one of them. The
    first open row is always settled, so the rounds end; rows that share no full group are settled together. Equal rows
    in `order` go by a hash of the whole row.
    """
    by = [F.col(c) for c in order]
    rows = top_per_group(df, [category, repository], by, per_repository, order, "_prefix").drop("_prefix")

    def named(c: str) -> Column:  # nulls are a group of their own, which joins would lose
        return F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(c).cast("string")))

    cap = reduce(lambda c, kv: c.when(F.col(category) == kv[0], kv[1]), caps.items(),
                 F.when(F.lit(False), 0)).otherwise(default_cap)
    rows = rows.withColumns({"_c": named(category), "_r": named(repository), "_cap": cap, "_most": F.lit(per_repository),
                             "_tie": F.xxhash64(*df.columns), "_in": F.lit(False)})
    for counts, column, key, room in ((category_counts, category, "_c", "_cap"), (repository_counts, repository, "_r", "_most")):
        if counts is not None:
            had = counts.select(named(column).alias(key), F.col("n").alias("_had"))
            rows = rows.join(had, key, "left").withColumn(room, F.col(room) - F.coalesce("_had", F.lit(0))).drop("_had")
    by = [*by, F.col("_tie")]
    rows = range_bins(rows.where("_cap > 0 AND _most > 0"), by)
    kept = rows.columns
    while not rows.where("NOT _in").isEmpty():
        seen = _counts_before(_counts_before(rows, "_c", by, "_of_c"), "_r", by, "_of_r")
        refused = ~F.col("_in") & ((F.col("_of_c_in") >= F.col("_cap")) | (F.col("_of_r_in") >= F.col("_most")))
        admitted = ((F.col("_of_c_in") + F.col("_of_c_open") < F.col("_cap"))
                    & (F.col("_of_r_in") + F.col("_of_r_open") < F.col("_most")))
        before, rows = rows, settle(seen.where(~refused).withColumn("_in", F.col("_in") | admitted).select(*kept), "admitted")
        discard(before)
    out = rows if target is None else rows.orderBy(*by).limit(target)
    return out.select(*df.columns)


def build_record(df: DataFrame) -> DataFrame:
    """Final projection of a mined row, from its commit columns and accepted `label` struct."""
    r, path = F.col("label"), F.col("file_path")
    return df.select(
        "repository", "commit_hash", "file_path", fx.language_of(path).alias("language"),
        r["bug_type"].alias("bug_type"),
        F.substring(F.replace(squeeze(F.col("message")), F.lit("\n"), F.lit(" ")), 1, 300)
        .alias("original_commit_message"),
        "buggy_code", "fixed_code",
        vx.vector_json(F.col("buggy_vector")).alias("buggy_ast_vector"),
        vx.vector_json(F.col("fixed_vector")).alias("fixed_ast_vector"), "ast_tier",
        r["bug_description"].alias("bug_description"), r["root_cause"].alias("root_cause"),
        r["fix_description"].alias("fix_description"),
        fx.severity_default(r["severity"], r["bug_type"]).alias("severity"),
        fx.bug_pattern(r["evidence"], r["bug_type"]).alias("bug_pattern"),
        fx.component_simple(path).alias("affected_component"),
        F.bround(r["confidence"], 2).alias("confidence_score"), "match_margin",
        F.lit("semantic").alias("label_source"),
        F.substring(F.array_join(r["evidence"], "; "), 1, 500).alias("label_reason"),
        F.lit("validated").alias("validation_status"))


def mining_summary(records: DataFrame, candidates: int | None = None) -> DataFrame:
    """Rows, repositories and rows per type of a mining output."""
    total = records.agg(F.count(F.lit(1)).alias("records_added"),
                        F.count_distinct("repository").alias("repositories"))
    total = total.selectExpr("stack(2, 'records_added', records_added, 'repositories', "
                             "repositories) AS (metric, value)")
    if candidates is not None:
        total = total.unionByName(records.sparkSession.createDataFrame(
            [("candidates", candidates)], "metric string, value long"))
    types = records.groupBy("bug_type").agg(F.count(F.lit(1)).alias("value")).select(
        F.concat(F.lit("type_"), "bug_type").alias("metric"), "value")
    return total.unionByName(types)


def distinct_repos(records: DataFrame) -> DataFrame:
    return records.select("repository").distinct()


def dedupe_repair(df: DataFrame, done: DataFrame, code: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Split work by content key: rows answered by stored results, and first rows of new keys."""
    keyed = df.withColumn("content_key", fx.content_key(F.col(code), F.col(label)))
    known = keyed.join(done, "content_key")
    fresh = keyed.join(done.select("content_key"), "content_key", "left_anti")
    return known, first_per_group(fresh, ["content_key"], [F.xxhash64(*df.columns)])
