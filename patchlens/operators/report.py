"""Counts, shares, summaries and grades over pairs, ledgers and issues."""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlens.functions.patterns import ladder
from patchlens.operators.grouping import with_group_count
from patchlens.operators.reshape import dependency_names
from patchlens.rules import lexicon as L


def dataset_stats(pairs: DataFrame, bug_type: str = "bug_type", severity: str = "severity",
                  project: str = "project_name", guards: str = "added_boundary_check",
                  awaits: str = "added_await") -> DataFrame:
    """Counts by type, severity and project and the totals, from one pass (grouping sets)."""
    named = pairs.select(
        F.coalesce(bug_type, F.lit("Unknown")).alias("t"),
        F.coalesce(severity, F.lit("Major")).alias("s"),
        F.coalesce(project, F.lit("Unknown")).alias("p"),
        F.col(guards).alias("g"), F.col(awaits).alias("a"))
    t, s, p = F.col("t"), F.col("s"), F.col("p")
    sets = named.groupingSets([[t], [s], [p], []], t, s, p).agg(
        F.grouping_id("t", "s", "p").alias("gid"), F.count(F.lit(1)).alias("pairs"),
        F.coalesce(F.sum("g"), F.lit(0)).alias("boundary_checks"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("await_fixes"))
    kind = ladder([(F.col("gid") == 3, F.lit("bug_type")), (F.col("gid") == 5, F.lit("severity")),
                   (F.col("gid") == 6, F.lit("project"))], F.lit("total"))
    return sets.select(kind.alias("kind"), F.coalesce("t", "s", "p", F.lit("all")).alias("name"),
                       "pairs", (F.col("pairs") * 2).alias("samples"), "boundary_checks",
                       "await_fixes")


def value_share(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage per value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(
        column, "n", (F.col("n") * 100.0 / F.col("_total")).alias("pct"))


def top_projects(df: DataFrame, project: str, k: int = 5) -> DataFrame:
    return (df.groupBy(project).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), project).limit(k))


def language_counts(df: DataFrame, language: str) -> DataFrame:
    """Rows per language, without rows that have none."""
    return df.where(F.col(language).isNotNull()).groupBy(F.col(language).alias("language")).agg(
        F.count(F.lit(1)).alias("n"))


def distinct_profile(df: DataFrame, repository: str, label: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  F.count_distinct(repository).alias("repositories"),
                  F.count_distinct(label).alias("classes"))


def tier_stats(df: DataFrame, before: str = "buggy_tier", after: str = "fixed_tier",
               failed: tuple[str, ...] = ("parse_error", "exec_error")) -> DataFrame:
    """Count and share per parse tier and side, and the success share over both sides."""
    sides = df.select(F.explode(F.array(
        F.struct(F.lit("buggy").alias("side"), F.col(before).alias("tier")),
        F.struct(F.lit("fixed").alias("side"), F.col(after).alias("tier")))).alias("x")).select("x.*")
    counts = sides.groupBy("side", "tier").agg(F.count(F.lit(1)).alias("n"))
    per_side = F.sum("n").over(Window.partitionBy("side"))  # one row per tier by now
    everything = Window.partitionBy()
    good = F.sum(F.when(F.col("tier").isin(*failed), 0).otherwise(F.col("n"))).over(everything)
    return counts.select("side", "tier", "n", (F.col("n") * 100.0 / per_side).alias("pct"),
                         (good * 100.0 / F.sum("n").over(everything)).alias("success_pct"))


def scan_summary(ledger: DataFrame, keys: list[str], file: str = "file_path",
                 complexity: str = "complexity", depth: str = "max_depth",
                 slots: Column | None = None, suspicious: str = "suspicious",
                 files: DataFrame | None = None) -> DataFrame:
    """Per scan: files, methods, clean methods, saved cost, mean complexity, depth, slots. `files`
    (keys, file) names all files scanned, also those without a method."""
    clean = F.count_if(~F.col(suspicious))
    found = ledger.groupBy(*keys).agg(
        F.count_distinct(file).alias("files_scanned"),
        F.count(F.lit(1)).alias("methods_analyzed"), clean.alias("clean_methods"),
        F.round(clean * L.COST_PER_CLEAN_METHOD, 3).alias("cost_saved_usd"),
        F.round(F.coalesce(F.avg(complexity), F.lit(0.0)), 2).alias("average_complexity"),
        F.coalesce(F.max(depth), F.lit(0)).alias("max_depth"),
        F.coalesce(F.sum(slots if slots is not None else F.lit(64)), F.lit(0)).alias("vector_slots"))
    if files is None:
        return found
    scanned = files.groupBy(*keys).agg(F.count_distinct(file).alias("_files"))
    both = scanned.join(found, keys, "left").withColumn("files_scanned", F.col("_files")).drop("_files")
    return both.na.fill(0).select(*found.columns)


REPORT_KEYS = {
    "severity": ["error", "warning", "info"],
    "engine": ["eslint", "typescript", "npm-audit", "semgrep"],
    "category": ["security", "logic", "type", "dependency", "react", "async", "unknown"],
}


def issue_report(issues: DataFrame, keys: dict[str, list[str]] = REPORT_KEYS) -> DataFrame:
    """Counts by severity, engine and category in one pass, zero rows for known values."""
    names = list(keys)
    cols = [F.col(n) for n in names]
    base = issues.select(*names)
    sets = base.groupingSets([[c] for c in cols] + [[]], *cols).agg(
        F.grouping_id(*names).alias("gid"), F.count(F.lit(1)).alias("n"))
    full = 2 ** len(names) - 1
    dims = [(F.col("gid") == full - 2 ** (len(names) - 1 - i), F.lit(n))
            for i, n in enumerate(names)]
    found = sets.select(ladder(dims, F.lit("total")).alias("dimension"),
                        F.coalesce(*names, F.lit("all")).alias("name"), "n")
    known = issues.sparkSession.createDataFrame(
        [(d, v) for d, values in keys.items() for v in values] + [("total", "all")],
        "dimension string, name string")
    return known.join(found, ["dimension", "name"], "full").select(
        "dimension", "name", F.coalesce("n", F.lit(0)).alias("n"))


def function_report(spans: DataFrame) -> DataFrame:
    """Functions per kind and in total, in the shape of the issue report."""
    counts = spans.groupingSets([[F.col("kind")], []], "kind").agg(
        F.grouping_id("kind").alias("gid"), F.count(F.lit(1)).alias("n"))
    return counts.select(F.when(F.col("gid") == 0, "function").otherwise("functions").alias("dimension"),
                         F.when(F.col("gid") == 0, F.col("kind")).otherwise("all").alias("name"), "n")


def attach_issues(files: DataFrame, issues: DataFrame) -> DataFrame:
    """Files with issue counts; issues of unknown files give a config file of 0 lines."""
    counts = issues.groupBy(F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("_n"))
    return files.select("path", "role", "lines").join(counts, "path", "full").select(
        "path", F.coalesce("role", F.lit("config")).alias("role"),
        F.coalesce("lines", F.lit(0)).alias("lines"),
        F.coalesce("_n", F.lit(0)).alias("issue_count"))


def files_by_issues(files: DataFrame) -> DataFrame:
    return files.orderBy(F.col("issue_count").desc(), "path")


def file_findings(files: DataFrame, findings: DataFrame, key: str = "file_path") -> DataFrame:
    """Findings next to their file; files without any stay, marked clean."""
    marked = findings.withColumn("_hit", F.lit(True))
    return files.join(marked, key, "left").withColumn(
        "is_buggy", F.coalesce("_hit", F.lit(False))).drop("_hit")


def lookup_texts(df: DataFrame, label: str = "bug_type",
                 descriptions: dict[str, str] = L.DESCRIPTIONS,
                 fixes: dict[str, str] = L.SUGGESTED_FIXES) -> DataFrame:
    """Description and advice per type, '' when the type is unknown. The text table is rule data."""
    names = sorted(set(descriptions) | set(fixes))
    texts = df.sparkSession.createDataFrame(
        [(t, descriptions.get(t, ""), fixes.get(t, "")) for t in names],
        f"{label} string, description string, suggested_fix string")
    return df.join(F.broadcast(texts), label, "left").fillna(
        "", ["description", "suggested_fix"])


def severity_breakdown(findings: DataFrame, keys: list[str], severity: str = "severity_level",
                       functions: str | None = None) -> DataFrame:
    """Critical, Major and Minor counts with shares, and bugs per 100 functions."""
    levels = {x: F.count_if(F.col(severity) == x) for x in ("Critical", "Major", "Minor")}
    counts = findings.groupBy(*keys).agg(
        *[c.alias(x.lower()) for x, c in levels.items()],
        *([F.max(functions).alias("functions")] if functions else []))
    total = F.col("critical") + F.col("major") + F.col("minor")
    shares = {f"{x}_pct": F.when(total > 0, F.col(x) * 100.0 / total).otherwise(0.0)
              for x in ("critical", "major", "minor")}
    out = counts.withColumn("bugs", total).withColumns(shares)
    if functions:
        out = out.withColumn("detection_rate", F.when(
            F.col("functions") > 0, F.round(F.col("bugs") * 100.0 / F.col("functions"), 1))
            .otherwise(0.0))
    return out


def health_score(counts: DataFrame) -> DataFrame:
    """Score and grade from critical, major and minor columns."""
    c, M, m = F.col("critical"), F.col("major"), F.col("minor")
    pts = L.GRADE_POINTS
    score = F.greatest(F.lit(0), 100 - c * pts["critical"] - M * pts["major"] - m * pts["minor"])
    return counts.withColumn("score", score).withColumn("grade", ladder([
        ((c > 0) | (F.col("score") < L.GRADE_LIMITS["C"]), F.lit("C")),
        ((M > 0) | (F.col("score") < L.GRADE_LIMITS["B"]), F.lit("B"))], F.lit("A")))


def framework_flags(files: DataFrame, project: str = "project", path: str = "path",
                    dependencies: DataFrame | None = None) -> DataFrame:
    """Frameworks per project by file pattern or dependency name: rows (project, framework)."""
    by_file = [F.when(reduce(or_, [F.col(path).rlike(p) for p in patterns]), F.lit(name))
               for name, _, patterns in L.FRAMEWORKS if patterns]
    seen = files.select(project, F.explode(F.array_compact(F.array(*by_file))).alias("framework"))
    if dependencies is not None:
        names = files.sparkSession.createDataFrame(
            [(d, f) for f, deps, _ in L.FRAMEWORKS for d in deps], "dependency string, framework string")
        seen = seen.unionByName(
            dependencies.withColumn("dependency", F.lower("dependency"))
            .join(F.broadcast(names), "dependency").select(project, "framework"))
    return seen.distinct()


def project_layout(files: DataFrame, project: str = "project", path: str = "path") -> DataFrame:
    """Structure type and side flags per project."""
    p, x = F.col(path), L.LAYOUT_PATTERNS
    flags = files.groupBy(project).agg(
        F.bool_or(p.rlike(x["front"])).alias("has_frontend"),
        F.bool_or(p.rlike(x["back"])).alias("has_backend"),
        F.bool_or(p.rlike(x["next"])).alias("_next"),
        F.bool_or(p.rlike(x["react_file"]) & p.rlike(x["react_dir"])).alias("_react"),
        F.bool_or(p.rlike(x["express_dir"])).alias("_express"),
        F.bool_or(p.rlike(x["typescript"])).alias("has_typescript"))
    kind = ladder([
        (F.col("has_frontend") & F.col("has_backend"), F.lit("fullstack-monorepo")),
        (F.col("_next"), F.lit("next-js")),
        (F.col("_react") & F.col("_express"), F.lit("fullstack-single")),
        (F.col("_react"), F.lit("react-only")), (F.col("_express"), F.lit("express-only")),
    ], F.lit("unknown"))
    return flags.withColumn("structure", kind).drop("_next", "_react", "_express")


def project_profile(files: DataFrame, project: str = "project", path: str = "path",
                    content: str = "content") -> DataFrame:
    """Stack text and front/back flags per project, from dependencies and folders."""
    p = F.col(path)
    is_package = p.rlike(r"(^|/)package\.json$")
    deps = F.when(is_package, dependency_names(F.col(content))).otherwise(
        F.array().cast("array<string>"))
    wanted = {label: F.bool_or(F.arrays_overlap(deps, F.array(*map(F.lit, names)))).alias(f"_s{i}")
              for i, (label, names) in enumerate(L.STACK_LABELS)}
    flags = files.groupBy(project).agg(
        *wanted.values(), F.bool_or(p.rlike(L.FRONT_DIRS)).alias("_front"),
        F.bool_or(p.rlike(L.BACK_DIRS)).alias("_back"))
    front = F.col("_front") | F.col("_s0")
    back = F.col("_back") | F.col("_s1")
    labels = [F.when(F.col(f"_s{i}"), F.lit(label)) for i, (label, _) in enumerate(L.STACK_LABELS)]
    stack = F.concat_ws(" + ", *labels, F.when(front & back, F.lit(L.FULLSTACK_LABEL)))
    return flags.select(
        project, F.when(stack == "", L.DEFAULT_STACK).otherwise(stack).alias("tech_stack"),
        front.alias("has_frontend"), back.alias("has_backend"))


def class_balance(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Balanced row weights n / (k * n_class), from one count table."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    everything = Window.partitionBy()
    weights = counts.select(label, (
        F.sum("_n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("_n")))
        .alias(name))
    return df.join(weights, label)


def latest_progress(log: DataFrame, scan: str = "scan_id", step: str = "step",
                    order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Latest step of each scan; among equal steps the last entry."""
    rest = [c for c in log.columns if c not in (scan, step, *order)]
    top = log.groupBy(scan).agg(F.max(F.struct(step, *order, *rest)).alias("x"))
    return top.select(scan, "x.*")


def step_feed(log: DataFrame, scan: str = "scan_id", step: str = "step", ts: str = "ts",
              tie: str = "id") -> DataFrame:
    """First entry of each step of each scan."""
    return log.groupBy(scan, step).agg(F.min(F.struct(ts, tie)).alias("x")).select(
        scan, step, F.col(f"x.{ts}").alias(ts), F.col(f"x.{tie}").alias(tie))


def search_samples(df: DataFrame, text: str | None = None, bug_type: str = "all",
                   fields: tuple[str, ...] = ("bug_type", "project_name", "commit_message")
                   ) -> DataFrame:
    """Exact type or 'all', and text contained in any field, case aside."""
    if bug_type != "all":
        df = df.where(F.col("bug_type") == bug_type)
    if text:
        hit = [F.coalesce(F.lower(F.col(f)).contains(text.lower()), F.lit(False)) for f in fields]
        df = df.where(reduce(or_, hit))
    return df


def find_samples(df: DataFrame, bug_type: str | None, order: str, limit: int = 20) -> DataFrame:
    """First rows whose type contains the text, with the total before the limit on each row."""
    if bug_type:
        df = df.where(F.lower("bug_type").contains(bug_type.lower()))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    page = df.orderBy(order).limit(limit)
    # both sides are bounded: one row, and at most `limit` rows
    return page.withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k").drop("_k")


SCAN_BUCKETS = 64


def scan_bucket(scan: Column, buckets: int = SCAN_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(scan), F.lit(buckets)).cast("int")


def get_scan(scans: DataFrame, scan_id, key: str = "scan_id", buckets: int = SCAN_BUCKETS) -> DataFrame:
    """Rows of one scan. Of a table that `write_scans` has stored, only the files of its bucket are read."""
    rows = scans.where(F.col(key) == scan_id)
    if "scan_bucket" not in scans.columns:
        return rows
    own = scan_bucket(F.lit(scan_id).cast(scans.schema[key].dataType), buckets)
    return rows.where(F.col("scan_bucket") == own).drop("scan_bucket")
