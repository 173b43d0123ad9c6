"""Operators that turn one row into many, pair rows up, or stack tables."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.functions.patterns import bind, squeeze
from patchlens.functions import text as fx
from patchlens.operators.grouping import range_bins, spread_row_number

HUNK_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def hunk_pairs(df: DataFrame, patch: str = "patch", context: int = 4) -> DataFrame:
    """One row per hunk: leading context, first run of changes, trailing context, on both sides.

    Patches whose hunks do not hold the announced number of lines are dropped whole. All array
    work stays inside the row; a patch is as small as one file's change.
    """
    text = F.regexp_replace(F.col(patch), r"\n\z", "")
    pieces = F.filter(F.split(text, r"(?m)^(?=@@ -\d)"), lambda h: h.rlike(HUNK_HEADER))

    def number(h, i, missing):
        n = F.regexp_extract(h, HUNK_HEADER, i)
        return F.when(n == "", F.lit(missing)).otherwise(n.try_cast("int"))

    def parse(h):
        body = F.split(F.regexp_replace(F.regexp_replace(h, r"\n\z", ""), r"\A[^\n]*\n?", ""), "\n")
        lines = F.filter(body, lambda x: ~x.startswith("\\"))
        return F.struct(
            number(h, 1, None).alias("source_start"), number(h, 2, 1).alias("source_length"),
            number(h, 3, None).alias("target_start"), number(h, 4, 1).alias("target_length"),
            F.transform(lines, lambda x: F.when(x == "", " ").otherwise(F.substring(x, 1, 1)))
            .alias("kinds"),
            F.transform(lines, lambda x: F.substring(x, F.lit(2), F.length(x))).alias("texts"))

    def holds(h):
        def count(kinds):
            return F.size(F.filter(h["kinds"], lambda k: k.isin(kinds)))

        return ((count([" ", "-"]) == h["source_length"])
                & (count([" ", "+"]) == h["target_length"]))

    # a filter on a computed column would be pushed down and parse every patch twice
    whole = bind({"h": F.transform(pieces, parse)},
                 lambda t: F.when(F.forall(t["h"], holds), t["h"]))
    one = df.withColumn("hunk", F.explode(whole))
    kinds, texts = F.col("hunk.kinds"), F.col("hunk.texts")
    flags = F.transform(kinds, lambda k: k != " ")
    one = one.withColumns({
        "_n": F.size(kinds), "_flags": flags,
        "_first": F.array_position(flags, True).cast("int"),
        "_back": F.array_position(F.reverse(flags), True).cast("int")})
    one = one.where("_first > 0").withColumn(
        "_run", F.array_position(F.slice("_flags", F.col("_first"), F.col("_n")), False).cast("int"))
    run = F.when(F.col("_run") == 0, F.col("_n") - F.col("_first") + 1).otherwise(
        F.col("_run") - 1)
    before_run = F.col("_first") - 1
    lead = F.slice(texts, F.greatest(F.col("_first") - context, F.lit(1)),
                   F.least(before_run, F.lit(context)))
    tail_size = F.col("_back") - 1
    trail = F.slice(texts, F.col("_n") - tail_size + 1, F.least(tail_size, F.lit(context)))
    picked = F.slice(F.arrays_zip(kinds.alias("k"), texts.alias("t")), F.col("_first"), run)

    def side(kind):
        own = F.transform(F.filter(picked, lambda p: p["k"] == kind), lambda p: p["t"])
        return squeeze(F.array_join(F.concat(lead, own, trail), "\n"))

    return (one.withColumns({"before": side("-"), "after": side("+")})
            .where("before <> '' AND after <> '' AND before <> after")
            .withColumns({c: F.col(f"hunk.{c}") for c in (
                "source_start", "source_length", "target_start", "target_length")})
            .drop("hunk", "_n", "_flags", "_first", "_back", "_run"))


def reverse_patch(patch: Column) -> Column:
    """Before-text of a patch: added lines and headers go, removed lines lose their mark."""
    lines = F.split(patch, "\n")
    kept = F.filter(lines, lambda x: ~(x.startswith("+") & ~x.startswith("+++"))
                    & ~(x.startswith("@@") & ~x.startswith("-")))
    plain = F.transform(kept, lambda x: F.when(
        x.startswith("-") & ~x.startswith("---"), F.substring(x, F.lit(2), F.length(x)))
        .otherwise(x))
    return squeeze(F.array_join(plain, "\n"))


def unpivot_pairs(pairs: DataFrame, key: str = "pair_id", **columns: str) -> DataFrame:
    """Pair row to a buggy and a clean row; blank code is skipped; sample_id runs without gaps."""
    c = {"before": "buggy_code", "after": "fixed_code", "before_vector": "buggy_ast_vector",
         "after_vector": "fixed_ast_vector", **columns}

    def sample(flag, name, code, vector):
        return F.struct(F.lit(flag).alias("is_bug"), F.lit(name).alias("label_name"),
                        squeeze(F.coalesce(F.col(code), F.lit(""))).alias("code"),
                        F.col(vector).alias("ast_vector"))

    both = F.array(sample(1, "buggy", c["before"], c["before_vector"]),
                   sample(0, "clean", c["after"], c["after_vector"]))
    rows = (pairs.withColumn("_s", F.explode(both)).where("_s.code <> ''")
            .drop(*c.values()).select("*", "_s.*").drop("_s"))
    order = [F.col(key), F.col("is_bug").desc()]
    return spread_row_number(range_bins(rows, order), [], F.col("_range"), order, "sample_id").drop("_range")


def swap_pairs(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Both orders of a pair as one feature row each; label 0 means the buggy side comes first."""
    def order(a, b, label):
        return F.struct(F.concat(F.col(a), F.col(b)).alias("features"), F.lit(label).alias("label"))

    return (pairs.withColumn("_o", F.explode(F.array(order(before, after, 0),
                                                     order(after, before, 1))))
            .select("*", "_o.*").drop("_o", before, after))


def dependency_names(content: Column) -> Column:
    """Names in dependencies and devDependencies of a package file; [] when it does not parse."""
    maps = F.from_json(content, "dependencies map<string,string>, devDependencies map<string,string>")
    empty = F.array().cast("array<string>")
    return F.concat(F.coalesce(F.map_keys(maps["dependencies"]), empty),
                    F.coalesce(F.map_keys(maps["devDependencies"]), empty))


AUDIT_SCHEMA = (
    "vulnerabilities map<string, struct<severity: string, range: string, via: array<string>>>")
ADVISORY_SCHEMA = "title string, url string, cwe array<string>, cvss struct<score: double>"
SAST_SCHEMA = (
    "results array<struct<path: string, check_id: string, start: struct<line: int, col: int>, "
    "`end`: struct<line: int>, extra: struct<severity: string, message: string>>>")


def audit_findings(df: DataFrame, content: str, file: str) -> DataFrame:
    """Dependency audit output to issue rows."""
    parsed = df.withColumn("_v", F.from_json(content, AUDIT_SCHEMA)["vulnerabilities"])
    rows = parsed.select(*df.columns, F.explode("_v").alias("package", "_d"))
    first = F.get(F.col("_d.via"), F.lit(0))
    rows = rows.withColumn("_a", F.when(first.startswith("{"), F.from_json(first, ADVISORY_SCHEMA)))
    level = F.coalesce(F.col("_d.severity"), F.lit("info"))
    plain = F.concat(F.col("package"), F.lit(" has a known "), level, F.lit(" vulnerability"))
    return rows.select(
        F.col(file).alias("file"), F.lit(1).alias("line"), fx.audit_severity(level).alias("severity"),
        F.concat(F.lit("npm-audit/"), level).alias("ruleId"),
        F.coalesce("_a.title", plain).alias("message"), F.lit("npm-audit").alias("engine"),
        F.lit("dependency").alias("category"), "package",
        F.coalesce("_a.cwe", F.array().cast("array<string>")).alias("cwe"),
        F.col("_a.cvss.score").alias("cvss"))


def sast_findings(df: DataFrame, content: str) -> DataFrame:
    """SAST output to issue rows."""
    r = F.col("_r")
    rows = df.withColumn("_r", F.explode(F.from_json(content, SAST_SCHEMA)["results"]))
    line = F.coalesce(r["start"]["line"], F.lit(1))
    return rows.select(
        F.replace(r["path"], F.lit("\\"), F.lit("/")).alias("file"), line.alias("line"),
        F.coalesce(r["start"]["col"], F.lit(1)).alias("column"),
        F.coalesce(r["end"]["line"], line).alias("endLine"),
        fx.sast_severity(r["extra"]["severity"]).alias("severity"),
        r["check_id"].alias("ruleId"),
        F.coalesce(r["extra"]["message"], F.lit("Security issue detected")).alias("message"),
        F.lit("semgrep").alias("engine"), F.lit("security").alias("category"))


def compiler_findings(df: DataFrame, output: str) -> DataFrame:
    """Compiler output text to issue rows, one per diagnostic line."""
    lines = df.withColumn("_d", F.explode(F.filter(F.transform(
        F.split(F.col(output), "\n"), fx.parse_tsc_line), lambda d: d.isNotNull())))
    return lines.select("_d.file", "_d.line", "_d.column", "_d.severity",
                        F.col("_d.code").alias("ruleId"), "_d.message",
                        F.lit("typescript").alias("engine"), F.lit("type").alias("category"))


def lint_findings(df: DataFrame) -> DataFrame:
    """Lint message rows (file, line, column, endLine, level, ruleId, message) to issue rows."""
    line = F.coalesce("line", F.lit(1))
    return df.select(
        "file", line.alias("line"), F.coalesce("column", F.lit(1)).alias("column"),
        F.coalesce("endLine", line).alias("endLine"),
        fx.lint_severity(F.col("level")).alias("severity"),
        F.coalesce("ruleId", F.lit("unknown")).alias("ruleId"), "message",
        F.lit("eslint").alias("engine"), fx.rule_category(F.col("ruleId")).alias("category"))


def top_predictions(df: DataFrame, probabilities: str, classes: list[str], k: int = 3) -> DataFrame:
    """The k most likely classes as rows with rank; ties go to the smaller class position."""
    scored = F.transform(F.col(probabilities), lambda p, i: F.struct(
        (-p).alias("key"), i.alias("position"), p.alias("probability")))
    best = F.slice(F.array_sort(scored), 1, k)
    names = F.array(*map(F.lit, classes))
    return (df.select(*[c for c in df.columns if c != probabilities],
                      F.posexplode(best).alias("_r", "_p"))
            .withColumns({"rank": F.col("_r") + 1, "bug_type": F.get(names, F.col("_p.position")),
                          "probability": F.col("_p.probability")}).drop("_r", "_p"))


def assemble_pairs(samples: DataFrame) -> DataFrame:
    """First buggy and first clean sample of each pair id, by sample_id; pairs lacking one go.

    Two-step: find the chosen sample ids from narrow columns, then fetch only those rows.
    """
    ids = samples.groupBy("pair_id").agg(
        F.min(F.when(F.col("is_bug") == 1, F.col("sample_id"))).alias("bug_id"),
        F.min(F.when(F.col("is_bug") == 0, F.col("sample_id"))).alias("clean_id")).where(
        "bug_id IS NOT NULL AND clean_id IS NOT NULL")
    bug = samples.withColumnRenamed("sample_id", "bug_id").drop("is_bug")
    clean = samples.select(F.col("sample_id").alias("clean_id"), F.col("code").alias("_after"))
    rows = ids.join(bug, ["pair_id", "bug_id"]).join(clean, "clean_id")
    have = set(samples.columns)

    def given(name, default):
        return F.coalesce(F.col(name), default) if name in have else default

    label, path = given("bug_type", F.lit("defect")), given("file_path", F.lit("source"))
    described = F.when(given("bug_description", F.lit("")) != "", given("bug_description", F.lit("")))
    message = F.coalesce(described, F.concat(F.lit("Fix "), label, F.lit(" in "), path))
    severity = given("severity", F.lit("Major"))
    return rows.select(
        "pair_id",
        given("commit_hash", F.concat(F.lit("c_"), F.col("pair_id").cast("string"))).alias("commit_id"),
        message.alias("commit_message"),
        given("repository", F.lit("open-source-repo")).alias("project_name"),
        given("file_path", F.lit("index.js")).alias("file_path"),
        given("bug_type", F.lit("Logic Error")).alias("bug_type"),
        F.concat(F.upper(F.substring(severity, 1, 1)),
                 F.lower(F.substring(severity, 2, 1000))).alias("severity"),
        F.col("code").alias("buggy_code_chunk"), F.col("_after").alias("fixed_code_chunk"),
        given("ast_vector", F.lit(None).cast("string")).alias("ast_vector"),
        fx.delta_signature(F.col("code"), F.col("_after")).alias("delta_signature"),
        given("root_cause", F.lit("")).alias("root_cause"),
        given("fix_description", F.lit("")).alias("fix_description"),
        given("language", F.lit("JavaScript")).alias("language"),
        given("confidence", F.lit(0.9)).alias("label_confidence"))


def union_all(*tables: DataFrame) -> DataFrame:
    """Stack tables with different columns; missing ones become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


union_engines = append_dataset = union_all


def union_dependencies(files: DataFrame, project: str, content: str) -> DataFrame:
    """Distinct dependency names per project over all its package files."""
    return files.select(project, F.explode(dependency_names(F.col(content))).alias("dependency")
                        ).distinct()
