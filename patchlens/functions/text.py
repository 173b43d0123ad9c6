"""Column builders over code, paths and messages. Everything here stays inside the JVM."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlens.functions.patterns import (
    any_literal, bind, ladder, squeeze,
)
from patchlens.rules import lexicon as L

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def count_sub(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    shrunk = F.length(F.replace(text, F.lit(literal), F.lit("")))
    return ((F.length(text) - shrunk) / len(literal)).cast("int")


def count_subs(text: Column, literals: list[str]) -> Column:
    return sum((count_sub(text, x) for x in literals[1:]), count_sub(text, literals[0]))


def line_count(text: Column) -> Column:
    """Lines as an editor counts them: a closing line break does not open a new line."""
    breaks = F.regexp_count(text, F.lit(LINE_BREAK))
    open_tail = (F.length(text) > 0) & ~text.rlike(rf"(?:{LINE_BREAK})\z")
    return breaks + open_tail.cast("int")


def delta_signature(before: Column, after: Column) -> Column:
    """What a change added: guards, async words, comparison operators, lines."""
    def grown(literals):
        return count_subs(after, literals) - count_subs(before, literals)

    return F.struct(
        F.greatest(F.lit(0), grown(L.GUARD_LITERALS)).alias("added_boundary_check"),
        F.greatest(F.lit(0), grown(L.ASYNC_LITERALS)).alias("added_await"),
        grown(L.COMPARISON_LITERALS).alias("delta_op_gt"),
        (line_count(after) - line_count(before)).alias("complexity_delta"),
    )


def defect_score(code: Column) -> Column:
    """Sum of the structural warning signs in a snippet, capped."""
    w = L.DEFECT_WEIGHTS
    has = code.contains
    signs = [
        (w["unawaited_call"],
         any_literal(code, L.CALL_LITERALS) & ~has("await ") & ~has(".then(")),
        (w["async_without_catch"], has("async ") & ~has("try {") & ~has(".catch(")),
        (w["inclusive_length_bound"], has("<=") & has(".length")),
        (w["hook_without_guard"],
         any_literal(code, ["useSelector", "useDispatch"]) & has("useEffect") & has(".map(")
         & ~has("if (") & ~has("&&")),
        (w["deep_access"], any_literal(code, L.DEEP_ACCESS_LITERALS) & ~has("?.") & ~has("if (")),
        (w["compare_if_return"],
         any_literal(code, [">=", "<=", "==", "!="]) & any_literal(code, ["if ", "if("])
         & has("return ")),
    ]
    total = sum((F.when(c, F.lit(x)).otherwise(F.lit(0.0)) for x, c in signs[1:]),
                F.when(signs[0][1], F.lit(signs[0][0])).otherwise(F.lit(0.0)))
    return F.least(total, F.lit(L.DEFECT_CAP))


def truncate_mark(text: Column, limit: int) -> Column:
    kept = F.concat(F.substring(text, 1, limit), F.lit("\n... [truncated]"))
    return F.when(F.length(text) > limit, kept).otherwise(F.coalesce(text, F.lit("")))


def decode_blob(content: Column, encoding: Column) -> Column:
    """Base64 file content as text; null when stored in another way."""
    return F.when(encoding == "base64",
                  F.decode(F.unbase64(F.regexp_replace(content, r"\s", "")), "UTF-8"))


# --- paths ------------------------------------------------------------------------------

def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Text after the last dot of the file name, '' when there is none."""
    return F.regexp_extract(base_name(path), r".\.([^.]*)$", 1)


def language_of(path: Column) -> Column:
    return (F.when(path.endswith(".ts") | path.endswith(".tsx"), "typescript")
            .otherwise("javascript"))


def prompt_language_of(path: Column) -> Column:
    return F.when(path.endswith(".py"), "python").otherwise(language_of(path))


def component_of(path: Column, repository: Column) -> Column:
    low, repo = F.lower(path), F.lower(repository)
    steps = [(any_literal(low, words), F.lit(name)) for name, words in L.COMPONENT_WORDS]
    return ladder(steps, F.when(any_literal(repo, ["server", "nest"]), "backend")
                  .otherwise("unknown"))


def component_simple(path: Column) -> Column:
    return F.when(any_literal(path, ["server", "api"]), "backend").otherwise("frontend")


def file_role(path: Column) -> Column:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    steps = [(low.rlike(pattern), F.lit(role)) for role, pattern in L.FILE_ROLES]
    steps[0] = (steps[0][0] | path.rlike(L.HOOK_NAME), steps[0][1])
    return ladder(steps, F.lit("unknown"))


def function_kind(name: Column, role: Column) -> Column:
    low = F.lower(name)
    handler = low.rlike("^(" + "|".join(L.HANDLER_PREFIXES) + ")")
    return ladder([
        (name.isNull() | (name == ""), F.lit("anonymous")),
        (name.rlike("^use[A-Z]"), F.lit("hook")),
        (name.rlike("^[A-Z]"), F.lit("component")),
        (handler & role.isin("route", "controller"), role),
        (role.isin("model", "middleware"), role),
    ], F.lit("utility"))


def method_role(path: Column, code: Column) -> Column:
    low, has = F.lower(path), code.contains
    r = L.METHOD_ROLES
    return ladder([
        (low.rlike(r"\.(jsx|tsx)$") | any_literal(low, ["frontend", "client", "component"])
         | any_literal(code, ["useState", "useEffect", "return ("]), F.lit(r["frontend"])),
        (any_literal(low, ["controller", "route", "server", "backend"]) | has("router.")
         | (has("req") & has("res")), F.lit(r["route"])),
        (any_literal(low, ["model", "schema"]) | has("mongoose"), F.lit(r["model"])),
        (any_literal(low, ["service", "api"]), F.lit(r["service"])),
        (any_literal(low, ["util", "helper"]), F.lit(r["utility"])),
    ], F.lit(r["other"]))


# --- tool reports -------------------------------------------------------------------------

def rule_category(rule_id: Column) -> Column:
    rule = F.coalesce(rule_id, F.lit(""))
    return ladder([(any_literal(rule, words), F.lit(name)) for name, words in L.LINT_CATEGORIES],
                  F.lit("logic"))


def lint_severity(level: Column) -> Column:
    return F.when(level == 2, "error").otherwise("warning")


def audit_severity(level: Column) -> Column:
    return F.when(level.isin("critical", "high"), "error").otherwise("warning")


def sast_severity(level: Column) -> Column:
    up = F.upper(level)
    return ladder([
        (level.isNull() | (level == ""), F.lit("warning")),
        (up.isin("ERROR", "CRITICAL", "HIGH"), F.lit("error")),
        (up.isin("WARNING", "MEDIUM"), F.lit("warning")),
    ], F.lit("info"))


DIAGNOSTIC = r"^(.+?)\((\d+),(\d+)\):\s+(error|warning)\s+TS(\d+):\s+(.+)$"


def parse_tsc_line(line: Column) -> Column:
    """Diagnostic line as a struct; null when the line has another form."""
    def part(i):
        return F.regexp_extract(line, DIAGNOSTIC, i)

    return F.when(line.rlike(DIAGNOSTIC), F.struct(
        F.replace(part(1), F.lit("\\"), F.lit("/")).alias("file"),
        part(2).try_cast("int").alias("line"), part(3).try_cast("int").alias("column"),
        part(4).alias("severity"), F.concat(F.lit("TS"), part(5)).alias("code"),
        squeeze(part(6)).alias("message")))


def parse_repo_url(url: Column, host: str = "github.com") -> Column:
    """Owner and repository of a hosted URL; null when the URL has another form."""
    clean = F.regexp_replace(F.regexp_replace(squeeze(url), r"\.git$", ""), r"/$", "")
    pattern = host.replace(".", r"\.") + r"/([^/]+)/([^/]+)"
    return F.when(clean.rlike(pattern), F.struct(
        F.regexp_extract(clean, pattern, 1).alias("owner"),
        F.regexp_extract(clean, pattern, 2).alias("repo")))


# --- labels ---------------------------------------------------------------------------------

def extract_json_object(text: Column) -> Column:
    """Drop code fences, keep what lies between the outer braces."""
    bare = squeeze(F.regexp_replace(text, r"(?m)^```(?:json)?|```$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(inner != "", inner).otherwise(bare)


RESPONSE = T.StructType([T.StructField(n, T.StringType()) for n in (
    "decision", "bug_type", "confidence", "root_cause", "bug_description", "fix_description",
    "severity", "evidence")])


def validate_label(response: Column) -> Column:
    """Checked label struct from a JSON answer, parsed once; null when any hard rule fails."""
    return bind({"r": F.from_json(response, RESPONSE)}, lambda t: _checked_label(t["r"]))


def _checked_label(r: Column) -> Column:
    confidence = r["confidence"].try_cast("double")
    accepted = r["decision"] == "accept"
    as_list = F.from_json(r["evidence"], "array<string>")
    evidence = ladder([
        (r["evidence"].isNull() | (r["evidence"] == ""), F.array().cast("array<string>")),
        (r["evidence"].startswith("["), F.coalesce(as_list, F.array(r["evidence"]))),
    ], F.array(r["evidence"]))

    def short(name):
        return F.substring(F.coalesce(r[name], F.lit("")), 1, 500).alias(name)

    valid = (r["decision"].isin("accept", "reject") & confidence.between(0.0, 1.0)
             & (~accepted | F.coalesce(r["bug_type"].isin(L.APPROVED_TYPES), F.lit(False))))
    return F.when(valid, F.struct(
        r["decision"].alias("decision"), F.when(accepted, r["bug_type"]).alias("bug_type"),
        confidence.alias("confidence"), short("root_cause"), short("bug_description"),
        short("fix_description"),
        F.when(r["severity"].isin(L.SEVERITIES), r["severity"]).otherwise("medium")
        .alias("severity"),
        F.slice(evidence, 1, 10).alias("evidence")))


def constrain_type(bug_type: Column) -> Column:
    return F.when(bug_type.isin(L.APPROVED_TYPES), bug_type).otherwise("other")


def constrain_component(component: Column) -> Column:
    return F.when(component.isin(L.COMPONENTS), component).otherwise("unknown")


def constrain_severity(severity: Column) -> Column:
    return F.when(severity.isin(L.SEVERITIES), severity).otherwise("medium")


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def severity_default(severity: Column, bug_type: Column) -> Column:
    steps = [(bug_type == t, F.lit(s)) for t, s in L.BASE_SEVERITY.items()]
    given = F.when(severity != "", severity)
    return F.coalesce(given, ladder(steps, F.lit("medium")))


def title_words(bug_type: Column) -> Column:
    return F.initcap(F.replace(bug_type, F.lit("_"), F.lit(" ")))


def bug_pattern(evidence: Column, bug_type: Column) -> Column:
    """First piece of evidence, else the type as a title; at most 120 characters."""
    return F.substring(F.coalesce(F.try_element_at(evidence, F.lit(1)), title_words(bug_type)),
                       1, 120)


def describe_defect(repository, path, bug_type, pattern, root_cause, fix) -> Column:
    from patchlens.rules.ladders import DESCRIPTION_TEMPLATE
    return F.format_string(
        DESCRIPTION_TEMPLATE, F.replace(bug_type, F.lit("_"), F.lit(" ")), repository,
        base_name(path), F.lower(pattern), F.lower(root_cause), F.lower(fix))


def content_key(code: Column, bug_type: Column) -> Column:
    return F.sha2(F.concat(squeeze(code), F.lit("_"), bug_type), 256)


# --- texts for models and scorers -------------------------------------------------------------

def narrative_text(message, description, cause, fix) -> Column:
    def part(c):
        return F.coalesce(c, F.lit(""))

    return F.concat(F.lit("COMMIT: "), part(message), F.lit("\nBUG: "), part(description),
                    F.lit("\nROOT CAUSE: "), part(cause), F.lit("\nFIX: "), part(fix))


def before_after_text(before, after, limit: int = 1000) -> Column:
    return F.concat(F.lit("BUGGY:\n"), F.substring(before, 1, limit),
                    F.lit("\nFIXED:\n"), F.substring(F.coalesce(after, F.lit("")), 1, limit))


def tagged_text(language, code) -> Column:
    body, lang = squeeze(code), squeeze(language)
    return F.when(lang != "", F.concat(F.lit("//"), lang, F.lit("\n"), body)).otherwise(body)


def prompt_row(before, after, diff, message, candidates, code_limit=1500, diff_limit=1500):
    """One text per row for an offline scorer."""
    return F.format_string(
        "Commit message: %s\nCandidate categories: %s\nBefore:\n%s\nAfter:\n%s\nDiff:\n%s",
        F.substring(squeeze(F.coalesce(message, F.lit(""))), 1, 300),
        F.array_join(candidates, ", "), truncate_mark(before, code_limit),
        truncate_mark(after, code_limit), truncate_mark(diff, diff_limit))


# --- scores ---------------------------------------------------------------------------------

def calibrated_score(raw: Column, bonus: Column) -> Column:
    return F.greatest(F.lit(L.SCORE_FLOOR),
                      F.least(F.lit(L.SCORE_CEILING), raw * L.SCORE_GAIN + bonus))


def cost_saved(suspicious: Column) -> Column:
    return F.when(suspicious, F.lit(0.0)).otherwise(F.lit(L.COST_PER_CLEAN_METHOD))


def progress_percent(step: Column, total: int = L.PROGRESS_STEPS) -> Column:
    return F.floor(step / F.lit(total) * 100).cast("int")
