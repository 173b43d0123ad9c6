"""Queries of the text, label and reshape operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from patchlens.functions import labels as lx
from patchlens.functions import text as fx
from patchlens.functions import vectors as vx
from patchlens.functions.patterns import squeeze
from patchlens.operators import mining, quality, repair, report, reshape, slicing, tfidf
from patchlens.plans import bindings as B
from patchlens.plans.bindings import (
    PAIRS, PATHS, SNIPPETS, quote, sql_any, sql_count, sql_fold, sql_found, sql_pick, sql_times,
    sql_trim, sql_words,
)
from patchlens.plans.registry import query
from patchlens.rules import ladders as R
from patchlens.rules import lexicon as L
from patchlens.rules.categories import CATEGORY_RULES, FIX_SIGNALS, HEURISTIC_CAPS, HEURISTIC_RULES

LONG = "long"
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _sum(expr, literals):
    return "(" + " + ".join(sql_count(expr, x) for x in literals) + ")"


def _lines(expr):
    return (f"({sql_times(expr, BREAKS)} + CASE WHEN length({expr}) > 0 AND NOT "
            f"{sql_found(expr, f'(?:{BREAKS})$')} THEN 1 ELSE 0 END)")


@query("count_sub", f"""WITH {SNIPPETS} SELECT doc_id, {sql_count('code', '<=')} AS n_bound,
{sql_count('code', 'await')} AS n_await FROM snippets""")
def _(t):
    c = F.col("code")
    return t.snippets().select("doc_id", fx.count_sub(c, "<=").cast(LONG).alias("n_bound"),
                               fx.count_sub(c, "await").cast(LONG).alias("n_await"))


def _grown(literals):
    return f"{_sum('after', literals)} - {_sum('before', literals)}"


SIGNATURE_SQL = f"""
greatest(0, {_grown(L.GUARD_LITERALS)}) AS added_boundary_check,
greatest(0, {_grown(L.ASYNC_LITERALS)}) AS added_await,
{_grown(L.COMPARISON_LITERALS)} AS delta_op_gt,
{_lines('after')} - {_lines('before')} AS complexity_delta"""


@query("delta_signature", f"WITH {PAIRS} SELECT pair_id, {SIGNATURE_SQL} FROM pairs "
                          "WHERE before IS NOT NULL")
def _(t):
    p = t.pairs().where("before IS NOT NULL")
    s = p.select("pair_id", fx.delta_signature(F.col("before"), F.col("after")).alias("s"))
    return s.select("pair_id", *[F.col(f"s.{c}").cast(LONG).alias(c) for c in (
        "added_boundary_check", "added_await", "delta_op_gt", "complexity_delta")])


@query("line_count", f"SELECT doc_id, {_lines('text')} AS n_lines FROM documents")
def _(t):
    return t.documents.select("doc_id", fx.line_count(F.col("text")).cast(LONG).alias("n_lines"))


def _no(expr, *literals):
    return " AND ".join(f"NOT contains({expr}, {quote(x)})" for x in literals)


def defect_sql(c):
    w = L.DEFECT_WEIGHTS
    rules = [
        (w["unawaited_call"], f"{sql_any(c, L.CALL_LITERALS)} AND {_no(c, 'await ', '.then(')}"),
        (w["async_without_catch"], f"contains({c}, 'async ') AND {_no(c, 'try {', '.catch(')}"),
        (w["inclusive_length_bound"], f"contains({c}, '<=') AND contains({c}, '.length')"),
        (w["hook_without_guard"],
         f"{sql_any(c, ['useSelector', 'useDispatch'])} AND contains({c}, 'useEffect') "
         f"AND contains({c}, '.map(') AND {_no(c, 'if (', '&&')}"),
        (w["deep_access"], f"{sql_any(c, L.DEEP_ACCESS_LITERALS)} AND {_no(c, '?.', 'if (')}"),
        (w["compare_if_return"],
         f"{sql_any(c, ['>=', '<=', '==', '!='])} AND {sql_any(c, ['if ', 'if('])} "
         f"AND contains({c}, 'return ')")]
    total = " + ".join(f"CASE WHEN {r} THEN {x}::DOUBLE ELSE 0.0::DOUBLE END" for x, r in rules)
    return f"least({total}, {L.DEFECT_CAP}::DOUBLE)"


@query("defect_score", f"WITH {SNIPPETS} SELECT doc_id, round({defect_sql('code')}, 4) AS score "
                       "FROM snippets")
def _(t):
    return t.snippets().select("doc_id", F.round(fx.defect_score(F.col("code")), 4).alias("score"))


@query("truncate_mark", """SELECT doc_id, CASE WHEN length(text) > 300
THEN substring(text, 1, 300) || chr(10) || '... [truncated]' ELSE text END AS cut FROM documents""")
def _(t):
    return t.documents.select("doc_id", fx.truncate_mark(F.col("text"), 300).alias("cut"))


@query("decode_blob", "SELECT page_id, CASE WHEN page_id % 3 > 0 THEN html END AS content FROM pages")
def _(t):
    stored = t.pages.select("page_id", F.base64(F.encode("html", "UTF-8")).alias("blob"),
                            F.when(F.col("page_id") % 3 > 0, "base64").otherwise("none").alias("enc"))
    return stored.select("page_id", fx.decode_blob(F.col("blob"), F.col("enc")).alias("content"))


# --- paths ------------------------------------------------------------------------------------

def _ladder(steps, otherwise):
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in steps) + f" ELSE {otherwise} END"


_BASE = "split_part(path, '/', -1)"
_EXT = f"CASE WHEN contains({_BASE}, '.') THEN split_part({_BASE}, '.', -1) ELSE {_BASE} END"
_DIRS = "[lower(x) for x in string_split(path, '/')[:-2]]"


@query("source_file_filter", f"""WITH {PATHS} SELECT page_id, path FROM paths
WHERE ({_EXT}) IN ('js', 'jsx', 'ts', 'tsx')
AND NOT list_has_any({_DIRS}, [{', '.join(map(quote, L.IGNORED_DIRS))}])
AND NOT {sql_found(_BASE, '|'.join(f'(?:{p})' for p in L.IGNORED_NAMES), 'i')}""")
def _(t):
    return t.paths().select("page_id", "path").where(quality.is_source_file(F.col("path")))


_ROLE_STEPS = [(sql_found("lower(path)", p), quote(r)) for r, p in L.FILE_ROLES]
_ROLE_STEPS[0] = (f"({_ROLE_STEPS[0][0]} OR {sql_found('path', L.HOOK_NAME)})", "'hook'")
FILE_ROLE_SQL = _ladder(_ROLE_STEPS, "'unknown'")


@query("file_role", f"WITH {PATHS} SELECT page_id, {FILE_ROLE_SQL} AS role FROM paths")
def _(t):
    return t.paths().select("page_id", fx.file_role(F.col("path")).alias("role"))


@query("component_of", f"""WITH {PATHS} SELECT page_id, {_ladder(
    [(sql_any('lower(path)', w), quote(n)) for n, w in L.COMPONENT_WORDS],
    "CASE WHEN page_id % 2 = 0 THEN 'backend' ELSE 'unknown' END")} AS component,
CASE WHEN {sql_any('path', ['server', 'api'])} THEN 'backend' ELSE 'frontend' END AS simple
FROM paths""")
def _(t):
    repo = F.when(F.col("page_id") % 2 == 0, "x/nest-app").otherwise("x/app")
    return t.paths().select("page_id", fx.component_of(F.col("path"), repo).alias("component"),
                            fx.component_simple(F.col("path")).alias("simple"))


@query("language_of", f"""WITH {PATHS} SELECT page_id, path,
CASE WHEN regexp_matches(path, '\\.tsx?$') THEN 'typescript' ELSE 'javascript' END AS language,
CASE WHEN path LIKE '%.py' THEN 'python' WHEN regexp_matches(path, '\\.tsx?$') THEN 'typescript'
ELSE 'javascript' END AS prompt_language FROM paths""")
def _(t):
    p = F.col("path")
    return t.paths().select("page_id", "path", fx.language_of(p).alias("language"),
                            fx.prompt_language_of(p).alias("prompt_language"))


_NAME = f"regexp_extract({_BASE}, '^[A-Za-z]+')"
_PREFIX = "^(" + "|".join(L.HANDLER_PREFIXES) + ")"


_KINDS = f"""WITH {PATHS}, named AS (SELECT page_id,
CASE WHEN page_id % 5 = 0 THEN 'getThing' WHEN page_id % 5 = 1 THEN 'Panel' ELSE {_NAME} END AS name,
{FILE_ROLE_SQL} AS role FROM paths), kinds AS (
SELECT page_id, {_ladder([
    ("name = ''", "'anonymous'"), (sql_found('name', '^use[A-Z]'), "'hook'"),
    (sql_found('name', '^[A-Z]'), "'component'"),
    (f"{sql_found('lower(name)', _PREFIX)} AND role IN ('route', 'controller')", "role"),
    ("role IN ('model', 'middleware')", "role")], "'utility'")} AS kind FROM named)"""


def _kinds(t):
    name = (F.when(F.col("page_id") % 5 == 0, "getThing").when(F.col("page_id") % 5 == 1, "Panel")
            .otherwise(F.regexp_extract(fx.base_name(F.col("path")), "^[A-Za-z]+", 0)))
    named = t.paths().select("page_id", name.alias("name"), fx.file_role(F.col("path")).alias("role"))
    return named.select("page_id", fx.function_kind(F.col("name"), F.col("role")).alias("kind"))


@query("function_kind", f"{_KINDS} SELECT page_id, kind FROM kinds")
def _(t):
    return _kinds(t)


@query("function_report", f"""{_KINDS} SELECT 'function' AS dimension, kind AS name, count(*) AS n FROM kinds GROUP BY 2
UNION ALL SELECT 'functions', 'all', count(*) FROM kinds""")
def _(t):
    return report.function_report(_kinds(t))


_RL = L.METHOD_ROLES


@query("method_role", f"""WITH {PAIRS} SELECT pair_id, {_ladder([
    (f"regexp_matches(lower(file_path), '[.](jsx|tsx)$') OR "
     f"{sql_any('lower(file_path)', ['frontend', 'client', 'component'])} OR "
     f"{sql_any('after', ['useState', 'useEffect', 'return ('])}", quote(_RL['frontend'])),
    (f"{sql_any('lower(file_path)', ['controller', 'route', 'server', 'backend'])} OR "
     f"contains(after, 'router.') OR (contains(after, 'req') AND contains(after, 'res'))",
     quote(_RL['route'])),
    (f"{sql_any('lower(file_path)', ['model', 'schema'])} OR contains(after, 'mongoose')",
     quote(_RL['model'])),
    (sql_any('lower(file_path)', ['service', 'api']), quote(_RL['service'])),
    (sql_any('lower(file_path)', ['util', 'helper']), quote(_RL['utility']))],
    quote(_RL['other']))} AS role FROM pairs""")
def _(t):
    return t.pairs().select(
        "pair_id", fx.method_role(F.col("file_path"), F.col("after")).alias("role"))


@query("parse_repo_url", """SELECT page_id, CASE WHEN page_id % 4 > 0 THEN 'owner' || (page_id % 7)
END AS owner, CASE WHEN page_id % 4 > 0 THEN 'repo' || page_id END AS repo FROM pages""")
def _(t):
    p = F.col("page_id")
    url = F.concat(
        F.when(p % 4 > 0, "https://github.com/owner").otherwise("https://elsewhere.org/owner"),
        (p % 7).cast("string"), F.lit("/repo"), p.cast("string"),
        F.when(p % 2 == 0, ".git").otherwise("/"))
    r = t.pages.select("page_id", fx.parse_repo_url(url).alias("r"))
    return r.select("page_id", "r.owner", "r.repo")


@query("rule_category", f"""WITH {PATHS} SELECT page_id, {_ladder(
    [(sql_any('path', w), quote(n)) for n, w in L.LINT_CATEGORIES], "'logic'")} AS category,
CASE WHEN page_id % 3 = 2 THEN 'error' ELSE 'warning' END AS lint,
CASE WHEN page_id % 4 IN (0, 1) THEN 'error' ELSE 'warning' END AS audit,
{sql_pick(['error', 'error', 'warning', 'warning', 'info'], 'page_id')} AS sast FROM paths""")
def _(t):
    p = F.col("page_id")
    return t.paths().select(
        "page_id", fx.rule_category(F.col("path")).alias("category"),
        fx.lint_severity(p % 3).alias("lint"),
        fx.audit_severity(B.pick(["critical", "high", "moderate", "low"], p)).alias("audit"),
        fx.sast_severity(B.pick(["ERROR", "high", "Medium", "", "note"], p)).alias("sast"))


# --- labels --------------------------------------------------------------------------------------

_FIX = (f"NOT {sql_words(sql_fold('lower(before)'), L.NON_FIX_WORDS)} "
        f"AND {sql_words(sql_fold('lower(before)'), L.FIX_WORDS)}")


@query("is_fix_commit", f"WITH {PAIRS} SELECT pair_id, coalesce({_FIX}, false) AS is_fix FROM pairs")
def _(t):
    return t.pairs().select("pair_id", lx.is_fix_commit(F.col("before")).alias("is_fix"))


@query("drop_blocked_owners", f"""WITH {PAIRS} SELECT pair_id, repository FROM pairs
WHERE lower(split_part(repository, '/', 1)) NOT IN ({', '.join(map(quote, L.BLOCKED_OWNERS))})
AND conv_id % 6 <> 0""")
def _(t):
    p = t.pairs().withColumn("kind", F.when(F.col("conv_id") % 6 == 0, "Organization")
                             .when(F.col("conv_id") % 6 == 1, "User"))
    return quality.drop_blocked_owners(p, owner_type="kind").select("pair_id", "repository")


@query("patch_size_filter", f"""WITH {PAIRS} SELECT pair_id FROM pairs WHERE before IS NOT NULL
AND regexp_matches(file_path, '\\.(js|jsx|ts|tsx)$')
AND len(string_split(before, chr(10))) + len(string_split(after, chr(10))) BETWEEN 1 AND 35""")
def _(t):
    return quality.patch_size_filter(t.patches(), "file_path").select("pair_id")


@query("meaningful_diff", f"""WITH {PAIRS} SELECT pair_id, regexp_replace(before, '[\\s;]', '', 'g')
<> regexp_replace(after, '[\\s;]', '', 'g') AS differs FROM pairs WHERE before IS NOT NULL""")
def _(t):
    return t.pairs().where("before IS NOT NULL").select(
        "pair_id", lx.meaningful_diff(F.col("before"), F.col("after")).alias("differs"))


_SIGNAL = " OR ".join(sql_found("folded", s.pattern, s.flags) for s in FIX_SIGNALS)


@query("has_fix_signal", f"""WITH {SNIPPETS}, f AS (SELECT doc_id, {sql_fold('code')} AS folded
FROM snippets) SELECT doc_id, ({_SIGNAL}) AS signal FROM f""")
def _(t):
    return t.snippets().select("doc_id", lx.has_fix_signal(F.col("code")).alias("signal"))


def _score_ctes(rules, whole=False):
    """With `whole`, a pair without a before-text counts as one with an empty one."""
    points, names = {}, []
    for r in rules:
        if r.category not in points:
            names.append(r.category)
        points.setdefault(r.category, []).append(
            f"(CASE WHEN {sql_found('hay', r.pattern, r.flags)} THEN 1 ELSE 0 END + "
            f"CASE WHEN {sql_found('fa', r.pattern, r.flags)} AND NOT "
            f"{sql_found('fb', r.pattern, r.flags)} THEN 2 ELSE 0 END)")
    cols = ", ".join(f"{' + '.join(points[n])} AS {n}" for n in names)
    before, cut = ("coalesce(before, '')", "") if whole else ("before", " WHERE before IS NOT NULL")
    return (f"{PAIRS}, folded AS (SELECT pair_id, {sql_fold(before)} AS fb, "
            f"{sql_fold('after')} AS fa, {sql_fold('after || chr(10) || after || chr(10) || message')}"
            f" AS hay FROM pairs{cut}), scored AS (SELECT pair_id, {cols} FROM folded), "
            f"tall AS (" + " UNION ALL ".join(
                f"SELECT pair_id, {quote(n)} AS category, {i} AS position, {n} AS score FROM scored"
                for i, n in enumerate(names)) + ")")


def _scores(t, rules=CATEGORY_RULES, whole=False):
    p = t.pairs() if whole else t.pairs().where("before IS NOT NULL")
    return p, lx.candidate_scores(F.col("after"), F.col("before"), F.col("after"), F.col("message"),
                                  rules)


@query("candidate_scores", f"WITH {_score_ctes(CATEGORY_RULES)} "
                           "SELECT pair_id, category, score::BIGINT AS score FROM tall")
def _(t):
    pairs, scores = _scores(t)
    # exploding the expression, not a column made from it, keeps Spark from scoring twice
    return pairs.select("pair_id", F.explode(scores).alias("s")).select(
        "pair_id", "s.category", F.col("s.score").cast(LONG).alias("score"))


@query("ranked_candidates", f"""WITH {_score_ctes(CATEGORY_RULES, True)}, r AS (SELECT *, row_number()
OVER (PARTITION BY pair_id ORDER BY score DESC, position) AS rn FROM tall WHERE score > 0)
SELECT p.pair_id, coalesce(string_agg(category, ',' ORDER BY rn) FILTER (WHERE rn <= 4), '') AS candidates,
(coalesce(max(score) FILTER (WHERE rn = 1), 0) - coalesce(max(score) FILTER (WHERE rn = 2), 0))::BIGINT
AS margin FROM scored p LEFT JOIN r USING (pair_id) GROUP BY p.pair_id""")
def _(t):
    pairs, scores = _scores(t, whole=True)
    r = pairs.select("pair_id", lx.ranked_candidates(scores).alias("r"))
    return r.select("pair_id", F.array_join("r.candidates", ",").alias("candidates"),
                    F.col("r.margin").cast(LONG).alias("margin"))


_ROOM_SQL = ", ".join(f"({quote(c)}, {n})" for c, n in HEURISTIC_CAPS.items())


@query("best_category_by_need", f"""WITH {_score_ctes(HEURISTIC_RULES)},
room(category, room) AS (VALUES {_ROOM_SQL}), r AS (SELECT pair_id, category, row_number() OVER
(PARTITION BY pair_id ORDER BY score DESC, room DESC, position) AS rn
FROM tall JOIN room USING (category) WHERE score > 0)
SELECT s.pair_id, coalesce(r.category, 'logic_error') AS best FROM scored s
LEFT JOIN r ON s.pair_id = r.pair_id AND rn = 1""")
def _(t):
    pairs, scores = _scores(t, HEURISTIC_RULES)
    return pairs.select("pair_id", mining.best_category_by_need(scores, HEURISTIC_CAPS).alias("best"))


def condition_sql(spec, fields, folded):
    op, *args = spec
    if op in ("and", "or"):
        return "(" + f" {op.upper()} ".join(condition_sql(a, fields, folded) for a in args) + ")"
    if op == "not":
        return f"NOT {condition_sql(args[0], fields, folded)}"
    if op == "has":
        return f"contains({fields[args[0]]}, {quote(args[1])})"
    if op == "any":
        return sql_any(fields[args[0]], args[1])
    return sql_found(folded[args[0]], args[1])


_LF = {"before": "coalesce(before, '')", "after": "after", "after_lower": "lower(after)",
       "diff_lower": "lower(after)", "message_lower": "lower(message)"}
_LFF = {k: sql_fold(v) for k, v in _LF.items()}


@query("classify_ladder", f"""WITH {PAIRS} SELECT pair_id, {_ladder(
    [(condition_sql(c, _LF, _LFF), quote(v[0] + '|' + v[4])) for c, v in R.DIVERSE_LADDER[:-1]],
    quote(R.DIVERSE_LADDER[-1][1][0] + '|' + R.DIVERSE_LADDER[-1][1][4]))} AS verdict
FROM pairs""")
def _(t):
    p = t.pairs()
    v = p.select("pair_id", lx.classify_ladder(F.col("after"), F.col("before"), F.col("after"),
                                               F.col("message")).alias("v"))
    return v.select("pair_id", F.concat_ws("|", "v.bug_type", "v.bug_pattern").alias("verdict"))


_RF = {"text": "txt", "diff": "dif", "label": "bug_type", "path": "file_path"}
RELABEL_CTE = f"""{PAIRS}, relabel_in AS (SELECT *,
lower(message || chr(10) || coalesce(before, '') || chr(10) || after) AS txt,
lower(coalesce(before, '') || ' -> ' || after) AS dif FROM pairs),
stepped AS (SELECT *, {_ladder([(condition_sql(c, _RF, _RF), str(i))
                              for i, c in enumerate(R.RELABEL_STEPS, 1)], '13')} AS step
FROM relabel_in),
texts(step, new_type, pattern, cause, fix, sev, conf) AS (VALUES {', '.join(
    '(' + ', '.join([str(i), *[quote(x) for x in v[:5]], f'{v[5]}::DOUBLE']) + ')'
    for i, v in R.RELABEL_TEXTS.items())}),
relabelled AS (SELECT s.*, CASE WHEN s.step = 13 THEN {_ladder(
    [(f"bug_type = {quote(k)}", quote(v)) for k, v in R.FALLBACK_LABELS.items()],
    "'logic_error'")} ELSE new_type END AS new_label, pattern, cause, fix, conf,
CASE {' '.join(f"WHEN s.step = {i} AND {sql_any('txt', w)} THEN {quote(x)}"
               for i, (x, w) in R.RELABEL_RAISED.items())} ELSE sev END AS new_severity
FROM stepped s JOIN texts USING (step))"""


def relabelled(t):
    p = t.pairs()
    return p.withColumn("r", lx.relabel(F.col("before"), F.col("after"), F.col("message"),
                                        F.col("bug_type"), F.col("file_path")))


@query("relabel_ladder", f"""WITH {RELABEL_CTE} SELECT pair_id, step::BIGINT AS step, new_label,
pattern, cause, fix, new_severity, conf AS confidence FROM relabelled""")
def _(t):
    return relabelled(t).select(
        "pair_id", F.col("r.step").cast(LONG).alias("step"), F.col("r.bug_type").alias("new_label"),
        F.col("r.bug_pattern").alias("pattern"), F.col("r.root_cause").alias("cause"),
        F.col("r.fix_description").alias("fix"), F.col("r.severity").alias("new_severity"),
        F.col("r.confidence_score").alias("confidence"))


_PARTS = R.DESCRIPTION_TEMPLATE.split("%s")
_ARGS = ["replace(new_label, '_', ' ')", "repository", "split_part(file_path, '/', -1)",
         "lower(pattern)", "lower(cause)", "lower(fix)"]
DESCRIBE_SQL = " || ".join(x for pair in zip(map(quote, _PARTS), [*_ARGS, "''"]) for x in pair)


@query("describe_defect", f"WITH {RELABEL_CTE} SELECT pair_id, {DESCRIBE_SQL} AS described "
                          "FROM relabelled")
def _(t):
    r = relabelled(t)
    return r.select("pair_id", fx.describe_defect(
        F.col("repository"), F.col("file_path"), F.col("r.bug_type"), F.col("r.bug_pattern"),
        F.col("r.root_cause"), F.col("r.fix_description")).alias("described"))


# answers of an offline scorer, as JSON text built from the pair columns
def _answers(t):
    p = F.col("pair_id")
    answer = F.struct(
        B.pick(["accept", "reject", "accept", "maybe"], p).alias("decision"),
        F.when(p % 7 == 0, "odd_type").otherwise(F.col("bug_type")).alias("bug_type"),
        ((p % 13) / 10).alias("confidence"), F.col("before").alias("root_cause"),
        F.col("message").alias("bug_description"), F.lit("x").alias("fix_description"),
        F.when(p % 5 == 0, "urgent").otherwise(F.col("severity")).alias("severity"),
        F.array("repository", "bug_type").alias("evidence"))
    return t.pairs().withColumn("answer", F.concat(F.lit("```json\n"), F.to_json(answer),
                                                   F.lit("\n```")))


def _checked(t):
    return _answers(t).withColumn("label", fx.validate_label(fx.extract_json_object(F.col("answer"))))


_DECIDED = sql_pick(["accept", "reject", "accept", "maybe"], "pair_id")
LABEL_CTE = f"""{PAIRS}, answers AS (SELECT *, {_DECIDED} AS decision, (pair_id % 13) / 10 AS conf,
CASE WHEN pair_id % 7 = 0 THEN 'odd_type' ELSE bug_type END AS said,
CASE WHEN pair_id % 5 = 0 THEN 'medium' ELSE severity END AS sev FROM pairs),
checked AS (SELECT *, decision IN ('accept', 'reject') AND conf <= 1
AND (decision = 'reject' OR said <> 'odd_type') AS valid FROM answers)"""


@query("validate_label", f"""WITH {LABEL_CTE} SELECT pair_id,
CASE WHEN valid THEN decision END AS decision,
CASE WHEN valid AND decision = 'accept' THEN said END AS bug_type,
CASE WHEN valid THEN round(conf, 4) END AS confidence,
CASE WHEN valid THEN substring(coalesce(before, ''), 1, 500) END AS root_cause,
CASE WHEN valid THEN sev END AS severity,
CASE WHEN valid THEN repository || ';' || bug_type END AS evidence FROM checked""")
def _(t):
    r = F.col("label")
    return _checked(t).select(
        "pair_id", r["decision"].alias("decision"), r["bug_type"].alias("bug_type"),
        F.round(r["confidence"], 4).alias("confidence"), r["root_cause"].alias("root_cause"),
        r["severity"].alias("severity"), F.array_join(r["evidence"], ";").alias("evidence"))


@query("extract_json_object", f"""WITH {PAIRS} SELECT pair_id,
CASE WHEN pair_id % 3 = 0 THEN '{{"k": ' || pair_id || '}}' ELSE 'no object' END AS found FROM pairs""")
def _(t):
    p = F.col("pair_id")
    text = F.when(p % 3 == 0, F.concat(F.lit("```json\nsure: {\"k\": "), p.cast("string"),
                                       F.lit("}\n```"))).otherwise("  no object\n")
    return t.pairs().select("pair_id", fx.extract_json_object(text).alias("found"))


@query("accept_label", f"""WITH {LABEL_CTE} SELECT pair_id, said AS bug_type FROM checked
WHERE valid AND decision = 'accept' AND conf >= 0.8""")
def _(t):
    return quality.accept_label(_checked(t)).select("pair_id", F.col("label.bug_type").alias("bug_type"))


@query("severity_default", f"""WITH {PAIRS} SELECT pair_id, CASE WHEN pair_id % 2 = 0 THEN severity
ELSE {_ladder([(f'bug_type = {quote(k)}', quote(v)) for k, v in L.BASE_SEVERITY.items()], "'medium'")} END
AS severity, CASE WHEN pair_id % 3 = 0 THEN repository ELSE
{_ladder([(f'bug_type = {quote(k)}', quote(k.replace('_', ' ').title())) for k in L.APPROVED_TYPES], "''")} END
AS pattern FROM pairs""")
def _(t):
    p = F.col("pair_id")
    evidence = F.when(p % 3 == 0, F.array("repository")).otherwise(F.array().cast("array<string>"))
    return t.pairs().select(
        "pair_id", fx.severity_default(F.when(p % 2 == 0, F.col("severity")).otherwise(""),
                                       F.col("bug_type")).alias("severity"),
        fx.bug_pattern(evidence, F.col("bug_type")).alias("pattern"))


@query("constrain_labels", f"""WITH {PATHS} SELECT page_id,
CASE WHEN page_id % 3 = 0 THEN 'other' ELSE 'null_pointer' END AS bug_type,
CASE WHEN page_id % 2 = 0 THEN 'api' ELSE 'unknown' END AS component,
CASE WHEN page_id % 4 = 1 THEN 'critical' ELSE 'medium' END AS severity,
round(greatest(0.0, least(1.0, (page_id % 30 - 5) / 10)), 4) AS confidence FROM paths""")
def _(t):
    p = F.col("page_id")
    return t.pages.select(
        "page_id", fx.constrain_type(F.when(p % 3 == 0, "bad").otherwise("null_pointer")).alias("bug_type"),
        fx.constrain_component(F.when(p % 2 == 0, "api").otherwise(F.col("url"))).alias("component"),
        fx.constrain_severity(F.when(p % 4 == 1, "critical").otherwise("Odd")).alias("severity"),
        F.round(fx.clamp01((p % 30 - 5) / 10), 4).alias("confidence"))


@query("semantic_text", f"""WITH {PAIRS} SELECT pair_id,
'COMMIT: ' || message || chr(10) || 'BUG: ' || bug_type || chr(10) || 'ROOT CAUSE: ' ||
coalesce(before, '') || chr(10) || 'FIX: ' || after AS narrative,
'BUGGY:' || chr(10) || substring(before, 1, 1000) || chr(10) || 'FIXED:' || chr(10)
|| substring(after, 1, 1000) AS both_sides,
'//' || bug_type || chr(10) || {sql_trim('before')} AS tagged FROM pairs""")
def _(t):
    b, a = F.col("before"), F.col("after")
    return t.pairs().select(
        "pair_id", fx.narrative_text(F.col("message"), F.col("bug_type"), b, a).alias("narrative"),
        fx.before_after_text(b, a).alias("both_sides"),
        fx.tagged_text(F.col("bug_type"), b).alias("tagged"))


@query("content_key", f"""SELECT doc_id, sha256({sql_trim('text')} || '_' || lang) AS content_key
FROM documents""")
def _(t):
    return t.documents.select("doc_id", fx.content_key(F.col("text"), F.col("lang")).alias("content_key"))


def _cut(e, n):
    return (f"CASE WHEN length({e}) > {n} THEN substring({e}, 1, {n}) || chr(10) || "
            f"'... [truncated]' ELSE {e} END")


@query("prompt_row", f"""WITH {PAIRS} SELECT pair_id, 'Commit message: ' ||
substring({sql_trim('message')}, 1, 300) || chr(10) || 'Candidate categories: ' || bug_type || ', ' ||
severity || chr(10) || 'Before:' || chr(10) || {_cut('before', 1500)} || chr(10) || 'After:' || chr(10)
|| {_cut('after', 1500)} || chr(10) || 'Diff:' || chr(10) || {_cut('after', 1500)} AS prompt
FROM pairs WHERE before IS NOT NULL""")
def _(t):
    return t.pairs().where("before IS NOT NULL").select("pair_id", fx.prompt_row(
        F.col("before"), F.col("after"), F.col("after"), F.col("message"),
        F.array("bug_type", "severity")).alias("prompt"))


# --- repair and patches ------------------------------------------------------------------------

_FRONT = (f"(regexp_matches(path, '\\.(jsx|tsx)$') OR "
          f"{sql_any('lower(path)', ['frontend', 'component'])} OR "
          f"{sql_any('code', ['useState', 'useEffect'])} OR (contains(code, '<') AND contains(code, '>')))")
_ROUTE = (f"({sql_any('lower(path)', ['controllers', 'routes', 'server.js'])} OR (contains(code, 'req') "
          "AND contains(code, 'res')) OR contains(code, 'router.'))")
# Rules 1 and 3 use back-references, which the SQL engine lacks. In the derived texts no array
# element is set before a setter, and only one unawaited call can occur, so rule 3 is spelled out.
_REPAIR_SQL = _ladder([
    (f"{_FRONT} AND {sql_found('folded', R.EMPTY_STATE_PATTERN)} AND contains(code, '.map(')", "2"),
    (f"contains(code, 'const class = fetchAll(x); class ') AND {_no('code', 'await ')}", "3"),
    (f"contains(code, '<=') AND {sql_any('code', ['.length', '.size'])}", "4"),
    (f"{sql_found('folded', R.DEEP_PATTERN)} AND {_no('code', '?.')}", "5"),
    (f"contains(code, 'fetch(') AND contains(code, {quote(quote('POST'))}) AND contains(code, 'body:') "
     f"AND {_no('code', 'headers:')}", "6"),
    (f"{_ROUTE} AND {sql_any('code', ['async ', 'async('])} AND {_no('code', 'try {', 'try{')}", "7"),
], "0")


@query("repair_rule", f"""WITH {SNIPPETS}, f AS (SELECT doc_id, code, {sql_fold('code')} AS folded,
source || '/app.jsx' AS path FROM snippets) SELECT doc_id, ({_REPAIR_SQL})::BIGINT AS rule FROM f""")
def _(t):
    path = F.concat("source", F.lit("/app.jsx"))
    return t.snippets().select("doc_id", repair.repair_rule(F.col("code"), path).cast(LONG).alias("rule"))


@query("repair_rules")
def _(t):
    code = t.snippets().withColumn("path", F.concat("source", F.lit("/app.jsx")))
    return repair.repair_rules(code, "code", "path").select(
        "doc_id", "rule", "is_bug", "repair_type", "repair_severity", "explanation", "suggested_code")


@query("repair_patch_bound", f"""WITH {SNIPPETS} SELECT doc_id,
regexp_replace({sql_fold('code')}, '<=\\s*(\\w+\\.(?:length|size))', '< \\1', 'g') AS patched
FROM snippets""")
def _(t):
    fixed = t.snippets().select("doc_id", repair.patched_code(F.col("code"), F.lit(4)).alias("p"))
    return fixed.select("doc_id", F.regexp_replace("p", "[^\\x00-\\x7F]", "_").alias("patched"))


@query("hunk_pairs", f"""WITH {PAIRS} SELECT pair_id,
'head line' || chr(10) || before || chr(10) || 'tail line' AS old_text,
'head line' || chr(10) || after || chr(10) || 'tail line' AS new_text,
10::BIGINT AS source_start, (len(string_split(before, chr(10))) + 2)::BIGINT AS source_length,
12::BIGINT AS target_start, (len(string_split(after, chr(10))) + 2)::BIGINT AS target_length
FROM pairs WHERE before IS NOT NULL AND before <> after""")
def _(t):
    h = reshape.hunk_pairs(t.patches().select("pair_id", "patch"))
    return h.select("pair_id", F.col("before").alias("old_text"), F.col("after").alias("new_text"),
                    *[F.col(c).cast(LONG) for c in ("source_start", "source_length", "target_start",
                                                    "target_length")])


@query("reverse_patch", f"""WITH {PAIRS} SELECT pair_id, {sql_trim(
    "' head line' || chr(10) || before || chr(10) || ' tail line'")} AS old_text
FROM pairs WHERE before IS NOT NULL""")
def _(t):
    return t.patches().select("pair_id", reshape.reverse_patch(F.col("patch")).alias("old_text"))


@query("strip_comments")
def _(t):
    return t.snippets().select("doc_id", slicing.strip_comments(F.col("code")).alias("code"))


@query("slice_methods")
def _(t):
    return slicing.slice_methods(t.snippets().select("doc_id", "code"), "code")


@query("function_spans")
def _(t):
    files = t.paths().select("page_id", fx.file_role(F.col("path")).alias("role"),
                             B.swap(F.col("html"), B.CODE_WORDS).alias("content"))
    return slicing.function_spans(files, "content", "role")


@query("complexity_proxy")
def _(t):
    return t.snippets().select("doc_id", fx_c("code").alias("c")).select("doc_id", "c.*")


def fx_c(name):
    return vx.complexity_proxy(F.col(name))


# --- reshape --------------------------------------------------------------------------------------

@query("unpivot_pairs", f"""WITH {PAIRS}, both_sides AS (
SELECT pair_id, 1 AS is_bug, {sql_trim("coalesce(before, '')")} AS code FROM pairs UNION ALL
SELECT pair_id, 0, {sql_trim('after')} FROM pairs)
SELECT row_number() OVER (ORDER BY pair_id, is_bug DESC) AS sample_id, pair_id,
is_bug::BIGINT AS is_bug, CASE WHEN is_bug = 1 THEN 'buggy' ELSE 'clean' END AS label_name, code
FROM both_sides WHERE code <> ''""")
def _(t):
    p = t.pairs().select("pair_id", "before", "after", F.lit("[]").alias("v1"), F.lit("[]").alias("v2"))
    return reshape.unpivot_pairs(p, before="before", after="after", before_vector="v1",
                                 after_vector="v2").select(
        F.col("sample_id").cast(LONG), "pair_id", F.col("is_bug").cast(LONG), "label_name", "code")


ASSEMBLE_CTE = f"""{PAIRS}, samples AS (
SELECT turn * 3 AS pair_key, pair_id * 2 AS sample_id, 1 AS is_bug, before AS code, repository,
file_path, bug_type, severity FROM pairs WHERE before IS NOT NULL UNION ALL
SELECT conv_id * 3, pair_id * 2 + 1, 0, after, repository, file_path, bug_type, severity FROM pairs)"""


@query("assemble_pairs", f"""WITH {ASSEMBLE_CTE}, ids AS (SELECT pair_key,
min(sample_id) FILTER (WHERE is_bug = 1) AS bug_id, min(sample_id) FILTER (WHERE is_bug = 0) AS clean_id
FROM samples GROUP BY 1), made AS (SELECT b.pair_key, b.code AS before, c.code AS after, b.repository,
b.file_path, b.bug_type, b.severity FROM ids JOIN samples b ON b.sample_id = ids.bug_id
JOIN samples c ON c.sample_id = ids.clean_id)
SELECT pair_key AS pair_id, 'c_' || pair_key AS commit_id,
'Fix ' || bug_type || ' in ' || file_path AS commit_message,
upper(severity[1]) || severity[2:] AS severity, before AS buggy, after AS fixed,
0.9::DOUBLE AS confidence, {SIGNATURE_SQL} FROM made""")
def _(t):
    p = t.pairs()
    cols = ["repository", "file_path", "bug_type", "severity"]
    bug = p.where("before IS NOT NULL").select(
        (F.col("turn") * 3).alias("pair_id"), (F.col("pair_id") * 2).alias("sample_id"),
        F.lit(1).alias("is_bug"), F.col("before").alias("code"), *cols)
    clean = p.select((F.col("conv_id") * 3).alias("pair_id"),
                     (F.col("pair_id") * 2 + 1).alias("sample_id"),
                     F.lit(0).alias("is_bug"), F.col("after").alias("code"), *cols)
    made = reshape.assemble_pairs(bug.unionByName(clean))
    return made.select(
        "pair_id", "commit_id", "commit_message", "severity", F.col("buggy_code_chunk").alias("buggy"),
        F.col("fixed_code_chunk").alias("fixed"), F.col("label_confidence").alias("confidence"),
        *[F.col(f"delta_signature.{c}").cast(LONG).alias(c) for c in (
            "added_boundary_check", "added_await", "delta_op_gt", "complexity_delta")])


@query("word_ngrams", """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text),
'[\\p{L}\\p{N}_]+|[-+*/=<>!&|?:.,]') AS w FROM documents), g AS (SELECT doc_id, unnest(list_concat(w,
[w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS gram FROM t)
SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g GROUP BY gram""")
def _(t):
    g = t.texts().select("doc_id", tfidf.word_grams(F.col("text")).alias("grams"))
    return tfidf.tfidf_fit(g, max_terms=None).select(F.col("term").alias("gram"),
                                                     F.col("tf").alias("n"), F.col("df").alias("docs"))


@query("char_ngrams", """WITH w AS (SELECT conv_id * 1000 + turn AS id,
unnest([x for x in regexp_split_to_array(lower(text), '\\s+') if x <> '']) AS w FROM conversations),
p AS (SELECT id, ' ' || w || ' ' AS w FROM w), g AS (SELECT id,
unnest([substring(w, i, n) for i in range(1, greatest(length(w) - n + 2, 1))]) AS gram
FROM p, (VALUES (2), (3), (4)) v(n))
SELECT gram, count(*) AS n, count(DISTINCT id) AS docs FROM g GROUP BY gram HAVING docs >= 2""")
def _(t):
    g = t.conversations.repartition("conv_id").select(tfidf.char_grams(F.col("text")).alias("grams"))
    return tfidf.tfidf_fit(g, max_terms=None, min_docs=2).select(
        F.col("term").alias("gram"), F.col("tf").alias("n"), F.col("df").alias("docs"))


@query("build_record", f"""WITH {LABEL_CTE} SELECT pair_id, file_path,
CASE WHEN regexp_matches(file_path, '\\.tsx?$') THEN 'typescript' ELSE 'javascript' END AS language,
substring(replace({sql_trim('message')}, chr(10), ' '), 1, 300) AS original_commit_message,
sev AS severity, repository AS bug_pattern,
CASE WHEN {sql_any('file_path', ['server', 'api'])} THEN 'backend' ELSE 'frontend' END AS component,
round(conf, 2) AS confidence_score FROM checked WHERE valid AND decision = 'accept'""")
def _(t):
    rows = _checked(t).where("label.decision = 'accept'").select(
        "*", F.col("before").alias("buggy_code"), F.col("after").alias("fixed_code"),
        F.array(F.lit(0.5)).alias("buggy_vector"), F.array(F.lit(0.25)).alias("fixed_vector"),
        F.lit("tier_1").alias("ast_tier"), F.lit(1).alias("match_margin"))
    made = mining.build_record(rows)
    ids = rows.select("pair_id", "commit_hash")
    return made.join(ids, "commit_hash").select(
        "pair_id", "file_path", "language", "original_commit_message", "severity", "bug_pattern",
        F.col("affected_component").alias("component"), "confidence_score")


@query("reliable_tier", f"""WITH {PAIRS} SELECT pair_id, CASE WHEN pair_id % 4 IN (0, 1) AND
turn % 3 < 2 THEN a ELSE 'unreliable:' || a || '|' || b END AS tier FROM (SELECT *,
{sql_pick(['tier_1_direct', 'tier_2_wrapped', 'tier_3_fallback', 'parse_error'], 'pair_id')} AS a,
{sql_pick(['tier_2_wrapped', 'tier_1_direct', 'tier_3_fallback'], 'turn')} AS b FROM pairs)""")
def _(t):
    a = B.pick(["tier_1_direct", "tier_2_wrapped", "tier_3_fallback", "parse_error"], F.col("pair_id"))
    b = B.pick(["tier_2_wrapped", "tier_1_direct", "tier_3_fallback"], F.col("turn"))
    return t.pairs().select("pair_id", quality.joint_tier(a, b).alias("tier"))


@query("dependency_names", """SELECT page_id, unnest(['react', 'dep' || (page_id % 9), 'jest']) AS name
FROM pages WHERE page_id % 5 > 0""")
def _(t):
    p = F.col("page_id")
    deps = F.create_map(F.lit("react"), F.lit("18"), F.concat(F.lit("dep"), (p % 9).cast("string")),
                        F.lit("1"))
    content = F.when(p % 5 > 0, F.to_json(F.struct(
        deps.alias("dependencies"), F.create_map(F.lit("jest"), F.lit("9")).alias("devDependencies"))))
    return t.pages.select("page_id", F.explode(reshape.dependency_names(
        F.coalesce(content, F.lit("not json")))).alias("name"))


@query("repository_name", "SELECT page_id, CASE WHEN contains(url, 'spam-farm') THEN 'spam-farm' "
                          "WHEN contains(url, 'blog') THEN 'blog' END AS known FROM pages")
def _(t):
    known = [("spam-farm", "https://spam-farm.example.org"), ("blog", "https://blog.example.org")]
    return t.pages.select("page_id", mining.match_known_repo(F.col("url"), known).alias("known"))


@query("squeeze_lines", f"SELECT item_id, {sql_trim('text')} AS text FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", squeeze(F.col("text")).alias("text"))
