import random
import re

import pytest
from pyspark.sql import functions as F

from patchlens.functions import labels as lx
from patchlens.functions import text as fx
from patchlens.functions import vectors as vx
from patchlens.functions.patterns import required_literal
from patchlens.operators import quality
from patchlens.rules.categories import CATEGORY_RULES, HEURISTIC_RULES


def one(spark, **exprs):
    return spark.range(1).select(*[e.alias(n) for n, e in exprs.items()]).first()


BEFORE = "function f(u) {\n  return u.profile.email;\n}"
AFTER = "async function f(u) {\n  if (!u) return null;\n  const r = await load(u);\n  return r?.email;\n}"


@pytest.mark.parametrize("before, after, expected", [
    (BEFORE, AFTER, (2, 2, 0, 2)),
    ("for (let i = 0; i <= a.length; i++) {}\n", "for (let i = 0; i < a.length; i++) {}", (0, 0, -1, 0)),
    (BEFORE, BEFORE, (0, 0, 0, 0)),
])
def test_delta_signature(spark, before, after, expected):
    assert tuple(one(spark, s=fx.delta_signature(F.lit(before), F.lit(after)))["s"]) == expected


@pytest.mark.parametrize("code, expected", [
    ("function add(a, b) { return a + b; }", 0.0),
    ("for (let i = 0; i <= x.length; i++) { s += x[i]; }", 0.30),
    ("async function g() { return fetch('/a'); }", 0.40),
    ("function e(user) { return user.profile.email; }", 0.20),
    ("if (n <= x.length) { return fetch('/a'); }", 0.40),
])
def test_defect_score(spark, code, expected):
    assert one(spark, s=fx.defect_score(F.lit(code)))["s"] == pytest.approx(expected)


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\nb", "\n", "a\r\nb\r\n", "a\n\nb\x0bc", "x y"])
def test_line_count_follows_splitlines(spark, text):
    assert one(spark, n=fx.line_count(F.lit(text)))["n"] == len(text.splitlines())


@pytest.mark.parametrize("message, expected", [
    ("fix: handle null user", True), ("docs: fix typo", False), ("Fix lint error", False),
    ("add feature", False), ("prefix tuning", False), ("", False)])
def test_is_fix_commit(spark, message, expected):
    assert one(spark, k=lx.is_fix_commit(F.lit(message)))["k"] is expected


@pytest.mark.parametrize("path, keep", [
    ("src/pages/Login.jsx", True), ("node_modules/a/index.js", False), ("Build/x.js", False),
    ("src/a.test.ts", False), ("src/types.d.ts", False), ("src/a.py", False)])
def test_source_file_filter(spark, path, keep):
    assert one(spark, k=quality.is_source_file(F.lit(path)))["k"] is keep


@pytest.mark.parametrize("path, role", [
    ("src/hooks/a.js", "hook"), ("src/useThing.js", "hook"), ("src/controllers/a.js", "controller"),
    ("hooks/a.js", "unknown"), ("src/models/u.js", "model"), ("src/index.js", "entry"),
    ("src/api/x.js", "utility"), ("src/store/x.js", "store")])
def test_file_role(spark, path, role):
    assert one(spark, r=fx.file_role(F.lit(path)))["r"] == role


def test_meaningful_diff(spark):
    row = one(spark, a=lx.meaningful_diff(F.lit("a = 1;"), F.lit("a=1")),
              b=lx.meaningful_diff(F.lit("a=1"), F.lit("a=2")))
    assert (row["a"], row["b"]) == (False, True)


def test_ranked_candidates(spark):
    def scores(*pairs):
        return F.array(*[F.struct(F.lit(c).alias("category"), F.lit(i).alias("rank"),
                                  F.lit(s).alias("score")) for i, (c, s) in enumerate(pairs)])

    row = one(spark, a=lx.ranked_candidates(scores(("async_error", 3), ("null_pointer", 5), ("logic_error", 1))),
              b=lx.ranked_candidates(scores(("x", 4), ("y", 0))), c=lx.ranked_candidates(scores(("x", 0))))
    assert (row["a"]["candidates"], row["a"]["margin"]) == (["null_pointer", "async_error", "logic_error"], 2)
    assert (row["b"]["candidates"], row["b"]["margin"]) == (["x"], 4)
    assert (row["c"]["candidates"], row["c"]["margin"]) == ([], 0)


def test_required_literal_never_loses_a_match(spark):
    import re
    samples = ["await x", "a.then (b)", "new promise(", "escape (x)", "escapeHtml(", "for (;;i <= a.length",
               "jwt.sign(", "verify(a token", "as Foo", "finally { x close", "React.lazy (", "res.status (5).send (",
               "[ i - 1 ]", "page * limit", "reducer(", "catch (", "try {", "if (!a.b)", "useEffect", "O(n"]
    for rule in [*CATEGORY_RULES, *HEURISTIC_RULES]:
        word = required_literal(rule.pattern)
        flags = (re.I if "i" in rule.flags else 0) | (re.S if "s" in rule.flags else 0)
        for text in samples:
            if word and re.search(rule.pattern, text, flags):
                folded = text.lower() if "i" in rule.flags else text
                assert (word.lower() if "i" in rule.flags else word) in folded, (rule, text)


def test_candidate_scores_equal_plain_regex_scan(spark):
    import re
    texts = [(BEFORE, AFTER, "fix null"), (AFTER, BEFORE, "x"), ("useState()", "useEffect(() => dispatch(x))", "m"),
             ("for (i; i <= a.length; i++)", "for (i; i < a.length; i++) { a.slice (1) }", "bounds")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, b string, a string, m string")
    rows = df.select("i", lx.candidate_scores(F.col("a"), F.col("b"), F.col("a"), F.col("m")).alias("s")).collect()
    for row in rows:
        before, after, message = texts[row["i"]]
        expected = {}
        for r in CATEGORY_RULES:
            flags = (re.I if "i" in r.flags else 0) | (re.S if "s" in r.flags else 0)
            hit = 1 if re.search(r.pattern, f"{after}\n{after}\n{message}", flags) else 0
            new = re.search(r.pattern, after, flags) and not re.search(r.pattern, before, flags)
            expected[r.category] = expected.get(r.category, 0) + hit + (2 if new else 0)
        assert {s["category"]: s["score"] for s in row["s"]} == expected


def test_validate_label(spark):
    def v(text):
        return one(spark, r=fx.validate_label(F.lit(text)))["r"]

    assert v('{"decision":"accept","bug_type":"null_pointer","confidence":1.2}') is None
    assert v('{"decision":"accept","bug_type":"odd","confidence":0.5}') is None
    assert v("not json") is None
    assert v('{"decision":"reject","bug_type":"null_pointer","confidence":0.5}')["bug_type"] is None
    row = v('{"decision":"accept","bug_type":"null_pointer","confidence":0.9,"severity":"urgent","evidence":"one"}')
    assert (row["severity"], row["evidence"]) == ("medium", ["one"])


def test_parse_vector(spark):
    row = one(spark, a=vx.parse_vector(F.lit("[1,2]"), 3), b=vx.parse_vector(F.lit("bad"), 3),
              c=vx.parse_vector(F.lit("[1,2,3]"), 3))
    assert (row["a"], row["b"], row["c"]) == ([0, 0, 0], [0, 0, 0], [1, 2, 3])


def test_token_vectors(spark):
    row = one(spark, a=vx.token_vector64(F.lit(AFTER)), b=vx.token_vector120(F.lit(AFTER)),
              c=vx.token_vector120(F.lit("  \n ")), d=vx.token_vector64(F.lit("")))
    assert len(row["a"]) == 64 and sum(x * x for x in row["a"]) == pytest.approx(1)
    assert len(row["b"]) == 120 and sum(row["b"]) == pytest.approx(1)
    assert row["c"] == [0.0] * 120
    assert row["d"][57] > 0 and sum(x > 0 for x in row["d"]) == 3


def test_calibrated_score(spark):
    cases = [(0.35, 0.30, 0.825), (0.3, 0.2, 0.65), (0.0, 0.0, 0.05), (1.0, 0.0, 0.98)]
    for raw, bonus, expected in cases:
        assert one(spark, s=fx.calibrated_score(F.lit(raw), F.lit(bonus)))["s"] == pytest.approx(expected)


def test_tool_lines_and_urls(spark):
    row = one(spark, a=fx.parse_tsc_line(F.lit("src\\a.ts(3,4): error TS2322: bad ")),
              b=fx.parse_tsc_line(F.lit("noise")), c=fx.parse_repo_url(F.lit(" https://github.com/a/b.git ")),
              d=fx.parse_repo_url(F.lit("https://x.org/a")))
    assert tuple(row["a"]) == ("src/a.ts", 3, 4, "error", "TS2322", "bad")
    assert row["b"] is None and tuple(row["c"]) == ("a", "b") and row["d"] is None


def _complexity(code):
    """Branches, nesting and tokens by walking over the text."""
    branches = len(re.findall(r"\b(?:if|for|while|catch)\b", code)) + len(re.findall(r"\bdo\b\s*\{", code))
    branches += len(re.findall(r"\?(?![.?:])", code)) + len(re.findall(r"&&|\|\||\?\?", code))
    now = top = 0
    for c in code:
        now = now + 1 if c == "{" else max(0, now - 1) if c == "}" else now
        top = max(top, now)
    return branches + 1, top + 1, len(re.findall(r"\w+|[^\s\w]", code))


def test_complexity_against_a_walk_over_the_text(spark):
    rng = random.Random(11)
    parts = ["if (", "for ", "while", "catch (e) ", "do {", "do", "}", "{", " ? a : b", "?.", "??", "&&", "||", "x1", " ", "\n", "é", "iffy", ";"]
    codes = ["", "}}}{{", "if"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(80)]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "id long, code string")
    got = {r["id"]: tuple(r["p"]) for r in rows.select("id", vx.complexity_proxy(F.col("code")).alias("p")).collect()}
    assert got == {i: _complexity(c) for i, c in enumerate(codes)}


def test_words_are_swapped_in_order(spark):
    from patchlens.plans.bindings import CODE_WORDS, PATH_WORDS, swap
    texts = [None, "", "The cat is in the house. Und mit été of of the the ", "aaa \U0001f600 et  et la la que"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    for words in (CODE_WORDS, PATH_WORDS, [("aa", "b"), ("ba", "")]):
        made = docs.select("id", swap(F.col("t"), words).alias("s"))
        want = []
        for t in texts:
            for old, new in words if t is not None else []:
                t = t.replace(old, new)
            want.append(t)
        assert [r["s"] for r in made.orderBy("id").collect()] == want
        assert "ArrowEvalPython" in made._jdf.queryExecution().toString()  # a batch at a time, not a pass over columns a word
