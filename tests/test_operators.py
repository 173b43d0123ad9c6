import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patchlens.functions import text as fx
from patchlens.operators import (
    evaluate, grouping, mining, quality, repair, report, reshape, retrieval, slicing, splits, tfidf,
)
from patchlens.rules import lexicon as L


def test_tfidf_worked_case(spark):
    docs = spark.createDataFrame([(1, "a.b"), (2, "a = b"), (3, "c")], "id long, t string")
    grams = docs.select("id", tfidf.word_grams(F.col("t")).alias("grams"))
    vocabulary = tfidf.tfidf_fit(grams, max_terms=None)
    w = {(r["id"], r["term"]): r["weight"] for r in tfidf.tfidf_transform(grams, vocabulary, "id").collect()}
    assert w[1, "a"] == pytest.approx(0.373022, abs=1e-6) and w[1, ". b"] == pytest.approx(0.490479, abs=1e-6)
    assert w[3, "c"] == 1.0
    cosine = sum(w.get((1, t), 0) * x for (d, t), x in w.items() if d == 2)
    assert cosine == pytest.approx(0.278291, abs=1e-6)
    fitted = tfidf.TermWeights.fit(grams)
    sparse = {r["id"]: dict(zip((fitted.terms[i] for i in r["idx"]), r["val"])) for r in fitted.sparse(grams).collect()}
    assert all(sparse[d][t] == pytest.approx(x) for (d, t), x in w.items())


def test_char_grams_short_words(spark):
    row = spark.range(1).select(tfidf.char_grams(F.lit("a  bcd")).alias("g")).first()["g"]
    assert row == [" a", "a ", " a ", " b", "bc", "cd", "d ", " bc", "bcd", "cd ", " bcd", "bcd "]


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_same_in_blocks_and_by_numpy(spark, k):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(70, 8)), rng.normal(size=(45, 8))
    b[7] = b[3]  # a tie: the smaller id must win
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id long, v array<double>")
    right = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)], "id long, v array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(unit(a) @ unit(b).T, 9)
    want = {(i, j) for i in range(70) for j in sorted(range(45), key=lambda j: (-s[i, j], j))[:k]}
    for sizes in ({}, {"block_rows": 10}):
        got = retrieval.vector_topk(left, right, "id", "v", 8, k, **sizes).collect()
        assert {(r["target_id"], r["reference_id"]) for r in got} == want
        assert len(got) == 70 * k


def test_hybrid_top1_finds_itself(spark):
    rows = [(1, "for (let i = 0; i <= a.length; i++) {}"), (2, "async function f() { await g(); }"), (3, "const x = 1;")]
    t = spark.createDataFrame(rows, "id long, code string")
    r = t.withColumnsRenamed({"id": "rid", "code": "ref"})
    for sizes in ({}, {"block_rows": 2}):
        got = {x["target_id"]: (x["reference_id"], x["score"])
               for x in retrieval.hybrid_top1(t, r, "id", "rid", "code", "ref", **sizes).collect()}
        assert got == {i: (i, pytest.approx(1.0)) for i, _ in rows}
    for sizes in ({}, {"block_rows": 2}):
        kept = retrieval.hybrid_top1(t.withColumn("n", F.length("code")), r, "id", "rid", "code", "ref", carry=("n",), **sizes)
        assert {x["target_id"]: x["n"] for x in kept.collect()} == {i: len(c) for i, c in rows}
    twice = retrieval.hybrid_top1(t.union(t), r, "id", "rid", "code", "ref").collect()
    assert sorted((x["target_id"], x["reference_id"]) for x in twice) == sorted((i, i) for i, _ in rows + rows)
    empty = retrieval.hybrid_top1(t, r.where("rid < 0"), "id", "rid", "code", "ref").collect()
    assert sorted((x["target_id"], x["reference_id"], x["score"]) for x in empty) == [(i, None, 0.0) for i, _ in rows]


def test_gate_is_monotone_in_the_threshold(spark):
    df = spark.range(200).select((F.col("id") / 200).alias("score"))
    sizes = [retrieval.gate(df, threshold=x).where("suspicious").count() for x in (0.2, 0.5, 0.8)]
    assert sizes == sorted(sizes, reverse=True)


def test_hunk_pairs(spark):
    rows = [(1, "@@ -1,3 +1,3 @@\n a\n-b\n+c\n d"), (2, "@@ -1,9 +1,3 @@\n a\n-b\n+c\n d"),
            (3, "@@ -1,2 +1,2 @@ f\n-x\n+y\n z\n@@ -9,4 +9,4 @@\n k\n-p\n+q\n m\n-r\n+s\n"),
            (4, "@@ -1,7 +1,8 @@\n 1\n 2\n 3\n 4\n 5\n+n\n 6\n 7\n\\ No newline")]
    df = spark.createDataFrame(rows, "id int, patch string")
    got = sorted((r["id"], r["before"], r["after"], r["source_start"], r["target_length"])
                 for r in reshape.hunk_pairs(df).collect())
    assert got == [(1, "a\nb\nd", "a\nc\nd", 1, 3), (3, "k\np", "k\nq", 9, 4), (3, "x\nz", "y\nz", 1, 2),
                   (4, "2\n3\n4\n5\n6\n7", "2\n3\n4\n5\nn\n6\n7", 1, 8)]


def test_unpivot_numbers_without_gaps(spark):
    p = spark.createDataFrame([(5, "a", ""), (1, "b", "c"), (300000, None, "d")], "pair_id long, x string, y string")
    p = p.withColumns({"v": F.lit("1"), "w": F.lit("2")})
    rows = reshape.unpivot_pairs(p, before="x", after="y", before_vector="v", after_vector="w")
    got = [(r["sample_id"], r["pair_id"], r["is_bug"]) for r in rows.orderBy("sample_id").collect()]
    assert got == [(1, 1, 1), (2, 1, 0), (3, 5, 1), (4, 300000, 0)]


def test_assemble_pairs_needs_both_sides(spark):
    s = spark.createDataFrame([(1, 1, 1, "a"), (2, 1, 0, "b"), (3, 2, 1, "c"), (4, 1, 1, "z")],
                              "sample_id long, pair_id long, is_bug int, code string")
    rows = reshape.assemble_pairs(s).collect()
    assert [(r["pair_id"], r["buggy_code_chunk"], r["fixed_code_chunk"], r["commit_message"]) for r in rows] == [
        (1, "a", "b", "Fix defect in source")]


def test_majority_and_duplicates(spark):
    d = spark.createDataFrame([("X", "b"), ("X", "a"), ("X", "b"), ("Y", "b"), ("Y", "a")], "c string, t string")
    keys = {r["k"]: r["c"] for r in d.select(F.sha2("c", 256).alias("k"), "c").collect()}
    assert {keys[r["code_key"]]: r["majority"] for r in quality.majority_label(d, "c", "t").collect()} == {"X": "b", "Y": "a"}
    p = spark.createDataFrame([("p",), ("p",), ("p",), ("q",)], "c string")
    assert tuple(quality.duplicate_audit(p, "c").first()) == (3, 2)


@pytest.mark.parametrize("c, M, m, score, grade", [
    (1, 1, 2, 50, "C"), (0, 1, 0, 85, "B"), (0, 0, 2, 90, "A"), (0, 0, 4, 80, "B"), (5, 0, 0, 0, "C")])
def test_health_score(spark, c, M, m, score, grade):
    d = spark.createDataFrame([(c, M, m)], "critical int, major int, minor int")
    assert tuple(report.health_score(d).select("score", "grade").first()) == (score, grade)


def _events(spark, rows):
    return spark.createDataFrame([(i, r, c) for i, (r, c) in enumerate(rows, 1)], "id long, r string, c string")


def test_caps(spark):
    first = _events(spark, [("r1", "a"), ("r1", "a"), ("r1", "b"), ("r2", "a"), ("r2", "b")])
    caps = {"a": 2, "b": 1}
    for f in (lambda: mining.cap_per_group(first, "c", "r", ["id"], caps, per_repository=2),
              lambda: mining.cap_per_group_greedy(first, "c", "r", ["id"], caps, 2)):
        assert sorted(r["id"] for r in f().collect()) == [1, 2, 5]
    second = _events(spark, [("r1", "a"), ("r2", "a"), ("r2", "b")])
    caps = {"a": 1, "b": 1}
    assert [r["id"] for r in mining.cap_per_group(second, "c", "r", ["id"], caps, per_repository=1).collect()] == [1]
    assert sorted(r["id"] for r in mining.cap_per_group_greedy(second, "c", "r", ["id"], caps, 1).collect()) == [1, 3]


def test_greedy_caps_equal_a_plain_loop_on_skewed_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(f"r{0 if rng.random() < .4 else rng.integers(30)}", f"c{0 if rng.random() < .4 else rng.integers(5)}")
            for _ in range(2000)]
    caps = {f"c{i}": 5 + i for i in range(5)}
    by_c, by_r, want = {}, {}, []
    for i, (r, c) in enumerate(rows, 1):
        if by_c.get(c, 0) < caps[c] and by_r.get(r, 0) < 3:
            by_c[c], by_r[r] = by_c.get(c, 0) + 1, by_r.get(r, 0) + 1
            want.append(i)
    got = mining.cap_per_group_greedy(_events(spark, rows), "c", "r", ["id"], caps, 3)
    assert sorted(r["id"] for r in got.collect()) == want


def test_top_per_group_with_one_hot_key(spark):
    d = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 40).alias("k"), "id",
                                 F.pmod(F.xxhash64("id"), F.lit(97)).alias("v"))
    got = grouping.top_per_group(d, ["k"], [F.col("v").desc(), F.col("id")], 7, ["id"]).collect()
    pdf = d.toPandas().sort_values(["k", "v", "id"], ascending=[True, False, True])
    want = {(k, i) for k, g in pdf.groupby("k") for i in g["id"].head(7)}
    assert {(r["k"], r["id"]) for r in got} == want


def test_spread_row_number_is_row_number(spark):
    d = spark.range(3000).select((F.col("id") % 2 * (F.col("id") % 7)).alias("k"), "id")
    d = d.withColumn("h", grouping.id_hash(F.col("id")))
    got = grouping.spread_row_number(d, ["k"], grouping.hash_bin(F.col("h")), [F.col("h"), F.col("id")]).toPandas()
    want = got.sort_values(["k", "h", "id"]).groupby("k").cumcount() + 1
    assert (got.loc[want.index, "rn"] == want).all() and len(got) == 3000


def test_splits_keep_shares_and_groups(spark):
    d = spark.range(1000).select("id", (F.col("id") % 3 * (F.col("id") % 2)).alias("y"), (F.col("id") % 90).alias("g"))
    s = splits.stratified_split(d, "y", "id").groupBy("y").agg(F.avg(F.col("is_test").cast("int")).alias("p"))
    assert all(abs(r["p"] - 0.2) < 0.01 for r in s.collect())
    for out, c in ((splits.group_split(d, F.col("g")), "is_test"), (splits.group_kfold(d, "g"), "fold")):
        assert out.groupBy("g").agg(F.count_distinct(c).alias("n")).agg(F.max("n")).first()[0] == 1
    sizes = d.withColumn("g", F.floor(F.sqrt("id"))).transform(lambda x: splits.group_kfold(x, "g")).groupBy("fold").count()
    assert max(r["count"] for r in sizes.collect()) - min(r["count"] for r in sizes.collect()) <= 63
    f = splits.stratified_kfold(d, "y", "id").groupBy("y", "fold").count().toPandas()
    assert f.groupby("y")["count"].agg(lambda x: x.max() - x.min()).max() <= 1


def test_roc_auc(spark):
    d = spark.createDataFrame([(1, .9), (1, .5), (0, .5), (0, .1)], "y int, s double")
    assert evaluate.roc_auc(d, "y", "s").first()[0] == 0.875


def test_enclosing_function_worked_case(spark):
    spans = spark.createDataFrame([("p", 1, 30, "a", "A"), ("p", 5, 12, "b", "B"), ("p", 14, 20, "c", "C")],
                                  "path string, line_start int, line_end int, name string, code string")
    changes = spark.createDataFrame([(1, "p", 7, 9), (2, "p", 13, 13), (3, "p", 11, 15), (4, "p", 31, 31)],
                                    "id long, path string, start int, end int").withColumn("line_total", F.lit(40))
    got = {r["id"]: (r["line_start"], r["line_end"], r["function_name"])
           for r in slicing.enclosing_function(changes, spans, ["path"], "id").collect()}
    assert got == {1: (5, 12, "b"), 2: (1, 30, "a"), 3: (1, 30, "a")}


def test_attach_issues(spark):
    files = spark.createDataFrame([("A", "util", 3), ("B", "util", 4)], "path string, role string, lines int")
    issues = spark.createDataFrame([("A",), ("A",), ("package.json",)], "file string")
    got = {tuple(r) for r in report.attach_issues(files, issues).collect()}
    assert got == {("A", "util", 3, 2), ("B", "util", 4, 0), ("package.json", "config", 0, 1)}


def test_file_findings_mark(spark):
    files = spark.createDataFrame([("a",), ("b",)], "file_path string")
    found = spark.createDataFrame([("a", 1), ("a", 2)], "file_path string, n int")
    got = sorted((r["file_path"], r["n"] or 0, r["is_buggy"]) for r in report.file_findings(files, found).collect())
    assert got == [("a", 1, True), ("a", 2, True), ("b", 0, False)]


def test_small_scans_go_to_verification(spark):
    d = spark.createDataFrame([(1, 0.1)] * 3 + [(2, 0.1)] * 4, "scan_id int, score double")
    got = retrieval.gate(d, "scan_id").groupBy("scan_id").agg(
        F.count_if("suspicious").alias("n"), F.max("verify_score").alias("v")).collect()
    assert {r["scan_id"]: (r["n"], r["v"]) for r in got} == {1: (3, L.SMALL_SCAN_SCORE), 2: (0, 0.1)}


REPAIRS = [
    ("const vote = () => {\n  polls[0].voted = true;\n  setPolls(polls);\n}", "Poll.jsx", 1, "setPolls(updatedPolls)"),
    ("const [polls, setPolls] = useState();\npolls.map(p => p)", "Poll.jsx", 2, "polls?.map("),
    ("export const login = (req, res) => {\n  const user = authenticateUser(req.body);\n  return user.id;\n}", "a.js", 3,
     "const user = await authenticateUser(req.body)"),
    ("for (let i = 0; i <= polls.length; i++) {}", "a.js", 4, "i < polls.length"),
    ("return user.profile.meta.avatarUrl;", "a.js", 5, "user?.profile?.meta?.avatarUrl"),
    ("fetch('/api', {\n method: 'POST', body: x })", "a.js", 6, "headers: { 'Content-Type'"),
    ("router.get('/', async (a) => {\n  work(a);\n})", "a.js", 7, "  try {"),
    ("const a = 1;", "a.js", 0, "const a = 1;"),
]


@pytest.mark.parametrize("code, path, rule, part", REPAIRS)
def test_repair_rules(spark, code, path, rule, part):
    d = spark.createDataFrame([(code, path)], "code string, file_path string")
    row = repair.repair_rules(d).first()
    assert row["rule"] == rule and part in row["suggested_code"] and row["is_bug"] is (rule > 0)
    if rule in (1, 2, 4, 5, 6):
        assert row["suggested_code"] != code


def test_content_key_reuse(spark):
    d = spark.createDataFrame([(" a ", "t"), ("a", "t"), ("b", "t")], "code string, bug_type string")
    done = d.where("code = 'b'").select(fx.content_key(F.col("code"), F.col("bug_type")).alias("content_key"))
    known, fresh = mining.dedupe_repair(d, done, "code", "bug_type")
    assert known.count() == 1 and fresh.count() == 1


def test_known_repo_takes_the_first_in_list_order(spark):
    known = [("alpha", "https://h/alpha"), ("alp", "https://h/alp")]
    d = spark.createDataFrame([("https://h/alp",), ("x/alphabet",), ("none",)], "u string")
    got = [r[0] for r in d.select(mining.match_known_repo(F.col("u"), known)).collect()]
    assert got == ["alp", "alpha", None]


def test_grams_are_counted_by_parts(spark, monkeypatch):
    rows = [["a", "b", "a"], [], None, ["b", None], ["c"] * 5 + ["a"]]
    want = {"a": (3, 2), "b": (2, 2), "c": (5, 1), tfidf.ROW_MARK: (4, 4)}
    docs = spark.createDataFrame([(g,) for g in rows], "grams array<string>").coalesce(1)
    got = tfidf.tfidf_fit(docs, max_terms=3).collect()
    assert {r["term"]: (r["tf"], r["df"]) for r in got} | {tfidf.ROW_MARK: (got[0]["n"],) * 2} == want
    for at_once, parts in ((tfidf.COUNT_GRAMS, 1), (3, 3)):
        monkeypatch.setattr(tfidf, "COUNT_GRAMS", at_once)
        made = list(tfidf._counts(iter([pa.RecordBatch.from_arrays([pa.array(rows).slice(0)], ["grams"])])))
        total = {}
        for r in (r for batch in made for r in batch.to_pylist()):
            had = total.get(r["term"], (0, 0))
            total[r["term"]] = had[0] + r["tf"], had[1] + r["df"]
        assert total == want and len(made) == parts
