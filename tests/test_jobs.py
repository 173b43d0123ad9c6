import json
import pytest
from pyspark.sql import functions as F

from patchlens.operators import mining, report
from patchlens.plans import jobs
from patchlens.streaming import jobs as st

OLD = "import x from 'x';\nfunction load(u) {\n  // note\n  const a = 1;\n  return fetch(u.id);\n}\n"
NEW = "import x from 'x';\nfunction load(u) {\n  // note\n  const a = 1;\n  if (!u) return null;\n  return fetch(u.id);\n}\n"
PATCH = "@@ -3,4 +3,5 @@ function load(u) {\n   // note\n   const a = 1;\n+  if (!u) return null;\n   return fetch(u.id);\n }"
COMMITS = ("repository string, position int, sha string, message string, parents array<struct<sha:string>>, "
           "files array<struct<filename:string,additions:int,deletions:int,patch:string>>")


def commit(repo, at, message="fix: null user", patch=PATCH, name="src/api/load.ts", parents=("p",)):
    return (repo, at, f"{repo}-{at}", message, [(f"{repo}-{at}-{p}",) for p in parents], [(name, 1, 0, patch)])


@pytest.fixture(scope="module")
def log(spark):
    rows = [commit("ann/app", i) for i in range(6)] + [
        commit("google/app", 1), commit("bob/app", 1, "docs: null"), commit("bob/app", 2, parents=()),
        commit("bob/app", 3, name="src/a.py"), commit("eve/app", 1, patch="@@ -1,9 +1,1 @@\n-a")]
    commits = spark.createDataFrame(rows, COMMITS)
    texts = [(r[0], ref, r[5][0][0], text) for r in rows
             for ref, text in ([(r[4][0][0], OLD)] if r[4] else []) + [(r[2], NEW)]]
    return commits, spark.createDataFrame(texts, "repository string, ref string, path string, content string")


def test_mine_pairs(spark, log):
    rows = jobs.mine_pairs(*log, jobs.RuleScorer()).collect()
    assert [r["repository"] for r in rows] == ["ann/app"] * 4  # five fix commits, four per repository
    r = rows[0]
    assert r["language"] == "typescript" and "note" not in r["buggy_code"]
    assert r["buggy_code"].startswith("function load") and "return null" in r["fixed_code"]
    # a bare guard matches no step of the ladder, so the fallback names it
    assert r["bug_type"] == "logic_error" and r["affected_component"] == "backend"
    assert len(r["buggy_ast_vector"].split(",")) == 64


def test_mine_pairs_honours_prior_output(spark, log):
    past = spark.createDataFrame([("ann/app", "ann/app-0", "null_pointer"), ("ann/app", "z", "null_pointer")],
                                 "repository string, commit_hash string, bug_type string")
    rows = jobs.mine_pairs(*log, jobs.RuleScorer(), existing=past).collect()
    assert len(rows) == 2 and "ann/app-0" not in {r["commit_hash"] for r in rows}


def test_other_miners(spark, log):
    heuristic = jobs.mine_pairs_heuristic(log[0]).collect()
    assert len(heuristic) == 4 and {r["bug_type"] for r in heuristic} <= set(mining.L.APPROVED_TYPES)
    diverse = jobs.mine_pairs_diverse(log[0]).collect()
    assert len(diverse) == 2 and diverse[0]["bug_type"] == "null_pointer"
    assert "if (!u)" in diverse[0]["fixed_code"] and "if (!u)" not in diverse[0]["buggy_code"]


def test_scan_files(spark):
    files = spark.createDataFrame([
        (1, "src/a.js", "for (let i = 0; i <= x.length; i++) {\n a(i);\n}"), (1, "dist/b.js", "x"),
        (1, "src/c.js", "const c = 1;"), (2, "src/d.js", "const q = 5;"),
        (2, "src/blank.js", "")], "scan_id int, path string, content string")
    refs = spark.createDataFrame([(1, "c1", "off_by_one", "Major", "for (let i = 0; i <= y.length; i++) {}"),
                                  (2, "c2", "async_error", "Major", "await fetch(x)")],
                                 "pair_id long, commit_id string, bug_type string, severity string, buggy_code_chunk string")
    scan = jobs.scan_files(files, refs, small_scans=False)
    led = {r["file_path"]: r for r in scan.ledger.collect()}
    assert set(led) == {"src/a.js", "src/c.js", "src/d.js"} and led["src/a.js"]["suspicious"]
    assert led["src/a.js"]["matched_historical_twin"] == "c1"
    found = scan.findings.collect()
    assert [(r["file_path"], r["severity_level"]) for r in found if r["file_path"] == "src/a.js"] == [("src/a.js", "Critical")]
    assert {r["file_path"]: r["is_buggy"] for r in scan.files.collect()}["src/a.js"]
    total = {r["scan_id"]: r["methods_analyzed"] for r in scan.summary.collect()}
    assert total == {1: 2, 2: 1}
    assert {r["scan_id"]: r["files_scanned"] for r in scan.summary.collect()} == {1: 2, 2: 2}
    documents = {r["file_path"]: json.loads(r["document"]) for r in scan.documents().collect()}
    assert set(documents) == {"src/a.js", "src/c.js", "src/d.js", "src/blank.js"}
    assert documents["src/a.js"]["findings_list"] and documents["src/a.js"]["ledger"][0]["suspicious"]
    assert documents["src/blank.js"]["method_count"] == 0 and documents["src/blank.js"]["totals"]["files_scanned"] == 2


def test_fallback_scorer_fills_what_the_first_left(spark):
    c = spark.createDataFrame([(1, "a", "await a", "m", "x.js", ["logic_error"]), (2, "b", "await b", "m", "x.js", ["logic_error"])],
                              "id long, buggy_code string, fixed_code string, message string, file_path string, candidates array<string>")
    answers = spark.createDataFrame([(1, '{"decision":"accept","bug_type":"type_error","confidence":0.9}'), (2, "broken")],
                                    "id long, response string")
    rows = jobs.FallbackScorer(jobs.AnswerScorer(answers, "id"), jobs.RuleScorer()).score(c).collect()
    assert {r["id"]: r["label"]["bug_type"] for r in rows} == {1: "type_error", 2: "async_error"}


def _log(spark, tmp_path):
    rows = spark.range(400).select(
        (F.col("id") % 5).alias("scan_id"), (F.col("id") % 7).cast("int").alias("step"),
        F.timestamp_seconds(F.col("id") * 3).alias("ts"), "id",
        F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("c"),
        F.concat(F.lit("r"), (F.col("id") % 11).cast("string")).alias("r"))
    for i in range(4):
        rows.where(F.col("id").between(i * 100, i * 100 + 99)).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def test_streams_equal_their_batch_twins(spark, tmp_path):
    rows, stream = _log(spark, tmp_path)
    got = st.upsert_updates(st.progress_updates(stream), ["scan_id", "step"], "p").collect()
    want = report.step_feed(rows).collect()
    assert {(r["scan_id"], r["step"], r["id"]) for r in got} == {(r["scan_id"], r["step"], r["id"]) for r in want}

    history = spark.createDataFrame([("r1",), ("r2",)], "r string")
    seen = st.run_batches(st.skip_seen(stream.select("r", "ts"), "r", history), lambda b, n: b, "s").collect()
    assert sorted(r["r"] for r in seen) == sorted({f"r{i}" for i in range(11)} - {"r1", "r2"})

    caps = {"c0": 3, "c1": 9}
    kept = st.run_caps(stream, "c", "r", ["ts", "id"], caps, 2, 4, "caps")
    by_c = {r["c"]: r["n"] for r in kept.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert by_c == {"c0": 3, "c1": 9, "c2": 2}
    assert kept.groupBy("r").count().agg(F.max("count")).first()[0] <= 4


@pytest.mark.parametrize("files", [1, 3])
def test_a_streamed_table_is_a_file_or_a_folder(spark, tmp_path, files):
    rows = spark.range(90).withColumn("x", F.col("id") * 2).repartition(files)
    rows.write.parquet(f"{tmp_path}/made")
    (tmp_path / "in").mkdir()
    parts = sorted((tmp_path / "made").glob("*.parquet"))
    if files == 1:
        parts[0].rename(tmp_path / "in" / "t.parquet")
    else:
        (tmp_path / "in" / "t.parquet").mkdir()
        for i, p in enumerate(parts):
            p.rename(tmp_path / "in" / "t.parquet" / f"part-{i}.parquet")
    spark.range(7).write.parquet(f"{tmp_path}/in/other.parquet")  # a folder beside it, which is not read
    got = st.run_batches(st.read_stream(spark, f"{tmp_path}/in", "t.parquet"), lambda b, n: b, "t").select("id", "x").collect()
    assert sorted(map(tuple, got)) == [(i, 2 * i) for i in range(90)]


def test_replayed_batch_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    for number in (0, 1, 1):  # batch 1 arrives twice
        spark.range(number * 10, number * 10 + 10).write.mode("overwrite").parquet(f"{out}/batch={number}")
    assert spark.read.parquet(out).count() == 20
    assert st.stored_before(spark, out, 1).count() == 10
