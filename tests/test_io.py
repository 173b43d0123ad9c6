import gzip
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from patchlens.operators import report
from patchlens.sources import json_arrays, readers, sinks
from patchlens.session import settle, shared_dir


@pytest.fixture
def folder_(tmp_path):
    return str(tmp_path)


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_pairs_json_aliases_and_missing_ids(spark, folder_):
    rows = [{"pair_id": 7, "buggy_code_chunk": "a", "fixed_code_chunk": "b", "ast_vector_120d": [1.0] * 70},
            {"id": 9, "buggy_code": "c", "fixed_code": "d", "ast_vector": [2.0]},
            {"buggy_code": "e", "fixed_code": "f"}, {"buggy_code": "g", "fixed_code": "h"}]
    write(f"{folder_}/p/pairs.json", json.dumps(rows))
    got = {r["pair_id"]: r for r in readers.read_pairs_json(spark, f"{folder_}/p").collect()}
    assert sorted(got) == [7, 9, 10, 11]
    assert all(len(r["ast_vector"]) == 64 for r in got.values())
    assert got[9]["buggy_code_chunk"] == "c" and got[9]["ast_vector"][:2] == [2.0, 0.0]
    assert {got[10]["buggy_code_chunk"], got[11]["buggy_code_chunk"]} == {"e", "g"}


TRICKY = ['a "quoted" word', "back\\\\slash\\", '\\\\"', "[{", "}]", '","id":5},{"id":6', "é 日本 \u2028", "", "x" * 3000,
          "{\"a\": [1, {\"b\": \"\\\\\\\"\"}]}"]


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1000, 1 << 20])
def test_array_by_byte_ranges_equals_the_whole_read(spark, folder_, size):
    """Strings with brackets, quotes and runs of backslashes, cut anywhere; one indented file, one compact, one object."""
    rows = [{"id": i, "t": t, "in": {"l": [{"s": t}, {"s": "]"}]}, "n": None} for i, t in enumerate(TRICKY)]
    if size < 7:
        rows = [r for r in rows if len(r["t"]) < 12]  # a task a few bytes
        write(f"{folder_}/j/a.json", json.dumps(rows[:2]))
    else:
        write(f"{folder_}/j/a.json", json.dumps(rows, ensure_ascii=False))
        write(f"{folder_}/j/b.json", "\ufeff \n" + json.dumps(rows * 3, indent=3))
        write(f"{folder_}/j/c.json", json.dumps({"id": 77, "t": "alone", "in": {"l": [{"s": "{"}]}}))
        write(f"{folder_}/j/d.json", "[]")
        write(f"{folder_}/j/e.json", "")
    schema = "id long, t string, `in` struct<l: array<struct<s: string>>>, n string"
    if size == 7:
        for name in "bd":
            write(f"{folder_}/j/{name}.json", "[]")
    want = [r for r in spark.read.schema(schema).json(f"{folder_}/j", multiLine=True).collect() if r.id is not None]
    got = json_arrays.read_json_array(spark, f"{folder_}/j", schema, size)
    assert sorted(map(str, got.collect())) == sorted(map(str, want))


def test_states_of_cut_strings():
    """Walking pieces one after the other is walking the whole, wherever it is cut."""
    text = json.dumps([{"t": t, "l": [t]} for t in TRICKY if len(t) < 50]).encode()
    whole = list(json_arrays.Walk(text, json_arrays.OUTSIDE))
    for cut in range(len(text)):
        one = json_arrays.Walk(text[:cut], json_arrays.OUTSIDE)
        first = list(one)
        two = json_arrays.Walk(text[cut:], one.state)
        assert first + [(at + cut, mark) for at, mark in two] == whole and two.state == json_arrays.OUTSIDE


def test_array_is_read_by_several_tasks_and_not_compressed(spark, folder_):
    write(f"{folder_}/k/a.json", json.dumps([{"id": i} for i in range(2000)]))
    got = json_arrays.read_json_array(spark, f"{folder_}/k", "id long", 2000)
    tasks = got.select("id", F.spark_partition_id().alias("p")).collect()
    assert sorted(r.id for r in tasks) == list(range(2000)) and len({r.p for r in tasks}) > 4
    os.makedirs(f"{folder_}/z")
    with gzip.open(f"{folder_}/z/a.json", "wb") as f:
        f.write(b'[{"id": 1}]')
    with pytest.raises(Exception, match="compressed"):
        json_arrays.read_json_array(spark, f"{folder_}/z", "id long").collect()


def test_samples_csv_round_trip_with_line_breaks(spark, folder_):
    rows = spark.createDataFrame([(1, 1, 1, 'a "quoted"\nline', "x,y")],
                                 "sample_id long, pair_id long, is_bug int, label_name string, code string")
    full = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
                         for f in readers.SAMPLES_CSV])
    sinks.append_records(full, f"{folder_}/c", "csv")
    got = readers.read_samples_csv(spark, f"{folder_}/c").first()
    assert got["label_name"] == 'a "quoted"\nline' and got["code"] == "x,y" and got["is_bug"] == 1


def test_malformed_lines_are_left_out(spark, folder_):
    write(f"{folder_}/m/a.csv", "a,b\n1,2\nx,y,z,1\n3,4\n")
    got = readers.read_samples_csv(spark, f"{folder_}/m", "a int, b int").collect()
    assert [tuple(r) for r in got] == [(1, 2), (3, 4)]


def test_source_tree(spark, folder_):
    for path in ("src/a.js", "src/b.py", "node_modules/x/c.js", "src/dist/d.ts", "web/e.mjs"):
        write(f"{folder_}/t/{path}", f"// {path} é")
    got = {r["path"]: r["content"] for r in readers.read_source_tree(spark, f"{folder_}/t").collect()}
    assert got == {"src/a.js": "// src/a.js é", "web/e.mjs": "// web/e.mjs é"}


def test_zip_tree_refuses_paths_out_of_the_root(spark, folder_):
    with zipfile.ZipFile(f"{folder_}/x.zip", "w") as z:
        z.writestr("a/b.js", "ok")
        z.writestr("../evil.js", "no")
        z.writestr("/abs.js", "no")
        z.writestr("c.txt", "no")
    got = readers.read_zip_tree(spark, f"{folder_}/x.zip").collect()
    assert [(r["path"], r["content"], r["size"]) for r in got] == [("a/b.js", "ok", 2)]


def test_commit_log(spark, folder_):
    rows = [{"repository": "a/b", "position": 1, "sha": "s1", "message": "fix", "parents": [{"sha": "p1"}],
             "files": [{"filename": "x.js", "additions": 1, "deletions": 2, "patch": "@@"}, {"filename": "y.js"}]},
            {"repository": "a/b", "position": 2, "sha": "s2", "message": "fix", "parents": [], "files": []}]
    write(f"{folder_}/l/log.json", "\n".join(map(json.dumps, rows)))
    got = readers.commit_files(readers.read_commit_log(spark, f"{folder_}/l")).collect()
    assert [(r["commit_hash"], r["parent_sha"], r["filename"]) for r in got] == [("s1", "p1", "x.js"), ("s1", "p1", "y.js")]


def test_seed_twice_adds_nothing(spark, folder_):
    rows = spark.range(5).withColumnRenamed("id", "pair_id")
    assert sinks.seed_if_empty(rows, f"{folder_}/s", "pair_id").count() == 5
    assert sinks.seed_if_empty(rows.union(spark.range(9, 10).toDF("pair_id")), f"{folder_}/s", "pair_id").count() == 6


def test_index_counts_rows_it_wrote(spark, folder_):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, []), (3, None)], "pair_id long, v array<double>")
    assert sinks.write_vector_index(rows, f"{folder_}/i", "pair_id", "v", 4) == 1
    got = spark.read.parquet(f"{folder_}/i").first()
    assert got["v"] == [0.6, 0.8, 0.0, 0.0]
    index = sinks.read_vector_index(spark, f"{folder_}/i")
    assert [(r["id"], r["cell"]) for r in index.rows.collect()] == [(1, 0)] and index.bounds.centres.tolist() == [[0.6, 0.8, 0.0, 0.0]]


def test_resume_enriches_each_row_once(spark, folder_):
    path = f"{folder_}/r"
    first = sinks.enrich_resume(spark.range(3), path, "id", lambda d: d.withColumn("run", F.lit(1)))
    assert first.count() == 3
    second = sinks.enrich_resume(spark.range(5), path, "id", lambda d: d.withColumn("run", F.lit(2)))
    assert sorted((r["id"], r["run"]) for r in second.collect()) == [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2)]


def test_metrics(spark, folder_):
    d = spark.createDataFrame([("m", 0.5, 0.25)], "model string, accuracy double, f1 double")
    sinks.write_metrics(d, f"{folder_}/k")
    got = {(r["model"], r["metric"], r["value"]) for r in spark.read.json(f"{folder_}/k").collect()}
    assert got == {("m", "accuracy", 0.5), ("m", "f1", 0.25)}


def test_scan_documents_split_hot_scans(spark):
    d = spark.range(95).select(F.when(F.col("id") < 90, 1).otherwise(2).alias("scan_id"), "id")
    d = d.withColumn("file", F.col("id") % 5)
    docs = sinks.scan_documents(d, "scan_id", "file", "id").collect()
    ids = [x["id"] for r in docs for x in json.loads(r["document"])]
    assert sorted(ids) == list(range(95)) and len([r for r in docs if r["scan_id"] == 1]) == 5
    assert {r["rows_total"] for r in docs if r["scan_id"] == 2} == {5}


def test_settle_writes_to_the_shared_folder(spark):
    before = set(os.listdir(shared_dir(spark)))
    assert settle(spark.range(4), "kept").count() == 4
    new = set(os.listdir(shared_dir(spark))) - before
    assert len(new) == 1 and new.pop().startswith("kept-")


def test_keyed_table_replaces_touched_buckets_only(spark, folder_):
    path, newest = f"{folder_}/t", [F.col("version").desc(), F.col("v")]

    def rows(*values):
        return spark.createDataFrame(values, "k long, version int, v string")

    def stored(version=None):
        return {(r["k"], r["version"], r["v"]) for r in sinks.read_keyed_table(spark, path, version).collect()}

    assert sinks.upsert_keyed_table(rows(*[(k, 1, "old") for k in range(50)]), path, "k", newest, 8) == 1
    first = sinks._listing(spark, path, 1)[1]
    assert sinks.upsert_keyed_table(rows((3, 2, "new"), (3, 0, "late"), (99, 1, "x"), (None, 1, "n"), (7, 0, "late")), path, "k", newest) == 2
    second = sinks._listing(spark, path, 2)[1]
    want = {(k, 1, "old") for k in range(50) if k != 3} | {(3, 2, "new"), (99, 1, "x"), (None, 1, "n")}
    assert stored() == want and stored(1) == {(k, 1, "old") for k in range(50)}
    changed = {b for b in second if second[b] != first.get(b)}
    assert changed == {r[0] for r in rows((3, 2, ""), (99, 1, ""), (None, 1, ""), (7, 0, "")).select(
        F.pmod(F.xxhash64("k"), F.lit(8))).collect()} and len(changed) < 8
    assert sinks.upsert_keyed_table(rows(), path, "k", newest) == 2 and sinks.upsert_keyed_table(rows(), f"{path}2", "k", newest) == 0
    more = rows((3, 3, "more")).withColumn("extra", F.lit(1))
    assert sinks.upsert_keyed_table(more, path, "k", newest) == 3
    got = sinks.read_keyed_table(spark, path)
    assert got.where("k = 3").first()["extra"] == 1 and got.where("k = 5").first()["extra"] is None
    sinks.expire_versions(spark, path)
    assert sinks.table_versions(spark, path) == [3] and got.count() == 52


def test_a_failed_upsert_leaves_the_version_before(spark, folder_):
    path = f"{folder_}/t"
    good = spark.range(5).selectExpr("id AS k", "1 AS version")
    sinks.upsert_keyed_table(good, path, "k", [F.col("version").desc()], 4)
    bad = spark.range(5).selectExpr("id AS k", "assert_true(id < 3) IS NULL AS ok", "2 AS version")
    with pytest.raises(Exception):
        sinks.upsert_keyed_table(bad, path, "k", [F.col("version").desc()])
    assert sinks.table_versions(spark, path) == [1]
    assert {r["version"] for r in sinks.read_keyed_table(spark, path).collect()} == {1}


def test_a_stored_scan_reads_its_bucket_only(spark, folder_):
    rows = spark.range(2000).selectExpr("if(id % 3 = 0, 5, id % 40) AS scan_id", "id AS method_id")
    sinks.write_scans(rows, f"{folder_}/s")
    sinks.write_scans(rows.selectExpr("scan_id", "method_id + 5000 AS method_id"), f"{folder_}/s")
    stored = spark.read.parquet(f"{folder_}/s")
    got = report.get_scan(stored, 5)
    assert got.columns == ["scan_id", "method_id"] and got.count() == 2 * rows.where("scan_id = 5").count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scan_bucket" in plan
    assert report.get_scan(rows, 5).count() == rows.where("scan_id = 5").count()


def test_small_ranges_share_tasks(spark, tmp_path):
    from pyspark.sql import types as T

    from patchlens.sources.json_arrays import read_json_array
    (tmp_path / "a.json").write_text("[" + ",".join('{"id": %d, "t": "}\\"{"}' % i for i in range(300)) + "]")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])
    got = read_json_array(spark, str(tmp_path), schema, split_bytes=64)
    assert sorted(r["id"] for r in got.collect()) == list(range(300))
    assert got.rdd.getNumPartitions() <= 4  # not one task for each of a hundred ranges
