"""Admission in arrival order against a plain loop, in one table and over a stream."""
import random

import pytest

from patchlens.operators import mining, splits
from patchlens.session import new_table_path
from patchlens.streaming import jobs as st


def loop(rows, caps, most, default=0, had_c=None, had_r=None, target=None):
    in_c, in_r, out = dict(had_c or {}), dict(had_r or {}), []
    for i, r, c in sorted(rows):
        if target is not None and len(out) >= target:
            break
        if in_c.get(c, 0) < caps.get(c, default) and in_r.get(r, 0) < most:
            in_c[c], in_r[r] = in_c.get(c, 0) + 1, in_r.get(r, 0) + 1
            out.append(i)
    return out


def events(spark, rows):
    return spark.createDataFrame(rows, "id long, r string, c string")


@pytest.mark.parametrize("seed", [0, 3])
def test_rounds_equal_the_row_by_row_rule(spark, seed):
    rng = random.Random(seed)
    repos, cats = rng.choice([3, 40]), rng.choice([2, 7])
    rows = [(i, f"r{rng.randrange(repos)}" if rng.random() > 0.35 else rng.choice(["r0", None]),
             f"c{rng.randrange(cats)}" if rng.random() > 0.35 else rng.choice(["c0", None])) for i in range(rng.choice([60, 900]))]
    rng.shuffle(rows)
    caps = {f"c{k}": rng.randrange(0, 25) for k in range(cats)}
    most, default = rng.choice([1, 3]), rng.choice([0, 4])
    df = events(spark, rows).repartition(7)
    got = mining.cap_per_group_greedy(df, "c", "r", ["id"], caps, most, default)
    assert got.columns == df.columns and sorted(r["id"] for r in got.collect()) == loop(rows, caps, most, default)
    had_c, had_r, target = {"c0": 3, "c1": 99}, {"r0": 1, "r1": 5}, 11
    got = mining.cap_per_group_greedy(
        df, "c", "r", ["id"], caps, most, default, spark.createDataFrame(list(had_r.items()), "r string, n long"),
        spark.createDataFrame(list(had_c.items()), "c string, n long"), target)
    assert sorted(r["id"] for r in got.collect()) == loop(rows, caps, most, default, had_c, had_r, target)


def test_no_group_holds_all_rows(spark):
    rows = [(i, f"r{i % 50}", "c0") for i in range(500)]
    plan = mining.cap_per_group_greedy(events(spark, rows), "c", "r", ["id"], {"c0": 30}, 2)
    assert len(plan.collect()) == 30
    assert mining.cap_per_group_greedy(events(spark, rows).where("id < 0"), "c", "r", ["id"], {"c0": 30}, 2).count() == 0


def test_a_chain_of_dependent_rows(spark):
    """Each row waits for the one before it: the longest number of rounds, and the same result."""
    rows, k = [], 5
    for i in range(k):
        rows += [(2 * i, f"r{i}", f"c{i}"), (2 * i + 1, f"r{i + 1}", f"c{i}")]
    caps = {f"c{i}": 1 for i in range(k)}
    got = mining.cap_per_group_greedy(events(spark, rows), "c", "r", ["id"], caps, 1)
    assert sorted(r["id"] for r in got.collect()) == loop(rows, caps, 1)


def two_filters(batches, caps, most, default):
    """The stream's rule: repositories first, categories second, inside a batch in order."""
    in_r, in_c, out = {}, {}, []
    for batch in batches:
        passed = []
        for i, r, c in sorted(batch):
            if in_r.get(r, 0) < most:
                in_r[r] = in_r.get(r, 0) + 1
                passed.append((i, r, c))
        for i, r, c in passed:
            if in_c.get(c, 0) < caps.get(c, default):
                in_c[c] = in_c.get(c, 0) + 1
                out.append(i)
    return sorted(out)


def test_running_caps_go_on_after_a_restart(spark, tmp_path):
    rng = random.Random(7)
    batches = [[(b * 1000 + i, f"r{0 if rng.random() < .4 else rng.randrange(15)}", f"c{0 if rng.random() < .4 else rng.randrange(3)}")
                for i in range(120)] for b in range(3)]
    caps, most, default = {"c0": 9, "c1": 4}, 3, 6
    source, out, state = f"{tmp_path}/in", new_table_path(spark, "caps"), new_table_path(spark, "caps-state")
    for n, batch in enumerate(batches, 1):
        events(spark, batch).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, r string, c string").parquet(source)
        rows = st.run_caps(stream, "c", "r", ["id"], caps, default, most, "caps", out, state)  # a new query each time
        assert sorted(r["id"] for r in rows.collect()) == two_filters(batches[:n], caps, most, default)


def test_state_is_one_row_a_group(spark, tmp_path):
    rows = [(i, f"r{i % 20}", f"c{i % 4}") for i in range(400)]
    events(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    st.use_rocksdb(spark)
    stream = spark.readStream.schema("id long, r string, c string").parquet(f"{tmp_path}/in")
    admitted = st.running_caps(stream, "c", "r", ["id"], {}, 5, 2)
    query = st.write_batches(admitted, lambda batch, n: batch, f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    assert sorted(st.state_rows(query)) == [4, 20]
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20


# known repositories and folds


def test_known_repositories(spark):
    rng = random.Random(2)
    known = [(i, rng.choice([None, "ab", "repo", "x/y", f"name{i}", "http", "zzz", "q"]), rng.choice([None, f"http://h/{i}"]))
             for i in rng.sample(range(500), 60)]
    urls = [(i, rng.choice([None, "", "http://h/3", f"http://g/name{rng.randrange(500)}/x", "ftp://repo/x/y", f"h/{i}",
                            f"http://h/{rng.randrange(500)}"])) for i in range(200)]

    def first(u):
        return next((n for _, n, k in sorted(known, key=lambda x: x[0]) if n is not None and (u == k or n in u)), None)

    def got(known):
        return {r["id"]: r["known_repo"] for r in mining.match_known_repos(
            spark.createDataFrame(urls, "id long, url string"), spark.createDataFrame(
                known, "position long, name string, url string")).collect()}

    assert got(known) == {i: None if u is None else first(u) for i, u in urls}
    known.append((250, "", None))
    assert got(known) == {i: None if u is None else first(u) for i, u in urls}
    assert set(got([]).values()) == {None}


def test_many_known_repositories_meet_few_urls(spark):
    known = spark.range(100_000).selectExpr("id AS position", "concat('owner', id, '/repo') AS name", "CAST(NULL AS STRING) AS url")
    urls = spark.range(300).selectExpr("id", "concat('https://host/owner', id * 997, '/repo.git') AS url")
    rows = mining.match_known_repos(urls, known).collect()
    assert all(r["known_repo"] == (f"owner{r['id'] * 997}/repo" if r["id"] * 997 < 100_000 else None) for r in rows)


def test_grams_of_urls_are_not_broadcast(spark):
    known = spark.range(50).selectExpr("id AS position", "concat('name', id) AS name", "CAST(NULL AS STRING) AS url")
    urls = spark.range(50).selectExpr("id", "concat('https://host/name', id, '/x') AS url")
    plan = mining.match_known_repos(urls, known)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join [gram" in x and "Contains(" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


def greedy_folds(sizes, folds):
    loads, out = [0] * folds, {}
    for n, g in sorted(((n, g) for g, n in sizes.items()), key=lambda x: (-x[0], x[1])):
        f = loads.index(min(loads))
        loads[f] += n
        out[g] = f
    return out


@pytest.mark.parametrize("seed", range(6))
def test_segments_deal_as_the_greedy_rule(seed):
    rng = random.Random(seed)
    folds, sizes = rng.choice([1, 2, 5, 7]), {g: rng.choice([1, 1, 1, 2, 5, rng.randrange(1, 400)]) for g in range(rng.choice([3, 400]))}
    want, place, histogram = greedy_folds(sizes, folds), {}, {}
    for g in sorted(sizes):
        histogram.setdefault(sizes[g], []).append(g)
    for size, first, last, turn in splits.fold_segments(sorted(((n, len(g)) for n, g in histogram.items()), reverse=True), folds):
        for rank in range(first, last + 1):
            place[histogram[size][rank - 1]] = turn[(rank - first) % len(turn)]
    assert place == want


def test_folds_of_whole_groups(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 0, rng.randrange(60), None])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g long")
    got = {r["id"]: r["fold"] for r in splits.group_kfold(df, "g", 4).collect()}
    sizes = {}
    for _, g in rows:
        sizes[-1 if g is None else g] = sizes.get(-1 if g is None else g, 0) + 1
    want = greedy_folds(sizes, 4)
    assert got == {i: want[-1 if g is None else g] for i, g in rows}
