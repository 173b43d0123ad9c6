"""Queries of the composite jobs, the streams and the models."""
from __future__ import annotations

from pyspark.sql import functions as F

from patchlens.functions import labels as lx
from patchlens.functions import text as fx
from patchlens.functions import vectors as vx
from patchlens.operators import evaluate, models, retrieval, tfidf
from patchlens.plans import bindings as B
from patchlens.plans import jobs
from patchlens.plans.bindings import PAIRS, PATHS, SNIPPETS, STEPS, quote, sql_any, sql_trim
from patchlens.plans.registry import query
from patchlens.plans.table_queries import (
    FEEDS, HYBRID_CTE, _CAPS, _refs, epairs, feeds, grams_cte, ranked, vocabulary_cte,
)
from patchlens.plans.text_queries import (
    DESCRIBE_SQL, FILE_ROLE_SQL, RELABEL_CTE, _BASE, _DIRS, _EXT, _ladder, condition_sql,
)
from patchlens.rules import ladders as R
from patchlens.rules import lexicon as L
from patchlens.session import new_table_path
from patchlens.sources import json_arrays, readers, sinks
from patchlens.streaming import jobs as st

LONG = "long"


# --- composite jobs ----------------------------------------------------------------------------------

@query("enrich_pairs", f"""WITH {RELABEL_CTE} SELECT pair_id, new_label AS bug_type,
{DESCRIBE_SQL} AS bug_description, {_ladder(
    [(sql_any('lower(file_path)', w), quote(n)) for n, w in L.COMPONENT_WORDS],
    f"CASE WHEN {sql_any('lower(repository)', ['server', 'nest'])} THEN 'backend' ELSE 'unknown' END")}
AS affected_component, new_severity AS severity, conf AS confidence_score FROM relabelled""")
def _(t):
    p = t.pairs().withColumnsRenamed({"before": "buggy_code", "after": "fixed_code",
                                      "message": "original_commit_message"})
    return jobs.enrich_pairs(p).select("pair_id", "bug_type", "bug_description", "affected_component",
                                       "severity", "confidence_score")


@query("read_pairs_json", f"""WITH {PAIRS} SELECT pair_id, before AS buggy_code_chunk,
after AS fixed_code_chunk, message AS commit_message, 0.9::DOUBLE AS label_confidence,
64::BIGINT AS width FROM pairs""")
def _(t):
    p = t.pairs().select("pair_id", F.col("before").alias("buggy_code"), F.col("after").alias("fixed_code_chunk"),
                         F.col("message").alias("commit_message"), F.array(F.lit(1.0)).alias("ast_vector"))
    path = new_table_path(p.sparkSession, "pairs")
    json_arrays.write_json_arrays(p, path)
    got = readers.read_pairs_json(p.sparkSession, path, split_bytes=1 << 16)
    return got.select("pair_id", "buggy_code_chunk", "fixed_code_chunk", "commit_message", "label_confidence",
                      F.size("ast_vector").cast(LONG).alias("width"))


@query("clean_revectorise", f"""WITH {PAIRS}, ok AS (SELECT *, row_number() OVER (PARTITION BY before, bug_type
ORDER BY pair_id) AS rn FROM pairs WHERE before IS NOT NULL
AND {sql_trim('before')} <> {sql_trim('after')} AND length(before) >= 20)
SELECT pair_id, 120::BIGINT AS width, 1.0::DOUBLE AS total FROM ok WHERE rn = 1""")
def _(t):
    p = t.pairs().withColumnsRenamed({"before": "buggy_code", "after": "fixed_code"})
    c = jobs.clean_revectorise(p, "pair_id", 20)
    v = F.from_json("buggy_ast_vector", "array<double>")
    return c.select("pair_id", F.size(v).cast(LONG).alias("width"),
                    F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def _commits(t):
    """Commit log with one changed file per pair: a function whose body changes."""
    def body(c):
        return F.translate(F.col(c), "{}'\"`/\\", "")

    def lines(c):
        return F.size(F.split(F.col(c), "\n"))

    def marked(c, m):
        return F.concat(F.lit(m), F.replace(F.col(c), F.lit("\n"), F.lit("\n" + m)))

    p = t.pairs().where("before IS NOT NULL").withColumns({"b": body("before"), "a": body("after")})
    head = F.format_string("function f%d(x) {", "turn")
    patch = F.concat(
        F.format_string("@@ -1,%d +1,%d @@\n ", lines("b") + 2, lines("a") + 2), head, F.lit("\n"),
        marked("b", "-"), F.lit("\n"), marked("a", "+"), F.lit("\n }"))
    whole = p.withColumns({
        "patch": patch, "old": F.concat(head, F.lit("\n"), "b", F.lit("\n}\n")),
        "new": F.concat(head, F.lit("\n"), "a", F.lit("\n}\n")),
        "parent": F.md5(F.concat("commit_hash", F.lit("p")))})
    commits = whole.select(
        "repository", F.col("pair_id").cast("int").alias("position"), F.col("commit_hash").alias("sha"),
        F.concat(F.lit("fix: "), F.col("bug_type")).alias("message"),
        F.array(F.struct(F.col("parent").alias("sha"))).alias("parents"),
        F.array(F.struct(F.col("file_path").alias("filename"), lines("a").alias("additions"),
                         lines("b").alias("deletions"), "patch")).alias("files"))
    files = whole.select("repository", F.col("parent").alias("ref"), F.col("file_path").alias("path"),
                         F.col("old").alias("content")).unionByName(
        whole.select("repository", F.col("commit_hash").alias("ref"), F.col("file_path").alias("path"),
                     F.col("new").alias("content")))
    return commits, files


@query("mine_pairs")
def _(t):
    commits, files = _commits(t)
    return jobs.mine_pairs(commits, files, jobs.RuleScorer()).drop("buggy_ast_vector", "fixed_ast_vector")


@query("mine_pairs_heuristic")
def _(t):
    return jobs.mine_pairs_heuristic(_commits(t)[0]).drop("buggy_ast_vector", "fixed_ast_vector")


@query("mine_pairs_diverse")
def _(t):
    return jobs.mine_pairs_diverse(_commits(t)[0])


@query("fallback_scorer")
def _(t):
    p = t.pairs().where("before IS NOT NULL").select(
        "pair_id", F.col("before").alias("buggy_code"), F.col("after").alias("fixed_code"), "message",
        "file_path", F.array("bug_type").alias("candidates"))
    answers = t.pairs().select("pair_id", F.when(F.col("pair_id") % 2 == 0, F.to_json(F.struct(
        F.lit("accept").alias("decision"), "bug_type", F.lit(0.9).alias("confidence")))).alias("response"))
    both = jobs.FallbackScorer(jobs.AnswerScorer(answers, "pair_id"), jobs.RuleScorer())
    return both.score(p).select("pair_id", "label.bug_type", "label.confidence")


def _scan(t):
    files = t.paths().select((F.col("page_id") % 20).alias("scan_id"), "path",
                             B.swap(F.col("html"), B.CODE_WORDS).alias("content"))
    refs = t.pairs().where("before IS NOT NULL").select(
        "pair_id", F.col("commit_hash").alias("commit_id"), "bug_type", "severity",
        F.col("before").alias("buggy_code_chunk"))
    return jobs.scan_files(files, refs)


@query("scan_files")
def _(t):
    return _scan(t).ledger


@query("scan_findings")
def _(t):
    return _scan(t).findings


@query("issue_report_job", f"""WITH {FEEDS}, {PATHS}, kept AS (SELECT path, {FILE_ROLE_SQL} AS role,
len(string_split(html, chr(10))) AS lines FROM paths WHERE ({_EXT}) IN ('js', 'jsx', 'ts', 'tsx')
AND NOT list_has_any({_DIRS}, [{', '.join(map(quote, L.IGNORED_DIRS))}])
AND NOT regexp_matches({_BASE}, {quote('(?i)' + '|'.join(f'(?:{p})' for p in L.IGNORED_NAMES))})),
c AS (SELECT file, count(*) AS n FROM issues GROUP BY 1)
SELECT coalesce(path, file) AS path, coalesce(role, 'config') AS role, coalesce(lines, 0)::BIGINT AS lines,
coalesce(n, 0) AS issue_count FROM kept FULL JOIN c ON path = file""")
def _(t):
    files = t.paths().select("path", F.col("html").alias("content"))
    return jobs.issue_report_job(files, feeds(t))[0].withColumn("lines", F.col("lines").cast(LONG))


@query("index_pairs", f"""WITH {PAIRS}, src AS (SELECT pair_id, before AS code FROM pairs
WHERE before IS NOT NULL), {grams_cte('src', 'pair_id', 'code', 'g')},
{vocabulary_cte('g', 'pair_id', 'src', 'v', 1500)} SELECT term, tf, df, round(idf, 6) AS idf FROM v""")
def _(t):
    p = t.pairs().where("before IS NOT NULL")
    sample = [p.select("pair_id", (F.col("pair_id") * 2 + 1 - bug).alias("sample_id"),
                       F.lit(bug).alias("is_bug"), F.col(c).alias("code"), F.lit("[1.0]").alias("ast_vector"))
              for bug, c in ((1, "before"), (0, "after"))]
    _, vocabulary, _ = jobs.index_pairs(sample[0].unionByName(sample[1]))
    return vocabulary.select("term", "tf", "df", F.round("idf", 6).alias("idf"))


# --- streams -----------------------------------------------------------------------------------------------

def _stream(t, name):
    return st.read_stream(t.spark, t.folder, f"{name}.parquet")


@query("stream_progress", f"""WITH {STEPS}, r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, step
ORDER BY ts, id) AS rn FROM steps) SELECT scan_id, step::BIGINT AS step, id FROM r WHERE rn = 1""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("int")
    log = _stream(t, "events").select(
        F.col("user_id").alias("scan_id"), (k % L.PROGRESS_STEPS + 1).alias("step"), "ts",
        F.col("event_id").alias("id"))
    updates = st.progress_updates(log, watermark="90 days")
    rows = st.upsert_updates(updates, ["scan_id", "step", "since"], "progress")
    return st.first_progress(rows).select("scan_id", F.col("step").cast(LONG).alias("step"), "id")


@query("stream_skip_seen", """SELECT DISTINCT user_id FROM events WHERE user_id NOT IN
(SELECT s_suppkey FROM supplier)""")
def _(t):
    known = t.supplier.select(F.col("s_suppkey").alias("user_id"))
    # users come back within ten years at most, so state of that span leaves none in twice
    fresh = st.skip_seen(_stream(t, "events").select("user_id", "ts"), "user_id", known, "ts", "3650 days")
    return st.run_batches(fresh, lambda batch, n: batch, "seen").select("user_id")


@query("stream_gate", f"""WITH {HYBRID_CTE} SELECT doc_id, matched_id, round(score, 5) AS score,
score >= 0.5 AS suspicious FROM scored""")
def _(t):
    refs = _refs(t)
    weights = tfidf.TermWeights.fit(refs.select(tfidf.word_grams(F.col("ref_code")).alias("grams")))
    arriving = _stream(t, "documents").select("doc_id", B.swap(F.col("text"), B.CODE_WORDS).alias("code"))
    step = st.gate_step(refs, weights, "doc_id", "pair_id", "code", "ref_code")
    rows = st.run_batches(arriving, step, "gate")
    return rows.select("doc_id", F.col("reference_id").alias("matched_id"),
                       F.round("score", 5).alias("score"), "suspicious")


_EF = {"text": "txt", "diff": "dif", "label": "''", "path": "''"}


@query("stream_enrich", f"""WITH {SNIPPETS}, i AS (SELECT doc_id, lower(lang || chr(10) || code || chr(10) || code) AS txt,
lower(code || ' -> ' || code) AS dif FROM snippets) SELECT doc_id, ({_ladder(
    [(condition_sql(c, _EF, _EF), str(n)) for n, c in enumerate(R.RELABEL_STEPS, 1)], '13')})::BIGINT AS step FROM i""")
def _(t):
    def enrich(batch):
        c = B.swap(F.col("text"), B.CODE_WORDS)
        return batch.select("doc_id", lx.relabel_step(c, c, F.col("lang"), F.lit(""), F.lit("")).alias("step"))

    rows = st.run_batches(_stream(t, "documents"), st.enrich_step(enrich), "enriched")
    return rows.select("doc_id", F.col("step").cast(LONG).alias("step"))


@query("stream_caps", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
AS rr FROM events), c AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS cr FROM r
WHERE rr <= 4) SELECT event_id FROM c JOIN {B.sql_values(list(_CAPS.items()) + [('purchase', 150)])} v(event_type, cap)
USING (event_type) WHERE cr <= cap""")
def _(t):
    return st.run_caps(_stream(t, "events"), "event_type", "user_id", ["ts", "event_id"], _CAPS,
                       150, 4, "caps").select("event_id")


# --- models -------------------------------------------------------------------------------------------------

def _embedded(t):
    rows = models.with_features(t.embeddings, "embedding").withColumn("label", F.col("label").cast("double"))
    return models.class_balance(rows, "label").select("vec_id", "label", "weight", "features")


def _scored(t, fit, positive=False):
    rows = _embedded(t) if not positive else models.class_balance(models.with_features(
        t.embeddings.withColumn("e", F.transform("embedding", lambda x: F.abs(x).cast("double"))), "e"
    ).withColumn("label", F.col("label").cast("double")), "label").select("vec_id", "label", "weight", "features")
    parts = models.group_split(rows, F.col("vec_id")).cache()
    model = fit(parts.where("NOT is_test"))
    return evaluate.class_report(model.transform(parts.where("is_test")))


@query("fit_linear")
def _(t):
    return _scored(t, lambda d: models.fit_linear(d, "logistic", iterations=30))


@query("fit_linear_svm")
def _(t):
    return _scored(t, lambda d: models.fit_linear(d, "svm", iterations=10))


@query("fit_forest")
def _(t):
    return _scored(t, lambda d: models.fit_forest(d, 20, 8))


@query("fit_extra_trees")
def _(t):
    return _scored(t, lambda d: models.fit_forest(d, 20, 8, True))


@query("fit_sgd")
def _(t):
    return _scored(t, lambda d: models.fit_linear(d, "sgd", iterations=10))


@query("fit_boosted")
def _(t):
    return _scored(t, lambda d: models.fit_boosted(d, 10, 3, 3))


@query("fit_mlp")
def _(t):
    return _scored(t, lambda d: models.fit_mlp(d, 64, 10, 30))


@query("fit_nb")
def _(t):
    return _scored(t, models.fit_nb, positive=True)


def _typed(t):
    texts = t.documents.select(F.col("doc_id").alias("vec_id"), "text", "source")
    e = epairs(t).join(texts, "vec_id")
    return e.select(F.col("vec_id").alias("pair_id"), F.concat(F.lit("type"), F.col("label").cast("string"))
                    .alias("bug_type"), B.pick(["low", "high"], F.col("vec_id")).alias("severity"),
                    F.col("x").alias("buggy_vector"), F.col("y").alias("fixed_vector"), "text", "source")


@query("train_type_model")
def _(t):
    return sinks.tall_metrics(models.train_type_model(
        _typed(t), terms=100, trees=10, rounds=2, depth=6, iterations=10).results)


@query("train_dual")
def _(t):
    out = models.train_dual(_typed(t), "pair_id", trees=10, depth=6, iterations=10)
    both = [sinks.tall_metrics(r.results).withColumn("target", F.lit(k)) for k, r in out.items()]
    return both[0].unionByName(both[1])


@query("train_hybrid")
def _(t):
    return sinks.tall_metrics(models.train_hybrid(
        _typed(t), "pair_id", "bug_type", "text", "buggy_vector").results)


@query("train_binary")
def _(t):
    # every labelled text; one without an embedding has zeros for it, as a vector that can't be read has
    embedding = F.coalesce(F.col("embedding").cast("array<double>"), vx.zeros(64)).alias("embedding")
    texts = t.snippets().select("doc_id", vx.token_vector64(F.col("code")).alias("tokens"))
    s = t.labels.join(texts, "doc_id").join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    s = s.select("doc_id", "quality", "tokens", embedding, (F.col("doc_id") % 97).alias("group"))
    return models.train_binary(s, "group", "quality", {
        "tokens": ["tokens"], "vector": ["embedding"], "both": ["tokens", "embedding"]}, trees=10, rounds=3, depth=5,
        iterations=10)[1]


@query("train_pair_order")
def _(t):
    p = epairs(t).select("vec_id", "x", "y")
    return sinks.tall_metrics(models.train_pair_order(p, "vec_id", "x", "y", 10, 5, 20).results)


@query("predict_batch")
def _(t):
    rows = models.with_features(t.embeddings, "embedding").withColumn("label", F.col("label").cast("double"))
    model = models.fit_forest(rows, 10, 6, weight=None)
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return models.predict_batch(model, e, L.APPROVED_TYPES[:10], "v", ["vec_id"], pair_model=False)
