"""Queries of the vector, retrieval, audit, mining and report operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from patchlens.functions import text as fx
from patchlens.functions import vectors as vx
from patchlens.operators import (
    evaluate, mining, quality, report, reshape, retrieval, slicing, splits, tfidf,
)
from patchlens.plans import bindings as B
from patchlens.plans.bindings import (
    LEDGER, PAIRS, PATHS, SNIPPETS, STEPS, quote, sql_fold, sql_found, sql_pick, sql_times,
    sql_values,
)
from patchlens.plans.registry import query
from patchlens.plans.text_queries import defect_sql
from patchlens.rules import lexicon as L
from patchlens.rules.categories import TOPIC_HINTS
from patchlens.session import new_table_path
from patchlens.sources import sinks
from patchlens.streaming.jobs import score_methods

LONG = "long"

# --- vectors -------------------------------------------------------------------------------------

_WORDS = "regexp_extract_all(code, '[\\p{L}\\p{N}_]+')"


def _slots_sql(slots, size, extra):
    cells = []
    for i in range(size):
        if i in extra:
            cells.append(extra[i])
        elif i in slots:
            cells.append(sql_times("folded", slots[i][0]))
        else:
            cells.append("0")
    return "[" + ", ".join(f"({c})::DOUBLE" for c in cells) + "]"


_IDENTIFIERS = f"len([x for x in {_WORDS} if regexp_full_match(x, '[a-zA-Z_][a-zA-Z0-9_]*')])"
_FUNCTIONS = (f"CASE WHEN {sql_times('folded', chr(92) + 'bfunction' + chr(92) + 'b')} > 0 THEN "
              f"{sql_times('folded', chr(92) + 'bfunction' + chr(92) + 'b')} "
              "WHEN contains(code, '=>') THEN 1 ELSE 0 END")
_COUNTS64 = _slots_sql(vx.SLOTS_64, 62, {0: _FUNCTIONS, 57: "1", 47: _IDENTIFIERS})


def vectors_cte(source: str, key: str, name: str) -> str:
    """CTEs that give `name`(key, vec): the 64-slot vector of every code text."""
    return f"""{name}_f AS (SELECT {key}, code, {sql_fold('code')} AS folded FROM {source}),
{name}_c AS (SELECT {key}, {_COUNTS64} AS counts FROM {name}_f),
{name}_r AS (SELECT {key}, list_concat(counts, [ln(1 + list_sum(counts)), (2.0 / 30)::DOUBLE]) AS raw
FROM {name}_c),
{name} AS (SELECT {key}, [x / sqrt(list_dot_product(raw, raw)) for x in raw] AS vec FROM {name}_r)"""


@query("token_vector64", f"""WITH {SNIPPETS}, {vectors_cte('snippets', 'doc_id', 'v')}
SELECT doc_id, slot::BIGINT AS slot, round(vec[slot + 1], 6) AS value
FROM v, range(64) r(slot) WHERE vec[slot + 1] <> 0""")
def _(t):
    v = t.snippets().select("doc_id", F.posexplode(vx.token_vector64(F.col("code"))).alias("slot", "x"))
    return v.where("x <> 0").select("doc_id", F.col("slot").cast(LONG), F.round("x", 6).alias("value"))


# letters outside ASCII count as word characters for `\b`, but match none of the classes of these three slots
_MARKED = "regexp_replace(code, '[^\\x00-\\x7F]', chr(1), 'g')"
_WHOLE = "chr(1) || '[a-zA-Z0-9_' || chr(1) || ']*|[a-zA-Z0-9_]+' || chr(1) || '[a-zA-Z0-9_' || chr(1) || ']*'"
_CALLS = (f"regexp_replace(regexp_replace({_MARKED}, '(?:' || {_WHOLE} || ')\\$', 'a$', 'g'), {_WHOLE}, chr(1), 'g')")
_COUNTS120 = _slots_sql(vx.SLOTS_120, vx.BAG_SIZE, {
    0: "1", vx.BLOCK_SLOT: "len(string_split(code, chr(10)))", 18: sql_times(_CALLS, vx.SLOTS_120[18][0]),
    19: sql_times("code", vx.SLOTS_120[19][0]),
    89: sql_times(f"replace({_MARKED}, chr(1) || 'as', '__')", vx.SLOTS_120[89][0])})
_TAIL120 = ", ".join(f"bag[{i + 1}]" for i in vx.REPEATED_120)


@query("token_vector120", f"""WITH {SNIPPETS}, f AS (SELECT doc_id, code, {sql_fold('code')} AS folded FROM snippets),
c AS (SELECT doc_id, {_COUNTS120} AS bag, list_max([length(regexp_extract(x, '^\\s+'))
FOR x IN string_split(code, chr(10))]) // 2 + 1 AS depth FROM f WHERE regexp_matches(code, '\\S')),
r AS (SELECT doc_id, list_concat(bag, [list_sum(bag), depth::DOUBLE, depth / 2.0, {vx.SEEN_TYPES}::DOUBLE, {_TAIL120}]) AS raw FROM c)
SELECT doc_id, slot::BIGINT AS slot, round(raw[slot + 1] / list_sum(raw), 6) AS value
FROM r, range(120) s(slot) WHERE raw[slot + 1] <> 0""")
def _(t):
    v = t.snippets().select("doc_id", F.posexplode(vx.token_vector120(F.col("code"))).alias("slot", "x"))
    return v.where("x <> 0").select("doc_id", F.col("slot").cast(LONG), F.round("x", 6).alias("value"))


@query("fit_dim", """SELECT vec_id, i::BIGINT AS i, round(coalesce(embedding[i], 0)::DOUBLE, 6) + 0 AS x
FROM embeddings, range(1, 121) r(i)""")
def _(t):
    v = t.embeddings.select("vec_id", F.posexplode(vx.fit_dim(F.col("embedding"), 120)).alias("p", "x"))
    return v.select("vec_id", (F.col("p") + 1).cast(LONG).alias("i"), F.round("x", 6).alias("x"))


@query("l2_normalise", """SELECT vec_id, i::BIGINT AS i, round(embedding[i]::DOUBLE /
sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) + 0 AS x
FROM embeddings, range(1, 65) r(i)""")
def _(t):
    v = t.embeddings.select("vec_id", F.posexplode(vx.l2_normalise(F.col("embedding"))).alias("p", "x"))
    return v.select("vec_id", (F.col("p") + 1).cast(LONG).alias("i"), F.round("x", 6).alias("x"))


@query("parse_vector", """SELECT vec_id, round(CASE WHEN vec_id % 3 = 0 THEN 0.0
ELSE list_sum(embedding::DOUBLE[]) END, 6) AS total FROM embeddings""")
def _(t):
    v, e = F.col("vec_id"), F.col("embedding").cast("array<double>")
    text = (F.when(v % 6 == 0, "not a vector").when(v % 3 == 0, F.to_json(F.slice(e, 1, 63)))
            .otherwise(F.to_json(e)))
    p = t.embeddings.select("vec_id", vx.parse_vector(text, 64).alias("v"))
    return p.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


# two embeddings with neighbouring ids form a pair
EPAIRS = """epairs AS (SELECT a.vec_id, a.label, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def epairs(t):
    e = t.embeddings
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("y"))
    return e.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x")).join(nxt, "vec_id")


@query("delta_vector", f"""WITH {EPAIRS} SELECT vec_id, i::BIGINT AS i, round(y[i] - x[i], 6) + 0 AS d
FROM epairs, range(1, 65) r(i)""")
def _(t):
    d = epairs(t).select("vec_id", F.posexplode(vx.delta_vector(F.col("y"), F.col("x"))).alias("p", "d"))
    return d.select("vec_id", (F.col("p") + 1).cast(LONG).alias("i"), F.round("d", 6).alias("d"))


@query("concat_features", f"""WITH {EPAIRS} SELECT vec_id, i::BIGINT AS i,
round(list_concat(x, y)[i], 6) + 0 AS v FROM epairs, range(1, 129) r(i)""")
def _(t):
    d = epairs(t).select("vec_id", F.posexplode(vx.concat_features(F.col("x"), F.col("y"))).alias("p", "v"))
    return d.select("vec_id", (F.col("p") + 1).cast(LONG).alias("i"), F.round("v", 6).alias("v"))


@query("vector_stats", """SELECT vec_id, len(embedding)::BIGINT AS length,
len([x for x in embedding if x > 0])::BIGINT AS nonzero,
round(list_sum([round(x::DOUBLE, 4) for x in [greatest(x, 0) for x in embedding][1:8]]), 4) AS head
FROM embeddings""")
def _(t):
    v = F.transform("embedding", lambda x: F.greatest(x, F.lit(0.0)).cast("double"))
    s = t.embeddings.select("vec_id", vx.vector_stats(v).alias("s"))
    head = F.aggregate("s.head", F.lit(0.0), lambda a, x: a + x)
    return s.select("vec_id", F.col("s.length").cast(LONG).alias("length"),
                    F.col("s.nonzero").cast(LONG).alias("nonzero"), F.round(head, 4).alias("head"))


@query("nonzero_vector", f"""WITH {EPAIRS} SELECT vec_id FROM epairs
WHERE vec_id % 3 > 0""")
def _(t):
    zeroed = epairs(t).withColumn("x", F.when(F.col("vec_id") % 3 == 0, vx.zeros(64)).otherwise(F.col("x")))
    return zeroed.where(vx.is_nonzero(F.col("x")) & vx.is_nonzero(F.col("y"))).select("vec_id")


@query("geometry_slots", f"""WITH {SNIPPETS}, f AS (SELECT doc_id, {sql_fold('code')} AS c FROM snippets)
SELECT doc_id, round({sql_times('c', 'if' + chr(92) + 's*' + chr(92) + '(')} / 10, 6) AS s3,
round({sql_times('c', 'for' + chr(92) + 's*' + chr(92) + '(')} / 5, 6) AS s4,
round({sql_times('c', 'await' + chr(92) + 's+')} / 5, 6) AS s5,
round({sql_times('c', 'try' + chr(92) + 's*' + chr(92) + '{')} / 5, 6) AS s6 FROM f""")
def _(t):
    v = t.snippets().select("doc_id", vx.geometry_slots(F.col("code")).alias("v"))
    return v.select("doc_id", *[F.round(F.get("v", F.lit(i)), 6).alias(f"s{i}") for i in (3, 4, 5, 6)])


_TOPK = """WITH u AS (SELECT vec_id, label,
[x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) for x in embedding::DOUBLE[]] AS v
FROM embeddings), s AS (SELECT a.vec_id AS target_id, b.vec_id AS reference_id,
round(list_dot_product(a.v, b.v), 9) AS score FROM u a, u b), r AS (SELECT *, row_number() OVER
(PARTITION BY target_id ORDER BY score DESC, reference_id) AS rank FROM s WHERE score >= 0.2)
SELECT target_id, reference_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""


def _topk(e, index):
    top = retrieval.vector_topk(e, index, "vec_id", "embedding", 64, 5, 0.2)
    return top.select("target_id", "reference_id", F.round("score", 6).alias("score"),
                      F.col("rank").cast(LONG).alias("rank"))


@query("vector_topk", _TOPK)
def _(t):
    return _topk(t.embeddings, t.embeddings)


@query("stored_index_topk", _TOPK)
def _(t):
    """The same neighbours from an index that was written and is read back."""
    path = new_table_path(t.spark, "vector-index")
    sinks.write_vector_index(t.embeddings, path, "vec_id", "embedding", 64)
    return _topk(t.embeddings, sinks.read_vector_index(t.spark, path))


@query("pair_similarity", f"""WITH {EPAIRS}, s AS (SELECT list_dot_product(x, y) /
((sqrt(list_dot_product(x, x)) + 1e-9) * (sqrt(list_dot_product(y, y)) + 1e-9)) AS c FROM epairs)
SELECT round(avg(c), 6) AS mean, round(min(c), 6) AS least, round(max(c), 6) AS most FROM s""")
def _(t):
    s = retrieval.pair_similarity(epairs(t), "x", "y")
    return s.agg(*[F.round(f("similarity"), 6).alias(n) for n, f in (
        ("mean", F.avg), ("least", F.min), ("most", F.max))])


# --- term weights and the gate ---------------------------------------------------------------------

_TOK = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+|[-+*/=<>!&|?:.,]')"


def grams_cte(source: str, key: str, text: str, name: str) -> str:
    return f"""{name}_w AS (SELECT {key}, {_TOK.format(text)} AS w FROM {source}),
{name} AS (SELECT {key}, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]))
AS term FROM {name}_w)"""


def vocabulary_cte(grams: str, key: str, source: str, name: str, top: int) -> str:
    return f"""{name} AS (SELECT term, tf, df, n, ln((1 + n) / (1 + df)) + 1 AS idf FROM (
SELECT term, count(*) AS tf, count(DISTINCT {key}) AS df, (SELECT count(*) FROM {source}) AS n
FROM {grams} GROUP BY term ORDER BY tf DESC, term LIMIT {top}))"""


def weights_cte(grams: str, key: str, vocabulary: str, name: str) -> str:
    return f"""{name}_t AS (SELECT {key}, term, count(*) * any_value(idf) AS w
FROM {grams} JOIN {vocabulary} USING (term) GROUP BY {key}, term),
{name} AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM {name}_t)"""


@query("tfidf_fit", f"""WITH {grams_cte('documents', 'doc_id', 'text', 'g')},
{vocabulary_cte('g', 'doc_id', 'documents', 'v', 1500)}
SELECT term, tf, df, round(idf, 6) AS idf FROM v""")
def _(t):
    g = t.texts().select(tfidf.word_grams(F.col("text")).alias("grams"))
    return tfidf.tfidf_fit(g).select("term", "tf", "df", F.round("idf", 6).alias("idf"))


@query("tfidf_transform", f"""WITH {grams_cte('documents', 'doc_id', 'text', 'g')},
{vocabulary_cte('g', 'doc_id', 'documents', 'v', 300)}, {weights_cte('g', 'doc_id', 'v', 'w')}
SELECT doc_id, term, round(weight, 6) AS weight FROM w""")
def _(t):
    g = t.texts().select("doc_id", tfidf.word_grams(F.col("text")).alias("grams"))
    v = tfidf.tfidf_fit(g, max_terms=300)
    return tfidf.tfidf_transform(g, v, "doc_id").select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query("tfidf_sparse", f"""WITH {grams_cte('documents', 'doc_id', 'text', 'g')},
{vocabulary_cte('g', 'doc_id', 'documents', 'v', 300)}, {weights_cte('g', 'doc_id', 'v', 'w')}
SELECT doc_id, count(*) AS terms, round(sum(weight), 5) AS total FROM w GROUP BY doc_id""")
def _(t):
    g = t.texts().select("doc_id", tfidf.word_grams(F.col("text")).alias("grams"))
    s = tfidf.TermWeights.fit(g, max_terms=300).sparse(g).where(F.size("idx") > 0)
    return s.select("doc_id", F.size("idx").cast(LONG).alias("terms"),
                    F.round(F.aggregate("val", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


REFS = "refs AS (SELECT pair_id, before AS code FROM pairs WHERE before IS NOT NULL)"
HYBRID_CTE = f"""{SNIPPETS}, {PAIRS}, {REFS},
{vectors_cte('snippets', 'doc_id', 'tv')}, {vectors_cte('refs', 'pair_id', 'rv')},
{grams_cte('refs', 'pair_id', 'code', 'rg')}, {grams_cte('snippets', 'doc_id', 'code', 'tg')},
{vocabulary_cte('rg', 'pair_id', 'refs', 'voc', 1500)},
{weights_cte('rg', 'pair_id', 'voc', 'rw')}, {weights_cte('tg', 'doc_id', 'voc', 'tw')},
txt AS (SELECT doc_id, pair_id, sum(tw.weight * rw.weight) AS t FROM tw JOIN rw USING (term) GROUP BY 1, 2),
hyb AS (SELECT tv.doc_id, rv.pair_id, round(0.4 * list_dot_product(tv.vec, rv.vec)
+ 0.6 * coalesce(t, 0), 9) AS raw FROM tv CROSS JOIN rv LEFT JOIN txt
ON txt.doc_id = tv.doc_id AND txt.pair_id = rv.pair_id),
best AS (SELECT doc_id, raw, pair_id AS matched_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
ORDER BY raw DESC, pair_id) AS rn FROM hyb) WHERE rn = 1),
scored AS (SELECT b.*, s.source, greatest(0.05, least(0.98, raw * 1.5 + {defect_sql('code')})) AS score
FROM best b JOIN snippets s USING (doc_id))"""


def _refs(t):
    return t.pairs().where("before IS NOT NULL").select("pair_id", F.col("before").alias("ref_code"))


def _gated(t, *keep):
    return score_methods(t.snippets(), _refs(t), "doc_id", "pair_id", "code", "ref_code", keep=keep)


@query("hybrid_top1", f"""WITH {HYBRID_CTE} SELECT doc_id, matched_id, round(raw, 5) AS raw FROM best""")
def _(t):
    best = retrieval.hybrid_top1(t.snippets(), _refs(t), "doc_id", "pair_id", "code", "ref_code")
    return best.select(F.col("target_id").alias("doc_id"), F.col("reference_id").alias("matched_id"),
                       F.round("score", 5).alias("raw"))


@query("hybrid_gate", f"""WITH {HYBRID_CTE} SELECT doc_id, matched_id, round(score, 5) AS score,
CASE WHEN score >= 0.5 THEN 'SUSPICIOUS (>=0.5)' ELSE 'CLEAN (<0.5)' END AS verdict,
CASE WHEN score >= 0.5 THEN 0.0 ELSE 0.003 END::DOUBLE AS cost_saved FROM scored""")
def _(t):
    return _gated(t).select("doc_id", F.col("reference_id").alias("matched_id"),
                            F.round("score", 5).alias("score"), "verdict", "cost_saved")


@query("gate_without_references", f"""WITH {SNIPPETS} SELECT doc_id, NULL::BIGINT AS matched_id, 0::DOUBLE AS score,
'CLEAN (<0.5)' AS verdict FROM snippets""")
def _(t):
    """No known pair at all: every snippet stays, without a twin."""
    scored = score_methods(t.snippets(), _refs(t).where(F.col("pair_id") < 0), "doc_id", "pair_id", "code", "ref_code")
    return scored.select("doc_id", F.col("reference_id").alias("matched_id"), "score", "verdict")


@query("gate_by_source", f"""WITH {HYBRID_CTE} SELECT source, score >= 0.5 AS suspicious,
count(*) AS methods, round(sum(CASE WHEN score >= 0.5 THEN 0.0 ELSE 0.003 END), 6)::DOUBLE AS saved
FROM scored GROUP BY 1, 2""")
def _(t):
    return _gated(t, "source").groupBy("source", "suspicious").agg(F.count(F.lit(1)).alias("methods"),
                                                 F.round(F.sum("cost_saved"), 6).alias("saved"))


@query("gate_small_scans", f"""WITH e AS (SELECT o_orderkey AS method_id, o_custkey AS scan_id,
(o_orderkey % 101) / 100 AS score, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT method_id, n <= 3 OR score >= 0.8 AS suspicious,
CASE WHEN n <= 3 THEN 'SNIPPET VERIFICATION' WHEN score >= 0.8 THEN 'SUSPICIOUS (>=0.8)'
ELSE 'CLEAN (<0.8)' END AS verdict,
round(CASE WHEN n <= 3 THEN greatest(score, 0.88) ELSE score END, 4) AS verify_score FROM e""")
def _(t):
    o = t.orders.select(F.col("o_orderkey").alias("method_id"), F.col("o_custkey").alias("scan_id"),
                        ((F.col("o_orderkey") % 101) / 100).alias("score"))
    return retrieval.gate(o, "scan_id", 0.8).select("method_id", "suspicious", "verdict",
                                                    F.round("verify_score", 4).alias("verify_score"))


@query("score_round", """SELECT event_id, round(greatest(0.05, least(0.98, value / 97 * 1.5
+ (event_id % 5) / 10)), 4) AS score FROM events""")
def _(t):
    s = fx.calibrated_score(F.col("value") / 97, (F.col("event_id") % 5) / 10)
    return t.events.select("event_id", F.round(s, 4).alias("score"))


@query("cost_saved", f"""WITH {LEDGER} SELECT scan_id,
round(sum(CASE WHEN suspicious THEN 0.0 ELSE 0.003 END), 3)::DOUBLE AS saved FROM ledger GROUP BY 1""")
def _(t):
    return t.ledger().groupBy("scan_id").agg(F.round(F.sum(fx.cost_saved(F.col("suspicious"))), 3).alias("saved"))


@query("progress_percent", f"WITH {STEPS} SELECT id, floor(step / 11 * 100)::BIGINT AS pct FROM steps")
def _(t):
    return t.steps().select("id", fx.progress_percent(F.col("step")).cast(LONG).alias("pct"))


# --- audits --------------------------------------------------------------------------------------------

@query("quality_filter", f"""WITH {PAIRS}, ok AS (SELECT *, row_number() OVER (PARTITION BY before, bug_type
ORDER BY pair_id) AS rn FROM pairs WHERE before IS NOT NULL
AND {B.sql_trim('before')} <> {B.sql_trim('after')} AND length(before) >= 15)
SELECT pair_id, bug_type FROM ok WHERE rn = 1""")
def _(t):
    return quality.quality_filter(t.pairs(), "pair_id", "before", "after").select("pair_id", "bug_type")


@query("drop_rare_classes", """SELECT p_partkey, p_brand FROM part WHERE p_brand IN
(SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) >= 80)""")
def _(t):
    return quality.drop_rare_classes(t.part, "p_brand", 80).select("p_partkey", "p_brand")


@query("dedupe_pairs", """WITH d AS (SELECT doc_id, row_number() OVER (PARTITION BY lang, text, n_chars
ORDER BY doc_id) AS rn FROM documents) SELECT doc_id FROM d WHERE rn = 1""")
def _(t):
    d = t.documents.withColumn("size", F.col("n_chars").cast("string"))
    return quality.dedupe_pairs(d, ["lang"], "text", "size", [F.col("doc_id")]).select("doc_id")


LABELLED = """labelled AS (SELECT d.doc_id, d.text, (['a', 'b', 'c'])[d.doc_id % 3 + 1] AS label
FROM documents d)"""


def _labelled(t):
    return t.documents.select("doc_id", "text", B.pick(["a", "b", "c"], F.col("doc_id")).alias("label"))


_MAJORITY = """counts AS (SELECT text, label, count(*) AS n FROM labelled GROUP BY 1, 2),
major AS (SELECT text, label FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY n DESC, label)
AS rn FROM counts) WHERE rn = 1)"""


@query("majority_label", f"WITH {LABELLED}, {_MAJORITY} SELECT sha256(text) AS code_key, "
                         "label AS majority FROM major")
def _(t):
    return quality.majority_label(_labelled(t), "text", "label")


@query("map_back_majority", f"WITH {LABELLED}, {_MAJORITY} SELECT l.doc_id, m.label FROM labelled l "
                            "JOIN major m ON l.text = m.text")
def _(t):
    return quality.map_back_majority(_labelled(t), "text", "label").select("doc_id", "label")


@query("label_conflicts", f"""WITH {LABELLED} SELECT count(*) AS conflicts FROM (SELECT text FROM labelled
GROUP BY text HAVING count(DISTINCT label) > 1)""")
def _(t):
    return quality.label_conflicts(_labelled(t), "text", "label")


@query("duplicate_audit", """WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text)
SELECT coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS in_duplicate_groups,
sum(n - 1)::BIGINT AS beyond_first FROM g""")
def _(t):
    return quality.duplicate_audit(t.documents, "text")


@query("null_audit", f"""WITH j AS (SELECT d.doc_id, quality, toxic, text FROM documents d
LEFT JOIN labels l USING (doc_id)), a AS (SELECT count(*) AS n, count(*) - count(quality) AS q,
count(*) - count(toxic) AS x, count(*) - count(text) AS t FROM j)
SELECT unnest(['quality', 'toxic', 'text']) AS column_name, unnest([q, x, t])::BIGINT AS nulls,
round(unnest([q, x, t]) * 100.0 / n, 4)::DOUBLE AS pct FROM a""")
def _(t):
    j = t.documents.join(t.labels, "doc_id", "left")
    return quality.null_audit(j, ["quality", "toxic", "text"]).withColumn("pct", F.round("pct", 4))


def _vector_texts(t):
    v = F.col("vec_id")
    e = F.to_json(F.col("embedding").cast("array<double>"))
    zero = F.to_json(vx.zeros(64))
    return t.embeddings.select(
        "vec_id", F.when(v % 7 == 0, "broken").when(v % 5 == 0, zero).otherwise(e).alias("before_v"),
        F.when(v % 11 == 0, "[1,2]").when(v % 3 == 0, zero).otherwise(e).alias("after_v"))


@query("vector_audit", """SELECT count(*) AS total,
count(*) FILTER (WHERE vec_id % 7 = 0 OR vec_id % 11 = 0) AS malformed,
count(*) FILTER (WHERE vec_id % 7 > 0 AND vec_id % 11 > 0 AND vec_id % 5 = 0) AS zero_before,
count(*) FILTER (WHERE vec_id % 7 > 0 AND vec_id % 11 > 0 AND vec_id % 3 = 0) AS zero_after
FROM embeddings""")
def _(t):
    return quality.vector_audit(_vector_texts(t), "before_v", "after_v")


@query("numeric_profile", """SELECT round(avg(n_chars), 4) AS mean, min(n_chars) AS least,
max(n_chars) AS greatest, quantile_cont(n_chars, 0.5) AS median FROM documents""")
def _(t):
    return quality.numeric_profile(t.documents, "n_chars").withColumn("mean", F.round("mean", 4))


@query("audit_pairs", f"""WITH {PAIRS}, p AS (SELECT *, length(coalesce(before, '')) AS n FROM pairs),
g AS (SELECT before, count(*) AS n, count(DISTINCT bug_type) AS kinds FROM pairs GROUP BY before),
bad AS (SELECT *, pair_id % 7 = 0 AS broken, pair_id % 5 = 0 AS zero FROM pairs)
SELECT unnest(['nulls_before', 'nulls_after', 'nulls_bug_type', 'vectors_total', 'vectors_malformed',
'vectors_zero_before', 'vectors_zero_after', 'in_duplicate_groups', 'beyond_first', 'identical_pairs',
'short_snippets', 'label_conflicts', 'length_mean', 'length_least', 'length_greatest',
'length_median']) AS metric, round(unnest([
(SELECT count(*) - count(before) FROM pairs), (SELECT count(*) - count(after) FROM pairs), 0,
(SELECT count(*) FROM pairs), (SELECT count(*) FROM bad WHERE broken),
(SELECT count(*) FROM bad WHERE NOT broken AND zero), 0,
(SELECT coalesce(sum(n), 0) FROM g WHERE n > 1), (SELECT sum(n - 1) FROM g),
(SELECT count(*) FROM pairs WHERE before = after), (SELECT count(*) FROM p WHERE n < 20),
(SELECT count(*) FROM g WHERE kinds > 1 AND before IS NOT NULL) + (SELECT count(*) FROM g WHERE kinds > 1 AND before IS NULL),
(SELECT avg(n) FROM p), (SELECT min(n) FROM p), (SELECT max(n) FROM p),
(SELECT quantile_cont(n, 0.5) FROM p)])::DOUBLE, 4) AS value""")
def _(t):
    good, zero = F.lit("[0.5,0.5]"), F.lit("[0,0]")
    p = t.pairs().withColumns({
        "v1": F.when(F.col("pair_id") % 7 == 0, "?").when(F.col("pair_id") % 5 == 0, zero).otherwise(good),
        "v2": good})
    a = quality.audit_pairs(p, "before", "after", "v1", "v2", n=2)
    return a.withColumn("value", F.round("value", 4))


@query("distinct_profile", f"""WITH {PAIRS} SELECT count(*) AS total_rows,
count(DISTINCT repository) AS repositories, count(DISTINCT bug_type) AS classes FROM pairs""")
def _(t):
    return report.distinct_profile(t.pairs(), "repository", "bug_type")


@query("language_counts", """SELECT lang AS language, count(*) AS n FROM documents WHERE lang IS NOT NULL
GROUP BY 1""")
def _(t):
    return report.language_counts(t.documents, "lang")


@query("tier_stats", """WITH s AS (SELECT 'buggy' AS side, event_type AS tier FROM events UNION ALL
SELECT 'fixed', CASE WHEN value > 10 THEN 'parse_error' ELSE event_type END FROM events),
c AS (SELECT side, tier, count(*) AS n FROM s GROUP BY 1, 2) SELECT side, tier, n,
round(n * 100.0 / sum(n) OVER (PARTITION BY side), 4)::DOUBLE AS pct,
round(sum(n) FILTER (WHERE tier <> 'parse_error') OVER () * 100.0 / sum(n) OVER (), 4)::DOUBLE
AS success_pct FROM c""")
def _(t):
    e = t.events.select(F.col("event_type").alias("buggy_tier"), F.when(
        F.col("value") > 10, "parse_error").otherwise(F.col("event_type")).alias("fixed_tier"))
    return report.tier_stats(e).withColumns({c: F.round(c, 4) for c in ("pct", "success_pct")})


# --- mining -----------------------------------------------------------------------------------------------

@query("existing_counts", f"""WITH {PAIRS} SELECT 'type' AS kind, bug_type AS name, count(*) AS n FROM pairs
GROUP BY 2 UNION ALL SELECT 'repository', repository, count(*) FROM pairs GROUP BY 2 UNION ALL
SELECT 'commits', 'all', count(DISTINCT commit_hash) FROM pairs""")
def _(t):
    c = mining.existing_counts(t.pairs())
    commits = c["commits"].agg(F.count(F.lit(1)).alias("n"))
    return (c["types"].select(F.lit("type").alias("kind"), F.col("bug_type").alias("name"), "n")
            .unionByName(c["repositories"].select(F.lit("repository").alias("kind"),
                                                  F.col("repository").alias("name"), "n"))
            .unionByName(commits.select(F.lit("commits").alias("kind"), F.lit("all").alias("name"), "n")))


@query("skip_known_commits", """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN
(SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def _(t):
    known = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return mining.skip_known_commits(t.orders, known, "o_orderkey").select("o_orderkey")


@query("match_known_repos", """WITH k AS (SELECT page_id AS position, CASE WHEN page_id % 15 = 0 THEN url
ELSE reverse(split_part(reverse(url), '/', 1)) END AS name, CASE WHEN page_id % 10 = 0 THEN url END AS known_url
FROM pages WHERE page_id % 5 = 0), m AS (SELECT page_id, name, row_number() OVER (PARTITION BY page_id ORDER BY position)
AS rn FROM pages JOIN k ON pages.url = known_url OR contains(pages.url, name))
SELECT page_id, m.name AS known_repo FROM pages LEFT JOIN (SELECT * FROM m WHERE rn = 1) m USING (page_id)""")
def _(t):
    url, at = F.col("url"), F.col("page_id")
    known = t.pages.where(at % 5 == 0).select(
        at.alias("position"), F.when(at % 15 == 0, url).otherwise(F.element_at(F.split(url, "/"), -1)).alias("name"),
        F.when(at % 10 == 0, url).alias("url"))
    return mining.match_known_repos(t.pages.select("page_id", "url"), known).select("page_id", "known_repo")


_CAPS = {"click": 40, "view": 25, "signup": 10, "error": 60}


@query("cap_per_group", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
AS rr FROM events), h AS (SELECT user_id, count(*) % 3 AS had FROM events GROUP BY 1),
c AS (SELECT r.*, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS cr FROM r JOIN h USING (user_id)
WHERE rr <= 4 - had)
SELECT event_id FROM c JOIN {sql_values(list(_CAPS.items()) + [('purchase', 150)])} v(event_type, cap)
USING (event_type) WHERE cr <= cap - 5 ORDER BY ts, event_id LIMIT 100""")
def _(t):
    e = t.events
    had = e.groupBy("user_id").agg((F.count(F.lit(1)) % 3).alias("n"))
    five = e.groupBy("event_type").agg((F.count(F.lit(1)) * 0 + 5).alias("n"))
    kept = mining.cap_per_group(e, "event_type", "user_id", ["ts", "event_id"], _CAPS,
                                repository_counts=had, category_counts=five, target=100)
    return kept.select("event_id")


@query("cap_per_group_greedy", f"""WITH RECURSIVE first AS (SELECT event_id, event_type, user_id, row_number() OVER
(PARTITION BY event_type, user_id ORDER BY ts, event_id) AS rn, ts FROM events),
line AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS i FROM first WHERE rn <= 3),
caps AS (SELECT MAP {{{', '.join(f"'{c}': {n}" for c, n in {**_CAPS, 'purchase': 30}.items())}}} AS cap),
walk(i, event_id, ok, types, users) AS (
SELECT 0::BIGINT, NULL::BIGINT, false, MAP {{'': 0}}, MAP {{-1::BIGINT: 0}} UNION ALL
SELECT l.i, l.event_id, l.ok, CASE WHEN l.ok THEN map_concat(w.types, MAP {{l.event_type: l.a + 1}}) ELSE w.types END,
CASE WHEN l.ok THEN map_concat(w.users, MAP {{l.user_id: l.b + 1}}) ELSE w.users END
FROM walk w, LATERAL (SELECT x.*, a < coalesce(cap[event_type], 0) AND b < 3 AS ok FROM (SELECT line.*,
coalesce(w.types[event_type], 0) AS a, coalesce(w.users[user_id], 0) AS b FROM line WHERE line.i = w.i + 1) x, caps) l)
SELECT event_id FROM walk WHERE ok""")
def _(t):
    caps = {**_CAPS, "purchase": 30}
    return mining.cap_per_group_greedy(
        t.events.drop("props"), "event_type", "user_id", ["ts", "event_id"], caps, 3).select("event_id")


_NEED = f"""WITH {PAIRS}, v(bug_type, position, cap) AS {sql_values(
    [(c, i, n) for i, (c, n) in enumerate(L.CATEGORY_CAPS.items())])},
need AS (SELECT v.bug_type, position, greatest(0, cap - coalesce(n, 0))::BIGINT AS room FROM v LEFT JOIN
(SELECT bug_type, count(*) AS n FROM pairs GROUP BY 1) USING (bug_type))"""


@query("category_need", f"{_NEED} SELECT bug_type, room FROM need WHERE room > 0")
def _(t):
    counts = mining.existing_counts(t.pairs())["types"]
    return mining.category_need(counts).select("bug_type", F.col("room").cast(LONG).alias("room"))


@query("search_plan", f"""{_NEED}, hints(bug_type, place, topic) AS {sql_values(
    [(c, i, x) for c, xs in TOPIC_HINTS.items() for i, x in enumerate(xs)])},
generic(place, topic) AS {sql_values(list(enumerate(L.GENERIC_TOPICS)))},
everything AS (SELECT topic, 0 AS part, -room AS need, position, place FROM need JOIN hints USING (bug_type)
WHERE room > 0 UNION ALL SELECT topic, 1, 0, 0, place FROM generic),
firsts AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY part, need, position, place) AS rn
FROM everything) SELECT topic, row_number() OVER (ORDER BY part, need, position, place) AS place
FROM firsts WHERE rn = 1""")
def _(t):
    plan = mining.search_plan(mining.category_need(mining.existing_counts(t.pairs())["types"]))
    return plan.select("topic", F.col("place").cast(LONG).alias("place"))


@query("first_fix_commits", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)
AS rn FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn) AS k FROM l
WHERE rn <= 30 AND event_type IN ('error', 'signup')) SELECT event_id FROM f WHERE k <= 5""")
def _(t):
    message = (F.when(F.col("event_type") == "error", "handle error")
               .when(F.col("event_type") == "signup", "Fixes a leak")
               .when(F.col("event_type") == "view", "fix docs").otherwise("add feature"))
    c = t.events.select("event_id", F.col("user_id").alias("repository"),
                        (-F.col("event_id")).alias("position"), message.alias("message"))
    return mining.first_fix_commits(c).select("event_id")


@query("mining_summary", f"""WITH {PAIRS} SELECT 'records_added' AS metric, count(*) AS value FROM pairs
UNION ALL SELECT 'repositories', count(DISTINCT repository) FROM pairs
UNION ALL SELECT 'type_' || bug_type, count(*) FROM pairs GROUP BY bug_type""")
def _(t):
    return mining.mining_summary(t.pairs())


@query("distinct_repos", f"WITH {PAIRS} SELECT DISTINCT repository FROM pairs")
def _(t):
    return mining.distinct_repos(t.pairs())


@query("dedupe_repair", f"""WITH k AS (SELECT doc_id, {B.sql_trim('text')} || '_' || lang AS k FROM documents),
done AS (SELECT DISTINCT k FROM k WHERE doc_id % 4 = 0)
SELECT sha256(k) AS content_key, 'known' AS state, count(*) AS n FROM k WHERE k IN (SELECT k FROM done) GROUP BY k
UNION ALL SELECT sha256(k), 'fresh', 1 FROM k WHERE k NOT IN (SELECT k FROM done) GROUP BY k""")
def _(t):
    d = t.documents
    done = d.where("doc_id % 4 = 0").select(fx.content_key(F.col("text"), F.col("lang")).alias("content_key")
                                            ).distinct()
    known, fresh = mining.dedupe_repair(d, done, "text", "lang")
    tag = [known.select("content_key", F.lit("known").alias("state")),
           fresh.select("content_key", F.lit("fresh").alias("state"))]
    return tag[0].unionByName(tag[1]).groupBy("content_key", "state").agg(F.count(F.lit(1)).alias("n"))


@query("enclosing_function", """WITH spans AS (SELECT l_suppkey AS file, l_orderkey * 10 + l_linenumber AS span,
(l_orderkey % 900)::INT + 1 AS s, (l_orderkey % 900)::INT + 1 + (l_quantity * 3)::INT AS e FROM lineitem),
uniq AS (SELECT file, s, max(e) AS e FROM spans GROUP BY 1, 2),
ch AS (SELECT p_partkey, p_partkey % 100 + 1 AS file, greatest(1, least(p_size * 17, 800)) AS s,
greatest(greatest(1, least(p_size * 17, 800)), least(p_size * 17 + 20, 800)) AS e FROM part)
SELECT p_partkey, max(u.s)::BIGINT AS line_start FROM ch JOIN uniq u ON u.file = ch.file AND u.s <= ch.s AND u.e >= ch.e
GROUP BY p_partkey""")
def _(t):
    start = (F.col("l_orderkey") % 900).cast("int") + 1
    spans = t.lineitem.groupBy(F.col("l_suppkey").alias("file"), start.alias("line_start")).agg(
        F.max(start + (F.col("l_quantity") * 3).cast("int")).alias("line_end"))
    spans = spans.withColumns({"name": F.lit("f"), "code": F.lit("")})
    changes = t.part.select(
        "p_partkey", (F.col("p_partkey") % 100 + 1).alias("file"), (F.col("p_size") * 17).alias("start"),
        (F.col("p_size") * 17 + 20).alias("end"), F.lit(800).alias("line_total"))
    found = slicing.enclosing_function(changes, spans, ["file"], "p_partkey")
    return found.select("p_partkey", F.col("line_start").cast(LONG).alias("line_start"))


_UPSERT = """WITH u AS (SELECT o_orderkey AS k, 0 AS version, o_totalprice AS v FROM orders
WHERE o_orderstatus <> 'P' UNION ALL SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC, v DESC) AS rn FROM u)
SELECT k, version::BIGINT AS version, v FROM r WHERE rn = 1"""


def _old_and_new(t):
    old = t.orders.where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("k"), F.lit(0).alias("version"), F.col("o_totalprice").alias("v"))
    return old, t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("version"),
                                  F.col("l_extendedprice").alias("v"))


def _newest():
    return [F.col("version").desc(), F.col("v").desc()]


@query("upsert_by_key", _UPSERT)
def _(t):
    best = sinks.upsert_by_key(*_old_and_new(t), "k", _newest())
    return best.select("k", F.col("version").cast(LONG).alias("version"), "v")


@query("upsert_keyed_table", _UPSERT)
def _(t):
    """The same rows from a table that was written, brought up to date and read back."""
    path = new_table_path(t.spark, "keyed")
    for rows in _old_and_new(t):
        sinks.upsert_keyed_table(rows, path, "k", _newest(), 16)
    return sinks.read_keyed_table(t.spark, path).select("k", F.col("version").cast(LONG).alias("version"), "v")


@query("resume_rows", """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN
(SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')""")
def _(t):
    done = t.lineitem.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return sinks.not_done(t.orders, done, "o_orderkey").select("o_orderkey")


@query("index_rows", """WITH u AS (SELECT vec_id, list_concat([x / sqrt(list_dot_product(embedding::DOUBLE[],
embedding::DOUBLE[])) for x in embedding::DOUBLE[]], [0.0::DOUBLE for x in range(56)]) AS v FROM embeddings
WHERE vec_id % 4 > 0) SELECT vec_id, i::BIGINT AS i, round(v[i], 6) + 0 AS x FROM u, range(1, 121) r(i)""")
def _(t):
    e = t.embeddings.withColumn("embedding", F.when(F.col("vec_id") % 4 > 0, F.col("embedding")))
    r = sinks.index_rows(e, "vec_id", "embedding", 120).select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return r.select("vec_id", (F.col("i") + 1).cast(LONG).alias("i"), (F.round("x", 6) + F.lit(0.0)).alias("x"))


@query("scan_documents", f"""WITH {LEDGER} SELECT scan_id, file_path,
sum(count(*)) OVER (PARTITION BY scan_id)::BIGINT AS rows_total,
string_agg(method_id || ':' || complexity || ':' || suspicious, ',' ORDER BY method_id) AS items
FROM ledger GROUP BY scan_id, file_path""")
def _(t):
    docs = sinks.scan_documents(t.ledger(), "scan_id", "file_path", "method_id")
    back = F.from_json("document", "array<struct<method_id:long,complexity:int,suspicious:boolean>>")
    items = F.transform(back, lambda x: F.concat_ws(":", x["method_id"], x["complexity"], x["suspicious"]))
    return docs.select("scan_id", "file_path", "rows_total", F.array_join(items, ",").alias("items"))


# --- reports ------------------------------------------------------------------------------------------------

_STATS = f"""WITH {PAIRS}, s AS (SELECT bug_type, severity, repository,
greatest(0, conv_id % 5) AS g, turn % 3 AS a FROM pairs)"""


@query("dataset_stats", _STATS + " UNION ALL ".join(
    f" SELECT {quote(k)} AS kind, {c} AS name, count(*) AS pairs, count(*) * 2 AS samples, "
    f"sum(g)::BIGINT AS boundary_checks, sum(a)::BIGINT AS await_fixes FROM s{g}"
    for k, c, g in [("bug_type", "bug_type", " GROUP BY bug_type"), ("severity", "severity", " GROUP BY severity"),
                    ("project", "repository", " GROUP BY repository"), ("total", "'all'", "")]))
def _(t):
    p = t.pairs().withColumns({"g": F.col("conv_id") % 5, "a": F.col("turn") % 3})
    return report.dataset_stats(p, project="repository", guards="g", awaits="a")


@query("value_share", """SELECT event_type, count(*) AS n,
round(count(*) * 100.0 / sum(count(*)) OVER (), 4)::DOUBLE AS pct FROM events GROUP BY 1""")
def _(t):
    return report.value_share(t.events, "event_type").withColumn("pct", F.round("pct", 4))


@query("top_projects", """SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 5""")
def _(t):
    return report.top_projects(t.events, "user_id", 5)


@query("scan_summary", f"""WITH {LEDGER} SELECT scan_id, count(DISTINCT file_path) AS files_scanned,
count(*) AS methods_analyzed, count(*) FILTER (WHERE NOT suspicious) AS clean_methods,
round(count(*) FILTER (WHERE NOT suspicious) * 0.003::DOUBLE, 3) AS cost_saved_usd,
round(avg(complexity), 2) AS average_complexity, max(max_depth) AS max_depth,
(count(*) * 64)::BIGINT AS vector_slots FROM ledger GROUP BY 1""")
def _(t):
    return report.scan_summary(t.ledger(), ["scan_id"]).withColumn("max_depth", F.col("max_depth").cast(LONG))


_SEV = f"""WITH {LEDGER}, c AS (SELECT scan_id, count(*) FILTER (WHERE severity_level = 'Critical') AS critical,
count(*) FILTER (WHERE severity_level = 'Major') AS major,
count(*) FILTER (WHERE severity_level = 'Minor') AS minor FROM ledger WHERE suspicious GROUP BY 1)"""


@query("severity_breakdown", f"""{_SEV}, f AS (SELECT scan_id, count(*) AS functions FROM ledger GROUP BY 1)
SELECT scan_id, critical, major, minor, functions, critical + major + minor AS bugs,
round(critical * 100.0 / (critical + major + minor), 4)::DOUBLE AS critical_pct,
round((critical + major + minor) * 100.0::DOUBLE / functions, 1) AS detection_rate FROM c JOIN f USING (scan_id)""")
def _(t):
    led = t.ledger()
    sizes = led.groupBy("scan_id").agg(F.count(F.lit(1)).alias("functions"))
    found = led.where("suspicious").join(sizes, "scan_id")
    r = report.severity_breakdown(found, ["scan_id"], functions="functions")
    return r.select("scan_id", "critical", "major", "minor", "functions", "bugs",
                    F.round("critical_pct", 4).alias("critical_pct"), "detection_rate")


@query("health_score", f"""WITH {PAIRS}, k AS (SELECT conv_id, count(*) FILTER (WHERE pair_id % 5 = 0) AS critical,
count(*) FILTER (WHERE pair_id % 3 = 0) AS major, count(*) FILTER (WHERE pair_id % 2 = 0) AS minor
FROM pairs GROUP BY 1), s AS (SELECT *, greatest(0, 100 - critical * 25 - major * 15 - minor * 5) AS score FROM k)
SELECT conv_id, score, CASE WHEN critical > 0 OR score < 70 THEN 'C' WHEN major > 0 OR score < 85 THEN 'B'
ELSE 'A' END AS grade FROM s""")
def _(t):
    p = F.col("pair_id")
    k = t.pairs().groupBy("conv_id").agg(*[F.count_if(p % n == 0).alias(c) for c, n in (
        ("critical", 5), ("major", 3), ("minor", 2))])
    return report.health_score(k).select("conv_id", F.col("score").cast(LONG).alias("score"), "grade")


# tool reports as four feeds with the columns each tool really gives
_RULES = ["no-eval", "react-hooks/deps", "require-await", "typescript/no-any", "eqeqeq"]
_CATS = ["security", "react", "async", "type", "logic"]
_LEVELS = ["critical", "high", "moderate", "low"]
FEEDS = f"""lint AS (SELECT 'src/' || l_suppkey || '.js' AS file, l_linenumber AS line,
CASE WHEN l_returnflag = 'R' THEN 'error' ELSE 'warning' END AS severity,
{sql_pick(_RULES, 'l_partkey')} AS rule_id, 'eslint' AS engine, {sql_pick(_CATS, 'l_partkey')} AS category
FROM lineitem),
tsc AS (SELECT 'src/' || o_custkey || '.ts', (o_orderkey % 90 + 1)::INT,
CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'warning' END, 'TS' || (2000 + o_orderkey % 50),
'typescript', 'type' FROM orders),
npm AS (SELECT 'package.json', 1, CASE WHEN p_partkey % 4 < 2 THEN 'error' ELSE 'warning' END,
'npm-audit/' || {sql_pick(_LEVELS, 'p_partkey')}, 'npm-audit', 'dependency' FROM part),
sast AS (SELECT 'src/' || s_suppkey || '.js', (s_suppkey % 40 + 1)::INT,
{sql_pick(['error', 'warning', 'info'], 's_suppkey')}, 'sql-injection', 'semgrep', 'security' FROM supplier),
issues AS (SELECT * FROM lint UNION ALL SELECT * FROM tsc UNION ALL SELECT * FROM npm
UNION ALL SELECT * FROM sast)"""


def feeds(t):
    """Raw tool outputs built from the tables, parsed by the feed readers."""
    li, o, p, s = t.lineitem, t.orders, t.part, t.supplier
    lint = reshape.lint_findings(li.select(
        F.format_string("src/%d.js", "l_suppkey").alias("file"), F.col("l_linenumber").alias("line"),
        F.lit(None).cast("int").alias("column"), F.lit(None).cast("int").alias("endLine"),
        F.when(F.col("l_returnflag") == "R", 2).otherwise(1).alias("level"),
        B.pick(_RULES, F.col("l_partkey")).alias("ruleId"), F.lit("m").alias("message")))
    output = F.format_string(
        "noise line\nsrc\\%d.ts(%d,7): %s TS%d: text here", "o_custkey", F.col("o_orderkey") % 90 + 1,
        F.when(F.col("o_orderstatus") == "F", "error").otherwise("warning"), F.col("o_orderkey") % 50 + 2000)
    tsc = reshape.compiler_findings(o.select(output.alias("out")), "out")
    via = F.to_json(F.struct(F.col("p_name").alias("title"), F.struct(F.lit(7.5).alias("score")).alias("cvss")))
    audit = F.format_string(
        '{"vulnerabilities":{"pkg%d":{"severity":"%s","range":"<1","via":[%s]}}}', "p_partkey",
        B.pick(_LEVELS, F.col("p_partkey")), via)
    npm = reshape.audit_findings(p.select(audit.alias("c"), F.lit("package.json").alias("f")), "c", "f")
    found = F.format_string(
        '{"results":[{"path":"src/%d.js","check_id":"sql-injection","start":{"line":%d,"col":2},'
        '"end":{"line":99},"extra":{"severity":"%s","message":"m"}}]}', "s_suppkey",
        F.col("s_suppkey") % 40 + 1, B.pick(["HIGH", "medium", "note"], F.col("s_suppkey")))
    sast = reshape.sast_findings(s.select(found.alias("c")), "c")
    return reshape.union_engines(lint, tsc, npm, sast)


@query("union_engines", f"""WITH {FEEDS} SELECT file, line::BIGINT AS line, severity, rule_id, engine, category,
count(*) AS n FROM issues GROUP BY ALL""")
def _(t):
    return feeds(t).groupBy("file", F.col("line").cast(LONG).alias("line"), "severity",
                            F.col("ruleId").alias("rule_id"), "engine", "category").agg(
        F.count(F.lit(1)).alias("n"))


@query("json_findings", f"""SELECT 'package.json' AS file, 'pkg' || p_partkey AS package, p_name AS message,
7.5::DOUBLE AS cvss, 'npm-audit/' || {sql_pick(_LEVELS, 'p_partkey')} AS rule_id FROM part""")
def _(t):
    return feeds(t).where("engine = 'npm-audit'").select("file", "package", "message", "cvss",
                                                         F.col("ruleId").alias("rule_id"))


@query("parse_tsc_line", """SELECT 'src/' || o_custkey || '.ts' AS file, o_orderkey % 90 + 1 AS line,
'TS' || (2000 + o_orderkey % 50) AS code, count(*) AS n FROM orders GROUP BY ALL""")
def _(t):
    return feeds(t).where("engine = 'typescript'").groupBy(
        "file", F.col("line").cast(LONG).alias("line"), F.col("ruleId").alias("code")).agg(
        F.count(F.lit(1)).alias("n"))


@query("issue_report", f"""WITH {FEEDS}, known(dimension, name) AS {sql_values(
    [(d, v) for d, vs in report.REPORT_KEYS.items() for v in vs] + [('total', 'all')])},
found AS (SELECT 'severity' AS dimension, severity AS name, count(*) AS n FROM issues GROUP BY 2 UNION ALL
SELECT 'engine', engine, count(*) FROM issues GROUP BY 2 UNION ALL
SELECT 'category', category, count(*) FROM issues GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM issues)
SELECT dimension, name, coalesce(n, 0)::BIGINT AS n FROM known FULL JOIN found USING (dimension, name)""")
def _(t):
    return report.issue_report(feeds(t))


_FILES = "files AS (SELECT 'src/' || s_suppkey || '.js' AS path, 'utility' AS role, s_suppkey AS lines FROM supplier)"


def _files(t):
    return t.supplier.select(F.format_string("src/%d.js", "s_suppkey").alias("path"),
                             F.lit("utility").alias("role"), F.col("s_suppkey").alias("lines"))


@query("attach_issues", f"""WITH {FEEDS}, {_FILES}, c AS (SELECT file, count(*) AS n FROM issues GROUP BY 1)
SELECT coalesce(path, file) AS path, coalesce(role, 'config') AS role, coalesce(lines, 0) AS lines,
coalesce(n, 0) AS issue_count FROM files FULL JOIN c ON path = file""")
def _(t):
    return report.attach_issues(_files(t), feeds(t))


@query("files_by_issues", f"""WITH {FEEDS}, {_FILES}, c AS (SELECT file, count(*) AS n FROM issues GROUP BY 1)
SELECT coalesce(path, file) AS path, coalesce(n, 0) AS issue_count
FROM files FULL JOIN c ON path = file ORDER BY issue_count DESC, path""")
def _(t):
    return report.files_by_issues(report.attach_issues(_files(t), feeds(t))).select("path", "issue_count")


@query("file_findings", f"""WITH {LEDGER} SELECT s.scan_id, l.method_id, l.method_id IS NOT NULL AS is_buggy
FROM (SELECT DISTINCT user_id AS scan_id FROM events) s LEFT JOIN (SELECT * FROM ledger WHERE suspicious
AND complexity > 80) l USING (scan_id)""")
def _(t):
    led = t.ledger()
    bad = led.where("suspicious AND complexity > 80").select("scan_id", "method_id")
    return report.file_findings(led.select("scan_id").distinct(), bad, "scan_id")


@query("lookup_texts", f"""WITH {PAIRS}, d(bug_type, description, suggested_fix) AS {sql_values(
    [(k, L.DESCRIPTIONS[k], L.SUGGESTED_FIXES[k]) for k in L.APPROVED_TYPES])},
p AS (SELECT pair_id, CASE WHEN pair_id % 4 = 0 THEN 'odd' ELSE bug_type END AS bug_type FROM pairs)
SELECT pair_id, bug_type, coalesce(description, '') AS description, coalesce(suggested_fix, '') AS suggested_fix
FROM p LEFT JOIN d USING (bug_type)""")
def _(t):
    p = t.pairs().select("pair_id", F.when(F.col("pair_id") % 4 == 0, "odd").otherwise(F.col("bug_type")).alias("bug_type"))
    return report.lookup_texts(p)


_PROJECT = "page_id % 12"
_DEPS = f"SELECT {_PROJECT} AS project, {sql_pick(['express', 'Mongoose', 'left-pad', 'jsonwebtoken'], 'page_id')} AS dep FROM pages"


def _files_of(t):
    return t.paths().withColumn("project", F.col("page_id") % 12)


@query("framework_flags", f"""WITH {PATHS}, f AS (SELECT {_PROJECT} AS project, path FROM paths), deps AS ({_DEPS}),
hit AS ({' UNION ALL '.join(f"SELECT project, {quote(n)} AS framework FROM f WHERE " + ' OR '.join(sql_found('path', p) for p in ps)
                            for n, _, ps in L.FRAMEWORKS if ps)} UNION ALL
SELECT project, framework FROM deps JOIN {sql_values([(d, n) for n, ds, _ in L.FRAMEWORKS for d in ds])}
k(dep, framework) ON lower(deps.dep) = k.dep) SELECT DISTINCT project, framework FROM hit""")
def _(t):
    f = _files_of(t)
    deps = f.select("project", B.pick(["express", "Mongoose", "left-pad", "jsonwebtoken"], F.col("page_id"))
                    .alias("dependency"))
    return report.framework_flags(f, dependencies=deps)


_LP = L.LAYOUT_PATTERNS


@query("project_layout", f"""WITH {PATHS}, a AS (SELECT {_PROJECT} AS project,
bool_or({sql_found('path', _LP['front'])}) AS has_frontend, bool_or({sql_found('path', _LP['back'])}) AS has_backend,
bool_or({sql_found('path', _LP['next'])}) AS nx,
bool_or({sql_found('path', _LP['react_file'])} AND {sql_found('path', _LP['react_dir'])}) AS re,
bool_or({sql_found('path', _LP['express_dir'])}) AS ex,
bool_or({sql_found('path', _LP['typescript'])}) AS has_typescript FROM paths GROUP BY 1)
SELECT project, has_frontend, has_backend, has_typescript, CASE WHEN has_frontend AND has_backend THEN 'fullstack-monorepo'
WHEN nx THEN 'next-js' WHEN re AND ex THEN 'fullstack-single' WHEN re THEN 'react-only'
WHEN ex THEN 'express-only' ELSE 'unknown' END AS structure FROM a""")
def _(t):
    return report.project_layout(_files_of(t))


@query("project_profile", f"""WITH {PATHS}, f AS (SELECT {_PROJECT} AS project, path, page_id FROM paths),
a AS (SELECT project, bool_or(page_id % 24 = 1) AS react, bool_or(page_id % 24 = 3) AS express,
bool_or({sql_found('path', L.FRONT_DIRS)}) AS fr, bool_or({sql_found('path', L.BACK_DIRS)}) AS bk
FROM f GROUP BY 1)
SELECT project, fr OR react AS has_frontend, bk OR express AS has_backend, CASE WHEN NOT react AND NOT express
AND NOT ((fr OR react) AND (bk OR express)) THEN 'JavaScript / TypeScript' ELSE concat_ws(' + ',
CASE WHEN react THEN 'React 18' END, CASE WHEN express THEN 'Express.js' END,
CASE WHEN (fr OR react) AND (bk OR express) THEN 'MERN Fullstack Architecture' END) END AS tech_stack FROM a""")
def _(t):
    p = F.col("page_id")
    package = p % 24
    f = _files_of(t)
    rows = f.select("project", "path", F.lit("").alias("content")).unionByName(f.where(package.isin(1, 3)).select(
        "project", F.lit("package.json").alias("path"),
        F.format_string('{"dependencies":{"%s":"1"}}', F.when(package == 1, "react").otherwise("express"))
        .alias("content")))
    return report.project_profile(rows)


@query("union_dependencies", """SELECT DISTINCT page_id % 6 AS project, unnest(['dep' || (page_id % 4),
'dev' || (page_id % 5)]) AS dependency FROM pages""")
def _(t):
    p = F.col("page_id")
    content = F.format_string('{"name":"x","dependencies":{"dep%d":"1"},"devDependencies":{"dev%d":"2"}}', p % 4, p % 5)
    return reshape.union_dependencies(t.pages.select((p % 6).alias("project"), content.alias("c")), "project", "c")


@query("append_dataset", f"""WITH {PAIRS} SELECT bug_type, count(*) AS n, count(extra) AS with_extra FROM (
SELECT bug_type, NULL AS extra FROM pairs UNION ALL SELECT event_type, event_id FROM events) GROUP BY 1""")
def _(t):
    new = t.events.select(F.col("event_type").alias("bug_type"), F.col("event_id").alias("extra"))
    both = reshape.append_dataset(t.pairs().select("bug_type"), new)
    return both.groupBy("bug_type").agg(F.count(F.lit(1)).alias("n"), F.count("extra").alias("with_extra"))


@query("class_balance", """WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT vec_id, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * c.n), 6)::DOUBLE AS weight
FROM embeddings JOIN c USING (label)""")
def _(t):
    return report.class_balance(t.embeddings, "label").select("vec_id", F.round("weight", 6).alias("weight"))


@query("latest_progress", f"""WITH {STEPS}, r AS (SELECT *, row_number() OVER (PARTITION BY scan_id
ORDER BY step DESC, ts DESC, id DESC) AS rn FROM steps) SELECT scan_id, step::BIGINT AS step, id, title
FROM r WHERE rn = 1""")
def _(t):
    p = report.latest_progress(t.steps().select("scan_id", "step", "ts", "id", "title"))
    return p.select("scan_id", F.col("step").cast(LONG).alias("step"), "id", "title")


@query("step_feed", f"""WITH {STEPS}, r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, step
ORDER BY ts, id) AS rn FROM steps) SELECT scan_id, step::BIGINT AS step, id FROM r WHERE rn = 1""")
def _(t):
    return report.step_feed(t.steps()).select("scan_id", F.col("step").cast(LONG).alias("step"), "id")


@query("find_samples", f"""WITH {PAIRS}, m AS (SELECT * FROM pairs WHERE contains(lower(bug_type), 'error'))
SELECT pair_id, bug_type, (SELECT count(*) FROM m) AS total FROM m ORDER BY pair_id LIMIT 20""")
def _(t):
    return report.find_samples(t.pairs(), "ERROR", "pair_id").select("pair_id", "bug_type", "total")


@query("search_samples", f"""WITH {PAIRS} SELECT pair_id FROM pairs WHERE bug_type = 'logic_error'
AND (contains(lower(repository), 'al') OR contains(lower(message), 'al') OR contains(lower(bug_type), 'al'))""")
def _(t):
    s = report.search_samples(t.pairs(), "AL", "logic_error", ("bug_type", "repository", "message"))
    return s.select("pair_id")


@query("get_scan", f"WITH {LEDGER} SELECT method_id, file_path FROM ledger WHERE scan_id = 7")
def _(t):
    return report.get_scan(t.ledger(), 7).select("method_id", "file_path")


@query("stored_scan", f"WITH {LEDGER} SELECT method_id, file_path FROM ledger WHERE scan_id = 7")
def _(t):
    path = new_table_path(t.spark, "scans")
    sinks.write_scans(t.ledger(), path)
    return report.get_scan(t.spark.read.parquet(path), 7).select("method_id", "file_path")


# --- splits ------------------------------------------------------------------------------------------------

def hash_sql(key: str, seed: int = 42) -> str:
    m = 2147483647
    once = f"((({key}) % {m} * 48271 + {seed}) % {m})"
    return f"(({once} * 69621 + {seed}) % {m})"


@query("stratified_split", f"""WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label
ORDER BY {hash_sql('vec_id')}, vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT vec_id, rn <= ceil(n * 0.2::DOUBLE) AS is_test FROM r""")
def _(t):
    return splits.stratified_split(t.embeddings, "label", "vec_id").select("vec_id", "is_test")


@query("stratified_kfold", f"""SELECT vec_id, (row_number() OVER (PARTITION BY label
ORDER BY {hash_sql('vec_id')}, vec_id) - 1) % 5 AS fold FROM embeddings""")
def _(t):
    return splits.stratified_kfold(t.embeddings, "label", "vec_id").select(
        "vec_id", F.col("fold").cast(LONG).alias("fold"))


@query("group_split", f"""SELECT event_id, {hash_sql('user_id')} % 100 < 20 AS is_test FROM events""")
def _(t):
    return splits.group_split(t.events, F.col("user_id")).select("event_id", "is_test")


@query("group_kfold", """WITH RECURSIVE g AS (SELECT user_id, count(*) AS n, row_number() OVER
(ORDER BY count(*) DESC, user_id) AS i FROM events GROUP BY 1), w(i, user_id, fold, loads) AS (
SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, [0, 0, 0, 0, 0]::BIGINT[] UNION ALL
SELECT g.i, g.user_id, list_position(loads, list_min(loads)) - 1, list_transform(loads,
lambda x, j: x + CASE WHEN j = list_position(loads, list_min(loads)) THEN g.n ELSE 0 END)
FROM w JOIN g ON g.i = w.i + 1) SELECT event_id, fold::BIGINT AS fold FROM events JOIN w USING (user_id)""")
def _(t):
    return splits.group_kfold(t.events, "user_id").select("event_id", F.col("fold").cast(LONG).alias("fold"))


@query("encode_label", """SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS label_index FROM part""")
def _(t):
    return splits.encode_label(t.part, "p_brand").select("p_partkey", F.col("label_index").cast(LONG).alias("label_index"))


@query("standardise", """WITH x AS (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)),
s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS d FROM x GROUP BY i)
SELECT vec_id, i::BIGINT AS i, round((x - m) / d, 5) + 0 AS z FROM x JOIN s USING (i)""")
def _(t):
    e = t.embeddings
    z = splits.standardise(e, "embedding", splits.fit_scale(e, "embedding", 64))
    cells = z.select("vec_id", F.posexplode("scaled").alias("p", "z"))
    return cells.select("vec_id", (F.col("p") + 1).cast(LONG).alias("i"), F.round("z", 5).alias("z"))


# --- evaluation: nearest class mean as the prediction ---------------------------------------------------------

RANKED = """means AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i)
GROUP BY 1, 2), cent AS (SELECT label AS c, list(m ORDER BY i) AS v FROM means GROUP BY 1),
sim AS (SELECT vec_id, e.label, c, round(list_dot_product(embedding::DOUBLE[], v) /
sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(v, v)), 9) AS s
FROM embeddings e, cent), ranked AS (SELECT vec_id, label, c AS prediction, s, row_number() OVER
(PARTITION BY vec_id ORDER BY s DESC, c) AS rank FROM sim), pred AS (SELECT * FROM ranked WHERE rank = 1)"""


def ranked(t):
    e = t.embeddings
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.avg(F.col("x").cast("double")).alias("m"))
    classes = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c")).select(
        F.col("label").alias("vec_id"), F.col("c.m").alias("embedding"))
    top = retrieval.vector_topk(e, classes, "vec_id", "embedding", 64, 3)
    return top.join(e.select(F.col("vec_id").alias("target_id"), "label"), "target_id").select(
        F.col("target_id").alias("vec_id"), "label", F.col("reference_id").cast("int").alias("prediction"),
        "score", "rank")


def _pred(t):
    return ranked(t).where("rank = 1")


@query("accuracy", f"WITH {RANKED} SELECT round(avg((label = prediction)::INT), 6) AS accuracy FROM pred")
def _(t):
    return evaluate.accuracy(_pred(t)).withColumn("accuracy", F.round("accuracy", 6))


@query("confusion", f"WITH {RANKED} SELECT label::BIGINT AS label, prediction::BIGINT AS prediction, "
                    "count(*) AS n FROM pred GROUP BY 1, 2")
def _(t):
    return evaluate.confusion(_pred(t)).select(F.col("label").cast(LONG), F.col("prediction").cast(LONG), "n")


@query("confusion_matrix", f"WITH {RANKED} SELECT label::BIGINT AS label, " + ", ".join(
    f'count(*) FILTER (WHERE prediction = {i}) AS "p{i}"' for i in range(10)) + " FROM pred GROUP BY 1")
def _(t):
    m = evaluate.confusion_matrix(_pred(t), list(range(10)))
    return m.select(F.col("label").cast(LONG), *[F.col(str(i)).alias(f"p{i}") for i in range(10)])


@query("class_report", f"""WITH {RANKED}, k AS (SELECT DISTINCT label AS c FROM pred UNION SELECT DISTINCT prediction FROM pred),
a AS (SELECT c, (SELECT count(*) FROM pred WHERE label = c) AS s, (SELECT count(*) FROM pred WHERE prediction = c) AS p,
(SELECT count(*) FROM pred WHERE label = c AND prediction = c) AS t FROM k),
b AS (SELECT c, s, CASE WHEN p > 0 THEN t / p ELSE 0 END AS pr, CASE WHEN s > 0 THEN t / s ELSE 0 END AS re FROM a),
d AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f FROM b),
e AS (SELECT c::VARCHAR AS class, pr, re, f, s FROM d UNION ALL SELECT 'macro avg', avg(pr), avg(re), avg(f), sum(s) FROM d
UNION ALL SELECT 'weighted avg', sum(pr * s) / sum(s), sum(re * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM d)
SELECT class, round(pr, 6) AS "precision", round(re, 6) AS recall, round(f, 6) AS f1, s::BIGINT AS support FROM e""")
def _(t):
    return evaluate.class_report(_pred(t)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("roc_auc", """WITH x AS (SELECT quality AS y, n_chars % 500 AS s FROM labels JOIN documents USING (doc_id)),
p AS (SELECT s FROM x WHERE y = 1), n AS (SELECT s FROM x WHERE y = 0)
SELECT round(sum(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) AS roc_auc
FROM p, n""")
def _(t):
    x = t.labels.join(t.documents, "doc_id").select("quality", ((F.col("n_chars") % 500) / 500).alias("s"))
    return evaluate.roc_auc(x, "quality", "s").withColumn("roc_auc", F.round("roc_auc", 6))


@query("top3_accuracy", f"""WITH {RANKED} SELECT round(avg(h), 6) AS top3_accuracy FROM (SELECT vec_id,
max((label = prediction)::INT) AS h FROM ranked WHERE rank <= 3 GROUP BY 1)""")
def _(t):
    return evaluate.topk_accuracy(ranked(t), "vec_id", "label", "prediction").withColumn(
        "top3_accuracy", F.round("top3_accuracy", 6))


@query("cv_summary", """SELECT event_type AS model, round(avg(value), 6) AS mean,
round(stddev_pop(value), 6) AS deviation FROM events GROUP BY 1""")
def _(t):
    c = evaluate.cv_summary(t.events, "event_type", "value")
    return c.select(F.col("event_type").alias("model"), F.round("mean", 6).alias("mean"),
                    F.round("deviation", 6).alias("deviation"))


@query("best_model", """SELECT event_type AS model, round(avg(value), 4) AS score FROM events GROUP BY 1
ORDER BY avg(value) DESC, event_type LIMIT 1""")
def _(t):
    r = t.events.groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("score"))
    return evaluate.best_model(r, "score", "model").withColumn("score", F.round("score", 4))


@query("top_predictions", """WITH p AS (SELECT vec_id, [abs(embedding[i]::DOUBLE) for i in range(1, 5)] AS v FROM embeddings),
r AS (SELECT vec_id, i, v[i] AS x, row_number() OVER (PARTITION BY vec_id ORDER BY v[i] DESC, i) AS rank
FROM p, range(1, 5) r(i)) SELECT vec_id, rank, (['null_pointer', 'off_by_one', 'type_error', 'api_misuse'])[i] AS bug_type,
round(x, 6) AS probability FROM r WHERE rank <= 3""")
def _(t):
    v = F.transform(F.slice("embedding", 1, 4), lambda x: F.abs(x.cast("double")))
    top = reshape.top_predictions(t.embeddings.select("vec_id", v.alias("p")), "p",
                                  ["null_pointer", "off_by_one", "type_error", "api_misuse"])
    return top.select("vec_id", F.col("rank").cast(LONG).alias("rank"), "bug_type",
                      F.round("probability", 6).alias("probability"))


@query("swap_pairs", f"""WITH {EPAIRS} SELECT vec_id, label::BIGINT AS label, round(f[1], 6) + 0 AS head,
round(f[128], 6) + 0 AS tail FROM (SELECT vec_id, 0 AS label, list_concat(x, y) AS f FROM epairs UNION ALL
SELECT vec_id, 1, list_concat(y, x) FROM epairs)""")
def _(t):
    s = reshape.swap_pairs(epairs(t).drop("label"), "x", "y")
    return s.select("vec_id", F.col("label").cast(LONG).alias("label"),
                    F.round(F.get("features", F.lit(0)), 6).alias("head"),
                    F.round(F.get("features", F.lit(127)), 6).alias("tail"))


@query("soft_vote", """WITH v AS (SELECT vec_id, [(embedding[i]::DOUBLE + embedding[i + 8]::DOUBLE) / 2
for i in range(1, 5)] AS p FROM embeddings)
SELECT vec_id, (list_position(p, list_max(p)) - 1)::DOUBLE AS prediction, round(list_max(p), 6) AS probability FROM v""")
def _(t):
    from patchlens.operators.models import soft_vote
    e = F.col("embedding").cast("array<double>")
    v = soft_vote(t.embeddings.select("vec_id", F.slice(e, 1, 4).alias("a"), F.slice(e, 9, 4).alias("b")), "a", "b")
    return v.select("vec_id", "prediction", F.round(F.array_max("probabilities"), 6).alias("probability"))
