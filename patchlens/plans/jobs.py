"""Composite jobs: mining, enrichment, cleaning, indexing, scanning, reporting."""
from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.functions import labels as lx
from patchlens.functions import text as fx
from patchlens.functions import vectors as vx
from patchlens.functions.patterns import squeeze
from patchlens.operators import mining, quality, repair, report, reshape, slicing, tfidf
from patchlens.operators.grouping import top_per_group
from patchlens.operators.retrieval import gate, hybrid_top1
from patchlens.rules import lexicon as L
from patchlens.rules.categories import (
    CATEGORY_RULES, HEURISTIC_CAPS, HEURISTIC_RULES, HEURISTIC_TEXTS,
)
from patchlens.session import settle
from patchlens.sources import sinks
from patchlens.sources.readers import commit_files


EXTRACTOR = "tier_3_tokens"  # both sides of every vector come from the one token extractor


class LabelScorer(Protocol):
    """Gives each candidate row a `label` struct (decision, bug_type, confidence, root_cause,
    bug_description, fix_description, severity, evidence), null where it has no answer."""

    def score(self, candidates: DataFrame) -> DataFrame: ...


@dataclass
class RuleScorer:
    """Scorer on the relabelling ladder: accepts the ladder's type with its confidence."""

    def score(self, candidates: DataFrame) -> DataFrame:
        best = F.get(F.col("candidates"), F.lit(0))
        made = candidates.withColumn("_r", lx.relabel(
            F.col("buggy_code"), F.col("fixed_code"), F.col("message"), best, F.col("file_path")))
        r = F.col("_r")
        return made.withColumn("label", F.struct(
            F.lit("accept").alias("decision"), r["bug_type"].alias("bug_type"),
            r["confidence_score"].alias("confidence"), r["root_cause"].alias("root_cause"),
            r["bug_pattern"].alias("bug_description"),
            r["fix_description"].alias("fix_description"), r["severity"].alias("severity"),
            F.array(r["bug_pattern"]).alias("evidence"))).drop("_r")


@dataclass
class AnswerScorer:
    """Scorer on landed JSON answers of an offline model, joined by key and checked."""

    answers: DataFrame
    key: str
    response: str = "response"

    def score(self, candidates: DataFrame) -> DataFrame:
        landed = self.answers.select(self.key, F.col(self.response).alias("_answer"))
        return candidates.join(landed, self.key, "left").withColumn(
            "label", fx.validate_label(fx.extract_json_object(F.col("_answer")))).drop("_answer")


@dataclass
class FallbackScorer:
    """First scorer, then the second for rows the first left without a label."""

    first: LabelScorer
    second: LabelScorer

    def score(self, candidates: DataFrame) -> DataFrame:
        once = settle(self.first.score(candidates), "labels")
        rest = self.second.score(once.where("label IS NULL").drop("label"))
        return once.where("label IS NOT NULL").unionByName(rest)


def mine_pairs(commits: DataFrame, files: DataFrame, scorer: LabelScorer,
               existing: DataFrame | None = None, caps: dict[str, int] = L.CATEGORY_CAPS,
               per_repository: int = L.DEFAULT_PER_REPOSITORY, target: int | None = None
               ) -> DataFrame:
    """Landed commits to labelled pairs of whole functions.

    `commits` is a commit log; `files` holds file texts as (repository, ref, path, content);
    `existing` is the prior output, which names known commits and takes up room under the caps.
    Cheap tests come first; texts are fetched and walked only for files of surviving hunks.
    """
    kept = quality.drop_blocked_owners(mining.first_fix_commits(commits))
    room = {}
    if existing is not None:
        past = mining.existing_counts(existing)
        kept = mining.skip_known_commits(
            kept, past["commits"].withColumnRenamed("commit_hash", "sha"), "sha")
        room = {"repository_counts": past["repositories"],
                "category_counts": past["types"].withColumnRenamed("bug_type", "_type")}
    changed = commit_files(kept)
    hunks = reshape.hunk_pairs(quality.patch_size_filter(changed))
    # scores are stored before the filter on them: pushed down, it would score every hunk twice
    ranked = settle(hunks.withColumn("_r", _ranked("patch", "before", "after", "message")), "ranked")
    hunks = ranked.where("size(_r.candidates) > 0").select(
        F.xxhash64("repository", "commit_hash", "filename", "source_start", "target_start")
        .alias("hunk_id"), "repository", "position", "file_no", "commit_hash", "parent_sha",
        F.col("filename").alias("file_path"), "message", "patch", "source_start", "source_length",
        "target_start", "target_length", F.col("_r.candidates").alias("candidates"),
        F.col("_r.margin").alias("match_margin"))
    both = _with_functions(hunks, files)
    both = both.withColumns({"buggy_code": slicing.strip_comments(F.col("buggy_code")),
                             "fixed_code": slicing.strip_comments(F.col("fixed_code"))})
    # no code is left out for a zero vector: its size slot is above 0 for any text
    both = settle(both, "functions").where(
        lx.meaningful_diff(F.col("buggy_code"), F.col("fixed_code")))
    order = ["repository", "position", "file_no", "source_start"]
    both = quality.dedupe_pairs(both, ["repository", "commit_hash"], "buggy_code", "fixed_code",
                                [F.col(c) for c in order])
    featured = both.withColumns({
        "buggy_vector": vx.token_vector64(F.col("buggy_code")),
        "fixed_vector": vx.token_vector64(F.col("fixed_code")),
        "ast_tier": quality.joint_tier(F.lit(EXTRACTOR), F.lit(EXTRACTOR))})
    labelled = settle(quality.accept_label(scorer.score(featured)), "labelled")
    capped = mining.cap_per_group(
        labelled.withColumn("_type", F.col("label.bug_type")), "_type", "repository", order, caps,
        per_repository=per_repository, target=target, **room)
    return mining.build_record(capped)


def _ranked(diff, before, after, message, rules=CATEGORY_RULES):
    """Ranked candidates, none when the change is only white space or shows no sign of a fix."""
    d, b, a, m = map(F.col, (diff, before, after, message))
    none = F.array().cast("array<struct<category:string,rank:int,score:int>>")
    worth = lx.meaningful_diff(b, a) & lx.has_fix_signal(lx.haystack(d, a, m))
    return lx.ranked_candidates(
        F.when(worth, lx.candidate_scores(d, b, a, m, rules)).otherwise(none))


def _with_functions(hunks: DataFrame, files: DataFrame) -> DataFrame:
    """Enclosing function of each hunk on both sides; hunks lacking one go."""
    out = hunks
    for side, ref, start, length in (("buggy_code", "parent_sha", "source_start", "source_length"),
                                     ("fixed_code", "commit_hash", "target_start", "target_length")):
        wanted = hunks.select("repository", F.col(ref).alias("ref"), F.col("file_path").alias("path")
                              ).distinct()
        texts = files.join(wanted, ["repository", "ref", "path"], "left_semi")
        spans = settle(slicing.all_spans(texts.select("repository", "ref", "path", "content")), "spans")
        totals = texts.select("repository", "ref", "path",
                              F.size(F.split("content", "\n")).alias("line_total"))
        first = F.greatest(F.col(start), F.lit(1))
        changes = hunks.select(
            "hunk_id", "repository", F.col(ref).alias("ref"), F.col("file_path").alias("path"),
            first.alias("start"),
            (first + F.greatest(F.col(length) - 1, F.lit(0))).alias("end")).join(
            totals, ["repository", "ref", "path"])
        found = slicing.enclosing_function(changes, spans, ["repository", "ref", "path"], "hunk_id")
        out = out.join(found.select("hunk_id", F.col("function_code").alias(side)), "hunk_id")
    return out


def mine_pairs_heuristic(commits: DataFrame, caps: dict[str, int] = HEURISTIC_CAPS,
                         per_repository: int = L.DEFAULT_PER_REPOSITORY, limit: int = 25,
                         counts: DataFrame | None = None) -> DataFrame:
    """Hunk snippets labelled by the looser rules; ties go to the category with most room."""
    kept = quality.drop_blocked_owners(mining.first_fix_commits(commits))
    hunks = reshape.hunk_pairs(quality.patch_size_filter(commit_files(kept), limit=limit))
    room = dict(caps)
    if counts is not None:  # at most one row per category
        rows = mining.category_room(counts, caps).collect()
        room = {r["bug_type"]: r["room"] for r in rows}
    scores = lx.candidate_scores(F.col("patch"), F.col("before"), F.col("after"), F.col("message"),
                                 HEURISTIC_RULES)
    texts = F.create_map(*[x for c, t in HEURISTIC_TEXTS.items()
                           for x in (F.lit(c), F.array(*map(F.lit, t)))])
    typed = hunks.withColumn("bug_type", mining.best_category_by_need(scores, room))
    capped = mining.cap_per_group(typed, "bug_type", "repository",
                                  ["repository", "position", "file_no", "source_start"], caps,
                                  per_repository=per_repository, category_counts=counts)
    words = texts[F.col("bug_type")]
    return capped.select(
        "repository", "commit_hash", F.col("filename").alias("file_path"),
        fx.language_of(F.col("filename")).alias("language"), "bug_type",
        F.substring(F.replace(squeeze(F.col("message")), F.lit("\n"), F.lit(" ")), 1, 300)
        .alias("original_commit_message"),
        F.col("before").alias("buggy_code"), F.col("after").alias("fixed_code"),
        vx.vector_json(vx.token_vector120(F.col("before"))).alias("buggy_ast_vector"),
        vx.vector_json(vx.token_vector120(F.col("after"))).alias("fixed_ast_vector"),
        words[0].alias("bug_description"), words[1].alias("root_cause"),
        words[2].alias("fix_description"), F.lit("medium").alias("severity"),
        words[3].alias("bug_pattern"),
        fx.component_simple(F.col("filename")).alias("affected_component"),
        F.lit(0.88).alias("confidence_score"))


def mine_pairs_diverse(commits: DataFrame, per_repository: int = 2,
                       existing: DataFrame | None = None) -> DataFrame:
    """Whole-patch pairs with a strict repository limit, labelled by the ordered ladder. The
    before-text is the patch reversed, the after-text the patch applied."""
    kept = quality.drop_blocked_owners(mining.first_fix_commits(commits))
    changed = quality.patch_size_filter(commit_files(kept))
    lines = F.split("patch", "\n")
    swapped = F.array_join(F.transform(lines, lambda x: F.when(
        x.startswith("+"), F.concat(F.lit("-"), F.substring(x, F.lit(2), F.length(x))))
        .when(x.startswith("-"), F.concat(F.lit("+"), F.substring(x, F.lit(2), F.length(x))))
        .otherwise(x)), "\n")
    pairs = changed.withColumns({"before": reshape.reverse_patch(F.col("patch")),
                                 "after": reshape.reverse_patch(swapped)})
    pairs = pairs.where("before <> '' AND after <> '' AND before <> after")
    typed = pairs.withColumn("_v", lx.classify_ladder(F.col("patch"), F.col("before"),
                                                      F.col("after"), F.col("message")))
    counts = None
    if existing is not None:
        counts = existing.groupBy("repository").agg(F.count(F.lit(1)).alias("n"))
    order = ["repository", "position", "file_no"]
    rows = top_per_group(typed, ["repository"], [F.col(c) for c in order], per_repository, order)
    if counts is not None:
        rows = rows.join(counts, "repository", "left").where(
            F.col("rank") <= per_repository - F.coalesce("n", F.lit(0)))
    new = rows.select("repository", "commit_hash", F.col("filename").alias("file_path"),
                      F.col("before").alias("buggy_code"), F.col("after").alias("fixed_code"),
                      "_v.*", F.lit("medium").alias("severity"),
                      F.lit(0.88).alias("confidence_score"))
    return new if existing is None else reshape.append_dataset(existing, new)


def enrich_pairs(pairs: DataFrame) -> DataFrame:
    """Relabel, describe and place every pair."""
    r = F.col("_r")
    made = pairs.withColumn("_r", lx.relabel(
        F.col("buggy_code"), F.col("fixed_code"), F.col("original_commit_message"),
        F.col("bug_type"), F.col("file_path")))
    return made.withColumns({
        "bug_description": fx.describe_defect(
            F.col("repository"), F.col("file_path"), r["bug_type"], r["bug_pattern"],
            r["root_cause"], r["fix_description"]),
        "affected_component": fx.component_of(F.col("file_path"), F.col("repository")),
        "root_cause": r["root_cause"], "fix_description": r["fix_description"],
        "severity": r["severity"], "bug_pattern": r["bug_pattern"],
        "confidence_score": fx.clamp01(r["confidence_score"]), "bug_type": r["bug_type"],
    }).drop("_r")


def clean_revectorise(pairs: DataFrame, key: str, shortest: int = 15) -> DataFrame:
    """Quality filters, then both vectors anew."""
    clean = quality.quality_filter(pairs, key, shortest=shortest)
    return clean.withColumns({
        "buggy_ast_vector": vx.vector_json(vx.token_vector120(F.col("buggy_code"))),
        "fixed_ast_vector": vx.vector_json(vx.token_vector120(F.col("fixed_code"))),
        "buggy_tier": F.lit(EXTRACTOR), "fixed_tier": F.lit(EXTRACTOR)})


def index_pairs(samples: DataFrame, max_terms: int = L.RETRIEVAL_TERMS
                ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples to (index rows, vocabulary, term weights)."""
    pairs = settle(reshape.assemble_pairs(samples), "pairs")
    vector = vx.fit_dim(F.coalesce(F.from_json("ast_vector", "array<double>"),
                                   F.array().cast("array<double>")), 64)
    rows = sinks.index_rows(pairs.withColumn("vector", vector), "pair_id", "vector", 64)
    grams = pairs.select("pair_id", tfidf.word_grams(F.col("buggy_code_chunk")).alias("grams"))
    vocabulary = settle(tfidf.tfidf_fit(grams, max_terms=max_terms), "vocabulary")
    return rows, vocabulary, tfidf.tfidf_transform(grams, vocabulary, "pair_id")


@dataclass
class Scan:
    """Tables of a scan job: one ledger row per method, findings, files, summary."""

    ledger: DataFrame
    findings: DataFrame
    files: DataFrame
    summary: DataFrame

    def documents(self) -> DataFrame:
        return sinks.nested_scan_documents(self.files, self.ledger, self.findings, self.summary,
                                           "scan_id", "file_path", "method_id")


def scan_files(files: DataFrame, references: DataFrame, threshold: float = L.GATE_THRESHOLD,
               small_scans: bool = True) -> Scan:
    """Files (scan_id, path, content) against known pairs (pair_id, commit_id, bug_type, severity,
    buggy_code_chunk): slice, score, gate, repair, regroup, summarise.

    Features and scores are written once; the ledger, findings and summary all read that table.
    """
    sources = files.where(quality.is_source_file(F.col("path"), L.SCAN_IGNORED_DIRS,
                                                 [*L.SOURCE_EXTENSIONS, "mjs"]))
    methods = slicing.slice_methods(sources.select("scan_id", F.col("path").alias("file_path"),
                                                   "content"))
    methods = methods.withColumn("method_id", F.xxhash64("scan_id", "file_path", "line_start"))
    methods = settle(methods, "methods")
    kept = tuple(c for c in methods.columns if c != "method_id")
    best = hybrid_top1(methods, references, "method_id", "pair_id", "code", "buggy_code_chunk",
                       carry=kept)
    shape = F.col("shape")
    scored = (best.withColumnsRenamed({"target_id": "method_id", "score": "raw"})
              .withColumn("score", F.when(F.col("reference_id").isNull(), 0.0).otherwise(
                  fx.calibrated_score(F.col("raw"), fx.defect_score(F.col("code")))))
              .withColumn("shape", vx.complexity_proxy(F.col("code"))))
    twins = references.select(F.col("pair_id").alias("reference_id"), "commit_id",
                              F.col("bug_type").alias("twin_type"),
                              F.col("severity").alias("twin_severity"))
    gated = settle(gate(scored.join(twins, "reference_id", "left"), "scan_id", threshold, small_scans),
                   "gated")
    ledger = gated.select(
        "scan_id", "method_id", "method_name", "file_path", "line_start", "line_end",
        shape["complexity"].alias("complexity"), shape["max_depth"].alias("max_depth"),
        F.bround("score", 4).alias("similarity_score"), "suspicious",
        F.col("verdict").alias("gatekeeper_verdict"),
        F.coalesce("commit_id", F.lit("N/A")).alias("matched_historical_twin"),
        F.col("cost_saved").alias("cost_saved_usd"))
    work = gated.where("suspicious").withColumn("content_key", fx.content_key(
        F.col("code"), F.coalesce("twin_type", F.lit("Logic Defect"))))
    # equal code with equal twin type is repaired once per path role; the rewrite is a pure function
    fixed = repair.repair_rules(work, "code", "file_path", "twin_type", "twin_severity")
    findings = fixed.where("is_bug").select(
        "scan_id", "method_id", "file_path", "method_name", "line_start", "line_end",
        fx.method_role(F.col("file_path"), F.col("code")).alias("role"),
        F.col("repair_type").alias("bug_type"), F.col("repair_severity").alias("severity_level"),
        "explanation", F.col("code").alias("original_code"), "suggested_code",
        F.bround("verify_score", 4).alias("confidence_score"), "content_key")
    hits = findings.groupBy("scan_id", "file_path").agg(F.count(F.lit(1)).alias("findings"))
    per_file = methods.groupBy("scan_id", "file_path").agg(F.count(F.lit(1)).alias("method_count"))
    named = sources.select("scan_id", F.col("path").alias("file_path")).distinct()  # blank files too
    tree = (named.join(per_file, ["scan_id", "file_path"], "left").join(hits, ["scan_id", "file_path"], "left")
            .na.fill(0, ["method_count", "findings"]).withColumn("is_buggy", F.col("findings") > 0))
    return Scan(ledger, findings, tree, report.scan_summary(ledger, ["scan_id"], files=named))


def issue_report_job(files: DataFrame, *feeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and parsed tool feeds to (files with issue counts, count report)."""
    kept = files.where(quality.is_source_file(F.col("path"))).select(
        "path", fx.file_role(F.col("path")).alias("role"),
        F.size(F.split(F.coalesce("content", F.lit("")), "\n")).alias("lines"))
    issues = reshape.union_engines(*feeds)
    return report.attach_issues(kept, issues), report.issue_report(issues)

