"""Rule tables compiled into column expressions: category scores and label ladders."""
from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchlens.functions.patterns import (
    any_literal, any_word, bind, folded, found, ladder, required_literal,
)
from patchlens.rules import ladders as R
from patchlens.rules import lexicon as L
from patchlens.rules.categories import CATEGORY_RULES, FIX_SIGNALS, Rule


def is_fix_commit(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return ~any_word(low, L.NON_FIX_WORDS) & any_word(low, L.FIX_WORDS)


def haystack(diff: Column, after: Column, message: Column) -> Column:
    return F.concat_ws("\n", diff, after, message)


def has_fix_signal(text: Column, signals: list[Rule] = FIX_SIGNALS) -> Column:
    return reduce(or_, [found(text, s.pattern, s.flags) for s in signals])


def meaningful_diff(before: Column, after: Column) -> Column:
    def bare(c):
        return F.regexp_replace(c, r"(?U)[\s;]", "")

    return bare(before) != bare(after)


def _seen(rule: Rule, texts: Column, name: str) -> Column:
    """Regex test of one bound text, behind a literal test that spares most of them."""
    test = found(texts[name], rule.pattern, rule.flags)
    word = required_literal(rule.pattern)
    if word is None:
        return test
    if "i" in rule.flags:
        return texts[f"{name}_folded"].contains(word.lower()) & test
    return texts[name].contains(word) & test


def _points(rule: Rule, texts: Column) -> Column:
    """3 when new in the after-text, 1 when only mentioned. The after-text is part of `all`."""
    fresh = F.when(_seen(rule, texts, "before"), 1).otherwise(3)
    return (F.when(_seen(rule, texts, "after"), fresh)
            .when(_seen(rule, texts, "all"), 1).otherwise(0))


def candidate_scores(diff, before, after, message, rules: list[Rule] = CATEGORY_RULES) -> Column:
    """Array of (category, rank, score) in rule order, one entry per category."""
    texts = {"before": before, "after": after, "all": haystack(diff, after, message)}
    texts |= {f"{n}_folded": folded(c) for n, c in texts.items()}
    groups: dict[str, list[Rule]] = {}
    for rule in rules:
        groups.setdefault(rule.category, []).append(rule)

    def score_all(t):
        return F.array(*[
            F.struct(F.lit(name).alias("category"), F.lit(rank).alias("rank"),
                     reduce(lambda a, b: a + b, [_points(r, t) for r in group]).alias("score"))
            for rank, (name, group) in enumerate(groups.items())])

    return bind(texts, score_all)


def ranked_candidates(scores: Column, keep: int = 4) -> Column:
    """Best categories by score (ties in rule order) and the lead over the runner-up."""
    positive = F.filter(scores, lambda s: s["score"] > 0)
    order = F.array_sort(F.transform(positive, lambda s: F.struct(
        (-s["score"]).alias("key"), s["rank"].alias("rank"), s["category"].alias("category"))))

    def build(o):
        best = F.coalesce(-F.get(o, F.lit(0))["key"], F.lit(0))
        second = F.coalesce(-F.get(o, F.lit(1))["key"], F.lit(0))
        return F.struct(
            F.transform(F.slice(o, 1, keep), lambda s: s["category"]).alias("candidates"),
            (best - second).alias("margin"), best.alias("top_score"))

    return bind({"o": order}, lambda t: build(t["o"]))


def condition(spec, fields: dict[str, Column]) -> Column:
    """Compile a condition tuple of the ladder tables."""
    op, *args = spec
    if op == "and":
        return reduce(and_, [condition(a, fields) for a in args])
    if op == "or":
        return reduce(or_, [condition(a, fields) for a in args])
    if op == "not":
        return ~condition(args[0], fields)
    field = fields[args[0]]
    if op == "has":
        return field.contains(args[1])
    if op == "any":
        return any_literal(field, args[1])
    return found(field, args[1])


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def classify_ladder(diff, before, after, message, steps=R.DIVERSE_LADDER) -> Column:
    """First matching row of the ladder as a struct of type and texts."""
    fields = {"before": _text(before), "after": after, "after_lower": F.lower(after),
              "diff_lower": F.lower(diff), "message_lower": F.lower(_text(message))}
    names = ["bug_type", "bug_description", "root_cause", "fix_description", "bug_pattern"]

    def row(values):
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values)])

    *checked, (_, last) = steps
    return ladder([(condition(c, fields), row(v)) for c, v in checked], row(last))


def relabel_step(before, after, message, label, path) -> Column:
    """Number of the first relabelling step that applies; 13 when none does."""
    before, after, path = _text(before), _text(after), _text(path)
    fields = {
        "text": F.lower(F.concat_ws("\n", _text(message), before, after)),
        "diff": F.lower(F.concat(before, F.lit(" -> "), after)),
        "label": F.lower(_text(label)), "path": path}
    return ladder([(condition(c, fields), F.lit(i)) for i, c in enumerate(R.RELABEL_STEPS, 1)],
                  F.lit(len(R.RELABEL_STEPS) + 1))


def relabel(before, after, message, label, path) -> Column:
    """Relabelling result as a struct. The step is bound once, texts hang off a literal map."""
    text = F.lower(F.concat_ws("\n", _text(message), _text(before), _text(after)))
    names = ["bug_type", "bug_pattern", "root_cause", "fix_description", "severity",
             "confidence_score"]
    fallback = ladder([(F.lower(_text(label)) == k, F.lit(v))
                       for k, v in R.FALLBACK_LABELS.items()], F.lit("logic_error"))

    def build(step):
        def row(i, values):
            cols = dict(zip(names, map(F.lit, values)))
            if i in R.RELABEL_RAISED:
                raised, words = R.RELABEL_RAISED[i]
                cols["severity"] = F.when(any_literal(text, words), raised).otherwise(
                    cols["severity"])
            if i == len(R.RELABEL_TEXTS):
                cols["bug_type"] = fallback
            return F.struct(F.lit(i).alias("step"), *[cols[n].alias(n) for n in names])

        rows = [(i, row(i, values)) for i, values in R.RELABEL_TEXTS.items()]
        return ladder([(step == i, r) for i, r in rows[:-1]], rows[-1][1])

    return bind({"step": relabel_step(before, after, message, label, path)},
                lambda t: build(t["step"]))
