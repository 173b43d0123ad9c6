"""Toxicity: Levenshtein automata intersected with a trie of lexicon terms, and context windows around the hits.

The intersection is made deterministic once and then run over the letters of all words of a batch at a time. Terms
are seeds plus words and stems that set toxic training documents apart. Hits are counted by kind and context, and a
small logistic model with a prior turns the counts into a score.

Edge cases: a null or empty text has no hits and gets the score of the bias; label rows without a label are left
out; without labelled rows the prior decides; repeated rows each give their row; an empty table gives no rows; other
columns are ignored.
"""
from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.ftrl import held_out, labelled_sample

#: Labelled rows fitted on, at most; and terms learned from them.
MAX_TRAIN = 12_000
MAX_TERMS = 150
SEEDS = ("idiot moron stupid dumb imbecile loser scum trash garbage clown pathetic worthless disgusting vermin "
         "filth filthy retard scumbag bastard bitch asshole shithead dickhead cunt whore slut").split()
#: Words that report speech: near a hit they tell quotation from abuse. And words that address someone.
REPORTING = frozenset("said says wrote writes quote quotes quoted called calls term word words phrase alleged".split())
ADDRESS = frozenset("you your you're youre yourself u ur".split())
QUOTES = frozenset("\"'`“”‘’«»„")
SPAN = 5  # words looked at on either side
SLICE = 1 << 19
#: Kinds of hits: 1 a term, 2 near a term, 3 a stem and whatever follows, 4 near a stem and whatever follows.
KINDS = 4
FEATURES = ("exact", "near", "stem", "near_stem", "exact_rate", "near_rate", "stem_rate", "near_stem_rate", "addressed",
            "quoted", "bias")
PRIOR = np.array([3.0, 1.5, 0.5, 0.25, 3.0, 1.5, 1.0, 0.5, 1.0, -1.0, -3.0])

_LETTER = np.zeros(0x3000, bool)
_LOWER = np.arange(0x3000, dtype=np.uint32)
for _c in range(0x3000):
    _LETTER[_c] = chr(_c).isalpha()
    if len(chr(_c).lower()) == 1:
        _LOWER[_c] = min(ord(chr(_c).lower()), 0x2FFF)
_DIGIT = np.zeros(0x3000, bool)
_DIGIT[ord("0"):ord("9") + 1] = True
_SIGN = np.zeros(0x3000, bool)
_SIGN[[ord(c) for c in "@$!*"]] = True


def edits(term: str) -> int:
    """Misspellings allowed: none in short terms, then one, two in long ones."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Deterministic automaton of all strings near a term. terms: (text, is it a stem).

    A state is a set of (trie node, edits so far); a stem accepts whatever follows it, or follows a misspelling of it
    (nodes -1 and -2). `accept` gives the kind of the best match of each state, an exact one before a near one: 0 none,
    1 exact, 3 stem, 2 near, 4 near a stem.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        self.chars = sorted({c for t, _ in terms for c in t})
        children: list[dict[str, int]] = [{}]
        ends: list[list[tuple[int, bool]]] = [[]]
        room = [0]
        for term, stem in terms:
            allowed, node = edits(term), 0
            room[0] = max(room[0], allowed)
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append([])
                    room.append(0)
                node = children[node][c]
                room[node] = max(room[node], allowed)
            ends[node].append((allowed, stem))

        def closed(found: dict[int, int]) -> frozenset:
            todo = list(found.items())
            while todo:  # a letter of the term is left out
                node, e = todo.pop()
                for child in children[node].values():
                    if e + 1 <= room[child] and found.get(child, 9) > e + 1:
                        found[child] = e + 1
                        todo.append((child, e + 1))
            return frozenset(found.items())

        def after(state: frozenset, c: str | None) -> frozenset:
            found: dict[int, int] = {}

            def put(node: int, e: int) -> None:
                if e <= room[node] and found.get(node, 9) > e:
                    found[node] = e
            for node, e in state:
                if node < 0:
                    found[node] = 0
                    continue
                if node:  # the first letter stays: no letter is put before a term
                    put(node, e + 1)
                for k, child in children[node].items():
                    put(child, e if k == c else e + 1)
            done = {n: 0 for n in (-1, -2) if found.pop(n, None) is not None}
            out = dict(closed(found))
            for node, e in out.items():
                if any(stem and e <= allowed for allowed, stem in ends[node]):
                    done[-1 if e == 0 else -2] = 0
            if -1 in done:
                done.pop(-2, None)
            return frozenset((out | done).items())

        def kind(state: frozenset) -> int:
            found = set()
            for node, e in state:
                if node < 0:
                    found.add(2 - node)
                else:
                    found |= {1 if e == 0 else 2 for allowed, stem in ends[node] if not stem and e <= allowed}
            return next((k for k in (1, 3, 2, 4) if k in found), 0)

        start = frozenset({(0, 0)})
        number = {frozenset(): 0, start: 1}
        rows: list[list[int]] = [[0] * (len(self.chars) + 1)]
        todo, i = [start], 0
        while i < len(todo):
            row = []
            for c in [None, *self.chars]:
                nxt = after(todo[i], c)
                if nxt not in number:
                    number[nxt] = len(number)
                    todo.append(nxt)
                row.append(number[nxt])
            rows.append(row)
            i += 1
        self.next = np.array(rows, np.int32)
        self.accept = np.array([kind(s) for s in sorted(number, key=number.get)], np.int8)
        self.of = np.zeros(0x3000, np.int16)
        for i, c in enumerate(self.chars):
            if ord(c) < 0x3000:
                self.of[ord(c)] = i + 1

    def run(self, letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Kind of each word letters[start:end]; words drop out as soon as no term can follow."""
        out = np.zeros(len(start), np.int8)
        coded = self.of[letters]
        live, state, at = np.arange(len(start)), np.ones(len(start), np.int32), start.copy()
        while len(live):
            state = self.next[state, coded[at]]
            at = at + 1
            over = at == end[live]
            out[live[over]] = self.accept[state[over]]
            keep = ~over & (state > 0)
            live, state, at = live[keep], state[keep], at[keep]
        return out


def split_words(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lowered letters, start, end, text) of the words of joined texts: letters and digits, with @ $ ! * inside."""
    small = np.minimum(codes, 0x2FFF)
    letters = _LOWER[small]
    solid = _LETTER[small] | _DIGIT[small]
    inner = np.zeros(len(codes), bool)
    if len(codes) > 2:
        inner[1:-1] = _SIGN[small[1:-1]] & solid[:-2] & solid[2:]
    word = np.concatenate([[False], solid | inner, [False]])
    cut = np.zeros(len(codes) + 1, bool)
    cut[bounds] = True
    start = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1]))
    end = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + 1
    return letters, start, end, np.searchsorted(bounds, start, "right") - 1


def batches_of(texts: list[str], limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= limit):
            size += len(texts[j])
            j += 1
        joined = np.frombuffer("".join(texts[i:j]).encode("utf-32-le", "surrogatepass"), np.uint32)
        yield i, j, joined, np.concatenate([[0], np.cumsum([len(t) for t in texts[i:j]])]).astype(np.int64)
        i = j


def features(texts: list[str], automaton: Automaton, usual: frozenset = frozenset(), span: int = SPAN) -> np.ndarray:
    """Counts of hits by kind, their rates, and how many are addressed to someone or quoted; one row a text.

    usual: words near a term or stem that are words of their own, no hits.
    """
    out = np.zeros((len(texts), len(FEATURES)))
    out[:, -1] = 1
    for i, j, codes, bounds in batches_of(texts):
        letters, start, end, text = split_words(codes, bounds)
        kinds = automaton.run(letters, start, end)
        for h in np.flatnonzero((kinds == 2) | (kinds == 4)) if usual else ():
            if "".join(map(chr, letters[start[h]:end[h]])) in usual:
                kinds[h] = 0
        size = np.maximum(1, np.bincount(text, minlength=j - i)) if len(text) else np.ones(j - i)
        for k in range(1, KINDS + 1):
            out[i:j, k - 1] = np.bincount(text[kinds == k], minlength=j - i) if len(text) else 0
        for h in np.flatnonzero(kinds):
            t = text[h]
            near = [x for x in range(max(0, h - span), min(len(start), h + span + 1)) if text[x] == t and x != h]
            around = {"".join(map(chr, letters[start[x]:end[x]])) for x in near}
            lo, hi = bounds[t], bounds[t + 1]
            left = {chr(c) for c in codes[max(lo, start[h] - 2):start[h]]}
            right = {chr(c) for c in codes[end[h]:min(hi, end[h] + 2)]}
            quoted = bool(left & QUOTES and right & QUOTES) or bool(around & REPORTING)
            if quoted:  # speech that is reported is no abuse of its own
                out[i + t, kinds[h] - 1] -= 1
            out[i + t, -2] += quoted
            out[i + t, -3] += bool(around & ADDRESS) and not quoted
        out[i:j, KINDS:2 * KINDS] = 10 * out[i:j, :KINDS] / np.sqrt(size)[:, None]
        out[i:j, :KINDS] = np.log1p(out[i:j, :KINDS])
        out[i:j, -3:-1] = np.log1p(out[i:j, -3:-1])
    return out


def learn_terms(texts: list[str], y: np.ndarray, most: int = MAX_TERMS) -> list[tuple[str, bool]]:
    """Words, and stems of 5 to 8 letters, that many toxic documents hold and hardly any other."""
    word, stem = (Counter(), Counter()), (Counter(), Counter())
    said, holders = Counter(), Counter()  # in toxic documents: times a word occurs, documents with a stem
    sizes = [1, 1]
    for text, toxic in zip(texts, y):
        own = Counter("".join(c if c.isalpha() else " " for c in text.lower()).split())
        sizes[toxic] += sum(own.values())
        word[toxic].update(own.keys())
        seen = set()
        for w, n in own.items():
            for k in range(5, min(9, len(w))):
                stem[toxic][w[:k]] += n
                seen.add(w[:k])
        if toxic:
            said.update(own)
            holders.update(seen)
    docs = [1 + int((y == 0).sum()), 1 + int((y == 1).sum())]
    found = []
    for w, n in word[1].items():
        lift = (n + 0.5) / docs[1] / ((word[0][w] + 0.5) / docs[0])
        if n >= 8 and len(w) >= 4 and lift >= 40:
            found.append((lift * n, w, False))
    stems = []
    for s, n in stem[1].items():
        lift = (n + 0.5) / sizes[1] / ((stem[0][s] + 0.5) / sizes[0])
        if n >= 25 and holders[s] >= 10 and lift >= 15:
            stems.append((n, s))
    chosen: list[str] = []
    for n, s in sorted(stems, key=lambda x: (len(x[1]), -x[0], x[1])):
        # a stem that one word all but makes up is that word
        if not any(s.startswith(c) for c in chosen) and not any(w.startswith(s) and said[w] > 0.7 * n
                                                                 for _, w, _ in found):
            chosen.append(s)
    words = [(w, False) for _, w, _ in sorted(found, key=lambda x: (-x[0], x[1]))]
    return [(s, True) for s in chosen[:most // 3]] + words[:most]


def usual_words(texts: list[str], automaton: Automaton, least: int = 2, most: int = 5000) -> frozenset:
    """Words near a term or a stem that several harmless documents hold."""
    holders: Counter = Counter()
    for i, _, codes, bounds in batches_of(texts):
        letters, start, end, text = split_words(codes, bounds)
        near = np.flatnonzero(np.isin(automaton.run(letters, start, end), (2, 4)))
        holders.update(w for w, _ in {("".join(map(chr, letters[start[h]:end[h]])), text[h]) for h in near})
    return frozenset(w for w, n in sorted(holders.items(), key=lambda x: (-x[1], x[0]))[:most] if n >= least)


def fit_model(x: np.ndarray, y: np.ndarray, strength: float = 2.0) -> np.ndarray:
    """Logistic weights that maximise the posterior under a normal prior around PRIOR; Newton steps."""
    w = PRIOR.copy()
    for _ in range(40 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ (p - y) + strength * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), grad)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train: int = MAX_TRAIN,
                 seeds: list[str] = SEEDS) -> dict:
    """{terms, usual, weights}, fitted in one task on a bounded sample of labelled rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)))]
        rows.sort(key=lambda r: r[0])
        texts, y = [r[1] or "" for r in rows], np.array([int(r[2] > 0) for r in rows], int)
        learned = learn_terms(texts, y)
        terms = learned + [(s, False) for s in seeds if (s, False) not in learned]
        automaton = Automaton(terms)
        usual = usual_words([t for t, toxic in zip(texts, y) if not toxic], automaton)
        w = fit_model(features(texts, automaton, usual), y)
        model = {"terms": terms, "usual": sorted(usual), "weights": w.tolist()}
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(model)])], ["model"])

    rows = labelled_sample(docs, labels, label, max_train).coalesce(1).mapInArrow(run, "model string").collect()
    if rows:
        return json.loads(rows[0].model)
    return {"terms": [(s, False) for s in seeds], "usual": [], "weights": PRIOR.tolist()}


def score_toxicity(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and hit counts of every document, from its whole text."""
    # made once for the whole run
    sent = docs.sparkSession.sparkContext.broadcast(Automaton([tuple(t) for t in model["terms"]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, w = sent.value, np.array(model["weights"])
        usual = frozenset(model["usual"])
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                x = features([t or "" for t in part.column(1).to_pylist()], automaton, usual)
                p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
                hits = np.rint(np.expm1(x[:, :KINDS])).astype(np.int64)
                hits[:, 2] += hits[:, 3]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(p), *(pa.array(hits[:, k]) for k in range(3))],
                    ["doc_id", "score", "n_exact", "n_near", "n_stem"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double, n_exact long, n_near long, n_stem long")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "n_exact", "n_near", "n_stem")
