"""Filter audit, conversation trie and license scan against brute force; and odd rows for each."""
import collections
import hashlib
import itertools
import random
import re
import re._parser as parser
import zlib

import numpy as np
import pytest

from patchlens.llm import filter_audit, license_scan, prefix_trie
from patchlens.llm.common import Scratch, table
from patchlens.llm.license_rules import BASE, RULES
from tests.llm.test_corpus import DOCS, ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def brute_audit(docs, labels):
    """Rows (part, order, step, ...) by applying the filters one after another."""
    good, toxic = collections.Counter(), collections.Counter()
    for i, q, t in labels:
        if i is not None:
            good[i] |= q == 1
            toxic[i] |= t == 1
    failed = collections.defaultdict(list)
    for i, text, source in docs:
        t = text or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)}
        failed[source or ""].append(({x for x in fails if fails[x]}, int(good[i]) if i is not None else 0,
                                     int(toxic[i]) if i is not None else 0))
    out = {}
    for part, rows in failed.items():
        worth = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                worth[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in r[0] for r in rows) - len(gone), sum(r[0] == {x} for r in rows),
                    sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(worth[order[step - 1]])
    return out


def audited(df):
    return {(r[0], r[1], r[2]): list(r[3:]) for r in df.collect()}


def test_audit_against_every_order(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["Aa", "b", "C|", "d", "e#", "ff", str(rng.random())]) for _ in range(rng.choice([3, 150, 230])))
             for _ in range(25)] + [None, "", "same", " "]
    docs = [(rng.choice([None, *range(80)]), rng.choice(texts), rng.choice(["x", "y", None, ""])) for _ in range(120)]
    labels = [(rng.choice([None, *range(80)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(70)]
    got = audited(filter_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, source string"),
                                     spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), Scratch(spark)))
    assert got == brute_audit(docs, labels)


def test_audit_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0, "z"), (5, 1, 1, "z"), (5, 0, 0, "z"), (None, 1, 1, "z")],
                                   "doc_id long, quality int, toxic int, part string")
    clash = odd.withColumnsRenamed({"size": "n", "target": "part", "blob": "mask"})
    got = audited(filter_audit.audit(clash, labels, Scratch(spark)))
    assert got == brute_audit([(r.doc_id, r.text, r.source) for r in clash.collect()],
                              [tuple(r)[:3] for r in labels.collect()])
    assert {p for p, _, _ in got} == {"", "a", "b", "c"} and len(got) == 4 * 600
    assert filter_audit.audit(clash.limit(0), labels, Scratch(spark)).count() == 0
    assert got["b", "ABCDE", 1][5] == 2  # both rows of id 5 are toxic and fail A


def test_audit_with_other_filters(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "a b", "s"), (3, "c", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = {"S": lambda text, words: text == "c"}
    got = audited(filter_audit.audit(docs, labels, Scratch(spark), one))
    assert got == {("s", "SE", 1): [2, 1, 0, 1, 0, 0, 2], ("s", "SE", 2): [1, 1, 0, 1, 0, 0, 2],
                   ("s", "ES", 1): [2, 1, 0, 1, 0, 0, 2], ("s", "ES", 2): [1, 1, 0, 1, 0, 0, 2]}


@pytest.mark.parametrize("k", [1, 2, 3, 5, 6])
def test_walk_equals_survivors_of_every_subset(k):
    cells = np.random.default_rng(k).integers(0, 9, (3, 1 << k, 2))
    states = filter_audit.subset_states(cells)
    for subset in range(1 << k):
        left = [m for m in range(1 << k) if not m & subset]
        assert (states[subset] == cells[:, left].sum(axis=1)).all()


def test_audit_spreads_hot_keys(spark):
    """A hot text does not meet in one task: its rows are joined by (digest, id)."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, concat('t', id), 'hot') AS text", "'s' AS source")
    out = filter_audit.failures(docs, Scratch(spark))
    assert out.where("mask >= 16").agg({"n": "sum"}).first()[0] == 1999


# conversations


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members = collections.defaultdict(list)
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    kids = collections.defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(kids[node]), leaves[node], saved[node],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(node)).encode()).hexdigest())
                  for node, m in members.items())


def tried(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed,most", [(1, 9), (2, 40)])
def test_trie_against_brute_force(spark, seed, most):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 420), 60) + [100, 200]:
        for t in range(rng.randint(1, most)):
            rows.append((c, rng.choice([t, t, None, 3]), rng.choice(["u", "a", None]), rng.choice(["x", "", None, "é日本"])))
    rows += [(c, t, "u", "same") for c in (300, 301, 302, 303, 377) for t in range(12)]
    rng.shuffle(rows)
    got = tried(prefix_trie.conversation_trie(spark.createDataFrame(rows, CONV), Scratch(spark)))
    assert got == brute_trie(rows)


def test_trie_odd_rows(spark):
    rows = [(None, 1, "u", "lost"), (1, None, None, None), (1, 0, "u", "a"), (1, 0, "u", "a"), (-7, 1, "u", "z" * 70_000),
            (5, 1, "u", "only"), (905, 1, "u", "x"), (2**40, 1, "a", "big"), (2**40 + 1, 1, "a", "big")]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], CONV + ", depth long, name string")
    assert tried(prefix_trie.conversation_trie(df, Scratch(spark))) == brute_trie(rows)
    assert prefix_trie.conversation_trie(df.limit(0), Scratch(spark)).count() == 0
    alone = [(4, 1, "u", "dropped")]  # crc32 of "4" leaves a head longer than the conversation, and the base is absent
    assert zlib.crc32(b"4") % 6 >= 1
    got = tried(prefix_trie.conversation_trie(spark.createDataFrame(alone, CONV), Scratch(spark)))
    assert got == brute_trie(alone) and len(got) == 1


def test_trie_of_one_long_conversation_and_many_equal_ones(spark, monkeypatch):
    """A third of the turns in one conversation; ends of one node in many pieces; a parent with many children."""
    monkeypatch.setattr(prefix_trie, "PIECE", 40)
    rows = [(101, t, "u", str(t % 3)) for t in range(700)]
    rows += [(c, t, "u", "same") for c in range(1000, 1300) for t in range(2)]
    rows += [(c, t, "u", f"{c}" if t == 7 else "s") for c in range(2000, 2100) for t in range(8)]
    got = tried(prefix_trie.conversation_trie(spark.createDataFrame(rows, CONV).repartition(5), Scratch(spark)))
    assert got == brute_trie(rows)


def test_heavy_parents_are_told(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "max", lambda a, b: 3, raising=False)
    rows = [(c, t, "u", f"{c}" if t > 5 else "s") for c in range(2000, 2030) for t in range(8)]
    assert tried(prefix_trie.conversation_trie(spark.createDataFrame(rows, CONV), Scratch(spark))) == brute_trie(rows)


# licenses


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for label, phrase in BASE for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def test_license_query_against_plain_search(spark, folder):
    docs = table(spark, folder, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = license_scan.scan_licenses(docs).collect()
    assert len(got) == len(texts) and sum(r.n_base for r in got) > 0
    for r in got:
        assert tuple(r)[1:6] == brute_base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        marked = re.search("licen|rights reserved", texts[r.doc_id] or "", re.I)
        assert bool(r.labels) == bool(marked) and (r.score > 0) == bool(r.labels)


def test_license_odd_rows(spark, odd):
    text = "Under-the MIT.license! under THE mit License under the mit license\x00é under the MIT Licensé; CC\nBY:NC cc by ncx"
    extra = spark.createDataFrame([(77, text, None, None, None, None, None, None)], DOCS)
    got = license_scan.scan_licenses(odd.unionByName(extra)).collect()
    assert [tuple(r)[1:6] for r in got] == [brute_base(t) for t in [r[1] for r in ODD] + [text]]
    assert got[-1].n_base == 4 and got[-1].base_labels == "cc-by-nc,mit"
    assert license_scan.scan_licenses(odd.limit(0)).count() == 0
    assert license_scan.license_spans(extra.withColumn("label", extra.text)).where("label = 'mit'").count() == 3


@pytest.mark.parametrize("text,labels", [
    ("Licensed under CC BY-NC 4.0.", ["cc-by-nc-4.0"]),
    ("Creative Commons Attribution-ShareAlike 4.0 International", ["cc-by-sa-4.0"]),
    ("https://creativecommons.org/licenses/by-nc-sa/3.0/", ["cc-by-nc-sa-3.0"]),
    ("licensed under the GNU General Public License, version 3.", ["gpl-3"]),
    ("GPLv2 or any later version", ["gpl-2-or-later"]),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", ["lgpl-2.1-or-later"]),
    ("SPDX-License-Identifier: BSD-3-Clause", ["bsd-3-clause"]),
    ("Licensed under the Apache License, Version 2.0.", ["apache-2"]),
    ("Released under the MIT License.", ["mit"]), ("All rights reserved.", ["all-rights-reserved"]),
    ("This is free and unencumbered software released into the public domain.", ["unlicense"]),
    ("released into the public domain", ["public-domain"]), ("CC0 1.0 Universal", ["cc0-1.0"]),
    ("Copyright (c) 2019 X. BSD 2-Clause License", ["bsd-2-clause", "copyright"]),
    ("the admit licensee eats mit Brot and apache stew; bsd by cc", []),
])
def test_license_labels(text, labels):
    _, _, hits = license_scan.Scanner().scan(text)
    assert sorted({x[2] for x in hits}) == labels


def sample(tree, rng):
    """A string that a parsed pattern matches."""
    out = ""
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "IN":
            low = [a for o, a in arg if str(o) == "LITERAL"]
            out += chr(rng.choice(low)) if low else "7" if "DIGIT" in str(arg) else "w"
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, part = arg
            out += "".join(sample(part, rng) for _ in range(rng.choice([least, min(int(most), least + 2)])))
        elif op == "SUBPATTERN":
            out += sample(arg[-1], rng)
        elif op == "BRANCH":
            out += sample(rng.choice(arg[1]), rng)
        elif op == "CATEGORY":
            out += "7"
    return out


def test_keywords_are_in_every_match():
    """The prefilter never hides a match: whatever a pattern can match holds the rule's keywords as words."""
    rng = random.Random(3)
    scanner = license_scan.Scanner()
    for label, keywords, pattern, _ in RULES:
        tree = parser.parse(re.sub(r"\\S\+", "w", re.sub(" +", " ", pattern)))
        for _ in range(12):
            text = sample(tree, rng)
            assert set(keywords) <= set(text.split()), (label, text)
            if license_scan.compiled(pattern).search(f" {text} ".encode()):
                assert scanner.scan(text)[2], (label, text)
    assert len(RULES) > 300


def test_contained_detections_are_suppressed():
    rng = random.Random(1)
    for _ in range(300):
        found = [(rng.randrange(6), s := rng.randrange(20), s + rng.randrange(1, 9)) for _ in range(rng.randrange(12))]
        kept = []
        for hit in sorted(found, key=lambda x: (x[0], x[1], -x[2])):
            if not any(k[1] <= hit[1] and hit[2] <= k[2] for k in kept):
                kept.append(hit)
        assert license_scan.suppressed(found) == sorted(kept, key=lambda x: x[1:3])
