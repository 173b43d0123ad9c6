"""Corpus operators against brute force, exact round trips and held-out accuracy; and odd rows for each."""
import base64
import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest

from check import TABLES, compare
from patchlens.llm import decontaminate, ftrl, itq, jaccard, lines, mixing, queries, rangecoder, secret_scan, tokens
from patchlens.llm import toxic, warc
from patchlens.llm.common import Scratch, components, fresh_path, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, blob string, size long, target string"
ODD = [
    (1, None, None, None, None, "x", 9, "t"), (2, "", "en", "a", 0, None, None, None), (3, " \n\t ", "en", "a", 4, "x", 1, ""),
    (4, "one two three four five six", "en", "a", 27, "x", 1, "t"),
    (5, "One TWO three four five six", "en", "b", 27, "x", 1, "t"),
    (5, "One TWO three four five six", "en", "b", 27, "x", 1, "t"),
    (6, "word", "en", None, 4, "x", 1, "t"), (7, "long " * 30_000 + "\nend", "en", "b", 150_004, "x", 1, "t"),
    (None, "no id here at all, none", "en", "a", 23, "x", 1, "t"), (8, "é日本 ßẞ ſKİ \x00\x85 1²½", "de", "c", 9, "x", 1, "t"),
]


def words(text):
    return WORD.findall((text or "").translate(LOW))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return {r.doc_id: r.text for r in table(spark, folder, "documents").collect()}


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


# --- token blocks

def test_coder_returns_any_ids():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, top, size) for top in (1, 2, 300, 65536) for size in (0, 1, 63, 64, 65, 1500)]
    blocks += [np.full(6000, 65535), np.arange(5000) % 3, np.zeros(0, int)]
    coded = rangecoder.encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, rangecoder.decode_blocks(coded)))
    alone = [rangecoder.encode_blocks([b])[0] for b in blocks]
    assert alone == coded  # a block does not depend on the others
    assert len(coded[-2]) < 5000  # a pattern is learned
    with pytest.raises(ValueError):
        rangecoder.decode_blocks([coded[5][:4] + b"\0\0\0\0" + coded[5][8:]])
    assert rangecoder.encode_blocks([]) == rangecoder.decode_blocks([]) == []


def test_crc_of_joined_bytes():
    for a, b in itertools.product((b"", b"x", b"hello" * 99), (b"", b"yz", bytes(5000))):
        assert tokens.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def token_rows(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, out = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_tokens_equal_the_tokenizers(spark, folder, docs, odd, none):
    got = queries.QUERIES["op1_token_blocks"](spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(token_rows(docs.items()))
    got = [tuple(r) for r in tokens.encoded(odd, fresh_path(spark, "t")).collect()]
    want = token_rows([r[:2] for r in ODD])
    assert collections.Counter(got) == collections.Counter(want)
    assert tokens.encoded(none, fresh_path(spark, "t")).collect() == []


def test_more_distinct_pieces_than_are_remembered(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokens, "KNOWN", 50)
    code = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(9)
    def junk(n):
        return " ".join("".join(rnd.choices("abcdefgé", k=6)) for _ in range(n))
    known = junk(40)
    for texts in ([known], [known + " " + junk(45), "", junk(30)], [junk(400), known, " ", known], [known] * 9, [""], [junk(50), "x"]):
        want = code._encode(texts)
        assert [x.tolist() for x in code.encode(texts)] == want
        assert len(code.start) <= 50


def test_cut_documents_come_back(spark):
    path = fresh_path(spark, "t")
    df = spark.createDataFrame([(i, "the cat sat on " * n) for i, n in enumerate((0, 3000, 1, 700))], "doc_id long, text string")
    import public_tokenizers
    tokens.write_tokens(df, path, public_tokenizers.path("word_bpe_49k.json"), block=512)
    rows = collections.defaultdict(list)
    for r in tokens.read_tokens(spark, path).orderBy("part", "ordinal", "block").collect():
        rows[r.doc_id] += r.ids
    assert [len(rows[i]) for i in range(4)] == [1, 12001, 5, 2801] and all(x[-1] == 2 for x in rows.values())


# --- archive

def test_archive_round_trip(spark, folder):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b\r\nX: y", "<p>x</p>"), (3, None, None), (4, "", ""), (5, "u", "é"),
            (2, "http://b\r\nX: y", "<p>x</p>"), (1, "http://z", "<p>x</p>"), (None, "n", "é")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    path = fresh_path(spark, "warc")
    warc.write_archive(pages, path, Scratch(spark))
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                              for r in warc.read_records(spark, path).collect())
    def d(s):
        return base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = [(1, 8, d("<p>x</p>"), "response", None), (1, 8, d("<p>x</p>"), "revisit", 1),
            (2, 8, d("<p>x</p>"), "revisit", 1), (2, 8, d("<p>x</p>"), "revisit", 1), (3, 0, d(""), "response", None),
            (4, 0, d(""), "revisit", 3), (5, 2, d("é"), "response", None), (None, 2, d("é"), "revisit", 5)]
    assert got == collections.Counter(want)
    whole = warc.reconstruct(spark, path).collect()
    bodies = [bytes(r.record).split(b"\r\n\r\n", 1)[1] for r in whole if b"WARC-Type: response" in bytes(r.header)]
    assert sorted(bodies) == sorted([b"<p>x</p>\r\n\r\n", b"\r\n\r\n", "é".encode() + b"\r\n\r\n"])
    assert spark.read.parquet(f"{path}/payloads").count() == 3 and len(whole) == len(rows)
    assert all(bytes(r.payload) in {b"<p>x</p>", b"", "é".encode()} for r in whole)
    path = fresh_path(spark, "warc")
    warc.write_archive(pages.limit(0), path, Scratch(spark))
    assert warc.read_records(spark, path).count() == 0


def test_archive_query(spark, folder):
    pages = {r.page_id: (r.html or "").encode() for r in table(spark, folder, "pages").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    for r in queries.QUERIES["op2_warc_archive"](spark, folder).collect():
        body = pages[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), warc.sha1_base32(body))
        assert r.refers_to == (None if first[body] == r.page_id else first[body])
        assert r.record_type == ("response" if r.refers_to is None else "revisit")


# --- near copies

def brute_components(sets, t):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations([i for i in sets if sets[i]], 2):
        small, large = sorted((len(sets[a]), len(sets[b])))
        if 100 * small >= t * large:
            n = len(sets[a] & sets[b])
            if 100 * n >= t * (small + large - n):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def shingles(text, k):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_jaccard_query_against_all_pairs(spark, folder, docs):
    sets = {i: shingles(t, 4) for i, t in docs.items()}
    want = brute_components(sets, 85)
    got = queries.QUERIES["op3_jaccard_join"](spark, folder).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_in_large_groups(spark, seed, monkeypatch):
    """Groups of copies around a base, at all distances of the threshold, and passages that many texts share."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "SMALL_WITHIN", 3)
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [[rnd.choice(vocabulary) for _ in range(30)] for _ in range(3)]
    texts = []
    for _ in range(3):
        base = [rnd.choice(vocabulary) for _ in range(60)] + rnd.choice(passages)
        for _ in range(50):
            own = list(base)
            for _ in range(rnd.randrange(7)):
                at = rnd.randrange(len(own))
                own[at:at + rnd.randrange(2)] = rnd.choices(vocabulary, k=rnd.randrange(3))
            texts.append(own)
    for _ in range(60):
        texts.append(sum((rnd.choice(passages) for _ in range(3)), [rnd.choice(vocabulary) for _ in range(rnd.randrange(15))]))
    rows = {i: " ".join(t) for i, t in enumerate(texts)}
    rnd.shuffle(texts)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df, Scratch(spark), 4, 85).collect()}
    assert got == brute_components({i: shingles(t, 4) for i, t in rows.items()}, 85)


def test_what_the_hub_alone_has_makes_no_pairs(spark):
    """All differences from a hub share what is the hub's own; documents that share no more than that do not meet."""
    rng, base = random.Random(3), [f"w{i}" for i in range(200)]

    def changed(name, n):
        own = base.copy()
        for i in rng.sample(range(200), n):
            own[i] = f"{name}_{i}"
        return own

    texts = [changed("hub", 12), *(changed(f"near{j}", 10) for j in range(40)), *(changed(f"apart{j}", 20) for j in range(40))]
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    met = []

    class Told(Scratch):
        def settle(self, df, name):
            out = super().settle(df, name)
            if name == "pairs":
                met.append(out.where("not star and a between 1 and 40 and b > 40").count())
            return out

    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Told(spark), 1, 80).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_components({i: set(x) for i, x in enumerate(texts)}, 80)
    assert met[1:] == [0]  # of 40 * 40 pairs of a near and an apart one


def test_jaccard_odd_rows(spark, odd, none):
    got = jaccard.near_duplicates(odd, Scratch(spark), 5, 80).select("doc_id", "n_shingles", "component_id").collect()
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 2, 4), (5, 2, 4), (5, 2, 4), (6, 1, 6), (7, 2, 7), (None, 2, None), (8, 1, 8)]
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    kept = jaccard.keep_one(odd, Scratch(spark))
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]
    assert jaccard.near_duplicates(none, Scratch(spark)).collect() == []


def test_keep_one_tells_rows_of_one_id_apart(spark):
    """Ids with several texts: copies go, other texts of the same id stay, whatever extra columns are called."""
    text = {x: " ".join(f"{x}{i}" for i in range(30)) for x in "abcde"}
    rows = [(1, "a"), (2, "a"), (2, "b"), (2, "c"), (3, "d"), (3, "e"), (4, "d"), (5, "e"), (6, "b"), (3, "d"), (None, "a")]
    df = spark.createDataFrame([(i, text[x], i, 0) for i, x in rows], "doc_id long, text string, number long, gone int")
    kept = jaccard.keep_one(df, Scratch(spark))
    assert kept.columns == df.columns
    got = sorted((r.doc_id or 0, r.text[0]) for r in kept.collect())
    assert got == [(0, "a"), (1, "a"), (2, "b"), (2, "c"), (3, "d"), (3, "e")]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = {r.node: r.component for r in components(
        Scratch(spark), spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


# --- vectors

def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.25, base[:20] + rng.normal(size=(20, 16)) * 0.1,
                        base[:1] + rng.normal(size=(300, 16)) * 0.08, np.repeat(base[3:4], 50, 0)])
    label = rng.integers(0, 2, len(x))
    rows = [(int(i), v.tolist(), int(k), "x") for i, (v, k) in enumerate(zip(x, label))]
    odd = [(1000, None, 1, ""), (1001, [0.0] * 16, 1, ""), (1002, [float("nan")] + [1.0] * 15, 1, ""), (1003, [None] + [1.0] * 15, 1, ""),
           (1004, x[0].tolist(), None, ""), (1005, [1.0, 2.0], 1, ""), (1006, [2.0, 4.0], 1, ""), (1007, [], 0, "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int, code string")
    got = {r.vec_id: r for r in itq.near_vectors(df, Scratch(spark), block=64).collect()}
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    near = (cos >= 0.93) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    found = sum(got[i].n_links for i in range(len(x)))
    assert 0.9 * near.sum() <= found <= near.sum()
    assert all(got[i].n_links <= near[i].sum() for i in range(len(x)))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (1000, 1001, 1002, 1003, 1004, 1007))
    assert got[1006].component_id == 1005 and got[1005].n_links == 1 and not got[1006].kept
    assert itq.near_vectors(df.limit(0), Scratch(spark)).collect() == []


# --- lines and mix: SQL

@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, folder, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    assert compare(df.collect(), df.columns, duck.execute(queries.ORACLES[name])) is None


def test_lines_odd_rows(spark, odd, none):
    rows = [(i, "Read the terms first\nown text of " + str(i), f"s{i}") for i in range(6)]
    rows += [(9, None, "s1"), (10, "\n\nRead the terms first\n\n", None), (11, "a b\na b", "s2")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, source string, key string")
    got = {r.doc_id: (r.text, r["__n_lines"], r["__n_removed"]) for r in lines.remove_boilerplate(df, Scratch(spark)).collect()}
    assert got[0] == (rows[0][1], 2, 0) and got[3] == ("own text of 3", 2, 1)
    assert got[9] == (None, 0, 0) and got[10] == ("\n\n\n", 5, 1) and got[11] == ("a b\na b", 2, 0)
    out = lines.remove_boilerplate(odd, Scratch(spark))
    assert out.count() == len(ODD) and out.columns[:-2] == odd.columns
    assert lines.cleaned(none, Scratch(spark)).collect() == []


def test_lines_near_the_threshold_are_counted(spark):
    rows = [(i, "a line on many sites", f"s{i % n}") for n in (4,) for i in range(40)]
    rows += [(100 + i, "a line on enough sites", f"s{i % 5}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = lines.cleaned(df, Scratch(spark)).collect()
    assert sorted(r.doc_id for r in got if r.n_removed) == list(range(101, 140))


def test_mix_odd_rows_and_whole_schedule(spark, odd, none):
    got = mixing.taken_words(odd, Scratch(spark)).collect()
    assert len(got) == len(ODD) and sum(r.size for r in got) == sum(len(WORD.findall(r[1] or "")) for r in ODD)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r.source_size, r.target] += r.taken
    assert all(abs(n - key[1]) <= 0.5 for key, n in taken.items())
    assert mixing.taken_words(none, Scratch(spark)).collect() == []
    out = mixing.mixed_documents(odd, Scratch(spark))
    assert out.columns == odd.columns
    by = {r.doc_id: r for r in got if r.doc_id != 5}
    for r in out.collect():
        if r.doc_id in by:
            assert len(WORD.findall(r.text)) == by[r.doc_id].taken and r.n_chars == len(r.text)


def test_mix_holds_what_is_taken_from_rows_of_one_id(spark):
    """Rows that share an id, a text or a source, and names that clash: the mix has the words that were taken."""
    def of(n, x):
        return " ".join([x] * n)
    rows = ([(2, of(7, "a"), "x", 1, "k")] * 3 + [(2, of(14, "b"), "x", 1, "k"), (2, of(8, "c"), None, 1, "k")]
            + [(3, of(11, "d"), "y", 1, "k"), (3, of(11, "e"), "y", 1, "k"), (None, of(5, "f"), "x", 1, None)]
            + [(None, of(5, "f"), "x", 2, None)] * 2 + [(4, of(30, "g"), "z", 1, "k"), (4, None, "z", 1, "k")])
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken long, key string")
    def fed(pairs):
        return collections.Counter(x for x in pairs if x[1])
    for block in (4, 2048):
        want = fed((r.doc_id, r.taken) for r in mixing.taken_words(df, Scratch(spark), block=block).collect())
        out = mixing.mixed_documents(df, Scratch(spark), block=block)
        assert out.columns == df.columns
        assert fed((r.doc_id, len(WORD.findall(r.text))) for r in out.collect()) == want


def test_schedule_is_even(spark):
    targets = spark.createDataFrame([(0, 5000.0, 4000), (1, 2000.0, 1500), (2, 30.0, 30)], "rank int, target double, source_size long")
    slots = mixing.schedule(targets, 10).orderBy("slot").collect()
    assert [r.slot for r in slots] == list(range(703))
    for rank, n in ((0, 500), (1, 200), (2, 3)):
        assert sorted(r.block for r in slots if r["rank"] == rank) == list(range(n))
        seen = np.cumsum([r["rank"] == rank for r in slots])
        assert np.abs(seen - np.arange(1, 704) * n / 703).max() < 6  # in any stretch from the start near its share


# --- secrets

def brute_secrets(text):
    found = []
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    found += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_secret_query_against_plain_patterns(spark, folder, docs):
    got = {r.doc_id: r for r in queries.QUERIES["op7_secret_scan"](spark, folder).collect()}
    for i, text in docs.items():
        base = brute_secrets(text or "")
        named = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert got[i].base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == j for _, k, _ in base) for j in range(3)]
        assert {f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base} <= set(filter(None, got[i].spans.split(",")))


def test_secret_cases(spark, odd, none):
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYzQ4kLm9"
    for text in ("API_KEY = 'abcdefgh'", "password:short token=longenough1", "AKIA" + "Q" * 12, "x" + "0a" * 16, "tokentoken=12345678",
                 "passwd=abc secret: \"abcdefghi\"", "AKIA" + "q" * 20, "Key apiKey=abcdefghij"):
        base, _ = secret_scan.scan(text)
        assert base == brute_secrets(text)
    assert [(a, b) for a, _, b in secret_scan.scan("see " + key + " here")[1]] == [(4, 4 + len(key))]
    for calm in ("z" * 60, "thisisonelongwordoflettersonly", "123e4567-e89b-12d3-a456-426614174000", "abcdefghijklmnopqrstuvwxyz0123456789",
                 "path/to/some/file/in/a/folder", "=" * 40, "CamelCaseIdentifierOfSomeLength42"):
        assert secret_scan.scan(calm) == ([], [])
    out = {r.doc_id: r for r in secret_scan.scan_secrets(odd).collect()}
    assert out[1].base_sha256 == hashlib.sha256(b"").hexdigest() and out[1].spans == ""
    assert secret_scan.scan_secrets(odd).count() == len(ODD) and secret_scan.scan_secrets(none).collect() == []


def test_lower_case_secrets_have_spans():
    def spans(text):
        return [text[a:b] for a, _, b in secret_scan.scan(text)[1]]
    rnd = random.Random(6)
    for chars, size, prefix in (("abcdefghijkmnpqrstuvwxyz23456789", 24, ""), ("abcdefghijkmnpqrstuvwxyz0123456789", 36, "ghp_"),
                                ("abcdefghijkmnpqrstuvwxyz0123456789", 32, "sk-live-"), ("0123456789abcdef", 28, "")):
        for _ in range(50):
            own = prefix + "".join(rnd.sample(chars, min(size, len(chars))) + rnd.choices(chars, k=max(0, size - len(chars))))
            assert spans(f"see {own} here"), own
    key = "k3j9x0qz7v1b5n8m2w4r6t0y"
    for text in ("example_key=" + key, key + "/xxxxxx", "xxxxxxxx-" + key, "placeholder/" + key + "/example"):
        assert any(key in s for s in spans(text)), text
    for calm in ("path/to/some2/file/in10/a/folder", "xxxxxxxxxxxxxxxxxxxxxxxx1234", "how-to-make-your-own-bread-at-home",
                 "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
        assert spans(calm) == [], calm


def test_allow_list_does_not_backtrack():
    for text in ("how-to-make-your-own-bread-at-home/Index", "a" * 5000 + "B", "a1/" * 2000 + "B", "ab-" * 2000 + "+", "0a" * 20 + "=",
                 "aB" * 2000 + "=", "/" * 5000 + "a", "xxxxx" * 1000 + "Y", "abcdefghijk" * 500 + "L="):
        start = time.process_time()
        secret_scan.scan(text)
        assert time.process_time() - start < 2, text[:40]


def test_entropy_counts_are_right():
    rnd, limits = random.Random(3), {"hex": 3.0, "alnum": 3.0, "base64": 3.0, "letters": 3.0}
    text = "".join(rnd.choice("abcXYZ0123+/") for _ in range(80))
    want = set()
    for i in range(61):
        w = text[i:i + 20]
        h = -sum(c / 20 * np.log2(c / 20) for c in collections.Counter(w).values())
        kind = secret_scan.char_class(sum(c.islower() for c in w), sum(c.isupper() for c in w), sum(c.isdigit() for c in w),
                                      sum(c in "0123456789abcdefABCDEF" for c in w), 20)
        if kind and h >= 3.0 - 1e-12:
            want |= set(range(i, i + 20))
    got = {x for a, b in secret_scan.entropy_spans(text, 0, 80, 20, limits) for x in range(a, b)}
    assert got == want


# --- decontamination

def brute_contaminated(docs, items):
    found = set()
    for d, text in docs.items():
        w = words(text)
        for i, item in items.items():
            v = words(item)
            least = min(decontaminate.STRETCH, len(v))
            if len(v) < decontaminate.MIN_WORDS:
                continue
            for shift in range(-len(v), len(w)):
                a, b = max(0, shift), min(len(w), shift + len(v))
                same = np.array([w[x] == v[x - shift] for x in range(a, b)])
                if same.sum() < 0.8 * least - 1e-9:
                    continue
                s = decontaminate.best_stretch(np.array([hash(x) for x in w]), np.array([hash(x) for x in v]), shift, least, 0.8)
                if s:
                    found.add((d, i))
                    break
    return found


def test_contamination_of_the_tables(spark, folder, docs):
    items = {r.item_id: r.text for r in table(spark, folder, "benchmark").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op8_decontamination"](spark, folder).collect()}
    plain = {(d, i) for d, text in docs.items() for i, item in items.items()
             if f" {' '.join(words(item))} " in f" {' '.join(words(text))} "}
    some = dict(itertools.islice(((d, t) for d, t in docs.items() if len(words(t)) < 150), 25))
    some |= {d: docs[d] for d, _ in itertools.islice(sorted(got), 5)}
    few = dict(itertools.islice(items.items(), 12)) | {i: items[i] for _, i in itertools.islice(sorted(got), 5)}
    assert plain and plain <= got
    assert {(d, i) for d, i in got if d in some and i in few} == brute_contaminated(some, few)


def test_contamination_with_words_replaced(spark, odd, none):
    rnd = random.Random(4)
    item = [f"t{i}" for i in range(40)]
    rows = []
    for i in range(30):
        own = list(item)
        for at in rnd.sample(range(40), 4):
            own[at] = "zz"
        rows.append((i, " ".join(["pad"] * rnd.randrange(9) + own + ["tail"] * 3), "x"))
    rows += [(50, " ".join(item[:8] + ["other"] * 40), ""), (51, None, ""), (52, "five words make it up yes", ""), (53, "t0 t1", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, seed string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, "words make it up yes"), (3, "t0 t1"), (4, None), (1, " ".join(item))],
                                  "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contaminated(df, items, Scratch(spark)).collect()}
    assert got == {(i, 1) for i in range(30)} | {(52, 2)}
    clean = decontaminate.drop_contaminated(df, items, Scratch(spark))
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == [50, 51, 53]
    assert decontaminate.drop_contaminated(odd, items, Scratch(spark)).count() == len(ODD)
    assert decontaminate.find_contaminated(none, items, Scratch(spark)).collect() == []
    assert decontaminate.find_contaminated(df, items.limit(0), Scratch(spark)).collect() == []


def test_masks_meet_every_pattern_of_changes():
    for size in range(5, 20):
        masks = [(m, range(size - m[-1])) for m in decontaminate.MASKS] if size >= decontaminate.SPAN else [
            (m, (0,)) for m in decontaminate._short_masks(size)]
        for changed in itertools.combinations(range(size), size // 5):
            assert any(all(p + at not in changed for p in m) for m, places in masks for at in places), (size, changed)
    assert all(len(m) >= min(n - 1, 5) for n in range(5, 10) for m in decontaminate._short_masks(n))


def test_contamination_of_short_items_and_stretches(spark):
    rows, items, want = [], [], set()
    for size in (5, 6, 7, 8, 9, 10, 11, 15):
        item = [f"s{size}w{i}" for i in range(size)]
        items.append((size, " ".join(item)))
        for changed in itertools.combinations(range(size), size // 5):
            want.add((len(rows), size))
            own = ["zz" if i in changed else w for i, w in enumerate(item)]
            rows.append((len(rows), " ".join(["pad"] * (len(rows) % 3) + own + ["tail"] * (len(rows) % 2))))
    item = [f"l{i}" for i in range(30)]
    items.append((30, " ".join(item)))
    for changed in itertools.combinations(range(12), 2):
        want.add((len(rows), 30))
        rows.append((len(rows), " ".join("zz" if i in changed else w for i, w in enumerate(item[9:21]))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.find_contaminated(df, spark.createDataFrame(items, "item_id long, text string"), Scratch(spark))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_best_stretch():
    a = np.arange(30)
    assert decontaminate.best_stretch(a, a[5:25], 5, 12, 0.8) == (20, 20, 5)
    assert decontaminate.best_stretch(a, a[5:25], 6, 12, 0.8) is None
    assert decontaminate.best_stretch(a, a[20:25], 20, 5, 0.8)[:2] == (5, 5)


# --- classifiers

@pytest.mark.parametrize("name,label,threshold,least", [
    ("op9_quality_classifier", "quality", 0.5, 0.95), ("op10_toxicity", "toxic", 0.7, 0.9)])
def test_held_out_accuracy(spark, name, label, threshold, least):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r[label] for r in table(spark, folder, "labels").collect()}
    got = queries.QUERIES[name](spark, folder).collect()
    assert len(got) == table(spark, folder, "documents").count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in got)
    scored = [(r.score, r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([p == y for _, p, y in scored]) >= least
    again = {r.doc_id: r.score for r in queries.QUERIES[name](spark, folder).collect()}
    assert all(again[r.doc_id] == r.score for r in got)


def test_classifiers_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(2, 1, 0), (4, 0, 1), (4, None, None), (5, 1, 0), (99, 1, 1), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    for fit, score in ((ftrl.fit_quality, ftrl.score_quality), (toxic.fit_toxicity, toxic.score_toxicity)):
        for d, n in ((odd, len(ODD)), (none, 0)):
            for given in (labels, labels.limit(0)):
                rows = score(d, fit(odd, given)).collect()
                assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    blank = ftrl.score_quality(odd, ftrl.fit_quality(odd, labels.limit(0))).collect()
    assert all(r.score == 0.5 for r in blank)
    assert ftrl.keep_quality(odd, np.zeros((1 << ftrl.BITS) + 1)).count() == len(ODD)


def test_same_text_of_an_id_is_learned_whatever_the_order(spark):
    rows = [(i, f"good words {i}") for i in range(9)] + [(i, f"other text {i}") for i in range(9)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    one, two = (ftrl.labelled_sample(spark.createDataFrame(x, "doc_id long, text string"), labels, "quality", 100)
                for x in (rows, rows[::-1]))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) and one.count() == sum(not held(i) for i in range(9))


def test_labels_held_out_are_never_learned(spark):
    rows = [(i, "good words here" if i % 2 else "bad bad stuff") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, i % 2) for i, _ in rows]
    flipped = [(i, 1 - y if held(i) else y) for i, y in labels]
    a, b = (ftrl.fit_quality(d, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, flipped))
    assert np.array_equal(a, b)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i] + row[1:], row
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
    return row[-1]


def test_automaton_is_the_edit_distance():
    terms = ["idiot", "moron", "scum", "pathetic", "disgusting"]
    automaton = toxic.Automaton([(t, False) for t in terms] + [("achli", True)])
    rnd, tried = random.Random(2), []
    for _ in range(6000):
        w = list(rnd.choice(terms))
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(1, len(w) + 1)
            w[at:at + rnd.randrange(2)] = rnd.choices("abcdeimnorstx", k=rnd.randrange(2))
        tried.append("".join(w))
    letters = np.frombuffer("".join(tried).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(w) for w in tried])
    got = automaton.run(letters, ends - [len(w) for w in tried], ends)
    for w, kind in zip(tried, got):
        same = w in terms
        near = any(w[:1] == t[:1] and distance(w[1:], t[1:]) <= toxic.edits(t) for t in terms)
        assert kind == (1 if same else 2 if near else 0), w
    letters = np.frombuffer("achlichpf".encode("utf-32-le"), np.uint32)
    assert automaton.run(letters, np.array([0]), np.array([9]))[0] == 3


def test_stems_have_misspellings_and_contexts():
    automaton = toxic.Automaton([("achli", True), ("verbrecht", True), ("achlich", False)])
    def kinds(*tried):
        letters = np.frombuffer("".join(tried).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(w) for w in tried])
        return automaton.run(letters, ends - [len(w) for w in tried], ends).tolist()
    assert kinds("achlich", "achlixyz", "achlicx", "achxixyz", "achixyz", "achllixyz", "axhxixyz") == [1, 3, 3, 4, 4, 4, 0]
    assert kinds("verbrechtung", "verbrxchtung", "vrbrxchtung", "vrbxxchtung", "acl", "acli") == [3, 4, 4, 0, 0, 4]
    rnd, stems = random.Random(8), ["achli", "verbrecht"]
    tried = []
    for _ in range(3000):
        w = list(rnd.choice(stems))
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(1, len(w) + 1)
            w[at:at + rnd.randrange(2)] = rnd.choices("abcehilrtv", k=rnd.randrange(2))
        tried.append("".join(w + rnd.choices("xyz", k=rnd.randrange(4))))
    for w, kind in zip(tried, kinds(*tried)):
        near = any(distance(w[1:n], t[1:]) <= toxic.edits(t) for t in stems if t[0] == w[0] for n in range(1, len(w) + 1))
        assert (kind > 0) == near, w
    texts = ["you are verbrechtung", "they said verbrechtung there", "you are verbrxchtung", "\"verbrxchtung\" it was"]
    x = toxic.features(texts, automaton)
    assert x[:, -3].tolist() == [np.log(2), 0, np.log(2), 0] and x[:, -2].tolist() == [0, np.log(2), 0, np.log(2)]
    assert not x[[1, 3], :2 * toxic.KINDS].any() and x[0, 2] and x[2, 3]


def test_words_under_a_stem_stay_terms():
    texts = [f"stemmy{x} stemmy{y} filler" for x, y in itertools.product("abcdefghij", "klmnopqrst")] + ["calm words here"] * 400
    got = toxic.learn_terms(texts, np.array([1] * 100 + [0] * 400))
    assert ("stemm", True) in got and {(f"stemmy{x}", False) for x in "abcdefghijklmnopqrst"} <= set(got)


def test_quotation_is_told_from_abuse():
    automaton = toxic.Automaton([(s, False) for s in toxic.SEEDS])
    x = toxic.features(["you are an idiot and a m0ron", "he said the word idiot was \"moron\" then", "", "idi ot"], automaton)
    p = 1 / (1 + np.exp(-x @ toxic.PRIOR))
    assert p[0] > 0.7 and p[1] < 0.3 and p[2] < 0.3 and p[3] < 0.3


# --- pipeline

def test_pipeline(spark, folder):
    import corpus_pipeline

    d = table(spark, folder, "documents")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_classifier"](spark, d, folder).cache()
    scores = {r.doc_id: r.predicted for r in ftrl.score_quality(d, ftrl.fit_quality(d, table(spark, folder, "labels"))).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, p in scores.items() if p}
    unique = stages["near_duplicates"](spark, kept, folder).cache()
    want = brute_components({r.doc_id: shingles(r.text, 5) for r in kept.collect()}, 80)
    assert {r.doc_id for r in unique.collect()} == set(want.values())
    clean = stages["decontamination"](spark, unique, folder).cache()
    bad = {r.doc_id for r in decontaminate.find_contaminated(unique, table(spark, folder, "benchmark"), Scratch(spark)).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in unique.collect()} - bad
    mixed = stages["source_mix"](spark, clean, folder).cache()
    taken = {r.doc_id: r.taken for r in mixing.taken_words(clean, Scratch(spark)).collect() if r.taken}
    assert {r.doc_id: len(WORD.findall(r.text)) for r in mixed.collect()} == taken
    last = stages["token_blocks"](spark, mixed, folder)
    want_rows = token_rows([(r.doc_id, r.text) for r in mixed.collect()])
    assert sorted(map(tuple, last.collect())) == sorted(want_rows)
    assert d.columns == kept.columns == unique.columns == clean.columns == mixed.columns
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(want_rows)
    for x in (kept, unique, clean, mixed):
        x.unpersist()
