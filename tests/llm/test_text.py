"""Fingerprints, windows and scores against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import ctw, golay, queries, simhash, windows
from palimpsest.llm.shared import Scratch, U, components

DOCS = "doc_id bigint, text string"


def find(parent, a):
    while parent[a] != a:
        a = parent[a]
    return a


def classes(ids, linked):
    parent = {i: i for i in ids}
    for a, b in linked:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    return {i: find(parent, i) for i in ids}


# ---------------------------------------------------------------------------- golay
def test_code_is_perfect():
    index = np.arange(4096)
    words = golay.encode(index)
    assert (golay.decode(words) == index).all()
    rng = np.random.default_rng(0)
    for weight in (1, 2, 3):
        for _ in range(20):
            e = sum(1 << int(p) for p in rng.choice(23, weight, replace=False))
            assert (golay.decode(words ^ e) == index).all()


@pytest.mark.parametrize("width", [23, 22, 21])
def test_two_errors_share_a_key(width):
    rng = np.random.default_rng(width)
    a = rng.integers(0, 1 << width, 400, dtype=np.int32)
    b = a.copy()
    for k in range(400):
        for p in rng.choice(width, rng.integers(0, 3), replace=False):
            b[k] ^= 1 << int(p)
    keys = []
    for v in (a, b):
        row, key = golay.fuzzy_keys(v, width)
        own = defaultdict(set)
        for r, x in zip(row.tolist(), key.tolist()):
            own[r].add(x)
        keys.append(own)
    assert all(keys[0][k] & keys[1][k] for k in range(400))
    assert max(len(x) for x in keys[0].values()) <= 6


# -------------------------------------------------------------------------- simhash
def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("hot", [0.001, 0.04, 1.0])
def test_fingerprints_and_components(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    texts += [None, "", " \t\n", "One", "one", "one two", "A bé c d", texts[3], texts[3].upper() if texts[3] else "x", "long " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r["id"]: (r["fp"] % (1 << 64), r["component"]) for r in simhash.fingerprint_components(df).collect()}
    fp = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: f for i, (f, _) in got.items()} == fp
    want = classes(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    assert {i: c for i, (_, c) in got.items()} == want


@pytest.mark.parametrize("small", [32, 3])
def test_links_in_crowded_buckets(spark, monkeypatch, small):
    """A crowd around one centre, chains two bits apart, and noise."""
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    fps = {centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)} | {rng.getrandbits(64) for _ in range(50)}
    x = rng.getrandbits(64)
    for k in range(0, 20, 2):
        x ^= 3 << k
        fps.add(x)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    scratch = Scratch(spark)
    edges = [tuple(r) for r in simhash.link_fingerprints(scratch, df).collect()]
    ids = [signed(f) for f in fps]
    truth = [(a, b) for a in ids for b in ids if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2]
    assert classes(ids, edges) == classes(ids, truth)
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 2 for a, b in edges)


@pytest.mark.parametrize("size", [200_000, 40])
def test_components(spark, monkeypatch, size):
    from palimpsest.llm import shared

    monkeypatch.setattr(shared, "CONTRACTED", size)
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    got = {r["node"]: r["root"] for r in components(Scratch(spark), spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = classes({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(Scratch(spark), spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("how", [{"crowded": 4}, {"crowded": 48}, {"crowded": 2, "rounds": 0, "part_rows": 3}])
def test_near_duplicates(spark, how):
    rng = random.Random(11)
    base = [[f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(200)] for _ in range(12)]
    rows, n = [], 0
    for b in base:
        rows.append((n, " ".join(b)))
        for _ in range(6):  # two words of two hundred: shingles overlap by more than 0.9
            c = list(b)
            for p in rng.sample(range(200), 2):
                c[p] = f"new{rng.randrange(10**6)}"
            n += 1
            rows.append((n, " ".join(c)))
        n += 1
    rows += [(1000, rows[0][1]), (1001, rows[0][1].upper()), (1002, None), (1003, ""), (None, rows[0][1])]
    rows += [(2000 + k, " ".join(f"x{rng.randrange(10**6)}" for _ in range(120))) for k in range(15)]
    got = {r["id"]: r["group"] for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS), **how).collect()}
    for k in range(12):
        assert {got.get(i) for i in range(7 * k, 7 * k + 7)} == {7 * k}
    assert got[1000] == 0 and got[1001] == 0
    assert not any(i >= 2000 for i in got)
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def near_groups(rows, similarity=0.8):
    """Groups of documents by brute force over five-word shingles."""
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    joined = {x for e in links for x in e}
    return {k: v for k, v in classes(set(sets), links).items() if k in joined}


def test_members_of_a_component_stay_candidates(spark):
    """Chains in which only neighbours overlap by 0.8; each is one group in a crowded bucket too."""
    rng = random.Random(23)
    rows = []
    for chain in range(6):
        w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        places = rng.sample(range(3, 197, 4), 44)
        ids = rng.sample(range(100 * chain, 100 * chain + 12), 12)
        for step, i in enumerate(ids):
            if step:
                for p in places[4 * step - 4 : 4 * step]:
                    w[p] = f"n{rng.randrange(10**6)}"
            rows.append((i, " ".join(w)))
    want = near_groups(rows)
    assert len(set(want.values())) == 6 and len(want) == 72
    for crowded in (3, 48):
        got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS), crowded=crowded)
        assert {r["id"]: r["group"] for r in got.collect()} == want


def test_near_duplicates_wherever_words_differ(spark):
    """Pairs at 0.8 to 0.9 by an appended, cut, contiguous or rare-word change: all are found."""
    rng = random.Random(29)
    fresh = lambda n: [f"q{rng.randrange(10**7)}" for _ in range(n)]
    rows = []
    for k in range(24):
        w = fresh(300)
        for how in (w + fresh(33), w + fresh(51), w + fresh(70), w[62:], w[:250], w[:100] + fresh(15) + w[115:], w[:150] + fresh(29) + w[179:]):
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(how))]
            w = fresh(300)
    rows += [(len(rows), "a b"), (len(rows) + 1, "A  b"), (len(rows) + 2, "a b c")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS))
    assert {r["id"]: r["group"] for r in got.collect()} == near_groups(rows)


def test_golay_keys_find_near_duplicates(spark, monkeypatch):
    """Texts within two bits are linked by their SimHashes, without the filter that adds the rest."""
    rng = random.Random(37)
    rows = []
    for _ in range(12):
        w = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
        rows += [(len(rows) + k, " ".join(x)) for k, x in enumerate((w, [*w, "more"], [x.upper() for x in w], w[1:]))]
    rows += [(len(rows), ""), (len(rows) + 1, " "), (len(rows) + 2, "\n"), (len(rows) + 3, "a b"), (len(rows) + 4, "c d")]
    docs = spark.createDataFrame(rows, DOCS)
    fp = {i: simhash.simhash(t.encode(), 5) for i, t in rows}
    near = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    texts = docs.select(simhash.text_node(F.col("text")).alias("node"), "text")
    name = {r["node"]: r["doc_id"] for r in docs.select("doc_id", simhash.text_node(F.col("text")).alias("node")).collect()}
    got = [(name[r["a"]], name[r["b"]]) for r in simhash.fingerprint_pairs(Scratch(spark), texts).collect()]
    assert {tuple(sorted(p)) for p in got} <= set(near)
    assert classes(set(fp), got) == classes(set(fp), near)
    # the stage takes its first links from them, as far as the shingles confirm them
    whole = simhash.shared_prefixes
    monkeypatch.setattr(simhash, "shared_prefixes", lambda *a: whole(*a).filter("false"))
    links = [(a, b) for a, b in near if b < 48]
    joined = {x for e in links for x in e}
    assert len(joined) > 36
    found = {r["id"]: r["group"] for r in simhash.near_duplicates(docs).collect()}
    assert found == {k: v for k, v in classes(set(fp), links).items() if k in joined}


def test_repeated_ids_lose_only_the_repeated_text(spark):
    """Id 7 holds a copy of document 3 and a text of its own; id 9 holds two near copies."""
    import corpus_pipeline

    rng = random.Random(31)
    a, own, b = ([f"w{rng.randrange(10**6)}" for _ in range(100)] for _ in range(3))
    texts = [(3, a), (7, a), (7, own), (9, b), (9, b + ["more"]), (11, own[:50]), (12, b + ["other"])]
    rows = [(i, " ".join(w)) for i, w in texts] + [(7, None)]
    left = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()]
    assert sorted(i for i, _ in left) == [3, 7, 7, 9, 11]
    assert {t for i, t in left if i == 7} == {" ".join(own), None}


# -------------------------------------------------------------------------- windows
def plain_cut(rows, width):
    lists = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + width]) for _, w in lists for k in range(len(w) - width + 1))
    out = []
    for i, w in lists:
        gone = {p for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for p in range(k, k + width)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_windows(spark, seed):
    rng = random.Random(seed)
    words = ["a", "b", "été", "D"]
    passage = [rng.choice(words) + str(rng.randrange(9)) for _ in range(12)]
    rows = []
    for i in range(40):
        w = [rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randrange(0, 30))]
        if i % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(40, None), (41, ""), (42, "x " * 50), (43, rows[5][1]), (43, rows[5][1]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, t, "f", 1, 2) for i, t in rows], "doc_id bigint, text string, flags string, block int, row int")
    got = windows.remove_repeated_windows(df, width=5).select("row.doc_id", "n_words", "n_removed", "kept_sha256", "kept", "intervals").collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == plain_cut(rows, 5)
    for r in got:
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]
        assert sum(x["end"] - x["first"] for x in r["intervals"]) == r["n_removed"]
        assert all(a["end"] < b["first"] for a, b in zip(r["intervals"], r["intervals"][1:]))


@pytest.mark.parametrize("short", [1, 2])
def test_windows_that_only_seem_repeated(spark, short):
    """Hashes cut to so few bytes that most windows seem repeated: the second hash decides."""
    rng = random.Random(short)
    rows = [(i, " ".join(str(rng.randrange(60)) for _ in range(rng.randrange(80)))) for i in range(60)]
    rows += [(60 + i, rows[i][1][:60]) for i in range(5)] + [(70, " ".join(str(rng.randrange(10**6)) for _ in range(60_000)))]

    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = windows.remove_repeated_windows(df, width=5, short=short).select("row.doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == plain_cut(rows, 5)


def test_short_hashes():
    h = np.array([0, 1, 2**40 - 1, 2**63 + 5], dtype=U)
    assert windows._shortened(windows._shorten(h, 5), 5).tolist() == [0, 1, 2**40 - 1, 5]


def test_windows_of_nothing(spark):
    assert windows.remove_repeated_windows(spark.createDataFrame([], DOCS)).count() == 0


# ------------------------------------------------------------------------------ ctw
class PlainTree:
    """Context-tree weighting by its definition, with dictionaries and recursion."""

    def __init__(self, depth):
        self.depth, self.counts, self.kids = depth, defaultdict(lambda: [0, 0]), defaultdict(set)

    def steps(self, text):
        s = bytes(self.depth) + text + b"\xff"
        for i in range(self.depth, len(s)):
            context, prefix = s[i - self.depth : i][::-1], 1
            for k in range(7, -1, -1):
                bit = s[i] >> k & 1
                yield context, prefix, bit
                prefix = prefix << 1 | bit

    def add(self, context, prefix, bit, by=1):
        for d in range(self.depth + 1):
            self.counts[context[:d], prefix][bit] += by
            if d:
                self.kids[context[: d - 1], prefix].add(context[:d])

    def weighted(self, context, prefix):
        a, b = self.counts[context, prefix]
        kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if len(context) == self.depth:
            return kt
        below = sum(self.weighted(c, prefix) for c in self.kids[context, prefix])
        return np.logaddexp(kt, below) - math.log(2)

    def score(self, text):
        """Each bit by the ratio of the weighted probability with and without it."""
        total = 0.0
        for context, prefix, bit in self.steps(text):
            before = self.weighted(b"", prefix)
            self.add(context, prefix, bit)
            total += self.weighted(b"", prefix) - before
            self.add(context, prefix, bit, -1)
        return total / math.log(10)


@pytest.mark.parametrize("depth", [3, 5])
def test_scores_match_the_definition(spark, depth):
    rows = [(1, "abab aab"), (2, "aba bé"), (3, "Abab"), (4, None), (5, "zz aba"), (6, ""), (7, "abab aab"), (None, "ab")]
    held = {5, 6, 7}
    tree = PlainTree(depth)
    lower = lambda t: (t or "").encode().lower()
    counts = Counter()
    for i, t in rows:
        if i not in held:
            for step in tree.steps(lower(t)):
                tree.add(*step)
            counts.update([*lower(t).split(), None])
    n, v = sum(counts.values()), len(counts)
    got = ctw.score(spark.createDataFrame(rows, DOCS), F.col("doc_id").isin(list(held)), depth=depth).collect()
    assert len(got) == len(rows)
    for r in got:
        text = lower(dict(rows)[r["id"]])
        tokens = [*text.split(), None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["id"] in held, len(tokens), sum(t in counts for t in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), abs=1e-9)
        assert r["score"] == pytest.approx(tree.score(text), rel=1e-5)


def test_probabilities_add_up():
    texts = [b"abracadabra", b"barbara", b"\x00\xfe"]
    keys = np.concatenate([ctw.byte_strings(texts, 5)[0]])
    context = keys[3] >> U(8) << U(8)
    every = np.unique(np.concatenate([keys, context | np.arange(256, dtype=U)]))
    counts = np.array([(keys == k).sum() for k in every])
    s = ctw.node_summary(every, counts, 5)
    upper = ctw.top_levels(s["last"], s["prefix"], s["zeros"], s["ones"], s["below"])
    p = 10 ** ctw.string_scores(every, counts, 5, upper)
    assert p[(every >> U(8) << U(8)) == context].sum() == pytest.approx(1)


def test_log_gamma_and_mix():
    x = np.array([0.5, 1.0, 1.5, 3.0, 10.25, 1e6 + 0.5])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-11)
    h = np.random.default_rng(1).integers(0, 2**63, 1000, dtype=U)
    from palimpsest.llm.shared import mix

    assert (ctw.unmix(mix(h)) == h).all()


def test_model_beats_the_base_on_unseen_texts(spark):
    d = "/root/testdata/sf0.1"
    seen = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5("text").alias("h"))
    scored = queries.op5_context_tree_weighting(spark, d).join(seen, "doc_id")
    first = scored.groupBy("h").agg(F.bool_and("held_out").alias("new"), F.first("score").alias("s"), F.first("base_score").alias("b"))
    total = first.filter("new").agg(F.sum("s").alias("s"), F.sum("b").alias("b"), F.count("*").alias("n")).first()
    assert total["n"] > 500 and total["s"] > total["b"]


def test_scores_of_nothing(spark):
    assert ctw.score(spark.createDataFrame([], DOCS), F.lit(False)).count() == 0
