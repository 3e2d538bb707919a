"""Chat formatting, mixing, quality, token ids, shards and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import resource
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chat, mixing, ordering, pieces, quality, queries
from palimpsest.llm.shared import Scratch
from tests.compare import connect, same

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_matches_sql(spark, name):
    same(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.SQL[name])


# ----------------------------------------------------------------------------- chat
NODES = "tree string, node string, parent string, score double"


def test_paths_of_trees(spark):
    rng = random.Random(2)
    rows, kids, parent, score = [], {}, {}, {}
    for t in range(6):
        for k in range(25):
            node = f"{t}-{k:02}"
            parent[node] = f"{t}-{rng.randrange(k):02}" if k else None
            score[node] = float(rng.randrange(5))
            kids.setdefault(parent[node], []).append(node)
            rows.append((str(t), node, parent[node], score[node]))

    def path(n):
        return path(parent[n]) + [n] if parent[n] else [n]

    want = {}
    for t in range(6):
        leaves = [n for n in parent if n.startswith(f"{t}-") and n not in kids]
        for rank, n in enumerate(sorted(leaves, key=lambda n: (-sum(score[x] for x in path(n)), n))[:3], 1):
            want[str(t), rank] = path(n)
    got: dict = {}
    for r in chat.reply_paths(Scratch(spark), spark.createDataFrame(rows, NODES), best=3).orderBy("pos").collect():
        got.setdefault((r["tree"], r["rank"]), []).append(r["node"])
    assert got == want


def test_odd_trees(spark):
    rows = [("a", "x", "gone", 1.0), ("b", "p", "q", 1.0), ("b", "q", "p", 1.0), ("c", "z", None, None)]
    got = chat.reply_paths(Scratch(spark), spark.createDataFrame(rows, NODES)).collect()
    assert sorted((r["tree"], r["node"]) for r in got) == [("a", "x"), ("c", "z")]
    assert chat.reply_paths(Scratch(spark), spark.createDataFrame([], NODES)).count() == 0


def test_repeated_nodes_and_names(spark):
    """Names hold within a tree; rows that repeat a node count once, by the least parent and score."""
    chain = [("a", f"n{k:02}", f"n{k - 1:02}" if k else None, 1.0) for k in range(12)]
    other = [("b", f"n{k:02}", f"n{k - 1:02}" if k else None, 1.0) for k in range(5)] + [("b", "n05", "n00", 9.0)]
    odd = [("a", "n03", "n09", 7.0), ("a", "n04", "n03", 5.0), (None, "n00", None, 1.0), ("b", None, "n01", 1.0)]
    rows = spark.createDataFrame(chain * 2 + other + odd, NODES).withColumn("rank", F.lit(1)).withColumn("up", F.lit("x"))
    got: dict = {}
    for r in chat.reply_paths(Scratch(spark), rows, best=2).orderBy("pos").collect():
        got.setdefault((r["tree"], r["rank"]), []).append(r["node"])
    assert got == {("a", 1): [f"n{k:02}" for k in range(12)], ("b", 1): ["n00", "n05"], ("b", 2): [f"n{k:02}" for k in range(5)]}


def test_long_conversation_texts(spark):
    text = "</turn> " * 100_000
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_conversations(chat.format_conversations(df)).first()["loss_texts"] == [text]


def test_control_strings_come_back(spark):
    texts = ["</turn>", r"<\/turn>", "<turn>x<text>y</turn>", r"\</turn>", "<<text>", "a\nb", "", None, "<\\", "é</turn>é", "assistant"]
    rows = [(1, i, "assistant" if i % 2 else "user<text>", t) for i, t in enumerate(texts)] + [(None, 0, None, "hi"), (2, None, "assistant", "x"), (2, None, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1)).withColumn("pos", F.lit(2))
    got = {r["conv_id"]: r for r in chat.read_conversations(chat.format_conversations(df)).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r, t or "") for c, _, r, t in rows if c == 1]
    assert got[1]["loss_texts"] == [t or "" for i, t in enumerate(texts) if i % 2]
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("", "hi")]
    assert got[2]["n_turns"] == 2 and got[2]["loss_texts"] == ["x", "x"]
    f = got[1]["formatted"]
    for t, s in zip(got[1]["turns"], got[1]["spans"]):
        assert f[s["start"] :].startswith("<turn>")
        if s["loss_start"] is not None:
            assert f[s["loss_end"] :].startswith("</turn>")


def test_conversations_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.format_conversations(none).count() == 0


# --------------------------------------------------------------------------- mixing
def water(children, budget):
    """{name: share} for {name: (weight, capacity)}, by filling until nobody is over."""
    share, left, open_ = {}, budget, {k: v for k, v in children.items() if v[0] > 0}
    share = dict.fromkeys(children, 0.0)
    while open_:
        level = left / sum(w for w, _ in open_.values())
        full = [k for k, (w, c) in open_.items() if c <= level * w]
        if not full:
            return share | {k: level * w for k, (w, _) in open_.items()}
        for k in full:
            share[k] = open_.pop(k)[1]
            left -= share[k]
    return share


@pytest.mark.parametrize("seed,fraction", [(1, 0.3), (2, 0.9), (3, 2.0), (4, 0.0)])
def test_budgets(spark, seed, fraction):
    rng = random.Random(seed)
    leaves = [(d, x, s, rng.randrange(1, 200)) for d in "ab" for x in ("en", "de") for s in range(3)]
    leaves = [(d, x, str(s), n) for d, x, s, n in leaves]
    weights = [("a", None, None, 3.0), ("a", "en", None, 0.0 if seed == 2 else 2.0), ("b", "de", "1", 5.0)]
    w = {tuple(x for x in r[:3] if x is not None): r[3] for r in weights}
    got = mixing.budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint"), spark.createDataFrame(weights, "domain string, lang string, source string, weight double"), fraction, 2)

    def descend(path, budget):
        below = sorted({r[: len(path) + 1] for r in leaves if r[: len(path)] == path})
        if len(path) == 3:
            return {path: budget}
        shares = water({p: (w.get(p, 1.0), 2.0 * sum(r[3] for r in leaves if r[: len(p)] == p)) for p in below}, budget)
        return {k: v for p in below for k, v in descend(p, shares[p]).items()}

    want = descend((), fraction * sum(r[3] for r in leaves))
    assert {tuple(r)[:3]: r["budget"] for r in got.collect()} == {k: pytest.approx(v, abs=1.001) for k, v in want.items()}


def test_mix_edge_cases(spark):
    shape = "doc_id bigint, text string, lang string, source string, epoch int, tokens string"
    rows = [(i, " a b\tc \n" * (i % 4), None if i % 5 == 0 else "en", f"s{i % 2}", 9, "x") for i in range(60)] + [(7, "a b", "en", "s1", 1, None), (None, None, None, None, None, None)]
    weights = queries.mix_weights(spark)
    df = spark.createDataFrame(rows, shape)
    got = mixing.mix_sources(df, weights, F.lit("web"), fraction=10.0, epochs=2).collect()
    assert len(got) == 2 * len(rows)  # everything, twice
    assert {len((r["row"]["text"] or "").split()) - r["tokens"] for r in got} == {0}
    half = mixing.mix_sources(df, weights, F.lit("web"), fraction=0.5, epochs=1).collect()
    total = sum(len((t or "").split()) for _, t, *_ in rows)
    assert 0 < sum(r["tokens"] for r in half) <= total / 2
    assert mixing.mix_sources(df.limit(0), weights, F.lit("web")).count() == 0


def test_mix_of_finer_parts(spark, monkeypatch):
    """How finely leaves are dealt does not change what is taken."""
    assert [mixing.part_digits(n) for n in (0, 1 << 20, 1 << 28, (1 << 28) + 1, 1 << 34)] == [2, 2, 2, 3, 4]
    rows = [(i % 300, "a " * (i % 7), "en" if i % 3 else "de", f"s{i % 2}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")

    def taken():
        mixed = mixing.mix_sources(df, queries.mix_weights(spark), F.lit("web"), fraction=0.7, epochs=2)
        return sorted(map(str, mixed.collect()))

    plain = taken()
    monkeypatch.setattr(mixing, "PART_ROWS", 0.001)
    assert mixing.part_digits(len(rows)) == 5
    assert taken() == plain


# -------------------------------------------------------------------------- quality
def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = quality.graded_labels(spark.read.parquet(f"{d}/labels.parquet"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    model = quality.fit(docs, labels.filter(~held), 3)
    assert (np.diff(model.thresholds) > 0).all()
    tail = F.col("tail")
    scored = quality.grade(docs, model).select("row.doc_id", (tail[1] >= 0.5).alias("keep"), "expected_grade", "tail").join(labels.filter(held), "doc_id")
    n = {(r["grade"], r["keep"]): r["count"] for r in scored.groupBy("grade", "keep").count().collect()}
    share = lambda g, k: n.get((g, k), 0) / (n.get((g, k), 0) + n.get((g, not k), 0))
    assert share(0, False) > 0.99 and share(1, False) > 0.9 and share(2, True) > 0.985
    assert all(r["tail"][0] >= r["tail"][1] for r in scored.limit(200).collect())


def test_slopes_are_those_of_the_likelihood():
    """The gradient against differences of a likelihood written out row by row."""
    rng = np.random.default_rng(4)
    rows = [rng.choice(6, rng.integers(0, 5), replace=False) for _ in range(30)]
    grades, heard, ridge = rng.integers(0, 4, 30), rng.random(30), 0.3
    where = np.repeat(np.arange(30), [len(r) for r in rows])
    column = np.concatenate(rows).astype(np.int64)

    def loss(x):
        w, t = x[:6], [x[6], x[6] + math.exp(x[7]), x[6] + math.exp(x[7]) + math.exp(x[8])]
        total = ridge / 2 * sum(c * c for c in w)
        for r, g, h in zip(rows, grades, heard):
            s = sum(w[k] for k in r)
            p = [1.0, *(1 / (1 + math.exp(c - s)) for c in t), 0.0]
            total -= h * math.log(p[g] - p[g + 1])
        return total

    x = rng.normal(size=9) * 0.5
    value, slope = quality.slopes(x[:6], x[6], x[7:], where, column, grades, heard, ridge)
    assert value == pytest.approx(loss(x))
    for k in range(9):
        e = np.zeros(9)
        e[k] = 1e-6
        assert slope[k] == pytest.approx((loss(x + e) - loss(x - e)) / 2e-6, abs=1e-6)


def plain_features(text):
    """Names of the word features of a text, by their definition."""
    seen = Counter()
    for plain in {w.lower().strip(quality.STRIP) for w in text.encode().split()}:
        seen.update({plain} | {plain[:n] + b" " for n in quality.PREFIXES if len(plain) > n})
    return {(name, level) for name, n in seen.items() for level, least in enumerate(quality.TIMES) if n >= least}


def test_scores_are_sums_of_weights(spark):
    """The query's scores, grades and tails against features looked up one by one."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    model = quality.fit(docs, quality.graded_labels(spark.read.parquet(f"{d}/labels.parquet")), 3, marks=False)
    weight = model.table()
    assert len(weight) > 3
    want = {r["doc_id"]: sum(weight.get(i, 0.0) for i in {quality.place(*f) for f in plain_features(r["text"] or "")}) for r in docs.collect()}
    for r in quality.grade(docs, model).collect():
        s = r["score"]
        tail = [1 / (1 + math.exp(t - s)) for t in model.thresholds]
        assert s == pytest.approx(want[r["row"]["doc_id"]], abs=1e-9)
        assert r["tail"] == pytest.approx(tail) and r["expected_grade"] == pytest.approx(sum(tail))


def test_quality_of_repeated_rows(spark):
    """Repeated ids and labels count once for each pair, and the bound holds after the join."""
    docs = spark.createDataFrame([(k % 3, f"good words {k % 3} here", k) for k in range(60)], "doc_id bigint, text string, row int").withColumn("tail", F.lit("x"))
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (2, 2)], "doc_id bigint, grade int")
    scored = quality.grade(docs, quality.fit(docs, labels, 3, sample=20)).collect()
    assert len(scored) == 60 and {r["row"]["tail"] for r in scored} == {"x"}
    assert len({(r["row"]["doc_id"], r["score"]) for r in scored}) == 3


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "word " * 100_000, 3)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (9, 2), (1, 7)], "doc_id bigint, grade int")
    model = quality.fit(docs, labels, 3)
    assert quality.grade(docs, model).count() == 3
    bare = quality.fit(docs, labels.limit(0), 3)
    assert {round(r["expected_grade"], 3) for r in quality.grade(docs, bare).collect()} == {2.0}
    assert quality.grade(docs.limit(0), bare).count() == 0


# ------------------------------------------------------------------- sentencepiece
@pytest.fixture(scope="module")
def model():
    return queries.file_content("piece_bpe_32k.model")


ODD = ["  two  spaces ", "\n\nx", "", " ", "日本語 text 🎉 émigré", "a\tb\r\nc   d", "x" * 3000, "a ", " a", "a  ", "▁▁ b", "a▁b", "\0"]


def test_ids_equal_the_library(spark, model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + ODD
    e = pieces.Encoder(pieces.Vocabulary(model), room=100, pair_room=100)
    ids = e.encode(texts)
    assert ids == library.encode(texts)
    assert [e.decode(i) for i in ids] == [library.decode(i) for i in ids]
    assert all(e.decode(i) == t for i, t in zip(ids, texts) if "▁" not in t)


def test_unigram_search_is_best(model):
    """The same recurrence with scores, against all segmentations of short words."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto.FromString(model)
    m.trainer_spec.model_type = pieces.UNIGRAM
    e = pieces.Encoder(pieces.Vocabulary(m.SerializeToString()))

    def best(u):
        found = [0.0] + [-1e18] * len(u)
        for end in range(1, len(u) + 1):
            for start in range(end):
                i = e.v.ids.get(u[start:end])
                if i is not None or end - start == 1:
                    found[end] = max(found[end], found[start] + (e.v.lowest if i is None else e.v.score[i]))
        return found[-1]

    rng = random.Random(1)
    words = {"▁" + "".join(rng.choice("abcdehinorst日") for _ in range(rng.randrange(1, 12))) for _ in range(400)}
    for u, ids in e.segment(words):
        own = sum(e.v.score[i] if e.v.type[i] != pieces.BYTE else 0 for i in ids)
        own += e.v.lowest * (sum(e.v.type[i] == pieces.BYTE for i in ids) // 3)
        assert own == pytest.approx(best(u))


def test_very_long_words(model):
    """Memory in proportion to the word, which is not remembered afterwards; ids equal the library's."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(3)
    blob = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/") for _ in range(1_000_000))
    e = pieces.Encoder(pieces.Vocabulary(model))
    e.encode(["warm up"])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ids = e.encode([blob, blob[:300_000] + " b"])
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 500
    assert ids[0] == library.encode(blob) and e.decode(ids[1]) == blob[:300_000] + " b"
    assert max(map(len, e.known)) <= pieces.LONG


def test_tokenize_rows(spark, model):
    docs = spark.createDataFrame([(1, "Hello world", 5), (2, None, 6), (None, "", 7), (1, "Hello world", 5)], "doc_id bigint, text string, ids int")
    got = pieces.tokenize(docs, model).collect()
    assert len(got) == 4 and all(r["restored"] for r in got)
    assert {r["n_tokens"] for r in got if r["row"]["ids"] == 5} == {2}
    back = pieces.detokenize(pieces.tokenize(docs, model).select("row.doc_id", "ids"), model).collect()
    assert sorted(r["text"] for r in back) == ["", "", "Hello world", "Hello world"]
    assert pieces.tokenize(docs.limit(0), model).count() == 0


# ------------------------------------------------------------------------- ordering
@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 64, 1000])
def test_permutation(n):
    f = ordering.Feistel(n, b"k")
    s = f.slot(np.arange(n))
    assert sorted(s.tolist()) == list(range(n)) and (f.index(s) == np.arange(n)).all()
    if n == 1000:
        assert (s != ordering.Feistel(n, b"other").slot(np.arange(n))).mean() > 0.9
        assert abs(np.corrcoef(s, np.arange(n))[0, 1]) < 0.15


def test_shards_hold_every_sequence_once(spark):
    ranks = queries.file_content("byte_bpe_50k.tiktoken")
    encoding = ordering.byte_pairs(ranks, queries.SPLIT_PATTERN)
    assert queries.END_OF_TEXT not in {int(x.split()[1]) for x in ranks.splitlines()}
    docs = [(i, " ".join(f"word{i * k}" for k in range(i))) for i in range(40)] + [(40, None), (41, "<|endoftext|>"), (None, "x"), (5, "again"), (5, "again")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, slot int").repartition(5)
    shards = ordering.training_order(df, ranks, queries.SPLIT_PATTERN, queries.END_OF_TEXT, length=16, per_shard=8)
    rows = shards.orderBy("shard").collect()
    assert [r["shard"] for r in rows] == list(range(len(rows))) and all(r["first_slot"] == 8 * r["shard"] for r in rows)
    size, found = ordering.stride(16), {}
    for r in rows:
        assert len(r["payload"]) == r["n_sequences"] * size
        for k in range(r["n_sequences"]):
            i, part, ids = ordering.read_record(bytes(r["payload"])[k * size : (k + 1) * size])
            found.setdefault(i, []).append((part, ids.tolist()))
    want: dict = {}
    for i, t in docs:
        ids = encoding.encode_ordinary(t or "") + [queries.END_OF_TEXT]
        want.setdefault(ordering.NO_ID if i is None else i, []).extend((k, ids[16 * k : 16 * k + 16]) for k in range(-(-len(ids) // 16)))
    assert {i: sorted(x) for i, x in found.items()} == {i: sorted(x) for i, x in want.items()}
    some = ordering.read_slots(shards, 5, 21, 16, 8).orderBy("slot").collect()
    assert [r["slot"] for r in some] == list(range(5, 21))
    whole = b"".join(bytes(r["payload"]) for r in rows)
    assert b"".join(bytes(r["record"]) for r in some) == whole[5 * size : 21 * size]
    assert ordering.training_order(df.limit(0), ranks, queries.SPLIT_PATTERN, queries.END_OF_TEXT).count() == 0


def test_slots_are_the_permutation_of_places(spark, tmp_path):
    """Sequence number i stands in slot(i), in rows and in files; files are resumed and read from any slot."""
    ranks = b"\n".join(base64.b64encode(bytes([k])) + b" %d" % k for k in range(256))
    docs = [(i, "x" * (7 * i % 40)) for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    shards = ordering.training_order(df, ranks, queries.SPLIT_PATTERN, 256, key=b"k", length=8, per_shard=10)
    places = [(i, part) for i, t in docs for part in range(-(-(len(t) + 1) // 8))]
    order = ordering.Feistel(len(places), b"k")
    want = dict(zip(order.slot(np.arange(len(places))).tolist(), places))
    assert [want[k] for k in range(len(places))] != places
    folder = f"file://{tmp_path}/shards"
    first = ordering.write_shards(shards, folder).collect()
    assert all(r["written"] for r in first) and [r["n_bytes"] for r in first] == [r["n_sequences"] * ordering.stride(8) for r in first]
    files = ordering.ShardFiles(folder, 8, 10)
    found = [(slot, ordering.read_record(blob)) for slot, blob in files.read()]
    assert [s for s, _ in found] == list(range(len(places)))
    assert {s: x[:2] for s, x in found} == want
    assert list(files.read(13, 27)) == [(s, b) for s, b in files.read() if 13 <= s < 27]
    # a lost and a torn file are written again, the others are left
    (tmp_path / "shards" / ordering.shard_name(1)).unlink()
    (tmp_path / "shards" / ordering.shard_name(2)).write_bytes(b"torn")
    again = {r["shard"]: r["written"] for r in ordering.write_shards(shards, folder).collect()}
    assert [s for s, w in again.items() if w] == [1, 2] and not list((tmp_path / "shards").glob("*.part"))
    assert [b for _, b in files.read()] == [b for _, b in files.read(0, len(places))] and len(list(files.read())) == len(places)
    assert ordering.write_shards(shards.limit(0), f"file://{tmp_path}/none").count() == 0


def test_width_of_ids():
    assert ordering.id_bytes(b"YQ== 0\nYg== 70000", 5) == 4 and ordering.id_bytes(b"YQ== 0", 65_535) == 2
    blob = ordering.records(1, np.array([70_000]), 5, 4, 4)[0]
    assert ordering.read_record(blob, 4)[2].tolist() == [70_000, 5]
    with pytest.raises(ValueError):
        ordering.records(1, np.array([70_000]), 5, 4, 2)


def test_memory_of_words_is_bounded():
    """A worker that lives on holds few words, however many it met, and their ids stay right."""
    model = queries.file_content("piece_bpe_32k.model")
    e = pieces.Encoder(pieces.Vocabulary(model))
    for k in range(8):
        texts = [" ".join(f"{i:x}k{k}" for i in range(50_000))]
        ids = e.encode(texts)
    assert [e.decode(i) for i in ids] == texts
    assert len(e.known) + len(e.older) <= 300_000
    assert pieces.TOGETHER <= 2_000_000


def test_groups_give_freed_memory_back(monkeypatch):
    from palimpsest.llm import shared

    trimmed = []
    monkeypatch.setattr(shared, "trim", lambda: trimmed.append(1))
    assert shared.tidy_group(lambda key, table: (key, table))(1, 2) == (1, 2)
    assert shared.tidy_cogroup(lambda key, a, b: (key, a, b))(1, 2, 3) == (1, 2, 3)
    assert len(trimmed) == 2


# ------------------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality classifier", "near-duplicates", "repeated windows", "source mixture", "token ids"]
    before = None
    for k, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, SMALL)
        if k < len(p.STAGES) - 1:
            assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        out.write.parquet(f"file://{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"file://{tmp_path}/{k}")
        assert 0 < docs.count() <= before.count()
        if k == 1:
            assert docs.groupBy("text").count().filter("count > 1").count() == 0
        if k == 2:
            assert docs.filter(F.length("text") != F.col("n_chars")).count() == 0
    run = {(r["doc_id"], hashlib.sha256(repr(r["ids"]).encode()).hexdigest()) for r in p.run(spark, SMALL).collect()}
    assert run == {(r["doc_id"], hashlib.sha256(repr(r["ids"]).encode()).hexdigest()) for r in docs.collect()}


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline as p

    shape = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, None, None, None, None), (None, "a b c", "en", "src1", 5), (2, "", "", "", 0), (3, "same words here", "en", "src2", 15), (3, "same words here", "en", "src2", 15), (4, "same words here", "de", "x", 15)]
    spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for n, data in (("full", rows), ("none", [])):
        docs = spark.createDataFrame(data, shape)
        for k, (_, stage) in enumerate(p.STAGES):
            stage(spark, docs, f"file://{tmp_path}").write.parquet(f"file://{tmp_path}/{n}{k}")
            docs = spark.read.parquet(f"file://{tmp_path}/{n}{k}")


def test_near_duplicates_of_rows_with_clashing_names(spark):
    """Columns named like ours, repeated ids with different texts, and null ids stay whole."""
    import corpus_pipeline as p

    words = [" ".join(f"{x}{k}" for k in range(30)) for x in "abc"]
    shape = "doc_id bigint, text string, again bigint, gone bigint, node string, row int, id int"
    rows = [(1, words[0]), (2, words[0]), (2, words[1]), (2, words[1]), (3, words[2]), (None, words[2]), (None, None)]
    docs = spark.createDataFrame([(*r, 7, 8, "n", 9, 1) for r in rows], shape)
    got = p.drop_near_duplicates(spark, docs, SMALL)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(1, words[0]), (2, words[1]), (3, words[2]), (None, words[2]), (None, None)], key=repr)
