"""The registered queries of this subpackage: thin callers of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, ctw, mixing, neighbours, ordering, pieces, quality, simhash, windows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.read_conversations(chat.format_conversations(rows))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = F.array_join("loss_texts", "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(F.array_join(lines, "")).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"),
        digest(masked).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), per AS (
  SELECT *, length(regexp_replace(role, '<(\\*)(/?turn>|text>)', '<\\\1\2', 'g'))
    + length(regexp_replace(text, '<(\\*)(/?turn>|text>)', '<\\\1\2', 'g')) + length('<turn><text></turn>') AS chars
  FROM said
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM per GROUP BY conv_id
"""


def op2_voronoi_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.voronoi_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.graded_labels(table(spark, sf_dir, "labels")), 3)
    tail = F.col("tail")
    return quality.grade(docs, model).select(
        "row.doc_id", "score", "expected_grade", tail[0].alias("p_good"), tail[1].alias("p_good_clean"), (tail[1] >= 0.5).alias("selected")
    )


def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.cross_polytope_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op5_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored = ctw.score(table(spark, sf_dir, "documents"), held_out)
    return scored.withColumnRenamed("id", "doc_id")


#: Where the files of the public tokenizers are.
TOKENIZERS = "/opt/tokenizers"


def file_content(name: str, folder: str | None = None) -> bytes:
    with open(f"{folder or TOKENIZERS}/{name}", "rb") as f:
        return f.read()


#: The split pattern of the byte-level vocabulary, and its free id.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = 50256


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = file_content("byte_bpe_50k.tiktoken")
    return ordering.training_order(table(spark, sf_dir, "documents"), ranks, SPLIT_PATTERN, END_OF_TEXT)


def op7_sentencepiece_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.tokenize(docs, file_content("piece_bpe_32k.model")).select("row.doc_id", "n_tokens", "ids", "restored")


def op8_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.fingerprint_components(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


#: Target weights of the mixture; nodes that are not named weigh 1.
MIX_WEIGHTS = (
    ("web", None, None, 5.0),
    ("books", None, None, 3.0),
    ("code", None, None, 2.0),
    *((d, lang, None, w) for d in ("web", "books", "code") for lang, w in (("en", 5.0), ("de", 2.0), ("fr", 2.0), ("es", 1.0))),
)


def mix_domain(source):
    """The domain of a source by its number: 0-9 web, 10-14 books, others code."""
    n = F.regexp_extract(source, "([0-9]+)$", 1)
    n = F.when(n != "", n.cast("int"))
    return F.when(n < 10, "web").when(n < 15, "books").otherwise("code")


def mix_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MIX_WEIGHTS, "domain string, lang string, source string, weight double")


def op9_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix_sources(docs, mix_weights(spark), mix_domain(F.col("source")))
    return mixed.select("row.doc_id", "domain", "lang", "source", "tokens", "epoch")


def _op9_sql() -> str:
    weights = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in w) + ")" for w in MIX_WEIGHTS)
    levels = ("domain", "lang", "source")
    flow = ""
    for depth, child in enumerate(levels):
        path, parent = ", ".join(levels[: depth + 1]), ", ".join(levels[:depth])
        by = f"PARTITION BY {parent}" if parent else ""
        below = "".join(f" AND w.{x} IS NULL" for x in levels[depth + 1 :])
        own = " AND ".join(f"w.{x} = s.{x}" for x in levels[: depth + 1])
        budget = "(SELECT sum(tokens) * 0.5::DOUBLE FROM leaves)" if not depth else "p.budget"
        join = "" if not depth else f"JOIN b{depth - 1} p ON " + " AND ".join(f"p.{x} = s.{x}" for x in levels[:depth])
        flow += f"""
, s{depth} AS (SELECT {path}, CAST(sum(tokens) * 2 AS DOUBLE) AS capacity FROM leaves GROUP BY {path})
, g{depth} AS (
  SELECT s.*, coalesce(w.weight, 1.0)::DOUBLE AS weight, {budget} AS budget
  FROM s{depth} s LEFT JOIN weights w ON {own}{below} {join}
), l{depth} AS (
  SELECT *, (budget - coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, capacity / weight AS ratio
  FROM g{depth} WINDOW o AS ({by} ORDER BY capacity / weight, {child})
), f{depth} AS (
  SELECT *, arg_min(level, row(ratio, {child})) FILTER (WHERE ratio > level) OVER ({by}) AS rest FROM l{depth}
), b{depth} AS (SELECT {path}, CASE WHEN ratio <= level THEN capacity ELSE greatest(0, weight * rest) END AS budget FROM f{depth})"""
    return f"""
WITH weights(domain, lang, source, weight) AS (VALUES {weights}),
named AS (
  SELECT doc_id, CASE WHEN n < 10 THEN 'web' WHEN n < 15 THEN 'books' ELSE 'code' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, tokens
  FROM (SELECT doc_id, lang, source, try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS n,
      len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents)
), leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM named GROUP BY ALL){flow}
, ordered AS (
  SELECT doc_id, n.domain, n.lang, n.source, n.tokens, e.epoch, floor(b2.budget) AS budget,
    sum(n.tokens) OVER (PARTITION BY n.domain, n.lang, n.source ORDER BY e.epoch, md5('42|' || e.epoch || '|' || doc_id)) AS reached
  FROM named n JOIN b2 ON n.domain = b2.domain AND n.lang = b2.lang AND n.source = b2.source CROSS JOIN (VALUES (0), (1)) e(epoch)
)
SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT) AS tokens, CAST(epoch AS INTEGER) AS epoch FROM ordered WHERE reached <= budget
"""


def op10_rabin_karp_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = windows.remove_repeated_windows(docs, with_text=False)
    return cut.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i + 1:i + 35], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)
), again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win SEMI JOIN again USING (h), range(0, 35) r(j)),
lists AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

QUERIES = {
    "op1_chat_reply_trees": op1_chat_reply_trees,
    "op2_voronoi_knn_join": op2_voronoi_knn_join,
    "op3_ordinal_quality": op3_ordinal_quality,
    "op4_cross_polytope": op4_cross_polytope,
    "op5_context_tree_weighting": op5_context_tree_weighting,
    "op6_feistel_shards": op6_feistel_shards,
    "op7_sentencepiece_trie": op7_sentencepiece_trie,
    "op8_simhash_golay": op8_simhash_golay,
    "op9_hierarchical_mix": op9_hierarchical_mix,
    "op10_rabin_karp_windows": op10_rabin_karp_windows,
}
SQL = {
    "op1_chat_reply_trees": OP1_SQL,
    "op2_voronoi_knn_join": OP2_SQL,
    "op9_hierarchical_mix": _op9_sql(),
    "op10_rabin_karp_windows": OP10_SQL,
}
