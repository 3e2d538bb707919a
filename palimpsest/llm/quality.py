"""Quality classifier: ordinal cumulative-link regression on hashed text.

Grades are ordered integers 0 .. K - 1.  One weight vector over hashed features
gives a score s(x); ordered thresholds t_1 < ... < t_{K-1} cut the line:
P(grade >= k | x) = sigmoid(s(x) - t_k).  From these follow the expected grade
(their sum) and the tail probability used for selection.

Features of a text are present or not: its distinct lower-case words stripped of
punctuation, their prefixes of some lengths (each also as "in two words or more"
and "in four or more"), and coarse marks of its shape (how many words end in
symbols, are upper case, are bars, repeat the word before; how many are distinct;
its length).  Presence instead of frequency, so that one word weighs the same in a
long text.  Features whose chi-square against the grades could be chance are left
out before the fit; a corpus has many words that occur once.

``fit`` looks at no more than ``sample`` labelled documents, the first by a hash
of their id, and where ids repeat the first by a hash of id and text; that bound is
the only one, scoring reads whole texts of all rows.  Rows that repeat count each.
Extra columns of any name pass through in ``row``.  An empty table gives no rows.
Null texts are empty; null ids are scored but not learned from; labels that are
null or outside the grades are not used; documents with several labels count once
for each.  Without any label all documents get the highest grade.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import encoded, small_batches, tidy, trim

BITS = 22
#: Lengths, in bytes, of the prefixes of words.
PREFIXES = (4, 5, 6, 7, 8)
#: A word or prefix counts again when this many distinct words have it.
TIMES = (1, 2, 4)
STRIP = b".,;:!?\"'()[]{}<>*$%&#|-_"
#: Shares are cut at these places to give marks.
CUTS = (0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.75)
SYMBOLS = frozenset(b"*$%&#!")


def shape_marks(n: int, distinct: int, symbol: int, upper: int, bar: int, again: int) -> list[bytes]:
    """Names of the shape features of n words; they start with a space, which no word does."""
    if not n:
        return [b" empty"]
    shares = {b" symbol": symbol, b" upper": upper, b" bar": bar, b" again": again, b" varied": distinct}
    marks = [name + b">%d" % i for name, s in shares.items() for i, cut in enumerate(CUTS) if s / n > cut]
    return marks + [b" length>%d" % i for i in range(n.bit_length())]


def place(name: bytes, level: int = 0) -> int:
    """Index of a feature: a hash of its name, then two bits for how often it is met."""
    return (zlib.crc32(name) & ((1 << BITS) - 1)) << 2 | level


class Features:
    """Feature indices of texts, with a bounded cache of words.

    ``wanted``: only these indices are of interest.  Most words then have none, and
    a text costs one look into the cache for each distinct word.
    """

    def __init__(self, wanted=None, room: int = 100_000, marks: bool = True):
        self.wanted = None if wanted is None else frozenset(wanted)
        self.names = None if wanted is None else frozenset(i >> 2 for i in self.wanted)
        self.room, self.cache, self.marks = room, {}, marks

    def _keys(self, word: bytes) -> tuple[int, ...]:
        """Hashes of a word and its prefixes, as far as they are of interest."""
        keys = [place(word) >> 2, *(place(word[:n] + b" ") >> 2 for n in PREFIXES if len(word) > n)]
        return tuple(keys if self.names is None else [k for k in keys if k in self.names])

    def _entry(self, word: bytes) -> tuple:
        """(stripped word, its keys, ends in a symbol?, upper case?); () where all of it is nothing."""
        plain = word.lower().strip(STRIP)
        keys, symbol, upper = self._keys(plain), word[-1] in SYMBOLS, len(word) > 1 and word.isupper()
        return (plain, keys, symbol, upper) if keys or symbol or upper else ()

    def indices(self, text: bytes) -> list[int]:
        """Sorted distinct feature indices of a text."""
        words = text.split()
        count = Counter(words)
        if len(self.cache) > self.room:
            self.cache.clear()
        cache, seen, times, symbol, upper = self.cache, set(), {}, 0, 0
        for w, n in count.items():
            e = cache.get(w)
            if e is None:
                e = cache[w] = self._entry(w)
            if e:
                plain, keys, s, u = e
                symbol += n * s
                upper += n * u
                if keys and plain not in seen:
                    seen.add(plain)
                    for k in keys:
                        times[k] = times.get(k, 0) + 1
        found = {k << 2 | level for k, n in times.items() for level, least in enumerate(TIMES) if n >= least}
        if self.marks:
            again = sum(map(eq, words, islice(words, 1, None)))
            found.update(map(place, shape_marks(len(words), len(count), symbol, upper, count[b"|"], again)))
        return sorted(found if self.wanted is None else found & self.wanted)


@dataclass
class Model:
    """Shared weights of the features in use, and ordered thresholds."""

    index: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def table(self) -> dict[int, float]:
        return dict(zip(self.index.tolist(), self.weights.tolist()))

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K - 1, one row per score."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -40, 40)))


def screened(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, strict: float = 4.0, least: int = 6) -> np.ndarray:
    """Features in at least ``least`` documents whose chi-square against the grades is no chance.

    The bar is ``strict`` times the logarithm of the number of features compared;
    2 would let about one of them pass by chance if documents were independent,
    and copies make them less so.
    """
    own = np.bincount(grades, minlength=n_grades).astype(np.float64)

    def counted(k: int | None) -> np.ndarray:
        """How many rows of grade k, or of all grades, have each feature; one such array is held at a time."""
        seen = np.zeros(4 << BITS, dtype=np.uint16 if len(rows) < 1 << 16 else np.uint32)
        for r, g in zip(rows, grades):
            if k is None or g == k:
                seen[r] += 1  # the features of a row are distinct
        return seen

    total = counted(None)
    some = np.flatnonzero((total >= least) & (total <= len(rows) - least))
    t, n, chi = total[some].astype(np.float64), float(len(rows)), np.zeros(len(some))
    del total
    for k in range(n_grades):
        if own[k]:
            expected = own[k] * t / n
            gap = (counted(k)[some] - expected) ** 2
            chi += gap / expected + gap / np.maximum(own[k] - expected, 1e-9)
    return some[chi > strict * np.log(len(some) + 1)]


def thresholds(first: float, gaps: np.ndarray) -> np.ndarray:
    """Ordered thresholds from the first one and the logarithms of their gaps."""
    return first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))


def slopes(w: np.ndarray, first: float, gaps: np.ndarray, where: np.ndarray, column: np.ndarray, grades: np.ndarray, heard: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """(loss, gradient by w, first and gaps) of the negative log likelihood with a ridge.

    Feature ``column[k]`` is present in row ``where[k]``; row i counts ``heard[i]``.
    """
    n, n_grades, i = len(grades), len(gaps) + 2, np.arange(len(grades))
    s = np.bincount(where, w[column], n)
    tail = 1 / (1 + np.exp(-np.clip(s[:, None] - thresholds(first, gaps), -40, 40)))
    # P(grade = g) = P(>= g) - P(>= g + 1)
    edge = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
    slope = edge * (1 - edge)
    p = np.maximum(edge[i, grades] - edge[i, grades + 1], 1e-12)
    up, low = heard * slope[i, grades] / p, heard * slope[i, grades + 1] / p
    dt = (np.bincount(grades, up, n_grades + 1) - np.bincount(grades + 1, low, n_grades + 1))[1:n_grades]
    dgaps = np.cumsum(dt[::-1])[::-1][1:] * np.exp(gaps)
    loss = -(heard * np.log(p)).sum() + ridge / 2 * (w * w).sum()
    return loss, np.concatenate([np.bincount(column, (low - up)[where], len(w)) + ridge * w, [dt.sum()], dgaps])


def fit_arrays(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, rounds: int = 800, rate: float = 0.1, ridge: float = 1e-4, balance: float = 0.5) -> Model:
    """Maximum likelihood by Adam steps over the whole sample, with a ridge on the weights.

    A grade weighs its frequency to the power of ``-balance``, so that rare grades
    are heard.  Thresholds are kept in order by modelling their gaps as exponentials.
    """
    if not len(rows):
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), np.full(n_grades - 1, -10.0))
    used = screened(rows, grades, n_grades)
    # the features of a row are sorted, and so are those in use
    kept = [np.flatnonzero(np.isin(used, r, assume_unique=True)) for r in rows]
    where = np.repeat(np.arange(len(rows)), [len(r) for r in kept])
    column = np.concatenate(kept).astype(np.int64)
    w, first, gaps = np.zeros(len(used)), -1.0, np.zeros(n_grades - 2)
    state = [np.zeros(len(used) + n_grades - 1) for _ in range(2)]
    own = np.bincount(grades, minlength=n_grades)
    heard = (np.maximum(own, 1) ** -balance)[grades]
    heard /= heard.sum()
    for step in range(1, rounds + 1):
        _, g = slopes(w, first, gaps, where, column, grades, heard, ridge)
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        w -= move[: len(used)]
        first -= move[len(used)]
        gaps -= move[len(used) + 1 :]
    return Model(used, w, thresholds(first, gaps))


def fit(docs: DataFrame, grades: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text", sample: int = 10_000, marks: bool = True, **how) -> Model:
    """Fit on at most ``sample`` rows of ``grades(id, grade)`` joined with their texts.

    ``marks``: whether the marks of a text's shape are features besides its words.
    """
    small_batches(docs.sparkSession)
    usable = grades.filter(F.col(id_col).isNotNull() & F.col("grade").between(0, n_grades - 1))
    some = usable.select(id_col, F.col("grade").cast("int").alias("grade")).orderBy(F.xxhash64(id_col), id_col, "grade").limit(sample)
    # the sample is bounded, so it may be broadcast and its texts are not shuffled
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).join(F.broadcast(some), id_col)

    def run(batches):
        f = Features(room=50_000, marks=marks)
        for b in batches:
            lists = pa.array([f.indices(x) for x in encoded(b.column(0))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), lists], names=["name", "grade", "features"])

    name = F.xxhash64(id_col, "text").alias("name")
    featured = rows.select("text", name, "grade").mapInArrow(tidy(run), "name bigint, grade int, features array<int>")
    # ids may repeat, so the rows that reach the driver are bounded once more
    table = featured.orderBy("name", "grade").limit(sample).toArrow()
    grade_of = table.column("grade").to_numpy().astype(np.int64)
    order = np.lexsort((grade_of, table.column("name").to_numpy()))  # the same whatever order rows arrive in
    lists = table.column("features").combine_chunks()
    values, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() if len(lists) else np.zeros(1, dtype=np.int64)
    features = [values[at[k] - at[0] : at[k + 1] - at[0]] for k in order]
    model = fit_arrays(features, grade_of[order], n_grades, **how)
    del table, featured, lists, values, at, features
    trim()
    return model


def grade(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row STRUCT of all columns, score, expected_grade, tail ARRAY<DOUBLE>) for every row."""
    small_batches(docs.sparkSession)
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**24 weights and K - 1 thresholds

    def run(batches):
        m = shared.value
        weights = m.table()
        f = Features(weights)
        for b in batches:
            s = np.array([sum(map(weights.__getitem__, f.indices(x))) for x in encoded(b.column(0).field(text_col))], dtype=np.float64)
            tail = m.tails(s)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(s), pa.array(tail.sum(axis=1)), pa.array(list(tail), pa.list_(pa.float64()))],
                names=["row", "score", "expected_grade", "tail"],
            )

    return docs.select(kept).mapInArrow(tidy(run), _schema(docs, kept))


def _schema(docs: DataFrame, row: Column):
    from pyspark.sql import types as T

    fields = [docs.select(row).schema["row"], T.StructField("score", T.DoubleType()), T.StructField("expected_grade", T.DoubleType())]
    return T.StructType([*fields, T.StructField("tail", T.ArrayType(T.DoubleType()))])


def graded_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 poor or unknown quality, 1 good but toxic, 2 good and not toxic."""
    good, toxic = F.col("quality") > 0, F.col("toxic") > 0
    return labels.select("doc_id", F.when(good & ~F.coalesce(toxic, F.lit(False)), 2).when(good, 1).when(F.col("quality") == 0, 0).alias("grade"))
