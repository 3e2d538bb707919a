"""SentencePiece encoding and decoding with a Viterbi search shared along a trie.

A text is marked (one space in front, spaces written as U+2581) and cut where no
piece of the vocabulary can reach across: before a mark that follows something
else, and around characters that occur in no longer piece.  The distinct units of
a batch are sorted, which lists a trie depth-first; the forward cells of a unit
stay in place for the next one up to their common prefix and only the rest is
computed.

The cell at a position holds the best segmentation that ends there.  For a
unigram model that is the one of largest score.  For a merge (BPE) model it is
the one whose neighbouring pieces would each survive merging, i.e. two pieces may
stand next to each other if merging their joined characters by the model's own
ranks gives those two back; exactly one segmentation of a prefix has only such
neighbours, and it is the one that merging gives.  So both kinds of model are
searched by one recurrence and agree with the public library.

Characters that the vocabulary lacks become byte pieces, or the unknown piece.
Null texts are empty; the empty text has no ids.  Decoding inverts encoding for
every text but for pieces that are unknown without byte fallback, and except that
a text of only the mark U+2581 itself cannot be told from spaces, as in the
library.  Ids outside the vocabulary decode to nothing.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Bytes of text whose words are sorted into one trie.
TOGETHER = 2_000_000
#: Longer words are encoded, but not remembered.
LONG = 64
#: Words with the spaces before them, and spaces that nothing follows.
RUNS = re.compile(" *[^ ]+| +")


class Vocabulary:
    """Pieces, scores and settings read from a model file; never trained here."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto.FromString(model)
        self.kind = m.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.identity = m.normalizer_spec.name == "identity" and not m.normalizer_spec.precompiled_charsmap
        self.collapse = m.normalizer_spec.remove_extra_whitespaces
        self.prefix = m.normalizer_spec.add_dummy_prefix
        if not self.prefix:
            raise ValueError("only models that put a space in front of a text are supported")
        if not self.identity or self.collapse or not m.normalizer_spec.escape_whitespaces:
            raise ValueError("the model normalises texts, which is not supported")
        self.text = [p.piece for p in m.pieces]
        self.type = [p.type or NORMAL for p in m.pieces]
        self.score = [p.score for p in m.pieces]
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.text, self.type)) if t in (NORMAL, USER)}
        self.unknown = next(i for i, t in enumerate(self.type) if t == UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.text, self.type)) if t == BYTE}
        self.longest = max(map(len, self.ids))
        self.lowest = min(self.score[i] for i in self.ids.values()) - 10.0
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces reach across words, which is not supported")
        # a line feed that occurs in no longer piece stands alone, so lines are cut apart
        self.lines = "\n" not in inner
        self.units = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    # ------------------------------------------------------------- merge models
    def merged(self, text: str) -> list[str]:
        """Merge neighbouring pieces, best score first and leftmost at ties, until none can."""
        parts = list(text)
        while True:
            best = max(((self.score[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]


class Encoder:
    """Encodes and decodes with a bounded memory of words seen before.

    A word is what stands between single spaces or line feeds, or, where spaces are
    doubled, a run of spaces with what follows it.  Words of more than ``LONG``
    characters are not remembered, so the memory is bounded in bytes.
    """

    def __init__(self, vocabulary: Vocabulary, room: int = 100_000, pair_room: int = 1_000_000):
        self.v, self.room, self.pair_room = vocabulary, room, pair_room
        # what was seen lately, and before that; a word that comes back moves up
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.long: list[str] = []
        self.joints = " \n" if vocabulary.lines else " "
        #: by a piece, which pieces before it may stay there, and how many answers are held
        self.pairs: list[dict[int, bool]] = [{} for _ in vocabulary.text]
        self.n_pairs = 0
        self.texts = [self._bytes_of(i) for i in range(len(vocabulary.text))]
        # pieces that merging would not leave as they are can end no segmentation
        self.usable = vocabulary.ids
        if vocabulary.kind == BPE:
            self.usable = {p: i for p, i in vocabulary.ids.items() if len(p) == 1 or vocabulary.merged(p) == [p]}
        ends: dict[str, set[int]] = {}
        for p in self.usable:
            if len(p) > 1:
                ends.setdefault(p[-3:], set()).add(len(p))
        #: lengths of the longer pieces by the last three characters of a text, longest
        #: first; endings met with in texts are added, those of two characters at the end
        self.ends, self.lengths = ends, {}

    # ---------------------------------------------------------------- the search
    def _fits(self, a: str, i, b: str, j) -> bool:
        """Would merging the characters of both pieces leave these two?"""
        ok = self.v.merged(a + b) == [a, b]
        if i is not None and j is not None:
            if self.n_pairs > self.pair_room:
                for held in self.pairs:
                    held.clear()
                self.n_pairs = 0
            self.pairs[j][i] = ok
            self.n_pairs += 1
        return ok

    def _sizes(self, tail: str) -> tuple[int, ...]:
        if len(self.lengths) > self.pair_room:
            self.lengths.clear()
        found = set(self.ends.get(tail, ()))
        if len(tail) > 1 and tail[-2:] in self.usable:
            found.add(2)
        out = self.lengths[tail] = tuple(sorted(found, reverse=True))
        return out

    def _extend_merging(self, unit: str, starts: list, last: list, scores: list) -> None:
        """Append the cells of the prefixes of ``unit`` that are not there yet.

        A cell is where the last piece of the segmentation that ends there starts, and
        the id of that piece (none for a character that the vocabulary lacks).
        """
        usable, lengths, pairs = self.usable.get, self.lengths.get, self.pairs
        begin, name = starts.append, last.append
        for end in range(len(starts), len(unit) + 1):
            tail = unit[end - 3 : end] if end > 2 else unit[:end]
            sizes = lengths(tail)
            for n in self._sizes(tail) if sizes is None else sizes:
                at = end - n
                if at > 0:
                    i = usable(unit[at:end])
                    if i is None:
                        continue
                    j = last[at]
                    ok = None if j is None else pairs[i].get(j)
                    if ok is None:
                        ok = self._fits(unit[starts[at] : at], j, unit[at:end], i)
                    if not ok:
                        continue
                elif at or (i := usable(unit[:end])) is None:
                    continue
                begin(at)
                name(i)
                break
            else:
                begin(end - 1)
                name(usable(unit[end - 1]))

    def _extend_scoring(self, unit: str, starts: list, last: list, scores: list) -> None:
        """As above, by the largest sum of scores; longer last pieces win ties."""
        usable, score = self.usable.get, self.v.score
        for end in range(len(starts), len(unit) + 1):
            start, found = end - 1, usable(unit[end - 1])
            best = scores[end - 1] + (self.v.lowest if found is None else score[found])
            tail = unit[end - 3 : end] if end > 2 else unit[:end]
            sizes = self.lengths.get(tail)
            for n in self._sizes(tail) if sizes is None else sizes:
                at = end - n
                i = usable(unit[at:end]) if at >= 0 else None
                if i is not None:
                    s = scores[at] + score[i]
                    if s > best or s == best and at < start:
                        start, found, best = at, i, s
            starts.append(start)
            last.append(found)
            scores.append(best)

    def segment(self, units: set[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """(unit, ids) of distinct units, in sorted order over shared prefixes.

        Cells point back, so their memory is in proportion to the longest unit; the
        ids of a unit are read off once, from its end.
        """
        starts, last, scores = [0], [None], [0.0]
        extend = partial(self._extend_merging if self.v.kind == BPE else self._extend_scoring, starts=starts, last=last, scores=scores)
        before = ""
        for unit in sorted(units):
            same = 1
            for a, b in zip(before, unit):
                if a != b:
                    break
                same += 1
            del starts[same:], last[same:], scores[same:]
            extend(unit)
            before = unit
            ids, at = [], len(unit)
            while at:
                i = last[at]
                start = starts[at]
                if i is None:
                    ids += reversed(self._unlisted(unit[start:at]))
                else:
                    ids.append(i)
                at = start
            ids.reverse()
            yield unit, tuple(ids)

    def _unlisted(self, piece: str) -> tuple[int, ...]:
        found = tuple(self.v.bytes.get(b) for b in piece.encode())
        return (self.v.unknown,) if None in found else found

    def learn(self, words: set[str]) -> None:
        if len(self.known) > self.room:
            self.older, fresh = self.known, self.older
            fresh.clear()
            self.known = fresh
        back = [(w, ids) for w in words.difference(self.known) if (ids := self.older.get(w)) is not None]
        self.known.update(back)
        fresh = words.difference(self.known)
        odd = {w for w in fresh if w[0] in self.joints or MARK in w}
        self.long = [w for w in fresh if len(w) > LONG]
        mark = lambda w: w.replace(" ", MARK) if w[0] == " " else MARK + w
        units = self.v.units.findall
        cut = {w: ["\n", *units(w[1:])] if self.v.lines and w[0] == "\n" else units(mark(w)) for w in odd}
        collecting = gc.isenabled()
        gc.disable()  # many small objects without cycles
        try:
            known = self.known
            for unit, ids in self.segment({MARK + w for w in fresh - odd}):
                known[unit[1:]] = ids
            found = dict(self.segment({u for c in cut.values() for u in c}))
            for w, c in cut.items():
                known[w] = tuple(i for u in c for i in found[u])
        finally:
            if collecting:
                gc.enable()

    # ----------------------------------------------------------------- interface
    def _words(self, text: str) -> list[str]:
        """Keys of what is known: ``word`` after one space, ``  word`` as it stands, ``\\nword`` after a line feed."""
        out: list[str] = []
        for k, line in enumerate(text.split("\n") if self.v.lines else [text]):
            parts = line.split(" ")
            if "" not in parts:
                if k:
                    parts[0] = "\n" + parts[0]
                out += parts
                continue
            runs = RUNS.findall(line if k else " " + line)
            if k:
                out.append("\n" + (runs.pop(0) if runs and runs[0][0] != " " else ""))
            out += [r[1:] if r[1:2] not in (" ", "") else r for r in runs]
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self._words(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(split)))
        get = self.known.__getitem__
        ids = [list(chain.from_iterable(map(get, words))) for words in split]
        for w in self.long:
            del self.known[w]
        self.long = []
        return ids

    def _bytes_of(self, i: int) -> bytes:
        kind = self.v.type[i]
        if kind == BYTE:
            return bytes([int(self.v.text[i][3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else self.v.text[i].replace(MARK, " ").encode()

    def decode(self, ids) -> str:
        n = len(self.texts)
        raw = b"".join([self.texts[i] for i in ids if 0 <= i < n])
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def encoder(model: bytes) -> Encoder:
    """One encoder per worker process, so that what it learned lasts."""
    return Encoder(Vocabulary(model))


# --------------------------------------------------------------------- operators
def tokenize(docs, model: bytes, text_col: str = "text"):
    """(row STRUCT of all columns, ids ARRAY<INT>, n_tokens LONG, restored BOOLEAN) for every row.

    ``model`` is the content of a model file; it travels with the task and has the
    size of the vocabulary.  ``restored``: decoding the ids gives the text back.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from .shared import encoded, gathered, portions, small_batches, tidy

    small_batches(docs.sparkSession)

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        e = encoder(shared.value)
        for b in gathered(batches, TOGETHER):
            raw = encoded(b.column(0).field(text_col))
            for lo, hi in portions(raw, TOGETHER):
                texts = [x.decode() for x in raw[lo:hi]]
                ids = e.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo),
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array(list(map(len, ids)), pa.int64()),
                        pa.array([e.decode(i) == t for i, t in zip(ids, texts)], pa.bool_()),
                    ],
                    names=["row", "ids", "n_tokens", "restored"],
                )

    held = docs.select(row)
    fields = [held.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("restored", T.BooleanType())]
    return held.mapInArrow(tidy(run), T.StructType(fields))


def detokenize(rows, model: bytes, ids_col: str = "ids"):
    """(row STRUCT of all columns, text STRING): the texts of id lists; null lists give null."""
    import pyarrow as pa
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        e = encoder(shared.value)
        for b in batches:
            texts = [None if x is None else e.decode([i for i in x if i is not None]) for x in b.column(0).field(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    held = rows.select(row)
    return held.mapInArrow(run, T.StructType([held.schema["row"], T.StructField("text", T.StringType())]))
