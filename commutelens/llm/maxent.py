"""Language-model scoring by a hashed maximum-entropy model.

The probability of a token is that of its class given the words before it times its share of
the class.  Class probabilities are a softmax over weights of hashed features: the word
before, the pair before, and the second and third word before with the others skipped.  Every
task trains on its documents by gradient steps; the weights of all tasks are averaged,
each row of them by how often the task met the feature.

Classes of frequent words are clusters by the company they keep; all other words are in a
class by how they end.  The most frequent words go to every task, as many as ``HEAD``;
counts of the others, however many there are, are joined by word.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commutelens.llm.common import blocks_of_text, held_out
from commutelens.session import cut

FOLDS = 10
SMOOTHING = 0.1
HEAD = 131_072
CLUSTERED = 16_384
"""So many of the head words are in clusters."""
ANCHORS = 64
CLASSES = 32
SPELLED = 12
"""Classes of words by their ending; they come after class 0 of the end and the clusters."""
BATCH = 8_192
RATE = 0.15
END = b"\n"
"""Stands for the end of a text; no word is a line feed."""

WORD_ROWS, PAIR_ROWS = 4_096, 8_192
OWN_ROWS = 3_072
"""The most frequent words have feature rows of their own, others share rows by ending."""
SKIPS = 3
ROWS = SKIPS * WORD_ROWS + PAIR_ROWS


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:])


def spelled_class(word: bytes) -> int:
    return CLASSES - SPELLED + ending(word) % SPELLED


# -- counts -------------------------------------------------------------------------


def word_counts(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """``word, class, n`` of all tokens of ``docs (text as bytes)``; class is by ending."""

    def rows(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(list(found), pa.binary()),
                pa.array([spelled_class(w) for w in found], pa.int32()),
                pa.array(list(found.values()), pa.int64()),
            ],
            ["word", "class", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(text.lower().split())
                found[END] += 1
                if len(found) > most:  # bounded memory: what is counted so far goes on
                    yield rows(found)
                    found = Counter()
        yield rows(found)

    counted = docs.select("text").mapInArrow(run, "word binary, class int, n long")
    return counted.groupBy("word", "class").agg(F.sum("n").alias("n"))


# -- tokens as numbers ----------------------------------------------------------------


@dataclass(frozen=True)
class Head:
    """The most frequent words: numbers by rank (the end is 0), and their counts."""

    ids: dict[bytes, int]
    counts: np.ndarray


@dataclass(frozen=True)
class Tokens:
    """All tokens of some texts in a row."""

    number: np.ndarray
    """Number in the head, -1 for other words."""
    row: np.ndarray
    starts: np.ndarray
    rare: list[bytes]
    endings: np.ndarray
    """The words that are not in the head, and the hashes of their endings."""

    def classes(self, klass: np.ndarray) -> np.ndarray:
        own = klass[self.number]
        own[self.number < 0] = CLASSES - SPELLED + self.endings % SPELLED
        return own


def numbered(texts: Iterable[bytes], ids: dict[bytes, int]) -> Tokens:
    words: list[bytes] = []
    starts = []
    for text in texts:
        starts.append(len(words))
        words += text.lower().split()
        words.append(END)
    number = np.fromiter(map(ids.get, words, repeat(-1)), np.int64, len(words))
    away = number < 0
    rare = [words[i] for i in np.flatnonzero(away).tolist()]
    endings = np.fromiter(map(ending, rare), np.int64, len(rare))
    row = number.copy()
    row[away] = OWN_ROWS + endings % (WORD_ROWS - OWN_ROWS - 1)
    common = number >= OWN_ROWS
    row[common] = OWN_ROWS + number[common] * 2_654_435_761 % (WORD_ROWS - OWN_ROWS - 1)
    return Tokens(number, row, np.array(starts, np.int64), rare, endings)


def feature_rows(row: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each feature its row at each token."""
    size = np.diff(np.append(starts, len(row)))
    place = np.arange(len(row)) - np.repeat(starts, size)
    out = np.empty((SKIPS + 1, len(row)), np.uint16)
    before = []
    for k in range(1, SKIPS + 1):
        shifted = np.full(len(row), WORD_ROWS - 1)  # before the beginning
        shifted[k:] = np.where(place[k:] >= k, row[:-k], WORD_ROWS - 1)
        before.append(shifted)
        out[k - 1] = shifted + (k - 1) * WORD_ROWS
    out[SKIPS] = SKIPS * WORD_ROWS + (before[0] * 40_503 + before[1] * 30_011) % PAIR_ROWS
    return out


def _documents(batches: Iterator[pa.RecordBatch], size: int = 64) -> Iterator[tuple[pa.RecordBatch, int, list[bytes]]]:
    """Texts in groups of about ``size`` times 4 kB, with the batch and the first row of each."""
    for batch in batches:
        texts, start, held = batch.column("text").to_pylist(), 0, 0
        for at, text in enumerate(texts):
            held += len(text)
            if held >= size * 4096 or at + 1 == len(texts):
                yield batch, start, texts[start : at + 1]
                start, held = at + 1, 0


# -- sums over tasks --------------------------------------------------------------------


def _blocks(array: np.ndarray, rows: int) -> pa.RecordBatch:
    """An array of float32, cut into blocks of rows."""
    parts = [array[at : at + rows] for at in range(0, len(array), rows)]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(len(parts)), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())],
        ["block", "data"],
    )


def _summed(blocks: DataFrame) -> np.ndarray:
    """The sum of all tasks' arrays.

    Two rounds, so that no task reads a block from every other one; what is left for the driver is
    one array of the fixed size of the model.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                part = np.frombuffer(zlib.decompress(data), np.float32).astype(np.float64)
                sums[block] = sums[block] + part if block in sums else part
        for block, total in sums.items():
            data = zlib.compress(total.astype(np.float32).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data], pa.binary())], ["block", "data"])

    salted = blocks.withColumn("_salt", F.pmod(F.xxhash64("data"), F.lit(16)))
    once = salted.repartition("block", "_salt").select("block", "data").mapInArrow(add, "block int, data binary")
    rows = once.repartition("block").mapInArrow(add, "block int, data binary").collect()
    parts = sorted(rows, key=lambda r: r["block"])
    return np.concatenate([np.frombuffer(zlib.decompress(r["data"]), np.float32) for r in parts] or [np.zeros(0, np.float32)])


# -- classes ----------------------------------------------------------------------------


def company(docs: DataFrame, head: Head) -> np.ndarray:
    """How often each clustered word stands within two words of each anchor."""
    ids = head.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CLUSTERED * ANCHORS, np.float32)
        for _, _, texts in _documents(batches, 512):
            found_tokens = numbered(texts, ids)
            number, starts = found_tokens.number, found_tokens.starts
            size = np.diff(np.append(starts, len(number)))
            of = np.repeat(np.arange(len(starts)), size)
            found = []
            for k in (1, 2):
                a, b, same = number[:-k], number[k:], of[:-k] == of[k:]
                for word, near in ((a, b), (b, a)):
                    ok = same & (word >= 0) & (word < CLUSTERED) & (near >= 0) & (near < ANCHORS)
                    found.append(word[ok] * ANCHORS + near[ok])
            at, times = np.unique(np.concatenate(found), return_counts=True)
            table[at] += times
        yield _blocks(table.reshape(-1, ANCHORS), CLUSTERED // 16)

    return _summed(docs.select("text").mapInArrow(run, "block int, data binary")).reshape(-1, ANCHORS)


def clusters(table: np.ndarray, head: Head, k: int, rounds: int = 15) -> np.ndarray:
    """The cluster of each word of ``table``, by spherical k-means on its company.

    The table has a fixed size, so this is no work that grows with the corpus.
    """
    expected = table.sum(0) / max(table.sum(), 1)
    share = (table + 20 * expected) / (table.sum(1, keepdims=True) + 20)
    x = np.sqrt(share) - np.sqrt(expected)
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    weight = np.sqrt(head.counts[: len(table)].astype(np.float64))[:, None]
    # start from the most frequent words that are unlike each other
    centres, near = [x[0]], x @ x[0]
    for _ in range(k - 1):
        pick = int(np.argmax((1 - near) * weight[:, 0]))
        centres.append(x[pick])
        near = np.maximum(near, x @ x[pick])
    c = np.array(centres)
    own = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x * weight)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return own


# -- the model ----------------------------------------------------------------------------


LEAST = np.float32(-60)
"""Logits count no further below the largest; what is less than e^-60 would be slow and changes nothing."""
ONES = np.ones(CLASSES, np.float32)


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(1, keepdims=True)
    np.maximum(logits, LEAST, out=logits)
    np.exp(logits, out=logits)
    logits /= (logits @ ONES)[:, None]
    return logits


def _logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = weights.take(rows[0], axis=0)
    out += bias
    for row in rows[1:]:
        out += weights.take(row, axis=0)
    return out


FEW = 8


def _sums(x: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of runs of rows: short runs all together place by place, long ones each as a product."""
    out = x.take(first, axis=0)
    for place in range(1, FEW):
        at = np.flatnonzero((size > place) & (size <= FEW))
        if not len(at):
            break
        out[at] += x.take(first[at] + place, axis=0)
    many = np.flatnonzero(size > FEW)
    ones = np.ones(int(size.max(initial=0)), np.float32)
    for at, start, n in zip(many.tolist(), first[many].tolist(), size[many].tolist()):
        out[at] = ones[:n] @ x[start : start + n]
    return out


def _step(weights: np.ndarray, squares: np.ndarray, met: np.ndarray, bias: np.ndarray, rows: np.ndarray, klass: np.ndarray) -> None:
    """One gradient step on a batch, scaled by what each feature's gradients were before."""
    error = _softmax(_logits(weights, bias, rows))
    error[np.arange(len(klass)), klass] -= 1
    for column in rows:
        order = np.argsort(column, kind="stable")
        row = column[order]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        row, size = row[first], np.diff(np.append(first, len(order)))
        gradient = _sums(error.take(order, axis=0), first, size)
        squares[row] += (gradient * gradient) @ ONES / np.float32(CLASSES)
        weights[row] -= gradient * (np.float32(RATE) / np.sqrt(squares[row] + 1))[:, None]
        met[row] += size


def train(docs: DataFrame, head: Head, klass: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights of all feature rows, averaged over tasks that each read their documents once."""
    ids = head.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((ROWS, CLASSES), np.float32)
        squares, met = np.zeros(ROWS, np.float32), np.zeros(ROWS, np.float32)
        for _, _, texts in _documents(batches):
            tokens = numbered(texts, ids)
            own, rows = tokens.classes(klass), feature_rows(tokens.row, tokens.starts)
            for at in range(0, len(own), BATCH):
                _step(weights, squares, met, bias, rows[:, at : at + BATCH], own[at : at + BATCH])
        yield _blocks(np.concatenate([weights * met[:, None], met[:, None]], 1), ROWS // 16)

    total = _summed(docs.select("text").mapInArrow(run, "block int, data binary")).reshape(-1, CLASSES + 1)
    if not len(total):
        return np.zeros((ROWS, CLASSES), np.float32)
    return (total[:, :-1] / np.maximum(total[:, -1:], 1)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    head: Head
    klass: np.ndarray
    """Class of each head word."""
    bias: np.ndarray
    weights: np.ndarray
    class_tokens: np.ndarray
    class_types: np.ndarray
    tokens: int
    types: int

    def share_of_class(self) -> np.ndarray:
        """Log10 share of each head word in its class; spelled classes leave room for unknown words."""
        top = np.log10(self.head.counts + SMOOTHING)
        return top - self.log_class()[self.klass]

    def log_class(self) -> np.ndarray:
        spelled = np.arange(CLASSES) >= CLASSES - SPELLED
        return np.log10(np.maximum(self.class_tokens + SMOOTHING * (self.class_types + spelled), 1e-9))

    def log_base(self) -> float:
        return math.log10(self.tokens + SMOOTHING * (self.types + 1))


def _most_frequent(counts: DataFrame, most: int) -> list:
    """The words from a count on, from which on there are at most ``most``; by count and word.

    The count is found from how many words there are in each of some thousand ranges of
    counts, so that no more than ``most`` rows ever reach the driver.
    """
    place = F.floor(F.log2("n") * 64)
    sizes = sorted(counts.groupBy(place.alias("place")).count().collect(), reverse=True)
    least, held = None, 0
    for at, words in sizes:
        held += words
        if held > most:
            break
        least = at
    if least is None:
        return []
    return sorted(counts.where(place >= least).collect(), key=lambda r: (-r["n"], bytes(r["word"])))


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """A model of ``docs (text as bytes)``, and the counts of all words (a stored table)."""
    counts = cut(word_counts(docs), "maxent-counts")
    totals = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()
    top = _most_frequent(counts.where(F.col("word") != F.lit(END)), HEAD - 1)
    end = counts.where(F.col("word") == F.lit(END)).first()
    words = [END, *[bytes(r["word"]) for r in top]]
    number = np.array([end["n"] if end else 0, *[r["n"] for r in top]], np.float64)
    head = Head({w: i for i, w in enumerate(words)}, number)
    klass = np.array([spelled_class(w) for w in words], np.int64)
    n = min(CLUSTERED, len(words))
    table = company(docs, head)
    if n > 1 and len(table):
        klass[1:n] = 1 + clusters(table[1:n], Head({}, number[1:n]), CLASSES - SPELLED - 1)
    klass[0] = 0
    # what is in clusters leaves the class of its ending
    class_tokens, class_types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in totals:
        class_tokens[r["class"]], class_types[r["class"]] = r["n"], r["types"]
    for i in range(n):
        if number[i]:
            spelled = spelled_class(words[i])
            class_tokens[spelled] -= number[i]
            class_types[spelled] -= 1
            class_tokens[klass[i]] += number[i]
            class_types[klass[i]] += 1
    total, types = sum(r["n"] for r in totals), sum(r["types"] for r in totals)
    bias = np.log((class_tokens + 1) / (total + CLASSES)).astype(np.float32)
    weights = train(docs, head, klass, bias)
    return Model(head, klass, bias, weights, class_tokens, class_types, int(total), int(types)), counts


def _score_texts(texts: list[bytes], model: Model, share: np.ndarray, base: np.ndarray, log_class: np.ndarray):
    """For each text: tokens, known ones, base and model score without the rare words' own counts, rare words."""
    tokens = numbered(texts, model.head.ids)
    number, starts, inside = tokens.number, tokens.starts, tokens.number >= 0
    klass, rows, log_p = tokens.classes(model.klass), feature_rows(tokens.row, starts), np.empty(len(number))
    for at in range(0, len(number), BATCH):
        p = _softmax(_logits(model.weights, model.bias, rows[:, at : at + BATCH]))
        own = klass[at : at + BATCH]
        log_p[at : at + BATCH] = np.log10(np.maximum(p[np.arange(len(own)), own], 1e-30))
    log_p += np.where(inside, share[number], -log_class[klass])
    plain = np.where(inside, base[number], -model.log_base())
    add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every text has a token, its end
    size = np.diff(np.append(starts, len(number)))
    rare_of = np.repeat(np.arange(len(starts)), size)[~inside]
    others: list[Counter] = [Counter() for _ in texts]
    for of, w in zip(rare_of.tolist(), tokens.rare):
        others[of][w] += 1
    known = add((inside & (model.head.counts[number] > 0)).astype(np.int64))
    return size, known, add(plain), add(log_p), others


def score(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Log10 probabilities of each row of ``docs (doc_id, text)`` under the model of fold 1 and up.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.  A null or empty text
    is its end only.  A null id is not held out.  Repeated rows are scored each.  Without
    documents to learn from, every token is unknown.  Other columns are ignored.
    """
    rows = blocks_of_text(docs.select("doc_id", "text")).withColumn("held_out", held_out("doc_id", folds))
    model, counts = fit(rows.where("NOT held_out"))
    share, log_class = model.share_of_class(), model.log_class()
    base = np.log10(model.head.counts + SMOOTHING) - model.log_base()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))
        for batch, start, texts in _documents(batches):
            size, known, plain, log_p, others = _score_texts(texts, model, share, base, log_class)
            part = batch.slice(start, len(texts))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("held_out"),
                    pa.array(size),
                    pa.array(known),
                    pa.array(plain),
                    pa.array(log_p),
                    pa.array([[{"word": w, "times": n} for w, n in c.items()] for c in others], pairs),
                ],
                ["doc_id", "held_out", "n_tokens", "known", "plain", "log_p", "others"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = (
        f"doc_id {kind}, held_out boolean, n_tokens long, known long, plain double, log_p double, "
        "others array<struct<word:binary,times:long>>"
    )
    # the number of a row is stored with it
    scored = cut(rows.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), "maxent-scored")
    n = F.coalesce("n", F.lit(0))
    rare = (
        scored.select("_row", F.inline("others"))
        .join(counts.select("word", "n"), "word", "left")
        .groupBy("_row")
        .agg(
            F.sum(F.col("times") * F.log10(n + F.lit(SMOOTHING))).alias("more"),
            F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"),
        )
    )
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(rare, "_row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("plain") + more).alias("base_score"),
        (F.col("log_p") + more).alias("score"),
    )
