"""Benchmark decontamination: rare n-gram seeds, then local alignment.

A seed of a test item is the shortest n-gram from a word on that is rare: the product of
its words' shares of the corpus is at most ``RARE``.  Rarity by word shares, not by how often
the n-gram itself is seen, finds a passage also where a third of all documents carry it.
Where a seed stands in a document, the item and the passage around it are aligned by
Smith-Waterman; words that were changed, left out or put in between cost a little.

The test items are taken in blocks of a bounded number of words (one, as a rule), which go to
the tasks; documents are read in place and never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

RARE = 1e-9
SHORTEST = 3
THRESHOLD = 0.5
"""Least score of a leak: alignment score by that of the whole item with itself."""
BLOCK_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, 1
EDGES = b".,;:!?\"'()[]{}*#$%&|<>-_"


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words without marks at their ends; words of marks only are left out."""
    return [w for w in (x.strip(EDGES) for x in text.lower().split()) if w]


@dataclass(frozen=True)
class Items:
    """A block of test items, ready to be searched for."""

    ids: list
    words: dict[bytes, int]
    sequences: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    """By length: hashes in order, the item of each and its place in it."""
    codes: np.ndarray


FACTOR = np.uint64(0x9E3779B97F4A7C15)


def prepare(rows: list[Row], counts: dict[bytes, int], total: int) -> Items:
    """``counts`` of the items' words among ``total`` words of the corpus."""
    texts = [(r["item_id"], tokens(r["text"].encode() if r["text"] else b"")) for r in rows]
    texts = [(i, t) for i, t in texts if t]
    words = {w: k + 1 for k, w in enumerate(sorted({w for _, t in texts for w in t}))}
    codes = np.random.default_rng(1).integers(1, 2**63, len(words) + 1, dtype=np.uint64)
    share = {w: math.log(max(counts.get(w, 0), 0.5) / max(total, 1)) for w in words}
    limit = math.log(RARE)
    found: dict[int, list[tuple[int, int, int]]] = {}
    sequences = [np.array([words[w] for w in t]) for _, t in texts]
    for item, (_, t) in enumerate(texts):
        whole = True
        for start in range(len(t)):
            weight, n = 0.0, 0
            while start + n < len(t) and (n < SHORTEST or weight > limit):
                weight += share[t[start + n]]
                n += 1
            if weight <= limit and n >= SHORTEST:
                found.setdefault(n, []).append((_hash(codes[sequences[item][start : start + n]]), item, start))
                whole = False
        if whole:  # nothing rare in it: all of it is the seed
            found.setdefault(len(t), []).append((_hash(codes[sequences[item]]), item, 0))
    seeds = {}
    for n, entries in found.items():
        h = np.array([e[0] for e in entries], np.uint64)
        order = np.argsort(h, kind="stable")
        seeds[n] = h[order], np.array([e[1] for e in entries])[order], np.array([e[2] for e in entries])[order]
    return Items([i for i, _ in texts], words, sequences, seeds, codes)


def _hash(codes: np.ndarray) -> int:
    h, power = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for c in codes:
        h += power * c
        power *= FACTOR
    return int(h[0])


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, and the passage's first and last word in it.

    Word 0 stands for any word that no item has and equals nothing.
    """

    def ends(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
        ramp = GAP * np.arange(len(b) + 1)
        row, best = np.zeros(len(b) + 1, np.int64), (0, 0, 0)
        for i, word in enumerate(a):
            new = np.zeros_like(row)
            new[1:] = np.maximum(0, np.maximum(row[:-1] + np.where(b == word, MATCH, MISMATCH), row[1:] - GAP))
            row = np.maximum.accumulate(new + ramp) - ramp
            top = int(row.argmax())
            if row[top] > best[0]:
                best = int(row[top]), i, top - 1
        return best

    score, i, last = ends(item, passage)
    if not score:
        return 0, 0, 0
    _, _, back = ends(item[i::-1], passage[last::-1])
    return score, last - back, last


def search(text: bytes, items: Items, threshold: float) -> list[tuple[int, float, int, int]]:
    """Item index, score, first and last word of the best passage of each item that leaks."""
    get = items.words.get
    ids = np.array([get(w, 0) for w in tokens(text)], np.int64)
    best: dict[int, tuple[float, int, int]] = {}
    hits_item, hits_diagonal = [], []
    at = np.flatnonzero(ids)
    h, power, n = np.zeros(len(at), np.uint64), np.ones(1, np.uint64), 0
    while len(at) and n < max(items.seeds):
        more = at + n < len(ids)
        at, h = at[more], h[more]
        more = ids[at + n] > 0
        at, h = at[more], h[more]
        h = h + power * items.codes[ids[at + n]]
        power = power * FACTOR
        n += 1
        if n in items.seeds:
            known, item, place = items.seeds[n]
            low, high = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
            times = high - low
            if times.any():
                which = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                hits_item.append(item[which])
                hits_diagonal.append(np.repeat(at, times) - place[which])
    if not hits_item:
        return []
    item, diagonal = np.concatenate(hits_item), np.concatenate(hits_diagonal)
    order = np.lexsort((diagonal, item))
    item, diagonal = item[order], diagonal[order]
    slack = np.array([len(s) // 4 + 4 for s in items.sequences])[item]
    new = np.flatnonzero((np.diff(item) != 0) | (np.diff(diagonal) > slack[1:])) + 1
    for a, b in zip([0, *new], [*new, len(item)]):
        i, size = int(item[a]), len(items.sequences[item[a]])
        if best.get(i, (0,))[0] >= 1:
            continue
        start = max(0, int(diagonal[a]) - int(slack[a]))
        score, first, last = align(items.sequences[i], ids[start : int(diagonal[b - 1]) + size + int(slack[a])])
        share = score / (MATCH * size)
        if share >= threshold and share > best.get(i, (0,))[0]:
            best[i] = share, start + first, start + last
    return [(i, *found) for i, found in sorted(best.items())]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[Row]]:
    """The items, in blocks of about ``block_words`` words at most; repeated rows count once.

    All texts of an id are in one block, so that the best of them can be told there.
    """
    rows = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    total = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = math.ceil(total / block_words)
    for k in range(blocks):
        yield rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()


def _load(docs: DataFrame, rows: list[Row]) -> Items | None:
    """The block with the shares of its words among all words of ``docs``."""
    known = {w: k for k, w in enumerate(sorted({w for r in rows for w in tokens((r["text"] or "").encode())}))}
    if not known:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, every = np.zeros(len(known) + 1, np.int64), 0
        for batch in batches:
            for text in _texts(batch):
                get, spare = known.get, len(known)
                own = np.array([get(w, spare) for w in tokens(text)], np.int64)
                found += np.bincount(own, minlength=len(found))
                every += len(own)
        at = np.flatnonzero(found[:-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(found[at], every))], ["word", "n"]
        )

    # as many rows as the block has words
    sums = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    total = next((r["n"] for r in sums if r["word"] == -1), 0)
    names = list(known)
    return prepare(rows, {names[r["word"]]: r["n"] for r in sums if r["word"] >= 0}, total)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = THRESHOLD,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``doc_id, item_id, score, first_word, last_word`` of each item that a document holds.

    ``docs`` has ``doc_id, text`` and ``benchmark`` has ``item_id, text``; other columns are
    ignored.  The score is 1 for a whole copy.  First and last word number the
    document's tokens from 0.  Null and empty texts hold and leak nothing.  Rows that repeat an
    id are searched each; of items that repeat an id the best counts.  Without items or
    documents the result is empty.
    """
    docs = docs.select("doc_id", "text")
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, first_word long, last_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for rows in _blocks(benchmark, block_words):
        items = _load(docs, rows)
        if items is None:
            continue

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(at, *x) for at, t in enumerate(_texts(batch)) for x in search(t, items, threshold)]
                # an id that items share has one row for a document, its best
                best = {}
                for at, i, score, a, b in found:
                    key = at, items.ids[i]
                    if key not in best or score > best[key][0]:
                        best[key] = score, a, b
                keys, values = list(best), list(best.values())
                item_type = pa.array([items.ids[0]]).type if not keys else None
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array([at for at, _ in keys], pa.int64())),
                        pa.array([i for _, i in keys], item_type),
                        pa.array([v[0] for v in values], pa.float64()),
                        pa.array([v[1] for v in values], pa.int64()),
                        pa.array([v[2] for v in values], pa.int64()),
                    ],
                    ["doc_id", "item_id", "score", "first_word", "last_word"],
                )

        out = out.unionByName(docs.mapInArrow(run, schema))
    return out


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = THRESHOLD,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` without the documents that hold an item; rows are read in place, once a block.

    Null and empty texts hold nothing and stay; of repeated rows all stay or none.  Without items
    all stay; an empty table gives an empty one.  Columns stay as they are, whatever their names.
    """
    counted, names = docs, docs.columns
    docs = docs.toDF(*["text" if c == "text" else f"_{k}" for k, c in enumerate(names)])
    for rows in _blocks(benchmark, block_words):
        items = _load(counted, rows)
        if items is None:
            continue

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not search(t, items, threshold) for t in _texts(batch)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.toDF(*names)
