"""Removal of repeated byte strings by longest previous factors.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier, that is, where the
longest previous factor is ``LENGTH`` or more.  Factors come from the suffix order: of the strings
before and after a string in that order, the nearest ones at a smaller position share most with it.
Suffixes are ordered up to ``LENGTH`` bytes, which is as far as the rule asks.

Most strings of a corpus occur once and need no place in the order.  Each string has an anchor,
the ``GRAM``-byte piece of least hash in it, so equal strings have equal anchors at equal places.
Neighbouring strings share their anchor; such a run is one row.  A run whose whole context occurs
earlier is a repeat and stands for nothing new; only where an anchor occurs in different contexts are
their strings put in suffix order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commutelens.llm.common import text_of
from commutelens.session import cut

LENGTH = 100
GRAM = 32
CHUNK = 1 << 18
"""Bytes looked at together; a longer document is looked at in overlapping pieces."""
BIG = 2_000
"""Groups of more contexts are compared over all tasks instead of within one."""
HELD = 8 << 20
"""Bytes of text whose equal contexts are put together before anything is shuffled."""
TOGETHER = 1_000
"""Contexts that are compared at a time, more only in a larger group."""

_BASE = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """Hashes of all substrings of a buffer, from sums along it."""

    def __init__(self, longest: int):
        self.up = _powers(int(_BASE), longest + 1)
        self.down = _powers(pow(int(_BASE), -1, 1 << 64), longest + 1)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[start]

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        return _mixed((prefix[k:] - prefix[:-k]) * self.down[: len(prefix) - k])


def _window_minimum(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours."""
    size = 1
    while 2 * size <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (w - size)], h[w - size :]) if size < w else h


def runs(data: np.ndarray, document: np.ndarray, hasher: Hasher, length: int, gram: int):
    """Runs of strings with a common anchor in a buffer of at most 2^20 bytes.

    ``document`` tells of each byte which document it is from; strings lie within one.
    Returns first and last start of each run, and the hashes of its anchor and its context.
    """
    prefix = hasher.prefix(data)
    width = length - gram + 1
    hashes = hasher.grams(prefix, gram)
    # rightmost place of the least hash: the place, counted back, stands in the low bits
    place = np.uint64((1 << 20) - 1) - np.arange(len(hashes), dtype=np.uint64)
    least = _window_minimum((hashes & ~np.uint64((1 << 20) - 1)) | place, width)
    anchor = ((1 << 20) - 1) - (least & np.uint64((1 << 20) - 1)).astype(np.int64)
    start = np.flatnonzero(document[: len(anchor)] == document[length - 1 :])
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64)
    anchor = anchor[start]
    new = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(start) != 1)) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new, [len(start)]]) - 1
    lo, hi, at = start[first], start[last], anchor[first]
    context = hasher.between(prefix, lo, hi + length)
    shape = (at - lo).astype(np.uint64) * np.uint64(1 << 10) + (hi - lo).astype(np.uint64)
    return lo, hi, hashes[at], _mixed(context ^ _mixed(shape + np.uint64(1)))


def anchored(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK, held: int = HELD
) -> DataFrame:
    """``doc_id, _text, lo, hi, anchor, context, gone`` of each run in ``docs (doc_id, _text, text)``.

    A run that repeats an earlier one of the same ``HELD`` bytes of documents is ``gone`` and gets an
    anchor of its own, so that a passage of a thousand documents, or a line that one document
    repeats a thousand times, adds one row to its anchor's group.
    """

    def pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
        """Documents, or parts of long ones, of about ``chunk`` bytes together: row, offset, bytes."""
        together, size = [], 0
        for row, text in enumerate(texts):
            if len(text) < length:
                continue
            for offset in range(0, len(text) - length + 1, chunk):
                part = text[offset : offset + chunk + length - 1]
                if together and size + len(part) > chunk + length:
                    yield together
                    together, size = [], 0
                together.append((row, offset, part))
                size += len(part)
        if together:
            yield together

    def marked(batch: pa.RecordBatch, place: np.ndarray, found: list[tuple]) -> pa.RecordBatch:
        row, lo, hi, anchor, context = (np.concatenate(c) for c in zip(*found))
        # runs come in order of their position, so the first of equal contexts is the earliest
        order = np.argsort(context, kind="stable")
        same = np.concatenate([[False], context[order][1:] == context[order][:-1]])
        head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        again = np.zeros(len(lo), bool)
        again[order] = (place[row[order]] != place[row[head]]) | (lo[order] != lo[head])
        alone = _mixed(anchor + np.arange(len(lo), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        rows = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(rows),
                batch.column("_text").take(rows),
                pa.array(lo),
                pa.array(hi),
                pa.array(np.where(again, alone, anchor).view(np.int64)),
                pa.array(context.view(np.int64)),
                pa.array(again),
            ],
            ["doc_id", "_text", "lo", "hi", "anchor", "context", "gone"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(2 * (chunk + length))
        for batch in batches:
            batch = batch.take(_in_order(batch.column("doc_id"), batch.column("_text")))
            new = _changes(batch.column("doc_id")) | _changes(batch.column("_text"))
            place = np.cumsum(new)
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            found, size = [], 0
            for parts in pieces(texts):
                data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
                sizes = np.array([len(p) for _, _, p in parts])
                starts = np.cumsum(sizes) - sizes
                part = np.repeat(np.arange(len(parts)), sizes)
                lo, hi, anchor, context = runs(data, part, hasher, length, gram)
                if len(lo):
                    of = part[lo]
                    shift = np.array([o for _, o, _ in parts])[of] - starts[of]
                    found.append((np.array([r for r, _, _ in parts])[of], lo + shift, hi + shift, anchor, context))
                size += len(data)
                if found and size >= held:
                    yield marked(batch, place, found)
                    found, size = [], 0
            if found:
                yield marked(batch, place, found)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(
        run, f"doc_id {kind}, _text long, lo long, hi long, anchor long, context long, gone boolean"
    )


def _order() -> list:
    return [F.col("doc_id").asc_nulls_last(), "_text", "lo"]


def judged(anchors: DataFrame) -> DataFrame:
    """Runs that are repeats (``gone``), and those whose strings must be compared one by one.

    ``others`` is the number of rows to compare in the group.  One exchange by the
    anchor serves both windows.
    """
    same = Window.partitionBy("anchor", "context").orderBy(*_order())
    group = Window.partitionBy("anchor")
    return (
        anchors.repartition("anchor")
        .withColumn("first", F.rank().over(same) == 1)
        .withColumn("several", F.min("context").over(group) != F.max("context").over(group))
        .withColumn("gone", F.col("gone") | ~F.col("first"))
        .where("gone OR several")
        .withColumn("others", F.sum((~F.col("gone")).cast("long")).over(group))
        .select("doc_id", "_text", "lo", "hi", "anchor", "gone", "others")
    )


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` runs with their bytes."""
    lists = wanted.groupBy("doc_id", "_text").agg(
        F.collect_set(F.struct("lo", "hi", "anchor", "others")).alias("runs")
    ).withColumnsRenamed({"doc_id": "_id", "_text": "_of"})
    joined = docs.join(lists, docs["doc_id"].eqNullSafe(lists["_id"]) & (docs["_text"] == lists["_of"]))
    # bytes are cut out in the JVM, where the text is
    return joined.select("doc_id", "_text", F.col("text").cast("binary").alias("text"), F.inline("runs")).select(
        "doc_id",
        "_text",
        "lo",
        "anchor",
        "others",
        F.substring("text", F.col("lo").cast("int") + 1, (F.col("hi") - F.col("lo") + length).cast("int")).alias("bytes"),
    )


def previous_factors(strings: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Longest previous factor of each string, at most its length.

    ``strings`` (one row of bytes each) are of one length and ``at`` their positions; equal positions
    are one string.  Of the strings that start earlier, the nearest before and the nearest after in
    suffix order share most with a string; both are known when it leaves the stack.
    """
    at, index, back = np.unique(at, return_index=True, return_inverse=True)
    length = strings.shape[1]
    order = np.argsort(np.ascontiguousarray(strings[index]).view(f"S{length}")[:, 0], kind="stable")
    sorted_ = strings[index[order]]
    differ = sorted_[1:] != sorted_[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    factors = [0] * len(at)
    # ranks whose next smaller position is still to come, and what each shares with its previous one
    stack: list[int] = []
    before: list[int] = []
    for position, common in zip([*order.tolist(), -1], [0, *shared.tolist(), 0]):
        while stack and position < stack[-1]:
            previous = before.pop()
            factors[stack.pop()] = max(previous, common)
            common = min(previous, common)
        stack.append(position)
        before.append(common)
    return np.array(factors)[back]


def _strings(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings of the contexts in ``table``: bytes, row, place in the context, longest previous factor.

    Equal strings share an anchor, so a factor of the whole length is found if the anchor's
    contexts are all here; shorter ones are those found among the rows at hand.
    """
    texts = table.column("bytes").to_pylist()
    count = np.array([len(t) - length + 1 for t in texts])
    row = np.repeat(np.arange(len(texts)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.repeat(np.cumsum(count + length - 1) - (count + length - 1), count) + within
    strings = np.lib.stride_tricks.sliding_window_view(data, length)[starts]
    # numbers in order of document and place; runs of a document do not overlap
    order = _in_order(*(table.column(c).combine_chunks() for c in ("doc_id", "_text", "lo")))
    ordered = table.select(["doc_id", "_text", "lo"]).take(order)
    new = _changes(ordered.column("doc_id")) | _changes(ordered.column("_text")) | _changes(ordered.column("lo"))
    number = np.empty(len(texts), np.int64)
    number[order.to_numpy()] = np.cumsum(new)
    return strings, row, within, previous_factors(strings, number[row] * length + within)


def _repeated(table: pa.Table, row: np.ndarray, within: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    """``doc_id, _text, lo, hi`` of runs of the strings ``gone``."""
    new = np.flatnonzero((np.diff(gone) != 1) | (np.diff(row[gone]) != 0)) + 1
    first, last = gone[np.concatenate([[0], new])], gone[np.concatenate([new, [len(gone)]]) - 1]
    rows, lo = pa.array(row[first]), table.column("lo").to_numpy()
    return pa.RecordBatch.from_arrays(
        [
            table.column("doc_id").combine_chunks().take(rows),
            table.column("_text").combine_chunks().take(rows),
            pa.array(lo[row[first]] + within[first]),
            pa.array(lo[row[first]] + within[last]),
        ],
        ["doc_id", "_text", "lo", "hi"],
    )


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """About ``TOGETHER`` rows at a time; an anchor's rows, which come together, stay so."""
    held: pa.Table | None = None
    for batch in batches:
        more = pa.Table.from_batches([batch])
        held = more if held is None else pa.concat_tables([held, more])
        starts = np.flatnonzero(_changes(held.column("anchor")))
        done = 0
        while True:
            # the last group may go on in the next batch
            past = starts[starts >= done + TOGETHER]
            if not len(past):
                break
            yield held.slice(done, int(past[0]) - done)
            done = int(past[0])
        held = held.slice(done)
    if held is not None and held.num_rows:
        yield held


def _compare_groups(contexts: DataFrame, length: int) -> DataFrame:
    """``doc_id, _text, lo, hi`` of runs of repeats, each group within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(batches):
            _, row, within, factor = _strings(table, length)
            gone = np.flatnonzero(factor >= length)
            if len(gone):
                yield _repeated(table, row, within, gone)

    kind = dict(contexts.dtypes)["doc_id"]
    return (
        contexts.repartition("anchor")
        .sortWithinPartitions("anchor", *_order())
        .select("doc_id", "_text", "lo", "anchor", "bytes")
        .mapInArrow(run, f"doc_id {kind}, _text long, lo long, hi long")
    )


def _in_order(*columns: pa.Array) -> pa.Array:
    """Places of the rows in ascending order of all columns, null last."""
    names = [str(i) for i in range(len(columns))]
    table = pa.table(list(columns), names)
    return pc.sort_indices(table, [(n, "ascending") for n in names], null_placement="at_end")


def _changes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Where a value differs from the one before; null equals null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    codes = column.dictionary_encode(null_encoding="encode")
    codes = codes.indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)]


def _compare_spread(contexts: DataFrame, length: int) -> DataFrame:
    """The same for groups of any size.

    Rows are put in suffix order where they lie first: what has a previous factor there is a repeat.
    The other strings, one a task and text at most, meet by their bytes; of equal ones each but the
    earliest has the one before as its nearest smaller position.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                table = pa.Table.from_batches([batch.slice(start, TOGETHER)])
                strings, row, within, factor = _strings(table, length)
                gone, left = np.flatnonzero(factor >= length), np.flatnonzero(factor < length)
                if len(gone):
                    done = _repeated(table, row, within, gone)
                    yield done.append_column("s", pa.nulls(done.num_rows, pa.binary()))
                rows = pa.array(row[left])
                at = pa.array(table.column("lo").to_numpy()[row[left]] + within[left])
                yield pa.RecordBatch.from_arrays(
                    [
                        table.column("doc_id").combine_chunks().take(rows),
                        table.column("_text").combine_chunks().take(rows),
                        at,
                        at,
                        pa.array([s.tobytes() for s in strings[left]], pa.binary()),
                    ],
                    ["doc_id", "_text", "lo", "hi", "s"],
                )

    kind = dict(contexts.dtypes)["doc_id"]
    strings = (
        contexts.sortWithinPartitions("anchor", *_order())
        .select("doc_id", "_text", "lo", "anchor", "bytes")
        .mapInArrow(run, f"doc_id {kind}, _text long, lo long, hi long, s binary")
    )
    # a repeat found already has a key of its own, shorter than any string
    key = F.coalesce("s", F.encode(F.concat_ws(":", "_text", "lo"), "utf-8"))
    equal = Window.partitionBy("_key").orderBy(*_order())
    return (
        strings.withColumn("_key", key)
        .withColumn("n", F.rank().over(equal))
        .where("s IS NULL OR n > 1")
        .select("doc_id", "_text", "lo", "hi")
    )


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, big: int = BIG) -> DataFrame:
    """``doc_id, _text, lo, hi``: every string that starts from lo to hi is a repeat."""
    found = cut(judged(anchored(docs, length, gram)), "lpf-judged")
    wanted = found.where("NOT gone")
    whole = found.where("gone").select("doc_id", "_text", "lo", "hi")
    parts = cut(_contexts(docs, wanted, length), "lpf-contexts")
    return whole.unionByName(_compare_groups(parts.where(F.col("others") <= big), length)).unionByName(
        _compare_spread(parts.where(F.col("others") > big), length)
    )


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, big: int = BIG) -> DataFrame:
    """What is left of each row of ``docs (doc_id, text)``.

    ``doc_id, n_bytes, n_removed, n_spans, kept`` (bytes) and ``kept_sha256``.  A null text is
    empty.  Documents are in order of id, null last; rows that share an id but not the text are
    in order of a hash of it, and rows that share both are one document and get equal results.
    Other columns are ignored; an empty table gives an empty one.
    """
    keyed = docs.select("doc_id", text_of("text").alias("text")).withColumn("_text", F.xxhash64("text"))
    spans = (
        repeats(keyed, length, gram, big)
        .groupBy("doc_id", "_text")
        .agg(F.collect_list(F.struct("lo", "hi")).alias("gone"))
        .withColumnsRenamed({"doc_id": "_id", "_text": "_of"})
    )
    joined = keyed.join(spans, keyed["doc_id"].eqNullSafe(spans["_id"]) & (keyed["_text"] == spans["_of"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gone in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("gone")):
                removed, spans, kept = _without(text, gone, length)
                out.append((len(text), removed, spans, kept, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return joined.select("doc_id", "text", "gone").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    )


def _without(text: bytes, gone: pa.ListScalar, length: int) -> tuple[int, int, bytes]:
    """Bytes removed, spans removed, and the bytes that stay."""
    if not gone.is_valid or not len(gone.values):
        return 0, 0, text
    lo = gone.values.field("lo").to_numpy(zero_copy_only=False)
    hi = gone.values.field("hi").to_numpy(zero_copy_only=False)
    edge = np.bincount(lo, minlength=len(text) + 1) - np.bincount(hi + length, minlength=len(text) + 1)
    covered = np.cumsum(edge[: len(text)]) > 0
    spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
    return int(covered.sum()), spans, np.frombuffer(text, np.uint8)[~covered].tobytes()
