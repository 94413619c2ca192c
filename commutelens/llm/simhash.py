"""SimHash near-dedup: tiled exact comparison of fingerprints.

Fingerprints at ``radius`` or fewer differing bits link.  Cut into ``radius + k`` blocks of
bits, two of them that link agree in ``k`` blocks at least, so all comparisons are within
groups that agree in some choice of ``k`` blocks; ``k`` grows with the number of
fingerprints.  A group is compared in tiles, ordered by population count: exclusive-or and
bit counts in numpy, and tiles whose population counts differ by more than the radius are
skipped, as such fingerprints differ in more bits.  Nothing is left out: the result is that of
comparing every pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commutelens.llm.common import blocks_of_text, columns_of, fresh
from commutelens.llm.components import components
from commutelens.session import cut

SHINGLE = 4
SEED = 42
RADIUS = 4
TILE = 2048
GROUP = 512
"""Aim for the mean number of fingerprints in a group."""


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a UTF-8 text: bit set if it is set in over half the shingles' XXH64."""
    found = text.lower().split()
    if not found:
        return 0
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(found), seed)
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(found) - shingle + 1
    for start in range(0, n, 1 << 16):
        part = found[start : start + (1 << 16) + shingle - 1]
        hashes = np.array(
            [digest(b" ".join(s), seed) for s in zip(*(part[i:] for i in range(shingle)))], np.uint64
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``fp``, the fingerprint as a signed long (null text: as empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(fps.view(np.int64))], [*keep, "fp"]
            )

    rows = blocks_of_text(docs.select(*keep, "text"))
    fields = ", ".join(f"`{c}` {kind}" for c, kind in docs.select(*keep).dtypes)
    return rows.mapInArrow(run, f"{fields}, fp long")


def _forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least index that each of ``n`` nodes reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _link(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups as stars. Rows are in order of group and population count."""
    pop = np.bitwise_count(fp).astype(np.int16)
    at, us, vs, found = np.arange(len(fp)), [], [], 0
    label = np.arange(len(fp))
    step = 0
    while len(at):
        step += 1
        at = at[at + step < len(fp)]
        to = at + step
        # once out of the group or out of reach by population count, so are all further rows
        near = (group[to] == group[at]) & (pop[to] - pop[at] <= radius)
        at, to = at[near], to[near]
        hit = np.bitwise_count(fp[at] ^ fp[to]) <= radius
        us.append(at[hit])
        vs.append(to[hit])
        found += int(hit.sum())
        if found > 1_000_000:
            tied = np.flatnonzero(label != np.arange(len(fp)))
            label = _forest(len(fp), np.concatenate([*us, tied]), np.concatenate([*vs, label[tied]]))
            us, vs, found = [], [], 0
    if found:
        tied = np.flatnonzero(label != np.arange(len(fp)))
        label = _forest(len(fp), np.concatenate([*us, tied]), np.concatenate([*vs, label[tied]]))
    tied = np.flatnonzero(label != np.arange(len(fp)))
    return fp[tied], fp[label[tied]]


def _links_frame(u: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})


def group_masks(n: int, radius: int = RADIUS, group: int = GROUP) -> list[int]:
    """Bit masks of the choices of blocks, of which two linked fingerprints agree in one."""
    k = 1
    while k < radius and n / 2 ** (64 * k / (radius + k)) > group:
        k += 1
    ends = [round(64 * i / (radius + k)) for i in range(radius + k + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(ends, ends[1:])]
    return [sum(c) for c in combinations(blocks, k)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE, masks: list[int] | None = None) -> DataFrame:
    """``u, v`` links between the distinct ``fp`` that span all groups of linked ones.

    Each tile gives a star for each of its groups, so no more links than it has rows.
    """
    masks = masks or group_masks(fps.count(), radius)
    keys = [
        F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("k"))
        for i, m in enumerate(masks)
    ]
    keyed = fps.select("fp", F.bit_count("fp").alias("pop"), F.inline(F.array(*keys)))
    cells = keyed.groupBy("c", "k", "pop").agg(F.count("*").alias("n"))
    sums = Window.partitionBy("c", "k")  # at most 65 population counts
    big = cut(cells.withColumn("all", F.sum("n").over(sums)).where(F.col("all") > tile), "simhash-big")

    def small_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            new = np.flatnonzero((frame["c"].to_numpy()[1:] != frame["c"].to_numpy()[:-1]) | (frame["k"].to_numpy()[1:] != frame["k"].to_numpy()[:-1])) + 1
            last = int(new[-1]) if len(new) else 0
            rest = frame.iloc[last:]  # the last group may go on; it has at most `tile` rows
            if last:
                yield _compared(frame.iloc[:last], radius)
        if rest is not None:
            yield _compared(rest, radius)

    small = (
        keyed.join(big.select("c", "k").distinct(), ["c", "k"], "left_anti")
        .repartition("c", "k")
        .sortWithinPartitions("c", "k", "pop", "fp")
        .mapInPandas(small_groups, "u long, v long")
    )
    return small.unionByName(_big_links(keyed, big, radius, tile))


def _compared(frame: pd.DataFrame, radius: int) -> pd.DataFrame:
    c, k = frame["c"].to_numpy(), frame["k"].to_numpy()
    group = np.concatenate([[0], np.cumsum((c[1:] != c[:-1]) | (k[1:] != k[:-1]))]).astype(np.int64)
    return _links_frame(*_link(frame["fp"].to_numpy().view(np.uint64), group[: len(c)], radius))


def _big_links(keyed: DataFrame, big: DataFrame, radius: int, tile: int) -> DataFrame:
    """Groups of more than ``tile`` fingerprints: tiles of one population count, in pairs."""
    cut_up = big.select("c", "k", "pop", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    tiles = cut_up.select("c", "k", "pop", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("i"))
    other = tiles.select("c", "k", F.col("pop").alias("pop2"), F.col("i").alias("i2"))
    near = (F.col("pop2") - F.col("pop")).between(0, radius)
    pairs = tiles.join(other, ["c", "k"]).where(near & ((F.col("pop2") > F.col("pop")) | (F.col("i2") >= F.col("i"))))
    rows = keyed.join(cut_up, ["c", "k", "pop"]).select(
        "c", "k", "pop", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int").alias("i"), "fp"
    )
    left = rows.join(pairs, ["c", "k", "pop", "i"])
    right = rows.withColumnsRenamed({"pop": "pop2", "i": "i2"}).join(pairs, ["c", "k", "pop2", "i2"])
    unit = ["c", "k", "pop", "i", "pop2", "i2"]
    both = left.select(*unit, "fp").unionByName(right.select(*unit, "fp"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        fp = np.unique(frame["fp"].to_numpy().view(np.uint64))
        fp = fp[np.argsort(np.bitwise_count(fp), kind="stable")]
        return _links_frame(*_link(fp, np.zeros(len(fp), np.int64), radius))

    return both.groupBy(*unit).applyInPandas(compare, "u long, v long")


def groups(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, root, component_id``: a node for the group and the smallest ``doc_id`` in it.

    ``marked`` has ``doc_id, fp`` (a table that can be read more than once).  Equal
    fingerprints are one node however many documents have them.
    """
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), radius)).withColumnsRenamed({"node": "fp"})
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(firsts, "root").select("fp", "root", "component_id")


def near_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    Texts are lower-cased (A-Z).  A null or empty text has fingerprint zero; a null id is
    never the smallest, and a component of null ids only has a null one; repeated rows
    fall together.  An empty table gives an empty one; other columns are ignored.
    """
    marked = cut(fingerprints(docs, ["doc_id"]), "simhash-marked")
    found = cut(groups(marked, radius), "simhash-groups")
    return marked.join(found, "fp").select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each group of linked fingerprints: that of the smallest id.

    Texts are lower-cased (A-Z); null and empty ones have fingerprint zero and are copies of each
    other.  Ids that are null come after all others; of rows that repeat an id the first by
    the hash of the text stays, and of equal rows one.  An empty table gives an empty one; columns
    stay as they are, whatever their names.
    """
    own, side = fresh(docs, "_own"), fresh(docs, "_stay")
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("_text"))
    marked = cut(fingerprints(hashed, ["doc_id", "_text"]), "simhash-marked")
    found = cut(groups(marked, radius), "simhash-groups")
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "_text")
    times = marked.groupBy("fp", "doc_id", "_text").agg(F.count("*").alias("times"))
    first = times.groupBy("fp").agg(F.min(F.struct(place.alias("p"), "times")).alias("first"))
    stay = found.join(first, "fp").groupBy("root").agg(F.min("first").alias(side)).select(side)
    same = F.col("doc_id").eqNullSafe(F.col(f"{side}.p.doc_id")) & (F.col(own) == F.col(f"{side}.p._text"))
    kept = docs.withColumn(own, F.xxhash64("text")).join(cut(stay, "simhash-stay"), same)
    once, again = kept.where(f"{side}.times = 1"), kept.where(f"{side}.times > 1").dropDuplicates(["doc_id", own])
    return once.unionByName(again).select(*columns_of(docs))


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
