"""Merkle dataset manifest: hash trees over ordered rows, proofs by checkpoint and recompute.

A tree's nodes are numbered in order, and every two consecutive ones give a node of the level
above, the last one alone if their number is odd.  Only every ``KEEP`` levels are stored.  A proof
needs a sibling on every level: going down from the top, each aligned subtree between two stored
levels is regenerated from its stored descendants, hands the siblings to them and is discarded.
A subtree has ``2 ** KEEP`` stored nodes at most, so a level is dealt out by subtree, whatever
tree it belongs to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commutelens.session import cut

KEEP = 8
SIBLINGS = T.ArrayType(T.StructType([T.StructField("before", T.BooleanType()), T.StructField("digest", T.StringType())]))


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def fold(digest: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings give; a level without a sibling has a null digest."""

    def up(own, s):
        other = F.coalesce(s["digest"], F.lit(""))
        return F.sha2(F.when(s["before"], F.concat(other, own)).otherwise(F.concat(own, other)), 256)

    return F.aggregate(siblings, digest, up)


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Add ``pos``, the place of a row within its ``tree``, and ``n``, the rows of that tree.

    Rows are sorted over all tasks by tree and ``order`` (nulls first, strings by their bytes);
    equal ones are told apart by a number that is stored with them, so that no key is too large
    for a task.
    """
    held = cut(rows.withColumn("_row", F.monotonically_increasing_id()), "merkle-rows")
    ranged = held.repartitionByRange(tree, *order, "_row").sortWithinPartitions(tree, *order, "_row")
    # the id counts on within a partition, and its upper part is the partition
    ranked = cut(ranged.drop("_row").withColumn("_id", F.monotonically_increasing_id()), "merkle-ranked")
    part = F.shiftright("_id", 33).alias("_part")
    pieces = ranked.groupBy(F.col(tree).alias("_tree"), part).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    # a row for each partition that a tree reaches into
    own = Window.partitionBy("_tree")
    before = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(
        "_tree",
        F.col("_part").alias("_of"),
        F.sum("_n").over(own).alias("n"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    return (
        ranked.withColumn("_part", part)
        .join(starts, F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_of")))
        .withColumn("pos", F.col("_id") + F.col("_shift"))
        .drop("_id", "_part", "_of", "_tree", "_shift")
    )


def _levels(n: int) -> int:
    """Levels above the lowest one until a single node of ``n`` remains."""
    return max(n - 1, 0).bit_length()


def _hash(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def _interior(nodes: list[str], levels: int) -> list[list[str]]:
    """An aligned subtree's nodes, level by level from ``nodes`` up."""
    rows = [nodes]
    for _ in range(levels):
        below = rows[-1]
        rows.append([_hash(below[i : i + 2]) for i in range(0, len(below), 2)])
    return rows


def _own_siblings(rows: list[list[str]], at: int) -> list[dict]:
    """Siblings of the node at ``at`` of the lowest level, up to below the subtree's top."""
    found = []
    for level in rows[:-1]:
        other = at ^ 1
        found.append({"before": bool(at & 1), "digest": level[other] if other < len(level) else None})
        at >>= 1
    return found


def _by_subtree(rows: DataFrame, at: int, use, schema: str) -> DataFrame:
    """``use(levels, batch)`` on each aligned subtree of stored level ``at``, its rows in order."""
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole(pieces):
            merged = pa.Table.from_batches(pieces).combine_chunks()
            levels = min(KEEP, max(_levels(merged.column("n")[0].as_py()) - at, 0))
            return use(levels, merged)

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("tree", "pos"))))
            begin = 0
            for i, (tree, pos) in enumerate(keys):
                if i == 0:
                    changed = bool(held) and (held[-1].column("tree")[0].as_py(), held[-1].column("pos")[0].as_py() >> KEEP) != (tree, pos >> KEEP)
                else:
                    changed = (keys[i - 1][0], keys[i - 1][1] >> KEEP) != (tree, pos >> KEEP)
                if changed:
                    if i > begin:
                        held.append(batch.slice(begin, i - begin))
                    yield from whole(held)
                    held, begin = [], i
            if batch.num_rows > begin:
                held.append(batch.slice(begin))
        if held:
            yield from whole(held)

    subtree = [F.col("tree"), F.shiftright("pos", KEEP)]
    dealt = rows.repartition(*subtree).sortWithinPartitions("tree", "pos")
    return dealt.select(*columns).mapInArrow(run, schema)


def stored_levels(nodes: DataFrame) -> list[DataFrame]:
    """Every ``KEEP``-th level of trees of ``tree, pos, n, node``, up to the single nodes on top.

    ``n`` stays the number of leaves of the tree.  A tree that has come down to one node keeps it.
    """
    largest = nodes.agg(F.max("n")).first()[0] or 0
    kept, at = [nodes.select("tree", "pos", "n", "node")], 0
    kind = nodes.schema["tree"].dataType.simpleString()

    def top(levels: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        root = _interior(rows.column("node").to_pylist(), levels)[-1][0]
        one = rows.slice(0, 1)
        yield from pa.Table.from_arrays(
            [one.column("tree"), pa.array([one.column("pos")[0].as_py() >> KEEP]), one.column("n"), pa.array([root])],
            ["tree", "pos", "n", "node"],
        ).to_batches()

    while at < _levels(largest):
        up = _by_subtree(kept[-1], at, top, f"tree {kind}, pos long, n long, node string")
        kept.append(cut(up, "merkle-level"))
        at += KEEP
    return kept


def proofs(kept: list[DataFrame], bottom: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """``bottom`` with ``siblings``, the proof of each of its nodes up to the top of its tree.

    ``bottom`` is the lowest of the stored levels, with whatever columns come along.
    ``above`` (``tree, siblings``) continues the proofs beyond a tree's own top.
    """
    inner = pa.list_(pa.struct([("before", pa.bool_()), ("digest", pa.string())]))

    def down(levels: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        interior = _interior(rows.column("node").to_pylist(), levels)
        upper = rows.column("upper")[0].as_py() or []
        found = [_own_siblings(interior, i) + upper for i in range(rows.num_rows)]
        yield from rows.drop_columns(["upper"]).append_column("siblings", pa.array(found, inner)).to_batches()

    known = None
    for k in range(len(kept) - 1, -1, -1):
        rows = kept[k] if k else bottom
        if known is None:  # a single node in each tree
            rest = above or rows.limit(0).select("tree", F.array().cast(SIBLINGS).alias("siblings"))
            ends = rest.select(F.col("tree").alias("_tree"), "siblings")
            known = rows.join(ends, F.col("tree").eqNullSafe(F.col("_tree")), "left").drop("_tree")
            known = known.withColumn("siblings", F.coalesce("siblings", F.array().cast(SIBLINGS)))
        else:
            # the rows of a subtree need what is above it once: on its first row
            uppers = known.select(
                F.col("tree").alias("_tree"), F.shiftleft("pos", KEEP).alias("_pos"), F.col("siblings").alias("upper")
            )
            first = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("pos") == F.col("_pos"))
            joined = rows.join(uppers, first, "left").drop("_tree", "_pos")
            schema = T.StructType([*rows.schema.fields, T.StructField("siblings", SIBLINGS)])
            known = _by_subtree(joined, k * KEEP, down, schema)
        if k:
            known = cut(known, "merkle-proofs")
    return known


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``doc_id, lang, pos, leaf, subroot, root, siblings``, and the columns of ``also``.

    A leaf for each row, of ``columns``; a tree for each ``lang`` (null is one of its own) in order of
    ``doc_id``, null first.  Rows of one ``doc_id`` are ordered by their leaf, and equal rows have
    equal leaves.  The trees' roots in order of ``lang`` are the nodes of one more tree.  An
    empty table gives an empty one.  Columns that are not named are left out.
    """
    also = dict(also or {})
    leaves = docs.select(
        "doc_id",
        F.col("lang").alias("tree"),
        leaf(*[F.col(c) for c in columns]).alias("node"),
        *[value.alias(f"_also_{name}") for name, value in also.items()],
    )
    ranked = cut(numbered(leaves, "tree", ["doc_id", "node"]), "merkle-leaves")
    kept = stored_levels(ranked)
    subroots = kept[-1].select(F.col("tree").alias("lang"), F.lit(0).alias("tree"), "node")
    tops = cut(numbered(subroots, "tree", ["lang"]), "merkle-tops")
    upper = stored_levels(tops)
    root = upper[-1].select("node").scalar()
    above = cut(proofs(upper, tops), "merkle-above")
    proven = proofs(kept, ranked, above.select(F.col("lang").alias("tree"), "siblings"))
    named = above.select(F.col("lang").alias("_lang"), F.col("node").alias("subroot"))
    return proven.join(named, F.col("tree").eqNullSafe(F.col("_lang"))).select(
        "doc_id",
        F.col("tree").alias("lang"),
        "pos",
        F.col("node").alias("leaf"),
        "subroot",
        root.alias("root"),
        "siblings",
        *[F.col(f"_also_{name}").alias(name) for name in also],
    )
