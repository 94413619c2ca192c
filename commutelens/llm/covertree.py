"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Vectors of one label are compared as unit vectors, whose distance is a function of the cosine.
Each tree covers its vectors by balls of radius 1, 1/2, 1/4 ...: a ball's centre is one of its
vectors, and the balls of the next level lie inside it.  Two trees are traversed together from the
top.  A pair of balls is left if the centres are further apart than the threshold and both
covering radii; it is taken whole if even its furthest vectors link; else its children are
compared, in the end vector by vector with the exact cosine.

A label has a tree for each ``TREE`` vectors or so: vectors go to the nearest of a number of
trunk centres, and those of one centre are split if there are too many.  Trees of a label meet
in pairs, unless their own covering radii keep them apart.  A task holds two trees.  Pairs of vectors
never leave it: a vector has its number of links, and one link to a vector it hangs together with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commutelens.llm.components import components
from commutelens.session import cut

COSINE = 0.98
RADII = (1.0, 0.5, 0.25, 0.125, 0.0625)
TREE = 8192
TRUNK = 4096
"""Trunk centres of all labels together, about: they go to every task."""
SLACK = 1e-7  # distances from cosines near 1 are no more exact than this


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (first by their largest component, so that no square overflows)."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _distance(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * cosines, 0.0))


def cover(x: np.ndarray, radius: float, block: int = 512) -> np.ndarray:
    """For each row the index of a centre within ``radius``; centres are further apart than that."""
    least = 1.0 - radius * radius / 2.0
    owner, centres = np.full(len(x), -1), np.empty(0, np.int64)
    for start in range(0, len(x), block):
        rows = np.arange(start, min(start + block, len(x)))
        if len(centres):
            near = x[rows] @ x[centres].T
            best = near.argmax(axis=1)
            found = near[np.arange(len(rows)), best] >= least
            owner[rows[found]] = centres[best[found]]
            rows = rows[~found]
        near = x[rows] @ x[rows].T >= least
        for i, row in enumerate(rows):
            if owner[row] < 0:
                centres = np.append(centres, row)
                free = near[i] & (owner[rows] < 0)
                owner[rows[free]] = row
                owner[row] = row
    return owner


def nested(x: np.ndarray) -> np.ndarray:
    """For each row its centres on the levels of ``RADII``; the first row is the root of all."""
    levels, balls = np.empty((len(x), len(RADII)), np.int64), np.zeros(len(x), np.int64)
    for k, radius in enumerate(RADII):
        order = np.argsort(balls, kind="stable")
        ends = np.flatnonzero(np.diff(balls[order], append=-1)) + 1
        own = np.arange(len(x))
        for begin, end in zip(np.concatenate([[0], ends[:-1]]), ends):
            if end - begin > 1:
                rows = order[begin:end]
                centre = balls[rows[0]]
                rows = np.concatenate([[centre], rows[rows != centre]])  # a ball's centre stays one below
                own[rows] = rows[cover(x[rows], radius)]
        levels[:, k] = balls = own
    return levels


class Tree:
    """Rows in an order in which each ball is a range of them."""

    def __init__(self, frame: pd.DataFrame):
        frame = frame.sort_values("node")  # as they were when the paths were made
        paths = np.stack(frame["path"].to_numpy())
        order = np.lexsort([np.arange(len(paths)) != paths[:, -1], *paths.T[::-1]])
        self.x = np.stack(frame["unit"].to_numpy())[order]
        self.ids = frame["node"].to_numpy()[order]
        self.weight = frame["n"].to_numpy()[order].astype(np.int64)
        paths, place = paths[order], np.argsort(order)
        self.sums = np.concatenate([[0], np.cumsum(self.weight)])
        self.starts, self.ends, self.centres, self.radii = [], [], [], []
        for level in [*range(paths.shape[1]), None]:
            centre = np.arange(len(paths)) if level is None else place[paths[:, level]]
            start = np.flatnonzero(np.diff(centre, prepend=-1))
            reach = _distance(np.einsum("ij,ij->i", self.x, self.x[centre]))
            self.starts.append(start)
            self.ends.append(np.append(start[1:], len(paths)))
            self.centres.append(centre[start])
            self.radii.append(np.maximum.reduceat(np.where(centre == np.arange(len(paths)), 0.0, reach), start))

    def children(self, level: int, ball: int) -> np.ndarray:
        begin, end = np.searchsorted(self.starts[level + 1], (self.starts[level][ball], self.ends[level][ball]))
        return np.arange(begin, end)


class Links:
    """Number of links of each row, and links that hold together what hangs together."""

    def __init__(self, a: Tree, b: Tree):
        self.counts = [np.zeros(len(a.x) + 1, np.int64), np.zeros(len(b.x) + 1, np.int64)]
        self.shift, self.pairs, self.found = len(a.x), [], 0
        self.label = np.arange(len(a.x) + len(b.x))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Rows ``i`` and ``j`` (counted on behind the first tree's) hang together."""
        self.pairs.append((i, j))
        self.found += len(i)
        if self.found > 1_000_000:
            self.settle()

    def settle(self) -> None:
        label = self.label
        u, v = (np.concatenate([p[k] for p in self.pairs] or [np.empty(0, np.int64)]) for k in (0, 1))
        while len(u):
            a, b = label[u], label[v]
            apart = a != b
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label[:] = label[label]
        self.pairs, self.found = [], 0


def dual(a: Tree, b: Tree, cosine: float = COSINE, block: int = 512) -> Links:
    """All links between the rows of two trees, or of a tree with itself (then in both directions)."""
    reach = float(_distance(np.float64(cosine)))
    links, last = Links(a, b), len(RADII)
    stack = [(0, np.arange(len(a.starts[0])), np.arange(len(b.starts[0])))]
    while stack:
        level, left, right = stack.pop()
        if len(left) > block or len(right) > 8 * block:
            stack += [
                (level, left[i : i + block], right[j : j + 8 * block])
                for i in range(0, len(left), block)
                for j in range(0, len(right), 8 * block)
            ]
            continue
        near = a.x[a.centres[level][left]] @ b.x[b.centres[level][right]].T
        if level == last:
            i, j = np.nonzero(near >= cosine)
            i, j = left[i], right[j]
            links.counts[0][:-1] += np.bincount(i, b.weight[j], len(a.x)).astype(np.int64)
            links.counts[1][:-1] += np.bincount(j, a.weight[i], len(b.x)).astype(np.int64)
            links.add(i, links.shift + j)
            continue
        far = _distance(near)
        both = a.radii[level][left][:, None] + b.radii[level][right][None, :]
        i, j = np.nonzero(far <= reach + both + SLACK)
        whole = far[i, j] + both[i, j] <= reach - SLACK
        _take(a, b, level, left[i[whole]], right[j[whole]], links)
        i, j = i[~whole], j[~whole]
        balls, begin = np.unique(i, return_index=True)
        for ball, partners in zip(balls, np.split(j, begin[1:])):
            below = np.concatenate([b.children(level, right[k]) for k in partners])
            stack.append((level + 1, a.children(level, left[ball]), below))
    links.settle()
    return links


def _take(a: Tree, b: Tree, level: int, left: np.ndarray, right: np.ndarray, links: Links) -> None:
    """Pairs of balls of which every two vectors link: added up by ranges, never pair by pair."""
    for own, other, tree, away, counts in (
        (left, right, a, b, links.counts[0]),
        (right, left, b, a, links.counts[1]),
    ):
        sums = away.sums[away.ends[level][other]] - away.sums[away.starts[level][other]]
        change = np.zeros(len(counts) + 1, np.int64)
        np.add.at(change, tree.starts[level][own], sums)
        np.add.at(change, tree.ends[level][own], -sums)
        counts += np.cumsum(change)[:-1]
    links.add(a.starts[level][left], links.shift + b.starts[level][right])
    for own, tree, shift in ((left, a, 0), (right, b, links.shift)):
        balls = np.unique(own)
        for ball in balls[tree.ends[level][balls] - tree.starts[level][balls] > 1]:
            rows = np.arange(tree.starts[level][ball], tree.ends[level][ball])
            links.add(np.full(len(rows), rows[0] + shift), rows + shift)


def comparable(embedding: str = "embedding", label: str = "label") -> Column:
    """Whether a vector can link: it has a label, is finite and not zero."""
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(F.col(label).isNotNull() & finite & F.exists(embedding, lambda v: v != 0), F.lit(False))


def _trunk(nodes: DataFrame, tree: int, trunk: int) -> dict[tuple, np.ndarray]:
    """Centres for each label with more than ``tree`` vectors: about one a tree, ``trunk`` in all."""
    large = nodes.groupBy("label", "dims").agg(F.count("*").alias("_all")).where(F.col("_all") > tree)
    total = large.agg(F.sum("_all")).first()[0]
    if total is None:
        return {}
    # one in so many vectors, chosen by hash
    rate = min(1.0 / tree, trunk / total)
    picked = F.pmod(F.xxhash64(F.lit(7), "embedding"), F.lit(1 << 40)) < F.lit(int(rate * (1 << 40)))
    rows = nodes.where(picked).join(large, ["label", "dims"], "left_semi").select("label", "dims", "embedding").collect()
    centres: dict[tuple, list] = {}
    for r in sorted(rows):
        centres.setdefault((r.label, r.dims), []).append(r.embedding)
    found = {}
    for key, vectors in centres.items():
        x = unit(np.array(vectors, np.float64))
        found[key] = x[np.unique(cover(x, RADII[2]))]  # near copies need no centre each
    return found


def _trees(nodes: DataFrame, tree: int, trunk: int) -> DataFrame:
    """``label, dims, tree, node, n, unit, path`` for each distinct vector."""
    centres = _trunk(nodes, tree, trunk)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["centre"] = 0
            for key, rows in frame.groupby(["label", "dims"]).groups.items():
                if key in centres:
                    x = unit(np.stack(frame.loc[rows, "embedding"].to_numpy()).astype(np.float64))
                    frame.loc[rows, "centre"] = np.argmax(x @ centres[key].T, axis=1)
            yield frame

    kinds = dict(nodes.dtypes)
    if centres:
        fields = ", ".join(f"{c} {kinds[c]}" for c in nodes.columns)
        placed = cut(nodes.mapInPandas(assign, f"{fields}, centre int"), "cover-placed")
    else:
        placed = nodes.withColumn("centre", F.lit(0))
    where = ["label", "dims", "centre"]
    sizes = placed.groupBy(*where).agg(F.ceil(F.count("*") / tree).cast("int").alias("_parts"))
    split = placed.join(sizes, where).withColumn(
        "tree",
        F.shiftleft(F.col("centre").cast("long"), 32) + F.pmod(F.xxhash64(F.lit(11), "node"), F.col("_parts")),
    )

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node", ignore_index=True)
        x = unit(np.stack(frame["embedding"].to_numpy()).astype(np.float64))
        frame["unit"], frame["path"] = list(x), list(nested(x))
        return frame[["label", "dims", "tree", "node", "n", "unit", "path"]]

    schema = f"label {kinds['label']}, dims int, tree long, node long, n long, unit array<double>, path array<long>"
    return split.drop("_parts", "centre").groupBy("label", "dims", "tree").applyInPandas(build, schema)


def _meeting(trees: DataFrame, cosine: float) -> DataFrame:
    """``label, dims, a, b``: the pairs of trees that their covering radii don't keep apart."""
    one = ["label", "dims", "tree"]

    def dot(u, v):
        return F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)

    def apart(cosines):
        return F.sqrt(F.greatest(F.lit(2.0) - F.lit(2.0) * cosines, F.lit(0.0)))

    tops = trees.groupBy(*one).agg(F.min_by("unit", "node").alias("root"))
    radii = trees.select(*one, "unit").join(tops, one).groupBy(*one).agg(
        F.first("root").alias("root"), F.max(apart(dot("unit", "root"))).alias("radius")
    )
    left = radii.select("label", "dims", F.col("tree").alias("a"), F.col("root").alias("_u"), F.col("radius").alias("_r"))
    right = radii.select("label", "dims", F.col("tree").alias("b"), F.col("root").alias("_v"), F.col("radius").alias("_s"))
    reach = float(_distance(np.float64(cosine))) + SLACK
    near = apart(dot("_u", "_v")) <= F.lit(reach) + F.col("_r") + F.col("_s")
    return left.join(right, ["label", "dims"]).where((F.col("a") <= F.col("b")) & near).select("label", "dims", "a", "b")


def _linked(trees: DataFrame, cosine: float) -> DataFrame:
    """``node, links, root``: for each meeting of two trees, with how many vectors a node links, and one it hangs with."""
    pairs = cut(_meeting(trees, cosine), "cover-meetings")
    key = ["label", "dims", "a", "b"]

    def side(k: int, pairs: DataFrame, tree: str) -> DataFrame:
        met = trees.join(pairs.withColumn("tree", F.col(tree)), ["label", "dims", "tree"])
        return met.select(*key, F.lit(k).alias("side"), "node", "n", "unit", "path")

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame["side"] == 0
        alone = bool(first.all())
        a = Tree(frame[first])
        b = a if alone else Tree(frame[~first])
        links = dual(a, b, cosine)
        ids, counts = np.concatenate([a.ids, b.ids]), np.concatenate([c[:-1] for c in links.counts])
        out = pd.DataFrame({"node": ids, "links": counts, "root": ids[links.label]})
        out = out[: len(a.ids)] if alone else out  # a tree with itself meets each link from both ends
        return out[(out["links"] > 0) | (out["node"] != out["root"])]

    met = side(0, pairs, "a").unionByName(side(1, pairs.where("a <> b"), "b"))
    return met.groupBy(*key).applyInPandas(meet, "node long, links long, root long")


def near_dedup(vectors: DataFrame, cosine: float = COSINE, tree: int = TREE, trunk: int = TRUNK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors (vec_id, embedding, label)``.

    Equal vectors of a label are one node with a weight.  A null, zero, empty or not finite vector, and
    one without a label, links with nothing, and so do vectors of different lengths.  A null id is
    never the smallest; a component of null ids has a null one, and such a row is not kept.  Rows that
    repeat an id are vectors of their own.  An empty table gives an empty one; other columns
    are ignored.
    """
    rows = cut(
        vectors.select(
            "vec_id", "label", "embedding", F.size("embedding").alias("dims"), comparable().alias("usable")
        ),
        "cover-rows",
    )
    same = ["label", "dims", "embedding"]
    nodes = cut(
        rows.where("usable")
        .groupBy(*same)
        .agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
        .withColumn("node", F.monotonically_increasing_id()),
        "cover-nodes",
    )
    trees = cut(_trees(nodes.drop("first"), tree, trunk), "cover-trees")
    linked = cut(_linked(trees, cosine), "cover-links")
    roots = components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    # a vector itself is among its links
    counts = linked.groupBy("node").agg((F.sum("links") - 1).alias("n_links"))
    rooted = nodes.join(counts, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = cut(rooted.select(*same, "first", "n_links", "root"), "cover-rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    found = rooted.join(least, "root").select(*same, "n_links", "component_id")
    judged = rows.where("usable").join(found, same).select("vec_id", "n_links", "component_id")
    others = rows.where("NOT usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return judged.unionByName(others).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
