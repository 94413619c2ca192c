"""Hash trees against a plain version that holds all levels."""

import hashlib

import pytest
from pyspark.sql import functions as F

from commutelens.llm import merkle


def digest(run):
    return hashlib.sha256("".join(run).encode()).hexdigest()


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def proof(tree, at):
    found = []
    for level in tree[:-1]:
        other = at ^ 1
        found.append((bool(at & 1), level[other] if other < len(level) else None))
        at >>= 1
    return found


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {
        x: sorted((r[0] is not None, r[0] or 0, digest(map(enc, r)), r) for r in rows if r[2] == x) for x in langs
    }
    trees = {x: levels([r[2] for r in own[x]]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for at, (_, _, leaf, r) in enumerate(own[x]):
            out.append((r[0], x, at, leaf, trees[x][-1][0], top[-1][0], proof(trees[x], at) + proof(top, k)))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 2, "b": 3, None: 5}, {"a": 257, "": 256, "z": 1, "é": 70}, {"a": 1025, "b": 511}])
def test_manifest(spark, monkeypatch, sizes):
    monkeypatch.setattr(merkle, "KEEP", 3)
    rows = [(k * 7 % 10_000, None if k % 5 else f"s{k}", x, k if k % 3 else None, f"text {k} ü") for x, n in sizes.items() for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = merkle.manifest(docs, also={"half": F.col("n_chars") / 2})
    found = sorted(
        ((r.doc_id, r.lang, r.pos, r.leaf, r.subroot, r.root, [tuple(s) for s in r.siblings]) for r in got.collect()), key=str
    )
    assert found == plain(rows)
    folded = got.select((merkle.fold(F.col("leaf"), F.col("siblings")) == F.col("root")).alias("same"), "half", "doc_id")
    assert folded.where("same").count() == len(rows)


def test_rows_that_repeat_and_nulls(spark):
    rows = [(1, "s", "en", 3, "abc")] * 40 + [(None, None, None, None, None), (None, "s", "en", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    got = merkle.manifest(docs)
    found = [(r.doc_id, r.lang, r.pos, r.leaf, r.subroot, r.root, [tuple(s) for s in r.siblings]) for r in got.collect()]
    assert sorted(found, key=str) == plain(rows)
    assert merkle.manifest(docs.where("false")).collect() == []


def test_any_change_shows(spark):
    rows = [(k, "s", "en", 3, f"text {k}") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    other = merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.concat("text", F.lit(" ")))
    got = merkle.manifest(docs, also={"changed": other})
    assert got.where(merkle.fold(F.col("changed"), F.col("siblings")) == F.col("root")).count() == 0


def test_one_tree_holds_a_third_and_subtrees_stay_small(spark):
    """Stored levels shrink by 2 ** KEEP, whatever tree the nodes belong to."""
    nodes = spark.range(3000).select(
        F.when(F.col("id") < 2500, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("tree"),
        F.sha2(F.col("id").cast("string"), 256).alias("node"),
        "id",
    )
    ranked = merkle.numbered(nodes, "tree", ["id"])
    kept = merkle.stored_levels(ranked)
    assert [k.where("tree = 'hot'").count() for k in kept] == [2500, 10, 1]
    assert kept[-1].count() == 501
    assert ranked.where("tree = 'hot' AND pos <> id").count() == 0
