"""The near-duplicate stage: one document of each group of linked fingerprints."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_brute import brute_fingerprint, brute_groups


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_stage_keeps_one_of_each_group(spark, folder):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    groups = brute_groups({i: brute_fingerprint(texts[i]) for i in sorted(texts)})
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(groups.values())) != sorted(texts)
    assert all(r.text == texts[r.doc_id] for r in kept if r.text is not None)


def test_stage_on_one_large_group(spark):
    """A third of the rows are copies, some of them edited; no row of another text goes."""
    rng = np.random.default_rng(3)
    words = [f"word{k}" for k in range(3000)]
    hot = list(rng.choice(words, 900))
    rows = [(k, " ".join(rng.choice(words, 60))) for k in range(400)]
    for k in range(200):
        copy = list(hot)
        copy[int(rng.integers(900))] = f"edit{k % 7}"
        rows.append((1000 + k, " ".join(copy)))
    rows += [rows[-1], rows[-1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    groups = brute_groups({i: brute_fingerprint(t) for i, t in sorted(dict(rows).items())})
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(kept) == sorted(set(groups.values()))
    assert len([i for i in kept if i >= 1000]) < 20 and len([i for i in kept if i < 400]) == 400


def test_stage_takes_null_ids_last(spark):
    same = "one two three four five six"
    rows = [(None, same), (7, same), (7, same), (5, same + " x" * 90), (None, "alone in the world of words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["5", "7", "None"]
    assert kept.where(F.col("doc_id").isNull()).first().text.startswith("alone")
