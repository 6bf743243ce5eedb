"""The registered queries over small tables, and the pipeline from end to end."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from meridia.llm import exact_dedup, lm_score, mixing, near_dedup, packing, quality, token_count, toxicity
from meridia.llm.queries import ORACLES, QUERIES, tokenizer

from .test_duplicates import brute, squeeze
from .test_neighbours import brute as nearest
from .test_scores import labelled


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents, labels and embeddings with a hot source, copies and the awkward rows."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs, labels, _ = labelled(spark, 300)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    copies = docs.where("doc_id between 1000 and 1020").selectExpr("doc_id + 5000 as doc_id", "text", "lang", "source", "n_chars")
    docs.unionByName(copies).write.parquet(f"{path}/documents.parquet")
    labels.selectExpr("cast(doc_id as int) as doc_id", "quality", "toxic").write.parquet(f"{path}/labels.parquet")
    r = random.Random(1)
    vectors = [(k, [r.gauss(0, 1) for _ in range(8)]) for k in range(200)] + [(500, None), (520, [0.0] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path, vectors


def rows_of(spark, folder):
    return spark.read.parquet(f"{folder[0]}/documents.parquet")


def equal(got, want):
    show = lambda df: Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect())
    assert show(got) == show(want)


def test_queries_apply_their_operators_to_whole_tables(spark, folder):
    docs, labels = rows_of(spark, folder), spark.read.parquet(f"{folder[0]}/labels.parquet")
    run = lambda name: QUERIES[name](spark, folder[0])
    equal(run("op1_toxicity"), toxicity.toxicity_scores(docs, labels, 0.3))
    equal(run("op9_quality"), quality.quality_scores(docs, labels, 0.7))
    equal(run("op4_exact_dedup"), exact_dedup.groups(docs))
    equal(run("op6_mixing"), mixing.mix(docs))
    equal(run("op7_token_counts"), token_count.token_counts(docs, tokenizer("word_bpe_49k.json"), 2048))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in run("op8_near_dedup").collect())
    assert got == brute([tuple(r) for r in docs.collect()], 2, 80)
    for name, column in (("op5_token_files", "n_tokens"), ("op10_packing", "length")):
        tokens = spark.createDataFrame([(x,) for x in run(name).groupBy().sum(column).first()], "n long").first().n
        assert tokens > docs.count()
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) == 13


def test_neighbours_query(spark, folder):
    want = nearest(folder[1], 20, 20)
    got = {(r.query_id, r["rank"]): r.vec_id for r in QUERIES["op2_neighbours"](spark, folder[0]).collect()}
    assert got == {(q, place): j for q, found in want.items() for place, j, _ in found}


def test_the_target_of_language_model_scores(spark, folder):
    """Good labels without the held-out fold, whatever integer type the ids have."""
    docs, labels = rows_of(spark, folder), spark.read.parquet(f"{folder[0]}/labels.parquet")
    good = [r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    target = docs.where(docs.doc_id.isin(good))
    assert target.count() > 100
    equal(QUERIES["op3_lm_scoring"](spark, folder[0]), lm_score.cross_entropy_difference(docs, target))


def test_pipeline_from_end_to_end(spark, folder):
    docs = rows_of(spark, folder)
    labels = spark.read.parquet(f"{folder[0]}/labels.parquet")
    got = corpus_pipeline.run(spark, folder[0]).collect()
    # the same by hand: what is good enough, first copies, one of each group, what the mix takes
    accepted = {(r.doc_id, r.text) for r in quality.accepted_documents(docs, labels).collect()}
    first = {}
    for d, text in sorted(accepted, key=lambda x: (x[0] is None, x[0] or 0)):
        first.setdefault(squeeze(text), (d, text))
    kept = [(d, t) for d, t in first.values()]
    groups = brute([(d, t, "en") for d, t in kept], 5, 80)
    one = {d for d, _, c in groups if d == c}
    left = docs.where(docs.doc_id.isin([d for d in one if d is not None])).dropDuplicates(["doc_id"])
    taken = {r.doc_id: r.taken for r in mixing.mix(left).collect() if r.taken}
    assert {r.doc_id for r in got if r.doc_id is not None} == set(taken)
    lengths = Counter()
    for r in got:
        lengths[r.sequence_id] += r.length
    assert all(n == packing.SIZE or n & (n - 1) == 0 for n in lengths.values())
    assert sum(n != packing.SIZE for n in lengths.values()) <= np.log2(packing.SIZE)
    assert near_dedup.reach(0.8) > 0
