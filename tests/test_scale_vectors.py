"""Word vectors and text embeddings on larger tables: what moves, and that the ways to the same rows agree."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.operators import joins as J, word_vectors as WV
from loomframe.plans.catalog import shapes
from loomframe.plans.registry import Tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _texts(spark, n=200):
    rng = random.Random(4)
    rows = [(i if i % 9 else None, [rng.choice([f"w{min(rng.randrange(30), rng.randrange(30))}", "rare" + str(i), None]) for _ in range(rng.randrange(40))]) for i in range(n)]
    # rows of one key are merged by position
    return spark.createDataFrame([*rows, rows[1], (5, None), (6, []), (7, ["none known"])], "k int, tokens array<string>").repartition(3)


OPTIONS = WV.Options(dimensions=4, epochs=2, min_count=3, block_tokens=25, seed=3)


def test_rows_are_added_as_numbers_one_by_one():
    rng = np.random.default_rng(1)
    for width in (1, 3, 4):
        rows, at = rng.normal(size=(7, width)), rng.integers(0, 7, (20, 2))
        more = rng.normal(size=(20, 2, width))
        want = rows.copy()
        np.add.at(want, at, more)
        WV._add_rows(rows, at, more)
        assert np.array_equal(rows, want)


def test_blocks_of_a_shipped_and_a_joined_vocabulary_agree(spark, monkeypatch):
    df = _texts(spark)
    words = WV.vocabulary(df, F.col("tokens"), 3).localCheckpoint()
    made = []
    for limit in (WV.skew.BROADCAST_BYTES, 0):
        monkeypatch.setattr(WV.skew, "BROADCAST_BYTES", limit)
        blocks = WV.sentences(df, F.col("tokens"), ["k"], words, OPTIONS, 40)
        made.append({r.block: (r.lengths, r.ids) for r in blocks.collect()})
        # a shipped vocabulary leaves the tokens where they are: only word numbers move
        assert ("Generate" in _plan(blocks)) == (limit == 0)
    numbers = {r.word: r.id for r in words.collect()}
    known = sum(t in numbers for r in df.collect() for t in r.tokens or [])
    assert made[0] == made[1] and len(made[0]) > 20
    assert all(sum(lengths) == len(ids) for lengths, ids in made[0].values()) and sum(len(ids) for _, ids in made[0].values()) == known


@pytest.mark.parametrize("mode", WV.MODES)
def test_vectors_shipped_and_joined_agree(spark, monkeypatch, mode):
    options = WV.Options(**(vars(OPTIONS) | {"mode": mode, "dimensions": 5}))
    corpus = WV.prepare(_texts(spark), F.col("tokens"), ["k"], options)
    got = []
    for limit in (WV.SHIPPED_BYTES, 0):
        monkeypatch.setattr(WV, "SHIPPED_BYTES", limit)
        got.append({r.word: r.vector for r in WV.fit(corpus.words, F.col("word"), ["id"], options, corpus).collect()})
    assert got[0].keys() == got[1].keys() and len(got[0]) == corpus.size
    for word, vector in got[0].items():
        assert vector == pytest.approx(got[1][word], rel=1e-9, abs=1e-12)
    with pytest.raises(ValueError, match="prepared"):
        WV.fit(corpus.words, F.col("word"), ["id"], WV.Options(min_count=4), corpus)


def test_a_round_moves_changes_and_no_sentences(spark, monkeypatch):
    plans, inner = [], WV.materialize
    monkeypatch.setattr(WV, "materialize", lambda df, label: plans.append((label, _plan(df))) or inner(df, label))
    assert WV.fit(_texts(spark), F.col("tokens"), ["k"], OPTIONS).count()
    rounds = [plan for label, plan in plans if label == "vectors"][1:]
    # the sentences met the vectors of their words in two more shuffles, and met them again to be trained
    assert len(rounds) == 2 and all(plan.count("Exchange") == 1 and "CoGroup" not in plan for plan in rounds)
    assert [label for label, _ in plans].count("sentences") == 1


def test_bundles_grow_while_their_words_fit(monkeypatch):
    counts = np.full(1000, 640.0)
    size = lambda: WV._together(counts, None, 64, 1, WV.Options(dimensions=16))
    assert size() == 32
    # a block touches about half of these words
    monkeypatch.setattr(WV, "BUNDLE_BYTES", 999 * 256)
    assert 1 <= size() < 32
    monkeypatch.setattr(WV, "BUNDLE_BYTES", 256)
    assert size() == 1


def _lookups(spark):
    df = _texts(spark)
    vocabulary = spark.createDataFrame([(f"w{i}", 90 - 3 * i) for i in range(25)] + [("", 7)], "token string, index long")
    return df, vocabulary


def test_ids_of_lists_are_those_of_their_rows(spark, monkeypatch):
    df, vocabulary = _lookups(spark)
    rows = J.token_lookup(J.explode_tokens(df, ["k"], "tokens"), vocabulary, 3)
    entry = F.struct("pos", F.col("index").cast("int").alias("index"))
    want = {r.k: [tuple(x) for x in r.ids] for r in J.recollect(rows.withColumn("x", entry), ["k"], "x", "ids").collect()}
    assert want[5] and None in want and len(want) < df.count() - 2
    for limit, slice_ in ((0, J.HASHED), (J.SHIPPED_BYTES, J.HASHED), (J.SHIPPED_BYTES, 4)):
        monkeypatch.setattr(J, "SHIPPED_BYTES", limit)
        monkeypatch.setattr(J, "HASHED", slice_)
        got = J.token_lookup(df, vocabulary, 3)
        assert {r.k: [tuple(x) for x in r.ids] for r in J.recollect(got, ["k"], "index", "ids").collect()} == want
    # a repeated word gives an id for each
    twice = J.token_lookup(df, vocabulary.union(vocabulary.limit(1)), 3)
    assert sum(len(r["index"]) for r in twice.collect()) > sum(len(r["index"]) for r in got.collect())
    wide = J.token_lookup(df, vocabulary.withColumn("index", F.col("index") + 2**40), 3)
    assert dict(wide.dtypes)["index"] == "array<bigint>" and max(max(r["index"]) for r in wide.collect()) == 90 + 2**40


@pytest.mark.parametrize("kind", ["double", "float"])
def test_matrices_of_shipped_and_joined_vectors_agree(spark, monkeypatch, kind):
    df, vocabulary = _lookups(spark)
    lists = J.recollect(J.token_lookup(df, vocabulary, 3), ["k"], "index", "ids")
    # ids without a vector, with several, with a null one, and a null key
    vectors = [(k, [float(k), 0.5]) for k in range(0, 90, 2)] + [(84, [2.0, None]), (87, None), (None, [9.0, 9.0])]
    table = spark.createDataFrame(vectors, f"index long, v array<{kind}>")
    got = []
    for limit, block in ((J.SHIPPED_BYTES, J.BLOCK_IDS), (J.SHIPPED_BYTES, 7), (0, 300)):
        monkeypatch.setattr(J, "SHIPPED_BYTES", limit)
        monkeypatch.setattr(J, "BLOCK_IDS", block)
        made = J.embedding_matrices(lists, table, "ids", "index", "v")
        got.append({r.k: r.matrix for r in made.collect()})
        assert ("CoGroup" in _plan(made)) == (limit == 0)
        assert J.embedding_matrices(lists.limit(0), table, "ids", "index", "v").count() == 0
    assert got[0] == got[1] == got[2] and len(got[0]) > 100
    assert any(v == [2.0, None] for m in got[0].values() for v in m) and any(v is None for m in got[0].values() for v in m)


def test_text_embedding_moves_a_list_once_and_no_vectors(spark, sf_dir, monkeypatch):
    # as with a vocabulary that is too large for a broadcast join: each token was a row that moved to meet its word
    monkeypatch.setattr(J.skew, "BROADCAST_BYTES", 0)
    plan = _plan(shapes._text_embedding(Tables(spark, sf_dir)))
    assert "Generate" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") <= 2
