"""Text classifiers, tree ensembles, attention and word vectors against numpy and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.operators import nn, text_classify as TC, trees as TR, word_vectors as WV
from loomframe.operators.optimizers import adam


# text classification ----------------------------------------------------------------------
def test_features_by_hand(spark):
    df = spark.createDataFrame([(["ab", "c", "ab"],), ([],), (None,)], "t array<string>")
    options = TC.Options(word_ngrams=3, min_char=3, max_char=4, buckets=10**9)
    got = df.select(TC.grams(F.col("t"), options).alias("g"), TC.features(F.col("t"), options).alias("x")).collect()
    assert got[0].g == ["ab", "c", "ab", "ab c", "c ab", "ab c ab", "<ab", "ab>", "<ab>", "<c>", "<ab", "ab>", "<ab>"]
    assert len(got[0].x) == 13 and got[0].x[0] == got[0].x[2] and got[1].x == [] and got[2].x == []
    long = df.limit(1).select(TC.features(F.array_repeat(F.lit("w"), 200_000), TC.Options()).alias("x")).first().x
    assert len(long) == 200_000 and len(set(long)) == 1


def test_huffman_ways_are_optimal_and_prefix_free():
    tree = TC.LabelTree.huffman([1, 1, 2, 4, 8])
    assert [len(t) for t in tree.turns] == [4, 4, 3, 2, 1]
    ways = ["".join(map(str, t)) for t in tree.turns]
    assert not any(a != b and b.startswith(a) for a in ways for b in ways)
    assert all(len(set(n)) == len(n) and n[0] == 0 for n in tree.nodes)
    assert TC.LabelTree.huffman([5]).nodes == [[]] and TC.LabelTree.huffman([]).nodes == []


@pytest.mark.parametrize("loss", TC.LOSSES)
def test_errors_are_the_derivative_of_the_loss(loss):
    rng = np.random.default_rng(2)
    labels, rows = 5, 7
    tree = TC.LabelTree.huffman([1, 3, 3, 9, 2]).matrices()
    outputs = labels - 1 if loss == "hs" else labels
    z, y = rng.normal(size=(rows, outputs)), rng.integers(0, labels, rows)
    each, error = TC.losses_and_errors(z, y, loss, tree)
    for k in range(outputs):
        moved = z.copy()
        moved[:, k] += 1e-6
        assert np.allclose((TC.losses_and_errors(moved, y, loss, tree)[0] - each) / 1e-6, error[:, k], atol=1e-4)
    if loss != "ova":
        assert np.allclose(np.exp(TC.log_probabilities(z, loss, tree)).sum(axis=1), 1)
        assert np.allclose(-TC.log_probabilities(z, loss, tree)[np.arange(rows), y], each)


TRAINING = [(i, ["red", "rose"] if i % 3 == 0 else ["blue", "sky"] if i % 3 == 1 else ["green", "leaf", "x"], "abc"[i % 3]) for i in range(60)]


@pytest.mark.parametrize("loss", TC.LOSSES)
def test_classifier_learns_and_travels_as_a_table(spark, loss):
    rows = [*TRAINING, (100, ["red"], None), (101, None, "a"), (102, [], "b"), (103, ["odd"], "rare"), (0, ["red", "rose"], "a")]
    df = spark.createDataFrame(rows, "id long, t array<string>, label string")
    options = TC.Options(epochs=12, batches=3, learning_rate=0.2, min_label_count=2, buckets=512, loss=loss, optimizer=adam(), rate_update=2)
    model = TC.fit(df, F.col("t"), F.col("label"), options, key=["id"])
    assert model.labels == ["a", "b", "c"] and model.history[-1]["loss"] < model.history[0]["loss"] and model.history[0]["rows"] == 63
    got = {r.id: [c["class"] for c in r.classes] for r in model.predict(df, F.col("t"), 2).collect()}
    assert all(got[i][0] == f"__label__{c}" and len(got[i]) == 2 for i, _, c in TRAINING) and len(got) == 64
    counts = [r[0] for r in df.groupBy("label").count().filter("label in ('a', 'b', 'c')").orderBy("label").select("count").collect()]
    again = TC.TextModel.from_table(model.to_table(spark), model.labels, options, counts)
    a, b = (m.probabilities(df, F.col("t")).orderBy("id", "probabilities").collect() for m in (model, again))
    assert np.allclose([r.probabilities for r in a], [r.probabilities for r in b])


def test_one_softmax_step_in_closed_form(spark):
    df = spark.createDataFrame([(["u"], "no"), (["u", "v"], "yes"), (["v"], "yes")], "t array<string>, label string")
    options = TC.Options(epochs=1, learning_rate=3.0, buckets=64)
    model = TC.fit(df, F.col("t"), F.col("label"), options)
    u, v = (r[0] for r in spark.createDataFrame([("u",), ("v",)], "g string").select(TC.bucket_of(F.col("g"), 64)).collect())
    # at zero weights each error is half; features weigh one over their row's number
    assert np.allclose(model.weights[u], [0.5 - 0.25, 0.25 - 0.5]) and np.allclose(model.weights[v], [-0.75, 0.75])
    assert abs(model.history[0]["loss"] - np.log(2)) < 1e-12


def test_classifier_edges(spark):
    df = spark.createDataFrame([(1, ["a"], None)], "id long, t array<string>, label string")
    model = TC.fit(df, F.col("t"), F.col("label"))
    assert model.labels == [] and model.predict(df, F.col("t")).first().classes == []
    one = TC.fit(df.withColumn("label", F.lit("x")), F.col("t"), F.col("label"), TC.Options(loss="hs", buckets=64))
    assert [c["prob"] for c in one.predict(df, F.col("t")).first().classes] == [1.0]
    with pytest.raises(ValueError, match="fewer buckets"):
        TC.fit(df.withColumn("label", F.lit("x")), F.col("t"), F.col("label"), TC.Options(buckets=1 << 30))
    with pytest.raises(ValueError, match="key"):
        TC.fit(df, F.col("t"), F.col("label"), TC.Options(batches=2))


# trees ------------------------------------------------------------------------------------
NODES = [(0, 0, 1, 0.5, 1, 2, True, None), (0, 1, None, None, None, None, None, -1.0), (0, 2, 0, 2.0, 4, 9, False, None)]
NODES += [(0, 4, None, None, None, None, None, 3.0), (0, 9, None, None, None, None, None, 7.0), (5, 0, None, None, None, None, None, 0.25)]


def test_tree_walks_by_hand(spark):
    model = TR.TreeEnsemble.from_table(spark.createDataFrame(NODES, TR.NODE_SCHEMA), base=1.0)
    assert model.depth == 2
    rows = [(0, [1.0, 0.4]), (1, [1.0, 0.5]), (2, [2.0, 0.5]), (3, [None, 0.9]), (4, [5.0]), (5, None), (6, [float("nan"), 3.0, 9.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = {r.id: r.scores for r in TR.predict(df, "v", model).collect()}
    assert got == {0: [0.25], 1: [4.25], 2: [8.25], 3: [8.25], 4: [0.25], 5: None, 6: [8.25]}
    assert TR.predict(df.limit(0), "v", model).count() == 0
    mean = TR.TreeEnsemble.from_table(spark.createDataFrame(NODES, TR.NODE_SCHEMA), "mean")
    assert TR.predict(df.filter("id = 1"), "v", mean).first().scores == [(3.0 + 0.25) / 2]


@pytest.mark.parametrize("change,message", [((0, 2, 0, 2.0, 4, 8, False, None), "no right child"), ((0, 2, 0, 2.0, 0, 9, False, None), "ring"), ((0, 1, None, None, None, None, None, 2.0), "twice")])
def test_broken_trees_are_refused(spark, change, message):
    nodes = [change if n[:2] == (0, 2) == change[:2] else n for n in NODES] + ([change] if change[1] == 1 else [])
    with pytest.raises(ValueError, match=message):
        TR.TreeEnsemble.from_table(spark.createDataFrame(nodes, TR.NODE_SCHEMA))


# attention --------------------------------------------------------------------------------
def dense_attention(x, k, v, ok, heads, causal):
    n, d = x.shape
    out = np.zeros((n, v.shape[1]))
    for h in range(heads):
        part = lambda m: m[:, h * m.shape[1] // heads : (h + 1) * m.shape[1] // heads]
        s = part(x) @ part(k).T / np.sqrt(d // heads)
        seen = np.broadcast_to(ok, (n, n)) & (np.tri(n, dtype=bool) if causal else True)
        w = np.where(seen, np.exp(s - s.max()), 0)
        total = w.sum(axis=1, keepdims=True)
        part(out)[:] = np.divide(w @ part(v), total, out=np.zeros((n, part(v).shape[1])), where=total > 0)
    return out


@pytest.mark.parametrize("heads,causal,masked", [(1, False, False), (4, False, True), (2, True, True)])
def test_blockwise_attention_equals_the_dense_one(spark, heads, causal, masked):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for name, n in (("a", 150), (None, 37), ("c", 1)):
        q, k, v = rng.normal(size=(n, 8)) * 3, rng.normal(size=(n, 8)), rng.normal(size=(n, 4))
        ok = rng.random(n) < 0.6 if masked else np.ones(n, bool)
        if masked and n == 37:
            ok[:] = False
        for i, y in enumerate(dense_attention(q, k, v, ok, heads, causal)):
            rows.append((name, i * 2, q[i].tolist(), k[i].tolist(), v[i].tolist(), bool(ok[i]) or None))
            want[name, i * 2] = y
    df = spark.createDataFrame(rows, "g string, at int, q array<double>, k array<double>, v array<double>, ok boolean").repartition(5)
    out = nn.attention(df, ["g"], "at", "q", causal=causal, heads=heads, valid="ok", keys="k", values="v", block=16).collect()
    assert len(out) == len(want)
    assert all(np.allclose(r.attended, want[r.g, r["at"]], atol=1e-9) for r in out)


def test_cut_sequences_attend_within_themselves(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(23, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "at int, x array<double>")
    out = {r["at"]: (r.sequence, r.attended) for r in nn.attention(df, [], "at", "x", length=10, block=4).collect()}
    for s in range(3):
        part = x[10 * s : 10 * s + 10]
        want = dense_attention(part, part, part, np.ones(len(part), bool), 1, False)
        assert all(out[10 * s + i][0] == s and np.allclose(out[10 * s + i][1], y) for i, y in enumerate(want))
    assert nn.attention(df.limit(0), [], "at", "x").count() == 0


# word vectors -----------------------------------------------------------------------------
def test_alias_draws_follow_the_weights():
    weights = np.array([1.0, 0.0, 5.0, 2.0, 12.0])
    table = WV.alias_table(weights)
    share = np.bincount(WV.draw(table, np.random.default_rng(0), 200_000), minlength=5) / 200_000
    assert np.allclose(share, weights / 20, atol=0.005) and share[1] == 0
    chance = np.bincount(np.arange(5), table[0] / 5, 5) + np.bincount(table[1], (1 - table[0]) / 5, 5)
    assert np.allclose(chance, weights / 20)


def test_pairs_stay_in_their_sentence_and_window():
    o = WV.Options(window=3, negatives=2)
    each = [np.arange(10), np.arange(10, 14), np.zeros(0, np.int64), np.arange(14, 15)]
    words, centre, other, against = WV._plan(each, None, WV.alias_table(np.ones(15)), o, [1, 2])
    assert words.tolist() == list(range(15)) and against.shape == (15, 2)
    assert set(np.abs(centre - other)) == {1, 2, 3} and ((centre < 10) == (other < 10)).all() and 14 not in centre
    assert len(set(zip(centre.tolist(), other.tolist()))) == len(centre)


@pytest.mark.parametrize("mode", WV.MODES)
def test_planted_synonyms_are_nearest(spark, mode):
    rng = np.random.default_rng(8)
    topics = [[f"t{k}w{i}" for i in range(6)] for k in range(4)]
    twins = [("cat", "kitten"), ("car", "auto"), ("rain", "drizzle"), ("bread", "loaf")]
    rows = []
    for i in range(800):
        k = int(rng.integers(4))
        around = rng.choice(topics[k], 8).tolist()
        around.insert(4, twins[k][i % 2])
        rows.append((i, around))
    rows += [(800, []), (801, None), (802, ["once", None])]
    df = spark.createDataFrame(rows, "id long, t array<string>")
    options = WV.Options(mode=mode, dimensions=12, epochs=6, min_count=3, sampling_threshold=0, window=4, block_tokens=3000, seed=3)
    vectors = WV.fit(df, F.col("t"), ["id"], options).cache()
    assert vectors.count() == 32 and {len(r.vector) for r in vectors.collect()} == {12}
    assert vectors.filter("word = 'once'").count() == 0 and WV.nearest(vectors, "once").count() == 0
    for k, (a, b) in enumerate(twins):
        found = [r.word for r in WV.nearest(vectors, a, 7).collect()]
        assert b in found and sum(w in topics[k] for w in found) == 6


def test_word_vectors_of_nothing(spark):
    df = spark.createDataFrame([(1, ["a"])], "id long, t array<string>")
    assert WV.fit(df.limit(0), F.col("t"), ["id"]).count() == 0 and WV.fit(df, F.col("t"), ["id"]).count() == 0
    with pytest.raises(ValueError, match="mode"):
        WV.Options(mode="other")
