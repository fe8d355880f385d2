"""Literal values: text processors, batchifiers, optimizers, schedules, metrics, losses."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.functions import activations as A, elementwise as E, text as T, vectors as V
from loomframe.operators import (
    detection as D,
    features as X,
    indexing as I,
    joins as J,
    language as L,
    losses as LO,
    metrics as M,
    optimizers as O,
    sampling as SA,
    schedules as S,
    shape as SH,
    topk as K,
    windows as W,
)


def one(spark, **cols):
    row = spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()
    return row if len(cols) > 1 else row[0]


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs])


# element-wise ------------------------------------------------------------------------
def test_division_and_logs_follow_ieee(spark):
    row = one(
        spark,
        a=E.div(F.lit(1.0), 0.0),
        b=E.div(F.lit(-1.0), 0.0),
        c=E.div(F.lit(0.0), 0.0),
        d=E.ln(F.lit(0.0)),
        e=E.ln(F.lit(-1.0)),
        f=E.ln(F.lit(None).cast("double")),
    )
    assert row.a == math.inf and row.b == -math.inf and math.isnan(row.c)
    assert row.d == -math.inf and math.isnan(row.e) and row.f is None


def test_round_half_to_even(spark):
    assert [one(spark, x=E.round_half_even(F.lit(x))) for x in (0.5, 1.5, 2.5, -0.5)] == [0.0, 2.0, 2.0, 0.0]


@pytest.mark.parametrize("y", [-3.5, -2.0, -0.7, -1e-3, 0.0, 1e-6, 0.3, 1.0, 2.4, 2.6, 4.0])
def test_erfinv_inverts_erf(spark, y):
    x = math.erf(y)
    got = one(spark, x=E.erfinv(F.lit(x)))
    assert math.erf(got) == pytest.approx(x, abs=1e-14)
    assert got == pytest.approx(y, abs=1e-6)


def test_erfinv_edges(spark):
    assert one(spark, x=E.erfinv(F.lit(1.0))) == math.inf
    assert one(spark, x=E.erfinv(F.lit(-1.0))) == -math.inf
    assert math.isnan(one(spark, x=E.erfinv(F.lit(1.5))))


def test_softplus_does_not_overflow(spark):
    assert one(spark, x=A.softplus(F.lit(1000.0))) == 1000.0


def test_softmax_of_large_values(spark):
    assert one(spark, x=A.softmax(arr(1000.0, 1000.0))) == [0.5, 0.5]


# vectors -----------------------------------------------------------------------------
def test_argmax_takes_the_first(spark):
    row = one(spark, a=V.argmax(arr(1.0, 3.0, 3.0)), b=V.argmin(arr(2.0, 1.0, 1.0)), c=V.argsort(arr(2.0, 1.0, 2.0), False))
    assert (row.a, row.b, row.c) == (1, 1, [0, 2, 1])


def test_slices_follow_python(spark):
    data = [float(i) for i in range(7)]
    v = arr(*data)
    for s in (slice(1, 5), slice(-3, None), slice(0, -2, 2), slice(None, None, 3), slice(None, None, -1)):
        assert one(spark, x=I.column_selector(v, s)) == data[s]


def test_index_strings():
    assert I.as_axis("1:5:2") == slice(1, 5, 2)
    assert I.as_axis("*") == slice(None) and I.as_axis(" -3") == -3


def test_distinct_pairs_keep_the_last(spark):
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("a", 1), ("b", 2), ("a", 3))])
    assert [tuple(p) for p in one(spark, x=V.distinct_keep_last(pairs))] == [("b", 2), ("a", 3)]


# text --------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "text, want",
    [("a b  c  ", ["a", "b", "", "c"]), ("", [""]), ("  ", []), ("one", ["one"])],
)
def test_tokenize_simple(spark, text, want):
    assert one(spark, x=T.tokenize_simple(F.lit(text))) == want


def test_separate_punctuation(spark):
    tokens = one(spark, x=T.separate_punctuation(arr("Hello,", "wo-rld!", "$5")))
    assert tokens == ["Hello", ",", "wo", "-", "rld", "!", "$", "5"]


def test_hyphens(spark):
    assert one(spark, x=T.normalize_hyphens(F.lit("a—b­c～d~e−f"))) == "a-bc～d-e-f"


def test_terminate_and_truncate(spark):
    assert one(spark, x=T.terminate(T.truncate(arr("a", "b", "c"), 2))) == ["<bos>", "a", "b", "<eos>"]
    assert one(spark, x=T.terminate(arr("a"), bos=None)) == ["a", "<eos>"]


def test_unicode_forms(spark):
    df = spark.createDataFrame([("ﬁ é",)], "s string")
    assert df.select(T.unicode_normalize("NFKC")(F.col("s"))).first()[0] == "fi é"
    assert df.select(T.strip_accents(F.col("s"))).first()[0] == "ﬁ e"


def test_bert_tokenize_and_encode(spark):
    q = T.bert_tokenize(F.lit("Where do Cranes nest?"))
    assert one(spark, x=q) == ["Where", "do", "Cranes", "nest", "?"]
    enc = T.bert_encode_pair(q, T.bert_tokenize(F.lit("Near water.")), 12)
    row = one(spark, **enc)
    assert row.tokens == ["[CLS]", "Where", "do", "Cranes", "nest", "?", "[SEP]", "Near", "water", ".", "[SEP]", "[PAD]"]
    assert row.types == [0] * 7 + [1] * 4 + [0]
    assert row.attention == [1] * 11 + [0] and row.valid_length == 8


def test_split_identifiers(spark):
    assert one(spark, x=T.split_identifiers(F.lit("int fooBar2=X;"))) == ["int", " ", "foo", "bar", "2", "=", "x", ";"]
    assert one(spark, x=T.split_identifiers(F.lit("X"))) == ["X"]


@pytest.mark.parametrize("na, nb, total", [(5, 5, 10), (9, 3, 6), (3, 9, 6), (0, 8, 3), (8, 0, 3), (7, 2, 1), (2, 7, 0)])
def test_truncate_pair(spark, na, nb, total):
    a, b = list(range(na)), list(range(100, 100 + nb))
    df = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    x, y = T.truncate_pair(F.col("a"), F.col("b"), total)
    left, right = df.select(x, y).first()
    assert left == a[: len(left)] and right == b[: len(right)]
    assert len(left) + len(right) == min(total, na + nb)
    # both give equally, the first one more if the excess is odd, unless a side has nothing left to give
    more = (na - len(left)) - (nb - len(right))
    assert more in (0, 1) or (more > 1 and not right) or (more < 0 and not left)


def test_wordpiece(spark):
    vocab = spark.createDataFrame([(w,) for w in ["un", "##aff", "##able", "##a", "run", "##n"]], "token string")
    tokens = spark.createDataFrame([("unaffable",), ("run",), ("runn",), ("xyz",), ("unx",), ("a" * 201,)], "token string")
    got = {r.token: r.pieces for r in L.wordpiece(tokens, vocab).collect()}
    assert got == {r.token: r.pieces for r in L.wordpiece_join(tokens, vocab).collect()}
    assert got["unaffable"] == ["un", "##aff", "##able"] and got["runn"] == ["run", "##n"]
    assert got["run"] == ["run"] and got["xyz"] == ["[UNK]"] and got["unx"] == ["[UNK]"] and got["a" * 201] == ["[UNK]"]


def test_vocabulary_orders(spark):
    words = "b a a c b a <pad> c c".split()
    tokens = spark.createDataFrame(list(enumerate(words)), "pos int, token string")
    by_count = {r.token: r["index"] for r in L.build_vocabulary(tokens, 2, ["<pad>"]).collect()}
    assert by_count == {"<pad>": 0, "<unk>": 1, "a": 2, "c": 3, "b": 4}
    reached = {r.token: r["index"] for r in L.build_vocabulary(tokens, 2, ["<pad>"], reached_by=["pos"]).collect()}
    assert reached == {"<pad>": 0, "<unk>": 1, "a": 2, "b": 3, "c": 4}


def test_lookup_join_salted_equals_broadcast(spark, monkeypatch):
    tokens = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string")).alias("token"))
    vocab = spark.createDataFrame([("hot", 1), ("5", 2), ("7", 3)], "token string, index long")
    plain = sorted(map(tuple, J.token_lookup(tokens, vocab, 0).select("id", "token", "index").collect()))
    monkeypatch.setattr(J.skew, "BROADCAST_BYTES", 1)
    salted = sorted(map(tuple, J.token_lookup(tokens, vocab, 0).select("id", "token", "index").collect()))
    assert plain == salted


# batching ----------------------------------------------------------------------------
def test_bucket_edges():
    assert SA.bucket_edges(1, 10, 5) == [2, 4, 6, 8, 10]
    assert SA.bucket_edges(3, 4, 5) == [3, 4]


def test_padding_and_back(spark):
    df = spark.createDataFrame([(0, 0, [1, 2]), (0, 1, [3]), (0, 2, [4, 5, 6])], "b int, p int, v array<int>")
    row = SA.pad_stack_batchify(df, "v", ["b"], "p", -1).first()
    assert row.stack == [[1, 2, -1], [3, -1, -1], [4, 5, 6]] and row.valid_lengths == [2, 1, 3]
    assert SA.pad_stack_batchify(df, "v", ["b"], "p", 0, width=4).first().stack[1] == [3, 0, 0, 0]
    with pytest.raises(Exception, match="wider"):
        SA.pad_stack_batchify(df, "v", ["b"], "p", 0, width=2).collect()
    with pytest.raises(Exception, match="differ in shape"):
        SA.stack_batchify(df, "v", ["b"], "p").collect()


@pytest.mark.parametrize("size, slices, want", [(6, 3, [2, 2, 2]), (7, 3, [3, 3, 1]), (2, 3, [1, 1])])
def test_split_batch(spark, size, slices, want):
    df = spark.range(size).select(F.col("id").alias("batch_pos"), F.lit(size).alias("size"))
    rows = SA.split_batch(df, slices, even=False).groupBy("slice_id").count().orderBy("slice_id").collect()
    assert [r["count"] for r in rows] == want


def test_even_split_must_divide(spark):
    df = spark.range(7).select(F.col("id").alias("batch_pos"), F.lit(7).alias("size"))
    with pytest.raises(Exception, match="multiple"):
        SA.split_batch(df, 3, even=True).collect()


# features ----------------------------------------------------------------------------
def test_unknown_category_is_an_error(spark):
    df = spark.createDataFrame([("a",), ("z",)], "c string")
    with pytest.raises(Exception, match="not in the map"):
        X.categorical_index_map(df, "c", {"a": 0}, "i").collect()


def test_first_seen_index(spark):
    df = spark.createDataFrame([(3, "b"), (1, "c"), (2, "b"), (4, "a"), (5, "c")], "pos int, c string")
    want = {"c": 0, "b": 1, "a": 2}
    assert {r.c: r["index"] for r in X.first_seen_index(df, "c", ["pos"]).collect()} == want


def test_feature_and_label_are_needed(spark):
    with pytest.raises(ValueError):
        X.select_features_labels(spark.range(1), [], ["id"])


def test_label_positions(spark):
    assert one(spark, x=X.label_encode_positions(F.lit("304"))) == [3, 0, 4, 11, 11, 11]


# optimizers: weight 2, gradient -1.5, rate 0.2, so a plain step adds 0.3 -----------------
@pytest.mark.parametrize(
    "optimizer, want",
    [
        (O.sgd(), 2 + 0.3),
        (O.momentum(0.9), 2 + 0.3),  # no velocity yet
        (O.nag(0.9), 2 + 0.3 * (1 + 0.9)),
        (O.adam(), 2 + 0.2),  # bias-corrected mean over root of square: one
        (O.adagrad(), 2 + 0.2),
        (O.rmsprop(centered=False), 2 + 0.2 / math.sqrt(0.1)),  # a tenth of the square under the root
        (O.rmsprop(centered=True), 2 + 0.2 / math.sqrt(0.1 - 0.1**2)),
    ],
)
def test_first_update(spark, optimizer, want):
    state = {s: np.zeros(1) for s in optimizer.states}
    w, _ = optimizer.step(np.array([2.0]), np.array([-1.5]), state, 1, 0.2)
    assert w[0] == pytest.approx(want, abs=1e-4)
    df = spark.createDataFrame([(2.0, -1.5)], "w double, g double").withColumns({s: F.lit(0.0) for s in optimizer.states})
    assert O.update_table(df, optimizer, 0.2).first().w == pytest.approx(want, abs=1e-4)


def test_second_momentum_update():
    opt = O.momentum(0.9)
    w, state = opt.step(np.array([2.0]), np.array([-1.5]), {"v": np.zeros(1)}, 1, 0.2)
    w, _ = opt.step(w, np.array([0.5]), state, 2, 0.2)
    assert w[0] == pytest.approx(2.3 + 0.9 * 0.3 - 0.2 * 0.5, abs=1e-4)


@pytest.mark.parametrize(
    "schedule, points",
    [
        (S.factor(1.0, 0.5, 3), {0: 1.0, 2: 0.25, 9: 0.125}),
        (S.linear(1.0, -0.1, 5), {0: 1.0, 3: 0.7, 8: 0.5}),
        (S.cosine(1.0, 0.0, 10), {0: 1.0, 5: 0.5, 10: 0.0, 11: 0.0}),
        (S.polynomial(1.0, 0.0, 4, 1.0), {0: 1.0, 1: 0.75, 9: 0.0}),
        (S.multifactor(1.0, 0.5, [2, 4]), {2: 1.0, 3: 0.5, 5: 0.25}),
        (S.warmup(S.fixed(1.0), 4, 0.0, 1.0), {0: 0.0, 1: 0.25, 4: 1.0}),
    ],
)
def test_schedules(spark, schedule, points):
    for n, want in points.items():
        assert float(schedule(np.float64(n), S.SCALAR)) == pytest.approx(want)
        assert one(spark, x=schedule(F.lit(float(n)))) == pytest.approx(want)


# metrics, losses, windows -----------------------------------------------------------------
def test_metric_percentile_clamps_the_last(spark):
    df = spark.createDataFrame([("m", float(v)) for v in (1, 2, 3, 4)], "name string, value double")
    got = {r.percent: r.value for r in M.percentile(df, ["name"], "value", [0, 50, 75, 100]).collect()}
    assert got == {0: 1.0, 50: 3.0, 75: 4.0, 100: 4.0}


def test_batch_means_differ_from_instance_mean(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 8.0)], "batch int, l double")
    assert LO.mean_loss(df, "l").first().loss == 4.0
    assert LO.mean_loss(df, "l", "batch").first().loss == 5.0


def _pool(xs, kernel, stride, padding, ceil, fn):
    n = len(xs)
    room = n + 2 * padding - kernel
    outs = (math.ceil(room / stride) if ceil else room // stride) + 1
    if ceil and (outs - 1) * stride >= n + padding:
        outs -= 1
    padded = {i: x for i, x in enumerate(xs)}
    result = []
    for o in range(outs):
        start = o * stride - padding
        result.append(fn([padded[i] for i in range(start, start + kernel) if i in padded], min(start + kernel, n + padding) - start))
    return result


@pytest.mark.parametrize("kernel, stride, padding, ceil", [(3, 2, 1, False), (2, 2, 0, True), (4, 3, 1, True), (3, 1, 0, False)])
def test_pooling_against_loops(spark, kernel, stride, padding, ceil):
    xs = [float((i * 7) % 11) for i in range(20)]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(xs)], "g string, i int, x double")
    run = lambda how, **kw: [
        r.value for r in W.pool1d(df, "x", ["g"], "i", how, kernel, stride, padding, ceil, **kw).orderBy("out").collect()
    ]
    assert run("max") == _pool(xs, kernel, stride, padding, ceil, lambda v, n: max(v))
    assert run("avg") == pytest.approx(_pool(xs, kernel, stride, padding, ceil, lambda v, n: sum(v) / n))
    assert run("avg", count_include_pad=False) == pytest.approx(_pool(xs, kernel, stride, padding, ceil, lambda v, n: sum(v) / len(v)))


def test_grouped_convolution(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [10.0, 20.0, 30.0, 40.0]
    df = spark.createDataFrame([("s", i, a[i], b[i]) for i in range(4)], "g string, i int, a double, b double")
    out = W.conv1d(df, ["a", "b"], ["g"], "i", [[[1.0, -1.0]], [[0.5, 0.5]]], [0.0, 1.0], groups=2).orderBy("out").collect()
    assert [r.f0 for r in out] == [-1.0, -1.0, -1.0] and [r.f1 for r in out] == [16.0, 26.0, 36.0]


# matrices ---------------------------------------------------------------------------------
def test_block_product_with_ragged_blocks(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(13, 7)), rng.normal(size=(7, 5))
    long = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in np.ndindex(*m.shape)], "i long, j long, v double")
    got = np.zeros((13, 5))
    for r in SH.mat_mul(long(a), long(b), block=4).collect():
        got[r.i, r.j] = r.v
    assert np.allclose(got, a @ b)


def test_topk_similar_in_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(200, 6)), rng.normal(size=(11, 6))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "q_id long, w array<double>")
    monkeypatch.setattr(J, "QUERY_BLOCK", 4)
    got = {(r.q_id, r["rank"]): r.vec_id for r in J.topk_similar(vectors, queries, 5, "vec_id", "v", "q_id", "w").collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = unit(q) @ unit(x).T
    want = {(i, k + 1): int(v) for i, row in enumerate(scores) for k, v in enumerate(np.argsort(-row, kind="stable")[:5])}
    assert got == want


def test_truncated_normal_stays_inside(spark):
    df = spark.range(4000).select(SH.truncated_normal(1, "id").alias("x"))
    row = df.agg(F.max(F.abs("x")).alias("m"), F.avg("x").alias("a"), F.stddev("x").alias("s")).first()
    assert row.m <= 2.0 and abs(row.a) < 0.05 and 0.8 < row.s < 0.95


# detection --------------------------------------------------------------------------------
def _boxes(spark, n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, y = rng.random(2) * 0.7
        w, h = 0.05 + rng.random(2) * 0.25
        # a third of all boxes in one image
        rows.append((0 if i % 3 == 0 else int(rng.integers(1, 6)), i, float(np.round(rng.random(), 2)), x, y, x + w, y + h))
    return rows, spark.createDataFrame(
        [(r[0], r[1], r[2], float(r[3]), float(r[4]), float(r[5]), float(r[6])) for r in rows],
        "image int, box_id int, score double, x1 double, y1 double, x2 double, y2 double",
    )


def _iou(a, b):
    w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda t: (t[5] - t[3]) * (t[6] - t[4])
    return w * h / (area(a) + area(b) - w * h)


def test_nms_paths_agree_with_loops(spark):
    rows, df = _boxes(spark, 600, 8)
    want = set()
    for image in range(6):
        kept = []
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[2], r[1])):
            if all(_iou(r, k) < 0.3 for k in kept):
                kept.append(r)
        want |= {(r[0], r[1]) for r in kept}
    pick = lambda out: {(r.image, r.box_id) for r in out.collect()}
    assert pick(D.nms(df, ["image"], "box_id", "score", 0.3)) == want
    # image 0 is over the limit and goes through the rounds
    assert pick(D.nms(df, ["image"], "box_id", "score", 0.3, local_boxes=150, grid=8)) == want


def test_iou_join_finds_all_pairs(spark):
    rows, df = _boxes(spark, 240, 9)
    left, right = df.filter("box_id % 2 = 0"), df.filter("box_id % 2 = 1")
    for threshold in (0.0, 0.25):
        got = {(r.box_id, r.t_box_id) for r in J.iou_join(left, right, ["image"], threshold).collect()}
        want = {
            (a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] % 2 == 0 and b[1] % 2 == 1 and _iou(a, b) > threshold
        }
        assert got == want


def test_box_target(spark):
    anchors = spark.createDataFrame(
        [(0, 0, 0.9, 0.0, 0.0, 0.5, 0.5), (0, 1, 0.1, 0.5, 0.5, 1.0, 1.0), (0, 2, 0.5, 0.0, 0.5, 0.5, 1.0), (1, 3, 0.2, 0.0, 0.0, 1.0, 1.0)],
        "image int, a int, score double, x1 double, y1 double, x2 double, y2 double",
    )
    truths = spark.createDataFrame([(0, 7, 1, 0.05, 0.05, 0.5, 0.5)], "image int, a int, class int, x1 double, y1 double, x2 double, y2 double")
    got = {r.a: r for r in D.box_target(anchors, truths, "image", "a", "a", 0.5).collect()}
    assert {k: r.target for k, r in got.items()} == {0: 2, 1: 0, 2: 0, 3: 0}
    assert got[0].offsets == pytest.approx([0.5, 0.5, math.log(0.9) / 0.2, math.log(0.9) / 0.2])
    mined = {r.a: r.target for r in D.box_target(anchors, truths, "image", "a", "a", 0.5, negative_ratio=1.0, confidence="score").collect()}
    # one background is kept for the one positive, the least confident; an image without positives keeps none
    assert mined == {0: 2, 1: 0, 2: -1, 3: -1}


def test_collapse(spark):
    assert one(spark, x=D.collapse(arr(1, 1, 0, 1, 2, 2, 0, 0, 2))) == [1, 1, 2, 2]


def test_answer_span_is_empty_when_reversed(spark):
    tokens = arr("a", "b", "c")
    assert one(spark, x=D.answer_span(tokens, arr(0.0, 1.0, 0.0), arr(0.0, 0.0, 1.0))) == ["b", "c"]
    assert one(spark, x=D.answer_span(tokens, arr(0.0, 0.0, 1.0), arr(1.0, 0.0, 0.0))) == []


@pytest.mark.parametrize("new_w, new_h", [(3, 5), (12, 16), (8, 1)])
def test_resize_nearest(spark, new_w, new_h):
    df = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"), F.col("id").alias("v"))
    got = {(r.x, r.y): r.v for r in D.pixel_resize_nearest(df, 8, 8, new_w, new_h).collect()}
    want = {(x, y): (y * 8 // new_h) * 8 + x * 8 // new_w for x in range(new_w) for y in range(new_h)}
    assert got == want


def test_topk_is_clamped(spark):
    assert [c["class"] for c in one(spark, x=K.topk(arr(0.2, 0.5, 0.3), ["a", "b", "c"], 9))] == ["b", "c", "a"]
