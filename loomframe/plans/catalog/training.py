"""Fit, optimizers, schedules, search, batch inference and user functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loomframe.core.keyed import keyed_hash
from loomframe.core.order import row_index
from loomframe.core.session import materialize
from loomframe.functions import text as T, vectors as V
from loomframe.operators import features as X, fit as FT, inference as I, optimizers as O, sampling as SA, schedules as S, text_classify as TC, trees as TR, word_vectors as WV
from loomframe.plans.catalog.text import CHAIN
from loomframe.plans.registry import LONG_EMBEDDINGS, Tables, h, query, r, register

# optimizers: weights, gradients and states from entries of the vectors --------------
_STATES_SQL = """(SELECT vec_id, i, v[i] AS w, v[65 - i] AS g, abs(v[(i + 6) % 64 + 1]) AS s1, abs(v[(i + 12) % 64 + 1]) AS s2, v[(i + 18) % 64 + 1] AS s3
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(1, 65)) AS i FROM embeddings))"""


def parameters(t: Tables, states):
    v = F.col("v")
    at = lambda shift: F.get(v, F.pmod(F.col("p") + shift, F.lit(64)).cast("int"))
    sources = [F.abs(at(7)), F.abs(at(13)), at(19)]
    df = t.embeddings.select("vec_id", V.doubles("embedding").alias("v")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return df.select(
        "vec_id",
        "p",
        F.get(v, F.col("p")).alias("w"),
        F.get(v, 63 - F.col("p")).alias("g"),
        *[c.alias(s) for s, c in zip(states, sources)],
    )


_G = "(greatest(least(g * 0.5, 0.1), -0.1) + 0.01 * w)"
_ADAM_LR = "(0.1 * sqrt(1 - pow(0.999::DOUBLE, 3)) / (1 - pow(0.9::DOUBLE, 3)))"
_OPTIMIZERS = {
    "opt_sgd": (O.sgd, f"w - 0.1 * {_G}"),
    "opt_momentum": (O.momentum, f"w + 0.9 * s1 - 0.1 * {_G}"),
    "opt_nag": (O.nag, f"w - 0.1 * ({_G} + 0.9 * (0.9 * s1 + {_G}))"),
    "opt_adam": (
        O.adam,
        f"w - {_ADAM_LR} * (0.9 * s1 + 0.1 * {_G}) / (sqrt(0.999 * s2 + 0.001 * {_G} * {_G}) + 1e-8)",
    ),
    "opt_adagrad": (O.adagrad, f"w - 0.1 * {_G} / sqrt(s1 + {_G} * {_G} + 1e-8)"),
    "opt_rmsprop": (
        lambda **kw: O.rmsprop(centered=False, **kw),
        f"w - 0.1 * {_G} / sqrt(0.9 * s1 + 0.1 * {_G} * {_G} + 1e-8)",
    ),
    "opt_rmsprop_centered": (
        lambda **kw: O.rmsprop(centered=True, epsilon=0.1, **{k: v for k, v in kw.items() if k != "epsilon"}),
        f"w + 0.9 * s3 - 0.1 * {_G} / sqrt(0.9 * s1 + 0.1 * {_G} * {_G} - pow(0.9 * s2 + 0.1 * {_G}, 2) + 0.1)",
    ),
    "opt_adadelta": (O.adadelta, f"w - sqrt(s2 + 1e-8) / sqrt(0.9 * s1 + 0.1 * {_G} * {_G} + 1e-8) * {_G}"),
}


def _update(t: Tables, make):
    optimizer = make(weight_decay=0.01, rescale=0.5, clip=0.1)
    out = O.update_table(parameters(t, optimizer.states), optimizer, 0.1, t=3)
    return out.groupBy("vec_id").agg(F.round(F.sum(F.col("w") * (F.col("p") + 1)), 6).alias("print"))


for _name, (_make, _rule) in _OPTIMIZERS.items():
    register(
        _name,
        lambda t, m=_make: _update(t, m),
        f"SELECT vec_id, {r(f'sum(i * ({_rule}))')} AS print FROM {_STATES_SQL} GROUP BY 1",
    )

# schedules: the update number is the position of an order ---------------------------
_N = "(SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1)::DOUBLE AS n FROM orders)"
_SCHEDULES = {
    "schedule_fixed": (S.fixed(0.05), "0.05"),
    "schedule_factor": (S.factor(0.8, 0.999, 5000), "0.8 * pow(0.999::DOUBLE, least(n, 5000))"),
    "schedule_linear": (S.linear(0.5, -0.0001, 4000), "0.5 - 0.0001 * least(n, 4000)"),
    "schedule_cosine": (S.cosine(0.5, 0.01, 9000), "CASE WHEN n > 9000 THEN 0.01 ELSE 0.01 + 0.49 / 2 * (1 + cos(pi() * n / 9000)) END"),
    "schedule_polynomial": (S.polynomial(0.3, 0.01, 8000, 1.5), "0.29 * pow(1.0 - least(n, 8000) / 8000, 1.5) + 0.01"),
    "schedule_multifactor": (S.multifactor(1.0, 0.5, [100, 1000, 10000]), "pow(0.5, (n > 100)::INT + (n > 1000)::INT + (n > 10000)::INT)"),
    "schedule_warmup": (
        S.warmup(S.factor(0.8, 0.999, 5000), 500, 0.001, 0.8),
        "CASE WHEN n < 500 THEN 0.001 + 0.799 * n / 500 ELSE 0.8 * pow(0.999::DOUBLE, least(n - 500, 5000)) END",
    ),
}
for _name, (_schedule, _formula) in _SCHEDULES.items():
    register(
        _name,
        lambda t, s=_schedule: row_index(t.orders.select("o_orderkey"), "o_orderkey", "n").select(
            "o_orderkey", F.round(s(F.col("n").cast("double")), 6).alias("value")
        ),
        f"SELECT o_orderkey, {r(_formula)} AS value FROM {_N}",
    )


# fit ---------------------------------------------------------------------------------
def _line_features(t: Tables):
    x = t.lineitem.select(
        F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("x"), F.col("l_extendedprice").alias("p")
    )
    return X.standardize(x, ["q", "d", "x", "p"])


@query(
    "fit_linear",
    f"""
WITH RECURSIVE s AS (SELECT avg(l_quantity) mq, stddev_pop(l_quantity) sq, avg(l_discount) md, stddev_pop(l_discount) sd, avg(l_tax) mx, stddev_pop(l_tax) sx, avg(l_extendedprice) mp, stddev_pop(l_extendedprice) sp FROM lineitem),
z AS (SELECT (l_quantity - mq) / sq AS q, (l_discount - md) / sd AS d, (l_tax - mx) / sx AS x, (l_extendedprice - mp) / sp AS p FROM lineitem, s),
m AS MATERIALIZED (SELECT avg(q) q1, avg(d) d1, avg(x) x1, avg(p) p1, avg(q * q) qq, avg(q * d) qd, avg(q * x) qx, avg(d * d) dd, avg(d * x) dx, avg(x * x) xx, avg(q * p) qp, avg(d * p) dp, avg(x * p) xp FROM z),
w AS (SELECT 0 AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, 0.0::DOUBLE AS e FROM m
  UNION ALL SELECT k + 1, a - 0.4 * (qq * a + qd * b + qx * c + q1 * e - qp), b - 0.4 * (qd * a + dd * b + dx * c + d1 * e - dp),
    c - 0.4 * (qx * a + dx * b + xx * c + x1 * e - xp), e - 0.4 * (q1 * a + d1 * b + x1 * c + e - p1) FROM w, m WHERE k < 6)
SELECT unnest(['quantity', 'discount', 'tax', 'bias']) AS parameter, unnest([{r('a')}, {r('b')}, {r('c')}, {r('e')}]) AS weight FROM w WHERE k = 6""",
)
def _fit_linear(t: Tables):
    features = F.array("q", "d", "x", F.lit(1.0))
    model = FT.fit(_line_features(t), features, F.col("p"), 4, [FT.Config(O.sgd(), S.fixed(0.4))], epochs=6)
    names = ["quantity", "discount", "tax", "bias"]
    rows = [(n, round(float(w), 6) + 0.0) for n, w in zip(names, model.weights[0])]
    return t.spark.createDataFrame(rows, "parameter string, weight double")


def _low_label():
    return (F.col("label") < 5).cast("double")


@query("fit_logistic")
def _fit_logistic(t: Tables):
    features = F.concat(V.doubles("embedding"), F.array(F.lit(1.0)))
    config = FT.Config(O.adam(), S.fixed(0.05), l2=1e-4)
    model = FT.fit(t.embeddings, features, _low_label(), 65, [config], "logistic", epochs=3, batches=2, seed=17, key=["vec_id"])
    scored = model.predict(t.embeddings.select("vec_id", "label", features.alias("x")), "x")
    return scored.select("vec_id", _low_label().alias("y"), F.round("prediction", 6).alias("prediction"))


_SPACE = {
    "lr": ("log_float", 1e-4, 1.0),
    "layers": ("int", 1, 5),
    "bias": ("bool",),
    "activation": ("categorical", ["relu", "tanh", "gelu"]),
    "net": {"dropout": ("float", 0.0, 0.5), "units": ("int", 16, 256)},
}
_T52 = "4503599627370496.0::DOUBLE"


@query(
    "hpo_sample",
    f"""SELECT c_custkey, {r(f'exp(ln(1e-4) + {h("3/lr", "c_custkey")} / {_T52} * (ln(1.0) - ln(1e-4)))')} AS lr, (1 + floor({h("3/layers", "c_custkey")} / {_T52} * 4))::BIGINT AS layers,
  {h("3/bias", "c_custkey")} / {_T52} < 0.5 AS bias, (['relu', 'tanh', 'gelu'])[{h("3/activation", "c_custkey")} % 3 + 1] AS activation,
  {r(f'{h("3/net/dropout", "c_custkey")} / {_T52} * 0.5')} AS dropout, (16 + floor({h("3/net/units", "c_custkey")} / {_T52} * 240))::BIGINT AS units FROM customer""",
)
def _hpo_sample(t: Tables):
    out = FT.hpo_sample(t.customer, _SPACE, 3, ["c_custkey"])
    return out.select(
        "c_custkey",
        F.round("lr", 6).alias("lr"),
        "layers",
        "bias",
        "activation",
        F.round("net.dropout", 6).alias("dropout"),
        F.col("net.units").alias("units"),
    )


@query("hpo_search")
def _hpo_search(t: Tables):
    features = F.concat(V.doubles("embedding"), F.array(F.lit(1.0)))
    split = SA.random_split(t.embeddings, [8, 2], 5, "vec_id")
    train, validate = split.filter("split = 0"), split.filter("split = 1")
    configs = [FT.Config(O.sgd(), S.fixed(lr), l2=l2) for lr in (0.01, 0.1, 1.0, 4.0) for l2 in (0.0, 1e-3)]
    results, best = FT.hpo_search(train, validate, features, _low_label(), 65, configs, loss="logistic", epochs=3)
    norm = float(np.linalg.norm(best.weights))
    return results.select("config", "repeat", F.round("loss", 6).alias("loss"), F.lit(round(norm, 6)).alias("best_norm"))


@query("best_config", "SELECT user_id AS config, worst FROM (SELECT user_id, max(value) AS worst FROM events GROUP BY 1) ORDER BY worst, config LIMIT 1")
def _best_config(t: Tables):
    return FT.best_config(t.events.select(F.col("user_id").alias("config"), "value"), ["config"], "value")


@query("average_parameters", f"SELECT label::BIGINT AS parameter, pos, {r('avg(x)')} AS w FROM {LONG_EMBEDDINGS} GROUP BY 1, 2")
def _average(t: Tables):
    long = t.embeddings.select(F.col("label").cast("bigint").alias("parameter"), F.posexplode(V.doubles("embedding")).alias("pos", "w"))
    out = O.average_parameters(long, ["parameter", "pos"])
    return out.select("parameter", F.col("pos").cast("bigint").alias("pos"), F.round("w", 6).alias("w"))


@query(
    "check_gradients",
    f"SELECT label::BIGINT AS parameter, {r('sum(abs(CASE WHEN label = 3 THEN 0 ELSE x END))', 4)} AS total, sum(abs(CASE WHEN label = 3 THEN 0 ELSE x END)) = 0 AS all_zero FROM {LONG_EMBEDDINGS} GROUP BY 1",
)
def _check(t: Tables):
    g = F.when(F.col("label") == 3, 0.0).otherwise(F.col("x"))
    long = t.embeddings.select("label", F.explode(V.doubles("embedding")).alias("x"))
    out = O.check_gradients(long.select(F.col("label").cast("bigint").alias("parameter"), g.alias("g")), "parameter")
    return out.withColumn("total", F.round("total", 4))


# inference ------------------------------------------------------------------------------
class MeanDirection(I.Translator):
    """Scores a vector by a fixed direction and names the sign."""

    def prepare(self) -> None:
        self.direction = np.array([((j * 7) % 5 - 2) / 2.0 for j in range(64)])

    def process_input(self, batch: pd.DataFrame):
        return np.stack(batch["embedding"].to_numpy()).astype(np.float64)

    def predict(self, inputs):
        return inputs @ self.direction

    def process_output(self, batch: pd.DataFrame, outputs) -> pd.DataFrame:
        names = np.where(outputs > 0, "up", "down")
        return pd.DataFrame({"vec_id": batch["vec_id"].to_numpy(), "class": names, "score": np.round(outputs, 6) + 0.0})


_DIRECTION = f"SELECT vec_id, CASE WHEN s > 0 THEN 'up' ELSE 'down' END AS class, {r('s')} AS score FROM (SELECT vec_id, sum(x * ((pos * 7) % 5 - 2) / 2.0) AS s FROM {LONG_EMBEDDINGS} GROUP BY 1)"


@query("batch_predict", _DIRECTION)
def _batch_predict(t: Tables):
    return I.batch_predict(t.embeddings.select("vec_id", "embedding"), MeanDirection(), "vec_id bigint, class string, score double")


@query("udf_translator", _DIRECTION)
def _udf_translator(t: Tables):
    schema = "vec_id bigint, class string, score double"
    return I.batch_predict(t.embeddings.select("vec_id", "embedding"), MeanDirection(), schema, batch_size=100)


# a boosted ensemble from a rule: 30 trees of depth 3, node n has the children 2n + 1 and 2n + 2
_DEPTH, _TREES = 3, 30
_F, _TH, _VALUE = "((tree * 7 + node * 5) % 64)", "((tree * 3 + node * 11) % 7 - 3) / 20.0", "((tree * 5 + node * 3) % 11 - 5) / 10.0"


def _given_trees(t: Tables):
    first_leaf = 2**_DEPTH - 1
    nodes = t.spark.range(_TREES * (2 * first_leaf + 1)).select(
        F.floor(F.col("id") / (2 * first_leaf + 1)).cast("int").alias("tree"), (F.col("id") % (2 * first_leaf + 1)).cast("int").alias("node")
    )
    inner = F.col("node") < first_leaf
    return nodes.select(
        "tree",
        "node",
        F.when(inner, F.expr(_F)).cast("int").alias("feature"),
        F.when(inner, F.expr(_TH)).cast("double").alias("threshold"),
        F.when(inner, 2 * F.col("node") + 1).cast("int").alias("left"),
        F.when(inner, 2 * F.col("node") + 2).cast("int").alias("right"),
        F.lit(True).alias("missing_left"),
        F.when(~inner, F.expr(_VALUE)).cast("double").alias("value"),
    )


def _walk_sql() -> str:
    step = lambda of: f"SELECT vec_id, v, tree, 2 * node + CASE WHEN v[{_F} + 1] < {_TH} THEN 1 ELSE 2 END AS node FROM ({of})"
    at = f"SELECT vec_id, embedding::DOUBLE[] AS v, tree, 0 AS node FROM embeddings, range({_TREES}) g(tree)"
    for _ in range(_DEPTH):
        at = step(at)
    return f"SELECT vec_id, tree, {_VALUE} AS y FROM ({at})"


@query(
    "tabular_predict",
    f"""
WITH w AS MATERIALIZED ({_walk_sql()}),
c AS (SELECT vec_id, tree % 3 AS k, sum(y) + 0.5 AS z FROM w GROUP BY 1, 2),
p AS (SELECT vec_id, k, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS p FROM c),
l AS (SELECT vec_id, k, sum(x * ((pos * 5 + k * 3) % 7 - 3) / 4.0) + (k - 1) / 10.0 AS z FROM {LONG_EMBEDDINGS}, range(3) g(k) GROUP BY 1, 2),
q AS (SELECT vec_id, k, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS p FROM l)
SELECT vec_id, 'regression' AS form, 0 AS output, {r('sum(y) + 0.5')} AS score FROM w GROUP BY 1
UNION ALL SELECT vec_id, 'logistic', 0, {r('1 / (1 + exp(-(sum(y) + 0.5)))')} FROM w GROUP BY 1
UNION ALL SELECT vec_id, 'mean', 0, {r('avg(y) + 0.5')} FROM w GROUP BY 1
UNION ALL SELECT vec_id, 'softmax', k::INT, {r('p')} FROM p
UNION ALL SELECT vec_id, 'linear', k::INT, {r('p')} FROM q""",
)
def _tabular(t: Tables):
    """A given boosted ensemble under each objective, and a given softmax regression."""
    df = t.embeddings.select("vec_id", "embedding")
    nodes = _given_trees(t)
    parts = []
    for form in TR.OBJECTIVES:
        model = TR.TreeEnsemble.from_table(nodes, form, 3 if form == "softmax" else 1, 0.5)
        parts.append(TR.predict(df, "embedding", model).select("vec_id", F.lit(form).alias("form"), F.posexplode("scores").alias("output", "score")))
    weights = [[((pos * 5 + k * 3) % 7 - 3) / 4.0 for pos in range(64)] for k in range(3)]
    p = TR.softmax_regression(F.col("embedding"), weights, [(k - 1) / 10.0 for k in range(3)])
    parts.append(df.select("vec_id", F.lit("linear").alias("form"), F.posexplode(p).alias("output", "score")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("score", F.round("score", 6) + 0.0)


def _reviews(t: Tables):
    return t.labels.join(t.documents.select("doc_id", "text"), "doc_id").select(
        "doc_id", T.text_chain(F.col("text")).alias("tokens"), F.col("quality").cast("string").alias("label")
    )


_TEXT = TC.Options(epochs=3, learning_rate=40.0, word_ngrams=2, min_count=2, buckets=4096, seed=11)


def _text_sql(result: str) -> str:
    """Two-label softmax regression on hashed n-grams, its three steps unrolled."""
    steps = []
    for k in range(_TEXT.epochs):
        rate = _TEXT.learning_rate * (1 - k / _TEXT.epochs)
        scored = f"SELECT doc_id, sum(x * p) AS p, sum(x * q) AS q FROM f JOIN w{k} USING (b) GROUP BY 1"
        steps.append(
            f"""s{k} AS MATERIALIZED (SELECT doc_id, y, exp(p) / (exp(p) + exp(q)) AS p, exp(q) / (exp(p) + exp(q)) AS q
  FROM (SELECT d.doc_id, y, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM d LEFT JOIN ({scored}) USING (doc_id))),
l{k} AS (SELECT {k} AS epoch, count(*) AS rows, avg(-ln(CASE WHEN y = 0 THEN p ELSE q END)) AS loss FROM s{k}),
w{k + 1} AS MATERIALIZED (SELECT b, any_value(w.p) - {rate} * sum(x * (s.p - (y = 0)::INT)) / any_value(rows) AS p, any_value(w.q) - {rate} * sum(x * (s.q - (y = 1)::INT)) / any_value(rows) AS q
  FROM f JOIN s{k} s USING (doc_id) JOIN w{k} w USING (b), l{k} GROUP BY b),
h{k} AS (SELECT l{k}.*, weight FROM l{k}, (SELECT sum(abs(p) + abs(q)) AS weight FROM w{k + 1}))"""
        )
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, quality AS y, {CHAIN} AS t FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL),
g AS (SELECT doc_id, unnest(t) AS g FROM d UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM d),
o AS MATERIALIZED (SELECT doc_id, ('0x' || substr(md5(g), 1, 8))::BIGINT % {_TEXT.buckets} AS b FROM g),
k AS (SELECT b FROM o GROUP BY b HAVING count(*) >= {_TEXT.min_count}),
f AS MATERIALIZED (SELECT doc_id, b, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS x FROM o JOIN k USING (b) GROUP BY doc_id, b),
w0 AS (SELECT b, 0.0::DOUBLE AS p, 0.0::DOUBLE AS q FROM k),
{", ".join(steps)}
{result}"""


@query(
    "text_classify_fit",
    _text_sql(" UNION ALL ".join(f"SELECT epoch, rows, {r('loss')} AS loss, {r('weight', 4)} AS weight FROM h{k}" for k in range(_TEXT.epochs))),
)
def _text_fit(t: Tables):
    """Bag of hashed word uni- and bigrams: the loss and the size of the weights by epoch."""
    model = TC.fit(_reviews(t), F.col("tokens"), F.col("label"), _TEXT)
    rows = [(x["epoch"], x["rows"], round(x["loss"], 6), round(x["weight"], 4)) for x in model.history]
    return t.spark.createDataFrame(rows, "epoch int, rows long, loss double, weight double")


@query(
    "text_classify_predict",
    _text_sql(
        f"""SELECT doc_id, rank, '__label__' || CASE WHEN (p >= q) = (rank = 0) THEN 0 ELSE 1 END AS class,
  {r('CASE WHEN rank = 0 THEN greatest(p, q) ELSE least(p, q) END')} AS prob
FROM (SELECT doc_id, exp(p) / (exp(p) + exp(q)) AS p, exp(q) / (exp(p) + exp(q)) AS q
  FROM (SELECT d.doc_id, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM d
    LEFT JOIN (SELECT doc_id, sum(x * p) AS p, sum(x * q) AS q FROM f JOIN w{_TEXT.epochs} USING (b) GROUP BY 1) USING (doc_id))), (VALUES (0), (1)) AS v(rank)"""
    ),
)
def _text_predict(t: Tables):
    df = _reviews(t).filter("label is not null")
    model = TC.fit(df, F.col("tokens"), F.col("label"), _TEXT)
    top = model.predict(df, F.col("tokens"), 2).select("doc_id", F.posexplode("classes").alias("rank", "c"))
    return top.select("doc_id", "rank", "c.class", F.round("c.prob", 6).alias("prob"))


@query("word2vec_fit")
def _word2vec(t: Tables):
    """Skip-gram and bag-of-words vectors of all words with 50 occurrences."""
    df = t.documents.select("doc_id", T.text_chain(F.col("text")).alias("tokens"))
    parts, corpus = [], None
    for mode in WV.MODES:
        options = WV.Options(mode=mode, dimensions=16, epochs=2, min_count=50, seed=7)
        corpus = corpus or WV.prepare(df, F.col("tokens"), ["doc_id"], options)
        parts.append(WV.fit(df, F.col("tokens"), ["doc_id"], options, corpus).select(F.lit(mode).alias("mode"), "word", "n", "vector"))
    return parts[0].unionByName(parts[1])


# user functions ----------------------------------------------------------------------------
@query("udf_featurizer", "SELECT c_custkey, length(c_mktsegment)::DOUBLE AS n, (ascii(c_mktsegment) - 65)::DOUBLE AS first FROM customer")
def _udf_featurizer(t: Tables):
    fn = X.custom_featurizer(lambda s: [len(s), ord(s[0]) - 65])
    df = t.customer.withColumn("v", fn(F.col("c_mktsegment")))
    return df.select("c_custkey", F.col("v")[0].alias("n"), F.col("v")[1].alias("first"))


@query(
    "udf_text_processor",
    "SELECT conv_id, turn, md5(array_to_string(list_filter(list_transform(string_split(rtrim(text, ' '), ' '), lambda w: reverse(w)), lambda w: length(w) > 3), chr(31))) AS digest FROM conversations",
)
def _udf_text(t: Tables):
    backwards = T.each_token(F.reverse)
    long_only = lambda tokens: F.filter(tokens, lambda w: F.length(w) > 3)
    tokens = long_only(backwards(T.tokenize_simple(F.col("text"))))
    return t.conversations.select("conv_id", "turn", T.digest(tokens).alias("digest"))


@query("udf_transform", "SELECT c_nationkey, round(avg(c_acctbal * 1.1), 4) AS balance FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def _udf_transform(t: Tables):
    positive = lambda df: df.filter("c_acctbal > 0")
    raised = lambda df: df.withColumn("c_acctbal", F.col("c_acctbal") * 1.1)
    return I.transform_with(t.customer, positive, raised).groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 4).alias("balance"))


class MeanAbsolute(I.Accumulator):
    """Mean absolute value of a column as a mergeable state."""

    def init(self) -> dict:
        return {"n": 0, "s": 0.0}

    def update(self, state: dict, batch: pd.DataFrame) -> dict:
        return {"n": state["n"] + len(batch), "s": state["s"] + float(batch["value"].abs().sum())}

    def merge(self, a: dict, b: dict) -> dict:
        return {"n": a["n"] + b["n"], "s": a["s"] + b["s"]}

    def finish(self, state: dict) -> float:
        return round(state["s"] / state["n"], 6)


@query("udaf_evaluator", f"SELECT event_type, {r('avg(abs(value))')} AS value FROM events GROUP BY 1")
def _udaf(t: Tables):
    return I.accumulate(t.events.select("event_type", "value"), ["event_type"], MeanAbsolute())


@query(
    "udf_sampler",
    f"SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 50 AS batch_id FROM orders WHERE {h(41, 'o_orderkey')} % 4 = 0",
)
def _udf_sampler(t: Tables):
    """A user sampler is a function DataFrame -> DataFrame with a batch_id."""

    def quarter(df):
        kept = df.filter(F.pmod(keyed_hash(41, "o_orderkey"), F.lit(4)) == 0)
        return SA.batch_sample(row_index(kept, "o_orderkey"), "idx", 50)

    return quarter(t.orders.select("o_orderkey")).select("o_orderkey", "batch_id")


@query("udtf_explode", f"SELECT vec_id, pos::INT AS pos, {r('x')} AS value FROM {LONG_EMBEDDINGS}")
def _udtf(t: Tables):
    unbatch = I.unbatch_udtf()
    t.spark.udtf.register("loomframe_unbatch", unbatch)
    t.embeddings.select("vec_id", V.doubles("embedding").alias("v")).createOrReplaceTempView("loomframe_vectors")
    return t.spark.sql(
        "SELECT vec_id, pos, round(value, 6) AS value FROM loomframe_vectors, LATERAL loomframe_unbatch(v)"
    )


@query(
    "listener",
    f"""
WITH s AS (SELECT avg(l_quantity) mq, stddev_pop(l_quantity) sq, avg(l_discount) md, stddev_pop(l_discount) sd, avg(l_tax) mx, stddev_pop(l_tax) sx, avg(l_extendedprice) mp, stddev_pop(l_extendedprice) sp FROM lineitem),
z AS (SELECT (l_quantity - mq) / sq AS q, (l_discount - md) / sd AS d, (l_tax - mx) / sx AS x, (l_extendedprice - mp) / sp AS p FROM lineitem, s),
w AS (SELECT 0.1 * avg(q * p) AS a, 0.1 * avg(d * p) AS b, 0.1 * avg(x * p) AS c, 0.1 * avg(p) AS e FROM z),
l AS (SELECT 0 AS epoch, 0.5 * avg(p * p) AS v FROM z UNION ALL SELECT 1, 0.5 * avg(pow(p - a * q - b * d - c * x - e, 2)) FROM z, w)
SELECT 'begin' AS event, -1 AS epoch, 1.0::DOUBLE AS value UNION ALL SELECT 'end', -1, 2.0
UNION ALL SELECT unnest(['batch', 'epoch']), epoch, {r('v')} FROM l""",
)
def _listener(t: Tables):
    """The callbacks of a fit, as rows."""
    seen = []

    class Recorder(FT.Listener):
        def on_begin(self, configs):
            seen.append(("begin", -1, float(len(configs))))

        def on_batch(self, epoch, batch, losses):
            seen.append(("batch", epoch, float(losses[0])))

        def on_epoch(self, epoch, losses):
            seen.append(("epoch", epoch, float(losses[0])))

        def on_end(self, fit):
            seen.append(("end", -1, float(len(fit.history))))

    features = F.array("q", "d", "x", F.lit(1.0))
    FT.fit(_line_features(t), features, F.col("p"), 4, epochs=2, listeners=[Recorder()])
    return t.spark.createDataFrame([(e, p, round(v, 6)) for e, p, v in seen], "event string, epoch int, value double")
