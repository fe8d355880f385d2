"""Losses, evaluators and metric reports over prediction and latency tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import activations as A, vectors as V
from loomframe.operators import evaluators as EV, losses as LO, metrics as M
from loomframe.plans.registry import LONG_EMBEDDINGS, Tables, query, r, register


# a regression table: price per thousand against 1.05 x quantity, batches = orders
def regression(t: Tables):
    return t.lineitem.select(
        F.col("l_orderkey").alias("batch"),
        (F.col("l_extendedprice") / 1000.0).alias("y"),
        (F.col("l_quantity") * 1.05).alias("p"),
    )


REGRESSION = "(SELECT l_orderkey AS batch, l_extendedprice / 1000.0 AS y, l_quantity * 1.05 AS p FROM lineitem)"


# a binary table: a logit per covered document
def binary(t: Tables):
    docs = t.documents.select("doc_id", (F.pmod(F.col("n_chars"), F.lit(997)) / 250.0 - 2.0).alias("p"))
    return t.labels.join(docs, "doc_id").select(
        F.floor(F.col("doc_id") / 16).alias("batch"), F.col("quality").cast("double").alias("y"), "p"
    )


BINARY = "(SELECT doc_id // 16 AS batch, quality::DOUBLE AS y, (n_chars % 997) / 250.0 - 2.0 AS p FROM labels JOIN documents USING (doc_id))"


# a ten-class table: logits from the first ten vector entries
def classes(t: Tables):
    logits = F.transform(F.slice(V.doubles("embedding"), 1, 10), lambda x: x * 10.0)
    return t.embeddings.select(F.floor(F.col("vec_id") / 32).alias("batch"), "vec_id", F.col("label").cast("int").alias("y"), logits.alias("p"))


CLASSES = f"""(SELECT vec_id // 32 AS batch, vec_id, label AS y, pos AS c, x * 10.0 AS p,
  x * 10.0 - ln(sum(exp(x * 10.0)) OVER (PARTITION BY vec_id)) AS logp FROM {LONG_EMBEDDINGS} WHERE pos < 10)"""


def _both(df, loss):
    """The loss over instances, and over batch means."""
    scored = df.withColumn("l", loss)
    one = LO.mean_loss(scored, "l").select(F.lit("instances").alias("form"), F.round("loss", 6).alias("loss"))
    two = LO.mean_loss(scored, "l", "batch").select(F.lit("batches").alias("form"), F.round("loss", 6).alias("loss"))
    return one.unionByName(two)


def _both_sql(table: str, loss: str) -> str:
    return f"""
WITH l AS (SELECT batch, {loss} AS l FROM {table} x)
SELECT 'instances' AS form, {r('avg(l)')} AS loss FROM l UNION ALL SELECT 'batches', {r('avg(m)')} FROM (SELECT avg(l) AS m FROM l GROUP BY batch)"""


_LOSSES = {
    "loss_l1": (regression, REGRESSION, lambda: LO.l1(F.col("y"), F.col("p")), "abs(y - p)"),
    "loss_l2": (regression, REGRESSION, lambda: LO.l2(F.col("y"), F.col("p")), "0.5 * (y - p) * (y - p)"),
    "loss_hinge": (
        binary,
        BINARY,
        lambda: LO.hinge(F.col("y") * 2 - 1, F.col("p"), 1.0, 0.5),
        "0.5 * greatest(1.0 - (2 * y - 1) * p, 0.0)",
    ),
    "loss_sigmoid_bce": (
        binary,
        BINARY,
        lambda: LO.sigmoid_bce(F.col("y"), F.col("p")),
        "greatest(p, 0.0) - p * y + ln(1.0 + exp(-abs(p)))",
    ),
    "loss_sigmoid_bce_probability": (
        binary,
        BINARY,
        lambda: LO.sigmoid_bce(F.col("y"), A.sigmoid(F.col("p")), from_logits=False),
        "-(y * ln(1.0 / (1.0 + exp(-p)) + 1e-5) + (1.0 - y) * ln(1.0 - 1.0 / (1.0 + exp(-p)) + 1e-5))",
    ),
    "loss_softmax_ce": (
        classes,
        f"(SELECT batch, logp FROM {CLASSES} WHERE c = y)",
        lambda: LO.softmax_ce(F.col("y"), F.col("p")),
        "-logp",
    ),
    "loss_softmax_ce_dense": (
        classes,
        f"(SELECT batch, sum(-logp * (0.01 + 0.9 * (c = y)::INT)) AS l0 FROM {CLASSES} GROUP BY batch, vec_id)",
        lambda: LO.softmax_ce(V.one_hot(F.col("y"), 10, 0.91, 0.01), F.col("p"), sparse=False),
        "l0",
    ),
    "loss_composite": (
        regression,
        REGRESSION,
        lambda: LO.composite(LO.l1(F.col("y"), F.col("p")), LO.l2(F.col("y"), F.col("p"), 0.25)),
        "abs(y - p) + 0.25 * (y - p) * (y - p)",
    ),
}
for _name, (_table, _table_sql, _loss, _loss_sql) in _LOSSES.items():
    register(_name, lambda t, a=_table, b=_loss: _both(a(t), b()), _both_sql(_table_sql, _loss_sql))


# sequences of eight steps over eight classes, from the 64 vector entries
def step_table(t: Tables):
    v = F.transform(V.doubles("embedding"), lambda x: x * 8.0)
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda s: F.slice(v, s * 8 + 1, F.lit(8)))
    labels = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda s: F.pmod(F.col("vec_id") + s * 3, F.lit(8)).cast("int"))
    return t.embeddings.select("vec_id", steps.alias("p"), labels.alias("y"), (F.col("label") % 8 + 1).alias("valid"))


STEPS = f"""(SELECT vec_id, label % 8 + 1 AS valid, pos // 8 AS step, pos % 8 AS c, (vec_id + (pos // 8) * 3) % 8 AS y,
  x * 8.0 - ln(sum(exp(x * 8.0)) OVER (PARTITION BY vec_id, pos // 8)) AS logp FROM {LONG_EMBEDDINGS})"""


@query(
    "loss_masked_softmax_ce",
    f"SELECT vec_id, {r('sum(CASE WHEN step < valid THEN -logp ELSE 0 END) / 8.0')} AS loss FROM {STEPS} WHERE c = y GROUP BY 1",
)
def _masked_ce(t: Tables):
    loss = LO.masked_softmax_ce(F.col("y"), F.col("p"), F.col("valid"))
    return step_table(t).select("vec_id", F.round(loss, 6).alias("loss"))


def masked_positions(t: Tables):
    zipped = F.arrays_zip("p", "y")
    return step_table(t).select("vec_id", "valid", F.posexplode(zipped).alias("step", "z")).select(
        "vec_id", A.log_softmax(F.col("z.p")).alias("logp"), F.col("z.y").alias("y"), (F.col("step") < F.col("valid")).cast("int").alias("m")
    )


MASKED_ROWS = f"""(SELECT vec_id, step, max(logp) FILTER (c = y) AS l, (arg_max(c, (logp, -c)) = any_value(y))::INT AS hit, any_value((step < valid)::INT) AS m FROM {STEPS} GROUP BY 1, 2)"""


@query("loss_masked_lm", f"SELECT {r('sum(-l * m) / (sum(m) + 1e-5)')} AS loss FROM {MASKED_ROWS}")
def _masked_lm(t: Tables):
    return LO.masked_lm(masked_positions(t), "logp", "y", "m").select(F.round("loss", 6).alias("loss"))


@query("eval_masked_lm_accuracy", f"SELECT {r('sum(hit * m) / sum(m)')} AS accuracy FROM {MASKED_ROWS}")
def _masked_acc(t: Tables):
    return LO.masked_lm(masked_positions(t), "logp", "y", "m").select(F.round("accuracy", 6).alias("accuracy"))


def sentence_scores(t: Tables):
    v = F.slice(V.doubles("embedding"), 1, 2)
    return t.embeddings.select(A.log_softmax(F.transform(v, lambda x: x * 10.0)).alias("logp"), (F.col("label") % 2).cast("int").alias("y"))


SENTENCES = f"""(SELECT vec_id, max(logp) FILTER (pos = y) AS l, (arg_max(pos, (logp, -pos)) = any_value(y))::INT AS hit FROM
  (SELECT vec_id, pos, label % 2 AS y, x * 10.0 - ln(sum(exp(x * 10.0)) OVER (PARTITION BY vec_id)) AS logp FROM {LONG_EMBEDDINGS} WHERE pos < 2) GROUP BY 1)"""


@query("loss_next_sentence", f"SELECT {r('avg(-l)')} AS loss FROM {SENTENCES}")
def _nsp_loss(t: Tables):
    return LO.next_sentence(sentence_scores(t), "logp", "y").select(F.round("loss", 6).alias("loss"))


@query("eval_next_sentence_accuracy", f"SELECT {r('avg(hit)')} AS accuracy FROM {SENTENCES}")
def _nsp_acc(t: Tables):
    return LO.next_sentence(sentence_scores(t), "logp", "y").select(F.round("accuracy", 6).alias("accuracy"))


@query(
    "loss_bert_pretraining",
    f"SELECT {r(f'(SELECT sum(-l * m) / (sum(m) + 1e-5) FROM {MASKED_ROWS}) + (SELECT avg(-l) FROM {SENTENCES})')} AS loss",
)
def _pretraining(t: Tables):
    nsp = LO.next_sentence(sentence_scores(t), "logp", "y").select("loss").scalar()
    return LO.masked_lm(masked_positions(t), "logp", "y", "m").select(F.round(F.col("loss") + nsp, 6).alias("loss"))


def anchor_offsets(t: Tables):
    """Four true and predicted offsets, mask and class scores per vector."""
    v = V.doubles("embedding")
    mask = F.array_repeat((F.col("label") % 2).cast("double"), 4)
    return t.embeddings.select(
        "vec_id",
        (F.col("label") % 3).cast("int").alias("y"),
        F.transform(F.slice(v, 1, 3), lambda x: x * 5.0).alias("p"),
        F.slice(v, 5, 4).alias("bl"),
        F.slice(v, 9, 4).alias("bp"),
        mask.alias("bm"),
    )


OFFSETS = f"""(SELECT a.vec_id, sum(abs(a.x - b.x) * (a.label % 2)) AS e FROM {LONG_EMBEDDINGS} a JOIN {LONG_EMBEDDINGS} b
  ON a.vec_id = b.vec_id AND b.pos = a.pos + 4 WHERE a.pos BETWEEN 4 AND 7 GROUP BY 1)"""
ANCHOR_CE = f"""(SELECT vec_id, max(logp) FILTER (pos = y) AS l, (arg_max(pos, (logp, -pos)) = any_value(y))::INT AS hit FROM
  (SELECT vec_id, pos, label % 3 AS y, x * 5.0 - ln(sum(exp(x * 5.0)) OVER (PARTITION BY vec_id)) AS logp FROM {LONG_EMBEDDINGS} WHERE pos < 3) GROUP BY 1)"""


@query("loss_ssd", f"SELECT {r('avg(-l + e / 4.0)')} AS loss FROM {ANCHOR_CE} JOIN {OFFSETS} o USING (vec_id)")
def _ssd(t: Tables):
    loss = LO.ssd(F.col("y"), F.col("p"), F.col("bl"), F.col("bp"), F.col("bm"))
    return LO.mean_loss(anchor_offsets(t), loss).select(F.round("loss", 6).alias("loss"))


@query("eval_box_error", f"SELECT {r('sum(e) / (4.0 * count(*))')} AS error FROM {OFFSETS}")
def _box_error(t: Tables):
    return anchor_offsets(t).agg(F.round(EV.box_error(F.col("bl"), F.col("bp"), F.col("bm")), 6).alias("error"))


@query("eval_ssd_accuracy", f"SELECT {r('avg(hit)')} AS accuracy FROM {ANCHOR_CE}")
def _ssd_accuracy(t: Tables):
    return anchor_offsets(t).agg(F.round(EV.accuracy(F.col("y"), F.col("p")), 6).alias("accuracy"))


# the embedding entries as a parameter table (parameter = label)
for _name, _agg, _sql in (
    ("penalty_l1", lambda: LO.penalty_l1(F.col("w"), 0.01), "0.01 * sum(abs(x))"),
    ("penalty_l2", lambda: LO.penalty_l2(F.col("w"), 0.02), "0.02 * sum(x * x)"),
    ("penalty_elastic", lambda: LO.penalty_elastic(F.col("w"), 0.01, 0.02), "0.01 * sum(abs(x)) + 0.02 * sum(x * x)"),
):
    register(
        _name,
        lambda t, a=_agg: t.embeddings.select(F.col("label").cast("bigint").alias("parameter"), F.explode(V.doubles("embedding")).alias("w"))
        .groupBy("parameter")
        .agg(F.round(a(), 6).alias("penalty")),
        f"SELECT label::BIGINT AS parameter, {r(_sql)} AS penalty FROM {LONG_EMBEDDINGS} GROUP BY 1",
    )

_RANKED = f"(SELECT vec_id, y, c, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, c) AS k FROM {CLASSES})"


@query(
    "eval_accuracy",
    f"SELECT y::BIGINT AS label, {r('avg((c = y)::INT)')} AS accuracy FROM {_RANKED} WHERE k = 1 GROUP BY 1 UNION ALL SELECT -1, {r('avg((c = y)::INT)')} FROM {_RANKED} WHERE k = 1",
)
def _accuracy(t: Tables):
    acc = F.round(EV.accuracy(F.col("y"), F.col("p")), 6).alias("accuracy")
    df = classes(t)
    return df.groupBy(F.col("y").cast("bigint").alias("label")).agg(acc).unionByName(
        df.agg(acc).select(F.lit(-1).cast("bigint").alias("label"), "accuracy")
    )


@query("eval_binary_accuracy", f"SELECT {r('avg(((p >= 0.25)::INT = y)::INT)')} AS accuracy FROM {BINARY}")
def _binary_accuracy(t: Tables):
    return binary(t).agg(F.round(EV.binary_accuracy(F.col("y"), F.col("p"), 0.25), 6).alias("accuracy"))


@query("eval_topk_accuracy", f"SELECT {r('sum((k <= 3 AND c = y)::INT) / count(DISTINCT vec_id)')} AS accuracy FROM {_RANKED}")
def _topk_accuracy(t: Tables):
    return classes(t).agg(F.round(EV.topk_accuracy(F.col("y"), F.col("p"), 3), 6).alias("accuracy"))


@query(
    "eval_dataset",
    f"""SELECT 'accuracy' AS evaluator, {r('avg((c = y)::INT)')} AS value FROM {_RANKED} WHERE k = 1
UNION ALL SELECT 'top3', {r('sum((k <= 3 AND c = y)::INT) / count(DISTINCT vec_id)')} FROM {_RANKED}
UNION ALL SELECT 'loss', {r('avg(-logp)')} FROM {CLASSES} WHERE c = y""",
)
def _eval_dataset(t: Tables):
    y, p = F.col("y"), F.col("p")
    evaluators = {"accuracy": EV.accuracy(y, p), "top3": EV.topk_accuracy(y, p, 3), "loss": F.avg(LO.softmax_ce(y, p))}
    return EV.evaluate(classes(t), evaluators).withColumn("value", F.round("value", 6))


@query(
    "divergence_check",
    """SELECT DISTINCT user_id AS run, true AS diverged FROM events WHERE value > 150""",
)
def _divergence(t: Tables):
    # a loss beyond 150 overflows to NaN
    loss = F.when(F.col("value") > 150, F.lit(float("nan"))).otherwise(F.col("value"))
    return LO.divergence(t.events.select(F.col("user_id").alias("run"), loss.alias("loss")), ["run"], "loss")


# metrics ---------------------------------------------------------------------------
@query("metric_mean", f"SELECT event_type, {r('avg(value)')} AS mean FROM events GROUP BY 1")
def _metric_mean(t: Tables):
    return M.mean(t.events, "event_type", "value").withColumn("mean", F.round("mean", 6))


_NTH = "(SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)"


@query(
    "metric_percentile",
    f"SELECT event_type, p AS percent, value FROM {_NTH}, (VALUES (0), (50), (90), (99), (100)) g(p) WHERE k = least(n * p // 100, n - 1)",
)
def _metric_percentile(t: Tables):
    return M.percentile(t.events, ["event_type"], "value", [0, 50, 90, 99, 100])


@query("metric_names", "SELECT DISTINCT event_type FROM events")
def _metric_names(t: Tables):
    return M.names(t.events, "event_type")


@query("metric_exists", "SELECT 'click' AS name, (SELECT count(*) > 0 FROM events WHERE event_type = 'click') AS present UNION ALL SELECT 'absent', (SELECT count(*) > 0 FROM events WHERE event_type = 'absent')")
def _metric_exists(t: Tables):
    return M.exists(t.events, "event_type", ["click", "absent"])


def _wide(order: str, percents) -> str:
    return ", ".join(f"max(value) FILTER (k = least(n * {p} // 100, n - 1)) AS p{p}" for p in percents)


@query(
    "latency_report",
    f"SELECT event_type AS phase, {_wide('k', (50, 90, 99))}, count(*) AS n, {r('count(*) / sum(value)')} AS throughput FROM {_NTH} GROUP BY 1",
)
def _latency(t: Tables):
    out = M.latency_report(t.events.select(F.col("event_type").alias("phase"), "value"), "phase", "value")
    return out.withColumn("throughput", F.round("throughput", 6))


@query(
    "training_speed",
    f"SELECT event_type AS phase, {_wide('k', (50, 90))}, {r('32 * count(*) / sum(value)')} AS items_per_second FROM {_NTH} GROUP BY 1",
)
def _speed(t: Tables):
    df = t.events.select(F.col("event_type").alias("phase"), F.lit(32).alias("size"), F.col("value").alias("seconds"))
    return M.training_speed(df, ["phase"], "size", "seconds").withColumn("items_per_second", F.round("items_per_second", 6))


@query(
    "epoch_evaluations",
    """
WITH e AS (SELECT event_type AS evaluator, CASE WHEN user_id % 2 = 0 THEN 'train' ELSE 'validate' END AS stage, event_id AS epoch, value FROM events)
SELECT evaluator, max(epoch) AS epoch, arg_max(value, epoch) FILTER (stage = 'train') AS train, arg_max(value, epoch) FILTER (stage = 'validate') AS validate FROM e GROUP BY 1""",
)
def _epochs(t: Tables):
    stage = F.when(F.col("user_id") % 2 == 0, "train").otherwise("validate")
    df = t.events.select(F.col("event_type").alias("evaluator"), stage.alias("stage"), F.col("event_id").alias("epoch"), "value")
    return M.epoch_evaluations(df, "stage", "evaluator", "epoch", "value")
