"""Fit against closed forms, search, inference and accumulators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomframe.operators import fit as FT, inference as I, optimizers as O, schedules as S


@pytest.fixture(scope="module")
def line(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 3))
    y = x @ np.array([2.0, -1.0, 0.5]) + 0.25
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double")


def features():
    return F.array("a", "b", "c", F.lit(1.0))


def test_linear_reaches_the_closed_form(line):
    model = FT.fit(line, features(), F.col("y"), 4, [FT.Config(O.sgd(), S.fixed(0.5))], epochs=12)
    assert model.weights[0] == pytest.approx([2.0, -1.0, 0.5, 0.25], abs=0.02)
    losses = [h["loss"] for h in model.history]
    assert losses == sorted(losses, reverse=True)


def test_mini_batches_and_listeners(line):
    seen = []

    class Recorder(FT.Listener):
        def on_batch(self, epoch, batch, losses):
            seen.append((epoch, batch))

    model = FT.fit(line, features(), F.col("y"), 4, [FT.Config(O.adam(), S.fixed(0.2))], epochs=3, batches=3, seed=1, key=["id"], listeners=[Recorder()])
    assert seen == [(e, b) for e in range(3) for b in range(3)]
    assert model.history[-1]["loss"] < model.history[0]["loss"]


def test_models_train_together_as_alone(line):
    configs = [FT.Config(O.sgd(), S.fixed(0.1)), FT.Config(O.momentum(), S.fixed(0.05), l2=0.01)]
    both = FT.fit(line, features(), F.col("y"), 4, configs, epochs=3)
    for i, c in enumerate(configs):
        assert FT.fit(line, features(), F.col("y"), 4, [c], epochs=3).weights[0] == pytest.approx(both.weights[i])


def test_logistic_agrees_with_ml(spark, line):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    label = (F.col("y") + 4 * F.sin(F.col("id")) > 0).cast("double")
    model = FT.fit(line, features(), label, 4, [FT.Config(O.adam(), S.factor(0.6, 0.94, 1000))], "logistic", epochs=70)
    ml = LogisticRegression(maxIter=100, standardization=False).fit(
        line.select(array_to_vector(F.array("a", "b", "c")).alias("features"), label.alias("label"))
    )
    want = [*ml.coefficients, ml.intercept]
    assert model.weights[0] == pytest.approx(want, rel=0.05, abs=0.05)


def test_search_picks_the_lowest_worst_loss(line):
    configs = [FT.Config(O.sgd(), S.fixed(lr)) for lr in (0.0001, 0.5, 0.01)]
    results, best = FT.hpo_search(line, line, features(), F.col("y"), 4, configs, repeats=2, epochs=4)
    assert results.count() == 6
    assert best.weights[0][0] == pytest.approx(2.0, abs=0.3)


def test_best_config_takes_the_worst_repeat(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.9), ("b", 0.5), ("b", 0.6)], "c string, loss double")
    assert tuple(FT.best_config(df, ["c"], "loss").first()) == ("b", 0.6)


def test_translator_must_answer_every_row(spark):
    class Drops(I.Translator):
        def predict(self, inputs):
            return [1.0] * len(inputs)

        def process_output(self, batch, outputs):
            return batch.iloc[1:]

    with pytest.raises(Exception, match="every row"):
        I.batch_predict(spark.range(5), Drops(), "id long").collect()


def test_accumulator_merges_states(spark):
    class Total(I.Accumulator):
        def init(self):
            return {"s": 0}

        def update(self, state, batch: pd.DataFrame):
            return {"s": state["s"] + int(batch["id"].sum())}

        def merge(self, a, b):
            return {"s": a["s"] + b["s"]}

        def finish(self, state):
            return float(state["s"])

    df = spark.range(0, 1000, 1, 8).withColumn("g", F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 3))
    got = {r.g: r.value for r in I.accumulate(df, ["g"], Total()).collect()}
    want = {}
    for i in range(1000):
        g = 0 if i < 700 else i % 3
        want[g] = want.get(g, 0) + i
    assert got == want
