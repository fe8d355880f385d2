"""Reductions, windows, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.core.order import row_index
from loomframe.functions import text as T, vectors as V
from loomframe.operators import reduce as R, topk as K, windows as W
from loomframe.plans.registry import LONG_EMBEDDINGS, Tables, query, r, register

# One id covers all elements, one value per group (both axis 0) and arrays (axis 1).


def _three_forms(t: Tables, axis0, axis1, digits: int):
    orders = t.orders.select((F.col("o_totalprice") / 1000.0).alias("x"), "o_orderpriority")
    everything = orders.agg(F.round(axis0(F.col("x")).cast("double"), digits).alias("y")).select(
        F.lit("all").alias("form"), F.lit("").alias("id"), "y"
    )
    groups = orders.groupBy(F.col("o_orderpriority").alias("id")).agg(
        F.round(axis0(F.col("x")).cast("double"), digits).alias("y")
    )
    arrays = t.embeddings.select(
        F.lit("array").alias("form"),
        F.col("vec_id").cast("string").alias("id"),
        F.round(axis1(V.doubles("embedding")).cast("double"), digits).alias("y"),
    )
    return everything.unionByName(groups.select(F.lit("group").alias("form"), "id", "y")).unionByName(arrays)


def _three_sql(agg: str, digits: int) -> str:
    over = lambda x: r(f"({agg.format(x=x)})::DOUBLE", digits)
    return f"""
SELECT 'all' AS form, '' AS id, {over('x')} AS y FROM (SELECT o_totalprice / 1000.0 AS x FROM orders)
UNION ALL SELECT 'group', o_orderpriority, {over('x')} FROM (SELECT o_orderpriority, o_totalprice / 1000.0 AS x FROM orders) GROUP BY 2
UNION ALL SELECT 'array', vec_id::VARCHAR, {over('x')} FROM {LONG_EMBEDDINGS} GROUP BY vec_id"""


_REDUCTIONS = {
    "reduce_max": (F.max, F.array_max, "max({x})"),
    "reduce_min": (F.min, F.array_min, "min({x})"),
    "reduce_sum": (F.sum, V.total, "sum({x})"),
    "reduce_mean": (F.avg, V.mean, "avg({x})"),
    "reduce_norm": (R.norm, V.norm, "sqrt(sum({x} * {x}))"),
    "reduce_norm_l3": (
        lambda x: R.norm(x, 3.0),
        lambda v: V.norm(v, 3.0),
        "pow(sum(pow(abs({x}), 3.0)), 1.0 / 3.0)",
    ),
    "reduce_all": (
        lambda x: R.all_true(F.floor(x / 2)).cast("int"),
        lambda v: V.all_true(F.transform(v, lambda e: F.floor(e * 3))).cast("int"),
        None,
    ),
    "reduce_any": (
        lambda x: R.any_true(F.floor(x / 450)).cast("int"),
        lambda v: V.any_true(F.transform(v, lambda e: F.floor(e * 3))).cast("int"),
        None,
    ),
    "reduce_none": (
        lambda x: R.none_true(F.floor(x / 600)).cast("int"),
        lambda v: V.none_true(F.transform(v, lambda e: F.floor(F.abs(e) * 3))).cast("int"),
        None,
    ),
    "count_nonzero": (
        lambda x: R.count_nonzero(F.floor(x / 200)),
        lambda v: V.count_nonzero(F.transform(v, lambda e: F.floor(F.abs(e) * 10))),
        None,
    ),
}

_SPLIT_SQL = {
    "reduce_all": ("bool_and(floor(x / 2) <> 0)", "bool_and(floor(x * 3) <> 0)"),
    "reduce_any": ("bool_or(floor(x / 450) <> 0)", "bool_or(floor(x * 3) <> 0)"),
    "reduce_none": ("NOT bool_or(floor(x / 600) <> 0)", "NOT bool_or(floor(abs(x) * 3) <> 0)"),
    "count_nonzero": ("count(*) FILTER (floor(x / 200) <> 0)", "count(*) FILTER (floor(abs(x) * 10) <> 0)"),
}


def _split_sql(axis0: str, axis1: str) -> str:
    return f"""
SELECT 'all' AS form, '' AS id, ({axis0})::INT::DOUBLE AS y FROM (SELECT o_totalprice / 1000.0 AS x FROM orders)
UNION ALL SELECT 'group', o_orderpriority, ({axis0})::INT::DOUBLE FROM (SELECT o_orderpriority, o_totalprice / 1000.0 AS x FROM orders) GROUP BY 2
UNION ALL SELECT 'array', vec_id::VARCHAR, ({axis1})::INT::DOUBLE FROM {LONG_EMBEDDINGS} GROUP BY vec_id"""


for _name, (_axis0, _axis1, _agg) in _REDUCTIONS.items():
    # extremes keep all five decimals of the input: nothing is left to round
    _digits = {"reduce_sum": 2, "reduce_max": 6, "reduce_min": 6}.get(_name, 4)
    register(
        _name,
        lambda t, a=_axis0, b=_axis1, d=_digits: _three_forms(t, a, b, d),
        _three_sql(_agg, _digits) if _agg else _split_sql(*_SPLIT_SQL[_name]),
    )


@query(
    "reduce_prod",
    f"""
SELECT 'all' AS form, '' AS id, {r("product(1.0 + x / 1e6)")} AS y FROM (SELECT o_totalprice / 1000.0 AS x FROM orders)
UNION ALL SELECT 'group', o_orderpriority, {r("product(1.0 + x / 1e6)")} FROM (SELECT o_orderpriority, o_totalprice / 1000.0 AS x FROM orders) GROUP BY 2
UNION ALL SELECT 'array', vec_id::VARCHAR, {r("product(1.0 + x)")} FROM {LONG_EMBEDDINGS} GROUP BY vec_id""",
)
def _prod(t: Tables):
    near_one = lambda x: F.product(F.lit(1.0) + x / 1e6)
    return _three_forms(t, near_one, lambda v: V.product(F.transform(v, lambda e: e + 1.0)), 6)


def _percentiles(t: Tables, fractions: dict[str, float]):
    orders = t.orders.select("o_orderpriority", "o_totalprice")
    everything = R.percentile(orders, "o_totalprice", fractions).select(
        F.lit("all").alias("form"), F.lit("").alias("id"), "name", F.round("value", 4).alias("y")
    )
    groups = R.percentile(orders, "o_totalprice", fractions, ["o_orderpriority"]).select(
        F.lit("group").alias("form"), F.col("o_orderpriority").alias("id"), "name", F.round("value", 4).alias("y")
    )
    v = V.doubles("embedding")
    per_row = F.array(*[F.struct(F.lit(k).alias("name"), V.percentile(v, p).alias("y")) for k, p in fractions.items()])
    arrays = t.embeddings.select(F.col("vec_id").cast("string").alias("id"), F.inline(per_row)).select(
        F.lit("array").alias("form"), "id", "name", F.round("y", 4).alias("y")
    )
    return everything.unionByName(groups).unionByName(arrays)


def _percentiles_sql(fractions: dict[str, float]) -> str:
    parts = []
    for k, p in fractions.items():
        parts += [
            f"SELECT 'all' AS form, '' AS id, '{k}' AS name, {r(f'quantile_cont(o_totalprice, {p})', 4)} AS y FROM orders",
            f"SELECT 'group', o_orderpriority, '{k}', {r(f'quantile_cont(o_totalprice, {p})', 4)} FROM orders GROUP BY 2",
            f"SELECT 'array', vec_id::VARCHAR, '{k}', {r(f'quantile_cont(x, {p})', 4)} FROM {LONG_EMBEDDINGS} GROUP BY vec_id",
        ]
    return " UNION ALL ".join(parts)


for _name, _fractions in (
    ("reduce_percentile", {"p10": 0.1, "p90": 0.9, "p99": 0.99}),
    ("reduce_median", {"median": 0.5}),
):
    register(_name, lambda t, f=_fractions: _percentiles(t, f), _percentiles_sql(_fractions))


def _arg(t: Tables, largest: bool):
    rows = R.extreme_position(t.orders, "o_totalprice", ["o_orderkey"], largest).select(
        F.lit("rows").alias("form"), F.lit(-1).cast("bigint").alias("id"), F.col("position").alias("y")
    )
    pick = V.argmax if largest else V.argmin
    arrays = t.embeddings.select(
        F.lit("array").alias("form"), F.col("vec_id").alias("id"), pick(F.col("embedding")).cast("bigint").alias("y")
    )
    return rows.unionByName(arrays)


for _name, _fn, _dir in (("reduce_argmax", "max", "DESC"), ("reduce_argmin", "min", "ASC")):
    register(
        _name,
        lambda t, m=_fn == "max": _arg(t, m),
        f"""
SELECT 'rows' AS form, -1::BIGINT AS id, (SELECT idx FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders)
  ORDER BY o_totalprice {_dir}, idx LIMIT 1) AS y
UNION ALL SELECT 'array', vec_id, list_position(embedding, list_{_fn}(embedding))::BIGINT - 1 FROM embeddings""",
    )


@query(
    "reduce_trace",
    f"""SELECT k::BIGINT AS k, {r('sum(x)')} AS trace FROM (SELECT k, e.x FROM (VALUES (-2), (0), (3)) d(k) JOIN
  (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, embedding::DOUBLE[] AS v FROM embeddings) m ON true,
  LATERAL (SELECT v[i + k + 1] AS x WHERE i + k BETWEEN 0 AND 63) e) GROUP BY k""",
)
def _trace(t: Tables):
    df = row_index(t.embeddings.select("vec_id", V.doubles("embedding").alias("v")), "vec_id")
    out = df.select(*[F.sum(F.when(F.col("idx") + k >= 0, F.get("v", (F.col("idx") + k).cast("int")))).alias(f"k{k}") for k in (-2, 0, 3)])
    pairs = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.round(F.col(f"k{k}"), 6).alias("trace")) for k in (-2, 0, 3)])
    return out.select(F.inline(pairs))


@query(
    "token_frequency",
    "SELECT token, count(*) AS n FROM (SELECT unnest(string_split(rtrim(text, ' '), ' ')) AS token FROM documents) GROUP BY 1",
)
def _token_frequency(t: Tables):
    return R.token_frequency(t.documents.select(F.explode(T.tokenize_simple(F.col("text"))).alias("token")))


@query(
    "accumulator_by_stage",
    f"""
SELECT event_type AS stage, d AS epoch, count(*) AS n, {r('avg(value)')} AS mean, {r('sum(value)', 2)} AS total
FROM (SELECT event_type, value, strftime(ts, '%Y-%m-%d') AS d FROM events) GROUP BY GROUPING SETS ((event_type, d), (event_type))""",
)
def _stages(t: Tables):
    df = t.events.select(F.col("event_type").alias("stage"), F.date_format("ts", "yyyy-MM-dd").alias("epoch"), "value")
    return R.stage_totals(df, "stage", "epoch", "value").select(
        "stage", "epoch", "n", F.round("mean", 6).alias("mean"), F.round("total", 2).alias("total")
    )


@query(
    "gradient_sum",
    f"""SELECT label, pos, {r('sum(x)')} AS total, {r('avg(x)')} AS mean FROM {LONG_EMBEDDINGS} GROUP BY 1, 2""",
)
def _gradient_sum(t: Tables):
    long = t.embeddings.select("label", F.posexplode(V.doubles("embedding")).alias("pos", "x"))
    return long.groupBy("label", F.col("pos").cast("bigint").alias("pos")).agg(
        F.round(F.sum("x"), 6).alias("total"), F.round(F.avg("x"), 6).alias("mean")
    )


# windows ----------------------------------------------------------------------
@query(
    "cum_sum",
    f"""
SELECT 'all' AS form, event_id AS id, {r('sum(value) OVER (ORDER BY event_id)', 4)} AS y FROM events
UNION ALL SELECT 'group', event_id, {r('sum(value) OVER (PARTITION BY event_type ORDER BY event_id)', 4)} FROM events
UNION ALL SELECT 'array', vec_id, {r('sum((64 - pos) * x * (pos + 1 + 64) / 2.0)', 4)} FROM {LONG_EMBEDDINGS} GROUP BY vec_id""",
)
def _cum_sum(t: Tables):
    events = t.events.select("event_id", "event_type", "value")
    everything = W.cum_sum(events, "value", "event_id").select(
        F.lit("all").alias("form"), F.col("event_id").alias("id"), F.round("running", 4).alias("y")
    )
    groups = W.cum_sum(events, "value", "event_id", ["event_type"]).select(
        F.lit("group").alias("form"), F.col("event_id").alias("id"), F.round("running", 4).alias("y")
    )
    # fingerprint of a running sum: sum_p (p + 1) * cs_p = sum_j x_j * sum_{p >= j} (p + 1)
    arrays = t.embeddings.select(
        F.lit("array").alias("form"),
        F.col("vec_id").alias("id"),
        F.round(V.fingerprint(V.cumsum(V.doubles("embedding"))), 4).alias("y"),
    )
    return everything.unionByName(groups).unionByName(arrays)


EVENT_SERIES = """(SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS p,
  count(*) OVER (PARTITION BY event_type) AS n FROM events)"""


def _pool_sql(agg: str, kernel: int, stride: int, padding: int, ceil_mode: bool = False) -> str:
    rounding = "ceil" if ceil_mode else "floor"
    outs = f"({rounding}((n + {2 * padding} - {kernel}) / {stride}.0)::BIGINT + 1)"
    if ceil_mode:
        outs = f"CASE WHEN ({outs} - 1) * {stride} >= n + {padding} THEN {outs} - 1 ELSE {outs} END"
    return f"""
WITH s AS {EVENT_SERIES}, m AS (SELECT event_type, any_value(n) AS n FROM s GROUP BY 1),
o AS (SELECT event_type, n, unnest(range({outs})) AS out FROM m)
SELECT o.event_type, out, {r(agg, 4)} AS value FROM o JOIN s ON s.event_type = o.event_type
  AND s.p BETWEEN out * {stride} - {padding} AND out * {stride} - {padding} + {kernel - 1} GROUP BY 1, 2, o.n"""


@query("pool1d_max", _pool_sql("max(value)", 3, 2, 1))
def _pool_max(t: Tables):
    return W.pool1d(t.events.select("event_type", "event_id", "value"), "value", ["event_type"], "event_id", "max", 3, 2, 1).withColumn("value", F.round("value", 4))


@query("pool1d_avg", _pool_sql("sum(value) / least(4, o.n + 2 - out * 3)", 4, 3, 1, ceil_mode=True))
def _pool_avg(t: Tables):
    out = W.pool1d(
        t.events.select("event_type", "event_id", "value"), "value", ["event_type"], "event_id", "avg", 4, 3, 1, ceil_mode=True
    )
    return out.withColumn("value", F.round("value", 4))


@query("pool1d_lp", _pool_sql("sqrt(sum(value * value))", 5, 5, 0))
def _pool_lp(t: Tables):
    return W.pool1d(t.events.select("event_type", "event_id", "value"), "value", ["event_type"], "event_id", "lp", 5, 5).withColumn("value", F.round("value", 4))


for _how, _agg in (("max", "max(value)"), ("avg", "avg(value)"), ("lp", "sqrt(sum(value * value))")):
    register(
        f"global_pool_{_how}",
        lambda t, how=_how: W.global_pool(t.events, "value", ["user_id"], how).withColumn("value", F.round("value", 4)),
        f"SELECT user_id, {r(_agg, 4)} AS value FROM events GROUP BY 1",
    )


@query(
    "conv1d",
    f"""
WITH s AS (SELECT *, (p * 7 % 11) - 5.0 AS c1 FROM {EVENT_SERIES}), m AS (SELECT event_type, any_value(n) AS n FROM s GROUP BY 1),
o AS (SELECT event_type, unnest(range(floor((n + 4 - 5) / 2.0)::BIGINT + 1)) AS out FROM m),
w AS (SELECT o.event_type, out, value, c1, (p - out * 2 + 2) AS d FROM o JOIN s ON s.event_type = o.event_type AND p BETWEEN out * 2 - 2 AND out * 2 + 2)
SELECT event_type, out, {r('sum(value * ([0.5, -0.25, 1.5])[d // 2 + 1] + c1 * ([0.1, 0.2, -0.3])[d // 2 + 1]) + 0.75', 4)} AS f0,
  {r('sum(value * ([1.0, 1.0, 1.0])[d // 2 + 1] + c1 * ([2.0, 0.0, -2.0])[d // 2 + 1]) - 0.25', 4)} AS f1 FROM w WHERE d % 2 = 0 GROUP BY 1, 2""",
)
def _conv(t: Tables):
    from loomframe.core.order import group_rank

    df = group_rank(t.events.select("event_type", "event_id", "value"), ["event_type"], "event_id", "p")
    df = df.withColumn("c1", F.col("p") * 7 % 11 - 5.0)
    weights = [[[0.5, -0.25, 1.5], [0.1, 0.2, -0.3]], [[1.0, 1.0, 1.0], [2.0, 0.0, -2.0]]]
    out = W.conv1d(df, ["value", "c1"], ["event_type"], "event_id", weights, [0.75, -0.25], stride=2, padding=2, dilation=2)
    return out.select("event_type", "out", F.round("f0", 4).alias("f0"), F.round("f1", 4).alias("f1"))


DOC_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"


@query(
    "consecutive_pairs",
    f"""SELECT a.doc_id, a.pos // 2 AS pair, a.line AS first, b.line AS second FROM {DOC_LINES} a JOIN {DOC_LINES} b
  ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.pos % 2 = 0""",
)
def _consecutive(t: Tables):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return W.consecutive_pairs(lines, ["doc_id"], "pos", "line")


@query(
    "latest_metric",
    "SELECT event_type, event_id, value FROM events e WHERE ts = (SELECT max(ts) FROM events x WHERE x.event_type = e.event_type)",
)
def _latest(t: Tables):
    return W.latest(t.events.select("event_type", "event_id", "value", "ts"), "event_type", ["ts", "event_id"]).drop("ts")


@query("argsort_rank", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS rank FROM orders")
def _argsort_rank(t: Tables):
    return W.argsort_rank(t.orders.select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"]).drop("o_totalprice")


# sort, limit, top-k -------------------------------------------------------------
@query(
    "sort_axis",
    f"""SELECT 'rows' AS form, row_number() OVER (ORDER BY value, event_id) - 1 AS id, value AS y FROM events
UNION ALL SELECT 'array', vec_id, {r('sum(k * x)')} FROM (SELECT vec_id, x, row_number() OVER (PARTITION BY vec_id ORDER BY x, pos) AS k FROM {LONG_EMBEDDINGS}) GROUP BY vec_id""",
)
def _sort(t: Tables):
    rows = row_index(t.events.select("value", "event_id"), ["value", "event_id"]).select(
        F.lit("rows").alias("form"), F.col("idx").alias("id"), F.col("value").alias("y")
    )
    arrays = t.embeddings.select(
        F.lit("array").alias("form"),
        F.col("vec_id").alias("id"),
        F.round(V.fingerprint(F.array_sort(V.doubles("embedding"))), 6).alias("y"),
    )
    return rows.unionByName(arrays)


@query(
    "argsort",
    f"""
WITH e AS (SELECT vec_id, pos, row_number() OVER (PARTITION BY vec_id ORDER BY x, pos) AS a, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, pos) AS d FROM {LONG_EMBEDDINGS})
SELECT vec_id, sum(a * pos)::DOUBLE AS ascending, sum(d * pos)::DOUBLE AS descending FROM e GROUP BY 1""",
)
def _argsort(t: Tables):
    v = F.col("embedding")
    return t.embeddings.select(
        "vec_id",
        V.fingerprint(V.argsort(v)).alias("ascending"),
        V.fingerprint(V.argsort(v, ascending=False)).alias("descending"),
    )


def class_probabilities(t: Tables):
    """(vec_id, label, probs): softmax over the first ten vector entries times ten."""
    from loomframe.functions.activations import softmax

    logits = F.transform(F.slice(V.doubles("embedding"), 1, 10), lambda x: x * 10.0)
    return t.embeddings.select("vec_id", F.col("label").cast("bigint").alias("label"), softmax(logits).alias("probs"))


CLASS_LONG = f"""(SELECT vec_id, label::BIGINT AS label, pos AS class_id, 'class_' || pos AS class, exp(x * 10.0) / sum(exp(x * 10.0)) OVER (PARTITION BY vec_id) AS prob
  FROM {LONG_EMBEDDINGS} WHERE pos < 10)"""
CLASS_NAMES = [f"class_{i}" for i in range(10)]


@query(
    "classification_topk",
    f"""SELECT vec_id, class, rank, {r('prob')} AS prob FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, class_id) AS rank FROM {CLASS_LONG}) WHERE rank <= 3""",
)
def _topk(t: Tables):
    df = class_probabilities(t).withColumn("top", K.topk(F.col("probs"), CLASS_NAMES, 3))
    return df.select("vec_id", F.posexplode("top").alias("p", "c")).select(
        "vec_id", "c.class", (F.col("p") + 1).cast("bigint").alias("rank"), F.round("c.prob", 6).alias("prob")
    )


@query(
    "classification_best",
    f"SELECT vec_id, arg_max(class, prob) AS class, {r('max(prob)')} AS prob FROM {CLASS_LONG} GROUP BY 1",
)
def _best(t: Tables):
    best = K.best(F.col("probs"), CLASS_NAMES)
    return class_probabilities(t).select("vec_id", best["class"].alias("class"), F.round(best["prob"], 6).alias("prob"))


@query(
    "classification_get",
    f"""SELECT vec_id, {r("max(prob) FILTER (class = 'class_4')")} AS prob, max(prob) FILTER (class = 'absent') IS NULL AS absent FROM {CLASS_LONG} GROUP BY 1""",
)
def _get(t: Tables):
    items = K.classifications(F.col("probs"), CLASS_NAMES)
    return class_probabilities(t).select(
        "vec_id",
        F.round(K.get(items, "class_4")["prob"], 6).alias("prob"),
        K.get(items, "absent").isNull().alias("absent"),
    )


@query(
    "classification_json",
    f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, class_id) AS rank FROM {CLASS_LONG})
SELECT vec_id, '[' || string_agg('{{"class":"' || class || '","permille":' || floor(prob * 1000)::BIGINT || '}}', ',' ORDER BY rank) || ']' AS json FROM k WHERE rank <= 5 GROUP BY 1""",
)
def _json(t: Tables):
    top = F.transform(
        K.topk(F.col("probs"), CLASS_NAMES, 5),
        lambda c: F.struct(c["class"].alias("class"), F.floor(c["prob"] * 1000).cast("bigint").alias("permille")),
    )
    return class_probabilities(t).select("vec_id", F.to_json(top).alias("json"))


TOKENS = "(SELECT doc_id, unnest(string_split(rtrim(text, ' '), ' ')) AS token FROM documents)"


@query(
    "dictionary_top_n",
    f"""
SELECT unnest(['<unk>', '<pad>', '<bos>', '<eos>', '<msk>']) AS token, unnest(range(5))::BIGINT AS index
UNION ALL SELECT token, row_number() OVER (ORDER BY n DESC, token) + 4 FROM (SELECT token, count(*) AS n FROM {TOKENS} GROUP BY 1 ORDER BY n DESC, token LIMIT 995)""",
)
def _dictionary(t: Tables):
    tokens = t.documents.select(F.explode(T.tokenize_simple(F.col("text"))).alias("token"))
    return K.dictionary_top_n(R.token_frequency(tokens), ["<unk>", "<pad>", "<bos>", "<eos>", "<msk>"], 1000)
