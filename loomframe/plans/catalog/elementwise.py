"""Element-wise functions and activations, each in scalar and vector form.

The scalar form runs over ``orders`` (one element per row), the vector form
over ``embeddings`` (one array per row, folded to a position-weighted sum).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import activations as A, elementwise as E, vectors as V
from loomframe.plans.registry import Tables, r, register

# domain -> (scalar over orders, element over embeddings), written for both engines
_DOMAINS = {
    "wide": ("(o_totalprice / 999.0 - 250.0)", "({x} * 250.0)"),
    "small": ("(o_totalprice / 90000.0 - 2.75)", "({x} * 2.5)"),
    "unit": ("(o_totalprice / 300000.0 - 0.9)", "({x} * 0.9)"),
    "pos": ("(o_totalprice / 1000.0)", "(abs({x}) + 0.5)"),
    "ge1": ("(o_totalprice / 1000.0 + 1.0)", "(abs({x}) + 1.0)"),
}
_SECOND = ("(o_custkey + 1.0)", "(abs({y}) + 1.0)")


def _double_literals(sql: str) -> str:
    """Spark reads 250.0 as a decimal; 250.0D is its double literal."""
    import re

    return re.sub(r"(\d+\.\d+)", r"\1D", sql)


def _two_forms(t: Tables, fn, domain: str, binary: bool, boolean: bool):
    scalar, element = _DOMAINS[domain]
    x = F.expr(_double_literals(scalar))
    second = F.expr(_double_literals(_SECOND[0])).cast("double")
    value = fn(x, second) if binary else fn(x)
    value = value.cast("int").cast("double") if boolean else value.cast("double")
    rows = t.orders.select(
        F.lit("scalar").alias("form"),
        F.col("o_orderkey").alias("id"),
        F.round(value, 6).alias("y"),
    )
    v = V.doubles("embedding")
    ready = t.embeddings.select(
        "vec_id",
        F.transform(v, lambda e: F.abs(e) + 0.5 if domain == "pos" else _scaled(e, domain)).alias("v"),
        F.transform(F.reverse(v), lambda e: F.abs(e) + 1.0).alias("w"),
    )
    lifted = (
        E.over_arrays(fn)(F.col("v"), F.col("w")) if binary else E.over_array(fn)(F.col("v"))
    )
    if boolean:
        lifted = lifted.cast("array<int>")
    vectors = ready.select(
        F.lit("vector").alias("form"),
        F.col("vec_id").alias("id"),
        F.round(V.fingerprint(lifted), 6).alias("y"),
    )
    return rows.unionByName(vectors)


def _scaled(e, domain: str):
    factor = {"wide": 250.0, "small": 2.5, "unit": 0.9}.get(domain)
    return F.abs(e) + 1.0 if factor is None else e * factor


def _sql(expr: str, domain: str, boolean: bool) -> str:
    scalar, element = _DOMAINS[domain]
    cast = "::INT::DOUBLE" if boolean else "::DOUBLE"
    s = expr.format(x="x", y="y")
    return f"""
WITH s AS (SELECT o_orderkey AS id, {scalar}::DOUBLE AS x, {_SECOND[0]}::DOUBLE AS y FROM orders),
e0 AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS a, unnest(list_reverse(embedding))::DOUBLE AS b,
  generate_subscripts(embedding, 1) AS i FROM embeddings),
e AS (SELECT id, i, {element.format(x='a')}::DOUBLE AS x, {_SECOND[1].format(y='b')}::DOUBLE AS y FROM e0)
SELECT 'scalar' AS form, id, {r(f'({s}){cast}')} AS y FROM s
UNION ALL
SELECT 'vector', id, {r(f'sum(i * ({s}){cast})')} FROM e GROUP BY id"""


# name -> (function, SQL, domain, two operands)
_FUNCTIONS = {
    "ew_add": (lambda a, b: E.add(a, b, 0.25), "{x} + {y} + 0.25", "wide", True),
    "ew_sub": (E.sub, "{x} - {y}", "wide", True),
    "ew_mul": (E.mul, "{x} * {y}", "small", True),
    "ew_div": (
        lambda a, b: E.div(a, F.rint(b) - 1.0),
        "CASE WHEN round_even({y}, 0) - 1.0 = 0 THEN CASE WHEN {x} > 0 THEN 'inf'::DOUBLE WHEN {x} < 0 "
        "THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END ELSE {x} / (round_even({y}, 0) - 1.0) END",
        "wide",
        True,
    ),
    "ew_mod": (E.mod, "{x} % {y}", "pos", True),
    "ew_pow": (lambda a, b: E.power(a, E.div(1.0, b)), "pow({x}, 1.0 / {y})", "pos", True),
    "ew_maximum": (E.maximum, "greatest({x}, {y})", "wide", True),
    "ew_minimum": (E.minimum, "least({x}, {y})", "wide", True),
    "ew_neg": (E.neg, "-{x}", "wide", False),
    "ew_abs": (E.absolute, "abs({x})", "wide", False),
    "ew_sign": (E.sign, "sign({x})", "wide", False),
    "ew_square": (E.square, "{x} * {x}", "small", False),
    "ew_sqrt": (E.sqrt, "sqrt({x})", "pos", False),
    "ew_cbrt": (E.cbrt, "cbrt({x})", "wide", False),
    "ew_floor": (E.floor, "floor({x})", "wide", False),
    "ew_ceil": (E.ceil, "ceil({x})", "wide", False),
    "ew_round": (E.round_half_even, "round_even({x}, 0)", "wide", False),
    "ew_trunc": (E.trunc, "trunc({x})", "wide", False),
    "ew_exp": (E.exp, "exp({x})", "small", False),
    "ew_log": (E.ln, "ln({x})", "pos", False),
    "ew_log10": (E.log10, "log10({x})", "pos", False),
    "ew_log2": (E.log2, "log2({x})", "pos", False),
    "ew_sin": (E.sin, "sin({x})", "small", False),
    "ew_cos": (E.cos, "cos({x})", "small", False),
    "ew_tan": (E.tan, "tan({x})", "unit", False),
    "ew_asin": (E.asin, "asin({x})", "unit", False),
    "ew_acos": (E.acos, "acos({x})", "unit", False),
    "ew_atan": (E.atan, "atan({x})", "wide", False),
    "ew_sinh": (E.sinh, "sinh({x})", "small", False),
    "ew_cosh": (E.cosh, "cosh({x})", "small", False),
    "ew_tanh": (E.tanh, "tanh({x})", "small", False),
    "ew_asinh": (E.asinh, "asinh({x})", "wide", False),
    "ew_acosh": (E.acosh, "acosh({x})", "ge1", False),
    "ew_atanh": (E.atanh, "atanh({x})", "unit", False),
    "ew_degrees": (E.degrees, "degrees({x})", "small", False),
    "ew_radians": (E.radians, "radians({x})", "wide", False),
    "ew_clip": (lambda x: E.clip(x, -20.0, 35.5), "least(greatest({x}, -20.0), 35.5)", "wide", False),
    "act_relu": (A.relu, "greatest({x}, 0.0)", "small", False),
    "act_sigmoid": (A.sigmoid, "1.0 / (1.0 + exp(-{x}))", "small", False),
    "act_tanh": (A.tanh, "tanh({x})", "small", False),
    "act_softplus": (A.softplus, "ln(1.0 + exp({x}))", "small", False),
    "act_softsign": (A.softsign, "{x} / (1.0 + abs({x}))", "small", False),
    "act_leaky_relu": (A.leaky_relu, "CASE WHEN {x} > 0 THEN {x} ELSE 0.01 * {x} END", "small", False),
    "act_elu": (
        lambda x: A.elu(x, 1.5),
        "CASE WHEN {x} > 0 THEN {x} ELSE 1.5 * (exp({x}) - 1.0) END",
        "small",
        False,
    ),
    "act_selu": (
        A.selu,
        "1.0507009873554805::DOUBLE * CASE WHEN {x} > 0 THEN {x} "
        "ELSE 1.6732632423543772::DOUBLE * (exp({x}) - 1.0) END",
        "small",
        False,
    ),
    "act_gelu": (
        A.gelu,
        "0.5 * {x} * (1.0 + tanh(sqrt(2.0 / pi()) * ({x} + 0.044715 * {x} * {x} * {x})))",
        "small",
        False,
    ),
    "act_swish": (
        lambda x: A.swish(x, 1.25),
        "{x} / (1.0 + exp(-1.25 * {x}))",
        "small",
        False,
    ),
    "act_mish": (A.mish, "{x} * tanh(ln(1.0 + exp({x})))", "small", False),
    "act_prelu": (
        lambda x, c: A.prelu(x, 0.1 / c),
        "CASE WHEN {x} > 0 THEN {x} ELSE {x} * (0.1 / {y}) END",
        "small",
        True,
    ),
}

# results are booleans
_PREDICATES = {
    "ew_is_nan": (
        lambda x: E.is_nan(E.ln(F.floor(x))),
        "isnan(CASE WHEN floor({x}) > 0 THEN 1.0::DOUBLE WHEN floor({x}) = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END)",
        "small",
        False,
    ),
    "ew_is_inf": (
        lambda x: E.is_inf(E.ln(F.floor(x))),
        "isinf(CASE WHEN floor({x}) > 0 THEN 1.0::DOUBLE WHEN floor({x}) = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END)",
        "small",
        False,
    ),
    "cmp_eq": (lambda a, b: E.eq(F.floor(a), F.floor(b)), "floor({x}) = floor({y})", "pos", True),
    "cmp_neq": (lambda a, b: E.neq(F.floor(a), F.floor(b)), "floor({x}) <> floor({y})", "pos", True),
    "cmp_gt": (E.gt, "{x} > {y}", "pos", True),
    "cmp_gte": (E.gte, "{x} >= {y}", "pos", True),
    "cmp_lt": (E.lt, "{x} < {y}", "pos", True),
    "cmp_lte": (E.lte, "{x} <= {y}", "pos", True),
    "logical_and": (
        lambda a, b: E.logical_and(F.floor(a), F.floor(b) % 2),
        "floor({x}) <> 0 AND floor({y}) % 2 <> 0",
        "small",
        True,
    ),
    "logical_or": (
        lambda a, b: E.logical_or(F.floor(a), F.floor(b) % 2),
        "floor({x}) <> 0 OR floor({y}) % 2 <> 0",
        "small",
        True,
    ),
    "logical_xor": (
        lambda a, b: E.logical_xor(F.floor(a), F.floor(b) % 2),
        "(floor({x}) <> 0) <> (floor({y}) % 2 <> 0)",
        "small",
        True,
    ),
    "logical_not": (lambda x: E.logical_not(F.floor(x)), "NOT (floor({x}) <> 0)", "small", False),
}

for _table, _boolean in ((_FUNCTIONS, False), (_PREDICATES, True)):
    for _name, (_fn, _expr, _domain, _binary) in _table.items():
        register(
            _name,
            lambda t, fn=_fn, d=_domain, b=_binary, z=_boolean: _two_forms(t, fn, d, b, z),
            _sql(_expr, _domain, _boolean),
        )


def _erfinv_series(x: str, terms: int = 16) -> str:
    """The Maclaurin series of the inverse error function, for x up to one half."""
    c = [1.0]
    for k in range(1, terms):
        c.append(sum(c[m] * c[k - 1 - m] / ((m + 1) * (2 * m + 1)) for m in range(k)))
    z = f"(sqrt(pi()) / 2 * {x})"
    return " + ".join(f"{ck / (2 * k + 1)!r}::DOUBLE * pow({z}, {2 * k + 1})" for k, ck in enumerate(c))


def _erfinv(t: Tables):
    x = F.col("o_totalprice") / 1e6
    return t.orders.select(
        "o_orderkey", F.round(E.erfinv(x), 6).alias("y"), F.round(E.erfinv(-x), 6).alias("mirrored")
    )


register(
    "ew_erfinv",
    _erfinv,
    f"SELECT o_orderkey, {r('s')} AS y, {r('-s')} AS mirrored FROM (SELECT o_orderkey, {_erfinv_series('(o_totalprice / 1e6)')} AS s FROM orders)",
)
