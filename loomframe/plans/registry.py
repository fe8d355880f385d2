"""Query registry: name -> (builder, SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# The six columns that together identify a lineitem row.
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
LINE_KEY_SQL = ", ".join(LINE_KEY)


class Tables:
    """Lazy access to the parquet tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


Builder = Callable[[Tables], DataFrame]
_QUERIES: dict[str, Builder] = {}
_SQL: dict[str, str] = {}


def register(name: str, build: Builder, sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"query {name} registered twice")
    _QUERIES[name] = build
    if sql is not None:
        _SQL[name] = sql.strip()


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def wrap(build: Builder) -> Builder:
        register(name, build, sql)
        return build

    return wrap


def _load_all() -> None:
    from loomframe.plans import catalog  # noqa: F401  (registers on import)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {
        name: (lambda spark, sf_dir, build=build: build(Tables(spark, sf_dir)))
        for name, build in _QUERIES.items()
    }


def all_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)


# SQL fragments ---------------------------------------------------------------
def r(expr: str, digits: int = 6) -> str:
    """Round for comparison, without negative zero."""
    rounded = f"round(({expr})::DOUBLE, {digits})"
    return f"(CASE WHEN {rounded} = 0 THEN 0.0::DOUBLE ELSE {rounded} END)"


def h(seed, *keys: str) -> str:
    """The keyed hash of loomframe.core.keyed in SQL."""
    text = " || ':' || ".join([f"'{seed}'", *[f"({k})::VARCHAR" for k in keys]])
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT)"


LONG_EMBEDDINGS = """(SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,
  generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"""
