"""Every query of the entity-resolution engine with its DuckDB counterpart.

QUERIES maps a name to (spark, sf_dir) -> DataFrame; ORACLES to the same relation in DuckDB's SQL. Spark's side reads the
tables that erloom.sources.store has made once; the other side builds them in each query from the definitions."""

from __future__ import annotations

from collections.abc import Callable

from erloom.sources import store
from erloom.sources.fixtures import registry, texts

from . import oracle
from .dialect import Duck, Spark

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def opened(spark, sf_dir: str) -> Spark:
    return Spark(sf_dir, store.of(spark, sf_dir))


def dual(build: Callable[[Spark], str]) -> Callable[[Spark], str]:
    """Register a query that both engines run from one text."""
    name = build.__name__
    QUERIES[name] = lambda spark, sf_dir: spark.sql(build(opened(spark, sf_dir)))
    ORACLES[name] = build(Duck())
    return build


def query(sql: str | None = None) -> Callable:
    """Register a query of DataFrames with its DuckDB SQL, if there is any."""

    def add(run: Callable) -> Callable:
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def with_(d: Spark, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def blocked(d: Spark) -> str:
    """All expressions from texts to `cand`."""
    base = [registry(d), texts(d, "st", "s1"), texts(d, "qt", "q")]
    if d.store:
        return ",\n".join([*base, d.store.cte("cand")])
    return ",\n".join([*base, oracle.keys("sk", "st"), oracle.keys("qk", "qt"), oracle.index("ix", "sk", "s1"), oracle.candidates("cand", "qk", "ix")])


def scored(d: Spark) -> str:
    """Pairs with a probability from key arithmetic, so that decision rules need no trained model."""
    return f"{blocked(d)},\nscored AS (SELECT rid, s1, score, rk, cast(((rid * 7919 + s1 * 104729) % 1000) as double) / 1000 AS p FROM cand)"


def _load() -> None:
    from . import baseline, catalog, decisions, fuzzy, linkage, rescue  # noqa: F401


_load()
