"""The registry: `query` registers a function of (spark, sf_dir), `sql` builds its oracle from named parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crossgrain.functions.columns import rounded
from crossgrain.sources import proxy

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
_BODIES: dict[str, tuple[str, str, str]] = {}
#: name -> (names it needs, body) of the parts that oracles share.
PARTS: dict[str, tuple[str, str]] = dict(proxy.SQL)


def part(name: str, needs: str, body: str) -> None:
    """A body that begins with ! is worked out once, as one that a recursion reads at every step must be."""
    if name in PARTS:
        raise ValueError(f"two parts named {name}")
    PARTS[name] = (needs, body)


def sql(needs: str, body: str, columns: str) -> str:
    """A statement over the parts in `needs`. columns: names of the result, a ~ before those to round."""
    found: dict[str, str] = {}

    def add(names: str) -> None:
        for n in names.split():
            if n not in found:
                add(PARTS[n][0])
                found[n] = PARTS[n][1]

    add(needs)
    found["out"] = body
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({b[1:]})" if b[0] == "!" else f"{n} AS ({b})" for n, b in found.items())
    shown = ", ".join(f"round({c[1:]}, 6) + 0.0 AS {c[1:]}" if c[0] == "~" else c for c in columns.split())
    return f"WITH RECURSIVE {ctes}\nSELECT {shown} FROM out"


def query(name: str, needs: str = "", body: str = "", columns: str = "") -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if body:
            _BODIES[name] = (needs, body, columns)
        return f

    return register


def oracle_sql() -> dict[str, str]:
    """The statements of all registered queries that have one."""
    return {name: sql(*x) for name, x in _BODIES.items()}
