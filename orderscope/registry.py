"""Query registry: name -> (Spark callable, oracle SQL).

Every entry binds an operator to the driver tables: ``fn(spark, sf_dir)``
returns a lazy DataFrame.  ``sql`` is the independent DuckDB oracle (or None
when the result is not SQL-expressible, e.g. k-means fitting or p-values).

Presentation rule shared by both sides: every ``double`` column is rounded
half-even at 6 dp (:func:`orderscope.functions.numeric.stable`).  The Spark
side rounds all double columns from the schema; the SQL side wraps the query
with ``SELECT * REPLACE`` for the declared ``doubles``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType

from .functions.numeric import stable
from .oracles import r6


@dataclass
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: list[str] = field(default_factory=list)
    group: str = ""

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return finish(self.fn(spark, sf_dir))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.doubles:
            return self.sql
        rep = ", ".join(f"{r6(c)} AS {c}" for c in self.doubles)
        return f"SELECT * REPLACE ({rep}) FROM (\n{self.sql}\n) _oracle"


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, doubles: list[str] | None = None,
             group: str = ""):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, list(doubles or []), group)
        return fn
    return deco


def finish(df: DataFrame) -> DataFrame:
    """Round every double column half-even at 6 dp (names and order unchanged)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, DoubleType):
            cols.append(stable(df[f.name]).alias(f.name))
        else:
            cols.append(df[f.name])
    return df.select(*cols)


def load_all() -> dict[str, Entry]:
    """Import every query module (they register themselves) and return the registry."""
    from . import queries  # noqa: F401
    return REGISTRY
