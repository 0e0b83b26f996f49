"""RFM: recency / frequency / monetary per customer and 1–5 scores.

The per-customer table is one hash aggregation of ``sales`` keyed by
customer (partial aggregation absorbs a customer holding a third of all rows).
Scores compare each value with global quintile edges: a one-row table from
the distributed exact-quantile plan, broadcast (exactly one row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import money
from ..plans.quantiles import quantiles
from .quality import describe
from ..plans.scalars import attach_row
from ..session import checkpoint_dir


def rfm_base(sales: DataFrame) -> DataFrame:
    """Recency (days before the snapshot), frequency (orders), monetary (revenue).

    One aggregation of ``sales`` keyed by customer, written once with a
    reliable checkpoint (the shared folder); the snapshot is the latest of
    the customers' last dates, one value read from that copy, so ``sales`` is
    scanned once and every later branch (scores, scaling, centroids, profiles,
    labels) is a projection of the per-customer table.
    """
    per = sales.groupBy("customer_id").agg(F.max("order_date").alias("last"),
                                           F.count(F.lit(1)).alias("frequency"),
                                           F.sum("cents").alias("cents"))
    checkpoint_dir(sales.sparkSession)
    per = per.checkpoint(eager=True)
    # one value (a date) read from the written copy by a one-row job
    snap = per.agg(F.date_add(F.max("last"), 1)).first()[0]
    return per.select("customer_id", F.datediff(F.lit(snap), "last").alias("recency"), "frequency",
                      money("cents").alias("monetary"))


def customer_table(sales: DataFrame) -> DataFrame:
    """The per-customer RFM table (its aggregation is already written once by
    :func:`rfm_base`; the segment pipelines read it in many branches)."""
    return rfm_base(sales)


# pandas qcut(q=5) asks for np.linspace(0, 1, 6): note the 0.6000000000000001.
QUINTILE_PROBS = [i * 0.2 for i in range(5)] + [1.0]
EDGES = [f"e{i}" for i in range(6)]


def quintile_edges(df: DataFrame, values: list[str]) -> DataFrame:
    """Six quintile edges of each column in ``values``: ONE row, columns
    ``<value>_e0 .. <value>_e5`` (exact NumPy quantiles).

    All columns go through a single quantile plan grouped by metric name.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("x")) for v in values
    ])).alias("p")).select("p.*")
    q = quantiles(long, "x", QUINTILE_PROBS, ["metric"], out=EDGES)
    return q.agg(*[F.max(F.when(F.col("metric") == v, F.col(e))).alias(f"{v}_{e}")
                   for v in values for e in EDGES])


def _count_above(x: str, edges: list[str]) -> str:
    return "1 + " + " + ".join(f"(CASE WHEN {x} > {e} THEN 1 ELSE 0 END)" for e in edges)


def score_expr(value: str, edges: list[str], reverse: bool = False) -> tuple[Column, Column]:
    """Score and method of column ``value`` given its six edge columns.

    ``qcut`` when the six edges are distinct; otherwise ``cut`` with five
    equal-width bins (``linspace(min, max, 6)``), a constant column scoring 3.
    Bins are right-closed: score = 1 + number of inner edges below the value.
    Built as one SQL expression (a single call to the JVM).
    """
    x = f"CAST(`{value}` AS DOUBLE)"
    e = [f"`{c}`" for c in edges]
    distinct = " AND ".join(f"{e[i]} < {e[i + 1]}" for i in range(5))
    step = f"(({e[5]} - {e[0]}) / 5.0D)"
    cut_edges = [f"({float(i)}D * {step} + {e[0]})" for i in range(1, 5)]
    q = _count_above(x, e[1:5])
    c = f"CASE WHEN {e[0]} = {e[5]} THEN 3 ELSE {_count_above(x, cut_edges)} END"
    score = f"CASE WHEN {distinct} THEN {q} ELSE {c} END"
    if reverse:
        score = f"6 - ({score})"
    method = f"CASE WHEN {distinct} THEN 'qcut' ELSE 'cut' END"
    return F.expr(f"CAST({score} AS INT)"), F.expr(method)


def quintile_scores(df: DataFrame, specs: list[tuple[str, str, bool]],
                    method_cols: dict[str, str] | None = None) -> DataFrame:
    """Add one score column per ``(value, out, reverse)`` spec.

    The reference's ``quintile_score``; edges of every value come from ``df``
    itself in one plan, joined as a single broadcast row.
    """
    method_cols = method_cols or {}
    values = [v for v, _, _ in specs]
    edges = quintile_edges(df, values)
    j = attach_row(df, edges)  # exactly one row
    cols = [F.col(c) for c in df.columns]
    for v, out, rev in specs:  # one projection (each withColumn would re-analyse the plan)
        s, m = score_expr(v, [f"{v}_{e}" for e in EDGES], rev)
        cols.append(s.alias(out))
        if v in method_cols:
            cols.append(m.alias(method_cols[v]))
    return j.select(*cols)


def quintile_score(df: DataFrame, value: str, out: str, reverse: bool = False,
                   method_col: str | None = None) -> DataFrame:
    return quintile_scores(df, [(value, out, reverse)], {value: method_col} if method_col else None)


def rfm_scores(rfm: DataFrame) -> DataFrame:
    """G3 + G5: R (reversed), F, M scores, ``rfm_score = 100R+10F+M`` and ``rfm_total``."""
    s = quintile_scores(rfm, [("recency", "r", True), ("frequency", "f", False), ("monetary", "m", False)])
    return s.withColumns({
        "rfm_score": F.col("r") * 100 + F.col("f") * 10 + F.col("m"),
        "rfm_total": F.col("r") + F.col("f") + F.col("m"),
    })


def urgent_orders(sales: DataFrame, channel: str) -> DataFrame:
    """Distinct orders per customer placed through ``channel`` (0 when none).

    A heavily tied column: it drives the equal-width fallback of G4.
    """
    o = F.when(F.col("channel") == F.lit(channel), F.expr("order_id div 10"))
    out = sales.groupBy("customer_id").agg(F.countDistinct(o).alias("urgent_orders"))
    checkpoint_dir(sales.sparkSession)
    return out.checkpoint(eager=True)  # the edges and the scores both read it


RFM_DESCRIBE_COLS = ["recency", "frequency", "monetary", "r", "f", "m", "rfm_total"]


def rfm_describe(scores: DataFrame) -> DataFrame:
    """``describe().round(2)`` of the RFM columns."""
    return describe(scores, RFM_DESCRIBE_COLS, {"monetary": 100})
