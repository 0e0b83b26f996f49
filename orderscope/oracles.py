"""Independent DuckDB SQL for every SQL-expressible query (the correctness oracle).

The SQL is written from the operator *definitions* (SURVEY §1.5), not from the
Spark plans: duplicates are removed after the joins with ``row_number``,
quantiles come from ranked rows, and so on.  Shared pieces:

* :data:`BASE` — ``raw`` (joined lines), ``dirty`` (the test view), their
  cleaned forms ``sales`` / ``dirty_clean`` and helpers.
* :func:`q_quantiles` — NumPy-exact quantiles by ``row_number``.

Conventions: money is summed as integer cents; every double that is not a
plain ``cents / 100`` is rounded with :func:`r6` (half-even at 6 dp, the same
arithmetic as ``functions.numeric.stable``).
"""

from __future__ import annotations

from collections.abc import Sequence


def D(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def lit(p: float) -> str:
    return f"CAST({float(p)!r} AS DOUBLE)"


def rhe(x: str, digits: int) -> str:
    """``rint(x * 10^d) / 10^d`` in DuckDB."""
    s = lit(float(10 ** digits))
    return f"(round_even(({x}) * {s}, 0) / {s})"


def r6(x: str) -> str:
    return rhe(x, 6)


def money(cents: str) -> str:
    return f"({D(cents)} / {lit(100.0)})"


def exact_double(x: str) -> str:
    """Correctly rounded double of an exact integer (same split as the Spark side)."""
    a = f"abs(CAST({x} AS HUGEINT))"
    return (f"(CASE WHEN CAST({x} AS HUGEINT) < 0 THEN -1 ELSE 1 END * "
            f"(CAST(({a} - {a} % 4294967296) // 4294967296 AS DOUBLE) * {lit(4294967296.0)} "
            f"+ CAST({a} % 4294967296 AS DOUBLE)))")


def H(x: str) -> str:
    return f"CAST({x} AS HUGEINT)"


def ratio(num: str, den: str) -> str:
    return f"({D(num)} / NULLIF({D(den)}, {lit(0.0)}))"


def lerp(a: str, b: str, t: str) -> str:
    return (f"(CASE WHEN {t} >= {lit(0.5)} THEN {b} - ({b} - {a}) * ({lit(1.0)} - {t}) "
            f"ELSE {a} + ({b} - {a}) * {t} END)")


def q_quantiles(rel: str, value: str, probs: Sequence[float], by: Sequence[str] = (),
                out: Sequence[str] | None = None, median: bool = False) -> str:
    """SELECT by..., out... : exact NumPy quantiles (or np.median) of ``value`` over ``rel``."""
    out = list(out) if out else [f"q{i}" for i in range(len(probs))]
    keys = list(by)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    kcols = ", ".join(keys) + (", " if keys else "")
    ranked = (f"SELECT {kcols}{D(value)} AS v, "
              f"row_number() OVER ({part} ORDER BY {value}) - 1 AS rk, "
              f"count(*) OVER ({part}) AS n FROM {rel} WHERE {value} IS NOT NULL")
    sel, aggs, outs = [], [], []
    for i, p in enumerate(probs):
        if median:
            k0 = f"CAST(floor({D('n - 1')} / {lit(2.0)}) AS BIGINT)"
            k1 = f"CAST(ceil({D('n - 1')} / {lit(2.0)}) AS BIGINT)"
            t = lit(0.5)
        else:
            pos = f"({D('n - 1')} * {lit(p)})"
            last = f"{pos} >= {D('n - 1')}"
            k0 = f"(CASE WHEN {last} THEN n - 1 ELSE CAST(floor({pos}) AS BIGINT) END)"
            k1 = f"(CASE WHEN {last} THEN n - 1 ELSE CAST(floor({pos}) AS BIGINT) + 1 END)"
            t = f"({pos} - CASE WHEN {last} THEN {lit(-1.0)} ELSE floor({pos}) END)"
        sel.append(f"{k0} AS k0_{i}, {k1} AS k1_{i}, {t} AS t_{i}")
        aggs.append(f"max(CASE WHEN rk = k0_{i} THEN v END) AS a_{i}, "
                    f"max(CASE WHEN rk = k1_{i} THEN v END) AS b_{i}, max(t_{i}) AS t_{i}")
        if median:
            outs.append(f"(a_{i} + b_{i}) / {lit(2.0)} AS {out[i]}")
        else:
            outs.append(f"{lerp(f'a_{i}', f'b_{i}', f't_{i}')} AS {out[i]}")
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return (f"SELECT {kcols}{', '.join(outs)} FROM ("
            f"SELECT {kcols}{', '.join(aggs)} FROM ("
            f"SELECT *, {', '.join(sel)} FROM ({ranked}) _r) _k {group}) _a")


TIEBREAK = "tb_shipdate, tb_partkey, tb_suppkey, tb_quantity, tb_extendedprice"
FACT = "order_id, customer_id, order_date, category, product, quantity, unit_price, region, channel"


def _clean(src: str, name: str) -> str:
    """CTEs ``{name}_dd``, ``{name}_med``, ``{name}`` = cleaned ``src``."""
    med = q_quantiles(f"{name}_dd", "unit_price", [0.5], ["category"], ["median_price"], median=True)
    cents = f"CAST(round_even(unit_price * {D('quantity')} * {lit(100.0)}, 0) AS BIGINT)"
    return (
        f"{name}_dd AS (SELECT * FROM {src} QUALIFY row_number() OVER "
        f"(PARTITION BY order_id ORDER BY {TIEBREAK}) = 1),\n"
        f"{name}_med AS ({med}),\n"
        f"{name}_imp AS (SELECT d.order_id, d.customer_id, d.order_date, d.category, d.product, "
        f"d.quantity, COALESCE(d.unit_price, m.median_price) AS unit_price, d.region, d.channel "
        f"FROM {name}_dd d LEFT JOIN {name}_med m ON d.category = m.category),\n"
        f"{name}_c AS (SELECT *, {cents} AS cents FROM {name}_imp),\n"
        f"{name} AS (SELECT *, {money('cents')} AS revenue FROM {name}_c WHERE cents > 0)"
    )


_RAW_CENTS = f"CAST(round_even(unit_price * {D('quantity')} * {lit(100.0)}, 0) AS BIGINT)"

BASE = f"""
raw0 AS (
  SELECT CAST(l.l_orderkey * 10 + l.l_linenumber AS BIGINT) AS order_id,
         CAST(o.o_custkey AS BIGINT) AS customer_id,
         CAST(o.o_orderdate AS DATE) AS order_date,
         p.p_type AS category, p.p_name AS product,
         CAST(trunc(l.l_quantity) AS INTEGER) AS quantity,
         {D('p.p_retailprice')} AS unit_price,
         r.r_name AS region, o.o_orderpriority AS channel,
         l.l_shipdate AS tb_shipdate, l.l_partkey AS tb_partkey, l.l_suppkey AS tb_suppkey,
         l.l_quantity AS tb_quantity, l.l_extendedprice AS tb_extendedprice
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey),
raw AS (SELECT *, {money(_RAW_CENTS)} AS revenue FROM raw0),
dirty0 AS (
  SELECT order_id, customer_id, order_date, category, product,
         CASE WHEN order_id % 997 = 0 THEN 0 ELSE quantity END AS quantity,
         CASE WHEN order_id % 250 = 3 THEN CAST(NULL AS DOUBLE) ELSE unit_price END AS unit_price,
         region, channel, {TIEBREAK}
  FROM raw0),
dirty AS (SELECT *, {money(_RAW_CENTS)} AS revenue FROM dirty0),
{_clean('raw0', 'sales')},
{_clean('dirty0', 'dclean')}
"""


def with_base(*ctes: tuple[str, str], final: str) -> str:
    """``WITH <base>, <ctes...> <final>``."""
    extra = "".join(f",\n{name} AS ({body})" for name, body in ctes)
    return f"WITH {BASE.strip()}{extra}\n{final}"
