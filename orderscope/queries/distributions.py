"""Histograms, box statistics, weekday AOV."""

from __future__ import annotations

from ..functions.dates import WEEKDAYS
from ..operators import distributions as Dist
from ..operators import trends as T
from ..oracles import D, lit, q_quantiles, with_base
from ..registry import register
from ..sources.sales import load_sales
from ._common import MONTH


def _k(keys, prefix=""):
    return "".join(f"{prefix}{k}, " for k in keys)


def _edge(i: str, bins: int) -> str:
    return f"(CASE WHEN {i} >= {bins} THEN hi ELSE {D(i)} * ((hi - lo) / {lit(bins)}) + lo END)"


def sql_histogram(rel: str, value: str, bins: int, keys: list[str], p: str = "h"):
    """CTEs computing numpy's equal-bin histogram; the final rows are in ``{p}_out``."""
    k = _k(keys)
    using = f"USING ({', '.join(keys)})" if keys else "ON TRUE"
    grp = f"GROUP BY {', '.join(keys)}" if keys else ""
    ctes = [
        (f"{p}_x", f"SELECT {k}{D(value)} AS v FROM {rel} WHERE {value} IS NOT NULL"),
        (f"{p}_r0", f"SELECT {k}min(v) AS lo0, max(v) AS hi0, count(*) AS total FROM {p}_x {grp}"),
        (f"{p}_r", f"SELECT {k}total, CASE WHEN lo0 = hi0 THEN lo0 - {lit(0.5)} ELSE lo0 END AS lo, "
                   f"CASE WHEN lo0 = hi0 THEN hi0 + {lit(0.5)} ELSE hi0 END AS hi FROM {p}_r0"),
        (f"{p}_i0", f"SELECT {k}v, lo, hi, CAST(trunc(((v - lo) / (hi - lo)) * {lit(bins)}) AS INTEGER) AS i0 "
                    f"FROM {p}_x JOIN {p}_r {using}"),
        (f"{p}_i1", f"SELECT {k}v, lo, hi, CASE WHEN i0 = {bins} THEN {bins - 1} ELSE i0 END AS i1 FROM {p}_i0"),
        (f"{p}_i2", f"SELECT {k}v, lo, hi, CASE WHEN v < {_edge('i1', bins)} THEN i1 - 1 ELSE i1 END AS i2 "
                    f"FROM {p}_i1"),
        (f"{p}_i3", f"SELECT {k}CASE WHEN v >= {_edge('i2 + 1', bins)} AND i2 != {bins - 1} THEN i2 + 1 "
                    f"ELSE i2 END AS bin FROM {p}_i2"),
        (f"{p}_c", f"SELECT {k}bin, count(*) AS cnt FROM {p}_i3 GROUP BY {k}bin"),
        (f"{p}_g", f"SELECT {k}lo, hi, total, CAST(unnest(range(0, {bins})) AS INTEGER) AS bin FROM {p}_r"),
        (f"{p}_out", f"SELECT {_k(keys, 'g.')}g.bin, {_edge('g.bin', bins)} AS bin_lo, "
                     f"{_edge('g.bin + 1', bins)} AS bin_hi, coalesce(c.cnt, 0) AS count, "
                     f"{D('coalesce(c.cnt, 0)')} / ({_edge('g.bin + 1', bins)} - {_edge('g.bin', bins)}) "
                     f"/ {D('g.total')} AS density "
                     f"FROM {p}_g g LEFT JOIN {p}_c c ON g.bin = c.bin"
                     + "".join(f" AND g.{x} = c.{x}" for x in keys)),
    ]
    return ctes


@register("revenue_histogram", group="distributions",
          doubles=["bin_lo", "bin_hi", "mean_revenue", "median_revenue"],
          sql=with_base(*sql_histogram("sales", "revenue", 60, []),
                        ("st", f"SELECT {D('sum(cents)')} / {D('count(*)')} / {lit(100.0)} AS mean_revenue FROM sales"),
                        ("md", q_quantiles("sales", "revenue", [0.5], [], ["median_revenue"], median=True)),
                        final="SELECT bin, bin_lo, bin_hi, count AS orders, mean_revenue, median_revenue "
                              "FROM h_out, st, md"))
def q_revenue_histogram(spark, sf):
    return Dist.revenue_histogram(load_sales(spark, sf))


@register("weekend_density", group="distributions", doubles=["bin_lo", "bin_hi", "density"],
          sql=with_base(("wk", "SELECT isodow(order_date) >= 6 AS is_weekend, revenue FROM sales"),
                        *sql_histogram("wk", "revenue", 50, ["is_weekend"]),
                        final="SELECT is_weekend, bin, bin_lo, bin_hi, count AS orders, density FROM h_out"))
def q_weekend_density(spark, sf):
    return Dist.weekend_density(load_sales(spark, sf))


def sql_box(rel: str, value: str, keys: list[str], p: str = "b", whis: float = 1.5):
    k = _k(keys)
    using = f"USING ({', '.join(keys)})"
    grp = f"GROUP BY {', '.join(keys)}"
    q = q_quantiles(rel, value, [0.25, 0.5, 0.75], keys, ["q1", "median", "q3"])
    return [
        (f"{p}_q", q),
        (f"{p}_n", f"SELECT {k}count(*) AS n FROM {rel} WHERE {value} IS NOT NULL {grp}"),
        (f"{p}_f", f"SELECT *, q3 - q1 AS iqr, q1 - {lit(whis)} * (q3 - q1) AS loval, "
                   f"q3 + {lit(whis)} * (q3 - q1) AS hival FROM {p}_q JOIN {p}_n {using}"),
        (f"{p}_j", f"SELECT {k}{D(value)} AS v, q1, median, q3, n, loval, hival FROM {rel} JOIN {p}_f {using} "
                   f"WHERE {value} IS NOT NULL"),
        (f"{p}_a", f"SELECT {k}max(CASE WHEN v <= hival THEN v END) AS hi_in, "
                   f"min(CASE WHEN v >= loval THEN v END) AS lo_in, any_value(q1) AS q1, "
                   f"any_value(median) AS median, any_value(q3) AS q3, any_value(n) AS n FROM {p}_j {grp}"),
        (f"{p}_w", f"SELECT *, CASE WHEN hi_in IS NULL OR hi_in < q3 THEN q3 ELSE hi_in END AS whisker_hi, "
                   f"CASE WHEN lo_in IS NULL OR lo_in > q1 THEN q1 ELSE lo_in END AS whisker_lo FROM {p}_a"),
        (f"{p}_o", f"SELECT {_k(keys, 'w.')}any_value(w.n) AS count, any_value(w.q1) AS q1, "
                   f"any_value(w.median) AS median, any_value(w.q3) AS q3, any_value(w.whisker_lo) AS whisker_lo, "
                   f"any_value(w.whisker_hi) AS whisker_hi, "
                   f"count(*) FILTER (WHERE j.v < w.whisker_lo OR j.v > w.whisker_hi) AS outliers "
                   f"FROM {p}_w w JOIN {p}_j j ON " + " AND ".join(f"w.{x} = j.{x}" for x in keys)
                   + f" GROUP BY {_k(keys, 'w.').rstrip(', ')}"),
    ]


_BOX = ["q1", "median", "q3", "whisker_lo", "whisker_hi"]


@register("category_boxplot", group="distributions", doubles=_BOX,
          sql=with_base(*sql_box("sales", "revenue", ["category"]),
                        final="SELECT *, CAST(row_number() OVER (ORDER BY median, category) AS INTEGER) AS median_rank FROM b_o"))
def q_category_boxplot(spark, sf):
    return Dist.category_boxplot(load_sales(spark, sf))


@register("q4_boxplot", group="distributions", doubles=_BOX,
          sql=with_base(("mq", f"SELECT quarter({MONTH}) = 4 AS is_q4, {D('sum(cents)')} / {lit(100.0)} AS revenue "
                               f"FROM sales GROUP BY {MONTH}"),
                        *sql_box("mq", "revenue", ["is_q4"]), final="SELECT * FROM b_o"))
def q_q4_boxplot(spark, sf):
    return Dist.q4_boxplot(T.monthly_sales(load_sales(spark, sf)))


_DAYS = " UNION ALL ".join(f"SELECT '{d}' AS day_of_week, {i} AS dow_index" for i, d in enumerate(WEEKDAYS))


@register("aov_by_weekday", group="distributions", doubles=["aov"], sql=with_base(
    ("days", _DAYS),
    ("g", "SELECT dayname(order_date) AS day_of_week, sum(cents) AS c, count(*) AS n FROM sales GROUP BY 1"),
    final=f"""SELECT d.day_of_week, CAST(d.dow_index AS INTEGER) AS dow_index,
       {D('g.c')} / {D('g.n')} / {lit(100.0)} AS aov FROM days d LEFT JOIN g ON d.day_of_week = g.day_of_week"""))
def q_aov_by_weekday(spark, sf):
    return Dist.aov_by_weekday(load_sales(spark, sf))
