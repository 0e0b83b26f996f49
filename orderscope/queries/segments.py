"""Scaled features, k-means (rows-only) and the segment reports.

The reports are checked by SQL on the deterministic seed-centroid assignment
(H5); the k-means fits feed the same operators (``*_kmeans`` keys, rows-only).
"""

from __future__ import annotations

from ..operators import segments as G
from ..operators.silhouette import silhouette_bounds
from ..oracles import D, H, exact_double, lit, rhe, with_base
from ..registry import register
from .rfm import SCORES_CTES, customers, rfm_scores_df

_F = G.FEATURES
_S = G.SCALE


N = "n"


def _sq(x):
    return f"({x}) * ({x})"


SCALED_CTES = [
    ("iv", "SELECT customer_id, CAST(recency AS BIGINT) AS i_recency, CAST(frequency AS BIGINT) AS i_frequency, "
           "CAST(round_even(monetary * 100.0::DOUBLE, 0) AS BIGINT) AS i_monetary FROM rfm"),
    ("st0", "SELECT count(*) AS n, " + ", ".join(f"sum(i_{c}) AS s_{c}, sum({H(f'i_{c}')} * i_{c}) AS ss_{c}"
                                                 for c in _F) + " FROM iv"),
    ("st", "SELECT " + ", ".join(
        f"{D(f's_{c}')} / {D('n')} / {lit(_S[c])} AS mean_{c}, "
        f"sqrt({exact_double(f'{H(N)} * ss_{c} - {H(f's_{c}')} * {H(f's_{c}')}')} / ({D('n')} * {D('n')}) "
        f"/ {lit(_S[c] * _S[c])}) AS std_{c}" for c in _F) + " FROM st0"),
    ("sz", "SELECT customer_id, " + ", ".join(
        f"({D(f'i_{c}')} / {lit(_S[c])} - mean_{c}) / std_{c} AS {c}_z" for c in _F) + " FROM iv, st"),
]
SEED_CTES = [
    ("cb", "SELECT CAST(least(3, (s.rfm_total - 3) // 3) AS INTEGER) AS cluster, count(*) AS nb, "
           + ", ".join(f"sum(i.i_{c}) AS b_{c}" for c in _F)
           + " FROM iv i JOIN scores s ON i.customer_id = s.customer_id GROUP BY 1"),
    ("cen", "SELECT cluster, " + ", ".join(
        f"({D(f'b_{c}')} / {D('nb')} / {lit(_S[c])} - mean_{c}) / std_{c} AS {c}_z" for c in _F) + " FROM cb, st"),
    ("asg", "SELECT s.customer_id, " + ", ".join(f"s.{c}_z" for c in _F) + ", c.cluster FROM sz s, cen c "
            "QUALIFY row_number() OVER (PARTITION BY s.customer_id ORDER BY "
            + " + ".join(_sq(f"c.{c}_z - s.{c}_z") for c in _F) + ", c.cluster) = 1"),
]
#: Profiles, labels and segments of any assignment ``asg``.
REPORT_CTES = [
    ("prof0", "SELECT a.cluster, count(*) AS customers, "
              f"{D('sum(i.i_recency)')} / {D('count(*)')} AS recency, "
              f"{D('sum(i.i_frequency)')} / {D('count(*)')} AS frequency, "
              f"{D('sum(i.i_monetary)')} / {D('count(*)')} / {lit(100.0)} AS monetary "
              "FROM iv i JOIN asg a ON i.customer_id = a.customer_id GROUP BY a.cluster"),
    ("prof", f"SELECT *, {lit(G.W_RECENCY)} * recency + frequency * {lit(G.W_FREQUENCY)} "
             f"+ monetary * {lit(G.W_MONETARY)} AS composite FROM prof0"),
    ("lab0", "SELECT cluster, composite, CAST(row_number() OVER (ORDER BY composite, cluster) AS INTEGER) AS rank, "
             "count(*) OVER () AS k FROM prof"),
    ("lab", f"SELECT cluster, composite, rank, CASE WHEN rank = k THEN '{G.SEGMENTS[0]}' "
            f"WHEN rank = k - 1 THEN '{G.SEGMENTS[1]}' WHEN rank = 1 THEN '{G.SEGMENTS[3]}' "
            f"WHEN rank = 2 THEN '{G.SEGMENTS[2]}' END AS segment FROM lab0"),
    ("cseg", "SELECT a.customer_id, a.cluster, l.segment FROM asg a JOIN lab l ON a.cluster = l.cluster"),
    ("seg", "SELECT r.*, c.cluster, c.segment FROM rfm r JOIN cseg c ON r.customer_id = c.customer_id"),
    ("ord", " UNION ALL ".join(f"SELECT '{s}' AS segment, {i + 1} AS seg_order" for i, s in enumerate(G.SEGMENTS))),
]
SEG_CTES = SCORES_CTES + SCALED_CTES + SEED_CTES + REPORT_CTES
ZD = [f"{c}_z" for c in _F]


def _assigned(spark, sf):
    """The scored customers with their cluster by the seed centroids."""
    return G.assigned_by_seeds(rfm_scores_df(spark, sf))


def _seg(spark, sf):
    return G.segmented(_assigned(spark, sf))


@register("rfm_scaled", group="segments", doubles=ZD, sql=with_base(*SEG_CTES, final="SELECT * FROM sz"))
def q_rfm_scaled(spark, sf):
    return G.rfm_scaled(customers(spark, sf))


@register("assign_centroids", group="segments", doubles=ZD, sql=with_base(*SEG_CTES, final="SELECT * FROM asg"))
def q_assign_centroids(spark, sf):
    return _assigned(spark, sf).select("customer_id", *ZD, "cluster")


@register("cluster_profile", group="segments", doubles=["recency", "frequency", "monetary", "composite"],
          sql=with_base(*SEG_CTES, final="SELECT * FROM prof"))
def q_cluster_profile(spark, sf):
    return G.cluster_profile(_assigned(spark, sf))


@register("segment_labels", group="segments", doubles=["composite"],
          sql=with_base(*SEG_CTES, final="SELECT cluster, composite, rank, segment FROM lab"))
def q_segment_labels(spark, sf):
    return G.segment_labels(G.cluster_profile(_assigned(spark, sf)))


@register("customer_segments", group="segments", sql=with_base(*SEG_CTES, final="SELECT * FROM cseg"))
def q_customer_segments(spark, sf):
    found = _assigned(spark, sf)
    return G.customer_segments(found, G.segment_labels(G.cluster_profile(found)))


_CELL = ", ".join(f"greatest(-16, least(16, floor({z} / {lit(0.25)})))" for z in ZD)
_CELL_D = " + ".join(_sq(f"a.{z} - c.{z}") for z in ZD)
_SIL = "CASE WHEN size = 1 OR {a} = {b} THEN 0.0::DOUBLE ELSE ({b} - {a}) / greatest({a}, {b}) END"


@register("silhouette_euclidean", group="segments", doubles=["silhouette_low", "silhouette_high"], sql=with_base(
    *SEG_CTES,
    ("ce", f"SELECT cluster, count(*) AS n, {', '.join(f'avg({z}) AS {z}' for z in ZD)}, "
           f"{' + '.join(f'var_pop({z})' for z in ZD)} AS v FROM asg GROUP BY cluster, {_CELL}"),
    ("cd", f"SELECT a.customer_id, a.cluster = c.cluster AS own, c.cluster, sum(n) AS size, sum(n * sqrt({_CELL_D})) AS lo, "
           f"sum(n * sqrt({_CELL_D} + v)) AS hi FROM asg a, ce c GROUP BY a.customer_id, a.cluster, c.cluster"),
    ("cs", "SELECT customer_id, max(size) FILTER (own) AS size, max(lo / greatest(size - 1, 1)) FILTER (own) AS al, "
           "max(hi / greatest(size - 1, 1)) FILTER (own) AS ah, min(lo / size) FILTER (NOT own) AS bl, "
           "min(hi / size) FILTER (NOT own) AS bh FROM cd GROUP BY customer_id"),
    final="SELECT count(*) AS customers, (SELECT count(DISTINCT cluster) FROM asg) AS clusters, "
          f"avg({_SIL.format(a='ah', b='bl')}) AS silhouette_low, avg({_SIL.format(a='al', b='bh')}) AS silhouette_high FROM cs"))
def q_silhouette_euclidean(spark, sf):
    return silhouette_bounds(_assigned(spark, sf))


_SUMMARY = ["avg_recency", "avg_frequency", "avg_monetary", "total_revenue", "revenue_share"]


def summary_sql(src: str = "seg") -> str:
    n = D("count(*)")
    sr, sf_ = D(f"sum({H('recency')})"), D(f"sum({H('frequency')})")
    return (f"SELECT segment, count(*) AS customers, "
            f"{rhe(f'{sr} / {n}', 1)} AS avg_recency, "
            f"{rhe(f'{sf_} / {n}', 1)} AS avg_frequency, "
            f"{rhe(f'{D(_SC)} / {n} / {lit(100.0)}', 1)} AS avg_monetary, "
            f"{rhe(f'{D(_SC)} / {lit(100.0)}', 1)} AS total_revenue, "
            f"{rhe(f'{D(_SC)} / {D(f'sum({_SC}) OVER ()')} * {lit(100.0)}', 1)} AS revenue_share "
            f"FROM {src} GROUP BY segment")


_SC = "sum(CAST(round_even(monetary * 100.0::DOUBLE, 0) AS BIGINT))"
_SF = "sum(CAST(frequency AS BIGINT))"


@register("segment_summary", group="segments", doubles=_SUMMARY,
          sql=with_base(*SEG_CTES, final=summary_sql()))
def q_segment_summary(spark, sf):
    return G.segment_summary(_seg(spark, sf))


@register("segment_counts", group="segments", doubles=["pct"], sql=with_base(
    *SEG_CTES, ("sc", "SELECT segment, count(*) AS customers FROM seg GROUP BY segment"),
    final=f"SELECT o.segment, CAST(o.seg_order AS INTEGER) AS seg_order, s.customers, "
          f"{D('s.customers')} / {D('sum(s.customers) OVER ()')} * {lit(100.0)} AS pct "
          f"FROM ord o LEFT JOIN sc s ON o.segment = s.segment"))
def q_segment_counts(spark, sf):
    return G.segment_counts(_seg(spark, sf))


@register("segment_revenue", group="segments", doubles=["revenue"], sql=with_base(
    *SEG_CTES, ("sr", f"SELECT segment, {D(_SC)} / {lit(100.0)} AS revenue FROM seg GROUP BY segment"),
    final="SELECT o.segment, CAST(o.seg_order AS INTEGER) AS seg_order, s.revenue "
          "FROM ord o LEFT JOIN sr s ON o.segment = s.segment"))
def q_segment_revenue(spark, sf):
    return G.segment_revenue(_seg(spark, sf))


@register("segment_treemap", group="segments", doubles=["total", "avg_ltv", "avg_freq"], sql=with_base(
    *SEG_CTES, final=f"SELECT segment, count(*) AS customers, {D(_SC)} / {lit(100.0)} AS total, "
                     f"{D(_SC)} / {D('count(*)')} / {lit(100.0)} AS avg_ltv, "
                     f"{D(_SF)} / {D('count(*)')} AS avg_freq FROM seg GROUP BY segment"))
def q_segment_treemap(spark, sf):
    return G.segment_treemap(_seg(spark, sf))


SEGMENT_FILTER = G.SEGMENTS[0]


@register("segment_customers", group="segments", doubles=["monetary"], sql=with_base(
    *SEG_CTES, final=f"SELECT customer_id, frequency, monetary, recency, segment FROM seg "
                     f"WHERE segment = '{SEGMENT_FILTER}'"))
def q_segment_customers(spark, sf):
    return G.segment_customers(_seg(spark, sf), SEGMENT_FILTER)


@register("segment_customers_all", group="segments", doubles=["monetary"], sql=with_base(
    *SEG_CTES, final="SELECT customer_id, frequency, monetary, recency, segment FROM seg"))
def q_segment_customers_all(spark, sf):
    return G.segment_customers(_seg(spark, sf))


