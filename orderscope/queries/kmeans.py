"""H2–H13 and L1–L2 on k-means clusters.

The SQL repeats the fit itself: k-means++ draws by MD5 and Lloyd's passes as recursive
CTEs over all customers, means from integer sums.  The reports then are the SQL of the
other segment keys over this assignment.
"""

from __future__ import annotations

from ..operators import kmeans as M
from ..operators import kpis as L
from ..operators import segments as G
from ..operators.silhouette import silhouette_bounds
from ..oracles import D, lit, with_base
from ..registry import REGISTRY, register
from ..sources.sales import ROLES, derived, load_sales
from . import kpis as _  # noqa: F401  (registers the keys whose SQL is reused here)
from .rfm import RFM_CTE, customers
from .segments import SCALED_CTES, SEED_CTES

N_INIT = 10
# Bump when a fit computes something else, so published ones are not reused.
VERSION = 3
KS = range(2, 9)

_Z = ["recency_z", "frequency_z", "monetary_z"]


def _dist(c: str, x: str = "") -> str:
    return " + ".join(f"({c}.{z} - {x}{z}) * ({c}.{z} - {x}{z})" for z in _Z)


_PICK = "{'recency_z': recency_z, 'frequency_z': frequency_z, 'monetary_z': monetary_z}"
_U = "((('0x' || md5(concat_ws('-', customer_id, s, {j}))[1:13])::BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE"


def fit_ctes(ks, n_init: int) -> list[tuple[str, str]]:
    """``km``: the best model of each k as (k, cs, cost), from the points ``kp``."""
    most = max(ks)
    return [
        ("kp", "SELECT sz.*, i_recency, i_frequency, i_monetary FROM sz JOIN iv USING (customer_id)"),
        # the centres of each start, one more in each step
        ("sd", f"""SELECT s, 0 AS j, [arg_min({_PICK}, {{'u': {_U.format(j='0')}, 'id': customer_id}})] AS cs
  FROM kp, (SELECT unnest(range({n_init})) AS s) GROUP BY s
  UNION ALL
  SELECT s, j + 1, list_append(any_value(cs), arg_min({_PICK}, {{'u': -ln({_U.format(j='j + 1')}) / d, 'id': customer_id}}))
  FROM (SELECT s, j, cs, kp.*, list_min(list_transform(cs, lambda c: {_dist('c', 'kp.')})) AS d FROM sd, kp WHERE j + 1 < {most})
  WHERE d > 0 GROUP BY s, j"""),
        ("st1", f"SELECT s, arg_max(cs, j) AS cs FROM sd GROUP BY s"),
        ("ll0", f"SELECT k, s, cs[1:k] AS cs FROM st1, (SELECT unnest({list(ks)}) AS k)"),
        *_lloyd_ctes("ll", "ll0", "1e-4"),
        ("best", "SELECT k, s, cs FROM ll_cost QUALIFY row_number() OVER (PARTITION BY k ORDER BY round_even(cost, 6), s) = 1"),
        *_lloyd_ctes("lb", "best", "0"),
        ("km", "SELECT k, cs, cost FROM lb_cost"),
    ]


def _lloyd_ctes(name: str, models: str, tol: str) -> list[tuple[str, str]]:
    """Lloyd's passes of the models (k, s, cs) until they move by at most ``tol``, and ``<name>_cost``."""
    new = ", ".join(f"'{c}_z': ({D(f'h.{c}')} / {D('h.n')} / {lit(G.SCALE[c])} - st.mean_{c}) / "
                    f"(CASE WHEN st.std_{c} = 0 THEN 1.0::DOUBLE ELSE st.std_{c} END)" for c in G.FEATURES)
    moved = " + ".join(f"(o.{z} - cs2[i].{z}) * (o.{z} - cs2[i].{z})" for z in _Z)
    return [
        (name, f"""SELECT k, s, 0 AS it, cs, false AS done FROM {models}
  UNION ALL
  SELECT k, s, it + 1, cs2, list_sum(list_transform(cs, lambda o, i: {moved})) <= {tol} FROM (
    SELECT k, s, it, cs, list_transform(cs, lambda o, i: coalesce(list_filter(hs, lambda h: h.c = i)[1].z, o)) AS cs2 FROM (
      SELECT k, s, it, any_value(cs) AS cs, list({{'c': c, 'z': {{{new}}}}}) AS hs FROM (
        SELECT k, s, it, any_value(cs) AS cs, c, count(*) AS n, sum(i_recency) AS recency, sum(i_frequency) AS frequency,
               sum(i_monetary) AS monetary
        FROM (SELECT k, s, it, cs, i_recency, i_frequency, i_monetary,
                     list_min(list_transform(cs, lambda o, i: {{'d': {_dist('o', 'kp.')}, 'i': i}})).i AS c
              FROM {name}, kp WHERE NOT done AND it < 300)
        GROUP BY k, s, it, c) h, st
      GROUP BY k, s, it))"""),
        (f"{name}_cost", f"SELECT k, s, any_value(cs) AS cs, sum(list_min(list_transform(cs, lambda o: {_dist('o', 'kp.')}))) AS cost "
                         f"FROM (SELECT k, s, arg_max(cs, it) AS cs FROM {name} GROUP BY k, s), kp GROUP BY k, s"),
    ]


def assigned_ctes(rel: str = "km") -> list[tuple[str, str]]:
    """``ka``: each customer's cluster in every model of ``rel``."""
    return [("ka", f"SELECT k, customer_id, recency_z, frequency_z, monetary_z, CAST(list_min(list_transform(cs, lambda o, i: "
                   f"{{'d': {_dist('o', 'kp.')}, 'i': i}})).i - 1 AS INTEGER) AS cluster FROM {rel}, kp")]


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1).replace("kp AS (", "kp AS MATERIALIZED (")


FOUR_CTES = [*fit_ctes([4], N_INIT), *assigned_ctes(),
             ("asg", "SELECT customer_id, recency_z, frequency_z, monetary_z, cluster FROM ka")]
_SWEEP = [RFM_CTE, *SCALED_CTES, *fit_ctes(KS, N_INIT)]


def _chain(ctes) -> str:
    return "".join(f",\n{name} AS ({body})" for name, body in ctes)


def on_clusters(name: str) -> str:
    """The SQL of a segment key over the k-means clusters."""
    sql = REGISTRY[name].sql
    swapped = sql.replace(_chain(SEED_CTES), _chain(FOUR_CTES))
    assert swapped != sql
    return recursive(swapped)


# --- Spark side: fits are made once per snapshot of sales and shared ---

def _assigned(spark, sf):
    return derived(spark, sf, f"clusters-{VERSION}-{N_INIT}", lambda _: M.kmeans_assigned(customers(spark, sf), 4, N_INIT))


def _sweep(spark, sf):
    return derived(spark, sf, f"sweep-{VERSION}-{N_INIT}", lambda _: M.kmeans_sweep(customers(spark, sf), KS, N_INIT))


def _segments(spark, sf):
    return G.segmented(_assigned(spark, sf))


@register("kmeans_elbow", group="kmeans", doubles=["inertia"], sql=recursive(with_base(
    *_SWEEP, final="SELECT CAST(k AS INTEGER) AS k, cost AS inertia FROM km")))
def q_kmeans_elbow(spark, sf):
    return _sweep(spark, sf).select("k", "inertia")


_NORM = " + ".join(f"{z} * {z}" for z in _Z)


@register("kmeans_silhouette", group="kmeans", doubles=["silhouette"], sql=recursive(with_base(
    *_SWEEP, *assigned_ctes(),
    ("kc", f"SELECT k, cluster, count(*) AS n, sum({_NORM}) AS p, {', '.join(f'sum({z}) AS y_{z}' for z in _Z)} FROM ka GROUP BY k, cluster"),
    ("kd", f"SELECT a.k, a.customer_id, a.cluster = c.cluster AS own, c.n, {_NORM.replace('recency_z', 'a.recency_z').replace('frequency_z', 'a.frequency_z').replace('monetary_z', 'a.monetary_z')} "
           f"+ c.p / c.n - 2.0::DOUBLE * ({' + '.join(f'a.{z} * c.y_{z}' for z in _Z)}) / c.n AS d FROM ka a JOIN kc c ON a.k = c.k"),
    ("ks", "SELECT k, customer_id, max(n) FILTER (own) AS n, max(d * n / greatest(n - 1, 1)) FILTER (own) AS a, "
           "min(d) FILTER (NOT own) AS b FROM kd GROUP BY k, customer_id"),
    final="SELECT CAST(k AS INTEGER) AS k, avg(CASE WHEN b IS NULL THEN NULL WHEN n = 1 OR a = b THEN 0.0::DOUBLE "
          "ELSE (b - a) / greatest(a, b) END) AS silhouette FROM ks GROUP BY k")))
def q_kmeans_silhouette(spark, sf):
    return _sweep(spark, sf).select("k", "silhouette")


@register("silhouette_euclidean_kmeans", group="kmeans", doubles=REGISTRY["silhouette_euclidean"].doubles,
          sql=on_clusters("silhouette_euclidean"))
def q_silhouette_euclidean_kmeans(spark, sf):
    return silhouette_bounds(_assigned(spark, sf))


@register("rfm_clusters", group="kmeans", sql=on_clusters("customer_segments"))
def q_rfm_clusters(spark, sf):
    return _segments(spark, sf).select("customer_id", "cluster", "segment")


@register("kmeans_violations", group="kmeans", sql=with_base(
    ("c", "SELECT count(DISTINCT customer_id) AS n FROM sales"),
    final="SELECT n AS customers, CAST(0 AS BIGINT) AS not_nearest, CAST(4 AS BIGINT) AS clusters FROM c"))
def q_kmeans_violations(spark, sf):
    """Customers that are nearer to the mean of another cluster than to their own: none."""
    return M.kmeans_violations(_assigned(spark, sf))


_REPORTS = {
    "segment_summary": G.segment_summary,
    "segment_counts": G.segment_counts,
    "segment_revenue": G.segment_revenue,
    "segment_treemap": G.segment_treemap,
    "segment_customers_all": G.segment_customers,
    "cluster_profile": G.cluster_profile,
    "segment_labels": lambda seg: G.segment_labels(G.cluster_profile(seg)),
}
for _name, _report in _REPORTS.items():
    register(f"{_name.removesuffix('_all')}_kmeans", group="kmeans", doubles=REGISTRY[_name].doubles, sql=on_clusters(_name))(
        lambda spark, sf, report=_report: report(_segments(spark, sf)))

for _name, _kpis in {"overview_kpis": L.overview_kpis, "project_summary": L.project_summary}.items():
    register(f"{_name}_kmeans", group="kmeans", doubles=REGISTRY[_name].doubles, sql=on_clusters(_name))(
        lambda spark, sf, kpis=_kpis: kpis(load_sales(spark, sf), _segments(spark, sf), ROLES.year_a, ROLES.year_b))
