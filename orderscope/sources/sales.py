"""The order fact table, built from the driver's TPC-H-style tables.

One row of ``sales`` is one order line, keyed by ``order_id``:

=========== ======================================== ==========
column      expression                               type
=========== ======================================== ==========
order_id    ``l_orderkey * 10 + l_linenumber``       bigint
customer_id ``o_custkey``                            bigint
order_date  ``cast(o_orderdate as date)``            date
category    ``p_type``                               string
product     ``p_name``                               string
quantity    ``cast(l_quantity as int)``              int
unit_price  ``p_retailprice``                        double
region      ``r_name`` via customer -> nation        string
channel     ``o_orderpriority``                      string
cents       ``rint(unit_price * quantity * 100)``    bigint
revenue     ``cents / 100``                          double
=========== ======================================== ==========

Join plan (scale notes):

* ``nation`` and ``region`` are fixed-size TPC-H dimensions (25 and 5 rows), so
  they are broadcast into the ``customer`` scan — no shuffle of ``customer``
  for the region lookup.
* ``lineitem`` meets ``orders ⋈ customer`` first and ``part``, with its strings, last.
  Line-sized data crosses three exchanges: the dedup (after its map-side combine),
  the order key and the part key; the first two carry only the keys, the quantity
  and what tells duplicates apart.  No other join is hinted: the planner
  broadcasts a side only when its measured or estimated size is under the
  broadcast threshold, else it sort-merge joins, and AQE re-plans from the
  real shuffle sizes (and splits skewed partitions).
* Duplicates are removed on ``lineitem`` *before* the joins (the joins are
  lossless key lookups, so this equals deduplicating the joined rows) with a
  partial aggregation, which survives a key holding a third of all rows.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import line_cents, money
from ..plans.lookups import lookup_join
from ..plans.store import publish
from ..session import checkpoint_dir

# Total order for "keep the first duplicate": the reference keeps the first row
# of a date sort; we make the order total with the line's own columns.
TIEBREAK = ["tb_shipdate", "tb_partkey", "tb_suppkey", "tb_quantity", "tb_extendedprice"]

FACT_COLUMNS = ["order_id", "customer_id", "order_date", "category", "product",
                "quantity", "unit_price", "region", "channel"]
SALES_COLUMNS = FACT_COLUMNS + ["cents", "revenue"]
SALES_SCHEMA = ("order_id bigint, customer_id bigint, order_date date, category string, product string, quantity int, "
                "unit_price double, region string, channel string, cents bigint, revenue double, order_year int")


@dataclass(frozen=True)
class Roles:
    """Driver values that play the reference's named roles (parameters, not literals)."""

    email_channel: str = "1-URGENT"
    social_channel: str = "5-LOW"
    year_a: int = 1999          # the reference's first full year
    year_b: int = 2000          # the year compared with it
    urgent_channel: str = "1-URGENT"


ROLES = Roles()


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one driver table, projecting only ``columns`` (pruned at the scan)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def dedup_keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per ``key``: the row that sorts first by ``order`` (then by the rest).

    ``min(struct(order..., rest...))`` is an ordinary aggregate, so each map task
    collapses its copies of a key before the shuffle (no window over a whole key
    group, no sort of a hot key in one task) and the choice is deterministic.
    """
    rest = [c for c in df.columns if c not in key and c not in order]
    fields = order + rest
    first = df.groupBy(*key).agg(F.min(F.struct(*fields)).alias("_first"))
    return first.select(*key, *[F.col("_first")[c].alias(c) for c in fields]).select(*df.columns)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey",
                    "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return li.select(
        (F.col("l_orderkey") * F.lit(10) + F.col("l_linenumber")).cast("bigint").alias("order_id"),
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_shipdate").alias("tb_shipdate"),
        F.col("l_partkey").alias("tb_partkey"),
        F.col("l_suppkey").alias("tb_suppkey"),
        F.col("l_quantity").alias("tb_quantity"),
        F.col("l_extendedprice").alias("tb_extendedprice"),
    )


def _enrich(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """``lines``, or their orders with an array ``lines``, with the columns of the other tables."""
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_type", "p_name", "p_retailprice")
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate",
                        "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")

    # Fixed-size dimensions (TPC-H: 25 nations, 5 regions): safe to broadcast.
    geo = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey) \
                .select("n_nationkey", "r_name")
    cust = customer.join(F.broadcast(geo), customer.c_nationkey == geo.n_nationkey) \
                   .select(F.col("c_custkey"), F.col("r_name").alias("region"))
    ords = orders.join(cust, orders.o_custkey == cust.c_custkey).select(
        F.col("o_orderkey"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_orderpriority").alias("channel"),
        F.col("region"),
    )
    lo = lines.join(ords, lines.orderkey == ords.o_orderkey).drop("orderkey", "o_orderkey")
    if "lines" in lo.columns:
        lo = lo.select(*[c for c in lo.columns if c != "lines"], F.inline("lines"))
    out = lo.join(part, lo.partkey == part.p_partkey).withColumnsRenamed(
        {"p_type": "category", "p_name": "product", "p_retailprice": "unit_price"})
    return out.select(*FACT_COLUMNS, *[c for c in TIEBREAK if c in lines.columns])


def sales_raw(spark: SparkSession, sf_dir: str, with_tiebreak: bool = False) -> DataFrame:
    """A1: every order line, duplicates included (``revenue`` per S1)."""
    df = _enrich(spark, sf_dir, _lines(spark, sf_dir))
    df = df.withColumn("revenue", money(line_cents("unit_price", "quantity")))
    cols = FACT_COLUMNS + ["revenue"] + (TIEBREAK if with_tiebreak else [])
    return df.select(*cols)


def sales_preview(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """A2: the first ``n`` raw rows by date.  The lines are chosen with their order's
    date alone; only those ``n`` meet the other tables (every key has its row there)."""
    lines = _lines(spark, sf_dir)
    dates = read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    first = lines.join(dates, lines.orderkey == dates.o_orderkey).orderBy(
        F.col("o_orderdate").cast("date"), "order_id", *TIEBREAK).limit(n).select(*lines.columns)
    df = _enrich(spark, sf_dir, first)
    return df.withColumn("revenue", money(line_cents("unit_price", "quantity"))).select(*FACT_COLUMNS, "revenue")


def sales_dirty(spark: SparkSession, sf_dir: str, with_tiebreak: bool = True) -> DataFrame:
    """Test view with the reference's kinds of dirt (FIXTURES §3), derived by Spark.

    The driver tables hold no null price and no zero quantity, so the cleaning
    branches need this view: price NULL where ``order_id % 250 = 3``, quantity
    0 where ``order_id % 997 = 0``; duplicate keys are already present.
    """
    raw = sales_raw(spark, sf_dir, with_tiebreak=True)
    d = raw.withColumns({
        "unit_price": F.when(F.col("order_id") % 250 == 3, F.lit(None).cast("double"))
                       .otherwise(F.col("unit_price")),
        "quantity": F.when(F.col("order_id") % 997 == 0, F.lit(0)).otherwise(F.col("quantity")),
    })
    d = d.withColumn("revenue", money(line_cents("unit_price", "quantity")))
    cols = FACT_COLUMNS + ["revenue"] + (TIEBREAK if with_tiebreak else [])
    return d.select(*cols)


def category_medians(df: DataFrame, value: str = "unit_price", by: str = "category") -> DataFrame:
    """Pandas ``groupby(by)[value].median()`` (exact; mean of the middle pair).

    Uses the distributed exact-quantile plan, so a category holding a third of
    all rows is never gathered into one task.
    """
    from ..plans.quantiles import medians
    return medians(df, value, [by], out="median_price")


def impute_prices(df: DataFrame) -> DataFrame:
    """B4 + B5: fill NULL ``unit_price`` with its category median, recompute revenue.

    The medians table has one row per category; it is joined with a
    size-checked broadcast (:func:`~orderscope.plans.lookups.lookup_join`), so
    the rows are never shuffled by a handful of category keys.
    """
    # The rows are read twice (medians, then filling): write them once, as columns
    # in the shared folder, so their lineage (dedup, joins) runs once, a lost
    # executor never re-runs it, and the medians read two columns only.
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/impute-{uuid.uuid4().hex}"
    df.write.parquet(path)
    df = spark.read.schema(df.schema).parquet(path)
    # Only NULL rows read their category's median, so taking the medians of
    # every category gives the same rows and needs no pre-pass to find the
    # categories with gaps (build_sales skips imputation when none can exist).
    med = category_medians(df)
    out = lookup_join(df, med, ["category"], "left").withColumn(
        "unit_price", F.coalesce(F.col("unit_price"), F.col("median_price")))
    cents = line_cents("unit_price", "quantity")
    return out.withColumns({"cents": cents, "revenue": money(cents)}) \
              .select(*FACT_COLUMNS, "cents", "revenue")


def clean_sales(df: DataFrame, key: str = "order_id") -> DataFrame:
    """Dedup (keep first) -> impute -> recompute revenue -> keep revenue > 0."""
    order = [c for c in TIEBREAK if c in df.columns] or ["order_date"]
    dd = dedup_keep_first(df, [key], order)
    return impute_prices(dd).filter(F.col("cents") > 0)


def prices_complete(spark: SparkSession, sf_dir: str) -> bool:
    """True when no ``part`` row has a NULL retail price.

    ``unit_price`` comes only from ``p_retailprice``, so then no sales row can
    need imputing.  The ``IS NULL`` filter is pushed to the Parquet reader,
    which skips every row group whose statistics count no nulls; the job
    reads at most one row.
    """
    part = read_table(spark, sf_dir, "part", "p_retailprice")
    return part.where(F.col("p_retailprice").isNull()).limit(1).count() == 0


def line_numbers_fit(spark: SparkSession, sf_dir: str) -> bool:
    """True when every line number is a digit, so that an ``order_id`` tells its order.

    As in :func:`prices_complete`, the reader skips row groups by their statistics.
    """
    n = F.col("l_linenumber")
    li = read_table(spark, sf_dir, "lineitem", "l_linenumber")
    return li.where(n.isNull() | (n < 0) | (n > 9)).limit(1).count() == 0


def unique_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line (by ``TIEBREAK``) of every ``order_id``: its order, part and quantity.

    Where an ``order_id`` tells its order, a row is an order with an array of its lines:
    one aggregation by order keeps the first line of each number, so the orders join
    without another exchange.  Only the columns before the price can decide which part
    and quantity come first there (whole quantities do for that, as cutting the
    fraction keeps their order), so only those are shuffled.
    """
    lines = _lines(spark, sf_dir)
    if not line_numbers_fit(spark, sf_dir):
        return dedup_keep_first(lines, ["order_id"], TIEBREAK).drop(*TIEBREAK)
    number = F.col("order_id") - F.col("orderkey") * F.lit(10)
    line = F.struct("tb_shipdate", "partkey", "tb_suppkey", "quantity")
    orders = lines.groupBy("orderkey").agg(*[F.min(F.when(number == k, line)).alias(f"line_{k}") for k in range(10)])
    kept = [F.when(F.col(f"line_{k}").isNotNull(), F.struct(
        (F.col("orderkey") * F.lit(10) + F.lit(k)).alias("order_id"),
        F.col(f"line_{k}.partkey").alias("partkey"), F.col(f"line_{k}.quantity").alias("quantity"))) for k in range(10)]
    return orders.select("orderkey", F.array_compact(F.array(*kept)).alias("lines"))


def build_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned ``sales`` table every analysis starts from (lazy plan).

    Duplicates are removed on ``lineitem`` before the joins; then the same
    impute / recompute / filter steps as :func:`clean_sales`.  Imputation
    needs the medians of the joined rows, i.e. a second pass over the whole
    join; when the prices are complete it is an exact no-op and is skipped,
    so the join runs once.
    """
    joined = _enrich(spark, sf_dir, unique_lines(spark, sf_dir))
    if prices_complete(spark, sf_dir):
        cents = line_cents("unit_price", "quantity")
        filled = joined.withColumns({"cents": cents, "revenue": money(cents)})
    else:
        filled = impute_prices(joined)
    return filled.filter(F.col("cents") > 0).select(*SALES_COLUMNS)


# Bump when build_sales or the table's layout changes, so old tables are not reused.
PIPELINE_VERSION = 5
MATERIALIZE_CONF = "orderscope.materialize"
SOURCE_TABLES = ("lineitem", "orders", "part", "customer", "nation", "region")


def _snapshot_key(spark: SparkSession, sf_dir: str) -> str:
    """Identify the source snapshot by the listing of its files.

    Spark's own ``binaryFile`` listing (path, length, modification time; no content
    is read) works for every URI and for tables of many files; only a count and a
    checksum reach the driver.
    """
    paths = [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in SOURCE_TABLES]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    seen = files.select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h"))
    one = seen.agg(F.count("*").alias("n"), F.sum("h").alias("s")).first()
    return hashlib.sha1(f"{sf_dir.rstrip('/')}|{PIPELINE_VERSION}|{one['n']}|{one['s']}".encode()).hexdigest()[:16]


def sales_path(spark: SparkSession, sf_dir: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/sales-{_snapshot_key(spark, sf_dir)}"


def with_year(sales: DataFrame) -> DataFrame:
    return sales.withColumn("order_year", F.year("order_date"))


def materialize_sales(spark: SparkSession, sf_dir: str) -> str:
    """Write the cleaned table once per source snapshot into the shared folder.

    Each build writes a folder of its own, partitioned by order year and sorted by
    date inside files (so year and date filters prune folders and pages; the tasks of
    the last join write, no exchange is made for it), and
    publishes it by a marker written last: a job that dies leaves an unnamed
    folder that nothing reads, and readers never see a table being replaced.
    Reading it back cuts the lineage of every analysis.
    """
    def write(path: str) -> None:
        table = with_year(build_sales(spark, sf_dir)).sortWithinPartitions("order_year", "order_date", "order_id")
        table.write.partitionBy("order_year").parquet(path)
    return publish(spark, sales_path(spark, sf_dir), write)


def load_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sales`` for the analyses: the materialised table (default) or the lazy plan.

    Set ``orderscope.materialize=false`` to run every analysis from the raw
    tables instead.  ``order_year`` is the partition column.
    """
    if spark.conf.get(MATERIALIZE_CONF, "true").lower() == "false":
        return with_year(build_sales(spark, sf_dir))
    return spark.read.schema(SALES_SCHEMA).parquet(materialize_sales(spark, sf_dir))


def derived(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """``build(sales)`` for an analysis that many queries share (the customers, their
    clusters): written once per snapshot of ``sales`` beside it.  ``name`` changes with
    the parameters and with what ``build`` computes."""
    if spark.conf.get(MATERIALIZE_CONF, "true").lower() == "false":
        return build(load_sales(spark, sf_dir))
    base = f"{sales_path(spark, sf_dir)}-{name}"
    path = publish(spark, base, lambda path: build(load_sales(spark, sf_dir)).write.parquet(path))
    return spark.read.parquet(path)
