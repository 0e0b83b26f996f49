import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from orderscope.session import build_session
    s = build_session("local[4]", 4, app_name="orderscope-tests")
    yield s
    s.stop()


def sales_frame(spark, rows):
    """A ``sales``-shaped frame from (order_id, customer_id, date, category, product,
    quantity, unit_price, region, channel) tuples; cents/revenue derived."""
    import datetime as dt
    from pyspark.sql import functions as F
    from orderscope.functions.numeric import line_cents, money
    schema = ("order_id bigint, customer_id bigint, order_date date, category string, product string, "
              "quantity int, unit_price double, region string, channel string")
    fixed = [(r[0], r[1], dt.date.fromisoformat(r[2]) if isinstance(r[2], str) else r[2], *r[3:]) for r in rows]
    df = spark.createDataFrame(fixed, schema)
    c = line_cents("unit_price", "quantity")
    return df.withColumn("cents", c).withColumn("revenue", money(F.col("cents")))
