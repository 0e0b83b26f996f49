"""orderscope — order-level sales analytics as Spark DataFrame jobs.

Sub-packages:

* ``sources``    driver tables -> the ``sales`` fact table (and its dirty test view), sinks
* ``functions``  column expressions: rounding, calendar features, distribution tails
* ``plans``      reusable distributed building blocks (exact quantiles, bounded broadcast)
* ``operators``  the analyses: quality, distributions, trends, breakdowns, RFM,
                 segments, cohorts, hypothesis tests, forecast, KPIs
* ``streaming``  notes only: the analyses are batch jobs (see the module docstring)
"""

__version__ = "0.1.0"
