"""Registered queries: each module binds operators to the driver tables and
states the DuckDB oracle for them (see :mod:`orderscope.registry`)."""

from . import (breakdowns, cohorts, cube, distributions, forecast, hypothesis, kmeans, kpis,  # noqa: F401
               quality, rfm, segments, source, trends)
