"""Shared bindings and SQL fragments for the query modules."""

from __future__ import annotations

from ..oracles import D, lit, money

MONTH = "CAST(date_trunc('month', order_date) AS DATE)"
AOV = f"({D('sum(cents)')} / {D('count(*)')} / {lit(100.0)})"
SUM_MONEY = money("sum(cents)")
