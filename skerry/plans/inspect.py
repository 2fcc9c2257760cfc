"""What a plan does: exchanges, joins, Python nodes and pushed filters, from its text."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def plan_nodes(df: DataFrame) -> Counter:
    text = df._jdf.queryExecution().executedPlan().toString()
    return Counter(re.findall(r"\b(Exchange|BroadcastExchange|SortMergeJoin|BroadcastHashJoin|BroadcastNestedLoopJoin|CartesianProduct|WindowGroupLimit|MapInPandas|MapInArrow|ArrowEvalPython)\b", text))


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString())
