"""EXPLAIN as rows (step, op, detail), from the optimised plan without running it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

_OPS = (("Relation", "SCAN"), ("LogicalRDD", "SCAN"), ("Range", "SCAN"), ("LocalRelation", "SCAN"), ("Join", "JOIN"), ("Filter", "FILTER"), ("Sort", "SORT"), ("GlobalLimit", "LIMIT"), ("Offset", "LIMIT"), ("Aggregate", "AGGREGATE"), ("Window", "WINDOW"), ("Expand", "GROUPING SETS"), ("Generate", "APPLY"), ("Union", "UNION"))


def explain(df: DataFrame) -> DataFrame:
    rows = []
    for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines():
        text = re.sub(r"^[\s:+-]*", "", line)
        op = next((name for start, name in _OPS if text.startswith(start)), None)
        if op:
            rows.append((len(rows) + 1, op, re.sub(r"#\d+L?", "", text)))
    return df.sparkSession.createDataFrame(rows, "step int, op string, detail string")
