"""Reading physical plans: what a query shuffles, broadcasts, pushes down and reads."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def text(df: DataFrame) -> str:
    """The formatted physical plan."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def nodes(df: DataFrame) -> Counter:
    """How many of each operator the plan has, before adaptive changes."""
    tree = text(df).split("\n\n\n")[0]
    return Counter(m[1] for m in re.finditer(r"^[\s:+\-|*]*\s*(?:\* )?([A-Z]\w+)[^\n]*\(\d+\)", tree, re.M))


def pushed_filters(df: DataFrame) -> list[str]:
    """The filters that scans evaluate."""
    return re.findall(r"PushedFilters: \[(.*?)\]\n", text(df))


def columns_read(df: DataFrame) -> list[set[str]]:
    """The columns of each scan."""
    return [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<(.*)>", text(df))]


def python_steps(df: DataFrame) -> int:
    """How many steps leave the JVM for Python."""
    return sum(n for name, n in nodes(df).items() if re.search("Python|Pandas|Arrow", name))
