"""Run SQL text over DataFrames."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame

_names = itertools.count()


def run_sql(text: str, **inputs: DataFrame) -> DataFrame:
    """``text`` with every ``@name`` standing for the DataFrame passed as ``name``.

    The inputs are temporary views only while the statement is analyzed; the result keeps their plans.
    """
    spark = next(iter(inputs.values())).sparkSession
    views = {}
    for name in sorted(inputs, key=len, reverse=True):
        views[name] = f"attesta_{name}_{next(_names)}"
        inputs[name].createOrReplaceTempView(views[name])
        text = text.replace("@" + name, views[name])
    try:
        return spark.sql(text)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
