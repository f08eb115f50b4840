"""Autocomplete: how its joins are planned."""

from placeloom.operators import search
from placeloom.runtime import Scratch


def test_autocomplete_broadcasts_nothing(spark, monkeypatch):
    """q12_q22: typed texts and lines grow with the data; a small Parquet file of them may not fit the driver as rows."""
    plans, write = [], Scratch.write

    def seen(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df)

    monkeypatch.setattr(Scratch, "write", seen)
    typed = spark.createDataFrame([(1, "7 high st ely"), (2, "st"), (3, "ely hi"), (4, "high st")], "query_id long, key string")
    lines = spark.createDataFrame([("high st ely", "7"), ("high st ely", "7"), ("low st ely", "7"), ("st st st", None)], "line string, number string")
    got = search.autocomplete(typed, lines)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert {tuple(x) for x in got.collect()} == {
        (1, "high st ely", 1, 1, 1), (2, "high st ely", 1, 0, 1), (2, "low st ely", 1, 0, 2), (2, "st st st", 1, 0, 3), (3, "high st ely", 2, 0, 1), (4, "high st ely", 1, 0, 1),
    }
    assert not [p for p in plans if "Broadcast" in p]
