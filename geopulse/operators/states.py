"""Views whose partial results are kept: coarser levels and later batches come from states, not from posts.

A reducer has three steps: ``init`` makes a state of values, ``merge`` a state of states, ``finish`` the result
of a state. States are rows at the finest key, one for each key and batch; any level is a merge over them, so the
posts are read once, whatever is asked for later. What can be merged can be a reducer: sums, extremes, and sketches.
"""

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geopulse.operators.views import stats

State = dict[str, Column]


@dataclass(frozen=True)
class Reducer:
    """``init`` takes the value column, ``merge`` and ``finish`` the fields of a state by name; each gives
    columns by name. ``init`` and ``merge`` give aggregates and name the same fields."""

    init: Callable[[Column], State]
    merge: Callable[[State], State]
    finish: Callable[[State], State] = dict

    def fields(self) -> list[str]:
        return list(self.init(F.lit(0)))


STATS = Reducer(
    stats,
    lambda s: {"sum": F.sum(s["sum"]), "count": F.sum(s["count"]), "min": F.min(s["min"]), "max": F.max(s["max"]), "sumsqr": F.sum(s["sumsqr"])},
)
SUM = Reducer(lambda x: {"sum": F.sum(x)}, lambda s: {"sum": F.sum(s["sum"])})
COUNT = Reducer(lambda x: {"count": F.count("*")}, lambda s: {"count": F.sum(s["count"])})
# Mean and sample deviation from sums.
MEAN = Reducer(
    lambda x: {"n": F.count(x), "total": F.sum(x.cast("double")), "squares": F.sum(x.cast("double") * x)},
    lambda s: {"n": F.sum(s["n"]), "total": F.sum(s["total"]), "squares": F.sum(s["squares"])},
    lambda s: {
        "mean": s["total"] / s["n"],
        "std": F.when(s["n"] > 1, F.sqrt(F.greatest(F.lit(0.0), s["squares"] - s["total"] * s["total"] / s["n"]) / (s["n"] - 1))),
    },
)
# How many different values, by a sketch of fixed size.
DISTINCT = Reducer(
    lambda x: {"sketch": F.hll_sketch_agg(x.cast("string"))},
    lambda s: {"sketch": F.hll_union_agg(s["sketch"])},
    lambda s: {"distinct": F.hll_sketch_estimate(s["sketch"])},
)


def named(columns: State) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


def states_of(df: DataFrame, keys, value, reducer=STATS) -> DataFrame:
    """A state for each key of the rows."""
    x = F.col(value) if isinstance(value, str) else value
    return df.groupBy(*keys).agg(*named(reducer.init(x)))


def merged(states: DataFrame, keys, reducer=STATS) -> DataFrame:
    """A state for each key of the states; ``keys`` may be fewer than theirs, or none."""
    return states.groupBy(*keys).agg(*named(reducer.merge({f: F.col(f) for f in reducer.fields()})))


def finished(states: DataFrame, reducer=STATS) -> DataFrame:
    """The results of states, beside their keys."""
    fields = reducer.fields()
    keys = [c for c in states.columns if c not in fields]
    return states.select(*keys, *named(reducer.finish({f: F.col(f) for f in fields})))


def all_levels(states: DataFrame, keys, reducer=STATS) -> DataFrame:
    """Results of all group levels at once, told apart by ``level``; level 0 is one grand total."""
    rolled = states.rollup(*keys).agg(F.grouping_id().alias("_gid"), *named(reducer.merge({f: F.col(f) for f in reducer.fields()})))
    # A rollup sets the low bits of the grouping id: level k leaves the last n-k columns out.
    level = (F.lit(len(keys)) - F.bit_count("_gid")).cast("int").alias("level")
    return finished(rolled.select(level, *keys, *reducer.fields()), reducer)


class StateStore:
    """States of a view by batch. A batch that is stored again replaces its states, so a replay counts once."""

    def __init__(self, spark: SparkSession, path: str, keys, value, reducer=STATS):
        self.spark, self.path, self.keys, self.value, self.reducer = spark, path, list(keys), value, reducer

    def add(self, rows: DataFrame, batch: int):
        """Reduce new rows to states; only these are read."""
        states_of(rows, self.keys, self.value, self.reducer).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def states(self) -> DataFrame:
        """A state for each key and batch."""
        return self.spark.read.parquet(self.path).drop("batch")

    def view(self, level=None) -> DataFrame:
        """The view grouped by the first ``level`` keys, all of them if not given."""
        keys = self.keys if level is None else self.keys[:level]
        return finished(merged(self.states(), keys, self.reducer), self.reducer)

    def levels(self) -> DataFrame:
        return all_levels(self.states(), self.keys, self.reducer)

    def compact(self, out: str) -> "StateStore":
        """A store with the states of all batches merged into one; readers move to it when it is there."""
        merged(self.states(), self.keys, self.reducer).write.mode("overwrite").parquet(f"{out}/batch=0")
        return StateStore(self.spark, out, self.keys, self.value, self.reducer)
