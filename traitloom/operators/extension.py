"""Surfaces for a caller's own group functions and aggregates, safe for hot groups."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType


class Aggregator(ABC):
    """An aggregate whose states merge.

    ``state`` and ``result`` are DDL texts of the fields of a state and of the
    result.  Methods get Arrow tables and give dicts.  ``merge`` must not depend
    on how rows were dealt into states, nor on their order.
    """

    state: str
    result: str

    @abstractmethod
    def reduce(self, rows: pa.Table) -> dict:
        """The state of some rows of one group."""

    @abstractmethod
    def merge(self, states: pa.Table) -> dict:
        """One state of several of the same group."""

    @abstractmethod
    def finish(self, state: dict) -> dict:
        """The result of a group's state."""


def aggregate_by(df: DataFrame, keys: list[str], aggregator: Aggregator, most: int = 10_000) -> DataFrame:
    """Keys and the aggregator's result per group.

    Every task reduces and merges what it reads before the shuffle, and hands
    states on when it holds ``most`` groups; a group's states, not its rows,
    meet in one task.  Null keys make a group.  Without keys there is one group,
    and no row for an empty table.
    """
    state, result = StructType.fromDDL(aggregator.state), StructType.fromDDL(aggregator.result)
    names, wanted = [f"_key{i}" for i in range(len(keys) or 1)], to_arrow_schema(state)
    key_columns = [F.col(k) for k in keys] or [F.lit(0)]
    rows = df.select(*[c.alias(n) for c, n in zip(key_columns, names)], *df.columns)
    kinds = [StructField(n, rows.schema[n].dataType) for n in names]
    partial = StructType([*kinds, StructField("state", state)])
    sent, out = to_arrow_schema(partial), StructType([*kinds, *result.fields])
    returned = to_arrow_schema(out)

    def merged(states: list[dict]) -> dict:
        return states[0] if len(states) == 1 else aggregator.merge(pa.Table.from_pylist(states, schema=wanted))

    def reduce(batches):
        held: dict[tuple, dict] = {}

        def drained():
            lists = [{**dict(zip(names, k)), "state": s} for k, s in held.items()]
            return pa.RecordBatch.from_pylist(lists, schema=sent)

        for batch in batches:
            table = pa.Table.from_batches([batch]).append_column("_at", pa.array(range(batch.num_rows), pa.int64()))
            for group in table.select([*names, "_at"]).group_by(names, use_threads=False).aggregate([("_at", "list")]).to_pylist():
                key = tuple(group[n] for n in names)
                fresh = aggregator.reduce(table.take(pa.array(group["_at_list"])).drop_columns([*names, "_at"]))
                held[key] = merged([held[key], fresh]) if key in held else fresh
            if len(held) >= most:
                yield drained()
                held.clear()
        if held:
            yield drained()

    def finish(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        last = aggregator.finish(merged(table.column("state").to_pylist()))
        return pa.Table.from_pylist([{**dict(zip(names, (v.as_py() for v in key))), **last}], schema=returned)

    done = rows.mapInArrow(reduce, partial).groupBy(*names).applyInArrow(finish, out)
    return done.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *[f.name for f in result.fields])


def apply_in_parts(df: DataFrame, keys: list[str], function: Callable[[pd.DataFrame], pd.DataFrame], merge: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows: int = 1_000_000) -> DataFrame:
    """A caller's group function over groups of any size: keys and the fields of ``schema``.

    A group of more than ``rows`` rows is dealt into parts of about that many.
    ``function`` gets the rows of a part, ``merge`` the results of all parts of
    a group; both give frames of ``schema``.  Groups of one part are not merged.
    Null keys make a group.
    """
    fields = StructType.fromDDL(schema)
    names = [f"_key{i}" for i in range(len(keys))]
    given = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *df.columns)
    large = given.groupBy(*names).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
    large = large.select(*[F.col(n).alias(f"_hot{i}") for i, n in enumerate(names)], F.ceil(F.col("_n") / rows).alias("_parts"))
    same = [F.col(n).eqNullSafe(F.col(f"_hot{i}")) for i, n in enumerate(names)]
    dealt = given.join(large, same, "left").drop(*large.columns[:-1])
    dealt = dealt.withColumn("_part", F.when(F.col("_parts").isNotNull(), F.monotonically_increasing_id() % F.col("_parts")))
    kinds = [StructField(n, given.schema[n].dataType) for n in names]
    columns = list(df.columns)

    def with_keys(key: tuple, out: pd.DataFrame) -> pd.DataFrame:
        out = out[[f.name for f in fields]]
        for i, n in enumerate(names):
            out.insert(i, n, [key[i]] * len(out))
        return out

    def first(key, frame: pd.DataFrame) -> pd.DataFrame:
        out = with_keys(key, function(frame[columns].reset_index(drop=True)).copy())
        out["_part"] = key[-1]
        return out

    def second(key, frame: pd.DataFrame) -> pd.DataFrame:
        return with_keys(key, merge(frame[[f.name for f in fields]].reset_index(drop=True)).copy())

    parts = dealt.groupBy(*names, "_part").applyInPandas(first, StructType([*kinds, *fields.fields, dealt.schema["_part"]]))
    whole = parts.where("_part is null").drop("_part")
    split = parts.where("_part is not null").groupBy(*names).applyInPandas(second, StructType([*kinds, *fields.fields]))
    return whole.unionByName(split).select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *[f.name for f in fields])
