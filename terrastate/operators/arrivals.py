"""A click log stored once, in arrival order, and classified without a second copy (O3).

Layout under one folder::

    rows/generation=<g>/*.parquet    the clicks, with the number of their part
    bests/generation=<g>/*.parquet   (tile_id, part, best): the click that owns each tile of a part afterwards
    published/<n>.json               how many generations there are, and the clicks' schema

Clicks are appended a generation at a time.  A generation is range-partitioned by
(tile, order columns) into even parts, so a hot tile, or a burst of one instant,
is cut; its rows and its bests are written once, then the generation is
published by a small manifest.  Classification reads the rows and
the bests (fewer rows than clicks by far) and writes nothing; the clicks of the
newest generations can be classified alone, reading only the bests of the others.

Generations are later than all before them in the order columns; an append that
is not is refused.  One writer at a time.  An append that was interrupted is
overwritten by the next.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrastate.operators.ownership import DEFAULT_ORDER, best_clicks, classify_parts
from terrastate.session import list_names, read_text, remove_path, write_text

PARTS = 1 << 20  # part numbers of one generation


def _later(a: tuple, b: tuple) -> bool:
    """Whether ``a`` comes behind ``b`` in the order of columns, nulls first."""
    for x, y in zip(a, b):
        if x != y:
            return y is None or (x is not None and x > y)
    return False


class ArrivalLog:
    def __init__(self, spark: SparkSession, path: str, order_cols: Sequence[str] = DEFAULT_ORDER, keep: int = 2):
        self.spark, self.path, self.order_cols, self.keep = spark, path.rstrip("/"), tuple(order_cols), keep

    def _states(self) -> list[int]:
        return sorted(int(n[:-5]) for n in list_names(self.spark, f"{self.path}/published") if n[:-5].isdigit())

    def published(self) -> dict:
        """generations: how many there are; schema: of the clicks."""
        states = self._states()
        if not states:
            return {"generations": 0, "schema": None}
        return json.loads(read_text(self.spark, f"{self.path}/published/{states[-1]}.json"))

    def _bounds(self, rows: DataFrame) -> tuple:
        key = F.struct(*[F.col(c) for c in self.order_cols])
        return rows.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()

    def append(self, clicks: DataFrame, parts: int | None = None) -> int:
        """Store one more generation and return its number."""
        told = self.published()
        g = told["generations"]
        n = parts or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if n >= PARTS:
            raise ValueError(f"at most {PARTS - 1} parts a generation")
        rows = clicks.repartitionByRange(n, "tile_id", *self.order_cols).withColumn("part", F.lit(g * PARTS) + F.spark_partition_id())
        where = f"{self.path}/rows/generation={g}"
        rows.write.mode("overwrite").parquet(where)
        stored = self.spark.read.schema(rows.schema).parquet(where)
        bounds = self._bounds(stored)
        if g and bounds.low is not None:
            before = self._bounds(self._rows(told, g - 1))
            if before.high is not None and not _later(tuple(bounds.low), tuple(before.high)):
                remove_path(self.spark, where)
                raise ValueError(f"clicks arrive before those already stored: {tuple(bounds.low)} <= {tuple(before.high)}")
        best_clicks(stored, self.order_cols, "part").write.mode("overwrite").parquet(f"{self.path}/bests/generation={g}")
        state = {"generations": g + 1, "schema": clicks.schema.json()}
        write_text(self.spark, f"{self.path}/published/{g + 1}.json", json.dumps(state))
        for old in self._states()[:-self.keep]:
            remove_path(self.spark, f"{self.path}/published/{old}.json")
        return g

    def _folders(self, kind: str, first: int, past: int) -> list[str]:
        return [f"{self.path}/{kind}/generation={g}" for g in range(first, past)]

    def _rows(self, told: dict, first: int) -> DataFrame:
        from pyspark.sql import types as T

        schema = T.StructType.fromJson(json.loads(told["schema"])).add("part", T.LongType())
        return self.spark.read.schema(schema).parquet(*self._folders("rows", first, told["generations"]))

    def clicks(self, first: int = 0) -> DataFrame:
        """The stored clicks from generation ``first`` on."""
        return self._rows(self.published(), first).drop("part")

    def classified(self, first: int = 0) -> DataFrame:
        """O3 over the clicks from generation ``first`` on; earlier ones count by their bests alone."""
        told = self.published()
        rows = self._rows(told, first)
        bests = self.spark.read.parquet(*self._folders("bests", 0, told["generations"]))
        return classify_parts(rows, bests, self.order_cols, "part").drop("part")
