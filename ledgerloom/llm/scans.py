"""Running sums over a whole table in a given order, without a window over one partition."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import materialise, tidy


def prefix_sums(df: DataFrame, order: list[Column | str], sums: dict[str, Column], name: str = "sums") -> DataFrame:
    """``df`` with, for each of ``sums``, a column of that name: the sum of its values over all rows before this one.

    Rows are sorted by range and written with their running sums inside their
    partition; the totals of the partitions (one row each, their number is a
    setting) give what comes before.  ``order`` should end in a unique column:
    it then spreads rows that are equal in the others over partitions.  Values
    are whole numbers, a null value raises an error.
    """
    values = {k: f"_value_{k}" for k in sums}
    ranged = (
        df.withColumns({values[k]: c.cast("long") for k, c in sums.items()})
        .repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    )

    def run(it):
        import pyarrow as pa

        before = dict.fromkeys(values, 0)
        for batch in it:
            out = list(batch.columns)
            for k, own in values.items():
                v = batch.column(own).to_numpy()
                upto = np.cumsum(v) + before[k]
                out.append(pa.array(upto - v))
                before[k] = int(upto[-1]) if len(upto) else before[k]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, *values])

    schema = StructType([*ranged.schema.fields, *[StructField(k, LongType()) for k in values]])
    fixed = materialise(ranged.mapInArrow(tidy(run), schema), name)
    totals = fixed.groupBy("_part").agg(*[F.sum(v).alias(f"_total_{k}") for k, v in values.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_total_{k}").over(earlier), F.lit(0)).alias(f"_start_{k}") for k in values])
    placed = fixed.join(F.broadcast(starts), "_part")
    return placed.select(*df.columns, *[(F.col(k) + F.col(f"_start_{k}")).alias(k) for k in values])
