"""Join shapes that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_many(one: DataFrame, many: DataFrame, one_key: str, many_key: str) -> DataFrame:
    """``one LEFT JOIN many`` (one row per key on the left, any number on the right).

    Written as ``many INNER JOIN one`` plus the ``one`` rows without a match.  In the inner
    join AQE may split a hot key of ``many`` across tasks (it cannot split the non-preserved
    side of an outer join), and the anti join reads ``many``'s keys after a map-side
    ``distinct``, so a hot key arrives as one row per map task.  Columns of ``many`` are NULL
    on the unmatched rows, exactly as in the outer join.
    """
    matched = many.join(one, many[many_key] == one[one_key], "inner")
    keys = many.select(F.col(many_key).alias("__k")).distinct()
    lonely = one.join(keys, one[one_key] == keys["__k"], "left_anti")
    for f in many.schema.fields:
        if f.name not in lonely.columns:
            lonely = lonely.withColumn(f.name, F.lit(None).cast(f.dataType))
    return matched.unionByName(lonely)


def mentioned(table: DataFrame, col: str, batch: DataFrame, batch_col: str) -> DataFrame:
    """Rows of ``table`` whose ``col`` appears in ``batch[batch_col]``.

    The batch's distinct values are small next to a stored table; joined as a semi join they
    can be broadcast, so the stored table is filtered as it is read, not shuffled whole.
    """
    wanted = batch.select(F.col(batch_col).alias("__want")).distinct()
    return table.join(wanted, table[col] == wanted["__want"], "left_semi")
