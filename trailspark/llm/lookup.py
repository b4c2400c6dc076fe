"""Looking rows up by a key of which some values are very common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is common if at least one in so many rows has it, so no more keys than this are.
SHARES = 1000


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str], n: str, total: int) -> DataFrame:
    """``rows`` with ``values`` of ``table``, which has one row for every key of ``rows``; ``n``: its rows, ``total``: all rows.

    Common keys are at most ``SHARES`` rows whatever the input, and are broadcast;
    the others are joined by a shuffle in which no key has more than a ``SHARES``-th
    of the rows. Both read ``rows`` and ``table``, which should be written tables.
    """
    common = F.col(n) * SHARES >= total
    found = F.broadcast(table.where(common).select(*keys, *values, F.lit(True).alias("is_common")))
    marked = rows.join(found, keys, "left")
    return marked.where("is_common").drop("is_common").unionByName(marked.where("is_common is null").select(*rows.columns).join(table.where(~common).select(*keys, *values), keys))
