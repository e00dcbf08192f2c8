"""What a row must know of the rows before and after it in its group, without one task for a group.

A group (a document) is cut into blocks of ``span`` positions. Windows run within blocks; of each block one summary goes on, and what a
block must know of the others is a window over its group's summaries, ``span`` times fewer rows. So a document of any length
is spread over its blocks, and short ones lose nothing: they are one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Positions of a block.
SPAN = 4096


def carried(
    rows: DataFrame, keys: list[str], at: str, order: tuple[str, ...] = (), counts: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, nexts: dict[str, Column] | None = None, span: int = SPAN
) -> DataFrame:
    """``rows`` with more columns, in the order of ``at`` (a whole number) and ``order`` within ``keys``.

    ``counts``: how many rows up to and with this one hold; ``lasts``: the last value that isn't null up to and with this row; ``nexts``: the
    first value that isn't null after this row. Rows that agree in ``at`` and ``order`` stand in any order; a null ``at`` stands first.
    Rows that share ``at`` are one block's, however many.
    """
    counts, lasts, nexts = counts or {}, lasts or {}, nexts or {}
    told = {f"__n_{k}": F.coalesce(c.cast("long"), F.lit(0)) for k, c in counts.items()} | {f"__l_{k}": c for k, c in lasts.items()} | {f"__f_{k}": c for k, c in nexts.items()}
    placed = rows.withColumns(told | {"__block": F.coalesce(F.floor(F.col(at) / span), F.lit(-(2**62)))})
    place = F.struct(at, *order)
    first = lambda c, last: (F.max_by if last else F.min_by)(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(c)
    summary = placed.groupBy(*keys, "__block").agg(*(F.sum(f"__n_{k}").alias(f"__n_{k}") for k in counts), *(first(f"__l_{k}", True) for k in lasts), *(first(f"__f_{k}", False) for k in nexts))
    blocks = Window.partitionBy(*keys).orderBy("__block")
    before, after = blocks.rowsBetween(Window.unboundedPreceding, -1), blocks.rowsBetween(1, Window.unboundedFollowing)
    known = {f"__c_n_{k}": F.sum(f"__n_{k}").over(before) for k in counts} | {f"__c_l_{k}": F.last(f"__l_{k}", ignorenulls=True).over(before) for k in lasts} | {f"__c_f_{k}": F.first(f"__f_{k}", ignorenulls=True).over(after) for k in nexts}
    carry = summary.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__block").alias("__k_block"), *(c.alias(name) for name, c in known.items()))
    met = F.col("__block") == F.col("__k_block")
    for k in keys:
        met &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = placed.join(carry, met, "left")
    here = Window.partitionBy(*keys, "__block").orderBy(at, *order)
    upto, beyond = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(1, Window.unboundedFollowing)
    found = {k: F.coalesce(f"__c_n_{k}", F.lit(0)) + F.sum(f"__n_{k}").over(upto) for k in counts}
    found |= {k: F.coalesce(F.last(f"__l_{k}", ignorenulls=True).over(upto), F.col(f"__c_l_{k}")) for k in lasts}
    found |= {k: F.coalesce(F.first(f"__f_{k}", ignorenulls=True).over(beyond), F.col(f"__c_f_{k}")) for k in nexts}
    return joined.select(*rows.columns, *(c.alias(name) for name, c in found.items()))
