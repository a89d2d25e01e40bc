"""Row numbers of a whole DataFrame without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.scratch import cut

ORDINAL = "_row_num"


#: Kinds of plan nodes that give the same partitions each time they run (fixed values).
_STEADY = ("Project", "Filter", "LogicalRelation", "LocalRelation", "Range", "DataSourceV2ScanRelation", "LogicalRDD")


def _repeatable(plan) -> bool:
    """Whether a plan is made of scans, projections and filters only, all deterministic."""
    if plan.getClass().getSimpleName() not in _STEADY:
        return False
    expressions = plan.expressions()
    if not all(expressions.apply(i).deterministic() for i in range(expressions.size())):
        return False
    children = plan.children()
    return all(_repeatable(children.apply(i)) for i in range(children.size()))


def with_ordinal(df: DataFrame, name: str = ORDINAL, start: int = 0, order: Sequence[Column | str] | None = None) -> DataFrame:
    """`df` with a gapless row number from `start`, in the rows' present order or by `order`.

    With `order` the rows are range-partitioned and sorted first. Each partition numbers its own
    rows; one small job counts the rows of every partition, and their running sums (one number per
    partition) are added. Both must see the same partitions, so everything but a plain scan with
    deterministic projections and filters is kept in the shared folder first. An empty table gives an
    empty table.
    """
    body = df.orderBy(*order) if order else df
    at, num = f"__{name}_part", f"__{name}_in"
    tagged = body.withColumn(num, F.monotonically_increasing_id())
    if not _repeatable(body._jdf.queryExecution().optimizedPlan()):
        tagged = cut(tagged)
    # the id counts up within a partition from partition << 33
    tagged = tagged.withColumn(at, F.shiftright(num, 33).cast("int"))
    counts = sorted((r[0], r[1]) for r in tagged.groupBy(at).agg(F.count(F.lit(1))).collect())
    offsets, total = {}, start
    for part, n in counts:
        offsets[part] = total
        total += n
    if not offsets:
        return tagged.withColumn(name, F.lit(start).cast("long")).drop(at, num)
    offset = F.element_at(F.map_from_arrays(F.lit(list(offsets)), F.lit(list(offsets.values()))), F.col(at))
    within = F.col(num) - F.shiftleft(F.col(at).cast("long"), 33)
    return tagged.withColumn(name, (within + offset).cast("long")).drop(at, num)
