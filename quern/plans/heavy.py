"""Joins whose keys leave many pairs and whose comparisons keep few of them: pruned by the keys' bounds, then split among tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.scratch import cut

#: Pairs of rows of equal keys up to which a join is left as it is.
LIGHT_PAIRS = 1 << 27
#: Rows of one key, of the left and of the right side, that meet in one place: each side's rows are dealt out, and the other's go to all of them.
PLACE_ROWS = (16384, 2048)
#: Pairs that one task is meant to compare.
TASK_PAIRS = 1 << 25
#: Keys whose bounds are broadcast; those of more keys are joined by a shuffle.
MOST_KEYS = 1 << 16

# Nodes that give the same rows each time they run, types that rows are dealt out by, and comparisons with what they are seen from the other side.
_STEADY = frozenset("Project Filter SubqueryAlias LogicalRelation LocalRelation LogicalRDD Range".split())
_HASHED = frozenset("string int bigint smallint tinyint double float date timestamp timestamp_ntz decimal boolean binary".split())
_COMPARISONS = {"LessThan": "GreaterThan", "LessThanOrEqual": "GreaterThanOrEqual", "GreaterThan": "LessThan", "GreaterThanOrEqual": "LessThanOrEqual"}
_TESTS = {"LessThan": Column.__lt__, "LessThanOrEqual": Column.__le__, "GreaterThan": Column.__gt__, "GreaterThanOrEqual": Column.__ge__}


def _seq(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _has_join(plan) -> bool:
    return _kind(plan) == "Join" or any(_has_join(c) for c in _seq(plan.children()))


def _steady(plan) -> bool:
    return _kind(plan) in _STEADY and plan.deterministic() and all(_steady(c) for c in _seq(plan.children()))


def _conjuncts(e) -> list:
    return [*_conjuncts(e.left()), *_conjuncts(e.right())] if _kind(e) == "And" else [e]


def split_heavy_joins(df: DataFrame) -> DataFrame:
    """`df` with the same rows, its heavy inner joins on equal keys and comparisons rebuilt.

    The planner puts all rows of a key into one task, which compares all pairs of them: few keys make few
    tasks, each with the square of its rows. For a join of two plain selections with comparisons between
    the sides (`a.k = b.k and a.x < b.y`) the pairs are counted (one aggregate job); beyond LIGHT_PAIRS
    a row is kept only if it passes against the other side's smallest or largest value of its key, and the
    keys' rows are divided among places that any task may take. Every row of the result passes the whole
    condition. Other joins stay as the planner has them.
    """
    execution = df._jdf.queryExecution()
    if not _has_join(execution.analyzed()):
        return df
    try:
        plan = execution.optimizedPlan()
    except Exception:  # raises again when it runs
        return df
    rebuilt = _rebuilt(df.sparkSession, plan)
    return df if rebuilt is None else _frame(df.sparkSession, rebuilt)


def _frame(spark, plan) -> DataFrame:
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def _rebuilt(spark, plan):
    """The plan with its heavy joins replaced, None if it has none."""
    children = _seq(plan.children())
    new = [_rebuilt(spark, c) for c in children]
    if any(n is not None for n in new):
        return plan.withNewChildren(spark._jvm.PythonUtils.toSeq([c if n is None else n for c, n in zip(children, new)]))
    return _split(spark, plan) if _kind(plan) == "Join" else None


def _kept(df: DataFrame) -> DataFrame:
    """`df` in the shared folder; where the cluster names none, it is worked out again at each use."""
    try:
        return cut(df)
    except RuntimeError:
        return df


def _split(spark, join):
    if join.joinType().toString() != "Inner" or join.condition().isEmpty() or join.hint().toString() != spark._jvm.org.apache.spark.sql.catalyst.plans.logical.JoinHint.NONE().toString():
        return None
    left, right = join.left(), join.right()
    if not (_steady(left) and _steady(right)):
        return None
    of = spark._jvm.org.apache.spark.sql.classic.ExpressionUtils
    column = lambda e: Column(of.column(e))
    within = lambda e, side: not e.references().isEmpty() and e.references().subsetOf(side.outputSet())
    keys, tests, others = [], [], []
    for e in _conjuncts(join.condition().get()):
        kind = _kind(e)
        if not e.deterministic():
            return None
        if kind != "EqualTo" and kind not in _COMPARISONS:
            others.append(column(e))
            continue
        if within(e.left(), left) and within(e.right(), right):
            a, b = e.left(), e.right()
        elif within(e.left(), right) and within(e.right(), left):
            a, b, kind = e.right(), e.left(), _COMPARISONS.get(kind, kind)
        else:
            others.append(column(e))
            continue
        if kind == "EqualTo":
            keys.append((column(a), column(b)))
        else:
            tests.append((kind, column(a), column(b)))
    if not keys or not tests:
        return None
    k, t = [f"__k{i}" for i in range(len(keys))], [f"__t{i}" for i in range(len(tests))]
    sides = []
    for n, side in enumerate((left, right), 1):
        made = [pair[n - 1].alias(c) for c, pair in zip(k, keys)] + [test[n].alias(c) for c, test in zip(t, tests)]
        known = [F.col(c).isNotNull() for c in (*k, *t)]
        sides.append(_frame(spark, side).select("*", *made).where(reduce(Column.__and__, known)))
    a, b = sides
    kinds = [kind for kind, _, _ in tests]

    def bounds(rows: DataFrame, of_kinds: list[str], n: str) -> DataFrame:
        """One row a key: its rows, and of each compared value the one that most of the other side pass against."""
        return rows.groupBy(*k).agg(F.count(F.lit(1)).alias(n), *[(F.max if kind.startswith("Less") else F.min)(c).alias(f"{n}{c}") for kind, c in zip(of_kinds, t)])

    # seen from the left side a value must lie below the right side's largest, from the right side above the left's smallest
    seen = [_COMPARISONS[kind] for kind in kinds]
    at = bounds(a, seen, "__l").join(bounds(b, kinds, "__r"), k)
    if (at.agg(F.sum(F.col("__l").cast("double") * F.col("__r"))).first()[0] or 0) <= LIGHT_PAIRS:
        return None
    at = _kept(at)
    few = at.count() <= MOST_KEYS
    limits = F.broadcast(at) if few else at

    def passing(rows: DataFrame, of_kinds: list[str], n: str, known: DataFrame) -> DataFrame:
        out = rows.join(known, k)
        for kind, c in zip(of_kinds, t):
            out = out.where(_TESTS[kind](F.col(c), F.col(f"{n}{c}")))
        return out

    left_rows = passing(a, kinds, "__r", limits).groupBy(*k).agg(F.count(F.lit(1)).alias("__ln"))
    right_rows = passing(b, seen, "__l", limits).groupBy(*k).agg(F.count(F.lit(1)).alias("__rn"))
    at = _kept(at.join(left_rows, k).join(right_rows, k).withColumns({"__lp": F.ceil(F.col("__ln") / PLACE_ROWS[0]).cast("int"), "__rp": F.ceil(F.col("__rn") / PLACE_ROWS[1]).cast("int")}))
    pairs = at.agg(F.sum(F.col("__ln").cast("double") * F.col("__rn"))).first()[0] or 0
    limits = F.broadcast(at) if few else at
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -int(-pairs // TASK_PAIRS))

    def dealt(rows: DataFrame, side, of_kinds: list[str], other: str, mine: str, theirs: str) -> DataFrame:
        """The rows that may pass, each at one of its own side's places and at all of the other's."""
        whole = [column(x) for x in _seq(side.output())]
        own = [F.col(c) for c in (*k, *t)]
        by = [column(x) for x in _seq(side.output()) if x.dataType().simpleString().split("(")[0] in _HASHED]
        out = passing(rows, of_kinds, other, limits).withColumn(f"{mine}_at", F.pmod(F.xxhash64(*by, *own), F.col(mine)).cast("int"))
        return out.select(*whole, *own, f"{mine}_at", F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)).alias(f"{theirs}_at")).repartition(tasks, *k, "__lp_at", "__rp_at")

    a, b = dealt(a, left, kinds, "__r", "__lp", "__rp"), dealt(b, right, seen, "__l", "__rp", "__lp")
    on = [a[c] == b[c] for c in (*k, "__lp_at", "__rp_at")] + [_TESTS[kind](a[c], b[c]) for kind, c in zip(kinds, t)] + others
    both = a.hint("merge").join(b, on, "inner")
    return both.select(*[column(x) for x in _seq(join.output())])._jdf.queryExecution().analyzed()
