"""Mixing sources to target weights.

The corpus becomes a small table of cells (source, language, topic) with their tokens. Iterative
proportional fitting rakes the cells' weights to the target shares of sources and to the marginals
of languages and topics; no weight may exceed its source's repeat limit. Documents are then drawn
by their cell's weight: the whole part as full repeats, the rest by chance, each document by a draw of
its own (a hash of its key), so nothing is sorted or grouped and any size is drawn alike. What chance
leaves over or short of a source's target is then made up by the best-fitting documents, one copy more
or less of each. Only cells and sizes ever reach the driver; their numbers are bounded by the values of
the three columns and by the classes of size, not by the documents.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.scratch import cut
from quern.plans.sizing import sized_join

#: Rounds of fitting at most, and the relative change below which it has settled.
ROUNDS, SETTLED = 2000, 1e-9
#: Sizes below this are classes of their own; above there are so many classes to each doubling.
EXACT_SIZES, SIZE_CLASSES = 1024, 64
NONE = "none"


def topic_of(repo: Column) -> Column:
    """Topic of a document: the kind of data set its repository holds (the word before the number), none without a repository."""
    kind = F.regexp_extract(repo, "-([a-z]+)(?:-[0-9]+)?$", 1)
    return F.coalesce(F.when(kind != "", kind), F.lit(NONE))


@dataclass
class Fit:
    """Weights (repeats per document) of cells, and what they reach."""

    weights: np.ndarray
    #: Tokens to be drawn in all, and of each source.
    scale: float
    budgets: np.ndarray
    rounds: int
    settled: bool


def rake(tokens: np.ndarray, source: np.ndarray, shares: np.ndarray, limits: np.ndarray, others: list[np.ndarray]) -> Fit:
    """Fit cell weights to source shares exactly and to the other marginals as far as sources and limits allow.

    `tokens`: per cell. `source`: its source's number; `shares` and `limits` per source. `others`:
    for each further marginal the number of each cell's value; its target is the value's share of
    the corpus tokens. Weights are fitted in shares of tokens; the source step is last, so source
    shares hold exactly. The total is the largest at which no cell's weight exceeds its source's
    limit (within a source, cells above the limit are held at it and the rest takes up the slack).
    """
    n_src = len(shares)
    src_tokens = np.bincount(source, tokens, n_src)
    live = (src_tokens > 0) & (shares > 0)
    wanted = np.where(live, shares, 0.0)
    if not live.any():
        return Fit(np.zeros(len(tokens)), 0.0, np.zeros(n_src), 0, True)
    wanted = wanted / wanted.sum()
    natural = tokens / tokens.sum()
    mass = np.where(live[source], wanted[source] * tokens / np.maximum(src_tokens[source], 1e-300), 0.0)
    # a value can reach at most what its live sources could give; its target is its natural share there
    rounds, settled = 0, True
    for rounds in range(1, ROUNDS + 1):
        before = mass.copy()
        for values in others:
            target = np.bincount(values, natural * live[source], values.max() + 1)
            target = target / max(target.sum(), 1e-300)
            now = np.bincount(values, mass, len(target))
            # damped, so conflicting marginals settle between source shares and these targets
            ratio = np.where(now > 0, np.sqrt(np.where(now > 0, target, 1.0) / np.where(now > 0, now, 1.0)), 1.0)
            mass = mass * ratio[values]
        now = np.bincount(source, mass, n_src)
        mass = mass * np.where(now > 0, wanted / np.where(now > 0, now, 1.0), 0.0)[source]
        if settled := bool(np.abs(mass - before).max() <= SETTLED):
            break
    if not settled:
        warnings.warn(f"weights still change by {np.abs(mass - before).max():.1e} after {rounds} rounds: the marginals contradict each other", stacklevel=2)
    # the largest total that the sources' limits allow
    with np.errstate(divide="ignore", invalid="ignore"):
        total = np.min(np.where(live, limits * src_tokens / np.where(live, wanted, 1.0), np.inf))
    weights = np.zeros(len(tokens))
    for s in np.flatnonzero(live):
        cells = np.flatnonzero((source == s) & (tokens > 0))
        budget = total * wanted[s]
        free, w = cells, np.zeros(len(tokens))
        share = mass[cells].copy()
        if share.sum() <= 0:
            share = tokens[cells].astype(float)
        raw = dict(zip(cells, share))
        while len(free):
            part = np.array([raw[c] for c in free])
            if part.sum() <= 0:
                part = tokens[free].astype(float)
            trial = budget * part / part.sum() / tokens[free]
            over = trial > limits[s] * (1 + 1e-12)
            if not over.any():
                w[free] = trial
                break
            for c in free[over]:
                w[c] = limits[s]
                budget -= limits[s] * tokens[c]
            free = free[~over]
            budget = max(budget, 0.0)
        weights[cells] = np.minimum(w[cells], limits[s])
    return Fit(weights, float(total), total * wanted, rounds, settled)


def corrections(short: float, more: list[tuple[int, int]], less: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(size, +1 or -1, how many) of the copies to add and to take away so that `short` tokens more (or fewer, if negative) are drawn.

    `more` and `less` are (size, documents) that one copy can be added of or taken from. Each step
    takes the size that comes closest to what is missing, as often as it fits; it ends when no copy
    brings the sum nearer, so less than half of the smallest size that is left stays missing.
    """
    left = {1: dict(more), -1: dict(less)}
    done: dict[tuple[int, int], int] = {}
    while short:
        sign = 1 if short > 0 else -1
        gap, sizes = abs(short), left[sign]
        best = min((s for s, n in sizes.items() if n > 0), key=lambda s: (abs(gap - s), s), default=None)
        if best is None or abs(gap - best) >= gap:
            break
        n = max(1, min(sizes[best], int(gap // best)))
        sizes[best] -= n
        done[(best, sign)] = done.get((best, sign), 0) + n
        short -= sign * n * best
    return [(size, sign, n) for (size, sign), n in sorted(done.items())]


def mix(sized: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 17) -> DataFrame:
    """`key`, source, lang, topic, n_tokens, weight and copies (how often to use the document) of every row of `sized`.

    `sized` holds `key`, source, lang, topic and n_tokens; `targets` source, target_share and
    max_repeats. Each source makes up its target share of the tokens drawn and no document is used
    more than its source's max_repeats times. Documents without a source, of a source without a
    target (or with a null or negative one) and without tokens get weight 0. A target whose source
    has no tokens cannot be met; the others then share the whole. Targets given twice count once.
    The same input and seed give the same draw. The tokens of each source come as near to its target
    as its documents allow (`corrections`).
    """
    spark = sized.sparkSession
    wanted = [r for r in targets.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("limit")).collect() if r["source"] is not None and (r["share"] or 0) > 0 and (r["limit"] or 0) > 0]
    wanted.sort(key=lambda r: r["source"])
    celled = sized.select(key, "source", "n_tokens", *(F.coalesce(c, F.lit(NONE)).alias(c) for c in ("lang", "topic")))
    names = [r["source"] for r in wanted]
    cells = celled.where(F.col("source").isin(names) & (F.col("n_tokens") > 0)).groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect() if names else []
    cells.sort(key=lambda r: (r["source"], r["lang"], r["topic"]))
    rows, budgets = [], {}
    if cells:
        number = {s: i for i, s in enumerate(names)}
        enum = lambda vs: {v: i for i, v in enumerate(sorted(set(vs)))}
        li, ti = enum(r["lang"] for r in cells), enum(r["topic"] for r in cells)
        limits = np.array([float(r["limit"]) for r in wanted])
        fit = rake(
            np.array([float(r["t"]) for r in cells]),
            np.array([number[r["source"]] for r in cells]),
            np.array([float(r["share"]) for r in wanted]),
            limits,
            [np.array([li[r["lang"]] for r in cells]), np.array([ti[r["topic"]] for r in cells])],
        )
        budgets = dict(zip(names, fit.budgets))
        rows = [(r["source"], r["lang"], r["topic"], float(w), int(limits[number[r["source"]]])) for r, w in zip(cells, fit.weights)]
    weights = spark.createDataFrame(rows, "source string, lang string, topic string, weight double, limit int")
    out = sized_join(celled, weights, ["source", "lang", "topic"], "left")
    live = (F.col("n_tokens") > 0) & F.col("weight").isNotNull()
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11) / float(1 << 53)
    weight = F.when(live, F.col("weight")).otherwise(0.0)
    drawn = out.select(
        key, "source", "lang", "topic", "n_tokens", weight.alias("weight"),
        F.when(live, F.floor("weight") + (chance < F.col("weight") - F.floor("weight")).cast("long")).otherwise(0).cast("int").alias("copies"),
        F.when(live, F.col("limit")).otherwise(0).alias("__limit"),
    )
    moves = _moves(drawn, budgets)
    if moves:
        # the few documents that make up for chance: those with the smallest hash of their size
        wanted_moves = spark.createDataFrame(moves, "source string, n_tokens long, __sign int, __many long")
        able = drawn.select(key, "source", F.col("n_tokens").cast("long").alias("n_tokens"), F.explode(F.array_compact(F.array(F.when(F.col("copies") < F.col("__limit"), 1), F.when(F.col("copies") > 0, -1)))).alias("__sign"))
        w = Window.partitionBy("source", "n_tokens", "__sign").orderBy(F.xxhash64(F.lit(seed + 1), F.col(key)), key)
        ranked = sized_join(able, wanted_moves, ["source", "n_tokens", "__sign"]).withColumn("__r", F.row_number().over(w))
        # the plain bound lets each task keep only so many before the exchange
        chosen = ranked.where((F.col("__r") <= max(m[3] for m in moves)) & (F.col("__r") <= F.col("__many"))).groupBy(key).agg(F.sum("__sign").alias("__sign"))
        drawn = sized_join(drawn, cut(chosen), key, "left").withColumn("copies", (F.col("copies") + F.coalesce("__sign", F.lit(0))).cast("int"))
    return drawn.select(key, "source", "lang", "topic", "n_tokens", "weight", "copies")


def _moves(drawn: DataFrame, budgets: dict[str, float]) -> list[tuple[str, int, int, int]]:
    """(source, n_tokens, sign, how many) of the corrections of every source, from one aggregate over sizes."""
    if not budgets:
        return []
    own = drawn.where(F.col("__limit") > 0)
    total = {r["source"]: int(r["t"]) for r in own.groupBy("source").agg(F.sum(F.col("n_tokens").cast("long") * F.col("copies")).alias("t")).collect()}
    sizes = own.groupBy("source", F.col("n_tokens").cast("long").alias("n_tokens")).agg(F.count_if(F.col("copies") < F.col("__limit")).alias("more"), F.count_if(F.col("copies") > 0).alias("less"))
    octave = F.floor(F.log2(F.col("n_tokens") / EXACT_SIZES) * SIZE_CLASSES)
    one = F.when(F.col("n_tokens") < EXACT_SIZES, F.col("n_tokens")).otherwise(EXACT_SIZES + octave)
    # of each class of sizes one size takes part
    least = lambda c: F.min(F.when(F.col(c) > 0, F.struct("n_tokens", c))).alias(c)
    more: dict[str, list] = {}
    less: dict[str, list] = {}
    for r in sizes.groupBy("source", one.alias("class")).agg(least("more"), least("less")).collect():
        for c, into in (("more", more), ("less", less)):
            if r[c] is not None:
                into.setdefault(r["source"], []).append((int(r[c]["n_tokens"]), int(r[c][c])))
    return [(s, size, sign, n) for s, budget in sorted(budgets.items()) for size, sign, n in corrections(budget - total.get(s, 0), more.get(s, []), less.get(s, []))]


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """The report: source, documents, tokens, tokens_drawn, most_copies, max_repeats, target_share, share reached and limiting.

    `limiting` marks the source whose tokens and repeat limit set the total of the mixture: with more of
    it more of all could be drawn. Sources without a target are reported with target_share null and nothing drawn; targets without
    documents with zeros; documents without a source under a null source.
    """
    per = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("n_tokens").cast("long")).alias("tokens"),
        F.sum(F.col("n_tokens").cast("long") * F.col("copies")).alias("drawn"), F.coalesce(F.max("copies"), F.lit(0)).alias("most_copies"),
    )
    wanted = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    j = per.join(wanted, per.source.eqNullSafe(wanted.source), "full_outer").select(F.coalesce(per.source, wanted.source).alias("source"), "documents", "tokens", "drawn", "most_copies", "target_share", "max_repeats")
    zero = lambda c: F.coalesce(c, F.lit(0))
    # the report has a row per source, so this window is over a handful of rows
    everything = F.sum("drawn").over(Window.partitionBy(F.lit(0)))
    room = F.when((F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0), F.col("tokens") * F.col("max_repeats") / F.col("target_share"))
    return j.select(
        "source",
        zero("documents").alias("documents"),
        zero("tokens").alias("tokens"),
        zero("drawn").alias("tokens_drawn"),
        zero("most_copies").alias("most_copies"),
        "max_repeats",
        "target_share",
        F.coalesce(F.col("drawn") / F.nullif(everything, F.lit(0)), F.lit(0.0)).alias("share"),
        F.coalesce(room == F.min(room).over(Window.partitionBy(F.lit(0))), F.lit(False)).alias("limiting"),
    )


def marginals(mixed: DataFrame) -> DataFrame:
    """The report on languages and topics: marginal (lang or topic), value, documents, target_share (the corpus' own), raked_share (by weights) and share (as drawn), all in tokens.

    Targets give way where they contradict the sources' shares or the repeat limits.
    """
    tokens = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))
    long = mixed.select(F.inline(F.array(F.struct(F.lit("lang").alias("marginal"), F.col("lang").alias("value")), F.struct(F.lit("topic").alias("marginal"), F.col("topic").alias("value")))), tokens.alias("t"), (tokens * F.col("copies")).alias("d"), (tokens * F.col("weight")).alias("w"))
    per = long.groupBy("marginal", "value").agg(F.count(F.lit(1)).alias("documents"), F.sum("t").alias("t"), F.sum("w").alias("w"), F.sum("d").alias("d"))
    of = lambda c: F.coalesce(F.col(c) / F.nullif(F.sum(c).over(Window.partitionBy("marginal")), F.lit(0)), F.lit(0.0))
    return per.select("marginal", "value", "documents", of("t").alias("target_share"), of("w").alias("raked_share"), of("d").alias("share"))
