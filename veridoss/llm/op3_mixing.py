"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). A node's budget is dealt to its children by weight; no
child gets more than its subtree can give (its tokens times the epochs allowed). What one child
cannot use goes to its siblings, and, since a node's own capacity is the sum of its children's,
only what all siblings cannot use goes further up. The level is found in closed form: children
sorted by capacity over weight are filled while they saturate, the rest share in proportion.

A leaf's budget buys whole epochs and a token-prefix of one more, in the order of a seeded hash
of (epoch, document). Where the prefix ends is narrowed down by histograms of hash ranges, STEPS
times by a factor of 2**RANGE_BITS, and then among the hashes of one last range, so no task holds a
leaf: a hot source costs no more than others. The level to which a domain's and language's many
sources are filled is found in the same way, by histograms of capacity over weight. Selection itself
is narrow: no text is shuffled.

Defined results. Tokens are estimated as bytes over bytes_per_token, rounded up, plus one for
the document's end, so empty or null texts count 1 and very long ones their whole length. Null
domain, language or source is a node of its own. Rows that repeat an id, and rows with a null id, share
a hash: they are taken together. Ties in capacity over weight are filled alike. An empty table
gives no row. Extra columns pass through; an input column named like a result column (epoch,
mix_tokens, mix_order, mix_domain) gives way to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoss.llm.shared import fresh, keep, maybe_broadcast, named

LEVELS = ("domain", "lang", "source")
RANGE_BITS = 8
STEPS = 3
OCTAVE = 16  # first ranges of capacity over weight to a factor of two
RESULT = ("epoch", "mix_tokens", "mix_order", "mix_domain")
BROADCAST_LEAVES = 50_000


def estimated_tokens(text: Column, bytes_per_token: float = 4.0) -> Column:
    return (F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / bytes_per_token) + 1).cast("long")


def _fill(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Give each child its part of the column budget; children has cap and w."""
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = w.orderBy(F.col("cap") / F.col("w"), child)
    taken = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col("budget") - taken) / left
    got = children.withColumns({"__level": level, "__fits": F.col("cap") / F.col("w") <= level})
    open_level = F.min(F.when(~F.col("__fits"), F.col("__level"))).over(w)
    # the first child that does not saturate fixes the level of all the rest
    first = F.max(F.when(~F.col("__fits"), F.struct((-F.col("cap") / F.col("w")).alias("r"), F.col("__level").alias("l")))).over(w)["l"]
    share = F.coalesce(first, open_level)
    return got.withColumn("budget", F.when(F.col("__fits"), F.col("cap")).otherwise(F.least("cap", share * F.col("w")))).drop("__level", "__fits")


def _fill_many(spark: SparkSession, children: DataFrame, parent: list[str]) -> DataFrame:
    """What _fill gives, where a parent may have very many children: no task holds them all.

    Children up to a ratio r (capacity over weight) are full if their capacities and r times the other
    weights are within the budget. The last such ratio is narrowed down by ranges of its logarithm.
    """
    rows = keep(spark, children.withColumns({"r": F.col("cap") / F.col("w"), "x": F.log2(F.col("cap") / F.col("w")) * OCTAVE}), "children")
    whole = rows.groupBy(*parent).agg(F.sum("w").alias("left"), F.first("budget").alias("budget"))
    state = whole.withColumns({"full": F.lit(0.0), "r": F.lit(None).cast("double")})  # none is full yet
    inside = rows
    by = Window.partitionBy(*parent).orderBy("key")
    for step in range(STEPS + 1):
        key = F.floor(F.col("x") * (1 << RANGE_BITS * step)).cast("long") if step < STEPS else F.col("r")
        parts = inside.withColumn("key", key).groupBy(*parent, "key").agg(F.sum("cap").alias("cap"), F.sum("w").alias("w"), F.max("r").alias("m"))
        at = parts.join(state.select(*[F.col(c).alias(f"p_{c}") for c in parent], "budget", "full", "left", F.col("r").alias("old")), [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in parent])
        at = at.withColumns({"c": F.col("full") + F.sum("cap").over(by), "l": F.col("left") - F.sum("w").over(by)})
        at = at.withColumn("fits", F.col("c") + F.col("m") * F.greatest(F.col("l"), F.lit(0.0)) <= F.col("budget") * (1 + 1e-12))
        best = F.max(F.when(F.col("fits"), F.struct("key", "m", "c", "l")))
        edge = F.min(F.when(~F.col("fits"), F.col("key")))
        state = keep(spark, at.groupBy(*parent).agg(best.alias("best"), edge.alias("edge"), F.first("budget").alias("budget"), F.first("full").alias("full"), F.first("left").alias("left"), F.first("old").alias("old")).select(*parent, "budget", "edge", F.coalesce("best.c", "full").alias("full"), F.coalesce("best.l", "left").alias("left"), F.coalesce("best.m", "old").alias("r")), "levels")
        if step < STEPS:
            edges = state.where("edge IS NOT NULL").select(*[F.col(c).alias(f"p_{c}") for c in parent], "edge")
            inside = inside.withColumn("key", key).join(maybe_broadcast(edges, BROADCAST_LEAVES), [F.col("key") == F.col("edge"), *(F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in parent)]).select(*rows.columns)
            # a parent without an edge is settled; its row must outlive the steps that see no child of it
            over = state.where("edge IS NULL")
            settled = over if step == 0 else settled.unionByName(over)
            state = state.where("edge IS NOT NULL")
    done = settled.unionByName(state).select(*[F.col(c).alias(f"p_{c}") for c in parent], F.col("r").alias("upto"), ((F.col("budget") - F.col("full")) / F.when(F.col("left") > 0, F.col("left"))).alias("level"))
    got = rows.drop("budget").join(maybe_broadcast(done, BROADCAST_LEAVES), [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in parent])
    full = F.coalesce(F.col("r") <= F.col("upto"), F.lit(False))
    return got.withColumn("budget", F.when(full, F.col("cap")).otherwise(F.least("cap", F.greatest(F.lit(0.0), F.coalesce("level", F.lit(0.0))) * F.col("w"))))


def plan_leaves(spark: SparkSession, leaves: DataFrame, total: float, epochs: int, targets: dict[str, float] | None, alphas: tuple[float, float, float]) -> DataFrame:
    """leaves (domain, lang, source, tokens) with budget, whole epochs and the rest.

    targets: weights of domains by name (others weigh 0.01); None: tokens to the power alphas[0].
    """
    a, b, c = LEVELS
    cap = (F.col("tokens") * epochs).cast("double")
    level1 = leaves.groupBy(a).agg(F.sum("tokens").alias("tokens")).withColumns({"cap": cap, "budget": F.lit(float(total))})
    if targets:
        weight = F.coalesce(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])[F.coalesce(F.col(a), F.lit(""))], F.lit(0.01))
    else:
        weight = F.pow("tokens", F.lit(alphas[0]))
    level1 = _fill(level1.withColumn("w", weight), [], a).select(F.col(a).alias("__a"), "budget")
    level2 = leaves.groupBy(a, b).agg(F.sum("tokens").alias("tokens")).withColumns({"cap": cap, "w": F.pow("tokens", F.lit(alphas[1]))})
    level2 = level2.join(level1, F.col(a).eqNullSafe(F.col("__a"))).drop("__a")
    level2 = _fill(level2, [a], b).select(F.col(a).alias("__a"), F.col(b).alias("__b"), "budget")
    level3 = leaves.withColumns({"cap": cap, "w": F.pow("tokens", F.lit(alphas[2]))})
    level3 = level3.join(level2, F.col(a).eqNullSafe(F.col("__a")) & F.col(b).eqNullSafe(F.col("__b"))).drop("__a", "__b")
    return _fill_many(spark, level3, [a, b]).select(*LEVELS, "tokens", "budget", F.floor(F.col("budget") / F.col("tokens") + 1e-9).cast("int").alias("whole")).withColumn("rest", F.greatest(F.lit(0.0), F.col("budget") - F.col("whole") * F.col("tokens")))


def _hash(seed: int, epoch: Column, key: str) -> Column:
    return F.xxhash64(F.lit(seed), epoch, F.col(key))


def mix_sources(spark: SparkSession, docs: DataFrame, domain: Column, share: float = 0.8, epochs: int = 2, targets: dict[str, float] | None = None, alphas: tuple[float, float, float] = (0.7, 0.7, 0.5), seed: int = 17, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """docs' rows chosen for each epoch, with columns epoch, mix_tokens and mix_order added.

    The total budget is share times the tokens of all rows. Within (leaf, epoch) mix_order
    ascends in the seeded order. With epochs = 1 a row is chosen at most once.
    """
    names = [c for c in docs.columns if c.lower() not in RESULT]
    i, d, l, s, t, p, n, cut = fresh(names, "id", "d", "l", "s", "t", "p", "whole", "cut")  # noqa: E741
    keyed = docs.select(*[named(c) for c in names], named(id_col).cast("string").alias(i), domain.cast("string").alias(d), named(lang_col).cast("string").alias(l), named(source_col).cast("string").alias(s), estimated_tokens(named(text_col)).alias(t))
    light = keep(spark, keyed.select(F.col(i).alias("__id"), F.col(d).alias("domain"), F.col(l).alias("lang"), F.col(s).alias("source"), F.col(t).alias("t")), "lengths")
    leaves = light.groupBy(*LEVELS).agg(F.sum("t").alias("tokens"))
    total = share * (light.agg(F.sum("t")).first()[0] or 0)
    plan = keep(spark, plan_leaves(spark, leaves, total, epochs, targets, alphas), "plan")
    final = keep(spark, _cuts(light, plan, seed), "cuts").toDF(p, n, cut)
    on = F.col(p)["domain"].eqNullSafe(F.col(d)) & F.col(p)["lang"].eqNullSafe(F.col(l)) & F.col(p)["source"].eqNullSafe(F.col(s))
    chosen = keyed.join(maybe_broadcast(final, BROADCAST_LEAVES), on)
    none = F.array().cast("array<int>")
    turns = F.concat(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(none), F.when(_hash(seed, F.col(n), i) <= F.col(cut), F.array(n)).otherwise(none))
    out = chosen.select("*", F.explode(turns).alias("epoch"))
    return out.select(*[named(c) for c in names], F.col("epoch").cast("int"), F.col(t).alias("mix_tokens"), _hash(seed, F.col("epoch"), i).alias("mix_order"), F.col(d).alias("mix_domain"))


def _cuts(light: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """(leaf, whole epochs, last hash of the prefix or null): where each leaf's prefix ends."""
    on = [F.col(f"__p.{x}").eqNullSafe(F.col(x)) for x in LEVELS]
    leaf = plan.select(F.struct(*LEVELS).alias("__p"), "whole", "rest")
    inside = light.join(maybe_broadcast(leaf.where("rest > 0"), BROADCAST_LEAVES), on[0] & on[1] & on[2]).select("__p", "rest", _hash(seed, F.col("whole"), "__id").alias("h"), "t")
    inside = inside.withColumns({"before": F.lit(0).cast("long"), "below": F.lit(None).cast("long")})
    full = None
    for step in range(STEPS):
        ranged = inside.withColumn("range", F.shiftright("h", 64 - RANGE_BITS * (step + 1)))
        summed = ranged.groupBy("__p", "range").agg(F.sum("t").alias("t"), F.first("rest").alias("rest"), F.first("before").alias("before"), F.max("h").alias("h"), F.first("below").alias("below"))
        w = Window.partitionBy("__p").orderBy("range")
        upto = summed.withColumns({"upto": F.col("before") + F.sum("t").over(w), "last": F.coalesce(F.lag("h").over(w), "below")})
        cut = upto.where("upto > rest AND upto - t <= rest").select("__p", "range", (F.col("upto") - F.col("t")).alias("before"), F.col("last").alias("below"))
        cut = keep(light.sparkSession, cut, "edges")
        if step == 0:  # leaves that are taken whole have no edge
            full = leaf.where("rest > 0").join(cut.select(F.col("__p").alias("__q")), F.col("__p").eqNullSafe(F.col("__q")), "left_anti").select("__p", F.lit((1 << 63) - 1).cast("long").alias("cut"))
        inside = ranged.drop("before", "below").join(maybe_broadcast(cut, BROADCAST_LEAVES), ["__p", "range"]).drop("range")
    once = inside.groupBy("__p", "h").agg(F.sum("t").alias("t"), F.first("rest").alias("rest"), F.first("before").alias("before"), F.first("below").alias("below"))
    so_far = F.col("before") + F.sum("t").over(Window.partitionBy("__p").orderBy("h"))
    ends = once.withColumn("so_far", so_far).groupBy("__p").agg(F.coalesce(F.max(F.when(F.col("so_far") <= F.col("rest"), F.col("h"))), F.first("below")).alias("cut"))
    ends = ends.unionByName(full).select(F.col("__p").alias("__q"), "cut")
    return leaf.join(ends, F.col("__p").eqNullSafe(F.col("__q")), "left").select("__p", "whole", "cut").where("whole > 0 OR cut IS NOT NULL")


def fill_exact(budget: float, caps: list[float], weights: list[float]) -> list[float]:
    """Brute-force counterpart of the level rule, for tests: fill, cap, redistribute, repeat."""
    got = [0.0] * len(caps)
    active, left = set(range(len(caps))), min(budget, math.fsum(caps))
    while active and left > 1e-9:
        whole = math.fsum(weights[i] for i in active)
        full = {i for i in active if got[i] + left * weights[i] / whole >= caps[i] - 1e-12}
        if not full:
            for i in active:
                got[i] += left * weights[i] / whole
            break
        for i in full:
            left -= caps[i] - got[i]
            got[i] = caps[i]
        active -= full
        # start over for those that remain, from nothing
        left += math.fsum(got[i] for i in active)
        for i in active:
            got[i] = 0.0
    return got
