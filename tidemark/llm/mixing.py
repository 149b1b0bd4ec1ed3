"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.joins import join_checked
from tidemark.session import written

#: Ranges of the seeded order of a leaf; only one of them is cut within.
RANGES = 4096


def _key(value: Column) -> Column:
    """A value as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def _value(key: str) -> Column:
    return F.when(F.substring(key, 1, 1) == "=", F.expr(f"substring({key}, 2)"))


def _fill(nodes: DataFrame, parent: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`nodes` (..., w, c, amount) with `budget`: the amount of each parent shared out over its children by weight w, none above its capacity c.

    What a child can't take goes to its siblings, by weight. The children stand in the order in which they are filled: the level that the amount reaches is the greatest of (amount -
    capacities before) / (weights from here on).
    """
    by = W.partitionBy(*parent)
    at = by.orderBy(F.col("c") / F.col("w"), *order)
    before = F.coalesce(F.sum("c").over(at.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("amount") - before) / F.sum("w").over(at.rowsBetween(0, W.unboundedFollowing))
    return nodes.where("w > 0 and c > 0").withColumn("_level", level).withColumn("budget", F.least(F.col("c"), F.max("_level").over(by) * F.col("w"))).drop("_level")


def budgets(sizes: DataFrame, targets: DataFrame, *, levels: Sequence[str] = ("domain", "lang", "source"), size: str = "tokens", share: str = "target_share", repeats: str = "max_repeats", total: int | None = None, weights: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """(levels..., size, repeats, budget): how much each leaf of the tree gives. `sizes` has rows (levels..., size), any number a leaf; sizes are not negative.

    The last level has the targets. A leaf's weight is its source's target share times the leaf's part of the source's size; a node's weight is the sum of its leaves', unless `weights` has the
    level: then it is that of the node's value, and values that aren't listed give nothing. So without `weights` every source's leaves add up to its target. Amounts come down the tree from `total` (null: all that the sources
    with a target hold). What a node can't give, with repeats, goes to its siblings, in proportion to their weights, and beyond what these can give to its parent's siblings. If the whole tree can't give `total`, every leaf gives all it has.
    Leaves without size, weight or repeats aren't listed.
    """
    levels = list(levels)
    keys = [f"_l{i}" for i in range(len(levels))]
    want = targets.select(_key(F.col(levels[-1])).alias(keys[-1]), F.col(share).cast("double").alias("_w"), F.greatest(F.coalesce(F.col(repeats).cast("long"), F.lit(1)), F.lit(0)).alias("repeats")).where(F.col(levels[-1]).isNotNull())
    want = want.groupBy(keys[-1]).agg(F.greatest(F.coalesce(F.max("_w"), F.lit(0.0)), F.lit(0.0)).alias("_w"), F.max("repeats").alias("repeats"))
    leaves = sizes.groupBy(*(_key(F.col(c)).alias(k) for k, c in zip(keys, levels, strict=True))).agg(F.sum(size).cast("long").alias("size"))
    leaves = join_checked(leaves, want, [keys[-1]]).where("size > 0")
    own = leaves.groupBy(keys[-1]).agg(F.sum("size").alias("_all"))
    leaves = leaves.join(own, keys[-1])
    leaves = leaves.select(*keys, "size", "repeats", (F.col("_w") * F.col("size") / F.col("_all")).alias("w"), (F.col("size") * F.col("repeats")).cast("double").alias("c"))
    given = {i: F.create_map(*(F.lit(x) for v, w in weights[c].items() for x in (v, float(max(w, 0))))) for i, c in enumerate(levels) if c in (weights or {})}
    for i, m in given.items():
        g = F.coalesce(F.try_element_at(m, _value(keys[i])), F.lit(0.0))
        leaves = leaves.withColumns({"c": F.when(g > 0, F.col("c")).otherwise(0.0), f"_g{i}": g})
    leaves = written(leaves, "leaves")
    held, can = leaves.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("c"))), F.lit(0.0))).first()
    amounts, parent = None, []
    for i in range(len(levels)):
        node = keys[: i + 1]
        more = [F.max(f"_g{i}").alias("_g")] if i in given else []
        nodes = leaves.where("w > 0").groupBy(*node).agg(F.sum("w").alias("w"), F.sum("c").alias("c"), *more)
        if i in given:
            nodes = nodes.withColumn("w", F.col("_g")).drop("_g")
        nodes = nodes.withColumn("amount", F.lit(min(float(held if total is None else total), can))) if amounts is None else nodes.join(amounts, parent)
        parent, amounts = node, _fill(nodes, parent, node).select(*node, F.col("budget").alias("amount"))
    out = leaves.select(*keys, "size", "repeats").join(amounts.withColumnRenamed("amount", "budget"), keys)
    return out.select(*(_value(k).alias(c) for k, c in zip(keys, levels, strict=True)), "size", "repeats", "budget")


def mix(df: DataFrame, targets: DataFrame, *, levels: Sequence[str] = ("domain", "lang", "source"), ident: str = "doc_id", tokens: str = "tokens", share: str = "target_share", repeats: str = "max_repeats", total: int | None = None, weights: Mapping[str, Mapping[str, float]] | None = None, seed: int = 17) -> DataFrame:
    """(ident, levels..., copies, tokens): how often each document goes into the mixture; documents that don't aren't listed.

    `targets` has one row for each value of the last of `levels`: its share of all tokens and how often one of its documents may occur at most (of several rows the greatest counts). Values without a target
    or with a null or 0 share give nothing; a null `repeats` is 1. A null level is a value like any other, but has no target. Null or negative sizes count as 0. `total` is the size wanted.

    Budgets come down the tree of `levels` (`budgets`). A leaf gives whole epochs of all its documents, and of
    the next epoch a prefix, in an order seeded by `seed` and epoch, up to the first document that would exceed its budget: so a leaf stays below it by less than one document.
    The order is cut into RANGES ranges of the hash; of a leaf, range sums tell where the prefix ends, and only that range is summed document by document.
    Rows with the same id are documents of their own, that lie together in the order. Nothing but two sums goes to the driver.
    """
    levels = list(levels)
    keys = [f"_l{i}" for i in range(len(levels))]
    docs = df.select(F.col(ident).alias("_i"), *(_key(F.col(c)).alias(k) for k, c in zip(keys, levels, strict=True)), F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0)).alias("_t"))
    plain = docs.select(*(_value(k).alias(c) for k, c in zip(keys, levels, strict=True)), F.col("_t").alias("size"))
    leaf = budgets(plain, targets, levels=levels, size="size", share=share, repeats=repeats, total=total, weights=weights)
    epochs = F.least(F.floor((F.col("budget") + 1e-6) / F.col("size")).cast("long"), F.col("repeats"))
    leaf = leaf.select(*(_key(F.col(c)).alias(k) for k, c in zip(keys, levels, strict=True)), epochs.alias("_epochs"), (F.col("budget") + 1e-6 - epochs * F.col("size")).alias("_left"))
    known = join_checked(docs, written(leaf, "leaf"), keys)
    known = known.withColumn("_h", F.xxhash64(F.lit(seed), F.col("_epochs"), F.col("_i"))).withColumn("_b", F.pmod(F.shiftright("_h", 40), F.lit(RANGES)))
    sums = known.groupBy(*keys, "_b").agg(F.sum("_t").alias("_s"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = known.join(sums, [*keys, "_b"])
    whole = F.col("_before") + F.col("_s") <= F.col("_left")
    sure = placed.where(whole | (F.col("_before") >= F.col("_left"))).withColumn("_in", (whole & (F.col("_left") > 0)).cast("long"))
    edge = placed.where(~whole & (F.col("_before") < F.col("_left")))
    upto = F.sum("_t").over(W.partitionBy(*keys).orderBy("_h", "_i", "_t").rowsBetween(W.unboundedPreceding, 0))
    edge = edge.withColumn("_in", (F.col("_before") + upto <= F.col("_left")).cast("long"))
    both = sure.unionByName(edge).withColumn("copies", F.col("_epochs") + F.col("_in")).where("copies > 0")
    return both.select(F.col("_i").alias(ident), *(_value(k).alias(c) for k, c in zip(keys, levels, strict=True)), "copies", F.col("_t").alias("tokens"))


def shares(mixed: DataFrame, targets: DataFrame, *, level: str = "source", share: str = "target_share") -> DataFrame:
    """(level, target_share, docs, rows, tokens, actual_share, most_copies): what each target really got; targets without documents show 0.

    `rows` counts repeats, `docs` doesn't; the shares are of all tokens of the mixture (null if it has none).
    """
    got = mixed.groupBy(F.col(level).alias("_s")).agg(F.count("*").alias("docs"), F.sum("copies").alias("rows"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.max("copies").alias("most_copies"))
    want = targets.select(F.col(level).cast("string").alias("_w"), F.col(share).alias("target_share"))
    both = want.join(got, F.col("_w") == F.col("_s"), "left").na.fill(0, ["docs", "rows", "tokens", "most_copies"])
    return both.select(F.col("_w").alias(level), "target_share", "docs", "rows", "tokens", F.try_divide(F.col("tokens"), F.sum("tokens").over(W.partitionBy())).alias("actual_share"), "most_copies")  # one row a target
