"""Irregular readings onto a regular grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.joins import join_checked
from tidemark.operators.readings import floor_to
from tidemark.session import written

#: Slots of a block: what one task orders at a time, whatever the length of a source.
BLOCK_SLOTS = 4096


def regular_grid(df: DataFrame, steps: DataFrame, *, entity: str = "series_id", time_ms: str = "ts_ms", value: str = "value", seq: str = "seq", step: str = "scrape_ms", max_gap_slots: int = 3, off_ms: int | None = None, keep_off: bool = True) -> DataFrame:
    """One row for each slot of `step` ms between an entity's first and last reading.

    `steps` has (entity, step), one row for each entity to put on a grid; entities without a row, and steps
    that are null or not positive, are left out. Rows of `df` with null entity, time or value are dropped.
    A slot takes its latest reading; readings at the same ms are settled by the highest `seq`, then by the greater value.

    Columns: entity, `slot_ms`, `value` (null if not known), `n` (readings' rows in the slot), `state`:
    "observed"; "filled" with the last value, up to `max_gap_slots` slots after it; "missing"; "off", in an unbroken
    run of empty slots that together last more than `off_ms` (null: there is no such state).
    With `keep_off` False the slots of "off" runs aren't made at all, so the result is no longer than the activity.

    Slots are made for blocks of BLOCK_SLOTS, left joined to the readings gathered by slot, and filled within a
    block; what was last known before a block comes from a summary of one row a block. So no task ever holds a whole source.
    """
    st = steps.select(F.col(entity).alias("_e"), F.col(step).cast("long").alias("_w")).where("_w > 0").groupBy("_e").agg(F.min("_w").alias("_w"))
    rows = df.select(F.col(entity).alias("_e"), F.col(time_ms).alias("_t"), F.col(value).cast("double").alias("_v"), F.coalesce(F.col(seq).cast("long"), F.lit(-(2**63))).alias("_q")).where("_e is not null and _t is not null and _v is not null")
    rows = join_checked(rows, st, ["_e"]).withColumn("_slot", floor_to(F.col("_t"), F.col("_w")))
    rows = rows.select("_e", "_w", "_slot", (F.col("_t") - F.col("_slot")).alias("_t"), "_v", "_q")
    # The slot's latest reading: time, then seq, then value. Partial aggregates on primitive buffers only.
    tie = rows.repartition("_e", "_slot").groupBy("_e", "_slot", "_w", "_t", "_q").agg(F.max("_v").alias("_v"), F.count("*").alias("_c"))
    at = tie.groupBy("_e", "_slot", "_w", "_t").agg(F.max_by("_v", "_q").alias("_v"), F.sum("_c").alias("_c"))
    seen = at.groupBy("_e", "_slot", "_w").agg(F.max_by("_v", "_t").alias("_v"), F.sum("_c").alias("_c"))
    seen = written(seen.withColumn("_blk", F.floor(F.col("_slot") / F.col("_w") / BLOCK_SLOTS).cast("long")), "slots")  # the readings are gathered once, for the ends of blocks and for the join

    # One row a block with readings: its first and last occupied slot, and what was known before it.
    ends = seen.groupBy("_e", "_w", "_blk").agg(F.min("_slot").alias("_lo"), F.max("_slot").alias("_hi"), F.max_by("_v", "_slot").alias("_hv"))
    by = W.partitionBy("_e").orderBy("_blk")
    ends = ends.select("_e", "_w", "_lo", "_hi", F.lag("_hi").over(by).alias("_b"), F.lag("_hv").over(by).alias("_bv"))
    # Each makes the slots after the previous block's last reading, up to its own last one.
    first = F.coalesce(F.col("_b") + F.col("_w"), F.col("_lo"))
    if off_ms is not None and not keep_off:
        first = F.when(F.col("_lo") - F.col("_b") - F.col("_w") > off_ms, F.col("_lo")).otherwise(first)
    width = F.col("_w") * BLOCK_SLOTS
    made = ends.withColumn("_from", first).withColumn("_blk", F.explode(F.sequence(F.floor(F.col("_from") / width).cast("long"), F.floor(F.col("_hi") / width).cast("long"))))
    slots = made.withColumn("_slot", F.explode(F.sequence(F.greatest("_from", F.col("_blk") * width), F.least("_hi", (F.col("_blk") + 1) * width - F.col("_w")), F.col("_w"))))
    full = slots.drop("_from", "_hi").join(seen.select("_e", "_slot", "_v", "_c"), ["_e", "_slot"], "left")

    here = W.partitionBy("_e", "_blk").orderBy("_slot")
    seen_slot = F.when(F.col("_c").isNotNull(), F.col("_slot"))
    full = full.withColumns({"_p": F.last(seen_slot, ignorenulls=True).over(here), "_pv": F.last(F.when(F.col("_c").isNotNull(), F.col("_v")), ignorenulls=True).over(here)})
    early = F.col("_slot") < F.col("_lo")  # before the block's first reading: the summary knows the neighbours
    p, pv = F.when(early, F.col("_b")).otherwise(F.col("_p")), F.when(early, F.col("_bv")).otherwise(F.col("_pv"))
    state = F.when(F.col("_c").isNotNull(), "observed")
    if off_ms is not None:
        # Slots after the same reading form one run; its last slot tells how long it is.
        run = F.when(early, F.col("_lo") - F.col("_b") - F.col("_w")).otherwise(F.max("_slot").over(W.partitionBy("_e", "_blk", "_p", "_lo")) - F.col("_p"))
        full = full.withColumn("_run", run)
        state = state.when(F.col("_run") > off_ms, "off")
    state = state.when(F.col("_slot") - p <= F.lit(max_gap_slots) * F.col("_w"), "filled").otherwise("missing")
    out = full.select(F.col("_e").alias(entity), F.col("_slot").alias("slot_ms"), pv.alias("_val"), F.coalesce("_c", F.lit(0)).alias("n"), state.alias("state"))
    if not keep_off:
        out = out.where("state <> 'off'")
    return out.select(entity, "slot_ms", F.when(F.col("state").isin("observed", "filled"), F.col("_val")).alias("value"), "n", "state")
