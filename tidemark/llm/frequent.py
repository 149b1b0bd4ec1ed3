"""Most frequent values in bounded memory: a majority-vote sketch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import join_checked
from tidemark.session import ship, written

#: Hash rows and cells of a row of the sketch of one name. See `sketch` for what they guarantee.
ROWS, CELLS = 4, 2048
#: Names whose sketches a task holds; the cells of further ones it passes on after each block, as sketches merge.
NAMES = 64
#: Rows that are counted together before they are added to a sketch.
BLOCK = 400_000


def cell(value: Column, row: int, cells: int = CELLS) -> Column:
    """The cell of a value in a row of the sketch."""
    return F.pmod(F.xxhash64(value, F.lit(row)), F.lit(cells)).cast("int")


def _key(name: Column) -> Column:
    """A name as a key that is never null: "1" and the name, or "0" for none."""
    return F.when(name.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), name.cast("string")))


def _name(key: str) -> Column:
    return F.when(F.substring(key, 1, 1) == "1", F.expr(f"substring({key}, 2)"))


class _Sketch:
    """The cells of one row of the sketch of one name."""

    def __init__(self, cells: int) -> None:
        self.total, self.votes = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        self.candidate = np.full(cells, None, object)

    def add(self, cells: np.ndarray, total: np.ndarray, theirs: np.ndarray, surplus: np.ndarray) -> None:
        """Merges cells of another sketch, each once, by vote cancellation."""
        held, mine = self.votes[cells], self.candidate[cells]
        same = mine == theirs
        self.votes[cells] = np.where(same, held + surplus, np.abs(held - surplus))
        self.candidate[cells] = np.where(same | (held >= surplus) & (held > 0), mine, theirs)
        self.total[cells] += total


def _partials(rows: int, cells: int):  # noqa: ANN202
    names_out = ["name", "row", "cell", "total", "candidate", "votes"]

    def batch(names: np.ndarray, row: int, at: np.ndarray, total: np.ndarray, candidate: np.ndarray, votes: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(names, pa.string()), pa.array(np.full(len(at), row), pa.int32()), pa.array(at, pa.int32()), pa.array(total, pa.int64()), pa.array(candidate, pa.string()), pa.array(votes, pa.int64())], names_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[_Sketch]] = {}
        block: list[pa.RecordBatch] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            """The cells of a block of rows, of all its names at once; those of names that are held are merged, the others passed on."""
            counts = pa.Table.from_batches(block).group_by(["n", "v"]).aggregate([("v", "count"), *((f"c{r}", "min") for r in range(rows))])
            code = counts["n"].combine_chunks().dictionary_encode()
            names, code = code.dictionary.to_numpy(zero_copy_only=False), code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            values, n = counts["v"].to_numpy(zero_copy_only=False), counts["v_count"].to_numpy()
            for name in names:
                if len(held) >= NAMES:
                    break
                if name not in held:
                    held[name] = [_Sketch(cells) for _ in range(rows)]
            for r in range(rows):
                key = code * cells + counts[f"c{r}_min"].to_numpy()
                order = np.lexsort((n, key))
                key = key[order]
                first = np.flatnonzero(np.diff(key, prepend=-1))
                last = np.append(first[1:], len(key)) - 1
                total, best, at = np.add.reduceat(n[order], first), order[last], key[last]
                surplus = np.maximum(0, 2 * n[best] - total)
                whose, at = at // cells, at % cells
                edges = np.append(np.flatnonzero(np.diff(whose, prepend=-1)), len(whose))
                away = np.ones(len(whose), bool)
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if (mine := held.get(names[whose[a]])) is not None:
                        mine[r].add(at[a:b], total[a:b], values[best[a:b]], surplus[a:b])
                        away[a:b] = False
                if away.any():
                    yield batch(names[whose[away]], r, at[away], total[away], values[best[away]], surplus[away])

        for b in batches:
            block.append(b)
            size += b.num_rows
            if size >= BLOCK:
                yield from close()
                block, size = [], 0
        if block:
            yield from close()
        for name, sketches in held.items():
            for r, x in enumerate(sketches):
                if len(c := np.flatnonzero(x.total)):
                    yield batch(np.full(len(c), name, object), r, c, x.total[c], x.candidate[c], x.votes[c])

    return run


def sketch(df: DataFrame, name: str = "name", value: str = "value", rows: int = ROWS, cells: int = CELLS) -> DataFrame:
    """(name, row, cell, total, candidate, votes): partial sketches, one set for each partition of `df`, of any number of rows.

    Each cell holds how many rows fell into it, the value that leads, and by how many votes once unequal values have cancelled
    each other. Rows with a null or empty value count nowhere; a null name is a name. Memory of a task: rows x cells entries for each of NAMES names at most, and one block of rows, however many names it has.
    `merge` combines sketches of partitions, days or tables.
    """
    ship(df.sparkSession)
    v = F.col(value).cast("string")
    clean = df.where(v.isNotNull() & (v != "")).select(_key(F.col(name)).alias("n"), v.alias("v"), *(cell(v, r, cells).alias(f"c{r}") for r in range(rows)))
    parts = clean.mapInArrow(_partials(rows, cells), "name string, row int, cell int, total long, candidate string, votes long")
    return parts.withColumn("name", _name("name"))


def merge(parts: DataFrame) -> DataFrame:
    """Cells of several sketches as one, by vote cancellation: equal candidates add up, then the others' votes cancel the leader's.

    Every cell keeps: the candidate occurs at least `votes` and at most (total + votes) / 2 times, any other value of the cell at most (total - votes) / 2 times.
    """
    each = parts.groupBy("name", "row", "cell", "candidate").agg(F.sum("total").alias("total"), F.sum("votes").alias("votes"))
    lead = F.max(F.struct("votes", "candidate"))
    both = each.groupBy("name", "row", "cell").agg(F.sum("total").alias("total"), F.sum("votes").alias("_all"), lead.alias("_lead"))
    most = F.col("_lead.votes")
    # What can't be paired: the leader's surplus, or one vote if the number of votes is odd.
    votes = F.when(2 * most > F.col("_all"), 2 * most - F.col("_all")).otherwise(F.col("_all") % 2)
    return both.select("name", "row", "cell", "total", F.col("_lead.candidate").alias("candidate"), votes.alias("votes"))


def bounds(cells: DataFrame, share: float, rows: int = ROWS, width: int = CELLS) -> DataFrame:
    """(name, value, lower, upper, rows_of_name): the candidates of merged cells that may make up `share` of their name's rows, with count bounds."""
    n = cells.where("row = 0").groupBy("name").agg(F.sum("total").alias("rows_of_name"))
    cand = cells.select("name", F.col("candidate").alias("value")).distinct()
    at = cand.select("name", "value", F.explode(F.array(*(F.struct(F.lit(r).alias("row"), cell(F.col("value"), r, width).alias("cell")) for r in range(rows)))).alias("_x")).select("name", "value", "_x.row", "_x.cell")
    own = F.col("candidate") == F.col("value")
    both = at.join(cells.withColumnRenamed("name", "_n"), F.col("name").eqNullSafe(F.col("_n")) & (at["row"] == cells["row"]) & (at["cell"] == cells["cell"]))
    found = both.groupBy("name", "value").agg(F.max(F.when(own, F.col("votes")).otherwise(0)).alias("lower"), F.floor(F.min(F.when(own, F.col("total") + F.col("votes")).otherwise(F.col("total") - F.col("votes"))) / 2).cast("long").alias("upper"))
    n = n.withColumnRenamed("name", "_n")
    return found.join(n, F.col("name").eqNullSafe(F.col("_n"))).where(F.col("upper") / F.col("rows_of_name") >= share).select("name", "value", "lower", "upper", "rows_of_name")


def heavy_hitters(df: DataFrame, share: float = 0.01, name: str = "name", value: str = "value", rows: int = ROWS, cells: int = CELLS) -> DataFrame:
    """(name, value, rows, rows_of_name): exactly the values that make up at least `share` of the rows of their name.

    The sketch proposes values; it can miss one only if in every row of the sketch it fell into a cell whose runners-up may be that
    frequent. Such doubtful cells are few (at most 1 / (2 share) in a row); values that lie in one in each row are proposed too.
    Then the proposed values alone are counted. Nothing is lost at any size of the data, and memory doesn't grow with the distinct values.
    Values compare byte by byte. Rows with a null or empty value count nowhere; repeated rows count each.
    """
    kept = written(merge(sketch(df, name, value, rows, cells)), "cells")
    cand = bounds(kept, share, rows, cells)
    totals = kept.where("row = 0").groupBy("name").agg(F.sum("total").alias("rows_of_name"))
    doubtful = kept.join(totals.withColumnRenamed("name", "_n"), F.col("name").eqNullSafe(F.col("_n"))).where((F.col("total") - F.col("votes")) / 2 / F.col("rows_of_name") >= share).select(_key(F.col("name")).alias("_k"), "row", F.col("cell").alias("_c"))
    v = F.col(value).cast("string")
    data = df.where(v.isNotNull() & (v != "")).select(_key(F.col(name)).alias("_k"), v.alias("_v"))
    few = join_checked(data, written(cand.select(_key(F.col("name")).alias("_k"), F.col("value").alias("_v")), "candidates"), ["_k", "_v"], "left_semi")
    counted = few.groupBy("_k", "_v").agg(F.count("*").alias("rows"))
    if doubtful.groupBy("_k").agg(F.countDistinct("row").alias("_r")).where(F.col("_r") == rows).limit(1).count():
        more = data
        for r in range(rows):
            more = join_checked(more.withColumn("_c", cell(F.col("_v"), r, cells)), doubtful.where(F.col("row") == r).select("_k", "_c"), ["_k", "_c"], "left_semi")
        counted = counted.unionByName(more.groupBy("_k", "_v").agg(F.count("*").alias("rows"))).distinct()
    n = totals.select(_key(F.col("name")).alias("_k"), "rows_of_name")
    return counted.join(n, "_k").where(F.col("rows") / F.col("rows_of_name") >= share).select(_name("_k").alias("name"), F.col("_v").alias("value"), "rows", "rows_of_name")
