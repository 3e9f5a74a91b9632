"""Order-based building blocks that never put one key into one task.

Rows get a dense index in a global sort order, and windows run over chunks of a fixed number of
consecutive rows. A chunk that needs the rows before it carries a short copy of them (the halo), so
a key with a third of the table is spread over as many chunks as it needs.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cinderleaf.session import checkpoint

CHUNK_ROWS = 200_000


def dense_index(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Adds 0, 1, 2, ... in the order of the columns, without a single-task sort.

    Range partitions are sorted and written once; only one count per partition is combined.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = ranged.withColumns(
        {
            "_pid": F.spark_partition_id(),
            "_pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    placed = checkpoint(placed)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_pid").agg(F.count("*").alias("_n"))
    starts = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    indexed = placed.join(F.broadcast(starts), "_pid")
    return indexed.withColumn(name, F.col("_start") + F.col("_pos")).drop("_pid", "_pos", "_start")


def _chunk(index: str, chunk_rows: int) -> Column:
    return F.floor(F.col(index) / chunk_rows)


def over_chunks(
    df: DataFrame,
    index: str,
    halo: int,
    columns: Callable[[WindowSpec], dict[str, Column]],
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds window columns that look back at most `halo` rows of the dense index."""
    own = _chunk(index, chunk_rows)
    near_end = F.col(index) % chunk_rows >= chunk_rows - halo
    copies = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    spread = df.withColumn("_chunk", F.explode(copies))
    window = Window.partitionBy("_chunk").orderBy(index)
    added = columns(window)
    out = spread.select("*", *[c.alias(n) for n, c in added.items()])
    return out.where(F.col("_chunk") == own).drop("_chunk")


def lag_in(key: list[str], column: str, n: int, window: WindowSpec) -> Column:
    """Value `n` rows earlier when that row has the same key, else null."""
    same = F.lit(True)
    for k in key:
        same = same & F.lag(k, n).over(window).eqNullSafe(F.col(k))
    return F.when(same, F.lag(column, n).over(window))


def running_max(
    df: DataFrame, index: str, value: Column, name: str, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Largest `value` up to and including each row of the dense index."""
    marked = df.withColumns({"_chunk": _chunk(index, chunk_rows), "_value": value})
    inside = Window.partitionBy("_chunk").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = marked.groupBy("_chunk").agg(F.max("_value").alias("_top"))
    carry = tops.select("_chunk", F.max("_top").over(earlier).alias("_carry"))
    joined = marked.withColumn("_inside", F.max("_value").over(inside)).join(carry, "_chunk", "left")
    best = F.greatest("_inside", "_carry")
    return joined.withColumn(name, best).drop("_chunk", "_value", "_inside", "_carry")


def cut_segments(
    df: DataFrame,
    key: list[str],
    order: list[str],
    uses: list[str],
    resets: Callable[[Callable[[str], Column]], Column],
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds `idx`, `fresh` and `segment`: runs of a key between rows where a rule starts afresh.

    `resets(previous)` states when a row starts a run; `previous(column)` is the value of one of the
    columns in `uses` one row earlier of the same key. The first row of a key always starts one.
    """
    indexed = dense_index(df, [*key, *order])

    def look_back(window: WindowSpec) -> dict[str, Column]:
        before = {f"_before_{c}": lag_in(key, c, 1, window) for c in uses}
        return before | {"_first": lag_in(key, "idx", 1, window).isNull()}

    seen = over_chunks(indexed, "idx", 1, look_back, chunk_rows)
    fresh = F.col("_first") | F.coalesce(resets(lambda c: F.col(f"_before_{c}")), F.lit(False))
    return running_max(
        seen.withColumn("_fresh", fresh).drop("_first", *[f"_before_{c}" for c in uses]),
        "idx",
        F.when(F.col("_fresh"), F.col("idx")),
        "segment",
        chunk_rows,
    ).withColumnRenamed("_fresh", "fresh")


def _fold_rows(
    start: Callable[[], object], step: Callable[..., object], inputs: list[str], group: list[str], output: str | None
):
    """Folds sorted rows group by group; a group starts from the state in `_before`, if its first row has one.

    With an output every row gets its result; without one every group gives its last state.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, fresh = None, None, True
        for pdf in batches:
            results, ended = [], []
            befores = pdf["_before"] if "_before" in pdf else [None] * len(pdf)
            for own, before, *values in zip(zip(*(pdf[g] for g in group)), befores, *(pdf[c] for c in inputs)):
                if own != current:
                    if output is None and not fresh:
                        ended.append((*current, pickle.dumps(vars(state))))
                    current, state, fresh = own, start(), False
                    if before is not None:
                        vars(state).update(pickle.loads(before))
                results.append(step(state, *values))
            if output is None:
                yield pd.DataFrame(ended, columns=[*group, "_after"])
            else:
                pdf[output] = results
                yield pdf.drop(columns="_before", errors="ignore")
        if output is None and not fresh:
            yield pd.DataFrame([(*current, pickle.dumps(vars(state)))], columns=[*group, "_after"])

    return run


def fold_segments(
    df: DataFrame,
    start: Callable[[], object],
    step: Callable[..., object],
    inputs: list[str],
    output: str,
    kind: str,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Runs `step(state, *inputs)` over the rows of each segment in index order.

    Rows stream through sorted partitions in Arrow batches; only the state of the current segment is
    held. A segment within one chunk of the index is folded by one task. The pieces of a longer one are
    folded side by side, at first each from a fresh state; then every piece whose predecessor ended in
    another state than it had assumed is folded again, until none is left. States that forget, like the
    windows of rate limits, settle after a round or two; the result is that of one long fold.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    result = f"{schema}, `{output}` {kind}"
    spans = df.groupBy("segment").agg(
        F.floor(F.min("idx") / chunk_rows).alias("_a"), F.floor(F.max("idx") / chunk_rows).alias("_b")
    )
    long = checkpoint(spans.where("_a < _b").select("segment"))
    if long.isEmpty():
        whole = df.repartition("segment").sortWithinPartitions("segment", "idx")
        return whole.mapInPandas(_fold_rows(start, step, inputs, ["segment"], output), result)
    whole = df.join(long, "segment", "left_anti").repartition("segment").sortWithinPartitions("segment", "idx")
    folded = whole.mapInPandas(_fold_rows(start, step, inputs, ["segment"], output), result)
    group = ["segment", "_chunk"]
    rows = checkpoint(df.join(long, "segment", "left_semi").withColumn("_chunk", _chunk("idx", chunk_rows)))
    pieces = rows.groupBy(*group).agg(F.min("idx").alias("idx"))
    previous = F.lag("_chunk").over(Window.partitionBy("segment").orderBy("_chunk"))
    pieces = checkpoint(pieces.withColumns({"_previous": previous, "_before": F.lit(None).cast("binary")}))
    columns = [c for c in df.columns if c != "segment"]

    def placed(some: DataFrame) -> DataFrame:
        """The rows of the pieces, in order, the first of each with its state."""
        own = rows.join(some.select(*group), group, "left_semi")
        states = some.where("_before IS NOT NULL").select("segment", "idx", "_before")
        joined = own.join(states, ["segment", "idx"], "left").select("segment", *columns, "_chunk", "_before")
        return joined.repartition(*group).sortWithinPartitions(*group, "idx")

    after = None
    changed = pieces
    while not changed.isEmpty():
        ended = placed(changed).mapInPandas(
            _fold_rows(start, step, inputs, group, None), "segment long, _chunk long, _after binary"
        )
        ended = checkpoint(ended)
        after = ended if after is None else checkpoint(after.join(ended, group, "left_anti").unionByName(ended))
        states = after.withColumnRenamed("_chunk", "_previous")
        met = checkpoint(pieces.join(states, ["segment", "_previous"], "left"))
        changed = met.where("NOT (_before <=> _after)").withColumn("_before", F.col("_after"))
        changed = checkpoint(changed.select(*pieces.columns))
        pieces = checkpoint(met.withColumn("_before", F.col("_after")).select(*pieces.columns))
    last = placed(pieces).mapInPandas(
        _fold_rows(start, step, inputs, group, output), f"{_typed(df, columns)}, _chunk long, `{output}` {kind}"
    )
    return folded.unionByName(last.select(*df.columns, output))


def _typed(df: DataFrame, columns: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{c}` {kinds[c]}" for c in ["segment", *columns])
