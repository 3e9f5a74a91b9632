"""First-wins resolution: the result of a sequential scan, computed in parallel rounds.

Row r is dropped when an earlier kept row claims a key that r checks; otherwise it is kept. Each
round decides every row that has no undecided earlier claimant, which is the lexicographically
first maximal independent set of the conflict graph. Keys stand for the conflicts, so no pairs of
rows are formed: the work per round is linear in the claims and checks of the open rows.

A chain in which every row conflicts with the one before needs a round per link, so after a few rounds
the open rows are cut into the connected components of their keys, which takes logarithmic rounds, and
each component is scanned in order by one task. Only components too large for a task stay in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderleaf.operators.components import components
from cinderleaf.session import checkpoint

# Rounds before the rest is cut into components, and rows of a component that one task may scan.
FIRST_ROUNDS, SCAN_ROWS = 2, 1_000_000


def _first_claims(claims: DataFrame) -> DataFrame:
    """Smallest open and smallest kept claimant per key; pre-aggregated before the shuffle."""
    return claims.groupBy("key").agg(
        F.min(F.when(F.col("kept"), F.col("ord"))).alias("first_kept"),
        F.min(F.when(~F.col("kept"), F.col("ord"))).alias("first_open"),
    )


def dropped_rows(claims: DataFrame, checks: DataFrame) -> DataFrame:
    """Orders (`ord`) that the sequential scan drops.

    `claims(ord, key)`: keys a row publishes once kept. `checks(ord, key)`: keys that must not have
    been published by an earlier kept row.
    """
    return settle(claims, checks)[0]


def settle(
    claims: DataFrame, checks: DataFrame, stuck: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(dropped, waiting) orders. Rows in `stuck` stay open, and so do the rows that wait for them."""
    firsts = claims.groupBy("key").agg(F.min("ord").alias("first"))
    contested = checks.join(firsts, "key").where("first < ord").select("ord", "key")
    if stuck is not None:
        contested = contested.join(stuck, "ord", "left_anti")
    open_checks = checkpoint(contested)
    relevant = open_checks.select("key").distinct()
    open_rows = open_checks.select("ord").distinct()
    dropped = open_rows.limit(0)
    if stuck is not None:
        open_rows = open_rows.unionByName(stuck)
    # rows without a contested key are kept from the start
    open_claims = (
        claims.join(relevant, "key", "left_semi")
        .join(open_rows.withColumn("_open", F.lit(True)), "ord", "left")
        .select("ord", "key", F.col("_open").isNull().alias("kept"))
    )
    open_claims = checkpoint(open_claims)

    rounds = 0
    while not open_checks.isEmpty():
        if rounds == FIRST_ROUNDS and stuck is None:
            scanned, large = _scan_components(open_claims, open_checks)
            dropped = dropped.unionByName(scanned)
            open_claims = checkpoint(open_claims.join(large, "ord", "left_semi"))
            open_checks = checkpoint(open_checks.join(large, "ord", "left_semi"))
            rounds += 1
            continue
        rounds += 1
        verdicts = (
            open_checks.join(_first_claims(open_claims), "key", "left")
            .groupBy("ord")
            .agg(
                F.max(F.coalesce(F.col("first_kept") < F.col("ord"), F.lit(False))).alias("drop"),
                F.max(F.coalesce(F.col("first_open") < F.col("ord"), F.lit(False))).alias("wait"),
            )
        )
        verdicts = checkpoint(verdicts)
        dropped = dropped.unionByName(verdicts.where("drop").select("ord"))
        waiting = verdicts.where("NOT drop AND wait").select("ord")
        settled = verdicts.where("NOT drop AND NOT wait").select("ord")
        if stuck is not None:
            if verdicts.where("drop OR NOT wait").isEmpty():
                break
            waiting = waiting.unionByName(stuck)
        open_checks = checkpoint(open_checks.join(waiting, "ord", "left_semi"))
        keys = open_checks.select("key").distinct()
        undecided = open_claims.where("NOT kept")
        still_open = undecided.join(waiting, "ord", "left_semi")
        newly_kept = undecided.join(settled, "ord", "left_semi").withColumn("kept", F.lit(True))
        open_claims = checkpoint(
            still_open.unionByName(newly_kept).join(keys, "key", "left_semi").select("ord", "key", "kept")
        )
    return dropped, open_checks.select("ord").distinct()


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by component and order to the numbers of the dropped ones."""
    root, published = None, set()
    for batch in batches:
        gone = []
        for row, own, kept, checks, claims in batch.itertuples(index=False):
            if own != root:
                root, published = own, set()
            if not kept and any(key in published for key in checks):
                gone.append(row)
            else:
                published.update(claims)
        yield pd.DataFrame({"row": gone}, dtype="int64")


def _scan_components(claims: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dropped orders of the components that a task can scan, orders of the other components).

    Hashes stand for orders and keys in the graph only; two that share one merely join components.
    """
    key = F.col("key").cast("string")
    events = claims.select("ord", "kept", key.alias("claim"), F.lit(None).cast("string").alias("check")).unionByName(
        checks.select("ord", F.lit(False).alias("kept"), F.lit(None).cast("string").alias("claim"), key.alias("check"))
    )
    rows = events.groupBy("ord").agg(
        F.max("kept").alias("kept"), F.collect_set("check").alias("checks"), F.collect_set("claim").alias("claims")
    )
    rows = checkpoint(rows.withColumns({"row": F.monotonically_increasing_id(), "node": F.xxhash64(F.lit("row"), "ord")}))
    edges = rows.select("node", F.explode(F.concat("checks", "claims")).alias("key"))
    roots = checkpoint(components(edges.select(F.col("node").alias("a"), F.xxhash64(F.lit("key"), "key").alias("b"))))
    rooted = checkpoint(rows.join(roots, "node"))
    sizes = rooted.groupBy("root").agg(F.count("*").alias("rows"))
    large = checkpoint(sizes.where(F.col("rows") > SCAN_ROWS).select("root"))
    ordered = (
        rooted.join(large, "root", "left_anti")
        .select("row", "root", "kept", "checks", "claims", "ord")
        .repartition("root")
        .sortWithinPartitions("root", "ord")
        .drop("ord")
    )
    gone = checkpoint(ordered.mapInPandas(_scan, "row long"))
    return rows.join(gone, "row", "left_semi").select("ord"), rooted.join(large, "root", "left_semi").select("ord")
