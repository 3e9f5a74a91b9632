"""Catalog statistics, recommendations, search and copy-on-write changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderleaf.fixed import guard_rules
from cinderleaf.fixed import place_rules as rules
from cinderleaf.functions.place import place_id
from cinderleaf.functions.text import strip
from cinderleaf.operators.ordered import dense_index
from cinderleaf.session import fixed_table


def catalog_stats(places: DataFrame) -> DataFrame:
    """(dim, value, n): counts by category, safety and popularity, known levels included, and total."""
    dims = F.array(
        F.struct(F.lit("category").alias("dim"), F.coalesce("category_id", F.lit("Unknown")).alias("value")),
        F.struct(F.lit("safety").alias("dim"), F.coalesce("safety_level", F.lit("Safe")).alias("value")),
        F.struct(
            F.lit("popularity").alias("dim"), F.coalesce("tourist_popularity", F.lit("High")).alias("value")
        ),
        F.struct(F.lit("total").alias("dim"), F.lit("total").alias("value")),
    )
    counted = places.select(F.inline(dims)).groupBy("dim", "value").agg(F.count("*").alias("n"))
    known = [("safety", v) for v in rules.SAFETY_LEVELS] + [("popularity", v) for v in rules.POPULARITY_LEVELS]
    rows = [(d, v, 0) for d, v in [*known, ("total", "total")]]
    levels = fixed_table(places.sparkSession, rows, "dim string, value string, n long")
    return counted.unionByName(levels).groupBy("dim", "value").agg(F.sum("n").alias("n"))


def search_places(places: DataFrame, query: str, category: str = "All") -> DataFrame:
    """Name or district contains the query, ignoring case; category equal unless 'All'."""
    wanted = query.lower().strip()
    hit = F.lower("name").contains(wanted) | F.lower("district_id").contains(wanted)
    if category != "All":
        hit = hit & (F.lower("category_id") == category.lower())
    return places.where(hit)


def select_spots(places: DataFrame, category: str) -> DataFrame:
    """Category equal, or contained in name or description; all rows when nothing matches."""
    wanted = category.lower().strip()
    described = F.lower("description") if "description" in places.columns else F.lit("")
    match = (
        (strip(F.lower(F.coalesce("category_id", F.lit("")))) == wanted)
        | F.lower(F.coalesce("name", F.lit(""))).contains(wanted)
        | F.coalesce(described, F.lit("")).contains(wanted)
    )
    flagged = places.withColumn("_match", match)
    any_match = flagged.agg(F.coalesce(F.bool_or("_match"), F.lit(False)).alias("_any"))
    # one aggregated row decides for the whole table
    return flagged.where(F.col("_match") | ~any_match.scalar()).drop("_match")


def dlp_view(df: DataFrame) -> DataFrame:
    """Private columns removed, positions rounded to two decimals."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    out = []
    for name, kind in df.dtypes:
        if name in guard_rules.PRIVATE_COLUMNS:
            continue
        if name in guard_rules.POSITION_COLUMNS and (kind in numeric or kind.startswith("decimal")):
            out.append(F.round(F.col(name).cast("double"), 2).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def allowlisted(events: DataFrame, ips: DataFrame, ip: str, flag: bool = False) -> DataFrame:
    """Events whose address is listed; with `flag` all events with an `allowed` column."""
    listed = ips.select(ip).distinct()
    if not flag:
        return events.join(listed, ip, "left_semi")
    marked = events.join(listed.withColumn("allowed", F.lit(True)), ip, "left")
    return marked.withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def _popularity_rank() -> Column:
    popularity = strip(F.coalesce("tourist_popularity", F.lit("Medium")))
    return F.when(popularity == "High", 0).when(popularity == "Medium", 1).otherwise(2)


def _top_names(
    rows: DataFrame, group: str, order: list[str], least: int, shown: Column, top: int = 5
) -> DataFrame:
    """(group, n, names): first `top` names of every group with at least `least` rows."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    # the rank filter cuts each partition to `top` rows per group before the shuffle
    best = rows.withColumn("_rank", rank).where(F.col("_rank") <= top)
    listed = best.groupBy(group).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_rank", shown.alias("_shown")))),
                lambda e: e["_shown"],
            ),
            ", ",
        ).alias("names")
    )
    sizes = rows.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return sizes.join(listed, group)


def district_recommendations(places: DataFrame, order: str, district: str = "district_id") -> DataFrame:
    """Top five names per district with three or more places."""
    rows = places.withColumn("_pop", _popularity_rank()).withColumn(
        "_group", strip(F.coalesce(F.col(district), F.lit("Unknown")))
    )
    top = _top_names(rows, "_group", ["_pop", order], 3, F.col("name"))
    return top.withColumnRenamed("_group", "district")


def category_recommendations(places: DataFrame, order: str, district: str = "district_id") -> DataFrame:
    """Top five 'name (district District)' entries per category with three or more places."""
    rows = places.withColumn("_pop", _popularity_rank()).withColumn(
        "_group", strip(F.coalesce("category_id", F.lit("Place")))
    )
    shown = F.concat(
        F.col("name"), F.lit(" ("), F.coalesce(F.col(district), F.lit("Unknown")), F.lit(" District)")
    )
    return _top_names(rows, "_group", ["_pop", order], 3, shown).withColumnRenamed("_group", "category")


def free_places(places: DataFrame, order: str, district: str = "district_id") -> DataFrame:
    """First five free names per district with two or more free places."""
    ticket = F.coalesce("ticket_price", F.lit("Free"))
    rows = places.where(F.lower(ticket).contains("free") | (ticket == "0")).withColumn(
        "_group", strip(F.coalesce(F.col(district), F.lit("Unknown")))
    )
    return _top_names(rows, "_group", [order], 2, F.col("name")).withColumnRenamed("_group", "district")


def district_density(places: DataFrame, district: str = "district_id") -> DataFrame:
    """Places per known district with circle colour and radius."""
    known = [d.lower() for d, *_ in rules.DISTRICTS]
    low = strip(F.lower(F.coalesce(F.col(district), F.lit(""))))
    counts = places.groupBy(low.alias("district")).agg(F.count("*").alias("n"))
    color = F.when(F.col("n") > 8, "#ef4444").when(F.col("n") > 3, "#f59e0b").otherwise("#14b8a6")
    radius = F.least(F.lit(35000), F.greatest(F.lit(7000), F.col("n") * 5000))
    return counts.where(F.col("district").isin(known)).withColumns({"color": color, "radius": radius})


def last_changes(changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One change per key: the last by `order`, as if they were applied one after the other.

    Without an order any one of the changes of a key stays.
    """
    if order is None:
        return changes.dropDuplicates([key])
    last = F.max_by(F.struct(*changes.columns), F.col(order)).alias("_last")
    return changes.groupBy(F.col(key).alias("_key")).agg(last).select("_last.*")


def update_rows(
    current: DataFrame, changes: DataFrame, key: str, order: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(table with matching rows replaced, changes whose key is unknown); the last change of a key wins."""
    changes = last_changes(changes, key, order)
    known = changes.join(current.select(key), key, "left_semi")
    unknown = changes.join(current.select(key), key, "left_anti")
    kept = current.join(changes.select(key), key, "left_anti")
    return kept.unionByName(known, allowMissingColumns=True), unknown


def delete_rows(current: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(table without the keys, keys that are unknown)."""
    return (
        current.join(keys.select(key), key, "left_anti"),
        keys.select(key).join(current.select(key), key, "left_anti"),
    )


def upsert_rows(current: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of `changes` replace rows with the same key; others are appended. The last change of a key wins."""
    changes = last_changes(changes, key, order)
    return current.join(changes.select(key), key, "left_anti").unionByName(
        changes, allowMissingColumns=True
    )


def assign_ids(current: DataFrame, new: DataFrame, order: str, name: str = "name") -> DataFrame:
    """Ids for new rows: made from the name, with the whole digest of name and order where that id is taken."""
    plain = new.withColumn("_id", place_id(F.col(name)))
    first = plain.groupBy("_id").agg(F.min(order).alias("_first"))
    taken = current.select(F.col("id").alias("_id")).distinct().withColumn("_taken", F.lit(True))
    marked = plain.join(first, "_id").join(taken, "_id", "left")
    free = F.col("_taken").isNull() & (F.col(order) == F.col("_first"))
    other = F.concat(F.lit("pl_"), F.md5(F.concat_ws(":", F.col(name), F.col(order).cast("string"))))
    return marked.withColumn("id", F.when(free, F.col("_id")).otherwise(other)).select(*new.columns, "id")


def insert_rows(current: DataFrame, new: DataFrame, order: str, name: str = "name") -> DataFrame:
    """Appends new rows under their assigned ids."""
    return current.unionByName(assign_ids(current, new, order, name), allowMissingColumns=True)


def delete_nth(pairs: DataFrame, order: list[str], n: int, text: str = "prompt") -> DataFrame:
    """Pairs without the n-th non-blank one, renumbered from 0 in `index`."""
    filled = pairs.where(strip(F.coalesce(F.col(text), F.lit(""))) != "")
    numbered = dense_index(filled, order, "index").where(F.col("index") != n)
    return numbered.withColumn("index", F.when(F.col("index") > n, F.col("index") - 1).otherwise(F.col("index")))
