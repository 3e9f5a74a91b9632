"""Readers: lines, JSON records, delimited files, map features and alert feeds."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderleaf.fixed import place_rules as rules
from cinderleaf.functions.place import nearest_centre
from cinderleaf.functions.text import strip

CORPUS_SCHEMA = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("image_path", T.StringType()),
        T.StructField("audio_path", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
SNIFF_CHARS = 4096


def _with_position(df: DataFrame) -> DataFrame:
    """Adds file, block offset and row number within the block: together the input order."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


ORDER = ["file", "block", "row"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One trimmed, non-blank line per row with its position."""
    lines = _with_position(spark.read.text(path).withColumnRenamed("value", "text"))
    return lines.withColumn("text", strip(F.col("text"))).where("text <> ''")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = CORPUS_SCHEMA) -> DataFrame:
    """JSON lines of a file or folder; a missing text becomes empty, bad rows keep `_corrupt`."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    reader = spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt")
    rows = _with_position(reader.option("pathGlobFilter", "*.json*").json(path))
    if "text" in schema.fieldNames():
        rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    return rows


def sniff_delimiter(spark: SparkSession, path: str) -> tuple[str, str]:
    """(delimiter, header line) from the first 4,096 characters; comma when undecided."""
    # a line gives at least one character, its end
    lines = spark.read.text(path).select(F.substring("value", 1, SNIFF_CHARS)).limit(SNIFF_CHARS)
    head = lines.collect()
    sample = "\n".join(r[0] for r in head)[:SNIFF_CHARS].lstrip("\ufeff")
    try:
        delimiter = csv.Sniffer().sniff(sample).delimiter
    except csv.Error:
        delimiter = ","
    return delimiter, sample.split("\n", 1)[0]


def read_csv_auto(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Delimited file as trimmed strings: short rows padded, all-blank rows dropped."""
    delimiter, header = sniff_delimiter(spark, path)
    names = [h.strip() for h in next(csv.reader(io.StringIO(header), delimiter=delimiter), [])]
    fields = [T.StructField(n or f"_blank{i}", T.StringType()) for i, n in enumerate(names)]
    rows = (
        spark.read.schema(T.StructType(fields))
        .option("sep", delimiter)
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )
    kept = [f.name for f, n in zip(fields, names) if n]
    clean = rows.select(*[strip(F.coalesce(F.col(f"`{n}`"), F.lit(""))).alias(n) for n in kept])
    filled = F.lit(False)
    for name in kept:
        filled = filled | (F.col(f"`{name}`") != "")
    return clean.where(filled)


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of a JSON array, or of an array under `data`, `places` or `locations`.

    The parser streams the elements of a top-level array; `file`, `row` and `pos` give their order.
    """
    keys = ("data", "places", "locations")
    wrappers = [T.StructField(k, T.ArrayType(schema)) for k in keys]
    full = T.StructType([*schema.fields, *wrappers])
    rows = spark.read.schema(full).option("multiLine", True).json(path)
    own = F.array(F.struct(*[F.col(f.name) for f in schema.fields]))
    placed = rows.select(
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(*[F.col(k) for k in keys], own).alias("_records"),
    )
    return placed.select("file", "row", F.posexplode("_records").alias("pos", "_r")).select(
        "file", "row", "pos", "_r.*"
    )


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """Tables under one `source` column, rows without any value dropped."""
    out = None
    for name, df in frames.items():
        tagged = df.dropna(how="all").withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def dataset_counts(rows: DataFrame, file: str = "file") -> DataFrame:
    """Rows per file."""
    return rows.groupBy(file).agg(F.count("*").alias("n"))


def _feature_category(tag: Column, settlements: bool) -> Column:
    options = [F.try_element_at(tag, F.lit(t)) for t in rules.FEATURE_TAGS]
    amenity = F.try_element_at(tag, F.lit("amenity"))
    options.append(F.when(amenity.isin(rules.FEATURE_AMENITIES), amenity))
    if settlements:
        place = F.try_element_at(tag, F.lit("place"))
        options.append(F.when(place.isin(rules.FEATURE_SETTLEMENTS), place))
    return F.coalesce(*options)


def _candidates(features: DataFrame, settlements: bool) -> DataFrame:
    """Named, categorised features; expects id, lat, lon and tag."""
    tag = F.col("tag")

    def value(key: str, default: str) -> Column:
        return F.coalesce(F.try_element_at(tag, F.lit(key)), F.lit(default))

    name = F.coalesce(
        F.nullif(F.try_element_at(tag, F.lit("name:en")), F.lit("")), F.try_element_at(tag, F.lit("name"))
    )
    category = _feature_category(tag, settlements)
    surf = F.map_contains_key(tag, "surfing") | F.lower(name).contains("surf")
    named = features.where((F.coalesce(name, F.lit("")) != "") & (F.coalesce(category, F.lit("")) != ""))
    placed = named.withColumn("_centre", nearest_centre(F.col("lat"), F.col("lon")))
    return placed.select(
        "id",
        strip(name).alias("name"),
        "lat",
        F.col("lon").alias("lng"),
        F.concat(F.upper(F.substring(category, 1, 1)), F.lower(F.substring(category, 2, 1000))).alias("category"),
        F.col("_centre.district").alias("district"),
        F.col("_centre.province").alias("province"),
        value("opening_hours", "Unknown").alias("opening_hours"),
        value("toilets", "Unknown").alias("toilets"),
        value("wheelchair", "Unknown").alias("wheelchair"),
        value("communication:mobile", "Unknown").alias("mobile_signal"),
        F.when(surf, "yes").otherwise("no").alias("Surfing"),
        value("height", "0").alias("Height_m"),
        F.lit("0").alias("Length_km"),
    )


def way_centroids(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, lat, lon): mean of the known member nodes; repeats count, ways without any are dropped."""
    members = ways.select("id", F.explode("nd").alias("node"))
    spots = nodes.select(F.col("id").alias("node"), "lat", "lon")
    return members.join(spots, "node").groupBy("id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def osm_places(nodes: DataFrame, ways: DataFrame, limit: int | None = None) -> DataFrame:
    """Place candidates of named nodes (kind 0) and of ways (kind 1); a `limit` keeps the first in this order."""
    points = _candidates(nodes, settlements=True).withColumn("kind", F.lit(0))
    tag = F.col("tag")
    usable = ways.where(
        (F.map_contains_key(tag, "name") | F.map_contains_key(tag, "name:en"))
        & _feature_category(tag, False).isNotNull()
    )
    centred = usable.select("id", "tag").join(way_centroids(usable, nodes), "id")
    areas = _candidates(centred, settlements=False).withColumn("kind", F.lit(1))
    found = points.unionByName(areas)
    return found if limit is None else found.orderBy("kind", "id").limit(limit)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files: title and description, empty when absent."""
    schema = T.StructType(
        [T.StructField("title", T.StringType()), T.StructField("description", T.StringType())]
    )
    items = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    return items.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "description")])


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(filename, size, content) of binary files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(
        F.regexp_extract("path", r"([^/]*)\z", 1).alias("filename"), F.col("length").alias("size"), "content"
    )
