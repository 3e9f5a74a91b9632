"""Dictionary lookups: either-way substring matches, mentions, alerts, travel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderleaf.fixed import food_rules as food
from cinderleaf.fixed import place_rules as rules
from cinderleaf.functions.fingerprints import FILTER_BITS, filter_bits, fingerprints, size_of
from cinderleaf.functions.template import contains_any
from cinderleaf.functions.text import strip
from cinderleaf.session import bounded, checkpoint, fits_broadcast


def contains_join(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Every (text row, needle row) where the text contains the needle; no cross join.

    Each needle is known by its piece that the fewest needles have, a piece of up to 32 bytes. The pieces of a
    text roll over it in one pass, and only those whose fingerprint passes a filter of all needles' leave the
    pass: a text becomes as many rows as it holds candidates, whatever its length. These meet the needles on equal
    fingerprints and are then checked. Blank needles match every text only by caller's choice: they are left out here.
    """
    names = needles.where(F.length(needle) > 0)
    distinct = names.select(needle).distinct()
    entries = distinct.select(needle, F.explode(fingerprints(F.col(needle))).alias("_piece"))
    use = entries.groupBy("_piece").agg(F.count("*").alias("_uses"))
    rarest = entries.join(use, "_piece").groupBy(needle).agg(
        F.min(F.struct("_uses", "_piece"))["_piece"].alias("_piece")
    )
    rarest = checkpoint(rarest)
    sizes = [r["size"] for r in rarest.select(size_of(F.col(needle)).alias("size")).distinct().collect()]
    if not sizes:
        return texts.join(names, F.lit(False))
    # at most one row per bit of the filter
    leading = rarest.select(F.shiftrightunsigned("_piece", 64 - FILTER_BITS).alias("bits")).distinct()
    passing = filter_bits([r["bits"] for r in leading.collect()])
    keyed = names.join(rarest, needle).select(*names.columns, "_piece")
    # a needle has one piece and a text every piece once, so a pair is met once
    spread = texts.withColumn("_piece", F.explode(fingerprints(F.col(text), sorted(sizes), passing)))
    met = spread.join(F.broadcast(keyed) if fits_broadcast(keyed) else keyed, "_piece")
    return met.where(F.contains(texts[text], keyed[needle])).drop("_piece")


def resolve_first_match(items: DataFrame, item: str, dictionary: DataFrame, name: str, prio: str) -> DataFrame:
    """Adds the dictionary columns of the first entry that contains the item or lies within it.

    Distinct items are resolved once; rows without a match get nulls in the dictionary columns.
    """
    clean = strip(F.lower(F.col(item)))
    keys = checkpoint(items.select(clean.alias("_item")).distinct())
    entries = dictionary.withColumn("_name", F.col(name))
    cols = dictionary.columns
    inside = contains_join(keys, "_item", entries, "_name").select("_item", *cols)
    around = contains_join(entries, "_name", keys, "_item").select("_item", *cols)
    # a blank item lies within every entry, so the first entry wins
    first = entries.agg(F.min_by(F.struct(*cols), prio).alias("_hit"))
    blank = first.select(F.lit("").alias("_item"), "_hit.*")
    best = (
        inside.unionByName(around)
        .unionByName(blank)
        .groupBy("_item")
        .agg(F.min_by(F.struct(*cols), prio).alias("_hit"))
        .select("_item", "_hit.*")
    )
    best = bounded(checkpoint(best))
    return items.withColumn("_item", clean).join(best, "_item", "left").drop("_item")


def resolve_foods(components: DataFrame, item: str, foods: DataFrame) -> DataFrame:
    """Adds `matched` and nutrients of each component; unknown components get the fallback."""
    named = resolve_first_match(components, item, foods.withColumnRenamed("name", "food"), "food", "prio")
    calories, protein, carbs, fat = food.FALLBACK_FOOD
    return named.withColumns(
        {
            "matched": F.col("prio").isNotNull(),
            "calories": F.coalesce(F.col("calories").cast("int"), F.lit(calories)),
            "protein": F.coalesce(F.col("protein").cast("double"), F.lit(protein)),
            "carbs": F.coalesce(F.col("carbs").cast("double"), F.lit(carbs)),
            "fat": F.coalesce(F.col("fat").cast("double"), F.lit(fat)),
        }
    ).drop("prio")


def mentions(texts: DataFrame, text: str, places: DataFrame, name: str) -> DataFrame:
    """(text row, place row) pairs where the place name occurs in the text, ignoring case."""
    low_texts = texts.withColumn("_text", F.lower(text))
    low_names = places.withColumn("_name", F.lower(name))
    return contains_join(low_texts, "_text", low_names, "_name").drop("_text", "_name")


def _first_of(entries: list[tuple], hit, value) -> Column:
    """Value of the first entry for which `hit(entry)` holds; null when none does."""
    out = None
    for entry in entries:
        out = F.when(hit(entry), value(entry)) if out is None else out.when(hit(entry), value(entry))
    return out


def tag_alerts(items: DataFrame, title: str = "title", description: str = "description") -> DataFrame:
    """Adds district, level, hazard, position, radius and bulletin to warning items."""
    head, body = F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(description), F.lit(""))
    low_head, low_body = F.lower(head), F.lower(body)

    def either(word: str) -> Column:
        return low_head.contains(word) | low_body.contains(word)

    def any_word(words: list[str]) -> Column:
        return contains_any(low_head, words) | contains_any(low_body, words)

    where = _first_of(
        rules.ALERT_POSITIONS,
        lambda e: either(e[0].lower()),
        lambda e: F.struct(
            F.lit(e[0]).alias("district"), F.lit(e[1]).alias("lat"), F.lit(e[2]).alias("lng")
        ),
    )
    name, lat, lng = rules.COUNTRY_CENTRE
    level = F.when(any_word(rules.ALERT_RED), "Red").when(any_word(rules.ALERT_AMBER), "Amber")
    hazard = (
        F.when(either("rain"), "Heavy Rain")
        .when(either("flood"), "Flood Alert")
        .when(either("landslide"), "Landslide Warning")
        .when(low_head.contains("wind") | low_head.contains("cyclone"), "Strong Winds")
        .otherwise("Weather Warning")
    )
    tagged = items.withColumns({"_where": where, "level": level.otherwise("Yellow"), "hazard": hazard})
    radius = _first_of(
        list(rules.ALERT_RADIUS.items()), lambda e: F.col("level") == e[0], lambda e: F.lit(e[1])
    )
    return tagged.withColumns(
        {
            "district": F.coalesce("_where.district", F.lit(name)),
            "lat": F.coalesce("_where.lat", F.lit(lat)),
            "lng": F.coalesce("_where.lng", F.lit(lng)),
            "radius": radius,
            "bulletin": F.concat(head, F.lit(": "), F.substring(body, 1, rules.BULLETIN_CHARS)),
        }
    ).drop("_where")


def distance_lookup(trips: DataFrame, origin: str, destination: str) -> DataFrame:
    """Adds distance and duration of the first known pair in either direction; null when unknown."""
    a, b = strip(F.lower(F.col(origin))), strip(F.lower(F.col(destination)))

    def hit(entry: tuple) -> Column:
        one, two = F.lit(entry[0]), F.lit(entry[1])
        return (one.contains(a) & two.contains(b)) | (one.contains(b) & two.contains(a))

    found = _first_of(
        rules.DISTANCES,
        hit,
        lambda e: F.struct(F.lit(e[2]).alias("distance"), F.lit(e[3]).alias("duration")),
    )
    joined = trips.withColumn("_hit", found)
    return joined.select(*trips.columns, "_hit.distance", "_hit.duration")


def convert_currency(amounts: DataFrame, amount: str, code: str) -> DataFrame:
    """Adds the rate, the LKR amount and the answer text; unsupported codes get an error text."""
    low = strip(F.lower(F.col(code)))
    rate = _first_of(rules.CURRENCY_RATES, lambda e: low == e[0], lambda e: F.lit(e[1]))
    value = F.col(amount).cast("double")
    listed = ", ".join(c.upper() for c, _ in rules.CURRENCY_RATES)
    priced = amounts.withColumn("rate", rate).withColumn("lkr", value * F.col("rate"))
    answer = F.concat(
        value.cast("string"), F.lit(" "), F.upper(code), F.lit(" is equivalent to approximately "),
        F.format_number("lkr", 2), F.lit(" LKR (Exchange rate: 1 "), F.upper(code), F.lit(" = "),
        F.col("rate").cast("string"), F.lit(" LKR)."),
    )
    error = F.concat(
        F.lit("Unsupported currency '"), F.col(code), F.lit(f"'. Supported currencies: {listed}.")
    )
    return priced.withColumn("answer", F.when(F.col("rate").isNull(), error).otherwise(answer))


def weather_codes(observations: DataFrame, location: str, code: str) -> DataFrame:
    """Adds the shown place, its position and the weather text of an observation."""
    low = strip(F.lower(F.col(location)))
    where = _first_of(
        rules.WEATHER_PLACES,
        lambda e: low.contains(e[0]) | F.lit(e[0]).contains(low),
        lambda e: F.struct(F.lit(e[1]).alias("lat"), F.lit(e[2]).alias("lng")),
    )
    text = _first_of(rules.WEATHER_CODES, lambda e: F.col(code) == e[0], lambda e: F.lit(e[1]))
    _, lat, lng = rules.WEATHER_PLACES[0]
    known = observations.withColumn("_where", where)
    shown = F.when(F.col("_where").isNull(), "Colombo (Default)").otherwise(F.initcap(location))
    return known.withColumns(
        {
            "shown": shown,
            "lat": F.coalesce("_where.lat", F.lit(lat)),
            "lng": F.coalesce("_where.lng", F.lit(lng)),
            "weather": F.coalesce(text, F.lit(rules.WEATHER_DEFAULT)),
        }
    ).drop("_where")


def prompt_category(prompt: Column) -> Column:
    """First keyword category of a prompt, else General."""
    low = F.lower(prompt)
    found = _first_of(
        rules.PROMPT_CATEGORIES, lambda e: contains_any(low, e[1]), lambda e: F.lit(e[0])
    )
    return F.coalesce(found, F.lit("General"))
