"""Place records: ids, notes, budgets, default attributes and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderleaf.fixed import place_rules as rules
from cinderleaf.fixed import templates as text
from cinderleaf.functions.template import choose, contains_any, first_key, render
from cinderleaf.functions.text import strip


def place_id(name: Column) -> Column:
    return F.concat(F.lit("pl_"), F.substring(F.md5(name), 1, 8))


def first_name(df: DataFrame) -> Column:
    """First non-null of the known name columns that the table has; empty when none."""
    present = [strip(F.col(c).cast("string")) for c in rules.NAME_COLUMNS if c in df.columns]
    return F.coalesce(*present, F.lit(""))


def field(df: DataFrame, names: list[str], default: str) -> Column:
    """First present column of the aliases as trimmed text, else the default."""
    present = [F.col(n).cast("string") for n in names if n in df.columns]
    return strip(F.coalesce(*present, F.lit(default)))


def number(df: DataFrame, names: list[str]) -> Column:
    present = [F.col(n).cast("double") for n in names if n in df.columns]
    return F.coalesce(*present, F.lit(0.0))


def spans(name: Column, short_keys: bool = False) -> Column:
    """Districts a river or road crosses, joined by a comma; null for other names."""
    entries = [
        (rules.SHORT_ROADS.get(key, key) if short_keys else key, ", ".join(districts))
        for key, districts in rules.SPANS
    ]
    return first_key(F.lower(name), entries)


def place_note(name: Column, short: bool = False) -> Column:
    return first_key(F.lower(name), rules.SHORT_PLACE_NOTES if short else rules.PLACE_NOTES)


def history_note(name: Column) -> Column:
    return first_key(F.lower(name), rules.HISTORY_NOTES)


def name_notes(places: DataFrame, name: str = "name") -> DataFrame:
    """Adds spanned districts, disambiguation note and history note."""
    col = F.col(name)
    return places.withColumns(
        {"spans": spans(col), "note": place_note(col), "history": history_note(col)}
    )


def nearest_centre(lat: Column, lng: Column, centres: list[tuple] | None = None) -> Column:
    """Struct (district, province) of the closest centre by squared degrees; first wins ties."""
    places = centres or rules.DISTRICTS
    squares = F.array(
        *[(lat - c_lat) * (lat - c_lat) + (lng - c_lng) * (lng - c_lng) for _, c_lat, c_lng, _ in places]
    )
    at = F.array_position(squares, F.array_min(squares)).cast("int")  # the first of equal distances
    known = lat.isNotNull() & lng.isNotNull()

    def label(i: int) -> Column:
        names = F.array(*[F.lit(place[i]) for place in places])
        return F.when(known, F.element_at(names, at)).otherwise("Unknown")

    return F.struct(label(0).alias("district"), label(3).alias("province"))


def entry_fee(ticket: Column) -> Column:
    """Entry fee in LKR: 0 for free words, the first whole number, else the default."""
    first = F.regexp_extract(F.regexp_replace(ticket, ",", ""), r"(?U)\d+", 0)
    return F.when(is_free(ticket), 0).otherwise(
        F.coalesce(first.try_cast("int"), F.lit(rules.BUDGET_DEFAULT_ENTRY))
    )


def is_free(ticket: Column) -> Column:
    low = F.lower(ticket)
    return low.contains("free") | low.contains("no cost") | ticket.isin("0", "")


def budget(ticket: Column, popularity: Column, road: Column) -> Column:
    """Struct (is_free, entry, food, transport, total, level) of an estimated visit budget."""
    rough = contains_any(F.lower(road), rules.ROUGH_ROADS)
    entry = entry_fee(ticket)
    food = F.when(popularity == "High", rules.BUDGET_FOOD["High"]).otherwise(rules.BUDGET_FOOD["other"])
    ride = F.when(rough, rules.BUDGET_TRANSPORT["rough"]).otherwise(rules.BUDGET_TRANSPORT["other"])
    total = entry + food + ride
    low, mid = rules.BUDGET_LEVELS
    level = F.when(total < low, 0).when(total < mid, 1).otherwise(2)
    return F.struct(
        is_free(ticket).alias("is_free"),
        entry.alias("entry"),
        food.alias("food"),
        ride.alias("transport"),
        total.alias("total"),
        level.alias("level"),
    )


def category_rule(category: Column) -> Column:
    """Name of the first category rule that applies; null for none."""
    low = F.lower(category)
    rule = None
    for name, parts, equal in rules.CATEGORY_RULES:
        hit = contains_any(low, parts) | low.isin(equal) if equal else contains_any(low, parts)
        rule = F.when(hit, name) if rule is None else rule.when(hit, name)
    return rule


def description(name: Column, category: Column, district: Column, province: Column) -> Column:
    """Template picked by the sum of the name's code points modulo 4."""
    slots = {"name": name, "category": F.lower(category), "district": district, "province": province}
    points = F.transform(F.split(name, ""), lambda ch: F.ascii(ch))
    pick = F.aggregate(points, F.lit(0), lambda acc, p: acc + p) % len(rules.DESCRIPTIONS)
    out = F.lit(None).cast("string")
    for i, template in enumerate(rules.DESCRIPTIONS):
        out = F.when(pick == i, render(template, slots)).otherwise(out)
    return out


def place_defaults(places: DataFrame) -> DataFrame:
    """Adds the rule-based attributes to (name, category, district, province, lat, opening_hours)."""
    ruled = places.withColumn("_rule", category_rule(F.col("category")))
    rule, low = F.col("_rule"), F.lower(F.col("name"))
    popular = contains_any(low, rules.POPULAR_NAMES)
    costly = contains_any(low, rules.COSTLY_NAMES) & popular
    south, north = rules.BEACH_SEASONS
    values: dict[str, Column] = {}
    for attribute, default in rules.PLACE_DEFAULTS.items():
        value = F.lit(default)
        for name, overrides in rules.RULE_VALUES.items():
            if attribute in overrides:
                value = F.when(rule == name, overrides[attribute]).otherwise(value)
        if attribute == "best_time_to_visit":
            season = F.when(F.col("lat") < rules.BEACH_LATITUDE, south).otherwise(north)
            value = F.when(rule == "beach", season).otherwise(value)
        if attribute == "tourist_popularity":
            value = F.when(popular, "High").otherwise(value)
        if attribute in rules.COSTLY_VALUES:
            value = F.when(costly, rules.COSTLY_VALUES[attribute]).otherwise(value)
        values[attribute] = value
    hours = F.col("opening_hours")
    known = hours.isNotNull() & ~hours.isin("", "Unknown")
    values["opening_hours"] = F.when(known, hours).otherwise("24 Hours")
    values["description"] = description(
        F.col("name"), F.col("category"), F.col("district"), F.col("province")
    )
    return ruled.withColumns(values).drop("_rule")


def place_document(df: DataFrame) -> Column:
    """One retrieval sentence per place, with defaults for absent fields."""
    slots = {
        "name": field(df, ["name"], "Unknown"),
        "category": field(df, ["category_id", "category"], "Place"),
        "district": field(df, ["district_id", "district"], "Unknown"),
        "desc": field(df, ["description"], "No description available."),
        "activities": field(df, ["activities"], "Sightseeing"),
        "best_time": field(df, ["best_time_to_visit"], "All year round"),
        "ticket": field(df, ["ticket_price", "ticket"], "Free"),
        "safety": field(df, ["safety_level"], "Safe"),
        "parking": field(df, ["parking_avail", "parking"], "Unknown"),
    }
    return render(text.PLACE_SENTENCE, slots)


def clean_description(desc: Column) -> Column:
    """Blank, null and placeholder descriptions become empty."""
    low = F.lower(desc)
    placeholder = low.contains("beautiful beaches") | low.contains("no description")
    return F.when(desc.isNull() | placeholder, "").otherwise(desc)


def sinhala_term(term: Column) -> Column:
    """Localised term, the term itself when unknown, a fixed word when empty."""
    low = F.lower(strip(term))
    pairs = [F.lit(x) for entry in rules.SINHALA_TERMS for x in entry]
    known = F.try_element_at(F.create_map(*pairs), low)
    empty = term.isNull() | (term == "")
    return F.when(empty, rules.UNKNOWN_TERM).otherwise(F.coalesce(known, term))


def _stage(df: DataFrame, slots: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """Slots as columns of their own, so that later expressions refer to them by name."""
    return (
        df.withColumns({f"_s_{name}": value for name, value in slots.items()}),
        {name: F.col(f"_s_{name}") for name in slots},
    )


def with_place_slots(df: DataFrame, short_notes: bool = False) -> tuple[DataFrame, dict[str, Column]]:
    """The table with every value the place templates can refer to, and those values by slot name."""
    lead = " ⚠️ Disambiguation: " if short_notes else " ⚠️ Note: "
    df, base = _stage(
        df,
        {
            "name": field(df, ["name"], "Unknown"),
            "district": field(df, ["district_id", "district"], "Unknown"),
            "province": field(df, ["province_id", "province"], "Unknown"),
            "category": field(df, ["category_id", "category"], "Place"),
            "lat": F.format_string("%.4f", number(df, ["lat", "latitude"])),
            "lng": F.format_string("%.4f", number(df, ["lng", "longitude"])),
            "desc": field(df, ["description"], ""),
            "best_time": field(df, ["best_time_to_visit"], "All year round"),
            "activities": field(df, ["activities"], "Sightseeing"),
            "popularity": field(df, ["tourist_popularity"], "Medium"),
            "safety": field(df, ["safety_level"], "Safe"),
            "road": field(df, ["road_condition"], "Paved"),
            "rain": field(df, ["rain_sensitivity"], "Safe"),
            "monsoon": field(df, ["monsoon_note"], "None"),
            "ticket_str": field(df, ["ticket_price", "ticket"], "Free"),
            "family": field(df, ["family_friendly"], "yes"),
        },
    )
    popularity, rain = base["popularity"], F.lower(base["rain"])
    note = place_note(base["name"], short_notes)
    df, more = _stage(
        df,
        {
            "cost": budget(base["ticket_str"], popularity, base["road"]),
            "rough": contains_any(F.lower(base["road"]), rules.ROUGH_ROADS),
            "is_family": F.lower(base["family"]).contains("yes"),
            "risky": rain.contains("high") | rain.contains("unsafe"),
            "pop_low": F.lower(popularity),
            "pop_si": F.coalesce(
                *[F.when(popularity == k, v) for k, v in text.POPULARITY_SI.items()], popularity
            ),
            "note": F.concat(F.lit(lead), note),
            "spans": spans(base["name"], short_notes),
            "history": history_note(base["name"]),
        },
    )
    slots = base | more
    free, busy = slots["cost"]["is_free"], popularity == "High"
    conditions = {
        "entry_si": free, "entry_en": free, "food_si": busy, "food_en": busy,
        "transport_si": slots["rough"], "transport_en": slots["rough"],
    }
    phrases = {n: choose(c, text.BUDGET_PHRASES[n], slots) for n, c in conditions.items()}
    for name, labels in [("level_si", text.BUDGET_LEVEL_SI), ("level_en", text.BUDGET_LEVEL_EN)]:
        listed = F.array(*[F.lit(label) for label in labels])
        phrases[name] = F.element_at(listed, slots["cost"]["level"] + 1)
    df, phrases = _stage(df, phrases)
    slots |= phrases
    conditions = {
        "free_si": free, "free_en": free, "rain_col": slots["risky"],
        **{n: slots["is_family"] for n in ("family_si", "family_en", "family_col")},
    }
    df, choices = _stage(df, {n: choose(c, text.CHOICES[n], slots) for n, c in conditions.items()})
    return df, slots | choices
