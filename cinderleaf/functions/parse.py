"""Parsers for model output: place JSON, food JSON and tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderleaf.fixed import food_rules as rules
from cinderleaf.functions.text import strip

TEXT_MAP = "map<string,string>"


def _unfenced(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"```(?:json)?\s*", ""))


def _valid(body: Column) -> Column:
    return F.try_parse_json(body).isNotNull()


def parse_model_json(df: DataFrame, text: str, output: str = "fields") -> DataFrame:
    """Adds the field map of the outermost JSON object; field by field when the JSON is broken."""
    body = F.regexp_extract(_unfenced(F.col(text)), r"(?s)\{.*\}", 0)
    cut = df.withColumn("_body", F.regexp_replace(body, r",\s*(?=[}\]])", ""))
    body = F.col("_body")
    found = [_text_entry(body, name) for name in rules.PLACE_TEXT_FIELDS]
    found += [_number_entry(body, name) for name in rules.PLACE_NUMBER_FIELDS]
    entries = F.when(~_valid(body), F.array_compact(F.array(*found)))
    loose = cut.withColumn("_entries", entries)
    fields = F.when(F.col("_entries").isNull(), F.from_json(body, TEXT_MAP)).when(
        F.size("_entries") >= rules.MIN_FIELDS, F.map_from_entries("_entries")
    )
    return loose.withColumn(output, fields).drop("_body", "_entries")


def _text_entry(body: Column, name: str) -> Column:
    pattern = rf'(?is)"{name}"\s*:\s*"(.*?)"'
    value = F.regexp_replace(F.regexp_extract(body, pattern, 1), "\n", " ")
    return F.when(body.rlike(pattern), F.struct(F.lit(name), strip(value)))


def _number_entry(body: Column, name: str) -> Column:
    pattern = rf'(?i)"{name}"\s*:\s*([+-]?\d*\.\d+|[+-]?\d+)'
    return F.when(
        body.rlike(pattern), F.struct(F.lit(name), F.regexp_extract(body, pattern, 1))
    )


def fenced_json(text: Column) -> Column:
    """Body of the first ```json block; null when there is none or it does not parse."""
    body = F.regexp_extract(text, r"(?s)```json\n(.*?)\n```", 1)
    return F.when(_valid(body), body)


def _named(fields: Column) -> Column:
    keys = [F.nullif(F.try_element_at(fields, F.lit(k)), F.lit("")) for k in rules.FOOD_NAME_KEYS]
    return F.coalesce(*keys)


def _pair(name: Column, fields: Column) -> Column:
    return F.struct(name.alias("name"), fields.alias("fields"))


def _parsed_foods(body: Column) -> Column:
    listed = F.transform(
        F.from_json(body, f"array<{TEXT_MAP}>"), lambda fields: _pair(_named(fields), fields)
    )
    keyed = F.transform(
        F.filter(F.map_entries(F.from_json(body, TEXT_MAP)), lambda e: e["value"].startswith("{")),
        lambda e: _pair(e["key"], F.from_json(e["value"], TEXT_MAP)),
    )
    foods = F.when(body.startswith("["), listed).otherwise(keyed)
    return F.when(_valid(body), F.filter(foods, lambda f: f["name"].isNotNull()))


def _loose_foods(text: Column) -> Column:
    keyed = r'"([^"]+)":\s*\{([^}]+)\}'
    by_key = F.zip_with(
        F.regexp_extract_all(text, F.lit(keyed), F.lit(1)),
        F.regexp_extract_all(text, F.lit(keyed), F.lit(2)),
        lambda name, inner: F.struct(
            strip(F.regexp_replace(name, ":+$", "")).alias("name"),
            F.concat(F.lit("{"), inner, F.lit("}")).alias("body"),
        ),
    )
    named = r'(?i)(\{[^{}]*(?:"food_name"|"foodname"|"name"|"item_name"|"item"|"dish")[^{}]*\})'
    by_object = F.transform(
        F.regexp_extract_all(text, F.lit(named), F.lit(1)),
        lambda body: F.struct(F.lit(None).cast("string").alias("name"), body.alias("body")),
    )
    usable = F.filter(F.concat(by_key, by_object), lambda c: _valid(c["body"]))
    foods = F.transform(
        usable,
        lambda c: _pair(
            F.coalesce(c["name"], _named(F.from_json(c["body"], TEXT_MAP)), _first_word(c["body"])),
            F.from_json(c["body"], TEXT_MAP),
        ),
    )
    return F.filter(foods, lambda f: f["name"].isNotNull())


def _first_word(body: Column) -> Column:
    """First value that is not a number, for objects without a usable name key."""
    nutrient = ["calories", "protein", "carbs", "fat", "fats", "carbohydrates"]
    texts = F.filter(
        F.map_entries(F.from_json(body, TEXT_MAP)),
        lambda e: ~F.lower(e["key"]).isin(nutrient) & e["value"].try_cast("double").isNull(),
    )
    return F.get(texts, F.lit(0))["value"]


def _nutrient(fields: Column, name: str) -> Column:
    """First alias that is present and not zero; the last alias may be zero."""
    *first, last = rules.NUTRIENT_KEYS[name]
    values = [F.nullif(_as_number(fields, key), F.lit(0.0)) for key in first]
    return F.coalesce(*values, _as_number(fields, last))


def _as_number(fields: Column, key: str) -> Column:
    return F.try_element_at(fields, F.lit(key)).try_cast("double")


def parse_food_json(df: DataFrame, text: str) -> DataFrame:
    """One row per food found in the model output, with resolved nutrients."""
    cut = df.withColumn("_clean", F.regexp_replace(F.col(text), "```json|```", ""))
    body = F.regexp_extract("_clean", r"(?s)^[^{\[]*(\{.*\}|\[.*\])", 1)
    cut = cut.withColumn("_body", body)
    cut = cut.withColumn("_found", _parsed_foods(F.col("_body")))
    none = F.col("_found").isNull() | (F.size("_found") == 0)
    foods = cut.withColumn("_food", F.explode(F.when(none, _loose_foods(F.col("_clean"))).otherwise(F.col("_found"))))
    fields = F.col("_food.fields")
    return (
        foods.withColumns(
            {
                "food": F.lower(F.trim(F.col("_food.name"))),
                "calories": F.floor(_nutrient(fields, "calories")).cast("int"),
                "protein": _nutrient(fields, "protein"),
                "carbs": F.coalesce(_nutrient(fields, "carbs"), F.lit(rules.DEFAULT_CARBS)),
                "fat": F.coalesce(_nutrient(fields, "fat"), F.lit(rules.DEFAULT_FAT)),
            }
        )
        .drop("_food", "_found", "_body", "_clean")
        .where("calories IS NOT NULL AND protein IS NOT NULL")
    )


def tool_calls(df: DataFrame, text: str) -> DataFrame:
    """One row per JSON tool call in the text; calls that do not parse are skipped."""
    bodies = F.regexp_extract_all(
        F.col(text), F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1)
    )
    calls = df.select("*", F.posexplode(bodies).alias("call_pos", "_body"))
    calls = calls.where(_valid(F.col("_body")))
    return calls.select(
        *df.columns,
        "call_pos",
        F.get_json_object("_body", "$.name").alias("tool"),
        F.get_json_object("_body", "$.arguments").alias("arguments"),
    )
