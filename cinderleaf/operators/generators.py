"""Question-answer, preference and portion samples expanded from records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderleaf.fixed import food_rules as food
from cinderleaf.fixed import templates as text
from cinderleaf.functions.place import clean_description, sinhala_term, with_place_slots
from cinderleaf.functions.template import choose, contains_any, render
from cinderleaf.functions.text import draw, md5_fraction, strip
from cinderleaf.operators.ordered import dense_index
from cinderleaf.session import bounded, fixed_table

PAIR = "instruction", "input", "output"


def _with_slots(df: DataFrame, slots: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """The table with one column per slot, so that templates refer to computed columns."""
    filled = df.select("*", *[value.alias(f"_s_{name}") for name, value in slots.items()])
    return filled, {name: F.col(f"_s_{name}") for name in slots}


def _category_kind(category: Column) -> Column:
    low, kind = F.lower(category), None
    for name, parts in text.CATEGORY_KINDS:
        hit = contains_any(low, parts)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return kind


def qa_pairs(places: DataFrame, keep: list[str]) -> DataFrame:
    """One row per place and applicable question: lang, family, seq, instruction, input, output."""
    filled, col = with_place_slots(places)
    filled = filled.withColumn("_s_kind", _category_kind(col["category"]))
    conditions = {
        "": F.lit(True),
        "described": F.length(col["desc"]) > 10,
        "spans": col["spans"].isNotNull(),
        "history": col["history"].isNotNull(),
        "monsoon": (col["monsoon"] != "") & (F.lower(col["monsoon"]) != "none"),
    }
    for kind, _ in text.CATEGORY_KINDS:
        conditions[kind] = F.coalesce(F.col("_s_kind") == kind, F.lit(False))
    rows = [
        F.when(
            conditions[condition],
            F.struct(
                F.lit(lang).alias("lang"),
                F.lit(family).alias("family"),
                F.lit(seq).alias("seq"),
                render(ask, col).alias("instruction"),
                F.lit("").alias("input"),
                render(answer, col).alias("output"),
            ),
        )
        for seq, (family, lang, condition, ask, answer) in enumerate(text.PLACE_QUESTIONS)
    ]
    return filled.select(*keep, F.inline(F.array_compact(F.array(*rows))))


def disambiguation_pairs(places: DataFrame, keep: list[str]) -> DataFrame:
    """Five to eight question rows per place with the short note dictionaries."""
    filled, col = with_place_slots(places, short_notes=True)
    conditions = {
        "": F.lit(True),
        "spans": col["spans"].isNotNull(),
        "text": col["desc"] != "",
    }
    rows = [
        F.when(
            conditions[condition],
            F.struct(
                F.lit(seq).alias("seq"),
                render(ask, col).alias("instruction"),
                F.lit("").alias("input"),
                render(answer, col).alias("output"),
            ),
        )
        for seq, (condition, ask, answer) in enumerate(text.DISAMBIGUATION_QUESTIONS)
    ]
    return filled.select(*keep, F.inline(F.array_compact(F.array(*rows))))


def aggregate_pairs(
    districts: DataFrame, categories: DataFrame, free: DataFrame, assistant: str = "Assistant"
) -> DataFrame:
    """Question rows from the three recommendation tables."""

    def expand(groups: DataFrame, name: str, questions: list[tuple[str, str]]) -> DataFrame:
        slots = {"group": F.col(name), "names": F.col("names"), "assistant": F.lit(assistant)}
        rows = [
            F.struct(
                F.lit(seq).alias("seq"),
                render(ask, slots).alias("instruction"),
                F.lit("").alias("input"),
                render(answer, slots).alias("output"),
            )
            for seq, (ask, answer) in enumerate(questions)
        ]
        return groups.select(F.inline(F.array(*rows)))

    return (
        expand(districts, "district", text.DISTRICT_QUESTIONS)
        .unionByName(expand(categories, "category", text.CATEGORY_QUESTIONS))
        .unionByName(expand(free, "district", text.FREE_QUESTIONS))
    )


PLACE_JSON = (
    "name string, description string, category_id string, parking_avail string, toilets string, "
    "safety_level string, mobile_signal string"
)


def _place_details(records: DataFrame, messages: str) -> DataFrame:
    """Records whose second message holds a JSON object, with its fields in `_p`."""
    body = F.get(F.col(messages), F.lit(1))["content"]
    usable = records.where(body.startswith("{") & F.try_parse_json(body).isNotNull())
    return usable.withColumn("_p", F.from_json(body, PLACE_JSON))


def _bilingual_slots(mobile: bool) -> dict[str, Column]:
    def get(name: str, default: str) -> Column:
        return F.coalesce(F.col(f"_p.{name}"), F.lit(default))

    desc = clean_description(get("description", ""))
    parking, toilets = get("parking_avail", "no"), get("toilets", "no")
    desc_si = desc
    for word, local in text.SI_WORDS:
        desc_si = F.replace(desc_si, F.lit(word), F.lit(local))
    slots = {
        "name": get("name", "Unknown Place"),
        "category": get("category_id", "place"),
        "category_si": sinhala_term(get("category_id", "place")),
        "safety": get("safety_level", "Safe"),
        "safety_si": sinhala_term(get("safety_level", "Safe")),
        "parking": parking,
        "toilets": toilets,
        "desc": desc,
        "desc_si": desc_si,
        "parking_si": F.when(F.lower(parking) == "yes", text.SI_PARKING[0]).otherwise(text.SI_PARKING[1]),
        "toilets_si": F.when(F.lower(toilets) == "yes", text.SI_TOILETS[0]).otherwise(text.SI_TOILETS[1]),
    }
    if mobile:
        slots["mobile"] = get("mobile_signal", "good")
        slots["mobile_si"] = sinhala_term(get("mobile_signal", "good"))
    return slots


def _describe(col: dict[str, Column], mobile: bool) -> tuple[Column, Column]:
    """English and Sinhala descriptions."""
    described = col["desc"] != ""
    english = F.concat(
        render(text.EN_INTRO, col),
        F.when(described, F.concat(F.lit(" "), col["desc"])).otherwise(text.EN_PLAIN),
        render(text.EN_FACTS + (text.EN_SIGNAL if mobile else ""), col),
    )
    plain = text.SI_PLAIN if mobile else text.SI_PLAIN_PAIR
    sinhala = F.concat(
        render(text.SI_INTRO, col),
        F.when(described, render(text.SI_ABOUT, col)).otherwise(plain),
        render(text.SI_SAFETY + text.SI_FACILITIES + (text.SI_SIGNAL if mobile else ""), col),
    )
    return english, sinhala


def chat(*turns: tuple[str, Column]) -> Column:
    """Message array from (role, content) turns."""
    return F.array(
        *[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in turns]
    )


def bilingual_sft(records: DataFrame, keep: list[str], messages: str = "messages") -> DataFrame:
    """English and Sinhala chat rows per usable record: lang, messages."""
    filled, col = _with_slots(_place_details(records, messages), _bilingual_slots(mobile=True))
    english, sinhala = _describe(col, mobile=True)
    rows = [
        F.struct(
            F.lit(lang).alias("lang"),
            chat(("user", render(ask, col)), ("assistant", answer)).alias("messages"),
        )
        for lang, ask, answer in [("en", text.EN_ASK, english), ("si", text.SI_ASK, sinhala)]
    ]
    return filled.select(*keep, F.inline(F.array(*rows)))


def preference_pairs(records: DataFrame, keep: list[str], messages: str = "messages") -> DataFrame:
    """English and Sinhala preference rows per usable record: lang, prompt, chosen, rejected."""
    filled, col = _with_slots(_place_details(records, messages), _bilingual_slots(mobile=False))
    english, sinhala = _describe(col, mobile=False)
    options = [
        ("en", text.PAIR_EN_ASK, english, text.PAIR_EN_REJECTED),
        ("si", text.SI_ASK, sinhala, text.PAIR_SI_REJECTED),
    ]
    rows = [
        F.struct(
            F.lit(lang).alias("lang"),
            render(ask, col).alias("prompt"),
            chosen.alias("chosen"),
            render(rejected, col).alias("rejected"),
        )
        for lang, ask, chosen, rejected in options
    ]
    return filled.select(*keep, F.inline(F.array(*rows)))


def seed_pairs(spark) -> DataFrame:
    """The fixed preference pairs that lead every generated set."""
    return fixed_table(spark, text.SEED_PAIRS, "prompt string, chosen string, rejected string")


def with_seed_pairs(pairs: DataFrame) -> DataFrame:
    """The fixed pairs and `pairs`; the fixed ones have nulls in all other columns."""
    return pairs.unionByName(seed_pairs(pairs.sparkSession), allowMissingColumns=True)


def synthetic_pairs(
    spots: DataFrame, order: str, kind: str, n: int, seed: int = 42, assistant: str = "Assistant"
) -> DataFrame:
    """`n` rows of a drawn place and template: chat rows for 'sft', preference rows for 'dpo'."""
    indexed = dense_index(spots, [order], "_spot")
    total = indexed.count()
    templates = text.SYNTHETIC_SFT if kind == "sft" else text.SYNTHETIC_PAIRS
    draws = spots.sparkSession.range(n).select(
        F.col("id").alias("draw"),
        draw(total, seed, "spot", F.col("id")).cast("long").alias("_spot"),
        draw(len(templates), seed, "template", F.col("id")).alias("_t"),
    )

    def raw(name: str, default: str = "") -> Column:
        known = F.col(name).cast("string") if name in spots.columns else F.lit(None).cast("string")
        return F.coalesce(known, F.lit(default))

    slots = {name: raw(name, default) for name, default in text.SYNTHETIC_DEFAULTS.items()}
    for name, (yes, no) in text.SYNTHETIC_FLAGS.items():
        slots[name] = F.when(F.lower(raw(name)) == "yes", yes).otherwise(no)
    risky = F.lower(slots["wildlife_hazard"]) != "none"
    slots["hazard"] = choose(risky, text.HAZARD_TEXT, slots)
    drawn, col = _with_slots(draws.join(indexed, "_spot"), slots)

    def pick(part: int) -> Column:
        out = render(templates[0][part], col)
        for i, template in enumerate(templates[1:], 1):
            out = F.when(F.col("_t") == i, render(template[part], col)).otherwise(out)
        return out

    if kind == "sft":
        system = F.lit(text.TRAVEL_SYSTEM.replace("{assistant}", assistant))
        turns = chat(("system", system), ("user", pick(0)), ("assistant", pick(1)))
        return drawn.select("draw", turns.alias("messages"))
    return drawn.select(
        "draw", pick(0).alias("prompt"), pick(1).alias("chosen"), pick(2).alias("rejected")
    )


def csv_to_sft(
    rows: DataFrame, instruction: str, response: str, extra: str | None, system: str, keep: list[str]
) -> DataFrame:
    """Chat rows of complete instruction rows; the input column joins the user turn."""
    ask, answer = strip(F.col(instruction)), strip(F.col(response))
    more = strip(F.col(extra)) if extra else F.lit("")
    user = F.when(more != "", strip(F.concat(ask, F.lit("\n"), more))).otherwise(ask)
    full = rows.where((ask != "") & (answer != ""))
    turns = chat(("system", F.lit(system)), ("user", user), ("assistant", answer))
    return full.select(*keep, turns.alias("messages"))


def portion_samples(
    foods: DataFrame, n: int, seed: int = 42, assistant: str = "Kitchen", order: str = "prio"
) -> DataFrame:
    """`n` drawn plates: sample, plate, dish_name, total_calories, components, user, answer.

    `foods(prio, name, calories, protein, carbs, fat)`. Plates hold two to four different foods,
    glasses one beverage.
    """
    indexed = dense_index(foods, [order], "_at")
    total = indexed.count()
    sips = dense_index(foods.where(contains_any(F.lower("name"), food.BEVERAGE_WORDS)), [order], "_at")
    n_sips = sips.count()
    base = foods.sparkSession.range(n).select(F.col("id").alias("sample"))
    key = F.col("sample")
    plates = F.array(
        *[F.struct(F.lit(p).alias("plate"), F.lit(a).cast("int").alias("area")) for p, a in food.PLATES]
    )
    base = base.withColumn("_plate", F.get(plates, draw(len(food.PLATES), seed, "plate", key)))
    base = base.select("sample", "_plate.*").withColumn("glass", F.col("plate").contains("Glass"))

    count = F.least(F.lit(total), draw(3, seed, "items", key) + 2)
    picked = _distinct_draws(count, total, seed, key)
    spots = F.transform(
        picked,
        lambda at, i: F.struct(
            i.alias("pos"),
            at.cast("long").alias("_at"),
            (draw(31, seed, "share", key, i.cast("string")) + 20).alias("share"),
        ),
    )
    meals = base.where("NOT glass").select("*", F.inline(spots))
    shares = F.aggregate(F.transform(spots, lambda s: s["share"]), F.lit(0), lambda a, s: a + s)
    meals = meals.withColumn("_all", shares).join(bounded(indexed), "_at")
    percent = F.floor(F.col("share") / F.col("_all") * food.PLATE_FILL)
    grams = F.greatest(F.floor(percent * food.GRAMS_PER_PERCENT), F.lit(food.MIN_GRAMS))
    low = F.lower("name")
    portion = (
        F.when(low.contains("rice"), F.concat(F.round(grams / 180, 1).cast("string"), F.lit(" cup ("), grams, F.lit("g)")))
        .when(
            contains_any(low, ["hopper", "roti", "dosa"]),
            F.concat(F.greatest(F.lit(1), F.bround(grams / 70).cast("int")).cast("string"), F.lit(" pieces ("), grams, F.lit("g)")),
        )
        .otherwise(F.concat(grams, F.lit("g")))
    )
    meals = meals.withColumns({"percent": percent, "grams": grams, "portion": portion})
    drinks = base.where("glass").withColumn("pos", F.lit(0))
    source, size = (sips, n_sips) if n_sips else (indexed, total)
    drinks = drinks.withColumn("_at", draw(size, seed, "drink", key).cast("long")).join(bounded(source), "_at")
    drinks = drinks.withColumns(
        {
            "percent": F.lit(None).cast("long"),
            "grams": F.lit(food.BASE_GRAMS),
            "portion": F.lit("1 glass (300ml)"),
        }
    )
    shared = ["sample", "plate", "area", "glass", "pos", "name", "percent", "grams", "portion",
              "calories", "protein", "carbs", "fat"]
    parts = meals.withColumn("grams", F.col("grams").cast("double")).select(*shared).unionByName(
        drinks.select(*shared)
    )
    scale = F.col("grams") / food.BASE_GRAMS
    scaled = {c: F.round(F.col(c) * scale, 1) for c in ("calories", "protein", "carbs", "fat")}
    return _assemble(parts.withColumns(scaled), seed, assistant)


def _distinct_draws(count: Column, total: int, seed: int, key: Column) -> Column:
    """`count` different positions below `total`: each draw skips the positions already taken."""

    def skip_taken(value: Column, taken: Column) -> Column:
        return F.aggregate(F.array_sort(taken), value, lambda v, t: F.when(v >= t, v + 1).otherwise(v))

    def take(taken: Column, i: Column) -> Column:
        value = draw(F.lit(total) - i, seed, "food", key, i.cast("string"))
        return F.concat(taken, F.array(skip_taken(value, taken)))

    return F.aggregate(F.sequence(F.lit(0), count - 1), F.array().cast("array<int>"), take)


def _assemble(parts: DataFrame, seed: int, assistant: str) -> DataFrame:
    """One row per sample from its at most four component rows."""
    entry = F.struct(
        "pos", "name", F.col("portion").alias("estimated_portion"), "calories", "protein", "carbs",
        "fat", "percent", F.col("grams").cast("int").alias("grams"),
    )
    plates = parts.groupBy("sample", "plate", "area", "glass").agg(
        F.array_sort(F.collect_list(entry)).alias("_c")
    )
    first = F.initcap(F.get("_c", F.lit(0))["name"])
    dish = F.when(F.col("glass"), first).otherwise(
        F.concat(F.lit("Sri Lankan "), first, F.lit(" Combo Plate"))
    )
    calories = F.aggregate("_c", F.lit(0.0), lambda acc, c: acc + c["calories"])
    components = F.transform(
        "_c",
        lambda c: F.struct(
            c["name"].alias("name"), c["estimated_portion"].alias("estimated_portion"),
            c["calories"].alias("calories"), c["protein"].alias("protein"),
            c["carbs"].alias("carbs"), c["fat"].alias("fat"),
        ),
    )
    lines = F.transform(
        "_c",
        lambda c: F.concat(
            (c["pos"] + 2).cast("string"), F.lit(". Item '"), c["name"], F.lit("': Occupies ~"),
            c["percent"].cast("string"), F.lit("% of plate surface area with ~2.5cm depth. Estimated mass: "),
            c["grams"].cast("string"), F.lit("g. Calculated calories: ~"), c["calories"].cast("string"),
            F.lit(" kcal."),
        ),
    )
    frame = F.concat(
        F.lit("1. Reference Frame: Detected a "), "plate", F.lit(" (approx surface area "),
        F.col("area").cast("string"), F.lit(" cm²)."),
    )
    only = F.get("_c", F.lit(0))
    glass = F.concat(
        F.lit("1. Visual Reference Analysis: The image shows a "), "plate",
        F.lit(".\n2. Volume Estimation: The liquid level reaches roughly 85% of the total glass capacity (~300ml).\n3. Identification: The texture and color identify this as '"),
        only["name"],
        F.lit("'.\n4. Nutritional Calculation: Standard serving (1 glass / 300ml) provides approximately "),
        only["calories"].cast("int").cast("string"), F.lit(" kcal."),
    )
    thinking = F.when(F.col("glass"), glass).otherwise(F.concat_ws("\n", frame, F.array_join(lines, "\n")))
    ask = F.when(
        F.col("glass"),
        F.concat(
            F.lit("Identify the item in this image scan and estimate its portion size and nutrition. Camera metadata: "),
            "plate", F.lit(" filled to ~85% capacity."),
        ),
    ).otherwise(
        F.concat(
            F.lit("Analyze this food image scan. Identify all visible items on the "), "plate",
            F.lit(" and calculate exact portion sizes (grams/cups) and nutritional values."),
        )
    )
    confidence = F.round(md5_fraction(seed, "confidence", F.col("sample")) * 0.07 + 0.91, 2)
    built = plates.withColumns(
        {
            "dish_name": dish,
            "confidence": confidence,
            "total_calories": F.round(calories, 1),
            "components": components,
            "user": ask,
            "_thinking": thinking,
        }
    )
    answer = F.to_json(F.struct("dish_name", "confidence", "total_calories", "components"))
    reply = F.concat(F.lit("<think>\n"), "_thinking", F.lit("\n</think>\n```json\n"), answer, F.lit("\n```"))
    system = (
        f"You are {assistant} Food Vision AI. Analyze food scans, reason about portion sizes using "
        "visual geometry, and output precise nutritional JSON."
    )
    turns = chat(("system", F.lit(system)), ("user", F.col("user")), ("assistant", reply))
    return built.withColumn("messages", turns).drop("_c", "_thinking", "area")
