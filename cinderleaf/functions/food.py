"""Dish and component rules: styling, spice, price, voice and advice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderleaf.fixed import food_rules as rules
from cinderleaf.functions.template import contains_any, render


def _ordered(text: Column, options: list[tuple[list[str], Column]]) -> Column:
    """The value of the first option with a word in the text; an empty word list always applies."""
    out = None
    for words, value in options:
        if not words:
            return value if out is None else out.otherwise(value)
        hit = contains_any(text, words)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def macro_tag(name: Column) -> Column:
    """Struct (tag, color, depth_cm, volume_ml) of a component."""
    options = [
        (
            words,
            F.struct(
                F.lit(tag).alias("tag"),
                F.lit(color).alias("color"),
                F.lit(depth).alias("depth_cm"),
                F.lit(volume).alias("volume_ml"),
            ),
        )
        for tag, color, depth, volume, words in rules.MACRO_TAGS
    ]
    return _ordered(F.lower(F.trim(name)), options)


def plate_box(pos: Column) -> Column:
    """Struct (x, y, w, h) of the plate cell a component index falls into."""
    cells = [
        F.struct(*[F.lit(v).alias(n) for n, v in zip("xywh", cell)]) for cell in rules.PLATE_GRID
    ]
    return F.element_at(F.array(*cells), (pos % len(cells) + 1).cast("int"))


def spice_alert(dish: Column, component_names: Column) -> Column:
    """Struct (is_emergency, level, badge, remedy, action)."""
    text = F.lower(F.concat(dish, F.lit(" "), F.array_join(component_names, " ")))
    fiery = contains_any(text, rules.FIERY_WORDS)

    def outcome(flag: bool) -> Column:
        level, badge, remedy, action = rules.SPICE_ALERT[flag]
        return F.struct(
            F.lit(flag).alias("is_emergency"),
            F.lit(level).alias("level"),
            F.lit(badge).alias("badge"),
            F.lit(remedy).alias("remedy"),
            F.lit(action).alias("action"),
        )

    return F.when(fiery, outcome(True)).otherwise(outcome(False))


def fair_price(dish: Column) -> Column:
    """Struct (lkr_min, lkr_max, max_reasonable_lkr, fair_price_lkr, fair_price_usd, advice)."""
    options = []
    for low, high, words in rules.PRICE_RULES:
        usd_low, usd_high = round(low / rules.LKR_PER_USD, 2), round(high / rules.LKR_PER_USD, 2)
        top = high + rules.PRICE_MARGIN
        advice = (
            f"💡 Fair Local Price: Rs. {low} - {high} (~${usd_low}-${usd_high}). "
            f"Avoid paying more than Rs. {top}! Politely check standard local menu."
        )
        value = F.struct(
            F.lit(low).alias("lkr_min"),
            F.lit(high).alias("lkr_max"),
            F.lit(top).alias("max_reasonable_lkr"),
            F.lit(f"Rs. {low} - {high}").alias("fair_price_lkr"),
            F.lit(f"~ ${usd_low} - ${usd_high} USD").alias("fair_price_usd"),
            F.lit(advice).alias("advice"),
        )
        options.append((words, value))
    return _ordered(F.lower(dish), options)


def confidence_state(confidence: Column, nutrition_confidence: Column | None = None) -> Column:
    """'high' or 'estimated'; the nutrition confidence takes part when it is given."""
    high = confidence >= rules.HIGH_CONFIDENCE
    if nutrition_confidence is not None:
        high = high & (nutrition_confidence >= rules.HIGH_NUTRITION)
    return F.when(high, "high").otherwise("estimated")


def badge_color(confidence: Column, emergency: Column) -> Column:
    color = F.when(confidence >= rules.HIGH_CONFIDENCE, rules.BADGE_HIGH)
    return F.when(emergency, rules.BADGE_EMERGENCY).otherwise(color.otherwise(rules.BADGE_ESTIMATED))


def guide_text(dish: Column, lang: Column) -> Column:
    """Struct (language, greeting, speech_text, tts_locale); unknown languages use English."""

    def voice(code: str) -> Column:
        greeting, summary, locale = rules.VOICE[code]
        return F.struct(
            F.upper(lang).alias("language"),
            F.lit(greeting).alias("greeting"),
            F.concat(F.lit(greeting + " "), render(summary, {"dish": dish})).alias("speech_text"),
            F.lit(locale).alias("tts_locale"),
        )

    out = voice("en")
    for code in rules.VOICE:
        if code != "en":
            out = F.when(F.lower(lang) == code, voice(code)).otherwise(out)
    return out


def _by_mode(mode: Column, phrases: dict[str, str], slots: dict[str, Column]) -> Column:
    out = render(phrases["normal"], slots)
    for name, phrase in phrases.items():
        if name != "normal":
            out = F.when(mode == name, render(phrase, slots)).otherwise(out)
    return out


def advice(context: Column, mode: Column, calories: Column, protein: Column) -> Column:
    slots = {"context": context, "calories": calories, "protein": protein}
    return _by_mode(mode, rules.ADVICE, slots)


def plate_advice(mode: Column, protein: Column) -> Column:
    return _by_mode(mode, rules.PLATE_ADVICE, {"protein": protein})


def knowledge_text(content: Column, kind: Column, spiciness: Column) -> Column:
    """Knowledge sentence of a retrieved row; a fixed sentence when nothing was found."""
    slots = {
        "content": content,
        "type": F.coalesce(kind, F.lit("Traditional")),
        "spiciness": F.coalesce(spiciness, F.lit("Unknown")),
    }
    found = render(rules.KNOWLEDGE_TEXT, slots)
    return F.when(content.isNull(), rules.KNOWLEDGE_NONE).otherwise(found)


def clean_component(name: Column) -> Column:
    """Name without punctuation; null when one character or less is left."""
    clean = F.regexp_replace(name, r"(?U)[^\p{L}\p{N}_\s]", "")
    clean = F.trim(clean)
    return F.when(F.length(clean) > 1, clean)


def clean_components(components: Column) -> Column:
    """Array of component structs with cleaned names, unusable ones removed."""
    cleaned = F.transform(components, lambda c: c.withField("name", clean_component(c["name"])))
    return F.filter(cleaned, lambda c: c["name"].isNotNull())
