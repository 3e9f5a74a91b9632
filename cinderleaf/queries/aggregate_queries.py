"""Queries for statistics, profiles, nutrition, evaluation and ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderleaf.fixed import food_rules as food
from cinderleaf.fixed import guard_rules as rules
from cinderleaf.fixed import place_rules as places_
from cinderleaf.functions import food as dish
from cinderleaf.functions import scores, tokens
from cinderleaf.operators import aggregates, audit, catalog, folds, sampling, sequence
from cinderleaf.queries import sql as q
from cinderleaf.queries.place_queries import _FOOD_MATCH
from cinderleaf.queries.registry import query
from cinderleaf.queries.text_queries import KEY
from cinderleaf.queries.views import cte, table, values, view

# --- catalog ----------------------------------------------------------------------------------------


@query(
    "catalog_stats",
    f"""{cte('places')}, c AS (SELECT 'category' AS dim, category_id AS value FROM places UNION ALL SELECT 'safety', safety_level FROM places
 UNION ALL SELECT 'popularity', tourist_popularity FROM places UNION ALL SELECT 'total', 'total' FROM places),
k AS (SELECT dim, value, count(*) AS n FROM c GROUP BY 1, 2 UNION ALL SELECT * FROM (VALUES ('safety', 'Safe', 0), ('safety', 'Moderate', 0),
 ('safety', 'Dangerous', 0), ('popularity', 'High', 0), ('popularity', 'Medium', 0), ('popularity', 'Low', 0), ('total', 'total', 0)) v(dim, value, n))
SELECT dim, value, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1, 2""",
)
def catalog_stats(spark, sf):
    return catalog.catalog_stats(view(spark, sf, "places"))


@query(
    "district_density",
    f"""{cte('places')}, c AS (SELECT lower(district_id) AS district, count(*) AS n FROM places GROUP BY 1)
SELECT district, n, CASE WHEN n > 8 THEN '#ef4444' WHEN n > 3 THEN '#f59e0b' ELSE '#14b8a6' END AS color,
 least(35000, greatest(7000, n * 5000)) AS radius FROM c""",
)
def district_density(spark, sf):
    return catalog.district_density(view(spark, sf, "places"))


_RANK = "CASE tourist_popularity WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END"


def _top_sql(group: str, order: str, shown: str, where: str, least: int, name: str) -> str:
    return f"""{cte('places')}, p AS (SELECT *, {group} AS g FROM places WHERE {where}),
r AS (SELECT g, {shown} AS shown, row_number() OVER (PARTITION BY g ORDER BY {order}) AS k, count(*) OVER (PARTITION BY g) AS n FROM p)
SELECT g AS {name}, any_value(n) AS n, string_agg(shown, ', ' ORDER BY k) AS names FROM r WHERE k <= 5 AND n >= {least} GROUP BY g"""


@query("district_recommendations", _top_sql("district_id", f"{_RANK}, ord", "name", "true", 3, "district"))
def district_recommendations(spark, sf):
    return catalog.district_recommendations(view(spark, sf, "places"), "ord")


@query(
    "category_recommendations",
    _top_sql("category_id", f"{_RANK}, ord", "concat(name, ' (', district_id, ' District)')", "true", 3, "category"),
)
def category_recommendations(spark, sf):
    return catalog.category_recommendations(view(spark, sf, "places"), "ord")


@query("free_places", _top_sql("district_id", "ord", "name", "contains(lower(ticket_price), 'free')", 2, "district"))
def free_places(spark, sf):
    return catalog.free_places(view(spark, sf, "places"), "ord")


# --- instruction and preference tables ----------------------------------------------------------------------


_ROWS = """SELECT doc_id + 2 AS row_num, CASE WHEN doc_id % 41 = 0 THEN ' ' WHEN doc_id % 17 = 0 THEN lang ELSE source || ' ' || lang || ' text?' END AS ask,
 CASE WHEN doc_id % 37 = 0 THEN '' ELSE text END AS reply, CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS extra FROM documents"""


def _instruction_rows(spark, sf):
    sql = _ROWS.replace("FROM documents", f"FROM parquet.`{sf}/documents.parquet`")
    return spark.sql(sql)


_USER = f"CASE WHEN x <> '' THEN {q.strip('concat(a, chr(10), x)')} ELSE a END"
_MEASURED = f"""WITH r AS ({_ROWS}), s AS (SELECT row_num, {q.strip('ask')} AS a, {q.strip('reply')} AS b, {q.strip('extra')} AS x FROM r),
u AS (SELECT row_num, a, b, {_USER} AS u FROM s),
m AS (SELECT row_num, a, b, u, len({q.words('u')}) AS uw, len({q.words('b')}) AS bw, length(concat(u, ' ', b)) AS chars,
 len(regexp_extract_all(concat(u, ' ', b), '[\\x{{0D80}}-\\x{{0DFF}}]')) AS si FROM u)"""


@query(
    "csv_profile",
    f"""{_MEASURED}, g AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = '') AS ea, count(*) FILTER (WHERE b = '') AS eb,
 count(*) FILTER (WHERE uw IN (1, 2)) + count(*) FILTER (WHERE bw IN (1, 2)) AS sw, sum(uw + bw) AS w, round(avg(uw + bw), 1) AS av,
 min(uw + bw) AS mi, max(uw + bw) AS ma, round(sum(si)::DOUBLE / sum(chars) * 100, 1) AS pct FROM m)
SELECT n AS total_rows, n - ea - eb AS passed_rows, ea + eb AS failed_rows, ea AS empty_instructions, eb AS empty_responses, sw AS short_warnings,
 av AS avg_words, CAST(mi AS INTEGER) AS min_words, CAST(ma AS INTEGER) AS max_words, CAST(floor(w * 1.3) AS BIGINT) AS est_tokens,
 pct AS sinhala_pct, round(100.0::DOUBLE - pct, 1) AS english_pct,
 CASE WHEN ea + eb > 0 THEN 'invalid' WHEN sw > 0 THEN 'warnings' ELSE 'valid' END AS status FROM g""",
)
def csv_profile(spark, sf):
    return aggregates.csv_profile(_instruction_rows(spark, sf), "ask", "reply", "extra")


@query(
    "csv_warnings",
    f"""{_MEASURED}, w AS (SELECT 2 AS stage, row_num, 0 AS part, concat('Row ', row_num, ': Instruction has only ', uw, ' words.') AS warning FROM m WHERE uw IN (1, 2)
 UNION ALL SELECT 2, row_num, 1, concat('Row ', row_num, ': Response has only ', bw, ' words.') FROM m WHERE bw IN (1, 2))
SELECT 0 AS stage, row_num AS row, 0 AS part, concat('Row ', row_num, ': Empty instruction (CRITICAL error).') AS warning FROM m WHERE a = ''
UNION ALL SELECT 1, row_num, 0, concat('Row ', row_num, ': Empty response (CRITICAL error).') FROM m WHERE b = ''
UNION ALL (SELECT stage, row_num, part, warning FROM w ORDER BY row_num, part LIMIT 50)
UNION ALL SELECT 3, NULL, 0, concat('... and ', count(*) - 50, ' more length warnings.') FROM w HAVING count(*) > 50""",
)
def csv_warnings(spark, sf):
    return aggregates.csv_warnings(_instruction_rows(spark, sf), "row_num", "ask", "reply", "extra")


_PAIR_WORDS = f"""{cte('pairs')}, w AS (SELECT round(avg(len({q.words('chosen')})), 1) AS c, round(avg(len({q.words('rejected')})), 1) AS r, count(*) AS n FROM pairs)"""


@query(
    "preference_diagnostics",
    f"""{_PAIR_WORDS} SELECT n AS total_pairs, c AS avg_chosen_words, r AS avg_rejected_words, round(c / r, 2) AS length_ratio,
 round(c / r, 2) > 1.5 AS verbosity_warning FROM w""",
)
def preference_diagnostics(spark, sf):
    return aggregates.preference_diagnostics(view(spark, sf, "pairs"))[0]


_ASKED = "concat(CASE pair_id % 7 WHEN 0 THEN 'Beach or temple? ' WHEN 1 THEN 'Ancient waterfall ' WHEN 2 THEN 'WILDLIFE ' WHEN 3 THEN 'hiking ' ELSE '' END, prompt)"
_KIND = "CASE " + " ".join(
    f"WHEN {q.contains_any('p', words)} THEN {q.text(name)}" for name, words in places_.PROMPT_CATEGORIES
) + " ELSE 'General' END"


@query(
    "preference_categories",
    f"""{cte('pairs')}, a AS (SELECT lower({_ASKED}) AS p FROM pairs) SELECT {_KIND} AS category, count(*) AS n FROM a GROUP BY 1""",
)
def preference_categories(spark, sf):
    asked = view(spark, sf, "pairs").withColumn("prompt", F.expr(_ASKED))
    return aggregates.preference_diagnostics(asked)[1]


# --- nutrition and dishes ---------------------------------------------------------------------------------------


def _nutrition_sql(places: int, sure: float, unsure: float) -> str:
    def even(col: str, n: int) -> str:
        return f"round_even({col}, {n})"

    sums = ", ".join(f"{even(f'sum({c})', places)} AS {c}_g" for c in ("protein", "carbs", "fat"))
    return f"""{cte('components', 'foods')}, {_FOOD_MATCH},
r AS (SELECT dish_id, f IS NOT NULL AS matched, coalesce(f.calories, 80) AS calories, coalesce(f.protein, 2.0::DOUBLE) AS protein,
 coalesce(f.carbs, 8.0::DOUBLE) AS carbs, coalesce(f.fat, 4.0::DOUBLE) AS fat FROM components LEFT JOIN m ON item = lower(trim(name)))
SELECT dish_id, CAST({even('sum(calories) / 10.0::DOUBLE', 0)} * 10 AS INTEGER) AS calories, {sums},
 CASE WHEN bool_and(matched) THEN {sure}::DOUBLE ELSE {unsure}::DOUBLE END AS nutrition_confidence, count(*) AS components FROM r GROUP BY dish_id"""


@query("nutrition_totals", _nutrition_sql(1, 0.90, 0.70))
def nutrition_totals(spark, sf):
    return aggregates.nutrition_totals(view(spark, sf, "components"), "dish_id", "name", view(spark, sf, "foods"))


@query("nutrition_totals_older", _nutrition_sql(0, 0.85, 0.65))
def nutrition_totals_older(spark, sf):
    return aggregates.nutrition_totals(
        view(spark, sf, "components"), "dish_id", "name", view(spark, sf, "foods"), "older"
    )


_MACRO = "CASE " + " ".join(
    f"WHEN {q.contains_any('n', words)} THEN {i}" for i, (*_, words) in enumerate(food.MACRO_TAGS) if words
) + f" ELSE {len(food.MACRO_TAGS) - 1} END"
_MACRO_VALUES = values([(i, *m[:4]) for i, m in enumerate(food.MACRO_TAGS)], "k, tag, color, depth_cm, volume_ml")


@query(
    "macro_tag",
    f"""{cte('components')}, t AS ({_MACRO_VALUES}), c AS (SELECT component_id, lower(trim(name)) AS n FROM components)
SELECT component_id, tag, color, depth_cm, volume_ml FROM c JOIN t ON k = {_MACRO}""",
)
def macro_tag(spark, sf):
    return view(spark, sf, "components").select("component_id", dish.macro_tag(F.col("name")).alias("m")).select(
        "component_id", "m.*"
    )


_DISH = "CASE o_orderkey % 6 WHEN 0 THEN 'Jaffna Crab' WHEN 1 THEN 'Cheese Kottu' WHEN 2 THEN 'Egg Hopper' WHEN 3 THEN 'Pol Roti' WHEN 4 THEN 'King Coconut' ELSE 'Fruit salad' END"


def _plates(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.expr(_DISH).alias("dish"), "o_totalprice", "o_custkey")


_SPICE = values([(k, *v) for k, v in [(1, food.SPICE_ALERT[True]), (0, food.SPICE_ALERT[False])]], "k, level, badge, remedy, action")


@query(
    "spice_alert",
    f"""WITH s AS ({_SPICE}), d AS (SELECT o_orderkey, lower({_DISH}) AS n FROM orders)
SELECT o_orderkey, k = 1 AS is_emergency, level, badge, remedy, action FROM d JOIN s ON k = {q.contains_any('n', food.FIERY_WORDS)}::INT""",
)
def spice_alert(spark, sf):
    none = F.array().cast("array<string>")
    return _plates(spark, sf).select("o_orderkey", dish.spice_alert(F.col("dish"), none).alias("s")).select(
        "o_orderkey", "s.*"
    )


_PRICE = "CASE " + " ".join(
    f"WHEN {q.contains_any('n', words)} THEN {i}" for i, (*_, words) in enumerate(food.PRICE_RULES) if words
) + f" ELSE {len(food.PRICE_RULES) - 1} END"
_PRICE_VALUES = values(
    [
        (i, low, high, high + 200, f"Rs. {low} - {high}", f"~ ${round(low / 300, 2)} - ${round(high / 300, 2)} USD")
        for i, (low, high, _) in enumerate(food.PRICE_RULES)
    ],
    "k, lkr_min, lkr_max, max_reasonable_lkr, fair_price_lkr, fair_price_usd",
)


@query(
    "fair_price",
    f"""WITH p AS ({_PRICE_VALUES}), d AS (SELECT o_orderkey, lower({_DISH}) AS n FROM orders)
SELECT o_orderkey, lkr_min, lkr_max, max_reasonable_lkr, fair_price_lkr, fair_price_usd FROM d JOIN p ON k = {_PRICE}""",
)
def fair_price(spark, sf):
    return _plates(spark, sf).select("o_orderkey", dish.fair_price(F.col("dish")).alias("p")).select(
        "o_orderkey", "p.*"
    ).drop("advice")


@query(
    "confidence_state",
    """SELECT o_orderkey, CASE WHEN c >= 0.85 THEN 'high' ELSE 'estimated' END AS live,
 CASE WHEN c >= 0.85 AND n >= 0.80 THEN 'high' ELSE 'estimated' END AS scanned FROM
 (SELECT o_orderkey, (o_orderkey % 100) / 100.0::DOUBLE AS c, (o_custkey % 100) / 100.0::DOUBLE AS n FROM orders)""",
)
def confidence_state(spark, sf):
    c, n = (F.col("o_orderkey") % 100) / F.lit(100.0), (F.col("o_custkey") % 100) / F.lit(100.0)
    return _plates(spark, sf).select(
        "o_orderkey", dish.confidence_state(c).alias("live"), dish.confidence_state(c, n).alias("scanned")
    )


_VOICE = values([(k, *v) for k, v in food.VOICE.items()], "code, greeting, summary, locale")
_LANG = "CASE o_custkey % 6 WHEN 0 THEN 'FR' WHEN 1 THEN 'de' WHEN 2 THEN 'ru' WHEN 3 THEN 'zh' WHEN 4 THEN 'en' ELSE 'xx' END"


@query(
    "guide_text",
    f"""WITH v AS ({_VOICE}), d AS (SELECT o_orderkey, {_DISH} AS dish, {_LANG} AS lang FROM orders)
SELECT o_orderkey, upper(lang) AS language, greeting, concat(greeting, ' ', replace(summary, '{{dish}}', dish)) AS speech_text, locale AS tts_locale
FROM d JOIN v ON code = CASE WHEN lower(lang) IN (SELECT code FROM v) THEN lower(lang) ELSE 'en' END""",
)
def guide_text(spark, sf):
    rows = _plates(spark, sf).withColumn("lang", F.expr(_LANG))
    return rows.select("o_orderkey", dish.guide_text(F.col("dish"), F.col("lang")).alias("g")).select("o_orderkey", "g.*")


_MODE = "CASE o_custkey % 4 WHEN 0 THEN 'spice_sensitive' WHEN 1 THEN 'health_tourist' WHEN 2 THEN 'fitness' ELSE 'normal' END"


@query(
    "advice",
    f"""WITH d AS (SELECT o_orderkey, {_DISH} AS dish, {_MODE} AS mode FROM orders) SELECT o_orderkey, CASE mode
 WHEN 'spice_sensitive' THEN concat(dish, chr(10), '⚠️ Note for you: Please request ''Less Spicy / No Chili'' from the chef if needed!')
 WHEN 'health_tourist' THEN concat(dish, chr(10), '🥗 Nutrition Info: Provides ~', o_orderkey % 900, ' kcal with ', '12.5', 'g clean protein.')
 ELSE dish END AS advice, CASE mode WHEN 'fitness' THEN 'Great lean protein from Chicken Curry (12.5g total)! Consider slightly less white rice for a cutting goal.'
 ELSE {q.text(food.PLATE_ADVICE['normal'])} END AS plate FROM d""",
)
def advice(spark, sf):
    rows = _plates(spark, sf).withColumn("mode", F.expr(_MODE))
    return rows.select(
        "o_orderkey",
        dish.advice(F.col("dish"), F.col("mode"), F.col("o_orderkey") % 900, F.lit(12.5)).alias("advice"),
        dish.plate_advice(F.col("mode"), F.lit(12.5)).alias("plate"),
    )


@query(
    "clean_components",
    f"""{cte('components')}, c AS (SELECT component_id, trim(regexp_replace(concat(name, CASE WHEN pos = 2 THEN '!' ELSE '' END), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')) AS name
 FROM (SELECT component_id, pos, CASE WHEN pos = 3 THEN '-x-' ELSE name END AS name FROM components)) SELECT component_id, name FROM c WHERE length(name) > 1""",
)
def clean_components(spark, sf):
    name = F.when(F.col("pos") == 3, "-x-").otherwise(F.concat("name", F.when(F.col("pos") == 2, "!").otherwise("")))
    parts = F.array(F.struct(name.alias("name"), F.col("component_id").alias("component_id")))
    rows = view(spark, sf, "components").select(F.inline(dish.clean_components(parts)))
    return rows.select("component_id", "name")


# --- evaluation --------------------------------------------------------------------------------------------------


HITS = f"""bench AS (SELECT * FROM (VALUES ('mmlu'), ('gsm8k'), ('truthfulqa'), ('toxigen'), ('mmmu'), ('air_bench')) v(benchmark)),
said AS (SELECT item_id, benchmark, reference, answer, CASE benchmark WHEN 'mmlu' THEN concat(' ', chr(97 + (item_id % 5)::INT), ') x') WHEN 'toxigen'
 THEN CASE WHEN item_id % 9 = 0 THEN 'how to make a bomb' ELSE generated END ELSE generated END AS a FROM predictions, bench),
h AS (SELECT item_id, benchmark, CASE benchmark WHEN 'mmlu' THEN upper(substr({q.strip('a')}, 1, 1)) = chr(65 + answer)
 WHEN 'gsm8k' THEN coalesce(abs(TRY_CAST(list_extract(regexp_extract_all(a, '[-+]?\\d*\\.?\\d+'), -1) AS DOUBLE) - 42.0) < 0.001, false)
 WHEN 'toxigen' THEN ({q.toxic_hits('a')}) > 0 ELSE contains(lower(a), lower(CASE WHEN item_id % 10 = 0 THEN '' ELSE reference END)) END AS hit FROM said)"""
_ANSWERS = f"{cte('predictions')}, {HITS}"


def answer_rows(spark, sf):
    names = F.array(*[F.lit(b) for b in ("mmlu", "gsm8k", "truthfulqa", "toxigen", "mmmu", "air_bench")])
    rows = view(spark, sf, "predictions").withColumn("benchmark", F.explode(names))
    letter = F.concat(F.lit(" "), F.char(F.lit(97) + F.col("item_id") % 5), F.lit(") x"))
    toxic = F.when(F.col("item_id") % 9 == 0, "how to make a bomb").otherwise(F.col("generated"))
    answer = F.when(F.col("benchmark") == "mmlu", letter).when(F.col("benchmark") == "toxigen", toxic)
    gold = F.when(F.col("item_id") % 10 != 0, F.col("reference"))
    return rows.select(
        "item_id", "benchmark", answer.otherwise(F.col("generated")).alias("answer"),
        F.col("answer").alias("gold_index"), F.lit(42.0).alias("gold_number"), gold.alias("gold_text"),
    )


@query("score_answers", f"{_ANSWERS} SELECT item_id, benchmark, hit::INTEGER AS hit FROM h")
def score_answers(spark, sf):
    return aggregates.score_answers(answer_rows(spark, sf)).select("item_id", "benchmark", "hit")


_TARGETS = values(food.BENCHMARK_TARGETS, "name, target")
_REPORT = f"""{_ANSWERS}, t AS ({_TARGETS}), r AS (SELECT benchmark AS name, avg(hit::INTEGER) AS score, count(*) AS n FROM h GROUP BY 1),
p AS (SELECT r.name, score, target, CASE WHEN r.name = 'toxigen' THEN score <= target ELSE score >= target END AS passed, n FROM r JOIN t ON t.name = r.name)"""


@query("benchmark_report", f"{_REPORT} SELECT name, round(score, 6) AS score, target, passed, n FROM p")
def benchmark_report(spark, sf):
    report = aggregates.benchmark_report(aggregates.score_answers(answer_rows(spark, sf)))
    return report.withColumn("score", F.round("score", 6))


@query("safety_gate", f"{_REPORT} SELECT bool_or(NOT passed) AS triggered FROM p WHERE name IN ('truthfulqa', 'toxigen')")
def safety_gate(spark, sf):
    return aggregates.safety_gate(aggregates.benchmark_report(aggregates.score_answers(answer_rows(spark, sf))))


@query(
    "cosine",
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine(spark, sf):
    a = table(spark, sf, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(scores.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query(
    "reference_answer",
    """SELECT item_id, CASE WHEN item_id % 3 = 0 THEN text WHEN item_id % 3 = 1 THEN CASE item_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE CAST(item_id % 5 AS VARCHAR) END
 ELSE CAST(item_id % 5 AS VARCHAR) END AS reference FROM benchmark""",
)
def reference_answer(spark, sf):
    item = F.col("item_id")
    choices = F.when(item % 3 == 1, F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    best = F.when(item % 3 == 0, F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", scores.reference_answer(best, choices, item % 5).alias("reference"))


# --- logs -----------------------------------------------------------------------------------------------------------


@query(
    "audit_summary",
    f"""{cte('audit')} SELECT endpoint, count(*) AS total, count(*) FILTER (WHERE NOT passed) AS blocked, count(*) FILTER (WHERE passed) AS passed
FROM audit GROUP BY endpoint""",
)
def audit_summary(spark, sf):
    return audit.audit_summary(view(spark, sf, "audit"), by=["endpoint"])


_RUNS = "SELECT event_id, value AS speedup, value * 10 AS acceptance_rate, event_id % 5 AS a, event_id % 7 AS b FROM events"


@query(
    "decoding_diagnostics",
    f"""WITH r AS (SELECT * FROM ({_RUNS}) ORDER BY event_id DESC LIMIT 20)
SELECT count(*) AS total_runs, round(avg(speedup), 2) AS avg_speedup, round(avg(acceptance_rate), 1) AS avg_acceptance_rate,
 concat_ws(',', sum(a), sum(b), 20, 0, 0, 0, sum(a + b)) AS histogram FROM r""",
)
def decoding_diagnostics(spark, sf):
    e = table(spark, sf, "events")
    a, b = F.col("event_id") % 5, F.col("event_id") % 7
    zero = F.lit(0).cast("long")
    runs = e.select(
        "event_id", F.col("value").alias("speedup"), (F.col("value") * 10).alias("acceptance_rate"),
        F.array(a, b, F.lit(1).cast("long"), zero, zero, zero, a + b).alias("histogram"),
    )
    out = aggregates.decoding_diagnostics(runs, ["event_id"])
    return out.withColumn("histogram", F.array_join("histogram", ","))


@query(
    "training_progress",
    f"""{cte('steps')} SELECT run_id, arg_max(step, step) AS step, arg_max(max_steps, step) AS max_steps, arg_max(loss, step) AS loss,
 arg_max(learning_rate, step) AS learning_rate, arg_max(epoch, step) AS epoch,
 CAST(least(100, floor(arg_max(step, step)::DOUBLE / arg_max(max_steps, step) * 100 + 0.5)) AS INTEGER) AS percent FROM steps GROUP BY run_id""",
)
def training_progress(spark, sf):
    return aggregates.training_progress(view(spark, sf, "steps"), "run_id")


@query(
    "validation_perplexity",
    f"{cte('steps')} SELECT run_id, round(avg(loss) * 3, 4) AS val_loss, round(exp(avg(loss)), 4) AS perplexity FROM steps GROUP BY run_id",
)
def validation_perplexity(spark, sf):
    out = aggregates.validation_perplexity(view(spark, sf, "steps"), by=["run_id"])
    return out.select("run_id", F.round(F.col("val_loss") * 3, 4).alias("val_loss"), F.round("perplexity", 4).alias("perplexity"))


@query("audit_page", f"{cte('audit')} SELECT event_id, message FROM audit ORDER BY event_id DESC LIMIT 20 OFFSET 40")
def audit_page(spark, sf):
    return audit.audit_page(view(spark, sf, "audit"), "event_id", page=3).select("event_id", "message")


@query("log_tail", f"{cte('audit')} SELECT event_id, message FROM audit ORDER BY event_id DESC LIMIT 400")
def log_tail(spark, sf):
    return audit.log_tail(view(spark, sf, "audit"), "event_id").select("event_id", "message")


@query(
    "keep_last_n",
    """SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 10""",
)
def keep_last_n(spark, sf):
    return audit.keep_last_n(table(spark, sf, "events").select("user_id", "event_id"), 10, ["event_id"], ["user_id"])


_MESSAGE = "concat(timestamp, ' ', client_ip, ' ', endpoint, ' ', threat_level, ' ', message, ' ', {prev})"
_CHAIN = f"""{cte('audit', recursive=True)}, seq AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY event_id) AS i FROM audit),
chain AS (SELECT stream, i, event_id, {q.hmac(_MESSAGE.format(prev=q.text(rules.ROOT_SIGNATURE)), KEY)} AS signature FROM seq WHERE i = 1
 UNION ALL SELECT seq.stream, seq.i, seq.event_id, {q.hmac(_MESSAGE.format(prev='chain.signature'), KEY)} FROM chain JOIN seq ON seq.stream = chain.stream AND seq.i = chain.i + 1)"""


@query("write_audit_chain", f"{_CHAIN} SELECT stream, event_id, signature FROM chain")
def write_audit_chain(spark, sf):
    rows = view(spark, sf, "audit").select("stream", "event_id", *audit.FIELDS)
    return audit.write_audit_chain(rows, "stream", ["event_id"], KEY).select("stream", "event_id", "signature")


def _log_lines(spark, sf):
    """Signed lines with one edited line in every fourth stream and blank lines in between."""
    rows = view(spark, sf, "audit").select("stream", "event_id", *audit.FIELDS)
    signed = audit.write_audit_chain(rows, "stream", ["event_id"], KEY)
    edited = (F.col("stream") % 4 == 0) & (F.col("event_id") % 97 == 5)
    text = F.when(edited, F.concat(audit.audit_line(), F.lit("0"))).otherwise(audit.audit_line())
    lines = signed.select("stream", (F.col("event_id") * 2).alias("line"), text.alias("text"))
    blank = signed.where("event_id % 50 = 0").select("stream", (F.col("event_id") * 2 + 1).alias("line"), F.lit("  ").alias("text"))
    return lines.unionByName(blank)


@query(
    "verify_audit_chain",
    f"""{cte('audit')}, b AS (SELECT stream, min(CASE WHEN stream % 4 = 0 AND event_id % 97 = 5 THEN event_id * 2 END) AS bad FROM audit GROUP BY stream)
SELECT b.stream, bad IS NULL AS is_intact, count(*) FILTER (WHERE bad IS NULL OR event_id * 2 < bad) AS valid_rows, coalesce(any_value(bad), -1) AS tampered_line
FROM audit JOIN b ON b.stream = audit.stream GROUP BY b.stream, bad""",
)
def verify_audit_chain(spark, sf):
    return audit.verify_audit_chain(_log_lines(spark, sf), KEY)


# --- requests --------------------------------------------------------------------------------------------------------


_SCORED = f"""{cte('prompts')}, s AS (SELECT prompt_id, session_id, t_ms, text, {q.intent_score('text')} AS score FROM prompts),
g AS (SELECT *, {q.intent_status('text', 'score')} AS status, CASE WHEN t_ms - lag(t_ms) OVER w > 1800000 THEN 1 ELSE 0 END AS cut FROM s WINDOW w AS (PARTITION BY session_id ORDER BY t_ms, prompt_id)),
k AS (SELECT *, sum(cut) OVER (PARTITION BY session_id ORDER BY t_ms, prompt_id) AS seg FROM g),
v AS (SELECT *, sum(score) OVER w AS total, count(*) FILTER (WHERE score > 0) OVER w AS hits, max(status = 'HARMFUL_CONTENT') OVER w AS harm FROM k
 WINDOW w AS (PARTITION BY session_id, seg ORDER BY t_ms, prompt_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
mt AS (SELECT *, CASE WHEN hits >= 3 OR total >= 50 THEN 'INJECTION_ATTEMPT' WHEN hits >= 2 OR total >= 30 THEN 'SUSPICIOUS' WHEN harm THEN 'HARMFUL_CONTENT' ELSE 'SAFE' END AS multi_turn FROM v)"""


@query(
    "multi_turn_escalation",
    f"""{_SCORED} SELECT prompt_id, score, status, multi_turn,
 CASE WHEN {q.severity('multi_turn')} > {q.severity('status')} THEN multi_turn ELSE status END AS final_status FROM mt""",
)
def multi_turn_escalation(spark, sf):
    from cinderleaf.functions.guard import final_intent

    scored = sequence.with_intent(view(spark, sf, "prompts"), "text")
    out = sequence.multi_turn_escalation(scored, "session_id", "t_ms", "prompt_id")
    final = final_intent(F.col("status"), F.col("multi_turn"))
    return out.select("prompt_id", "score", "status", "multi_turn", final.alias("final_status"))


_SEQ = "seq AS (SELECT event_id, client_ip AS k, t_ms AS t, row_number() OVER (PARTITION BY client_ip ORDER BY t_ms, event_id) AS i FROM requests)"
_RATE = f"""{cte('requests', recursive=True)}, {_SEQ},
scan AS (SELECT k, 0::BIGINT AS i, NULL::BIGINT AS event_id, -1000000::BIGINT AS until, []::BIGINT[] AS times, '' AS verdict FROM (SELECT DISTINCT k FROM seq)
 UNION ALL SELECT k, i, event_id, CASE WHEN v = 'burst' THEN t + 300000 ELSE until END, CASE WHEN v = 'blocked' THEN times ELSE recorded END, v FROM
 (SELECT *, CASE WHEN t < until THEN 'blocked' WHEN len(list_filter(recorded, lambda x: t - x < 5000)) >= 20 THEN 'burst'
   WHEN len(recorded) > 10 THEN 'limited' ELSE 'ok' END AS v FROM
  (SELECT seq.k, seq.i, seq.event_id, seq.t, scan.until, scan.times, list_append(list_filter(scan.times, lambda x: seq.t - x < 60000), seq.t) AS recorded
   FROM scan JOIN seq ON seq.k = scan.k AND seq.i = scan.i + 1)))"""


@query("rate_limit", f"{_RATE} SELECT event_id, verdict FROM scan WHERE i > 0")
def rate_limit(spark, sf):
    return folds.rate_limit(view(spark, sf, "requests"), "client_ip", "t_ms", "event_id").select("event_id", "verdict")


@query(
    "rate_limit_admitted",
    f"""{cte('requests', recursive=True)}, {_SEQ},
scan AS (SELECT k, 0::BIGINT AS i, NULL::BIGINT AS event_id, []::BIGINT[] AS times, false AS allowed FROM (SELECT DISTINCT k FROM seq)
 UNION ALL SELECT k, i, event_id, CASE WHEN len(live) < 30 THEN list_append(live, t) ELSE live END, len(live) < 30 FROM
 (SELECT seq.k, seq.i, seq.event_id, seq.t, list_filter(scan.times, lambda x: seq.t - x < 60000) AS live FROM scan JOIN seq ON seq.k = scan.k AND seq.i = scan.i + 1))
SELECT event_id, allowed FROM scan WHERE i > 0""",
)
def rate_limit_admitted(spark, sf):
    out = folds.rate_limit_admitted(view(spark, sf, "requests"), "client_ip", "t_ms", "event_id")
    return out.select("event_id", "allowed")


_FRAME = "concat('frame-', CAST((event_id // 3) % 40 AS VARCHAR))"


@query(
    "throttle_frames",
    f"""{cte('requests', recursive=True)}, seq AS (SELECT event_id, client_ip AS k, t_ms * 20 AS t, {_FRAME} AS sig, row_number() OVER (PARTITION BY client_ip ORDER BY t_ms, event_id) AS i FROM requests),
scan AS (SELECT k, 0::BIGINT AS i, NULL::BIGINT AS event_id, -100000::BIGINT AS last, '' AS sig, false AS accepted FROM (SELECT DISTINCT k FROM seq)
 UNION ALL SELECT k, i, event_id, CASE WHEN ok THEN t ELSE last END, CASE WHEN ok THEN s ELSE sig END, ok FROM
 (SELECT seq.k, seq.i, seq.event_id, seq.t, seq.sig AS s, scan.last, scan.sig, seq.t - scan.last >= 1500 AND seq.sig <> scan.sig AS ok FROM scan JOIN seq ON seq.k = scan.k AND seq.i = scan.i + 1))
SELECT event_id, accepted FROM scan WHERE i > 0""",
)
def throttle_frames(spark, sf):
    rows = view(spark, sf, "requests")
    payload = F.concat(F.lit("frame-"), (F.floor(F.col("event_id") / 3) % 40).cast("string"))
    frames = rows.select("event_id", "client_ip", (F.col("t_ms") * 20).alias("t"), payload.alias("payload"))
    return folds.throttle_frames(frames, "client_ip", "t", "event_id", "payload").select("event_id", "accepted")


_SENT = "t_ms - CASE event_id % 50 WHEN 7 THEN 400000 ELSE 1000 END"
_NONCE = "CASE WHEN event_id % 40 = 3 THEN '' ELSE concat('n', CAST(event_id % 37 AS STRING)) END"


@query(
    "replay_detection",
    f"""{cte('requests', recursive=True)}, r AS (SELECT event_id, {_NONCE} AS k, {_SENT} AS sent, t_ms AS t FROM requests),
seq AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, event_id) AS i FROM r WHERE k <> '' AND abs(t - sent) <= 300000),
scan AS (SELECT k, 0::BIGINT AS i, NULL::BIGINT AS event_id, -1000000::BIGINT AS last, '' AS verdict FROM (SELECT DISTINCT k FROM seq)
 UNION ALL SELECT seq.k, seq.i, seq.event_id, CASE WHEN seq.t - scan.last > 300000 THEN seq.t ELSE scan.last END,
  CASE WHEN seq.t - scan.last > 300000 THEN 'ok' ELSE 'replay' END FROM scan JOIN seq ON seq.k = scan.k AND seq.i = scan.i + 1)
SELECT event_id, verdict FROM scan WHERE i > 0 UNION ALL SELECT event_id, CASE WHEN k = '' THEN 'missing' ELSE 'stale' END FROM r
WHERE k = '' OR abs(t - sent) > 300000""",
)
def replay_detection(spark, sf):
    rows = view(spark, sf, "requests").select(
        "event_id", F.expr(_NONCE).alias("nonce"), F.expr(_SENT).alias("sent"), "t_ms"
    )
    return folds.replay_detection(rows, "nonce", "sent", "t_ms", "event_id").select("event_id", "verdict")


_GAPS = f"""{cte('requests')}, g AS (SELECT event_id, session_id, t_ms, t_ms - lag(t_ms) OVER w AS gap FROM requests WINDOW w AS (PARTITION BY session_id ORDER BY t_ms, event_id)),
c AS (SELECT *, sum(CASE WHEN gap > 1800000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY t_ms, event_id) AS seg FROM g)"""


@query("session_validity", f"{_GAPS} SELECT event_id, seg = 0 AS valid FROM c")
def session_validity(spark, sf):
    out = sequence.session_validity(view(spark, sf, "requests"), "session_id", "t_ms", "event_id")
    return out.select("event_id", "valid")


@query(
    "session_segments",
    f"""{_GAPS} SELECT session_id, min(t_ms) AS start, max(t_ms) AS "end", count(*) AS events FROM c GROUP BY session_id, seg""",
)
def session_segments(spark, sf):
    return sequence.session_segments(view(spark, sf, "requests"), "session_id", "t_ms", "event_id")


@query(
    "stale_keys",
    f"""{cte('requests')}, l AS (SELECT session_id, max(t_ms) AS last_seen FROM requests GROUP BY 1)
SELECT session_id, last_seen FROM l WHERE (SELECT max(t_ms) FROM requests) - last_seen > 60000""",
)
def stale_keys(spark, sf):
    rows = view(spark, sf, "requests")
    now = rows.agg(F.max("t_ms")).scalar()
    return sequence.stale_keys(rows, "session_id", "t_ms", now, 60_000)


# --- sampling and batching ------------------------------------------------------------------------------------------------


@query(
    "uniform_sample",
    """WITH f AS (SELECT vec_id AS video, unnest(generate_series(0, vec_id % 90)) AS frame FROM embeddings),
n AS (SELECT video, count(*) AS n, least(16, count(*)) AS k FROM f GROUP BY 1),
s AS (SELECT DISTINCT video, CASE WHEN j = 0 THEN 0 WHEN j = k - 1 THEN n - 1 ELSE CAST(floor(j * ((n - 1)::DOUBLE / (k - 1))) AS BIGINT) END AS frame
 FROM (SELECT video, n, k, unnest(generate_series(0, k - 1)) AS j FROM n))
SELECT video, frame * 7 + 2 AS frame FROM s""",
)
def uniform_sample(spark, sf):
    clips = table(spark, sf, "embeddings").select(F.col("vec_id").alias("video"))
    frames = clips.select("video", F.explode(F.sequence(F.lit(0).cast("long"), F.col("video") % 90)).alias("frame"))
    frames = frames.withColumn("frame", F.col("frame") * 7 + 2)  # numbers with gaps
    return sequence.uniform_sample(frames, "video", "frame", 16)


@query(
    "pad_batches",
    f"""WITH t AS (SELECT conv_id, turn, list_transform(string_split({q.squeeze('text')}, ''), lambda c: unicode(c) % 256 + 17) AS ids FROM conversations),
b AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY conv_id, turn) - 1) / 8) AS BIGINT) AS batch FROM t),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) - len(ids) AS pad FROM b)
SELECT conv_id, turn, batch, array_to_string(list_concat(ids, list_transform(generate_series(1, pad), lambda x: 0)), ',') AS input_ids,
 array_to_string(list_concat(ids, list_transform(generate_series(1, pad), lambda x: -100)), ',') AS labels FROM m""",
)
def pad_batches(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", tokens.encode_bytes(F.col("text")).alias("ids"))
    out = sequence.pad_batches(rows, ["conv_id", "turn"], "ids", 8)
    return out.select(
        "conv_id", "turn", "batch", F.array_join("input_ids", ",").alias("input_ids"), F.array_join("labels", ",").alias("labels")
    )


def _samples(spark, sf):
    clips = table(spark, sf, "documents").select(F.col("doc_id").alias("clip"), F.split("text", "").alias("c"))
    return clips.select("clip", F.posexplode("c").alias("i", "ch")).select(
        "clip", "i", ((F.ascii("ch") % 256 - 128) / F.lit(128.0)).alias("value")
    )


_SAMPLES = """WITH t AS (SELECT doc_id AS clip, string_split(text, '') AS c FROM documents),
s AS (SELECT clip, generate_subscripts(c, 1) - 1 AS i, abs((unicode(unnest(c)) % 256 - 128) / 128.0::DOUBLE) AS v FROM t),
n AS (SELECT clip, greatest(1, count(*) // 40) AS step FROM s GROUP BY clip),
j AS (SELECT s.clip, i, v, step, i // step AS pos FROM s JOIN n ON n.clip = s.clip WHERE i // step < 40),
grid AS (SELECT clip, unnest(generate_series(0, 39)) AS pos FROM n)"""


@query(
    "amplitude_points",
    f"""{_SAMPLES}, k AS (SELECT clip, pos, v FROM j WHERE i % step = 0)
SELECT grid.clip, CAST(grid.pos AS INTEGER) AS pos, coalesce(round(v, 3), 0.0::DOUBLE) AS amplitude FROM grid LEFT JOIN k ON k.clip = grid.clip AND k.pos = grid.pos""",
)
def amplitude_points(spark, sf):
    return sequence.amplitude_points(_samples(spark, sf), "clip", "i", "value")


@query(
    "amplitude_means",
    f"""{_SAMPLES}, k AS (SELECT clip, pos, avg(v) AS v FROM j GROUP BY clip, pos)
SELECT grid.clip, CAST(grid.pos AS INTEGER) AS pos, coalesce(round(least(1.0::DOUBLE, greatest(0.01::DOUBLE, v * 6.0)), 3), 0.01::DOUBLE) AS amplitude
FROM grid LEFT JOIN k ON k.clip = grid.clip AND k.pos = grid.pos""",
)
def amplitude_means(spark, sf):
    return sequence.amplitude_points(_samples(spark, sf), "clip", "i", "value", mode="mean")


@query(
    "blend",
    f"""WITH n AS (SELECT unnest(generate_series(0, (SELECT count(*) FROM documents) - 1)) AS pos), u AS (SELECT pos, {q.fraction("'7'", "CAST(pos AS VARCHAR)")} AS u FROM n)
SELECT pos, CASE WHEN u < 0.5::DOUBLE THEN 'web' WHEN u < 0.5::DOUBLE + 0.3::DOUBLE THEN 'books' ELSE 'audio' END AS source,
 CASE WHEN u < 0.5::DOUBLE + 0.3::DOUBLE THEN 'text' ELSE 'audio' END AS modality FROM u""",
)
def blend(spark, sf):
    n = table(spark, sf, "documents").count()
    configs = [("web", "/web", 5.0, "text"), ("books", "/books", 3.0, "text"), ("audio", "/audio", 2.0, "audio")]
    return sampling.blend(spark, configs, n, seed=7).select("pos", "source", "modality")


_SOURCE = "CASE lang WHEN 'en' THEN 'web' WHEN 'fr' THEN 'books' ELSE 'audio' END"


@query(
    "blend_rows",
    f"""WITH n AS (SELECT unnest(generate_series(0, (SELECT 2 * count(*) FROM documents) - 1)) AS pos), u AS (SELECT pos, {q.fraction("'7'", "CAST(pos AS VARCHAR)")} AS u FROM n),
c AS (SELECT pos, CASE WHEN u < 0.5::DOUBLE THEN 'web' WHEN u < 0.5::DOUBLE + 0.3::DOUBLE THEN 'books' ELSE 'audio' END AS source FROM u),
d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) - 1 AS k FROM c),
s AS (SELECT {_SOURCE} AS source, doc_id, row_number() OVER (PARTITION BY {_SOURCE} ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY {_SOURCE}) AS size FROM documents)
SELECT d.pos, d.source, s.doc_id FROM d JOIN s ON d.source = s.source AND d.k % s.size = s.r""",
)
def blend_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.expr(_SOURCE).alias("kind"))
    configs = [("web", "/web", 5.0, "text"), ("books", "/books", 3.0, "text"), ("audio", "/audio", 2.0, "audio")]
    sources = {name: docs.where(F.col("kind") == name).select("doc_id") for name, *_ in configs}
    drawn = sampling.blend_rows(spark, configs, sources, "doc_id", 2 * docs.count(), seed=7)
    return drawn.select("pos", "source", "doc_id")


@query(
    "shuffle",
    f"""WITH u AS (SELECT doc_id, {q.fraction("'42'", "CAST(doc_id AS VARCHAR)")} AS u FROM documents) SELECT doc_id FROM u ORDER BY u, doc_id""",
)
def shuffle(spark, sf):
    return sampling.shuffle(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query(
    "shuffled_preview",
    f"""WITH u AS (SELECT doc_id, {q.fraction("'42'", "CAST(doc_id AS VARCHAR)")} AS u FROM documents) SELECT doc_id FROM u ORDER BY u, doc_id LIMIT 25""",
)
def shuffled_preview(spark, sf):
    return shuffle(spark, sf).limit(25)


@query("preview", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 5")
def preview(spark, sf):
    return sampling.preview(table(spark, sf, "documents").select("doc_id", "lang"), 5, ["doc_id"])


@query(
    "union_training_sets",
    f"""{cte('pairs')} SELECT 'en' AS lang, prompt, chosen, rejected FROM pairs UNION ALL SELECT 'si', prompt, chosen, NULL FROM pairs""",
)
def union_training_sets(spark, sf):
    rows = view(spark, sf, "pairs").select("prompt", "chosen", "rejected")
    return sampling.union_training_sets({"en": rows, "si": rows.drop("rejected")}).select("lang", "prompt", "chosen", "rejected")


@query(
    "ingest_text",
    f"SELECT doc_id, {q.strip('text')} AS text FROM documents WHERE {q.strip('text')} <> '' ORDER BY doc_id LIMIT 500",
)
def ingest_text(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text")
    return sampling.ingest_text(rows, 500, ["doc_id"])


@query(
    "resume",
    f"""{cte('places')} SELECT ord, name FROM places WHERE name NOT IN (SELECT name FROM places WHERE ord % 2 = 0 AND ord % 5 <> 0 AND
 length({q.strip("lower(coalesce(description, ''))")}) > 10)""",
)
def resume(spark, sf):
    rows = view(spark, sf, "places")
    hours = F.when(F.col("ord") % 5 != 0, "24 Hours")
    done = rows.where("ord % 2 = 0").select("name", "description", "id", hours.alias("opening_hours"))
    return sampling.resume(rows.select("ord", "name"), done)


@query("dataset_counts", "SELECT source AS file, count(*) AS n FROM documents GROUP BY source")
def dataset_counts(spark, sf):
    from cinderleaf.sources.readers import dataset_counts as counts

    return counts(table(spark, sf, "documents").withColumnRenamed("source", "file"))


@query(
    "csv_preview",
    f"""WITH r AS ({_ROWS}), s AS (SELECT row_num, {q.strip('ask')} AS a, {q.strip('reply')} AS b, {q.strip('extra')} AS x FROM r)
SELECT row_num, {_USER} AS ask, b AS answer FROM s WHERE a <> '' AND b <> '' ORDER BY row_num LIMIT 3""",
)
def csv_preview(spark, sf):
    rows = aggregates.csv_preview(_instruction_rows(spark, sf), "row_num", "ask", "reply", "extra", "Be brief")
    turns = F.col("messages")
    return rows.select("row_num", turns[1]["content"].alias("ask"), turns[2]["content"].alias("answer"))


@query("loss_series", f"{cte('steps')} SELECT step, coalesce(loss, 0.0::DOUBLE) AS loss FROM steps")
def loss_series(spark, sf):
    return aggregates.loss_series(view(spark, sf, "steps"))


@query(
    "valid_prefix",
    f"""{cte('audit')}, b AS (SELECT stream, min(CASE WHEN stream % 4 = 0 AND event_id % 97 = 5 THEN event_id * 2 END) AS bad FROM audit GROUP BY stream)
SELECT audit.stream, event_id * 2 AS line, message FROM audit JOIN b ON b.stream = audit.stream WHERE bad IS NULL OR event_id * 2 < bad""",
)
def valid_prefix(spark, sf):
    return audit.valid_prefix(_log_lines(spark, sf), KEY).select("stream", "line", "message")
