"""Queries that chain operators, expand records, parse model output and pass through files."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderleaf.fixed import food_rules as food
from cinderleaf.fixed import guard_rules as rules
from cinderleaf.fixed import place_rules
from cinderleaf.fixed import templates
from cinderleaf.functions import guard, parse
from cinderleaf.operators import generators
from cinderleaf.plans import catalog_build, corpus, dishes, evaluation, index, requests, safety
from cinderleaf.queries import sql as q
from cinderleaf.queries.aggregate_queries import _FOOD_MATCH, _MACRO, _MACRO_VALUES, HITS, answer_rows
from cinderleaf.queries.place_queries import _DROPPED, _OSM, _map_nodes, _map_ways
from cinderleaf.queries.registry import query
from cinderleaf.queries.views import cte, table, values, view
from cinderleaf.session import ensure_checkpoint_dir
from cinderleaf.sources import readers, writers


def _scratch(spark: SparkSession) -> str:
    """A fresh folder next to the checkpoints, which every executor can reach."""
    return f"{ensure_checkpoint_dir(spark)}/round-trip-{uuid.uuid4().hex}"


# --- corpus and safety --------------------------------------------------------------------------


@query(
    "prepare_corpus",
    f"""WITH RECURSIVE {_DROPPED} SELECT doc_id, {q.redact_pii('text')} AS text FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM gone) AND ({q.quality('text')}) >= 0.5 AND ({q.toxic_hits('text')}) = 0""",
)
def prepare_corpus(spark, sf):
    return corpus.prepare_corpus(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


_JAIL = q.any_match("x", rules.JAILBREAK_PATTERNS)
_PRE = f"""{cte('prompts')}, c AS (SELECT session_id, string_agg({q.squeeze('text')}, ' ' ORDER BY turn) AS x FROM prompts WHERE {q.squeeze('text')} <> '' GROUP BY 1),
f AS (SELECT session_id, {_JAIL} AS jail, ({q.toxic_hits('x')}) = 0 AND NOT {q.contains_pii('x')} AS clean FROM c)"""


def _sessions(spark, sf):
    rows = view(spark, sf, "prompts")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return rows.groupBy("session_id").agg(turns.alias("messages"))


@query(
    "safety_pre",
    f"""{_PRE} SELECT session_id, NOT jail AND clean AS allowed, CASE WHEN jail THEN 'jailbreak' WHEN NOT clean THEN 'input_toxic' END AS refusal_reason,
 CASE WHEN jail THEN {q.text(rules.REFUSALS['jailbreak'])} WHEN NOT clean THEN {q.text(rules.REFUSALS['harmful'])} ELSE '' END AS response FROM f""",
)
def safety_pre(spark, sf):
    return safety.safety_pre(_sessions(spark, sf), ["session_id"]).drop("events")


@query(
    "safety_pre_events",
    f"""{_PRE} SELECT session_id, 0 AS pos, 'prompt_process' AS event_type, 'L1' AS layer, NOT jail AS passed FROM f
UNION ALL SELECT session_id, 1, 'input_text', 'L2', clean FROM f WHERE NOT jail""",
)
def safety_pre_events(spark, sf):
    return safety.safety_events(safety.safety_pre(_sessions(spark, sf), ["session_id"]), ["session_id"])


_ANSWER = "CASE doc_id % 6 WHEN 0 THEN concat('I cannot help. ', text) WHEN 1 THEN concat(text, ' api_key=abc') ELSE text END"
_POST = f"""WITH r AS (SELECT doc_id, {_ANSWER} AS t FROM documents),
o AS (SELECT doc_id, t, ({q.toxic_hits('t')}) = 0 AND NOT {q.contains_pii('t')} AS clean, lower(t) AS low FROM r),
p AS (SELECT doc_id, t, low, clean AND NOT regexp_matches(t, {q.text(rules.OUTPUT_SECRET)}) AS ok,
 NOT (length({q.strip('low')}) < 2 OR (contains(low, 'i cannot') AND NOT contains(low, 'because') AND NOT contains(low, 'sorry')))
 AND NOT {q.contains_any('low', rules.HARMFUL_PHRASES)} AS aligned FROM o)"""


@query(
    "safety_post",
    f"""{_POST} SELECT doc_id, ok AND aligned AS allowed, CASE WHEN NOT ok THEN {q.text(rules.REFUSALS['harmful'])} WHEN NOT aligned THEN {q.text(rules.REFUSALS['default'])} ELSE t END AS response,
 CASE WHEN NOT ok THEN 'output_blocked' WHEN NOT aligned THEN 'alignment_failed' END AS refusal_reason,
 CASE WHEN ok THEN 2 ELSE 1 END AS layers FROM p""",
)
def safety_post(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.expr(_ANSWER).alias("response"))
    checked = safety.safety_post(rows, ["doc_id"])
    return checked.withColumn("layers", F.size("events")).drop("events")


# --- request guard ---------------------------------------------------------------------------------


_CALLS = """calls AS (SELECT prompt_id, concat('10.0.0.', CAST(session_id % 4 AS STRING)) AS client_ip, session_id, turn * 400 + session_id * 17 AS t_ms, text FROM prompts)"""


def _calls(spark, sf):
    return view(spark, sf, "prompts").select(
        "prompt_id",
        F.concat(F.lit("10.0.0."), (F.col("session_id") % 4).cast("string")).alias("client_ip"),
        "session_id",
        (F.col("turn") * 400 + F.col("session_id") * 17).alias("t_ms"),
        "text",
    )


_GUARD = f"""{cte('prompts', recursive=True)}, {_CALLS},
seq AS MATERIALIZED (SELECT prompt_id, client_ip AS k, t_ms AS t, row_number() OVER (PARTITION BY client_ip ORDER BY t_ms, prompt_id) AS i FROM calls),
scan AS (SELECT k, 0::BIGINT AS i, NULL::BIGINT AS prompt_id, -1000000::BIGINT AS until, []::BIGINT[] AS times, '' AS verdict FROM (SELECT DISTINCT k FROM seq)
 UNION ALL SELECT k, i, prompt_id, CASE WHEN v = 'burst' THEN t + 300000 ELSE until END, CASE WHEN v = 'blocked' THEN times ELSE recorded END, v FROM
 (SELECT *, CASE WHEN t < until THEN 'blocked' WHEN len(list_filter(recorded, lambda x: t - x < 5000)) >= 20 THEN 'burst'
   WHEN len(recorded) > 10 THEN 'limited' ELSE 'ok' END AS v FROM
  (SELECT seq.k, seq.i, seq.prompt_id, seq.t, scan.until, scan.times, list_append(list_filter(scan.times, lambda x: seq.t - x < 60000), seq.t) AS recorded
   FROM scan JOIN seq ON seq.k = scan.k AND seq.i = scan.i + 1))),
j AS (SELECT calls.*, verdict, until, length(text) > 8000 AS too_long, {q.hijack('text')} AS hijack, {q.intent_score('text')} AS score FROM calls JOIN scan ON scan.prompt_id = calls.prompt_id),
s AS (SELECT *, {q.intent_status('text', 'score')} AS status FROM j),
a AS (SELECT * FROM s WHERE verdict = 'ok' AND NOT too_long),
v AS (SELECT prompt_id, sum(score) OVER w AS total, count(*) FILTER (WHERE score > 0) OVER w AS hits, max(status = 'HARMFUL_CONTENT') OVER w AS harm FROM a
 WINDOW w AS (PARTITION BY session_id ORDER BY t_ms, prompt_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
mt AS (SELECT prompt_id, CASE WHEN hits >= 3 OR total >= 50 THEN 'INJECTION_ATTEMPT' WHEN hits >= 2 OR total >= 30 THEN 'SUSPICIOUS' WHEN harm THEN 'HARMFUL_CONTENT' ELSE 'SAFE' END AS multi_turn FROM v),
fin AS (SELECT s.*, CASE WHEN multi_turn IS NOT NULL THEN CASE WHEN {q.severity('multi_turn')} > {q.severity('status')} THEN multi_turn ELSE status END END AS final_status
 FROM s LEFT JOIN mt ON mt.prompt_id = s.prompt_id),
o AS (SELECT *, CASE WHEN verdict <> 'ok' THEN 'rate_limited' WHEN too_long THEN 'too_long' WHEN final_status IN ('INJECTION_ATTEMPT', 'JAILBREAK') THEN 'blocked' ELSE 'allowed' END AS outcome FROM fin)"""


def _guarded(spark, sf):
    return requests.guard_requests(_calls(spark, sf), "prompt_id", "client_ip", "session_id", "t_ms", "text")


@query("guard_requests", f"{_GUARD} SELECT prompt_id, verdict, outcome, final_status FROM o")
def guard_requests(spark, sf):
    return _guarded(spark, sf).select("prompt_id", "verdict", "outcome", "final_status")


@query(
    "guard_audit",
    f"""{_GUARD}, e AS (SELECT prompt_id, 0 AS k, 'HIGH' AS threat_level, concat('Rate Limit Blocked: ', CASE verdict
 WHEN 'blocked' THEN concat('Abuse Detected: IP temporarily blocked. Try again in ', CAST((until - t_ms) // 1000 AS VARCHAR), ' seconds.')
 WHEN 'burst' THEN 'Abuse Detected: Request burst threshold exceeded. IP blocked for 5 minutes.' ELSE 'Too many requests. Limit is 10 requests per minute.' END) AS message FROM o WHERE outcome = 'rate_limited'
 UNION ALL SELECT prompt_id, 1, 'WARNING', 'Block: Prompt exceeds length threshold of 2000 tokens.' FROM o WHERE outcome = 'too_long'
 UNION ALL SELECT prompt_id, 2, 'WARNING', 'Persona hijack attempt detected and neutralized.' FROM o WHERE outcome IN ('blocked', 'allowed') AND hijack
 UNION ALL SELECT prompt_id, 3, 'CRITICAL', concat('Block: Prompt injection attempt. Intent: ', final_status) FROM o WHERE outcome = 'blocked'
 UNION ALL SELECT prompt_id, 4, 'INFO', concat('Inference prompt: ', CASE WHEN hijack THEN 'neutralized' ELSE substr(text, 1, 40) END, '...') FROM o WHERE outcome = 'allowed')
SELECT prompt_id, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY k) - 1 AS INTEGER) AS pos, threat_level, message FROM e""",
)
def guard_audit(spark, sf):
    """Audit rows with their messages; the prompt of a hijack is shown as neutralized."""
    guarded = _guarded(spark, sf)
    shown = F.when(F.col("hijack") & (F.col("outcome") == "allowed"), "neutralized").otherwise(F.col("clean"))
    rows = requests.guard_audit(guarded.withColumn("clean", shown), "prompt_id", "client_ip", "t_ms", "/api/test")
    return rows.select("prompt_id", "pos", "threat_level", "message")


@query("guard_responses")
def guard_responses(spark, sf):
    """What the guard lets through, with a response without personal data for every allowed prompt."""
    said = _guarded(spark, sf).withColumn("response", F.concat(F.lit("You said: "), "text"))
    return requests.scrub_responses(said).select("prompt_id", "outcome", "response")


# --- dishes -----------------------------------------------------------------------------------------


def _scans(spark, sf):
    """One scan per order; components are the order's lines."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    mode = F.when(key % 9 == 0, "please bypass it").when(key % 4 == 0, "health_tourist").otherwise("normal")
    scans = o.select(
        key.alias("scan_id"), (F.col("o_custkey") % 40).alias("client_id"), (key * 700).alias("t_ms"),
        F.concat(F.lit("img"), (F.floor(key / 2) % 50).cast("string")).alias("payload"), mode.alias("mode"),
        F.lit("de").alias("lang"), F.when(key % 3 == 0, "Cheese Kottu").otherwise("Fruit salad").alias("dish_name"),
        ((key % 100) / F.lit(100.0)).alias("confidence"),
    )
    parts = view(spark, sf, "components").select(F.col("dish_id").alias("scan_id"), "pos", "name")
    return scans, parts


@query("scan_dishes")
def scan_dishes(spark, sf):
    scans, parts = _scans(spark, sf)
    out = dishes.scan_dishes(scans, parts, view(spark, sf, "foods"))
    return out.select(
        "scan_id", "outcome", "calories", "protein_g", "nutrition_confidence", "recommendation",
        F.col("spice.level").alias("spice_level"), F.col("price.lkr_min").alias("lkr_min"),
        F.col("voice.tts_locale").alias("tts_locale"), "confidence_state", "badge_color", "label",
    )


_BOXES = values([(i, *b) for i, b in enumerate(food.PLATE_GRID)], "i, x, y, w, h")


@query(
    "component_breakdown",
    f"""{cte('components', 'foods')}, {_FOOD_MATCH}, g AS ({_BOXES}), t AS ({_MACRO_VALUES}),
c AS (SELECT component_id, pos, lower(trim(name)) AS n FROM components)
SELECT component_id, coalesce(f.calories, 80) AS calories, x, y, w, h, tag, color FROM c LEFT JOIN m ON item = n JOIN g ON i = pos % 5 JOIN t ON k = {_MACRO}""",
)
def component_breakdown(spark, sf):
    from cinderleaf.operators.lookup import resolve_foods

    rows = resolve_foods(view(spark, sf, "components"), "name", view(spark, sf, "foods"))
    out = dishes.component_breakdown(rows)
    return out.select("component_id", "calories", "box.*", "styling.tag", "styling.color")


# --- catalog and training pairs ---------------------------------------------------------------------------


@query(
    "build_catalog",
    f"""{_OSM} SELECT concat('pl_', substr(md5(name), 1, 8)) AS id, name, category AS category_id, district AS district_id,
 CASE category WHEN 'Beach' THEN 'High' ELSE 'Medium' END AS tourist_popularity, 'yes' AS family_friendly FROM o
 WHERE NOT (kind = 0 AND id % 10 = 0)""",
)
def build_catalog(spark, sf):
    nodes, ways = _map_nodes(spark, sf), _map_ways(spark, sf)
    done = nodes.where("id % 10 = 0").select(F.col("tag")["name"].alias("name"))
    built = catalog_build.build_catalog(nodes, ways, done)
    return built.select("id", "name", "category_id", "district_id", "tourist_popularity", "family_friendly")


@query(
    "training_pairs",
    f"""{cte('places')}, p AS (SELECT *, {q.strip("coalesce(description, '')")} AS d, lower(category_id) AS c FROM places),
n AS (SELECT 'si' AS lang, sum(8 + CASE WHEN length(d) > 10 THEN 1 ELSE 0 END) AS n FROM p
 UNION ALL SELECT 'en', sum(8 + CASE WHEN length(d) > 10 THEN 1 ELSE 0 END + CASE WHEN contains(c, 'temple') OR contains(c, 'waterfall') THEN 1 ELSE 0 END) FROM p
 UNION ALL SELECT 'col', sum(9 + CASE WHEN length(d) > 10 THEN 1 ELSE 0 END + CASE WHEN contains(c, 'temple') OR contains(c, 'waterfall') OR contains(c, 'beach') THEN 2 WHEN contains(c, 'view') THEN 1 ELSE 0 END) FROM p
 UNION ALL SELECT 'agg', (SELECT 3 * count(*) FROM (SELECT district_id FROM places GROUP BY 1 HAVING count(*) >= 3))
  + (SELECT count(*) FROM (SELECT category_id FROM places GROUP BY 1 HAVING count(*) >= 3))
  + (SELECT 2 * count(*) FROM (SELECT district_id FROM places WHERE ticket_price = 'Free' GROUP BY 1 HAVING count(*) >= 2)))
SELECT lang, CAST(n AS BIGINT) AS n FROM n""",
)
def training_pairs(spark, sf):
    pairs = catalog_build.training_pairs(_plain_places(spark, sf), "ord")
    return pairs.groupBy("lang").agg(F.count("*").alias("n"))


def _plain_places(spark, sf) -> DataFrame:
    """Places whose names carry no river, road or note keyword."""
    return view(spark, sf, "places").withColumn("name", F.concat(F.lit("Spot "), F.col("ord").cast("string")))


def _filled(template: str) -> str:
    """A template whose slots are columns."""
    parts = [f"coalesce(\"{x}\", '')" if i % 2 else q.text(x) for i, x in enumerate(re.split(r"\{(\w+)\}", template)) if x]
    return f"concat({', '.join(parts)})" if parts else "''"


def _either(name: str, condition: str, phrases: tuple[str, str]) -> str:
    yes, no = phrases
    return f'CASE WHEN {condition} THEN {_filled(yes)} ELSE {_filled(no)} END AS "{name}"'


def _picked(values: list[str], at: str) -> str:
    return f"list_extract([{', '.join(map(q.text, values))}], {at})"


# slots of places with plain names: no note, no spans, no history, a paved road
_SLOTS = f"""{cte('places')}, base AS (SELECT ord, concat('Spot ', CAST(ord AS VARCHAR)) AS name, district_id AS district, 'Unknown' AS province, category_id AS category,
 format('{{:.4f}}', lat) AS lat, format('{{:.4f}}', lng) AS lng, coalesce(description, '') AS "desc", 'All year round' AS best_time, 'Sightseeing' AS activities,
 tourist_popularity AS popularity, safety_level AS safety, 'Paved' AS road, 'Safe' AS rain, 'None' AS monsoon, ticket_price AS ticket_str, '' AS note, '' AS spans, '' AS history,
 contains(lower(ticket_price), 'free') AS free, lower(category_id) AS kind, lower(tourist_popularity) AS pop_low,
 CASE tourist_popularity {' '.join(f"WHEN {q.text(k)} THEN {q.text(v)}" for k, v in templates.POPULARITY_SI.items())} ELSE tourist_popularity END AS pop_si FROM places),
cost AS (SELECT *, CASE WHEN free THEN 0 ELSE coalesce(TRY_CAST(regexp_extract(replace(ticket_str, ',', ''), '\\d+') AS INT), 500) END + CASE WHEN popularity = 'High' THEN 1100 ELSE 600 END + 500 AS total FROM base),
phrased AS (SELECT *, {', '.join(_either(n, c, templates.BUDGET_PHRASES[n]) for n, c in (('entry_si', 'free'), ('entry_en', 'free'), ('food_si', "popularity = 'High'"), ('food_en', "popularity = 'High'"), ('transport_si', 'false'), ('transport_en', 'false')))},
 CASE WHEN total < 1500 THEN 1 WHEN total < 5000 THEN 2 ELSE 3 END AS level FROM cost),
slots AS (SELECT *, {_picked(templates.BUDGET_LEVEL_SI, 'level')} AS level_si, {_picked(templates.BUDGET_LEVEL_EN, 'level')} AS level_en,
 {', '.join(_either(n, c, templates.CHOICES[n]) for n, c in (('free_si', 'free'), ('free_en', 'free'), ('rain_col', 'false'), ('family_si', 'true'), ('family_en', 'true'), ('family_col', 'true')))} FROM phrased)"""
_KIND = " ".join(
    f"WHEN {' OR '.join(f'contains(kind, {q.text(w)})' for w in words)} THEN {q.text(name)}" for name, words in templates.CATEGORY_KINDS
)
_ASKED = {
    "": "true", "described": 'length("desc") > 10', "spans": "false", "history": "false", "monsoon": "false", "text": '"desc" <> \'\'',
    **{name: f"CASE {_KIND} END = {q.text(name)}" for name, _ in templates.CATEGORY_KINDS},
}


@query(
    "qa_pairs",
    _SLOTS + " " + " UNION ALL ".join(
        f"SELECT ord, {q.text(lang)} AS lang, {family} AS family, {seq} AS seq, {_filled(ask)} AS instruction, '' AS input, {_filled(answer)} AS output FROM slots WHERE {_ASKED[condition]}"
        for seq, (family, lang, condition, ask, answer) in enumerate(templates.PLACE_QUESTIONS)
    ),
)
def qa_pairs(spark, sf):
    """Every question of every place, in all three languages."""
    return generators.qa_pairs(_plain_places(spark, sf), ["ord"])


@query(
    "disambiguation_pairs",
    _SLOTS + " " + " UNION ALL ".join(
        f"SELECT ord, {seq} AS seq, {_filled(ask)} AS instruction, '' AS input, {_filled(answer)} AS output FROM slots WHERE {_ASKED[condition]}"
        for seq, (condition, ask, answer) in enumerate(templates.DISAMBIGUATION_QUESTIONS)
    ),
)
def disambiguation_pairs(spark, sf):
    return generators.disambiguation_pairs(_plain_places(spark, sf), ["ord"])


_GROUPS = f"""{cte('places')}, p AS (SELECT *, CASE tourist_popularity WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END AS k FROM places),
a AS (SELECT district_id AS g, name, row_number() OVER (PARTITION BY district_id ORDER BY k, ord) AS r, count(*) OVER (PARTITION BY district_id) AS n FROM p),
d AS (SELECT g, string_agg(name, ', ' ORDER BY r) AS names FROM a WHERE r <= 5 AND n >= 3 GROUP BY g),
b AS (SELECT category_id AS g, concat(name, ' (', district_id, ' District)') AS name, row_number() OVER (PARTITION BY category_id ORDER BY k, ord) AS r, count(*) OVER (PARTITION BY category_id) AS n FROM p),
c AS (SELECT g, string_agg(name, ', ' ORDER BY r) AS names FROM b WHERE r <= 5 AND n >= 3 GROUP BY g),
e AS (SELECT district_id AS g, name, row_number() OVER (PARTITION BY district_id ORDER BY ord) AS r, count(*) OVER (PARTITION BY district_id) AS n FROM p WHERE contains(lower(ticket_price), 'free')),
f AS (SELECT g, string_agg(name, ', ' ORDER BY r) AS names FROM e WHERE r <= 5 AND n >= 2 GROUP BY g)"""


def _group_rows(source: str, questions: list[tuple[str, str]]) -> str:
    def filled(template: str) -> str:
        named = q.text(template.replace("{assistant}", "Assistant"))
        return f"replace(replace({named}, '{{group}}', g), '{{names}}', names)"

    return " UNION ALL ".join(
        f"SELECT {i} AS seq, {filled(ask)} AS instruction, '' AS input, {filled(answer)} AS output FROM {source}"
        for i, (ask, answer) in enumerate(questions)
    )


@query(
    "aggregate_pairs",
    f"{_GROUPS} {_group_rows('d', templates.DISTRICT_QUESTIONS)} UNION ALL {_group_rows('c', templates.CATEGORY_QUESTIONS)} "
    f"UNION ALL {_group_rows('f', templates.FREE_QUESTIONS)}",
)
def aggregate_pairs(spark, sf):
    from cinderleaf.operators import catalog

    places = view(spark, sf, "places")
    return generators.aggregate_pairs(
        catalog.district_recommendations(places, "ord"),
        catalog.category_recommendations(places, "ord"),
        catalog.free_places(places, "ord"),
    )


def _messages(spark, sf):
    """Place records as JSON inside the second message; every ninth one is broken."""
    p = view(spark, sf, "places")
    body = F.to_json(F.struct("name", "category_id", "safety_level", "description", F.lit("yes").alias("parking_avail")))
    body = F.when(F.col("ord") % 9 == 0, F.substring(body, 1, 20)).otherwise(body)
    turns = generators.chat(("user", F.lit("describe")), ("assistant", body))
    return p.select("ord", turns.alias("messages"))


_BILINGUAL = f"""{cte('places')}, p AS (SELECT ord, name, category_id, safety_level, CASE WHEN description IS NULL OR contains(lower(description), 'beautiful beaches')
 OR contains(lower(description), 'no description') THEN '' ELSE description END AS d FROM places WHERE ord % 9 <> 0),
t AS (SELECT *, concat(name, ' is a popular ', category_id, ' in Sri Lanka.', CASE WHEN d = '' THEN ' It offers scenic beauty, ideal for relaxing and photography.' ELSE concat(' ', d) END,
 chr(10), '- Safety Level: ', safety_level, chr(10), '- Parking: yes | Toilets: no') AS facts FROM p)"""


def _term(column: str) -> str:
    known = " ".join(f"WHEN {q.text(k)} THEN {q.text(v)}" for k, v in place_rules.SINHALA_TERMS)
    return f"CASE lower({q.strip(column)}) {known} ELSE {column} END"


def _local(column: str) -> str:
    for word, local in templates.SI_WORDS:
        column = f"replace({column}, {q.text(word)}, {q.text(local)})"
    return column


_SAID = f"""{_BILINGUAL}, slots AS (SELECT ord, name, category_id AS category, safety_level AS safety, 'yes' AS parking, 'no' AS toilets, 'good' AS mobile, d AS "desc",
 {_local('d')} AS desc_si, {_term('category_id')} AS category_si, {_term('safety_level')} AS safety_si, {_term("'good'")} AS mobile_si,
 {q.text(templates.SI_PARKING[0])} AS parking_si, {q.text(templates.SI_TOILETS[1])} AS toilets_si FROM p)"""


def _described(mobile: bool) -> tuple[str, str]:
    """English and Sinhala descriptions."""
    signal = (templates.EN_SIGNAL, templates.SI_SIGNAL) if mobile else ("", "")
    plain = templates.SI_PLAIN if mobile else templates.SI_PLAIN_PAIR
    english = f"concat({_filled(templates.EN_INTRO)}, CASE WHEN d <> '' THEN concat(' ', d) ELSE {q.text(templates.EN_PLAIN)} END, {_filled(templates.EN_FACTS + signal[0])})"
    sinhala = f"""concat({_filled(templates.SI_INTRO)}, CASE WHEN d <> '' THEN {_filled(templates.SI_ABOUT)} ELSE {q.text(plain)} END,
 {_filled(templates.SI_SAFETY + templates.SI_FACILITIES + signal[1])})"""
    return tuple(x.replace("d <> ''", "\"desc\" <> ''").replace("concat(' ', d)", "concat(' ', \"desc\")") for x in (english, sinhala))


@query(
    "bilingual_sft",
    f"""{_SAID} SELECT ord, 'en' AS lang, {_filled(templates.EN_ASK)} AS ask, {_described(True)[0]} AS answer FROM slots
UNION ALL SELECT ord, 'si', {_filled(templates.SI_ASK)}, {_described(True)[1]} FROM slots""",
)
def bilingual_sft(spark, sf):
    rows = generators.bilingual_sft(_messages(spark, sf), ["ord"])
    return rows.select("ord", "lang", F.col("messages")[0]["content"].alias("ask"), F.col("messages")[1]["content"].alias("answer"))


@query(
    "preference_pairs",
    f"""{_SAID} SELECT ord, 'en' AS lang, {_filled(templates.PAIR_EN_ASK)} AS prompt, {_described(False)[0]} AS chosen, {_filled(templates.PAIR_EN_REJECTED)} AS rejected FROM slots
UNION ALL SELECT ord, 'si', {_filled(templates.SI_ASK)}, {_described(False)[1]}, {_filled(templates.PAIR_SI_REJECTED)} FROM slots
UNION ALL SELECT NULL, NULL, prompt, chosen, rejected FROM ({values(templates.SEED_PAIRS, 'prompt, chosen, rejected')}) seeds""",
)
def preference_pairs(spark, sf):
    """Pairs of all places in both languages, and the fixed ones."""
    rows = generators.preference_pairs(_messages(spark, sf), ["ord"])
    return generators.with_seed_pairs(rows).select("ord", "lang", "prompt", "chosen", "rejected")


@query(
    "bilingual_sft_sinhala",
    f"{_SAID} SELECT ord, {_described(True)[1]} AS answer FROM slots",
)
def bilingual_sft_sinhala(spark, sf):
    rows = generators.bilingual_sft(_messages(spark, sf), ["ord"]).where("lang = 'si'")
    return rows.select("ord", F.col("messages")[1]["content"].alias("answer"))


def _drawn(n: str, *parts: str) -> str:
    return f"CAST(floor({q.fraction(*parts)} * {n}) AS BIGINT)"


_SYNTHETIC = f"""{cte('places')}, n AS (SELECT count(*) AS n FROM places), i AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS at FROM places),
d AS (SELECT unnest(generate_series(0, n - 1)) AS draw, n FROM n),
e AS (SELECT draw, {_drawn('n', "'42'", "'spot'", 'CAST(draw AS VARCHAR)')} AS at, {_drawn('2', "'42'", "'template'", 'CAST(draw AS VARCHAR)')} AS t FROM d)"""


@query(
    "synthetic_pairs",
    f"""{_SYNTHETIC} SELECT draw, CASE t WHEN 0 THEN concat('Tell me about the travel safety and features of ', name, ' in ', district_id, '.')
 ELSE concat('I want to visit ', name, '. Is it good for camping and is there signal coverage?') END AS prompt,
 CASE t WHEN 0 THEN concat('Here are the details for ', name, ' in ', district_id, ' district: The safety level is classified as ', safety_level,
  '. Wildlife hazard warning: None. Rain sensitivity: Low. Best time to visit: anytime. You can enjoy activities like sightseeing.')
 ELSE concat('Visiting ', name, ' is a great choice. Camping is not allowed. Mobile signal coverage is Moderate. Road condition: Fair. We recommend visiting during anytime for the safest and most enjoyable experience.') END AS chosen,
 CASE t WHEN 0 THEN concat('It is safe to go to ', name, '. It is in ', district_id, '. You can visit anytime. It''s a nice place.')
 ELSE concat(name, ' is okay. You can camp if you want. Signals are sometimes there, sometimes not.') END AS rejected FROM e JOIN i ON i.at = e.at""",
)
def synthetic_pairs(spark, sf):
    places = view(spark, sf, "places")
    return generators.synthetic_pairs(places, "ord", "dpo", places.count())


@query("synthetic_chats")
def synthetic_chats(spark, sf):
    places = view(spark, sf, "places")
    rows = generators.synthetic_pairs(places, "ord", "sft", places.count())
    return rows.select("draw", F.col("messages")[1]["content"].alias("ask"), F.col("messages")[2]["content"].alias("answer"))


@query("portion_samples")
def portion_samples(spark, sf):
    n = table(spark, sf, "orders").count()
    out = generators.portion_samples(view(spark, sf, "foods"), n)
    return out.select("sample", "plate", "dish_name", "total_calories", F.size("components").alias("items"))


@query(
    "csv_to_sft",
    f"""{cte('pairs')} SELECT pair_id, 'Be brief' AS system, CASE WHEN pair_id % 2 = 0 THEN concat({q.strip('prompt')}, chr(10), 'now') ELSE {q.strip('prompt')} END AS ask,
 {q.strip('chosen')} AS answer FROM pairs WHERE pair_id % 5 <> 0 AND {q.strip('prompt')} <> '' AND {q.strip('chosen')} <> ''""",
)
def csv_to_sft(spark, sf):
    rows = view(spark, sf, "pairs").select(
        "pair_id", "prompt", F.when(F.col("pair_id") % 5 == 0, "  ").otherwise(F.col("chosen")).alias("reply"),
        F.when(F.col("pair_id") % 2 == 0, " now ").otherwise("").alias("extra"),
    )
    out = generators.csv_to_sft(rows, "prompt", "reply", "extra", "Be brief", ["pair_id"])
    turn = F.col("messages")
    return out.select(
        "pair_id", turn[0]["content"].alias("system"), turn[1]["content"].alias("ask"), turn[2]["content"].alias("answer")
    )


# --- model output ---------------------------------------------------------------------------------------------


@query(
    "parse_model_json",
    f"""{cte('places')} SELECT ord, CASE WHEN ord % 4 = 3 THEN NULL ELSE concat('Nice ', name) END AS description,
 CASE WHEN ord % 4 = 3 THEN NULL ELSE ticket_price END AS ticket_price, CASE WHEN ord % 4 = 3 THEN NULL ELSE 'yes' END AS toilets FROM places""",
)
def parse_model_json(spark, sf):
    p = view(spark, sf, "places")
    body = F.concat(
        F.lit('{"description": "Nice '), "name", F.lit('", "ticket_price": "'), "ticket_price", F.lit('", "toilets": "yes"')
    )
    text = (
        F.when(F.col("ord") % 4 == 0, F.concat(F.lit("Sure!\n```json\n"), body, F.lit(",}\n```")))
        .when(F.col("ord") % 4 == 1, F.concat(body, F.lit("}")))
        .when(F.col("ord") % 4 == 2, F.concat(body, F.lit(' "latitude": 6.5 }')))
        .otherwise("no json at all")
    )
    out = parse.parse_model_json(p.select("ord", text.alias("text")), "text")
    fields = ["description", "ticket_price", "toilets"]
    return out.select("ord", *[F.try_element_at("fields", F.lit(f)).alias(f) for f in fields])


@query(
    "parse_food_json",
    """SELECT p_partkey, p_name AS food, CAST(CASE WHEN p_partkey % 4 = 2 THEN p_size + 1 ELSE p_size END AS INTEGER) AS calories, 2.5::DOUBLE AS protein,
 CASE WHEN p_partkey % 4 = 0 THEN 15.0::DOUBLE ELSE 7.0::DOUBLE END AS carbs, 3.0::DOUBLE AS fat FROM part WHERE p_size > 0""",
)
def parse_food_json(spark, sf):
    p = table(spark, sf, "part").where("p_size > 0")
    size = F.col("p_size").cast("string")
    text = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit('[{"name": "'), "p_name", F.lit('", "calories": '), size, F.lit(', "protein": 2.5, "carbs": 0}]')))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit('```json\n{"'), "p_name", F.lit('": {"cals": '), size, F.lit(', "proteins": 2.5, "carbohydrates": 7}}\n```')))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit('{"'), "p_name", F.lit('": {"calories": 0, "energy": '), (F.col("p_size") + 1).cast("string"), F.lit(', "protein": 2.5, "total_carbs": 7}, "x": {"protein": 1}}')))
        .otherwise(F.concat(F.lit('oops "'), "p_name", F.lit('": {"calories": '), size, F.lit(', "protein": 2.5, "carbs": 7}, broken {')))
    )
    out = parse.parse_food_json(p.select("p_partkey", text.alias("text")), "text")
    return out.drop("text")


@query(
    "tool_calls",
    """SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS call_pos, event_type AS tool FROM events""",
)
def tool_calls(spark, sf):
    good = F.concat(F.lit('<tool_call>{"name": "'), "event_type", F.lit('", "arguments": {"q": 1}}</tool_call>'))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("<tool_call>{bad</tool_call> then "), good)).otherwise(good)
    rows = table(spark, sf, "events").select("event_id", text.alias("text"))
    return parse.tool_calls(rows, "text").select("event_id", "call_pos", "tool")


# --- evaluation and index ------------------------------------------------------------------------------------------


def _grams(side: str) -> str:
    return " UNION ALL ".join(
        f"SELECT item_id, {n} AS n, array_to_string(w[i:i+{n - 1}], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - {n - 1})) AS i FROM {side})"
        for n in range(1, 5)
    )


_BLEU = f"""{cte('predictions')}, r AS (SELECT item_id, {q.words('lower(reference)')} AS w FROM predictions),
c AS (SELECT item_id, {q.words('lower(generated)')} AS w FROM predictions),
rg AS (SELECT item_id, n, g, count(*) AS k FROM ({_grams('r')}) GROUP BY ALL), cg AS (SELECT item_id, n, g, count(*) AS k FROM ({_grams('c')}) GROUP BY ALL),
p AS (SELECT cg.item_id, cg.n, (sum(least(cg.k, coalesce(rg.k, 0))) + 0.1::DOUBLE) / (sum(cg.k) + 0.1::DOUBLE) AS p FROM cg LEFT JOIN rg ON rg.item_id = cg.item_id AND rg.n = cg.n AND rg.g = cg.g GROUP BY 1, 2),
s AS (SELECT item_id, count(*) AS orders, exp(sum(ln(p)) / 4.0) AS m FROM p GROUP BY 1),
b AS (SELECT r.item_id, CASE WHEN coalesce(s.orders, 0) < 4 THEN 0.0::DOUBLE WHEN len(c.w) > len(r.w) THEN m ELSE exp(1 - len(r.w)::DOUBLE / len(c.w)) * m END AS bleu
 FROM r JOIN c ON c.item_id = r.item_id LEFT JOIN s ON s.item_id = r.item_id)"""


@query("bleu", f"{_BLEU} SELECT item_id, round(bleu, 6) AS bleu FROM b")
def bleu(spark, sf):
    scored = evaluation.score_predictions(view(spark, sf, "predictions"))
    return scored.select("item_id", F.round("bleu", 6).alias("bleu"))


# the row of the longest common subsequence, one word of the reference a round
_OVERLAP = f"""{_BLEU.replace('WITH ', 'WITH RECURSIVE ', 1)},
l AS (SELECT r.item_id, r.w AS x, c.w AS y, 0 AS i, list_transform(range(len(c.w) + 1), lambda j: 0::BIGINT) AS best FROM r JOIN c ON c.item_id = r.item_id
 UNION ALL SELECT item_id, x, y, i + 1, list_transform(range(1, len(y) + 2), lambda j: list_max(step[1:j])) FROM
 (SELECT *, list_transform(range(len(y) + 1), lambda j: CASE WHEN j = 0 THEN 0::BIGINT ELSE greatest(best[j + 1], best[j] + (y[j] = x[i + 1])::BIGINT) END) AS step FROM l WHERE i < len(x))),
rouge AS (SELECT item_id, CASE WHEN best[-1] = 0 THEN 0.0::DOUBLE ELSE 2 * (best[-1] / len(y)) * (best[-1] / len(x)) / (best[-1] / len(y) + best[-1] / len(x)) END AS rouge FROM l WHERE i = len(x))"""


@query("rouge_l", f"{_OVERLAP} SELECT item_id, round(rouge, 6) AS rouge_l FROM rouge")
def rouge_l(spark, sf):
    scored = evaluation.score_predictions(view(spark, sf, "predictions"))
    return scored.select("item_id", F.round("rouge_l", 6).alias("rouge_l"))


def _with_vectors(spark, sf):
    """Predictions with a vector for the reference and one for the answer."""
    vecs = table(spark, sf, "embeddings")
    rows = view(spark, sf, "predictions").withColumn("vec_id", F.col("item_id") % 100)
    rows = rows.join(vecs.select("vec_id", F.col("embedding").alias("v")), "vec_id")
    return rows.join(vecs.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("u")), "vec_id")


_SIMILAR = """sim AS (SELECT item_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity
 FROM predictions JOIN embeddings a ON a.vec_id = item_id % 100 JOIN embeddings b ON b.vec_id = item_id % 100 + 1)"""


@query(
    "evaluate_predictions",
    f"""{_OVERLAP}, {_SIMILAR} SELECT round(avg(bleu), 4) AS avg_bleu, round(avg(rouge), 4) AS avg_rouge, round(avg(similarity), 4) AS avg_similarity, count(*) AS count
FROM b JOIN rouge ON rouge.item_id = b.item_id JOIN sim ON sim.item_id = b.item_id""",
)
def evaluate_predictions(spark, sf):
    return evaluation.evaluate_predictions(_with_vectors(spark, sf), vectors=("v", "u"))


@query(
    "evaluation_history",
    f"""{_OVERLAP}, {_SIMILAR}, {HITS},
g AS (SELECT b.item_id % 13 AS run, avg(bleu) AS bl, avg(rouge) AS ro, avg(similarity) AS si, count(*) AS n FROM b JOIN rouge ON rouge.item_id = b.item_id JOIN sim ON sim.item_id = b.item_id GROUP BY 1),
k AS (SELECT item_id % 13 AS run, benchmark, avg(hit::INTEGER) AS score FROM h GROUP BY 1, 2),
f AS (SELECT run, max(score) FILTER (WHERE benchmark = 'mmlu') AS mmlu, max(score) FILTER (WHERE benchmark = 'toxigen') AS toxigen,
 bool_or(CASE WHEN benchmark = 'toxigen' THEN score > target ELSE score < target END) FILTER (WHERE benchmark IN ('truthfulqa', 'toxigen')) AS triggered
 FROM k JOIN ({values(food.BENCHMARK_TARGETS, 'name, target')}) t ON t.name = k.benchmark GROUP BY 1)
SELECT g.run, round(bl, 4) AS avg_bleu, round(ro, 4) AS avg_rouge, round(si, 4) AS avg_similarity, n AS count, round(mmlu, 4) AS mmlu, round(toxigen, 4) AS toxigen, triggered
FROM g JOIN f ON f.run = g.run WHERE g.run >= 3""",
)
def evaluation_history(spark, sf):
    """Thirteen runs that arrive in two parts; the newest ten stay."""
    run = (F.col("item_id") % 13).alias("run")
    rows, answers = _with_vectors(spark, sf).withColumn("run", run), answer_rows(spark, sf).withColumn("run", run)
    early, late = F.col("item_id") % 2 == 0, F.col("item_id") % 2 == 1
    first = evaluation.run_states(rows.where(early), answers.where(early), "run", vectors=("v", "u"))
    second = evaluation.run_states(rows.where(late), answers.where(late), "run", vectors=("v", "u"))
    report = evaluation.history_report(evaluation.add_states(first, second, "run"), "run")
    shown = [F.col("benchmarks")[n].alias(n) for n in ("mmlu", "toxigen")]
    return report.select("run", "avg_bleu", "avg_rouge", "avg_similarity", "count", *shown, "triggered")


@query(
    "answer_prompts",
    """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
 FROM embeddings a JOIN embeddings b ON b.label <> 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM s)
SELECT query_id, concat('Verified Context:', chr(10), string_agg(concat('row ', CAST(doc_id AS VARCHAR)), chr(10) ORDER BY k), chr(10), chr(10), 'Question: q', CAST(query_id AS VARCHAR)) AS prompt
FROM r WHERE k <= 2 GROUP BY query_id""",
)
def answer_prompts(spark, sf):
    vecs = table(spark, sf, "embeddings")
    rows = vecs.select(F.col("vec_id").alias("id"), F.concat(F.lit("row "), F.col("vec_id").cast("string")).alias("content"))
    vectors = vecs.select(F.col("vec_id").alias("id"), "embedding")
    start = rows.join(vectors, "id").where("id % 2 = 0").withColumn("content", F.lit("old"))
    full = index.index_documents(start, rows, vectors)
    kept = full.join(vecs.where("label = 3").select(F.col("vec_id").alias("id")), "id", "left_anti")
    queries = vecs.select(
        F.col("vec_id").alias("query_id"), F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("question"), "embedding"
    )
    return index.answer_prompts(queries, kept).select("query_id", "prompt")


# --- files ------------------------------------------------------------------------------------------------------------


@query("read_lines", f"SELECT {q.strip('line')} AS text FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE {q.strip('line')} <> ''")
def read_lines(spark, sf):
    path = _scratch(spark)
    table(spark, sf, "documents").select("text").write.text(path)
    return readers.read_lines(spark, path).select("text")


@query("read_jsonl", "SELECT doc_id, coalesce(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END, '') AS text FROM documents")
def read_jsonl(spark, sf):
    path = _scratch(spark)
    text = F.when(F.col("doc_id") % 7 != 0, F.col("text"))
    table(spark, sf, "documents").select("doc_id", text.alias("text")).write.json(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    return readers.read_jsonl(spark, path, schema).select("doc_id", "text")


@query(
    "read_csv_auto",
    f"{cte('places')} SELECT CAST(ord AS VARCHAR) AS ord, name, coalesce(description, '') AS description, ticket_price FROM places",
)
def read_csv_auto(spark, sf):
    path = _scratch(spark)
    rows = view(spark, sf, "places").select("ord", F.concat(F.lit(" "), "name").alias("name"), "description", "ticket_price")
    rows.write.option("header", True).option("sep", ";").csv(path)
    return readers.read_csv_auto(spark, path)


@query("read_records", f"{cte('places')} SELECT id, name, lat FROM places")
def read_records(spark, sf):
    path = _scratch(spark)
    places = view(spark, sf, "places").select("id", "name", "lat", (F.col("ord") % 40).alias("part"))
    listed = places.groupBy("part").agg(F.collect_list(F.struct("id", "name", "lat")).alias("places"))
    bare = listed.where("part % 2 = 0").select(F.to_json("places").alias("value"))
    wrapped = listed.where("part % 2 = 1").select(F.to_json(F.struct("places")).alias("value"))
    bare.unionByName(wrapped).repartition(40, F.col("value")).write.option("maxRecordsPerFile", 1).text(path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "name")] + [T.StructField("lat", T.DoubleType())])
    return readers.read_records(spark, path, schema).select("id", "name", "lat")


@query(
    "union_sources",
    "SELECT 'nation' AS source, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT 'region', r_name, NULL FROM region",
)
def union_sources(spark, sf):
    frames = {
        "nation": table(spark, sf, "nation").selectExpr("n_name AS name", "n_regionkey AS region"),
        "region": table(spark, sf, "region").selectExpr("r_name AS name"),
    }
    return readers.union_sources(frames).select("source", "name", "region")


@query("read_alerts", f"{cte('alerts')} SELECT title, CASE WHEN event_id % 5 = 0 THEN '' ELSE description END AS description FROM alerts")
def read_alerts(spark, sf):
    path = _scratch(spark)
    body = F.when(F.col("event_id") % 5 != 0, F.col("description"))
    rows = view(spark, sf, "alerts").select("title", body.alias("description"))
    rows.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    return readers.read_alerts(spark, path)


@query(
    "write_jsonl",
    f"{cte('pairs')} SELECT prompt AS instruction, chosen AS output, 'user' AS first_role, chosen AS reply FROM pairs",
)
def write_jsonl(spark, sf):
    path = _scratch(spark)
    pairs = view(spark, sf, "pairs").select(F.col("prompt").alias("instruction"), F.lit("").alias("input"), F.col("chosen").alias("output"))
    writers.write_jsonl(pairs, path)
    turns = "array<struct<role:string,content:string>>"
    back = spark.read.schema(f"instruction string, input string, output string, messages {turns}").json(path)
    return back.select(
        "instruction", "output", F.col("messages")[0]["role"].alias("first_role"), F.col("messages")[1]["content"].alias("reply")
    )


@query(
    "write_catalog_csv",
    f"{cte('places')} SELECT id, name, category_id, CAST(lat AS VARCHAR) AS lat, '' AS toilets, 30 AS columns FROM places",
)
def write_catalog_csv(spark, sf):
    path = _scratch(spark)
    writers.write_catalog_csv(view(spark, sf, "places"), path)
    back = readers.read_csv_auto(spark, path)
    return back.select("id", "name", "category_id", "lat", "toilets", F.lit(len(back.columns)).alias("columns"))


@query("append_records", f"{cte('pairs')} SELECT prompt, chosen, rejected FROM pairs UNION ALL SELECT prompt, chosen, rejected FROM pairs")
def append_records(spark, sf):
    path = _scratch(spark)
    pairs = view(spark, sf, "pairs").select("prompt", "chosen", "rejected")
    writers.append_records(pairs, path)
    writers.append_records(pairs, path)
    return spark.read.schema(pairs.schema).json(path)


@query("final_intent", f"{cte('prompts')} SELECT prompt_id, CASE WHEN turn % 2 = 0 THEN 'HARMFUL_CONTENT' ELSE 'JAILBREAK' END AS final FROM prompts")
def final_intent(spark, sf):
    single = F.when(F.col("turn") % 2 == 0, "HARMFUL_CONTENT").otherwise("SUSPICIOUS")
    return view(spark, sf, "prompts").select("prompt_id", guard.final_intent(single, F.lit("JAILBREAK")).alias("final"))
