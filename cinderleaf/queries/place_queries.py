"""Queries over places, lookups, routes and catalog changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderleaf.fixed import food_rules as food
from cinderleaf.fixed import place_rules as rules
from cinderleaf.fixed import templates as text
from cinderleaf.functions import place
from cinderleaf.operators import catalog, lookup, retrieval, routes
from cinderleaf.operators.dedup import dedup_normalised_names, exact_dedup, merge_records, near_dedup
from cinderleaf.queries import sql as q
from cinderleaf.queries.registry import query
from cinderleaf.queries.views import cte, table, values, view
from cinderleaf.sources import manifest, readers


# --- search and views ---------------------------------------------------------------------------


@query(
    "search_places",
    f"""{cte('places')} SELECT ord, name, district_id, category_id FROM places
WHERE (contains(lower(name), 'ga') OR contains(lower(district_id), 'ga')) AND lower(category_id) = 'beach'""",
)
def search_places(spark, sf):
    found = catalog.search_places(view(spark, sf, "places"), " GA ", "Beach")
    return found.select("ord", "name", "district_id", "category_id")


@query(
    "dlp_view",
    f"""{cte('places')} SELECT ord, name, round(lat * 1.2345::DOUBLE, 2) AS lat, round(lng * 1.2345::DOUBLE, 2) AS lng,
 'kept' AS owner FROM places""",
)
def dlp_view(spark, sf):
    rows = view(spark, sf, "places").select(
        "ord", "name", (F.col("lat") * 1.2345).alias("lat"), (F.col("lng") * 1.2345).alias("lng"),
        F.lit("kept").alias("owner"), F.col("id").alias("owner_id"), F.lit("x").alias("internal_notes"),
    )
    return catalog.dlp_view(rows)


@query(
    "select_spots",
    f"""{cte('places')} SELECT ord, category_id FROM places WHERE lower(trim(category_id)) = 'beach'
 OR contains(lower(name), 'beach') OR contains(lower(coalesce(description, '')), 'beach')""",
)
def select_spots(spark, sf):
    return catalog.select_spots(view(spark, sf, "places"), " Beach ").select("ord", "category_id")


@query("select_spots_fallback", f"{cte('places')} SELECT ord, category_id FROM places")
def select_spots_fallback(spark, sf):
    return catalog.select_spots(view(spark, sf, "places"), "no such kind").select("ord", "category_id")


@query(
    "clean_description",
    f"""{cte('places')} SELECT ord, CASE WHEN description IS NULL OR contains(lower(description), 'beautiful beaches')
 OR contains(lower(description), 'no description') THEN '' ELSE description END AS description FROM places""",
)
def clean_description(spark, sf):
    return view(spark, sf, "places").select(
        "ord", place.clean_description(F.col("description")).alias("description")
    )


@query(
    "place_id",
    f"{cte('places')} SELECT ord, concat('pl_', substr(md5(name), 1, 8)) AS id FROM places",
)
def place_id(spark, sf):
    rows = view(spark, sf, "places").select("ord", F.lit(None).cast("string").alias("River_Name"), F.col("name").alias("Name"))
    return rows.select("ord", place.place_id(place.first_name(rows)).alias("id"))


_FREE = "(contains(lower(t), 'free') OR contains(lower(t), 'no cost') OR t IN ('0', ''))"
_ROUGH = q.contains_any("lower(road)", rules.ROUGH_ROADS)


@query(
    "budget",
    f"""{cte('places')}, b AS (SELECT ord, ticket_price AS t, tourist_popularity AS p,
 CASE ord % 3 WHEN 0 THEN 'Rough track' ELSE 'Paved' END AS road FROM places),
c AS (SELECT ord, {_FREE} AS is_free, CASE WHEN {_FREE} THEN 0 ELSE
  coalesce(TRY_CAST(regexp_extract(replace(t, ',', ''), '\\d+') AS INT), 500) END AS entry,
 CASE WHEN p = 'High' THEN 1100 ELSE 600 END AS food, CASE WHEN {_ROUGH} THEN 2200 ELSE 500 END AS transport FROM b)
SELECT ord, is_free, entry, food, transport, entry + food + transport AS total,
 CASE WHEN entry + food + transport < 1500 THEN 0 WHEN entry + food + transport < 5000 THEN 1 ELSE 2 END AS level FROM c""",
)
def budget(spark, sf):
    road = F.when(F.col("ord") % 3 == 0, "Rough track").otherwise("Paved")
    cost = place.budget(F.col("ticket_price"), F.col("tourist_popularity"), road)
    return view(spark, sf, "places").select("ord", cost.alias("c")).select("ord", "c.*")


_PICK = f"list_sum(list_transform(string_split(name, ''), lambda c: unicode(c))) % {len(rules.DESCRIPTIONS)}"


def _rule_sql() -> str:
    parts = []
    for name, contained, equal in rules.CATEGORY_RULES:
        tests = [f"contains(c, {q.text(w)})" for w in contained]
        if equal:
            tests.append("c IN (" + ", ".join(q.text(e) for e in equal) + ")")
        parts.append(f"WHEN {' OR '.join(tests)} THEN {q.text(name)}")
    return "CASE " + " ".join(parts) + " END"


def _attribute_sql(attribute: str) -> str:
    parts = [
        f"WHEN r = {q.text(name)} THEN {q.text(values_[attribute])}"
        for name, values_ in rules.RULE_VALUES.items()
        if attribute in values_
    ]
    if attribute == "best_time_to_visit":
        south, north = rules.BEACH_SEASONS
        parts.insert(0, f"WHEN r = 'beach' AND lat < 7.5 THEN {q.text(south)} WHEN r = 'beach' THEN {q.text(north)}")
    if attribute == "tourist_popularity":
        parts.insert(0, f"WHEN {q.contains_any('n', rules.POPULAR_NAMES)} THEN 'High'")
    if attribute in rules.COSTLY_VALUES:
        parts.insert(0, f"WHEN {q.contains_any('n', rules.COSTLY_NAMES)} THEN {q.text(rules.COSTLY_VALUES[attribute])}")
    default = q.text(rules.PLACE_DEFAULTS[attribute])
    return f"CASE {' '.join(parts)} ELSE {default} END" if parts else default


_DESCRIBED = "CASE pick " + " ".join(
    f"WHEN {i} THEN "
    + "replace(replace(replace(replace({t}, '{{name}}', name), '{{category}}', c), '{{district}}', district), '{{province}}', province)".format(
        t=q.text(t)
    )
    for i, t in enumerate(rules.DESCRIPTIONS)
) + " END"


@query(
    "place_defaults",
    f"""{cte('places', 'districts')}, b AS (SELECT ord, name, lower(name) AS n, lower(category_id) AS c, lat, district_id AS district,
 d.province, {_PICK} AS pick FROM places JOIN (SELECT district, province FROM districts) d ON d.district = district_id),
r AS (SELECT *, {_rule_sql()} AS r FROM b)
SELECT ord, {_DESCRIBED} AS description, '24 Hours' AS opening_hours, """
    + ", ".join(f"{_attribute_sql(a)} AS {a}" for a in rules.PLACE_DEFAULTS)
    + " FROM r",
)
def place_defaults(spark, sf):
    rows = view(spark, sf, "places").join(
        F.broadcast(view(spark, sf, "districts").select(F.col("district").alias("district_id"), "province")), "district_id"
    )
    rows = rows.select(
        "ord", "name", F.col("category_id").alias("category"), F.col("district_id").alias("district"), "province",
        "lat", "lng", F.lit("Unknown").alias("opening_hours"),
    )
    out = place.place_defaults(rows)
    return out.select("ord", "description", "opening_hours", *rules.PLACE_DEFAULTS)


@query(
    "place_document",
    f"""{cte('places')} SELECT ord, concat(name, ' is a ', category_id, ' located in ', district_id, '. Description: ',
 {q.strip("coalesce(description, 'No description available.')")}, ' Activities: Sightseeing. Best time to visit: All year round. Ticket: ',
 ticket_price, ', Parking: Unknown, Safety: ', safety_level, '.') AS content FROM places""",
)
def place_document(spark, sf):
    rows = view(spark, sf, "places")
    return rows.select("ord", place.place_document(rows).alias("content"))


_TERMS = values([(k, v) for k, v in rules.SINHALA_TERMS], "term, local")


@query(
    "translate_terms",
    f"""{cte('places')}, t AS ({_TERMS}) SELECT ord, coalesce(a.local, category_id) AS category,
 coalesce(b.local, safety_level) AS safety FROM places LEFT JOIN t a ON a.term = lower(trim(category_id))
 LEFT JOIN t b ON b.term = lower(trim(safety_level))""",
)
def translate_terms(spark, sf):
    return view(spark, sf, "places").select(
        "ord",
        place.sinhala_term(F.col("category_id")).alias("category"),
        place.sinhala_term(F.col("safety_level")).alias("safety"),
    )


# --- lookups -------------------------------------------------------------------------------------------


_FOOD_MATCH = """m AS (SELECT item, arg_min(struct_pack(calories, protein, carbs, fat), prio) AS f FROM
 (SELECT DISTINCT lower(trim(name)) AS item FROM components) i JOIN foods ON contains(item, foods.name) OR contains(foods.name, item)
 GROUP BY item)"""


@query(
    "resolve_foods",
    f"""{cte('components', 'foods')}, {_FOOD_MATCH}
SELECT component_id, f IS NOT NULL AS matched, coalesce(f.calories, 80) AS calories, coalesce(f.protein, 2.0::DOUBLE) AS protein,
 coalesce(f.carbs, 8.0::DOUBLE) AS carbs, coalesce(f.fat, 4.0::DOUBLE) AS fat
FROM components LEFT JOIN m ON item = lower(trim(name))""",
)
def resolve_foods(spark, sf):
    out = lookup.resolve_foods(view(spark, sf, "components"), "name", view(spark, sf, "foods"))
    return out.select("component_id", "matched", "calories", "protein", "carbs", "fat")


@query(
    "nearest_centre",
    f"""{cte('places', 'districts')} SELECT ord, arg_min(district, d) AS district, arg_min(province, d) AS province FROM
 (SELECT ord, district, province, struct_pack(s := (places.lat - districts.lat) * (places.lat - districts.lat)
  + (places.lng - districts.lng) * (places.lng - districts.lng), p := prio) AS d FROM places, districts) GROUP BY ord""",
)
def nearest_centre(spark, sf):
    near = place.nearest_centre(F.col("lat"), F.col("lng"))
    return view(spark, sf, "places").select("ord", near.alias("c")).select("ord", "c.*")


@query(
    "mentions",
    """SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(lower(documents.text), lower(benchmark.text))""",
)
def mentions(spark, sf):
    names = table(spark, sf, "benchmark").withColumnRenamed("text", "name")
    found = lookup.mentions(table(spark, sf, "documents"), "text", names, "name")
    return found.select("doc_id", "item_id")


_NOTICE = (
    "CASE ord % 9 WHEN 0 THEN concat('Mahaweli ', name) WHEN 1 THEN concat('Victoria ', name) "
    "WHEN 2 THEN concat('Kandy Lake ', name) WHEN 3 THEN concat('Parakramabahu ', name) "
    "WHEN 4 THEN concat('A9 Highway ', name) ELSE name END"
)


def _first_note(entries: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN contains(n, {q.text(k)}) THEN {q.text(v)}" for k, v in entries) + " END"


@query(
    "name_notes",
    f"""{cte('places')}, k AS (SELECT ord, lower({_NOTICE}) AS n FROM places) SELECT ord,
 {_first_note([(k, ", ".join(v)) for k, v in rules.SPANS])} AS spans, {_first_note(rules.PLACE_NOTES)} AS note,
 {_first_note(rules.HISTORY_NOTES)} AS history FROM k""",
)
def name_notes(spark, sf):
    rows = view(spark, sf, "places").select("ord", F.expr(_NOTICE).alias("name"))
    return place.name_notes(rows).select("ord", "spans", "note", "history")


def _alert_sql() -> str:
    def either(word: str) -> str:
        return f"(contains(t, {q.text(word)}) OR contains(b, {q.text(word)}))"

    def any_word(words: list[str]) -> str:
        return " OR ".join(either(w) for w in words)

    def place_sql(i: int, default: object) -> str:
        cases = " ".join(f"WHEN {either(p[0].lower())} THEN {q.text(str(p[i]))}" for p in rules.ALERT_POSITIONS)
        return f"CASE {cases} ELSE {q.text(str(default))} END"

    name, lat, lng = rules.COUNTRY_CENTRE
    return f"""a AS (SELECT event_id, title, description, lower(title) AS t, lower(description) AS b FROM alerts),
l AS (SELECT *, {place_sql(0, name)} AS district, {place_sql(1, lat)}::DOUBLE AS lat, {place_sql(2, lng)}::DOUBLE AS lng,
 CASE WHEN {any_word(rules.ALERT_RED)} THEN 'Red' WHEN {any_word(rules.ALERT_AMBER)} THEN 'Amber' ELSE 'Yellow' END AS level,
 CASE WHEN {either('rain')} THEN 'Heavy Rain' WHEN {either('flood')} THEN 'Flood Alert' WHEN {either('landslide')} THEN 'Landslide Warning'
  WHEN contains(t, 'wind') OR contains(t, 'cyclone') THEN 'Strong Winds' ELSE 'Weather Warning' END AS hazard FROM a),
tagged AS (SELECT event_id, district, lat, lng, level, hazard, CASE level WHEN 'Red' THEN 15000 WHEN 'Amber' THEN 10000 ELSE 5000 END AS radius,
 concat(title, ': ', substr(description, 1, 200)) AS bulletin FROM l)"""


@query("tag_alerts", f"{cte('alerts')}, {_alert_sql()} SELECT * FROM tagged")
def tag_alerts(spark, sf):
    out = lookup.tag_alerts(view(spark, sf, "alerts"))
    return out.select("event_id", "district", "lat", "lng", "level", "hazard", "radius", "bulletin")


_DISTANCE = values([(i, *d) for i, d in enumerate(rules.DISTANCES)], "prio, one, two, distance, duration")


@query(
    "distance_lookup",
    f"""{cte('trips')}, r AS ({_DISTANCE}), p AS (SELECT DISTINCT lower(src) AS a, lower(dst) AS b FROM trips),
h AS (SELECT a, b, arg_min(distance, prio) AS distance, arg_min(duration, prio) AS duration FROM p JOIN r
 ON (contains(one, a) AND contains(two, b)) OR (contains(one, b) AND contains(two, a)) GROUP BY a, b)
SELECT trip_id, distance, duration FROM trips LEFT JOIN h ON a = lower(src) AND b = lower(dst)""",
)
def distance_lookup(spark, sf):
    return lookup.distance_lookup(view(spark, sf, "trips"), "src", "dst").select("trip_id", "distance", "duration")


_CODE = "CASE o_orderkey % 6 WHEN 0 THEN 'USD' WHEN 1 THEN ' eur ' WHEN 2 THEN 'Gbp' WHEN 3 THEN 'AUD' WHEN 4 THEN 'inr' ELSE 'JPY' END"
_RATES = values(rules.CURRENCY_RATES, "code, rate")


@query(
    "convert_currency",
    f"""WITH r AS ({_RATES}), o AS (SELECT o_orderkey, o_totalprice AS amount, {_CODE} AS code FROM orders)
SELECT o_orderkey, rate, amount * rate AS lkr, rate IS NULL AS unsupported FROM o LEFT JOIN r ON r.code = lower(trim(o.code))""",
)
def convert_currency(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("amount"), F.expr(_CODE).alias("code"))
    out = lookup.convert_currency(rows, "amount", "code")
    return out.select(
        "o_orderkey", "rate", "lkr", F.col("answer").startswith("Unsupported").alias("unsupported")
    )


_LOCATION = "CASE event_id % 5 WHEN 0 THEN 'Kandy city' WHEN 1 THEN 'ELLA' WHEN 2 THEN 'eliya' WHEN 3 THEN 'Paris' ELSE 'galle' END"
_WEATHER_PLACES = values([(i, *p) for i, p in enumerate(rules.WEATHER_PLACES)], "prio, place, lat, lng")
_WEATHER_CODES = values(rules.WEATHER_CODES, "code, text")


@query(
    "weather_codes",
    f"""WITH w AS ({_WEATHER_PLACES}), c AS ({_WEATHER_CODES}), e AS (SELECT event_id, {_LOCATION} AS loc, event_id % 100 AS code FROM events),
m AS (SELECT loc, arg_min(lat, prio) AS lat, arg_min(lng, prio) AS lng FROM (SELECT DISTINCT loc FROM e) JOIN w
 ON contains(lower(loc), place) OR contains(place, lower(loc)) GROUP BY loc)
SELECT event_id, CASE WHEN m.lat IS NULL THEN 'Colombo (Default)' WHEN e.loc = 'ELLA' THEN 'Ella' WHEN e.loc = 'Kandy city' THEN 'Kandy City'
 WHEN e.loc = 'eliya' THEN 'Eliya' ELSE 'Galle' END AS shown, coalesce(m.lat, 6.9271::DOUBLE) AS lat, coalesce(m.lng, 79.8612::DOUBLE) AS lng,
 coalesce(c.text, {q.text(rules.WEATHER_DEFAULT)}) AS weather FROM e LEFT JOIN m ON m.loc = e.loc LEFT JOIN c ON c.code = e.code""",
)
def weather_codes(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", F.expr(_LOCATION).alias("loc"), (F.col("event_id") % 100).alias("code")
    )
    return lookup.weather_codes(rows, "loc", "code").select("event_id", "shown", "lat", "lng", "weather")


# --- routes ---------------------------------------------------------------------------------------------------


_EDGES = values(
    [(s, d, i) for s, ds in rules.NEIGHBOURS.items() for i, d in enumerate(ds)], "src, dst, pos"
)
_CLOSED = ["galle", "kandy", "ratnapura"]
_CLOSED_SQL = ", ".join(q.text(c) for c in _CLOSED)


def _walk(name: str, condition: str) -> str:
    """Simple walks of at most nine hops; every fewest-hop path is among them."""
    return f"""{name} AS (SELECT src AS start, src AS node, [src] AS path, []::INT[] AS turns FROM (SELECT DISTINCT src FROM edges)
 UNION ALL SELECT w.start, e.dst, list_append(w.path, e.dst), list_append(w.turns, e.pos) FROM {name} w JOIN edges e ON e.src = w.node
 WHERE len(w.path) < 9 AND NOT list_contains(w.path, e.dst){condition})"""


@query(
    "district_routes",
    f"""{cte('trips', recursive=True)}, edges AS ({_EDGES}),
{_walk('free_walk', '')},
{_walk('clear_walk', f" AND (w.node NOT IN ({_CLOSED_SQL}) OR w.node = w.start)")},
a AS (SELECT start, node, arg_min(path, struct_pack(n := len(path), t := turns)) AS path FROM free_walk GROUP BY start, node),
c AS (SELECT start, node, arg_min(path, struct_pack(n := len(path), t := turns)) AS path FROM clear_walk GROUP BY start, node)
SELECT trip_id, array_to_string(coalesce(c.path, a.path), '>') AS path, c.path IS NULL AND a.path IS NOT NULL AS fallback
FROM trips LEFT JOIN a ON a.start = lower(src) AND a.node = lower(dst) LEFT JOIN c ON c.start = lower(src) AND c.node = lower(dst)""",
)
def district_routes(spark, sf):
    closed = spark.createDataFrame([(c,) for c in _CLOSED], "district string")
    out = routes.district_routes(view(spark, sf, "trips"), "src", "dst", routes.district_edges(spark), closed)
    return out.select("trip_id", F.array_join("path", ">").alias("path"), "fallback")


_PATH = "list_value(lower(src), 'kandy', 'matale', lower(dst))"
_PATH_SPARK = "array_distinct(array(lower(src), 'kandy', 'matale', lower(dst)))"


def _hazard_sql(tail: str, start: str | None = None, trips: str = "trips", path: str = _PATH) -> str:
    return f"""{start or cte('trips', 'places', 'alerts')}, {_alert_sql()},
w AS (SELECT lower(district) AS district, arg_min(level, event_id) AS level, arg_min(hazard, event_id) AS hazard,
 arg_min(bulletin, event_id) AS bulletin FROM tagged GROUP BY 1),
u AS (SELECT trip_id, unnest({path}) AS district, generate_subscripts({path}, 1) AS hop FROM {trips}),
s AS (SELECT trip_id, district, min(hop) AS hop FROM u GROUP BY trip_id, district),
p AS (SELECT lower(district_id) AS district, ord, safety_level, name FROM places),
dist AS (SELECT district, min(ord) FILTER (WHERE safety_level = 'Dangerous') AS first, count(*) FILTER (WHERE safety_level = 'Dangerous') AS dangers FROM p GROUP BY 1),
early AS (SELECT p.district, count(*) AS n FROM p JOIN dist USING (district) WHERE safety_level = 'Moderate' AND (first IS NULL OR ord < first) GROUP BY 1),
r AS (SELECT trip_id, hop, s.district, first, coalesce(dangers, 0) AS dangers, coalesce(early.n, 0) AS cautions, level, hazard, bulletin,
 coalesce(max(coalesce(dangers, 0) > 0) OVER (PARTITION BY trip_id ORDER BY hop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen,
 coalesce(max(coalesce(level = 'Red', false)) OVER (PARTITION BY trip_id ORDER BY hop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS red,
 max(coalesce(dangers, 0) > 0) OVER (PARTITION BY trip_id) AS bad
 FROM s LEFT JOIN dist ON dist.district = s.district LEFT JOIN early ON early.district = s.district LEFT JOIN w ON w.district = s.district),
x AS (SELECT *, dangers + CASE WHEN seen THEN 0 ELSE cautions END AS spots, coalesce(level = 'Red' OR (level = 'Amber' AND NOT bad AND NOT red), false) AS shown FROM r)
{tail}"""


def _route_inputs(spark, sf):
    paths = view(spark, sf, "trips").select("trip_id", F.expr(_PATH_SPARK).alias("path"))
    warned = lookup.tag_alerts(view(spark, sf, "alerts")).withColumn("ord", F.col("event_id"))
    return paths, view(spark, sf, "places"), warned


@query(
    "route_hazards",
    _hazard_sql(
        """SELECT trip_id, CASE WHEN max(dangers > 0 OR coalesce(level = 'Red', false)) THEN 'Dangerous' WHEN max(spots > 0 OR shown) THEN 'Moderate'
 ELSE 'Safe' END AS safety, CAST(sum(spots) AS BIGINT) AS spot_cautions, count(*) FILTER (WHERE shown) AS alert_cautions FROM x GROUP BY trip_id"""
    ),
)
def route_hazards(spark, sf):
    paths, spots, warned = _route_inputs(spark, sf)
    return routes.route_hazards(paths, "trip_id", spots, warned)


_ROUTED = f"""{cte('trips', 'places', 'alerts', recursive=True)}, edges AS ({_EDGES}),
{_walk('free_walk', '')},
{_walk('clear_walk', f" AND (w.node NOT IN ({_CLOSED_SQL}) OR w.node = w.start)")},
ways AS (SELECT start, node, arg_min(path, struct_pack(n := len(path), t := turns)) AS path FROM free_walk GROUP BY start, node),
clear AS (SELECT start, node, arg_min(path, struct_pack(n := len(path), t := turns)) AS path FROM clear_walk GROUP BY start, node),
ends AS (SELECT DISTINCT lower(src) AS s, lower(dst) AS d FROM trips),
routed AS (SELECT concat(s, '>', d) AS trip_id, coalesce(clear.path, ways.path) AS route FROM ends LEFT JOIN ways ON ways.start = s AND ways.node = d
 LEFT JOIN clear ON clear.start = s AND clear.node = d)"""


@query(
    "route_cautions",
    _hazard_sql(
        """SELECT trip_id AS route, 0 AS stage, CAST(hop - 1 AS INTEGER) AS pos, p.ord, CASE safety_level WHEN 'Dangerous' THEN concat('⚠️ Dangerous spot in ', upper(district), ': ', name, ' (Wildlife caution)')
 ELSE concat('⚠️ Caution in ', upper(district), ': ', name, ' (Rain caution)') END AS caution FROM x JOIN p USING (district)
 WHERE safety_level = 'Dangerous' OR (safety_level = 'Moderate' AND NOT seen AND (first IS NULL OR ord < first))
UNION ALL SELECT trip_id, 1, CAST(hop - 1 AS INTEGER), 0, concat(CASE level WHEN 'Red' THEN '🚨 Evacuate immediately in ' ELSE '⚠️ DMC Warning in ' END, upper(district), ': ', hazard, ' (', bulletin, ')')
 FROM x WHERE shown""",
        _ROUTED, "routed", "route",
    ),
)
def route_cautions(spark, sf):
    """The caution lists of the routes between all ends of trips."""
    _, spots, warned = _route_inputs(spark, sf)
    ends = view(spark, sf, "trips").select(F.lower("src").alias("src"), F.lower("dst").alias("dst")).distinct()
    closed = spark.createDataFrame([(c,) for c in _CLOSED], "district string")
    paths = routes.district_routes(ends, "src", "dst", routes.district_edges(spark), closed)
    named = paths.select(F.concat("src", F.lit(">"), "dst").alias("route"), "path")
    return routes.route_cautions(named, "route", spots, warned).select("route", "stage", "pos", "ord", "caution")


# --- deduplication and changes ------------------------------------------------------------------------------------


_DROPPED = f"""t AS MATERIALIZED (SELECT doc_id, text, {q.words('lower(text)')} AS w FROM documents),
sh AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) < 5 THEN [hash(text)] ELSE list_transform(generate_series(1, len(w) - 4),
 lambda i: hash(array_to_string(w[i:i+4], ' '))) END) AS s FROM t),
un AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sh),
ov AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM un a JOIN un b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
ed AS MATERIALIZED (SELECT b, list(a) AS earlier, row_number() OVER (ORDER BY b) AS i FROM ov WHERE c * 5 >= (na + nb - c) * 4 GROUP BY b),
scan AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS gone UNION ALL
 SELECT ed.i, CASE WHEN len(list_filter(ed.earlier, lambda x: NOT list_contains(scan.gone, x))) > 0 THEN list_append(scan.gone, ed.b) ELSE scan.gone END
 FROM scan JOIN ed ON ed.i = scan.i + 1),
gone AS (SELECT unnest(gone) AS doc_id FROM scan WHERE i = (SELECT max(i) FROM scan))"""


@query("near_dedup", f"WITH RECURSIVE {_DROPPED} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)")
def near_duplicates(spark, sf):
    return near_dedup(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id")


@query("exact_dedup", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def exact_duplicates(spark, sf):
    return exact_dedup(table(spark, sf, "documents"), "doc_id").select("doc_id")


@query(
    "merge_records",
    f"""{cte('record_files', recursive=True)}, seq AS (SELECT row_number() OVER (ORDER BY ord) AS i, ord, id, lower(trim(name)) AS n FROM record_files),
scan AS (SELECT 0::BIGINT AS i, 0::BIGINT AS ord, '' AS new_id, false AS keep, []::VARCHAR[] AS ids, []::VARCHAR[] AS names UNION ALL
 SELECT i, ord, new_id, keep, CASE WHEN keep THEN list_append(ids, new_id) ELSE ids END, CASE WHEN keep THEN list_append(names, n) ELSE names END FROM
 (SELECT seq.i, seq.ord, n, CASE WHEN id = '' THEN concat('pl_', substr(md5(n), 1, 8)) ELSE id END AS new_id, ids, names,
  NOT ((id <> '' AND list_contains(ids, id)) OR (n <> '' AND list_contains(names, n))) AS keep FROM scan JOIN seq ON seq.i = scan.i + 1))
SELECT ord, new_id AS id FROM scan WHERE keep""",
)
def merged_records(spark, sf):
    return merge_records(view(spark, sf, "record_files"), "ord").select("ord", "id")


_FOOD_NAMES = "concat(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END, ' (', CAST(p_size AS STRING), ' cups)')"


@query(
    "dedup_normalised_names",
    f"""WITH n AS (SELECT p_partkey, lower(trim(regexp_replace({_FOOD_NAMES}, '\\(.*?\\)', '', 'g'))) AS k FROM part)
SELECT min(p_partkey) AS p_partkey FROM n WHERE k NOT IN (SELECT k FROM n WHERE p_partkey % 50 = 0) GROUP BY k""",
)
def food_names(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.expr(_FOOD_NAMES).alias("food"))
    existing = rows.where("p_partkey % 50 = 0").select("food")
    return dedup_normalised_names(rows, "p_partkey", "food", existing).select("p_partkey")


@query(
    "update_rows",
    f"""{cte('places')} SELECT id, CASE WHEN ord % 10 = 0 THEN 'renamed' ELSE name END AS name, 'table' AS part FROM places
UNION ALL SELECT concat('new', id), 'renamed', 'unknown' FROM places WHERE ord % 10 = 1""",
)
def update_rows(spark, sf):
    current = view(spark, sf, "places").select("id", "name", "ord")
    changes = current.where("ord % 10 < 2").select(
        F.when(F.col("ord") % 10 == 0, F.col("id")).otherwise(F.concat(F.lit("new"), "id")).alias("id"),
        F.lit("renamed").alias("name"),
        F.lit(2).alias("step"),
    )
    # every change was preceded by another one of the same row
    changes = changes.unionByName(changes.select("id", F.lit("draft").alias("name"), F.lit(1).alias("step")))
    updated, unknown = catalog.update_rows(current.drop("ord"), changes, "id", "step")
    updated = updated.drop("step")
    return updated.withColumn("part", F.lit("table")).unionByName(
        unknown.select("id", "name").withColumn("part", F.lit("unknown"))
    )


@query(
    "delete_rows",
    f"""{cte('places')} SELECT id, 'table' AS part FROM places WHERE ord % 10 <> 0
UNION ALL SELECT concat('new', id), 'unknown' FROM places WHERE ord % 10 = 1""",
)
def delete_rows(spark, sf):
    current = view(spark, sf, "places").select("id", "ord")
    keys = current.where("ord % 10 < 2").select(
        F.when(F.col("ord") % 10 == 0, F.col("id")).otherwise(F.concat(F.lit("new"), "id")).alias("id")
    )
    left, unknown = catalog.delete_rows(current, keys, "id")
    return left.select("id", F.lit("table").alias("part")).unionByName(unknown.withColumn("part", F.lit("unknown")))


@query(
    "insert_rows",
    f"""{cte('places')}, new AS (SELECT ord, CASE WHEN ord % 3 = 0 THEN name ELSE concat('Twin ', CAST(ord // 4 AS VARCHAR)) END AS name,
 concat('pl_', substr(md5(CASE WHEN ord % 3 = 0 THEN name ELSE concat('Twin ', CAST(ord // 4 AS VARCHAR)) END), 1, 8)) AS pid FROM places)
SELECT ord, CASE WHEN pid IN (SELECT id FROM places) OR ord <> min(ord) OVER (PARTITION BY pid)
 THEN concat('pl_', md5(concat(name, ':', CAST(ord AS VARCHAR)))) ELSE pid END AS id FROM new""",
)
def insert_rows(spark, sf):
    current = view(spark, sf, "places")
    twin = F.concat(F.lit("Twin "), F.floor(F.col("ord") / 4).cast("string"))
    new = current.select("ord", F.when(F.col("ord") % 3 == 0, F.col("name")).otherwise(twin).alias("name"))
    return catalog.assign_ids(current.select("id"), new, "ord").select("ord", "id")


@query(
    "delete_nth",
    f"""{cte('pairs')}, n AS (SELECT row_number() OVER (ORDER BY pair_id) - 1 AS i, pair_id FROM pairs)
SELECT pair_id, CASE WHEN i > 17 THEN i - 1 ELSE i END AS index FROM n WHERE i <> 17""",
)
def delete_nth(spark, sf):
    return catalog.delete_nth(view(spark, sf, "pairs"), ["pair_id"], 17).select("pair_id", "index")


# --- retrieval ------------------------------------------------------------------------------------------------------


@query(
    "vector_topk",
    """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 3""",
)
def vector_topk(spark, sf):
    vecs = table(spark, sf, "embeddings")
    top = retrieval.vector_topk(
        vecs.withColumnRenamed("vec_id", "query_id"), vecs.withColumnRenamed("vec_id", "doc_id"), 3, skip_self=True
    )
    return top.withColumn("score", F.round("score", 6))


_PLATE = (
    "CASE o_orderkey % 7 WHEN 0 THEN 'Jaffna Crab' WHEN 1 THEN 'Fish rice' WHEN 2 THEN 'budget Egg Hopper' "
    "WHEN 3 THEN 'fitness chicken fish' WHEN 4 THEN 'string hoppers' WHEN 5 THEN 'DHAL normal' ELSE 'soup' END"
)
_RECIPES = "SELECT * FROM (VALUES " + ", ".join(
    f"({o}, {q.text(t)}, [{', '.join(q.text(x) for x in tags)}])" for o, t, _, tags in food.RECIPES
) + ") AS v(ord, title, tags)"


@query(
    "keyword_retrieve",
    f"""WITH d AS ({_RECIPES}), c AS (SELECT o_orderkey, lower({_PLATE}) AS n FROM orders),
h AS (SELECT o_orderkey, ord, title FROM c JOIN d ON len(list_filter(tags, lambda t: contains(n, t))) > 0
  OR len(list_filter({q.words('n')}, lambda w: contains(lower(title), w))) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY ord) AS rank FROM h)
SELECT o_orderkey, ord, title, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2
UNION ALL SELECT o_orderkey, 0, {q.text(food.RECIPES[0][1])}, 1 FROM c WHERE o_orderkey NOT IN (SELECT o_orderkey FROM h)""",
)
def keyword_retrieve(spark, sf):
    docs = spark.createDataFrame(food.RECIPES, "ord int, title string, desc string, tags array<string>")
    asked = table(spark, sf, "orders").select("o_orderkey", F.expr(_PLATE).alias("ask"))
    return retrieval.keyword_retrieve(asked, "o_orderkey", "ask", docs, "ord")


@query("similar_prompt")
def similar_prompt(spark, sf):
    existing = view(spark, sf, "pairs").select("pair_id", "prompt")
    new = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("ask"))
    return retrieval.similar_prompt(new, "item_id", "ask", existing, "prompt", "pair_id")


_FILES = "SELECT concat('l', CAST(n_nationkey AS STRING)) AS source FROM nation"


@query(
    "document_chunk_counts",
    f"""WITH f AS ({_FILES}), c AS (SELECT concat('l', CAST(label AS STRING)) AS source, count(*) AS n FROM embeddings GROUP BY 1)
SELECT f.source, coalesce(n, 0) AS chunks FROM f LEFT JOIN c ON c.source = f.source""",
)
def document_chunk_counts(spark, sf):
    files = table(spark, sf, "nation").selectExpr("concat('l', CAST(n_nationkey AS STRING)) AS source")
    chunks = table(spark, sf, "embeddings").selectExpr("concat('l', CAST(label AS STRING)) AS source")
    return retrieval.document_chunk_counts(files, chunks, "source")


@query(
    "delete_by_source",
    """SELECT source, count(*) AS n, part FROM (SELECT concat('s', CAST(label AS STRING)) AS source,
 CASE WHEN label % 3 = 0 THEN 'deleted' ELSE 'kept' END AS part FROM embeddings) GROUP BY source, part""",
)
def delete_by_source(spark, sf):
    chunks = table(spark, sf, "embeddings").selectExpr("concat('s', CAST(label AS STRING)) AS source", "label", "vec_id")
    kept, gone = retrieval.delete_by_source(chunks, chunks.where("label % 3 = 0").select("source").distinct(), "source")
    counts = kept.groupBy("source").agg(F.count("*").alias("n")).withColumn("part", F.lit("kept"))
    return counts.unionByName(gone.select("source", F.col("deleted").alias("n"), F.lit("deleted").alias("part")))


# --- map features and manifests -------------------------------------------------------------------------------------------


_NODES = """SELECT event_id AS id, CAST(590 + (event_id * 37) % 390 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat,
 CAST(7970 + (event_id * 53) % 210 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon FROM events"""


def _map_nodes(spark, sf):
    rows = table(spark, sf, "events")
    lat = (590 + (F.col("event_id") * 37) % 390).cast("double") / 100.0
    lon = (7970 + (F.col("event_id") * 53) % 210).cast("double") / 100.0
    tags = F.map_filter(
        F.create_map(
            F.lit("name"), F.concat(F.lit("Node "), F.col("event_id").cast("string")),
            F.lit("tourism"), F.when(F.col("event_id") % 5 == 0, "museum"),
            F.lit("natural"), F.when(F.col("event_id") % 3 == 0, "beach"),
            F.lit("amenity"), F.when(F.col("event_id") % 4 == 0, "cafe").otherwise("bank"),
            F.lit("place"), F.when(F.col("event_id") % 7 == 0, "village"),
        ),
        lambda k, v: v.isNotNull(),
    )
    return rows.select(F.col("event_id").alias("id"), lat.alias("lat"), lon.alias("lon"), tags.alias("tag"))


def _map_ways(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"))
    ways = rows.agg(F.collect_list(F.col("l_partkey") * 8).alias("nd"))  # at most seven lines per order
    tags = F.create_map(
        F.lit("name"), F.concat(F.lit("Way "), F.col("id").cast("string")),
        F.lit("leisure"), F.when(F.col("id") % 2 == 0, "park").otherwise(""),
    )
    return ways.select("id", "nd", F.map_filter(tags, lambda k, v: v != "").alias("tag"))


_WAYS = f"""n AS ({_NODES}), wc AS (SELECT l_orderkey AS id, avg(lat) AS lat, avg(lon) AS lon FROM lineitem JOIN n ON n.id = l_partkey * 8 GROUP BY 1)"""


@query(
    "way_centroids",
    f"WITH {_WAYS} SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM wc",
)
def way_centroids(spark, sf):
    out = readers.way_centroids(_map_ways(spark, sf), _map_nodes(spark, sf))
    return out.select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


_OSM = f"""{cte('districts')}, {_WAYS},
f AS (SELECT 0 AS kind, id, concat('Node ', CAST(id AS VARCHAR)) AS name, lat, lon, CASE WHEN id % 5 = 0 THEN 'Museum' WHEN id % 3 = 0 THEN 'Beach'
  WHEN id % 4 = 0 THEN 'Cafe' WHEN id % 7 = 0 THEN 'Village' END AS category FROM n
 UNION ALL SELECT 1, id, concat('Way ', CAST(id AS VARCHAR)), lat, lon, CASE WHEN id % 2 = 0 THEN 'Park' END FROM wc),
o AS (SELECT kind, f.id, name, category, arg_min(district, struct_pack(s := (f.lat - d.lat) * (f.lat - d.lat) + (f.lon - d.lng) * (f.lon - d.lng), p := prio)) AS district
 FROM f, districts d WHERE category IS NOT NULL GROUP BY ALL)"""


@query("osm_places", f"{_OSM} SELECT kind, id, name, category, district FROM o")
def osm_places(spark, sf):
    found = readers.osm_places(_map_nodes(spark, sf), _map_ways(spark, sf))
    return found.select("kind", "id", "name", "category", "district")


@query(
    "verify_manifest",
    """SELECT concat('f', CAST(page_id AS VARCHAR)) AS filename, CASE WHEN page_id % 11 = 0 THEN 'missing' WHEN page_id % 5 = 0 THEN 'registered'
 WHEN page_id % 7 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM pages WHERE NOT (page_id % 11 = 0 AND page_id % 5 = 0)""",
)
def verify_manifest(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("filename"),
        F.col("html").cast("binary").alias("content"),
    )
    changed = F.when(F.col("page_id") % 7 == 0, F.sha2(F.reverse(F.hex("content")), 256)).otherwise(F.sha2("content", 256))
    known = pages.where("page_id % 5 <> 0").select("filename", changed.alias("sha256"))
    return manifest.verify_manifest(pages.where("page_id % 11 <> 0"), known)
