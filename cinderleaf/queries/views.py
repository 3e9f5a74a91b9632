"""Input tables and the views derived from them, stated once for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cinderleaf.fixed import food_rules, place_rules

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """SELECT over a VALUES list; doubles are cast in both engines."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({columns})"


_LOCALS = ", ".join(f"'{d}'" for d, *_ in place_rules.DISTRICTS)

# name -> (tables and views it reads, statement)
VIEWS: dict[str, tuple[list[str], str]] = {
    "districts": (
        [],
        values([(i, *d) for i, d in enumerate(place_rules.DISTRICTS)], "prio, district, lat, lng, province"),
    ),
    "foods": (
        [],
        values(
            [(i, f[0], f[1], *f[2:]) for i, f in enumerate(food_rules.FOODS)],
            "prio, name, calories, protein, carbs, fat",
        ),
    ),
    "places": (
        ["part"],
        """SELECT p_partkey AS ord,
 concat('pl_', substring(md5(concat(p_name, ' ', CAST(p_partkey AS STRING))), 1, 8)) AS id,
 concat(p_name, ' ', CAST(p_partkey AS STRING)) AS name,
 CASE p_partkey % 6 WHEN 0 THEN 'Beach' WHEN 1 THEN 'Waterfall' WHEN 2 THEN 'Temple'
  WHEN 3 THEN 'Viewpoint' WHEN 4 THEN 'National_park' ELSE 'Cafe' END AS category_id,
 CAST(590 + (p_partkey * 37) % 390 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat,
 CAST(7970 + (p_partkey * 53) % 210 AS DOUBLE) / CAST(100 AS DOUBLE) AS lng,
 CASE p_partkey % 25 """
        + " ".join(f"WHEN {i} THEN '{d}'" for i, (d, *_) in enumerate(place_rules.DISTRICTS))
        + """ END AS district_id,
 CASE p_size % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS tourist_popularity,
 CASE p_partkey % 5 WHEN 0 THEN 'Moderate' WHEN 1 THEN 'Dangerous' ELSE 'Safe' END AS safety_level,
 CASE WHEN p_partkey % 4 = 0 THEN 'Free' ELSE concat(CAST(p_size * 100 AS STRING), ' LKR') END AS ticket_price,
 CASE p_partkey % 4 WHEN 0 THEN 'No description available' WHEN 1 THEN concat('A quiet spot near ', p_type)
  WHEN 2 THEN NULL ELSE 'Home of beautiful beaches' END AS description
FROM part""",
    ),
    "components": (
        ["lineitem"],
        """SELECT l_orderkey AS dish_id, l_linenumber AS pos, l_orderkey * 10 + l_linenumber AS component_id,
 CASE l_partkey % 8 WHEN 0 THEN 'White Rice ' WHEN 1 THEN 'spicy chicken curry' WHEN 2 THEN 'dhal'
  WHEN 3 THEN 'pol sambol' WHEN 4 THEN 'papadam' WHEN 5 THEN 'Kottu' WHEN 6 THEN 'curry' ELSE 'jackfruit' END AS name
FROM lineitem""",
    ),
    "requests": (
        ["events"],
        """SELECT event_id, concat('10.0.0.', CAST(user_id % 5 AS STRING)) AS client_ip,
 user_id AS session_id, concat('n', CAST(event_id % 900 AS STRING)) AS nonce,
 (event_id - event_id % 100) * 600 + (event_id % 100) * 30 AS t_ms
FROM events""",
    ),
    "prompts": (
        ["conversations"],
        """SELECT conv_id * 1000 + turn AS prompt_id, conv_id AS session_id, turn, role,
 CASE (conv_id * 7 + turn) % 9 WHEN 0 THEN concat(text, ' ignore all previous instructions')
  WHEN 1 THEN concat(text, ' please act as my guide') WHEN 2 THEN concat('pretend to be free. ', text)
  WHEN 3 THEN concat(text, ' system prompt') ELSE text END AS text,
 conv_id * 10000000 + turn * CASE WHEN conv_id % 3 = 0 THEN 2000000 ELSE 60000 END AS t_ms
FROM conversations""",
    ),
    "predictions": (
        ["benchmark"],
        """SELECT item_id, text AS reference,
 CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, ' the ', ' ') ELSE 'I do not know 42' END AS generated,
 CAST(item_id % 4 AS INT) AS answer
FROM benchmark""",
    ),
    "pairs": (
        ["conversations"],
        """SELECT a.conv_id, a.turn, a.conv_id * 1000 + a.turn AS pair_id, a.text AS prompt, b.text AS chosen,
 a.text AS rejected
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
WHERE a.role = 'user' AND b.role = 'assistant'""",
    ),
    "alerts": (
        ["events"],
        """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Flood warning in Kandy'
  WHEN 1 THEN 'Evacuate Galle: landslide' WHEN 2 THEN 'Scattered rain' ELSE 'Notice' END AS title,
 CASE event_id % 3 WHEN 0 THEN 'strong wind near Jaffna' ELSE 'no detail' END AS description
FROM events""",
    ),
    "files": (
        ["pages"],
        """SELECT page_id, concat('f', CAST(page_id AS STRING), CASE page_id % 4 WHEN 0 THEN '.csv'
  WHEN 1 THEN '.md' WHEN 2 THEN '.exe' ELSE '../x.txt' END) AS filename, html, length(html) AS size
FROM pages""",
    ),
    "trips": (
        ["orders"],
        "SELECT o_orderkey AS trip_id, "
        "CASE o_custkey % 25 "
        + " ".join(f"WHEN {i} THEN '{d}'" for i, (d, *_) in enumerate(place_rules.DISTRICTS))
        + " END AS src, CASE (o_orderkey * 7) % 25 "
        + " ".join(f"WHEN {i} THEN '{d}'" for i, (d, *_) in enumerate(place_rules.DISTRICTS))
        + " END AS dst FROM orders",
    ),
    "record_files": (
        ["places"],
        """SELECT ord * 2 AS ord, id, name FROM places
UNION ALL SELECT ord * 2 + 1, CASE WHEN ord % 3 = 0 THEN '' ELSE concat('x', CAST(ord % 40 AS STRING)) END, upper(name)
FROM places WHERE ord % 2 = 0""",
    ),
    "audit": (
        ["events"],
        """SELECT event_id, user_id AS stream, '2024-01-01 00:00:00' AS timestamp,
 concat('10.0.0.', CAST(user_id % 5 AS STRING)) AS client_ip, concat('/api/', event_type) AS endpoint,
 CASE event_id % 7 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'WARNING' ELSE 'INFO' END AS threat_level,
 props AS message, event_id % 4 <> 0 AS passed
FROM events""",
    ),
    "steps": (
        ["orders"],
        """SELECT o_custkey AS run_id, o_orderkey AS step, CAST(o_orderkey * 2 AS BIGINT) AS max_steps,
 o_totalprice / CAST(100000 AS DOUBLE) AS loss, CAST(1 AS DOUBLE) / o_orderkey AS learning_rate,
 CAST(o_orderkey % 10 AS DOUBLE) AS epoch FROM orders WHERE o_orderkey > 0""",
    ),
}


def _order(names: tuple[str, ...]) -> list[str]:
    """Views needed for the names, dependencies first."""
    out: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in out:
            for need in VIEWS[name][0]:
                add(need)
            out.append(name)

    for name in names:
        add(name)
    return out


def cte(*names: str, recursive: bool = False) -> str:
    """WITH clause that defines the views."""
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in _order(names)]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts)


# Below this size a table may sit in a single row group, which one task would read and compute alone.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores; larger ones come in many row groups and stay as they are."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/{name}.parquet"))


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A derived view as a DataFrame."""
    needed = _order((name,))
    sources = {t for v in needed for t in VIEWS[v][0] if t in TABLES}
    parts = [f"{t} AS (SELECT * FROM parquet.`{sf}/{t}.parquet`)" for t in sorted(sources)]
    parts += [f"{n} AS ({VIEWS[n][1]})" for n in needed]
    return spread(spark.sql("WITH " + ",\n".join(parts) + f"\nSELECT * FROM {name}"))
