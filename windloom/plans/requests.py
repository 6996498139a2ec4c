"""Queries that read names, parameters and quantities from requests derived from the orders, with their SQL.

Each order gives one request text, so the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.functions import extract as X
from windloom.functions import text as T
from windloom.operators import design
from windloom.session import checkpointed, table

#: The request of an order, in SQL that Spark and DuckDB read alike; k is its key.
_KINDS = (
    "'Please explain the NACA ' || lpad(cast(k % 100000 as varchar(9)), CASE WHEN k % 2 = 0 THEN 4 ELSE 5 END, '0') || ' section at Re=' || cast(k % 900 + 100 as varchar(9)) || 'e3, V: ' || cast(k % 60 as varchar(9)) || '.5 m/s. See also E' || lpad(cast(k % 1000 as varchar(9)), 3, '0') || ', goe228 and AG35.'",
    "'What is a wing of mass ' || cast(k % 700 as varchar(9)) || ' lbs, cruise ' || cast(k % 150 + 20 as varchar(9)) || ' kt, ceiling FL' || cast(k % 300 as varchar(9)) || ', range ' || cast(k % 900 as varchar(9)) || ' nm; it may stall at ' || cast(k % 60 as varchar(9)) || ' mph. \"Lift Drag\" and ''induced drag'' matter.'",
    "'The report, on page ' || cast(k % 50 as varchar(9)) || ', gives AR = ' || cast(k % 45 as varchar(9)) || '.5 and a wing loading of ' || cast(k % 4000 as varchar(9)) || ' N/m2, an L/D of ' || cast(k % 90 as varchar(9)) || ' with ' || cast(k % 700 as varchar(9)) || ' Wh/kg on S1223. The wing {draft} was cut. A low price helps.'",
    "'mass_kg: ' || cast(k % 3 as varchar(9)) || ' payload_kg: ' || cast(k % 40 as varchar(9)) || ' range_km: ' || cast(k % 800 as varchar(9)) || ' endurance_hr: ' || cast(k % 9 as varchar(9)) || ' cruise_speed_ms: ' || cast(k % 2 * (k % 220) as varchar(9)) || ' at ' || cast(k % 220 as varchar(9)) || ' km/h'",
)
REQUEST = f"CASE k % 4 WHEN 0 THEN {_KINDS[0]} WHEN 1 THEN {_KINDS[1]} WHEN 2 THEN {_KINDS[2]} ELSE {_KINDS[3]} END"


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select((F.col("o_orderkey") * 7919 % 1_000_003).alias("k"), "o_orderkey")
    return orders.select("o_orderkey", F.expr(REQUEST.replace("\\", "").replace("''", "\\'")).alias("text"))


def request_question_type(spark: SparkSession, sf: str) -> DataFrame:
    return _requests(spark, sf).groupBy(T.question_type(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


def definition_requests(spark: SparkSession, sf: str) -> DataFrame:
    """What the cleaned requests that ask for a definition ask for."""
    cleaned = _requests(spark, sf).select("o_orderkey", T.definition_term(F.regexp_replace(F.lower("text"), "^please ", "")).alias("term"))
    return cleaned.filter("term is not null")


def request_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return _requests(spark, sf).select("o_orderkey", F.array_join(T.keywords(F.col("text")), "|").alias("keywords"))


def section_named(spark: SparkSession, sf: str) -> DataFrame:
    """The section that each request is about, and all that it names."""
    t = F.col("text")
    return _requests(spark, sf).select("o_orderkey", X.section_name(t).alias("section"), F.array_join(X.section_names(t), ",").alias("sections"))


def flow_parameters(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    rows = _requests(spark, sf).filter(X.gives_flow(t))
    return rows.select("o_orderkey", *[X.flow_parameter(t, name).alias(name.lower()) for name in X.FLOW_DEFAULTS])


def unit_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities that requests give in other units than SI."""
    t = F.col("text")
    got = _requests(spark, sf).select("o_orderkey", *[F.round(X.in_si(t, name), 6).alias(name) for name in X.UNITS], F.round(X.stall_speed(t), 6).alias("stall_speed_ms"))
    return got.dropna(how="all", subset=[*X.UNITS, "stall_speed_ms"])


def reference_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """Design numbers that requests give, within the ranges that are believed."""
    t = F.col("text")
    return _requests(spark, sf).select("o_orderkey", *[X.reference_number(t, name).alias(name) for name in X.REFERENCE_NUMBERS]).dropna(how="all", subset=list(X.REFERENCE_NUMBERS))


def specification_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Specifications with overridden units and what follows where a field is missing."""
    rows = _requests(spark, sf).filter(F.col("text").startswith("mass_kg"))
    fields = X.specification(F.col("text"))
    return rows.select("o_orderkey", *[F.round(fields[name], 6).alias(name) for name in ("mass_kg", "cruise_speed_ms", "range_km", "altitude_m")])


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    return _requests(spark, sf).select(X.section_name(F.col("text")).alias("name")).distinct()


def section_contours(spark: SparkSession, sf: str) -> DataFrame:
    """Thickness, camber and closing gap of every named 4- or 5-digit section, as a prepared contour."""
    names = checkpointed(_sections(spark, sf))
    sections = checkpointed(design.naca4(names, 50).unionByName(design.naca5(names, 50)))
    prepared = design.prepared(checkpointed(design.contour(sections)))
    got = prepared.groupBy("name").agg(
        F.count("*").alias("n_points"), F.round(F.min("x"), 6).alias("x_min"), F.round(F.max("x"), 6).alias("x_max"), F.round(F.max("y"), 5).alias("y_max"), F.round(F.min("y"), 5).alias("y_min")
    )
    return got


QUERIES = {
    f.__name__: f
    for f in (
        request_question_type, definition_requests, request_keywords, section_named, flow_parameters, unit_overrides, reference_parameters, specification_fields, section_contours,
    )
}

_TEXTS = f"t AS (SELECT o_orderkey, {REQUEST.replace(chr(92), '')} AS text FROM (SELECT o_orderkey, o_orderkey * 7919 % 1000003 AS k FROM orders))"
_STOP = ", ".join(f"'{w.replace(chr(39), chr(39) * 2)}'" for w in T.STOP_WORDS)
_KIND = " ".join(f"WHEN regexp_matches(lower(text), '\\b(?:{'|'.join(words)})\\b') THEN '{kind}'" for kind, words in T.QUESTION_WORDS.items())


def _number(pattern: str) -> str:
    return f"try_cast(nullif(regexp_extract(lower(text), '{pattern}', 1), '') AS DOUBLE)"


def _unit(units: str) -> str:
    return _number(rf"({X.NUMBER}) *(?:{units})(?:[^a-z0-9/]|$)")


def _si(name: str) -> str:
    parts = [f"{_unit(units)} * {factor!r}" for units, factor in X.UNITS[name]]
    return f"coalesce({', '.join(([_number('\\bfl *([0-9]+)') + ' * 30.48'] if name == 'altitude_m' else []) + parts)})"


_STALL = rf"stall[^.]{{0,40}}?({X.NUMBER}) *(km/h|kph|kts?|knots?|mph)"
_STALL_SQL = f"{_number(_STALL)} * CASE WHEN regexp_extract(lower(text), '{_STALL}', 2) IN ('km/h', 'kph') THEN 1 / 3.6 WHEN regexp_extract(lower(text), '{_STALL}', 2) = 'mph' THEN 0.44704 ELSE 0.51444 END"
_FLOW = r"(?i)(Re|V|c|Mach|Ncrit)[ \t]*[=:]?[ \t]*([0-9.eE+-]+)"


def _flow(name: str) -> str:
    pairs = f"list_zip(regexp_extract_all(text, '{_FLOW}', 1), regexp_extract_all(text, '{_FLOW}', 2))"
    return f"coalesce(try_cast(list_filter({pairs}, lambda x: lower(x[1]) = '{name.lower()}')[-1][2] AS DOUBLE), {X.FLOW_DEFAULTS[name]}) AS {name.lower()}"


def _gated(name: str) -> str:
    patterns, least, most = X.REFERENCE_NUMBERS[name]
    return f"coalesce({', '.join(f'CASE WHEN {_number(p)} BETWEEN {least} AND {most} THEN {_number(p)} END' for p in patterns)}) AS {name}"


_FIELD = lambda name: _number(rf'{name}[":\s]+({X.NUMBER})')

_P5 = "(substring(name, 6, 1)::DOUBLE / 20)"
_PLACES = sorted(design.MEAN_LINES)
_K1 = " ".join(
    f"WHEN {_P5} BETWEEN {a} AND {b} THEN {design.MEAN_LINES[a]} + ({_P5} - {a}) / ({b} - {a}) * ({design.MEAN_LINES[b]} - {design.MEAN_LINES[a]})" for a, b in zip(_PLACES, _PLACES[1:])
)

ORACLE = {
    "section_contours": f"""
        WITH {_TEXTS}, b AS (SELECT replace(lower(text), ' ', '') AS bare FROM t),
        s AS (SELECT DISTINCT coalesce('naca' || nullif(regexp_extract(bare, 'naca([0-9]{{4,5}})', 1), ''), nullif(regexp_extract(bare, '\\b([a-z]{{1,3}}[0-9]{{3,5}})\\b', 1), '')) AS name FROM b),
        x AS (SELECT i, i / 49.0 AS x FROM range(0, 50) r(i)),
        four AS (SELECT name, i, x, substring(name, 5, 1)::DOUBLE / 100 AS m, substring(name, 6, 1)::DOUBLE / 10 AS p, substring(name, 7, 2)::DOUBLE / 100 AS t FROM s, x WHERE regexp_matches(name, '^naca[0-9]{{4}}$')),
        five AS (SELECT name, i, x, CASE {_K1} END AS k, {_P5} AS p, substring(name, 8, 2)::DOUBLE / 100 AS t FROM s, x WHERE regexp_matches(name, '^naca[0-9]{{2}}[02-9][0-9]{{2}}$')),
        lines AS (
            SELECT name, i, x, t, CASE WHEN m = 0 OR p = 0 THEN 0 WHEN x < p THEN m / (p * p) * (2 * p * x - x * x) ELSE m / ((1 - p) * (1 - p)) * (1 - 2 * p + 2 * p * x - x * x) END AS c,
                CASE WHEN m = 0 OR p = 0 THEN 0 WHEN x < p THEN 2 * m / (p * p) * (p - x) ELSE 2 * m / ((1 - p) * (1 - p)) * (p - x) END AS d FROM four
            UNION ALL
            SELECT name, i, x, t, CASE WHEN x < p THEN k / 6 * (x ** 3 - 3 * p * x * x + p * p * (3 - p) * x) ELSE k * p ** 3 / 6 * (1 - x) END,
                CASE WHEN x < p THEN k / 6 * (3 * x * x - 6 * p * x + p * p * (3 - p)) ELSE -k * p ** 3 / 6 END FROM five WHERE k IS NOT NULL
        ),
        h AS (SELECT *, 5 * t * (0.2969 * sqrt(x) - 0.126 * x - 0.3516 * x ** 2 + 0.2843 * x ** 3 - 0.1015 * x ** 4) AS h, atan(d) AS a FROM lines),
        c AS (SELECT name, -i AS seq, x - h * sin(a) AS x, c + h * cos(a) AS y FROM h UNION ALL SELECT name, i, x + h * sin(a), c - h * cos(a) FROM h WHERE i > 0),
        k AS (SELECT name, seq, x, y FROM (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM c WINDOW w AS (PARTITION BY name ORDER BY seq)) WHERE step IS NULL OR step > 1e-10),
        e AS (SELECT name, arg_min(x, seq) AS x0, arg_min(y, seq) AS y0, arg_max(x, seq) AS x1, arg_max(y, seq) AS y1, min(x) AS lo, max(x) AS hi FROM k GROUP BY name),
        f AS (SELECT name, x, y FROM k UNION ALL SELECT name, x0, y0 FROM e WHERE sqrt((x0 - x1) ** 2 + (y0 - y1) ** 2) > 1e-6)
        SELECT f.name, count(*) AS n_points, round(min((x - lo) / (hi - lo)), 6) AS x_min, round(max((x - lo) / (hi - lo)), 6) AS x_max, round(max(y / (hi - lo)), 5) AS y_max, round(min(y / (hi - lo)), 5) AS y_min
        FROM f JOIN e ON f.name = e.name GROUP BY f.name
    """,
    "request_question_type": f"WITH {_TEXTS} SELECT CASE {_KIND} ELSE 'general' END AS kind, count(*) AS n FROM t GROUP BY 1",
    "definition_requests": f"""
        WITH {_TEXTS}, c AS (SELECT o_orderkey, regexp_replace(lower(text), '^please ', '') AS q FROM t)
        SELECT o_orderkey, trim(regexp_replace(q, '^(?:{"|".join(T.DEFINITION_OPENINGS)})', '')) AS term FROM c WHERE regexp_matches(q, '^(?:{"|".join(T.DEFINITION_OPENINGS)})')
    """,
    "request_keywords": f"""
        WITH {_TEXTS}, w AS (SELECT o_orderkey, regexp_extract_all(text, '"[^"\\n]+"|''[^''\\n]+''|[^ \\t\\n\\r\\f]+') AS w FROM t)
        SELECT o_orderkey, array_to_string(list_transform(list_filter(w, lambda x: regexp_matches(x, '^("[^"]+"|''[^'']+'')$') OR lower(x) NOT IN ({_STOP})),
            lambda x: CASE WHEN regexp_matches(x, '^("[^"]+"|''[^'']+'')$') THEN x[2:-2] ELSE lower(x) END), '|') AS keywords FROM w
    """,
    "section_named": f"""
        WITH {_TEXTS}, b AS (SELECT o_orderkey, lower(text) AS low, replace(lower(text), ' ', '') AS bare FROM t)
        SELECT o_orderkey,
            coalesce('naca' || nullif(regexp_extract(bare, 'naca([0-9]{{4,5}})', 1), ''), nullif(regexp_extract(bare, '\\b([a-z]{{1,3}}[0-9]{{3,5}})\\b', 1), '')) AS section,
            array_to_string(list_filter(list_transform(regexp_extract_all(low, '{"|".join(X.SECTION_NAMES)}'), lambda x: replace(x, ' ', '')), lambda x, i: length(x) >= 4)[:6], ',') AS sections FROM b
    """,
    "flow_parameters": f"""
        WITH {_TEXTS} SELECT o_orderkey, {', '.join(map(_flow, X.FLOW_DEFAULTS))} FROM t
        WHERE regexp_matches(text, '[0-9]') AND list_has_any(regexp_extract_all(lower(text), '[a-z/=:]+'), [{', '.join(f"'{w}'" for w in X.FLOW_WORDS)}])
    """,
    "unit_overrides": f"""
        WITH {_TEXTS}, u AS (SELECT o_orderkey, {', '.join(f'round({_si(name)}, 6) AS {name}' for name in X.UNITS)}, round({_STALL_SQL}, 6) AS stall_speed_ms FROM t)
        SELECT * FROM u WHERE coalesce({', '.join(X.UNITS)}, stall_speed_ms) IS NOT NULL
    """,
    "reference_parameters": f"""
        WITH {_TEXTS}, r AS (SELECT o_orderkey, {', '.join(map(_gated, X.REFERENCE_NUMBERS))} FROM t) SELECT * FROM r WHERE coalesce({', '.join(X.REFERENCE_NUMBERS)}) IS NOT NULL
    """,
    "specification_fields": f"""
        WITH {_TEXTS}, f AS (SELECT o_orderkey, coalesce({_si('mass_kg')}, {_FIELD('mass_kg')}, 0) AS m, coalesce({_FIELD('payload_kg')}, 0) AS p, coalesce({_si('range_km')}, {_FIELD('range_km')}, 0) AS r,
            coalesce({_FIELD('endurance_hr')}, 0) AS e, coalesce({_si('cruise_speed_ms')}, {_FIELD('cruise_speed_ms')}, 0) AS v, coalesce({_si('altitude_m')}, {_FIELD('altitude_m')}, 0) AS a, {_unit('km/h|kph')} AS kmh
            FROM t WHERE starts_with(text, 'mass_kg')),
        s AS (SELECT *, CASE WHEN v > 0 THEN v WHEN r > 0 AND e > 0 THEN r / e / 3.6 ELSE 0 END AS w FROM f)
        SELECT o_orderkey, round(CASE WHEN m > 0 THEN m ELSE p * 4 END, 6) AS mass_kg, round(CASE WHEN w > 150 AND abs(w - kmh) < 5 THEN kmh / 3.6 ELSE w END, 6) AS cruise_speed_ms,
            round(r, 6) AS range_km, round(CASE WHEN a > 0 THEN a ELSE 500 END, 6) AS altitude_m FROM s
    """,
}
