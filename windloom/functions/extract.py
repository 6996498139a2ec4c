"""Names, parameters and quantities read from requests and reference texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[0-9]+(?:\.[0-9]+)?"
#: Words of texts that give flow parameters.
FLOW_WORDS = ("re", "reynolds", "velocity", "v=", "v:", "chord", "c=", "mach", "ncrit", "m/s", "ms", "km/h", "kph")
#: Flow parameters and what they are where a text doesn't give them.
FLOW_DEFAULTS = {"Re": 1e6, "V": 30.0, "c": 1.0, "Mach": 0.0, "Ncrit": 9.0}
#: Patterns of section names.
SECTION_NAMES = (r"\bnaca[ ]*[0-9]{4,5}\b", r"\be[0-9]{3}[a-z]?\b", r"\bs[0-9]{4}[a-z]?\b", r"\bag[0-9]{2}[a-z]?\b", r"\bgoe[0-9]{3}\b", r"\bsd[0-9]{4}\b", r"\bfx[ ]*[0-9]{2}[a-z][0-9]+\b")
#: Units by quantity, in order of trial, with their factor to kg, m/s, m and km.
UNITS = {
    "mass_kg": (("n|newtons?", 1 / 9.81), ("lbs?|pounds?", 1 / 2.20462)),
    "cruise_speed_ms": (("kmh|km/h|kph", 1 / 3.6), ("kts?|knots?", 0.51444), ("mph", 0.44704), ("ft/s|fps", 0.3048)),
    "altitude_m": (("ft|feet", 0.3048),),
    "range_km": (("nm|nautical[ ]+miles?", 1.852), ("mi|miles?", 1.60934)),
}
STALL_UNITS = (("km/h|kph", 1 / 3.6), ("kts?|knots?", 0.51444), ("mph", 0.44704))
#: Design numbers in reference texts, by patterns in order of trial, with the range that is believed.
REFERENCE_NUMBERS = {
    "aspect_ratio": ((rf"\bar *[=:] *({NUMBER})", rf"aspect +ratio +(?:of +)?({NUMBER})"), 3, 40),
    "wing_loading": ((rf"wing +loading +(?:of +)?({NUMBER}) *n/m", rf"w/s *[=:] *({NUMBER})"), 10, 3000),
    "lift_to_drag": ((rf"l/d *(?:max|ratio)? *[=:≈~of]+ *({NUMBER})", rf"lift.to.drag +(?:ratio +)?(?:of +)?({NUMBER})"), 5, 80),
    "battery_density": ((rf"({NUMBER}) *wh/kg", rf"energy +density +(?:of +)?({NUMBER})"), 80, 600),
}
#: Fields of ``key: value`` specifications.
SPECIFICATION = ("mass_kg", "cruise_speed_ms", "range_km", "endurance_hr", "altitude_m", "wing_span_m", "payload_kg", "stall_speed_ms")


def _first(text: Column, pattern: str) -> Column:
    """The number in the first match's group, null without a match."""
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found).try_cast("double")


def section_name(text: Column) -> Column:
    """The section that a request is about: a NACA number, else letters with digits; spaces don't count."""
    bare = F.replace(F.lower(text), F.lit(" "), F.lit(""))
    naca, other = F.regexp_extract(bare, r"naca([0-9]{4,5})", 1), F.regexp_extract(bare, r"\b([a-z]{1,3}[0-9]{3,5})\b", 1)
    return F.when(naca != "", F.concat(F.lit("naca"), naca)).when(other != "", other)


def section_names(text: Column, most: int = 6) -> Column:
    """The first different sections that a text names, in its order, without spaces."""
    found = F.regexp_extract_all(F.lower(text), F.lit("|".join(SECTION_NAMES)), F.lit(0))
    bare = F.transform(found, lambda x: F.replace(x, F.lit(" "), F.lit("")))
    return F.slice(F.array_distinct(F.filter(bare, lambda x: F.length(x) >= 4)), 1, most)


def gives_flow(text: Column) -> Column:
    """Whether a text has a digit and a word of flow parameters."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z/=:]+"), F.lit(0))
    return text.rlike("[0-9]") & F.arrays_overlap(words, F.array(*map(F.lit, FLOW_WORDS)))


def flow_parameter(text: Column, name: str) -> Column:
    """The last value that a text gives for one of ``FLOW_DEFAULTS``, its default where there is none."""
    pattern = r"(?i)(Re|V|c|Mach|Ncrit)[ \t]*[=:]?[ \t]*([0-9.eE+-]+)"
    keys, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
    given = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x: F.lower(x["k"]) == name.lower())
    return F.coalesce(F.try_element_at(given, F.lit(-1))["v"].try_cast("double"), F.lit(FLOW_DEFAULTS[name]))


def quantity(text: Column, units: str, before: str = "") -> Column:
    """The first number that stands before one of ``units`` as a whole, behind ``before``."""
    return _first(F.lower(text), rf"{before}({NUMBER}) *(?:{units})(?:[^a-z0-9/]|$)")


def in_si(text: Column, name: str) -> Column:
    """A quantity given in other units than SI; the first unit in order that the text has counts."""
    parts = [quantity(text, units) * factor for units, factor in UNITS[name]]
    if name == "altitude_m":
        parts.insert(0, _first(F.lower(text), r"\bfl *([0-9]+)") * 30.48)
    return F.coalesce(*parts)


def stall_speed(text: Column) -> Column:
    """The first speed within 40 characters behind "stall", in m/s."""
    found = lambda k: F.regexp_extract(F.lower(text), rf"stall[^.]{{0,40}}?({NUMBER}) *(km/h|kph|kts?|knots?|mph)", k)
    value, unit = F.when(found(1) != "", found(1)).try_cast("double"), found(2)
    return F.when(unit.rlike("^(?:km/h|kph)$"), value / 3.6).when(unit == "mph", value * 0.44704).otherwise(value * 0.51444)


def reference_number(text: Column, name: str) -> Column:
    """A design number of a reference text that lies in the range that is believed."""
    patterns, least, most = REFERENCE_NUMBERS[name]
    values = [_first(F.lower(text), p) for p in patterns]
    return F.coalesce(*[F.when(v.between(least, most), v) for v in values])


def specification(text: Column) -> dict[str, Column]:
    """Fields of a ``key: value`` specification, quantities in other units first, with what follows where one is missing.

    Mass is four times the payload, speed is range by endurance, altitude is 500 m; a speed that is
    the text's km/h is converted.
    """
    own = {name: _first(F.lower(text), rf'{name}[":\s]+({NUMBER})') for name in SPECIFICATION}
    got = {name: F.coalesce(in_si(text, name), value) if name in UNITS else value for name, value in own.items()}
    got["stall_speed_ms"] = F.coalesce(stall_speed(text), own["stall_speed_ms"])
    zero = {name: F.coalesce(value, F.lit(0.0)) for name, value in got.items()}
    mass = F.when(zero["mass_kg"] > 0, zero["mass_kg"]).otherwise(zero["payload_kg"] * 4)
    derived = F.when((zero["range_km"] > 0) & (zero["endurance_hr"] > 0), zero["range_km"] / zero["endurance_hr"] / 3.6).otherwise(0.0)
    speed = F.when(zero["cruise_speed_ms"] > 0, zero["cruise_speed_ms"]).otherwise(derived)
    kmh = quantity(text, "km/h|kph")
    speed = F.when((speed > 150) & (F.abs(speed - kmh) < 5), kmh / 3.6).otherwise(speed)
    altitude = F.when(zero["altitude_m"] > 0, zero["altitude_m"]).otherwise(500.0)
    return zero | {"mass_kg": mass, "cruise_speed_ms": speed, "altitude_m": altitude}
