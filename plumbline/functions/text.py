"""Names, quantities and sentences: normalised words, roles, numbers with units, templates, counts in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mean another, words that say nothing in a name, and the words of each role: fixed values.
ALIASES = {"sofa": "couch", "settee": "couch", "bin": "basket", "washbasin": "sink", "lavatory": "sink", "wc": "toilet"}
STOPS = ("a", "an", "the", "of", "with", "and")
ROLES = {
    "counter": ("counter", "desk", "till"), "door": ("door", "entrance"), "dining": ("table", "booth"), "seat": ("chair", "stool", "bench"), "control": ("switch", "outlet", "thermostat"),
    "kiosk": ("kiosk", "terminal"), "ramp": ("ramp",), "handrail": ("handrail",), "sink": ("sink", "basin"), "mirror": ("mirror",), "bar": ("grab bar",), "toilet": ("toilet", "wc"),
}
#: Units as texts write them, in metres: fixed values.
UNITS = {"mm": 0.001, "cm": 0.01, "m": 1.0, "in": 0.0254, "inch": 0.0254, "inches": 0.0254, "ft": 0.3048, "foot": 0.3048, "feet": 0.3048}
QUANTITY = r"(\d+(?:\.\d+)?)\s*(mm|cm|m|inches|inch|in|feet|foot|ft)\b"


def _mapped(values: dict) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])


def words(name: Column) -> Column:
    """Sorted distinct words of a name: lower case, marks as spaces, aliases in place, stop words left out."""
    plain = F.filter(F.split(F.lower(F.regexp_replace(name, r"[-_/,.]+", " ")), r"\s+"), lambda w: (w != "") & ~w.isin(*STOPS))
    return F.array_sort(F.array_distinct(F.transform(plain, lambda w: F.coalesce(F.try_element_at(_mapped(ALIASES), w), w))))


def agree(a: Column, b: Column) -> Column:
    """Whether one of two arrays of words, neither empty, holds all of the other."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))


def roles(label: Column) -> Column:
    """Every role, in order of its name, one of whose words is part of the label."""
    fits = [F.when(F.greatest(*[F.contains(F.lower(label), F.lit(w)) for w in (*some, some[0])]), F.lit(role)) for role, some in sorted(ROLES.items())]
    return F.array_compact(F.array(*fits))


def quantities(text: Column) -> Column:
    """Every number with a unit in a whole text, in order, as structs of value, unit and metres."""
    found = F.arrays_zip(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(QUANTITY), F.lit(1)).alias("v"), F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(QUANTITY), F.lit(2)).alias("u"))
    value = lambda x: x["v"].cast("double")
    return F.transform(found, lambda x: F.struct(value(x).alias("value"), x["u"].alias("unit"), (value(x) * F.try_element_at(_mapped(UNITS), x["u"])).alias("metres")))


def filled(template: Column, values: dict[str, Column], verdicts: dict[str, Column] | None = None) -> Column:
    """A sentence with {hole} in place of each value and {verdict?this|that} chosen; a null value leaves no sentence."""
    out = template
    for name, flag in (verdicts or {}).items():
        out = F.regexp_replace(out, F.lit(rf"\{{{name}\?([^|}}]*)\|([^}}]*)\}}"), F.when(flag, F.lit("$1")).otherwise(F.lit("$2")))
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value.cast("string"))
    return out


def plural(n: Column, one: str, many: str) -> Column:
    """A count and its noun."""
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many))


def listed(items: Column) -> Column:
    """Items as `a`, `a and b`, or `a, b and c`; of none, null."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 1, items[0]).when(n > 1, F.concat(head, F.lit(" and "), F.element_at(items, -1)))


def feet_and_inches(inches: Column) -> Column:
    """Whole inches in words: inches below two feet, feet and inches from there on."""
    whole = F.bround(inches, 0).cast("long")
    feet, rest = F.floor(whole / 12), whole % 12
    return F.when(whole < 24, plural(whole, "inch", "inches")).when(rest == 0, plural(feet, "foot", "feet")).otherwise(F.concat_ws(" ", plural(feet, "foot", "feet"), plural(rest, "inch", "inches")))
