"""What an answer may say: figures that a question or a scan can account for, and things that are there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers as words; scales between what is said and metres; how far a figure may be off: fixed values.
WORDS = {
    "a": 1.0, "an": 1.0, "one": 1.0, "two": 2.0, "three": 3.0, "four": 4.0, "five": 5.0, "six": 6.0, "seven": 7.0, "eight": 8.0, "nine": 9.0, "ten": 10.0,
    "half": 0.5, "quarter": 0.25, "twelve": 12.0, "twenty": 20.0, "thirty": 30.0,
}
SCALES = (1.0, 0.01, 0.001, 0.0254, 0.3048)
SHARE, LEAST = 0.02, 1e-6
NUMBER = r"\d+(?:\.\d+)?"


def figures(text: Column) -> Column:
    """All numbers in digits of a whole text, as doubles; of null none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))


def stated(text: Column) -> Column:
    """All numbers that a whole text states, in digits or words; two number words in a row also multiply."""
    value = F.create_map(*[x for w, v in WORDS.items() for x in (F.lit(w), F.lit(v))])
    said = F.transform(F.filter(F.split(F.lower(F.translate(F.coalesce(text, F.lit("")), "-", " ")), r"\s+"), lambda w: w != ""), lambda w: F.try_element_at(value, w))
    both = F.zip_with(F.slice(said, 1, F.greatest(F.size(said) - 1, F.lit(0))), F.slice(said, 2, F.greatest(F.size(said) - 1, F.lit(1))), lambda a, b: a * b)
    return F.concat(figures(text), F.array_compact(said), F.array_compact(both))


def accounted(value: Column, known: Column) -> Column:
    """Whether one of the known numbers is the value, at any scale."""
    close = lambda n: F.exists(F.array(*[F.lit(s) for s in SCALES]), lambda s: F.abs(value - n * s) <= F.greatest(F.abs(value) * SHARE, F.lit(LEAST)))
    return F.exists(known, close)


def invented(text: Column, known: Column) -> Column:
    """The figures of a whole text that no known number accounts for."""
    return F.filter(F.array_distinct(figures(text)), lambda v: ~accounted(v, known))
