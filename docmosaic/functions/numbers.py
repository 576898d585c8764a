"""Numbers, dates and grading rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import holds_gold, neutralize, norm, text

# Fixed values.
MONTHS = "january february march april may june july august september october november december".split()
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10, "1st": 1, "2nd": 2, "3rd": 3, "4th": 4, "5th": 5}
UNDATED = "9999-99-99"
NUMBER = r"\d[\d.,]*\d|\d"
DECLARED_EDGES = {"amends": "AMENDS", "supersedes": "SUPERSEDES", "novates": "NOVATES"}


def to_number(t: Column) -> Column:
    """One numeric token; a comma is a decimal sign only alone and before other than three digits."""
    comma, dot = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
    decimal = comma & ~dot & (F.size(F.split(t, ",")) == 2) & (F.length(F.element_at(F.split(t, ","), -1)) != 3)
    return F.when(decimal, F.replace(t, F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit(""))).try_cast("double")


def numbers(c: Column) -> Column:
    """All numbers of a text, in order."""
    return F.filter(F.transform(F.regexp_extract_all(text(c), F.lit(NUMBER), F.lit(0)), to_number), lambda x: x.isNotNull())


def signed_numbers(c: Column) -> Column:
    """Numbers with their sign; commas before three digits are grouping, others decimal signs."""
    t = F.replace(F.regexp_replace(neutralize(c), r"(?<=\d),(?=\d{3}(?:\D|$))", ""), F.lit(","), F.lit("."))
    return F.transform(F.regexp_extract_all(t, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))


def close(a: Column, b: Column) -> Column:
    """Within 1 % or 1e-6."""
    return F.abs(a - b) <= F.greatest(F.lit(1e-6), 0.01 * F.greatest(F.abs(a), F.abs(b)))


def iso_date(c: Column) -> Column:
    """The first YYYY-MM-DD, else the first "D Month YYYY", as text; not validated as a calendar date."""
    x = text(c)
    iso = F.regexp_extract(x, r"(\d{4}-\d{2}-\d{2})", 1)
    dmy = r"(?i)(\d{1,2})\s+(" + "|".join(MONTHS) + r")\s+(\d{4})"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(x, dmy, 2)))
    made = F.concat_ws("-", F.regexp_extract(x, dmy, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(x, dmy, 1), 2, "0"))
    return F.when(iso != "", iso).when(x.rlike(dmy), made)


def ordinal(c: Column) -> Column:
    """The first ordinal word a text holds, in list order; 0 for none and for base documents."""
    t = norm(c)
    out = F.when(t.isin("", "none", "not stated", "standalone", "na", "n/a", "base"), 0)
    for w, n in ORDINALS.items():
        out = out.when(F.contains(t, F.lit(w)), n)
    return out.otherwise(0)


def best_date(effective: Column, declared: Column, document: Column, graph: Column) -> Column:
    """The date that places a document in its chain."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (effective, declared, document, graph)), F.lit(UNDATED))


def declared_edge(c: Column, edges: dict[str, str] = DECLARED_EDGES) -> Column:
    """The edge that a relation word means, null for others."""
    out = F.lit(None).cast("string")
    for w, e in edges.items():
        out = F.when(norm(c) == w, e).otherwise(out)
    return out


def verification_boost(verified: Column, disputed: Column, votes: Column) -> Column:
    """+0.05 and 0.01 per vote (five at most) for what people verified, -0.05 for what is disputed."""
    return F.when(disputed, -0.05).when(verified, 0.05 + 0.01 * F.least(votes, F.lit(5))).otherwise(0.0)


def present(c: Column) -> Column:
    """PF18: neither empty nor "Not Stated"."""
    return ~norm(c).isin("", "not stated")


def value_matches(kind: Column, gold: Column, found: Column) -> Column:
    """Whether the found values (array) say what gold says: numbers by value, vocabularies exactly, other texts by containment."""
    first = F.get(signed_numbers(gold), F.lit(0))
    every = F.flatten(F.transform(found, signed_numbers))
    alike = F.exists(found, lambda v: holds_gold(gold, v))
    number = F.when(first.isNull(), alike).otherwise(F.exists(every, lambda x: close(first, x)))
    exact = F.exists(found, lambda v: norm(v) == norm(gold))
    return F.when(kind.isin("enum", "presence_enum"), exact).when(kind.isin("value", "number"), number).otherwise(alike)


def outcome(kind: Column, gold: Column, found: Column) -> Column:
    """Correct, wrong, missed, hallucinated, or correct_abstention where neither side states a value."""
    stated = F.filter(found, present)
    has_gold, has = present(gold), F.size(stated) > 0
    return F.when(~has_gold & ~has, "correct_abstention").when(~has_gold, "hallucinated").when(~has, "missed").when(value_matches(kind, gold, stated), "correct").otherwise("wrong")


def field_status(n_values: Column, conflict: Column, has_evidence: Column, judged: Column) -> Column:
    """N12, AG15: red for a conflict or a value without evidence, grey for none, yellow for types that need judgement, else green."""
    return F.when(conflict, "red").when(n_values == 0, "grey").when(~has_evidence, "red").when(judged, "yellow").otherwise("green")


def machine_digest(values: Column) -> Column:
    """Sorted values, one per line."""
    return F.array_join(F.array_sort(values), "\n")
