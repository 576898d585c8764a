"""Row filters of the knowledge layer (PF1-PF26)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed role sets: the query layer and the chat layer differ.
QUERY_ROLES, CHAT_ROLES = ("admin", "confidential"), ("finance", "admin", "confidential")


def in_partition(df: DataFrame, pk: str | None, col: str = "pk") -> DataFrame:
    """PF1, SC2: rows of one partition, all where none is named."""
    return df if pk is None else df.where(F.col(col) == pk)


def in_scope(c: Column, ids: list | None) -> Column:
    """PF2, PF3, PF4: membership in a list; an empty list means everything."""
    return c.isin(ids) if ids else F.lit(True)


def contains_any(c: Column, tokens: list[str]) -> Column:
    """PF5: whether the lower-cased text holds any token; none means false."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(t.lower())) for t in tokens], F.lit(False))


def role_of(role: str | None, known: tuple[str, ...] = ("admin", "confidential", "finance", "general"), default: str = "general") -> str:
    """PF7: a known role, else the default one."""
    r = (role or "").strip().lower()
    return r if r in known else default


def visible(sensitivity: Column, role: str | None, privileged: tuple[str, ...] = QUERY_ROLES) -> Column:
    """PF8, PF9: privileged roles see all; others all but confidential rows. Null counts as general."""
    return F.lit(True) if role_of(role) in privileged else F.coalesce(sensitivity, F.lit("general")) != "confidential"


def span_visible(cites_confidential: Column, role: str | None) -> Column:
    """PF10, PF11: the same for spans and blocks marked confidential."""
    return F.lit(True) if role_of(role) in CHAT_ROLES else ~F.coalesce(cites_confidential, F.lit(False))


def current(c: Column) -> Column:
    """PF13: null counts as current."""
    return F.coalesce(c, F.lit(True))


def candidates(fields: DataFrame, role: str | None = None, ids: list | None = None, superseded: bool = False) -> DataFrame:
    """PF13: field rows in scope that the role may see, current ones only unless superseded."""
    out = fields.where(in_scope(F.col("doc_id"), ids) & visible(F.col("sensitivity"), role, CHAT_ROLES))
    return out if superseded else out.where(current(F.col("is_current")))


def admit(fields: DataFrame, pinned: DataFrame) -> DataFrame:
    """PF12: all rows of pinned documents; of their family's others the current ones, with carried_from set. pinned: doc_id."""
    p = pinned.select(F.col("doc_id").alias("__p")).distinct()
    j = fields.join(p, F.col("doc_id") == F.col("__p"), "left")
    return j.where(F.col("__p").isNotNull() | current(F.col("is_current"))).withColumn("carried_from", F.when(F.col("__p").isNull(), F.col("doc_id"))).drop("__p")


def stale(snapshot: Column, digest: Column) -> Column:
    """PF25: an approval whose snapshot differs from the value now; a null snapshot (or digest) isn't stale."""
    return F.coalesce(snapshot != digest, F.lit(False))


def chain_member(document_type: Column, ancillary: list[str]) -> Column:
    """PF19: not one of the ancillary types."""
    return ~F.coalesce(F.lower(F.trim(document_type)), F.lit("")).isin(ancillary)


def base_candidate(edge: Column, document_type: Column, ancillary: list[str]) -> Column:
    """PF20: no edge of its own and in the chain."""
    return edge.isNull() & chain_member(document_type, ancillary)


def party_supersedable(mechanism: Column, party_key: Column, document_type: Column, ancillary: list[str]) -> Column:
    """PF21: a real party in a chain document."""
    return F.coalesce(mechanism == "party", F.lit(False)) & (F.coalesce(party_key, F.lit("")) != "") & chain_member(document_type, ancillary)
