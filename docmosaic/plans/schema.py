"""Domain configuration, compiled on the driver into small dimensions: field schema, vocabularies, tool registry."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import LEGAL_SUFFIXES, PLACEHOLDER_PARTIES, STOPWORDS


def deep_merge(base: dict, over: dict) -> dict:
    """A10: over's values in place of base's, maps merged key by key."""
    return base | {k: deep_merge(base[k], v) if isinstance(base.get(k), dict) and isinstance(v, dict) else v for k, v in over.items()}


def chunks(items: list, n: int) -> Iterable[list]:
    """A11."""
    return (items[i : i + n] for i in range(0, len(items), n))


@dataclass
class Domain:
    """A compiled domain: fields by category, policies and vocabularies."""

    fields: list[dict]
    ancillary: list[str] = field(default_factory=list)
    relations: dict[str, str] = field(default_factory=dict)
    units: list[str] = field(default_factory=list)
    suffixes: list[str] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)

    @classmethod
    def compile(cls, spec: dict, overlay: dict | None = None) -> Domain:
        """Fields of all categories in declared order; an overlay adds, edits (null deletes) and reclassifies them. Raises on unknown types."""
        spec = deep_merge(spec, overlay or {})
        out = []
        for cat, c in spec.get("categories", {}).items():
            for key, f in (c.get("fields") or {}).items():
                if f is None:
                    continue
                kind = f.get("type", "text")
                if kind not in ("value", "number", "text", "enum", "presence_enum", "free_text", "reference"):
                    raise ValueError(f"{cat}.{key}: unknown type {kind}")
                out.append({
                    "full_key": f"{cat}.{key}", "category": cat, "field_key": key, "title": f.get("title", key.replace("_", " ").title()), "type": kind, "multiplicity": int(f.get("multiplicity", 1)),
                    "sensitivity": f.get("sensitivity") or c.get("sensitivity") or "general", "mechanism": f.get("mechanism", "extract"), "role": f.get("role"), "supersedes": bool(c.get("supersedes", True)), "ord": len(out),
                })
        ident = spec.get("identity", {})
        return cls(out, [x.lower() for x in spec.get("ancillary", [])], spec.get("relations", {}), spec.get("units", []), ident.get("legal_suffixes", []), ident.get("canonical_roles", []))

    def table(self, spark: SparkSession) -> DataFrame:
        """The field dimension."""
        return spark.createDataFrame(self.fields, "full_key string, category string, field_key string, title string, type string, multiplicity int, sensitivity string, mechanism string, role string, supersedes boolean, ord int")

    def matchers(self) -> list[dict]:
        """Words of each field's key and title, without plural s."""
        return [{"field": f["full_key"], "words": sorted(fold(f["field_key"] + " " + f["title"]))} for f in self.fields]

    def party_suffixes(self) -> list[str]:
        """Legal suffixes, longest first."""
        return sorted({*LEGAL_SUFFIXES, *(s.strip().lower() for s in self.suffixes)}, key=len, reverse=True)

    def placeholders(self) -> list[str]:
        """Names that are roles, not parties."""
        words = [r.replace("_", " ").lower() for r in self.roles]
        return sorted({*PLACEHOLDER_PARTIES, *words, *(f"the {w}" for w in words)})

    def generic_tokens(self) -> list[str]:
        """Words that name no entity."""
        return sorted({*STOPWORDS, *(w for s in self.party_suffixes() for w in s.split()), *(w for r in self.roles for w in re.findall("[a-z]+", r.lower()))})

    def unit_pattern(self) -> str:
        """Units of the domain, longest first, as one pattern."""
        return "(?i)(" + "|".join(re.escape(u) for u in sorted(self.units, key=len, reverse=True)) + ")"

    def party_roles(self) -> list[str]:
        """Roles that fields play as parties."""
        return sorted({f["role"] for f in self.fields if f["mechanism"] == "party" and f["role"]})

    def missing_roles(self, needed: Iterable[str]) -> list[str]:
        """Structural roles that no field plays."""
        return sorted(set(needed) - {f["role"] for f in self.fields})


def fold(s: str) -> set[str]:
    return {w[:-1] if w.endswith("s") and len(w) > 3 else w for w in re.split("[^a-z0-9]+", s.lower()) if w and w not in STOPWORDS}


def raw_label_map(ontology: dict) -> dict[str, str | None]:
    """Raw label to category."""
    return {raw.lower(): cat for cat, raws in ontology.get("raw_labels", {}).items() for raw in raws}


def endpoint_pairs(ontology: dict, rel: str) -> set[tuple[str, str]]:
    """Label pairs that an edge may join."""
    e = ontology.get("relationships", {}).get(rel, {})
    return {(a, b) for a in e.get("from", []) for b in e.get("to", [])}


def value_bearing(labels: Iterable[str], stems: Iterable[str]) -> list[str]:
    """PF22: labels that hold a stem."""
    p = re.compile("|".join(map(re.escape, stems)), re.I)
    return sorted(x for x in labels if p.search(x))


#: The retrieval tools by name: each takes tables and arguments and returns a DataFrame.
TOOLS: dict[str, Callable[..., DataFrame]] = {}


def tool(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    TOOLS[f.__name__] = f
    return f


def call(name: str, /, **args) -> DataFrame:
    """Run a tool; unknown names and arguments raise."""
    if name not in TOOLS:
        raise KeyError(f"no tool named {name}")
    return TOOLS[name](**args)
