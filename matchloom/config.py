"""Settings of a comparison, as plain dataclasses, readable from a nested mapping (a parsed YAML or JSON file)."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, fields
from typing import Any

#: Settings that are accepted and have no effect.
IGNORED = frozenset(
    """matching_threshold compare_as_multiset allow_surrogate_keys allow_natural_keys business_key_patterns max_execution_seconds
    strict_length_check strict_precision_scale_check use_existing_mapping_reports reject_unsafe_sql execute_on_answer_db
    use_snapshot_view_definitions enabled student_required""".split()
)


@dataclass
class NameRules:
    """How names of a candidate are resolved to names of the reference."""

    tables: dict[str, list[str]] = field(default_factory=dict)
    columns_global: dict[str, list[str]] = field(default_factory=dict)
    columns_by_table: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    natural_keys: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    abbreviations: dict[str, str] = field(default_factory=dict)
    weak_aliases: tuple[str, ...] = ("ctct", "thanhtoan")
    excluded_tables: tuple[str, ...] = ("sysdiagrams",)
    table_accept: float = 0.90
    table_ambiguous: float = 0.75
    column_accept: float = 0.88
    column_ambiguous: float = 0.75


@dataclass
class TypeRules:
    """Which types of different groups may stand for each other."""

    mode: str = "group_with_warnings"
    warning_score: float = 0.75
    identifier_integer_text: bool = True
    integer_decimal: bool = True
    decimal_float: bool = True
    bit_integer: bool = False
    identifiers: tuple[str, ...] = ()


@dataclass
class KeyRules:
    """How keys are judged: 'exact' or 'adequacy'."""

    mode: str = "adequacy"
    surrogate_patterns: tuple[str, ...] = ("id", "{table}id", "{table}_id")
    business_key_unique: bool = True
    #: child table to parent tables any of whose relationships is accepted in place of the expected one
    accepted_parents: dict[str, tuple[str, ...]] = field(default_factory=dict)


@dataclass
class ViewRules:
    """One expected view: its columns as (name, type, aliases), and how outputs are compared."""

    name: str
    columns: list[tuple[str, str, tuple[str, ...]]]
    sort_by: tuple[str, ...] = ()
    tolerance: float = 0.01
    ordered: bool = False
    column_threshold: float = 0.85


@dataclass
class Rules:
    names: NameRules = field(default_factory=NameRules)
    types: TypeRules = field(default_factory=TypeRules)
    keys: KeyRules = field(default_factory=KeyRules)
    views: list[ViewRules] = field(default_factory=list)


def _fill(cls, given: dict[str, Any]):
    known = {f.name for f in fields(cls)}
    for name in given:
        if name in IGNORED:
            warnings.warn(f"setting {name} has no effect", stacklevel=3)
        elif name not in known:
            raise ValueError(f"unknown setting {name} for {cls.__name__}")
    return cls(**{k: tuple(v) if isinstance(v, list) and k in ("weak_aliases", "excluded_tables", "identifiers", "surrogate_patterns", "sort_by") else v for k, v in given.items() if k in known})


def from_mapping(given: dict[str, Any]) -> Rules:
    """Rules of a nested mapping with the keys names, types, keys and views."""
    views = [
        _fill(ViewRules, {**v, "columns": [(c["canonical"], c.get("type", "text"), tuple(c.get("aliases", ()))) for c in v["columns"]]})
        for v in given.get("views", [])
    ]
    return Rules(_fill(NameRules, given.get("names", {})), _fill(TypeRules, given.get("types", {})), _fill(KeyRules, given.get("keys", {})), views)
