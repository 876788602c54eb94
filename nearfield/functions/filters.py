"""Payload filters: build, check, combine, and compile to a Column.

A filter is a dict of up to three lists, ``must``, ``should`` and ``must_not``.
Each entry names a ``key`` and has either ``match: {value}`` or
``range: {gte, lte, gt, lt}``.  A row passes if all of ``must``, at least one of
a non-empty ``should``, and none of ``must_not`` hold.  A missing or NULL key
makes an entry false, so ``must_not`` keeps such rows.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Filter = dict[str, list[dict[str, Any]]]
Value = str | int | float | bool

CLAUSES = ("must", "should", "must_not")
BOUNDS = {"gte": operator.ge, "lte": operator.le, "gt": operator.gt, "lt": operator.lt}
DOC_KEY = "doc_id"


# --- builders ---------------------------------------------------------------


def _entries(key: str, values: Iterable[Value]) -> list[dict[str, Any]]:
    return [{"key": key, "match": {"value": value}} for value in values]


def match(key: str, value: Value) -> Filter:
    return {"must": _entries(key, [value])}


def range_(key: str, **bounds: float) -> Filter:
    return {"must": [{"key": key, "range": bounds}]}


def any_of(key: str, values: Iterable[Value]) -> Filter:
    return {"should": _entries(key, values)}


def none_of(key: str, values: Iterable[Value]) -> Filter:
    return {"must_not": _entries(key, values)}


def metadata(pairs: Mapping[str, Value]) -> Filter:
    return {"must": [entry for key, value in pairs.items() for entry in _entries(key, [value])]}


def for_doc(doc_id: Value, key: str = DOC_KEY) -> Filter:
    return match(key, doc_id)


def not_docs(doc_ids: Iterable[Value], key: str = DOC_KEY) -> Filter:
    return none_of(key, doc_ids)


def _merge(filters: Iterable[Filter], target: str) -> Filter:
    filters = list(filters)
    merged = {
        target: [entry for f in filters for clause in ("must", "should") for entry in f.get(clause) or []],
        "must_not": [entry for f in filters for entry in f.get("must_not") or []],
    }
    return {clause: entries for clause, entries in merged.items() if entries}


def combine_and_flat(*filters: Filter) -> Filter:
    """One flat filter in which every ``must`` *and every ``should``* entry is required.

    An any-of list thus becomes all-of; for a strict AND, combine compiled Columns with ``&``.
    """
    return _merge(filters, "must")


def combine_or_flat(*filters: Filter) -> Filter:
    """One flat filter in which any ``must`` or ``should`` entry suffices; ``must_not`` lists add up.

    For a strict OR, combine compiled Columns with ``|``.
    """
    return _merge(filters, "should")


# --- validation -------------------------------------------------------------


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _entry_problems(entry: Any) -> list[str]:
    if not isinstance(entry, Mapping):
        return ["not an object"]
    problems = []
    if not (isinstance(entry.get("key"), str) and entry["key"]):
        problems.append("'key' must be a non-empty string")
    if ("match" in entry) == ("range" in entry):
        problems.append("exactly one of 'match' and 'range' is needed")
    if "match" in entry:
        body = entry["match"]
        if not isinstance(body, Mapping):
            problems.append("'match' must be an object")
        elif not isinstance(body.get("value"), (str, int, float, bool)):
            problems.append("'match' needs a string, number or boolean 'value'")
    if "range" in entry:
        body = entry["range"]
        if not isinstance(body, Mapping):
            problems.append("'range' must be an object")
        elif not body:
            problems.append(f"'range' needs at least one of {', '.join(BOUNDS)}")
        else:
            problems += [f"unknown bound '{name}'" for name in body if name not in BOUNDS]
            problems += [
                f"bound '{name}' must be a number" for name, v in body.items() if name in BOUNDS and not _is_number(v)
            ]
    return problems


def problems(spec: Any) -> list[str]:
    """Everything wrong with a filter; empty for a valid one."""
    if not isinstance(spec, Mapping):
        return ["a filter must be an object"]
    found = [f"unknown clause '{name}'; use {', '.join(CLAUSES)}" for name in spec if name not in CLAUSES]
    for clause in CLAUSES:
        entries = spec.get(clause)
        if entries is None:
            continue
        if not isinstance(entries, (list, tuple)):
            found.append(f"'{clause}' must be a list")
            continue
        found += [f"{clause}[{i}]: {text}" for i, entry in enumerate(entries) for text in _entry_problems(entry)]
    return found


def check(spec: Any) -> None:
    found = problems(spec)
    if found:
        raise ValueError("invalid filter: " + "; ".join(found))


# --- compilation ------------------------------------------------------------


def _lookup(key: str, schema: T.StructType, variant: str | None) -> tuple[Column, T.DataType] | None:
    """The column a key names: a top-level name, a dotted struct path, or a path in the variant column."""
    if key in schema.names:
        return F.col(f"`{key}`"), schema[key].dataType
    column, current = None, schema
    for part in key.split("."):
        if not isinstance(current, T.StructType) or part not in current.names:
            column = None
            break
        column = F.col(f"`{part}`") if column is None else column.getField(part)
        current = current[part].dataType
    if column is not None:
        return column, current
    if variant and variant in schema.names and isinstance(schema[variant].dataType, T.VariantType):
        path = "$" + "".join(f"['{part}']" for part in key.split("."))
        return F.try_variant_get(F.col(f"`{variant}`"), path, "variant"), schema[variant].dataType
    return None


#: A struct of payload keys that stand as typed columns beside a variant column has its name and this.
SHREDDED = "_keys"


def shred(df, keys: Mapping[str, str], *, variant: str = "payload"):
    """``df`` with the named keys of its free payload as typed columns too, in a struct beside it.

    ``keys`` gives ``string``, ``double`` or ``boolean`` for each.  A value of another kind is NULL there.  Filters on
    these keys compare plain columns, which the scan of a stored table checks against its row groups, and leave the
    payload itself unread.
    """
    kinds = {"string": "string", "double": "number", "boolean": "bool"}
    if unknown := [kind for kind in keys.values() if kind not in kinds]:
        raise ValueError(f"unknown kind '{unknown[0]}'; use {', '.join(kinds)}")

    def typed(key: str, kind: str) -> Column:
        value = F.try_variant_get(F.col(f"`{variant}`"), "$" + "".join(f"['{part}']" for part in key.split(".")), "variant")
        return F.when(F.schema_of_variant(value).rlike(_VARIANT_KINDS[kinds[kind]]), F.try_variant_get(value, "$", kind))

    return df.withColumn(variant + SHREDDED, F.struct(*[typed(key, kind).alias(key) for key, kind in keys.items()]))


def _holds(entry: Mapping[str, Any], column: Column, dtype: T.DataType) -> Column | None:
    """The entry as a comparison on ``column``; None where the types can never agree."""
    if isinstance(dtype, T.ArrayType):
        inner = dtype.elementType
        if _holds(entry, F.lit(None), inner) is None:
            return None
        return F.exists(column, lambda element: F.coalesce(_holds(entry, element, inner), F.lit(False)))
    if isinstance(dtype, T.VariantType):
        return _variant_holds(entry, column)
    if "range" in entry:
        if not isinstance(dtype, T.NumericType):
            return None
        return reduce(operator.and_, [BOUNDS[name](column, F.lit(v)) for name, v in entry["range"].items()])
    value = entry["match"]["value"]
    fits = (
        isinstance(dtype, T.BooleanType)
        if isinstance(value, bool)
        else isinstance(dtype, T.NumericType)
        if _is_number(value)
        else isinstance(dtype, T.StringType)
    )
    return column == F.lit(value) if fits else None


# Type names schema_of_variant reports, by the kind of value they hold.
_VARIANT_KINDS = {
    "bool": r"^BOOLEAN$",
    "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "string": r"^STRING$",
}


def _variant_holds(entry: Mapping[str, Any], column: Column) -> Column:
    def typed(kind: str, name: str) -> Column:
        return F.when(
            F.schema_of_variant(column).rlike(_VARIANT_KINDS[kind]), F.try_variant_get(column, "$", name)
        )

    if "range" in entry:
        return _holds(entry, typed("number", "double"), T.DoubleType())
    value = entry["match"]["value"]
    if isinstance(value, bool):
        return typed("bool", "boolean") == F.lit(value)
    if _is_number(value):
        return typed("number", "double") == F.lit(float(value))
    return typed("string", "string") == F.lit(value)


def compile_filter(
    spec: Filter | None, schema: T.StructType, *, variant: str | None = None, as_value: bool = False
) -> Column:
    """One boolean Column for ``where``.

    Plain scalar entries stay plain comparisons, so Catalyst pushes them to the
    scan.  With ``as_value`` the Column is never NULL and can be projected.
    Keys that name no column are looked up in the column ``variant``, or in the
    only one of that type.
    """
    if spec is None:
        return F.lit(True)
    check(spec)
    free = [field.name for field in schema if isinstance(field.dataType, T.VariantType)]
    variant = variant or (free[0] if len(free) == 1 else None)

    beside = f"{variant}{SHREDDED}"
    typed = schema[beside].dataType if variant and beside in schema.names else T.StructType()

    def look_up(entry: Mapping[str, Any]) -> tuple[Column, T.DataType] | None:
        """Where an entry's key is; a typed column beside the payload, if the entry is of its kind."""
        found = _lookup(entry["key"], schema, variant)
        if found and isinstance(found[1], T.VariantType) and entry["key"] in typed.names:
            own = F.col(f"`{beside}`").getField(entry["key"]), typed[entry["key"]].dataType
            return own if _holds(entry, *own) is not None else found
        return found

    def positive(entry: Mapping[str, Any]) -> Column:
        found = look_up(entry)
        held = found and _holds(entry, *found)
        return F.lit(False) if held is None else held

    def negative(entry: Mapping[str, Any]) -> Column:
        found = look_up(entry)
        held = found and _holds(entry, *found)
        if held is None:
            return F.lit(True)
        if isinstance(found[1], (T.ArrayType, T.VariantType)):
            return ~F.coalesce(held, F.lit(False))
        return found[0].isNull() | ~held  # same truth table, and pushable

    def alternatives(entries: list[Mapping[str, Any]]) -> Column:
        # Equalities on one scalar key become a single IN.
        by_key: dict[tuple[str, type], list[Any]] = {}
        rest = []
        for entry in entries:
            found = look_up(entry)
            scalar = found and not isinstance(found[1], (T.ArrayType, T.VariantType, T.StructType))
            if "match" in entry and scalar and _holds(entry, *found) is not None:
                by_key.setdefault((entry["key"], type(entry["match"]["value"])), []).append(entry["match"]["value"])
            else:
                rest.append(positive(entry))
        lists = [look_up({"key": key, "match": {"value": values[0]}})[0].isin(values) for (key, _), values in by_key.items()]
        return reduce(operator.or_, lists + rest)

    parts = [positive(entry) for entry in spec.get("must") or []]
    if spec.get("should"):
        parts.append(alternatives(spec["should"]))
    parts += [negative(entry) for entry in spec.get("must_not") or []]
    condition = reduce(operator.and_, parts) if parts else F.lit(True)
    return F.coalesce(condition, F.lit(False)) if as_value else condition


def filter_rows(df, spec: Filter | None, *, variant: str | None = None):
    return df.where(compile_filter(spec, df.schema, variant=variant))


def cells_may_hold(spec: Filter, schema: T.StructType) -> Column:
    """For a row that sums up many (``low_``, ``high_`` and ``seen_`` of a key): false only if none of them can pass ``spec``.

    ``seen_`` has a bit for the hash of each value.  Keys that are not summed up leave everything possible.
    """
    check(spec)

    def possible(entry: Mapping[str, Any]) -> Column:
        key = entry["key"]
        if key not in schema.names or not isinstance(schema[key].dataType, (T.StringType, T.NumericType, T.BooleanType)):
            return F.lit(True)
        dtype = schema[key].dataType
        low, high, seen = (F.col(f"`{what}_{key}`") for what in ("low", "high", "seen"))
        if _holds(entry, low, dtype) is None:
            return F.lit(False)
        if "range" in entry:
            held = [BOUNDS[name](high if name in ("gte", "gt") else low, F.lit(v)) for name, v in entry["range"].items()]
        else:
            value = F.lit(entry["match"]["value"])
            held = [low <= value, value <= high]
            own = value.cast(dtype)
            place = F.pmod(F.xxhash64(own), F.lit(63)).cast("int")
            bit = F.call_function("shiftrightunsigned", seen, place).bitwiseAND(F.lit(1)) == 1
            held.append(bit | (own != value))  # a value that the type cannot hold
        return F.coalesce(reduce(operator.and_, held), F.lit(False))

    parts = [possible(entry) for entry in spec.get("must") or []]
    if spec.get("should"):
        parts.append(reduce(operator.or_, [possible(entry) for entry in spec["should"]]))
    return reduce(operator.and_, parts) if parts else F.lit(True)
