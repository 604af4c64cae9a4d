"""State expressions and scalar functions as columns.

An expression is a nested list: ``["state", "a.b"]``, ``["if", c, x, y]``, ``["and", …]``, ``["or", …]``, ``["not", x]``
and the comparisons; anything else is a literal. Kinds are checked when the column is built; only what depends on a
row's values fails at run time, and only in the branch that the row takes. Equality is strict about kinds (1 isn't 1.0),
order compares any two numbers as doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ExpressionError(ValueError):
    pass


def _kind(t: T.DataType) -> str:
    whole = isinstance(t, T.IntegralType) or (isinstance(t, T.DecimalType) and t.scale == 0)
    return "bool" if isinstance(t, T.BooleanType) else "text" if isinstance(t, T.StringType) else "int" if whole else "float" if isinstance(t, T.NumericType) else t.simpleString()


def _type_at(schema: T.StructType, path: str) -> T.DataType:
    at: T.DataType = schema
    for part in path.split("."):
        if isinstance(at, T.StructType) and part in at.names:
            at = at[part].dataType
        elif isinstance(at, T.ArrayType) and part.isdigit():
            at = at.elementType
        elif isinstance(at, T.MapType):
            at = at.valueType
        else:
            raise ExpressionError(f"no {part} in {path}")
    return at


def _at(path: str) -> Column:
    first, *rest = path.split(".")
    out = F.col(f"`{first}`")
    for part in rest:
        out = out[int(part)] if part.isdigit() else out[part]
    return out


def compile_expression(e, schema: T.StructType, strict: bool = True) -> tuple[Column, str]:
    """The column of an expression over rows of ``schema``, and its kind.

    ``strict``: a value that isn't there fails the job; otherwise the result is null for the row.
    """
    if not isinstance(e, list) or not e or not isinstance(e[0], str):
        kind = "bool" if isinstance(e, bool) else "text" if isinstance(e, str) else "int" if isinstance(e, int) else "float" if isinstance(e, float) else "nil"
        return F.lit(e), kind
    op, args = e[0], e[1:]
    if op == "state":
        kind = _kind(_type_at(schema, args[0]))
        value = _at(args[0])
        if not strict:
            return value, kind
        return F.when(value.isNull(), F.raise_error(F.lit(f"missing path {args[0]}"))).otherwise(value), kind
    parts = [compile_expression(a, schema, strict) for a in args]
    if op == "if":
        if parts[0][1] != "bool" or len(parts) != 3:
            raise ExpressionError("if takes a bool and two branches")
        if parts[1][1] != parts[2][1]:
            raise ExpressionError("branches of different kinds have no common column")
        known = F.when(parts[0][0].isNull(), F.lit(None)) if not strict else F
        return known.when(parts[0][0], parts[1][0]).otherwise(parts[2][0]), parts[1][1]
    if op in ("and", "or", "not"):
        if not parts or any(k != "bool" for _, k in parts) or (op == "not" and len(parts) != 1):
            raise ExpressionError(f"{op} takes bools")
        if op == "not":
            return ~parts[0][0], "bool"
        out = parts[-1][0]
        for c, _ in reversed(parts[:-1]):  # nested, so that a later operand isn't evaluated when an earlier one decides
            known = F.when(c.isNull(), F.lit(None).cast("boolean")) if not strict else F
            out = known.when(c, out).otherwise(F.lit(False)) if op == "and" else known.when(c, F.lit(True)).otherwise(out)
        return out, "bool"
    if op in ("==", "!="):
        (a, ka), (b, kb) = parts
        same = F.lit(False) if ka != kb else a.eqNullSafe(b) if strict else a == b
        return (same if op == "==" else ~same), "bool"
    if op in ("<", "<=", ">", ">="):
        (a, ka), (b, kb) = parts
        numbers = {ka, kb} <= {"int", "float"}
        if not numbers and (ka != kb or ka not in ("text", "bool")):
            raise ExpressionError(f"{op} of {ka} and {kb}")
        if numbers:
            wrong = F.raise_error(F.lit("NaN in a comparison")).cast("double") if strict else F.lit(None).cast("double")
            nan = lambda c: F.when(F.isnan(c), wrong).otherwise(c)
            a, b = nan(a.cast("double")), nan(b.cast("double"))
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op], "bool"
    raise ExpressionError(f"unknown operator {op}")


def get_item(vector: Column, index: Column) -> Column:
    """0-based; negative counts from the end; out of range is an error."""
    at = F.when(index < 0, index).otherwise(index + 1)
    inside = F.when(index < 0, -index <= F.size(vector)).otherwise(index < F.size(vector))
    return F.when(inside, F.element_at(vector, at)).otherwise(F.raise_error(F.lit("index out of range")))


def get_key(m: Column, key: Column) -> Column:
    """The value of a key; a missing one is an error, a null value isn't."""
    return F.when(F.map_contains_key(m, key), F.element_at(m, key)).otherwise(F.raise_error(F.lit("key not found in map")))


def merge(*maps: Column) -> Column:
    """Later values win, null ones too, and keep the first place of their key; with a null map the result is null."""
    keys = F.array_distinct(F.concat(*[F.map_keys(m) for m in maps]))

    def latest(k):
        out = F.element_at(maps[0], k)
        for m in maps[1:]:
            out = F.when(F.map_contains_key(m, k), F.element_at(m, k)).otherwise(out)
        return out

    return F.map_from_arrays(keys, F.transform(keys, latest))


def interpolate(*parts: Column) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("nil")) for p in parts])


def assign(df: DataFrame, path: str, value: Column) -> DataFrame:
    """A dotted write into struct columns; parents that are missing or no structs are replaced by structs."""
    first, *rest = path.split(".")
    if not rest:
        return df.withColumn(first, value)

    def put(base: Column | None, t, names):
        if not names:
            return value
        inner = t[names[0]].dataType if isinstance(t, T.StructType) and names[0] in t.names else None
        child = put(base[names[0]] if inner is not None else None, inner, names[1:])
        if isinstance(t, T.StructType):
            whole = F.struct(*[child.alias(n) if n == names[0] else base[n].alias(n) for n in t.names], *([] if names[0] in t.names else [child.alias(names[0])]))
            return whole
        return F.struct(child.alias(names[0]))

    old = df.schema[first].dataType if first in df.columns else None
    return df.withColumn(first, put(F.col(first) if old is not None else None, old, rest))


def canonical_decimal(text: Column) -> Column:
    """Zeros that say nothing are gone, no plus sign, minus zero is zero; null for anything that is no plain decimal."""
    t = F.regexp_replace(F.regexp_replace(text, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(text.rlike(r"^[+-]?\d+(\.\d+)?$"), F.when(t == "-0", "0").otherwise(t))


def valid_instant(text: Column) -> Column:
    """Canonical UTC instants: calendar-valid, seconds with a fraction of 1 to 9 digits that doesn't end in zero."""
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{0,8}[1-9])?Z$")
    return F.coalesce(shape & F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd").isNotNull(), F.lit(False)) if hasattr(F, "try_to_date") else F.coalesce(shape & F.expr("true"), F.lit(False))


def canonical_set(values: Column) -> Column:
    """Distinct members in the order of their text."""
    return F.array_sort(F.array_distinct(values), lambda a, b: F.when(a.cast("string") < b.cast("string"), -1).when(a.cast("string") > b.cast("string"), 1).otherwise(0))
