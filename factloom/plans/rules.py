"""Rules programs: facts, conjunctive rules and a routing query, compiled to DataFrame joins.

A program is small and lives on the driver; facts live in relations (one DataFrame per predicate, columns a0, a1, …) or
in the program itself. Rules are planned producers first, so a rule may use what other rules derive. Each body becomes
equi-joins on shared variables with the filters as soon as their variables are bound; heads are distinct projections.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Failure codes and source limits.
UNBOUND, TYPE, FORBIDDEN = "EVAL.unbound_var", "EVAL.type_mismatch", "EVAL.forbidden_feature"
NO_MATCH, AMBIGUOUS, STATE = "EVAL.no_match", "EVAL.ambiguous_match", "EVAL.E_STATE_INVALID"
MAX_BYTES, MAX_TOKENS, MAX_FACTS, MAX_RULES, MAX_BODY = 64 * 1024, 20_000, 1_000, 1_000, 100
BUILTINS = ("=", "!=", "<", "<=", ">", ">=", "in")


class RulesError(ValueError):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


class Atom(str):
    """A route or other symbolic literal, written ``:name``."""


class Var(str):
    """A logic variable, written ``?name``."""


@dataclass
class Program:
    rules: list  # (head, body): tuples (predicate, terms…)
    query: tuple
    facts: list = field(default_factory=list)
    no_match: str | None = None  # default route, or None: an error
    ambiguous: str = "error"  # or choose-first


# ------------------------------------------------------------------------------------------------ loading

_TOKEN = re.compile(r'\s+|;[^\n]*|([()])|"((?:[^"\\]|\\.)*)"|([^\s()"]+)')


def parse_source(text: str) -> Program:
    """A program in s-expression form."""
    if len(text.encode()) > MAX_BYTES:
        raise RulesError(STATE, "source too long")
    stack, at, count = [[]], 0, 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise RulesError(STATE, f"unreadable at {at}")
        at = m.end()
        if m[1] is None and m[2] is None and m[3] is None:
            continue
        count += 1
        if count > MAX_TOKENS:
            raise RulesError(STATE, "too many tokens")
        if m[1] == "(":
            stack.append([])
        elif m[1] == ")":
            if len(stack) < 2:
                raise RulesError(STATE, "unbalanced")
            done = stack.pop()
            stack[-1].append(done)
        elif m[2] is not None:
            stack[-1].append(re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t", "r": "\r"}.get(e[1], e[1]), m[2]))
        else:
            stack[-1].append(_symbol(m[3]))
    if len(stack) != 1 or len(stack[0]) != 1 or not stack[0][0] or stack[0][0][0] != "rules-sexpr-v0":
        raise RulesError(STATE, "not one rules form")
    parts = {str(p[0]).lstrip(":"): p[1:] for p in stack[0][0][1:]}
    policy = {str(p[0]).lstrip(":"): p[1] for p in parts.get("routing_policy", [])}
    facts = [_form(f) for f in parts.get("facts", [])]
    if "query" not in parts:
        raise RulesError(STATE, "no query")
    rules = []
    for r in parts.get("rules", []):
        if str(r[0]) != ":-":
            raise RulesError(STATE, "a rule begins with :-")
        rules.append((_form(r[1]), [_form(b) for b in r[2:]]))
    none = policy.get("no_match_policy", "error")
    default = ":" + none[1].lstrip(":") if isinstance(none, list) else None
    ambiguous = "choose-first" if str(policy.get("ambiguous_policy", "error")).lstrip(":") == "allow_multiple" else "error"
    return analyse(Program(rules, _form(parts["query"][0]), list(dict.fromkeys(facts)), default, ambiguous))


def _symbol(s: str):
    if s in ("true", "false"):
        return s == "true"
    if re.fullmatch(r"[+-]?\d+", s):
        return int(s)
    if re.fullmatch(r"[+-]?\d+\.\d+([eE][+-]?\d+)?", s):
        return float(s)
    return Var(s[1:]) if s.startswith("?") else Atom(":" + s.lstrip(":")) if s != ":-" and s not in BUILTINS and s != "rules-sexpr-v0" else s


def _form(f):
    name = str(f[0]).lstrip(":")
    out = []
    for t in f[1:]:
        if isinstance(t, list):
            if name == "in" and t and str(t[0]).lstrip(":") == "set":
                t = tuple(t[1:])
            else:
                raise RulesError(FORBIDDEN, "nested term")
        out.append(t)
    return (name, *out)


def parse_json(spec: dict) -> Program:
    """A program in JSON form (``facts``, ``rules``, ``query``, ``on_no_match``, ``on_ambiguous``)."""
    def term(x):
        if isinstance(x, dict) or x is None:
            raise RulesError(FORBIDDEN, "function symbol")
        if isinstance(x, str):
            return Var(x[1:]) if x.startswith("?") else Atom(x) if x.startswith(":") else x
        return tuple(term(y) for y in x) if isinstance(x, list) else x

    form = lambda f: (f[0], *[term(x) for x in f[1:]])
    if any(r.get("negated") or any(isinstance(b, dict) for b in r["body"]) for r in spec["rules"]):
        raise RulesError(FORBIDDEN, "negation")
    none = spec.get("on_no_match", "error")
    facts = list(dict.fromkeys(form(f) for f in spec.get("facts", [])))
    default = none["default"] if isinstance(none, dict) else None
    return analyse(Program([(form(r["head"]), [form(b) for b in r["body"]]) for r in spec["rules"]], form(spec["query"]), facts, default, spec.get("on_ambiguous", "error")))


# ------------------------------------------------------------------------------------------------ analysis


def analyse(p: Program) -> Program:
    """Checks limits, arities, safety, bans and cycles; sorts the rules producers first."""
    if len(p.facts) > MAX_FACTS or len(p.rules) > MAX_RULES or any(len(b) > MAX_BODY for _, b in p.rules):
        raise RulesError(STATE, "limits")
    arity: dict[str, int] = {}
    for f in [*p.facts, *(h for h, _ in p.rules), *(b for _, body in p.rules for b in body if b[0] not in BUILTINS), p.query]:
        if str(f[0]) == "not" or str(f[0]).startswith("not("):
            raise RulesError(FORBIDDEN, "negation")
        if arity.setdefault(f[0], len(f)) != len(f):
            raise RulesError(TYPE, f"arity of {f[0]}")
    for f in p.facts:
        if any(isinstance(t, Var) for t in f[1:]):
            raise RulesError(UNBOUND, "variable in a fact")
    for head, body in p.rules:
        bound: set = set()
        for b in body:
            names = {t for t in b[1:] if isinstance(t, Var)}
            if b[0] in BUILTINS:
                if len(b) != 3:
                    raise RulesError(TYPE, f"{b[0]} takes two terms")
                if names - bound:
                    raise RulesError(UNBOUND, ", ".join(sorted(names - bound)))
            else:
                bound |= names
        if {t for t in head[1:] if isinstance(t, Var)} - bound:
            raise RulesError(UNBOUND, "head variable")
    made = {h[0] for h, _ in p.rules}
    needs = {m: {b[0] for h, body in p.rules if h[0] == m for b in body if b[0] in made} for m in made}
    order: list[str] = []
    while len(order) < len(made):
        ready = sorted(m for m in made if m not in order and needs[m] <= set(order))
        if not ready:
            raise RulesError(FORBIDDEN, "recursion")
        order += ready
    p.rules.sort(key=lambda r: order.index(r[0][0]))
    return p


# ------------------------------------------------------------------------------------------------ compiling


def _kind(t):
    """Kinds never equal one another: an atom isn't the string of the same text."""
    return "bool" if isinstance(t, bool) else "number" if isinstance(t, (int, float)) else "atom" if isinstance(t, Atom) else "text"


@dataclass
class Relation:
    """A predicate's rows (a0, a1, …) and the kind of each column."""

    rows: DataFrame
    kinds: list[str]

    @classmethod
    def of(cls, df: DataFrame) -> Relation:
        kinds = ["text" if t == "string" else "bool" if t == "boolean" else "number" for _, t in df.dtypes]
        return cls(df.toDF(*[f"a{i}" for i in range(len(kinds))]), kinds)

    def union(self, other: Relation) -> Relation:
        if self.kinds != other.kinds:
            raise RulesError(TYPE, "a column of mixed kinds")
        return Relation(self.rows.union(other.rows), self.kinds)


def _literal_relation(spark: SparkSession, rows: list[tuple]) -> Relation:
    kinds = [{_kind(v) for v in c} for c in zip(*rows, strict=True)]
    if any(len(k) > 1 for k in kinds):
        raise RulesError(TYPE, "a column of mixed kinds")
    types = ["boolean" if k == {"bool"} else "string" if k & {"text", "atom"} else "bigint" if all(isinstance(r[i], int) for r in rows) else "double" for i, k in enumerate(kinds)]
    clean = [tuple(float(v) if t == "double" else str(v) if t == "string" else v for v, t in zip(r, types, strict=True)) for r in rows]
    return Relation(spark.createDataFrame(clean, ", ".join(f"a{i} {t}" for i, t in enumerate(types))), [k.pop() for k in kinds])


def _compare(op: str, left: Column, right: Column) -> Column:
    return {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def _filter(kinds: dict, b: tuple) -> Column:
    op, left, right = b
    kind = lambda t: kinds[t] if isinstance(t, Var) else _kind(t)
    column = lambda t: F.col(f"v_{t}") if isinstance(t, Var) else F.lit(str(t) if isinstance(t, str) else t)
    if op == "in":
        if any(_kind(x) != kind(left) for x in right):
            raise RulesError(TYPE, "in")
        return column(left).isin([str(x) if isinstance(x, str) else x for x in right]) if right else F.lit(False)
    if kind(left) != kind(right) or (op not in ("=", "!=") and kind(left) != "number"):
        raise RulesError(TYPE, op)
    if kind(left) == "number":
        return _compare(op, column(left).cast("double"), column(right).cast("double"))
    return _compare(op, column(left), column(right))


def _pattern(relation: Relation, terms: tuple) -> tuple[DataFrame, dict]:
    """A relation's rows that fit the terms, with a column for each variable, and the variables' kinds."""
    seen: dict = {}
    df, fits = relation.rows, True
    for i, t in enumerate(terms):
        if isinstance(t, Var):
            if t in seen:
                fits &= relation.kinds[i] == relation.kinds[seen[t]]
                df = df.where(F.col(f"a{i}") == F.col(f"a{seen[t]}")) if fits else df
            seen.setdefault(t, i)
        elif relation.kinds[i] != _kind(t):
            fits = False
        else:
            df = df.where(F.col(f"a{i}") == F.lit(str(t) if isinstance(t, str) else t))
    df = df if fits else df.where(F.lit(False))
    return df.select(*[F.col(f"a{j}").alias(f"v_{v}") for v, j in seen.items()] or [F.lit(True).alias("v_")]), {v: relation.kinds[j] for v, j in seen.items()}


def _body(spark: SparkSession, known: dict[str, Relation], body: list) -> tuple[DataFrame | None, dict]:
    """Bindings of a rule's body, None where a predicate has no facts at all."""
    rows, kinds = None, {}
    for b in body:
        if b[0] in BUILTINS:
            rows = spark.range(1).select(F.lit(True).alias("v_")) if rows is None else rows  # over literals only
            rows = rows.where(_filter(kinds, b))
            continue
        if b[0] not in known:
            return None, {}
        new, own = _pattern(known[b[0]], b[1:])
        if any(kinds.get(v, k) != k for v, k in own.items()):
            new = new.select(*[F.col(f"v_{v}") for v in own if kinds.get(v, own[v]) == own[v]] or [F.lit(True).alias("v_")]).where(F.lit(False))
        kinds = {**own, **kinds}
        if rows is None:
            rows = new
            continue
        shared = [c for c in new.columns if c in rows.columns]
        rows = rows.join(new, shared, "inner") if shared else rows.crossJoin(new)
    return rows, kinds


def _head_of(head: tuple, rows: DataFrame, kinds: dict) -> Relation:
    terms = [(F.col(f"v_{t}") if isinstance(t, Var) else F.lit(str(t) if isinstance(t, str) else t)).alias(f"a{i}") for i, t in enumerate(head[1:])]
    return Relation(rows.select(*terms), [kinds[t] if isinstance(t, Var) else _kind(t) for t in head[1:]])


def _apart(spark: SparkSession, known: dict[str, Relation], head: tuple, body: list) -> tuple[list[DataFrame], dict] | None:
    """Bindings of a body of two predicates that share out the head's variables, so that they may pair many with many.

    Two parts: in the first no two bindings agree in the head, so it needs no distinct over what may be far more rows
    than the predicates have; the second has the other bindings, and no head row of the first. A predicate's rows count
    as single where its head variables have one value only of the variables beside them. None for any other body.
    """
    atoms = [i for i, b in enumerate(body) if b[0] not in BUILTINS]
    heads = {t for t in head[1:] if isinstance(t, Var)}
    if len(atoms) != 2 or any(body[i][0] not in known or heads <= set(body[i][1:]) for i in atoms):
        return None
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few rows may make very many pairs
    single, several, every = {}, {}, {}
    for i in atoms:
        rows, kinds = _pattern(known[body[i][0]], body[i][1:])
        used = heads | {t for j, b in enumerate(body) if j != i for t in b[1:] if isinstance(t, Var)}
        names = sorted((v for v in kinds if v in used), key=lambda v: v not in heads)
        key, rest = [f"v_{v}" for v in names if v in heads], [f"v_{v}" for v in names if v not in heads]
        body = [*body[:i], (f"#{i}", *map(Var, names)), *body[i + 1 :]]
        as_relation = lambda df: Relation(df.toDF(*[f"a{j}" for j in range(len(df.columns))]), [kinds[c[2:]] for c in df.columns])  # noqa: B023, E731
        rows = rows.select(*key, *rest)
        every[f"#{i}"] = as_relation(rows)
        if not rest:
            single[f"#{i}"] = as_relation(rows.distinct().repartition(parts))
            continue
        ends = rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("lo"), F.max(F.struct(*rest)).alias("hi"))
        same = F.col("lo").eqNullSafe(F.col("hi"))
        single[f"#{i}"] = as_relation(ends.where(same).select(*key, *[F.col(f"lo.{c}") for c in rest]).repartition(parts))
        again = ends.where(~same).select(*[F.col(c).alias(f"k_{c}") for c in key])
        several[f"#{i}"] = as_relation(rows.join(again, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in key]), "left_semi"))
    one, two = (f"#{i}" for i in atoms)
    first, kinds = _body(spark, single, body)
    rest = [{one: several[one], two: every[two]}] if one in several else []
    rest += [{one: single[one], two: several[two]}] if two in several else []
    return [first, *[_body(spark, r, body)[0] for r in rest]], kinds


def _relations(spark: SparkSession, program: Program, relations: dict[str, DataFrame] | None = None) -> dict[str, Relation]:
    known = {k: Relation.of(df) for k, df in (relations or {}).items()}
    for name in dict.fromkeys(f[0] for f in program.facts):
        own = _literal_relation(spark, [tuple(f[1:]) for f in program.facts if f[0] == name])
        known[name] = known[name].union(own) if name in known else own
        known[name].rows = known[name].rows.distinct()
    for head in dict.fromkeys(h[0] for h, _ in program.rules):
        parts = [known[head]] if head in known else []
        mine = [(h, body) for h, body in program.rules if h[0] == head]
        apart = _apart(spark, known, *mine[0]) if len(mine) == 1 and not parts else None
        if apart:
            first, *others = [_head_of(mine[0][0], rows, apart[1]) for rows in apart[0]]
            if others:
                first.rows = first.rows.union(reduce(Relation.union, others).rows.distinct())
            known[head] = first
            continue
        for h, body in mine:
            rows, kinds = _body(spark, known, body)
            if rows is not None:
                parts.append(_head_of(h, rows, kinds))
        if parts:
            known[head] = reduce(Relation.union, parts)
            known[head].rows = known[head].rows.distinct()
    return known


def derive(spark: SparkSession, program: Program, relations: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Every predicate's relation, stored and derived rows together."""
    return {name: r.rows for name, r in _relations(spark, program, relations).items()}


def solve(spark: SparkSession, program: Program, relations: dict[str, DataFrame] | None = None) -> str:
    """The route that the program's query chooses: the first in canonical order, under its policies."""
    if len(program.query) != 2:
        raise RulesError(TYPE, "the query takes one term")
    known = _relations(spark, program, relations)
    first, several = None, False
    if program.query[0] in known:
        rows, _ = _pattern(known[program.query[0]], program.query[1:])
        route = F.col(rows.columns[0])
        first, several = rows.agg(F.min_by(route, route.cast("string")), F.count_distinct(route) > 1).first()
    if first is None:
        if program.no_match is None:
            raise RulesError(NO_MATCH)
        return program.no_match
    if several and program.ambiguous == "error":
        raise RulesError(AMBIGUOUS)
    return first


def route_each(spark: SparkSession, program: Program, relations: dict[str, DataFrame], entities: DataFrame) -> DataFrame:
    """(entity, route, candidates): the program's query ``(predicate ?entity ?route)`` answered for every entity."""
    known = derive(spark, program, relations)
    found = known[program.query[0]].groupBy(F.col("a0").alias("entity")).agg(F.min("a1").alias("route"), F.countDistinct("a1").alias("candidates"))
    out = entities.toDF("entity").join(found, "entity", "left")
    route = F.coalesce("route", F.lit(program.no_match)) if program.no_match else F.coalesce("route", F.raise_error(F.lit(NO_MATCH)))
    if program.ambiguous == "error":
        route = F.when(F.col("candidates") > 1, F.raise_error(F.lit(AMBIGUOUS))).otherwise(route)
    return out.select("entity", route.alias("route"), F.coalesce("candidates", F.lit(0)).alias("candidates"))
