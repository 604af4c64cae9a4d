"""Plans in JSON form, evaluated over many instances at once, and their compiler from workflow artifacts.

A plan lives on the driver; instances are rows with a struct column ``state``. One pass over the steps in order takes
every instance to its end, to where it suspends, or to an error of its own: a row's failure never fails the job. Payloads
may hold ``$expr`` and ``$fn`` markers anywhere; constant parts are folded into literals.
"""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import values as V
from factloom.functions.expressions import ExpressionError, assign, compile_expression
from factloom.operators import identity as I
from factloom.operators import relational as R
from factloom.plans import rules
from factloom.plans.workflow import MAX_STEPS

#: Failure codes and limits.
STATE, IDENTITY, CONTRACT, MISMATCH = "EVAL.E_STATE_INVALID", "EVAL.E_STEP_IDENTITY", "EVAL.E_STEP_CONTRACT", "PROTOCOL.schema_mismatch"
MOST_STEPS = 9999
REQUEST = "struct<request_ordinal bigint, request_id string, capability_id string, operation string, args string, step_id string, history_cursor bigint>"
OBLIGATION = "struct<obligation_id string, obligation_type string, satisfaction_ref string>"
FIELDS = {"assign": ("path", "value", "next_step_id"), "emit": ("emission", "next_step_id"), "request": ("capability_id", "operation", "args", "next_step_id")}


class PlanFailure(ValueError):
    def __init__(self, codes: list[str], detail: str = ""):
        super().__init__(", ".join(codes) + (f": {detail}" if detail else ""))
        self.codes = codes


def in_order(codes) -> list[str]:
    """Distinct codes by namespace, place within it and text."""

    def key(c):
        space, _, leaf = c.partition(".")
        places = R.LEAVES.get(space, ())
        last = 2**31 - 1
        return (R.NAMESPACES.index(space) if space in R.NAMESPACES else last, places.index(leaf) if leaf in places else last, c)

    return sorted(set(codes), key=key)


# ------------------------------------------------------------------------------------------------ loading


def load(text: str) -> dict:
    """A plan from JSON; malformed text is ``E_STATE_INVALID``. ``kind`` and ``rules_program`` are other names of fields."""
    try:
        plan = json.loads(text)
        steps = [{"op" if k == "kind" else "rules" if k == "rules_program" else k: v for k, v in s.items()} for s in plan["steps"]]
        return {**plan, "steps": steps} | {k: plan[k] for k in ("format_id", "ir_version", "entry_step_id")}
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise PlanFailure([STATE], str(e)) from None


def _program(step: dict) -> rules.Program:
    given = [k for k in ("rules", "rules_sexpr") if step.get(k) is not None]
    if len(given) != 1:
        raise rules.RulesError(rules.STATE, "one of rules and rules_sexpr")
    return rules.parse_json(step["rules"]) if given == ["rules"] else rules.parse_source(step["rules_sexpr"])


def digest_of(x) -> str | None:
    """A digest as text or as an object of alg and hex, normalised."""
    if isinstance(x, dict):
        x = f"{x.get('alg') or x.get('algorithm')}:{x.get('hex')}"
    m = re.fullmatch(r"\s*:?(sha256|blake3)\s*:([0-9a-fA-F]{64})\s*", x) if isinstance(x, str) else None
    return f"{m[1]}:{m[2].lower()}" if m else None


def _joined(step: dict) -> tuple[list[str], str]:
    """Request hashes and policy of a join step."""
    hashes = []
    for o in step.get("obligations") or []:
        params = o.get("params") if isinstance(o, dict) else None
        kind = str(o.get("obligation_type", "")).strip().lstrip(":") if isinstance(o, dict) else ""
        h = digest_of(params.get("request_hash")) if isinstance(params, dict) and kind == I.RECEIPT_VALID else None
        if h is None or not isinstance(o.get("format"), str):
            raise PlanFailure([MISMATCH])
        hashes.append(h)
    policy = str(step.get("policy") or "all_of").strip().lstrip(":")
    if not hashes or policy not in ("all_of", "any_of") or step.get("on_timeout") is not None or not step.get("next_step_id"):
        raise PlanFailure([MISMATCH])
    return hashes, policy


def _after(step: dict) -> list[str]:
    if step["op"] == "choose_rules_v0":
        return list((step.get("routes") or {}).values())
    return [step["next_step_id"]] if step.get("next_step_id") else []


def validate(plan: dict) -> list[str]:
    """Every failure code of a plan, in order; none for a plan that can run."""
    codes, steps = [], plan["steps"]
    if not isinstance(plan.get("format_id"), str) or str(plan.get("ir_version")) != "v0":
        codes.append(STATE)
    if not steps:
        return in_order([*codes, IDENTITY])
    ids = [s.get("step_id", "") for s in steps]
    if any(not re.fullmatch(r"S\d{4}", i) for i in ids) or ids != sorted(set(ids)) or plan["entry_step_id"] != ids[0]:
        codes.append(IDENTITY)
    for s in steps:
        op = s.get("op")
        if op in FIELDS:
            blank = [f for f in FIELDS[op] if s.get(f) is None or (f in ("path", "capability_id", "operation") and not str(s[f]).strip())]
            codes += [CONTRACT] * bool(blank)
        elif op == "choose_rules_v0":
            codes += [CONTRACT] * (s.get("next_step_id") is not None or not s.get("routes"))
            try:
                _program(s)
            except rules.RulesError as e:
                codes.append(e.code)
        elif op == "join_obligations_v0":
            try:
                _joined(s)
            except PlanFailure as e:
                codes += e.codes
        elif op != "end" or s.get("next_step_id") is not None:
            codes.append(CONTRACT)
    if sum(s.get("op") == "end" for s in steps) != 1:
        codes.append(CONTRACT)
    reached = {plan["entry_step_id"]}
    for s in steps:  # steps rise and go forward, so one pass reaches all
        for n in _after(s):
            if n not in ids or n <= s["step_id"]:
                codes.append(IDENTITY)
            elif s["step_id"] in reached:
                reached.add(n)
    if not set(ids) <= reached:
        codes.append(IDENTITY)
    return in_order(codes)


# ------------------------------------------------------------------------------------------------ payloads


def is_expression(payload) -> bool:
    """Whether a payload holds a marker anywhere."""
    if isinstance(payload, dict):
        return "$expr" in payload or "$fn" in payload or any(map(is_expression, payload.values()))
    return isinstance(payload, list) and any(map(is_expression, payload))


def _listed(e, state: str):
    """A marked payload as a nested list that ``compile_expression`` takes; anything else is a literal."""
    if not isinstance(e, dict):
        return e
    if "$fn" in e:
        if set(e) != {"$fn", "body"} or e["$fn"] != "state":
            raise ExpressionError("a function payload binds state and has a body")
        return _listed(e["body"], state)
    op = e.get("$expr")
    keys = {"state_get": ("path",), "if": ("cond", "then", "else"), "not": ("arg",), "and": ("args",), "or": ("args",)}.get(op, ("left", "right"))
    if op is None or set(e) != {"$expr", *keys}:
        raise ExpressionError(f"{op} takes {', '.join(keys)}")
    if op == "state_get":
        return ["state", f"{state}.{e['path']}"]
    args = e["args"] if keys == ("args",) else [e[k] for k in keys]
    if not args:
        raise ExpressionError(f"{op} takes arguments")
    return [op, *[_listed(a, state) for a in args]]


def resolve(payload, df: DataFrame, state: str = "state") -> tuple[Column, str]:
    """A payload as a typed column (objects are structs, arrays of one kind arrays), null where a value isn't there."""
    if isinstance(payload, dict) and not {"$expr", "$fn"} & set(payload):
        parts = {k: resolve(v, df, state)[0] for k, v in payload.items()}
        whole = F.struct(*[c.alias(k) for k, c in parts.items()])
        missing = [parts[k].isNull() for k, v in payload.items() if v is not None]
        return (F.when(~F.greatest(F.lit(False), *missing), whole) if missing else whole), "struct"
    if isinstance(payload, list):
        items = [resolve(x, df, state) for x in payload]
        if len({k for _, k in items}) > 1:
            raise ExpressionError("an array of mixed kinds")
        whole = F.array(*[c for c, _ in items])
        return (F.when(~F.greatest(F.lit(False), *[c.isNull() for c, _ in items]), whole) if items else whole), "array"
    e = _listed(payload, state)
    return compile_expression(e, df.schema, strict=False)


def _shortest(value: Column) -> Column:
    """The shortest text of doubles that reads back the same."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: re.sub(r"e([+-])0*", lambda m: "e" + m[1].strip("+"), repr(float(x))), na_action="ignore")

    return run(value)


def json_of(payload, df: DataFrame, state: str = "state") -> Column:
    """A payload as canonical JSON text, null where a value isn't there."""
    if not is_expression(payload):
        return F.lit(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
    if isinstance(payload, dict) and not {"$expr", "$fn"} & set(payload):
        return I.raw_object(**{k: json_of(v, df, state) for k, v in payload.items()})
    if isinstance(payload, list):
        parts = [x for i, p in enumerate(payload) for x in ([F.lit(",")] if i else []) + [json_of(p, df, state)]]
        return F.concat(F.lit("["), *parts, F.lit("]"))
    value, kind = resolve(payload, df, state)
    if kind == "text":
        return F.when(value.isNotNull(), I.quoted(value))
    if kind in ("int", "bool"):
        return value.cast("string")
    return _shortest(value.cast("double")) if kind == "float" else F.to_json(value)


# ------------------------------------------------------------------------------------------------ evaluation


def _met(receipts: DataFrame, hashes: list[str], instance: str, trusted: list[str] | None) -> DataFrame:
    """Of each instance, which of the plan's request hashes an acceptable receipt answers: no more than the plan names."""
    sound = F.lit(True) if trusted is None else F.coalesce(F.col("signer").isin(trusted) & F.col("signature_valid"), F.lit(False))
    own = receipts.where(F.lower("request_hash").isin(hashes) & sound)
    return own.groupBy(instance).agg(F.collect_set(F.lower("request_hash")).alias("met"))


def evaluate(instances: DataFrame, plan: dict, instance: str = "instance", state: str = "state", receipts: DataFrame | None = None, trusted: list[str] | None = None,
             cursor: str | None = None, routes: dict[str, str] | None = None, max_steps: int = MAX_STEPS) -> DataFrame:
    """Adds control, current_step, steps_taken, emissions, requests, obligations and errors to the instances.

    ``receipts``: instance, request_hash, signer, signature_valid. ``cursor`` names the column of the history cursor.
    ``routes`` names, by choose step, a column that holds each instance's route; other choose steps run their program.
    A step that an instance can't do (a value isn't there) ends it with ``error``. Assigning to a new path adds it to
    the state of all instances, as null where the step isn't reached; a path can't change its kind.
    """
    if codes := validate(plan):
        raise PlanFailure(codes)
    steps = plan["steps"]
    artifact = plan.get("artifact_hash") or "sha256:" + hashlib.sha256(json.dumps(plan, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    array = lambda t: F.array().cast(f"array<{t}>")
    fresh = {"control": F.lit("continue"), "current_step": F.lit(plan["entry_step_id"]), "steps_taken": F.lit(0), "emissions": array("string"),
             "requests": array(REQUEST), "obligations": array(OBLIGATION), "errors": array("string")}
    df = instances
    for name, start in fresh.items():
        df = df if name in df.columns else df.withColumn(name, start)
    hashes = sorted({h for s in steps if s["op"] == "join_obligations_v0" for h in _joined(s)[0]})
    if hashes and receipts is not None:
        df = df.join(_met(receipts, hashes, instance, trusted), instance, "left")
    elif hashes:
        df = df.withColumn("met", F.lit(None).cast("array<string>"))
    for s in steps:
        here = (F.col("current_step") == s["step_id"]) & (F.col("control") == "continue") & (F.col("steps_taken") < max_steps)
        df = df.withColumn("here", here)
        here = F.col("here")
        fails, goes, control = F.lit(False), F.lit(s.get("next_step_id")), F.lit("continue")
        if s["op"] == "assign":
            df, fails = _assign(df, s, state)
        elif s["op"] == "emit":
            emission = json.dumps(s["emission"], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            df = df.withColumn("emissions", F.when(here, F.array_append("emissions", F.lit(emission))).otherwise(F.col("emissions")))
        elif s["op"] == "request":
            df, fails = _request(df, s, state, artifact, cursor)
            goes, control = F.col("current_step"), F.lit("suspend")
        elif s["op"] == "choose_rules_v0":
            if s["step_id"] in (routes or {}):
                table = F.create_map(*[F.lit(x) for pair in s["routes"].items() for x in pair])
                goes = table[F.col(routes[s["step_id"]])]
            else:
                goes = F.lit(s["routes"].get(rules.solve(df.sparkSession, _program(s))))
            fails = goes.isNull()
        elif s["op"] == "join_obligations_v0":
            wanted, policy = _joined(s)
            held = [F.coalesce(F.array_contains("met", h), F.lit(False)) for h in wanted]
            ok = F.least(F.lit(True), *held) if policy == "all_of" else F.greatest(F.lit(False), *held)
            control, goes = F.when(ok, "continue").otherwise("suspend"), F.when(ok, goes).otherwise(F.col("current_step"))
        elif s["op"] == "end":
            control, goes = F.lit("end"), F.col("current_step")
        code = rules.NO_MATCH if s["op"] == "choose_rules_v0" else CONTRACT
        df = df.withColumn("fails", here & fails)
        df = df.withColumn("errors", F.when(F.col("fails"), F.array_append("errors", F.lit(code))).otherwise(F.col("errors")))
        df = df.withColumn("steps_taken", F.col("steps_taken") + here.cast("int"))
        df = df.withColumn("current_step", F.when(here & ~F.col("fails"), goes).otherwise(F.col("current_step")))
        df = df.withColumn("control", F.when(F.col("fails"), "error").when(here, control).otherwise(F.col("control"))).drop("here", "fails")
    return df.drop("met")


def _assign(df: DataFrame, s: dict, state: str) -> tuple[DataFrame, Column]:
    try:
        value, _ = resolve(s["value"], df, state)
    except ExpressionError:
        return df, F.lit(True)
    df = df.withColumn("assigned", value)
    path, kind = s["path"].split("."), df.schema["assigned"].dataType
    at: T.DataType | None = df.schema[state].dataType
    old = F.col(state)
    for part in path:
        at = at[part].dataType if isinstance(at, T.StructType) and part in at.names else None
        old = old[part] if at is not None else F.lit(None)
    if at is not None and at.simpleString() != kind.simpleString():
        if not (isinstance(at, T.IntegralType) and isinstance(kind, T.IntegralType)):
            raise PlanFailure([CONTRACT], f"{s['path']} is {at.simpleString()} and can't become {kind.simpleString()}")
        kind = at
    missing = F.col("assigned").isNull() if s["value"] is not None else F.lit(False)
    new = F.when(F.col("here") & ~missing, F.col("assigned").cast(kind)).otherwise(old.cast(kind))
    df = df.withColumn("failing", missing)
    return assign(df, f"{state}.{s['path']}", new).drop("assigned"), F.col("failing")


def _request(df: DataFrame, s: dict, state: str, artifact: str, cursor: str | None) -> tuple[DataFrame, Column]:
    try:
        args = json_of(s["args"], df, state)
    except ExpressionError:
        return df, F.lit(True)
    step, source = F.lit(s["step_id"]), F.lit(artifact)
    at = F.col(cursor).cast("long") if cursor else F.lit(0).cast("long")
    df = df.withColumn("args", args).withColumn("asked", I.request_key(source, step, I.args_hash(F.col("args"))))
    request = F.struct(F.lit(1).cast("long"), F.col("asked"), F.lit(s["capability_id"]), F.lit(s["operation"]), F.col("args"), step, at).cast(REQUEST)
    obligation = F.struct(I.obligation_id(source, step, F.col("asked")), F.lit(I.RECEIPT_VALID), F.col("asked")).cast(OBLIGATION)
    does = F.col("here") & F.col("args").isNotNull()
    df = df.withColumn("requests", F.when(does, F.array_append("requests", request)).otherwise(F.col("requests")))
    df = df.withColumn("obligations", F.when(does, F.array_append("obligations", obligation)).otherwise(F.col("obligations")))
    return df.withColumn("failing", F.col("args").isNull()).drop("args", "asked"), F.col("failing")


def resume(suspended: DataFrame, plan: dict, receipts: DataFrame, instance: str = "instance", trusted: list[str] | None = None) -> DataFrame:
    """Instances that wait on a request whose obligation a receipt meets, put at the step behind it; the rest as they are."""
    sound = F.lit(True) if trusted is None else F.coalesce(F.col("signer").isin(trusted) & F.col("signature_valid"), F.lit(False))
    waits = F.element_at("obligations", -1)["satisfaction_ref"]
    answered = receipts.where(sound).select(instance, F.lower("request_hash").alias("asked"), F.lit(True).alias("answered")).distinct()
    df = suspended.withColumn("asked", F.when((F.col("control") == "suspend") & (F.size("obligations") > 0), waits)).join(answered, [instance, "asked"], "left")
    after = F.create_map(*[F.lit(x) for s in plan["steps"] if s["op"] == "request" for x in (s["step_id"], s["next_step_id"])])
    goes = F.when(F.col("answered"), after[F.col("current_step")])
    df = df.withColumn("control", F.when(goes.isNotNull(), "continue").otherwise(F.col("control"))).withColumn("current_step", F.coalesce(goes, "current_step"))
    return df.drop("asked", "answered").select(*suspended.columns)


def rows_of(evaluated: DataFrame, what: str, instance: str = "instance") -> DataFrame:
    """The requests or obligations of all instances, one a row."""
    return evaluated.select(instance, F.explode(what).alias("r")).select(instance, "r.*")


# ------------------------------------------------------------------------------------------------ artifacts


def json_value(value):
    """A nested value as JSON data: sets are arrays, names are text, tags and annotations go."""
    kind, body = value
    if kind in ("vector", "set"):
        return [json_value(v) for v in body]
    if kind == "map":
        if any(k[0] not in ("keyword", "string") for k, _ in body):
            raise PlanFailure([CONTRACT], "keys must be names")
        return {k[1]: json_value(v) for k, v in body}
    if kind in ("tagged", "annotated"):
        return json_value(body[1])
    if kind in ("bytes", "bigint") or (kind in ("f32", "f64") and body in (float("inf"), float("-inf"))) or body != body:
        raise PlanFailure([CONTRACT], f"{kind} has no JSON form")
    return body


#: A step's fields: those it must have and those it may have.
STEPS = {
    "assign": (("path", "value"), ()), "emit": (("emission",), ()), "request": (("capability_id", "operation", "args"), ()),
    "join_obligations_v0": ((), ("obligations", "wait_for_steps", "policy")), "end": ((), ()),
}


def _fields(value, required, optional, what: str) -> dict:
    if value[0] != "map":
        raise PlanFailure([STATE], f"{what} must be a map")
    out = {}
    for k, v in value[1]:
        name = k[1].replace("/", "_").replace("-", "_") if k[0] in ("keyword", "string") else None
        if name not in (*required, *optional) or name in out:
            raise PlanFailure([STATE], f"{what} has an unknown or repeated field {name}")
        out[name] = v
    if missing := [f for f in required if f not in out]:
        raise PlanFailure([STATE], f"{what} lacks {', '.join(missing)}")
    return out


def _text(value, what: str, code: str = CONTRACT) -> str:
    if value[0] != "string" or not value[1].strip():
        raise PlanFailure([code], f"{what} must be text")
    return value[1]


def compile_artifact(value) -> dict:
    """The plan of a workflow artifact: steps get ids in order, joins the hashes of the requests that they wait for."""
    if value[0] != "tagged" or value[1][0].replace("/", "_").replace("-", "_") != "workflow_artifact_v0":
        raise PlanFailure([STATE], "no workflow artifact")
    root = _fields(value[1][1], ("id", "version", "steps"), (), "artifact")
    _text(root["id"], "artifact.id", STATE)
    if _text(root["version"], "artifact.version", STATE) != "v0" or root["steps"][0] != "vector":
        raise PlanFailure([STATE], "artifact.version or artifact.steps")
    given = root["steps"][1]
    if not 0 < len(given) <= MOST_STEPS:
        raise PlanFailure([IDENTITY], "number of steps")
    artifact = "sha256:" + hashlib.sha256(V.encode(V.canonical(value))).hexdigest()
    ids = [f"S{i + 1:04d}" for i in range(len(given))]
    steps, names, asked = [], {}, {}
    for i, step in enumerate(given):
        ops = [v for k, v in (step[1] if step[0] == "map" else []) if k[1] == "op"]
        op = ops[0][1].replace("/", "_").replace("-", "_") if ops and ops[0][0] in ("keyword", "string") else None
        if op not in STEPS:
            raise PlanFailure([CONTRACT if step[0] == "map" else STATE], f"unsupported step {op}")
        required, optional = STEPS[op]
        f = _fields(step, ("op", *required), ("name", *optional), f"{op} step")
        if "name" in f and names.setdefault(_text(f["name"], "a step's name"), i) != i:
            raise PlanFailure([IDENTITY], "repeated step name")
        if (op == "end") != (i == len(given) - 1):
            raise PlanFailure([CONTRACT], "the last step, and only it, is end")
        out = {"step_id": ids[i], "op": op, "given": f} | ({"next_step_id": ids[i + 1]} if op != "end" else {})
        for name in required:
            out[name] = _text(f[name], name) if name in ("path", "capability_id", "operation") else json_value(f[name])
        if op == "request" and not is_expression(out["args"]):
            seed = {"artifact_hash": artifact, "step_id": ids[i], "request_ordinal": 1, "args_hash": _sha(out["args"])}
            asked[i] = _sha(seed)
        steps.append(out)
    for s in steps:
        f = s.pop("given")
        if s["op"] != "join_obligations_v0":
            continue
        sources = [k for k in ("obligations", "wait_for_steps") if k in f]
        if len(sources) != 1 or f[sources[0]][0] != "vector" or not f[sources[0]][1]:
            raise PlanFailure([MISMATCH], "one of obligations and wait_for_steps")
        policy = f["policy"][1].strip().replace("-", "_") if "policy" in f else "all_of"
        if policy not in ("all_of", "any_of"):
            raise PlanFailure([MISMATCH], "policy")
        if sources == ["obligations"]:
            s["obligations"] = [json_value(o) for o in f["obligations"][1]]
        else:
            s["obligations"] = [_awaited(ref, names, asked, steps) for ref in f["wait_for_steps"][1]]
        s |= {"policy": policy} if policy != "all_of" else {}
    return {"format_id": "evalir", "ir_version": "v0", "artifact_hash": artifact, "entry_step_id": ids[0], "steps": steps}


def _sha(x) -> str:
    return "sha256:" + hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def _awaited(ref, names: dict, asked: dict, steps: list) -> dict:
    """The obligation of a step named by its name or its ordinal (from 1)."""
    kind, body = ref
    at = names.get(body.strip(), -1) if kind == "string" else body - 1 if kind in ("int", "uint") else -1
    if not 0 <= at < len(steps):
        raise PlanFailure([MISMATCH], f"no step {body}")
    if at not in asked:
        raise PlanFailure([CONTRACT], f"step {body} is no request with constant arguments")
    return {"format": "obligation_v0", "obligation_type": I.RECEIPT_VALID, "params": {"request_hash": asked[at]}}


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Plans of the artifact files of a folder, text or messages: path, plan (JSON) or codes."""

    @F.pandas_udf("struct<plan string, codes array<string>>")
    def compiled(contents: pd.Series) -> pd.DataFrame:
        def one(raw):
            raw = bytes(raw)
            try:
                value = V.decode(raw) if raw[:4] == V.MAGIC else V.parse(raw.decode())
                return json.dumps(compile_artifact(value), sort_keys=True, ensure_ascii=False), None
            except PlanFailure as e:
                return None, e.codes
            except (ValueError, RecursionError):
                return None, [STATE]

        return pd.DataFrame([one(c) for c in contents], columns=["plan", "codes"])

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", compiled("content").alias("c")).select("path", "c.*")
