"""Forward-only workflow plans evaluated over many instances at once.

A plan is a small list of steps on the driver; instances are rows of a DataFrame with struct columns for state. Step
ids rise and successors lie ahead, so one pass over the steps in order takes every instance to its end or to where it
suspends; each step is a projection that changes the rows whose current step it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.expressions import assign, compile_expression

#: Failure codes and the default number of steps.
IDENTITY, CONTRACT = "EVAL.E_STEP_IDENTITY", "EVAL.E_STEP_CONTRACT"
MAX_STEPS = 10
OPERATIONS = ("assign", "emit", "request", "choose", "join_obligations_v0", "end")


class PlanError(ValueError):
    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


def _next(step: dict) -> list[str]:
    if step["op"] == "choose":
        return list(step["routes"].values())
    return [] if step["op"] == "end" else [step.get("next_step_id")]


def validate(plan: list[dict]) -> list[dict]:
    ids = [s["step_id"] for s in plan]
    if not ids or ids != sorted(set(ids)):
        raise PlanError(IDENTITY, "step ids must rise")
    if any(s["op"] not in OPERATIONS for s in plan):
        raise PlanError(CONTRACT, "unknown operation")
    if sum(s["op"] == "end" for s in plan) != 1:
        raise PlanError(CONTRACT, "exactly one end")
    reached = {ids[0]}
    for s in plan:
        for n in _next(s):
            if n not in ids or n <= s["step_id"]:
                raise PlanError(CONTRACT, f"{s['step_id']} must go forward to a step")
            if s["step_id"] in reached:
                reached.add(n)
    if reached != set(ids):
        raise PlanError(CONTRACT, "unreachable steps")
    return plan


def run(instances: DataFrame, plan: list[dict], routes: dict[str, str] | None = None, max_steps: int = MAX_STEPS) -> DataFrame:
    """Adds current_step, steps_taken, control (continue, suspend, end) and emissions to the instances.

    ``choose`` steps read the route from the column that ``routes`` names for them; ``join_obligations_v0`` steps read
    a boolean column ``satisfied``; a suspended instance is resumed by running the plan on it again.
    """
    validate(plan)
    df = instances
    for name, start in (("current_step", F.lit(plan[0]["step_id"])), ("steps_taken", F.lit(0)), ("control", F.lit("continue")), ("emissions", F.array().cast("array<string>"))):
        if name not in df.columns:
            df = df.withColumn(name, start)
    df = df.withColumn("control", F.when(F.col("control") == "suspend", "continue").otherwise(F.col("control")))
    for s in plan:
        here = (F.col("current_step") == s["step_id"]) & (F.col("control") == "continue") & (F.col("steps_taken") < max_steps)
        df = df.withColumn("here", here)
        goes, control = F.lit(s.get("next_step_id")), F.lit("continue")
        if s["op"] == "assign":
            value, _ = compile_expression(s["value"], df.schema)
            changed = assign(df.select("*"), s["path"], value)
            top = s["path"].split(".")[0]
            if top in df.columns and df.schema[top].dataType.simpleString() == changed.schema[top].dataType.simpleString():
                df = df.withColumn("new_state", _column(df, s["path"], value)).withColumn(top, F.when(F.col("here"), F.col("new_state")).otherwise(F.col(top))).drop("new_state")
            else:
                raise PlanError(CONTRACT, f"{s['path']} must exist with the kind that is assigned")
        elif s["op"] == "emit":
            df = df.withColumn("emissions", F.when(F.col("here"), F.array_append("emissions", F.lit(s["emission"]))).otherwise(F.col("emissions")))
        elif s["op"] == "request":
            control = F.lit("suspend")
        elif s["op"] == "choose":
            table = F.create_map(*[x for k, v in s["routes"].items() for x in (F.lit(k), F.lit(v))])
            goes = F.coalesce(table[F.col((routes or {})[s["step_id"]])], F.raise_error(F.lit("EVAL.no_match")).cast("string"))
        elif s["op"] == "join_obligations_v0":
            control = F.when(F.col("satisfied"), "continue").otherwise("suspend")
            goes = F.when(F.col("satisfied"), goes).otherwise(F.col("current_step"))
        elif s["op"] == "end":
            control, goes = F.lit("end"), F.col("current_step")
        df = df.withColumn("steps_taken", F.col("steps_taken") + F.col("here").cast("int"))
        df = df.withColumn("current_step", F.when(F.col("here"), goes).otherwise(F.col("current_step")))
        df = df.withColumn("control", F.when(F.col("here"), control).otherwise(F.col("control"))).drop("here")
    return df


def _column(df: DataFrame, path: str, value):
    top, _, rest = path.partition(".")
    return F.col(top).withField(rest, value) if rest else value
