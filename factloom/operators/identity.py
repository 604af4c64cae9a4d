"""Identities: canonical JSON of known columns, request and obligation ids, ledgers with their hashes, format checks.

Everything here but float text and chain building is built-in functions, so hashing stays in the JVM.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import values as V
from factloom.operators import relational as R

#: Formats that identifiers have.
FORMATS = {
    "digest": r"^(sha256|blake3):[0-9a-fA-F]{64}$", "hex64": r"^[0-9a-f]{64}$", "step_id": r"^S[0-9]{4}$", "vector_id": r"^[A-Za-z0-9][A-Za-z0-9_.-]*$",
    "failure_code": r"^(KERNEL|EVAL|PROTOCOL|CAPABILITY)\.[A-Za-z0-9_]+$",
}
RECEIPT_VALID = "receipt_valid"


# ------------------------------------------------------------------------------------------------ canonical JSON


def sha256(text: Column, prefixed: bool = False) -> Column:
    out = F.sha2(text, 256)
    return F.concat(F.lit("sha256:"), out) if prefixed else out


def float_text(x: float) -> str:
    """A finite double with 17 significant digits at most: zero is ``0``, exponents have no plus and no leading zeros."""
    if x != x or x in (float("inf"), float("-inf")):
        raise V.ValueFormatError("only finite floats have canonical JSON")
    if x == 0:
        return "0"
    mantissa, e, exponent = f"{x:.17g}".partition("e")
    return mantissa + (f"e{int(exponent)}" if e else "")


def json_text(value) -> str:
    """Canonical JSON of Python data, floats included: keys in the order of their UTF-8 bytes, no spaces."""
    if isinstance(value, float):
        return float_text(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{json_text(value[k])}" for k in sorted(value, key=str.encode)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(json_text, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def canonical_json_floats(text: Column) -> Column:
    """Canonical JSON of a JSON text, floats included; null for null, malformed or repeated keys."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def pairs(items):
            if len(dict(items)) < len(items):
                raise ValueError("repeated key")
            return dict(items)

        def one(x):
            try:
                return None if x is None else json_text(json.loads(x, object_pairs_hook=pairs))
            except (ValueError, RecursionError):
                return None

        return pd.Series([one(x) for x in s], dtype=object)

    return run(text)


def json_object(**fields: Column) -> Column:
    """Canonical JSON of columns without floats, in the JVM: sorted keys, null fields left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields, key=str.encode)]))


def raw_object(**texts: Column) -> Column:
    """A JSON object whose members are JSON texts already, in sorted order."""
    parts = []
    for i, k in enumerate(sorted(texts, key=str.encode)):
        parts += [F.lit(("," if i else "{") + json.dumps(k) + ":"), texts[k]]
    return F.concat(*parts, F.lit("}"))


def quoted(text: Column) -> Column:
    """A string as JSON text."""
    whole = F.to_json(F.struct(text.alias("s")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


# ------------------------------------------------------------------------------------------------ requests


def args_hash(args: Column) -> Column:
    """Of canonical JSON."""
    return sha256(args, prefixed=True)


def request_key(artifact_hash: Column, step_id: Column, args_hash: Column, ordinal: Column | None = None, cursor: Column | None = None, process: Column | None = None) -> Column:
    optional = {k: v for k, v in (("history_cursor", cursor), ("process_id", process)) if v is not None}
    ordinal = F.lit(1).cast("long") if ordinal is None else ordinal
    return sha256(json_object(artifact_hash=artifact_hash, step_id=step_id, request_ordinal=ordinal, args_hash=args_hash, **optional), prefixed=True)


def obligation_id(artifact_id: Column, step_id: Column, request_id: Column, kind: str = RECEIPT_VALID) -> Column:
    """Of the fields in the order of their declaration, which isn't sorted."""
    seed = F.struct(artifact_id.alias("artifact_id"), step_id.alias("step_id"), request_id.alias("request_id"), F.lit(kind).alias("obligation_type"))
    return sha256(F.to_json(seed), prefixed=True)


def run_id(input_digest: Column) -> Column:
    return F.concat(F.lit("run-"), F.substring(input_digest, 1, 16))


def delivery_id(medium: str, run: Column, inputs_digest: Column) -> Column:
    """Request id of a delivery by ``webhook`` or ``file``."""
    return F.concat(F.lit(f"{medium}-"), F.substring(sha256(json_object(run_id=run, inputs_digest=inputs_digest, medium=F.lit(medium))), 1, 16))


def mediated(customer: Column, change: Column, value: Column, correlation: Column, source: str) -> Column:
    """A parsed record as the event that goes on: five fields and the payload."""
    payload = F.struct(customer.alias("customer_id"), change.alias("change_type"), value.alias("new_value"))
    subject = F.concat(F.lit("customer/"), F.coalesce(customer, F.lit("")))
    return F.struct(F.lit("customer.change").alias("event_type"), subject.alias("subject"), F.lit(source).alias("source"), correlation.alias("correlation_id"), payload.alias("payload"))


def reveal(profile: Column, requested: Column, always: str = "subject_id") -> Column:
    """The requested fields of a map that it has; ``always`` stays whether asked for or not. Requests are trimmed, lower case."""
    asked = F.transform(requested, lambda x: F.lower(F.trim(x)))
    return F.map_filter(profile, lambda k, _: (k == always) | F.coalesce(F.array_contains(asked, k), F.lit(False)))


def receipt_digest(receipt: Column, fields: list[str]) -> Column:
    """Of a receipt struct without its own digest."""
    return sha256(json_object(**{f: receipt[f] for f in fields if f != "receipt_digest"}))


# ------------------------------------------------------------------------------------------------ ledgers


def event_hash(sequence: Column, prev_hash: Column, event: Column) -> Column:
    """Of an entry; ``event`` is canonical JSON."""
    return sha256(raw_object(sequence=sequence.cast("string"), prev_hash=quoted(prev_hash), event=event))


def build_ledger(events: DataFrame, ledger: str, order: list[str], event: str, heads: DataFrame | None = None) -> DataFrame:
    """Appends events (canonical JSON) in order: sequence, prev_hash and event_hash for each.

    ``heads`` (ledger, head, entries) are the ledgers so far. A chain is sequential by nature: a ledger is one task's
    stream, of which it holds a batch; ledgers are built side by side. Events that tie in ``order`` follow by their text,
    so a chain that is built twice has the same hashes.

    The numbering is a window, which holds each ledger together in order whatever adaptive execution makes of the plan
    below it; an explicit repartition is left out over a join that is partitioned already, which then may become a
    broadcast join that reads its rows map by map.
    """
    if heads is not None:
        so_far = heads.select(F.col(ledger).alias("_ledger"), F.col("head").alias("_head"), F.col("entries").cast("long").alias("_entries"))
        df = events.join(so_far, F.col(ledger).eqNullSafe(F.col("_ledger")), "left")
    else:
        df = events.withColumn("_head", F.lit(None).cast("string")).withColumn("_entries", F.lit(None).cast("long"))
    names = events.columns
    at_event = names.index(event)
    new = [T.StructField("sequence", T.LongType()), T.StructField("prev_hash", T.StringType()), T.StructField("event_hash", T.StringType())]

    def run(batches):
        n, head = 0, R.GENESIS
        for batch in batches:
            made = [], [], []
            columns = [batch.column(i).to_pylist() for i in (at_event, *range(len(names), len(names) + 3))]
            for text, start, entries, place in zip(*columns, strict=True):
                if place == 1:
                    n, head = entries or 0, start or R.GENESIS
                n += 1
                scope = f'{{"event":{text},"prev_hash":"{head}","sequence":{n}}}'
                made[0].append(n)
                made[1].append(head)
                head = hashlib.sha256(scope.encode()).hexdigest()
                made[2].append(head)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(made[0], pa.int64()), pa.array(made[1], pa.string()), pa.array(made[2], pa.string())], names=[*names, *(f.name for f in new)])

    place = F.row_number().over(Window.partitionBy(ledger).orderBy(*order, event))
    ordered = df.select(*names, "_head", "_entries", place.alias("_place"))
    return ordered.mapInArrow(run, T.StructType([*[events.schema[c] for c in names], *new]))


def check_ledger(df: DataFrame, ledger: str, event: str = "event") -> DataFrame:
    """Adds link_ok, sequence_ok and hash_ok: an event that was tampered with fails though its links hold."""
    own = event_hash(F.col("sequence"), F.col("prev_hash"), F.col(event))
    return R.verify_chain(df, ledger, "sequence", "prev_hash", "event_hash").withColumn("hash_ok", F.coalesce(own == F.col("event_hash"), F.lit(False)))


def ledger_lines(df: DataFrame, event: str = "event") -> DataFrame:
    """Entries as the lines of a JSONL file."""
    line = raw_object(event=F.col(event), event_hash=quoted(F.col("event_hash")), prev_hash=quoted(F.col("prev_hash")), sequence=F.col("sequence").cast("string"))
    return df.withColumn("value", line)


def parse_ledger(lines: DataFrame, column: str = "value") -> DataFrame:
    """sequence, prev_hash, event_hash and canonical event of JSONL lines; blank lines are skipped, others kept, with nulls."""
    rows = lines.where(F.length(F.trim(column)) > 0)
    fields = F.from_json(column, "sequence long, prev_hash string, event_hash string")
    return rows.withColumn("_f", fields).withColumn("event", canonical_json_floats(F.get_json_object(column, "$.event"))).select(*[c for c in lines.columns if c != column], "_f.*", "event")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSONL files (a trace, a ledger) that aren't blank."""
    return spark.read.text(path).where(F.length(F.trim("value")) > 0)


def write_lines(df: DataFrame, path: str, **fields: Column) -> None:
    """One canonical line for each row, of columns without floats."""
    df.select(json_object(**fields).alias("value")).write.text(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return parse_ledger(spark.read.text(path))


def export_chain(df: DataFrame, ledger: str, heads: DataFrame) -> DataFrame:
    """Entries up to each asked head; a head that its ledger doesn't hold fails the job."""
    known = heads.join(df.select(ledger, F.col("event_hash").alias("head"), F.col("sequence").alias("_last")), [ledger, "head"], "left")
    known = known.groupBy(ledger, "head").agg(F.min("_last").alias("_last"))
    known = known.withColumn("_last", F.coalesce("_last", F.raise_error(F.concat(F.lit("head_hash not found: "), F.col("head"))).cast("long")))
    return df.join(known, ledger).where(F.col("sequence") <= F.col("_last")).drop("_last")


# ------------------------------------------------------------------------------------------------ formats


def well_formed(text: Column, kind: str) -> Column:
    return F.coalesce(text.rlike(FORMATS[kind]), F.lit(False))


def safe_relative_path(path: Column) -> Column:
    """Why a path could leave its folder, null if it can't."""
    inner = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = F.exists(inner, lambda p: p == "..") | path.startswith("./") | (path == ".")
    return (
        F.when(F.contains(path, F.lit("\\")), "backslash").when(path.startswith("/"), "absolute").when(up, "segments").when(F.size(inner) == 0, "empty")
    )


def integer(text: Column) -> Column:
    """A whole number from text, floats with nothing behind the point included; null for anything else."""
    t = F.trim(text.cast("string"))
    number = F.when(t.rlike(r"^[+-]?\d+$"), F.expr("1")).when(t.rlike(r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"), F.expr("2"))
    whole = t.try_cast("double")
    return F.when(number == 1, t.try_cast("long")).when((number == 2) & (whole == F.floor(whole)), whole.try_cast("long"))


def normal_digest(text: Column) -> Column:
    """Trimmed, lower case, without its algorithm; null where nothing is left."""
    t = F.regexp_replace(F.lower(F.trim(text)), "^sha256:", "")
    return F.when(t != "", t)
