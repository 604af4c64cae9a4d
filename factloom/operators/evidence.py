"""Evidence: receipts with every check, signed values and thresholds, bundles, the artifact store, vector runs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import ed25519
from factloom.functions import values as V
from factloom.operators import identity as I
from factloom.operators import relational as R

# ------------------------------------------------------------------------------------------------ receipts

RECEIPT = {
    "request_id": "string", "signer_key_id": "string", "signature_valid": "boolean", "payload_hash_valid": "boolean", "capability_id": "string",
    "capability_version": "string", "operation": "string", "outcome": "string",
}


def check_receipts(obligations: DataFrame, receipts: DataFrame, trusted: DataFrame | list[str]) -> DataFrame:
    """Obligations against receipts of their request with every check; satisfied, the receipt, or the codes of all tried.

    Obligations: step, request_hash and, where they ask for it, capability_id, capability_version, operation (together)
    and allowed_outcomes. Receipts: request_hash, history_index, receipt_hash and the columns of RECEIPT. ``trusted``:
    keys, or a small table of them (key_id). Receipts are joined to the obligations of their request and reduced at
    once, so a request with very many receipts is aggregated where they are.
    """
    need = {c: (F.col(c) if c in obligations.columns else F.lit(None).cast("array<string>" if c == "allowed_outcomes" else "string")).alias(f"o_{c}")
            for c in ("capability_id", "capability_version", "operation", "allowed_outcomes")}
    asked = obligations.select("step", "request_hash", *need.values())
    if isinstance(trusted, list):
        known = receipts.withColumn("_trusted", F.col("signer_key_id").isin(trusted))
    else:
        known = receipts.join(trusted.select(F.col("key_id").alias("signer_key_id"), F.lit(True).alias("_trusted")).distinct(), "signer_key_id", "left")
    trust = F.coalesce("_trusted", F.lit(False))
    fine = lambda c: F.coalesce(c, F.lit(False))
    tuple_ok = fine((F.col("capability_id") == F.col("o_capability_id")) & (F.col("capability_version") == F.col("o_capability_version")) & (F.col("operation") == F.col("o_operation")))
    failures = {
        "PROTOCOL.request_hash_mismatch": F.col("request_id").isNotNull() & (F.lower("request_id") != F.lower("request_hash")),
        "PROTOCOL.untrusted_signer": ~trust,
        "PROTOCOL.signature_invalid": trust & ~fine(F.col("signature_valid")),
        "PROTOCOL.payload_hash_mismatch": ~fine(F.col("payload_hash_valid")),
        "PROTOCOL.unknown_capability": F.col("o_capability_id").isNotNull() & ~tuple_ok,
        "PROTOCOL.outcome_disallowed": F.col("o_allowed_outcomes").isNotNull() & ~fine(F.array_contains("o_allowed_outcomes", F.col("outcome"))),
    }
    flags = [F.bool_or(c).alias(f"f{i}") for i, c in enumerate(failures.values())]
    any_failure = F.lit(False)
    for c in failures.values():
        any_failure = any_failure | c
    both = asked.join(known.drop("step"), "request_hash")
    first = F.min(F.when(~any_failure, F.struct("history_index", "receipt_hash"))).alias("best")
    per = both.groupBy("step", "request_hash").agg(first, F.count("*").alias("matched"), *flags)
    out = asked.select("step", "request_hash").distinct().join(per, ["step", "request_hash"], "left")
    met = F.col("best").isNotNull()
    # the codes stand in the order that ranks them
    ranked = sorted(failures, key=lambda c: R.LEAVES["PROTOCOL"].index(c.split(".")[1]))
    tried = F.array_compact(F.array(*[F.when(F.col(f"f{list(failures).index(c)}"), F.lit(c)) for c in ranked]))
    none = F.array().cast("array<string>")
    return out.select(
        "step", "request_hash", met.alias("satisfied"), F.col("best.receipt_hash").alias("receipt_hash"), F.coalesce("matched", F.lit(0)).alias("matched"),
        F.when(met, none).when(F.col("matched").isNull(), F.array(F.lit("PROTOCOL.missing_receipt"))).otherwise(tried).alias("codes"),
    )


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    """Receipt messages of a folder: history_index, receipt_hash, path, message; files named otherwise are no receipts."""

    @F.pandas_udf("string")
    def canonical_hash(messages: pd.Series) -> pd.Series:
        def one(m):
            try:
                return "sha256:" + hashlib.sha256(V.encode(V.canonical(V.decode(bytes(m))))).hexdigest()
            except ValueError:
                return None

        return pd.Series([one(m) for m in messages], dtype=object)

    files = spark.read.format("binaryFile").load(path)
    index = F.regexp_extract("path", r"/(\d{20})\.receipt\.[a-z]+\.bin$", 1)
    found = files.where(index != "")
    return found.select(index.cast("decimal(20,0)").alias("history_index"), canonical_hash("content").alias("receipt_hash"), "path", F.col("content").alias("message"))


def read_trust_anchors(spark: SparkSession, path: str) -> DataFrame:
    """key_id (the file's name up to its first dot) and public_key (32 raw bytes, or 64 hexadecimal digits)."""
    files = spark.read.format("binaryFile").load(path)
    text = F.trim(F.col("content").cast("string"))
    key = F.when(F.octet_length("content") == 32, F.col("content")).when(text.rlike("^[0-9a-fA-F]{64}$"), F.unhex(text))
    return files.select(F.regexp_extract("path", r"/([^/.]+)[^/]*$", 1).alias("key_id"), key.alias("public_key")).where("public_key is not null")


# ------------------------------------------------------------------------------------------------ signatures


@dataclass
class Policy:
    domain: str
    trusted: list[str]
    algorithms: list[str]
    threshold: int = 1

    @property
    def scope(self) -> str:
        return self.domain.replace(":", "_")


def verify_signed(signatures: DataFrame, accepted: DataFrame, policy: Policy, verifier: Callable) -> DataFrame:
    """For each value: verified signatures and the first error in order, null where it holds.

    Signatures: value_id, place, key_id, alg, scope, payload_digest, sig. Accepted: value_id, payload_digest (one row, or
    more where several digests do). ``verifier(key_id, alg, domain, digest, sig)`` is a column expression giving a
    boolean: the cryptography is injected.
    """
    s = signatures.join(accepted.select("value_id", "payload_digest", F.lit(True).alias("_ok")).distinct(), ["value_id", "payload_digest"], "left")
    again = F.row_number().over(Window.partitionBy("value_id", "key_id").orderBy("place")) > 1
    verified = verifier(F.col("key_id"), F.col("alg"), F.lit(policy.domain), F.col("payload_digest"), F.col("sig"))
    missing = lambda c: ~F.coalesce(c, F.lit(False))
    error = (
        F.when(missing(F.col("key_id").isin(policy.trusted)), "untrusted key_id").when(missing(F.col("alg").isin(policy.algorithms)), "disallowed alg")
        .when(missing(F.col("scope") == policy.scope), "scope mismatch").when(missing(F.col("_ok")), "payload digest mismatch")
        .when(again, "duplicate key_id").when(missing(verified), "verification failed")
    )
    per = s.withColumn("_e", error).groupBy("value_id").agg(F.count_if(F.col("_e").isNull()).alias("n"), F.min(F.when(F.col("_e").isNotNull(), F.struct("place", "_e"))).alias("first"))
    out = accepted.select("value_id").distinct().join(per, "value_id", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("value_id", n.alias("verified"), F.coalesce("first._e", F.when(n < policy.threshold, F.lit("threshold not met"))).alias("error"))


def _map(value, tag: str, allowed: tuple, needed: tuple) -> dict:
    if value[0] != "tagged" or value[1][0] != tag or value[1][1][0] != "map":
        raise V.ValueFormatError(f"{tag}: expected a tagged map")
    entries = value[1][1][1]
    if any(k[0] != "keyword" or k[1] not in allowed for k, _ in entries):
        raise V.ValueFormatError(f"{tag}: unknown key")
    out = {k[1]: v for k, v in entries}
    if missing := [n for n in needed if n not in out]:
        raise V.ValueFormatError(f"{tag}: missing {missing[0]}")
    return out


def _scalar(value, kinds: tuple, what: str):
    if value[0] not in kinds:
        raise V.ValueFormatError(f"signature: {what} must be {' or '.join(kinds)}")
    return value[1]


def signed_parts(value) -> tuple[list[str], list[dict]]:
    """Of a signed value or a manifest: the payload digests that signatures may name, and the signatures in order.

    A manifest is signed without its signatures or with an empty list of them; both digests count.
    """
    digest = lambda v: hashlib.sha256(V.encode(V.canonical(v))).hexdigest()
    tag = value[1][0] if value[0] == "tagged" else ""
    if tag == "manifest":
        m = _map(value, tag, ("format", "root", "objects", "policy", "attestations", "signatures"), ("format", "root", "policy", "objects", "signatures"))
        if m["policy"][0] != "map" or m["objects"][0] != "vector" or m.get("attestations", ("vector",))[0] != "vector":
            raise V.ValueFormatError("manifest: policy is a map, objects and attestations are vectors")
        rest = [(k, v) for k, v in value[1][1][1] if k[1] != "signatures"]
        empty = [*rest, (("keyword", "signatures"), ("vector", []))]
        accepted = [digest(("tagged", (tag, ("map", body)))) for body in (rest, empty)]
    else:
        m = _map(value, "signed", ("payload", "signatures", "meta"), ("payload", "signatures"))
        accepted = [digest(m["payload"])]
    if m["signatures"][0] != "vector":
        raise V.ValueFormatError("signatures must be a vector")
    out = []
    for place, one in enumerate(m["signatures"][1]):
        needed = ("key_id", "alg", "scope", "payload_digest", "sig")
        f = _map(one, "signature", (*needed, "created", "purpose", "claims"), needed)
        d = _map(f["payload_digest"], "digest", ("alg", "hex"), ("alg", "hex"))
        out.append({
            "place": place, "key_id": _scalar(f["key_id"], ("string", "keyword"), "key_id"), "alg": _scalar(f["alg"], ("keyword",), "alg"), "scope": _scalar(f["scope"], ("keyword",), "scope"),
            "payload_digest": _scalar(d["hex"], ("string",), "hex"), "sig": _scalar(f["sig"], ("bytes",), "sig"),
        })
    return accepted, out


SIGNED = "struct<accepted array<string>, signatures array<struct<place int, key_id string, alg string, scope string, payload_digest string, sig binary>>, error string>"


def read_signed(df: DataFrame, value_id: str, column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures, accepted digests and unreadable rows (value_id, error) of a column of value texts, for ``verify_signed``."""

    @F.pandas_udf(SIGNED)
    def parts(s: pd.Series) -> pd.DataFrame:
        def one(text):
            try:
                return *signed_parts(V.parse(text)), None
            except (ValueError, RecursionError) as e:
                return None, None, str(e)

        return pd.DataFrame([one(x) for x in s], columns=["accepted", "signatures", "error"])

    read = df.select(F.col(value_id).alias("value_id"), parts(column).alias("p"))
    fine = read.where("p.error IS NULL")
    signatures = fine.select("value_id", F.explode("p.signatures").alias("s")).select("value_id", "s.*")
    return signatures, fine.select("value_id", F.explode("p.accepted").alias("payload_digest")), read.where("p.error IS NOT NULL").select("value_id", "p.error")


def verify_receipts(df: DataFrame, body: str, key: str, signature: str, domain: str, into: str = "signature_valid") -> DataFrame:
    """Ed25519 over the domain, a zero byte and the signing body. Plain Python: some hundred rows a second and core."""

    @F.pandas_udf("boolean")
    def check(bodies: pd.Series, keys: pd.Series, signatures: pd.Series) -> pd.Series:
        head = domain.encode() + b"\0"
        rows = zip(bodies, keys, signatures, strict=True)
        return pd.Series([None if b is None else k is not None and s is not None and ed25519.verify(bytes(k), head + bytes(b), bytes(s)) for b, k, s in rows], dtype=object)

    return df.withColumn(into, check(body, key, signature))


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """Keyed hash in the JVM, hexadecimal; the secret stays in the plan, so mind who reads it."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inside, outside = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outside, F.unhex(F.sha2(F.concat(inside, message.cast("binary")), 256))), 256)


def signing_token(run: Column, role: Column, digest: Column, nonce: Column, secret: bytes) -> Column:
    """A token of run, role, package digest, nonce and their keyed hash, base64url without padding."""
    signed = hmac_sha256(F.concat_ws("|", run, role, digest, nonce), secret)
    raw = F.base64(F.concat_ws(".", run, role, digest, nonce, signed).cast("binary"))
    return F.regexp_replace(F.translate(F.regexp_replace(raw, r"\s", ""), "+/", "-_"), "=+$", "")


def check_token(token: Column, secret: bytes) -> Column:
    """The parts of a token that holds, null for any other."""
    padded = F.rpad(F.translate(F.trim(token), "-_", "+/"), (F.ceil(F.length(F.trim(token)) / 4) * 4).cast("int"), "=")
    text = F.when(F.trim(token).rlike("^[A-Za-z0-9_-]+$") & (F.length(F.trim(token)) % 4 != 1), F.unbase64(padded).cast("string"))
    p = F.split(text, r"\.")
    part = lambda i: F.get(p, F.lit(i))
    fine = (F.size(p) == 5) & part(2).rlike("^sha256:[0-9a-f]{64}$") & part(3).rlike("^[0-9a-f]{24}$")
    holds = fine & (hmac_sha256(F.concat_ws("|", part(0), part(1), part(2), part(3)), secret) == F.lower(part(4)))
    return F.when(holds, F.struct(part(0).alias("run_id"), part(1).alias("role"), part(2).alias("digest"), part(3).alias("nonce")))


# ------------------------------------------------------------------------------------------------ bundles and artifacts


def read_bundles(spark: SparkSession, root: str) -> DataFrame:
    """Files of the bundles in a folder, one folder each: bundle, path inside it, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    part = lambda i: F.regexp_extract("path", "/" + re.escape(root.rstrip("/").rpartition("/")[2]) + "/([^/]+)/(.+)$", i)
    return files.select(part(1).alias("bundle"), part(2).alias("path"), "content").where("bundle <> ''")


def check_bundles(files: DataFrame, references: DataFrame) -> DataFrame:
    """Bundles' artifacts against their manifests: artifact_hash and code (null where it holds).

    Files: bundle, path, content. References, from the manifests: bundle, path, expected (``sha256:…``).
    """
    hashed = files.select("bundle", "path", I.sha256(F.col("content"), prefixed=True).alias("artifact_hash"))
    unsafe = I.safe_relative_path(F.col("path"))
    code = F.when(unsafe.isNotNull() | F.col("artifact_hash").isNull(), "EVAL.E_STATE_INVALID").when(F.col("artifact_hash") != F.lower("expected"), "EVAL.E_ARTIFACT_IDENTITY")
    return references.join(hashed, ["bundle", "path"], "left").select("bundle", "path", "expected", "artifact_hash", code.alias("code"))


def store_artifacts(df: DataFrame, content: str, path: str) -> None:
    """Writes contents under their digests, each once: what the store has already isn't written again."""
    spark = df.sparkSession
    new = df.where(F.col(content).isNotNull()).select(F.sha2(F.col(content), 256).alias("digest"), F.col(content).alias("content"))
    new = new.groupBy("digest").agg(F.any_value("content").alias("content")).withColumn("prefix", F.substring("digest", 1, 2))
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        new = new.join(spark.read.parquet(path).select("digest"), "digest", "left_anti")
    new.write.mode("append").partitionBy("prefix").parquet(path)


def load_artifacts(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """Contents by digest, hashed anew; status ok, missing or digest_mismatch."""
    found = wanted.select(I.normal_digest(F.col("digest")).alias("digest")).distinct().join(store.select("digest", "content"), "digest", "left")
    status = F.when(F.col("content").isNull(), "missing").when(F.sha2("content", 256) != F.col("digest"), "digest_mismatch").otherwise("ok")
    return found.withColumn("status", status)


def members(digests: DataFrame, index: DataFrame, column: str = "digest") -> DataFrame:
    """Adds ``known``: whether a digest stands in the index."""
    return digests.join(index.select(column, F.lit(True).alias("known")).distinct(), column, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def export_manifest(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """One manifest for each run: its artifacts' digests in first-seen order, trace digest and the manifest's own.

    Runs: run_id, input_digest, final_digest. Steps: run_id, place, step (canonical JSON), digests (array).
    """
    seen = steps.select("run_id", "place", F.posexplode("digests").alias("k", "raw")).withColumn("digest", I.normal_digest(F.col("raw"))).where("digest is not null")
    first = seen.groupBy("run_id", "digest").agg(F.min(F.struct("place", "k")).alias("at"))
    digests = first.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda s: s["digest"]).alias("artifact_digests"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("place", "step"))), lambda s: F.concat(s["step"], F.lit("\n")))
    trace = steps.groupBy("run_id").agg(I.sha256(F.concat_ws("", line)).alias("run_trace_digest"), F.count("*").alias("trace_step_count"))
    out = runs.join(digests, "run_id", "left").join(trace, "run_id", "left")
    out = out.withColumn("artifact_digests", F.coalesce("artifact_digests", F.array().cast("array<string>"))).withColumn("bundle_id", F.concat_ws("-", "run_id", F.substring("final_digest", 1, 12)))
    fields = ("run_id", "input_digest", "final_digest", "run_trace_digest", "trace_step_count", "artifact_digests")
    manifest = I.json_object(bundle_version=F.lit("v0"), **{f: F.col(f) for f in fields})
    return out.withColumn("manifest", manifest).withColumn("manifest_digest", I.sha256(F.col("manifest")))


# ------------------------------------------------------------------------------------------------ vector runs

VECTORS = (
    "schema_version string, format_id string, vectors array<struct<id string, levels array<string>, inputs map<string, struct<path string>>, "
    "expected struct<verdict string, failure_codes array<string>>>>"
)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors of JSON files, in order of their ids, with what is wrong with each (null: nothing)."""
    v = spark.read.schema(VECTORS).json(path, multiLine=True).select(F.explode("vectors").alias("v")).select("v.*")
    paths = F.transform(F.map_values("inputs"), lambda i: i["path"])
    problem = (
        F.when(~I.well_formed(F.col("id"), "vector_id"), "id").when(F.coalesce(F.size("levels"), F.lit(0)) < 1, "levels")
        .when(~F.col("expected.verdict").isin("pass", "fail") | F.col("expected.verdict").isNull(), "verdict")
        .when(F.exists(paths, lambda p: I.safe_relative_path(p).isNotNull()), "path")
        .when(F.exists(F.coalesce("expected.failure_codes", F.array().cast("array<string>")), lambda c: ~I.well_formed(c, "failure_code")), "failure_codes")
    )
    return v.withColumn("problem", problem).orderBy("id")


def run_vectors(vectors: DataFrame, results: DataFrame, stop_at_failure: bool = False) -> DataFrame:
    """Expected against found (id, verdict, failure_codes): passed for each vector; what comes after a stop isn't there."""
    found = results.select("id", F.col("verdict").alias("found"), R.ordered_codes(F.col("failure_codes")).alias("codes"))
    expected = vectors.select("id", F.col("expected.verdict").alias("verdict"), R.ordered_codes(F.coalesce("expected.failure_codes", F.array().cast("array<string>"))).alias("wanted"))
    out = expected.join(found, "id", "left").withColumn("passed", F.coalesce((F.col("verdict") == F.col("found")) & (F.col("wanted") == F.col("codes")), F.lit(False)))
    if stop_at_failure:
        first = out.where(~F.col("passed")).agg(F.min("id").alias("first"))
        out = out.join(F.broadcast(first)).where(F.col("first").isNull() | (F.col("id") <= F.col("first"))).drop("first")  # one row
    return out


def summary(run: DataFrame) -> DataFrame:
    """Counts and all codes of a vector run."""
    return run.agg(
        F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), R.ordered_codes(F.array_distinct(F.flatten(F.collect_set("codes")))).alias("codes")
    )


def append_unique(items: Column, item: Column) -> Column:
    return F.array_union(items, F.array(item))
