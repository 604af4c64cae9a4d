"""Statistics, chains, obligations, capabilities and digests over relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
#: The order of failure codes, by namespace and within it.
NAMESPACES = ("KERNEL", "EVAL", "PROTOCOL", "CAPABILITY")
LEAVES = {
    "EVAL": ("E_ARTIFACT_IDENTITY", "E_STEP_IDENTITY", "E_STATE_INVALID", "E_HISTORY_CURSOR", "E_CONTEXT_SNAPSHOT_MISSING", "E_CONTEXT_SNAPSHOT_MISMATCH",
             "E_TRIGGER_ITEM_INVALID", "E_STEP_CONTRACT", "E_REQUEST_CANONICALIZATION"),
    "PROTOCOL": ("unknown_capability", "request_hash_mismatch", "untrusted_signer", "signature_invalid", "schema_mismatch", "policy_violation",
                 "payload_hash_mismatch", "missing_receipt", "outcome_disallowed", "missing_event_type", "correlation_mismatch", "invalid_correlation_rule",
                 "missing_timer_evidence", "timer_untrusted", "timer_time_invalid", "timer_before_deadline"),
    "CAPABILITY": ("missing_required_capability", "incompatible_version", "incompatible_config_hash", "constraint_violation", "untrusted_or_missing_trust_anchor"),
}


# ---------------------------------------------------------------------------------------------- statistics


def group_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, median, extremes and sample deviation (0 for one row) of each group."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias("runs"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stddev"),
    )


def best_per_group(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The row of greatest value in each group; ties to the smaller name. One aggregation, no sort."""
    best = F.max(F.struct(F.col(value), (-F.col(name)).alias("n"))).alias("b")
    return df.groupBy(key).agg(best).select(key, (-F.col("b.n")).alias(name), F.col(f"b.{value}").alias(value))


def rank_in_group(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), name)))


def regression(baseline: DataFrame, candidate: DataFrame, keys: list[str], value: str, limit: float) -> DataFrame:
    """Relative change from the baseline in percent; a missing side or a loss beyond ``limit`` fails."""
    b = baseline.select(*keys, F.col(value).alias("baseline"))
    c = candidate.select(*keys, F.col(value).alias("candidate"))
    out = b.join(c, keys, "left").withColumn("delta_percent", (F.col("candidate") - F.col("baseline")) / F.col("baseline") * 100)
    return out.withColumn("ok", F.coalesce(F.col("delta_percent") >= -limit, F.lit(False)))


def checksum_status(df: DataFrame, group: str, checksum: str) -> DataFrame:
    return df.groupBy(group).agg(F.countDistinct(checksum).alias("checksums")).withColumn("identical", F.col("checksums") == 1)


# ---------------------------------------------------------------------------------------------- chains


#: Sequence numbers that one task checks together.
CHAIN_BLOCK = 1 << 16


def verify_chain(df: DataFrame, ledger: str, sequence: str, previous: str, digest: str, block: int = CHAIN_BLOCK) -> DataFrame:
    """Each entry's link and sequence check.

    Sequence numbers are dense, so a ledger is cut into blocks of them that are checked side by side, however long it is;
    a block begins with the last hash and the count of those before it, one row for each block.
    """
    cut = df.withColumn("_block", F.coalesce(F.floor(F.col(sequence) / block), F.lit(-1)).cast("long"))
    edges = cut.groupBy(F.col(ledger).alias("_l"), F.col("_block").alias("_b")).agg(F.max_by(digest, sequence).alias("_last"), F.count("*").alias("_n"))
    along = Window.partitionBy("_l").orderBy("_b")
    before = F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = edges.select("_l", "_b", F.lag("_last").over(along).alias("_head"), before.alias("_before"))
    own = Window.partitionBy(ledger, "_block").orderBy(sequence)
    both = cut.join(edges, F.col(ledger).eqNullSafe(F.col("_l")) & (F.col("_block") == F.col("_b")))
    linked = F.col(previous) == F.coalesce(F.lag(digest).over(own), F.col("_head"), F.lit(GENESIS))
    return both.select(*[F.col(c) for c in df.columns], linked.alias("link_ok"), (F.col(sequence) == F.col("_before") + F.row_number().over(own)).alias("sequence_ok"))


def strictly_rising(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("rising", F.coalesce(F.col(value) > F.lag(value).over(w), F.lit(True)))


def chain_head(df: DataFrame, ledger: str, sequence: str, digest: str) -> DataFrame:
    return df.groupBy(ledger).agg(F.max_by(digest, sequence).alias("head"), F.count("*").alias("entries"))


def prefix_until(df: DataFrame, ledger: str, sequence: str, digest: str, heads: DataFrame) -> DataFrame:
    """The entries of each ledger up to and with its head (``heads``: ledger, head)."""
    at = df.join(heads, [ledger]).where(F.col(digest) == F.col("head")).groupBy(ledger).agg(F.min(sequence).alias("last"))
    return df.join(at, ledger).where(F.col(sequence) <= F.col("last")).drop("last")


def first_seen(df: DataFrame, group: str, order: str, digest: str) -> DataFrame:
    """Distinct digests of each group with their place in first-seen order."""
    seen = df.groupBy(group, digest).agg(F.min(order).alias("first"))
    return seen.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("first", digest)))


# ---------------------------------------------------------------------------------------------- obligations


def satisfy(obligations: DataFrame, receipts: DataFrame, trusted: list[str] | None = None) -> DataFrame:
    """Each obligation (step, request_hash) with its first acceptable receipt and, without one, its failure codes.

    Receipts: request_hash, history_index, receipt_hash, signer, signature_valid. Without trusted signers a receipt of
    the same request is acceptable as it is.
    """
    known = lambda c: F.coalesce(c, F.lit(False))
    trust = known(F.col("signer").isin(trusted)) if trusted is not None else F.lit(True)
    sound = trust & known(F.col("signature_valid")) if trusted is not None else F.lit(True)
    first = F.min(F.when(sound, F.struct("history_index", "receipt_hash"))).alias("best")
    flags = [F.bool_or(~trust).alias("untrusted"), F.bool_or(trust & ~sound).alias("unsound")]
    per = receipts.groupBy("request_hash").agg(first, F.count("*").alias("matched"), *flags)
    out = obligations.join(per, "request_hash", "left").withColumn("satisfied", F.col("best").isNotNull())
    tried = F.array_compact(F.array(F.when(F.col("untrusted"), F.lit("PROTOCOL.untrusted_signer")), F.when(F.col("unsound"), F.lit("PROTOCOL.signature_invalid"))))  # in their order
    missing = F.when(F.col("matched").isNull(), F.array(F.lit("PROTOCOL.missing_receipt"))).otherwise(tried)
    return out.select(
        "step", "request_hash", "satisfied", F.col("best.receipt_hash").alias("receipt_hash"), F.coalesce("matched", F.lit(0)).alias("matched"),
        F.when(F.col("satisfied"), F.array().cast("array<string>")).otherwise(missing).alias("codes"),
    )


def join_steps(satisfied: DataFrame, policy: str = "all_of") -> DataFrame:
    """Whether each step goes on or suspends."""
    fold = F.bool_and if policy == "all_of" else F.bool_or
    return satisfied.groupBy("step").agg(fold("satisfied").alias("satisfied")).withColumn("control", F.when(F.col("satisfied"), "continue").otherwise("suspend"))


def ordered_codes(codes: Column) -> Column:
    """Distinct codes by namespace, by place within it, then by text; unknown ones last."""
    ranks = {f"{n}.{leaf}": i for n, ls in LEAVES.items() for i, leaf in enumerate(ls, 1)}
    table = F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))])
    space = F.create_map(*[x for i, n in enumerate(NAMESPACES, 1) for x in (F.lit(n), F.lit(i))])
    last = F.lit(2**31 - 1)
    key = lambda c: F.struct(F.coalesce(space[F.split_part(c, F.lit("."), F.lit(1))], last).alias("n"), F.coalesce(table[c], last).alias("l"), c.alias("c"))
    return F.transform(F.array_sort(F.array_distinct(F.transform(codes, key))), lambda s: s["c"])


def collect_codes(df: DataFrame, group: str, codes: str) -> DataFrame:
    """Each group's distinct codes in order, groups without any left out.

    Known codes travel as bits of one number, so the aggregation combines early and holds no lists; others are collected.
    """
    known = [f"{n}.{leaf}" for n in NAMESPACES for leaf in LEAVES.get(n, ())]
    table = F.create_map(*[x for i, c in enumerate(known) for x in (F.lit(c), F.lit(i))])
    one = df.select(group, F.explode(codes).alias("code")).withColumn("bit", table[F.col("code")])
    per = one.groupBy(group).agg(F.bit_or(F.when(F.col("bit").isNotNull(), F.expr("shiftleft(1L, bit)"))).alias("bits"), F.collect_set(F.when(F.col("bit").isNull(), F.col("code"))).alias("others"))
    own = F.array_compact(F.array(*[F.when(F.coalesce("bits", F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0, F.lit(c)) for i, c in enumerate(known)]))
    return per.select(group, F.when(F.size("others") == 0, own).otherwise(ordered_codes(F.concat(own, "others"))).alias("codes"))


def find_first(df: DataFrame, condition: Column, order: list[str]) -> DataFrame:
    """The first row that fits, in order; one row at most, found without sorting the rest."""
    return df.where(condition).orderBy(*order).limit(1)


# ---------------------------------------------------------------------------------------------- capabilities

#: The stages of a match, in order, and the code and rank of failing at each of them.
STAGES = ("capability", "version", "config_hash", "operations", "constraints", "trust_anchors")
CODES = ("missing_required_capability", "incompatible_version", "incompatible_version", "constraint_violation", "constraint_violation", "untrusted_or_missing_trust_anchor")
RANKS = (1, 2, 2, 4, 4, 5)
#: How a requirement's value of each kind of constraint must stand to the environment's.
KINDS = {
    "set": lambda a, e: F.size(F.array_except(a, e)) == 0,
    "max": lambda a, e: a <= e,
    "flag": lambda a, e: ~a | e,
    "raw": lambda a, e: a == e,
}
#: A requirement's trust anchors, the environment's that they are held against, and whether all must be there.
ANCHORS = (
    ("signer_keys_all_of", "trusted_signer_keys", True), ("signer_keys_any_of", "trusted_signer_keys", False), ("signature_algs", "allowed_signature_algs", True),
    ("cert_roots_all_of", "trusted_cert_roots", True), ("cert_roots_any_of", "trusted_cert_roots", False),
)


def alternative_stages(alternatives: DataFrame, environment: DataFrame, constraints: dict[str, str] | None = None) -> DataFrame:
    """(requirement_id, alternative, stage): the place in STAGES where each alternative fails, their number if it passes.

    Alternatives: requirement_id, alternative, capability_id, version, operations and, if there are any, config_hash,
    the constraints and the first column of ANCHORS. Environment: capability_id, version, operations and, where the
    alternatives ask for them, config_hash, the constraints and the second column of ANCHORS. ``constraints`` names the
    kind (of KINDS) of each constraint's column. A null or an empty set asks for nothing; what the environment lacks
    does not fit. A stage that no entry passes fails, so an alternative's stage is the furthest of its entries.
    """
    names = [c for c in environment.columns if c != "capability_id"]
    e = environment.select("capability_id", *[F.col(c).alias(f"e_{c}") for c in names], F.lit(True).alias("e_"))
    pair = alternatives.join(e, "capability_id", "left")

    def fits(own: str, other: str, test) -> Column:
        if own not in alternatives.columns:
            return F.lit(True)
        return F.col(own).isNull() | (F.coalesce(test(F.col(own), F.col(f"e_{other}")), F.lit(False)) if other in names else F.lit(False))

    def anchored(own: str, other: str, every: bool) -> Column:
        if own not in alternatives.columns:
            return F.lit(True)
        there = F.coalesce(F.col(f"e_{other}"), F.array().cast(alternatives.schema[own].dataType)) if other in names else F.array().cast(alternatives.schema[own].dataType)
        common = F.size(F.array_intersect(F.col(own), there))
        return F.col(own).isNull() | (F.size(own) == 0) | (common == F.size(F.array_distinct(own)) if every else common > 0)

    both = lambda tests: reduce(Column.__and__, tests, F.lit(True))
    tests = (
        F.col("e_").isNotNull(), F.coalesce(F.col("version") == F.col("e_version"), F.lit(False)), fits("config_hash", "config_hash", KINDS["raw"]), fits("operations", "operations", KINDS["set"]),
        both([fits(c, c, KINDS[kind]) for c, kind in ({"most": "max"} if constraints is None else constraints).items()]), both([anchored(*a) for a in ANCHORS]),
    )
    stage = F.coalesce(*[F.when(~t, F.lit(i)) for i, t in enumerate(tests)], F.lit(len(STAGES)))
    return pair.withColumn("stage", stage).groupBy("requirement_id", "alternative").agg(F.max("stage").alias("stage"))


def match_capabilities(alternatives: DataFrame, environment: DataFrame, constraints: dict[str, str] | None = None) -> DataFrame:
    """For each requirement its verdict: the first passing alternative, else the code of lowest rank among the failures."""
    per = alternative_stages(alternatives, environment, constraints)
    passed = F.col("stage") == len(STAGES)
    failure = F.struct(F.element_at(F.array(*map(F.lit, RANKS)), F.col("stage") + 1), F.concat(F.lit("CAPABILITY."), F.element_at(F.array(*map(F.lit, CODES)), F.col("stage") + 1)).alias("code"))
    best = per.groupBy("requirement_id").agg(F.min(F.when(passed, F.col("alternative"))).alias("chosen"), F.min(F.when(~passed, failure)).alias("failure"))
    return best.select(
        "requirement_id", "chosen", F.when(F.col("chosen").isNotNull(), "accepted").otherwise("reject").alias("verdict"), F.when(F.col("chosen").isNull(), F.col("failure.code")).alias("code"),
    )


def verdicts(matches: DataFrame, request: str, absence: Column) -> DataFrame:
    """Each request's status over its requirements: accepted, accepted_with_soft_gaps, or what ``absence`` says.

    Matches: the request, requirement_id, optional, and chosen and code of ``match_capabilities``. ``absence`` (suspend or
    reject, a column of the request) counts where a required one is unmet. The primary failure is that of the first
    unmet required one.
    """
    unmet = F.col("chosen").isNull()
    hard = unmet & ~F.col("optional")
    per = matches.withColumn("absence", absence).groupBy(request).agg(
        F.count_if(hard).alias("unmet_required"), F.count_if(unmet & F.col("optional")).alias("unmet_optional"),
        F.min(F.when(hard, F.struct("requirement_id", "code"))).alias("first"), F.min("absence").alias("absence"),
    )
    status = F.when((F.col("unmet_required") == 0) & (F.col("unmet_optional") == 0), "accepted").when(F.col("unmet_required") == 0, "accepted_with_soft_gaps").otherwise(F.col("absence"))
    return per.select(request, status.alias("status"), "unmet_required", "unmet_optional", F.col("first.code").alias("primary_failure"))


def constraint_kind(field: str, example) -> str:
    """The kind of a constraint, by its name before its value."""
    if field.endswith("allowlist") or field.endswith("allow/list"):
        return "set"
    if field.startswith(("max_", "max/")):
        return "max"
    if field.startswith(("allow_", "allow/")):
        return "flag"
    return "flag" if isinstance(example, bool) else "max" if isinstance(example, int) else "set" if isinstance(example, (list, set, tuple)) else "raw"


def disjoint(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) == 0


def mentions(text: Column, part: str) -> Column:
    """Whether a text holds a part, in any case."""
    return F.contains(F.lower(text), F.lit(part.lower()))


def newest(df: DataFrame, group: str, time: str, name: str) -> DataFrame:
    """The latest row of each group (ties: the greater name) and how many there are; one aggregation."""
    return df.groupBy(group).agg(F.max(F.struct(time, name)).alias("b"), F.count("*").alias("n")).select(group, f"b.{time}", f"b.{name}", "n")


# ---------------------------------------------------------------------------------------------- digests


def digest(*parts: Column, separator: str = "|") -> Column:
    return F.sha2(F.concat_ws(separator, *parts), 256)


def artifacts(df: DataFrame, content: str) -> DataFrame:
    """One row per distinct content, by its digest."""
    return df.where(F.col(content).isNotNull()).groupBy(F.sha2(content, 256).alias("digest")).agg(F.count("*").alias("copies"), F.max(F.octet_length(content)).alias("bytes"))


def union_pivot(df: DataFrame, tag: str, value: str, variants: list[str]) -> DataFrame:
    """One nullable column per variant of a tagged value."""
    return df.select("*", *[F.when(F.col(tag) == v, F.col(value)).alias(v) for v in variants])
