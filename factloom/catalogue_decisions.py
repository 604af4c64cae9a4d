"""Queries over decisions: capabilities, receipts, signatures, requests, ledgers, plans, bundles, vector runs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from factloom.functions import expressions as X
from factloom.functions import values as V
from factloom.operators import evidence as E
from factloom.operators import identity as I
from factloom.operators import relational as R
from factloom.plans import evalir, rules
from factloom.query_registry import register, spread, table

# ------------------------------------------------------------------------------------------------ kinds


@register("kernel_kind_strict", """
SELECT o_orderkey AS orderkey, false AS int_is_float, o_custkey = 7 AS ints, o_totalprice = 1000.5 AS floats, CAST(o_custkey AS DOUBLE) < o_totalprice AS mixed_order, false AS text_is_int FROM orders""")
def kernel_kind_strict(spark, sf):
    """Equality is strict about kinds, order isn't between numbers."""
    o = table(spark, sf, "orders")
    c = lambda e: X.compile_expression(e, o.schema)[0]
    key = ["state", "o_custkey"]
    return o.select(
        F.col("o_orderkey").alias("orderkey"), c(["==", key, 7.0]).alias("int_is_float"), c(["==", key, 7]).alias("ints"), c(["==", ["state", "o_totalprice"], 1000.5]).alias("floats"),
        c(["<", key, ["state", "o_totalprice"]]).alias("mixed_order"), c(["!=", ["state", "o_orderstatus"], 1]).alias("text_is_int"),
    ).withColumn("text_is_int", ~F.col("text_is_int"))


@register("merge_later_nil", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN event_type ELSE 'base' END AS kind, 'kind,own' || CASE WHEN event_id % 3 < 2 THEN '' ELSE ',more' END AS names, event_id % 5 = 0 AS nothing FROM events""")
def merge_later_nil(spark, sf):
    """A later null wins over an earlier value, keys keep their first place, a null map makes the result null."""
    e = table(spark, sf, "events")
    text, third = F.col("event_type"), F.col("event_id") % 3
    base = F.create_map(F.lit("kind"), F.lit("base"), F.lit("own"), F.lit("x"))
    later = F.when(third == 0, F.create_map(F.lit("kind"), F.lit(None).cast("string"))).when(third == 1, F.create_map(F.lit("kind"), text)).otherwise(F.create_map(F.lit("more"), text))
    m = X.merge(base, later)
    empty = F.when(F.col("event_id") % 5 != 0, base)
    return e.select("event_id", m["kind"].alias("kind"), F.concat_ws(",", F.map_keys(m)).alias("names"), X.merge(empty, later).isNull().alias("nothing"))


@register("map_get_key", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, true AS known FROM events")
def map_get_key(spark, sf):
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", X.get_key(m, F.lit("k")).alias("k"), F.map_contains_key(m, F.lit("k")).alias("known"))


def _derived(spark, text, head, facts, names):
    query = " ".join(f"?q{i}" for i in range(len(names)))
    return rules.derive(spark, rules.parse_source(f"(rules-sexpr-v0 (facts) (rules {text}) (query ({head} {query})))"), facts)[head].toDF(*names)


@register("rules_atom_is_no_string", """
SELECT n_nationkey AS nationkey, 'string' AS found FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 'atom' FROM nation WHERE n_nationkey % 2 = 1""")
def rules_atom_is_no_string(spark, sf):
    """The stored string ``:x`` fits the pattern ``":x"`` and not the atom ``:x``; a derived atom is the other way round."""
    n = table(spark, sf, "nation")
    facts = {"mark": n.where("n_nationkey % 2 = 0").select("n_nationkey", F.lit(":x")), "odd": n.where("n_nationkey % 2 = 1").select("n_nationkey")}
    text = """(:- (kind ?n :x) (odd ?n)) (:- (hit ?n "atom") (mark ?n :x)) (:- (hit ?n "string") (mark ?n ":x")) (:- (hit ?n "atom") (kind ?n :x)) (:- (hit ?n "string") (kind ?n ":x"))"""
    return _derived(spark, text, "hit", facts, ["nationkey", "found"])


@register("rules_notice_is_no_negation", "SELECT DISTINCT c_custkey AS custkey FROM customer WHERE c_acctbal < 0")
def rules_notice_is_no_negation(spark, sf):
    """A predicate whose name begins with ``not`` is one like any other."""
    facts = {"notice": table(spark, sf, "customer").select("c_custkey", "c_acctbal")}
    return _derived(spark, "(:- (low ?c) (notice ?c ?b) (< ?b 0))", "low", facts, ["custkey"])


@register("rules_literal_builtin_first", "SELECT DISTINCT c_mktsegment AS segment FROM customer WHERE c_mktsegment <> 'BUILDING'")
def rules_literal_builtin_first(spark, sf):
    """Built-ins over literals may lead a body; ``=`` and ``!=`` over variables."""
    facts = {"segment": table(spark, sf, "customer").select("c_custkey", "c_mktsegment")}
    return _derived(spark, '(:- (s ?s) (= 1 1) (segment ?c ?s) (!= ?s "BUILDING") (= ?c ?c)) (:- (s ?s) (= 1 2) (segment ?c ?s))', "s", facts, ["segment"])


@register("rules_first_of_all_routes", "SELECT min(':' || p_name || '_' || p_partkey) AS route FROM part")
def rules_first_of_all_routes(spark, sf):
    """One route out of very many candidates: the first in canonical order."""
    p = table(spark, sf, "part").select(F.concat(F.lit(":"), "p_name", F.lit("_"), "p_partkey"))
    program = rules.parse_json({"facts": [], "rules": [{"head": ["route", "?r"], "body": [["candidate", "?r"]]}], "query": ["route", "?r"], "on_ambiguous": "choose-first"})
    return spark.range(1).select(F.lit(rules.solve(spark, program, {"candidate": p})).alias("route"))


# ------------------------------------------------------------------------------------------------ capabilities


def _requirements(spark, sf):
    """Two alternatives a part against what suppliers offer, with every stage of the cascade."""
    p, s = table(spark, sf, "part"), table(spark, sf, "supplier")
    key, k = F.col("p_partkey"), F.col("s_suppkey")
    a = p.select("p_partkey", "p_size", F.explode(F.array(F.lit(1), F.lit(2))).alias("alternative"))
    first = F.col("alternative") == 1
    a = a.select(
        key.alias("requirement_id"), "alternative", F.when(first, key % 17).otherwise(key % 11).alias("capability_id"), (key % 3).alias("version"),
        F.when(key % 4 == 0, F.concat(F.lit("h"), key % 2)).alias("config_hash"), F.array(F.struct((key % 5).cast("string").alias("operation"), F.lit("r").alias("semantics_ref"))).alias("operations"),
        F.col("p_size").alias("max_size"), (key % 6 == 0).alias("allow_net"), F.array((key % 7).cast("string")).alias("signer_keys_any_of"),
    )
    e = s.groupBy((k % 13).alias("capability_id"), (k % 3).alias("version")).agg(
        F.concat(F.lit("h"), F.max(k % 2)).alias("config_hash"), F.collect_set(F.struct((k % 7).cast("string").alias("operation"), F.lit("r").alias("semantics_ref"))).alias("operations"),
        F.max(k % 50).alias("max_size"), F.max(k % 2 == 0).alias("allow_net"), F.collect_set((k % 5).cast("string")).alias("trusted_signer_keys"),
    )
    return a, e, {"max_size": "max", "allow_net": "flag"}


_CASCADE = """
WITH a AS (SELECT p_partkey AS r, alternative, CASE alternative WHEN 1 THEN p_partkey % 17 ELSE p_partkey % 11 END AS c, p_partkey % 3 AS v, CASE WHEN p_partkey % 4 = 0 THEN 'h' || (p_partkey % 2) END AS h,
           p_partkey % 5 AS op, p_size AS m, p_partkey % 6 = 0 AS net, p_partkey % 7 AS signer FROM part CROSS JOIN (VALUES (1), (2)) t(alternative)),
e AS (SELECT s_suppkey % 13 AS c, s_suppkey % 3 AS v, 'h' || max(s_suppkey % 2) AS h, list(DISTINCT s_suppkey % 7) AS ops, max(s_suppkey % 50) AS m, bool_or(s_suppkey % 2 = 0) AS net, list(DISTINCT s_suppkey % 5) AS signers
      FROM supplier GROUP BY 1, 2),
rank AS (SELECT r, alternative, CASE
    WHEN NOT EXISTS (SELECT 1 FROM e WHERE e.c = a.c) THEN 1
    WHEN NOT EXISTS (SELECT 1 FROM e WHERE e.c = a.c AND e.v = a.v) THEN 2
    WHEN NOT EXISTS (SELECT 1 FROM e WHERE e.c = a.c AND e.v = a.v AND (a.h IS NULL OR e.h = a.h)) THEN 2
    WHEN NOT EXISTS (SELECT 1 FROM e WHERE e.c = a.c AND e.v = a.v AND (a.h IS NULL OR e.h = a.h) AND list_contains(e.ops, a.op)) THEN 4
    WHEN NOT EXISTS (SELECT 1 FROM e WHERE e.c = a.c AND e.v = a.v AND (a.h IS NULL OR e.h = a.h) AND list_contains(e.ops, a.op) AND a.m <= e.m AND (NOT a.net OR e.net)) THEN 4
    WHEN NOT EXISTS (SELECT 1 FROM e WHERE e.c = a.c AND e.v = a.v AND (a.h IS NULL OR e.h = a.h) AND list_contains(e.ops, a.op) AND a.m <= e.m AND (NOT a.net OR e.net) AND list_contains(e.signers, a.signer)) THEN 5
    ELSE 9 END AS rank FROM a),
res AS (SELECT r AS requirement_id, min(alternative) FILTER (rank = 9) AS chosen, min(rank) AS rank FROM rank GROUP BY r),
m AS (SELECT requirement_id, chosen, CASE WHEN chosen IS NULL THEN 'reject' ELSE 'accepted' END AS verdict, CASE WHEN chosen IS NULL THEN 'CAPABILITY.' || CASE rank WHEN 1 THEN 'missing_required_capability'
      WHEN 2 THEN 'incompatible_version' WHEN 4 THEN 'constraint_violation' ELSE 'untrusted_or_missing_trust_anchor' END END AS code FROM res)
"""


@register("capability_cascade", _CASCADE + "SELECT * FROM m")
def capability_cascade(spark, sf):
    """Every stage, the first passing alternative, else the failure of lowest rank."""
    return R.match_capabilities(*_requirements(spark, sf))


@register("capability_verdict", _CASCADE + """
, n AS (SELECT m.*, p_size AS request, p_partkey % 3 > 0 AS optional FROM m JOIN part ON requirement_id = p_partkey),
g AS (SELECT request, count(*) FILTER (NOT optional AND chosen IS NULL) AS unmet, count(*) FILTER (optional AND chosen IS NULL) AS soft, arg_min(code, requirement_id) FILTER (NOT optional AND chosen IS NULL) AS primary_failure FROM n GROUP BY 1)
SELECT request, CASE WHEN unmet = 0 AND soft = 0 THEN 'accepted' WHEN unmet = 0 THEN 'accepted_with_soft_gaps' WHEN request % 2 = 0 THEN 'suspend' ELSE 'reject' END AS status, unmet AS unmet_required, soft AS unmet_optional, primary_failure FROM g""")
def capability_verdict(spark, sf):
    """Requirements of one request together: soft gaps, suspension where the request says so."""
    per = R.match_capabilities(*_requirements(spark, sf))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("requirement_id"), F.col("p_size").alias("request"), (F.col("p_partkey") % 3 > 0).alias("optional"))
    return R.verdicts(per.join(p, "requirement_id"), "request", F.when(F.col("request") % 2 == 0, "suspend").otherwise("reject"))


@register("constraint_kinds", """
SELECT p_partkey AS partkey, p_type IN ('ECONOMY', 'STANDARD') AS subset, p_type NOT IN ('PROMO') AS disjoint, p_size <= 25 AS within, (p_partkey % 2 = 1) OR p_retailprice > 950 AS implied, p_brand = 'Brand#1' AS same FROM part""")
def constraint_kinds(spark, sf):
    """The library's tests of constraint values: subset, disjoint sets, upper bound, implication, equality."""
    p = table(spark, sf, "part")
    own = F.array("p_type")
    return p.select(
        F.col("p_partkey").alias("partkey"), R.KINDS["set"](own, F.array(F.lit("ECONOMY"), F.lit("STANDARD"))).alias("subset"), R.disjoint(own, F.array(F.lit("PROMO"))).alias("disjoint"),
        R.KINDS["max"](F.col("p_size"), F.lit(25)).alias("within"), R.KINDS["flag"](F.col("p_partkey") % 2 == 0, F.col("p_retailprice") > 950).alias("implied"), R.KINDS["raw"](F.col("p_brand"), F.lit("Brand#1")).alias("same"),
    )


# ------------------------------------------------------------------------------------------------ receipts and signatures


@register("receipt_checks", """
WITH o AS (SELECT o_orderkey AS step, 'R' || o_orderkey AS request_hash, CASE WHEN o_orderkey % 3 = 0 THEN 'cap' || (o_orderkey % 2) END AS cap, CASE WHEN o_orderkey % 5 < 2 THEN ['ok'] END AS outcomes FROM orders),
r AS (SELECT 'R' || l_orderkey AS request_hash, l_linenumber AS i, 'X' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS receipt_hash, CASE WHEN l_suppkey % 10 = 0 THEN 'other' ELSE 'r' || l_orderkey END AS rid,
      l_returnflag AS signer, l_linestatus = 'F' AS sig, l_partkey % 4 > 0 AS pay, 'cap' || (l_linenumber % 2) AS cap, CASE WHEN l_tax > 0.04 THEN 'ok' ELSE 'late' END AS outcome FROM lineitem),
b AS (SELECT o.step, o.request_hash, r.i, r.receipt_hash, lower(rid) <> lower(o.request_hash) AS f1, signer NOT IN ('A', 'N') AS f2, signer IN ('A', 'N') AND NOT sig AS f3, NOT pay AS f4,
      o.cap IS NOT NULL AND r.cap <> o.cap AS f5, o.outcomes IS NOT NULL AND outcome <> 'ok' AS f6 FROM o JOIN r USING (request_hash)),
g AS (SELECT step, request_hash, count(*) AS n, arg_min(receipt_hash, struct_pack(i := i, h := receipt_hash)) FILTER (NOT (f1 OR f2 OR f3 OR f4 OR f5 OR f6)) AS best,
      concat_ws(',', CASE WHEN bool_or(f5) THEN 'PROTOCOL.unknown_capability' END, CASE WHEN bool_or(f1) THEN 'PROTOCOL.request_hash_mismatch' END, CASE WHEN bool_or(f2) THEN 'PROTOCOL.untrusted_signer' END,
        CASE WHEN bool_or(f3) THEN 'PROTOCOL.signature_invalid' END, CASE WHEN bool_or(f4) THEN 'PROTOCOL.payload_hash_mismatch' END, CASE WHEN bool_or(f6) THEN 'PROTOCOL.outcome_disallowed' END) AS codes FROM b GROUP BY 1, 2)
SELECT o.step, o.request_hash, best IS NOT NULL AS satisfied, best AS receipt_hash, coalesce(n, 0) AS matched, CASE WHEN best IS NOT NULL THEN '' WHEN n IS NULL THEN 'PROTOCOL.missing_receipt' ELSE codes END AS codes
FROM o LEFT JOIN g ON o.step = g.step""")
def receipt_checks(spark, sf):
    """Receipts with every check: request id, trust, signature, payload hash, capability and outcome."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    k = F.col("o_orderkey")
    asks = k % 3 == 0
    obligations = o.select(
        k.alias("step"), F.concat(F.lit("R"), k).alias("request_hash"), F.when(asks, F.concat(F.lit("cap"), k % 2)).alias("capability_id"), F.when(asks, "1").alias("capability_version"),
        F.when(asks, "do").alias("operation"), F.when(k % 5 < 2, F.array(F.lit("ok"))).alias("allowed_outcomes"),
    )
    receipts = li.select(
        F.concat(F.lit("R"), "l_orderkey").alias("request_hash"), F.col("l_linenumber").alias("history_index"), F.concat(F.lit("X"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("receipt_hash"),
        F.when(F.col("l_suppkey") % 10 == 0, "other").otherwise(F.concat(F.lit("r"), "l_orderkey")).alias("request_id"), F.col("l_returnflag").alias("signer_key_id"), (F.col("l_linestatus") == "F").alias("signature_valid"),
        (F.col("l_partkey") % 4 > 0).alias("payload_hash_valid"), F.concat(F.lit("cap"), F.col("l_linenumber") % 2).alias("capability_id"), F.lit("1").alias("capability_version"), F.lit("do").alias("operation"),
        F.when(F.col("l_tax") > 0.04, "ok").otherwise("late").alias("outcome"),
    )
    return E.check_receipts(obligations, receipts, ["A", "N"]).withColumn("codes", F.concat_ws(",", "codes"))


@register("signed_thresholds", """
WITH s AS (SELECT l_orderkey AS value_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place, 'k' || (l_suppkey % 4) AS key_id, CASE WHEN l_partkey % 19 = 0 THEN 'rsa' ELSE 'ed25519' END AS alg,
           l_partkey % 23 = 0 AS bad_scope, l_partkey % 29 = 0 AS bad_digest, l_suppkey % 31 = 0 AS bad FROM lineitem),
e AS (SELECT *, CASE WHEN key_id = 'k3' THEN 'untrusted key_id' WHEN alg = 'rsa' THEN 'disallowed alg' WHEN bad_scope THEN 'scope mismatch' WHEN bad_digest THEN 'payload digest mismatch'
      WHEN row_number() OVER (PARTITION BY value_id, key_id ORDER BY place) > 1 THEN 'duplicate key_id' WHEN bad THEN 'verification failed' END AS err FROM s),
g AS (SELECT value_id, count(*) FILTER (err IS NULL) AS n, arg_min(err, place) FILTER (err IS NOT NULL) AS first FROM e GROUP BY 1)
SELECT o_orderkey AS value_id, coalesce(n, 0) AS verified, coalesce(first, CASE WHEN coalesce(n, 0) < 2 THEN 'threshold not met' END) AS error FROM orders LEFT JOIN g ON value_id = o_orderkey""")
def signed_thresholds(spark, sf):
    """Signatures over payload digests: the first error in order, then the threshold; the verifier is injected."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    own = F.sha2(F.col("l_orderkey").cast("string"), 256)
    s = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("value_id"), F.row_number().over(w).alias("place"), F.concat(F.lit("k"), F.col("l_suppkey") % 4).alias("key_id"), F.when(F.col("l_partkey") % 19 == 0, "rsa").otherwise("ed25519").alias("alg"),
        F.when(F.col("l_partkey") % 23 == 0, "other").otherwise("orders_v1").alias("scope"), F.when(F.col("l_partkey") % 29 == 0, F.lit("0" * 64)).otherwise(own).alias("payload_digest"), F.col("l_suppkey"),
    )
    sign = lambda key, digest: F.sha2(F.concat(key, digest), 256)
    s = s.withColumn("sig", F.when(F.col("l_suppkey") % 31 == 0, "forged").otherwise(sign(F.col("key_id"), F.col("payload_digest")))).drop("l_suppkey")
    accepted = table(spark, sf, "orders").select(F.col("o_orderkey").alias("value_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("payload_digest"))
    policy = E.Policy("orders:v1", ["k0", "k1", "k2"], ["ed25519"], threshold=2)
    return E.verify_signed(s, accepted, policy, lambda key, alg, domain, digest, sig: sig == sign(key, digest))


@register("signed_values", """
SELECT c_custkey AS value_id, CASE c_custkey % 6 WHEN 0 THEN 'untrusted key_id' WHEN 1 THEN 'duplicate key_id' WHEN 2 THEN 'payload digest mismatch' WHEN 3 THEN 'signed: missing payload' END AS error FROM customer""")
def signed_values(spark, sf):
    """Signed values and manifests as nested values: payload digests, key and threshold checks, unreadable ones named."""
    import hashlib

    def signature(key, digest):
        sig = hashlib.sha256((key + digest).encode()).hexdigest()
        return f'Signature((Keyword("key_id")="{key}", alg=:ed25519, scope=Keyword("orders_v1"), Keyword("payload_digest")=Digest((alg=:sha256, hex="{digest}")), sig=0x[{sig}]))'

    @F.pandas_udf("string")
    def made(keys: pd.Series) -> pd.Series:
        def one(k):
            digest = lambda text: hashlib.sha256(V.encode(V.canonical(V.parse(text)))).hexdigest()
            if k % 6 == 4:
                body = f'format=Keyword("manifest_v1"), root=1, objects=[{k}], policy=()'
                own = digest(f"Manifest(({body}))")
                return f"Manifest(({body}, signatures=[{signature('k0', own)}, {signature('k1', own)}]))"
            payload = f'(id={k}, name="x")'
            own = digest(payload if k % 6 != 2 else "(id=0)")
            keys = {0: ("k9", "k1"), 1: ("k0", "k0")}.get(k % 6, ("k0", "k1"))
            head = "" if k % 6 == 3 else f"payload={payload}, "
            return f"Signed(({head}signatures=[{', '.join(signature(x, own) for x in keys)}]))"

        return pd.Series([one(k) for k in keys])

    c = spread(table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"))).select("custkey", made("custkey").alias("text"))
    signatures, accepted, unreadable = E.read_signed(c, "custkey", "text")
    policy = E.Policy("orders:v1", ["k0", "k1"], ["ed25519"], threshold=2)
    done = E.verify_signed(signatures, accepted, policy, lambda key, alg, domain, digest, sig: F.lower(F.hex(sig)) == F.sha2(F.concat(key, digest), 256))
    return done.select("value_id", "error").union(unreadable)


@register("receipt_signatures", "SELECT n_nationkey AS nationkey, n_nationkey % 3 > 0 AS signature_valid FROM nation")
def receipt_signatures(spark, sf):
    """Ed25519 over a domain and the signing body; a third of the bodies were changed."""
    from factloom.functions import ed25519

    key, _ = ed25519.sign(b"\1" * 32, b"")

    @F.pandas_udf("binary")
    def signed(names: pd.Series) -> pd.Series:
        return names.map(lambda n: ed25519.sign(b"\1" * 32, b"receipt:v0\0" + n.encode())[1])

    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name", F.lit(bytearray(key)).alias("key"), signed("n_name").alias("sig"))
    n = n.withColumn("body", F.when(F.col("nationkey") % 3 == 0, F.concat("n_name", F.lit("x"))).otherwise(F.col("n_name")).cast("binary"))
    return E.verify_receipts(n, "body", "key", "sig", "receipt:v0").select("nationkey", "signature_valid")


@register("signing_tokens", "SELECT c_custkey AS custkey, c_custkey % 4 <> 0 AS holds, CASE WHEN c_custkey % 4 <> 0 THEN 'run-' || c_custkey END AS run_id FROM customer")
def signing_tokens(spark, sf):
    """Tokens issued and checked in the JVM; those that were changed don't hold."""
    run, digest = F.concat(F.lit("run-"), "c_custkey"), F.concat(F.lit("sha256:"), F.sha2("c_name", 256))
    token = E.signing_token(run, F.lit("owner"), digest, F.substring(F.sha2("c_mktsegment", 256), 1, 24), b"secret")
    changed = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("A"), F.substring(token, F.lit(2), F.length(token)))).otherwise(token)
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), E.check_token(changed, b"secret").alias("t"))
    return c.select("custkey", F.col("t").isNotNull().alias("holds"), F.col("t.run_id").alias("run_id"))


# ------------------------------------------------------------------------------------------------ identities and ledgers


@register("request_identity", """
WITH a AS (SELECT o_orderkey AS orderkey, '{"amount":' || o_custkey || ',"status":"' || o_orderstatus || '"}' AS args FROM orders),
b AS (SELECT *, 'sha256:' || sha256(args) AS args_hash FROM a),
c AS (SELECT *, 'sha256:' || sha256('{"args_hash":"' || args_hash || '","artifact_hash":"sha256:art","request_ordinal":1,"step_id":"S0002"}') AS request_id FROM b)
SELECT orderkey, args_hash, request_id, 'sha256:' || sha256('{"artifact_id":"sha256:art","step_id":"S0002","request_id":"' || request_id || '","obligation_type":"receipt_valid"}') AS obligation_id,
       'run-' || substr(sha256(args), 1, 16) AS run_id, 'webhook-' || substr(sha256('{"inputs_digest":"d","medium":"webhook","run_id":"r"}'), 1, 16) AS delivery_id FROM c""")
def request_identity(spark, sf):
    """Hash of arguments, request key (sorted fields), obligation id (declared order), run and delivery ids."""
    o = table(spark, sf, "orders")
    args = I.json_object(amount=F.col("o_custkey"), status=F.col("o_orderstatus"))
    df = o.select(F.col("o_orderkey").alias("orderkey"), args.alias("args")).withColumn("args_hash", I.args_hash(F.col("args")))
    art, step = F.lit("sha256:art"), F.lit("S0002")
    df = df.withColumn("request_id", I.request_key(art, step, F.col("args_hash"))).withColumn("obligation_id", I.obligation_id(art, step, F.col("request_id")))
    return df.withColumn("run_id", I.run_id(I.sha256(F.col("args")))).withColumn("delivery_id", I.delivery_id("webhook", F.lit("r"), F.lit("d"))).drop("args")


@register("canonical_json_floats", """
SELECT event_id, '{"id":' || event_id || ',"v":' || CASE WHEN value = 0 THEN '0' ELSE regexp_replace(regexp_replace(printf('%.17g', value), 'e\\+0*', 'e'), 'e-0*', 'e-') END || ',"w":0}' AS canonical FROM events""")
def canonical_json_floats(spark, sf):
    """Canonical JSON with floats: 17 significant digits, zero as ``0``."""
    text = F.concat(F.lit('{ "w": -0.0, "v": '), F.col("value").cast("string"), F.lit(', "id": '), F.col("event_id").cast("string"), F.lit("}"))
    return spread(table(spark, sf, "events").select("event_id", text.alias("t"))).select("event_id", I.canonical_json_floats(F.col("t")).alias("canonical"))


def _ledger_events(spark, sf):
    e = table(spark, sf, "events")
    return e.select("user_id", "event_id", I.json_object(id=F.col("event_id"), kind=F.col("event_type")).alias("event"))


@register("ledger_hash_check", """
SELECT user_id, count(*) AS entries, count(*) FILTER (event_id % 50 = 7) AS tampered, 0 AS broken_links, count(*) AS numbered FROM events GROUP BY 1""")
def ledger_hash_check(spark, sf):
    """Ledgers are built, some events changed behind their hashes: links hold, hashes tell."""
    built = I.build_ledger(_ledger_events(spark, sf), "user_id", ["event_id"], "event")
    changed = built.withColumn("event", F.when(F.col("event_id") % 50 == 7, F.replace("event", F.lit('"kind":"'), F.lit('"kind":"x'))).otherwise(F.col("event")))
    c = I.check_ledger(changed, "user_id")
    return c.groupBy("user_id").agg(F.count("*").alias("entries"), F.count_if(~F.col("hash_ok")).alias("tampered"), F.count_if(~F.col("link_ok")).alias("broken_links"), F.count_if("sequence_ok").alias("numbered"))


@register("ledger_lines_round_trip", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\"}' AS event, true AS hash_ok FROM events WHERE user_id % 4 = 0")
def ledger_lines_round_trip(spark, sf):
    """Entries as JSONL lines and back, blank lines between them; the hashes still hold."""
    built = I.build_ledger(_ledger_events(spark, sf).where("user_id % 4 = 0"), "user_id", ["event_id"], "event")
    lines = I.ledger_lines(built).select("user_id", "event_id", "value")
    back = I.parse_ledger(lines.union(lines.withColumn("value", F.lit("  "))))
    return I.check_ledger(back, "user_id").select("user_id", "event_id", "sequence", "event", "hash_ok")


@register("ledger_append", """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2, event_id) AS sequence, true AS link_ok, true AS hash_ok FROM events""")
def ledger_append(spark, sf):
    """Odd events appended behind the heads of ledgers of the even ones; negative odd ones come before these, null ones last."""
    e = _ledger_events(spark, sf).withColumn("turn", F.coalesce(F.col("event_id") % 2, F.lit(2)))
    first = I.build_ledger(e.where("turn < 1"), "user_id", ["turn", "event_id"], "event")
    heads = R.chain_head(first, "user_id", "sequence", "event_hash")
    second = I.build_ledger(e.where("turn >= 1"), "user_id", ["turn", "event_id"], "event", heads)
    return I.check_ledger(first.union(second), "user_id").select("user_id", "event_id", "sequence", "link_ok", "hash_ok")


@register("ledger_export_to_head", """
WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events) SELECT * FROM s WHERE sequence <= 5 AND user_id IN (SELECT user_id FROM s WHERE sequence = 5)""")
def ledger_export_to_head(spark, sf):
    built = I.build_ledger(_ledger_events(spark, sf), "user_id", ["event_id"], "event")
    heads = built.where("sequence = 5").select("user_id", F.col("event_hash").alias("head"))
    return I.export_chain(built, "user_id", heads).select("user_id", "event_id", "sequence")


@register("ledger_replay", "SELECT user_id, true AS same, count(*) AS entries FROM events GROUP BY 1")
def ledger_replay(spark, sf):
    """A ledger built anew from its events has the same hashes."""
    from factloom.streaming.ledger import replayed

    return replayed(I.build_ledger(_ledger_events(spark, sf), "user_id", ["event_id"], "event"), "user_id", ["event_id"], "event")


@register("receipt_digests", """
SELECT o_orderkey AS orderkey, sha256('{"inputs_digest":"' || sha256(CAST(o_custkey AS VARCHAR)) || '","receipt_type":"ledger.append.v1","sequence":' || o_orderkey || '}') AS digest FROM orders""")
def receipt_digests(spark, sf):
    """Of receipts without the field that holds the digest."""
    fields = ["receipt_type", "sequence", "inputs_digest", "receipt_digest"]
    r = F.struct(F.lit("ledger.append.v1").alias("receipt_type"), F.col("o_orderkey").alias("sequence"), F.sha2(F.col("o_custkey").cast("string"), 256).alias("inputs_digest"), F.lit("x").alias("receipt_digest"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"), I.receipt_digest(r, fields).alias("digest"))


@register("mediated_events", """
SELECT c_custkey AS custkey, 'customer.change' AS event_type, 'customer/' || c_name AS subject, 'outbox.v0' AS source, md5(c_name) AS correlation_id, c_mktsegment AS new_value FROM customer""")
def mediated_events(spark, sf):
    m = I.mediated(F.col("c_name"), F.lit("01"), F.col("c_mktsegment"), F.md5("c_name"), "outbox.v0")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), m.alias("m"))
    return c.select("custkey", *[F.col(f"m.{n}").alias(n) for n in ("event_type", "subject", "source", "correlation_id")], F.col("m.payload.new_value").alias("new_value"))


@register("revealed_fields", """
SELECT c_custkey AS custkey, CASE WHEN c_custkey % 2 = 0 THEN 'name,subject_id' ELSE 'segment,subject_id' END AS names, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS value FROM customer""")
def revealed_fields(spark, sf):
    """Asked fields of a profile, trimmed and lower-cased, unknown ones ignored, the subject always there."""
    profile = F.create_map(F.lit("subject_id"), F.col("c_custkey").cast("string"), F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    asked = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit(" Name "), F.lit("nothing"))).otherwise(F.array(F.lit("SEGMENT")))
    got = I.reveal(profile, asked)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), F.concat_ws(",", F.array_sort(F.map_keys(got))).alias("names"), F.coalesce(got["name"], got["segment"]).alias("value"))


@register("format_checks", """
SELECT event_id, event_id % 3 = 0 AS digest, event_id % 4 <> 1 AS step_id, event_id % 2 = 0 AS code, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'absolute' WHEN 2 THEN 'segments' WHEN 3 THEN 'backslash' ELSE 'empty' END AS unsafe,
       CASE event_id % 3 WHEN 2 THEN NULL ELSE event_id END AS whole, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'ab' || event_id END AS normal, 'a,b' || CASE WHEN event_id % 2 = 0 THEN ',c' ELSE '' END AS items FROM events""")
def format_checks(spark, sf):
    """Digests, step ids, failure codes, paths, whole numbers, normalised digests, unique appends."""
    k = F.col("event_id")
    text = F.expr(r"""named_struct('digest', IF(event_id % 3 = 0, concat('sha256:', sha2(event_type, 256)), concat('md5:', sha2(event_type, 256))), 'step', IF(event_id % 4 = 1, 'S12', concat('S', lpad(event_id % 10000, 4, '0'))),
      'code', IF(event_id % 2 = 0, 'EVAL.no_match', 'OTHER.x'), 'path', element_at(array('a/b.bin', '/a', 'a/../b', 'a\\b', ''), int(event_id % 5 + 1)),
      'number', concat(event_id, element_at(array('', '.0', '.5'), int(event_id % 3 + 1))), 'raw', IF(event_id % 7 = 0, '  ', concat(' SHA256:AB', event_id, ' ')))""")
    items = E.append_unique(F.array(F.lit("a"), F.lit("b")), F.when(k % 2 == 0, "c").otherwise("b"))
    return table(spark, sf, "events").select("event_id", "event_type").withColumn("t", text).select(
        "event_id", I.well_formed(F.col("t.digest"), "digest").alias("digest"), I.well_formed(F.col("t.step"), "step_id").alias("step_id"), I.well_formed(F.col("t.code"), "failure_code").alias("code"),
        I.safe_relative_path(F.col("t.path")).alias("unsafe"), I.integer(F.col("t.number")).alias("whole"), I.normal_digest(F.col("t.raw")).alias("normal"), F.concat_ws(",", items).alias("items"),
    )


# ------------------------------------------------------------------------------------------------ bundles and vector runs


@register("digest_members", "SELECT c_custkey AS custkey, c_custkey % 3 <> 0 AS known FROM customer")
def digest_members(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), F.sha2("c_name", 256).alias("digest"))
    return E.members(c, c.where("custkey % 3 <> 0")).select("custkey", "known")


@register("artifact_load", """
SELECT sha256(c_name) AS digest, CASE c_custkey % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'digest_mismatch' ELSE 'ok' END AS status FROM customer""")
def artifact_load(spark, sf):
    """Artifacts by digest, hashed anew when they are read."""
    c = table(spark, sf, "customer")
    own = F.sha2("c_name", 256)
    store = c.where("c_custkey % 4 <> 0").select(own.alias("digest"), F.when(F.col("c_custkey") % 4 == 1, "changed").otherwise(F.col("c_name")).alias("content"))
    return E.load_artifacts(c.select(F.upper(F.concat(F.lit("sha256:"), own)).alias("digest")), store).select("digest", "status")


@register("bundle_check", """
SELECT c_custkey AS bundle, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'EVAL.E_ARTIFACT_IDENTITY' ELSE 'EVAL.E_STATE_INVALID' END AS code FROM customer""")
def bundle_check(spark, sf):
    """Artifacts against their manifests: a wrong hash, a missing file, a path that leaves the bundle."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    files = c.where("c_custkey % 4 <> 2").select(k.alias("bundle"), F.when(k % 4 == 3, "../a.bin").otherwise("a.bin").alias("path"), F.col("c_name").cast("binary").alias("content"))
    expected = I.sha256(F.when(k % 4 == 1, "other").otherwise(F.col("c_name")), prefixed=True)
    return E.check_bundles(files, c.select(k.alias("bundle"), F.when(k % 4 == 3, "../a.bin").otherwise("a.bin").alias("path"), expected.alias("expected"))).select("bundle", "code")


@register("bundle_manifests", """
WITH s AS (SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place, sha256(l_returnflag) AS digest, '{"step":"' || l_linestatus || '"}' AS step FROM lineitem),
d AS (SELECT run_id, string_agg(digest, '","' ORDER BY first) AS digests FROM (SELECT run_id, digest, min(place) AS first FROM s GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT run_id, sha256(string_agg(step || chr(10), '' ORDER BY place)) AS trace, count(*) AS n FROM s GROUP BY 1),
m AS (SELECT o_orderkey AS run_id, '{"artifact_digests":[' || coalesce('"' || digests || '"', '') || '],"bundle_version":"v0","final_digest":"' || sha256(o_orderstatus) || '","input_digest":"in","run_id":' || o_orderkey ||
      coalesce(',"run_trace_digest":"' || trace || '","trace_step_count":' || n, '') || '}' AS manifest FROM orders LEFT JOIN d ON d.run_id = o_orderkey LEFT JOIN t ON t.run_id = o_orderkey)
SELECT run_id, manifest, sha256(manifest) AS manifest_digest FROM m""")
def bundle_manifests(spark, sf):
    """Each run's manifest: digests in first-seen order, the trace's digest and the manifest's own."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    steps = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.row_number().over(w).alias("place"), F.array(F.sha2("l_returnflag", 256), F.lit(" ")).alias("digests"), F.format_string('{"step":"%s"}', "l_linestatus").alias("step"))
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.lit("in").alias("input_digest"), F.sha2("o_orderstatus", 256).alias("final_digest"))
    return E.export_manifest(runs, steps).select("run_id", "manifest", "manifest_digest")


def _vectors(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    none = F.array().cast("array<string>")
    vectors = p.select(F.format_string("V%05d", k).alias("id"), F.struct(F.when(k % 3 == 0, "fail").otherwise("pass").alias("verdict"), F.when(k % 3 == 0, F.array(F.lit("EVAL.no_match"), F.lit("KERNEL.x"))).otherwise(none).alias("failure_codes")).alias("expected"))
    results = p.where("p_partkey % 50 <> 49").select(F.format_string("V%05d", k).alias("id"), F.when(k % 3 == 0, "fail").otherwise("pass").alias("verdict"),
                                                    F.when(k % 3 == 0, F.array(F.lit("KERNEL.x"), F.lit("EVAL.no_match"), F.lit("KERNEL.x"))).when(k % 20 == 10, F.array(F.lit("PROTOCOL.policy_violation"))).otherwise(none).alias("failure_codes"))
    return vectors, results


_PASSED = "(p_partkey % 50 <> 49 AND (p_partkey % 3 = 0 OR p_partkey % 20 <> 10))"


@register("vector_run_summary", f"SELECT count(*) FILTER {_PASSED.replace('(', '(WHERE ', 1)} AS passed, count(*) FILTER (WHERE NOT {_PASSED}) AS failed, 'KERNEL.x,EVAL.no_match,PROTOCOL.policy_violation' AS codes FROM part")
def vector_run_summary(spark, sf):
    return E.summary(E.run_vectors(*_vectors(spark, sf))).withColumn("codes", F.concat_ws(",", "codes"))


@register("vector_run_until_failure", f"SELECT printf('V%05d', p_partkey) AS id, {_PASSED} AS passed FROM part WHERE p_partkey <= (SELECT min(p_partkey) FROM part WHERE NOT {_PASSED})")
def vector_run_until_failure(spark, sf):
    return E.run_vectors(*_vectors(spark, sf), stop_at_failure=True).select("id", "passed")


@register("newest_runs_of_filter", """
SELECT o_custkey AS custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS newest, count(*) AS runs FROM orders WHERE contains(lower(o_orderpriority), 'urgent') GROUP BY 1""")
def newest_runs_of_filter(spark, sf):
    """Runs whose name holds a text in any case, the newest of each subject found without a sort."""
    return R.newest(table(spark, sf, "orders").where(R.mentions(F.col("o_orderpriority"), "URGENT")), "o_custkey", "o_orderdate", "o_orderkey").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("newest"), F.col("n").alias("runs"))


@register("find_first_run", "SELECT o_orderkey AS orderkey, o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_orderdate, o_orderkey LIMIT 1")
def find_first_run(spark, sf):
    o = table(spark, sf, "orders")
    return R.find_first(o, (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000), ["o_orderdate", "o_orderkey"]).select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"))


# ------------------------------------------------------------------------------------------------ plans

EVALIR = {
    "format_id": "evalir", "ir_version": "v0", "artifact_hash": "sha256:art", "entry_step_id": "S0001",
    "steps": [
        {"step_id": "S0001", "op": "assign", "path": "order.high", "value": {"$expr": ">=", "left": {"$expr": "state_get", "path": "order.amount"}, "right": 150000}, "next_step_id": "S0002"},
        {"step_id": "S0002", "kind": "choose_rules_v0", "routes": {":check": "S0003", ":skip": "S0006"}, "rules": {
            "facts": [["limit", 5]], "rules": [{"head": ["route", ":check"], "body": [["limit", "?x"], [">", "?x", 3]]}], "query": ["route", "?r"], "on_no_match": {"default": ":skip"}, "on_ambiguous": "choose-first"}},
        {"step_id": "S0003", "op": "emit", "emission": {"kind": "checked", "at": [1, None]}, "next_step_id": "S0004"},
        {"step_id": "S0004", "op": "request", "capability_id": "cap", "operation": "review", "next_step_id": "S0005", "args": {
            "id": {"$expr": "state_get", "path": "order.id"}, "lane": {"$fn": "state", "body": {"$expr": "if", "cond": {"$expr": "state_get", "path": "order.high"}, "then": "fast", "else": "slow"}}, "n": [1, {"$expr": "state_get", "path": "order.status"}]}},
        {"step_id": "S0005", "op": "emit", "emission": "reviewed", "next_step_id": "S0006"},
        {"step_id": "S0006", "op": "end"},
    ],
}

_EVALIR_SQL = """
WITH s AS (SELECT o_orderkey AS instance, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS amount, o_orderstatus FROM orders),
a AS (SELECT *, '{"id":' || instance || ',"lane":"' || CASE WHEN amount >= 150000 THEN 'fast' ELSE 'slow' END || '","n":[1,"' || o_orderstatus || '"]}' AS args FROM s),
r AS (SELECT *, 'sha256:' || sha256('{"args_hash":"sha256:' || sha256(args) || '","artifact_hash":"sha256:art","request_ordinal":1,"step_id":"S0004"}') AS request_id FROM a)
"""


def _plan(plan=EVALIR):
    return evalir.load(json.dumps(plan))


def _instances(spark, sf):
    """Orders as instances; those of status P lack their amount."""
    o = table(spark, sf, "orders")
    amount = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return o.select(F.col("o_orderkey").alias("instance"), F.struct(F.struct(F.col("o_orderkey").alias("id"), amount.alias("amount"), F.col("o_orderstatus").alias("status")).alias("order")).alias("state"))


@register("evalir_requests", _EVALIR_SQL + """
SELECT instance, CASE WHEN amount IS NULL THEN 'error' ELSE 'suspend' END AS control, CASE WHEN amount IS NULL THEN 'S0001' ELSE 'S0004' END AS current_step, CASE WHEN amount IS NULL THEN '' ELSE '{"at":[1,null],"kind":"checked"}' END AS emissions,
       CASE WHEN amount IS NOT NULL THEN args END AS args, CASE WHEN amount IS NOT NULL THEN request_id END AS request_id, CASE WHEN amount IS NULL THEN 'EVAL.E_STEP_CONTRACT' ELSE '' END AS errors,
       CASE WHEN amount IS NOT NULL THEN CAST(amount >= 150000 AS VARCHAR) END AS high FROM r""")
def evalir_requests(spark, sf):
    """A JSON plan over all orders: expressions, rules, emissions, requests with their identities; rows that fail say so."""
    out = evalir.evaluate(_instances(spark, sf), _plan())
    first = F.try_element_at("requests", F.lit(1))
    return out.select("instance", "control", "current_step", F.concat_ws("|", "emissions").alias("emissions"), first["args"].alias("args"), first["request_id"].alias("request_id"), F.concat_ws(",", "errors").alias("errors"), F.col("state.order.high").cast("string").alias("high"))


@register("evalir_obligations", _EVALIR_SQL + """
SELECT instance, 'sha256:' || sha256('{"artifact_id":"sha256:art","step_id":"S0004","request_id":"' || request_id || '","obligation_type":"receipt_valid"}') AS obligation_id, 'receipt_valid' AS obligation_type, request_id AS satisfaction_ref
FROM r WHERE amount IS NOT NULL""")
def evalir_obligations(spark, sf):
    return evalir.rows_of(evalir.evaluate(_instances(spark, sf), _plan()), "obligations")


@register("evalir_resume", _EVALIR_SQL + """
SELECT instance, CASE WHEN amount IS NULL THEN 'error' WHEN instance % 2 = 0 THEN 'end' ELSE 'suspend' END AS control, CASE WHEN amount IS NULL THEN 0 WHEN instance % 2 = 0 THEN 2 ELSE 1 END AS emitted,
       CASE WHEN amount IS NULL THEN 1 WHEN instance % 2 = 0 THEN 6 ELSE 4 END AS steps_taken FROM r""")
def evalir_resume(spark, sf):
    """Suspended instances go on where a trusted receipt of their request has come in."""
    out = evalir.evaluate(_instances(spark, sf), _plan())
    asked = evalir.rows_of(out, "requests")
    receipts = asked.select("instance", F.col("request_id").alias("request_hash"), F.when(F.col("instance") % 2 == 0, "good").otherwise("bad").alias("signer"), F.lit(True).alias("signature_valid"))
    again = evalir.evaluate(evalir.resume(out, _plan(), receipts, trusted=["good"]), _plan())
    return again.select("instance", "control", F.size("emissions").alias("emitted"), "steps_taken")


@register("evalir_step_budget", "SELECT o_orderkey AS instance, 'continue' AS control, 'S0004' AS current_step, 3 AS steps_taken FROM orders WHERE o_orderstatus <> 'P'")
def evalir_step_budget(spark, sf):
    """A budget that is used up leaves an instance where it is, to go on."""
    return evalir.evaluate(_instances(spark, sf).where("state.order.status <> 'P'"), _plan(), max_steps=3).select("instance", "control", "current_step", "steps_taken")


_ARTIFACT = """Tagged("workflow_artifact_v0", (id="a", version="v0", steps=[(op=:request, name="ask", capability_id="cap", operation="review", args=(k=1)),
  (op=:join_obligations_v0, wait_for_steps=["ask"], policy="any_of"), (op=:assign, path="done", value=true), (op=:end)]))"""


@register("artifact_plan_joined", "SELECT o_orderkey AS instance, CASE WHEN o_orderkey % 3 = 0 THEN 'end' ELSE 'suspend' END AS control, CASE WHEN o_orderkey % 3 = 0 THEN 'true' END AS done FROM orders")
def artifact_plan_joined(spark, sf):
    """An artifact compiled to a plan whose join waits for a request step by its name; instances past the request run it."""
    plan = evalir.compile_artifact(V.parse(_ARTIFACT))
    asked = plan["steps"][1]["obligations"][0]["params"]["request_hash"]
    start = _instances(spark, sf).withColumn("current_step", F.lit("S0002")).withColumn("control", F.lit("continue")).withColumn("steps_taken", F.lit(1))
    receipts = start.select("instance", F.when(F.col("instance") % 3 == 0, F.lit(asked)).otherwise("sha256:other").alias("request_hash"), F.lit("k").alias("signer"), F.lit(True).alias("signature_valid"))
    return evalir.evaluate(start, plan, receipts=receipts, trusted=["k"]).select("instance", "control", F.col("state.done").cast("string").alias("done"))
