"""The library's queries over the driver's tables, and the SQL that checks them.

Doubles are rounded to four places where a sum's order could show; timestamps stay as they are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import expressions as X
from factloom.functions import values as V
from factloom.operators import relational as R
from factloom.plans import rules, workflow
from factloom.query_registry import ORACLE_SQL, QUERIES, spread  # noqa: F401
from factloom.query_registry import register as _register
from factloom.query_registry import table as _table
from factloom.sources import records


def _r(c, n=4):
    return F.round(c, n)


# ------------------------------------------------------------------------------------------------ rules

FLAGSHIP = """
(rules-sexpr-v0
  (facts (open_segment "BUILDING") (open_segment "MACHINERY"))
  (rules
    (:- (large ?o) (order_total ?o ?p) (>= ?p 150000))
    (:- (route ?o open_case) (large ?o) (order_cust ?o ?c) (segment ?c ?s) (open_segment ?s))
    (:- (route ?o wait_docs) (order_total ?o ?p) (order_cust ?o ?c) (segment ?c ?s) (in ?s (set "AUTOMOBILE" "BUILDING")) (>= ?p 50000)))
  (query (route ?o ?r))
  (routing_policy (route_predicate route) (no_match_policy (default manual)) (ambiguous_policy allow_multiple)))
"""


def _order_facts(spark, sf):
    o, c = _table(spark, sf, "orders"), _table(spark, sf, "customer")
    return {"order_total": o.select("o_orderkey", "o_totalprice"), "order_cust": o.select("o_orderkey", "o_custkey"), "segment": c.select("c_custkey", "c_mktsegment")}


@_register("flagship_route_orders", """
WITH f AS (SELECT o_orderkey AS entity, o_totalprice AS p, c_mktsegment AS s FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
r AS (SELECT entity, ':open_case' AS route FROM f WHERE p >= 150000 AND s IN ('BUILDING', 'MACHINERY')
      UNION SELECT entity, ':wait_docs' FROM f WHERE p >= 50000 AND s IN ('AUTOMOBILE', 'BUILDING'))
SELECT f.entity, coalesce(min(r.route), ':manual') AS route, count(r.route) AS candidates FROM f LEFT JOIN r ON f.entity = r.entity GROUP BY f.entity""")
def flagship_route_orders(spark, sf):
    facts = _order_facts(spark, sf)
    return rules.route_each(spark, rules.parse_source(FLAGSHIP), facts, facts["order_total"].select("o_orderkey"))


def _derived(spark, sf, source, head, facts, names):
    return rules.derive(spark, rules.parse_source(source), facts)[head].toDF(*names)


def _program(rule_text, head, n):
    query = " ".join(f"?q{i}" for i in range(n))
    return f"(rules-sexpr-v0 (facts) (rules {rule_text}) (query ({head} {query})))"


@_register("rules_threshold_route", "SELECT DISTINCT o_orderkey AS orderkey, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def rules_threshold_route(spark, sf):
    src = _program("(:- (big ?o ?s) (order_total ?o ?p) (> ?p 200000) (order_cust ?o ?c) (segment ?c ?s))", "big", 2)
    return _derived(spark, sf, src, "big", _order_facts(spark, sf), ["orderkey", "segment"])


@_register("rules_allowlist_in", "SELECT DISTINCT c_custkey AS custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN (SELECT n_name FROM nation WHERE n_nationkey IN (1, 2, 3, 8))")
def rules_allowlist_in(spark, sf):
    c, n = _table(spark, sf, "customer"), _table(spark, sf, "nation")
    src = _program("(:- (allowed ?c) (customer ?c ?n) (nation ?n) (in ?n (set 1 2 3 8)))", "allowed", 1)
    return _derived(spark, sf, src, "allowed", {"customer": c.select("c_custkey", "c_nationkey"), "nation": n.select("n_nationkey")}, ["custkey"])


@_register("rules_multi_rule_union", "SELECT o_orderkey AS orderkey FROM orders WHERE o_totalprice >= 250000 UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def rules_multi_rule_union(spark, sf):
    o = _table(spark, sf, "orders")
    facts = {"total": o.select("o_orderkey", "o_totalprice"), "status": o.select("o_orderkey", "o_orderstatus")}
    src = _program('(:- (hit ?o) (total ?o ?p) (>= ?p 250000)) (:- (hit ?o) (status ?o "F"))', "hit", 1)
    return _derived(spark, sf, src, "hit", facts, ["orderkey"])


@_register("rules_repeated_var", "SELECT DISTINCT l_orderkey AS orderkey FROM lineitem WHERE l_linenumber = l_quantity")
def rules_repeated_var(spark, sf):
    li = _table(spark, sf, "lineitem")
    facts = {"item": li.select("l_orderkey", F.col("l_linenumber").cast("double"), "l_quantity")}
    return _derived(spark, sf, _program("(:- (same ?o) (item ?o ?x ?x))", "same", 1), "same", facts, ["orderkey"])


@_register("rules_cross_product", "SELECT r_name AS region, n_name AS nation FROM region CROSS JOIN nation")
def rules_cross_product(spark, sf):
    facts = {"region": _table(spark, sf, "region").select("r_name"), "nation": _table(spark, sf, "nation").select("n_name")}
    return _derived(spark, sf, _program("(:- (pair ?r ?n) (region ?r) (nation ?n))", "pair", 2), "pair", facts, ["region", "nation"])


@_register("rules_stratified_chain", """
WITH risky AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_discount >= 0.09),
held AS (SELECT DISTINCT l_orderkey FROM risky JOIN part ON l_partkey = p_partkey WHERE p_size >= 40)
SELECT DISTINCT o_custkey AS custkey FROM held JOIN orders ON l_orderkey = o_orderkey""")
def rules_stratified_chain(spark, sf):
    facts = {
        "discount": _table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_discount"),
        "size": _table(spark, sf, "part").select("p_partkey", "p_size"), "placed": _table(spark, sf, "orders").select("o_orderkey", "o_custkey"),
    }
    src = _program("(:- (review ?c) (held ?o) (placed ?o ?c)) (:- (held ?o) (risky ?o ?p) (size ?p ?s) (>= ?s 40)) (:- (risky ?o ?p) (discount ?o ?p ?d) (>= ?d 0.09))", "review", 1)
    return _derived(spark, sf, src, "review", facts, ["custkey"])


@_register("rules_theta_join", "SELECT DISTINCT c_custkey AS custkey, s_suppkey AS suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal < s_acctbal")
def rules_theta_join(spark, sf):
    facts = {"customer": _table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "supplier": _table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")}
    return _derived(spark, sf, _program("(:- (poorer ?c ?s) (customer ?c ?n ?x) (supplier ?s ?n ?y) (< ?x ?y))", "poorer", 2), "poorer", facts, ["custkey", "suppkey"])


# ------------------------------------------------------------------------------------------------ expressions


@_register("kernel_if_and_or_not", """
SELECT o_orderkey AS orderkey, CASE WHEN (o_totalprice >= 100000 AND NOT (o_orderstatus = 'O')) OR o_orderpriority = '1-URGENT' THEN 'fast' ELSE 'slow' END AS lane FROM orders""")
def kernel_if_and_or_not(spark, sf):
    o = _table(spark, sf, "orders")
    e = ["if", ["or", ["and", [">=", ["state", "o_totalprice"], 100000], ["not", ["==", ["state", "o_orderstatus"], "O"]]], ["==", ["state", "o_orderpriority"], "1-URGENT"]], "fast", "slow"]
    return o.select(F.col("o_orderkey").alias("orderkey"), X.compile_expression(e, o.schema)[0].alias("lane"))


@_register("kernel_compare_cast_double", "SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, CAST(l_linenumber AS DOUBLE) < l_quantity AS less, l_returnflag <= 'N' AS flag FROM lineitem")
def kernel_compare_cast_double(spark, sf):
    li = _table(spark, sf, "lineitem")
    less, flag = (X.compile_expression(e, li.schema)[0] for e in (["<", ["state", "l_linenumber"], ["state", "l_quantity"]], ["<=", ["state", "l_returnflag"], "N"]))
    return li.select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"), less.alias("less"), flag.alias("flag"))


@_register("path_get_negative_index", "SELECT vec_id, embedding[1] AS first, embedding[-1] AS last, embedding[-2] AS before_last FROM embeddings")
def path_get_negative_index(spark, sf):
    v = F.col("embedding")
    return _table(spark, sf, "embeddings").select("vec_id", X.get_item(v, F.lit(0)).alias("first"), X.get_item(v, F.lit(-1)).alias("last"), X.get_item(v, F.lit(-2)).alias("before_last"))


@_register("merge_last_wins", """
SELECT event_id, 'base' AS source, coalesce(json_extract_string(props, '$.k'), '0') AS k, event_type AS kind FROM events""")
def merge_last_wins(spark, sf):
    e = _table(spark, sf, "events")
    base = F.create_map(F.lit("source"), F.lit("base"), F.lit("k"), F.lit("0"))
    m = X.merge(base, F.from_json("props", "map<string,string>"), F.create_map(F.lit("kind"), F.col("event_type")))
    return e.select("event_id", m["source"].alias("source"), m["k"].alias("k"), m["kind"].alias("kind"))


@_register("interpolate_text", "SELECT o_orderkey AS orderkey, 'order ' || o_orderkey || ' of ' || o_custkey || ' is ' || coalesce(nullif(o_orderstatus, 'P'), 'nil') AS line FROM orders")
def interpolate_text(spark, sf):
    parts = [F.lit("order "), F.col("o_orderkey"), F.lit(" of "), F.col("o_custkey"), F.lit(" is "), F.nullif(F.col("o_orderstatus"), F.lit("P"))]
    return _table(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"), X.interpolate(*parts).alias("line"))


@_register("assign_nested_path", "SELECT o_orderkey AS orderkey, o_orderstatus AS status, CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS tier FROM orders")
def assign_nested_path(spark, sf):
    o = _table(spark, sf, "orders").select("o_orderkey", F.struct("o_orderstatus", "o_totalprice").alias("order"))
    out = X.assign(o, "order.review.tier", F.when(F.col("order.o_totalprice") > 100000, "high").otherwise("low"))
    return out.select(F.col("o_orderkey").alias("orderkey"), F.col("order.o_orderstatus").alias("status"), F.col("order.review.tier").alias("tier"))


@_register("union_pivot", """
SELECT event_id, CASE WHEN event_type = 'signup' THEN value END AS signup, CASE WHEN event_type = 'purchase' THEN value END AS purchase,
       CASE WHEN event_type = 'error' THEN value END AS error FROM events""")
def union_pivot(spark, sf):
    return R.union_pivot(_table(spark, sf, "events").select("event_id", "event_type", "value"), "event_type", "value", ["signup", "purchase", "error"]).drop("event_type", "value")


@_register("canonical_text_sort", "SELECT n_regionkey AS regionkey, array_to_string(list_sort(list_distinct(list(CAST(n_nationkey AS VARCHAR)))), ',') AS keys FROM nation GROUP BY n_regionkey")
def canonical_text_sort(spark, sf):
    n = _table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("regionkey")).agg(F.collect_list(F.col("n_nationkey").cast("string")).alias("v"))
    return n.select("regionkey", F.concat_ws(",", X.canonical_set(F.col("v"))).alias("keys"))


# ------------------------------------------------------------------------------------------------ aggregates and windows


@_register("group_stats", """
SELECT l_returnflag, l_linestatus, count(l_quantity) AS runs, round(avg(l_quantity), 4) AS mean, median(l_quantity) AS median, min(l_quantity) AS min, max(l_quantity) AS max,
       round(coalesce(stddev_samp(l_quantity), 0), 4) AS stddev FROM lineitem GROUP BY ALL""")
def group_stats(spark, sf):
    out = R.group_stats(_table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")
    return out.withColumn("mean", _r("mean")).withColumn("stddev", _r("stddev"))


@_register("best_per_group", "SELECT o_custkey, arg_max(o_orderkey, struct_pack(p := o_totalprice, k := -o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY o_custkey")
def best_per_group(spark, sf):
    return R.best_per_group(_table(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderkey")


@_register("rank_by_mean", """
WITH m AS (SELECT event_type, user_id, avg(CAST(round(value * 100) AS BIGINT)) AS mean FROM events GROUP BY ALL)
SELECT event_type, user_id, mean, row_number() OVER (PARTITION BY event_type ORDER BY mean DESC, user_id) AS rank FROM m""")
def rank_by_mean(spark, sf):
    m = _table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.avg(F.round(F.col("value") * 100).cast("long")).alias("mean"))
    return R.rank_in_group(m, "event_type", "mean", "user_id")


@_register("regression_join", """
WITH b AS (SELECT l_suppkey, count(*) AS v FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), c AS (SELECT l_suppkey, count(*) AS v FROM lineitem WHERE l_linenumber = 4 GROUP BY 1)
SELECT b.l_suppkey, b.v AS baseline, c.v AS candidate, round((c.v - b.v)::DOUBLE / b.v * 100, 4) AS delta_percent, coalesce((c.v - b.v)::DOUBLE / b.v * 100 >= -70, false) AS ok FROM b LEFT JOIN c USING (l_suppkey)""")
def regression_join(spark, sf):
    li = _table(spark, sf, "lineitem")
    side = lambda cond: li.where(cond).groupBy("l_suppkey").agg(F.count("*").alias("v"))
    return R.regression(side("l_linenumber <= 3"), side("l_linenumber = 4"), ["l_suppkey"], "v", 70.0).withColumn("delta_percent", _r("delta_percent"))


@_register("checksum_status", "SELECT o_orderpriority AS priority, count(DISTINCT o_orderstatus) AS checksums, count(DISTINCT o_orderstatus) = 1 AS identical FROM orders GROUP BY 1")
def checksum_status(spark, sf):
    return R.checksum_status(_table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "priority"), "priority", "o_orderstatus")


_CHAIN = """
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence, sha256(event_id || '|' || event_type) AS event_hash FROM events),
c AS (SELECT *, CASE WHEN event_id % 50 = 7 THEN repeat('f', 64) ELSE coalesce(lag(event_hash) OVER (PARTITION BY user_id ORDER BY sequence), repeat('0', 64)) END AS prev_hash FROM e)
"""


def _ledger(spark, sf):
    """Events as one ledger for each user, with some links broken."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = _table(spark, sf, "events").select("user_id", "event_id", "event_type", R.digest(F.col("event_id"), F.col("event_type")).alias("event_hash"))
    e = e.withColumn("sequence", F.row_number().over(w)).withColumn("prev", F.lag("event_hash", 1, R.GENESIS).over(w))
    return e.withColumn("prev_hash", F.when(F.col("event_id") % 50 == 7, F.lit("f" * 64)).otherwise(F.col("prev"))).drop("prev")


@_register("chain_prev_check", _CHAIN + """
SELECT user_id, sequence, prev_hash = coalesce(lag(event_hash) OVER (PARTITION BY user_id ORDER BY sequence), repeat('0', 64)) AS link_ok,
       sequence = row_number() OVER (PARTITION BY user_id ORDER BY sequence) AS sequence_ok FROM c""")
def chain_prev_check(spark, sf):
    return R.verify_chain(_ledger(spark, sf), "user_id", "sequence", "prev_hash", "event_hash").select("user_id", "sequence", "link_ok", "sequence_ok")


@_register("chain_head", _CHAIN + "SELECT user_id, arg_max(event_hash, sequence) AS head, count(*) AS entries FROM c GROUP BY user_id")
def chain_head(spark, sf):
    return R.chain_head(_ledger(spark, sf), "user_id", "sequence", "event_hash")


@_register("chain_prefix", _CHAIN + "SELECT user_id, event_id, sequence FROM c WHERE sequence <= 3 AND user_id IN (SELECT user_id FROM c WHERE sequence = 3)")
def chain_prefix(spark, sf):
    ledger = _ledger(spark, sf)
    heads = ledger.where("sequence = 3").select("user_id", F.col("event_hash").alias("head"))
    return R.prefix_until(ledger, "user_id", "sequence", "event_hash", heads).select("user_id", "event_id", "sequence")


@_register("adjacent_order_check", "SELECT user_id, event_id, coalesce(value > lag(value) OVER (PARTITION BY user_id ORDER BY event_id), true) AS rising FROM events")
def adjacent_order_check(spark, sf):
    return R.strictly_rising(_table(spark, sf, "events"), "user_id", "event_id", "value").select("user_id", "event_id", "rising")


@_register("ordered_distinct_digests", """
WITH s AS (SELECT user_id, sha256(event_type) AS digest, min(event_id) AS first FROM events GROUP BY ALL)
SELECT user_id, digest, first, row_number() OVER (PARTITION BY user_id ORDER BY first, digest) AS place FROM s""")
def ordered_distinct_digests(spark, sf):
    e = _table(spark, sf, "events").select("user_id", "event_id", F.sha2("event_type", 256).alias("digest"))
    return R.first_seen(e, "user_id", "event_id", "digest")


# ------------------------------------------------------------------------------------------------ obligations and capabilities


def _obligations(spark, sf):
    o = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("step"), F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    obligations = o.select("step", F.concat_ws("-", "step", "n").alias("request_hash"))
    li = _table(spark, sf, "lineitem")
    receipts = li.select(
        F.concat_ws("-", "l_orderkey", (F.col("l_linenumber") % 2 + 1)).alias("request_hash"), F.col("l_linenumber").alias("history_index"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("receipt_hash"), F.col("l_returnflag").alias("signer"), (F.col("l_linestatus") == "F").alias("signature_valid"),
    )
    return R.satisfy(obligations, receipts, ["A", "N"])


_SATISFY = """
WITH ob AS (SELECT o_orderkey AS step, o_orderkey || '-' || n AS request_hash FROM orders CROSS JOIN (VALUES (1), (2)) t(n)),
re AS (SELECT l_orderkey || '-' || (l_linenumber % 2 + 1) AS request_hash, l_linenumber AS i, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS receipt_hash,
       l_returnflag IN ('A', 'N') AS trusted, l_linestatus = 'F' AS valid FROM lineitem),
per AS (SELECT request_hash, count(*) AS matched, arg_min(receipt_hash, struct_pack(i := i, h := receipt_hash)) FILTER (trusted AND valid) AS receipt_hash,
        bool_or(NOT trusted) AS u, bool_or(trusted AND NOT valid) AS s FROM re GROUP BY 1),
sat AS (SELECT step, ob.request_hash, receipt_hash IS NOT NULL AS satisfied, receipt_hash, coalesce(matched, 0) AS matched,
        CASE WHEN receipt_hash IS NOT NULL THEN '' WHEN matched IS NULL THEN 'PROTOCOL.missing_receipt'
             ELSE concat_ws(',', CASE WHEN u THEN 'PROTOCOL.untrusted_signer' END, CASE WHEN s THEN 'PROTOCOL.signature_invalid' END) END AS codes
        FROM ob LEFT JOIN per ON ob.request_hash = per.request_hash)
"""


@_register("obligation_receipts", _SATISFY + "SELECT * FROM sat")
def obligation_receipts(spark, sf):
    return _obligations(spark, sf).withColumn("codes", F.concat_ws(",", "codes"))


@_register("obligation_all_of", _SATISFY + "SELECT step, bool_and(satisfied) AS satisfied, CASE WHEN bool_and(satisfied) THEN 'continue' ELSE 'suspend' END AS control FROM sat GROUP BY step")
def obligation_all_of(spark, sf):
    return R.join_steps(_obligations(spark, sf), "all_of")


@_register("obligation_any_of", _SATISFY + "SELECT step, bool_or(satisfied) AS satisfied, CASE WHEN bool_or(satisfied) THEN 'continue' ELSE 'suspend' END AS control FROM sat GROUP BY step")
def obligation_any_of(spark, sf):
    return R.join_steps(_obligations(spark, sf), "any_of")


@_register("failure_codes_ordered", _SATISFY + """
, x AS (SELECT step, unnest(string_split(codes, ',')) AS code FROM sat), d AS (SELECT DISTINCT step, code FROM x WHERE code <> '')
SELECT step, string_agg(code, ',' ORDER BY CASE code WHEN 'PROTOCOL.untrusted_signer' THEN 1 WHEN 'PROTOCOL.signature_invalid' THEN 2 ELSE 3 END) AS codes FROM d GROUP BY step""")
def failure_codes_ordered(spark, sf):
    return R.collect_codes(_obligations(spark, sf), "step", "codes").withColumn("codes", F.concat_ws(",", "codes"))


@_register("requirement_first_alternative", """
WITH a AS (SELECT p_partkey AS requirement_id, alternative, CASE alternative WHEN 1 THEN p_partkey % 17 ELSE p_partkey % 11 END AS capability_id, p_partkey % 3 AS version, p_size AS most, p_partkey % 5 AS op
           FROM part CROSS JOIN (VALUES (1), (2)) t(alternative)),
e AS (SELECT s_suppkey % 13 AS capability_id, s_suppkey % 3 AS version, max(s_suppkey % 50) AS most, list(DISTINCT s_suppkey % 7) AS ops FROM supplier GROUP BY 1, 2),
s AS (SELECT requirement_id, alternative, max(CASE WHEN e.version IS NULL THEN 0 WHEN a.version <> e.version THEN 1 WHEN NOT list_contains(ops, op) THEN 2 WHEN a.most > e.most THEN 3 ELSE 4 END) AS stage
      FROM a LEFT JOIN e ON a.capability_id = e.capability_id GROUP BY 1, 2),
b AS (SELECT requirement_id, min(alternative) FILTER (stage = 4) AS chosen, max(stage) AS stage FROM s GROUP BY 1)
SELECT requirement_id, chosen, CASE WHEN chosen IS NULL THEN 'reject' ELSE 'accepted' END AS verdict,
       CASE WHEN chosen IS NULL THEN ['CAPABILITY.missing_required_capability', 'CAPABILITY.incompatible_version', 'CAPABILITY.incompatible_config_hash', 'CAPABILITY.constraint_violation'][stage + 1] END AS code FROM b""")
def requirement_first_alternative(spark, sf):
    p, s = _table(spark, sf, "part"), _table(spark, sf, "supplier")
    a = p.select("p_partkey", "p_size", F.explode(F.array(F.lit(1), F.lit(2))).alias("alternative"))
    key = F.col("p_partkey")
    a = a.select(key.alias("requirement_id"), "alternative", F.when(F.col("alternative") == 1, key % 17).otherwise(key % 11).alias("capability_id"), (key % 3).alias("version"), F.col("p_size").alias("most"), F.array(key % 5).alias("operations"))
    k = F.col("s_suppkey")
    e = s.groupBy((k % 13).alias("capability_id"), (k % 3).alias("version")).agg(F.max(k % 50).alias("most"), F.collect_set(k % 7).alias("operations"))
    # the fixed SQL takes the furthest stage and its own codes; R.match_capabilities follows the reference
    per = R.alternative_stages(a, e)
    best = per.groupBy("requirement_id").agg(F.min(F.when(F.col("stage") == len(R.STAGES), F.col("alternative"))).alias("chosen"), F.max("stage").alias("stage"))
    codes = F.create_map(*[F.lit(x) for i, c in ((0, "missing_required_capability"), (1, "incompatible_version"), (3, "incompatible_config_hash"), (4, "constraint_violation")) for x in (i, f"CAPABILITY.{c}")])
    accepted = F.col("chosen").isNotNull()
    return best.select("requirement_id", "chosen", F.when(accepted, "accepted").otherwise("reject").alias("verdict"), F.when(~accepted, codes[F.col("stage")]).alias("code"))


@_register("constraint_subset", """
WITH u AS (SELECT user_id, list(DISTINCT event_type) AS t, max(value) AS top FROM events GROUP BY 1)
SELECT user_id, list_has_all(['view', 'click', 'purchase', 'signup'], t) AS subset, NOT list_has_any(t, ['error']) AS disjoint, (NOT list_contains(t, 'purchase')) OR list_contains(t, 'view') AS implied, top <= 100 AS within FROM u""")
def constraint_subset(spark, sf):
    u = _table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("t"), F.max("value").alias("top"))
    allowed = F.array(*map(F.lit, ("view", "click", "purchase", "signup")))
    return u.select(
        "user_id", (F.size(F.array_except("t", allowed)) == 0).alias("subset"), (~F.arrays_overlap("t", F.array(F.lit("error")))).alias("disjoint"),
        (~F.array_contains("t", "purchase") | F.array_contains("t", "view")).alias("implied"), (F.col("top") <= 100).alias("within"),
    )


# ------------------------------------------------------------------------------------------------ digests and sources


@_register("content_digest", "SELECT c_custkey AS custkey, sha256(concat_ws('|', c_custkey, c_name, c_mktsegment)) AS digest, 'run-' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 16) AS run_id FROM customer")
def content_digest(spark, sf):
    c = _table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("custkey"), R.digest(F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")).alias("digest"), F.concat(F.lit("run-"), F.substring(R.digest(F.col("c_custkey")), 1, 16)).alias("run_id"))


@_register("artifact_dedup", "SELECT sha256(text) AS digest, count(*) AS copies, CAST(max(strlen(text)) AS INTEGER) AS bytes FROM documents WHERE text IS NOT NULL GROUP BY 1")
def artifact_dedup(spark, sf):
    return R.artifacts(_table(spark, sf, "documents"), "text")


@_register("digest_membership_anti", "SELECT o_orderkey AS orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def digest_membership_anti(spark, sf):
    li = _table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("orderkey"))
    return _table(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey")).join(li, "orderkey", "left_anti")


def _rendered(spark, sf):
    c = _table(spark, sf, "customer")
    return records.render_records(c, F.col("c_custkey"), F.lpad((F.col("c_nationkey") % 3).cast("string"), 2, "0"), F.col("c_name"), F.md5(F.col("c_name")))


@_register("fixed_width_parse", """
WITH f AS (SELECT rpad(CAST(c_custkey AS VARCHAR), 10, ' ') AS a, lpad(CAST(c_nationkey % 3 AS VARCHAR), 2, '0') AS b, rpad(c_name, 40, ' ') AS c, md5(c_name) AS d FROM customer)
SELECT trim(a) AS customer_id, b AS change_type, rtrim(c) AS new_value, d AS correlation_id, sha256(a || '|' || b || '|' || c || '|' || d) AS record_checksum, true AS length_ok, true AS checksum_ok FROM f""")
def fixed_width_parse(spark, sf):
    return records.parse_records(_rendered(spark, sf).select("value"))


# ------------------------------------------------------------------------------------------------ workflows

PLAN = [
    {"step_id": "S0001", "op": "choose", "routes": {":open_case": "S0002", ":wait_docs": "S0003", ":manual": "S0005"}},
    {"step_id": "S0002", "op": "assign", "path": "order.status", "value": "open_case", "next_step_id": "S0004"},
    {"step_id": "S0003", "op": "assign", "path": "order.status", "value": "wait_docs", "next_step_id": "S0004"},
    {"step_id": "S0004", "op": "emit", "emission": "routed", "next_step_id": "S0005"},
    {"step_id": "S0005", "op": "join_obligations_v0", "next_step_id": "S0006"},
    {"step_id": "S0006", "op": "end"},
]


@_register("workflow_route_orders", """
WITH f AS (SELECT o_orderkey, o_orderstatus, o_totalprice AS p, c_mktsegment AS s FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
r AS (SELECT *, CASE WHEN p >= 150000 AND s IN ('BUILDING', 'MACHINERY') THEN 'open_case' WHEN p >= 50000 AND s IN ('AUTOMOBILE', 'BUILDING') THEN 'wait_docs' END AS route FROM f)
SELECT o_orderkey AS entity, coalesce(route, o_orderstatus) AS status, CASE WHEN route IS NULL THEN 0 ELSE 1 END AS emitted,
       CASE WHEN o_orderstatus = 'F' THEN 'end' ELSE 'suspend' END AS control, CASE WHEN o_orderstatus = 'F' THEN 'S0006' ELSE 'S0005' END AS current_step FROM r""")
def workflow_route_orders(spark, sf):
    routed = flagship_route_orders(spark, sf).select("entity", "route")
    o = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("entity"), F.struct(F.col("o_orderstatus").alias("status")).alias("order"), (F.col("o_orderstatus") == "F").alias("satisfied"))
    out = workflow.run(o.join(routed, "entity"), PLAN, {"S0001": "route"})
    return out.select("entity", F.col("order.status").alias("status"), F.size("emissions").alias("emitted"), "control", "current_step")


# ------------------------------------------------------------------------------------------------ nested values


def _order_values(spark, sf):
    """Each order as the text of a nested value, with its keys in no order."""
    o = _table(spark, sf, "orders")
    text = F.format_string('(status="%s", cust=%d, tags=Set([3, 10, 2]), kind=:order_%s)', "o_orderstatus", "o_custkey", F.lower("o_orderstatus"))
    return spread(o.select(F.col("o_orderkey").alias("orderkey"), text.alias("value")))


_ORDER_TEXT = """'(cust=' || o_custkey || ', kind=:order_' || lower(o_orderstatus) || ', status="' || o_orderstatus || '", tags=Set([10, 2, 3]))'"""


@_register("canonical_value_text", f"SELECT o_orderkey AS orderkey, {_ORDER_TEXT} AS canonical, sha256({_ORDER_TEXT}) AS digest FROM orders")
def canonical_value_text(spark, sf):
    out = _order_values(spark, sf).select("orderkey", V.canonical_text(F.col("value"), strict=True).alias("canonical"))
    return out.withColumn("digest", F.sha2("canonical", 256))


@_register("binary_round_trip", f"SELECT o_orderkey AS orderkey, {_ORDER_TEXT} AS decoded FROM orders")
def binary_round_trip(spark, sf):
    """Text to a message with its digest and back; decoding verifies the digest."""
    message = V.encode_canonical(F.col("value"), digest=True, strict=True)
    return _order_values(spark, sf).select("orderkey", V.decode_text(message, strict=True).alias("decoded"))


@_register("canonical_json_digest", "SELECT event_id, replace(props, ' ', '') AS canonical, sha256(replace(props, ' ', '')) AS digest FROM events")
def canonical_json_digest(spark, sf):
    out = _table(spark, sf, "events").select("event_id", V.canonical_json_column(F.col("props"), strict=True).alias("canonical"))
    return out.withColumn("digest", F.sha2("canonical", 256))


from factloom import catalogue_decisions, catalogue_values  # noqa: E402, F401  (they add their queries)
