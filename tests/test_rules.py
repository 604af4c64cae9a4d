import pytest

from factloom.plans import rules, workflow
from factloom.plans.rules import RulesError, parse_json, parse_source, solve

RISK = """(rules-sexpr-v0 (facts (risk_score "case-001" 82) (doc_complete "case-001" true) (doc_complete "case-001" true))
 (rules (:- (route open_case) (risk_score ?case ?score) (>= ?score 80) (doc_complete ?case true)) (:- (route wait_docs) (doc_complete ?case false)))
 (query (route ?r)) (routing_policy (route_predicate route) (no_match_policy (default wait_docs)) (ambiguous_policy allow_multiple)))"""


def test_risk_routing(spark):
    assert solve(spark, parse_source(RISK)) == ":open_case"
    assert solve(spark, parse_source(RISK.replace("82", "12"))) == ":wait_docs"


def test_chained_rules_run_producers_first(spark):
    p = parse_json({
        "facts": [["score", "a", 9]], "rules": [{"head": ["route", ":x"], "body": [["risky", "?c"]]}, {"head": ["risky", "?c"], "body": [["score", "?c", "?s"], [">", "?s", 5]]}],
        "query": ["route", "?r"],
    })
    assert solve(spark, p) == ":x"


@pytest.mark.parametrize(("rule", "code"), [
    ({"head": ["route", "?x"], "body": [["f", "?y"]]}, rules.UNBOUND),
    ({"head": ["route", ":a"], "body": [["f", "?y"], [">", "?z", 1]]}, rules.UNBOUND),
    ({"head": ["route", ":a"], "body": [["not", "?y"]]}, rules.FORBIDDEN),
    ({"head": ["route", ":a"], "body": [["route", "?y"]]}, rules.FORBIDDEN),
    ({"head": ["route", ":a"], "body": [["f", "?y", 1]]}, rules.TYPE),
])
def test_rejected_programs(rule, code):
    with pytest.raises(RulesError) as e:
        parse_json({"facts": [["f", "a"]], "rules": [rule], "query": ["route", "?r"]})
    assert e.value.code == code


def test_policies(spark):
    spec = {"facts": [["f", "a"]], "rules": [{"head": ["route", ":b"], "body": [["f", "?x"]]}, {"head": ["route", ":a"], "body": [["f", "?x"]]}], "query": ["route", "?r"]}
    with pytest.raises(RulesError, match=rules.AMBIGUOUS):
        solve(spark, parse_json(spec))
    assert solve(spark, parse_json(spec | {"on_ambiguous": "choose-first"})) == ":a"
    with pytest.raises(RulesError, match=rules.NO_MATCH):
        solve(spark, parse_json(spec | {"facts": []}))


def test_first_of_many_routes(spark):
    p = parse_json({"facts": [], "rules": [{"head": ["route", "?r"], "body": [["candidate", "?r"]]}], "query": ["route", "?r"], "on_ambiguous": "choose-first"})
    many = spark.range(5000, 0, -1, 8).selectExpr("concat(':r', lpad(id, 5, '0')) AS r")
    assert solve(spark, p, {"candidate": many}) == ":r00001"
    assert solve(spark, p, {"candidate": many.where("r > ':r04000'")}) == ":r04001"
    p.ambiguous = "error"
    with pytest.raises(RulesError, match=rules.AMBIGUOUS):
        solve(spark, p, {"candidate": many})


def test_plans():
    with pytest.raises(workflow.PlanError):
        workflow.validate([{"step_id": "S0002", "op": "end"}, {"step_id": "S0001", "op": "end"}])
    with pytest.raises(workflow.PlanError):
        workflow.validate([{"step_id": "S0001", "op": "emit", "emission": "x", "next_step_id": "S0001"}, {"step_id": "S0002", "op": "end"}])


def test_many_to_many_rules_have_each_row_once(spark):
    left = spark.createDataFrame([(i % 40, i % 3, float(i % 7)) for i in range(90)] + [(100, 1, 2.0)] * 2 + [(None, 1, 0.0), (None, 2, 0.0), (101, None, 1.0), (102, 0, None)], "c long, n int, x double")
    right = spark.createDataFrame([(i % 25, i % 3, float(i % 11)) for i in range(60)] + [(200, 1, 9.0), (200, 1, 9.0), (201, 1, None), (None, 1, 5.0)], "s long, n int, y double")
    for rule, keep in (
        ('(:- (pair ?c ?s) (left ?c ?n ?x) (right ?s ?n ?y) (< ?x ?y))', lambda c, n, x, s, m, y: n is not None and n == m and None not in (x, y) and x < y),
        ('(:- (pair ?c ?s) (left ?c ?n ?x) (right ?s ?m ?y))', lambda *_: True),
        ('(:- (pair ?c ?s) (left ?c 1 ?x) (> ?x 1) (right ?s ?n ?n))', lambda c, n, x, s, m, y: n == 1 and x > 1 and None not in (m, y) and m == y),
    ):
        got = rules.derive(spark, parse_source(f"(rules-sexpr-v0 (facts) (rules {rule}) (query (pair ?a ?b)))"), {"left": left, "right": right})["pair"].collect()
        want = {(a[0], b[0]) for a in left.collect() for b in right.collect() if keep(*a, *b)}
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_single_rows_pair_without_a_distinct(spark):
    """Pairs of rows that are alone under their ids, as keys are, aren't shuffled to be told apart."""
    left, right = (spark.range(200).selectExpr("id", "id % 2 AS n", "double(id) AS x") for _ in range(2))
    source = "(rules-sexpr-v0 (facts) (rules (:- (poorer ?c ?s) (left ?c ?n ?x) (right ?s ?n ?y) (< ?x ?y))) (query (poorer ?a ?b)))"
    out = rules.derive(spark, parse_source(source), {"left": left, "right": right})["poorer"]
    assert out.count() == 2 * 100 * 99 // 2
    top = out._jdf.queryExecution().optimizedPlan()
    assert top.nodeName() == "Union" and [top.children().apply(i).toString().startswith("Aggregate") for i in range(2)] == [False, True]
