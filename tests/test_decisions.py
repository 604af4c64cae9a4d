import hashlib
import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.operators import evidence as E
from factloom.operators import identity as I
from factloom.operators import relational as R
from factloom.plans import evalir
from factloom.plans.rules import RulesError, parse_json, parse_source, solve


def test_float_text():
    assert [I.float_text(x) for x in (0.0, -0.0, 1.0, 0.1, 1e21, 1e-7, -2.5)] == ["0", "0", "1", "0.10000000000000001", "1e21", "9.9999999999999995e-8", "-2.5"]
    with pytest.raises(V.ValueFormatError):
        I.float_text(float("nan"))
    assert I.json_text({"b": [1, None, True, "é"], "a": {}}) == '{"a":{},"b":[1,null,true,"é"]}'


def test_identities(spark):
    one = spark.createDataFrame([('{"a":1}', 'say "hi"\n')], "args string, t string")
    key = I.request_key(F.lit("A"), F.lit("S0001"), I.args_hash(F.col("args")), cursor=F.lit(4).cast("long"), process=F.lit("p"))
    sha = lambda s: "sha256:" + hashlib.sha256(s.encode()).hexdigest()
    want = json.dumps({"args_hash": sha('{"a":1}'), "artifact_hash": "A", "history_cursor": 4, "process_id": "p", "request_ordinal": 1, "step_id": "S0001"}, separators=(",", ":"))
    got = one.select(key.alias("k"), I.quoted(F.col("t")).alias("q")).first()
    assert got.k == sha(want) and json.loads(got.q) == 'say "hi"\n'


def test_ledger(spark, tmp_path):
    from factloom.streaming.ledger import kafka_rows, ledger_sink

    e = spark.createDataFrame([("x", i, f'{{"n":{i}}}') for i in range(5)] + [("y", 0, '{"n":0}')], "ledger string, k int, event string")
    prev, want = "0" * 64, []
    for i in range(5):
        prev = hashlib.sha256(f'{{"event":{{"n":{i}}},"prev_hash":"{prev}","sequence":{i + 1}}}'.encode()).hexdigest()
        want.append(prev)
    built = I.build_ledger(e, "ledger", ["k"], "event")
    assert [r.event_hash for r in built.where("ledger = 'x'").orderBy("sequence").collect()] == want
    with pytest.raises(Exception, match="head_hash not found"):
        I.export_chain(built, "ledger", spark.createDataFrame([("x", "f" * 64)], "ledger string, head string")).collect()
    write = ledger_sink(str(tmp_path / "l"), "ledger", ["k"], "event")
    write(e.where("k < 3"), 0)
    write(e.where("k >= 3"), 1)
    write(e.where("k >= 3"), 1)  # a trigger that is run again
    kept = spark.read.parquet(str(tmp_path / "l"))
    assert [r.event_hash for r in kept.where("ledger = 'x'").orderBy("sequence").collect()] == want and kept.count() == 6
    I.ledger_lines(built).select("value").coalesce(1).write.text(str(tmp_path / "t"))
    back = I.check_ledger(I.read_ledger(spark, str(tmp_path / "t")).where("sequence > 0").withColumn("ledger", F.when(F.get_json_object("event", "$.n") < 0, "").otherwise("x")).where("sequence > 1 OR true"), "ledger")
    assert back.where("hash_ok").count() == 6
    assert kafka_rows(e, "ledger", "t").first().value == '{"event":"{\\"n\\":0}","k":0,"ledger":"x"}'


def test_frames_arrive_in_any_cut(spark, tmp_path):
    from factloom.sources.records import encode_frame
    from factloom.streaming.frames import frame_stream

    whole = b"".join(encode_frame(bytes([65 + i]) * (i + 1)) for i in range(6))
    pieces = [whole[i : i + 3] for i in range(0, len(whole), 3)]
    rows = [("good", i, p, i == len(pieces) - 1) for i, p in enumerate(pieces)] + [("cut", 0, whole[:9], True), ("bad", 0, b"\0\0\0\0", False), ("bad", 1, whole, False)]
    df = spark.createDataFrame(rows, "stream string, place int, data binary, last boolean")
    for n, part in enumerate((df.where("place < 4"), df.where("place >= 4"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = frame_stream(stream).writeStream.format("memory").queryName("frames").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("frames").collect()
    assert sorted((r.frame, r.length) for r in got if r.stream == "good" and r.error is None) == [(i + 1, i + 1) for i in range(6)]
    assert [(r.frame, r.error) for r in got if r.stream == "cut" and r.error] == [(2, "FRAMING_TRUNCATED_HEADER")] or [(r.frame, r.error) for r in got if r.stream == "cut" and r.error] == [(2, "FRAMING_TRUNCATED_PAYLOAD")]
    assert [(r.frame, r.error) for r in got if r.stream == "bad"] == [(1, "FRAMING_LENGTH_ZERO")]


def test_receipt_folder_and_anchors(spark, tmp_path):
    receipt = V.encode(V.parse("(b=1, a=2)"))
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / f"{7:020d}.receipt.x.bin").write_bytes(receipt)
    (tmp_path / "h" / f"{8:020d}.receipt.x.bin").write_bytes(b"damaged")
    (tmp_path / "h" / "notes.bin").write_bytes(receipt)
    got = {int(r.history_index): r.receipt_hash for r in E.read_receipts(spark, str(tmp_path / "h")).collect()}
    assert got == {7: "sha256:" + hashlib.sha256(V.encode(V.parse("(a=2, b=1)"))).hexdigest(), 8: None}
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "key1.pub").write_bytes(bytes(range(32)))
    (tmp_path / "k" / "key2.hex").write_text("ab" * 32)
    (tmp_path / "k" / "key3.txt").write_text("no key")
    assert {r.key_id: bytes(r.public_key) for r in E.read_trust_anchors(spark, str(tmp_path / "k")).collect()} == {"key1": bytes(range(32)), "key2": b"\xab" * 32}


def test_artifact_store(spark, tmp_path):
    path, df = str(tmp_path / "s"), spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "c string")
    E.store_artifacts(df, "c", path)
    E.store_artifacts(df, "c", path)
    store = spark.read.parquet(path)
    assert store.count() == 2
    wanted = spark.createDataFrame([(hashlib.sha256(x).hexdigest(),) for x in (b"a", b"z")], "digest string")
    assert sorted(r.status for r in E.load_artifacts(wanted, store).collect()) == ["missing", "ok"]


def test_vector_files(spark, tmp_path):
    v = {"schema_version": "1", "format_id": "f", "vectors": [
        {"id": "b", "levels": ["L0"], "inputs": {"x": {"path": "a/b"}}, "expected": {"verdict": "pass", "failure_codes": []}},
        {"id": "a", "levels": ["L0"], "inputs": {"x": {"path": "../b"}}, "expected": {"verdict": "pass", "failure_codes": []}},
        {"id": "c", "levels": [], "inputs": {}, "expected": {"verdict": "pass", "failure_codes": ["X.y"]}},
    ]}
    (tmp_path / "v.json").write_text(json.dumps(v))
    assert [(r.id, r.problem) for r in E.read_vectors(spark, str(tmp_path / "v.json")).collect()] == [("a", "path"), ("b", None), ("c", "levels")]


def test_constraint_kinds_by_name():
    assert [R.constraint_kind(*x) for x in (("host_allowlist", 1), ("max_size", True), ("allow_net", 3), ("x", True), ("x", 3), ("x", ["a"]), ("x", "s"))] == ["set", "max", "flag", "flag", "max", "set", "raw"]


def test_atoms_strings_and_bans(spark):
    base = {"facts": [["f", ":x"], ["g", "x"]], "query": ["route", "?r"], "on_no_match": {"default": ":none"}, "on_ambiguous": "choose-first"}
    rule = lambda *body: parse_json(base | {"rules": [{"head": ["route", ":hit"], "body": list(body)}]})
    assert solve(spark, rule(["f", ":x"])) == ":hit" and solve(spark, parse_source('(rules-sexpr-v0 (facts (f ":x")) (rules (:- (route hit) (f :x))) (query (route ?r)) (routing_policy (no_match_policy (default none))))')) == ":none"
    assert solve(spark, rule(["f", "?a"], ["g", "?a"])) == ":none" and solve(spark, rule(["=", 1, 1], ["notice", 2])) == ":none" and solve(spark, rule(["=", 1, 1], ["g", "?a"], ["!=", "?a", "y"])) == ":hit"
    with pytest.raises(RulesError, match="EVAL.type_mismatch"):
        solve(spark, rule(["f", "?a"], ["=", "?a", "x"]))
    for name in ("not", "not(x)"):
        with pytest.raises(RulesError, match="EVAL.forbidden_feature"):
            rule([name, "?a"])


def plan(*steps, **more):
    ids = [f"S{i + 1:04d}" for i in range(len(steps))]
    made = [{"step_id": ids[i], **({"next_step_id": ids[i + 1]} if s["op"] not in ("end", "choose_rules_v0") else {}), **s} for i, s in enumerate(steps)]
    return evalir.load(json.dumps({"format_id": "evalir", "ir_version": "v0", "entry_step_id": "S0001", "steps": made} | more))


END = {"op": "end"}


@pytest.mark.parametrize(("bad", "codes"), [
    ({"steps": []}, [evalir.IDENTITY]), ({"entry_step_id": "S0002"}, None), ({"ir_version": "v9"}, [evalir.STATE]),
])
def test_refused_plans(bad, codes):
    got = evalir.validate(plan({"op": "emit", "emission": 1}, END, **bad))
    assert got == codes if codes else got
    assert evalir.validate(plan({"op": "emit"}, END)) == [evalir.CONTRACT] and evalir.validate(plan(END, END)) == [evalir.IDENTITY, evalir.CONTRACT]
    assert evalir.validate(plan({"op": "join_obligations_v0", "obligations": []}, END)) == [evalir.MISMATCH]
    with pytest.raises(evalir.PlanFailure, match="E_STATE_INVALID"):
        evalir.load("{")


def test_plan_over_rows(spark):
    p = plan({"op": "assign", "path": "out.total", "value": {"$expr": "state_get", "path": "n"}}, {"op": "assign", "path": "out.big", "value": {"$expr": ">", "left": {"$expr": "state_get", "path": "out.total"}, "right": 1.5}},
             {"op": "assign", "path": "items", "value": [{"$expr": "state_get", "path": "n"}, 7]}, END)
    df = spark.createDataFrame([(1, (1,)), (2, (2,)), (3, (None,))], "instance int, state struct<n int>")
    got = {r.instance: r for r in evalir.evaluate(df, p).collect()}
    assert (got[2].control, got[2].state.out.total, got[2].state.out.big, got[2].state["items"]) == ("end", 2, True, [2, 7]) and got[1].state.out.big is False
    assert (got[3].control, got[3].errors, got[3].current_step) == ("error", [evalir.CONTRACT], "S0001")
    with pytest.raises(evalir.PlanFailure):
        evalir.evaluate(df, plan({"op": "assign", "path": "n", "value": "text"}, END))


ARTIFACT = 'Tagged("workflow_artifact_v0", (id="a", version="v0", steps=[%s (op=:end)]))'


@pytest.mark.parametrize(("steps", "code"), [
    ('(op=:choose_rules_v0),', evalir.CONTRACT), ('(op=:emit),', evalir.STATE), ('(op=:emit, emission=1, name="a"), (op=:emit, emission=1, name="a"),', evalir.IDENTITY), ("(op=:end),", evalir.CONTRACT),
    ('(op=:join_obligations_v0, wait_for_steps=["none"]),', evalir.MISMATCH), ('(op=:emit, emission=1), (op=:join_obligations_v0, wait_for_steps=[1]),', evalir.CONTRACT), ('(op=:assign, path="", value=1),', evalir.CONTRACT),
    ('(op=:request, capability_id="c", operation="o", args=("\\$expr"="state_get", path="x")), (op=:join_obligations_v0, wait_for_steps=[1]),', evalir.CONTRACT),
])
def test_refused_artifacts(steps, code):
    with pytest.raises(evalir.PlanFailure) as e:
        evalir.compile_artifact(V.parse(ARTIFACT % steps))
    assert e.value.codes == [code]


def test_artifact_files(spark, tmp_path):
    text = ARTIFACT % '(op=:request, name="r", capability_id="c", operation="o", args=(b=1, a=2)), (op=:join_obligations_v0, wait_for_steps=["r"]),'
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.bin").write_bytes(V.encode(V.parse(text)))
    (tmp_path / "c.txt").write_text("(")
    got = {r.path.rsplit("/", 1)[1]: r for r in evalir.read_artifacts(spark, str(tmp_path)).collect()}
    assert got["a.txt"].plan == got["b.bin"].plan and got["c.txt"].codes == [evalir.STATE]
    made = json.loads(got["a.txt"].plan)
    assert evalir.validate(made) == [] and made["steps"][1]["obligations"][0]["params"]["request_hash"].startswith("sha256:") and [s["step_id"] for s in made["steps"]] == ["S0001", "S0002", "S0003"]


def test_tokens_are_keyed_hashes(spark):
    import base64
    import hmac

    one = spark.createDataFrame([("r", "owner", "sha256:" + "a" * 64, "b" * 24)], "run string, role string, d string, nonce string")
    token = E.signing_token(*map(F.col, ("run", "role", "d", "nonce")), b"k" * 70)
    got = one.select(token.alias("t"), E.check_token(token, b"k" * 70)["role"].alias("role"), E.check_token(token, b"other").alias("wrong"), E.check_token(F.lit("!"), b"k").alias("bad")).first()
    parts = base64.urlsafe_b64decode(got.t + "=" * (-len(got.t) % 4)).decode().split(".")
    assert parts[4] == hmac.new(b"k" * 70, "|".join(parts[:4]).encode(), "sha256").hexdigest() and got.role == "owner" and got.wrong is None and got.bad is None


def test_codes_of_groups(spark):
    df = spark.createDataFrame([(1, ["EVAL.E_STATE_INVALID", "X.b"]), (1, ["CAPABILITY.constraint_violation", "PROTOCOL.missing_receipt", "KERNEL.z"]), (2, []), (3, ["PROTOCOL.policy_violation"])], "g int, codes array<string>")
    got = {r.g: r.codes for r in R.collect_codes(df, "g", "codes").collect()}
    assert got == {1: ["KERNEL.z", "EVAL.E_STATE_INVALID", "PROTOCOL.missing_receipt", "CAPABILITY.constraint_violation", "X.b"], 3: ["PROTOCOL.policy_violation"]}


def test_chains_in_blocks(spark):
    from pyspark.sql import Window

    rows = [(ledger, s, f"h{s - 1}" if s % 13 else "broken", f"h{s}") for ledger in ("a", "b", None) for s in range(1, 60) if not (ledger == "b" and s in (20, 40))]
    df = spark.createDataFrame(rows, "ledger string, s int, prev string, hash string")
    w = Window.partitionBy("ledger").orderBy("s")
    want = df.select("ledger", "s", (F.col("prev") == F.lag("hash", 1, R.GENESIS).over(w)).alias("link_ok"), (F.col("s") == F.row_number().over(w)).alias("sequence_ok"))
    got = R.verify_chain(df, "ledger", "s", "prev", "hash", block=8).select("ledger", "s", "link_ok", "sequence_ok")
    key = lambda r: (r.ledger or "", r.s)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_bundles_and_traces(spark, tmp_path):
    for name, content in (("one", b"a"), ("two", b"b")):
        (tmp_path / "bundles" / name / "sub").mkdir(parents=True)
        (tmp_path / "bundles" / name / "sub" / "x.bin").write_bytes(content)
    files = E.read_bundles(spark, str(tmp_path / "bundles"))
    refs = spark.createDataFrame([("one", "sub/x.bin", "sha256:" + hashlib.sha256(b"a").hexdigest()), ("two", "sub/x.bin", "sha256:" + "0" * 64), ("two", "none", "x")], "bundle string, path string, expected string")
    assert sorted((r.bundle, r.path, r.code) for r in E.check_bundles(files, refs).collect()) == [("one", "sub/x.bin", None), ("two", "none", "EVAL.E_STATE_INVALID"), ("two", "sub/x.bin", "EVAL.E_ARTIFACT_IDENTITY")]
    I.write_lines(spark.createDataFrame([("s", 1)], "step string, n int"), str(tmp_path / "trace"), step=F.col("step"), n=F.col("n"))
    assert [r.value for r in I.read_lines(spark, str(tmp_path / "trace")).collect()] == ['{"n":1,"step":"s"}']


def test_ledgers_hold_together_where_a_join_turns_broadcast(spark, tmp_path):
    rows = [(None if i % 5 == 4 else i % 5, i // 5, f'{{"n":{i}}}') for i in range(400)]
    for k in range(4):  # every ledger in every file
        spark.createDataFrame(rows[k::4], "ledger int, k int, event string").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    first = I.build_ledger(e.where("k < 40"), "ledger", ["k"], "event")
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.files.openCostInBytes": "128m"}
    for name, value in changed.items():
        spark.conf.set(name, value)
    try:
        second = I.build_ledger(e.where("k >= 40"), "ledger", ["k"], "event", R.chain_head(first, "ledger", "sequence", "event_hash"))
        got = I.check_ledger(first.union(second), "ledger").collect()
    finally:
        for name in changed:
            spark.conf.unset(name)
    assert len(got) == 400 and all(r.sequence == r.k + 1 and r.link_ok and r.hash_ok and r.sequence_ok for r in got)


def test_events_that_tie_follow_by_their_text(spark):
    e = spark.createDataFrame([("x", 1, f'{{"n":{i}}}') for i in (3, 1, 2)], "ledger string, k int, event string")
    assert [r.event for r in I.build_ledger(e, "ledger", ["k"], "event").orderBy("sequence").collect()] == ['{"n":1}', '{"n":2}', '{"n":3}']


def test_ledger_append_takes_every_event(spark, tmp_path):
    import duckdb

    from factloom import catalogue

    rows = [(u, i, ("view", "error")[(i or 0) % 2]) for u in (1, None) for i in (-5, -4, -3, 0, 1, 2, 3, None)]
    spark.createDataFrame(rows, "user_id long, event_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = catalogue.QUERIES["ledger_append"](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, got), key=repr) == sorted(db.sql(catalogue.ORACLE_SQL["ledger_append"]).fetchall(), key=repr)
