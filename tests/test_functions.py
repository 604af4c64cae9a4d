import pytest
from pyspark.sql import functions as F

from factloom.functions import expressions as X
from factloom.operators import relational as R
from factloom.sources.records import FrameDecoder, encode_frame, parse_records, read_frames, render_records


def test_scalar_functions(spark):
    df = spark.createDataFrame([("007.50",), ("-0",), ("+3",), ("1e5",), (".5",), ("10",)], "d string")
    assert [r[0] for r in df.select(X.canonical_decimal(F.col("d"))).collect()] == ["7.5", "0", "3", None, None, "10"]
    one = spark.range(1).select(X.merge(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("c"), F.lit(3), F.lit("a"), F.lit(9))).alias("m"))
    assert list(one.first()["m"].items()) == [("a", 9), ("b", 2), ("c", 3)]
    assert spark.range(1).select(X.canonical_set(F.array(*map(F.lit, (10, 9, 2, 10))))).first()[0] == [10, 2, 9]
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(X.get_item(F.array(F.lit(1)), F.lit(4))).collect()
    with pytest.raises(X.ExpressionError):
        X.compile_expression(["<", 1, "a"], df.schema)
    assert spark.range(1).select(X.compile_expression(["==", 1, "1"], df.schema)[0]).first()[0] is False


def test_ordered_codes(spark):
    codes = F.array(*map(F.lit, ("CAPABILITY.constraint_violation", "PROTOCOL.signature_invalid", "X.y", "KERNEL.b", "PROTOCOL.request_hash_mismatch", "KERNEL.b")))
    got = spark.range(1).select(R.ordered_codes(codes)).first()[0]
    assert got == ["KERNEL.b", "PROTOCOL.request_hash_mismatch", "PROTOCOL.signature_invalid", "CAPABILITY.constraint_violation", "X.y"]


def test_records(spark):
    df = spark.createDataFrame([("c1", "AD", "new", "k" * 32)], "a string, b string, c string, d string")
    lines = render_records(df, *map(F.col, "abcd")).select("value")
    broken = lines.select(F.concat(F.substring("value", 1, 147), F.lit("~")).alias("value"))
    got = parse_records(lines.union(broken).union(spark.createDataFrame([("short",)], "value string"))).collect()
    assert [(r.length_ok, r.checksum_ok) for r in got] == [(True, True), (True, False), (False, False)]
    assert (got[0].customer_id, got[0].new_value) == ("c1", "new")


def test_frames(spark, tmp_path):
    good = encode_frame(b"one") + encode_frame(b"two")
    d = FrameDecoder()
    assert [p for i in range(len(good)) for _, p in d.push(good[i : i + 1])] == [b"one", b"two"]
    d.end()
    for tail, error in ((b"\1\0", "FRAMING_TRUNCATED_HEADER"), (b"\5\0\0\0ab", "FRAMING_TRUNCATED_PAYLOAD"), (b"\0\0\0\0", "FRAMING_LENGTH_ZERO")):
        (tmp_path / "f.bin").write_bytes(good + tail)
        rows = read_frames(spark, str(tmp_path / "f.bin")).orderBy("frame").collect()
        assert [r.length for r in rows] == [3, 3, None] and rows[2].error == error


def test_outbox_stream(spark, tmp_path):
    from factloom.streaming.outbox import outbox_stream

    df = spark.createDataFrame([(f"c{i}", "AD", "v", f"{i:032d}") for i in range(3)], "a string, b string, c string, d string")
    lines = [r.value for r in render_records(df, *map(F.col, "abcd")).collect()]
    (tmp_path / "x.dat").write_text("\n".join(lines) + "\nbad\n")
    q = outbox_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("outbox").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("outbox").count() == 3


def test_outbox_keeps_every_record(spark, tmp_path):
    from factloom.streaming.outbox import outbox_rejects, outbox_stream

    df = spark.createDataFrame([(f"c{i}", "AD", "v", "k" * 32 if i < 3 else "") for i in range(6)], "a string, b string, c string, d string")
    lines = [r.value for r in render_records(df, *map(F.col, "abcd")).collect()]
    (tmp_path / "x.dat").write_text("\n".join([*lines, lines[0][:-1] + "~"]) + "\nbad\n")
    for name, stream in (("every_record", outbox_stream), ("no_record", outbox_rejects)):
        q = stream(spark, str(tmp_path)).writeStream.format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    got = spark.table("every_record").collect()
    assert sorted(r.customer_id for r in got) == ["c0", "c0", "c1", "c2", "c3", "c4", "c5"] and [r.customer_id for r in got if not r.checksum_ok] == ["c0"]
    assert [(r.value, r.path.endswith("x.dat")) for r in spark.table("no_record").collect()] == [("bad", True)]


def test_capability_cascade(spark):
    asks = [  # version, operations, config hash, most, all of these signers, any of these roots
        (1, 1, "v", ["op"], None, 5, [], []), (2, 1, "v", ["op"], "h2", 5, [], []), (3, 1, "v", ["no"], None, 5, [], []), (4, 1, "v", ["op"], "h", 9, [], []),
        (5, 1, "v", ["op"], "h", 5, ["k", "z"], []), (6, 1, "v", ["op"], "h", 5, ["k"], ["y"]), (7, 1, "v", ["op"], "h", 5, ["k"], ["y", "r"]),
        (8, 1, "v", ["op"], None, 9, [], []), (9, 1, "w", ["op"], None, 5, [], []), (10, 1, "w", ["op"], None, 5, [], []), (10, 2, "v", ["op"], "h", None, None, None),
    ]
    a = spark.createDataFrame(asks, "requirement_id int, alternative int, version string, operations array<string>, config_hash string, most int, signer_keys_all_of array<string>, cert_roots_any_of array<string>").withColumn("capability_id", F.lit("c"))
    other = spark.createDataFrame([(8, 2, "v", [], None, None, [], [], "absent"), (9, 2, "v", ["op"], None, 9, [], [], "c")], a.schema)
    e = spark.createDataFrame([("c", "v", "h", ["op", "more"], 7, ["k"], ["r"]), ("d", "v", "h2", ["no"], 99, ["z"], ["y"])], "capability_id string, version string, config_hash string, operations array<string>, most int, trusted_signer_keys array<string>, trusted_cert_roots array<string>")
    got = {r.requirement_id: (r.chosen, (r.code or "").removeprefix("CAPABILITY.")) for r in R.match_capabilities(a.union(other), e).collect()}
    trust = (None, "untrusted_or_missing_trust_anchor")
    assert got == {
        1: (1, ""), 2: (None, "incompatible_version"), 3: (None, "constraint_violation"), 4: (None, "constraint_violation"), 5: trust, 6: trust, 7: (1, ""),
        8: (None, "missing_required_capability"), 9: (None, "incompatible_version"), 10: (2, ""),
    }
    flags = R.match_capabilities(a.where("requirement_id = 1").withColumn("safe", F.lit(True)), e.withColumn("safe", F.lit(False)), {"safe": "flag"}).first()
    assert flags.code == "CAPABILITY.constraint_violation"
