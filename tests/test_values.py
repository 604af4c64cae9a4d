import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import values as V


@pytest.mark.parametrize(
    "text, canonical",
    [
        ("(b=1, a_x=2u)", "(a_x=2u, b=1)"),
        ("[10, 2, 9, 1e20, 1.0, -0.5]", "[10, 2, 9, 100000000000000000000.0, 1.0, -0.5]"),
        ("Set([10, 2, 9])", "Set([10, 2, 9])"),
        ("9223372036854775808", "9223372036854775808N"),
        ('Keyword("my_app/x")', 'Keyword("my_app/x")'),
        ("GeoPoint([1, 2])", "GeoPoint([1, 2])"),
        ('Tagged("a_b", nil)', 'Tagged("a_b", nil)'),
        ("Ref(:user_id, 3)", "Ref(:user_id, 3)"),
        ("# note\n['x, @?y, _, 0x[0aff], true, 1.5f]", "['x, @?y, '_, 0x[0aff], true, 1.5f]"),
        ('@meta(z = 1, a = 2)\n"about"\n(k="q\\$\\n")', '@meta(a = 2, z = 1)\n"about"\n(k="q\\$\\n")'),
    ],
)
def test_canonical_text_is_a_fixed_point(text, canonical):
    value = V.parse(text)
    assert V.to_text(value, canonical=True) == canonical
    assert V.to_text(V.parse(canonical), canonical=True) == canonical
    assert V.identity(V.decode(V.encode(value))) == V.identity(value)


@pytest.mark.parametrize("text", ["", "(a=1", "[1 2]", "let", '"a $x"', "f(1)", "1 2", "-1u", '"\\q"'])
def test_text_that_is_no_data(text):
    with pytest.raises(ValueError):
        V.parse(text)


def test_message_layout():
    message = V.encode(V.parse('["a", "a", 7]'))
    # root pointer, vector of three at 8, two indices of the one dictionary entry, the int on the next multiple of 8
    seg = struct.pack("<Q", 11 << 48 | 8) + struct.pack("<II3Q", 3, 0, 7 << 48 | 40, 7 << 48 | 44, 2 << 48 | 48) + struct.pack("<IIq", 0, 0, 7)
    names = struct.pack("<IBI", 1, 0, 1) + b"a"
    assert message == struct.pack("<4sHHQQQ", b"RULI", 1, 0, 32, 32 + len(seg), len(names)) + seg + names
    signed = V.encode(V.parse("nil"), digest=True)
    assert signed[-33:] == b"\x01" + hashlib.sha256(signed[:-33]).digest()
    with pytest.raises(V.ValueFormatError, match="digest"):
        V.decode(signed[:-1] + bytes([signed[-1] ^ 1]))
    for cut in range(len(message)):
        with pytest.raises(V.ValueFormatError):
            V.decode(message[:cut])


def test_canonical_order_repeats_and_facts():
    once, twice = V.parse("Set([2, 10, 2])"), V.parse("Set([10, 2])")
    assert V.encode(V.canonical(once)) == V.encode(V.canonical(twice))
    with pytest.raises(V.ValueFormatError, match="repeated"):
        V.encode(once)
    with pytest.raises(V.ValueFormatError, match="repeated"):
        V.encode(V.parse("(a=1, a=2)"))
    assert V.fact_digest(V.parse('@meta(by = "x")\n(a=1)')) == V.fact_digest(V.parse("(a=1)"))
    assert V.fact_digest(V.parse("(a=1)")) != V.fact_digest(V.parse("(a=1u)"))


SCALARS = st.one_of(
    st.just(V.NIL),
    st.tuples(st.just("bool"), st.booleans()),
    st.tuples(st.just("int"), st.integers(-(2**63), 2**63 - 1)),
    st.tuples(st.just("uint"), st.integers(0, 2**64 - 1)),
    st.tuples(st.just("bigint"), st.integers()),
    st.tuples(st.just("f64"), st.floats(allow_nan=False, allow_infinity=False)),
    st.tuples(st.just("string"), st.text(st.characters(exclude_categories=["Cs"]))),
    st.tuples(st.just("bytes"), st.binary()),
)
#: Keys of maps in text are keywords or strings only; a message holds any key.
TEXT_KEYS = st.one_of(st.tuples(st.just("keyword"), st.sampled_from(["nil", "a", "a/b", "x_y/z"])), st.tuples(st.just("string"), st.sampled_from(["", "a", "$\n"])))


def values(keys):
    return st.recursive(
        SCALARS,
        lambda v: st.one_of(
            st.tuples(st.just("vector"), st.lists(v, max_size=4)),
            st.tuples(st.just("map"), st.lists(st.tuples(keys if keys is not None else v, v), max_size=3, unique_by=lambda p: V.identity(p[0]))),
            st.tuples(st.just("tagged"), st.tuples(st.sampled_from(["a", "geo/point-set", "x_y"]), v)),
        ),
        max_leaves=8,
    )


@settings(max_examples=100, deadline=None)
@given(values(None))
def test_message_round_trips(value):
    value = V.canonical(value)
    assert V.identity(V.decode(V.encode(value, digest=True))) == V.identity(value)


@settings(max_examples=100, deadline=None)
@given(values(TEXT_KEYS))
def test_text_round_trips(value):
    text = V.to_text(value, canonical=True)
    assert V.to_text(V.parse(text), canonical=True) == text


def test_canonical_json():
    assert V.canonical_json('{"b": [1, null], "a": "é"}') == '{"a":"é","b":[1,null]}'
    for bad in ('{"a": 1, "a": 2}', '{"a": 1.5}', "NaN"):
        with pytest.raises(ValueError):
            V.canonical_json(bad)


def test_short_forms_of_tags():
    assert V.to_text(("tagged", ("geo/point-set", V.NIL))) == "GeoPointSet(nil)"
    assert V.to_text(("tagged", ("a/b", V.NIL))) == "AB(nil)" and V.parse("AB(nil)") == ("tagged", ("ab", V.NIL))  # no round trip


def test_json_contains(spark):
    texts = ['{"a": [1, {"b": true, "c": 2}], "d": null}', '{"a": [1, {"b": 1}]}', '{"a": [1]}', '{"a": [1.0, {"b": true}]}', "broken", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(V.json_contains_column(F.col("t"), {"a": [1, {"b": True}]})).collect()] == [True, False, False, False, None, None]
    df = spark.createDataFrame([("1u",), ("[1]",), ("(",), ("@meta(a = 1)\nnil",)], "t string")
    assert [r[0] for r in df.select(V.kind_column(F.col("t"))).collect()] == ["uint", "vector", None, "annotated"]


def test_columns(spark):
    df = spark.createDataFrame([("(b=1, a=2)",), ("broken(",), (None,)], "t string")
    rows = df.select(V.canonical_text(F.col("t")), V.decode_text(V.encode_canonical(F.col("t"), digest=True)), V.fact_digest_column(F.col("t")).isNull()).collect()
    assert [tuple(r) for r in rows] == [("(a=2, b=1)", "(a=2, b=1)", False), (None, None, True), (None, None, True)]
    assert df.limit(0).select(V.canonical_text(F.col("t"))).collect() == []
    with pytest.raises(Exception, match="no data"):
        df.select(V.canonical_text(F.col("t"), strict=True)).collect()
