import hashlib

import pytest

from factloom.functions import access as A
from factloom.functions import language as L
from factloom.functions import values as V
from factloom.functions.blake3 import blake3
from factloom.functions.schema import Schema, SchemaError, of_struct, rows, texts, typed


@pytest.mark.parametrize(("program", "text"), [
    ("let x = 5 [x, x]", "[5, 5]"), ('let { a = 1; b = 2 } concat(a, "-", b)', '"1-2"'), ("let f = fn(x) => (v=x) f(3)", "(v=3)"), ("let (a, b) = [1, 2] [b, a]", "[2, 1]"),
    ("let [a, b] = [1, 2] [b, a]", "[2, 1]"), ("let x = 1 let f = fn() => x let x = 2 f()", "1"), ("let add = fn(x) => fn(y) => [x, y] let g = add(1) g(2)", "[1, 2]"),
    ('let n = "a" "$n $(concat(n, "b")) $ \\$n"', '"a ab $ $n"'), ("@ns user begin (id = 1, :x_y = 2) end", "(user_id=1, x_y=2)"), ("@meta(by = \"x\") 3", '@meta(by = "x")\n3'),
    ("(@?age >= 18)", "['>=, @?age, 18]"), ("('f 1, 2)", "['f, 1, 2]"), ("count", "'count"), ("Set([])", "Set([])"), ("Set()", "Set([])"), ("User()", "User(())"), ("get((a=1), :a)", "1"),
    ("merge((a=1, b=2), (b=nil))", "(a=1, b=nil)"), ("concat(1, 2u, 1.5, 2.5f, nil, true, [1])", '"121.52.5niltrue[1]"'), ('"""\na\nb\n"""', '"a\\nb"'),
])
def test_programs(program, text):
    assert V.to_text(L.evaluate(program)) == text


@pytest.mark.parametrize("program", ["missing", "fn(x) => x", "let f = fn(x) => x f()", "get([1], 1)", "get([1], -2)", 'get((a=1), "a")', "merge()", "merge([1])", "(1 2)", 'import "x"', "@new(:uuid)", "1 2", "[1 2]",
                                     'ULID("x")', 'Instant("2023-02-29T00:00:00Z")', 'UUID("12")', "Generator(1)", "(a=1, a=2)", '"$(1"', '"\\q"', "@ns a begin 1"])
def test_refused_programs(program):
    with pytest.raises(V.ValueFormatError):
        L.evaluate(program)


def test_imports(tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "a").write_text('import "../b"')
    (tmp_path / "b").write_text("(n=3)")
    o = L.Options(L.in_folder(str(tmp_path)))
    assert L.evaluate('[import "lib/a", import "b"]', o) == ("vector", [V.parse("(n=3)")] * 2)
    assert L.evaluate(f'import "b" sha256:{hashlib.sha256(b"(n=3)").hexdigest()}', o) == L.evaluate(f'import "b" blake3:{blake3(b"(n=3)").hex()}', o)
    for bad in ('import "b" sha256:' + "0" * 64, 'import "../outside"', 'import "none"'):
        with pytest.raises(L.EvaluationError):
            L.evaluate(bad, o)
    with pytest.raises(L.EvaluationError, match="imports itself"):
        L.evaluate('import "x"', L.Options(L.in_memory({"x": 'import "y"', "y": 'import "x"'})))


def test_new_follows_from_its_seed():
    one, two = (L.evaluate("[@new(:uuid), @new(:ulid), @new(:now)]", L.Options(new=L.SeededNew(b"s", 1_700_000_000_000))) for _ in range(2))
    assert one == two and L.ULID.fullmatch(one[1][1][1][1][1]) and one[1][2] == ("tagged", ("inst", ("int", 1_700_000_000_000)))
    assert L.contains_generator(V.parse("[(a=Generator(:uuid))]")) and not L.contains_generator(V.parse("[1]"))


def test_blake3_vectors():
    data = bytes(i % 251 for i in range(2049))
    assert blake3(b"").hex().startswith("af1349b9f5f9a1a6") and blake3(b"abc").hex().startswith("6437b3ac38465133") and blake3(data).hex().startswith("5f4d72f40d7a5f82")


SHAPES = '(defs=(Point=SchemaStruct((x=:f64, y=:float64)), Shape=SchemaTaggedUnion((circle=SchemaStruct((radius=:f64)), rect=:Point, none=nil)), Loop=SchemaStruct((next=:Loop))), root=%s)'


def test_schema_validation():
    s = Schema.parse(SHAPES % ":Shape")
    for good in ("Circle((radius=2.0))", "Circle((radius=2.0, more=1))", "Rect((y=1.0, x=0.5))", "None(nil)"):
        s.validate(V.parse(good))
    for bad in ("Rect((x=2.0))", "Circle((radius=2))", "Square(1)", "None(1)", "(radius=1.0)"):
        with pytest.raises(SchemaError):
            s.validate(V.parse(bad))
    with pytest.raises(SchemaError, match="contains itself"):
        Schema.parse(SHAPES % ":Loop").column_type()
    with pytest.raises(SchemaError, match="contains itself"):
        Schema.parse(SHAPES % ":Loop").validate(V.parse("(next=(next=nil))"))
    Schema.parse("(defs=(), root=SchemaStruct((a=:int)))").validate(V.parse("(ns_a=1)"), by_name=True)
    for bad in ("(root=:int)", "(defs=(), more=1)", "(defs=(A=:int))", "(defs=(), root=SchemaOther(1))"):
        with pytest.raises(SchemaError):
            Schema.parse(bad)
    with pytest.raises(SchemaError, match="no root"):
        Schema.parse("(defs=())").validate(V.NIL)


def test_typed_columns(spark):
    s = Schema.parse("""(defs=(E=SchemaTaggedUnion((:event_made=:string, :event_gone=nil))),
      root=SchemaStruct((name=:string, age=:uint, at=SchemaStruct((street=:string)), tags=SchemaSet(:keyword), sizes=SchemaMap((key=:string, value=:int)), raw=:bytes, e=:E)))""")
    texts_ = ['(name="a", age=3u, at=(street="x"), tags=Set([:k_v]), sizes=("l"=5), raw=0x[0aff], e=Tagged("event/made", "q"))', "(name=nil, e=Tagged(\"event/gone\", nil))", "(age=3)", "(", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts_)], "id int, text string")
    got = {r.id: r for r in typed(df, "text", s).collect()}
    v = got[0].value
    assert (v.name, int(v.age), v.at.street, v.tags, v.sizes, bytes(v.raw), v.e["event/made"], v.e["event/gone"]) == ("a", 3, "x", ["k/v"], {"l": 5}, b"\x0a\xff", "q", None)
    assert got[1].value.name is None and got[1].value.e["event/gone"] is True and got[1].error is None
    assert got[2].value is None and got[2].error == "expected uint, found int" and got[3].error and got[4].value is None and got[4].error is None
    back = {r.id: r.text for r in texts(typed(df, "text", s).drop("error"), "value", s).collect()}
    assert back[0] == V.to_text(V.parse(texts_[0]), canonical=True) and back[4] is None
    assert typed(df.limit(0), "text", s).count() == 0
    assert [r.value for r in rows(spark.createDataFrame([("[(a=1), nil]",)], "text string"), "text", Schema.parse("(defs=(), root=SchemaStruct((a=:int)))")).collect()][1] is None
    with pytest.raises(SchemaError):
        of_struct(spark.sql("SELECT current_timestamp() AS t").schema)


def test_access():
    v = V.parse('(a=[1, 2.5, "x"], b=User((id=7u)), "c d"=Set([3]))')
    m = A.Message(V.encode(V.canonical(v), digest=True), verify=True)
    assert [m.get(p) for p in ("a.0", "a.1", "a.-1", "b.id", "c d.0", "a.9", "z", "a")] == [1, 2.5, "x", 7, 3, None, None, None]
    with pytest.raises(V.ValueFormatError):
        A.Message(b"RULI")
    assert A.from_json('{"a": [1, 18446744073709551615, 1e3, null, {"b": true}]}')[1][0][1][1][:3] == [("int", 1), ("uint", 2**64 - 1), ("f64", 1000.0)]
    for bad in ('{"a": 1, "a": 2}', "[NaN]", "{"):
        with pytest.raises(ValueError):
            A.from_json(bad)
    with pytest.raises(V.ValueFormatError):
        A.to_json(V.parse("[1N]"))
    assert A.to_json(V.parse("[1u, :a]"), typed=True) == '{"vector":[{"uint":"1"},{"keyword":"a"}]}' and A.at_path(v, "b.id") == ("uint", 7)


@pytest.mark.parametrize("seed", range(4))
def test_shapes_read_as_the_reader_does(seed):
    import random

    r = random.Random(seed)

    def make(depth=0):
        k = r.randrange(11 if depth < 3 else 6)
        leaves = ["5", '"a"', '"b\\n\\"x"', '"$x"', "1.50", "7u", "8N", "99999999999999999999", "nil", ":ns_kw", "'sym", "0x[0a]", 'Keyword("a/b")', "Ref(:a, 2)", "User(id = 1)", "-0", "x1", "# c\n 4", '"d"\n5']
        if k < 6:
            return r.choice(leaves)
        inner = [make(depth + 1) for _ in range(r.randrange(4))]
        return f"[{', '.join(inner)}]" if k < 8 else f"Set([{', '.join(inner)}])" if k < 9 else "(" + ", ".join(f"{r.choice(['a', 'b', ':k', chr(34) + 's' + chr(34)])}={x}" for x in inner) + ")"

    def tried(f, x):
        try:
            return repr(f(x))
        except ValueError:
            return "refused"

    for _ in range(400):
        x = make()
        assert tried(V.parse, x) == tried(V.read, x)
        assert tried(V.canonical_of, x) == tried(lambda t: V.canonical(V.read(t)), x)
        assert tried(V.canonical_text_of, x) == tried(lambda t: V.to_text(V.read(t), True), x)


def test_layout_and_lints():
    from factloom.functions.formatting import first_difference, formatted, lint

    assert formatted('@meta(v = 1, a = "o")\n"""\nx\ny\n"""\nReport([1,2])') == '@meta(a = "o", v = 1)\n"""\nx\ny\n"""\nReport([1, 2])'
    for text in ("let {b=2; a=1} concat(a, b)", "let f=fn(x, y) => [x, y] f(1, 2)", "@ns u begin (a=2, b=1) end", "(@?a >= 1)", '"a $x $(b)"', "let (a, b)=[1, 2] a", "(gen=Generator(:uuid), new=@new(:uuid))"):
        assert formatted(text) == text
    assert first_difference("abc", "abc") is None and first_difference("ab", "abc") == 2 and first_difference("axc", "abc") == 1
    assert lint(V.parse("[Expr(['and, true]), Path([1.5])]")) == ["EXPR_INVALID_ARITY", "PATH_INVALID_SEGMENT"]


def test_ed25519_vectors():
    from factloom.functions import ed25519

    key, signature = ed25519.sign(bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60"), b"")  # RFC 8032, test 1
    assert key.hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a" and signature.hex().startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e06522490155")
    assert ed25519.verify(key, b"", signature) and not ed25519.verify(key, b"x", signature) and not ed25519.verify(key, b"", signature[:-1]) and not ed25519.verify(b"\1" + b"\0" * 31, b"", signature)
