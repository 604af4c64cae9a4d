"""Queries over nested values: schemas, typed columns, programs, accessors, messages, frames."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import access as A
from factloom.functions import language as L
from factloom.functions import values as V
from factloom.functions.blake3 import blake3
from factloom.functions.formatting import formatted_columns, lint
from factloom.functions.schema import Schema, of_struct, rows, texts, typed, variant
from factloom.query_registry import register, spread, table
from factloom.sources import records

PART = Schema.parse("""
(defs=(Part=SchemaStruct((id=:int, name=:string, kind=:keyword, price=:f64, stock=:uint, sizes=SchemaVector(:int), tags=SchemaSet(:string), by=SchemaMap((key=:string, value=:int)), state=:State)),
       State=SchemaTaggedUnion((cheap=SchemaStruct((price=:f64)), dear=:f64, sold=nil))),
 root=:Part)""")

_STATE = "CASE WHEN p_partkey % 5 = 0 THEN 'Sold(nil)' WHEN p_retailprice < 1000 THEN 'Cheap((price=' || CAST(p_retailprice AS {t}) || '))' ELSE 'Dear(' || CAST(p_retailprice AS {t}) || ')' END"


def _part_texts(spark, sf):
    """Parts as value texts; every seventh lacks its name, every eleventh has a float for its id."""
    text = """'(id=' || p_partkey || IF(p_partkey % 11 = 0, '.5', '') || IF(p_partkey % 7 = 0, '', ', name="' || p_name || '"') || ', kind=:' || lower(p_type) || ', price=' ||
      CAST(p_retailprice AS STRING) || ', stock=' || p_size || 'u, sizes=[' || p_size || ', nil, ' || (p_size + 1) || '], tags=Set(["' || p_brand || '"]), by=("' || p_brand || '"=' || p_size || '), state=' || """
    return spread(table(spark, sf, "part").select(F.col("p_partkey").alias("partkey"), F.expr(text + _STATE.format(t="STRING") + " || ')'").alias("text")))


_PART_COLUMNS = """
SELECT p_partkey AS partkey, CASE WHEN p_partkey % 11 <> 0 THEN p_partkey END AS id, CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 THEN p_name END AS name,
       CASE WHEN p_partkey % 11 <> 0 THEN lower(p_type) END AS kind, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size AS BIGINT) END AS stock, CASE WHEN p_partkey % 11 <> 0 THEN p_size + 1 END AS last_size,
       CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS tag, CASE WHEN p_partkey % 11 <> 0 THEN p_size END AS by_brand,
       CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'sold' WHEN p_retailprice < 1000 THEN 'cheap' ELSE 'dear' END AS state,
       CASE WHEN p_partkey % 11 = 0 OR p_partkey % 5 = 0 THEN NULL ELSE p_retailprice END AS price,
       CASE WHEN p_partkey % 11 = 0 THEN 'expected int, found f64' END AS error FROM part"""


def _flat(df):
    v = F.col("value")
    state = PART.column_type()["state"].dataType
    return df.select(
        "partkey", v["id"].alias("id"), v["name"].alias("name"), v["kind"].alias("kind"), v["stock"].cast("long").alias("stock"), v["sizes"][2].alias("last_size"), v["tags"][0].alias("tag"),
        F.map_values(v["by"])[0].alias("by_brand"), F.when(v.isNotNull(), variant(v["state"], state)).alias("state"), F.coalesce(v["state"]["cheap"]["price"], v["state"]["dear"]).alias("price"), "error",
    )


@register("schema_typed_columns", _PART_COLUMNS)
def schema_typed_columns(spark, sf):
    return _flat(typed(_part_texts(spark, sf), "text", PART))


@register("schema_messages_to_columns", _PART_COLUMNS)
def schema_messages_to_columns(spark, sf):
    messages = _part_texts(spark, sf).select("partkey", V.encode_canonical(F.col("text"), digest=True).alias("message"))
    return _flat(typed(messages, "message", PART))


@register("schema_validate_quarantine", """
SELECT coalesce(CASE WHEN p_partkey % 11 = 0 THEN 'expected int, found f64' WHEN p_partkey % 7 = 0 THEN 'missing field name' ELSE 'expected int, found nil' END, '') AS problem, count(*) AS n
FROM part GROUP BY 1""")
def schema_validate_quarantine(spark, sf):
    """Every text is validated, nil members of a vector of ints included; none is dropped."""
    return typed(_part_texts(spark, sf), "text", PART, validate=True).groupBy(F.coalesce("error", F.lit("")).alias("problem")).agg(F.count("*").alias("n"))


@register("schema_columns_to_text", """
SELECT c_custkey AS custkey, '(balance=' || CAST(c_acctbal AS VARCHAR) || ', key=' || c_custkey || ', names=["' || c_name || '", "' || c_mktsegment || '"], nation=(key=' || c_nationkey || '))' AS text FROM customer""")
def schema_columns_to_text(spark, sf):
    """Native rows as values: the schema follows from their struct type."""
    c = table(spark, sf, "customer")
    row = F.struct(F.col("c_custkey").alias("key"), F.array("c_name", "c_mktsegment").alias("names"), F.col("c_acctbal").alias("balance"), F.struct(F.col("c_nationkey").alias("key")).alias("nation"))
    df = spread(c.select(F.col("c_custkey").alias("custkey"), row.alias("row")))
    return texts(df, "row", of_struct(df.schema["row"].dataType))


@register("schema_columns_and_back", "SELECT p_partkey AS partkey, true AS same FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 7 <> 0")
def schema_columns_and_back(spark, sf):
    """Text to columns to a message to columns: nothing changes."""
    once = typed(_part_texts(spark, sf).where("partkey % 11 <> 0 AND partkey % 7 <> 0"), "text", PART, "a").drop("error")
    again = typed(texts(once.withColumn("b", F.col("a")), "b", PART, "m", message=True), "m", PART, "b")
    return again.select("partkey", (F.to_json("a") == F.to_json("b")).alias("same"))


@register("schema_rows_of_vector", """
SELECT n_regionkey AS regionkey, n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT DISTINCT n_regionkey, CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR) FROM nation""")
def schema_rows_of_vector(spark, sf):
    """A vector of maps, a nil among them, as rows."""
    member = F.format_string('(key=%d, name="%s")', "n_nationkey", "n_name")
    df = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("regionkey")).agg(F.concat(F.lit("[nil, "), F.concat_ws(", ", F.collect_list(member)), F.lit("]")).alias("text"))
    schema = Schema.parse("(defs=(N=SchemaStruct((key=:int, name=:string))), root=:N)")
    return rows(df, "text", schema).select("regionkey", F.col("value.key").alias("key"), F.col("value.name").alias("name"))


# ------------------------------------------------------------------------------------------------ programs


def _programs(spark, sf, *forms):
    """One program for each customer, in turns of the forms: %k, %n, %s are its key, name and segment."""
    at = F.element_at(F.array(*map(F.lit, forms)), (F.col("c_custkey") % len(forms) + 1).cast("int"))
    for sign, c in (("%k", "c_custkey"), ("%n", "c_name"), ("%s", "c_mktsegment")):
        at = F.replace(at, F.lit(sign), F.col(c).cast("string"))
    return spread(table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), at.alias("program")))


@register("program_let_functions", """
SELECT c_custkey AS custkey, CASE c_custkey % 6
  WHEN 0 THEN '"' || c_name || ': ' || c_custkey || '"' WHEN 1 THEN '[' || c_custkey || ', "' || c_mktsegment || '"]' WHEN 2 THEN '(double="' || c_custkey || c_custkey || '", own=' || c_custkey || ')'
  WHEN 3 THEN '(a=1, b=nil, c=' || c_custkey || ')' WHEN 4 THEN CAST(c_custkey AS VARCHAR) ELSE '"' || c_name || '/true/nil/' || c_custkey || '.5"' END AS value, CAST(NULL AS VARCHAR) AS error FROM customer""")
def program_let_functions(spark, sf):
    forms = (
        'let name = "%n" "$name: $(concat(%k))"', 'let (k, s) = [%k, "%s"] [k, s]', "let { n = %k; twice = fn(x) => concat(x, x) } (own=n, double=twice(n))",
        "merge((a=1, b=2), (b=nil), (c=%k))", "get([0, get((k=%k), :k)], -1)", 'concat("%n", "/", true, "/", nil, "/", %k.5)',
    )
    return L.evaluated(_programs(spark, sf, *forms), "program")


@register("program_errors", """
SELECT error, count(*) AS n FROM (SELECT CASE c_custkey % 6 WHEN 0 THEN 'unknown identifier missing' WHEN 1 THEN 'expected 1 arguments, received 2' WHEN 2 THEN 'a function is no data'
  WHEN 3 THEN 'index 3 out of bounds' WHEN 4 THEN 'no such key' ELSE 'imports need a resolver' END AS error FROM customer) GROUP BY 1""")
def program_errors(spark, sf):
    forms = ("[missing, %k]", "let f = fn(x) => x f(%k, 1)", "fn(x) => x", "get([%k], 3)", 'get((a=%k), "a")', 'import "%n"')
    return L.evaluated(_programs(spark, sf, *forms), "program").groupBy("error").agg(F.count("*").alias("n"))


@register("program_macros", """
SELECT c_custkey AS custkey, CASE c_custkey % 5 WHEN 0 THEN '(user_id=' || c_custkey || ', user_name="' || c_name || '")' WHEN 1 THEN '@meta(by = "' || c_name || '")' || chr(10) || c_custkey
  WHEN 2 THEN '[''>=, @?age, ' || c_custkey || ']' WHEN 3 THEN '[''max, @?x]' ELSE 'User((id=' || c_custkey || '))' END AS value FROM customer""")
def program_macros(spark, sf):
    """Namespaces, metadata, infix and symbol calls as vectors, constructors with entries."""
    forms = ('@ns user begin (id = %k, name = "%n") end', '@meta(by = "%n") %k', "(@?age >= %k)", "('max @?x)", "User(id = %k)")
    return L.evaluated(_programs(spark, sf, *forms), "program").select("custkey", "value")


@register("program_imports", """
SELECT c_custkey AS custkey, CASE c_custkey % 4 WHEN 0 THEN '(limit=5, own=' || c_custkey || ')' WHEN 1 THEN '[3, ' || c_custkey || ']' END AS value,
       CASE c_custkey % 4 WHEN 2 THEN 'b has another sha256 digest' WHEN 3 THEN 'loop/x imports itself' END AS error FROM customer""")
def program_imports(spark, sf):
    """Imports of checked content, relative ones, a wrong digest and a cycle."""
    contents = {"a": "(limit=5)", "b": "3", "lib/c": 'import "../b"', "loop/x": 'import "x"'}
    digest = hashlib.sha256(contents["a"].encode()).hexdigest()
    forms = (f'merge(import "a" sha256:{digest}, (own=%k))', '[import "lib/c", %k]', f'[import "b" sha256:{digest}, %k]', 'import "loop/x"')
    return L.evaluated(_programs(spark, sf, *forms), "program", options=L.Options(L.in_memory(contents)))


@register("program_new_seeded", """
SELECT CASE c_custkey % 3 WHEN 0 THEN 'uuid' WHEN 1 THEN 'ulid' ELSE 'now' END AS kind, count(*) AS n, count(*) AS well_formed, true AS repeatable FROM customer GROUP BY 1""")
def program_new_seeded(spark, sf):
    """Generated identifiers follow from the row's text, so a re-run task makes the same."""
    forms = ("let who = %k @new(:uuid)", "let who = %k @new(:ulid)", "let who = %k @new(:now)")
    first, second = (L.evaluated(_programs(spark, sf, *forms), "program", seeded=True) for _ in range(2))
    kind = F.when(F.col("value").startswith("Uuid(0x["), "uuid").when(F.col("value").startswith("Ulid("), "ulid").when(F.col("value") == "Inst(0)", "now")
    fine = F.col("value").rlike(r'^(Uuid\(0x\[[0-9a-f]{12}4[0-9a-f]{3}[89ab][0-9a-f]{15}\]\)|Ulid\("[0-9A-HJKMNP-TV-Z]{26}"\)|Inst\(0\))$')
    both = first.join(second.select("custkey", F.col("value").alias("again")), "custkey")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(fine).alias("well_formed"), F.bool_and(F.col("value") == F.col("again")).alias("repeatable"))


@register("constructor_checks", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN event_id % 4 < 2 WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN false ELSE true END AS accepted FROM events WHERE event_id < 3000""")
def constructor_checks(spark, sf):
    """Scalars with a form of their own: a ULID of 26 letters, an instant on a day that exists, a UUID of 16 bytes."""
    e = table(spark, sf, "events").where("event_id < 3000")
    text = F.expr(r"""CASE event_id % 6 WHEN 0 THEN 'ULID("01ARZ3NDEKTSV4RRFFQ69' || lpad(upper(hex(event_id)), 5, '0') || '")'
      WHEN 1 THEN 'Instant("2024-0' || IF(event_id % 4 < 2, '1', '2') || '-30T00:00:0' || (event_id % 10) || 'Z")' WHEN 2 THEN 'UUID("550e8400-e29b-41d4-a716-' || lpad(event_id, 12, '0') || '")'
      WHEN 3 THEN 'UUID("550e8400-' || event_id || '")' WHEN 4 THEN 'Instant("2024-01-01T00:00:00.' || event_id || '0Z")' ELSE 'Generator(:uuid)' END""")
    return L.evaluated(spread(e.select("event_id", text.alias("program"))), "program").select("event_id", F.col("error").isNull().alias("accepted"))


@register("program_layout", """
SELECT c_custkey AS custkey, CASE c_custkey % 5 WHEN 0 THEN 'let {b=' || c_custkey || '; a=1} concat(a, b)' WHEN 1 THEN '(a=[1, ' || c_custkey || '], b="' || c_name || '")' WHEN 2 THEN 'let f=fn(x) => [x, x] f(' || c_custkey || ')'
  WHEN 3 THEN '(new=@new(:uuid), own=' || c_custkey || ')' END AS formatted, CASE c_custkey % 5 WHEN 0 THEN 5 WHEN 1 THEN 1 WHEN 2 THEN 5 END AS differs_at, c_custkey % 5 = 4 AS refused FROM customer""")
def program_layout(spark, sf):
    """Programs in canonical layout, unevaluated; where the given text departs from it."""
    forms = ("let { b = %k, a=1 } concat(a,b)", '(b="%n", a=[1,%k])', "let f = fn(x)=>[x,x] f(%k)", "(new=@new(:uuid), own=%k)", "(a=1, a=%k)")
    return formatted_columns(_programs(spark, sf, *forms), "program").select("custkey", "formatted", "differs_at", F.col("error").isNotNull().alias("refused"))


@register("value_lints", """
SELECT c_custkey AS custkey, CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'EXPR_INVALID_ARITY' WHEN 2 THEN 'EXPR_INVALID_OP' WHEN 3 THEN 'EXPR_FORBIDDEN_TYPE' WHEN 4 THEN 'PATH_INVALID_SHAPE'
  WHEN 5 THEN 'PATH_INVALID_SEGMENT' ELSE 'ENVELOPE_KEY_SHOULD_BE_STRING,ENVELOPE_KEY_SHOULD_BE_STRING' END AS codes FROM customer""")
def value_lints(spark, sf):
    forms = ('[Expr([\'<, "a", %k]), Path([:a, 0, "b"]), ("kind"="x", "payload"=%k)]', "Expr(['not, true, %k])", "[Expr(['plus, 1, %k])]", "Expr(['<, 0x[00], %k])", "Path([])", "Path([:a, -%k1])", '(kind="x", payload=%k)')
    return A.value_columns(_programs(spark, sf, *forms), "program", {"codes": (lambda v: ",".join(lint(v)), T.StringType())})


# ------------------------------------------------------------------------------------------------ accessors


@register("value_accessors", """
SELECT c_custkey AS custkey, 3 AS entries, 'id,name,tags' AS names, c_name AS name, 2 AS tags, c_mktsegment AS last_tag, 'acme/user' AS tag, CAST(c_custkey AS BIGINT) AS id, 'map' AS kind, c_name AS by, c_custkey % 3 = 0 AS generated,
       'acme/user-account' AS pascal, 'ns/some_key' AS sugar FROM customer""")
def value_accessors(spark, sf):
    c = table(spark, sf, "customer")
    text = F.expr("""'@meta(by="' || c_name || '") AcmeUser((id=' || c_custkey || ', name="' || c_name || '", tags=["x", ' || IF(c_custkey % 3 = 0, 'Generator(:uuid)', '"' || c_mktsegment || '"') || ', "' || c_mktsegment || '"]))'""")
    own = lambda f: lambda v: f(A.payload(A.inner(v)))
    texts_ = lambda ks: ",".join(k[1] for k in ks)
    return A.value_columns(spread(c.select(F.col("c_custkey").alias("custkey"), text.alias("value"))), "value", {
        "entries": (own(A.length), T.IntegerType()), "names": (own(lambda v: texts_(A.keys(v))), T.StringType()), "name": (own(lambda v: A.scalar(A.field(v, "name"), "string")), T.StringType()),
        "tags": (own(lambda v: A.length(A.field(v, "tags")) - 1), T.IntegerType()), "last_tag": (own(lambda v: A.scalar(A.item(A.field(v, "tags"), -1), "string")), T.StringType()),
        "tag": (lambda v: A.tag(A.inner(v)), T.StringType()), "id": (own(lambda v: A.entry(v, 0)[1][1]), T.LongType()), "kind": (lambda v: A.payload(A.inner(v))[0], T.StringType()),
        "by": (lambda v: A.scalar(A.at_path(A.metadata(v), "by"), "string"), T.StringType()), "generated": (L.contains_generator, T.BooleanType()),
        "pascal": (lambda v: V._tag_of("AcmeUserAccount"), T.StringType()), "sugar": (lambda v: V.parse(":ns_some_key")[1], T.StringType()),
    })


@register("message_lazy_fields", """
SELECT p_partkey AS partkey, CASE WHEN p_partkey % 11 <> 0 THEN p_partkey END AS id, p_size AS size, p_retailprice AS price, p_brand AS brand, CAST(NULL AS VARCHAR) AS absent FROM part""")
def message_lazy_fields(spark, sf):
    """Fields of binary messages without decoding the rest; a field of another kind is null."""
    messages = _part_texts(spark, sf).select("partkey", V.encode_canonical(F.col("text")).alias("message"))
    return A.message_fields(messages, "message", {
        "id": ("id", T.LongType()), "size": ("sizes.0", T.IntegerType()), "price": ("price", T.DoubleType()), "brand": ("tags.0", T.StringType()), "absent": ("none.of.it", T.StringType()),
    })


@register("value_json", """
SELECT event_id, '("id"=' || event_id || ', "props"=("k"=' || json_extract_string(props, '$.k') || '), "tags"=["' || event_type || '", nil, 2.5])' AS text,
       '{"id":' || event_id || ',"props":{"k":' || json_extract_string(props, '$.k') || '},"tags":["' || event_type || '",null,2.5]}' AS back FROM events""")
def value_json(spark, sf):
    """JSON to value text and back."""
    e = table(spark, sf, "events")
    json_text = F.expr("""'{"id": ' || event_id || ', "props": ' || props || ', "tags": ["' || event_type || '", null, 2.50]}'""")

    @F.pandas_udf("struct<text string, back string>")
    def both(s: pd.Series) -> pd.DataFrame:
        values = [A.from_json(x) for x in s]
        return pd.DataFrame({"text": [V.to_text(v) for v in values], "back": [A.to_json(v) for v in values]})

    return spread(e.select("event_id", json_text.alias("j"))).select("event_id", both("j").alias("b")).select("event_id", "b.*")


# ------------------------------------------------------------------------------------------------ digests, messages, frames


@register("fact_and_object_digests", "SELECT c_custkey AS custkey, true AS fact_same, false AS object_same, true AS replays, c_custkey % 2 = 1 AS as_is FROM customer")
def fact_and_object_digests(spark, sf):
    """Annotations change the object digest and not the fact's; messages replay; as-is encoding refuses repeated members."""
    @F.pandas_udf("struct<fact_same boolean, object_same boolean, replays boolean, as_is boolean>")
    def check(plain: pd.Series, annotated: pd.Series, members: pd.Series) -> pd.DataFrame:
        out = []
        for p, a, m in zip(plain, annotated, members, strict=True):
            p, a = V.parse(p), V.parse(a)
            digest = lambda v: hashlib.sha256(V.encode(V.canonical(v))).hexdigest()
            message = V.encode(V.canonical(a), digest=True)
            try:
                V.encode(V.parse(m))
                fine = True
            except V.ValueFormatError:
                fine = False
            out.append((V.fact_digest(p) == V.fact_digest(a), digest(p) == digest(a), V.encode(V.canonical(V.decode(message)), digest=True) == message, fine))
        return pd.DataFrame(out, columns=["fact_same", "object_same", "replays", "as_is"])

    c = table(spark, sf, "customer")
    plain = F.format_string('(id=%d, name="%s")', "c_custkey", "c_name")
    df = c.select(F.col("c_custkey").alias("custkey"), plain.alias("p"), F.concat(F.lit('@meta(by="x") '), plain).alias("a"))
    as_is = F.format_string("Set([%d, 1])", F.col("custkey") % 2 + 1)
    return spread(df.withColumn("m", as_is)).select("custkey", check("p", "a", "m").alias("r")).select("custkey", "r.*")


@register("blake3_digest", """
SELECT n_nationkey AS nationkey, CASE n_nationkey % 2 WHEN 0 THEN 'af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262' ELSE '6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85' END AS digest FROM nation""")
def blake3_digest(spark, sf):
    """The specification's digests of no bytes and of ``abc``."""
    @F.pandas_udf("string")
    def digest(s: pd.Series) -> pd.Series:
        return s.map(lambda x: blake3(x.encode()).hex())

    n = table(spark, sf, "nation")
    return n.select(F.col("n_nationkey").alias("nationkey"), digest(F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("abc")).alias("digest"))


@register("frame_summary", """
SELECT c_custkey AS custkey, k AS frame, strlen(CASE k WHEN 1 THEN c_name ELSE c_mktsegment END) AS length, sha256(CASE k WHEN 1 THEN c_name ELSE c_mktsegment END) AS sha256, CAST(NULL AS VARCHAR) AS error
FROM customer CROSS JOIN (VALUES (1), (2)) t(k) WHERE NOT (k = 2 AND c_custkey % 9 = 0)
UNION ALL SELECT c_custkey, 2, NULL, NULL, 'FRAMING_TRUNCATED_PAYLOAD' FROM customer WHERE c_custkey % 9 = 0""")
def frame_summary(spark, sf):
    """Two frames for each customer, cut off for some, decoded with ordinals, lengths and digests."""
    c = table(spark, sf, "customer")
    stream = F.concat(records.frame(F.col("c_name").cast("binary")), records.frame(F.col("c_mktsegment").cast("binary")))
    cut = F.when(F.col("c_custkey") % 9 == 0, F.substring(stream, F.lit(1), F.length(stream) - 1)).otherwise(stream)
    return records.decode_frames(c.select(F.col("c_custkey").alias("custkey"), cut.alias("content")), "content")
