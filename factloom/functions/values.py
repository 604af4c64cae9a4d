"""Nested values: literal text, canonical text, binary messages and digests, as Arrow-batched columns.

A value is a pair ``(kind, body)``. Bodies: None, bool, int, float, str, bytes; names are ``ns/name`` text; vectors and
sets are lists, maps are lists of pairs, a tagged value is ``(tag, value)``, an annotated one ``(pairs, value)``.
Text is data only here: ``let``, functions and imports are read by ``factloom.functions.language``. Columns give null for
null or malformed input; ``strict=True`` raises instead. Texts that differ in their literals only share a shape, which is
read once: its key order and what doesn't change are worked out for all of them.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the message format.
KINDS = ("nil", "bool", "int", "uint", "bigint", "f32", "f64", "string", "bytes", "symbol", "keyword", "vector", "set", "map", "tagged", "annotated")
MAGIC, VERSION, HEADER, DIGEST_FLAG, SHA256_ID = b"RULI", 1, 32, 1, 1
ENTRY_KINDS = {"string": 0, "symbol": 1, "keyword": 2}

CODE = {k: i for i, k in enumerate(KINDS)}
NIL = ("nil", None)
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "\\": "\\", '"': '"', "$": "$"}


class ValueFormatError(ValueError):
    pass


# ------------------------------------------------------------------------------------------------ text


_PLAIN = re.compile(r"[^\n\r\t\\\"$]*")


def _quoted(s: str, canonical: bool) -> str:
    if _PLAIN.fullmatch(s):
        return f'"{s}"'
    back = {v: "\\" + k for k, v in ESCAPES.items() if canonical or k != "$"}
    return '"' + "".join(back.get(c, c) for c in s) + '"'


def _decimal(kind: str, v: float) -> str:
    if np.isnan(v):
        return "NaN"
    if np.isinf(v):
        return "inf" if v > 0 else "-inf"
    return np.format_float_positional(np.float32(v) if kind == "f32" else np.float64(v), trim="-")


def _keyword(name: str, sigil: str) -> str:
    ns, slash, rest = name.partition("/")
    return f'Keyword("{name}")' if slash and "_" in ns else sigil + name.replace("/", "_", 1)


def _constructor(tag: str) -> str | None:
    """The short form of a tag; None if it has to be spelled out. Parts of one letter don't read back: ``a/b`` gives ``AB``, read as ``ab``."""
    plain = re.fullmatch(r"[a-z0-9]*|[a-z0-9]*/[a-z0-9-]*", tag)
    return "".join(p[:1].upper() + p[1:] for p in re.split("[/-]", tag)) if plain else None


def to_text(value, canonical: bool = False) -> str:
    """Display text, or canonical text: members and keys in the order of their own text, ``.0`` on whole doubles."""
    kind, body = value
    if kind == "string":
        return _quoted(body, canonical)
    if kind == "int":
        return str(body)
    text = lambda v: to_text(v, canonical)
    key = lambda k: _keyword(k[1], "") if k[0] == "keyword" else text(k)
    order = (lambda xs, of: sorted(xs, key=lambda x: text(of(x)).encode())) if canonical else (lambda xs, of: xs)
    if kind == "nil":
        return "nil"
    if kind == "bool":
        return "true" if body else "false"
    if kind in ("int", "uint", "bigint"):
        return f"{body}{dict(int='', uint='u', bigint='N')[kind]}"
    if kind == "f32":
        return _decimal(kind, body) + "f"
    if kind == "f64":
        out = _decimal(kind, body)
        return out + ".0" if canonical and "." not in out else out
    if kind == "bytes":
        return f"0x[{body.hex()}]"
    if kind == "symbol":
        return ("@" if body.rpartition("/")[2].startswith("?") else "'") + body
    if kind == "keyword":
        return _keyword(body, ":")
    if kind == "vector":
        return f"[{', '.join(map(text, body))}]"
    if kind == "set":
        members = list(map(text, body))
        return f"Set([{', '.join(sorted(members, key=str.encode) if canonical else members)}])"
    if kind == "map":
        return f"({', '.join(f'{key(k)}={text(v)}' for k, v in order(body, lambda p: p[0]))})"
    if kind == "tagged":
        tag, inner = body
        if tag == "ref":
            return f"Ref({', '.join(map(text, inner[1])) if inner[0] == 'vector' else text(inner)})"
        name = _constructor(tag)
        return f"{name}({text(inner)})" if name else f'Tagged("{tag}", {text(inner)})'
    pairs, inner = body
    doc = [v[1] for k, v in pairs if k == ("keyword", "doc") and v[0] == "string"]
    rest = order([p for p in pairs if p[0] != ("keyword", "doc") or (canonical and p[1][0] != "string")], lambda p: p[0])
    out = f"@meta({', '.join(f'{key(k)} = {text(v)}' for k, v in rest)})\n" if rest else ""
    if doc:
        d = doc[-1]
        out += ('"""\n' + d + ("" if d.endswith("\n") else "\n") + '"""\n') if "\n" in d else _quoted(d, canonical) + "\n"
    return out + text(inner)


_TOKEN = re.compile(
    r'(?P<block>"""\n?(?:.|\n)*?""")|(?P<text>"(?:[^"\\]|\\.)*")|(?P<bytes>0x\[[0-9a-fA-F\s]*\])|(?P<var>@\?[^\s,()\[\]=]*)|(?P<meta>@meta\b)'
    r"|(?P<number>[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?[Nuf]?(?![\w]))|(?P<symbol>'[^\s,()\[\]=]+)|(?P<keyword>:[A-Za-z_*+!<>/-][\w*+!?<>/-]*)"
    r"|(?P<word>[A-Za-z_*+!<>/-][\w*+!?<>/-]*)|(?P<mark>[()\[\],=])",
    re.S,
)

_SPACE = re.compile(r"(?:[ \n\r\t]|#[^\n]*)*")  # comments run from # to the end of the line


def _name_of(identifier: str) -> str:
    return identifier.replace("_", "/", 1)


def _tag_of(name: str) -> str:
    if re.fullmatch(r"[A-Z0-9]+", name):
        return name.lower()
    first, *rest = [p.lower() for p in re.split(r"(?<=[a-z])(?=[A-Z])", name)]
    return f"{first}/{'-'.join(rest)}" if rest else first


class _Reader:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while True:
            at = _SPACE.match(text, at).end()
            if at == len(text):
                break
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueFormatError(f"unexpected {text[at]!r} at {at}")
            self.tokens.append((m.lastgroup, m.group(), text[m.end() : m.end() + 1]))
            at = m.end()
        self.at = 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "", "")

    def take(self, mark: str | None = None):
        t = self.peek()
        if t[0] == "end" or (mark is not None and t[:2] != ("mark", mark)):
            raise ValueFormatError(f"expected {mark or 'a value'}, found {t[1] or 'the end'}")
        self.at += 1
        return t

    def items(self, close: str, one):
        out = []
        while self.peek()[:2] != ("mark", close):
            out.append(one())
            if self.peek()[:2] == ("mark", ","):
                self.at += 1
            elif self.peek()[:2] != ("mark", close):
                raise ValueFormatError(f"expected , or {close}")
        self.at += 1
        return out

    def entry_follows(self) -> bool:
        """Whether the parenthesis ahead begins with a key and its sign, as in ``User(id = 1)``."""
        ahead = self.tokens[self.at + 1 : self.at + 3]
        return len(ahead) == 2 and ahead[0][0] in ("word", "keyword", "text") and ahead[1][1] == "="

    def pair(self):
        ahead = self.tokens[self.at + 1 : self.at + 2]
        if self.peek()[0] == "word" and ahead and ahead[0][1] == "=":
            key = ("keyword", _name_of(self.take()[1]))
        else:
            key = self.value()
        if key[0] not in ("keyword", "string"):
            raise ValueFormatError("keys in text are identifiers, keywords or strings")
        self.take("=")
        return key, self.value()

    def value(self):
        group, text, after = self.take()
        if group in ("text", "block"):
            s = text[3:-3].removeprefix("\n") if group == "block" else _unescape(text[1:-1])
            if after == "\n" and self.peek()[0] != "end" and (self.peek()[0] != "mark" or self.peek()[1] in "(["):
                return _annotate([(("keyword", "doc"), ("string", s))], self.value())
            return "string", s
        if group == "bytes":
            return "bytes", bytes.fromhex(text[3:-1])
        if group == "number":
            return _number(text)
        if group == "keyword":
            return "keyword", _name_of(text[1:])
        if group in ("var", "symbol"):
            return "symbol", text[1:]
        if group == "meta":
            self.take("(")
            pairs = self.items(")", self.pair)
            return _annotate(pairs, self.value())
        if text == "[":
            return "vector", self.items("]", self.value)
        if text == "(":
            pairs = self.items(")", self.pair)
            if len({identity(k) for k, _ in pairs}) < len(pairs):
                raise ValueFormatError("repeated map key")
            return "map", pairs
        if group == "word":
            if text[0].isupper() and self.peek()[1] == "(" and self.entry_follows():
                self.at += 1
                return "tagged", (_tag_of(text), ("map", self.items(")", self.pair)))
            if text in ("nil", "true", "false"):
                return NIL if text == "nil" else ("bool", text == "true")
            if text == "_":
                return "symbol", "_"
            if text[0].isupper() and self.peek()[1] == "(":
                self.at += 1
                return _construct(text, self.items(")", self.value))
        raise ValueFormatError(f"{text} is no data")


def _annotate(pairs, value):
    """Decorators in front of one value share one list of metadata."""
    return ("annotated", (pairs + value[1][0], value[1][1])) if value[0] == "annotated" else ("annotated", (pairs, value))


def _unescape(s: str) -> str:
    if re.search(r"(?<!\\)(?:\\\\)*\$[A-Za-z_(]", s):
        raise ValueFormatError("interpolation is no data")

    def one(m):
        if m[1] not in ESCAPES:
            raise ValueFormatError(f"unknown escape {m[0]}")
        return ESCAPES[m[1]]

    return re.sub(r"\\(.)", one, s, flags=re.S)


def _number(text: str):
    if text[-1] in "Nuf":
        digits = text[:-1]
        if text[-1] == "f":
            return "f32", float(np.float32(digits))
        v = int(digits)
        if text[-1] == "u" and not 0 <= v < 2**64:
            raise ValueFormatError("unsigned integer out of range")
        return ("bigint" if text[-1] == "N" else "uint"), v
    if re.search(r"[.eE]", text):
        return "f64", float(text)
    v = int(text)
    return ("int" if -(2**63) <= v < 2**63 else "bigint"), v


def _construct(name: str, args: list):
    one = args[0] if len(args) == 1 else None
    if name in ("Keyword", "Symbol") and one and one[0] == "string":
        return name.lower(), one[1]
    if name == "Set" and one and one[0] == "vector":
        return "set", one[1]
    if name == "Tagged" and len(args) == 2 and args[0][0] == "string":
        return "tagged", (args[0][1], args[1])
    if name == "Ref" and args:
        return "tagged", ("ref", one or ("vector", args))
    if name == "UUID" and one and one[0] == "string":
        return "tagged", ("uuid", ("bytes", bytes.fromhex(one[1].replace("-", ""))))
    if one:
        return "tagged", (_tag_of(name), one)
    raise ValueFormatError(f"{name} takes one value")


def parse(text: str):
    shape, literals = _shaped(text)
    return shape.build(literals) if shape else read(text)


def read(text: str):
    reader = _Reader(text)
    out = reader.value()
    if reader.peek()[0] != "end":
        raise ValueFormatError("text after the value")
    return out


# ------------------------------------------------------------------------------------------------ shapes

_LITERAL = re.compile(r"\"((?:[^\"\\$]|\\.)*)\"|(?<![\w:'@?*+!<>/.-])([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?[Nuf]?)(?!\w)", re.S)
#: Shapes that a worker remembers.
SHAPES = 512
_shapes: dict = {}


class _Shape:
    """Functions from a text's literals, in order, to its value, its canonical value and its canonical text."""

    def __init__(self, tree, count: int):
        self.found: list[int] = []
        self.build, self.canonical, self.text = self._node(tree)
        if self.found != list(range(count)):
            raise ValueFormatError("a literal that is no value of its own")

    def _slot(self, value) -> int | None:
        if value[0] == "bigint":
            return value[1]
        return int(value[1][1:]) if value[0] == "string" else None

    def _node(self, value):
        at = self._slot(value)
        if at is not None:
            self.found.append(at)
            one = lambda x: x[at]
            return one, one, lambda x: to_text(x[at], True)
        kind, body = value
        before = len(self.found)
        if kind in ("vector", "set"):
            parts = [self._node(v) for v in body]
        elif kind == "map":
            if any(self._slot(k) is not None for k, _ in body):
                raise ValueFormatError("a key that is a literal")
            parts = [self._node(v) for _, v in body]
        elif kind == "tagged":
            parts = [self._node(body[1])]
        elif kind == "annotated":
            raise ValueFormatError("annotations are read each time")
        else:
            parts = []
        if len(self.found) == before:  # nothing in it varies
            fixed, text = canonical(value), to_text(value, True)
            return lambda x: value, lambda x: fixed, lambda x: text
        build, canon, texts = zip(*parts, strict=True)
        if kind == "vector":
            return lambda x: (kind, [f(x) for f in build]), lambda x: (kind, [f(x) for f in canon]), lambda x: f"[{', '.join([f(x) for f in texts])}]"
        if kind == "set":
            return (
                lambda x: (kind, [f(x) for f in build]), lambda x: canonical((kind, [f(x) for f in build])),
                lambda x: f"Set([{', '.join(sorted([f(x) for f in texts], key=str.encode))}])",
            )
        if kind == "tagged":
            tag, name = body[0], _constructor(body[0])
            if tag == "ref":
                raise ValueFormatError("references are written each time")
            opened = f"{name}(" if name else f'Tagged("{tag}", '
            return lambda x: (kind, (tag, build[0](x))), lambda x: (kind, (tag, canon[0](x))), lambda x: f"{opened}{texts[0](x)})"
        names = [k for k, _ in body]
        shown = [_keyword(k[1], "") if k[0] == "keyword" else to_text(k, True) for k in names]
        order = sorted(range(len(names)), key=lambda i: to_text(names[i], True).encode())
        pairs, sorted_pairs = list(zip(names, build, strict=True)), [(names[i], canon[i]) for i in order]
        written = [(shown[i] + "=", texts[i]) for i in order]
        return (
            lambda x: (kind, [(k, f(x)) for k, f in pairs]), lambda x: (kind, [(k, f(x)) for k, f in sorted_pairs]),
            lambda x: f"({', '.join([k + f(x) for k, f in written])})",
        )


def _shaped(text: str) -> tuple[_Shape | None, list]:
    """The text's shape and literals; no shape for texts that have to be read one by one."""
    parts = _LITERAL.split(text)
    fixed, strings, numbers = parts[::3], parts[1::3], parts[2::3]
    key = ("\0".join(fixed), "".join(["n" if s is None else "s" for s in strings]))
    shape = _shapes.get(key)
    if shape is None and key not in _shapes:
        if len(_shapes) >= SHAPES:
            _shapes.clear()
        _shapes[key] = shape = _learn(fixed, strings)
    if shape is None:
        return None, []
    try:
        return shape, [_number(n) if s is None else ("string", _unescape(s) if "\\" in s else s) for s, n in zip(strings, numbers, strict=True)]
    except ValueError:
        return None, []  # the reader says what is wrong


def _learn(fixed: list, strings: list) -> _Shape | None:
    if any('"' in f or "#" in f or "0x[" in f or f.startswith("\n") for f in fixed[:1] + fixed[1:]):
        return None
    marked = fixed[0] + "".join((f"{i}N" if s is None else f'"\1{i}"') + f for i, (s, f) in enumerate(zip(strings, fixed[1:], strict=True)))
    try:
        return _Shape(read(marked), len(strings))
    except ValueError:
        return None


def canonical_of(text: str):
    """The canonical value of a text."""
    shape, literals = _shaped(text)
    return shape.canonical(literals) if shape else canonical(read(text))


def canonical_text_of(text: str) -> str:
    shape, literals = _shaped(text)
    return shape.text(literals) if shape else to_text(read(text), canonical=True)


# ------------------------------------------------------------------------------------------------ identity


def identity(value):
    """A hashable form that is equal for equal values only: kinds count, NaN equals NaN, minus zero equals zero."""
    kind, body = value
    if kind in ("f32", "f64"):
        return kind, "nan" if body != body else body + 0.0
    if kind in ("vector", "set"):
        return kind, tuple(map(identity, body))
    if kind == "map":
        return kind, tuple((identity(k), identity(v)) for k, v in body)
    if kind == "tagged":
        return kind, body[0], identity(body[1])
    if kind == "annotated":
        return kind, identity(("map", body[0])), identity(body[1])
    return value


def canonical(value):
    """Sets, maps and metadata in the order of display text; repeats that end up side by side are gone."""
    kind, body = value

    def ordered(rows, of, unique=True):
        out, last = [], None
        for row in sorted(rows, key=lambda r: to_text(of(r)).encode()):
            if unique and out and identity(of(row)) == last:
                continue
            out.append(row)
            last = identity(of(row))
        return out

    pairs = lambda ps: [(canonical(k), canonical(v)) for k, v in ps]
    if kind == "vector":
        return kind, [canonical(v) for v in body]
    if kind == "set":
        return kind, ordered([canonical(v) for v in body], lambda v: v)
    if kind == "map":
        return kind, ordered(pairs(body), lambda p: p[0])
    if kind == "tagged":
        return kind, (body[0], canonical(body[1]))
    if kind == "annotated":
        return kind, (ordered(pairs(body[0]), lambda p: p[0], False), canonical(body[1]))
    return value


def strip_annotations(value):
    kind, body = value
    if kind == "annotated":
        return strip_annotations(body[1])
    if kind in ("vector", "set"):
        return kind, [strip_annotations(v) for v in body]
    if kind == "map":
        return kind, [(strip_annotations(k), strip_annotations(v)) for k, v in body]
    return (kind, (body[0], strip_annotations(body[1]))) if kind == "tagged" else value


# ------------------------------------------------------------------------------------------------ binary


class _Segment:
    """Bodies of values behind the root pointer, and the names and strings they refer to."""

    def __init__(self):
        self.data, self.names = bytearray(8), {}

    def room(self, size: int, align: int) -> int:
        self.data += bytes(-len(self.data) % align)
        at = len(self.data)
        self.data += bytes(size)
        return at

    def index(self, kind: str, text: str) -> int:
        return self.names.setdefault((kind, text), len(self.names))

    def body(self, packed: bytes, align: int) -> int:
        at = self.room(len(packed), align)
        self.data[at:] = packed
        return at

    def pointers(self, values) -> int:
        """A counted block of pointers; it precedes what it points to."""
        flat, width = values
        at = self.room(8 + 8 * len(flat), 8)
        struct.pack_into("<I", self.data, at, len(flat) // width)
        for i, v in enumerate(flat):
            struct.pack_into("<Q", self.data, at + 8 + 8 * i, self.put(v))
        return at

    def put(self, value) -> int:
        kind, v = value
        if kind == "nil":
            at = 0
        elif kind == "bool":
            at = self.body(bytes([v]), 1)
        elif kind in ("int", "uint", "f64"):
            at = self.body(struct.pack({"int": "<q", "uint": "<Q", "f64": "<d"}[kind], v), 8)
        elif kind == "f32":
            at = self.body(struct.pack("<f", v), 4)
        elif kind == "bigint":
            size = max(1, (abs(v).bit_length() + 7) // 8)
            at = self.body(struct.pack("<IB3x", size, 0 if v == 0 else 1 if v > 0 else 2) + abs(v).to_bytes(size, "little"), 8)
        elif kind in ENTRY_KINDS:
            at = self.body(struct.pack("<I", self.index(kind, ":" + v if kind == "keyword" else v)), 4)
        elif kind == "bytes":
            at = self.body(struct.pack("<I", len(v)) + v, 4)
        elif kind in ("vector", "set"):
            if kind == "set" and len({identity(x) for x in v}) < len(v):
                raise ValueFormatError("repeated set member")
            at = self.pointers((v, 1))
        elif kind == "map":
            if len({identity(k) for k, _ in v}) < len(v):
                raise ValueFormatError("repeated map key")
            at = self.pointers(([x for pair in v for x in pair], 2))
        elif kind == "tagged":
            tag = self.index("symbol", v[0])
            at = self.body(struct.pack("<IIQ", tag, 0, 0), 8)
            struct.pack_into("<Q", self.data, at + 8, self.put(v[1]))
        else:
            both = [self.put(("map", v[0])), self.put(v[1])]
            at = self.body(struct.pack("<QQ", *both), 8)
        return CODE[kind] << 48 | at


def encode(value, digest: bool = False) -> bytes:
    """A message of the value as it is; with ``digest`` its flag is set and algorithm id and SHA-256 follow."""
    seg = _Segment()
    struct.pack_into("<Q", seg.data, 0, seg.put(value))
    names = struct.pack("<I", len(seg.names))
    for kind, text in seg.names:
        raw = text.encode()
        names += struct.pack("<BI", ENTRY_KINDS[kind], len(raw)) + raw
    out = struct.pack("<4sHHQQQ", MAGIC, VERSION, DIGEST_FLAG if digest else 0, HEADER, HEADER + len(seg.data), len(names)) + seg.data + names
    return out + bytes([SHA256_ID]) + hashlib.sha256(out).digest() if digest else out


def decode(message: bytes):
    """The value of a message; a digest that is present must hold."""
    try:
        return _decode(message)
    except (struct.error, IndexError, UnicodeDecodeError) as e:
        raise ValueFormatError(f"truncated or damaged message: {e}") from None


def _decode(message: bytes):
    magic, version, flags, root, names_at, names_len = struct.unpack_from("<4sHHQQQ", message)
    end = names_at + names_len
    if magic != MAGIC or version != VERSION or names_at < HEADER or end > len(message):
        raise ValueFormatError("no such message")
    if flags & DIGEST_FLAG and message[end:] != bytes([SHA256_ID]) + hashlib.sha256(message[:end]).digest():
        raise ValueFormatError("digest mismatch")
    seg, names, at = message[HEADER:names_at], [], names_at + 4
    for _ in range(struct.unpack_from("<I", message, names_at)[0]):
        _, size = struct.unpack_from("<BI", message, at)
        if at + 5 + size > end:
            raise ValueFormatError("dictionary entry past the end")
        names.append(message[at + 5 : at + 5 + size].decode())
        at += 5 + size

    def cut(start, size):
        if start + size > len(seg):
            raise ValueFormatError("offset out of bounds")
        return seg[start : start + size]

    def block(start, width):
        count = width * struct.unpack_from("<I", seg, start)[0]
        return [get(p) for p in struct.unpack(f"<{count}Q", cut(start + 8, 8 * count))]

    def get(pointer):
        code, at = pointer >> 48, pointer & (1 << 48) - 1
        if code >= len(KINDS):
            raise ValueFormatError(f"unknown kind {code}")
        kind = KINDS[code]
        u32 = lambda: struct.unpack_from("<I", seg, at)[0]
        if kind == "nil":
            return NIL
        if kind == "bool":
            return kind, seg[at] != 0
        if kind in ("int", "uint", "f64", "f32"):
            return kind, struct.unpack_from({"int": "<q", "uint": "<Q", "f64": "<d", "f32": "<f"}[kind], seg, at)[0]
        if kind == "bigint":
            size, sign = struct.unpack_from("<IB", seg, at)
            return kind, int.from_bytes(cut(at + 8, size), "little") * (0, 1, -1)[sign]
        if kind in ENTRY_KINDS:
            return kind, names[u32()].removeprefix(":") if kind == "keyword" else names[u32()]
        if kind == "bytes":
            return kind, bytes(cut(at + 4, u32()))
        if kind in ("vector", "set"):
            return kind, block(at, 1)
        if kind == "map":
            flat = block(at, 2)
            return kind, list(zip(flat[::2], flat[1::2], strict=True))
        first, second = struct.unpack_from("<QQ", seg, at)
        if kind == "tagged":
            return kind, (names[first & 0xFFFFFFFF], get(second))
        return kind, (get(first)[1], get(second))

    return get(struct.unpack_from("<Q", message, root)[0])


def fact_digest(value) -> str:
    return hashlib.sha256(encode(canonical(strip_annotations(value)))).hexdigest()


# ------------------------------------------------------------------------------------------------ canonical JSON


def canonical_json(text: str) -> str:
    """Sorted keys, no spaces. Repeated keys and floats are refused: no two writers agree on the text of floats."""

    def pairs(items):
        if len(dict(items)) < len(items):
            raise ValueFormatError("repeated key")
        return dict(items)

    def refuse(x):
        raise ValueFormatError(f"float {x}")

    value = json.loads(text, object_pairs_hook=pairs, parse_float=refuse, parse_constant=refuse)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def json_contains(whole, part) -> bool:
    """Objects may hold more keys than ``part``, arrays match member by member, scalars match in kind and value."""
    if isinstance(part, dict):
        return isinstance(whole, dict) and all(k in whole and json_contains(whole[k], v) for k, v in part.items())
    if isinstance(part, list):
        return isinstance(whole, list) and len(whole) == len(part) and all(map(json_contains, whole, part))
    return type(whole) is type(part) and whole == part


# ------------------------------------------------------------------------------------------------ columns


def _column(returns: str, one, strict: bool):
    def guarded(x):
        if x is None:
            return None
        try:
            return one(x)
        except (ValueError, OverflowError, RecursionError):
            if strict:
                raise
            return None

    @F.pandas_udf(returns)
    def batch(s: pd.Series) -> pd.Series:
        return pd.Series([guarded(x) for x in s], dtype=object)

    return batch


def canonical_text(text: Column, strict: bool = False) -> Column:
    return _column("string", canonical_text_of, strict)(text)


def encode_canonical(text: Column, digest: bool = False, strict: bool = False) -> Column:
    return _column("binary", lambda t: encode(canonical_of(t), digest), strict)(text)


def decode_text(message: Column, strict: bool = False) -> Column:
    """Canonical text of a binary message, whose digest, if any, is verified."""
    return _column("string", lambda m: to_text(decode(bytes(m)), canonical=True), strict)(message)


def fact_digest_column(text: Column, strict: bool = False) -> Column:
    return _column("string", lambda t: fact_digest(parse(t)), strict)(text)


def object_digest_column(text: Column, strict: bool = False) -> Column:
    """SHA-256 of the canonical message, annotations included."""
    return _column("string", lambda t: hashlib.sha256(encode(canonical_of(t))).hexdigest(), strict)(text)


def canonical_json_column(text: Column, strict: bool = False) -> Column:
    return _column("string", canonical_json, strict)(text)


def json_contains_column(text: Column, part, strict: bool = False) -> Column:
    return _column("boolean", lambda t: json_contains(json.loads(t), part), strict)(text)


def kind_column(text: Column, strict: bool = False) -> Column:
    return _column("string", lambda t: parse(t)[0], strict)(text)
