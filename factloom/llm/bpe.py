"""Byte-level BPE encoding and decoding through a pair occurrence index.

A batch's texts are cut into pre-tokens by code-point class, the distinct pre-tokens that are new to the worker become
one flat array of byte ids, and an index maps each mergeable pair to all its positions there. The active ranks are
applied in ascending order from a heap: a rank's positions are checked against the current symbols, merged left to
right, and the pairs that the merges create join the lists of their own (always later) ranks. Texts are then ids
gathered by pre-token. Decoding concatenates the bytes that the ids stand for.

The vocabulary file (``vocab`` and ``merges`` of a byte-level tokenizer in the public JSON format) is a parameter and is
read once on the driver. Special tokens of the file that occur literally in a text are single ids, as in the library.

Defined results: null and empty texts have no ids; repeated rows are encoded alike; very long texts are handled whole;
an empty table gives an empty result; input columns named like one of the outputs give way to it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix

LETTER, NUMBER, OTHER, SPACE, BLANK = 1, 2, 3, 4, 5  # SPACE: white space other than the blank
#: Distinct pre-tokens that a worker remembers before it starts afresh, and code points handled at a time.
REMEMBERED = 1_000_000
STEP_CHARS = 4 << 20
#: The suffixes that stand alone after an apostrophe in this pre-tokenizer.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = OTHER
    out[32] = BLANK
    return out


@lru_cache(maxsize=1)
def multipliers() -> np.ndarray:
    return np.random.default_rng(99).integers(1, 2**63, 1 << 16, dtype=np.uint64) | np.uint64(1)


class Vocabulary:
    """Symbols, bytes and merge ranks of a vocabulary file; small and of fixed size."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        back = {c: b for b, c in char.items()}
        self.base = np.array([vocab[char[b]] for b in range(256)], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        table = [b""] * size
        for token, i in vocab.items():
            table[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            table[i] = token.encode()
        self.bytes, self.byte_bounds = np.frombuffer(b"".join(table), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in table])])
        digits = [b"%d," % i for i in range(size)]
        self.decimal = np.array([list(d.ljust(8, b"\0")) for d in digits], np.uint8)
        self.pair = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)  # by rank
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.rising = bool((np.diff(self.made) > 0).all() and self.base.max() < self.made.min())
        self.table = HashTable(1 << 19)
        self.table.put(self.pair.astype(np.uint64) + np.uint64(1), np.arange(len(merges), dtype=np.int32))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where the pair doesn't merge."""
        return self.table.get((left.astype(np.int64) << 20 | right).astype(np.uint64) + np.uint64(1))

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged(self.bytes, self.byte_bounds, ids)[0].tobytes()


class HashTable:
    """Open addressing over non-zero uint64 keys, looked up and filled a vector at a time."""

    def __init__(self, size: int):
        self.keys, self.values, self.shift = np.zeros(size, np.uint64), np.zeros(size, np.int32), np.uint64(64 - (size.bit_length() - 1))
        self.mask = size - 1

    def _home(self, keys):
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], np.int32(-1))
        open_ = np.flatnonzero((found != keys) & (found != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys must be distinct and new."""
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = keys[free]
            won = free[self.keys[at[free]] == keys[free]]
            self.values[at[won]] = values[won]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask


def ragged(flat: np.ndarray, bounds: np.ndarray, which: np.ndarray):
    """The runs ``flat[bounds[w]:bounds[w + 1]]`` one after another, and the bounds of each."""
    begin = bounds[which]
    size = bounds[which + 1] - begin
    ends = np.cumsum(size)
    at = np.repeat(begin - ends + size, size)
    at += np.arange(len(at))
    return flat[at], np.concatenate([[0], ends])


def merge_all(vocabulary: Vocabulary, symbols: np.ndarray, bounds: np.ndarray):
    """Applies every merge to the words ``symbols[bounds[i]:bounds[i + 1]]``; their final symbols and bounds."""
    n = len(symbols)
    current = symbols.copy()
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    filled = bounds[:-1] < bounds[1:]
    after[bounds[1:][filled] - 1] = -1
    before[bounds[:-1][filled]] = -1
    alive = np.ones(n, bool)
    seen = np.zeros(n, np.int32)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(positions: np.ndarray) -> None:
        rank = vocabulary.rank(current[positions], current[after[positions]])
        ok = rank >= 0
        positions, rank = positions[ok], rank[ok].astype(np.uint16 if len(vocabulary.made) <= 65536 else np.int32)
        if not len(rank):
            return
        order = np.argsort(rank, kind="stable")
        positions, rank = positions[order], rank[order]
        cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            r = int(rank[a])
            if r not in index:
                index[r] = []
                heapq.heappush(heap, r)
            index[r].append(positions[a:b])

    add(np.flatnonzero(after >= 0).astype(np.int32))
    while heap:
        r = heapq.heappop(heap)
        parts = index.pop(r)
        left, right = int(vocabulary.pair[r]) >> 20, int(vocabulary.pair[r]) & 0xFFFFF
        at = np.concatenate(parts) if len(parts) > 1 else parts[0]
        nxt = after[at]
        ok = (current[at] == left) & (nxt >= 0) & alive[at]
        ok &= current[nxt] == right
        at = at[ok]
        turn = np.arange(len(at), dtype=np.int32)  # a position may have been listed twice
        seen[at] = turn
        at = at[seen[at] == turn]
        if left == right and len(at) > 1:  # runs of one symbol: every second pair, from the left
            at = np.sort(at)
            linked = np.concatenate([[False], after[at[:-1]] == at[1:]])
            start = np.maximum.accumulate(np.where(~linked, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
        if not len(at):
            continue
        nxt = after[at]
        current[at] = vocabulary.made[r]
        alive[nxt] = False
        far = after[nxt]
        after[at] = far
        some = far >= 0
        before[far[some]] = at[some]
        prev = before[at]
        add(np.concatenate([at[some], prev[prev >= 0]]))
    kept = np.concatenate([[0], np.cumsum(alive)])
    return current[alive], kept[bounds]


def cut(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of the rows ``points[bounds[i]:bounds[i + 1]]``."""
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n, bool)
    first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    last = np.zeros(n, bool)
    last[bounds[1:][bounds[:-1] < bounds[1:]] - 1] = True
    white = kind >= SPACE
    back, ahead = np.roll(kind, 1), np.roll(white, -1)
    back[first] = 0
    ends_run = white & ~last & ~ahead  # the last white space before something else stands apart from its run
    start = first | np.where(white, (back < SPACE) | ends_run, (kind != back) & (back != BLANK))
    quote = (points == 39) & ~last & start  # a mark that begins a token of its own
    for i in np.flatnonzero(quote).tolist():
        if not start[i]:
            continue
        end = i + 1
        for s in SUFFIXES:
            stop = i + 1 + len(s)
            if stop <= n and not first[i + 1 : stop].any() and all(points[i + 1 + k] == ord(c) for k, c in enumerate(s)):
                end = stop
                break
        if end > i + 1:
            start[i + 1 : end] = False
            if end < n:  # what follows begins anew: a letter of the run, a mark after it, or another row
                start[end] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes batches; remembers the ids of distinct pre-tokens (by a 64-bit hash) between them.

    ``merge`` gives new words their ids: the pair occurrence index unless another function of the same form is given.
    """

    def __init__(self, vocabulary: Vocabulary, merge=merge_all):
        self.v, self.merge = vocabulary, merge
        self.forget()

    def forget(self) -> None:
        self.table = HashTable(1 << (2 * REMEMBERED).bit_length())
        self.ids = np.zeros(0, np.int32)
        self.bounds = np.zeros(1, np.int64)

    def learn(self, hashes: np.ndarray, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Words are runs of code points; their bytes go through the merges together."""
        order = np.argsort(begin)
        hashes, begin, end = hashes[order], begin[order], end[order]
        chars, char_bounds = ragged(points, np.stack([begin, end], 1).ravel(), np.arange(0, 2 * len(begin), 2))
        raw = np.frombuffer(chars.tobytes().decode("utf-32-le").encode(), np.uint8)
        width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        ids, bounds = self.merge(self.v, self.v.base[raw], np.concatenate([[0], np.cumsum(width)])[char_bounds])
        self.table.put(hashes, np.arange(len(self.bounds) - 1, len(self.bounds) - 1 + len(hashes), dtype=np.int32))
        self.bounds = np.concatenate([self.bounds, bounds[1:] + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the bounds of each text."""
        special = [s for s in self.v.special if any(s in t for t in texts)]
        if not special:
            return self._rows(texts)
        marks = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")
        parts = [marks.split(t) for t in texts]
        ids, bounds = self._rows([p for ps in parts for p in ps[::2]])
        out, sizes, k = [], [], 0
        for ps in parts:
            own = [ids[bounds[k] : bounds[k + 1]]]
            for i, mark in enumerate(ps[1::2], k + 1):
                own += [np.array([self.v.special[mark]], np.int32), ids[bounds[i] : bounds[i + 1]]]
            k += (len(ps) + 1) // 2
            out += own
            sizes.append(sum(map(len, own)))
        return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def _rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.bounds) > REMEMBERED:
            self.forget()
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        starts = cut(points, bounds)
        flag = np.zeros(len(points), np.int32)
        flag[starts] = 1
        at = np.arange(len(points), dtype=np.int64) - starts[np.cumsum(flag) - 1]
        part = (points.astype(np.uint64) + np.uint64(1)) * multipliers()[at & 0xFFFF]
        far = at > 0xFFFF
        if far.any():
            part[far] = mix(part[far] + at[far].astype(np.uint64))
        hashes = mix(np.add.reduceat(part, starts)) | np.uint64(1)
        slots = self.table.get(hashes)
        new = np.flatnonzero(slots < 0)
        while len(new):  # more new pre-tokens than the table remembers are learnt in rounds
            room = REMEMBERED * 3 // 2 - len(self.bounds)
            unique, which = np.unique(hashes[new], return_index=True)
            if len(unique) > room:
                if len(texts) > 1:
                    half = len(texts) // 2
                    (a, x), (b, y) = self._rows(texts[:half]), self._rows(texts[half:])
                    return np.concatenate([a, b]), np.concatenate([x, y[1:] + x[-1]])
                self.table, self.ids, self.bounds = HashTable(1 << (4 * (len(unique) + REMEMBERED)).bit_length()), np.zeros(0, np.int32), np.zeros(1, np.int64)
                unique, which = np.unique(hashes, return_index=True)
                new = np.arange(len(hashes))
            begin = starts[new[which]]
            self.learn(unique, points, begin, np.append(starts, len(points))[new[which] + 1])
            slots[new] = self.table.get(hashes[new])
            new = new[:0]
        ids, token_bounds = ragged(self.ids, self.bounds, slots)
        return ids, token_bounds[np.searchsorted(starts, bounds)]

    def encode(self, text: str) -> list[int]:
        return self.rows([text or ""])[0].tolist()

    def decode(self, ids) -> str:
        return self.v.decode(np.asarray(ids, dtype=np.int64)).decode("utf-8", "replace")


_worker: dict = {}


def worker_encoder(vocabulary: Vocabulary, key: str, merge=merge_all) -> Encoder:
    """One encoder for the life of a Python worker."""
    if _worker.get("key") != (key, merge):
        _worker.update(key=(key, merge), encoder=Encoder(vocabulary, merge))
    return _worker["encoder"]


def text_steps(column: pa.Array, limit: int = STEP_CHARS):
    """The batch's texts (null: empty) in lists of about ``limit`` characters, with their first row."""
    texts, own, size, begin = column.to_pylist(), [], 0, 0
    for i, t in enumerate(texts):
        own.append(t or "")
        size += len(own[-1])
        if size >= limit:
            yield begin, own
            own, size, begin = [], 0, i + 1
    if own:
        yield begin, own


def encode(docs: DataFrame, path: str, carry: list[str] | None = None) -> DataFrame:
    """Adds ``ids`` (array<int>) and ``decoded`` to every row; ``carry``: the columns that stay (all unless given)."""

    def pack(e, ids, bounds):
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
        return [lists, pa.array([e.decode(ids[a:b]) for a, b in _pairs(bounds)], pa.string())]

    return _run(docs, path, carry, "ids array<int>, decoded string", pack)


def digests(docs: DataFrame, path: str, carry: list[str] | None = None) -> DataFrame:
    """Like ``encode``, but with n_tokens and sha256 of the ids' decimal text and of the decoded text."""

    def pack(e, ids, bounds):
        digits = e.v.decimal[ids]
        width = np.concatenate([[0], np.cumsum((digits != 0).sum(1))])[bounds].tolist()
        flat = digits[digits != 0].tobytes()
        raw, raw_bounds = ragged(e.v.bytes, e.v.byte_bounds, ids)
        raw, cuts = raw.tobytes(), raw_bounds[bounds].tolist()
        told = [hashlib.sha256(flat[a : max(a, b - 1)]).hexdigest() for a, b in zip(width[:-1], width[1:], strict=True)]
        text = [hashlib.sha256(raw[a:b].decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return [pa.array(np.diff(bounds)), pa.array(told, pa.string()), pa.array(text, pa.string())]

    return _run(docs, path, carry, "n_tokens long, ids_sha256 string, decoded_sha256 string", pack)


def library_merge(vocabulary: Vocabulary, symbols: np.ndarray, bounds: np.ndarray):
    """The same ids as ``merge_all`` from an installed BPE library, word by word (its ranks are the vocabulary's ids).

    A vocabulary whose ids don't rise with its ranks, which the library would merge wrongly, goes to ``merge_all``.
    """
    if not vocabulary.rising:
        return merge_all(vocabulary, symbols, bounds)
    if "library" not in _worker:
        import tiktoken

        table, edge = vocabulary.bytes.tobytes(), vocabulary.byte_bounds.tolist()
        ranks = {table[a:b]: i for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if i not in vocabulary.special.values()}
        _worker["library"] = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
        _worker["byte_of"] = np.zeros(int(vocabulary.base.max()) + 1, np.uint8)
        _worker["byte_of"][vocabulary.base] = np.arange(256)
    raw, one = _worker["byte_of"][symbols].tobytes(), _worker["library"]._encode_single_piece
    lists = [one(raw[a:b]) for a, b in _pairs(bounds)]
    sizes = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return np.fromiter((i for x in lists for i in x), np.int32, sizes[-1]), sizes


def _pairs(bounds):
    return zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)


def _run(docs, path, carry, new, pack):
    fields = [x.strip().split(" ")[0] for x in new.split(", ")]
    names = carry or [n for n in docs.columns if n not in fields]
    read = names if "text" in names else [*names, "text"]
    bc = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))  # fixed size: the vocabulary

    def run(batches):
        e = worker_encoder(bc.value, path)
        for batch in batches:
            for begin, texts in text_steps(batch.column(read.index("text"))):
                kept = [c.slice(begin, len(texts)) for c in batch.columns[: len(names)]]
                yield pa.RecordBatch.from_arrays([*kept, *pack(e, *e.rows(texts))], names=[*names, *fields])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields] + [new])
    return docs.select(*read).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text"))
    return digests(docs, public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])
