"""URL filters: glob rules packed into multiword Shift-And masks, all simulated at once over each canonical URL.

A rule is a host suffix and a path prefix. On the canonical form ``.host<SEP>path`` (SEP a byte that UTF-8 never has)
it is the glob ``*.host<SEP>path*``; ``?`` in a rule stands for any one byte and ``*`` for any run of bytes. Each
pattern byte is one bit of a state vector of 64-bit words; a bit with a ``*`` before it also holds itself, and a
carry-free shift per word plus the word's top bit carries states over word bounds. One pass over a URL's bytes moves
all rules' states together; the step is vectorised over the URLs of a batch, which only take part while they last.

The longest rule that matches gives the verdict (on equal length: block); no match gives ``default``.

Defined results: a null url or one without ``://`` has an empty host and path and gets the default; repeated rows are
judged each on its own; very long urls are scanned whole; an empty table gives an empty result. Other columns pass;
those named like one of the outputs give way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEP = 0xFF
#: The rules of the contract as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DEFAULT = "allow"


class Automaton:
    """Shift-And over many globs: byte masks, self-loops, initial and final bits."""

    def __init__(self, rules=RULES):
        self.rules = sorted(rules, key=lambda r: (-len((r[1] + r[2]).encode()), r[0] != "block", r[1], r[2]))
        bits, ends, loops, begins, free = [], [], [], [], []
        for _, host, path in self.rules:
            begins.append(len(bits))
            star = True  # every pattern begins after a free run
            for b in b"." + host.encode() + bytes([SEP]) + path.encode():
                if b == ord("*"):
                    star = True
                    continue
                if star and len(bits) > begins[-1]:
                    loops.append(len(bits) - 1)  # what has matched so far may wait here for any bytes
                star = False
                if b == ord("?"):
                    free.append(len(bits))
                bits.append(b)
            ends.append(len(bits) - 1)
        self.words = max(1, -(-len(bits) // 64))
        one = lambda at: self._mask(at)
        self.bytes = np.zeros((256, self.words), np.uint64)
        for i, b in enumerate(bits):
            if i not in free:
                self.bytes[b, i // 64] |= np.uint64(1 << (i % 64))
        self.bytes |= one(free)
        self.begin, self.loop, self.ends = one(begins), one(loops), ends

    def _mask(self, at):
        out = np.zeros(self.words, np.uint64)
        for i in at:
            out[i // 64] |= np.uint64(1 << (i % 64))
        return out

    def first_match(self, texts: list[bytes]) -> np.ndarray:
        """Index of the best rule that matches each text, -1 for none."""
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        flat, bounds = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(size)])
        size, base = size[order], bounds[:-1][order]
        state, hit = np.zeros((len(texts), self.words), np.uint64), np.zeros((len(texts), self.words), np.uint64)
        top, one = np.uint64(63), np.uint64(1)
        for k in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -k, side="left"))  # rows longer than k
            d = state[:live]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            state[:live] = ((moved | self.begin) & self.bytes[flat[base[:live] + k]]) | (d & self.loop)
            hit[:live] |= state[:live]
        best = np.full(len(texts), -1, np.int64)
        for r in reversed(range(len(self.rules))):
            e = self.ends[r]
            best[(hit[:, e // 64] >> np.uint64(e % 64) & one) == 1] = r
        out = np.empty_like(best)
        out[order] = best
        return out


def canonical(column) -> tuple:
    """Host (ASCII lower-cased) and path columns: what follows the first ``://`` up to ``/?#``, and up to ``?#``."""
    rest = F.expr(f"if(instr({column}, '://') > 0, substr({column}, instr({column}, '://') + 3), '')")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(pages: DataFrame, rules=RULES, default: str = DEFAULT, column: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to every row."""
    automaton = Automaton(rules)
    names = [n for n in pages.columns if n not in ("host", "path", "rule", "verdict")]
    host, path = canonical(f"`{column}`")
    read = pages.select(*names, F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))

    def run(batches):
        for batch in batches:
            pairs = zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)
            best = automaton.first_match([b"." + h.encode() + bytes([SEP]) + p.encode() for h, p in pairs]).tolist()
            rule = [automaton.rules[i][1] + automaton.rules[i][2] if i >= 0 else None for i in best]
            verdict = [automaton.rules[i][0] if i >= 0 else default for i in best]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields] + ["rule string", "verdict string"])
    return read.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), ruled AS (
  SELECT page_id, host, path,
         CASE WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
