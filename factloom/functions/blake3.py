"""BLAKE3 (default hash mode, 32 bytes), after its public specification; plain Python for small contents.

For columns of large contents use SHA-256, which runs in the JVM.
"""

from __future__ import annotations

import struct

# Fixed values of the specification: initial words, message permutation, flags, sizes.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
BLOCK, CHUNK, MASK = 64, 1024, 0xFFFFFFFF


def _mix(v: list, a: int, b: int, c: int, d: int, x: int, y: int) -> None:
    for word, far, near in ((x, 16, 12), (y, 8, 7)):
        v[a] = (v[a] + v[b] + word) & MASK
        t = v[d] ^ v[a]
        v[d] = (t >> far | t << (32 - far)) & MASK
        v[c] = (v[c] + v[d]) & MASK
        t = v[b] ^ v[c]
        v[b] = (t >> near | t << (32 - near)) & MASK


def _compress(chain, block: bytes, counter: int, flags: int) -> list:
    words = list(struct.unpack("<16I", block.ljust(BLOCK, b"\0")))
    v = [*chain, *IV[:4], counter & MASK, counter >> 32, len(block), flags]
    for k in range(7):
        for i in range(4):  # columns, then diagonals
            _mix(v, i, i + 4, i + 8, i + 12, words[2 * i], words[2 * i + 1])
        for i in range(4):
            _mix(v, i, (i + 1) % 4 + 4, (i + 2) % 4 + 8, (i + 3) % 4 + 12, words[8 + 2 * i], words[9 + 2 * i])
        if k < 6:
            words = [words[p] for p in PERMUTATION]
    return [v[i] ^ v[i + 8] for i in range(8)]


def _chunk(data: bytes, counter: int, flags: int) -> list:
    chain = IV
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)] or [b""]
    for i, block in enumerate(blocks):
        last = i == len(blocks) - 1
        chain = _compress(chain, block, counter, (CHUNK_START if i == 0 else 0) | ((CHUNK_END | flags) if last else 0))
    return chain


def _tree(data: bytes, counter: int, flags: int) -> list:
    if len(data) <= CHUNK:
        return _chunk(data, counter, flags)
    chunks = -(-len(data) // CHUNK)
    left = 1 << (chunks - 1).bit_length() - 1  # the largest power of two below the number of chunks
    both = _tree(data[: left * CHUNK], counter, 0) + _tree(data[left * CHUNK :], counter + left, 0)
    return _compress(IV, struct.pack("<16I", *both), 0, PARENT | flags)


def blake3(data: bytes) -> bytes:
    return struct.pack("<8I", *_tree(data, 0, ROOT))
