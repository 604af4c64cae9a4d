"""Ed25519 verification after RFC 8032, strict: canonical numbers only, no points of small order. Plain Python, for
receipts and manifests; inject a library's verifier where there are many."""

from __future__ import annotations

import hashlib

# Fixed values of the curve: prime, group order, constant, base point.
P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
BASE_Y = 4 * pow(5, -1, P) % P


def _x(y: int, odd: int) -> int | None:
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * pow(2, (P - 1) // 4, P) % P
    if (x * x - square) % P or (x == 0 and odd):
        return None
    return P - x if x & 1 != odd else x


def _point(raw: bytes):
    y = int.from_bytes(raw, "little")
    odd, y = y >> 255, y & (1 << 255) - 1
    x = _x(y, odd) if y < P else None
    return None if x is None else (x, y, 1, x * y % P)


def _add(p, q):
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, p):
    out = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, p)
        p, n = _add(p, p), n >> 1
    return out


def _same(p, q) -> bool:
    return (p[0] * q[2] - q[0] * p[2]) % P == 0 and (p[1] * q[2] - q[1] * p[2]) % P == 0


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    if len(key) != 32 or len(signature) != 64:
        return False
    a, r, s = _point(key), _point(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= ORDER or any(_same(_times(8, p), (0, 1, 1, 0)) for p in (a, r)):
        return False
    h = int.from_bytes(hashlib.sha512(signature[:32] + key + message).digest(), "little") % ORDER
    base = (_x(BASE_Y, 0), BASE_Y, 1, _x(BASE_Y, 0) * BASE_Y % P)
    return _same(_times(s, base), _add(r, _times(h, a)))


def sign(seed: bytes, message: bytes) -> tuple[bytes, bytes]:
    """Public key and signature; for tests and tools, not hardened against timing."""
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | 1 << 254
    x = _x(BASE_Y, 0)
    base = (x, BASE_Y, 1, x * BASE_Y % P)

    def packed(p):
        inverse = pow(p[2], -1, P)
        x, y = p[0] * inverse % P, p[1] * inverse % P
        return (y | (x & 1) << 255).to_bytes(32, "little")

    key = packed(_times(a, base))
    r = int.from_bytes(hashlib.sha512(h[32:] + message).digest(), "little") % ORDER
    nonce = packed(_times(r, base))
    k = int.from_bytes(hashlib.sha512(nonce + key + message).digest(), "little") % ORDER
    return key, nonce + ((r + k * a) % ORDER).to_bytes(32, "little")
