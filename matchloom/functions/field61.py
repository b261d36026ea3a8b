"""The field of integers modulo 2^61 - 1: vectors in numpy, polynomials as coefficient lists (lowest first)."""

from __future__ import annotations

import random

import numpy as np

P = (1 << 61) - 1
_P, _LOW31, _LOW30 = np.uint64(P), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_30, _31, _61, _1 = np.uint64(30), np.uint64(31), np.uint64(61), np.uint64(1)


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Element-wise product of uint64 vectors below P, without 128-bit integers."""
    ah, al, bh, bl = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    mid, low = ah * bl + al * bh, al * bl
    s = ((ah * bh) << _1) + (mid >> _30) + ((mid & _LOW30) << _31) + (low >> _61) + (low & _P)
    s = (s & _P) + (s >> _61)
    return np.where(s >= _P, s - _P, s)


def minus(z: int, a: np.ndarray) -> np.ndarray:
    """z - a for a vector below P."""
    z = np.uint64(z)
    return np.where(a <= z, z - a, z + (_P - a))


def segment_products(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Product of each segment of `values`; `starts` are the first positions, in ascending order, none empty."""
    sizes = np.diff(np.append(starts, len(values)))
    while len(values) > len(starts):
        place = np.arange(len(values)) - np.repeat(starts, sizes)
        left = np.flatnonzero(place % 2 == 0)
        paired = place[left] + 1 < np.repeat(sizes, sizes)[left]
        out = values[left]
        out[paired] = mul(out[paired], values[left[paired] + 1])
        values, sizes = out, (sizes + 1) // 2
        starts = np.cumsum(sizes) - sizes
    return values


def inverse(a: int) -> int:
    return pow(a, P - 2, P)


def trim(f: list[int]) -> list[int]:
    while f and f[-1] == 0:
        f.pop()
    return f


def monic(f: list[int]) -> list[int]:
    inv = 1 if f[-1] == 1 else inverse(f[-1])
    return [c * inv % P for c in f]


def product(f: list[int], g: list[int]) -> list[int]:
    if not f or not g:
        return []
    out = [0] * (len(f) + len(g) - 1)
    for i, a in enumerate(f):
        if a:
            for j, b in enumerate(g):
                out[i + j] += a * b
    return trim([c % P for c in out])


def difference(f: list[int], g: list[int]) -> list[int]:
    n = max(len(f), len(g))
    return trim([((f[i] if i < len(f) else 0) - (g[i] if i < len(g) else 0)) % P for i in range(n)])


def quotient(f: list[int], g: list[int]) -> tuple[list[int], list[int]]:
    """Quotient and remainder of f by g."""
    rest, out, inv = list(f), [0] * max(0, len(f) - len(g) + 1), 1 if g[-1] == 1 else inverse(g[-1])
    for k in range(len(f) - len(g), -1, -1):
        c = rest[k + len(g) - 1] * inv % P
        out[k] = c
        if c:
            for j, b in enumerate(g):
                rest[k + j] = (rest[k + j] - c * b) % P
    return trim(out), trim(rest[: len(g) - 1])


def gcd(f: list[int], g: list[int]) -> list[int]:
    while g:
        f, g = g, quotient(f, g)[1]
    return monic(f)


def value(f: list[int], z: int) -> int:
    out = 0
    for c in reversed(f):
        out = (out * z + c) % P
    return out


def square(f: list[int], modulus: list[int]) -> list[int]:
    """f squared, modulo a monic polynomial; sums are reduced late."""
    n = len(modulus) - 1
    out = [0] * max(2 * len(f) - 1, n)
    for i, a in enumerate(f):
        if a:
            out[2 * i] += a * a
            a += a
            for j in range(i + 1, len(f)):
                out[i + j] += a * f[j]
    low = modulus[:n]
    for k in range(len(out) - 1, n - 1, -1):
        c = out[k] % P
        if c:
            k -= n
            for j, b in enumerate(low):
                out[k + j] -= c * b
    return [c % P for c in out[:n]]


def interpolate(points: list[int], values: list[int]) -> list[int]:
    """The polynomial through the points (Newton's divided differences)."""
    table = list(values)
    for k in range(1, len(points)):
        for i in range(len(points) - 1, k - 1, -1):
            table[i] = (table[i] - table[i - 1]) * inverse((points[i] - points[i - k]) % P) % P
    out: list[int] = []
    for k in range(len(points) - 1, -1, -1):
        out = product(out, [-points[k] % P, 1])
        out = trim([((out[0] if out else 0) + table[k]) % P, *out[1:]])
    return out


def roots(f: list[int], seed: int = 1) -> list[int] | None:
    """The roots of a monic polynomial, or None where it does not split into different linear factors.

    For a random shift, g(z) = z + shift keeps its value under 60 squarings exactly at the roots where g is
    a square; the others are taken to their negative, which splits the factors into two about equal parts.
    """
    rng, out, open_, tries = random.Random(seed), [], [f], 64 + 16 * len(f)
    while open_:
        g = open_.pop()
        if len(g) <= 2:
            out += [-g[0] % P] if len(g) == 2 else []
            continue
        if (tries := tries - 1) < 0:
            return None
        shift = rng.randrange(P)
        h = [shift, 1]
        for _ in range(60):
            h = square(h, g)
        same = difference(h, [shift, 1])
        part = gcd(g, same) if same else g
        open_ += [g] if len(part) in (1, len(g)) else [part, quotient(g, part)[0]]
    return out if len(set(out)) == len(f) - 1 and not any(value(f, z) for z in out) else None


def ratio(points: list[int], values: list[int], top: int) -> tuple[list[int], list[int]]:
    """The rational function of lowest terms through the points whose numerator has degree `top` at most.

    Extended Euclid on the interpolating polynomial. Both parts are monic.
    """
    r0: list[int] = [1]
    for z in points:
        r0 = product(r0, [-z % P, 1])
    r1, t0, t1 = interpolate(points, values), [], [1]
    while len(r1) - 1 > top:
        q, rest = quotient(r0, r1)
        r0, r1, t0, t1 = r1, rest, t1, difference(t0, product(q, t1))
    return (monic(r1) if r1 else []), (monic(t1) if t1 else [])
