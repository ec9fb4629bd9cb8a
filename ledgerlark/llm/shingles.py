"""Sets of word shingles, their SetSketch registers and the joint estimate of two sets' similarity, in numpy."""

from __future__ import annotations

import numpy as np

#: SetSketch: registers, base of the exponential spacing, rate, and the largest register value.
REGISTERS, BASE, RATE, LIMIT = 240, 1.001, 20.0, 65_534
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
_P = 0xD6E8FEB86659FD93
_P_INVERSE = pow(_P, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The distinct hashes of each text's word shingles, sorted. Fewer words than a shingle: the whole sequence is one; none: empty.

    A-Z count as lower case; words are what lies between ASCII white space. Hashes have 64 bits.
    """
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    doc_ends = np.cumsum([len(r) + 1 for r in raw])
    white = _WHITE[data]
    ends = np.flatnonzero(white & ~np.concatenate([[True], white[:-1]]))
    starts = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_OF_BYTE[_LOWER[data]] * _powers(_P, len(data)), dtype=np.uint64)])
    word = mix((sums[ends] - sums[starts]) * _powers(_P_INVERSE, len(data))[starts] ^ (ends - starts).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    bounds = np.concatenate([[0], np.searchsorted(starts, doc_ends)])
    chain = word.copy()
    for k in range(1, min(words, len(word))):
        chain[:-k] = mix(chain[:-k] * _U(0x9FB21C651E98DF25) + word[k:])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(chain[a : b - words + 1]))
        elif b > a:
            one = word[a : a + 1]
            for k in range(a + 1, b):
                one = mix(one * _U(0x9FB21C651E98DF25) + word[k : k + 1])
            out.append(mix(one + _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(members: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers."""
    a = mix(members ^ _U(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    b = mix(members + _U(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (sets, REGISTERS).

    Each member draws points of a Poisson process, each in a random register, so a register's least point is exponential; a member
    stops once its points are beyond the largest of its set's registers. A register's value is the point on an exponential
    scale, truncated: merging two sets is the larger value of each register.
    """
    least = np.full((len(sets), REGISTERS), np.inf)
    flat = least.reshape(-1)
    sizes = [len(s) for s in sets]
    if not sum(sizes):
        return np.zeros((len(sets), REGISTERS), np.uint16)
    member, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    reach, drawn, many = np.zeros(len(member)), 0, 1
    while len(member):
        steps = np.arange(drawn, drawn + many, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
        bits = mix(member[:, None] + steps[None, :])
        points = reach[:, None] + np.cumsum(-np.log(((bits >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53), 1) / (RATE * REGISTERS)
        register = (mix(bits ^ _U(0xC2B2AE3D27D4EB4F)) % _U(REGISTERS)).astype(np.int64)
        np.minimum.at(flat, (owner[:, None] * REGISTERS + register).ravel(), points.ravel())
        reach = points[:, -1]
        drawn += many
        going = reach < least.max(1)[owner]
        member, owner, reach = member[going], owner[going], reach[going]
        if len(member):
            many = max(1, min(64, drawn, 1_000_000 // len(member)))
    with np.errstate(divide="ignore"):
        value = np.floor(1 - np.log(least) / np.log(BASE))
    return np.clip(value, 0, LIMIT + 1).astype(np.uint16)


_GRID = np.linspace(0.0, 1.0, 101)


def estimate(more: np.ndarray, less: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of two sets, given how many registers are larger in the first, and in the second.

    Joint likelihood over the three outcomes of a register (larger, smaller, equal), with the sizes known.
    """
    u, v = (n1 / (n1 + n2))[:, None], (n2 / (n1 + n2))[:, None]
    top = np.minimum(u / v, v / u)
    j = _GRID[None, :] * top

    def larger(x):
        return np.maximum(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE), 1e-12)

    p, q = larger(u - v * j), larger(v - u * j)
    equal = np.maximum(1 - p - q, 1e-12)
    same = REGISTERS - more - less
    likely = more[:, None] * np.log(p) + less[:, None] * np.log(q) + same[:, None] * np.log(equal)
    return j[np.arange(len(j)), likely.argmax(1)]


def compare(a: np.ndarray, b: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """estimate() for rows of registers."""
    return estimate((a > b).sum(1), (a < b).sum(1), n1.astype(float), n2.astype(float))
