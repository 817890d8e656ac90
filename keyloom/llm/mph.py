"""A minimal perfect hash over fixed-width digests, in vectorised numpy.

Level by level, every key still without a slot hashes into a bit array; keys that land alone
set their bit, the others go on to the next level. A key's slot is the number of set bits
before its own, so n keys fill slots 0 to n - 1. Nonmembers may land on a set bit: callers
compare the full digest in the slot.
"""

from __future__ import annotations

import io

import numpy as np

WIDTH = 32
_GAMMA = 2
_LEVELS = 48


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _spot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    words = np.ascontiguousarray(keys).view("<u8")
    with np.errstate(over="ignore"):
        seed = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
        h = _mix(words[:, level % 4] + seed) ^ _mix(words[:, (level + 1) % 4] ^ seed)
        return (_mix(h) % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """``build(keys)`` takes distinct (n, 32) uint8 digests; ``slots(keys)`` gives -1 for sure nonmembers."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self._starts = np.cumsum([0] + [int(x.sum()) for x in levels])
        self._ranks = [np.cumsum(x) - x for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        left = keys
        for level in range(_LEVELS):
            if not len(left):
                break
            bits = _GAMMA * len(left) + 1
            at = _spot(left, level, bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(alone)
            left = left[~alone[at]]
        # Digests that agree in every hash so far (not seen in practice) keep a sorted list.
        return cls(levels, left[np.lexsort(left.T[::-1])] if len(left) else left)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                return out
            at = _spot(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self._starts[level] + self._ranks[level][at[hit]]
            open_ = open_[~hit]
        if len(self.rest):
            place = {bytes(k): i for i, k in enumerate(self.rest)}
            for i in open_:
                if (j := place.get(bytes(keys[i]))) is not None:
                    out[i] = self._starts[-1] + j
        return out

    def to_bytes(self, **slots: np.ndarray) -> bytes:
        """The hash and its slot columns, which the caller has put in slot order, as one blob."""
        out = io.BytesIO()
        packed = {f"level{i}": np.packbits(x) for i, x in enumerate(self.levels)}
        np.savez(out, sizes=np.array([len(x) for x in self.levels], dtype=np.int64), rest=self.rest, **packed, **slots)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, blob: bytes) -> tuple[PerfectHash, dict[str, np.ndarray]]:
        with np.load(io.BytesIO(blob)) as f:
            levels = [np.unpackbits(f[f"level{i}"], count=int(n)).astype(bool) for i, n in enumerate(f["sizes"])]
            rest = f["rest"]
            slots = {k: f[k] for k in f.files if not k.startswith("level") and k not in ("sizes", "rest")}
        return cls(levels, rest), slots
