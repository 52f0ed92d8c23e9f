"""Counting quotient filters over packed word-id n-grams: lossless, compact, mergeable.

An n-gram of k ids of b bits each is a number of k*b bits. It is permuted by
an invertible mixing of its words, so that its leading bits are evenly spread.
A filter holds the permuted numbers in order: the quotient (leading bits) as
one bit an entry and one a quotient, the remainder (all other bits) in full,
and a counter of one byte with longer ones beside. Nothing is lost: undoing
the permutation gives the n-gram back. Sorted filters are merged by adding up
equal numbers, and cut by leading bits into filters for separate shards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from wardlight.llm.textio import mix64

#: Updates of every word by the others; each is undone by itself, in reverse order.
ROUNDS = 2


def _update(words: list[np.ndarray], i: int, mask: np.uint64) -> None:
    others = np.full(len(words[0]), 0x9E3779B97F4A7C15 + i, np.uint64)
    with np.errstate(over="ignore"):
        for j, w in enumerate(words):
            if j != i:
                others = mix64(others + w)
    words[i] ^= others & mask


def permuted(words: list[np.ndarray], bits: int) -> list[np.ndarray]:
    out = [w.astype(np.uint64) for w in words]
    mask = np.uint64((1 << bits) - 1)
    for _ in range(ROUNDS):
        for i in range(len(out)):
            _update(out, i, mask)
    return out


def restored(words: list[np.ndarray], bits: int) -> list[np.ndarray]:
    out = [w.copy() for w in words]
    mask = np.uint64((1 << bits) - 1)
    for _ in range(ROUNDS):
        for i in reversed(range(len(out))):
            _update(out, i, mask)
    return out


def packed(words: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """The words as 64-bit limbs, first word in the leading bits of the first limb; unused low bits of the last are 0."""
    n = len(words[0])
    limbs = [np.zeros(n, np.uint64) for _ in range((len(words) * bits + 63) // 64)]
    for i, w in enumerate(words):
        at, off = divmod(i * bits, 64)
        room = 64 - off
        if bits <= room:
            limbs[at] |= w << np.uint64(room - bits)
        else:
            limbs[at] |= w >> np.uint64(bits - room)
            limbs[at + 1] |= w << np.uint64(64 - (bits - room))
    return limbs


def unpacked(limbs: list[np.ndarray], k: int, bits: int) -> list[np.ndarray]:
    mask, out = np.uint64((1 << bits) - 1), []
    for i in range(k):
        at, off = divmod(i * bits, 64)
        room = 64 - off
        if bits <= room:
            out.append((limbs[at] >> np.uint64(room - bits)) & mask)
        else:
            out.append(((limbs[at] << np.uint64(bits - room)) | (limbs[at + 1] >> np.uint64(64 - (bits - room)))) & mask)
    return out


def _added(limbs: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct numbers and their summed counts."""
    order = np.argsort(limbs[0], kind="stable") if len(limbs) == 1 else np.lexsort(limbs[::-1])
    limbs, counts = [x[order] for x in limbs], counts[order]
    new = np.zeros(len(counts), bool)
    new[:1] = True
    for x in limbs:
        new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    return [x[at] for x in limbs], np.add.reduceat(counts, at) if len(at) else counts


@dataclass
class Filter:
    """Permuted k-grams in order, with counts."""

    k: int
    bits: int
    limbs: list[np.ndarray]
    counts: np.ndarray

    @classmethod
    def of(cls, words: list[np.ndarray], bits: int) -> Filter:
        """Count the k-grams whose i-th words are ``words[i]``."""
        limbs = packed(permuted(words, bits), bits)
        return cls(len(words), bits, *_added(limbs, np.ones(len(limbs[0]), np.int64)))

    @classmethod
    def merged(cls, filters: list[Filter]) -> Filter:
        one = filters[0]
        if len(filters) == 1:
            return one
        limbs = [np.concatenate(x) for x in zip(*[f.limbs for f in filters], strict=True)]
        return cls(one.k, one.bits, *_added(limbs, np.concatenate([f.counts for f in filters])))

    def __len__(self) -> int:
        return len(self.counts)

    def words(self) -> list[np.ndarray]:
        return restored(unpacked(self.limbs, self.k, self.bits), self.bits)

    def cut(self, upto: int, more: int) -> list[tuple[int, Filter]]:
        """Shards by the ``more`` bits after the first ``upto``; the number of each and its filter, without empty ones."""
        lead = (self.limbs[0] << np.uint64(upto)) >> np.uint64(64 - more)
        edges = np.searchsorted(lead, np.arange((1 << more) + 1))
        return [(i, Filter(self.k, self.bits, [x[a:b] for x in self.limbs], self.counts[a:b]))
                for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if b > a]

    def encoded(self) -> bytes:
        """Header, bits of quotients, remainders as byte planes, counters, long counters."""
        n, first = len(self), self.limbs[0]
        # the quotient starts after the leading bits that all entries of a shard share
        shared = 64 - int(first[0] ^ first[-1]).bit_length() if n > 1 else 64
        q = min(64 - shared, max(1, n.bit_length()))
        left = 64 - shared - q
        body = (first << np.uint64(shared)) >> np.uint64(shared) if shared < 64 else np.zeros(n, np.uint64)
        quotient = (body >> np.uint64(left)).astype(np.int64)
        unary = np.ones(n + (1 << q), np.uint8)
        unary[np.searchsorted(quotient, np.arange(1 << q), side="right") + np.arange(1 << q)] = 0
        rest = body & np.uint64((1 << left) - 1)
        planes = [_planes(rest, left), *[_planes(x, 64) for x in self.limbs[1:]]]
        long = np.flatnonzero(self.counts >= 255)
        head = np.array([n, shared, q, len(long), self.k, self.bits, first[0]], "<u8")
        parts = [head.tobytes(), np.packbits(unary).tobytes(), *planes,
                 np.minimum(self.counts, 255).astype(np.uint8).tobytes(), self.counts[long].astype("<i8").tobytes()]
        whole = b"".join(parts)
        return len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)

    @classmethod
    def decoded(cls, data: bytes) -> Filter:
        size = int.from_bytes(data[:8], "little")
        whole = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True)
        n, shared, q, n_long, k, bits, top = (int(x) for x in np.frombuffer(whole, "<u8", 7))
        at, size = 56, (n + (1 << q) + 7) // 8
        unary = np.unpackbits(np.frombuffer(whole, np.uint8, size, at), count=n + (1 << q))
        at += size
        left = 64 - shared - q
        entries = np.flatnonzero(unary)
        quotient = (entries - np.arange(n)).astype(np.uint64)
        rest, at = _from_planes(whole, at, n, left)
        lead = np.uint64((top >> (64 - shared)) << (64 - shared) if shared else 0)
        first = lead | ((quotient << np.uint64(left)) | rest if shared < 64 else np.uint64(0))
        limbs = [np.broadcast_to(first, n).astype(np.uint64)]
        for _ in range((k * bits + 63) // 64 - 1):
            limb, at = _from_planes(whole, at, n, 64)
            limbs.append(limb)
        counts = np.frombuffer(whole, np.uint8, n, at).astype(np.int64)
        counts[counts == 255] = np.frombuffer(whole, "<i8", n_long, at + n)
        return cls(k, bits, limbs, counts)


def _planes(x: np.ndarray, bits: int) -> bytes:
    view = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(view[:, :(bits + 7) // 8].T).tobytes()


def _from_planes(data: bytes, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    wide = (bits + 7) // 8
    out = np.zeros((n, 8), np.uint8)
    if wide:
        out[:, :wide] = np.frombuffer(data, np.uint8, n * wide, at).reshape(wide, n).T
    return out.view("<u8").ravel().astype(np.uint64), at + n * wide
