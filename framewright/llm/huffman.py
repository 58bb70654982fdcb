"""Canonical length-limited Huffman codes: construction, vectorised coding, table-driven decoding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bits of the longest code; also the width of the decoding table's index.
LIMIT = 18
#: Ids between two bit-offset checkpoints: each stretch can be decoded on its own.
STRETCH = 512


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths of at most ``limit`` bits for the ids that occur, by package-merge; 0 elsewhere."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit in codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels: list[np.ndarray] = []
    merged, is_leaf = leaves, np.ones(len(leaves), dtype=bool)
    for _ in range(limit):
        levels.append(is_leaf)
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        merged, is_leaf = both[rank], rank < len(leaves)
    lengths = np.zeros(len(order), dtype=np.uint8)
    take = 2 * len(order) - 2
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out[order] = lengths
    return out


@dataclass
class Code:
    """Canonical: codes of one length ascend with the id, and shorter ones come first."""

    lengths: np.ndarray

    def __post_init__(self) -> None:
        self.limit = max(1, int(self.lengths.max(initial=0)))
        ids = np.flatnonzero(self.lengths)
        ids = ids[np.argsort(self.lengths[ids], kind="stable")]
        size = self.lengths[ids].astype(np.int64)
        span = np.int64(1) << (self.limit - size)
        first = np.cumsum(span) - span
        self.codes = np.zeros(len(self.lengths), dtype=np.uint64)
        self.codes[ids] = (first >> (self.limit - size)).astype(np.uint64)
        self.table = np.zeros(1 << self.limit, dtype=np.uint32)
        self.table[: int(span.sum())] = np.repeat((ids.astype(np.uint32) << np.uint32(5)) | size.astype(np.uint32), span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bits from the top of each byte, bit offsets of every ``STRETCH``-th id)."""
        coded, _, marks, _ = self.encode_many(ids, np.array([len(ids)]))
        return coded.tobytes(), marks

    def encode_many(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Several documents at once, ``counts`` ids each, every one from a whole byte on.

        Given are the bytes and their number by document, and the bit offsets, from the document's own
        start, of every ``STRETCH``-th id and their number by document.
        """
        size = self.lengths[ids].astype(np.int64)
        if not size.all():
            raise ValueError("an id without a code")
        upto = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(counts)
        begins = ends - counts
        n_bytes = -(-(upto[ends] - upto[begins]) // 8)
        first_bit = 8 * (np.cumsum(n_bytes) - n_bytes)
        start = upto[:-1] + np.repeat(first_bit - upto[begins], counts)
        out = np.zeros(int(n_bytes.sum()) // 4 + 3, dtype=np.uint32)
        if len(ids):
            word, room = start >> 5, 64 - (start & 31) - size
            value = self.codes[ids] << room.astype(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], np.diff(word) > 0]))
            wide = np.bitwise_or.reduceat(value, first)
            at = word[first]
            out[at] |= (wide >> np.uint64(32)).astype(np.uint32)
            out[at + 1] |= (wide & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        n_marks = -(-counts // STRETCH)
        owner = np.repeat(np.arange(len(counts)), n_marks)
        place = begins[owner] + STRETCH * (np.arange(len(owner)) - np.repeat(np.cumsum(n_marks) - n_marks, n_marks))
        return out.astype(">u4").view(np.uint8)[: int(n_bytes.sum())], n_bytes, start[place] - first_bit[owner], n_marks

    def decode(self, payload: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of all stretches, which start at bit ``offsets`` and hold ``counts`` ids each.

        All stretches advance together, one id a step, so the work is in whole-array operations.
        """
        raw = np.concatenate([payload, np.zeros(8, np.uint8)]).astype(np.uint32)
        windows = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
        order = np.argsort(-counts, kind="stable")
        at, left = offsets[order].astype(np.int64), counts[order]
        out = np.zeros((len(order), int(counts.max(initial=0))), dtype=np.uint32)
        drop = np.uint32(32 - self.limit)
        active = len(order)
        for step in range(out.shape[1]):
            while active and left[active - 1] <= step:
                active -= 1
            where = at[:active]
            found = self.table[(windows[where >> 3] << (where & 7).astype(np.uint32)) >> drop]
            out[:active, step] = found >> np.uint32(5)
            where += (found & np.uint32(31)).astype(np.int64)
        back = np.empty_like(out)
        back[order] = out
        return back[np.arange(out.shape[1]) < counts[:, None]]
