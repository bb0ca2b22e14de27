"""Weighted acyclic automata over words: how often each phrase of up to three words occurs.

An automaton reads a phrase word by word; the weight of the last arc is the phrase's count.
It is built from sorted phrases, one depth after the other, so a phrase shares the states
of all its prefixes; states from which a single arc leads on are shared by equal arcs.
Automata of the same words' range are united by adding the weights of equal arcs, and
composed with a list of phrases to look up their counts. All of it works on arrays.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BITS = 21  # three word numbers make one sortable key while a shard is counted
MASK = (1 << BITS) - 1
_TYPES = ("<u1", "<u2", "<u4", "<i8")


def _starts(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _packed(values: np.ndarray) -> bytes:
    most = int(values.max()) if len(values) else 0
    kind = next(k for k, t in enumerate(_TYPES) if most <= np.iinfo(t).max)
    return struct.pack("<BQ", kind, len(values)) + values.astype(_TYPES[kind]).tobytes()


def word_array(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.large_binary())


class Automaton:
    """``words`` are sorted; ``label``, ``weight`` and ``parent`` have one array per depth.

    Arcs of a depth are in order of (parent, label). An arc without a count of its own has
    weight 0: the count of that phrase belongs to another automaton.
    """

    def __init__(self, words: pa.Array, label: list, weight: list, parent: list) -> None:
        self.words, self.label, self.weight, self.parent = words, label, weight, parent

    @classmethod
    def from_sorted(cls, keys: np.ndarray, counts: np.ndarray, words: pa.Array) -> Automaton:
        """From sorted distinct keys of three word numbers (from 1; 0 for none) and their counts."""
        used = np.unique(np.concatenate([(keys >> (BITS * k)) & MASK for k in range(3)]))
        used = used[used > 0]
        label, weight, parent = [], [], []
        above = np.empty(0, np.int64)
        for depth in range(3):
            here = (keys >> (BITS * (2 - depth))) & MASK
            keys, counts, here = keys[here > 0], counts[here > 0], here[here > 0]
            starts = _starts(keys >> (BITS * (2 - depth)))
            ends_here = (keys[starts] & ((1 << (BITS * (2 - depth))) - 1)) == 0
            label.append(np.searchsorted(used, here[starts]))
            weight.append(np.where(ends_here, counts[starts], 0))
            prefixes = keys[starts] >> (BITS * (3 - depth))
            parent.append(np.searchsorted(above, prefixes) if depth else np.zeros(len(starts), np.int64))
            above = keys[starts] >> (BITS * (2 - depth))
        return cls(words.take(pa.array(used - 1)), label, weight, parent)

    @classmethod
    def union(cls, parts: list[Automaton]) -> Automaton:
        """All phrases of all automata, with their counts added up."""
        if len(parts) == 1:
            return parts[0]
        every = pa.concat_arrays([p.words for p in parts]).dictionary_encode()
        order = pc.sort_indices(every.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        names = np.split(rank[every.indices.to_numpy()], np.cumsum([len(p.words) for p in parts])[:-1])
        above = [np.zeros(1, np.int64) for _ in parts]
        label, weight, parent = [], [], []
        for depth in range(3):
            keys = np.concatenate([
                (up[p.parent[depth]] << 32) | name[p.label[depth]] for p, up, name in zip(parts, above, names, strict=True)
            ])
            sums = np.concatenate([p.weight[depth] for p in parts])
            by_key = np.argsort(keys, kind="stable")
            keys = keys[by_key]
            starts = _starts(keys)
            place = np.empty(len(keys), np.int64)
            place[by_key] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(keys)]))
            above = np.split(place, np.cumsum([len(p.label[depth]) for p in parts])[:-1])
            label.append(keys[starts] & 0xFFFFFFFF)
            parent.append(keys[starts] >> 32)
            weight.append(np.add.reduceat(sums[by_key], starts) if len(starts) else sums)
        return cls(every.dictionary.take(pa.array(order)), label, weight, parent)

    def at_least(self, least: int) -> Automaton:
        """Only the phrases with that count, and arcs that lead to one."""
        keep = [w >= least for w in self.weight]
        for depth in (2, 1):
            keep[depth - 1][self.parent[depth][keep[depth]]] = True
        label, weight, parent = [], [], []
        for depth in range(3):
            weight.append(np.where(self.weight[depth] >= least, self.weight[depth], 0)[keep[depth]])
            label.append(self.label[depth][keep[depth]])
            up = self.parent[depth][keep[depth]]
            parent.append(up if depth == 0 else (np.cumsum(keep[depth - 1]) - 1)[up])
        used = np.unique(np.concatenate(label))
        return Automaton(self.words.take(pa.array(used)), [np.searchsorted(used, x) for x in label], weight, parent)

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (three columns, -1 for none) and counts of the phrases that have one."""
        out, counts = [], []
        rows = np.full((1, 3), -1, np.int64)
        for depth in range(3):
            rows = rows[self.parent[depth]]
            rows[:, depth] = self.label[depth]
            some = self.weight[depth] > 0
            out.append(rows[some])
            counts.append(self.weight[depth][some])
        return np.concatenate(out), np.concatenate(counts)

    def compose(self, phrases: list[pa.Array]) -> np.ndarray:
        """The count of each phrase, given as one array of words per place, null for none; 0 if unknown."""
        n = len(phrases[0])
        count, node, alive = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
        for depth, column in enumerate(phrases):
            name = pc.fill_null(pc.index_in(column, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            ended = column.is_null().to_numpy(zero_copy_only=False)
            arcs = (self.parent[depth] << 32) | self.label[depth]
            wanted = (node << 32) | np.maximum(name, 0)
            at = np.minimum(np.searchsorted(arcs, wanted), max(0, len(arcs) - 1))
            met = alive & ~ended & (name >= 0) & (arcs[at] == wanted if len(arcs) else False)
            count = np.where(ended, count, np.where(met, self.weight[depth][at] if len(arcs) else 0, 0))
            node, alive = np.where(met, at, node), met
        return count

    def dump(self) -> bytes:
        """As bytes: words, then arcs by depth; single arcs into the last depth are stored once."""
        sizes = pc.binary_length(self.words).to_numpy(zero_copy_only=False)
        text = b"".join(self.words.to_pylist())
        n2 = len(self.label[1])
        fan1 = np.bincount(self.parent[1], minlength=len(self.label[0]))
        fan2 = np.bincount(self.parent[2], minlength=n2)
        first = np.cumsum(fan2) - fan2
        # The register of states: none leads on from state 0; states with one arc are equal if it is.
        single = np.flatnonzero(fan2 == 1)
        arcs = np.stack([self.label[2][first[single]], self.weight[2][first[single]]], axis=1) if len(single) else np.empty((0, 2), np.int64)
        order = np.lexsort((arcs[:, 1], arcs[:, 0]))
        new = np.r_[True, (arcs[order][1:] != arcs[order][:-1]).any(axis=1)] if len(single) else np.empty(0, bool)
        several = np.flatnonzero(fan2 > 1)
        state = np.zeros(n2, np.int64)
        state[single[order]] = np.cumsum(new)
        state[several] = new.sum() + 1 + np.arange(len(several))
        owner = np.r_[single[order][new], several] if n2 else np.empty(0, np.int64)
        fan3 = fan2[owner]
        rows = _ranges(first[owner], fan3)
        arrays = (
            sizes, self.label[0], self.weight[0], fan1, self.label[1], self.weight[1], state,
            fan3, self.label[2][rows], self.weight[2][rows],
        )
        return b"".join(map(_packed, arrays)) + text

    @classmethod
    def load(cls, data: bytes) -> Automaton:
        arrays, at = [], 0
        for _ in range(10):
            kind, size = struct.unpack_from("<BQ", data, at)
            arrays.append(np.frombuffer(data, _TYPES[kind], size, at + 9).astype(np.int64))
            at += 9 + size * np.dtype(_TYPES[kind]).itemsize
        sizes, label1, weight1, fan1, label2, weight2, state, fan3, label3, weight3 = arrays
        offsets = np.r_[0, np.cumsum(sizes)].astype("<i8")
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[at:])])
        fans, starts = np.r_[0, fan3], np.r_[0, np.cumsum(fan3) - fan3]
        rows = _ranges(starts[state], fans[state])
        parents = [
            np.zeros(len(label1), np.int64),
            np.repeat(np.arange(len(fan1)), fan1),
            np.repeat(np.arange(len(state)), fans[state]),
        ]
        return cls(words, [label1, label2, label3[rows]], [weight1, weight2, weight3[rows]], parents)
