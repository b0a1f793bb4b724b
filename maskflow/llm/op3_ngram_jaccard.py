"""Exact Jaccard join of word n-gram sets by T-occurrence search, and its connected components.

1. Each text becomes the set of its distinct n-grams (64-bit hashes). Equal sets are one *node* from here on (64-bit
   hash of the set), so copies cost nothing further and no pair of copies is ever formed. A node has a *sketch*: for
   about as many buckets as elements, whether the bucket holds an odd number of them.
2. Routing. Sets of sizes a <= c that are similar enough differ in at most H(a) elements. Hash ranges cut a set into
   more than H segments, so such sets agree on a whole segment: only nodes that share a segment's signature are
   compared, by their sketches. Sketches differ in no more buckets than sets differ in elements, so a pair whose
   sketches differ in more can't be linked; the others connect their nodes to candidate families. Signatures of more
   than GROUP nodes connect all of them without comparing. Very frequent signatures, found in a sample of the texts,
   are never shuffled: each is combined to its least node in every task, and its nodes are connected to that.
3. Search. A family's sets go to one task (in chunks beyond CHUNK nodes or CHUNK_BYTES), which keeps inverted lists and
   answers each set's T-occurrence query by DivideSkip: the L longest lists are set aside, the short ones are merged in
   a heap that skips to what can still reach T - L, and survivors are probed in the long lists by binary search. Links
   inside a component that is known already add nothing to components and aren't searched again.
4. Families of many chunks: each chunk is searched along with the same few pivots; if the family is not yet one
   component, the nodes outside its largest one are searched against all its chunks, in blocks of pairs of chunks.

Nothing is capped: every pair that reaches the threshold lies in one family, and every two nodes of a family are
compared unless they are known to be connected.

Defined cases: null text, or text without words, has the empty set: n_shingles 0, linked with nothing, its own
component. Fewer than ``n`` words: the whole sequence is the one element. A row without doc_id is linked
like any other and never gives a component its id. Repeated rows count as copies. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_words, lower_ascii, materialize, mix, read_table, text_buffer, text_slices, word_bounds
from .components import components

#: Nodes of a family, and bytes of their sets, that one task searches at once (more only if a set alone is larger).
CHUNK, CHUNK_BYTES = 4096, 64 << 20
#: Nodes of one signature that are compared by sketches.
GROUP = 4096
#: One text in SAMPLED is looked at for signatures that occur HOT times among them; so many of these are kept apart.
SAMPLED, HOT, MOST_HOT = 64, 512, 10_000
#: Pairs of nodes, and words of their sketches, that are compared in one step.
PAIRS, PAIR_WORDS = 1 << 20, 1 << 21
#: Nodes that every chunk of a large family holds besides its own.
PIVOTS = 32
#: A segment of fewer elements is weak: its signature alone brings many unlike sets together, to be compared.
WEAK = 2
#: The text scan for candidate families gets their ids broadcast up to so many rows, else joins by shuffle.
BROADCAST_ROWS = 1_000_000

#: DivideSkip sets aside T / (MU * log2(longest list) + 1) long lists.
MU = 0.01

_GOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Threshold:
    """Two sets are linked when 100 * intersection >= percent * union."""

    percent: int = 90

    def linked(self, shared: int, a: int, b: int) -> bool:
        return 100 * shared >= self.percent * (a + b - shared)

    def least_shared(self, size: int) -> int:
        """Least overlap of a set of this size with any set it is linked with."""
        return -(-self.percent * size // 100)

    def needed(self, a: int, b: int) -> int:
        """Least overlap that links sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def groups(self, upto: int) -> np.ndarray:
        """First sizes of the size groups: linked sets lie in the same or in neighbouring groups."""
        firsts = [1]
        while firsts[-1] <= upto:
            firsts.append(max(100 * firsts[-1] // self.percent + 1, int(1.3 * firsts[-1])))
        return np.array(firsts, np.int64)

    def spare(self, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Extra segments, so that weak ones can be passed over, and the size below which a segment is weak: WEAK where
        segments are large enough for few to be so, else 1. ``least``: the smallest size of the group."""
        out = []
        for size in (WEAK, 1):
            mean = least / (most + 1)
            chance = np.exp(-mean) * (1 + mean * (size > 1))
            few = (most + 1) * chance
            far = np.where(most > 200, 5, 3)  # a long set with too many weak segments would cost the most
            out.append(np.where(most >= 12, np.ceil(few + far * np.sqrt(few) + 1), 0).astype(np.int64))
        large = out[0] <= (most + 1) // 8
        return np.where(large, out[0], out[1]), np.where(large, WEAK, 1)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Most elements that are in just one of two linked sets of these sizes."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def differ(self, size: int | np.ndarray):
        """Most elements that are in just one of two linked sets, the smaller one of this size."""
        return (100 - self.percent) * size // self.percent


# --- sets and signatures -------------------------------------------------------------------------------------


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, offsets): each text's distinct n-grams as sorted 64-bit hashes."""
    data, off = text_buffer(texts)
    data = lower_ascii(data)
    starts, ends, row = word_bounds(data, off)
    words = hash_words(data, starts, ends)
    rows = len(off) - 1
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])
    grams = max(0, len(words) - n + 1)
    element = np.zeros(grams, np.uint64)
    for k in range(n):
        element = mix(element * _GOLD + words[k : k + grams] + np.uint64(k + 1))
    whole = row[:grams] == row[n - 1 :] if grams else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < n))
    alone = np.zeros(len(short), np.uint64)
    for k in range(n - 1):
        more = count[short] > k
        alone[more] = mix(alone[more] * _GOLD + words[first[short[more]] + k] + np.uint64(k + 1))
    sizes = np.maximum(count - n + 1, 0)
    sizes[short] = 1
    ends = np.cumsum(sizes)
    flat = np.empty(int(ends[-1]) if rows else 0, np.uint64)
    is_short = np.zeros(len(flat), bool)
    is_short[ends[short] - 1] = True
    flat[~is_short], flat[is_short] = element[whole], mix(alone + count[short].astype(np.uint64))
    for e, s in zip(ends.tolist(), sizes.tolist(), strict=True):
        if s > 1:
            flat[e - s : e].sort()
    owner = np.repeat(np.arange(rows), sizes)
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    return flat[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=rows))]).astype(np.int64)


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[off[1:]] - total[off[:-1]]


def set_keys(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64-bit hash of each set."""
    return mix(_sums(mix(flat ^ _GOLD), off) + np.diff(off).astype(np.uint64) * _GOLD).view(np.int64)


def _segments(flat: np.ndarray, owner: np.ndarray, parts: np.ndarray, begin: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and size of each segment; an element's segment is its place among equal ranges of the hash space."""
    at = begin[owner] + (((flat >> np.uint64(32)) * parts[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    sizes = np.bincount(at, minlength=n)
    return _sums(mix(flat + _GOLD), np.concatenate([[0], np.cumsum(sizes)])), sizes  # flat is sorted, so are the segments


def signatures(flat: np.ndarray, off: np.ndarray, rule: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) such that rows of linked, different sets have a signature in common."""
    size = np.diff(off)
    firsts = rule.groups(int(size.max(initial=1)))
    own = np.searchsorted(firsts, size, side="right") - 1
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for shift in (0, 1):
        space = own - shift
        rows = np.flatnonzero((size > 0) & (space >= 0))
        if shift:  # as the larger set of a pair: is there a size in the group below that it can be linked with?
            rows = rows[-(-rule.percent * size[rows] // 100) < firsts[own[rows]]]
        if not len(rows):
            continue
        most = rule.differ(firsts[space[rows] + 1] - 1)
        spare, weakest = rule.spare(firsts[space[rows]], most)
        parts = most + 1 + spare
        begin = np.concatenate([[0], np.cumsum(parts)])
        elements = np.repeat(rows, size[rows])
        take = np.arange(len(elements)) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows]) + off[elements]
        part_flat, owner = flat[take], np.repeat(np.arange(len(rows)), size[rows])
        content, sizes = _segments(part_flat, owner, parts, begin, begin[-1])
        of = np.repeat(np.arange(len(rows)), parts)
        label = mix((space[rows][of].astype(np.uint64) << np.uint64(32)) + (np.arange(begin[-1]) - begin[of]).astype(np.uint64))
        sign = mix(content + label)
        weak = sizes < weakest[of]
        out.append((sign[~weak], rows[of[~weak]]))
        # at least spare + 1 segments agree; only where so many are weak can all that agree be weak
        n_weak = np.bincount(of[weak], minlength=len(rows))
        for k in np.flatnonzero(n_weak > spare).tolist():
            lo, hi = off[rows[k]], off[rows[k] + 1]
            # a weak segment agrees, so the differences lie in the rest, which agrees on one of as many parts again
            again = mix(flat[lo:hi] ^ _GOLD) >> np.uint64(32)
            second = ((again * np.uint64(parts[k])) >> np.uint64(32)).astype(np.int64)
            home = (((flat[lo:hi] >> np.uint64(32)) * np.uint64(parts[k])) >> np.uint64(32)).astype(np.int64)
            hashed = mix(flat[lo:hi] + _GOLD)
            for j in np.flatnonzero(weak[begin[k] : begin[k + 1]]).tolist():
                rest = home != j
                sums = np.zeros(parts[k], np.uint64)
                np.add.at(sums, second[rest], hashed[rest])
                got = mix(sign[begin[k] + j] ^ mix(sums + np.arange(1, parts[k] + 1).astype(np.uint64) * _GOLD))
                out.append((got, np.full(len(got), rows[k])))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([s for s, _ in out]).view(np.int64), np.concatenate([r for _, r in out])


def sketches(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): each set's parities of 2^k buckets, the least such number of at least its size and 64."""
    size = np.diff(off)
    buckets = (1 << np.ceil(np.log2(np.maximum(size, 64))).astype(np.int64)).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(buckets)])
    owner = np.repeat(np.arange(len(size)), size)
    at = begin[owner] + (mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & (buckets[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=begin[-1]) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8"), begin // 64


def alike(size: np.ndarray, words: np.ndarray, begin: np.ndarray, a: np.ndarray, b: np.ndarray, rule: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows (a, b) that sizes and sketches allow to be linked."""
    can = 100 * np.minimum(size[a], size[b]) >= rule.percent * np.maximum(size[a], size[b])
    a, b = a[can], b[can]
    width = np.diff(begin)

    def folded(rows: np.ndarray, w: int) -> np.ndarray:
        """A sketch of more buckets, folded to w words, is that of so many buckets."""
        place = begin[rows][:, None] + np.arange(w)
        x = words[place]
        for k in range(1, int(width[rows].max(initial=w)) // w):
            more = width[rows] // w > k
            x[more] ^= words[place[more] + k * w]
        return x

    most, least_width = rule.apart(size[a], size[b]), np.minimum(width[a], width[b])
    near = np.zeros(len(a), bool)
    for w in np.unique(least_width).tolist():
        same = np.flatnonzero(least_width == w)
        step = max(1, PAIR_WORDS // w)
        for at in range(0, len(same), step):
            some = same[at : at + step]
            near[some] = np.bitwise_count(folded(a[some], w) ^ folded(b[some], w)).sum(1, dtype=np.int64) <= most[some]
    return a[near], b[near]


def _compare(rule: Threshold):
    """Edges that connect the nodes of each signature which are alike; rows (sig, node, n_shingles, sketch), in order of sig."""

    def edges_of(rows: pa.Table) -> pa.RecordBatch:
        sig, node, size = (rows.column(c).to_numpy() for c in ("sig", "node", "n_shingles"))
        raw = rows.column("sketch").to_pylist()
        words, begin = np.frombuffer(b"".join(raw), "<u8"), np.concatenate([[0], np.cumsum([len(x) // 8 for x in raw])]).astype(np.int64)
        last = np.searchsorted(sig, sig, side="right")
        partners = last - np.arange(len(sig)) - 1
        upto = np.cumsum(partners)
        label = np.arange(len(sig))
        at = 0
        while at < len(sig):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
            n = partners[at:to]
            a = np.repeat(np.arange(at, to), n)
            b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + a + 1
            a, b = alike(size, words, begin, a, b, rule)
            while len(a):  # the least label of each pair spreads, until no pair has two
                la, lb = label[a], label[b]
                differ = la != lb
                if not differ.any():
                    break
                a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
                np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
                while True:
                    further = label[label]
                    if (further == label).all():
                        break
                    label = further
            at = to
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = batch.column("sig").to_numpy()
            cut = int(np.searchsorted(sig, sig[-1]))  # the last signature may go on
            if cut or (held and held[-1].column("sig")[-1].as_py() != sig[0]):
                if cut:
                    held.append(batch.slice(0, cut))
                yield edges_of(pa.Table.from_batches(held).combine_chunks())
                held = []
            held.append(batch.slice(cut))
        if held:
            yield edges_of(pa.Table.from_batches(held).combine_chunks())

    return run


def _scan(n: int):
    """doc_id, text_key, node, n_shingles and, at a node's first row in a slice, its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch):
                flat, off = shingle_sets(rows.column("text"), n)
                size, node = np.diff(off), set_keys(flat, off)
                _, once = np.unique(node, return_index=True)
                once = np.sort(once[size[once] > 0])
                words, begin = sketches(*_some(flat, off, once))
                held = np.zeros(len(size), np.int64)
                held[once] = np.diff(begin) * 8
                places = pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32))
                sketch = pa.Array.from_buffers(pa.binary(), len(size), [None, places.buffers()[1], pa.py_buffer(words.tobytes())])
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), rows.column("text_key"), pa.array(node, pa.int64(), mask=size == 0), pa.array(size, pa.int64()), sketch], names=["doc_id", "text_key", "node", "n_shingles", "sketch"])

    return run


def _some(flat: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of some rows."""
    size = np.diff(off)[rows]
    at = np.concatenate([[0], np.cumsum(size)])
    return flat[np.arange(at[-1]) + np.repeat(off[rows] - at[:-1], size)], at


def _signed(texts: DataFrame, n: int, rule: Threshold, hot: np.ndarray, wanted: bool = False) -> DataFrame:
    """(node, sig) of the signatures that are not among ``hot``, or only those (``wanted``); a node's own once a slice."""
    held = texts.sparkSession.sparkContext.broadcast(hot)  # at most MOST_HOT numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch):
                flat, off = shingle_sets(rows.column("text"), n)
                node = set_keys(flat, off)
                _, once = np.unique(node, return_index=True)
                once = np.sort(once[np.diff(off)[once] > 0])
                sign, of = signatures(*_some(flat, off, once), rule)
                if len(held.value):
                    keep = np.isin(sign, held.value) == wanted
                    sign, of = sign[keep], of[keep]
                yield pa.RecordBatch.from_arrays([pa.array(node[once][of]), pa.array(sign)], names=["node", "sig"])

    return texts.select("text").mapInArrow(run, "node long, sig long")


# --- T-occurrence search -------------------------------------------------------------------------------------


class InvertedLists:
    """Inverted lists over a few thousand sets, for T-occurrence queries by DivideSkip."""

    def __init__(self, sets: list[np.ndarray], ids: list[int]):
        self.ids, self.sizes = ids, {i: len(s) for i, s in zip(ids, sets, strict=True)}
        place = np.repeat(np.arange(len(ids)), [len(s) for s in sets])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.lexsort((place, flat))
        flat, place = flat[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        self.elements, self.begin = flat[first], np.append(first, len(flat))
        self.places = place.tolist()

    def lists(self, wanted: np.ndarray) -> list[tuple[int, int]]:
        """(begin, end) in ``places`` of the lists of those elements that have one, shortest first."""
        if not len(self.elements):
            return []
        at = np.searchsorted(self.elements, wanted)
        at = at[(at < len(self.elements)) & (self.elements[np.minimum(at, len(self.elements) - 1)] == wanted)]
        b, e = self.begin[at], self.begin[at + 1]
        by = np.argsort(e - b, kind="stable")
        return list(zip(b[by].tolist(), e[by].tolist(), strict=True))

    def search(self, query: np.ndarray, rule: Threshold, skip) -> Iterator[int]:
        """Ids of the sets linked with ``query``; ``skip(id)`` is asked as late as possible and saves the probing."""
        least = rule.least_shared(len(query))
        lists = self.lists(query)
        if len(lists) < least:
            return
        n_long = min(least - 1, int(least / (MU * math.log2(lists[-1][1] - lists[-1][0] + 1) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        need = least - n_long
        places, ids = self.places, self.ids
        heap = [(places[b], b, e) for b, e in short]
        heapq.heapify(heap)
        while len(heap) >= need:
            here = heap[0][0]
            shared = 0
            while heap and heap[0][0] == here:
                _, b, e = heap[0]
                shared += 1
                b += 1
                if b < e:
                    heapq.heapreplace(heap, (places[b], b, e))
                else:
                    heapq.heappop(heap)
            if shared >= need:
                i = ids[here]
                if not skip(i):
                    wanted = rule.needed(len(query), self.sizes[i])
                    left = len(long)
                    for b, e in reversed(long):
                        if shared >= wanted or shared + left < wanted:
                            break
                        left -= 1
                        at = bisect_left(places, here, b, e)
                        shared += at < e and places[at] == here
                    if shared >= wanted:
                        yield i
            elif len(heap) >= need:  # skip: no list before this one can reach the threshold alone
                least_next = heapq.nsmallest(need, heap)[-1][0]
                while heap and heap[0][0] < least_next:
                    _, b, e = heap[0]
                    b = bisect_left(places, least_next, b, e)
                    if b < e:
                        heapq.heapreplace(heap, (places[b], b, e))
                    else:
                        heapq.heappop(heap)


class Links:
    """Union-find over node keys, and the spanning edges that made it."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        root = x
        while (up := self.up.get(root, root)) != root:
            root = up
        while self.up.get(x, x) != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, a: int, b: int) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self.up[max(ra, rb)] = min(ra, rb)
            self.edges.append((a, b))


def link_sets(nodes: list[int], sets: list[np.ndarray], rule: Threshold, known: list[int] | None = None, queries: list[bool] | None = None) -> list[tuple[int, int]]:
    """Spanning edges of the links among the sets. ``known``: nodes of one label are connected already;
    ``queries``: only links of these are asked for (all, if None)."""
    links, last = Links(), {}
    for node, label in zip(nodes, known or nodes, strict=True):
        links.join(node, last.setdefault(label, node))
    links.edges.clear()

    def ask(index: InvertedLists, which: list[int]) -> None:
        for k in which:
            mine = nodes[k]
            for other in index.search(sets[k], rule, lambda i, mine=mine: links.find(i) == links.find(mine)):
                links.join(mine, other)

    order = sorted(range(len(nodes)), key=lambda k: (len(sets[k]), nodes[k]))
    pivots = order[:: max(1, len(order) // PIVOTS)]
    asked = order if queries is None else [k for k in order if queries[k]]
    ask(InvertedLists([sets[k] for k in pivots], [nodes[k] for k in pivots]), asked)
    if len(pivots) < len(order):
        root = [links.find(n) for n in nodes]
        names, counts = np.unique(root, return_counts=True)
        if len(names) > 1:
            main = names[counts.argmax()]  # a link between two components has an end outside the largest
            index = InvertedLists([sets[k] for k in order], [nodes[k] for k in order])
            ask(index, [k for k in asked if queries is not None or root[k] != main])
    return links.edges


# --- the operator --------------------------------------------------------------------------------------------

_EDGES = "a long, b long"


def _edges_frame(edges: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame({"a": pd.Series([a for a, _ in edges], dtype="int64"), "b": pd.Series([b for _, b in edges], dtype="int64")})


def _sets_of(wanted: DataFrame, docs: DataFrame, n: int, rows: int) -> DataFrame:
    """The sets (bytes) of the nodes of ``wanted`` (doc_id, node, ...), made again from the texts."""
    small = F.broadcast(wanted) if rows <= BROADCAST_ROWS else wanted
    columns = [f.name for f in wanted.schema if f.name != "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                flat, off = shingle_sets(part.column("text"), n)
                same = pa.array(set_keys(flat, off) == part.column("node").to_numpy(zero_copy_only=False))
                raw = pa.array([flat[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), raw], names=[*columns, "elements"]).filter(same)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema if f.name != "doc_id")
    found = docs.select(F.col("doc_id").cast("long"), "text").join(small, "doc_id").mapInArrow(run, f"{kinds}, elements binary")
    if wanted.where("doc_id is null").isEmpty():
        return found

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                flat, off = shingle_sets(part.column("text"), n)
                raw = pa.array([flat[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(flat, off)), raw], names=["node", "elements"])

    # nodes that only rows without an id have are known by the hash of the set
    rest = docs.where("doc_id is null").select("text").mapInArrow(sets, "node long, elements binary")
    rest = rest.join(small.where("doc_id is null").drop("doc_id"), "node").dropDuplicates(["node"])
    return found.unionByName(rest.select(found.columns))


def _hot_signatures(texts: DataFrame, n: int, rule: Threshold, one_in: int, least: int) -> np.ndarray:
    """Signatures that occur very often in a sample. What is found decides how rows move, never what is linked."""
    some = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(one_in)) == 0)
    counts = _signed(some, n, rule, np.zeros(0, np.int64)).groupBy("sig").count().where(F.col("count") >= least)
    return np.array([r["sig"] for r in counts.orderBy(F.desc("count"), "sig").limit(MOST_HOT).collect()], np.int64)


def _candidates(texts: DataFrame, nodes: DataFrame, n: int, rule: Threshold, group: int, hot_rule: tuple[int, int]) -> DataFrame:
    """Edges (a, b) that connect every two nodes which could be linked, directly or through others."""
    hot = _hot_signatures(texts, n, rule, *hot_rule)
    # one exchange, read by the aggregate and by the join
    signed = _signed(texts, n, rule, hot).repartition("sig")
    heads = signed.groupBy("sig").agg(F.min("node").alias("head"), F.max("node").alias("tail"), F.count("*").alias("n")).where("head < tail").drop("tail")
    shared = materialize(signed.join(heads, "sig").distinct(), "op3-shared")
    edges = shared.where((F.col("n") > group) & (F.col("node") != F.col("head"))).select(F.col("node").alias("a"), F.col("head").alias("b"))
    small = shared.where(F.col("n") <= group).select("sig", "node")
    # signatures of the same nodes tell the same: one of them is enough
    same = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.count("*").alias("n")]
    first = small.groupBy("sig").agg(*same).groupBy("x", "y", "n").agg(F.min("sig").alias("sig"))
    members = small.join(first, "sig", "left_semi").join(nodes.select("node", "n_shingles", "sketch"), "node")
    alike_ = members.select("sig", "node", "n_shingles", "sketch").repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(_compare(rule), _EDGES)
    edges = edges.unionByName(alike_)
    if len(hot):
        often = _signed(texts, n, rule, hot, wanted=True)
        least = materialize(often.groupBy("sig").agg(F.min("node").alias("b")), "op3-hot")  # at most MOST_HOT rows
        edges = edges.unionByName(often.join(F.broadcast(least), "sig").where("node <> b").select(F.col("node").alias("a"), "b"))
    return edges


def ngram_jaccard(docs: DataFrame, n: int = 3, percent: int = 90, chunk: int = CHUNK, group: int = GROUP, hot: tuple[int, int] = (SAMPLED, HOT)) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (equal sets; null for the empty set) of each row of ``docs``; besides
    text_key (64-bit hash of the text) and group, which names the component whatever the ids (null for the empty set)."""
    rule = Threshold(percent)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    rows = materialize(texts.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(_scan(n), "doc_id long, text_key long, node long, n_shingles long, sketch binary"), "op3-rows")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch"))
    nodes = materialize(nodes, "op3-nodes")
    rows = rows.drop("sketch")
    families = components(_candidates(texts, nodes, n, rule, group, hot), "op3-families")
    families = materialize(families.join(nodes.select("doc_id", "node", "n_shingles"), "node").select("doc_id", "node", "n_shingles", F.col("label").alias("family")), "op3-families")
    total = families.count()

    chunks = F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("n_shingles") * 8 / CHUNK_BYTES)).cast("int")
    sized = materialize(families.groupBy("family").agg(chunks.alias("chunks")).where("chunks > 1"), "op3-large")
    large = not sized.isEmpty()
    families = families.drop("n_shingles")
    if large:
        cut = families.join(sized, "family", "left").withColumn("chunk", F.when(F.col("chunks").isNotNull(), F.pmod(F.xxhash64("node"), F.col("chunks"))).otherwise(0).cast("int")).drop("chunks")
    else:
        cut = families.withColumn("chunk", F.lit(0))
    sets = _sets_of(cut, docs, n, total)
    if large:
        sets = materialize(sets, "op3-sets")

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("node")
        return _edges_frame(link_sets(frame["node"].tolist(), [np.frombuffer(x, np.uint64) for x in frame["elements"]], rule))

    edges = sets
    if large:  # the same pivots in each chunk of a family
        edges = sets.unionByName(_pivots(sets, sized))
    edges = materialize(edges.groupBy("family", "chunk").applyInPandas(search, _EDGES), "op3-edges")
    if large:
        edges = edges.union(_across(sets, sized, edges, rule))
    joined = components(edges, "op3-components")
    # aggregates are written before their joins: only joins of plain exchanges are split where a key is hot
    least = materialize(joined.join(nodes, "node").groupBy("label").agg(F.min("doc_id").alias("least")), "op3-label")
    joined = joined.join(least, "label").select("node", "least", "label")
    least = nodes.join(joined, "node", "left").select("node", F.coalesce("least", "doc_id").alias("component_id"), F.coalesce("label", "node").alias("group"))
    least = materialize(least, "op3-least")
    return rows.join(least, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("node").alias("class_id"), "text_key", "group")


def _pivots(sets: DataFrame, sized: DataFrame) -> DataFrame:
    """PIVOTS nodes of each large family, a row for each chunk of it."""
    from pyspark.sql import Window

    some = sets.join(sized, "family").where(F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks") * (CHUNK // PIVOTS)) == 0)
    rank = F.row_number().over(Window.partitionBy("family").orderBy("node"))
    few = some.withColumn("k", rank).where(F.col("k") <= PIVOTS)
    return few.select("node", "family", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "elements")


def _across(sets: DataFrame, sized: DataFrame, edges: DataFrame, rule: Threshold) -> DataFrame:
    """Links between different chunks of families that their chunks and pivots didn't connect."""
    labels = components(edges, "op3-chunks")
    labelled = sets.join(sized, "family").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = labelled.groupBy("family", "label").count()
    main = sizes.groupBy("family").agg(F.max_by("label", "count").alias("main"), F.count("*").alias("parts")).where("parts > 1")
    labelled = materialize(labelled.join(main.select("family", "main"), "family"), "op3-open")
    asked = labelled.where("label <> main").withColumns({"at": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "query": F.lit(True)})
    # a query chunk meets each chunk of the family; rows of the latter repeat once for each chunk that has queries
    by = asked.select("family", F.col("chunk").alias("query_chunk")).distinct()
    held = labelled.join(by, "family").withColumns({"at": F.col("chunk"), "query": F.lit(False)})
    columns = ["family", "query_chunk", "at", "node", "label", "query", "elements"]

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("query", ascending=False).drop_duplicates("node")
        return _edges_frame(link_sets(frame["node"].tolist(), [np.frombuffer(x, np.uint64) for x in frame["elements"]], rule, frame["label"].tolist(), frame["query"].tolist()))

    both = asked.withColumn("query_chunk", F.col("chunk")).select(columns).unionByName(held.select(columns))
    return both.groupBy("family", "query_chunk", "at").applyInPandas(search, _EDGES)


def one_of_each(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, that of the smallest doc_id (rows without one come last, ties go by a hash
    of the text). Rows without words belong to no component: of those equal in doc_id and text one stays, without doc_id all."""
    row = ["_op3_no_id", "_op3_id", "_op3_text"]
    named = lambda df, text: df.withColumns(dict(zip(row, (F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), text), strict=True)))
    rows = named(joined, F.col("text_key")).where("group is not null or doc_id is not null").select("group", *row)
    counts = materialize(rows.groupBy("group", *row).count(), "op3-rows")
    first = materialize(counts.where("group is not null").groupBy("group").agg(F.min(F.struct(*row)).alias("first")), "op3-first")
    others = materialize(counts.join(first, "group").where(F.struct(*row) != F.col("first")).select(row), "op3-others")
    again = materialize(counts.where("count > 1").join(others, row, "left_anti").select(row), "op3-again")
    sized = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    left = named(docs, F.xxhash64("text")).join(sized(others), row, "left_anti")
    if again.isEmpty():
        return left.select(docs.columns)
    again = sized(again)
    once = left.join(again, row, "left_semi").dropDuplicates(row)
    return left.join(again, row, "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(read_table(spark, sf_dir, "documents")).drop("text_key", "group")


QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}
ORACLE: dict[str, str] = {}
