"""Similarity join of documents by the Jaccard similarity of their word n-grams, with token-combination prefixes.

The tokens of the join are hashed n-grams.  All documents order their tokens alike: by frequency level, rare first, then
by hash.  Two sets that reach the similarity share at least ``o`` of their ``n`` tokens, so of the first
``n - o + 1`` tokens of each at least one is common.

*Frequency classes.*  Levels are logarithms of frequencies.  Below ``rare_level`` a token is indexed by itself (k = 1).
From there on tokens would open long lists, so the tokens of a class are dealt to groups and of every group
combinations are indexed: of two tokens (k = 2), from ``triple_level`` on of three (k = 3).  ``k - 1`` common tokens
of a group stay unseen, so the prefix is extended by ``k - 1`` for each group met: ``g`` tokens of a group count as
``g - k + 1``, and the prefix ends when the count is ``n - o + 1``.  The number of groups follows the size of a set by powers of two;
a set whose partners may be of a neighbouring size is indexed under that size as well.  Sizes too small for
unseen tokens (``_groups``) use k = 1 throughout.

Frequencies are estimated over all documents by a count-min sketch of fixed size, summed by tasks: it only orders
tokens, so its errors, and rows that a task counts twice, cost time, never links.

*Candidates.*  Documents with equal sets are one node.  Entries that are expected to be long are dealt to chunks by the node.
Every chunk has a leader, the node with the earliest place in its order (near copies have tokens of
their own, which come first; what they were copied from has none).

1. Short entries give all their pairs; in long entries each node meets the leader that it shares most entries with.
2. Long entries whose nodes are still in different components are compared block by block, and of each block only a
   forest of its nearest candidates goes on.
3. What long entries still hold across components goes on as a whole.

A pair passes bounds on length and place, then on parity bitmaps: bit ``i`` is the parity of the number of tokens with
hash ``i``, so two bitmaps differ in at most as many bits as their sets differ in tokens.  Only then do texts cross the
network, and the pair is verified on its sets.  No bound drops a link, and pairs of long entries within a component
are not compared again, which keeps large groups of near copies linear while no link between components is missed.

Sets are compared by 64-bit hashes of their n-grams: the odds of a wrong count in a pair of sets of ``n`` tokens are
below ``n * n / 2 ** 63``.  Equal sets are recognised by a 64-bit digest and their size: among ``d`` different sets the odds of
any mistake are below ``d * d / 2 ** 65`` (one in ten thousand for sixty million sets).

Defined results: a null or empty text has an empty set and is linked with nothing; a null id is returned with a null
component and takes no part; rows that share an id are one document, linked when any of its texts is; repeated rows
are each returned; very long texts are sets as any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.arrow import in_small_batches, rows
from loomwork.llm.bloom import Bloom
from loomwork.llm.scratch import Scratch
from loomwork.llm.wordhash import Words, batches, mix, ngrams, pair

_U = np.uint64
_SKETCH_PARTS = 256
_SEED = _U(0xA0761D6478BD642F)
_LOW = 2**31 - 1
#: Nodes of an entry that one chunk is expected to hold.
_CHUNK = 2048
#: Entries of at most so many nodes give pairs directly.
_SHORT = 32
_BLOOM_BITS = 25


class TokenSets:
    """The sets of hashed n-grams (A-Z in lower case) of texts: sorted distinct ``tokens``, those of text j from ``first[j]``
    to ``first[j + 1]``.  A text of fewer than n words has its whole sequence as one token."""

    def __init__(self, texts: list[bytes], n: int):
        w = Words([t.lower() for t in texts])
        grams = ngrams(w.hashes, n)
        size = w.counts()
        first = np.concatenate(([0], np.cumsum(np.where(size >= n, size - n + 1, size > 0))))
        out = np.empty(first[-1], _U)
        for a, b, at in zip(w.first.tolist(), w.last.tolist(), first.tolist(), strict=False):
            if b - a >= n:
                own = out[at : at + b - a - n + 1]
                own[:] = grams[a : b - n + 1]
                own.sort()
            elif b > a:
                h = np.array([b - a], _U)
                for k in range(a, b):
                    h = pair(h, w.hashes[k : k + 1])
                out[at : at + 1] = h
        new = np.ones(len(out), bool)
        new[1:] = out[1:] != out[:-1]
        new[first[:-1][size > 0]] = True
        self.tokens = out[new]
        self.first = np.concatenate(([0], np.cumsum(new)))[first]
        self.sizes = np.diff(self.first)

    def __getitem__(self, j: int) -> np.ndarray:
        return self.tokens[self.first[j] : self.first[j + 1]]

    def digests(self) -> np.ndarray:
        """Signed digests of the sets; 0 for empty ones."""
        out = np.zeros(len(self.sizes), np.int64)
        some = np.flatnonzero(self.sizes)
        if len(some):
            at = self.first[some]
            mixed = mix(self.tokens)
            total = pair(pair(np.add.reduceat(mix(self.tokens ^ _SEED), at), np.bitwise_xor.reduceat(mixed, at)), self.sizes[some].astype(_U))
            out[some] = total.view(np.int64)
            out[some[out[some] == 0]] = 1
        return out

    def bitmaps(self) -> list[bytes | None]:
        """Parity bitmap of each set: its size in four bytes, then between 2 and 4 bits a token."""
        out: list[bytes | None] = []
        for j, n in enumerate(self.sizes.tolist()):
            if n:
                bits = max(64, 1 << (2 * n - 1).bit_length())
                odd = np.bincount((self[j] & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
                out.append(n.to_bytes(4, "little") + np.packbits(odd.astype(bool), bitorder="little").tobytes())
            else:
                out.append(None)
        return out


def can_link(a: int, b: int, difference: int, num: int, den: int) -> bool:
    """Whether sets of ``a`` and ``b`` tokens that differ in at least ``difference`` tokens can reach num/den."""
    return (den + num) * difference <= (den - num) * (a + b)


Parity = tuple[int, int, int]  # tokens, bits, bitmap


def parity(packed: bytes) -> Parity:
    return int.from_bytes(packed[:4], "little"), 8 * (len(packed) - 4), int.from_bytes(packed[4:], "little")


def least_difference(a: Parity, b: Parity) -> int:
    """A lower bound of the number of tokens in one of two sets only; the longer bitmap is folded to the shorter."""
    (_, m, x), (_, k, y) = a, b
    while m > k:
        m //= 2
        x = (x >> m) ^ (x & ((1 << m) - 1))
    while k > m:
        k //= 2
        y = (y >> k) ^ (y & ((1 << k) - 1))
    return (x ^ y).bit_count()


class Sketch:
    """Count-min sketch of token frequencies: two rows of ``2 ** bits`` counts."""

    def __init__(self, bits: int, counts: np.ndarray | None = None):
        self.bits = bits
        self.counts = np.zeros((2, 1 << bits), np.uint32) if counts is None else counts
        mean = float(self.counts.mean())
        self.noise = mean + 3 * mean**0.5

    def _cells(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = _U(64 - self.bits)
        return (tokens >> shift).astype(np.int64), (mix(tokens) >> shift).astype(np.int64)

    def add(self, tokens: np.ndarray) -> None:
        for row, at in enumerate(self._cells(tokens)):
            np.add.at(self.counts[row], at, np.uint32(1))

    def levels(self, tokens: np.ndarray) -> np.ndarray:
        """Logarithms of the estimated frequencies, without what an average cell holds of other tokens."""
        a, b = self._cells(tokens)
        return np.log2(np.maximum(np.minimum(self.counts[0][a], self.counts[1][b]) - self.noise, 1)).astype(np.int8)


def _added(total: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Sum of counts that stops at the largest value."""
    return np.minimum(total.astype(np.uint64) + more, 2**32 - 1).astype(np.uint32)


class Seen:
    """Digests met in this task, the latest ones; a digest that is forgotten only costs time."""

    def __init__(self, most: int = 100_000):
        self.most, self.now, self.before = most, set(), set()

    def new(self, digest: int) -> bool:
        if digest in self.now or digest in self.before:
            return False
        if len(self.now) >= self.most:
            self.now, self.before = set(), self.now
        self.now.add(digest)
        return True


_PROFILE = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("bitmap", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])


def _profiles(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """One scan: (doc, key, node, n, bitmap) of each row and, as rows with a ``part``, the parts of each task's sketch."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen, pack = Sketch(bits), Seen(), zstandard.ZstdCompressor(level=1)
        some_rows = False
        for some in batches(rows(found, "doc", "text", "key"), lambda r: len(r[1])):
            sets = TokenSets([r[1] for r in some], n)
            nodes = sets.digests()
            fresh = np.fromiter((seen.new(x) for x in nodes.tolist()), bool, len(some)) & (sets.sizes > 0)
            sketch.add(sets.tokens[np.repeat(fresh, sets.sizes)])
            some_rows |= bool(fresh.any())
            k = len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in some], pa.int64()), pa.array([r[2] for r in some], pa.int64()), pa.array(nodes), pa.array(sets.sizes), pa.array(sets.bitmaps(), pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                schema=_PROFILE,
            )
        if some_rows:
            packed = [pack.compress(p.tobytes()) for p in sketch.counts.reshape(_SKETCH_PARTS, -1)]
            none = [pa.nulls(_SKETCH_PARTS, f.type) for f in _PROFILE][:5]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(_SKETCH_PARTS), pa.int32()), pa.array(packed, pa.binary())], schema=_PROFILE)

    return docs.mapInArrow(run, "doc long, key long, node long, n long, bitmap binary, part int, counts binary")


def _sum_sketch(profiles: DataFrame, bits: int) -> np.ndarray:
    """The sum of all tasks' sketches: of fixed size, so the driver can hold it."""
    width = (2 << bits) // _SKETCH_PARTS

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack, total = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1), {}
        for part, counts in rows(found, "part", "counts"):
            more = np.frombuffer(unpack.decompress(counts), np.uint32)
            total[part] = _added(total[part], more) if part in total else more
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([pack.compress(x.tobytes()) for x in total.values()], pa.binary())], names=["part", "counts"])

    out = np.zeros((_SKETCH_PARTS, width), np.uint32)
    unpack = zstandard.ZstdDecompressor()
    parts = profiles.where("part is not null").select("part", "counts")
    for r in parts.repartition("part").mapInArrow(run, "part int, counts binary").collect():
        out[r.part] = np.frombuffer(unpack.decompress(bytes(r.counts)), np.uint32)
    return out.reshape(2, -1)


def prefix_need(n: int, num: int, den: int) -> int:
    """So many tokens of a prefix must count, that every linked set shares one."""
    return n + (-n * num // den) + 1


def _groups(tier: int, num: int, den: int) -> dict[int, int]:
    """Number of groups of the classes k = 2 and k = 3 for sets of ``tier`` bits of size; none for sizes in which the unseen
    tokens of all groups could be all that two linked sets share."""
    need = prefix_need(1 << tier, num, den)
    out = {2: max(1, need // 4), 3: max(1, need // 3)}
    unseen = sum((k - 1) * groups for k, groups in out.items())
    return out if unseen * den * den < (1 << (tier - 1)) * num * num else {}


def signatures(s: np.ndarray, level: np.ndarray, num: int, den: int, rare_level: int = 5, triple_level: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index entries of one set (single tokens even, combinations odd), the place of each in the order, and its level."""
    n = len(s)
    assert 2 * num > den, "a similarity of one half or less needs other groups"
    need = prefix_need(n, num, den)
    order = np.argsort(level, kind="stable")
    rare = int((level < rare_level).sum())
    alone = order[: min(rare, need)]
    if rare >= need:
        return s[alone] & ~_U(1), np.arange(need), level[alone]
    out, places, levels = [s[alone] & ~_U(1)], [np.arange(rare)], [level[alone]]
    rest, rest_level = s[order[rare:]], level[order[rare:]]
    for tier in {n.bit_length(), (n * den // num).bit_length(), (-(-n * num // den)).bit_length()}:
        groups = _groups(tier, num, den)
        if not groups:
            more = min(need - rare, len(rest))
            out.append(rest[:more] & ~_U(1))
            places.append(np.arange(rare, rare + more))
            levels.append(rest_level[:more])
            continue
        k = np.where(rest_level >= triple_level, 3, 2)
        of = (mix(rest ^ _SEED) % np.where(k == 3, groups[3], groups[2]).astype(_U)).astype(np.int64) * 4 + k
        members: dict[int, list[int]] = {}
        left = need - rare
        for at, g in enumerate(of.tolist()):
            own = members.setdefault(g, [])
            own.append(at)
            left -= len(own) >= (g & 3)
            if not left:
                break
        for g, own in members.items():
            at = np.array(own)
            at = at[np.argsort(rest[at])]
            label = np.array([tier], _U)
            i, j = np.triu_indices(len(at), 1)
            pairs = pair(rest[at[i]], rest[at[j]])
            low = np.minimum(rest_level[at[i]], rest_level[at[j]])
            if g & 3 == 3:
                first, third = np.nonzero(j[:, None] < np.arange(len(at))[None, :])
                pairs = pair(pairs[first], rest[at[third]])
                low = np.minimum(low[first], rest_level[at[third]])
            out.append(pair(pairs, np.broadcast_to(label, pairs.shape)) | _U(1))
            places.append(np.full(len(pairs), rare))
            levels.append(low)
    return np.concatenate(out), np.concatenate(places), np.concatenate(levels)


_ENTRY = pa.schema([("entry", pa.int64()), ("chunk", pa.int32()), ("node", pa.int64()), ("packed", pa.int64())])


def _entries(docs: DataFrame, n: int, num: int, den: int, rare_level: int, triple_level: int, bits: int, sketch) -> DataFrame:
    """Index entries (entry, chunk, node, packed) of all sets.  ``packed`` holds the size of the set and the place of the
    entry; ``chunk`` the number of chunks of the entry, then that of this row."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = Sketch(bits, sketch.value), Seen()
        for some in batches(rows(found, "text"), lambda r: len(r[0])):
            sets = TokenSets([r[0] for r in some], n)
            level = counts.levels(sets.tokens)
            own, where, levels, nodes, sizes = [], [], [], [], []
            for j, node in enumerate(sets.digests().tolist()):
                if sets.sizes[j] and seen.new(node):
                    entry, place, low = signatures(sets[j], level[sets.first[j] : sets.first[j + 1]], num, den, rare_level, triple_level)
                    own.append(entry)
                    where.append(place + (int(sets.sizes[j]) << 31))
                    levels.append(low)
                    nodes.append(node)
                    sizes.append(len(entry))
            if own:
                node = np.repeat(np.array(nodes, np.int64), sizes)
                chunks = np.minimum(-(-(1 << np.concatenate(levels).astype(np.int64)) // _CHUNK), 1 << 14).astype(np.int64)
                chunk = (chunks << 16) | (mix(node.view(_U)) % chunks.astype(_U)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array(chunk.astype(np.int32)), pa.array(node), pa.array(np.concatenate(where))], schema=_ENTRY)

    return docs.select("text").mapInArrow(run, "entry long, chunk int, node long, packed long")


def whole_groups(found: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``; memory holds one batch and the group at its end."""
    held: list[pa.RecordBatch] = []
    for batch in found:
        if not batch.num_rows:
            continue
        last = {k: batch.column(batch.schema.get_field_index(k))[-1].as_py() for k in keys}
        other = np.zeros(batch.num_rows, bool)
        for k in keys:
            other |= batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) != last[k]
        start = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if start or held and any(held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() != last[k] for k in keys):
            yield pa.Table.from_batches([*held, *([batch.slice(0, start)] if start else [])])
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in sorted keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _index(entries: DataFrame) -> DataFrame:
    """Entries of two nodes or more: (entry, chunk, node, packed, leader, members), the last two of the chunk."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(found, ("entry", "chunk")):
            entry, chunk, node, packed = _columns(table, "entry", "chunk", "node", "packed")
            once = _starts(entry, chunk, node)
            entry, chunk, node, packed = entry[once], chunk[once], node[once], packed[once]
            first = _starts(entry, chunk)
            size = np.diff(np.append(first, len(entry)))
            keep = np.repeat((size > 1) | (chunk[first] >> 16 > 1), size)
            if not keep.any():
                continue
            group = np.repeat(np.arange(len(first)), size)
            best = np.lexsort((mix(node.view(_U)), packed & _LOW, group))[first]
            out = [entry, chunk, node, packed, np.repeat(node[best], size), np.repeat(size, size)]
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in out], names=["entry", "chunk", "node", "packed", "leader", "members"])

    return entries.repartition("entry", "chunk").sortWithinPartitions("entry", "chunk", "node").mapInArrow(run, "entry long, chunk int, node long, packed long, leader long, members long")


def _may(n_a: np.ndarray, place_a: np.ndarray, n_b: np.ndarray, place_b: np.ndarray, single: np.ndarray, num: int, den: int) -> np.ndarray:
    """Bounds on length and, for single tokens that may be the first two sets share, on what follows their places."""
    most = np.where(single, np.minimum(n_a - place_a, n_b - place_b), np.minimum(n_a, n_b))
    return (num + den) * most >= num * (n_a + n_b)


def _short_pairs(short: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of one short entry that pass the bounds."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(found, ("entry",)):
            entry, node, packed = _columns(table, "entry", "node", "packed")
            n, place = packed >> 31, packed & _LOW
            first = _starts(entry)
            end = np.repeat(np.append(first[1:], len(entry)), np.diff(np.append(first, len(entry))))
            at = np.arange(len(entry))
            out = []
            for step in range(1, int((end - at).max())):
                i = at[at + step < end]
                j = i + step
                ok = _may(n[i], place[i], n[j], place[j], entry[i] & 1 == 0, num, den)
                out.append((np.minimum(node[i], node[j])[ok], np.maximum(node[i], node[j])[ok]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b"])

    return short.repartition("entry").sortWithinPartitions("entry").mapInArrow(run, "a long, b long")


def _folded(bitmaps: list[bytes], size: int) -> np.ndarray:
    """Parity bitmaps as rows of 64-bit words, folded to ``size`` bytes."""
    out = np.frombuffer(b"".join(bitmaps), np.uint64).reshape(len(bitmaps), -1)
    while out.shape[1] * 8 > size:
        half = out.shape[1] // 2
        out = out[:, :half] ^ out[:, half:]
    return out


class Block:
    """Nodes of one entry in the order of their sizes, with components and bitmaps, to be compared with one another."""

    def __init__(self, node: np.ndarray, component: np.ndarray, side: np.ndarray, bitmaps: list[bytes]):
        n = np.fromiter((int.from_bytes(b[:4], "little") for b in bitmaps), np.int64, len(bitmaps))
        order = np.argsort(n, kind="stable")
        self.node, self.component, self.side, self.n = node[order], component[order], side[order], n[order]
        self.bitmaps = [bitmaps[k][4:] for k in order.tolist()]

    def candidates(self, num: int, den: int, strip: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places i < j of pairs of different components and, in a block of two chunks, of different chunks, that pass the
        bitmaps, with their least difference."""
        length = np.fromiter((len(b) for b in self.bitmaps), np.int64, len(self.bitmaps))
        two = bool((self.side != self.side[0]).any())
        for size in np.unique(length).tolist():
            own = np.flatnonzero(length == size)
            other = np.flatnonzero((length == size) | (length == 2 * size))
            left = _folded([self.bitmaps[k] for k in own.tolist()], size)
            right = np.concatenate([left, _folded([self.bitmaps[k] for k in np.flatnonzero(length == 2 * size).tolist()], size)]) if len(other) > len(own) else left
            for a in range(0, len(own), strip):
                i = own[a : a + strip]
                end = int(np.searchsorted(self.n[other], self.n[i[-1]] * den // num, "right"))
                j, words = other[a:end], right[a:end]
                if not len(j):
                    continue
                wide = max(1, 4_000_000 // max(1, len(i) * words.shape[1]))
                for b in range(0, len(j), wide):
                    part = j[b : b + wide]
                    differ = np.bitwise_count(left[a : a + strip, None, :] ^ words[None, b : b + wide, :]).sum(2, dtype=np.int64)
                    ok = (den + num) * differ <= (den - num) * (self.n[i][:, None] + self.n[part][None, :])
                    ok &= (i[:, None] < part[None, :]) & (self.component[i][:, None] != self.component[part][None, :])
                    if two:
                        ok &= self.side[i][:, None] != self.side[part][None, :]
                    x, y = np.nonzero(ok)
                    if len(x):
                        yield i[x], part[y], differ[x, y]


def forest(i: np.ndarray, j: np.ndarray, component: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Which candidates a forest over the components takes, the nearest first."""
    _, name = np.unique(component, return_inverse=True)
    parent = list(range(int(name.max()) + 1))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    taken = []
    for k in np.argsort(distance, kind="stable").tolist():
        a, b = find(name[i[k]]), find(name[j[k]])
        if a != b:
            parent[a] = b
            taken.append(k)
    return np.array(taken, np.int64)


def _blocks(long_rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(one, two) of block keys whose nodes are to be compared, and (key, node) of the keys.

    A block holds the nodes of one chunk.  Entries of near copies have much the same nodes: where all nodes under a
    leader are at most twice those of its largest chunk, its chunks are one block, which holds every pair of each of them.
    """
    under = scratch.written(long_rows.groupBy("leader", "node").agg(F.max("members").alias("members")), "under")
    merged = scratch.written(under.groupBy("leader").agg(F.count(F.lit(1)).alias("nodes"), F.max("members").alias("largest")).where("nodes <= 2 * largest").select("leader"), "leaders")
    own = F.col("chunk").bitwiseAND(F.lit(0xFFFF)).alias("own")
    # leaders meet the nodes and the chunks under them apart: in a group of near copies each node has many entries.
    # Not a semi join: that would be moved below the distinct
    together = long_rows.select("entry", own, "leader").distinct().join(merged, "leader").select("entry", "own", F.col("leader").alias("key"))
    alone = long_rows.join(merged, "leader", "left_anti").select("entry", own, "node").withColumn("key", F.xxhash64("entry", "own"))
    chunks = scratch.written(together.unionByName(alone.select("entry", "own", "key")).distinct(), "chunks")
    whole = under.join(merged, "leader").select(F.col("leader").alias("key"), "node")
    members = scratch.written(whole.unionByName(alone.select("key", "node")).distinct(), "members")
    other = chunks.select("entry", F.col("own").alias("next"), F.col("key").alias("two"))
    cross = chunks.join(other, "entry").where("own <= next").select(F.least("key", "two").alias("one"), F.greatest("key", "two").alias("two")).distinct()
    out = scratch.written(cross, "cross"), members
    scratch.drop("under", "leaders", "chunks")
    return out


def _long_pairs(cross: DataFrame, members: DataFrame, component: DataFrame, nodes: DataFrame, num: int, den: int, nearest: bool) -> DataFrame:
    """Candidates (a, b) across components of long entries: all of them, or of each block a forest of the nearest."""
    named = members.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ends = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    one = ends.select(F.col("key").alias("one"), "low", "high")
    two = ends.select(F.col("key").alias("two"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    wanted = cross.join(one, "one").join(two, "two").where("least(low, low2) <> greatest(high, high2)").select("one", "two")
    sides = wanted.select("one", "two", F.lit(0).alias("side"), F.col("one").alias("key")).unionByName(wanted.where("one <> two").select("one", "two", F.lit(1).alias("side"), F.col("two").alias("key")))
    dealt = sides.join(named, "key").select("one", "two", "side", "node", "component").join(nodes.select("node", "bitmap"), "node")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(found, ("one", "two")):
            one, two, node, component, side = _columns(table, "one", "two", "node", "component", "side")
            first = _starts(one, two).tolist()
            bitmaps = table.column("bitmap").to_pylist()
            for a, b in zip(first, [*first[1:], len(one)], strict=True):
                block = Block(node[a:b], component[a:b], side[a:b], bitmaps[a:b])
                for i, j, differ in _kept(block, num, den, nearest):
                    x, y = block.node[i], block.node[j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return dealt.repartition("one", "two").sortWithinPartitions("one", "two").mapInArrow(run, "a long, b long")


def _kept(block: Block, num: int, den: int, nearest: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The candidates of a block; of the nearest, what a forest keeps is merged strip by strip, so memory stays bounded."""
    held = None
    for got in block.candidates(num, den):
        if not nearest:
            yield got
            continue
        held = got if held is None else tuple(np.concatenate(x) for x in zip(held, got, strict=True))
        if len(held[0]) > 200_000:
            held = tuple(x[forest(held[0], held[1], block.component, held[2] / (block.n[held[0]] + block.n[held[1]]))] for x in held)
    if held is not None:
        yield tuple(x[forest(held[0], held[1], block.component, held[2] / (block.n[held[0]] + block.n[held[1]]))] for x in held)


def _met(pairs: DataFrame, loads: DataFrame, compare: Callable[[list[bytes]], list], judge: Callable[[object, object], bool], block: int = 128) -> DataFrame:
    """The pairs (a, b) for which ``judge`` holds on the loads (node, load) of both.  A load of ``a`` is sent once for
    ``block`` partners; ``compare`` makes what is judged of some loads."""
    degree = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    salted = pairs.join(degree, "a").select("a", F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("degree") / block))).alias("salt"), "b")
    left = salted.groupBy("a", "salt").agg(F.lit(None).cast("long").alias("b")).join(loads.withColumnRenamed("node", "a"), "a").select("a", "salt", "b", "load")
    right = salted.join(loads.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "load")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for some in batches(rows(found, "a", "salt", "b", "load"), lambda r: len(r[3]), 1_000_000):
            out: list[tuple[int, int]] = []
            for (a, salt, b, _), made in zip(some, compare([r[3] for r in some]), strict=True):
                if b is None:
                    key, own = (a, salt), made
                    continue
                assert key == (a, salt)
                if judge(own, made):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b); a component's name is its smallest node.

    Every round takes the smallest name among neighbours and jumps to that name's own name; names are tables in the
    shared folder, and the driver gets one number a round.
    """
    both = scratch.written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    names = scratch.written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("name")), "names")
    while True:
        near = both.join(names.select(F.col("a").alias("b"), "name"), "b").groupBy("a").agg(F.min("name").alias("near"))
        step = names.join(near, "a").select("a", F.least("name", "near").alias("next"), "name")
        jumped = step.join(names.select(F.col("a").alias("next"), F.col("name").alias("far")), "next", "left").select("a", F.least("next", F.coalesce("far", "next")).alias("name"), F.col("name").alias("old"))
        new = scratch.written(jumped, "names")
        if new.where("name <> old").isEmpty():
            return new.select(F.col("a").alias("node"), F.col("name").alias("component"))
        names = new.drop("old")


class Join:
    """One run of the join: its tables and thresholds."""

    def __init__(self, docs: DataFrame, scratch: Scratch, n: int, num: int, den: int):
        self.docs, self.scratch, self.n, self.num, self.den = docs, scratch, n, num, den
        self.spark = docs.sparkSession

    def near(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs whose bitmaps leave a link possible."""
        num, den = self.num, self.den

        def judge(x: Parity, y: Parity) -> bool:
            return x[0] * den >= y[0] * num and y[0] * den >= x[0] * num and can_link(x[0], y[0], least_difference(x, y), num, den)

        return _met(pairs, nodes.select("node", F.col("bitmap").alias("load")), lambda loads: [parity(x) for x in loads], judge)

    def texts(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """(node, load) with the compressed text of each node of ``pairs``.  A filter of fixed size keeps most texts that
        are not wanted from crossing the network."""
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        hashed = F.xxhash64("doc", "key").alias("hash")
        wanted = self.scratch.written(nodes.select("node", "doc", "key").join(ends, "node").select("node", "doc", "key", hashed), "wanted")
        bloom = Bloom(wanted, "hash", _BLOOM_BITS)

        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pack = zstandard.ZstdCompressor(level=1)
            for b in found:
                b = b.filter(pa.array(bloom.has(b.column(3).to_numpy())))
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack.compress(t) for (t,) in rows([b], "text")], pa.binary())], names=["doc", "key", "load"])

        sent = self.docs.select("doc", "key", "text", hashed).mapInArrow(run, "doc long, key long, load binary")
        return self.scratch.written(sent.join(wanted, ["doc", "key"]).dropDuplicates(["node"]).select("node", "load"), "texts")

    def links(self, pairs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
        """The pairs that are links."""
        n, num, den = self.n, self.num, self.den
        near = self.scratch.written(self.near(pairs, nodes), "near")
        texts = self.texts(near, nodes)

        def compare(loads: list[bytes]) -> list[np.ndarray]:
            unpack, out = zstandard.ZstdDecompressor(), []
            for some in batches(((unpack.decompress(x),) for x in loads), lambda r: len(r[0])):
                sets = TokenSets([r[0] for r in some], n)
                out += [sets[j] for j in range(len(some))]
            return out

        def judge(x: np.ndarray, y: np.ndarray) -> bool:
            both = np.concatenate((x, y))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            return den * common >= num * (len(x) + len(y) - common)

        found = self.scratch.written(_met(near, texts, compare, judge), name)
        self.scratch.drop("near", "texts", "wanted")
        return found


def jaccard_components(
    docs: DataFrame,
    n: int = 5,
    num: int = 80,
    den: int = 100,
    rare_level: int = 5,
    triple_level: int = 10,
    sketch_bits: int = 20,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per document: (doc_id, n_shingles, component_id) of the graph that links sets with a similarity of num/den or more.

    ``rare_level``, ``triple_level``: tokens estimated in at least ``2 ** level`` sets are indexed by pairs, by triples.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    source = in_small_batches(docs).select(F.col(id_column).cast("long").alias("doc"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    profiles = scratch.written(_profiles(source, n, sketch_bits), "profiles")
    known = profiles.where("part is null").select("doc", "key", "node", "n")
    some = profiles.where("part is null and doc is not null and n > 0")
    sketch = spark.sparkContext.broadcast(_sum_sketch(profiles, sketch_bits))
    valid = source.where("doc is not null")
    index = scratch.written(_index(_entries(valid, n, num, den, rare_level, triple_level, sketch_bits, sketch)), "index")
    indexed = index.select("node").distinct()
    nodes = scratch.written(some.join(indexed, "node", "left_semi").groupBy("node").agg(F.min("doc").alias("doc"), F.min_by("key", "doc").alias("key"), F.first("bitmap").alias("bitmap")), "nodes")
    # rows that share an id are one document: their nodes are linked too
    shared = some.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc", "a")
    found = scratch.written(shared.join(some.select("doc", F.col("node").alias("b")), "doc").where("a <> b").select("a", "b"), "shared")
    join = Join(valid, scratch, n, num, den)

    long_entry = F.expr(f"members > {_SHORT} or shiftright(chunk, 16) > 1")
    short = _short_pairs(index.where(~long_entry).select("entry", "node", "packed"), num, den)
    long_rows = scratch.written(index.where(long_entry).select("entry", "chunk", "node", "leader", "members"), "long")
    best = long_rows.where("leader <> node").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("times")).groupBy("node").agg(F.max_by("leader", F.struct("times", "leader")).alias("leader"))
    stars = best.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"))
    found = found.unionByName(join.links(scratch.written(short.unionByName(stars).distinct(), "pairs"), nodes, "by_pairs"))
    component = connected_components(found, scratch)
    cross, members = _blocks(long_rows, scratch)
    for nearest in (True, False):
        pairs = scratch.written(_long_pairs(cross, members, component, nodes, num, den, nearest).distinct(), "pairs")
        if pairs.isEmpty():
            break
        more = join.links(pairs, nodes, f"by_blocks_{nearest}")
        if not more.isEmpty():
            found = found.unionByName(more)
            component = connected_components(found, scratch)

    first = some.groupBy("node").agg(F.min("doc").alias("doc"))
    smallest = component.join(first, "node").groupBy("component").agg(F.min("doc").alias("smallest"))
    label = first.join(component.join(smallest, "component").select("node", "smallest"), "node", "left")
    label = scratch.written(label.select("node", F.least("doc", F.coalesce("smallest", "doc")).alias("label")), "labels")
    scratch.drop("index", "nodes", "long", "cross", "members", "pairs", "edges", "names", "shared", "by_pairs", "by_blocks_True", "by_blocks_False")
    return known.join(label, "node", "left").select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.coalesce("label", "doc")).alias("component_id"),
    )
