"""Hierarchical multi-length packing of token ids into training sequences.

*Routing.*  Tiers are context sizes, powers of two up to the longest.  Whole windows of the longest tier are cut from a
document first; what remains, or the whole of a shorter document, waits in the tier whose window just holds it.

*Packing.*  When many pieces wait in a tier, the tier is packed into windows of its own size.  A window begins with the
longest piece of its tier; the gap that this leaves takes the largest waiting piece that fits, from the tier itself and then
from the shorter ones; when nothing fits, a waiting piece is cut, and what is left of it waits in the tier of its new
length.  So windows are full, and at the end of a task the last pieces are cut at powers of two: nothing is padded.

*Step groups.*  A step holds windows of one tier.  The windows of a tier are dealt out in rounds, one to each of ``groups`` open
groups: of a round the window with the greatest attention cost (sum of squared lengths of its pieces) goes to the group with the
least so far.  A set of groups is closed when each holds ``step_tokens``.  Hence the groups of a set have equally many
tokens, and their costs differ by no more than the windows of one round do.

Every task packs its own documents, so no shuffle is needed; memory holds the ids of a batch of documents, a bounded
number of waiting pieces per tier and one round of windows.  ``sequence_id`` is the task's number and a counter, the same when a
task is run again.

Defined results: a null text is empty and yields the end id alone; a null id is kept as null; repeated rows are packed
once each; a very long text is encoded at once and cut into windows; an empty table yields no piece; columns other than the id
and the text are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.arrow import in_small_batches, rows
from loomwork.llm.vocab import tokenizer_path

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])

END_TEXT = b"<|endoftext|>"
_BLANK = bytes(0x20 if k < 0x21 else k for k in range(256))
#: White space beyond ASCII: next line, no-break space, ogham space, general punctuation, mathematical and ideographic space.
_WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def _spaced(text: bytes) -> bool:
    """Whether white space stands beside white space, at a limit of the text or beyond ASCII."""
    flat = text.translate(_BLANK)
    return flat[:1] == b" " or flat[-1:] == b" " or b"  " in flat or any(w in text for w in _WIDE)


class ByteLevelEncoder:
    """Ids of a byte-level BPE, whole texts cut at single spaces between two characters that are not white space.

    The pattern that splits a text before merging always starts a new piece at such a space, so the parts can be
    encoded alone; ids of parts seen before come from a bounded memory.
    """

    def __init__(self, ranks_path: str, pattern: str, end_id: int, most: int = 100_000):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(max(ranks.values()) + 1, bool)
        self.opens[[i for b, i in ranks.items() if b[:1] == b" "]] = True
        self.end = np.array([end_id], "<u4").tobytes()
        self.most, self.known, self.before = most, {}, {}

    def _plain(self, text: str) -> bytes:
        return np.asarray(self.model.encode_ordinary(text), "<u4").tobytes()

    def _learn(self, parts: set[bytes]) -> None:
        """Keeps the ids of each part after a space.  Two generations bound the memory."""
        if len(self.known) > self.most:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        new = []
        for p in parts.difference(known):
            if p in before:
                known[p] = before[p]
            elif b" " in p:
                known[p] = self._plain(" " + p.decode())
            else:
                new.append(p)
        if new:
            ids = np.asarray(self.model.encode_ordinary((b" " + b" ".join(new)).decode()), "<u4")
            cuts = np.append(np.flatnonzero(self.opens[ids]), len(ids)) * 4
            all_ids, at = ids.tobytes(), cuts.tolist()
            known.update(zip(new, [all_ids[a:b] for a, b in zip(at, at[1:], strict=False)], strict=True))

    def _ordinary(self, text: bytes) -> bytes:
        if not text:
            return b""
        if _spaced(text):
            parts = [p.encode() for p in _SAFE_CUT.split(text.decode())]
        else:
            parts = text.split(b" ")
        rest = parts[1:]
        known = self.known
        try:
            return self._plain(parts[0].decode()) + b"".join([known[p] for p in rest])
        except KeyError:
            self._learn(set(rest))
        known = self.known
        return self._plain(parts[0].decode()) + b"".join([known[p] for p in rest])

    def __call__(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; the end string in a text is its special id."""
        if END_TEXT in text:
            return self.end.join(self._ordinary(x) for x in text.split(END_TEXT))
        return self._ordinary(text)


_encoders: dict[tuple, ByteLevelEncoder] = {}


def byte_encoder(name: str = "byte_bpe_50k", end_id: int = 50256, folder: str | None = None) -> ByteLevelEncoder:
    """One encoder for a Python worker, kept between tasks."""
    key = (name, end_id, folder)
    if key not in _encoders:
        from public_tokenizers import PATTERN

        _encoders[key] = ByteLevelEncoder(tokenizer_path(f"{name}.tiktoken", folder), PATTERN, end_id)
    return _encoders[key]


Piece = tuple[object, int, bytes, int]  # document, start, ids, tokens of the document


class Packer:
    """Packs pieces into windows of the tiers' sizes.  ``emit`` gets the pieces of a window and its tier."""

    def __init__(self, longest: int, emit: Callable[[list[Piece], int], None], shortest: int = 64, waiting: int = 1024):
        assert longest & (longest - 1) == 0
        self.longest, self.emit, self.waiting = longest, emit, waiting
        self.tiers = [1 << k for k in range(shortest.bit_length() - 1, longest.bit_length())]
        self.pools: dict[int, list[tuple[int, int, Piece]]] = {t: [] for t in self.tiers}
        self.count = 0

    def add(self, doc: object, ids: bytes, total: int) -> None:
        full = self.longest * 4
        at = 0
        while len(ids) - at >= full:
            self.emit([(doc, at // 4, ids[at : at + full], total)], self.longest)
            at += full
        if at < len(ids):
            tier = self._wait((doc, at // 4, ids[at:], total))
            if len(self.pools[tier]) >= self.waiting:
                while len(self.pools[tier]) > self.waiting // 2:
                    self._window(tier)

    def _wait(self, piece: Piece) -> int:
        """Routes a piece to the tier whose window just holds it."""
        n = len(piece[2]) // 4
        tier = self.tiers[bisect_left(self.tiers, n)]
        self.count += 1
        insort(self.pools[tier], (n, self.count, piece))
        return tier

    def _take(self, room: int) -> Piece | None:
        """The largest waiting piece of at most ``room`` ids."""
        for tier in self.tiers[bisect_left(self.tiers, room) :: -1] if room <= self.longest else ():
            pool = self.pools[tier]
            if pool and pool[0][0] <= room:
                return pool.pop(bisect_right(pool, (room, self.count + 1)) - 1)[2]
        return None

    def _cut(self, room: int) -> Piece | None:
        """The first ``room`` ids of a waiting piece that has more, of the shortest tier there is."""
        for tier in self.tiers:
            if self.pools[tier]:
                _, _, (doc, start, ids, total) = self.pools[tier].pop()
                self._wait((doc, start + room, ids[room * 4 :], total))
                return doc, start, ids[: room * 4], total
        return None

    def _window(self, tier: int) -> None:
        """Packs one window of a tier in which a piece waits."""
        window = [self.pools[tier].pop()[2]]
        room = tier - len(window[0][2]) // 4
        while room and (piece := self._take(room) or self._cut(room)):
            window.append(piece)
            room -= len(piece[2]) // 4
        if room:
            self._tail(window)
        else:
            self.emit(window, tier)

    def _tail(self, window: list[Piece]) -> None:
        """Pieces that don't fill a window, cut into windows of powers of two."""
        total = sum(len(p[2]) for p in window) // 4
        while total:
            size = 1 << (total.bit_length() - 1)
            out, room = [], size
            while room:
                doc, start, ids, n = window[0]
                if (k := len(ids) // 4) <= room:
                    out.append(window.pop(0))
                    room -= k
                else:
                    out.append((doc, start, ids[: room * 4], n))
                    window[0] = (doc, start + room, ids[room * 4 :], n)
                    room = 0
            self.emit(out, size)
            total -= size

    def close(self) -> None:
        for tier in reversed(self.tiers):
            while self.pools[tier]:
                self._window(tier)


def cost(window: list[Piece]) -> int:
    """Attention within the pieces of a window: the sum of their squared lengths."""
    return sum((len(p[2]) // 4) ** 2 for p in window)


class StepGroups:
    """Deals windows of each tier to step groups.  ``emit`` gets the window, its tier and the number of its group."""

    def __init__(self, emit: Callable[[list[Piece], int, int], None], groups: int, step_tokens: int):
        self.emit, self.groups, self.step_tokens = emit, max(1, groups), step_tokens
        self.rounds: dict[int, list[list[Piece]]] = {}
        self.loads: dict[int, list[list[int]]] = {}  # of each tier: cost, number and windows of its open groups
        self.count = 0

    def add(self, window: list[Piece], tier: int) -> None:
        waiting = self.rounds.setdefault(tier, [])
        waiting.append(window)
        if len(waiting) == self.groups:
            self._deal(tier)

    def _deal(self, tier: int) -> None:
        if not self.loads.get(tier):
            self.loads[tier] = [[0, self.count + k, 0] for k in range(self.groups)]
            self.count += self.groups
        open_groups = sorted(self.loads[tier])
        for group, window in zip(open_groups, sorted(self.rounds[tier], key=cost, reverse=True), strict=False):
            group[0] += cost(window)
            group[2] += 1
            self.emit(window, tier, group[1])
        self.rounds[tier] = []
        if max(g[2] for g in open_groups) * tier >= self.step_tokens:
            self.loads[tier] = []

    def close(self) -> None:
        for tier in sorted(self.rounds):
            if self.rounds[tier]:
                self._deal(tier)


def pack_documents(docs: DataFrame, longest: int = 1024, groups: int = 8, step_tokens: int = 65536, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """Pieces of all documents: ids by the tokenizer, then id 0, in sequences of at most ``longest`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = byte_encoder(tokenizer, folder=folder)
        task = TaskContext.get().partitionId() << 32
        zero = bytes(4)
        out: list[list[int]] = []
        sequences = count()

        def emit(pieces: list[Piece], tier: int, group: int) -> None:
            number, offset = task + next(sequences), 0
            for doc, start, ids, total in pieces:
                n = len(ids) // 4
                out.append([doc, start, n, zlib.crc32(ids), total, number, offset, tier, task + group])
                offset += n

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ARROW)

        steps = StepGroups(emit, groups, step_tokens)
        packer = Packer(longest, steps.add)
        for doc, text in rows(batches, "doc_id", "text"):
            ids = encode(text) + zero
            packer.add(doc, ids, len(ids) // 4)
            if len(out) > 20_000:
                yield flush()
        packer.close()
        steps.close()
        if out:
            yield flush()

    return in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
