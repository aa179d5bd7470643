"""Exact removal of repeated word sequences by compaction of a de Bruijn graph.

The windows of ``k`` consecutive words are the edges of a de Bruijn graph whose nodes are sequences of ``k - 1`` words.

1. *Local compaction.*  Every window has an anchor, its leftmost smallest ``m``-word hash.  A maximal run of windows of
   a document around one anchor is a path of edges and goes out as one row: (anchor, digest of the whole path, source
   coordinate, number of edges).  There is about one row to nine words.  Equal windows have equal anchors at equal
   offsets, so whatever repeats meets again under its anchor.
2. *Repeated paths.*  One aggregation by anchor, combined before the shuffle, gives the number of paths, whether all
   are equal and the first source coordinate.  Paths under an anchor seen once cannot repeat; a filter of fixed size keeps
   most of them from being sent again.  Where all paths of an
   anchor are equal, the path does not branch: every occurrence but the first repeats the first as a whole.  Where they
   differ, the graph branches; these paths are split into single edges again, which are compared one by one.
3. *Compaction through joins.*  Paths and edges are joined with their first occurrence and so carry the coordinate of
   their source.  A piece continues another when it follows it in its document *and* its source follows the other's
   source; each chain of such pieces becomes one long repeated span, which its source coordinates verify.
4. *Removal.*  Words covered by a span are removed; spans are judged on the input, not on what is left.

Windows are compared by two 64-bit digests together (anchor and window), coordinates by document id and place.

Hot sequences: aggregations combine before they shuffle.  Their results are written as tables, so that the joins with them
have no aggregate on the join key below them: only then may adaptive execution split a hot anchor or edge over tasks.
No group is ever gathered.  Texts cross the network twice, compressed: once for documents with branching paths, once
for the result.

Defined results: a null text has no words; documents shorter than ``k`` words stay whole; ids that are null come after
all others; rows that share an id share its coordinates: equal windows at equal places of them are not earlier than
one another, places removed in one are removed in each, and each row is returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.arrow import in_small_batches, rows
from loomwork.llm.bloom import Bloom
from loomwork.llm.scratch import written
from loomwork.llm.wordhash import Words, batches, ngrams, pair

LAST_ID = 2**63 - 1
_BLOOM_BITS = 27
_U = np.uint64


def sources(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id to order by, digest that tells apart rows of one id, and text."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return in_small_batches(docs).select(F.coalesce(F.col(id_column).cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))


def _anchors(h: np.ndarray, k: int, m: int) -> np.ndarray:
    """For each window of k words the place of its leftmost smallest m-word hash."""
    value = ngrams(h, m)
    place = np.arange(len(value))
    width, size = k - m + 1, 1
    steps = []
    while size < width:
        step = min(size, width - size)
        steps.append(step)
        size += step
    for step in steps:
        a, b = value[:-step], value[step:]
        right = b < a
        place = np.where(right, place[step:], place[:-step])
        value = np.where(right, b, a)
    return place


class Windows:
    """Windows of k words of a batch, their anchors and the paths around the anchors."""

    def __init__(self, texts: list[bytes], k: int, m: int):
        self.words = w = Words(texts)
        n = len(w.hashes)
        if n < k:
            self.at = self.hash = self.anchor = np.zeros(0, np.int64)
            self.doc = np.zeros(0, np.int64)
            return
        doc = w.doc_of()
        ok = doc[: n - k + 1] == doc[k - 1 :]
        self.at = np.flatnonzero(ok)
        self.doc = doc[self.at]
        self.hash = ngrams(w.hashes, k)[self.at]
        place = _anchors(w.hashes, k, m)[self.at]
        self.place = place
        self.anchor = ngrams(w.hashes, m)[place]

    def paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First window of each path, its number of windows, its anchor and its digest."""
        if not len(self.at):
            z = np.zeros(0, np.int64)
            return z, z, z.astype(_U), z.astype(_U)
        new = np.ones(len(self.at), bool)
        new[1:] = (self.place[1:] != self.place[:-1]) | (self.at[1:] != self.at[:-1] + 1)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(self.at)))
        digest = pair(pair(self.hash[first], self.hash[first + size - 1]), size.astype(_U))
        return first, size, self.anchor[first], digest


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(_U).view(np.int64)


def _paths_of(docs: DataFrame, k: int, m: int, with_digest: bool, among: Bloom | None = None) -> DataFrame:
    """The paths of all documents, of those alone whose anchor may be ``among`` the wanted ones."""
    schema = "anchor long, doc long, start int, edges int" + ", path long" * with_digest

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches(rows(parts, "doc", "text"), lambda r: len(r[1])):
            w = Windows([r[1] for r in some], k, m)
            first, size, anchor, digest = w.paths()
            if among and len(first):
                wanted = among.has(_signed(anchor))
                first, size, anchor, digest = first[wanted], size[wanted], anchor[wanted], digest[wanted]
            if not len(first):
                continue
            ids = np.fromiter((r[0] for r in some), np.int64, len(some))
            of = w.doc[first]
            start = w.at[first] - w.words.first[of]
            out = [pa.array(_signed(anchor)), pa.array(ids[of]), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))]
            names = ["anchor", "doc", "start", "edges"]
            if with_digest:
                out.append(pa.array(_signed(digest)))
                names.append("path")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select("doc", "text").mapInArrow(run, schema)


class Coordinates:
    """Packs (doc, start) into one long where ids and places allow it, so that minima are taken over longs."""

    def __init__(self, docs: DataFrame):
        got = docs.where(F.col("doc") != LAST_ID).agg(F.min("doc"), F.max("doc")).first()
        self.low = got[0] or 0
        self.packs = (got[1] or 0) - self.low < 2**31 - 2

    def pack(self, doc: str = "doc", start: str = "start"):
        if not self.packs:
            return F.struct(F.col(doc).alias("doc"), F.col(start).cast("long").alias("start"))
        base = F.when(F.col(doc) == LAST_ID, F.lit(2**31 - 1).cast("long")).otherwise(F.col(doc) - self.low)
        return base * F.lit(2**32).cast("long") + F.col(start).cast("long")

    def doc(self, at: str):
        if not self.packs:
            return F.col(f"{at}.doc")
        high = F.shiftright(at, 32)
        return F.when(high == 2**31 - 1, F.lit(LAST_ID)).otherwise(high + self.low)

    def start(self, at: str):
        return F.col(f"{at}.start") if not self.packs else F.col(at).bitwiseAND(F.lit(2**32 - 1).cast("long"))


def repeated_pieces(docs: DataFrame, k: int = 20, m: int = 5) -> DataFrame:
    """Pieces (doc, start, edges) that repeat an earlier sequence, with its coordinate (source_doc, source_start)."""
    coordinates = Coordinates(docs)
    at = coordinates.pack()
    seen = written(
        _paths_of(docs, k, m, True)
        .groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("low"), F.max("path").alias("high"), F.min(at).alias("source"))
        .where("n > 1")
        .select("anchor", (F.col("low") == F.col("high")).alias("pure"), "source"),
        "anchors",
    )
    found = written(
        _paths_of(docs, k, m, False, Bloom(seen, "anchor", _BLOOM_BITS)).join(seen, "anchor").select("anchor", "doc", "start", "edges", "pure", "source").where(~F.col("pure") | (at != F.col("source"))),
        "paths",
    )
    pure = found.where("pure").select("doc", "start", "edges", coordinates.doc("source").alias("source_doc"), coordinates.start("source").alias("source_start"))
    branching = found.where("not pure").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "edges"))).alias("places"))
    edges = _edges(written(_compressed(docs).join(branching, "doc").select("doc", "packed", "places"), "branching"), k, m)
    first = written(edges.groupBy("edge", "anchor").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("source")).where("n > 1").drop("n"), "edges")
    single = (
        edges.join(first, ["edge", "anchor"])
        .where(at != F.col("source"))
        .select("doc", "start", F.lit(1).alias("edges"), coordinates.doc("source").alias("source_doc"), coordinates.start("source").alias("source_start"))
    )
    return pure.unionByName(single)


def _compressed(docs: DataFrame, carried: str | None = None) -> DataFrame:
    """Texts compressed before they cross the network, beside ``carried`` as it is."""
    more = [carried] if carried else []

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in parts:
            texts = [pack.compress(t) for (t,) in rows([b], "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.binary()), *b.columns[3:]], names=["doc", "row", "packed", *more])

    schema = "doc long, row long, packed binary" + "".join(f", {c} {dict(docs.dtypes)[c]}" for c in more)
    return docs.select("doc", "row", "text", *more).mapInArrow(run, schema)


def _edges(texts: DataFrame, k: int, m: int) -> DataFrame:
    """The single edges of the places of each document, at their coordinates."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        source = ((doc, unpack.decompress(packed), places) for doc, packed, places in rows(parts, "doc", "packed", "places"))
        for some in batches(source, lambda r: len(r[1])):
            w = Windows([r[1] for r in some], k, m)
            wanted = np.zeros(len(w.words.hashes) + 1, bool)
            for j, (_, _, places) in enumerate(some):
                base, end = w.words.first[j], w.words.last[j]
                for p in {(p["start"], p["edges"]) for p in places}:
                    wanted[min(base + p[0], end) : min(base + p[0] + p[1], end)] = True
            keep = np.flatnonzero(wanted[w.at])
            if not len(keep):
                continue
            ids = np.fromiter((r[0] for r in some), np.int64, len(some))
            of = w.doc[keep]
            start = (w.at[keep] - w.words.first[of]).astype(np.int32)
            out = [pa.array(_signed(w.hash[keep])), pa.array(_signed(w.anchor[keep])), pa.array(ids[of]), pa.array(start)]
            yield pa.RecordBatch.from_arrays(out, names=["edge", "anchor", "doc", "start"])

    return texts.select("doc", "packed", "places").mapInArrow(run, "edge long, anchor long, doc long, start int")


def compacted_spans(pieces: DataFrame, k: int = 20) -> DataFrame:
    """Chains of pieces joined to long repeated spans of words: (doc, start, length, source_doc, source_start).

    A chain is what follows one another both in the document and in its source; a document's pieces are dealt out once,
    by the document, for all steps up to the result.
    """
    shift = F.col("start") - F.col("source_start")
    here = pieces.repartition("doc").select("doc", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("edges")).alias("end"), "source_doc", shift.alias("shift"))
    chain = Window.partitionBy("doc", "source_doc", "shift").orderBy("start")
    reach = F.max("end").over(chain.rowsBetween(Window.unboundedPreceding, -1))
    marked = here.withColumn("head", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    numbered = marked.withColumn("number", F.sum("head").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc", "source_doc", "shift", "number").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(
        "doc",
        F.col("start").cast("int").alias("start"),
        (F.col("end") - F.col("start") + (k - 1)).cast("int").alias("length"),
        "source_doc",
        (F.col("start") - F.col("shift")).cast("int").alias("source_start"),
    )


RowOf = Callable[[int | None, bytes, np.ndarray, list[bytes] | None], tuple]


def remove_spans(texts: DataFrame, spans: DataFrame, schema: str, row_of: RowOf, carried: str | None = None) -> DataFrame:
    """Applies ``row_of(doc, text, mask of removed words, kept words)`` to each document.

    ``texts`` has doc, row and packed; ``carried`` names a column of it that is passed on as it is.
    """
    per_doc = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]
    columns = ["doc", "packed", "spans"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in parts:
            out: list[tuple] = []
            for doc, packed, found in rows([batch], *columns):
                text = unpack.decompress(packed)
                words = text.split()
                gone = np.zeros(len(words), bool)
                for s in found or ():
                    gone[s["start"] : s["start"] + s["length"]] = True
                kept = [words[i] for i in np.flatnonzero(~gone).tolist()] if gone.any() else words
                out.append(row_of(None if doc == LAST_ID else doc, text, gone, kept))
            arrays = [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * len(types), types, strict=True)]
            if carried:
                arrays.append(batch.column(batch.schema.get_field_index(carried)))
            yield pa.RecordBatch.from_arrays(arrays, names=names + ([carried] if carried else []))

    joined = texts.join(per_doc, "doc", "left").select(*columns, *([carried] if carried else []))
    if carried:
        schema += f", {carried} {dict(texts.dtypes)[carried]}"
    return joined.mapInArrow(run, schema)


def deduplicate_substrings(docs: DataFrame, k: int = 20, m: int = 5) -> DataFrame:
    """Per document: words, removed words, digest of the kept words joined by one space, and the kept text itself."""
    source = sources(docs)
    spans = compacted_spans(repeated_pieces(source, k, m), k)

    def row_of(doc: int, text: bytes, gone: np.ndarray, kept: list[bytes]) -> tuple:
        joined = b" ".join(kept)
        return doc, len(gone), int(gone.sum()), hashlib.sha256(joined).hexdigest()

    return remove_spans(_compressed(source), spans, "doc_id long, n_words long, n_removed long, kept_sha256 string", row_of)


def deduplicated_texts(docs: DataFrame, k: int = 20, m: int = 5) -> DataFrame:
    """The documents with repeated words removed, with all their columns; ``n_chars``, where there is one, is counted anew.

    A text that loses words becomes its kept words joined by one space; another stays as it is (null stays null).
    """
    source = sources(docs)
    spans = compacted_spans(repeated_pieces(source, k, m), k)
    others = [c for c in docs.columns if c != "text"]
    carried = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.struct(*others, F.col("text").isNull().alias("_none")).alias("others"),
    )

    def row_of(doc: int, text: bytes, gone: np.ndarray, kept: list[bytes]) -> tuple:
        return (b" ".join(kept).decode() if gone.any() else text.decode(),)

    done = remove_spans(_compressed(carried, "others"), spans, "text string", row_of, "others")
    text = F.when(~F.col("others._none"), F.col("text"))
    return done.select(*[text.alias(c) if c == "text" else F.length(text).cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(f"others.`{c}`").alias(c) for c in docs.columns])
