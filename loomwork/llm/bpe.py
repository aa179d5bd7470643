"""BPE encoding and decoding by forced-boundary splitting.

A pair of adjacent bytes that occurs inside no token of the vocabulary can never be merged across, so every such pair
is a certain cut: the fragments between cuts are encoded independently and their ids are concatenated.  The cuts are
found at two levels.  White space is dropped before merging and so occurs inside no token: a text is first cut there.
After normalisation, each remaining word is cut again at every byte pair that the table of inner pairs lacks; only
its last fragment carries the end-of-word suffix.

Fragments and words seen before come from a bounded memory, so that a corpus costs about one look-up a word.
Decoding maps ids back to the tokenizer's token strings and joins them as the library does.

Defined results: a null text is empty (no ids, empty decoded text); repeated rows are encoded once each; null ids are
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.arrow import in_small_batches, rows
from loomwork.llm.vocab import tokenizer_path


def inner_pairs(vocabulary: dict[str, int], suffix: str) -> set[str]:
    """All pairs of adjacent characters (each stands for a byte) inside a token, the suffix aside."""
    found: set[str] = set()
    for token in vocabulary:
        body = token.removesuffix(suffix) if suffix else token
        found.update(map("".join, zip(body, body[1:], strict=False)))
    return found


class ForcedBoundaryTokenizer:
    """Encodes and decodes as the ``tokenizers`` library does with the same file and no special tokens added."""

    def __init__(self, path: str, most: int = 250_000):
        from tokenizers import Tokenizer, pre_tokenizers
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.whole = Tokenizer.from_file(path)
        self.suffix = model["end_of_word_suffix"] or ""
        self.pairs = inner_pairs(model["vocab"], self.suffix)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.models = {False: Tokenizer(BPE(model["vocab"], merges)), True: Tokenizer(BPE(model["vocab"], merges, end_of_word_suffix=self.suffix or None))}
        for m in self.models.values():
            m.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.specials = [t["content"].encode() for t in spec["added_tokens"]]
        self.most = most
        self.fragments: dict[tuple[str, bool], bytes] = {}
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        names = {**{t["id"]: t["content"] for t in spec["added_tokens"]}, **{i: t for t, i in model["vocab"].items()}}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]

    def cut(self, word: str) -> list[str]:
        """The fragments of a word between its forced boundaries."""
        pairs, out, at = self.pairs, [], 0
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in pairs:
                out.append(word[at:k])
                at = k
        out.append(word[at:])
        return out

    def _merge(self, wanted: set[tuple[str, bool]]) -> dict[tuple[str, bool], bytes]:
        """Ids of fragments, each encoded by itself: a batch goes to the model as one text, cut at spaces."""
        if len(self.fragments) > self.most:
            self.fragments = {}
        got = self.fragments
        for last, model in self.models.items():
            new = [f for f, x in wanted if x == last and (f, x) not in got]
            if new:
                coded = model.encode(" ".join(new), add_special_tokens=False)
                ids, of = np.asarray(coded.ids, "<u4").tobytes(), np.asarray(coded.word_ids)
                at = (np.searchsorted(of, np.arange(len(new) + 1)) * 4).tolist()
                got.update({(f, last): ids[i:j] for f, i, j in zip(new, at, at[1:], strict=False)})
        return got

    def _pieces(self, words: list[str]) -> list[list[str]]:
        """The pieces of each word after normalisation, in the vocabulary's characters for bytes."""
        whole = self.whole
        text = whole.normalizer.normalize_str(" ".join(words))
        if any(len(w.split()) != 1 for w in words) or text.count(" ") != len(words) - 1:  # white space beyond ASCII
            return [[p for p, _ in whole.pre_tokenizer.pre_tokenize_str(whole.normalizer.normalize_str(w))] for w in words]
        out: list[list[str]] = [[] for _ in words]
        ends = np.cumsum([len(w) + 1 for w in text.split(" ")]).tolist()
        k = 0
        for piece, (start, _) in whole.pre_tokenizer.pre_tokenize_str(text):
            while start >= ends[k]:
                k += 1
            out[k].append(piece)
        return out

    def _learn(self, words: list[bytes]) -> None:
        """Keeps the ids of runs without white space."""
        special = [w for w in words if any(s in w for s in self.specials)]
        for w in special:
            self.known[w] = np.asarray(self.whole.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        plain = [w for w in words if w not in set(special)] if special else words
        if not plain:
            return
        parts = []
        for pieces in self._pieces([w.decode() for w in plain]):
            own = []
            for p in pieces:
                cuts = self.cut(p)
                own += [(c, False) for c in cuts[:-1]]
                own.append((cuts[-1], True))
            parts.append(own)
        got = self._merge({f for own in parts for f in own})
        self.known.update({w: b"".join([got[f] for f in own]) for w, own in zip(plain, parts, strict=True)})

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words = text.split()
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > self.most:
                self.known, self.before = {}, known
            known, before = self.known, self.before
            new = []
            for w in set(words).difference(known):
                if w in before:
                    known[w] = before[w]
                else:
                    new.append(w)
            self._learn(new)
        return b"".join([known[w] for w in words])

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8: without a decoder, token strings are joined by a space."""
        names = self.names
        return b" ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])


_tokenizers: dict[str, ForcedBoundaryTokenizer] = {}


def forced_boundary_tokenizer(name: str, folder: str | None = None) -> ForcedBoundaryTokenizer:
    path = tokenizer_path(name, folder)
    if path not in _tokenizers:
        _tokenizers[path] = ForcedBoundaryTokenizer(path)
    return _tokenizers[path]


def encode_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", folder: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Per document: number of ids, digests of the ids and of the decoded text and, on demand, ids and text themselves."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = forced_boundary_tokenizer(tokenizer, folder)
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for doc, text in rows(batches, "doc_id", "text"):
            ids = model.encode(text)
            decoded = model.decode(ids)
            row = (doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
            out.append(row + ((np.frombuffer(ids, "<i4").tolist(), decoded.decode()) if keep_ids else ()))
            if len(out) >= 2000:
                yield flush()
        if out:
            yield flush()

    return in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
