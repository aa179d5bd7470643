"""Operators on documents against brute force, with nulls, repeated rows, clashing columns and empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomwork.llm import license_scan, license_texts, multiset_hash, ngram_join, packing, quality, substring_dedup
from loomwork.llm.scratch import Scratch
from loomwork.llm.bpe import encode_documents, forced_boundary_tokenizer
from loomwork.llm.vocab import tokenizer_path
from tests.llm import fixtures as X

ORDER = lambda r: repr(r)


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def test_license_scan_equals_brute_force(spark):
    rows = X.texts() + [(70, "Under the MIT license! under the mit license; Apache License, Version 2.0 (cc-by-nc)"), (71, "underthe mit license under the MIT")]
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan_licenses(X.table(spark, rows)).collect()}
    phrases = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
    expected = set()
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        found = [(k, label) for p, label in phrases for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in found]
        expected.add((i, len(w), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))))
    assert got == expected
    assert license_scan.scan_licenses(X.table(spark, [])).count() == 0


def test_license_templates_have_optional_and_replaceable_regions():
    a = license_scan.Automaton([license_scan.Template("x", "one <<optional>> two <<optional>> three <<end>> <<end>> four <<var 1-2>> five")])
    ends = lambda text: [m[2] for m in a.matches(text.encode().split())]
    assert ends("one four x five") == [4] and ends("one two four x y five") == [6] and ends("one two three four z five") == [6]
    assert ends("one three four x five") == [] and ends("one four five") == [] and ends("one four a b c five") == []
    with pytest.raises(ValueError):
        license_scan.Automaton([license_scan.Template("x", "<<optional>> a <<end>>")])


def _pattern(markup):
    """A template as a regular expression over words that each end with a space."""
    out = []
    for x in re.findall(r"<<optional>>|<<end>>|<<var \d+-\d+>>|[^\s<]+", markup):
        if x == "<<optional>>":
            out.append("(?:")
        elif x == "<<end>>":
            out.append(")?")
        elif x.startswith("<<var"):
            a, b = re.findall(r"\d+", x)
            out.append(f"(?:\\S+ ){{{a},{b}}}")
        else:
            out += [w.decode() + " " for w in license_scan.words_of(x.encode())]
    return re.compile("".join(out))


def test_whole_licenses_are_accepted():
    a = license_scan.Automaton(license_scan.TEMPLATES)
    for label, markup in (("mit", license_texts.MIT), ("bsd-2-clause", license_texts.BSD_2), ("bsd-3-clause", license_texts.BSD_3), ("isc", license_texts.ISC), ("0bsd", license_texts.ZERO_BSD), ("apache-2", license_texts.APACHE_NOTICE), ("unlicense", license_texts.UNLICENSE), ("zlib", license_texts.ZLIB)):
        plain = re.sub(r"<<var (\d+)-\d+>>", "the holder", re.sub(r"<<optional>>[^<]*<<end>>", "", re.sub(r"<<optional>>[^<]*<<end>>", "", markup.replace("<<var 0-30>>", "2020 Some One").replace("<<var 1-1>>", "2"))))
        plain = re.sub(r"<<\w+>>", "", plain)
        got = license_scan.scan(plain.encode(), a)
        assert (got["accepted"], got["labels"], got["score"]) == (label, label, 1.0), (label, got["labels"], got["score"])
        changed = license_scan.scan(re.sub("(?i)software", "hardware", plain, count=1).encode(), a)
        assert changed["accepted"] == "", label
        with_head = license_scan.scan(("prose before " + plain).encode(), a)
        assert label in with_head["labels"].split(",") and with_head["accepted"] == ""


@pytest.mark.parametrize(("text", "labels"), [
    ("Creative Commons Attribution ShareAlike 4.0 International License", "cc-by-sa"),
    ("Creative Commons Attribution NoDerivs License", "cc-by-nd"),
    ("Creative Commons Attribution 4.0 International License", "cc-by"),
    ("Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License", "cc-by-nc-sa"),
    ("GNU Lesser General Public License", "lgpl"),
    ("GNU Affero General Public License version 3", "agpl"),
    ("the GNU General Public License", "gpl"),
    ("Copyright (c) 1983, 1990 The Regents of the University of California. All rights reserved.", "all-rights-reserved"),
])
def test_labels_of_notices(text, labels):
    assert license_scan.scan(text.encode(), license_scan.Automaton(license_scan.TEMPLATES))["labels"] == labels


def test_labels_and_score_equal_a_search_by_regular_expressions():
    import random

    r = random.Random(1)
    automaton = license_scan.Automaton(license_scan.TEMPLATES)
    patterns = [_pattern(t.markup) for t in license_scan.TEMPLATES]
    short = [t.markup for t in license_scan.TEMPLATES if len(t.markup) < 300]
    for _ in range(60):
        parts = [re.sub(r"<<[^>]*>>", lambda m: r.choice(["", "x", "3"]), r.choice(short)) if r.random() < 0.5 else " ".join(r.choices(["the", "mit", "copyright", "license", "gnu", "prose", "2"], k=5)) for _ in range(8)]
        words = license_scan.words_of(" ".join(parts).encode())
        line = b" ".join(words).decode() + " "
        starts = [0, *[m.end() for m in re.finditer(" ", line)]]
        found = []
        for k, p in enumerate(patterns):
            for i, at in enumerate(starts[:-1]):
                ends = [j for j in range(i + 1, len(starts)) if p.fullmatch(line, at, starts[j])]
                found += [(k, i, max(ends))] if ends else []
        inner = lambda x: any(y[1] <= x[1] and x[2] <= y[2] and (y[1], y[2]) != (x[1], x[2]) for y in found if not license_scan.TEMPLATES[y[0]].base)
        kept = [x for x in found if license_scan.TEMPLATES[x[0]].base or not inner(x)]
        got = license_scan.scan(" ".join(parts).encode(), automaton)
        assert got["labels"] == ",".join(sorted({license_scan.TEMPLATES[k].label for k, _, _ in kept}))
        covered = {p for _, i, e in kept for p in range(i, e)}
        assert got["score"] == len(covered) / len(words)


def test_substring_dedup_equals_brute_force(spark):
    rows = X.texts()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.deduplicate_substrings(X.table(spark)).collect()), key=ORDER)
    expected = []
    for i, w, gone in X.removed_words(rows):
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(expected, key=ORDER) and any(r[2] for r in got)
    assert substring_dedup.deduplicate_substrings(X.table(spark, [])).count() == 0


def test_spans_carry_verified_sources(spark):
    rows = [(i, t) for i, t in X.texts() if i is not None and i < 50]
    source = substring_dedup.sources(X.table(spark, rows))
    words = {i: (t or "").split() for i, t in rows}
    spans = substring_dedup.compacted_spans(substring_dedup.repeated_pieces(source)).collect()
    assert spans and max(s.length for s in spans) > 40
    for s in spans:
        assert words[s.doc][s.start : s.start + s.length] == words[s.source_doc][s.source_start : s.source_start + s.length]
        assert (s.source_doc, s.source_start) < (s.doc, s.start)


def test_coordinates_beyond_packing_give_the_same(spark):
    rows = [(i * 10**12 - 5 * 10**12, t) for i, t in X.texts() if i is not None]
    got = {(r.doc_id, r.n_removed) for r in substring_dedup.deduplicate_substrings(X.table(spark, rows)).collect()}
    assert got == {(i, sum(gone)) for i, _, gone in X.removed_words(rows)}


def test_deduplicated_texts_keep_columns(spark):
    rows = X.texts()
    got = substring_dedup.deduplicated_texts(X.table(spark))
    assert got.columns == X.table(spark).columns
    expected = Counter()
    for (i, t), (_, w, gone) in zip(rows, X.removed_words(rows), strict=True):
        expected[i, " ".join(x.decode() for x, g in zip(w, gone, strict=True) if not g) if any(gone) else t, "en", 7, 8] += 1
    assert Counter((r.doc_id, r.text, r.lang, r.doc, r.node) for r in got.collect()) == expected


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80), (2, 60)])
def test_jaccard_components_equal_all_pairs(spark, n, num):
    rows = X.texts()
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(X.table(spark), n, num, 100, sketch_bits=12).collect())
    by_id = X.components(rows, n, num, 100)
    assert got == Counter((i, len(X.shingles(t, n)), by_id.get(i)) for i, t in rows)


def test_jaccard_with_combinations_of_frequent_tokens(spark):
    import random

    r = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(X.table(spark, rows), 4, 85, 100, rare_level=2, triple_level=4, sketch_bits=16).collect()}
    assert got == X.components(rows, 4, 85, 100)


def test_prefixes_of_linked_sets_share_an_entry():
    r = np.random.default_rng(2)
    linked = 0
    for k in range(600):
        num = (85, 80, 60)[k % 3]
        a = np.unique(r.integers(0, 2**63, int(r.integers(1, 300 if k % 2 else 12))).astype(np.uint64))
        keep = a[r.random(len(a)) > 0.06]
        b = np.unique(np.concatenate((keep, r.integers(0, 2**63, int(r.integers(0, 4))).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < num * (len(a) + len(b) - both):
            continue
        linked += 1
        for often in (lambda s: s % np.uint64(3) * 6, lambda s: s % np.uint64(2) * 11, lambda s: s * np.uint64(0) + np.uint64(12)):
            entries = [ngram_join.signatures(s, often(s).astype(np.int8), num, 100)[0] for s in (a, b)]
            assert np.array_equal(a, b) or np.intersect1d(*entries).size
    assert linked > 200


def test_parity_bitmaps_never_exceed_the_difference():
    r = np.random.default_rng(3)
    for _ in range(100):
        texts = [" ".join(f"w{x}" for x in r.integers(0, 60, int(r.integers(4, 400)))).encode() for _ in range(2)]
        sets = ngram_join.TokenSets(texts, 2)
        x, y = (ngram_join.parity(m) for m in sets.bitmaps())
        assert ngram_join.least_difference(x, y) <= len(np.setxor1d(sets[0], sets[1]))


def test_long_entries_in_chunks_and_blocks(spark, monkeypatch):
    """Groups without a hub, entries dealt to many chunks, pairs that only blocks can find."""
    import random

    monkeypatch.setattr(ngram_join, "_SHORT", 4)
    monkeypatch.setattr(ngram_join, "_CHUNK", 8)
    r = random.Random(7)
    rows = []
    for g in range(4):
        w = [f"g{g}w{k}" for k in range(120)]
        for i in range(40):
            w = list(w)
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            rows.append((100 * g + i, " ".join(w)))
    got = {x.doc_id: x.component_id for x in ngram_join.jaccard_components(X.table(spark, rows), 4, 85, 100, rare_level=2, triple_level=4, sketch_bits=16).collect()}
    assert got == X.components(rows, 4, 85, 100) and len(set(got.values())) < 160


def test_blocks_need_no_row_for_each_node_and_entry(spark):
    """One group of 60 nodes that share 40 entries, and two entries whose leader has more nodes than twice a chunk's."""
    group = [(e, 1 << 16, node, 1, 60) for e in range(40) for node in range(1, 61)]
    apart = [(100 + e, 1 << 16, node, 500, 5) for e in range(4) for node in range(500 + 5 * e, 505 + 5 * e)]
    table = spark.createDataFrame(group + apart, "entry long, chunk int, node long, leader long, members long")
    written = []

    class Counted(Scratch):
        def written(self, df, name):
            out = super().written(df, name)
            written.append((name, out.count()))
            return out

    cross, members = ngram_join._blocks(table, Counted(spark))
    assert max(n for _, n in written) < 200, written
    held = {}
    for r in members.collect():
        held.setdefault(r.key, set()).add(r.node)
    assert held[1] == set(range(1, 61)) and sorted(map(sorted, held.values()))[1:] == [list(range(500 + 5 * e, 505 + 5 * e)) for e in range(4)]
    assert {(r.one, r.two) for r in cross.collect()} == {(k, k) for k in held}


def test_texts_of_one_id_are_verified_each_with_its_own(spark):
    words = lambda i, k: [f"w{i}x{k}n{j}" for j in range(60)]
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = []
    for i in range(12):
        x, y = words(i, 0), words(i, 1)
        rows += [(10 * i + 3, " ".join(x)), (10 * i + 3, " ".join(y)), (10 * i + 5, near(x)), (10 * i + 7, near(y))]
    got = {(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(X.table(spark, rows), 4, 85, 100, sketch_bits=12).collect()}
    assert got == {(10 * i + k, 10 * i + 3) for i in range(12) for k in (3, 5, 7)}


def test_empty_table_has_no_components(spark):
    assert ngram_join.jaccard_components(X.table(spark, []), 4, 85, 100, sketch_bits=10).count() == 0


def test_fingerprints_and_edits(spark):
    rows = X.texts()
    got = multiset_hash.fingerprint_edits(X.table(spark)).collect()
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    expected = Counter()
    for k, (i, t) in enumerate(ordered):
        h = len(t) // 2
        edited = t[: len(t) - h] + ordered[(k + 1) % len(ordered)][1][:h]
        expected[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == expected
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert multiset_hash.fingerprint_edits(X.table(spark, [])).count() == 0
    alone = multiset_hash.fingerprint_edits(X.table(spark, [(9, "ab\ncd")])).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"ab\nab").hexdigest()


def test_fingerprints_ignore_order_and_change_with_paragraphs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a\nb\nb", "b\na\nb", "a\nb", "b")], "x string, y string, z string, p string").select(*[multiset_hash.fingerprint(c).alias(c) for c in "xyzp"])
    r = df.select("x", "y", "z", multiset_hash.combined("z", "p").alias("sum"), multiset_hash.combined("x", "p", -1).alias("less"), multiset_hash.likeness("x", "y").alias("same"), F.length("x").alias("n")).first()
    assert r.x == r.y and r.x != r.z and r["sum"] == r.x and r.less == r.z and r.same == 1.0 and r.n == 8 + 128 + 256


def test_likeness_follows_common_paragraphs(spark):
    line = lambda k: f"paragraph number {k} of many"
    rows = [("\n".join(map(line, range(40))), "\n".join(map(line, range(40 - c, 80 - c)))) for c in (0, 20, 40)]
    df = spark.createDataFrame(rows, "x string, y string").select(multiset_hash.fingerprint("x").alias("x"), multiset_hash.fingerprint("y").alias("y"))
    none, half, whole = (r.l for r in df.select(multiset_hash.likeness("x", "y").alias("l")).collect())
    assert none < 0.1 < half < 0.8 and whole == 1.0


def test_encoding_and_decoding_equal_the_library(spark):
    rows = X.texts() + [(80, "<|startoftext|>It's 12x don'T <|endoftext|>"), (81, "日本語 テキスト!!🙂"), (82, "ΣΑΣ İ x̸ ̸a")]
    t = library("word_bpe_49k.json")
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_documents(X.table(spark, rows)).collect())
    expected = Counter()
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        expected[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == expected and encode_documents(X.table(spark, [])).count() == 0


def test_forced_boundaries_cut_where_no_token_does():
    m = forced_boundary_tokenizer("word_bpe_49k.json")
    parts = m.cut("zqxjkvwzzq")
    assert "".join(parts) == "zqxjkvwzzq" and all(a[-1] + b[0] not in m.pairs for a, b in zip(parts, parts[1:], strict=False))


def _measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    at = defaultdict(list)
    for k in range(len(w) - 2):
        at[tuple(w[k : k + 3])].append(k)
    covered = {k + d for v in at.values() if len(v) > 1 for k in v for d in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_equal_brute_force(spark):
    rows = X.texts() + [(90, "a#b $c <d> " * 30), (91, "x y\nx y\n\nx y\n z")]
    got = quality.judge_documents(X.table(spark, rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r.doc_id, *[r[n] for n in names]) for r in got) == Counter((i, *_measures(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality.judge_documents(X.table(spark, [])).count() == 0


def test_verdicts_do_not_depend_on_the_order_of_rules(spark):
    a = {(r.doc_id, r.kept) for r in quality.judge_documents(X.table(spark), quality.RULES, 5).collect()}
    b = {(r.doc_id, r.kept) for r in quality.judge_documents(X.table(spark), quality.RULES[::-1], 0).collect()}
    assert a == b
    kept = Counter(r.doc_id for r in quality.keep_documents(X.table(spark)).collect())
    assert kept == Counter(r.doc_id for r in quality.judge_documents(X.table(spark)).collect() if r.kept)
    assert quality.keep_documents(X.table(spark)).columns == X.table(spark).columns


def test_packing_is_exact_and_without_padding(spark):
    rows = X.texts() + [(95, " ".join(f"word{k}" for k in range(4000))), (96, "end <|endoftext|> more")]
    t = library("byte_bpe_50k.json")
    pieces = packing.pack_documents(X.table(spark, rows)).collect()
    tokens = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 0]) for i, x in rows]
    want = Counter((i, len(ids)) for i, ids in tokens)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append(p)
        by_sequence[p.sequence_id].append(p)
    for (i, n), own in by_doc.items():
        assert sum(p.length for p in own) == n * want[i, n]
    for i, ids in tokens:
        for p in by_doc[i, len(ids)]:
            same = [ids_ for j, ids_ in tokens if j == i and len(ids_) == p.doc_tokens]
            assert any(zlib.crc32(np.array(s[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for s in same)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack_documents(X.table(spark, [])).count() == 0


def test_tiers_are_packed_each_and_steps_are_balanced():
    import random

    r = random.Random(4)
    out = []
    steps = packing.StepGroups(lambda pieces, tier, group: out.append((tier, group, pieces)), 8, 8192)
    packer = packing.Packer(1024, steps.add, waiting=64)
    total = 0
    for doc in range(4000):
        n = int(2 ** r.uniform(0, 11.5))
        total += n
        packer.add(doc, bytes(4 * n), n)
    packer.close()
    steps.close()
    assert sum(len(p[2]) // 4 for _, _, w in out for p in w) == total
    tiers = Counter(t for t, _, _ in out)
    assert all(tiers[t] > 20 for t in (64, 128, 256, 512, 1024)) and all(sum(len(p[2]) // 4 for p in w) == t for t, _, w in out)
    # gaps of long windows hold pieces that were routed to shorter tiers
    assert any(t == 1024 and len(w) > 1 and min(len(p[2]) // 4 for p in w) <= 256 for t, _, w in out)
    groups = defaultdict(list)
    for t, g, w in out:
        groups[t, g // 8].append((g, packing.cost(w)))
    for (t, _), own in groups.items():
        counts, costs = Counter(g for g, _ in own), Counter()
        for g, c in own:
            costs[g] += c
        assert max(counts.values()) - min(counts.get(g, 0) for g in counts) <= 1
        if len(set(counts.values())) == 1 and len(counts) == 8:
            spread = max(c for _, c in own) - min(c for _, c in own)
            assert max(costs.values()) - min(costs.values()) <= spread


def test_packed_ids_equal_the_library_over_a_whole_table():
    import pyarrow.parquet as pq

    t, e = library("byte_bpe_50k.json"), packing.byte_encoder()
    for x in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist():
        assert np.frombuffer(e((x or "").encode()), "<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids


def test_byte_encoder_equals_the_library():
    t, e = library("byte_bpe_50k.json"), packing.byte_encoder()
    for x in ["", " ", "a  b\n\n c ", " lead", "tail ", "it's  don't\tx", "a b  c　d", "x <|endoftext|>y", "\x1ca b\x85c d"]:
        assert np.frombuffer(e(x.encode()), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_very_long_texts(spark):
    """Texts of 30,000 words, one an edited copy of the other, beside short ones."""
    import random

    r = random.Random(11)
    words = [f"v{r.randrange(9000)}" for _ in range(30_000)]
    edited = [*words[:15_000], "new", *words[15_000:29_000], *words[:60]]
    rows = [(1, " ".join(words)), (2, "\n".join(edited)), (3, " ".join(words[100:140])), (4, "x")]
    table = X.table(spark, rows).cache()
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.deduplicate_substrings(table).collect()}
    assert removed == {i: (len(w), sum(gone)) for i, w, gone in X.removed_words(rows)}
    joined = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(table, 4, 85, 100, sketch_bits=14).collect()}
    groups = X.components(rows, 4, 85, 100)
    assert joined == {i: (len(X.shingles(t, 4)), groups[i]) for i, t in rows} and groups[2] == 1
    measured = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge_documents(table).collect()}
    assert measured == {i: _measures(t) for i, t in rows}
    t = library("byte_bpe_50k.json")
    tokens = Counter()
    for p in packing.pack_documents(table).collect():
        tokens[p.doc_id] += p.length
    assert tokens == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in rows}
    t = library("word_bpe_49k.json")
    assert {r.doc_id: r.n_tokens for r in encode_documents(table).collect()} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in rows}
    assert {r.doc_id: r.n_words for r in license_scan.scan_licenses(table).collect()} == {i: len(x.split()) for i, x in rows}
    prints = {r.doc_id: r for r in multiset_hash.fingerprint_edits(table).collect()}
    assert {i: p.n_chars for i, p in prints.items()} == {i: len(x) for i, x in rows} and prints[1].near_next < 1.0


def test_stages_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    good = " ".join(f"word{k}" for k in range(80))
    rows = [(None, good), (None, good + " more"), (5, good), (5, good), (6, None)]
    docs = X.table(spark, rows)
    assert corpus_pipeline.quality(spark, docs, "").count() == 4
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert Counter(r.doc_id for r in kept) == {None: 2, 5: 2, 6: 1}
    cut = corpus_pipeline.substrings(spark, docs, "").collect()
    assert Counter(r.doc_id for r in cut) == {None: 2, 5: 2, 6: 1}
    assert Counter(p.doc_id for p in corpus_pipeline.packing(spark, docs, "").collect()).keys() == {None, 5, 6}
