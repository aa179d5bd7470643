"""The pipeline against a brute-force version of all its stages."""

import re
from collections import Counter

import corpus_pipeline
from loomwork.llm import queries
from tests.llm import fixtures as X
from tests.llm.test_documents import _measures, library


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t in X.texts() if i is not None]
    X.table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter()
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[p.doc_id] += p.length
    good = []
    for i, t in rows:
        n, chars, symbols, _, repeated = _measures(t)
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if x.split()]
        capitals = sum(len(x) > 1 and x == x.upper() != x.lower() for x in w)
        letterless = sum(not re.search(r"[^\W\d_]", x) for x in w)
        bad = n < 50 or 100 * repeated > 50 * n or 100 * symbols > 5 * chars or 2 * (len(lines) - len(set(lines))) > len(lines) or 2 * capitals > n or 2 * letterless > n or chars > 100 * n
        if not bad:
            good.append((i, t))
    groups = X.components(good, 5, 80, 100)
    first = [(i, t) for i, t in good if groups[i] == i]
    t = library("byte_bpe_50k.json")
    expected = Counter()
    for (i, text), (_, w, gone) in zip(first, X.removed_words(first), strict=True):
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode() if any(gone) else text
        expected[i] += len(t.encode(kept, add_special_tokens=False).ids) + 1
    assert got == expected


def test_every_stage_takes_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, X.table(spark, []), "").count() == 0


def test_queries_are_registered():
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} <= {q.split("_")[0] for q in queries.QUERIES}
