"""Metrics, folds, layout, markup, data sets, sources and sinks on small tables."""

import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators import folds, graph, hybrid, knn, layout, markup, ranking, service
from loomwork.sources import readers, writers
from loomwork.streaming import ingest


def test_ranking_metrics(spark):
    run = spark.createDataFrame([("q1", d, i + 1) for i, d in enumerate(["d5", "d2", "d1"])], "qid string, did string, rank int")
    qrels = spark.createDataFrame([("q1", "d1"), ("q1", "d5")], "qid string, did string")
    got = {(r.metric, r.k): r.value for r in ranking.metrics(run, qrels).collect()}
    assert got["mrr", 1] == 1 and got["recall", 1] == 0.5 and got["recall", 3] == 1 and got["hit_rate", 1] == 1
    assert got["precision", 3] == pytest.approx(2 / 3, abs=1e-6) and got["ndcg", 3] == pytest.approx((1 + 0.5) / (1 + 1 / math.log2(3)), abs=1e-6)
    assert ranking.mean_average_precision(run, qrels).first().map == pytest.approx((1 + 2 / 3) / 2, abs=1e-6)


def _distances(spark, *lists):
    return spark.createDataFrame([(q, i + 1, d) for q, own in enumerate(lists) for i, d in enumerate(own)], "qid int, rank int, distance double")


def test_threshold_recall_over_queries(spark):
    """Two queries whose second true distances are 2 and 5: the run hits 2 of 2 and 1 of 2."""
    truth, run = _distances(spark, [1.0, 2.0, 3.0], [4.0, 5.0, 6.0]), _distances(spark, [1.5, 2.0, 2.5], [4.5, 5.5, 7.0])
    assert {r.qid: r.recall for r in ranking.threshold_recall(truth, run, 2).collect()} == {0: 1.0, 1: 0.5}


def test_relative_error_of_sums(spark):
    truth, run = _distances(spark, [1.0, 3.0], [2.0, 2.0]), _distances(spark, [1.0, 5.0], [3.0, 3.0])
    assert ranking.relative_error(truth, run).first().rel == pytest.approx(12 / 8, abs=1e-6)
    assert ranking.relative_error(truth, _distances(spark).limit(0)).first().rel == math.inf


def test_knn_ties_go_to_the_smaller_id(spark):
    e = spark.createDataFrame([(0, [1.0, 0.0]), (2, [0.0, 1.0]), (1, [0.0, 1.0]), (3, None)], "vec_id long, embedding array<float>")
    assert [r.did for r in knn.knn(e.where("vec_id = 0"), e, 5, "euclidean").orderBy("rank").collect()] == [1, 2]


def test_joined_paragraphs_carry_fragments(spark):
    f = spark.createDataFrame([("a", i, t) for i, t in enumerate(["one", "two.", "three.", "rest"])], "doc string, i int, t string")
    got = folds.joined_paragraphs(f, "doc", "i", "t", F.col("t").endswith(".")).orderBy("number").collect()
    assert [(r.text, r.whole) for r in got] == [("one two.", True), ("three.", True), ("rest", False)]


def test_merged_chapters(spark):
    rows = [(0, "DEFAULT", "A", ["x" * 10, "w"]), (1, "FIGURE", "F", ["no"]), (2, "INTRO", "I", ["own"]), (3, "DEFAULT", "B", ["y" * 600, "v"]), (4, "DEFAULT", "C", ["z"]), (5, "DEFAULT", None, [])]
    c = spark.createDataFrame([("a", *r) for r in rows], "d string, i int, k string, h string, t array<string>")
    got = [r.text for r in folds.merged_chapters(c, "d", "i", "k", "h", "t").orderBy("seq").collect()]
    assert got == ["## A\n\n" + "x" * 10 + "\nw\n\n## B\n\n" + "y" * 600 + " v", "## I\n\nown", "## C\n\nz\n\n## \n\n"]


BOXES = "page int, left int, top int, right int, bottom int"


def test_layout_of_pages(spark):
    """Golden pages of 800 x 1000, worked by hand; the slice is 390 to 410."""
    columns = [(40, 100, 380, 900), (420, 100, 760, 900)]
    boxes = {
        1: columns,
        2: [(40, 0, 760, 90), *columns],  # a wide title: the free part around the middle row 450 is 90 to 900, 90 <= 135
        3: [(40, 0, 760, 300), (40, 310, 380, 900), (420, 310, 760, 900)],  # wide above: a T
        4: [(40, 0, 380, 500), (420, 0, 760, 500), (40, 510, 760, 900)],  # wide below: an inverted T
        5: [(40, 0, 760, 900)],
        6: [(40, 100, 380, 900)],  # the right column is empty; the free part is all of it
        7: [(40, 0, 380, 400), (420, 0, 760, 400), (40, 410, 760, 500), (40, 510, 760, 900)],
    }
    e = spark.createDataFrame([(p, *b) for p, own in boxes.items() for b in own], BOXES)
    got = {}
    for r in layout.layout_of_pages(e, ["page"], 800, 1000).orderBy("page", "seq").collect():
        got.setdefault(r.page, []).append((r.layout, r.zone, r.left, r.top, r.right, r.bottom))
    pair = lambda name, top, bottom, a="LEFT", b="RIGHT": [(name, a, 0, top, 390, bottom), (name, b, 410, top, 800, bottom)]
    assert got[1] == pair("TWO_COLUMN", 100, 900) and got[2] == pair("TWO_COLUMN_BORDER", 90, 900) and got[6] == pair("TWO_COLUMN_BORDER", 100, 900)
    assert got[3] == [("T", "UP", 0, 0, 800, 300), *pair("T", 300, 900, "LEFT_LOW", "RIGHT_LOW")]
    assert got[4] == [*pair("INVERTED_T", 0, 510, "LEFT_UP", "RIGHT_UP"), ("INVERTED_T", "LOW", 0, 510, 800, 1000)]
    assert got[5] == [("DEFAULT", "DEFAULT", 0, 0, 800, 1000)] and got[7][0][0] == "INVERTED_T"


def test_junk_and_box_headers(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [
        ("Source: a b", "Text", True), (f"Source: {long}", "Text", False), (f"Notes and sources: {long}", "Text", True), ("Figure 3 | x of y", "Text", True),
        ("Figure 3 of all", "Text", False), ("Figure 3 of all", "Caption", True), ("Any caption here", "Caption", False), ("Photo: x", "Text", False), ("abc", "Text", True), ("page 7", "Page footer", True),
    ]
    df = spark.createDataFrame(rows, "t string, k string, junk boolean").select("junk", T.is_junk("t", "k").alias("got"), "t")
    assert [r.t for r in df.where("junk <> got").collect()] == []
    heads = spark.createDataFrame([("Box 1 | x", "Text", True), ("box 1 x", "Text", False), ("BOX", "Section header", True), ("A box 1 | x", "Text", False)], "t string, k string, head boolean")
    assert heads.where(T.is_box_header("t", F.col("k") == "Section header") != F.col("head")).count() == 0


def test_postprocessing_stops_after_references(spark):
    at = lambda k, side: (40, 50 * k, 380, 50 * k + 40) if side == "l" else (420, 50 * k, 760, 50 * k + 40)
    text = "seven words and one more are enough here"
    rows = [(1, 0, "Text", f"{text}.", at(0, "l")), (1, 1, "Text", f"hy- phen {text}", at(1, "l")), (1, 2, "Text", f"{text} right.", at(0, "r")), (1, 3, "Section header", "References", at(1, "r")), (1, 4, "Text", "Ref one", at(2, "r")),
            (2, 5, "Text", "Ref two", at(0, "l")), (2, 6, "Section header", "Annex", at(0, "r")), (2, 7, "Text", f"{text} never.", at(1, "r"))]
    e = spark.createDataFrame([("d", p, i, k, t, *b) for p, i, k, t, b in rows], "doc string, page int, index int, kind string, text string, left int, top int, right int, bottom int")
    zones = layout.layout_of_pages(e, ["doc", "page"], 800, 1000)
    paragraphs, references = layout.postprocessed(e, zones, "doc", 800, 1000)
    got = {(r.page, r.zone): (r.paragraphs, r.last_fragment) for r in paragraphs.collect()}
    assert got == {(1, "LEFT"): ([f"{text}."], f"hyphen {text}"), (1, "RIGHT"): ([f"{text} right."], None)}
    assert references.first().references == ["Ref one", "Ref two"]


def test_tei_fields():
    """Nameless authors are left out; an identifier is the DOI by its type only."""
    xml = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><titleStmt><title>On looms</title></titleStmt><author/><author><persName><surname>Weaver</surname></persName></author>
    <author><persName><forename>Ada</forename><surname>Thread</surname></persName></author><idno type="arXiv">2401.1</idno><idno type="DOI">10.5555/loom.7</idno></teiHeader>
    <text><body><div><head>Warp</head><p>first</p><p>second</p></div><div><p>alone</p></div></body></text></TEI>"""
    got = markup.parse_tei(xml)
    assert got["authors"] == ["Weaver", "Ada Thread"] and len(got["idnos"]) == 2 and got["doi"] == "10.5555/loom.7" and got["title"] == "On looms"
    assert got["sections"] == [{"head": "Warp", "text": "first second"}, {"head": None, "text": "alone"}] and markup.parse_tei("<open") is None and markup.parse_tei(None) is None


def test_tei_nodes(spark):
    df = spark.createDataFrame([(1, "<TEI><text><body><div><head>Discussion</head><p>x</p></div><div><p>y</p></div></body></text></TEI>"), (2, "bad")], "id int, xml string")
    nodes = markup.section_nodes(df.select("id", markup.tei_fields("xml").alias("tei")), "id")
    assert {(r.tag, r.text) for r in nodes.collect()} == {("Discussion", "x"), ("Unnamed Section", "y")}
    assert [r.text for r in markup.tag_filter(nodes).collect()] == ["x"]


def test_split_is_exact_and_disjoint(spark):
    got = service.split_by_hash(spark.range(101), "id", 0.8).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in got} == {"train": 80, "val": 21}


def test_synonyms_take_the_shortest_name(spark):
    v = spark.createDataFrame([("f", "red soil"), ("f", "soil red"), ("f", "forest")], "field string, item string")
    assert {r.item: r.canonical for r in graph.synonym_groups(v).collect()} == {"red soil": "red soil", "soil red": "red soil", "forest": "forest"}


def test_class_edges_stand_for_the_edges_of_all_nodes(spark):
    rows = [(i, f, x) for i in range(1, 31) for f, xs in (("a", "pq"[: 1 + i % 2]), ("b", "rst"[i % 3 :])) for x in xs if f == "a" or i % 5]
    items = spark.createDataFrame(rows, "id long, field string, item string")
    similar = graph.similar_items(graph.vocabulary(items), 0.9)
    every = {(r.source, r.target, r.score) for r in graph.overlap_edges(items.withColumn("ord", F.col("id")), similar, 0.24).collect()}
    classes = graph.item_classes(items)
    of = {r.id: r["class"] for r in classes.collect()}
    by_class = {(r.source, r.target): r.score for r in graph.class_edges(items, classes, similar, 0.24).collect()}
    assert len(of) == 30 and len(set(of.values())) < 30
    assert every == {(a, b, by_class[of[a], of[b]]) for a in of for b in of if a < b and (of[a], of[b]) in by_class}


def test_linked_pairs_take_all_vectors(spark):
    import numpy as np

    v = np.random.default_rng(3).standard_normal((40, 4))
    e = spark.createDataFrame([(i + 1, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    expected = {(i + 1, j + 1) for i in range(40) for j in range(i + 1, 40) if unit[i] @ unit[j] >= 0.3}
    got = [(r.source, r.target) for r in knn.linked_pairs(e.repartition(3), 0.3, block=7).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_contained_terms_stand_inside_words(spark):
    nodes = spark.createDataFrame([(1, "Rainforests, e.g. the AMAZON's"), (2, None), (3, "sea")], "id long, text string")
    terms = spark.createDataFrame([(t,) for t in ("forest", "e.g.", "amazon's", "sea", "rain", "fire", "forest")], "term string")
    assert sorted((r.id, r.term) for r in graph.contained(nodes, terms).collect()) == [(1, "amazon's"), (1, "e.g."), (1, "forest"), (1, "rain"), (3, "sea")]


def test_hybrid_search_equals_all_pairs(spark):
    """Rows without vector or without words, in blocks of a few rows, against scores of all pairs."""
    import random

    r = random.Random(6)
    rows = [(i, None if i % 9 == 0 else r.choices("abcdefgh", k=r.randint(0, 6)), None if i % 5 == 1 else [r.uniform(-1, 1) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, embedding array<double>").repartition(3)

    def score(x, y):
        w = [{t: v.count(t) / math.sqrt(sum(v.count(u) ** 2 for u in set(v))) for t in v} for v in (x[1] or [], y[1] or [])]
        s = sum(w[0][t] * w[1].get(t, 0) for t in w[0])
        d = None if x[2] is None or y[2] is None else round(sum(p * q for p, q in zip(x[2], y[2], strict=True)) / math.hypot(*x[2]) / math.hypot(*y[2]), 6)
        return None if not s and d is None else 0.7 * (d or 0) + 0.3 * s

    got = {}
    for g in hybrid.search(df.where("id < 12"), df, 7, queries_per_block=5, rows_per_block=8).collect():
        got.setdefault(g.qid, []).append((g.rank, g.score))
    for x in rows[:12]:
        every = sorted((-score(x, y) for y in rows if y[0] != x[0] and score(x, y) is not None))[:7]
        assert [s for _, s in sorted(got.get(x[0], []))] == pytest.approx([-s for s in every], abs=2e-6)


def _block(rows):
    """A block of rows given as {term: count}."""
    terms = sorted({t for r in rows for t in r})
    at = [[i for i, r in enumerate(rows) if t in r] for t in terms]
    places, counts = [i for x in at for i in x], [rows[i][t] for t, x in zip(terms, at, strict=True) for i in x]
    made = (np.array(terms, "<i8"), *(np.array(x, "<i4") for x in ([len(x) for x in at], places, counts)))
    return hybrid.Block(range(len(rows)), *[x.tobytes() for x in made], 0, b"")


@pytest.mark.parametrize("dense", (0, 0.1, 2))
def test_sparse_products_of_rare_and_frequent_terms(monkeypatch, dense):
    monkeypatch.setattr(hybrid, "_DENSE", dense)
    r = np.random.default_rng(3)
    some = lambda n: [{int(t): int(c) for t, c in zip(r.zipf(1.3, 9) % 50, r.integers(1, 4, 9), strict=True)} for _ in range(n)] + [{}]
    a, b = some(12), some(30)
    length = lambda x: math.sqrt(sum(c * c for c in x.values())) or 1
    want = [[sum(c * y.get(t, 0) for t, c in x.items()) / length(x) / length(y) for y in b] for x in a]
    assert hybrid.sparse_products(_block(a), _block(b), most=7, wide=3) == pytest.approx(np.array(want))


def test_words_of_all_rows_are_not_multiplied_one_by_one(monkeypatch):
    """150 words in each of 256 and 2,048 rows: 78 million products, which as single ones take many seconds."""
    single, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a, **k: single.append(len(x)) or bincount(x, *a, **k))
    a, b = (_block([dict.fromkeys(range(150), 1)] * n) for n in (256, 2048))
    assert hybrid.sparse_products(a, b).min() == pytest.approx(1)
    assert sum(single) < 1_000_000


def test_best_of_blocks_keeps_the_nearest():
    r = np.random.default_rng(4)
    rows = sorted({(int(q), int(d)): int(x) for q, d, x in r.integers(0, (5, 300, 20), (900, 3))}.items(), key=lambda x: x[0][1] % 7)
    best = knn.Best(4, least=50)
    for k in range(0, len(rows), 30):
        best.add(*(np.array(c) for c in zip(*[(q, d, x) for (q, d), x in rows[k : k + 30]], strict=True)))
    got = sorted((int(q), int(x), int(d)) for part in best.rows() for q, d, x in zip(*part, strict=True))
    every = sorted((q, x, d) for (q, d), x in rows)
    assert got == [y for q in range(5) for y in [x for x in every if x[0] == q][:4]]


def test_lsh_search_ranks_all_candidates_without_copies_of_vectors(spark):
    r = np.random.default_rng(5)
    v = r.standard_normal((150, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "vec_id long, embedding array<double>").repartition(3)
    found = knn.lsh_search(df.where("vec_id < 20"), df, 5, planes=3, tables=4, seed=2)
    bits = (v @ np.random.default_rng(2).standard_normal((12, 8)).T > 0).reshape(-1, 4, 3)
    near = np.round(1 - v @ v.T / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1)), 6)
    got = {}
    for x in sorted(found.collect(), key=lambda x: (x.qid, x["rank"])):
        got.setdefault(x.qid, []).append(x.did)
    for q in range(20):
        same = [d for d in range(150) if d != q and (bits[q] == bits[d]).all(1).any()]
        assert got[q] == [d for _, d in sorted((near[q, d], d) for d in same)[:5]]
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.b.json").write_text('[{"page_number": 1, "page_width": 100.0, "top": 10.9, "left": 1.0, "width": 5.0, "height": 2.0, "type": "Text", "text": "t"}]')
    assert [r.doc_id for r in readers.text_objects(spark, str(tmp_path / "docs")).collect()] == ["a"]
    e = readers.layout_elements(spark, str(tmp_path / "docs"), 200.0).first()
    assert (e.doc_id, e["index"], e.top, e.right) == ("a.b", 0, 21, 12)
    with sqlite3.connect(tmp_path / "x.db") as c:
        c.execute("CREATE TABLE docs (doc_id TEXT, n INTEGER)")
        c.execute("INSERT INTO docs VALUES ('d', 3)")
    assert readers.sqlite_tables(spark, [str(tmp_path / "x.db")], "docs", "doc_id string, n long").collect()[0].n == 3
    assert readers.sqlite_tables(spark, [str(tmp_path / "x.db")], "chunks", "doc_id string, n long").count() == 0
    v = readers.text_vectors(spark.createDataFrame([("1.5 2",)], "value string"))
    assert v.first().vector == [1.5, 2.0] and writers.remaining(spark.range(3), spark.range(1), "id").count() == 2
    out = str(tmp_path / "kg")
    assert writers.graph(spark.range(1), spark.range(1), out).endswith("kg_v1") and writers.graph(spark.range(1), spark.range(1), out).endswith("kg_v2")


def test_stream_ingest_takes_each_key_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (2, "2024-01-01 00:00:02")], "id long, t string").select("id", F.to_timestamp("t").alias("t"))
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.ingest(ingest.new_rows(spark, str(tmp_path / "in"), "id long, t timestamp", "id", "t"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
