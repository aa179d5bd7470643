"""Distances, similarities and text functions with values worked out by hand."""

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.functions import similarity as Sim
from loomwork.functions import text as T
from loomwork.functions import vectors as V


@pytest.mark.parametrize(
    ("metric", "p", "q", "expected"),
    [
        ("euclidean", [1, 2, 2], [4, 6, 2], 5),
        ("euclidean", [0.5], [0.5], 0),
        ("hamming", [1, 0, 1, 1, 0], [0, 0, 1, 1, 0], 0.2),
        ("angular", [1, 1], [2, 0], 1 - math.sqrt(0.5)),
        ("angular", [0, 2], [0, -9], 2),
        ("jaccard", [3, 5, 8], [5, 8, 13, 21], 0.4),
        ("jaccard", [2], [], 0),
        ("jaccard", [9, 11], [11, 9], 1),
    ],
)
def test_distances(spark, metric, p, q, expected):
    kind, as_ = ("int", int) if metric == "jaccard" else ("double", float)
    df = spark.createDataFrame([([*map(as_, p)], [*map(as_, q)])], f"p array<{kind}>, q array<{kind}>")
    f = {"euclidean": V.euclidean, "hamming": V.hamming, "angular": V.angular, "jaccard": V.jaccard}[metric]
    assert df.select(f(F.col("p"), F.col("q")).alias("d")).first().d == pytest.approx(expected)


def test_text_functions(spark):
    row = spark.createDataFrame([("é- té fo- o", "BOX 1 | x", "Grasses  Lands!", "3. Why?", "a  b")], "h string, b string, t string, q string, s string").select(
        T.dehyphenated("h").alias("h"), T.is_box_header("b").alias("b"), T.normalized_term("t").alias("t"), T.clean_question("q").alias("q"), T.single_space_words("s").alias("s")
    ).first()
    assert row.h == "été foo" and row.b and row.t == "grasses land" and row.q == "Why?" and row.s == 3


def test_chunks_cover_all_words(spark):
    words = [f"w{i}" for i in range(25)]
    got = spark.createDataFrame([(" ".join(words),), ("",), (None,)], "t string").select(F.explode(T.chunks("t", 10, 3)).alias("c")).select("c.*").collect()
    assert [r.text.split(" ")[0] for r in got] == ["w0", "w7", "w14", "w21"][: len(got)]
    assert got[-1].text.split(" ")[-1] == "w24"


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_similarities_are_symmetric_and_bounded(a, b):
    for f, most in ((Sim.jaro, 1.0), (Sim.indel_ratio, 100.0)):
        assert 0 <= f(a, b) <= most and f(a, b) == pytest.approx(f(b, a))
    assert Sim.jaro_winkler(a, a) == 1.0


def test_jaro_winkler_values():
    assert Sim.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
    assert Sim.jaro("DIXON", "DICKSONX") == pytest.approx(0.7667, abs=1e-4)
    assert Sim.token_sort_ratio("big red dog", "dog big red") == 100.0
