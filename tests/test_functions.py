"""Column functions against hand-made rows."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvid.functions import filters as X
from corvid.functions import ids, text
from corvid.functions import vector as V


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {_type(v)}" for k, v in values.items()))
    return df.select(expr.alias("x")).first()["x"]


def _type(v):
    return "array<double>" if isinstance(v, list) else "string"


@pytest.mark.parametrize(
    ("f", "a", "b", "want"),
    [
        (V.cosine, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], 1.0),
        (V.cosine, [1.0, 0.0], [0.0, 1.0], 0.0),
        (V.cosine, [1.0, 2.0], [-1.0, -2.0], -1.0),
        (V.cosine, [0.0, 0.0], [1.0, 2.0], 0.0),
        (V.dot, [1.0, 2.0, 3.0], [4.0, 5.0, 6.0], 32.0),
        (V.euclidean_distance, [0.0, 0.0, 0.0], [3.0, 4.0, 0.0], 5.0),
        (V.euclidean, [0.0], [4.0], 0.2),
        (V.manhattan, [0.0, 0.0], [1.0, 2.0], 0.25),
        (V.angular, [1.0, 0.0], [-1.0, 0.0], 0.0),
        (V.rbf, [1.0], [1.0], 1.0),
    ],
)
def test_similarities(spark, f, a, b, want):
    assert one(spark, f(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want, abs=1e-9)


def test_different_lengths_raise(spark):
    with pytest.raises(Exception, match="different lengths"):
        one(spark, V.dot(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 2.0])


def test_normalize(spark):
    assert one(spark, V.normalize(F.col("a")), a=[3.0, 4.0, 0.0]) == pytest.approx([0.6, 0.8, 0.0])
    assert one(spark, V.normalize(F.col("a")), a=[0.0, 0.0]) == [0.0, 0.0]


def test_unknown_metric(spark):
    with pytest.raises(ValueError, match="unknown metric"):
        V.similarity("hamming", F.col("a"), F.col("b"))


def test_centroids(spark):
    df = spark.createDataFrame([("k", [1.0, 2.0]), ("k", [3.0, 4.0]), ("l", [5.0, 6.0])], "key string, v array<double>")
    assert {r["key"]: r["centroid"] for r in V.centroid_arrays(df, "key", "v").collect()} == {"k": [2.0, 3.0], "l": [5.0, 6.0]}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(-10, 10), min_size=3, max_size=3), st.lists(st.floats(-10, 10), min_size=3, max_size=3))
def test_cosine_is_symmetric_and_bounded(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    x, y = df.select(V.cosine(F.col("a"), F.col("b")), V.cosine(F.col("b"), F.col("a"))).first()
    assert x == y and -1 - 1e-9 <= x <= 1 + 1e-9 and not math.isnan(x)


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (text.normalize_whitespace, "  a\t\n b  ", "a b"),
        (text.remove_html, "a <b>c</b>", "a c"),
        (text.remove_punctuation, "a, b! $c", "a b c"),
        (text.remove_diacritics, "café résumé ü", "cafe resume ü"),
        (text.replace_numbers, "a 12345 b6", "a [NUMBER] b[NUMBER]"),
        (text.remove_stopwords, "o gato e a casa", "gato casa"),
        (lambda c: text.truncate(c, 3), "abcdef", "abc"),
        (lambda c: text.clean(c, text.Cleaning(lower=True, max_length=4)), " <p>ABC  DEF</p> ", "abc "),
    ],
)
def test_cleaning(spark, f, given, want):
    assert one(spark, f(F.col("t")), t=given) == want


def test_ids(spark):
    assert one(spark, ids.content_hash(F.col("t")), t="hello") == 99162322
    assert one(spark, ids.legacy_id(F.col("t")), t="hello") == "doc-5e918d2"


ROWS = [("1", {"category": "tech", "priority": "5", "published": "true"}, ["spark", "sql"], 5), ("2", {"category": "science"}, None, None)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id string, metadata map<string,string>, tags array<string>, size int")


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        (X.eq("category", "tech"), ["1"]),
        (X.ne("priority", 5), ["2"]),
        (X.gt("priority", 4), ["1"]),
        (X.lt("size", 9), ["1"]),
        (X.gte("size", 5), ["1"]),
        (X.lte("size", 5), ["1"]),
        (X.contains("tags", "sql"), ["1"]),
        (X.contains("category", "ien"), ["2"]),
        (X.contains("metadata", "tech"), ["1"]),
        (X.in_("category", ["science", "art"]), ["2"]),
        (X.in_("category", []), []),
        (X.not_in("size", [5]), ["2"]),
        (X.between("priority", 5, 6), ["1"]),
        (X.matches("category", "t.*h"), ["1"]),
        (X.matches("category", "ec"), []),
        (X.exists("priority"), ["1"]),
        (X.exists("size"), ["1"]),
        (X.eq("published", True), ["1"]),
        (X.all_of(), ["1", "2"]),
        (X.any_of(), []),
        (X.all_of(X.any_of(X.eq("category", "science"), X.eq("size", 5)), X.exists("size")), ["1"]),
        ({"category": ["tech", "art"], "priority": X.Range(1, 9)}, ["1"]),
        (None, ["1", "2"]),
    ],
)
def test_filters(table, spec, want):
    assert sorted(r["id"] for r in X.apply_filter(table, spec).collect()) == want


def test_missing_is_true_only_in_compat(table):
    assert table.where(X.compile_filter(table, X.gte("size", 1), compat=True)).count() == 2
    assert table.where(X.compile_filter(table, X.gte("size", 1))).count() == 1


def test_unknown_field_and_operator(spark, table):
    with pytest.raises(ValueError, match="neither a column"):
        X.apply_filter(spark.range(1), X.eq("x", 1))
    with pytest.raises(ValueError, match="unknown operator"):
        X.apply_filter(table, X.Condition("size", "like", 1))


def test_lenient_and_remote(table):
    assert [r["id"] for r in table.where(X.lenient_equals(table, "priority", 5.0)).collect()] == ["1"]
    assert X.remote_where({"a": [1, 2], "b": X.Range(1, 2), "c": "x"}) == {"a": {"$in": [1, 2]}, "b": {"$gte": 1, "$lte": 2}, "c": "x"}
