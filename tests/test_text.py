import re

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import similarity as S
from quillgraph.functions import text as X
from quillgraph.operators import chunking


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "want"),
    [("a \nb", "a  b"), ("a\n \nb", "a   b"), ("a\r\nb\n\n\n\nc", "a b\n\nc"), ("a b", "a b"), ("ﬁn", "fin"), ("  x ", "x"), (None, ""), ("a\tb", "a b")],
)
def test_normalize(spark, text, want):
    assert one(spark, text, X.normalize) == want


@pytest.mark.parametrize(("n", "want"), [(0, 0), (1, 1), (5, 6), (199, 259), (200, 260), (201, 261), (381, 495)])
def test_token_estimate_rounds_halves_to_even(spark, n, want):
    assert one(spark, " ".join(["w"] * n), X.token_estimate) == want


def test_unicode_white_space(spark):
    assert one(spark, "a b\x1cc d", X.word_count) == 4


@pytest.mark.parametrize("text", ["John Smith met ACME Corp. in New York City", "É Alba\nNord x_Y A1 Ab", "AB C De Fg", "iPhone McDonald Éa"])
def test_capitalised_phrases_as_python_has_them(spark, text):
    pattern = r"\b(?:[A-Z][a-zA-Z]+|[A-Z]{2,})(?:\s+(?:[A-Z][a-zA-Z]+|[A-Z]{2,}))*\b"
    assert one(spark, text, X.capitalised_phrases) == [re.sub(r"\s+", " ", m) for m in re.findall(pattern, text)]


@pytest.mark.parametrize(("name", "want"), [("Acme Labs", "Organization"), ("Park", "Location"), ("Long Road Inn", "Location"), ("NASA", "Organization"), ("John Smith", "Person"), ("Moonkeep", "Concept"), ("Bank", "Concept")])
def test_labels(spark, name, want):
    assert one(spark, name, X.guess_label) == want


@pytest.mark.parametrize(("name", "norm", "single"), [("The Hobbit", "hobbit", "hobbit"), ("Cities", "cities", "city"), ("Glass Boxes", "glass boxes", "glass box"), ("A  Bus!", "bus", "bus"), ("é", "", ""), ("the the cats", "the cats", "the cat")])
def test_surface_and_singular(spark, name, norm, single):
    assert one(spark, name, X.surface) == norm == S.surface(name)
    assert one(spark, norm, X.singular) == single == S.singular(norm)


@pytest.mark.parametrize(("kind", "want"), [("co-founded", "CO_FOUNDED"), ("  ", "RELATED_TO"), ("--", "_"), ("9th", "REL_9TH"), ("works at", "WORKS_AT"), (None, "RELATED_TO")])
def test_relation_type(spark, kind, want):
    assert one(spark, kind, X.relation_type) == want


def test_fence_and_json(spark):
    assert one(spark, '```json\n{"a": 1}\n```', X.without_fence) == '{"a": 1}'
    assert one(spark, 'so {"a": {"b": 1}} there', X.outer_json) == '{"a": {"b": 1}}'
    with pytest.raises(Exception, match="JSON"):
        one(spark, "none", X.outer_json)


def test_snippet(spark):
    text = "x" * 100 + " Needle " + "y" * 100
    got = one(spark, text, lambda c: X.snippet(c, [F.lit(""), F.lit("needle")]))
    assert got == "..." + "x" * 69 + " Needle " + "y" * 69 + "..."
    assert one(spark, "short", lambda c: X.snippet(c, [F.lit("none")])) == "short"
    assert one(spark, "z" * 150, lambda c: X.snippet(c, [F.lit("none")])) == "z" * 140 + "..."


@pytest.mark.parametrize("n", [0, 1, 199, 200, 201, 380, 381])
def test_word_windows(spark, n):
    words = [f"w{i}" for i in range(n)]
    d = spark.createDataFrame([(1, " ".join(words))], "document_id long, text string")
    got = [(r.chunk_id, r.text, r.start_index, r.end_index) for r in chunking.word_chunks(d).orderBy("chunk_id").collect()]
    assert got == [(k, " ".join(words[i : i + 200]), i, min(n, i + 200)) for k, i in enumerate(range(0, n, 180))]


def test_recursive_segments():
    assert chunking.recursive_segments("a b. c d. e f.", size=4, overlap=1) == ["a b. c d.", "e f."]
    assert chunking.recursive_segments("a b c d e f g", size=4, overlap=1) == ["a b c d", "d e f g"]
    assert chunking.recursive_segments("p q\n \nr", size=9) == ["p q", "r"]
    assert chunking.recursive_segments("") == []


def test_unknown_chunker():
    with pytest.raises(ValueError, match="unknown"):
        chunking.chunker("page")


def test_token_sort_ratio():
    assert S.token_sort_ratio("smith john", "john smith") == 1.0
    assert abs(S.token_sort_ratio("cat", "cats") - 6 / 7) < 1e-12
    assert S.token_sort_ratio("ab", "cd") == 0.0
