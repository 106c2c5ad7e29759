"""Operator 10 splits a group's texts into words twice, once to ask and once to number them; numbers stand for the words after."""

from __future__ import annotations

from docweave.llm import ctw


def test_words_and_ends_are_numbered():
    numbered = ctw.Numbered()
    first, sizes = numbered.of([b"a B\ta", b"", b" c\n"])
    assert first.tolist() == [1, 2, 1, 0, 0, 3, 0] and sizes.tolist() == [4, 1, 2]
    again, sizes = numbered.of([b"C d b"])
    assert again.tolist() == [3, 4, 2, 0] and sizes.tolist() == [4]
    assert list(numbered) == [b"", b"a", b"b", b"c", b"d"]


def test_groups_keys_are_found_once(spark, odd, monkeypatch):
    """A group's distinct grams are made where it asks alone: what it is told names them."""
    calls = spark.sparkContext.accumulator(0)
    found = ctw.distinct_keys

    def counted(texts):
        calls.add(1)
        return found(texts)

    monkeypatch.setattr(ctw, "distinct_keys", counted)
    scores = ctw.score(odd)
    assert scores.count() == odd.count()
    assert calls.value == 1  # one group
