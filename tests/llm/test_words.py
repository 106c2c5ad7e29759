"""The encoder's cache of words: what is asked of the tokenizer, and that the cache's limits change no ids."""

from __future__ import annotations

import random

import numpy as np
import pytest

from docweave.llm import tokens


def texts(n: int) -> list[str]:
    rng = random.Random(3)
    stems = ["".join(rng.choice("abdeinorsté") for _ in range(rng.randint(2, 9))) for _ in range(n)]
    return [" ".join(rng.choice(stems) + rng.choice(["", ",", ".", "$$$", "###", ".%%%", "'s", "'", "\n"]) for _ in range(50)) for _ in range(n)]


def test_words_are_not_encoded_again_for_the_marks_after_them():
    enc = tokens.Encoder()
    asked, whole = [], enc.whole
    enc.whole = lambda t: asked.append(t) or whole(t)
    stems = [f"{a}{b}{c}" for a in "aeio" for b in "lmnr" for c in "stäö"]
    enc.encode([" ".join(s + m for s in stems for m in ("$$$", "###", ",***", "'")).encode()])
    assert sorted(asked) == sorted([b"$$$", b"###", b",***", b"'"])


@pytest.mark.parametrize("most", [1, 7, 100])
def test_small_generations_give_the_same_ids(monkeypatch, most):
    monkeypatch.setattr(tokens, "CACHE_WORDS", most)
    enc = tokens.Encoder()
    some = texts(40)
    for t, got in zip(some, enc.encode([t.encode() for t in some]), strict=True):
        assert np.frombuffer(got, enc.dtype).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids
    assert len(enc.cache) <= most and len(enc.cache.older) <= most
