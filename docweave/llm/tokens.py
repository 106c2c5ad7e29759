"""Token ids by the tokenizers library, with a cache of words.

The tokenizer drops white space and never joins tokens across it, so a text's ids are its words' ids in turn. Words are
lower-cased in ASCII, which the tokenizer would do anyway; most are then found in a cache of the worker. Texts with "<|"
(which may hold a special token) are encoded whole.
"""

from __future__ import annotations

import os
import string
import unicodedata
from collections.abc import Callable

import numpy as np

TOKENIZER = "word_bpe_49k.json"
#: Words of a generation of the cache, of which there are two at most, which bounds a worker's memory: when the newer one
#: is full the older goes, but for words that were asked for since.
CACHE_WORDS = 250_000
#: Bytes of a long text whose words are looked up at once.
CHUNK = 1 << 19
#: Marks that end words: the tokenizer takes a run of them after a letter on its own.
MARKS = string.punctuation.encode()
#: Letters before this one are the same in Python and the tokenizer, whatever Unicode either knows.
LAST = "\u0530"


class Words(dict):
    """Ids by word; a word that is in neither generation is encoded."""

    def __init__(self, encode: Callable[[bytes], bytes]):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Encodes UTF-8 texts to little-endian ids; two bytes an id where the vocabulary allows."""

    def __init__(self, name: str = TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.as_characters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.ids = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.cache = Words(self.word)

    def whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.dtype).tobytes()

    def word(self, word: bytes) -> bytes:
        """The ids of a word. Letters go to the tokenizer's model at once, as its rules would not cut them."""
        if word.isalpha():
            return self.merged(word.decode())
        stem = word.rstrip(MARKS)
        if len(stem) < len(word) and (stem.isalpha() or letters(stem)):
            return self.cache[stem] + self.cache[word[len(stem) :]]
        if letters(word):
            return self.merged(self.as_characters(self.normalizer.normalize_str(word.decode()))[0][0])
        return self.whole(word)

    def merged(self, characters: str) -> bytes:
        return b"".join([self.ids[t.id] for t in self.model.tokenize(characters)])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as bytes."""
        get = self.cache.__getitem__
        out = []
        for t in texts:
            some = [self.whole(c) if b"<|" in c else b"".join(map(get, c.lower().replace(b"\n", b" ").split(b" "))) for c in cut_long(t)]
            out.append(some[0] if len(some) == 1 else b"".join(some))
        return out


def cut_long(text: bytes) -> list[bytes]:
    """A text in pieces of CHUNK bytes and up to the next space: ids of the pieces in turn are the text's ids."""
    if len(text) <= CHUNK:
        return [text]
    out, first = [], 0
    while first < len(text):
        last = text.find(b" ", first + CHUNK)
        last = len(text) if last < 0 else last
        out.append(text[first:last])
        first = last
    return out


def letters(word: bytes) -> bool:
    """Whether a word is letters alone, not all ASCII, and stays so when the tokenizer normalises it."""
    s = word.decode()
    return not s.isascii() and s.isalpha() and max(s) < LAST and s.lower().isalpha() and unicodedata.normalize("NFC", s).isalpha()


_encoders: dict[str, Encoder] = {}


def encoder(name: str = TOKENIZER) -> Encoder:
    """The worker's encoder; its cache serves all tasks."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]
