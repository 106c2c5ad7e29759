from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docweave.llm import packing, records, tokens

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(text: str | None, end: int) -> np.ndarray:
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aé.,!?'<|> \n\t\x1c\x85ßİΣ1"), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_cached_words_equal_whole_texts(texts):
    enc = tokens.encoder()
    for t, got in zip(texts, enc.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, enc.dtype).tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids


def test_long_texts_are_cut_at_spaces(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 50)
    rng = random.Random(1)
    t = " ".join(rng.choice(["the", "x" * 70, "nation,", "...", "a.b"]) for _ in range(400))
    enc = tokens.encoder()
    assert np.frombuffer(enc.encode([t.encode()])[0], enc.dtype).tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("damage", [0, 5, 9, 14, -1])
def test_damaged_records_are_found(damage):
    record = bytearray(records.frame(b"some payload"))
    assert records.unframe(bytes(record)) == b"some payload"
    record[damage] ^= 1
    with pytest.raises(ValueError):
        records.unframe(bytes(record))


def test_records_round_trip(spark, odd, odd_rows, as_table):
    got = records.op5_binary_records(spark, as_table(documents=odd)).collect()
    rows = sorted(((r[0], r[1] or "") for r in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want, start = [], 0
    for doc, text in rows:
        x = ids(text, 1)
        want.append((doc, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_folders_of_stores_are_found():
    """Names that Hadoop and the native readers have for one folder."""
    same = {"s3a://bucket/x y/z": "s3://bucket/x y/z", "s3n://b/x": "s3://b/x", "s3://b/x": "s3://b/x", "gs://b/x": "gs://b/x", "hdfs://name:8020/x": "hdfs://name:8020/x", "file:/a/b": "file:///a/b", "file:///a/b": "file:///a/b", "/a/b:c": "file:///a/b:c"}
    assert {k: records.native_uri(k) for k in same} == same
    system, path = records.file_system("file:/tmp/a")
    assert (system.type_name, path) == ("local", "/tmp/a")


def test_index_rows_can_be_read_in_any_order(spark, odd, tmp_path):
    directory = f"file://{tmp_path}/records"
    index = records.write_records(odd, directory)
    some = index.orderBy("n_tokens").limit(5)
    assert records.read_records(some, directory).count() == 5


def test_empty_tables(spark, empty, as_table):
    where = as_table(documents=empty)
    assert records.op5_binary_records(spark, where).count() == 0
    assert packing.op6_packed_sequences(spark, where).count() == 0


def check_packing(rows, texts, capacity=2048):
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    want = []
    for doc, text in texts:
        x = ids(text, 0)
        want += [(doc, k, first, len(x[first : first + capacity]), zlib.crc32(x[first : first + capacity].tobytes())) for k, first in enumerate(range(0, len(x), capacity))]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    return len(sequences)


def test_packing_of_odd_rows(spark, odd, odd_rows, as_table):
    rows = packing.op6_packed_sequences(spark, as_table(documents=odd)).collect()
    total = sum(r.length for r in rows)
    assert check_packing(rows, [(r[0], r[1]) for r in odd_rows]) == -(-total // 2048)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=40))
def test_fullest_combination_is_the_best(lengths):
    counts = {x: lengths.count(x) for x in lengths}
    got = packing.fullest(counts, 20)
    sums = {max(lengths)}
    rest = sorted(lengths)
    rest.remove(max(lengths))
    for x in rest:
        sums |= {s + x for s in sums if s + x <= 20}
    assert sum(x * n for x, n in got) == max(sums)
    assert all(n <= counts[x] for x, n in got)
    made = packing.plan(counts, 20)
    assert sum(times * n for chosen, times in made for _, n in chosen) == len(lengths)
    assert all(sum(x * n for x, n in chosen) <= 20 for chosen, _ in made)
