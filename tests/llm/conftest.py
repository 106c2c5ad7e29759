from __future__ import annotations

import random

import pytest

from docweave.llm import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __s string, rank string"


@pytest.fixture(autouse=True)
def no_scratch():
    yield
    common.release()


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["the", "an", "tion", "er", "ou", "é", "st"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls in every column, empty and very long texts, copies, repeated rows and clashing extra columns."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(1, 120)) for _ in range(40)]
    long = words(rng, 30_000)
    texts = [*base, None, "", " ", "\n", "a", "x" * 3000, "!!! ???", "<|endoftext|> is not special here", "ＡＢＣ ß É ÉTÉ İ", base[0], base[0], base[1] + " " + base[2], base[3][: len(base[3]) // 2] + base[4], long, long[:-5] + "zebra"]
    rows = [(i * 3 % 97 + 1, t, "en" if i % 5 else None, None if i % 7 == 0 else f"src{i % 3 if i % 2 else 0}", None if t is None else len(t), "s", "r") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, "no id at all", None, None, None, None, None)]


@pytest.fixture()
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def as_table(tmp_path):
    """Writes frames as tables of a data folder; returns the folder."""

    def write(**frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
