"""vector_pick_chunks reads the events whole and ranks every vector that they name."""

from __future__ import annotations

import duckdb
import pytest

from docweave.plans import catalog

N = 600


def both(spark, folder, events, vectors):
    """The query's rows and its SQL's over small tables."""
    spark.createDataFrame([(i, [1.0, float(i % 61) / 7], i % 3) for i in vectors], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(i,) for i in events], "event_id long").write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    for t in ("embeddings", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = catalog.queries()["vector_pick_chunks"](spark, str(folder))
    got = [(r.chunk_id, r.score) for r in df.collect()]
    assert got == con.execute(catalog.oracle_sql()["vector_pick_chunks"]).fetchall()
    return [i for i, _ in got]


@pytest.mark.parametrize(
    "events, want",
    [
        (range(3 * N), [7, 68, 129, 190, 251, 312, 373, 434, 495, 556]),  # every vector is named, three times
        ([*range(N + 50), 2 * N + 7], [7, 68, 129, 190, 251, 312, 373, 434, 495, 556]),
        ([7 + N, 7, 68, 599], [7, 68, 599]),  # only what events name
        ([68, None], []),  # a chunk without a vector
        ([], []),
    ],
)
def test_chunks_are_those_that_events_name(spark, tmp_path, events, want):
    assert both(spark, tmp_path, list(events), range(N)) == want


def test_a_named_chunk_without_a_vector_gives_none(spark, tmp_path):
    assert both(spark, tmp_path, [7, 68, 200], [i for i in range(N) if i != 200]) == []
