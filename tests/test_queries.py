"""Every registered query of the engine's own operators against its SQL in DuckDB."""

import math

import duckdb
import pytest

from sievegrid.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events part supplier".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x) or type(x).__name__ in ("NAType", "NaTType"):
            return None
        if hasattr(x, "isoformat"):
            return x.isoformat()[:10]
        x = x.item() if hasattr(x, "item") else x
        return round(float(x), 9) if isinstance(x, (int, float)) else str(x)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(([value(x) for x in r] for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_equals_sql(spark, duck, name):
    got = rows(registry.queries()[name](spark, SF).toPandas())
    assert got == rows(duck.sql(registry.oracles()[name]).df())


def test_all_events_reach_the_ordered_sink(spark, monkeypatch):
    from sievegrid.plans import queries

    real, seen = queries.streams.ordered_sink, []

    def noting(write, *order):
        def noted(batch, i):
            seen.append([r["event_id"] for r in batch.collect()])
            write(batch, i)

        return real(noted, *order)

    monkeypatch.setattr(queries.streams, "ordered_sink", noting)
    registry.queries()["q42_stream_ordered"](spark, SF).collect()
    events = [r["event_id"] for r in spark.read.parquet(f"{SF}/events.parquet").collect()]
    assert all(ids == sorted(ids) for ids in seen) and sorted(x for ids in seen for x in ids) == sorted(events)


def test_tiles_are_made_once_for_each_size(spark):
    plan = registry.queries()["q71_tiles_in_sql"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("PythonUDTF") :]
