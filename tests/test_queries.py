"""Every registered query with SQL of its own gives the rows of that SQL."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from quillon.plans import registry

from .oracle import assert_same

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


SIZES = ("sf0.001", "sf0.01")


@pytest.fixture(scope="module", params=SIZES)
def outcomes(request, spark):
    """What each query's comparison raised, or None; several queries run at a time."""
    folder = f"/root/testdata/{request.param}"

    def run(name):
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                assert_same(df, ORACLES[name], folder)
            else:
                assert df.count() > 0
        except BaseException as e:  # noqa: BLE001
            return e

    with ThreadPoolExecutor(4) as pool:
        return dict(zip(QUERIES, pool.map(run, QUERIES)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(outcomes, name):
    if outcomes[name]:
        raise outcomes[name]


def test_point_ids_are_version_five(spark, small):
    import uuid

    rows = QUERIES["point_id"](spark, small).collect()
    assert rows and all(r.point_id == str(uuid.uuid5(uuid.NAMESPACE_URL, f"chunk/{r.doc_id}")) for r in rows)


def test_entry_imports_without_training_operators(spark, monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "quillon.llm", None)
    again = importlib.reload(entry)
    assert set(again.queries()) == set(QUERIES) and set(again.oracle_sql()) == set(ORACLES)
    monkeypatch.undo()
    importlib.reload(entry)
    assert entry.entry(spark).count() > 0
