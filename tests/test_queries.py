"""Every query of the library against its SQL on the smallest tables; those without SQL at least give rows."""

import pytest

from strandframe.plans import library
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_same_rows_as_sql(spark, con, name, monkeypatch):
    monkeypatch.setenv("EMPTY_OK", "1")
    assert oracle.differences(spark, con, SF, library.queries()[name], library.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(library.queries()) - set(library.oracle_sql())))
def test_runs(spark, name):
    df = library.queries()[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry_without_the_llm_package(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    for gone in ("corpus_pipeline", "strandframe.llm"):
        for m in [m for m in sys.modules if m == gone or m.startswith(gone + ".")]:
            monkeypatch.delitem(sys.modules, m)

    class Hide:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("strandframe.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Hide(), *sys.meta_path])
    try:
        importlib.reload(entry)
        assert entry.llm is None and "r4_check" in entry.queries() and "pipeline" not in entry.oracle_sql()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
