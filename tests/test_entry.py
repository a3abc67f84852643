import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[1]))


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()
    assert len(entry.queries()) >= 30
