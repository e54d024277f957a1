"""Sessions by resets against a plain loop; extraction as a table function."""

import pytest
from pyspark.sql import functions as F

from mnemograph.operators import sessions
from mnemograph.plans import scripted
from mnemograph.sources.extraction_table import register_extraction
from mnemograph.sources.working import keeper

TURNS = "host string, at long, role string, session string"


def plain(rows, scoped):
    first = lambda v: (v is not None, v)  # noqa: E731  nulls come first
    out, session, place, last = [], 0, 0, object()
    for host, at, role, _ in sorted(rows, key=lambda r: (first(r[0]) if scoped else 0, first(r[1]))):
        scope = host if scoped else 0
        if role == "system" or scope != last or not out:
            session, place = session + 1, 0
        place, last = place + 1, scope
        out.append((host, at, session, place))
    return out


@pytest.mark.parametrize("scoped", [False, True])
@pytest.mark.parametrize("every", [1, 7, 1000])
def test_sessions_equal_a_loop(spark, scoped, every):
    """One host holds most rows; some sessions fill many ranges, others one row."""
    rows = [("a" if i % 10 else f"h{i % 30}", i, "system" if i % every == every - 1 else "user", "x") for i in range(400)]
    rows += [(None, None, None, None), (None, 401, "user", None)]
    df = spark.createDataFrame(rows, TURNS).repartition(7)
    got = sessions.by_resets(df, ["at"], F.col("role") == "system", keeper(spark), ["host"] if scoped else None)
    assert got.columns == ["host", "at", "role", "session", "place"]
    want = plain(rows, scoped)
    assert sorted(map(str, want)) == sorted(str((r["host"], r["at"], r["session"], r["place"])) for r in got.collect())


def test_no_turns_and_equal_turns(spark):
    none = spark.createDataFrame([], TURNS)
    assert sessions.by_resets(none, ["at"], F.col("role") == "system", keeper(spark)).count() == 0
    same = spark.createDataFrame([("a", 1, "system", "")] * 3 + [("a", 1, "user", "")] * 2, TURNS)
    got = sessions.by_resets(same, ["at", "role"], F.col("role") == "system", keeper(spark)).collect()
    assert sorted((r["session"], r["place"]) for r in got) == [(1, 1), (2, 1), (3, 1), (3, 2), (3, 3)]


def test_extraction_in_sql(spark):
    class Broken:
        def extract(self, text):
            if "boom" in text:
                raise OSError("no service")
            return scripted.sentence_extractor().extract(text)

    register_extraction(spark, Broken)
    spark.createDataFrame([(1, "user: Ana rows. No tea\nassistant: ok."), (2, None), (3, "user: boom\nassistant: "), (4, "user: \nassistant: hm")], "id long, text string").createOrReplaceTempView("said_turns")
    got = spark.sql("SELECT t.id, f.* FROM said_turns t, LATERAL extract_facts(t.text) f ORDER BY id, pos").collect()
    assert [tuple(r) for r in got] == [(1, 0, "Ana", None, "said", "Ana rows", False), (1, 1, "No", None, "said", "No tea", True)]
    with pytest.raises(Exception, match="is a string, not"):
        spark.sql("SELECT * FROM extract_facts(7)").collect()
