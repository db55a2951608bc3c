"""Sessions over a small weather station: sensors, and what they measure."""

import pytest

from keyspan import errors
from keyspan.plans import dialect
from keyspan.plans.session import Session
from keyspan.sources import store as store_module
from keyspan.sources.catalog import Catalog, Index, Table, load_or_seed
from keyspan.sources.store import Store


def station():
    sensors = Table("sensors", {"no": "INT", "place": "STRING", "serial": "STRING"}, ["no"], ["place", "serial"], [Index("sensors_by_place", ["place"]), Index("one_serial", ["serial"], True)], rows=4000, row_bytes=96)
    readings = Table("readings", {"at": "INT", "sensor": "INT", "kind": "STRING", "level": "INT"}, ["at"], ["sensor", "kind", "level"])
    return Catalog([sensors, readings])


@pytest.fixture
def opened(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    return lambda **options: Session(spark, station(), store, **options)


def seen(result):
    return sorted(tuple(r) for r in result.rows.collect())


def test_queries_over_two_tables(opened):
    s = opened()
    assert s.execute("insert into sensors (no, place, serial) values (1, 'roof', 'R-1'), (2, 'cellar', 'C-9'), (3, 'yard', null), (4, 'yard', 'Y-4')").tag == "INSERT 0 4"
    s.execute("insert into readings (at, sensor, kind, level) values (10, 1, 'wind', 6), (11, 1, 'rain', 2), (12, 3, 'rain', 9), (13, 9, 'rain', 1)")
    assert [tuple(r) for r in s.execute("select place, no from sensors where no >= 2 order by place desc, no desc limit 3").rows.collect()] == [("yard", 4), ("yard", 3), ("cellar", 2)]
    assert seen(s.execute("select kind, sum(level), count(*) from readings group by kind")) == [("rain", 12, 3), ("wind", 6, 1)]
    assert seen(s.execute("select r.at, x.place from readings r join sensors x on r.sensor = x.no")) == [(10, "roof"), (11, "roof"), (12, "yard")]


def test_what_changes_return(opened):
    s = opened()
    first = s.execute("insert into readings (at, sensor, kind, level) values (1, 4, 'frost', -3), (2, 4, 'frost', -5) returning at, level")
    assert first.tag == "INSERT 0 2" and seen(first) == [(1, -3), (2, -5)]
    assert seen(s.execute("update readings set level = -4 where at = 2 returning *")) == [(2, 4, "frost", -4)]
    put = s.execute("upsert into readings (at, sensor) values (2, 5) returning at, kind")
    assert put.tag == "UPSERT 1" and seen(put) == [(2, None)]  # columns that are not given are emptied
    s.execute("upsert into readings (at, sensor) values (3, 5)")
    away = s.execute("delete from readings where at >= 2 and at < 9 returning sensor, at")
    assert away.tag == "DELETE 2" and seen(away) == [(5, 2), (5, 3)]
    assert seen(s.execute("select at, level from readings")) == [(1, -3)]
    assert s.execute("delete from readings where at = 77").tag == "DELETE 0"


def test_a_serial_is_given_once(opened):
    s = opened()
    s.execute("insert into sensors (no, place, serial) values (1, 'roof', 'S'), (2, 'yard', null)")
    for sql, broken in (("insert into sensors (no, place) values (2, 'attic')", "sensors_pkey"), ("insert into sensors (no, serial) values (3, 'T'), (4, 'S')", "one_serial"),
                        ("insert into sensors (no, serial) values (5, 'U'), (6, 'U')", "one_serial"), ("update sensors set serial = 'S' where no = 2", "one_serial"), ("upsert into sensors (no, serial) values (2, 'S')", "one_serial")):
        with pytest.raises(errors.UniqueViolation) as e:
            s.execute(sql)
        assert (e.value.sqlstate, e.value.constraint) == ("23505", broken)
    s.execute("upsert into sensors (no, serial) values (1, 'S')")  # its own
    s.execute("insert into sensors (no, place) values (7, 'pond')")  # none at all
    assert seen(s.execute("select no, serial from sensors")) == [(1, "S"), (2, None), (7, None)]


def test_conflicts_by_index_and_by_key(opened):
    s = opened()
    s.execute("insert into sensors (no, place, serial) values (1, 'roof', 'A'), (2, 'yard', 'B')")
    kept = s.execute("insert into sensors (no, place, serial) values (8, 'pond', 'A'), (9, 'pond', 'Z') on conflict (serial) do nothing returning no")
    assert kept.tag == "INSERT 0 1" and seen(kept) == [(9,)]
    moved = s.execute("insert into sensors (no, place, serial) values (20, 'gate', 'B'), (21, 'gate', 'Q') on conflict (serial) do update set place = excluded.place returning no, place")
    assert seen(moved) == [(2, "gate"), (21, "gate")]
    s.execute("insert into sensors (no, place) values (9, 'lake') on conflict (no) do update set place = 'shore'")
    assert seen(s.execute("select no, place from sensors")) == [(1, "roof"), (2, "gate"), (9, "shore"), (21, "gate")]
    with pytest.raises(errors.Unsupported):
        s.execute("insert into sensors (no, place) values (5, 'x') on conflict (place) do nothing")


def test_a_failed_transaction_takes_only_rollback(opened):
    s = opened()
    assert s.execute("begin").status == "T"
    s.execute("insert into readings (at, level) values (1, 1)")
    with pytest.raises(errors.ActiveTransaction):
        s.execute("begin")
    assert s.status == "E"
    for sql in ("select * from readings", "insert into readings (at) values (2)", "commit"):
        with pytest.raises(errors.FailedTransaction):
            s.execute(sql)
    assert s.execute("rollback").status == "I" and seen(s.execute("select * from readings")) == []


def test_writers_meet_only_at_the_same_keys(opened):
    a, b, c = opened(), opened(), opened()
    a.execute("insert into readings (at, level) values (1, 10), (2, 20), (3, 30)")
    for s in (a, b, c):
        s.execute("begin")
    a.execute("update readings set level = 11 where at = 1")
    b.execute("update readings set level = 21 where at = 2")
    b.execute("insert into sensors (no, place) values (5, 'tower')")
    c.execute("delete from readings where at = 1")
    assert seen(b.execute("select no from sensors")) == [(5,)]  # b's own
    assert a.execute("commit").status == "I"
    assert b.execute("commit").status == "I"  # other keys
    with pytest.raises(errors.Retry) as e:
        c.execute("commit")
    assert e.value.sqlstate == "40001" and c.status == "I"
    assert seen(c.execute("select at, level from readings")) == [(1, 11), (2, 21), (3, 30)]
    for s in (a, b):  # what a read would no longer hold
        s.execute("begin")
    a.execute("select sum(level) from readings")
    a.execute("insert into sensors (no, place) values (6, 'mast')")
    b.execute("insert into readings (at, level) values (4, 40)")
    b.execute("commit")
    with pytest.raises(errors.Retry):
        a.execute("commit")
    for s in (a, b):  # a unique index
        s.execute("begin")
        s.execute(f"insert into sensors (no, serial) values ({7 if s is a else 8}, 'same')")
    a.execute("commit")
    with pytest.raises(errors.Retry):
        b.execute("commit")


def test_statements_by_name(opened):
    s = opened()
    assert s.prepare("note", "insert into readings (at, sensor, level) values ($1, $2, $3) on conflict (at) do update set level = $4") == 4
    for k, values in enumerate(([1, 7, 5, 0], [1, 7, 6, 99], [2, 8, 7, 0])):
        s.bind(f"portal{k}", "note", values)
        s.run_portal(f"portal{k}")
    assert s.prepare("above", "select at, level from readings where level > $1 order by level desc limit 1") == 1
    s.bind("one", "above", [6])
    assert seen(s.run_portal("one")) == [(1, 99)]
    with pytest.raises(errors.UnknownStatement):
        s.bind("one", "below", [])
    with pytest.raises(errors.UnknownPortal):
        s.run_portal("two")
    with pytest.raises(errors.ProtocolViolation):
        s.execute("select at from readings where level = $1", [])


@pytest.mark.parametrize("sql", [
    "select distinct place from sensors", "select no from sensors where place in ('roof')", "select count(*) from readings having count(*) > 2", "select r.at from readings r left join sensors x on r.sensor = x.no",
    "select r.at from readings r join sensors x on r.sensor > x.no", "select at from readings union select no from sensors", "select lower(place) from sensors", "select at from readings where at = 1 or level = 2",
    "delete from readings", "delete from readings where at > 3", "update sensors set place = 'a' where serial = 'b'", "update readings set at = 2 where at = 1", "create table clouds (no int)", "select at from readings limit 2 offset 1",
    "select kind, count(*) from readings group by kind order by kind", "insert into sensors (place) values ('roof')", "select at from (select at from readings)", "select at from readings, sensors",
])
def test_the_strict_dialect_refuses(opened, sql):
    with pytest.raises(errors.SqlError) as e:
        opened(strict=True).execute(sql)
    assert e.value.sqlstate == "0A000"


def test_the_strict_dialect_changes_ranges_of_keys(opened):
    s = opened(strict=True)
    s.execute("insert into readings (at, level) values (1, 1), (2, 2), (3, 3), (4, 4)")
    assert s.execute("update readings set level = 0 where at > 1 and at <= 3").tag == "UPDATE 2"
    assert s.execute("delete from readings where 3 <= at and at < 5").tag == "DELETE 2"
    assert seen(s.execute("select at, level from readings")) == [(1, 1), (2, 0)]


@pytest.mark.parametrize("sql, error", [
    ("insert into sensors (no, place) values ('4', 'roof')", errors.BadText), ("insert into sensors (no, place) values (4, 5)", errors.Unsupported), ("insert into sensors (no) values (null)", errors.NotNullViolation),
    ("insert into clouds (no) values (1)", errors.UndefinedTable), ("insert into sensors (no, colour) values (1, 'red')", errors.UndefinedColumn),
])
def test_values_and_names_are_checked(opened, sql, error):
    with pytest.raises(error):
        opened().execute(sql)


def test_snapshots_compaction_and_full_manifests(opened, monkeypatch):
    monkeypatch.setattr(store_module, "FULL_EVERY", 3)
    s = opened()
    for k in range(7):
        s.execute(f"upsert into readings (at, level) values ({k % 2}, {k})")
    readings, store = s.catalog.resolve("readings"), s.store
    levels = lambda n: {r["at"]: r["level"] for r in store.current(readings, n).collect()}
    assert [levels(n) for n in (1, 2, 3, 6, 7)] == [{0: 0}, {0: 0, 1: 1}, {0: 2, 1: 1}, {0: 4, 1: 5}, {0: 6, 1: 5}]
    n = store.compact(readings)
    assert store.log(readings, n).count() == 2 and levels(2) == {0: 0, 1: 1}
    s.execute("delete from readings where at = 0")
    assert levels(None) == {1: 5} and levels(n) == {0: 6, 1: 5}


def test_a_catalog_is_seeded_once(spark, tmp_path):
    path = str(tmp_path / "catalog")
    first = load_or_seed(spark, path, station().tables())
    again = load_or_seed(spark, path, [])
    assert first.to_json() == again.to_json() and again.resolve(" Sensors").uniques == {"one_serial": ["serial"]}
    with pytest.raises(errors.SqlError):
        Table("clouds", {"no": "DOUBLE"}, ["no"])


def test_plans_are_ranked(opened):
    s = opened()
    assert s.explain("select place from sensors where no = 3")["candidates"][0][0] == "PointLookup"
    assert s.explain("delete from sensors where no >= 10 and no < 12")["candidates"][0][0] == "RangeScan"
    assert s.explain("select count(*) from readings")["candidates"]


def test_quoted_parameters_stay_text():
    assert dialect.named_parameters("select \'$2\', $2, \"$1\"") == "select \'$2\', :v2, \"$1\""
