import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from lectern.operators.timestamps import to_instant

CASES = [
    ("2021-03-04T05:06:07Z", None, "2021-03-04T05:06:07+00:00"),
    ("2021-03-04t05:06:07.123456789z", None, "2021-03-04T05:06:07+00:00"),
    ("2021-03-04 05:06:07,5+0545", None, "2021-03-03T23:21:07+00:00"),
    ("2021-07-04T05:06-07", None, "2021-07-04T12:06:00+00:00"),
    ("2021-07-04T05:06:00+02:00[Europe/Berlin]", None, "2021-07-04T03:06:00+00:00"),
    ("2021-07-04 05:06:00 Europe/Berlin", None, "2021-07-04T03:06:00+00:00"),
    ("2021-07-04 05:06:00", "America/New_York", "2021-07-04T09:06:00+00:00"),
    ("2021-07-04 05:06:00", None, None),
    ("2021-03-28 02:30:00", "Europe/Berlin", None),  # the clocks skip it
    ("2021-10-31 02:30:00", "Europe/Berlin", None),  # the clocks show it twice
    ("2021-10-31 02:30:00 CET", "Europe/Berlin", "2021-10-31T01:30:00+00:00"),
    ("2021-10-31 03:30:00", "Europe/Berlin", "2021-10-31T02:30:00+00:00"),
    ("Sat, 03 Feb 2018  08:53:33 +0545 (NPT)", None, "2018-02-03T03:08:33+00:00"),
    ("Wed, 7 Feb 18 08:53:33 EST", None, "2018-02-07T13:53:33+00:00"),
    ("Tue Apr  9 10:13:45 2011", "UTC", "2011-04-09T10:13:45+00:00"),
    ("May 2, 2020 12:05 AM", "UTC", "2020-05-02T00:05:00+00:00"),
    ("May 2, 2020 13:05 PM", "UTC", None),
    ("14. Januar 2013, 08:24 Uhr", "Europe/Berlin", "2013-01-14T07:24:00+00:00"),
    ("23 février 2022 à 5h58", "UTC", "2022-02-23T05:58:00+00:00"),
    ("12 de julio de 2016, 2:54", "UTC", "2016-07-12T02:54:00+00:00"),
    ("2012年8月23日 20時43分", "Asia/Tokyo", "2012-08-23T11:43:00+00:00"),
    ("25.03.2013 09:10", "UTC", "2013-03-25T09:10:00+00:00"),
    ("02/15/2016 19:24", "UTC", "2016-02-15T19:24:00+00:00"),
    ("31/12/2019 18:04", "UTC", "2019-12-31T18:04:00+00:00"),
    ("05/05/2024 17:09", "UTC", "2024-05-05T17:09:00+00:00"),
    ("08/05/2022 19:33", "UTC", None),
    ("31/10/2021 02:30", "Europe/Berlin", None),
    ("2014/08/12 01:00:14.005939", "UTC", "2014-08-12T01:00:14+00:00"),
    ("20200114T095323Z", None, "2020-01-14T09:53:23+00:00"),
    ("20200114095323", "UTC", "2020-01-14T09:53:23+00:00"),
    ("2021-196T19:33:18Z", None, "2021-07-15T19:33:18+00:00"),
    ("2021-366T19:33:18Z", None, None),
    ("1618745926", None, "2021-04-18T11:38:46+00:00"),
    ("1719.5", None, None),
    ("1428112952312", None, "2015-04-04T02:02:32+00:00"),
    ("1585825378800362", None, "2020-04-02T11:02:58+00:00"),
    ("634326708205419183", None, "2011-02-07T10:20:20+00:00"),
    ("0001-01-01T00:00:00Z", None, None),
    ("0101-01-01T00:00:00+00:00", None, None),
    ("2021-02-30 10:00:00Z", None, None),
    ("2021-02-03 25:00:00Z", None, None),
    ("2021-02-03 10:00:00 Mars/Base", "UTC", None),
    ("2021-02-03", "UTC", None),
    ("2009", "UTC", None),
    ("0", "UTC", None),
    ("soon", "UTC", None),
    ("", "UTC", None),
    (None, "UTC", None),
    ("x" * 100_000, "UTC", None),
]


@pytest.fixture(scope="module")
def got(spark):
    zones = spark.createDataFrame([(z, z) for z in {z for _, z, _ in CASES if z}] + [("two", "UTC"), ("two", "Asia/Tokyo"), (None, "UTC")], "origin string, tz_name string")
    rows = [(i, v, z) for i, (v, z, _) in enumerate(CASES)] + [(900, "2021-01-01 00:00", "two"), (901, "2021-01-01 00:00Z", "two")]
    df = spark.createDataFrame(rows, "n int, written string, origin string").selectExpr("*", "'a' as tz_name", "1 as _w_tz", "2 as _origin", "3 as fields")
    out = to_instant(df, zones, "written", "origin")
    assert set(out.columns) == {*df.columns, "utc_second"}
    return {r.n: r.utc_second for r in out.collect()}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_case(got, n):
    want = CASES[n][2]
    assert got[n] == (None if want is None else int(dt.datetime.fromisoformat(want).timestamp())), CASES[n]


def test_contradicting_zones(got):
    assert got[900] is None and got[901] == int(dt.datetime(2021, 1, 1, tzinfo=dt.timezone.utc).timestamp())


def test_every_half_hour_around_changes_of_clocks(spark):
    """Against zoneinfo: an instant only where the wall clock shows it exactly once."""
    rows, want = [], []
    for tz in ("Europe/Berlin", "America/New_York", "Australia/Sydney", "Australia/Lord_Howe", "Asia/Kathmandu"):
        zone = ZoneInfo(tz)
        for start in (dt.datetime(2021, 3, 13), dt.datetime(2021, 3, 27), dt.datetime(2021, 4, 3), dt.datetime(2021, 10, 2), dt.datetime(2021, 10, 30), dt.datetime(2021, 11, 6)):
            for k in range(100):
                wall = start + dt.timedelta(minutes=30 * k)
                hits = {int(u.timestamp()) for f in (0, 1) for u in [wall.replace(tzinfo=zone, fold=f).astimezone(dt.timezone.utc)] if u.astimezone(zone).replace(tzinfo=None, fold=0) == wall}
                rows.append((len(rows), wall.strftime("%Y-%m-%d %H:%M:%S"), tz))
                want.append(hits.pop() if len(hits) == 1 else None)
    zones = spark.createDataFrame([(z, z) for z in {r[2] for r in rows}], "origin string, tz_name string")
    out = to_instant(spark.createDataFrame(rows, "n int, written string, origin string"), zones, "written", "origin")
    assert [r.utc_second for r in out.orderBy("n").collect()] == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "n int, written string, origin string")
    zones = spark.createDataFrame([], "origin string, tz_name string")
    assert to_instant(none, zones, "written", "origin").count() == 0
    one = spark.createDataFrame([(1, "2021-01-01 10:00Z", "x")], none.schema)
    assert to_instant(one, zones, "written", "origin").first().utc_second == 1609495200
