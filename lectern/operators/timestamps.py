"""Written times to instants: an ordered cascade of anchored patterns.

Every rule rewrites a value into the fields ``y|mo|d|h|mi|s|ap|zone``; the first
rule that matches the whole value decides. The zone in the value counts first,
else the wall clock of the record's origin. A wall clock that a zone shows twice
(clocks set back), or not at all (clocks set forward), denotes no instant; a date
with slashes and the year last is read both ways and denotes an instant only if
all readings that exist agree.

Everything is built-in expressions: no Python per row, no exchange but the join
with the zone table.

Defined cases: null, blank, placeholders, dates without a time of day, unknown
zones or origins, impossible dates and years before 1900 give null; numbers are
read by size as seconds, milliseconds, microseconds, nanoseconds or 100 ns ticks
since year 1; a repeated origin in the zone table with different zones gives null
for wall clocks of that origin.
"""

from __future__ import annotations

from collections.abc import Callable
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of months, zone abbreviations in minutes, and the cascade.
MONTHS = {
    1: "january jan januar jänner jän janvier janv enero ene",
    2: "february feb februar feber février févr fév febrero",
    3: "march mar märz mrz mär mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre déc diciembre dic",
}
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "met": 60, "mest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "ast": -240, "adt": -180, "nst": -210, "ndt": -150,
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d{1,9})?)?"
_ZONE = r" ?([Zz]|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5}|[A-Za-z]+(?:/[A-Za-z0-9_+-]+){1,2})?(?:\[[^\]]*\])?(?: \([^)]*\))?"
_NAME = r"(\p{L}{3,12})\.?"
_DAY = r"(?:\p{L}{2,12}\.?,? )?"
RULES = [
    ("iso", rf"(\d{{4}})-(\d{{2}})-(\d{{2}})[Tt ]{_TIME}{_ZONE}", "$1|$2|$3|$4|$5|$6||$7"),
    ("iso slashes", rf"(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})[Tt ]{_TIME}{_ZONE}", "$1|$2|$3|$4|$5|$6||$7"),
    ("iso named zone", rf"(\d{{4}})-(\d{{2}})-(\d{{2}})[Tt ]{_TIME}\[([^\]]+)\]", "$1|$2|$3|$4|$5|$6||$7"),
    ("compact", rf"(\d{{4}})(\d{{2}})(\d{{2}})[Tt]?(\d{{2}})(\d{{2}})(\d{{2}})?{_ZONE}", "$1|$2|$3|$4|$5|$6||$7"),
    ("day of year", rf"(\d{{4}})-(\d{{3}})[Tt ]{_TIME}{_ZONE}", "$1||$2|$3|$4|$5||$6"),
    ("mail", rf"{_DAY}(\d{{1,2}})[ -]{_NAME}[ -](\d{{4}}|\d{{2}}),? {_TIME}{_ZONE}", "$3|$2|$1|$4|$5|$6||$7"),
    ("clock first", rf"\p{{L}}{{3,9}} {_NAME} (\d{{1,2}}) {_TIME}(?: ([A-Z]{{2,5}}|[+-]\d{{4}}))? (\d{{4}})", "$7|$1|$2|$3|$4|$5||$6"),
    ("month first", rf"{_DAY}{_NAME} (\d{{1,2}}),? (\d{{4}}),? (?:at )?{_TIME}(?: ?([AaPp])\.?[Mm]\.?)?{_ZONE}", "$3|$1|$2|$4|$5|$6|$7|$8"),
    ("day with point", rf"{_DAY}(\d{{1,2}})\. ?{_NAME} (\d{{4}}),?(?: um)? {_TIME}(?: Uhr)?{_ZONE}", "$3|$2|$1|$4|$5|$6||$7"),
    ("points", rf"(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}),?(?: um)? {_TIME}(?: Uhr)?{_ZONE}", "$3|$2|$1|$4|$5|$6||$7"),
    ("hour letter", rf"{_DAY}(\d{{1,2}})(?:er)? {_NAME} (\d{{4}}),?(?: à)? (\d{{1,2}}) ?h ?(\d{{2}})(?::(\d{{2}}))?{_ZONE}", "$3|$2|$1|$4|$5|$6||$7"),
    ("particles", rf"{_DAY}(\d{{1,2}}) de {_NAME} de (\d{{4}}),?(?: a las)? {_TIME}{_ZONE}", "$3|$2|$1|$4|$5|$6||$7"),
    ("ideographs", r"(\d{4})年(\d{1,2})月(\d{1,2})日 ?(\d{1,2})[時时点](\d{1,2})分(?:(\d{1,2})秒)?()", "$1|$2|$3|$4|$5|$6||$7"),
    ("slashes", rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}}),? {_TIME}(?: ?([AaPp])\.?[Mm]\.?)?{_ZONE}", "$3|$2|$1|$4|$5|$6|$7|$8"),
]
TURNED = "$3|$1|$2|$4|$5|$6|$7|$8"  # the other reading of a date with slashes


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _offset(instant: Column, zone: Column) -> Column:
    """Seconds that the zone is ahead of UTC at the instant."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(instant), zone)) - instant


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _clock(part: Column, tz: Column) -> Column:
    """Struct (wall, fixed, region) of the fields: wall-clock seconds and the zone they are in."""
    year, month, day, hour, minute, second, half, zone = (part[i] for i in range(8))
    names = {n: str(k) for k, words in MONTHS.items() for n in words.split()}
    y = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    mo = F.when(month.rlike("^[0-9]+$"), month).otherwise(_literal_map(names)[F.lower(month)])
    plain = F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")
    doy = F.date_add(F.concat(y, F.lit("-01-01")).try_cast("date"), day.try_cast("int") - 1)
    date = F.when(month == "", F.when(F.year(doy) == y.try_cast("int"), doy)).when(mo.isNotNull(), plain)
    h, mi, s = hour.try_cast("int"), minute.try_cast("int"), F.coalesce(second.try_cast("int"), F.lit(0))
    h12 = F.when(h.between(1, 12), h % 12 + F.when(F.lower(half) == "p", 12).otherwise(0))
    h = F.when(half == "", h).otherwise(h12)
    fits = (h < 24) & (mi < 60) & (s < 60) & (F.year(date) >= 1900)
    wall = F.when(fits, F.unix_date(date).cast("long") * 86400 + h * 3600 + mi * 60 + s)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hours, minutes = F.substring(digits, 1, 2).try_cast("int"), F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    numeric = F.when((hours <= 14) & (minutes < 60), (hours * 60 + minutes) * F.when(zone.startswith("-"), -1).otherwise(1))
    fixed = F.when(zone.rlike("^[+-]"), numeric).otherwise(_literal_map(ABBREVIATIONS)[F.lower(zone)])
    regions = sorted(z for z in available_timezones() if "/" in z and not z.startswith(("posix", "right")))
    region = F.when(zone == "", tz).when(zone.contains("/"), zone)
    return _let(region, lambda r: F.struct(wall.alias("wall"), fixed.alias("fixed"), F.when(r.isin([*regions, "UTC", "GMT"]), r).alias("region")))


def _denoted(clock: Column) -> Column:
    """Array of the instants at which the zone shows the wall clock."""
    wall, fixed, region = clock["wall"], clock["fixed"], clock["region"]
    # the offsets a day before and after are the two a change of clocks can bring
    offsets = F.array_distinct(F.array(_offset(wall - 86400, region), _offset(wall + 86400, region)))
    local = F.transform(F.filter(offsets, lambda o: _offset(wall - o, region) == o), lambda o: wall - o)
    none = F.array().cast("array<bigint>")
    return F.when(wall.isNull(), none).when(fixed.isNotNull(), F.array(wall - fixed * 60)).when(region.isNotNull(), local).otherwise(none)


def _number(value: Column) -> Column:
    """Seconds of a plain number, by its size."""
    whole = F.regexp_extract(value, r"^(\d+)(?:\.\d+)?$", 1)
    n = whole.try_cast("bigint")
    size = F.length(F.regexp_replace(whole, "^0+", ""))
    whole_div = lambda x, by: F.floor(x.cast("decimal(20,0)") / F.lit(by).cast("decimal(20,0)")).cast("long")
    return (
        F.when(size.between(9, 11), n)
        .when(size.between(12, 14), whole_div(n, 1000))
        .when(size.between(15, 17), whole_div(n, 1_000_000))
        .when((size == 18) & n.between(599266080000000000, 693937152000000000), whole_div(n - 621355968000000000, 10_000_000))
        .when(size.between(18, 19), whole_div(n, 1_000_000_000))
    )


def _fields(v: Column) -> Column:
    """The fields of every reading of the value: none, one, or two for dates with slashes."""
    fields = F.array().cast("array<string>")
    for name, pattern, template in reversed(RULES):
        whole = f"^{pattern}$"
        got = [F.regexp_replace(v, whole, template)]
        if name == "slashes":
            got.append(F.regexp_replace(v, whole, TURNED))
        fields = F.when(v.rlike(whole), F.array(*got)).otherwise(fields)
    return fields


def instants(value: Column, tz: Column) -> Column:
    """Array of the distinct instants (seconds) that a written time can denote; ``tz`` may be null."""
    v = F.trim(F.regexp_replace(value, r"[\s\u00a0\u2000-\u200a\u3000]+", " "))
    read = lambda x: F.transform(F.transform(_fields(x), lambda f: _clock(F.split(f, r"\|"), tz)), _denoted)
    number = v.rlike(r"^\d+(\.\d+)?$") & ~v.rlike(r"^(19|20)\d{12}$")
    return F.when(number, F.array_compact(F.array(_let(v, _number)))).otherwise(F.array_distinct(F.flatten(_let(v, read))))


def zones(home_zones: DataFrame) -> DataFrame:
    """One zone per origin; null where an origin has two."""
    z = home_zones.where("origin is not null").groupBy("origin").agg(F.min("tz_name").alias("lo"), F.max("tz_name").alias("hi"))
    return z.select(F.col("origin").alias("_origin"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("_tz"))


def to_instant(records: DataFrame, home_zones: DataFrame, value_col: str, origin_col: str, out: str = "utc_second") -> DataFrame:
    """``records`` with the instant of ``value_col`` in whole UTC seconds, or null where it is not exactly one."""
    pre = "_"
    while any(c.startswith(pre + "w_") for c in records.columns):  # names that no column of the records has
        pre += "_"
    o, tz, got = f"{pre}w_origin", f"{pre}w_tz", f"{pre}w_instants"
    z = zones(home_zones).select(F.col("_origin").alias(o), F.col("_tz").alias(tz))
    joined = records.join(z, records[origin_col] == z[o], "left").withColumn(got, instants(F.col(value_col), F.col(tz)))
    return joined.withColumn(out, F.when(F.size(got) == 1, F.col(got)[0])).drop(o, tz, got)
