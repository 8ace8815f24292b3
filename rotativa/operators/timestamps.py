"""Mixed timestamp texts to one UTC instant.

Texts are rewritten by style into one field list (a CASE of patterns, inside codegen), which gives a
wall time as microseconds and, if stated, an offset. Wall times without an offset are looked up in
zone-offset intervals: every IANA zone in use is expanded to its intervals of constant offset in
local time, exploded to calendar years, and joined on (zone, year). Two matching intervals mean an
ambiguous wall time (the earlier instant is taken), none a skipped one (the offset before the change
holds), one gives the offset directly.

The interval table holds at most 599 zones x 201 years, whatever the data, so it is broadcast.

Defined results: null, empty, relative or impossible values give a null instant; a fraction is cut
to microseconds; missing time parts are zero; a wall time without zone and without outlet is UTC;
years before 1900 or after 2100 use the offset of these years; input rows and extra columns are kept.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotativa.session import bounded_broadcast

FIRST_YEAR, LAST_YEAR = 1900, 2100
DAY, SECOND = 86_400, 1_000_000

#: Month names and their common short forms in Spanish, English and Portuguese.
MONTHS = {
    1: "ene enero jan january janeiro",
    2: "feb febrero february fev fevereiro",
    3: "mar marzo march março",
    4: "abr abril apr april",
    5: "may mayo mai maio",
    6: "jun junio june junho",
    7: "jul julio july julho",
    8: "ago agosto aug august",
    9: "sep sept septiembre set setiembre september setembro",
    10: "oct octubre october out outubro",
    11: "nov noviembre november novembro",
    12: "dic diciembre dec december dez dezembro",
}

#: Zone abbreviations in offset hours; ("" for any zone).
ABBREVIATIONS = {
    "": {"Z": 0, "UTC": 0, "GMT": 0, "UT": 0},
    "America/Bogota": {"COT": -5},
    "America/Lima": {"PET": -5},
    "America/Santiago": {"CLT": -4, "CLST": -3},
    "America/Sao_Paulo": {"BRT": -3, "BRST": -2},
    "America/Mexico_City": {"CST": -6, "CDT": -5},
    "America/New_York": {"EST": -5, "EDT": -4},
    "America/Chicago": {"CST": -6, "CDT": -5},
    "America/Denver": {"MST": -7, "MDT": -6},
    "America/Los_Angeles": {"PST": -8, "PDT": -7},
    "America/Argentina/Buenos_Aires": {"ART": -3},
    "America/Caracas": {"VET": -4},
    "America/Guayaquil": {"ECT": -5},
    "America/La_Paz": {"BOT": -4},
    "Europe/Madrid": {"CET": 1, "CEST": 2},
    "Europe/London": {"BST": 1},
    "Europe/Lisbon": {"WET": 0, "WEST": 1},
}

_ZONE = r"((?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|[A-Z]{1,5})?"
_BRACKET = r"(?:\[([A-Za-z0-9_+/-]+)\])?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_HALF = r"(?i:([ap])\.? ?m\.?)?"

#: style: (pattern, rewriting into year|month|day|hour|minute|second|fraction|half|zone|bracket)
STYLES = {
    "iso": (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:(?:T| |, )(?:{_CLOCK}))? ?{_ZONE}{_BRACKET}$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    "basic": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[T ](\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))? ?{_ZONE}{_BRACKET}$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    "named": (rf"^(?:[^\W\d]+\.?,? )?(\d{{1,2}})[ -](?:de )?([^\W\d]{{3,}})\.?,?[ -](?:del? )?(\d{{4}})(?:(?:,| -| a las|, a las)? {_CLOCK} ?{_HALF})? ?{_ZONE}{_BRACKET}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    "us_named": (rf"^(?:[^\W\d]+\.?,? )?([^\W\d]{{3,}})\.? (\d{{1,2}}),? (\d{{4}})(?:,? {_CLOCK} ?{_HALF})? ?{_ZONE}{_BRACKET}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    "slash": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,? {_CLOCK} ?{_HALF})? ?{_ZONE}{_BRACKET}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    "slash_us": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,? {_CLOCK} ?{_HALF})? ?{_ZONE}{_BRACKET}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
}


def offset_intervals(zone: str, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> list[tuple[int, int, int]]:
    """(start, end, offset) seconds: intervals of constant offset of ``zone``, bounds in UTC."""
    info = ZoneInfo(zone)
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)

    def offset(second: int) -> int:
        return int((epoch + dt.timedelta(seconds=second)).astimezone(info).utcoffset().total_seconds())

    low, high = (int((dt.datetime(y, 1, 1, tzinfo=dt.timezone.utc) - epoch).total_seconds()) for y in (first_year, last_year + 1))
    intervals, start, now = [], -(2**40), offset(low)
    for at in range(low, high, 7 * DAY):
        if (after := offset(at + 7 * DAY)) == now:
            continue
        left, right = at, at + 7 * DAY
        while right - left > 1:
            middle = (left + right) // 2
            left, right = (middle, right) if offset(middle) == now else (left, middle)
        intervals.append((start, right, now))
        start, now = right, after
    return [*intervals, (start, 2**40, now)]


def _expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for zone in batch["zone"]:
            try:
                found = [(s + o, e + o, o) for s, e, o in offset_intervals(zone)]
            except (ValueError, OSError, KeyError):
                continue
            for year in range(FIRST_YEAR, LAST_YEAR + 1):
                begin = int((dt.datetime(year, 1, 1) - dt.datetime(1970, 1, 1)).total_seconds()) - 2 * DAY
                end = begin + 371 * DAY
                if year == FIRST_YEAR:
                    begin = -(2**41)
                if year == LAST_YEAR:
                    end = 2**41
                rows += [(zone, year, s * SECOND, e * SECOND, o) for s, e, o in found if s < end and e > begin]
        yield pd.DataFrame(rows, columns=["zone", "year", "local_start", "local_end", "offset"])


def interval_table(zones: DataFrame) -> DataFrame:
    """``zones(zone)`` to one row for each zone and year with its local offset intervals."""
    schema = "zone string, year int, local_start long, local_end long, offset int"
    long = zones.where("zone is not null").distinct().mapInPandas(_expand, schema)
    return long.groupBy("zone", "year").agg(F.collect_list(F.struct("local_start", "local_end", "offset")).alias("intervals"))


def _literal_map(pairs: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def parse(value: Column, month_first: Column) -> Column:
    """Struct(utc, wall, zone_text, bracket): microseconds; ``utc`` for epochs only, ``wall`` otherwise."""
    text = F.trim(F.regexp_replace(F.regexp_replace(value, r"[\s   ﻿]+", " "), "[−‐‑]", "-"))
    epoch = text.rlike(r"^\d{1,16}(?:\.\d+)?$")
    number = F.when(epoch, text.try_cast("decimal(30,9)"))
    micros = F.when(number >= 100_000_000_000, F.floor(number * 1_000)).otherwise(F.floor(number * 1_000_000)).try_cast("long")
    styled = F.when(epoch, F.lit(None).cast("string"))
    for style, (pattern, rewriting) in STYLES.items():
        condition = text.rlike(pattern)
        condition = condition & F.coalesce(month_first, F.lit(False)) if style == "slash_us" else condition & ~F.coalesce(month_first, F.lit(False)) if style == "slash" else condition
        styled = styled.when(condition, F.regexp_replace(text, pattern, rewriting))
    months = _literal_map({name: m for m, names in MONTHS.items() for name in names.split()})

    def field(k: int) -> Column:
        return F.get(F.col("_f"), F.lit(k))

    return F.struct(micros.alias("utc"), F.split(styled, r"\|").alias("fields")), months, field


def normalise(df: DataFrame, value: str, zone: Column, month_first: Column, intervals: DataFrame, out: str = "utc") -> DataFrame:
    """Add ``out``: the UTC text of ``value``, null where it names no date by itself.

    ``zone`` is the IANA zone that holds for values without one, ``month_first`` whether slashed dates
    are month first. ``intervals`` comes from :func:`interval_table`.
    """
    keep = df.columns
    parsed, months, field = parse(F.col(f"`{value}`"), month_first)
    x = df.withColumn("_p", parsed).withColumn("_f", F.col("_p.fields")).withColumn("_zone", zone)
    month = F.coalesce(field(1).try_cast("int"), F.try_element_at(months, F.lower(field(1))))
    number = lambda k: F.coalesce(F.nullif(field(k), F.lit("")).try_cast("int"), F.lit(0))
    half = F.lower(F.coalesce(field(7), F.lit("")))
    hour = F.when((half != "") & number(3).between(1, 12), number(3) % 12 + F.when(half == "p", 12).otherwise(0)).when(half == "", number(3))
    date = F.expr("try_to_date(concat_ws('-', lpad(_f[0], 4, '0'), lpad(cast(_m as string), 2, '0'), lpad(_f[2], 2, '0')), 'yyyy-MM-dd')")
    fraction = F.rpad(F.substring(F.coalesce(field(6), F.lit("")), 1, 6), 6, "0").try_cast("long")
    valid = hour.between(0, 23) & number(4).between(0, 59) & number(5).between(0, 59)
    wall = F.when(valid, F.unix_date("_d").cast("long") * DAY * SECOND + (hour * 3600 + number(4) * 60 + number(5)).cast("long") * SECOND + fraction)
    said = F.coalesce(field(8), F.lit(""))
    digits = F.regexp_replace(F.regexp_extract(said, r"([+-]\d{1,2}(?::?\d{2})?)$", 1), ":", "")
    hours = F.regexp_extract(digits, r"^[+-](\d{1,2}?)(?:\d{2})?$", 1)
    minutes = F.regexp_extract(digits, r"^[+-]\d{1,2}?(\d{2})$", 1)
    plain = F.length(digits) <= 3
    stated = F.when(digits != "", F.when(digits.startswith("-"), -1).otherwise(1) * (F.when(plain, F.substring(digits, 2, 2)).otherwise(hours).try_cast("int") * 3600 + F.coalesce(F.when(~plain, minutes).try_cast("int"), F.lit(0)) * 60))
    own = _literal_map({f"{z}|{a}": h * 3600 for z, names in ABBREVIATIONS.items() for a, h in names.items()})
    any_zone = _literal_map({a: h * 3600 for names in ABBREVIATIONS.values() for a, h in names.items()})
    named = F.coalesce(F.try_element_at(own, F.concat(F.lit("|"), said)), F.try_element_at(own, F.concat_ws("|", "_zone", said)), F.try_element_at(any_zone, said))
    x = (
        x.withColumn("_m", month)
        .withColumn("_d", date)
        .withColumn("_wall", wall)
        .withColumn("_stated", F.when(said != "", F.coalesce(stated, named)))
        .withColumn("_unknown", (said != "") & F.col("_stated").isNull())
        .withColumn("_at", F.when(F.col("_stated").isNull() & F.col("_wall").isNotNull(), F.coalesce(F.nullif(field(9), F.lit("")), F.col("_zone"))))
        .withColumn("_year", F.least(F.greatest(F.year("_d"), F.lit(FIRST_YEAR)), F.lit(LAST_YEAR)))
    )
    lookup = intervals.select(F.col("zone").alias("_at"), F.col("year").alias("_year"), F.col("intervals").alias("_iv"))
    x = x.join(F.broadcast(lookup), ["_at", "_year"], "left")  # at most 599 zones x 201 years
    inside = F.filter("_iv", lambda i: (i["local_start"] <= F.col("_wall")) & (F.col("_wall") < i["local_end"]))
    before = F.filter("_iv", lambda i: i["local_end"] <= F.col("_wall"))
    looked = F.when(F.size("_in") > 0, F.array_max(F.transform("_in", lambda i: i["offset"]))).otherwise(F.array_max(F.transform(before, lambda i: F.struct(i["local_end"], i["offset"])))["offset"])
    x = x.withColumn("_in", inside).withColumn("_off", F.coalesce("_stated", looked, F.lit(0)).cast("long"))
    x = x.withColumn("_us", F.when(~F.coalesce("_unknown", F.lit(False)), F.coalesce(F.col("_p.utc"), F.col("_wall") - F.col("_off") * SECOND)))
    return x.withColumn(out, utc_text(F.col("_us"))).select(*[f"`{c}`" for c in keep if c != out], out)


def utc_text(micros: Column) -> Column:
    """Microseconds since 1970 as ``2026-01-31T23:59:59.000000Z``, whatever the session's zone."""
    day = F.floor(micros / F.lit(DAY * SECOND).cast("decimal(20,0)")).cast("int")
    rest = F.pmod(micros, F.lit(DAY * SECOND))
    second = (rest / SECOND).cast("long")
    stamp = F.format_string("T%02d:%02d:%02d.%06dZ", (second / 3600).cast("long"), (second / 60 % 60).cast("long"), second % 60, rest % SECOND)
    return F.when(micros.isNotNull(), F.concat(F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string"), stamp))


def outlet_of(df: DataFrame, outlets: DataFrame, name: str = "medio", url: str = "url") -> DataFrame:
    """Add ``_zone`` and ``_country`` of a row's outlet: by brand or domain, else by the url's host."""
    keyed = outlets.select(F.explode(F.array_distinct(F.array("medio", "dominio"))).alias("_key"), F.col("zona_horaria").alias("_z"), F.col("pais").alias("_c"))
    keyed = bounded_broadcast(keyed.groupBy("_key").agg(F.min(F.struct("_z", "_c")).alias("_o")))
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?(?:www\.)?([^/:?#]+)", 1)
    x = df.withColumn("_host", host).withColumn("_name", F.trim(F.coalesce(F.col(name), F.lit(""))))
    x = x.join(keyed.select(F.col("_key").alias("_name"), F.col("_o").alias("_by_name")), "_name", "left")
    x = x.join(keyed.select(F.col("_key").alias("_host"), F.col("_o").alias("_by_host")), "_host", "left")
    outlet = F.coalesce("_by_name", "_by_host")
    return x.withColumn("_zone", outlet["_z"]).withColumn("_country", outlet["_c"]).select(*[f"`{c}`" for c in df.columns], "_zone", "_country")


def instants(notes: DataFrame, results: DataFrame, outlets: DataFrame) -> DataFrame:
    """(tabla, id, campo, utc) of every date field of both tables that names a date by itself."""
    published = [F.struct(F.lit(c).alias("campo"), F.col(c).alias("value")) for c in ("fecha_publicacion", "fecha_captura")]
    long = (
        notes.select(F.lit("notas").alias("tabla"), "id", "medio", "url", F.explode(F.array(*published)).alias("v"))
        .unionByName(results.select(F.lit("resultados").alias("tabla"), F.col("resultado_id").alias("id"), "medio", "url", F.struct(F.lit("fecha").alias("campo"), F.col("fecha").alias("value")).alias("v")))
        .select("tabla", "id", "medio", "url", "v.campo", "v.value")
        .where("value is not null")
    )
    x = outlet_of(long, outlets)
    zone = F.when(F.col("campo") == "fecha_captura", F.lit("UTC")).otherwise(F.coalesce("_zone", F.lit("UTC")))
    zones = outlets.select(F.col("zona_horaria").alias("zone")).unionByName(outlets.sparkSession.createDataFrame([("UTC",)], "zone string"))
    done = normalise(x, "value", zone, F.col("_country") == "US", interval_table(zones), "utc")
    return done.where("utc is not null").select("tabla", "id", "campo", "utc").distinct()
