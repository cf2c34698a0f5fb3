"""Normalisation of mixed timestamp texts to microseconds since 1970-01-01 UTC.

Every written form is one branch of a single regular expression with named groups. One replacement turns a
text into a fixed list of parts; the calendar is then checked and the instant assembled by integer
arithmetic on days, all in generated JVM code. Only a local time without offset needs a zone's rules.
"""

from __future__ import annotations

import datetime as dt
import functools
import zoneinfo

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Month names of the mail-style form.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# Fixed value: numbers of at least this size count milliseconds, smaller ones seconds.
MILLIS_FROM = 100_000_000_000

_BLANK = r"[\s\p{Z}\x{FEFF}]*"
_CLOCK = r"(?<h1>\d{1,2}):(?<n1>\d{2})(?::(?<s1>\d{2})(?:[.,](?<f1>\d+))?)?(?: ?(?<half>[ap]m))?"
_YEAR_FIRST = r"(?<y1>\d{4})(?<sep1>[-:/.])(?<m1>\d{1,2})\k<sep1>(?<d1>\d{1,2})(?:T| +)"
_YEAR_LAST = r"(?<a2>\d{1,2})(?<sep2>[-/.])(?<b2>\d{1,2})\k<sep2>(?<y2>\d{4})(?:T|,? +)"
_MAIL = r"(?:[a-z]{3}, ?)?(?<d3>\d{1,2}) (?<mon3>[a-z]{3}) (?<y3>\d{4}) +"
_DENSE = r"(?<y4>\d{4})(?<m4>\d{2})(?<d4>\d{2})[T_](?<h4>\d{2})(?<n4>\d{2})(?<s4>\d{2})(?:[.,](?<f4>\d+))?"
_ZONE = r"(?: *(?<off>Z|[+-]\d{2}(?::?\d{2})?))?(?: ?\[(?<zone>[a-z0-9_+/-]+)\])?(?: +(?<letters>[a-z]{1,6}))?"
_NUMBER = r"(?<sign>[+-]?)(?<num>\d{1,15})(?:\.(?<nf>\d+))?"
PATTERN = rf"(?i)^{_BLANK}(?:(?:(?:{_YEAR_FIRST}|{_YEAR_LAST}|{_MAIL}){_CLOCK}|{_DENSE}){_ZONE}|{_NUMBER}){_BLANK}\z"

_PARTS = {
    "y": "${y1}${y2}${y3}${y4}", "m": "${m1}${m4}", "d": "${d1}${d3}${d4}", "a": "${a2}", "b": "${b2}", "mon": "${mon3}",
    "h": "${h1}${h4}", "n": "${n1}${n4}", "s": "${s1}${s4}", "f": "${f1}${f4}", "half": "${half}", "off": "${off}",
    "zone": "${zone}", "letters": "${letters}", "sign": "${sign}", "num": "${num}", "nf": "${nf}",
}


@functools.cache
def zone_letters() -> dict[str, dict[str, int]]:
    """For each known zone its letter codes and their offsets in seconds, the latest use of a code last.

    Read from the zone rules at both solstices of each year, so its size depends on the rules alone.
    """
    moments = [dt.datetime(y, m, 1, tzinfo=dt.timezone.utc) for y in range(1970, 2038) for m in (1, 7)]
    out = {}
    for name in sorted(zoneinfo.available_timezones()):
        if name.startswith(("posix/", "right/")) or name in ("localtime", "Factory", "posixrules"):
            continue
        zone, codes = zoneinfo.ZoneInfo(name), {}
        for at in moments:
            local = at.astimezone(zone)
            if (code := local.tzname()).isalpha():
                codes[code.upper()] = int(local.utcoffset().total_seconds())
        out[name] = {"UTC": 0, "GMT": 0, "Z": 0} | codes
    return out


def zones(spark: SparkSession) -> DataFrame:
    """One row per known zone: zone_name, zone_codes. A few hundred rows, whatever the data."""
    known = set(spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    rows = [(z, c) for z, c in zone_letters().items() if z in known]
    return spark.createDataFrame(rows, "zone_name string, zone_codes map<string,int>")


def instant_micros(df: DataFrame, text: str, out: str, zone: Column, date_order: Column, codes: Column) -> DataFrame:
    """Add ``out``: the instant that ``text`` states, in microseconds since 1970-01-01 UTC, or null.

    zone: name of the zone of a text that states none (it must be a known zone, or null: then such a text has
    no instant). date_order: 'dmy' or 'mdy' for all-numeric dates that end with the year (null: dmy). codes:
    map of the zone's letter codes to seconds. Null, empty, unreadable and impossible texts give null, and so
    do unknown letters and zone names, leap seconds, 24:00 and years outside 1 to 9999.
    """
    t = "__ts_"
    known = [z for z in zone_letters()]
    row = "|".join(_PARTS.values())
    parts = F.split(F.regexp_replace(F.translate(F.col(text), "\x01", "?"), PATTERN, f"\x01|{row}"), "\\|", -1)
    df = df.withColumns({f"{t}p": parts, f"{t}zone": zone, f"{t}order": date_order, f"{t}codes": codes})
    unread = F.array(*[F.lit("")] * (len(_PARTS) + 1))
    df = df.withColumn(f"{t}p", F.when((F.size(f"{t}p") == len(_PARTS) + 1) & (F.get(f"{t}p", F.lit(0)) == "\x01"), F.col(f"{t}p")).otherwise(unread))
    part = {k: F.nullif(F.get(f"{t}p", F.lit(i)), F.lit("")) for i, k in enumerate(_PARTS, 1)}
    number = lambda k: part[k].cast("int")
    mdy = F.coalesce(F.lower(F.trim(f"{t}order")) == "mdy", F.lit(False))
    month_name = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part["mon"])).cast("int")
    micros_of = lambda x: F.rpad(F.coalesce(x, F.lit("0")), 6, "0").cast("bigint")  # noqa: E731 rpad also cuts
    df = df.withColumns({
        f"{t}y": number("y"),
        f"{t}m": F.coalesce(number("m"), month_name, F.when(mdy, number("a")).otherwise(number("b"))),
        f"{t}d": F.coalesce(number("d"), F.when(mdy, number("b")).otherwise(number("a"))),
        f"{t}h0": number("h"), f"{t}half": F.lower(part["half"]), f"{t}n": number("n"), f"{t}s": F.coalesce(number("s"), F.lit(0)),
        f"{t}f": micros_of(part["f"]), f"{t}off": F.upper(part["off"]), f"{t}in": part["zone"], f"{t}let": F.upper(part["letters"]),
        f"{t}sign": F.when(part["sign"] == "-", F.lit(-1)).otherwise(F.lit(1)), f"{t}num": part["num"].cast("bigint"), f"{t}nf": part["nf"],
    }).drop(f"{t}p")
    c = lambda k: F.col(t + k)
    half_hour = F.when(c("half").isNull(), c("h0")).when(c("h0").between(1, 12), c("h0") % 12 + F.when(c("half") == "pm", 12).otherwise(0))
    leap = ((c("y") % 4 == 0) & (c("y") % 100 != 0)) | (c("y") % 400 == 0)
    last = F.when(c("m").isin(4, 6, 9, 11), 30).when(c("m") == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    digits = F.regexp_replace(c("off"), ":", "")
    hours, minutes = F.substring(digits, 2, 2).cast("int"), F.coalesce(F.nullif(F.substring(digits, 4, 2), F.lit("")).cast("int"), F.lit(0))
    signed = F.when(F.substring(digits, 1, 1) == "-", -1).otherwise(1) * (hours * 3600 + minutes * 60)
    stated = F.when(c("off") == "Z", 0).when(c("off").isNotNull(), F.when((hours <= 18) & (minutes < 60), signed)).when(
        c("in").isNull() & c("let").isNotNull(), F.element_at(c("codes"), c("let")))
    df = df.withColumns({f"{t}h": half_hour, f"{t}last": last, f"{t}fix": stated, f"{t}where": F.coalesce(c("in"), c("zone"))})
    valid = (c("y") >= 1) & c("m").between(1, 12) & c("d").between(1, c("last")) & c("h").between(0, 23) & c("n").between(0, 59) & c("s").between(0, 59)
    # Days since 1970-01-01 of a proleptic Gregorian date, counting years from March.
    years, months = f"({t}y - if({t}m <= 2, 1, 0))", f"(({t}m + 9) % 12)"
    days = F.expr(f"{years} * 365 + {years} div 4 - {years} div 100 + {years} div 400 + (153 * {months} + 2) div 5 + {t}d - 719469")
    df = df.withColumn(f"{t}local", F.when(valid, ((days.cast("bigint") * 24 + c("h")) * 60 + c("n")) * 60_000_000 + c("s") * 1_000_000 + c("f")))
    fixed = c("off").isNotNull() | (c("let").isNotNull() & c("in").isNull())
    usable = c("where").isNotNull() & (c("in").isNull() | c("in").isin(known))
    ruled = F.when(usable, F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(c("local")), c("where"))))
    counted = F.when(
        c("num") < MILLIS_FROM, c("num") * 1_000_000 + micros_of(c("nf"))
    ).otherwise(c("num") * 1000 + F.rpad(F.coalesce(c("nf"), F.lit("0")), 3, "0").cast("bigint"))
    counted = c("sign") * counted
    in_range = counted.between(-62_135_596_800_000_000, 253_402_300_799_999_999)
    value = F.when(c("num").isNotNull(), F.when(in_range, counted)).when(fixed, c("local") - c("fix") * F.lit(1_000_000).cast("bigint")).otherwise(ruled)
    made = df.withColumn(f"{t}out", value)
    kept = [x for x in made.columns if not x.startswith(t) and x != out]
    return made.select(*[F.col(f"`{x}`") for x in kept], F.col(f"{t}out").alias(out))
