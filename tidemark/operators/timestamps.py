"""Texts in many timestamp formats become one UTC instant in epoch microseconds.

An ordered cascade of anchored patterns rewrites each text into one canonical form
of nine fields; a strict reading of these fields follows. Everything is a Catalyst
expression, so the work stays in the JVM and needs no shuffle but the (small) lookup
of a source's default zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Offsets in minutes of zone abbreviations, in their North American or European sense.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "IST": 60,
    "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "MET": 60, "MEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240,
    "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "HDT": -540,
    "JST": 540, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}
# The English months.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

_ZONE = r"(Z|[A-Z]{2,5}|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|[A-Z][A-Za-z_]+(?:/[A-Za-z_+-]+)+)"
_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
#: hour, minute, second, fraction, half of the day
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AP])\.?M\.?)?"
_TAIL = rf"(?:\s*\[?{_ZONE}\]?)?$"
#: what may stand around a text
_AROUND = ' \t\n\x0b\f\r\u00a0"'

#: (pattern, replacement) in order. The replacement is year|month|day|hour|minute|second|fraction|half|zone.
_CASCADE = [
    (rf"(?i)^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:\s*T\s*|\s+){_TIME}{_TAIL}", "$1|$3|$4|$5|$6|$7|$8|$9|$10"),
    (rf"(?i)^(\d{{4}})(\d{{2}})(\d{{2}})[T ](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_TAIL}", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"(?i)^{_WEEKDAY}(\d{{1,2}})[-/ .]+{_MONTH}[-/ ,]+(\d{{4}}|\d{{2}})(?:[:T]|,?\s+){_TIME}{_TAIL}", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"(?i)^{_WEEKDAY}{_MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{_TIME}{_TAIL}", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"(?i)^{_WEEKDAY}{_MONTH}\s+(\d{{1,2}})\s+{_TIME}(?:\s+{_ZONE})?\s+(\d{{4}})$", "$9|$1|$2|$3|$4|$5|$6|$7|$8"),
    (rf"(?i)^{_WEEKDAY}{_MONTH}\s+(\d{{1,2}}),?\s+{_TIME}{_TAIL}", "|$1|$2|$3|$4|$5|$6|$7|$8"),
]
_NUMERIC = rf"(?i)^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?:\s*T\s*|,?\s+){_TIME}{_TAIL}"
_REST = "|$5|$6|$7|$8|$9|$10"


def _canonical(text: Column, order: Column) -> Column:
    found = F.lit(None).cast("string")
    ymd = F.when(
        F.length(F.regexp_extract(text, _NUMERIC, 4)) == 4, F.regexp_replace(text, _NUMERIC, "$4|$1|$3" + _REST)
    ).otherwise(F.regexp_replace(text, _NUMERIC, "$1|$3|$4" + _REST))
    numeric = F.when(
        order == "mdy", F.regexp_replace(text, _NUMERIC, "$4|$1|$3" + _REST)
    ).when(order == "ymd", ymd).when(order == "dmy", F.regexp_replace(text, _NUMERIC, "$4|$3|$1" + _REST))
    found = F.when(text.rlike(_NUMERIC), numeric)
    for pattern, replacement in reversed(_CASCADE):
        found = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, replacement)).otherwise(found)
    return found


def _bare_number(text: Column) -> Column:
    """Epoch seconds, or finer units by the number of digits before the point; digits beyond microseconds are cut off."""
    before, after = F.substring_index(text, ".", 1), F.split_part(text, F.lit("."), F.lit(2))
    whole = F.length(before)
    # cut as text, because a cast would round
    value = F.concat(before, F.lit("."), F.rpad(F.substring(after, 1, 9), 9, "0")).try_cast("decimal(31,9)")
    scale = F.when(whole == 13, F.lit(1000)).when(whole == 16, F.lit(1)).otherwise(F.lit(1000000))
    micros = F.when(whole == 19, F.floor(value / 1000)).otherwise(F.floor(value * scale))
    return micros.try_cast("bigint")


def _offset_minutes(zone: Column) -> Column:
    """Minutes east of UTC that an abbreviation or offset names; null for anything else."""
    upper = F.upper(zone)
    table = F.create_map(*[F.lit(x) for pair in ZONE_MINUTES.items() for x in pair])
    shape = r"^(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?$"
    hours, minutes = (F.regexp_extract(upper, shape, k).try_cast("int") for k in (2, 3))
    minutes = F.coalesce(minutes, F.lit(0))
    offset = F.when(F.regexp_extract(upper, shape, 1) == "-", -(hours * 60 + minutes)).otherwise(hours * 60 + minutes)
    return F.coalesce(F.try_element_at(table, upper), F.when(upper.rlike(shape) & (hours <= 18) & (minutes < 60), offset))


def normalize_timestamps(df: DataFrame, text: str, received: str, tz: str, order: str, out: str = "epoch_us") -> DataFrame:
    """`df` with one more column `out` (bigint): the instant that `text` names.

    text: the timestamps as text; received: a timestamp column near which an instant
    without a year lies; tz: an IANA zone for texts without zone; order: dmy, mdy or
    ymd for numeric dates that don't start with a four-digit year.

    Policies: an instant that occurs twice on the wall clock means the earlier one; a
    skipped one is read with the offset before the change; digits beyond microseconds
    are cut off; missing seconds are zero; two-digit years are 20xx.

    Null for: null, empty or blank text, text in no known format (however long),
    impossible dates and times, a zone-less text whose `tz` is null or unknown, a numeric date whose
    `order` is null, a year-less text whose `received` is null. Rows keep their number
    and order of columns; an existing column named `out` is replaced.
    """
    raw = F.btrim(F.col(f"`{text}`"), F.lit(_AROUND))
    names = {k: f"__ts_{k}" for k in ("raw", "parts", "y", "mo", "d", "h", "mi", "s", "zone", "off", "us")}
    c = {k: F.col(v) for k, v in names.items()}
    columns = [F.col(f"`{x}`") for x in df.columns if x != out]

    part = lambda k: F.get(c["parts"], F.lit(k))
    number = lambda k: part(k).try_cast("int")
    month = F.when(part(1).rlike(r"^\d"), number(1)).otherwise(
        F.try_element_at(F.create_map(*[x for k, m in enumerate(MONTHS) for x in (F.lit(m[:3]), F.lit(k + 1))]), F.lower(F.substring(part(1), 1, 3)))
    )
    half, hour = F.upper(part(7)), number(3)
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "P", 12).otherwise(0))
    second = F.concat(F.when(part(5) == "", "00").otherwise(part(5)), F.lit("."), F.rpad(F.substring(part(6), 1, 6), 6, "0")).try_cast("decimal(8,6)")
    year = F.when(F.length(part(0)) == 2, number(0) + 2000).otherwise(number(0))

    def instant(y: Column) -> Column:
        # a minute of 60 or a second of 60 would pass as the next one
        possible = (c["mi"] < 60) & (c["s"] < 60) & (c["h"] < 24)
        with_offset = F.unix_micros(F.try_make_timestamp(
            y, c["mo"], c["d"], c["h"], c["mi"], c["s"], F.lit("UTC")
        )) - c["off"].cast("bigint") * 60_000_000
        with_zone = F.unix_micros(F.try_make_timestamp(y, c["mo"], c["d"], c["h"], c["mi"], c["s"], c["zone"]))
        return F.when(possible & c["off"].isNotNull(), with_offset).when(possible & c["zone"].isNotNull(), with_zone)

    at = F.col(f"`{received}`")
    # the nearest instant lies in the year before, the same or the next; a 29 February at most eight years away (around 2100)
    reach = F.when((c["mo"] == 2) & (c["d"] == 29), 8).otherwise(1)
    years = F.sequence(F.year(at) - reach, F.year(at) + reach)
    nearest = F.array_min(F.filter(
        F.transform(years, lambda y: F.struct(F.abs(instant(y) - F.unix_micros(at)).alias("far"), instant(y).alias("us"))),
        lambda x: x["us"].isNotNull()
    ))["us"]
    staged = (
        df.select(*columns, raw.alias(names["raw"]))
        .select("*", F.split(_canonical(c["raw"], F.lower(F.col(f"`{order}`"))), r"\|").alias(names["parts"]))
        .select(
            "*", year.alias(names["y"]), month.alias(names["mo"]), number(2).alias(names["d"]), hour.alias(names["h"]),
            number(4).alias(names["mi"]), second.alias(names["s"]), F.nullif(part(8), F.lit("")).alias("__ts_text_zone")
        )
        .select(
            "*",
            _offset_minutes(F.col("__ts_text_zone")).alias(names["off"]),
            # an unknown zone in the text names no instant, so the default must not step in
            F.when(F.col("__ts_text_zone").isNull(), F.col(f"`{tz}`")).when(F.col("__ts_text_zone").contains("/"), F.col("__ts_text_zone")).alias(names["zone"]),
        )
    )
    us = F.when(c["raw"].rlike(r"^\d+(\.\d+)?$"), _bare_number(c["raw"])).when(
        c["parts"].isNotNull(), F.when(c["y"].isNotNull(), instant(c["y"])).when(at.isNotNull(), nearest)
    )
    # the id is never negative: as it is not deterministic, it keeps a filter on the result from being pushed below, which would repeat the whole cascade
    return staged.select(*columns, F.when(F.monotonically_increasing_id() >= 0, us).alias(out))
