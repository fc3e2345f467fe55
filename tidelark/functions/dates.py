"""Business days, tenors, futures dates and coupon schedules, as columns: no calendar is joined, so that any date has its answer."""

from __future__ import annotations

import calendar
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .numeric import let

#: Month letters of futures codes.
MONTH_LETTERS = {"F": 1, "G": 2, "H": 3, "J": 4, "K": 5, "M": 6, "N": 7, "Q": 8, "U": 9, "V": 10, "X": 11, "Z": 12}


def act_360(a: Column, b: Column) -> Column:
    return F.datediff(b, a) / 360.0


def act_365(a: Column, b: Column) -> Column:
    return F.datediff(b, a) / 365.0


def nth_weekday(first: Column, weekday: int, n: int) -> Column:
    """The n-th weekday (Monday 0) of the month that begins on `first`."""
    return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))


def last_weekday(first: Column, weekday: int) -> Column:
    end = F.last_day(first)
    return F.date_sub(end, F.pmod(F.weekday(end) - weekday, F.lit(7)))


def third_wednesday(d: Column) -> Column:
    """The quarterly futures date of d's month."""
    return nth_weekday(F.trunc(d, "MM"), 2, 3)


def us_holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(holiday): US federal holidays; fixed days move from Sunday to Monday and from Saturday to Friday."""
    y = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y"))
    day = lambda m, d: F.make_date("y", F.lit(m), F.lit(d))
    fixed = F.array(day(1, 1), day(6, 19), day(7, 4), day(11, 11), day(12, 25))
    moved = F.transform(fixed, lambda d: F.when(F.weekday(d) == 6, F.date_add(d, 1)).when(F.weekday(d) == 5, F.date_sub(d, 1)).otherwise(d))
    floating = F.array(nth_weekday(day(1, 1), 0, 3), nth_weekday(day(2, 1), 0, 3), last_weekday(day(5, 1), 0), nth_weekday(day(9, 1), 0, 1), nth_weekday(day(10, 1), 0, 2), nth_weekday(day(11, 1), 3, 4))
    return y.select(F.explode(F.concat(moved, floating)).alias("holiday")).distinct()


#: Holidays by date, as month * 100 + day, and the days that those by weekday fall on.
FIXED_HOLIDAYS = (101, 619, 704, 1111, 1225)
FIXED_AFTER, FIXED_BEFORE = (102, 620, 705, 1112, 1226), (1231, 618, 703, 1110, 1224)
MONDAY_HOLIDAYS, THURSDAY_HOLIDAY = ((115, 121), (215, 221), (525, 531), (901, 907), (1008, 1014)), (1122, 1128)



def _is_open(weekday: int, md: int) -> bool:
    between = any(a <= md <= z for a, z in MONDAY_HOLIDAYS)
    holiday = md in FIXED_HOLIDAYS or (weekday == 0 and (between or md in FIXED_AFTER)) or (weekday == 3 and THURSDAY_HOLIDAY[0] <= md <= THURSDAY_HOLIDAY[1]) or (weekday == 4 and md in FIXED_BEFORE)
    return weekday < 5 and not holiday


def _tables() -> tuple[bytes, bytes, bytes]:
    """For each weekday (Monday 0), month and day: 1 on business days, and the days to the next and from the last, as letters.

    The 29th of February is no holiday and no neighbour of one, so that a year's length makes no difference.
    """
    every = [(w, date(2000, 1, 1) + timedelta(k)) for w in range(7) for k in range(366)]
    run = lambda w, d, sign: next(k for k in range(1, 9) if _is_open((w + sign * k) % 7, (d + timedelta(sign * k)).month * 100 + (d + timedelta(sign * k)).day))
    out = [bytearray(7 * 372) for _ in range(3)]
    for w, d in every:
        at = (w * 12 + d.month - 1) * 31 + d.day - 1
        out[0][at] = 48 + _is_open(w, d.month * 100 + d.day)
        out[1][at], out[2][at] = 48 + run(w, d, 1), 48 + run(w, d, -1)
    return tuple(map(bytes, out))


_OPEN, _NEXT, _LAST = _tables()


def _entry(table: bytes, d: Column) -> Column:
    at = (F.weekday(d) * 12 + F.month(d) - 1) * 31 + F.dayofmonth(d)
    return F.ascii(F.substring(F.lit(table), at, F.lit(1)).cast("string")) - 48


def is_business_day(d: Column) -> Column:
    """Neither a weekend nor a US federal holiday, as us_holidays lists them: one look into a constant, as for the days around it."""
    return _entry(_OPEN, d) == 1


def next_business_day(d: Column) -> Column:
    return F.date_add(d, _entry(_NEXT, d))


def previous_business_day(d: Column) -> Column:
    return F.date_sub(d, _entry(_LAST, d))


def modified_following(d: Column) -> Column:
    """d, or the next business day, or the one before if that is in another month."""
    return F.when(is_business_day(d), d).otherwise(let(next_business_day(d), lambda after: F.when(F.month(after) == F.month(d), after).otherwise(previous_business_day(d))))


def business_calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(d, is_bd, next_bd, prev_bd, mf): one row a day of the years; next and previous are strict, mf is modified following."""
    begin = F.make_date(F.lit(first_year), F.lit(1), F.lit(1))
    n = spark.range(1).select(F.datediff(F.make_date(F.lit(last_year), F.lit(12), F.lit(31)), begin)).first()[0] + 1
    d = spark.range(n).select(F.date_add(begin, F.col("id").cast("int")).alias("d"))
    c = F.col("d")
    return d.select("d", is_business_day(c).alias("is_bd"), next_business_day(c).alias("next_bd"), previous_business_day(c).alias("prev_bd"), modified_following(c).alias("mf"))


def add_tenor(base: Column, tenor: Column) -> Column:
    """base plus a tenor such as 1B, 2W, 3M, 5Y or 10D; months end at the month's end, days aren't adjusted.

    A tenor of another form gives NULL.
    """
    n = F.substring(tenor, F.lit(1), F.length(tenor) - 1).try_cast("int")
    unit = F.upper(F.substring(F.trim(tenor), -1, 1))
    raw = F.when(unit == "Y", F.add_months(base, 12 * n)).when(unit == "M", F.add_months(base, n)).when(unit == "W", F.date_add(base, 7 * n))
    return F.when((unit == "B") & (n == 1), next_business_day(base)).when(unit == "D", F.date_add(base, n)).when(raw.isNotNull(), let(raw, modified_following))


def futures_dates(code: Column, as_of: Column) -> Column:
    """Struct (start, end) of a quarterly rate future such as SOFR3H6: from its month's third Wednesday to that three months on.

    The year's last digit stands for the first decade, from this one on, in which the contract has not ended.
    """
    tail = F.regexp_replace(code, "^SOFR3", "")
    letters = F.create_map(*(F.lit(x) for p in MONTH_LETTERS.items() for x in p))
    month, digit = letters[F.substring(tail, 1, 1)], F.substring(tail, 2, 4).try_cast("int")
    decade = F.floor(F.year(as_of) / 10).cast("int") * 10
    start = lambda k: third_wednesday(F.make_date(decade + digit + 10 * k, month, F.lit(1)))
    end = lambda k: third_wednesday(F.add_months(F.trunc(start(k), "MM"), 3))
    pick = F.when(end(0) >= as_of, F.struct(start(0).alias("start"), end(0).alias("end"))).otherwise(F.struct(start(1).alias("start"), end(1).alias("end")))
    return F.when(month.isNotNull() & digit.isNotNull(), pick)


def annual_schedule(df: DataFrame, effective: str, maturity: str) -> DataFrame:
    """df exploded into (coupon_no, coupon_date): every year from effective, adjusted, up to maturity, which ends the schedule."""
    d = df.withColumn("coupon_no", F.explode(F.sequence(F.lit(1), F.ceil(F.months_between(maturity, effective) / 12).cast("int") + 1)))
    year = lambda k: modified_following(F.add_months(effective, 12 * k))
    d = d.where((F.col("coupon_no") == 1) | (year(F.col("coupon_no") - 1) < F.col(maturity)))  # the first date not before maturity closes the schedule
    return d.withColumn("coupon_date", F.least(year(F.col("coupon_no")), F.col(maturity)))


def backward_schedule(maturity: Column, settlement: Column, months: int = 6) -> Column:
    """Coupon dates after settlement, ascending: chained steps back from maturity, so that a day cut at a month's end stays cut."""
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.months_between(maturity, settlement) / months).cast("int") + 1))
    chain = F.aggregate(
        steps,
        F.array(maturity),
        lambda a, _: F.when(F.add_months(F.element_at(a, -1), -months) > settlement, F.concat(a, F.array(F.add_months(F.element_at(a, -1), -months)))).otherwise(a),
    )
    return F.when(maturity > settlement, F.reverse(chain)).otherwise(F.array().cast("array<date>"))


# The same rules of plain dates, for tasks that find a trade date's grid once for all its curves.


def _day_entry(table: bytes, d: date) -> int:
    return table[(d.weekday() * 12 + d.month - 1) * 31 + d.day - 1] - 48


def next_business_date(d: date) -> date:
    return d + timedelta(_day_entry(_NEXT, d))


def previous_business_date(d: date) -> date:
    return d - timedelta(_day_entry(_LAST, d))


def months_on(d: date, n: int) -> date:
    """As add_months: cut at the month's end."""
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    return date(y, m + 1, min(d.day, calendar.monthrange(y, m + 1)[1]))


def modified_following_date(d: date) -> date:
    if _day_entry(_OPEN, d) == 1:
        return d
    after = next_business_date(d)
    return after if after.month == d.month else previous_business_date(d)


def tenor_date(base: date, tenor: str) -> date:
    """base plus a whole number of days, weeks, months or years, as add_tenor."""
    n, unit = int(tenor[:-1]), tenor[-1]
    if unit == "D":
        return base + timedelta(n)
    return modified_following_date(base + timedelta(7 * n) if unit == "W" else months_on(base, n * (12 if unit == "Y" else 1)))


def annual_dates(effective: date, maturity: date) -> list[date]:
    """The coupon dates of annual_schedule."""
    out, k = [], 1
    while not out or out[-1] < maturity:
        out.append(min(modified_following_date(months_on(effective, 12 * k)), maturity))
        k += 1
    return out
