"""Spreadsheet functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def round_up(x: Column, digits: int = 0) -> Column:
    scale = F.lit(10.0**digits)
    return F.signum(x) * F.ceil(F.abs(x) * scale) / scale


def round_down(x: Column, digits: int = 0) -> Column:
    scale = F.lit(10.0**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def mod(x: Column, y: Column) -> Column:
    """The remainder with the divisor's sign."""
    return x - y * F.floor(x / y)


def trim(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, " +", " "))


def if_error(x: Column, other: Column) -> Column:
    """For x built of try_ functions: their null is the error."""
    return F.coalesce(x, other)


def choose(index: Column, *values: Column) -> Column:
    out = F.lit(None)
    for k, v in enumerate(values, 1):
        out = F.when(index == k, v) if k == 1 else out.when(index == k, v)
    return out


def serial_date(x: Column) -> Column:
    """A date serial number (day 0: 1899-12-30) or a Y-M-D text as a date."""
    text = x.cast("string")
    return F.when(text.rlike(r"^\d+(\.\d+)?$"), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(text.try_cast("double")).cast("int"))).otherwise(F.try_to_date(text, "yyyy-M-d"))


def pmt(rate: Column, periods: Column, present: Column, future: Column | float = 0.0, due: int = 0) -> Column:
    future = future if isinstance(future, Column) else F.lit(future)
    growth = F.pow(1 + rate, periods)
    return F.when(rate == 0, -(present + future) / periods).otherwise(-(present * growth + future) * rate / ((1 + rate * due) * (growth - 1)))


def fv(rate: Column, periods: Column, payment: Column, present: Column | float = 0.0, due: int = 0) -> Column:
    present = present if isinstance(present, Column) else F.lit(present)
    growth = F.pow(1 + rate, periods)
    return F.when(rate == 0, -(present + payment * periods)).otherwise(-(present * growth + payment * (1 + rate * due) * (growth - 1) / rate))


def pv(rate: Column, periods: Column, payment: Column, future: Column | float = 0.0, due: int = 0) -> Column:
    future = future if isinstance(future, Column) else F.lit(future)
    growth = F.pow(1 + rate, periods)
    return F.when(rate == 0, -(future + payment * periods)).otherwise(-(future + payment * (1 + rate * due) * (growth - 1) / rate) / growth)


def nper(rate: Column, payment: Column, present: Column) -> Column:
    return F.when(rate == 0, -present / payment).otherwise(F.log(payment / (payment + present * rate)) / F.log(1 + rate))


def npv(rate: Column, flows: Column) -> Column:
    """flows: an array, the first one period from now."""
    return F.aggregate(F.transform(flows, lambda x, i: x / F.pow(1 + rate, i + 1)), F.lit(0.0), lambda a, x: a + x)


def sln(cost: Column, salvage: Column, life: Column) -> Column:
    return (cost - salvage) / life


def effect(rate: Column, periods: Column) -> Column:
    return F.pow(1 + rate / periods, periods) - 1


def left(x: Column, n: int = 1) -> Column:
    return F.substring(x, 1, n)


def mid(x: Column, start: int, n: int) -> Column:
    return F.substring(x, start, n)


def find(what: str, x: Column) -> Column:
    """FIND: the place (from 1) of a text in another, case and all; null (an error) if it isn't there."""
    place = F.instr(x, what)
    return F.when(place > 0, place)


def substitute(x: Column, old: str, new: str) -> Column:
    return F.replace(x, F.lit(old), F.lit(new))


def proper(x: Column) -> Column:
    """PROPER: letters behind anything that is no letter are capitals, all others aren't."""
    runs = F.regexp_extract_all(F.lower(x), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 20))), "")


def edate(x: Column, months: int) -> Column:
    return F.add_months(x, months)


def eomonth(x: Column, months: int) -> Column:
    return F.last_day(F.add_months(x, months))


def weekday(x: Column) -> Column:
    """1 (Sunday) to 7."""
    return F.dayofweek(x)


def networkdays(first: Column, last: Column) -> Column:
    """Working days from the first to the last date, both counted, without holidays; negative if they run backwards."""
    lo, hi = F.least(first, last), F.greatest(first, last)
    # days since a Monday: of each whole week five count, of the rest those before Saturday
    days = lambda d: F.date_diff(d, F.lit("1900-01-01").cast("date"))
    upto = lambda n: F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))
    n = upto(days(hi) + 1) - upto(days(lo))
    return F.when(first <= last, n).otherwise(-n).cast("int")


def number_format(x: Column, code: str) -> Column:
    """A number by a format code of digits: grouping (#,##0), decimals (0.00), per cent (0%), thousands (0,)."""
    body = code.rstrip("%").rstrip(",")
    scaled = x * 100 if code.endswith("%") else x / 1000 ** (len(code) - len(code.rstrip(",")))
    decimals = len(body.partition(".")[2])
    half_up = F.floor(F.abs(scaled) * 10**decimals + 0.5) / 10**decimals
    text = F.format_number(half_up, decimals)
    text = text if "," in body else F.replace(text, F.lit(","), F.lit(""))
    return F.concat(F.when((scaled < 0) & (half_up != 0), "-").otherwise(""), text, F.lit("%" if code.endswith("%") else ""))


@F.pandas_udf(DoubleType())
def rate(periods: pd.Series, payment: pd.Series, present: pd.Series) -> pd.Series:
    """RATE of a loan of ``present`` paid off by ``payment`` in ``periods``: bisection of all rows of a batch at once; null if there is none."""
    n, p, v = (x.to_numpy(float) for x in (periods, payment, present))

    def worth(r: np.ndarray) -> np.ndarray:
        growth = (1 + r) ** n
        with np.errstate(all="ignore"):
            return np.where(np.abs(r) < 1e-12, v + p * n, v * growth + p * (growth - 1) / np.where(r == 0, 1, r))

    return pd.Series(_bisect(worth, np.full(len(n), -0.99), np.full(len(n), 10.0)))


def _bisect(worth: Callable[[np.ndarray], np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where ``worth`` is nothing between lo and hi, for many at once; NaN where its ends have one sign."""
    first = worth(lo)
    bracket = first * worth(hi) <= 0
    for _ in range(100):
        middle = (lo + hi) / 2
        below = first * worth(middle) <= 0
        lo, hi = np.where(below, lo, middle), np.where(below, middle, hi)
    return np.where(bracket, (lo + hi) / 2, np.nan)


@F.pandas_udf(DoubleType())
def irr(flows: pd.Series) -> pd.Series:
    """The rate at which an array of flows, the first one now, is worth nothing; null if no bracket holds one."""
    rows = [np.asarray([] if x is None else x, float) for x in flows]
    wide = np.zeros((len(rows), max(map(len, rows), default=0)))
    for k, x in enumerate(rows):
        wide[k, : len(x)] = x
    power = np.arange(wide.shape[1])
    worth = lambda r: (wide / (1 + r)[:, None] ** power).sum(axis=1)
    found = _bisect(worth, np.full(len(rows), -0.99), np.full(len(rows), 10.0))
    short = np.array([len(x) < 2 for x in rows], bool)
    return pd.Series(np.where(short, np.nan, found)).astype(object).where(lambda x: x.notna(), None)
