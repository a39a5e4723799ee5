"""Dates in form text, and the term between two of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheetwright import constants as C


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def dates_in(text: Column) -> Column:
    """Dates written with a month name; if fewer than two, then those in digits too.  Impossible dates are skipped."""
    months = F.create_map(*[F.lit(x) for n, name in enumerate(C.MONTHS, 1) for x in (name, f"{n:02d}")])
    part = lambda pattern, n: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(n))
    named, digits = r"(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})", r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})"
    date = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    real = lambda dates: F.filter(dates, lambda d: d.isNotNull())
    words = real(F.transform(F.arrays_zip(part(named, 1), part(named, 2), part(named, 3)), lambda x: F.when(months[F.lower(x["1"])].isNotNull(), date(x["2"], months[F.lower(x["1"])], x["0"]))))
    year = lambda y: F.when(F.length(y) == 4, y).otherwise((F.lit(2000) + y.cast("int")).cast("string"))
    numbers = real(F.transform(F.arrays_zip(part(digits, 1), part(digits, 2), part(digits, 3)), lambda x: date(year(x["2"]), x["1"], x["0"])))
    return let(words, lambda w: F.when(F.size(w) < 2, F.concat(w, numbers)).otherwise(w))


def month_difference(a: Column, b: Column) -> Column:
    """Calendar months between two dates; days do not count."""
    return F.abs((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a))


def nearest_term(months: Column) -> Column:
    """The offered term within one month of ``months``, the smaller on a tie; null if none or no month lies between."""
    near = F.array_min(F.transform(F.array(*[F.lit(x) for x in C.TENORS]), lambda x: F.struct(F.abs(x - months).alias("d"), x.alias("term"))))
    return F.when((months > 0) & (near["d"] <= C.TENOR_TOLERANCE), near["term"])


def term_of_range(text: Column) -> Column:
    """struct(value, reason): the term between the first two dates of a text."""
    return let(dates_in(text), lambda found: let(month_difference(F.get(found, 0), F.get(found, 1)), lambda months: _term(text, found, months)))


def _term(text: Column, found: Column, months: Column) -> Column:
    value = F.when(F.size(found) >= 2, nearest_term(months))
    reason = (
        F.when(F.coalesce(text, F.lit("")) == "", "rentang_tenor_kosong")
        .when(F.size(found) < 2, "tidak_bisa_ekstrak_2_tanggal_dari_rentang_tenor")
        .when(months <= 0, "selisih_tanggal_tidak_valid")
        .when(value.isNull(), F.concat(F.lit("selisih_"), months.cast("string"), F.lit("_bulan_tidak_dekat_opsi_manapun")))
        .otherwise(F.concat(F.lit("derived_dari_rentang_tenor_"), months.cast("string"), F.lit("_bulan_kalender")))
    )
    return F.struct(value.alias("value"), reason.alias("reason"))
