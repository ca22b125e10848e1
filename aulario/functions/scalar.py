"""Column expressions shared by the operators. All of them stay inside codegen."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

Date = dt.date | str


def day(value: Date | Column) -> Column:
    """A reference date as a DATE column."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def pct2(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` to two decimals, halves away from zero, NULL for an empty whole.

    The rounding is done on integers: rounding a DOUBLE would depend on its binary
    representation, and a DECIMAL would overflow or lose scale on large counts.
    """
    whole = F.nullif(whole.cast("bigint"), F.lit(0).cast("bigint"))
    scaled = part.cast("bigint") * F.lit(20000).cast("bigint") + whole
    return F.call_function("div", scaled, whole * F.lit(2)) / F.lit(100.0)


def rounded_mean(total: Column, n: Column) -> Column:
    """``total / n`` to the nearest whole number, halves up, NULL when there is nothing to average."""
    n = F.nullif(n.cast("bigint"), F.lit(0).cast("bigint"))
    return F.call_function("div", total.cast("bigint") * F.lit(2) + n, n * F.lit(2))


def mean1(total: Column, n: Column) -> Column:
    """``total / n`` to one decimal, 0 when there is nothing to average."""
    n = F.nullif(n.cast("bigint"), F.lit(0).cast("bigint"))
    tenths = F.call_function("div", total.cast("bigint") * F.lit(20) + n, n * F.lit(2))
    return F.coalesce(tenths / F.lit(10.0), F.lit(0.0))


def week_start(date: Column) -> Column:
    """Monday of the week of ``date``."""
    return F.date_sub(date, F.weekday(date))


def _week_year(date: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), date)


def year_week(date: Column) -> Column:
    """ISO week as ``YYYYWW``; the year is the one the week belongs to."""
    return (_week_year(date) * 100 + F.weekofyear(date)).cast("int")


def week_in_year(date: Column) -> Column:
    """Week number 0..53 that stays inside the calendar year of ``date``.

    Days before the first ISO week count as week 0, days that already belong to
    the first week of the next year count as week 53.
    """
    return (
        F.when(_week_year(date) < F.year(date), F.lit(0))
        .when(_week_year(date) > F.year(date), F.lit(53))
        .otherwise(F.weekofyear(date))
    )


def slot_label(start: str = "hora_inicio", end: str = "hora_fin") -> Column:
    return F.concat(F.col(start), F.lit(" - "), F.col(end))


def full_name(first: str = "nombre", last: str = "apellido") -> Column:
    return F.concat_ws(" ", F.col(first), F.col(last))


def room_label(room: str = "nombre_sala", building: str = "edificio") -> Column:
    return F.concat(F.col(room), F.lit(" ("), F.col(building), F.lit(")"))


def status_caption(col: str = "estado") -> Column:
    return F.upper(F.col(col))


def room_type_caption(col: str = "tipo_sala") -> Column:
    """First letter in upper case, the rest in lower case."""
    c = F.col(col)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1_000_000)))


def user_type(role: str = "rol", programme_type: str = "tipo") -> Column:
    return (
        F.when(F.col(role) == "docente", "Docente")
        .when(F.col(programme_type) == "posgrado", "Alumno Posgrado")
        .otherwise("Alumno Grado")
    )


def short_user_type(label: str = "tipo_usuario") -> Column:
    """The student labels without the leading 'Alumno '."""
    return F.regexp_replace(F.col(label), "^Alumno ", "")


def in_force(as_of: Date | Column, start: str = "fecha_inicio", end: str = "fecha_fin") -> Column:
    return day(as_of).between(F.col(start), F.col(end))


def sanction_state(as_of: Date, start: str = "fecha_inicio", end: str = "fecha_fin") -> Column:
    return (
        F.when(in_force(as_of, start, end), "ACTIVA")
        .when(day(as_of) > F.col(end), "FINALIZADA")
        .otherwise("FUTURA")
    )


def severity(pct: str = "porcentaje_cancelacion") -> Column:
    """Traffic light of a cancellation percentage."""
    return F.when(F.col(pct) > 20, "danger").when(F.col(pct) > 10, "warning").otherwise("success")
