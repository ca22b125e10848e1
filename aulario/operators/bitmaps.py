"""Exact distinct counts that are kept and added up, month by month.

Numbers that a database gives out one after the other are dense, so a set of them is small as bits: 32,768 numbers share
a bucket, and the members of a group in a bucket are a bitmap of 4 KB. Bitmaps of the same group and bucket merge by OR,
so the sets of closed months are stored once and a report over any span reads them, together with those of the open
month, instead of the facts. Worth storing where a group has more than about 300 members per bucket; below that the
plain pairs of the reports are smaller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aulario.functions.scalar import user_type
from aulario.tables import Tables


def member_bitmaps(pairs: DataFrame, group: list[str], member: str) -> DataFrame:
    """(group, ``tramo``, ``bits``): the members of each group as one bitmap for each bucket of numbers.

    ``member`` is a positive whole number; rows without one are left out. Repeated pairs count once. Bitmaps are formed
    inside map tasks, so what is shuffled is at most one bitmap per task, group and bucket, and no pairs.
    """
    number = F.col(member).cast("long")
    return (
        pairs.filter(number.isNotNull())
        .groupBy(*group, F.bitmap_bucket_number(number).alias("tramo"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
    )


def merged(bitmaps: DataFrame, group: list[str]) -> DataFrame:
    """The union of the sets of each group."""
    return bitmaps.groupBy(*group, "tramo").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_count(bitmaps: DataFrame, group: list[str], name: str) -> DataFrame:
    """(group, ``name``): how many members each group has; the sets may come in parts."""
    return merged(bitmaps, group).groupBy(*group).agg(F.sum(F.bitmap_count("bits")).alias(name))


def month_of(date: str) -> Column:
    return F.date_format(date, "yyyy-MM").alias("mes")


def _booked_pairs(t: Tables) -> DataFrame:
    """Participations of existing bookings with the month of the booking."""
    dated = t.reserva.select("id_reserva", month_of("fecha"))
    return t.reserva_participante.select("ci_participante", "id_reserva").join(dated, "id_reserva")


def monthly_bookings_by_programme(t: Tables) -> DataFrame:
    """(nombre_programa, mes, tramo, bits): the bookings each programme took part in, to be stored by month."""
    enrolled = t.participante_programa_academico.select("ci_participante", "nombre_programa")
    pairs = _booked_pairs(t).join(enrolled, "ci_participante")
    return member_bitmaps(pairs, ["nombre_programa", "mes"], "id_reserva")


def monthly_bookings_by_user_type(t: Tables) -> DataFrame:
    """(tipo_usuario, mes, tramo, bits): the bookings people of each type took part in, to be stored by month."""
    enrolled = t.participante_programa_academico.join(t.programa_academico, "nombre_programa")
    typed = enrolled.select("ci_participante", user_type().alias("tipo_usuario"))
    return member_bitmaps(_booked_pairs(t).join(typed, "ci_participante"), ["tipo_usuario", "mes"], "id_reserva")


def bookings_in_months(bitmaps: DataFrame, group: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """(group, total_reservas): distinct bookings of the months from ``first`` to ``last`` (yyyy-MM, both included)."""
    span = bitmaps
    if first is not None:
        span = span.filter(F.col("mes") >= first)
    if last is not None:
        span = span.filter(F.col("mes") <= last)
    return distinct_count(span, [group], "total_reservas")
