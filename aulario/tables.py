"""The ten related tables every operator works on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROOM = ["nombre_sala", "edificio"]
SLOT = ["nombre_sala", "edificio", "fecha", "id_turno"]
# Partition column of bookings stored by month; a column of the scan, never of the state.
MONTH = "mes"


class Tables:
    """The tables as lazy DataFrames; operators never read files themselves.

    A table is given as a DataFrame or as a function that opens it. Functions are called
    when the table is first used, so an operator does not pay for the ones it ignores.
    """

    facultad: DataFrame
    programa_academico: DataFrame
    participante: DataFrame
    participante_programa_academico: DataFrame
    edificio: DataFrame
    sala: DataFrame
    turno: DataFrame
    reserva: DataFrame
    reserva_participante: DataFrame
    sancion_participante: DataFrame

    def __init__(
        self,
        *,
        reserva_mensual: Callable[[], DataFrame] | None = None,
        **tables: DataFrame | Callable[[], DataFrame],
    ):
        """``reserva_mensual`` opens the stored bookings with their month, for pruned reads."""
        if set(tables) != set(self.names()):
            raise ValueError(f"expected exactly the tables {', '.join(self.names())}")
        self._by_month = reserva_mensual
        self._openers = {n: t for n, t in tables.items() if not isinstance(t, DataFrame)}
        self.__dict__.update({n: t for n, t in tables.items() if isinstance(t, DataFrame)})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._openers:
            raise AttributeError(name)
        self.__dict__[name] = self._openers[name]()
        return self.__dict__[name]

    def with_tables(self, **changed: DataFrame) -> Tables:
        unchanged = {
            n: self.__dict__[n] if n in self.__dict__ else self._openers[n] for n in self.names()
        }
        by_month = None if "reserva" in changed else self._by_month
        return Tables(reserva_mensual=by_month, **{**unchanged, **changed})

    def reserva_since(self, first: Column) -> DataFrame:
        """Bookings from a date on. Of those stored by month, unchanged since, only the months
        needed are read."""
        if self._by_month is None:
            return self.reserva.filter(F.col("fecha") >= first)
        needed = F.col(MONTH) >= F.date_format(first, "yyyy-MM")
        return self._by_month().filter(needed & (F.col("fecha") >= first)).drop(MONTH)

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, getattr(self, name)) for name in self.names()]

    @classmethod
    def names(cls) -> list[str]:
        return list(Tables.__annotations__)
