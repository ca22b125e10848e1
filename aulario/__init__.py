"""Room-booking analytics as Spark DataFrame operators."""

from aulario.tables import Tables

__all__ = ["Tables"]
