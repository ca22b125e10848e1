"""Batch changes of rooms and buildings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulario.functions.scalar import Date
from aulario.operators import rules
from aulario.operators.changes import (
    ChangeResult,
    cut,
    delete_rows,
    first_reason,
    insert_rows,
    mark_first,
    shaped_like,
    split,
    update_rows,
)
from aulario.operators.rules import mark
from aulario.sources.schemas import ROOM_TYPES
from aulario.tables import ROOM, Tables

NEW_ROOM = ["nuevo_nombre_sala", "nuevo_edificio"]


def _valid_room() -> F.Column:
    return (
        F.col("nombre_sala").isNotNull()
        & (F.col("capacidad") > 0)
        & F.col("tipo_sala").isin(ROOM_TYPES)
    )


def create_rooms(requests: DataFrame, t: Tables) -> ChangeResult:
    """Create rooms in existing buildings; a name once per building."""
    columns = requests.columns
    judged = rules.exists_in(requests, t.edificio, {"edificio": "nombre_edificio"}, "hay_edificio")
    judged = mark(judged, t.sala, ROOM, "ya_existe").withColumn("valida", _valid_room())
    fit = F.col("hay_edificio") & F.coalesce("valida", F.lit(False)) & ~F.col("ya_existe")
    judged = mark_first(judged, ROOM, "primera", fit).withColumn(
        "motivo",
        first_reason(
            ("edificio_inexistente", F.col("hay_edificio")),
            ("datos_invalidos", F.col("valida")),
            ("sala_duplicada", ~F.col("ya_existe") & F.col("primera")),
        ),
    )
    accepted, rejected = split(judged, *columns)
    rooms = insert_rows(t.sala, accepted)
    return ChangeResult(t.with_tables(sala=rooms), accepted, rejected, {"sala": accepted.select(*ROOM)})


def update_rooms(changes: DataFrame, t: Tables, as_of: Date) -> ChangeResult:
    """Change rooms, including their name or building.

    Bookings refer to a room by name and building, so these may only change while the room
    has no bookings. A new name must be free before the batch and goes to the first request.
    """
    columns = changes.columns
    changes = cut(changes)
    renamed = (F.col("nuevo_nombre_sala") != F.col("nombre_sala")) | (
        F.col("nuevo_edificio") != F.col("edificio")
    )
    judged = rules.exists_in(
        changes, t.edificio, {"nuevo_edificio": "nombre_edificio"}, "hay_edificio"
    )
    judged = mark(judged, t.sala, ROOM, "existe")
    judged = rules.exists_in(
        judged, t.sala, dict(zip(NEW_ROOM, ROOM, strict=True)), "nombre_ocupado", changes
    )
    judged = (
        rules.room_deletion_blocks(t, judged, as_of, changes)
        .withColumn("cambia_nombre", renamed)
        .withColumn("valida", _valid_room())
    )
    fit = (
        F.col("hay_edificio")
        & F.col("existe")
        & F.coalesce("valida", F.lit(False))
        & ~(F.col("cambia_nombre") & (F.col("nombre_ocupado") | F.col("con_reservas")))
    )
    judged = mark_first(judged, ROOM, "primera", fit)
    judged = mark_first(judged, NEW_ROOM, "primera_con_nombre", fit & F.col("primera"))
    judged = judged.withColumn(
        "motivo",
        first_reason(
            ("edificio_inexistente", F.col("hay_edificio")),
            ("sala_inexistente", F.col("existe")),
            ("datos_invalidos", F.col("valida")),
            ("sala_duplicada", ~(F.col("cambia_nombre") & F.col("nombre_ocupado"))),
            ("con_reservas", ~(F.col("cambia_nombre") & F.col("con_reservas"))),
            ("repetida", F.col("primera")),
            ("sala_duplicada", F.col("primera_con_nombre")),
        ),
    )
    accepted, rejected = split(judged, *columns)
    updates = accepted.select(*ROOM, *NEW_ROOM, "capacidad", "tipo_sala")
    kept = update_rows(t.sala, updates.select(*ROOM, "capacidad", "tipo_sala"), ROOM)
    keys = updates.select(*ROOM, *NEW_ROOM)
    moved = kept.join(keys, ROOM, "left").select(
        F.coalesce("nuevo_nombre_sala", "nombre_sala").alias("nombre_sala"),
        F.coalesce("nuevo_edificio", "edificio").alias("edificio"),
        "capacidad",
        "tipo_sala",
    )
    after = keys.select(*[F.col(n).alias(c) for n, c in zip(NEW_ROOM, ROOM, strict=True)])
    touched = {"sala": keys.select(*ROOM).union(after).distinct()}
    return ChangeResult(t.with_tables(sala=shaped_like(t.sala, moved)), accepted, rejected, touched)


def delete_rooms(asked: DataFrame, t: Tables, as_of: Date) -> ChangeResult:
    """Delete rooms without active, future or past bookings."""
    columns = asked.columns
    judged = mark(rules.room_deletion_blocks(t, asked, as_of), t.sala, ROOM, "existe")
    judged = mark_first(judged, ROOM, "primera").withColumn(
        "motivo",
        first_reason(
            ("con_reservas_activas", ~F.col("con_activas")),
            ("con_reservas_futuras", ~F.col("con_futuras")),
            ("con_reservas", ~F.col("con_reservas")),
            ("sala_inexistente", F.col("existe") & F.col("primera")),
        ),
    )
    accepted, rejected = split(judged, *columns)
    kept = delete_rows(t.sala, accepted, ROOM)
    return ChangeResult(t.with_tables(sala=kept), accepted, rejected, {"sala": accepted.select(*ROOM)})


def create_buildings(requests: DataFrame, t: Tables) -> ChangeResult:
    """Create buildings; name, address and department are required, names are unique."""
    columns = requests.columns
    judged = rules.complete(requests, ["nombre_edificio", "direccion", "departamento"])
    judged = mark(judged, t.edificio, ["nombre_edificio"], "ya_existe")
    fit = F.col("completa") & ~F.col("ya_existe")
    judged = mark_first(judged, ["nombre_edificio"], "primera", fit).withColumn(
        "motivo",
        first_reason(
            ("datos_incompletos", F.col("completa")),
            ("edificio_duplicado", ~F.col("ya_existe") & F.col("primera")),
        ),
    )
    accepted, rejected = split(judged, *columns)
    buildings = insert_rows(t.edificio, accepted)
    touched = {"edificio": accepted.select("nombre_edificio")}
    return ChangeResult(t.with_tables(edificio=buildings), accepted, rejected, touched)
