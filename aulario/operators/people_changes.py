"""Batch changes of participants and their enrolments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulario.operators import rules
from aulario.operators.changes import (
    ID,
    ORDER,
    ChangeResult,
    assign_ids,
    cut,
    delete_rows,
    first_reason,
    insert_rows,
    mark_first,
    split,
    turn,
    update_rows,
)
from aulario.operators.rules import CI, mark
from aulario.operators.sequencing import Limit, admit_in_order
from aulario.sources.schemas import ROLES
from aulario.tables import Tables


def normal_role(column: str = "rol") -> F.Column:
    """The forms call a student 'estudiante'; the tables say 'alumno'."""
    return F.when(F.col(column) == "estudiante", "alumno").otherwise(F.col(column))


def register_participants(people: DataFrame, t: Tables) -> ChangeResult:
    """Load participants with their first enrolment, in request order.

    Identity number and email must each be new: not in the state and not taken by a
    request accepted earlier. A refused request takes neither.
    """
    columns = people.columns
    required = ["ci", "nombre", "apellido", "email", "nombre_programa", "rol"]
    judged = rules.complete(people.withColumn("rol", normal_role()), required)
    judged = mark(judged, t.participante, ["ci"], "ci_usada")
    judged = mark(judged, t.participante, ["email"], "email_usado")
    judged = rules.exists_in(
        judged, t.programa_academico, {"nombre_programa": "nombre_programa"}, "hay_programa"
    )
    judged = cut(
        judged.withColumn("libre", F.lit(1)).withColumn(
            "motivo",
            first_reason(
                ("datos_incompletos", F.col("completa")),
                ("ya_registrado", ~F.col("ci_usada") & ~F.col("email_usado")),
                ("programa_inexistente", F.col("hay_programa")),
                ("rol_invalido", F.col("rol").isin(ROLES)),
            ),
        )
    )
    granted = admit_in_order(
        judged.filter(F.col("motivo").isNull()).withColumn("libre_email", F.col("libre")),
        [Limit(["ci"], "libre", 1), Limit(["email"], "libre_email", 1)],
    )
    judged = mark(judged, granted, [ID], "concedida").withColumn(
        "motivo", F.coalesce("motivo", F.when(~F.col("concedida"), "ya_registrado"))
    )
    _, rejected = split(judged, *columns)
    accepted = assign_ids(
        granted.select(*columns).withColumn(CI, F.col("ci")),
        t.participante_programa_academico,
        "id_alumno_programa",
        ORDER,
    )
    tables = t.with_tables(
        participante=insert_rows(t.participante, accepted),
        participante_programa_academico=insert_rows(t.participante_programa_academico, accepted),
    )
    touched = {
        "participante": accepted.select("ci"),
        "participante_programa_academico": accepted.select("id_alumno_programa"),
    }
    return ChangeResult(tables, accepted, rejected, touched)


def update_participants(changes: DataFrame, t: Tables) -> ChangeResult:
    """Change names and emails.

    Emails are judged against the state before the batch: one that another participant has
    is refused, even when that participant changes it in the same batch. An email goes to
    the participant who first asks for it and stays theirs for the batch. Of several granted
    changes of a participant the last counts; a refused one replaces nothing.
    """
    columns = changes.columns
    judged = mark(changes, t.participante, ["ci"], "existe")
    # Several holders of one email are an error in the state; a row each would repeat requests.
    holders = (
        t.participante.join(changes.select("email"), "email", "left_semi")
        .groupBy("email")
        .agg(F.min("ci").alias("titular"), F.max("ci").alias("otro_titular"))
    )
    own = (F.col("titular") == F.col("ci")) & (F.col("otro_titular") == F.col("ci"))
    judged = cut(
        judged.join(cut(holders), "email", "left").withColumn(
            "email_libre", F.col("titular").isNull() | own
        )
    )
    fit = F.col("existe") & F.col("email_libre")
    first = F.min(F.struct(turn().alias("turno"), F.col("ci"))).alias("p")
    takers = judged.filter(fit).groupBy("email").agg(first).select("email", F.col("p.ci").alias("dueno"))
    judged = judged.join(cut(takers), "email", "left").withColumn(
        "concedida", fit & F.coalesce(F.col("dueno") == F.col("ci"), F.lit(False))
    )
    judged = cut(judged)
    latest = judged.filter("concedida").groupBy("ci").agg(F.max(turn()).alias("t")).select(f"t.{ID}")
    judged = mark(judged, latest, [ID], "vigente").withColumn(
        "motivo",
        first_reason(
            ("participante_inexistente", F.col("existe")),
            ("email_registrado", F.col("email_libre") & F.col("concedida")),
            ("reemplazada", F.col("vigente")),
        ),
    )
    accepted, rejected = split(judged, *columns)
    updates = accepted.select("ci", "nombre", "apellido", "email")
    updated = update_rows(t.participante, updates, ["ci"])
    touched = {"participante": updates.select("ci")}
    return ChangeResult(t.with_tables(participante=updated), accepted, rejected, touched)


def delete_participants(asked: DataFrame, t: Tables) -> ChangeResult:
    """Delete participants without active bookings, with all their rows elsewhere."""
    columns = asked.columns
    free = rules.without_active_bookings(t, asked.select("ci").distinct())
    judged = mark(mark(asked, t.participante, ["ci"], "existe"), free, ["ci"], "sin_activas")
    judged = mark_first(judged, ["ci"], "primera").withColumn(
        "motivo",
        first_reason(
            ("con_reservas_activas", F.col("sin_activas")),
            ("participante_inexistente", F.col("existe") & F.col("primera")),
        ),
    )
    accepted, rejected = split(judged, *columns)
    gone = accepted.select("ci", F.col("ci").alias(CI))
    tables = t.with_tables(
        sancion_participante=delete_rows(t.sancion_participante, gone, [CI]),
        reserva_participante=delete_rows(t.reserva_participante, gone, [CI]),
        participante_programa_academico=delete_rows(t.participante_programa_academico, gone, [CI]),
        participante=delete_rows(t.participante, gone, ["ci"]),
    )
    touched = {
        name: gone.select(CI)
        for name in ("sancion_participante", "reserva_participante", "participante_programa_academico")
    }
    return ChangeResult(tables, accepted, rejected, touched | {"participante": gone.select("ci")})


ENROLMENT = [CI, "nombre_programa"]


def add_enrolments(requests: DataFrame, t: Tables) -> ChangeResult:
    """Enrol participants in programmes, once per programme."""
    columns = requests.columns
    judged = rules.complete(requests.withColumn("rol", normal_role()), ["nombre_programa", "rol"])
    judged = rules.exists_in(judged, t.participante, {CI: "ci"}, "existe")
    judged = rules.exists_in(
        judged, t.programa_academico, {"nombre_programa": "nombre_programa"}, "hay_programa"
    )
    judged = mark(judged, t.participante_programa_academico, ENROLMENT, "inscripto")
    judged = judged.withColumn("rol_valido", F.col("rol").isin(ROLES))
    fit = (
        F.col("completa")
        & F.col("existe")
        & F.col("hay_programa")
        & ~F.col("inscripto")
        & F.coalesce("rol_valido", F.lit(False))
    )
    judged = mark_first(judged, ENROLMENT, "primera", fit).withColumn(
        "motivo",
        first_reason(
            ("datos_incompletos", F.col("completa")),
            ("participante_inexistente", F.col("existe")),
            ("programa_inexistente", F.col("hay_programa")),
            ("rol_invalido", F.col("rol_valido")),
            ("ya_inscripto", ~F.col("inscripto") & F.col("primera")),
        ),
    )
    accepted, rejected = split(judged, *columns)
    created = assign_ids(accepted, t.participante_programa_academico, "id_alumno_programa", ORDER)
    enrolled = insert_rows(t.participante_programa_academico, created)
    tables = t.with_tables(participante_programa_academico=enrolled)
    touched = {"participante_programa_academico": created.select("id_alumno_programa")}
    return ChangeResult(tables, created, rejected, touched)


def remove_enrolments(requests: DataFrame, t: Tables) -> ChangeResult:
    columns = requests.columns
    judged = mark(requests, t.participante_programa_academico, ENROLMENT, "inscripto")
    judged = mark_first(judged, ENROLMENT, "primera").withColumn(
        "motivo", first_reason(("no_inscripto", F.col("inscripto") & F.col("primera")))
    )
    accepted, rejected = split(judged, *columns)
    kept = delete_rows(t.participante_programa_academico, accepted, ENROLMENT)
    tables = t.with_tables(participante_programa_academico=kept)
    touched = {"participante_programa_academico": accepted.select(*ENROLMENT)}
    return ChangeResult(tables, accepted, rejected, touched)
