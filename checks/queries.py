"""Registered queries: library operators over the mapped tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aulario.operators import (
    booking_changes as bc,
)
from aulario.operators import (
    bitmaps,
    constraints,
    kpis,
    listings,
    rules,
)
from aulario.operators import (
    people_changes as pc,
)
from aulario.operators import (
    room_changes as rc,
)
from aulario.operators import (
    sanction_changes as sc,
)
from aulario.operators.changes import ChangeResult, insert_rows
from aulario.plans.registry import REPORTS, report
from aulario.session import work_folder
from aulario.sources.versions import load_version, write_next_version, write_version
from aulario.sources.writers import json_rows
from aulario.tables import Tables
from checks.change_sets import Source
from checks.driver_tables import AS_OF_BOOKINGS, AS_OF_SANCTIONS

Query = Callable[[SparkSession, str], DataFrame]
Build = Callable[[Source], DataFrame]

B, S = AS_OF_BOOKINGS, AS_OF_SANCTIONS
STATE_AS_OF = "2024-01-30"
REQUESTS_AS_OF = "2024-01-02"

# Reports whose reference date is a sanction date.
_SANCTION_REPORTS = {"sanciones_por_tipo", "participantes_sancionados"}


def _report(name: str, variant: str) -> Build:
    as_of = S if name in _SANCTION_REPORTS else B
    return lambda s: report(name, variant)(s.t, as_of)


def _reports() -> dict[str, Build]:
    found: dict[str, Build] = {}
    for variant, mark in (("full", ""), ("basic", "b")):
        for number, name in enumerate(REPORTS, start=1):
            found[f"r{number}{mark}_{name}"] = _report(name, variant)
    return found


def _as_json(df: DataFrame, column: str) -> DataFrame:
    text = F.to_json(column, {"ignoreNullFields": "false"})
    return df.withColumn(column, text)


def _known_sanction(s: Source) -> Column:
    people = s.t.participante.select(F.col("ci").alias("ci_participante"))
    known = s.t.sancion_participante.join(people, "ci_participante", "left_semi")
    return known.agg(F.min("id_sancion")).scalar()


LISTINGS: dict[str, Build] = {
    "l1_reservas_recientes": lambda s: listings.latest_bookings(s.t),
    "l2_reservas_detalle": lambda s: listings.bookings_detailed(s.t),
    "l3_reservas_con_participantes": lambda s: _as_json(
        listings.bookings_with_participants(s.t), "participantes"
    ).select("id_reserva", "participantes"),
    "l3_participantes_de_reservas": lambda s: listings.booking_participants(s.t),
    "l4_reservas_por_participante": lambda s: listings.participant_bookings(s.t),
    "l6_salas": lambda s: listings.rooms(s.t),
    "l8_edificios": lambda s: listings.buildings(s.t),
    "l10_participantes": lambda s: listings.participants(s.t),
    "l11_participantes_con_programas": lambda s: _as_json(
        listings.participants_with_programmes(s.t), "programas"
    ),
    "l12_programas": lambda s: listings.programmes(s.t),
    "l13_sanciones": lambda s: listings.sanctions(s.t, S),
    "l15_sanciones_por_participante": lambda s: listings.participant_sanctions(s.t, S),
    "l16_disponibles_por_reserva": lambda s: listings.available_participants(s.t),
    "l16_fuera_de_una_reserva": lambda s: listings.participants_outside_booking(
        s.t, s.last("reserva", "id_reserva")
    ),
    "l7_sala": lambda s: listings.rooms(
        s.t, nombre_sala=s.last("sala", "nombre_sala")
    ).drop("etiqueta", "tipo_texto"),
    "l14_sancion": lambda s: listings.sanction(s.t, S, _known_sanction(s)),
    "l20_por_email": lambda s: listings.participant_by_email(
        s.t, s.t.participante.agg(F.max("email")).scalar()
    ),
    "l17_pertenencias": lambda s: listings.memberships(
        s.t, s.removals().select("id_reserva", "ci_participante")
    ),
    "l18_docentes": lambda s: listings.teachers(s.t),
    "l19_sanciones_vigentes": lambda s: listings.sanctions_in_force(s.t, S),
    "s5_reservas_json": lambda s: json_rows(
        report("edificios_cancelaciones")(s.t, B).select("nombre_edificio", "total_reservas")
    ),
}

#: Months that the stored bitmaps are asked for.
MONTHS = ("1999-02", "2000-11")

MONTHLY: dict[str, Build] = {
    "g2_reservas_por_programa_en_meses": lambda s: bitmaps.bookings_in_months(
        bitmaps.monthly_bookings_by_programme(s.t), "nombre_programa", *MONTHS
    ),
    "g2_reservas_por_tipo_en_meses": lambda s: bitmaps.bookings_in_months(
        bitmaps.monthly_bookings_by_user_type(s.t), "tipo_usuario", *MONTHS
    ),
}

KPIS: dict[str, Build] = {
    "k1_tablero": lambda s: kpis.dashboard(s.t, S),
    "k2_estadisticas_sala": lambda s: kpis.room_statistics(s.t),
    "k3_estadisticas_sanciones": lambda s: kpis.sanction_statistics(s.t, S),
    "k4_estados_pagina": lambda s: kpis.status_tiles(s.t),
    "k4_estados_todas": lambda s: kpis.status_tiles(s.t, "all"),
    "k5_sanciones_por_estado": lambda s: kpis.sanction_tiles(s.t, S),
    "k6_lugares_restantes": lambda s: kpis.seats_left(s.t),
    "k7_nivel_cancelacion": lambda s: kpis.cancellation_severity(s.t, B),
    "k8_reservas_propias": lambda s: kpis.own_booking_counts(s.t),
}


def _rule(df: DataFrame, *flags: str) -> DataFrame:
    return df.select("id_solicitud", *flags)


def _all_participants(s: Source) -> DataFrame:
    everyone = s.t.participante.select("ci")
    free = rules.without_active_bookings(s.booking_state(STATE_AS_OF), everyone)
    return rules.mark(everyone, free, ["ci"], "eliminable")


RULES: dict[str, Build] = {
    "s2_restricciones": lambda s: constraints.check_constraints(s.t),
    "v0_todas_las_reglas": lambda s: _rule(
        rules.evaluate_requests(s.booking_requests(), s.booking_state(), REQUESTS_AS_OF),
        "sin_sancion", "sala_permitida", "privilegiado", "en_limite_dia", "en_limite_semana",
        "turno_libre",
    ),
    "v1_sin_sancion": lambda s: _rule(
        rules.no_sanction(s.booking_requests(), s.t, REQUESTS_AS_OF), "sin_sancion"
    ),
    "v2_limite_dia": lambda s: _rule(
        rules.within_daily_limit(s.booking_requests(), s.booking_state()), "en_limite_dia"
    ),
    "v3_limite_semana": lambda s: _rule(
        rules.within_weekly_limit(s.booking_requests(), s.booking_state()), "en_limite_semana"
    ),
    "v4_capacidad": lambda s: rules.fits_capacity(
        s.t.reserva.select("id_reserva", "nombre_sala", "edificio"), s.t, F.col("id_reserva") % 3 + 1
    ).select("id_reserva", "cabe"),
    "v5_privilegiados": lambda s: rules.privileged(s.t),
    "v6_sala_permitida": lambda s: _rule(
        rules.room_allowed(s.booking_requests(), s.t), "sala_permitida"
    ),
    "v7_turno_libre": lambda s: _rule(
        rules.slot_free(s.booking_requests(), s.booking_state()), "turno_libre"
    ),
    "v8_turno_libre_para_mover": lambda s: _rule(
        rules.slot_free_for_move(s.slot_moves(), s.booking_state()), "turno_libre"
    ),
    "v9_participantes_eliminables": _all_participants,
    "v10_salas_eliminables": lambda s: rules.deletable_rooms(
        s.t, s.t.sala.select("nombre_sala", "edificio"), B
    ),
    "v11_periodo_solapado": lambda s: _rule(
        rules.overlaps_sanction(s.sanction_requests(), s.t.sancion_participante), "solapada"
    ),
    "v12_solapada_salvo_propia": lambda s: rules.overlaps_sanction(
        s.t.sancion_participante.withColumn("fecha_fin", F.date_sub("fecha_fin", 8)),
        s.t.sancion_participante,
        key="id_sancion",
        own="id_sancion",
    ).select("id_sancion", "solapada"),
    "v13_fechas_en_orden": lambda s: _rule(
        rules.dates_in_order(s.sanction_requests()), "fechas_en_orden"
    ),
    "v14_datos_validos": lambda s: _rule(
        rules.valid_status(
            rules.parse_requests(
                rules.complete(s.raw_requests(), ["nombre_sala", "fecha", "id_turno"])
            )
        ),
        "fecha", "id_turno", "completa", "datos_validos", "estado_valido",
    ),
    "v15_no_pasada": lambda s: _rule(
        rules.not_in_past(s.booking_requests(), S), "no_pasada"
    ),
    "v16_existe_participante": lambda s: _rule(
        rules.exists_in(
            s.sanction_requests(), s.t.participante, {"ci_participante": "ci"}, "existe"
        ),
        "existe",
    ),
}


def _finished(s: Source) -> Tables:
    return s.booking_state(STATE_AS_OF)


def _unchecked_additions(s: Source) -> DataFrame:
    """What the audit of a change says of participants put into bookings past all rules."""
    new = s.additions().select(
        "id_reserva",
        "ci_participante",
        F.col("solicitada_en").alias("fecha_solicitud_reserva"),
        F.lit(None).cast("boolean").alias("asistencia"),
    )
    tables = s.t.with_tables(reserva_participante=insert_rows(s.t.reserva_participante, new))
    touched = {"reserva_participante": new.select("ci_participante", "id_reserva")}
    return constraints.check_changes(s.t, ChangeResult(tables, new, new.limit(0), touched))


def _admitted(s: Source) -> DataFrame:
    before = s.booking_state()
    return constraints.check_changes(before, bc.admit_bookings(s.booking_requests(), before, REQUESTS_AS_OF))


def _purged_version(s: Source) -> DataFrame:
    """The bookings of the version after a purge, of which only the touched months were written."""
    first, second = work_folder(s.spark), work_folder(s.spark)
    write_version(s.t, first)
    write_next_version(bc.purge_bookings(s.booking_ids(), load_version(s.spark, first)), first, second)
    found = load_version(s.spark, second).reserva
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in s.t.reserva.schema])


CHANGES: dict[str, Build] = {
    "s2_altas_sin_control": _unchecked_additions,
    "s2_reservas_admitidas": _admitted,
    "s7_reservas_tras_purga": _purged_version,
    "m1_admitir_reservas": lambda s: bc.admit_bookings(
        s.booking_requests(), s.booking_state(), REQUESTS_AS_OF
    ).outcomes(),
    "m1_reservas_nuevas": lambda s: bc.admit_bookings(
        s.booking_requests(), s.booking_state(), REQUESTS_AS_OF
    ).tables.reserva,
    "m1_participaciones_nuevas": lambda s: bc.admit_bookings(
        s.booking_requests(), s.booking_state(), REQUESTS_AS_OF
    ).tables.reserva_participante,
    "m5_participaciones": lambda s: bc.add_participants(
        s.additions(), s.t
    ).tables.reserva_participante.drop("fecha_solicitud_reserva"),
    "m6_participaciones": lambda s: bc.remove_participants(
        s.removals(), s.t
    ).tables.reserva_participante.drop("fecha_solicitud_reserva"),
    "m8_sanciones": lambda s: sc.create_sanctions(
        s.sanction_requests(), s.t
    ).tables.sancion_participante,
    "m9_sanciones": lambda s: sc.update_sanctions(
        s.sanction_updates(), s.t
    ).tables.sancion_participante,
    "m11_sanciones": lambda s: sc.create_sanctions(
        sc.default_sanctions(
            s.participant_ids().withColumnRenamed("ci", "ci_participante"), "2024-02-20"
        ),
        s.t,
    ).tables.sancion_participante,
    "m12_sanciones": lambda s: sc.shift_sanctions(
        s.sanction_shifts(), s.t
    ).tables.sancion_participante,
    "m14_participantes": lambda s: pc.register_participants(
        s.registrations(), s.t
    ).tables.participante,
    "m19_salas": lambda s: rc.create_rooms(s.room_requests(), s.t).tables.sala,
    "m21_salas": lambda s: rc.delete_rooms(
        s.room_ids(), s.booking_state(STATE_AS_OF), "2024-02-03"
    ).tables.sala,
    "m2_mover_reservas": lambda s: bc.move_bookings(s.moves(), s.t).outcomes(),
    "m2_reservas_movidas": lambda s: bc.move_bookings(s.moves(), s.t).tables.reserva,
    "m3_cambiar_estado": lambda s: bc.set_status(s.status_changes(), s.t).outcomes(),
    "m3_reservas_con_estado": lambda s: bc.set_status(s.status_changes(), s.t).tables.reserva,
    "m3_cancelar_propias": lambda s: bc.cancel_bookings(
        s.removals(), s.t, own_only=True
    ).tables.reserva,
    "m4_purgar_reservas": lambda s: bc.purge_bookings(s.booking_ids(), s.t).outcomes(),
    "m4_participaciones_tras_purga": lambda s: bc.purge_all_bookings(s.t).reserva_participante.drop(
        "fecha_solicitud_reserva"
    ),
    "m5_agregar_participantes": lambda s: bc.add_participants(s.additions(), s.t).outcomes(),
    "m6_quitar_participantes": lambda s: bc.remove_participants(s.removals(), s.t).outcomes(),
    "m7_marcar_asistencia": lambda s: bc.mark_attendance(
        s.attendance_marks(), s.t
    ).tables.reserva_participante.drop("fecha_solicitud_reserva"),
    "m8_crear_sanciones": lambda s: sc.create_sanctions(s.sanction_requests(), s.t).outcomes(),
    "m9_cambiar_sanciones": lambda s: sc.update_sanctions(s.sanction_updates(), s.t).outcomes(),
    "m10_finalizar_sanciones": lambda s: sc.finish_sanctions(
        s.sanction_ids(), s.t, S
    ).outcomes(),
    "m10_sanciones_finalizadas": lambda s: sc.finish_sanctions(
        s.sanction_ids(), s.t, S
    ).tables.sancion_participante,
    "m11_sanciones_automaticas": lambda s: sc.create_sanctions(
        sc.default_sanctions(
            s.participant_ids().withColumnRenamed("ci", "ci_participante"), "2024-02-20"
        ),
        s.t,
    ).outcomes(),
    "m12_extender_sanciones": lambda s: sc.shift_sanctions(s.sanction_shifts(), s.t).outcomes(),
    "m13_eliminar_sanciones": lambda s: sc.delete_sanctions(
        s.sanction_ids(), s.t
    ).tables.sancion_participante,
    "m14_registrar_participantes": lambda s: pc.register_participants(
        s.registrations(), s.t
    ).outcomes(),
    "m15_cambiar_participantes": lambda s: pc.update_participants(
        s.participant_updates(), s.t
    ).tables.participante,
    "m16_eliminar_participantes": lambda s: pc.delete_participants(
        s.participant_ids(), _finished(s)
    ).outcomes(),
    "m16_sanciones_tras_bajas": lambda s: pc.delete_participants(
        s.participant_ids(), _finished(s)
    ).tables.sancion_participante,
    "m17_agregar_inscripciones": lambda s: pc.add_enrolments(
        s.enrolment_requests(), s.t
    ).tables.participante_programa_academico,
    "m18_quitar_inscripciones": lambda s: pc.remove_enrolments(
        s.enrolment_requests(), s.t
    ).tables.participante_programa_academico,
    "m19_crear_salas": lambda s: rc.create_rooms(s.room_requests(), s.t).outcomes(),
    "m20_cambiar_salas": lambda s: rc.update_rooms(
        s.room_updates(), s.booking_state(), S
    ).outcomes(),
    "m20_salas_cambiadas": lambda s: rc.update_rooms(
        s.room_updates(), s.booking_state(), S
    ).tables.sala,
    "m21_eliminar_salas": lambda s: rc.delete_rooms(
        s.room_ids(), s.booking_state(STATE_AS_OF), "2024-02-03"
    ).outcomes(),
    "m22_crear_edificios": lambda s: rc.create_buildings(
        s.building_requests(), s.t
    ).tables.edificio,
}


def _query(build: Build) -> Query:
    return lambda spark, sf_dir: build(Source(spark, sf_dir))


def all_queries() -> dict[str, Query]:
    builds = {**_reports(), **LISTINGS, **MONTHLY, **KPIS, **RULES, **CHANGES}
    return {name: _query(build) for name, build in builds.items()}
