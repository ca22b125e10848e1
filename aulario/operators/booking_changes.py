"""Batch changes of bookings and participations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aulario.functions.scalar import Date
from aulario.operators import rules
from aulario.operators.aggregates import in_state, or_zero, participants_by_booking
from aulario.operators.changes import (
    ID,
    ORDER,
    ChangeResult,
    LateResult,
    assign_ids,
    cut,
    delete_rows,
    first_reason,
    insert_rows,
    last_change,
    mark_first,
    split,
    turn,
    union_all,
    update_rows,
)
from aulario.operators.rules import CI, mark
from aulario.operators.sequencing import Limit, admit_in_order
from aulario.sources.schemas import MAX_BOOKINGS_PER_DAY, MAX_BOOKINGS_PER_WEEK
from aulario.tables import ROOM, SLOT, Tables


def _earlier(turns: str) -> Column:
    """How many of the collected turns come before the row's own."""
    return F.coalesce(F.size(F.filter(turns, lambda t: t < turn())), F.lit(0))


def _granted_turns(granted: DataFrame, keys: list[str], name: str) -> DataFrame:
    # At most the quota per key: only requests subject to it are counted.
    return cut(granted.filter("con_cuota").groupBy(*keys).agg(F.collect_list(turn()).alias(name)))


def admit_bookings(
    requests: DataFrame,
    t: Tables,
    as_of: Date,
    not_before: Date | None = None,
) -> ChangeResult:
    """Book rooms in request order.

    Checks per request: valid data, known participant and slot, no sanction in force, room
    allowed, then for unprivileged participants the daily and the weekly quota, then the
    slot. Each request meets the bookings granted before it. A granted request becomes an
    active booking with the requester as its participant; capacities are above zero (a rule
    of the audit), so one person always fits and no capacity is read.
    """
    columns = requests.columns
    valid = F.lit(True)
    for column in [CI, *SLOT]:
        valid = valid & F.col(column).isNotNull()
    if not_before is not None:
        valid = valid & (F.col("fecha") >= F.lit(str(not_before)).cast("date"))
    requests = cut(requests)
    judged = rules.exists_in(requests, t.participante, {CI: "ci"}, "existe")
    judged = rules.exists_in(judged, t.turno, {"id_turno": "id_turno"}, "hay_turno", requests)
    judged = rules.room_allowed(rules.no_sanction(judged, t, as_of), t, requests)
    judged = rules.slot_free(rules.booked_that_day(judged, t, requests), t, requests)
    judged = cut(
        judged.withColumn(
            "motivo",
            first_reason(
                ("datos_invalidos", valid),
                ("participante_inexistente", F.col("existe")),
                ("turno_inexistente", F.col("hay_turno")),
                ("sancion_activa", F.col("sin_sancion")),
                ("sala_no_permitida", F.col("sala_permitida")),
            ),
        )
        .withColumn("con_cuota", ~F.col("privilegiado"))
        .withColumn("libre_turno", F.col("turno_libre").cast("int"))
        .withColumn("libre_dia", MAX_BOOKINGS_PER_DAY - F.col("activas_dia"))
        .withColumn("libre_semana", MAX_BOOKINGS_PER_WEEK - F.col("activas_semana"))
    )
    open_requests = judged.filter(F.col("motivo").isNull()).drop("motivo")
    granted = admit_in_order(
        open_requests,
        [
            Limit(SLOT, "libre_turno", 1),
            Limit([CI, "fecha"], "libre_dia", MAX_BOOKINGS_PER_DAY, "con_cuota"),
            Limit([CI, "lunes"], "libre_semana", MAX_BOOKINGS_PER_WEEK, "con_cuota"),
        ],
    )
    granted = cut(granted)
    subject = F.col("con_cuota")
    refused = (
        open_requests.join(granted.select(ID), ID, "left_anti")
        .join(_granted_turns(granted, [CI, "fecha"], "del_dia"), [CI, "fecha"], "left")
        .join(_granted_turns(granted, [CI, "lunes"], "de_semana"), [CI, "lunes"], "left")
        .withColumn(
            "motivo",
            F.when(subject & (F.col("libre_dia") <= _earlier("del_dia")), "limite_dia")
            .when(subject & (F.col("libre_semana") <= _earlier("de_semana")), "limite_semana")
            .otherwise("turno_ocupado"),
        )
    )
    rejected = union_all(
        [
            judged.filter(F.col("motivo").isNotNull()).select(*columns, "motivo"),
            refused.select(*columns, "motivo"),
        ]
    )
    booked = assign_ids(granted.select(*columns), t.reserva, "id_reserva", ORDER)
    tables = t.with_tables(
        reserva=insert_rows(t.reserva, booked.withColumn("estado", F.lit("activa"))),
        reserva_participante=insert_rows(
            t.reserva_participante,
            booked.withColumn("fecha_solicitud_reserva", F.col("solicitada_en")).withColumn(
                "asistencia", F.lit(None).cast("boolean")
            ),
        ),
    )
    new = booked.select("id_reserva")
    return ChangeResult(tables, booked, rejected, {"reserva": new, "reserva_participante": new})


def move_bookings(moves: DataFrame, t: Tables) -> ChangeResult:
    """Move bookings to another room, date or slot.

    Moves are judged against the bookings before the batch: a slot freed by one move
    can be taken in the next batch. Within the batch the first move of a booking and
    the first move into a slot count.
    """
    columns = moves.columns
    moves = cut(moves)
    judged = rules.slot_free_for_move(moves, t)
    judged = mark(judged, _touched(t, moves), ["id_reserva"], "existe")
    judged = rules.exists_in(judged, t.sala, {c: c for c in ROOM}, "hay_sala", moves)
    judged = rules.exists_in(judged, t.turno, {"id_turno": "id_turno"}, "hay_turno", moves)
    fit = F.col("existe") & F.col("turno_libre") & F.col("hay_sala") & F.col("hay_turno")
    judged = mark_first(judged, ["id_reserva"], "primera", fit)
    judged = mark_first(judged, SLOT, "primera_en_turno", fit & F.col("primera"))
    judged = judged.withColumn(
        "motivo",
        first_reason(
            ("turno_ocupado", F.col("turno_libre")),
            ("reserva_inexistente", F.col("existe")),
            ("sala_inexistente", F.col("hay_sala")),
            ("turno_inexistente", F.col("hay_turno")),
            ("repetida", F.col("primera")),
            ("turno_ocupado", F.col("primera_en_turno")),
        ),
    )
    accepted, rejected = split(judged, *columns)
    moved = update_rows(t.reserva, accepted.select("id_reserva", *SLOT), ["id_reserva"])
    touched = {"reserva": accepted.select("id_reserva")}
    return ChangeResult(t.with_tables(reserva=moved), accepted, rejected, touched)


def _touched(t: Tables, asked: DataFrame) -> DataFrame:
    return t.reserva.join(asked.select("id_reserva"), "id_reserva", "left_semi")


def _touched_people(t: Tables, asked: DataFrame) -> DataFrame:
    return t.reserva_participante.join(asked.select("id_reserva"), "id_reserva", "left_semi")


def set_status(changes: DataFrame, t: Tables, own_only: bool = False) -> ChangeResult:
    """Set booking statuses; of several valid changes of a booking the last one stays.

    With ``own_only`` the requester (``ci_participante``) must take part in the booking.
    """
    columns = changes.columns
    judged = mark(rules.valid_status(changes), _touched(t, changes), ["id_reserva"], "existe")
    checks = [("reserva_inexistente", F.col("existe")), ("estado_invalido", F.col("estado_valido"))]
    if own_only:
        judged = mark(judged, _touched_people(t, changes), ["id_reserva", CI], "propia")
        checks.insert(1, ("reserva_ajena", F.col("propia")))
    accepted, rejected = split(judged.withColumn("motivo", first_reason(*checks)), *columns)
    updates = last_change(accepted, ["id_reserva"], "estado")
    changed = update_rows(t.reserva, updates, ["id_reserva"])
    touched = {"reserva": updates.select("id_reserva")}
    return ChangeResult(t.with_tables(reserva=changed), accepted, rejected, touched)


def cancel_bookings(changes: DataFrame, t: Tables, own_only: bool = False) -> ChangeResult:
    return set_status(changes.withColumn("estado", F.lit("cancelada")), t, own_only)


def purge_bookings(asked: DataFrame, t: Tables) -> ChangeResult:
    """Delete cancelled and unattended bookings together with their participations.

    A booking is deleted once; later requests for it find it no more.
    """
    columns = asked.columns
    states = _touched(t, asked).select("id_reserva", "estado")
    judged = asked.join(states, "id_reserva", "left").withColumn(
        "motivo",
        first_reason(
            ("reserva_inexistente", F.col("estado").isNotNull()),
            ("estado_no_permitido", F.col("estado").isin("cancelada", "sin asistencia")),
        ),
    )
    judged = mark_first(judged, ["id_reserva"], "primera", F.col("motivo").isNull()).withColumn(
        "motivo", F.coalesce("motivo", F.when(~F.col("primera"), "reserva_inexistente"))
    )
    accepted, rejected = split(judged, *columns)
    gone = accepted.select("id_reserva")
    touched = {"reserva": gone, "reserva_participante": gone}
    return ChangeResult(_without_bookings(t, gone), accepted, rejected, touched)


def purge_all_bookings(t: Tables) -> Tables:
    """Delete every cancelled and unattended booking."""
    gone = t.reserva.filter(in_state("cancelada") | in_state("sin asistencia"))
    return t.with_tables(
        reserva=t.reserva.filter(~(in_state("cancelada") | in_state("sin asistencia"))),
        reserva_participante=delete_rows(t.reserva_participante, gone, ["id_reserva"]),
    )


def _without_bookings(t: Tables, gone: DataFrame) -> Tables:
    return t.with_tables(
        reserva=delete_rows(t.reserva, gone, ["id_reserva"]),
        reserva_participante=delete_rows(t.reserva_participante, gone, ["id_reserva"]),
    )


def first_per_booking(df: DataFrame, limit: str) -> DataFrame:
    """The first ``limit`` requests of each booking, ranked in two steps.

    Each booking is spread over as many salts as there are shuffle partitions, ranked and
    cut there; only the survivors, at most ``limit`` (the seats of a room) per salt, meet in
    the final ranking. The explicit shuffle keeps an earlier partitioning by booking from
    putting all salts into one task.
    """
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(ID), F.lit(salts))
    parts = Window.partitionBy("id_reserva", "sal").orderBy(*ORDER)
    whole = Window.partitionBy("id_reserva").orderBy(*ORDER)
    return (
        df.withColumn("sal", salt)
        .repartition("id_reserva", "sal")
        .withColumn("n", F.row_number().over(parts))
        .filter(F.col("n") <= F.col(limit))
        .withColumn("n", F.row_number().over(whole))
        .filter(F.col("n") <= F.col(limit))
        .drop("sal", "n")
    )


def add_participants(requests: DataFrame, t: Tables, enforce: bool = True) -> ChangeResult:
    """Add participants while their booking has room; each person once.

    Room is checked before repetition, as of the turn of the request. Without
    ``enforce`` the room is not checked.
    """
    columns = requests.columns
    requests = cut(requests)
    inside = _touched_people(t, requests)
    sizes = (
        _touched(t, requests)
        .join(t.sala.select(*ROOM, "capacidad"), ROOM)
        .join(participants_by_booking(inside), "id_reserva", "left")
        .select("id_reserva", (F.col("capacidad") - or_zero("num_participantes")).alias("libres"))
    )
    judged = requests.join(cut(sizes), "id_reserva", "left")
    judged = mark(judged, inside, ["id_reserva", CI], "ya_dentro")
    judged = rules.exists_in(judged, t.participante, {CI: "ci"}, "existe", requests)
    candidate = F.col("libres").isNotNull() & F.col("existe") & ~F.col("ya_dentro")
    judged = mark_first(judged, ["id_reserva", CI], "primera", candidate)
    pool = judged.filter(candidate & F.col("primera"))
    if not enforce:
        judged = judged.withColumn("en_cupo", F.lit(True)).withColumn("llena", F.lit(False))
    else:
        winners = cut(
            first_per_booking(
                pool.filter("libres > 0").select("id_reserva", *ORDER, "libres"), "libres"
            )
        )
        filled = (
            winners.groupBy("id_reserva", "libres")
            .agg(F.count("*").alias("n"), F.max(turn()).alias("lleno_desde"))
            .filter("n = libres")
            .select("id_reserva", "lleno_desde")
        )
        judged = (
            rules.flag(judged, winners, [ID], "en_cupo")
            .join(filled, "id_reserva", "left")
            .withColumn(
                "llena",
                (F.col("libres") <= 0) | F.coalesce(F.col("lleno_desde") < turn(), F.lit(False)),
            )
        )
    judged = judged.withColumn(
        "motivo",
        first_reason(
            ("reserva_inexistente", F.col("libres").isNotNull()),
            ("capacidad", ~F.col("llena")),
            ("participante_inexistente", F.col("existe")),
            ("repetido", ~F.col("ya_dentro") & F.col("primera")),
            ("capacidad", F.col("en_cupo")),
        ),
    )
    accepted, rejected = split(judged, *columns)
    rows = accepted.withColumn("fecha_solicitud_reserva", F.col("solicitada_en")).withColumn(
        "asistencia", F.lit(None).cast("boolean")
    )
    tables = t.with_tables(
        reserva_participante=insert_rows(t.reserva_participante, rows),
    )
    touched = {"reserva_participante": accepted.select("id_reserva", CI)}
    return ChangeResult(tables, accepted, rejected, touched)


def _turn_type(requests: DataFrame):
    return requests.select(turn().alias("turno")).schema["turno"].dataType


def remove_participants(requests: DataFrame, t: Tables, enforce: bool = True) -> ChangeResult:
    """Remove participants, never the last one of a booking.

    Only a batch that names every participant of a booking has a removal refused by that
    rule: the last of their first requests. Once a single one is left, every later request
    is refused. So bookings need counts and the last two turns, not a ranking; these come from
    one row per person, in which participations and requests are put together. The rule is
    checked before membership. The new state needs these rows only; the requests are judged
    one by one when the verdicts are asked for.
    """
    columns = requests.columns
    person = ["id_reserva", CI]
    requests = cut(requests)
    rows = _touched_people(t, requests).select(
        *person, F.lit(1).alias("filas"), F.lit(None).cast(_turn_type(requests)).alias("turno")
    )
    asked = requests.select(*person, F.lit(0).alias("filas"), turn().alias("turno"))
    people = cut(
        rows.unionByName(asked)
        .groupBy(*person)
        .agg(F.sum("filas").alias("filas"), F.min("turno").alias("turno"))
        .filter("filas > 0")
    )
    newest = Window.partitionBy("id_reserva").orderBy(F.desc("turno"))
    last = (
        people.filter("turno IS NOT NULL")
        .withColumn("n", F.row_number().over(newest))
        .filter("n <= 2")
        .groupBy("id_reserva")
        .agg(
            F.max("turno").alias("final"),
            F.when(F.count("*") > 1, F.min("turno")).alias("anterior"),
        )
    )
    sizes = people.groupBy("id_reserva").agg(
        F.sum("filas").alias("num_participantes"), F.count("turno").alias("pedidos")
    )
    bookings = cut(
        sizes.join(last, "id_reserva", "left").select(
            "id_reserva",
            "num_participantes",
            F.when(F.col("pedidos") == F.col("num_participantes"), F.col("anterior"))
            .when(F.col("pedidos") == F.col("num_participantes") - 1, F.col("final"))
            .alias("uno_desde"),
        )
    )
    def alone(at: Column) -> Column:
        known = or_zero("num_participantes") <= 1
        return known | F.coalesce(F.col("uno_desde") < at, F.lit(False))

    first = people.filter("turno IS NOT NULL").select(*person, "turno").dropna(subset=person)

    def verdicts() -> tuple[DataFrame, DataFrame]:
        judged = requests.join(first, person, "left").join(bookings, "id_reserva", "left")
        judged = judged.withColumn(
            "motivo",
            first_reason(
                ("ultimo_participante", ~alone(turn()) if enforce else F.lit(True)),
                ("no_participa", F.col("turno") == turn()),
            ),
        )
        return split(judged, *columns)

    # Who goes follows from the first request of each person, however many requests there are.
    gone = first.join(bookings, "id_reserva").filter(~alone(F.col("turno"))) if enforce else first
    gone = gone.select(*person)
    kept = delete_rows(t.reserva_participante, gone, person)
    return LateResult(t.with_tables(reserva_participante=kept), verdicts, {"reserva_participante": gone})


def mark_attendance(marks: DataFrame, t: Tables) -> ChangeResult:
    """Record attendance (``asistio``); the last mark of a participation stays."""
    columns = marks.columns
    judged = mark(marks, _touched_people(t, marks), ["id_reserva", CI], "dentro").withColumn(
        "motivo",
        first_reason(
            ("datos_invalidos", F.col(CI).isNotNull() & F.col("asistio").isNotNull()),
            ("no_participa", F.col("dentro")),
        ),
    )
    accepted, rejected = split(judged, *columns)
    keys = ["id_reserva", CI]
    updates = last_change(accepted, keys, "asistio").withColumnRenamed("asistio", "asistencia")
    updated = update_rows(t.reserva_participante, updates, keys)
    touched = {"reserva_participante": updates.select(*keys)}
    return ChangeResult(t.with_tables(reserva_participante=updated), accepted, rejected, touched)
