"""Booking state and change requests derived from the generated tables.

``checks/oracle_changes.py`` holds the same derivations as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aulario.tables import SLOT, Tables
from checks.driver_tables import read, tables


def event() -> Column:
    return F.col("event_id")


def user() -> Column:
    return F.col("user_id")


def whole(dividend: Column, divisor: int) -> Column:
    return F.call_function("div", dividend, F.lit(divisor).cast("bigint"))


def pick(values: list[str], by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


def plus_days(date: Column, days: Column) -> Column:
    return F.date_add(date, days.cast("int"))


class Source:
    """One data folder with the views the change operators need."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.t = tables(spark, sf_dir)

    def events(self, *types: str) -> DataFrame:
        events = read(self.spark, self.sf_dir, "events")
        return events.filter(F.col("event_type").isin(*types)) if types else events

    def _requests(self, *types: str) -> DataFrame:
        return self.events(*types).withColumn("id_solicitud", event()).withColumn(
            "solicitada_en", F.col("ts")
        )

    def last(self, table: str, column: str) -> Column:
        """The highest number in a column, so that keys asked for grow with the tables."""
        return getattr(self.t, table).agg(F.max(column).cast("bigint")).scalar()

    def _slot_events(self, event_type: str, slots: int = 15) -> DataFrame:
        """Events as bookings of an eighth of the rooms; a third of them of one room."""
        halls = self.t.sala.select("nombre_sala", "edificio")
        spread = event() % F.greatest(whole(self.last("sala", "nombre_sala"), 8), F.lit(1)) + 1
        return (
            self._requests(event_type)
            .withColumn("nombre_sala", F.when(event() % 3 == 0, 1).otherwise(spread))
            .join(halls, "nombre_sala")
            .withColumn("fecha", plus_days(F.col("ts").cast("date"), whole(event(), 300) % 7))
            .withColumn("id_turno", (whole(event(), 20) % slots + 1).cast("int"))
        )

    def booking_state(self, finished_before: str | None = None) -> Tables:
        """Purchases as bookings, the earliest per slot."""
        first = (
            self._slot_events("purchase")
            .groupBy(*SLOT)
            .agg(F.min(F.struct("event_id", "user_id", "ts")).alias("e"))
            .select(*SLOT, "e.*")
        )
        state = F.lit("activa")
        if finished_before:
            state = F.when(F.col("fecha") < finished_before, "finalizada").otherwise("activa")
        return self.t.with_tables(
            reserva=first.select(event().alias("id_reserva"), *SLOT, state.alias("estado")),
            reserva_participante=first.select(
                user().alias("ci_participante"),
                event().alias("id_reserva"),
                F.col("ts").alias("fecha_solicitud_reserva"),
                F.lit(None).cast("boolean").alias("asistencia"),
            ),
        )

    def booking_requests(self) -> DataFrame:
        # One slot number more than there are, so that some requests name an unknown slot.
        return self._slot_events("signup", slots=16).select(
            "id_solicitud", user().alias("ci_participante"), *SLOT, "solicitada_en"
        )

    def raw_requests(self) -> DataFrame:
        """Booking requests as form text, some of it unreadable or missing."""
        date = F.col("ts").cast("date").cast("string")
        return self._requests("signup").select(
            "id_solicitud",
            F.when(event() % 5 == 0, "").otherwise(user().cast("string")).alias("nombre_sala"),
            F.when(event() % 7 == 0, "ayer").otherwise(date).alias("fecha"),
            F.when(event() % 11 == 0, "x").otherwise((event() % 15 + 1).cast("string")).alias("id_turno"),
            pick(["activa", "cancelada", "finalizada", "otra"], event()).alias("estado"),
        )

    def sanction_requests(self) -> DataFrame:
        start = plus_days(F.col("ts").cast("date"), event() % 120 - 30)
        return self._requests("view").select(
            "id_solicitud",
            user().alias("ci_participante"),
            start.alias("fecha_inicio"),
            plus_days(start, event() % 11 - 2).alias("fecha_fin"),
            "solicitada_en",
        )

    def sanction_updates(self) -> DataFrame:
        """New dates for sanctions, far enough out to be partly free."""
        start = plus_days(F.col("ts").cast("date"), event() % 400)
        return self._requests("error", "click").select(
            "id_solicitud",
            (event() - event() % 2).alias("id_sancion"),
            start.alias("fecha_inicio"),
            plus_days(start, event() % 9 - 1).alias("fecha_fin"),
            "solicitada_en",
        )

    def sanction_shifts(self) -> DataFrame:
        return self._requests("error").select(
            "id_solicitud",
            event().alias("id_sancion"),
            (event() % 41 - 20).cast("int").alias("dias"),
            "solicitada_en",
        )

    def sanction_ids(self) -> DataFrame:
        return self._requests("error", "click").select(
            "id_solicitud", (event() - event() % 2).alias("id_sancion"), "solicitada_en"
        )

    def slot_moves(self) -> DataFrame:
        """Each booking of the state moved to the next day."""
        state = self.booking_state().reserva
        return state.select(
            F.col("id_reserva").alias("id_solicitud"),
            "id_reserva",
            "nombre_sala",
            "edificio",
            F.date_add("fecha", 1).alias("fecha"),
            "id_turno",
        )

    def moves(self) -> DataFrame:
        """Moves to the slot of another booking, or the slot after it."""
        target = self.t.reserva.select(F.col("id_reserva").alias("destino"), *SLOT)
        return (
            self._requests("click", "view")
            .withColumn("destino", event() + user())
            .join(target, "destino")
            .select(
                "id_solicitud",
                ((event() - event() % 4) * 2).alias("id_reserva"),
                "nombre_sala",
                "edificio",
                "fecha",
                (F.col("id_turno") + event() % 3 * 6).cast("int").alias("id_turno"),
                "solicitada_en",
            )
        )

    def status_changes(self) -> DataFrame:
        states = ["activa", "cancelada", "sin asistencia", "finalizada", "otra"]
        return self._requests("view").select(
            "id_solicitud",
            ((event() - event() % 4) * 2).alias("id_reserva"),
            pick(states, event()).alias("estado"),
            "solicitada_en",
        )

    def booking_ids(self) -> DataFrame:
        return self._requests("click").select(
            "id_solicitud", (event() * 2).alias("id_reserva"), "solicitada_en"
        )

    def additions(self) -> DataFrame:
        return self._requests("signup", "view").select(
            "id_solicitud",
            F.when(event() % 3 == 0, 7)
            .otherwise(event() % whole(self.last("reserva", "id_reserva"), 4))
            .alias("id_reserva"),
            user().alias("ci_participante"),
            "solicitada_en",
        )

    def _participation_requests(self) -> DataFrame:
        rp = self.t.reserva_participante
        return rp.select(
            (F.col("id_reserva") * 1_000_000 + F.col("ci_participante") * 2).alias("id_solicitud"),
            "id_reserva",
            "ci_participante",
            F.col("fecha_solicitud_reserva").alias("solicitada_en"),
        )

    def removals(self) -> DataFrame:
        """Every participation asked to be removed, and as many by a neighbour's number."""
        asked = self._participation_requests()
        return asked.unionByName(
            asked.withColumn("id_solicitud", F.col("id_solicitud") + 1).withColumn(
                "ci_participante", F.col("ci_participante") + 1
            )
        )

    def attendance_marks(self) -> DataFrame:
        """A mark for every participation, and a later one under a neighbour's number."""
        asked = self._participation_requests().withColumn(
            "asistio", (F.col("ci_participante") + F.col("id_reserva")) % 2 == 0
        )
        return asked.unionByName(
            asked.select(
                (F.col("id_solicitud") + 1).alias("id_solicitud"),
                "id_reserva",
                (F.col("ci_participante") + 1).alias("ci_participante"),
                F.col("solicitada_en").alias("solicitada_en"),
                (~F.col("asistio")).alias("asistio"),
            )
        )

    def registrations(self) -> DataFrame:
        people = self.last("participante", "ci")
        return self._requests("signup").select(
            "id_solicitud",
            (event() % (people * 7) + whole(people, 2)).alias("ci"),
            F.concat(F.lit("N"), user().cast("string")).alias("nombre"),
            F.when(event() % 13 == 0, "").otherwise("A").alias("apellido"),
            F.concat(F.lit("n"), (whole(event(), 3) % (people * 6)).cast("string"), F.lit("@campus.test")).alias("email"),
            F.concat(F.lit("NATION_"), (event() % 27).cast("string")).alias("nombre_programa"),
            pick(["alumno", "estudiante", "docente", "jefe"], whole(event(), 5)).alias("rol"),
            "solicitada_en",
        )

    def participant_updates(self) -> DataFrame:
        taken = F.concat(F.lit("p"), (user() + event() % 3).cast("string"), F.lit("@campus.test"))
        some = event() % (self.last("participante", "ci") * 2)
        fresh = F.concat(F.lit("n"), some.cast("string"), F.lit("@campus.test"))
        return self._requests("view").select(
            "id_solicitud",
            user().alias("ci"),
            F.concat(F.lit("N"), event().cast("string")).alias("nombre"),
            F.lit("B").alias("apellido"),
            F.when(event() % 2 == 0, taken).otherwise(fresh).alias("email"),
            "solicitada_en",
        )

    def participant_ids(self) -> DataFrame:
        return self._requests("signup").select("id_solicitud", user().alias("ci"), "solicitada_en")

    def enrolment_requests(self) -> DataFrame:
        return self._requests("signup", "click").select(
            "id_solicitud",
            user().alias("ci_participante"),
            F.concat(F.lit("NATION_"), (event() % 27).cast("string")).alias("nombre_programa"),
            pick(["alumno", "estudiante", "docente", "jefe"], whole(event(), 5)).alias("rol"),
            "solicitada_en",
        )

    def room_requests(self) -> DataFrame:
        return self._requests("view").select(
            "id_solicitud",
            (event() % (self.last("sala", "nombre_sala") * 2)).alias("nombre_sala"),
            (user() % 27).cast("int").alias("edificio"),
            (event() % 13).cast("int").alias("capacidad"),
            pick(["libre", "posgrado", "docente", "otro"], whole(event(), 13)).alias("tipo_sala"),
            "solicitada_en",
        )

    def room_updates(self) -> DataFrame:
        halls = self.t.sala.select("nombre_sala", "edificio")
        return (
            self._requests("click")
            .withColumn("nombre_sala", event() % whole(self.last("sala", "nombre_sala") * 4, 3))
            .join(halls, "nombre_sala", "left")
            .withColumn("edificio", F.coalesce("edificio", F.lit(0)))
            .select(
                "id_solicitud",
                "nombre_sala",
                "edificio",
                F.when(event() % 3 == 0, F.col("nombre_sala"))
                .otherwise(whole(event(), 2) + 100_000)
                .alias("nuevo_nombre_sala"),
                F.when(event() % 5 == 0, 26).otherwise(F.col("edificio")).alias("nuevo_edificio"),
                (event() % 13).cast("int").alias("capacidad"),
                pick(["libre", "posgrado", "docente", "otro"], whole(event(), 13)).alias("tipo_sala"),
                "solicitada_en",
            )
        )

    def room_ids(self) -> DataFrame:
        """Every room, and as many unknown ones, asked to be deleted."""
        known = self.t.sala.select(
            (F.col("nombre_sala") * 2).alias("id_solicitud"), "nombre_sala", "edificio"
        )
        unknown = self.t.sala.select(
            (F.col("nombre_sala") * 2 + 1).alias("id_solicitud"),
            "nombre_sala",
            (F.col("edificio") + 1).alias("edificio"),
        )
        return known.unionByName(unknown).withColumn("solicitada_en", F.col("id_solicitud"))

    def building_requests(self) -> DataFrame:
        return self._requests("view").select(
            "id_solicitud",
            (event() % 60).cast("int").alias("nombre_edificio"),
            F.when(event() % 10 == 0, "").otherwise(F.concat(F.lit("Calle "), user().cast("string"))).alias("direccion"),
            F.when(event() % 7 == 0, None).otherwise("D").alias("departamento"),
            "solicitada_en",
        )
