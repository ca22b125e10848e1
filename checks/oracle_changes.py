"""Comparison SQL of the booking rules and the change operators.

Requests are judged here the way one would process them by hand: running counts in
request order where these decide, otherwise a recursive query that takes one request
after the other.
"""

from __future__ import annotations

from checks.oracle import B, S

SLOT = "nombre_sala, edificio, fecha, id_turno"
TURN = "solicitada_en, id_solicitud"
STATE_AS_OF = "DATE '2024-01-30'"
# Early enough that only some participants have a sanction in force.
REQUESTS_AS_OF = "DATE '2024-01-02'"


def _slot_events(event_type: str, slots: int = 15) -> str:
    return f"""SELECT event_id AS id_solicitud, user_id AS ci_participante, nombre_sala, edificio,
        CAST(ts AS DATE) + CAST(event_id // 300 % 7 AS INTEGER) AS fecha,
        CAST(event_id // 20 % {slots} + 1 AS INTEGER) AS id_turno, ts AS solicitada_en
        FROM events JOIN sala ON nombre_sala = CASE WHEN event_id % 3 = 0 THEN 1 ELSE
            event_id % greatest((SELECT max(nombre_sala) FROM sala) // 8, 1) + 1 END
        WHERE event_type = '{event_type}'"""


def _pick(values: str, by: str, n: int) -> str:
    return f"[{values}][{by} % {n} + 1]"


ROLE = _pick("'alumno', 'estudiante', 'docente', 'jefe'", "(event_id // 5)", 4)
ROOM_TYPE = _pick("'libre', 'posgrado', 'docente', 'otro'", "(event_id // 13)", 4)

CHANGE_VIEWS: dict[str, str] = {
    "solicitud": _slot_events("signup", 16),
    "compra": f"""SELECT * FROM ({_slot_events("purchase")})
        QUALIFY row_number() OVER (PARTITION BY {SLOT} ORDER BY id_solicitud) = 1""",
    "solicitud_texto": """SELECT event_id AS id_solicitud,
        CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS nombre_sala,
        CASE WHEN event_id % 7 = 0 THEN 'ayer' ELSE strftime(ts, '%Y-%m-%d') END AS fecha,
        CASE WHEN event_id % 11 = 0 THEN 'x' ELSE CAST(event_id % 15 + 1 AS VARCHAR) END AS id_turno,
        ['activa', 'cancelada', 'finalizada', 'otra'][event_id % 4 + 1] AS estado
        FROM events WHERE event_type = 'signup'""",
    "pedido_sancion": """SELECT *, fecha_inicio + CAST(id_solicitud % 11 - 2 AS INTEGER) AS fecha_fin
        FROM (SELECT event_id AS id_solicitud, user_id AS ci_participante,
                     CAST(ts AS DATE) + CAST(event_id % 120 - 30 AS INTEGER) AS fecha_inicio,
                     ts AS solicitada_en
              FROM events WHERE event_type = 'view')""",
    "pedido_automatico": """SELECT event_id AS id_solicitud, user_id AS ci_participante,
        DATE '2024-02-20' AS fecha_inicio, DATE '2024-02-27' AS fecha_fin, ts AS solicitada_en
        FROM events WHERE event_type = 'signup'""",
    "cambio_sancion": """SELECT *, fecha_inicio + CAST(id_solicitud % 9 - 1 AS INTEGER) AS fecha_fin
        FROM (SELECT event_id AS id_solicitud, event_id - event_id % 2 AS id_sancion,
                     CAST(ts AS DATE) + CAST(event_id % 400 AS INTEGER) AS fecha_inicio,
                     ts AS solicitada_en
              FROM events WHERE event_type IN ('error', 'click'))""",
    "cambio_dias": """SELECT id_sancion AS id_solicitud, id_sancion, fecha_inicio,
        fecha_fin + CAST(id_sancion % 41 - 20 AS INTEGER) AS fecha_fin, ts AS solicitada_en
        FROM sancion JOIN events ON event_id = id_sancion""",
    "sancion_nombrada": """SELECT event_id AS id_solicitud, event_id - event_id % 2 AS id_sancion,
        ts AS solicitada_en FROM events WHERE event_type IN ('error', 'click')""",
    "mudanza": """SELECT event_id AS id_solicitud, (event_id - event_id % 4) * 2 AS id_reserva,
        nombre_sala, edificio, fecha, CAST(id_turno + event_id % 3 * 6 AS INTEGER) AS id_turno,
        ts AS solicitada_en
        FROM events JOIN reserva AS r ON r.id_reserva = event_id + user_id
        WHERE event_type IN ('click', 'view')""",
    "cambio_estado": """SELECT event_id AS id_solicitud, (event_id - event_id % 4) * 2 AS id_reserva,
        ['activa', 'cancelada', 'sin asistencia', 'finalizada', 'otra'][event_id % 5 + 1] AS nuevo,
        ts AS solicitada_en FROM events WHERE event_type = 'view'""",
    "baja_reserva": """SELECT event_id AS id_solicitud, event_id * 2 AS id_reserva, ts AS solicitada_en
        FROM events WHERE event_type = 'click'""",
    "alta_participante": """SELECT event_id AS id_solicitud, CASE WHEN event_id % 3 = 0 THEN 7
            ELSE event_id % ((SELECT max(id_reserva) FROM reserva) // 4) END AS id_reserva,
        user_id AS ci_participante, ts AS solicitada_en
        FROM events WHERE event_type IN ('signup', 'view')""",
    "pedido_propio": """SELECT id_reserva * 1000000 + ci_participante * 2 AS id_solicitud,
        id_reserva, ci_participante, fecha_solicitud_reserva AS solicitada_en FROM rp""",
    "baja_participante": """SELECT * FROM pedido_propio UNION ALL
        SELECT id_solicitud + 1, id_reserva, ci_participante + 1, solicitada_en
        FROM pedido_propio""",
    "marca": """SELECT *, (ci_participante + id_reserva) % 2 = 0 AS asistio FROM pedido_propio
        UNION ALL
        SELECT id_solicitud + 1, id_reserva, ci_participante + 1, solicitada_en,
               (ci_participante + id_reserva) % 2 = 1 FROM pedido_propio""",
    "registro": f"""SELECT event_id AS id_solicitud, event_id % (people * 7) + people // 2 AS ci,
        'N' || user_id AS nombre, CASE WHEN event_id % 13 = 0 THEN '' ELSE 'A' END AS apellido,
        'n' || (event_id // 3 % (people * 6)) || '@campus.test' AS email,
        'NATION_' || (event_id % 27) AS nombre_programa, {ROLE} AS rol, ts AS solicitada_en
        FROM events, (SELECT max(ci) AS people FROM participante) WHERE event_type = 'signup'""",
    "cambio_participante": """SELECT event_id AS id_solicitud, user_id AS ci,
        'N' || event_id AS nombre, 'B' AS apellido,
        CASE WHEN event_id % 2 = 0 THEN 'p' || (user_id + event_id % 3) || '@campus.test'
             ELSE 'n' || (event_id % (2 * (SELECT max(ci) FROM participante))) || '@campus.test' END AS email, ts AS solicitada_en
        FROM events WHERE event_type = 'view'""",
    "baja_persona": """SELECT event_id AS id_solicitud, user_id AS ci, ts AS solicitada_en
        FROM events WHERE event_type = 'signup'""",
    "pedido_inscripcion": f"""SELECT event_id AS id_solicitud, user_id AS ci_participante,
        'NATION_' || (event_id % 27) AS nombre_programa,
        replace({ROLE}, 'estudiante', 'alumno') AS rol, ts AS solicitada_en
        FROM events WHERE event_type IN ('signup', 'click')""",
    "alta_sala": f"""SELECT event_id AS id_solicitud, event_id % (2 * (SELECT max(nombre_sala) FROM sala)) AS nombre_sala,
        CAST(user_id % 27 AS INTEGER) AS edificio, event_id % 13 AS capacidad,
        {ROOM_TYPE} AS tipo_sala, ts AS solicitada_en FROM events WHERE event_type = 'view'""",
    "cambio_sala": f"""SELECT event_id AS id_solicitud, event_id % rooms AS nombre_sala,
        coalesce(s.edificio, 0) AS edificio,
        CASE WHEN event_id % 3 = 0 THEN event_id % rooms ELSE event_id // 2 + 100000 END AS nuevo_nombre,
        CASE WHEN event_id % 5 = 0 THEN 26 ELSE coalesce(s.edificio, 0) END AS nuevo_edificio,
        CAST(event_id % 13 AS INTEGER) AS nueva_capacidad, {ROOM_TYPE} AS nuevo_tipo, ts AS solicitada_en
        FROM (SELECT *, (SELECT max(nombre_sala) FROM sala) * 4 // 3 AS rooms FROM events) AS e
        LEFT JOIN sala AS s ON s.nombre_sala = event_id % rooms
        WHERE event_type = 'click'""",
    "alta_edificio": """SELECT event_id AS id_solicitud, CAST(event_id % 60 AS INTEGER) AS nombre,
        CASE WHEN event_id % 10 = 0 THEN '' ELSE 'Calle ' || user_id END AS direccion,
        CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'D' END AS departamento, ts AS solicitada_en
        FROM events WHERE event_type = 'view'""",
    "privilegio": """SELECT ci_participante, bool_or(rol = 'docente' OR tipo = 'posgrado') AS p
        FROM inscripcion JOIN programa USING (nombre_programa) GROUP BY ci_participante""",
}


def touches(a: str, b: str) -> str:
    """Sanction ``a`` touches period ``b``, as three separate cases."""
    return f"""(({a}.fecha_inicio <= {b}.fecha_inicio AND {a}.fecha_fin >= {b}.fecha_inicio)
        OR ({a}.fecha_inicio <= {b}.fecha_fin AND {a}.fecha_fin >= {b}.fecha_fin)
        OR ({a}.fecha_inicio >= {b}.fecha_inicio AND {a}.fecha_fin <= {b}.fecha_fin))"""


NO_SANCTION = f"""NOT EXISTS (SELECT 1 FROM sancion AS x WHERE x.ci_participante = q.ci_participante
    AND {REQUESTS_AS_OF} BETWEEN x.fecha_inicio AND x.fecha_fin)"""
SAME_DAY = """(SELECT count(*) FROM compra AS c
    WHERE c.ci_participante = q.ci_participante AND c.fecha = q.fecha)"""
SAME_WEEK = """(SELECT count(*) FROM compra AS c WHERE c.ci_participante = q.ci_participante
    AND c.fecha BETWEEN CAST(date_trunc('week', q.fecha) AS DATE)
                    AND CAST(date_trunc('week', q.fecha) AS DATE) + 6)"""
FREE = """NOT EXISTS (SELECT 1 FROM compra AS c WHERE c.nombre_sala = q.nombre_sala
    AND c.edificio = q.edificio AND c.fecha = q.fecha AND c.id_turno = q.id_turno)"""
PRIVILEGED = """coalesce((SELECT p FROM privilegio AS v
    WHERE v.ci_participante = q.ci_participante), false)"""
ALLOWED = f"""coalesce((SELECT tipo_sala = 'libre' OR {PRIVILEGED} FROM sala AS h
    WHERE h.nombre_sala = q.nombre_sala AND h.edificio = q.edificio), false)"""


def _keys(table: str, rule: str, columns: list[str], source: str) -> str:
    text = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in columns)
    return f"""SELECT '{table}' AS tabla, '{rule}' AS regla, {text} AS clave, count(*) AS filas
        FROM {source} GROUP BY {", ".join(columns)} HAVING count(*) > 1"""


def _orphans(table: str, parent: str, columns: list[str], source: str, match: str) -> str:
    text = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in columns)
    return f"""SELECT '{table}', 'fk_{parent}', {text}, count(*) FROM {source} AS h
        WHERE NOT EXISTS (SELECT 1 FROM {match}) GROUP BY {", ".join(columns)}"""


RULES: dict[str, str] = {
    "s2_restricciones": " UNION ALL ".join(
        [
            _keys("facultad", "pk", ["id_facultad"], "facultad"),
            _keys("facultad", "uk_nombre", ["nombre"], "facultad"),
            _keys("programa_academico", "pk", ["nombre_programa"], "programa"),
            _keys("participante", "pk", ["ci"], "participante"),
            _keys("participante", "uk_email", ["email"], "participante"),
            _keys("participante_programa_academico", "pk", ["id_alumno_programa"], "inscripcion"),
            _keys("participante_programa_academico", "uk_participante_programa",
                  ["ci_participante", "nombre_programa"], "inscripcion"),
            _keys("edificio", "pk", ["nombre_edificio"], "edificio"),
            _keys("sala", "pk", ["nombre_sala", "edificio"], "sala"),
            _keys("turno", "pk", ["id_turno"], "turno"),
            _keys("turno", "uk_turno", ["hora_inicio", "hora_fin"], "turno"),
            _keys("reserva", "pk", ["id_reserva"], "reserva"),
            _keys("reserva", "uk_reserva", SLOT.split(", "), "reserva"),
            _keys("reserva_participante", "pk", ["ci_participante", "id_reserva"], "rp"),
            _keys("sancion_participante", "pk", ["id_sancion"], "sancion"),
            _orphans("programa_academico", "facultad", ["id_facultad"], "programa",
                     "facultad AS p WHERE p.id_facultad = h.id_facultad"),
            _orphans("participante_programa_academico", "participante", ["ci_participante"],
                     "inscripcion", "participante AS p WHERE p.ci = h.ci_participante"),
            _orphans("sala", "edificio", ["edificio"], "sala",
                     "edificio AS p WHERE p.nombre_edificio = h.edificio"),
            _orphans("reserva", "sala", ["nombre_sala", "edificio"], "reserva",
                     "sala AS p WHERE p.nombre_sala = h.nombre_sala AND p.edificio = h.edificio"),
            _orphans("reserva", "turno", ["id_turno"], "reserva",
                     "turno AS p WHERE p.id_turno = h.id_turno"),
            _orphans("reserva_participante", "participante", ["ci_participante"], "rp",
                     "participante AS p WHERE p.ci = h.ci_participante"),
            _orphans("reserva_participante", "reserva", ["id_reserva"], "rp",
                     "reserva AS p WHERE p.id_reserva = h.id_reserva"),
            _orphans("sancion_participante", "participante", ["ci_participante"], "sancion",
                     "participante AS p WHERE p.ci = h.ci_participante"),
        ]
    ),
    "v0_todas_las_reglas": f"""
        SELECT id_solicitud, {NO_SANCTION} AS sin_sancion, {ALLOWED} AS sala_permitida,
               {PRIVILEGED} AS privilegiado, {SAME_DAY} < 2 AS en_limite_dia,
               {SAME_WEEK} < 3 AS en_limite_semana, {FREE} AS turno_libre FROM solicitud AS q""",
    "v1_sin_sancion": f"SELECT id_solicitud, {NO_SANCTION} AS sin_sancion FROM solicitud AS q",
    "v2_limite_dia": f"SELECT id_solicitud, {SAME_DAY} < 2 AS en_limite_dia FROM solicitud AS q",
    "v3_limite_semana": f"""
        SELECT id_solicitud, {SAME_WEEK} < 3 AS en_limite_semana FROM solicitud AS q""",
    "v4_capacidad": """
        SELECT id_reserva, count(ci_participante) + id_reserva % 3 + 1 <= capacidad AS cabe
        FROM reserva JOIN sala USING (nombre_sala, edificio) LEFT JOIN rp USING (id_reserva)
        GROUP BY id_reserva, capacidad""",
    "v5_privilegiados": "SELECT ci_participante, p AS privilegiado FROM privilegio",
    "v6_sala_permitida": f"SELECT id_solicitud, {ALLOWED} AS sala_permitida FROM solicitud AS q",
    "v7_turno_libre": f"SELECT id_solicitud, {FREE} AS turno_libre FROM solicitud AS q",
    "v8_turno_libre_para_mover": """
        SELECT id_solicitud, NOT EXISTS (
            SELECT 1 FROM compra AS c WHERE c.nombre_sala = q.nombre_sala
            AND c.edificio = q.edificio AND c.fecha = q.fecha + 1 AND c.id_turno = q.id_turno
            AND c.id_solicitud <> q.id_solicitud) AS turno_libre FROM compra AS q""",
    "v9_participantes_eliminables": f"""
        SELECT ci, NOT EXISTS (SELECT 1 FROM compra AS c WHERE c.ci_participante = ci
                               AND c.fecha >= {STATE_AS_OF}) AS eliminable FROM participante""",
    "v10_salas_eliminables": f"""
        SELECT nombre_sala, edificio FROM sala AS s WHERE NOT EXISTS (
            SELECT 1 FROM reserva AS r WHERE r.nombre_sala = s.nombre_sala
            AND r.edificio = s.edificio AND (r.estado = 'activa' OR r.fecha >= {B}))""",
    "v11_periodo_solapado": f"""
        SELECT id_solicitud, EXISTS (SELECT 1 FROM sancion AS s
            WHERE s.ci_participante = q.ci_participante AND {touches("s", "q")}) AS solapada
        FROM pedido_sancion AS q""",
    "v12_solapada_salvo_propia": f"""
        WITH corta AS (SELECT id_sancion, ci_participante, fecha_inicio, fecha_fin - 8 AS fecha_fin
                       FROM sancion)
        SELECT id_sancion, EXISTS (SELECT 1 FROM sancion AS s
            WHERE s.ci_participante = q.ci_participante AND s.id_sancion <> q.id_sancion
            AND {touches("s", "q")}) AS solapada FROM corta AS q""",
    "v13_fechas_en_orden": """
        SELECT id_solicitud, fecha_fin > fecha_inicio AS fechas_en_orden FROM pedido_sancion""",
    "v14_datos_validos": """
        SELECT id_solicitud, try_cast(fecha AS DATE) AS fecha, try_cast(id_turno AS INTEGER) AS id_turno,
               nombre_sala <> '' AS completa,
               fecha <> 'ayer' AND id_turno <> 'x' AS datos_validos,
               estado <> 'otra' AS estado_valido FROM solicitud_texto""",
    "v15_no_pasada": f"SELECT id_solicitud, fecha >= {S} AS no_pasada FROM solicitud",
    "v16_existe_participante": """
        SELECT id_solicitud, ci_participante IN (SELECT ci FROM participante) AS existe
        FROM pedido_sancion""",
}


def outcomes(reason: str, source: str) -> str:
    """One row per request from a CASE that names the first failing check."""
    return f"""SELECT id_solicitud, motivo IS NULL AS aceptada, motivo
        FROM (SELECT id_solicitud, CASE {reason} END AS motivo FROM {source})"""


def before(condition: str, keys: str) -> str:
    return f"""count(*) FILTER (WHERE {condition}) OVER (PARTITION BY {keys} ORDER BY {TURN}
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def first(keys: str, eligible: str = "true", order: str = TURN) -> str:
    """Whether a row is the earliest eligible one of its key."""
    return f"""({eligible}) AND row_number() OVER (PARTITION BY {keys}, ({eligible})
        ORDER BY {order}) = 1"""


LATEST = "solicitada_en DESC, id_solicitud DESC"

ADMISSION = f"""
    WITH RECURSIVE juzgada AS MATERIALIZED (
        SELECT id_solicitud, solicitada_en, {NO_SANCTION} AS limpio, {ALLOWED} AS apta,
               ci_participante IN (SELECT ci FROM participante) AS existe,
               id_turno IN (SELECT id_turno FROM turno) AS hay_turno,
               {PRIVILEGED} AS libre_de_cuota, {SAME_DAY} AS dia, {SAME_WEEK} AS semana, {FREE} AS libre,
               ci_participante || '|' || fecha AS clave_dia,
               ci_participante || '|' || date_trunc('week', fecha) AS clave_semana,
               nombre_sala || '|' || edificio || '|' || fecha || '|' || id_turno AS clave_turno
        FROM solicitud AS q),
    fila AS MATERIALIZED (
        SELECT *, row_number() OVER (ORDER BY {TURN}) AS n FROM juzgada
        WHERE existe AND hay_turno AND limpio AND apta),
    paso AS (
        SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id_solicitud,
               CAST(NULL AS VARCHAR) AS motivo, CAST([] AS VARCHAR[]) AS turnos,
               CAST([] AS VARCHAR[]) AS dias, CAST([] AS VARCHAR[]) AS semanas
        UNION ALL
        SELECT n, id_solicitud, motivo,
               CASE WHEN motivo IS NULL THEN list_append(turnos, clave_turno) ELSE turnos END,
               CASE WHEN motivo IS NULL THEN list_append(dias, clave_dia) ELSE dias END,
               CASE WHEN motivo IS NULL THEN list_append(semanas, clave_semana) ELSE semanas END
        FROM (SELECT f.*, turnos, dias, semanas, CASE
                WHEN NOT libre_de_cuota AND
                     dia + len(list_filter(dias, lambda d: d = clave_dia)) >= 2 THEN 'limite_dia'
                WHEN NOT libre_de_cuota AND
                     semana + len(list_filter(semanas, lambda d: d = clave_semana)) >= 3
                     THEN 'limite_semana'
                WHEN NOT libre OR list_contains(turnos, clave_turno) THEN 'turno_ocupado'
                END AS motivo
              FROM paso AS p JOIN fila AS f ON f.n = p.n + 1))
    SELECT id_solicitud, motivo IS NULL AS aceptada, motivo FROM paso WHERE n > 0
    UNION ALL
    SELECT id_solicitud, false, CASE WHEN NOT existe THEN 'participante_inexistente'
                                     WHEN NOT hay_turno THEN 'turno_inexistente'
                                     WHEN NOT limpio THEN 'sancion_activa'
                                     ELSE 'sala_no_permitida' END
    FROM juzgada WHERE NOT (existe AND hay_turno AND limpio AND apta)"""


def creation(requests: str) -> str:
    """Sanction requests taken one after the other, all participants side by side."""
    return f"""
    WITH RECURSIVE fila AS MATERIALIZED (
        SELECT q.*, row_number() OVER (PARTITION BY ci_participante ORDER BY {TURN}) AS n,
               EXISTS (SELECT 1 FROM sancion AS s WHERE s.ci_participante = q.ci_participante
                       AND {touches("s", "q")}) AS ocupado
        FROM {requests} AS q WHERE ci_participante IN (SELECT ci FROM participante)),
    paso AS (
        SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id_solicitud, ci AS ci_participante,
               CAST(NULL AS VARCHAR) AS motivo,
               CAST([] AS STRUCT(fecha_inicio DATE, fecha_fin DATE)[]) AS dadas FROM participante
        UNION ALL
        SELECT n, id_solicitud, ci_participante, motivo,
               CASE WHEN motivo IS NULL
                    THEN list_append(dadas, {{'fecha_inicio': fecha_inicio, 'fecha_fin': fecha_fin}})
                    ELSE dadas END
        FROM (SELECT q.*, dadas, CASE
                WHEN ocupado OR len(list_filter(dadas, lambda s: {touches("s", "q")})) > 0
                     THEN 'periodo_solapado'
                WHEN q.fecha_fin <= q.fecha_inicio THEN 'fechas_invalidas' END AS motivo
              FROM paso AS p JOIN fila AS q
              ON q.n = p.n + 1 AND q.ci_participante = p.ci_participante))
    SELECT id_solicitud, motivo IS NULL AS aceptada, motivo FROM paso WHERE n > 0
    UNION ALL
    SELECT id_solicitud, false, 'participante_inexistente' FROM {requests}
    WHERE ci_participante NOT IN (SELECT ci FROM participante)"""


def alteration(changes: str) -> str:
    """Changes of sanction dates, judged against the state and then one after the other."""
    return f"""
    WITH RECURSIVE juzgado AS MATERIALIZED (
        SELECT q.*, v.ci_participante, EXISTS (SELECT 1 FROM sancion AS s
                   WHERE s.ci_participante = v.ci_participante AND s.id_sancion <> q.id_sancion
                   AND {touches("s", "q")}) AS ocupado,
               v.id_sancion IS NOT NULL AS existe
        FROM {changes} AS q LEFT JOIN sancion AS v ON v.id_sancion = q.id_sancion),
    fila AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY ci_participante ORDER BY {TURN}) AS n
        FROM juzgado WHERE existe AND NOT ocupado AND fecha_fin > fecha_inicio),
    paso AS (
        SELECT DISTINCT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id_solicitud, ci_participante,
               CAST(NULL AS BIGINT) AS id_sancion, CAST(NULL AS VARCHAR) AS motivo,
               CAST([] AS STRUCT(id_sancion BIGINT, fecha_inicio DATE, fecha_fin DATE)[]) AS dadas FROM fila
        UNION ALL
        SELECT n, id_solicitud, ci_participante, id_sancion, motivo,
               CASE WHEN motivo IS NULL THEN list_append(dadas, {{'id_sancion': id_sancion,
                    'fecha_inicio': fecha_inicio, 'fecha_fin': fecha_fin}}) ELSE dadas END
        FROM (SELECT q.*, dadas, CASE WHEN len(list_filter(dadas, lambda s:
                         s.id_sancion <> q.id_sancion AND {touches("s", "q")})) > 0
                         THEN 'periodo_solapado' END AS motivo
              FROM paso AS p JOIN fila AS q
              ON q.n = p.n + 1 AND q.ci_participante = p.ci_participante)),
    visto AS (
        SELECT *, n = max(n) FILTER (motivo IS NULL) OVER (PARTITION BY id_sancion) AS vigente
        FROM paso WHERE n > 0)
    SELECT id_solicitud, motivo IS NULL AND vigente AS aceptada,
           CASE WHEN motivo IS NULL AND NOT vigente THEN 'reemplazada' ELSE motivo END AS motivo
    FROM visto
    UNION ALL
    SELECT id_solicitud, false, CASE WHEN NOT existe THEN 'sancion_inexistente'
        WHEN ocupado THEN 'periodo_solapado' ELSE 'fechas_invalidas' END
    FROM juzgado WHERE NOT (existe AND NOT ocupado AND fecha_fin > fecha_inicio)"""


REGISTRATION = f"""
    WITH RECURSIVE juzgado AS MATERIALIZED (
        SELECT *, CASE WHEN apellido = '' THEN 'datos_incompletos'
            WHEN ci IN (SELECT ci FROM participante) OR email IN (SELECT email FROM participante)
                 THEN 'ya_registrado'
            WHEN nombre_programa NOT IN (SELECT nombre_programa FROM programa)
                 THEN 'programa_inexistente'
            WHEN rol = 'jefe' THEN 'rol_invalido' END AS falla
        FROM registro),
    fila AS MATERIALIZED (
        SELECT *, row_number() OVER (ORDER BY {TURN}) AS n FROM juzgado WHERE falla IS NULL),
    paso AS (
        SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id_solicitud, true AS aceptada,
               CAST([] AS BIGINT[]) AS cis, CAST([] AS VARCHAR[]) AS emails
        UNION ALL
        SELECT n, id_solicitud, nuevo,
               CASE WHEN nuevo THEN list_append(cis, ci) ELSE cis END,
               CASE WHEN nuevo THEN list_append(emails, email) ELSE emails END
        FROM (SELECT f.*, cis, emails,
                     NOT list_contains(cis, f.ci) AND NOT list_contains(emails, f.email) AS nuevo
              FROM paso AS p JOIN fila AS f ON f.n = p.n + 1))
    SELECT id_solicitud, aceptada, CASE WHEN NOT aceptada THEN 'ya_registrado' END AS motivo
    FROM paso WHERE n > 0
    UNION ALL SELECT id_solicitud, false, falla FROM juzgado WHERE falla IS NOT NULL"""

MOVES = f"""
    juzgada AS (
        SELECT q.*, EXISTS (SELECT 1 FROM reserva AS r WHERE r.nombre_sala = q.nombre_sala
                   AND r.edificio = q.edificio AND r.fecha = q.fecha AND r.id_turno = q.id_turno
                   AND r.id_reserva <> q.id_reserva) AS ocupado,
               q.id_reserva IN (SELECT id_reserva FROM reserva) AS existe,
               q.id_turno IN (SELECT id_turno FROM turno) AS hay_turno FROM mudanza AS q),
    una AS (SELECT *, {first("id_reserva", "existe AND NOT ocupado AND hay_turno")} AS primera FROM juzgada),
    otra AS (SELECT *, {first(SLOT, "primera")} AS gana FROM una)"""

STATUS = """
    juzgado AS (SELECT q.*, id_reserva IN (SELECT id_reserva FROM reserva) AS existe
                FROM cambio_estado AS q)"""

ROOM_CHANGES = f"""
    juzgado AS (
        SELECT q.*, s.nombre_sala IS NOT NULL AS existe,
               nuevo_edificio IN (SELECT nombre_edificio FROM edificio) AS hay_edificio,
               nuevo_nombre <> q.nombre_sala OR nuevo_edificio <> q.edificio AS renombra,
               EXISTS (SELECT 1 FROM sala AS o WHERE o.nombre_sala = nuevo_nombre
                       AND o.edificio = nuevo_edificio) AS tomado,
               EXISTS (SELECT 1 FROM compra AS c WHERE c.nombre_sala = q.nombre_sala
                       AND c.edificio = q.edificio) AS reservada,
               nueva_capacidad > 0 AND nuevo_tipo <> 'otro' AS valida
        FROM cambio_sala AS q LEFT JOIN sala AS s
        ON s.nombre_sala = q.nombre_sala AND s.edificio = q.edificio),
    una AS (SELECT *, {first("nombre_sala, edificio",
            "existe AND hay_edificio AND valida AND NOT (renombra AND (tomado OR reservada))")}
            AS primera FROM juzgado),
    otra AS (SELECT *, {first("nuevo_nombre, nuevo_edificio", "primera")} AS gana FROM una)"""

PERSON_DELETES = f"""
    juzgada AS (
        SELECT q.*, {first("ci")} AS primera, ci IN (SELECT ci FROM participante) AS existe,
               EXISTS (SELECT 1 FROM compra AS c WHERE c.ci_participante = q.ci
                       AND c.fecha >= {STATE_AS_OF}) AS activo FROM baja_persona AS q)"""

CHANGES: dict[str, str] = {
    "m1_admitir_reservas": ADMISSION,
    "m2_mover_reservas": f"""WITH {MOVES} """ + outcomes(
        """WHEN ocupado THEN 'turno_ocupado' WHEN NOT existe THEN 'reserva_inexistente'
           WHEN NOT hay_turno THEN 'turno_inexistente'
           WHEN NOT primera THEN 'repetida' WHEN NOT gana THEN 'turno_ocupado'""", "otra"),
    "m2_reservas_movidas": f"""WITH {MOVES}
        SELECT r.id_reserva, coalesce(m.nombre_sala, r.nombre_sala) AS nombre_sala,
               coalesce(m.edificio, r.edificio) AS edificio, coalesce(m.fecha, r.fecha) AS fecha,
               coalesce(m.id_turno, r.id_turno) AS id_turno, estado
        FROM reserva AS r LEFT JOIN (SELECT * FROM otra WHERE gana) AS m USING (id_reserva)""",
    "m3_cambiar_estado": f"WITH {STATUS} " + outcomes(
        "WHEN NOT existe THEN 'reserva_inexistente' WHEN nuevo = 'otra' THEN 'estado_invalido'",
        "juzgado"),
    "m3_reservas_con_estado": f"""WITH {STATUS},
        ultimo AS (SELECT * FROM juzgado WHERE nuevo <> 'otra'
                   QUALIFY row_number() OVER (PARTITION BY id_reserva ORDER BY {LATEST}) = 1)
        SELECT r.* EXCLUDE (estado), coalesce(nuevo, estado) AS estado
        FROM reserva AS r LEFT JOIN ultimo USING (id_reserva)""",
    "m3_cancelar_propias": """
        SELECT r.* EXCLUDE (estado), CASE WHEN id_reserva IN (
            SELECT b.id_reserva FROM baja_participante AS b JOIN rp
            ON rp.id_reserva = b.id_reserva AND rp.ci_participante = b.ci_participante)
            THEN 'cancelada' ELSE estado END AS estado FROM reserva AS r""",
    "m4_purgar_reservas": f"""WITH
        juzgada AS (SELECT q.*, estado, estado IN ('cancelada', 'sin asistencia') AS permitido
                    FROM baja_reserva AS q LEFT JOIN reserva USING (id_reserva)),
        una AS (SELECT *, {first("id_reserva", "coalesce(permitido, false)")} AS primera FROM juzgada) """ + outcomes(
        """WHEN estado IS NULL THEN 'reserva_inexistente'
           WHEN NOT permitido THEN 'estado_no_permitido'
           WHEN NOT primera THEN 'reserva_inexistente'""", "una"),
    "m4_participaciones_tras_purga": """
        SELECT ci_participante, id_reserva, asistencia FROM rp WHERE id_reserva NOT IN (
            SELECT id_reserva FROM reserva WHERE estado IN ('cancelada', 'sin asistencia'))""",
    "m5_agregar_participantes": f"""WITH
        cupo AS (SELECT id_reserva, capacidad - count(ci_participante) AS libres
                 FROM reserva JOIN sala USING (nombre_sala, edificio) LEFT JOIN rp USING (id_reserva)
                 GROUP BY id_reserva, capacidad),
        juzgada AS (
            SELECT q.*, libres, ci_participante IN (SELECT ci FROM participante) AS existe,
                   EXISTS (SELECT 1 FROM rp WHERE rp.id_reserva = q.id_reserva
                           AND rp.ci_participante = q.ci_participante) AS dentro
            FROM alta_participante AS q LEFT JOIN cupo USING (id_reserva)),
        una AS (SELECT *, {first("id_reserva, ci_participante",
                "libres IS NOT NULL AND existe AND NOT dentro")} AS util FROM juzgada),
        contada AS (SELECT *, {before("util", "id_reserva")} AS previas FROM una) """ + outcomes(
        """WHEN libres IS NULL THEN 'reserva_inexistente' WHEN previas >= libres THEN 'capacidad'
           WHEN NOT existe THEN 'participante_inexistente' WHEN NOT util THEN 'repetido'""",
        "contada"),
    "m6_quitar_participantes": f"""WITH
        grupo AS (SELECT id_reserva, count(*) AS n FROM rp GROUP BY id_reserva),
        juzgada AS (SELECT q.*, n, rp.id_reserva IS NOT NULL AS dentro
                    FROM baja_participante AS q JOIN grupo USING (id_reserva)
                    LEFT JOIN rp ON rp.id_reserva = q.id_reserva
                                AND rp.ci_participante = q.ci_participante),
        una AS (SELECT *, {first("id_reserva, ci_participante", "dentro")} AS util FROM juzgada),
        contada AS (SELECT *, {before("util", "id_reserva")} AS previas FROM una) """ + outcomes(
        """WHEN n - least(previas, n - 1) <= 1 THEN 'ultimo_participante'
           WHEN NOT util THEN 'no_participa'""", "contada"),
    "m7_marcar_asistencia": f"""WITH
        ultima AS (SELECT * FROM marca QUALIFY row_number() OVER (
                   PARTITION BY id_reserva, ci_participante ORDER BY {LATEST}) = 1)
        SELECT id_reserva, ci_participante, coalesce(asistio, asistencia) AS asistencia
        FROM rp LEFT JOIN ultima USING (id_reserva, ci_participante)""",
    "m8_crear_sanciones": creation("pedido_sancion"),
    "m9_cambiar_sanciones": alteration("cambio_sancion"),
    "m10_finalizar_sanciones": f"""WITH
        juzgada AS (SELECT q.*, fecha_inicio, fecha_fin, {first("id_sancion")} AS primera
                    FROM sancion_nombrada AS q LEFT JOIN sancion USING (id_sancion)) """ + outcomes(
        f"""WHEN fecha_fin IS NULL THEN 'sancion_inexistente'
            WHEN fecha_fin <= {S} THEN 'ya_finalizada' WHEN fecha_inicio >= {S} THEN 'sin_comenzar'
            WHEN NOT primera THEN 'ya_finalizada'""", "juzgada"),
    "m10_sanciones_finalizadas": f"""
        SELECT id_sancion, ci_participante, fecha_inicio,
               CASE WHEN fecha_inicio < {S} AND fecha_fin > {S}
                     AND id_sancion IN (SELECT id_sancion FROM sancion_nombrada)
                    THEN {S} ELSE fecha_fin END AS fecha_fin FROM sancion""",
    "m11_sanciones_automaticas": creation("pedido_automatico"),
    "m12_extender_sanciones": alteration("cambio_dias"),
    "m13_eliminar_sanciones": """
        SELECT * FROM sancion WHERE id_sancion NOT IN (SELECT id_sancion FROM sancion_nombrada)""",
    "m14_registrar_participantes": REGISTRATION,
    "m15_cambiar_participantes": f"""WITH
        apto AS (SELECT q.* FROM cambio_participante AS q JOIN participante AS p ON p.ci = q.ci
                 WHERE NOT EXISTS (SELECT 1 FROM participante AS o
                                   WHERE o.email = q.email AND o.ci <> q.ci)),
        dado AS (SELECT * FROM apto QUALIFY ci = first(ci) OVER (PARTITION BY email ORDER BY {TURN})),
        gana AS (SELECT * FROM dado QUALIFY row_number() OVER (
                 PARTITION BY ci ORDER BY {LATEST}) = 1)
        SELECT p.ci, coalesce(g.nombre, p.nombre) AS nombre,
               coalesce(g.apellido, p.apellido) AS apellido, coalesce(g.email, p.email) AS email
        FROM participante AS p LEFT JOIN gana AS g ON g.ci = p.ci""",
    "m16_eliminar_participantes": f"WITH {PERSON_DELETES} " + outcomes(
        """WHEN activo THEN 'con_reservas_activas'
           WHEN NOT (existe AND primera) THEN 'participante_inexistente'""", "juzgada"),
    "m16_sanciones_tras_bajas": f"""WITH {PERSON_DELETES}
        SELECT * FROM sancion WHERE ci_participante NOT IN (
            SELECT ci FROM juzgada WHERE existe AND NOT activo)""",
    "m17_agregar_inscripciones": f"""WITH
        nueva AS (
            SELECT * FROM pedido_inscripcion AS q
            WHERE rol <> 'jefe' AND ci_participante IN (SELECT ci FROM participante)
            AND nombre_programa IN (SELECT nombre_programa FROM programa)
            AND NOT EXISTS (SELECT 1 FROM inscripcion AS i WHERE i.ci_participante = q.ci_participante
                            AND i.nombre_programa = q.nombre_programa)
            QUALIFY row_number() OVER (PARTITION BY ci_participante, nombre_programa
                                       ORDER BY {TURN}) = 1)
        SELECT * FROM inscripcion UNION ALL
        SELECT (SELECT max(id_alumno_programa) FROM inscripcion)
               + row_number() OVER (ORDER BY {TURN}), ci_participante, nombre_programa, rol
        FROM nueva""",
    "m18_quitar_inscripciones": """
        SELECT * FROM inscripcion AS i WHERE NOT EXISTS (
            SELECT 1 FROM pedido_inscripcion AS q WHERE q.ci_participante = i.ci_participante
            AND q.nombre_programa = i.nombre_programa)""",
    "m19_crear_salas": f"""WITH
        juzgada AS (
            SELECT q.*, edificio IN (SELECT nombre_edificio FROM edificio) AS hay_edificio,
                   capacidad > 0 AND tipo_sala <> 'otro' AS valida,
                   EXISTS (SELECT 1 FROM sala AS s WHERE s.nombre_sala = q.nombre_sala
                           AND s.edificio = q.edificio) AS existe FROM alta_sala AS q),
        una AS (SELECT *, {first("nombre_sala, edificio",
                "hay_edificio AND valida AND NOT existe")} AS primera FROM juzgada) """ + outcomes(
        """WHEN NOT hay_edificio THEN 'edificio_inexistente' WHEN NOT valida THEN 'datos_invalidos'
           WHEN NOT primera THEN 'sala_duplicada'""", "una"),
    "m20_cambiar_salas": f"WITH {ROOM_CHANGES} " + outcomes(
        """WHEN NOT hay_edificio THEN 'edificio_inexistente' WHEN NOT existe THEN 'sala_inexistente'
           WHEN NOT valida THEN 'datos_invalidos' WHEN renombra AND tomado THEN 'sala_duplicada'
           WHEN renombra AND reservada THEN 'con_reservas' WHEN NOT primera THEN 'repetida'
           WHEN NOT gana THEN 'sala_duplicada'""", "otra"),
    "m20_salas_cambiadas": f"""WITH {ROOM_CHANGES}
        SELECT coalesce(nuevo_nombre, s.nombre_sala) AS nombre_sala,
               coalesce(nuevo_edificio, s.edificio) AS edificio,
               coalesce(nueva_capacidad, capacidad) AS capacidad,
               coalesce(nuevo_tipo, tipo_sala) AS tipo_sala
        FROM sala AS s LEFT JOIN (SELECT * FROM otra WHERE gana) AS g
        ON g.nombre_sala = s.nombre_sala AND g.edificio = s.edificio""",
    "m21_eliminar_salas": f"""WITH
        pedida AS (SELECT nombre_sala * 2 AS id_solicitud, nombre_sala, edificio FROM sala UNION ALL
                   SELECT nombre_sala * 2 + 1, nombre_sala, edificio + 1 FROM sala),
        juzgada AS (
            SELECT q.id_solicitud, s.nombre_sala IS NOT NULL AS existe,
                   bool_or(c.fecha >= {STATE_AS_OF}) AS activa,
                   bool_or(c.fecha >= DATE '2024-02-03') AS futura,
                   count(c.id_solicitud) > 0 AS usada
            FROM pedida AS q LEFT JOIN sala AS s
            ON s.nombre_sala = q.nombre_sala AND s.edificio = q.edificio
            LEFT JOIN compra AS c ON c.nombre_sala = q.nombre_sala AND c.edificio = q.edificio
            GROUP BY q.id_solicitud, s.nombre_sala) """ + outcomes(
        """WHEN activa THEN 'con_reservas_activas' WHEN futura THEN 'con_reservas_futuras'
           WHEN usada THEN 'con_reservas' WHEN NOT existe THEN 'sala_inexistente'""", "juzgada"),
    "m22_crear_edificios": f"""
        SELECT * FROM edificio UNION ALL
        SELECT * FROM (
            SELECT nombre, direccion, departamento FROM alta_edificio
            WHERE direccion <> '' AND departamento IS NOT NULL
            AND nombre NOT IN (SELECT nombre_edificio FROM edificio)
            QUALIFY row_number() OVER (PARTITION BY nombre ORDER BY {TURN}) = 1)""",
}


def _numbered(state: str, column: str, columns: str, result: str, requests: str) -> str:
    """New rows of a table: those of the accepted requests, numbered from its highest id on."""
    return f"""
        SELECT coalesce((SELECT max({column}) FROM {state}), 0) + row_number() OVER (ORDER BY {TURN}) AS {column},
               {columns} FROM ({result}) AS o JOIN {requests} AS q USING (id_solicitud) WHERE aceptada"""


#: The tables after a change.
CHANGES |= {
    "m1_reservas_nuevas": f"""
        SELECT id_solicitud AS id_reserva, {SLOT}, 'activa' AS estado FROM compra UNION ALL
        SELECT id_solicitud, {SLOT}, 'activa' FROM (
            {_numbered("compra", "id_solicitud", SLOT, ADMISSION, "solicitud")})""",
    "m1_participaciones_nuevas": f"""
        SELECT id_solicitud AS id_reserva, ci_participante, solicitada_en AS fecha_solicitud_reserva,
               CAST(NULL AS BOOLEAN) AS asistencia FROM compra UNION ALL
        SELECT id_solicitud, ci_participante, solicitada_en, NULL FROM (
            {_numbered("compra", "id_solicitud", "ci_participante, solicitada_en", ADMISSION, "solicitud")})""",
    "m5_participaciones": f"""
        SELECT id_reserva, ci_participante, asistencia FROM rp UNION ALL
        SELECT id_reserva, ci_participante, NULL FROM ({CHANGES["m5_agregar_participantes"]}) AS o
        JOIN alta_participante USING (id_solicitud) WHERE aceptada""",
    "m6_participaciones": f"""
        SELECT id_reserva, ci_participante, asistencia FROM rp ANTI JOIN (
            SELECT q.id_reserva, q.ci_participante FROM ({CHANGES["m6_quitar_participantes"]}) AS o
            JOIN baja_participante AS q USING (id_solicitud) WHERE aceptada) AS g
        USING (id_reserva, ci_participante)""",
    "m14_participantes": f"""
        SELECT ci, nombre, apellido, email FROM participante UNION ALL
        SELECT ci, nombre, apellido, email FROM ({REGISTRATION}) AS o
        JOIN registro USING (id_solicitud) WHERE aceptada""",
    "m19_salas": f"""
        SELECT nombre_sala, edificio, capacidad, tipo_sala FROM sala UNION ALL
        SELECT nombre_sala, edificio, capacidad, tipo_sala FROM ({CHANGES["m19_crear_salas"]}) AS o
        JOIN alta_sala USING (id_solicitud) WHERE aceptada""",
    "m21_salas": f"""
        SELECT * FROM sala WHERE nombre_sala * 2 NOT IN (
            SELECT id_solicitud FROM ({CHANGES["m21_eliminar_salas"]}) AS o WHERE aceptada)""",
}

#: The audit of what a change touched.
CHANGES |= {
    "s2_altas_sin_control": """
        WITH ahora AS (SELECT ci_participante, id_reserva FROM rp
                       UNION ALL SELECT ci_participante, id_reserva FROM alta_participante),
        clave AS (SELECT DISTINCT ci_participante, id_reserva FROM alta_participante)
        SELECT 'reserva_participante' AS tabla, 'pk' AS regla,
               CAST(ci_participante AS VARCHAR) || '|' || CAST(id_reserva AS VARCHAR) AS clave, count(*) AS filas
        FROM ahora JOIN clave USING (ci_participante, id_reserva)
        GROUP BY ci_participante, id_reserva HAVING count(*) > 1
        UNION ALL
        SELECT 'reserva_participante', 'fk_participante', CAST(ci_participante AS VARCHAR), count(*)
        FROM ahora SEMI JOIN clave USING (ci_participante)
        ANTI JOIN (SELECT ci AS ci_participante FROM participante) AS p USING (ci_participante)
        GROUP BY ci_participante
        UNION ALL
        SELECT 'reserva_participante', 'fk_reserva', CAST(id_reserva AS VARCHAR), count(*)
        FROM ahora SEMI JOIN clave USING (id_reserva) ANTI JOIN reserva USING (id_reserva)
        GROUP BY id_reserva""",
    "s2_reservas_admitidas": f"""
        WITH ahora AS ({CHANGES["m1_reservas_nuevas"]}),
        nueva AS (SELECT * FROM ahora WHERE id_reserva > (SELECT max(id_solicitud) FROM compra)),
        persona AS ({CHANGES["m1_participaciones_nuevas"]})
        SELECT 'reserva' AS tabla, 'pk' AS regla, CAST(id_reserva AS VARCHAR) AS clave, count(*) AS filas
        FROM ahora SEMI JOIN nueva USING (id_reserva) GROUP BY id_reserva HAVING count(*) > 1
        UNION ALL
        SELECT 'reserva', 'uk_reserva', concat_ws('|', nombre_sala, edificio, fecha, id_turno), count(*)
        FROM ahora SEMI JOIN nueva USING (nombre_sala, edificio, fecha, id_turno)
        GROUP BY nombre_sala, edificio, fecha, id_turno HAVING count(*) > 1
        UNION ALL
        SELECT 'reserva_participante', 'fk_participante', CAST(ci_participante AS VARCHAR), count(*)
        FROM persona WHERE ci_participante NOT IN (SELECT ci FROM participante)
        AND ci_participante IN (SELECT ci_participante FROM persona SEMI JOIN nueva USING (id_reserva))
        GROUP BY ci_participante""",
    "s7_reservas_tras_purga": f"""
        SELECT * FROM reserva ANTI JOIN (
            SELECT id_reserva FROM ({CHANGES["m4_purgar_reservas"]}) AS o
            JOIN baja_reserva USING (id_solicitud) WHERE aceptada) AS g USING (id_reserva)""",
}
for _name, _result, _requests in (
    ("m8_sanciones", creation("pedido_sancion"), "pedido_sancion"),
    ("m11_sanciones", creation("pedido_automatico"), "pedido_automatico"),
):
    _columns = "ci_participante, fecha_inicio, fecha_fin"
    CHANGES[_name] = f"""
        SELECT id_sancion, {_columns} FROM sancion UNION ALL
        SELECT * FROM ({_numbered("sancion", "id_sancion", _columns, _result, _requests)})"""
for _name, _requests in (("m9_sanciones", "cambio_sancion"), ("m12_sanciones", "cambio_dias")):
    CHANGES[_name] = f"""
        SELECT s.id_sancion, s.ci_participante, coalesce(c.fecha_inicio, s.fecha_inicio) AS fecha_inicio,
               coalesce(c.fecha_fin, s.fecha_fin) AS fecha_fin
        FROM sancion AS s LEFT JOIN (
            SELECT q.* FROM ({alteration(_requests)}) AS o JOIN {_requests} AS q USING (id_solicitud)
            WHERE aceptada) AS c ON c.id_sancion = s.id_sancion"""
