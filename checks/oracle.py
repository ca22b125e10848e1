"""Comparison SQL for DuckDB, written apart from the DataFrame code."""

from __future__ import annotations

import re

from checks.driver_tables import AS_OF_BOOKINGS, AS_OF_SANCTIONS

B = f"DATE '{AS_OF_BOOKINGS}'"
S = f"DATE '{AS_OF_SANCTIONS}'"

# Views of the booking model over the generated tables.
VIEWS: dict[str, str] = {
    "facultad": "SELECT r_regionkey AS id_facultad, r_name AS nombre FROM region",
    "programa": """SELECT n_name AS nombre_programa, n_regionkey AS id_facultad,
        CASE WHEN n_nationkey % 3 = 0 THEN 'posgrado' ELSE 'grado' END AS tipo FROM nation""",
    "participante": """SELECT s_suppkey AS ci, s_name AS nombre, 'A' || s_nationkey AS apellido,
        'p' || s_suppkey || '@campus.test' AS email FROM supplier""",
    "inscripcion": """
        SELECT s_suppkey * 2 AS id_alumno_programa, s_suppkey AS ci_participante,
               n_name AS nombre_programa,
               CASE WHEN s_suppkey % 5 = 0 THEN 'docente' ELSE 'alumno' END AS rol
        FROM supplier JOIN nation ON n_nationkey = s_nationkey
        UNION ALL
        SELECT s_suppkey * 2 + 1, s_suppkey, n_name, 'alumno'
        FROM supplier JOIN nation ON n_nationkey = (s_nationkey + 7) % 25
        WHERE s_suppkey % 4 = 0""",
    "edificio": """SELECT n_nationkey AS nombre_edificio, n_name AS direccion,
        'D' || n_regionkey AS departamento FROM nation""",
    "sala": """SELECT c_custkey AS nombre_sala, c_nationkey AS edificio,
        CAST(1 + c_custkey % 12 AS INTEGER) AS capacidad,
        CASE c_custkey % 3 WHEN 0 THEN 'libre' WHEN 1 THEN 'posgrado' ELSE 'docente' END
        AS tipo_sala FROM customer""",
    "turno": """SELECT CAST(i AS INTEGER) AS id_turno,
        lpad(CAST(i + 7 AS VARCHAR), 2, '0') || ':00:00' AS hora_inicio,
        lpad(CAST(i + 8 AS VARCHAR), 2, '0') || ':00:00' AS hora_fin
        FROM range(1, 16) AS n(i)""",
    "reserva": """SELECT o_orderkey AS id_reserva, c_custkey AS nombre_sala,
        c_nationkey AS edificio, CAST(o_orderdate AS DATE) AS fecha,
        CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS id_turno,
        CASE WHEN o_orderstatus = 'F' THEN 'finalizada' WHEN o_orderstatus = 'O' THEN 'activa'
             WHEN o_orderkey % 2 = 0 THEN 'cancelada' ELSE 'sin asistencia' END AS estado
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    "rp": """SELECT l_suppkey AS ci_participante, l_orderkey AS id_reserva,
        min(l_shipdate) AS fecha_solicitud_reserva,
        CASE max(l_returnflag) WHEN 'A' THEN true WHEN 'R' THEN false END AS asistencia
        FROM lineitem GROUP BY ALL""",
    "sancion": """SELECT event_id AS id_sancion, user_id AS ci_participante,
        CAST(ts AS DATE) AS fecha_inicio,
        CAST(ts AS DATE) + CAST([7, 15, 30, 60][event_id % 4 + 1] AS INTEGER) AS fecha_fin
        FROM events WHERE event_type = 'error'""",
}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the views it uses, directly or through other views."""
    views = {**VIEWS, **(extra or {})}

    def used(text: str) -> set[str]:
        return {v for v in views if re.search(rf"\b(?:FROM|JOIN)\s+{v}\b", text)}

    needed: set[str] = set()
    todo = used(sql)
    while todo:
        name = todo.pop()
        needed.add(name)
        todo |= used(views[name]) - needed
    if not needed:
        return sql
    ctes = ",\n".join(f"{v} AS ({views[v]})" for v in views if v in needed)
    own = re.match(r"\s*WITH\b( RECURSIVE)?(.*)", sql, re.DOTALL)
    if own is None:
        return f"WITH {ctes}\n{sql}"
    return f"WITH{own.group(1) or ''} {ctes},{own.group(2)}"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def pct(part: str, whole: str) -> str:
    n = f"nullif({big(whole)}, 0)"
    return f"((20000 * {big(part)} + {n}) // (2 * {n})) / 100.0"


def user_type(short: bool = False) -> str:
    prefix = "" if short else "Alumno "
    return f"""CASE WHEN rol = 'docente' THEN 'Docente'
        WHEN tipo = 'posgrado' THEN '{prefix}Posgrado' ELSE '{prefix}Grado' END"""


def state(as_of: str) -> str:
    return f"""CASE WHEN fecha_fin < {as_of} THEN 'FINALIZADA'
        WHEN fecha_inicio > {as_of} THEN 'FUTURA' ELSE 'ACTIVA' END"""


ROOM = "nombre_sala, edificio"

REPORTS: dict[str, str] = {
    "r1_salas_mas_reservadas": f"""
        SELECT {ROOM}, capacidad, tipo_sala, count(id_reserva) AS total_reservas
        FROM sala LEFT JOIN reserva USING ({ROOM}) GROUP BY ALL
        ORDER BY total_reservas DESC, {ROOM} LIMIT 10""",
    "r2_turnos_demandados": """
        SELECT id_turno, hora_inicio || ' - ' || hora_fin AS horario,
               count(id_reserva) AS total_reservas
        FROM turno LEFT JOIN reserva USING (id_turno) GROUP BY ALL""",
    "r3_promedio_participantes": f"""
        WITH por_reserva AS (
            SELECT id_reserva, {ROOM}, count(ci_participante) AS n
            FROM reserva LEFT JOIN rp USING (id_reserva) GROUP BY ALL)
        SELECT {ROOM}, capacidad,
               coalesce(CAST(sum(n) AS DOUBLE) / count(n), 0) AS promedio_participantes,
               coalesce({pct("sum(n)", "count(n) * capacidad")}, 0) AS porcentaje_capacidad
        FROM sala LEFT JOIN por_reserva USING ({ROOM}) GROUP BY {ROOM}, capacidad""",
    "r4_reservas_por_carrera": """
        SELECT f.nombre AS facultad, p.nombre_programa, p.tipo AS tipo_programa,
               count(DISTINCT r.id_reserva) AS total_reservas
        FROM facultad AS f JOIN programa AS p USING (id_facultad)
        LEFT JOIN inscripcion AS i ON i.nombre_programa = p.nombre_programa
        LEFT JOIN rp ON rp.ci_participante = i.ci_participante
        LEFT JOIN reserva AS r ON r.id_reserva = rp.id_reserva GROUP BY ALL""",
    "r5_ocupacion_edificio": f"""
        WITH recientes AS (SELECT * FROM reserva WHERE fecha >= {B} - 30)
        SELECT nombre_edificio, count(DISTINCT s.nombre_sala) AS total_salas,
               count(r.id_reserva) AS total_reservas,
               {pct("count(r.id_reserva)",
                    "count(DISTINCT s.nombre_sala) * (SELECT count(*) FROM turno) * 30")}
               AS porcentaje_ocupacion
        FROM edificio LEFT JOIN sala AS s ON s.edificio = nombre_edificio
        LEFT JOIN recientes AS r ON r.nombre_sala = s.nombre_sala AND r.edificio = s.edificio
        GROUP BY nombre_edificio""",
    "r6_reservas_por_tipo": f"""
        SELECT {user_type()} AS tipo_usuario,
               count(DISTINCT i.ci_participante) AS total_usuarios,
               count(DISTINCT rp.id_reserva) AS total_reservas,
               count(*) FILTER (WHERE asistencia) AS total_asistencias,
               count(*) FILTER (WHERE NOT asistencia) AS total_inasistencias,
               {pct("count(*) FILTER (WHERE asistencia)", "count(rp.id_reserva)")}
               AS porcentaje_asistencia
        FROM inscripcion AS i JOIN programa USING (nombre_programa)
        LEFT JOIN rp ON rp.ci_participante = i.ci_participante GROUP BY tipo_usuario""",
    "r7_sanciones_por_tipo": f"""
        SELECT {user_type()} AS tipo_usuario,
               count(DISTINCT ci_participante) AS usuarios_sancionados,
               count(id_sancion) AS total_sanciones,
               count(*) FILTER (WHERE {S} BETWEEN fecha_inicio AND fecha_fin)
               AS sanciones_activas,
               (2 * {big("sum(fecha_fin - fecha_inicio)")} + count(*)) // (2 * count(*))
               AS duracion_promedio_dias
        FROM sancion JOIN inscripcion USING (ci_participante)
        JOIN programa USING (nombre_programa) GROUP BY tipo_usuario""",
    "r8_efectividad": f"""
        SELECT estado, count(*) AS total,
               {pct("count(*)", "(SELECT count(*) FROM reserva)")} AS porcentaje
        FROM reserva GROUP BY estado""",
    "r9_horas_semana": f"""
        SELECT CAST(isoyear(fecha) * 100 + week(fecha) AS INTEGER) AS semana,
               CAST(year(fecha) AS INTEGER) AS anio,
               CAST(CASE WHEN isoyear(fecha) < year(fecha) THEN 0
                         WHEN isoyear(fecha) > year(fecha) THEN 53
                         ELSE week(fecha) END AS INTEGER) AS num_semana,
               CAST(date_trunc('week', fecha) AS DATE) AS inicio_semana,
               count(*) AS total_horas_reservadas,
               count(*) FILTER (WHERE estado = 'activa') AS horas_activas,
               count(*) FILTER (WHERE estado = 'finalizada') AS horas_finalizadas,
               count(*) FILTER (WHERE estado = 'cancelada') AS horas_canceladas
        FROM reserva WHERE fecha >= {B} - 56 GROUP BY ALL""",
    "r10_participantes_sancionados": f"""
        SELECT ci, p.nombre, apellido, email, count(id_sancion) AS total_sanciones,
               count(id_sancion) FILTER (WHERE {S} BETWEEN fecha_inicio AND fecha_fin)
               AS sanciones_activas,
               max(fecha_fin) AS ultima_sancion_fin,
               string_agg(DISTINCT rol, ', ' ORDER BY rol) AS roles
        FROM participante AS p LEFT JOIN sancion AS s ON s.ci_participante = ci
        LEFT JOIN inscripcion AS i ON i.ci_participante = ci
        GROUP BY ci, p.nombre, apellido, email HAVING count(id_sancion) > 0
        ORDER BY total_sanciones DESC, ultima_sancion_fin DESC, ci LIMIT 10""",
    "r11_edificios_cancelaciones": f"""
        WITH base AS (
            SELECT nombre_edificio, direccion, count(id_reserva) AS total_reservas,
                   count(*) FILTER (WHERE estado = 'cancelada') AS total_canceladas,
                   count(*) FILTER (WHERE estado = 'sin asistencia') AS total_sin_asistencia
            FROM edificio JOIN sala AS s ON s.edificio = nombre_edificio
            JOIN reserva AS r ON r.nombre_sala = s.nombre_sala AND r.edificio = s.edificio
            GROUP BY ALL)
        SELECT *, {pct("total_canceladas", "total_reservas")} AS porcentaje_cancelacion,
               {pct("total_canceladas + total_sin_asistencia", "total_reservas")}
               AS porcentaje_problematicas FROM base""",
}

BASIC_REPORTS: dict[str, str] = {
    "r1b_salas_mas_reservadas": f"""
        SELECT {ROOM}, count(id_reserva) AS total_reservas
        FROM sala LEFT JOIN reserva USING ({ROOM}) GROUP BY ALL
        ORDER BY total_reservas DESC, {ROOM} LIMIT 10""",
    "r2b_turnos_demandados": REPORTS["r2_turnos_demandados"],
    "r3b_promedio_participantes": f"""
        WITH por_reserva AS (
            SELECT id_reserva, {ROOM}, count(ci_participante) AS n
            FROM reserva LEFT JOIN rp USING (id_reserva) GROUP BY ALL)
        SELECT {ROOM}, CAST(sum(n) AS DOUBLE) / count(n) AS promedio_participantes
        FROM sala LEFT JOIN por_reserva USING ({ROOM}) GROUP BY {ROOM}""",
    "r4b_reservas_por_carrera": """
        SELECT f.nombre AS facultad, p.nombre_programa,
               count(DISTINCT r.id_reserva) AS total_reservas
        FROM facultad AS f JOIN programa AS p USING (id_facultad)
        LEFT JOIN inscripcion AS i ON i.nombre_programa = p.nombre_programa
        LEFT JOIN rp ON rp.ci_participante = i.ci_participante
        LEFT JOIN reserva AS r ON r.id_reserva = rp.id_reserva GROUP BY ALL""",
    "r5b_ocupacion_edificio": REPORTS["r5_ocupacion_edificio"],
    "r6b_reservas_por_tipo": f"""
        SELECT {user_type(short=True)} AS tipo_usuario,
               count(DISTINCT id_reserva) AS total_reservas,
               count(*) FILTER (WHERE asistencia) AS total_asistencias
        FROM rp JOIN inscripcion USING (ci_participante) JOIN programa USING (nombre_programa)
        GROUP BY tipo_usuario""",
    "r7b_sanciones_por_tipo": f"""
        SELECT {user_type(short=True)} AS tipo_usuario,
               count(DISTINCT id_sancion) AS total_sanciones
        FROM sancion JOIN inscripcion USING (ci_participante)
        JOIN programa USING (nombre_programa) GROUP BY tipo_usuario""",
    "r8b_efectividad": REPORTS["r8_efectividad"],
    "r9b_horas_semana": f"""
        SELECT CAST(isoyear(fecha) * 100 + week(fecha) AS INTEGER) AS semana,
               CAST(date_trunc('week', fecha) AS DATE) AS inicio_semana,
               count(*) AS total_horas_reservadas
        FROM reserva WHERE fecha >= {B} - 56 GROUP BY ALL""",
    "r10b_participantes_sancionados": """
        SELECT ci, p.nombre, apellido, count(*) AS total_sanciones
        FROM participante AS p JOIN sancion AS s ON s.ci_participante = ci
        GROUP BY ci, p.nombre, apellido ORDER BY total_sanciones DESC, ci LIMIT 10""",
    "r11b_edificios_cancelaciones": f"""
        WITH base AS (
            SELECT nombre_edificio, count(id_reserva) AS total_reservas,
                   count(*) FILTER (WHERE estado = 'cancelada') AS canceladas
            FROM edificio JOIN sala AS s ON s.edificio = nombre_edificio
            JOIN reserva AS r ON r.nombre_sala = s.nombre_sala AND r.edificio = s.edificio
            GROUP BY ALL)
        SELECT *, {pct("canceladas", "total_reservas")} AS porcentaje_cancelacion FROM base""",
}


LISTINGS: dict[str, str] = {
    "l1_reservas_recientes": """
        SELECT id_reserva, nombre_sala, edificio, fecha, id_turno, hora_inicio, hora_fin, estado,
               hora_inicio || ' - ' || hora_fin AS horario,
               count(ci_participante) AS num_participantes
        FROM reserva JOIN turno USING (id_turno) LEFT JOIN rp USING (id_reserva) GROUP BY ALL
        ORDER BY fecha DESC, hora_inicio DESC, id_reserva DESC LIMIT 100""",
    "l2_reservas_detalle": """
        SELECT id_reserva, nombre_sala, edificio, fecha, id_turno, estado, hora_inicio, hora_fin,
               hora_inicio || ' - ' || hora_fin AS horario, capacidad, tipo_sala,
               upper(estado) AS estado_texto
        FROM reserva JOIN turno USING (id_turno) JOIN sala USING (nombre_sala, edificio)""",
    "l3_reservas_con_participantes": """
        WITH persona AS (
            SELECT id_reserva, '{"ci_participante":' || ci || ',"nombre":"' || nombre
                   || '","apellido":"' || apellido || '","email":"' || email
                   || '","asistencia":' || coalesce(CAST(asistencia AS VARCHAR), 'null') || '}' AS txt, ci
            FROM rp JOIN participante ON ci = ci_participante)
        SELECT id_reserva, '[' || coalesce(string_agg(txt, ',' ORDER BY ci), '') || ']' AS participantes
        FROM reserva JOIN sala USING (nombre_sala, edificio) LEFT JOIN persona USING (id_reserva)
        GROUP BY ALL""",
    "l3_participantes_de_reservas": """
        SELECT id_reserva, ci_participante, nombre, apellido, email, asistencia
        FROM rp JOIN participante ON ci = ci_participante""",
    "g2_reservas_por_programa_en_meses": """
        SELECT nombre_programa, count(DISTINCT id_reserva) AS total_reservas
        FROM rp JOIN reserva USING (id_reserva) JOIN inscripcion USING (ci_participante)
        WHERE strftime(fecha, '%Y-%m') BETWEEN '1999-02' AND '2000-11' GROUP BY ALL""",
    "g2_reservas_por_tipo_en_meses": """
        SELECT CASE WHEN rol = 'docente' THEN 'Docente' WHEN tipo = 'posgrado' THEN 'Alumno Posgrado'
                    ELSE 'Alumno Grado' END AS tipo_usuario, count(DISTINCT id_reserva) AS total_reservas
        FROM rp JOIN reserva USING (id_reserva) JOIN inscripcion USING (ci_participante)
        JOIN programa USING (nombre_programa)
        WHERE strftime(fecha, '%Y-%m') BETWEEN '1999-02' AND '2000-11' GROUP BY ALL""",
    "l4_reservas_por_participante": """
        SELECT * EXCLUDE (hora_inicio) FROM (
            SELECT ci_participante, id_reserva, nombre_sala, edificio, fecha, hora_inicio, estado,
                   hora_inicio || ' - ' || hora_fin AS horario, asistencia,
                   CAST(row_number() OVER (PARTITION BY ci_participante
                        ORDER BY fecha DESC, hora_inicio DESC, id_reserva DESC) AS INTEGER) AS orden
            FROM rp JOIN reserva USING (id_reserva) JOIN turno USING (id_turno))
        WHERE orden <= 20""",
    "l6_salas": """
        SELECT nombre_sala, s.edificio, capacidad, tipo_sala, direccion,
               nombre_sala || ' (' || s.edificio || ')' AS etiqueta,
               upper(tipo_sala[1]) || tipo_sala[2:] AS tipo_texto
        FROM sala AS s JOIN edificio AS e ON e.nombre_edificio = s.edificio""",
    "l8_edificios": "SELECT nombre_edificio, direccion FROM edificio",
    "l10_participantes": """
        SELECT ci, nombre, apellido, email, nombre || ' ' || apellido AS nombre_completo,
               string_agg(rol || ' en ' || nombre_programa, ', '
                          ORDER BY rol || ' en ' || nombre_programa) AS programas
        FROM participante LEFT JOIN inscripcion ON ci_participante = ci GROUP BY ALL""",
    "l11_participantes_con_programas": """
        SELECT ci, nombre, apellido, email,
               '[' || coalesce(string_agg('{"nombre_programa":"' || nombre_programa || '","rol":"'
                   || rol || '"}', ',' ORDER BY nombre_programa, rol), '') || ']' AS programas
        FROM participante LEFT JOIN inscripcion ON ci_participante = ci GROUP BY ALL""",
    "l12_programas": "SELECT * FROM programa",
    "l13_sanciones": f"""
        SELECT id_sancion, ci_participante, nombre, apellido, email, fecha_inicio, fecha_fin,
               {state(S)} AS estado, CAST(fecha_fin - fecha_inicio AS INTEGER) AS duracion_dias
        FROM sancion JOIN participante ON ci = ci_participante""",
    "l15_sanciones_por_participante": f"""
        SELECT ci_participante, id_sancion, fecha_inicio, fecha_fin, {state(S)} AS estado
        FROM sancion""",
    "l16_disponibles_por_reserva": """
        SELECT id_reserva, (SELECT count(*) FROM participante) - count(ci) AS disponibles
        FROM reserva LEFT JOIN rp USING (id_reserva) LEFT JOIN participante ON ci = ci_participante
        GROUP BY id_reserva""",
    "l16_fuera_de_una_reserva": """
        SELECT ci, nombre, apellido FROM participante WHERE ci NOT IN (
            SELECT ci_participante FROM rp WHERE id_reserva = (SELECT max(id_reserva) FROM reserva))""",
    "l7_sala": """
        SELECT nombre_sala, s.edificio, capacidad, tipo_sala, direccion FROM sala AS s
        JOIN edificio ON nombre_edificio = s.edificio
        WHERE nombre_sala = (SELECT max(nombre_sala) FROM sala)""",
    "l14_sancion": f"""
        SELECT id_sancion, ci_participante, nombre, apellido, email, fecha_inicio, fecha_fin,
               {state(S)} AS estado
        FROM sancion JOIN participante ON ci = ci_participante
        WHERE id_sancion = (SELECT min(id_sancion) FROM sancion JOIN participante ON ci = ci_participante)""",
    "l20_por_email": """
        SELECT * FROM participante WHERE email = (SELECT max(email) FROM participante)""",
    "l17_pertenencias": """
        WITH pedido AS (
            SELECT id_reserva, ci_participante FROM rp
            UNION ALL SELECT id_reserva, ci_participante + 1 FROM rp)
        SELECT id_reserva, ci_participante FROM pedido AS q
        WHERE EXISTS (SELECT 1 FROM rp WHERE rp.id_reserva = q.id_reserva
                      AND rp.ci_participante = q.ci_participante)""",
    "l18_docentes": """
        SELECT * FROM participante
        WHERE ci IN (SELECT ci_participante FROM inscripcion WHERE rol = 'docente')""",
    "l19_sanciones_vigentes": f"""
        SELECT * FROM (SELECT ci_participante, id_sancion, fecha_inicio, fecha_fin FROM sancion
                       WHERE {S} BETWEEN fecha_inicio AND fecha_fin)
        QUALIFY row_number() OVER (PARTITION BY ci_participante
                                   ORDER BY fecha_fin DESC, id_sancion DESC) = 1""",
    "s5_reservas_json": """
        SELECT '{"nombre_edificio":' || edificio || ',"total_reservas":' || count(*) || '}' AS json
        FROM reserva GROUP BY edificio""",
}

KPIS: dict[str, str] = {
    "k1_tablero": f"""
        SELECT (SELECT count(*) FROM participante) AS total_participantes,
               (SELECT count(*) FROM sala) AS total_salas,
               (SELECT count(*) FROM reserva WHERE estado = 'activa') AS reservas_activas,
               (SELECT count(*) FROM sancion WHERE {S} BETWEEN fecha_inicio AND fecha_fin)
               AS sanciones_activas""",
    "k2_estadisticas_sala": f"""
        SELECT {ROOM}, count(id_reserva) AS total_reservas,
               count(*) FILTER (WHERE estado = 'activa') AS reservas_activas,
               coalesce({pct("count(*) FILTER (WHERE estado = 'cancelada')", "count(id_reserva)")}, 0)
               AS tasa_cancelacion
        FROM sala LEFT JOIN reserva USING ({ROOM}) GROUP BY {ROOM}""",
    "k3_estadisticas_sanciones": f"""
        SELECT count(*) FILTER (WHERE vigente) AS activas, count(*) AS totales,
               count(DISTINCT ci_participante) FILTER (WHERE vigente) AS participantes_sancionados,
               ((20 * {big("sum(fecha_fin - fecha_inicio)")} + count(*)) // (2 * count(*))) / 10.0
               AS duracion_promedio_dias
        FROM (SELECT *, {S} BETWEEN fecha_inicio AND fecha_fin AS vigente FROM sancion)""",
    "k4_estados_pagina": """
        SELECT estado, count(*) AS total
        FROM (SELECT estado FROM reserva JOIN turno USING (id_turno)
              ORDER BY fecha DESC, hora_inicio DESC, id_reserva DESC LIMIT 100)
        GROUP BY estado""",
    "k4_estados_todas": "SELECT estado, count(*) AS total FROM reserva GROUP BY estado",
    "k5_sanciones_por_estado": f"""
        SELECT {state(S)} AS estado, count(*) AS total
        FROM sancion JOIN participante ON ci = ci_participante GROUP BY 1""",
    "k6_lugares_restantes": """
        SELECT id_reserva, capacidad, count(ci_participante) AS num_participantes,
               capacidad - count(ci_participante) AS lugares_restantes,
               count(ci_participante) >= capacidad AS completa
        FROM reserva JOIN sala USING (nombre_sala, edificio) LEFT JOIN rp USING (id_reserva)
        GROUP BY id_reserva, capacidad""",
    "k7_nivel_cancelacion": f"""
        SELECT *, CASE WHEN porcentaje_cancelacion > 20 THEN 'danger'
                       WHEN porcentaje_cancelacion > 10 THEN 'warning' ELSE 'success' END AS nivel
        FROM (SELECT edificio AS nombre_edificio,
                     {pct("count(*) FILTER (WHERE estado = 'cancelada')", "count(*)")}
                     AS porcentaje_cancelacion
              FROM reserva GROUP BY edificio)""",
    "k8_reservas_propias": """
        SELECT ci, least(count(id_reserva), 20) AS reservas
        FROM participante LEFT JOIN rp ON ci_participante = ci GROUP BY ci""",
}


def all_sql() -> dict[str, str]:
    from checks.oracle_changes import CHANGE_VIEWS, CHANGES, RULES

    plain = {**REPORTS, **BASIC_REPORTS, **LISTINGS, **KPIS, **RULES, **CHANGES}
    return {name: with_views(sql, CHANGE_VIEWS) for name, sql in plain.items()}
