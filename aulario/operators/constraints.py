"""Integrity audit: keys, references, row rules, value domains and missing values.

The whole state is audited by ``check_constraints``, what a change made of a sound state by
``check_changes``, which reads the changed rows and what shares a key with them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulario.operators.changes import ChangeResult
from aulario.session import cut
from aulario.sources.schemas import CHECKS, ENUM_DOMAINS, FOREIGN_KEYS, UNIQUE_KEYS, ForeignKey
from aulario.tables import Tables

NULLABLE = {"asistencia"}


def _key_text(columns: tuple[str, ...]) -> F.Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns])


def _violations(df: DataFrame, table: str, rule: str, columns: tuple[str, ...]) -> DataFrame:
    return df.select(
        F.lit(table).alias("tabla"),
        F.lit(rule).alias("regla"),
        _key_text(columns).alias("clave"),
        F.col("filas"),
    )


def duplicate_keys(df: DataFrame, table: str, rule: str, columns: tuple[str, ...]) -> DataFrame:
    repeated = df.groupBy(*columns).agg(F.count("*").alias("filas")).filter("filas > 1")
    return _violations(repeated, table, rule, columns)


def _parent_keys(t: Tables, key: ForeignKey) -> DataFrame:
    return getattr(t, key.parent).select(
        *[F.col(p).alias(c) for c, p in zip(key.columns, key.parent_columns, strict=True)]
    )


def dangling_references(t: Tables, table: str) -> list[DataFrame]:
    """Child keys without a parent, counted per key before the anti join."""
    found = []
    for key in FOREIGN_KEYS.get(table, []):
        child = getattr(t, table).groupBy(*key.columns).agg(F.count("*").alias("filas"))
        child = child.dropna(subset=list(key.columns))
        orphans = child.join(_parent_keys(t, key), list(key.columns), "left_anti")
        found.append(_violations(orphans, table, f"fk_{key.parent}", key.columns))
    return found


def broken_row_rules(df: DataFrame, table: str) -> DataFrame:
    """Rows breaking a CHECK, a value domain or NOT NULL, found in one scan."""
    pk = UNIQUE_KEYS[table]["pk"]
    broken = {f"check_{name}": ~F.expr(rule) for name, rule in CHECKS.get(table, {}).items()}
    for column, domain in ENUM_DOMAINS.get(table, {}).items():
        broken[f"enum_{column}"] = ~F.col(column).isin(domain)
    for column in df.columns:
        if column not in NULLABLE:
            broken[f"not_null_{column}"] = F.col(column).isNull()
    rules = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in broken.items()]))
    return (
        df.select(_key_text(pk).alias("clave"), F.explode(rules).alias("regla"))
        .groupBy("regla", "clave")
        .agg(F.count("*").alias("filas"))
        .select(F.lit(table).alias("tabla"), "regla", "clave", "filas")
    )


def check_constraints(t: Tables, only: list[str] | None = None) -> DataFrame:
    """All violations as (tabla, regla, clave, filas); empty for a sound data set.

    The violations of each rule are dealt anew: their groups are then a stage of their own. In a
    stage of all rules together, the tasks would be shared out among them, a few for each.
    """
    parts: list[DataFrame] = []
    for table, df in t.items():
        if only is not None and table not in only:
            continue
        for rule, columns in UNIQUE_KEYS[table].items():
            parts.append(duplicate_keys(df, table, rule, columns))
        parts += dangling_references(t, table)
        parts.append(broken_row_rules(df, table))
    return reduce(DataFrame.unionByName, [part.repartition("clave") for part in parts])


def _same_keys(df: DataFrame, keys: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows that share their key with ``keys``; a missing value is a key of its own, as it is when grouping."""
    asked = keys.select(*[F.col(c).alias(f"_{c}") for c in columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
    return df.join(asked, same, "left_semi")


def _newly_dangling(
    after: Tables, rows: dict[str, DataFrame], gone: dict[str, DataFrame]
) -> list[DataFrame]:
    """References of changed rows, and to parents that went, that lead nowhere; counted over all rows that hold them."""
    found = []
    for table in after.names():
        for key in FOREIGN_KEYS.get(table, []):
            asked = []
            if table in rows:
                asked.append(rows[table].select(*key.columns))
            if key.parent in gone:
                left = [F.col(p).alias(c) for c, p in zip(key.columns, key.parent_columns, strict=True)]
                asked.append(gone[key.parent].select(*left))
            if not asked:
                continue
            wanted = reduce(DataFrame.union, asked).dropna().distinct()
            lost = wanted.join(_parent_keys(after, key), list(key.columns), "left_anti")
            child = getattr(after, table).join(cut(lost), list(key.columns), "left_semi")
            orphans = child.groupBy(*key.columns).agg(F.count("*").alias("filas"))
            found.append(_violations(orphans, table, f"fk_{key.parent}", key.columns))
    return found


def check_changes(before: Tables, result: ChangeResult) -> DataFrame:
    """The violations that a change brought into a sound state, as ``check_constraints`` would name them.

    Only the rows the change touched are audited: their own rules and references, the unique
    keys they have now, and what refers to those that are gone. If the state before has no
    violation, these are all violations of the new state.
    """
    after = result.tables
    rows, gone = {}, {}
    for table, keys in result.touched.items():
        named = cut(keys.distinct())
        rows[table] = cut(getattr(after, table).join(named, named.columns, "left_semi"))
        gone[table] = getattr(before, table).join(named, named.columns, "left_semi")
    parts = _newly_dangling(after, rows, gone)
    for table, changed in rows.items():
        for rule, columns in UNIQUE_KEYS[table].items():
            near = _same_keys(getattr(after, table), changed, columns)
            parts.append(duplicate_keys(near, table, rule, columns))
        parts.append(broken_row_rules(changed, table))
    return reduce(DataFrame.unionByName, parts)
