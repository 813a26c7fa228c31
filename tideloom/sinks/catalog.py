"""Catalog registration through Spark's own catalog."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from .table import COMMIT_COLUMN, MERGE_ON_READ, VersionedTable

_ASKED = "tideloom.asked"
_NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
_AT_ONCE = 200


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _create(spark: SparkSession, full: str, schema: T.StructType, path: str, parts: Sequence[str] = ()) -> bool:
    """Create an external table unless it is there as asked for; whether it was created."""
    asked = hashlib.sha256(f"{path}|{schema.json()}|{','.join(parts)}".encode()).hexdigest()
    if spark.catalog.tableExists(full):
        held = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {full}").collect()}
        if held.get(_ASKED) == asked:
            return False
        spark.sql(f"DROP TABLE {full}")
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    by = f"PARTITIONED BY ({', '.join(_quoted(p) for p in parts)})" if parts else ""
    spark.sql(f"CREATE TABLE {full} ({columns}) USING parquet {by} LOCATION {_text(path)} TBLPROPERTIES ({_text(_ASKED)} = {_text(asked)})")
    return True


def register_external(
    spark: SparkSession, database: str, name: str, path: str, schema: T.StructType, parts: Sequence[str] = ()
) -> str:
    """An external Parquet table over a hive-style folder, with its partitions discovered."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(database)}")
    full = f"{_quoted(database)}.{_quoted(name)}"
    spark.sql(f"DROP TABLE IF EXISTS {full}")
    _create(spark, full, schema, path, parts)
    if parts:
        spark.sql(f"MSCK REPAIR TABLE {full}")
    return full


def _partition(folder: str) -> str:
    """The partition clause of a hive-style folder."""
    pairs = [step.split("=", 1) for step in folder.split("/")]
    value = lambda v: "NULL" if v == _NULL_FOLDER else _text(unquote(v))
    return "PARTITION (" + ", ".join(f"{_quoted(unquote(n))} = {value(v)}" for n, v in pairs) + ")"


def _sync(spark: SparkSession, full: str, root: str, folders: set[str]) -> None:
    """Make the table's partitions the given folders: new ones are added, others dropped, the rest is not touched."""
    held = {r.partition for r in spark.sql(f"SHOW PARTITIONS {full}").collect()}
    add, drop = sorted(folders - held), sorted(held - folders)
    for at in range(0, len(add), _AT_ONCE):
        listed = " ".join(f"{_partition(f)} LOCATION {_text(f'{root}/{f}')}" for f in add[at : at + _AT_ONCE])
        spark.sql(f"ALTER TABLE {full} ADD IF NOT EXISTS {listed}")
    for at in range(0, len(drop), _AT_ONCE):
        spark.sql(f"ALTER TABLE {full} DROP IF EXISTS {', '.join(_partition(f) for f in drop[at : at + _AT_ONCE])}")


def register_table(table: VersionedTable, database: str, name: str) -> list[str]:
    """Make a versioned table queryable by name; call again after commits to follow them.

    The folders of live files become partitions of external tables: those that are live as a
    whole are read as they are, and only in folders that are partly live are files told apart.
    A merge-on-read table gets two views: ``<name>_ro`` over the base files and ``<name>_rt``
    with the change log merged in.
    """
    spark, key = table.spark, table.key
    version = table.version()
    schema = version.schema
    if schema is None:
        raise ValueError(f"{table.root}: no such table")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(database)}")
    stored = [f for f in schema.fields if f.name not in key.parts]
    # Folders nest by the order of the key's parts.
    layout = [COMMIT_COLUMN, *key.parts]
    held = T.StructType([*stored, T.StructField(COMMIT_COLUMN, T.StringType()), *(schema[p] for p in key.parts)])
    columns = ", ".join(_quoted(n) for n in schema.names)
    taken = f"{', '.join('f.' + _quoted(n) for n in schema.names)}, f.{COMMIT_COLUMN} AS __commit"
    below = f"element_at(split(url_decode(replace(f._metadata.file_path, '+', '%2B')), '/data/{COMMIT_COLUMN}='), -1)"

    def folders_of(kind: str, whole: bool) -> str | None:
        files = [f for f in version.of(kind) if f.whole_folder == whole]
        full = f"{_quoted(database)}.{_quoted(f'{name}_{kind}' + ('' if whole else '_partly'))}"
        if not files and not spark.catalog.tableExists(full):
            return None
        _create(spark, full, held, table.data_root, layout)
        _sync(spark, full, table.data_root, {f.folder for f in files})
        return full if files else None

    def live(kind: str) -> str:
        selects = []
        whole, partly = folders_of(kind, True), folders_of(kind, False)
        if whole:
            selects.append(f"SELECT {taken} FROM {whole} f")
        if partly:
            listed = f"{_quoted(database)}.{_quoted(f'{name}_{kind}_live')}"
            path = f"{table.root}/_live/{kind}-{version.seq:010d}"
            rows = [(f.path[len(COMMIT_COLUMN) + 1 :],) for f in version.of(kind) if not f.whole_folder]
            one = T.StructType([T.StructField("path", T.StringType())])
            if not table._storage.exists(f"{path}/_SUCCESS"):
                spark.createDataFrame(rows, one).coalesce(1).write.mode("overwrite").parquet(path)
            _create(spark, listed, one, path)
            selects.append(f"SELECT {taken} FROM {partly} f LEFT SEMI JOIN {listed} l ON {below} = l.path")
        if not selects:
            nothing = [f"CAST(NULL AS {f.dataType.simpleString()}) AS {_quoted(f.name)}" for f in schema.fields]
            selects.append(f"SELECT {', '.join(nothing)}, CAST(NULL AS STRING) AS __commit WHERE false")
        return " UNION ALL ".join(selects)

    def view(suffix: str, query: str) -> str:
        full = f"{_quoted(database)}.{_quoted(name + suffix)}"
        spark.sql(f"CREATE OR REPLACE VIEW {full} AS {query}")
        return full

    base_only = f"SELECT {columns} FROM ({live('base')})"
    if table.spec.table_type != MERGE_ON_READ:
        return [view("", base_only)]
    return [view("_ro", base_only), view("_rt", _merged(live, columns, key))]


def _merged(live, columns: str, key) -> str:
    """The log merge as SQL, by the same rules as the DataFrame form."""
    as_order = []
    for name in key.ordering if key.event_time else ():
        if key.ordering_as_timestamp:
            as_order.append(f"try_to_timestamp(cast({{0}}{_quoted(name)} AS STRING))")
        as_order.append("{0}" + _quoted(name))
    newest_first = ", ".join([c.format("") + " DESC NULLS LAST" for c in as_order] + ["__commit DESC"])
    scope = ", ".join(_quoted(n) for n in key.scope)

    def same(left: str, right: str) -> str:
        return " AND ".join(
            f"{left}.{_quoted(n)} {'=' if n in key.keys else '<=>'} {right}.{_quoted(n)}" for n in key.scope
        )

    later = "false"
    if as_order:
        tuple_of = lambda side: "struct(" + ", ".join(c.format(side + ".") for c in as_order) + ")"
        later = f"{tuple_of('b')} > {tuple_of('c')}"
    return f"""
        WITH base AS ({live('base')}),
        changes AS (
            SELECT * FROM (
                SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY {newest_first}) AS __rank
                FROM ({live('log')})
            ) WHERE __rank = 1
        ),
        beaten AS (
            SELECT DISTINCT {', '.join('b.' + _quoted(n) for n in key.scope)}
            FROM base b JOIN changes c ON {same('b', 'c')} AND {later}
        ),
        stored AS (SELECT c.* FROM changes c LEFT ANTI JOIN beaten x ON {same('c', 'x')})
        SELECT {columns} FROM base b LEFT ANTI JOIN stored s ON {same('b', 's')}
        UNION ALL SELECT {columns} FROM stored"""
