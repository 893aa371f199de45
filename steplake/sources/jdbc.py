"""Relational databases through Spark's JDBC source. The database's driver jar has to be installed."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

FETCH_ROWS = 1000

# Schemas a catalog listing hides, per kind of database.
SYSTEM_SCHEMAS = {
    "postgresql": ("pg_catalog", "information_schema", "pg_toast"),
    "mysql": ("information_schema", "performance_schema", "mysql", "sys"),
    "clickhouse": ("system", "INFORMATION_SCHEMA", "information_schema"),
    "sqlite": (),
}
# SQLite type names and the Spark type each is read as; others are text.
SQLITE_TYPES = {
    "INTEGER": "int", "INT": "int", "TINYINT": "int", "SMALLINT": "int", "BIGINT": "bigint",
    "REAL": "double", "FLOAT": "double", "NUMERIC": "double", "DECIMAL": "double",
    "TEXT": "string", "CHAR": "string", "VARCHAR": "string", "BLOB": "binary",
    "BOOLEAN": "boolean", "DATE": "date", "DATETIME": "timestamp_ntz", "TIMESTAMP": "timestamp_ntz",
}


def dialect(url: str) -> str:
    """Kind of database named in a JDBC address."""
    parts = url.split(":")
    if len(parts) < 3 or parts[0] != "jdbc":
        raise ValueError(f"not a JDBC address: {url!r}")
    return {"ch": "clickhouse", "mariadb": "mysql"}.get(parts[1], parts[1])


def read_options(url: str, table: str | None = None, query: str | None = None, partition_column: str | None = None,
                 lower_bound: Any = None, upper_bound: Any = None, num_partitions: int | None = None,
                 fetch_rows: int = FETCH_ROWS, **connection: str) -> dict[str, str]:
    """Reader options for a whole table or a query the database runs."""
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    options = {"url": url, "fetchsize": str(fetch_rows), **connection}
    split = (partition_column, lower_bound, upper_bound, num_partitions)
    if any(v is not None for v in split):
        if any(v is None for v in split):
            raise ValueError("a split read needs partition_column, lower_bound, upper_bound and num_partitions")
        options |= {"partitionColumn": partition_column, "lowerBound": str(lower_bound),
                    "upperBound": str(upper_bound), "numPartitions": str(num_partitions)}
        # Spark splits tables only, and a query in brackets is a table
        options["dbtable"] = table or f"({query}) AS part"
    elif table:
        options["dbtable"] = table
    else:
        options["query"] = query
    return options


def read_jdbc(spark: SparkSession, url: str, **options: Any) -> DataFrame:
    """A table or query as a DataFrame; give a partition column for anything large.

    Without one a single task reads everything. Filters and columns used later
    are sent to the database.
    """
    return spark.read.format("jdbc").options(**read_options(url, **options)).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", read_only: bool = False,
               staging_table: str | None = None, batch_rows: int = FETCH_ROWS, **connection: str) -> None:
    """Append, or empty the table and insert.

    Spark commits one partition at a time. With a staging table the rows go there
    first and one transaction in the database moves them over, so that readers
    see all of them or none and a repeated task leaves no duplicates behind.
    """
    if read_only:
        raise PermissionError("the connection is read-only")
    if mode not in ("append", "overwrite"):
        raise ValueError("mode must be 'append' or 'overwrite'")
    options = {"url": url, "batchsize": str(batch_rows), **connection}
    writer = df.write.format("jdbc").options(**options)
    if staging_table is None:
        if mode == "overwrite":
            writer = writer.option("truncate", "true")
        writer.mode(mode).option("dbtable", table).save()
        return
    writer.mode("overwrite").option("dbtable", staging_table).save()
    jvm = df.sparkSession.sparkContext._jvm
    properties = jvm.java.util.Properties()
    for key, value in connection.items():
        properties.setProperty(key, value)
    run_transaction(jvm.java.sql.DriverManager.getConnection(url, properties),
                    move_statements(table, staging_table, df.columns, mode))


def move_statements(table: str, staging_table: str, columns: list[str], mode: str) -> list[str]:
    """The statements that publish a staging table, by column name.

    DELETE, not TRUNCATE: some databases cannot undo a TRUNCATE.
    """
    names = ", ".join(columns)
    insert = f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging_table}"
    return ([f"DELETE FROM {table}"] if mode == "overwrite" else []) + [insert]


def run_transaction(connection: Any, statements: list[str]) -> None:
    """Run statements in one transaction, undone on any error."""
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for text in statements:
            statement.executeUpdate(text)
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def catalog_query(kind: str) -> str:
    """SQL that lists schema, name and node_type of all tables and views but the system's."""
    if kind == "sqlite":
        return ("SELECT 'main' AS table_schema, name AS table_name, type AS node_type FROM sqlite_master"
                " WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%'")
    hidden = ", ".join(f"'{s}'" for s in SYSTEM_SCHEMAS.get(kind, ("information_schema",)))
    if kind == "clickhouse":
        return ("SELECT database AS table_schema, name AS table_name,"
                " if(engine LIKE '%View', 'view', 'table') AS node_type"
                f" FROM system.tables WHERE database NOT IN ({hidden})")
    return ("SELECT table_schema, table_name,"
            " CASE table_type WHEN 'BASE TABLE' THEN 'table' ELSE 'view' END AS node_type"
            f" FROM information_schema.tables WHERE table_schema NOT IN ({hidden})")


def jdbc_catalog(spark: SparkSession, url: str, **connection: str) -> DataFrame:
    """Tables and views of a database."""
    return read_jdbc(spark, url, query=catalog_query(dialect(url)), **connection).orderBy("table_schema", "table_name")


def columns_query(kind: str, schema: str, table: str) -> str:
    """SQL that lists the columns of a table in order."""
    def text(value):
        return "'" + value.replace("'", "''") + "'"
    if kind == "sqlite":
        return (f"SELECT cid + 1 AS position, name, type AS data_type, \"notnull\" = 0 AS nullable"
                f" FROM pragma_table_info({text(table)})")
    if kind == "clickhouse":
        return ("SELECT position, name, type AS data_type, startsWith(type, 'Nullable') AS nullable"
                f" FROM system.columns WHERE database = {text(schema)} AND table = {text(table)}")
    return ("SELECT ordinal_position AS position, column_name AS name, data_type,"
            " CASE is_nullable WHEN 'YES' THEN 1 ELSE 0 END AS nullable FROM information_schema.columns"
            f" WHERE table_schema = {text(schema)} AND table_name = {text(table)}")


def jdbc_table_schema(spark: SparkSession, url: str, schema: str, table: str, **connection: str) -> DataFrame:
    """Name, type and nullability of a table's columns, in order."""
    return read_jdbc(spark, url, query=columns_query(dialect(url), schema, table), **connection).orderBy("position")


def sqlite_type(declared: str) -> str:
    """Spark type for a type name declared in SQLite."""
    return SQLITE_TYPES.get(declared.upper().split("(")[0].strip(), "string")
