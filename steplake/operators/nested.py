"""Documents: nested objects become dotted columns, arrays become JSON text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from steplake.operators.steps import quoted, require_columns


def _leaves(schema: T.StructType, column, prefix: str, sep: str) -> Iterator[tuple[str, Column, T.DataType]]:
    for field in schema:
        name = f"{prefix}{sep}{field.name}" if prefix else field.name
        value = column(field.name)
        if isinstance(field.dataType, T.StructType):
            yield from _leaves(field.dataType, value.getField, name, sep)
        else:
            yield name, value, field.dataType


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested objects of any depth as ``a.b.c`` columns; arrays and maps as JSON text, one row per row."""
    return df.select(*[
        (F.to_json(value) if isinstance(kind, (T.ArrayType, T.MapType)) else value).alias(name)
        for name, value, kind in _leaves(df.schema, quoted, "", sep)])


def order_document_columns(df: DataFrame, id_column: str = "_id") -> DataFrame:
    """The id first, as text, the other columns by name."""
    rest = sorted(c for c in df.columns if c != id_column)
    first = [quoted(id_column).cast("string").alias(id_column)] if id_column in df.columns else []
    return df.select(*first, *map(quoted, rest))


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                   id_column: str = "_id") -> DataFrame:
    """A folder of JSON documents, one per line, as one flat table."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return order_document_columns(flatten(reader.json(path)), id_column)


def infer_value_schema(df: DataFrame, column: str = "value") -> T.StructType:
    """The schema of JSON text, merged from all rows by the executors."""
    require_columns(df, [column])
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(quoted(column)))).first()[0]
    if not found or not found.startswith("OBJECT<"):
        raise ValueError(f"column {column!r} does not hold JSON objects")
    return _TypeText(found).read()


class _TypeText:
    """Reads the text of a variant's type; field names are taken as they are.

    Decimals are how variants keep fractions, a document's fraction is a double; a
    value that is always null, or of several kinds, is text.
    """

    LEAVES = {"BOOLEAN": T.BooleanType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType(),
              "STRING": T.StringType(), "VOID": T.StringType(), "VARIANT": T.StringType(), "DATE": T.DateType(),
              "TIMESTAMP": T.TimestampType(), "BINARY": T.BinaryType()}

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def _takes(self, token: str) -> bool:
        if self.text.startswith(token, self.at):
            self.at += len(token)
            return True
        return False

    def read(self) -> T.DataType:
        if self._takes("OBJECT<"):
            fields = []
            while not self._takes(">"):
                self._takes(", ")
                name = self._name()
                fields.append(T.StructField(name, self.read()))
            return T.StructType(fields)
        if self._takes("ARRAY<"):
            item = self.read()
            self._takes(">")
            return T.ArrayType(item)
        end = self.at
        while end < len(self.text) and (self.text[end].isalpha() or self.text[end] == "_"):
            end += 1
        word, self.at = self.text[self.at:end], end
        if self._takes("("):
            self.at = self.text.index(")", self.at) + 1
        if word == "DECIMAL":
            return T.DoubleType()
        return self.LEAVES.get(word, T.StringType())

    def _name(self) -> str:
        if self._takes("`"):
            name = ""
            while True:
                end = self.text.index("`", self.at)
                name, self.at = name + self.text[self.at:end], end + 1
                if not self._takes("`"):
                    break
                name += "`"
            self._takes(": ")
            return name
        end = self.text.index(": ", self.at)
        name, self.at = self.text[self.at:end], end + 2
        return name


def expand_json(df: DataFrame, column: str, schema: T.StructType | str | None = None, sep: str = ".") -> DataFrame:
    """A column of JSON text as flat columns ``column.a.b`` in its place."""
    kind = schema if schema is not None else infer_value_schema(df, column)
    return flatten(df.withColumn(column, F.from_json(quoted(column), kind)), sep)


def infer_types(df: DataFrame, column: str, order_by: str) -> DataFrame:
    """Field names and types of JSON documents, judged from all of them.

    The first value in order that is no text decides a field's type: boolean, bigint or
    double; otherwise the field is text.
    """
    head = df.select(quoted(order_by).alias("at"), quoted(column).alias("doc"))
    schema = infer_value_schema(head, "doc")
    paths = [name for name, *_ in _leaves(schema, lambda n: F.lit(None), "", "\x00")]
    doc = F.try_parse_json("doc")
    values = head.select("at", F.explode(F.array(*[
        F.struct(F.lit(p.replace("\x00", ".")).alias("name"),
                 F.schema_of_variant(F.try_variant_get(doc, _json_path(p.split("\x00")), "variant")).alias("type"))
        for p in paths])).alias("f")).select("at", "f.*")
    kind = (F.when(F.col("type") == "BOOLEAN", "BOOLEAN").when(F.col("type") == "BIGINT", "BIGINT")
            .when(F.col("type").rlike("^(DECIMAL|DOUBLE|FLOAT)"), "DOUBLE"))
    return values.withColumn("kind", kind).groupBy("name").agg(
        F.coalesce(F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("at"))), F.lit("VARCHAR"))
        .alias("data_type"))


def _json_path(parts: list[str]) -> str:
    return "$" + "".join('["' + p.replace('"', '\\"') + '"]' for p in parts)
