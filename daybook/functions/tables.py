"""Table functions for SQL: ``register`` makes them known to a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from daybook.functions.text import other_names
from daybook.operators.lint import Reader


@udtf
class HouseStyle:
    """``SELECT * FROM house_style(TABLE(t), 'doc_id', 'n', 'line')``: findings of documents that are tables of lines, under the names of the table's own columns for document, place and line.

    The function asks for its table by document, in order of place; Spark deals and sorts it so. Of a document only the state of its front matter and fences is held."""

    @staticmethod
    def analyze(table: AnalyzeArgument, document: AnalyzeArgument, place: AnalyzeArgument, line: AnalyzeArgument) -> AnalyzeResult:
        names = [a.value for a in (document, place, line)]
        fields = {f.name: f for f in table.dataType.fields}
        if missing := [n for n in names if n not in fields]:
            raise ValueError(f"the table has no column {', '.join(map(str, missing))}")
        out = [StructField(names[0], fields[names[0]].dataType), StructField(names[1], fields[names[1]].dataType), StructField("col", IntegerType()), StructField("rule", StringType()), StructField("found", StringType())]
        return AnalyzeResult(StructType(out), partitionBy=[PartitioningColumn(names[0])], orderBy=[OrderingColumn(names[1])])

    def __init__(self):
        self.reader = Reader()

    def eval(self, row: Row, document: str, place: str, line: str) -> Iterator[tuple]:
        for column, rule, found in self.reader.read(row[line] or ""):
            yield row[document], row[place], column, rule, found


@udtf(returnType="place int, name string")
class OtherNames:
    """``SELECT * FROM t, LATERAL other_names(t.raw)``: the names that one string gives for an organisation, in order."""

    def eval(self, name: str | None) -> Iterator[tuple]:
        yield from enumerate(other_names(name), 1)


def register(spark: SparkSession) -> None:
    spark.udtf.register("house_style", HouseStyle)
    spark.udtf.register("other_names", OtherNames)
