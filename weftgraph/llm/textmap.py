"""Arrow batches of texts to rows of numbers: the frame that text scanners share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weftgraph.llm.common import bound_batches, without
from weftgraph.llm.memory import forget


def add_columns(docs: DataFrame, text: str, scan: Callable[[], Callable[[bytes], tuple]], added: str) -> DataFrame:
    """`docs` with the columns of the DDL string `added`, made by `scan()` from each whole text as UTF-8.

    `scan` is called once a task and returns the function for a text. Null texts come as b"".
    Added columns replace those of the same name.
    """
    bound_batches(docs.sparkSession)
    more = StructType.fromDDL(added)
    keep = without(docs, [*more.names, "_utf8"])
    source = docs.select(*keep, F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("_utf8"))
    schema = StructType(source.schema.fields[:-1] + more.fields)
    made = to_arrow_schema(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        one = scan()
        for batch in batches:
            rows = [one(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            columns = [pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), made, strict=True)] if rows else [pa.array([], type=f.type) for f in made]
            names = [*batch.schema.names[:-1], *made.names]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=names)

    return source.mapInArrow(run, schema)
