"""What the operators share: reading tables, and cutting lineage through the shared folder."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.sources.scratch import Scratch, shared_dir

__all__ = ["Scratch", "map_texts", "replaced", "shared_dir", "slices", "table", "text_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text"):
    """A null text counts as the empty one."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, rows: int, max_bytes: int = 8 << 20):
    """Parts of a batch of at most ``rows`` rows and about ``max_bytes`` (a single row may be longer)."""
    at = 0
    while at < batch.num_rows:
        part = batch.slice(at, rows)
        while part.num_rows > 1 and part.get_total_buffer_size() and part.nbytes > max_bytes:
            part = part.slice(0, part.num_rows // 2)
        yield part
        at += part.num_rows


def map_texts(df: DataFrame, rows, schema: str, batch_rows: int = 512) -> DataFrame:
    """Applies ``rows(texts) -> columns`` to the last column of ``df``, the text, in bounded batches; the columns before it pass through unchanged and come first in ``schema``."""
    n = len(df.columns) - 1
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch_rows):
                new = rows(part.column(n).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(k).cast(target.field(k).type) for k in range(n)] + [pa.array(c, target.field(n + k).type) for k, c in enumerate(new)], schema=target)

    return df.mapInArrow(run, schema)


def replaced(docs: DataFrame, text) -> list:
    """The columns of ``docs`` out of the struct ``_row``, with ``text`` in place of the text, and its length in n_chars, if there is such a column."""
    out = []
    for f in docs.schema.fields:
        if f.name == "text":
            out.append(text.alias("text"))
        elif f.name == "n_chars":
            out.append(F.length(text).cast(f.dataType).alias("n_chars"))
        else:
            out.append(F.col("_row")[f.name].alias(f.name))
    return out
