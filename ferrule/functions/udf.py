"""User-code hooks (UDF1-UDF3).

* UDF1 ``tokenizer_udf``: any ``text -> list[int]`` tokenizer, loaded once per
  Python worker (iterator pandas UDF) and fed Arrow batches.
* UDF2 ``generate_candidates``: run a user scorer/generator over all sources
  with ``mapInPandas``; output is keyed, so order never matters. The Arrow
  batch size (``spark.sql.execution.arrow.maxRecordsPerBatch``) replaces the
  reference's manual batch size.
* UDF3 ``map_batches``: a batched row mapper for user code.

Built-in column expressions are preferred everywhere else; these hooks exist
only for code that cannot be expressed in Spark SQL (a model, a sub-word
tokenizer).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions.udf_support import few_bytes, ship_by_value

ship_by_value(__name__)

ARROW = {T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.FloatType: pa.float32(),
         T.BooleanType: pa.bool_(), T.BinaryType: pa.binary()}
PLAIN = tuple(ARROW)


def tokenizer_udf(factory: Callable[[], Callable[[str], list[int]]]) -> Callable[[Column], Column]:
    """UDF1: wrap a tokenizer factory; the tokenizer is built once per worker process."""
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = factory()
        for s in batches:
            yield s.map(lambda t: None if t is None else list(tok(t)))

    udf = F.pandas_udf(encode, T.ArrayType(T.IntegerType()))
    return lambda col: udf(F.col(col) if isinstance(col, str) else col)


def generate_candidates(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], key: str, text: str,
                        out_col: str = "candidate") -> DataFrame:
    """UDF2: ``fn(batch[key, text]) -> batch[key, out_col]`` applied with ``mapInPandas``."""
    schema = T.StructType([df.schema[key], T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = fn(b[[key, text]])
            yield out[[key, out_col]]

    return df.select(key, text).mapInPandas(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """UDF3: batched row mapper (user code on pandas batches).

    Rows of plain types come as runs of ``FEW_BYTES`` of an Arrow batch, so that a worker never holds a whole batch of long
    texts as Python strings; times and nested values take Spark's own conversion of whole batches.
    """
    target = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not all(isinstance(f.dataType, PLAIN) for f in [*df.schema.fields, *target.fields]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield fn(b)
        return df.mapInPandas(run, schema)
    names = [f.name for f in target.fields]
    out_types = pa.schema([(f.name, ARROW[type(f.dataType)]) for f in target.fields])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_bytes(batches):
            out = fn(part.to_pandas())
            if all(isinstance(c, str) for c in out.columns):
                out = out[names]
            yield pa.RecordBatch.from_arrays([pa.array(out.iloc[:, i], type=t, from_pandas=True) for i, t in enumerate(out_types.types)], schema=out_types)
    return df.mapInArrow(slices, target)


def corrupt_words(batch: pd.DataFrame, key: str = "pair_id", text: str = "source", every: int = 3,
                  out_col: str = "candidate") -> pd.DataFrame:
    """Deterministic stand-in for a model (tests): restore every ``every``-th reversed word.

    Word i of the source is reversed back when (i + key) % every == 0, so the
    result is a partial correction of a F1 source.
    """
    def fix(k, s):
        words = s.split()
        return " ".join(w[::-1] if (i + k) % every == 0 else w for i, w in enumerate(words))

    return pd.DataFrame({key: batch[key], out_col: [fix(k, s) for k, s in zip(batch[key], batch[text])]})
