"""Plain Python over the ordered rows of each group, for scans that no expression covers.

Rows are dealt by key, sorted by Spark (which spills), and streamed through Arrow batches; a group costs no call of its own into Spark, so
millions of small groups are as good as a few large ones. What is held is one group and one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def per_group(df: DataFrame, keys: list[str], order: list[str], run: Callable[[list[tuple]], list[tuple]], schema: StructType | str, *, emit: int = 5000) -> DataFrame:
    """``run`` takes the rows of one group, tuples in the order of ``df``'s columns, and gives rows of ``schema``."""
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    names, places = df.columns, [df.columns.index(k) for k in keys]
    fields = [(f.name, to_arrow_type(f.dataType)) for f in kind.fields]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                now = tuple(row[p] for p in places)
                if now != key and rows:
                    out += run(rows)
                    rows = []
                    if len(out) >= emit:
                        yield made()
                        out = []
                key = now
                rows.append(row)
        if rows:
            out += run(rows)
        if out:
            yield made()

    # a given number of tasks: what Python does with a row costs far more than its bytes tell. Dealt by a hash of the key, because Spark would
    # take an earlier shuffle by the key itself instead, merged into few partitions by the size of its rows
    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(stream, kind)
