"""One large JSON object read by many tasks.

The corpus layout is one object ``{"Documents": [{...}, {...}, ...]}`` a file,
which a JSON reader takes as one record and so in one task.  Here a file is read
as text cut at every closing brace, which Spark does by byte ranges.  A brace
ends a record unless it stands in a string, and whether it does follows from the
number of quotes before it: each byte range counts its quotes and its records
for both cases, prefix sums over the ranges of a file tell which case holds and
how many records came before, and pieces of one record are put together by its
number.  No text is sorted, and a record may span any number of ranges.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotext.session import ship_package, stored

_ESCAPE = re.compile(r"\\.", re.DOTALL)
_PIECE = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("odd", pa.int32()),
                    ("even_before", pa.int64()), ("odd_before", pa.int64()), ("piece", pa.string())])
_DDL = "file string, block long, seq long, odd int, even_before long, odd_before long, piece string"


def _count(batches):
    """Pieces with what is known inside their byte range.

    ``odd``: parity of the quotes of the range up to the piece's end.
    ``even_before``, ``odd_before``: records ended before the piece, if the
    range begins outside a string or inside one."""
    place, seq, odd, ended = None, 0, 0, [0, 0]
    for b in batches:
        out = []
        for file, block, piece in zip(*(b.column(c).to_pylist() for c in ("file", "block", "piece")), strict=True):
            if (file, block) != place:
                place, seq, odd, ended = (file, block), 0, 0, [0, 0]
            # an escape never reaches over a piece's end: no escape has a closing brace
            odd = (odd + (_ESCAPE.sub("", piece) if "\\" in piece else piece).count('"')) % 2
            out.append((file, block, seq, odd, *ended, piece))
            ended[odd] += 1
            seq += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), _PIECE, strict=True)], schema=_PIECE)


def read_objects(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """``(file, position, d)``: the records of the files' ``Documents`` arrays with their place in the file.

    Records are flat objects; a file holds one object, whose one key is
    ``Documents``.  Anything else is an error.  Empty arrays give no rows."""
    ship_package(spark)
    text = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("piece"))
    pieces = stored(text.mapInArrow(_count, _DDL), "json-pieces")
    # one row a byte range
    last = F.struct("odd", (F.col("even_before") + (F.col("odd") == 0).cast("long")).alias("even"),
                    (F.col("odd_before") + F.col("odd")).alias("odd_n"))
    ranges = pieces.groupBy("file", "block").agg(F.max_by(last, "seq").alias("l")).select("file", "block", "l.*")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    ranges = ranges.withColumn("first", F.coalesce(F.sum(F.when(F.col("inside") == 1, F.col("odd_n")).otherwise(F.col("even"))).over(before), F.lit(0)))
    ranges = stored(ranges.select("file", "block", "inside", "first"), "json-ranges")
    placed = pieces.join(ranges, ["file", "block"]).select(
        "file", (F.col("first") + F.when(F.col("inside") == 1, F.col("odd_before")).otherwise(F.col("even_before"))).alias("position"),
        F.struct("block", "seq", "piece").alias("p"))
    whole = placed.groupBy("file", "position").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["piece"]), "}").alias("body"))
    body = F.when(F.col("position") == 0, F.regexp_replace("body", r'^\x{FEFF}?\s*\{\s*"Documents"\s*:\s*\[', "")).otherwise(
        F.regexp_replace("body", r"^\s*,", ""))
    end = F.col("body").rlike(r"^\s*\]?\s*$")
    whole = whole.withColumn("body", body).where(~end)
    full = T.StructType([*record.fields, T.StructField("_bad", T.StringType())])
    read = F.from_json(F.concat("body", F.lit("}")), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = F.concat(F.lit("not a record of a Documents array: "), F.substring("body", 1, 80))
    # a filter that is merged with the one above may be tried on an array's end first: that is no error
    return whole.select("file", "position", F.when(F.col("body").rlike(r"^\s*\{"), read).alias("d"), "body").select(
        "file", "position", F.when((F.col("d").isNotNull() & F.col("d._bad").isNull()) | end, F.col("d")).otherwise(F.raise_error(bad)).alias("d"))
