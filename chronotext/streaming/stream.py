"""Structured Streaming adapters.

Cleaning, tokenisation, segmentation and frozen-vocabulary transforms are
per-document and stateless, so they run on a stream unchanged.  Documents
arriving as files are featurised micro-batch by micro-batch with
``foreachBatch``: every batch is an ordinary DataFrame, so the per-document
aggregation (term counts, L1) is the batch operator itself.  Each epoch is
written to its own folder with ``overwrite``, so a batch replayed after a
failure replaces its own output instead of duplicating it (the checkpoint
under ``spark.checkpoint.dir`` records committed epochs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotext.sources import corpus

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


def document_stream(spark: SparkSession, folder: str, glob: str | None = None,
                    max_files: int | None = None) -> DataFrame:
    """A file stream of ``documents``-shaped parquet files in ``folder``
    (optionally only file names matching ``glob``); ``folder`` may also be
    a pattern, which one file can match."""
    r = spark.readStream.schema(DOCUMENT_SCHEMA)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder)


def featurize_stream(stream: DataFrame, model, sink: str, checkpoint: str, available_now: bool = True):
    """Apply a fitted feature model (e.g. ``CharNGrams`` with a frozen
    vocabulary) to every micro-batch; rows go to ``sink/epoch=<id>``."""

    def per_batch(batch: DataFrame, epoch: int) -> None:
        docs = corpus.prepare_documents(corpus.records_from_documents(batch))
        out = model.weights(docs).select("doc_id", "term", F.col("c").cast("long").alias("c"), "value")
        out.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
