"""Corpus sources: JSON corpus files and the driver's ``documents`` table.

A loaded corpus is one DataFrame
``documents(doc_id, text, title, epoch, language, area, filename)``,
hash-partitioned by ``doc_id`` so that every per-document operator
downstream (n-grams, token windows, sentence folds) runs without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotext.operators.ordering import running_index
from chronotext.functions.text import clean_text, not_blank, strip_space
from chronotext.sources.split_json import read_objects

RECORD_FIELDS = ["Title", "Content", "Epoch", "Language", "Area"]
RECORD_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in RECORD_FIELDS])
CORPUS_SCHEMA = T.StructType([T.StructField("Documents", T.ArrayType(RECORD_SCHEMA))])
DOC_COLUMNS = ["doc_id", "text", "title", "epoch", "language", "area", "filename"]


def by_doc(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Hash-partition by ``doc_id`` (one shuffle of the raw text, once).

    The count is explicit (default ``spark.sql.shuffle.partitions``): the
    text is small in bytes but heavy in CPU, and AQE would otherwise
    coalesce it into very few tasks by byte size."""
    if not partitions:
        conf = df.sparkSession.conf
        partitions = max(int(conf.get("spark.sql.shuffle.partitions", "200")),
                         df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(partitions, "doc_id")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def records_from_documents(documents: DataFrame) -> DataFrame:
    """Stand-in corpus records from the driver's ``documents`` table:
    Content = text, Epoch = Language = lang, Title = Area = source."""
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").alias("Title"), F.col("text").alias("Content"),
        F.col("lang").alias("Epoch"), F.col("lang").alias("Language"),
        F.col("source").alias("Area"))


def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and fields of the ``documents`` corpus without its text.

    The text is read for the blank-content rule alone; nothing is cleaned,
    shuffled or kept."""
    records = records_from_documents(read_table(spark, sf_dir, "documents"))
    fields = [strip_space(F.coalesce(F.col(f), F.lit(""))).alias(f.lower()) for f in RECORD_FIELDS if f != "Content"]
    kept = records.where(not_blank(F.coalesce("Content", F.lit(""))))
    return kept.select("doc_id", *fields, F.replace(strip_space(F.coalesce("Title", F.lit(""))), F.lit(" "), F.lit("_")).alias("filename"))


def prepare_documents(records: DataFrame, skip_epochs: Iterable[str] = (),
                      partitions: int | None = None, clean: bool = True) -> DataFrame:
    """Loader rules: skip epochs (trimmed, case-insensitive), drop blank
    content (tested before cleaning), trim fields, ``filename`` = title with
    spaces as underscores, clean the text.  Missing fields read as ''."""
    fields = {f: F.coalesce(F.col(f), F.lit("")) for f in RECORD_FIELDS}
    df = records.select("doc_id", *[fields[f].alias(f) for f in RECORD_FIELDS])
    skip = sorted({s.strip().lower() for s in skip_epochs})
    if skip:
        df = df.where(~F.lower(strip_space("Epoch")).isin(skip))
    # shuffle first, then the regex work: a small file is read as one task,
    # and cleaning in the scan's partitions would run it on one core
    df = by_doc(df, partitions)
    df = df.where(not_blank("Content"))
    title = strip_space("Title")
    text = clean_text("Content") if clean else F.col("Content")
    out = df.select(
        "doc_id", text.alias("text"), title.alias("title"),
        strip_space("Epoch").alias("epoch"), strip_space("Language").alias("language"),
        strip_space("Area").alias("area"), F.replace(title, F.lit(" "), F.lit("_")).alias("filename"))
    return out


def load_documents(spark: SparkSession, sf_dir: str, skip_epochs: Iterable[str] = (),
                   partitions: int | None = None) -> DataFrame:
    """The driver's ``documents`` table as a cleaned, doc-partitioned corpus."""
    return prepare_documents(records_from_documents(read_table(spark, sf_dir, "documents")),
                             skip_epochs, partitions)


def load_corpus_json(spark: SparkSession, path: str, skip_epochs: Iterable[str] = (),
                     multiline: bool = True, partitions: int | None = None,
                     number_lines: bool = False, split: bool = True) -> DataFrame:
    """Read a JSON corpus.

    ``multiline=True``: every file is one object ``{"Documents": [{Title,
    Content, Epoch, Language, Area}, ...]}`` (the reference layout).  A file is
    read by byte ranges in many tasks (``split_json``); with ``split=False`` in
    one task, which also takes objects with other keys or nested fields.
    ``multiline=False``: JSON lines; a line is either one record or one
    ``{"Documents": [...]}`` chunk (the scalable layouts).
    Records may carry a ``doc_id``; otherwise it is the position inside its
    file plus a per-file offset.  In JSON lines a position is only known by
    counting the lines before it: ``number_lines=True`` sorts the records by
    file and place to do so, without it a record that lacks its id is an error.
    """
    rec = T.StructType([T.StructField("doc_id", T.LongType())] + list(RECORD_SCHEMA.fields))
    schema = T.StructType([T.StructField("Documents", T.ArrayType(rec))] + list(rec.fields))
    if multiline and split:
        raw = read_objects(spark, path, rec).select(F.col("file").alias("_file"), F.col("position").alias("_pos"), "d")
        return prepare_documents(_by_file(raw), skip_epochs, partitions)
    raw = spark.read.schema(schema).option("multiLine", multiline).json(path)
    raw = raw.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_line"),
                     F.coalesce(F.col("Documents"),
                                F.array(F.struct(*[F.col(f.name) for f in rec.fields])))
                     .alias("Documents"))
    raw = raw.where(F.size("Documents") > 0).select("_file", "_block", "_line", F.posexplode("Documents").alias("_pos", "d"))
    if not multiline:
        own = F.col("d.doc_id")
        if number_lines:
            # one order over all files: ids 0, 1, 2, ... by file name, then by place in the file
            raw = running_index(raw.withColumn("_all", F.lit(0)), ["_all"], ["_file", "_block", "_line", "_pos"], "_id")
            own = F.coalesce(own, F.col("_id"))
        else:
            own = F.coalesce(own, F.raise_error(F.lit("a JSON line has no doc_id; number_lines=True makes ids")).cast("long"))
        return prepare_documents(raw.select(own.alias("doc_id"), *[F.col(f"d.{f}").alias(f) for f in RECORD_FIELDS]),
                                 skip_epochs, partitions)
    return prepare_documents(_by_file(raw), skip_epochs, partitions)


def _by_file(raw: DataFrame) -> DataFrame:
    """Records ``(_file, _pos, d)`` with their id: their own, or the place in the file and the file's number."""
    # one row per input file: a bounded table, numbered in file-name order
    file_rank = (raw.select("_file").distinct()
                 .withColumn("_file_no", F.row_number().over(Window.orderBy("_file")) - 1))
    raw = raw.join(F.broadcast(file_rank), "_file")
    position_id = (F.col("_file_no").cast("long") * F.lit(1 << 32)) + F.col("_pos")
    return raw.select(F.coalesce(F.col("d.doc_id"), position_id).alias("doc_id"),
                      *[F.col(f"d.{f}").alias(f) for f in RECORD_FIELDS])


def write_corpus_json(records: DataFrame, path: str, lines: bool = True,
                      chunk: int = 1000) -> None:
    """Write corpus records (``doc_id`` + the five fields) as JSON lines.

    ``lines=False`` writes the reference object layout, one
    ``{"Documents": [...]}`` object per line for every ``chunk`` documents
    (bounded groups; never the whole corpus in one row).
    """
    cols = ["doc_id", *RECORD_FIELDS]
    if lines:
        records.select(*cols).write.mode("overwrite").json(path)
        return
    chunks = (records.select(F.floor(F.col("doc_id") / chunk).alias("_chunk"), F.struct(*cols).alias("d"))
              .groupBy("_chunk").agg(F.sort_array(F.collect_list("d")).alias("Documents")))
    chunks.select("Documents").write.mode("overwrite").json(path)
