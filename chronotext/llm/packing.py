"""Packing of token pieces into fixed-length sequences by first-fit decreasing.

Pieces are dealt at random into groups of bounded size; each group is packed by
itself, with the bin capacities in a tournament tree that finds the first bin
with room in logarithmic time.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_path, load_bpe
from .common import row_ids, ship_package, stored, text_slices, tidied, to_batches

CAPACITY = 2048
END_ID = 1
GROUP_PIECES = 4096


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece; larger pieces first, each into the first bin with room."""
    n = len(sizes)
    leaves = 1
    while leaves < n:
        leaves *= 2
    room = [capacity] * (2 * leaves)  # room[1] is the root, room[leaves + b] bin b; every node holds its best child
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, at = int(sizes[i]), 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - room[at]
        room[at] -= size
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
    return bins, offsets


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 end_id: int = END_ID, path: str | None = None, seed: int = 0) -> DataFrame:
    """Each document's ids with ``end_id`` appended, cut at multiples of ``capacity``; one row per piece.

    A null or empty text is one piece; repeated rows, null ids and other columns
    change nothing; an empty table gives no piece.
    """
    ship_package(df.sparkSession)
    path = path or default_path()
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("draw", pa.int64())])

    def run(batches):
        bpe, numbers = load_bpe(path), row_ids()

        def rows():
            for b in batches:
                keys = b.column("doc_id").to_pylist()
                for lo, hi, texts in text_slices(b, "text"):
                    for key, ids in zip(keys[lo:hi], bpe.encode_batch(texts), strict=True):
                        ids = np.append(ids, end_id).astype("<u4")
                        for start in range(0, len(ids), capacity):
                            piece = ids[start:start + capacity]
                            draw = xxhash.xxh64_intdigest(next(numbers).to_bytes(8, "little"), seed=seed) >> 1
                            yield key, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), draw
        with tidied():
            yield from to_batches(rows(), schema)

    return src.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, draw long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces (``length`` <= ``capacity``, random ``draw``).

    The number of groups follows the number of pieces, so a group holds about
    ``group_pieces`` of them whatever the table; a document's pieces are dealt
    one by one, so neither long documents nor repeated ids fill a group.
    """
    spark = pieces.sparkSession
    ship_package(spark)
    groups = max(1, -(-pieces.count() // group_pieces))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "doc_id", "start"], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets).drop(columns=["draw", "grp"])

    return (pieces.withColumn("grp", F.col("draw") % F.lit(groups)).groupBy("grp")
            .applyInPandas(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                 "sequence_id long, offset long"))


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   end_id: int = END_ID, path: str | None = None, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack every document of ``df`` into sequences of at most ``capacity`` tokens.

    One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``. A null or empty text is one piece that holds
    ``end_id`` alone; repeated rows and null ids are packed like any other;
    other columns are not read; an empty table gives an empty table. The pieces
    (numbers only) are written to the shared folder, so that a lost task finds
    the same deal.
    """
    pieces = stored(df.sparkSession, token_pieces(df, id_col, text_col, capacity, end_id, path), "pieces")
    return pack(pieces, capacity, group_pieces)
