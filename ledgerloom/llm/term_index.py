"""Frequency of every distinct term, from a vertical layout of compressed bitmaps.

Each term has bitmaps of the numbers of the records that hold it, cut into chunks of
2**16 records, and parallel counters of its occurrences. A chunk's bitmap is a sorted
list of 16-bit numbers while that is shorter, else 8 KB of bits. Tasks build the
bitmaps of their records, equal chunks merge by union, and a term's document frequency
is the cardinality of its bitmaps. Bitmaps merge chunk by chunk, so no task and no row
ever holds all of a frequent term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Records of a chunk, numbers up to which a list is kept, rows a task sorts at once.
CHUNK, LISTED, ROWS = 1 << 16, 4096, 400_000


def pack(places: np.ndarray) -> bytes:
    """Bitmap of sorted distinct places below CHUNK."""
    if len(places) <= LISTED:
        return b"L" + places.astype("<u2").tobytes()
    bits = np.zeros(CHUNK, np.uint8)
    bits[places] = 1
    return b"B" + np.packbits(bits, bitorder="little").tobytes()


def unpack(bitmap: bytes) -> np.ndarray:
    """Places of a bitmap, sorted."""
    if bitmap[:1] == b"L":
        return np.frombuffer(bitmap, "<u2", offset=1).astype(np.int64)
    return np.nonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8, offset=1), bitorder="little"))[0]


def union(bitmaps: list[bytes]) -> bytes:
    """Union of bitmaps of one chunk."""
    return bitmaps[0] if len(bitmaps) == 1 else pack(np.unique(np.concatenate([unpack(b) for b in bitmaps])))


def cardinality(bitmap: bytes) -> int:
    if bitmap[:1] == b"L":
        return (len(bitmap) - 1) // 2
    return int(np.unpackbits(np.frombuffer(bitmap, np.uint8, offset=1)).sum())


_PARTS = "term string, chunk bigint, bitmap binary, occurrences bigint"


def _bitmaps(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of the batches of (record, term, occurrences), some ROWS at a time."""

    def build(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        words = t.column(1).combine_chunks().dictionary_encode()
        codes, record, times = np.asarray(words.indices).astype(np.int64), np.asarray(t.column(0)), np.asarray(t.column(2))
        order = np.lexsort((record, codes))
        codes, record, times = codes[order], record[order], times[order]
        chunk = record >> 16
        first = np.r_[True, (codes[1:] != codes[:-1]) | (chunk[1:] != chunk[:-1])]
        starts = np.nonzero(first)[0]
        place = (record & (CHUNK - 1)).astype("<u2")
        new = np.r_[True, (codes[1:] != codes[:-1]) | (record[1:] != record[:-1])]
        ends = np.r_[starts[1:], len(codes)]
        bitmaps = [pack(place[a:b][new[a:b]]) for a, b in zip(starts, ends)]
        return pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(codes[starts])).cast(pa.string()), pa.array(chunk[starts]), pa.array(bitmaps, pa.binary()), pa.array(np.add.reduceat(times, starts))], ["term", "chunk", "bitmap", "occurrences"])

    held, n = [], 0
    for batch in rows:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= ROWS:
            yield build(held)
            held, n = [], 0
    if held:
        yield build(held)


def term_bitmaps(postings: DataFrame) -> DataFrame:
    """term, chunk, bitmap, occurrences, cardinality: one row for each chunk of each term.

    ``postings``: record BIGINT (0 or more), term STRING, occurrences BIGINT; rows of one record and term add up.
    """
    ship(postings.sparkSession)
    rows = postings.select(F.col("record").cast("bigint"), F.col("term").cast("string"), F.col("occurrences").cast("bigint")).where("record is not null and term is not null")
    parts = rows.mapInArrow(_bitmaps, _PARTS)

    @F.pandas_udf("struct<bitmap:binary,cardinality:bigint>")
    def merged(bitmaps: pd.Series) -> pd.DataFrame:
        out = [union(list(b)) for b in bitmaps]
        return pd.DataFrame({"bitmap": out, "cardinality": [cardinality(b) for b in out]})

    grouped = parts.groupBy("term", "chunk").agg(F.collect_list("bitmap").alias("bitmaps"), F.sum("occurrences").alias("occurrences"))
    return grouped.withColumn("m", merged("bitmaps")).select("term", "chunk", "m.bitmap", "occurrences", "m.cardinality")


def term_frequencies(bitmaps: DataFrame, records: DataFrame, rare_below: int = 3, common_above: float = 0.2, loose: DataFrame | None = None) -> DataFrame:
    """term, occurrences, n_records, share, mark of every distinct term.

    ``records``: one row with the number of all records in ``n``. ``loose``: further (term, occurrences) outside
    of any record. mark is 'rare' for terms in at least 1 but fewer than ``rare_below`` records, 'common' for
    those in more than ``common_above`` of all records (rare wins), else ''.
    """
    sums = bitmaps.select("term", "occurrences", "cardinality")
    if loose is not None:
        sums = sums.unionByName(loose.select("term", "occurrences", F.lit(0).cast("bigint").alias("cardinality")))
    out = sums.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("cardinality").alias("n_records")).crossJoin(records.select(F.col("n").alias("all_records")))  # one row
    share = F.when(F.col("all_records") > 0, F.col("n_records") / F.col("all_records")).otherwise(F.lit(0.0))
    mark = F.when((F.col("n_records") >= 1) & (F.col("n_records") < rare_below), "rare").when(F.col("n_records") > F.lit(common_above) * F.col("all_records"), "common").otherwise("")
    return out.select("term", "occurrences", "n_records", share.alias("share"), mark.alias("mark"))


def number_records(postings: DataFrame) -> DataFrame:
    """``postings`` (key, term, occurrences), each once, with a dense number for each key in ``record``.

    Keys are spread by hash and numbered within their partition, so the numbers of a partition fill whole chunks.
    A retried task may number its keys anew; within the partition that is a renaming, which no count sees.
    """
    ship(postings.sparkSession)
    spread = postings.select("key", "term", "occurrences").repartition("key").sortWithinPartitions("key").withColumn("p", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0)
            other = np.r_[key[0].as_py() != last, np.asarray(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False))]
            number = n + np.cumsum(other)
            last, n = key[-1].as_py(), int(number[-1])
            record = (np.asarray(batch.column(3)).astype(np.int64) << 40) + number
            yield pa.RecordBatch.from_arrays([pa.array(record), batch.column(1), batch.column(2)], ["record", "term", "occurrences"])

    return spread.mapInArrow(number, "record bigint, term string, occurrences bigint")


def keyed_term_frequencies(rows: DataFrame, key_col: str, term_col: str, rare_below: int = 3, common_above: float = 0.2) -> DataFrame:
    """Term frequencies of (key, term) rows, one for each occurrence, with any kind of key.

    Rows with a null term are left out; rows with a null key belong to no record and only count as occurrences.
    All records are the keys with a term. Rows are summed by key and term before they are shuffled by key.
    """
    r = rows.select(rows[key_col].alias("key"), rows[term_col].alias("term")).where("term is not null")
    sums = r.where("key is not null").groupBy("key", "term").agg(F.count("*").alias("occurrences"))
    loose = r.where("key is null").groupBy("term").agg(F.count("*").alias("occurrences"))
    n = r.where("key is not null").agg(F.count_distinct("key").alias("n"))
    return term_frequencies(term_bitmaps(number_records(sums)), n, rare_below, common_above, loose)


def text_term_frequencies(rows: DataFrame, id_col: str, text_col: str, rare_below: int = 3, common_above: float = 0.2) -> DataFrame:
    """Frequencies of the words (runs of a-z and 0-9 of the lower-cased text) of texts with a unique number of 0 or more.

    Null and empty texts are no records; texts without a word are.
    """
    r = rows.select(rows[id_col].cast("bigint").alias("record"), rows[text_col].alias("text")).where("record is not null and text is not null and text <> ''")
    words = r.select("record", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("term")).withColumn("occurrences", F.lit(1).cast("bigint"))
    return term_frequencies(term_bitmaps(words), r.agg(F.count("*").alias("n")), rare_below, common_above)
