"""Rows that fail to parse: typed rows and failing records, each with its reason.

Records travel in blocks of one file. A block is parsed as a whole on a columnar
path that accepts only what is certainly valid. A block that it refuses is cut in
half, again and again, until the refused records stand in a handful or alone; those are
diagnosed strictly, one by one, and the strict parser has the last word on them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship, small

#: Records of one file that are parsed together, and lines of a file that one task takes at most (about).
BLOCK, PART = 2048, 65_536
#: A refused block of so many records isn't cut further: its records are all diagnosed.
ALONE = 16

#: What a typed field may look like, by type id.
INTEGER = r"[+-]?[0-9]+"
FLOAT = r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])"
BOOLEAN = r"(?:[tT][rR][uU][eE]|[fF][aA][lL][sS][eE]|[yY][eE][sS]|[nN][oO]|[01tfynTFYN])"
TRUE = ("true", "1", "yes", "t", "y")
TYPES = {1: INTEGER, 2: FLOAT, 3: BOOLEAN}
_WHOLE = {k: re.compile(v) for k, v in TYPES.items()}
LOW, HIGH = -(2**63), 2**63 - 1


def split_strictly(record: str, delimiter: str) -> list[str] | None:
    """Fields of a record, quotes removed; None where a quote is illegal.

    A quote is legal only around a whole field, with quotes inside doubled.
    """
    if '"' not in record:
        return record.split(delimiter)
    out, at, n = [], 0, len(record)
    while True:
        if record.startswith('"', at):
            parts, at = [], at + 1
            while True:
                end = record.find('"', at)
                if end < 0:
                    return None
                parts.append(record[at:end])
                at = end + 1
                if not record.startswith('"', at):
                    break
                parts.append('"')
                at += 1
            out.append("".join(parts))
            if at < n and not record.startswith(delimiter, at):
                return None
        else:
            end = record.find(delimiter, at)
            end = n if end < 0 else end
            field = record[at:end]
            if '"' in field:
                return None
            out.append(field)
            at = end
        if at >= n:
            return out
        at += len(delimiter)


def fits(value: str, type_id: int) -> bool:
    """Whether a field without its quotes fits its type; an empty one always does."""
    known = _WHOLE.get(type_id)
    if not value or known is None:
        return True
    if not known.fullmatch(value):
        return False
    if type_id != 1:
        return True
    digits = value.lstrip("+-").lstrip("0") or "0"
    return len(digits) <= 19 and LOW <= (-int(digits) if value[0] == "-" else int(digits)) <= HIGH


def diagnose(record: str, delimiter: str, names: list[str], types: list[int]) -> tuple[str, str, list[str] | None]:
    """(reason, column to blame, fields): the reason is empty for a valid record."""
    fields = split_strictly(record, delimiter)
    if fields is None:
        return "quoting", "", None
    if len(fields) != len(types):
        return "column_count", "", None
    for value, name, type_id in zip(fields, names, types):
        if not fits(value, type_id):
            return "invalid_value", name, None
    return "", "", fields


@lru_cache(256)
def _legal(delimiter: str, columns: int) -> str:
    """Pattern of a record with legal quotes and so many columns."""
    d = re.escape(delimiter)
    field = f'(?:"(?:[^"]|"")*"|[^"{d}]*)'
    return f"^{field}(?:{d}{field}){{{columns - 1}}}$" if len(delimiter.encode()) == 1 and delimiter not in '"\r\n' else ""


def _parse_block(records: pa.Array, delimiter: str, types: list[int]) -> list[pa.Array] | None:
    """String columns of a block all of whose records are valid, else None. Never takes an invalid record."""
    pattern = _legal(delimiter, len(types))
    if not pattern or not 1 <= len(types) <= 200:
        return None
    if pc.any(pc.match_substring(records, '"')).as_py():
        legal = pc.match_substring_regex(records, pattern)
    else:
        legal = pc.equal(pc.count_substring(records, delimiter), len(types) - 1)
    if not pc.all(legal).as_py():
        return None
    if pc.any(pc.ends_with(records, "\r")).as_py():  # with the line end that follows it would be taken for CR LF
        return None
    one = pa.ListArray.from_arrays(pa.array([0, len(records)], pa.int32()), records)
    text = pc.binary_join(one, "\n")[0].as_buffer().to_pybytes() + b"\n"
    names = [str(i) for i in range(len(types))]
    try:
        got = pacsv.read_csv(
            pa.BufferReader(text),
            pacsv.ReadOptions(column_names=names, use_threads=False, block_size=max(len(text) * 4, 1 << 16)),
            pacsv.ParseOptions(delimiter=delimiter, newlines_in_values=True, ignore_empty_lines=False),
            pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False, quoted_strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    if got.num_rows != len(records):
        return None
    columns = [c.combine_chunks() for c in got.columns]
    for column, type_id in zip(columns, types):
        pattern = TYPES.get(type_id)
        if pattern is None:
            continue
        if not pc.all(pc.match_substring_regex(column, f"^(?:{pattern})?$")).as_py():
            return None
        # 18 digits are always within 64 bits; longer numbers are left to the strict parser
        if type_id == 1 and pc.any(pc.greater(pc.binary_length(column), 18)).as_py():
            return None
    return columns


def _bisect(records: pa.Array, first: int, delimiter: str, types: list[int], good: list, bad: list) -> None:
    """Sort a block into parsed sub-blocks (first row, columns) and rows that stand alone."""
    n = len(records)
    if n == 0:
        return
    if (columns := _parse_block(records, delimiter, types)) is not None:
        good.append((first, n, columns))
    elif n <= ALONE:
        bad.extend(range(first, first + n))
    else:
        half = n // 2
        _bisect(records.slice(0, half), first, delimiter, types, good, bad)
        _bisect(records.slice(half), first + half, delimiter, types, good, bad)


def check_block(records: pa.Array, delimiter: str, names: list[str], types: list[int]) -> tuple[list, list[tuple[int, list[str]]], list[tuple[int, str, str]]]:
    """(valid sub-blocks by column, valid single records, failing records with reason and column)."""
    good, alone, single, failed = [], [], [], []
    _bisect(records, 0, delimiter, types, good, alone)
    for i in alone:
        reason, column, fields = diagnose(records[i].as_py(), delimiter, names, types)
        if reason:
            failed.append((i, reason, column))
        else:
            single.append((i, fields))
    return good, single, failed


def prepare_records(records: DataFrame, options: DataFrame, columns: DataFrame) -> DataFrame:
    """Records and definitions of files in one stream: file_id, salt, line_no, raw, delimiter, has_header, names, types.

    Spread by file and sorted: the definition of a file comes first (raw null), then its records by line, the latest
    delivery with a text first (ties: the greater text). So a definition travels once a task and not once a record, and
    one shuffle serves the deliveries and the definitions. Rows with a null key and records without a text are left out.
    A file of more than PART records is spread over as many tasks as it has parts, and its definition with
    it; these files are counted beforehand, from the one column.
    """
    raw = records.select("file_id", "line_no", F.col("raw_text").alias("raw"), "loaded_ts").where("file_id is not null and line_no is not null and raw is not null")
    large = cut(records.groupBy("file_id").agg(F.count("*").alias("n")).where((F.col("n") > PART) & F.col("file_id").isNotNull()))
    large = small(large.select("file_id", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    raw = raw.join(large, "file_id", "left").withColumn("salt", F.pmod(F.floor(F.col("line_no") / BLOCK), parts).cast("int"))
    one = Window.partitionBy("file_id", "col_no").orderBy("name", "type_id")  # repeated definitions of a column count once
    columns = columns.where("file_id is not null and col_no is not null").withColumn("nth", F.row_number().over(one)).where("nth = 1")
    columns = columns.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("col_no", "name", "type_id"))).alias("cols"))
    options = options.groupBy("file_id").agg(F.max("delimiter").alias("delimiter"), F.max("has_header").alias("has_header"))
    files = options.join(columns, "file_id").join(large, "file_id", "left").where("delimiter is not null and delimiter <> ''").select(
        "file_id", "delimiter", F.coalesce("has_header", F.lit(False)).alias("has_header"), F.transform("cols", lambda c: F.coalesce(c["name"], F.lit(""))).alias("names"), F.transform("cols", lambda c: F.coalesce(c["type_id"], F.lit(0)).cast("int")).alias("types"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt")
    )
    names = ["file_id", "salt", "line_no", "raw", "loaded_ts", "delimiter", "has_header", "names", "types"]
    both = raw.select("file_id", "salt", "line_no", "raw", "loaded_ts").unionByName(files, allowMissingColumns=True).select(*names)
    spread = both.repartition("file_id", "salt").sortWithinPartitions("file_id", "salt", F.col("raw").isNotNull(), "line_no", F.desc_nulls_last("loaded_ts"), F.desc("raw"))
    return spread.drop("loaded_ts")


_OUT = "file_id string, line_no bigint, reason string, column_name string"
_FIELDS = ", fields array<string>, names array<string>, types array<int>"


def parse_records(records: DataFrame, options: DataFrame, columns: DataFrame, fields: bool = True) -> DataFrame:
    """Every data record once: file_id, line_no, reason, column_name, and with ``fields`` also fields, names, types.

    Line 1 of a file with a header and empty records are no data; one trailing CR is no part of a record. A record
    delivered again counts once, see :func:`prepare_records`. Records of a file without options or columns are left out.
    Valid records have reason '' and their fields (empty ones null); failing records have no fields. Without
    ``fields`` only the failing records come out. Empty tables give no rows.
    """
    ship(records.sparkSession)
    prepared = prepare_records(records, options, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, definition, last = None, None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            codes = np.asarray(batch.column(0).dictionary_encode().indices).astype(np.int64)
            salt, line = np.asarray(batch.column(1)), np.asarray(batch.column(2).fill_null(-1))
            head = np.asarray(pc.is_null(batch.column(3)).to_numpy(zero_copy_only=False))
            edges = np.r_[0, np.nonzero((np.diff(codes) != 0) | (np.diff(salt) != 0))[0] + 1, len(codes)]
            for a, b in zip(edges[:-1], edges[1:]):
                now = (batch.column(0)[int(a)].as_py(), int(salt[a]))
                if now != key:
                    key, definition, last = now, None, None
                if head[a]:
                    definition, a = [batch.column(i)[int(a)].as_py() for i in (4, 5, 6, 7)], a + 1
                if definition is None or a == b:
                    continue
                first = np.r_[line[a] != last, line[a + 1 : b] != line[a : b - 1]]  # of a record's deliveries
                last = line[b - 1]
                rows = np.nonzero(first & ~((line[a:b] == 1) & definition[1]))[0] + a
                raw, at = batch.column(3).take(pa.array(rows)), line[rows]
                if pc.any(cr := pc.ends_with(raw, "\r")).as_py():
                    raw = pc.if_else(cr, pc.utf8_slice_codeunits(raw, 0, -1), raw)
                filled = pc.greater(pc.binary_length(raw), 0)
                raw, at = raw.filter(filled), at[np.asarray(filled.to_numpy(zero_copy_only=False))]
                for s in range(0, len(raw), BLOCK):
                    yield _block(now[0], raw.slice(s, BLOCK), at[s : s + BLOCK], definition)

    def _block(file: str, raw: pa.Array, line: np.ndarray, definition: list) -> pa.RecordBatch:
        delimiter, _, names, types = definition
        good, single, failed = check_block(raw, delimiter, names, types)
        if not fields:
            rows = np.array([i for i, _, _ in failed], np.int64)
            arrays = [pa.array([file] * len(rows), pa.string()), pa.array(line[rows]), pa.array([why for _, why, _ in failed], pa.string()), pa.array([name for _, _, name in failed], pa.string())]
            return pa.RecordBatch.from_arrays(arrays, ["file_id", "line_no", "reason", "column_name"])
        n, none = len(raw), pa.scalar(None, pa.string())
        # sub-blocks and single records in any order, each with its lists; then taken in the order of the block
        places, lists = [], []
        for first, m, columns in good:
            places.append(np.arange(first, first + m))
            values = pa.concat_arrays(columns).take(pa.array(np.arange(m * len(columns)).reshape(len(columns), m).T.ravel()))
            lists.append(pa.ListArray.from_arrays(pa.array(np.arange(0, m * len(columns) + 1, len(columns), dtype=np.int32)), pc.if_else(pc.equal(values, ""), none, values)))
        places.append(np.array([i for i, _ in single] + [i for i, _, _ in failed], np.int64))
        lists.append(pa.array([[v or None for v in row] for _, row in single] + [None] * len(failed), pa.list_(pa.string())))
        order = pa.array(np.argsort(np.concatenate(places), kind="stable"))
        reason, column = [""] * n, [""] * n
        for i, why, name in failed:
            reason[i], column[i] = why, name
        same = pa.array(np.zeros(n, np.int64))
        arrays = [pa.array([file] * n, pa.string()), pa.array(line), pa.array(reason, pa.string()), pa.array(column, pa.string()), pa.concat_arrays(lists).take(order), pa.array([names], pa.list_(pa.string())).take(same), pa.array([types], pa.list_(pa.int32())).take(same)]
        return pa.RecordBatch.from_arrays(arrays, ["file_id", "line_no", "reason", "column_name", "fields", "names", "types"])

    return prepared.mapInArrow(run, _OUT + (_FIELDS if fields else ""))


def failing_records(parsed: DataFrame) -> DataFrame:
    """file_id, line_no, reason, column_name of the records that fail."""
    return parsed.where("reason <> ''").select("file_id", "line_no", "reason", "column_name")


def typed_rows(parsed: DataFrame) -> DataFrame:
    """Values of the valid records, a row for each field, typed by its type id.

    Files differ in names and types, so a value stands in the column of its type:
    string_value, bigint_value, double_value or boolean_value; an empty field is null in all.
    """
    rows = parsed.where("reason = ''").select("file_id", "line_no", F.posexplode(F.arrays_zip("fields", "names", "types")).alias("col_no", "f"))
    value, kind = F.col("f.fields"), F.col("f.types")
    return rows.select(
        "file_id",
        "line_no",
        "col_no",
        F.col("f.names").alias("name"),
        kind.alias("type_id"),
        F.when(~kind.isin(1, 2, 3), value).alias("string_value"),
        F.when(kind == 1, value.try_cast("bigint")).alias("bigint_value"),
        F.when(kind == 2, value.try_cast("double")).alias("double_value"),
        F.when(kind == 3, F.lower(value).isin(*TRUE)).alias("boolean_value"),
    )
