"""CSV, Parquet, Excel, the conversion session and the file stream."""

import glob
import io
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerloom import api
from ledgerloom.errors import CsvMissingHeader, ExcelEncrypted, ExcelFileTooLarge, ExcelInvalid, InvalidCsv, InvalidSchema, InvalidState, MemoryLimitExceeded, ParquetRowGroupTooLarge
from ledgerloom.functions.casts import FLOAT, INTEGER, cast_or_null
from ledgerloom.session import put
from ledgerloom.sources.arrow_ipc import read_ipc_files
from ledgerloom.sources.converter import Converter
from ledgerloom.sources.csv_files import infer_types, read_csv, surveyed
from ledgerloom.sources.parquet_files import row_groups, write_parquet
from ledgerloom.sources.xlsx import Workbook, read_xlsx, write_workbook
from ledgerloom.streaming.csv_stream import csv_to_parquet
from ledgerloom.types import ColumnDef, Compression, CsvReadOptions, ExcelLoadOptions, NullHandling, ParquetWriteOptions, SchemaHint


def hint(*kinds):
    return SchemaHint([ColumnDef(f"h{i}", k) for i, k in enumerate(kinds)])


@pytest.fixture
def csv(spark, tmp_path):
    def run(text, options=None, schema=None):
        at = tmp_path / "in.csv"
        at.write_bytes(text.encode())
        return read_csv(spark, str(at), options, schema)

    return run


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_lenient(csv):
    assert rows(csv("part,bin,dock\nbolt M6,12,north\nwasher,7,west\n")) == [("bolt M6", "12", "north"), ("washer", "7", "west")]
    no = csv("u7,w2\nq,r\ns,t\n", CsvReadOptions(has_header=False))
    assert no.columns == ["col_0", "col_1"] and len(rows(no)) == 3
    assert rows(csv("part\tbin\nnut, hex\t3\n", CsvReadOptions("\t"))) == [("nut, hex", "3")]
    assert rows(csv("part;dock\nSchraube;Lübeck ☂\n", CsvReadOptions(";"))) == [("Schraube", "Lübeck ☂")]
    assert rows(csv('part,label\ncable,"5 m ""flat"", grey"\n')) == [("cable", '5 m "flat", grey')]
    several = csv('part,note\nlamp,"top\nshelf, left"\nfuse,"10 A"\n')
    assert rows(several) == [("lamp", "top\nshelf, left"), ("fuse", "10 A")]
    assert rows(csv("part,bin\n reel ,\t4\n")) == [(" reel ", "\t4")]
    assert rows(csv("a,a\n5,6\n").toDF("x", "y")) == [("5", "6")]
    assert rows(csv("a,b\r\n5,6\r\n\r\n7,8\r\n")) == [("5", "6"), ("7", "8")]
    assert rows(csv("a,b,c\n")) == []
    assert rows(csv('a,b\n,""\n')) == [(None, None)]
    assert rows(csv('a,b\n,""\n', CsvReadOptions(null_handling=NullHandling.EMPTY_STRING))) == [("", "")]
    with pytest.raises(CsvMissingHeader):
        csv("")


def test_line_feeds_within_quotes_are_looked_up(spark, tmp_path):
    (tmp_path / "plain.csv").write_text('a,b\n"x, y",1\n"say ""so""",2\n')
    (tmp_path / "open.csv").write_text('a,b\n"x\ny",1\n')
    found = lambda name, o=CsvReadOptions(): surveyed(spark, str(tmp_path / name), o).multi_line
    assert found("plain.csv") is False and found("open.csv") is True and found("plain.csv", CsvReadOptions(multi_line=True)) is True
    for name in ("plain.csv", "open.csv"):
        assert rows(read_csv(spark, str(tmp_path / name))) == rows(read_csv(spark, str(tmp_path / name), CsvReadOptions(multi_line=True)))


def test_a_file_without_line_feeds_in_quotes_is_split(spark, tmp_path):
    """A large file is read by several tasks, and no row is lost or read twice."""
    with open(tmp_path / "large.csv", "w") as f:
        f.write("n,t\n" + "".join(f'{i},"row, {i}"\n' for i in range(60_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
        df = read_csv(spark, str(tmp_path / "large.csv"), None, hint(1, 0))
        assert df.rdd.getNumPartitions() > 5
        got = df.agg({"h0": "sum", "*": "count"}).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == [60_000, sum(range(60_000))]


def test_bytes_that_are_no_utf8(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("part,dock\nnail,Köln\n".encode("latin-1"))
    with pytest.raises(InvalidCsv, match="latin.csv"):
        read_csv(spark, str(tmp_path / "latin.csv"))


def test_strict(csv):
    assert rows(csv("id,p\n+42,.25\n-7,1e3\n,\n0012,5.\n", None, hint(1, 2))) == [(42, 0.25), (-7, 1000.0), (None, None), (12, 5.0)]
    assert rows(csv("n,a\nx,yes\ny,N\nz,1\n", None, hint(0, 3))) == [("x", True), ("y", False), ("z", True)]
    assert csv("x\n1\n", None, hint(99)).schema["h0"].dataType.simpleString() == "string"
    for text, kind in (("i\ntwelve\n", 1), ("i\n 41\n", 1), ("i\n41 \n", 1), ("i\n4.0\n", 1), ("i\n+\n", 1), ("i\n9223372036854775808\n", 1), ("i\n1d\n", 2), ("i\n 1.5\n", 2), ("i\n.\n", 2), ("i\nmaybe\n", 3), ("i\n y \n", 3)):
        with pytest.raises(Exception, match="TypeConversionFailed: column 'h0'"):
            rows(csv(text, None, hint(kind)))
    with pytest.raises(InvalidSchema):
        csv("a,b\n1,2\n", None, hint(0, 0, 0))


def test_casts_are_those_of_the_patterns(spark):
    """Numbers and what looks like them: what the ends of a text settle is what its pattern says."""
    parts = ["", "1", "07", "-", "+", ".", "e5", "E-3", "x", "0x1p3", "d", "f", "NaN", "inf", "Infinity", " ", "\t", "\x7f", "٣", "_", ",", "9223372036854775807", *["8", "25", ".5", "1e2"] * 6]
    rnd = random.Random(1)
    texts = sorted({"".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(8000)})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = df.select("t", cast_or_null(t, 1).alias("i"), F.when(t.rlike(INTEGER), t.try_cast("bigint")).alias("wi"), cast_or_null(t, 2).alias("d"), F.when(t.rlike(FLOAT), t.try_cast("double")).alias("wd")).collect()
    assert [(r.t, r.i) for r in got] == [(r.t, r.wi) for r in got]
    assert [(r.t, str(r.d)) for r in got] == [(r.t, str(r.wd)) for r in got]
    assert sum(r.d is not None for r in got) > 300


def test_hint_json():
    got = SchemaHint.from_json('{"columns":[{"name":"id","type_id":1}]}')
    assert got.columns == [ColumnDef("id", 1)]
    for bad in ("{", "[]", '{"columns":[],"x":1}', '{"columns":[{"name":"a"}]}', '{"columns":[{"name":"a","type_id":1,"y":0}]}', '{"columns":[{"name":"a","type_id":"1"}]}'):
        with pytest.raises(InvalidSchema):
            SchemaHint.from_json(bad)
    with pytest.raises(InvalidSchema):
        SchemaHint([]).validate(0)


def test_infer(csv):
    assert infer_types(csv("i,d,s,e\n1,1.5,x,\n-2,3,4,5\n")) == {"i": "bigint", "d": "double", "s": "string", "e": "string"}


def test_row_groups(spark, tmp_path):
    out = str(tmp_path / "out")
    write_parquet(spark.range(3000).coalesce(1), out, ParquetWriteOptions(1000, Compression.ZSTD))
    (file,) = glob.glob(f"{out}/*.parquet")
    meta = pq.ParquetFile(file).metadata
    told = row_groups(spark, out).orderBy("nth").collect()
    assert [(r.nth, r.last, r.n_rows, r.compression) for r in told] == [(0, False, 1000, "zstd"), (1, False, 1000, "zstd"), (2, True, 1000, "zstd")] and told[0].n_bytes > 0
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [1000, 1000, 1000]
    assert meta.row_group(0).column(0).compression == "ZSTD" and spark.read.parquet(out).count() == 3000
    for n in (63, 20000):
        with pytest.raises(ParquetRowGroupTooLarge):
            ParquetWriteOptions(n)


def test_api_conversion(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b\n1;x\n")
    api.convert_csv_to_parquet(spark, str(tmp_path / "a.csv"), str(tmp_path / "o"), ";", True, 64, '{"columns":[{"name":"n","type_id":1},{"name":"t","type_id":0}]}')
    assert rows(spark.read.parquet(str(tmp_path / "o"))) == [(1, "x")]
    write_workbook(str(tmp_path / "b.xlsx"), {"s": [["a", "b"], ["1", "x"]]})
    api.convert_excel_to_parquet(spark, str(tmp_path / "b.xlsx"), str(tmp_path / "p"))
    assert rows(spark.read.parquet(str(tmp_path / "p"))) == [("1", "x")]


def test_converter(spark, tmp_path):
    with Converter(spark, str(tmp_path / "o")) as c:
        with pytest.raises(InvalidState):
            c.feed(b"x")
        c.begin_csv_to_parquet(write=ParquetWriteOptions(64))
        with pytest.raises(InvalidState):
            c.begin_excel_to_parquet()
        data = "part,bin\nÖse,30\nrivet,25\n".encode()
        assert c.feed(data[:10]) is None and c.state == "CsvToParquet"
        assert c.feed(data[10:], True) == str(tmp_path / "o") and c.state == "Idle" and c.bytes_consumed == len(data)
        assert rows(spark.read.parquet(str(tmp_path / "o"))) == [("Öse", "30"), ("rivet", "25")]
        c.begin_csv_to_parquet()
        with pytest.raises(CsvMissingHeader):
            c.feed(b"", True)
    small = Converter(spark, str(tmp_path / "p"), input_cap=5)
    small.begin_csv_to_parquet()
    with pytest.raises(MemoryLimitExceeded):
        small.feed(b"123456")
    small.free()
    with Converter(spark, str(tmp_path / "q"), memory_limit_mb=1) as c:
        c.begin_csv_to_parquet()
        with pytest.raises(MemoryLimitExceeded):
            c.feed(b"x" * (2**20 + 1))
    with pytest.raises(ValueError):
        Converter(spark, str(tmp_path / "r"), memory_limit_mb=0)


def test_xlsx(spark, tmp_path):
    at = str(tmp_path / "w.xlsx")
    write_workbook(at, {"first": [["a", "b & c"], ["1", ""], ["2", " y "]], "second": [["x"], ["7"]], "none": []})
    assert rows(read_xlsx(spark, at)) == [("1", None), ("2", " y ")]
    assert read_xlsx(spark, at).columns == ["a", "b & c"]
    assert rows(read_xlsx(spark, at, ExcelLoadOptions("second"), hint(1))) == [(7,)]
    assert rows(read_xlsx(spark, at, ExcelLoadOptions(1, has_header=False))) == [("x",), ("7",)]
    assert read_xlsx(spark, at, ExcelLoadOptions(1, has_header=False)).columns == ["col_0"]
    for sheet in ("third", 5, "none"):
        with pytest.raises(ExcelInvalid):
            read_xlsx(spark, at, ExcelLoadOptions(sheet))
    with pytest.raises(InvalidSchema):
        read_xlsx(spark, at, None, hint(1))
    for data, kind in ((b"", ExcelInvalid), (b"text", ExcelInvalid), (b"PK\x03\x04junk", ExcelInvalid), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", ExcelInvalid), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + "EncryptedPackage".encode("utf-16-le"), ExcelEncrypted)):
        (tmp_path / "bad.xlsx").write_bytes(data)
        with pytest.raises(kind):
            read_xlsx(spark, str(tmp_path / "bad.xlsx"))


def test_xlsx_shared_strings(spark, tmp_path):
    import zipfile

    at = str(tmp_path / "s.xlsx")
    write_workbook(at, {"s": []})
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(at) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{main}"><si><t>id</t></si><si><r><t>fl</t></r><r><t>ag</t></r></si></sst>'.encode()
    parts["xl/worksheets/sheet0.xml"] = f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>5</v></c><c r="C2" t="b"><v>1</v></c></row></sheetData></worksheet>'.encode()
    with zipfile.ZipFile(at, "w") as z:
        for n, data in parts.items():
            z.writestr(n, data)
    got = read_xlsx(spark, at)
    assert got.columns == ["id", "", "flag"] and rows(got) == [("5", None, "true")]
    with open(at, "rb") as f:
        book = Workbook(f.read())
    assert (book.sheet_names, book.string_table_size, book.row_count()) == (["s"], 2, 2)
    with pytest.raises(ExcelFileTooLarge):
        read_xlsx(spark, at, ExcelLoadOptions(max_string_table_bytes=10))


def test_several_workbooks(spark, tmp_path):
    write_workbook(str(tmp_path / "a.xlsx"), {"s": [["k", "v"], ["1", "x"], ["2"]]})
    write_workbook(str(tmp_path / "b.xlsx"), {"s": [["k", "v", "more"], ["3", "y", ""]]})
    assert sorted(rows(read_xlsx(spark, str(tmp_path)))) == [("1", "x"), ("2", None), ("3", "y")]
    write_workbook(str(tmp_path / "b.xlsx"), {"s": [["k", "v"], ["3", "y", "beyond"]]})
    with pytest.raises(Exception, match="more than 2 columns"):
        rows(read_xlsx(spark, str(tmp_path)))
    book = io.BytesIO()
    write_workbook(book, {"s": [["k"], ["9"]]})
    put(spark, f"file://{tmp_path}/new/c.xlsx", book.getvalue())
    assert rows(read_xlsx(spark, f"file://{tmp_path}/new/c.xlsx")) == [("9",)]


def test_ipc_files(spark, tmp_path):
    for i in range(3):
        t = pa.table({"a": [i, i + 10], "b": ["x", None]})
        with pa.ipc.new_stream(str(tmp_path / f"{i}.arrow"), t.schema) as w:
            w.write_table(t)
    assert sorted(r.a for r in read_ipc_files(spark, str(tmp_path)).collect()) == [0, 1, 2, 10, 11, 12]


def test_stream_takes_each_file_once(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    (tmp_path / "src").mkdir()
    for i in range(2):
        (tmp_path / "src" / f"{i}.csv").write_text(f"a,b\n{i},x\n")
        csv_to_parquet(spark, src, out, state, hint(1, 0)).awaitTermination()
        assert spark.read.parquet(out).count() == i + 1


def test_types_are_inferred_from_all_rows(spark):
    df = spark.range(300).selectExpr("cast(id as string) a", "case when id = 299 then 'x' else cast(id as string) end b").coalesce(1)
    assert infer_types(df) == {"a": "bigint", "b": "string"}
    assert infer_types(df, 100) == {"a": "bigint", "b": "bigint"}
