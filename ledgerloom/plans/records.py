"""Queries of the record parser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.bad_records import failing_records, parse_records, typed_rows
from ..session import table


def _parsed(spark: SparkSession, d: str, fields: bool = True) -> DataFrame:
    return parse_records(table(spark, d, "raw_records"), table(spark, d, "csv_options"), table(spark, d, "column_defs"), fields)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return failing_records(_parsed(spark, d, fields=False))


def p5_rows(spark: SparkSession, d: str) -> DataFrame:
    return typed_rows(_parsed(spark, d))


def queries() -> dict:
    return {f.__name__: f for f in (p5_found, p5_rows)}


def _by_delimiter(expr: str) -> str:
    """An SQL expression with a constant pattern for each delimiter of the tables."""
    out = "".join(f" WHEN {text} THEN " + expr.replace("@D", text).replace("@C", char) for text, char in (("','", ","), ("';'", ";"), ("'|'", "|"), ("chr(9)", r"\t")))
    return f"CASE delimiter{out} END"


_FIELD = '("([^"]|"")*"|[^"@C]*)'
_LEGAL = _by_delimiter(f"regexp_full_match(raw, '{_FIELD}([@C]{_FIELD})*')")
_FIELDS = _by_delimiter(f"regexp_extract_all(raw || @D, '{_FIELD}[@C]', 1)")
_FLOAT = r"[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))"
_BAD = f"v <> '' AND CASE type_id WHEN 1 THEN NOT regexp_full_match(v, '[+-]?[0-9]+') OR TRY_CAST(v AS BIGINT) IS NULL WHEN 2 THEN NOT regexp_full_match(v, '{_FLOAT}') WHEN 3 THEN NOT regexp_full_match(v, '(?i:true|1|yes|t|y|false|0|no|f|n)') ELSE false END"
_SPLIT = f"""WITH c AS (SELECT file_id, count(*) n FROM column_defs GROUP BY 1),
l AS (SELECT file_id, line_no, arg_max(raw_text, (loaded_ts, raw_text)) t FROM raw_records GROUP BY 1, 2),
r AS (SELECT file_id, line_no, delimiter, n, CASE WHEN right(t, 1) = chr(13) THEN left(t, length(t) - 1) ELSE t END raw FROM l JOIN csv_options USING (file_id) JOIN c USING (file_id) WHERE NOT (has_header AND line_no = 1)),
x AS (SELECT file_id, line_no, n, {_LEGAL} legal, {_FIELDS} fields FROM r WHERE raw <> ''),
u AS (SELECT file_id, line_no, unnest(fields) f, generate_subscripts(fields, 1) - 1 col_no FROM x WHERE legal AND len(fields) = n),
v AS (SELECT u.file_id, line_no, u.col_no, name, type_id, CASE WHEN left(f, 1) = '"' THEN replace(substr(f, 2, length(f) - 2), '""', '"') ELSE f END v FROM u JOIN column_defs d ON d.file_id = u.file_id AND d.col_no = u.col_no),
b AS (SELECT file_id, line_no, arg_min(name, col_no) column_name FROM v WHERE {_BAD} GROUP BY 1, 2)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": f"{_SPLIT} SELECT file_id, line_no, CASE WHEN NOT legal THEN 'quoting' ELSE 'column_count' END reason, '' column_name FROM x WHERE NOT legal OR len(fields) <> n UNION ALL SELECT file_id, line_no, 'invalid_value', column_name FROM b",
        "p5_rows": f"{_SPLIT} SELECT file_id, line_no, CAST(col_no AS INT) col_no, name, type_id, CASE WHEN v <> '' AND type_id NOT IN (1, 2, 3) THEN v END string_value, CASE WHEN type_id = 1 THEN TRY_CAST(v AS BIGINT) END bigint_value, CASE WHEN type_id = 2 THEN TRY_CAST(v AS DOUBLE) END double_value, CASE WHEN type_id = 3 AND v <> '' THEN lower(v) IN ('true', '1', 'yes', 't', 'y') END boolean_value FROM v ANTI JOIN b USING (file_id, line_no)",
    }
