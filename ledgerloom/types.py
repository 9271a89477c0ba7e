"""Enums, options, schemas and schema hints."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from enum import Enum, IntEnum

from .errors import InvalidSchema, ParquetRowGroupTooLarge, ValidationError

#: Output schemas.
ANOMALY = "order_id string, abnormal_score double, is_abnormal boolean"
CLUSTER = "order_id string, cluster_id bigint"
FORECAST = "step_index int, prediction double"
BATCH_FORECAST = "sku_id string, step_index int, prediction double, error_code string, error_message string"
PATTERNS = "pattern array<string>, support bigint"

#: Limits.
MAX_FEATURES = 16
STRICT_DIMS = (2, 5, 7, 10, 11, 13, 15, 16)
ROW_GROUP_LIMITS = (64, 16384)
EPSILON = 2.220446049250313e-16
DEFAULT_PERIOD = 7


class ScalingMethod(IntEnum):
    """How a column is scaled; unknown codes mean none."""

    NONE = 0
    MIN_MAX = 1
    STANDARD = 2

    @classmethod
    def of(cls, code: int | str | ScalingMethod) -> ScalingMethod:
        """From a number (unknown: none) or from a name (unknown: ValidationError)."""
        if isinstance(code, str):
            try:
                return {"none": cls.NONE, "minmax": cls.MIN_MAX, "min_max": cls.MIN_MAX, "standard": cls.STANDARD}[code.lower()]
            except KeyError:
                raise ValidationError(f"unknown scaling: {code}") from None
        return cls(code) if code in (0, 1, 2) else cls.NONE


@dataclass(frozen=True)
class PredictionMode:
    """Features of time that a forecast uses: linear, polynomial (degree), seasonal or ensemble (period)."""

    kind: str = "linear"
    degree: int = 1
    period: int = DEFAULT_PERIOD

    @classmethod
    def from_code(cls, code: int, period: int = 0) -> PredictionMode:
        """0 linear, 1 polynomial of degree 2, 2 seasonal, 3 ensemble; others linear; period 0 is 7."""
        period = period or DEFAULT_PERIOD
        return {1: cls("polynomial", 2, period), 2: cls("seasonal", 1, period), 3: cls("ensemble", 2, period)}.get(code, cls("linear", 1, period))

    @classmethod
    def from_name(cls, name: str, period: int = DEFAULT_PERIOD) -> PredictionMode:
        """linear, polynomial_2, polynomial_3, seasonal or ensemble (a suffix _N of the last two is their period)."""
        kind, _, tail = name.lower().partition("_")
        if kind == "linear" and not tail:
            return cls("linear", 1, period)
        if kind == "polynomial" and tail in ("2", "3"):
            return cls("polynomial", int(tail), period)
        if kind in ("seasonal", "ensemble") and (not tail or tail.isdigit()):
            return cls(kind, 2 if kind == "ensemble" else 1, int(tail) if tail else period)
        raise ValidationError(f"unknown prediction mode: {name}")


class NullHandling(str, Enum):
    """What an empty CSV field of a string column becomes."""

    NULL = "null"
    EMPTY_STRING = "empty_string"


class Compression(str, Enum):
    UNCOMPRESSED = "uncompressed"
    SNAPPY = "snappy"
    ZSTD = "zstd"


@dataclass(frozen=True)
class CsvReadOptions:
    """``multi_line``: whether line feeds within quotes are looked for, which keeps a file from being split; None finds out by one scan of the lines."""

    delimiter: str = ","
    has_header: bool = True
    null_handling: NullHandling = NullHandling.NULL
    multi_line: bool | None = None


@dataclass(frozen=True)
class CsvWriteOptions:
    delimiter: str = ","
    has_header: bool = True


@dataclass(frozen=True)
class ParquetWriteOptions:
    row_group_size: int = 1024
    compression: Compression = Compression.SNAPPY

    def __post_init__(self) -> None:
        low, high = ROW_GROUP_LIMITS
        if not low <= self.row_group_size <= high:
            raise ParquetRowGroupTooLarge(f"row group size {self.row_group_size} is outside {low}..{high}")


@dataclass(frozen=True)
class ExcelLoadOptions:
    """``sheet``: name or index from 0; '' is the first sheet. ``max_string_table_bytes`` 0 is 100 MB."""

    sheet: str | int = ""
    has_header: bool = True
    max_string_table_bytes: int = 0


#: Spark types by type id; any other id is a string.
TYPE_NAMES = {0: "string", 1: "bigint", 2: "double", 3: "boolean"}


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type_id: int = 0

    @property
    def spark_type(self) -> str:
        return TYPE_NAMES.get(self.type_id, "string")


@dataclass(frozen=True)
class SchemaHint:
    """Names and types of the columns of a file; they override its header."""

    columns: list[ColumnDef] = field(default_factory=list)

    @classmethod
    def from_json(cls, text: str) -> SchemaHint:
        """From ``{"columns": [{"name": ..., "type_id": ...}]}``; other keys are an error."""
        try:
            got = json.loads(text)
        except json.JSONDecodeError as e:
            raise InvalidSchema(f"schema hint is no JSON: {e}") from None
        if not isinstance(got, dict) or set(got) != {"columns"} or not isinstance(got["columns"], list):
            raise InvalidSchema("schema hint must hold columns and nothing else")
        out = []
        for c in got["columns"]:
            if not isinstance(c, dict) or set(c) != {"name", "type_id"} or not isinstance(c["name"], str) or type(c["type_id"]) is not int:
                raise InvalidSchema("a column of a schema hint must hold name and type_id and nothing else")
            out.append(ColumnDef(c["name"], c["type_id"]))
        return cls(out)

    def validate(self, file_columns: int) -> None:
        if not self.columns:
            raise InvalidSchema("schema hint has no columns")
        if len(self.columns) != file_columns:
            raise InvalidSchema(f"schema hint has {len(self.columns)} columns, the file has {file_columns}")
