"""Exception classes of the engine."""


class AnalysisError(Exception):
    """Base of analysis errors; shown as ``Kind: message``."""

    kind = "AnalysisError"

    def __init__(self, message: str):
        super().__init__(message)
        self.message = message

    def __str__(self) -> str:
        return f"{self.kind}: {self.message}"


class ValidationError(AnalysisError):
    kind = "ValidationError"


class ArrowError(AnalysisError):
    kind = "ArrowError"


class ModelError(AnalysisError):
    kind = "ModelError"


def split_error(text: str) -> tuple[str, str]:
    """``"Kind: msg"`` as (code, message), cut at the first ``": "``; ModelError where there is none."""
    code, found, message = text.partition(": ")
    return (code, message) if found else ("ModelError", text)


class ConvertError(Exception):
    """Base of file conversion errors; the message ends with a hint how to mend it."""

    hint = ""

    def __init__(self, message: str):
        super().__init__(f"{message}. Fix: {self.hint}" if self.hint else message)


class InvalidCsv(ConvertError):
    hint = "check the delimiter, the quoting and that the file is UTF-8"


class CsvMissingHeader(ConvertError):
    hint = "add a header line or read without a header"


class InvalidSchema(ConvertError):
    hint = "give one column definition for each column of the file"


class TypeConversionFailed(ConvertError):
    hint = "correct the value or declare the column as a string (type_id 0)"


class ParquetRowGroupTooLarge(ConvertError):
    hint = "use a row group size from 64 to 16384"


class MemoryLimitExceeded(ConvertError):
    hint = "convert smaller files or raise the limit"


class ExcelInvalid(ConvertError):
    hint = "save the workbook as .xlsx"


class ExcelEncrypted(ConvertError):
    hint = "remove the password of the workbook"


class ExcelFileTooLarge(ConvertError):
    hint = "raise max_string_table_bytes or split the workbook"


class InvalidState(ConvertError):
    hint = "call begin once, then feed, the last time with is_last"


class InternalError(ConvertError):
    hint = ""
