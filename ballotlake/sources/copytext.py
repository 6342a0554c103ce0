r"""COPY text: one row per line, tab between columns, ``\N`` for NULL, ``\.`` at the end.

Columns are split and unescaped by built-in functions on lines Spark reads in
parallel; a tab or newline inside a value is escaped, so neither splits one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotlake.model import SCHEMAS
from ballotlake.sources.snapshot import conform

# The escapes of the format, as (escape letter, character).
ESCAPES = (("t", "\t"), ("n", "\n"), ("r", "\r"), ("b", "\b"), ("f", "\f"), ("v", "\v"))
_HOLD = "\x00"


#: A backslash and hexadecimal or octal digits stand for the byte of that value.
_NUMBERED = r"\\(?:x[0-9A-Fa-f]{1,2}|[0-7]{1,3})"


def _numbered(value: Column) -> Column:
    """Values with numbered bytes, decoded as UTF-8 together with what stands around them."""
    parts = F.split(value, _NUMBERED, -1)
    codes = F.transform(F.regexp_extract_all(value, F.lit(_NUMBERED), F.lit(0)), lambda c: F.when(
        F.substring(c, 2, 1) == "x", F.lpad(F.substring(c, 3, 2), 2, "0")
    ).otherwise(F.lpad(F.conv(F.substring(c, 2, 3), 8, 16), 2, "0")))
    hexes = F.zip_with(F.transform(parts, lambda p: F.hex(p.cast("binary"))), codes, lambda p, c: F.concat(p, F.coalesce(c, F.lit(""))))
    return F.when(value.rlike(_NUMBERED), F.decode(F.unhex(F.array_join(hexes, "")), "UTF-8")).otherwise(value)


def _unescape(value: Column) -> Column:
    """Backslash pairs are put aside first, so that an escaped backslash escapes nothing."""
    value = _numbered(F.replace(value, F.lit("\\\\"), F.lit(_HOLD)))
    for letter, character in ESCAPES:
        value = F.replace(value, F.lit(f"\\{letter}"), F.lit(character))
    value = F.replace(value, F.lit("\\"), F.lit(""))
    return F.replace(value, F.lit(_HOLD), F.lit("\\"))


def _escape(value: Column) -> Column:
    value = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for letter, character in ESCAPES:
        value = F.replace(value, F.lit(character), F.lit(f"\\{letter}"))
    return F.coalesce(value, F.lit("\\N"))


def load_copy_text(
    spark: SparkSession, path: str, table: str, columns: list[str] | None = None
) -> DataFrame:
    """A table of the model from COPY text files; ``columns`` is the order in the files."""
    return parse_lines(spark.read.text(path).where(F.col("value") != "\\."), table, columns)


def parse_lines(lines: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    """A table of the model from the data lines (``value``) of COPY text."""
    columns = columns or SCHEMAS[table].names
    fields = F.split("value", "\t")
    values = [
        F.when(fields[i] == "\\N", None).otherwise(_unescape(fields[i])).alias(name)
        for i, name in enumerate(columns)
    ]
    whole = lines.withColumn("value", F.when(
        F.size(fields) == len(columns), F.col("value")
    ).otherwise(F.raise_error(F.concat(F.lit(f"{table}: wrong number of columns: "), "value"))))
    return conform(whole.select(*values), table)


def copy_line(values: list[Column]) -> Column:
    """One line of COPY text."""
    return F.concat_ws("\t", *[_escape(v.cast("string")) for v in values])


def write_copy_text(df: DataFrame, path: str) -> None:
    """COPY text files, one per partition, without the end marker."""
    df.select(copy_line([F.col(name) for name in df.columns]).alias("value")).write.mode("overwrite").text(path)
