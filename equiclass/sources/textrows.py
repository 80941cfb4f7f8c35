"""Tables and lines that are stored as text in a column.

- ``stored_lines``: the non-blank lines of a text column with their positions.
- ``csv_line``: one CSV line of some columns, built natively.
- ``parse_csv``: a DataFrame of CSV lines -> typed or string columns; the header line of every
  file goes, and lines that don't fit the schema are told by a column of their own.

All are projections (``split``, ``to_csv``, ``from_csv``) but for the header, which is found by its
position, so nothing is shuffled. Null lines are dropped; an empty table keeps its schema.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Line ends of a stored text.
LINE_END = r"\r\n|\n|\r"


def stored_lines(df: DataFrame, text_col: str, keys: Sequence[str], line_col: str = "value",
                 position_col: str = "line_no") -> DataFrame:
    """``keys``, the line's position in its text (from 1; blank lines count) and the line.

    Blank lines (spaces only) and null texts give no row. A very long text becomes rows in its
    own task, as every ``explode`` does.
    """
    lines = df.select(*(F.col(f"`{k}`") for k in keys),
                      F.posexplode(F.split(F.col(f"`{text_col}`"), LINE_END)).alias("_at", "_line"))
    return lines.filter(F.trim("_line") != "").select(
        *(F.col(f"`{k}`") for k in keys), (F.col("_at") + 1).alias(position_col), F.col("_line").alias(line_col))


def csv_line(*columns: str, sep: str = ",") -> Column:
    """One CSV line of the columns; text with separators or quotes is quoted."""
    return F.to_csv(F.struct(*(F.col(f"`{c}`") for c in columns)), {"sep": sep})


def parse_csv(lines: DataFrame, schema: StructType | str | int, *, line_col: str = "value", sep: str = ",",
              header: bool = False, position_col: str | None = None, keep: Sequence[str] = (),
              corrupt_col: str | None = None, class_col: str | None = None) -> tuple[DataFrame, str]:
    """(frame, class column) of CSV lines; the class is the last column unless told otherwise.

    ``schema``: a schema, or a number of columns, which are then strings named ``_c0`` on.
    ``header``: lines whose ``position_col`` is 0 are their files' headers and are left out.
    ``keep``: columns of ``lines`` that stay before the parsed ones.
    ``corrupt_col``: holds the line where it doesn't fit the schema (then what didn't fit is
    null); without it such a line fails the job.
    """
    if isinstance(schema, int):
        schema = StructType([StructField(f"_c{i}", StringType()) for i in range(schema)])
    elif isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if header and position_col is None:
        raise ValueError("a header is told by its position: give position_col")
    names = schema.fieldNames()
    clash = sorted(set(names) & {*keep, corrupt_col} | ({corrupt_col} & set(keep)))
    if clash:
        raise ValueError(f"columns {clash} occur twice")
    rows, line = lines.filter(F.col(f"`{line_col}`").isNotNull()), F.col(f"`{line_col}`")
    if header:
        own = F.col(f"`{position_col}`") != 0
        # A header that is a literal would be parsed when the plan is made, before any filter.
        rows, line = rows.filter(own), F.when(own, line)
    wanted, options = schema, {"sep": sep, "mode": "FAILFAST"}
    if corrupt_col is not None:
        wanted = StructType([*schema.fields, StructField(corrupt_col, StringType())])
        options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt_col}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.fields)
    parsed = rows.select(*(F.col(f"`{k}`") for k in keep), F.from_csv(line, ddl, options).alias("_row"))
    columns = [F.col("_row").getField(n).alias(n) for n in wanted.fieldNames()]
    return parsed.select(*(F.col(f"`{k}`") for k in keep), *columns), class_col or names[-1]
