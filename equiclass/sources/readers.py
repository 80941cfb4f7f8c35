"""Sources: CSV tables and labelled-vector text lines.

- ``read_table``: CSV with or without header, all strings or inferred / explicit types,
  one path or a list of paths (a path listed twice is read twice); the class column
  defaults to the last column.
- ``read_lines``: text lines, blank ones dropped.
- ``parse_labeled_vectors``: ``label idx:value idx:value ...`` lines -> label, sparse
  (indices, values) and, with ``size``, a dense array<double>; native functions only.
- ``format_labeled_vectors``: the inverse, a dense vector back to such a line.
- ``read_libsvm``: the same lines with numeric labels through Spark's ``libsvm`` source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.vectors import let, sparse_to_dense


def read_table(spark: SparkSession, paths: str | Sequence[str], header: bool = False,
               infer: bool = False, schema: StructType | str | None = None,
               class_col: str | None = None, sep: str = ",") -> tuple[DataFrame, str]:
    """Read CSV; returns (frame, class column). Without a header columns are ``_c0.._cN``."""
    reader = spark.read.option("header", str(header).lower()).option("sep", sep)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", str(infer).lower())
    src = [paths] if isinstance(paths, str) else list(paths)
    df = reader.csv(src)
    return df, class_col or df.columns[-1]


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per non-blank line, column ``value``."""
    src = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.text(src)
    return df.filter(F.col("value").isNotNull() & (F.trim(F.col("value")) != ""))


def read_libsvm(spark: SparkSession, paths: str | Sequence[str], num_features: int | None = None,
                label_col: str = "label", features_col: str = "features") -> DataFrame:
    """Numeric-label ``label i:v ...`` lines through Spark's ``libsvm`` source (1-based
    indices): (label double, features as array<double>)."""
    from pyspark.ml.functions import vector_to_array

    reader = spark.read.format("libsvm")
    if num_features is not None:
        reader = reader.option("numFeatures", str(int(num_features)))
    src = [paths] if isinstance(paths, str) else list(paths)
    df = reader.load(src if len(src) > 1 else src[0])
    return df.select(F.col("label").alias(label_col),
                     vector_to_array(F.col("features")).alias(features_col))


def parse_labeled_vectors(df: DataFrame, value_col: str = "value", size: int | None = None,
                          index_base: int = 1, label_col: str = "label",
                          features_col: str = "features", errors: str = "raise",
                          error_col: str = "parse_error") -> DataFrame:
    """Parse ``label i:v i:v ...``; other columns pass through.

    Adds ``label_col`` (string), ``indices`` (array<int>, 0-based: token index minus
    ``index_base``), ``values`` (array<double>) and, with ``size``, the dense
    ``features_col``. Tokens are split on any run of whitespace. A token that isn't
    ``integer:number``, an index that occurs twice, or one outside ``size`` is an error: the
    job fails (``errors="raise"``), or with ``errors="column"`` the line keeps its label,
    gets null vectors and the reason in ``error_col`` (null on good lines).
    """
    if errors not in ("raise", "column"):
        raise ValueError("errors must be 'raise' or 'column'")
    top = F.lit(2 ** 31 - 1 if size is None else size)

    def entry(token: Column) -> Column:
        parts = F.split(token, ":")
        return F.when(F.size(parts) == 2, F.struct(
            (parts[0].try_cast("int") - F.lit(index_base)).alias("i"), parts[1].try_cast("double").alias("v")))

    def checked(tokens: Column, pairs: Column) -> Column:
        bad = F.filter(F.arrays_zip(tokens.alias("t"), pairs.alias("p")), lambda z: z["p"]["i"].isNull()
                       | z["p"]["v"].isNull())
        indices = F.transform(pairs, lambda p: p["i"])
        reason = (F.when(F.size(bad) > 0, F.concat(F.lit("malformed token "), bad[0]["t"]))
                  .when(F.size(F.array_distinct(indices)) < F.size(indices), F.lit("index given twice"))
                  .when(F.exists(indices, lambda i: (i < 0) | (i >= top)), F.lit("index out of range")))
        return F.struct(reason.alias("reason"), indices.alias("indices"),
                        F.transform(pairs, lambda p: p["v"]).alias("values"))

    def parsed(tokens: Column) -> Column:
        rest = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
        return let(rest, lambda r: let(F.transform(r, entry), lambda pairs: F.struct(
            tokens[0].alias("label"), checked(r, pairs).alias("body"))))

    tokens = F.split(F.trim(F.col(value_col)), r"\s+")
    out = df.withColumn("_ec_parsed", let(tokens, parsed))
    reason = F.col("_ec_parsed.body.reason")
    good = reason.isNull()
    if errors == "raise":
        line = F.concat(reason, F.lit(" in line: "), F.substring(F.col(value_col), 1, 200))
        stop = F.raise_error(line)
    else:
        stop = F.lit(None)
    out = (out.withColumn("indices", F.when(good, F.col("_ec_parsed.body.indices")).otherwise(
                stop.cast("array<int>") if errors == "column" else stop))
           .withColumn("values", F.when(good, F.col("_ec_parsed.body.values")).otherwise(
                stop.cast("array<double>") if errors == "column" else stop)))
    found = {label_col: F.col("_ec_parsed.label")}
    if errors == "column":
        found[error_col] = reason
    elif size is None:
        found[label_col] = F.when(good, found[label_col]).otherwise(stop)
    out = out.withColumns(found)
    if size is not None:
        out = out.withColumn(features_col, sparse_to_dense(size, "indices", "values"))
    keep = value_col in (label_col, features_col)
    return out.drop("_ec_parsed") if keep else out.drop("_ec_parsed", value_col)


def format_labeled_vectors(label: str | Column, vector: str | Column, index_base: int = 1,
                           skip_zeros: bool = True) -> Column:
    """``label i:v ...`` from a dense vector (zeros left out unless ``skip_zeros`` is False)."""
    lab = F.col(label) if isinstance(label, str) else label
    vec = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    tok = F.transform(vec, lambda v, i: F.when(
        (v != 0.0) | F.lit(not skip_zeros),
        F.concat(F.lit(""), (i + F.lit(index_base)).cast("string"), F.lit(":"), v.cast("string"))))
    return F.concat_ws(" ", lab.cast("string"), F.filter(tok, lambda t: t.isNotNull()))
