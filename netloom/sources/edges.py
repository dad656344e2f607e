"""Edge lists: delimited files, Parquet and tables, as records (seq, source, target, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.index import dense_index
from netloom.sources.mapping import HEAD_BYTES, Mapping, guess

#: What is a weight: a decimal number, infinity or not a number; Spark's casts take a trailing f or d too.
_WEIGHT = r"(?i)^[+-]?(\d+\.?\d*([e][+-]?\d+)?|\.\d+([e][+-]?\d+)?|inf|infinity|nan)$"


def weight_of(text: Column) -> Column:
    """A float, or null for what is no number."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(_WEIGHT), trimmed.try_cast("float"))


def beginning(lines: DataFrame, file: str) -> DataFrame:
    """The first lines of one of the files of ``lines`` (text as read), in their order; the others are not opened."""
    path = lambda c: F.regexp_replace(c, "^[^:/]+:/+", "")  # noqa: E731  inputFiles and _metadata write the scheme's slashes differently
    return lines.where((path(F.col("_metadata.file_path")) == path(F.lit(file))) & (F.col("_metadata.file_block_start") == 0)).limit(2000)


def guess_mapping(spark: SparkSession, path: str) -> Mapping:
    """What the beginning says, in the order of ``read_records``: that of the first file with a line that isn't blank. The first rows of a scan are no
    beginning, as a scan takes the largest files first."""
    lines, head = spark.read.text(path), []
    for file in sorted(lines.inputFiles()):
        head += [r["value"] for r in beginning(lines, file).collect()]
        if any(head):
            break
    return guess("\n".join(head)[: HEAD_BYTES + 1])


def read_records(spark: SparkSession, path: str, mapping: Mapping | None = None) -> tuple[DataFrame, DataFrame]:
    """Records (seq, source, target, weight) of a delimited file, and a row (rows, skipped). Rows without a source or target column, or with a
    weight that is no number, are skipped and counted.

    Lines are read with their file and place, so ``seq`` follows the files' order however they are split. Each line is split by one
    expression: fields in quotes may hold delimiters and doubled quotes. Where a line has an odd number of quotes, one at a field's begin, a field
    goes on in the next line, and the file is read by ``read_multiline``."""
    mapping = mapping or guess_mapping(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    opened = F.concat(F.lit(mapping.delimiter), "value").contains(mapping.delimiter + '"')
    if not spark.read.text(path).where((quotes % 2 == 1) & opened).isEmpty():
        return read_multiline(spark, path, mapping)
    # a blank line is none; carriage returns outside quotes vanish
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return _records(lines.where("line <> ''"), mapping, ["file", "block", "at"])


def split_fields(line: Column, delimiter: str) -> Column:
    """The fields of a line: quoted ones without their quotes, doubled quotes in them as one, what follows the quotes appended."""
    d = "\\" + delimiter if delimiter in "|^$.*+?()[]{}\\" else delimiter
    # a field begins at the line's begin or a delimiter
    raw = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(f'{d}("(?:[^"]|"")*"?[^{d}]*|[^{d}]*)'), F.lit(1))
    quoted = lambda x: F.concat(F.replace(F.regexp_extract(x, '^"((?:[^"]|"")*)"?', 1), F.lit('""'), F.lit('"')), F.regexp_extract(x, '^"(?:[^"]|"")*"?(.*)$', 1))
    return F.transform(raw, lambda x: F.when(x.startswith('"'), quoted(x)).otherwise(x))


def _records(lines: DataFrame, mapping: Mapping, order: list[str]) -> tuple[DataFrame, DataFrame]:
    split = dense_index(lines, order, "row").select("row", split_fields(F.col("line"), mapping.delimiter).alias("f"))
    split = split.where("row > 0") if mapping.header else split
    weight = F.lit(None).cast("float") if mapping.weight is None else weight_of(F.get("f", mapping.weight))
    rows = split.select("row", F.get("f", mapping.source).alias("source"), F.get("f", mapping.target).alias("target"), weight.alias("weight"))
    return _kept(rows, mapping)


def _kept(rows: DataFrame, mapping: Mapping) -> tuple[DataFrame, DataFrame]:
    ok = F.col("source").isNotNull() & F.col("target").isNotNull() & (F.lit(True) if mapping.weight is None else F.col("weight").isNotNull())
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~ok).alias("skipped"))
    return rows.where(ok).select(F.col("row").alias("seq"), "source", "target", "weight"), counts


def read_multiline(spark: SparkSession, path: str, mapping: Mapping) -> tuple[DataFrame, DataFrame]:
    """As ``read_records``, of files whose quoted fields hold line breaks, by Spark's reader: one task a file. Empty fields are null there, and
    such rows are skipped."""
    rows = spark.read.csv(path, sep=mapping.delimiter, header=mapping.header, quote='"', escape='"', multiLine=True, inferSchema=False)
    pick = lambda i: F.col("`" + rows.columns[i].replace("`", "``") + "`") if i < len(rows.columns) else F.lit(None).cast("string")
    weight = F.lit(None).cast("float") if mapping.weight is None else weight_of(pick(mapping.weight))
    out = rows.select(pick(mapping.source).alias("source"), pick(mapping.target).alias("target"), weight.alias("weight"), F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    return _kept(dense_index(out, ["_file", "_at"], "row"), mapping)


def _named(df: DataFrame, source: Column, target: Column, weight: Column | None, *more: Column) -> DataFrame:
    return df.select(source.cast("string").alias("source"), target.cast("string").alias("target"), (F.lit(None) if weight is None else weight).cast("double").alias("weight"), *more)


#: What makes a row of a table a record.
_VALID = "source is not null and target is not null"


def validity(df: DataFrame, source: Column, target: Column, weight: Column | None = None) -> DataFrame:
    """One row: n_rows of a table, how many of them ``from_table`` skips, and how many have a weight."""
    return _named(df, source, target, weight).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.expr(_VALID)).alias("skipped"), F.count("weight").alias("weighted"))


def unnumbered(df: DataFrame, source: Column, target: Column, weight: Column | None = None, order: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Records (source, target, weight and the columns that order them) from any table, and the names of these columns. Rows without a source or
    target are skipped (``validity`` counts them)."""
    valid = _named(df, source, target, weight, *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order or []))).where(_VALID)
    return valid, [f"_o{i}" for i in range(len(order or []))] or ["source", "target", "weight"]


def from_table(df: DataFrame, source: Column, target: Column, weight: Column | None = None, order: list[str] | None = None) -> DataFrame:
    """Records as ``unnumbered`` gives them; ``seq`` numbers them by ``order``."""
    return dense_index(*unnumbered(df, source, target, weight, order), "seq").select("seq", "source", "target", "weight")
