"""File sources: record lines, delimited files, listings, lineage."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowgate.contract import RAW_LINE
from rowgate.functions.scalar import file_stem
from rowgate.sources.scratch import files_of

#: The bytes in which code page 1252 differs from ISO 8859-1, which Spark reads.
_C1 = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}

LINE_OK, LINE_BAD = "OK", "PARSE_ERROR"


def text_lines(reader, path: str) -> DataFrame:
    """Text of a batch or stream reader with where it stood: ``raw_line``, ``source_file``, ``block``."""
    return reader.text(path).select(
        F.col("value").alias("raw_line"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("block")
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """``raw_line``, ``source_file``, ``source_line_no`` (of all lines, from 1), blank lines left out.

    Lines are numbered within the blocks that the reader cut the file into, and each block starts after the lines of
    those before it, so no task holds a whole file. A block's lines follow one another in one task, so a line's number in it is
    told by its place, and lines stay where they were read; only the blocks, a row each, come together.
    """
    placed = lines.withColumn("at", F.monotonically_increasing_id())
    before = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("source_file", "block").agg(F.count("*").alias("lines"), F.min("at").alias("first"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("lines").over(before), F.lit(0))).drop("lines")
    numbered = placed.join(F.broadcast(blocks), ["source_file", "block"]).filter(F.trim("raw_line") != "")
    return numbered.select("raw_line", "source_file", (F.col("at") - F.col("first") + 1 + F.col("before")).cast("long").alias("source_line_no"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return number_lines(text_lines(spark.read, path))


def parse_json_lines(lines: DataFrame, schema: T.StructType = RAW_LINE) -> DataFrame:
    """The fields of each line, all text, with ``parse_status`` and ``parse_error``.

    A line that isn't JSON, or is JSON but no object, is PARSE_ERROR; keys outside the schema
    are left to ``raw_line``.
    """
    variant = F.try_parse_json("raw_line")
    error = F.when(variant.isNull(), "invalid json line").when(
        ~F.schema_of_variant(variant).startswith("OBJECT"), "json not an object"
    )
    marked = lines.withColumn("parse_error", error)
    data = F.when(F.col("parse_error").isNull(), F.from_json("raw_line", schema))
    return marked.withColumn("__d", data).select(
        *(F.col("__d")[f.name].alias(f.name) for f in schema.fields),
        *lines.columns,
        F.when(F.col("parse_error").isNull(), LINE_OK).otherwise(LINE_BAD).alias("parse_status"),
        "parse_error",
    )


def read_ndjson(spark: SparkSession, path: str, on_bad_line: str = "line") -> DataFrame:
    """Record lines from files. ``on_bad_line="fail_file"`` marks every line of a file with a bad one READER_FAILURE."""
    parsed = parse_json_lines(read_lines(spark, path))
    if on_bad_line == "fail_file":
        parsed = fail_files(parsed)
    return parsed


def fail_files(parsed: DataFrame) -> DataFrame:
    """Every line of a file that has a bad one is READER_FAILURE."""
    bad = parsed.filter(F.col("parse_error").isNotNull()).select("source_file", F.lit(True).alias("__bad")).distinct()
    status = F.when(F.col("__bad"), "READER_FAILURE").otherwise(F.col("parse_status"))
    return parsed.join(bad, "source_file", "left").withColumn("parse_status", status).drop("__bad")


def read_delimited(
    spark: SparkSession,
    path: str,
    columns: list[tuple[str, str]],
    sep: str = ",",
    header_rows: int = 0,
    encoding: str = "UTF-8",
    qualifier: str | None = None,
    row_end: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows of a delimited file with the declared (name, DDL type) columns, and its malformed rows.

    The first ``header_rows`` lines of each file that aren't empty are left out.
    """
    ddl = ", ".join(f"{n} {t}" for n, t in columns) + ", _corrupt_record string"
    paged = encoding.lower() in ("windows-1252", "cp1252", "1252")
    reader = spark.read.schema(ddl).option("sep", sep).option("header", header_rows == 1)
    reader = reader.option("encoding", "iso-8859-1" if paged else encoding)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    reader = reader.option("quote", qualifier if qualifier else "")
    if row_end and row_end not in ("\n", "\r\n"):
        reader = reader.option("lineSep", row_end)
    rows = reader.csv(path)
    if header_rows > 1:
        rows = _without_first(rows, header_rows)
    if paged:
        texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
        rows = rows.withColumns({c: F.translate(c, "".join(_C1), "".join(_C1.values())) for c in texts})
    names = [n for n, _ in columns]
    # a row is malformed by any of its columns, so each is read whatever is asked for; the length is always 0 or more
    whole = F.length(F.concat_ws("", *(F.col(n).cast("string") for n in names))) >= 0
    good = rows.filter(whole & F.col("_corrupt_record").isNull()).select(*names)
    return good, rows.filter(whole & F.col("_corrupt_record").isNotNull())


def _without_first(rows: DataFrame, n: int) -> DataFrame:
    """A file reader's rows without the first ``n`` of each file.

    A file starts with its first block, whose rows follow one another in one task; so its first rows are told by their place in that.
    """
    places = {"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__at": F.monotonically_increasing_id()}
    placed = rows.withColumns(places)
    first = placed.filter("__block = 0").groupBy("__file").agg(F.min("__at").alias("__first"))
    header = (F.col("__block") == 0) & (F.col("__at") < F.col("__first") + n)
    return placed.join(first, "__file", "left").filter(~F.coalesce(header, F.lit(False))).select(*rows.columns)


def plain(delimiter: str) -> str:
    """A delimiter as it stands in a connection's description: ``_x000D_`` and the like are characters by their code."""
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), delimiter)


def read_flat_file(
    spark: SparkSession, path: str, columns: list[tuple[str, str, str]], row_end: str = "", header_rows: int = 0, code_page: int = 65001, qualifier: str = ""
) -> tuple[DataFrame, DataFrame]:
    """Rows of a flat file by its description, (name, type, delimiter) for each column, and its malformed rows (``_corrupt_record``).

    Without ``row_end`` the last column's delimiter ends a row, whatever the description says elsewhere; with neither, a line break does. Columns may
    each end in a delimiter of their own, in UTF-8 files without a qualifier. ``<none>`` is no qualifier. There is a header only if rows are to be skipped.
    """
    ends = [plain(d) for _, _, d in columns]
    end = plain(row_end) or ends[-1] or "\n"
    quote = "" if plain(qualifier) == "<none>" else plain(qualifier)
    named, body = [(n, t) for n, t, _ in columns], [d or "," for d in ends[:-1]]
    if len(set(body)) <= 1:
        encoding = "windows-1252" if code_page == 1252 else "UTF-8"
        return read_delimited(spark, path, named, body[0] if body else ",", header_rows, encoding, quote or None, end)
    if quote or code_page == 1252:
        raise ValueError("columns with delimiters of their own are read without a qualifier, in UTF-8")
    lines = spark.read.option("lineSep", end).text(path)
    lines = _without_first(lines, header_rows) if header_rows else lines
    cut = split_columns(lines.filter("value <> ''"), [(n, d) for (n, _), d in zip(named, [*body, end], strict=True)], keep=True)
    typed = {n: F.col(n).try_cast(t) for n, t in named}
    wrong = ~F.col("__split")
    for n, value in typed.items():
        wrong = wrong | (value.isNull() & (F.col(n) != ""))
    marked = cut.withColumn("__wrong", wrong)
    good = marked.filter(~F.col("__wrong")).select(*(F.when(F.col(n) != "", v).alias(n) for n, v in typed.items()))
    return good, marked.filter("__wrong").select(*(v.alias(n) for n, v in typed.items()), F.col("value").alias("_corrupt_record"))


def split_columns(lines: DataFrame, columns: list[tuple[str, str]], line: str = "value", keep: bool = False) -> DataFrame:
    """Columns that each end in a delimiter of their own; (name, delimiter), the last one's ends the line.

    With ``keep`` also the line, and ``__split``, whether it has all the delimiters.
    """
    escaped = ["".join("\\" + c if not c.isalnum() else c for c in d) for _, d in columns[:-1]]
    pattern = "(?s)^" + "".join(f"(.*?){d}" for d in escaped) + "(.*)$"
    kept = [F.col(line), F.col(line).rlike(pattern).alias("__split")] if keep else []
    return lines.select(*(F.regexp_extract(line, pattern, i + 1).alias(n) for i, (n, _) in enumerate(columns)), *kept)


def list_files(spark: SparkSession, path: str, suffix: str | tuple[str, ...] = ".json") -> DataFrame:
    """``source_file``, ``bytes``, ``modified`` of a folder, empty files too, which no Spark reader returns.

    The listing comes from the file system that ``path`` names. A packed file (``.gz``) that holds nothing has 0 bytes.
    """
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    found = []
    for s in fs.listStatus(at):
        name = s.getPath().getName()
        if s.isFile() and name.endswith(suffix):
            size = int(s.getLen())
            if name.endswith(".gz") and 0 < size < 512 and _holds_nothing(sc._jvm, fs, s.getPath()):
                size = 0
            found.append((name, size, int(s.getModificationTime())))
    return spark.createDataFrame(sorted(found), "source_file string, bytes long, modified long")


def _holds_nothing(jvm, fs, at) -> bool:
    stream = fs.open(at)
    try:
        return jvm.java.util.zip.GZIPInputStream(stream).read() < 0
    except Py4JJavaError:  # no packed file
        return False
    finally:
        stream.close()


def pending(listing: DataFrame, ledger: DataFrame, as_of_ms: int | None = None, min_age_ms: int = 0) -> DataFrame:
    """Listed files that the ledger doesn't have, old enough, by name."""
    new = listing.join(ledger.select("source_file"), "source_file", "left_anti")
    if as_of_ms is not None:
        new = new.filter(F.col("modified") <= as_of_ms - min_age_ms)
    return new.orderBy("source_file")


def empty_files(listing: DataFrame) -> DataFrame:
    """Zero-byte files as failed ledger rows."""
    failed = {"status": F.lit("FAILED"), "error_text": F.lit("<empty file>")}
    return listing.filter("bytes = 0").withColumns(failed).drop("bytes")


def stamp(df: DataFrame, as_of: Column | None = None, source_file: str = "source_file") -> DataFrame:
    """Lineage: ``batch_id`` (the file's name without extension), ``ingest_ts``."""
    when = as_of if as_of is not None else F.current_timestamp()
    return df.withColumn("batch_id", file_stem(F.col(source_file))).withColumn("ingest_ts", when)


def dead_letters(spark: SparkSession, path: str, seen: DataFrame, most: int = 4000) -> DataFrame:
    """One READER_FAILURE row for each parked file that ``seen`` doesn't name, with its first ``most`` characters.

    The tasks read no more of a file than that, whatever its size and lines. Packed files (by their name, ``.gz`` say) are unpacked as far; one
    that can't be is shown as it is. ``path`` is a folder that all executors reach: a shared one,
    or an address that Arrow's file systems know.
    """
    at, _ = files_of(spark, path)
    uri = at.toUri()
    where = uri.getPath() if uri.getScheme() in (None, "file") else path.rstrip("/")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(where)
        for batch in batches:
            found = []
            for name in batch.column("source_file").to_pylist():
                try:
                    with fs.open_input_stream(f"{base}/{name}") as file:
                        head = file.read(4 * most)  # a character has four bytes at most
                except OSError:
                    with fs.open_input_stream(f"{base}/{name}", compression=None) as file:
                        head = file.read(4 * most)
                found.append(head)
            yield pa.RecordBatch.from_arrays([batch.column("source_file"), pa.array(found, pa.binary())], ["source_file", "head"])

    new = list_files(spark, path, "").select("source_file").join(seen.select("source_file"), "source_file", "left_anti")
    rows = new.mapInArrow(heads, "source_file string, head binary").withColumn("payload", F.substring(F.col("head").cast("string"), 1, most))
    shown = F.when(F.coalesce(F.trim("payload"), F.lit("")) == "", "<empty file>").otherwise(F.col("payload"))
    return rows.select("source_file", F.lit("READER_FAILURE").alias("reason"), shown.alias("raw_payload"))


def calendar(spark: SparkSession, first: str = "2020-01-01", last: str = "2026-12-31") -> DataFrame:
    """One row for each day, ``full_date``."""
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias("full_date"))
