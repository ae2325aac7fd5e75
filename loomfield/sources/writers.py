"""Writers: JSON, NDJSON, CSV, workbooks and several formats at once."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.operators.records import FieldRule, export_columns, flatten, validate
from loomfield.session import ensure_checkpoint_dir
from loomfield.sources.documents import make_xlsx, parse_xlsx

#: Rows a workbook may hold; results beyond are an error, not cut.
WORKBOOK_ROWS = 1_000_000


def write_ndjson(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str, append: bool = False, null_text: str = "") -> None:
    """Nested fields flattened, columns in alphabetical order; appending takes the order of the files there."""
    flat = export_columns(flatten(df), null_text)
    if append:
        there = df.sparkSession.read.csv(path, header=True).columns
        flat = flat.select(*[F.col(c) if c in flat.columns else F.lit("").alias(c) for c in there])
    flat.write.mode("append" if append else "overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def _files(spark: SparkSession, path: str):
    """(file system, path) in any store that Spark writes."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _files(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_document(df: DataFrame, path: str, head: str | Callable[[int], str] = "[", tail: str = "]", order: Sequence[str] = (), pretty: bool = False) -> int:
    """One JSON document in parts: head, the rows as objects with commas between, tail; returns the number of rows.

    Every task writes a part of its own rows.  The rows of each partition are counted first, so that the first part
    with rows begins with the head (which may tell the number of rows) and the last one ends with the tail; parts
    in the order of their names are the document, for join_parts() or read_document().  ``order`` sorts rows over all parts.
    Nulls are kept, characters stand as they are."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    rows = df.orderBy(*order) if order else df
    rows = rows.select(F.to_json(F.struct(*df.columns), {"pretty": str(pretty).lower(), "ignoreNullFields": "false"}).alias("value")).checkpoint()
    counts = {r.part: r.n for r in rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()}  # a row a partition
    total = sum(counts.values())
    top = head(total) if callable(head) else head
    first, last = (min(counts), max(counts)) if counts else (0, 0)

    def run(batches):
        part = TaskContext.get().partitionId()
        lead = [top] if part == first else []
        comma = "" if part == first else ","
        for b in batches:
            lines = lead
            for v in b.column(0).to_pylist():
                lines.append(comma + v)
                comma = ","
            lead = []
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines)], ["value"])
        if part == last:
            yield pa.RecordBatch.from_arrays([pa.array([tail])], ["value"])

    if counts:
        rows.mapInArrow(run, "value string").write.mode("overwrite").text(path)
    else:
        spark.createDataFrame([(top + tail,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    _put(spark, f"{path}/document.json", json.dumps({"head": top, "tail": tail, "rows": total}).encode())
    return total


def join_parts(spark: SparkSession, path: str, target: str) -> None:
    """The parts of a folder as one file, in the order of their names.  The file systems' bytes are copied by the
    driver; no row is looked at."""
    fs, p = _files(spark, path)
    to, q = _files(spark, target)
    jvm = spark.sparkContext._jvm
    out = to.create(q, True)
    try:
        for name in sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")):
            part = fs.open(jvm.org.apache.hadoop.fs.Path(p, name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
            finally:
                part.close()
    finally:
        out.close()


def write_json_array(df: DataFrame, path: str, pretty: bool = True) -> None:
    """One JSON array in one file of a folder, which any reader of JSON takes: written in parts by all tasks, whose
    bytes are then joined."""
    spark = df.sparkSession
    write_document(df, f"{path}/_parts", pretty=pretty)
    join_parts(spark, f"{path}/_parts", f"{path}/part-00000.json")
    fs, p = _files(spark, f"{path}/_parts")
    fs.delete(p, True)


def write_envelope(df: DataFrame, path: str, source: str, url: str, scrape_time: str, order: Sequence[str] = ()) -> int:
    """A document {metadata, data} of any number of rows, in parts; the metadata has the number of rows."""
    meta = lambda n: {"source": source, "scrape_time": scrape_time, "url": url, "record_count": n, "format_version": "1.0"}
    return write_document(df, path, lambda n: json.dumps({"metadata": meta(n)}, ensure_ascii=False, separators=(",", ":"))[:-1] + ',"data":[', "]}", order)


def write_validated(df: DataFrame, path: str, schema: Mapping[str, FieldRule], order: Sequence[str] = ()) -> int:
    """A document {count, schema, data} of the rows that fit a schema, in parts."""
    types = json.dumps({n: r.type for n, r in schema.items()}, separators=(",", ":"))
    return write_document(validate(df, schema).select(*schema), path, lambda n: f'{{"count":{n},"schema":{types},"data":[', "]}", order)


def _sheet(df: DataFrame) -> list[list]:
    flat = flatten(df)
    if (n := flat.limit(WORKBOOK_ROWS + 1).count()) > WORKBOOK_ROWS:
        raise ValueError(f"a sheet holds {WORKBOOK_ROWS} rows at most, this result has {n} or more")
    return [flat.columns, *map(list, flat.toLocalIterator(prefetchPartitions=True))]


def files_of(df: DataFrame, make: Callable[[list[str], list[tuple]], bytes], suffix: str, rows: int = 10_000) -> DataFrame:
    """(path, content): files of ``rows`` rows at most, made side by side by the tasks that have the rows; none goes
    through the driver.  make(columns, rows) gives a file's bytes.  Paths are numbered by task."""
    columns = df.columns

    def run(batches):
        part, n, held = TaskContext.get().partitionId(), 0, []

        def flush():
            nonlocal n, held
            out = pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{n:05d}{suffix}"]), pa.array([make(columns, held)], pa.binary())], ["path", "content"])
            n, held = n + 1, []
            return out

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                held.append(row)
                if len(held) == rows:
                    yield flush()
        if held:
            yield flush()

    return df.mapInArrow(run, "path string, content binary")


def workbook_files(df: DataFrame, sheet: str = "data", rows: int = 10_000) -> DataFrame:
    """(path, content) of workbooks with a header row each; nested fields flattened."""
    return files_of(flatten(df), lambda columns, held: make_xlsx({sheet: [columns, *map(list, held)]}), ".xlsx", rows)


def sqlite_files(df: DataFrame, name: str, rows: int = 100_000) -> DataFrame:
    """(path, content) of SQLite files with one table of df's columns; values other than numbers and texts as text."""

    def make(columns: list[str], held: list[tuple]) -> bytes:
        con = sqlite3.connect(":memory:")
        quoted = ['"' + c.replace('"', '""') + '"' for c in (name, *columns)]
        try:
            con.execute(f"CREATE TABLE {quoted[0]} ({', '.join(quoted[1:])})")
            plain = ([v if v is None or isinstance(v, int | float | str | bytes) else str(v) for v in row] for row in held)
            con.executemany(f"INSERT INTO {quoted[0]} VALUES ({', '.join('?' * len(columns))})", plain)
            con.commit()
            return con.serialize()
        finally:
            con.close()

    return files_of(df, make, ".db", rows)


def workbook(df: DataFrame | Mapping[str, DataFrame], sheet: str = "data", append_to: bytes | None = None) -> bytes:
    """Bounded results as sheets with a header row; lists and structs as JSON or joined text.  Several are given by
    sheet names; append_to: a workbook whose other sheets are kept, as text."""
    sheets: dict[str, list] = {}
    for name, row, cells in parse_xlsx(append_to) if append_to else ():
        held = sheets.setdefault(name, [])
        held.extend([] for _ in range(row - len(held)))
        held.append(cells)
    for name, part in (df if isinstance(df, Mapping) else {sheet: df}).items():
        sheets[name] = _sheet(part)
    return make_xlsx(sheets)


def workbook_with_summary(df: DataFrame, sheet: str = "data") -> bytes:
    """A workbook with the rows and a sheet of numbers about them: rows, columns, and filled values by column."""
    flat = flatten(df)
    got = flat.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"f{i}") for i, c in enumerate(flat.columns)]).first()
    summary = [["metric", "value"], ["rows", got["n"]], ["columns", len(flat.columns)], *[[f"filled {c}", got[f"f{i}"]] for i, c in enumerate(flat.columns)]]
    return make_xlsx({sheet: _sheet(df), "summary": summary})


def write_workbook(df: DataFrame, path: str) -> None:
    """A workbook as one file in any store that Spark writes."""
    _put(df.sparkSession, path, workbook(df))


def write_workbooks(df: DataFrame, path: str, rows: int = 10_000) -> None:
    """A folder of workbooks of ``rows`` rows at most, made and written by the tasks that have the rows, so that a
    result of any size fits.

    Spark's text writer ends each file with a line break; the workbook, a zip file, declares it as its comment.  The
    driver only renames the files."""
    spark = df.sparkSession

    def lined(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([d[:-2] + b"\1\0" for d in b.column(0).to_pylist()], pa.binary())], ["content"])

    files = workbook_files(df, rows=rows).select("content").mapInArrow(lined, "content binary")
    files.select(F.col("content").cast("string").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    fs, p = _files(spark, path)
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith("part-"):
            if s.getLen():
                fs.rename(s.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, name.removesuffix(".txt") + ".xlsx"))
            else:  # a task without rows
                fs.delete(s.getPath(), False)


def write_everywhere(df: DataFrame, paths: Sequence[str], write: Callable[[DataFrame, str], None] = write_parquet) -> dict[str, str | None]:
    """The same rows to several stores; each path with None, or with the error of a store that failed, which doesn't
    keep the others from their copies.  The rows are computed once."""
    held, out = df.persist(), {}
    try:
        for p in paths:
            try:
                write(held, p)
                out[p] = None
            except Exception as e:
                out[p] = f"{type(e).__name__}: {e}".splitlines()[0]
        return out
    finally:
        held.unpersist()


WRITERS: dict[str, Callable[[DataFrame, str], None]] = {"json": write_json_array, "ndjson": write_ndjson, "csv": write_csv, "parquet": write_parquet, "xlsx": write_workbooks}


def write_all(df: DataFrame, base: str, formats: Sequence[str]) -> dict[str, str]:
    """Each format under base; the rows are computed once."""
    held = df.persist()
    try:
        paths = {f: f"{base}/{f}" for f in formats}
        for f, p in paths.items():
            WRITERS[f](held, p)
        return paths
    finally:
        held.unpersist()
