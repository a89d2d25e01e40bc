"""Reading and writing tables by file extension, with dialect and schema inference."""

from __future__ import annotations

import csv
import os
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows on which a schema is inferred, None for all of them; with a number, later values that do not fit become null.
INFER_ROWS: int | None = None
#: Bytes of a text file that the dialect is guessed from.
SNIFF_BYTES = 64 << 10
DELIMITERS = ",\t;|"
#: What a cell without anything, not even quotes, reads as before it becomes null; an empty cell in quotes is an empty text.
_ABSENT = "\x00absent\x00"


class FormatError(ValueError):
    """A path, extension or reader option that cannot be used."""


def extension(path: str) -> str:
    """Lower-case extension without the dot; a path without one raises."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    if not ext:
        raise FormatError(f"{path!r} has no extension")
    return ext


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _head(spark: SparkSession, path: str, n: int = SNIFF_BYTES) -> bytes:
    """The first bytes of a file, or of the first file of a folder, on any file system."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        raise FormatError(f"there is no {path}")
    if fs.getFileStatus(p).isDirectory():
        files = sorted(str(s.getPath()) for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", ".")))
        return _head(spark, files[0], n) if files else b""
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def sniff(sample: str, delimiter: str | None = None, quote: str | None = None) -> tuple[str, str]:
    """(delimiter, quote) of a text sample; given ones win, and comma and double quote stand where nothing can be told."""
    if delimiter is not None and len(delimiter.encode()) != 1:
        raise FormatError("a delimiter is exactly one byte")
    if quote is not None and not quote:
        raise FormatError("a quote must not be empty")
    if delimiter is None or quote is None:
        try:
            found = csv.Sniffer().sniff(sample, DELIMITERS)
            delimiter = delimiter or found.delimiter
            quote = quote or found.quotechar or '"'
        except csv.Error:
            first = sample.split("\n", 1)[0]
            counts = {d: first.count(d) for d in DELIMITERS}
            best = max(counts, key=lambda d: counts[d])
            delimiter = delimiter or (best if counts[best] else ",")
    return delimiter, quote or '"'


def _quoting(spark: SparkSession, path: str, delimiter: str, quote: str) -> tuple[bool, bool]:
    """(quoted, spanning): whether cells are quoted at all, and whether one may span lines; from one aggregate over all lines.

    A quote that never closes would swallow the rest of a file, so a file in which some line has an odd
    number of quotes but none ever opens a cell is read without quoting.
    """
    line = F.col("value")
    count = F.length(line) - F.length(F.replace(line, F.lit(quote), F.lit("")))
    opens = F.startswith(line, F.lit(quote)) | (F.instr(line, delimiter + quote) > 0)
    row = spark.read.text(path).agg(F.count_if(count % 2 == 1).alias("odd"), F.count_if((count > 0) & opens).alias("opens")).first()
    return not (row["odd"] and not row["opens"]), bool(row["odd"] and row["opens"])


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, quote: str | None = None, schema: T.StructType | None = None, rows: int | None = None, infer_rows: int | None = None) -> DataFrame:
    """Delimited text with a header. The schema is inferred on all rows (`infer_rows`: on the first ones only) and then fixed: long rows are cut, short ones filled with null, wrong values null.

    One look at all lines tells whether a quoted cell may span lines; only then is a file one task's
    work, all others are split among many. `rows` caps what is read, and what the schema is inferred on.
    """
    d, q = sniff(_head(spark, path).decode("utf-8", "replace"), delimiter, quote)
    quoted, spanning = _quoting(spark, path, d, q)
    base = {"header": True, "sep": d, "quote": q if quoted else "", "escape": q if quoted else "\\", "mode": "PERMISSIVE", "encoding": "UTF-8", "multiLine": spanning, "nullValue": _ABSENT}
    if schema is None:
        head = spark.read.options(**base).csv(path)
        most = min((n for n in (rows, infer_rows, INFER_ROWS) if n is not None), default=None)
        schema = _infer(head if most is None else head.limit(most))
    if len({f.name.lower() for f in schema.fields}) < len(schema.fields):
        raise FormatError("column names must differ in more than letter case")
    out = spark.read.options(**base).schema(schema).csv(path)
    return out.limit(rows) if rows is not None else out


def _infer(head: DataFrame) -> T.StructType:
    """Narrowest of bigint, double, boolean and string that holds every value of each column of a sample, from one aggregate."""
    names = head.columns
    kinds = [("bigint", T.LongType()), ("double", T.DoubleType()), ("boolean", T.BooleanType())]
    checks = []
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        # an empty cell in quotes tells no type
        c = F.nullif(c, F.lit(""))
        checks.append(F.count(c).alias(f"n{i}"))
        for k, (sql, _) in enumerate(kinds):
            good = c.try_cast(sql).isNotNull()
            if sql == "boolean":
                good = F.lower(F.trim(c)).isin("true", "false")
            elif sql == "bigint":
                good = good & F.regexp_like(F.trim(c), F.lit("^[+-]?[0-9]+$"))
            checks.append(F.count_if(c.isNotNull() & ~good).alias(f"b{i}_{k}"))
    row = head.agg(*checks).first() if names else None
    fields = []
    for i, n in enumerate(names):
        kind: T.DataType = T.StringType()
        if row[f"n{i}"]:
            kind = next((t for k, (_, t) in enumerate(kinds) if not row[f"b{i}_{k}"]), T.StringType())
        fields.append(T.StructField(n, kind, True))
    return T.StructType(fields)


def read_json_lines(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """One JSON object per line; the schema holds every field of every line (of the first `rows` where that is set)."""
    most = min((n for n in (rows, INFER_ROWS) if n is not None), default=None)
    if most is None:
        return spark.read.json(path)
    sample = spark.read.text(path).limit(most)
    schema = spark.read.json(sample.rdd.map(lambda r: r[0])).schema if sample.head(1) else T.StructType([])
    out = spark.read.schema(schema).json(path)
    return out.limit(rows) if rows is not None else out


def read_json(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """A JSON array of objects, or JSON lines if the file does not begin with one."""
    if _head(spark, path, 64).lstrip(b"\xef\xbb\xbf \t\r\n")[:1] != b"[":
        return read_json_lines(spark, path, rows)
    out = spark.read.json(path, multiLine=True)
    return out.limit(rows) if rows is not None else out


def _files_of(spark: SparkSession, path: str, suffix: str) -> list[str]:
    """The file itself, or the files of a folder that end in `suffix`, in order."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        raise FormatError(f"there is no {path}")
    if not fs.getFileStatus(p).isDirectory():
        return [str(fs.makeQualified(p))]
    return sorted(str(s.getPath()) for s in fs.listStatus(p) if s.getPath().getName().lower().endswith(suffix))


def _arrow_source(uri: str):
    """(open input, close) of a file on any file system that Arrow knows."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(uri)
    return system.open_input_file(inner)


def _arrow_reader(source):
    """Reader of an Arrow file, or of an Arrow stream: (schema, iterator of batches)."""
    import pyarrow as pa

    try:
        f = pa.ipc.open_file(source)
        return f.schema, (f.get_batch(i) for i in range(f.num_record_batches))
    except pa.ArrowInvalid:
        source.seek(0)
        s = pa.ipc.open_stream(source)
        return s.schema, iter(s)


def read_arrow(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """An Arrow IPC file or stream, or a folder of them: a task per file, which holds one batch at a time; the driver reads only a schema.

    All files must have the schema of the first.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    found = _files_of(spark, path, ".arrow")
    if not found:
        raise FormatError(f"there is no Arrow file at {path}")
    with _arrow_source(found[0]) as source:
        schema = from_arrow_schema(_arrow_reader(source)[0])

    def load(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for uri in p.column(0).to_pylist():
                with _arrow_source(uri) as source:
                    yield from _arrow_reader(source)[1]

    listed = spark.createDataFrame([(x,) for x in found], "uri string").repartition(min(len(found), 10_000), "uri")
    out = listed.mapInArrow(load, schema)
    return out.limit(rows) if rows is not None else out


def read_df(spark: SparkSession, path: str, rows: int | None = None, delimiter: str | None = None, quote: str | None = None) -> DataFrame:
    """A table by its extension: csv, data, tsv, json, jsonl, ndjson, parquet, arrow. `rows` caps what is read."""
    ext = extension(path)
    if ext in ("csv", "data"):
        return read_csv(spark, path, delimiter, quote, rows=rows)
    if ext == "tsv":
        return read_csv(spark, path, "\t", quote, rows=rows)
    if ext in ("jsonl", "ndjson"):
        return read_json_lines(spark, path, rows)
    if ext == "json":
        return read_json(spark, path, rows)
    if ext == "parquet":
        out = spark.read.parquet(path)
        return out.limit(rows) if rows is not None else out
    if ext == "arrow":
        return read_arrow(spark, path, rows)
    raise FormatError(f"no reader for .{ext}")


def parse_json_rows(spark: SparkSession, text: str, schema: T.StructType | None = None) -> DataFrame:
    """A table from JSON lines in a text; `{}` alone is an empty table."""
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines or lines == ["{}"]:
        return spark.createDataFrame([], schema or T.StructType([]))
    raw = spark.createDataFrame([(x,) for x in lines], "j string")
    if schema is None:
        schema = spark.read.json(raw.rdd.map(lambda r: r[0])).schema
    return raw.select(F.from_json("j", schema).alias("r")).select("r.*")


def frame_from_view(spark: SparkSession, rows: Sequence[dict], fields: Sequence[tuple[str, str]]) -> DataFrame:
    """A table from the rows of a JSON view, columns in the order of `fields` (name, type name) and of their types.

    Without rows all columns are text, as nothing tells their values; names that a row lacks are null, others are left out.
    """
    import json

    from quern.functions.types import from_name

    if not rows:
        return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n, _ in fields]))
    schema = T.StructType([T.StructField(n, from_name(t)) for n, t in fields])
    return parse_json_rows(spark, "\n".join(json.dumps(r, ensure_ascii=True) for r in rows), schema)


def cloud_settings(bucket: str, region: str | None = None, endpoint: str | None = None, path_style: bool | None = None) -> dict[str, str]:
    """Hadoop settings of one S3 bucket, for `use_cloud`: its region and endpoint; an endpoint of its own is spoken to by path unless told otherwise."""
    if not bucket or "/" in bucket:
        raise FormatError(f"{bucket!r} is no bucket")
    own = f"fs.s3a.bucket.{bucket}."
    out = {}
    if region:
        out[own + "endpoint.region"] = region
    if endpoint:
        out[own + "endpoint"] = endpoint
        out[own + "connection.ssl.enabled"] = str(not endpoint.startswith("http://")).lower()
    if path_style or path_style is None and endpoint:
        out[own + "path.style.access"] = "true"
    return out


def use_cloud(spark: SparkSession, bucket: str, region: str | None = None, endpoint: str | None = None, path_style: bool | None = None) -> None:
    """Let `read_df` and `write_df` reach `s3a://bucket/...`; all formats are read there as anywhere, the dialect of a text from its first 64 KiB."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for k, v in cloud_settings(bucket, region, endpoint, path_style).items():
        conf.set(k, v)


def import_zip(spark: SparkSession, archive: str, folder: str) -> list[str]:
    """Unpack an archive into a folder, entry by entry through streams; returns the paths written, relative to it.

    Entries that would lie outside the folder (absolute, `..`, drive letters) raise before anything is
    written; folders and the helpers of file managers are left out.
    """
    jvm = spark.sparkContext._jvm
    p, fs = _fs(spark, archive)

    def entries():
        stream = jvm.java.util.zip.ZipInputStream(fs.open(p))
        try:
            while (entry := stream.getNextEntry()) is not None:
                name = entry.getName().replace("\\", "/")
                if not entry.isDirectory() and not name.startswith("__MACOSX/") and name.rpartition("/")[2] not in (".DS_Store", "Thumbs.db"):
                    yield name, stream
        finally:
            stream.close()

    names = []
    for name, _ in entries():
        if name.startswith("/") or ":" in name or ".." in name.split("/") or not name:
            raise FormatError(f"{name!r} leads out of the folder")
        names.append(name)
    for name, stream in entries():
        target, to = _fs(spark, f"{folder.rstrip('/')}/{name}")
        out = to.create(target, True)
        try:
            jvm.org.apache.commons.io.IOUtils.copy(stream, out)
        finally:
            out.close()
    return names


def listing(spark: SparkSession, folder: str, recursive: bool = True, extra: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """`file_path` (relative to the folder) of its files, with extra columns (name, type name) of nulls."""
    from quern.functions.types import from_name

    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path")
    root = _fs(spark, folder)[0].toUri().getPath().rstrip("/") + "/"
    out = files.select(F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*(?=/)", ""), "^\\Q" + root + "\\E", "").alias("file_path"))
    return out.select("file_path", *[F.lit(None).cast(from_name(t)).alias(n) for n, t in extra])


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text and void ones as strings, for text formats."""
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def _replace(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file over another in one step: a reader sees the old file or the new one."""
    jvm = spark.sparkContext._jvm
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kinds, 1)
    how[0] = kinds.OVERWRITE
    a, fs = _fs(spark, source)
    b = fs.makeQualified(_fs(spark, target)[0])
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(a), b, how)


def _replace_folder(spark: SparkSession, source: str, target: str) -> None:
    """Put a folder in the place of another. Two renames: in between a reader may find nothing, but no rows are ever lost, and a failure puts the old folder back."""
    p, fs = _fs(spark, target)
    aside = _fs(spark, f"{target.rstrip('/')}.{uuid.uuid4().hex}.old")[0]
    moved = fs.exists(p)
    if moved and not fs.rename(p, aside):
        raise FormatError(f"cannot replace {target}")
    if not fs.rename(_fs(spark, source)[0], p):
        if moved:
            fs.rename(aside, p)
        raise FormatError(f"cannot write {target}")
    if moved:
        fs.delete(aside, True)


def write_df(df: DataFrame, path: str, single: bool = True) -> str:
    """Write a table by its extension; returns the path.

    With `single` one file appears at `path` by one rename once it is complete, so readers see the old
    file or the new one. Without it `path` becomes a folder written by all tasks (see `_replace_folder`).
    Works on any file system of the cluster; nothing passes through the driver or a machine's own disk.
    """
    ext = extension(path)
    spark = df.sparkSession
    if ext not in ("csv", "data", "tsv", "json", "jsonl", "ndjson", "parquet", "arrow"):
        raise FormatError(f"no writer for .{ext}")
    tmp = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    body = df.coalesce(1) if single else df
    if ext in ("csv", "data", "tsv"):
        _flat(body).write.options(header=True, sep="\t" if ext == "tsv" else ",", quote='"', escape='"', emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(tmp)
    elif ext == "parquet":
        body.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(f"`{f.name}`") for f in df.schema.fields]).write.parquet(tmp)
    elif ext == "json" and single:
        # records behind each other with commas; the brackets are put around them below
        body.write.options(ignoreNullFields="false", lineSep=",").json(tmp)
    elif ext in ("json", "jsonl", "ndjson"):
        body.write.option("ignoreNullFields", "false").json(tmp)
    else:
        _write_arrow(body, tmp)
    p, fs = _fs(spark, tmp)
    if not single:
        _replace_folder(spark, tmp, path)
        return path
    part = next((str(s.getPath()) for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")), None)
    if ext == "json":
        part = _bracketed(spark, part, f"{tmp}/array")
    _replace(spark, part, path)
    fs.delete(p, True)
    return path


def _bracketed(spark: SparkSession, part: str | None, target: str) -> str:
    """`part`, records that each end in a comma, as one JSON array; copied by streams of the file system."""
    to, fs = _fs(spark, target)
    out = fs.create(to, True)
    try:
        out.write(bytearray(b"["))
        if part is not None:
            p = _fs(spark, part)[0]
            size = fs.getFileStatus(p).getLen() - 1
            if size > 0:
                src = fs.open(p)
                try:
                    spark.sparkContext._jvm.org.apache.commons.io.IOUtils.copyLarge(src, out, 0, size)
                finally:
                    src.close()
        out.write(bytearray(b"]"))
    finally:
        out.close()
    return target


def _write_arrow(df: DataFrame, folder: str) -> None:
    """Each partition as an Arrow file `part-n.arrow` of a new folder, written batch by batch by its task."""
    import pyarrow as pa
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    schema = to_arrow_schema(df.schema)
    p, fs = _fs(spark, folder)
    fs.mkdirs(p)
    uri = str(fs.makeQualified(p))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as arrow_fs

        context = TaskContext.get()
        system, inner = arrow_fs.FileSystem.from_uri(uri)
        # an attempt writes a file of its own, so a repeated task never meets half of another
        name = f"{inner}/.{context.partitionId()}-{context.taskAttemptId()}"
        with system.open_output_stream(name) as sink, pa.ipc.new_file(sink, schema) as w:
            for b in batches:
                w.write_batch(pa.RecordBatch.from_arrays([b.column(i).cast(schema.field(i).type) for i in range(len(schema))], schema=schema))
        yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int32()), pa.array([name.rpartition("/")[2]])], ["part", "name"])

    written = df.mapInArrow(save, "part int, name string").collect()
    for r in written:
        fs.rename(_fs(spark, f"{folder}/{r['name']}")[0], _fs(spark, f"{folder}/part-{r['part']:05d}.arrow")[0])
    if not written:
        # a table without partitions still has a schema
        import pyarrow.fs as arrow_fs

        system, inner = arrow_fs.FileSystem.from_uri(uri)
        with system.open_output_stream(f"{inner}/part-00000.arrow") as sink, pa.ipc.new_file(sink, schema):
            pass
    for s in fs.listStatus(p):
        if s.getPath().getName().startswith("."):
            fs.delete(s.getPath(), False)


def json_view(df: DataFrame) -> DataFrame:
    """One column `row`: each row as a JSON object, nulls kept; binary columns as text, or `[binary]` throughout where any value is not UTF-8."""
    cols = []
    binary = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BinaryType)]
    bad = set()
    if binary:
        row = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & ~F.is_valid_utf8(F.col(f"`{c}`").cast("string"))).alias(f"b{i}") for i, c in enumerate(binary)]).first()
        bad = {c for i, c in enumerate(binary) if row[f"b{i}"]}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cols.append((F.when(c.isNotNull(), F.lit("[binary]")) if f.name in bad else c.cast("string") if f.name in binary else c).alias(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("row"))


def schema_text(df: DataFrame) -> str:
    """Flat form of a schema: `a:str,b:i64`."""
    from quern.functions.types import to_name

    return ",".join(f"{f.name}:{to_name(f.dataType, f.metadata)}" for f in df.schema.fields)
