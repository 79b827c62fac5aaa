"""Sources as DataFrames. Files of special formats are read whole by Spark's binary reader and parsed on executors.

Any path that Spark can read will do, and one file is one task's work; rows of a file are given out in batches.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import struct
import tarfile
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

BATCH = 4096


def _binary(spark: SparkSession, path: str, depth: int | None = None, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    if depth != 0:
        reader = reader.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def _entry(df: DataFrame) -> list:
    return [F.col("path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified")]


def list_folder(spark: SparkSession, path: str, depth: int = 0, pattern: str | None = None) -> DataFrame:
    """One row per file, without its bytes: the content column isn't read."""
    df = _binary(spark, path, depth, pattern)
    return df.select(*_entry(df))


def open_folder(spark: SparkSession, path: str, depth: int = 0, pattern: str | None = None) -> DataFrame:
    df = _binary(spark, path, depth, pattern)
    return df.select(*_entry(df), F.col("content").alias("bytes"))


def open_archive(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """One row per regular file in zip and tar archives, also gz and bz2."""

    def entries(raw: bytes):
        if zipfile.is_zipfile(io.BytesIO(raw)):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        yield i.filename, z.read(i)
            return
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            for m in t:
                if m.isfile():
                    yield m.name, t.extractfile(m).read()

    def run(iterator):
        for pdf in iterator:
            for at, raw in zip(pdf["path"], pdf["content"]):
                for name, data in entries(raw):
                    if pattern is None or fnmatch.fnmatch(name.rsplit("/", 1)[-1], pattern):
                        yield pd.DataFrame({"archive": [at], "entry": [name], "size": [len(data)], "bytes": [data]})

    return _binary(spark, path).select("path", "content").mapInPandas(run, "archive string, entry string, size long, bytes binary")


def open_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def open_json(spark: SparkSession, path: str) -> DataFrame:
    """A file whose root is an array of objects, or an object."""
    return spark.read.json(path, multiLine=True)


def open_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def open_csv(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Each line as an array of its fields, quotes taken off."""
    mark = delimiter or sniff(spark, path)[0]

    @F.pandas_udf("array<string>")
    def fields(s: pd.Series) -> pd.Series:
        return pd.Series(list(csv.reader(s.tolist(), delimiter=mark)))

    return spark.read.text(path).select(fields("value").alias("fields"))


def sniff(spark: SparkSession, path: str, lines: int = 50) -> tuple[str, bool]:
    """Delimiter and header of a CSV file by its first lines."""
    sample = "\n".join(r[0] for r in spark.read.text(path).limit(lines).collect())
    try:
        mark = csv.Sniffer().sniff(sample, ",;\t|").delimiter
    except csv.Error:
        mark = ","
    rows = list(csv.reader(sample.splitlines(), delimiter=mark))

    def number(x: str) -> bool:
        try:
            float(x)
            return True
        except ValueError:
            return False

    header = bool(rows) and not any(map(number, rows[0])) and (len(rows) < 2 or any(map(number, rows[1])) or len(set(rows[0])) == len(rows[0]))
    return mark, header


def open_csv_typed(spark: SparkSession, path: str, delimiter: str | None = None, header: bool | None = None, comment: str | None = None, null_token: str = "", skip_lines: int = 0) -> DataFrame:
    """Columns typed by a scan of the whole file; delimiter and header are found if not given."""
    mark, head = sniff(spark, path) if delimiter is None or header is None else (delimiter, header)
    options = {"sep": delimiter or mark, "header": head if header is None else header, "inferSchema": True, "nullValue": null_token, "quote": '"', "escape": '"'}
    if comment:
        options["comment"] = comment
    if not skip_lines:
        return spark.read.options(**options).csv(path)
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("i"))
    first = spark.read.text(path).limit(skip_lines).collect()  # the few lines that are passed over
    text = lines.where(~((F.col("i") < skip_lines) & F.col("value").isin([r[0] for r in first]))).select("value")
    return spark.read.options(**options).csv(text.rdd.map(lambda r: r[0]))


def read_csv(df: DataFrame, column: str, delimiter: str = ",") -> DataFrame:
    """Rows of fields from CSV bytes in a column."""

    def run(iterator):
        for pdf in iterator:
            for raw in pdf[column]:
                if raw is not None:
                    yield pd.DataFrame({"fields": list(csv.reader(io.StringIO(bytes(raw).decode("utf-8-sig")), delimiter=delimiter))})

    return df.select(column).mapInPandas(run, "fields array<string>")


def open_parquet_meta(spark: SparkSession, path: str) -> DataFrame:
    """Columns of a Parquet table and their types."""
    return _meta(spark, spark.read.parquet(path))


def _meta(spark: SparkSession, df: DataFrame) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString(), f.dataType.typeName() == "array", f.nullable) for f in df.schema]
    return spark.createDataFrame(rows, "column_name string, element_kind string, is_array boolean, nullable boolean")


def _arrow_schema(spark: SparkSession, path: str) -> pa.Schema:
    """Of the first file, parsed where the file is read; only the schema comes to the driver."""

    def run(iterator):
        for batch in iterator:
            for raw in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([_opened(raw.as_py()).schema.serialize().to_pybytes()])], ["schema"])

    first = _binary(spark, path).select("content").limit(1).mapInArrow(run, "schema binary").first()
    if first is None:
        raise FileNotFoundError(path)
    return pa.ipc.read_schema(pa.BufferReader(bytes(first[0])))


def _opened(raw: bytes):
    try:
        return pa.ipc.open_file(pa.BufferReader(raw))
    except pa.ArrowInvalid:
        return pa.ipc.open_stream(pa.BufferReader(raw))


def open_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files and streams (Feather version 2)."""
    schema = from_arrow_schema(_arrow_schema(spark, path))

    def run(iterator):
        for batch in iterator:
            for raw in batch.column(0):
                yield from _opened(raw.as_py()).read_all().to_batches(BATCH)

    return _binary(spark, path).select("content").mapInArrow(run, schema)


def open_arrow_meta(spark: SparkSession, path: str) -> DataFrame:
    schema = from_arrow_schema(_arrow_schema(spark, path))
    return _meta(spark, spark.createDataFrame([], schema))


def _idx(raw: bytes) -> np.ndarray:
    """The array of an IDX file: two zeros, a type, a rank, big-endian sizes, the values."""
    zero, kind, rank = struct.unpack(">HBB", raw[:4])
    types = {8: ">u1", 9: ">i1", 11: ">i2", 12: ">i4", 13: ">f4", 14: ">f8"}
    if zero or kind not in types:
        raise ValueError("not an IDX file")
    shape = struct.unpack(f">{rank}I", raw[4 : 4 + 4 * rank])
    return np.frombuffer(raw, types[kind], int(np.prod(shape)), 4 + 4 * rank).reshape(shape)


def open_idx_images(spark: SparkSession, path: str) -> DataFrame:
    """index, height, width and the pixels of each image."""

    def run(iterator):
        for pdf in iterator:
            for raw in pdf["content"]:
                a = _idx(raw)
                for i in range(0, len(a), BATCH):
                    part = a[i : i + BATCH]
                    yield pd.DataFrame({"index": np.arange(i, i + len(part)), "height": a.shape[1], "width": a.shape[2] if a.ndim > 2 else 1, "pixels": [x.tobytes() for x in part]})

    return _binary(spark, path).select("content").mapInPandas(run, "index long, height int, width int, pixels binary")


def open_idx_labels(spark: SparkSession, path: str) -> DataFrame:
    def run(iterator):
        for pdf in iterator:
            for raw in pdf["content"]:
                a = _idx(raw)
                yield pd.DataFrame({"index": np.arange(len(a)), "label": a.astype(np.int16)})

    return _binary(spark, path).select("content").mapInPandas(run, "index long, label short")


def _cifar(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    size = len(labels) + 3072

    def run(iterator):
        for pdf in iterator:
            for raw in pdf[column]:
                if raw is None:
                    continue
                if len(raw) % size:
                    raise ValueError(f"records have {size} bytes")
                a = np.frombuffer(raw, np.uint8).reshape(-1, size)
                for i in range(0, len(a), BATCH):
                    part = a[i : i + BATCH]
                    rgb = part[:, len(labels) :].reshape(-1, 3, 1024).transpose(0, 2, 1)  # planes to pixels
                    yield pd.DataFrame({"index": np.arange(i, i + len(part)), **{k: part[:, n].astype(np.int16) for n, k in enumerate(labels)}, "pixels": [x.tobytes() for x in rgb]})

    return df.select(column).mapInPandas(run, "index long, " + ", ".join(f"{k} short" for k in labels) + ", pixels binary")


def open_cifar10(df: DataFrame, column: str = "bytes") -> DataFrame:
    return _cifar(df, column, ["label"])


def open_cifar100(df: DataFrame, column: str = "bytes") -> DataFrame:
    return _cifar(df, column, ["coarse_label", "fine_label"])


def fits_units(raw: bytes) -> list[dict]:
    """Header and data range of each unit of a FITS file, in blocks of 2880 bytes."""
    out, pos = [], 0
    while pos + 2880 <= len(raw):
        header: dict = {}
        end = False
        while not end and pos < len(raw):
            block = raw[pos : pos + 2880].decode("ascii", "replace")
            pos += 2880
            for card in (block[i : i + 80] for i in range(0, 2880, 80)):
                if card.startswith("END"):
                    end = True
                    break
                if card[8:10] == "= ":
                    header[card[:8].strip()] = _fits_value(card[10:])
        axes = [int(header.get(f"NAXIS{i + 1}", 0)) for i in range(int(header.get("NAXIS", 0)))]
        count = int(np.prod(axes)) if axes else 0
        size = abs(int(header.get("BITPIX", 8))) // 8 * int(header.get("GCOUNT", 1)) * (int(header.get("PCOUNT", 0)) + count) if axes else 0
        kind = {"BINTABLE": "bintable", "TABLE": "table", "IMAGE": "image"}.get(str(header.get("XTENSION", "IMAGE")).strip(), "other")
        out.append({"header": header, "axes": axes, "start": pos, "size": size, "kind": kind})
        pos += -(-size // 2880) * 2880
    return out


def _fits_value(text: str):
    text = text.strip()
    if text.startswith("'"):
        return text[1 : text.index("'", 1)].rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    try:
        return int(text)
    except ValueError:
        try:
            return float(text.replace("D", "E"))
        except ValueError:
            return text


def open_fits_hdus(spark: SparkSession, path: str) -> DataFrame:
    def run(iterator):
        for pdf in iterator:
            for raw in pdf["content"]:
                rows = [(i, u["kind"], u["header"].get("EXTNAME"), int(u["header"].get("BITPIX", 8)), u["axes"], {k: str(v) for k, v in u["header"].items()}) for i, u in enumerate(fits_units(raw))]
                yield pd.DataFrame(rows, columns=["hdu_index", "kind", "extname", "bitpix", "axes", "header"])

    return _binary(spark, path).select("content").mapInPandas(run, "hdu_index long, kind string, extname string, bitpix int, axes array<int>, header map<string,string>")


_BITPIX = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def open_fits_images(spark: SparkSession, path: str) -> DataFrame:
    """Each image unit's axes and its scaled values, flat and row-major."""

    def run(iterator):
        for pdf in iterator:
            for raw in pdf["content"]:
                for i, u in enumerate(fits_units(raw)):
                    if u["kind"] == "image" and u["size"]:
                        h = u["header"]
                        a = np.frombuffer(raw, _BITPIX[int(h["BITPIX"])], int(np.prod(u["axes"])), u["start"]).astype(float) * float(h.get("BSCALE", 1)) + float(h.get("BZERO", 0))
                        yield pd.DataFrame({"hdu_index": [i], "extname": [h.get("EXTNAME")], "shape": [u["axes"][::-1]], "data": [a]})

    return _binary(spark, path).select("content").mapInPandas(run, "hdu_index long, extname string, shape array<int>, data array<double>")


_TFORM = {"L": ("i1", "boolean"), "B": ("u1", "short"), "I": (">i2", "short"), "J": (">i4", "int"), "K": (">i8", "long"), "E": (">f4", "float"), "D": (">f8", "double"), "A": ("S", "string")}


def _fits_fields(h: dict) -> list[tuple[str, int, str]]:
    out = []
    for i in range(1, int(h["TFIELDS"]) + 1):
        form = str(h[f"TFORM{i}"]).strip()
        digits = "".join(c for c in form if c.isdigit() and form.index(c) < len(form) - 1)
        out.append((str(h.get(f"TTYPE{i}", f"c{i}")).strip(), int(digits or 1), form[len(digits)]))
    return out


def open_fits_table(spark: SparkSession, path: str, unit: int | str) -> DataFrame:
    """Rows of a binary table, named by its index or its EXTNAME."""

    def find(raw: bytes) -> dict:
        return next(u for i, u in enumerate(fits_units(raw)) if unit in (i, u["header"].get("EXTNAME")))

    def heads(iterator):
        for pdf in iterator:
            for raw in pdf["content"]:
                yield pd.DataFrame(_fits_fields(find(raw)["header"]), columns=["name", "n", "code"])

    files = _binary(spark, path).select("content")
    fields = [tuple(r) for r in files.limit(1).mapInPandas(heads, "name string, n int, code string").collect()]  # one row per column
    kind = ", ".join(f"`{k}` {_TFORM[c][1] if n == 1 or c == 'A' else f'array<{_TFORM[c][1]}>'}" for k, n, c in fields)

    def run(iterator):
        dtype = np.dtype([(k, f"S{n}" if c == "A" else _TFORM[c][0], () if n == 1 or c == "A" else (n,)) for k, n, c in fields])
        for pdf in iterator:
            for raw in pdf["content"]:
                u = find(raw)
                a = np.frombuffer(raw, dtype, u["axes"][1], u["start"])
                cols = {}
                for k, n, c in fields:
                    v = a[k]
                    if c == "A":
                        cols[k] = [x.decode("ascii", "replace").rstrip() for x in v]
                    elif c == "L":
                        cols[k] = (v == ord("T")).tolist()
                    else:
                        cols[k] = list(v.astype(v.dtype.newbyteorder("="))) if n > 1 else v.astype(np.int16 if c == "B" else v.dtype.newbyteorder("="))
                yield pd.DataFrame(cols)

    return files.mapInPandas(run, kind)


def generate_series(spark: SparkSession, start, stop, step=1) -> DataFrame:
    """start to stop, both included."""
    if all(isinstance(x, int) for x in (start, stop, step)):
        return spark.range(start, stop + (1 if step > 0 else -1), step).select(F.col("id").alias("value"))
    n = int(np.floor((stop - start) / step + 1e-9)) + 1
    return spark.range(max(0, n)).select((F.lit(float(start)) + F.col("id") * float(step)).alias("value"))


def range_(spark: SparkSession, start, stop, step=1) -> DataFrame:
    """start to before stop."""
    if all(isinstance(x, int) for x in (start, stop, step)):
        return spark.range(start, stop, step).select(F.col("id").alias("value"))
    return generate_series(spark, start, stop, step).where((F.col("value") < stop) if step > 0 else (F.col("value") > stop))


def unnest(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(column).alias("value"))
