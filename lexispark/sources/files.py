"""Readers and writers of text, JSON, CSV, matrices and annotated documents.

Spark's own sources read plain, gzip and bzip2 files in parallel; xz and zip files, and JSON without delimiters, are decoded file by file in workers.
"""

from __future__ import annotations

import bz2
import csv
import gzip
import io
import json
import lzma
import os
import re
import shutil
import tarfile
import urllib.request
import zipfile
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKED = (".xz", ".zip")


def decompressed(name: str, content: bytes) -> bytes:
    """Content by the suffix of its name; a zip file must hold one member."""
    suffix = os.path.splitext(name)[1]
    if suffix == ".zip":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if len(z.namelist()) != 1:
                raise ValueError(f"{name} holds {len(z.namelist())} members and not one")
            return z.read(z.namelist()[0])
    return {".gz": gzip.decompress, ".bz2": bz2.decompress, ".xz": lzma.decompress}.get(suffix, bytes)(content)


def open_sesame(path: str, *, mode: str = "rt", encoding: str | None = None, errors: str | None = None, newline: str | None = None, compression: str | None = "infer", make_dirs: bool = False):
    """A driver-side file, compressed as its suffix says; a missing file raises when read."""
    if make_dirs:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    if not set(mode) & set("wax") and not os.path.isfile(path):
        raise OSError(f"file {path!r} doesn't exist")
    kind = os.path.splitext(path)[1] if compression == "infer" else f".{compression}" if compression else ""
    options = {} if "b" in mode else {"encoding": encoding, "errors": errors, "newline": newline}
    if kind == ".zip":
        z = zipfile.ZipFile(path, mode[0])
        if mode[0] == "r" and len(z.namelist()) != 1:
            raise ValueError(f"{path} holds {len(z.namelist())} members and not one")
        member = z.open(z.namelist()[0] if mode[0] == "r" else os.path.splitext(os.path.basename(path))[0], mode[0])
        close = member.close

        def close_both() -> None:
            close()
            z.close()

        member.close = close_both
        return member if "b" in mode else io.TextIOWrapper(member, **options)
    opener = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}.get(kind, open)
    return opener(path, mode, **options)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole files, decompressed by suffix."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "content": [decompressed(p, bytes(c)) for p, c in zip(b["path"], b["content"])]})

    return files.mapInPandas(run, "path string, content binary")


def _packed(path: str) -> bool:
    return path.endswith(PACKED)


def read_text(spark: SparkSession, path: str, *, lines: bool = False, keep_newlines: bool = False) -> DataFrame:
    """(text): a row for each file, or for each line, with its newline if asked for."""
    if _packed(path):
        whole = read_binary(spark, path).select(F.decode("content", "UTF-8").alias("text"))
        out = whole.select(F.explode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("text")) if lines else whole
    else:
        out = spark.read.text(path, wholetext=not lines).select(F.col("value").alias("text"))
    return out.select(F.concat("text", F.lit("\n")).alias("text")) if lines and keep_newlines else out


def write_text(df: DataFrame, path: str, *, text_col: str = "text", compression: str = "none", mode: str = "error") -> None:
    """A line for each row."""
    df.select(text_col).write.mode(mode).option("compression", compression).text(path)


def read_json(spark: SparkSession, path: str, *, lines: bool = False, schema: T.StructType | str | None = None) -> DataFrame:
    """One document a file, or one a line."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if _packed(path):
        text = read_text(spark, path, lines=lines)
        return reader.json(text.rdd.map(lambda r: r[0])) if schema is None else text.select(F.from_json("text", schema if isinstance(schema, str) else schema.simpleString()).alias("r")).select("r.*")
    return reader.json(path, multiLine=not lines)


def json_mash(text: str) -> Iterator[object]:
    """Documents that follow one another with or without white space between."""
    decoder, at = json.JSONDecoder(), 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        found, at = decoder.raw_decode(text, at)
        yield found


def read_json_mash(spark: SparkSession, path: str) -> DataFrame:
    """(value): each document of files that hold several without delimiters, as JSON text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"value": [json.dumps(x, ensure_ascii=False) for c in b["content"] for x in json_mash(bytes(c).decode())]})

    return read_binary(spark, path).select("content").mapInPandas(run, "value string")


def write_json(df: DataFrame, path: str, *, compression: str = "none", mode: str = "error", ignore_null: bool = False) -> None:
    """JSON lines; dates and timestamps in ISO form."""
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    df.write.mode(mode).options(timestampNTZFormat=iso).json(path, compression=compression, dateFormat="yyyy-MM-dd", timestampFormat=iso, ignoreNullFields=ignore_null)


def to_json_document(df: DataFrame, *, sort_keys: bool = False) -> Column:
    """A row as compact JSON, its keys in order if asked for."""
    names = sorted(df.columns) if sort_keys else df.columns
    return F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss", "ignoreNullFields": "false"})


def sniff_csv(head: str) -> tuple[str, str, bool]:
    """Delimiter, quote and whether there is a header, from the first 1024 characters."""
    dialect = csv.Sniffer().sniff(head[:1024])
    return dialect.delimiter, dialect.quotechar or '"', csv.Sniffer().has_header(head[:1024])


def read_csv(spark: SparkSession, path: str, *, fieldnames: list[str] | None = None, dialect: str = "excel", delimiter: str = ",", numeric: bool = True, schema: str | None = None) -> DataFrame:
    """Rows with fields _c0, _c1, ... or ``fieldnames`` (a row equal to these is a header and goes); ``numeric`` reads numbers as doubles.

    The dialect ``infer`` looks at the beginning of the first file; ``excel-tab`` has tabs.
    """
    header, quote = False, '"'
    if dialect == "infer":
        head = spark.read.text(path).limit(20).collect()  # 20 lines
        delimiter, quote, header = sniff_csv("\n".join(r[0] for r in head))
    elif dialect == "excel-tab":
        delimiter = "\t"
    reader = spark.read.option("sep", delimiter).option("quote", quote).option("escape", quote).option("header", header).option("multiLine", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    out = reader.csv(path)
    if fieldnames:
        names = out.columns
        same = F.lit(True)
        for n, f in zip(names, fieldnames):
            same = same & F.col(n).eqNullSafe(F.lit(f))
        out = out.where(~same).toDF(*fieldnames)
    if numeric:
        checks = out.agg(*[F.every(F.col(c).isNull() | F.expr(f"try_cast(`{c}` AS double)").isNotNull()).alias(c) for c in out.columns]).first()
        out = out.select(*[F.expr(f"try_cast(`{c}` AS double)").alias(c) if checks[c] else F.col(c) for c in out.columns])
    return out


def write_csv(df: DataFrame, path: str, *, header: bool = False, delimiter: str = ",", quote_all: bool = False, compression: str = "none", mode: str = "error") -> None:
    df.write.mode(mode).csv(path, header=header, sep=delimiter, quoteAll=quote_all, escape='"', compression=compression)


def read_sparse_matrix(spark: SparkSession, path: str, *, kind: str = "csr") -> DataFrame:
    """(row, col, value) of npz files with the arrays data, indices, indptr and shape of a compressed sparse matrix."""
    if kind not in ("csr", "csc"):
        raise ValueError(f"kind = {kind!r}; known are csr and csc")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c in b["content"]:
                with np.load(io.BytesIO(bytes(c))) as z:
                    major = np.repeat(np.arange(len(z["indptr"]) - 1), np.diff(z["indptr"]))
                    row, column = (major, z["indices"]) if kind == "csr" else (z["indices"], major)
                    yield pd.DataFrame({"row": row.astype(np.int64), "col": column.astype(np.int64), "value": z["data"].astype(float)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row long, col long, value double")


def write_sparse_matrix(df: DataFrame, path: str, *, compressed: bool = True, npz: bool = False) -> None:
    """(row, col, value) as Parquet; ``npz`` collects a matrix that fits the driver into one file of CSR arrays."""
    if not npz:
        df.select("row", "col", "value").write.parquet(path)
        return
    cells = df.select("row", "col", "value").orderBy("row", "col").toPandas()
    n = int(cells["row"].max()) + 1 if len(cells) else 0
    arrays = {"data": cells["value"].to_numpy(), "indices": cells["col"].to_numpy(np.int32), "indptr": np.r_[0, np.cumsum(np.bincount(cells["row"], minlength=n))], "shape": np.array([n, int(cells["col"].max()) + 1 if len(cells) else 0])}
    (np.savez_compressed if compressed else np.savez)(path, **arrays)


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    """Annotated documents."""
    return spark.read.parquet(path)


def write_docs(df: DataFrame, path: str, *, attrs: list[str] | None = None, store_user_data: bool = False, tokens_col: str = "tokens") -> None:
    """Annotated documents as Parquet, with some token attributes or all, and without ``meta`` unless asked for."""
    tokens = F.col(tokens_col)
    if attrs is not None:
        tokens = F.transform(tokens, lambda t: F.struct(*[t[a].alias(a) for a in dict.fromkeys(["text", "ws", *attrs])]))
    df.select(*[c for c in df.columns if c != tokens_col and (store_user_data or c != "meta")], tokens.alias(tokens_col)).write.parquet(path)


def split_records(df: DataFrame, content_field: str) -> DataFrame:
    """(content, meta): one column, and the others as a struct."""
    return df.select(F.col(content_field).alias("content"), F.struct(*[c for c in df.columns if c != content_field]).alias("meta"))


def unzip(df: DataFrame) -> tuple[DataFrame, ...]:
    """Each column by itself."""
    return tuple(df.select(c) for c in df.columns)


def get_filepaths(spark: SparkSession, path: str, *, match_regex: str | None = None, ignore_regex: str | None = None, extension: str | None = None, ignore_invisible: bool = True, recursive: bool = False) -> DataFrame:
    """(path) of the files in a folder, in order; names are searched for the expressions."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    if ignore_invisible:
        rows = rows.where(~name.startswith("."))
    if match_regex:
        rows = rows.where(name.rlike(match_regex))
    if ignore_regex:
        rows = rows.where(~name.rlike(ignore_regex))
    if extension:
        rows = rows.where(name.endswith(extension))
    return rows.orderBy("path")


def coerce_content_type(c: Column, mode: str) -> Column:
    """Text to bytes for a binary mode, bytes to text for others."""
    return F.encode(c.cast("string"), "UTF-8") if "b" in mode else F.decode(c.cast("binary"), "UTF-8")


def get_filename_from_url(url: Column) -> Column:
    """The last part of a URL's path, decoded."""
    return F.url_decode(F.element_at(F.split(F.parse_url(url, F.lit("PATH")), "/"), -1))


def filename_from_url(url: str) -> str:
    return os.path.basename(unquote(urlsplit(unquote(url)).path))


def _get(url: str, auth: tuple[str, str] | None):
    request = urllib.request.Request(url)
    if auth:
        import base64

        request.add_header("Authorization", "Basic " + base64.b64encode(":".join(auth).encode()).decode())
    return urllib.request.urlopen(request)  # noqa: S310


def write_http_stream(url: str, path: str, *, make_dirs: bool = False, chunk_size: int = 1 << 16, auth: tuple[str, str] | None = None) -> str:
    """Fetches a URL on the driver into a file; executors read it from there."""
    if make_dirs:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with _get(url, auth) as source, open(path, "wb") as file:
        shutil.copyfileobj(source, file, chunk_size)
    return path


def read_http_stream(url: str, *, lines: bool = False, decode: bool = True, auth: tuple[str, str] | None = None) -> Iterator[str | bytes]:
    """The body as one piece, or its lines that aren't empty."""
    with _get(url, auth) as source:
        parts = (x.rstrip(b"\r\n") for x in source) if lines else [source.read()]
        for x in parts:
            if x or not lines:
                yield x.decode() if decode else x


def download_file(url: str, *, dirpath: str, filename: str | None = None, force: bool = False) -> str | None:
    """The path of the fetched file; None if it was there already."""
    path = os.path.join(dirpath, filename or filename_from_url(url))
    return None if os.path.exists(path) and not force else write_http_stream(url, path, make_dirs=True)


def unpack_archive(path: str, *, extract_dir: str | None = None) -> str:
    """Unpacks a zip or tar file on the driver; a single root folder takes the name of the target. Members can't leave the folder."""
    target = Path(extract_dir or re.sub(r"\.(?:zip|tar(?:\.\w+)?|tgz)$", "", path))
    target.mkdir(parents=True, exist_ok=True)
    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as z:
            z.extractall(target)
    elif tarfile.is_tarfile(path):
        with tarfile.open(path) as t:
            t.extractall(target, filter="data")
    else:
        raise ValueError(f"{path} is neither a zip nor a tar file")
    inner = list(target.iterdir())
    return str(inner[0] if len(inner) == 1 and inner[0].is_dir() else target)
