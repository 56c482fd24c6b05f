"""Files as rows: directory listings, contents, camera metadata, label files and manifests."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.functions.scalar import extension, file_name
from argentum.plans.shared import cut, importable
from argentum.sources.formats import detect, is_photo_path

# Folders that a scan leaves out, and what a plain listing takes.
PRUNED = {".Trash", ".Trashes", ".argentum-bin"}
PLAIN = ("jpg", "jpeg", "png", "webp", "heic")


ENTRIES = "path string, folder boolean, file_size long, modified_at timestamp"
_ENTRY = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("file_size", pa.int64()), ("modified_at", pa.timestamp("us", "UTC"))])


def entries(folder: str) -> Iterator[tuple]:
    """What is directly in a folder, by the store's own file system: path, whether it is a folder, bytes, seconds of the last change.

    A path with a scheme is listed by Arrow's file system for it, file: and no scheme by the local one, where links to folders aren't
    followed. What can't be read is left out.
    """
    try:
        scheme = "file://" if folder.startswith("file://") else ""
        folder = unquote(folder[len(scheme) :]) if scheme else folder
        if "://" in folder:
            from pyarrow import fs

            store, base = fs.FileSystem.from_uri(folder)
            head = folder[: len(folder) - len(base)] if folder.endswith(base) else folder.split("://")[0] + "://"
            for x in store.get_file_info(fs.FileSelector(base)):
                if x.type != fs.FileType.NotFound:
                    yield head + x.path, x.type == fs.FileType.Directory, x.size, x.mtime_ns / 1e9 if x.mtime_ns is not None else None
            return
        with os.scandir(folder) as found:
            for x in found:
                try:
                    inner = x.is_dir(follow_symlinks=False)
                    if inner or x.is_file():
                        s = x.stat()
                        yield (scheme + quote(x.path) if scheme else x.path), inner, s.st_size, s.st_mtime
                except OSError:
                    continue
    except OSError:
        return


def tree(spark: SparkSession, root: str) -> DataFrame:
    """All files under a folder (path, file_size, modified_at), listed level by level by executors.

    The folders of a level are a table, dealt out by path; what they hold is written before the next level begins. Nothing but
    whether there is a next level comes to the driver. Folders in PRUNED are left out.
    """
    importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = iter(entries(folder))
                while some := list(islice(rows, 10_000)):
                    path, inner, size, at = zip(*some, strict=True)
                    when = [None if x is None else int(x * 1_000_000) for x in at]
                    yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(inner), pa.array(size, pa.int64()), pa.array(when, pa.int64()).cast(_ENTRY.field(3).type)], schema=_ENTRY)

    folders, levels = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string"), []
    while True:
        found = cut(folders.repartition("path").mapInArrow(run, ENTRIES), "level")
        levels.append(found.filter("not folder").drop("folder"))
        folders = found.filter("folder").select("path").filter(~file_name(F.col("path")).isin(*PRUNED))
        if folders.isEmpty():
            return reduce(DataFrame.union, levels)


def walk(spark: SparkSession, root: str) -> DataFrame:
    """Photos under a folder, hidden names included; unreadable folders are left out."""
    listed = tree(spark, root)
    return listed.filter(is_photo_path(F.col("path"))).withColumn("filename", file_name(F.col("path"))).withColumn("extension", extension(F.col("path")))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Pictures directly in a folder, by name; names with a leading dot are left out."""
    try:
        names = sorted(n for n in os.listdir(folder) if not n.startswith(".") and n.rsplit(".", 1)[-1].lower() in PLAIN and os.path.isfile(os.path.join(folder, n)))
    except OSError:
        names = []
    return spark.createDataFrame([(os.path.join(folder, n), n) for n in names], "path string, filename string").orderBy("filename")


def contents(spark: SparkSession, path: str) -> DataFrame:
    """Binary files of any store that Spark reads, with hash, size and format. Names that begin with . or _ need walk()."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.filter(is_photo_path(F.col("path"))).select("path", F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("sha256"), detect(F.col("path"), F.col("content")).alias("format"), "content")


TAGS = {0x010F: "camera_make", 0x0110: "camera_model", 0x0112: "orientation", 0x0132: "changed", 0x8769: "exif", 0x8825: "gps", 0x9003: "taken"}


def exif(data: bytes | None) -> dict:
    """Camera metadata of a JPEG or TIFF: time taken (else changed), make, model, orientation, whether there is a place."""
    out: dict = {"capture_time": None, "camera_make": None, "camera_model": None, "orientation": None, "gps_available": False}
    try:
        base = data if data[:4] in (b"II*\0", b"MM\0*") else _app1(data)
        order = "<" if base[:2] == b"II" else ">"
        found: dict = {}
        gps: dict = {}
        _directory(base, order, struct.unpack_from(order + "I", base, 4)[0], found)
        if isinstance(found.get(0x8769), int):
            _directory(base, order, found[0x8769], found)
        if isinstance(found.get(0x8825), int):
            _directory(base, order, found[0x8825], gps)
        text = lambda tag: (found[tag].strip().strip('"').strip() or None) if isinstance(found.get(tag), str) else None
        out |= {"capture_time": text(0x9003) or text(0x0132), "camera_make": text(0x010F), "camera_model": text(0x0110), "orientation": found.get(0x0112) if isinstance(found.get(0x0112), int) else None, "gps_available": 2 in gps}
    except (struct.error, IndexError, ValueError, TypeError):
        pass
    return out


def _app1(data: bytes) -> bytes:
    """The TIFF part of a JPEG's metadata."""
    at = 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack_from(">H", data, at + 2)[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        at += 2 + size
    raise ValueError("no metadata")


def _directory(base: bytes, order: str, at: int, found: dict) -> None:
    for i in range(struct.unpack_from(order + "H", base, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", base, at + 2 + 12 * i)
        place = at + 10 + 12 * i
        if kind == 2:
            start = place if n <= 4 else struct.unpack_from(order + "I", base, place)[0]
            found.setdefault(tag, base[start : start + n].split(b"\0")[0].decode("utf-8", "replace"))
        elif kind == 3:
            found.setdefault(tag, struct.unpack_from(order + "H", base, place)[0])
        else:
            found.setdefault(tag, struct.unpack_from(order + "I", base, place)[0])


METADATA = "capture_time string, camera_make string, camera_model string, orientation long, gps_available boolean"


def with_metadata(files: DataFrame) -> DataFrame:
    """Adds camera metadata to rows with `path` and `content`; files without any give nulls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            more = pd.DataFrame([exif(bytes(c) if c is not None else None) for c in f["content"]], columns=[x.split()[0] for x in METADATA.split(", ")])
            more["orientation"] = more["orientation"].astype("Int64")
            yield pd.concat([f[["path"]].reset_index(drop=True), more], axis=1)

    return files.select("path", "content").mapInPandas(run, "path string, " + METADATA)


TRUTH = "map<string,array<struct<face:int,left_eye:string,right_eye:string>>>"


def ground_truth(texts: DataFrame, column: str = "value") -> DataFrame:
    """Label files (JSON objects) to filename, face, left_eye, right_eye, problem.

    Keys that begin with _, nulls and what is no list are left out. A file without faces has one row with null
    face. Labels that don't exist, and texts that are no object, are rows with a problem.
    """
    good = F.expr(f"try_variant_get(try_parse_json({column}), '$', 'map<string,variant>')")
    broken = texts.filter(good.isNull()).select(*[F.lit(None).cast(t).alias(n) for n, t in (("filename", "string"), ("face", "int"), ("left_eye", "string"), ("right_eye", "string"))], F.lit("not a JSON object").alias("problem"))
    each = texts.select(F.explode(good).alias("filename", "v")).filter(~F.col("filename").startswith("_")).withColumn("faces", F.expr("try_variant_get(v, '$', 'array<struct<face:int,left_eye:string,right_eye:string>>')")).filter("faces is not null")
    rows = each.select("filename", F.explode_outer("faces").alias("f")).select("filename", "f.face", F.coalesce("f.left_eye", F.lit("")).alias("left_eye"), F.coalesce("f.right_eye", F.lit("")).alias("right_eye"))
    bad = ~F.col("left_eye").isin("", "OPEN", "CLOSED", "IGNORE") | ~F.col("right_eye").isin("", "OPEN", "CLOSED", "IGNORE")
    return rows.withColumn("problem", F.when(bad, "no such label")).union(broken)


def ground_truth_text(truth: DataFrame) -> DataFrame:
    """Labels back to one JSON text for each file: filename, faces."""
    return truth.filter("face is not null").groupBy("filename").agg(F.to_json(F.sort_array(F.collect_list(F.struct("face", "left_eye", "right_eye")))).alias("faces"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated manifest of RAW files."""
    return spark.read.csv(path, sep="\t", header=True, schema="file string, make string, model string, raw_width int, raw_height int")


def data_url(content: str = "content", mime: str = "image/jpeg"):
    """A data address; Spark's base64 breaks lines, an address has none."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))
