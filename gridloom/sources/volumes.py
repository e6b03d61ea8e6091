"""Volumes as files: MetaImage headers with raw data, whole or by slices; windowed bitmaps; noise; file lists and schedules."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Element types of the format.
ELEMENTS = {"MET_CHAR": "i1", "MET_UCHAR": "u1", "MET_SHORT": "i2", "MET_USHORT": "u2", "MET_INT": "i4", "MET_UINT": "u4", "MET_LONG_LONG": "i8", "MET_ULONG_LONG": "u8", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}
VOXELS = "img string, x long, y long, z long, c array<double>"
_VOXELS = pa.schema([("img", pa.string()), *((a, pa.int64()) for a in "xyz"), ("c", pa.list_(pa.float64()))])
PART = 1 << 20  # voxels that are handed on at once


def read_header(text: str) -> dict[str, str]:
    """The `key = value` lines of a header, up to and with ElementDataFile."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        if "=" in line:
            k, v = (x.strip() for x in line.split("=", 1))
            out[k] = v
            if k == "ElementDataFile":
                break
    return out


def _dims(h: dict[str, str]) -> tuple[int, int, int]:
    return tuple(([*map(int, h["DimSize"].split()), 1, 1])[:3])


def image_meta(spark: SparkSession, path: str) -> DataFrame:
    """(img, ext, spacing, origin, dtype, ncomp) of the headers that a path or pattern of .mhd files names."""

    def meta(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            rows = []
            for img, text in zip(part["img"], part["text"], strict=True):
                h = read_header(text)
                n = _dims(h)
                three = lambda *keys, h=h, fill=0.0: [*map(float, next((h[k] for k in keys if k in h), "").split()), fill, fill, fill][:3]
                rows.append((img, [v for k in n for v in (0, k - 1)], three("ElementSpacing", "ElementSize", fill=1.0), three("Offset", "Origin", "Position"), h["ElementType"], int(h.get("ElementNumberOfChannels", 1))))
            yield pd.DataFrame(rows, columns=["img", "ext", "spacing", "origin", "dtype", "ncomp"])

    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("img"), F.col("value").alias("text"))
    return texts.mapInPandas(meta, "img string, ext array<int>, spacing array<double>, origin array<double>, dtype string, ncomp int")


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """(img, x, y, z, c) of the volumes whose .mhd headers a path or pattern names.

    The data is one raw file beside the header, or one for each slice from a printf pattern `name%03d.raw first last step`
    or a LIST of names. Each raw file, 2 GB at most, is read by Spark as one row of bytes, so a volume by slices is
    read by as many tasks. zlib-compressed data is taken apart whole.
    """
    heads = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("img"), F.col("value").alias("text"))

    def names(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            rows = []
            for img, text in zip(part["img"], part["text"], strict=True):
                h = read_header(text)
                folder, data = img.rsplit("/", 1)[0], h["ElementDataFile"]
                if data == "LIST":
                    files = text.split("LIST", 1)[1].split()
                elif "%" in data:
                    pattern, first, last, *step = data.split()
                    files = [pattern % i for i in range(int(first), int(last) + 1, int(step[0]) if step else 1)]
                else:
                    files = [data]
                rows += [(img, text, f"{folder}/{f}", i if len(files) > 1 else -1) for i, f in enumerate(files)]
            yield pd.DataFrame(rows, columns=["img", "text", "file", "slice"])

    files = heads.mapInPandas(names, "img string, text string, file string, slice int")
    folders = sorted({r["folder"] for r in files.select(F.regexp_replace("file", "/[^/]*$", "").alias("folder")).distinct().collect()})
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{raw,zraw}").load(folders) if folders else spark.createDataFrame([], "path string, content binary")

    def voxels(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                h = read_header(r["text"])
                nx, ny, nz = _dims(h)
                k = int(h.get("ElementNumberOfChannels", 1))
                data = zlib.decompress(r["content"]) if h.get("CompressedData", "False") == "True" else r["content"]
                order = ">" if h.get("BinaryDataByteOrderMSB", h.get("ElementByteOrderMSB", "False")) == "True" else "<"
                values = np.frombuffer(data, order + ELEMENTS[h["ElementType"]]).reshape(-1, k)
                first = 0 if r["slice"] < 0 else r["slice"] * nx * ny
                for a in range(0, len(values), PART):
                    v = values[a : a + PART].astype(float)
                    i = np.arange(first + a, first + a + len(v))
                    c = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, k, dtype=np.int32)), pa.array(v.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([r["img"]] * len(v)), pa.array(i % nx), pa.array(i // nx % ny), pa.array(i // (nx * ny)), c], schema=_VOXELS)

    rows = files.join(raw.select(F.col("path").alias("file"), "content"), "file")
    return rows.select("img", "text", "slice", "content").mapInArrow(voxels, VOXELS)


def write_volume(image: DataFrame, folder: str, dtype: str = "MET_FLOAT", spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> None:
    """Write a dense image (x, y, z, v) of non-negative places as raw slices and a header: each slice is a task's file.

    Missing voxels are 0. The files are written by pyarrow's file systems, so the folder is a URI that all executors reach.
    """
    import pyarrow.fs

    n = [int(v) + 1 for v in image.agg(*(F.max(a) for a in "xyz")).first()]
    kind = np.dtype("<" + ELEMENTS[dtype])

    def put(group: pd.DataFrame) -> pd.DataFrame:
        z = int(group["z"].iloc[0])
        out = np.zeros((n[1], n[0]), kind)
        out[group["y"].to_numpy(int), group["x"].to_numpy(int)] = group["v"].to_numpy()
        fs, top = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        with fs.open_output_stream(f"{top}/slice{z:05d}.raw") as f:
            f.write(out.tobytes())
        return pd.DataFrame({"z": [z]})

    done = image.select("x", "y", "z", "v").groupBy("z").applyInPandas(put, "z long").count()
    if done != n[2]:
        raise ValueError("slices are missing")
    fs, top = pyarrow.fs.FileSystem.from_uri(folder)
    head = f"ObjectType = Image\nNDims = 3\nDimSize = {n[0]} {n[1]} {n[2]}\nElementSpacing = {' '.join(map(str, spacing))}\nOffset = 0 0 0\nElementByteOrderMSB = False\nElementType = {dtype}\nElementDataFile = slice%05d.raw 0 {n[2] - 1} 1\n"
    with fs.open_output_stream(f"{top}/volume.mhd") as f:
        f.write(head.encode())


def read_bitmaps(spark: SparkSession, path: str) -> DataFrame:
    """(img, x, y, z, c) of uncompressed bitmaps of 8, 24 or 32 bits a pixel: z is 0, y grows upwards, c is the grey value or r, g, b."""

    def pixels(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                b = r["content"]
                at, size, w, h, _, bits, packed = struct.unpack("<10xIIiiHHI", b[:34])
                if packed or bits not in (8, 24, 32):
                    raise ValueError(f"{r['path']}: not a plain bitmap")
                k = bits // 8
                rows = np.frombuffer(b, np.uint8, -(-w * k // 4) * 4 * abs(h), at).reshape(abs(h), -1)[:, : w * k].reshape(abs(h), w, k)
                rows = rows if h > 0 else rows[::-1]
                if k == 1:
                    palette = np.frombuffer(b, np.uint8, at - 14 - size, 14 + size).reshape(-1, 4)
                    v = palette[rows[..., 0], 2:3] if len(palette) else rows
                else:
                    v = rows[..., 2::-1]
                i = np.arange(abs(h) * w)
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(i)), pa.array(i % w), pa.array(i // w), pa.array(np.zeros_like(i)), pa.array(list(v.reshape(len(i), -1).astype(float)))], schema=_VOXELS)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(pixels, VOXELS)


def graymap(image: DataFrame, most: int = 1 << 26) -> bytes:
    """A slice (x, y, v) as a binary portable graymap, spread to 0 .. 255: a picture for people, of at most `most` pixels."""
    n = image.count()
    if n > most:
        raise ValueError("too many pixels for a picture")
    p = image.select("x", "y", "v").toPandas()
    if p.empty:
        return b"P5\n0 0\n255\n"
    out = np.zeros((int(p["y"].max()) + 1, int(p["x"].max()) + 1))
    out[p["y"].to_numpy(int), p["x"].to_numpy(int)] = p["v"]
    span = out.max() - out.min() or 1.0
    return f"P5\n{out.shape[1]} {out.shape[0]}\n255\n".encode() + ((out - out.min()) / span * 255).astype(np.uint8).tobytes()


def noise(spark: SparkSession, size: tuple[int, int, int], low: float, high: float, channels: int = 1, seed: int = 0) -> DataFrame:
    """(x, y, z, c0, c1, ...): uniform noise in [low, high) that depends on the place and the seed alone."""
    from .fixtures import lattice

    unit: list[Column] = [(F.xxhash64("x", "y", "z", F.lit(seed), F.lit(k)).bitwiseAND((1 << 53) - 1) / float(1 << 53)) for k in range(channels)]
    return lattice(spark, *size).withColumns({f"c{k}": F.lit(float(low)) + u * F.lit(float(high - low)) for k, u in enumerate(unit)})


def file_list(spark: SparkSession, names: str, labels: str | None = None) -> DataFrame:
    """(at, name, label): the lines of a text file, with those at the same places of another."""
    lines = lambda path: spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), r"\r?\n")).alias("at", "line"))
    out = lines(names).select("at", F.trim("line").alias("name"))
    more = out.select("at").withColumn("label", F.lit(None).cast("string")) if labels is None else lines(labels).select("at", F.trim("line").alias("label"))
    return out.join(more, "at", "left").where("name <> ''")


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    """(iter, mA, vA, wA, mW, vW, wW): lines of seven numbers between white space; others are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    names = ("iter", "mA", "vA", "wA", "mW", "vW", "wW")
    return spark.read.text(path).where(F.size(parts) == 7).select(*(parts[i].try_cast("double").alias(n) for i, n in enumerate(names))).dropna()
