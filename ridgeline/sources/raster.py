"""Zipped raster tiles.

Archives come through Spark's ``binaryFile`` source, one task taking some files;
each gives a row for every row of its raster, so a large tile is never one
value. GeoTIFF members are decoded with the standard library and numpy: one
band or the first of several, in strips or tiles, either byte order, plain,
LZW or Deflate, with or without a predictor, classic or BigTIFF.

Defined results: an archive without a ``.tif`` or ``.xml`` member, or one that
cannot be read, gives one row with ``error`` and no values; the load goes on.
Of several such members the first in the archive is taken. A box comes from the
corner positions of the XML, as in ``elevation.bounds_from_xml``.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.runtime import store_uri
from ridgeline.sources.files import tile_id

#: Sizes and struct codes of TIFF field types.
_FIELDS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
_KINDS = {1: "u", 2: "i", 3: "f"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _STRIPS, _SAMPLES, _ROWS, _STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
_PLANES, _PREDICTOR, _TILE_WIDTH, _TILE_HEIGHT, _TILES, _TILE_BYTES, _FORMAT = 284, 317, 322, 323, 324, 325, 339

ROWS = (
    "path string, file_id string, min_easting int, min_northing int, max_easting int, max_northing int, "
    "height int, row int, values array<double>, error string"
)


def members(names: list[str]) -> tuple[str, str]:
    """The first raster and the first XML of an archive."""
    found = []
    for ending in (".tif", ".xml"):
        match = [n for n in names if ending in n.lower()]
        if not match:
            raise ValueError(f"no {ending} member")
        found.append(match[0])
    return found[0], found[1]


def corner_box(xml: str | bytes) -> tuple[int, int, int, int]:
    """(min_easting, min_northing, max_easting, max_northing) of the corners."""
    corners = [p.text.split() for p in ElementTree.fromstring(xml).iterfind(".//spatRepInfo/Georect/cornerPts/pos") if p.text]
    if not corners:
        raise ValueError("no corner positions")
    e, n = ([int(float(c[i])) for c in corners] for i in (0, 1))
    return min(e), min(n), max(e), max(n)


def _directory(raw: bytes) -> tuple[str, dict[int, list]]:
    """Byte order, and the values of the fields of the first image."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None:
        raise ValueError("not a TIFF")
    (version,) = struct.unpack_from(order + "H", raw, 2)
    if version == 42:
        (at,), count, entry, offset = struct.unpack_from(order + "I", raw, 4), "H", 12, "I"
    elif version == 43:
        (at,), count, entry, offset = struct.unpack_from(order + "Q", raw, 8), "Q", 20, "Q"
    else:
        raise ValueError(f"TIFF version {version}")
    (n,) = struct.unpack_from(order + count, raw, at)
    at += struct.calcsize(count)
    fields = {}
    for i in range(n):
        place = at + i * entry
        tag, kind = struct.unpack_from(order + "HH", raw, place)
        (many,) = struct.unpack_from(order + offset, raw, place + 4)
        if kind not in _FIELDS:
            continue
        code = order + f"{many}{_FIELDS[kind]}" if len(_FIELDS[kind]) == 1 else order + _FIELDS[kind] * many
        start = place + 4 + struct.calcsize(offset)
        if struct.calcsize(code) > struct.calcsize(offset):
            (start,) = struct.unpack_from(order + offset, raw, start)
        fields[tag] = list(struct.unpack_from(code, raw, start))
    return order, fields


def unpack_lzw(raw: bytes) -> bytes:
    """TIFF's variant of LZW: codes of 9 to 12 bits, most significant bit first,
    each width ending a code early."""
    out = bytearray()
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    width, last, held, bits = 9, b"", 0, 0
    for byte in raw:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code < len(table):
            piece = table[code]
        elif code == len(table) and last:
            piece = last + last[:1]
        else:
            raise ValueError("bad LZW code")
        out += piece
        if last:
            table.append(last + piece[:1])
        last = piece
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def _plain(raw: bytes, compression: int) -> bytes:
    if compression == 1:
        return raw
    if compression == 5:
        return unpack_lzw(raw)
    if compression in (8, 32946):
        return zlib.decompress(raw)
    raise ValueError(f"TIFF compression {compression}")


def _block(raw: bytes, height: int, width: int, samples: int, kind: np.dtype, predictor: int) -> np.ndarray:
    """The first band of a strip or tile."""
    size = height * width * samples
    if predictor == 3:
        # Bytes of each row lie by significance, and are differences.
        rows = np.frombuffer(raw, dtype=np.uint8, count=size * kind.itemsize).reshape(height, width * samples * kind.itemsize)
        spread = np.lib.stride_tricks.as_strided(rows, (height, rows.shape[1] // samples, samples), (rows.strides[0], samples, 1))
        rows = np.cumsum(spread, axis=1, dtype=np.uint8).reshape(height, kind.itemsize, width * samples)
        out = np.ascontiguousarray(rows.transpose(0, 2, 1)).view(kind.newbyteorder(">"))
        return out.reshape(height, width, samples)[:, :, 0]
    out = np.frombuffer(raw, dtype=kind, count=size).reshape(height, width, samples)
    if predictor == 2:
        native = kind.newbyteorder("=")
        out = np.cumsum(out.astype(native).view(f"u{kind.itemsize}"), axis=1, dtype=f"u{kind.itemsize}").view(native)
    return out[:, :, 0]


def decode_tiff(raw: bytes) -> np.ndarray:
    """The first band of a TIFF's first image, the first row on top."""
    order, fields = _directory(raw)
    one = lambda tag, default: fields.get(tag, [default])[0]
    width, height, samples = one(_WIDTH, 0), one(_HEIGHT, 0), one(_SAMPLES, 1)
    kind = np.dtype(f"{order}{_KINDS[one(_FORMAT, 1)]}{one(_BITS, 8) // 8}")
    if one(_PLANES, 1) == 2:
        samples = 1  # bands lie one after the other, the first one first
    out = np.zeros((height, width), dtype=kind.newbyteorder("="))
    tiled = _TILES in fields
    deep = one(_TILE_HEIGHT, 0) if tiled else min(one(_ROWS, height), height)
    wide = one(_TILE_WIDTH, 0) if tiled else width
    places, sizes = (fields[_TILES], fields[_TILE_BYTES]) if tiled else (fields[_STRIPS], fields[_STRIP_BYTES])
    across = -(-width // wide)
    for i in range(across * -(-height // deep)):
        top, left = i // across * deep, i % across * wide
        rows = deep if tiled else min(deep, height - top)
        part = _plain(raw[places[i] : places[i] + sizes[i]], one(_COMPRESSION, 1))
        block = _block(part, rows, wide, samples, kind, one(_PREDICTOR, 1))
        out[top : top + deep, left : left + wide] = block[: height - top, : width - left]
    return out


def read_archive(raw: bytes) -> tuple[np.ndarray, tuple[int, int, int, int]]:
    """Raster and box of one zipped tile."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        tif, xml = members(z.namelist())
        return decode_tiff(z.read(tif)), corner_box(z.read(xml))


#: Raster values that go to Spark at once.
_VALUES = 1 << 20


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in ROWS.split(", ")]
    for batch in batches:
        for path, file_id, content in zip(*(batch.column(i) for i in range(3)), strict=True):
            path, file_id = path.as_py(), file_id.as_py()
            try:
                raster, box = read_archive(content.as_buffer().to_pybytes())
            except Exception as e:  # noqa: BLE001 - whatever a broken file raises is its row's error
                values = pa.array([None], pa.list_(pa.float64()))
                yield pa.record_batch([pa.array([x], t) for x, t in ((path, pa.string()), (file_id, pa.string()), *[(None, pa.int32())] * 6)] + [values, pa.array([f"{type(e).__name__}: {e}"])], names=names)
                continue
            height, width = raster.shape
            step = max(1, _VALUES // max(1, width))
            for top in range(0, height, step):
                part = raster[top : top + step].astype(np.float64)
                n = len(part)
                same = lambda x, t, n=n: pa.array([x] * n, t)
                values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(part.reshape(-1)))
                yield pa.record_batch(
                    [same(path, pa.string()), same(file_id, pa.string()), *[same(v, pa.int32()) for v in box], same(height, pa.int32()),
                     pa.array(np.arange(top, top + n, dtype=np.int32)), values, same(None, pa.string())],
                    names=names,
                )


def read_rasters(spark: SparkSession, folder: str, pattern: str = "*.zip") -> DataFrame:
    """``path, file_id``, the box, ``height``, and one ``row`` of ``values`` each,
    of all tiles of a folder; unreadable ones have an ``error`` instead."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", tile_id(F.col("path")).alias("file_id"), "content").mapInArrow(_rows, ROWS)


def fitting_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raster rows of tiles whose raster fills its box; the others."""
    fits = (F.col("height") == F.col("max_northing") - F.col("min_northing")) & (F.size("values") == F.col("max_easting") - F.col("min_easting"))
    fits = F.coalesce(fits & F.col("error").isNull(), F.lit(False))
    return rows.where(fits), rows.where(~fits)


def melt_rows(rows: DataFrame) -> DataFrame:
    """``easting, northing, elevation, file_id`` of every cell (S14, S15). The
    first row is the northernmost."""
    cells = rows.select("file_id", "min_easting", "max_northing", "row", F.posexplode("values").alias("col", "elevation"))
    return cells.select(
        (F.col("min_easting") + F.col("col")).cast("int").alias("easting"),
        (F.col("max_northing") - 1 - F.col("row")).cast("int").alias("northing"),
        "elevation",
        "file_id",
    )


# --------------------------------------------------------------------------
# writing, for exports and tests


def encode_tiff(raster: np.ndarray, compression: int = 8, rows: int = 64, order: str = "<") -> bytes:
    """A classic TIFF of one band in strips, plain (1) or deflated (8)."""
    height, width = raster.shape
    kind = raster.dtype.newbyteorder(order)
    strips = [raster[i : i + rows].astype(kind).tobytes() for i in range(0, height, rows)]
    strips = [zlib.compress(s) for s in strips] if compression == 8 else strips
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    places = []
    for s in strips:
        places.append(len(out))
        out += s
    n, code = len(strips), {"u": 1, "i": 2, "f": 3}[kind.kind]
    lists = len(out)
    out += struct.pack(f"{order}{2 * n}I", *places, *map(len, strips))
    fields = [(_WIDTH, 4, 1, width), (_HEIGHT, 4, 1, height), (_BITS, 3, 1, 8 * kind.itemsize), (_COMPRESSION, 3, 1, compression)]
    fields += [(_STRIPS, 4, n, lists if n > 1 else places[0]), (_SAMPLES, 3, 1, 1), (_ROWS, 4, 1, rows)]
    fields += [(_STRIP_BYTES, 4, n, lists + 4 * n if n > 1 else len(strips[0])), (_FORMAT, 3, 1, code)]
    struct.pack_into(order + "I", out, 4, len(out))
    out += struct.pack(order + "H", len(fields))
    for tag, kind_, many, value in fields:
        short = kind_ == 3
        out += struct.pack(order + ("HHIHH" if short else "HHII"), *((tag, kind_, many, value, 0) if short else (tag, kind_, many, value)))
    return bytes(out + struct.pack(order + "I", 0))


def encode_archive(raster: np.ndarray, box: tuple[int, int, int, int], name: str, compression: int = 8) -> bytes:
    """A zipped tile of a raster and its box, as ``read_archive`` takes it."""
    corners = "".join(f"<pos>{e}.000000 {n}.000000</pos>" for e in (box[0], box[2]) for n in (box[1], box[3]))
    xml = f"<metadata><spatRepInfo><Georect><cornerPts>{corners}</cornerPts></Georect></spatRepInfo></metadata>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"{name}.tfw", "1.0\n")
        z.writestr(f"{name}.tif", encode_tiff(raster, compression))
        z.writestr(f"{name}.tif.xml", xml)
    return out.getvalue()


def write_archives(tiles: DataFrame, folder: str, compression: int = 8) -> None:
    """A zipped tile ``survey-<file_id>.zip`` for each row with a box and a
    ``raster array<array>``; written by the executors."""
    uri = store_uri(tiles.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            names = []
            for r in batch.to_pylist():
                box = (r["min_easting"], r["min_northing"], r["max_easting"], r["max_northing"])
                names.append(f"survey-{r['file_id']}")
                with fs.open_output_stream(f"{root}/{names[-1]}.zip", compression=None) as out:
                    out.write(encode_archive(np.array(r["raster"], dtype=np.float32), box, names[-1], compression))
            yield pa.record_batch([pa.array(names, pa.string())], names=["name"])

    tiles.select("file_id", "min_easting", "min_northing", "max_easting", "max_northing", "raster").mapInArrow(write, "name string").count()
