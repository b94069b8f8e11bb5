"""Raw map extracts in the binary map format.

An extract is a sequence of blobs, each a small header and some thousand nodes
or ways, compressed on its own. One task walks the headers and notes where every
blob lies; then all tasks decode blobs side by side from byte ranges, so a file
of any size is read in parallel. Packed numbers are decoded with numpy.

Field numbers are those of the published format. Nodes come dense or one by
one; relations are skipped. Blobs are plain or deflated. The rows have the
columns that ``ingest`` takes; timestamps are seconds, NULL where the extract
has none. A required feature other than the two that every extract names, or a
truncated file, is an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.runtime import materialize, store_uri

TAGS = "array<struct<key:binary,value:binary>>"
NODES = f"id long, latitude double, longitude double, timestamp long, tags {TAGS}"
WAYS = f"id long, tags {TAGS}, timestamp long, nodes array<struct<index:int,nodeId:long>>"
KNOWN_FEATURES = {b"OsmSchema-V0.6", b"DenseNodes"}
#: Bytes of blobs that one task takes, about.
STRETCH = 32 << 20


def locate(spark: SparkSession, folder: str) -> str:
    """The one extract of a folder; none or several are an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
    found = [n for n in names if n.endswith(".osm.pbf")]
    if not found:
        raise FileNotFoundError(f"{folder}: no *.osm.pbf")
    if len(found) > 1:
        raise ValueError(f"{folder}: several extracts, {', '.join(found)}")
    return f"{folder.rstrip('/')}/{found[0]}"


# --------------------------------------------------------------------------
# messages


def _number(raw: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = raw[at]
        out |= (b & 127) << shift
        at += 1
        if b < 128:
            return out, at
        shift += 7


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a message; lengths give bytes."""
    at = 0
    while at < len(raw):
        key, at = _number(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _number(raw, at)
        elif kind == 2:
            n, at = _number(raw, at)
            value, at = raw[at : at + n], at + n
            if len(value) != n:
                raise ValueError("truncated message")
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = raw[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def packed(raw: bytes) -> np.ndarray:
    """Numbers of a packed field, as uint64."""
    b = np.frombuffer(raw, dtype=np.uint8)
    if not len(b):
        return np.empty(0, dtype=np.uint64)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), first)


def signed(x: np.ndarray) -> np.ndarray:
    """Zigzag numbers as int64."""
    return ((x >> np.uint64(1)) ^ (np.uint64(0) - (x & np.uint64(1)))).view(np.int64)


def _deltas(raw: bytes) -> np.ndarray:
    return np.cumsum(signed(packed(raw)))


def _collect(raw: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for f, v in fields(raw):
        out.setdefault(f, []).append(v)
    return out


def _one(m: dict[int, list], f: int, default):
    return m[f][-1] if f in m else default


def _int(v: int) -> int:
    """A plain varint as a signed 64-bit number."""
    return v - (1 << 64) if v >= 1 << 63 else v


class Block:
    """A block of primitives: its strings and scales."""

    def __init__(self, raw: bytes):
        m = _collect(raw)
        self.strings = [v for f, v in fields(_one(m, 1, b"")) if f == 1]
        self.groups = [_collect(g) for g in m.get(2, [])]
        self.scale = _one(m, 17, 100)
        self.lat0, self.lon0 = _int(_one(m, 19, 0)), _int(_one(m, 20, 0))
        self.per_second = 1000 / _one(m, 18, 1000)

    def _degrees(self, x, zero: int):
        return (zero + self.scale * x) * 1e-9

    def _seconds(self, x: int) -> int:
        return int(x / self.per_second)

    def _tags(self, keys, values) -> list[dict]:
        return [{"key": self.strings[k], "value": self.strings[v]} for k, v in zip(keys, values, strict=True)]

    def _info(self, m: dict, f: int) -> int | None:
        info = _collect(_one(m, f, b""))
        return self._seconds(_int(info[2][-1])) if 2 in info else None

    def nodes(self) -> Iterator[tuple]:
        for g in self.groups:
            for raw in g.get(1, []):
                m = _collect(raw)
                lat, lon = (int(signed(np.array([_one(m, f, 0)], dtype=np.uint64))[0]) for f in (8, 9))
                tags = self._tags(packed(_one(m, 2, b"")).tolist(), packed(_one(m, 3, b"")).tolist())
                yield int(signed(np.array([_one(m, 1, 0)], dtype=np.uint64))[0]), self._degrees(lat, self.lat0), self._degrees(lon, self.lon0), self._info(m, 4), tags
            for raw in g.get(2, []):
                yield from self._dense(_collect(raw))

    def _dense(self, m: dict) -> Iterator[tuple]:
        ids = _deltas(_one(m, 1, b"")).tolist()
        lats = self._degrees(_deltas(_one(m, 8, b"")), self.lat0).tolist()
        lons = self._degrees(_deltas(_one(m, 9, b"")), self.lon0).tolist()
        info = _collect(_one(m, 5, b""))
        when = [self._seconds(t) for t in _deltas(_one(info, 2, b"")).tolist()] or [None] * len(ids)
        tags: list[list] = [[] for _ in ids]
        pairs, at, i = packed(_one(m, 10, b"")).tolist(), 0, 0
        while at < len(pairs):
            if pairs[at] == 0:
                at, i = at + 1, i + 1
            else:
                tags[i].append({"key": self.strings[pairs[at]], "value": self.strings[pairs[at + 1]]})
                at += 2
        yield from zip(ids, lats, lons, when, tags, strict=True)

    def ways(self) -> Iterator[tuple]:
        for g in self.groups:
            for raw in g.get(3, []):
                m = _collect(raw)
                tags = self._tags(packed(_one(m, 2, b"")).tolist(), packed(_one(m, 3, b"")).tolist())
                refs = _deltas(_one(m, 8, b"")).tolist()
                yield _int(_one(m, 1, 0)), tags, self._info(m, 4), [{"index": i, "nodeId": n} for i, n in enumerate(refs)]


def unpack_blob(raw: bytes) -> bytes:
    m = _collect(raw)
    if 1 in m:
        return m[1][-1]
    if 3 in m:
        return zlib.decompress(m[3][-1])
    raise ValueError("blob compression is neither none nor deflate")


def blobs(f, size: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, offset and length of every blob of an open file."""
    at = 0
    while at < size:
        f.seek(at)
        head = f.read(4)
        if len(head) < 4:
            raise ValueError("truncated file")
        (n,) = struct.unpack(">I", head)
        m = _collect(f.read(n))
        length = _one(m, 3, 0)
        at += 4 + n
        if at + length > size:
            raise ValueError("truncated file")
        yield _one(m, 1, b""), at, length
        at += length


# --------------------------------------------------------------------------
# reading


def _ranges(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, root = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(f"{root}/{name}") as f:
                    found = []
                    for kind, at, n in blobs(f, f.size()):
                        if kind == b"OSMHeader":
                            f.seek(at)
                            other = {v for k, v in fields(unpack_blob(f.read(n))) if k == 4} - KNOWN_FEATURES
                            if other:
                                raise ValueError(f"the extract requires {sorted(other)}")
                        elif kind == b"OSMData":
                            found.append((name, at, n))
                if found:
                    cols = zip(*found, strict=True)
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["name", "at", "length"])

    return run


def _decoder(uri: str, kind: str, types: list[pa.DataType], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for name, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    f.seek(at)
                    block = Block(unpack_blob(f.read(n)))
                rows = list(getattr(block, kind)())
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


_TAGS = pa.list_(pa.struct([("key", pa.binary()), ("value", pa.binary())]))
_REFS = pa.list_(pa.struct([("index", pa.int32()), ("nodeId", pa.int64())]))


def read_extract(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and ways of the one extract of a folder, as ``NODES`` and ``WAYS``."""
    path = locate(spark, folder)
    uri, name = store_uri(spark, path.rpartition("/")[0]), path.rpartition("/")[2]
    one = spark.createDataFrame([(name,)], "name string").coalesce(1)
    found = materialize(one.mapInArrow(_ranges(uri), "name string, at long, length long"), "blobs")
    total = found.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, min(-(-total // STRETCH) * 4, found.count()))
    dealt = found.repartition(tasks, "at").select("name", "at", "length")
    nodes = dealt.mapInArrow(_decoder(uri, "nodes", [pa.int64(), pa.float64(), pa.float64(), pa.int64(), _TAGS], ["id", "latitude", "longitude", "timestamp", "tags"]), NODES)
    ways = dealt.mapInArrow(_decoder(uri, "ways", [pa.int64(), _TAGS, pa.int64(), _REFS], ["id", "tags", "timestamp", "nodes"]), WAYS)
    return nodes, ways


# --------------------------------------------------------------------------
# writing, for exports and tests


def varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def message(*parts: tuple[int, int | bytes]) -> bytes:
    """A message of numbered fields, ints as varints."""
    out = bytearray()
    for f, v in parts:
        out += varint(f << 3) + varint(v) if isinstance(v, int) else varint(f << 3 | 2) + varint(len(v)) + v
    return bytes(out)


def _pack(values) -> bytes:
    return b"".join(varint(v) for v in values)


def _zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def _pack_deltas(values) -> bytes:
    last, out = 0, []
    for v in values:
        out.append(_zigzag(v - last))
        last = v
    return _pack(out)


def encode_block(nodes: list[tuple], ways: list[tuple]) -> bytes:
    """A block of dense nodes and ways; rows as ``Block`` gives them."""
    strings: dict[bytes, int] = {b"": 0}
    number = lambda s: strings.setdefault(s, len(strings))
    groups = []
    if nodes:
        pairs = []
        for *_, tags in nodes:
            for t in tags:
                pairs += [number(t["key"]), number(t["value"])]
            pairs.append(0)
        degrees = lambda i: _pack_deltas([round(r[i] * 1e7) for r in nodes])
        info = [(5, message((2, _pack_deltas([r[3] for r in nodes]))))] if all(r[3] is not None for r in nodes) else []
        groups.append(message((2, message((1, _pack_deltas([r[0] for r in nodes])), *info, (8, degrees(1)), (9, degrees(2)), (10, _pack(pairs))))))
    if ways:
        one = lambda i, tags, when, refs: message(
            (1, i), (2, _pack(number(t["key"]) for t in tags)), (3, _pack(number(t["value"]) for t in tags)),
            *([(4, message((2, when)))] if when is not None else []), (8, _pack_deltas([r["nodeId"] for r in refs])),
        )
        groups.append(b"".join(message((3, one(*w))) for w in ways))
    return message((1, message(*[(1, s) for s in strings])), *[(2, g) for g in groups])


def encode_blob(kind: bytes, raw: bytes, deflate: bool = True) -> bytes:
    blob = message((2, len(raw)), (3, zlib.compress(raw))) if deflate else message((1, raw))
    head = message((1, kind), (3, len(blob)))
    return struct.pack(">I", len(head)) + head + blob


def header_blob() -> bytes:
    return encode_blob(b"OSMHeader", message(*[(4, f) for f in sorted(KNOWN_FEATURES)]))


def write_extract(nodes: DataFrame, ways: DataFrame, folder: str, name: str = "area", rows: int = 8000) -> str:
    """An extract of nodes and ways: tasks encode blocks side by side, then one
    puts them into the file, which it only copies."""
    spark = nodes.sparkSession
    uri = store_uri(spark, folder)

    def encode(kind: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, rows):
                    part = [tuple(r.values()) for r in batch.slice(lo, rows).to_pylist()]
                    raw = encode_block(part if kind == "nodes" else [], part if kind == "ways" else [])
                    yield pa.record_batch([pa.array([int(kind == "ways")], pa.int32()), pa.array([encode_blob(b"OSMData", raw)], pa.binary())], names=["kind", "blob"])

        return run

    schema = "kind int, blob binary"
    encoded = nodes.select("id", "latitude", "longitude", "timestamp", "tags").mapInArrow(encode("nodes"), schema)
    encoded = encoded.unionByName(ways.select("id", "tags", "timestamp", "nodes").mapInArrow(encode("ways"), schema))
    stored = materialize(encoded, "encoded")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{name}.osm.pbf", compression=None) as out:
            out.write(header_blob())
            for batch in batches:
                for blob in batch.column(1):
                    out.write(blob.as_buffer())
        yield pa.record_batch([pa.array([name], pa.string())], names=["name"])

    stored.coalesce(1).mapInArrow(put, "name string").count()
    return f"{folder.rstrip('/')}/{name}.osm.pbf"
