import io
import struct
import zipfile
import zlib

import numpy as np
import pytest

from ridgeline.operators import elevation as el
from ridgeline.sources import raster as rt


def pack_lzw(raw):
    """TIFF's LZW, by the rule: clear, codes, end; widths grow a code early."""
    out, held, bits = bytearray(), 0, 0

    def put(code, width):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)

    table, width, last = {bytes([i]): i for i in range(256)}, 9, b""
    put(256, width)
    for i in range(len(raw)):
        nxt = last + raw[i : i + 1]
        if nxt in table:
            last = nxt
            continue
        put(table[last], width)
        table[nxt] = len(table) + 2
        n = len(table) + 2
        width = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
        if n == 4095:
            put(256, 12)
            table, width = {bytes([j]): j for j in range(256)}, 9
        last = raw[i : i + 1]
    if last:
        put(table[last], width)
    put(257, width)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def tiff(data, order="<", compression=1, predictor=1, tile=None, rows=None, big=False, planes=1):
    """A TIFF of ``data`` (height, width, samples), written field by field."""
    height, width, samples = data.shape
    kind = data.dtype.newbyteorder(order)
    if tile:
        deep, wide = tile
        padded = np.zeros((-(-height // deep) * deep, -(-width // wide) * wide, samples), data.dtype)
        padded[:height, :width] = data
        blocks = [padded[i : i + deep, j : j + wide] for i in range(0, padded.shape[0], deep) for j in range(0, padded.shape[1], wide)]
    else:
        rows = rows or height
        bands = [data] if planes == 1 else [data[:, :, k : k + 1] for k in range(samples)]
        blocks = [b[i : i + rows] for b in bands for i in range(0, height, rows)]
    parts = []
    for b in blocks:
        if predictor == 2:
            whole = b.view(f"u{kind.itemsize}").astype(f"u{kind.itemsize}")
            d = whole.copy()
            d[:, 1:] -= whole[:, :-1]
            raw = d.astype(f"{order}u{kind.itemsize}").tobytes()
        elif predictor == 3:
            n = b.shape[2]
            planes_ = b.astype(kind.newbyteorder(">")).reshape(len(b), -1).view(np.uint8).reshape(len(b), -1, kind.itemsize).transpose(0, 2, 1).reshape(len(b), -1)
            d = planes_.copy()
            d[:, n:] -= planes_[:, :-n]
            raw = d.tobytes()
        else:
            raw = b.astype(kind).tobytes()
        parts.append({1: lambda x: x, 5: pack_lzw, 8: zlib.compress}[compression](raw))
    head = struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)
    out = bytearray((b"II" if order == "<" else b"MM") + head)
    places = []
    for p in parts:
        places.append(len(out))
        out += p
    code = {"u": 1, "i": 2, "f": 3}[kind.kind]
    fields = [(256, 3, [width]), (257, 3, [height]), (258, 3, [8 * kind.itemsize] * samples), (259, 3, [compression]), (277, 3, [samples]), (284, 3, [planes]), (317, 3, [predictor]), (339, 3, [code] * samples)]
    fields += [(322, 3, [tile[1]]), (323, 3, [tile[0]]), (324, 4, places), (325, 4, list(map(len, parts)))] if tile else [(273, 4, places), (278, 3, [rows]), (279, 4, list(map(len, parts)))]
    entries, room = [], "Q" if big else "I"
    for tag, t, values in sorted(fields):
        raw = struct.pack(f"{order}{len(values)}{'H' if t == 3 else 'I'}", *values)
        if len(raw) > struct.calcsize(room):
            at = len(out)
            out += raw
            raw = struct.pack(order + room, at)
        entries.append(struct.pack(order + "HH" + room, tag, t, len(values)) + raw.ljust(struct.calcsize(room), b"\0"))
    struct.pack_into(order + room, out, 8 if big else 4, len(out))
    out += struct.pack(order + ("Q" if big else "H"), len(entries)) + b"".join(entries) + struct.pack(order + room, 0)
    return bytes(out)


RND = np.random.default_rng(5)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression", [1, 5, 8])
@pytest.mark.parametrize(
    "kind,predictor,how",
    [
        ("f4", 1, {"rows": 7}), ("f4", 3, {"rows": 5}), ("f4", 3, {"tile": (16, 32)}), ("i2", 2, {"rows": 4}), ("u1", 2, {"tile": (16, 16)}),
        ("f8", 1, {"big": True}), ("u2", 1, {"rows": 3, "big": True}), ("i4", 2, {"rows": 50}), ("f8", 3, {"rows": 9}),
    ],
)
def test_decodes_what_is_written(order, compression, kind, predictor, how):
    smooth = np.add.outer(np.arange(41) * 3, np.arange(53) * 2) % 200
    data = (smooth + RND.integers(0, 3, smooth.shape)).astype(kind)[:, :, None]
    if kind[0] == "f":
        data = data + np.array(0.25, dtype=kind)
    got = rt.decode_tiff(tiff(data, order, compression, predictor, **how))
    assert got.dtype == np.dtype(kind) and (got == data[:, :, 0]).all()


def test_first_band_of_several():
    data = RND.integers(0, 60_000, (20, 15, 3)).astype("u2")
    for how in ({}, {"predictor": 2}, {"rows": 6}, {"tile": (16, 16), "predictor": 2}, {"planes": 2, "rows": 20}):
        assert (rt.decode_tiff(tiff(data, **how)) == data[:, :, 0]).all(), how
    floats = data.astype("f4")
    assert (rt.decode_tiff(tiff(floats, predictor=3)) == floats[:, :, 0]).all()


def test_lzw_fills_its_table():
    raw = RND.integers(0, 256, 60_000).astype("u1").tobytes() + b"ab" * 5000
    assert rt.unpack_lzw(pack_lzw(raw)) == raw


def test_members_and_box():
    assert rt.members(["a.txt", "x/b.tif", "c.tif", "b.tif.xml", "d.xml"]) == ("x/b.tif", "b.tif.xml")
    for names in (["a.tif"], ["a.xml"], []):
        with pytest.raises(ValueError):
            rt.members(names)
    xml = "<m><spatRepInfo><Georect><cornerPts><pos>85000.000000 4000.000000</pos><pos>90000.0 9000.0</pos></cornerPts></Georect></spatRepInfo></m>"
    assert rt.corner_box(xml) == (85000, 4000, 90000, 9000)
    with pytest.raises(ValueError):
        rt.corner_box("<m/>")


def test_folder_of_zipped_tiles(spark, tmp_path):
    good = np.arange(12, dtype="f4").reshape(3, 4)
    box = (100, 200, 104, 203)
    files = {"survey-SU41ne.zip": rt.encode_archive(good, box, "a"), "survey-SU41nw.zip": rt.encode_archive(good, (0, 0, 5, 5), "b"), "survey-SU41se.zip": b"no zip", "other.txt": b""}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    with zipfile.ZipFile(io.BytesIO(files["survey-SU41ne.zip"])) as z:
        assert rt.members(z.namelist()) == ("a.tif", "a.tif.xml")
    rows = rt.read_rasters(spark, str(tmp_path))
    fit, rest = rt.fitting_rows(rows)
    got = sorted((r.northing, r.easting, r.elevation) for r in rt.melt_rows(fit).collect())
    assert got == sorted((202 - i, 100 + j, float(good[i, j])) for i in range(3) for j in range(4))
    assert {(r.file_id, r.error is None) for r in rest.collect()} == {("SU41nw", True), ("SU41se", False)}
    assert rt.read_rasters(spark, str(tmp_path), "*.none").count() == 0


def test_overlapping_tiles_give_a_cell_once(spark):
    """Where tiles overlap, nodes and samples are not multiplied; tiles out of
    the way are not read."""
    cells = [("a", e, n, 1.0) for e in range(20) for n in range(20)] + [("b", e, n, 3.0) for e in range(10, 30) for n in range(20)] + [("far", e, 5000, None) for e in range(9)]
    elevation = spark.createDataFrame(cells, "file_id string, easting int, northing int, elevation double")
    bounds = spark.createDataFrame([("a", 0, 0, 20, 20), ("b", 10, 0, 30, 20), ("far", 0, 5000, 9, 5001)], "file_id string, min_easting int, min_northing int, max_easting int, max_northing int")
    nodes = spark.createDataFrame([(1, 5, 5), (2, 15, 5), (3, 25, 5), (4, 999, 999)], "id long, easting int, northing int")
    near = el.cells_around(el.squares_of_points(nodes), elevation, bounds)
    assert near.count() == 600
    got = el.node_elevation(nodes, near).collect()
    assert sorted((r.id, r.elevation) for r in got) == [(1, 1.0), (2, 1.0), (3, 3.0), (4, None)]
    edges = spark.createDataFrame([(1, 3, 1, 0, 5, 5, 25, 5)], "src long, dst long, way_id long, way_inx int, src_easting int, src_northing int, dst_easting int, dst_northing int")
    along = el.cells_around(el.squares_of_edges(edges), elevation, bounds)
    assert [r.elevation for r in el.tag_edges(edges, along).collect()] == [[1.0, 1.0, 3.0]]
