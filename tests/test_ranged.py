"""Files read by ranges: what comes out, what is turned away, and how many bytes are read."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyarrow import fs

from fathomline.sources import ranged


def png(width, height, bits=16, colour=0, tail=0, interlace=0):
    body = struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, interlace)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + body + struct.pack(">I", zlib.crc32(b"IHDR" + body)) + b"x" * tail


class Counting:
    """A local store that counts the bytes read of its files."""

    def __init__(self):
        self.bytes, self.local = 0, fs.LocalFileSystem()

    def open_input_file(self, path):
        store, f = self, open(path, "rb")

        class Raw:
            closed = False

            def read(self, n=-1):
                data = f.read(n)
                store.bytes += len(data)
                return data

            def read_at(self, n, at):
                f.seek(at)
                return self.read(n)

            def seek(self, *a):
                return f.seek(*a)

            def tell(self):
                return f.tell()

            def seekable(self):
                return True

            def __enter__(self):
                return self

            def __exit__(self, *a):
                f.close()

        return Raw()


def counted(reader, root):
    store, rows = Counting(), []
    for part in reader.partitions():
        for file in part.files:
            rows += reader.rows(store, *file)
    return rows, store.bytes


def test_png_headers(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b/frame_000002.png").write_bytes(png(640, 480, tail=100_000))
    (tmp_path / "frame_000001.PNG").write_bytes(png(64, 48, 8, 2))
    (tmp_path / "bad_3.png").write_bytes(b"short")
    (tmp_path / "odd_4.png").write_bytes(png(1, 1, 8, 5, interlace=2))
    (tmp_path / "notes.txt").write_bytes(b"no")
    got = {os.path.basename(r.path): (r.frame_idx, r.length, r.width, r.height, r.bit_depth, r.channels) for r in ranged.read_png_headers(spark, f"file://{tmp_path}", filesPerPartition="2").collect()}
    assert got == {"frame_000002.png": (2, 100_033, 640, 480, 16, 1), "frame_000001.PNG": (1, 33, 64, 48, 8, 3), "bad_3.png": (3, 5, None, None, None, None), "odd_4.png": (4, 33, None, None, None, None)}
    assert ranged.read_png_headers(spark, str(tmp_path)).count() == 4
    (tmp_path / "none").mkdir()
    assert ranged.read_png_headers(spark, f"file://{tmp_path}/none").count() == 0


def test_29_bytes_a_file(tmp_path):
    for i in range(5):
        (tmp_path / f"f_{i}.png").write_bytes(png(8, 8, tail=50_000))
    rows, read = counted(ranged.PngHeaderReader({"path": str(tmp_path)}), tmp_path)
    assert len(rows) == 5 and read == 5 * 29


def test_partitions_are_even(tmp_path):
    for i in range(25):
        (tmp_path / f"f_{i}.png").write_bytes(png(8, 8))
    parts = ranged.PngHeaderReader({"path": str(tmp_path), "filesPerPartition": "10"}).partitions()
    assert sorted(len(p.files) for p in parts) == [8, 8, 9]


def test_raw_maps_are_widened_and_held_to_what_is_stated(spark, tmp_path):
    half, single = np.arange(6, dtype="<f2").reshape(2, 3) / 3, np.arange(6, dtype="<f4").reshape(2, 3)
    np.savez_compressed(tmp_path / "d_1.npz", values=half)
    np.savez(tmp_path / "d_2.npz", values=single, other=np.ones(9))
    got = {r.frame_idx: r for r in ranged.read_npz_maps(spark, f"file://{tmp_path}", shape="2x3").collect()}
    assert got[1]["values"] == half.astype(np.float32).ravel().tolist() and got[1].dtype == "<f2" and got[2].shape == [2, 3]
    assert [r["values"] for r in ranged.read_npz_maps(spark, f"file://{tmp_path}", headers="true").collect()] == [None, None]
    for options, why in (({"shape": "3x2"}, "shape 2x3"), ({"dtype": "<f4"}, "d_1.npz: type <f2")):
        with pytest.raises(Exception, match=why):
            ranged.read_npz_maps(spark, f"file://{tmp_path}", **options).collect()


@pytest.mark.parametrize("make, why", [(lambda p: np.savez(p, v=np.ones((2, 2))), "values"), (lambda p: np.savez(p, values=np.ones((2, 2))), "type <f8"), (lambda p: np.savez(p, values=np.ones(4, "<f4")), "shape 4"), (lambda p: p.write_bytes(b"nothing"), "d_1.npz")])
def test_files_that_are_not_as_stated(tmp_path, make, why):
    make(tmp_path / "d_1.npz")
    with pytest.raises(ValueError, match=why):
        counted(ranged.NpzMapReader({"path": str(tmp_path)}), tmp_path)


def test_metric_maps(spark, tmp_path):
    valid = np.array([[True, False], [True, True]])
    good = dict(inverse_depth=np.where(valid, 0.5, 0).astype("<f4"), valid=valid, focal_x_normalized=np.float32(0.8))
    np.savez_compressed(tmp_path / "m_7.npz", **good)
    r = ranged.read_npz_maps(spark, f"file://{tmp_path}", kind="metric").first()
    assert (r.frame_idx, r.shape, r.valid, r.inverse_depth) == (7, [2, 2], [True, False, True, True], [0.5, 0.0, 0.5, 0.5]) and r.focal_x_normalized == pytest.approx(0.8)
    for change in ({"focal_x_normalized": np.float32(0)}, {"focal_x_normalized": np.float32("nan")}, {"valid": valid[:1]}, {"inverse_depth": np.full((2, 2), 0.5, "<f4")}, {"inverse_depth": np.full((2, 2), np.inf, "<f4")}, {"inverse_depth": np.zeros((2, 2), "<f4")}):
        np.savez(tmp_path / "m_7.npz", **{**good, **change})
        with pytest.raises(ValueError, match="m_7.npz"):
            counted(ranged.NpzMapReader({"path": str(tmp_path), "kind": "metric"}), tmp_path)


def test_only_the_member_asked_for_is_read(tmp_path):
    np.savez(tmp_path / "d_1.npz", big=np.zeros(2_000_000), values=np.ones((4, 4), "<f4"))
    rows, read = counted(ranged.NpzMapReader({"path": str(tmp_path)}), tmp_path)
    assert len(rows) == 1 and read < 20_000 < os.path.getsize(tmp_path / "d_1.npz")
    np.savez(tmp_path / "d_1.npz", values=np.ones((1000, 1000), "<f4"))
    assert counted(ranged.NpzMapReader({"path": str(tmp_path), "headers": "true"}), tmp_path)[1] < 20_000


def test_shots_are_verified_by_the_hashes_of_their_files(spark, tmp_path):
    import hashlib

    for i in range(6):
        (tmp_path / f"f_{i}.png").write_bytes(bytes([i]) * (i * 1000))
    digest = lambda i: hashlib.sha256(bytes([i]) * (i * 1000)).hexdigest()
    files = ranged.read_file_hashes(spark, f"file://{tmp_path}", extensions=".png", chunkBytes="700", filesPerPartition="2")
    assert {r.name: r.sha256 for r in files.collect()} == {f"f_{i}.png": digest(i) for i in range(6)}
    rows = [(i // 2, f"f_{i}.png", digest(i)) for i in range(6)] + [(3, "f_9.png", "x"), (3, "f_5.png", digest(5)), (4, "f_0.png", "x"), (4, "f_9.png", "x")]
    (tmp_path / "f_3.png").write_bytes(b"other")
    got = {r.shot: (r.state, r.reason) for r in ranged.verified_shots(spark.createDataFrame(rows, "shot int, name string, sha256 string"), files, ["shot"]).collect()}
    assert got == {0: ("reusable", "files match"), 1: ("invalid", "hash mismatch: f_3.png"), 2: ("reusable", "files match"), 3: ("pending", "files are absent"), 4: ("invalid", "hash mismatch: f_0.png")}
