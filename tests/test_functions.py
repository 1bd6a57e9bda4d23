"""Literal cases of the column functions."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from fathomline.functions import depth, geometry, text
from fathomline.plans import catalogue as cat
from fathomline.sources import frames as src
from fathomline.streaming import progress


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def s(value):
    return F.lit(value).cast("string")


def test_scores_and_codes(spark):
    kinds = [("metric_depth", 4.0, 0.25), ("metric_depth", 0.0, None), ("inverse_depth", 3.0, 3.0), ("relative_depth", 2.0, -2.0)]
    assert one(spark, *[depth.score(F.lit(x), F.lit(k)) for k, x, _ in kinds]) == tuple(w for *_, w in kinds)
    assert one(spark, depth.canonical(F.lit(3.0), F.lit(2.0), F.lit(4.0)), depth.canonical(F.lit(3.0), F.lit(2.0), F.lit(2.0)), depth.canonical(F.lit(float("nan")), F.lit(0.0), F.lit(1.0))) == (0.5, 0.5, 0.5)
    assert one(spark, depth.encode(F.lit(0.5)), depth.encode(F.lit(2.0)), depth.encode(F.lit(-1.0))) == (32768, 65535, 0)
    assert one(spark, depth.clip01(F.lit(None).cast("double"))) == (None,)


def test_metric_inverse(spark):
    values = [2.0, 0.0, float("inf"), 4.0, -1.0, 1e-45]
    assert one(spark, *[depth.inverse_metric(F.lit(v)) for v in values]) == (0.5, None, None, 0.25, None, None)


def test_lanes_and_bounds(spark):
    assert one(spark, depth.lane_offset(F.lit(1.0)), depth.lane_offset(F.lit(0.5), -1)) == (16, -8)
    assert one(spark, depth.bounded(F.lit(1.0000001), 0.0, 1.0, 1e-6), depth.bounded(F.lit(-0.0), 0.0, 1.0, 1e-6)) == (1.0, 0.0)
    with pytest.raises(Exception, match="out of its bounds"):
        one(spark, depth.bounded(F.lit(2.0), 0.0, 1.0, 1e-6))


def test_clock(spark):
    assert one(spark, *[text.clock_seconds(s(t)) for t in ("1:30", "01:05:30", "90", "a:b", None)]) == (90, 3930, None, None, None)
    a, b = text.frame_range(F.lit(1000), F.lit(30.0), s("0:10"), s("0:20"))
    assert one(spark, a, b) == (300, 600)
    assert one(spark, text.clock_text(F.lit(3661)), text.clock_text(F.lit(90.5)), text.remaining_text(F.lit(323)), text.remaining_text(F.lit(8100))) == ("01:01:01", "00:01:30", "5m 23s", "2h 15m")


def test_names(spark):
    assert one(spark, text.frame_name(F.lit(42)), text.safe_name(s("my<video>.mp4")), text.safe_name(s("___test___.txt"))) == ("frame_000042.png", "my_video_.mp4", "test_.txt")
    long = "x" * 250 + ".txt"
    assert one(spark, text.safe_name(s(long))) == ("x" * 196 + ".txt",)
    assert one(spark, text.output_name(s("myvideo"), s("side_by_side"), s("1080p")), text.output_name(s("a"), s("over_under"), s(None))) == ("myvideo_3D_side-by-side_1080p.mp4", "a_3D_over-under.mp4")
    assert one(spark, text.frame_index(s("frame_000007.png")), text.frame_index(s("frame_7.png"))) == (7, None)


def test_sizes(spark):
    assert one(spark, *[text.size_text(F.lit(n)) for n in (0, 1023, 1536, 1 << 30, 1 << 50)]) == ("0 B", "1023 B", "1.5 KB", "1.0 GB", "1024.0 TB")
    assert one(spark, *text.sample_aspect(s("40:30")), *text.sample_aspect(s(None)), *text.sample_aspect(s("0:1"))) == (4, 3, 1, 1, None, None)
    assert one(spark, *text.custom_size(s("custom:1920x1080")), *text.custom_size(s("custom:0x5")), *text.custom_size(s("1x1"))) == (1920, 1080, None, None, None, None)
    assert one(spark, geometry.depth_input_size(F.lit(3840), F.lit(2160)), geometry.depth_input_size(F.lit(320), F.lit(200))) == (2160, 320)
    assert one(spark, geometry.auto_preset(F.lit(4096), F.lit(1716)), geometry.auto_preset(F.lit(1920), F.lit(1080)), geometry.auto_preset(F.lit(100), F.lit(0))) == ("cinema-2k", "16x9-1080p", "square-1k")


def test_png_header(spark):
    body = struct.pack(">IIBBBBB", 640, 480, 16, 2, 0, 0, 0)
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + body + struct.pack(">I", zlib.crc32(b"IHDR" + body))
    df = spark.createDataFrame([(bytearray(png),), (bytearray(b"nope"),), (bytearray(png[:24] + b"\x10\x02\x01\x00\x00" + png[29:]),), (None,)], "b binary")
    got = [r[0] and tuple(r[0]) for r in df.select(src.png_header(F.col("b"))).collect()]
    assert got == [(640, 480, 16, 3), None, None, None]


def test_plan_and_progress(spark):
    plan = lambda kind, base, stable: tuple(one(spark, cat.execution_plan(s(kind), F.lit(base), F.lit(stable)))[0])
    assert plan("off", True, False) == (True, False, False, "base")
    assert plan("off", False, True) == (False, True, False, "base")
    assert plan("temporal", False, True) == (True, False, False, "stabilized")
    assert plan("temporal", False, False) == (False, True, True, "stabilized")
    with pytest.raises(Exception, match="unknown post-processor"):
        plan("other", True, True)
    left = lambda *x: one(spark, cat.remaining_seconds(*[F.lit(v) for v in x]))[0]
    assert left(0.0, 10.0, 1, 10, 5.0, True) is None
    assert left(50.0, 10.0, 5, 10, 5.0, True) == pytest.approx(5.0 * 0.8 + 10.0 * 0.2)
    assert left(50.0, 10.0, 0, 10, 5.0, False) == pytest.approx(10.0)
    assert one(spark, progress.encoder_frame(s("frame= 12 fps=3"), F.lit(10)), progress.encoder_frame(s("x"), F.lit(10))) == (10, None)


def test_content_samples(spark):
    """Sizes on either side of one and two MiB: all of a content up to two, its ends beyond."""
    import hashlib

    mib = 1 << 20
    sizes = [0, 1, mib, mib + 1, 2 * mib, 2 * mib + 1]
    bodies = [bytes(range(256)) * (n // 256) + b"x" * (n % 256) for n in sizes]
    got = spark.createDataFrame(list(enumerate([*bodies, None])), "i int, b binary").coalesce(1).select("i", text.content_sample_hash("b").alias("h")).orderBy("i").collect()
    want = [hashlib.blake2b(n.to_bytes(16, "big") + (b if n <= 2 * mib else b[:mib] + b[-mib:]), digest_size=16).hexdigest() for n, b in zip(sizes, bodies)]
    assert [r.h for r in got] == [*want, None]
