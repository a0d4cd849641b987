import glob
import hashlib
import struct
import zlib

import pytest

from mailframe.llm import media


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 20000])
def test_png_round_trip(n):
    samples = media.pad(bytes(i * 7 % 256 for i in range(n)))
    assert len(samples) % 576 == 0 and len(samples) >= 576
    assert media.decode_png(media.encode_png(samples)) == samples


def test_archive_against_brute_force(spark, tmp_path):
    texts = [(1, b"abc"), (2, None), (None, "é🎉".encode() * 9000), (1, b"abc"), (3, b""), (4, b"x" * 576)]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "id long, payload binary, media string")
    media.write_media(df, f"file://{tmp_path}/a")
    got = sorted(media.features(media.read_media(spark, f"file://{tmp_path}/a", rangeBytes=100)).collect(), key=str)
    want = []
    for i, t in texts:
        p = media.pad(t or b"")
        want.append((i, len(t or b""), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)


def test_a_bad_member_is_retried_then_reported(spark, tmp_path):
    media.write_media(spark.createDataFrame([(1, b"abc"), (2, b"def")], "id long, payload binary").coalesce(1), f"file://{tmp_path}/b")
    [path] = glob.glob(f"{tmp_path}/b/*.marc")
    data = bytearray(open(path, "rb").read())
    data[-3] ^= 1
    open(path, "wb").write(data)
    rows = {r.id: r for r in media.read_media(spark, f"file://{tmp_path}/b", retries=2).collect()}
    assert rows[1].media and rows[1].retries == 0
    assert rows[2].media is None and rows[2].retries == 2


def test_empty_table(spark, tmp_path):
    media.write_media(spark.createDataFrame([], "id long, payload binary"), f"file://{tmp_path}/c")
    assert media.features(media.read_media(spark, f"file://{tmp_path}/c")).count() == 0


def plain_png(data):
    """An independent reader: width, height, depth, colour type and the bytes of all rows, any filter but 0 refused."""
    assert data[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    chunks, at = [], 8
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        assert zlib.crc32(data[at + 4 : at + 8 + n]) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        chunks.append((data[at + 4 : at + 8], data[at + 8 : at + 8 + n]))
        at += 12 + n
    assert chunks[0][0] == b"IHDR" and chunks[-1] == (b"IEND", b"")
    width, height, depth, colour = struct.unpack(">IIBB", chunks[0][1][:10])
    raw = zlib.decompress(b"".join(c for k, c in chunks if k == b"IDAT"))
    rows = [raw[i : i + width + 1] for i in range(0, len(raw), width + 1)]
    assert len(rows) == height and all(r[0] == 0 for r in rows)
    return width, height, depth, colour, b"".join(r[1:] for r in rows)


@pytest.mark.parametrize("n", [0, 1, 576, 577, 54_000])
def test_images_are_what_another_reader_reads(n):
    payload = bytes((i * i) % 251 for i in range(n))
    padded = payload + b"\xff" * (-n % 576 or (576 if n == 0 else 0))
    assert plain_png(media.encode_png(media.pad(payload))) == (576, len(padded) // 576, 8, 0, padded)


def test_appends_add_up_and_overwrite_replaces(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    frame = lambda lo, hi: spark.createDataFrame([(i, bytes([i]) * 700, "x", 1) for i in range(lo, hi)], "id long, payload binary, media string, archive int")
    media.write_media(frame(0, 10), path)
    media.write_media(frame(10, 20), path)
    media.write_media(frame(0, 0), path)
    assert sorted(r.id for r in media.read_media(spark, path).collect()) == list(range(20))
    media.write_media(frame(30, 33), path, mode="overwrite")
    assert sorted(r.id for r in media.read_media(spark, path).collect()) == [30, 31, 32]


def test_long_and_null_payloads_in_several_writes(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    for _ in range(2):
        media.write_media(spark.createDataFrame([(None, None), (1, b"z" * 3_000_000)], "id long, payload binary"), path)
    rows = media.features(media.read_media(spark, path, rangeBytes=1000)).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in rows) == [("1", 3_000_000)] * 2 + [("None", 0)] * 2


def test_a_folder_without_a_record_is_no_archive(spark, tmp_path):
    with pytest.raises(Exception, match="no commit record"):
        media.read_media(spark, f"file://{tmp_path}/none").collect()
