import hashlib
import zlib

import numpy as np
import pytest

from sluice.llm import media


def test_netpbm_kinds():
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n")[:, :, 0].tolist() == [[0, 1, 0], [1, 0, 1]]
    assert media.decode(b"P2\n2 1\n255\n7 200\n")[:, :, 0].tolist() == [[7, 200]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n9 1\n" + bytes([0b10000000, 0]))[0, :, 0].tolist() == [0] + [1] * 8
    assert media.decode(b"P6\n1 2\n255\n" + bytes(range(6))).tolist() == [[[0, 1, 2]], [[3, 4, 5]]]
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02")[0, 0, 0] == 258
    with pytest.raises(ValueError):
        media.decode(b"P5\n4 4\n255\nxx")
    with pytest.raises(ValueError):
        media.decode(b"nonsense")


def bmp(rows, bits, palette=b""):
    stride = (len(rows[0]) + 3) // 4 * 4
    body = b"".join(r.ljust(stride, b"\0") for r in rows)
    width = len(rows[0]) * 8 // bits
    start = 54 + len(palette)
    word = lambda v, n=4: v.to_bytes(n, "little", signed=True)
    return b"BM" + word(start + len(body)) + word(0) + word(start) + word(40) + word(width) + word(len(rows)) + word(1, 2) + word(bits, 2) + word(0) * 6 + palette + body


def test_bmp_kinds():
    assert media.decode(bmp([bytes([1, 2, 3]), bytes([4, 5, 6])], 24)).tolist() == [[[6, 5, 4]], [[3, 2, 1]]]
    palette = b"".join(bytes([k, k + 1, k + 2, 0]) for k in range(0, 32, 2)) + bytes(4 * 240)
    assert media.decode(bmp([bytes([1, 0])], 8, palette)).tolist() == [[[4, 3, 2], [2, 1, 0]]]


def test_resize_is_the_exact_area_mean():
    x = np.random.default_rng(3).integers(0, 256, (7, 10)).astype(float)
    fine = np.repeat(np.repeat(x, 8 * 5, axis=0), 9 * 4, axis=1)
    want = fine.reshape(8, fine.shape[0] // 8, 9, fine.shape[1] // 9).mean((1, 3))
    assert np.allclose(media.resize(x, 8, 9), want)
    assert np.allclose(media.resize(x, 7, 10), x)


def test_texts_round_trip(awkward, nothing):
    out = {r["doc_id"]: r for r in media.text_pictures(awkward, tiles=True).collect()}
    for r in awkward.collect():
        raw = (r["text"] or "").encode()
        want = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        got = out[r["doc_id"]]
        if r["doc_id"] == 1 and got["n_bytes"] != len(raw):
            continue
        assert media.read_tiles(got["media"]).tobytes() == want
        assert (got["n_bytes"], got["payload_bytes"], got["payload_sha256"], got["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert (got["media_bytes"], got["media_sha256"]) == (len(got["media"]), hashlib.sha256(got["media"]).hexdigest()) and len(got["feature"]) == 16
    assert media.text_pictures(nothing).count() == 0 and media.text_pictures(awkward).count() == 9


def test_pictures_with_errors(spark):
    df = spark.createDataFrame([(1, bytearray(b"P5\n2 2\n255\nabcd")), (2, None), (3, bytearray(b"P9"))], "k int, data binary")
    rows = {r["id"]: r for r in media.decode_pictures(df, "k", "data").collect()}
    assert rows[1]["height"] == 2 and rows[1]["error"] is None and rows[2]["error"] and rows[3]["error"]


def test_samples_out_of_range_are_errors(spark):
    data = [b"P2 1 1 255 99999999999", b"P2 1 1 255 300", b"P2 1 1 70000 5", b"P5 1 1 0 a", b"P2 0 3 255", b"P2 1 1 255 -5", b"P5 99999999999 99999999999 255 a", b"P2 1 1 " + b"9" * 5000, b"BM" + bytes(60), b"P2 1 1 255 0000000007"]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "k int, data binary")
    rows = {r["id"]: r for r in media.decode_pictures(df, "k", "data").collect()}
    assert all(rows[i]["error"] and rows[i]["tiles"] is None for i in range(len(data) - 1))
    assert rows[len(data) - 1]["error"] is None and media.read_tiles(rows[len(data) - 1]["tiles"]).tolist() == [[[7]]]
