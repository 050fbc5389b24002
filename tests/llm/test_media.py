import hashlib
import io
import zlib

import numpy as np
import pytest

from tickloom.llm import media


def colour(h=3, w=5):
    return np.random.default_rng(1).integers(0, 256, (h, w, 3), dtype=np.uint8)


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (8, 64), (7, 4)])
def test_round_trips(shape):
    a = np.random.default_rng(2).integers(0, 256, shape, dtype=np.uint8)
    for write in (media.write_pgm, media.write_bmp):
        assert (media.decode_image(write(a)) == a).all()


def test_every_netpbm_kind():
    bits = np.array([[0, 1, 1, 0, 1, 0, 0, 1, 1], [1, 0, 0, 1, 0, 1, 1, 0, 0]], dtype=np.uint8)
    plain = b"P1\n# note\n9 2\n" + b" ".join(str(b).encode() for b in bits.ravel())
    packed = b"P4\n9 2\n" + np.packbits(bits, axis=1).tobytes()
    assert (media.decode_image(plain) == (1 - bits) * 255).all()
    assert (media.decode_image(packed) == (1 - bits) * 255).all()
    c = colour()
    text = b"P3 5 3 255\n" + " ".join(map(str, c.ravel())).encode()
    assert (media.decode_image(text) == c).all()
    assert (media.decode_image(b"P6 5 3 255\n" + c.tobytes()) == c).all()
    assert media.decode_image(b"P2 2 1 15\n0 15").tolist() == [[0, 255]]
    assert media.decode_image(b"P5 2 1 65535\n" + np.array([0, 65535], ">u2").tobytes()).tolist() == [[0, 255]]


@pytest.mark.parametrize("bits", [1, 4, 24, 32])
@pytest.mark.parametrize("down", [True, False])
def test_every_bmp_kind(bits, down):
    h, w = 3, 5
    r = np.random.default_rng(3)
    if bits >= 24:
        want = colour(h, w)
        body = want[:, :, ::-1] if bits == 24 else np.dstack([want[:, :, ::-1], np.zeros((h, w), np.uint8)])
        rows, palette = body.reshape(h, -1), b""
    else:
        index = r.integers(0, 1 << bits, (h, w), dtype=np.uint8)
        table = r.integers(0, 256, (1 << bits, 4), dtype=np.uint8)
        want, palette = table[:, 2::-1][index], table.tobytes()
        wide = np.unpackbits(index[..., None], axis=2)[:, :, 8 - bits :].reshape(h, -1)
        rows = np.packbits(wide, axis=1)
    pitch = (w * bits + 31) // 32 * 4
    held = np.zeros((h, pitch), np.uint8)
    held[:, : rows.shape[1]] = rows
    start = 54 + len(palette)
    head = b"BM" + np.array([start + held.size, 0, start], "<u4").tobytes() + np.array([40], "<u4").tobytes()
    head += np.array([w, -h if down else h], "<i4").tobytes() + np.array([1, bits], "<u2").tobytes() + np.zeros(6, "<u4").tobytes()
    data = head + palette + (held if down else held[::-1]).tobytes()
    assert (media.decode_image(data) == want).all()


def test_area_resize_against_counting():
    a = np.random.default_rng(4).integers(0, 256, (6, 4), dtype=np.uint8)
    got = media.area_resize(a, 4, 3)
    fine = np.repeat(np.repeat(a.astype(float), 4, axis=0), 3, axis=1)  # 24 x 12
    want = fine.reshape(4, 6, 3, 4).mean(axis=(1, 3))
    assert np.allclose(got, want)
    assert np.allclose(media.area_resize(a, 6, 4), a)


def test_features_of_media(spark):
    a = np.arange(64 * 3, dtype=np.uint8).reshape(3, 64)
    rows = [(1, media.write_pgm(a)), (2, media.write_bmp(a)), (3, None), (4, b""), (5, b"P5 9"), (6, b"nonsense"), (None, media.write_pgm(a))]
    df = spark.createDataFrame(rows, "media_id long, media binary").selectExpr("*", "1 AS height", "2 AS Tile")
    out = {r["media_id"]: r for r in media.media_features(df, tile=8).collect()}
    assert out[1]["dhash"] == out[2]["dhash"] == out[None]["dhash"] and out[1]["height"] == 3
    assert np.load(io.BytesIO(out[1]["tile"])).shape == (8, 8)
    assert all(out[i]["dhash"] is None and out[i]["tile"] is None for i in (3, 4, 5, 6))
    assert media.media_features(df.where("media_id > 99")).count() == 0


@pytest.mark.parametrize("form", ["pgm", "bmp"])
def test_text_rows(odd_docs, no_docs, form):
    got = {(r["doc_id"], r["n_bytes"]): r for r in media.text_media(odd_docs, form=form).collect()}
    for d in odd_docs.collect():
        raw = (d["text"] or "").encode()
        pad = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        r = got[d["doc_id"], len(raw)]
        assert (r["payload_bytes"], r["payload_sha256"]) == (len(pad), hashlib.sha256(pad).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(pad[-64:])
        stored = media.store_payload(raw, form)[1]
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert media.text_media(no_docs).count() == 0
