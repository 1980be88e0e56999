import numpy as np
import pytest

from foliant.llm import media


@pytest.mark.parametrize("shape", [(3, 5), (4, 8), (2, 3, 3), (1, 1), (70, 33)])
def test_round_trips(shape):
    x = np.random.default_rng(0).integers(0, 256, shape).astype(np.uint8)
    assert (media.decode(media.encode_bmp(x)) == x).all()
    if x.ndim == 2:
        assert (media.decode(media.encode_pgm(x)) == x).all()
    else:
        assert (media.decode(b"P6\n%d %d\n255\n" % (x.shape[1], x.shape[0]) + x.tobytes()) == x).all()
    assert (media.from_npy(media.npy(x)) == x).all()


def test_plain_netpbm():
    assert media.decode(b"P2 # grey\n2 2\n255\n1 2\n3 4").tolist() == [[1, 2], [3, 4]]
    assert media.decode(b"P1\n3 2\n101\n010").tolist() == [[1, 0, 1], [0, 1, 0]]
    assert media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[1, 0, 1], [0, 1, 0]]
    assert media.decode(b"P2 3 1 15 0 15 5").tolist() == [[0, 255, 85]]
    masks = bytearray(media.encode_bmp(np.zeros((2, 2, 3), np.uint8)))
    masks[30] = 3  # colours under masks of their own
    for bad in (bytes(masks), b"", b"P5\n4 4\n255\nxx", b"GIF89a", b"BM123"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_area_resize_is_the_mean_of_areas(monkeypatch):
    x = np.random.default_rng(1).integers(0, 256, (50, 31)).astype(np.uint8)
    big = np.repeat(np.repeat(x, 8, 0), 9, 1).astype(float)  # 400 x 279
    want = big.reshape(8, 50, 9, 31).mean((1, 3))
    assert np.allclose(media.area_resize(x, 8, 9), want)
    monkeypatch.setattr(media, "BAND", 7)
    assert np.allclose(media.area_resize(x, 8, 9), want)


def test_tiles(spark):
    x = np.arange(300 * 280, dtype=np.uint32).astype(np.uint8).reshape(300, 280)
    df = spark.createDataFrame([(1, bytearray(media.encode_bmp(x))), (2, bytearray(b"nothing")), (3, None)], "id long, media binary")
    found = media.tiles(df, "media", keep=["id"]).collect()
    own = {(r["tile_y"], r["tile_x"]): media.from_npy(r["npy"]) for r in found if r["id"] == 1}
    assert (np.block([[own[0, 0], own[0, 1]], [own[1, 0], own[1, 1]]]) == x).all()
    assert [r["error"] is not None for r in found if r["id"] in (2, 3)] == [True, True]
