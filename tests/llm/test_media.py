import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import jpeg, media


def payload(text):
    raw = (text or "").encode()
    return raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))


def test_payloads_come_back(awkward, empty):
    df, rows = awkward
    read = media.read_media(media.store_payloads(df), keep_media=True).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.payload) for r in read) == sorted((str(i), len((t or "").encode()), payload(t)) for i, t in rows)
    assert all(len(r.rgb) == r.height * r.width * 3 for r in read)
    by_text = {}
    for r in read:
        assert by_text.setdefault(bytes(r.payload[: r.n_bytes]), (hashlib.sha256(r.media).digest(), r.feature)) == (hashlib.sha256(r.media).digest(), r.feature)
    assert media.read_media(media.store_payloads(empty)).count() == 0


def test_damaged_and_foreign_media_give_nulls(spark):
    good = media.encode_payloads(np.frombuffer(b"hello", np.uint8), np.array([0, 5]))[0]
    rows = [(1, bytearray(good)), (2, None), (3, bytearray(b"")), (4, bytearray(b"\xff\xd8\xff\xd9")), (5, bytearray(good[:40])), (6, bytearray(b"PNG not a jpeg"))]
    got = {r.doc_id: r for r in media.read_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got[1].payload[:5] == b"hello" and all(got[i].feature is None and got[i].rgb is None for i in range(2, 7))


def test_large_images_by_stripes_are_the_same(monkeypatch):
    """Any number of blocks at a time gives the same media, coefficients and tensors."""
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 256, 3_000_000).astype(np.uint8)
    offsets = np.array([0, 5, 5, 1_500_000, 3_000_000])
    whole = {}
    for blocks in (1 << 30, 1 << 14, 3000):
        monkeypatch.setattr(jpeg, "STRIPE_BLOCKS", blocks)
        monkeypatch.setattr(media, "STRIPE_BLOCKS", blocks)
        stored = media.encode_payloads(raw, offsets)
        images, coefs, first = jpeg.decode_coefficients(np.frombuffer(b"".join(stored), np.uint8), np.concatenate(([0], np.cumsum([len(m) for m in stored]))))
        tensors = jpeg.render(images, coefs, first)
        found = stored, [media.payloads_of(coefs[a:b]).tobytes() for a, b in zip(first[:-1], first[1:])], [t.tobytes() for t in tensors]
        assert found[1][3][:1_500_000] == raw[1_500_000:].tobytes()
        whole = whole or found
        assert found == whole


def decoded(data):
    images, coefs, first = jpeg.decode_coefficients(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    return jpeg.render(images, coefs, first)[0]


def java_pixels(spark, data):
    """The same image by the JVM's own reader."""
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    w, h = image.getWidth(), image.getHeight()
    raster = np.array(list(image.getRGB(0, 0, w, h, None, 0, w)), np.int64).reshape(h, w)
    return np.stack([raster >> s & 255 for s in (16, 8, 0)], axis=2)


def java_progressive(spark, width, height, quality=0.9):
    """A smooth picture with an edge, written by the JVM as a progressive JPEG (4:2:0, its own scans and tables)."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(width, height, 1)
    for y in range(height):
        for x in range(width):
            image.setRGB(x, y, (x * 5 % 256) << 16 | (y * 3 % 256) << 8 | (255 if x > width // 2 else 40))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    out = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    param = writer.getDefaultWriteParam()
    param.setProgressiveMode(1)
    param.setCompressionMode(2)
    param.setCompressionQuality(quality)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    writer.dispose()
    return bytes(out.toByteArray())


@pytest.mark.parametrize("size", [(64, 48), (37, 29), (8, 8), (16, 33)])
def test_foreign_progressive_images(spark, size):
    """Run lengths, ends of bands and refined coefficients as another encoder writes them."""
    data = java_progressive(spark, *size)
    mine, theirs = decoded(data), java_pixels(spark, data)
    assert mine.shape == theirs.shape
    # Readers differ in how they upsample chroma, so edges may be apart, the rest may not.
    assert np.median(np.abs(mine - theirs)) <= 3


def test_stored_payloads_are_standard_images(spark):
    data = media.encode_payloads(np.frombuffer(bytes(range(32, 127)) * 30, np.uint8), np.array([0, 95 * 30]))[0]
    mine, theirs = decoded(data), java_pixels(spark, data)
    light = np.array([0.299, 0.587, 0.114])  # free of how chroma is upsampled, but for clipped values
    assert mine.shape == theirs.shape and np.corrcoef((mine @ light).ravel(), (theirs @ light).ravel())[0, 1] > 0.9


def test_media_keep_null_ids(spark):
    df = spark.createDataFrame([(None, "x"), (1, None)], "doc_id long, text string")
    assert media.read_media(media.store_payloads(df)).where(F.col("doc_id").isNull()).first().n_bytes == 1
