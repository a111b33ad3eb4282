import hashlib
import zlib

import numpy as np
import pytest

from tablewright.llm import webp

RNG = np.random.default_rng(5)


def noisy(h, w, c=3, top=256):
    return RNG.integers(0, top, (h, w, c)).astype(np.uint8)


def smooth(h, w):
    y, x = np.mgrid[:h, :w]
    return np.stack([x * 3 + y, x + y * 2, x * y // 4, 255 - x], -1).astype(np.uint8)


def same(pixels, **how):
    got = webp.decode(webp.encode(pixels, **how))
    assert np.array_equal(got[..., : pixels.shape[2]], pixels)


@pytest.mark.parametrize("shape", [(1, 1), (1, 64), (7, 5), (33, 64)])
@pytest.mark.parametrize("top", [1, 2, 3, 40, 256])
def test_literals(shape, top):
    same(noisy(*shape, top=top))
    same(noisy(*shape, c=4, top=top), flat=False)


@pytest.mark.parametrize("bits", [1, 6, 11])
def test_cache_and_copies(bits):
    tile = noisy(4, 9)
    same(np.tile(tile, (5, 3, 1)), flat=False, copies=True)
    same(np.tile(tile, (5, 3, 1)), flat=False, cache_bits=bits)
    same(np.tile(tile, (5, 3, 1)), flat=False, copies=True, cache_bits=bits)
    same(np.zeros((40, 50, 3), np.uint8), flat=False, copies=True)


@pytest.mark.parametrize("mode", range(14))
def test_predictor_modes(mode):
    for pixels in (smooth(13, 10), noisy(9, 11, 4)):
        tiles = np.full((-(-pixels.shape[0] >> 2), -(-pixels.shape[1] >> 2)), mode << 8, np.uint32)
        same(pixels, predictor=tiles)
        mixed = RNG.integers(0, 14, tiles.shape).astype(np.uint32) << np.uint32(8)
        same(pixels, predictor=mixed, subtract=True, flat=False)


def test_cross_colour():
    pixels = noisy(10, 12)
    tiles = RNG.integers(0, 1 << 24, (3, 3)).astype(np.uint32) | np.uint32(0xFF000000)
    same(pixels, cross=tiles)
    same(pixels, cross=tiles, subtract=True, predictor=np.full((3, 3), 11 << 8, np.uint32), flat=False, copies=True, cache_bits=4)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palette(colours):
    table = noisy(1, colours, 4)[0]
    same(table[RNG.integers(0, colours, (9, 21))], palette=True)
    same(table[RNG.integers(0, colours, (9, 21))], palette=True, flat=False, copies=True)


def test_broken_files():
    data = webp.encode(noisy(5, 64))
    with pytest.raises(ValueError):
        webp.decode(data[:-40][:20] + data[20:60])
    with pytest.raises(ValueError):
        webp.decode(b"nothing at all, but long enough")


def test_store_texts(spark):
    texts = [None, "", "a", "é" * 96, "x" * 192, "y" * 193, "long " * 700_000, "a", "<\x00\x7f>"]
    docs = spark.createDataFrame([(i, t, "feature") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    got = {r.doc_id: r for r in webp.store_texts(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(-(-len(raw) // 192), 1) * 192, b" ")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
    assert got[2][1:] == got[7][1:] and got[0][1:] == got[1][1:]
    assert webp.store_texts(docs.limit(0)).count() == 0


# Streams put together by hand, field by field (value, bits), lowest bit first, as the format's specification has them.


def by_hand(width, height, *fields):
    value, at = 0, 0
    for v, n in ((width - 1, 14), (height - 1, 14), (1, 1), (0, 3), *fields):
        value |= v << at
        at += n
    body = b"\x2f" + value.to_bytes(-(-at // 8), "little")
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def one(symbol):
    return (1, 1), (0, 1), (1, 1), (symbol, 8)


def two(low, high):
    return (1, 1), (1, 1), (1, 1), (low, 8), (high, 8)


def normal(low, high, size):
    """A normal code of two symbols, its lengths run by run: length 1 is stored as bit 0, runs of zeros as bit 1."""
    out = [(0, 1), (0, 4), (0, 3), (1, 3), (0, 3), (1, 3), (0, 1)]

    def zeros(n):
        while n:
            k = min(n, 138) if n <= 138 or n - 138 >= 11 else n - 11
            out.extend([(1, 1), (k - 11, 7)])
            n -= k

    zeros(low)
    out.append((0, 1))
    zeros(high - low - 1)
    out.append((0, 1))
    zeros(size - high - 1)
    return out


PLAIN = ((0, 1), (0, 1), (0, 1))  # no more transforms, no cache, no groups
REST = (*one(0), *one(0), *one(255), *one(0))  # red, blue, alpha, distance


def rgba(data):
    return [[tuple(p) for p in row] for row in webp.decode(data).tolist()]


def test_a_file_of_another_encoder():
    import base64

    assert rgba(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")) == [[(0, 0, 0, 0)]]


def test_subtracted_green_by_hand():
    data = by_hand(2, 1, (1, 1), (2, 2), *PLAIN, *two(10, 200), *one(5), *two(1, 250), *one(255), *one(0), (0, 1), (0, 1), (1, 1), (1, 1))
    assert rgba(data) == [[(15, 10, 11, 255), (205, 200, 194, 255)]]


def test_cross_colour_by_hand():
    tile = ((0, 1), *one(8), *one(240), *one(16), *one(255), *one(0))  # green to blue 8, red to blue -16, green to red 16
    data = by_hand(1, 1, (1, 1), (1, 2), (0, 3), *tile, *PLAIN, *one(100), *one(10), *one(20), *one(255), *one(0))
    assert rgba(data) == [[(60, 100, 15, 255)]]


@pytest.mark.parametrize(("mode", "corner"), [(1, 220), (2, 140), (7, 180), (8, 130), (11, 220), (12, 240), (13, 200 + 20 - 10)])
def test_predictors_by_hand(mode, corner):
    tile = ((0, 1), *one(mode), *one(0), *one(0), *one(255), *one(0))
    data = by_hand(2, 2, (1, 1), (0, 2), (0, 3), *tile, *PLAIN, *two(20, 100), *one(0), *one(0), *one(0), *one(0), (1, 1), (0, 1), (1, 1), (0, 1))
    got = rgba(data)  # residuals 100, 20, 100, 20
    assert got[0] == [(0, 100, 0, 255), (0, 120, 0, 255)] and got[1][0] == (0, 200, 0, 255)
    if mode == 13:  # mean of 200 and 120, and half of its difference to the corner's 100
        corner = 160 + 30 + 20
    assert got[1][1] == (0, corner, 0, 255)


def test_palette_by_hand():
    colours = ((0, 1), *two(7, 250), *one(0), *one(0), *two(0, 255), *one(0), (0, 1), (1, 1), (1, 1), (0, 1))
    data = by_hand(3, 1, (1, 1), (3, 2), (1, 8), *colours, *PLAIN, *one(0b101), *REST)
    assert rgba(data) == [[(0, 1, 0, 255), (0, 7, 0, 255), (0, 1, 0, 255)]]


def test_copies_by_hand():
    codes = (*normal(65, 258, 280), *one(9), *one(8), *one(255), *one(1))  # a literal; three pixels from one before
    assert rgba(by_hand(4, 1, *PLAIN, *codes, (0, 1), (1, 1))) == [[(9, 65, 8, 255)] * 4]
    codes = (*normal(65, 258, 280), *two(9, 10), *one(8), *one(255), *one(1))
    assert rgba(by_hand(5, 1, *PLAIN, *codes, (0, 1), (0, 1), (0, 1), (1, 1), (1, 1))) == [[(9, 65, 8, 255)] + [(10, 65, 8, 255)] * 4]


def test_colour_cache_by_hand():
    argb = 255 << 24 | 9 << 16 | 65 << 8 | 8
    slot = (0x1E35A7BD * argb & 0xFFFFFFFF) >> 31
    lengths = [(0, 1), (0, 4), (0, 3), (1, 3), (0, 3), (1, 3), (1, 1), (1, 3), (5 - 2, 4)]  # five runs are stored, zeros follow
    lengths += [(1, 1), (65 - 11, 7), (0, 1), (1, 1), (138 - 11, 7), (1, 1), (280 + slot - 66 - 138 - 11, 7), (0, 1)]
    data = by_hand(3, 1, (0, 1), (1, 1), (1, 4), (0, 1), *lengths, *one(9), *one(8), *one(255), *one(0), (0, 1), (1, 1), (1, 1))
    assert rgba(data) == [[(9, 65, 8, 255)] * 3]


def test_prefix_groups_by_hand():
    groups = ((0, 1), *two(0, 1), *one(0), *one(0), *one(0), *one(0), (0, 1), (1, 1))
    data = by_hand(8, 2, (0, 1), (0, 1), (1, 1), (0, 3), *groups, *one(11), *REST, *one(22), *REST)
    assert rgba(data) == [[(0, 11, 0, 255)] * 4 + [(0, 22, 0, 255)] * 4] * 2


# What documents take


def payload_of(raw):
    return raw.ljust(max(-(-len(raw) // 192), 1) * 192, b" ")


PROSE = ("the quick brown fox jumps over the lazy dog and " * 40 + "".join(chr(97 + i * i % 26) for i in range(3000))).encode()
KINDS = {
    "prose": PROSE,
    "three bytes a character": "漢字かな交じり文、東京都千代田区。".encode() * 2 + "".join(chr(0x4E00 + i * 7919 % 900) for i in range(4000)).encode(),
    "few samples": b"abba" * 900 + b"c" * 77,
    "all samples": bytes(RNG.integers(0, 256, 9000).astype(np.uint8)),
    "slopes": bytes(np.cumsum(RNG.integers(0, 2, (6000, 3)), axis=0).astype(np.uint8)),
    "one sample": b" " * 500,
}


@pytest.mark.parametrize("kind", KINDS)
def test_media_come_back(kind, monkeypatch):
    monkeypatch.setattr(webp, "ROWS", 16)  # several files
    payload = payload_of(KINDS[kind])
    media = webp.to_media(payload)
    assert webp.from_media(media).tobytes() == payload and webp.to_media(payload) == media
    widths = {int.from_bytes(media[k + 21 : k + 23], "little") & 0x3FFF for k in range(len(media) - 20) if media[k : k + 4] == b"RIFF"}
    assert widths <= {191, 63} and (63 in widths) == (kind in ("three bytes a character", "slopes"))
    monkeypatch.setattr(webp, "STRETCH", 256)
    assert webp.from_media(media).tobytes() == payload


def test_documents_are_decoded_by_codes_and_copies(monkeypatch):
    payload = payload_of(PROSE)
    seen = []
    step, near = webp._step_table, webp._distance
    monkeypatch.setattr(webp, "_step_table", lambda code: seen.append(len(set(code.lengths))) or step(code))
    monkeypatch.setattr(webp, "_distance", lambda code, width: seen.append("copy") or near(code, width))
    media = webp.to_media(payload)
    assert webp.from_media(media).tobytes() == payload
    assert "copy" in seen and max(x for x in seen if x != "copy") > 3 and len(media) < len(payload) // 2


def test_long_codes_and_broken_streams(monkeypatch):
    counts = np.array([1, 1] + [2**k for k in range(1, 14)])
    assert webp.huffman_lengths(counts, 15).max() == 14 and webp.huffman_lengths(counts, 12).max() == 12
    monkeypatch.setattr(webp, "DEEPEST", 14)
    payload = payload_of(b"".join(bytes([65 + k]) * int(n) for k, n in enumerate(counts)))
    samples = RNG.permutation(np.frombuffer(payload, np.uint8)).tobytes()
    media = webp.to_media(samples)
    assert webp.from_media(media).tobytes() == samples
    for cut in (9, len(media) // 2):
        with pytest.raises(ValueError):
            webp.from_media(media[:-cut])


def test_media_columns_by_brute_force(spark):
    texts = [None, "x", PROSE.decode(), "漢字" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in webp.store_texts(docs).collect():
        payload = payload_of((texts[r.doc_id] or "").encode())
        media = webp.to_media(payload)
        means = [sum(payload[k::3]) // (len(payload) // 3) for k in range(3)]
        counts = [sum(b >> 5 == k for b in payload) for k in range(8)]
        want = f"64x{len(payload) // 192};mean={','.join(map(str, means))};hist={','.join(map(str, counts))}"
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media), hashlib.sha256(media).hexdigest(), want)
