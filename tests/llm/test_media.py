import numpy as np
import pytest

from spindrift.llm import media as M


def payloads(texts):
    return [M.padded(t) for t in texts]


def test_padding():
    assert len(M.padded(b"")) == 576 and len(M.padded(b"a" * 576)) == 576 and M.padded(b"a" * 577)[577:] == b"\xff" * 575


def test_round_trip():
    rng = np.random.default_rng(1)
    own = payloads([b"", b"\x00" * 600, bytes(rng.integers(0, 256, 5000, dtype=np.uint8)), b"\xff\x00" * 800, "é漢".encode() * 500, bytes(rng.integers(0, 256, M.FRAME + 9000, dtype=np.uint8))])
    blobs = M.encode(own)
    back = M.thumbnails(blobs)
    assert [b"".join(g.tobytes() for _, _, g in frames) for frames in back] == own
    assert len(back[-1]) == 2 and back[0][0][:2] == (192, 192)
    assert M.encode([own[2]])[0] == blobs[2]


def general(width, height, dc, ac, restart=0, two=False):
    """A small baseline writer with AC coefficients, to test the decoder on what the encoder never writes."""
    dc_bits, dc_values = M.DC_BITS, M.DC_VALUES
    ac_bits, ac_values = bytes([0, 2, 2] + [0] * 13), bytes([0x00, 0x01, 0x23, 0xF0])
    code = lambda bits, values: {v: (c, n) for c, n, v in M._codes(bits, values)}
    dcs, acs = code(dc_bits, dc_values), code(ac_bits, ac_values)
    out, scans = [], []

    def put(value, n):
        out.extend(value >> k & 1 for k in range(n - 1, -1, -1))

    def flush():
        while len(out) % 8:
            out.append(1)
        scans.append(np.packbits(np.array(out, dtype=np.uint8)).tobytes().replace(b"\xff", b"\xff\x00"))
        out.clear()

    last = 0
    for k, (d, tail) in enumerate(zip(dc, ac)):
        if restart and k and k % restart == 0:
            flush()
            last = 0
        diff, last = d - last, d
        size = abs(diff).bit_length()
        put(*dcs[size])
        put(diff if diff >= 0 else diff + (1 << size) - 1, size)
        for symbol, value in tail:
            put(*acs[symbol])
            put(value, symbol & 15)
        put(*acs[0])
    flush()
    body = b"".join(s + (b"\xff" + bytes([0xD0 + i % 8]) if i < len(scans) - 1 else b"") for i, s in enumerate(scans))
    seg = M._segment
    head = [b"\xff\xd8", seg(0xFE, b"a comment"), seg(0xDB, b"\0" + bytes([16]) + bytes([1]) * 63), seg(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x01\x01\x11\x00")]
    head += [seg(0xC4, b"\x00" + dc_bits + dc_values + b"\x10" + ac_bits + ac_values)] + ([seg(0xDD, restart.to_bytes(2, "big"))] if restart else [])
    return b"".join([*head, seg(0xDA, b"\x01\x01\x00\x00\x3f\x00"), body, b"\xff\xd9"])


@pytest.mark.parametrize("restart", [0, 2])
def test_general_baseline(restart):
    dc = [0, 5, -7, 30, 30, -60]
    ac = [[], [(0x01, 1)], [(0xF0, 0), (0x23, 5)], [(0x23, 7), (0x01, 0)], [], [(0x01, 1)] * 4]
    ((width, height, grey),) = M.thumbnails([general(20, 13, dc, ac, restart)])[0]
    assert (width, height, grey.shape) == (20, 13, (2, 3))
    assert grey.ravel().tolist() == [min(255, max(0, (d * 16 + 4) // 8 + 128)) for d in dc]


def plain_decode(blob):
    """A second decoder, bit by bit, of grey images of flat blocks: the bytes of all frames."""
    out, at = bytearray(), 0
    while at < len(blob):
        assert blob[at : at + 2] == b"\xff\xd8"
        at += 2
        codes = {}
        while True:
            marker, length = blob[at + 1], int.from_bytes(blob[at + 2 : at + 4], "big")
            body, at = blob[at + 4 : at + 2 + length], at + 2 + length
            if marker == 0xDB:
                step = body[1]
            elif marker == 0xC0:
                blocks = int.from_bytes(body[1:3], "big") // 8 * (int.from_bytes(body[3:5], "big") // 8)
            elif marker == 0xDD:
                restart = int.from_bytes(body, "big")
            elif marker == 0xC4:
                code, place, known = 0, 17, {}
                for size in range(1, 17):
                    for _ in range(body[size]):
                        known[f"{code:0{size}b}"] = body[place]
                        place, code = place + 1, code + 1
                    code *= 2
                codes[body[0] >> 4] = known
            elif marker == 0xDA:
                break
        end = at
        while not (blob[end] == 0xFF and blob[end + 1] == 0xD9):
            end += 1
        bits, k, done, last = "", at, 0, 0

        def symbol(kind):
            nonlocal bits, k
            word = ""
            while word not in codes[kind]:
                word += take(1)
            return codes[kind][word]

        def take(n):
            nonlocal bits, k
            while len(bits) < n:
                bits += f"{blob[k]:08b}"
                k += 2 if blob[k] == 0xFF else 1  # a stuffed zero follows
            head, bits = bits[:n], bits[n:]
            return head

        while done < blocks:
            if done and done % restart == 0:
                assert set(bits) <= {"1"} and blob[k] == 0xFF and blob[k + 1] == 0xD0 + (done // restart - 1) % 8
                bits, k, last = "", k + 2, 0
            size = symbol(0)
            value = int(take(size), 2) if size else 0
            last += value if not size or value >> (size - 1) else value - (1 << size) + 1
            assert symbol(1) == 0  # the end of the block
            out.append(last * step // 8 + 128)
            done += 1
        at = end + 2
    return bytes(out)


def test_columns_equal_a_second_decoder(spark):
    import hashlib
    import zlib

    rng = np.random.default_rng(2)
    texts = ["", None, "é漢😀" * 50, "plain words " * 400, "\x7f\x00" * 300, "".join(map(chr, rng.integers(1, 0xD000, 2000))), "x" * 576]
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)], "doc_id long, text string, media string, n_bytes int")
    stored = {r.doc_id: bytes(r.media) for r in M.store_text(docs).collect()}
    for r in M.media_features(M.store_text(docs)).collect():
        data = (texts[r.doc_id] or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        assert plain_decode(stored[r.doc_id]) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())


def test_long_texts_take_bounded_memory():
    import tracemalloc

    own = M.padded(b"Some words of a very long text. " * 300_000)
    tracemalloc.start()
    (frames,) = M.thumbnails(M.encode([own]))
    assert b"".join(g.tobytes() for _, _, g in frames) == own and tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


def test_bad_images():
    good = M.encode(payloads([b"hello"]))[0]
    for bad in (b"x", good[:40], good.replace(b"\xff\xc0", b"\xff\xc2"), good[:-30]):
        with pytest.raises(M.JpegError):
            M.thumbnails([bad])


def test_columns(odd, nothing):
    got = M.media_features(M.store_text(odd)).collect()
    assert len(got) == odd.count()
    fours = [tuple(r) for r in got if r.doc_id == 4 and r.n_bytes == min(x.n_bytes for x in got if x.doc_id == 4)]
    assert len(fours) == 2 and fours[0] == fours[1]
    assert all(r.payload_bytes % 576 == 0 and r.payload_bytes >= max(1, r.n_bytes) for r in got)
    assert M.media_features(M.store_text(nothing)).count() == 0
