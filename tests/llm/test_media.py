import zlib

import numpy as np
import pytest
from pyarrow import fs

from tempora.llm import media

from tests.llm.conftest import ODD


def test_png_round_trip_with_every_filter():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, media.ROW * 3, dtype=np.uint8).tobytes()
    assert media.from_png(media.to_png(data)) == data
    width, rows = 5, rng.integers(0, 256, (6, 5)).astype(int)
    lines = bytearray()
    for y in range(6):
        kind = y % 5
        up = rows[y - 1] if y else np.zeros(5, int)
        for x in range(-1, 5):
            if x < 0:
                lines.append(kind)
                continue
            a, b, c = (rows[y, x - 1] if x else 0), up[x], (up[x - 1] if x else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            lines.append(int(rows[y, x] - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
    import struct

    image = media._PNG + media._chunk(b"IHDR", struct.pack(">IIBBBBB", width, 6, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(bytes(lines))) + media._chunk(b"IEND", b"")
    assert media.from_png(image) == rows.astype(np.uint8).tobytes()


def test_payloads():
    assert media.payload(None) == media.payload("") == b"\xff" * 576
    assert len(media.payload("a" * 576)) == 576 and len(media.payload("a" * 577)) == 1152


def test_stored_and_read_back(spark, odd, monkeypatch):
    monkeypatch.setattr(media, "ARCHIVE_BYTES", 2000)
    folder = media.write_archives(odd)
    for span in (1, 700, media.RANGE_BYTES):  # however the bytes are dealt, each member is read once
        rows = media.inspect(media.read_media(spark, folder, span)).collect()
        got = sorted((r["doc_id"] or 0, r["payload"]) for r in rows)
        assert got == sorted((i or 0, media.payload(t)) for i, t, _ in ODD)
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert all(r["n_bytes"] == len(r["payload"].rstrip(b"\xff")) for r in rows)
    by_text = {r["payload"]: set() for r in rows}
    for r in rows:
        by_text[r["payload"]].add((bytes(r["media"]), r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())
    media.drop_archives(spark, folder)


def test_empty_table(spark, nothing):
    assert media.read_media(spark, media.write_archives(nothing)).count() == 0


def test_a_failed_read_is_tried_again_by_itself(tmp_path):
    writer = media.ArchiveWriter(f"file://{tmp_path}")
    for i in range(4):
        writer.add(i, bytes([i]) * 100)
    writer.close()
    (name, size, n), = writer.done
    assert (size, n) == (400, 4)
    members = media.Members(fs.LocalFileSystem(), f"{tmp_path}/{name}")
    entries = members.beginning_in(100, 301)
    assert entries["id"].tolist() == [1, 2, 3]
    failures, read = [OSError("lost"), OSError("lost")], members.at

    def unsteady(offset, size):
        if failures:
            raise failures.pop()
        return read(offset, size)

    members.at = unsteady
    assert members.member(entries[1]) == bytes([2]) * 100
    failures += [OSError("gone")] * media.ATTEMPTS
    with pytest.raises(OSError):
        members.member(entries[0])
    path = tmp_path / name
    path.write_bytes(b"\x09" + path.read_bytes()[1:])
    with pytest.raises(ValueError, match="checksum"):
        media.Members(fs.LocalFileSystem(), str(path)).member(media.Members(fs.LocalFileSystem(), str(path)).beginning_in(0, 1)[0])


def slow_row(text):
    """Every column of op5 from the text alone, by the PNG format and plain sums."""
    import hashlib
    import math
    import struct

    own = (text or "").encode()
    data = own + b"\xff" * (576 * max(1, -(-len(own) // 576)) - len(own))
    lines = b"".join(b"\0" + data[i : i + 576] for i in range(0, len(data), 576))
    image = b"\x89PNG\r\n\x1a\n"
    for kind, body in ((b"IHDR", struct.pack(">IIBBBBB", 576, len(data) // 576, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(lines, 1)), (b"IEND", b"")):
        image += struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    mean = math.fsum(data) / len(data)
    deviation = math.sqrt(math.fsum((b - mean) ** 2 for b in data) / len(data))
    shares = [n / len(data) for n in np.bincount(np.frombuffer(data, np.uint8)) if n]
    step = math.fsum(abs(a - b) for a, b in zip(data, data[1:])) / (len(data) - 1)
    numbers = [mean, deviation, -math.fsum(p * math.log2(p) for p in shares), step]
    return len(own), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(image), hashlib.sha256(image).hexdigest(), numbers


def test_query_says_what_the_texts_do(spark, sf, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = media.op5(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        *exact, numbers = slow_row(texts[r["doc_id"]])
        assert [r[c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")] == exact
        assert np.allclose([float(x.split("=")[1]) for x in r["feature"].split(";")], numbers, rtol=0, atol=1e-4)
