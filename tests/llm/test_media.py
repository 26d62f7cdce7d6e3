import hashlib
import tarfile
import zlib

import pytest
from panelspark.llm import media
from panelspark.session import scratch_folder
from tests.llm.data import awkward, frame


def folder_of(spark):
    return scratch_folder(spark, "media")


def test_payloads_come_back(spark):
    rows, folder = awkward(), folder_of(spark)
    out = media.media_columns(frame(spark, rows, extra=True), folder).collect()
    assert len(out) == len(rows)
    by_text = {}
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        image = media.to_png(payload)
        by_text[r[0], r[1]] = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), media.describe(payload),
                               64, len(payload) // 64, 8, 0)
    assert sorted(map(repr, (tuple(r)[1:] for r in out))) == sorted(repr(by_text[r[0], r[1]]) for r in rows)


def test_shards_are_plain_tar_with_each_image_once_per_task(spark, tmp_path):
    rows = [(i, f"text {i % 20}", "en", "s", 0) for i in range(200)]
    store = media.store(frame(spark, rows).coalesce(1), str(tmp_path / "m")).collect()
    assert len(store) == 200 and len({(r["shard"], r["offset"]) for r in store}) == 20
    for name in {r["shard"] for r in store}:
        with tarfile.open(tmp_path / "m" / name) as tar:
            members = {m.offset_data: m for m in tar.getmembers()}
            for r in store:
                member = members[r["offset"]]
                assert member.name == f"{r['digest'].hex()[:2]}/{r['digest'].hex()}.png" and member.size == r["length"]
                assert hashlib.sha256(tar.extractfile(member).read()).digest() == r["digest"]


def test_images_are_readable_and_damage_is_seen():
    payload = media.to_payload("naïve " * 100)
    image = media.to_png(payload)
    assert media.from_png(image) == payload and media.read_header(image[:33]) == (64, len(payload) // 64, 8, 0)
    with pytest.raises(ValueError):
        media.read_header(b"x" * 33)
    broken = bytearray(image)
    broken[60] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(broken))


def test_empty(spark):
    assert media.media_columns(frame(spark, []), folder_of(spark)).count() == 0
