from __future__ import annotations

import hashlib
import io
import tarfile
import zlib
from urllib.parse import urlparse

import pytest

from larkspur.llm.media import feature_of, from_png, media_columns, media_facts, media_headers, pad, png_header, store_media, to_png

from .helpers import documents, odd_documents

TEXTS = ["", "a", "x" * 64, "x" * 65, "é日本🙂" * 100, "same", "same", None, "long " * 50_000]


@pytest.mark.parametrize("text", [t for t in TEXTS if t is not None])
def test_png_round_trip(text):
    payload = pad(text.encode())
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(text.encode())
    media = to_png(payload)
    assert from_png(media) == payload and png_header(media[:33]) == (64, len(payload) // 64, 8)


def test_damaged_images_are_noticed():
    media = bytearray(to_png(pad(b"text")))
    media[45] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        from_png(bytes(media))
    with pytest.raises(ValueError):
        png_header(b"\0" * 33)


def test_what_is_read_back(spark, tmp_path):
    folder = f"file://{tmp_path}/media"
    rows = {r.doc_id: r for r in media_columns(documents(spark, TEXTS), folder=folder).collect()}
    for i, t in enumerate(TEXTS):
        r, payload = rows[i], pad((t or "").encode())
        assert (r.n_bytes, r.payload_bytes) == (len((t or "").encode()), len(payload))
        assert r.payload_sha256 == r.digest == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        with open(urlparse(r.shard).path, "rb") as f:
            f.seek(r.offset)
            media = f.read(r.media_bytes)
        assert r.media_sha256 == hashlib.sha256(media).hexdigest() and from_png(media) == payload and r.feature == feature_of(payload)
    same = [rows[i].asDict() | {"doc_id": 0, "shard": "", "offset": 0} for i in (5, 6)]
    assert same[0] == same[1]


def test_shards_are_tar_files_with_content_addresses(spark, tmp_path):
    index = store_media(documents(spark, TEXTS * 3).coalesce(1), f"file://{tmp_path}/m", shard_bytes=2000)
    rows = index.collect()
    shards = {r.shard for r in rows if r.shard}
    assert len(shards) > 1 and len(rows) == 3 * len(TEXTS)
    names = []
    for shard in shards:
        with open(urlparse(shard).path, "rb") as f, tarfile.open(fileobj=io.BytesIO(f.read())) as tar:
            for member in tar.getmembers():
                assert hashlib.sha256(from_png(tar.extractfile(member).read())).hexdigest() + ".png" == member.name
                names.append(member.name)
    assert len(names) == len(set(names)) == len({r.digest for r in rows})
    heads = media_headers(index.where("shard is not null")).collect()
    assert all(h.width == 64 and h.bit_depth == 8 and h.payload_bytes == 64 * h.height for h in heads)


def tar_names(folder) -> list[str]:
    found = []
    for shard in folder.glob("*.tar"):
        with tarfile.open(shard) as tar:
            found += tar.getnames()
    return found


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_a_payload_is_stored_once_in_the_whole_table(spark, tmp_path, monkeypatch, broadcast_rows):
    """Over eight tasks, with one payload in a third of the rows; joined by broadcast and by shuffle."""
    from larkspur.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(common, "HOT", 50)
    texts = [("hot" if i % 3 == 0 else f"text {i % 100}") for i in range(600)]
    rows = media_columns(documents(spark, texts).repartition(8), folder=f"file://{tmp_path}/media").collect()
    assert {r.doc_id: r.payload_sha256 for r in rows} == {i: hashlib.sha256(pad(t.encode())).hexdigest() for i, t in enumerate(texts)}
    names = tar_names(tmp_path / "media")
    assert len(rows) == 600 and len(names) == len(set(names)) == len(set(texts))


def test_metadata_comes_from_headers_alone(spark, tmp_path):
    """With every byte after the headers destroyed the metadata columns are as before; the payloads are refused."""
    stored = store_media(documents(spark, TEXTS).coalesce(1), f"file://{tmp_path}/m").where("shard is not null")
    before = sorted(media_headers(stored).collect())
    for r in before:
        with open(urlparse(r.shard).path, "r+b") as f:
            f.seek(r.offset + 33)
            f.write(b"#" * (r.length - 33))
    assert sorted(media_headers(stored).collect()) == before
    with pytest.raises(Exception, match="damaged PNG|incorrect header"):
        media_facts(media_headers(stored)).collect()


def test_a_payload_of_many_megabytes(spark, tmp_path):
    text = "é long line of text\n" * 600_000
    r = media_columns(documents(spark, [text]), folder=f"file://{tmp_path}/big").first()
    assert r.n_bytes == len(text.encode()) > 12_000_000 and r.payload_sha256 == hashlib.sha256(pad(text.encode())).hexdigest()


def test_odd_rows(spark, tmp_path):
    rows = media_columns(odd_documents(spark), folder=f"file://{tmp_path}/o").collect()
    assert len(rows) == 8 and {r.payload_bytes for r in rows if r.doc_id in (1, 2)} == {64}
    assert media_columns(odd_documents(spark).limit(0), folder=f"file://{tmp_path}/e").count() == 0
