from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from larkspur.llm.bpe import ByteBpe, RankQueue, bpe_decode, bpe_digests, bpe_encode, load_ranks

from .helpers import documents, odd_documents, prose

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return ByteBpe(load_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def odd_texts() -> list[str]:
    rng = random.Random(3)
    texts = ["", " ", "\n\n", "a", "aa" * 700, "é" * 300, "日本語のテキスト", "x" * 5000, "ab" * 4000, "  lead", "1234567890" * 50, "don't I'LL", "🙂👍🏽" * 40, "\x00\x01", "tab\tsep \r\n"]
    texts += ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(160, 1000), rng.randrange(0x4E00, 0x5000)))) for _ in range(400)) for _ in range(20)]
    return texts + [" ".join(prose(i, 300)) for i in range(20)]


def test_equals_the_library(coder, library):
    texts = odd_texts()
    for text, ids in zip(texts, coder.encode_texts(texts)):
        assert ids.tolist() == library.encode_ordinary(text), text[:40]
        assert coder.decode(ids.tolist()) == text.encode()


def test_one_long_piece_equals_the_library(coder, library):
    rng = random.Random(5)
    for piece in ("a" * 3000, "".join(rng.choice("abc") for _ in range(3000)), "lower" * 600):
        assert coder.encode_piece(piece.encode()) == library.encode_ordinary(piece)


def test_queue_gives_ranks_in_order_then_leftmost():
    rng, queue = random.Random(1), RankQueue(5000)
    entries = [(rng.randrange(5000), rng.randrange(100)) for _ in range(2000)]
    for e in entries:
        queue.push(*e)
    assert [queue.pop() for _ in entries] == sorted(entries) and not queue.upper


def test_round_trip_and_digests(spark, library):
    texts = odd_texts()
    docs = documents(spark, texts)
    encoded = bpe_encode(docs, PATH, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe_decode(encoded, PATH).collect()} == dict(enumerate(texts))
    for r in bpe_digests(docs, PATH, public_tokenizers.PATTERN).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark):
    rows = bpe_digests(odd_documents(spark), PATH, public_tokenizers.PATTERN).collect()
    empty = hashlib.sha256(b"").hexdigest()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == 8 and None in by_id and by_id[1].n_tokens == by_id[2].n_tokens == 0 and by_id[1].ids_sha256 == by_id[1].decoded_sha256 == empty
    assert bpe_digests(odd_documents(spark).limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_vocabularies_of_one_size_are_kept_apart(spark, tmp_path):
    import base64

    docs = documents(spark, ["abcd"]).coalesce(1)
    for k, pair in enumerate((b"ab", b"cd", b"bc")):
        path = tmp_path / f"v{k}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate([*(bytes([i]) for i in range(256)), pair])))
        want = tiktoken.Encoding(f"v{k}", pat_str=r"\S+", mergeable_ranks=load_ranks(str(path)), special_tokens={}).encode_ordinary("abcd")
        assert bpe_encode(docs, str(path), r"\S+").first().ids == want
