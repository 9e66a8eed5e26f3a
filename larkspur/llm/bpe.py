"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut into pre-tokens; within a pre-token the adjacent pair of lowest merge rank, leftmost
first, is merged until no pair has a rank. The queue keeps one bucket of start positions per rank
and a two-level bitmap of the non-empty buckets: find-first-set on the upper word and then on the
lower word gives the lowest rank in constant time; a bucket gives its leftmost position in time
logarithmic in its size. Parts form a linked list; an entry whose part
has been merged away, or whose pair has since another rank, is stale and skipped. A pre-token of n
bytes makes at most 3 n entries, so the cost stays near linear on very long pre-tokens.

Short pre-tokens of one Arrow batch share a single queue, whose buckets are arrays of positions, so
each turn of the queue merges the lowest rank in all of them at once; longer ones run alone. Equal
pre-tokens of a batch are encoded once. Memory follows the batch, which Spark bounds. The vocabulary
is sent once to each executor as a broadcast variable of fixed size.

Nulls and odd input: a null text is an empty one: no ids, and the digest of no bytes; a null id is
kept as it is; repeated rows give equal rows; columns other than the id and the text are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_in_arrow

#: Bytes up to which a pre-token shares one vectorised queue with the batch's others.
SHORT = 64
_BITS = 256
DIGESTS = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class RankQueue:
    """Positions by merge rank; ``pop`` gives the lowest rank's leftmost position."""

    def __init__(self, n_ranks: int):
        self.upper = 0
        self.lower = [0] * (n_ranks // _BITS + 1)
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        if bucket is None:
            self.buckets[rank] = [position]
        else:
            bucket.append(position)
        word = rank >> 8
        if not self.lower[word]:
            self.upper |= 1 << word
        self.lower[word] |= 1 << (rank & 255)

    def pop(self) -> tuple[int, int]:
        word = (self.upper & -self.upper).bit_length() - 1
        bits = self.lower[word]
        bit = bits & -bits
        rank = word << 8 | bit.bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            self.lower[word] = bits ^ bit
            if bits == bit:
                self.upper &= self.upper - 1
        return rank, position


class PairTable:
    """Ids of adjacent tokens to the rank of their joined bytes, as an open-addressing table."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.mask = (1 << int(64 - self.shift)) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.full(self.mask + 1, -1, np.int32)
        left, to_put = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slot(left)
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = left[free]  # of several keys for one slot the last one stays
            placed = self.keys[slot] == left
            self.values[slot[placed]] = to_put[placed]
            left, to_put, slot = left[~placed], to_put[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where the joined bytes are no token."""
        keys = a.astype(np.int64) << 32 | b
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class ByteBpe:
    """Encoder and decoder for one vocabulary of ranks and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.tokens = {i: t for t, i in ranks.items()}
        self.pairs = PairTable(ranks)
        self.of_byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)

    def encode_piece(self, piece: bytes) -> list[int]:
        """One pre-token of any length, an entry at a time."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n, get, queue = len(piece), ranks.get, self.queue
        push, pop = queue.push, queue.pop
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        pair = [-1] * (n + 1)  # rank of the pair that starts here; -1: none, or merged away
        for i in range(n - 1):
            if (r := get(piece[i : i + 2])) is not None:
                pair[i] = r
                push(r, i)
        while queue.upper:
            r, i = pop()
            if pair[i] != r:
                continue
            k = after[after[i]]
            pair[after[i]] = -1
            after[i] = k
            r = None
            if k < n:
                before[k] = i
                r = get(piece[i : after[k]])
            if r is None:
                pair[i] = -1
            else:
                pair[i] = r
                push(r, i)
            if (h := before[i]) >= 0:
                if (r := get(piece[h:k])) is None:
                    pair[h] = -1
                elif pair[h] != r:
                    pair[h] = r
                    push(r, h)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def encode_short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short pre-tokens in a row, and how many each has.

        One queue holds the positions of all of them: a rank's bucket is a set of positions, and
        each turn merges, of the lowest rank, the leftmost live position of every pre-token.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = int(sizes.sum())
        token = np.empty(n + 1, np.int32)
        token[:n] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        token[n] = -1
        owner = np.append(np.repeat(np.arange(len(pieces), dtype=np.int32), sizes), -1)
        after = np.arange(1, n + 2)
        before = np.arange(-1, n)
        pair = np.full(n + 1, -1, np.int32)
        at = np.flatnonzero(owner[:n] == owner[1:])
        pair[at] = self.pairs.ranks(token[at], token[at + 1])
        at = at[pair[at] >= 0]
        buckets: dict[int, list[np.ndarray]] = {}
        upper, lower = 0, [0] * len(self.queue.lower)

        def push(at: np.ndarray) -> None:
            nonlocal upper
            ranks = pair[at]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            ends = [0, *cuts.tolist(), len(at)]
            for rank, start, end in zip(ranks[ends[:-1]].tolist(), ends, ends[1:]):
                if (bucket := buckets.get(rank)) is None:
                    buckets[rank] = [at[start:end]]
                    word = rank >> 8
                    lower[word] |= 1 << (rank & 255)
                    upper |= 1 << word
                else:
                    bucket.append(at[start:end])

        if len(at):
            push(at)
        while upper:
            word = (upper & -upper).bit_length() - 1
            bits = lower[word]
            bit = bits & -bits
            rank = word << 8 | bit.bit_length() - 1
            bucket = buckets.pop(rank)
            lower[word] = bits ^ bit
            if bits == bit:
                upper &= upper - 1
            at = bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))
            at = at[pair[at] == rank]  # others are stale
            if not len(at):
                continue
            own = owner[at]
            first = np.ones(len(at), bool)
            np.not_equal(own[1:], own[:-1], out=first[1:])
            rest = at[~first]
            at = at[first]
            gone = after[at]
            follow = after[gone]
            pair[gone] = -1
            token[at] = rank
            after[at] = follow
            before[follow] = at
            same = owner[follow] == owner[at]
            new = np.full(len(at), -1, np.int32)
            new[same] = self.pairs.ranks(token[at[same]], token[follow[same]])
            pair[at] = new
            left = before[at]
            left = left[(left >= 0) & (owner[left] == owner[at])]
            pair[left] = self.pairs.ranks(token[left], token[after[left]])
            changed = np.concatenate((at, left))
            changed = changed[pair[changed] >= 0]
            if len(rest):
                changed = np.concatenate((changed, rest[pair[rest] == rank]))
            if len(changed):
                push(np.unique(changed))
        live = np.zeros(n + 1, bool)
        live[np.append(0, np.cumsum(sizes))] = True  # each pre-token's start
        at = np.flatnonzero(live[:n])
        alive = np.ones(n, bool)
        heads = at
        while len(heads):  # walks all linked lists a step at a time
            following = after[heads]
            gaps = following - heads
            for step in range(1, int(gaps.max())):
                alive[heads[gaps > step] + step] = False
            heads = following[(following < n)]
            heads = heads[~live[heads]]
        return token[:n][alive], np.bincount(owner[:n][alive], minlength=len(pieces))

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text; equal pre-tokens of the texts are encoded once."""
        seen = _Numbers()
        number = seen.__getitem__
        parts = [np.fromiter(map(number, found), np.int32, len(found)) for found in map(self.pieces, texts)]
        pieces = [p.encode("utf-8", "surrogatepass") for p in seen]
        counts = np.zeros(len(pieces), np.int64)
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        counts[whole >= 0] = 1
        short = np.flatnonzero((whole < 0) & np.fromiter((len(p) <= SHORT for p in pieces), bool, len(pieces)))
        flat_short, n_short = self.encode_short([pieces[i] for i in short]) if len(short) else (np.empty(0, np.int32), np.empty(0, np.int64))
        counts[short] = n_short
        long = {i: self.encode_piece(pieces[i]) for i in np.flatnonzero((whole < 0) & (counts == 0)).tolist()}
        for i, ids in long.items():
            counts[i] = len(ids)
        ends = np.cumsum(counts)
        starts = ends - counts
        flat = np.empty(int(counts.sum()), np.int32)
        flat[starts[whole >= 0]] = whole[whole >= 0]
        flat[_ragged(starts[short], n_short)] = flat_short
        for i, ids in long.items():
            flat[starts[i] : ends[i]] = ids
        return [flat[_ragged(starts[part], counts[part])] for part in parts]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Numbers(dict):
    """Numbers keys in the order they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    total = int(counts.sum())
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)


def coder_of(ranks, digest: bytes, pattern: str) -> ByteBpe:
    """The coder of this worker: one for all its tasks on one vocabulary, so that its tables are built once."""
    key = (digest, pattern)
    if coder_of.__dict__.get("key") != key:
        coder_of.key, coder_of.coder = key, ByteBpe(ranks.value, pattern)
    return coder_of.coder


def ranks_digest(ranks: dict[bytes, int]) -> bytes:
    """A digest of a vocabulary's tokens and ranks."""
    out = hashlib.blake2b(digest_size=16)
    for token, rank in sorted(ranks.items()):
        out.update(len(token).to_bytes(4) + token + rank.to_bytes(8))
    return out.digest()


def bpe_encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) for every row; vocabulary is the path of a file of ranks that the driver reads."""
    table = load_ranks(vocabulary)
    ranks, key = docs.sparkSession.sparkContext.broadcast(table), ranks_digest(table)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(ranks, key, pattern)
        for batch in batches:
            ids = coder.encode_texts([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    rows = docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias("text"))
    return map_in_arrow(rows, encode, f"`{id_col}` long, ids array<int>")


def bpe_decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) for every row of ids; decoded is binary, null ids count as none."""
    ranks = encoded.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {i: t for t, i in ranks.value.items()}
        for batch in batches:
            texts = [b"".join(map(tokens.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=[id_col, "decoded"])

    rows = encoded.select(encoded[id_col].cast("long").alias(id_col), encoded[ids_col].alias("ids"))
    return map_in_arrow(rows, decode, f"`{id_col}` long, decoded binary")


def bpe_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes every text and decodes the ids again."""
    table = load_ranks(vocabulary)
    ranks, key = docs.sparkSession.sparkContext.broadcast(table), ranks_digest(table)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(ranks, key, pattern)
        decimal = {i: str(i) for i in coder.tokens}.__getitem__
        for batch in batches:
            counts, coded, decoded = [], [], []
            for ids in coder.encode_texts([t or "" for t in batch.column(1).to_pylist()]):
                ids = ids.tolist()
                counts.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            cells = [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(cells, names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return map_in_arrow(rows, digest, DIGESTS).withColumnRenamed("id", id_col)
