"""Conversation prefix trie: sorted runs with common-prefix lengths, a loser tree, nodes finished off an open path.

1. Turns become (digest, code points): 128 bits of SHA-256 over role and text, so texts aren't
   shuffled. A conversation is the string of its digests, 16 bytes a turn, so that plain byte order
   is the order of sequences and a prefix sorts before what it begins.
2. Copies are joined first: the ids of equal sequences, sorted by range over all tasks, are counted
   and hashed in a stream (``ends``), so a group of copies of any size is one sequence from here on.
3. Distinct sequences are dealt by range over tasks of about TURNS_A_TASK turns; this exchange, which
   spills to disk, is the external part. The ranges go by so many first turns that no more than HOT_ROWS
   sequences agree in all of them (``_depth_of_ranges``).
4. A task sorts runs of RUN_TURNS turns. Each run carries the LCP (number of shared first turns) of
   every sequence with the one before. A loser tree merges the runs: of two heads the one that
   shares more with the last winner comes first, unread; only equal LCPs make it read on, from there.
5. The merged stream moves an open path, a stack of nodes from the root. What the next sequence
   doesn't share is finished: a node knows its smallest member, members, children, leaves and saved
   tokens from what its children left with it.
6. A node on the path of a task's first or last sequence may go on in another task. Such nodes (a
   path's depth, twice a task) are left as partial sums, and one stream over all tasks' paths, in
   order, finishes them with the same open path. Finished nodes whose parent is among them get its id by a join.

The order of children is that of their digests, which no figure depends on.

Nulls and odd input: rows with a null conversation id belong to no conversation and are left out; a
null role or text is an empty one; null turns come first; turns of the same number are ordered by
their digests, and repeated rows are turns of their own; conversations that end up without turns are
members of the root alone; other columns aren't read; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, join_spread, map_in_arrow, materialize
from .common import hot_rows as hot_rows_of

KEY = 16
#: Turns that a task merges (about 20 bytes each), and turns of a sorted run.
TURNS_A_TASK, RUN_TURNS = 500_000, 16_384
#: Sequences that may agree in all turns that the ranges look at.
HOT_ROWS = 2_000
#: Bytes of joined ids that are handed on at once.
CHUNK_BYTES = 1 << 20
EVERY, MOST_SHARED = 100, 6
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
PARTS = "part int, place int, node binary, parent binary, key binary, chars bigint, " + NODES


# --- sequences of turns


def turn_sequences(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns (key, chars) in order."""
    role, text = F.coalesce(df[role_col], F.lit("")), F.coalesce(df[text_col], F.lit(""))
    key = F.substr(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(1), F.lit(2 * KEY))
    rows = df.select(df[conv_col].alias("conv_id"), F.struct(df[turn_col].alias("turn"), key.alias("key"), F.length(text).alias("chars")).alias("t")).where("conv_id is not null")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t["key"], t["chars"])).alias("turns"))


def rebuilt(sequences: DataFrame, every: int = EVERY, most: int = MOST_SHARED) -> DataFrame:
    """(conv_id, turns): the first h turns of conversation c - c % every, then c's own after its first h; h = crc32(c) % most."""
    c = F.col("conv_id")
    heads = sequences.where(c % every == 0).select(c.alias("base"), F.slice("turns", 1, most).alias("head"))
    rows = sequences.withColumns({"base": c - c % every, "h": (F.crc32(c.cast("string").cast("binary")) % most).cast("int")}).join(heads, "base", "left")
    none = F.slice("turns", 1, 0)
    shared = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    return rows.select("conv_id", F.concat(shared, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def packed(sequences: DataFrame) -> DataFrame:
    """(conv_id, seq, keys, chars): keys joined to bytes, and their digest."""
    keys = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), ""))
    return sequences.select("conv_id", keys.alias("keys"), F.transform("turns", lambda t: t["chars"]).alias("chars")).withColumn("seq", F.unhex(F.sha2("keys", 256)))


# --- copies: ids of equal sequences


def ends(members: DataFrame, tasks: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(seq, conv_id, n_ends, ends_sha256) for each seq of members (seq, conv_id): smallest id, count, digest of the ids in order.

    Ids are sorted by range, so a large group spans tasks. Those hash what is theirs alone, and hand on
    the joined ids of the first and last group, which may go on elsewhere, in chunks; a second stream,
    sorted, hashes these.
    """

    fields = pa.schema([("seq", pa.binary()), ("conv_id", pa.int64()), ("n_ends", pa.int64()), ("ends_sha256", pa.string()), ("ids", pa.string())])

    def stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bytes, list]]:
        """Equal seqs that follow each other, a batch at most, with their rows' other columns."""
        for batch in batches:
            seqs, rest = batch.column(0).to_pylist(), list(zip(*(batch.column(j).to_pylist() for j in range(1, batch.num_columns))))
            a = 0
            for b in range(1, len(seqs) + 1):
                if b == len(seqs) or seqs[b] != seqs[a]:
                    yield seqs[a], rest[a:b]
                    a = b

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, ids, size = None, True, [], 0  # open_: the group may have ids that aren't in ids

        def row(part: bool) -> tuple:
            joined = ",".join(ids)
            return (now, int(ids[0]), len(ids), None, joined) if part else (now, int(ids[0]), len(ids), hashlib.sha256(joined.encode()).hexdigest(), None)

        def rows() -> Iterator[tuple]:
            nonlocal now, open_, ids, size
            for seq, found in stretches(batches):
                if seq != now:
                    if ids:
                        yield row(open_)
                    open_, now, ids, size = now is None, seq, [], 0
                for (i,) in found:
                    ids.append(str(i))
                    size += len(ids[-1]) + 1
                    if size >= chunk_bytes:
                        yield row(True)
                        open_, ids, size = True, [], 0
            if ids:
                yield row(True)

        yield from _batches(rows(), fields)

    def rehashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, low, n, sha = None, None, 0, None
            for seq, found in stretches(batches):
                if seq != now:
                    if now is not None:
                        yield now, low, n, sha.hexdigest(), None
                    now, low, n, sha = seq, found[0][0], 0, hashlib.sha256()
                for _, k, ids in found:
                    sha.update((b"," if n else b"") + ids.encode())
                    n += k
            if now is not None:
                yield now, low, n, sha.hexdigest(), None

        yield from _batches(rows(), fields)

    kind = "seq binary, conv_id bigint, n_ends bigint, ends_sha256 string, ids string"
    dealt = members.select("seq", "conv_id").repartitionByRange(tasks, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    found = materialize(map_in_arrow(dealt, hashed, kind), "ends")
    parts = found.where("ids is not null").select("seq", "conv_id", "n_ends", "ids").repartition("seq").sortWithinPartitions("seq", "conv_id")
    whole = map_in_arrow(parts, rehashed, kind)
    return found.where("ids is null").unionByName(whole).drop("ids")


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a schema; large strings make smaller batches."""
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += 1 + sum(len(x) for x in r if isinstance(x, (str, bytes))) // 1000
        if weight >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


# --- sorted runs and their merge


@dataclass(slots=True)
class Sequence:
    """A distinct sequence of turns: their digests and code points, its smallest id, its copies, and the digest of their ids."""

    keys: bytes
    chars: list[int]
    conv_id: int
    n: int
    ends: str


def shared(a: bytes, b: bytes, since: int = 0) -> int:
    """Number of first turns that two sequences share, ``since`` of them known; compared in growing blocks, then by halves."""
    most, step = min(len(a), len(b)) // KEY, 1
    while since < most:
        end = min(most, since + step)
        if a[since * KEY : end * KEY] == b[since * KEY : end * KEY]:
            since, step = end, step * 4
            continue
        while end - since > 1:
            middle = (since + end) // 2
            if a[since * KEY : middle * KEY] == b[since * KEY : middle * KEY]:
                since = middle
            else:
                end = middle
        return since
    return most


@dataclass(slots=True)
class Run:
    """Sorted sequences; lcps[i] is what sequence i shares with the one before it (0 for the first)."""

    rows: list[Sequence]
    lcps: list[int]

    @staticmethod
    def of(rows: list[Sequence]) -> Run:
        rows.sort(key=lambda s: s.keys)
        return Run(rows, [0, *(shared(a.keys, b.keys) for a, b in zip(rows, rows[1:]))])


def merged(runs: list[Run]) -> Iterator[tuple[Sequence, int]]:
    """All sequences of the runs in order, each with its LCP with the one before.

    A tree of losers: a run's ``lcp`` is what its head shares with the winner that it lost to last, on
    the path of the run that has won that is the last sequence given out. So of two heads, the one with the
    larger LCP is the smaller; with equal ones they are compared from there on.
    """
    k = 1 << max(0, (len(runs) - 1).bit_length())
    at, lcp = [0] * len(runs), [0] * len(runs)

    def played(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs; -1 is a run that has ended."""
        if a < 0 or b < 0:
            return (b, a) if a < 0 else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        x, y = runs[a].rows[at[a]].keys, runs[b].rows[at[b]].keys
        h = shared(x, y, lcp[a])
        here = slice(h * KEY, (h + 1) * KEY)
        first, second = (b, a) if y[here] < x[here] else (a, b)
        lcp[second] = h
        return first, second

    champions = [-1] * k + [i if i < len(runs) and runs[i].rows else -1 for i in range(k)]
    losers = [-1] * k
    for node in range(k - 1, 0, -1):
        champions[node], losers[node] = played(champions[2 * node], champions[2 * node + 1])
    top = champions[1]
    while top >= 0:
        run = runs[top]
        yield run.rows[at[top]], lcp[top]
        at[top] += 1
        now, node = top, (k + top) // 2
        if at[top] < len(run.rows):
            lcp[top] = run.lcps[at[top]]
        else:
            now = -1
        while node:
            now, losers[node] = played(now, losers[node])
            node //= 2
        top = now


# --- nodes off an open path


@dataclass(slots=True)
class Node:
    """A node of the open path. ``edge``: it is on the path of the task's first sequence, so another task may have begun it."""

    key: bytes
    chars: int
    depth: int
    edge: bool
    id: bytes | None = None
    conv_id: int | None = None
    n: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str = EMPTY_SHA
    waiting: list[tuple] = field(default_factory=list)  # finished children, which wait for this node's smallest id

    def take(self, conv_id: int | None, n: int) -> None:
        self.n += n
        if conv_id is not None and (self.conv_id is None or conv_id < self.conv_id):
            self.conv_id = conv_id

    def row(self, parent: int | None) -> tuple:
        return self.conv_id, self.depth, parent, self.n, self.children, self.leaves, self.saved, self.ends

    def part(self) -> tuple:
        return self.row(None)

    def finished_into(self, parent: Node) -> None:
        """All of this node's rows are seen: its figures are final and are added to its parent's."""
        if not self.children:
            self.leaves = 1
        self.saved += (self.n - 1) * self.chars
        parent.take(self.conv_id, self.n)
        parent.children += 1
        parent.leaves += self.leaves
        parent.saved += self.saved


def node_id(parent: bytes, key: bytes) -> bytes:
    return hashlib.blake2b(parent + key, digest_size=KEY).digest()


ROOT_ID = node_id(b"", b"")


def trie_of(stream: Iterable[tuple[Sequence, int]], part: int) -> Iterator[tuple]:
    """Rows of PARTS for a task's sorted sequences: finished nodes, and partial ones on the paths of its first and last sequence."""
    path = [Node(b"", 0, 0, True, ROOT_ID)]
    leave = lambda node, place, parent: (part, place, node.id, parent, node.key, node.chars, *node.part())
    done = lambda node, rows: ((None, None, None, node.id, None, None, *r) for r in rows)
    first = True
    for s, lcp in stream:
        while len(path) > lcp + 1:
            node = path.pop()
            if node.edge:
                yield leave(node, node.depth, path[-1].id)
                continue
            node.finished_into(path[-1])
            for r in node.waiting:
                yield (None, None, None, None, None, None, r[0], r[1], node.conv_id, *r[3:])
            if path[-1].edge:
                yield from done(path[-1], [node.row(None)])
            else:
                path[-1].waiting.append(node.row(None))
        for d in range(lcp, len(s.chars)):
            key = s.keys[d * KEY : (d + 1) * KEY]
            path.append(Node(key, s.chars[d], d + 1, first, node_id(path[-1].id, key) if first else None))
        path[-1].take(s.conv_id, s.n)
        path[-1].ends = s.ends
        first = False
    if first:
        return
    for i, node in enumerate(path):
        if not node.edge:
            node.id = node_id(path[i - 1].id, node.key)
            yield from done(node, node.waiting)
        yield leave(node, node.depth if node.edge else (1 << 30) + node.depth, path[i - 1].id if i else None)


def finished_paths(parts: Iterable[tuple]) -> Iterator[tuple]:
    """(node, NODES) of all partial nodes, in the order of their tasks and places: merged, and finished off one open path."""
    path: list[Node] = []

    def close(depth: int) -> Iterator[tuple]:
        while len(path) > depth:
            node = path.pop()
            if path:
                node.finished_into(path[-1])
                path[-1].waiting.append((node.id, *node.row(None)))
            else:
                node.leaves += not node.children
                yield (node.id, *node.row(None))
            for r in node.waiting:
                yield (*r[:3], node.conv_id, *r[4:])

    for id_, key, chars, conv_id, depth, n, children, leaves, saved, ends_sha in parts:
        if len(path) <= depth or path[depth].id != id_:
            yield from close(depth)
            path.append(Node(key, chars, depth, False, id_))
        node = path[depth]
        node.take(conv_id, n)
        node.children += children
        node.leaves += leaves
        node.saved += saved
        node.ends = ends_sha if ends_sha != EMPTY_SHA else node.ends
    yield from close(0)


# --- the whole


def _depth_of_ranges(sequences: DataFrame, longest: int, hot_rows: int) -> int:
    """So many first turns that at most hot_rows sequences agree in all of them (or all turns there are)."""
    depth = 32
    while depth < longest:
        most = sequences.groupBy(F.xxhash64(F.substr("keys", F.lit(1), F.lit(depth * KEY)))).count().agg(F.max("count")).first()[0]
        if most <= hot_rows:
            break
        depth *= 2
    return depth


def prefix_trie(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    rebuild: bool = True,
    turns_a_task: int = TURNS_A_TASK,
    run_turns: int = RUN_TURNS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The nodes of the trie of all conversations; rebuild: of those with the shared first turns of ``rebuilt``."""
    spark = df.sparkSession
    sequences = turn_sequences(df, conv_col, turn_col, role_col, text_col)
    sequences = materialize(packed(rebuilt(sequences) if rebuild else sequences), "sequences")
    convs, turns = sequences.agg(F.count("*"), F.coalesce(F.sum(F.size("chars")), F.lit(0))).first()
    if not convs:
        discard(sequences)
        return spark.createDataFrame([], NODES)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(-(-turns // turns_a_task), min(spread, -(-turns // run_turns)), 1)
    id_tasks = max(-(-convs // turns_a_task), min(spread, -(-convs // run_turns)), 1)
    distinct = materialize(sequences.select("conv_id", "keys", "chars").join(ends(sequences, id_tasks), "conv_id").drop("seq"), "distinct")
    longest = distinct.agg(F.max(F.size("chars"))).first()[0]
    depth = _depth_of_ranges(distinct, longest, hot_rows)
    dealt = distinct.repartitionByRange(tasks, F.substr("keys", F.lit(1), F.lit(depth * KEY))).select("keys", "chars", "conv_id", "n_ends", "ends_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        runs, rows, held = [], [], 0
        for batch in batches:
            for s in map(Sequence, *(c.to_pylist() for c in batch.columns)):
                rows.append(s)
                held += len(s.chars) + 1
                if held >= run_turns:
                    runs.append(Run.of(rows))
                    rows, held = [], 0
        if rows:
            runs.append(Run.of(rows))
        yield from _batches(trie_of(merged(runs), TaskContext.get().partitionId()), PART_FIELDS)

    parts = materialize(map_in_arrow(dealt, run, PARTS), "nodes")
    discard(sequences, distinct)
    partial = parts.where("part is not null").select("part", "place", "node", "key", "chars", *(c for c in NODE_COLUMNS if c != "parent_conv_id"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns[2:])))
        yield from _batches(finished_paths(rows), FINISHED_FIELDS)

    finished = materialize(map_in_arrow(partial.coalesce(1).sortWithinPartitions("part", "place"), finish, "node binary, " + NODES), "paths")
    inner = parts.where("part is null").select(F.col("parent").alias("node"), *NODE_COLUMNS)
    settled, open_ = inner.where("node is null"), inner.where("node is not null")
    parents = finished.select("node", F.col("conv_id").alias("of_node"))
    if finished.count() <= BROADCAST_ROWS:
        joined = open_.join(F.broadcast(parents), "node")
    else:  # the root and other first nodes may have very many children
        hot = materialize(open_.groupBy("node").count().where(F.col("count") > hot_rows_of(turns)).select("node"), "hot")
        joined = join_spread(open_, parents, "node", hot, "inner")
    joined = joined.withColumn("parent_conv_id", F.col("of_node"))
    return settled.select(*NODE_COLUMNS).unionByName(joined.select(*NODE_COLUMNS)).unionByName(finished.select(*NODE_COLUMNS))


NODE_COLUMNS = [c.split()[0] for c in NODES.split(", ")]


def _fields(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


PART_FIELDS, FINISHED_FIELDS = _fields(PARTS), _fields("node binary, " + NODES)
