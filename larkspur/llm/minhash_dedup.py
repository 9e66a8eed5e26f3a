"""Near-duplicate documents by a chosen-path set similarity join, confirmed on full shingle sets.

1. Sketch. A document's set is its distinct five-word shingles (fewer words: the whole sequence as
   one). One pass takes COORDINATES minwise tokens of it, its size and a digest of it. Documents
   of one digest have one set and are one class from there on, stood for by its smallest id.
2. Trees. TREES independent trees branch the classes by selected minwise tokens. The first two
   levels of a tree are two tokens of its own; a node of at most SMALL classes is compared
   exhaustively by sketch, and classes that agree on LINK_AT or more tokens are tied. A larger node is
   dealt over tasks of SALT_ROWS classes, which all get the node's random anchors; every class is
   tied to all anchors that agree with it on LINK_AT or more tokens. Those on LEAVE_AT or more of an
   anchor's tokens leave the node: what agrees with them on k tokens agrees with that anchor on
   k - (COORDINATES - LEAVE_AT) at least, so it is as a rule tied to the anchor as well, whichever
   anchor is its own nearest. The rest branch on, by one further token a level, and in a share EXTRA
   of the nodes by two, until every node is small: a similar pair then keeps about
   0.85 (1 + EXTRA) > 1 common paths a level, while the pairs of a node that are less similar than
   1 / (1 + EXTRA), 0.71, become fewer with each level.
3. Confirmation. The components of the ties are a superset of the wanted ones. Each text in one is
   fetched once, and all pairs of a component are compared by their exact intersection sizes.
   Components beyond GROUP members are dealt over chunks that share anchors; classes that don't
   come out in the chunks' main component are then compared, in blocks, with every member that a
   link could reach: two linked sets share one of their rarest tokens (a prefix of 15 % and one).
   Only confirmed links count, and each group reports its components as stars of their smallest ids, not its pairs.
   Set sizes and intersections are exact but for collisions of the shingles' 64-bit hashes.
A pair of similarity s survives a tree's first two levels with probability s^2, so at 0.85 all
TREES miss it with probability (1 - 0.7225)^12 = 2e-7. That covers nodes of up to SMALL classes;
in larger ones it is anchors and further levels that find the pair, which tests hold against all pairs.

Nulls and odd input: a null, empty or blank text has no set and is linked with nothing; a null id
takes no part: its component is null and it is kept; equal rows are one document, all of them kept
or none; if an id has several texts it is linked as each of them is; columns other than the id and
the text are not read by ``near_duplicates``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, hot_rows, join_spread, map_in_arrow, materialize, small
from .components import connected_components
from .shingles import mix, shingle_sets

COORDINATES = 32
TREES = 12
LINK_AT = 17
LEAVE_AT = 26
SMALL = 1024
ANCHORS = 32
SALT_ROWS = 4096
EXTRA = 0.4
GROUP = 256
GROUP_SHINGLES = 2_000_000
BLOCK = 128
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 85
_RNG = np.random.Generator(np.random.PCG64(8506))
FACTOR = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDEND = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def minwise_tokens(shingles: np.ndarray) -> np.ndarray:
    """For each coordinate the smallest value of its hash over a non-empty set."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 4096):
        part = shingles[a : a + 4096]
        np.minimum(best, (part[None, :] * FACTOR[:, None] + ADDEND[:, None]).min(axis=1), out=best)
    return mix(best)


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, digest, nodes, sig): set size, digest of the set, depth-two tree nodes, 32-bit tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = np.arange(TREES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                sizes, digests, nodes, sigs = [], [], [], []
                for s in shingle_sets(texts):
                    sizes.append(len(s))
                    if not len(s):
                        digests.append(None)
                        nodes.append(None)
                        sigs.append(None)
                        continue
                    tokens = minwise_tokens(s)
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    nodes.append(mix(mix(tokens[: 2 * TREES : 2] + tree) ^ tokens[1 : 2 * TREES : 2]).view(np.int64))
                    sigs.append((tokens >> np.uint64(32)).astype(np.uint32).view(np.int32))
                cells = [part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(nodes, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cells, names=["id", "n", "digest", "nodes", "sig"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return map_in_arrow(rows, run, "id long, n long, digest binary, nodes array<long>, sig array<int>")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[pa.Table]]:
    """The groups of rows that come in order of keys, a list at a time; only the last group is held over."""

    def cut(table: pa.Table) -> list[pa.Table]:
        change = np.zeros(table.num_rows, bool)
        change[:1] = True
        for k in keys:
            c = table.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        cuts = [*np.flatnonzero(change).tolist(), table.num_rows]
        return [table.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]

    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        last = np.ones(table.num_rows, bool)
        for k in keys:
            c = table.column(k).to_numpy()
            last &= c == c[-1]
        whole = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if whole:
            yield cut(table.slice(0, whole))
        rest = table.slice(whole)
    if rest is not None and rest.num_rows:
        yield cut(rest)


def by_group(rows: DataFrame, keys: list[str], compare: Callable[[pa.Table], Iterator[tuple[int, int]]]) -> DataFrame:
    """Edges (a, b) that compare gives for each group of rows; groups are small, and stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _groups(batches, keys):
            edges = [e for g in groups for e in compare(g)]
            for a in range(0, len(edges), 50_000):
                x, y = zip(*edges[a : a + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return map_in_arrow(rows.repartition(*keys).sortWithinPartitions(*keys), run, "a long, b long")


def _stars(ids: list[int], pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each component of pairs (of positions) the links of its smallest id to the others.

    Stars rather than the pairs themselves: groups that overlap then mostly report the same links.
    """
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in pairs:
        a, b = root(i), root(j)
        if ids[a] > ids[b]:
            a, b = b, a
        parent[b] = a
    return [(ids[r], ids[i]) for i in range(len(ids)) if ids[r := root(i)] != ids[i]]


def _sigs(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES)


def tie_small(table: pa.Table) -> Iterator[tuple[int, int]]:
    """Exhaustive comparison of one node by sketch."""
    ids = table.column("rep").to_pylist()
    sig = _sigs(table.column("sig"))
    pairs: list[tuple[int, int]] = []
    for i in range(len(ids) - 1):
        pairs += [(i, i + 1 + j) for j in np.flatnonzero((sig[i + 1 :] == sig[i]).sum(axis=1) >= LINK_AT).tolist()]
        if len(pairs) > 100_000:
            pairs = _stars(list(range(len(ids))), iter(pairs))
    return iter(_stars(ids, iter(pairs)))


NEAR = "tree int, node long, rep long, sig array<int>, near boolean, tie long"


def _near_anchors(rows: DataFrame) -> DataFrame:
    """rows (tree, node, salt, rep, sig, anchor) with near and tie; each (node, salt) holds all the node's anchors.

    near: the class is an anchor, or shares LEAVE_AT tokens with one. tie: a class that it is tied to,
    directly or through others, by LINK_AT tokens shared with an anchor; null if it is its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _groups(batches, ["node", "salt"]):
            for g in groups:
                sig, ids, anchor = _sigs(g.column("sig")), g.column("rep").to_pylist(), g.column("anchor").to_numpy()
                near, pairs = anchor.copy(), []
                for k in np.flatnonzero(anchor).tolist():
                    shared = (sig == sig[k]).sum(axis=1)
                    near |= shared >= LEAVE_AT
                    pairs += [(k, i) for i in np.flatnonzero(shared >= LINK_AT).tolist() if i != k]
                tie = dict((b, a) for a, b in _stars(ids, iter(pairs)))
                cells = [g.column(c).combine_chunks() for c in ("tree", "node", "rep", "sig")]
                yield pa.RecordBatch.from_arrays([*cells, pa.array(near), pa.array([tie.get(i) for i in ids], pa.int64())], names=["tree", "node", "rep", "sig", "near", "tie"])

    dealt = rows.repartition("node", "salt").sortWithinPartitions("node", "salt")
    return map_in_arrow(dealt.select("tree", "node", "salt", "rep", "sig", "anchor"), run, NEAR)


def _counted(rows: DataFrame) -> DataFrame:
    """Nodes with at least two classes, and how many."""
    return rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")


def _with_sizes(rows: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """rows of nodes with at least two classes, and their node's size."""
    sizes = write(_counted(rows), "nodes")
    n, total = sizes.agg(F.count("*"), F.sum("size")).first()
    if small(sizes, n) is not sizes:
        return rows.join(small(sizes, n), "node")
    return join_spread(rows, sizes, "node", write(sizes.where(F.col("size") > hot_rows(total)).select("node"), "hot"), "inner")


def _chance(seed: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 40))


def tie(reps: DataFrame, write: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """Ties (a, b) between classes (rep, nodes, sig) that agree on LINK_AT tokens, found by the trees."""
    rows = reps.select("rep", F.posexplode("nodes").alias("tree", "node"))
    rows = _with_sizes(rows, write).join(reps.select("rep", "sig"), "rep").select("tree", "node", "rep", "sig", "size")
    rows = write(rows, "tree")
    ties = by_group(rows.where(F.col("size") <= SMALL), ["node"], tie_small)
    depth, large = 0, rows.where(F.col("size") > SMALL)
    while large.limit(1).count():
        if depth == COORDINATES // 2 - 2:
            # every token is used up; what is left of a node is tied together and left to confirmation
            first = large.groupBy("node").agg(F.min("rep").alias("first"))
            ties = ties.unionByName(large.join(first, "node").where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b")))
            break
        salts = F.ceil(F.col("size") / SALT_ROWS).cast("int")
        drawn = _chance(1, "rep", "node") * F.col("size") < ANCHORS * (1 << 40)
        own = F.pmod(F.xxhash64("rep", F.lit(2)), salts).cast("int")
        members = large.select("tree", "node", own.alias("salt"), "rep", "sig", drawn.alias("anchor"))
        # anchors go to all tasks of their node but their own, where they are members
        copies = large.where(drawn).select("tree", "node", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), own.alias("own"), "rep", "sig", F.lit(True).alias("anchor"))
        near = write(_near_anchors(members.unionByName(copies.where("salt <> own").drop("own"))), "tree")
        ties = ties.unionByName(near.where("tie is not null").select(F.col("rep").alias("a"), F.col("tie").alias("b")))
        depth += 1
        first = _chance(3 + depth, "node") < int(EXTRA * (1 << 40))
        branch = F.explode(F.when(first, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        at = (2 * F.col("tree") + 2 * F.lit(depth) + F.col("branch")) % COORDINATES
        open_ = near.where("not near").withColumn("branch", branch).select("tree", F.xxhash64("node", at, F.get("sig", at)).alias("node"), "rep", "sig")
        rows = write(_with_sizes(write(open_, "tree"), write), "tree")
        ties = ties.unionByName(by_group(rows.where(F.col("size") <= SMALL), ["node"], tie_small))
        large = rows.where(F.col("size") > SMALL)
    return ties


def linked_pairs(sets: list[np.ndarray], of: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Positions of all pairs of sets that are linked, by exact intersection sizes.

    of: if given, only pairs with at least one position for which it is true.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if common and 100 * common >= PERCENT * (int(sizes.sum()) - common):
            yield 0, 1
        return
    every = np.concatenate(sets)
    _, column, count = np.unique(every, return_inverse=True, return_counts=True)
    keep = count[column] > 1  # a shingle of one set is in no intersection
    row = np.repeat(np.arange(n), sizes)[keep]
    _, column = np.unique(column[keep], return_inverse=True)
    width, common = 4096, np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    cuts = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else -1) + 1 + width, width))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        part = np.zeros((n, width), np.float32)
        part[row[a:b], column[a:b] - k * width] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    ok = np.triu(100 * common >= PERCENT * (sizes[:, None] + sizes[None, :] - common), 1) & (common > 0)
    if of is not None:
        ok &= of[:, None] | of[None, :]
    for i, j in zip(*(x.tolist() for x in np.nonzero(ok))):
        yield i, j


def confirm(table: pa.Table) -> Iterator[tuple[int, int]]:
    """The components of the confirmed links of one group (rep, text, asked), as stars."""
    texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
    asked = table.column("asked").to_numpy()
    sets = list(shingle_sets(texts))
    return iter(_stars(table.column("rep").to_pylist(), linked_pairs(sets, None if asked.all() else asked)))


def _dealt(members: DataFrame, write: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """members (comp, rep, n) with size and the number of chunks of their component."""
    sizes = write(members.groupBy("comp").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")), "sizes")
    hot = sizes.where(F.col("size") > hot_rows(sizes.agg(F.sum("size")).first()[0] or 0)).select("comp")
    chunks = F.greatest(F.ceil(F.col("size") / GROUP), F.ceil(F.col("shingles") / GROUP_SHINGLES)).cast("int")
    return join_spread(members, sizes.select("comp", "size", F.when(F.col("size") <= 2, 1).otherwise(chunks).alias("chunks")), "comp", hot, "inner")


def _tokens(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(comp, rep, n, part, token): the shingle hashes of the texts of members (comp, rep, n, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])]
            cells = [batch.column(c) for c in ("comp", "rep", "n", "part")]
            yield pa.RecordBatch.from_arrays([*cells, pa.array(sets, pa.list_(pa.int64()))], names=["comp", "rep", "n", "part", "tokens"])

    texts = docs.join(members, docs["id"] == members["rep"]).select("comp", "rep", "n", "part", "text")
    out = map_in_arrow(texts, run, "comp long, rep long, n long, part long, tokens array<long>")
    return out.select("comp", "rep", "n", "part", F.explode("tokens").alias("token"))


def _reachable(docs: DataFrame, large: DataFrame, asked: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(rep, block): the members of large that share a rare token with a class of the block, which every link does.

    large: (comp, rep, n, part); asked: (rep, own_block). A linked pair has PERCENT % of either set in
    common, so of each set's tokens, rarest first, one of the first n - ceil(n PERCENT / 100) + 1 is common.
    """
    tokens = write(_tokens(docs, large), "tokens")
    often = write(tokens.groupBy("comp", "token").agg(F.count("*").alias("f")).where("f > 1"), "often")
    hot = often.where(F.col("f") > hot_rows(often.agg(F.sum("f")).first()[0] or 0)).select("comp", "token")
    ranked = join_spread(tokens, often, ["comp", "token"], hot, "left").withColumn("f", F.coalesce("f", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("comp", "rep").orderBy("f", "token"))
    prefix = ranked.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1).where("f > 1")
    prefix = write(prefix.select("comp", "token", "rep", "f"), "prefix")
    wanted = prefix.join(asked, "rep").select("comp", "token", F.col("own_block").alias("block"), "f").distinct()
    # a token of many members is spread over parts of SMALL
    parts = F.ceil(F.col("f") / SMALL).cast("int")
    wanted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("f")
    met = prefix.withColumn("salt", F.pmod(F.xxhash64("rep"), parts).cast("int")).join(wanted, ["comp", "token", "salt"])
    return met.select("rep", "block").distinct()


def confirmed_components(docs: DataFrame, members: DataFrame, write: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """(node, component) over confirmed links. docs: (id, text); members: (comp, rep, n) to compare."""
    dealt = write(_dealt(members, write), "members")
    texts = docs.join(small(dealt, dealt.count()), docs["id"] == dealt["rep"]).select("comp", "rep", "text", "size", "chunks")
    many = F.col("chunks") > 1
    anchor = many & (_chance(2, "rep") * F.col("size") < ANCHORS * (1 << 40))
    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    places = F.when(anchor, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own))
    grouped = texts.select("comp", "rep", "text", F.lit(True).alias("asked"), F.explode(places).alias("chunk"))
    edges = write(by_group(grouped, ["comp", "chunk"], confirm), "links")
    found = connected_components(edges, write)
    if not dealt.where(many).limit(1).count():
        return found
    found = write(found, "components")
    large = dealt.where(many).join(found, F.col("rep") == F.col("node"), "left").select("comp", "rep", "n", "size", "chunks", F.coalesce("component", "rep").alias("part"))
    large = write(large, "members")
    main = large.groupBy("comp", "part").agg(F.count("*").alias("k")).groupBy("comp").agg(F.max_by("part", F.struct("k", "part")).alias("main"))
    # large components are the hot keys of all that follows; the others are in no join by component
    total = large.count()
    hot = write(large.where(F.col("size") > hot_rows(total)).select("comp").distinct(), "hot")
    left = join_spread(large, write(main, "main"), "comp", hot, "inner").where("part <> main")
    blocks = left.groupBy("comp").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("int").alias("blocks"))
    blocks = write(blocks, "blocks")
    if not blocks.limit(1).count():
        return found
    asked = join_spread(left.select("comp", "rep"), blocks, "comp", hot, "inner").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int"))
    asked = write(asked.select("rep", F.col("block").alias("own_block")), "asked")
    loose = join_spread(large, blocks.select("comp"), "comp", hot, "left_semi")
    reach = write(_reachable(docs, loose.select("comp", "rep", "n", "part"), asked, write), "reach")
    every_chunk = F.sequence(F.lit(0), F.col("chunks") - 1)
    # a left-over class goes, asked, to every chunk of its block; every class that a link could reach to its chunk of that block
    as_member = loose.join(reach, "rep").select("comp", "rep", "block", own.alias("chunk"), F.lit(False).alias("asked"))
    as_asked = loose.join(asked, "rep").select("comp", "rep", F.col("own_block").alias("block"), F.explode(every_chunk).alias("chunk"), F.lit(True).alias("asked"))
    plan = as_member.unionByName(as_asked).groupBy("comp", "rep", "block", "chunk").agg(F.max("asked").alias("asked"))
    plan = write(plan, "plan")
    texts = docs.join(small(plan, plan.count()), docs["id"] == plan["rep"]).select("comp", "rep", "text", "block", "chunk", "asked")
    more = by_group(texts, ["comp", "block", "chunk"], confirm)
    return connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), write)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs."""
    used: list[DataFrame] = []

    def write(df: DataFrame, name: str) -> DataFrame:
        used.append(materialize(df, name))
        return used[-1]

    known = materialize(sketch(docs, id_col, text_col), "sketch")
    classes = known.where("digest is not null and id is not null").groupBy("digest")
    classes = classes.agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.first("n").alias("n"), F.first("nodes").alias("nodes"), F.first("sig").alias("sig"))
    classes = write(classes, "classes")
    tied = connected_components(tie(classes, write), write)
    members = tied.join(classes.select("rep", "n"), F.col("node") == F.col("rep")).select(F.col("component").alias("comp"), "rep", "n")
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    found = confirmed_components(texts, members.distinct(), write)
    labels = classes.join(found, F.col("rep") == F.col("node"), "left").select("digest", "rep", "last", F.coalesce("component", "rep").alias("component_id"))
    labels = materialize(labels.where("last <> rep or component_id <> rep").select("digest", "component_id"), "labels")
    discard(*used)
    # a digest of many copies is joined where its rows are, whatever the size of the table
    n, rows = labels.count(), known.count()
    if small(labels, n) is not labels:
        out = known.select("id", "n", "digest").join(small(labels, n), "digest", "left")
    else:
        crowded = known.groupBy("digest").agg(F.count("*").alias("k")).where(F.col("k") > hot_rows(rows))
        out = join_spread(known.where("digest is not null").select("id", "n", "digest"), labels, "digest", materialize(crowded.where("digest is not null").select("digest"), "hot"), "left")
        out = out.unionByName(known.where("digest is null").select("id", "n", "digest").withColumn("component_id", F.lit(None).cast("long")))
    component = F.coalesce("component_id", "id")
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that aren't kept; rows of a null id stay."""
    gone = near_duplicates(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("__gone")).distinct()
    gone = materialize(gone, "gone")
    gone = small(gone, gone.count())
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
