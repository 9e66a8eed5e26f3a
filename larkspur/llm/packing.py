"""Conflict-constrained best-fit packing of documents into training sequences.

A document's size is its words, or the number in a column such as its count of tokens, and one end
mark. Documents of more than ``capacity`` are cut into pieces; a piece of the whole capacity is a bin of its own, and what remains
is packed. Bins are kept by residual capacity, with a bitmap of the residuals that some bin has:
find-first-set from a document's size on gives the tightest bin. Each bin carries a bitmap of the
duplicate clusters in it, and bitmaps of its sources (one for each of the ``per_source`` documents that
it may have of one source). If the tightest bin holds the document's cluster, or its source often
enough, the search goes on to that bin's successor, until the tightest compatible bin is found; if
there is none, a bin is opened. Documents go in by falling size (best fit decreasing).

A cluster is by default the documents whose words are equal but for upper case of A-Z; a column of
cluster ids, such as a near-duplicate component, may be given instead. Unless ``per_source`` is given
it is PER_SOURCE, or if that is more, twice what the largest source needs a bin on average, so a corpus
of few sources or of short documents fills its bins. Rows that have no words, or no source, conflict
with nothing on that account.

Only (id, size, source, cluster) is written and shuffled: rows are dealt evenly, whatever their keys,
over tasks of about TASK_ROWS, and each task packs runs of GROUP_ROWS on their own, so memory is
bounded, hot sources and clusters are spread over all bins, and only the loose bins at the end of a
run, a few of tens of thousands, are less full than in a single run. A row's place in the dealing is a
hash of the row, so that a task which runs again after a lost executor sees the same rows.

Nulls and odd input: a null or empty text is a document of its end mark alone; a null id is kept;
repeated rows are packed each, in different bins, as their texts are equal; ties in size go in the
order of id; other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_in_arrow, materialize

CAPACITY = 2048
PER_SOURCE = 4
TASK_ROWS = GROUP_ROWS = 65_536
#: Refusing bins that are met one by one; a bitmap of them is kept beyond.
FEW_BINS = 32
SPACE = "[ \\t\\n\\x0b\\f\\r]"
PLACED = "doc_id long, piece int, start long, size int, bin long, position int, bin_size int"


class Bins:
    """Open bins by residual capacity; ``place`` finds the tightest compatible one, of equally tight ones the oldest.

    Each bin carries bitmaps of its clusters and sources. Those of clusters and sources with many
    documents are kept the other way round too, as bitmaps of the bins that refuse them, so the search
    steps over any number of refusing bins at once; the bins' own bitmaps settle the few others.
    """

    def __init__(self, capacity: int, per_source: int):
        self.per_source = per_source
        self.residuals = 0  # bit r: some bin has residual r
        self.at = [0] * (capacity + 1)  # bitmap of the bins of each residual
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []  # of each bin: bitmap of sources with more than 0, 1, ... documents
        self.left: list[int] = []
        self.capacity = capacity
        self._bins_of: dict[tuple[str, int], list[int]] = {}  # bins that refuse a cluster or a source, up to FEW_BINS
        self._refusing: dict[tuple[str, int], int] = {}  # their bitmap, beyond

    def place(self, size: int, source: int, cluster: int) -> int:
        """The bin that takes a document; source and cluster are bits, 0 for none."""
        refuse = self._refusing.get(("c", cluster), 0) | self._refusing.get(("s", source), 0)
        full, residual = self.per_source - 1, size
        while rest := self.residuals >> residual:
            residual += (rest & -rest).bit_length() - 1
            open_ = self.at[residual] & ~refuse if refuse else self.at[residual]
            while open_:
                low = open_ & -open_
                b = low.bit_length() - 1
                if not (self.clusters[b] & cluster or self.sources[b][full] & source):
                    self.at[residual] ^= low
                    if not self.at[residual]:
                        self.residuals ^= 1 << residual
                    self._add(b, residual - size, source, cluster)
                    return b
                open_ ^= low
            residual += 1
        self.clusters.append(0)
        self.sources.append([0] * self.per_source)
        self.left.append(self.capacity)
        b = len(self.left) - 1
        self._add(b, self.capacity - size, source, cluster)
        return b

    def _add(self, b: int, residual: int, source: int, cluster: int) -> None:
        self.left[b] = residual
        self.at[residual] |= 1 << b
        self.residuals |= 1 << residual
        self.clusters[b] |= cluster
        if cluster:
            self._refused("c", cluster, b)
        planes = self.sources[b]
        for k in range(self.per_source):
            if not planes[k] & source:
                planes[k] |= source
                if source and k == self.per_source - 1:
                    self._refused("s", source, b)
                break

    def _refused(self, kind: str, bit: int, b: int) -> None:
        """Notes that a bin refuses a cluster or source from now on."""
        key = kind, bit
        if key in self._refusing:
            self._refusing[key] |= 1 << b
            return
        bins = self._bins_of.setdefault(key, [])
        bins.append(b)
        if len(bins) > FEW_BINS:
            self._refusing[key] = sum(1 << x for x in self._bins_of.pop(key))


def _bits(values: np.ndarray, known: np.ndarray, alone: bool) -> list[int]:
    """A bit for each value that is known; alone: also for values that occur once, which can't conflict else."""
    _, number, count = np.unique(values, return_inverse=True, return_counts=True)
    use = known & (count[number] > (0 if alone else 1))
    _, number = np.unique(number, return_inverse=True)
    few = np.unique(number[use])
    place = np.searchsorted(few, number)
    return [1 << p if u else 0 for p, u in zip(place.tolist(), use.tolist())]


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int, per_source: int) -> list[int]:
    """The bin of each document, in the order given, which should be by falling size.

    sources and clusters: any integers; 0 is none.
    """
    bins = Bins(capacity, per_source)
    places = zip(sizes.tolist(), _bits(sources, sources != 0, False), _bits(clusters, clusters != 0, False))
    return [bins.place(*x) for x in places]


def _packer(capacity: int, per_source: int, group_rows: int):
    def pack(table: pa.Table, first_bin: int) -> tuple[pa.RecordBatch, int]:
        table = table.sort_by([("size", "descending"), ("source", "ascending"), ("cluster", "ascending"), ("id", "ascending")])
        full = table.column("cut").to_numpy() // capacity  # pieces that are a bin of their own
        rest = table.column("size").to_numpy()
        ids = table.column("id").to_numpy(zero_copy_only=False) if not table.column("id").null_count else None
        packed = np.flatnonzero(rest > 0)
        bins = np.array(best_fit(rest[packed], table.column("source").to_numpy()[packed], table.column("cluster").to_numpy()[packed], capacity, per_source), np.int64)
        n_bins = int(bins.max()) + 1 if len(bins) else 0
        order = np.argsort(bins, kind="stable")
        starts = np.searchsorted(bins[order], np.arange(n_bins))
        position = np.empty(len(bins), np.int64)
        position[order] = np.arange(len(bins)) - np.repeat(starts, np.diff(np.append(starts, len(bins))))
        filled = np.bincount(bins, weights=rest[packed], minlength=n_bins).astype(np.int64)
        owner = np.repeat(np.arange(len(full)), full)  # of each full piece
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
        whose = np.concatenate((owner, packed))
        cells = {
            "piece": np.concatenate((piece, full[packed])),
            "start": np.concatenate((piece * capacity, full[packed] * capacity)),
            "size": np.concatenate((np.full(len(owner), capacity), rest[packed])),
            "bin": first_bin + np.concatenate((n_bins + np.arange(len(owner)), bins)),
            "position": np.concatenate((np.zeros(len(owner), np.int64), position)),
            "bin_size": np.concatenate((np.full(len(owner), capacity), filled[bins])),
        }
        types = {"piece": pa.int32(), "size": pa.int32(), "position": pa.int32(), "bin_size": pa.int32()}
        doc = pa.array(ids[whose], pa.int64()) if ids is not None else table.column("id").combine_chunks().take(pa.array(whose))
        columns = [doc, *(pa.array(v.astype(np.int64)).cast(types.get(k, pa.int64())) for k, v in cells.items())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", *cells]), first_bin + n_bins + len(owner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        next_bin = TaskContext.get().partitionId() << 40
        waiting, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, group_rows - n)
                batch = batch.slice(part.num_rows)
                waiting.append(part)
                n += part.num_rows
                if n == group_rows:
                    out, next_bin = pack(pa.Table.from_batches(waiting), next_bin)
                    yield out
                    waiting, n = [], 0
        if waiting:
            out, next_bin = pack(pa.Table.from_batches(waiting), next_bin)
            yield out

    return run


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, SPACE + "+"), lambda w: w != "")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, cluster_col: str | None, size_col: str | None) -> DataFrame:
    """(id, n, source, cluster) of every row: its units and end mark, hashes of its source and its cluster, 0 for none."""
    words = F.transform(F.array(words_of(docs[text_col].cast("string"))), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.xxhash64(w).alias("h")))[0]
    hashed = lambda c: F.when(c.isNotNull(), F.xxhash64(c)).otherwise(F.lit(0)).cast("long")
    given = [hashed(docs[cluster_col]).alias("given")] if cluster_col else []
    size = [F.greatest(F.coalesce(docs[size_col].cast("long"), F.lit(0)), F.lit(0)).alias("units")] if size_col else []
    rows = docs.select(docs[id_col].cast("long").alias("id"), hashed(docs[source_col]).alias("source"), words.alias("w"), *given, *size)
    cluster = F.col("given") if cluster_col else F.when(F.col("w.n") > 0, F.col("w.h")).otherwise(F.lit(0))
    return rows.select("id", ((F.col("units") if size_col else F.col("w.n")) + 1).alias("n"), "source", cluster.cast("long").alias("cluster"))


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, size_col: str | None = None,
    capacity: int = CAPACITY, per_source: int | None = None, task_rows: int = TASK_ROWS, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(id, piece, start, size, bin, position, bin_size) for every piece of every row of docs.

    A bin is a training sequence: its pieces by position, of ``size`` units (words, or what size_col
    counts) from unit ``start`` on. The last piece's end mark counts as one. bin_size is what the bin
    holds in all. A null or negative size counts as 0.
    """
    if capacity < 1 or group_rows < 1 or per_source is not None and per_source < 1:
        raise ValueError("capacity, per_source and group_rows are 1 at least")
    items = materialize(_sized(docs, id_col, text_col, source_col, cluster_col, size_col), "sizes")
    by_source = items.groupBy("source").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    rows, total, most = by_source.agg(F.sum("k"), F.sum("n"), F.max(F.when(F.col("source") != 0, F.col("k")))).first()
    if per_source is None:
        per_source = max(PER_SOURCE, -(-2 * (most or 0) // max(1, -(-(total or 0) // capacity))))
    tail = F.col("n") % capacity
    items = items.select("id", (F.col("n") - tail).alias("cut"), tail.alias("size"), "source", "cluster")
    tasks = max(2, -(-(rows or 0) // task_rows))
    dealt = items.repartition(tasks, F.xxhash64("id", "cut", "size", "cluster"))
    placed = map_in_arrow(dealt, _packer(capacity, per_source, group_rows), PLACED)
    return placed.withColumnRenamed("doc_id", id_col)


def sequences(docs: DataFrame, placed: DataFrame, units_col: str, end: Column, id_col: str = "doc_id") -> DataFrame:
    """(bin, units): the training sequences themselves, at most a capacity of units each; ids of docs must be unique.

    units_col: an array of each row's words or token ids, as many as were packed; end: the end mark. A
    row with a null id is in no sequence.
    """
    units = docs.select(id_col, F.concat(F.coalesce(F.col(units_col), F.array()), F.array(end)).alias("units"))
    parts = placed.join(units, id_col).select("bin", "position", F.slice("units", F.col("start").cast("int") + 1, F.col("size")).alias("part"))
    in_order = F.sort_array(F.collect_list(F.struct("position", "part")))  # a bin's capacity bounds it
    return parts.groupBy("bin").agg(in_order.alias("parts")).select("bin", F.flatten(F.transform("parts", lambda p: p["part"])).alias("units"))
