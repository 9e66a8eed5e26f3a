"""Optimal assignment of blocks that no single task could solve: an auction whose rounds are Spark jobs.

Every row of a block's smaller group (a bidder) gets a partner of the larger one (an item). Items have
prices, 0 at first. A bidder without an item bids for the one of least cost plus price, so much that
it would be content with its second choice but for ``epsilon``; the highest bid takes the item, and
its former holder bids again. An item that once got a bid is held from then on, so at the end all items
without a holder are free, and the total is at most (number of bidders) * epsilon above the least one.

Both groups are numbered along their columns and cut into strips of equally many rows. A round deals
bidders to tasks by cells of two strips each, with the items of these and of ``reach`` strips on either
side, at the prices that the last round wrote. A task plays the auction of its own bidders to its end
and sends the bids that stand; the highest bid for an item wins. (Other tasks' bids can only have raised
prices, so whoever keeps an item is as content as it was with its own task's prices.) Items beyond the
reach cost a bidder at least its distance, along the first column, from where they begin; if its
second choice is dearer than that it asks for a wider reach instead of bidding, so bids are those of the
whole block. Cells of odd and even rounds overlap by a strip: neighbours whom one round parts meet in
the next. Only cells with bidders that hold nothing are played, so rounds become small soon.
"""

from __future__ import annotations

import logging
from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.session import hadoop_path, shared_dir, ship_package, written
from .cumulative import with_range

log = logging.getLogger(__name__)
#: Rows of a strip.
STRIP = 16_384
#: Of the bidders' mean cost in the first round: what a bid goes beyond the second choice.
EPSILON = 0.05
ROUNDS = 10_000
BIDS = "item bigint, price double, holder bigint, cost double"


def _strips(rows: DataFrame, columns: Sequence[str], size: int) -> DataFrame:
    """rows (block, id, columns) with their strip from 0 within the block, in the order of columns and id, counted range by range."""
    ranged = with_range(rows, columns[0])
    sizes = ranged.groupBy("block", "__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("block").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # at most RANGES rows a block
    sizes = sizes.select("block", "__range", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("block", "__range").orderBy(*columns, "id")) - 1
    placed = ranged.withColumn("__i", inside).join(sizes, ["block", "__range"])
    return placed.withColumn("strip", F.expr(f"(__i + __before) div {size}")).drop("__i", "__before", "__range")


def played(bidders: pd.DataFrame, items: pd.DataFrame, columns: Sequence[str], epsilon: float) -> pd.DataFrame:
    """One task's auction: bids that stand, and (null, null, bidder, null) of bidders whose second choice may be beyond the reach.

    bidders: (bidder, below, above, columns), below and above being the ends of the reach on the first
    column; items: (item, price, holder, columns).
    """
    x, who = bidders[columns].to_numpy(float), bidders["bidder"].to_numpy(np.int64).tolist()
    gap = np.minimum(x[:, 0] - bidders["below"].to_numpy(float), bidders["above"].to_numpy(float) - x[:, 0])
    y, prices, names = items[columns].to_numpy(float), items["price"].to_numpy(float).copy(), items["item"].to_numpy(np.int64)
    place = {b: i for i, b in enumerate(who)}
    holder = [place.get(int(h), -2) if ok else -1 for h, ok in zip(items["holder"].fillna(-1), items["holder"].notna())]  # -1: none, -2: elsewhere
    holding = {h for h in holder if h >= 0}
    queue = deque(i for i in range(len(who)) if i not in holding and not bidders["held"].iloc[i])
    bids: dict[int, int] = {}
    short: list[int] = []
    while queue:
        i = queue.popleft()
        asked = np.sqrt(((y - x[i]) ** 2).sum(axis=1)) + prices
        j = int(asked.argmin()) if len(asked) else -1
        least = float(asked[j]) if len(asked) else np.inf
        if len(asked):
            asked[j] = np.inf
        second = float(asked.min()) if len(asked) > 1 else np.inf
        if min(second, 1e300) > gap[i]:
            short.append(i)
            continue
        prices[j] += (second - least if np.isfinite(second) else 0.0) + epsilon
        before, holder[j] = holder[j], i
        bids[j] = i
        if before >= 0:
            queue.append(before)
    found = list(bids)
    cost = [float(np.sqrt(((y[j] - x[bids[j]]) ** 2).sum())) for j in found]
    none = len(short)
    return pd.DataFrame({
        "item": pd.array([*names[found].tolist(), *[None] * none], "Int64"), "price": [*prices[found].tolist(), *[None] * none],
        "holder": pd.array([*(who[bids[j]] for j in found), *(who[i] for i in short)], "Int64"), "cost": [*cost, *[None] * none],
    })


def _forget(*tables: DataFrame | None) -> None:
    """Deletes written tables that no later round reads."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()} if df is not None else ():
            if path.removeprefix("file:").lstrip("/").startswith(shared_dir(df.sparkSession).removeprefix("file:").lstrip("/")):
                where, files = hadoop_path(df.sparkSession, path)
                files.delete(where, True)


def auction(bidders: DataFrame, items: DataFrame, columns: Sequence[str], epsilon: float = EPSILON, strip: int = STRIP) -> tuple[DataFrame, float]:
    """((block, bidder, item, cost, price) for every bidder, the epsilon used).

    bidders, items: (block, id, columns); a block has at least as many items as bidders, and ids are unique.
    """
    spark, columns = bidders.sparkSession, list(columns)
    ship_package(spark)
    every = bidders.select("block", "id", *columns, F.lit(True).alias("bids")).unionByName(items.select("block", "id", *columns, F.lit(False).alias("bids")))
    placed = written(_strips(every, columns, strip))
    axis = columns[0]
    ends = written(placed.groupBy("block", "strip").agg(F.min(axis).alias("low"), F.max(axis).alias("high"), F.count_if("bids").alias("n")))
    strips, n = ends.agg(F.max("strip"), F.sum("n")).first()
    empty = spark.createDataFrame([], BIDS)
    if not n:
        return empty.select(F.lit(None).cast("bigint").alias("block"), F.col("holder").alias("bidder"), "item", "cost", "price"), 0.0
    own = placed.where("bids").select("block", F.col("id").alias("bidder"), "strip", *columns)
    goods = placed.where("not bids").select("block", F.col("id").alias("item"), "strip", *columns)
    # the scale of costs: from each bidder to the middle of the items of its strip, at first
    middle = goods.groupBy("block", "strip").agg(*(F.avg(c).alias(f"m_{c}") for c in columns), F.count("*").alias("k"))
    far = F.sqrt(sum(((F.col(c) - F.col(f"m_{c}")) ** 2 for c in columns), F.lit(0.0))) / F.sqrt("k")
    step = epsilon * (own.join(middle, ["block", "strip"]).agg(F.avg(far)).first()[0] or 0.0) or 1e-12
    state, reach = empty, 1
    kept: DataFrame | None = None
    for turn in range(ROUNDS):
        of = lambda c: F.expr(f"({c} + {turn % 2}) div 2")
        holders = state.select(F.col("holder").alias("bidder"), F.lit(True).alias("held"))
        now = own.join(holders, "bidder", "left").withColumns({"held": F.coalesce("held", F.lit(False)), "cell": of("strip")})
        active = written(now.where("not held").select("block", "cell").distinct())
        # a cell's strips and those in reach, and where what is beyond begins
        first, last = 2 * F.col("cell") - turn % 2 - reach, 2 * F.col("cell") - turn % 2 + 1 + reach
        window = active.withColumns({"first": first, "last": last})
        beyond = window.alias("w").join(ends.alias("e"), "block").groupBy("block", "cell").agg(
            F.coalesce(F.max(F.when(F.col("strip") < F.col("first"), F.col("high"))), F.lit(float("-inf"))).alias("below"),
            F.coalesce(F.min(F.when(F.col("strip") > F.col("last"), F.col("low"))), F.lit(float("inf"))).alias("above"),
        )
        here = now.join(beyond, ["block", "cell"]).select("block", "cell", "bidder", "held", "below", "above", *columns)
        met = goods.join(window.select("block", "cell", F.explode(F.sequence(F.greatest("first", F.lit(0)), F.least("last", F.lit(strips)))).alias("strip")), ["block", "strip"])
        met = met.join(state.select("item", "price", "holder"), "item", "left").select("block", "cell", "item", F.coalesce("price", F.lit(0.0)).alias("price"), "holder", *columns)
        here, met = here.toDF(*here.columns), met.toDF(*met.columns)
        play = lambda a, b: played(a, b, columns, step)
        bids = written(here.groupBy("block", "cell").cogroup(met.groupBy("block", "cell")).applyInPandas(play, BIDS))
        got, short = bids.agg(F.count("item"), F.count_if(F.col("item").isNull())).first()
        log.debug("round %d: %d bids, %d bidders ask for a wider reach than %d", turn, got, short, reach)
        _forget(active)
        if not got and not short:
            _forget(bids)
            break
        standing = state.unionByName(bids.where("item is not null"))
        after = written(standing.groupBy("item").agg(F.max(F.struct("price", "holder", "cost")).alias("x")).select("item", "x.price", "x.holder", "x.cost"))
        _forget(bids, kept)
        state = kept = after
        if short:
            reach = min(2 * reach, strips + 1)
    else:
        raise RuntimeError(f"no assignment after {ROUNDS} rounds")
    pairs = state.select(F.col("holder").alias("bidder"), "item", "cost", "price").join(own.select("block", "bidder"), "bidder")
    return pairs.select("block", "bidder", "item", "cost", "price"), step


def lower_bound(bidders: DataFrame, items: DataFrame, columns: Sequence[str], prices: DataFrame, chunks: int = 64, parts: int = 8) -> float:
    """The dual bound of item prices (item, price): no assignment of all bidders costs less. All pairs of a block are compared, chunk by chunk."""
    priced = items.join(prices.select(F.col("item").alias("id"), "price"), "id", "left").fillna(0.0, ["price"])
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    of = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    a = bidders.withColumn("part", of(parts)).withColumn("chunk", every(chunks))
    b = priced.withColumn("chunk", of(chunks)).withColumn("part", every(parts))
    names = list(columns)

    def least(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "least": np.zeros(0)})
        u, v = x[names].to_numpy(float), y[names].to_numpy(float)
        cost = np.sqrt(sum((u[:, None, j] - v[None, :, j]) ** 2 for j in range(len(names)))) + y["price"].to_numpy(float)[None, :]
        return pd.DataFrame({"id": x["id"].to_numpy(np.int64), "least": cost.min(axis=1)})

    found = a.groupBy("block", "part", "chunk").cogroup(b.groupBy("block", "part", "chunk")).applyInPandas(least, "id bigint, least double")
    of_bidders = found.groupBy("id").agg(F.min("least").alias("least")).agg(F.sum("least")).first()[0] or 0.0
    return float(of_bidders) - float(prices.agg(F.sum("price")).first()[0] or 0.0)
