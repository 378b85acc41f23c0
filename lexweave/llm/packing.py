"""Filling fixed-capacity containers with items: mixture-controlled packing.

Each source has a queue of items, and each container (window) has a target of
tokens per source: its share of the capacity.  What a window still lacks of a
source is that source's deficit there.  Windows are served in three passes.

* Items of more than a ``SMALL``-th of the capacity, largest first, each go to the
  window with the greatest deficit of their source that has room.
* Smaller items follow by deficit round-robin: window after window, in the order
  of the sources' deficits, from each queue the largest item that neither the
  room nor the deficit forbids.  Deficits live on from window to window.
* Texts larger than the capacity are the only ones that may be cut.  They are
  cut where windows have room left, from the source that lags most, so they level
  the mixture and fill the windows; no piece but a text's last is shorter than
  a ``LEAST_PIECE``-th of the capacity, unless the room it fills is.

Distribution.  Documents are spread by a hash of their id over shards of some
tens of thousands, so a source with a third of all documents is spread too.
Only a table of tokens per shard and source is summed up across shards: a
shard starts with the deficits that the shards before it leave, which are known
from these sums as every shard packs all it holds.  Shards then pack
independently.

Targets.  By default windows aim at the shares their shard has, so all are alike.
With given targets they aim at these while the scarcest source lasts, and the
remaining windows share what is left.

Defined results: null, empty and blank texts hold nothing to pack and are left
out; a null source is a source of its own; copies are packed as the separate
documents they are; null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import save
from .common import table
from .tokens import TOKENIZER, token_count

#: Documents a shard holds on average; it bounds the memory and time of a task and leaves one ill-filled window a shard.
SHARD_DOCS = 10_000
#: Parts of the capacity: up to which items are small, and the least a text is cut to.
SMALL, LEAST_PIECE = 32, 4
PLACED = "pack_name string, shard_no int, container_no long, slot_no int, doc_id long, source string, piece_no int, token_from long, n_tokens long, capacity_tokens int"


class _Queue:
    """Items of a source in order of size; the largest that fits is found by bisection."""

    def __init__(self, sizes: np.ndarray, items: np.ndarray) -> None:
        order = np.lexsort((-items, sizes))
        distinct, first = np.unique(sizes[order], return_index=True)
        self.sizes = distinct.tolist()
        self.stacks = [x.tolist() for x in np.split(items[order], first[1:])] if len(sizes) else []

    def take(self, room: int):
        """(size, item) of the largest item of at most ``room``, or None."""
        k = bisect_right(self.sizes, room) - 1
        if k < 0:
            return None
        size, item = self.sizes[k], self.stacks[k].pop()
        if not self.stacks[k]:
            del self.sizes[k], self.stacks[k]
        return size, item


def window_targets(have: np.ndarray, share: np.ndarray | None, capacity: int) -> np.ndarray:
    """Tokens of each source that each window aims at, a row per window; ``have`` are the tokens there are."""
    total = float(have.sum())
    n = max(1, int(np.ceil(total / capacity)))
    if share is None or not (share * have).any():
        return np.tile(have / max(total, 1.0) * capacity, (n, 1))
    share = share / share.sum()
    wanted = share > 0
    kept = min(n, int((have[wanted] / (share[wanted] * capacity)).min()))
    rest = np.maximum(have - kept * capacity * share, 0)
    rest = rest / max(rest.sum(), 1.0) * capacity
    return np.concatenate([np.tile(share * capacity, (kept, 1)), np.tile(rest, (n - kept, 1))])


def pack_windows(sizes: np.ndarray, source: np.ndarray, share: np.ndarray | None, deficit: np.ndarray, capacity: int):
    """Pieces of items in windows: (item, first token, tokens, container, slot).

    ``source`` numbers the sources, ``share`` is each one's target share (None:
    what the items have) and ``deficit`` the tokens it is owed at the start.
    """
    n_sources = len(deficit)
    weigh = lambda of: np.bincount(source[of], weights=sizes[of], minlength=n_sources)
    lack = window_targets(weigh(slice(None)), share, capacity)
    room = np.full(len(lack), float(capacity))
    out: list[tuple[int, int, int, int]] = []  # item, first token, tokens, window
    whole = sizes <= capacity
    least = max(1, capacity // LEAST_PIECE)

    large = np.flatnonzero(whole & (sizes > capacity / SMALL))
    for i in large[np.argsort(-sizes[large], kind="stable")]:
        s, size = source[i], sizes[i]
        score = np.where(room >= size, lack[:, s], -np.inf)
        w = int(score.argmax())
        if room[w] < size:
            lack, room, w = np.concatenate([lack, lack[-1:] * 0 + lack[-1].sum() / max(1, n_sources)]), np.append(room, capacity), len(room)
        out.append((int(i), 0, int(size), w))
        room[w] -= size
        lack[w, s] -= size
        positive = np.maximum(lack[w], 0)
        if positive.any():  # what is lacking must fit the room
            lack[w] = np.where(lack[w] > 0, positive * (room[w] / positive.sum()), lack[w])

    small = np.flatnonzero(whole & (sizes <= capacity / SMALL))
    queues = [_Queue(sizes[small[source[small] == s]], small[source[small] == s]) for s in range(n_sources)]
    texts = [[(int(i), 0) for i in np.flatnonzero(~whole & (source == s))][::-1] for s in range(n_sources)]
    some, liquid = weigh(small), weigh(np.flatnonzero(~whole))
    lack = np.maximum(lack, 0)
    lack *= (some + liquid) / np.maximum(lack.sum(0), 1e-9)  # in all, as much as there is
    poured = liquid.sum() / max(1.0, some.sum() + liquid.sum())
    owed = np.clip(deficit, -capacity, capacity).astype(float)
    # Windows with large items have low numbers, so they are served, and numbered, in a shuffled order.
    turn = np.random.default_rng(17).permutation(len(room))
    for w in turn.tolist():
        left = int(room[w])
        mine = (owed + lack[w]).tolist()
        kept_free = int(left * poured)
        live = [s for s in range(n_sources) if queues[s].sizes]
        while live and left > kept_free:
            s = max(live, key=mine.__getitem__)
            got = queues[s].take(min(left, max(int(mine[s]), queues[s].sizes[0])))
            if got is None:  # nothing of this source fits this window any more
                live.remove(s)
                continue
            size, item = got
            out.append((item, 0, size, w))
            left -= size
            mine[s] -= size
            if not queues[s].sizes:
                live.remove(s)
        live = [s for s in range(n_sources) if texts[s]]
        while live and left:
            s = max(live, key=mine.__getitem__)
            item, at = texts[s].pop()
            size = min(left, max(least, int(mine[s])), int(sizes[item]) - at)
            if left - size < least:
                size = min(left, int(sizes[item]) - at)
            out.append((item, at, size, w))
            left -= size
            mine[s] -= size
            if at + size < sizes[item]:
                texts[s].append((item, at + size))
            elif not texts[s]:
                live.remove(s)
        owed = np.array(mine)

    # What found no room: the largest that fits, window by window.
    n = len(room)
    rest = [(int(i), 0, int(size)) for q in queues for size, stack in zip(q.sizes, q.stacks) for i in stack]
    for left_over in texts:
        for item, at in left_over:
            while at < sizes[item]:
                rest.append((item, at, int(min(capacity, sizes[item] - at))))
                at += capacity
    queue = _Queue(np.array([r[2] for r in rest], np.int64), np.arange(len(rest)))
    while queue.sizes:
        left = capacity
        while got := queue.take(left):
            out.append((*rest[got[1]], n))
            left -= got[0]
            if not left:
                break
        n += 1
    item, at, size, window = (np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
    place = np.arange(n)
    place[turn] = np.arange(len(turn))
    window = place[window]
    order = np.lexsort((at, item, window))
    item, at, size, window = item[order], at[order], size[order], window[order]
    used, window = np.unique(window, return_inverse=True)
    slot = np.arange(len(window)) - np.searchsorted(window, window)
    return item, at, size, window, slot


def pack(docs: DataFrame, packs: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Documents (``doc_id``, ``source``, ``n_tokens``) to slots of containers of each capacity of ``packs``.

    ``targets`` (``source``, ``target_share``) are the token shares windows aim
    at; by default those of the collection.
    """
    sized = docs.where("n_tokens > 0").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "n_tokens")
    n = sized.count()
    shards = max(1, int(np.ceil(n / SHARD_DOCS)))
    shard = F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(shards)).cast("int")
    placed = sized.withColumn("shard_no", shard)
    # Shares and carried deficits, from a table of shards x sources.
    per = placed.groupBy("shard_no", "source").agg(F.sum("n_tokens").alias("tokens"))
    per = save(per, "shard-tokens").df
    by_source = per.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    if targets is None:
        share = by_source.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(1)))).select("source", "share")
    else:
        share = by_source.join(targets.select("source", F.col("target_share").alias("share")), "source", "left")
        share = share.select("source", F.coalesce("share", F.lit(0.0)).alias("share"))
    shard_total = per.groupBy("shard_no").agg(F.sum("tokens").alias("total"))
    # Sources are few (each window looks at all of them), so their shares are literals of the plan: a row per shard and source.
    shares = [F.struct(F.lit(r["source"]).alias("source"), F.lit(float(r["share"])).alias("share")) for r in share.collect()]
    shares = F.array(*shares) if shares else F.array().cast("array<struct<source:string,share:double>>")
    grid = shard_total.select("shard_no", "total", F.explode(shares).alias("x")).select("shard_no", "total", "x.source", "x.share")
    grid = grid.join(per, ["shard_no", "source"], "left")
    before = Window.partitionBy("source").orderBy("shard_no").rowsBetween(Window.unboundedPreceding, -1)
    owed = F.coalesce(F.sum(F.col("share") * F.col("total") - F.coalesce("tokens", F.lit(0))).over(before), F.lit(0.0))
    start = grid.select("shard_no", "source", "share", owed.alias("owed"))
    sized_packs = packs.where("capacity_tokens > 0").select("pack_name", F.col("capacity_tokens").cast("int").alias("c")).distinct().collect()
    caps = [F.struct(F.lit(r["pack_name"]).alias("pack_name"), F.lit(r["c"]).alias("capacity_tokens")) for r in sized_packs]
    caps = F.array(*caps) if caps else F.array().cast("array<struct<pack_name:string,capacity_tokens:int>>")
    each = lambda d: d.select("*", F.explode(caps).alias("x")).select("*", "x.pack_name", "x.capacity_tokens").drop("x")
    own = targets is None

    def run(key, pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        start = start.sort_values("source")
        names = start["source"].tolist()
        pdf = pdf.sort_values(["doc_id", "n_tokens"], kind="stable").reset_index(drop=True)
        size = pdf["n_tokens"].to_numpy(np.int64)
        source = pd.Index(names).get_indexer(pdf["source"])
        item, at, length, container, slot = pack_windows(size, source, None if own else start["share"].to_numpy(), start["owed"].to_numpy(), int(key[2]))
        first = np.lexsort((at, item))
        piece = np.empty(len(item), np.int64)
        piece[first] = np.arange(len(item)) - np.searchsorted(item[first], item[first])
        return pd.DataFrame(
            {
                "pack_name": key[0],
                "shard_no": np.int32(key[1]),
                "container_no": container,
                "slot_no": slot.astype(np.int32),
                "doc_id": pdf["doc_id"].to_numpy()[item],
                "source": pdf["source"].to_numpy()[item],
                "piece_no": piece.astype(np.int32),
                "token_from": at,
                "n_tokens": length,
                "capacity_tokens": np.int32(key[2]),
            }
        )

    keys = ["pack_name", "shard_no", "capacity_tokens"]
    return each(placed).groupBy(*keys).cogroup(each(start).groupBy(*keys)).applyInPandas(run, PLACED)


def window_distances(packed: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Each container with its tokens and its distance from the target: half the sum of the differences in shares (0 to 1).

    ``targets`` as for ``pack``; by default the shares of all that was packed.
    """
    window = ["pack_name", "capacity_tokens", "shard_no", "container_no"]
    if targets is None:
        per = packed.groupBy("pack_name", "source").agg(F.sum("n_tokens").alias("t"))
        share = per.select("pack_name", "source", (F.col("t") / F.sum("t").over(Window.partitionBy("pack_name"))).alias("share"))
    else:
        share = packed.select("pack_name").distinct().crossJoin(targets.select(F.coalesce("source", F.lit("")).alias("source"), F.col("target_share").alias("share")))
    got = packed.groupBy(*window, "source").agg(F.sum("n_tokens").alias("t"))
    got = got.withColumn("used", F.sum("t").over(Window.partitionBy(*window)))
    # A source that isn't in the window differs by its share, so only those that are need a row: 1 less what is common to both.
    common = F.least(F.col("t") / F.col("used"), F.coalesce("share", F.lit(0.0)))
    got = got.join(F.broadcast(share), ["pack_name", "source"], "left").groupBy(*window).agg(F.first("used").alias("used"), (1 - F.sum(common)).alias("distance"))
    return got.select(*window, "used", F.greatest("distance", F.lit(0.0)).alias("distance"))


def sized_documents(spark, sf_dir: str, path: str = TOKENIZER) -> DataFrame:
    """``doc_id``, ``source`` in its usual spelling, ``n_tokens`` of documents with text; written once as several steps read it."""
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\S"))
    name = F.regexp_replace(F.lower(F.trim("source")), r"[\s-]+", "_")
    # Texts differ much in size; spreading them evens out the tokenizing tasks.
    d = d.select("doc_id", name.alias("source"), "text")
    return save(d.select("doc_id", "source", token_count(F.col("text"), path).alias("n_tokens")), "sized").df


def p7_pack(spark, sf_dir: str) -> DataFrame:
    return pack(sized_documents(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p7_fill(spark, sf_dir: str) -> DataFrame:
    """Per capacity: containers, tokens, mean fill, and the mean distance of a container's mixture from the collection's."""
    c = window_distances(save(p7_pack(spark, sf_dir), "packed").df)
    return c.groupBy("pack_name", "capacity_tokens").agg(
        F.count("*").alias("containers"),
        F.sum("used").alias("tokens"),
        F.round(F.avg(F.col("used") / F.col("capacity_tokens")), 6).alias("mean_fill"),
        F.round(F.avg("distance"), 4).alias("mean_distance"),
    )


def p7_checks(spark, sf_dir: str) -> DataFrame:
    """Per capacity: documents placed, containers over their capacity, documents cut though they fit, documents with a
    token missing or placed twice, and whether containers are filled to 98 % on average."""
    sized = sized_documents(spark, sf_dir)
    p = save(pack(sized, table(spark, sf_dir, "pack_sizes")), "packed").df
    c = p.groupBy("pack_name", "capacity_tokens", "shard_no", "container_no").agg(F.sum("n_tokens").alias("used"))
    c = c.groupBy("pack_name").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("over_full"), (F.avg(F.col("used") / F.col("capacity_tokens")) >= 0.98).alias("filled"))
    # Pieces in a row: each starts where the one before ends.
    ahead = F.lag(F.col("token_from") + F.col("n_tokens"), 1, 0).over(Window.partitionBy("pack_name", "doc_id").orderBy("token_from"))
    d = p.withColumn("gap", F.col("token_from") != ahead).groupBy("pack_name", "capacity_tokens", "doc_id")
    d = d.agg(F.max("gap").alias("gap"), F.sum("n_tokens").alias("placed"), F.count("*").alias("pieces")).join(sized, "doc_id")
    d = d.groupBy("pack_name").agg(
        F.count("*").alias("docs"),
        F.count_if(F.col("gap") | (F.col("placed") != F.col("n_tokens"))).alias("broken"),
        F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity_tokens"))).alias("cut"),
    )
    return d.join(c, "pack_name").select("pack_name", "docs", "over_full", "cut", "broken", "filled")


QUERIES = {"p7_pack": p7_pack, "p7_fill": p7_fill, "p7_checks": p7_checks}
SQL = {
    "p7_checks": """SELECT pack_name, (SELECT count(*) FROM documents WHERE regexp_matches(text, '\\S')) AS docs, 0::BIGINT AS over_full, 0::BIGINT AS cut, 0::BIGINT AS broken, true AS filled
FROM (SELECT DISTINCT pack_name FROM pack_sizes WHERE capacity_tokens > 0)"""
}
