"""Shards of even size that keep linked documents together: balanced label propagation.

Documents start in hash-random shards. In each round every linked document counts its neighbours' shards (a join of
links and labels) and asks to move to the one with most. Quotas from the shard-to-shard request counts decide how
many may: swaps that balance each other go through, and one-way moves as far as the target has room. Only half the
documents ask in a round, so neighbours don't swap places for ever. After the last round each group of linked
documents as a whole goes to the shard that most of it is in, or to another with room for all of it. Documents without
links fill up the shards.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shellac.llm.scratch import with_position, written

ROUNDS = 8
#: Groups with more rows than the whole table's over this are placed one after the other, so at most as many.
LARGE_GROUPS = 10_000


def _quotas(asked: DataFrame, sizes: DataFrame, shards: int, quota: int) -> DataFrame:
    """(shard, wanted, share): the share of requests from shard to wanted that goes through.

    Tables of at most shards * shards rows. Swaps up to the lesser count of the two directions keep sizes; what is
    left may use the target's room, each asking shard in proportion."""
    back = asked.select(F.col("shard").alias("wanted"), F.col("wanted").alias("shard"), F.col("asking").alias("back"))
    pairs = asked.join(F.broadcast(back), ["shard", "wanted"], "left").withColumn("swap", F.least("asking", F.coalesce("back", F.lit(0))))
    pairs = pairs.withColumn("more", F.col("asking") - F.col("swap"))
    pairs = pairs.withColumn("all_more", F.sum("more").over(Window.partitionBy("wanted")))
    room = sizes.select(F.col("shard").alias("wanted"), F.greatest(F.lit(0), F.lit(quota) - F.col("rows")).alias("room"))
    pairs = pairs.join(F.broadcast(room), "wanted", "left").withColumn("room", F.coalesce("room", F.lit(quota)))
    granted = F.when(F.col("all_more") > 0, F.least(F.lit(1.0), F.col("room") / F.col("all_more")) * F.col("more")).otherwise(0)
    return pairs.select("shard", "wanted", ((F.col("swap") + granted) / F.col("asking")).alias("share"))


def propagate(links: DataFrame, shards: int, quota: int, rounds: int = ROUNDS) -> DataFrame:
    """(node, shard) for every node of `links` (columns a, b, each link once), after label propagation under a quota
    of nodes for each shard.

    The quotas hold up to the chance of the hash draws by which requests go through, and nodes that had no turn may
    remain apart; the caller levels and gathers what remains.
    """
    both = written(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    nodes = both.select(F.col("a").alias("node")).distinct()
    labels = written(nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")))
    for number in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("b"), F.col("shard").alias("wanted")), "b")
        votes = votes.groupBy("a", "wanted").agg(F.count(F.lit(1)).alias("votes"))
        # most votes first; of ties the lesser shard
        best = votes.groupBy("a").agg(F.max(F.struct("votes", (-F.col("wanted")).alias("minus"))).alias("best"))
        own = labels.join(votes.select(F.col("a").alias("node"), F.col("wanted").alias("shard"), F.col("votes").alias("own")), ["node", "shard"], "left")
        asks = own.join(best.withColumnRenamed("a", "node"), "node").select(
            "node", "shard", (-F.col("best.minus")).alias("wanted"), (F.col("best.votes") - F.coalesce("own", F.lit(0))).alias("gain")
        )
        turn = F.pmod(F.xxhash64("node", F.lit(number)), F.lit(2)) == 0
        asks = written(asks.withColumn("asks", (F.col("gain") > 0) & turn & (F.col("shard") != F.col("wanted"))))
        asked = asks.filter("asks").groupBy("shard", "wanted").agg(F.count(F.lit(1)).alias("asking"))
        sizes = labels.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
        share = F.broadcast(_quotas(asked, sizes, shards, quota))
        draw = F.shiftrightunsigned(F.xxhash64("node", F.lit(number), F.lit("draw")), 11) / F.lit(float(1 << 53))
        moved = asks.join(share, ["shard", "wanted"], "left").withColumn("moves", F.col("asks") & (draw < F.coalesce("share", F.lit(0.0))))
        labels = written(moved.select("node", F.when(F.col("moves"), F.col("wanted")).otherwise(F.col("shard")).alias("shard"), "moves", "gain"))
        went, wanting = labels.agg(F.count_if(F.col("moves")), F.count_if(F.col("gain") > 0)).first()
        labels = labels.select("node", "shard")
        if wanting == 0 or (number and went == 0):
            break
    return labels


def _in_turn(groups: list[tuple[int, int, int]], room: list[int]) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Pieces (hub, from, to, shard) of groups (hub, rows, shard wanted), and the room left.

    Largest first, whole into the wanted shard, else into the one with least room that suffices. A group that no
    shard has room for fills up the one with most room; its rest queues again."""

    def packed(heed: bool) -> tuple[list[tuple[int, int, int, int]], list[int]]:
        left, pieces = list(room), []
        queue = [(-rows, hub, 0, wanted) for hub, rows, wanted in groups]
        heapq.heapify(queue)
        while queue:
            minus, hub, start, wanted = heapq.heappop(queue)
            rows = -minus
            shard = wanted
            if not heed or left[wanted] < rows:
                fits = [(free, s) for s, free in enumerate(left) if free >= rows]
                shard = min(fits)[1] if fits else max(range(len(left)), key=lambda s: (left[s], -s))
            taken = min(rows, left[shard])
            pieces.append((hub, start, start + taken, shard))
            left[shard] -= taken
            if taken < rows:
                heapq.heappush(queue, (taken - rows, hub, start + taken, wanted))
        return pieces, left

    found = packed(True)
    if len(found[0]) > len(groups):
        # wishes may have cost room that whole groups need
        found = min(found, packed(False), key=lambda x: len(x[0]))
    return found


def _rows_before(groups: DataFrame, order: list[str], within: list[str]) -> DataFrame:
    """`groups` with column before: the rows of all groups before each in the order of `order`, a range sort and
    prefix sums; of the same values of `within` (a prefix of `order`) only."""
    ranged = written(groups.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    prior = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = ranged.groupBy("_part", *within).agg(F.sum("linked").alias("_rows"))
    spans = spans.select("_part", *within, F.coalesce(F.sum("_rows").over(prior), F.lit(0)).alias("_prior"))
    inside = Window.partitionBy("_part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("_own", F.coalesce(F.sum("linked").over(inside), F.lit(0)))
    return own.join(spans, ["_part", *within]).withColumn("before", F.col("_prior") + F.col("_own")).drop("_part", "_own", "_prior")


def _ranges(spark: SparkSession, room: list[int]) -> DataFrame:
    """(shard, free, from, to): the free places of all shards numbered through."""
    rows, at = [], 0
    for shard, free in enumerate(room):
        rows.append((shard, free, at, at + free))
        at += free
    return spark.createDataFrame(rows, "shard int, free long, from long, to long")


def _place_groups(groups: DataFrame, limits: list[int], total: int) -> tuple[DataFrame | None, list[tuple[int, int, int, int]], list[int]]:
    """Shards for groups (hub, linked, wanted): (hub, shard) of small ones as a table, pieces (hub, from, to, shard) of
    the others, and the room left.

    Large groups go in turn. Of the small ones, each shard takes those that want it while it has room; the rest are
    laid end to end over the free places, and the few that would lie across two shards go in turn at the end."""
    spark = groups.sparkSession
    large = F.col("linked") > total // LARGE_GROUPS
    pieces, room = _in_turn([(r["hub"], r["linked"], r["wanted"]) for r in groups.filter(large).collect()], limits)
    small = groups.filter(~large)
    if small.isEmpty():
        return None, pieces, room

    def taken(rows: DataFrame) -> list[int]:
        held = {r["shard"]: r["held"] for r in rows.groupBy("shard").agg(F.sum("linked").alias("held")).collect()}
        return [free - held.get(shard, 0) for shard, free in enumerate(room)]

    wanting = _rows_before(small.withColumn("shard", F.col("wanted")), ["shard", "hub"], ["shard"])
    wanting = wanting.join(F.broadcast(_ranges(spark, room).select("shard", "free")), "shard")
    wanting = written(wanting.withColumn("stays", F.col("before") + F.col("linked") <= F.col("free")))
    stays = wanting.filter("stays").select("hub", "linked", "shard")
    room = taken(stays)
    rest = wanting.filter("NOT stays").select("hub", "linked", "wanted")
    if rest.isEmpty():
        return stays.select("hub", "shard"), pieces, room
    rest = _rows_before(rest, ["hub"], [])
    starts = (F.col("before") >= F.col("from")) & (F.col("before") < F.col("to"))
    rest = rest.join(F.broadcast(_ranges(spark, room)), starts)  # one row for each shard
    rest = written(rest.select("hub", "linked", "wanted", "shard", (F.col("before") + F.col("linked") <= F.col("to")).alias("whole")))
    whole = rest.filter("whole").select("hub", "linked", "shard")
    room = taken(whole)
    across = [(r["hub"], r["linked"], r["wanted"]) for r in rest.filter("NOT whole").collect()]  # at most one for each shard
    last, room = _in_turn(across, room)
    return stays.unionAll(whole).select("hub", "shard"), pieces + last, room


def shard_documents(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, size (UTF-8 bytes plus 1), text_crc32, law ('rows': counts differ by one at most),
    shard, slot (gapless from 0 in each shard), grown_shard (null), linked (rows of the same text, itself included).

    Documents of equal text are linked, each with the first row of its text. A null text links with nothing and has
    a null text_crc32 and the size 1; empty texts are equal texts. Rows are told apart by their place in the written
    table, so repeated or null ids do no harm. A group is split only if no shard has room for all of it when its turn
    comes (large ones by size, then small ones), so one larger than a shard is, over as few shards as have room. An
    empty table gives an empty result; other columns are not read.
    """
    thin = docs.select(
        F.col(id_column).alias("id"),
        (F.coalesce(F.octet_length(text_column), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col(text_column).cast("binary")).alias("crc"),
        F.sha2(F.col(text_column).cast("binary"), 256).alias("digest"),
    )
    thin = written(thin.withColumn("node", F.monotonically_increasing_id()))
    total = thin.count()
    floor, more = divmod(total, shards)
    same = thin.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("linked"))
    same = written(same.filter("linked > 1"))  # as a table, so that Spark can split a large group in the join
    grouped = written(thin.join(same, "digest", "left"))
    links = grouped.filter("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    labels = propagate(links, shards, floor)

    # each group goes as a whole to the shard that most of it is in, as far as there is room
    spark = docs.sparkSession
    votes = grouped.filter("hub IS NOT NULL").select("node", "hub").join(labels, "node").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("votes"))
    wanted = votes.groupBy("hub").agg(F.max(F.struct("votes", (-F.col("shard")).alias("minus"))).alias("most"))
    groups = written(same.select("hub", "linked").join(wanted, "hub").select("hub", "linked", (-F.col("most.minus")).alias("wanted")))
    limits = [floor + (shard < more) for shard in range(shards)]
    small, pieces, room = _place_groups(groups, limits, total)
    parts: dict[int, int] = {}
    for hub, *_ in pieces:
        parts[hub] = parts.get(hub, 0) + 1
    linked = grouped.filter("hub IS NOT NULL")
    columns = ["id", "size", "crc", "linked", "node", "hub", "shard"]
    whole = spark.createDataFrame([(hub, shard) for hub, _, _, shard in pieces if parts[hub] == 1], "hub long, shard int")
    placed = linked.join(F.broadcast(whole), "hub").select(*columns)
    if small is not None:
        placed = placed.unionAll(linked.join(small, "hub").select(*columns))
    if len(parts) < len(pieces):
        cuts = [piece for piece in pieces if parts[piece[0]] > 1]
        cuts = spark.createDataFrame(cuts, "hub long, from long, to long, shard int").withColumnRenamed("hub", "own")
        split = linked.join(F.broadcast(cuts.select(F.col("own").alias("hub")).distinct()), "hub", "left_semi")
        split = with_position(split, ["hub", "node"], "rank", within=["hub"])
        inside = (F.col("hub") == F.col("own")) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to"))
        placed = placed.unionAll(split.join(F.broadcast(cuts), inside).select(*columns))
    placed = with_position(placed, ["shard", "hub", "node"], "place", within=["shard"])

    # rows without links take what is free
    held = spark.createDataFrame([(s, limit - free) for s, (limit, free) in enumerate(zip(limits, room, strict=True))], "shard int, held long")
    free = _ranges(spark, room).join(held, "shard")
    rest = with_position(grouped.filter("hub IS NULL"), ["node"], "place")
    inside = (F.col("place") >= F.col("from")) & (F.col("place") < F.col("to"))
    rest = rest.join(F.broadcast(free), inside)  # one row for each shard
    columns = ["id", "size", "crc", "linked", "shard", "place"]
    done = placed.select(*columns).unionAll(rest.withColumn("place", F.col("place") - F.col("from") + F.col("held")).select(*columns))
    return done.select(
        F.col("id").alias(id_column),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.coalesce("linked", F.lit(1)).alias("linked"),
    )
