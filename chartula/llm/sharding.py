"""Sharding by a k-d tree: weighted medians along the widest metadata dimension until each leaf has the target bytes.

Equal texts are one group, which has one place. Groups of more than 1 / GREAT of a shard (at most GREAT of them a shard) are
dealt first, the greatest to the shard with the fewest bytes so far; only a group larger than a whole shard is cut, into as
few pieces as fit. The tree then cuts all other groups so that each leaf gets the bytes its shard still lacks.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, whole, written

#: Bins of one pass of a median search; the share of a shard's bytes at which it ends; rows that a slot counter sees in one group.
BINS, CLOSE, BLOCK = 1 << 11, 0.002, 4096
#: Bits of a coordinate that order rows of one metadata value: by hash of the text. Places of the values of a text column.
TIE, VALUES = 38, 1 << 16
GREAT = 50


@dataclass
class Node:
    """A cell of the tree: the shards it becomes, its bytes and its bounds, where it is cut, and its halves."""

    first: int
    last: int
    size: float
    box: list[tuple[int, int]]
    dim: int = 0
    cut: int = 0
    halves: list[Node] = field(default_factory=list)

    def leaf(self, x: list[Column]) -> Column:
        """The first shard of the cell that a row falls in."""
        if not self.halves:
            return F.lit(self.first)
        return F.when(x[self.dim] <= self.cut, self.halves[0].leaf(x)).otherwise(self.halves[1].leaf(x))


def groups(rows: DataFrame) -> DataFrame:
    """(text_hash, group_size, x0, x1, x2): a row a group of equal texts, with its coordinates.

    They are the logarithm of a text's size, and the hashed places of the smallest language and source among its copies;
    below each stands the hash of the text.
    """
    place = lambda c: F.coalesce(F.pmod(F.xxhash64(F.min(c)), F.lit(VALUES)), F.lit(VALUES))
    log_size = F.floor(F.log2(F.min("size").cast("double") + 1) * 1024).cast("long")
    found = rows.groupBy("text_hash").agg(F.sum("size").alias("group_size"), log_size.alias("d0"), *[F.when(F.min(c).isNull(), F.lit(VALUES)).otherwise(place(c)).cast("long").alias(f"d{i}") for i, c in ((1, "lang"), (2, "source"))])
    return found.select("text_hash", "group_size", *[(F.shiftleft(F.col(f"d{i}"), TIE) + F.shiftrightunsigned("text_hash", 64 - TIE)).alias(f"x{i}") for i in range(3)])


def _level(cells: DataFrame, nodes: list[Node], targets: list[float], spans: list[int], close: float) -> None:
    """Cuts all cells of one level by passes over histograms. The driver sees at most BINS sums for each of at most as many
    cells as there are shards."""
    search, by = {}, {n.first: n for n in nodes}
    for n in nodes:
        # Metadata values decide; where a cell holds one value in every dimension, the order of hashes does.
        width = [((high >> TIE) - (low >> TIE)) / span for (low, high), span in zip(n.box, spans)]
        n.dim = max(range(3), key=lambda i: (width[i], -i))
        half = n.first + (n.last - n.first) // 2
        lack = sum(targets[n.first : n.last])
        goal = n.size * (sum(targets[n.first : half]) / lack if lack else 0.5)
        search[n.first] = [*n.box[n.dim], 0, goal]
        n.halves = [Node(n.first, half, 0, [*n.box]), Node(half, n.last, 0, [*n.box])]
    x = [F.col(f"x{i}") for i in range(3)]
    done: dict[int, tuple[int, float]] = {}
    while search:
        dim, low, high = (_by_cell(search, f) for f in (lambda k: by[k].dim + 1, lambda k: search[k][0], lambda k: search[k][1]))
        at = cells.filter(F.col("cell").isin(*search)).select("cell", "group_size", F.element_at(F.array(*x), dim.cast("int")).alias("value"), low.alias("low"), high.alias("high"))
        inside = at.filter("value BETWEEN low AND high").select("cell", "group_size", F.expr(f"(value - low) DIV ((high - low) DIV {BINS} + 1)").alias("bin"))
        counted = inside.groupBy("cell", "bin").agg(F.sum("group_size").alias("size")).toPandas().sort_values(["cell", "bin"])
        for cell, mine in counted.groupby("cell"):
            low, high, below, goal = search[cell]
            upto = below + mine["size"].cumsum().to_numpy()
            if goal <= below:
                continue
            h = min(int((upto < goal).sum()), len(upto) - 1)
            step, size = (high - low) // BINS + 1, int(mine["size"].iloc[h])
            low, below = low + int(mine["bin"].iloc[h]) * step, int(upto[h]) - size
            if step == 1 or size <= close:
                done[cell] = (low + step - 1, below + size) if below + size - goal <= goal - below else (low - 1, below)
                del search[cell]
            else:
                search[cell] = [low, min(high, low + step - 1), below, goal]
        for cell in [c for c, (_, _, base, goal) in search.items() if goal <= base]:
            done[cell] = (search.pop(cell)[0] - 1, 0)
    for n in nodes:
        n.cut, left = done[n.first]
        low, high = n.box[n.dim]
        n.halves[0].size, n.halves[1].size = left, n.size - left
        n.halves[0].box[n.dim], n.halves[1].box[n.dim] = (low, n.cut), (min(n.cut + 1, high), high)


def _by_cell(search: dict, of) -> Column:
    """A value for each cell, as one literal map of at most as many entries as there are shards."""
    return F.element_at(F.create_map(*[F.lit(v) for cell in search for v in (cell, of(cell))]), F.col("cell"))


def grow(units: DataFrame, targets: list[float]) -> Node:
    """The tree over groups: each level is cut in a few aggregations over all of its cells. targets: bytes of each leaf."""
    bounds = units.agg(F.coalesce(F.sum("group_size"), F.lit(0)), *[F.coalesce(f(f"x{i}"), F.lit(0)) for i in range(3) for f in (F.min, F.max)]).first()
    box = [(bounds[1 + 2 * i], bounds[2 + 2 * i]) for i in range(3)]
    spans = [max(1, (high >> TIE) - (low >> TIE)) for low, high in box]
    root = Node(0, len(targets), bounds[0], box)
    level, x = [root], [F.col(f"x{i}") for i in range(3)]
    close = max(1.0, CLOSE * (bounds[0] / len(targets)))
    while cut := [n for n in level if n.last - n.first > 1 and n.size > 0]:
        _level(units.withColumn("cell", root.leaf(x)), cut, targets, spans, close)
        level = [h for n in cut for h in n.halves]
    return root


def deal_great(great: list[tuple[int, int]], total: float, shards: int) -> tuple[list[tuple[int, int, int]], list[float]]:
    """(text_hash, piece, shard) for great groups (text_hash, bytes), and the bytes that each shard still lacks."""
    cut = []
    for h, size in great:
        n = max(1, -(-size * shards // max(1, total)))
        cut += [(size / n, h, piece) for piece in range(n)]
    heap, out, load = [(0.0, s) for s in range(shards)], [], [0.0] * shards
    for size, h, piece in sorted(cut, key=lambda g: (-g[0], g[1:])):
        least, s = heapq.heappop(heap)
        out.append((h, piece, s))
        load[s] = least + size
        heapq.heappush(heap, (load[s], s))
    # What is left fills the shards up to one level, from the emptiest on.
    left, level, by = total - sum(load), 0.0, sorted(load)
    for n in range(1, shards + 1):
        level = (left + sum(by[:n])) / n
        if n < shards and level <= by[n]:
            break
    return out, [max(0.0, level - x) for x in load]


def local(spark: SparkSession, rows: list[tuple[int, ...]], schema: str) -> DataFrame:
    """Few rows of whole numbers, as Arrow: of a list, Spark makes an RDD that Python workers on the executors pass on."""
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]
    return spark.createDataFrame(pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)}), schema)


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of documents (doc_id, text, lang, source); law: near-equal bytes.

    Size is the UTF-8 bytes of the text (null: none) and 16 a row. Cells are cut at weighted medians along the dimension
    (logarithm of the size, language, source) that is widest in them; rows of one value are ordered by the hash of their
    text, so a cut can fall inside a hot source. Copies of a text stay together, whatever their metadata; only where they
    have more bytes than a shard are they cut, by id. Null metadata is a value of its own; no rows give no rows; fewer rows
    than shards leave shards empty.
    Slots: counted in blocks of a shard, offset by the blocks before, so no task sees a whole shard.
    """
    text = whole()
    spark = docs.sparkSession
    rows = written(docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), "lang", "source"))
    units = written(groups(rows))
    total, n = units.agg(F.coalesce(F.sum("group_size"), F.lit(0)), F.count("*")).first()
    great = [(r[0], r[1]) for r in units.filter(F.col("group_size") * shards * GREAT > total).select("text_hash", "group_size").collect()]  # at most shards * GREAT
    placed, targets = deal_great(great, total, shards)
    pieces = {}
    for h, piece, _ in placed:
        pieces[h] = max(pieces.get(h, 0), piece + 1)
    dealt = F.broadcast(local(spark, [(h, piece, pieces[h], s) for h, piece, s in placed], "text_hash long, piece int, pieces int, great_shard int"))
    whole_ = F.broadcast(local(spark, [*pieces.items()], "text_hash long, pieces int"))
    small = units.join(whole_.select("text_hash"), "text_hash", "left_anti")
    tree = grow(small, targets)
    x = [F.col(f"x{i}") for i in range(3)]
    # Rows of great groups know their piece by their id; all others get the shard of their group.
    mine = rows.select("doc_id", "size", "text_crc32", "text_hash").join(whole_, "text_hash", "left").withColumn("piece", F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), "pieces").cast("int")))
    one = mine.filter("pieces IS NOT NULL").join(dealt.drop("pieces"), ["text_hash", "piece"]).select("doc_id", "size", "text_crc32", "text_hash", F.col("great_shard").alias("shard"))
    two = mine.filter("pieces IS NULL").join(small.select("text_hash", tree.leaf(x).alias("shard")), "text_hash").select("doc_id", "size", "text_crc32", "text_hash", "shard")
    blocks = max(8, -(-rows.count() // (shards * BLOCK)))
    block = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(blocks)).cast("int").alias("block")
    placed_rows = written(one.unionByName(two).select("*", block))
    counts = placed_rows.groupBy("shard", "block").count()
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")))
    slotted = placed_rows.withColumn("place", F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_hash")) - 1)
    return slotted.join(offsets, ["shard", "block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("offset")).cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
