"""Sharding (5): minimax contiguous partition of atomic groups.

Equal texts are a group that stays together. Groups are ordered by a hash of their text and
cut into consecutive shards of nearly equal bytes: the capacity is the smallest for which
filling shards greedily, a group larger than the capacity alone in its shard, needs no more
shards than there are. The search runs on sums over hash ranges. Ranges that a cut may fall
into are split further until every cut is known exactly, so the driver sees a bounded number
of sums and never the groups.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressline.llm.store import stored

SHARDS = 24
ROW_BYTES = 8  # counted for every row besides its text
FIRST_BITS = 12
STEP_BITS = 4
KEY_BITS = 60
PARTS = 512  # parts per shard in which slots are counted


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, group, key`` of every row; texts are read once."""
    digest = F.md5("text")
    return docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
        F.coalesce(digest, F.lit("")).alias("group"),
        F.coalesce(F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long"), F.lit(0)).alias("key"),
    )


def _sums(groups: DataFrame, shift: int) -> dict[int, list]:
    """Sums over hash ranges of ``2**shift`` keys by the key they start with.

    Groups with one and the same key stay together.
    """
    cell = F.shiftright("key", shift).alias("cell")
    summed = groups.groupBy(cell).agg(
        F.sum("size").alias("size"), (F.count(F.lit(1)) if shift else F.lit(1)).alias("n"), F.max("size").alias("most"), F.max("group").alias("last")
    )
    return {(row["cell"] << shift): [row["size"], row["n"], row["most"], row["last"], shift] for row in summed.collect()}


class _Cells:
    """Consecutive hash ranges with the bytes before each."""

    def __init__(self, cells: dict[int, list]):
        self.start = sorted(cells)
        self.cells = [cells[k] for k in self.start]
        self.ends = []
        total = 0
        for size, *_ in self.cells:
            total += size
            self.ends.append(total)
        self.total = total

    def _at(self, place: int) -> int:
        """The range that holds the byte after ``place``."""
        return min(bisect_right(self.ends, place), len(self.ends) - 1)

    def _before(self, at: int) -> int:
        return self.ends[at - 1] if at else 0

    def sure(self, place: int, capacity: int) -> int:
        """A place that a shard from ``place`` on reaches for certain."""
        if place >= self.total:
            return self.total
        at = bisect_right(self.ends, place + capacity)
        reached = self._before(at)
        if reached > place:
            return reached
        at = self._at(place)
        return self.ends[at] if self.cells[at][1] == 1 and self._before(at) == place else place

    def hoped(self, place: int, capacity: int) -> int:
        """A place that a shard from ``place`` on does not reach beyond."""
        if place >= self.total:
            return self.total
        own = self._at(place)
        reach = max(place + capacity, min(place + self.cells[own][2], self.ends[own]))
        if reach >= self.total:
            return self.total
        at = self._at(reach)
        return max(self._before(at), place) if self.cells[at][1] == 1 else reach

    def path(self, step, capacity: int, shards: int) -> list[int]:
        places = [0]
        for _ in range(shards):
            places.append(step(places[-1], capacity))
        return places

    def least(self, step, shards: int) -> int:
        low, high = 0, self.total
        while low < high:
            middle = (low + high) // 2
            if self.path(step, middle, shards)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low


def cut_groups(groups: DataFrame, shards: int = SHARDS) -> list[str]:
    """The last group of every shard but the last, from ``group, key, size``."""
    cells = _sums(groups, KEY_BITS - FIRST_BITS)
    if not cells:
        return []
    while True:
        known = _Cells(cells)
        low, high = known.least(known.hoped, shards), known.least(known.sure, shards)
        sure, hoped = known.path(known.sure, low, shards), known.path(known.hoped, high, shards)
        open_ranges: dict[int, list[int]] = {}
        for a, b in zip(sure[:-1], hoped[:-1]):
            for begin, end in ((a, b), (a + low, b + high)):
                for at in range(known._at(begin), known._at(end) + 1):
                    if known.cells[at][1] > 1:
                        open_ranges.setdefault(known.cells[at][4], []).append(known.start[at])
        if not open_ranges:
            break
        for shift, starts in open_ranges.items():
            starts = sorted(set(starts))
            inside = groups.filter(F.shiftright("key", shift).isin([k >> shift for k in starts]))
            for k in starts:
                del cells[k]
            cells.update(_sums(inside, max(0, shift - STEP_BITS)))
    last = dict(zip(known.ends, (cell[3] for cell in known.cells)))
    return [last[place] for place in known.path(known.sure, high, shards)[1:-1] if place < known.total]


def _slots(placed: DataFrame) -> DataFrame:
    """Number the rows of a shard from 0: rows are counted in parts and numbered inside them."""
    parted = placed.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    counts = parted.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("shard", "_part", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("doc_id", "group")) - 1
    # At most shards x PARTS rows.
    return parted.withColumn("_at", inside).join(F.broadcast(before), ["shard", "_part"]).withColumn("slot", F.col("_before") + F.col("_at"))


def _shard(cuts: list[str]) -> Column:
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < F.col("group")))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    ``size`` is the bytes of the text and eight; ``law`` is ``bytes``: the shards' bytes are as
    equal as whole groups of equal texts in hash order allow. ``slot`` numbers the rows of a
    shard from 0. A null text is a group of its own, apart from the empty text, with no
    checksum. Repeated rows keep their group and get slots of their own. With fewer groups than
    shards the last shards stay empty. Other columns are not read.
    """
    rows = stored(digests(docs))
    groups = stored(rows.groupBy("group", "key").agg(F.sum("size").alias("size")))
    placed = rows.withColumn("shard", _shard(cut_groups(groups, shards)))
    return _slots(placed).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
