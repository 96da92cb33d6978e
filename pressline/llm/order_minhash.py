"""MinHash near-dedup (9): order MinHash over word shingles, verified by banded alignment.

A document is the sequence of its five-word shingles, each labelled with how many equal ones
came before it. A sketch takes, for each of several hash functions, the few labelled shingles
with the smallest hashes and keeps them in text order, so that texts agree on a sketch when
they share shingles in the same order. Documents that agree on a whole sketch meet in a
bucket. Candidates are verified by aligning their labelled shingles inside a band. A bucket of
any size is compared completely, a large one in cells of bounded size.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pressline.llm.columns import as_before, set_aside
from pressline.llm.store import stored
from pressline.llm.textarrays import mix, occurrence, ranges, sequence_hashes, slices, split_words, word_hashes
from pressline.operators.graph import connected_components
from pressline.operators.ranking import top_n

SHINGLE = 5
SIMILARITY = 0.8
TABLES = 24
ELEMENTS = 4
SMALL_BUCKET = 8  # up to this many members all pairs are candidates
LIKELY_PARTNERS = 4  # partners a document tries in the second pass; the third pass tries all that are left
BLOCK_WEIGHT = 1 << 18  # shingles, and MEMBER_WEIGHT for each member, of a block of larger buckets
MEMBER_WEIGHT = 64
_COLUMNS = 2048  # shingles counted in one matrix product
_UNNAMED = 1 << 62  # vertices of rows without an id start here
_ODD = np.random.RandomState(7).randint(1, 2**62, TABLES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.RandomState(8).randint(1, 2**62, ELEMENTS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def labelled_shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled shingles of every row in text order, and the row bounds.

    A text of one to four words is one shingle.
    """
    words = split_words(column)
    count = words.counts
    length = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), length)
    start = ranges(words.bounds[:-1], length)
    plain = sequence_hashes(word_hashes(words), start, start + np.minimum(count, SHINGLE)[row])
    label = occurrence(plain, row).astype(np.uint64)
    return mix(plain + label * np.uint64(0xD6E8FEB86659FD93)), np.concatenate([[0], np.cumsum(length)])


def sketch_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One bucket key per row and hash function; rows without shingles must be ignored."""
    size = np.diff(bounds)
    rows = len(size)
    row = np.repeat(np.arange(rows), size)
    need = np.minimum(size, ELEMENTS)
    # Only hashes below a limit that some sixteen per row pass can be among the smallest.
    limit = np.where(size > 16, np.floor(16.0 * 2.0**64 / np.maximum(size, 17)), 2.0**64 - 2048).astype(np.uint64)[row]
    keys = np.zeros((rows, TABLES), np.uint64)
    for table in range(TABLES):
        hashed = values * _ODD[table]
        chosen = np.flatnonzero(hashed < limit)
        short = np.bincount(row[chosen], minlength=rows) < need
        if short.any():
            chosen = np.union1d(chosen, np.flatnonzero(short[row]))
        chosen = chosen[np.lexsort((hashed[chosen], row[chosen]))]
        first = np.searchsorted(row[chosen], np.arange(rows))
        rank = np.arange(len(chosen)) - first[row[chosen]]
        kept = np.sort(chosen[rank < ELEMENTS])  # back in text order
        first = np.searchsorted(row[kept], np.arange(rows))
        place = np.arange(len(kept)) - first[row[kept]]
        total = np.zeros(len(kept) + 1, np.uint64)
        np.cumsum(mix(values[kept]) * _PLACE[place], out=total[1:])
        keys[:, table] = mix(total[first + need] - total[first] + np.uint64(table + 1))
    return keys


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            values, bounds = labelled_shingles(part.column("text"))
            size = np.diff(bounds)
            keys = sketch_keys(values, bounds)[size > 0].ravel().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum((size > 0) * TABLES)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("vertex"), part.column("copy"), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(ends, keys)],
                names=["vertex", "copy", "n", "keys"],
            )


def aligned(left: np.ndarray, right: np.ndarray, threshold: float) -> float:
    """Similarity of two sequences of distinct labelled shingles; 0 when below ``threshold``.

    Matches outside the band, whose half width is the largest drift a similar pair can have,
    are left out; the longest increasing run of the others is the alignment.
    """
    total = len(left) + len(right)
    least = threshold / (1 + threshold) * total
    order = np.argsort(right)
    ranked = right[order]
    at = np.minimum(np.searchsorted(ranked, left), len(right) - 1)
    i = np.flatnonzero(ranked[at] == left)
    j = order[at[i]]
    inside = np.abs(i - j) <= total - 2 * least + 1
    j = j[inside]
    if len(j) < least - 1e-9:
        return 0.0
    if (np.diff(j) > 0).all():
        matched = len(j)
    else:
        tails: list[int] = []
        for value in j.tolist():
            place = bisect_left(tails, value)
            tails[place : place + 1] = [value]
        matched = len(tails)
    similarity = matched / (total - matched)
    return similarity if similarity >= threshold - 1e-12 else 0.0


def _verify(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a"):
                a, a_bounds = labelled_shingles(part.column("text_a"))
                b, b_bounds = labelled_shingles(part.column("text_b"))
                linked = [
                    a_bounds[k] < a_bounds[k + 1] and b_bounds[k] < b_bounds[k + 1]
                    and aligned(a[a_bounds[k] : a_bounds[k + 1]], b[b_bounds[k] : b_bounds[k + 1]], threshold) > 0
                    for k in range(part.num_rows)
                ]
                found = part.select(["src", "dst"]).filter(pa.array(linked, pa.bool_()))
                if found.num_rows:
                    yield found

    return verify


def _links(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (``src``, ``dst``) that the alignment confirms."""
    left = texts.select(F.col("vertex").alias("src"), F.col("text").alias("text_a"))
    right = texts.select(F.col("vertex").alias("dst"), F.col("text").alias("text_b"))
    both = pairs.join(left, "src").join(right, "dst").select("src", "dst", "text_a", "text_b")
    return both.mapInArrow(_verify(threshold), "src long, dst long")


def _members(reps: DataFrame, key: str = "key") -> DataFrame:
    """Rows of ``reps`` whose ``key`` others share, with the bucket's size and least vertex."""
    size = reps.groupBy(key).agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("least"), F.min("part").alias("_a"), F.max("part").alias("_b"))
    return reps.join(size.filter("size > 1 and _a <> _b").drop("_a", "_b"), key)


def _cross_pairs(members: DataFrame, key: str, similarity: float) -> DataFrame:
    """All pairs of a small bucket whose parts differ and whose sizes can be similar."""
    listed = members.groupBy(key).agg(F.collect_list(F.struct("rep", "n", "part")).alias("m"))
    pairs = F.expr(
        "flatten(transform(m, a -> transform(filter(m, b -> b.rep > a.rep and b.part <> a.part "
        f"and least(a.n, b.n) >= {similarity} * greatest(a.n, b.n)), b -> struct(b.rep as src, a.rep as dst))))"
    )
    return listed.select(F.inline(pairs))


def _main_parts(members: DataFrame) -> DataFrame:
    """The largest part of each bucket, and four members of it drawn by hashes of bucket and member."""
    draws = [F.min(F.struct(F.xxhash64("key", "rep", F.lit(k)), "rep"))["rep"] for k in range(4)]
    sizes = members.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c"), F.array(*draws).alias("drawn"))
    return sizes.groupBy("key").agg(F.max(F.struct("c", "part", "drawn")).alias("main"))


def _beside_main(members: DataFrame) -> DataFrame:
    """Pairs of the members of large buckets outside the bucket's largest part with four members of that part."""
    others = members.join(_main_parts(members), "key").filter("part <> main.part")
    pairs = others.select("rep", F.explode("main.drawn").alias("other"))
    return pairs.select("rep", F.greatest("rep", "other").alias("src"), F.least("rep", "other").alias("dst"))


def _apart(met: DataFrame, links: DataFrame) -> DataFrame:
    """Members of buckets that links do not yet hold together, with the part each belongs to."""
    parts = connected_components(links).select(F.col("id").alias("rep"), "component")
    labelled = met.select("key", "rep", "n").join(parts, "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("part"))
    return stored(_members(labelled))


def _groups(members: DataFrame) -> DataFrame:
    """``rep, part, n, group``: the members of large buckets, with the buckets that overlap in one group.

    Most large buckets hold the same members. In its group a member is compared once, however
    many of the buckets it is in.
    """
    together = connected_components(members.select(F.col("rep").alias("src"), F.col("least").alias("dst")).distinct())
    return members.select("rep", "part", "n").distinct().join(together.select(F.col("id").alias("rep"), F.col("component").alias("group")), "rep")


def _cells(members: DataFrame) -> DataFrame:
    """Members of large buckets once per cell (``group, i, j``) in which they are compared, with their ``block``.

    A group of buckets that fits is one cell. Others are cut by a hash into blocks of the largest
    part and blocks of the rest; a cell is a block of the rest with itself, another one or one of
    the largest part, so that every pair of members of different parts shares a cell.
    """
    weight = F.col("n") + MEMBER_WEIGHT
    sized = members.groupBy("group", "part").agg(F.count(F.lit(1)).alias("c"), F.sum(weight).alias("w"))
    whole = sized.groupBy("group").agg(F.max(F.struct("c", "part", "w")).alias("main"), F.sum("w").alias("w"))
    count = lambda w: F.when(F.col("w") <= BLOCK_WEIGHT, 1).otherwise(F.ceil(w / BLOCK_WEIGHT)).cast("int")
    plan = whole.select(
        "group", F.col("main.part").alias("main"), count(F.col("w") - F.col("main.w")).alias("rest"),
        F.when(F.col("w") <= BLOCK_WEIGHT, 0).otherwise(count(F.col("main.w"))).alias("most"),
    )
    inside = (F.col("part") == F.col("main")) & (F.col("most") > 0)
    place = F.xxhash64("rep", F.lit("block"))
    block = F.when(inside, F.col("rest") + F.pmod(place, F.greatest("most", F.lit(1)))).otherwise(F.pmod(place, F.col("rest")))
    own = members.join(plan, "group").select("group", "rep", "part", "rest", "most", block.cast("int").alias("block"))
    partner = F.sequence(F.lit(0), F.when(F.col("block") < F.col("rest"), F.col("rest") + F.col("most")).otherwise(F.col("rest")) - 1)
    return own.withColumn("with", F.explode(partner)).select(
        "group", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "rep", "part"
    )


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            values, bounds = labelled_shingles(part.column("text"))
            lists = pa.ListArray.from_arrays(bounds.astype(np.int32), values.view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("rep"), lists], names=["rep", "shingles"])


def common_counts(values: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each row of ``left`` has in common with each of ``right``; a row's values are distinct."""
    size = np.diff(bounds)
    row = np.repeat(np.arange(len(size)), size)
    _, token, often = np.unique(values, return_inverse=True, return_counts=True)
    shared = often > 1
    number = np.cumsum(shared) - 1
    kept = np.flatnonzero(shared[token])
    kept = kept[np.argsort(token[kept], kind="stable")]
    token, row = number[token[kept]], row[kept]
    total = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(shared.sum()), _COLUMNS):
        a, b = np.searchsorted(token, [low, low + _COLUMNS])
        has = np.zeros((len(size), _COLUMNS), np.float32)
        has[row[a:b], token[a:b] - low] = 1
        total += has[left] @ has[right].T
    return total


def _compare(threshold: float):
    def compare(cell: pa.Table) -> pa.Table:
        """Links that join the parts of a cell as all its similar pairs would."""
        cell = cell.combine_chunks()
        lists = cell.column("shingles").combine_chunks()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy()[bounds[0] : bounds[-1]].view(np.uint64)
        bounds = bounds - bounds[0]
        size = np.diff(bounds)
        rep, block, label = (cell.column(c).to_numpy() for c in ("rep", "block", "part"))
        left, right = (np.flatnonzero(block == cell.column(c)[0].as_py()) for c in ("i", "j"))
        if not len(left) or not len(right):
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64())})
        least = threshold / (1 + threshold) * (size[left][:, None] + size[right][None, :])
        likely = common_counts(values, bounds, left, right) >= least - 1e-3
        label = np.unique(label, return_inverse=True)[1]
        found = []
        if left[0] == right[0]:
            likely = np.triu(likely, 1)
        for x, row in zip(left, likely):
            for y in right[row]:
                if label[x] != label[y] and aligned(values[bounds[x] : bounds[x + 1]], values[bounds[y] : bounds[y + 1]], threshold) > 0:
                    label[label == label[y]] = label[x]
                    found.append((max(rep[x], rep[y]), min(rep[x], rep[y])))
        ends = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"src": ends[:, 0], "dst": ends[:, 1]})

    return compare


def _large_links(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links that join the members of large buckets as all their similar pairs would."""
    inside = members.select(F.col("rep").alias("vertex")).distinct()
    read = texts.join(inside, "vertex", "left_semi").select(F.col("vertex").alias("rep"), "text").distinct()
    shingles = stored(read.mapInArrow(_shingles, "rep long, shingles array<long>"))
    return _cells(_groups(members)).join(shingles, "rep").groupBy("group", "i", "j").applyInArrow(_compare(threshold), "src long, dst long")


def _vertex() -> Column:
    """The id of a row, or a hash of its text above all ids."""
    unnamed = F.xxhash64("text").bitwiseAND(F.lit(_UNNAMED - 1)) + F.lit(_UNNAMED)
    return F.coalesce(named_below(F.col("doc_id")), unnamed)


def named_below(name: Column, limit: int = _UNNAMED) -> Column:
    """A row's id; one from ``limit`` on is refused, since vertices without an id start there."""
    value = name.cast("long")
    return F.when(value >= limit, F.raise_error(F.lit("ids must be below 2**62"))).otherwise(value)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, component_id, kept`` for every row: the class of near copies it belongs to.

    Two texts are linked when the alignment of their labelled five-word shingles matches
    ``m`` of ``n1`` and ``n2`` with ``m / (n1 + n2 - m) >= similarity``; classes are the
    connected components of links and ``component_id`` is the smallest id in the class. The
    row that carries it is kept. Equal texts, empty ones included, are one class and are
    worked on once. A null text is linked with nothing. Rows with one id are one document. A
    null id is allowed: such a row joins its class without naming it and its ``kept`` says
    that no other row of its class is. Ids from 2**62 on are an error; other columns are not read.

    Finding candidates takes three passes. The first compares every document with the one
    leader it shares most buckets with and joins what is confirmed. The second compares those
    that stand beside the largest part of a large bucket with a few members of that part.
    The third takes all pairs of a bucket whose members are still apart. Buckets of more than
    ``SMALL_BUCKET`` members that overlap are one group, which is cut into blocks of bounded
    size; every pair of blocks, but for those of the group's largest part, is compared in one
    task, which counts the common shingles of all pairs, aligns those that can be similar and
    emits a spanning forest. So every pair that
    shares a sketch is linked or known to be in one class already; work, not rows, grows with
    the square of a group that does not hold together.
    """
    component = F.col("component")
    return _judged(docs, similarity).select(
        "doc_id", F.when(component < _UNNAMED, component).alias("component_id"), (F.col("vertex") == component).alias("kept")
    )


def _judged(docs: DataFrame, similarity: float) -> DataFrame:
    """``doc_id, vertex, component`` for every row, for rows and classes without ids too."""
    named = docs.select(_vertex().alias("vertex"), F.md5("text").alias("copy"), "text", "doc_id")
    present = named.filter(F.col("text").isNotNull())
    sketched = present.select("vertex", "copy", "text").mapInArrow(_sketch, "vertex long, copy string, n int, keys array<long>")
    reps = stored(sketched.groupBy("copy").agg(F.min("vertex").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")))

    rows = reps.select("rep", "n", F.explode("keys").alias("key"))
    met = stored(_members(rows.withColumn("part", F.col("rep"))).select("key", "rep", "n", "size", "least"))
    texts = stored(
        present.select("vertex", "text").join(met.select(F.col("rep").alias("vertex")).distinct().hint("shuffle_hash"), "vertex", "left_semi")
    )

    votes = met.filter("rep <> least").groupBy("rep", "least").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("rep").agg(F.max(F.struct("votes", "least")).alias("best"))
    first = stored(_links(best.select(F.col("rep").alias("src"), F.col("best.least").alias("dst")), texts, similarity))
    near_main = _beside_main(_apart(met, first).filter(F.col("size") > SMALL_BUCKET))
    likely = near_main.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("votes"), F.first("rep").alias("rep"))
    tried = top_n(likely, ["rep"], [F.desc("votes"), F.asc("src"), F.asc("dst")], LIKELY_PARTNERS).select("src", "dst")
    first = stored(first.unionByName(_links(tried.distinct(), texts, similarity)))

    apart = _apart(met, first)
    small = _cross_pairs(apart.filter(F.col("size") <= SMALL_BUCKET), "key", similarity)
    large = _large_links(apart.filter(F.col("size") > SMALL_BUCKET), texts, similarity)
    second = _links(small.distinct(), texts, similarity).unionByName(large)
    labels = connected_components(first.unionByName(second)).select(F.col("id").alias("rep"), "component")

    classes = reps.select("rep", "copy").join(labels, "rep", "left").select("copy", F.coalesce("component", "rep").alias("component_id"))
    joined = named.select("doc_id", "vertex", "copy").join(classes, "copy", "left")
    return joined.select("doc_id", "vertex", F.coalesce("component_id", "vertex").alias("component"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows that :func:`near_duplicates` does not keep.

    Of the rows without an id that have the text of a class without ids, one stays, any of them;
    rows with neither id nor text stay. Repeated rows of a kept id stay as often as they come.
    """
    own = ("doc_id", "text")
    plain = set_aside(docs, *own)
    dropped = stored(_judged(plain, similarity).filter("vertex <> component").select(F.col("vertex").alias("_vertex")).distinct())
    left = plain.withColumn("_vertex", _vertex()).join(dropped.hint("shuffle_hash"), "_vertex", "left_anti")
    unnamed = F.col("doc_id").isNull() & F.col("text").isNotNull()
    return as_before(left.filter(~unnamed).unionByName(left.filter(unnamed).dropDuplicates(["_vertex"])), docs, *own)
