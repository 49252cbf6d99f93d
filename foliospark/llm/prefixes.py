"""Trie of conversation prefixes by sparse-table range minima over sorted common-prefix lengths.

A conversation is its sequence of turn digests (16 bytes a turn), so in sorted order every prefix covers one interval.
With ``lcp`` the common-prefix lengths of neighbours, the interval of prefix (i, d) ends, on either side, before the first
lcp below d. A sparse table holds the minima of all stretches of 1, 2, 4 ... lcps; each prefix searches its left
and right end in it alone, all prefixes at a time as arrays. A prefix that finds itself at its left end stands
for its node.

Over many tasks: conversations are range-sorted by (digests, conv_id) into slices, so copies of one conversation may
fill many slices. The same search runs on two levels. Inside a slice it is as above. Between slices, one row of numbers per
slice (common prefix with the slice before, least lcp inside) gives a second, small sparse table, in which a prefix that
enters a slice from the left finds the slice its node starts in. Everything a node needs is a sum or a minimum
over its interval, so a node over many slices is the sum of a part in each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark import scale
from foliospark.llm.common import Stage

WORD = r"[^\x20\x09-\x0D]+"
SLICE_TURNS = 1_000_000  # turns of conversations that one task sorts and searches
CHUNK = 20_000  # conversation ids that stand in one string
DIGEST = 16
EDGE = "slice int, first binary, last binary, least bigint"
SUMS = ("n_convs", "n_children", "n_leaves", "turn_words", "node_words")
EMPTY = hashlib.sha256(b"").hexdigest()
#: ``owner`` is the slice a part's node starts in, ``open`` tells that the node goes on in the next slice. A parent that is
#: in this slice alone is known; of any other, ``parent_left`` tells whether it comes from the slice before or starts here.
PART = (
    "slice int, owner int, depth bigint, open boolean, conv_id bigint, parent_conv_id bigint, parent_left boolean, "
    + "".join(f"{n} bigint, " for n in SUMS)
    + "ends_sha256 string"
)
ENDS = "owner int, depth bigint, slice int, number int, ids string"


def turn_rows(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as (turn, digest, words).

    Rows without conv_id belong to no conversation. A null turn comes first; turns with one number follow each other by their
    digests. A null role or text is empty. Other columns are not read. Texts stay where they are: a turn takes 16 bytes
    and a count from here on, and a conversation is one row.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.md5(F.concat(F.length(role), F.lit(":"), role, text).cast("binary")))
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
        digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("turns"))


def regrouped(conversations: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Conversations whose first h turns are those of the first conversation of their group.

    h is crc32(conv_id as text) mod ``heads``, the group's first conversation conv_id - conv_id % ``group``. A
    conversation with fewer turns lends what it has, an absent one nothing.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    firsts = conversations.where(F.col("conv_id") % group == 0)
    firsts = firsts.select(F.col("conv_id").alias("_first"), F.slice("turns", 1, max(heads - 1, 1)).alias("_lent"))
    own = conversations.withColumns({"_first": F.col("conv_id") - F.col("conv_id") % group, "_h": h})
    lent = F.when(F.col("_lent").isNotNull(), F.slice("_lent", F.lit(1), F.col("_h")))
    kept = F.slice("turns", F.col("_h") + 1, F.size("turns"))
    joined = own.join(firsts, "_first", "left")
    return joined.select("conv_id", F.when(lent.isNull(), kept).otherwise(F.concat(lent, kept)).alias("turns"))


def trie(conversations: DataFrame, *, slice_turns: int = SLICE_TURNS) -> DataFrame:
    """A row for every distinct prefix of (conv_id, turns), as ``turn_rows`` gives them; all but the digest are bigint.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256, as the query's contract has them. A conversation without turns is a member of the root. Copies count
    each; rows that repeat a conv_id are members each. No conversations give no rows.
    """
    spark = conversations.sparkSession
    stage = Stage(spark)
    digests, words = F.transform("turns", lambda t: F.hex(t["digest"])), F.transform("turns", lambda t: t["words"])
    whole = conversations.select("conv_id", F.unhex(F.array_join(digests, "")).alias("key"), words.alias("words"))
    whole = stage.keep(whole, "conversations")
    turns = whole.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    slices = max(-(-turns // slice_turns), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = whole.repartitionByRange(slices, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    sorted_ = scale.checkpointed(ranged.withColumn("slice", F.spark_partition_id()))
    stage.drop(whole)
    outer = _Outer.of(stage.keep(sorted_.mapInArrow(_edges, EDGE), "edges"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            yield _Slice(held, outer).parts()

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            yield from _Slice(held, outer).shared_ends()

    parts = stage.keep(sorted_.mapInArrow(search, PART), "parts")
    ends = sorted_.mapInArrow(members, ENDS)
    ends = ends.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "slice", "number")
    ends = ends.mapInArrow(_hashed, "owner int, depth bigint, ends_sha256 string")

    starts = F.col("slice") == F.col("owner")
    shared = parts.where(F.col("open") | ~starts)
    merged = shared.groupBy("owner", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.bool_or(F.when(starts, F.col("parent_left"))).alias("parent_left"), *[F.sum(n).alias(n) for n in SUMS]
    )
    merged = stage.keep(merged.join(ends, ["owner", "depth"], "left"), "nodes")

    # smallest members of the nodes over several slices, for the nodes below them in every slice they are in
    above = shared.select("slice", "owner", "depth").join(merged.select("owner", "depth", F.col("conv_id").alias("_top")), ["owner", "depth"])
    above = above.select("slice", (F.col("depth") + 1).alias("depth"), (~starts).alias("parent_left"), "_top")
    columns = ["slice", "depth", "conv_id", "parent_left", *SUMS, "ends_sha256"]
    nodes = parts.where(~F.col("open") & starts).select(*columns, "parent_conv_id")
    nodes = nodes.unionByName(merged.withColumnRenamed("owner", "slice").select(*columns), allowMissingColumns=True)
    return nodes.join(above, ["slice", "depth", "parent_left"], "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "_top").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("turn_words") - F.col("node_words")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def _minima(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: entry i of level k is the least of values[i : i + 2^k]."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def _left(table: list[np.ndarray], at: np.ndarray, d: np.ndarray) -> np.ndarray:
    """For each place, the leftmost one that is reached over values of at least d; values[i] lies between i - 1 and i."""
    at = at.copy()
    for k in range(len(table) - 1, -1, -1):
        from_ = at - (1 << k) + 1
        go = (from_ >= 0) & (table[k][np.clip(from_, 0, len(table[k]) - 1)] >= d)
        at[go] -= 1 << k
    return at


def _right(table: list[np.ndarray], at: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The same to the right."""
    at = at.copy()
    for k in range(len(table) - 1, -1, -1):
        from_ = at + 1
        go = (from_ < len(table[k])) & (table[k][np.clip(from_, 0, len(table[k]) - 1)] >= d)
        at[go] += 1 << k
    return at


def _common(keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Common-prefix length of each key with the one before it; -1 for the first."""
    lcp = np.zeros(len(lengths), np.int64)
    lcp[:1] = -1
    live, depth = np.arange(1, len(lengths)), 0
    while len(live):
        live = live[(lengths[live] > depth) & (lengths[live - 1] > depth)]
        live = live[(keys[starts[live] + depth] == keys[starts[live - 1] + depth]).all(axis=1)]
        lcp[live] += 1
        depth += 1
    return lcp


def _digests(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All digests as pairs of 64-bit numbers, and how many each row has."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    keys = np.frombuffer(data, np.uint64, (offsets[-1] - offsets[0]) // 8, offsets[0]) if data else np.zeros(0, np.uint64)
    return keys.reshape(-1, 2), np.diff(offsets) // DIGEST


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last key of a slice and the least common-prefix length inside."""
    number = first = last = None
    least = (1 << 62)
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("key")
        keys, lengths = _digests(column)
        starts = np.cumsum(lengths) - lengths
        least = min(least, int(_common(keys, starts, lengths)[1:].min(initial=least)))
        if last is None:
            number, first = batch.column("slice")[0].as_py(), column[0].as_py()
        else:
            least = min(least, _shared(last, column[0].as_py()))
        last = column[-1].as_py()
    rows = [] if last is None else [(number, first, last, least)]
    types = [pa.int32(), pa.binary(), pa.binary(), pa.int64()]
    columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, types)]
    yield pa.RecordBatch.from_arrays(columns, ["slice", "first", "last", "least"])


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common at their starts."""
    n = min(len(a), len(b)) // DIGEST
    same = (np.frombuffer(a, np.uint64, 2 * n).reshape(-1, 2) == np.frombuffer(b, np.uint64, 2 * n).reshape(-1, 2)).all(axis=1)
    return n if same.all() else int(same.argmin())


class _Outer:
    """The level between slices: those that have rows, in order, and how far each goes on from the one before.

    ``border`` is the common-prefix length of a slice's first key with the slice before (-1 for the first), ``steps`` that
    or the least one inside, whichever is less: a prefix as long passes through the whole slice.
    """

    def __init__(self, present: np.ndarray, border: np.ndarray, least: np.ndarray):
        self.present, self.border, self.steps = present, border, np.minimum(border, least)

    @classmethod
    def of(cls, edges: DataFrame) -> "_Outer":
        found = edges.select("slice", "least").orderBy("slice").toArrow()
        present, least = found.column("slice").to_numpy(), found.column("least").to_numpy()
        border = np.full(len(present), -1, np.int64)
        if len(present) > 1:
            pairs = list(zip(present[1:].tolist(), present[:-1].tolist()))
            before = edges.sparkSession.createDataFrame(pairs, "slice int, before int")
            lasts = edges.select(F.col("slice").alias("before"), "last")
            joined = edges.select("slice", "first").join(before, "slice").join(lasts, "before").select("slice", "last", "first")
            found = joined.mapInArrow(_compared, "slice int, common bigint").orderBy("slice").toArrow()
            border[1:] = found.column("common").to_numpy()
        return cls(present, border, least)

    def place(self, number: int) -> tuple[int, int]:
        """Common-prefix lengths of a slice with the one before and the one after."""
        at = int(np.searchsorted(self.present, number))
        return int(self.border[at]), int(self.border[at + 1]) if at + 1 < len(self.border) else -1

    def owners(self, number: int, depths: np.ndarray) -> np.ndarray:
        """The slices in which the prefixes that come into this slice from the left start."""
        at = int(np.searchsorted(self.present, number))
        return self.present[_left(_minima(self.steps), np.full(len(depths), at - 1), depths)]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_shared(a, b) for a, b in zip(batch.column("last").to_pylist(), batch.column("first").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("slice"), pa.array(found, pa.int64())], ["slice", "common"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash over the id strings of each (owner, depth), which come in order; a string at a time is held."""
    key, digest = None, hashlib.sha256()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32(), pa.int64(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 3, types)]
        return pa.RecordBatch.from_arrays(columns, ["owner", "depth", "ends_sha256"])

    for batch in batches:
        done = []
        for owner, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "ids"))):
            if (owner, depth) == key:
                digest.update(b",")
            else:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (owner, depth), hashlib.sha256()
            digest.update(ids.encode())
        yield batch_of(done)
    yield batch_of([] if key is None else [(*key, digest.hexdigest())])


class _Slice:
    """The conversations of one slice in order, equal ones as one key with its members."""

    def __init__(self, batches: list[pa.RecordBatch], outer: _Outer):
        rows = pa.Table.from_batches(batches).combine_chunks()
        self.number, self.outer = rows.column("slice")[0].as_py(), outer
        self.before, self.after = outer.place(self.number)
        keys, lengths = _digests(rows.column("key").chunk(0))
        starts = np.cumsum(lengths) - lengths
        lcp = _common(keys, starts, lengths)
        copy = np.zeros(len(lengths), bool)
        copy[1:] = (lcp[1:] == lengths[1:]) & (lengths[1:] == lengths[:-1])
        self.first = np.flatnonzero(~copy)  # of a key's members
        self.counts = np.diff(np.append(self.first, len(copy)))
        self.members = rows.column("conv_id").to_numpy()
        self.lengths, self.lcp, self.starts = lengths[self.first], lcp[self.first], starts[self.first]
        self.words = _upto(rows.column("words").chunk(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        self.table = _minima(self.lcp)

    def _ids(self, key: int) -> Iterator[str]:
        """The members of a key, as strings of a bounded number of ids."""
        first, count = int(self.first[key]), int(self.counts[key])
        for at in range(0, count, CHUNK):
            yield ",".join(map(str, self.members[first + at : first + min(at + CHUNK, count)].tolist()))

    def _hash(self, key: int) -> str:
        digest = hashlib.sha256()
        for number, ids in enumerate(self._ids(key)):
            digest.update(("," * (number > 0) + ids).encode())
        return digest.hexdigest()

    def shared_ends(self) -> Iterator[pa.RecordBatch]:
        """The members that end at nodes over several slices."""
        i = np.arange(len(self.lengths))
        goes_on = (_right(self.table, i, self.lengths) == i[-1]) & (self.lengths <= self.after)
        goes_on[0] |= self.lengths[0] <= self.before
        for key in np.flatnonzero(goes_on).tolist():
            depth, owner = self.lengths[key : key + 1], self.number
            if key == 0 and depth[0] <= self.before:
                owner = int(self.outer.owners(self.number, depth)[0])
            for number, ids in enumerate(self._ids(key)):
                values = [(owner, pa.int32()), (int(depth[0]), pa.int64()), (self.number, pa.int32()), (number, pa.int32()), (ids, pa.string())]
                columns = [pa.array([v], t) for v, t in values]
                yield pa.RecordBatch.from_arrays(columns, ["owner", "depth", "slice", "number", "ids"])

    def parts(self) -> pa.RecordBatch:
        """A row for every prefix in this slice: its node, or this slice's part of it."""
        i, d = self._prefixes(np.arange(len(self.lengths)))
        left, right = _left(self.table, i, d), _right(self.table, i, d)
        stands = left == i  # the first key of an interval stands for the node; rows stay in preorder
        i, d, right = i[stands], d[stands], right[stands]
        starts_here = (i > 0) | (d > self.before)
        goes_on = (right == len(self.lengths) - 1) & (d <= self.after)
        first_row = np.searchsorted(i, np.arange(len(self.lengths) + 1))

        above = _left(self.table, i, np.maximum(d - 1, 0))
        parent = np.where(d > 0, first_row[above] + d - 2 - self.lcp[above], -1)
        known = (d > 0) & starts_here & starts_here[parent] & ~goes_on[parent]
        conv_id = self._least(i, right)

        def over_keys(values: np.ndarray) -> np.ndarray:
            sums = _upto(values)
            return sums[right + 1] - sums[i]

        n_convs = over_keys(self.counts)
        all_words = self.words[self.starts + self.lengths] - self.words[self.starts]
        earlier = self.words[self.starts[i] + np.maximum(d - 1, 0)] - self.words[self.starts[i]]
        last = self.words[self.starts[i] + d] - self.words[self.starts[i]] - earlier
        of_nodes = _upto(np.where(starts_here, last, 0))
        leaf = np.append(self.lcp[1:], self.after) < self.lengths

        owner = np.full(len(i), self.number)
        if not starts_here.all():
            owner[~starts_here] = self.outer.owners(self.number, d[~starts_here])
        own_hash = [
            (self._hash(key) if ends else EMPTY) if alone else None
            for key, ends, alone in zip(i.tolist(), (self.lengths[i] == d).tolist(), (starts_here & ~goes_on).tolist())
        ]
        columns = {
            "slice": pa.array(np.full(len(i), self.number), pa.int32()),
            "owner": pa.array(owner, pa.int32()),
            "depth": pa.array(d, pa.int64()),
            "open": pa.array(goes_on),
            "conv_id": pa.array(conv_id, pa.int64()),
            "parent_conv_id": pa.array(conv_id[parent], pa.int64(), mask=~known),
            "parent_left": pa.array(~starts_here[parent], mask=known | (d == 0)),
            "n_convs": pa.array(n_convs, pa.int64()),
            "n_children": pa.array(np.bincount(parent[(d > 0) & starts_here], minlength=len(i)), pa.int64()),
            "n_leaves": pa.array(over_keys(leaf.astype(np.int64)), pa.int64()),
            "turn_words": pa.array(over_keys(self.counts * all_words) - n_convs * earlier, pa.int64()),
            "node_words": pa.array(of_nodes[first_row[right + 1]] - of_nodes[:-1], pa.int64()),
            "ends_sha256": pa.array(own_hash, pa.string()),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def _prefixes(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, depth) of every prefix, the empty one included."""
        many = self.lengths + 1
        return np.repeat(keys, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)

    def _least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Smallest member of the keys from ``first`` to ``last``: two overlapping stretches of the sparse table."""
        table, span = _minima(self.members[self.first]), last - first + 1
        out = np.empty(len(first), np.int64)
        for k, least in enumerate(table):
            mine = (span >> k) == 1
            out[mine] = np.minimum(least[first[mine]], least[last[mine] - (1 << k) + 1])
        return out


def _upto(values: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2 ... values."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
