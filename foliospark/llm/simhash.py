"""SimHash near-duplicates: fingerprints, blocks that close pairs share, Hamming check.

A fingerprint of 64 bits is cut into blocks. Two fingerprints that differ in at
most d bits agree in all but d blocks, so every choice of ``blocks - d`` blocks
is a join key and no close pair is missed (``close_groups``). Word overlap of 0.8
moves about 15 % of the bits, too many for that; in ``similar_groups`` texts meet
in a fifth of their shingles, the first in one order of all shingles, and a pair with that
overlap has one of these in common. Wider fingerprints of those that meet are
compared, and the overlap of the two shingle sets decides. Which order it is changes
no result: shingles found often in a part of the texts come last, so few
texts meet. Of texts of few shingles, whose bits say little, the sets alone are compared.

Groups of copies are never expanded into pairs. Equal fingerprints are one node.
In each bucket (rows with one key) every node is first checked against the
node that stands for most rows; what that links is merged. Only buckets that still hold
nodes of different groups are compared further, leaving out pairs inside the
bucket's largest group, and a pair leaves the join only if it is a link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import Stage, raw, words
from foliospark.llm.graph import components
from foliospark.llm.templates import MAP_BITS, key_map

SEED = 42
KEY = "__llm_key"
LANES = 52  # of 64 bits, for word overlap
PART = 16  # shingles are counted in one of so many texts, to put frequent ones last
OFTEN = (2, 8, 64, 512)  # texts of that part with a shingle, from which it stands one level later
RATE = 0.185  # share of differing bits beyond which a pair isn't looked at; at an overlap of 0.8, 0.151 to 0.161 is expected (by parity), with a deviation of 0.006
MINI = 24  # differing bits of the first lane, likewise
FEW = 32  # a text of so many shingles or fewer is compared by its shingles, as is its partner, which has at most 5 / 4 as many
MANY = FEW * 5 // 4


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words as big-endian bytes, one row each; the whole text if shorter."""
    found = words(text)
    if not found:
        return np.empty((0, 8), np.uint8)
    joined = b" ".join(found)
    digest = xxhash.xxh64_digest
    if len(found) <= size:
        hashes = digest(joined, SEED)
    else:
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        spans = zip(starts[: len(found) - size + 1].tolist(), ends[size - 1 :].tolist())
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in spans])
    return np.frombuffer(hashes, np.uint8).reshape(-1, 8)


def _mixed(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """Further hashes from each hash, so that one pass over the words serves all lanes."""
    if lanes == 1:
        return hashes
    base = hashes.view(">u8").astype(np.uint64)
    salt = np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = base ^ salt[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.uint8)


def fingerprint(text: bytes, size: int, lanes: int = 1, distinct: bool = False) -> bytes:
    """A bit is 1 if it is set in more than half the shingle hashes; no words give zero. ``distinct`` counts
    a repeated shingle once, as overlap of shingle sets does."""
    if distinct:
        return majority(distinct_hashes(text, size), lanes)
    return majority(shingle_hashes(text, size).view(">u8").ravel(), lanes)


def majority(hashes: np.ndarray, lanes: int) -> bytes:
    """For each bit of the hashes, and of ``lanes`` hashes made of each, whether it is set in more than half of them."""
    hashes = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    total = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(hashes), 255):
        bits = np.unpackbits(_mixed(hashes[at : at + 255], lanes), axis=1)
        total += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(hashes)).tobytes()


def fingerprints(
    docs: DataFrame, keep: list[str], text: str, size: int, lanes: int = 1, distinct: bool = False
) -> DataFrame:
    """The kept columns and ``bits``, an array of one long for each lane. Null text: as if empty."""
    source = docs.select(*keep, F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = b"".join([fingerprint(t, size, lanes, distinct) for t in raw(batch.column("_text"))])
            longs = pa.array(np.frombuffer(found, ">i8").astype(np.int64))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * lanes)
            columns = [batch.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, longs)], [*keep, "bits"])

    schema = docs.select(*keep).schema.add("bits", T.ArrayType(T.LongType()))
    return source.mapInArrow(run, schema)


def word_prints(docs: DataFrame, keep: list[str], text: str, size: int, lanes: int, common: list[np.ndarray]) -> DataFrame:
    """The kept columns, ``n`` (distinct shingles), ``bits`` and ``keys`` (none up to ``FEW`` shingles) and ``few`` (the
    sorted distinct shingles, none beyond ``MANY``). ``keys`` are the first n - 4 / 5 n + 1 shingles by level and hash; the
    level is how many of the bit maps ``common`` hold a shingle."""
    source = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast([m.tobytes() for m in common])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [np.frombuffer(m, np.uint64) for m in shared.value]
        for batch in batches:
            n, bits, few, keys = [], [], [], []
            for data in raw(batch.column("_text")):
                found = distinct_hashes(data, size)
                n.append(len(found))
                few.append(found.astype(np.int64) if len(found) <= MANY else found[:0].astype(np.int64))
                longs = majority(found, lanes) if len(found) > FEW else b""
                bits.append(np.frombuffer(longs, ">i8").astype(np.int64))
                level = np.add.reduce([in_map(m, found) for m in maps], dtype=np.int8)
                places = len(found) - (4 * len(found) + 4) // 5 + 1 if len(found) > FEW else 0
                keys.append(found[np.argsort(level, kind="stable")[:places]].astype(np.int64))
            columns = [batch.column(k) for k in keep] + [pa.array(n, pa.int32()), _lists(bits), _lists(few), _lists(keys)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n", "bits", "few", "keys"])

    schema = docs.select(*keep).schema.add("n", T.IntegerType())
    for name in ("bits", "few", "keys"):
        schema = schema.add(name, T.ArrayType(T.LongType()))
    return source.mapInArrow(run, schema)


def in_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set in a map that ``key_map`` made."""
    low = hashes & np.uint64((1 << MAP_BITS) - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)) > 0


def frequent_shingles(texts: DataFrame, size: int) -> list[np.ndarray]:
    """A bit map for each entry of ``OFTEN``, of shingles that so many texts have among those whose ``mark`` is divisible by ``PART``."""
    stage = Stage(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in raw(batch.column("text")):
                found = distinct_hashes(data, size).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found)], ["key"])

    part = texts.where(F.pmod("mark", F.lit(PART)) == 0).select("text").mapInArrow(run, "key long")
    counted = stage.keep(part.groupBy("key").count().where(F.col("count") >= OFTEN[0]), "frequent")
    maps = [key_map(counted.where(F.col("count") >= least).select("key")) for least in OFTEN]
    stage.drop(counted)
    return maps


def distinct_hashes(text: bytes, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size).view(">u8").ravel().astype(np.uint64))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *rows])))


def shingle_sets(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node and ``set`` (distinct shingles), once for each ``mark`` of ``texts`` that is a wanted node, and for few others."""
    shared = texts.sparkSession.sparkContext.broadcast(key_map(wanted.select(F.col("node").alias("key"))).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint64)
        for batch in batches:
            marks, at = np.unique(batch.column("mark").to_numpy(), return_index=True)
            hit = in_map(bits, marks.view(np.uint64))
            found = raw(batch.column("text").take(pa.array(at[hit], pa.int64())))
            sets = _lists([distinct_hashes(t, size).astype(np.int64) for t in found])
            yield pa.RecordBatch.from_arrays([pa.array(marks[hit], pa.int64()), sets], ["node", "set"])

    return texts.select("mark", "text").mapInArrow(run, "node long, set array<long>").groupBy("node").agg(F.first("set").alias("set"))


def overlapping(a: Column, b: Column) -> Column:
    """Whether two sets share 4 / 5 of their union."""
    return F.size(F.array_intersect(a, b)) * 9 >= (F.size(a) + F.size(b)) * 4


def enough_left(a: Column, b: Column) -> Column:
    """Whether two texts can share 4 / 5 of their union when the key is the first shingle that they share: each has
    ``n`` shingles, ``place`` of them before it."""
    return F.least(a["n"] - a["place"], b["n"] - b["place"]) * 9 >= (a["n"] + b["n"]) * 4


def rare_keys(nodes: DataFrame) -> DataFrame:
    """node, copies, bits, keys: of the n shingles in ``bits``, the n - 4 / 5 n + 1 rarest, without those no other
    text has. Two texts with an overlap of 0.8 have one of these in common."""
    stage = Stage(nodes.sparkSession)
    each = nodes.select("node", F.size("bits").alias("n"), F.explode("bits").alias("shingle"))
    common = stage.keep(each.groupBy("shingle").count().where("count > 1"), "common")
    held = each.join(common, "shingle").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("count", "shingle"))).alias("held"))
    places = F.expr("greatest(0, n - (4 * n + 4) div 5 + 1 - (n - size(held)))").cast("int")
    keys = held.select("node", F.transform(F.slice("held", F.lit(1), places), lambda x: x["shingle"]).alias("keys"))
    return nodes.join(keys.where(F.size("keys") > 0), "node")


def block_keys(bits: Column, blocks: int, distance: int) -> Column:
    """For each choice of ``blocks - distance`` blocks of one lane, a hash of their bits."""
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for number, kept in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in kept)
        mask -= (mask >> 63) << 64
        keys.append(F.xxhash64(F.lit(number), bits.getItem(0).bitwiseAND(F.lit(mask).cast("bigint"))))
    return F.array(*keys)


def differing(a: Column, b: Column, lanes: int) -> Column:
    """How many bits differ. Lanes are added by a function of arrays, as one sum of many is too long a method for Java to compile."""
    if lanes == 1:
        return F.bit_count(a.getItem(0).bitwiseXOR(b.getItem(0)))
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n)


def linked(
    nodes: DataFrame, keys: Column | DataFrame, lanes: int, limit: int, mini: int | None = None,
    test: Callable[[Column, Column], Column] | None = None, exact: Callable[[DataFrame], DataFrame] | None = None,
    meets: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """(node, root) for nodes with a link; ``nodes`` is a written table of node, copies, bits. ``keys`` is an array of it,
    or rows of node, key and at, in which a row may be repeated; ``meets`` tells by the ``at`` of both whether a pair is
    looked at under a key. It must hold under one of the keys that a link shares, and where it holds, for one of the two with itself.

    A link is a pair that shares a key and differs in at most ``limit`` bits, or passes ``test`` of both
    ``bits``, and that ``exact``, which takes and returns rows with a and b, leaves in. With ``mini``, the
    first lane alone is compared before the other lanes are fetched.
    """
    test = test or (lambda a, b: differing(a, b, lanes) <= limit)
    meets = meets or (lambda a, b: F.lit(True))
    stage = Stage(nodes.sparkSession)
    first = F.col("bits").getItem(0).alias("lane")
    # Most rows are alone under their key and go at once, by the narrowest rows there are.
    if isinstance(keys, DataFrame):
        # Many keys for each node: they move once, with the node alone.
        each = Window.partitionBy("key")
        facts = {"_least": F.min("node").over(each), "_most": F.max("node").over(each), "_some": F.max(meets(F.col("at"), F.col("at"))).over(each)}
        met = keys.select("key", "node", "at").withColumns(facts).where("_least <> _most and _some").select("key", "node", "at").distinct()
        shared, several = stage.keep(met.join(nodes.select("node", "copies", first), "node"), "shared"), None
    else:
        keyed = nodes.select("node", "copies", first, F.explode(keys).alias("key"), F.lit(None).cast("int").alias("at"))
        several = stage.keep(keyed.groupBy("key").count().where("count > 1").select("key"), "several")
        shared = stage.keep(keyed.join(several.hint("merge"), "key"), "shared")
    buckets = shared.groupBy("key").agg(F.max(F.struct("copies", "node", "lane", "at")).alias("rep"), F.count("*").alias("members"))
    buckets = stage.keep(buckets, "buckets")

    near = meets(shared["at"], F.col("rep.at")) & (F.bit_count(F.col("lane").bitwiseXOR(F.col("rep.lane"))) <= (limit if mini is None else mini))
    star = shared.join(buckets, (shared.key == buckets.key) & (F.col("node") != F.col("rep.node")) & near)
    star = star.select(F.col("node").alias("a"), F.col("rep.node").alias("b"), F.col("rep.copies").alias("copies")).distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        if lanes > 1:
            left = nodes.select(F.col("node").alias("a"), F.col("bits").alias("a_bits"))
            right = nodes.select(F.col("node").alias("b"), F.col("bits").alias("b_bits"))
            pairs = pairs.join(left, "a").join(right, "b")
            pairs = pairs.where(test(F.col("a_bits"), F.col("b_bits"))).select("a", "b")
        return pairs if exact is None else exact(pairs)

    if lanes == 1:
        merged = stage.keep(components(verified(star.select("a", "b")), "a", "b"), "merged")
    else:
        # A node of a large group has a representative in every bucket. It is checked against the one that stands for
        # most rows first; other pairs are fetched only if their nodes are still in different groups.
        star = stage.keep(star, "star")
        best = stage.keep(star.groupBy("a").agg(F.max(F.struct("copies", "b"))["b"].alias("b")), "best")
        first = stage.keep(components(verified(best), "a", "b"), "first")
        rest = star.select("a", "b").join(best, ["a", "b"], "left_anti")
        rest = rest.join(first.select(F.col("node").alias("a"), F.col("root").alias("a_grp")), "a", "left")
        rest = rest.join(first.select(F.col("node").alias("b"), F.col("root").alias("b_grp")), "b", "left")
        rest = stage.keep(rest.where(F.coalesce("a_grp", "a") != F.coalesce("b_grp", "b")).select("a", "b"), "rest")
        links = first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified(rest))
        merged = stage.keep(components(links, "a", "b"), "merged")
        stage.drop(star, best, first, rest)

    # Buckets of two are settled by now. Larger ones matter only if they hold several groups.
    crowded = shared.select("key", "node", "at").join(buckets.where("members > 2").select("key"), "key")
    grouped = stage.keep(crowded.join(merged, "node", "left").select("key", "node", "at", F.coalesce("root", "node").alias("grp")), "grouped")
    sizes = grouped.groupBy("key", "grp").count()
    mixed = sizes.groupBy("key").agg(F.max(F.struct("count", "grp"))["grp"].alias("main"), F.count("*").alias("n"))
    mixed = stage.keep(mixed.where("n > 1").drop("n"), "mixed")
    rows = stage.keep(grouped.join(mixed, "key").join(nodes.select("node", "bits"), "node"), "rows")
    s, r = rows.alias("s"), rows.alias("r")
    other = (F.col("s.grp") != F.col("r.grp")) & ((F.col("r.grp") == F.col("r.main")) | (F.col("s.node") < F.col("r.node")))
    close = meets(F.col("s.at"), F.col("r.at")) & test(F.col("s.bits"), F.col("r.bits"))
    late = s.where("grp <> main").join(r, (F.col("s.key") == F.col("r.key")) & other & close)
    if exact is not None:
        pair = [F.col("s.node").alias("a"), F.col("r.node").alias("b"), F.col("s.grp").alias("a_grp"), F.col("r.grp").alias("b_grp")]
        late = exact(late.select(*pair).distinct()).select("a_grp", "b_grp")
    else:
        late = late.select(F.col("s.grp").alias("a_grp"), F.col("r.grp").alias("b_grp"))
    late = components(late.distinct(), "a_grp", "b_grp")
    late = late.select(F.col("node").alias("root"), F.col("root").alias("last"))
    every = merged.unionByName(late.select(F.col("root").alias("node"), "root")).distinct()
    out = stage.keep(every.join(late, "root", "left").select("node", F.coalesce("last", "root").alias("root")), "groups")
    stage.drop(*([several] if several is not None else []), shared, buckets, merged, grouped, mixed, rows)
    return out.distinct()


def close_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, size: int = 4, distance: int = 4, blocks: int = 6
) -> DataFrame:
    """doc_id, bits and component_id (smallest doc_id reachable over links of at most ``distance`` bits).

    Finds every link. Null or blank text has fingerprint zero and is linked like any other. Rows
    with the same doc_id are separate rows of the result. A null doc_id keeps its row; it is
    component_id only where no document of the group has an id. Other columns are not read.
    """
    stage = Stage(docs.sparkSession)
    found = stage.keep(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text", size), "prints")
    nodes = found.groupBy(F.col("bits").getItem(0).alias("node")).agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    nodes = stage.keep(nodes.withColumn("bits", F.array("node")), "nodes")
    groups = linked(nodes, block_keys(F.col("bits"), blocks, distance), 1, distance)
    roots = nodes.join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage.keep(roots.join(least, "root").select("node", "component_id"), "named")
    rows = found.withColumn("node", F.col("bits").getItem(0))
    return rows.join(named, "node").select("doc_id", "bits", "component_id")


def similar_groups(
    docs: DataFrame, doc_id: str, text: str, *, size: int = 5, lanes: int = LANES, rate: float = RATE
) -> DataFrame:
    """One row for each distinct (doc_id, text): doc_id, row_key (hash of both), group, first.

    ``group`` is shared by texts whose distinct word shingles overlap by 0.8 or more, over chains of
    such pairs; ``first`` is true for the row to keep (smallest doc_id, null ids last, then smallest
    hash of the text). Texts without words form one group. Equal texts are one node before anything is compared.
    """
    stage = Stage(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    ids = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"))
    ids = ids.withColumns({"mark": F.xxhash64("text"), "row_key": F.xxhash64("doc_id", "text")})
    common = frequent_shingles(ids, size)
    members = stage.keep(word_prints(ids, ["doc_id", "mark", "row_key"], "text", size, lanes, common), "prints")
    firsts = [F.first(k).alias(k) for k in ("n", "bits", "few")]
    nodes = stage.keep(members.groupBy(F.col("mark").alias("node")).agg(F.count("*").alias("copies"), *firsts), "nodes")

    def exact(pairs: DataFrame) -> DataFrame:
        pairs = stage.keep(pairs, "pairs")
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
        sets = stage.keep(shingle_sets(ids, wanted, size), "sets")
        left = sets.select(F.col("node").alias("a"), F.col("set").alias("a_set"))
        right = sets.select(F.col("node").alias("b"), F.col("set").alias("b_set"))
        near = pairs.join(left, "a").join(right, "b").where(overlapping(F.col("a_set"), F.col("b_set")))
        near = stage.keep(near.drop("a_set", "b_set"), "near")
        stage.drop(pairs, sets)
        return near

    many = nodes.where(F.col("n") > FEW).select("node", "copies", "bits")
    keys = members.select(F.col("mark").alias("node"), "n", F.posexplode("keys").alias("place", "key"))
    keys = keys.select("node", "key", F.struct("n", "place").alias("at"))
    groups = linked(many, keys, lanes, int(rate * 64 * lanes), MINI, exact=exact, meets=enough_left)
    few = nodes.where((F.col("n") > 0) & (F.col("n") <= MANY)).select("node", "copies", F.col("few").alias("bits"))
    few = stage.keep(rare_keys(few), "few")
    groups = groups.unionByName(linked(few, F.col("keys"), MANY, 0, 64, test=overlapping))
    blank = nodes.where("n = 0").select("node")
    groups = groups.unionByName(blank.crossJoin(blank.agg(F.min("node").alias("root"))))
    groups = components(groups, "node", "root")
    groups = groups.withColumnRenamed("node", "mark")
    rows = members.select("doc_id", "mark", "row_key").distinct().join(groups, "mark", "left")
    rows = stage.keep(rows.select("doc_id", "mark", "row_key", F.coalesce("root", "mark").alias("group")), "members")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "row_key"))
    winners = stage.keep(rows.groupBy("group").agg(best.alias("best")).select("group", "best.row_key"), "winners")
    winners = winners.withColumnRenamed("row_key", "winner")
    stage.drop(members, nodes)
    return rows.join(winners, "group").select("doc_id", "row_key", "group", (F.col("row_key") == F.col("winner")).alias("first"))


def near_duplicates_removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One document of each group of similar texts, with all its columns; of repeated rows, one.

    Extra columns of any name pass through. Empty and null texts count as equal texts.
    """
    kept = similar_groups(docs, doc_id, text, **settings).where("first").select(F.col("row_key").alias(KEY))
    kept = Stage(docs.sparkSession).keep(kept, "kept")
    keyed = docs.withColumn(KEY, F.xxhash64(F.col(doc_id), F.coalesce(F.col(text).cast("string"), F.lit(""))))
    return keyed.join(kept, KEY, "left_semi").dropDuplicates([KEY]).drop(KEY)
