import random
from collections import defaultdict

import xxhash
from conftest_llm import prose
from pyspark.sql import functions as F

from foliospark.llm import graph, simhash


def plain_print(text, size):
    words = (text or "").lower().split()
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, limit):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= limit:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def edited(text, seed, changes):
    words, r = text.split(), random.Random(seed)
    for _ in range(changes):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def test_close_groups_match_all_pairs(spark):
    texts = [prose(s, 120) for s in range(6)]
    texts += [edited(texts[s % 3], s, s % 5) for s in range(120)] + ["", None, "one", "one two three"]
    rows = list(enumerate(texts, 10))
    found = simhash.close_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    mine = {r.doc_id: (r.bits[0] & (2**64 - 1), r.component_id) for r in found}
    prints = [plain_print(t, 4) for t in texts]
    roots = plain_groups(prints, 4)
    assert mine == {i: (p, r + 10) for (i, _), p, r in zip(rows, prints, roots)}


def test_close_groups_on_odd_rows(odd, empty):
    found = simhash.close_groups(odd).collect()
    assert len(found) == odd.count()
    zero = {r.component_id for r in found if r.bits == [0]}
    assert zero == {3}
    assert {r.component_id for r in found if r.doc_id == 2} == {1}
    assert simhash.close_groups(empty).count() == 0


def test_dense_group_is_found_without_pairs(spark):
    """Fingerprints around one centre, some of them near no other but through the group."""
    r = random.Random(3)
    centre = r.getrandbits(64)
    prints = {centre}
    for _ in range(150):
        p = centre
        for b in r.sample(range(64), r.randrange(1, 7)):
            p ^= 1 << b
        prints.add(p)
    prints |= {r.getrandbits(64) for _ in range(150)}
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p, 1) for p in prints]
    nodes = spark.createDataFrame(signed, "node long, copies long").withColumn("bits", F.array("node"))
    found = simhash.linked(nodes, simhash.block_keys(F.col("bits"), 6, 4), 1, 4).collect()
    mine = {r.node: r.root for r in found}
    by_root = defaultdict(set)
    for (n, _), root in zip(signed, plain_groups(prints, 4)):
        by_root[root].add(n)
    groups = defaultdict(set)
    for n, root in mine.items():
        groups[root].add(n)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in by_root.values() if len(g) > 1}


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_similar_texts_go_and_others_stay(spark):
    base = [prose(s, 300) for s in range(40)]
    near = [edited(t, s, 4) for s, t in enumerate(base[:20])]  # overlap about 0.88
    far = [edited(t, s, 60) for s, t in enumerate(base[20:])]  # overlap about 0.3
    rows = list(enumerate([*base, *near, *far]))
    kept = {r.doc_id for r in simhash.near_duplicates_removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= set(range(40)) | set(range(60, 80))
    assert len(kept & set(range(40, 60))) <= 1


def test_removal_on_odd_rows(odd, empty):
    found = simhash.near_duplicates_removed(odd)
    assert found.columns == odd.columns
    kept = [(r.doc_id, r.text) for r in found.collect()]
    assert sorted(i for i, _ in kept if i is not None) == [1, 1, 3, 6, 7, 8]
    assert sum(i is None for i, _ in kept) == 1
    assert simhash.near_duplicates_removed(empty).count() == 0


def run_of(seed, n):
    """``n`` words that no other text has."""
    return [f"w{seed}x{i}" for i in range(n)]


def halves(spark, cases):
    """For each (shared, own of one, own of the other) of shingles, whether the two texts are in one group."""
    rows = []
    for i, (shared, a, b) in enumerate(cases):
        common = run_of(f"c{i}", shared + 4)
        rows += [(2 * i, " ".join(run_of(f"a{i}", a) + common)), (2 * i + 1, " ".join(run_of(f"b{i}", b) + common))]
    found = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    group = {r.doc_id: r.group for r in found.collect()}
    assert len(set(group.values())) >= len(cases)
    return [group[2 * i] == group[2 * i + 1] for i in range(len(cases))]


def test_overlap_below_the_contract_is_never_a_link(spark):
    """The bits of many such pairs differ in less than the rate."""
    assert not any(halves(spark, [(s, a, b) for s in (79, 158, 316, 395) for a in range(s * 21 // 79, s * 21 // 79 + 20) for b in (0,)]))
    assert not any(halves(spark, [(399, 50, 51)] * 40 + [(3, 1, 0), (7, 1, 1), (31, 4, 4)]))


def test_overlap_of_the_contract_is_a_link(spark):
    """Exactly 4 / 5, in long texts and where one of the texts is the shorter."""
    found = halves(spark, [(400, 50, 50)] * 100 + [(400, 100, 0)] * 100 + [(36, 9, 0)] * 100 + [(48, 6, 6)] * 100)
    assert sum(found) >= 396


def test_short_texts_meet_in_their_shingles(spark):
    """Every length at which an overlap of 4 / 5 is possible, and lines that many texts have."""
    cases = [(s, own, 0) for s in range(4, 41) for own in range(1, s // 4 + 1)]
    cases += [(s, 1, own) for s in range(8, 41) for own in range(1, s // 4)]
    assert all(halves(spark, cases))
    line = " ".join(run_of("line", 9))
    texts = [f"{line} {' '.join(run_of(i // 2, 25))}{' and one' * (i % 2)}" for i in range(400)]
    found = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    assert found.select("group").distinct().count() == 200


def test_texts_without_words_are_one_group(spark):
    rows = [(1, ""), (2, " "), (3, None), (4, "\n\t"), (5, "a")]
    found = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    group = {r.doc_id: r.group for r in found.collect()}
    assert len({group[i] for i in (1, 2, 3, 4)}) == 1 and group[5] != group[1]


def test_texts_that_share_nothing_never_meet(spark, monkeypatch):
    """Blocks of bits meet by chance, with the square of the texts; shingles don't."""
    met, keep = [], simhash.Stage.keep

    def counting(self, df, name="llm"):
        out = keep(self, df, name)
        if name == "shared":
            met.append(out.count())
        return out

    monkeypatch.setattr(simhash.Stage, "keep", counting)
    texts = [" ".join(run_of(f"u{i}", 60)) for i in range(3000)]
    found = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    assert found.select("group").distinct().count() == 3000 and sum(met) == 0


def test_long_texts_with_frequent_lines_meet_in_the_rest(spark):
    """Lines that every text has come last in the order; pairs of exactly 4 / 5 are found all the same."""
    line = " ".join(run_of("line", 30))
    rows = []
    for i in range(150):
        own = " ".join(run_of(f"o{i}", 174))
        rows += [(2 * i, f"{line} {own}"), (2 * i + 1, f"{line} {own} {' '.join(run_of(f'p{i}', 50))}")]
    found = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), "doc_id", "text")
    group = {r.doc_id: r.group for r in found.collect()}
    assert all(group[2 * i] == group[2 * i + 1] for i in range(150)) and len(set(group.values())) == 150


def test_groups_are_the_same_whatever_the_order_of_shingles(spark, monkeypatch):
    """Which texts the frequent shingles are counted in decides who meets, not who is linked."""
    cases = [(120 + i, i % 45, (7 * i) % 45) for i in range(60)]
    line = " ".join(run_of("line", 40))
    rows = []
    for i, (shared, a, b) in enumerate(cases):
        common = [*run_of(f"c{i}", shared + 4), line]
        rows += [(2 * i, " ".join([*run_of(f"a{i}", a), *common])), (2 * i + 1, " ".join([*run_of(f"b{i}", b), *common]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def groups():
        found = defaultdict(set)
        for r in simhash.similar_groups(docs, "doc_id", "text").collect():
            found[r.group].add(r.doc_id)
        return {frozenset(g) for g in found.values()}

    sets = {i: set(simhash.distinct_hashes(t.encode(), 5).tolist()) for i, t in rows}
    linked = {i for i in range(0, 120, 2) if len(sets[i] & sets[i + 1]) * 5 >= len(sets[i] | sets[i + 1]) * 4}
    expected = {frozenset((i, i + 1)) for i in linked} | {frozenset([j]) for i in range(0, 120, 2) if i not in linked for j in (i, i + 1)}
    assert 10 < len(linked) < 50 and groups() == expected
    none = simhash.np.zeros(1 << simhash.MAP_BITS - 6, simhash.np.uint64)
    for maps in ([none] * len(simhash.OFTEN), [~none] * len(simhash.OFTEN)):
        monkeypatch.setattr(simhash, "frequent_shingles", lambda *_, m=maps: m)
        assert groups() == expected


def test_pairs_that_cannot_reach_the_overlap_are_not_looked_at(spark):
    """The shorter text's key is among its first ninth, and both have enough shingles left."""
    at = spark.createDataFrame([(90, 10, 90, 10), (90, 11, 90, 0), (90, 0, 112, 0), (90, 0, 113, 0), (100, 0, 125, 25), (100, 1, 125, 25), (100, 0, 125, 26)],
                               "an int, ap int, bn int, bp int")
    a, b = (F.struct(F.col(f"{x}n").alias("n"), F.col(f"{x}p").alias("place")) for x in "ab")
    assert [r[0] for r in at.select(simhash.enough_left(a, b)).collect()] == [True, False, True, False, True, False, False]
