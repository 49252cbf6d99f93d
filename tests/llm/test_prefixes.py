import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from foliospark.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, depth int, slice string, turns string, key int"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(found)] for c, found in own.items()}
    out = {}
    for c, turns in own.items():
        h, first = zlib.crc32(str(c).encode()) % 4, c - int(c - 20 * int(c / 20))
        out[c] = own.get(first, [])[:h] + turns[h:]
    return out


def plain(rows):
    """Every node of the trie, by a dict of prefixes."""
    found = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []
    for p, of in members.items():
        below, leaves, saved = [p], 0, 0
        while below:
            at = below.pop()
            below += children[at]
            leaves += not children[at]
            saved += (len(members[at]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", at[-1][1])) if at else 0
        ends = ",".join(str(c) for c in sorted(of) if len(found[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        out.append((min(of), len(p), up, len(of), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def trie(spark, rows, **how):
    turns = spark.createDataFrame([(*r, 1, "s", "t", 2) for r in rows], SCHEMA)
    found = prefixes.trie(prefixes.regrouped(prefixes.turn_rows(turns)), **how)
    order = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert found.columns == order
    return sorted(repr(tuple(r)) for r in found.collect())


def made(seed, n, words=3, longest=6):
    dealer, rows = random.Random(seed), []
    for c in range(n):
        for turn in range(dealer.randrange(longest)):
            rows.append((c * dealer.choice([1, 1, 7]), turn, dealer.choice(["u", "a"]), " ".join(dealer.choice("xyz") for _ in range(dealer.randrange(words)))))
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("turns", [3, 40, 1_000_000])
def test_random_conversations_in_many_slices(spark, seed, turns):
    rows = [r for r in {(c, t): (c, t, r, x) for c, t, r, x in made(seed, 120)}.values()]
    assert trie(spark, rows, slice_turns=turns) == plain(rows)


def test_copies_and_a_shared_start_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "CHUNK", 3)
    rows = [(c, t, "u", "same turn") for c in range(300, 400) for t in range(5)]
    rows += [(c, t, "u", "same turn" if t < 4 else f"own {c}") for c in range(100) for t in range(6)]
    rows += [(500, t, "u", "same turn") for t in range(200)]
    assert trie(spark, rows, slice_turns=20) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "u", "no conversation"), (1, None, None, None), (1, 0, "u", ""), (2, 5, "", None), (2, 3, "u", " \n\t "), (-7, 0, "u", "é ü"), (-7, 1, "a", "word " * 20_000),
        (20, 0, "u", "a"), (20, 1, "b", "b"), (21, 0, "ub", ""), (22, 0, "u", "b"), (22, 1, None, "c"), (-20, 0, "x", "y"), (2**62, 0, "u", "a"),
    ]
    assert trie(spark, rows) == plain(rows)
    assert trie(spark, []) == []


def test_turns_with_one_number_and_repeated_rows(spark):
    rows = [(3, 0, "u", "b"), (3, 0, "u", "a"), (3, 0, "u", "a"), (45, 1, "u", "z")]
    found = [eval(r) for r in trie(spark, rows)]
    root = next(r for r in found if r[1] == 0)
    assert root[0] == 3 and root[3] == 2 and max(r[1] for r in found) <= 3
    assert trie(spark, rows[::-1]) == trie(spark, rows)


def test_roles_and_texts_are_not_mixed_up(spark):
    rows = [(c, t, r, x) for c, r, x in [(1, "ab", "c"), (2, "a", "bc"), (3, "", "abc"), (4, "1:", "x")] for t in range(5)]
    assert trie(spark, rows) == plain(rows)
