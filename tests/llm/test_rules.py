import re
from collections import Counter

from foliospark.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    found = WORD.findall(text or "")
    windows = Counter(zip(found, found[1:], found[2:]))
    covered = {i + j for i in range(len(found) - 2) if windows[tuple(found[i : i + 3])] > 1 for j in range(3)}
    lines = [s for s in (text or "").split("\n") if WORD.search(s)]
    repeats = sum(s in lines[:i] for i, s in enumerate(lines))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(found), sum(map(len, found)), symbols, repeats, len(covered)


def test_counts_match_plain_loops():
    texts = ["", " ", "a b c a b c", "a a a a a", "é\x85b c\u3000d #*", "x\ny\nx\n\n \nx\r", "a b c d a b c d e a b", "<|>&%$"]
    for t in texts:
        assert rules.rule_counts(t.encode()) == plain_counts(t), t


def test_counts_of_odd_rows(odd, empty):
    found = rules.host_verdicts(odd)
    assert found.count() == odd.count()
    mine = Counter((r.doc_id, *[r[c] for c in rules.COUNTS], r.base_failed) for r in found.collect())
    theirs = Counter()
    for r in odd.collect():
        c = plain_counts(r.text)
        theirs[(r.doc_id, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert mine == theirs
    assert all(r.kept == (not r.base_failed) for r in found.collect())
    assert rules.host_verdicts(empty).count() == 0


def test_host_rates_shrink_towards_the_mean(spark):
    rows = [("good", False)] * 95 + [("good", True)] * 5 + [("bad", True)] * 90 + [("bad", False)] * 10 + [("new", True)]
    found = {r.host: r for r in rules.host_rates(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
    n, f = 201, 96
    mean = f / n
    squares = 25 / 100 + 8100 / 100 + 1
    between = squares / n - mean * mean - mean * (1 - mean) * 3 / n
    weight = max(mean * (1 - mean) / between - 1, 1)
    for host, docs, failures in (("good", 100, 5), ("bad", 100, 90), ("new", 1, 1)):
        assert abs(found[host].rate - (failures + weight * mean) / (docs + weight)) < 1e-9
    assert found["good"].rate < found["new"].rate < 1


def test_host_verdict_reaches_clean_documents(spark):
    clean = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "few", "spam") for i in range(50)] + [(50, clean, "spam"), (51, clean, "fine"), (52, clean, None)]
    rows += [(60 + i, clean + f" {i}", "fine") for i in range(50)]
    found = {r.doc_id: r for r in rules.host_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert found[50].host_rejected and not found[50].base_failed and not found[50].kept
    assert found[51].kept and found[52].kept
