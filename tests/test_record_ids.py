import random

import pytest

from foliospark.operators import ordering

SCHEMA = "board string, problem int, part int, block int, note string"


def made(seed, n, hot=0):
    dealer = random.Random(seed)
    rows = [(dealer.choice(["a", "b", "c", None, "zz"]), dealer.choice([1, 2, 3, None]), dealer.randrange(3), i, "x") for i in range(n)]
    rows += [("b", 2, 1, n + i, "x") for i in range(hot)]
    return rows + [("bare", None, None, None, None), ("bare", 7, 0, None, "only one")]


def plain(rows):
    def first_null(r):
        return [(v is not None, v if v is not None else 0 if k else "") for k, v in enumerate(r[:4])]

    return sorted((i, r) for i, r in enumerate(sorted(rows, key=first_null)))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize(("rows", "hot"), [(None, 0), (5, 0), (7, 60), (1, 3)])
def test_ids_follow_boards_problems_and_blocks(spark, seed, rows, hot):
    given = made(seed, 50, hot)
    df = spark.createDataFrame(given, SCHEMA).repartition(5)
    found = ordering.record_ids(df, ["board", "problem", "part"], ["block"], rows=rows)
    assert found.columns == [*df.columns, "record_id"]
    assert sorted((r.record_id, tuple(r)[:-1]) for r in found.collect()) == plain(given)


def test_one_ordering_column_and_an_empty_table(spark):
    df = spark.createDataFrame([("b", 1, 1, 2, ""), ("a", 1, 1, 1, ""), ("b", 1, 1, 1, "")], SCHEMA)
    found = ordering.record_ids(df, ["board"], ["block"]).collect()
    assert sorted((r.record_id, r.board, r.block) for r in found) == [(0, "a", 1), (1, "b", 1), (2, "b", 2)]
    assert ordering.record_ids(df.limit(0), ["board", "problem"], ["block"]).count() == 0


def test_records_are_not_put_in_one_range_order(spark, monkeypatch):
    df, ranged = spark.createDataFrame(made(1, 300), SCHEMA), []
    deal = type(df).repartitionByRange
    monkeypatch.setattr(type(df), "repartitionByRange", lambda self, *a: ranged.append(self.columns) or deal(self, *a))
    found = ordering.record_ids(df, ["board", "problem"], ["part", "block"])
    assert found.count() == 302
    assert ranged and all("block" not in columns for columns in ranged)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "SinglePartition" not in plan
