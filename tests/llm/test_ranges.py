import random

from pyspark.sql import functions as F

from scriptorium.llm._common import ranges


def test_ranges(spark):
    r = random.Random(1)
    tables = [[r.randrange(10**6) for _ in range(600)], [5] * 400 + [r.randrange(-(2**63), 2**63) for _ in range(100)] + [None] * 140, [2**63 - 1, -(2**63), 0, 0, None], [], [None]]
    for keys in tables:
        rows = [(k, r.randint(1, 50)) for k in keys]
        df = spark.createDataFrame(rows, "key long, weight long")
        for most in (300, 10**9):
            cut = ranges(df, most, 4)
            by: dict = {}
            for x in df.select("key", "weight", cut.part(F.col("key"), F.monotonically_increasing_id()).alias("p")).collect():
                by.setdefault(x.p, []).append(x)
            assert all(0 <= p < max(1, cut.count) for p in by) and sum(map(len, by.values())) == len(rows)
            last, limit = -(2**63), max(1, min(most, -(-sum(w for _, w in rows) // 4)))
            for p in sorted(by):
                found = [x.key for x in by[p] if x.key is not None]
                assert not found or min(found) >= last
                last = max(found, default=last)
                assert len({x.key for x in by[p]}) == 1 or sum(x.weight for x in by[p]) <= limit
            if keys.count(5) > 1 and most == 300:
                assert len({p for p, v in by.items() if v[0].key == 5}) > 1 and len({p for p, v in by.items() if v[0].key is None}) > 1
