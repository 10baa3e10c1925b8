"""The source audit against plain counts in memory."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np

from scriptorium.llm import divergence

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def brute(rows: list[tuple], least: int = 30, top: int = 50) -> list[tuple]:
    groups, documents = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = Counter(WORD.findall(lower(text or "")))
        groups[lang or "", source or ""].update(found)
        documents[lang or ""].update(found.keys())
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in documents[lang].items() if d >= least]
        sources = [g[1] for g in groups if g[0] == lang]
        whole = Counter()
        for s in sources:
            whole.update({t: groups[lang, s][t] for t in kept})

        def share(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: share(groups[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if groups[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ordered)]
    return sorted(map(repr, out))


def got(spark, rows, extra=(), **options) -> list[str]:
    schema = "text string, lang string, source string" + "".join(f", {c} string" for c in extra)
    df = divergence.audit(spark.createDataFrame([(*r, *extra) for r in rows], schema), **options)
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(repr, map(tuple, df.collect())))


def made(n: int, seed: int = 0) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda k: rng.choice(["Été", "x_y", "don't", "Zoë", "a1b", "—", " ", "ß"]) + f"{'abcdefgh'[k % 8]}{'ijklmnop'[k // 8 % 8]}"
    rows = [(" ".join(word(int(rng.expovariate(0.1))) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "fr", None, ""]), rng.choice([*(f"s{k}" for k in range(7)), None, "é"])) for _ in range(n)]
    return [*rows, (None, "en", "mute"), ("", "solo", "only"), ("one two", "few", "a"), ("three", "few", "b"), (None, "few", None), ("x " * 50_000, "en", "s1")]


def test_equals_plain_counts(spark):
    rows = made(400)
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, ("term", "n", "total", "block", "place", "groups", "value", "rank", "item", "part"), least_documents=3, top=4) == brute(rows, 3, 4)


def test_several_groups_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "GROUP_SOURCES", 3)
    monkeypatch.setattr(divergence, "BLOCK_WORDS", 16)
    rows = made(300, 1) + made(300, 1)  # repeated rows count twice
    assert got(spark, rows, least_documents=2) == brute(rows, 2)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_task_counts_are_summed(spark):
    rows = made(200, 2)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").na.fill("")
    total = {tuple(r)[:3]: r.n for r in divergence.counted(docs).groupBy("lang", "source", "term").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert total["en", "s1", "x"] >= 50_000


def test_shares_are_exact_beyond_64_bits():
    counts, whole = np.array([9_000_000_000_000_000, 123_456_789_012_345, 5, 7]), np.array([9_000_000_000_000_001, 8_765_432_109_876_543, 5, 9_000_000_000_000_000])
    assert divergence.shares(counts, whole).tolist() == [1 + 10**9 * int(c) // int(w) for c, w in zip(counts, whole, strict=True)]
