import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import simhash
from scriptorium.operators.graph import components


def brute(rows):
    """The contract, pair by pair."""

    def mark(text):
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    marks = [mark(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{m:016x}", least.get(find(i))) for i, ((d, _), m) in enumerate(zip(rows, marks))), key=str)


def rows_of(seed=3):
    r = random.Random(seed)
    words = ["a", "bb", "ccc", "Dd", "é", "x-y"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 6)))) for i in range(150)]
    base = [r.choice("abcdefgh") * r.randint(1, 5) for _ in range(300)]
    for i in range(60):
        near = list(base)
        near[r.randrange(300)] = "new%d" % i
        rows.append((1000 - i, " ".join(near)))
    return [*rows, (5, None), (6, ""), (7, "\t \n"), (None, "a bb"), (8, rows[3][1]), (3, rows[3][1])]


def test_against_brute_force(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, fp string")
    for limit in (32, 2):
        got = sorted((tuple(x) for x in simhash.groups(docs, list_limit=limit).collect()), key=str)
        assert got == brute(rows)


def test_long_lists_link_exactly(spark):
    r = random.Random(5)
    base = r.getrandbits(64)
    marks = {base}
    while len(marks) < 120:
        m = r.choice(sorted(marks))
        for _ in range(r.randint(1, 3)):
            m ^= 1 << r.randrange(64)
        marks.add(m)
    signed = [m - (1 << 64 if m >> 63 else 0) for m in marks]
    found = {}
    for limit in (2, 200):
        edges = simhash.links(spark.createDataFrame([(m,) for m in signed], "fp long"), list_limit=limit)
        found[limit] = sorted(map(tuple, components(edges).collect()))
    parent = {m: m for m in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) % 2**64).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    want = sorted((m, find(m)) for m in signed if sum(find(x) == find(m) for x in signed) > 1)
    assert found[2] == found[200] == want


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, None), (60, 50), (50, 60)], "a long, b long")
    assert sorted(map(tuple, components(edges).collect())) == sorted([(i, 0) for i in range(41)] + [(50, 50), (60, 50)])
    assert components(edges.limit(0)).collect() == []


def test_deduplicate(spark):
    docs = spark.createDataFrame([(2, "x y z w", "k"), (1, "x y z w", "m"), (3, "some other words entirely", None), (3, "some other words entirely", "b"), (None, "q", "q")], "doc_id long, text string, fp string")
    assert sorted(map(tuple, simhash.deduplicate(docs).collect()), key=str) == sorted([(1, "x y z w", "m"), (3, "some other words entirely", None), (None, "q", "q")], key=str)
    assert simhash.groups(docs.limit(0)).collect() == []


def test_deduplicate_by_rows(spark):
    near = [" ".join(f"w{i}" for i in range(300))]
    rows = [
        (1, near[0], "a"), (5, near[0], "b"), (5, "a text of its own, unlike any other", "c"), (5, "zz another unlike text under the same id", "d"), (5, "zz another unlike text under the same id", "e"),
        (7, "seven words that nobody else has here", "f"), (7, "aa unlike seven", "g"),
        (None, near[0], "h"), (None, "text without id", "i"), (None, "text without id", "j"), (None, "other text without id", "k"), (None, None, "l"), (None, "", "m"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    assert sorted(r.fp for r in simhash.deduplicate(docs).collect()) == list("acdfgikl")
    assert sorted(r.fp for r in simhash.deduplicate(docs.where("doc_id is not null")).collect()) == list("acdfg")
    assert sorted(r.fp for r in simhash.deduplicate(docs.where("doc_id is null")).collect()) == list("hikl")
    assert simhash.deduplicate(docs).columns == docs.columns and simhash.deduplicate(docs.limit(0)).collect() == []


def test_deduplicate_with_a_map_column(spark):
    rows = [(1, "x y z", {"k": 1}), (1, "x y z", {"k": 0}), (2, "x y z", None), (None, "q", {"a": 2}), (None, "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string, int>")
    got = simhash.deduplicate(docs).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("1", "x y z"), ("None", "q")]


@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=9))
@settings(max_examples=300, deadline=None)
def test_tally_says_how_many_bytes_are_shared(a, flips):
    b = a
    for k in flips:
        b ^= 1 << k
    alike = {k for k in range(8) if a >> 8 * k & 255 == b >> 8 * k & 255}
    tally = sum(set(key) <= alike for key in simhash._KEYS)
    assert len(simhash._KEYS) == 14 and (tally >= simhash.LEAST_TALLY) == (len(alike) >= 6)


def test_columns_of_any_name_are_kept(spark):
    names = ["label", "__gone", "__fp", "__id", "of", "id", "row", "fp", "node", "least_id", "component_id", "n", "k"]
    rows = [(1, "one two three four", "en"), (2, "one two three four", "en"), (None, "a b c d", "x"), (None, "a b c d", "y"), (5, "z z z", "p"), (5, "other words here now", "q"), (5, "other words here now", "r"), (7, None, "n"), (8, "", "n")]
    docs = spark.createDataFrame([(*r, *(f"{n}{k}" for n in names)) for k, r in enumerate(rows)], "doc_id long, text string, lang string" + "".join(f", {n} string" for n in names))
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "", r.label) for r in kept.collect()) == [(0, "a b c d", "label2"), (1, "one two three four", "label0"), (5, "other words here now", "label5"), (5, "z z z", "label4"), (7, "", "label7")]
