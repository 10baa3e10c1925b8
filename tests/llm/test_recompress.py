"""Substring deduplication against all windows in memory, and the parse's own promise."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import recompress


def brute(rows: list[tuple[int | None, str | None]], window: int = 13) -> list[tuple]:
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    first: dict[tuple, int] = {}
    for i, words in texts:
        if i is not None:
            for k in range(len(words) - window + 1):
                w = tuple(words[k : k + window])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, words in texts:
        gone = set()
        if i is not None:
            for k in range(len(words) - window + 1):
                if first[tuple(words[k : k + window])] < i:
                    gone.update(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def got(spark, rows, window=13, extra=()):
    schema = "doc_id long, text string" + "".join(f", {c} string" for c in extra)
    docs = spark.createDataFrame([(*r, *extra) for r in rows], schema)
    return sorted(map(repr, map(tuple, recompress.report(docs, window).collect())))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=13, max_size=60), st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30), st.sampled_from([13, 5, 29]))
def test_equal_windows_have_equal_anchors(middle, before, after, window):
    names = recompress._mixed(np.arange(1, 6, dtype=np.uint64))
    alone, inside = (recompress.anchors(names[np.array(x, int)], window) for x in (middle, before + middle + after))
    assert (alone == inside[len(before) : len(before) + len(alone)]).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4000), min_size=40, max_size=400, unique=True))
def test_every_window_has_an_anchor_where_no_word_repeats(words):
    names = recompress._mixed(np.array(words, np.uint64))
    keys = recompress.anchors(names, 13)
    assert len(set(keys.tolist())) < 0.5 * len(keys) + 5  # far fewer anchors than windows


def test_texts_are_parsed_together_and_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    names = recompress._mixed(rng.integers(0, 50, 5000).astype(np.uint64))
    whole = recompress.anchors(names, 13)
    monkeypatch.setattr(recompress, "_CHUNK", 300)
    assert (recompress._batch_anchors(names, 13) == whole).all() and len(recompress._batch_anchors(names[:12], 13)) == 0
    # A text's windows have the keys that they have where it stands alone.
    assert (recompress.anchors(names[700:900], 13) == whole[700:888]).all()


@pytest.mark.parametrize("vocabulary", [2, 40, 3000])
def test_equals_all_windows(spark, vocabulary):
    rng = random.Random(vocabulary)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    shared = [" ".join(word() for _ in range(rng.randrange(13, 90))) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 40))) for _ in range(3)]
        parts.insert(1, rng.choice(shared) if i % 2 else "")
        rows.append((i * 7 % 127, rng.choice([" ", "\n", "\t \x0b"]).join(parts)))
    assert got(spark, rows) == brute(rows)


def test_cases(spark):
    long = " ".join(f"v{k}" for k in range(40))
    same = "a " * 200
    rows = [
        (1, long), (2, long), (3, long + " tail"), (4, "head " + long), (5, None), (6, ""), (7, " \n"), (8, same), (9, same + "b"), (10, "b " + same), (11, long + " " + long), (0, long + " " + long + " x"),
        (12, " ".join(f"v{k}" for k in range(12))), (13, " ".join(f"v{k}" for k in range(13))), (None, long), (None, None), (14, "é " * 30), (15, "é é " * 30), (16, "É " * 30), (17, "é " * 13), (3, "other " + long), (3, long + " tail"),
        (-5, " ".join(f"v{k}" for k in range(3, 30))), (20, "x y " * 30), (21, "z " + "x y " * 30), (22, "x " * 12), (23, "x " * 13), (24, "x " * 14),
    ]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, 4) == brute(rows, 4)
    assert got(spark, rows, extra=("version", "keys", "at", "whole", "top", "key")) == brute(rows)
    assert got(spark, []) == []


def test_very_long_text(spark):
    rng = random.Random(3)
    text = " ".join(f"{rng.randrange(5000)}" for _ in range(300_000))
    rows = [(1, text), (2, text[200_000:900_000]), (3, "own words alone")]
    assert got(spark, rows) == brute(rows)
