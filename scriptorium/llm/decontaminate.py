"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Words of a document are streamed through the automaton, which at each word knows the longest stretch ending there that
occurs in some item.  A stretch of `window` words, or a whole item that has fewer, is a hit.  Automata are built in
blocks of bounded size, one at a time on the driver, and broadcast; documents are not shuffled.  A worker holds
`pass_blocks` automata at most: a benchmark of more blocks takes further passes over the documents, each written to the
shared folder with what was found so far.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import dropped, prepare, written

#: Fixed value: a word in UTF-8, after A-Z were lower-cased.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
RESULT = "n_words long, n_hit long, items array<string>, hits array<struct<a: long, b: long>>, spans array<struct<start: long, end: long>>, cleaned string"


class Automaton:
    """Generalised suffix automaton over items, each a list of words."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        held = [(name, words) for name, words in items if words]
        self.known = {w for _, words in held for w in words}
        self.least = min([window, *(len(words) for _, words in held)])
        for _, words in held:
            last = 0
            for w in words:
                last = self._extend(last, w)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        # The state that stands for the last `window` words of a state's stretches.
        self.at_window = [0] * len(self.link)
        for v in order:
            if self.length[v] >= window:
                self.at_window[v] = v if self.length[self.link[v]] < window else self.at_window[self.link[v]]
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}
        for name, words in held:
            v = 0
            for n, w in enumerate(words, 1):
                v = self.next[v][w]
                if n >= window:
                    self.items.setdefault(self.at_window[v], set()).add(name)
            if len(words) < window:
                while self.length[self.link[v]] >= len(words):
                    v = self.link[v]
                self.short.setdefault(v, {}).setdefault(len(words), set()).add(name)
        # The nearest state on the way to the root, itself included, at which a short item ends.
        self.up = [-1] * len(self.link)
        for v in order:
            self.up[v] = v if v in self.short else self.up[self.link[v]]

    def _new(self, length: int, after: dict, link: int) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """A state for the stretches of q that end the way p and w do."""
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, w: bytes) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, end, items) of each occurrence of a window in the words, by ascending end."""
        flags = bytes(map(self.known.__contains__, words))
        run = b"\x01" * self.least
        begin = flags.find(run)
        while begin >= 0:
            end = flags.find(b"\x00", begin)
            end = len(words) if end < 0 else end
            v = n = 0
            for at in range(begin, end):
                w = words[at]
                while v and w not in self.next[v]:
                    v = self.link[v]
                    n = self.length[v]
                if w in self.next[v]:
                    v, n = self.next[v][w], n + 1
                if n >= self.window:
                    yield at + 1 - self.window, at + 1, self.items[self.at_window[v]]
                u = self.up[v]
                while u > 0:
                    for m, names in self.short[u].items():
                        if m <= n:
                            yield at + 1 - m, at + 1, names
                    u = self.up[self.link[u]]
            begin = flags.find(run, end)


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


def joined(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap, or touch, made one; ascending."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def automata(benchmark: DataFrame, window: int = 10, block_words: int = 200_000) -> Iterator:
    """Broadcast automata over benchmark (item_id, text), each of at most block_words words (or one longer item).

    Items come to the driver one partition at a time and a block at a time is held.  Null ids count as "" and null or
    wordless texts as no item.
    """
    sc = benchmark.sparkSession.sparkContext
    held, weight = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text")).toLocalIterator():
        words = words_of(None if row.text is None else bytes(row.text))
        if held and weight + len(words) > block_words:
            yield sc.broadcast(Automaton(held, window))
            held, weight = [], 0
        if words:
            held.append((row.item_id, words))
            weight += len(words)
    if held:
        yield sc.broadcast(Automaton(held, window))


def contamination(text: Column, blocks: list, longest: int = 1, coverage: float = 0.5, cleaned: bool = True, before: Column | None = None) -> Column:
    """Struct RESULT for a text column.

    n_words: its words.  n_hit: those inside an occurrence of a window.  items: ids with occurring windows, sorted as
    strings.  hits: stretches of hit words.  spans: code-point spans of the removed stretches.  cleaned: the text without its
    hit stretches of at least `longest` words, each replaced by a line end; null where more than `coverage` of the words
    are hit (the document is to be dropped), and the text as it was where nothing is hit.  A null text has no words and
    stays null.  before: such a struct of the same text, found with other blocks, to be added.
    """

    def run(parts: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for texts, earlier in parts:
            rows = []
            for data, old_items, old_hits in zip(texts, earlier["items"], earlier["hits"], strict=True):
                words = words_of(data)
                hits, items = [(h["a"], h["b"]) for h in old_hits], set(old_items)
                for block in blocks:
                    for a, b, names in block.value.matches(words):
                        hits.append((a, b))
                        items |= names
                hits = joined(hits)
                n_hit = sum(b - a for a, b in hits)
                spans, clean = [], None
                if cleaned and not hits:
                    clean = None if data is None else data.decode()
                elif cleaned:
                    places, at, kept = [m.span() for m in WORD.finditer(data.lower())], 0, []
                    for a, b in hits:
                        if b - a >= longest:
                            start, end = places[a][0], places[b - 1][1]
                            spans.append({"start": len(data[:start].decode()), "end": len(data[:end].decode())})
                            kept.append(data[at:start])
                            at = end
                    clean = b"\n".join([*kept, data[at:]]).decode() if n_hit <= coverage * len(words) else None
                rows.append((len(words), n_hit, sorted(items), [{"a": a, "b": b} for a, b in hits], spans, clean))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "hits", "spans", "cleaned"])

    none = F.struct(F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<a: long, b: long>>").alias("hits"))
    earlier = none if before is None else F.struct(before["items"].alias("items"), before["hits"].alias("hits"))
    # Not deterministic, so that a filter on the result does not make Spark call it twice.
    return F.pandas_udf(run, RESULT).asNondeterministic()(text.cast("binary"), earlier)


def held_against(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int = 200_000, pass_blocks: int = 4, **settings) -> DataFrame:
    """docs (text among its columns) with the struct of ``contamination`` as __found, in as many passes as blocks need."""
    prepare(docs.sparkSession)
    rows, before, group = docs, None, []
    for block in automata(benchmark, window, block_words):
        if len(group) == pass_blocks:
            following = written(docs.select("*", contamination(F.col("text"), group, cleaned=False).alias("__found")) if before is None else rows.withColumn("__found", contamination(F.col("text"), group, cleaned=False, before=before)), "pass")
            dropped(rows)
            for b in group:
                b.destroy()
            rows, before, group = following, F.col("__found"), []
        group.append(block)
    return rows.withColumn("__found", contamination(F.col("text"), group, before=before, **settings))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, longest: int = 1, coverage: float = 0.5, **passes) -> DataFrame:
    """docs (any columns, text among them) without the stretches that occur in benchmark; n_chars, if there, follows.

    A document of which more than `coverage` of the words are hit goes; all others stay, with all their columns, repeated
    rows too.  Null and empty texts stay as they are; an empty benchmark changes nothing; an empty table gives no rows.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    out = held_against(rows, benchmark, window, longest=longest, coverage=coverage, **passes).withColumnRenamed("__found", "found").where("found.cleaned is not null or text is null")
    changed = {"text": F.col("found.cleaned"), "n_chars": F.when(F.col("found.n_hit") > 0, F.length("found.cleaned").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[(changed[c] if changed.get(c) is not None else F.col("row").getField(c)).alias(c) for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, **passes) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or wordless text has no words and no hits; repeated rows are kept; items with the same id count once; other
    columns are ignored, whatever their names; an empty benchmark hits nothing and an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    found = held_against(rows, benchmark, window, cleaned=False, **passes)
    return found.select("doc_id", "__found.n_words", "__found.n_hit", F.size("__found.items").cast("long").alias("n_items"), F.sha2(F.array_join("__found.items", ","), 256).alias("items_sha256"), (F.col("__found.n_hit") > 0).alias("contaminated"))
