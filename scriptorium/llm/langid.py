"""Language identification with hyperdimensional vectors.

Each letter has a random vector of +1 and -1, drawn from its code point.  A run of three letters (words padded by a space)
is bound into one vector: the first letter's permuted twice, the second's once, the third's as it is, multiplied.  A text
is the bundle (sum) of its runs' vectors, a language the bundle of its documents'; a text has the language whose vector is
nearest by cosine.  The mean of all languages' vectors is taken off the prototypes, since what all languages share says
nothing.

Learning sums counts of runs over all labelled rows in the tasks and sends one vector for each language and task on, which
are added up by Spark; what reaches the driver is one vector a language.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator as _Iterator
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import prepare

DIMENSION, RUN = 1024, 3
RESULT = "lang_pred string, score double, evidence double"
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_vectors: dict[int, np.ndarray] = {}


def letter_vector(code: int) -> np.ndarray:
    """The vector of a code point; 32 is what stands for all that isn't a letter."""
    if code not in _vectors:
        raw = hashlib.shake_128(f"letter {code}".encode()).digest(DIMENSION // 8)
        _vectors[code] = (np.unpackbits(np.frombuffer(raw, np.uint8)).astype(np.int8) * 2 - 1)
    return _vectors[code]


def _bind(run: int) -> np.ndarray:
    a, b, c = run >> 42, run >> 21 & 0x1FFFFF, run & 0x1FFFFF
    return np.roll(letter_vector(a), 2) * np.roll(letter_vector(b), 1) * letter_vector(c)


class _Table:
    """Bound vectors that this worker has made, as rows of a matrix; full, it starts anew."""

    def __init__(self, most: int = 20_000):
        self.most, self.place = most, {}
        self.rows = np.empty((256, DIMENSION), np.float32)

    def of(self, runs: list[int]) -> np.ndarray:
        new = [r for r in runs if r not in self.place]
        if len(self.place) + len(new) > self.most:
            self.place, new = {}, runs
        while len(self.place) + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])[: max(self.most, 256)]
        for r in new:
            self.rows[len(self.place)] = _bind(r)
            self.place[r] = len(self.place)
        return self.rows[list(map(self.place.__getitem__, runs))]

    def bundled(self, runs: np.ndarray, weights: np.ndarray, step: int = 4096) -> np.ndarray:
        """The weighted sum of bound vectors, taken in steps so that a text with very many runs needs no more memory."""
        weights = weights.astype(np.float32)
        return sum(weights[k : k + step] @ self.of(runs[k : k + step].tolist()) for k in range(0, len(runs), step))


_table = _Table()


def run_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(runs, counts) of a text; a run holds three code points of 21 bits.  Both are empty if it has no letter."""
    words = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, words)):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.frombuffer(f" {words} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)


def bundle(text: str) -> np.ndarray | None:
    """The vector of a text; None if it has no letter."""
    runs, counts = run_counts(text)
    return _table.bundled(runs, counts) if len(runs) else None


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, prototypes as unit rows) from all rows with a non-null lang and text.

    A document's counts are divided by their root of squares, so it weighs the same whatever its length; a batch's documents
    of one language are summed before they are bound.  Rows without letters teach nothing; with no rows there are no languages.
    """
    prepare(docs.sparkSession)

    def sums(batches: _Iterator[pa.RecordBatch]) -> _Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            found: dict[str, tuple[list, list]] = {}
            for name, value in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                runs, counts = run_counts(value)
                if len(runs):
                    of, weights = found.setdefault(name, ([], []))
                    of.append(runs)
                    weights.append(counts / np.sqrt(float(counts @ counts)))
            for name, (of, weights) in found.items():
                runs, place = np.unique(np.concatenate(of), return_inverse=True)
                held.setdefault(name, np.zeros(DIMENSION))
                held[name] += _table.bundled(runs, np.bincount(place, np.concatenate(weights)))
        if held:
            yield pa.RecordBatch.from_pydict({"lang": list(held), "v": [np.round(x * 2**20).astype(np.int64).tolist() for x in held.values()]}, pa.schema([("lang", pa.string()), ("v", pa.list_(pa.int64()))]))

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null").mapInArrow(sums, "lang string, v array<long>")
    # Sums by language and component first, so that no task gets all vectors of a language.
    summed = rows.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    total = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v"))
    found = sorted(((r.lang, [y.x for y in r.v]) for r in total.toLocalIterator()), key=lambda r: r[0])
    if not found:
        return [], np.zeros((0, DIMENSION), np.float32)
    matrix = np.array([v for _, v in found], np.float64)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True) + 1e-12
    if len(found) > 1:
        matrix -= matrix.mean(0)
        matrix /= np.linalg.norm(matrix, axis=1, keepdims=True) + 1e-12
    return [n for n, _ in found], matrix.astype(np.float32)


def predicted(text: Column, model: tuple[list[str], np.ndarray], context) -> Column:
    """Struct RESULT for a text column: the nearest language, (1 + its cosine) / 2, and of how many equally frequent runs the text
    is worth ((sum of counts)^2 / sum of squares; repeated words are worth little).  A null text, one without a letter,
    or a model without languages gives ``und``, 0 and 0.  Equal texts have equal results; ties go to the first language by name."""
    shared = context.broadcast(model)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, prototypes = shared.value
        for part in parts:
            out = []
            for value in part:
                runs, counts = run_counts(value or "")
                if not len(runs) or not names:
                    out.append((UNKNOWN, 0.0, 0.0))
                    continue
                v = _table.bundled(runs, counts)
                cosines = prototypes @ v / (np.linalg.norm(v) or 1)
                best = int(cosines.argmax())
                out.append((names[best], round((1 + min(1.0, max(-1.0, float(cosines[best])))) / 2, 6), float(counts.sum()) ** 2 / float(counts @ counts)))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "evidence"])

    return F.pandas_udf(run, RESULT).asNondeterministic()(text)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 by three.  A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text, lang); learns from what isn't held out.

    A null text, or one without a letter, is ``und`` with a score of 0, and so is everything where nothing is labelled.  Rows are
    kept one for one, repeated ones too; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), predicted(F.col("text"), model, docs.sparkSession.sparkContext).alias("found")).select("doc_id", "held_out", "found.lang_pred", "found.score")


def accepted(docs: DataFrame, least_score: float = 0.54, full_runs: int = 200) -> DataFrame:
    """The rows of docs (any columns, text and lang among them) in a known language; the others go.

    Rejected are texts without a letter, and texts worth at least full_runs runs that are no nearer to any language than a text
    of none can come by chance (a score of 0.54 is 2.6 standard deviations of such a text's cosine).  The score of a text in a
    known language rises with the runs that it is worth, so for fewer runs the least score falls, in proportion, to 0.5.  A null
    lang is filled with what was found where the score is at least least_score, and else stays null.
    """
    prepare(docs.sparkSession)
    model = learn(docs)
    found = docs.select(F.struct("*").alias("row"), predicted(F.col("text"), model, docs.sparkSession.sparkContext).alias("found"))
    judged = F.least(F.lit(1.0), F.col("found.evidence") / full_runs)
    good = (F.col("found.lang_pred") != UNKNOWN) & (F.col("found.score") >= 0.5 + (least_score - 0.5) * judged)
    certain = F.when(F.col("found.score") >= least_score, F.col("found.lang_pred"))
    return found.where(good).select(*[(F.coalesce(F.col("row").getField(c), certain) if c == "lang" else F.col("row").getField(c)).alias(c) for c in docs.columns])
