"""Attack scorers behind one small protocol: score many texts of a row, or one long text.

A scorer works on array columns, so every window of an item is scored in the row that holds it and
nothing is regrouped afterwards. A native scorer is plain Column arithmetic; a Python model becomes
an Arrow UDF over the same arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.functions.spans import let


@dataclass(frozen=True)
class Scorer:
    name: str
    many: Callable[[Column], Column]  # array<string> -> array<double>; null for a null text, or in all if any text fails
    cut: Callable[[Column], Column]  # string -> array<string>: the pieces a long text is scored in
    native: bool = True
    phrases: tuple[str, ...] = ()  # of a scorer that only looks whether the lower-cased text holds one of them
    found_score: tuple[float, float] = (0.99, 0.01)  # and its scores if it does, and if not

    def long(self, text: Column) -> Column:
        """The highest score of a text's pieces."""
        return F.array_max(self.many(self.cut(text)))


def keyword_score(lowered: Column, phrases: list[str]) -> Column:
    """0.99 when any phrase occurs in the lower-cased text, else 0.01."""
    found = F.contains(lowered, F.lit(phrases[0]))
    for p in phrases[1:]:
        found = found | F.contains(lowered, F.lit(p))
    return F.when(found, F.lit(0.99)).otherwise(F.lit(0.01))


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Overlapping chunks that cover the whole text."""
    last = F.greatest(F.char_length(text) - overlap, F.lit(1))
    return F.transform(F.sequence(F.lit(0), last - 1, F.lit(size - overlap)), lambda s: F.substring(text, s + 1, F.lit(size)))


def keyword_scorer(name: str, phrases: list[str], size: int = 2048, overlap: int = 64) -> Scorer:
    phrases = [p.lower() for p in phrases]

    def one(text: Column) -> Column:
        return let(F.lower(text), lambda low: keyword_score(low, phrases))

    # How a sigma is lower-cased depends on what follows it, so phrases with one are looked for in each text itself.
    plain = bool(phrases) and all(phrases) and not any(c in p for p in phrases for c in "σς")
    return Scorer(name, lambda texts: F.transform(texts, one), lambda text: chunks(text, size, overlap), phrases=tuple(phrases) if plain else ())


Model = Callable[[list[str]], list[float]]


def score_rows(model: Model, rows: list[list[str] | None], batch: int) -> list[list[float | None] | None]:
    """Scores of every row's texts, batched over all rows. If the model raises, each row is scored alone and only rows it
    raises on are null."""
    def scored(own: list[list[str]]) -> list[list[float | None]]:
        flat = [t for row in own for t in row if t is not None]
        found = iter([float(s) for i in range(0, len(flat), batch) for s in model(flat[i:i + batch])])
        return [[None if t is None else next(found) for t in row] for row in own]

    def alone(row: list[str]) -> list[float | None] | None:
        try:
            return scored([row])[0]
        except Exception:  # whatever a model raises, its item is decided without it
            return None

    whole = [list(row) for row in rows if row is not None]
    try:
        results = iter(scored(whole))
    except Exception:
        results = iter([alone(row) for row in whole])
    return [None if row is None else next(results) for row in rows]


def make_scorer(name: str, fn: Model | None = None, batch: int = 16, size: int = 2048, overlap: int = 64,
                load: Callable[[], Model] | None = None) -> Scorer:
    """A scorer around a Python model that scores lists of texts: ``fn`` itself, or what ``load`` returns once a task."""
    if (fn is None) == (load is None):
        raise ValueError("give a scorer either fn or load")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load() if load else fn
        for rows in batches:
            yield pd.Series(score_rows(model, list(rows), batch), dtype=object)

    return Scorer(name, scores, lambda text: chunks(text, size, overlap), native=False)


def assert_scorer(spark: SparkSession, scorer: Scorer, attack: str, benign: str) -> None:
    """Refuses a scorer that does not tell a known attack from ordinary text."""
    row = spark.createDataFrame([(attack, benign)], "a string, b string") \
        .select(scorer.many(F.array("a", "b")).alias("s")).head()
    if not (row.s[0] > 0.9 and row.s[1] < 0.1):
        raise ValueError(f"{scorer.name} failed its self-test: attack={row.s[0]:.3f} benign={row.s[1]:.3f}")
