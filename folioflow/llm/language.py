"""Language identification by words first, and by shorter and shorter character n-grams for words never seen.

Spark counts the words of all texts to learn from by language. Each language's ``WORDS`` most frequent ones are known words;
character n-grams are counted in the known words, as often as these stand, and the ``GRAMS`` most frequent of each length and language are kept.
So a model's size is bounded by these parameters and the number of languages, at most ``LANGUAGES``. A known word adds the logarithm of its smoothed frequency in every language. A word that no language knows
is scored by the mean of its longest known n-grams: of five letters, and if none is known, of four, and so on to single letters.

Words are runs of letters, lower-cased; a text that is null or has no letter is ``und`` with score 0. Rows without a language
are predicted but not learned from. Repeated rows count each for itself. Without anything to learn from, all is ``und``.
Equal scores go to the language that sorts first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ._store import work_dir, written
from ._text import fields, map_arrow, settle

#: Words that a language's model knows, and n-grams of each length that it knows.
WORDS, GRAMS = 30_000, 6_000
#: Languages of a model at most; one with more is refused, since its size wouldn't be bounded.
LANGUAGES = 200
#: Letters of an n-gram, the longest first.
SIZES = (5, 4, 3, 2, 1)
#: Distinct words of a task that are counted before they are sent.
HELD = 200_000

_WORD = regex.compile(r"\p{L}+")


def words(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return _WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """All runs of n characters of a word between two marks."""
    w = f"<{word}>"
    return [w[k : k + n] for k in range(len(w) - n + 1)] if n > 1 else list(word)


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n): words of the texts, counted in each task before they are sent."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        held: dict[tuple[str, str], int] = {}

        def out():
            keys = list(held)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(held.values()), pa.int64())], schema=arrow)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                own = lang.as_py()
                for w in words(text.as_py() or ""):
                    held[own, w] = held.get((own, w), 0) + 1
                if len(held) >= HELD:
                    yield from out()
        if held:
            yield from out()
        settle()

    rows = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(run, schema)
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """Logarithms of frequencies: one row of numbers, a column for each language, for each known word and n-gram."""

    def __init__(self, langs: list[str], places: dict[int, dict[str, int]], values: np.ndarray):
        """places: the rows of ``values`` of known words (at 0) and n-grams (at their lengths)."""
        self.langs, self.places = langs, places
        self.values = np.vstack([values, np.zeros((1, len(langs)))])  # the last row is for words without any known piece

    def pieces(self, word: str) -> list[int]:
        """The rows whose mean is what a word adds: its own, or those of its longest known n-grams."""
        if (at := self.places[0].get(word)) is not None:
            return [at]
        for n in SIZES:
            places = self.places[n]
            if found := [at for g in grams(word, n) if (at := places.get(g)) is not None]:
                return found
        return [len(self.values) - 1]

    def predict(self, texts: list[list[str]]) -> tuple[list[str], np.ndarray]:
        """The best language of each list of words, and its share of the probability of all, by the mean word."""
        sizes = np.array([len(t) for t in texts], np.int64)
        if not self.langs or not sizes.sum():
            return ["und"] * len(texts), np.zeros(len(texts))
        found = pa.array([w for t in texts for w in t], pa.string()).dictionary_encode()
        used = [self.pieces(w) for w in found.dictionary.to_pylist()]
        n = np.array([len(p) for p in used], np.int64)
        rows = np.add.reduceat(self.values[np.array([at for p in used for at in p])], np.cumsum(n) - n, axis=0) / n[:, None]
        doc, values = np.repeat(np.arange(len(texts)), sizes), rows[found.indices.to_numpy()]
        sums = np.stack([np.bincount(doc, values[:, k], len(texts)) for k in range(len(self.langs))], axis=1)
        best = sums.argmax(axis=1)
        mean = (sums - sums.max(axis=1)[:, None]) / np.maximum(sizes, 1)[:, None]
        return [self.langs[b] if s else "und" for b, s in zip(best, sizes, strict=True)], np.where(sizes > 0, 1 / np.exp(mean).sum(axis=1), 0.0)


def fit(docs: DataFrame, n_words: int = WORDS, n_grams: int = GRAMS) -> Model:
    """A model of the rows with a language; ``docs`` needs text and lang."""
    path = work_dir(docs.sparkSession, "language")
    counts = written(_counts(docs.select(F.col("lang").cast("string").alias("lang"), "text")), f"{path}/words")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    known = counts.withColumn("k", rank).where(F.col("k") <= n_words).select("word").distinct()
    kept = written(counts.join(known, "word").select("lang", F.lit(0).alias("size"), F.col("word").alias("x"), "n"), f"{path}/known")
    marked = F.concat(F.lit("<"), F.col("x"), F.lit(">"))
    cut = lambda n, text: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.struct(F.lit(n).alias("size"), F.substring(text, i, F.lit(n)).alias("x"))))
    parts = F.flatten(F.filter(F.array(*(cut(n, marked if n > 1 else F.col("x")) for n in SIZES)), lambda p: p.isNotNull()))
    pieces = kept.select("lang", "n", F.explode(parts).alias("p")).groupBy("lang", "p.size", "p.x").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang", "size").orderBy(F.col("n").desc(), "x"))
    best = pieces.withColumn("k", rank).where(F.col("k") <= n_grams).select("size", "x").distinct()
    whole = counts.select("lang", F.lit(0).alias("size"), "n").unionByName(pieces.select("lang", "size", "n"))
    sums = {(r["lang"], r["size"]): (r["n"], r["v"]) for r in whole.groupBy("lang", "size").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    # bounded by the number of languages and the two parameters
    rows = kept.unionByName(pieces.join(best, ["size", "x"])).select("size", "x", "lang", "n").toArrow()
    places, sizes = {n: {} for n in (0, *SIZES)}, []
    row = np.empty(rows.num_rows, np.int64)
    for k, (size, x) in enumerate(zip(rows["size"].to_pylist(), rows["x"].to_pylist(), strict=True)):
        row[k] = places[size].setdefault(x, len(sizes))
        if row[k] == len(sizes):
            sizes.append(size)
    values = np.zeros((len(sizes), len(langs)))
    values[row, np.searchsorted(np.array(langs, object), np.array(rows["lang"].to_pylist(), object)) if langs else row] = rows["n"].to_numpy()
    total = np.array([[sums.get((lang, size), (0, 0)) for lang in langs] for size in sizes], float).reshape(len(sizes), len(langs), 2)
    return Model(langs, places, np.log((values + 0.5) / (total[:, :, 0] + 0.5 * (total[:, :, 1] + 1))))


def predict(docs: DataFrame, model: Model, keys: list[str], text: str = "text") -> DataFrame:
    """keys, lang_pred and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the model's parameters
    schema = T.StructType([*fields(docs, keys), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batch: pa.RecordBatch):
        names, scores = sent.value.predict([words(t.as_py() or "") for t in batch.column(len(keys))])
        return [*(batch.column(k) for k in range(len(keys))), pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return map_arrow(docs.select(*keys, text), run, schema)


def held_out(key: Column, folds: int, remainder: int) -> Column:
    """Whether the crc32 of an id as text leaves this remainder; a null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == remainder
