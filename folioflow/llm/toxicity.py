"""Toxicity: a small convolutional text classifier in numpy.

A word's embedding is the sum of two hashed ones, of the whole word and of its first bytes, so that
unseen forms of a known stem still count. Filters of widths 1 to 3 run over the words, each filter's
largest response over the whole text is pooled, and a logistic layer on top gives the score.

Training takes all labelled rows, four bytes a word of each. Up to ``FIT_ROWS`` of them are one set, trained on by the driver. More are dealt to
shards by a hash of the id: in each of ``ROUNDS`` rounds a task takes the steps of every row of its shard, from the model that all shards begin with, and the
shards' parameters are averaged by their numbers of rows; the driver holds a few MB for each of at most ``SHARDS`` shards. Texts of any length are learned
from and scored whole; a gradient flows through the windows that win a filter only.
One row in ``HOLD`` is held back to calibrate: a logistic rescaling of the score, and one decision
threshold for each language, from counts of the held-back rows by steps of their score. The language chooses the threshold only; scores see nothing but words.

Null and empty texts get the score of a text without words; a null id stays null; repeated rows are
scored each on its own; an id that is labelled both ways is not learned from; without labelled rows every
score is the prior; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import copy
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import written
from ._text import alnum_words, column_bytes, fields, map_arrow, settle

WORD_BITS, STEM_BITS, STEM_BYTES = 15, 13, 4
DIM, FILTERS, WIDTHS = 16, 16, (1, 2, 3)
#: Labelled rows up to which the driver trains on all of them; of more, rows of a shard (more in each, where SHARDS are not enough), and rounds.
FIT_ROWS, SHARD_ROWS, SHARDS, ROUNDS = 8000, 16_000, 16, 3
#: Share of the labelled rows that is held back for calibration: one in so many.
HOLD = 5
#: Steps of a score's logarithmic odds in which held-back rows are counted.
ODDS = 64
BATCH = 32
#: Words in a slab when texts are scored.
SLAB = 1 << 16
#: Words whose codes a worker keeps.
MEMO_WORDS = 150_000
#: Decision threshold where a language has too few held-back rows.
DEFAULT_THRESHOLD = 0.3
PRIOR = 0.05
_PARTS = [(w, j) for w in WIDTHS for j in range(w)]


def word_codes(words: list[bytes], memo: dict[bytes, int]) -> np.ndarray:
    """Both hashes of each word in one number; 0 is kept for padding."""
    out = []
    for w in words:
        c = memo.get(w)
        if c is None:
            c = memo[w] = 1 + (zlib.crc32(w) & ((1 << WORD_BITS) - 1)) + ((zlib.crc32(w[:STEM_BYTES], 7) & ((1 << STEM_BITS) - 1)) << WORD_BITS)
        out.append(c)
    return np.array(out, np.uint32)


class Model:
    """Parameters and the forward and backward pass."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.p = {
            "word": r.normal(0, 0.1, (1 << WORD_BITS, DIM)).astype(np.float32),
            "stem": r.normal(0, 0.1, (1 << STEM_BITS, DIM)).astype(np.float32),
            "conv": r.normal(0, 0.25, (len(_PARTS), DIM, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS * len(WIDTHS), np.float32),
            "out": r.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32),
            "base": np.array([np.log(PRIOR / (1 - PRIOR))], np.float32),
        }
        self.scale, self.shift = 1.0, 0.0
        self.thresholds: dict[str, float] = {}

    def embed(self, codes: np.ndarray) -> np.ndarray:
        c = codes.astype(np.int64) - 1
        e = self.p["word"][c & ((1 << WORD_BITS) - 1)] + self.p["stem"][(c >> WORD_BITS) & ((1 << STEM_BITS) - 1)]
        e[codes == 0] = 0
        return e

    def responses(self, parts: np.ndarray) -> np.ndarray:
        """parts: for each position the products of its word with all filter rows; the last two positions only pad."""
        n = len(parts) - 2
        out = np.empty((n, FILTERS * len(WIDTHS)), np.float32)
        for k, w in enumerate(WIDTHS):
            first = _PARTS.index((w, 0))
            r = parts[:n, first].copy()
            for j in range(1, w):
                r += parts[j : n + j, first + j]
            out[:, k * FILTERS : (k + 1) * FILTERS] = r
        return out

    def parts(self, emb: np.ndarray) -> np.ndarray:
        flat = self.p["conv"].transpose(1, 0, 2).reshape(DIM, -1)
        return (emb @ flat).reshape(len(emb), len(_PARTS), FILTERS)

    def pooled(self, docs: list[np.ndarray]) -> np.ndarray:
        """Largest response of each filter over each whole text, slab by slab."""
        out = np.full((len(docs), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        stream = np.concatenate([x for d in docs for x in (d, np.zeros(2, np.uint32))] or [np.zeros(2, np.uint32)])
        of = np.repeat(np.arange(len(docs)), [len(d) + 2 for d in docs])
        for lo in range(0, len(stream), SLAB):
            codes, own = stream[lo : lo + SLAB + 2], of[lo : lo + SLAB]
            if len(codes) < len(own) + 2:
                codes = np.concatenate([codes, np.zeros(len(own) + 2 - len(codes), np.uint32)])
            kinds, at = np.unique(codes, return_inverse=True)
            r = self.responses(self.parts(self.embed(kinds))[at])
            keep = np.flatnonzero(codes[: len(own)])
            if len(keep):
                who = own[keep]
                starts = np.flatnonzero(np.diff(who, prepend=-1))
                who = who[starts]
                out[who] = np.maximum(out[who], np.maximum.reduceat(r[keep], starts))
        out[np.isneginf(out)] = 0
        return out

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        h = np.maximum(self.pooled(docs) + self.p["bias"], 0)
        return h @ self.p["out"] + self.p["base"][0]

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        z = self.logits(docs).astype(np.float64) * self.scale + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def winners(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest response over a whole text, and the first place of it; slab by slab, so of any length."""
        top, at = np.full(FILTERS * len(WIDTHS), -np.inf, np.float32), np.zeros(FILTERS * len(WIDTHS), np.int64)
        whole = np.concatenate([doc, np.zeros(2, np.uint32)])
        for lo in range(0, len(doc), SLAB):
            r = self.responses(self.parts(self.embed(whole[lo : lo + SLAB + 2])))
            here = r.argmax(0)
            value = r[here, np.arange(r.shape[1])]
            at, top = np.where(value > top, here + lo, at), np.maximum(top, value)
        return top, at

    def step(self, docs: list[np.ndarray], y: np.ndarray, state: dict, t: int, rate: float) -> None:
        """One step of Adam on a batch; the gradient flows through each filter's best position only."""
        p = self.p
        found = [self.winners(d) for d in docs]
        top, place = np.stack([x for x, _ in found]), np.stack([x for _, x in found])
        starts = np.cumsum([0] + [len(d) + 2 for d in docs])[:-1]
        best = place + starts[:, None]
        stream = np.concatenate([x for d in docs for x in (d, np.zeros(2, np.uint32))] + [np.zeros(2, np.uint32)])
        empty = np.isneginf(top)
        act = np.where(empty, 0, top) + p["bias"]
        h = np.maximum(act, 0)
        z = h @ p["out"] + p["base"][0]
        d = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - y).astype(np.float32) / len(docs)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"], g["base"] = h.T @ d, np.array([d.sum()], np.float32)
        dh = np.outer(d, p["out"]) * (act > 0)
        g["bias"] = dh.sum(0)
        dh = np.where(empty, 0, dh)
        codes = stream.astype(np.int64) - 1
        for k, w in enumerate(WIDTHS):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            where, dk = best[:, own], dh[:, own]
            for j in range(w):
                q = _PARTS.index((w, j))
                at = where + j
                e = self.embed(stream[at])
                g["conv"][q] += np.einsum("bf,bfd->df", dk, e)
                de = dk[:, :, None] * p["conv"][q].T[None]
                hit = (stream[at] != 0) & (dk != 0)
                c = codes[at[hit]]
                np.add.at(g["word"], c & ((1 << WORD_BITS) - 1), de[hit])
                np.add.at(g["stem"], (c >> WORD_BITS) & ((1 << STEM_BITS) - 1), de[hit])
        for k, v in p.items():
            m, s = state.setdefault(k, (np.zeros_like(v), np.zeros_like(v)))
            m *= 0.9
            m += 0.1 * g[k]
            s *= 0.999
            s += 0.001 * g[k] ** 2
            v -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-7)


def train(docs: list[np.ndarray], y: np.ndarray, langs: list[str], seed: int = 1, batch: int = BATCH, steps: int = 900) -> Model:
    """Fit on most rows, calibrate on one in HOLD; y holds 0 and 1."""
    model, r = Model(seed), np.random.default_rng(seed)
    y = np.asarray(y, np.float32)
    if not len(docs) or y.min() == y.max():
        model.p["out"][:] = 0
        return model
    order = r.permutation(len(docs))
    held, fit = order[::HOLD], np.setdiff1d(order, order[::HOLD])
    if not 0 < y[fit].sum() < len(fit):
        fit = order
    model.p["base"][0] = np.log((y[fit].mean() + 1e-3) / (1 - y[fit].mean() + 1e-3))
    state: dict = {}
    todo = np.empty(0, np.int64)
    for t in range(1, steps + 1):
        if len(todo) < batch:
            todo = np.concatenate([todo, r.permutation(fit)])
        now, todo = todo[:batch], todo[batch:]
        model.step([docs[k] for k in now], y[now], state, t, 0.01 if t < steps * 0.6 else 0.003)
    calibrate(model, [docs[k] for k in held], y[held], [langs[k] for k in held])
    return model


def calibrate(model: Model, docs: list[np.ndarray], y: np.ndarray, langs: list[str]) -> None:
    """Calibrates by held-back rows."""
    calibrate_by_odds(model, model.logits(docs).astype(np.float64), y, langs, np.ones(len(y)))


def calibrate_by_odds(model: Model, z: np.ndarray, y: np.ndarray, langs: list[str], n: np.ndarray, least: int = 30) -> None:
    """Damped logistic rescaling on held-back rows, then the best threshold by F1 of each language; n: how often each row counts."""
    a, b = 1.0, 0.0
    mean = lambda x: (n * x).sum() / n.sum()
    for _ in range(200):  # a prior keeps a near 1 where the rows are separated
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        a -= 0.02 * (mean((q - y) * z) + 0.1 * (a - 1))
        b -= 0.1 * (mean(q - y) + 0.05 * b)
    model.scale, model.shift = max(a, 0.2), b
    s = 1 / (1 + np.exp(-np.clip(model.scale * z + model.shift, -30, 30)))
    grid = sorted(np.round(np.arange(0.1, 0.91, 0.05), 2), key=lambda x: abs(x - DEFAULT_THRESHOLD))
    lang = np.array([x or "" for x in langs])
    for name in sorted(set(lang)):
        own = lang == name
        if n[own].sum() >= least and (n * y)[own].sum() >= 5:
            f1 = lambda c: 2 * ((n * y)[own] * (s[own] >= c)).sum() / max(1, (n[own] * (s[own] >= c)).sum() + (n * y)[own].sum())  # noqa: B023, E731
            model.thresholds[name] = float(max(grid, key=f1))


def train_shards(coded: DataFrame, rows: int, toxic: int, seed: int = 1) -> Model:
    """Fit on all rows (k, toxic, lang, codes) but those held back, shard by shard, and calibrate on these."""
    spark, model = coded.sparkSession, Model(seed)
    model.p["base"][0] = np.log((toxic / rows + 1e-3) / (1 - toxic / rows + 1e-3))
    held = F.pmod(F.xxhash64(F.lit("hold"), "k"), F.lit(HOLD)) == 0
    shards = min(SHARDS, -(-rows // SHARD_ROWS))
    dealt = coded.where(~held).select("k", "toxic", "codes").repartition(shards, "k").coalesce(shards).sortWithinPartitions("k", "codes")
    names = list(model.p)
    for turn in range(ROUNDS):
        sent, rate = spark.sparkContext.broadcast(model), 0.01 if turn < ROUNDS - 1 else 0.003

        def learn(batches, sent=sent, rate=rate):
            own, state, docs, y, n, t = copy.deepcopy(sent.value), {}, [], [], 0, 0

            def step():
                nonlocal t, n
                t, n = t + 1, n + len(docs)
                own.step(docs, np.array(y, np.float32), state, t, rate)
                docs.clear()
                y.clear()

            for batch in batches:
                for toxic, codes in zip(batch.column(1), batch.column(2), strict=True):
                    docs.append(np.frombuffer(codes.as_py(), np.uint32))
                    y.append(toxic.as_py())
                    if len(docs) == BATCH:
                        step()
            if docs:
                step()
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([np.concatenate([own.p[c].ravel() for c in names]).tobytes()])], names=["n", "p"])
            del own, state
            settle()

        learned = dealt.mapInArrow(learn, "n long, p binary").toArrow()  # a row for each shard
        n = np.array(learned["n"].to_pylist(), np.float64)
        mean = sum(np.frombuffer(p.as_py(), np.float32) * np.float32(w) for p, w in zip(learned["p"], n / n.sum(), strict=True))
        model, at = Model(seed), 0
        for c in names:
            size = model.p[c].size
            model.p[c] = mean[at : at + size].reshape(model.p[c].shape).astype(np.float32)
            at += size
        del learned, mean
    sent = spark.sparkContext.broadcast(model)

    def odds(batch: pa.RecordBatch):
        z = sent.value.logits([np.frombuffer(c, np.uint32) for c in batch.column(2).to_pylist()])
        return [batch.column(0), batch.column(1), pa.array(np.round(np.clip(z.astype(np.float64), -60, 60) * ODDS).astype(np.int64))]

    counted = map_arrow(coded.where(held).select("toxic", "lang", "codes"), odds, T.StructType([*fields(coded, ["toxic", "lang"]), T.StructField("z", T.LongType())]))
    counted = counted.groupBy("toxic", "lang", "z").count().orderBy("toxic", "lang", "z").toArrow()  # a row for each language and step
    if len(counted):
        calibrate_by_odds(model, counted["z"].to_numpy() / ODDS, counted["toxic"].to_numpy().astype(np.float64), counted["lang"].to_pylist(), counted["count"].to_numpy().astype(np.float64))
    settle()
    return model


def fit_model(docs: DataFrame, labels: DataFrame, fold=None, rows: int = FIT_ROWS) -> Model:
    """Train on all labelled documents, whole texts of any length; on the driver, if there are at most ``rows``. fold: a condition on doc_id that rows to learn from must meet."""
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("_toxic")).where("doc_id is not null and _toxic in (0, 1)")
    labels = labels.groupBy("doc_id").agg(F.min("_toxic").alias("_toxic"), F.max("_toxic").alias("_other")).where("_toxic = _other").drop("_other")
    if fold is not None:
        labels = labels.where(fold)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")
    # an id that stands for several texts gives the first of them, so no more texts than labels come out
    found = docs.select("doc_id", F.col("text").cast("string").alias("_text"), lang.alias("_lang")).join(labels, "doc_id")
    found = found.groupBy("doc_id", "_toxic").agg(F.min(F.struct("_text", "_lang")).alias("t")).select("doc_id", "_toxic", "t._text", "t._lang")
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("codes", T.BinaryType())])

    def codes(batch: pa.RecordBatch):
        memo: dict[bytes, int] = {}
        out = []
        for t in column_bytes(batch.column(3)):
            out.append(word_codes(alnum_words(t), memo).tobytes())
        return [batch.column(0), batch.column(1), batch.column(2), out]

    coded = written(map_arrow(found.select(F.xxhash64("doc_id").alias("k"), "_toxic", "_lang", "_text"), codes, schema), "labelled")
    sizes = coded.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    if sizes["n"] > rows and 0 < sizes["toxic"] < sizes["n"]:
        return train_shards(coded, sizes["n"], sizes["toxic"])
    if sizes["n"] > rows:
        coded = coded.limit(0)  # rows of one kind: every score is the prior
    table = coded.toArrow()
    table = table.sort_by([("k", "ascending"), ("codes", "ascending")])
    model = train([np.frombuffer(c, np.uint32) for c in table["codes"].to_pylist()], np.array(table["toxic"].to_pylist()), table["lang"].to_pylist())
    del table
    settle()
    return model


def score(df: DataFrame, model: Model, keys: list[str], text: str = "text", lang: str | None = None) -> DataFrame:
    """The key columns, ``score`` and, where a language column is named, ``toxic`` by that language's threshold.

    A language column that the table lacks counts as one of nulls, which have the default threshold."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the data
    schema = T.StructType([*fields(df, keys), T.StructField("score", T.DoubleType()), *([T.StructField("toxic", T.BooleanType())] if lang else [])])

    def run(batch: pa.RecordBatch):
        model, memo, out, held, size = sent.value, {}, [], [], 0
        for t in column_bytes(batch.column(len(keys))):
            held.append(word_codes(alnum_words(t), memo))
            size += len(held[-1])
            if size >= 1 << 18:
                out.append(model.scores(held))
                held, size = [], 0
                if len(memo) > MEMO_WORDS:
                    memo.clear()
        s = np.concatenate([*out, model.scores(held)] if held else out)
        cols = [*(batch.column(k) for k in range(len(keys))), pa.array(s)]
        if lang:
            limits = np.array([model.thresholds.get(x, DEFAULT_THRESHOLD) for x in batch.column(len(keys) + 1).to_pylist()])
            cols.append(pa.array(s >= limits))
        return cols

    extra = [(F.col(lang).cast("string") if lang in df.columns else F.lit(None).cast("string")).alias("_lang")] if lang else []
    return map_arrow(df.select(*keys, F.col(text).cast("string").alias("_text"), *extra), run, schema)
