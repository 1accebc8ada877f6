"""Language identification: multinomial naive Bayes over hashed letter n-grams.

Training counts are exact sums over every training row: each task adds up
dense per-language arrays and emits (language, feature, count) rows, which
Spark sums. The fitted log-probability matrix has ``languages x BUCKETS``
cells, whatever the number of rows, and is broadcast in blocks of at most
``BLOCK_LANGS`` languages, one after the other. A block keeps of each document
its best language, that score and the sum of all posterior weights against it;
the next block merges its own. So the number of features is the same for any
number of languages, and neither the driver nor a task holds more than one
block. Scoring is one pass over the documents a block, in numpy.

A text is lower-cased; each letter gives a trigram (left, letter, right) and
a bigram (letter, right), where any other character counts as a blank. No
feature spans two words, so batches do not change a result, and fixed-point
log probabilities make sums exact in any order.

Defined results: a null text, or one without a letter, is ``und`` with score
0; so is every text when nothing could be learned. Ties go to the language
that sorts first. Rows with a null language or an empty text teach nothing
but the prior (null language: nothing at all). Very long texts are scored in
slices of ``CHUNK`` characters. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.llm.common import isolate, materialize, restore

BUCKETS = 1 << 16
#: languages whose weights are on the driver and broadcast at a time
BLOCK_LANGS = 256
ALPHA = 0.5
#: characters in memory at a time
CHUNK = 1 << 20
#: fixed-point unit of a log probability
UNIT = 1 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """True for the code points that are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _slices(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each part, parts joined by blanks) with about CHUNK characters."""
    rows: list[int] = []
    parts: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        text = (text or "").lower()
        for begin in range(0, len(text), CHUNK):
            part = text[begin:begin + CHUNK]
            rows.append(i)
            parts.append(part)
            size += len(part)
            if size >= CHUNK:
                yield np.array(rows), parts
                rows, parts, size = [], [], 0
    if parts:
        yield np.array(rows), parts


def _features(parts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram bucket, bigram bucket) of each letter, and where each part's letters begin."""
    joined = " " + " ".join(parts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    points = np.where(letter, points, np.uint32(32))
    at = np.flatnonzero(letter)
    starts = 1 + np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    begins = np.searchsorted(at, starts)
    with np.errstate(over="ignore"):
        left, mid, right = points[at - 1], points[at], points[at + 1]
        pair = mid * np.uint32(0x9E3779B1) ^ right * np.uint32(0x85EBCA77)
        triple = (pair ^ (left + np.uint32(1)) * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        pair = (pair ^ pair >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    return triple >> shift, pair >> shift, begins


def _counts(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}

    def rows() -> Iterator[pd.DataFrame]:
        for lang, counts in sums.items():
            used = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "feature": np.append(used, -1),
                                "n": np.append(counts[used], docs[lang])})
        sums.clear()
        docs.clear()

    for batch in batches:
        for lang, group in batch.groupby("lang", sort=False):
            if lang not in sums and len(sums) >= 64:  # keeps memory bounded; Spark adds the parts up
                yield from rows()
            total = sums.setdefault(lang, np.zeros(buckets, dtype=np.int64))
            docs[lang] = docs.get(lang, 0) + len(group)
            for _, parts in _slices(list(group["text"])):
                triple, pair, _ = _features(parts, buckets)
                total += np.bincount(triple, minlength=buckets) + np.bincount(pair, minlength=buckets)
    yield from rows()


class Model:
    """A block of languages in sorted order, fixed-point log probabilities and priors."""

    def __init__(self, langs: list[str], weights: np.ndarray, priors: np.ndarray, buckets: int):
        self.langs, self.weights, self.priors, self.buckets = langs, weights, priors, buckets

    def best(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: place of the best language, its fixed-point log score,
        the sum of all languages' weights against it, and the letters."""
        total = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        letters = np.zeros(len(texts), dtype=np.int64)
        for rows, parts in _slices(texts):
            triple, pair, begins = _features(parts, self.buckets)
            np.add.at(letters, rows, np.diff(begins))
            for k, weights in enumerate(self.weights):
                run = np.concatenate([[0], np.cumsum(weights[triple] + weights[pair], dtype=np.int64)])
                np.add.at(total[:, k], rows, np.diff(run[begins]))
        total += self.priors
        top = total.max(axis=1)
        return total.argmax(axis=1), top, np.exp((total - top[:, None]) / UNIT).sum(axis=1), letters

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best, _, rest, letters = self.best(texts)
        known = letters > 0
        langs = [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return langs, np.where(known, 1.0 / rest, 0.0)


class Languages:
    """The fitted counts, which stay in Spark: (block, lang, feature, n). A
    block's model is put together when it is needed."""

    def __init__(self, counts: DataFrame, blocks: int, documents: int, buckets: int):
        self.counts, self.blocks, self.documents, self.buckets = counts, blocks, documents, buckets

    def model(self, block: int) -> Model:
        # at most BLOCK_LANGS x (buckets + 1) rows
        found = self.counts.where(F.col("block") == block).select("lang", "feature", "n").toArrow().to_pandas()
        langs = sorted(found["lang"].unique())
        counts = np.zeros((len(langs), self.buckets), dtype=np.float64)
        docs = np.ones(len(langs))
        place = {lang: k for k, lang in enumerate(langs)}
        own = found["lang"].map(place).to_numpy(dtype=np.int64) if len(found) else np.zeros(0, np.int64)
        feature, n = found["feature"].to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=np.int64)
        is_doc = feature < 0
        docs[own[is_doc]] = n[is_doc]
        counts[own[~is_doc], feature[~is_doc]] = n[~is_doc]
        logs = np.log((counts + ALPHA) / (counts.sum(axis=1, keepdims=True) + ALPHA * self.buckets))
        priors = np.log(docs / max(self.documents, 1))
        return Model(langs, np.rint(logs * UNIT).astype(np.int64 if UNIT > 1 << 26 else np.int32),
                     np.rint(priors * UNIT).astype(np.int64), self.buckets)

    @property
    def weights(self) -> np.ndarray:
        """Of the first block."""
        return self.model(0).weights

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores of a few texts outside Spark, with at most one block."""
        if self.blocks > 1:
            raise ValueError("more languages than one block holds: use predict")
        return self.model(0).score(texts)

    @property
    def langs(self) -> list[str]:
        """Every language, in order."""
        return sorted(r["lang"] for r in self.counts.where("feature = -1").select("lang").collect())


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS) -> Languages:
    """Learn from every row of ``train`` with a language."""
    rows = train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where(
        "lang is not null")
    summed = materialize(rows.mapInPandas(lambda b: _counts(b, buckets), "lang string, feature int, n long")
                         .groupBy("lang", "feature").agg(F.sum("n").alias("n")), "languages")
    known = summed.where("feature = -1").select(F.col("lang").alias("own"), "n")
    sums = known.agg(F.count(F.lit(1)).alias("langs"), F.coalesce(F.sum("n"), F.lit(0)).alias("documents")).first()
    blocks = -(-sums["langs"] // BLOCK_LANGS)
    if blocks <= 1:
        return Languages(summed.withColumn("block", F.lit(0)), blocks, sums["documents"], buckets)
    # one row a language: dealt into blocks in order
    place = F.floor((F.row_number().over(Window.orderBy("own")) - 1) / BLOCK_LANGS).cast("int")
    dealt = known.select("own", place.alias("block"))
    counts = materialize(summed.join(dealt, F.col("lang") == F.col("own")).drop("own"), "language-blocks")
    return Languages(counts, blocks, sums["documents"], buckets)


#: best language so far, its score, the sum of weights against it, letters of the text
SO_FAR = "struct<lang:string,top:bigint,rest:double,letters:bigint>"


def _merging(part: Broadcast):
    """A function of texts and what earlier blocks found, for one more block."""
    @F.pandas_udf(SO_FAR)
    def merge(texts: pd.Series, so_far: pd.DataFrame) -> pd.DataFrame:
        best, top, rest, letters = part.value.best(list(texts))
        fresh = so_far["lang"].isna().to_numpy()
        before = so_far["top"].fillna(0).to_numpy(dtype=np.int64)
        # blocks are in order of their languages, so a tie stays with the earlier one
        wins = fresh | (top > before)
        highest = np.where(wins, top, before)
        old = np.where(fresh, 0.0, so_far["rest"].fillna(0).to_numpy(dtype=float) * np.exp((before - highest) / UNIT))
        names = np.array(part.value.langs, dtype=object)[best]
        return pd.DataFrame({"lang": np.where(wins, names, so_far["lang"].to_numpy()), "top": highest,
                             "rest": old + rest * np.exp((top - highest) / UNIT), "letters": letters})
    return merge


def predict(docs: DataFrame, model: Model | Languages, text_col: str = "text", lang_out: str = "lang_pred",
            score_out: str = "score") -> DataFrame:
    """``docs`` without its text, with the predicted language and its posterior probability."""
    spark = docs.sparkSession
    roles = {"text": text_col}
    rows = isolate(docs, **roles)
    blocks = 1 if isinstance(model, Model) else model.blocks
    if blocks <= 1:
        shared = spark.sparkContext.broadcast(model if isinstance(model, Model) else model.model(0))

        @F.pandas_udf("lang string, score double")
        def judge(texts: pd.Series) -> pd.DataFrame:
            langs, scores = shared.value.score(list(texts))
            return pd.DataFrame({"lang": langs, "score": scores})

        done = rows.withColumn("found", judge("text"))
    else:
        done = materialize(rows.withColumn("so_far", F.lit(None).cast(SO_FAR)), "language-scores")
        for block in range(blocks):
            part = spark.sparkContext.broadcast(model.model(block))
            done = materialize(done.withColumn("so_far", _merging(part)("text", "so_far")), "language-scores")
        known = F.col("so_far.letters") > 0
        done = done.withColumn("found", F.struct(
            F.when(known, F.col("so_far.lang")).otherwise(UNKNOWN).alias("lang"),
            F.when(known, 1 / F.col("so_far.rest")).otherwise(0.0).alias("score")))
    return restore(done, docs, roles, drop=(text_col,),
                   **{lang_out: F.col("found.lang"), score_out: F.col("found.score")})


