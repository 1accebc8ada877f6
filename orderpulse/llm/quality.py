"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The bigram model is trained on every trusted document (but for the held-out
fold that sets the thresholds), so what it gathers grows with the corpus.
Words are lower-cased, stripped of trailing stops and commas and hashed into a
vocabulary of ``VOCAB`` ids; a word that repeats its predecessor becomes an id
for its place in the run, so that runs of one word are as unlikely as they
are in trusted text.

Counts are joined shard by shard:

1. ``blocks``: each batch of documents becomes one row with its compressed
   word ids, written once in buckets; neither texts nor words are shuffled.
2. ``counts``: blocks send the distinct bigrams of their trusted documents to
   shards, ranges of a mixed 40-bit bigram key, one for every ``SHARD_WORDS``
   words of the corpus. A frequent bigram arrives once a block, so no key is
   hot. A shard sums its bigrams and adds up, for
   every word, what Kneser-Ney needs of it as a context and as a successor.
   Those per-word sums have ``VOCAB`` cells however large the corpus is; they
   are merged by Spark and broadcast.
3. ``scores``: blocks ask each shard for the counts of their distinct
   bigrams of known words; the answers (small numbers, well compressed) meet the block again
   and give the log probability of every document.

A document is rejected when its perplexity, shrunk towards the median of its
language as if by ``PRIOR_WORDS`` words, lies above a fence made of that
language's quantiles over held-out trusted documents.

Defined results: texts without a word (null, empty) have no perplexity and
are rejected. A null language is a language of its own; a language with fewer
than ``MIN_HELD_OUT`` held-out documents uses the quantiles of all. With no
trusted text nothing is rejected but texts without a word. Documents are
trusted when all their labels say so; repeated rows are scored (and, if
trusted, counted) as often as they occur. Rows with a null id are scored,
never trusted. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import isolate, materialize, materialize_bucketed, restore, shuffle_partitions, spread

BITS = 20
VOCAB = 1 << BITS
#: ids below this one are the document start (0) and places in a run of one word
FIRST_WORD, MAX_RUN = 16, 9
BLOCK_CHARS = 16_000_000
#: words of the corpus for each shard of bigrams: what a shard holds, and what all blocks ask it, is at most that many
SHARD_WORDS = 8_000_000
#: one trusted document in so many is held out for the thresholds
HELD_OUT = 5
PRIOR_WORDS = 32
UPPER, MIDDLE, MARGIN = 0.99, 0.5, 0.5
MIN_HELD_OUT = 20
#: languages whose quantiles are broadcast; more are joined by a shuffle
MAX_BROADCAST_LANGS = 10_000
PARTS = 64  # of the per-word sums
_MASK = np.uint64((1 << 2 * BITS) - 1)
_HALF = np.uint64(BITS)
_ODD = 0x9E3779B97F4A7C15 & ((1 << 2 * BITS) - 1) | 1
_BACK = pow(_ODD, -1, 1 << 2 * BITS)


def mix(key: np.ndarray) -> np.ndarray:
    """A permutation of 40-bit keys that spreads frequent words over all ranges."""
    with np.errstate(over="ignore"):
        key = key * np.uint64(_ODD) & _MASK
        return (key ^ key >> _HALF) * np.uint64(_ODD) & _MASK


def unmix(key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = key * np.uint64(_BACK) & _MASK
        return (key ^ key >> _HALF) * np.uint64(_BACK) & _MASK


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes; the first byte is the width."""
    most = int(values.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1).astype(np.uint64)


def squeeze_keys(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unsqueeze_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data), dtype=np.uint64)


def word_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of all texts, and how many each text has."""
    lists = [(t or "").lower().split() for t in texts]
    lengths = np.array([len(x) for x in lists], dtype=np.int64)
    if not lengths.sum():
        return np.zeros(0, np.uint32), lengths
    codes, distinct = pd.factorize(np.array([w for x in lists for w in x], dtype=object))
    raw = np.array([zlib.crc32((w.rstrip(".,") or w).encode("utf-8", "surrogatepass")) for w in distinct], dtype=np.uint64)
    with np.errstate(over="ignore"):
        raw = (raw * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
    ids = (raw % np.uint64(VOCAB - FIRST_WORD) + np.uint64(FIRST_WORD)).astype(np.uint32)[codes]
    # place in a run of equal words inside a text
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = ids[1:] != ids[:-1]
    fresh[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    place = np.arange(len(ids)) - np.maximum.accumulate(np.where(fresh, np.arange(len(ids)), 0))
    return np.where(place > 0, np.minimum(place, MAX_RUN), ids).astype(np.uint32), lengths


def to_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, n = TaskContext.get().partitionId(), 0

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        nonlocal n
        n += 1
        ids, lengths = word_ids(list(rows["text"]))
        vocab, codes, counts = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # frequent words get small codes
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        return pd.DataFrame({"block": [f"{part}-{n}"], "n_words": [len(ids)], "ids": [list(rows["id"])], "langs": [list(rows["lang"])],
                             "lengths": [squeeze(lengths)], "vocab": [squeeze(vocab[order])],
                             "codes": [squeeze(rank[codes] if len(codes) else codes)]})

    for batch in batches:
        begin, size = 0, 0
        for i, text in enumerate(batch["text"]):
            size += len(text or "")
            if size >= BLOCK_CHARS:
                yield block(batch.iloc[begin:i + 1])
                begin, size = i + 1, 0
        if begin < len(batch):
            yield block(batch.iloc[begin:])


BLOCKS = "block string, n_words long, ids array<string>, langs array<string>, lengths binary, vocab binary, codes binary"


def bigrams(lengths: bytes, vocab: bytes, codes: bytes, keep: np.ndarray | None = None):
    """(document of each bigram, first word, second word); ``keep`` selects documents."""
    n = unsqueeze(lengths).astype(np.int64)
    ids = unsqueeze(vocab)[unsqueeze(codes).astype(np.int64)]
    doc = np.repeat(np.arange(len(n)), n)
    before = np.concatenate([[np.uint64(0)], ids[:-1]]) if len(ids) else ids
    before[(np.cumsum(n) - n)[n > 0]] = 0  # every document starts after id 0
    if keep is not None:
        chosen = keep[doc]
        doc, before, ids = doc[chosen], before[chosen], ids[chosen]
    return doc, before, ids


def keys_of(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mix(before << _HALF | ids)


def shard_edges(shards: int) -> np.ndarray:
    return np.array([(s << 2 * BITS) // shards for s in range(1, shards)], dtype=np.uint64)


def send_counts(batches: Iterator[pd.DataFrame], shards: int) -> Iterator[pd.DataFrame]:
    """Distinct bigrams of the trusted documents of each block, by shard."""
    for batch in batches:
        for row in batch.itertuples():
            trusted = set(row.trusted) if row.trusted is not None else set()
            keep = np.array([i in trusted for i in row.ids], dtype=bool)
            if not keep.any():
                continue
            _, before, ids = bigrams(row.lengths, row.vocab, row.codes, keep)
            keys, counts = np.unique(keys_of(before, ids), return_counts=True)
            cuts = np.searchsorted(keys, shard_edges(shards))
            yield pd.DataFrame([(s, squeeze_keys(k), squeeze(c)) for s, (k, c) in enumerate(
                zip(np.split(keys, cuts), np.split(counts, cuts), strict=True)) if len(k)],
                columns=["shard", "keys", "counts"])


def sum_counts(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard: its summed bigrams, and per-word sums in PARTS rows."""
    keys = np.concatenate([unsqueeze_keys(k) for k in rows["keys"]])
    counts = np.concatenate([unsqueeze(c) for c in rows["counts"]])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys, counts = keys[first], np.add.reduceat(counts, first)
    shard = int(rows["shard"].iloc[0])
    of_counts = [int((counts == i).sum()) for i in (1, 2, 3, 4)]
    out = [(shard, -1, squeeze_keys(keys), squeeze(counts), of_counts)]
    pair = unmix(keys)
    one, two = (pair >> _HALF).astype(np.int64), (pair & np.uint64(VOCAB - 1)).astype(np.int64)
    kind = np.minimum(counts, 3).astype(np.int64)
    for sums, words in (((np.bincount(one, counts, VOCAB), *(np.bincount(one[kind == i], minlength=VOCAB) for i in (1, 2, 3)),
                          np.bincount(two, minlength=VOCAB)), np.union1d(one, two)),):
        part = words * PARTS // VOCAB
        for p in np.unique(part):
            mine = words[part == p]
            out.append((shard, int(p), squeeze_keys(mine.astype(np.uint64)),
                        squeeze(np.concatenate([s[mine].astype(np.uint64) for s in sums])), []))
    return pd.DataFrame(out, columns=["shard", "part", "keys", "counts", "of_counts"])


COUNTS = "shard int, part int, keys binary, counts binary, of_counts array<long>"


def sum_words(rows: pd.DataFrame) -> pd.DataFrame:
    """Merge per-word sums of one range of words over all shards."""
    total = np.zeros((5, VOCAB // PARTS), dtype=np.uint64)
    base = int(rows["part"].iloc[0]) * (VOCAB // PARTS)
    for keys, counts in zip(rows["keys"], rows["counts"], strict=True):
        total[:, unsqueeze_keys(keys).astype(np.int64) - base] += unsqueeze(counts).reshape(5, -1)
    return pd.DataFrame({"part": [base * PARTS // VOCAB], "sums": [squeeze(total.reshape(-1))]})


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
    return np.array([0.0, *(min(max(d, 0.05), i) for i, d in enumerate(raw, 1))])


class Model:
    """Per-word arrays of the model; bigram counts stay in their shards."""

    def __init__(self, sums: np.ndarray, of_counts: list[int]):
        context, k1, k2, k3, follows = sums.astype(float)
        self.discount = discounts(of_counts)
        d = self.discount
        self.context = np.maximum(context, 1.0)
        self.spare = np.where(context > 0, (d[1] * k1 + d[2] * k2 + d[3] * k3) / self.context, 1.0)
        kind = np.minimum(follows, 3).astype(int)
        low = discounts([int((follows == i).sum()) for i in (1, 2, 3, 4)])
        total = max(follows.sum(), 1.0)
        mass = low[kind].sum() / total if follows.any() else 1.0
        self.follows = np.maximum(follows - low[kind], 0.0) / total + mass / VOCAB
        self.opens, self.ends = context > 0, follows > 0

    def known(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Where a count may be above zero: both words occur in their places."""
        return self.opens[before.astype(np.int64)] & self.ends[ids.astype(np.int64)]

    def bits(self, before: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        before, ids = before.astype(np.int64), ids.astype(np.int64)
        own = np.maximum(counts - self.discount[np.minimum(counts, 3)], 0.0) / self.context[before]
        return -np.log2(own + self.spare[before] * self.follows[ids])


def ask(batches: Iterator[pd.DataFrame], shards: int, model: Model) -> Iterator[pd.DataFrame]:
    """Distinct bigrams of known words of all documents of each block, by shard."""
    for batch in batches:
        for row in batch.itertuples():
            _, before, ids = bigrams(row.lengths, row.vocab, row.codes)
            may = model.known(before, ids)
            keys = np.unique(keys_of(before[may], ids[may]))
            cuts = np.searchsorted(keys, shard_edges(shards))
            yield pd.DataFrame([(s, row.block, squeeze_keys(k)) for s, k in enumerate(np.split(keys, cuts)) if len(k)],
                               columns=["shard", "block", "keys"])


def answer(counted: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The counts of the bigrams that blocks ask a shard for."""
    if len(counted):
        known = unsqueeze_keys(counted["keys"].iloc[0])
        counts = unsqueeze(counted["counts"].iloc[0])
    else:
        known, counts = np.zeros(1, np.uint64), np.zeros(1, np.uint64)
    out = []
    for row in asked.itertuples():
        keys = unsqueeze_keys(row.keys)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        out.append((row.block, row.shard, squeeze(np.where(known[at] == keys, counts[at], np.uint64(0)))))
    return pd.DataFrame(out, columns=["block", "shard", "counts"])


def _blocks(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, Callable[[], None]]:
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"),
                       F.col(lang_col).cast("string").alias("lang"))
    return materialize_bucketed(rows.mapInPandas(to_blocks, BLOCKS), "blocks", "block")


def count_shards(blocks: DataFrame) -> int:
    """Shards of bigrams: at least one a task, and as many as the corpus needs
    for the largest group to be bounded whatever its size."""
    words = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    return max(shuffle_partitions(blocks.sparkSession), -(-words // SHARD_WORDS))


def _trusted(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(tid, held): trusted ids and whether they are held out."""
    good = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("tid")).agg(
        F.min(label_col).alias("q")).where("q = 1")
    return good.select("tid", (F.pmod(F.xxhash64("tid"), F.lit(HELD_OUT)) == 0).alias("held"))


def train(blocks: DataFrame, trusted: DataFrame, shards: int) -> tuple[DataFrame, Model]:
    """Bigram counts by shard, and the per-word arrays."""
    members = blocks.select("block", F.explode("ids").alias("id"))
    chosen = members.join(trusted.where("not held"), F.col("id") == F.col("tid")).groupBy("block").agg(
        F.collect_set("id").alias("trusted"))
    flagged = blocks.join(chosen, "block").select("ids", "lengths", "vocab", "codes", "trusted")
    sent = flagged.mapInPandas(lambda b: send_counts(b, shards), "shard int, keys binary, counts binary")
    counts = materialize(sent.groupBy("shard").applyInPandas(sum_counts, COUNTS), "counts")
    merged = counts.where("part >= 0").groupBy("part").applyInPandas(sum_words, "part int, sums binary").collect()
    sums = np.zeros((5, VOCAB), dtype=np.uint64)  # PARTS rows, VOCAB cells in all
    for row in merged:
        width = VOCAB // PARTS
        sums[:, row["part"] * width:(row["part"] + 1) * width] = unsqueeze(bytes(row["sums"])).reshape(5, -1)
    n = counts.where("part < 0").agg(*[F.coalesce(F.sum(F.get("of_counts", F.lit(i))), F.lit(0)).alias(f"n{i}")
                                       for i in range(4)]).first()
    return counts.where("part < 0").select("shard", "keys", "counts"), Model(sums, list(n))


def score(blocks: DataFrame, counts: DataFrame, model: Model, shards: int) -> DataFrame:
    """(id, lang, n_words, bits): total bits of every document."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)  # VOCAB cells
    asked = blocks.select("block", "lengths", "vocab", "codes").mapInPandas(
        lambda b: ask(b, shards, shared.value), "shard int, block string, keys binary")
    answers = counts.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(
        answer, "block string, shard int, counts binary")

    def total(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        row = own.iloc[0]
        n = unsqueeze(row["lengths"]).astype(np.int64)
        doc, before, ids = bigrams(row["lengths"], row["vocab"], row["codes"])
        may = shared.value.known(before, ids)
        place = np.unique(keys_of(before[may], ids[may]), return_inverse=True)[1]
        parts = [unsqueeze(c) for _, c in sorted(zip(found["shard"], found["counts"], strict=True), key=lambda x: x[0])]
        counts = np.zeros(len(ids), dtype=np.int64)
        if parts:
            counts[may] = np.concatenate(parts).astype(np.int64)[place]
        bits = shared.value.bits(before, ids, counts) if len(ids) else np.zeros(0)
        return pd.DataFrame({"id": row["ids"], "lang": row["langs"], "n_words": n,
                             "bits": np.bincount(doc, bits, len(n)) if len(n) else np.zeros(0)})

    return blocks.select("block", "ids", "langs", "lengths", "vocab", "codes").groupBy("block").cogroup(
        answers.groupBy("block")).applyInPandas(total, "id string, lang string, n_words long, bits double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             label_col: str = "quality") -> DataFrame:
    """(id_col, lang, n_words, perplexity, threshold, keep): one row per row of
    ``docs``; ``threshold`` bounds the shrunk perplexity."""
    blocks, drop_blocks = _blocks(docs, id_col, text_col, lang_col)
    shards = count_shards(blocks)
    trusted = materialize(_trusted(labels, id_col, label_col), "trusted")
    counts, model = train(blocks, trusted, shards)
    scores = materialize(score(blocks, counts, model, shards), "scores")
    drop_blocks()

    rate = F.when(F.col("n_words") > 0, F.col("bits") / F.col("n_words"))
    rated = scores.withColumn("rate", rate).withColumn("g", F.coalesce("lang", F.lit("")))
    held = rated.where("rate is not null").join(trusted.where("held"), F.col("id") == F.col("tid")).select(
        "g", "rate", "n_words")

    def with_quantiles(frame: DataFrame, column: str, names: list[str], at: list[float]) -> DataFrame:
        """``frame`` with quantiles of ``column`` over the held-out rows of
        its language, or of all when the language has too few."""
        base = with_middle if column == "shrunk" else held
        quantiles = F.percentile_approx(column, at, 10000).alias("q")
        overall = base.agg(quantiles).first()["q"] or [None] * len(at)
        own = base.groupBy("g").agg(quantiles, F.count(F.lit(1)).alias("n")).where(
            F.col("n") >= MIN_HELD_OUT).select(F.col("g").alias("_g"), "q")
        rows = own.limit(MAX_BROADCAST_LANGS + 1).collect()
        few = len(rows) <= MAX_BROADCAST_LANGS
        small = F.broadcast(frame.sparkSession.createDataFrame(rows, own.schema)) if few else spread(own)
        joined = frame.join(small, F.col("g") == F.col("_g"), "left")
        return joined.withColumns({n: F.coalesce(F.get("q", F.lit(i)), F.lit(v).cast("double"))
                                   for i, (n, v) in enumerate(zip(names, overall, strict=True))}).drop("_g", "q")

    shrink = (F.col("rate") * F.col("n_words") + PRIOR_WORDS * F.col("mid")) / (F.col("n_words") + PRIOR_WORDS)
    with_middle = with_quantiles(held, "rate", ["mid"], [MIDDLE]).withColumn("shrunk", shrink)
    judged = with_quantiles(rated, "rate", ["mid"], [MIDDLE]).withColumn("shrunk", shrink)
    judged = with_quantiles(judged, "shrunk", ["centre", "upper"], [MIDDLE, UPPER]).withColumn(
        "limit", F.col("upper") + MARGIN * (F.col("upper") - F.col("centre")))
    id_type = docs.schema[id_col].dataType
    return judged.select(
        F.col("id").cast(id_type).alias(id_col), "lang", "n_words", F.pow(F.lit(2.0), "rate").alias("perplexity"),
        F.pow(F.lit(2.0), "limit").alias("threshold"),
        ((F.col("n_words") > 0) & (F.col("limit").isNull() | (F.col("shrunk") <= F.col("limit")))).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rejected documents. Of rows that repeat an id all
    stay if one is kept; rows with a null id stay."""
    judged = classify(docs, labels, id_col, **options).where(F.col(id_col).isNotNull())
    gone = judged.groupBy(F.col(id_col).alias("gone")).agg(F.max("keep").alias("kept")).where("not kept").select("gone")
    roles = {"id": id_col}
    return restore(isolate(docs, **roles).join(gone, F.col("id") == F.col("gone"), "left_anti"), docs, roles)
