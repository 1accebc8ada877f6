"""Packing documents into fixed-length token sequences.

Documents are tokenised where they lie, cut into pieces, and only the pieces'
lengths take part in the planning: shortest-pack-first histogram packing
places the lengths longest first, each into the open pattern with the most
room, and keeps counts of patterns instead of sequences. The plan is as large
as the length histogram (at most ``max_len`` lengths), whatever the corpus.
Pieces then find their sequence by their rank among the pieces of equal length.

With an order column the sequences follow that order: pieces of equal length
are ranked by it, every pattern takes its pieces evenly from the whole order
(its k-th of c sequences, from 0, those about (k + u) / c of the way through
each length, with u between 0 and 1 for each pattern), and sequences are
numbered by their earliest piece.

Defined results: a null text is an empty one (a single end token). Repeated
rows and rows with a null id are packed like any other row. An empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import materialize, rank_within, shuffle_partitions

MAX_LEN = 1024
END = 0
#: multiples of it, without their whole part, lie evenly between 0 and 1
GOLDEN = 0.6180339887498949
#: characters tokenised at a time, so that memory does not follow the batch
CHUNK = 4_000_000
#: characters of the pieces whose ids a worker keeps from one chunk to the next, each with 8 more
KNOWN = 8_000_000


class PieceTokenizer:
    """Token ids of whole texts by the ``tokenizers`` library.

    The byte-level pre-tokenizer never merges across a blank or line end that
    stands between two other characters. Texts are therefore cut there, each
    distinct piece is looked up in a table of ids, which encodes it if it is
    not there, and ids are put together again with numpy. A table of more than
    ``room`` is halved, and the most used pieces stay. The key of a piece is
    the piece without its blank, or with its line end; a text's first piece,
    which has neither, has a blank in front as its key. Texts with doubled
    white space are encoded whole. The split only saves work: ``encode``
    returns the ids of ``Tokenizer.encode``.
    """

    JOIN = 64

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.run = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)  # without offsets
        self.room = KNOWN
        self.known: dict[str, int] = {}  # key of a piece -> its place in the arrays below
        self.begins, self.sizes, self.chars, self.uses = (np.zeros(0, dtype=np.int64) for _ in range(4))
        self.ids = np.zeros(0, dtype=np.uint32)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.cuttable = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                         and not pre.get("add_prefix_space", False) and not spec.get("normalizer"))
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)  # ids that begin with a blank or line end
        for token, i in vocab.items():
            self.opens[i] = token[:1] in ("Ġ", "Ċ")
        self.specials = [t["content"] for t in spec.get("added_tokens") or []]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for i in range(0, len(texts), self.JOIN):  # few encodings at a time: they are large objects
            out += [np.array(e.ids, dtype=np.uint32) for e in self.run(texts[i:i + self.JOIN], add_special_tokens=False)]
        return out

    def _opened(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of pieces that each begin with a blank or line end: several are
        encoded in one string and told apart by the ids that open a piece."""
        out: list[np.ndarray] = []
        groups = [pieces[i:i + self.JOIN] for i in range(0, len(pieces), self.JOIN)]
        for group, ids in zip(groups, self._whole(["".join(g) for g in groups]), strict=True):
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(group) and starts[0] == 0:
                cuts = [*starts.tolist(), len(ids)]
                out += [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            else:
                out += self._whole(group)
        return out

    def _learn(self, keys: list[str]) -> None:
        """Adds the ids of keys that are not in the table."""
        keys = sorted(keys, key=lambda k: k[:1] == " ")
        heads = [k[1:] for k in keys if k[:1] == " "]
        ids = self._opened([k if k[:1] == "\n" else " " + k for k in keys[:len(keys) - len(heads)]]) + self._whole(heads)
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys)), strict=True))
        self.begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.chars = np.concatenate([self.chars, [8 + len(k) for k in keys]])
        self.uses = np.concatenate([self.uses, np.zeros(len(keys), dtype=np.int64)])
        self.ids = np.concatenate([self.ids, *ids])

    def _places(self, keys: list[str]) -> np.ndarray:
        """The keys' places in the table, which takes up those it has not met."""
        out = np.fromiter(map(self.known.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        missed = np.flatnonzero(out < 0)
        new = [keys[i] for i in missed]
        self._learn(list(dict.fromkeys(new)))
        out[missed] = [self.known[k] for k in new]
        return out

    def _forget(self) -> None:
        """Leaves the most used pieces of a full table, in half of its room."""
        order = np.argsort(-self.uses, kind="stable")
        kept = np.sort(order[np.cumsum(self.chars[order]) <= self.room // 2])
        keys = list(self.known)  # in the order of their places
        self.known = {keys[i]: n for n, i in enumerate(kept)}
        begins, self.sizes, self.chars, self.uses = self.begins[kept], self.sizes[kept], self.chars[kept], self.uses[kept] // 2
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.ids = self.ids[np.arange(self.sizes.sum()) + np.repeat(begins - self.begins, self.sizes)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        import re

        rough = re.compile(r"\s\s")
        cut = [self.cuttable and not rough.search(t) and not any(s in t for s in self.specials) for t in texts]
        whole = iter(self._whole([t for t, c in zip(texts, cut, strict=True) if not c]))
        if not any(cut):
            return list(whole)
        # a leading blank makes the first piece look like the others
        own = pa.array([" " + t for t, c in zip(texts, cut, strict=True) if c], pa.large_string())
        own = pc.split_pattern(pc.replace_substring(own, "\n", " \n"), " ")
        bounds = own.offsets.to_numpy()  # of each text, whose piece before that blank is nothing
        pieces = own.values.dictionary_encode()
        heads = own.values.take(pa.array(bounds[:-1] + 1)).to_pylist()
        places = self._places(pieces.dictionary.to_numpy(zero_copy_only=False).tolist() + [" " + head for head in heads])
        at = places[pieces.indices.to_numpy()]
        at[bounds[:-1] + 1] = places[len(pieces.dictionary):]
        at = np.delete(at, bounds[:-1])
        counts = np.diff(bounds) - 1
        self.uses += np.bincount(at, minlength=len(self.uses))
        each = self.sizes[at]
        total = np.cumsum(each)
        stream = self.ids[np.arange(total[-1]) + np.repeat(self.begins[at] - total + each, each)]
        if self.chars.sum() > self.room:
            self._forget()
        parts = iter(np.split(stream, total[np.cumsum(counts)[:-1] - 1]))
        return [next(parts if c else whole) for c in cut]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> PieceTokenizer:
    """One for each worker process."""
    return PieceTokenizer(path)


def tokenize(batches: Iterator[pd.DataFrame], path: str, max_len: int) -> Iterator[pd.DataFrame]:
    tok = tokenizer(path)
    end = np.array([END], dtype=np.uint32)

    def cut(ids: list, texts: list[str], places: list) -> pd.DataFrame:
        rows = []
        for doc_id, place, tokens in zip(ids, places, tok.encode(texts), strict=True):
            tokens = np.concatenate([tokens, end]).astype("<u4")
            for start in range(0, len(tokens), max_len):
                piece = tokens[start:start + max_len]
                rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(tokens), place))
        done = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "place"])
        return done.astype({"place": "Int64"})

    for batch in batches:
        texts = ["" if t is None else t for t in batch["text"]]
        ids = list(batch["doc_id"])
        places = [None if pd.isna(p) else int(p) for p in batch["place"]]
        begin, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= CHUNK:
                yield cut(ids[begin:i + 1], texts[begin:i + 1], places[begin:i + 1])
                begin, size = i + 1, 0
        if begin < len(texts):
            yield cut(ids[begin:], texts[begin:], places[begin:])


def plan_packs(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[list[int], int]]:
    """Shortest-pack-first histogram packing: [(lengths in a sequence, number
    of such sequences)]. Lengths are placed longest first into the open
    pattern with the most room left; a new sequence takes as many as fit."""
    open_: dict[int, list[tuple[tuple, int]]] = {}  # room -> [(pattern, count)]
    done: list[tuple[tuple, int]] = []

    def put(pattern: tuple, count: int, room: int) -> None:
        (open_.setdefault(room, []) if room else done).append((pattern, count))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            room = max((r for r, packs in open_.items() if packs), default=0)
            if room >= length:
                pattern, count = open_[room].pop()
                used = min(count, n)
                if used < count:
                    open_[room].append((pattern, count - used))
                put((pattern, length), used, room - length)
                n -= used
                continue
            fit = max_len // length
            packs, rest = divmod(n, fit)
            for copies, count in ((fit, packs), (rest, 1 if rest else 0)):
                if count:
                    pattern: tuple = ()
                    for _ in range(copies):
                        pattern = (pattern, length)
                    put(pattern, count, max_len - copies * length)
            n = 0
    out = []
    for pattern, count in [*done, *(p for r in sorted(open_) for p in open_[r])]:
        lengths = []
        while pattern:
            pattern, length = pattern
            lengths.append(length)
        out.append((lengths[::-1], count))
    return out


def slots(packs: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length the runs of ranks: first rank, first sequence, offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for lengths, count in packs:
        offset = 0
        for length in lengths:
            first = taken.get(length, 0)
            runs.setdefault(length, []).append((first, base, offset))
            taken[length] = first + count
            offset += length
        base += count
    return {k: np.array(v, dtype=np.int64) for k, v in runs.items()}


def in_order(pieces: DataFrame, packs: list[tuple[list[int], int]], buckets: int) -> DataFrame:
    """``pieces`` with sequence_id and offset, along their column ``place``.
    One row for each piece of a sequence is made in tasks and meets the
    pieces by length and rank; the driver holds the patterns only."""
    spark = pieces.sparkSession
    ends = np.cumsum([count for _, count in packs])
    total = int(ends[-1]) if packs else 0

    def seats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            number = batch["id"].to_numpy()
            pattern = np.searchsorted(ends, number, side="right")
            for p in np.unique(pattern):
                own = number[pattern == p]
                lengths, count = packs[p]
                share = (own - (ends[p] - count) + (p + 1) * GOLDEN % 1) / count
                offset = 0
                for length in lengths:
                    yield pd.DataFrame({"length": length, "share": share, "sequence": own, "offset": offset})
                    offset += length

    seat = spark.range(total).mapInPandas(seats, "length long, share double, sequence long, offset long")
    seat = rank_within(seat, "length", ["share", "sequence", "offset"], buckets, "rank",
                       F.floor(F.col("share") * buckets)).drop("share")
    low, high = pieces.agg(F.min("place"), F.max("place")).first()
    width = 1 if low is None else (high - low) // buckets + 1
    along = F.coalesce(F.floor((F.col("place") - F.lit(low or 0)) / F.lit(width)), F.lit(buckets))  # nulls last
    pieces = pieces.withColumn("late", F.col("place").isNull())
    ranked = rank_within(pieces, "length", ["late", "place", "doc_id", "start"], buckets, "rank", along)
    seated = materialize(ranked.join(seat, ["length", "rank"]), "seated")
    first = seated.groupBy("sequence").agg(F.min("place").alias("place")).withColumns(
        {"late": F.col("place").isNull(), "all": F.lit(0)})
    numbered = rank_within(materialize(first, "first"), "all", ["late", "place", "sequence"], buckets, "sequence_id", along)
    return seated.join(numbered.select("sequence", "sequence_id"), "sequence")


PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long"


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         max_len: int = MAX_LEN, order_col: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. A document is its ids followed by id 0; documents
    longer than ``max_len`` are cut into full pieces and a rest. ``order_col``
    (whole numbers, close together; nulls last) gives the documents' order."""
    place_of = F.lit(None) if order_col is None else F.col(order_col)
    cut = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"),
                      place_of.cast("long").alias("place")).mapInPandas(
        lambda batches: tokenize(batches, tokenizer_path, max_len), PIECES + ", place long")
    pieces = materialize(cut if order_col else cut.drop("place"), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    packs = plan_packs(histogram, max_len)
    buckets = 4 * shuffle_partitions(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    if order_col is not None:
        done = in_order(pieces, packs, buckets)
        return done.select(F.col("doc_id").cast(id_type).alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens",
                           "sequence_id", "offset")
    runs = slots(packs)
    ranked = rank_within(pieces, "length", ["doc_id", "start"], buckets, "rank")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence = np.empty(len(batch), dtype=np.int64)
            offset = np.empty(len(batch), dtype=np.int64)
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                run = runs[int(length)]
                at = np.searchsorted(run[:, 0], ranks[own], side="right") - 1
                sequence[own] = run[at, 1] + ranks[own] - run[at, 0]
                offset[own] = run[at, 2]
            yield batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    packed = ranked.mapInPandas(place, PIECES + ", sequence_id long, offset long")
    return packed.withColumn("doc_id", F.col("doc_id").cast(id_type))
