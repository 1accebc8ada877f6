"""Document log probability by a subword lattice.

A text is its tokens (words, A-Z lower-cased, then one end). A word is reached
over a lattice of the characters of ``▁word``: arcs over the whole word have
the weight of its discounted counts in the training documents; the other arcs
are the pieces of an existing subword vocabulary, with unigram scores, and so
every segmentation of the word into pieces counts. The forward recursion adds
all paths in log space. All paths of a document meet at every word end, so its
marginal probability is a product over tokens, and the recursion runs once for
a distinct word however often it occurs. Training documents may have a class
(their language); each class k has scores of its own, and the document's
probability is the sum over classes, of which it need not know its own::

    P(text)   = sum over k of share_k * product over tokens of P_k(token)
    P_k(end)  = (ends_k + 1/2) / (tokens_k + 1)
    P_k(word) = (1 - P_k(end)) * (kept(c_k) / words_k + spare_k * all_k(word))
    all_k     = kept(c) / words + spare * spelled_k(word)

``kept`` takes modified absolute discounts from counts 1, 2 and 3 or more, and
``spare`` is what they set free. ``spelled_k`` is the sum over segmentations:
the first piece opens a word, the others go on, and a stop ends it; each of the
two kinds of pieces sums to one. The pieces and their order come from the
vocabulary file; their scores start from that order and are fitted by
``ROUNDS`` of expectation maximisation on the training words, each with the
weight that its discount sets free; the last round also splits the expected
counts by class. Characters outside the vocabulary are spelled by their bytes.

What grows with the corpus stays in Spark tables: each ``block`` of documents
sends its distinct words once, counts are summed by word, words are scored
where they lie, and blocks ask for the words that they hold. Only the scores
of the fixed vocabulary, for at most ``MAX_CLASSES`` classes, are broadcast.

Defined results: a null or empty text is the end alone. Rows with a null id
are scored, not held out and not learned from; repeated rows are learned from
and scored as often as they occur. A null class is the empty one; of more than
``MAX_CLASSES`` classes the rarest are one class. With nothing to learn from,
all words are spelled by the vocabulary's order. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import isolate, materialize, restore
from orderpulse.llm.quality import squeeze, unsqueeze

#: a block is full with so many characters or rows
BLOCK_CHARS, BLOCK_ROWS = 12_000_000, 10_000
#: texts that are split into words at a time
SPLIT_CHARS, SPLIT_ROWS = 1_000_000, 1_000
ROUNDS = 3
MAX_CLASSES = 16
#: weight of the vocabulary's own order against the fitted counts, in pieces
PRIOR = 100.0
#: cells of a forward table at a time, few enough for a processor's cache, and the longest words that share one
CELLS, LONG_WORD = 100_000, 200
#: the class that a row teaches; a column name of no table
OWN = "lattice_lm.own"
#: stands for the mark that opens a word; no character has this number
OPEN = 0x110000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def split_words(texts: pa.Array | list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z lower-cased, and their number in each text."""
    texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
    # a copy whose bytes begin at zero: Arrow lower-cases the wrong bytes of a slice
    texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))), "")
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    word = pc.not_equal(pc.binary_length(cut.values), 0)  # white space at an end leaves an empty one
    so_far = np.concatenate([[0], np.cumsum(word.to_numpy(zero_copy_only=False))])
    return cut.values.filter(word), np.diff(so_far[cut.offsets.to_numpy()])


def _next(h: np.ndarray, char: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ char) * _STEP
    return h ^ (h >> np.uint64(29))


class Vocabulary:
    """Pieces of a sentencepiece file and their prefixes by 64-bit hashes.
    ``log`` holds a column of natural-log scores for each class: pieces that
    open a word sum to one, the others with the stop (last place) too."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: list[tuple[int, ...]] = []
        weight, bytes_of = [], {}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            piece = model.id_to_piece(i)
            rank = max(-model.get_score(i), 0.0)
            if model.is_byte(i):
                bytes_of[int(piece[3:5], 16)] = len(self.pieces)
                self.pieces.append((-1, int(piece[3:5], 16)))
                weight.append(1.0 / (model.get_piece_size() + 1.0))
            elif "▁" not in piece[1:]:
                self.pieces.append(tuple(OPEN if c == "▁" else ord(c) for c in piece))
                weight.append(1.0 / (min(rank, float(model.get_piece_size())) + 1.0))
        if len(bytes_of) < 256 or (OPEN,) not in self.pieces:
            raise ValueError("the vocabulary must spell every byte and open a word")
        self.bytes_of = np.array([bytes_of[b] for b in range(256)])
        self.opens = np.array([p[0] == OPEN for p in self.pieces] + [False])
        start = np.array([*weight, sum(w for w, o in zip(weight, self.opens, strict=False) if not o) / 4])
        self.start = self._normal(start)
        self.log = np.log(self.start)[:, None]
        known: dict[int, int] = {}  # hash of a prefix -> piece, or -1 for a prefix only
        self.longest = 1
        with np.errstate(over="ignore"):
            for i, chars in enumerate(self.pieces):
                if chars[0] < 0:
                    continue
                self.longest = max(self.longest, len(chars))
                h = np.zeros(1, np.uint64)
                for n, c in enumerate(chars, 1):
                    h = _next(h, np.array([c], np.uint64))
                    if n == len(chars):
                        known[int(h[0])] = i
                    else:
                        known.setdefault(int(h[0]), -1)
        self.index = pd.Index(np.array(list(known), dtype=np.uint64))
        self.piece_of = np.array([*known.values(), -2], dtype=np.int64)  # -2: no prefix

    def _normal(self, weight: np.ndarray) -> np.ndarray:
        out = weight.copy()
        for own in (self.opens, ~self.opens):
            out[own] /= out[own].sum()
        return out

    def __getstate__(self) -> dict:
        return self.__dict__ | {"index": self.index.to_numpy()}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"index": pd.Index(state["index"])}

    def fitted(self, expected: np.ndarray) -> Vocabulary:
        """The vocabulary with scores by expected counts of its pieces and the stop, a column a class."""
        out = object.__new__(Vocabulary)
        out.__dict__ |= self.__dict__
        out.log = np.log(np.stack([self._normal(e + PRIOR * self.start) for e in expected.T], axis=1))
        return out


@dataclass
class Arcs:
    """Arcs of the lattices of several words: word, start, end, piece. Pieces
    from ``len(vocabulary.log)`` on are characters spelled by bytes."""

    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    spelled: list[np.ndarray]
    sizes: np.ndarray

    def scores(self, v: Vocabulary) -> np.ndarray:
        more = [v.log[own].sum(axis=0) for own in self.spelled]
        return np.concatenate([v.log, np.array(more).reshape(-1, v.log.shape[1])])[self.piece]


def arcs_of(words: list[str], v: Vocabulary) -> Arcs:
    """All arcs, by start, length and word. Prefixes are followed only as long
    as some piece goes on with them."""
    sizes = np.array([len(w) for w in words], dtype=np.int64) + 1
    joined = np.frombuffer("".join("\0" + w for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    first = np.cumsum(sizes) - sizes
    chars = joined.astype(np.uint64)
    chars[first] = OPEN
    word = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(chars)) - first[word]
    left = sizes[word] - at
    live, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
    found = []
    for n in range(1, v.longest + 1):
        live_in = left[live] >= n
        live, h = live[live_in], h[live_in]
        h = _next(h, chars[live + n - 1])
        piece = v.piece_of[v.index.get_indexer(h)]
        hit = piece >= 0
        found.append((live[hit], np.full(int(hit.sum()), n), piece[hit]))
        go = piece > -2
        live, h = live[go], h[go]
    place, length, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    alone = np.ones(len(chars), dtype=bool)
    alone[place[length == 1]] = False
    odd = np.flatnonzero(alone & (chars != OPEN))
    codes, distinct = pd.factorize(joined[odd])
    spelled = [v.bytes_of[list(chr(int(c)).encode("utf-8", "surrogatepass"))] for c in distinct]
    place = np.concatenate([place, odd])
    length = np.concatenate([length, np.ones(len(odd), np.int64)])
    piece = np.concatenate([piece, codes + len(v.log)])
    step = at[place] * (v.longest + 1) + length
    # 16-bit numbers are sorted in one pass; odd characters come after the words of their step
    order = np.argsort(step.astype(np.uint16) if step.max(initial=0) < 1 << 16 else step, kind="stable")
    place, length, piece = place[order], length[order], piece[order]
    return Arcs(word[place], at[place], at[place] + length, piece, spelled, sizes)


def _steps(arcs: Arcs) -> list[slice]:
    """Runs of arcs with equal start and length, which never share a word."""
    cuts = np.flatnonzero(np.diff(arcs.start) | np.diff(arcs.end)) + 1
    return [slice(a, b) for a, b in zip([0, *cuts], [*cuts, len(arcs.start)], strict=True) if b > a]


def _sum_paths(arcs: Arcs, score: np.ndarray, n_words: int, backward: bool = False) -> np.ndarray:
    """(words, characters + 1, classes) log sums over all paths from the start
    to each node or, backward, from each node to the word's end. In memory a
    node's words lie together, as a step goes through them."""
    nodes, classes = int(arcs.sizes.max(initial=1)) + 1, score.shape[1]
    table = np.full((nodes, n_words, classes), -np.inf)
    if backward:
        table[arcs.sizes, np.arange(n_words)] = 0.0
    else:
        table[0] = 0.0
    # one class needs no second index
    flat, score = (table.reshape(-1), score[:, 0]) if classes == 1 else (table.reshape(-1, classes), score)
    come, go = arcs.start * n_words + arcs.word, arcs.end * n_words + arcs.word
    if backward:
        come, go = go, come
    steps = _steps(arcs)
    for own in (reversed(steps) if backward else steps):
        at = go[own]
        flat[at] = np.logaddexp(flat[at], flat[come[own]] + score[own])
    return table.transpose(1, 0, 2)


def _batches(words: list[str]) -> Iterator[np.ndarray]:
    """Word numbers with equal lengths together, so that one table is full;
    a very long word comes alone and its table is as long as it is."""
    sizes = np.array([len(w) for w in words], dtype=np.int64) + 2
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order].tolist()
    begin = 0
    for i in range(1, len(order) + 1):
        if i == len(order) or (i - begin + 1) * sizes[i] > CELLS or sizes[i] > LONG_WORD:
            yield order[begin:i]
            begin = i


def _long_word(arcs: Arcs, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward sums of one word, node by node."""
    from math import exp, inf, log1p

    size = int(arcs.sizes[0])
    starts, ends = arcs.start.tolist(), arcs.end.tolist()

    def add(a: float, b: float) -> float:
        if a == -inf or b == -inf:
            return max(a, b)
        return a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))

    out = np.empty((2, 1, size + 1, score.shape[1]))
    for k in range(score.shape[1]):
        scores = score[:, k].tolist()
        forward, backward = [-inf] * (size + 1), [-inf] * (size + 1)
        forward[0] = backward[size] = 0.0
        for a, b, s in zip(starts, ends, scores, strict=True):
            forward[b] = add(forward[b], forward[a] + s)
        for a, b, s in zip(reversed(starts), reversed(ends), reversed(scores), strict=True):
            backward[a] = add(backward[a], backward[b] + s)
        out[0, 0, :, k], out[1, 0, :, k] = forward, backward
    return out[0], out[1]


def spell(words: list[str], v: Vocabulary) -> np.ndarray:
    """(words, classes): natural-log sum over all segmentations of each word, with the stop."""
    out = np.zeros((len(words), v.log.shape[1]))
    for own in _batches(words):
        arcs = arcs_of([words[i] for i in own], v)
        score = arcs.scores(v)
        if arcs.sizes.max() > LONG_WORD and len(own) == 1:
            out[own] = _long_word(arcs, score)[0][0, -1]
        else:
            out[own] = _sum_paths(arcs, score, len(own))[np.arange(len(own)), arcs.sizes]
    return out + v.log[-1]


def expect(words: list[str], weight: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Expected number of uses of every piece, and of the stop, in the words
    under the scores of ``v`` (one class), for each column of ``weight``."""
    total = np.zeros((len(v.log), weight.shape[1]))
    for own in _batches(words):
        arcs = arcs_of([words[i] for i in own], v)
        score = arcs.scores(v)
        if arcs.sizes.max() > LONG_WORD and len(own) == 1:
            forward, backward = _long_word(arcs, score)
        else:
            forward = _sum_paths(arcs, score, len(own))
            backward = _sum_paths(arcs, score, len(own), backward=True)
        whole = backward[:, 0]
        used = np.exp(forward[arcs.word, arcs.start] + score + backward[arcs.word, arcs.end] - whole[arcs.word])[:, 0]
        for k in range(weight.shape[1]):
            counts = np.bincount(arcs.piece, used * weight[own, k][arcs.word], len(v.log) + len(arcs.spelled))
            total[:, k] += counts[:len(v.log)]
            for n, pieces in zip(counts[len(v.log):], arcs.spelled, strict=True):
                np.add.at(total[:, k], pieces, n)
    total[-1] += weight.sum(axis=0)
    return total


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified absolute discounts of counts 0, 1, 2, 3 and more; some of each
    count is always set free, so that every word can be spelled."""
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0)
    return np.array([0.0, *(min(max(d, 0.05), 0.95 * i) for i, d in enumerate(raw, 1))])


@dataclass
class Level:
    """Word counts of one class, or of all: sums, discounts, and what these set free."""

    words: int
    types: int
    of_counts: tuple[int, int, int, int]
    ends: int

    def __post_init__(self) -> None:
        n1, n2 = self.of_counts[:2]
        self.discount = d = discounts(*self.of_counts)
        self.spare = ((d[1] * n1 + d[2] * n2 + d[3] * (self.types - n1 - n2)) / self.words) if self.words else 1.0

    def freed(self, c: np.ndarray) -> np.ndarray:
        return self.discount[np.minimum(c, 3)]

    def over(self, c: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Natural-log probability of words with counts ``c`` over the one of the level below."""
        with np.errstate(divide="ignore"):
            kept = np.log((c - self.freed(c)) / max(self.words, 1))
            return np.logaddexp(kept, np.log(self.spare) + below)

    def end(self) -> float:
        return (self.ends + 0.5) / (self.words + self.ends + 1)


@dataclass
class Counts:
    """Sums over the training documents: of all, and of each class."""

    all: Level
    classes: list[Level]

    @property
    def tokens(self) -> int:
        return self.all.words + self.all.ends

    def base(self, c: np.ndarray) -> np.ndarray:
        """log10 of the token probability with one half added to every count."""
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.all.types + (self.all.ends > 0) + 1)))

    def words_log(self, c: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Natural-log P_k(word), a column a class, from its counts by class."""
        total = c.sum(axis=1)
        return np.stack([np.log1p(-own.end()) + own.over(c[:, k], self.all.over(total, spelled[:, k]))
                         for k, own in enumerate(self.classes)], axis=1)

    def shares(self) -> np.ndarray:
        ends = np.array([own.ends for own in self.classes], dtype=float) + 0.5
        return ends / ends.sum()


def _to_blocks(batches: Iterator[pa.RecordBatch], classes: int) -> Iterator[pa.RecordBatch]:
    """Blocks from batches of any size. Rows and words stay in Arrow; of texts
    that were split only the distinct words and their places are held."""
    part, n, size, n_rows = TaskContext.get().partitionId(), 0, 0, 0
    held: list[tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]] = []

    def hold(batch: pa.RecordBatch) -> None:
        words, lengths = split_words(batch.column("text"))
        held.append((batch.column("row"), batch.column("own").to_numpy().astype(np.int8), words.dictionary_encode(), lengths))

    def block() -> pa.RecordBatch:
        nonlocal n
        n += 1
        rows, own, words, lengths = zip(*held, strict=True)
        held.clear()
        words = pa.chunked_array(words).unify_dictionaries().chunks
        rows, own, lengths = pa.concat_arrays(rows), np.concatenate(own), np.concatenate(lengths)
        codes, vocab = np.concatenate([w.indices.to_numpy() for w in words]), words[0].dictionary
        used = np.bincount(codes, minlength=len(vocab))
        order = np.argsort(-used, kind="stable")  # frequent words get small codes
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        of = np.repeat(own, lengths)  # the class that a word's document teaches, or -1
        learned = [np.bincount(codes[of == k], minlength=len(vocab))[order].astype(np.int32) for k in range(classes)]
        lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in (rows, vocab.take(pa.array(order)).cast(pa.string()), *map(pa.array, learned))]
        packed = [pa.array([squeeze(x)], pa.binary()) for x in (lengths, rank[codes] if len(codes) else codes)]
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | n]), lists[0], *packed, *lists[1:]],
                                          ["block", "rows", "lengths", "codes", "vocab", *[f"l{k}" for k in range(classes)]])

    for batch in batches:
        chars = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(chars, dtype=np.int64) // SPLIT_CHARS) | np.diff(np.arange(len(chars)) // SPLIT_ROWS)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(chars)], strict=True):
            if b > a:
                hold(batch.slice(a, b - a))
                size, n_rows = size + int(chars[a:b].sum(dtype=np.int64)), n_rows + b - a
            if size >= BLOCK_CHARS or n_rows >= BLOCK_ROWS:
                yield block()
                size = n_rows = 0
    if held:
        yield block()


def class_values(train: DataFrame) -> tuple[list[str], list[int], int]:
    """The classes of training rows (``cls``), commonest first, with their
    numbers of rows, and the rows of all other classes."""
    counted = train.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("k")).first()
    kept = MAX_CLASSES if total["k"] <= MAX_CLASSES else MAX_CLASSES - 1
    rows = counted.orderBy(F.desc("n"), "cls").limit(kept).collect()
    return [r["cls"] for r in rows], [r["n"] for r in rows], total["t"] - sum(r["n"] for r in rows)


def count_words(blocks: DataFrame, ends: list[int]) -> tuple[DataFrame, Counts]:
    """(word, c0, c1, … by class) for every word, and the sums. Each block adds one row a word."""
    classes = len(ends)
    # words are taken from the arrays by place: a zipped array would be an object a word on the heap
    own = blocks.select(F.posexplode("vocab").alias("at", "word"), *[f"l{k}" for k in range(classes)])
    counted = materialize(own.groupBy("word").agg(
        *[F.sum(F.get(f"l{k}", F.col("at"))).alias(f"c{k}") for k in range(classes)]), "words")
    columns = [F.col(f"c{k}") for k in range(classes)]
    learned = sum(columns, F.lit(0))
    sums = counted.agg(*[
        x.alias(f"{name}{k}") for k, c in enumerate([*columns, learned]) for name, x in (
            ("words", F.coalesce(F.sum(c), F.lit(0))), ("types", F.count_if(c > 0)),
            *((f"n{i}_", F.count_if(c == i)) for i in (1, 2, 3, 4)))]).first()
    levels = [Level(sums[f"words{k}"], sums[f"types{k}"], tuple(sums[f"n{i}_{k}"] for i in (1, 2, 3, 4)), e)
              for k, e in enumerate([*ends, sum(ends)])]

    return counted, Counts(levels[-1], levels[:-1])


def _class_counts(batch: pd.DataFrame, classes: int) -> np.ndarray:
    return batch[[f"c{k}" for k in range(classes)]].to_numpy(dtype=np.int64)


def fit(counted: DataFrame, counts: Counts, v: Vocabulary, rounds: int = ROUNDS) -> Vocabulary:
    """Piece scores by expectation maximisation. Each task sends at most one
    row for each piece of the vocabulary; so does the sum to the driver."""
    spark, classes = counted.sparkSession, len(counts.classes)
    learned = counted.where(sum((F.col(f"c{k}") for k in range(classes)), F.lit(0)) > 0)
    for last in [False] * (rounds - 1) + [True]:
        shared = spark.sparkContext.broadcast(v)
        columns = classes if last else 1

        def part(batches: Iterator[pd.DataFrame], shared=shared, columns=columns) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(shared.value.log), columns))
            for batch in batches:
                c = _class_counts(batch, classes)
                whole = c.sum(axis=1, keepdims=True)
                freed = counts.all.freed(whole)
                total += expect(list(batch["word"]), freed * c / whole if columns == classes else freed, shared.value)
            used = np.flatnonzero(total.any(axis=1))
            if len(used):
                yield pd.DataFrame({"piece": used, "n": list(total[used])})

        sums = learned.mapInPandas(part, "piece long, n array<double>").groupBy("piece").agg(
            F.array(*[F.sum(F.get("n", F.lit(k))) for k in range(columns)]).alias("n")).collect()
        expected = np.zeros((len(v.log), columns))
        for r in sums:
            expected[r["piece"]] = r["n"]
        v = v.fitted(expected)
    return v


def score_documents(docs: DataFrame, train_col: str, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
                    class_col: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` without ``text_col``, and n_tokens, n_known (tokens that occur
    in the rows whose ``train_col`` is true), train_tokens, base_score (log10
    probability by add-half word counts) and score (log10 marginal
    probability by the lattice). ``class_col`` is read of training rows only."""
    if rounds < 1:
        raise ValueError("rounds must be at least 1")
    spark = docs.sparkSession
    train = F.coalesce(F.col(train_col), F.lit(False))
    cls = F.lit("") if class_col is None else F.coalesce(F.col(class_col).cast("string"), F.lit(""))
    values, ends, others = class_values(docs.where(train).select(cls.alias("cls")))
    if others or not values:
        ends.append(others)
    found = F.array_position(F.array(*[F.lit(v) for v in values]), cls) if values else F.lit(0)
    own = F.when(train, F.when(found > 0, found - 1).otherwise(len(ends) - 1)).otherwise(-1).cast("int")
    roles = {"id": id_col, "text": text_col}
    carried = isolate(docs.select("*", own.alias(OWN)), **roles, own=OWN).select(F.struct("id", "rest").alias("row"), "text", "own")
    row_type = carried.schema["row"].dataType.simpleString()
    classes = len(ends)
    blocks = materialize(carried.mapInArrow(
        lambda b: _to_blocks(b, classes), f"block long, rows array<{row_type}>, lengths binary, codes binary, "
        "vocab array<string>, " + ", ".join(f"l{k} array<int>" for k in range(classes))), "blocks")
    counted, counts = count_words(blocks, ends)
    shared = spark.sparkContext.broadcast(fit(counted, counts, Vocabulary(vocabulary_path), rounds))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            c = _class_counts(batch, classes)
            lp = counts.words_log(c, spell(list(batch["word"]), shared.value))
            data = lp.astype("<f4").tobytes()
            yield pd.DataFrame({"word": batch["word"], "c": c.sum(axis=1),
                                "lp": [data[i:i + 4 * classes] for i in range(0, len(data), 4 * classes)]})

    # the scores of a word, one for each class, travel as 32-bit floats
    scored = materialize(counted.mapInPandas(judge, "word string, c long, lp binary"), "scored")
    asked = blocks.select(F.col("block").alias("asker"), F.posexplode("vocab").alias("at", "asked"))
    answers = asked.join(scored, F.col("asked") == F.col("word")).select("asker", "at", "c", "lp")

    def total(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        row = own.iloc[0]
        lengths = unsqueeze(row["lengths"]).astype(np.int64)
        codes = unsqueeze(row["codes"]).astype(np.int64)
        c, lp = np.zeros(len(found), dtype=np.int64), np.zeros((len(found), classes))
        if len(found):
            c[found["at"]] = found["c"]
            lp[found["at"]] = np.frombuffer(b"".join(found["lp"]), dtype="<f4").reshape(-1, classes)
        doc = np.repeat(np.arange(len(lengths)), lengths)

        def sums(values: np.ndarray) -> np.ndarray:
            return np.bincount(doc, values[codes], len(lengths)) if len(codes) else np.zeros(len(lengths))

        of_class = np.stack([sums(lp[:, k]) + np.log(level.end()) for k, level in enumerate(counts.classes)], axis=1)
        return pd.DataFrame({
            "row": list(row["rows"]), "n_tokens": lengths + 1,
            "n_known": sums((c > 0).astype(float)).astype(np.int64) + (counts.all.ends > 0), "train_tokens": counts.tokens,
            "base_score": sums(counts.base(c)) + counts.base(np.array([counts.all.ends]))[0],
            "score": np.logaddexp.reduce(of_class + np.log(counts.shares()), axis=1) / np.log(10.0)})

    done = blocks.select("block", "rows", "lengths", "codes").groupBy("block").cogroup(answers.groupBy("asker")).applyInPandas(
        total, f"row {row_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    return restore(done.select("row.*", *added), docs, roles, (text_col,), **{c: F.col(c) for c in added})
