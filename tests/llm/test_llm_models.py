"""Lattice language model, conversation trie, fill-in-middle, pipeline edges."""

import collections
import hashlib
import math
import random
import re
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import EDGE, LONG, PROSE, frame
from public_tokenizers import path
from pyspark.sql import functions as F

from orderpulse.llm import fill_middle, lattice_lm, prefix_trie, queries

SF = "/root/testdata/sf0.001"
PIECES = path("piece_bpe_32k.model")


# lattice language model ------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    return lattice_lm.Vocabulary(PIECES)


def paths(word, v, k=0):
    """Every segmentation of a word: its pieces and probability."""
    chars = (lattice_lm.OPEN, *map(ord, word))
    number = {p: i for i, p in enumerate(v.pieces)}
    found = []

    def walk(i, used, p):
        if i == len(chars):
            found.append((used, p * math.exp(v.log[-1, k])))
            return
        for j in range(i + 1, len(chars) + 1):
            if chars[i:j] in number:
                n = number[chars[i:j]]
                walk(j, [*used, n], p * math.exp(v.log[n, k]))
        if chars[i:i + 1] not in number:
            own = list(v.bytes_of[list(chr(chars[i]).encode())])
            walk(i + 1, used + own, p * math.exp(v.log[own, k].sum()))

    walk(0, [], 1.0)
    return found


WORDS = ["the", "ththsthe", "éeauxç", "x", "ꙮab", "▁a", "a" * 9, "\x1cb", "9.5%"]


def test_forward_sums_all_segmentations(vocabulary):
    want = [math.log(sum(p for _, p in paths(w, vocabulary))) for w in WORDS]
    assert np.allclose(lattice_lm.spell(WORDS, vocabulary)[:, 0], want, atol=1e-9)
    assert lattice_lm.spell([], vocabulary).shape == (0, 1)


def test_expected_counts_match_all_segmentations(vocabulary):
    weight = np.array([[1.0, 0.5], [2.0, 0.0]] * 4 + [[1.0, 1.0]])
    want = np.zeros((len(vocabulary.log), 2))
    for w, own in zip(WORDS, weight, strict=True):
        every = paths(w, vocabulary)
        total = sum(p for _, p in every)
        for used, p in every:
            for n in used:
                want[n] += own * p / total
        want[-1] += own
    assert np.allclose(lattice_lm.expect(WORDS, weight, vocabulary), want, atol=1e-9)


def test_a_very_long_word_takes_the_same_sums(vocabulary):
    rnd = random.Random(1)
    long_ = "".join(rnd.choice("the ꙮéab".replace(" ", "")) for _ in range(lattice_lm.LONG_WORD + 50))
    arcs = lattice_lm.arcs_of([long_], vocabulary)
    score = arcs.scores(vocabulary)
    forward, backward = lattice_lm._long_word(arcs, score)
    assert np.allclose(forward, lattice_lm._sum_paths(arcs, score, 1))
    assert np.allclose(backward, lattice_lm._sum_paths(arcs, score, 1, backward=True))
    assert np.allclose(lattice_lm.spell([long_, "the"], vocabulary)[:, 0] - vocabulary.log[-1, 0],
                       [forward[0, -1, 0], lattice_lm.spell(["the"], vocabulary)[0, 0] - vocabulary.log[-1, 0]])


def test_a_step_is_one_run_of_arcs(vocabulary):
    words = [*WORDS, "thethe", "\u6f22\u5b57the", ""]
    arcs = lattice_lm.arcs_of(words, vocabulary)
    steps = [(s, arcs.start[s], arcs.end[s], arcs.word[s]) for s in lattice_lm._steps(arcs)]
    for _, start, end, word in steps:  # so no step is searched for the arcs of one length
        assert len(set(start)) == len(set(end)) == 1 and len(set(word)) == len(word)
    keys = [(start[0], end[0]) for _, start, end, _ in steps]
    assert keys == sorted(set(keys)) and sum(len(word) for *_, word in steps) == len(arcs.word)


def test_words_end_at_ascii_white_space_only():
    texts = [None, "", " ", "The end", " a\x0bB\x0c\r\n\tc ", "\x1cx\x85Y\xa0z\u2003\u3000", "\u00c9T\u00c9 \u0130I", "\x00 A\x00b", PROSE]
    want = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    words, lengths = lattice_lm.split_words(texts)
    assert words.to_pylist() == [w for own in want for w in own] and lengths.tolist() == [len(own) for own in want]
    assert [len(x) for x in lattice_lm.split_words([])] == [0, 0]


def test_blocks_follow_characters_and_hold_a_few_texts_at_a_time(monkeypatch):
    rnd = random.Random(7)
    texts = [None if i % 9 == 4 else " ".join(rnd.choice(["the", "Th\u00e9", "on", "x" * rnd.randint(1, 9), "\ua66e"]) for _ in range(rnd.randint(0, 40)))
             for i in range(300)]
    own = [i % 4 - 1 for i in range(300)]
    rows = pa.array([{"id": i, "rest": {"lang": str(i % 3)}} for i in range(300)])
    whole = pa.RecordBatch.from_arrays([rows, pa.array(texts), pa.array(own, pa.int32())], ["row", "text", "own"])
    seen, split = [], lattice_lm.split_words

    def watched(part):
        seen.append(sum(len(t or "") for t in part.to_pylist()))
        return split(part)

    monkeypatch.setattr(lattice_lm, "split_words", watched)
    monkeypatch.setattr(lattice_lm, "BLOCK_CHARS", 3_000)
    monkeypatch.setattr(lattice_lm, "SPLIT_CHARS", 500)
    monkeypatch.setattr(lattice_lm, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 5)))
    batches = [whole.slice(a, 7) for a in range(0, 140, 7)] + [whole.slice(140, 0), whole.slice(140, 160)]  # many of a block, and many blocks of one
    blocks = list(lattice_lm._to_blocks(iter(batches), 3))
    longest = max(len(t or "") for t in texts)
    assert max(seen) < 500 + longest and sum(seen) == sum(len(t or "") for t in texts)  # never a block's text at once
    assert [b.column("block")[0].as_py() for b in blocks] == [5 << 32 | n for n in range(1, len(blocks) + 1)]
    done, at = [], 0
    for block in blocks:
        block.validate(full=True)
        vocab = block.column("vocab")[0].as_py()
        lengths, codes = (lattice_lm.unsqueeze(block.column(c)[0].as_py()).astype(int).tolist() for c in ("lengths", "codes"))
        ids = [r["id"] for r in block.column("rows")[0].as_py()]
        want = [[lower(w) for w in re.findall(r"[^\x20\x09-\x0D]+", texts[i] or "")] for i in ids]
        assert lengths == [len(ws) for ws in want] and [vocab[c] for c in codes] == [w for ws in want for w in ws]
        for k in range(3):
            count = collections.Counter(w for i, ws in zip(ids, want, strict=True) if own[i] == k for w in ws)
            assert block.column(f"l{k}")[0].as_py() == [count[w] for w in vocab]
        size, at = sum(len(texts[i] or "") for i in ids), at + len(ids)
        assert size < 3_500 + longest and (size >= 3_000 or at == 300)
        done += ids
    assert done == list(range(300)) and not list(lattice_lm._to_blocks(iter([]), 3))
    monkeypatch.setattr(lattice_lm, "BLOCK_ROWS", 10)  # rows without a text fill a block too
    monkeypatch.setattr(lattice_lm, "SPLIT_ROWS", 4)
    empty = pa.RecordBatch.from_arrays([rows.slice(0, 50), pa.array([None, ""] * 25), pa.array([0] * 50, pa.int32())], ["row", "text", "own"])
    blocks = list(lattice_lm._to_blocks(iter([empty]), 1))
    assert [r["id"] for b in blocks for r in b.column("rows")[0].as_py()] == list(range(50))
    assert [len(b.column("rows")[0]) for b in blocks] == [12, 12, 12, 12, 2]


def test_words_are_counted_without_an_object_a_word(spark, monkeypatch):
    blocks = spark.createDataFrame([(["a", "b"], [1, 0], [2, 3]), (["b", "c"], [4, 0], [0, 0]), ([], [], [])],
                                   "vocab array<string>, l0 array<int>, l1 array<int>")
    plans, keep = [], lattice_lm.materialize

    def kept(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(lattice_lm, "materialize", kept)
    counted, counts = lattice_lm.count_words(blocks, [1, 1])
    assert sorted(map(tuple, counted.collect())) == [("a", 1, 2), ("b", 4, 3), ("c", 0, 0)]
    assert (counts.all.words, counts.all.types, [x.words for x in counts.classes]) == (10, 2, [5, 5])
    assert "arrays_zip" not in plans[0]


def test_piece_scores_are_two_distributions(vocabulary):
    fitted = vocabulary.fitted(np.random.default_rng(0).random((len(vocabulary.log), 3)) * 100)
    for v in (vocabulary, fitted):
        p = np.exp(v.log)
        assert np.allclose(p[v.opens].sum(axis=0), 1) and np.allclose(p[~v.opens].sum(axis=0), 1)


def lower(word):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in word)


def brute_model(rows, v, rounds):
    """The whole model in plain Python: rows (text, class or None), and a function of a text."""
    tokens = [([lower(w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")], c) for t, c in rows]
    trained = [(ws, c) for ws, c in tokens if c is not None]
    classes = [c for c, _ in sorted(collections.Counter(c for _, c in trained).items(), key=lambda x: (-x[1], x[0]))]
    count = {c: collections.Counter(w for ws, k in trained if k == c for w in ws) for c in classes}
    whole = sum(count.values(), collections.Counter())
    ends = collections.Counter(c for _, c in trained)

    def level(c, e):
        of = collections.Counter(c.values())
        d = lattice_lm.discounts(*(of[i] for i in (1, 2, 3, 4)))
        n = sum(c.values())
        return d, n, sum(d[min(x, 3)] for x in c.values()) / n, (e + 0.5) / (n + e + 1)

    d, n, spare, _ = level(whole, len(trained))
    types = sorted(whole)
    for last in [False] * (rounds - 1) + [True]:
        freed = np.array([d[min(whole[w], 3)] for w in types])
        share = np.array([[count[c][w] / whole[w] for c in classes] for w in types])
        v = v.fitted(lattice_lm.expect(types, freed[:, None] * share if last else freed[:, None], v))
    own = {c: level(count[c], ends[c]) for c in classes}
    distinct = len(whole) + 1

    def score(text):
        ws = [lower(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        base = sum(math.log10((whole[w] + 0.5) / (n + len(trained) + 0.5 * (distinct + 1))) for w in ws)
        base += math.log10((len(trained) + 0.5) / (n + len(trained) + 0.5 * (distinct + 1)))
        spelled = np.exp(lattice_lm.spell(ws, v))
        total = 0.0
        for k, c in enumerate(classes):
            dk, nk, sk, end = own[c]
            p = math.log((ends[c] + 0.5) / (len(trained) + 0.5 * len(classes))) + math.log(end)
            for i, w in enumerate(ws):
                below = (whole[w] - d[min(whole[w], 3)]) / n + spare * spelled[i, k]
                p += math.log((1 - end) * ((count[c][w] - dk[min(count[c][w], 3)]) / nk + sk * below))
            total = p if not k else np.logaddexp(total, p)
        return len(ws) + 1, sum(w in whole for w in ws) + 1, n + len(trained), base, total / math.log(10)

    return score


def test_scores_match_a_plain_model(spark, vocabulary):
    rnd = random.Random(4)
    syllables = ["th", "er", "on", "eau", "é", "sch", "A"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3)))
    texts = [" ".join(word() for _ in range(rnd.randint(0, 25))) + rnd.choice(["", "\n", ".\x1fq\xa0z", "\t!"]) for _ in range(60)]
    texts += [None, "", "   ", texts[0], texts[0], "UNSEEN unseen ꙮꙮ"]
    rows = [(i if i % 11 else None, t, rnd.choice(["x", "y", None]), rnd.random() < 0.7) for i, t in enumerate(texts)]
    out = lattice_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, learn boolean"), "learn",
                                     PIECES, class_col="lang", rounds=2)
    assert out.columns == ["doc_id", "lang", "learn", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    model = brute_model([(t, (c or "") if learn else None) for _, t, c, learn in rows], vocabulary, 2)
    want = collections.Counter((i, c, learn, *(round(x, 3) for x in model(t))) for i, t, c, learn in rows)
    got = collections.Counter((*r[:6], round(r[6], 3), round(r[7], 3)) for r in out.collect())
    assert got == want


def test_lattice_edges_and_held_out_gain(spark):
    scored = lattice_lm.score_documents(frame(spark, EDGE).withColumn("learn", F.lit(False)), "learn", PIECES)
    rows = scored.collect()
    assert len(rows) == len(EDGE) and "text" not in scored.columns and {r["train_tokens"] for r in rows} == {0}
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    assert next(r["n_tokens"] for r in rows if r["doc_id"] == 7) == len(LONG.split()) + 1
    empty = {round(r["score"], 9) for r in rows if r["doc_id"] in (1, 2, 3)}
    assert len(empty) == 1 and next(r["n_tokens"] for r in rows if r["doc_id"] == 1) == 1
    assert lattice_lm.score_documents(frame(spark, EDGE[:0]).withColumn("learn", F.lit(True)), "learn", PIECES).count() == 0
    # the same kind of text again is more likely than words in no order of probability
    out = queries.op11_lattice_lm(spark, "/root/testdata/sf0.01")
    held = out.where("held_out and n_known > 0.95 * n_tokens").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held["s"] > held["b"]
    fold = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 for r in out.collect()}
    assert fold == {r["doc_id"]: r["held_out"] for r in out.collect()}


# conversation trie -----------------------------------------------------------------

def brute_trie(conversations):
    """{(smallest member, depth): row} of {id: [(role, text), ...]}."""
    members = collections.defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = {}

    def below(node):
        leaves, saved = 0 if children[node] else 1, (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        for child in children[node]:
            a, b = below(child)
            leaves, saved = leaves + a, saved + b
        ends = sorted(c for c in members[node] if len(conversations[c]) == len(node))
        out[min(members[node]), len(node)] = (
            min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), leaves, saved,
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
        return leaves, saved

    if members:
        below(())
    return out


def brute_rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def random_conversations(seed, n=300):
    rnd = random.Random(seed)
    out = {}
    for c in rnd.sample(range(100_000), n):
        size = rnd.choice([1, 2, 3, 4, 9])
        out[c] = [(rnd.choice("ua"), rnd.choice(["", "x", "yé", "zzz" * rnd.randint(1, 99)])) for _ in range(size)]
    for c in range(200_000, 200_000 + n):  # a third of all are one conversation, another third share its opening
        out[c] = [("u", "hello"), ("a", "hi"), ("u", "x" * 300)] if c % 2 else [("u", "hello"), ("a", "hi"), ("u", str(c))]
    return out


def turns_frame(spark, conversations, seed=0):
    rows = [(c, i, r, t) for c, turns in conversations.items() for i, (r, t) in enumerate(turns)]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")


def as_rows(df):
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"],
                                        r["ends_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("shard", [1, 11, 150, prefix_trie.SHARD_TURNS])
def test_trie_matches_brute_force(spark, shard):
    conversations = random_conversations(shard)
    paths_ = prefix_trie.paths_of(turns_frame(spark, conversations))
    assert as_rows(prefix_trie.trie(paths_, shard)) == brute_trie(conversations)


def test_rebuilt_conversations_match_brute_force(spark):
    rnd = random.Random(9)
    own = {c: [(rnd.choice("ua"), rnd.choice("abc") * rnd.randint(0, 3)) for _ in range(rnd.randint(1, 7))]
           for c in [*rnd.sample(range(1000), 250), 0, 100, 300, 10 ** 12, 10 ** 12 + 7]}
    got = prefix_trie.trie(prefix_trie.share_heads(prefix_trie.paths_of(turns_frame(spark, own))))
    assert as_rows(got) == brute_trie(brute_rebuilt(own))


def test_trie_edges(spark):
    schema = "conv_id long, turn int, role string, text string, id string, path string, key int"
    extra = ("i", "p", 1)
    rows = [(1, None, "u", "first", *extra), (1, 0, None, None, *extra), (1, 5, "u", LONG, *extra),
            (2, None, "u", "first", *extra), (2, 0, "", "", *extra), (None, 0, "u", "x", *extra),
            (3, 0, "u", "same", *extra), (3, 0, "u", "same", *extra), (4, 0, "us", "ame", *extra)]
    got = as_rows(prefix_trie.prefix_trie(spark.createDataFrame(rows, schema)))
    want = brute_trie({1: [("u", "first"), ("", ""), ("u", LONG)], 2: [("u", "first"), ("", "")],
                       3: [("u", "same"), ("u", "same")], 4: [("us", "ame")]})
    assert got == want
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0


def test_double_array_holds_exactly_its_paths():
    rnd = random.Random(2)
    code = lambda i: hashlib.md5(str(i).encode()).digest() + i.to_bytes(8, "big")
    every = {b"".join(code(rnd.randrange(40)) for _ in range(rnd.randint(0, 6))) for _ in range(500)}
    array, dense, chars, states = prefix_trie.pack(sorted(every))
    assert len(states) == len(set(states)) == len({p[:24 * d] for p in every for d in range(len(p) // 24 + 1)})
    for path_, turns in zip(sorted(every), dense, strict=True):
        state = 0
        for k, t in enumerate(turns):
            child = array.base[state] + t
            assert array.check[child] == state and chars[t] == int.from_bytes(path_[24 * k + 16:24 * k + 24], "big")
            state = child
    assert sum(c >= 0 for c in array.check) == len(states) - 1


def test_many_copies_hash_in_runs(spark):
    ids = [1, 2, 65_535, 65_536, 200_000, 3 << 40]
    frame_ = spark.createDataFrame([(i, 0, "u", "x") for i in ids], "conv_id long, turn int, role string, text string")
    got = as_rows(prefix_trie.prefix_trie(frame_))
    assert got[1, 1][-1] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


# fill in the middle ----------------------------------------------------------------

def brute_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle_matches_brute_force_and_rebuilds(spark):
    rnd = random.Random(5)
    texts = [None, "", "\n", "\n\n\n", "a", "a\nb", "a\n$1\\b\n<P", "x<P>y", "é\n𝄞\nß", "\r\n\x85 \nz", ">\nS>\nP>\n", "<\nS>",
             "\n".join(f"line {i}" for i in range(200_000)), "a" * 2_000_000, PROSE, LONG]
    texts += ["".join(rnd.choice("ab<>PSM$\\\n") for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    rows = [(None if i == 3 else i, t) for i, t in enumerate(texts)] + [(9, "a\nb\nc"), (9, "a\nb\nc")]
    out = fill_middle.transform(frame(spark, rows)).withColumn("back", fill_middle.rebuild(F.col("text"), F.col("form")))
    got = collections.Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["text"], r["back"])
                              for r in out.collect())
    assert got == collections.Counter((i, *brute_middle(i, t), t or "") for i, t in rows)
    assert {"psm", "spm", "plain"} == {k[2] for k in got} and out.columns[:17] == frame(spark, rows[:1]).columns
    assert fill_middle.transform(frame(spark, rows).limit(0)).count() == 0


def test_rates_and_other_units(spark):
    rows = [(i, "one two  three four") for i in range(400)]
    none = fill_middle.transform(frame(spark, rows), rate=0)
    assert none.where("form <> 'plain'").count() == 0
    some = fill_middle.transform(frame(spark, rows), rate=30, spm_rate=100, unit=r"\S*+\s++|\S++")
    forms = collections.Counter(r["form"] for r in some.collect())
    assert 60 < forms["spm"] < 180 and forms["psm"] == 0 and {r["n"] for r in some.collect()} == {4}
    back = some.select(fill_middle.rebuild(F.col("text"), F.col("form")).alias("b")).distinct().collect()
    assert [r["b"] for r in back] == ["one two  three four"]


# pipeline --------------------------------------------------------------------------

def test_pipeline_takes_edge_rows(spark):
    import corpus_pipeline as pipeline

    docs = frame(spark, EDGE).drop("n_chars").withColumn("extra", F.lit(1))
    before = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = pipeline.materialize(stage(spark, before, SF), name)
        assert after.columns == list(pipeline.COLUMNS)
        before = after
        rows = [(r["doc_id"], r["text"]) for r in after.collect()]
        if name == "quality":  # no text with an id and without a word
            assert not {1, 2, 3} & {i for i, _ in rows} and sum(i is None for i, _ in rows) == 2
        if name == "near_dedup":
            assert sum(i == 5 for i, _ in rows) == 1 and sum(i is None for i, _ in rows) == 2
        assert (7, LONG) in rows
    packed = pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in before.collect()}


def test_file_order_is_by_number(spark, tmp_path, scratch):
    import shutil

    import corpus_pipeline as pipeline

    from orderpulse.session import local_path

    base = scratch("order")
    spark.range(6).repartitionByRange(3, "id").sortWithinPartitions("id").write.parquet(f"{base}/out")
    import glob
    import os
    os.makedirs(local_path(f"{base}/in"))
    for n, f in zip((99_998, 99_999, 100_000), sorted(glob.glob(local_path(f"{base}/out/part-*.parquet"))), strict=True):
        shutil.copy(f, local_path(f"{base}/in/part-{n}-x.snappy.parquet"))
    rows = pipeline.in_file_order(spark.read.parquet(f"{base}/in")).orderBy("place").collect()
    assert [r["id"] for r in rows] == list(range(6)) and [r["place"] for r in rows] == list(range(6))


# language identification --------------------------------------------------------

def test_two_thousand_languages_in_blocks_match_brute_force(spark):
    from orderpulse.llm import language_id

    rnd = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"l{k:04d}" for k in range(2000)]
    rows = [(k, " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 6))) for _ in range(3)), names[k]) for k in range(2000)]
    rows += [(9000 + k, t, n) for k, (_, t, n) in enumerate(rows[:40])] + [(9999, None, "l0000"), (9998, "twin", "zz"), (9997, "twin", "za")]
    buckets = 1 << 10
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), buckets=buckets)
    assert model.blocks == 8 and len(model.langs) == 2002
    # the dense matrix of all languages
    langs = sorted({r[2] for r in rows})
    counts, docs = np.zeros((len(langs), buckets)), collections.Counter(r[2] for r in rows)
    for _, text, lang in rows:
        triple, pair, _ = language_id._features([text or ""], buckets)
        counts[langs.index(lang)] += np.bincount(triple, minlength=buckets) + np.bincount(pair, minlength=buckets)
    logs = np.log((counts + language_id.ALPHA) / (counts.sum(axis=1, keepdims=True) + language_id.ALPHA * buckets))
    priors = np.log([docs[x] / len(rows) for x in langs])
    dense = language_id.Model(langs, np.rint(logs * language_id.UNIT).astype(np.int32), np.rint(priors * language_id.UNIT).astype(np.int64), buckets)
    texts = [rows[5][1], rows[1500][1], "twin", None, "", "12!", PROSE] + [r[1] for r in rows[::97]]
    want = list(zip(*dense.score(texts), strict=True))
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(asked, model).collect()}
    assert [got[i][0] for i in range(len(texts))] == [w for w, _ in want] and got[2][0] == "za"
    assert np.allclose([got[i][1] for i in range(len(texts))], [s for _, s in want])


# fingerprints -------------------------------------------------------------------

def test_fingerprints_hash_all_terms_of_fixed_subsets(spark):
    from orderpulse.llm import imatch

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    codes = {r["term"]: r["code"] for r in imatch.lexicon(docs).collect()}
    split = lambda t: {w for w in re.sub(r"[^\w]|_", " ", t.lower()).split() if w}
    for r in (0, 5, 15, 30, 50):  # subsets have the density that was fixed beforehand
        share = sum(c >> r & 1 for c in codes.values()) / len(codes)
        assert abs(share - 2.0 ** -imatch.SHIFTS[r]) < 4 * math.sqrt(2.0 ** -imatch.SHIFTS[r] / len(codes)) + 1e-9
    out = {r["doc_id"]: r["fingerprint"].split(",") for r in imatch.compare_edited(docs).collect()}
    terms_in_hashes, single, hashes = 0, 0, 0
    for d in docs.collect():
        own = sorted(split(d["text"] or "") & codes.keys())
        for r, got in enumerate(out[d["doc_id"]]):
            chosen = [w for w in own if codes[w] >> r & 1]
            if got != "-" and not got.startswith("="):
                assert chosen and got == hashlib.md5(" ".join(chosen).encode()).hexdigest()[:6]
                terms_in_hashes, hashes, single = terms_in_hashes + len(chosen), hashes + 1, single + (len(chosen) == 1)
            else:
                assert not chosen
    # a hash covers about 7 terms on average, and most cover more than one
    assert terms_in_hashes / hashes > 5 and single / hashes < 0.5


# licences -----------------------------------------------------------------------

def test_notices_and_tags_are_named_rightly(spark):
    from orderpulse.llm import license_scan

    gnu = {n: license_scan.GNU_NOTICE.format(what=w, name=long_, version=v, colon=":", comma=",") for n, w, long_, v in license_scan.GNU}
    cases = [
        ("MIT", "SPDX-License-Identifier: MIT"), ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-only"),
        ("MIT", "Copyright (c) 2020 Jane Doe. Licensed under the MIT License."),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                    "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
        *gnu.items(),
        *[(n, "Copyright 2021 The Authors\n\n" + "\n\n".join(ps)) for n, ps in license_scan.WHOLE.items()],
        ("MIT", "A readme.\nWith prose: all of it long. " + PROSE + ". Released under the MIT License. " + PROSE + "."),
        (None, PROSE), (None, "The license of the driver was renewed in May."),
    ]
    out = license_scan.summarize(license_scan.scan(frame(spark, list(enumerate(t for _, t in cases)))), ["doc_id"]).collect()
    found = {r["doc_id"]: r for r in out}
    for i, (name, text) in enumerate(cases):
        # paragraphs that two licences share name one of them; the whole text is named by its own
        assert name == found[i]["best_license"] or name == "BSD-2-Clause" and name in found[i]["licenses"].split(","), (text[:60], found[i])
    assert len({n for n, _ in license_scan.TEMPLATES}) >= 20 and len({t for _, t in license_scan.TEMPLATES}) == len(license_scan.TEMPLATES)


def test_dice_matches_brute_force(spark):
    from orderpulse.llm import license_scan

    rnd = random.Random(6)
    texts = []
    for name, text in license_scan.TEMPLATES:
        words = text.replace("\n\n", " ").split(" ")
        texts.append(" ".join(w for w in words if rnd.random() > 0.06))
    hits = license_scan.scan(frame(spark, list(enumerate(texts)))).select("doc_id", F.explode("license_hits").alias("h")).collect()
    got = {r["doc_id"]: (r["h"]["license"], r["h"]["dice"]) for r in hits if r["h"]["unit"] == "line"}
    sets = [(n, set(license_scan.template_bigrams(t))) for n, t in license_scan.TEMPLATES]
    for i, text in enumerate(texts):
        own = set(license_scan.template_bigrams(text))
        dice, name = min((-2 * len(own & b) / max(1, len(own) + len(b)), n) for n, b in sets)
        assert got.get(i) == ((name, -dice) if -dice >= license_scan.THRESHOLD else None)


# top-k -----------------------------------------------------------------------------

def test_a_repeated_query_asks_once(spark):
    from orderpulse.llm import topk

    rnd = random.Random(3)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(1, 60)]
    rows += [(100, [0.5, 0.5, 0.1, 0.2])] * 2 + [(200, [0.1, 0.2, 0.3, 0.4]), (200, [0.9, 0.2, 0.3, 0.4])]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    for q in (100, 200):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert len({(v, s) for _, v, s in mine if v < 100}) == len([v for _, v, _ in mine if v < 100])
        whole = lambda x: [math.floor(1024 * c) for c in x]
        asks = min((np.array(whole(v), dtype="<i8").tobytes(), whole(v)) for i, v in rows if i == q)[1]
        scores = sorted(((-sum(a * b for a, b in zip(asks, whole(v), strict=True)), i) for i, v in rows if i != q))[:10]
        assert [(v, s) for _, v, s in mine] == [(i, -s) for s, i in scores]


# quality ---------------------------------------------------------------------------

def test_shards_follow_the_corpus_and_bound_every_group(spark, monkeypatch):
    from orderpulse.llm import quality

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    whole = {r["doc_id"]: (r["n_words"], r["keep"], round(r["perplexity"] or 0, 6)) for r in quality.classify(docs, labels).collect()}
    monkeypatch.setattr(quality, "SHARD_WORDS", 10_000)
    monkeypatch.setattr(quality, "BLOCK_CHARS", 300_000)
    blocks, drop = quality._blocks(docs, "doc_id", "text", "lang")
    shards = quality.count_shards(blocks)
    words = sum(n for n, _, _ in whole.values())
    assert shards == -(-words // 10_000) > 30
    sent = [r for b in [blocks.withColumn("trusted", F.col("ids")).toPandas()] for r in
            (x for f in quality.send_counts(iter([b]), shards) for x in f.itertuples())]
    held = collections.Counter()
    for r in sent:
        held[r.shard] += len(quality.unsqueeze_keys(r.keys))
    assert max(held.values()) <= 1.3 * 10_000              # bigrams of all blocks that meet in one group
    drop()
    split = {r["doc_id"]: (r["n_words"], r["keep"], round(r["perplexity"] or 0, 6)) for r in quality.classify(docs, labels).collect()}
    assert split == whole


def test_classifier_on_documents_that_it_never_saw(spark):
    from orderpulse.llm import quality

    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = quality._trusted(labels, "doc_id", "quality").where("held").select(F.col("tid").cast("long").alias("doc_id"))
    found = quality.classify(docs, labels).join(labels, "doc_id")
    good = found.join(held, "doc_id").agg(F.avg(F.col("keep").cast("int"))).first()[0]
    bad = found.where("quality = 0").agg(F.avg((~F.col("keep")).cast("int"))).first()[0]
    assert good > 0.97 and bad > 0.85


def test_thresholds_and_keep_match_plain_python(spark):
    from orderpulse.llm import quality

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = {int(r["tid"]) for r in quality._trusted(labels, "doc_id", "quality").where("held").collect()}
    rows = quality.classify(docs, labels).collect()
    rate = {r["doc_id"]: math.log2(r["perplexity"]) if r["n_words"] else None for r in rows}
    words = {r["doc_id"]: r["n_words"] for r in rows}

    def quantile(values, q):  # the least value with at least that share at or below it
        values = sorted(values)
        return values[max(0, math.ceil(q * len(values)) - 1)]

    def of(values):
        """Values by language, or of all where a language has too few."""
        every = [v for _, v in values]
        own = collections.defaultdict(list)
        for g, v in values:
            own[g].append(v)
        return lambda g, q: quantile(own[g] if len(own[g]) >= quality.MIN_HELD_OUT else every, q)

    known = [i for i in held if rate.get(i) is not None]
    middle = of([(lang[i] or "", rate[i]) for i in known])
    shrunk = {i: (rate[i] * words[i] + quality.PRIOR_WORDS * middle(lang[i] or "", quality.MIDDLE)) / (words[i] + quality.PRIOR_WORDS)
              for i in rate if rate[i] is not None}
    fence = of([(lang[i] or "", shrunk[i]) for i in known])
    for r in rows:
        i, g = r["doc_id"], lang[r["doc_id"]] or ""
        high = fence(g, quality.UPPER)
        limit = high + quality.MARGIN * (high - fence(g, quality.MIDDLE))
        assert abs(math.log2(r["threshold"]) - limit) < 1e-9
        assert r["keep"] == (i in shrunk and shrunk[i] <= limit + 1e-12)


# near-duplicates -----------------------------------------------------------------------

def test_recall_on_a_large_group_of_copies(spark):
    """2,000 copies with one to four edits: of the true links at least nine in
    ten lie inside a class, and no class holds two true components."""
    from orderpulse.llm import near_dup

    rnd = random.Random(7)
    words = [f"w{k}" for k in range(5000)]
    base = [rnd.choice(words) for _ in range(160)]
    docs = []
    for c in range(2000):
        text = list(base)
        for _ in range(rnd.randint(1, 4)):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        docs.append((c, " ".join(text)))
    cells = [near_dup.shingle_cells([near_dup.words(t)], 5)[0].tolist() for _, t in docs]
    seen = collections.Counter(x for own in cells for x in own)
    place = {x: k for k, x in enumerate(x for x, n in seen.items() if n > 1)}
    table = np.zeros((len(docs), len(place)), dtype=np.float32)
    for k, own in enumerate(cells):
        table[k, [place[x] for x in own if x in place]] = 1
    size = np.array([len(own) for own in cells])
    common = (table @ table.T).round()
    a, b = np.nonzero(np.triu(common >= 0.8 * (size[:, None] + size[None, :] - common) - 1e-6, 1))
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        parent[root(x)] = root(y)
    got = {r["doc_id"]: r["class_id"] for r in
           near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    same = np.mean([got[x] == got[y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    assert len(a) > 100_000 and same >= 0.99, same
    held = collections.defaultdict(set)
    for i in got:
        held[got[i]].add(root(i))
    assert all(len(v) == 1 for v in held.values())
