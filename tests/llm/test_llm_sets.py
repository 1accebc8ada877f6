"""Near-duplicates, exact top-k, mixing, the quality classifier, the pipeline."""

import collections
import contextlib
import io
import os
import random

import numpy as np
import pytest
from llm_cases import EDGE, LONG, PROSE, frame
from pyspark.sql import functions as F

from orderpulse.llm import common, mixing, near_dup, quality, topk

SF, SF1 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# near-duplicates -------------------------------------------------------------

def shingles(text, n=5):
    w = near_dup.words(text)
    return collections.Counter(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else None


def brute_classes(docs, threshold=0.8):
    """{id: smallest id of its class}."""
    parent = {i: i for i, _ in docs if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t), t or "") for i, t in docs if i is not None]
    for k, (i, a, s) in enumerate(sets):
        for j, b, t in sets[:k]:
            if a is None or b is None:
                near = a is None and b is None and s == t
            else:
                common = sum((a & b).values())
                near = common >= threshold * (sum(a.values()) + sum(b.values()) - common)
            if near and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in parent}


def near_copies(rnd, families=12, copies=8):
    docs, words = [], [f"w{k}" for k in range(400)]
    for f in range(families):
        base = [rnd.choice(words) for _ in range(rnd.randint(3, 160))]
        for c in range(copies):
            text = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            docs.append((1000 * (c + 1) + f, " ".join(text)))
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_match_brute_force(spark, seed):
    docs = near_copies(random.Random(seed)) + [(7, ""), (8, None), (9, "!!"), (10, "!!"), (11, PROSE), (12, PROSE), (12, "a b")]
    got = near_dup.near_duplicates(frame(spark, docs)).collect()
    want = brute_classes(docs)
    assert {r["doc_id"]: r["class_id"] for r in got} == want and len(got) == len(docs)


@pytest.mark.parametrize("options", [{"n_bands": 1, "rows": 6}, {}])
def test_no_link_is_lost_in_groups_of_far_copies(spark, options):
    """Copies of which most are no near copies of each other, also when hardly any pair shares a bucket."""
    rnd, words, docs = random.Random(3), [f"w{k}" for k in range(3000)], []
    for size, copies, least, most in ((200, 220, 3, 9), (120, 160, 2, 5), (40, 30, 1, 2)):
        base = [rnd.choice(words) for _ in range(size)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rnd.randint(least, most)):
                text[rnd.randrange(size)] = rnd.choice(words)
            docs.append((len(docs), " ".join(text)))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(frame(spark, docs), **options).collect()}
    assert got == brute_classes(docs)


def test_prefixes_of_similar_sets_share_enough():
    rnd = random.Random(11)
    for _ in range(2000):
        common, more, other = rnd.randint(1, 120), rnd.randint(0, 30), rnd.randint(0, 30)
        if common < 0.8 * (common + more + other):
            continue
        cells = rnd.sample(range(10**6), common + more + other)
        a, b = sorted(cells[:common + more]), sorted(cells[:common] + cells[common + more:])
        met = len({*a[:near_dup.prefix_size(len(a), 0.8)]} & {*b[:near_dup.prefix_size(len(b), 0.8)]})
        assert met >= max(near_dup.least_met(len(a), 0.8), near_dup.least_met(len(b), 0.8))


def test_supplied_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_darts_estimate_weighted_jaccard():
    rnd = random.Random(5)
    a = [f"w{rnd.randrange(50)}" for _ in range(600)]
    b = a[:420] + [f"v{rnd.randrange(50)}" for _ in range(180)]
    cells, counts = near_dup.shingle_cells([a, b, [], ["x"]], 1)
    s = near_dup.signatures(cells, counts, 2048)
    x, y = collections.Counter(a), collections.Counter(b)
    exact = sum((x & y).values()) / sum((x | y).values())
    assert abs((s[0] == s[1]).mean() - exact) < 0.04
    assert not s[2].any() and (s[3] != 0).all()
    again = near_dup.signatures(*near_dup.shingle_cells([b], 1), 2048)
    assert (again[0] == s[1]).all()  # a signature does not depend on its batch


def test_sparse_coordinates_are_filled():
    cells, counts = near_dup.shingle_cells([["a"], ["b", "c"]], 5)
    assert (near_dup.signatures(cells, counts, 64, spare=-3.5) == near_dup.signatures(cells, counts, 64)).all()


def test_scratch_tables_end_with_the_job(spark, monkeypatch):
    kept, paths, rounds = common._written, [], []
    monkeypatch.setattr(common, "_written", lambda df, name: paths.append((name, made := kept(df, name))) or made)
    real = near_dup._round
    monkeypatch.setattr(near_dup, "_round", lambda mixed, number: rounds.append(number) or real(mixed, number))
    text = " ".join(f"w{i}" for i in range(60))
    docs = [(1, text), (2, text + " end"), (3, text), (4, "far " * 9), (None, text)]
    out = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    left = [name for name, (_, path) in paths if os.path.exists(path.removeprefix("file:"))]
    assert len(paths) > 5 and left == ["classes"] and rounds == [1]
    assert sorted((r[0] or 0, r[1] or 0) for r in out.collect()) == [(0, 0), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_ranks_shuffle_rows_once(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else "a") for i in range(40)], "id long, source string")
    ranked = common.rank_within(rows, "source", ["id"], 8, "rank")
    got = ranked.collect()
    assert sorted(r["rank"] for r in got if r["source"] is None) == list(range(26))
    assert sorted(r["rank"] for r in got if r["source"] == "a") == list(range(14))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    with io.StringIO() as plan, contextlib.redirect_stdout(plan):
        spark.conf.set(threshold, "-1")
        common.rank_within(rows, "source", ["id"], 8, "rank").explain()
        spark.conf.set(threshold, before)
        shuffles = plan.getvalue().count("Exchange hashpartitioning")
    # the rows, and the sizes: by key and bucket, by key, and for the join
    assert shuffles <= 4


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r["node"]: r["label"] for r in near_dup.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}


def test_keep_one(spark):
    out = near_dup.keep_one(frame(spark, EDGE))
    kept = sorted((r["doc_id"] for r in out.collect()), key=repr)
    assert [i for i in kept if i is not None] == sorted({r[0] for r in EDGE} - {None, 2, 6}, key=repr)
    assert kept.count(None) == 2 and "gone" in out.columns
    assert near_dup.keep_one(frame(spark, [])).count() == 0


# exact top-k ------------------------------------------------------------------

def brute_top(rows, k=10):
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ints = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in good]
    out = []
    for q, a in ints:
        if q % 100 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ints if i != q and len(a) == len(b))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * rng.choice([0.01, 1, 1, 40])]) for i in range(400)]
    rows += [(400 + i, rows[200][1]) for i in range(30)] + [(600, None), (700, [None] * 6), (800, [float("nan")] * 6)]
    rows += [(900, [0.0] * 6), (901, [1.0, 2.0]), (1000, [3.0, -1.0]), (None, rows[0][1]), (1001, []), (1100, [float("inf")] * 6)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, id int, block int")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect())
    assert got == brute_top(rows)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_prunes_by_coordinates_without_loss(monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8)) * 900
    vectors = np.floor(np.concatenate([c + rng.normal(size=(60, 8)) * 30 for c in centres])).astype(np.int64)
    ids = np.arange(len(vectors))
    monkeypatch.setattr(topk, "BUCKET_ROWS", 100)
    calls = []
    inner = topk.within_range
    monkeypatch.setattr(topk, "within_range", lambda *a: calls.append(len(a[2].ids)) or inner(*a))
    found = topk.search(ids[::50], vectors[::50], topk.buckets(ids, vectors), 10)
    scores = vectors[::50] @ vectors.T
    for q, own in zip(ids[::50], scores, strict=True):
        order = [i for i in np.lexsort((ids, -own)) if i != q][:10]
        assert [(v, s) for p, v, s in found if p == q] == [(i, own[i]) for i in order]
    assert calls


def test_products_beyond_doubles():
    big = np.array([[1 << 40, 3]], dtype=np.int64)
    assert topk.products(big, big)[0, 0] == 2 ** 63 - 1
    mid = np.array([[1 << 28, 3]], dtype=np.int64)
    assert topk.products(mid, mid)[0, 0] == (1 << 56) + 9


# mixing ------------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(20))
def test_pfair_deviation_is_below_one_block(seed):
    rnd = random.Random(seed)
    blocks = {f"s{i}": rnd.randint(0, 400) for i in range(rnd.randint(1, 9))}
    phases = mixing.plan(blocks, {s: rnd.random() + 0.01 for s in blocks}, 64)
    for phase in phases:
        placed = collections.Counter()
        for t, s in enumerate(phase.order, 1):
            placed[s] += 1
            for other, m in phase.slots.items():
                assert abs(placed[other] - t * m / phase.period) < 1


def test_mixture_is_whole_and_ordered(spark):
    docs = [(i, "t", None, f"s{min(i % 7, 3)}" if i % 11 else None) for i in range(3000)]
    out = mixing.mix(frame(spark, docs), {"s0": 1.0, "s3": 2.0, "s1": 0.0}, block_docs=4, period=128).toPandas()
    assert sorted(out["doc_id"]) == list(range(3000)) and "spot" in out.columns
    per_slot = out.groupby("mix_slot")
    assert (per_slot["source"].nunique(dropna=False) == 1).all() and (per_slot["mix_offset"].max() < 4).all()
    assert sorted(out["mix_slot"].unique()) == list(range(out["mix_slot"].max() + 1))
    ranks = out.groupby("source", dropna=False)["source_rank"].apply(lambda x: sorted(x) == list(range(len(x))))
    assert ranks.all()
    again = mixing.mix(frame(spark, docs[::-1]), {"s0": 1.0, "s3": 2.0, "s1": 0.0}, block_docs=4, period=128).toPandas()
    assert (out.set_index("doc_id")["mix_slot"].sort_index() == again.set_index("doc_id")["mix_slot"].sort_index()).all()


def test_weights_hold_exactly_over_many_periods(spark):
    sources = [f"s{i}" for i in range(20) for _ in range(400)] + ["rare"] * 3
    weights = {f"s{i}": 1.0 for i in range(20)} | {"rare": 0.005}
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(sources)], "doc_id long, source string")
    out = mixing.mix(docs, weights, block_docs=1, period=64).toPandas().sort_values("mix_slot")
    assert list(out["mix_slot"]) == list(range(len(sources)))
    first = out["target_share"].map(lambda x: min(abs(x - w / 20.005) for w in weights.values())) < 1e-12
    whole = int(np.argmin(first)) if not first.all() else len(out)  # slots before a source runs out
    assert whole > 7900
    for s, w in weights.items():
        placed = (out["source"].to_numpy()[:whole] == s).cumsum()
        assert np.abs(placed - np.arange(1, whole + 1) * w / 20.005).max() < 1


@pytest.mark.parametrize("seed", range(5))
def test_states_give_the_whole_schedule(seed):
    rnd = random.Random(seed)
    blocks = {f"s{i}": rnd.randint(0, 300) for i in range(9)} | {None: 7}
    weights = {s: rnd.choice([0.003, 1, rnd.random()]) + 1e-9 for s in blocks}
    phases = mixing.plan(blocks, weights)
    order = [s for phase in phases for s in phase.order]
    share = [phase.slots[s] / phase.period for phase in phases for s in phase.order]
    assert collections.Counter(order) == collections.Counter({s: n for s, n in blocks.items() if n})
    states = mixing.States(blocks, weights, 32)
    for s, i in states.number.items():
        slot, found = states.find(i, np.arange(blocks[s]), states.part)
        assert [order[t] for t in slot] == [s] * blocks[s] and (np.diff(slot) > 0).all()
        assert [share[t] for t in slot] == list(found)


def test_mixing_edges(spark):
    assert mixing.mix(frame(spark, EDGE)).count() == len(EDGE)
    assert mixing.mix(frame(spark, [])).count() == 0


# quality ---------------------------------------------------------------------------

def brute_bits(train_texts, text):
    """Total bits of a text under the same model, from plain dictionaries."""
    def pairs(t):
        ids, _ = quality.word_ids([t])
        return list(zip([0, *ids[:-1]], ids, strict=False))

    c = collections.Counter(p for t in train_texts for p in pairs(t))
    context, follows = collections.Counter(), collections.Counter()
    kinds = collections.defaultdict(collections.Counter)
    for (a, b), n in c.items():
        context[a] += n
        follows[b] += 1
        kinds[a][min(n, 3)] += 1
    d = quality.discounts([sum(n == i for n in c.values()) for i in (1, 2, 3, 4)])
    low = quality.discounts([sum(n == i for n in follows.values()) for i in (1, 2, 3, 4)])
    total = max(1, sum(follows.values()))
    mass = sum(low[min(n, 3)] for n in follows.values()) / total
    bits = 0.0
    for a, b in pairs(text):
        unigram = max(follows[b] - low[min(follows[b], 3)], 0) / total + mass / quality.VOCAB
        spare = sum(d[k] * n for k, n in kinds[a].items()) / context[a] if context[a] else 1.0
        own = max(c[a, b] - d[min(c[a, b], 3)], 0) / max(context[a], 1)
        bits -= np.log2(own + spare * unigram)
    return bits


def test_perplexity_matches_brute_force(spark):
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rnd.choice(words[:rnd.choice([5, 60])]) for _ in range(rnd.randint(0, 60))) for _ in range(120)]
    docs = frame(spark, [(i, t, "en", None) for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, i % 3 and 1, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    trusted = quality._trusted(labels, "doc_id", "quality")
    held = {int(r["tid"]): r["held"] for r in trusted.collect()}
    training = [texts[i] for i in held if not held[i]]
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 120
    for i in range(0, 120, 7):
        n = len(texts[i].split())
        assert got[i]["n_words"] == n
        if n:
            assert abs(np.log2(got[i]["perplexity"]) - brute_bits(training, texts[i]) / n) < 1e-6


def test_keys_and_codecs():
    keys = np.random.default_rng(0).integers(0, 1 << 40, 5000).astype(np.uint64)
    assert (quality.unmix(quality.mix(keys)) == keys).all() and len(np.unique(quality.mix(np.unique(keys)))) == len(np.unique(keys))
    keys.sort()
    assert (quality.unsqueeze_keys(quality.squeeze_keys(keys)) == keys).all()
    assert len(quality.unsqueeze(quality.squeeze(np.zeros(0, np.int64)))) == 0


def test_runs_of_a_word_have_their_own_ids():
    ids, n = quality.word_ids(["a a, a b", "b b", None, ""])
    assert list(n) == [4, 2, 0, 0] and list(ids[1:3]) == [1, 2] and ids[0] >= quality.FIRST_WORD
    assert ids[4] == ids[3] and ids[5] == 1


def test_classifier_on_the_labels(spark):
    labels = spark.read.parquet(f"{SF1}/labels.parquet")
    found = quality.classify(spark.read.parquet(f"{SF1}/documents.parquet"), labels).join(labels, "doc_id").toPandas()
    good, bad = found[found["quality"] == 1], found[found["quality"] == 0]
    assert good["keep"].mean() > 0.99 and (~bad["keep"]).mean() > 0.85


def test_quality_edges(spark):
    labels = spark.createDataFrame([(5, 1), (5, 1), (9, 1), (9, 0), (None, 1)], "doc_id long, quality int")
    docs = frame(spark, EDGE)
    out = {(r["doc_id"], r["n_words"]): r["keep"] for r in quality.classify(docs, labels).collect()}
    assert quality.classify(docs, labels).count() == len(EDGE)
    assert out[1, 0] is False and out[2, 0] is False and out[5, len(PROSE.split())] is True
    none = quality.classify(docs, labels.limit(0))
    assert none.where("n_words > 0 and not keep").count() == 0
    assert quality.classify(docs.limit(0), labels).count() == 0
    kept = quality.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 2
    assert kept.where("doc_id = 7").first()["text"] == LONG


# pipeline ------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, ids = docs, {r["doc_id"] for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        after = pipeline.materialize(stage(spark, before, SF), name)
        assert after.columns == docs.columns
        now = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert now <= ids and after.count() == len(now)
        if name == "mixing":
            assert now == ids
            in_files = after.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index")
            rank = [r["doc_id"] for r in in_files.collect()]
            want = mixing.mix(before).orderBy("mix_slot", "mix_offset").select("doc_id").collect()
            assert rank == [r["doc_id"] for r in want]
        if name == "near_dedup":
            assert len(set(brute_classes([(r["doc_id"], r["text"]) for r in before.collect()]).values())) == len(now)
        before, ids = after, now
    packed = pipeline.STAGES[-1][1](spark, before, SF)
    assert {r["doc_id"] for r in packed.collect()} == ids
    assert pipeline.run(spark, SF).count() == packed.count()


def test_mixture_reaches_the_sequences(spark, monkeypatch):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*pipeline.COLUMNS)

    def packed(before):
        rows = pipeline.pack_sequences(spark, pipeline.materialize(before, "mixed"), SF).collect()
        return {(r["doc_id"], r["start"]): (r["sequence_id"], r["offset"], r["length"], r["ids_crc32"]) for r in rows}

    first, inner = docs.select("source").first()[0], mixing.mix
    monkeypatch.setattr(mixing, "mix", lambda d, weights=None: inner(d, weights, block_docs=1))  # the table is small
    mixed = packed(pipeline.mix_sources(spark, docs, SF))
    order = mixing.mix(docs).orderBy("mix_slot", "mix_offset").select("doc_id").collect()
    place = {r["doc_id"]: n for n, r in enumerate(order)}
    firsts, filled = {}, collections.defaultdict(list)
    for (doc_id, _), (sequence, offset, length, _) in mixed.items():
        firsts[sequence] = min(place[doc_id], firsts.get(sequence, len(place)))
        filled[sequence].append((offset, length))
    assert [firsts[k] for k in range(len(firsts))] == sorted(firsts.values())
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 1024
    plain = packed(docs)  # the stage left out
    monkeypatch.setattr(mixing, "mix", lambda d: inner(d, {first: 50.0, "other": 1.0}, block_docs=1))
    other = packed(pipeline.mix_sources(spark, docs, SF))
    assert mixed.keys() == plain.keys() == other.keys()
    assert all(mixed[k][2:] == plain[k][2:] == other[k][2:] for k in mixed)
    assert sum(mixed[k] != plain[k] for k in mixed) > len(mixed) / 2
    assert sum(mixed[k] != other[k] for k in mixed) > len(mixed) / 2


def test_sequences_take_their_pieces_from_one_part_of_the_order(spark):
    from public_tokenizers import path

    from orderpulse.llm import packing

    rnd = random.Random(3)
    docs = [(i, " ".join(["word"] * 23 * rnd.randint(1, 20)), None if i > 1990 else i) for i in range(2000)]
    frame_ = spark.createDataFrame(docs, "doc_id long, text string, at long")
    out = packing.pack(frame_, path("byte_bpe_50k.json"), order_col="at").toPandas()
    assert sorted(out["doc_id"]) == list(range(2000))
    assert (out.groupby("sequence_id")["length"].sum() <= 1024).all()
    firsts = out.groupby("sequence_id")["doc_id"].min()
    assert list(firsts.index) == list(range(len(firsts))) and firsts.is_monotonic_increasing
    assert np.corrcoef(out["doc_id"], out["sequence_id"])[0, 1] > 0.8, np.corrcoef(out["doc_id"], out["sequence_id"])
    assert packing.pack(frame_.limit(0), path("byte_bpe_50k.json"), order_col="at").count() == 0


def test_pipeline_takes_empty_documents(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
