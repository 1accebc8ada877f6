"""Line dedup, packing, language identification, licences, fingerprints, pages."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from llm_cases import EDGE, LONG, PROSE, frame

from orderpulse.llm import html_text, imatch, language_id, license_scan, line_dedup, packing

SF = "/root/testdata/sf0.001"


# line dedup ---------------------------------------------------------------

def brute_lines(docs, min_chars=40, min_docs=5):
    """{row index: (n_lines, n_dropped, kept)} for (id, text) rows."""
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = collections.defaultdict(set)
    for i, text in docs:
        if i is not None:
            for line in (text or "").split("\n"):
                holders[key(line)].add(i)
    shared = {k: max(v) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or key(x) not in shared or shared[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines_match_brute_force(spark):
    rnd = random.Random(7)
    pool = [("Line number %d with ÉÀ and enough characters to count " % k) + "x" * k for k in range(12)] + ["short", "", " "]
    docs = []
    for i in range(60):
        lines = [rnd.choice(pool) for _ in range(rnd.randint(0, 9))]
        docs.append((i, "\n".join((rnd.choice(["", " ", "\t"]) + (x.upper() if rnd.random() < .2 else x)) for x in lines)))
    docs += [(3, docs[3][1]), (3, pool[0] + "\n" + pool[0]), (None, pool[0]), (77, None), (78, "\n\n")]
    got = line_dedup.dedup_lines(frame(spark, docs)).select("doc_id", "n_lines", "n_dropped", "text").collect()
    want = [(i, n, d, None if t is None else k) for (i, n, d, k), (_, t) in zip(brute_lines(docs), docs, strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert any(d for _, _, d, _ in want)


def test_lines_edges(spark):
    out = line_dedup.dedup_lines(frame(spark, EDGE))
    assert out.count() == len(EDGE)
    assert out.columns[-2:] == ["n_lines", "n_dropped"] and "kept" in out.columns  # the own n_lines replaces the old
    assert out.where("text = ''").count() == 1
    assert line_dedup.dedup_lines(frame(spark, EDGE[:0])).count() == 0


# packing ------------------------------------------------------------------

TOK = None


def path():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def test_token_ids_equal_the_library():
    from tokenizers import Tokenizer

    plain, tok = Tokenizer.from_file(path()), packing.PieceTokenizer(path())
    rnd = random.Random(3)
    texts = ["", " ", "\n", "a", " a", "\na b", "a \n b", "<|endoftext|> a", PROSE, "é漢  x", "I'll can't"]
    texts += ["".join(rnd.choice(" \n\tabIt's.,1é$%漢") for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    for got, text in zip(tok.encode(texts), texts, strict=True):
        assert list(got) == plain.encode(text, add_special_tokens=False).ids, repr(text)


def encoded(tok) -> list[str]:
    """The strings that ``tok`` hands to the library from now on."""
    seen, run = [], tok.run

    def kept(texts, **how):
        seen.extend(texts)
        return run(texts, **how)

    tok.run = kept
    return seen


def test_pieces_met_late_are_encoded_once():
    tok = packing.PieceTokenizer(path())
    tok.encode([" ".join(f"w{i}" for i in range(120_000))])
    tok.encode(["then common words"])
    seen = encoded(tok)
    tok.encode(["then words", "then common words"])
    assert seen == []


def test_a_full_table_keeps_the_most_used_pieces():
    from tokenizers import Tokenizer

    plain, tok = Tokenizer.from_file(path()), packing.PieceTokenizer(path())
    tok.room = 2_000
    rng = random.Random(7)
    for _ in range(40):
        texts = [" ".join(rng.choice(["the", "of,", "a\nb", "\u00e9t\u00e9", f"x{rng.randrange(10 ** 6)}"]) for _ in range(50)) for _ in range(4)]
        found = tok.encode(["", " ", "\n", "the", *texts])
        assert [x.tolist() for x in found] == [plain.encode(t, add_special_tokens=False).ids for t in ["", " ", "\n", "the", *texts]]
        assert tok.chars.sum() <= tok.room and len(tok.known) == len(tok.sizes) == len(tok.uses)
    seen = encoded(tok)
    tok.encode(["the the of, a\nb \u00e9t\u00e9"])
    assert seen == []


@pytest.mark.parametrize("seed", range(5))
def test_packs_hold_every_length_once(seed):
    rnd = random.Random(seed)
    histogram = {rnd.randint(1, 64): rnd.randint(1, 500) for _ in range(rnd.randint(1, 40))}
    packs = packing.plan_packs(histogram, 64)
    placed = collections.Counter()
    for lengths, count in packs:
        assert 0 < sum(lengths) <= 64 and count > 0
        for x in lengths:
            placed[x] += count
    assert placed == collections.Counter(histogram)


def test_packing_round_trip(spark):
    docs = [r for r in EDGE if r[0] is not None] + [(100 + i, PROSE * (i % 17)) for i in range(200)] + [(None, "x y")]
    found = packing.pack(frame(spark, docs), path()).collect()
    tok = packing.PieceTokenizer(path())
    ids = [np.append(x, 0).astype("<u4") for x in tok.encode([t or "" for _, t, *_ in docs])]
    want = collections.Counter()
    for (i, *_), x in zip(docs, ids, strict=True):
        for a in range(0, len(x), 1024):
            want[(i, a, len(x[a:a + 1024]), zlib.crc32(x[a:a + 1024].tobytes()), len(x))] += 1
    assert collections.Counter(tuple(r)[:5] for r in found) == want
    out = pd.DataFrame([r.asDict() for r in found])
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s["offset"]) == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 1024
    assert packing.pack(frame(spark, []), path()).count() == 0


def test_padding_is_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    total = packing.pack(docs, path()).groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    padded = total[(total & (total - 1)) != 0]
    assert (1024 - padded).sum() < 0.01 * total.sum()


# language identification ----------------------------------------------------

def test_language_held_out_accuracy(spark):
    from orderpulse.llm.queries import op9_language_id

    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = op9_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(truth, "doc_id").toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() > 0.99
    assert found["score"].between(0, 1).all()


def test_language_matches_brute_force(spark):
    train = [(1, "aa ab", "x"), (2, "ba bb", "y"), (3, "aa", "x"), (4, None, "y"), (5, "zz", None), (6, "", "x")]
    model = language_id.fit(frame(spark, [(*r, None) for r in train]))
    assert model.langs == ["x", "y"]
    triple, pair, _ = language_id._features(["aa ab", "aa", ""], language_id.BUCKETS)
    counts = np.bincount(triple, minlength=language_id.BUCKETS) + np.bincount(pair, minlength=language_id.BUCKETS)
    logs = np.log((counts + language_id.ALPHA) / (counts.sum() + language_id.ALPHA * language_id.BUCKETS))
    assert (model.weights[0] == np.rint(logs * language_id.UNIT)).all()
    langs, scores = model.score(["aa ab", "bb ba", "", None, "12 !!", LONG + " " + LONG])
    assert langs[:5] == ["x", "y", "und", "und", "und"] and list(scores[2:5]) == [0, 0, 0] and langs[5] in "xy"


def test_language_slices_do_not_change_scores(monkeypatch):
    model = language_id.Model(["x", "y"], np.random.default_rng(1).integers(-9, 0, (2, 1 << 16)), np.array([0, 0]), 1 << 16)
    texts = [PROSE, None, "a", LONG]
    before = model.score(texts)
    whole = [model.score([t]) for t in texts]
    assert [w[0][0] for w in whole] == before[0] and [w[1][0] for w in whole] == list(before[1])


def test_language_edges(spark):
    docs = frame(spark, EDGE)
    model = language_id.fit(docs)
    out = language_id.predict(docs, model, score_out="found")
    assert out.count() == len(EDGE) and "text" not in out.columns and dict(out.dtypes)["found"] == "double"
    empty = language_id.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(docs, empty).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


# licences --------------------------------------------------------------------

def test_lines_are_cut_once(spark):
    docs = frame(spark, [(k, "a line that five documents share, of forty characters\nown %d" % k) for k in range(6)])
    out = line_dedup.dedup_lines(docs)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r["n_dropped"] for r in out.orderBy("doc_id").collect()] == [1, 1, 1, 1, 1, 0]


def test_license_scan_asks_templates_only_for_hopeful_units(spark):
    rnd, docs = random.Random(4), []
    for k in range(120):
        words = rnd.choice(license_scan.TEMPLATES)[1].split()
        for _ in range(rnd.randint(0, max(1, len(words) // 6))):
            words[rnd.randrange(len(words))] = rnd.choice(["the", "of", "license", "xyz"])
        docs.append((k, " ".join(words)))
    scanned = license_scan.scan(frame(spark, docs))
    got = {r["doc_id"]: {h["dice"] for h in r["license_hits"] if h["unit"] == "line"} for r in scanned.collect()}
    sets = [set(license_scan.template_bigrams(t)) for _, t in license_scan.TEMPLATES]
    for k, text in docs:
        own = set(license_scan.template_bigrams(text))
        best = max((2 * len(own & t) / (len(own) + len(t)) for t in sets), default=0)
        assert got[k] == ({best} if best >= license_scan.THRESHOLD else set())
    assert " INSET " in scanned._jdf.queryExecution().optimizedPlan().toString()


def test_license_scan_finds_units(spark):
    mit = dict(license_scan.TEMPLATES)["MIT"]
    wrapped = "\n".join(mit[i:i + 60] for i in range(0, len(mit), 60))
    docs = [(1, f"Some prose here.\n{'Released under the MIT License.'}\nMore prose."), (2, "intro\n\n" + mit + "\n\nend"),
            (3, PROSE), (4, "RELEASED  under -- the mit license"), (5, "Licensed under CC BY 4.0."), (6, wrapped)]
    scanned = license_scan.scan(frame(spark, docs))
    out = {r["doc_id"]: r for r in license_scan.summarize(scanned, ["doc_id"]).collect()}
    assert out[1]["best_license"] == "MIT" and out[1]["best_dice"] == 1.0 and out[1]["n_hits"] == 1
    assert out[2]["licenses"] == "MIT" and out[3]["n_hits"] == 0 and out[3]["best_license"] is None
    assert out[4]["best_dice"] == 1.0 and out[5]["best_license"] == "CC-BY-4.0"
    hits = scanned.where("doc_id = 1").first()["license_hits"]
    assert [(h["unit"], h["number"]) for h in hits] == [("line", 1)]


def test_license_bounds_prune_nothing_that_matches():
    for a in range(1, 60):
        lo, hi = license_scan.size_bounds(a, 0.8)
        for b in range(1, 120):
            if 2 * min(a, b) / (a + b) >= 0.8:
                assert lo <= b <= hi


def test_license_edges(spark):
    out = license_scan.summarize(license_scan.scan(frame(spark, EDGE)), ["doc_id", "grams"])
    assert out.count() == len(EDGE) and out.agg({"n_hits": "sum"}).first()[0] == 0
    assert license_scan.scan(frame(spark, [])).count() == 0


# fingerprints ------------------------------------------------------------------

def test_fingerprint_edges(spark):
    out = imatch.compare_edited(frame(spark, EDGE)).collect()
    assert len(out) == len(EDGE)
    by_text = collections.defaultdict(set)
    order = sorted([r for r in EDGE if r[0] is not None], key=lambda r: -r[0])
    sha = {r["doc_id"]: r for r in out if r["doc_id"] not in (5, None)}
    for a, b in zip(order, order[1:], strict=False):
        if a[0] in sha and b[0] not in (5,):
            t, nx = a[1] or "", b[1] or ""
            half = len(t) // 2
            want = hashlib.sha256((t[:len(t) - half] + nx[:half]).encode()).hexdigest()
            assert sha[a[0]]["edited_sha256"] == want and sha[a[0]]["n_chars"] == len(t)
    for r in out:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    for i in (5, 6):
        by_text[PROSE] |= {r["fingerprint"] for r in out if r["doc_id"] == i}
    assert len(by_text[PROSE]) == 1
    assert imatch.compare_edited(frame(spark, [])).count() == 0


def test_only_document_is_its_own_neighbour(spark):
    r = imatch.compare_edited(frame(spark, [(4, "ab cd")])).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"ab ab").hexdigest()


def test_fingerprint_likeness_follows_the_text(spark):
    out = imatch.compare_edited(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    assert (out["near_edited"] > out["near_next"]).mean() > 0.8
    assert len(out) == 1000


# pages ----------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head>
<body class="with-sidebar"><header><p>Site name and slogan that is rather long</p></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>First  paragraph
with <b>bold</b> text &lt;here&gt;.<p>Short.</p><form><input><p>your mail</p></form><div class="ad-slot">Buy now</div>
<p>Last paragraph of the article, with enough words to count as content.</p></article>
<aside>Related things</aside><section id="comments"><article class="comment"><p>First! I liked this very much indeed.</p></article></section>
<footer>&copy; us</footer></body></html>"""


def test_page_text():
    assert html_text.main_text(PAGE) == ("Head & line\nFirst paragraph with bold text <here>.\nShort.\n"
                                         "Last paragraph of the article, with enough words to count as content.")


def test_page_without_article():
    page = ('<body><div id="sidebar">x y z</div><div class="post"><h1>T</h1><p>A long paragraph of text about the matter at '
            'hand.</p><p>Short.</p></div><div class="links"><a href="a">one</a> <a href="b">two</a></div></body>')
    assert html_text.main_text(page) == "T\nA long paragraph of text about the matter at hand.\nShort."


def sentences(n, word):
    return " ".join(f"{word}{i} is a word of this sentence." for i in range(n))


@pytest.mark.parametrize("page", [
    "<body><div class=links><a href=a>one</a> <a href=b>two</a></div><div id=post><section><p>{a}</p></section><section><p>{b}</p>"
    "</section></div></body>",
    "<body><div class=links><a href=a>one</a> <a href=b>two</a></div><section><p>{a}</p></section><section><p>{b}</p></section></body>",
    "<body><div id=post><blockquote><p>{a}</p></blockquote><p>{b}</p></div></body>",
    "<body><blockquote><p>{a}</p></blockquote><p>{b}</p></body>",
    "<body><div>menu</div><article><p>{a}</p></article><article><p>{b}</p></article></body>",
    "<body><article><p class=promo>buy<p>{a}<p>{b}</article></body>",
    "<body><article><p>{a}<div class=ad>buy</div><p class=ad>buy<div>{b}</div></article></body>",
    "<body><article><p>{a} <span class=ad>buy<p>{b}</p></article></body>",
])
def test_uneven_parts_are_all_kept(page):
    for n, m in ((17, 3), (3, 17), (30, 1)):
        a, b = sentences(n, "red"), sentences(m, "blue")
        assert html_text.main_text(page.format(a=a, b=b)) == a + "\n" + b


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"), ("<article><p>a</p><p>cut <a hre", "a\ncut"),
    ("<![CDATA[x]]>y", "y"), ("<article>" + "<p>w</p>" * 20000 + "</article>", "\n".join(["w"] * 20000)), ("<nav>menu</nav>", ""),
])
def test_page_edges(html, want):
    assert html_text.main_text(html) == want


def test_pages_table(spark):
    import html as entities
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = html_text.extract(pages).toPandas().set_index("page_id")
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", body)]
        want = "\n".join(b for b in blocks if b)
        assert out.loc[r["page_id"], "text"] == want and out.loc[r["page_id"], "n_chars"] == len(want)
    extra = spark.createDataFrame([(1, None, "old", 3), (1, PAGE, "old", 3)], "page_id long, html string, text string, rest int")
    assert sorted(len(x["text"]) for x in html_text.extract(extra).collect())[0] == 0
    assert html_text.extract(extra.limit(0)).count() == 0
