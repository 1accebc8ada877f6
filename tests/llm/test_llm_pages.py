"""The region of a page follows from the text-to-tag cluster; names only exclude."""

import math
import random

import pytest

from orderpulse.llm import html_text

SENTENCE = "This is a sentence with enough words in it to count as the running text of a story on a page."


def body(*parts):
    return "<html><body>" + "".join(parts) + "</body></html>"


def p(n, tag="p"):
    return "".join(f"<{tag}>{SENTENCE} {i}</{tag}>" for i in range(n))


def lines(n):
    return "\n".join(f"{SENTENCE} {i}" for i in range(n))


LINKS = "".join(f"<div><b>Item {i}</b> <i>x</i> <u>y</u></div>" for i in range(12))  # short, full of tags, no link
PAGES = [
    body(f"<div>{LINKS}</div>", f"<div>{p(6)}</div>", f"<div>{LINKS}</div>"),
    body(f"<section>{LINKS}</section>", f"<section><div><h1>Short headline</h1>{p(4)}</div></section>"),
    body(f"<div><div>{LINKS}</div><div>{p(9, 'div')}</div></div>"),
]


def test_the_cluster_selects_the_lines(monkeypatch):
    by_cluster = [html_text.main_text(h) for h in PAGES]
    assert by_cluster == [lines(6), "Short headline\n" + lines(4), lines(9)]
    monkeypatch.setattr(html_text, "cluster", lambda own: html_text.np.ones(len(own), dtype=bool))
    assert all(a != b for a, b in zip(by_cluster, (html_text.main_text(h) for h in PAGES), strict=True))


def plain_cluster(rows, sigma=html_text.SIGMA):
    """Text-to-tag ratios, Gaussian smoothing and the threshold, number by number."""
    ratios = [len(text) / max(1, tags) for text, tags in rows]
    radius = max(1, math.ceil(2 * sigma))
    smoothed = []
    for i in range(len(ratios)):
        near = [(ratios[j], math.exp(-0.5 * ((i - j) / sigma) ** 2)) for j in range(max(0, i - radius), min(len(ratios), i + radius + 1))]
        smoothed.append(sum(r * w for r, w in near) / sum(w for _, w in near))
    mean = sum(smoothed) / len(smoothed)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in smoothed) / len(smoothed))
    chosen = [x >= deviation for x in smoothed]
    return smoothed, chosen if any(chosen) else [True] * len(chosen)


@pytest.mark.parametrize("seed", range(5))
def test_ratio_smoothing_and_threshold_match_plain_python(seed):
    rnd = random.Random(seed)
    rows = [("x" * rnd.choice([1, 5, 40, 300]), rnd.choice([0, 1, 2, 9])) for _ in range(rnd.randint(1, 60))]
    smoothed, chosen = plain_cluster(rows)
    own = [html_text.Line(text, tags, 0, ()) for text, tags in rows]
    ratios = html_text.np.array([len(t) / max(1, n) for t, n in rows], dtype=float)
    assert html_text.np.allclose(html_text.smooth(ratios), smoothed)
    assert list(html_text.cluster(own)) == chosen


@pytest.mark.parametrize("html, want", [
    # content beside the article, in a plain element
    (body(f"<article>{p(12)}</article>", f"<div>{p(3)}</div>"), lines(12) + "\n" + lines(3)),
    # a teaser elsewhere, though it is an article as well
    (body(f"<main><article>{p(6)}</article></main>", "<section><article class='teaser'><a href='/o'>Other story</a></article></section>"), lines(6)),
    # names of which only one word is a word of page furniture
    (body(f"<article>{p(3)}<div class='share-of-market'><p>{SENTENCE}</p></div><section id='related-work'><p>{SENTENCE}</p></section></article>"),
     lines(3) + f"\n{SENTENCE}\n{SENTENCE}"),
    (body(f"<article>{p(3)}<p>I said <label>this</label> and pressed <button>OK</button> to go.</p></article>"),
     lines(3) + "\nI said this and pressed OK to go."),
    # furniture by compound names, and controls that are no running text
    (body(f"<article>{p(5)}<div class='share-buttons'><p>{SENTENCE}</p></div><div id='related-posts'><p>{SENTENCE}</p></div>"
          f"<div class='post-comments'><p>{SENTENCE}</p></div><button>Send</button><label>Name</label></article>"), lines(5)),
])
def test_hand_made_pages(html, want):
    assert html_text.main_text(html) == want
