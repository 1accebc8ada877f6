"""Rows that every operator must take: nulls, empty and long texts, repeated
rows, and extra columns whose names clash with the operators' own."""

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, rest int, pos int, key string, "
          "gone long, rank int, spot int, grams string, found string, lines array<string>, n_lines long, kept string")
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
PROSE = "the quick brown fox jumps over the lazy dog and runs far away into the dark green wood tonight"


def rows(pairs):
    """(doc_id, text[, lang, source]) rows with the clashing columns filled."""
    out = []
    for r in pairs:
        doc_id, text, lang, source = (*r, None, None)[:4] if len(r) < 4 else r
        out.append((doc_id, text, lang, source, None if text is None else len(text), "x", 1, 2, "k", 3, 4, 5, "g", "f",
                    ["l"], 99, "kept"))
    return out


def frame(spark, pairs):
    return spark.createDataFrame(rows(pairs), SCHEMA)


EDGE = [
    (1, None), (2, ""), (3, "   "), (4, "!!! ???"), (5, PROSE, "en", "a"), (5, PROSE, "en", "a"), (6, PROSE, "en", "a"),
    (7, LONG, "en", "b"), (None, PROSE, "en", None), (None, None), (8, "one", None, "b"), (9, "ein zwei drei", "de", "c"),
    (2 ** 60 + 1, "ß É\tx\r\ny", "de", None), (10, PROSE + " " + PROSE.upper(), "en", "a"),
]
