"""Document fingerprints by I-Match with randomised lexicons.

The lexicon holds the terms whose document frequency lies in a band, that is
within a band of inverse document frequency. Its size has a bound that does
not depend on the number of documents: a document has some average number
``m`` of distinct terms, each lexicon term is in at least ``LOW`` of the
documents, so there are at most ``m / LOW`` of them. That is what makes the
broadcast of the lexicon safe.

The lexicon has ``len(SHIFTS)`` random subsets, the draws, each of a density
fixed beforehand, 1/4 to 1/4096, for texts of few and of very many terms. For
each draw a text's distinct terms in the subset are sorted and hashed, all of
them; a draw without a term of the text has no hash. The likeness of two texts
is the share of equal hashes among the draws in which either has one; it is 1
for equal texts. A hash is equal when all its terms are, so a sparse draw
survives edits that a dense one does not.

Built-in functions only. ``with_neighbour`` pairs every document with the
next one in descending id order without a global sort: ids are cut into
ranges by an aggregate over equal cells, each range is one window group, and
the greatest id of a range also visits the range above as a guest (the
greatest of all visits the lowest range, which closes the ring). The text is
shuffled once; the lexicon join, the grouping and both windows reuse that
partitioning.

Defined results: a null text is empty. A text without a term in any draw gets
its own hash in every one, so it is like equal texts only. Rows that repeat an
id are ordered by a hash of their text; null ids come last. An only document
is its own neighbour. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.llm.common import shuffle_partitions

LOW, HIGH = 0.001, 0.25
#: density of each draw, as a power of 1/2
SHIFTS = [2] * 4 + [4] * 8 + [6] * 16 + [8] * 16 + [10] * 12 + [12] * 4
#: the first draws, which look at all lexicon terms of a text; few terms are in any of the others
DENSE = 12
DRAWS = len(SHIFTS)
MAX_CELLS = 1 << 16


def terms(text: Column) -> Column:
    """Distinct lower-case words."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term, code): terms in the band; bit r of ``code`` tells whether the
    term is in draw r, by three hex digits of an MD5 of the term."""
    n = docs.count()
    counted = (docs.select(F.explode(terms(F.col(text_col))).alias("term"))
               .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    band = counted.where((F.col("df") >= low * n) & (F.col("df") <= max(1.0, high * n)))
    digests = [F.md5(F.concat(F.lit(f"{i} "), F.col("term"))) for i in range(-(-DRAWS // 10))]
    code = F.lit(0).cast("long")
    for draw, shift in enumerate(SHIFTS):
        value = F.conv(F.substring(digests[draw // 10], 3 * (draw % 10) + 1, 3), 16, 10).cast("int")
        code = code.bitwiseOR(F.when(value < 4096 >> shift, F.lit(1 << draw)).otherwise(0))
    return band.select("term", code.alias("code"))


def fingerprint(found: str, own: str) -> Column:
    """Hash per draw, joined by commas, '-' for a draw without a term.
    ``found``: sorted array of (term, code); ``own``: digest of the text."""
    def hashes(rows: str, first: int, last: int) -> str:
        return f"""transform(sequence({first}, {last}), r -> transform(
            array(filter({rows}, t -> (shiftright(t.code, r) & 1) = 1)),
            s -> if(size(s) = 0, '-', substr(md5(array_join(transform(s, t -> t.term), ' ')), 1, 6)))[0])"""

    sparse = f"filter({found}, t -> shiftright(t.code, {DENSE}) <> 0)"
    every = f"concat({hashes(found, 0, DENSE - 1)}, transform(array({sparse}), f -> {hashes('f', DENSE, DRAWS - 1)})[0])"
    return F.expr(f"""transform(array({every}), h -> if(exists(h, x -> x <> '-'), array_join(h, ','),
        array_join(array_repeat(concat('=', substr({own}, 1, 6)), {DRAWS}), ',')))[0]""")


def likeness(a: Column, b: Column) -> Column:
    pairs = F.filter(F.arrays_zip(F.split(a, ",").alias("a"), F.split(b, ",").alias("b")), lambda p: (p["a"] != "-") | (p["b"] != "-"))
    return F.size(F.filter(pairs, lambda p: p["a"] == p["b"])) / F.size(pairs).cast("double")


def _ranges(docs: DataFrame, id_col: str, parts: int) -> tuple[Column, Column]:
    """(range of a row, whether it is the greatest id of its range), from
    counts over equal cells of the id span."""
    low, high, n = docs.agg(F.min(id_col), F.max(id_col), F.count(id_col)).first()
    if not n:
        return F.lit(0), F.lit(False)
    cells = int(min(MAX_CELLS, 16 * parts))
    width = max(1.0, (float(high) - float(low)) / cells)
    position = (F.col(id_col).cast("double") - F.lit(float(low))) / F.lit(width)
    cell = F.coalesce(F.least(F.floor(position), F.lit(cells - 1)).cast("int"), F.lit(0))
    found = docs.where(F.col(id_col).isNotNull()).groupBy(cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.max(id_col).alias("top")).orderBy("cell").collect()  # at most ``cells`` rows
    range_of, tops, filled, at = [0] * cells, [], 0, 0
    share = max(1, n // parts)
    for row in found:
        if filled >= share:
            filled, at = 0, at + 1
        filled += row["n"]
        range_of[row["cell"]] = at
        tops[at:] = [row["top"]]
    constant = lambda values, kind: F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")
    place = F.get(constant(range_of, "int"), cell)
    return place, F.coalesce(F.get(constant(tops, "bigint"), place) == F.col(id_col), F.lit(False))


def with_neighbour(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, rn, guest, id, text, next_text): each row beside the next one in
    descending id order; ``guest`` rows only close the ranges."""
    parts = 4 * shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    place, is_top = _ranges(rows, "id", parts)
    last = rows.select(place.alias("p")).agg(F.max("p")).first()[0] or 0
    visits = F.when(is_top, F.array(F.struct(place.alias("part"), F.lit(0).alias("guest")),
                                    F.struct(F.pmod(place + 1, F.lit(last + 1)).alias("part"), F.lit(1).alias("guest")))
                    ).otherwise(F.array(F.struct(place.alias("part"), F.lit(0).alias("guest"))))
    dealt = rows.select("id", "text", F.inline(visits).alias("part", "guest"))
    ring = Window.partitionBy("part").orderBy("guest", F.desc_nulls_last("id"), F.xxhash64("text"))
    return dealt.select("part", F.row_number().over(ring).alias("rn"), "guest", "id", "text",
                        F.coalesce(F.lead("text").over(ring), F.lit("")).alias("next_text"))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW,
                   high: float = HIGH) -> DataFrame:
    """Per document: n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next, where the edited text has the second half
    replaced by the beginning of the next document's text."""
    known = lexicon(docs, text_col, low, high)
    beside = with_neighbour(docs, id_col, text_col)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    texts = beside.select("part", "rn", "guest", "id", n.alias("n_chars"), F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")),
        F.struct(F.lit(1).alias("kind"), edited.alias("t")))).alias("v"))
    # one row per term; the digest travels once, in a row without a term
    marked = texts.select(
        "part", "rn", "guest", "id", "n_chars", F.col("v.kind").alias("kind"),
        F.inline(F.concat(
            F.array(F.struct(F.lit(None).cast("string").alias("term"), F.sha2("v.t", 256).alias("sha"))),
            F.transform(terms(F.col("v.t")), lambda w: F.struct(w.alias("term"), F.lit(None).cast("string").alias("sha"))),
        )).alias("term", "sha"))
    found = marked.join(F.broadcast(known), "term", "left").where(F.col("sha").isNotNull() | F.col("code").isNotNull())
    per_text = found.groupBy("part", "rn", "kind").agg(
        F.first("guest").alias("guest"), F.first("id").alias("id"), F.first("n_chars").alias("n_chars"),
        F.max("sha").alias("sha"),
        F.sort_array(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("term", "code")))).alias("found"))
    prints = per_text.withColumn("fp", fingerprint("found", "sha"))
    one = prints.groupBy("part", "rn").agg(
        F.first("guest").alias("guest"), F.first("id").alias(id_col), F.first("n_chars").cast("long").alias("n_chars"),
        F.max(F.when(F.col("kind") == 1, F.col("sha"))).alias("edited_sha256"),
        F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fingerprint"),
        F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fingerprint"))
    ring = Window.partitionBy("part").orderBy("rn")
    return (one.withColumn("_next", F.lead("fingerprint").over(ring)).where("guest = 0").select(
        id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next")))
