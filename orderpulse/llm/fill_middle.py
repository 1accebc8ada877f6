"""Fill-in-middle transformation by a counted-quantifier pattern.

A text is cut into units (lines with their end, by default). ``regexp_count``
gives their number n; hashes of the row's id choose two cuts a <= b among the
n + 1 places between units; and one match of a pattern made for the row,

    \\A ((?:unit){a}+) ((?:unit){b-a}+) (.*+) \\z

captures prefix, middle and suffix and writes them in the order of the form.
The possessive counts take the units one after the other without going back
and without a call for each of them, so that texts of many units need no deep
stack, and cost grows with the text's length. Built-in functions only: no
shuffle, no Python.

Forms: ``psm`` is ``<P>``prefix``<S>``suffix``<M>``middle, ``spm`` is
``<S>``suffix``<P>``prefix``<M>``middle, ``plain`` is the text.

Defined results: a null or empty text is plain and empty; so stays plain, as
it is, a text that contains a marker. A null id counts as an empty one in the
hash; repeated rows are transformed alike. An empty table gives an empty
result. Other columns pass through.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import isolate, restore

#: one line; possessive, as a line never ends inside another
LINE = r"[^\n]*+\n|[^\n]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50


def draws(id_: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers by the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _literal(text: str) -> str:
    """``text`` as a pattern that matches it alone."""
    return "".join(c if c.isalnum() else "\\" + c for c in text)


def cut_pattern(a: Column, b: Column, unit: str = LINE) -> Column:
    """The row's pattern: a units, b - a units, the rest."""
    return F.concat(F.lit(rf"(?s)\A((?:{unit}){{"), a.cast("string"), F.lit(rf"}}+)((?:{unit}){{"), (b - a).cast("string"),
                    F.lit(r"}+)(.*+)\z"))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE,
              spm_rate: int = SPM_RATE, unit: str = LINE) -> DataFrame:
    """``docs`` with ``text_col`` transformed, and n (units), form,
    prefix_chars and middle_chars (code points; null if plain). ``rate``
    percent of the texts are transformed, ``spm_rate`` percent of these as spm."""
    roles = {"id": id_col, "text": text_col}
    h1, h2, h3, h4 = draws(F.col("id"), seed)
    rows = isolate(docs, **roles).withColumn("text", F.coalesce("text", F.lit("")))
    marked = F.col("text").rlike("|".join(map(_literal, (PREFIX, SUFFIX, MIDDLE))))
    form = F.when((F.col("text") == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    counted = rows.withColumns({"n": F.regexp_count("text", F.lit(unit)).cast("long"), "form": form}).withColumns(
        {"h1": h1 % (F.col("n") + 1), "h2": h2 % (F.col("n") + 1)})
    order = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    cut = counted.withColumn("out", F.when(F.col("form") == "plain", F.col("text")).otherwise(
        F.regexp_replace("text", cut_pattern(F.least("h1", "h2"), F.greatest("h1", "h2"), unit), order)))
    # the markers stand once in the output, so their places give the lengths
    at = {m: F.locate(m, F.col("out")) for m in (PREFIX, SUFFIX, MIDDLE)}
    after = F.when(F.col("form") == "spm", at[MIDDLE]).otherwise(at[SUFFIX])
    change = F.col("form") != "plain"
    return restore(
        cut, docs, {"id": id_col, "out": text_col}, n=F.col("n"), form=F.col("form"),
        prefix_chars=F.when(change, (after - at[PREFIX] - len(PREFIX)).cast("long")),
        middle_chars=F.when(change, (F.char_length("out") - at[MIDDLE] - len(MIDDLE) + 1).cast("long")))


def rebuild(out: Column, form: Column) -> Column:
    """The text from an output and its form, by one match."""
    p, s, m = (_literal(x) for x in (PREFIX, SUFFIX, MIDDLE))
    psm = F.regexp_replace(out, rf"(?s)\A{p}(.*?){s}(.*?){m}(.*+)\z", "$1$3$2")
    spm = F.regexp_replace(out, rf"(?s)\A{s}(.*?){p}(.*?){m}(.*+)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(out)


def python_units(text: str, unit: str = LINE) -> list[str]:
    """The units of a text outside Spark, for files and tests."""
    return [m.group(0) for m in re.finditer(unit, text)]
