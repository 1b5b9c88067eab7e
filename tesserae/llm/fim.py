"""Fill-in-middle by a streaming matcher of constant memory, which goes twice over each text.

The first pass counts the text's units (by default runs of Latin letters, and every other code point). The ranks where prefix and
middle end are drawn from a hash of the document's id. The second pass advances a lazy iterator of matches to both ranks and notes
where they end; neither pass keeps a unit. Python gives three numbers for a text; the parts are cut, put in order and
restored by Spark's own string functions.

Defined cases: null counts as an empty text, which has no units and stays plain; repeated rows are transformed row by row, alike;
a row without an id draws as if its id were an empty string; a text that contains a marker stays plain; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from itertools import islice, permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: what a unit is, and the marks before prefix, suffix and middle.
UNIT, MARKERS = r"[A-Za-z]+|[^A-Za-z]", ("<P>", "<S>", "<M>")


def count(text: str, unit: re.Pattern) -> int:
    """How many units a text has."""
    last = deque(enumerate(unit.finditer(text), 1), maxlen=1)
    return last[0][0] if last else 0


def ends(text: str, unit: re.Pattern, first: int, second: int) -> tuple[int, int]:
    """Code points up to the end of unit number first, and of number second, which isn't smaller; 0 is the beginning."""
    units = unit.finditer(text)
    one = next(islice(units, first - 1, None)).end() if first else 0
    return one, next(islice(units, second - first - 1, None)).end() if second > first else one


def _cuts(pattern: str):
    """The Arrow function (text, draw, draw) -> (n, first, second); the smaller rank comes first."""

    def run(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        unit, n, first, second = re.compile(pattern), [], [], []
        for text, a, b in zip(texts, one.to_pylist(), two.to_pylist()):
            text = text.as_py()
            total = count(text, unit)
            a, b = ends(text, unit, *sorted((a % (total + 1), b % (total + 1))))
            n.append(total)
            first.append(a)
            second.append(b)
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, first, second)], ["n", "first", "second"])

    return F.arrow_udf(run, "n long, first long, second long")


def checked(markers: tuple[str, str, str]) -> tuple[str, str, str]:
    """The markers, if no text around them can make an occurrence of one that overlaps another."""
    if len(set(markers)) < 3 or not all(markers):
        raise ValueError("three different markers are needed")
    for a in markers:
        for b in markers:
            if any(b.startswith(a[-k:]) for k in range(1, len(a))):
                raise ValueError(f"{a!r} can overlap {b!r}")
    for a, b in permutations(markers, 2):
        if a in b:
            raise ValueError(f"{a!r} is part of {b!r}")
    return markers


def draws(id_: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the hash of the seed and an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, text: str = "text", id_col: str = "doc_id", seed: int = 1, unit: str = UNIT, markers: tuple[str, str, str] = MARKERS, fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row: form is plain, psm (prefix first) or spm (suffix first).

    unit must take every code point of a text; what it leaves out at the end goes to the suffix.
    """
    p, s, m = checked(markers)
    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), whole.alias("text"), _cuts(unit)(whole, h1, h2).alias("cut"), h3.alias("h3"), h4.alias("h4"))
    plain = (F.col("text") == "") | F.contains("text", F.lit(p)) | F.contains("text", F.lit(s)) | F.contains("text", F.lit(m)) | (F.col("h3") % 100 >= fim_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    first, second = F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    prefix, middle = F.substring("text", F.lit(1), first), F.substring("text", first + 1, second - first)
    suffix = F.substring("text", second + 1, F.length("text") - second)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle)).otherwise(F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle))
    cut = lambda x, name: F.when(F.col("form") != "plain", x.cast("long")).alias(name)
    return rows.withColumn("form", form).select("doc_id", F.col("cut.n").alias("n"), "form", cut(first, "prefix_chars"), cut(second - first, "middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of this form was made from; the markers tell the parts apart."""
    p, s, m = checked(markers)
    head, middle = F.split_part(output, F.lit(m), F.lit(1)), F.split_part(output, F.lit(m), F.lit(2))
    psm = F.concat(F.split_part(F.split_part(head, F.lit(s), F.lit(1)), F.lit(p), F.lit(2)), middle, F.split_part(head, F.lit(s), F.lit(2)))
    spm = F.concat(F.split_part(head, F.lit(p), F.lit(2)), middle, F.split_part(F.split_part(head, F.lit(p), F.lit(1)), F.lit(s), F.lit(2)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
