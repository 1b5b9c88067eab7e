"""Fill-in-middle against plain Python that keeps all units, round trips, and odd rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tesserae.llm import fim

ODD = [(1, None), (2, ""), (3, "one two, three\n\n four5"), (3, "one two, three\n\n four5"), (4, "é\U0001f600 日本語 x\x85y\r\n"), (5, "has a <S> mark and more"), (6, "<P"), (7, "a" * 70_000), (None, "no id at all, but text"), (None, None), (8, "ends in <"), (9, "S><M")]
ODD += [(i, f"word{i} <{'x' * (i % 7)}> and S> <M, P> {'ab, ' * (i % 13)}<") for i in range(10, 150)]


def brute(i, text):
    t = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, len(units), "plain", None, None, t
    if h[3] % 100 < 20:
        return i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_all_units(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({c: F.lit("x") for c in ("n", "form", "cut", "h3", "output", "_text")})
    out = fim.transformed(docs)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted((brute(*r) for r in ODD), key=str)
    assert {r["form"] for r in out.collect()} == {"plain", "psm", "spm"}
    assert fim.transformed(docs.limit(0)).collect() == []


def test_texts_come_back(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    for options in ({}, {"seed": 7, "fim_percent": 100, "spm_percent": 50}, {"unit": r"\w+|\W", "markers": ("[pre]", "[suf]", "[mid]")}):
        marks = {"markers": options["markers"]} if "markers" in options else {}
        out = fim.transformed(docs, **options)
        back = out.select("doc_id", fim.restored(F.col("output"), F.col("form"), **marks).alias("text")).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in back), key=str) == sorted(((i, t or "") for i, t in ODD), key=str)


def test_matcher_stops_at_its_ranks():
    unit = re.compile(fim.UNIT)
    text = "ab, cd. e"
    units = unit.findall(text)
    assert fim.count(text, unit) == len(units) == 7 and fim.count("", unit) == 0
    for a in range(8):
        for b in range(a, 8):
            assert fim.ends(text, unit, a, b) == (len("".join(units[:a])), len("".join(units[:b])))


def test_markers_that_may_overlap_are_refused():
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("aba", "c", "d"), ("<x", "x>", "y"), ("abc", "b", "d")):
        with pytest.raises(ValueError):
            fim.checked(bad)
