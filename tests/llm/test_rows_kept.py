"""What stages do to single rows: repeated ids with other texts, rows without an id, many spans in one text; and links at any distance."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import common, quality_model, secrets, simhash

SCHEMA = "doc_id long, text string, spans string, _row int, tokens string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_each_row_is_redacted_by_its_own_spans(spark):
    rows = [(1, "token=abcdef123456 x"), (1, "hello world this is long token=zzzzzz999999"), (None, "password=hunter2222"), (2, "clean é words"), (3, None), (4, "")]
    out = secrets.redacted(rows_of(spark, rows))
    assert out.columns == ["doc_id", "text", "spans", "_row", "tokens"]
    assert texts(out) == sorted([(1, "[secret] x"), (1, "hello world this is long [secret]"), (None, "[secret]"), (2, "clean é words"), (3, None), (4, "")], key=str)


def test_redaction_against_plain_cuts(spark):
    r = random.Random(4)
    parts = ["token=abcdef{}", "é word", "AKIA" + "Q7" * 9, "0123456789abcdef" * 2, "password: secret=hunter{}x", "api_key='k{}' tail", "\n", "日本語", "0123456789abcdef01234567api_key=xyzxyz{}"]
    rows = [(i, " ".join(r.choice(parts).format(k) for k in range(n))) for i, n in enumerate([0, 1, 5, 30, 700, 1500])]
    docs = rows_of(spark, rows)
    spans = {x["doc_id"]: x["spans"] for x in secrets.scanned(docs).collect()}
    want = []
    for i, t in rows:
        out, at = [], 0
        for s in spans[i]:
            if s["start"] >= at:
                out += [t[at : s["start"]], "[secret]"]
            at = max(at, s["end"])
        want.append((i, "".join(out) + t[at:]))
    assert texts(secrets.redacted(docs)) == sorted(want, key=str)


def test_pieces_are_what_base_spans_leave(spark):
    r, cases = random.Random(6), []
    for i in range(60):
        cuts = sorted(r.sample(range(200), 2 * r.randint(0, 6)))
        tokens = [(a, b, "x" * (b - a)) for a, b in zip(cuts[::2], cuts[1::2])]
        base = [(a, a + r.randint(1, 40), "") for a in r.sample(range(190), r.randint(0, 5))]
        cases.append((i, tokens, sorted(base, key=lambda s: s[1])))
    span = "array<struct<start:bigint,end:bigint,value:string>>"
    got = {x["i"]: [tuple(p) for p in x["pieces"]] for x in secrets.pieces(spark.createDataFrame(cases, f"i int, tokens {span}, _base {span}")).collect()}
    for i, tokens, base in cases:
        covered = {c for a, b, _ in base for c in range(a, b)}
        free = lambda c, t: t[0] <= c < t[1] and c not in covered
        pairs = []
        for k, t in enumerate(tokens, 1):
            inside = [c for c in range(t[0], t[1]) if free(c, t)]
            starts = [c for c in inside if not free(c - 1, t)]
            pairs += [(k, a, next(c for c in range(a, t[1] + 1) if not free(c, t))) for a in starts]
        merged = []  # a base span that begins inside covered text cuts nothing
        for k, a, b in got[i]:
            if merged and merged[-1][0] == k and merged[-1][2] == a:
                merged[-1] = (k, merged[-1][1], b)
            else:
                merged.append((k, a, b))
        assert merged == (pairs if base else [])


def test_time_follows_the_number_of_spans(spark):
    import time

    took = []
    for n in (2_000, 2_000, 16_000):
        one = spark.createDataFrame([(1, " ".join(f"token=abc{i}def0123 identifier_number_{i}x" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        assert len(secrets.scanned(one).first()["spans"]) == n
        took.append(time.time() - began)
    assert took[2] < 4 * took[1] + 5  # it was 4 times for each doubling


def test_one_row_of_a_component_and_no_other_text_goes(spark):
    prose = " ".join(f"w{i % 37}x{i % 11}" for i in range(120))
    other = " ".join(f"v{i % 29}y{i % 13}" for i in range(120))
    rows = [(5, prose), (5, other), (6, prose), (5, prose), (None, prose), (None, other), (7, None), (8, ""), (9, other.upper())]
    out = texts(simhash.keep_one(rows_of(spark, rows)))
    assert out == sorted([(5, prose), (5, other), (None, prose), (None, other), (7, None)], key=str)


def test_each_row_is_judged_by_its_own_text(spark):
    good = [" ".join(f"plain{(i * k) % 41} words" for i in range(60)) + "." for k in range(1, 30)]
    bad = ["| # $ % WIN WIN WIN " * k + "!!!" for k in range(5, 34)]
    rows = [(i, t) for i, t in enumerate(good)] + [(100 + i, t) for i, t in enumerate(bad)]
    extra = [(3, bad[2]), (101, good[4]), (None, bad[5]), (None, None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows + extra], "doc_id long, text string, _features double").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows if i not in (3, 101)], "doc_id long, quality int")
    out = quality_model.keep_good(docs, labels)
    assert out.columns == docs.columns and texts(out) == sorted(rows[: len(good)] + extra[1:], key=str)


@pytest.mark.parametrize("distance", range(1, 9))
def test_links_at_every_distance(spark, distance):
    r = np.random.default_rng(distance)
    base = r.integers(0, 1 << 64, 700, np.uint64)
    near = [f ^ np.bitwise_or.reduce(np.uint64(1) << r.choice(64, d, False).astype(np.uint64)) for f in base[:440] for d in (distance - 1, distance, distance + 1) if d]
    fps = np.unique(np.concatenate([base, near, [0], [sum(1 << b for b in (0, 1, 22, 23, 43, 44))]]).astype(np.uint64))
    comp = {x["node"]: x["component"] for x in common.connected_components(simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), distance)).collect()}
    label = np.arange(len(fps))
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
    while True:  # the least number spreads along links
        new = np.array([label[c].min() for c in close])
        if (new == label).all():
            break
        label = new
    own = [comp.get(int(x), int(x)) for x in fps.view(np.int64)]
    assert len(set(zip(label.tolist(), own))) == len(set(label.tolist())) == len(set(own))


def test_segments_cover_every_distance():
    for distance in (0, 1, 4, 6, 8, 12):
        for n in (1, 1000, 10**6, 10**9):
            parts = simhash.segments(distance, n)
            assert sum(r + 1 for _, _, r in parts) == distance + 1
            assert [p[0] for p in parts] == np.cumsum([0] + [p[1] for p in parts])[:-1].tolist() and sum(p[1] for p in parts) == 64
    with pytest.raises(ValueError):
        simhash.segments(64, 10)


def test_no_row_is_lost_on_the_way(spark):
    """Odd rows through the stages: what near-dup removal and redaction must keep is followed by (id, text)."""
    clean = [" ".join(f"{a}{i % k}" for i in range(90)) + "." for a, k in (("alpha", 31), ("beta", 37), ("gamma", 41))]
    rows = [(1, clean[0]), (1, clean[1]), (None, clean[2]), (2, clean[0]), (3, clean[2] + " token=abcdef123456"), (None, "password=hunter2222 " + clean[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    stages = dict(corpus_pipeline.STAGES)
    near = common.stored(stages["near_dups"](spark, docs, ""), "near")
    assert texts(near) == sorted([(1, clean[0]), (1, clean[1]), (None, clean[2]), (3, rows[4][1]), (None, rows[5][1])], key=str)
    red = stages["secrets"](spark, near, "")
    assert texts(red) == sorted([(1, clean[0]), (1, clean[1]), (None, clean[2]), (3, clean[2] + " [secret]"), (None, "[secret] " + clean[0])], key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in red.collect())
