"""BPE by merge rounds against the tokenizers library and against one merge at a time."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import merges

P = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer
PATH = P.path("byte_bpe_50k.json")


def texts():
    r = random.Random(5)
    letters = "etaoin shrdlu" * 4 + "ABCéßñ日本語한국\U0001f600\n\t'.,<|>0123456789"
    out = ["".join(r.choice(letters) for _ in range(r.randint(0, 400))) for _ in range(60)]
    out += ["", None, " ", "a" * 30_000, "ab" * 9000, "".join(r.choice("etaoinshrdlu") for _ in range(12_000)), "  \n\n  x  ", "it's they'll I'd", "x\x85y z ", "͸ unassigned \U000e0fff"]
    out += ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "no <|endoftext|> é ͸", "aaaaa aaaa aaa aa a", "\x00\x01\x1c\x1d\x1e\x1f\x7f"]
    return out


def test_ids_and_texts_are_the_library_s(spark):
    lib, rows = Tokenizer.from_file(PATH), list(enumerate(texts())) + [(None, "no id"), (3, texts()[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({c: F.lit("x") for c in ("ids", "pieces", "odd")})
    want = sorted(((i, lib.encode(t or "", add_special_tokens=False).ids) for i, t in rows), key=str)
    coded = merges.encode(docs, PATH)
    assert sorted(((r["doc_id"], r["ids"]) for r in coded.collect()), key=str) == want
    packed = merges.encode(docs, PATH, packed=True)
    assert sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in packed.collect()), key=str) == want
    for c in (coded, packed):
        assert sorted(((r["doc_id"], r["text"]) for r in merges.decode(c, PATH).collect()), key=str) == sorted(((i, lib.decode(lib.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in rows), key=str)
    assert merges.encode(docs.limit(0), PATH).collect() == [] and merges.decode(coded.limit(0), PATH).collect() == []


def test_decoding_of_any_ids(spark):
    lib = Tokenizer.from_file(PATH)
    lists = [[], [220, 50256, 11], [0xE2, 0x80, 300], [99, 255, 128, 187], list(range(200, 260)), [164, 245], [50256] * 3]
    rows = [(i, x) for i, x in enumerate(lists)]
    got = {r["doc_id"]: r["text"] for r in merges.decode(spark.createDataFrame(rows + [(90, None), (91, [220, None, 60_000, -1, 220])], "doc_id long, ids array<int>"), PATH).collect()}
    assert got == {i: lib.decode(x, skip_special_tokens=False) for i, x in rows} | {90: "", 91: "  "}


def one_by_one(t, symbols):
    """Merges the leftmost pair of lowest rank, once in a step."""
    ranks = {int(k): int(r) for k, r in zip(t.keys, t.ranks)}
    s = list(symbols)
    while True:
        found = [(ranks[a * t.size + b], i) for i, (a, b) in enumerate(zip(s, s[1:])) if a * t.size + b in ranks]
        if not found:
            return s
        rank, i = min(found)
        s[i : i + 2] = [int(t.makes[rank])]


def test_rounds_equal_single_merges():
    t, r = merges.table(PATH), random.Random(9)
    words = ["".join(r.choice(x) for _ in range(r.randint(1, 40))).encode() for x in ("a", "ab", "etaoin ", "the rain", "0123", "éñ日") for _ in range(60)]
    ids, counts = merges.merged(t, np.concatenate([t.of_byte[np.frombuffer(w, np.uint8)] for w in words]), np.array([len(w) for w in words]))
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for w, got in zip(words, parts):
        assert got.tolist() == one_by_one(t, t.of_byte[np.frombuffer(w, np.uint8)].tolist())
    assert [len(x) for x in merges.merged(t, np.zeros(0, np.int32), np.zeros(0, np.int64))] == [0, 0]


def test_files_that_are_something_else_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    for change in (lambda s: s["model"].update(dropout=0.1), lambda s: s["pre_tokenizer"].update(add_prefix_space=True), lambda s: s["added_tokens"][0].update(lstrip=True), lambda s: s["model"]["merges"].insert(0, s["model"]["merges"][-1])):
        other = json.loads(json.dumps(spec))
        change(other)
        at = tmp_path / f"{abs(hash(str(change)))}.json"
        at.write_text(json.dumps(other))
        with pytest.raises(ValueError):
            merges.table(str(at))
