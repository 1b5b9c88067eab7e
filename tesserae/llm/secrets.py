"""Secret scan in DataFrame functions alone: base patterns, and character Markov models of random strings.

Base kinds assign, access and hex are patterns with least lengths. On top of them, any token of 12 characters or more, less
what base spans cover of it, is scored by two first-order Markov models over characters: one of random strings, one of ordinary
identifiers; a sum of log-likelihood ratios over THRESHOLD makes it a span of kind random. No other rule decides, so strings of
letters alone, or of digits, are scored like all others. The models are trained from labelled samples of several sources, which weigh
alike whatever their size: of random strings, values that the base patterns found and strings made by digests; of ordinary ones,
the corpus's long lower-case words and numbers, and common names of programs (WORDS), numbers and runs of one character.
Names also come in the forms that identifiers have: capitals, upper case, camel case, parts joined by _, - or /, and with
digits; of the corpus's words, whose number grows with it, the counted pairs get their capital forms instead. training() also takes samples from elsewhere. Added spans never overlap base ones.

Positions are in code points, ends exclusive: a pattern's matches and the pieces between them give them by running sums, which are
made in blocks, so that a text's cost doesn't grow with the square of its matches.

Defined cases: null counts as an empty text, without spans; repeated rows are scanned row by row; an empty table
gives an empty result; given samples of which either kind is missing, no span is added. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import stored, unused

#: The base kinds in their order, patterns, which group's length counts, and the least length.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # whole runs only, as a run of any length and a filter would give
)
CANDIDATE, ORDINARY = r"[A-Za-z0-9+/_-]{12,}=*", r"^([a-z]{12,}|[0-9]{12,})$"
#: Elements of a running sum that one step copies.
STEP = 512
#: Natural logarithm of the odds that an added span needs; pseudo-counts of a row, and characters in use.
THRESHOLD, PRIOR, ALPHABET = 10.0, 8.0, 66
SPAN = "struct<start:bigint,end:bigint>"
#: Strings made by digests, and pairs of characters that a source of samples counts for.
MADE, MASS, WORDS_SOURCE = 4000, 100_000.0, "words"
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Common names in programs.
WORDS = (
    "account", "action", "address", "array", "attribute", "backup", "balance", "batch", "block", "body", "buffer", "build", "button", "byte", "cache", "callback", "category",
    "channel", "character", "checksum", "class", "client", "cluster", "collection", "color", "column", "command", "comment", "config", "connection", "content", "context",
    "controller", "count", "customer", "database", "date", "default", "description", "device", "dictionary", "directory", "document", "element", "email", "encoding", "entry",
    "environment", "error", "event", "exception", "factory", "field", "file", "filter", "format", "function", "get", "group", "handler", "header", "height", "history", "identifier",
    "image", "index", "input", "instance", "interface", "item", "iterator", "key", "label", "length", "library", "list", "location", "manager", "message", "method", "model",
    "module", "name", "network", "number", "object", "of", "offset", "on", "only", "option", "order", "output", "owner", "package", "parameter", "parser", "path", "pattern", "percent",
    "position", "process", "product", "property", "provider", "queue", "read", "record", "reference", "region", "request", "resource", "response", "result", "schedule", "schema",
    "select", "server", "service", "session", "set", "sha", "size", "source", "state", "status", "storage", "string", "summary", "table", "target", "template", "thread", "time", "to",
    "total", "transaction", "type", "update", "user", "utility", "validate", "value", "variable", "version", "view", "width", "window", "with", "worker", "workflow", "write",
)


def located(rows: DataFrame, text: str, pattern: str, name: str, group: int = 0) -> DataFrame:
    """rows with name: array of (start, end, value) of the pattern's leftmost non-overlapping matches.

    Arrays meet by zip_with: a column that a lambda names may be computed again for every element.
    """
    rows = rows.withColumn("_m", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    rows = rows.withColumn("_v", F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.col("_m"))
    rows = rows.withColumn("_p", F.when(F.size("_m") > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")))
    # between the matches there is one piece more than there are matches
    rows = rows.withColumn("_n", F.slice(F.zip_with("_p", "_m", lambda p, m: (F.length(p) + F.length(m)).cast("long")), F.lit(1), F.size("_m")))
    rows = running(rows, "_n", "_e", lambda a, b: a + b, 0)
    places = F.zip_with("_e", "_m", lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end")))
    spans = F.zip_with(places, "_v", lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value")))
    return rows.withColumn(name, spans).drop("_m", "_v", "_p", "_n", "_e")


def running(rows: DataFrame, values: str, name: str, fold: Callable[[Column, Column], Column], zero: int) -> DataFrame:
    """rows with name: fold over the first, the first two, ... of an array of longs. Blocks of STEP are folded first, then their ends."""
    none, first = F.array().cast("array<bigint>"), F.lit(zero).cast("long")
    begin = F.struct(first.alias("at"), none.alias("all"))

    def step(acc: Column, x: Column) -> Column:
        now = fold(acc["at"], x)
        return F.struct(now.alias("at"), F.concat(acc["all"], F.array(now)).alias("all"))

    blocks = F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STEP).cast("int")), lambda b: F.slice(values, b * STEP + 1, STEP)))
    rows = rows.withColumn("_blocks", F.coalesce(blocks, F.array().cast("array<array<bigint>>")))
    rows = rows.withColumn("_own", F.transform("_blocks", lambda b: F.aggregate(b, begin, step, lambda acc: acc["all"])))
    rows = rows.withColumn("_before", F.aggregate(F.transform("_own", lambda o: F.element_at(o, -1)), F.struct(first.alias("at"), none.alias("all")), lambda acc, x: F.struct(fold(acc["at"], x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"]))
    return rows.withColumn(name, F.flatten(F.zip_with("_own", "_before", lambda o, b: F.transform(o, lambda x: fold(b, x))))).drop("_blocks", "_own", "_before")


def base(rows: DataFrame, text: Column) -> DataFrame:
    """rows with an array of spans for each base kind, tokens, ordinary words, and pieces: what base spans leave of the tokens.

    A piece is (token, start, end), token a place in tokens from 1 on; texts without base spans have none, as their tokens are whole.
    """
    kept = rows.columns
    rows = rows.withColumn("_text", F.coalesce(text.cast("string"), F.lit("")))
    for kind, pattern, group, least in KINDS:
        rows = located(rows, "_text", pattern, kind, group)
        rows = rows.withColumn(kind, F.filter(kind, lambda s: F.length(s["value"]) >= least))
    rows = located(rows, "_text", CANDIDATE, "tokens")
    rows = rows.withColumn("ordinary", F.filter(F.transform("tokens", lambda t: t["value"]), lambda v: v.rlike(ORDINARY)))
    return pieces(rows.withColumn("_base", F.concat(*[k for k, *_ in KINDS]))).select(*kept, *[k for k, *_ in KINDS], "tokens", "ordinary", "pieces")


def pieces(rows: DataFrame) -> DataFrame:
    """rows with pieces, from tokens and _base: both lists are put in order of their starts once.

    From one start to the next nothing begins, so what is free there lies between the largest end of a base span so far and the end of
    the last token. Both, and the token's place, are running maxima, so a text's cost follows the number of its spans.
    """
    event = lambda start, covered, token, end: F.struct(start.alias("start"), covered.cast("long").alias("covered"), token.cast("long").alias("token"), end.cast("long").alias("end"))
    zero = F.lit(0)
    events = F.array_sort(F.concat(F.transform("_base", lambda b: event(b["start"], b["end"], zero, zero)), F.transform("tokens", lambda t, i: event(t["start"], zero, i + 1, t["end"]))))
    rows = rows.withColumn("_events", F.when(F.size("_base") > 0, events).otherwise(F.array().cast("array<struct<start:bigint,covered:bigint,token:bigint,end:bigint>>")))
    field = lambda name: F.transform("_events", lambda e: e[name])
    for name in ("start", "covered", "token", "end"):
        rows = rows.withColumn(f"_{name}", field(name))
        if name != "start":
            rows = running(rows, f"_{name}", f"_{name}", F.greatest, 0)
    rows = rows.withColumn("_next", F.concat(F.slice("_start", F.lit(2), F.greatest(F.size("_start") - 1, zero)), F.array(F.lit(None).cast("long"))))
    free = F.transform(F.arrays_zip("_token", "_start", "_covered", "_next", "_end"), lambda e: F.struct(e["_token"].alias("token"), F.greatest(e["_start"], e["_covered"]).alias("start"), F.least(e["_next"], e["_end"]).alias("end")))
    return rows.withColumn("pieces", F.filter(free, lambda p: p["start"] < p["end"]))


def uncovered(found: DataFrame) -> DataFrame:
    """found, as it was stored, with tokens less what base spans cover of them."""
    piece = lambda p, t: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.substring(t["value"], (p["start"] - t["start"]).cast("int") + 1, (p["end"] - p["start"]).cast("int")).alias("value"))
    left = F.transform("pieces", lambda p: piece(p, F.get("tokens", (p["token"] - 1).cast("int"))))
    return found.withColumn("tokens", F.when(reduce(lambda a, b: a + b, [F.size(k) for k, *_ in KINDS]) == 0, F.col("tokens")).otherwise(left))


def forms(word: Column) -> Column:
    """The forms that a word of letters has in identifiers."""
    half = F.floor(F.length(word) / 2).cast("int")
    a, b = F.substring(word, F.lit(1), half), F.substring(word, half + 1, F.length(word))
    digits = F.pmod(F.crc32(word), F.lit(1000)).cast("string")
    capital = F.initcap(b)
    return F.array(word, F.initcap(word), F.upper(word), F.concat(a, capital), F.concat(F.initcap(a), capital), F.concat_ws("_", a, b), F.concat_ws("_", F.upper(a), F.upper(b)), F.concat_ws("-", a, b), F.concat_ws("/", a, b), F.concat(a, digits, capital), F.concat_ws("_", a, digits, b), F.concat(a, b, digits))


def samples(found: DataFrame) -> DataFrame:
    """(sample, secret, source, n): labelled samples, those that the base scan gives (and how often) and those made by rule."""
    spark = found.sparkSession
    # the prefix of an access key is fixed, not random
    values = F.concat(*[F.transform(k, lambda s: F.regexp_replace(s["value"], "^AKIA", "")) for k, *_ in KINDS])
    rows = lambda d, sample, secret, source, n: d.select(sample.alias("sample"), F.lit(secret).alias("secret"), F.lit(source).alias("source"), n.cast("long").alias("n"))
    secret = found.select(F.explode(values).alias("sample")).groupBy("sample").agg(F.count("*").alias("n"))
    ordinary = found.select(F.explode("ordinary").alias("sample")).groupBy("sample").agg(F.count("*").alias("n"))
    made = spark.range(MADE)
    digest = F.sha2(F.col("id").cast("string"), 256)
    random = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    random = F.explode(F.array(random, F.lower(F.regexp_replace(random, "[^A-Za-z]", "")), F.substring(digest, 1, 32)))
    # each name with another, as identifiers put them together
    two = F.lit(" ".join(WORDS))
    names = F.transform(F.split(two, " "), lambda w, i: F.concat(w, F.get(F.split(two, " "), F.pmod(i * 7 + F.col("id"), F.lit(len(WORDS))).cast("int"))))
    pairs = spark.range(8).select(F.explode(names).alias("sample"))
    plain = spark.range(MADE // 8).select(F.explode(F.array(F.abs(F.xxhash64("id")).cast("string"), F.repeat(F.substring(F.lit(CHARACTERS), F.pmod("id", F.lit(len(CHARACTERS))).cast("int") + 1, F.lit(1)), 16))).alias("sample"))
    one = F.lit(1)
    parts = [rows(secret, F.col("sample"), 1, "found", F.col("n")), rows(made, random, 1, "made", one), rows(ordinary, F.col("sample"), 0, WORDS_SOURCE, F.col("n")), rows(pairs, F.explode(forms(F.col("sample"))), 0, "names", one), rows(plain, F.col("sample"), 0, "names", one)]
    return reduce(DataFrame.unionByName, parts)


def cased(pair: Column, n: Column) -> Column:
    """(pair, n) and, for pairs of small letters in the corpus's words, shares of n for both as capitals and either."""
    small = (F.col("source") == WORDS_SOURCE) & F.floor(pair / 128).between(97, 122) & (pair % 128).between(97, 122)
    one = lambda p, share: F.struct(p.cast("int").alias("pair"), (n * share).alias("n"))
    return F.when(small, F.array(one(pair, 1.0), one(pair - 32 * 128 - 32, 0.2), one(pair - 32 * 128, 0.1), one(pair - 32, 0.1))).otherwise(F.array(one(pair, 1.0)))


def training(labelled: DataFrame) -> DataFrame:
    """(pair, n0, n1): how often each pair of ASCII codes, 128 * a + b, occurs in ordinary and in random samples.

    Where labelled has n, a sample counts n times; where it has source, all sources of a kind weigh alike.
    """
    codes = F.transform(F.split("sample", ""), lambda c: F.ascii(c))
    times = F.col("n").cast("double") if "n" in labelled.columns else F.lit(1.0)
    source = F.col("source") if "source" in labelled.columns else F.lit("")
    rows = labelled.where("sample is not null and secret in (0, 1)").select("secret", source.alias("source"), codes.alias("codes"), times.alias("n"))
    pairs = F.transform("codes", lambda a, i: F.when((a < 128) & (F.get("codes", i + 1) < 128), a * 128 + F.get("codes", i + 1)))
    rows = rows.select("secret", "source", "n", F.explode(pairs).alias("pair")).where("pair is not null")
    counts = rows.groupBy("secret", "source", "pair").agg(F.sum("n").alias("n"))  # 16,384 for each source at most
    if "source" in labelled.columns:
        counts = counts.select("secret", "source", F.explode(cased(F.col("pair"), F.col("n"))).alias("p")).groupBy("secret", "source", F.col("p.pair").alias("pair")).agg(F.sum("p.n").alias("n"))
        whole = Window.partitionBy("secret", "source")
        counts = counts.withColumn("n", F.col("n") * MASS / F.sum("n").over(whole))
    return counts.groupBy("pair").agg(*[F.sum(F.when(F.col("secret") == v, F.col("n")).otherwise(0.0)).alias(f"n{v}") for v in (0, 1)])


def ratios(counts: dict[int, tuple[float, float]]) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) for each pair; a row leans on its model's own character frequencies."""
    logs = []
    for v in (0, 1):
        rows, chars = [0.0] * 128, [0.5] * 128
        for pair, n in counts.items():
            rows[pair // 128] += n[v]
            chars[pair % 128] += n[v]
        total = sum(chars) - 64 + ALPHABET / 2
        logs.append([math.log((counts.get(i, (0.0, 0.0))[v] + PRIOR * chars[i % 128] / total) / (rows[i // 128] + PRIOR)) for i in range(128 * 128)])
    return [b - a for a, b in zip(*logs)]


def table(model: DataFrame) -> Column | None:
    """The model as a constant array over all pairs; it has 128 * 128 entries whatever the corpus holds."""
    counts = {r["pair"]: (r["n0"], r["n1"]) for r in model.collect()}  # 16,384 rows at most
    if not any(a for a, _ in counts.values()) or not any(b for _, b in counts.values()):
        return None
    return F.split(F.lit(",".join(f"{x:.6f}" for x in ratios(counts))), ",").cast("array<double>")


def spanned(order: int, kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def _spanned(rows: DataFrame, text: Column, labelled: DataFrame | None, threshold: float) -> DataFrame:
    """rows with spans. What the base scan gives is stored with the rows, so no row has to be found again by an id."""
    kept = rows.columns
    found = uncovered(stored(base(rows, text), "secrets"))
    llr = table(training(samples(found) if labelled is None else labelled))
    kinds = [F.transform(k, spanned(i, k)) for i, (k, *_) in enumerate(KINDS)]
    if llr is None:
        return found.select(*kept, F.array_sort(F.concat(*kinds)).alias("spans"))
    found = found.withColumn("codes", F.transform("tokens", lambda t: F.transform(F.split(t["value"], ""), lambda c: F.ascii(c))))
    ratio = lambda a: F.aggregate(F.zip_with(F.slice(a, 1, F.size(a) - 1), F.slice(a, 2, F.size(a)), lambda x, y: F.get(llr, x * 128 + y)), F.lit(0.0), lambda acc, x: acc + x)
    found = found.withColumn("ratios", F.transform("codes", ratio))
    added = F.filter(F.zip_with("tokens", "ratios", lambda t, r: F.when(r > threshold, spanned(len(KINDS), "random")(t))), lambda x: x.isNotNull())
    return found.select(*kept, F.array_sort(F.concat(*kinds, added)).alias("spans"))


def scanned(docs: DataFrame, text: str = "text", id_col: str = "doc_id", labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and spans, an array of (start, order, kind, end) sorted by start, then kind, for every row; base ones and added ones."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("_raw"))
    return _spanned(rows, F.col("_raw"), labelled, threshold).select("doc_id", "spans")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def without(text: Column, spans: Column, last: Column, mark: str) -> Column:
    """text with mark for each of spans, an array of (before, start): what lies between is kept, as is what follows last.

    Substrings are found from a text's beginning; so stretches of STEP spans are cut out first, and spans out of these.
    """
    numbered = F.filter(F.transform(spans, lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda x: x["i"] % STEP == 0)
    blocks = F.transform(numbered, lambda x: F.slice(spans, x["i"] + 1, STEP))
    part = lambda b, at: F.struct(b.alias("spans"), at.alias("at"), F.substring(text, at.cast("int") + 1, (F.element_at(b, -1)["start"] - at).cast("int")).alias("text"))
    piece = lambda x, s: F.concat(F.substring(x["text"], (s["before"] - x["at"]).cast("int") + 1, (s["start"] - s["before"]).cast("int")), F.lit(mark))
    kept = F.transform(F.transform(blocks, lambda b: part(b, F.element_at(b, 1)["before"])), lambda x: F.array_join(F.transform(x["spans"], lambda s: piece(x, s)), ""))
    return F.concat(F.array_join(kept, ""), F.substring(text, last.cast("int") + 1, F.length(text)))


def redacted(docs: DataFrame, text: str = "text", id_col: str = "doc_id", mark: str = "[secret]", labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every stretch of spans that overlap replaced by mark. Each row is cut by its own text's spans, whatever its id, and a row without one, too."""
    rows = _spanned(docs.select(F.struct(*docs.columns).alias("_row")), F.col("_row").getField(text), labelled, threshold)
    # what lies before each span begins at the largest end so far; a span that begins before that end has no mark of its own
    rows = running(rows.withColumn("_ends", F.transform("spans", lambda s: s["end"])), "_ends", "_upto", F.greatest, 0)
    rows = rows.withColumn("_before", F.slice(F.concat(F.array(F.lit(0).cast("long")), "_upto"), F.lit(1), F.size("_upto")))
    apart = F.filter(F.arrays_zip("spans", "_before", "_upto"), lambda z: z["spans"]["start"] >= z["_before"])
    rows = rows.withColumn("_cuts", F.transform(apart, lambda z: F.struct(z["_before"].alias("before"), z["spans"]["start"].alias("start"))))
    whole = F.col("_row").getField(text)
    new = F.when(F.size("spans") > 0, without(whole, F.col("_cuts"), F.element_at("_upto", -1), mark)).otherwise(whole)
    return rows.select(*[new.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns])
