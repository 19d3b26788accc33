"""Secret scan: fixed detectors, and character Markov models of random strings
and ordinary identifiers compared by log-likelihood ratio.

The fixed detectors (``BASE``) find assignments, access keys and long hex runs.
Two first-order Markov models over the token alphabet, one of random strings and
one of ordinary tokens, are counted from labelled samples.  What is left of a text
outside the fixed matches is read as tokens of at least ``MIN_TOKEN`` characters; in
each the running log-likelihood ratio gives the segments that score best (a segment
ends where the ratio has fallen by ``MIN_RATIO`` from its top).  A segment over
``MIN_RATIO`` grows to the separators around it and is a secret of kind ``markov``
when it then has at least ``MIN_TOKEN`` characters: so random parts of paths, hosts
and dotted names are found without the ordinary parts beside them.  Positions are
code points, ends exclusive.  All of it is DataFrame expressions; the models are two
tables whose size the alphabet fixes.

Labelled samples of the query, from all documents: fixed matches are random strings,
all other tokens of at least four characters are ordinary.  Equal tokens are counted
before they are taken apart.

Nulls: a null text is the empty text.  Repeated rows give equal rows.  Without
samples of both classes the ratio is 0 and no token is reported.  Of spans that start
together the kind listed first comes first.  Very long texts and tokens are read
once, from left to right.  An empty table gives an empty result.  ``scan`` adds
``_text``, ``_base`` and ``_spans``; ``masked_texts`` takes columns of any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in the order in which they are listed, pattern, group that holds the secret, least length of it.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
TOKEN = "[A-Za-z0-9+/_.=-]"
SYMBOLS = len(ALPHABET) + 1     # 0: outside the token
MIN_TOKEN = 16
MIN_RATIO = 16.0
SEPARATORS = "+/_.=-"
MASK = "[SECRET]"
SPAN = "struct<start:int,kind:int,end:int,inner:int>"


def located(df: DataFrame, to: str, pattern: str, group: int, kind: int, keep, text: str = "_text") -> DataFrame:
    """Column ``to``: spans of the leftmost non-overlapping matches of ``pattern`` in
    ``text`` whose ``group`` passes ``keep``, from the lengths of the matches and of
    the text between them.  ``inner`` is where the group starts."""
    whole, part, gap = f"{to}_whole", f"{to}_part", f"{to}_gap"
    df = df.withColumn(whole, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = (df.withColumn(part, F.when(F.size(whole) > 0, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
                        if group else F.col(whole))
          .withColumn(gap, F.when(F.size(whole) > 0, F.split(text, pattern, -1))))

    def step(acc, z):
        start = acc["at"] + F.char_length(z[gap])
        end = start + F.char_length(z[whole])
        span = F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"),
                        (end - F.char_length(z[part])).cast("int").alias("inner"))
        ok = z[whole].isNotNull() & keep(z[part])
        return F.struct(F.coalesce(end, start).alias("at"),
                        F.when(ok, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(f"array<{SPAN}>")
    first = F.struct(F.lit(0).alias("at"), none.alias("out"))
    found = F.aggregate(F.arrays_zip(gap, whole, part), first, step, lambda acc: acc["out"])
    return df.withColumn(to, F.when(F.size(whole) > 0, found).otherwise(none)).drop(whole, part, gap)


def base_spans(df: DataFrame) -> DataFrame:
    """``df(_text)`` with ``_base``, the spans of the fixed detectors by start, then kind."""
    for k, (name, pattern, group, least) in enumerate(BASE):
        df = located(df, f"_{name}", pattern, group, k, lambda part, least=least: F.char_length(part) >= least)
    cols = [f"_{name}" for name, *_ in BASE]
    return df.withColumn("_base", F.array_sort(F.concat(*cols))).drop(*cols)


def symbol(ch: Column) -> Column:
    """1-based place of a character in the alphabet, 0 if it has none."""
    return F.call_function("instr", F.lit(ALPHABET), ch)


def symbols_of(token: Column) -> Column:
    """Symbols of a token's characters."""
    return F.transform(F.split(token, ""), symbol)


def fit(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of every symbol pair, from
    ``samples(token, random)``; add-one smoothing, 0 throughout without samples of both."""
    tokens = samples.groupBy("random", "token").agg(F.count("*").alias("n"))
    zero = F.array(F.lit(0))
    ids = tokens.select("random", "n", F.concat(zero, symbols_of(F.col("token")), zero).alias("s"))
    pairs = ids.select("random", "n", F.explode(F.zip_with(
        F.slice("s", 1, F.size("s") - 1), F.slice("s", 2, F.size("s") - 1), lambda a, b: a * SYMBOLS + b)).alias("pair"))
    n = {True: [[1.0] * SYMBOLS for _ in range(SYMBOLS)], False: [[1.0] * SYMBOLS for _ in range(SYMBOLS)]}
    seen = set()
    for r in pairs.groupBy("random", "pair").agg(F.sum("n").alias("n")).collect():   # the alphabet bounds it
        seen.add(r["random"])
        n[r["random"]][r["pair"] // SYMBOLS][r["pair"] % SYMBOLS] += r["n"]
    if len(seen) < 2:
        return [0.0] * SYMBOLS ** 2
    out = []
    for a in range(SYMBOLS):
        x, y = sum(n[True][a]), sum(n[False][a])
        out += [math.log(n[True][a][b] / x) - math.log(n[False][a][b] / y) for b in range(SYMBOLS)]
    return out


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once and once in the plan, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ratio_table(model: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{v:.9g}" for v in model)), ",").cast("array<double>")


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token."""
    table = ratio_table(model)
    symbols = F.concat(F.array(F.lit(0)), symbols_of(token), F.array(F.lit(0)))
    first = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last"))
    return F.aggregate(symbols, first, lambda acc, s: F.struct(
        F.when(acc["last"] < 0, acc["sum"]).otherwise(
            acc["sum"] + F.element_at(table, acc["last"] * SYMBOLS + s + 1)).alias("sum"),
        s.alias("last")), lambda acc: acc["sum"])


def segments(token: Column, model: list[float], min_token: int = MIN_TOKEN, min_ratio: float = MIN_RATIO) -> Column:
    """Ascending, disjoint (a, b) of a token: its best-scoring segments, each scored as a
    token of its own, grown to the separators around them.  A step from or to a separator
    or from a small to a capital letter scores 0: how paths and names are put together
    tells nothing of their parts."""
    chars = " " + ALPHABET
    joint = lambda a, b: a in SEPARATORS or b in SEPARATORS or a.islower() and b.isupper()
    table = ratio_table([0.0 if joint(a, b) else model[i * SYMBOLS + j] for i, a in enumerate(chars) for j, b in enumerate(chars)])
    return bound(table, lambda t: bound(_best_segments(token, t, min_ratio), lambda best: _grown(token, best, min_token)))


_SEGMENTS = "array<struct<a:int,b:int>>"


def _best_segments(token: Column, table: Column, min_ratio: float) -> Column:
    """The best-scoring segments of a token by the ratios of ``table``."""
    step = lambda a, b: F.element_at(table, a * SYMBOLS + b + 1)
    # open segment: ``since`` its start, ``sum`` its ratio so far; ``top`` its best closed ratio, ending before ``to``
    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("last"), F.lit(0.0).alias("sum"), F.lit(0).alias("since"),
                     F.lit(-1e300).alias("top"), F.lit(0).alias("to"), F.array().cast(_SEGMENTS).alias("out"))

    def found(acc):
        here = F.array(F.struct(acc["since"].alias("a"), acc["to"].alias("b")))
        return F.when(acc["top"] > min_ratio, F.concat(acc["out"], here)).otherwise(acc["out"])

    def read(acc, s):
        on, anew = acc["sum"] + step(acc["last"], s), step(F.lit(0), s)
        fresh = (acc["at"] == 0) | (on < anew) | ((acc["top"] > min_ratio) & (acc["top"] - on > min_ratio))
        total = F.when(fresh, anew).otherwise(on)
        closed = total + step(s, F.lit(0))
        better = fresh | (closed > acc["top"])
        return F.struct((acc["at"] + 1).alias("at"), s.alias("last"), total.alias("sum"),
                        F.when(fresh, acc["at"]).otherwise(acc["since"]).alias("since"),
                        F.when(better, closed).otherwise(acc["top"]).alias("top"),
                        F.when(better, acc["at"] + 1).otherwise(acc["to"]).alias("to"),
                        F.when(fresh, found(acc)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(symbols_of(token), first, read, found)


def _grown(token: Column, best: Column, min_token: int) -> Column:
    """Segments of at least ``min_token`` characters, grown to the separators around them."""
    run = lambda t: F.char_length(F.regexp_extract(t, "^[A-Za-z0-9]*", 0))
    begun = F.transform(best, lambda s: F.struct((s["a"] + F.char_length(F.regexp_extract(
        F.substring(token, s["a"] + 1, s["b"] - s["a"]), "^[+/_.=-]*", 0))).alias("a"), s["b"].alias("b")))
    grown = F.transform(begun, lambda s: F.struct(
        (s["a"] - run(F.reverse(F.substring(token, F.lit(1), s["a"])))).alias("a"),
        (s["b"] + run(F.substring(token, s["b"] + 1, F.char_length(token)))).alias("b")))

    def merge(acc, s):
        tail = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] >= s["a"]), F.concat(
            F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.least(tail["a"], s["a"]).alias("a"), F.greatest(tail["b"], s["b"]).alias("b"))))) \
            .otherwise(F.concat(acc, F.array(s)))

    whole = F.when(F.size(best) < 2, grown).otherwise(F.aggregate(grown, F.array().cast(_SEGMENTS), merge))
    return F.filter(whole, lambda s: s["b"] - s["a"] >= min_token)


def document_samples(docs: DataFrame) -> DataFrame:
    """Labelled tokens of all documents."""
    some = docs.select(F.coalesce("text", F.lit("")).alias("_text"))
    found, rest = base_spans(some), F.col("_text")
    for _, pattern, _, _ in BASE:
        rest = F.regexp_replace(rest, pattern, " ")
    secret = F.transform("_base", lambda s: F.substring(F.col("_text"), s["inner"] + 1, s["end"] - s["inner"]))
    return found.select(F.explode(secret).alias("token"), F.lit(True).alias("random")).union(
        some.select(F.explode(F.regexp_extract_all(rest, F.lit(f"{TOKEN}{{4,}}"), F.lit(0))).alias("token"), F.lit(False).alias("random")))


def replaced(spans: Column, start: str, by) -> Column:
    """``_text`` with each span (ascending by ``start``) replaced by ``by(its number of
    characters)``; of overlapping spans the later one only from where the earlier ended.
    The parts are gathered first and joined once."""
    text = F.col("_text")
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        before = F.substring(text, acc["at"] + 1, s[start] - acc["at"])
        return F.when(s[start] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(before, by(s["end"] - s[start]))).alias("out"))) \
            .when(s["end"] > acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(by(s["end"] - acc["at"]))).alias("out"))).otherwise(acc)

    return F.aggregate(spans, first, step, lambda acc: F.array_join(
        F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.char_length(text)))), ""))


def scan(docs: DataFrame, model: list[float], min_token: int = MIN_TOKEN, min_ratio: float = MIN_RATIO) -> DataFrame:
    """``docs`` with ``_text``, ``_base`` and ``_spans`` (fixed and Markov spans by start, then kind)."""
    df = base_spans(docs.withColumn("_text", F.coalesce("text", F.lit(""))))
    blank = replaced(F.col("_base"), "start", lambda n: F.repeat(F.lit(" "), n))
    df = df.withColumn("_rest", F.when(F.size("_base") == 0, F.col("_text")).otherwise(blank))
    pattern = f"{TOKEN}{{{min_token},}}"
    df = located(df, "_runs", pattern, 0, len(BASE), lambda token: F.lit(True), "_rest")
    df = df.withColumn("_tokens", F.regexp_extract_all("_rest", F.lit(pattern), F.lit(0)))
    random = F.flatten(F.transform(F.arrays_zip("_runs", "_tokens"), lambda z: F.transform(
        segments(z["_tokens"], model, min_token, min_ratio), lambda s: F.struct(
            (z["_runs"]["start"] + s["a"]).alias("start"), F.lit(len(BASE)).alias("kind"),
            (z["_runs"]["start"] + s["b"]).alias("end"), (z["_runs"]["start"] + s["a"]).alias("inner")))))
    added = F.when(F.size("_tokens") > 0, random).otherwise(F.array().cast(f"array<{SPAN}>"))
    return df.withColumn("_spans", F.array_sort(F.concat("_base", added))).drop("_rest", "_runs", "_tokens")


def listed(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(n) for n in [name for name, *_ in BASE] + ["markov"]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def masked() -> Column:
    """``_text`` with each secret (of an assignment, its value) replaced by ``MASK``."""
    by_inner = F.array_sort(F.transform("_spans", lambda s: F.struct(s["inner"].alias("inner"), s["end"].alias("end"))))
    merged = F.aggregate(by_inner, F.array().cast("array<struct<inner:int,end:int>>"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > s["inner"]), F.concat(
            F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["inner"].alias("inner"),
                                                                F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(s))))
    return F.when(F.size("_spans") == 0, F.col("_text")).otherwise(replaced(merged, "inner", lambda n: F.lit(MASK)))


def masked_texts(docs: DataFrame, model: list[float]) -> DataFrame:
    """``docs``, its columns of any names, with every secret in ``text`` masked; ``n_chars``
    follows a changed text."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), "text")
    found = scan(own, model).withColumn("_masked", masked())
    hit = F.size("_spans") > 0
    of = lambda c: F.col("own").getField(c)
    changed = {"text": F.when(hit, F.col("_masked")).otherwise(of("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.char_length("_masked").cast(dict(docs.dtypes)["n_chars"])).otherwise(of("n_chars"))
    return found.select(*[changed.get(c, of(c)).alias(c) for c in docs.columns])
