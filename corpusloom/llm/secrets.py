"""Secrets in texts, by patterns and by a battery of randomness tests.

All of it is built-in functions of Spark. Patterns find assignments, access keys
and hexadecimal runs. Further tokens whose characters point to an encoding (hex,
base 32, base 36, base 64) go through three tests: a chi-squared test of the
alphabet's uniformity, a test of the runs of one class of characters and a test of
serial correlation. Their scores, positive where ordinary text lies, are added up.

What has to be ruled out is ordinary text: names made of words, counters, time
stamps. So the null hypothesis is that a token is ordinary: its sum of scores is
compared with that of ordinary tokens of the same length and encoding, and Benjamini
and Hochberg's procedure, by stratum of length, bounds the share of ordinary tokens
among those that it calls random. A token that is too uneven, too regular or too
repetitive for a random one is not called either.

Short tokens say little. With a hundred ordinary tokens for each random one, nine of
ten random ones are called from 32 characters on, about half of them at 20 to 24;
the others are left, as nothing tells them apart at that error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import named
from corpusloom.llm._shared import materialize

# The patterns of the three base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8

#: Tokens that the battery looks at.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: Name, alphabet, what all characters are, what must occur.
ENCODINGS = (
    ("hex", "0123456789abcdef", r"\A[0-9a-f]+\z", r"[0-9].*[a-f]|[a-f].*[0-9]"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"\A[A-Z2-7]+\z", r"[2-7].*[A-Z]|[A-Z].*[2-7]"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", r"\A[0-9a-z]+\z", r"[0-9].*[a-z]|[a-z].*[0-9]"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r"\A[A-Za-z0-9+/_-]+\z", r"\A(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])"),
)
#: Letters that words use most, and the others.
_OFTEN, _SELDOM = "acdehilnorstu", "bfgjkmpqvwxyz"
#: For each encoding: cells of the alphabet with the number of characters in each, as
#: few as short tokens can fill; classes whose runs count; a class whose neighbours are compared.
CELLS = (
    (("[0]", 1), ("[1-9]", 9), ("[a-f]", 6)),
    ((f"[{_OFTEN.upper()}]", 13), (f"[{_SELDOM.upper()}]", 13), ("[2-7]", 6)),
    ((f"[{_OFTEN}]", 13), (f"[{_SELDOM}]", 13), ("[0-9]", 10)),
    ((f"[{_OFTEN}]", 13), (f"[{_SELDOM}]", 13), ("[A-Z]", 26), ("[^A-Za-z]", 12)),
)
CLASSES = (
    (("[0-9]", 10), ("[a-f]", 6)),
    (("[A-Z]", 26), ("[2-7]", 6)),
    (("[a-z]", 26), ("[0-9]", 10)),
    (("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10), ("[^A-Za-z0-9]", 2)),
)
NEIGHBOURS = ("[0-7]", "[AEIOU]", "[aeiou]", "[AEIOUaeiou]")
#: Sums of scores of ordinary tokens of n characters: a + b * sqrt(n), and a spread that covers
#: their lower tail down to 1 in 1000. Fitted to names of 200 English words of programs in five
#: styles, with numbers, and to time stamps and counters, of 20 to 120 characters.
ORDINARY = ((-1.9, 1.45, 1.7), (-1.8, 1.08, 0.8), (-1.7, 1.22, 0.8), (-1.2, 1.2, 1.15))
#: A random token passes each test's other side and the evenness of all characters up to this score.
TOO_ODD = 3.5
#: Lengths below each bound make a stratum.
STRATA = (32, 48, 80)
FALSE_DISCOVERIES = 0.02
#: Bins of p-values in each power of ten.
DECADE_BINS = 100

KINDS = ("assign", "access", "hex", "random")
_SPANS = "array<struct<kind:int,s:int,e:int>>"
#: Elements of an array, and code points of a text, that are summed up together.
_BLOCK = 128
_PIECE = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _none() -> Column:
    return F.array().cast(_SPANS)


def _spans(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """Code-point spans of all matches, each with what matched as m, found from the texts between them.

    Sums of lengths are kept for blocks of matches, so that a text full of matches
    costs little more than its length. ``keep`` gives a boolean for each match.
    """
    expr = F.lit(pattern)
    none = F.array().cast("array<struct<kind:int,s:int,e:int,m:string>>")

    def placed(found: Column, between: Column) -> Column:
        widths = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda p, m: F.length(p) + F.length(m))

        def starts(width: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(width) - 1) / _BLOCK).cast("int")), lambda b: _total(F.slice(width, b * _BLOCK + 1, F.lit(_BLOCK))))
            return let(blocks, lambda block: F.transform(found, lambda m, i: let(_before(block, width, i) + F.length(F.element_at(between, i + 1)), lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m")))))

        return let(widths, starts)

    spans = let(F.regexp_extract_all(text, expr, F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda between: placed(found, between))))
    if keep is not None:
        spans = let(spans, lambda all_: F.when(F.size(all_) == 0, all_).otherwise(let(keep, lambda ok: F.filter(all_, lambda x, i: F.element_at(ok, i + 1)))))
    return spans


def _before(block: Column, width: Column, i: Column) -> Column:
    """The sum of the first i widths."""
    whole = F.floor(i / _BLOCK).cast("int")
    return _total(F.slice(block, F.lit(1), whole)) + _total(F.slice(width, whole * _BLOCK + 1, i - whole * _BLOCK))


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds, in order of start and kind."""
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= LEAST_VALUE)
    assign = _spans(text, ASSIGN, 0, long_enough)
    plain = lambda spans: F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    access = F.when(F.contains(text, F.lit("AKIA")), plain(_spans(text, ACCESS, 1))).otherwise(_none())
    hexes = F.when(text.rlike(HEX), plain(_spans(text, HEX, 2))).otherwise(_none())
    return _in_order(F.concat(plain(assign), access, hexes))


def _in_order(spans: Column) -> Column:
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"))))
    return F.transform(keyed, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def _tail(z: Column) -> Column:
    """The normal distribution's upper tail, by the rational approximation with an error below 1e-7."""

    def positive(x: Column) -> Column:
        t = 1 / (1 + 0.2316419 * x)
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-x * x / 2) * 0.3989422804014327 * poly

    return let(z.cast("double"), lambda x: F.when(x >= 0, positive(x)).otherwise(1 - positive(-x)))


def _cubed(chi: Column, freedom: int) -> Column:
    """A chi-squared value as a normal score, by Wilson and Hilferty."""
    spread = 2 / (9 * freedom)
    return (F.pow(F.greatest(chi, F.lit(0.0)) / freedom, F.lit(1 / 3)) - (1 - spread)) / spread**0.5


def _scores(token: Column, which: int) -> Column:
    """Array of four scores: evenness of the cells, runs, serial correlation, evenness of all characters."""
    _, alphabet, _, _ = ENCODINGS[which]
    k, n = len(alphabet), F.length(token).cast("double")
    count = lambda pattern: F.regexp_count(token, F.lit(pattern)).cast("double")

    off = [(let(count(c) - n * (size / k), lambda d: d * d) / (n * (size / k))) for c, size in CELLS[which]]
    even = _cubed(sum(off[1:], off[0]), len(off) - 1)

    shares = [size / k for _, size in CLASSES[which]]
    second, third = sum(p**2 for p in shares), sum(p**3 for p in shares)
    variance = (n - 1) * (second * (1 - second)) + 2 * (n - 2) * (third - second**2)
    runs = ((n - 1) * (1 - second) + 1 - count("|".join(f"{c}+" for c, _ in CLASSES[which]))) / F.sqrt(variance)

    own = NEIGHBOURS[which]

    def serial(ones: Column) -> Column:
        mean, at_ends = ones / n, token.rlike(rf"\A{own}").cast("double") + token.rlike(rf"{own}\z").cast("double")
        cross = count(f"{own}(?={own})") - mean * (2 * ones - at_ends) + (n - 1) * mean * mean
        square = ones * (1 - mean)
        return -(F.when(square > 0, cross / square).otherwise(F.lit(0.0)) + 1 / n) * F.sqrt(n)

    plain = F.translate(token, "-_", "+/")
    each = F.transform(F.array(*(F.lit(c) for c in alphabet)), lambda c: n - F.length(F.replace(plain, c, F.lit(""))))
    chi = F.aggregate(each, F.lit(0.0), lambda a, c: a + c * c) * float(k) / n - n
    return F.array(even, runs, let(count(own), serial), _cubed(chi, k - 1))


def _ordinary_p(token: Column, which: int) -> Column:
    """The probability that an ordinary token of this length and encoding scores as low; 1 for what is no random token either."""
    a, b, spread = ORDINARY[which]
    mean = a + b * F.sqrt(F.length(token).cast("double"))

    def judged(z: Column) -> Column:
        odd = (z[1] < -TOO_ODD) | (z[2] < -TOO_ODD) | (z[3] > TOO_ODD)
        return F.when(odd, F.lit(1.0)).otherwise(_tail((mean - (z[0] + z[1] + z[2]) / 3**0.5) / spread))

    return let(_scores(token, which), judged)


def _encoding(token: Column) -> Column:
    """The place of the token's encoding in ENCODINGS, or null."""
    found = F.lit(None).cast("int")
    for i, (_, _, whole, some) in reversed(list(enumerate(ENCODINGS))):
        found = F.when(token.rlike(whole) & token.rlike(some), i).otherwise(found)
    return found


def _tested(text: Column) -> Column:
    """s, e, stratum and p-value of every token that has an encoding."""
    kind = "array<struct<s:int,e:int,stratum:int,p:double>>"

    def p_value(token: Column, which: Column) -> Column:
        found = F.when(which == 0, _ordinary_p(token, 0))
        for i in range(1, len(ENCODINGS)):
            found = found.when(which == i, _ordinary_p(token, i))
        return found

    def stratum(length: Column) -> Column:
        return sum(((length >= b).cast("int") for b in STRATA), F.lit(0))

    def each(span: Column) -> Column:
        test = lambda which: F.struct(span["s"].alias("s"), span["e"].alias("e"), stratum(span["e"] - span["s"]).alias("stratum"), p_value(span["m"], which).alias("p"))
        return let(_encoding(span["m"]), lambda which: F.when(which.isNotNull(), test(which)))

    found = F.filter(F.transform(_spans(text, TOKEN, 3), each), lambda x: x.isNotNull())
    return F.when(text.rlike(TOKEN), found.cast(kind)).otherwise(F.array().cast(kind))


def _limits(scanned: DataFrame) -> DataFrame:
    """For each stratum the highest p-value that is called random: at most a row for each stratum.

    A value of rank k among m is called if one no smaller is at most FALSE_DISCOVERIES * k / m.
    Values above FALSE_DISCOVERIES count in m only. Ranks are two-level sums: bins of
    log p, bounded in number, are summed in one place, values inside their bin.
    """
    tested = scanned.select(F.explode("tested").alias("t")).select(F.col("t.stratum").alias("stratum"), F.when(F.col("t.p") <= FALSE_DISCOVERIES, F.col("t.p")).alias("p"))
    values = tested.groupBy("stratum", "p").agg(F.count("*").alias("n")).withColumn("bin", F.floor(-F.log10("p") * DECADE_BINS))
    bins = values.groupBy("stratum", "bin").agg(F.sum("n").alias("inside"))
    upto = F.sum("inside").over(Window.partitionBy("stratum").orderBy(F.col("bin").desc_nulls_last()))
    placed = bins.select("stratum", "bin", (upto - F.col("inside")).alias("before"), F.sum("inside").over(Window.partitionBy("stratum")).alias("m"))
    rank = F.col("before") + F.sum("n").over(Window.partitionBy("stratum", "bin").orderBy("p"))
    ranked = values.join(F.broadcast(placed), ["stratum", "bin"]).select("stratum", "p", "m", rank.alias("rank"))
    return ranked.where(F.col("p") <= FALSE_DISCOVERIES * F.col("rank") / F.col("m")).groupBy("stratum").agg(F.max("p").alias("p"))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns ``base`` and ``spans``: arrays of (kind, s, e), code points, end exclusive.

    kind counts KINDS. base holds the matches of the patterns; spans those and the
    tokens called random that no base span touches. A null or empty text has none. Columns
    named base or spans are replaced, all others pass; repeated rows are scanned
    each. Texts are read once: what is found is written first, and one number for
    each stratum of lengths comes back to it.
    """
    rest = [c for c in docs.columns if c not in ("base", "spans")]
    return _found(docs, rest).select("row.*", "base", "spans")


def _found(docs: DataFrame, rest: list[str]) -> DataFrame:
    """The columns ``rest`` as one struct named row, so that no name can clash, with base and spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = docs.select(F.struct(*(F.col(named(c)) for c in rest)).alias("row"), base_spans(text).alias("base"), _tested(text).alias("tested"))
    scanned = materialize(scanned, "scanned")
    limits = _limits(scanned).agg(F.map_from_entries(F.collect_list(F.struct("stratum", "p"))).alias("limits"))
    judged = scanned.crossJoin(F.broadcast(limits))  # one row
    random = F.filter("tested", lambda t: t["p"] <= F.coalesce(F.element_at(F.col("limits"), t["stratum"]), F.lit(-1.0)))
    apart = let(_span_blocks(F.col("base")), lambda blocks: F.filter(random, lambda t: ~_touched(blocks, t)))
    added = F.when(F.size("base") == 0, random).otherwise(apart)
    added = F.transform(added, lambda t: F.struct(F.lit(3).alias("kind"), t["s"].alias("s"), t["e"].alias("e")))
    return judged.select("row", "base", _in_order(F.concat("base", added)).alias("spans"))


def _in_blocks(values: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of each _BLOCK neighbouring elements of an array that holds some."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: body(F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK))))


def _span_blocks(spans: Column) -> Column:
    """Spans by neighbours, with the stretch that each block of them covers."""
    edges = lambda part: F.struct(F.array_min(F.transform(part, lambda x: x["s"])).alias("s"), F.array_max(F.transform(part, lambda x: x["e"])).alias("e"), part.alias("part"))
    return F.when(F.size(spans) > 0, _in_blocks(spans, edges))


def _touched(blocks: Column, t: Column) -> Column:
    meets = lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])
    return F.exists(blocks, lambda block: meets(block) & F.exists(block["part"], meets))


def _of_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def spans_text(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    counts = [_of_kind(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return _found(docs, ["doc_id"]).select("row.doc_id", *counts, F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def _stretch(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to before ``end`` of a text in pieces of _PIECE code points."""
    first = F.floor(start / _PIECE).cast("int")
    joined = F.array_join(F.slice(pieces, first + 1, F.floor((end - 1) / _PIECE).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(joined, start - first * _PIECE + 1, end - start)).otherwise(F.lit(""))


def _redacted(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with ``mark`` for each stretch of spans that overlap; some time for each span and code point, not for their product."""

    def rebuilt(pieces: Column, ends: Column, tops: Column) -> Column:
        def reached(i: Column) -> Column:
            """How far the first i spans reach."""
            whole = F.floor(i / _BLOCK).cast("int")
            return F.greatest(F.lit(0), F.array_max(F.slice(tops, F.lit(1), whole)), F.array_max(F.slice(ends, whole * _BLOCK + 1, i - whole * _BLOCK)))

        kept = F.transform(spans, lambda x, i: let(reached(i), lambda at: F.when(x["s"] >= at, F.concat(_stretch(pieces, at, x["s"]), F.lit(mark))).otherwise(F.lit(""))))
        return F.concat(F.array_join(kept, ""), _stretch(pieces, F.array_max(ends), F.length(text)))

    ends = F.transform(spans, lambda x: x["e"])
    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)), lambda pieces: let(ends, lambda e: let(_in_blocks(e, F.array_max), lambda tops: rebuilt(pieces, e, tops))))


def redact_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``; other columns unchanged, a null text stays null."""
    text = F.col("row.text")
    redacted = F.when(F.size("spans") > 0, _redacted(text, F.col("spans"), mark)).otherwise(text)
    return _found(docs, docs.columns).select(*(redacted.alias("text") if c == "text" else F.col(f"row.{named(c)}") for c in docs.columns))
