import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from corpusloom.llm import secrets

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def texts():
    rng = random.Random(4)
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    b64 = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(44))
    out = [None, "", "token: api_key = abcdefgh12", "token=secret=abcdefghij", "PassWord = 'hunter22'", "password: short", "x" * 300, f'token = "{hexes}" é😀 api_key:{b64}', f"😀😀 AKIA{'A1' * 8} AKIAshort AKIAAAAAAAAAAA", "a" * 31 + " " + "b" * 32, hexes * 3]
    out += [f"some words {b64} more", "thisisaverylongplainwordthatgoeson aaaaaaaaaa1111111111aaaaaaaaaa1111111111", "token=abcdefgh " * 3000, "secret\n=abcdefgh", "api-key=abcdefgh1 apikey=abcdefgh2"]
    pieces = ["token", "Secret", "=", ":", " ", '"', "'", "abcdefgh", "AKIA", "ZZZZ9999", "0123456789abcdef", "é", "\n", "_", "password", "api_key", "x"]
    return out + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(300)]


def test_base_spans_equal_the_patterns(spark):
    rows = [(i, t, "b", 1) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string, spans int")
    got = {r.doc_id: r for r in secrets.secret_digests(df).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        found = base(t or "")
        named = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in found)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in found) for x in range(3))
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == [x for x in named.split(",") if x]


def test_random_tokens_are_found_and_plain_ones_left(spark):
    rng = random.Random(9)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    random_ones = ["".join(rng.choice(alphabet) for _ in range(44)) for _ in range(200)]
    plain = [("Section" + "".join(rng.choice(["the", "and", "for", "ing"]) for _ in range(12)) + "2024")[:40] for _ in range(200)]
    df = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(random_ones + plain)], "doc_id long, text string")
    flagged = {r.doc_id for r in secrets.secret_digests(df).collect() if "random" in r.spans}
    assert len([i for i in flagged if i < 200]) >= 180 and len([i for i in flagged if i >= 200]) <= 20


def test_normal_tail(spark):
    zs = [-3.0, -1.0, 0.0, 0.5, 2.0, 5.0]
    got = [r.p for r in spark.createDataFrame(list(enumerate(zs)), "i int, z double").select("i", secrets._tail(F.col("z")).alias("p")).orderBy("i").collect()]
    assert all(abs(p - math.erfc(z / math.sqrt(2)) / 2) < 1e-6 for p, z in zip(got, zs))


def test_redaction(spark, awkward, empty):
    df = spark.createDataFrame([(1, "é token=abcdefgh tail", 3), (2, None, 4), (3, "plain", 5)], "doc_id long, text string, spans int")
    out = secrets.redact_secrets(df)
    assert out.columns == df.columns
    assert {r.doc_id: (r.text, r.spans) for r in out.collect()} == {1: ("é [secret] tail", 3), 2: (None, 4), 3: ("plain", 5)}
    assert secrets.redact_secrets(awkward[0]).count() == len(awkward[1])
    assert secrets.secret_digests(empty).count() == 0


def test_rejections_are_those_of_the_exact_procedure(spark):
    rng, rows, values, expected = random.Random(3), [], {}, {}
    for stratum, plain in enumerate((50, 100, 150, 0)):
        ps = [1e-9] * plain + [rng.random() for _ in range(10_000 - plain)]
        ranked = sorted(ps)
        expected[stratum] = max((k for k, p in enumerate(ranked, 1) if p <= secrets.FALSE_DISCOVERIES * k / len(ps)), default=0)
        values[stratum] = ps
        rows += [([(0, 20, stratum, p)],) for p in ps]
    df = spark.createDataFrame(rows, "tested array<struct<s:int,e:int,stratum:int,p:double>>")
    limits = {r.stratum: r.p for r in secrets._limits(df).collect()}
    got = {k: sum(p <= limits.get(k, -1) for p in ps) for k, ps in values.items()}
    assert got == expected and all(expected[k] >= n for k, n in enumerate((50, 100, 150)))


def test_few_plain_tokens_among_many_random_ones_are_left(spark):
    rng = random.Random(12)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    made = ["".join(rng.choice(alphabet) for _ in range(44)) for _ in range(600)] + ["A" + "a" * 42 + "1"] * 5
    df = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(made)], "doc_id long, text string")
    flagged = {r.doc_id for r in secrets.secret_digests(df).collect() if "random" in r.spans}
    assert len([i for i in flagged if i < 600]) >= 540 and not [i for i in flagged if i >= 600]


def tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def cubed(chi, freedom):
    spread = 2 / (9 * freedom)
    return ((max(chi, 0) / freedom) ** (1 / 3) - (1 - spread)) / math.sqrt(spread)


def plain_p(token):
    """The p-value of one token under ordinary text, or None without an encoding."""
    for which, (_, alphabet, whole, some) in enumerate(secrets.ENCODINGS):
        if re.search(whole.replace("\\z", "\\Z"), token) and re.search(some, token):
            break
    else:
        return None
    n, k = len(token), len(alphabet)
    cells = [(sum(bool(re.match(c, x)) for x in token), n * size / k) for c, size in secrets.CELLS[which]]
    even = cubed(sum((o - e) ** 2 / e for o, e in cells), len(cells) - 1)
    kind = [next(i for i, (c, _) in enumerate(secrets.CLASSES[which]) if re.match(c, x)) for x in token]
    p = [size / k for _, size in secrets.CLASSES[which]]
    same, thrice = sum(x**2 for x in p), sum(x**3 for x in p)
    variance = (n - 1) * same * (1 - same) + 2 * (n - 2) * (thrice - same**2)
    runs = (1 + (n - 1) * (1 - same) - 1 - sum(a != b for a, b in zip(kind, kind[1:]))) / math.sqrt(variance)
    x = [bool(re.match(secrets.NEIGHBOURS[which], c)) for c in token]
    d = [v - sum(x) / n for v in x]
    square = sum(v * v for v in d)
    serial = -((sum(a * b for a, b in zip(d, d[1:])) / square if square > 1e-9 else 0) + 1 / n) * math.sqrt(n)
    plain = token.replace("-", "+").replace("_", "/")
    every = cubed(sum(plain.count(c) ** 2 for c in alphabet) * k / n - n, k - 1)
    if runs < -secrets.TOO_ODD or serial < -secrets.TOO_ODD or every > secrets.TOO_ODD:
        return 1.0
    a, b, spread = secrets.ORDINARY[which]
    return tail((a + b * math.sqrt(n) - (even + runs + serial) / math.sqrt(3)) / spread)


def plain_scan(texts):
    """Spans of kind random in each text, with the step-up test over all tokens of a stratum."""
    tested, ps = [], {}
    for d, text in enumerate(texts):
        for m in re.finditer(secrets.TOKEN, text):
            if (p := plain_p(m[0])) is not None:
                stratum = sum(len(m[0]) >= b for b in secrets.STRATA)
                tested.append((d, m.start(), m.end(), stratum, p))
                ps.setdefault(stratum, []).append(p)
    limit = {}
    for stratum, values in ps.items():
        ranked = sorted(values)
        limit[stratum] = max((p for k, p in enumerate(ranked, 1) if p <= secrets.FALSE_DISCOVERIES * k / len(ranked)), default=-1)
    out = [[] for _ in texts]
    for d, s, e, stratum, p in tested:
        if p <= limit[stratum] and not any(a < e and s < b for a, _, b in base(texts[d])):
            out[d].append(f"random:{s}:{e}")
    return out


def test_random_spans_equal_a_plain_version(spark):
    rng = random.Random(21)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    kinds = [alphabet for _, alphabet, *_ in secrets.ENCODINGS]
    periodic = lambda n: (draw(kinds[3], 3) + "a1B") * (n // 6 + 1)
    token = lambda: rng.choice([lambda: draw(rng.choice(kinds), rng.randint(20, 120)), lambda: periodic(60)[: rng.randint(20, 60)], lambda: "the-quick_brown/fox+jumps2024Over"])()
    texts = [" é ".join(rng.choice([token(), "word", f"token={draw(kinds[0], 12)}"]) for _ in range(rng.randint(0, 12))) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("random")] for r in secrets.secret_digests(df).collect()}
    want = plain_scan(texts)
    assert sum(map(len, want)) > 300 and all(got[d] == want[d] for d in range(700))


WORDS = "get set user account value name index count list file path size buffer string number type key map node tree hash code block stream reader writer input output state status error message event handler factory manager service client request response session token cache queue thread process task worker pool image color width height frame video audio player score point vector matrix table column row record query filter sort order group merge parse format print debug test check valid option default public static abstract method object module import version update delete insert select remove append prefix start open close load save store send connect network socket port host domain page view model control button label window panel menu icon mouse click zoom rotate scale render draw shape line curve mesh light camera scene system physics force mass speed time date year month day hour minute clock calendar email phone customer price amount total tax payment invoice report summary title author comment rating category tag search match pattern rule policy license".split()


def name(rng, n, style):
    """A name of n characters made of words, with a number in it."""
    joined = ""
    while len(joined) < n:
        word = rng.choice(WORDS)
        joined += (word if style == "camel" and not joined else word.capitalize()) + {"snake": "_", "path": "/"}.get(style, "")
    digits = str(rng.randint(0, 9999))
    at = rng.choice([n - len(digits), rng.randint(1, n - len(digits))])
    return joined[:at] + digits + joined[at : n - len(digits)]


def flagged(spark, tokens):
    df = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(tokens)], "doc_id long, text string").repartition(8)
    return {r.doc_id for r in secrets.secret_digests(df).collect() if "random" in r.spans}


def test_names_are_left_whatever_their_share(spark):
    rng = random.Random(77)
    alphabet = secrets.ENCODINGS[3][1]
    for names, drawn in ((1000, 10), (1000, 1000), (20, 1000), (1000, 0)):
        plain = [name(rng, rng.randint(20, 40), rng.choice(["camel", "pascal", "snake", "path"])) for _ in range(names)]
        found = flagged(spark, plain + ["".join(rng.choice(alphabet) for _ in range(rng.randint(32, 44))) for _ in range(drawn)])
        false = sum(i < names for i in found)
        assert false <= 0.05 * len(found) and len(found) - false >= 0.9 * drawn


def test_serial_numbers_and_constants_are_left(spark):
    rng = random.Random(5)
    stamps = [f"{rng.randint(2000, 2030)}{rng.randint(1, 12):02}{rng.randint(1, 28):02}{rng.randrange(10**11):011}{rng.choice('abcdef')}" for _ in range(300)]
    counters = [f"{rng.randrange(16**6):024x}" for _ in range(300)]
    constants = ["".join(rng.choice(WORDS) for _ in range(9)).upper()[: rng.randint(22, 40)] + "2" for _ in range(300)]
    drawn = ["".join(rng.choice(secrets.ENCODINGS[e][1]) for _ in range(31 + 9 * (e > 0))) for e in (0, 1, 2) for _ in range(10)]
    found = flagged(spark, stamps + counters + constants + drawn)
    assert sum(i < 900 for i in found) <= 0.05 * len(found) and sum(i >= 900 for i in found) >= 25


def test_periodic_tokens_among_a_thousand_random_ones_are_rejected(spark):
    rng = random.Random(13)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    made = ["".join(rng.choice(alphabet) for _ in range(44)) for _ in range(1000)] + [("aB1" + chr(99 + i)) * 11 for i in range(10)]
    df = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(made)], "doc_id long, text string")
    flagged = {r.doc_id for r in secrets.secret_digests(df).collect() if "random" in r.spans}
    assert len([i for i in flagged if i >= 1000]) <= 1 and len([i for i in flagged if i < 1000]) >= 900


def test_a_text_full_of_tokens_and_secrets_takes_seconds(spark):
    rng = random.Random(2)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    text = "é" + " ".join("".join(rng.choice(alphabet) for _ in range(30)) + (" token=abcdefgh1" if i % 3 else "") for i in range(25_000))
    assert len(text) > 1_000_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    out = secrets.redact_secrets(df).first().text
    assert time.time() - began < 60
    assert out.count("[secret]") > 35_000 and "token=" not in out and len(out) < 0.7 * len(text)


def test_redaction_equals_cutting(spark):
    """Spans that touch or overlap, and stretches that cross the pieces in which a text is cut."""
    rng = random.Random(7)
    rows = []
    for i in range(40):
        parts = [rng.choice(["é" * rng.randint(0, 9000), "x " * rng.randint(0, 3000), "token=abcdefgh1", f"AKIA{'A1' * 8}", "0123456789abcdef" * 2, f"token={'0123456789abcdef' * 2}"]) for _ in range(rng.randint(0, 8))]
        rows.append((i, rng.choice(["", " "]).join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secrets.secret_digests(df).collect()}
    for r in secrets.redact_secrets(df).collect():
        text, at, out = dict(rows)[r.doc_id], 0, []
        for s, e in sorted(tuple(map(int, x.split(":")[1:])) for x in spans[r.doc_id].split(",") if x):
            out += [text[at:s], "[secret]"] if s >= at else []
            at = max(at, e)
        assert r.text == "".join(out) + text[at:]
