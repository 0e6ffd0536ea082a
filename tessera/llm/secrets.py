"""Secret scan: fixed patterns, and a randomness test battery, in DataFrame expressions only.

Long tokens outside the patterns' spans are tested under the alphabet of the encoding they seem to
be in (hexadecimal, base 32, base 36, base 64): chi-squared uniformity of characters and of
character classes, Wald-Wolfowitz runs about the alphabet's middle, and lag-1 serial correlation.
A token whose combined p-value (Bonferroni) falls below LEAST is not random. The others are
reported as far as a false-discovery bound on the *reported* tokens allows: the null hypothesis is
"drawn like the ordinary tokens of its encoding", whose character frequencies come from the tokens
that the battery rejects beyond PLAIN, on top of fixed ones. A token's evidence against it is its likelihood
ratio (uniform over ordinary), an e-value that grows with length; of m tested tokens the k with
the greatest evidence are reported for the greatest k whose evidence all reaches m / (k * RATE).

All work on a text is linear in its length: each stage of a token is bound once, characters are
counted in native string operations, and positions are summed in blocks.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import let, materialize

# The base patterns in their listed order. Runs of at least the least length are the
# maximal runs that reach it, so hex and access need no later filter.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX, MIN_VALUE = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}", 6
KINDS = ("assign", "access", "hex", "random")
TOKEN, RATE, LEAST, PLAIN = "[A-Za-z0-9+/_=-]{20,}", 0.05, 0.001, 1e-6
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings, first fit wins: (name, pattern, alphabet, share of each class of characters in
#: ordinary tokens). The classes are digits, upper case, lower case and the rest.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef", (0.97, 0, 0.03, 0)),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF", (0.97, 0.03, 0, 0)),
    ("base32", "^[A-Z2-7]+=*$", _UPPER + "234567", (0.03, 0.97, 0, 0)),
    ("base36", "^[a-z0-9]+$", _DIGITS + _LOWER, (0.07, 0, 0.93, 0)),
    ("BASE36", "^[A-Z0-9]+$", _DIGITS + _UPPER, (0.07, 0.93, 0, 0)),
    ("base64", "^[A-Za-z0-9+/_=-]+$", _UPPER + _LOWER + _DIGITS + "+/", (0.07, 0.08, 0.80, 0.05)),
)
CLASSES = (_DIGITS, _UPPER, _LOWER, "+/")
#: Letters a to z in a thousand of English text; and their weight in characters.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
PRIOR = 1000.0
#: Matches whose positions are summed together; a matter of speed only.
BLOCK = 256
#: Evidence beyond so many bits is enough for any number of tests.
ENOUGH, STEPS = 100, 8
_SPAN = "array<struct<start:int,end:int,kind:int,m:string,v:string>>"


def spans(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """array<struct<start, end, kind, m, v>> of a pattern's leftmost matches, in code points."""

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        value = F.regexp_extract(x["m"], pattern, group) if group else x["m"]
        one = F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), F.lit(KINDS.index(kind)).alias("kind"), x["m"].alias("m"), value.alias("v"))
        return F.struct((start + F.length(x["m"])).alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    def block(state: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(state["at"].alias("at"), F.array().cast(_SPAN).alias("out")), step)
        return let(inner, lambda w: F.struct(w["at"].alias("at"), F.concat(state["out"], F.array(w["out"])).alias("out")))

    def walked(found: Column) -> Column:
        gaps = F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m")))
        steps = let(gaps, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda k: F.filter(F.slice(s, k * BLOCK + 1, F.lit(BLOCK)), lambda x: x["m"].isNotNull())))
        first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
        return F.flatten(F.aggregate(steps, first, block)["out"])

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: F.when(F.size(f) > 0, walked(f)).otherwise(F.array().cast(_SPAN)))


def tail(z: Column) -> Column:
    """Upper tail of the normal distribution, to a relative error of 2e-7 (a Chebyshev fit of erfc)."""
    # Coefficients of the fit, from the constant up.
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    root = math.sqrt(2)

    def half(v: Column) -> Column:
        sum_ = reduce(lambda rest, c: F.lit(c) + v["t"] * rest, reversed(fit[:-1]), F.lit(fit[-1]))
        upper = v["t"] * F.exp(sum_ - v["x"] * v["x"]) / 2
        return F.when(v["z"] >= 0, upper).otherwise(1 - upper)

    return let(let(z, lambda z: F.struct(z.alias("z"), (F.least(F.lit(37.0), F.abs(z)) / root).alias("x"))), lambda v: let(F.struct(v["z"].alias("z"), v["x"].alias("x"), (1 / (1 + v["x"] / 2)).alias("t")), half))


def _by_encoding(code: Column, values: list) -> Column:
    """The value of an encoding's index."""
    return F.element_at(F.array(*map(F.lit, values)), code + 1)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _chi_tail(stat: Column, df: Column) -> Column:
    """Upper tail of a chi-squared statistic, by the cube-root transform."""
    part = 2 / (9 * df)
    return tail((F.pow(F.greatest(stat, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - part)) / F.sqrt(part))


def tested(m: Column) -> Column:
    """struct<code, n, counts, p> of a token: its encoding, characters, their counts over the
    alphabet, and the battery's combined p-value (small for tokens not random in their encoding)."""
    code = reduce(lambda rest, k: F.when(m.rlike(ENCODINGS[k][1]), F.lit(k)).otherwise(rest), reversed(range(len(ENCODINGS) - 1)), F.lit(len(ENCODINGS) - 1))
    return let(F.struct(code.alias("code"), F.regexp_replace(F.translate(m, "-_", "+/"), "=+$", "").alias("plain")), _battery)


def _battery(x: Column) -> Column:
    code, plain = x["code"], x["plain"]
    n = F.greatest(F.length(plain), F.lit(2)).cast("double")
    size = _by_encoding(code, [float(len(e[2])) for e in ENCODINGS])
    alphabet = _by_encoding(code, [e[2] for e in ENCODINGS])
    counts = F.transform(_chars(alphabet), lambda c: F.length(plain) - F.length(F.replace(plain, c, F.lit(""))))
    # One pass over the characters' places: count above the middle, runs, sums and lagged products.
    codes = let(alphabet, lambda a: F.transform(_chars(plain), lambda c: (F.position(c, a) - 1).cast("double")))
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("first"), none.alias("last"), *[F.lit(0.0).alias(k) for k in ("high", "runs", "sum", "squares", "lag")])

    def step(s: Column, c: Column) -> Column:
        return F.struct(
            F.coalesce(s["first"], c).alias("first"),
            c.alias("last"),
            (s["high"] + F.when(c * 2 >= size, 1.0).otherwise(0.0)).alias("high"),
            (s["runs"] + F.when(s["last"].isNull() | ((c * 2 >= size) != (s["last"] * 2 >= size)), 1.0).otherwise(0.0)).alias("runs"),
            (s["sum"] + c).alias("sum"),
            (s["squares"] + c * c).alias("squares"),
            (s["lag"] + F.coalesce(s["last"] * c, F.lit(0.0))).alias("lag"),
        )

    return let(
        F.struct(code.alias("code"), n.alias("n"), size.alias("size"), counts.alias("counts"), F.aggregate(codes, start, step).alias("s")),
        lambda y: F.struct(y["code"].alias("code"), F.length(plain).alias("n"), y["counts"].alias("counts"), _combined(y).alias("p")),
    )


def _combined(y: Column) -> Column:
    n, size, s = y["n"], y["size"], y["s"]
    chi = size / n * F.aggregate(y["counts"], F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")) - n
    shares = [[sum(c in kind for c in e[2]) / len(e[2]) for e in ENCODINGS] for kind in CLASSES]
    signs = _chars(_by_encoding(y["code"], [e[2] for e in ENCODINGS]))
    spread, kinds = -n, F.lit(-1.0)
    for kind, share in zip(CLASSES, shares, strict=True):
        within = F.zip_with(y["counts"], signs, (lambda k: lambda c, g: F.when(F.lit(k).contains(g), c).otherwise(0))(kind))
        held = F.aggregate(within, F.lit(0.0), lambda a, c: a + c)
        expected = _by_encoding(y["code"], share)
        spread = spread + F.when(expected > 0, held * held / (n * F.greatest(expected, F.lit(1e-9)))).otherwise(0.0)
        kinds = kinds + F.when(expected > 0, 1.0).otherwise(0.0)
    p_chi, p_class = _chi_tail(chi, size - 1), let(F.struct(spread.alias("x"), F.greatest(kinds, F.lit(1.0)).alias("df")), lambda z: _chi_tail(z["x"], z["df"]))
    mu = 2 * s["high"] * (n - s["high"]) / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    p_runs = F.when(var > 0, F.least(F.lit(1.0), 2 * tail(F.abs(s["runs"] - mu) / F.sqrt(F.greatest(var, F.lit(1e-9)))))).otherwise(0.0)
    mean = s["sum"] / n
    dev = s["squares"] - n * mean * mean
    lag = s["lag"] - mean * (2 * s["sum"] - s["first"] - s["last"]) + (n - 1) * mean * mean
    p_serial = F.when(dev > 1e-6, F.least(F.lit(1.0), 2 * tail(F.abs(lag / F.greatest(dev, F.lit(1e-9)) + 1 / n) * F.sqrt(n)))).otherwise(0.0)
    return F.least(F.lit(1.0), 4 * F.least(p_chi, p_class, p_runs, p_serial))


def weights(held: dict[tuple[int, int], int]) -> list[list[float]]:
    """Bits of evidence of each character by encoding, from the characters of ordinary tokens.

    ``held[code, place]`` are the counts of the whole table; fixed frequencies weigh as PRIOR
    characters beside them.
    """
    out = []
    for k, (_, _, alphabet, shares) in enumerate(ENCODINGS):
        prior = []
        for c in alphabet:
            kind = next(j for j, chars in enumerate(CLASSES) if c in chars)
            own = LETTERS[ord(c.lower()) - 97] if c.isalpha() else 1
            all_ = sum(LETTERS[ord(x.lower()) - 97] if x.isalpha() else 1 for x in alphabet if x in CLASSES[kind])
            prior.append(PRIOR * shares[kind] * own / all_)
        total = sum(prior) + sum(held.get((k, j), 0) for j in range(len(alphabet)))
        out.append([math.log2(total / len(alphabet) / (w + held.get((k, j), 0))) for j, w in enumerate(prior)])
    return out


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """(id, base, extra) for every row of ``docs``: spans of the patterns, and of random tokens.

    Spans are structs (start, end, kind, m, v) in order, kind an index of KINDS. Tokens are sought
    outside the assignments and left out where they hold another base span. Nulls: a null text
    is an empty one, a null id is carried. Repeated rows are scanned each, and each counts among
    the tests. An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    # Assignments become white space of equal length, so that tokens are sought around them only.
    blank = lambda x: F.when(F.length(x["v"]) >= MIN_VALUE, F.repeat(F.lit(" "), F.length(x["m"]))).otherwise(x["m"])
    masked = F.array_join(F.zip_with(F.split(F.col("text"), ASSIGN, -1), F.transform("assign", blank), lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    masked = F.when(F.size("assign") > 0, masked).otherwise(F.col("text"))
    tokens = let(masked, lambda t: F.filter(spans(t, TOKEN, "random"), lambda x: ~x["m"].rlike(HEX) & ~x["m"].rlike(ACCESS)))
    rows = rows.withColumn("assign", spans(F.col("text"), ASSIGN, "assign", 2))
    base = F.concat(F.filter("assign", lambda x: F.length(x["v"]) >= MIN_VALUE), spans(F.col("text"), ACCESS, "access"), spans(F.col("text"), HEX, "hex"))
    tests = F.transform(tokens, lambda x: F.struct(x.alias("span"), tested(x["m"]).alias("t")))
    rows = materialize(rows.select("id", F.array_sort(base).alias("base"), tests.alias("tests")), "scanned")
    each = rows.select(F.explode("tests.t").alias("t"))
    ordinary = each.where(F.col("t.p") < PLAIN).select(F.col("t.code").alias("code"), F.posexplode("t.counts").alias("place", "n"))
    held = {(r.code, r.place): int(r.n) for r in ordinary.groupBy("code", "place").agg(F.sum("n").alias("n")).collect()}
    table = F.from_json(F.lit(json.dumps(weights(held))), "array<array<double>>")
    bits = lambda t: F.aggregate(F.zip_with(t["counts"], F.element_at(table, t["code"] + 1), lambda c, w: c * w), F.lit(0.0), lambda a, x: a + x)
    # Steps of evidence, rounded down; at most ENOUGH * STEPS + 2 rows whatever the input.
    place = lambda t: F.when(t["p"] < LEAST, F.lit(-1)).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(ENOUGH)), bits(t))) * STEPS).cast("int"))
    grid = each.select(place(F.col("t")).alias("g")).groupBy("g").count().collect()
    total, seen, bound = sum(r["count"] for r in grid), 0, ENOUGH * STEPS + 1
    for r in sorted(grid, key=lambda r: -r["g"]):
        seen += r["count"]
        if r["g"] >= 0 and 2.0 ** (r["g"] / STEPS) * seen * rate >= total:
            bound = r["g"]
    return rows.select("id", "base", F.transform(F.filter("tests", lambda x: place(x["t"]) >= bound), lambda x: x["span"]).alias("extra"))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, by start, then kind."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
