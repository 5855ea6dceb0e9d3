"""Secret scans: fixed patterns, then a battery of randomness tests on the tokens that they leave."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.llm.exprs import let
from hazardlens.llm.io import Stash
from hazardlens.llm.spans import clear_of, count_of, joined, matches, spans

KINDS = ("assign", "access", "hex")
#: Fixed by the operator's contract.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}+"  # maximal runs, as [0-9a-f]+ finds, of 16 or more

_PLAIN, _URL = "[A-Za-z0-9+/]{20,}+", "[A-Za-z0-9_-]{20,}+"
#: Tokens that the battery tests: runs of 20 or more characters of one of the two widest alphabets and their padding. An
#: equals sign inside ends a token; a run that mixes + or / with _ or - gives its parts that one alphabet covers.
TOKEN = f"(?:{_PLAIN}(?![_-])|{_URL}(?![+/])|{_PLAIN}|{_URL})(?:=++(?![A-Za-z0-9+/_-]))?+"
#: name, pattern of tokens that it covers, alphabet in order; the first that fits is the token's encoding.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Length classes begin at these; within each, randomness is rejected at the highest of LEVELS that Benjamini and Hochberg allow for FDR.
CLASSES, FDR = (20, 32, 64), 0.05
LEVELS = tuple(FDR / 2**i for i in range(24))


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z), by the logistic-type approximation of Bowling et al. (error below 2e-4); at least 1e-12."""
    return F.greatest(F.lit(1e-12), 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.07056 * z * z * z))))


def random_p(token: Column) -> Column:
    """P value of ``token`` (20 characters or more) under the hypothesis of uniform independent characters.

    Chi-squared uniformity over the inferred alphabet (upper tail), a runs test about the alphabet's middle and lag-1
    serial correlation (both two-sided), combined by Fisher's method. 0 for a token that no alphabet covers.
    """

    def statistics(x: Column, squares: Column, size: int) -> Column:
        """``x``: places in an alphabet of ``size``; ``squares``: sum of squared character counts."""
        n = F.size(x).cast("double")
        total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, t: s + t)
        chi = (squares * size / n - n - (size - 1)) / math.sqrt(2 * (size - 1))
        high = F.size(F.filter(x, lambda t: t >= size // 2)).cast("double")
        low = n - high
        half = lambda t: (t >= size // 2).cast("int")
        runs = F.size(F.filter(F.zip_with(x, F.slice(x, 2, F.size(x)), lambda s, t: half(s) != half(t)), lambda t: F.coalesce(t, F.lit(False)))) + 1
        mean = 2 * high * low / n + 1
        spread = F.sqrt((mean - 1) * (mean - 2) / (n - 1))
        z_runs = F.when((high == 0) | (low == 0) | (spread <= 0), F.lit(6.0)).otherwise(F.abs((runs - mean) / F.nullif(spread, F.lit(0.0))))
        s1, s2 = total(F.transform(x, lambda t: t.cast("double"))), total(F.transform(x, lambda t: (t * t).cast("double")))
        s11 = total(F.transform(F.zip_with(x, F.slice(x, 2, F.size(x)), lambda s, t: s * t), lambda t: F.coalesce(t, F.lit(0)).cast("double")))
        varies = n * s2 - s1 * s1
        serial = F.when(varies <= 0, F.lit(6.0)).otherwise(F.abs(((n * s11 - s1 * s1) / F.nullif(varies, F.lit(0.0)) + 1 / n) * F.sqrt(n)))
        p = [_upper_tail(chi), F.least(F.lit(1.0), 2 * _upper_tail(z_runs)), F.least(F.lit(1.0), 2 * _upper_tail(serial))]
        half_fisher = -(F.log(p[0]) + F.log(p[1]) + F.log(p[2]))
        return let(half_fisher, lambda h: F.exp(-h) * (1 + h + h * h / 2))

    def battery(body: Column, alphabet: str) -> Column:
        chars = F.filter(F.split(body, ""), lambda c: c != "")
        places = F.transform(chars, lambda c: F.call_function("locate", c, F.lit(alphabet)) - 1)
        counts = F.transform(F.array_distinct(chars), lambda c: F.length(body) - F.length(F.replace(body, c, F.lit(""))))
        squares = F.aggregate(counts, F.lit(0.0), lambda s, k: s + (k * k).cast("double"))
        return let(places, lambda x: statistics(x, squares, len(alphabet)))

    def of(alphabet: str) -> Column:
        return let(F.rtrim(token, F.lit("=")), lambda body: F.when(F.length(body) >= 16, battery(body, alphabet)).otherwise(F.lit(0.0)))

    out = None
    for _, fits, alphabet in ENCODINGS:
        found = of(alphabet)
        out = F.when(token.rlike(fits), found) if out is None else out.when(token.rlike(fits), found)
    return out.otherwise(F.lit(0.0))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start and then kind."""
    assign = spans(matches(text, ASSIGN, text.rlike("(?i:passw|secret|token|api_?key)")), "assign", 0, lambda m: F.length(F.regexp_extract(m, f"^{ASSIGN}", 2)) >= 12)
    access = spans(matches(text, ACCESS, F.contains(text, F.lit("AKIA"))), "access", 1, lambda m: F.length(m) >= 18)
    hexes = spans(matches(text, HEX, text.rlike(HEX)), "hex", 2, lambda m: F.length(m) >= 16)
    return F.sort_array(F.concat(assign, access, hexes))


def _class(n: Column) -> Column:
    return sum(((n >= x).cast("int") for x in CLASSES[1:]), F.lit(0))


def scan(docs: DataFrame, stash: Stash) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    Null text counts as empty: no spans, and the digest of nothing. Repeated rows give repeated results; an empty
    table gives an empty one; other columns are not read. Beyond the base, a span of kind ``random`` is a token of 20
    characters or more with a digit and a letter, clear of all base spans, that the randomness battery doesn't reject.
    The level is set for each length class by Benjamini and Hochberg on the p values themselves: the highest level times
    the tokens tested is at most 5 % of those it rejects, so of the rejected ones at most some 5 % are random, in a table
    of any size. Ordinary tokens that the battery doesn't reject are added too. The counts come from all documents,
    through one aggregation to a single row.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    tokens = clear_of(matches(F.col("text"), TOKEN, F.col("text").rlike(TOKEN)), F.col("base"))

    def tested(x: Column) -> Column:
        m = x["match"]
        ordinary = m.rlike("^[A-Za-z]+$")
        return F.struct(
            x["start"].alias("start"), F.lit(len(KINDS)).alias("place"), x["end"].alias("end"), F.lit("random").alias("kind"),
            _class(F.length(m)).alias("class"), random_p(m).alias("p"), ordinary.alias("ordinary"),
        )

    able = F.filter(tokens, lambda x: x["match"].rlike("[A-Za-z]"))
    rows = stash.keep(rows.select("doc_id", "base", F.transform(able, tested).alias("tokens")), "tokens")
    one = rows.select(F.explode("tokens").alias("t")).select("t.*").filter(~F.col("ordinary"))
    sums = []
    for c in range(len(CLASSES)):
        own = F.col("class") == c
        sums += [F.count_if(own).alias(f"k{c}"), *[F.count_if(own & (F.col("p") <= level)).alias(f"k{c}_{i}") for i, level in enumerate(LEVELS)]]
    limits = []
    for c in range(len(CLASSES)):
        limit = F.lit(0.0)
        for i in reversed(range(len(LEVELS))):
            limit = F.when(LEVELS[i] * F.col(f"k{c}") <= FDR * F.col(f"k{c}_{i}"), F.lit(LEVELS[i])).otherwise(limit)
        limits.append(limit)
    limits = one.agg(*sums).select(F.array(*limits).alias("limits"))
    rows = rows.crossJoin(F.broadcast(limits))
    added = F.filter("tokens", lambda x: ~x["ordinary"] & (x["p"] > F.get(F.col("limits"), x["class"])))
    added = F.transform(added, lambda x: F.struct(x["start"].alias("start"), x["place"].alias("place"), x["end"].alias("end"), x["kind"].alias("kind")))
    rows = rows.select("doc_id", "base", F.sort_array(F.concat("base", added)).alias("every"))
    return rows.select(
        "doc_id", *[count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("every")).alias("spans"),
    )
