"""Quality rules as a short-circuit cascade."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.llm.exprs import let, n_chars_of, without, words
from hazardlens.llm.io import Stash

SYMBOLS = "#*$%&|<>"
#: Rows read to estimate costs and selectivities.
SAMPLE_ROWS = 4_000


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the same text."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(without(x, " \t\x0b\f\r")) > 0)
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in ``w``, the first occurrence included.

    Windows are compared by a 64-bit hash of their three words; only texts with some repeated hash are sorted.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(p: Column) -> Column:
            def same(x: Column, i: Column) -> Column:
                at = lambda k: F.get(p, k)["h"]
                return x["h"].eqNullSafe(at(i - 1)) | x["h"].eqNullSafe(at(i + 1))

            return F.sort_array(F.transform(F.filter(p, same), lambda x: x["i"]))

        def length(starts: Column) -> Column:
            steps = F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return let(let(pairs, repeated), length)

    def of(ws: Column) -> Column:
        at = lambda i: F.get(ws, i)
        hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
        some = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))
        return F.when(F.size(ws) < 4, F.lit(0)).otherwise(let(hashes, some))

    return of(w).cast("long")


@dataclass(frozen=True)
class Rule:
    """A document fails if ``fails`` (over the columns of ``measured`` and ``text``) is true; null counts as passed."""

    name: str
    fails: Column


def default_rules() -> list[Rule]:
    c, text = F.col, F.col("text")
    lines = F.split(text, "\n")
    ends = F.size(F.filter(lines, lambda x: F.endswith(F.rtrim(x), F.lit("...")) | F.endswith(F.rtrim(x), F.lit("…"))))
    bullets = F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^[-*•]")))
    letters = F.length(F.regexp_replace(text, "[^\\p{L}]", ""))
    return [
        Rule("symbols", c("n_symbols") * 10 > c("n_words")),
        Rule("word_length", (c("word_chars") < c("n_words") * 2) | (c("word_chars") > c("n_words") * 15)),
        Rule("repeated_lines", c("n_dup_lines") * 2 > F.size(lines)),
        Rule("ellipsis_lines", ends * 10 > F.size(lines) * 3),
        Rule("bullet_lines", bullets * 10 > F.size(lines) * 9),
        Rule("letters", letters * 2 < c("word_chars")),
    ]


def measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", text.alias("text")).withColumn("_w", words(F.col("text")))
    out = out.select(
        "doc_id", "text", F.size("_w").cast("long").alias("n_words"),
        F.length(without(F.col("text"), " \t\n\x0b\f\r")).cast("long").alias("word_chars"),
        n_chars_of(F.col("text"), SYMBOLS).alias("n_symbols"), n_dup_lines(F.col("text")).alias("n_dup_lines"),
        n_repeat_words(F.col("_w")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return out.withColumn("base_failed", failed)


def ordered(sample: DataFrame, rules: Sequence[Rule]) -> list[tuple[Rule, float, float]]:
    """Rules by rejections per second over ``sample`` (measured rows), best first, with rejection share and cost."""
    found = []
    for rule in rules:
        best, share = float("inf"), 0.0
        for _ in range(2):
            began = time.perf_counter()
            n, k = sample.agg(F.count("*"), F.count_if(rule.fails)).first()
            best, share = min(best, time.perf_counter() - began), (k / n if n else 0.0)
        found.append((rule, share, best))
    return sorted(found, key=lambda x: -(x[1] + 1e-6) / x[2])


def assess(docs: DataFrame, stash: Stash, rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 3) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.

    Null text counts as empty and fails (under 50 words); repeated rows are judged alike; an empty table gives an empty
    result; other columns are not read. ``kept`` is false if ``base_failed``; else the rules run as one CASE expression
    that stops at the first rule that fails. The order (most rejections per second first) comes from a sample of about
    ``sample_rows`` rows. It changes the time only: a document is kept when no rule fails.
    """
    rules = default_rules() if rules is None else list(rules)
    n = docs.select("doc_id").count()
    part = min(1.0, sample_rows / max(n, 1))
    sample = stash.keep(measured(docs.select("doc_id", "text").sample(part, seed)), "sample").filter(~F.col("base_failed"))
    cascade = F.when(F.col("base_failed"), F.lit(False))
    for rule, _, _ in ordered(sample, rules):
        cascade = cascade.when(F.coalesce(rule.fails, F.lit(False)), F.lit(False))
    out = measured(docs).withColumn("kept", cascade.otherwise(F.lit(True)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws, string_split(text, chr(10)) as ls from t),
g as (select *, list_transform(range(1, len(ws) - 1), lambda i: ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2]) as gs,
  list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as wl from w),
u as (select row_number() over () as r, * from g),
e as (select r, unnest(gs) as s, unnest(range(len(gs))) as i from u),
p as (select r, i from (select *, count(*) over (partition by r, s) as c from e) where c > 1),
d as (select distinct r, i + j as k from p, (values (0), (1), (2)) as o(j)),
n as (select r, count(*) as c from d group by r),
m as (select doc_id, text, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  (len(wl) - len(list_distinct(wl)))::bigint as n_dup_lines, coalesce(n.c, 0)::bigint as n_repeat_words, len(ls) as n_lines,
  len(list_filter(ls, lambda x: rtrim(x, ' ') like '%...' or rtrim(x, ' ') like '%…')) as ends,
  len(list_filter(ls, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]'))) as bullets,
  length(regexp_replace(text, '[^\p{L}]', '', 'g')) as letters
  from u left join n using (r)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or n_symbols * 10 > n_words or word_chars < n_words * 2 or word_chars > n_words * 15
    or n_dup_lines * 2 > n_lines or ends * 10 > n_lines * 3 or bullets * 10 > n_lines * 9 or letters * 2 < word_chars) as kept from b
"""
