"""Personal data: fixed patterns, then further spans by weak supervision.

Labelers (regular expressions on the span, gazetteers, words in the context) vote for, against or not at all on each
candidate span. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is, and
the posteriors train a final classifier: naive Bayes over the candidate's shape and its context. Only pattern counts
(their number is bounded by the labelers and shapes, not by the data) reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.llm.io import Stash
from hazardlens.llm.spans import clear_of, count_of, joined, matches, spans

KINDS = ("email", "ip", "card", "phone")
#: Fixed by the operator's contract. They are written so that no match backtracks over more than one run: a match can
#: begin only where its first run does, or where the last match ended, and the repeated parts are possessive.
EMAIL = "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "[0-9]++(?:[\\x20-][0-9]++)*+"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Candidates for further spans.
CANDIDATE = (
    "(?<![A-Za-z0-9])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])|\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
    "|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+|[0-9]{9,11}+(?![0-9])|@[A-Za-z0-9_]{3,30}+"
    "|(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Sr|Sra|Mme)\\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?)"
)
SHAPES = (
    ("national_id", "^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
    ("local_phone", "^\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}$"),
    ("account", "^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"),
    ("number", "^[0-9]{9,11}$"),
    ("handle", "^@"),
    ("name", "^[A-Z][a-z]+"),
)
#: Words before a span that speak for or against personal data; common given names.
FOR = "phone|tel|call|fax|mobile|contact|ssn|social|passport|account|iban|name|dear|patient|customer|telefon|konto|cuenta|compte|nombre|nom"
AGAINST = "page|isbn|version|line|no|nr|id|invoice|order|item|part|build|error|total|price"
NAMES = "James|Mary|John|Anna|Peter|Maria|Paul|Laura|Thomas|Julia|Pierre|Marie|Hans|Karl|Juan|Carlos|Ana|Luis|Sophie|Emma"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.transform(F.split(F.reverse(number), "(?<=.)(?=.)"), lambda d: d.cast("int"))

    def part(d: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(places, part), F.lit(0), lambda s, d: s + d) % 10 == 0


def base_spans(text: Column) -> Column:
    email = spans(matches(text, EMAIL, F.contains(text, F.lit("@"))), "email", 0, lambda m: F.lit(True))
    ip = spans(matches(text, IP, text.rlike("[0-9]\\.[0-9]++\\.[0-9]")), "ip", 1, lambda m: m.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$"))
    n = lambda m: F.length(digits(m))
    card = spans(matches(text, CARD, text.rlike("[0-9](?:[\\x20-]?[0-9]){11}")), "card", 2, lambda m: F.when(n(m).between(12, 19), luhn(digits(m))).otherwise(False))
    phone = spans(matches(text, PHONE, text.rlike("\\+[0-9]")), "phone", 3, lambda m: n(m).between(9, 15))
    return F.sort_array(F.concat(email, ip, card, phone))


def labelers(match: Column, before: Column) -> list[Column]:
    """Votes (1, -1 or 0) of each labeler on a candidate, from its text and the 32 characters before it."""
    near = F.lower(F.right(before, F.lit(32)))
    n = F.length(digits(match))
    vote = lambda plus, minus=F.lit(False): F.when(plus, 1).when(minus, -1).otherwise(0)
    return [
        vote(match.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), match.rlike("^(?:000|666)")),
        vote(match.rlike("^\\(?[2-9][0-9]{2}\\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}$"), match.rlike("^[01][0-9]{2}[ .-]")),
        vote(match.rlike("^[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{4}){3,}"), match.rlike("([0-9])\\1{5}")),
        vote(match.rlike(f" (?:{NAMES})\\b"), (n == 0) & match.rlike("^@(?:media|import|param|return|override)")),
        vote(near.rlike(f"(?:^|[^a-z])(?:{FOR})[^a-z]{{0,4}}$"), near.rlike(f"(?:^|[^a-z])(?:{AGAINST})[^a-z]{{0,4}}$")),
        vote(near.rlike("[:=][ \"']{0,2}$"), near.rlike("[$€£%#][ ]?$")),
    ]


def pattern(match: Column, before: Column) -> Column:
    """A candidate's shape and votes as one string: the features of the model."""
    shape = F.lit("other")
    for name, fits in reversed(SHAPES):
        shape = F.when(match.rlike(fits), F.lit(name)).otherwise(shape)
    return F.concat(shape, *[F.concat(F.lit("|"), v.cast("string")) for v in labelers(match, before)])


@dataclass(frozen=True)
class Model:
    """``rates[j][y][v]``: estimated probability that labeler j votes v - 1 on a span of class y; ``scores`` by pattern."""

    prior: float
    rates: list[list[list[float]]]
    scores: dict[str, float]


def fit(counts: dict[str, int], rounds: int = 60) -> Model:
    """EM from majority votes on, then naive Bayes over shape and votes trained on the posteriors. Exact and seedless."""
    votes = {p: [int(v) for v in p.split("|")[1:]] for p in counts}
    post = {p: (0.5 if not sum(v) else 0.9 if sum(v) > 0 else 0.1) for p, v in votes.items()}
    n = sum(counts.values())
    labels = len(next(iter(votes.values()), []))
    prior, rates = 0.5, []
    for _ in range(rounds if counts else 0):
        mass = [sum(c * (1 - post[p]) for p, c in counts.items()), sum(c * post[p] for p, c in counts.items())]
        prior = (mass[1] + 1) / (n + 2)
        rates = [
            [
                [(sum(c * (post[p] if y else 1 - post[p]) for p, c in counts.items() if votes[p][j] == v) + (2 if v == 2 * y - 1 else 1)) / (mass[y] + 4) for v in (-1, 0, 1)]
                for y in (0, 1)
            ]
            for j in range(labels)
        ]
        for p, v in votes.items():
            odds = math.log(prior / (1 - prior))
            odds += sum(math.log(rates[j][1][x + 1] / rates[j][0][x + 1]) for j, x in enumerate(v) if x)
            post[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    features = {p: list(enumerate(p.split("|"))) for p in counts}
    mass = [n - sum(c * post[p] for p, c in counts.items()), sum(c * post[p] for p, c in counts.items())]
    seen: dict = {}
    for p, c in counts.items():
        for f in features[p]:
            own = seen.setdefault(f, [1.0, 1.0])
            own[0] += c * (1 - post[p])
            own[1] += c * post[p]
    scores = {}
    for p in counts:
        odds = math.log((mass[1] + 1) / (mass[0] + 1))
        odds += sum(math.log(seen[f][1] / (mass[1] + 3)) - math.log(seen[f][0] / (mass[0] + 3)) for f in features[p])
        scores[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return Model(prior, rates, scores)


def find(docs: DataFrame, stash: Stash, accepted: float = 0.9) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    Null text counts as empty: no spans, and the digest of nothing. Repeated rows give repeated results; an empty
    table gives an empty one; other columns are not read. Beyond the base, a span of kind ``other`` is a candidate,
    clear of all base spans, for which some labeler votes and which the final classifier gives ``accepted`` or more. The
    model is fitted on the vote patterns of all candidates.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    free = clear_of(matches(F.col("text"), CANDIDATE, F.col("text").rlike(CANDIDATE)), F.col("base"))

    def voted(x: Column) -> Column:
        return F.struct(
            x["start"].alias("start"), F.lit(len(KINDS)).alias("place"), x["end"].alias("end"), F.lit("other").alias("kind"),
            pattern(x["match"], x["before"]).alias("pattern"),
        )

    rows = stash.keep(rows.select("doc_id", "base", F.transform(free, voted).alias("found")), "votes")
    counts = rows.select(F.explode("found.pattern").alias("p")).groupBy("p").count().collect()
    model = fit({r["p"]: r["count"] for r in sorted(counts)})
    good = [p for p, s in sorted(model.scores.items()) if s >= accepted and "|1" in p]
    added = F.filter("found", lambda x: x["pattern"].isin(good) if good else F.lit(False))
    added = F.transform(added, lambda x: F.struct(x["start"].alias("start"), x["place"].alias("place"), x["end"].alias("end"), x["kind"].alias("kind")))
    rows = rows.select("doc_id", "base", F.sort_array(F.concat("base", added)).alias("every"))
    return rows.select(
        "doc_id", *[count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("every")).alias("spans"),
    )
