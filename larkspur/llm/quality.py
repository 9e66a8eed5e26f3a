"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at one statistic of a text and votes good (1), bad (-1) or abstains (0). Votes are
noisy: expectation-maximisation over the counts of vote patterns estimates the share of good
documents and each rule's two accuracies, how often it votes good on good documents and how often
bad on bad ones, when it votes at all. A rule is never taken to be worse than chance: if the
estimate says that it votes good more often on bad documents, it gets one rate for both, and then
says nothing. A document is kept if the posterior probability of good, given its votes, is at least
``keep_at``. Two base rules are final: fewer than MIN_WORDS words, or more than half of the words in
repeated three-word windows; the model is fitted to the other documents.

Only the table of vote patterns reaches the driver: at most 3 to the power of the number of rules,
whatever the corpus, and every document is counted in it. The statistics of a text are computed in
one pass over it; windows are compared by 64-bit hashes, which collide once in about 10^11 texts of
20,000 words.

Nulls and odd input: a null or empty text has no words, so it fails; an id may be null or repeated;
ties don't arise, as each row is judged alone; a corpus without documents gives an empty result;
a column of the input named like one of the statistics stays as it is, since the operator keeps
its own in one struct, ``__quality``, that it drops in the end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACE = " \t\n\x0b\f\r"
MIN_WORDS = 50
KEEP_AT = 0.5
ROUNDS = 30
OWN = "__quality"


def text_stats(text: Column) -> Column:
    """Struct of the statistics of a text."""
    text = F.coalesce(text, F.lit(""))

    def of(t: Column) -> Column:
        words = F.when(F.btrim(t, F.lit(SPACE)) == "", F.array().cast("array<string>")).otherwise(F.split(F.btrim(t, F.lit(SPACE)), f"[{SPACE}]+"))
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))

        def from_parts(p: Column) -> Column:
            w, n = p["words"], F.size(p["words"])
            joined = F.array_join(w, "")
            return F.struct(
                n.cast("long").alias("n_words"),
                F.length(joined).cast("long").alias("word_chars"),
                F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                F.size(p["lines"]).cast("long").alias("n_lines"),
                (F.size(p["lines"]) - F.size(F.array_distinct(p["lines"]))).cast("long").alias("n_dup_lines"),
                _repeat_words(w, n).cast("long").alias("n_repeat_words"),
                F.length(F.regexp_replace(joined, r"\p{L}+", "")).cast("long").alias("n_other"),
                F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
                F.regexp_count(t, F.lit("[!?]")).cast("long").alias("n_shouts"),
                F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            )

        return F.transform(F.array(F.struct(words.alias("words"), lines.alias("lines"))), from_parts)[0]

    return F.transform(F.array(text), of)[0]


def _repeat_words(words: Column, n: Column) -> Column:
    """Words that stand in a three-word window found at least twice."""
    windows = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), F.greatest(n - 2, F.lit(0)))

    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
        found = F.transform(F.array(by_hash), lambda s: F.filter(s, lambda e, k: same(s, e, k - 1) | same(s, e, k + 1)))[0]
        at = F.sort_array(F.transform(found, lambda e: e["i"]))
        gaps = F.transform(F.array(at), lambda a: F.transform(a, lambda x, k: F.least(F.coalesce(F.get(a, k + 1) - x, F.lit(3)), F.lit(3))))[0]
        count = F.aggregate(gaps, F.lit(0), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(count)

    return F.transform(F.array(windows), covered)[0]


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def votes(s: Column) -> dict[str, Column]:
    """The vote of each rule: 1 good, -1 bad, 0 abstains."""
    words = F.nullif(s["n_words"], F.lit(0))

    def low(value: Column, good: float, bad: float) -> Column:
        """Good up to one bound, bad from another."""
        return _vote(value, value <= good, value >= bad)

    length = s["word_chars"] / words
    return {
        "symbols": low(s["n_symbols"] / words, 0.02, 0.1),
        "letters": low(s["n_other"] / F.nullif(s["word_chars"], F.lit(0)), 0.1, 0.15),
        "repeats": low(s["n_repeat_words"] / words, 0.1, 0.3),
        "duplicate_lines": low(s["n_dup_lines"] / F.nullif(s["n_lines"], F.lit(0)), 0.05, 0.3),
        "upper_case": low(s["n_upper"] / F.nullif(s["word_chars"], F.lit(0)), 0.1, 0.3),
        "shouts": low(s["n_shouts"] / words, 0.05, 0.2),
        "word_length": _vote(length, length.between(3.5, 8), (length < 2.5) | (length > 12)),
        "variety": _vote(s["n_distinct"] / words, s["n_distinct"] / words >= 0.35, s["n_distinct"] / words <= 0.1),
        "length": _vote(s["n_words"], s["n_words"] >= 100, s["n_words"] < MIN_WORDS),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[float], list[float]]:
    """Prior log odds of good and, for each rule, what a good and what a bad vote add to them.

    patterns: votes and the number of documents with them. An abstention adds nothing. The start says
    only that a rule is right more often than wrong; add-one smoothing keeps every rate inside 0 and 1.
    """
    k = len(patterns[0][0]) if patterns else 0
    on_good, on_bad, share = [0.9] * k, [0.5] * k, 0.8  # rates of a good vote on good and on bad documents
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        weights = []
        for votes_, n in patterns:
            odds = math.log(share / (1 - share))
            for v, g, b in zip(votes_, on_good, on_bad):
                odds += math.log(g / b) if v == 1 else math.log((1 - g) / (1 - b)) if v == -1 else 0.0
            weights.append((n / (1 + math.exp(min(700.0, -odds))), n))
        share = (sum(w for w, _ in weights) + 1) / (total + 2)
        for r in range(k):
            voted = [(v[r] == 1, w, n - w) for (v, _), (w, n) in zip(patterns, weights) if v[r]]
            good, bad = sum(w for _, w, _ in voted), sum(x for _, _, x in voted)
            good_up, bad_up = sum(w for up, w, _ in voted if up), sum(x for up, _, x in voted if up)
            on_good[r], on_bad[r] = (good_up + 1) / (good + 2), (bad_up + 1) / (bad + 2)
            if on_good[r] < on_bad[r]:
                on_good[r] = on_bad[r] = (good_up + bad_up + 1) / (good + bad + 2)
    up = [math.log(g / b) for g, b in zip(on_good, on_bad)]
    down = [math.log((1 - g) / (1 - b)) for g, b in zip(on_good, on_bad)]
    return math.log(share / (1 - share)), up, down


def _verdicts(known: DataFrame) -> tuple[Column, Column]:
    """Base failure and posterior of good, as columns of known, whose statistics are written down."""
    s = known[OWN]
    rules = votes(s)
    names = list(rules)
    open_ = known.where(~base_failed(s))  # what the base rules decide isn't for the model
    counted = open_.select(*(v.cast("int").alias(k) for k, v in rules.items())).groupBy(*names).count().collect()
    prior, up, down = fit(sorted((tuple(row[k] for k in names), row["count"]) for row in counted))
    odds = F.lit(prior)
    for u, d, vote in zip(up, down, rules.values()):
        odds = odds + F.when(vote == 1, u).when(vote == -1, d).otherwise(0.0)
    return base_failed(s), 1 / (1 + F.exp(-odds))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """(id, the statistics, base_failed, kept, p_good) for every row of docs."""
    known = materialize(docs.select(docs[id_col].alias(id_col), text_stats(docs[text_col].cast("string")).alias(OWN)), "quality")
    failed, p = _verdicts(known)
    stats = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return known.select(
        id_col, *(F.col(f"{OWN}.{c}").alias(c) for c in stats),
        failed.alias("base_failed"), (~failed & (p >= keep_at)).alias("kept"), F.round(p, 6).alias("p_good"),
    )


def quality_filter(docs: DataFrame, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs that are kept, with docs' columns.

    Rows and their statistics are written once, for the fit and the filter: computing the statistics
    again would cost many times what writing does.
    """
    known = materialize(docs.withColumn(OWN, text_stats(docs[text_col].cast("string"))), "quality")
    failed, p = _verdicts(known)
    return known.where(~failed & (p >= keep_at)).select(*docs.columns)
