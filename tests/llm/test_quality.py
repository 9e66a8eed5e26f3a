from __future__ import annotations

import math
import random
import re
import unicodedata

from larkspur.llm.quality import fit, quality_filter, quality_verdicts, votes

from .helpers import documents, odd_documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text: str | None) -> dict[str, object]:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count: dict = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(covered),
        "base_failed": n < 50 or 100 * len(covered) > 50 * n,
    }


def texts() -> list[str | None]:
    rng = random.Random(2)
    out: list[str | None] = [None, "", " \n\t ", "a b c a b c a b c", "a a a a a", "x\ny\nx\n\n x\nx", "é日本🙂 <b> #1\x0b\x0c", "\x1cone\x1d two\x85 three\xa0four"]
    out += [" ".join(prose(i, rng.randrange(1, 300))) for i in range(60)]
    out += ["\n".join(prose(i, 30) + ["same line here"] * rng.randrange(20)) for i in range(20)]
    return out + [" ".join(rng.choice(("$$$", "!!!", "WORD", "word")) for _ in range(120)) for _ in range(20)]


def test_statistics_equal_plain_loops(spark):
    rows = quality_verdicts(documents(spark, texts())).collect()
    for r in rows:
        want = brute(texts()[r.doc_id])
        assert {k: r[k] for k in want} == want, texts()[r.doc_id]
        assert not (r.base_failed and r.kept)


def test_driver_table_statistics(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    known = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_verdicts(docs).collect():
        want = brute(known[r.doc_id])
        assert {k: r[k] for k in want} == want


def test_kept_agrees_with_labels(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = quality_verdicts(docs).join(spark.read.parquet(f"{small_dir}/labels.parquet"), "doc_id").collect()
    good = [r for r in rows if r.quality == 1]
    assert sum(r.kept for r in good) / len(good) > 0.9


def plain_fit(patterns, rounds):
    """Expectation-maximisation on single documents, not on counts of patterns, in probabilities."""
    docs = [v for v, n in patterns for _ in range(n)]
    k, n = len(docs[0]), len(docs)
    g, b, share = [0.9] * k, [0.5] * k, 0.8
    rate = lambda p, v: p if v == 1 else 1 - p if v == -1 else 1.0
    for _ in range(rounds):
        w = []
        for v in docs:
            a = share * math.prod(rate(g[r], x) for r, x in enumerate(v))
            z = (1 - share) * math.prod(rate(b[r], x) for r, x in enumerate(v))
            w.append(a / (a + z))
        share = (sum(w) + 1) / (n + 2)
        for r in range(k):
            voted = [(v[r], p) for v, p in zip(docs, w) if v[r]]
            g[r] = (1 + sum(p for x, p in voted if x == 1)) / (2 + sum(p for _, p in voted))
            b[r] = (1 + sum(1 - p for x, p in voted if x == 1)) / (2 + sum(1 - p for _, p in voted))
            if g[r] < b[r]:
                g[r] = b[r] = (1 + sum(x == 1 for x, _ in voted)) / (2 + len(voted))
    return share, g, b


def plain_votes(text: str | None) -> tuple[int, ...]:
    """The votes of the rules in their order, by plain loops."""
    text = text or ""
    words = WORD.findall(text)
    stats, chars = brute(text), "".join(words)
    lines = [x for x in text.split("\n") if WORD.search(x)]

    def low(part, whole, good, bad):
        return 0 if not whole else -1 if part / whole >= bad else 1 if part / whole <= good else 0

    n = len(words)
    length = len(chars) / n if n else None
    variety = len(set(words)) / n if n else None
    letters = sum(unicodedata.category(c)[0] == "L" for c in chars)
    return (
        low(stats["n_symbols"], n, 0.02, 0.1), low(len(chars) - letters, len(chars), 0.1, 0.15), low(stats["n_repeat_words"], n, 0.1, 0.3), low(stats["n_dup_lines"], len(lines), 0.05, 0.3),
        low(sum(unicodedata.category(c) == "Lu" for c in text), len(chars), 0.1, 0.3), low(text.count("!") + text.count("?"), n, 0.05, 0.2),
        0 if length is None else -1 if length < 2.5 or length > 12 else 1 if 3.5 <= length <= 8 else 0, 0 if variety is None else -1 if variety <= 0.1 else 1 if variety >= 0.35 else 0,
        1 if n >= 100 else -1 if n < 50 else 0,
    )


def plain_kept(texts: dict) -> set:
    """The ids of the texts that the base rules and the posterior keep."""
    open_ = {i: plain_votes(t) for i, t in texts.items() if not brute(t)["base_failed"]}
    if not open_:
        return set()
    share, good, bad = plain_fit([(v, 1) for v in open_.values()], 30)
    kept = set()
    for i, v in open_.items():
        a, z = share, 1 - share
        for x, g, b in zip(v, good, bad):
            a, z = (a * g, z * b) if x == 1 else (a * (1 - g), z * (1 - b)) if x == -1 else (a, z)
        if a >= z:
            kept.add(i)
    return kept


def test_votes_and_verdicts_equal_plain_ones(spark, small_dir):
    from pyspark.sql import functions as F

    from larkspur.llm.quality import text_stats

    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").union(documents(spark, texts(), 10_000).select("doc_id", "text"))
    known = {r.doc_id: r.text for r in docs.collect()}
    voted = docs.select("doc_id", text_stats(docs["text"]).alias("s")).select("doc_id", *(v.cast("int").alias(k) for k, v in votes(F.col("s")).items()))
    assert {r.doc_id: tuple(r[1:]) for r in voted.collect()} == {i: plain_votes(t) for i, t in known.items()}
    assert {r.doc_id for r in quality_verdicts(docs).where("kept").collect()} == plain_kept(known)


def test_expectation_maximisation_equals_a_plain_one():
    rng = random.Random(4)
    patterns = [(tuple(rng.choice((1, 0, -1)) for _ in range(4)), rng.randrange(1, 9)) for _ in range(30)]
    prior, up, down = fit(patterns, 7)
    share, g, b = plain_fit(patterns, 7)
    assert math.isclose(prior, math.log(share / (1 - share)), abs_tol=1e-9)
    for r in range(4):
        assert g[r] >= b[r] and math.isclose(up[r], math.log(g[r] / b[r]), abs_tol=1e-9) and math.isclose(down[r], math.log((1 - g[r]) / (1 - b[r])), abs_tol=1e-9)
    assert fit([])[1:] == ([], [])


def test_posterior_is_that_of_the_votes(spark):
    from pyspark.sql import functions as F

    from larkspur.llm.quality import text_stats

    docs = documents(spark, texts())
    known = docs.select("doc_id", text_stats(docs["text"]).alias("s"))
    voted = {r.doc_id: tuple(r[1:]) for r in known.select("doc_id", *(v.cast("int").alias(k) for k, v in votes(F.col("s")).items())).collect()}
    verdicts = quality_verdicts(docs).collect()
    open_ = [voted[r.doc_id] for r in verdicts if not r.base_failed]
    share, good, bad = plain_fit([(v, 1) for v in open_], 30)
    seen = set()
    for r in verdicts:
        a, z = share, 1 - share
        for x, g, b in zip(voted[r.doc_id], good, bad):
            a, z = (a * g, z * b) if x == 1 else (a * (1 - g), z * (1 - b)) if x == -1 else (a, z)
        want = a / (a + z)
        assert abs(r.p_good - want) < 1e-5 and r.kept == (not r.base_failed and want >= 0.5)
        seen.add((min(voted[r.doc_id]) < 0, r.kept))
    assert {(True, False), (False, True)} <= seen


def test_posterior_agrees_with_labels_on_both_sides(spark, small_dir):
    """Documents labelled bad that pass the base rules are rejected by the posterior; good ones stay."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = quality_verdicts(docs).join(spark.read.parquet(f"{small_dir}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert all(r.kept == (r.quality == 1) for r in rows) and {r.quality for r in rows} == {0, 1}


def test_odd_rows(spark):
    rows = quality_verdicts(odd_documents(spark)).collect()
    assert len(rows) == 8 and sum(r.base_failed for r in rows) == 7
    assert quality_verdicts(odd_documents(spark).limit(0)).count() == 0
    kept = quality_filter(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns and {r.doc_id for r in kept.collect()} <= {4}
    plan = quality_verdicts(documents(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
