"""Operator 5: quality rules combined by weak supervision (native).

Each rule votes good, bad or abstains on every document.  How often a rule votes each way on good and
on bad documents is estimated by expectation-maximisation over the counts of vote patterns (at most
``3 ** rules`` rows, whatever the data), and a document is kept by its posterior quality probability
instead of by passing all rules.  Texts never leave the JVM; one pass computes the measures, which are
written to the shared folder, and the votes are read from there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selvage.llm.common import WORD, words
from selvage.session import cut

GOOD, ABSTAIN, BAD = 1, 0, -1
VOTES = (GOOD, ABSTAIN, BAD)
SYMBOLS = "[#*$%&|<>]"
#: Frequent function words of the languages expected.
STOP_WORDS = (
    "the of and to in is that it for on with as be at by "
    "de la le les et des un une du que est en "
    "der die das und ist ein zu den mit von "
    "el los las y se del por con"
).split()


def _window_key(a: Column, b: Column, c: Column) -> Column:
    return F.xxhash64(a, b, c)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and, as long, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop, n_upper.

    n_repeat_words counts words in 3-word windows found twice or more in the text, first included.
    Window keys hold a part of a 64-bit hash above the window's position; sorted, repeats are
    neighbours, which are compared word by word.  Texts in which unequal windows of one key stand
    side by side are sorted by the words of their windows instead, so the count is exact at any
    length.  Null text has no words, lines or symbols.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    n = F.size("w")
    # positions take 21 bits of the key, or 31 in texts beyond two million words
    rows = rows.withColumn("w", words(F.col("t"))).withColumn("b", F.when(n <= 1 << 21, 21).otherwise(31))
    window = lambda i: _window_key(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    up, down = (lambda f: lambda c: F.call_function(f, c, F.col("b")))("shiftleft"), (lambda f: lambda c: F.call_function(f, c, F.col("b")))("shiftright")
    key = F.transform(F.sequence(F.lit(0), n - 3), lambda i: up(window(i)).bitwiseOR(i.cast("long")))
    rows = rows.withColumn("k", F.when(n >= 4, F.sort_array(key)).otherwise(F.array().cast("array<bigint>")))
    at = lambda k: k.bitwiseAND(up(F.lit(1).cast("long")) - 1).cast("int")

    def words_equal(k: Column, other: Column) -> Column:
        return (F.get("w", at(k)) == F.get("w", at(other))) & (F.get("w", at(k) + 1) == F.get("w", at(other) + 1)) & (F.get("w", at(k) + 2) == F.get("w", at(other) + 2))

    def twin(k: Column, other: Column) -> Column:
        return F.coalesce((down(k) == down(other)) & words_equal(k, other), F.lit(False))

    def beside(windows: str, same: Callable[[Column, Column], Column]) -> Column:
        return F.filter(windows, lambda x, i: same(x, F.get(windows, i + 1)) | same(x, F.get(windows, i - 1)))

    foreign = lambda k, i: F.coalesce((down(k) == down(F.get("k", i + 1))) & ~words_equal(k, F.get("k", i + 1)), F.lit(False))
    mixed = F.size(F.filter("k", foreign)) > 0
    spelled = F.transform("k", lambda k: F.struct(F.get("w", at(k)).alias("a"), F.get("w", at(k) + 1).alias("b"), F.get("w", at(k) + 2).alias("c"), at(k).alias("at")))
    rows = rows.withColumn("s", F.when(mixed, F.sort_array(spelled)))
    equal = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    places = F.when(F.col("s").isNull(), F.transform(beside("k", twin), at)).otherwise(F.transform(beside("s", equal), lambda x: x["at"]))
    rows = rows.withColumn("r", F.sort_array(places)).withColumn("l", F.filter(F.split("t", "\n"), lambda s: F.rlike(s, F.lit(WORD))))
    step = lambda i: F.least(F.coalesce(F.get("r", i) - F.get("r", i - 1), F.lit(3)), F.lit(3))
    covered = F.aggregate(F.sequence(F.lit(1), F.size("r")), F.lit(0), lambda acc, i: acc + step(i))
    count = lambda pattern: F.regexp_count("t", F.lit(pattern))
    long = {
        "n_words": n, "word_chars": F.length(F.array_join("w", "")), "n_symbols": count(SYMBOLS),
        "n_dup_lines": F.size("l") - F.size(F.array_distinct("l")), "n_repeat_words": F.when(F.size("r") > 0, covered).otherwise(0),
        "n_lines": F.size("l"), "n_stop": F.size(F.array_intersect("w", F.array(*map(F.lit, STOP_WORDS)))), "n_upper": count("[A-Z]"),
    }
    return rows.select("doc_id", *(c.cast("long").alias(k) for k, c in long.items()))


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN).cast("byte")


def rules() -> dict[str, Column]:
    """Votes by rule over the columns of :func:`measures`; wordless documents abstain on shares."""
    some = F.col("n_words") > 0
    mean = _share("word_chars", "n_words")
    return {
        "length": _vote(F.col("n_words") < 20, F.col("n_words") >= 50),
        "word_length": _vote(some & ((mean < 3) | (mean > 12)), some & (mean >= 3.5) & (mean <= 9)),
        "symbols": _vote(some & (_share("n_symbols", "n_words") > 0.1), some & (_share("n_symbols", "n_words") < 0.02)),
        "lines": _vote(_share("n_dup_lines", "n_lines") > 0.3, some & (_share("n_dup_lines", "n_lines") < 0.1)),
        "repeats": _vote(_share("n_repeat_words", "n_words") > 0.3, some & (_share("n_repeat_words", "n_words") < 0.1)),
        "stop_words": _vote((F.col("n_words") >= 50) & (F.col("n_stop") < 1), F.col("n_stop") >= 2),
        "capitals": _vote(some & (_share("n_upper", "word_chars") > 0.4), some & (_share("n_upper", "word_chars") < 0.15)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: Prior beliefs of a rule, as counts: P(good, abstain, bad vote) on good and on bad documents.
PRIOR = ((0.85, 0.13, 0.02), (0.3, 0.3, 0.4))
PRIOR_WEIGHT = 20.0
#: Rules are better than chance: bad votes on good documents at most, and on bad documents at least.
FALSE_ALARM, DETECTION = 0.01, 0.2


def _bounded(p: dict[int, float], c: int) -> dict[int, float]:
    """Keeps a rule on its side: else EM may take a rule's bad votes for a habit of good documents."""
    bad = min(p[BAD], FALSE_ALARM) if c == 0 else max(p[BAD], DETECTION)
    rest = (1 - bad) / (1 - p[BAD])
    return {v: bad if v == BAD else p[v] * rest for v in VOTES}


def estimate(patterns: Mapping[tuple[int, ...], int], n_rules: int = 0, steps: int = 60) -> tuple[float, list[tuple[dict[int, float], dict[int, float]]]]:
    """EM over counted vote patterns: P(good), and for each rule the vote probabilities on good and on bad documents.

    Starts from and is regularised by ``PRIOR``, which also says which class is the good one; an
    empty table gives the prior.  Deterministic.
    """
    m = max(n_rules, len(next(iter(patterns), ())))
    good = 0.9
    probs = [tuple({v: PRIOR[c][i] for i, v in enumerate(VOTES)} for c in (0, 1)) for _ in range(m)]
    items = sorted(patterns.items())
    for _ in range(steps if items else 0):
        sums = [[{v: PRIOR[c][i] * PRIOR_WEIGHT for i, v in enumerate(VOTES)} for c in (0, 1)] for _ in range(m)]
        mass = [9.0, 1.0]
        for votes, n in items:
            q = posterior(votes, good, probs)
            for c, share in ((0, q * n), (1, (1 - q) * n)):
                mass[c] += share
                for j, v in enumerate(votes):
                    sums[j][c][v] += share
        good = mass[0] / sum(mass)
        probs = [tuple(_bounded({v: s[c][v] / sum(s[c].values()) for v in VOTES}, c) for c in (0, 1)) for s in sums]
    return good, probs  # type: ignore[return-value]


def posterior(votes: Sequence[int], good: float, probs: Sequence[tuple[dict[int, float], dict[int, float]]]) -> float:
    """P(good | votes) under independent rules."""
    z = math.log(good / (1 - good)) + sum(math.log(p[0][v] / p[1][v]) for v, p in zip(votes, probs, strict=True))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, measures, base_failed, p_good, kept) for each row.

    Null, empty and wordless texts fail the base rule.  Repeated rows are judged row by row and count
    that often in the estimate.  Other columns are ignored; an empty table gives no rows.
    """
    found = cut(measures(docs, id_col, text_col), "measures")
    names = list(rules())
    voted = found.select("*", *(c.alias(f"v_{k}") for k, c in rules().items()))
    columns = [f"v_{k}" for k in names]
    counted = voted.groupBy(*columns).count().collect()  # 3 ** rules rows at most
    patterns = {tuple(r[c] for c in columns): r["count"] for r in counted}
    good, probs = estimate(patterns, len(names))
    odds: Column = F.lit(math.log(good / (1 - good)))
    for c, p in zip(columns, probs, strict=True):
        weight = [math.log(p[0][v] / p[1][v]) for v in VOTES]
        odds = odds + F.when(F.col(c) == GOOD, weight[0]).when(F.col(c) == BAD, weight[2]).otherwise(weight[1])
    sure = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), odds))))
    out = voted.withColumn("p_good", sure).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least)).drop(*columns)
