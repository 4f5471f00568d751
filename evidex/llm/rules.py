"""Quality rules with weak supervision, in DataFrame functions only.

Each rule looks at one statistic of a document and votes strongly bad, bad, good, or
abstains.  A latent-class model says how votes come about: documents are good or of one
of several kinds of junk, one kind for each rule, which is the rule's to detect; in each
class every rule votes by its own odds, and abstaining says nothing.  Expectation-maximisation over the counts of vote
patterns (a fixed number of them at most, whatever the corpus) estimates the classes'
shares and the odds, which are the rules' accuracies.  A document is kept if its
posterior probability of being good is one half or more: the vote of a rule that good
documents trip too does not reject it, several such votes do.  Two hard base rules
reject on top of that.

Pseudo-counts (``GOOD``, ``OWN``, ``OTHER``, ``SHARE_GOOD``) start the model and decide where
the counts can't: whether documents on which one rule alone votes are a kind of junk or
that rule's errors.  A strong vote then counts as junk, a plain one as an error.

Cases: a null text counts as empty (no words, rejected by the base rules);
repeated rows are judged alike and each kept or dropped; an empty table gives
an empty result; very long texts cost a sort of their own word windows and no
shuffle; other input columns are never read, and the columns added take names
that none of them begins with.
"""

from __future__ import annotations

import json
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import SPACES, checkpointed, free_prefix, stored, table

SYMBOLS = "#*$%&|<>"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PREFIX = "_q_"
#: Rule: statistics (ratios, of which the greatest counts), at or above which it votes strongly bad,
#: bad, below which it votes good.  Between the last two it abstains, as all rules do on documents too
#: short to tell.  Repeated lines and repeated words are one rule: each brings about the other.
RULES = (
    ("symbols", (("n_symbols", "n_words"),), 0.20, 0.10, 0.03),
    ("shouting", (("n_upper", "word_chars"),), 0.50, 0.30, 0.12),
    ("exclaims", (("n_exclaims", "n_words"),), 0.30, 0.15, 0.05),
    ("repeats", (("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words")), 0.60, 0.30, 0.10),
    ("digits", (("n_digits", "word_chars"),), 0.40, 0.20, 0.05),
    ("marks", (("n_marks", "word_chars"),), 0.50, 0.25, 0.12),
)
#: Mean word length in code points: outside the first pair strongly bad, the second bad, inside the third good.
WORD_LENGTH = ((2.0, 20.0), (2.5, 14.0), (3.0, 10.0))
VOTES = (-2, -1, 0, 1)
CAST = (-2, -1, 1)
MIN_WORDS = 50


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def with_statistics(docs: DataFrame, text_col: str = "text", prefix: str = PREFIX) -> DataFrame:
    """``docs`` and the statistics of its texts, in columns that begin with ``prefix``.

    The arrays are built in steps, each kept as a column, so that no step is
    evaluated again for each element of the next.
    """
    p, text = prefix, F.col(f"{prefix}text")
    words, windows, order, starts, lines = (F.col(p + n) for n in ("words", "windows", "order", "starts", "lines"))
    stepped = (
        docs.withColumn(f"{p}text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
        .withColumn(f"{p}words", F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
        .withColumn(f"{p}n_words", F.size(words).cast("bigint"))
        .withColumn(
            f"{p}windows",
            F.when(
                F.size(words) >= 3,
                F.slice(F.transform(words, lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1), F.lit(" "), F.get(words, i + 2))), F.lit(1), F.size(words) - 2),
            ),
        )
        # only windows that repeat need a sort to find them
        .withColumn(
            f"{p}order",
            F.when(
                F.size(F.array_distinct(windows)) < F.size(windows),
                F.sort_array(F.transform(windows, lambda t, i: F.struct(t.alias("t"), i.alias("i")))),
            ),
        )
        .withColumn(
            f"{p}starts",
            F.sort_array(
                F.transform(
                    F.filter(
                        F.transform(
                            order,
                            lambda x, k: F.struct(
                                x["i"].alias("i"),
                                (x["t"].eqNullSafe(F.get(order, k - 1)["t"]) | x["t"].eqNullSafe(F.get(order, k + 1)["t"])).alias("again"),
                            ),
                        ),
                        lambda y: y["again"],
                    ),
                    lambda y: y["i"],
                )
            ),
        )
        .withColumn(f"{p}lines", F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    )
    # a window covers three words; the next repeated window may cover some of them too
    covered = F.aggregate(F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    n = F.length(text)
    return stepped.select(
        *docs.columns,
        F.col(f"{p}n_words"),
        _without(text, SPACES).cast("bigint").alias(f"{p}word_chars"),
        (n - _without(text, SYMBOLS)).cast("bigint").alias(f"{p}n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias(f"{p}n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias(f"{p}n_repeat_words"),
        F.size(lines).cast("bigint").alias(f"{p}n_lines"),
        (n - _without(text, _UPPER)).cast("bigint").alias(f"{p}n_upper"),
        (n - _without(text, "!")).cast("bigint").alias(f"{p}n_exclaims"),
        (n - _without(text, "0123456789")).cast("bigint").alias(f"{p}n_digits"),
        (n - _without(text, MARKS)).cast("bigint").alias(f"{p}n_marks"),
    )


def votes(prefix: str = PREFIX) -> list[Column]:
    """-2 strongly bad, -1 bad, 0 abstains, 1 good."""
    stat = lambda n: F.col(prefix + n)
    long_enough = stat("n_words") >= 20
    out = []
    for _, ratios, strong, bad, good in RULES:
        ratio = F.greatest(F.lit(0.0), *(stat(above) / F.greatest(stat(below), F.lit(1)) for above, below in ratios))
        out.append(F.when(~long_enough, 0).when(ratio >= strong, -2).when(ratio >= bad, -1).when(ratio < good, 1).otherwise(0))
    mean = stat("word_chars") / F.greatest(stat("n_words"), F.lit(1))
    outside = lambda limits: (mean < limits[0]) | (mean > limits[1])
    strong, bad, good = map(outside, WORD_LENGTH)
    out.append(F.when(~long_enough, 0).when(strong, -2).when(bad, -1).when(~good, 1).otherwise(0))
    return out


#: Votes expected before any are counted, strongly bad, bad and good: of each rule on good documents,
#: of a kind's own rule on its junk, of other rules on it.
GOOD = (0.0005, 0.0095, 0.99)
OWN = (0.88, 0.10, 0.02)
OTHER = (0.03, 0.07, 0.90)
SHARE_GOOD = 0.8
#: Weight of those expectations, as a share of the documents; each class has its share of it.
STRENGTH = 0.002


def start(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the classes (good first) and odds[class, rule, vote] before any count."""
    shares = np.array([SHARE_GOOD] + [(1 - SHARE_GOOD) / m] * m)
    odds = np.empty((m + 1, m, len(CAST)))
    odds[0], odds[1:] = GOOD, OTHER
    odds[np.arange(1, m + 1), np.arange(m)] = OWN
    return shares, odds


def beliefs(shares: np.ndarray, odds: np.ndarray, cast: np.ndarray) -> np.ndarray:
    """Probability of each class for vote patterns, one column per rule."""
    logs = np.log(shares) + np.zeros((len(cast), 1))
    for k in range(cast.shape[1]):
        for x, vote in enumerate(CAST):
            logs[cast[:, k] == vote] += np.log(odds[:, k, x])
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Shares and odds by expectation-maximisation; ``patterns`` are votes and how many documents cast them."""
    m = len(patterns[0][0]) if patterns else len(RULES) + 1
    first_shares, first_odds = shares, odds = start(m)
    if not patterns:
        return shares, odds
    cast = np.array([v for v, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    strength = max(1.0, STRENGTH * n.sum())
    before = None
    for _ in range(rounds):
        belief = beliefs(shares, odds, cast)
        if before is not None and np.abs(belief - before).max() < 1e-9:
            break
        before, weight = belief, belief * n[:, None]
        shares = (weight.sum(axis=0) + strength * first_shares) / (n.sum() + strength)
        counts = np.stack([[weight[cast[:, k] == x].sum(axis=0) for x in CAST] for k in range(m)])  # rule, vote, class
        odds = counts.transpose(2, 0, 1) + (strength * first_shares)[:, None, None] * first_odds
        odds /= odds.sum(axis=2, keepdims=True)
        for j in range(m):  # a kind of junk is what its rule detects: in at least half of it
            own = odds[j + 1, j]
            if own[:2].sum() < 0.5:
                odds[j + 1, j] = np.concatenate((own[:2] / own[:2].sum(), own[2:] / own[2:].sum())) / 2
    return shares, odds


def code(cast: list[Column]) -> Column:
    """One number for a pattern of votes."""
    total = F.lit(0)
    for k, v in enumerate(cast):
        total = total + (v - VOTES[0]) * len(VOTES) ** k
    return total


def pattern_of(number: int) -> tuple[int, ...]:
    return tuple(number // len(VOTES) ** k % len(VOTES) + VOTES[0] for k in range(len(RULES) + 1))


def posterior(shares: np.ndarray, odds: np.ndarray, number: Column) -> Column:
    """Probability of being good by :func:`code`, from a literal table of all patterns."""
    m = odds.shape[1]
    cast = np.array([p[::-1] for p in product(VOTES, repeat=m)])
    return F.get(F.from_json(F.lit(json.dumps(beliefs(shares, odds, cast)[:, 0].tolist())), "array<double>"), number)


def pattern_counts(numbered: DataFrame, column: str) -> list[tuple[tuple[int, ...], int]]:
    """Rows per vote pattern: 4 ** rules rows at most reach the driver."""
    return sorted((pattern_of(r[0]), r[1]) for r in numbered.groupBy(column).count().collect())


def base_failed(prefix: str = PREFIX) -> Column:
    n, again = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < MIN_WORDS) | (100 * again > 50 * n)


def judge(stats: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """Rows of :func:`with_statistics`, already stored, with the base verdict, ``posterior`` and ``kept``.

    Votes of the rows that pass the base rules are counted in a first pass, all rows judged in a second.
    """
    numbered = stats.withColumn(f"{prefix}code", code(votes(prefix))).withColumn(f"{prefix}base_failed", base_failed(prefix))
    shares, odds = fit_votes(pattern_counts(numbered.where(~F.col(f"{prefix}base_failed")), f"{prefix}code"))
    return (
        numbered.withColumn(f"{prefix}posterior", posterior(shares, odds, F.col(f"{prefix}code")))
        .withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & (F.col(f"{prefix}posterior") >= 0.5))
    )


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``.

    Rows are stored with their statistics once, so that neither pass computes them again.
    """
    prefix = free_prefix(docs, PREFIX)
    judged = judge(stored(with_statistics(docs, text_col, prefix)), prefix)
    return judged.where(F.col(f"{prefix}kept")).select(*docs.columns)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    judged = judge(checkpointed(with_statistics(docs).drop("text")))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *(F.col(PREFIX + n).alias(n) for n in names), F.round(F.col(f"{PREFIX}posterior"), 6).alias("posterior"))
