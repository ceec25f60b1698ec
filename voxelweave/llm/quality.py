"""Quality rules as weak supervision, with DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). The votes of all documents are counted by pattern (at most
3 ** rules patterns, whatever the number of documents), expectation-maximisation over these counts estimates how often
each rule votes or abstains on good and on bad documents, and the posterior probability of good decides. What is bad in
one way is seen by more than one rule (symbols: their share, the words and the runs that have them), so that the data
say how right a rule is; only a prior of a fixed number of documents stands beside them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, plain_reads, text_of

SPACES = " \\t\\n\\x0B\\f\\r"
WINDOW = 5
#: Rule, expression, and its votes: bad if the value is over the first bound, good if at most the second (None: never).
RULES = {
    "symbols": ("n_symbols / greatest(n_words, 1)", 0.10, None),
    "marked_words": ("n_marked / greatest(n_words, 1)", 0.10, None),
    "symbol_runs": ("n_runs / greatest(n_words, 1)", 0.05, None),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", 0.20, None),
    "duplicate_lines": ("n_dup_lines / greatest(n_lines, 1)", 0.30, None),
    "capitals": ("n_capitals / greatest(word_chars, 1)", 0.30, None),
    "marks": ("n_marks / greatest(n_words, 1)", 0.20, None),
    "digits": ("n_digits / greatest(word_chars, 1)", 0.25, None),
    "length": ("CASE WHEN n_words < 10 THEN 2 WHEN n_words < 50 THEN 1 ELSE 0 END", 1, 0),
    "word_length": ("abs(word_chars / greatest(n_words, 1) - 6.0)", 5.0, 2.5),
}
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_capitals", "n_marks", "n_digits", "n_marked", "n_runs"]


def _count(text: Column, characters: str) -> Column:
    return (F.size(F.split(text, characters)) - 1).cast("long")


def _pairs(a: Column, b: Column, shift: int, n: Column) -> Column:
    """Hashes of a[i] with b[i + shift], for the n first i."""
    return F.zip_with(F.slice(a, 1, n), F.slice(b, shift + 1, n), lambda x, y: F.xxhash64(x, y))


def features(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and the counts that the rules look at, of each row's whole text (null: empty).

    Repeated words are those in windows of five words that the text has twice or more. Windows are compared by 64-bit
    hashes within one text; only texts with equal ones sort them.
    """
    assert window == WINDOW
    text = docs.select("doc_id", text_of(docs).alias("t"))
    words = text.select("doc_id", "t", F.filter(F.split("t", f"[{SPACES}]+"), lambda w: w != "").alias("ws"), F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACES}]")).alias("ls"))
    words = words.select(
        "doc_id",
        F.size("ws").cast("long").alias("n_words"),
        F.char_length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        _count(F.col("t"), "[#*$%&|<>]").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.size("ls").cast("long").alias("n_lines"),
        _count(F.col("t"), "[A-Z]").alias("n_capitals"),
        _count(F.col("t"), "[!?]").alias("n_marks"),
        _count(F.col("t"), "[0-9]").alias("n_digits"),
        _count(F.col("t"), f"[#*$%&|<>][^{SPACES}]*").alias("n_marked"),
        _count(F.col("t"), "[#*$%&|<>]{2,}").alias("n_runs"),
        F.transform("ws", lambda w: F.xxhash64(w)).alias("h"),
    )
    kept = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", *EXTRA]
    n = F.greatest(F.size("h") - 4, F.lit(0))
    two = words.withColumn("h2", _pairs(F.col("h"), F.col("h"), 1, F.greatest(F.size("h") - 1, F.lit(0))))
    four = two.withColumn("h4", _pairs(F.col("h2"), F.col("h2"), 2, F.greatest(F.size("h") - 3, F.lit(0))))
    five = four.select(*kept, _pairs(F.col("h4"), F.col("h"), 4, n).alias("h5"))
    again = F.size("h5") > F.size(F.array_distinct("h5"))
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    found = five.select(*kept, F.when(again, F.array_sort(F.transform("h5", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(empty).alias("s"))

    def repeated(x: Column, k: Column) -> Column:  # its neighbours in sorted order; k counts from 0, get() is null outside
        return F.coalesce(F.get("s", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("s", k + 1)["h"] == x["h"], F.lit(False))

    places = found.select(*kept, F.array_sort(F.transform(F.filter("s", repeated), lambda x: x["i"])).alias("p"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("p", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")))
    return places.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered["n"].alias("n_repeat_words"), *EXTRA)


def votes(counted: DataFrame, rules: dict = RULES) -> DataFrame:
    columns = {}
    for name, (x, bad, good) in rules.items():
        vote = F.when(F.expr(x) > bad, -1)
        columns[f"v_{name}"] = (vote if good is None else vote.when(F.expr(x) <= good, 1)).otherwise(0)
    return counted.withColumns(columns)


VOTES = (-1, 0, 1)
#: What EM starts from and what the prior says: the share of good documents, and how often a rule votes bad on good and
#: on bad documents. The prior counts as this many documents of each kind.
SHARE, BAD_ON_GOOD, BAD_ON_BAD, PRIOR_DOCUMENTS = 0.85, 0.02, 0.3, 20.0
Table = list[list[tuple[float, float]]]


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: int = 0, steps: int = 300) -> tuple[float, Table]:
    """The share of good documents, and for each rule and vote (bad, none, good) its probability on good and on bad ones.

    The expectation step gives each pattern its posterior; the maximisation step counts votes by it, with the prior's
    documents added. Other votes than bad begin as often as they occur.
    """
    k = len(patterns[0][0]) if patterns else rules
    begin: Table = []
    for r in range(k):
        rest = [1 + sum(n for votes_, n in patterns if votes_[r] == v) for v in (0, 1)]
        begin.append([(BAD_ON_GOOD, BAD_ON_BAD), *(((1 - BAD_ON_GOOD) * x / sum(rest), (1 - BAD_ON_BAD) * x / sum(rest)) for x in rest)])
    share, table = SHARE, begin
    for _ in range(steps if patterns else 0):
        sums = [[[PRIOR_DOCUMENTS * x for x in pair] for pair in rule] for rule in begin]
        good, total = PRIOR_DOCUMENTS * SHARE, PRIOR_DOCUMENTS
        for votes_, n in patterns:
            p = posterior(votes_, share, table)
            good, total = good + n * p, total + n
            for r, v in enumerate(votes_):
                sums[r][v + 1][0] += n * p
                sums[r][v + 1][1] += n * (1 - p)
        new: Table = []
        for rule in sums:
            of = [sum(pair[c] for pair in rule) for c in (0, 1)]
            new.append([(pair[0] / of[0], pair[1] / of[1]) for pair in rule])
        moved = max((abs(x - y) for a, b in zip(new, table, strict=True) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True)), default=0.0)
        share, table = good / total, new
        if moved < 1e-9:
            break
    return share, table


def weights(share: float, table: Table) -> tuple[float, list[list[float]]]:
    """Log odds of the share, and what each vote of each rule (bad, none, good) adds to them."""
    return math.log(share / (1 - share)), [[math.log(g / b) for g, b in rule] for rule in table]


def posterior(votes_: tuple[int, ...], share: float, table: Table) -> float:
    base, w = weights(share, table)
    return 1 / (1 + math.exp(-min(max(base + sum(t[v + 1] for t, v in zip(w, votes_, strict=True)), -700), 700)))


def quality(docs: DataFrame, rules: dict = RULES, least: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, the posterior probability of good quality and kept, for each row of docs.

    kept needs both: the base rules hold (ten words at least, at most a fifth of them in repeated windows) and the
    probability is `least` or more. A null text counts as empty and fails. Rows with equal doc_ids stay separate rows.
    Other columns aren't looked at; no rows give no rows.
    """
    plain_reads(docs.sparkSession)
    voted = cut(votes(features(docs), rules))
    names = [f"v_{name}" for name in rules]
    counts = voted.groupBy(*names).count().collect()  # 3 ** len(rules) rows at most
    base, added = weights(*fit(sorted((tuple(r[:-1]), r[-1]) for r in counts), len(rules)))
    logit = F.lit(base)
    for name, w in zip(names, added, strict=True):
        logit = logit + F.when(F.col(name) == 1, w[2]).when(F.col(name) == -1, w[0]).otherwise(w[1])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    chance = 1 / (1 + F.exp(-logit))
    return voted.select("doc_id", *COLUMNS, failed.alias("base_failed"), (~failed & (chance >= least)).alias("kept"), chance.alias("quality"))
