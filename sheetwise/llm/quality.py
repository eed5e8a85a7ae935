"""Quality rules as a short-circuit cascade (native).

Every text gets its base figures; texts that pass the base rule go through a cascade of further rules.
Each rule's cost and rejection rate are measured on a bounded sample, and rules are ordered by
rejection per cost, so that most bad texts leave after one cheap test. A cost is the time of the rule over the
sample many times over, the least of several tries, less the time of a job that only reads the texts, as a power of
four: what start-up and other load add is left out, rules that cost next to nothing cost the same, and small differences do not change the order. The order changes
the work, not the verdict: a text is kept if no rule rejects it.

Repeated windows are found by the 64-bit hash of their five words. Defined results: a null or empty
text has no words, so it fails the base rule; repeated rows are judged alone; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.shared import materialise, words

WINDOW = 5
SAMPLE_ROWS = 400  # that costs and rejection rates are measured on
REPEATS = 4  # of the sample in one measurement
TRIES = 3


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, from the windows' hashes in order.

    Windows are sorted with their places; one is repeated if a neighbour in that order has its hash. In
    order of place, each repeated window adds the words that the one before it does not cover.
    """
    last = F.size(hashes) - 1
    pairs = F.array_sort(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(0), last).alias("i")))
    # A let binding: the sorted array is computed once and its neighbours are looked at by index.
    one = F.array(pairs)

    def places(s: Column) -> Column:
        same = lambda p, k: F.coalesce(p["h"] == F.get(s, k)["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda p, k: same(p, k - 1) | same(p, k + 1)), lambda p: p["i"]))

    covered = lambda q: F.aggregate(q, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("p")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["p"])).alias("n"), i.alias("p")), lambda a: a["n"])
    return F.get(F.transform(one, lambda s: covered(places(s))), F.lit(0))


def base(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    d = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumn("_w", words(F.col("text")))
    n = F.size("_w")
    shingle = lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(WINDOW)))
    d = d.withColumn("_h", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), shingle)).otherwise(F.array().cast("array<bigint>")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("_lines", lines)
    distinct = F.size(F.array_distinct("_h")) == F.size("_h")
    d = d.select(
        "doc_id",
        "text",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(distinct, F.lit(0)).otherwise(_repeat_words(F.col("_h"))).cast("long").alias("n_repeat_words"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


#: The further rules: true rejects. Each looks at whole texts and is set far from clean prose.
RULES: dict[str, Column] = {}


def rules() -> dict[str, Column]:
    if not RULES:
        n, text = F.col("n_words"), F.col("text")
        letters = lambda p: F.length(F.regexp_replace(text, p, ""))
        RULES.update(
            symbols=10 * F.col("n_symbols") > 3 * n,
            long_words=F.col("word_chars") > 25 * n,
            short_words=2 * F.col("word_chars") < 3 * n,
            repeated_lines=2 * F.col("n_dup_lines") > F.size(F.split(text, "\n", -1)),
            marks=10 * (F.length(text) - letters("[!?]")) > 5 * n,
            shouting=10 * (F.length(text) - letters(r"\p{Lu}")) > 6 * F.col("word_chars"),
            no_letters=2 * (F.length(text) - letters(r"\p{L}")) < F.col("word_chars"),
        )
    return RULES


def plan(figures: DataFrame, n_rows: int, sample_rows: int = SAMPLE_ROWS, seed: int = 5) -> list[tuple[str, float, float]]:
    """(rule, seconds per row, rejection rate) in order of rejection per cost, from a sample of about sample_rows texts."""
    share = min(1.0, sample_rows / max(n_rows, 1))
    some = materialise(figures.sample(fraction=share, seed=seed).limit(4 * sample_rows).coalesce(1), "quality-sample").filter("NOT base_failed")
    bad = some.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(rule.cast("long")), F.lit(0)).alias(name) for name, rule in rules().items())).first()
    many = some.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def seconds(rule: Column) -> float:
        took = []
        for _ in range(TRIES):  # a plan of its own each time: a plan that ran once keeps its shuffled sums
            job = many.agg(F.sum(rule.cast("long")))
            began = time.perf_counter()
            job.collect()
            took.append(time.perf_counter() - began)
        return min(took)

    empty = seconds(F.length("text") < 0)
    costs = {name: max(seconds(rule) - empty, empty / 8) / (REPEATS * max(bad.n, 1)) for name, rule in rules().items()}
    measured = [(name, 4.0 ** round(math.log(cost, 4)), (bad[name] + 1) / (bad.n + 2)) for name, cost in costs.items()]
    return sorted(measured, key=lambda m: (-m[2] / m[1], m[0]))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base figures of every text and `kept`: not base_failed, and rejected by no rule of the cascade."""
    n_rows = docs.count()
    share = min(1.0, 4 * sample_rows / max(n_rows, 1))
    order = plan(base(docs.sample(fraction=share, seed=3), key, text), int(n_rows * share), sample_rows)
    figures = base(docs, key, text)
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for name, _, _ in order:
        verdict = verdict.when(rules()[name], F.lit(False))
    return figures.withColumn("kept", verdict.otherwise(F.lit(True))).drop("text")


def kept_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose text is kept, with all their columns."""
    judged = judge(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text")), "_row", "_text")
    return judged.filter("kept").select("doc_id.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(least(5, i - p)) AS n FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -99) AS p FROM r) GROUP BY doc_id),
f AS (SELECT w.doc_id, text, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars > 25 * n_words OR 2 * word_chars < 3 * n_words
    OR 2 * n_dup_lines > len(string_split(text, chr(10)))
    OR 10 * (length(text) - length(regexp_replace(text, '[!?]', '', 'g'))) > 5 * n_words
    OR 10 * (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g'))) > 6 * word_chars
    OR 2 * (length(text) - length(regexp_replace(text, '\p{L}', '', 'g'))) < word_chars) AS kept
FROM b
"""
