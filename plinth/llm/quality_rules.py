"""Quality rules combined by weak supervision, in DataFrame functions only.

Every rule votes good, bad, or abstains where it doesn't apply. Which votes to
trust is learnt from their agreement: expectation-maximisation over the documents
that pass the base limits estimates the share of good documents and, for each
rule, how often its votes are right on good and on bad documents; an abstention
says nothing. A document stays when it passes the base limits and its posterior
probability of being good reaches one half, whatever single rules say. The steps
run over the table of distinct vote patterns, at most 3 ** len(RULES) rows at any
input size; the documents themselves are only counted once.

Defined results: null or empty text has no words, fails the base limits and is
not kept; very long texts are counted whole, in the row's own memory; repeated
rows vote and are judged each; an empty table gives an empty result; other columns
of the input, whatever their names, are ignored by ``judge`` and kept by
``keep_good``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import SPACE, let, packed, stored, text_of

SYMBOLS = "#*$%&|<>"
#: Rule, condition of a good vote, condition of a bad vote; over the counts below, in whole numbers. Else it abstains.
RULES = (
    ("word_length", "word_chars between 4 * n_words and 7 * n_words", "word_chars < 3 * n_words or word_chars > 10 * n_words"),
    ("letters", "10 * n_letters >= 9 * word_chars", "10 * n_letters < 8 * word_chars"),
    ("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    ("lines", "n_dup_lines = 0 and n_lines >= 2", "10 * n_dup_lines > 3 * n_lines"),
    ("repeats", "n_repeat_words = 0 and n_words >= 20", "10 * n_repeat_words > n_words"),
    ("capitals", "20 * n_capitals <= word_chars", "10 * n_capitals > 3 * word_chars"),
    ("marks", "50 * n_marks <= n_words", "10 * n_marks > n_words"),
    ("digits", "20 * n_digits <= word_chars", "5 * n_digits > word_chars"),
    ("length", "n_words >= 50", "n_words < 20"),
)
FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_marks", "n_digits")
#: Steps of expectation-maximisation; at first, the share of good documents, and how often votes on good and on bad documents are right.
STEPS, SHARE, RIGHT_GOOD, RIGHT_BAD = 20, 0.8, 0.95, 0.5
WINDOW = 5


def _only(text: Column, characters: str) -> Column:
    """How many of these characters (a class of a regular expression) a text has."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


def _repeat_words(words: Column) -> Column:
    """Words inside windows that occur twice or more. Hashes rule out most texts; the rest compares the windows themselves."""
    n = F.size(words)

    def windows(make: Callable[[Column], Column]) -> Column:
        return F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), make)

    def covered(at: Column) -> Column:
        gaps = F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(WINDOW)))
        return F.when(F.size(at) == 0, 0).otherwise(F.aggregate(gaps, F.lit(WINDOW), lambda s, x: s + x))

    def twice(sorted_windows: Column) -> Column:
        same = F.filter(
            sorted_windows,
            lambda s, k: (F.get(sorted_windows, k - 1)["w"] == s["w"]) | F.coalesce(F.get(sorted_windows, k + 1)["w"] == s["w"], F.lit(False)),
        )
        return let(F.array_sort(F.transform(same, lambda s: s["i"])), covered)

    exact = let(F.sort_array(windows(lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("w"), i.alias("i")))), twice)
    unlike = let(windows(lambda i: F.xxhash64(F.slice(words, i, WINDOW))), lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(n <= WINDOW, 0).when(unlike, 0).otherwise(exact)


def counts(text: Column) -> dict[str, Column]:
    """COUNTS of a text without nulls, as longs."""
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    by_words = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    found = {
        "w": by_words,
        "l": by_lines,
        "word_chars": F.length(text) - _only(text, SPACE),
        "n_letters": F.length(text) - _only(text, SPACE) - F.length(F.regexp_replace(text, rf"[\p{{L}}{SPACE}]+", "")),
        "n_symbols": _only(text, SYMBOLS),
        "n_capitals": _only(text, "A-Z"),
        "n_marks": _only(text, "!?"),
        "n_digits": _only(text, "0-9"),
    }
    return found


def with_counts(rows: DataFrame, text: Column) -> DataFrame:
    """rows, which may have no column c or q, and a struct ``q`` with COUNTS."""
    rows = rows.withColumn("c", F.struct(*(c.alias(k) for k, c in counts(text).items())))
    inner = {"n_words": "w.n", "n_repeat_words": "w.r", "n_lines": "l.n", "n_dup_lines": "l.d"}
    fields = (F.col(f"c.{inner.get(k, k)}").cast("long").alias(k) for k in COUNTS)
    return rows.withColumn("q", F.struct(*fields)).drop("c")


def votes() -> str:
    """SQL for the vote pattern: a digit for each rule, 2 good, 1 bad, 0 abstains."""
    return "concat(" + ", ".join(f"case when {good} then '2' when {bad} then '1' else '0' end" for _, good, bad in RULES) + ")"


def posterior(params: list[float], pattern: str = "pattern") -> str:
    """SQL for the probability that a document of this pattern is good.

    params: the share of good documents, then for each rule how often its votes are right on good documents, and on bad ones.
    """
    odds = [f"{(1 - params[0]) / params[0]!r}D"]
    for j in range(len(RULES)):
        on_good, on_bad = params[2 * j + 1 : 2 * j + 3]
        odds.append(f"case substr({pattern}, {j + 1}, 1) when '2' then {(1 - on_bad) / on_good!r}D when '1' then {on_bad / (1 - on_good)!r}D else 1.0D end")
    return f"(1.0D / (1.0D + {' * '.join(odds)}))"


def learn(patterns: DataFrame) -> list[float]:
    """The parameters from rows (pattern, n): expectation-maximisation, one aggregation a step.

    One right and one wrong vote are added to what a rule is seen to do, so that no parameter reaches 0 or 1.
    """
    params = [SHARE, *[RIGHT_GOOD, RIGHT_BAD] * len(RULES)]
    for _ in range(STEPS):
        rows = patterns.withColumn("good", F.col("n") * F.expr(posterior(params)))
        good, bad = F.col("good"), F.col("n") - F.col("good")
        sums = [F.sum(good), F.sum(bad)]
        for j in range(len(RULES)):
            vote = F.substring("pattern", j + 1, 1)
            sums += [F.sum(F.when(vote == v, side)) for side in (good, bad) for v in ("2", "1")]
        x = [float(v or 0) for v in rows.agg(*sums).first()]
        params = [(x[0] + 1) / (x[0] + x[1] + 2)]
        for at in range(2, len(x), 4):
            good_up, good_down, bad_up, bad_down = x[at : at + 4]
            params += [(good_up + 1) / (good_up + good_down + 2), (bad_down + 1) / (bad_up + bad_down + 2)]
    return params


def _judged(rows: DataFrame) -> DataFrame:
    """Adds ``posterior`` and ``kept`` to a stored table with pattern and base_failed; only documents within the base limits teach."""
    patterns = rows.where("not base_failed").groupBy("pattern").agg(F.count("*").alias("n"))
    params = learn(stored(patterns, "patterns"))
    rows = rows.withColumn("posterior", F.expr(posterior(params)))
    return rows.withColumn("kept", F.expr("not base_failed and posterior >= 0.5"))


def judge(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, the vote pattern, the posterior probability of being good, and kept."""
    rows = with_counts(docs.select("doc_id", text_of(docs).alias("text")), F.col("text")).select("doc_id", "q.*")
    return _judged(stored(rows.withColumns({"pattern": F.expr(votes()), "base_failed": F.expr(FAILED)}), "counts"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with their columns. Rows are written once, with their pattern, so that nothing is counted twice."""
    rows = with_counts(packed(docs, "text").withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))), F.col("text"))
    rows = rows.select("row", "q.*").select("row", F.expr(votes()).alias("pattern"), F.expr(FAILED).alias("base_failed"))
    return _judged(stored(rows, "voted")).where("kept").select("row.*")


def _sql() -> str:
    """DuckDB SQL for op9, with the steps of expectation-maximisation spelled out."""

    def post(p: str) -> str:
        odds = [f"((1 - {p}.p0) / {p}.p0)"]
        for j in range(len(RULES)):
            good, bad = f"{p}.a{j}", f"{p}.b{j}"
            odds.append(f"case substr(pattern, {j + 1}, 1) when '2' then (1 - {bad}) / {good} when '1' then {bad} / (1 - {good}) else 1 end")
        return f"(1 / (1 + {' * '.join(odds)}))"

    first = ", ".join(f"{RIGHT_GOOD}::double a{j}, {RIGHT_BAD}::double b{j}" for j in range(len(RULES)))
    steps = [f"em0 as (select {SHARE}::double p0, {first})"]
    for t in range(STEPS):
        columns = ["(coalesce(sum(n * p), 0) + 1) / (coalesce(sum(n), 0) + 2) p0"]
        for j in range(len(RULES)):
            for name, mark, weight in (("a", "2", "p"), ("b", "1", "(1 - p)")):
                right, cast = (f"coalesce(sum(n * {weight}) filter (where substr(pattern, {j + 1}, 1) {which}), 0)" for which in (f"= '{mark}'", "<> '0'"))
                columns.append(f"({right} + 1) / ({cast} + 2) {name}{j}")
        steps.append(f"em{t + 1} as materialized (select {', '.join(columns)} from (select pattern, n, {post(f'em{t}')} p from patterns, em{t}))")
    return f"""
with base as (
  select row_number() over () rid, doc_id, coalesce(text, '') t from documents
), cut as (
  select rid, doc_id, t, list_filter(regexp_split_to_array(t, '[ \\t-\\r]+'), lambda x: x <> '') w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) l from base
), windows as (
  select rid, i, array_to_string(w[i:i + 4], ' ') v from (select rid, w, unnest(range(1, len(w) - 3)) i from cut)
), twice as (
  select rid, unnest(range(i, i + 5)) pos from (select rid, i, count(*) over (partition by rid, v) c from windows) where c > 1
), repeats as (select rid, count(distinct pos) r from twice group by rid
), counted as (
  select doc_id, len(w)::bigint n_words, length(regexp_replace(t, '[ \\t-\\r]+', '', 'g'))::bigint word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols, (len(l) - len(list_distinct(l)))::bigint n_dup_lines,
    coalesce(r, 0)::bigint n_repeat_words, len(l)::bigint n_lines,
    length(regexp_replace(regexp_replace(t, '[ \\t-\\r]+', '', 'g'), '[^\\p{{L}}]+', '', 'g'))::bigint n_letters, length(regexp_replace(t, '[^A-Z]+', '', 'g'))::bigint n_capitals,
    length(regexp_replace(t, '[^!?]+', '', 'g'))::bigint n_marks, length(regexp_replace(t, '[^0-9]+', '', 'g'))::bigint n_digits
  from cut left join repeats using (rid)
), voted as (select *, {votes()} pattern, {FAILED} base_failed from counted
), patterns as materialized (select pattern, count(*)::double n from voted where not base_failed group by pattern
), {", ".join(steps)}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, pattern, round({post(f"em{STEPS}")}, 6) posterior,
  not base_failed and {post(f"em{STEPS}")} >= 0.5 kept
from voted, em{STEPS}"""


SQL = _sql()
