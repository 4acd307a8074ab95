"""Selecting and packing ranked results into bounded contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.text import SPACES, let


def _by_rank(first: int, last: int):
    return Window.partitionBy("query_id").orderBy("rank").rowsBetween(first, last)


def budget_prefix(ranked: DataFrame, budget_tokens: int) -> DataFrame:
    """The longest prefix of each query's results (query_id, rank, text, ...) within four characters a token; nothing is skipped over."""
    if budget_tokens <= 0:
        raise ValueError("the budget must be positive")
    running = F.sum(F.length("text")).over(_by_rank(Window.unboundedPreceding, 0))
    return ranked.withColumn("running_chars", running).where(F.col("running_chars") <= 4 * budget_tokens)


def context_pack(ranked: DataFrame, most: int = 4000) -> DataFrame:
    """Results until ``most`` characters are used; the last one is cut."""
    before = F.coalesce(F.sum(F.length("text")).over(_by_rank(Window.unboundedPreceding, -1)), F.lit(0))
    rows = ranked.withColumn("before", before).where(F.col("before") < most)
    return rows.withColumn("text", F.substring("text", F.lit(1), (most - F.col("before")).cast("int"))).drop("before")


def budget_frontier(ranked: DataFrame, gold: DataFrame, budgets: list[int]) -> DataFrame:
    """For each budget: results kept, and gold pairs (query_id, chunk_id) that the prefix loses against the full ranking."""
    running = F.sum(F.length("text")).over(_by_rank(Window.unboundedPreceding, 0))
    flags = gold.select("query_id", "chunk_id", F.lit(1).alias("gold"))
    rows = ranked.withColumn("running_chars", running).join(flags, ["query_id", "chunk_id"], "left")
    rows = rows.select("running_chars", "gold", F.explode(F.array(*map(F.lit, budgets))).alias("budget"))
    kept = F.col("running_chars") <= 4 * F.col("budget")
    return rows.groupBy("budget").agg(F.count_if(kept).alias("n_kept"), F.count_if((F.col("gold") == 1) & ~kept).alias("n_lost"), F.count("*").alias("n_all"))


def replay(ranked: DataFrame, gold: DataFrame, budget_tokens: int, *by: str) -> DataFrame:
    """For each query (and ``by``) of ranked results (query_id, rank, chunk_id, text), what a prefix within the budget keeps of them:
    whether a gold chunk (query_id, chunk_id) is among all and among the kept, how many are kept, the last kept rank, and characters."""
    running = F.sum(F.length("text")).over(Window.partitionBy(*by, "query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    flags = gold.select("query_id", "chunk_id", F.lit(True).alias("__gold")).distinct()
    kept, is_gold, size = F.col("__running") <= 4 * budget_tokens, F.coalesce("__gold", F.lit(False)), F.length("text")
    rows = ranked.withColumn("__running", running).join(flags, ["query_id", "chunk_id"], "left")
    return rows.groupBy(*by, "query_id").agg(
        F.max(is_gold).alias("parent_hit"), F.max(is_gold & kept).alias("hit"), F.count("*").alias("n_results"), F.count_if(kept).alias("n_kept"), F.coalesce(F.max(F.when(kept, F.col("rank"))), F.lit(0)).alias("last_kept"),
        F.coalesce(F.sum(F.when(kept, size)), F.lit(0)).alias("chars_kept"), F.sum(size).alias("chars_all"),
    )


# Words that say little about what a query asks for.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "does", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "under", "what", "when", "which", "with",
)


def fragment_header(rank: Column, source: Column, page: Column) -> Column:
    return F.concat(F.lit("[rank="), rank.cast("string"), F.lit(" source="), source, F.lit(" page="), page, F.lit("]"))


def allocate(ranked: DataFrame, most: int = 3072, largest: int = 640) -> DataFrame:
    """Adds ``allocation`` to results (query_id, rank, text, header): ``most`` characters, less headers and what stands between the
    results, shared over a query's results, none above its length or ``largest``.

    All get the same, what doesn't divide goes to the first; what short results leave goes to the others in the same way, until nothing
    is left. A budget that can't give every result a character is an error, and so is a result without text. A query's results are
    folded in one row.
    """
    length = F.least(F.length("text"), F.lit(largest))
    one = F.struct("rank", length.alias("cap"), F.length("header").alias("header"))
    rows = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("r"))
    caps = F.transform("r", lambda x: x["cap"])
    spent = F.aggregate("r", F.lit(0), lambda n, x: n + x["header"] + 1) + 2 * (F.size("r") - 1)
    available = most - spent

    def deal(state: Column, _: Column) -> Column:
        open_ = F.zip_with(state["given"], F.col("caps"), lambda g, c: F.when(g < c, 1).otherwise(0))

        def grants(flags: Column) -> Column:
            n = F.aggregate(flags, F.lit(0), lambda a, b: a + b)
            left = F.greatest(state["left"], F.lit(0))
            share, rest = F.floor(left / F.greatest(n, F.lit(1))).cast("int"), (left % F.greatest(n, F.lit(1))).cast("int")

            def one(flag: Column, i: Column) -> Column:
                before = F.aggregate(F.slice(flags, F.lit(1), i), F.lit(0), lambda a, b: a + b)
                asked = share + F.when(before < rest, 1).otherwise(0)
                free = F.element_at(F.col("caps"), i + 1) - F.element_at(state["given"], i + 1)
                return F.when(flag == 1, F.least(asked, free)).otherwise(0)

            return F.transform(flags, one)

        def dealt(g: Column) -> Column:
            total = F.aggregate(g, F.lit(0), lambda a, b: a + b)
            return F.struct(F.zip_with(state["given"], g, lambda a, b: a + b).alias("given"), (state["left"] - total).alias("left"))

        return let(let(open_, grants), dealt)

    rows = rows.withColumns({"caps": caps, "available": available})
    start = F.struct(F.transform("caps", lambda c: F.lit(0)).alias("given"), F.col("available").alias("left"))
    given = F.aggregate(F.sequence(F.lit(0), F.size("caps")), start, deal)["given"]
    rows = rows.withColumn("given", F.when((F.col("available") < F.size("r")) | F.exists("caps", lambda c: c < 1), F.raise_error(F.lit("the budget or a text is too small for every result")).cast("array<int>")).otherwise(given))
    each = rows.select("query_id", F.explode(F.zip_with("r", "given", lambda x, g: F.struct(x["rank"].alias("rank"), g.alias("allocation")))).alias("x"))
    return ranked.join(each.select("query_id", "x.rank", "x.allocation"), ["query_id", "rank"])


#: What ends a unit of text: line ends, or white space after a sentence or clause.
BOUNDARY = rf"(?:\r?\n)+|(?<=[.!?;:])[{SPACES}]+"


def fragment_windows(rows: DataFrame, stride: int = 112) -> DataFrame:
    """Windows of every text, at most ``allocation`` characters long: window_start, window_end, window_text.

    A window starts where a unit of text does, every ``stride`` within units longer than a window, and so that it reaches the end. It ends
    where the last unit does that leaves it at least half its length, else at its length; without white space at its ends. A text that
    fits is one window. Everything is worked out inside the row.
    """
    text, size = F.col("text"), F.col("allocation")
    pieces = F.zip_with(F.split(text, BOUNDARY, -1), F.regexp_extract_all(text, F.lit(BOUNDARY), F.lit(0)), lambda a, b: F.length(a) + F.coalesce(F.length(b), F.lit(0)))
    ends = F.aggregate(pieces, F.array(F.lit(0)), lambda seen, n: F.concat(seen, F.array(F.element_at(seen, -1) + n)))
    rows = rows.withColumn("bounds", F.array_distinct(ends))
    units = F.zip_with(F.slice("bounds", 1, F.size("bounds") - 1), F.slice("bounds", 2, F.size("bounds") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    inside = F.flatten(F.transform(units, lambda u: F.when(u["b"] - u["a"] > size, F.sequence(u["a"], u["b"] - 1, F.lit(stride))).otherwise(F.array(u["a"]))))
    starts = F.array_distinct(F.concat(inside, F.array(F.greatest(F.lit(0), F.length("text") - size))))

    def window(raw: Column) -> Column:
        blank = F.length(F.regexp_extract(F.substring(text, raw + 1, F.length("text")), f"^[{SPACES}]*", 0))

        def ended(start: Column) -> Column:
            limit = F.least(F.length("text"), start + size)
            fits = F.filter("bounds", lambda b: (b >= start + F.greatest(F.lit(1), F.floor(size / 2).cast("int"))) & (b <= limit))
            end = F.coalesce(F.array_max(fits), limit)
            kept = F.regexp_replace(F.substring(text, start + 1, end - start), f"[{SPACES}]+$", "")
            return F.struct(start.alias("window_start"), (start + F.length(kept)).alias("window_end"), kept.alias("window_text"))

        return let(raw + blank, ended)

    whole = F.array(F.struct(F.lit(0).alias("window_start"), F.length("text").alias("window_end"), text.alias("window_text")))
    windows = F.array_distinct(F.filter(F.transform(starts, window), lambda w: w["window_end"] > w["window_start"]))
    rows = rows.withColumn("w", F.when(F.length("text") == 0, F.slice(whole, 1, 0)).when(F.length("text") <= size, whole).otherwise(windows)).drop("bounds")
    return rows.select(*(c for c in rows.columns if c != "w"), F.explode("w").alias("w")).select("*", "w.*").drop("w")


def content_tokens(tokens: Column) -> Column:
    """Query tokens without stop words, unless all are."""
    kept = F.filter(tokens, lambda t: ~t.isin(*STOP_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def _runs(words: Column, n: int) -> Column:
    """The distinct runs of n words."""
    made = let(words, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(made)


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def fragment_scores(windows: DataFrame) -> DataFrame:
    """Adds to (query_tokens, window_tokens, and signal_tokens where there are any): distinct query tokens found, occurrences, shared
    bigrams, and distinct query tokens that the window shares with the signals. Stop words of the query don't count, unless all are."""
    query = F.col("query_tokens")
    signals = F.col("signal_tokens") if "signal_tokens" in windows.columns else F.array().cast("array<string>")
    rows = windows.withColumn("query_tokens", content_tokens(query))
    occurrences = F.size(F.filter("window_tokens", lambda t: F.array_contains("query_tokens", t)))
    return rows.withColumns({
        "n_unique": _shared(query, F.col("window_tokens")), "n_occurrences": occurrences, "n_bigrams": _shared(_runs(query, 2), _runs(F.col("window_tokens"), 2)),
        "n_signals": _shared(F.array_intersect("query_tokens", "window_tokens"), signals),
    })


def evidence_scores(windows: DataFrame, n: int = 3) -> DataFrame:
    """As fragment_scores, against what should be found: shared runs of n evidence_tokens, occurrences, shared bigrams; no signals."""
    evidence = F.col("evidence_tokens")
    occurrences = F.size(F.filter("window_tokens", lambda t: F.array_contains("evidence_tokens", t)))
    return windows.withColumns({
        "n_unique": _shared(_runs(evidence, n), _runs(F.col("window_tokens"), n)), "n_occurrences": occurrences,
        "n_bigrams": _shared(_runs(evidence, 2), _runs(F.col("window_tokens"), 2)), "n_signals": F.lit(0),
    })


def best_windows(scored: DataFrame, *keys: str) -> DataFrame:
    """For each of the keys the window with the highest scores; ties go to the longer, then the earlier window."""
    order = F.struct("n_unique", "n_occurrences", "n_bigrams", "n_signals", F.col("window_end") - F.col("window_start"), -F.col("window_start"))
    fields = F.struct("window_start", "window_end", "window_text", "n_unique", "n_occurrences", "n_bigrams", "n_signals")
    return scored.groupBy(*keys).agg(F.max_by(fields, order).alias("w")).select(*keys, "w.*")


def render_fragments(best: DataFrame) -> DataFrame:
    """(query_id, context): each fragment (query_id, rank, header, window_text) under its header, in rank order."""
    part = F.struct("rank", F.concat("header", F.lit("\n"), "window_text").alias("part"))
    return best.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["part"]), "\n\n").alias("context"))


def evidence_held(gold: DataFrame, **texts: DataFrame) -> DataFrame:
    """How much of the n-grams of each case (query_id, grams) different texts (query_id, grams) hold, by the name they are given under:
    n_gold and a count for each; a case without grams is left out. Grams are compared as hashed rows, never as lists of a whole run."""
    wanted = gold.select("query_id", F.explode(F.array_distinct("grams")).alias("gram"))
    rows = wanted
    for name, t in texts.items():
        held = t.select("query_id", F.explode("grams").alias("gram")).distinct().withColumn(name, F.lit(1))
        rows = rows.join(held, ["query_id", "gram"], "left")
    return rows.groupBy("query_id").agg(F.count("*").alias("n_gold"), *(F.count(n).alias(f"n_{n}") for n in texts))


def untraceable(best: DataFrame, chunks: DataFrame) -> DataFrame:
    """Fragments (chunk_id, window_start, window_end, window_text) that aren't what their chunk has at their place."""
    rows = best.join(chunks.select("chunk_id", F.col("text").alias("chunk_text")), "chunk_id", "left")
    same = F.substring("chunk_text", F.col("window_start") + 1, F.col("window_end") - F.col("window_start")) == F.col("window_text")
    inside = (F.col("window_start") >= 0) & (F.col("window_end") > F.col("window_start")) & (F.col("window_end") <= F.length("chunk_text"))
    return rows.where(~F.coalesce(same & inside, F.lit(False))).drop("chunk_text")


def prompt(packed: DataFrame, question: bool = False) -> DataFrame:
    """query_id and the rendered context: a numbered header and the text of each result, in rank order.

    Results may have a score, which the header then shows; with ``question`` the query (a column of packed) stands at the end.
    """
    head = [F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("chunk_id")]
    head += [F.lit(" (score "), F.regexp_replace(F.format_string("%.4f", F.col("score").cast("double")), r"\.?0+$", ""), F.lit(")")] if "score" in packed.columns else []
    part = F.concat(*head, F.lit("\n"), F.col("text"))
    parts = F.sort_array(F.collect_list(F.struct("rank", part.alias("part"))))
    rows = packed.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "\n\n").alias("prompt"), *([F.first("query").alias("query")] if question else []))
    return rows.select("query_id", F.concat("prompt", F.lit("\n\nQuestion: "), "query").alias("prompt")) if question else rows
