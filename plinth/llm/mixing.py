"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target in words: the sources share RATE times all words by
weight, no target is above MOST times its source's words, and what a capped
source can't take goes to the others by weight. A source is read in whole epochs
as often as its target holds, then once more in part: documents are ordered by
an exponential key, scaled by a quality weight and seeded by the document itself,
and taken in this order until the rest of the target is met as closely as whole
documents allow.

No source is gathered in one task. The order's prefix sums are taken over BUCKETS
ranges of the key for each source; only the range in which the target ends is
ordered document by document. A document then finds out from its own key and a
table with a row for each source what it contributes. Rows alike in doc_id, text
and source share one key; where the target ends among them, as many are taken as
fit: files of the stored keys get quotas, and each file numbers its own rows.

Defined results: null or empty text has size 0 and contributes nothing; very long
texts are counted whole, in the row's own memory; null is a source of its own and
comes last; of rows alike in doc_id, text and source, any may be the ones that are
taken; an empty table gives an empty result. Other columns of the input, whatever
their names, are ignored by ``mix`` and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import SPACE, packed, stored, text_of
from plinth.operators.numbering import numbered

#: Weights of the sources in code point order, repeating; words of the mix against all words; largest repetition; seed.
WEIGHTS, RATE, MOST, SEED = (5, 2, 1), 1.5, 2, 17
#: Ranges of the key for each source in which words are summed.
BUCKETS = 4096
SYMBOLS = "#*$%&|<>!"


def _measured(docs: DataFrame) -> dict[str, Column]:
    """Size, tie-breaking digest, key, and the key's range, of every row."""
    text = text_of(docs)
    size = F.size(F.array_remove(F.split(text, f"[{SPACE}]+"), "")).cast("long")
    symbols = F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", ""))
    doc = F.coalesce(docs["doc_id"].cast("string"), F.lit("null"))
    digest = F.md5(F.concat_ws("|", F.lit(str(SEED)), doc, F.md5(text.cast("binary"))).cast("binary"))
    return {"size": size, "symbols": symbols, "digest": digest}


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds ``key`` and ``bucket`` to rows with size, symbols and digest. A document's weight falls with its symbols per word, down to 0.1."""
    uniform = (F.conv(F.substring("digest", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    weight = 1.0 - F.least(F.lit(0.9), F.col("symbols").cast("double") / F.greatest(F.col("size"), F.lit(1)).cast("double"))
    rows = rows.withColumn("key", -F.log(uniform) / weight)
    return rows.withColumn("bucket", F.floor(F.col("key") / (1.0 + F.col("key")) * BUCKETS).cast("int"))


def targets(sizes: DataFrame) -> DataFrame:
    """Adds ``target`` to rows (source, no_source, source_size), one for each source; no task sees all of them.

    The level is what a weight of one gets. It rises as sources reach their cap and leave the rest to the others, one aggregation a
    step, until no further one does.
    """
    rows = numbered(sizes, "no_source", "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("number") % len(WEIGHTS) + 1).cast("int"))
    rows = rows.withColumns({"weight": weight.cast("long"), "cap": MOST * F.col("source_size")}).drop("number")
    level, seen, capped = 0.0, -1, F.lit(False)
    while True:
        n, total, caps, weights = rows.agg(F.count_if(capped), F.sum("source_size"), F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if n == seen or not weights:
            break
        seen, level = n, (RATE * total - (caps or 0)) / weights
        capped = F.lit(level) * F.col("weight") > F.col("cap")
    share = F.when(capped, F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return rows.select("source", "no_source", "source_size", share.alias("target"))


def _plan(keyed: DataFrame) -> DataFrame:
    """A row for each source: size, target, epochs, and the last key and digest that the part epoch takes (null: none), how many rows have them and fit."""
    by = ["source", "no_source"]
    ranges = stored(keyed.groupBy(*by, "bucket").agg(F.sum("size").alias("words")), "ranges")
    plan = targets(ranges.groupBy(*by).agg(F.sum("words").alias("source_size")))
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.withColumn("epochs", whole.cast("long")).withColumn("part", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = stored(plan, "targets")
    before = F.coalesce(F.sum("words").over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = ranges.withColumn("before", before).join(plan, by).where("before <= part")
    last = last.groupBy(*by).agg(F.max(F.struct("bucket", "before", "part")).alias("x")).select(*by, "x.*")
    edge = keyed.join(last, [*by, "bucket"]).groupBy(*by, "bucket", "before", "part", "key", "digest", "size").agg(F.count("*").alias("copies"))
    words = F.sum(F.col("size") * F.col("copies")).over(Window.partitionBy(*by).orderBy("key", "digest").rowsBetween(Window.unboundedPreceding, -1))
    edge = edge.withColumn("rest", F.col("part") - F.col("before") - F.coalesce(words, F.lit(0)))
    fit = F.when(F.col("size") > 0, F.least("copies", F.floor(F.col("rest") / F.col("size") + 0.5).cast("long"))).otherwise(F.col("copies"))
    cut = edge.withColumn("fit", fit).where("2 * rest >= size").groupBy(*by).agg(F.max(F.struct("key", "digest", "copies", "fit")).alias("cut"))
    rows = last.select(*by, F.col("bucket").alias("edge")).join(cut, by, "left")
    return stored(plan.join(rows, by, "left"), "plan")


def _sourced(rows: DataFrame, source: Column) -> DataFrame:
    return rows.withColumns({"source": F.coalesce(source.cast("string"), F.lit("")), "no_source": source.isNull()})


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``nth`` to the rows of a source's last key where only some of its copies fit: their number, from 1; null elsewhere.

    The rows are those of a stored table, told apart by file and place; a file's rows are numbered in one task, and go on where the
    files before it end. Only these rows are shuffled.
    """
    by = ["source", "no_source"]
    last = F.coalesce(F.expr("cut.fit < cut.copies and key = cut.key and digest = cut.digest"), F.lit(False))
    some = rows.where(last)
    in_file = some.groupBy(*by, "file").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(*by, "file").orderBy("place"))
    some = some.withColumn("own", own).join(in_file.select(*by, "file", before.alias("start")), [*by, "file"])
    some = some.withColumn("nth", F.col("start") + F.col("own")).drop("start", "own")
    return rows.where(~last).withColumn("nth", F.lit(None).cast("long")).unionByName(some)


def _planned(measured: DataFrame) -> DataFrame:
    """The rows of a table with source, size, symbols, digest and others, with their source's plan and ``taken``, the words that the mix takes.

    Only what the plan needs is written; the rows themselves are, too, where some of them have to be told apart.
    """
    own = _keyed(measured)
    keyed = stored(own.select("source", "no_source", "size", "key", "digest", "bucket"), "keys")
    plan = _plan(keyed)
    by = ["source", "no_source"]
    if plan.where("cut.fit < cut.copies").isEmpty():
        rows = own.join(plan, by).withColumn("nth", F.lit(None).cast("long"))
    else:
        placed = stored(own, "rows").select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
        rows = _numbered(placed.join(plan, by))
    below = F.col("bucket") < F.col("edge")
    within = (F.col("bucket") == F.col("edge")) & F.coalesce(F.struct("key", "digest") <= F.struct("cut.key", "cut.digest"), F.lit(False))
    fits = F.coalesce(F.col("nth") <= F.col("cut.fit"), F.lit(True))
    return rows.withColumn("taken", (F.col("size") * (F.col("epochs") + F.when((below | within) & fits, 1).otherwise(0))).cast("long"))


def mix(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, size, its source's size and target, and the words that the mix takes of it, repeats counted."""
    found = _measured(docs)
    rows = docs.select("doc_id", "source", *(c.alias(k) for k, c in found.items()))
    rows = stored(_sourced(rows, rows["source"]), "sizes")
    return _planned(rows).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the columns of docs."""
    own = packed(docs, "doc_id", "source", "text")
    rows = own.select("row", "doc_id", "source", *(c.alias(k) for k, c in _measured(own).items()))
    rows = _planned(_sourced(rows, rows["source"]))
    times = (F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")


SQL = f"""
with d as (
  select doc_id, source, len(list_filter(regexp_split_to_array(t, '[ \\t-\\r]+'), lambda x: x <> ''))::bigint size,
    length(regexp_replace(t, '[^#*$%&|<>!]+', '', 'g')) symbols, md5('{SEED}|' || coalesce(doc_id::varchar, 'null') || '|' || md5(t)) digest
  from (select *, coalesce(text, '') t from documents)
), k as (
  select *, -ln((('0x' || substr(digest, 1, 13))::bigint::double + 0.5) / {1 << 52}) / (1.0::double - least(0.9::double, symbols::double / greatest(size, 1)::double)) key from d
), s as (
  select source, sum(size)::bigint source_size, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] weight from k group by source
), l as (
  select *, {MOST} * source_size cap, ({RATE} * sum(source_size) over () - coalesce(sum({MOST} * source_size) over (order by {MOST} * source_size / weight, source nulls last
    rows between unbounded preceding and 1 preceding), 0))::double / sum(weight) over (order by {MOST} * source_size / weight, source nulls last rows between current row and unbounded following) level from s
), t as (
  select source, source_size, case when level * weight > cap then cap::double
    else first_value(case when level * weight > cap then null else level end ignore nulls) over (order by cap / weight, source nulls last rows between unbounded preceding and unbounded following) * weight end target from l
), p as (
  select k.*, source_size, target, case when source_size > 0 then floor(target / source_size)::bigint else 0 end epochs,
    coalesce(sum(size) over (partition by k.source order by key, digest rows between unbounded preceding and 1 preceding), 0) seen
  from k join t on k.source is not distinct from t.source
)
select doc_id, size, source_size, target, (size * (epochs + case when 2 * seen + size <= 2 * (target - epochs * source_size) then 1 else 0 end))::bigint taken from p"""
