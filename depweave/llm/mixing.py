"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Each document gets a random key by a hash of its id and text. The key's leading bits name a range of the source's random order,
so the ranges are even whatever the ids look like, and one more large source only means more ranges. Sums
per range, added up along each source, give every range its offset; within a range a running sum places
every document. The mix takes whole epochs of a source and, of one more, the documents before the cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.llm.store import save
from depweave.operators.spread import spread_join

#: The words that sizes count.
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """``weights`` go to the sources in code point order, null last, and repeat. ``most_epochs`` bounds a
    source's target as a multiple of its size. ``range_rows``: documents that a range holds on average, or
    more if there would be over ``most_ranges``. Up to ``most_sources`` sources are broadcast."""

    weights: tuple[int, ...] = (5, 2, 1)
    most_epochs: int = 3
    seed: str = "mix"
    range_rows: int = 4096
    most_ranges: int = 1 << 16
    most_sources: int = 1 << 16


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, how: Mix) -> DataFrame:
    """``sizes`` (source, source_size, n) with ``target``: the share by weight of the total, stopped at
    ``most_epochs`` times the size; the excess goes to the others by weight until none is above.

    Sources with the least room for their weight stop first: in that order source i stops exactly if what
    the sources before it leave, dealt out by weight over it and those after it, exceeds its own room.
    """
    everything = Window.partitionBy()  # one row a source
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*(F.lit(w) for w in how.weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(how.weights))) + 1).cast("double")
    rows = sizes.withColumn("weight", weight).withColumn("room", (F.col("source_size") * how.most_epochs).cast("double"))
    rows = rows.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    by_room = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("room").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("total") - before) / after)
    # The level of the first source that doesn't stop holds for it and all after it.
    stops = F.col("level") * F.col("weight") > F.col("room")
    level = F.max(F.when(~stops, F.struct((-F.col("room") / F.col("weight")).alias("o"), F.col("level").alias("level")))).over(everything)["level"]
    rows = rows.withColumn("stops", stops).withColumn("level", level)
    target = F.when(F.col("stops") | F.col("level").isNull(), F.col("room")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("room")))
    return rows.select("source", "source_size", "n", target.alias("target"))


def _taken(docs: DataFrame, kept: list[str], how: Mix) -> DataFrame:
    """body (a struct of the kept columns), size, source_size, target, taken.

    Words are counted once into a narrow table, and once more only where texts themselves are kept."""
    body = F.struct(*(docs[c] for c in kept)) if kept else F.struct(F.lit(0).alias("none"))
    source = F.coalesce(F.concat(F.lit("s"), docs["source"].cast("string")), F.lit("none"))
    # Of doc_id and text, so that neither repeated nor lacking ids meet in one range.
    key = F.md5(F.concat(F.lit(f"{how.seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(docs["text"], F.lit("")))))
    rows = docs.select(body.alias("body"), docs["source"].alias("source"), source.alias("of"), docs["doc_id"].alias("doc_id"), word_count("text").alias("size"), key.alias("key"), F.xxhash64(docs["text"]).alias("tie"))
    if "text" in (c.lower() for c in kept):
        sizes = save(rows.select("source", "of", "size", "key"), "mix-sizes")
    else:
        rows = sizes = save(rows, "mix-sizes")
    totals = save(sizes.groupBy("source", "of").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-sources")
    n_sources, n_rows = totals.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    few = n_sources <= how.most_sources
    each = max(how.range_rows, -(-n_rows // how.most_ranges))
    plan = targets(totals, how).select(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("none")).alias("of"), "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("n") / each)).alias("ranges"))
    share = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")

    def ranged(table: DataFrame) -> DataFrame:
        joined = table.join(F.broadcast(plan), "of") if few else spread_join(table, plan, "of", counted=sizes)
        return joined.withColumn("range", F.floor(share * F.col("ranges") / F.lit(2**32)).cast("long"))

    sums = ranged(sizes).groupBy("of", "range").agg(F.sum("size").alias("sum"))
    along = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("of", "range", F.coalesce(F.sum("sum").over(along), F.lit(0)).alias("offset"))
    # At most ``most_ranges`` and one for each source.
    rows = ranged(rows).join(F.broadcast(offsets) if few else offsets, ["of", "range"])
    within = Window.partitionBy("of", "range").orderBy("key", "doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - F.col("before")))
    return rows.withColumn("before", before).select("body", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, how: Mix | None = None, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (by default all) plus size, source_size, target, taken (words taken, repeats counted).

    The sum of ``taken`` over a source is its target rounded to a word. A null source is a source of its
    own, after all others; null or empty texts have size 0 and take nothing. Rows that repeat a doc_id are
    documents of their own, in the order of their texts' hashes. An empty table gives an empty result.
    Columns named like the new ones are replaced, all other names are free.
    """
    new = ["size", "source_size", "target", "taken"]
    kept = [c for c in columns or docs.columns if c.lower() not in new]
    return _taken(docs, kept, how or Mix()).select(*(F.col("body")[c].alias(c) for c in kept), *new)


def mixed_documents(docs: DataFrame, how: Mix | None = None) -> DataFrame:
    """The mix as documents, with the columns of ``docs``, whatever their names: a document comes as often as the mix
    takes it, the one that a budget cuts through if at least half of it is taken. Documents without words, which
    cost nothing, come once. Null sources, repeated rows and an empty table are as in ``mix``."""
    rows = _taken(docs, docs.columns, how or Mix())
    copies = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size"))).cast("int")
    rows = rows.select("body", copies.alias("copies")).where("copies > 0")
    rows = rows.select("body", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(*(F.col("body")[c].alias(c) for c in docs.columns))
