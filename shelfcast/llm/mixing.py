"""Mixing sources to target weights: hash-random order, distributed prefix sums, an exact cut.

1. A document's size is its number of words (runs of anything but space, tab, line feed, vertical tab, form feed and
   return). Sources in code point order, null last, get ``weights`` in turn and share ``share`` times all sizes. A
   target stops at ``most`` times its source's size; what is beyond is shared again by weight until none is above.
   With the sources ordered by ``size / weight`` those that stop come first, so one running sum settles all of them.
2. A document's key is the md5 of seed, id and text. Every source is range-sorted by key: it has as many
   even key ranges as its rows need (``rows_per_range``), so a source that holds most rows is spread like many small ones. Sums of the
   ranges, added up, give each range its start; a running sum within the range gives each document the words before it.
3. A source of ``size`` words is taken whole as often as it fits into its target, rounded to whole words, and once
   more up to the exact word: a document counts with as many of its first words as still fit.

Equal rows (same source, id, text) are one row with a count until the very end, so repeated rows can't
make a range large; the rows taken of them are the first ones.

Defined results: null texts and texts without words have size 0 and take 0; null ids take part; null sources are a
source of their own; equal keys are ordered by id (nulls first), then size; an empty table gives an empty one. The result
depends on rows and seed only, not on how they are laid out. Only the named columns are read, so
other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
#: Documents of a key range, on average.
ROWS_PER_RANGE = 2_000
#: Equal rows that are written out together.
COPIES_PER_BLOCK = 10_000
#: Blank characters between words: fixed values.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words, without a list of them: each word and the blanks after it become one letter."""
    marks = F.regexp_replace(F.ltrim(text, F.lit(BLANKS)), WORD + r"[\x20\x09-\x0D]*", "x")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def document_key(doc_id: Column, text: Column, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string"), text).cast("binary"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (source, source_size) with ``target``, one row per source."""
    names = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rank = F.row_number().over(names) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    # The least capacity for its weight fills first; each row sees what is left once all before it are full.
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    steps = (
        sources.select("source", "source_size", rank.alias("rank"), weight.alias("weight"), cap.alias("cap"))
        .withColumns({"left": left, "open_weight": open_weight})
        .withColumn("full", F.col("weight") * F.col("left") >= F.col("cap") * F.col("open_weight"))
    )
    first_open = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "rank", "left", "open_weight"))).over(whole)
    level = steps.withColumn("_open", first_open)
    shared = F.col("weight") * F.col("_open.left") / F.col("_open.open_weight")
    return level.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(shared).alias("target"))


def mixture(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """One row per different row: key, doc_id, source, size, copies, source_size, target, rounds, part.

    The mix takes every copy ``rounds`` times, and ``part`` words more of the copies together: as many
    whole ones as fit and the beginning of the next.
    """
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    rows = docs.select(
        doc_id.alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text).alias("size"),
        document_key(doc_id, text, seed).alias("key"),
    )
    different = stored(rows.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("copies")), "mix-rows")
    sums = different.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n"))
    sums = stored(sums, "mix-sources")
    plan = targets(sums, weights, share, most).withColumnsRenamed({"source": "of"})
    plan = plan.join(sums.select(F.col("source").alias("of2"), "n"), F.col("of").eqNullSafe(F.col("of2"))).drop("of2")
    plan = stored(
        plan.withColumn("whole", F.floor(F.col("target") + 0.5))
        .withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("whole") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("whole") - F.col("rounds") * F.col("source_size"))
        .withColumn("ranges", F.ceil(F.col("n") / rows_per_range).cast("long")),
        "mix-plan",
    )
    # The first 32 bits of the key, scaled to the source's number of ranges: ranges of keys in order.
    at = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(float(1 << 32)))
    dealt = different.join(plan, different["source"].eqNullSafe(plan["of"])).drop("of").withColumn("range", at.cast("long"))
    words = F.col("size") * F.col("copies")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    dealt = stored(dealt.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0))), "mix-ranges")
    ranges = dealt.groupBy("source", "range").agg(F.sum(words).alias("in_range"))
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(F.col("source").alias("of"), F.col("range").alias("at"), F.coalesce(F.sum("in_range").over(along), F.lit(0)).alias("start"))
    starts = stored(starts, "mix-starts")
    placed = dealt.join(starts, (F.col("range") == F.col("at")) & F.col("source").eqNullSafe(F.col("of")))
    part = F.greatest(F.lit(0), F.least(words, F.col("rest") - F.col("start") - F.col("inside")))
    return placed.select("key", "doc_id", "source", "size", "copies", "source_size", "target", "rounds", part.cast("long").alias("part"))


def documents_taken(plan: DataFrame) -> DataFrame:
    """One row per document row: doc_id, size, source_size, target, taken (words of all its repeats)."""
    one = plan.where("copies = 1")
    more = plan.where("copies > 1")
    columns = ["doc_id", "size", "source_size", "target", "rounds", "part"]
    # Many copies are written out in blocks, by as many tasks as there are blocks for.
    blocks = more.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES_PER_BLOCK).cast("long"))))
    blocks = blocks.repartition("key", "block")
    last = F.least(F.col("copies"), F.col("block") + COPIES_PER_BLOCK) - 1
    each = blocks.withColumn("copy", F.explode(F.sequence(F.col("block"), last)))
    own = F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.col("copy") * F.col("size")))
    rows = one.select(columns).unionByName(each.withColumn("part", own.cast("long")).select(columns))
    taken = F.col("rounds") * F.col("size") + F.col("part")
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, plan: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself, one row per text that is taken: doc_id, source, words, text.

    A text that is cut keeps its first words, joined by one blank; whole texts are unchanged. Texts of
    no words aren't taken.
    """
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    texts = docs.select(document_key(doc_id, text, seed).alias("key"), doc_id.alias("doc_id"), text.alias("text"))
    whole = texts.join(plan.where("size > 0").drop("doc_id"), "key")
    # All copies of a row are whole in each full round; of the last one, counted over the copies, some are.
    again = whole.where("rounds > 0").withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rounds"))))
    again = again.select("doc_id", "source", F.col("size").alias("words"), "text")
    last = plan.where("part > 0").withColumn("full", F.floor(F.col("part") / F.col("size")))
    last = last.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("part") - 1) / F.col("size")), F.lit(COPIES_PER_BLOCK).cast("long"))))
    last = last.repartition("key", "block").withColumn(
        "copy", F.explode(F.sequence(F.col("block"), F.least(F.col("block") + COPIES_PER_BLOCK - 1, F.floor((F.col("part") - 1) / F.col("size")))))
    )
    last = last.select("key", "source", "size", F.least(F.col("size"), F.col("part") - F.col("copy") * F.col("size")).alias("words"))
    first = texts.join(plan.where("part > 0").select("key"), "key", "left_semi").dropDuplicates(["key"])
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("(" + WORD + ")"), 1), F.lit(1), F.col("words").cast("int")), " ")
    cut = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(head)
    return again.unionByName(last.join(first, "key").select("doc_id", "source", "words", cut.alias("text")))
