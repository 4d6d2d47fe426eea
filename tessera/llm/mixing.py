"""Mixing sources to target weights with a low-discrepancy schedule.

* Targets: sources in code point order (null last) weigh the given cycle; together they
  take ``share`` of all sizes.  No target passes ``max_repeat`` times its source; the
  excess goes to the others by weight until none is above.
* Each source is one stream: its documents in the order of a hash, repeated as often as
  its target needs, cut into blocks of equal numbers of tokens (the last may be shorter).
* The schedule has one slot per block.  Slot t gets the point frac(t * g / n), with g the
  integer next to n / golden ratio that shares no factor with n: a golden-ratio lattice,
  which meets each of the n equal cells of [0, 1) exactly once.  The point is mapped through
  the cumulative weights (blocks per source) to its source.  So every source gets exactly
  its number of slots, spread evenly over the mix.
* Slots are ranked per source, and the r-th slot of a source takes its r-th block.

Nothing is ordered in one task and nothing but totals reaches the driver, however many
sources there are: places in a stream, ranks of slots and sums over sources are running sums
over range partitions (``sums_before_once``).  The slot of a cell is the cell times the
inverse of g, so a source's cells, which follow each other, give its slots directly.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ranking import number_rows_once, sums_before_once

from .common import cut, doc_id_of, key_id, key_text, written
from .quality import n_words_of

GOLDEN = (1 + 5 ** 0.5) / 2
_CELLS = 1 << 16                  # cells of a source that one row expands to


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_repeat: float) -> DataFrame:
    """sizes: (source, source_size), one row per source.  -> source, source_size, sid, weight,
    target; sid numbers the sources from 1.

    The repeated resharing ends at one level x with target = min(cap, weight * x): sources
    are capped in the order of cap / weight, so the first k are capped for the smallest k
    at which the next one's cap holds the rest."""
    t = sizes.withColumn("last", F.col("source").isNull())
    t = number_rows_once(t, ["last", "source"], out="sid")
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("sid") - 1) % n + 1).cast("int"))
    t = t.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    t = t.withColumn("at", F.col("cap") / F.col("weight"))
    t = written(sums_before_once(t, ["at", "sid"], {"cap_before": "cap", "weight_before": "weight"}), "sources")
    size, weight = t.agg(F.sum("source_size"), F.sum("weight")).head()
    total, weight = (size or 0) * float(share), weight or 1.0
    t = t.withColumn("level", (F.lit(float(total)) - F.col("cap_before")) / (F.lit(float(weight)) - F.col("weight_before")))
    # the level at the first source that stays below its cap; capped sources keep their cap
    free = t.filter(F.col("weight") * F.col("level") < F.col("cap")).agg(F.min(F.struct("at", "sid", "level")).alias("f")).head().f
    target = F.col("cap") if free is None else F.least(F.col("cap"), F.col("weight") * F.lit(free.level))
    return t.select("source", "source_size", "sid", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_repeat: float = 2.0,
        block_tokens: int = 2048, pieces: int | None = None, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """-> (documents, schedule).

    documents: one row per input row: id, th, size, source, source_size, target, taken, and
    n_slots, the slots of the mix that hold words of it, and first_slot, the first of them
    (null if none does).
    schedule: (slot, source, id, th, first_word, n_words): what each slot of the mix takes,
    in order of first position.

    Null text has size 0 and is never taken; null source is a source of its own, ranked
    last.  Repeated rows are documents of their own; they share the words that their common
    place gets, and its slots.  Texts of any length are counted whole; other columns are not
    read.  A corpus without words, or an empty table, gives targets of 0 and an empty schedule.
    ``pieces``: range partitions of the streams, by default the session's shuffle partitions.
    """
    size = n_words_of(F.coalesce(docs[text_col], F.lit(""))).cast("long")
    rows = docs.select(key_id(docs[id_col]).alias("id"), key_text(docs[id_col], docs[text_col]).alias("th"),
                       docs[source_col].alias("source"), size.alias("size"))
    # repeated rows are one row with a count here, so equal rows need no order
    rows = cut(rows.groupBy("id", "th", "source", "size").agg(F.count(F.lit(1)).alias("copies")))
    t = targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, share, max_repeat)
    # whole words are taken: the target rounded to a number of words
    t = t.withColumn("words", F.floor(F.col("target") + 0.5)).withColumn("n_blocks", F.ceil(F.col("words") / block_tokens).cast("long"))
    t = written(sums_before_once(t, ["sid"], {"first_cell": "n_blocks"}), "targets")
    n = t.agg(F.sum("n_blocks")).first()[0] or 0

    by_source = t.select(F.col("source").alias("t_source"), "sid", "source_size", "target", "words")
    d = rows.join(by_source, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    # a document's place in its stream: by hash of its keys
    own = F.when(F.col("id") == key_id(F.lit(None)), F.col("th"))       # nulls are skipped by concat_ws
    pick = F.sha2(F.concat_ws("|", F.lit(seed), F.col("id"), own), 256)
    d = d.withColumn("place", F.conv(F.substring(pick, 1, 15), 16, 10).cast("long")).withColumn(
        "span", F.col("size") * F.col("copies"))
    d = written(sums_before_once(d, ["place", "id", "th"], {"start": "span"}, group=["sid"], pieces=pieces), "places")

    # pieces: the stream goes round max_repeat times at most; a piece is a document's words in one block
    rounds = int(-(-max_repeat // 1))
    piece = (d.filter("span > 0")
             .withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
             .withColumn("lo", F.col("start") + F.col("round") * F.col("source_size"))
             .withColumn("hi", F.least(F.col("lo") + F.col("span"), F.col("words")))
             .filter("lo < hi")
             .withColumn("rank", F.explode(F.expr(f"sequence(lo div {block_tokens}, (hi - 1) div {block_tokens})")))
             .withColumn("from", F.greatest("lo", F.col("rank") * block_tokens))
             .withColumn("n_words", F.least("hi", (F.col("rank") + 1) * block_tokens) - F.col("from"))
             .select("sid", "rank", "id", "th", F.col("source").alias("piece_source"),
                     ((F.col("from") - F.col("lo")) % F.col("size")).alias("first_word"), "n_words"))
    placed = piece.join(schedule(t, n), ["sid", "rank"])
    taken = (placed.groupBy("id", "th", "sid", "slot").agg(F.sum("n_words").alias("n_words"))
             .groupBy("id", "th", "sid").agg(F.sum("n_words").alias("got"), F.count(F.lit(1)).alias("n_slots"),
                                             F.min("slot").alias("first_slot")))
    per = (d.join(taken, ["id", "th", "sid"], "left")
           .withColumn("got", F.coalesce("got", F.lit(0)))
           # equal rows share what their common place got, the first ones a word more
           .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
           .withColumn("taken", F.floor(F.col("got") / F.col("copies"))
                       + F.when(F.col("copy") <= F.col("got") % F.col("copies"), 1).otherwise(0)))
    documents = per.select("id", "th", "size", "source", "source_size", "target", F.col("taken").cast("long").alias("taken"),
                           F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"), "first_slot")
    return documents, placed.select("slot", F.col("piece_source").alias("source"), "id", "th", "first_word", "n_words")


def multiplier(n: int) -> int:
    """The integer next to n / golden ratio that shares no factor with n."""
    g = max(1, round(n / GOLDEN))
    while gcd(g, n) != 1:
        g += 1
    return g


def schedule(t: DataFrame, n: int) -> DataFrame:
    """(sid, rank, slot) for the n slots; t: (sid, first_cell, n_blocks).

    Slot s has cell s * g mod n, and a source owns n_blocks cells from first_cell on."""
    if n == 0:
        return t.sparkSession.createDataFrame([], "sid long, rank long, slot long")
    back = pow(multiplier(n), -1, n) if n > 1 else 0
    parts = t.filter("n_blocks > 0").select("sid", "first_cell", "n_blocks", F.expr(
        f"explode(CASE WHEN n_blocks > 0 THEN sequence(0L, (n_blocks - 1) div {_CELLS}) END)").alias("part"))
    cells = parts.repartition("sid", "part").select("sid", "first_cell", F.expr(
        f"explode(sequence(part * {_CELLS}, least(n_blocks, (part + 1) * {_CELLS}) - 1))").alias("own"))
    cells = cells.select("sid", (F.col("first_cell") + F.col("own")).alias("cell"))
    wide = "decimal(38,0)"                 # the product may pass 2^63
    slot = ((F.col("cell").cast("decimal(18,0)") * F.lit(back).cast("decimal(18,0)")).cast(wide) % F.lit(n).cast(wide)).cast("long")
    slots = cells.select("sid", slot.alias("slot"))
    return number_rows_once(slots, ["slot"], group=["sid"], out="_n").select("sid", (F.col("_n") - 1).alias("rank"), "slot")


def with_doc_id(documents: DataFrame) -> DataFrame:
    return documents.select(doc_id_of(F.col("id")).alias("doc_id"), "size", "source_size", "target", "taken", "n_slots", "first_slot")
