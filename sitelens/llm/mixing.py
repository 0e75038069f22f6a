"""Mixing sources to target weights by Pfair scheduling (operator 4, DataFrame functions only).

Rows of a source form blocks of ``BLOCK_ROWS`` in a shuffled order (by the MD5 of the id).  Integer
weights a_s that sum to ``period`` give block j (from 0) of source s the release floor(j * period / a_s)
and the deadline ceil((j + 1) * period / a_s); each slot takes, of the released blocks, the one with the
earliest deadline.  The weights sum to one block a slot, so every block meets its window and after any
slot each source is less than one block away from a_s / period.  The schedule repeats after ``period``
slots: one period is simulated, and block b of s lies in slot (b div a_s) * period + slot of its
(b mod a_s)-th block.  As a_s / period is a rounded share, the distance from the target weight itself
grows with the rows.  A source that has run out leaves its slots empty: the others go on in the same
proportions and no row is dropped or repeated.

With ``exact`` the windows are those of the target weights (in units of 2**-52) and the whole run is
simulated, so after any slot each source is less than one block away from its target weight.  That is
done in one task: slots (blocks of a source over its weight, at most) times sources.

Defined cases: a null source is a source of its own (named ``null_source`` in weights, default weight
as any other); sources missing from given weights get weight 0 and come after the mix in blocks dealt
evenly; ties between equal ids are broken by the text, exact repeated rows keep one place each;
null ids come first within their source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 8
#: Slots of one period; at least twice the number of sources.
PERIOD = 400
NULL_SOURCE = "null_source"
#: Rows of a source are numbered in 16**BUCKET_DIGITS independent parts, so that one hot source has many tasks.
BUCKET_DIGITS = 3
#: Slots of sources without a weight start here.
AFTER_MIX = 1 << 40
#: Exact weights are integers that sum to this; chunks of slots are simulated one after the other.
SCALE = 1 << 52
CHUNK = 512
MIX_COLUMNS = ("mix_source", "mix_block", "mix_slot", "mix_position")


def integer_weights(targets: DataFrame, period: Column) -> DataFrame:
    """(source, weight) -> (source, a): integers summing to ``period``, at least 1 each, by largest remainder."""
    everything = Window.partitionBy(F.lit(0))  # one row a source
    shares = targets.filter(F.col("weight") > 0).withColumn("quota", (period - F.count("*").over(everything)) * F.col("weight") / F.sum("weight").over(everything))
    shares = shares.withColumn("left", period - F.count("*").over(everything) - F.sum(F.floor("quota")).over(everything))
    rank = F.row_number().over(everything.orderBy(F.desc(F.col("quota") - F.floor("quota")), "source"))
    return shares.select("source", (1 + F.floor("quota") + (rank <= F.col("left")).cast("int")).cast("int").alias("a"))


def schedule(weights: DataFrame) -> DataFrame:
    """(source, j, slot, a, period): earliest-deadline-first over one period of slots."""
    one = weights.agg(F.sort_array(F.collect_list(F.struct("source", "a"))).alias("s"), F.sum("a").cast("int").alias("period"))
    done = F.transform("s", lambda x: F.lit(0))
    late = F.lit(2147483647)

    def take(acc: Column, t: Column) -> Column:
        deadline = F.transform(F.arrays_zip(F.col("s"), acc["done"]), lambda x: F.when(
            F.floor(x["done"] * F.col("period") / x["s"]["a"]) <= t, F.ceil((x["done"] + 1) * F.col("period") / x["s"]["a"]).cast("int")).otherwise(late))
        return F.struct(acc["done"].alias("done"), F.array_position(deadline, F.array_min(deadline)).cast("int").alias("at"), acc["out"].alias("out"))

    def put(acc: Column) -> Column:
        return F.struct(F.transform(acc["done"], lambda d, i: d + (i + 1 == acc["at"]).cast("int")).alias("done"), F.lit(0).alias("at"),
                        F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    start = F.struct(done.alias("done"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    order = F.aggregate(F.sequence(F.lit(0), F.col("period") - 1), start, lambda acc, t: put(take(acc, t)), lambda acc: acc["out"])
    slots = one.select("s", "period", F.posexplode(order).alias("slot", "at")).select(F.element_at("s", F.col("at")).alias("x"), "slot", "period")
    nth = F.row_number().over(Window.partitionBy("x.source").orderBy("slot")) - 1
    return slots.select(F.col("x.source").alias("source"), nth.alias("j"), "slot", F.col("x.a").alias("a"), "period")


def _bound(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def exact_weights(targets: DataFrame) -> DataFrame:
    """(source, weight, blocks) -> one row (s: sources in order, w: integers that sum to SCALE, chunks: of slots until all blocks are placed)."""
    one = targets.filter(F.col("weight") > 0).agg(F.sort_array(F.collect_list(F.struct("source", "weight", "blocks"))).alias("s")).filter(F.size("s") > 0)
    one = one.withColumn("total", F.aggregate("s", F.lit(0.0), lambda a, x: a + x["weight"]))
    one = one.withColumn("w", F.transform("s", lambda x: F.greatest(F.lit(1).cast("long"), F.floor(x["weight"] / F.col("total") * SCALE).cast("long"))))
    rest = F.lit(SCALE) - F.aggregate("w", F.lit(0).cast("long"), lambda a, v: a + v)
    one = one.withColumn("rest", rest).withColumn("top", F.array_position("w", F.array_max("w")))
    one = one.withColumn("w", F.transform("w", lambda v, i: v + F.when(i + 1 == F.col("top"), F.col("rest")).otherwise(F.lit(0).cast("long"))))
    last = F.array_max(F.zip_with("s", "w", lambda x, v: F.ceil(x["blocks"] * (F.lit(float(SCALE)) / v))))
    return one.select(F.transform("s", lambda x: x["source"]).alias("s"), "w", (F.floor(last / CHUNK) + 1).cast("int").alias("chunks"))


def exact_schedule(targets: DataFrame) -> DataFrame:
    """(source, weight, blocks) -> (source, j, slot): earliest-deadline-first over the whole run.

    lag = slots * weight - SCALE * blocks done stays within one block, so no number grows with the run: the
    next block is released if lag + weight > 0, and its deadline is ceil((SCALE - lag) / weight) slots away.
    """
    def step(state: Column, t: Column) -> Column:
        due = F.zip_with(state["lag"], state["w"], lambda lag, v: F.when(lag + v > 0, F.call_function("div", F.lit(SCALE) - lag + v - 1, v)).otherwise(F.lit((1 << 63) - 1)))
        first = _bound(due, lambda d: F.array_position(d, F.array_min(d)).cast("int"))
        return _bound(first, lambda at: F.struct(
            F.transform(state["lag"], lambda lag, i: lag + F.get(state["w"], i) - F.when(i + 1 == at, F.lit(SCALE)).otherwise(F.lit(0).cast("long"))).alias("lag"),
            state["w"].alias("w"), F.concat(state["out"], F.array(at)).alias("out")))

    def chunk(state: Column, c: Column) -> Column:
        start = F.struct(state["lag"].alias("lag"), state["w"].alias("w"), F.array().cast("array<int>").alias("out"))
        return _bound(F.aggregate(F.sequence(F.lit(1), F.lit(CHUNK)), start, step), lambda x: F.struct(
            x["lag"].alias("lag"), x["w"].alias("w"), F.concat(state["out"], F.array(x["out"])).alias("out")))

    begin = F.struct(F.transform("w", lambda v: F.lit(0).cast("long")).alias("lag"), F.col("w"), F.array().cast("array<array<int>>").alias("out"))
    order = F.aggregate(F.sequence(F.lit(1), F.col("chunks")), begin, chunk, lambda state: state["out"])
    chunks = exact_weights(targets).select("s", F.posexplode(order).alias("chunk", "picks"))
    mine = chunks.select("chunk", "picks", F.posexplode("s").alias("i", "source")).select("chunk", "source", F.filter(
        F.transform("picks", lambda at, k: F.when(at == F.col("i") + 1, k)), lambda k: k.isNotNull()).alias("ks"))
    done = F.sum(F.size("ks")).over(Window.partitionBy("source").orderBy("chunk")) - F.size("ks")
    placed = mine.withColumn("done", done).select("source", "chunk", "done", F.posexplode("ks").alias("nth", "k"))
    return placed.select("source", (F.col("done") + F.col("nth")).alias("j"), (F.col("chunk").cast("long") * CHUNK + F.col("k")).alias("slot"))


def _keys(id_col: str, source_col: str) -> list[Column]:
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return [F.coalesce(F.col(source_col), F.lit(NULL_SOURCE)).alias("mix_source"), F.substring(digest, 1, BUCKET_DIGITS).alias("mix_bucket"), digest.alias("mix_hash")]


def _slot_of_period() -> Column:
    of_period = F.element_at("slots", F.pmod(F.col("mix_block"), F.col("a").cast("long")).cast("int") + 1)
    return F.when(F.col("a").isNotNull(), F.floor(F.col("mix_block") / F.col("a")) * F.col("period") + of_period).cast("long")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source",
        text_col: str | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD, exact: bool = False) -> DataFrame:
    """docs (less columns of these names) plus mix_source, mix_block (in its source), mix_slot and mix_position (order by it to read the mix).

    ``weights``: target weight by source; default: each source weighs the square root of its rows.
    ``exact``: schedule by the target weights themselves, not by integers of ``period`` slots.
    """
    counts = docs.select(*_keys(id_col, source_col)[:2]).groupBy("mix_source", "mix_bucket").agg(F.count("*").alias("n"))
    sizes = counts.groupBy(F.col("mix_source").alias("source")).agg(F.sum("n").alias("n"))
    if weights is None:
        targets = sizes.select("source", "n", F.sqrt("n").alias("weight"))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.create_map().cast("map<string,double>")
        targets = sizes.select("source", "n", F.coalesce(F.element_at(given, F.col("source")), F.lit(0.0)).alias("weight"))
    # a source's slots go to each of its parts, so rows join by part: no task gets a whole source
    before = counts.withColumn("mix_before", F.sum("n").over(Window.partitionBy("mix_source").orderBy("mix_bucket")) - F.col("n"))
    if exact:
        dealt = exact_schedule(targets.select("source", "weight", F.ceil(F.col("n") / block_rows).alias("blocks"))).withColumnRenamed("source", "mix_source")
        span = F.sequence(F.floor(F.col("mix_before") / block_rows), F.floor((F.col("mix_before") + F.col("n") - 1) / block_rows))
        held = before.select("mix_source", "mix_bucket", F.explode(span).alias("j")).join(dealt, ["mix_source", "j"])
        held = held.groupBy("mix_source", "mix_bucket").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "slot"))), lambda x: x["slot"]).alias("slots"))
        parts = before.drop("n").join(held, ["mix_source", "mix_bucket"], "left")
    else:
        counted = F.count("*").over(Window.partitionBy(F.lit(0)))
        slots_of = targets.drop("n").withColumn("period", F.greatest(F.lit(period), 2 * counted).cast("int"))
        plan = schedule(integer_weights(slots_of, F.col("period")))
        dealt = plan.groupBy("source", "a", "period").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "slot"))), lambda x: x["slot"]).alias("slots"))
        parts = before.drop("n").join(dealt.withColumnRenamed("source", "mix_source"), "mix_source", "left")
    own = docs.drop(*MIX_COLUMNS)
    ties = [F.col("mix_hash"), F.col("mix_tie")]
    nth = F.row_number().over(Window.partitionBy("mix_source", "mix_bucket").orderBy(*ties)) - 1
    tie = F.struct(F.col(id_col), *([F.col(text_col)] if text_col else [])).alias("mix_tie")
    rows = docs.select(F.struct(*[own[c] for c in own.columns]).alias("mix_own"), tie, *_keys(id_col, source_col))
    rows = rows.withColumn("mix_nth", nth).drop("mix_tie", "mix_hash").join(parts, ["mix_source", "mix_bucket"])
    row = F.col("mix_before") + F.col("mix_nth")
    rows = rows.withColumn("mix_block", F.floor(row / block_rows).cast("long"))
    if exact:
        slot = F.element_at("slots", (F.col("mix_block") - F.floor(F.col("mix_before") / block_rows) + 1).cast("int"))
    else:
        slot = _slot_of_period()
    out = rows.withColumn("mix_slot", F.coalesce(slot, F.lit(AFTER_MIX) + F.col("mix_block")))
    place = F.col("mix_slot") * block_rows + F.pmod(row, F.lit(block_rows))
    return out.withColumn("mix_position", place).select("mix_own.*", *MIX_COLUMNS)
