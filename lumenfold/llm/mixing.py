"""Mixing sources to target weights with a time-varying curriculum.

**Targets.** Sources, by code point and null last, have weights 5, 2, 1, repeating, and share the size of
the whole corpus; a target stops at ``CAP`` = 3 times its source's size and the excess is shared again by
weight. That is water filling: with sources in order of cap / weight, those up to some place are at their
caps and the rest get one level times their weights, so running sums over the (short) table of sources give it.

**Demand.** A source's documents lie end to end in the order of a hash of the id (of the text, if it has none), over and over; training takes
the first ``target`` words. A document's offset there is the size of the hash bins before its own, plus
those before it within the bin: two short running sums, so a source with a third of all rows is spread
over thousands of bins.

**Positions.** A source's weight moves in a straight line over training time t from (1 - drift) to (1 + drift) times its
mean; drift is +``DRIFT`` for the even sources and -``DRIFT`` for the odd ones. The weight integrated to t is the share of the
source's target taken by then, t (1 - drift) + t^2 drift; inverting it turns an offset's share into a
training position. ``curriculum`` range-sorts by position.

All is DataFrame functions. Defined cases: null texts have size 0 and are taken 0 words; a source of size 0
has target 0; a null source is a source of its own; repeated rows are separate documents with equal hashes,
placed side by side; columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.llm.sparkkit import cut

WEIGHTS = (5, 2, 1)
CAP = 3
DRIFT = 0.5
#: Leading hex digits of the order that make a bin: 16^3 bins for each source.
BIN_DIGITS = 3

_WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target, turn) of a table (source, source_size); one row for each source throughout."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    table = sizes.withColumn("turn", F.row_number().over(order) - 1)
    table = table.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("turn") % len(weights) + 1).cast("int")))
    table = table.withColumn("cap", F.col("source_size") * float(cap))
    filling = W.orderBy(F.col("cap") / F.col("w"), F.col("turn"))
    table = table.withColumns(
        {
            "before": F.coalesce(F.sum("cap").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
            "rest": F.sum("w").over(filling.rowsBetween(0, W.unboundedFollowing)),
            "all": F.sum("source_size").over(W.partitionBy()),
        }
    )
    # the level if this source and all after it aren't at their caps; the first that fits its cap sets it
    table = table.withColumn("level", (F.col("all") - F.col("before")) / F.col("rest"))
    table = table.withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    level = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), "turn", "level"))).over(W.partitionBy())
    table = table.withColumn("level", level["level"])
    target = F.coalesce(F.least("cap", F.col("level") * F.col("w")), "cap")
    return table.select("source", "source_size", F.round(target, 6).alias("target"), "turn")


def _offsets(docs: DataFrame) -> DataFrame:
    """docs (source, order, bin, size) with ``at``: the words of the source before the document."""
    in_bin = docs.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    before = F.coalesce(F.sum("bin_size").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begin = in_bin.select(F.col("source").alias("s"), F.col("bin").alias("b"), before.alias("begin"))
    within = W.partitionBy("source", "bin").orderBy("order", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, -1)
    docs = docs.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return docs.join(begin, docs.source.eqNullSafe(begin.s) & (docs.bin == begin.b)).withColumn("at", F.col("begin") + F.col("inner")).drop("s", "b", "begin", "inner")


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, drift: float = DRIFT, bin_digits: int = BIN_DIGITS) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, passes (words taken and training position in [0, 1] of each pass over the source)."""
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    docs = documents.select("doc_id", "source", size_of().alias("size"), order.alias("order"))
    docs = cut(docs.withColumn("bin", F.substring("order", 1, bin_digits)))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, cap).select(F.col("source").alias("s"), "source_size", "target", "turn")
    placed = _offsets(docs)
    placed = placed.join(F.broadcast(goal) if goal.count() <= 100_000 else goal, placed.source.eqNullSafe(goal.s)).drop("s")
    slope = F.when(F.col("turn") % 2 == 0, F.lit(float(drift))).otherwise(F.lit(-float(drift)))

    def taken_of(k: Column) -> Column:
        left = F.floor(F.col("target")) - (k * F.col("source_size") + F.col("at"))
        return F.greatest(F.lit(0), F.least("size", left)).cast("long")

    def position(k: Column) -> Column:
        share = (k * F.col("source_size") + F.col("at")) / F.greatest("target", F.lit(1.0))
        share = F.least(F.lit(1.0), share)
        # t (1 - d) + t^2 d = share
        root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
        return share if drift == 0 else (root - (1 - slope)) / (2 * slope)

    passes = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda k: F.struct(taken_of(k).alias("taken"), position(k).alias("position")))
    passes = F.filter(passes, lambda p: p["taken"] > 0)
    return placed.select("doc_id", "source", "size", "source_size", "target", passes.alias("passes"))


def taken() -> Column:
    return F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["taken"])


def curriculum(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """The training order: one row for each pass of each document, range-sorted by position."""
    rows = mixed.select("doc_id", "source", F.explode("passes").alias("p")).select("doc_id", "source", "p.taken", "p.position")
    by = [F.col("position"), F.col("doc_id").asc_nulls_last()]
    dealt = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    return dealt.sortWithinPartitions(*by)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    first = F.round(F.element_at(F.col("passes.position"), 1), 6)
    out = mixed.select("doc_id", "size", "source_size", "target", taken().alias("taken"), F.when(F.size("passes") > 0, first).alias("position"))
    by = [F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last()]
    return out.repartitionByRange(*by).sortWithinPartitions(*by)


# Water filling by one level at a time would need recursion; as in targets(), running sums give the level.
OP6_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(coalesce(doc_id::varchar, md5(coalesce(text, '')))) as ord
  from documents),
s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as turn from d group by source),
w as (select *, [5.0, 2.0, 1.0][(turn % 3 + 1)::int]::double as w, source_size * 3.0::double as cap from s),
f as (
  select *, coalesce(sum(cap) over (order by cap / w, turn rows between unbounded preceding and 1 preceding), 0) as before,
         sum(w) over (order by cap / w, turn rows between current row and unbounded following) as rest,
         sum(source_size) over () as total
  from w),
l as (select *, (total - before) / rest as level from f),
g as (select arg_min(level, cap / w * 1e6 + turn) as level from l where level * w <= cap),
t as (
  select l.source, l.source_size, l.turn, round(coalesce(least(l.cap, g.level * l.w), l.cap), 6)::double as target from l cross join g),
o as (
  select d.doc_id, d.size, t.source_size, t.target, t.turn,
         coalesce(sum(d.size) over (partition by d.source order by d.ord, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as off
  from d join t on d.source is not distinct from t.source),
k as (
  select *, greatest(0, least(size, floor(target) - off))::bigint as t0, greatest(0, least(size, floor(target) - source_size - off))::bigint as t1,
         greatest(0, least(size, floor(target) - 2 * source_size - off))::bigint as t2,
         case when turn % 2 = 0 then 0.5 else -0.5 end::double as slope from o),
p as (select *, t0 + t1 + t2 as taken, case when t0 > 0 then 0 when t1 > 0 then 1 else 2 end as first from k)
select doc_id, size, source_size, target, taken::bigint as taken,
       case when taken > 0 then round((sqrt((1 - slope) * (1 - slope) + 4 * slope * least(1.0::double, (first * source_size + off) / greatest(target, 1.0::double))) - (1 - slope)) / (2 * slope), 6) end::double as position
from p
"""
