"""Mixing sources to target weights as a time-varying curriculum; DataFrame functions only.

Each source has a weight and a schedule of its rate over training time 0..1. Its share of the words is the weight times the
schedule's integral; a target stops at `max_epochs` times the source's size and the excess is reshared by weight (water level,
in closed form). A source's documents form a stream in keyed-hash order, repeated for further epochs; a document's offset in
that stream, divided by the target, is its share of the cumulative demand, which the inverted integral turns into a training
position. `training_order` range-sorts the placements by position.

A stream offset is the sum of two parts: the sizes of the earlier hash buckets of the source (4096 of them) and a running sum
within the bucket, so that no task sees more than 1/4096 of a hot source.

Defined cases: a null text or one without words has size 0 and is never taken; a null source is a source of its own, the
last; sources without words have target 0; an empty table gives an empty result. Rows with equal keys are ordered by size and
are otherwise interchangeable. The last document of a stream may be taken in part: `taken` counts the words of its beginning.
Output columns replace input columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, n_words

Schedule = tuple[tuple[float, float], ...]


@dataclass(frozen=True)
class MixConfig:
    """weights and schedules are dealt to the sources in code-point order, repeating. A schedule: (time, rate) knots from 0 to 1.
    broadcast_rows: most buckets, of all sources, that a broadcast holds; beyond it their join is a shuffle."""

    weights: tuple[int, ...] = (1, 2, 3)
    schedules: tuple[Schedule, ...] = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)))
    max_epochs: int = 3
    key: str = "mix-1"
    broadcast_rows: int = 500_000


def area(schedule: Schedule) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:]))


def inverse(schedule: Schedule, share: Column) -> Column:
    """Training time at which the schedule's integral reaches `share` (0..1) of its total."""
    need, done, out = share * F.lit(area(schedule)), 0.0, None
    for (t0, r0), (t1, r1) in zip(schedule, schedule[1:]):
        part, slope = (t1 - t0) * (r0 + r1) / 2, (r1 - r0) / (t1 - t0)
        u = need - F.lit(done)
        t = F.lit(t0) + (u / F.lit(r0) if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), F.lit(r0 * r0) + F.lit(2 * slope) * u)) - F.lit(r0)) / F.lit(slope))
        done += part
        out = F.when(need < F.lit(done), t) if out is None else out.when(need < F.lit(done), t)
    return F.least(F.lit(1.0), out.otherwise(F.lit(schedule[-1][0])))


def source_targets(totals: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """source, source_size, rank, target from (source, source_size). One row per source."""
    per = F.create_map(*[x for i, w in enumerate(cfg.weights) for x in (F.lit(i), F.lit(float(w)))])
    bent = F.create_map(*[x for i, s in enumerate(cfg.schedules) for x in (F.lit(i), F.lit(area(s)))])
    one = W.orderBy(F.col("source").asc_nulls_last())
    rows = totals.withColumn("rank", F.row_number().over(one) - 1)
    rows = rows.withColumn("w", per[F.col("rank") % len(cfg.weights)] * bent[F.col("rank") % len(cfg.schedules)])
    cap = F.lit(cfg.max_epochs) * F.col("source_size")
    rows = rows.withColumn("cap", cap)
    all_ = W.partitionBy()
    before = W.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({
        "left": F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "w_left": F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
    })
    rows = rows.withColumn("full", F.col("left") * F.col("w") >= F.col("cap") * F.col("w_left"))
    level = F.max(F.when(~F.col("full"), F.struct(F.col("w_left"), (F.col("left") / F.col("w_left")).alias("level")))).over(all_)["level"]
    return rows.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level * F.col("w"))).select("source", "source_size", "rank", "target")


def mix(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", cfg: MixConfig = MixConfig(), carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, position (of its first placement, null if none) and
    placements array<struct<copy, position, words>>; with `carry` the whole input row stands in the struct `row`."""
    digest = F.md5(F.concat(F.lit(cfg.key + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    cols = [F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text).cast("string")).alias("size"), digest.alias("__key")]
    if carry:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    rows = df.select(*cols).withColumn("__bucket", F.conv(F.substring("__key", 1, 3), 16, 10).cast("int"))
    if not carry:
        rows = cut(rows)
    buckets = cut(rows.groupBy("source", "__bucket").agg(F.sum("size").alias("words")))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), cfg)
    ahead = W.partitionBy("source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = buckets.withColumn("__ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words").alias("b").join(targets.alias("t"), F.expr("b.source <=> t.source")).select("b.source", "__bucket", "__ahead", "source_size", "rank", "target")
    within = W.partitionBy("source", "__bucket").orderBy("__key", "size").rowsBetween(W.unboundedPreceding, -1)
    named = starts.withColumnsRenamed({"source": "__source", "__bucket": "__b"})
    if buckets.count() <= cfg.broadcast_rows:
        named = F.broadcast(named)
    rows = rows.withColumn("__within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(named, (F.coalesce(rows["source"], F.lit("")) == F.coalesce(named["__source"], F.lit(""))) & (rows["source"].isNull() == named["__source"].isNull()) & (rows["__bucket"] == named["__b"]))
    begin, want = F.col("__ahead") + F.col("__within"), F.floor("target")

    def place(copy: Column) -> Column:
        at = copy * F.col("source_size") + begin
        share = at / F.greatest(want, F.lit(1)).cast("double")
        pos = None
        for i, s in enumerate(cfg.schedules):
            here = F.col("rank") % len(cfg.schedules) == i
            pos = F.when(here, inverse(s, share)) if pos is None else pos.when(here, inverse(s, share))
        return F.struct(copy.alias("copy"), pos.alias("position"), F.greatest(F.lit(0), F.least(F.col("size"), want - at)).cast("long").alias("words"))

    copies = F.filter(F.array(*[place(F.lit(c)) for c in range(cfg.max_epochs)]), lambda p: p["words"] > 0)
    rows = rows.withColumn("placements", copies)
    out = ["doc_id", "size", "source_size", "target", F.aggregate("placements", F.lit(0).cast("long"), lambda s, p: s + p["words"]).alias("taken"), F.get("placements", F.lit(0))["position"].alias("position"), "placements"]
    return rows.select(*out, *(["row"] if carry else []))


def training_order(mixed: DataFrame, *keep: str) -> DataFrame:
    """One row per placement, range-sorted by position (then key): copy, position, words and the columns of `keep`."""
    rows = mixed.select(*keep, F.explode("placements").alias("p")).select(*keep, "p.copy", "p.position", "p.words")
    return rows.repartitionByRange("position", "copy").sortWithinPartitions("position", "copy")
