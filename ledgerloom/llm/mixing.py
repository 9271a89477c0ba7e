"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1. Its integral,
scaled to the source's tokens, is the cumulative token demand; a document that
starts at some token of its source's line gets the time at which the demand
reaches that token, and the documents of all sources are range-sorted by time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, small
from .tokenizer import corpus_sizes

#: Hash buckets of a source's line. Sums within a bucket are taken by one task, sums over buckets by another,
#: so neither grows to a whole source.
BUCKETS = 4096
#: Knots (time, weight) of a source without a schedule of its own: always its target share.
EVEN = [(0.0, 1.0), (1.0, 1.0)]


def segments(knots: list[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """Pieces (c0, c1, t0, w0, slope) of a piecewise linear schedule; c is its integral up to the piece, 1 at the end."""
    knots = sorted((float(t), float(w)) for t, w in knots)
    if len(knots) < 2 or knots[0][0] != 0.0 or knots[-1][0] != 1.0 or any(w < 0 for _, w in knots):
        raise ValueError("a schedule needs knots from time 0 to 1 with weights of 0 or more")
    total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    if total <= 0:
        raise ValueError("a schedule needs a positive integral")
    out, c = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area = (t1 - t0) * (w0 + w1) / 2 / total
        if area > 0:
            out.append((c, c + area, t0, w0 / total, (w1 - w0) / (t1 - t0) / total))
            c += area
    c0, _, *rest = out[-1]
    out[-1] = (c0, 1.0, *rest)
    return out


def plan_mixture(sizes: DataFrame, targets: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Lines of documents by source and the plan of each source.

    ``sizes``: doc_id, source, n_tokens (null: no text, never drawn). ``targets``: source,
    target_share, max_repeats. The target total is the sum of n_tokens over all rows.
    Returns (documents with their first token ``at`` on the line of their source, sources with
    ``supply``, ``demand``, ``full`` passes, ``rest`` tokens of a last part pass).
    """
    s = sizes.where("n_tokens is not null")
    total = s.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total_tokens"))
    targets = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("source is not null")
    targets = small(cut(targets))  # a row a source: a hot source isn't shuffled to one task
    h = F.xxhash64(F.col("doc_id"), F.lit(seed))
    listed = s.join(targets.select("source"), "source", "left_semi").withColumns({"h": h, "bucket": F.shiftrightunsigned(h, 52).cast("int")})
    buckets = listed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("in_bucket"), F.count("*").alias("docs_in_bucket"))
    line = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(line), F.lit(0)).alias("bucket_at"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    docs = (
        listed.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(starts, ["source", "bucket"])
        .select("doc_id", "source", "n_tokens", (F.col("bucket_at") + F.col("before")).alias("at"))
    )
    supply = buckets.groupBy("source").agg(F.sum("in_bucket").alias("supply"), F.sum("docs_in_bucket").alias("documents"))
    repeats = F.greatest(F.col("max_repeats"), F.lit(0))
    plan = (
        targets.join(supply, "source", "left")
        .crossJoin(total)  # one row
        .withColumns({"supply": F.coalesce("supply", F.lit(0)), "documents": F.coalesce("documents", F.lit(0)), "demand": F.col("target_share") * F.col("total_tokens")})
        .withColumn("full", F.when(F.col("supply") > 0, F.least(repeats.cast("bigint"), F.floor(F.col("demand") / F.col("supply")))).otherwise(F.lit(0).cast("bigint")))
        .withColumn("rest", F.when((F.col("supply") > 0) & (F.col("full") < repeats), F.col("demand") - F.col("full") * F.col("supply")).otherwise(F.lit(0.0)))
    )
    return docs, plan


def mix_sources(sizes: DataFrame, targets: DataFrame, schedules: dict[str, list[tuple[float, float]]] | None = None, seed: int = 0) -> DataFrame:
    """The drawn documents in training order: doc_id, source, pass_no, n_tokens, position.

    Each source is drawn in whole passes of a hash order and one last part pass, which takes the
    documents whose middle token lies within the demand. A source smaller than its share gives at
    most max_repeats passes, so its reached share is lower (see :func:`shares`). ``position`` is
    the training time 0..1 at which the source's scheduled demand reaches the middle of the
    document; rows come range-sorted by it. Null texts and documents of no or an unlisted source
    aren't drawn. Ties of position go by source, pass and doc_id. Empty tables give no rows.
    """
    docs, plan = plan_mixture(sizes, targets, seed)
    schedules = schedules or {}
    rows = [(s, [list(map(float, x)) for x in segments(k)]) for s, k in schedules.items()]
    spark = sizes.sparkSession
    curves = spark.createDataFrame(rows, "source string, segs array<array<double>>")  # a few rows, as given by the caller
    even = F.array(*[F.array(*[F.lit(float(v)) for v in x]) for x in segments(EVEN)])
    plan = plan.join(curves, "source", "left").withColumn("segs", F.coalesce("segs", even))
    drawn = docs.join(small(cut(plan.select("source", "supply", "full", "rest", "segs"))), "source")  # a row for each listed source
    middle = F.col("at") + F.col("n_tokens") / 2
    drawn = drawn.withColumn("copies", F.col("full") + (middle <= F.col("rest")).cast("bigint") * (F.col("rest") > 0).cast("bigint"))
    drawn = drawn.where("copies > 0").withColumn("pass_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    share = F.least(F.lit(1.0), (F.col("pass_no") * F.col("supply") + middle) / (F.col("full") * F.col("supply") + F.col("rest")))
    drawn = drawn.withColumn("q", share)
    seg = F.coalesce(F.get(F.filter("segs", lambda x: (F.col("q") >= x[0]) & (F.col("q") < x[1])), F.lit(0)), F.element_at("segs", -1))
    drawn = drawn.withColumn("seg", seg)
    area, w0, slope = F.col("q") - F.col("seg")[0], F.col("seg")[3], F.col("seg")[4]
    # the u with w0*u + slope*u*u/2 = area, in the form that also holds for slope 0
    root = w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * area))
    position = F.least(F.lit(1.0), F.col("seg")[2] + F.when(root > 0, 2 * area / root).otherwise(F.lit(0.0)))
    return drawn.select("doc_id", "source", "pass_no", "n_tokens", position.alias("position")).orderBy("position", "source", "pass_no", "doc_id")


def shares(sizes: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """What each listed source contributes, one row a source, also for those without documents.

    ``reached_share`` is of the target total, ``drawn_share`` of all tokens drawn; ``capped`` marks
    sources that max_repeats keeps below their share.
    """
    docs, plan = plan_mixture(sizes, targets, seed)
    part = F.when(F.col("at") + F.col("n_tokens") / 2 <= F.col("rest"), F.col("n_tokens")).otherwise(F.lit(0))
    plan = cut(plan)
    last = docs.join(small(plan.select("source", "rest").where("rest > 0")), "source").groupBy("source").agg(F.sum(part).alias("part_tokens"))
    out = plan.join(last, "source", "left").withColumn("drawn_tokens", F.col("full") * F.col("supply") + F.coalesce("part_tokens", F.lit(0)))
    everything = out.agg(F.sum("drawn_tokens").alias("all_drawn"))
    return out.crossJoin(everything).select(  # one row
        "source",
        "target_share",
        "max_repeats",
        "documents",
        F.col("supply").alias("supply_tokens"),
        F.round("demand", 3).alias("target_tokens"),
        "drawn_tokens",
        F.when(F.col("total_tokens") > 0, F.round(F.col("drawn_tokens") / F.col("total_tokens"), 6)).otherwise(0.0).alias("reached_share"),
        F.when(F.col("all_drawn") > 0, F.round(F.col("drawn_tokens") / F.col("all_drawn"), 6)).otherwise(0.0).alias("drawn_share"),
        F.when(F.col("supply") > 0, F.round(F.col("drawn_tokens") / F.col("supply"), 6)).otherwise(0.0).alias("passes"),
        ((F.col("max_repeats") * F.col("supply")) < F.col("demand")).alias("capped"),
    )


def sized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens of every document, counted once and kept: a few bytes a document."""
    return cut(corpus_sizes(docs, ["doc_id", "source"], "text", path))
