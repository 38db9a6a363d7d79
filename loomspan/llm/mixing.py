"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words. Documents are counted by exact size within each source; each source's budget is
met by a proportional share of every size, a greedy remainder and a bounded-knapsack dynamic programme over the last few
thousand words; then, for every size, as many documents as the plan says are chosen in the order of a seeded hash.

Defined results: null text has size 0; a null source is a source of its own, last in order; documents of size 0 take 0
words; repeated rows count each; an empty table gives an empty result; clashing extra columns are ignored. Whole texts are
counted, however long; equal hashes are taken in the order of doc_id, and rows that agree in both are alike.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

GAPS = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null gives 0.

    Every word becomes one mark and the gaps go, so that no array of words is built: the length left is the count.
    """
    marks = F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), GAPS, "")
    return F.coalesce(F.length(marks).cast("long"), F.lit(0).cast("long"))


def share_out(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Split ``total`` by weight; who would pass ``most`` times its size stops there and the excess is shared again."""
    target = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes))]
    left = float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = unit * weights[i]
            break
        for i in full:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ = [i for i in open_ if i not in set(full)]
    return target


def fit_budget(counts: dict[int, int], budget: int, window: int = 4096) -> dict[int, int]:
    """How many documents of each size to take so that their sizes sum to ``budget`` or as near below as possible.

    ``counts`` maps size to number of documents. The bulk is proportional; a greedy pass takes the remainder from the
    largest size down; then documents of about ``window`` words are put back and a bit-set dynamic programme over bounded
    multiplicities finds the sum nearest to the budget.
    """
    counts = {s: c for s, c in counts.items() if s > 0 and c > 0}
    total = sum(s * c for s, c in counts.items())
    if budget >= total:
        return dict(counts)
    take = {s: c * budget // total for s, c in counts.items()}
    left = budget - sum(s * k for s, k in take.items())
    order = sorted(counts, reverse=True)
    for s in order:
        k = min(counts[s] - take[s], left // s)
        take[s] += k
        left -= k * s
    if not left:
        return take
    for s in reversed(order):  # smallest first: many ways to recombine
        if left >= window:
            break
        k = min(take[s], -(-(window - left) // s))
        take[s] -= k
        left += k * s
    reach, steps, full = 1, [], (1 << (left + 1)) - 1
    for s in reversed(order):
        room, unit = counts[s] - take[s], 1
        while room > 0 and s * unit <= left and not reach >> left & 1:
            n = min(unit, room)
            steps.append((s, n, reach))
            reach |= reach << s * n & full
            room, unit = room - n, unit * 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for s, n, before in reversed(steps):
        if not before >> at & 1:
            take[s] += n
            at -= s * n
    return take


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17,
    bucket_rows: int = 256, run_buckets: int = 4096, max_sources: int = 1_000_000,
) -> DataFrame:
    """Every document with doc_id, size, source_size, target and taken (words the mix takes, repeats counted).

    One row per source reaches the driver; ``max_sources`` bounds that table and more is an error. Each source's counts by
    size (at most one row per distinct size) are fitted in one task per source. Choosing documents of a size splits large
    counts into hashed buckets of about ``bucket_rows``, whose running counts are taken by runs of ``run_buckets``, so a hot
    source or a hot size never meets in one task. The plan is a table of its own when documents join it: the planner can
    broadcast it where it is small and split a hot (source, size) where it is not.
    """
    spark = docs.sparkSession
    base = cut(
        docs.select(
            F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"),
            F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"),
        ),
        "mix-sizes",
    )
    by_size = cut(base.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    totals = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    totals.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(r[1]) for r in totals]
    targets = share_out(sizes, [float(weights[i % len(weights)]) for i in range(len(sizes))], share * sum(sizes), most)
    plan = spark.createDataFrame(
        [(r[0], s, float(t)) for r, s, t in zip(totals, sizes, targets)], "source string, source_size long, target double"
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        whole, budget = int(pdf["source_size"].iloc[0]), round(float(pdf["target"].iloc[0]))
        each = budget // whole if whole else 0  # every document this often; the fit chooses who is taken once more
        more = fit_budget(dict(zip(pdf["size"].tolist(), pdf["n"].tolist())), budget - each * whole if whole else 0)
        return pdf[["source", "size", "n", "source_size", "target"]].assign(each=each, more=[more.get(s, 0) for s in pdf["size"].tolist()])

    fitted = cut(
        by_size.join(plan, by_size["source"].eqNullSafe(plan["source"])).drop(plan["source"])
        .groupBy("source").applyInPandas(fit, "source string, size long, n long, source_size long, target double, each int, more long")
        .withColumn("buckets", F.ceil(F.col("n") / bucket_rows)),
        "mix-plan",
    )
    f = fitted.select(F.col("source").alias("f_source"), F.col("size").alias("f_size"), "source_size", "target", "each", "more", "buckets")
    unit = F.shiftrightunsigned("h", 11) * F.lit(2.0**-53)
    dealt = (
        base.join(f, base["source"].eqNullSafe(f["f_source"]) & (base["size"] == f["f_size"])).drop("f_source", "f_size")
        .withColumn("bucket", F.least(F.floor(unit * F.col("buckets")), F.col("buckets") - 1))
    )
    key = ["source", "size", "bucket"]
    filled = dealt.groupBy(*key).agg(F.count("*").alias("rows"))
    # running counts in two steps, so that no window sees all buckets of a hot size
    filled = cut(filled.withColumn("run", F.floor(F.col("bucket") / run_buckets)), "mix-buckets")
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    runs = filled.groupBy("source", "size", "run").agg(F.sum("rows").alias("rows"))
    runs = runs.select(
        F.col("source").alias("r_source"), F.col("size").alias("r_size"), F.col("run").alias("r_run"),
        F.coalesce(F.sum("rows").over(earlier("source", "size").orderBy("run")), F.lit(0)).alias("runs_before"),
    )
    of_run = filled["source"].eqNullSafe(runs["r_source"]) & (filled["size"] == runs["r_size"]) & (filled["run"] == runs["r_run"])
    within = F.coalesce(F.sum("rows").over(earlier("source", "size", "run").orderBy("bucket")), F.lit(0))
    filled = filled.withColumn("within", within).join(runs, of_run).withColumn("before", F.col("within") + F.col("runs_before"))
    g = filled.select(*[F.col(c).alias(f"g_{c}") for c in key], "before")
    same = dealt["source"].eqNullSafe(g["g_source"]) & (dealt["size"] == g["g_size"]) & (dealt["bucket"] == g["g_bucket"])
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("h", "doc_id"))
    copies = F.col("each") + F.when(rank <= F.col("more") - F.col("before"), 1).otherwise(0)
    return dealt.join(g, same).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), "h")


def apply_mix(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """``docs`` (all columns) with every row as often as the mix takes it; rows it does not take go.

    Rows that agree in doc_id and text share what the mix takes of them; only if there are such rows are they numbered.
    """
    plan = mix_sources(docs, seed=seed, **options)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("long")
    shares = cut(plan.groupBy(F.col("doc_id").alias("_m_id"), F.col("h").alias("_m_h")).agg(F.sum(times).alias("_m_times"), F.count("*").alias("_m_rows")), "mix-shares").filter("_m_times > 0")
    names = docs.columns
    hidden = docs.select(*[F.col(f"`{c}`").alias(f"_d{i}") for i, c in enumerate(names)])
    text, doc = (F.col(f"_d{names.index(c)}") for c in ("text", "doc_id"))
    rows = hidden.withColumn("_h", F.xxhash64(F.lit(seed), doc, text)).join(shares, (F.col("_h") == F.col("_m_h")) & doc.cast("long").eqNullSafe(F.col("_m_id")))
    each = rows.filter("_m_rows = 1").withColumn("_times", F.col("_m_times"))
    if not shares.filter("_m_rows > 1").isEmpty():
        place = F.row_number().over(Window.partitionBy("_m_id", "_m_h").orderBy("_m_id"))
        many = rows.filter("_m_rows > 1").withColumn("_times", F.floor(F.col("_m_times") / F.col("_m_rows")) + F.when(place <= F.col("_m_times") % F.col("_m_rows"), 1).otherwise(0))
        each = each.union(many)
    out = each.withColumn("_again", F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int"))))
    return out.select(*[F.col(f"_d{i}").alias(c) for i, c in enumerate(names)])
