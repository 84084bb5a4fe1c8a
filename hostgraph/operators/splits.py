"""Leakage-safe splits and exact seeded sampling.

Random order = ``md5(seed | id)``: deterministic, identical in Spark and SQL engines, and
recomputable after an executor loss (no ``rand()`` whose value changes on retry).

``hash_rank`` gives the exact ``row_number() over (partition by g order by md5)`` without
sorting a whole group in one task: the 16-bit hash prefix splits every group into up to
65,536 sub-groups; their counts (a small table, ``groups x 65,536`` rows at most) give each
sub-group's offset, and a window ranks rows inside a sub-group only.  A label holding a
third of all rows is therefore ranked by 65,536 independent sorts.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRAIN_DAYS = ("Monday", "Tuesday", "Wednesday")
TEST_DAYS = ("Thursday", "Friday")
PREFIX_CHARS = 4            # 16-bit hash prefix -> 65,536 sub-groups per group


def seeded_hash(id_col: str, seed: int) -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL meets NULL; the keys of ``left`` stay."""
    r = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = [left[k].eqNullSafe(r[f"_k_{k}"]) for k in keys]
    return left.join(r, cond, how).drop(*[f"_k_{k}" for k in keys])


def hash_rank(df: DataFrame, group_cols: list[str], id_col: str, seed: int = 42,
              rank_col: str = "hash_rank", size_col: str = "group_size") -> DataFrame:
    """Exact 1-based rank of every row inside its group by ``md5(seed|id)`` (ties by id),
    plus the group's size.  NULL is a group like any other; rows with a NULL id tie."""
    g = list(group_cols)
    d = (df.withColumn("_h", seeded_hash(id_col, seed))
         .withColumn("_p", F.substring("_h", 1, PREFIX_CHARS)))
    counts = d.groupBy(*g, "_p").agg(F.count(F.lit(1)).alias("_n"))
    wg = Window.partitionBy(*g) if g else Window.partitionBy()
    offsets = counts.select(
        *g, "_p",
        (F.sum("_n").over(wg.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("_n")).alias("_off"),
        F.sum("_n").over(wg).alias(size_col))
    within = Window.partitionBy(*g, "_p").orderBy("_h", id_col)
    ranked = d.withColumn("_rn", F.row_number().over(within))
    return (_join_null_safe(ranked, offsets, [*g, "_p"])
            .withColumn(rank_col, F.col("_off") + F.col("_rn"))
            .drop("_h", "_p", "_rn", "_off"))


def stratified_split(df: DataFrame, strata: list[str], id_col: str = "row_id",
                     test_size: float = 0.2, seed: int = 42, out: str = "is_test") -> DataFrame:
    """Exactly ``round_half_even(n * test_size)`` test rows per stratum."""
    r = hash_rank(df, strata, id_col, seed)
    k = F.bround(F.col("group_size") * F.lit(test_size), 0)
    return r.withColumn(out, F.col("hash_rank") <= k).drop("hash_rank", "group_size")


def holdout_class(df: DataFrame, label_col: str = "label", cls: str = "BENIGN",
                  id_col: str = "row_id", size: float = 0.1, seed: int = 42,
                  out: str = "is_holdout") -> DataFrame:
    """A seeded holdout of one class (never trained on); other rows are never holdout."""
    one = df.where(F.col(label_col).eqNullSafe(F.lit(cls)))
    marked = stratified_split(one, [], id_col, size, seed, out)
    rest = df.where(~F.col(label_col).eqNullSafe(F.lit(cls))).withColumn(out, F.lit(False))
    return marked.unionByName(rest)


def day_split(df: DataFrame, day_col: str = "day", train_days=TRAIN_DAYS,
              test_days=TEST_DAYS, out: str = "side") -> DataFrame:
    """train / test by weekday; other days are left out.  ``isin`` is pushed to the scan
    and prunes partitions when the table is written partitioned by day."""
    return (df.where(F.col(day_col).isin(*train_days, *test_days))
            .withColumn(out, F.when(F.col(day_col).isin(*train_days), F.lit("train"))
                        .otherwise(F.lit("test"))))


def group_split(df: DataFrame, group_col: str = "bucket", test_size: float = 0.2,
                seed: int = 42, out: str = "is_test") -> DataFrame:
    """Whole groups (time buckets) go to one side: ``max(1, round_half_even(k * size))``
    test groups of k, chosen by hash rank; rows without a bucket form one group.  The group
    table has one row per bucket (time span / width), so ranking it is small; the join back
    is planned by AQE from its size."""
    groups = df.select(group_col).distinct()
    ranked = hash_rank(groups, [], group_col, seed)
    n_test = F.greatest(F.lit(1), F.bround(F.col("group_size") * F.lit(test_size), 0))
    chosen = ranked.select(group_col, (F.col("hash_rank") <= n_test).alias(out))
    return _join_null_safe(df, chosen, [group_col])


def stratified_sample(df: DataFrame, label_col: str | None = "label", max_per_label: int = 500,
                      id_col: str = "row_id", seed: int = 42) -> DataFrame:
    """At most ``max_per_label`` rows per label (all rows of smaller labels), seeded; with no
    label column, of the whole table.

    Rows per (label, hash prefix) are counted first; the prefix at which a label has its rows
    is a filter ahead of the shuffle, and only the rows at or below it are ranked (about
    ``max_per_label`` plus one prefix of rows per label move).  All rows of the smaller
    prefixes are among them, so their ranks are those in the whole label."""
    g = [label_col] if label_col else []
    d = df.withColumn("_p", F.substring(seeded_hash(id_col, seed), 1, PREFIX_CHARS))
    counts = d.groupBy(*g, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*g).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    needed = (counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
              .where(F.col("_before") < max_per_label))
    # a row without an id has no prefix: it sorts first and is always among the survivors
    last = needed.groupBy(*g).agg(F.max("_p").alias("_last"))
    kept = (_join_null_safe(d, last, g) if g else d.join(F.broadcast(last)))     # else: one row
    kept = kept.where(F.col("_p").isNull() | (F.col("_p") <= F.col("_last"))).drop("_p", "_last")
    r = hash_rank(kept, g, id_col, seed)
    return r.where(F.col("hash_rank") <= max_per_label).drop("hash_rank", "group_size")


def loco_fold_sizes(df: DataFrame, label_col: str = "label", benign: str = "BENIGN",
                    benign_train_col: str = "is_benign_train") -> DataFrame:
    """Leave-one-class-out folds: for class c, train = benign-train rows + every other
    attack class, test = c.  Sizes come from one aggregate per label, not a loop.  Rows
    without a label are attacks and form a class of their own (NULL)."""
    per = df.groupBy(label_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(benign_train_col)).alias("n_btrain"))
    attack = ~F.col(label_col).eqNullSafe(F.lit(benign))
    w = Window.partitionBy()
    tot = per.select(
        label_col, "n",
        F.sum(F.when(F.col(label_col) == benign, F.col("n_btrain"))).over(w).alias("_bt"),
        F.sum(F.when(attack, F.col("n"))).over(w).alias("_att"))
    return (tot.where(attack)
            .select(F.col(label_col).alias("held_out_class"),
                    (F.col("_bt") + F.col("_att") - F.col("n")).alias("n_train"),
                    F.col("n").alias("n_test")))
