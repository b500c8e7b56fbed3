"""Window embeddings (series_id, w, embedding): references, dissimilarity, pooled vectors, patch grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOWER_MEDIAN = "percentile_disc(0.5) WITHIN GROUP (ORDER BY v)"


def embedding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per label; w counts its vectors by id."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label IS NOT NULL")
    w = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return rows.select(
        F.col("label").cast("long").alias("series_id"), w.cast("long").alias("w"), "vec_id", F.col("embedding").cast("array<double>").alias("embedding")
    )


def dimensions(windows: DataFrame) -> DataFrame:
    return windows.select("series_id", "w", F.posexplode("embedding").alias("dim", "v"))


def global_median(windows: DataFrame) -> DataFrame:
    """series_id, dim, v: the lower median over all windows."""
    return dimensions(windows).groupBy("series_id", "dim").agg(F.expr(LOWER_MEDIAN).alias("v"))


def early_median(windows: DataFrame, share: float = 0.2, least: int = 5) -> DataFrame:
    """The same over the first max(least, share of L) windows, L - 1 at most."""
    n = windows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    cut = F.least(F.greatest(F.lit(least), F.floor(F.col("n") * share)), F.col("n") - 1)
    return global_median(windows.join(n, "series_id").where(F.col("w") < cut).drop("n"))


def local_median(windows: DataFrame, k: int = 5) -> DataFrame:
    """series_id, w, dim, v: lower median of the k windows before and the k after; k is at least 5, so that
    a window has five neighbours or all others."""
    if k < 5:
        raise ValueError("k must be at least 5")
    order = Window.partitionBy("series_id", "dim").orderBy("w")
    around = F.concat(
        F.collect_list("v").over(order.rowsBetween(-k, -1)), F.collect_list("v").over(order.rowsBetween(1, k))
    )
    near = dimensions(windows).select("series_id", "w", "dim", F.array_sort(around).alias("a"))
    return near.where(F.size("a") > 0).select(
        "series_id", "w", "dim", F.element_at("a", F.floor((F.size("a") + 1) / 2).cast("int")).alias("v")
    )


def as_vector(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("dim", "v")))
    return rows.groupBy(*keys).agg(F.transform(ordered, lambda x: x["v"]).alias(name))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def dissimilarity(windows: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """(1 - cosine) / 2 to the reference of the same keys."""
    ref = as_vector(reference, keys, "reference")
    return windows.join(ref, keys).select("series_id", "w", ((1 - cosine(F.col("embedding"), F.col("reference"))) / 2).alias("score"))


def patches(windows: DataFrame, size: int) -> DataFrame:
    """series_id, w, patch, vec: consecutive runs of ``size`` dimensions."""
    n = (F.size("embedding") / size).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.slice("embedding", p * size + 1, F.lit(size)))
    return windows.select("series_id", "w", F.posexplode(parts).alias("patch", "vec"))


def best_patch_match(windows: DataFrame, reference: DataFrame, size: int, side: int, same_row: bool) -> DataFrame:
    """For each patch the least (1 - cosine) / 2 over the reference's patches, of all rows or its own row.

    The reference has a fixed number of patches per series, so a window's rows grow by that factor only.
    """
    ref = as_vector(reference, ["series_id"], "embedding").withColumn("w", F.lit(0))
    right = patches(ref, size).select("series_id", F.col("patch").alias("other"), F.col("vec").alias("ref"))
    pairs = patches(windows, size).join(right, "series_id")
    if same_row:
        pairs = pairs.where(F.floor(F.col("patch") / side) == F.floor(F.col("other") / side))
    score = F.min((1 - cosine(F.col("vec"), F.col("ref"))) / 2)
    return pairs.groupBy("series_id", "w", "patch").agg(score.alias("score"))


def pooled(windows: DataFrame, size: int, rms: bool) -> DataFrame:
    """series_id, w, embedding: mean over patches, and with ``rms`` the root mean square too, each of unit length."""
    cells = patches(windows, size).select("series_id", "w", "patch", F.posexplode("vec").alias("dim", "x"))
    stats = cells.groupBy("series_id", "w", "dim").agg(F.avg("x").alias("m"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("q"))

    def unit(name: str) -> Column:
        v = F.transform("a", lambda e: e[name])
        size_ = norm(v)
        return F.transform(v, lambda x: F.when(size_ > 0, x / size_).otherwise(0.0))

    rows = stats.groupBy("series_id", "w").agg(F.array_sort(F.collect_list(F.struct("dim", "m", "q"))).alias("a"))
    return rows.select("series_id", "w", (F.concat(unit("m"), unit("q")) if rms else unit("m")).alias("embedding"))


def membership(spark: SparkSession, side: int, group: int) -> DataFrame:
    """group_id, cell: square groups with stride 1 on a side x side grid."""
    starts = side - group + 1
    rows = spark.range(starts * starts).select(
        F.col("id").alias("group_id"), F.floor(F.col("id") / starts).alias("r"), (F.col("id") % starts).alias("c")
    )
    inner = F.explode(F.sequence(F.lit(0), F.lit(group * group - 1))).alias("k")
    return rows.select("group_id", "r", "c", inner).select(
        "group_id", ((F.col("r") + F.floor(F.col("k") / group)) * side + F.col("c") + F.col("k") % group).cast("long").alias("cell")
    )


def group_scores(cells: DataFrame, members: DataFrame) -> DataFrame:
    """(series_id, w, cell, s) to the mean over each group."""
    return cells.join(F.broadcast(members), "cell").groupBy("series_id", "w", "group_id").agg(F.avg("s").alias("s"))


def harmonic(groups: DataFrame, members: DataFrame, cells: DataFrame, shift: int) -> DataFrame:
    """Per cell the harmonic mean of the groups that hold cell + shift; 0 without any.

    shift 1 repeats a known off-by-one of the method, 0 is the corrected form.
    """
    moved = members.select("group_id", (F.col("cell") - shift).alias("cell"))
    got = groups.join(F.broadcast(moved), "group_id").groupBy("series_id", "w", "cell").agg(
        (F.count(F.lit(1)) / F.sum(1 / F.col("s"))).alias("score")
    )
    return cells.select("series_id", "w", "cell").join(got, ["series_id", "w", "cell"], "left").select(
        "series_id", "w", "cell", F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)).alias("score")
    )
