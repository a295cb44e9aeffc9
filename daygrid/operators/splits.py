"""Participant splits without leakage.

Members are ordered by md5 of (seed, participant), which is the same digest in every engine, and the
first round(n * share) of each stratum go to the test part. Ranks come from
``functions.ranking.rank_and_size``, so a stratum may be as large as the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

from daygrid import constants as C
from daygrid.functions.ranking import rank_and_size
from daygrid.operators import labels as L
from daygrid.operators import recode as R
from daygrid.sources.session import scratch_path

ROW = "participant_id"


def split_digest(seed: int, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def label_count_bins(counts: DataFrame, bins: int = 5) -> DataFrame:
    """Quantile bins of the label counts: right-closed, lowest edge included, duplicate edges dropped.

    Falls back to the raw count when only one edge is left. There are at most as many different counts as labels, and
    ``percentile`` merges (count, frequency) pairs, so few numbers leave a task.
    """
    edges = counts.agg(
        F.array_distinct(F.percentile("label_count", [i / bins for i in range(bins + 1)])).alias("edges")
    )
    with_edges = counts.withColumn("_e", edges.scalar())
    inner_edges_below = F.size(
        F.filter(F.slice(F.col("_e"), 2, F.greatest(F.size("_e") - 2, F.lit(0))), lambda e: e < F.col("label_count"))
    )
    return with_edges.withColumn(
        "stratum",
        F.when(F.size("_e") < 2, F.col("label_count")).otherwise(inner_edges_below).cast("int"),
    ).drop("_e")


def assigned_by_rank(ranked: DataFrame, shares: list[tuple[str, float]], rest: str = "train") -> Column:
    """Split of a row with ``_rank`` and ``_size``: cut points at the rounded cumulative shares, on one ranking."""
    out, cuts, total = F.lit(rest), [], 0.0
    for name, share in shares:
        total += share
        cuts.append((name, total))
    for name, cut in reversed(cuts):
        out = F.when(F.col("_rank") <= F.round(F.col("_size") * F.lit(cut)), F.lit(name)).otherwise(out)
    return out


def stratified_assignment(
    members: DataFrame,
    strata: list[str],
    test_size: float = 0.2,
    seed: int = 42,
    shares: list[tuple[str, float]] | None = None,
) -> DataFrame:
    """``participant_id, split`` for one row per participant. ``strata`` may be empty.

    ``shares`` gives several parts at once, in order; without it the parts are test and train.
    """
    rows = members.select(ROW, *strata).withColumn("_h", split_digest(seed, F.col(ROW)))
    ranked = rank_and_size(rows, strata, F.substring(F.col("_h"), 1, 3), [F.col("_h"), F.col(ROW)])
    return ranked.select(ROW, assigned_by_rank(ranked, shares or [("test", test_size)]).alias("split"))


def split_by_label_count(
    flat: DataFrame, test_size: float = 0.2, bins: int = 5, seed: int = 42
) -> DataFrame:
    """Assignment stratified by how many labels a participant has."""
    binned = label_count_bins(L.labels_present(flat), bins)
    return stratified_assignment(binned, ["stratum"], test_size, seed)


def rows_of_split(df: DataFrame, assignment: DataFrame, split: str | None = None) -> DataFrame:
    out = df.join(assignment, ROW)
    return out if split is None else out.where(F.col("split") == split).drop("split")


def rare_strata(members: DataFrame, strata: list[str], minimum: int = 2) -> DataFrame:
    """Strata with fewer members than ``minimum``."""
    return members.groupBy(*strata).agg(F.count("*").alias("n")).where(F.col("n") < minimum)


def require_no_rare_strata(members: DataFrame, strata: list[str], minimum: int = 2, show: int = 10) -> None:
    """Raise with at most ``show`` examples when a stratum is too small to be split."""
    examples = rare_strata(members, strata, minimum).orderBy(*strata).limit(show).collect()
    if examples:
        raise ValueError(f"strata with fewer than {minimum} members: {[r.asDict() for r in examples]}")


def open_sharing(df: DataFrame, info: DataFrame) -> DataFrame:
    """Rows of participants who share with all researchers."""
    allowed = info.where(F.col("sharing_scope") == C.OPEN_SHARING_SCOPE).select(ROW)
    return df.join(allowed, ROW, "left_semi")


def with_age_group(members: DataFrame, info: DataFrame) -> DataFrame:
    """Left join of the age group; participants without information are Unknown_Age."""
    ages = R.with_age(info).select(ROW, R.age_group(F.col("age")).alias("age_group"))
    return members.join(ages, ROW, "left").withColumn(
        "age_group", F.coalesce("age_group", F.lit(C.UNKNOWN_AGE))
    )


def label_strata(flat: DataFrame) -> DataFrame:
    """Label text columns per participant."""
    return R.label_texts(R.coarse_means(L.label_means(flat)))


def split_by_label_values(
    flat: DataFrame,
    info: DataFrame,
    test_size: float = 0.2,
    seed: int = 42,
    sharing_subset: bool = True,
    check: bool = True,
) -> DataFrame:
    """Assignment stratified by the tuple of coarse label texts."""
    if sharing_subset:
        flat = open_sharing(flat, info)
    strata = label_strata(flat)
    columns = [c for c in strata.columns if c != ROW]
    if check:
        require_no_rare_strata(strata, columns)
    return stratified_assignment(strata, columns, test_size, seed)


def demographic_features(flat: DataFrame, demographics: DataFrame, info: DataFrame) -> DataFrame:
    """Demographics with age, joined to the label means, one row per participant."""
    demo = R.most_complete(demographics).select(ROW, "biological_sex")
    ages = R.with_age(info).select(ROW, "age")
    return demo.join(ages, ROW, "left").join(L.label_means(flat), ROW)


#: Starts of k-means; the fit with the least cost is taken.
STARTS = 10


def cluster_vectors(features: DataFrame) -> DataFrame:
    """Scaled numeric features and one-hot sex of each participant, as vectors."""
    numeric = [c for c in features.columns if c not in (ROW, "biological_sex")]
    levels = ["Female", "Male", C.MISSING]
    table = R.one_hot(R.scaled_features(features, numeric, "biological_sex"), "biological_sex", levels)
    inputs = numeric + [f"biological_sex_{v}" for v in levels]
    vectors = VectorAssembler(inputCols=inputs, outputCol="features").transform(table)
    # Every start reads the vectors several times.
    path = scratch_path(features.sparkSession, "cluster-vectors")
    vectors.select(ROW, "features").write.parquet(path)
    return features.sparkSession.read.parquet(path)


def fitted(vectors: DataFrame, k: int, seed: int, starts: int = STARTS):
    """The best of several k-means fits; None where there are fewer than two participants or clusters.

    No more clusters than participants, as published.
    """
    k = min(k, vectors.count())
    if k <= 1:
        return None
    fits = [KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="cluster").fit(vectors) for i in range(starts)]
    return min(fits, key=lambda model: model.summary.trainingCost)


def clusters(features: DataFrame, k: int = 10, seed: int = 42, starts: int = STARTS) -> DataFrame:
    """k-means cluster per participant over scaled numeric features and one-hot sex."""
    vectors = cluster_vectors(features)
    model = fitted(vectors, k, seed, starts)
    if model is None:
        return vectors.select(ROW, F.lit(0).alias("cluster"))
    return model.transform(vectors).select(ROW, "cluster")


def cluster_checks(features: DataFrame, k: int = 10, seed: int = 42, starts: int = STARTS) -> DataFrame:
    """Members, whether at most k clusters are used, and members that are nearer to the centre of another cluster."""
    vectors = cluster_vectors(features)
    model = fitted(vectors, k, seed, starts)
    if model is None:
        return vectors.agg(F.count("*").alias("members"), F.lit(True).alias("within_k"), F.lit(0).cast("long").alias("not_at_nearest"))
    rows = model.transform(vectors).select("cluster", vector_to_array("features").alias("x"))

    def distance(centre) -> Column:
        parts = F.zip_with("x", F.array(*[F.lit(float(v)) for v in centre]), lambda a, b: (a - b) * (a - b))
        return F.aggregate(parts, F.lit(0.0), lambda total, v: total + v)

    distances = F.array(*[distance(c) for c in model.clusterCenters()])
    own = F.get(F.col("d"), F.col("cluster"))
    return rows.select("cluster", distances.alias("d")).agg(
        F.count("*").alias("members"),
        (F.count_distinct("cluster") <= k).alias("within_k"),
        F.count_if(own > F.array_min("d") + 1e-9).alias("not_at_nearest"),
    )


def cluster_strata(
    flat: DataFrame, demographics: DataFrame, info: DataFrame, k: int = 10, seed: int = 42, starts: int = STARTS
) -> DataFrame:
    """The stratum of every participant: its cluster, or -1 without demographics.

    When a cluster has a single member the clusters are ignored, as stratifying by them is impossible.
    """
    members = flat.select(ROW).distinct()
    path = scratch_path(flat.sparkSession, "clusters")
    clusters(demographic_features(flat, demographics, info), k, seed, starts).write.parquet(path)
    assigned = flat.sparkSession.read.parquet(path)
    smallest = assigned.groupBy("cluster").agg(F.count("*").alias("n")).agg(F.min("n").alias("n"))
    assigned = assigned.withColumn("stratum", F.when(smallest.scalar() < 2, F.lit(0)).otherwise(F.col("cluster")))
    return members.join(assigned, ROW, "left").withColumn("stratum", F.coalesce("stratum", F.lit(-1)))


def split_by_cluster(
    flat: DataFrame,
    demographics: DataFrame,
    info: DataFrame,
    test_size: float = 0.2,
    k: int = 10,
    seed: int = 42,
    sharing_subset: bool = True,
    starts: int = STARTS,
) -> DataFrame:
    """Assignment stratified by cluster; participants without demographics are split on their own."""
    if sharing_subset:
        flat = open_sharing(flat, info)
    strata = cluster_strata(flat, demographics, info, k, seed, starts)
    return stratified_assignment(strata, ["stratum"], test_size, seed)


def cluster_split_checks(
    flat: DataFrame, demographics: DataFrame, info: DataFrame, test_size: float = 0.2, k: int = 10, seed: int = 42
) -> DataFrame:
    """With and without demographics: members, members without or with two splits, strata with a wrong test count."""
    flat = open_sharing(flat, info)
    path = scratch_path(flat.sparkSession, "cluster-strata")
    cluster_strata(flat, demographics, info, k, seed).write.parquet(path)
    strata = flat.sparkSession.read.parquet(path)
    split = stratified_assignment(strata, ["stratum"], test_size, seed)
    per_member = split.groupBy(ROW).agg(F.count_distinct("split").alias("splits"), F.max("split").alias("split"))
    rows = strata.select(ROW, "stratum").join(per_member, ROW, "left")
    per_stratum = rows.groupBy("stratum").agg(
        F.count("*").alias("members"),
        F.count_if(F.col("splits").isNull()).alias("unassigned"),
        F.count_if(F.col("splits") > 1).alias("overlapping"),
        F.count_if(F.col("split") == "test").alias("test"),
    )
    wrong = F.col("test") != F.round(F.col("members") * F.lit(test_size))
    return per_stratum.groupBy((F.col("stratum") >= 0).alias("has_demographics")).agg(
        F.sum("members").alias("members"),
        F.sum("unassigned").alias("unassigned"),
        F.sum("overlapping").alias("overlapping"),
        F.count_if(wrong).alias("wrong_strata"),
    )


def three_way(
    flat: DataFrame,
    test_size: float = 0.2,
    validation_size: float = 0.1,
    bins: int = 5,
    seed: int = 42,
    by: str = "label_count",
    info: DataFrame | None = None,
    demographics: DataFrame | None = None,
    **more,
) -> DataFrame:
    """Test split, then a validation split of the rest at validation / (1 - test).

    ``by`` is how both are stratified: ``label_count`` (bins of the rest are made anew), ``label_values`` (a participant's
    label texts, which do not depend on the others) or ``clusters`` (the rest is clustered anew). What the first split
    knows of each participant is kept, so labels are read once for the first two.
    """
    second_size = validation_size / (1 - test_size)
    if by == "label_count":
        members = label_count_bins(L.labels_present(flat), bins)
        first = _with_split(members, ["stratum"], test_size, seed)
        rest = label_count_bins(first.where("split = 'train'").drop("split", "stratum"), bins)
        second = stratified_assignment(rest, ["stratum"], second_size, seed)
    elif by == "label_values":
        members = label_strata(flat if info is None else open_sharing(flat, info))
        strata = [c for c in members.columns if c != ROW]
        first = _with_split(members, strata, test_size, seed)
        second = stratified_assignment(first.where("split = 'train'"), strata, second_size, seed)
    elif by == "clusters":
        path = scratch_path(flat.sparkSession, "first-split")
        split_by_cluster(flat, demographics, info, test_size, seed=seed, **more).write.parquet(path)
        first = flat.sparkSession.read.parquet(path)
        rest = flat.join(first.where("split = 'train'"), ROW, "left_semi")
        second = split_by_cluster(rest, demographics, info, second_size, seed=seed, **more)
    else:
        raise ValueError(f"splits are stratified by label_count, label_values or clusters, not {by!r}")
    renamed = second.withColumn("split", F.when(F.col("split") == "test", "validation").otherwise("train"))
    return first.where("split = 'test'").select(ROW, "split").unionByName(renamed)


def _with_split(members: DataFrame, strata: list[str], test_size: float, seed: int) -> DataFrame:
    """``members`` with their split; ranks are taken on the rows themselves, so nothing is joined back."""
    rows = members.withColumn("_h", split_digest(seed, F.col(ROW)))
    ranked = rank_and_size(rows, strata, F.substring(F.col("_h"), 1, 3), [F.col("_h"), F.col(ROW)])
    return ranked.withColumn("split", assigned_by_rank(ranked, [("test", test_size)])).drop("_h", "_rank", "_size")


def without_rare_strata(members: DataFrame, strata: list[str], minimum: int = 2) -> DataFrame:
    """Members of strata that are large enough to be split."""
    # Strata are counted map-side.
    sizes = members.groupBy(F.struct(*strata).alias("_g")).agg(F.count("*").alias("_n")).where(F.col("_n") >= minimum)
    return members.withColumn("_g", F.struct(*strata)).join(sizes, "_g", "left_semi").drop("_g")


def described_splits(assignment: DataFrame, demographics: DataFrame, info: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max of the columns in each split."""
    from daygrid.operators.stats import describe

    return describe(assignment.join(diagnostics(demographics, info), ROW, "left"), ["split"], columns)


def window_level_split(windows: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Random split of windows, not participants: the same participant may be on both sides."""
    key = F.concat_ws("|", F.col(ROW).cast("string"), F.date_format("start_date", "yyyy-MM-dd"))
    rows = windows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), key)))
    ranked = rank_and_size(rows, [], F.substring(F.col("_h"), 1, 3), [F.col("_h"), F.col(ROW), F.col("start_date")])
    return ranked.withColumn("split", assigned_by_rank(ranked, [("test", test_size)])).drop("_h", "_rank", "_size")


def split_checks(assignment: DataFrame, members: DataFrame) -> DataFrame:
    """Participants in more than one split, not assigned, and assigned without being members."""
    per_participant = assignment.groupBy(ROW).agg(F.count_distinct("split").alias("splits"))
    joined = members.select(ROW).distinct().withColumn("_m", F.lit(True)).join(
        per_participant, ROW, "full_outer"
    )
    return joined.agg(
        F.count_if(F.col("splits") > 1).alias("overlapping"),
        F.count_if(F.col("splits").isNull()).alias("unassigned"),
        F.count_if(F.col("_m").isNull()).alias("unknown"),
    )


def demographics_coverage(flat: DataFrame, demographics: DataFrame) -> DataFrame:
    """Participants of the dataset with and without demographics."""
    members = flat.select(ROW).distinct()
    known = demographics.select(ROW).distinct()
    both = members.intersect(known).withColumn("has_demographics", F.lit(True))
    without = members.join(known, ROW, "left_anti").withColumn("has_demographics", F.lit(False))
    return both.unionByName(without)


def diagnostics(demographics: DataFrame, info: DataFrame) -> DataFrame:
    """Full outer join of first demographics rows and ages."""
    demo = R.first_per_key(demographics, [ROW], [F.col("row_no")]).drop("row_no")
    ages = R.with_age(info).select(ROW, "age")
    return demo.join(ages, ROW, "full_outer")


def evaluation_rows(df: DataFrame) -> DataFrame:
    """Rows of the test split, or every row when there is no test row."""
    has_test = df.agg(F.bool_or(F.col("split") == "test").alias("t"))
    return df.where(~F.coalesce(has_test.scalar(), F.lit(False)) | (F.col("split") == "test"))
