"""Catalog entries: Spark ML training, scoring, anomaly scoring.

Model outputs depend on Spark ML's learners, not on SQL, so these carry the rows-only check
— except the label index, which is a pure function of the training labels."""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from ..functions.columns import is_internal_ip
from ..operators import boosting as BO
from ..operators import iforest as IF
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import splits as SP
from ..session import compilable_methods, materialize, scratch_path
from . import sqlparts as S
from . import stages as ST
from .q_chain import _TL as CHAIN_SQL
from .registry import register, rounded


def _scored_test(spark, sf):
    return SP.day_split(ST.scored_flows(spark, sf)).where(F.col("side") == "test")


@register("gbt_binary", "M1,M8,M9")
def q_gbt_binary(spark, sf):
    """Day split, flow + graph features: F1 of the attack class on the test days."""
    return rounded(M.f1_binary(_scored_test(spark, sf)))


@register("score_flows", "M8")
def q_score_flows(spark, sf):
    """Every flow, on every day, with the class and probability of the saved model."""
    return rounded(ST.scored_flows(spark, sf).select("row_id", "y", "pred", "attack_probability"))


def _multi_predictions(train, test, cols, split):
    """Test rows whose class training has seen, with the class they are taken for."""
    model = ML.boosted(train, cols, "label")
    seen = test.where(F.coalesce(*[F.when(F.col("label").eqNullSafe(F.lit(c)), True) for c in model.classes], F.lit(False)))
    return (BO.decode(BO.predict(ML.as_float(seen, cols), model), model)
            .select("row_id", "label", "pred_label", F.lit(split).alias("split")))


def multi_predictions(spark, sf):
    """Softmax boosting on the day split and on a stratified random split of all flows (a stage)."""
    def build():
        day, rows = ST.day_labelled(spark, sf), ST.labelled(spark, sf)
        cols = ML.feature_columns(rows, True)
        rand = SP.stratified_split(rows, ["label"], "row_id", 0.2, 42)
        runs = [(day.where("side = 'train'"), day.where("side = 'test'"), cols, "day"),
                (rand.where("NOT is_test"), rand.where("is_test"), cols, "random")]
        with ThreadPoolExecutor(len(runs)) as pool:          # independent fits side by side
            a, b = pool.map(lambda r: _multi_predictions(*r), runs)
        return a.unionByName(b)
    return ST.cached(spark, sf, "multi-class", build)


@register("multi_class", "M2,M3,M10")
def q_multi_class(spark, sf):
    """Softmax boosted trees of all classes on the day split and on a stratified random split of all
    flows; per-class report (rows of classes never seen in training are left out of it, see
    ``unseen_classes``)."""
    p = multi_predictions(spark, sf)
    day, rand = (M.classification_report(p.where(F.col("split") == s), "label", "pred_label").withColumn("split", F.lit(s))
                 for s in ("day", "random"))
    return rounded(day.unionByName(rand))


@register("multi_class_margins", "M2,M10", S.with_(S.FLOWS) + """
, n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || row_id), row_id) AS r,
               count(*) OVER (PARTITION BY label) AS k FROM flows),
d AS (SELECT label, CASE WHEN day IN ('Monday', 'Tuesday', 'Wednesday') THEN 'train' ELSE 'test' END AS side
      FROM flows WHERE day NOT IN ('Saturday', 'Sunday'))
SELECT 'day' AS split, label, count(*) AS n, CAST(0 AS BIGINT) AS n_unknown_class FROM d
WHERE side = 'test' AND label IN (SELECT label FROM d WHERE side = 'train') GROUP BY label
UNION ALL
SELECT 'random', label, count(*), 0 FROM n WHERE r <= round_even(k * 0.2, 0) GROUP BY label""")
def q_multi_class_margins(spark, sf):
    """The rows' margins of both confusion tables: every test row of a class that training has seen is
    taken for one such class."""
    day = ST.day_labelled(spark, sf)
    seen = (day.where("side = 'train'").select(F.lit("day").alias("split"), "label").unionByName(
        ST.labelled(spark, sf).select(F.lit("random").alias("split"), "label"))
        .distinct().withColumnRenamed("label", "pred_label").withColumn("known", F.lit(True)))
    return (multi_predictions(spark, sf).join(seen, ["split", "pred_label"], "left").groupBy("split", "label")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("known").isNull()).alias("n_unknown_class")))


@register("model_supports", "M1,M2,M5,S1,S3", S.with_(S.FLOWS) + """
, n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || row_id), row_id) AS r,
               count(*) OVER (PARTITION BY label) AS k FROM flows)
SELECT 'day' AS split, label, CASE WHEN day IN ('Monday', 'Tuesday', 'Wednesday') THEN 'train' ELSE 'test' END AS side,
       count(*) AS n FROM flows WHERE day NOT IN ('Saturday', 'Sunday') GROUP BY ALL
UNION ALL
SELECT 'random', label, CASE WHEN r <= round_even(k * 0.2, 0) THEN 'test' ELSE 'train' END, count(*) FROM n GROUP BY ALL
UNION ALL
SELECT 'zero_day', label, CASE WHEN label = 'BENIGN' AND r <= round_even(k * 0.1, 0) THEN 'holdout' ELSE 'base' END,
       count(*) FROM n GROUP BY ALL""")
def q_model_supports(spark, sf):
    """What the learners are given: rows per class and side of every protocol."""
    day, rows = ST.day_labelled(spark, sf), ST.labelled(spark, sf)
    rand = SP.stratified_split(rows, ["label"], "row_id", 0.2, 42)
    hold = SP.holdout_class(rows, "label", "BENIGN", "row_id", 0.1, 42)
    side = lambda flag, yes, no: F.when(F.col(flag), F.lit(yes)).otherwise(F.lit(no)).alias("side")
    parts = [day.select(F.lit("day").alias("split"), "label", "side"),
             rand.select(F.lit("random").alias("split"), "label", side("is_test", "test", "train")),
             hold.select(F.lit("zero_day").alias("split"), "label", side("is_holdout", "holdout", "base"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("split", "label", "side").agg(
        F.count(F.lit(1)).alias("n"))


@register("label_index", "M3", S.with_(S.FLOWS) + """
SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS DOUBLE) AS label_index
FROM (SELECT DISTINCT label FROM flows WHERE day IN ('Monday', 'Tuesday', 'Wednesday')) t""")
def q_label_index(spark, sf):
    from ..sources.flows import events_flows
    train = SP.day_split(events_flows(spark, sf)).where(F.col("side") == "train")
    return ML.label_index(train)


# The columns the models learn from, in their order.
_GRAPH = ("fan_out", "fan_in", "pagerank", "degree_ratio_change", "novelty_score", "flow_volume", "byte_volume",
          "fan_out_zscore", "fan_in_zscore", "novelty_zscore", "flow_volume_zscore", "byte_volume_zscore")
_MODEL_COLS = ("bytes", "dst_port", *(f"{end}_{f}" for end in ("src", "dst") for f in _GRAPH))


def _model_source(c: str) -> str:
    if c in ("bytes", "dst_port"):
        return f"fl.{c}"
    return f"{c[0]}{'p' if c[4:] == 'pagerank' else ''}.{c[4:]}"


_MODEL_CTES = S.with_(S.FLOWS, S.edges("1 day"), S.HOST_BUCKET, S.BASELINES, S.pagerank_ctes())
_MODEL_ROWS = (f"SELECT fl.row_id, {', '.join(f'{_model_source(c)} AS {c}' for c in _MODEL_COLS)} FROM {{source}} fl " + " ".join(
    f"LEFT JOIN {t} {a} ON {a}.bucket = date_trunc('day', fl.ts) AND {a}.host = fl.{e}"
    for t, a, e in (("hf", "s", "src"), ("hf", "d", "dst"), ("pr", "sp", "src"), ("pr", "dp", "dst"))))

_MEDIAN_SQL = _MODEL_CTES + f"""
, ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || row_id), row_id) AS r, count(*) OVER () AS k
             FROM flows WHERE label = 'BENIGN'),
t AS MATERIALIZED ({_MODEL_ROWS.format(source="ranked")} WHERE fl.r > round_even(fl.k * 0.2, 0))
""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median, "
                         f"count(*) - count({c}) AS n_missing FROM t" for c in _MODEL_COLS)


@register("impute_median", "M6", _MEDIAN_SQL)
@register("impute_median_all", "M6", _MEDIAN_SQL)
def q_impute_median(spark, sf):
    """Exact medians and missing values of every column the models impute."""
    return _medians(spark, sf, ML.feature_columns(ST.labelled(spark, sf), True))


@register("model_matrix", "P8,P9", _MODEL_CTES + ", m AS (" + _MODEL_ROWS.format(source="flows") + ") SELECT row_id, " + ", ".join(
    f"round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 6) AS {c}" for c in _MODEL_COLS) + " FROM m")
def q_model_matrix(spark, sf):
    """The columns the models choose, as floats, of every flow."""
    data = ST.labelled(spark, sf)
    cols = ML.feature_columns(data, True)
    return rounded(ML.as_float(data, cols).select("row_id", *[F.col(c).cast("double").alias(c) for c in cols]))


def _medians(spark, sf, cols):
    """Exact medians (a distributed rank, no group in one task) and missing values of the 80 %
    of benign rows, on all days, that the isolation forest learns from."""
    from ..operators import scan
    h = SP.holdout_class(ST.labelled(spark, sf), "label", "BENIGN", "row_id", 0.2, 42)
    benign = h.where((F.col("label") == "BENIGN") & ~F.col("is_holdout"))
    long = benign.select("row_id", F.explode(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])).alias("v")).select(
        "row_id", "v.*")
    # counted beside one another, not as rows: the exploded rows are made once, for the ranks
    missing = benign.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).where(
        "_n > 0").select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_missing"))
                                             for c in cols])).alias("m")).select("m.*")
    q = scan.exact_quantiles(long, "feature", "value", ["row_id"], (0.5,))
    return rounded(missing.join(q, "feature", "left").select("feature", F.col("quantile").alias("median"), "n_missing"))


@register("feature_gain", "M14")
def q_feature_gain(spark, sf):
    data = ST.day_labelled(spark, sf)
    cols = ML.feature_columns(data, True)
    return rounded(ML.gain_importance(spark, ST.day_split_model(spark, sf), cols, 20))


@register("feature_mean_gain", "M14")
def q_feature_mean_gain(spark, sf):
    """Mean gain per split of each feature over the saved trees' nodes, and whether it is a graph feature;
    the 20 largest."""
    cols = ML.feature_columns(ST.day_labelled(spark, sf), True)
    return rounded(ML.mean_gain(spark, ST.day_split_model(spark, sf), ST.model_path(spark, sf), cols, 20))


@register("score_rule", "M8", S.with_(S.FLOWS) + "SELECT row_id, TRUE AS class_is_likelier FROM flows")
def q_score_rule(spark, sf):
    """On every flow the class is 1 exactly where its probability is more than one half."""
    s = ST.scored_flows(spark, sf)
    return s.select("row_id", ((F.col("pred") == 1) == (F.col("attack_probability") > 0.5)).alias("class_is_likelier"))


@register("model_roundtrip", "A9", S.with_(S.FLOWS) + "SELECT row_id, TRUE AS equal FROM flows")
def q_model_roundtrip(spark, sf):
    """Save -> load -> score: class and probability of the reloaded model equal the original's
    on every flow."""
    data = ST.labelled(spark, sf)
    model = ST.day_split_model(spark, sf)
    path = scratch_path(spark, "model-roundtrip")
    ML.save_model(model, path)
    rows = ML.as_float(data, ML.feature_columns(data, True))
    a = ST.scored_flows(spark, sf).select("row_id", "pred", "attack_probability")
    with compilable_methods(spark):
        b = materialize(ML.score(ML.load_model(path), rows).select(
            "row_id", F.col("pred").alias("again"), F.col("attack_probability").alias("again_probability")))
    return a.join(b, "row_id").select("row_id", ((F.col("pred") == F.col("again")) & (
        F.col("attack_probability") == F.col("again_probability"))).alias("equal"))


@register("zero_day", "M5")
def q_zero_day(spark, sf):
    """Each attack class left out of training in turn (a stage, like the fitted model)."""
    return ST.cached(spark, sf, "zero-day", lambda: _zero_day(spark, sf))


def _zero_day(spark, sf):
    data = ST.labelled(spark, sf)
    cols = ML.feature_columns(data, True)
    flagged = SP.holdout_class(data, "label", "BENIGN", "row_id", 0.1, 42)
    base, hold = flagged.where(~F.col("is_holdout")), flagged.where(F.col("is_holdout"))
    # the protocol trains one model per class: its loop is over the class names
    classes = sorted((r[0] for r in data.where(F.col("y") == 1).select("label").distinct().collect()),
                     key=lambda c: (c is None, c))
    rows = ML.zero_day_rates(base, hold, cols, classes)
    return rounded(spark.createDataFrame(rows, "class string, support long, zero_day_catch_rate double, "
                                               "benign_fpr double"))


@register("isolation_forest", "M7")
def q_isolation_forest(spark, sf):
    """Catch rates of the isolation forest (a stage, like the fitted model)."""
    return ST.cached(spark, sf, "isolation-forest", lambda: _isolation_forest(spark, sf))


def _isolation_forest(spark, sf):
    """Forest fitted on 80 % of benign rows (median-imputed with train statistics);
    catch rate per attack class and false-positive rate on the benign holdout."""
    data = ST.labelled(spark, sf)
    cols = ML.feature_columns(data, True)
    h = SP.holdout_class(data, "label", "BENIGN", "row_id", 0.2, 42)
    benign_train = h.where(F.col("label").eqNullSafe("BENIGN") & ~F.col("is_holdout"))
    imp = ML.imputer(cols).fit(ML.as_float(benign_train, cols))
    out_cols = imp.getOutputCols()

    def prep(df):
        return imp.transform(ML.as_float(df, cols)).select("row_id", "label", "is_holdout", *out_cols)

    forest = IF.fit(prep(benign_train), out_cols)
    scored = IF.score(prep(h.where(~F.col("label").eqNullSafe("BENIGN") | F.col("is_holdout"))), forest, out_cols)
    return rounded(M.recall_per_class(scored.withColumn("pred", F.col("is_outlier").cast("int"))))


@register("pivot_check", "M17", CHAIN_SQL + """
SELECT row_id, dst, ts FROM tl WHERE is_novel_destination AND starts_with(dst, '192.168.')""")
def q_pivot_check(spark, sf):
    """The pivot flows of the chain (novel internal destinations of patient zero among all
    flows); every one of them is scored by the day-split model (see ``pivot_scores``)."""
    return _pivot_scores(spark, sf).select("row_id", "dst", "ts")


@register("pivot_scores", "M17")
def q_pivot_scores(spark, sf):
    return rounded(_pivot_scores(spark, sf))


def _pivot_scores(spark, sf):
    from .q_chain import timeline
    tl, _ = timeline(spark, sf)
    piv = tl.where(F.col("is_novel_destination") & is_internal_ip("dst")).select("row_id")
    data = ST.labelled(spark, sf)
    rows = data.join(piv, "row_id", "left_semi")
    n_ids, n_rows = piv.count(), rows.count()
    if n_ids != n_rows:          # every pivot id must match exactly one flow
        raise ValueError(f"{n_ids} pivots, but {n_rows} rows match them")
    s = ML.score(ST.day_split_model(spark, sf), ML.as_float(rows, ML.feature_columns(data, True)))
    return s.select("row_id", "dst", "ts", F.col("pred").cast("boolean").alias("flagged"),
                    F.col("attack_probability").alias("probability"))


def model_timeline(spark, sf):
    """The post-compromise timeline with the saved model's flag in place of the byte rule."""
    from .q_chain import timeline
    tl, t0 = timeline(spark, sf)
    data = ST.labelled(spark, sf)
    s = ML.score(ST.day_split_model(spark, sf), ML.as_float(
        data.join(tl.select("row_id"), "row_id", "left_semi"), ML.feature_columns(data, True)))
    return tl.drop("flagged").join(s.select("row_id", F.col("pred").cast("boolean").alias("flagged")), "row_id"), t0


@register("model_chain_timeline", "G5,M8", CHAIN_SQL + """
SELECT row_id, dst, ts, is_novel_destination, cumulative_distinct_destinations, n_prior_destinations FROM tl""")
def q_model_chain_timeline(spark, sf):
    """The timeline scored by the model keeps every flow (the flag itself is the model's)."""
    tl, _ = model_timeline(spark, sf)
    return tl.where("flagged IS NOT NULL").select("row_id", "dst", "ts", "is_novel_destination",
                                                  "cumulative_distinct_destinations", "n_prior_destinations")


@register("model_pivot_summary", "G6,M8")
def q_model_pivot_summary(spark, sf):
    from ..operators import chain as CH
    return CH.pivot_summary(model_timeline(spark, sf)[0])


@register("model_novel_summary", "G7,M8")
def q_model_novel_summary(spark, sf):
    from ..operators import chain as CH
    return CH.novel_summary(model_timeline(spark, sf)[0])


@register("model_chain_headline", "G8,M8")
def q_model_chain_headline(spark, sf):
    from ..operators import chain as CH
    tl, t0 = model_timeline(spark, sf)
    return rounded(CH.chain_headline(tl, t0))


@register("model_mttd", "T3,M8")
def q_model_mttd(spark, sf):
    from ..operators import mttd as MT
    return rounded(MT.mttd_table(model_timeline(spark, sf)[0]))


@register("detection_regimes", "J6,M1,M5,M7")
def q_detection_regimes(spark, sf):
    """Per attack class: caught by a model that has seen the class (random split), by one that
    has not (zero-day), and by the isolation forest."""
    data = ST.labelled(spark, sf)
    cols = ML.feature_columns(data, True)
    rand = SP.stratified_split(data, ["label"], "row_id", 0.2, 42)

    def known_classes():
        model = ML.boosted(rand.where("NOT is_test"), cols)
        return M.recall_per_class(ML.boosted_scores(rand.where("is_test"), model))

    with ThreadPoolExecutor(3) as pool:                  # the regimes are independent of one another
        parts = [pool.submit(f) for f in (known_classes, lambda: q_zero_day(spark, sf), lambda: q_isolation_forest(spark, sf))]
        known, zero, forest = (p.result() for p in parts)
    support = data.where("y = 1").groupBy("label").agg(F.count(F.lit(1)).alias("support"))
    return rounded(support.join(known.select("label", F.col("recall").alias("known_catch_rate")), "label", "left")
                   .join(zero.select(F.col("class").alias("label"), "zero_day_catch_rate"), "label", "left")
                   .join(forest.select("label", F.col("recall").alias("isolation_forest_catch_rate")), "label", "left"))


def _explained_sample(spark, sf):
    """Stratified test-day sample (<= 500 rows per label), scored and explained.  The sample and its explanations
    are made once; every leaf costs a task the same however few rows it has, so there are no more tasks than cores."""
    from ..operators import attribution as AT
    data = ST.day_labelled(spark, sf)
    cols = ML.feature_columns(data, True)
    model = ST.day_split_model(spark, sf)
    sample = materialize(ML.as_float(
        SP.stratified_sample(data.where(F.col("side") == "test"), "label", 500, "row_id", 42), cols)).coalesce(
        spark.sparkContext.defaultParallelism)
    scored = ML.score(model, sample).select("row_id", "pred")
    ex = materialize(AT.explain(spark, model, ST.model_path(spark, sf), sample, cols))
    return ex.join(scored, "row_id"), cols


@register("attribution_rank", "M15")
def q_attribution_rank(spark, sf):
    """Mean |phi| per feature over the sample, top 20, with the graph-feature flag."""
    from ..operators import attribution as AT
    ex, cols = _explained_sample(spark, sf)
    r = AT.rank_features(AT.long_form(ex, cols), 20)
    graph = F.array(*[F.lit(c) for c in cols if ML.is_graph_feature(c)])
    return rounded(r.withColumn("is_graph_feature", F.array_contains(graph, F.col("feature"))))


@register("attribution_share", "M16")
def q_attribution_share(spark, sf):
    """Per label over all test rows: recall, mean total |phi| and the share of graph features in it."""
    from ..operators import attribution as AT
    data = ST.day_labelled(spark, sf)
    cols = ML.feature_columns(data, True)
    model = ST.day_split_model(spark, sf)
    with compilable_methods(spark):
        scored = ML.score(model, ML.as_float(data.where(F.col("side") == "test"), cols))
        ex = AT.explain(spark, model, ST.model_path(spark, sf), scored, cols, ("row_id", "label", "pred"))
        return materialize(rounded(AT.share_by_label(ex, cols, [ML.is_graph_feature(c) for c in cols])))


@register("attribution_check", "M15", S.with_(S.FLOWS) + """
SELECT CAST(sum(least(n, 500)) AS BIGINT) AS n_rows, TRUE AS locally_accurate
FROM (SELECT label, count(*) AS n FROM flows WHERE day IN ('Thursday', 'Friday') GROUP BY 1) c""")
def q_attribution_check(spark, sf):
    """Local accuracy of the attributions: base + sum(phi) equals the model's log-odds on every
    row of the sample (to 1e-9)."""
    from pyspark.ml.functions import vector_to_array
    ex, cols = _explained_sample(spark, sf)
    data = ST.day_labelled(spark, sf)
    raw = (ST.day_split_model(spark, sf).transform(ML.as_float(data.join(ex.select("row_id"), "row_id", "left_semi"), cols))
           .select("row_id", (2 * vector_to_array("rawPrediction")[1]).alias("model_logit")))
    j = ex.join(raw, "row_id")
    return j.agg(F.count(F.lit(1)).alias("n_rows"),
                 (F.max(F.abs(F.col("logit") - F.col("model_logit"))) < 1e-9).alias("locally_accurate"))


def _f1_run(train, test, cols):
    return M.f1_binary(ML.boosted_scores(test, ML.boosted(train, cols))).first()["f1"]


@register("f1_by_feature_set", "M1,M9,M13,S3,S4,G1")
def q_f1_by_feature_set(spark, sf):
    """The detection experiment: binary F1 of the attack class for flow-only features, then
    + graph features (day buckets), + 5-minute graph features, + per-flow novelty, on the
    day split; flow-only vs + graph on a random row split of all flows (leaks bucket-scoped
    features) and vs + hourly graph features on the hour-grouped split (does not).  One row per run with
    the delta to flow-only on the same split."""
    from ..operators.novelty import flow_novelty_both
    day, every = ST.day_labelled(spark, sf), ST.labelled(spark, sf)
    hour = ST.labelled(spark, sf, "1 hour")
    fine = ST.day_labelled(spark, sf, "5 minutes")
    novel = flow_novelty_both(ST.labelled(spark, sf).select("row_id", "src", "dst", "ts")).select(
        "row_id", F.col("novel_dst_for_src").cast("int").alias("novel_dst_for_src"),
        F.col("novel_src_for_dst").cast("int").alias("novel_src_for_dst"))
    fine_nov = fine.join(novel, "row_id", "left")
    flow_cols = ML.feature_columns(day, False)
    runs = []

    def add(split, name, df, cols, train, test):
        runs.append((split, name, len(cols), df.where(train), df.where(test), cols))

    tr, te = F.col("side") == "train", F.col("side") == "test"
    add("day", "flow", day, flow_cols, tr, te)
    add("day", "flow+graph", day, ML.feature_columns(day, True), tr, te)
    add("day", "flow+graph_5min", fine, ML.feature_columns(fine, True), tr, te)
    add("day", "flow+graph_5min+novelty", fine_nov,
        ML.feature_columns(fine, True) + ["novel_dst_for_src", "novel_src_for_dst"], tr, te)
    # the leaking protocol: a random row split lets rows of one host-bucket (which share
    # every graph feature) fall on both sides
    rows = SP.stratified_split(every, ["y"], "row_id", 0.2, 42)
    add("row_random", "flow", rows, flow_cols, ~F.col("is_test"), F.col("is_test"))
    add("row_random", "flow+graph", rows, ML.feature_columns(day, True), ~F.col("is_test"), F.col("is_test"))
    # features and groups have the same hour: no host-bucket has rows on both sides
    hourly = SP.group_split(hour, "bucket", 0.2, 42)
    add("hour_grouped", "flow", hourly, flow_cols, ~F.col("is_test"), F.col("is_test"))
    add("hour_grouped", "flow+graph_hourly", hourly, ML.feature_columns(hour, True), ~F.col("is_test"), F.col("is_test"))
    with ThreadPoolExecutor(len(runs)) as pool:          # independent fits side by side
        f1 = list(pool.map(lambda r: float(_f1_run(*r[3:])), runs))
    df = spark.createDataFrame([(*r[:3], x) for r, x in zip(runs, f1)],
                               "split string, feature_set string, n_features int, f1 double")
    from pyspark.sql import Window
    base = F.max(F.when(F.col("feature_set") == "flow", F.col("f1"))).over(Window.partitionBy("split"))
    return rounded(df.withColumn("delta_vs_flow", F.col("f1") - base))
