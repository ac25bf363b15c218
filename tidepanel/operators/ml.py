"""Feature selection, scaling, weights, fold training with Spark ML, ensemble scores, attribution."""
from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import wide
from ..functions.scale import exact_quantiles, with_row
from ..functions.windows import Series, clip, col, nz

C = F.col


# --- selection ---------------------------------------------------------------------------------

def time_blocks(df: DataFrame, blocks: int = 3, p: Series = Series()) -> DataFrame:
    """Block number 0..blocks-1 by position in each symbol's series."""
    n = F.count(F.lit(1)).over(p.whole)
    return df.withColumn("block", F.least(F.floor(p.row() * blocks / n), F.lit(blocks - 1)).cast("int"))


def mutual_information(df: DataFrame, features: list[str], label: str, keys: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Binned mutual information (nats) of each feature with the 0/1 label, per key.

    Bin edges are exact quantiles per (key, feature). What is shuffled is the contingency table, whose size does not grow with the rows.
    """
    keys = keys or []
    d = df.where(C(label).isNotNull())
    edges = wide.edges_of(wide.quantiles(d, features, [i / bins for i in range(1, bins)], keys), keys)
    cnt = wide.contingency(d, features, edges, label, 2, keys).withColumn("n", C("n").cast("double"))
    w = Window.partitionBy(*keys, "feature")
    tot, nb, ny = F.sum("n").over(w), F.sum("n").over(w.partitionBy(*keys, "feature", "bin")), F.sum("n").over(w.partitionBy(*keys, "feature", label))
    cnt = cnt.withColumns({"_t": tot, "_b": nb, "_y": ny})
    return cnt.groupBy(*keys, "feature").agg(F.sum(C("n") / C("_t") * F.ln(C("n") * C("_t") / (C("_b") * C("_y")))).alias("mi"))


def stable_mi(df: DataFrame, features: list[str], label: str, blocks: int = 3) -> DataFrame:
    """Median over time blocks, discounted by its coefficient of variation. A table may bring its ``block`` along."""
    m = mutual_information(df if "block" in df.columns else time_blocks(df, blocks), features, label, ["block"])
    a = m.groupBy("feature").agg(F.percentile("mi", F.lit(0.5)).alias("_m"), F.stddev_pop("mi").alias("_s"))
    return a.select("feature", (C("_m") / (1.0 + C("_s") / (C("_m") + 1e-8))).alias("mi"))


def tree_importance(df: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 4, seed: int = 42) -> DataFrame:
    d = assemble(df, features, label)
    model = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed).fit(d)
    imp = model.featureImportances.toArray().tolist()
    return df.sparkSession.createDataFrame(list(zip(features, imp)), "feature string, importance double")


def combined_rank(mi: DataFrame, importance: DataFrame, w_mi: float = 0.6, w_tree: float = 0.4) -> DataFrame:
    """Weighted percentile ranks; tables hold one row per feature."""
    d = mi.join(importance, "feature")
    one = Window.partitionBy(F.lit(1))
    def pr(x):
        ties = F.count(F.lit(1)).over(Window.partitionBy(x))
        return (F.rank().over(one.orderBy(x)) + (ties - 1) / 2.0) / F.count(F.lit(1)).over(one)
    return d.withColumn("score", w_mi * pr("mi") + w_tree * pr("importance"))


def assemble(df: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    clean = [F.coalesce(F.when(F.isnan(c) | (F.abs(C(c)) == float("inf")), None).otherwise(C(c)).cast("double"), F.lit(0.0)).alias(c) for c in features]
    rest = [c for c in df.columns if c not in features]
    d = df.select(*rest, *clean)
    if label and label != "label":
        d = d.withColumn("label", C(label).cast("double"))
    elif label:
        d = d.withColumn("label", C("label").cast("double"))
    return VectorAssembler(inputCols=features, outputCol="features").transform(d)


def prune_correlated(df: DataFrame, ranked: list[str], max_corr: float = 0.85, n: int = 15) -> list[str]:
    """Greedy walk over the ranked names on the k x k correlation matrix Spark computed once."""
    m = Correlation.corr(assemble(df, ranked).select("features"), "features").head()[0].toArray()
    keep: list[int] = []
    for i in range(len(ranked)):
        if len(keep) == n:
            break
        if all(not abs(m[i, j]) >= max_corr for j in keep):
            keep.append(i)
    return [ranked[i] for i in keep]


class FeatureSelector:
    """Fit on the train slice only, then project."""

    def __init__(self, n: int = 15, max_corr: float = 0.85, blocks: int = 0):
        self.n, self.max_corr, self.blocks = n, max_corr, blocks
        self.selected: list[str] = []

    def fit(self, df: DataFrame, features: list[str], label: str) -> "FeatureSelector":
        mi = stable_mi(df, features, label, self.blocks) if self.blocks else mutual_information(df, features, label)
        rank = combined_rank(mi, tree_importance(df, features, label))
        # one row per feature reaches the driver
        order = [r["feature"] for r in rank.orderBy(F.desc("score"), "feature").collect()]
        self.selected = prune_correlated(df, order, self.max_corr, self.n)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select("symbol", "ts", *[F.coalesce(C(c), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in self.selected])


# --- scaling and weights -----------------------------------------------------------------------

def scaler_stats(df: DataFrame, features: list[str], regime: str | None = None, low: float = 0.01, high: float = 0.99, eps: float = 1e-8) -> DataFrame:
    """feature[, regime], n, lo, hi, median, iqr. Quartiles are of the clipped values: clipping at the
    1st and 99th percentile leaves the inner quartiles and the median where they are."""
    keys = ([regime] if regime else [])
    q = wide.quantiles(df, features, [low, 0.25, 0.5, 0.75, high], keys)
    counts = [F.count(F.nanvl(C(f).cast("double"), F.lit(None).cast("double"))).alias(f) for f in features]
    n = df.groupBy(*keys).agg(*counts) if keys else df.agg(*counts)
    n = n.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), C(f).alias("n")) for f in features])).alias("_x")).select(*keys, "_x.*")
    def at(x):
        return F.max(F.when(F.abs(C("q") - x) < 1e-9, C("value")))
    s = q.groupBy(*keys, "feature").agg(at(low).alias("lo"), at(high).alias("hi"), at(0.5).alias("median"), (at(0.75) - at(0.25)).alias("_iqr"))
    return s.join(n, [*keys, "feature"]).withColumn("iqr", F.greatest("_iqr", F.lit(eps))).drop("_iqr")


def robust_scale(df: DataFrame, features: list[str], stats: DataFrame, regime_stats: DataFrame | None = None, regime: str = "regime",
                 min_regime_rows: int = 50) -> DataFrame:
    """df with every feature winsorised, centred on the median and divided by the quartile range; the regime's own statistics where it has
    enough rows, else the global ones. Statistics travel as one array per regime, so a row is neither turned nor shuffled."""
    pick = ("lo", "hi", "median", "iqr")
    packed = F.array(*[F.max(F.when(C("feature") == f, F.struct(*pick))) for f in features])
    whole = stats.agg(packed.alias("_g"))
    d = with_row(df, whole)
    at = lambda i: F.get("_g", F.lit(i))
    if regime_stats is not None:
        own = regime_stats.where(C("n") >= min_regime_rows).groupBy(regime).agg(packed.alias("_r"))
        d = d.join(F.broadcast(own), regime, "left")
        at = lambda i: F.coalesce(F.get("_r", F.lit(i)), F.get("_g", F.lit(i)))
    out = {}
    for i, f in enumerate(features):
        v = F.nanvl(C(f).cast("double"), F.lit(None).cast("double"))
        out[f] = F.when(v.isNotNull(), (F.least(F.greatest(v, at(i)["lo"]), at(i)["hi"]) - at(i)["median"]) / at(i)["iqr"])
    return d.withColumns(out).drop("_g", "_r")


def recency_weights(df: DataFrame, halflife: int = 63, cap: float = 4.6, p: Series = Series()) -> DataFrame:
    """Exponential weights with mean 1, oldest at least e**-cap of the newest."""
    age = (F.count(F.lit(1)).over(p.whole) - 1 - p.row()) / float(halflife)
    d = df.withColumn("_w", F.exp(-F.least(age, F.lit(cap))))
    return d.withColumn("recency_weight", C("_w") / F.avg("_w").over(p.whole)).drop("_w")


def regime_weight(regime="regime") -> Column:
    r = col(regime)
    return F.when(r.isin(2, 0), 2.0).when(r == 3, 1.5).otherwise(1.0)


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """Weight that balances the two classes."""
    a = df.agg(F.count_if(C(label) == 0).alias("_n0"), F.count_if(C(label) == 1).alias("_n1"))
    return with_row(df, a).withColumn("class_weight", F.when(C(label) == 1, C("_n0") / nz(C("_n1").cast("double"))).otherwise(1.0)).drop("_n0", "_n1")


# --- training ----------------------------------------------------------------------------------

def members(size: int = 3, seed: int = 42, iterations: int = 10, depth: int = 3):
    """Ensemble members with their own seeds: boosted trees, forests and a linear model in turn."""
    out = {}
    for i in range(size):
        kind = ("gbt", "rf", "lr")[i % 3]
        common = dict(labelCol="label", featuresCol="features", weightCol="weight")
        est = {"gbt": lambda: GBTClassifier(maxIter=iterations, maxDepth=depth, seed=seed + i, validationIndicatorCol="is_val", **common),
               "rf": lambda: RandomForestClassifier(numTrees=20, maxDepth=depth + 1, seed=seed + i, **common),
               "lr": lambda: LogisticRegression(maxIter=20, regParam=0.01, **common)}[kind]()
        out[f"{kind}{i}"] = est
    return out


def fit_members(train: DataFrame, ests: dict) -> dict:
    return {name: est.fit(train) for name, est in ests.items()}


def score_members(df: DataFrame, models: dict) -> DataFrame:
    """P(up) of each member in an array column."""
    d = df
    for name, m in models.items():
        drop = [c for c in ("rawPrediction", "probability", "prediction") if c in d.columns]
        d = m.transform(d.drop(*drop)).withColumn(f"p_{name}", vector_to_array("probability")[1])
    d = d.drop("rawPrediction", "probability", "prediction")
    return d.withColumn("member_p", F.array(*[C(f"p_{n}") for n in models]))


# --- scores ------------------------------------------------------------------------------------

def array_quantile(arr, q: float) -> Column:
    s = F.sort_array(arr)
    pos = (F.size(arr) - 1) * F.lit(q)
    k = F.floor(pos).cast("int")
    lo, hi = F.get(s, k), F.get(s, F.least(k + 1, F.size(arr) - 1))
    return lo + (pos - k) * (hi - lo)


def ensemble_score(arr, weights=None) -> dict[str, Column]:
    """score_mean, score_std (population), score_lower and score_upper (10 / 90 % of the members)."""
    a = col(arr)
    n = F.size(a).cast("double")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    plain = total(a) / n
    mean = plain
    if weights is not None:
        w = F.transform(weights, lambda v: F.greatest(v, F.lit(0.0)))
        sw = total(w)
        mean = F.when(sw > 1e-9, total(F.zip_with(a, w, lambda x, y: x * y)) / nz(sw)).otherwise(plain)
    std = F.sqrt(F.greatest(total(F.transform(a, lambda v: v * v)) / n - plain * plain, F.lit(0.0)))
    return {"score_mean": mean, "score_std": std, "score_lower": array_quantile(a, 0.10), "score_upper": array_quantile(a, 0.90)}


def member_weights(scores: DataFrame, p: str = "member_p", y: str = "fwd_return") -> DataFrame:
    """Softmax of each member's average out-of-sample Sharpe over folds: (member, sharpe, weight)."""
    d = scores.select("fold", y, F.posexplode(p).alias("member", "prob"))
    r = C(y) * F.signum(C("prob") - 0.5)
    f = d.groupBy("fold", "member").agg((F.avg(r) / (F.stddev_samp(r) + 1e-12) * math.sqrt(252.0)).alias("s"))
    m = f.groupBy("member").agg(F.avg("s").alias("sharpe"))
    one = Window.partitionBy(F.lit(1))
    e = F.exp(F.greatest(C("sharpe") - F.max("sharpe").over(one), F.lit(-10.0)))
    m = m.withColumn("_e", e)
    return m.withColumn("weight", C("_e") / F.sum("_e").over(one)).drop("_e")


def isotonic(scores: DataFrame, score: str = "score_mean", label: str = "label"):
    """Monotone calibration of scores to probabilities, fitted on pooled out-of-sample rows."""
    d = scores.select(C(score).alias("features"), C(label).cast("double").alias("label"))
    return IsotonicRegression(featuresCol="features", labelCol="label").fit(d)


def calibrate(df: DataFrame, model, score: str = "score_mean", out: str = "calibrated") -> DataFrame:
    d = df.withColumn("features", C(score))
    return model.transform(d).withColumnRenamed("prediction", out).drop("features")


def confidence(mean, std) -> Column:
    return clip(2.0 * F.abs(col(mean) - 0.5) * (1.0 - clip(col(std) / 0.5, 0.0, 1.0)), 0.0, 1.0)


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(x, -30.0, 30.0)))


def signal(mean, conf, threshold: float) -> Column:
    """Direction of p - 0.5 where the confidence suffices."""
    return F.when(col(conf) >= threshold, F.signum(col(mean) - 0.5)).otherwise(0.0).cast("int")


def threshold_signal(p, threshold: float = 0.55) -> Column:
    return F.when(col(p) > threshold, 1).when(col(p) < 1.0 - threshold, -1).otherwise(0)


def nontrivial(df: DataFrame, y: str = "fwd_return", keys=("fold",), share: float = 0.25) -> DataFrame:
    """Rows whose move exceeds a quarter of the fold's median move (exact median of any fold size)."""
    med = exact_quantiles(df.withColumn("_a", F.abs(y)), list(keys), "_a", [0.5]).select(*keys, C("value").alias("_med"))
    return df.join(F.broadcast(med), list(keys)).where(F.abs(y) > share * C("_med")).drop("_med")


def meta_model(scores: DataFrame, features: list[str], seed: int = 77777):
    """Second model: is the primary direction right? Trained on out-of-sample rows with non-trivial moves."""
    d = nontrivial(scores).withColumn("prim_sig", F.signum(C("score_mean") - 0.5))
    d = d.withColumn("meta", ((C("prim_sig") * F.signum("fwd_return")) > 0).cast("double")).drop("label")
    v = assemble(d, [*features, "prim_sig"], "meta")
    return GBTClassifier(labelCol="label", featuresCol="features", maxIter=10, maxDepth=2, seed=seed).fit(v)


def meta_probability(df: DataFrame, model, features: list[str]) -> DataFrame:
    """P(primary is right); 1 where no meta model exists."""
    if model is None:
        return df.withColumn("meta_p", F.lit(1.0))
    d = df.withColumn("prim_sig", F.signum(C("score_mean") - 0.5))
    v = model.transform(assemble(d, [*features, "prim_sig"]))
    return v.withColumn("meta_p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction", "prim_sig")


def accuracy_weights(scores: DataFrame, p: str = "member_p", label: str = "label", keys: tuple[str, ...] = ()) -> DataFrame:
    """Weights in proportion to max(0, accuracy - 0.5), equal when no member beats a coin; per key. The rows should be such that neither the
    members were fitted on nor the weights are used for."""
    d = scores.select(*keys, label, F.posexplode(p).alias("member", "prob"))
    a = d.groupBy(*keys, "member").agg(F.avg(((C("prob") > 0.5).cast("double") == C(label).cast("double")).cast("double")).alias("accuracy"))
    one = Window.partitionBy(*(keys or [F.lit(1)]))
    e = F.greatest(C("accuracy") - 0.5, F.lit(0.0))
    a = a.withColumn("_e", e).withColumn("_t", F.sum("_e").over(one))
    return a.withColumn("weight", F.when(C("_t") > 1e-9, C("_e") / nz("_t")).otherwise(1.0 / F.count(F.lit(1)).over(one))).drop("_e", "_t")


def vote(arr) -> Column:
    a = col(arr)
    return F.size(F.filter(a, lambda v: v > 0.5)) / F.size(a).cast("double")


def stack(scores: DataFrame, size: int):
    """Linear model on the member scores."""
    d = scores.select(C("label").cast("double").alias("label"), *[C("member_p")[i].alias(f"m{i}") for i in range(size)])
    v = VectorAssembler(inputCols=[f"m{i}" for i in range(size)], outputCol="features").transform(d)
    return LogisticRegression(labelCol="label", featuresCol="features", maxIter=50).fit(v)


def stacked(scores: DataFrame, model, size: int) -> DataFrame:
    """Adds the probability that the linear model gives to the members' scores."""
    d = scores.withColumns({f"m{i}": C("member_p")[i] for i in range(size)})
    s = model.transform(VectorAssembler(inputCols=[f"m{i}" for i in range(size)], outputCol="features").transform(d))
    return s.withColumn("stacked", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction", *[f"m{i}" for i in range(size)])


def stack_weights(scores: DataFrame, size: int, key: str = "fold", label: str = "label", penalty: float = 1.0, rounds: int = 10) -> DataFrame:
    """(key, coef): intercept and weights of a logistic model of the label on the members' scores, one per key; ridge ``penalty`` on the weights.

    Newton's steps from zero for all keys at once: a step is one aggregate of gradient and curvature, one row per key comes back. Keys are few,
    such as folds; one whose labels are all equal has no model. ``scores`` is read in every round."""
    y, x = C(label).cast("double"), [F.lit(1.0), *[C("member_p")[i] for i in range(size)]]
    d = scores.where(C(label).isNotNull())
    both = d.groupBy(key).agg(F.min(y).alias("a"), F.max(y).alias("b")).where("a < b").select(key).collect()
    coef, kind = {r[0]: np.zeros(size + 1) for r in both}, d.schema[key].dataType.simpleString()
    ridge = np.diag([0.0, *[penalty] * size])
    given = lambda: d.sparkSession.createDataFrame([(k, v.tolist()) for k, v in coef.items()], f"{key} {kind}, coef array<double>")
    for _ in range(rounds if coef else 0):
        q = sigmoid(sum(C("coef")[i] * x[i] for i in range(size + 1)))
        v = d.join(F.broadcast(given()), key).withColumns({"_q": q, "_y": y})
        sums = [F.sum((C("_y") - C("_q")) * e) for e in x] + [F.sum(C("_q") * (1.0 - C("_q")) * x[i] * x[j]) for i in range(size + 1) for j in range(size + 1)]
        for r in v.groupBy(key).agg(*sums).collect():
            g, h = np.array(r[1:size + 2]), np.array(r[size + 2:]).reshape(size + 1, size + 1)
            coef[r[0]] = coef[r[0]] + np.linalg.solve(h + ridge, g - ridge @ coef[r[0]])
    return given()


def stacked_score(coef, arr="member_p") -> Column:
    """Probability by the coefficients of ``stack_weights``; null without any."""
    c, a = col(coef), col(arr)
    return sigmoid(F.aggregate(F.zip_with(F.slice(c, 2, F.size(a)), a, lambda w, v: w * v), c[0], lambda s, v: s + v))


# --- attribution -------------------------------------------------------------------------------

def attribution(df: DataFrame, features: list[str], signal_col: str = "signal", importance: DataFrame | None = None) -> DataFrame:
    """Adds contributions, an array of (feature, value, importance) of every row: distance from the feature's mean signed by the signal, or tree
    importance signed the same way. Contributions below 1e-10 are left out; the rest are rounded to nine digits, so equal ones tie."""
    base = df.agg(F.array(*[F.avg(F.nanvl(C(f).cast("double"), F.lit(None).cast("double"))) for f in features]).alias("_b"))
    d = with_row(df, base)
    if importance is not None:
        d = with_row(d, importance.agg(F.array(*[F.max(F.when(C("feature") == f, C("importance"))) for f in features]).alias("_i")))
    parts = []
    for i, f in enumerate(features):
        v = F.nanvl(C(f).cast("double"), F.lit(None).cast("double"))
        dev = v - F.get("_b", F.lit(i))
        imp = F.abs(dev) * F.signum(dev * C(signal_col) + 1e-9) if importance is None else F.get("_i", F.lit(i)) * F.signum(dev) * F.signum(signal_col)
        parts.append(F.struct(F.lit(f).alias("feature"), v.alias("value"), F.round(imp, 9).alias("importance")))
    kept = F.filter(F.array(*parts), lambda x: F.abs(x["importance"]) >= 1e-10)
    return d.withColumn("contributions", kept).drop("_b", "_i")


def attribution_rows(attr: DataFrame) -> DataFrame:
    """One row per contribution: symbol, ts, feature, value, importance, direction."""
    d = attr.select("symbol", "ts", F.explode("contributions").alias("x")).select("symbol", "ts", "x.*")
    return d.withColumn("direction", F.when(C("importance") > 0, "bullish").otherwise("bearish"))


def top_attributions(attr: DataFrame, k: int = 10) -> DataFrame:
    """The k strongest contributions of every row as a sorted array: (symbol, ts, top). Rows without any are left out; nothing is shuffled."""
    arr = F.sort_array(F.transform("contributions", lambda x: F.struct((-F.abs(x["importance"])).alias("o"), x["feature"].alias("feature"), x["importance"].alias("importance"))))
    top = F.transform(F.slice(arr, 1, k), lambda s: F.struct(s["feature"].alias("feature"), s["importance"].alias("importance")))
    return attr.where(F.size("contributions") > 0).select("symbol", "ts", top.alias("top"))


def importance_summary(attr_top: DataFrame, newest: int = 30) -> DataFrame:
    """Mean absolute importance and appearances per feature over the newest explanations."""
    recent = attr_top.orderBy(F.desc("ts"), "symbol").limit(newest)
    x = recent.select(F.explode("top").alias("t"))
    return x.groupBy(C("t.feature").alias("feature")).agg(F.avg(F.abs("t.importance")).alias("mean_abs_importance"), F.count(F.lit(1)).alias("n_appearances"))
