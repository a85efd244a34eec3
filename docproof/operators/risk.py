"""Statistical certification of acceptance thresholds: labels, refit of weights, design effect, exact tails, the walk.

What grows with the data stays in Spark; the driver sees sums of fixed size (moments of the features) and cumulative
counts by distinct score, which are rounded to four places, so at most 10 001 rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA = {"normal": 0.01, "high_stakes": 0.003}
DELTA = 0.05
LEAST_FIT = 300


def half(doc_id: Column | str) -> Column:
    """fit or cal, by the first byte of the id's digest."""
    return F.when(F.conv(F.substring(F.sha2(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), 256), 1, 2), 16, 10).cast("int") < 128, "fit").otherwise("cal")


def same_label(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    near = F.abs(a.try_cast("decimal(18,4)") - b.try_cast("decimal(18,4)")) < F.lit("0.005").cast("decimal(9,3)")
    return F.coalesce(near, a.eqNullSafe(b))


def labelled(fields: DataFrame, docs: DataFrame) -> DataFrame:
    """Fields of reviewed documents whose outcome is known, with wrong: corrected to something else, confirmed, or
    untouched on a sampled document."""
    rows = fields.join(docs.where("reviewed_at is not null").select("doc_id", "is_qa_sample"), "doc_id")
    wrong = F.when(F.col("status") == "corrected", ~same_label("final_value", "value")).when((F.col("status") == "confirmed") | (F.col("is_qa_sample") & (F.col("status") == "auto")), F.lit(False))
    return rows.withColumn("wrong", wrong).where("wrong is not null")


def design_effect(rows: DataFrame) -> DataFrame:
    """One row: fields, documents, intra-document correlation of errors (ANOVA estimate, at least 0), mean size, effect."""
    groups = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("wrong").cast("int")).alias("k"))
    m, k = F.col("m").cast("double"), F.col("k").cast("double")
    sums = groups.agg(F.count(F.lit(1)).alias("groups"), F.sum("m").alias("n"), F.sum("k").alias("errors"), F.sum(m * m).alias("mm"), F.sum(k * k / m).alias("between"))
    n, g, errors = F.col("n").cast("double"), F.col("groups").cast("double"), F.col("errors").cast("double")
    ssb, ssw = F.col("between") - errors * errors / n, errors - F.col("between")
    msb, msw = ssb / F.nullif(g - 1, F.lit(0.0)), ssw / F.nullif(n - g, F.lit(0.0))
    m0 = (n - F.col("mm") / n) / F.nullif(g - 1, F.lit(0.0))
    below = msb + (m0 - 1) * msw
    icc = F.when((g < 2) | (n <= g) | (below <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), (msb - msw) / F.nullif(below, F.lit(0.0))))
    return sums.select("n", "groups", "errors", F.coalesce(icc, F.lit(0.0)).alias("icc"), (n / F.greatest(g, F.lit(1.0))).alias("mean_size")).withColumn("effect", 1 + (F.col("mean_size") - 1) * F.col("icc"))


def cumulative(rows: DataFrame) -> DataFrame:
    """score (four places), fields and errors at or above it."""
    each = rows.groupBy(F.round(F.col("score").cast("decimal(9,6)"), 4).cast("decimal(6,4)").alias("score")).agg(F.count(F.lit(1)).alias("f"), F.sum(F.col("wrong").cast("int")).alias("e"))
    upto = Window.orderBy(F.desc("score"))
    return each.select("score", F.sum("f").over(upto).alias("fields"), F.sum("e").over(upto).alias("errors"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by its continued fraction evaluated from the far end inwards."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    depth, value = 50 + int(4 * math.sqrt(max(a, b))), 1.0
    for i in range(depth, 0, -1):
        j = i // 2
        term = j * (b - j) * x / ((a + i - 1) * (a + i)) if i % 2 == 0 else -(a + j) * (a + b + j) * x / ((a + i - 1) * (a + i))
        value = 1 + term / value
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a / value


def binomial_tail(k: float, n: float, p: float) -> float:
    """P(errors <= k) of n at rate p, for real k and n."""
    return 1.0 if k >= n else incomplete_beta(n - k, k + 1, 1 - p)


def upper_bound(k: float, n: float, delta: float) -> float:
    """The rate whose tail at k of n is delta: an upper bound with confidence 1 - delta."""
    low, high = (k / n if n > 0 else 1.0), 1.0
    while n > 0 and high - low > 1e-15:
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if binomial_tail(k, n, middle) > delta else (low, middle)
    return high


def with_tails(counts: DataFrame, alpha: float, delta: float = DELTA) -> DataFrame:
    """Counts (fields, errors; real numbers) with p_value at ``alpha`` and upper bound of the rate."""
    tail = F.pandas_udf(lambda k, n: pd.Series([binomial_tail(a, b, alpha) if b >= 1 else 1.0 for a, b in zip(k, n, strict=True)]), "double")
    bound = F.pandas_udf(lambda k, n: pd.Series([upper_bound(a, b, delta) for a, b in zip(k, n, strict=True)]), "double")
    return counts.withColumns({"p_value": tail(F.col("errors").cast("double"), F.col("fields").cast("double")), "upper": bound(F.col("errors").cast("double"), F.col("fields").cast("double"))})


def certify(rows: DataFrame, alpha: float, delta: float, guide: DataFrame | None = None) -> dict:
    """Tests thresholds from strict to lenient and gives the most lenient one before the first that cannot be certified. The walk
    starts where independent ``guide`` rows look best, else where enough fields are accepted to certify anything."""
    steps = cumulative(rows).orderBy(F.desc("score")).toPandas()
    if steps.empty:
        return {"threshold": None}
    effect = design_effect(rows).first()["effect"]
    p = lambda k, n, d: binomial_tail(k / d, n / d, alpha) if n / d >= 1 else 1.0
    start = 0
    if guide is not None and (seen := cumulative(guide).orderBy(F.desc("score")).toPandas()).size:
        other = design_effect(guide).first()["effect"]
        score, n, k = (np.append(seen[c].astype(float).to_numpy(), 0.0) for c in ("score", "fields", "errors"))
        at = [int(np.searchsorted(-score[:-1], -float(t), side="right")) - 1 for t in steps["score"]]
        start = int(np.argmin([p(k[i], n[i], other) if i >= 0 else 1.0 for i in at]))
    else:
        least = math.log(delta) / math.log1p(-alpha)
        start = int(np.argmax(steps["fields"].to_numpy() >= least)) if (steps["fields"] >= least).any() else len(steps)
    found: dict = {"threshold": None, "effect": effect}
    for score, n, k in steps.iloc[start:].itertuples(index=False):
        if p(k, n, effect) > delta:
            break
        found |= {"threshold": float(score), "accepted": int(n), "errors": int(k), "p_value": p(k, n, effect), "upper": upper_bound(k / effect, n / effect, delta)}
    return found


def certificates(rows: DataFrame) -> dict[str, dict]:
    """The certificate of each stakes group of ``labelled`` rows: certified on the sampled documents of the cal half at the
    group's ``ALPHA``, guided by those of the fit half."""
    sampled = rows.where("is_qa_sample").withColumn("half", half("doc_id")).persist()
    found = {}
    for group, alpha in ALPHA.items():
        mine = sampled.where(F.coalesce("is_high_stakes", F.lit(False)) == F.lit(group == "high_stakes"))
        found[group] = certify(mine.where("half = 'cal'"), alpha, DELTA / 2, mine.where("half = 'fit'"))
    sampled.unpersist()
    return found


def refit(rows: DataFrame, features: list[str], label: str, l2: float = 1.0) -> dict[str, float]:
    """Weights of a logistic model with an L2 penalty on each, by Newton steps: every step is one aggregate of fixed size."""
    n, x = len(features), F.array(*[F.col(f).cast("double") for f in features])
    w = np.zeros(n)
    base = rows.select(x.alias("x"), F.col(label).cast("double").alias("y")).persist()
    for _ in range(25):
        z = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        p = base.withColumn("p", 1 / (1 + F.exp(-z)))
        at = lambda i: F.get("x", F.lit(i))
        sums = [F.sum((F.col("p") - F.col("y")) * at(i)) for i in range(n)] + [F.sum(F.col("p") * (1 - F.col("p")) * at(i) * at(j)) for i in range(n) for j in range(i, n)]
        found = [v or 0.0 for v in p.agg(*[c.alias(f"s{i}") for i, c in enumerate(sums)]).first()]
        curve = np.zeros((n, n))
        curve[np.triu_indices(n)] = found[n:]
        curve += np.triu(curve, 1).T + l2 * np.eye(n)
        step = np.linalg.solve(curve, np.array(found[:n]) + l2 * w)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    base.unpersist()
    return dict(zip(features, map(float, w), strict=True))


def backtest(rows: DataFrame, features: list[str], least: int = LEAST_FIT) -> dict:
    """From ``labelled`` rows with their signals: weights refitted on the fit half, every field scored anew, thresholds certified
    on the cal half's sampled documents, and what follows from it. A field that went to a person whatever its score
    (``forced``, if there is such a column) neither certifies nor guides. High stakes never get the laxer threshold."""
    fit = rows.where(half("doc_id") == "fit")
    found: dict = {"labelled": rows.count(), "fit": fit.count(), "auto_accept": None, "high_stakes": None}
    if found["fit"] < least:
        return found | {"decision": "keep: too few labelled fields"}
    weights = refit(fit.withColumn("__right", (~F.col("wrong")).cast("int")), features, "__right")
    total = F.aggregate(F.array(*[F.lit(w) * F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f, w in weights.items()]), F.lit(0.0), lambda a, b: a + b)
    free = rows.where(~F.coalesce("forced", F.lit(False))) if "forced" in rows.columns else rows
    certs = certificates(free.withColumn("score", F.round(1 / (1 + F.exp(-total)), 4)))
    found |= {"weights": {f: round(w, 4) for f, w in weights.items()}, "certificates": certs}
    normal, high = (certs[g]["threshold"] for g in ("normal", "high_stakes"))
    if normal is None or high is None:
        return found | {"decision": "keep: no certified threshold for " + " and ".join(g for g, c in certs.items() if c["threshold"] is None)}
    return found | {"auto_accept": normal, "high_stakes": max(normal, high), "decision": "proposed"}
