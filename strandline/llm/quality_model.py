"""Operator 8: document quality by hierarchical empirical Bayes.

Level one is a logistic classifier over the rule ledger's measurements, fitted on
a bounded sample of labelled rows (``max_rows``).  Level two gathers outcomes by
site (host) and by path within the site, over *all* documents, in one grouped
aggregation: a labelled document counts with its label, any other with the
classifier's probability, at the weight that this probability explains of the
labels' variance.  Site means shrink toward the global mean and path means toward
their site, by as many pseudo-documents as the variance between groups says
(method of moments), so a site with few documents stays near the prior.  What a
document itself has put into its groups is taken out before they speak about it.
A second logistic fit weighs the document's evidence against how far its site and
path stand from the prior.

Cases: a null host or path is a site or path of its own (the empty one); null
and empty texts are scored by their measurements; without labels the score is
0.5 times nothing known, that is 0.5; repeated rows each keep their row; labels of
one id count by their minimum; sums are decimals, so that the result does not
depend on the order of rows; other input columns do not enter.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import written
from strandline.llm.quality_rules import ledger, rules
from strandline.llm.toxicity import fit

MAX_ROWS = 20_000
#: Groups up to which their posteriors are broadcast.
BROADCAST_GROUPS = 500_000


def _features() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda a, b: F.least(F.col(a) / F.greatest(b, F.lit(1)), F.lit(5.0))
    return [
        F.lit(1.0), F.log1p(F.col("n_words").cast("double")), share("n_symbols", n), share("n_digits", F.col("word_chars")),
        share("n_dup_lines", F.col("n_lines")), share("n_repeat_words", n), F.least(F.col("word_chars") / n, F.lit(30.0)) / 10,
        *(F.when(F.col("failures").bitwiseAND(F.lit(1 << k)) != 0, 1.0).otherwise(0.0) for k in range(len(rules()))),
    ]


def _logistic(weights, columns: list[Column]) -> Column:
    total = F.lit(0.0)
    for w, c in zip(weights, columns, strict=True):
        total = total + F.lit(float(w)) * c
    return 1 / (1 + F.exp(-F.least(F.greatest(total, F.lit(-30.0)), F.lit(30.0))))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame) -> float:
    """Pseudo-documents of the prior: variance within groups over variance between them, from rows of ``n, s, ss``."""
    mean = F.col("s") / F.col("n")
    within = F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(1e-4))
    r = groups.where("n > 0").select(mean.alias("m"), within.alias("w"), F.col("n").alias("n")).agg(F.coalesce(F.var_pop("m"), F.lit(0.0)).alias("v"), F.avg(F.col("w") / F.col("n")).alias("noise"), F.avg("w").alias("w")).first()
    if r["w"] is None:
        return 1.0
    between = max(r["v"] - r["noise"], 1e-6)
    return round(min(max(r["w"] / between, 1.0), 1e4), 6)  # rounded: averages of floats depend on the order of rows


def site_sums(evidence: DataFrame) -> tuple[DataFrame, float, float, float]:
    """Rows of ``host, path, v`` (0 to 1) and ``w`` (weight) to ``host, path, pn, ps, hn, hs``, the prior, and the strengths of hosts and paths."""
    exact = lambda c: F.sum(F.round(c, 12).cast("decimal(28,12)")).cast("double")
    sums = lambda x: (exact(x[0]).alias("n"), exact(x[1]).alias("s"), exact(x[2]).alias("ss"))
    w, v = F.col("w"), F.col("v")
    paths = written(evidence.groupBy("host", "path").agg(*sums((w, w * v, w * v * v))), "path-sums")
    hosts = written(paths.groupBy("host").agg(*sums((F.col("n"), F.col("s"), F.col("ss")))), "host-sums")
    total = hosts.agg(*sums((F.col("n"), F.col("s"), F.col("ss")))).first()
    prior = (total["s"] or 0.0) / total["n"] if total["n"] else 0.5
    both = paths.select("host", "path", F.col("n").alias("pn"), F.col("s").alias("ps")).join(hosts.select("host", F.col("n").alias("hn"), F.col("s").alias("hs")), "host")
    return both, prior, _strength(hosts), _strength(paths)


def posteriors(rows: DataFrame, prior: float, host_k: float, path_k: float) -> DataFrame:
    """Rows with the sums and an own ``v, w`` gain ``host_post`` and ``path_post``, without what is their own."""
    w, own = F.col("w"), F.col("w") * F.col("v")
    left = lambda n, x: F.greatest(F.col(n) - x, F.lit(0.0))
    shrunk = lambda s, n, k, mean: F.least(F.greatest((s + F.lit(k) * mean) / (n + F.lit(k)), F.lit(0.0)), F.lit(1.0))
    with_host = rows.withColumn("host_post", shrunk(left("hs", own), left("hn", w), host_k, F.lit(prior)))
    return with_host.withColumn("path_post", shrunk(left("ps", own), left("pn", w), path_k, F.col("host_post")))


def url_site(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of an address, lowered; empty where there is none."""
    found = lambda k: F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)(?::[0-9]*)?(?:/([^/?#]*))?", k))
    return found(1), found(2)


def score_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", max_rows: int = MAX_ROWS) -> DataFrame:
    """``id_col, score, doc_score, host_post, path_post`` for every row; ``labels`` has ``id_col`` and ``quality``."""
    named = docs.select(id_col, F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "text")
    measured = written(ledger(named).select(id_col, "host", "path", F.array(*_features()).alias("x")), "quality")
    usable = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").alias("y"))
    share = min(1.0, max_rows / max(usable.count(), 1))
    chosen = F.broadcast(usable.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("quality")), F.lit(1_000_000)) < int(1_000_000 * share)))

    width = len(_features())
    sample = sorted(measured.join(chosen, id_col).select("x", "y").collect())  # about max_rows short rows, in a fixed order
    y = np.array([float(r["y"]) for r in sample])
    x = np.array([r["x"] for r in sample]).reshape(-1, width)
    first = fit(x, y) if len(y) else np.zeros(width)
    told = 1 / (1 + np.exp(-np.clip(x @ first, -30, 30)))
    weight = float(min(max(told.var() / y.var(), 0.01), 1.0)) if len(y) and y.var() > 0 else 1.0

    outcomes = usable.select(F.col(id_col).alias("__id"), F.col("y").cast("double").alias("label"))
    scored = measured.withColumn("p", F.round(_logistic(first, [F.col("x")[k] for k in range(width)]), 12)).drop("x").join(outcomes, F.col(id_col) == F.col("__id"), "left").drop("__id")
    evidence = written(scored.select(id_col, "host", "path", "p", F.coalesce("label", "p").alias("v"), F.when(F.col("label").isNull(), F.lit(weight)).otherwise(F.lit(1.0)).alias("w")), "evidence")
    groups, prior, host_k, path_k = site_sums(evidence)
    groups = written(groups, "site-sums")
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    known = posteriors(evidence.join(groups, ["host", "path"]), prior, host_k, path_k)
    z = F.array(F.lit(1.0), _logit(F.col("p")), _logit(F.col("host_post")) - _logit(F.lit(prior)), _logit(F.col("path_post")) - _logit(F.col("host_post")))
    both = known.withColumn("z", F.transform(z, lambda c: F.round(c, 9)))
    sample = sorted(both.join(chosen, id_col).select("z", "y").collect())
    second = fit(np.array([r["z"] for r in sample]), np.array([float(r["y"]) for r in sample])) if sample else np.zeros(4)
    return both.select(id_col, F.round(_logistic(second, [F.col("z")[k] for k in range(4)]), 9).alias("score"), F.col("p").alias("doc_score"), "host_post", "path_post")


def held_out_loss(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", fold: int = 0, folds: int = 5) -> tuple[float, float, int]:
    """Mean log loss on a fold of the labelled rows that nothing was learned from: by the document alone, with its sites, and the fold's rows."""
    at = F.pmod(F.xxhash64(F.col(id_col), F.lit("fold")), F.lit(folds))
    judged = score_quality(docs, labels.where(at != fold), host, path, id_col)
    known = labels.where(F.col("quality").isNotNull() & (at == fold)).groupBy(id_col).agg(F.min("quality").alias("y"))
    loss = lambda p: F.avg(-F.log(F.greatest(F.when(F.col("y") == 1, F.col(p)).otherwise(1 - F.col(p)), F.lit(1e-9))))
    r = judged.join(known, id_col).agg(loss("doc_score").alias("alone"), loss("score").alias("sites"), F.count("*").alias("n")).first()
    return r["alone"], r["sites"], r["n"]


def op8_quality_classifier(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Sites are sources, paths the languages within them: ``documents`` has no addresses; ``url_site`` serves tables that have."""
    found = score_quality(documents, labels, F.col("source"), F.col("lang"))
    return found.select("doc_id", "score", "doc_score", "host_post", "path_post", (F.col("score") >= 0.5).alias("kept"))
