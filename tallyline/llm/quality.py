"""Quality by hierarchical empirical Bayes: text evidence, host and path.

The text classifier is naive Bayes over binned shape features of whole texts: per feature and bin
the log-odds of good and bad labels, added up and damped by ``DAMPING``, since the features are
not independent. Sites form a hierarchy: everything, hosts, and paths within hosts. A site
counts its labelled training rows as they are and its other rows as ``SOFT`` of an observation
each, valued at the classifier's probability. Its rate is shrunk towards its parent's posterior
with a strength estimated from the spread of the rates at that level (method of moments), so a
site with few rows stays near its parent. The posterior log-odds of the path replaces the global
prior when the evidence of a document is added up.

Scale: features are computed in the scan; everything else is grouped sums that combine before the
shuffle, and one join of narrow rows with the site table. Only the bin table (features times
bins) and one row per level reach the driver.

Defined cases: a NULL text has the features of an empty one. NULL hosts and paths are sites of
their own. Repeated labels of an id count as good only if all are; NULL labels are left out.
Repeated rows are scored each. Without labels the score is 0.5 everywhere. Held-out rows
(crc32(id as text) mod 5 = 0) never lend their labels. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.llm.common import stored

HELD_OUT_MODULUS = 5
BINS = 24
SOFT = 0.25
DAMPING = 0.6
STRENGTHS = (1.0, 10_000.0)


def shape(text: Column) -> dict[str, Column]:
    """Feature name -> bin number, 0 to BINS - 1."""
    size = F.length(text)
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.split(text, "\n", -1)
    count = lambda pattern: size - F.length(F.regexp_replace(text, pattern, ""))
    share = lambda n, of: n / F.greatest(of, F.lit(1))
    cut = lambda x, scale: F.least(F.floor(x * scale), F.lit(BINS - 1)).cast("int")
    return {
        "symbols": cut(share(count(r"[^\p{L}\p{N}\s]+"), size), 80),
        "capitals": cut(share(count(r"\p{Lu}+"), size), 40),
        "digits": cut(share(count(r"\p{N}+"), size), 40),
        "repeats": cut(1 - share(F.size(F.array_distinct(words)), F.size(words)), 24),
        "same_lines": cut(1 - share(F.size(F.array_distinct(lines)), F.size(lines)), 24),
        "word_length": cut(share(size, F.size(words)), 2),
        "length": cut(F.log2(size + 1.0), 1.2),
    }


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (probability of good quality),
    predicted (1 if >= 0.5), evidence, host_posterior, path_posterior."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bins = shape(F.col("__text"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("\x00")).alias("host"), F.coalesce(path.cast("string"), F.lit("\x00")).alias("path"), text.alias("__text"))
    rows = rows.select("doc_id", "host", "path", *[b.alias(n) for n, b in bins.items()])
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % HELD_OUT_MODULUS == 0
    rows = rows.join(marked, "doc_id", "left").withColumn("held_out", held_out).withColumn("label", F.when(~F.col("held_out"), F.col("quality"))).drop("quality")
    rows = stored(rows, "quality-rows")

    counted = rows.where("label IS NOT NULL").select("label", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("bin")) for n in bins])).alias("f"))
    table = counted.groupBy("f.feature", "f.bin").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")).collect()  # features * BINS
    good = sum(r.good for r in table if r.feature == "length")
    bad = sum(r.bad for r in table if r.feature == "length")
    prior = math.log((good + 1) / (bad + 1)) if good or bad else 0.0
    evidence = F.lit(0.0)
    for name in bins:
        odds = [0.0] * BINS
        for r in table:
            if r.feature == name:
                odds[r.bin] = math.log((r.good + 1) / (good + BINS)) - math.log((r.bad + 1) / (bad + BINS))
        evidence = evidence + F.element_at(F.array(*[F.lit(o) for o in odds]), F.col(name) + 1)
    scored = rows.select("doc_id", "held_out", "host", "path", "label", (evidence * DAMPING).alias("evidence"))

    chance = 1 / (1 + F.exp(-(F.col("evidence") + prior)))
    weight = F.when(F.col("label").isNotNull(), 1.0).otherwise(SOFT)
    sites = scored.groupBy("host", "path").agg(F.sum(weight).alias("n"), F.sum(weight * F.coalesce(F.col("label").cast("double"), chance)).alias("good"))
    sites = stored(sites, "quality-sites")
    hosts = sites.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    whole = hosts.agg(F.sum("n"), F.sum("good")).first()
    rate = (whole[1] + 1) / (whole[0] + 2) if whole[0] else 0.5
    of_hosts = _strength(hosts.select("n", "good", F.lit(rate).alias("mean")))
    hosts = hosts.select("host", ((F.col("good") + of_hosts * rate) / (F.col("n") + of_hosts)).alias("host_posterior"))
    sites = sites.join(hosts, "host")
    of_paths = _strength(sites.select("n", "good", F.col("host_posterior").alias("mean")))
    sites = sites.select("host", "path", "host_posterior", ((F.col("good") + of_paths * F.col("host_posterior")) / (F.col("n") + of_paths)).alias("path_posterior"))

    site_odds = F.log(F.col("path_posterior") / (1 - F.col("path_posterior")))
    value = 1 / (1 + F.exp(-(F.col("evidence") + site_odds))) if table else F.lit(0.5)
    return scored.join(sites, ["host", "path"]).select("doc_id", "held_out", value.alias("score"), (value >= 0.5).cast("int").alias("predicted"), "evidence", "host_posterior", "path_posterior")


def _strength(sites: DataFrame) -> float:
    """Observations that the parent's rate is worth, from the spread of (n, good) about ``mean``."""
    off = F.col("good") - F.col("n") * F.col("mean")
    chance = F.col("mean") * (1 - F.col("mean"))
    row = sites.agg(F.sum(off * off - F.col("n") * chance), F.sum(F.col("n") * (F.col("n") - 1)), F.sum(F.col("n") * chance), F.sum("n")).first()
    if not row[3] or not row[1] or row[1] <= 0:
        return STRENGTHS[1]
    spread, within = row[0] / row[1], row[2] / row[3]
    return STRENGTHS[1] if spread <= 0 else min(STRENGTHS[1], max(STRENGTHS[0], within / spread - 1))
