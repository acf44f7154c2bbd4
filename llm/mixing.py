"""Mixing sources to target weights by soft membership.

A classifier fitted on the labelled table gives each document posteriors over domains (clean,
low quality, toxic). Projected-gradient least squares then finds nonnegative document rates r so
that the expected tokens of each domain, sum of r * tokens * posterior, match the targets. The
gradient is one K-vector a step, aggregated over all documents; a document's rate follows from
its own posteriors, so a step moves K numbers and no document.

The classifier is naive Bayes over the presence of words; its words and weights come from a
sample of labelled rows bounded by MAX_LABELLED; these informative words alone are broadcast.
Everything else covers all documents. Unlabelled documents are scored like labelled ones; null
and empty texts have no words: they have the prior's posteriors and count for 0 tokens. Rows
that repeat a doc_id are scored once for each row by their joint words; rows without a doc_id have the
prior's posteriors and are kept as it says. Without labels every document counts as clean. An empty table has an empty
result; columns of the caller may have any names.
Built from DataFrame functions alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialise, read, unused

DOMAINS = ("clean", "low", "toxic")
#: Token totals wanted of each domain, as multiples of the expected tokens of the first, which all but keeps its size: its documents stay.
TARGETS = (1.01, 0.0, 0.0)
#: Bound of the classifier: labelled rows. Its words are among theirs.
MAX_LABELLED = 8000
#: A word counts if the share of a domain's labelled rows that have it is this many times the share of all rows, and if its spread over the domains has this likelihood ratio statistic.
MIN_RATIO, MIN_G2 = 3.0, 40.0
STEPS, TOLERANCE = 80, 1e-3


def words_of(text) -> Column:
    """Lower-case runs of letters and digits, and one word for runs of symbols."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[#*$%&|<>]+", " \u00a4 ")
    return F.split(plain, r"[^\p{L}\p{N}\u00a4]+")


def fit_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(word, w0, w1, w2): what the presence of an informative word adds to each domain's log likelihood; the row of the null word holds what a text without any of them has."""
    sample = labels.select(F.col("doc_id").alias("_id"), F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0).alias("k"))
    sample = sample.orderBy(F.xxhash64("_id"), "_id", "k").limit(MAX_LABELLED)
    rows = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("k", "text").withColumn("same", F.xxhash64("text")).dropDuplicates(["same", "k"])  # copies count once
    rows = rows.select("k", F.explode(F.array_distinct(F.concat(words_of(F.col("text")), F.array(F.lit(None).cast("string"))))).alias("word"))
    counts = rows.groupBy("word").agg(*[F.count_if(F.col("k") == k).alias(f"n{k}") for k in range(len(DOMAINS))])
    counts = materialise(counts.withColumn("n", sum(F.col(f"n{k}") for k in range(len(DOMAINS)))).where("word IS NULL OR (word <> '' AND n > 1)"))
    total = counts.where("word IS NULL").first()
    size = [total[f"n{k}"] if total else 0 for k in range(len(DOMAINS))]
    every = max(1, sum(size))
    k = range(len(DOMAINS))
    share = lambda i: (F.col(f"n{i}") + F.col("n") / every) / (size[i] + 1.0)
    surplus = lambda i: F.when(F.col(f"n{i}") > 0, F.col(f"n{i}") * F.log(F.col(f"n{i}") * every / (F.col("n") * max(1, size[i])))).otherwise(0.0)
    found = counts.where(f"word IS NOT NULL AND n < {every}").where(2 * sum(surplus(i) for i in k) >= MIN_G2).select("word", *[share(i).alias(f"w{i}") for i in k], F.greatest(*[share(i) for i in k]).alias("most"), (F.col("n") / every).alias("all"))
    found = found.where(F.col("most") > MIN_RATIO * F.col("all")).drop("most", "all")
    found = materialise(found)
    absent = found.agg(*[F.sum(F.log1p(-F.col(f"w{i}"))).alias(f"w{i}") for i in k]).first()
    prior = [math.log((n + (1e-3 if i else 1.0)) / (every + 1)) + (absent[i] or 0.0) for i, n in enumerate(size)]
    found = found.select("word", *[(F.log(f"w{i}") - F.log1p(-F.col(f"w{i}"))).alias(f"w{i}") for i in k])
    return found.union(docs.sparkSession.range(1).select(F.lit(None).cast("string"), *[F.lit(float(x)) for x in prior]))


def posteriors(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, tokens, p0, p1, p2): a row for each doc_id, and tokens of the whole text."""
    k = range(len(DOMAINS))
    model = materialise(model)
    prior = model.where("word IS NULL").first()
    words = docs.select(F.col("doc_id").alias("_id"), F.explode(words_of(F.col("text"))).alias("word"))
    hits = words.join(F.broadcast(model.where("word IS NOT NULL")), "word").select("_id", "word", *[f"w{i}" for i in k]).distinct()
    sums = hits.groupBy("_id").agg(*[F.sum(f"w{i}").alias(f"s{i}") for i in k])
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    sizes = docs.select("doc_id", F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long").alias("tokens"))
    both = sizes.join(sums, F.col("doc_id") == F.col("_id"), "left")
    both = both.select("doc_id", "tokens", *[(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + F.lit(float(prior[f"w{i}"]))).alias(f"s{i}") for i in k])
    both = both.withColumn("top", F.greatest(*[F.col(f"s{i}") for i in k]))
    both = both.select("doc_id", "tokens", *[F.exp(F.col(f"s{i}") - F.col("top")).alias(f"e{i}") for i in k])
    return both.select("doc_id", "tokens", *[(F.col(f"e{i}") / sum(F.col(f"e{j}") for j in k)).alias(f"p{i}") for i in k])


def fit_rates(members: DataFrame, targets: tuple[float, ...] = TARGETS, steps: int = STEPS) -> DataFrame:
    """members(doc_id, tokens, p0...) with the column `rate`.

    The objective is the sum over domains of (expected tokens - target)^2. The step is taken in the
    metric that weighs a document by its tokens, so a rate depends on the posteriors alone, and
    the descent runs over the distinct posteriors with their token sums.
    """
    k = range(len(targets))
    p = [F.col(f"p{i}") for i in k]
    grid = materialise(members.groupBy(*p).agg(F.sum("tokens").alias("tokens")))
    moment = grid.agg(*[F.sum(F.col("tokens") * p[i] * p[j]).alias(f"m{i}{j}") for i in k for j in k], *[F.sum(F.col("tokens") * p[i]).alias(f"t{i}") for i in k]).first()
    if not moment["t0"]:
        return members.withColumn("rate", F.lit(1.0))
    goal = [t * moment["t0"] for t in targets]
    step = 1 / max(sum(moment[f"m{i}{j}"] for j in k) for i in k)
    grid, rate, before = grid.withColumn("rate", F.lit(1.0)), F.lit(1.0), None
    for n in range(steps):
        now = grid.agg(*[F.sum(F.col("rate") * F.col("tokens") * p[i]).alias(f"x{i}") for i in k]).first()
        error = [now[i] - goal[i] for i in k]
        if before and max(abs(a - b) for a, b in zip(error, before, strict=True)) < TOLERANCE * moment["t0"] / steps:
            break
        before = error
        move = lambda r, error=error: F.greatest(F.lit(0.0), r - sum(F.lit(step * e) * p[i] for i, e in enumerate(error)))
        grid, rate = grid.withColumn("rate", move(F.col("rate"))), move(rate)
        if n % 20 == 19:
            grid = materialise(grid)
    return members.withColumn("rate", rate)


def mix(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """(doc_id, tokens, p_clean, p_low, p_toxic, rate, copies): copies is the rate rounded up or down by a hash of doc_id, right in expectation."""
    docs = docs.select("doc_id", "text")
    members = materialise(posteriors(docs, fit_classifier(docs, labels)))
    unit = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 20)) / (1 << 20)
    out = fit_rates(members, targets).withColumn("copies", F.floor(F.col("rate") + unit).cast("long"))
    return out.select("doc_id", "tokens", *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", "copies")


def totals(mixed: DataFrame, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """(domain, given, wanted, reached): expected tokens of each domain before mixing, by the targets, and by the rates found."""
    sums = mixed.agg(*[F.sum(F.col("tokens") * F.col(f"p_{d}")).alias(f"given_{d}") for d in DOMAINS], *[F.sum(F.col("rate") * F.col("tokens") * F.col(f"p_{d}")).alias(f"reached_{d}") for d in DOMAINS])
    rows = [F.struct(F.lit(d).alias("domain"), F.col(f"given_{d}").alias("given"), (F.lit(float(t)) * F.col(f"given_{DOMAINS[0]}")).alias("wanted"), F.col(f"reached_{d}").alias("reached")) for d, t in zip(DOMAINS, targets, strict=True)]
    return sums.select(F.inline(F.array(*rows)))


def resample(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """docs, each row as often as its copies say."""
    id_, copies_, copy_ = unused(docs, "mix_id", "mix_copies", "mix_copy")
    copies = mix(docs, labels, targets).select(F.col("doc_id").alias(id_), F.col("copies").alias(copies_)).distinct()
    out = docs.join(copies, docs["doc_id"].eqNullSafe(F.col(id_))).where(F.col(copies_) > 0)
    return out.withColumn(copy_, F.explode(F.sequence(F.lit(1), F.col(copies_)))).select(*[docs[f"`{c}`"] for c in docs.columns])


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
