"""Quality classifier: evidence of the document, priors of its host and path.

Two sparse logistic models, trained here on a bounded sample of labelled rows,
judge a document by its words and the shapes of its words: is it of low quality,
is it toxic? Sums of their probabilities by host and by path within the host are
turned into posteriors by empirical Bayes: a host is drawn to the mean of all
documents, a path to its host, the more the fewer documents it has; how strongly
is estimated from how much hosts, and paths, differ. A document's odds are its own
times the odds that its path has over the mean.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchbook.llm.texts import Memo, keyed_documents, map_rows, parts, same_document
from matchbook.runtime import cut

TARGETS = ("low", "toxic")
_EPS = 1e-6


@dataclass(frozen=True)
class Model:
    """Weights of each feature, and the intercept, for both targets."""

    weights: dict[str, tuple[float, float]]
    intercepts: tuple[float, float]


#: Longer words are judged by their parts.
_LONG = 32
_RUN = re.compile(r"[^\W_]+")


def _kinds(word: str) -> str:
    """A letter for a run of capitals (A), other letters (a) or digits (0), any other character once a run."""
    shape: list[str] = []
    for c in word:
        kind = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        if not shape or shape[-1] != kind:
            shape.append(kind)
    return "".join(shape)


def _word(word: str) -> tuple[str, str]:
    """The letters and digits of a word in lower case, and its shape: four runs, and + for more."""
    shape = _kinds(word)
    return "".join(filter(str.isalnum, word)).lower(), shape if len(shape) < 5 else shape[:4] + "+"


def _long_word(word: str) -> tuple[set[str], set[str]]:
    """All parts of a long word and all shapes of four neighbouring runs.

    A part is a run of letters and digits in lower case; of a run that is long itself,
    as in scripts without spaces, every three neighbouring characters.
    """
    parts: set[str] = set()
    for run in map(str.lower, _RUN.findall(word)):
        if len(run) <= _LONG:
            parts.add("w " + run)
        else:
            parts.update("g " + run[i : i + 3] for i in range(len(run) - 2))
    shape = _kinds(word)
    return parts, {shape[i : i + 4] for i in range(max(1, len(shape) - 3))}


def word_memo() -> Memo:
    return Memo(_word)


def features(text: str, memo: Memo) -> list[str]:
    """Distinct words, shapes by the share of words that have them, and how words repeat.

    Every character counts: words of more than 32 characters give all their parts.
    """
    words = text.split()
    if not words:
        return ["empty"]
    counts = Counter(words)
    shapes: Counter = Counter()
    out = set()
    for word, n in counts.items():
        if len(word) > _LONG:
            parts, inner = _long_word(word)
            out |= parts
            out.update("l " + shape for shape in inner)
            continue
        core, shape = memo[word]
        if core:
            out.add("w " + core)
        shapes[shape] += n
    for shape, n in shapes.items():
        out.add(f"s {shape} {min(4, int(np.log2(len(words) / n)))}")
    out.add(f"repeats {int(4 * len(counts) / len(words))}")
    out.add(f"words {min(12, int(np.log2(len(words))))}")
    return sorted(out)


def _sample(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled documents by a hash of their id; of several labels the worst."""
    rows = labels.filter("doc_id is not null and (quality is not null or toxic is not null)")
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce((1 - F.min("quality")).cast("double"), F.lit(0.0)).alias("low"),
        F.coalesce(F.max("toxic").cast("double"), F.lit(0.0)).alias("toxic"),
    )
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _cells(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))


def _surprise(n: Column, hits: Column, total: int, positives: float) -> Column:
    """Log-likelihood ratio of a feature and a target: how little chance explains of their meeting."""
    inner = _cells(hits) + _cells(n - hits) + _cells(F.lit(positives) - hits)
    inner += _cells(F.lit(float(total) - positives) - n + hits)
    outer = _cells(n) + _cells(F.lit(float(total)) - n) + _cells(F.lit(positives))
    return 2 * (inner - outer - _cells(F.lit(float(total) - positives)) + _cells(F.lit(float(total))))


def _vocabulary(rows: DataFrame, n: int, seen: dict, most: int, least: float) -> list[str]:
    """The ``most`` features that say most about either target, at least ``least`` each."""
    counts = rows.select(F.explode("found").alias("name"), *TARGETS).groupBy("name").agg(
        F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(t).alias(t) for t in TARGETS)
    )
    worth = F.greatest(*(_surprise(F.col("n"), F.col(t), n, seen[t]) for t in TARGETS))
    ranked = counts.select("name", worth.alias("worth")).filter(F.col("worth") >= least)
    # At most ``most`` names.
    return [r["name"] for r in ranked.orderBy(F.desc("worth"), "name").limit(most).collect()]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = 20_000,
    vocabulary: int = 4096,
    least: float = 12.0,
    penalty: float = 0.0005,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Train on at most ``max_labelled`` labelled rows, whatever the size of the tables.

    Labels are ``doc_id, quality (1 good), toxic (1 toxic)``; null ids and rows without either are
    passed over, a null label counts as the good one. Of all features of the sample, at
    most ``vocabulary`` whose log-likelihood ratio with a target reaches ``least`` enter
    the models. Without labels, or with labels of one kind, the model has no weights
    and the share of that kind as its answer.
    """
    # The sample is bounded, so it may go to every task.
    sample = F.broadcast(_sample(labels, max_labelled))
    texts = keyed_documents(docs, id_col, text_col)
    rows = texts.join(sample, "doc_id").select("text", *TARGETS)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        memo = word_memo()
        for batch in parts(batches, 1000):
            found = [features(text, memo) for text in batch["text"].to_pylist()]
            yield {"found": found} | {t: batch[t] for t in TARGETS}

    rows = map_rows(rows, run, "found array<string>, low double, toxic double")
    rows, seen = cut(rows, n=F.count(F.lit(1)), **{t: F.sum(t) for t in TARGETS})
    n = seen["n"]
    if not n:
        return Model({}, (-4.0, -4.0))
    names = _vocabulary(rows, n, seen, vocabulary, least)
    shares = tuple(_logit((seen[t] + 0.5) / (n + 1)) for t in TARGETS)
    if not names:
        return Model({}, shares)
    counted = CountVectorizerModel.from_vocabulary(names, inputCol="found", outputCol="features")
    points, _ = cut(counted.setBinary(True).transform(rows).select("features", *TARGETS))
    weights: dict[str, list[float]] = {}
    intercepts = []
    for i, target in enumerate(TARGETS):
        if seen[target] in (0, n):
            intercepts.append(shares[i])
            continue
        line = LogisticRegression(
            labelCol=target, elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60
        ).fit(points)
        intercepts.append(float(line.intercept))
        values = line.coefficients.toArray()
        for j in np.flatnonzero(values).tolist():
            weights.setdefault(names[j], [0.0, 0.0])[i] = float(values[j])
    return Model({k: tuple(v) for k, v in weights.items()}, tuple(intercepts))


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def evidence(docs: DataFrame, model: Model, host: Column, path: Column) -> DataFrame:
    """``doc_id, text_key, host, path, low, toxic``: log odds by the text alone."""
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
    )
    own = own.withColumn("text_key", F.xxhash64("text"))
    # Bounded by the vocabulary.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        memo, trained = word_memo(), shared.value
        for batch in parts(batches, 1000):
            scores = np.tile(trained.intercepts, (batch["text"].__len__(), 1))
            for i, text in enumerate(batch["text"].to_pylist()):
                for name in features(text, memo):
                    if (w := trained.weights.get(name)) is not None:
                        scores[i] += w
            names = ("doc_id", "text_key", "host", "path")
            yield {n: batch[n] for n in names} | {"low": scores[:, 0], "toxic": scores[:, 1]}

    schema = "doc_id long, text_key long, host string, path string, low double, toxic double"
    return map_rows(own, run, schema)


def _p(name: str) -> Column:
    return 1 / (1 + F.exp(-F.col(name)))


def _odds(p: Column) -> Column:
    kept = F.least(F.greatest(p, F.lit(_EPS)), F.lit(1 - _EPS))
    return F.log(kept / (1 - kept))


def _strength(groups: DataFrame, toward: str, total: str) -> float:
    """How many documents the prior of a group is worth, by the method of moments.

    The spread of group means beyond what their sizes explain is the spread of the
    groups; the less of it, the stronger the prior.
    """
    mean = F.col(total) / F.col("n")
    row = groups.agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("groups"),
        F.sum(F.col("n") * (mean - F.col(toward)) ** 2).alias("between"),
        F.sum(F.col(toward) * (1 - F.col(toward))).alias("noise"),
        F.sum(F.col("n") * F.col(toward) * (1 - F.col(toward))).alias("whole"),
    ).first()
    if not row["n"] or row["groups"] < 2:
        return 1e6
    spread = max(0.0, row["between"] - row["noise"]) / row["n"]
    whole = row["whole"] / row["n"]
    return float(min(1e6, max(1.0, whole / spread - 1))) if spread > 0 and whole > 0 else 1e6


def posteriors(scores: DataFrame) -> DataFrame:
    """``host, path`` and, per target, ``shift_<target>``: log odds of the path over the mean."""
    sums = [F.sum(_p(t)).alias(t) for t in TARGETS]
    # Partial sums leave each task before the shuffle, so a hot host is no hot task.
    paths, _ = cut(scores.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *sums))
    hosts, _ = cut(paths.groupBy("host").agg(F.sum("n").alias("n"), *(F.sum(t).alias(t) for t in TARGETS)))
    whole = hosts.agg(F.sum("n").alias("n"), *(F.sum(t).alias(t) for t in TARGETS)).first()
    if not whole["n"]:
        return paths.select("host", "path", *(F.lit(0.0).alias(f"shift_{t}") for t in TARGETS))
    means = {t: min(1 - _EPS, max(_EPS, whole[t] / whole["n"])) for t in TARGETS}
    priors = hosts
    for t in TARGETS:
        mean = F.lit(means[t])
        k = _strength(priors.withColumn("mean", mean), "mean", t)
        priors = priors.withColumn(f"host_{t}", (F.col(t) + k * mean) / (F.col("n") + k))
    placed = paths.join(priors.select("host", *(f"host_{t}" for t in TARGETS)), "host")
    for t in TARGETS:
        k = _strength(placed, f"host_{t}", t)
        path = (F.col(t) + k * F.col(f"host_{t}")) / (F.col("n") + k)
        placed = placed.withColumn(f"shift_{t}", _odds(path) - _odds(F.lit(means[t])))
    return placed.select("host", "path", *(f"shift_{t}" for t in TARGETS))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    host: Column | None = None,
    path: Column | None = None,
    threshold: float = 0.5,
    **options,
) -> DataFrame:
    """``doc_id, text_key, p_low, p_toxic, keep`` of every row.

    ``host`` and ``path`` default to ``source`` and ``lang``; nulls are a host or path of
    their own. ``keep`` is false where either probability reaches the threshold. Null and
    empty texts are judged by having no words. Equal rows get equal answers.
    """
    model = fit(docs, labels, **options)
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    # Reading the texts is the costly part: once.
    scores, _ = cut(evidence(docs, model, host, path))
    found = scores.join(posteriors(scores), ["host", "path"])
    p = {t: 1 / (1 + F.exp(-(F.col(t) + F.col(f"shift_{t}")))) for t in TARGETS}
    keep = (p["low"] < threshold) & (p["toxic"] < threshold)
    return found.select(
        "doc_id", "text_key", *(p[t].alias(f"p_{t}") for t in TARGETS), keep.alias("keep")
    )


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    names = docs.columns
    kept = classify(docs, labels, **options).filter("keep").select("doc_id", "text_key").distinct()
    own = docs.select(
        F.struct(*(docs[n] for n in names)).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
    )
    return own.join(kept, same_document(own, kept), "left_semi").select("row.*")
