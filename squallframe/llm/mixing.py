"""Mixing sources to target weights: soft memberships and least-squares rates.

1. A naive Bayes classifier over token ids is fitted on a bounded sample of the documents that name their source (at most
   about TRAIN_DOCUMENTS of each source, by hash). One pass over all texts then gives every document its tokens and its
   posterior over the sources.
2. A document's membership is soft: LABEL_TRUST on the source that it names and the rest by its posterior; a document without
   a source has its posterior alone.
3. Each mix wants tokens of every source, and each document has a rate between 0 and the number of times it may be used. The
   rates minimise the squared distance between the expected tokens of the sources and the wanted ones, by projected gradient
   steps in the metric in which a step changes tokens in proportion to what there is; a step of length 1 is stable there.
   Rates follow from the history of the residuals alone, so a step is one scan that returns one number for each mix and
   source, and no state of the documents is kept.
4. Where soft memberships leave a source's own documents off its target, finishing steps of the same kind run on the sources
   that documents name. A source whose documents are all at their cap then and still hold less than wanted is short.

Whole uses are then drawn: the integer part of the rate, and one more for documents whose hash is low enough; the bound is
moved, by counts of tokens over hash ranges, until the source's tokens come as near to the target as whole documents allow.
The numbers of steps and passes are limited; a fit or draw that stops at its limit says so (``settled``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cleaning import letters_key
from ..session import broadcast_if_small, settle
from .stable_sample import salted_hash, threshold
from .tokens import _slices, codec

#: Pseudo-count of the classifier.
SMOOTH = 0.1
#: The classifier learns from about so many documents of each source at most.
TRAIN_DOCUMENTS = 2000
#: A text's likelihood counts as that of so many tokens.
SHARPNESS = 30.0
#: The share of a document's membership that goes to the source it names; the rest follows its posterior.
LABEL_TRUST = 0.8
#: Ranges of the draw for each mix and source.
RANGES = 4096


def training_sample(documents: DataFrame, names: list[str], key: str = "doc_id", text: str = "text", source: str = "source", most: int | None = None) -> DataFrame:
    """(text, category): of each named source all its documents, or about ``most`` (TRAIN_DOCUMENTS) of them by hash of the key."""
    most = TRAIN_DOCUMENTS if most is None else most
    base = documents.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text"), letters_key(F.col(f"`{source}`")).alias("category")).where(F.col("category").isin(names))
    counts = base.groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each name
    bound = F.lit("g")
    for r in counts:
        bound = F.when(F.col("category") == r.category, F.lit(threshold(min(1.0, most / r.n)))).otherwise(bound)
    return base.where(salted_hash(F.coalesce("key", F.lit("")), "mix-train") < bound).select("text", "category")


def train(sample: DataFrame, model, names: list[str]) -> Classifier:
    """A classifier over the given sources from a training_sample(). names is bounded by the caller."""
    arrow = pa.schema([("category", pa.int32()), ("token", pa.int32()), ("n", pa.int64())])
    at = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        sums = np.zeros((len(names), c.size + 1), np.int64)  # the last column counts documents
        for whole in batches:
            for batch in _slices(whole.select([1, 0])):
                for name, doc in zip(batch.column(0).to_pylist(), c.encode_batch(batch.column(1).to_pylist())):
                    sums[at[name]] += np.bincount(np.asarray([*doc, c.size], np.int64), minlength=c.size + 1)
        i, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(sums[i, j])], schema=arrow)

    size = codec(model.value).size
    sums = np.zeros((len(names), size + 1))
    if names:
        counted = sample.select("text", "category").mapInArrow(run, "category int, token int, n bigint").groupBy("category", "token").agg(F.sum("n").alias("n"))
        for b in counted.toArrow().to_batches():  # at most names x vocabulary rows
            sums[b.column(0).to_numpy(), b.column(1).to_numpy()] = b.column(2).to_numpy()
    smooth = sums[:, :size] + SMOOTH
    docs = sums[:, size] + 0.5
    weight = (np.log(smooth) - np.log(smooth.sum(axis=1, keepdims=True))).astype(np.float32)
    return Classifier(names, weight, np.log(docs / docs.sum()) if names else np.zeros(0))


def measure(documents: DataFrame, model, classifier: Classifier, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, category, tokens, posterior array<double>), a row for each document, in one pass over the texts. Null and empty
    texts have no tokens and the prior as posterior; a null, blank or sign-only source is no category."""
    ship = documents.sparkSession.sparkContext.broadcast(classifier)  # names x vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        for whole in batches:
            for batch in _slices(whole):
                ids = c.encode_batch(batch.column(1).to_pylist())
                k = len(ids)
                p = ship.value.posteriors(ids)
                each = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * p.shape[1], pa.int32()), pa.array(p.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.fromiter(map(len, ids), np.int64, k)), each], names=["doc_id", "category", "tokens", "posterior"])

    base = documents.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"), letters_key(F.col(f"`{source}`")).alias("category"))
    return settle(base.mapInArrow(run, "doc_id bigint, category string, tokens bigint, posterior array<double>"), "mix-measure")


@dataclass
class Classifier:
    """Naive Bayes: log probabilities (category, token) and log priors. Its size is bounded by categories x vocabulary."""

    names: list[str]
    weight: np.ndarray
    prior: np.ndarray

    def posteriors(self, ids: list[list[int]]) -> np.ndarray:
        """(documents, names). The likelihood counts as SHARPNESS tokens of the document's average: naive Bayes takes the tokens
        of a text for independent, which they are not, and would be as good as certain of every longer one."""
        out = np.tile(self.prior, (len(ids), 1))
        if not self.names or not len(ids):
            return out
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        some = np.flatnonzero(sizes)
        if len(some):
            flat = np.fromiter((t for d in ids for t in d), np.int64, int(sizes.sum()))
            starts = (np.cumsum(sizes) - sizes)[some]
            for k, row in enumerate(self.weight):
                out[some, k] += np.add.reduceat(row[flat].astype(np.float64), starts) / sizes[some] * SHARPNESS
        out -= out.max(axis=1, keepdims=True)
        p = np.exp(out)
        return p / p.sum(axis=1, keepdims=True)


def wanted(targets: DataFrame) -> DataFrame:
    """Targets with their category, wanted tokens and cap: (mix_id, source, category, want, cap, total). Null weights, totals and
    uses count as 0; of several targets with one mix and category the sum is wanted and the largest cap holds."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    targets = targets.drop("category", "want", "cap", "held", "expected", "capacity", "short", "tokens", "most_uses", "documents", "share")
    w = targets.withColumn("category", letters_key(F.col("source"))).withColumn("want", z("weight").cast("double") * z("total_tokens")).withColumn("cap", F.greatest(z("max_uses"), F.lit(0)).cast("double"))
    return w


@dataclass
class Fit:
    """mixes and names index want and cap. steps: the history that rates are computed from, each the scaled residuals (mixes,
    names) and whether it was taken on the named sources alone. got: expected tokens by membership; given: tokens of the
    documents that name a source (or, without one, most likely belong to it); settled: no step limit was hit."""

    mixes: list[int]
    names: list[str]
    want: np.ndarray
    cap: np.ndarray
    loose: float
    trust: float
    steps: list[tuple[np.ndarray, bool]]
    got: np.ndarray
    given: np.ndarray
    settled: bool = True

    def members(self, category: np.ndarray, posterior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(soft, own, top): memberships (documents, names), the position of the source a document counts for (-1: none), and the
        most uses (documents, mixes)."""
        if not self.names or not self.mixes:
            k = len(category)
            return np.zeros((k, len(self.names))), np.full(k, -1), np.zeros((k, len(self.mixes)))
        at = {n: i for i, n in enumerate(self.names)}
        own = np.fromiter((at.get(c, -1) if c is not None else -2 for c in category), np.int64, len(category))
        stray = own == -2
        soft = np.where(stray[:, None], posterior, (1 - self.trust) * posterior)
        named = np.flatnonzero(own >= 0)
        soft[named, own[named]] += self.trust
        soft[own == -1] = 0.0  # of a source that no mix has
        if stray.any():
            own = np.where(stray, posterior.argmax(axis=1) if self.loose > 0 else -1, own)
        top = np.where((own >= 0)[:, None], self.cap[:, own].T, 0.0)
        return soft, own, np.where(stray[:, None], np.minimum(top, self.loose), top)

    def rates(self, soft: np.ndarray, own: np.ndarray, top: np.ndarray) -> np.ndarray:
        """(documents, mixes): the rate of every document."""
        r = np.zeros((len(own), len(self.mixes)))
        for g, hard in self.steps:
            r = np.clip(r - (np.where((own >= 0)[:, None], g[:, own].T, 0.0) if hard else soft @ g.T), 0.0, top)
        return r


def _columns(batch: pa.RecordBatch, fit: Fit, tokens: int, category: int, posterior: int) -> tuple[np.ndarray, tuple]:
    k = len(fit.names)
    p = batch.column(posterior).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, k) if k else np.zeros((batch.num_rows, 0))
    return batch.column(tokens).to_numpy(zero_copy_only=False).astype(np.float64), fit.members(batch.column(category).to_numpy(zero_copy_only=False), p)


def _totals(docs: DataFrame, fit: Fit) -> dict[str, np.ndarray]:
    """One scan: by mix and source the tokens expected and given at the current rates, and by source those held, softly and by
    name (all of them as (mixes, names))."""
    m, n = len(fit.mixes), len(fit.names)
    kinds = ("got", "given", "soft", "held")
    arrow = pa.schema([("kind", pa.int32()), ("m", pa.int32()), ("k", pa.int32()), ("v", pa.float64())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((4, m, n))
        for b in batches:
            t, (soft, own, top) = _columns(b, fit, 1, 0, 2)
            used = fit.rates(soft, own, top) * t[:, None]
            out[0] += used.T @ soft
            some = own >= 0
            one = np.zeros_like(soft)
            one[np.flatnonzero(some), own[some]] = 1.0
            out[1] += used.T @ one
            may = (top > 0) * t[:, None]
            out[2] += may.T @ soft
            out[3] += may.T @ one
        kind, i, j = (x.ravel().astype(np.int32) for x in np.indices(out.shape))
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(i), pa.array(j), pa.array(out.ravel())], schema=arrow)

    got = {k: np.zeros((m, n)) for k in kinds}
    if m and n:
        for r in docs.select("category", "tokens", "posterior").mapInArrow(sums, "kind int, m int, k int, v double").groupBy("kind", "m", "k").agg(F.sum("v").alias("v")).collect():
            got[kinds[r.kind]][r.m, r.k] = r.v
    return got


def fit_rates(docs: DataFrame, targets: DataFrame, names: list[str], loose: float = 0.0, trust: float | None = None, steps: int = 30, tolerance: float = 1e-3, improve: float = 0.1) -> Fit:
    """Rates for all mixes at once. docs: measure(). targets: wanted(); its rows are few by nature (mixes x sources) and lie on
    the driver, as do the sums of tokens by mix and source. ``loose``: how often a document without a source may be used. The
    steps by membership end when all targets are met to ``tolerance`` or a step lessens the squared distance by a share of less
    than ``improve``; the finishing steps when they are met or nothing changes any more; either at ``steps`` steps, which
    ``settled`` tells."""
    rows = targets.where("category is not null").groupBy("mix_id", "category").agg(F.sum("want").alias("want"), F.max("cap").alias("cap")).collect()
    mixes = sorted({r.mix_id for r in rows if r.mix_id is not None})
    m, n = len(mixes), len(names)
    want, cap = np.zeros((m, n)), np.zeros((m, n))
    for r in rows:
        if r.mix_id is not None and r.category in names:
            want[mixes.index(r.mix_id), names.index(r.category)], cap[mixes.index(r.mix_id), names.index(r.category)] = r.want, r.cap
    fit = Fit(mixes, names, want, cap, loose, LABEL_TRUST if trust is None else trust, [], np.zeros((m, n)), np.zeros((m, n)))
    now = _totals(docs, fit)
    for hard in (False, True):
        least = 1.0 if hard or not n else want.mean(axis=1, keepdims=True)  # what a mix does not want comes as spill of what it does
        near = tolerance * np.maximum(want, np.maximum(least, 1.0))
        for left in range(steps - 1, -1, -1):
            reached, held = (now["given"], now["held"]) if hard else (now["got"], now["soft"])
            fit.got, fit.given = now["got"], now["given"]
            gap = reached - want
            if (np.abs(gap) <= near)[held > 0].all():
                break
            fit.steps.append((np.where(held > 0, gap / np.maximum(held, 1e-9), 0.0), hard))
            now = _totals(docs, fit)
            after = now["given"] if hard else now["got"]
            if hard and (np.abs(after - reached) <= near / 10).all():  # used up
                break
            far = lambda x: float(((x - want) ** 2 / np.maximum(held, 1.0))[want <= cap * held].sum())  # noqa: E731, B023
            if not hard and far(after) >= (1 - improve) * far(reached):
                break
            fit.settled &= left > 0
        fit.got, fit.given = now["got"], now["given"]
    return fit


def shortages(docs: DataFrame, targets: DataFrame, fit: Fit) -> DataFrame:
    """The targets with expected (by the memberships) and given (by name) tokens of the fit, held (tokens of the source), capacity
    (held times the cap) and short: whether the fit gives less than is wanted though the source is used up. The exact sums of
    tokens over all its documents have the last word on the second."""
    spark = docs.sparkSession
    rows = [(m, k, float(fit.got[i, j]), float(fit.given[i, j])) for i, m in enumerate(fit.mixes) for j, k in enumerate(fit.names)]
    got = spark.createDataFrame(rows or [(None, None, None, None)], "_m int, _k string, expected double, given double")
    held = docs.where("category is not null").groupBy("category").agg(F.sum("tokens").alias("held"))
    t = targets.join(held, "category", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    t = t.join(got, (F.col("mix_id") == F.col("_m")) & (F.col("category") == F.col("_k")), "left").drop("_m", "_k")
    for c in ("expected", "given"):
        t = t.withColumn(c, F.coalesce(c, F.lit(0.0)))
    t = t.withColumn("capacity", F.col("held") * F.col("cap")).withColumn("settled", F.lit(fit.settled)).withColumn("steps", F.lit(len(fit.steps)))
    return t.withColumn("short", (F.col("given") < F.col("want")) & (F.col("capacity") < F.col("want")))


def draw(docs: DataFrame, fit: Fit, salt: str, passes: int = 4, tolerance: float = 0.005) -> DataFrame:
    """(mix_id, doc_id, category, tokens, uses): whole uses of the documents that a mix takes at least once."""

    arrow = pa.schema([("mix_id", pa.int32()), ("doc_id", pa.int64()), ("category", pa.string()), ("tokens", pa.int64()), ("base", pa.int32()), ("part", pa.float64())])
    names = pa.array([*fit.names, None], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, (soft, own, top) = _columns(b, fit, 2, 1, 3)
            r = fit.rates(soft, own, top)
            for i, mix in enumerate(fit.mixes):
                at = np.flatnonzero(r[:, i] > 0)
                base = np.floor(r[at, i] + 1e-9)
                part = r[at, i] - base
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), mix, np.int32)), b.column(0).take(pa.array(at)), names.take(pa.array(own[at])), b.column(2).take(pa.array(at)), pa.array(base.astype(np.int32)), pa.array(np.where(part > 1e-9, part, 0.0))], schema=arrow)

    rated = docs.select("doc_id", "category", "tokens", "posterior").mapInArrow(run, "mix_id int, doc_id bigint, category string, tokens bigint, base int, part double")
    unit = F.conv(F.substring(salted_hash(F.concat_ws(":", "mix_id", "doc_id"), salt), 1, 13), 16, 10).cast("double") / float(16**13)
    rated = settle(rated.withColumn("_z", F.when(F.col("part") > 0, unit / F.col("part"))), "mix-rated")
    sure = {(r.mix_id, r.category): r.n for r in rated.groupBy("mix_id", "category").agg(F.sum(F.col("tokens") * F.col("base")).alias("n")).collect()}
    aims = {(m, k): min(float(fit.given[i, j]), float(fit.want[i, j])) for i, m in enumerate(fit.mixes) for j, k in enumerate(fit.names)}
    gaps = {at: aim - sure.get(at, 0) for at, aim in aims.items() if aim - sure.get(at, 0) > 0}
    rest, picked = rated.where("part > 0 and tokens > 0"), None
    for _ in range(passes):
        # The first pass fills a source up to the first document that is too large; later ones fill what that left open.
        gaps = {at: gap for at, gap in gaps.items() if gap > tolerance * aims[at]}
        if not gaps:
            break
        took = settle(_fill(rest, gaps, fits=picked is not None), "mix-picked")
        got = {(r.mix_id, r.category): r.n for r in took.groupBy("mix_id", "category").agg(F.sum("tokens").alias("n")).collect()}
        picked = took if picked is None else picked.unionByName(took)
        if not got:
            break
        gaps = {at: gap - got.get(at, 0) for at, gap in gaps.items()}
        rest = rest.join(took.select("mix_id", "doc_id"), ["mix_id", "doc_id"], "left_anti")
    whole = rated.select("mix_id", "doc_id", "category", "tokens", F.col("base").alias("uses"))
    if picked is not None:
        more = picked.select("mix_id", "doc_id", F.lit(1).alias("_one"))
        whole = whole.join(more, ["mix_id", "doc_id"], "left").withColumn("uses", F.col("uses") + F.coalesce("_one", F.lit(0))).drop("_one")
    return whole.where("uses > 0")


def _fill(rest: DataFrame, gaps: dict[tuple[int, str], float], fits: bool) -> DataFrame:
    """The documents that fill each mix and source by rising draw number until the next one would overshoot by more than it
    adds; with fits, documents larger than the gap are passed over. Only the range of draw numbers in which a gap closes is
    ordered."""
    spark = rest.sparkSession
    gap = spark.createDataFrame([(m, k, g) for (m, k), g in gaps.items()], "mix_id int, category string, _gap double")
    near = rest.join(F.broadcast(gap), ["mix_id", "category"])  # a row for each mix and source, as on the driver
    if fits:
        near = near.where("tokens <= _gap")
    near = near.withColumn("_span", F.least(F.floor(F.col("_z") * (RANGES // 4)), F.lit(RANGES - 1)).cast("int"))
    by = near.groupBy("mix_id", "category", "_span").agg(F.sum("tokens").alias("_t"), F.max("_gap").alias("_gap"))
    before = F.sum("_t").over(W.partitionBy("mix_id", "category").orderBy("_span").rowsBetween(W.unboundedPreceding, -1))
    room = by.withColumn("_room", F.col("_gap") - F.coalesce(before, F.lit(0))).where("_room > 0").select("mix_id", "category", "_span", "_t", "_room")
    placed = near.drop("_gap").join(broadcast_if_small(room, 500_000), ["mix_id", "category", "_span"])
    upto = F.sum("tokens").over(W.partitionBy("mix_id", "category", "_span").orderBy("_z", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    edge = placed.where("_t > _room").withColumn("_upto", upto).where("_upto - tokens / 2 <= _room")
    keep = ["mix_id", "doc_id", "category", "tokens"]
    return placed.where("_t <= _room").select(*keep).unionByName(edge.select(*keep))


def share_report(drawn: DataFrame, short: DataFrame) -> DataFrame:
    """The targets with the tokens that the mix really has of the source, their share of its total (null for an empty mix), and
    the most uses made."""
    made = drawn.groupBy(F.col("mix_id").alias("_m"), F.col("category").alias("_k")).agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"), F.count(F.lit(1)).alias("documents"))
    got = short.join(made, (F.col("mix_id") == F.col("_m")) & (F.col("category") == F.col("_k")), "left").drop("_m", "_k")
    got = got.withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("most_uses", F.coalesce("most_uses", F.lit(0))).withColumn("documents", F.coalesce("documents", F.lit(0)))
    return got.withColumn("share", F.try_divide(F.col("tokens"), F.sum("tokens").over(W.partitionBy("mix_id"))))

