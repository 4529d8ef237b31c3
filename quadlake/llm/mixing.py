"""A mixture in which each source has its target share of the tokens.

Method: soft-membership mixing. A document of a listed source is a member of
that source; one whose source is missing gets the domain posteriors of a
classifier trained on labelled documents; one of another, unlisted source is a
member of none. Projected-gradient least squares then fits a rate between 0 and
the allowed repeats for every document, so that the expected tokens of each
domain meet their targets, and the rates are rounded to whole copies without
changing the totals of tokens by more than a few small documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadlake.llm.tokens import Encoder, shared_encoder, text_batches
from quadlake.session import ship, stage

#: Labelled documents the classifier is fitted on (those with the smallest
#: hash of their id), and the size of its hashed features.
TRAIN_ROWS, FEATURES = 2000, 1024
#: Passes of the least squares at most, and the residual at which they stop.
PASSES, TOLERANCE = 30, 1e-6
#: Documents rounded together, about; groups of a source are this large at every size.
GROUP_ROWS = 20_000
_SIZED = "doc_id {kind}, source string, tokens bigint, member array<double>"


@dataclass(frozen=True)
class Targets:
    """Listed sources in a fixed order, their shares and repeats."""

    sources: tuple[str, ...]
    shares: tuple[float, ...]
    repeats: tuple[int, ...]


def read_targets(weights: DataFrame) -> Targets:
    """Of the small table of sources; null or repeated sources after the first,
    and shares or repeats that are null, not positive or not numbers, are left out."""
    rows = weights.select("source", "target_share", "max_repeats").where("source is not null and target_share > 0 and not isnan(target_share) and max_repeats > 0").distinct().orderBy("source", "target_share", "max_repeats").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10000 sources")
    first = {}
    for r in rows:
        first.setdefault(r.source, r)
    return Targets(tuple(first), tuple(r.target_share for r in first.values()), tuple(r.max_repeats for r in first.values()))


# ------------------------------------------------------------------ classifier
def features(encoder: Encoder, text: str | None) -> np.ndarray:
    """Counts of the token ids, hashed, dampened and of length 1."""
    ids = np.frombuffer(encoder.encode_raw(text or ""), np.int32).astype(np.uint64)
    if not len(ids):
        return np.zeros(FEATURES)
    x = np.log1p(np.bincount(((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % FEATURES, minlength=FEATURES))
    return x / np.linalg.norm(x)


def fit_classifier(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 120, decay: float = 1e-4) -> np.ndarray:
    """Weights (features + 1) x classes of a softmax regression, by accelerated
    gradient descent from the class frequencies. Rows of length 1 and a constant
    bound the curvature by 1, so a step of 1 is safe. The same rows give the
    same weights."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    w = np.zeros((x.shape[1], classes), np.float32)
    counts = np.bincount(y, minlength=classes)
    w[-1] = np.where(counts > 0, np.log(np.maximum(counts, 1) / max(1, counts.sum())), -100.0)  # a domain without documents stays out
    one = np.eye(classes, dtype=np.float32)[y]
    ahead = w
    for k in range(steps):
        grad = x.T @ (posteriors(ahead, x, biased=True) - one) / max(1, len(x))
        grad[:-1] += decay * ahead[:-1]
        w, last = ahead - grad, w
        ahead = w + (k / (k + 3)) * (w - last)
    return w


def posteriors(w: np.ndarray, x: np.ndarray, biased: bool = False) -> np.ndarray:
    s = x @ w if biased else x @ w[:-1] + w[-1]
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def training_rows(docs: DataFrame, targets: Targets, rows: int = TRAIN_ROWS, path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most rows documents of listed sources: those
    with the smallest hash of their id. A bound on the hash keeps all others
    from leaving their task, however many tasks there are."""
    labelled = docs.where(F.col("source").isin(*targets.sources))
    share = min(1.0, (1.5 * rows + 200) / max(1, labelled.count()))
    known = labelled.select("source", "text", F.xxhash64(F.col("doc_id").cast("string")).alias("_h"))
    near = known.where(F.pmod("_h", F.lit(1 << 30)) <= F.lit(int(share * (1 << 30))))
    sample = near.orderBy("_h", "source").limit(rows).select("source", "text")
    get = shared_encoder(docs, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 1):
            x = [features(get(), t).astype(np.float32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["source", "x"])

    got = sample.mapInArrow(run, "source string, x binary").collect()
    x = np.array([np.frombuffer(r.x, np.float32) for r in got]).reshape(len(got), FEATURES)
    place = {s: i for i, s in enumerate(targets.sources)}
    return x, np.array([place[r.source] for r in got], np.int64)


# ---------------------------------------------------------------------- sizes
def sized_documents(docs: DataFrame, targets: Targets, weights: np.ndarray, path: str | None = None) -> DataFrame:
    """doc_id, source, tokens, member: the posteriors of documents without a
    source, null for all others. One pass over the texts, no shuffle."""
    rows = docs.select("doc_id", "text", F.when(F.trim("source") != "", F.col("source")).alias("source"))
    get = shared_encoder(docs, path)
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # (FEATURES + 1) x sources numbers, at most 4 MB a thousand sources

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        for batch in text_batches(batches, 1):
            encoder, texts, sources = get(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            tokens = [encoder.count(t) for t in texts]
            member = [None if s is not None or not targets.sources else posteriors(weights, features(encoder, t)[None])[0].tolist() for s, t in zip(sources, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pa.array(member, pa.list_(pa.float64()))], names=["doc_id", "source", "tokens", "member"])

    return rows.mapInArrow(run, _SIZED.format(kind=docs.schema["doc_id"].dataType.simpleString()))


# ---------------------------------------------------------------------- rates
@dataclass(frozen=True)
class Fit:
    """Start rates and the errors after each pass; a document's rate is folded
    from them, so no pass has to keep the rates of all documents."""

    start: tuple[float, ...]
    errors: tuple[tuple[float, ...], ...]
    caps: tuple[int, ...]
    targets: tuple[float, ...]
    residual: float

    def hard(self) -> list[float]:
        return [float(self.rates(np.eye(len(self.start))[[k]], self.caps[k])[0]) for k in range(len(self.start))]

    def rates(self, member: np.ndarray, cap: float) -> np.ndarray:
        r = np.clip(member @ np.array(self.start), 0, cap)
        for e in self.errors:
            r = np.clip(r - member @ np.array(e), 0, cap)
        return r


def soft_cap(targets: Targets) -> int:
    """Repeats of a document whose source is unknown: the fewest of any source."""
    return min(targets.repeats, default=0)


def _soft_totals(soft: DataFrame, fit: Fit, cap: int) -> np.ndarray:
    """Expected tokens of each domain from the soft documents."""
    k = len(fit.start)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                member = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                total += (fit.rates(member, cap) * batch.column(0).to_numpy(zero_copy_only=False)) @ member
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total)], names=["k", "v"])

    rows = soft.select("tokens", "member").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v")).collect()  # one row a domain
    out = np.zeros(k)
    for i, v in rows:
        out[i] = v
    return out


def fit_rates(sized: DataFrame, targets: Targets, total: float | None = None, passes: int = PASSES) -> Fit:
    """Nonnegative least squares of the expected domain tokens to their targets.

    total: tokens of the mixture; None takes the most that all available
    sources can give within their repeats. A listed source without tokens is
    not available: its share is spread over the others in proportion. Each
    pass moves every rate against the gradient, scaled by the document's tokens
    and the domain's, and projects it onto 0 to cap.
    """
    k = len(targets.sources)
    caps = np.array(targets.repeats, float)
    sums = {r.source: r.n for r in sized.where(F.col("source").isin(*targets.sources)).groupBy("source").agg(F.sum("tokens").alias("n")).collect()} if k else {}
    own = np.array([float(sums.get(s, 0)) for s in targets.sources])
    open_ = own > 0
    share = np.where(open_, targets.shares, 0.0)
    if not open_.any():
        return Fit((0.0,) * k, (), targets.repeats, (0.0,) * k, 0.0)
    share = share / share.sum()
    total = float(np.min((own * caps)[open_] / share[open_])) if total is None else float(total)
    want = total * share
    start = np.where(open_, np.minimum(want / np.maximum(own, 1), caps), 0.0)
    soft = sized.where("member is not null and tokens > 0")
    fit = Fit(tuple(start.tolist()), (), targets.repeats, tuple(want.tolist()), 1.0)
    cap = soft_cap(targets)
    ones = Fit((1.0,) * k, (), targets.repeats, (), 0.0)
    whole = own + _soft_totals(soft, ones, 1)
    for _ in range(passes):
        now = own * np.array(fit.hard()) + _soft_totals(soft, fit, cap)
        residual = float(np.abs(now - want)[open_].max() / max(total, 1))
        fit = Fit(fit.start, fit.errors, fit.caps, fit.targets, residual)
        if residual <= TOLERANCE:
            break
        error = np.where(open_, (now - want) / np.maximum(whole, 1), 0.0)
        fit = Fit(fit.start, (*fit.errors, tuple(error.tolist())), fit.caps, fit.targets, residual)
    return fit


def with_rates(sized: DataFrame, targets: Targets, fit: Fit) -> DataFrame:
    """Add rate, and domain: the source, or the most probable one if missing."""
    k = len(targets.sources)
    hard = fit.hard()
    known = F.create_map(*[F.lit(x) for s, r in zip(targets.sources, hard) for x in (s, r)]) if k else None
    rate = F.coalesce(F.try_element_at(known, F.col("source")), F.lit(0.0)) if k else F.lit(0.0)
    cap = soft_cap(targets)

    @F.pandas_udf("double")
    def soft_rate(member):
        out = np.zeros(len(member))
        has = member.notna().to_numpy()
        if has.any():
            out[has] = fit.rates(np.stack(member[has].to_list()), cap)
        return member.notna().astype(float) * out

    names = F.array(*[F.lit(s) for s in targets.sources]) if k else F.array().cast("array<string>")
    likely = F.get(names, F.array_position("member", F.array_max("member")).cast("int") - 1)
    hard_rows = sized.where("member is null").withColumns({"rate": rate, "domain": F.col("source")})
    soft_rows = sized.where("member is not null").withColumns({"rate": soft_rate("member"), "domain": likely})
    return hard_rows.unionByName(soft_rows)


def _extra_copies(tokens: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Which documents, in falling order of tokens, get one more copy, so that
    the tokens of these copies make up the sum of part * tokens: a document gets
    it when at least half of its tokens are owed."""
    out = np.zeros(len(tokens), bool)
    owed = 0.0
    for k, (n, f) in enumerate(zip(tokens.tolist(), part.tolist())):
        owed += f * n
        if f > 0 and 2 * owed >= n > 0:
            out[k] = True
            owed -= n
    return out


def with_copies(rated: DataFrame, n_rows: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add copies: rate rounded down, and one more for so many documents that
    the tokens of all copies are kept.

    Documents of a domain, those with and without a source apart, are cut by hash
    into groups of about group_rows. In a
    group they are taken from the largest to the smallest, and what one document
    leaves owed or overpaid is carried on to the next: each group is right to
    half of its smallest documents. A document without tokens, whose copies weigh
    nothing, gets no extra one.
    """
    groups = max(1, -(-n_rows // group_rows))
    key = F.xxhash64(F.col("doc_id").cast("string"), F.col("tokens"))
    rows = rated.withColumn("rate", F.round("rate", 9)).withColumn("_g", F.struct(F.pmod(key, F.lit(groups)), F.col("member").isNull())).withColumn("_h", key)
    schema = T.StructType([*rated.schema.fields, T.StructField("copies", T.IntegerType())])

    def deal(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tokens", "descending"), ("_h", "ascending"), ("doc_id", "ascending")])
        rate, tokens = table["rate"].to_numpy(), table["tokens"].to_numpy()
        base = np.floor(rate)
        copies = base + _extra_copies(tokens, rate - base)
        return table.drop_columns(["_g", "_h"]).append_column("copies", pa.array(copies.astype(np.int32)))

    ship(rated.sparkSession)
    return rows.groupBy("domain", "_g").applyInArrow(deal, schema)


def mixture(spark: SparkSession, docs: DataFrame, weights: DataFrame, total: float | None = None, path: str | None = None) -> tuple[DataFrame, Targets, Fit]:
    """doc_id, source, domain, tokens, member, rate, copies of every document.

    Null and empty texts have no tokens, so their copies weigh nothing. A
    document without a source (null or blank) may be used as often as the
    strictest source allows; one of an unlisted source never. Rows that repeat
    are separate documents. Empty documents or weights give no copies.
    """
    docs, targets = docs.select("doc_id", "text", "source"), read_targets(weights)
    x, y = training_rows(docs, targets, path=path) if targets.sources else (np.zeros((0, FEATURES)), np.zeros(0, np.int64))
    model = fit_classifier(x, y, len(targets.sources)) if targets.sources else np.zeros((FEATURES + 1, 1))
    sized = stage(spark, sized_documents(docs, targets, model, path), "sized")
    fit = fit_rates(sized, targets, total)
    return with_copies(with_rates(sized, targets, fit), sized.count()), targets, fit


def share_report(mixed: DataFrame, targets: Targets, fit: Fit) -> DataFrame:
    """For every listed source: target_share, fitted_share (after sources that
    have no documents are left out), actual_share of the tokens, n_tokens,
    n_documents used, most_copies and the rate of its documents.

    A document without a source counts for each source by its posterior.
    """
    spark, k = mixed.sparkSession, len(targets.sources)
    if not k:
        return spark.createDataFrame([], "source string, target_share double, fitted_share double, actual_share double, n_tokens double, n_documents bigint, most_copies int, rate double")
    names = F.array(*[F.lit(s) for s in targets.sources])
    hard = F.array(F.struct(F.col("source").alias("source"), F.lit(1.0).alias("part")))
    soft = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(F.get(names, i).alias("source"), F.get("member", i).alias("part")))
    used = mixed.where("copies > 0").select("tokens", "copies", F.explode(F.when(F.col("member").isNull(), hard).otherwise(soft)).alias("_m"), F.col("member").isNull().alias("_hard"))
    sums = used.groupBy("_m.source").agg(
        F.sum(F.col("tokens") * F.col("copies") * F.col("_m.part")).alias("n_tokens"),
        F.count(F.when(F.col("_hard"), 1)).alias("n_documents"),
        F.max(F.when(F.col("_hard"), F.col("copies"))).alias("most_copies"),
    )
    asked = sum(fit.targets)
    listed = spark.createDataFrame([(s, t, w / asked if asked else 0.0, r) for s, t, w, r in zip(targets.sources, targets.shares, fit.targets, fit.hard())], "source string, target_share double, fitted_share double, rate double")
    rows = listed.join(sums, "source", "left").fillna(0, ["n_tokens", "n_documents", "most_copies"])
    every = F.sum("n_tokens").over(Window.partitionBy())  # one row a listed source
    return rows.select("source", "target_share", "fitted_share", F.coalesce(F.try_divide("n_tokens", every), F.lit(0.0)).alias("actual_share"), "n_tokens", "n_documents", "most_copies", "rate")
