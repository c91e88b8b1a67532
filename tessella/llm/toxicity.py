"""Toxicity by a classifier chain.

Categories are predicted one after another, each by a linear (logistic) model over which words a text has; every
later model also gets the log-odds of the earlier categories. In training these come from out-of-fold
predictions (FOLDS folds by a hash of the id), so a later model learns from probabilities as they will be for
texts nobody has labelled. A category's cutoff is the one of best F1 on its out-of-fold predictions.

The labels have one category, toxic. The second, severe, is derived from them: toxic, with SEVERE_WORDS or more
different words that are significant for toxic texts among CUE_PART of the labelled documents. Those documents serve for
that alone: no model of the chain is fitted to them, so the derived label does not come from a model's own features, and
the out-of-fold predictions are of documents that neither the fold's models nor the words of the label have seen.

Training uses a sample of at most SAMPLE labelled documents (those whose ids hash lowest), a documented bound
that keeps the driver's share the same at every size; every document is scored, on its whole text. Words that
are not significant (|z| < MIN_Z, a bound that random words of a long text do not pass) have no weight, so a long
text does not collect noise.

Null texts count as empty and get the probability of a text without significant words. Null labels are ignored,
of several labels of one id the highest counts. Without labels of both classes nothing is toxic, with
probability equal to the share of toxic labels (0 without any). Repeated rows are scored alike.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialize, ship

#: Labelled documents that are used for training at most.
SAMPLE = 10_000
FOLDS = 5
#: Significance that a word needs, and words that a model has at most.
MIN_Z, MAX_WORDS = 5.0, 300
SEVERE_WORDS = 3
#: One in so many labelled documents (by a hash of the id) gives the words that the second category is derived from.
CUE_PART = 4
CATEGORIES = ("toxic", "severe")
#: Hashed words.
SPACE_BITS = 22
_STRIP = b".,;:!?\"'()[]{}|*#$%&<>-_/"
CACHE_WORDS = 200_000


class _Features(dict):
    def __missing__(self, word: bytes) -> int:
        bare = word.strip(_STRIP)
        self[word] = h = zlib.crc32(bare) & ((1 << SPACE_BITS) - 1) if bare else -1
        return h


_features = _Features()


def features_of(text: str | None) -> set[int]:
    """Hashes of the different words of a text."""
    if len(_features) > CACHE_WORDS:
        _features.clear()
    out = set(map(_features.__getitem__, (text or "").lower().encode().split()))
    out.discard(-1)
    return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class LinearModel:
    """Logistic regression on the significant words and some further columns, by Newton's method."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, extra: np.ndarray, y: np.ndarray, penalty: float = 0.1):
        rows, n1, n0 = np.repeat(np.arange(len(y)), lengths), max(y.sum(), 1), max((~y).sum(), 1)
        size = 1 << SPACE_BITS
        a = np.bincount(flat[y[rows]], minlength=size) / n1
        b = np.bincount(flat[~y[rows]], minlength=size) / n0
        share = (a * n1 + b * n0) / (n1 + n0)
        z = (a - b) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
        strong = np.flatnonzero((np.abs(z) >= MIN_Z) & (share * (n1 + n0) >= 3))
        self.words = np.sort(strong[np.argsort(-np.abs(z[strong]), kind="stable")[:MAX_WORDS]])
        self.positive = self.words[z[self.words] > 0]
        x = np.hstack([self._dense(flat, lengths), extra, np.ones((len(y), 1))])
        w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
        ridge[-1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.w, self.bias = w[: len(self.words)], w[-1]
        self.extra = w[len(self.words) : -1]

    def _dense(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        rows = np.repeat(np.arange(len(lengths)), lengths)
        at = np.searchsorted(self.words, flat)
        hit = np.append(self.words, -1)[at] == flat
        x = np.zeros((len(lengths), len(self.words)))
        x[rows[hit], at[hit]] = 1
        return x

    def predict(self, flat: np.ndarray, lengths: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._dense(flat, lengths) @ self.w + extra @ self.extra + self.bias, -30, 30)))


def _constant(p: float) -> dict:
    return {"words": {}, "extra": [], "bias": float(_logit(np.array([p]))[0]) if p > 0 else -30.0, "cutoff": 2.0}


def _best_cutoff(p: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    following = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + following) / 2)


def fit_chain(ids: np.ndarray, flat: np.ndarray, lengths: np.ndarray, toxic: np.ndarray) -> list[dict]:
    """Models of CATEGORIES, each with words, weights of earlier categories, bias and cutoff."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    some = lambda use: np.concatenate([flat[starts[i] : starts[i + 1]] for i in np.flatnonzero(use)] or [flat[:0]])
    cue = np.array([zlib.crc32(f"cue:{i}".encode()) % CUE_PART == 0 for i in ids], bool)
    cues = np.zeros(0, np.int64)
    if 0 < toxic[cue].sum() < cue.sum():
        cues = LinearModel(some(cue), lengths[cue], np.zeros((cue.sum(), 0)), toxic[cue]).positive
    if not cue.all():
        ids, flat, lengths, toxic = ids[~cue], some(~cue), lengths[~cue], toxic[~cue]
    n = len(toxic)
    if not 0 < toxic.sum() < n:
        return [_constant(float(toxic.mean()) if n else 0.0)] + [{**_constant(0.0), "extra": [0.0] * k} for k in range(1, len(CATEGORIES))]
    fold = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in ids])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    part = lambda use: (np.concatenate([flat[starts[i] : starts[i + 1]] for i in np.flatnonzero(use)] or [flat[:0]]), lengths[use])
    earlier, models, y = np.zeros((n, 0)), [], toxic
    for k, _ in enumerate(CATEGORIES):
        if k:
            y = toxic & (np.bincount(np.repeat(np.arange(n), lengths), weights=np.isin(flat, cues), minlength=n) >= SEVERE_WORDS)
        if not 0 < y.sum() < n:
            models.append({**_constant(float(y.mean())), "extra": [0.0] * k})
            earlier = np.hstack([earlier, np.full((n, 1), models[-1]["bias"])])
            continue
        out = np.full(n, y.mean())
        for f in range(FOLDS):
            use = fold != f
            if 0 < y[use].sum() < use.sum() and (~use).any():
                out[~use] = LinearModel(*part(use), earlier[use], y[use]).predict(*part(~use), earlier[~use])
        whole = LinearModel(flat, lengths, earlier, y)
        models.append({"words": dict(zip(whole.words.tolist(), whole.w.tolist(), strict=True)), "extra": whole.extra.tolist(), "bias": float(whole.bias), "cutoff": _best_cutoff(out, y)})
        earlier = np.hstack([earlier, _logit(out)[:, None]])
    return models


def _collect_features(batches):
    import pyarrow as pa

    for batch in batches:
        got = [sorted(features_of(t)) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.int32()))], ["doc_id", "toxic", "words"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    spark = docs.sparkSession
    ship(spark)
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").cast("int").alias("l_toxic"))
    chosen = materialize(marked.orderBy(F.xxhash64("l_id"), "l_id").limit(SAMPLE), "sample")  # SAMPLE rows at most
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
    got = rows.select("doc_id", "l_toxic", "text").mapInArrow(_collect_features, "doc_id long, toxic int, words array<int>").toArrow()
    ids, toxic = got["doc_id"].to_numpy(), got["toxic"].to_numpy() > 0
    words = got["words"].combine_chunks()
    order = np.argsort(ids, kind="stable")
    flat, offsets = words.values.to_numpy(zero_copy_only=False).astype(np.int64), words.offsets.to_numpy()
    flat = np.concatenate([flat[offsets[i] : offsets[i + 1]] for i in order] or [flat[:0]])
    return fit_chain(ids[order], flat, np.diff(offsets)[order].astype(np.int64), toxic[order])


def score(docs: DataFrame, models: list[dict], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, and p_<category> and <category> for each category, of every row."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        tables = [m["words"] for m in models]
        for batch in batches:
            cols: list[list] = [[] for _ in models]
            for t in batch.column(1).to_pylist():
                has, logits = features_of(t), []
                for k, m in enumerate(models):
                    x = m["bias"] + sum(m["words"][w] for w in sorted(has & tables[k].keys())) + sum(a * b for a, b in zip(m["extra"], logits, strict=True))
                    p = 1 / (1 + np.exp(-min(max(x, -30.0), 30.0)))
                    logits.append(float(_logit(np.array([p]))[0]))
                    cols[k].append(float(p))
            out = [batch.column(0)]
            for m, c in zip(models, cols, strict=True):
                out += [pa.array(c, pa.float64()), pa.array([p >= m["cutoff"] for p in c], pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", *(x for c in CATEGORIES for x in (f"p_{c}", c))])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"p_{c} double, {c} boolean" for c in CATEGORIES))


def op3(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels))
