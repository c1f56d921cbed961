"""Quality and toxicity of documents by hierarchical empirical Bayes.

1. Evidence of a document: two logistic models over its structure (shares of marks, capitals and digits, word
   lengths, repeats) and over marker words. They are fitted to a bounded sample of labelled rows: ``FIT_ROWS``, those
   with the least hashes of doc_id. Marker words are the ``MARKERS`` words of the sample that tell the labels apart
   best (the signed root of the likelihood ratio).
2. Every document is scored. Sites are summed in grouped aggregations over all documents: each host, and each path below
   it (here: source, and language within the source). A labelled document counts with its label, any other with the
   probability that its evidence gives.
3. A host's rate is shrunk towards the global rate, and a path's towards its host's, by a beta prior whose strength is
   fitted to the spread of the sites by moments; sparse sites take the rate above them. A document's own share is left
   out of the rates that it is judged by.
4. A document's log odds are its evidence plus the difference between its path's and the global log odds.

Kept: toxic < 0.5 and quality >= 0.5. Nulls: a null text is an empty one; a null source or language is a site of its
own. Labelled documents that are missing, and null labels, are ignored; without usable labels of both kinds a model
gives 0.5 for quality and 0 for toxicity. Repeated rows each count, repeated labels of a document are averaged, ties
between marker words go by hash. Extra columns are ignored. An empty table gives no rows. A text is held whole in a
worker, with some 60 times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import find_words, slices

FIT_ROWS = 20_000
MARKERS = 256
LEAST_ROOT = 5.0
#: Sums of sites, and labels, are broadcast up to so many rows (some 100 bytes each), else joined by a shuffle.
BROADCAST_ROWS = 200_000
TARGETS = ("low", "toxic")
STRUCTURE = 10

_upper, _digit, _symbol, _shout, _line, _bar, _any = (np.zeros(256, bool) for _ in range(7))
_upper[65:91] = True
_digit[48:58] = True
_symbol[[ord(c) for c in "#*$%&<>"]] = True
_shout[33] = True
_line[10] = True
_bar[124] = True
_any[:] = True


def structure(raw: np.ndarray, off: np.ndarray, words, bare) -> np.ndarray:
    """STRUCTURE numbers of each text, each about 0 to 1."""
    n = np.maximum(np.diff(off), 1)
    count = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[raw])])[off])
    n_words = np.diff(words.first)
    some = np.maximum(n_words, 1)
    lengths = np.concatenate([[0], np.cumsum(words.end - words.start)])
    mean = (lengths[words.first[1:]] - lengths[words.first[:-1]]) / some
    text = bare.text_of
    order = np.lexsort((bare.hash, text))
    h, t = bare.hash[order], text[order]
    new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])) if len(h) else np.zeros(0, bool)
    distinct = np.bincount(t[new], minlength=len(n))
    columns = [count(_upper) / n, count(_digit) / n, count(_symbol) / some, count(_shout) / some, count(_line) / some, count(_bar) / some, np.minimum(mean, 20) / 10, distinct / np.maximum(np.diff(bare.first), 1), np.log1p(n_words) / 8, n_words == 0]
    return np.stack([c.astype(np.float64) for c in columns], axis=1)


def _distinct(bare) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct words of each text."""
    text = bare.text_of
    order = np.lexsort((bare.hash, text))
    h, t = bare.hash[order], text[order]
    new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])) if len(h) else np.zeros(0, bool)
    return t[new], h[new]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, documents, low quality, toxic) of each batch."""
    for batch in batches:
        low = 1 - batch.column(1).to_numpy(zero_copy_only=False)
        toxic = batch.column(2).to_numpy(zero_copy_only=False)
        for i, j, raw, off in slices(batch):
            t, h = _distinct(find_words(raw, off, bare=True))
            if len(h):
                words, which = np.unique(h, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), *[pa.array(np.bincount(which, x[t]).astype(np.int64)) for x in (np.ones(j - i), low[i:j], toxic[i:j])]], ["word", "n", "low", "toxic"])


def _features(raw: np.ndarray, off: np.ndarray, several: list[np.ndarray]) -> list[np.ndarray]:
    """Structure and marker words of each text, for each of several lists of markers."""
    bare = find_words(raw, off, bare=True)
    shape = structure(raw, off, find_words(raw, off), bare)
    t, h = _distinct(bare)
    out = []
    for markers in several:
        hits = np.zeros((len(off) - 1, len(markers)))
        if len(markers):
            place = np.minimum(np.searchsorted(markers, h), len(markers) - 1)
            ok = markers[place] == h
            hits[t[ok], place[ok]] = 1
        out.append(np.concatenate([shape, hits], axis=1))
    return out


def _sample_features(markers: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in slices(batch):
                x = _features(raw, off, [markers])[0].astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i)], ["x", "quality", "toxic"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, turns: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the constant last, mean, scale) by Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + ridge * w
        curve = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, rows: int = FIT_ROWS) -> dict:
    """The two models, from at most ``rows`` labelled documents."""
    chosen = labels.where("doc_id is not null and quality is not null and toxic is not null").select("doc_id", "quality", "toxic")
    chosen = scratch.save(chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "toxic").limit(rows), "chosen")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    sample = scratch.save(sample, "sample")
    size = sample.agg(F.count("*"), F.sum(1 - F.col("quality")), F.sum("toxic")).first()
    n = float(size[0] or 0)
    words = sample.mapInArrow(_word_counts, "word long, n long, low long, toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic")).where("n >= 5")
    models: dict = {}
    for target, total in (("low", float(size[1] or 0)), ("toxic", float(size[2] or 0))):
        if not 0 < total < n:
            models[target] = None
            continue
        a, b = F.col(target).cast("double"), (F.col("n") - F.col(target)).cast("double")
        ea, eb = F.col("n") * (total / n), F.col("n") * (1 - total / n)
        ratio = 2 * (F.when(a > 0, a * F.ln(a / ea)).otherwise(0.0) + F.when(b > 0, b * F.ln(b / eb)).otherwise(0.0))
        top = words.select("word", F.sqrt(F.greatest(ratio, F.lit(0.0))).alias("root")).where(F.col("root") >= LEAST_ROOT).orderBy(F.desc("root"), "word").limit(MARKERS)
        markers = np.sort(np.array([r[0] for r in top.collect()], np.int64).view(np.uint64))
        got = sample.mapInArrow(_sample_features(markers), "x binary, quality double, toxic double").toPandas()
        x = np.stack([np.frombuffer(b, np.float32) for b in got["x"]]).astype(np.float64)
        y = (1 - got["quality"] if target == "low" else got["toxic"]).to_numpy(float)
        models[target] = (markers, *logistic(x, y))
    scratch.drop("sample", "chosen")
    return models


def _evidence(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            for i, j, raw, off in slices(batch):
                fitted = [t for t in ("low", "toxic") if models[t] is not None]
                features = dict(zip(fitted, _features(raw, off, [models[t][0] for t in fitted]), strict=True))
                columns = []
                for target, empty in (("low", 0.0), ("toxic", -30.0)):
                    if target not in features:
                        columns.append(np.full(j - i, empty))
                        continue
                    _, w, mean, scale = models[target]
                    columns.append(np.clip((features[target] - mean) / scale @ w[:-1] + w[-1], -30, 30))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in range(3)] + [pa.array(c) for c in columns], ["doc_id", "host", "path", "low", "toxic"])

    return run


def _sigmoid(x) -> F.Column:
    return 1 / (1 + F.exp(-x))


def _logit(p) -> F.Column:
    safe = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.ln(safe / (1 - safe))


def with_labels(scored: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """``scored`` with y_low and y_toxic: the label, or else the probability that the evidence gives."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(1 - F.col("quality")).alias("l_low"), F.avg(F.col("toxic")).alias("l_toxic"))
    known = scratch.save(known, "known")
    small = known.count() <= BROADCAST_ROWS
    joined = scored.join(F.broadcast(known) if small else known, "doc_id", "left")
    return joined.select("doc_id", "host", "path", *TARGETS, *[F.coalesce(F.col(f"l_{t}").cast("double"), _sigmoid(F.col(t))).alias(f"y_{t}") for t in TARGETS])


def site_sums(given: DataFrame) -> DataFrame:
    """host, path, the sums of the path (n, p_*) and of its host (hn, h_*), the global rates (g_*) and the strengths of
    the priors of paths (sp_*) and of hosts (sh_*)."""
    paths = given.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(f"y_{t}").alias(f"p_{t}") for t in TARGETS])
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), *[F.sum(f"p_{t}").alias(f"h_{t}") for t in TARGETS])
    everywhere = hosts.agg(*[(F.sum(f"h_{t}") / F.sum("hn")).alias(f"g_{t}") for t in TARGETS])

    def strength(table: DataFrame, of: dict[str, tuple[str, str, str]]) -> DataFrame:
        """One row: how many documents a prior weighs, from the spread of rates around the level above."""
        out = []
        for name, (total, n, above) in of.items():
            rate = F.col(total) / F.col(n)
            spread = F.sum(F.col(n) * (rate - F.col(above)) * (rate - F.col(above))) / F.sum(n)
            plain = F.sum(F.col(n) * F.col(above) * (1 - F.col(above))) / F.sum(n)
            out.append(F.when(spread > 0, F.greatest(F.lit(1.0), F.least(F.lit(1e6), plain / spread - 1))).otherwise(F.lit(1e6)).alias(name))
        return table.agg(*out)

    h = hosts.join(F.broadcast(everywhere))  # one row
    h = h.join(F.broadcast(strength(h, {f"sh_{t}": (f"h_{t}", "hn", f"g_{t}") for t in TARGETS})))
    p = paths.join(h, "host").withColumns({f"r_{t}": (F.col(f"h_{t}") + F.col(f"g_{t}") * F.col(f"sh_{t}")) / (F.col("hn") + F.col(f"sh_{t}")) for t in TARGETS})
    p = p.join(F.broadcast(strength(p, {f"sp_{t}": (f"p_{t}", "n", f"r_{t}") for t in TARGETS})))
    return p.drop(*[f"r_{t}" for t in TARGETS])


def posterior(target: str) -> F.Column:
    """Log odds of a row with its evidence and its site's sums, its own share left out of these."""
    c = lambda x: F.col(f"{x}_{target}")
    host = (c("h") - c("y") + c("g") * c("sh")) / (F.col("hn") - 1 + c("sh"))
    path = (c("p") - c("y") + host * c("sp")) / (F.col("n") - 1 + c("sp"))
    return F.col(target) + _logit(path) - _logit(c("g"))


def judge(given: DataFrame, sums: DataFrame) -> DataFrame:
    """doc_id, quality, toxic (probabilities) and kept of each row of ``given``."""
    out = given.join(sums, ["host", "path"]).select("doc_id", F.round(1 - _sigmoid(posterior("low")), 6).alias("quality"), F.round(_sigmoid(posterior("toxic")), 6).alias("toxic"))
    return out.withColumn("kept", (F.col("toxic") < 0.5) & (F.col("quality") >= 0.5))


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, quality, toxic (probabilities) and kept of each row."""
    models = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, scratch))
    site = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias({"source": "host", "lang": "path"}[c])
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), site("source"), site("lang"), F.col("text").cast("string").alias("text"))
    scored = scratch.save(given.mapInArrow(_evidence(models), "doc_id long, host string, path string, low double, toxic double"), "evidence")
    given = with_labels(scored, labels, scratch)
    sums = scratch.save(site_sums(given), "sites")
    return judge(given, F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums)
