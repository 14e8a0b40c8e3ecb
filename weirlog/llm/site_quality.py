"""Hierarchical empirical Bayes: a document classifier's evidence with priors of host and path.

A logistic model over hashed words gives each document's own evidence. Grouped sums of it give
every host and every path within a host a posterior mean, shrunk towards its parent (path to host, host
to all) by a strength estimated from how much siblings differ beyond chance. A document's final log-odds are its
own plus what its path departs from the whole, itself left out of its path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.llm import texts
from weirlog.llm.jaccard import word_hashes
from weirlog.session import join_lookup, settle

#: Labelled documents that the model is fitted on, at most: those with the least hashes of their ids.
SAMPLE = 12_000
#: Columns of the hashed space, and how many of them each target keeps, by chi-square.
SPACE_BITS, KEPT = 20, 1500
LEAST_DOCS = 8
#: Pull of the weights towards nothing.
SHRINK = 2e-5
PREFIX = 5
#: How far site evidence counts against a document's own.
SITE_WEIGHT = 0.5
#: Hosts and paths are broadcast up to this many rows (some 10 MB), and joined by shuffle beyond.
SITE_ROWS = 100_000
#: Bounds of a prior's strength in documents; the upper one is also that of sites that do not differ.
LEAST_STRENGTH, MOST = 2.0, 1000.0
TARGETS = ("quality", "toxic")
MEASURES = 7
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot) of distinct hashed words and word beginnings, and dense measures of each row."""
    raw, off = texts.bytes_of(column)
    low = _LOWER[raw]
    marks = texts.table_of(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
    starts, ends, rows = texts.words(raw, off, marks)
    n = len(column)
    measures = np.zeros((n, MEASURES), np.float32)
    size = np.maximum(off[1:] - off[:-1], 1)
    for k, chars in enumerate((b"#*$%&|<>", b"!?", bytes(range(65, 91)), b"0123456789")):
        total = np.concatenate([[0], np.cumsum(texts.table_of(chars)[raw])])
        measures[:, k] = (total[off[1:]] - total[off[:-1]]) / size
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), measures
    with np.errstate(over="ignore"):
        word = word_hashes(low, starts, ends)
        lead = word_hashes(low, starts, np.minimum(starts + PREFIX, ends)) ^ np.uint64(0x5851F42D4C957F2D)
    counts = texts.sums_by_row(rows, None, n)
    shift = np.uint64(64 - SPACE_BITS)
    key = np.unique(np.concatenate([rows, rows]).astype(np.int64) << SPACE_BITS | (np.concatenate([word, lead]) >> shift).astype(np.int64))
    distinct = np.unique(rows.astype(np.int64) << SPACE_BITS | (word >> shift).astype(np.int64)) >> SPACE_BITS
    measures[:, 4] = texts.sums_by_row(distinct, None, n) / np.maximum(counts, 1)
    measures[:, 5] = np.log1p(counts) / 5
    measures[:, 6] = (ends - starts).sum() and texts.sums_by_row(rows, (ends - starts).astype(np.float64), n) / np.maximum(counts, 1) / 10
    return key >> SPACE_BITS, key & ((1 << SPACE_BITS) - 1), measures


class Model:
    """Logistic models of the targets over chosen slots and measures."""

    def __init__(self, slots, weights, mean, scale):
        self.slots, self.weights, self.mean, self.scale = slots, weights, mean, scale

    def logits(self, column: pa.Array) -> np.ndarray:
        rows, slot, measures = hashed_words(column)
        at = np.minimum(np.searchsorted(self.slots, slot), len(self.slots) - 1)
        hit = self.slots[at] == slot
        dense = (measures - self.mean) / self.scale
        out = []
        for w in self.weights:
            n = len(self.slots)
            words = np.bincount(rows[hit], w[at[hit]], len(column))
            out.append(words + np.clip(dense, -8, 8) @ w[n:-1] + w[-1])
        return np.clip(np.array(out).T, -15, 15)


def fit(rows: list[np.ndarray], measures: np.ndarray, truth: np.ndarray, steps: int = 250) -> Model:
    """Fit on slots (one array per document), measures and 0/1 labels, one column per target."""
    slot = np.concatenate([*rows, np.zeros(0, np.int32)])
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    keep = np.zeros(1 << SPACE_BITS, bool)
    total = np.bincount(slot, minlength=len(keep)).astype(np.float64)
    for y in truth.T:
        hits = np.bincount(slot[(y > 0)[owner]], minlength=len(keep))
        share = y.mean()
        chi = (hits - total * share) ** 2 / np.maximum(total * share * (1 - share), 1e-9)
        chi[total < LEAST_DOCS] = 0
        best = np.argsort(-chi, kind="stable")[:KEPT]
        keep[best[chi[best] > 10]] = True
    number = np.cumsum(keep) - 1
    some = keep[slot]
    n = int(keep.sum())
    doc, word = owner[some], number[slot[some]]
    mean, scale = measures.mean(0), measures.std(0) + 1e-3
    dense = np.column_stack([np.clip((measures - mean) / scale, -8, 8), np.ones(len(rows))])
    weights = []
    for y in truth.T:
        w = np.zeros(n + MEASURES + 1)
        first, second = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            logit = np.bincount(doc, w[word], len(rows)) + dense @ w[n:]
            off = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
            g = np.concatenate([np.bincount(word, off[doc], n), dense.T @ off]) + SHRINK * np.append(w[:-1], 0)
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            w = w - 0.08 * 0.99**step * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights.append(w)
    return Model(np.flatnonzero(keep) if n else np.array([-1]), weights if n else [np.concatenate([[0.0], w]) for w in weights], mean, scale)


def trained(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Model of at most ``SAMPLE`` labelled documents; None where there are none."""
    chosen = (
        labels.where("doc_id is not null and quality is not null and toxic is not null")
        .dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    )
    sample = docs.join(F.broadcast(settle(chosen)), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "quality", "toxic", "text")

    def run(batches):
        for batch in batches:
            for part in texts.slices(batch, "text"):
                rows, slot, measures = hashed_words(part.column("text"))
                cut = np.searchsorted(rows, np.arange(part.num_rows + 1))
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"), "quality": part.column("quality").cast(pa.int32()), "toxic": part.column("toxic").cast(pa.int32()),
                        "slots": pa.array([slot[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                        "measures": pa.array([m.tobytes() for m in measures], pa.binary()),
                    }
                )

    found = sorted(
        sample.mapInArrow(run, "doc_id bigint, quality int, toxic int, slots binary, measures binary").collect(), key=lambda r: r.doc_id
    )
    if not found:
        return None
    return fit(
        [np.frombuffer(r.slots, np.int32) for r in found],
        np.stack([np.frombuffer(r.measures, np.float32) for r in found]),
        np.array([[r.quality, r.toxic] for r in found], np.float64),
    )


def variances(hosts: DataFrame, target: str) -> tuple[float, float, float]:
    """Variance of probabilities among documents of a path, paths of a host, and hosts, by moments.

    Sums of squares at each level are held against what chance and the levels below add to them, whatever the
    numbers of documents are. Where no path has two documents, sites cannot be told from chance, and
    the two latter are 0.
    """
    t = target
    r = hosts.selectExpr(
        "coalesce(sum(n), 0L) as n", "count(*) as hosts", "coalesce(sum(paths), 0L) as paths", f"sum(s_{t}) as s", f"sum(q_{t}) as q", f"sum(r_{t}) as by_path",
        f"sum(s_{t} * s_{t} / n) as by_host", "sum(w) as w", "sum(w / n) as w_host", "sum(cast(n as double) * n) as w_all",
    ).first()
    if r.n <= r.paths:
        return 0.0, 0.0, 0.0
    chance = max(0.0, r.q - r.by_path) / (r.n - r.paths)
    path = max(0.0, r.by_path - r.by_host - (r.paths - r.hosts) * chance) / max(r.n - r.w_host, 1.0) if r.paths > r.hosts else 0.0
    among = r.by_host - r.s * r.s / r.n - (r.hosts - 1) * chance - (r.w_host - r.w / r.n) * path
    host = max(0.0, among) / max(r.n - r.w_all / r.n, 1.0) if r.hosts > 1 else 0.0
    # differences within rounding of the sums are none
    dust = 1e-12 * max(r.q, 1.0)
    return chance, path if path * r.n > dust else 0.0, host if host * r.n > dust else 0.0


def _strength(noise: str, effect: float) -> str:
    """Documents a prior counts for: variance of a document over that of the effect, within bounds."""
    return f"least({MOST}, greatest({LEAST_STRENGTH}, ({noise}) / {effect!r}D))" if effect > 0 else f"{MOST}"


def site_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
    path_column: str = "lang",
) -> DataFrame:
    """(doc_id, host, path, p_quality, p_toxic, host_quality, path_quality, quality, toxic, kept).

    ``p_*`` are the document's own probabilities, ``quality`` and ``toxic`` those with its site's
    evidence; ``kept`` asks for quality of a half or more and toxicity below 0.3. One row per row
    of ``docs``; ids may be null or repeat. A null text is empty, a null host or path is a site of
    its own. Labels that are null or without a document are left out, of repeated ones one counts.
    Without labels all probabilities are a half and everything is kept but for toxicity, which is 0.
    Extra columns are ignored whatever their names. An empty table gives an empty result.
    """
    docs = texts.pick(docs, id_column, text_column, host_column, path_column).toDF("doc_id", "text", "host", "path")
    labels = texts.pick(labels, "doc_id", *TARGETS)
    model = trained(docs.select("doc_id", "text"), labels)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            for part in texts.slices(batch, "text"):
                if held.value is None:
                    logit = np.tile([0.0, -15.0], (part.num_rows, 1))
                else:
                    logit = held.value.logits(part.column("text"))
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id").cast(pa.int64()), "host": part.column("host").cast(pa.string()), "path": part.column("path").cast(pa.string()),
                        "l_quality": logit[:, 0], "l_toxic": logit[:, 1],
                    }
                )

    scored = settle(docs.mapInArrow(score, "doc_id bigint, host string, path string, l_quality double, l_toxic double"))
    return posteriors(scored)


def sites(scored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with probabilities, and sums of these by path and by host."""
    own = scored.selectExpr(
        "*", "coalesce(host, '') as h", "coalesce(path, '') as p", *[f"1 / (1 + exp(-l_{t})) as p_{t}" for t in TARGETS]
    )
    sums = [F.expr(e) for t in TARGETS for e in (f"sum(p_{t}) as s_{t}", f"sum(p_{t} * p_{t}) as q_{t}")]
    paths = settle(own.groupBy("h", "p").agg(F.count("*").alias("n"), *sums))
    parts = [F.expr(e) for t in TARGETS for e in (f"sum(s_{t}) as s_{t}", f"sum(q_{t}) as q_{t}", f"sum(s_{t} * s_{t} / n) as r_{t}")]
    hosts = settle(
        paths.groupBy("h").agg(F.expr("sum(n) as n"), F.expr("count(*) as paths"), F.expr("sum(cast(n as double) * n) as w"), *parts)
    )
    return own, paths, hosts


def posteriors(scored: DataFrame) -> DataFrame:
    """The columns of ``site_quality`` from (doc_id, host, path, l_quality, l_toxic), the log-odds of each
    document's own evidence. ``scored`` is read twice."""
    own, paths, hosts = sites(scored)
    whole = hosts.selectExpr(*[f"coalesce(sum(s_{t}) / sum(n), 0.5) as m_{t}" for t in TARGETS]).first()
    mean = {t: f"{min(0.999, max(0.001, whole[f'm_{t}']))!r}D" for t in TARGETS}
    host, of_path = [], {}
    for t in TARGETS:
        chance, path, among = variances(hosts, t)
        of_path[t] = _strength(f"{chance!r}D", path)
        # a host's mean varies with its paths, the more the fewer they are
        of_host = _strength(f"{chance!r}D + {path!r}D * w / n", among)
        host.append(f"({of_host} * {mean[t]} + s_{t}) / ({of_host} + n) as host_{t}")
    site = paths.join(hosts.selectExpr("h", *host), "h").withColumnsRenamed({"n": "site_n"})
    joined = join_lookup(own, site, ["h", "p"], max_rows=SITE_ROWS)
    # the path's posterior without the document itself
    posterior = {t: f"(({of_path[t]} * host_{t} + s_{t} - p_{t}) / ({of_path[t]} + site_n - 1))" for t in TARGETS}
    final = joined.selectExpr("*", *[f"{posterior[t]} as path_{t}" for t in TARGETS])
    odds = {
        t: f"1 / (1 + exp(-(l_{t} + {SITE_WEIGHT} * (ln(path_{t} / (1 - path_{t})) - ln({mean[t]} / (1 - {mean[t]}))))))" for t in TARGETS
    }
    return final.selectExpr(
        "doc_id", "host", "path", "p_quality", "p_toxic", "host_quality", "path_quality", *[f"{odds[t]} as {t}" for t in TARGETS]
    ).selectExpr("*", "quality >= 0.5 and toxic < 0.3 as kept")
