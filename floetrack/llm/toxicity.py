"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as its own embedding beside those of its characters: of its first 4 and first 6 bytes, and
the mean of its character 4-grams (all hashed).
Overlapping windows of words run forward and backward through gated recurrent units; attention over
all of a window's states gives its score; a text's score is that of its highest window. Training starts from
random values, on a bounded sample of labelled texts: a text's windows are a bag with one label, and of their
scores, pooled softly, the gradient goes to the highest. It runs in one task; the driver gets the parameters.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floetrack.llm import bytesview
from floetrack.llm.decontaminate import WORD_BYTES

#: Words of a window and of the step to the next; bits of an embedding's bucket number.
WIDTH, STEP, BITS = 32, 24, 15
#: Embeddings by a hash of a span of a word, with the span's largest size in bytes.
SPANS = {"word": 1 << 30, "head4": 4, "head6": 6}
TABLES = (*SPANS, "gram")
INPUTS = 4 * len(TABLES)
EMBED, HIDDEN, ATTEND = 4, 8, 8
#: Bounds of the training sample: rows with label 1, rows with label 0, and bytes of text.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 1000, 3000, 8_000_000
#: Of the sample, one text in HOLD sets the threshold and is not trained on. Texts of a step by label, and windows of a text.
HOLD, STEP_TOXIC, STEP_CLEAN, BAG = 5, 8, 24, 12
#: A text of more bytes enters the sample by PIECES passages of PIECE characters (of 4 bytes at most), one from each part.
ROW_BYTES, PIECES, PIECE = 32_768, 8, 1024
_PAD = 30.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Words:
    """The words of some texts: bucket of each, buckets of their character n-grams, first word of each text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        data, start, end, self.first = bytesview.word_spans(raw, offsets, WORD_BYTES)
        hashes = bytesview.span_hashes(data, start, *[np.minimum(end, start + size) for size in SPANS.values()])
        self.spans = {name: (h >> np.uint64(64 - BITS)).astype(np.int32) for name, h in zip(SPANS, hashes, strict=True)}
        framed = np.concatenate([[32], np.where(WORD_BYTES[data], data, 32), [32, 32, 32]]).astype(np.uint32)
        four = framed[:-3] | framed[1:-2] << np.uint32(8) | framed[2:-1] << np.uint32(16) | framed[3:] << np.uint32(24)
        self.gram = ((four * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
        # In the frame a word lies one further; its n-grams begin at the space before it.
        self.begin, self.count = start, end - start - 1

    def __len__(self) -> int:
        return len(self.begin)

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        """Of a list of texts, a part of them at a time."""
        column = pa.array(texts, pa.large_string())
        parts = [cls(raw, offsets) for _, _, raw, offsets in bytesview.text_chunks(column, 1 << 19)]
        out, grams, words = cls.__new__(cls), 0, 0
        begins, firsts = [], []
        for part in parts:
            begins.append(part.begin + grams)
            firsts.append(part.first[:-1] + words)
            grams, words = grams + len(part.gram), words + len(part)
        out.spans = {name: np.concatenate([part.spans[name] for part in parts]) for name in SPANS}
        out.begin, out.count, out.gram = np.concatenate(begins), np.concatenate([part.count for part in parts]), np.concatenate([part.gram for part in parts])
        out.first = np.concatenate([*firsts, [words]])
        return out

    def inputs(self, p: dict) -> np.ndarray:
        """The network's input for each word."""
        return np.concatenate([*(p[name][b] for name, b in self.spans.items()), self.mean_grams(p["gram"])], axis=1)

    def mean_grams(self, table: np.ndarray) -> np.ndarray:
        """The mean of a table's rows over each word's n-grams."""
        if not len(self.begin):
            return np.zeros((0, table.shape[1]), table.dtype)
        edges = np.stack([self.begin, self.begin + np.maximum(self.count, 1)], axis=1).ravel()
        out = np.empty((len(self.begin), table.shape[1]), table.dtype)
        for k in range(table.shape[1]):
            out[:, k] = np.add.reduceat(table[:, k][self.gram], edges)[::2]
        return out * (np.where(self.count > 0, 1.0 / np.maximum(self.count, 1), 0.0)[:, None]).astype(table.dtype)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(words of each window, the number of words where there is none; text of each window)."""
        size = np.diff(self.first)
        many = np.where(size > 0, 1 + np.maximum(0, -(-(size - WIDTH) // STEP)), 0)
        text = np.repeat(np.arange(len(size)), many)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = (self.first[:-1][text] + nth * STEP)[:, None] + np.arange(WIDTH)
        return np.where(at < self.first[1:][text][:, None], at, len(self)).astype(np.int32), text


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Small random parameters."""
    out: dict[str, np.ndarray] = {}
    make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    for way in ("f", "b"):
        out[f"{way}x"], out[f"{way}h"], out[f"{way}c"] = make(INPUTS, 3 * HIDDEN), make(HIDDEN, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32)
    out["a"], out["ac"], out["av"] = make(2 * HIDDEN, ATTEND), np.zeros(ATTEND, np.float32), make(ATTEND)
    out["o"], out["oc"] = make(2 * HIDDEN), np.zeros(1, np.float32)
    for name in TABLES:
        out[name] = (rng.standard_normal((1 << BITS, EMBED)) * 0.05).astype(np.float32)
    return out


def _states(p: dict, x: np.ndarray, spots: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
    """The states (time, window, HIDDEN) of one direction; at a padded word the state stays as it was."""
    inputs = np.concatenate([x @ p[f"{way}x"] + p[f"{way}c"], np.repeat(np.float32([[_PAD, 0, 0]]), HIDDEN, axis=1)])
    n, h = len(spots), HIDDEN
    state, out = np.zeros((n, h), np.float32), np.zeros((WIDTH, n, h), np.float32)
    for t in range(WIDTH) if way == "f" else range(WIDTH - 1, -1, -1):
        a, u = inputs[spots[:, t]], state @ p[f"{way}h"]
        gate = _sigmoid(a[:, : 2 * h] + u[:, : 2 * h])
        z, r = gate[:, :h], gate[:, h:]
        new = np.tanh(a[:, 2 * h :] + r * u[:, 2 * h :])
        if keep is not None:
            keep.append((t, state, z, r, new, u[:, 2 * h :]))
        state = new + z * (state - new)
        out[t] = state
    return out


def _pool(p: dict, both: np.ndarray, padded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(scores before the sigmoid, pooled states, weights, inner attention) of the states of windows."""
    inner = np.tanh(both @ p["a"] + p["ac"])
    e = inner @ p["av"] - _PAD * padded.T
    weight = np.exp(e - e.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tn,tnk->nk", weight, both)
    return pooled @ p["o"] + p["oc"], pooled, weight, inner


def window_logits(p: dict, words: Words, spots: np.ndarray) -> np.ndarray:
    """The score of each window, before the sigmoid."""
    if not len(spots):
        return np.zeros(0, np.float32)
    x = words.inputs(p)
    both = np.concatenate([_states(p, x, spots, "f"), _states(p, x, spots, "b")], axis=2)
    return _pool(p, both, spots == len(words))[0]


def bag_slopes(logit: np.ndarray, bag: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The slope, for each window's score, of the cross entropy of the soft highest scores of bags; either label weighs a half."""
    top = np.full(len(label), -np.inf)
    np.maximum.at(top, bag, logit)
    grown = np.exp(logit - top[bag])
    total = np.bincount(bag, grown, len(label))
    weight = np.where(label == 1, 0.5 / max((label == 1).sum(), 1), 0.5 / max((label == 0).sum(), 1))
    return (((_sigmoid(top + np.log(total)) - label) * weight)[bag] * grown / total[bag]).astype(np.float32)


def _gradients(p: dict, words: Words, spots: np.ndarray, bag: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """The gradient of the loss of some bags of windows; ``bag`` numbers each window's."""
    h, n = HIDDEN, len(spots)
    x = words.inputs(p)
    kept: dict[str, list] = {"f": [], "b": []}
    both = np.concatenate([_states(p, x, spots, way, kept[way]) for way in ("f", "b")], axis=2)
    logit, pooled, share, inner = _pool(p, both, spots == len(words))
    d_logit = bag_slopes(logit.astype(np.float64), bag, label)
    g = {"o": pooled.T @ d_logit, "oc": np.array([d_logit.sum()], np.float32)}
    d_pooled = d_logit[:, None] * p["o"]
    d_both = share[:, :, None] * d_pooled
    d_share = np.einsum("tnk,nk->tn", both, d_pooled)
    d_e = share * (d_share - (share * d_share).sum(axis=0))
    g["av"] = np.einsum("tn,tna->a", d_e, inner)
    d_inner = d_e[:, :, None] * p["av"] * (1 - inner**2)
    g["a"], g["ac"] = np.einsum("tnk,tna->ka", both, d_inner), d_inner.sum(axis=(0, 1))
    d_both = d_both + d_inner @ p["a"].T
    d_x = np.zeros((len(words) + 1, INPUTS), np.float32)
    xs = np.concatenate([x, np.zeros((1, INPUTS), np.float32)])
    for way, own in (("f", d_both[:, :, :h]), ("b", d_both[:, :, h:])):
        d_state = np.zeros((n, h), np.float32)
        for name in ("x", "h", "c"):
            g[way + name] = np.zeros_like(p[way + name])
        for t, before, z, r, new, u in reversed(kept[way]):
            d_state = d_state + own[t]
            d_new = d_state * (1 - z) * (1 - new**2)
            d_z = d_state * (before - new) * z * (1 - z)
            d_r = d_new * u * r * (1 - r)
            d_a = np.concatenate([d_z, d_r, d_new], axis=1)
            d_u = np.concatenate([d_z, d_r, d_new * r], axis=1)
            real = (spots[:, t] < len(words))[:, None]
            d_a, d_u = d_a * real, d_u * real
            g[way + "x"] += xs[spots[:, t]].T @ d_a
            g[way + "c"] += d_a.sum(axis=0)
            g[way + "h"] += before.T @ d_u
            back = d_a @ p[way + "x"].T
            for k in range(INPUTS):
                d_x[:, k] += np.bincount(spots[:, t], back[:, k], minlength=len(d_x))
            d_state = np.where(real, d_state * z + d_u @ p[way + "h"].T, d_state)
    d_x = d_x[:-1]
    live = np.flatnonzero(np.abs(d_x).sum(axis=1) > 0)
    many = np.maximum(words.count[live], 0)
    place = np.repeat(words.begin[live] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    bucket, own = words.gram[place], np.repeat(np.arange(len(live)), many)
    for i, name in enumerate(TABLES):
        g[name] = np.zeros_like(p[name])
        for k in range(EMBED):
            d = d_x[live, i * EMBED + k]
            if name == "gram":
                g[name][:, k] = np.bincount(bucket, (d / np.maximum(many, 1))[own], minlength=1 << BITS)
            else:
                g[name][:, k] = np.bincount(words.spans[name][live], d, minlength=1 << BITS)
    return g


def train(texts: list[str], labels: list[int], *, steps: int = 400, rate: float = 0.01, table_rate: float = 0.03, seed: int = 7) -> dict[str, np.ndarray]:
    """The parameters, with ``prior``, the share of label 1. Texts of one label only, or none, give just the prior."""
    label = np.array(labels, np.float32)
    prior = {"prior": np.array([float((label.sum() + 0.5) / (len(label) + 1.0)) if len(label) else 0.0])}
    if not len(label) or label.min() == label.max():
        return prior
    words = Words.of(texts)
    spots, text = words.windows()
    rng = np.random.default_rng(seed)
    begin = np.flatnonzero(np.diff(text, prepend=-1))
    many, known = np.diff(np.append(begin, len(text))), label[text[begin]]
    aside = rng.permutation(len(begin)) % HOLD == 0
    if min(np.bincount(known[aside].astype(int), minlength=2)) < 5:
        aside[:] = False  # too few to set a threshold by
    toxic, clean = np.flatnonzero((known == 1) & ~aside), np.flatnonzero((known == 0) & ~aside)
    if not len(toxic) or not len(clean):
        return prior
    p = initial(rng)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(toxic, STEP_TOXIC), rng.choice(clean, STEP_CLEAN)])
        windows = [begin[i] + (rng.choice(many[i], BAG, replace=False) if many[i] > BAG else np.arange(many[i])) for i in chosen]
        bag = np.repeat(np.arange(len(chosen)), [len(w) for w in windows])
        g = _gradients(p, *_part(words, spots[np.concatenate(windows)]), bag, known[chosen])
        slower = 1 - (step - 1) / steps
        for k, v in g.items():
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.01 * (v * v - second[k])
            scale = slower * (table_rate if k in TABLES else rate) / (1 - 0.9**step)
            p[k] -= (scale * first[k] / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    if aside.any():
        p["oc"] = p["oc"] - np.float32(_threshold(p, words, spots, begin, many, np.flatnonzero(aside), known))
    return p | prior


def _threshold(p: dict, words: Words, spots: np.ndarray, begin: np.ndarray, many: np.ndarray, texts: np.ndarray, label: np.ndarray) -> float:
    """The score, before the sigmoid, that best parts the labels of some texts; a clean text rejected counts as two toxic ones let through, by shares."""
    top = np.array([window_logits(p, *_part(words, spots[begin[i] : begin[i] + many[i]])).max() for i in texts], np.float64)
    order = np.argsort(top)
    top, one = top[order], label[texts][order] == 1
    cuts = np.concatenate([[top[0] - 1], (top[1:] + top[:-1]) / 2, [top[-1] + 1]])
    missed = np.append(0, np.cumsum(one)) / one.sum()
    false = np.append(np.cumsum(~one[::-1])[::-1], 0) / (~one).sum()
    best = np.flatnonzero(missed + 2 * false <= (missed + 2 * false).min() + 1e-12)
    return float(cuts[best[len(best) // 2]])


class _Subset(Words):
    """Some words of a larger collection, under new numbers in the same order; the padding stays last."""

    def __init__(self, words: Words, chosen: np.ndarray):
        self.spans = {name: b[chosen] for name, b in words.spans.items()}
        self.begin, self.count, self.gram = words.begin[chosen], words.count[chosen], words.gram

    def mean_grams(self, table: np.ndarray) -> np.ndarray:
        many = np.maximum(self.count, 0)
        place = np.repeat(self.begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
        own, bucket = np.repeat(np.arange(len(many)), many), self.gram[place]
        out = np.stack([np.bincount(own, table[bucket, k], minlength=len(many)) for k in range(table.shape[1])], axis=1)
        return (out / np.maximum(many, 1)[:, None]).astype(table.dtype)


def _part(words: Words, spots: np.ndarray) -> tuple[Words, np.ndarray]:
    """Only the words of some windows, and the windows under their new numbers."""
    chosen, inverse = np.unique(spots, return_inverse=True)
    pad = len(words)
    if chosen[-1] != pad:
        return _Subset(words, chosen), inverse.reshape(spots.shape)
    return _Subset(words, chosen[:-1]), inverse.reshape(spots.shape)


def scores(p: dict, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The score of each text: its highest window's; the prior for a text without words."""
    out = np.full(len(offsets) - 1, float(p["prior"][0]))
    if "word" not in p:
        return out
    words = Words(raw, offsets)
    spots, text = words.windows()
    if len(spots):
        logit = window_logits(p, words, spots).astype(np.float64)
        begin = np.flatnonzero(np.diff(text, prepend=-1))
        out[text[begin]] = 1.0 / (1.0 + np.exp(-np.clip(np.maximum.reduceat(logit, begin), -50, 50)))
    return out


def passages(text: Column, key: Column) -> Column:
    """A text of ROW_BYTES at most; of a longer one, passages at places given by a hash of the key."""
    part = F.floor(F.length(text) / PIECES).cast("int")
    # Over ROW_BYTES a text has PIECES * PIECE characters at least, so a passage fits in every part.
    spots = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring(text, i * part + 1 + F.pmod(F.xxhash64(key, i), part - PIECE + 1).cast("int"), F.lit(PIECE)))
    return F.when(F.octet_length(text.cast("binary")) <= ROW_BYTES, text).otherwise(F.array_join(spots, " "))


def sample(
    docs: DataFrame,
    labels: DataFrame,
    *,
    text: str = "text",
    label: str = "toxic",
    key: str = "doc_id",
    toxic: int = SAMPLE_TOXIC,
    clean: int = SAMPLE_CLEAN,
    size: int = SAMPLE_BYTES,
) -> DataFrame:
    """(at, label, text): at most ``toxic`` and ``clean`` labelled rows and ``size`` bytes, the first in the order of a hash of the key.

    A text over ROW_BYTES enters by passages of it, so no row takes more than that of ``size``. Of ``size`` each
    label has its share by rows, and what the other label leaves. Rows with a null key, text or label are
    passed over. The rows are chosen by lengths alone; only the chosen texts are moved.
    """
    named = labels.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label"), F.md5(F.col(key).cast("string").cast("binary")).alias("at"))
    parts = [named.where(F.col("label") == v).orderBy("at", "_key").limit(n) for v, n in ((0, clean), (1, toxic))]
    some = F.broadcast(parts[0].union(parts[1]))  # at most clean + toxic rows of a few bytes
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("text"))
    sized = texts.join(some, "_key").select("_key", "at", "label", F.xxhash64("text").alias("h"), F.octet_length(passages(F.col("text"), F.col("_key")).cast("binary")).cast("long").alias("size"))
    sized = sized.orderBy("at", "h", "label").limit(clean + toxic)
    running, whole = Window.orderBy("at", "h", "label").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    fits = F.lit(False)
    for v, share in ((0, size * clean // max(clean + toxic, 1)), (1, size - size * clean // max(clean + toxic, 1))):
        mine = (F.col("label") == v) & (F.col("size") <= share)  # a row over its label's share takes nothing of it
        own, other = F.when(mine, F.col("size")).otherwise(0), F.when(F.col("label") != v, F.col("size")).otherwise(0)
        left = F.lit(size) - F.least(F.sum(other).over(whole), F.lit(size - share))
        fits = fits | (mine & (F.sum(own).over(running) <= left))
    chosen = F.broadcast(sized.withColumn("fits", fits).where("fits").groupBy("_key", "at", "label", "h").agg(F.count("*").alias("rows")))
    found = texts.withColumn("h", F.xxhash64("text")).join(chosen, ["_key", "h"])
    found = found.select("at", "label", passages(F.col("text"), F.col("_key")).alias("text"), "rows")
    return found.groupBy("at", "label", "text").agg(F.max("rows").alias("rows")).select("at", "label", "text", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))).select("at", "label", "text")


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", key: str = "doc_id", **bounds) -> dict[str, np.ndarray]:
    """Trains on ``sample(docs, labels, ...)`` in one task of an executor; of a bounded size, whatever the input.

    A label that has rows but none in the sample gives a warning. Empty tables give a model with the prior alone.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)), key=lambda r: (r[0], r[2], r[1]))
        p = train([r[2] for r in rows], [r[1] for r in rows])
        p["seen"] = np.bincount([r[1] for r in rows], minlength=2)
        yield pa.RecordBatch.from_arrays([pa.array(list(p)), pa.array([str(v.dtype) for v in p.values()]), pa.array([list(v.shape) for v in p.values()], pa.list_(pa.int64())), pa.array([v.tobytes() for v in p.values()], pa.binary())], names=["name", "kind", "shape", "data"])

    rows = sample(docs, labels, label=label, key=key, **bounds).repartition(1).mapInArrow(learn, "name string, kind string, shape array<long>, data binary").collect()
    model = {r["name"]: np.frombuffer(r["data"], r["kind"]).reshape(r["shape"]) for r in rows} or {"prior": np.zeros(1), "seen": np.zeros(2)}
    for v, seen in enumerate(model.pop("seen")):
        if not seen and not labels.where(F.col(key).isNotNull() & (F.col(label).cast("int") == v)).isEmpty():
            warnings.warn(f"no text of {label} = {v} is in the training sample, though rows have that label", stacklevel=2)
    return model


def predict(docs: DataFrame, model: dict[str, np.ndarray], *, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on); columns of these names are replaced.

    Null and empty texts, and texts without words, get the prior. Texts are read whole, in windows;
    equal texts get equal scores whatever stands beside them.
    """
    kept = docs.drop("score", "predicted")
    held = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: the tables and a few small matrices
    schema = kept.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    place = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        for batch in batches:
            parts = [np.round(scores(p, raw, offsets), 5) for _, _, raw, offsets in bytesview.text_chunks(batch.column(place), 1 << 19)]
            value = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return kept.mapInArrow(run, schema)
