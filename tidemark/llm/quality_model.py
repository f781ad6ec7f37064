"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage of the whole text is encoded as hashed byte pairs,
hashed words and a few ratios. A hidden representation h of each passage gets a gated attention weight

    a = softmax over the bag of  w . (tanh(V h) * sigmoid(U h))

and the document's score is the logistic of a linear function of the weighted mean of h. Labels are known for documents
only; which passages matter is learned.

The fit uses at most ``SAMPLE`` labelled documents, those whose ids hash lowest, whatever their length; of a document with
more than ``FIT_PASSAGES`` passages it uses that many, evenly spaced. Everything else covers all rows and all passages.
Scoring is one narrow pass.

Defined results: a null or empty text is one passage of zeros and gets a score like any other, as does a very long one, whose
passages are encoded in slices; documents without label are scored; labels of absent documents, null labels and labels
other than 0 and 1 are not learned; a label repeated for an id counts once, the least, and so does a document repeated for
an id, that whose text hashes lowest; equal texts score alike; ids of any type are kept as they are; without any usable
label every score is 0.5; further columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

PASSAGE = 96
PAIRS, BAG, RATIOS = 96, 64, 10
WIDTH = PAIRS + BAG + RATIOS

#: The bound of the fit: labelled documents, and passages of each.
SAMPLE, FIT_PASSAGES = 4000, 512

#: Bytes of passages that are encoded at one time, and passages that are scored at one time.
SLICE_BYTES, SLICE_PASSAGES = 1 << 18, 1 << 14

HIDDEN, GATE, EPOCHS, BAGS, RATE, DECAY, SEED = 24, 12, 30, 128, 0.01, 1e-4, 17

THRESHOLD = 0.3


def _class_table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_UPPER = _class_table(bytes(range(65, 91)))
_LOWER = _class_table(bytes(range(97, 123)))
_DIGIT = _class_table(bytes(range(48, 58)))
_POINT = _class_table(b".,;:?'\"()-")
_SHOUT = _class_table(b"!")
_MARK = _class_table(b"#*$%&|<>=+@^~_{}[]\\/`")
_LINE = _class_table(b"\n")


def encode(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Passages as rows of ``WIDTH`` numbers, and the first passage of each document; each has one at least."""
    data, offsets = common.text_buffer(batch.column(batch.schema.get_field_index("text")))
    n = batch.num_rows
    starts, ends, row = common.word_spans(data, offsets)
    n_words = np.bincount(row, minlength=n)
    first_word = np.cumsum(n_words) - n_words
    n_passages = np.maximum(-(-n_words // PASSAGE), 1)
    first = np.cumsum(n_passages) - n_passages
    total = int(n_passages.sum())
    x = np.zeros((total, WIDTH), np.float32)
    if not len(starts):
        return x, first
    place = np.arange(len(starts)) - first_word[row]
    passage = first[row] + place // PASSAGE
    opens = np.flatnonzero(place % PASSAGE == 0)
    h = common.word_hashes(data, starts, ends)
    again = _repeats(h, row)
    begin, stop = starts[opens], np.concatenate([ends[opens[1:] - 1], ends[-1:]])
    upto = np.concatenate([opens, [len(starts)]])
    for a, b in common.slices(stop - begin, SLICE_BYTES):
        words = slice(upto[a], upto[b])
        into = passage[opens[a:b]]  # every passage but those of texts without words
        x[into] = _features(data, begin[a:b], stop[a:b], h[words], again[words], np.repeat(np.arange(b - a), np.diff(upto[a : b + 1])))
    return x, first


def _features(data: np.ndarray, begin: np.ndarray, stop: np.ndarray, h: np.ndarray, again: np.ndarray, of_word: np.ndarray) -> np.ndarray:
    """The numbers of neighbouring passages: their bytes from begin to stop, and the hash and repetition of each word."""
    total = len(begin)
    x = np.zeros((total, WIDTH), np.float32)
    words = np.bincount(of_word, minlength=total)
    bag = of_word * BAG + (h % np.uint64(BAG)).astype(np.int64)
    x[:, PAIRS : PAIRS + BAG] = (np.bincount(bag, np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0), total * BAG)).reshape(total, BAG) / np.sqrt(np.maximum(words, 1))[:, None]
    size = stop - begin
    of_byte = np.repeat(np.arange(total), size)
    raw = data[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    now = raw.astype(np.int64)
    pair = (now[:-1] * 31 + now[1:] * 7919 + (now[:-1] * now[1:] >> 3)) % PAIRS
    inside = of_byte[1:] == of_byte[:-1]
    counted = np.bincount(of_byte[:-1][inside] * PAIRS + pair[inside], minlength=total * PAIRS).reshape(total, PAIRS)
    length = np.maximum(size, 1)
    x[:, :PAIRS] = np.sqrt(counted / length[:, None])
    ratios = [np.bincount(of_byte[t[raw]], minlength=total) / length for t in (_UPPER, _LOWER, _DIGIT, _POINT, _SHOUT, _MARK, _LINE)]
    ratios += [size / np.maximum(words, 1) / 10, np.bincount(of_word[again], minlength=total) / np.maximum(words, 1), words / PASSAGE]
    x[:, PAIRS + BAG :] = np.stack(ratios, 1)
    return x


def _repeats(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether the three-word window at each word repeats an equal one of its document."""
    again = np.zeros(len(h), bool)
    if len(h) > 2:
        at = np.flatnonzero(row[:-2] == row[2:])
        key = common.mix(common.mix(common.mix(h[:-2] + row[:-2].astype(np.uint64)) + h[1:-1]) + h[2:])[at]
        order = np.argsort(key, kind="stable")
        again[at[order[1:][key[order][1:] == key[order][:-1]]]] = True
    return again


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Attention:
    """The fitted model; ``held`` are its parameters by name."""

    mean: np.ndarray
    scale: np.ndarray
    held: dict[str, np.ndarray]

    def _forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, c = self.held, {}
        c["x"] = np.clip((x - self.mean) / self.scale, -8, 8)
        c["h"] = np.tanh(c["x"] @ p["W"] + p["b"])
        c["t"], c["s"] = np.tanh(c["h"] @ p["V"]), _sigmoid(c["h"] @ p["U"])
        e = (c["t"] * c["s"]) @ p["w"]
        sizes = np.diff(np.concatenate([first, [len(x)]]))
        c["bag"] = np.repeat(np.arange(len(first)), sizes)
        e = np.exp(e - np.maximum.reduceat(e, first)[c["bag"]])
        c["a"] = e / np.add.reduceat(e, first)[c["bag"]]
        c["z"] = np.add.reduceat(c["a"][:, None] * c["h"], first)
        c["y"] = _sigmoid(c["z"] @ p["c"] + p["d"][0])
        return c

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each document's score. Passages are weighed in slices: only the sums that the softmax needs outlive a slice."""
        p, n = self.held, len(first)
        bag = np.repeat(np.arange(n), np.diff(np.concatenate([first, [len(x)]])))
        top, mass, z = np.full(n, -np.inf), np.zeros(n), np.zeros((n, len(p["b"])))
        for at in range(0, len(x), SLICE_PASSAGES):
            part = np.clip((x[at : at + SLICE_PASSAGES].astype(np.float64) - self.mean) / self.scale, -8, 8)
            h = np.tanh(part @ p["W"] + p["b"])
            e = (np.tanh(h @ p["V"]) * _sigmoid(h @ p["U"])) @ p["w"]
            of = bag[at : at + SLICE_PASSAGES]
            docs, start = np.unique(of, return_index=True)
            higher = np.maximum(top[docs], np.maximum.reduceat(e, start))
            shrink = np.exp(top[docs] - higher)
            top[docs] = higher
            a = np.exp(e - top[of])
            mass[docs] = mass[docs] * shrink + np.add.reduceat(a, start)
            z[docs] = z[docs] * shrink[:, None] + np.add.reduceat(a[:, None] * h, start)
        return _sigmoid(z / mass[:, None] @ p["c"] + p["d"][0])

    def attention(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each passage's weight in its document."""
        return self._forward(x.astype(np.float64), first)["a"]

    def gradients(self, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        p, c = self.held, self._forward(x, first)
        dy = (c["y"] - label) / len(label)
        dz = dy[:, None] * p["c"][None, :]
        bag, a, h = c["bag"], c["a"], c["h"]
        da = (dz[bag] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, first)[bag])
        g = c["t"] * c["s"]
        dg = de[:, None] * p["w"][None, :]
        dt, ds = dg * c["s"] * (1 - c["t"] ** 2), dg * g * (1 - c["s"])
        dh = a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T
        dw = dh * (1 - h**2)
        return {"W": c["x"].T @ dw, "b": dw.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": g.T @ de, "c": c["z"].T @ dy, "d": np.array([dy.sum()])}


def fit(bags: list[np.ndarray], labels: np.ndarray) -> Attention | None:
    """Adam over shuffled groups of bags; None without labels of a kind."""
    if not len(labels):
        return None
    rng = np.random.default_rng(SEED)
    every = np.concatenate(bags).astype(np.float64)
    shapes = {"W": (WIDTH, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
    held = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or k in "wc" else np.zeros(s) for k, s in shapes.items()}
    share = np.clip(labels.mean(), 0.01, 0.99)
    held["d"][0] = np.log(share / (1 - share))
    model = Attention(every.mean(0), np.maximum(every.std(0), 1e-3), held)
    first, second, step = {k: np.zeros_like(v) for k, v in held.items()}, {k: np.zeros_like(v) for k, v in held.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), BAGS):
            take = order[k : k + BAGS]
            sizes = np.array([len(bags[i]) for i in take])
            grads = model.gradients(np.concatenate([bags[i] for i in take]).astype(np.float64), np.cumsum(sizes) - sizes, labels[take])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for name, grad in grads.items():
                grad = grad + DECAY * held[name] * (held[name].ndim == 2)
                first[name] = 0.9 * first[name] + 0.1 * grad
                second[name] = 0.999 * second[name] + 0.001 * grad**2
                held[name] -= rate * first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves no remainder by 5; a null id too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id") -> Attention | None:
    """Fit on the bounded sample that the module describes."""
    common.small_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(id_col)).groupBy(id_col).agg(F.min("quality").cast("int").alias("label__"))
    share = 1.2 * sample / max(known.count(), 1)  # so few rows are sorted, wherever the labels come from
    known = known.where(common.hash_share(share, id_col)).orderBy(F.xxhash64(id_col), id_col).limit(sample).withColumnRenamed(id_col, "label_id__")
    rows = docs.select(id_col, "text").join(F.broadcast(known), F.col(id_col) == F.col("label_id__"))

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            x, first = encode(batch)
            bags = [_thinned(b).tobytes() for b in np.split(x.astype(np.float16), first[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bags, pa.binary())], names=["id", "label", "rank", "bag"])

    made = rows.select(F.col(id_col).alias("id"), F.col("label__").alias("label"), F.xxhash64("text").alias("rank"), "text")
    made = made.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, label int, rank long, bag binary")
    one = made.groupBy("id").agg(F.min(F.struct("rank", "label", "bag")).alias("d"))  # at most ``sample`` rows, whatever repeats
    found = sorted(((r.d.rank, r.d.label, bytes(r.d.bag)) for r in one.collect()))
    bags = [np.frombuffer(b, np.float16).reshape(-1, WIDTH) for _, _, b in found]
    return fit(bags, np.array([y for _, y, _ in found], np.float64))


def _thinned(bag: np.ndarray, most: int = FIT_PASSAGES) -> np.ndarray:
    """The bag's passages, or ``most`` of them, evenly spaced."""
    return bag if len(bag) <= most else bag[np.linspace(0, len(bag) - 1, most).round().astype(int)]


def score(docs: DataFrame, model: Attention | None, keep: tuple[str, ...] = ("doc_id",), into: str = "score") -> DataFrame:
    """``keep`` and the score, under the name ``into``, of every row."""
    spark = docs.sparkSession
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            if sent.value is None:
                scores = np.full(batch.num_rows, 0.5)
            else:
                x, first = encode(batch)
                scores = np.round(sent.value.score(x, first), 6)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(scores)], names=[*keep, into])

    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    return rows.mapInArrow(run, ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", `{into}` double")


def predicted(threshold: float = THRESHOLD, score: str = "score") -> Column:
    return (F.col(score) >= threshold).cast("int")
