"""Language identification by a convolutional network over bytes.

Filters of several widths run over the bytes of fixed-length windows; each filter's greatest response
in a window goes through a softmax layer. A filter over one-hot bytes is a table row per byte and
offset, so a response is a sum of ``width`` rows. The network is trained in numpy on labelled rows
and is a few hundred KB whatever the corpus, so it goes to the tasks with the function.

Training takes a bounded sample: at most ``per_lang`` rows of each language (by a hash of key and text,
so reruns agree), ``windows`` windows of each at places that a hash chooses. Everything else reads whole texts: a prediction
is the mean over all windows of the text, weighted by their bytes.

Results for edge cases: a text that is null or has no letter is ``und`` with score 0; so is every
text if no row is labelled. With one label, every text with a letter gets it with score 1. Texts
shorter than a window are padded with zero bytes. Equal scores go to the label first in order.
Repeated rows give repeated results. Rows with a null label or no letter are never learned from.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
UNKNOWN = "und"


def as_windows(data: bytes, size: int = WINDOW) -> np.ndarray:
    """The bytes as rows of one window each; the last is padded with zeros."""
    rows = max(1, -(-len(data) // size))
    out = np.zeros(rows * size, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(rows, size)


class ByteConvNet:
    """Tables of the filters, and the softmax layer over their maxima."""

    def __init__(self, labels, seed=7, widths=WIDTHS, filters=FILTERS):
        rng = np.random.default_rng(seed)
        self.labels, self.widths, self.filters = list(labels), widths, filters
        self.tables = [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths]
        self.out = rng.normal(0, 0.1, (len(widths) * filters, len(self.labels))).astype(np.float32)
        self.bias = np.zeros(len(self.labels), np.float32)

    def responses(self, x: np.ndarray):
        """Per width the response of each filter at each place: (windows, places, filters)."""
        for table, width in zip(self.tables, self.widths):
            places = x.shape[1] - width + 1
            total = table[0].take(x[:, :places], axis=0)
            for j in range(1, width):
                total += table[j].take(x[:, j : j + places], axis=0)
            yield total

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.tanh(pooled) @ self.out + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, x: np.ndarray, chunk=16) -> np.ndarray:
        """Probabilities of each window."""
        parts = []
        for at in range(0, len(x), chunk):
            part = x[at : at + chunk]
            parts.append(self.softmax(np.concatenate([r.max(axis=1) for r in self.responses(part)], axis=1)))
        return np.concatenate(parts)

    def train(self, x, y, epochs=12, batch=32, rate=0.05, seed=7):
        """Stochastic gradient descent with a falling step; the gradient of a maximum goes to the
        place that had it."""
        rng = np.random.default_rng(seed)
        steps, step = epochs * -(-len(x) // batch), 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                pick = order[at : at + batch]
                part, target = x[pick], y[pick]
                lr = rate * (1 - step / steps)
                step += 1
                tops, pooled = [], []
                for r in self.responses(part):
                    top = r.argmax(axis=1)
                    tops.append(top)
                    pooled.append(np.take_along_axis(r, top[:, None, :], axis=1)[:, 0, :])
                h = np.tanh(np.concatenate(pooled, axis=1))
                p = self.softmax(np.concatenate(pooled, axis=1))
                p[np.arange(len(pick)), target] -= 1
                back = (p @ self.out.T) * (1 - h * h)
                self.out -= lr * h.T @ p
                self.bias -= lr * p.sum(axis=0)
                columns = np.arange(self.filters)[None, :]
                for i, (table, width, top) in enumerate(zip(self.tables, self.widths, tops)):
                    g = lr * back[:, i * self.filters : (i + 1) * self.filters]
                    for j in range(width):
                        seen = np.take_along_axis(part, top + j, axis=1)
                        np.subtract.at(table[j], (seen, columns), g)
        return self


def training_sample(df: DataFrame, key="doc_id", text="text", lang="lang", per_lang=400, windows=4):
    """Driver rows ``(lang, window text)`` of the bounded sample.

    Rows per language are counted first. Then a row is kept if the hash of its key and text falls
    into the share that gives ``per_lang`` rows, and the least hashes of those are taken.
    """
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = dict(labelled.groupBy(F.col(lang).alias("lang")).count().collect())
    if not counts:
        return []
    draw = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 << 40))
    share = F.lit(0)
    for name in sorted(counts):
        part = math.ceil((1 << 40) * min(1.0, per_lang / counts[name]))
        share = F.when(F.col(lang) == name, F.lit(part)).otherwise(share)
    room = F.greatest(F.length(text) - WINDOW, F.lit(0)) + 1
    cuts = [
        F.substr(F.col(text), (F.pmod(F.xxhash64(F.col(key), F.lit(i)), room) + 1).cast("int"), F.lit(WINDOW))
        for i in range(windows)
    ]
    return (
        labelled.select(F.col(lang).alias("lang"), draw.alias("draw"), share.alias("share"), F.array(*cuts).alias("cuts"))
        .where("draw < share")
        .orderBy("draw", "lang", "cuts")
        .limit(2 * per_lang * len(counts))
        .select("lang", F.explode("cuts").alias("cut"))
        .where(F.col("cut").rlike(r"\p{L}"))
        .collect()
    )


def train(df: DataFrame, key="doc_id", text="text", lang="lang", per_lang=400, windows=4, epochs=12):
    """A network for the labels of ``df``, or None if it has none."""
    rows = training_sample(df, key, text, lang, per_lang, windows)
    labels = sorted({r[0] for r in rows})
    if not labels:
        return None
    x = np.concatenate([as_windows(r[1].encode()[:WINDOW]) for r in rows])
    y = np.array([labels.index(r[0]) for r in rows])
    net = ByteConvNet(labels)
    return net if len(labels) == 1 else net.train(x, y, epochs)


def predict(df: DataFrame, net: ByteConvNet | None, key="doc_id", text="text", keep=()) -> DataFrame:
    """``doc_id, lang_pred, score`` and, as ``kept_<name>``, the columns ``keep`` of every row, each read in
    its whole."""
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    others = [c for c in keep if c != text]
    rows = df.select(*[F.col(c).alias(f"kept_{c}") for c in others], F.col(text).alias(f"kept_{text}"), F.col(key).alias("doc_id"), has_letter.alias("ok"))
    at = [rows.columns.index(f"kept_{c}") for c in keep]
    n_kept = len(others)
    fields = [rows.schema[i] for i in (*at, n_kept + 1)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["lang_pred string", "score double"])
    names = [*[f.name for f in fields], "lang_pred", "score"]

    def run(batches):
        for batch in batches:
            langs, scores = [], []
            for value, ok in zip(batch.column(n_kept).to_pylist(), batch.column(n_kept + 2).to_pylist()):
                if not ok or net is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                data = value.encode()
                x = as_windows(data)
                weight = np.full(len(x), WINDOW, np.float64)
                weight[-1] = len(data) - WINDOW * (len(x) - 1)
                p = (net.predict(x).astype(np.float64) * weight[:, None]).sum(axis=0) / weight.sum()
                best = int(p.argmax())
                langs.append(net.labels[best])
                scores.append(float(min(1.0, p[best])))
            columns = [batch.column(i) for i in (*at, n_kept + 1)]
            columns += [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)


def identified(df: DataFrame, net: ByteConvNet | None, key="doc_id", text="text", least=0.35) -> DataFrame:
    """The rows of ``df`` whose language is told with a score of ``least`` or more."""
    found = predict(df, net, key, text, keep=df.columns)
    sure = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return sure.select(*[F.col(f"kept_{c}").alias(c) for c in df.columns])
