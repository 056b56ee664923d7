"""Personal data: patterns, and a character BiLSTM with a CRF on top.

The patterns find e-mail addresses, internet addresses, card and telephone numbers. The network learns from
the spans they find in a bounded sample of documents: each character has an embedding, a forward and a backward
LSTM read the window, and a CRF with learned transitions scores whole label sequences. It is written and
trained in numpy. It reads a text in overlapping windows; each is decoded by Viterbi, and where windows
overlap, the label of the one in which the character lies farthest from an edge counts. Equal neighbouring
labels are put together over the whole text, so a span may be longer than a window.

Every kind has a digit or an @, so a window with neither is outside by definition and is not run. Spans of the
network that overlap a pattern's span are left out; all others are added. They also report numbers that have
the shape of a kind but fail its check (such as a mistyped card number).

Spans are code points, end exclusive. A null or empty text has none. Nothing is learned when the sample has no
spans; then only the patterns count. Every row is on its own, so repeated rows repeat their results and an empty table
gives none. Very long texts are read whole, window by window. Where two windows are equally good for a character, the
earlier one counts. Only ``doc_id`` and ``text`` are read; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import Taken, documents, plain_texts, text_chunks

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile("[A-Za-z0-9._%+-]")
PATTERNS = (
    EMAIL,
    # only the start of a run of digits can begin a match; said so, long runs are read once
    re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)
MARKED = re.compile(r"[0-9@]")

#: Bounds of training: documents and windows per kind (and as many without a span).
SAMPLE_DOCS = 8_000
SAMPLE_WINDOWS = 400
LENGTH = 64
STRIDE = 32
EMBEDDING = 12
HIDDEN = 16
EPOCHS = 14
BATCH = 64
RATE = 0.02
SEED = 7
LABELS = len(KINDS) + 1
#: Codes: ASCII as it is, letters beyond it, other characters beyond it, and padding.
LETTER, OTHER, PAD = 128, 129, 130
CODES = 131


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _valid(kind: int, found: re.Match) -> bool:
    digits = re.sub("[^0-9]", "", found[0])
    if kind == 1:
        parts = [part.lstrip("0") for part in found[0].split(".")]
        return all(len(part) <= 3 and int(part or 0) <= 255 for part in parts)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == 0 or 8 <= len(digits) <= 15


def _shaped(kind: int, found: re.Match) -> bool:
    """Right in shape, whatever the check says."""
    n = sum(c.isdigit() for c in found[0])
    return 16 <= n <= 19 if kind == 2 else True


def _emails(text: str) -> Iterator[re.Match]:
    """Leftmost matches of ``EMAIL``, looked for from each @, so that long runs of letters are read once."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text, start - 1):
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            yield found
            last = found.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str, valid=_valid) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns, in that order."""
    if not MARKED.search(text):
        return []
    there = ("@" in text, "." in text, True, "+" in text)
    return [
        (kind, m.start(), m.end())
        for kind, pattern in enumerate(PATTERNS)
        if there[kind]
        for m in (_emails(text) if pattern is EMAIL else pattern.finditer(text))
        if valid(kind, m)
    ]


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = points.astype(np.uint8, casting="unsafe")
    for i in np.flatnonzero(points >= 128):
        out[i] = LETTER if text[i].isalpha() else OTHER
    return out


def _labels(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(n, np.int8)
    for kind, start, end in reversed(spans):
        out[start:end] = kind + 1
    return out


def training_windows(docs: DataFrame) -> DataFrame:
    """(kind, codes, labels): windows around labelled spans, and kind -1 around other digits and other text.

    Windows with a match that fails its check are neither one nor the other and are not learned from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            out = []
            for text in plain_texts(batch):
                if not text:
                    continue
                base = base_spans(text)
                unclear = [s for s in base_spans(text, _shaped) if s not in base]
                whole = codes(text)
                labels = _labels(len(whole), base)
                centres = [(kind, start) for kind, start, _ in base]
                marked = [m.start() for m in MARKED.finditer(text) if not labels[m.start()]]
                centres += [(-1, at) for at in marked[:: max(1, len(marked) // 2)][:2]] + [(-1, len(whole) // 2)]
                for kind, centre in centres:
                    # where the centre lies in the window differs from one to the next
                    begin = max(0, centre - (centre * 7919) % (LENGTH - 8))
                    end = begin + LENGTH
                    if any(a < end and b > begin for _, a, b in unclear):
                        continue
                    padded = np.full(LENGTH, PAD, np.uint8)
                    padded[: len(whole[begin:end])] = whole[begin:end]
                    truth = np.zeros(LENGTH, np.int8)
                    truth[: len(labels[begin:end])] = labels[begin:end]
                    out.append((kind, padded.tobytes(), truth.tobytes()))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                ["kind", "codes", "labels"],
            )

    return docs.select("text").mapInArrow(run, "kind int, codes binary, labels binary")


def sampled_windows(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most ``SAMPLE_WINDOWS`` windows of each kind, as many per kind without spans, picked by hash."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    share = min(1.0, SAMPLE_DOCS / max(1, rows.count()))
    picked = F.pmod(F.xxhash64("doc_id", F.lit("pii")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    order = Window.partitionBy("kind").orderBy(F.xxhash64("codes"), "codes")
    most = F.when(F.col("kind") < 0, SAMPLE_WINDOWS * len(KINDS)).otherwise(SAMPLE_WINDOWS)
    windows = training_windows(rows.filter(picked)).distinct().withColumn("rank", F.row_number().over(order))
    found = windows.filter(F.col("rank") <= most).orderBy("kind", "rank").toPandas()
    x = np.array([np.frombuffer(c, np.uint8) for c in found["codes"]]).reshape(-1, LENGTH)
    y = np.array([np.frombuffer(c, np.int8) for c in found["labels"]]).reshape(-1, LENGTH)
    return x, y.astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction over (time, batch) codes; the embedding is folded into the input weights when it runs."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.p = {
            "e": rng.normal(0, 0.3, (CODES, EMBEDDING)),
            "w": rng.normal(0, EMBEDDING**-0.5, (EMBEDDING, 4 * HIDDEN)),
            "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)),
            "b": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN),
        }

    def forward(self, x: np.ndarray, keep: bool = False) -> np.ndarray:
        table = (self.p["e"] @ self.p["w"] + self.p["b"]).astype(np.float32)
        u = self.p["u"].astype(np.float32)
        steps, n = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        self.seen = []
        for t in range(steps):
            z = table[x[t]] + h @ u
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before = (h, c)
            c = f * c + i * g
            held = np.tanh(c)
            h = o * held
            out[t] = h
            if keep:
                self.seen.append((before, i, f, o, g, held))
        return out

    def backward(self, x: np.ndarray, dout: np.ndarray) -> dict[str, np.ndarray]:
        steps, n = x.shape
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        dtable = np.zeros((CODES, 4 * HIDDEN))
        dh_next, dc_next = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        for t in range(steps - 1, -1, -1):
            (h0, c0), i, f, o, g, held = self.seen[t]
            dh = dout[t] + dh_next
            dc = dh * o * (1 - held**2) + dc_next
            dz = np.concatenate(
                [dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * held * o * (1 - o), dc * i * (1 - g**2)], axis=1
            )
            grads["u"] += h0.T @ dz
            np.add.at(dtable, x[t], dz)
            dh_next, dc_next = dz @ self.p["u"].T, dc * f
        grads["b"] = dtable.sum(axis=0)
        grads["w"] = self.p["e"].T @ dtable
        grads["e"] = dtable @ self.p["w"].T
        return grads


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """BiLSTM-CRF over windows of codes (batch, LENGTH)."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.left, self.right = Lstm(rng), Lstm(rng)
        self.p = {
            "v": rng.normal(0, 0.3, (2 * HIDDEN, LABELS)),
            "d": np.zeros(LABELS),
            "trans": np.zeros((LABELS, LABELS)),
            "begin": np.zeros(LABELS),
        }

    def emissions(self, x: np.ndarray, keep: bool = False) -> np.ndarray:
        """(time, batch, labels)"""
        x = x.T
        both = np.concatenate([self.left.forward(x, keep), self.right.forward(x[::-1], keep)[::-1]], axis=2)
        if keep:
            self.both = both
        return both @ self.p["v"].astype(np.float32) + self.p["d"].astype(np.float32)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[dict, dict]]]:
        """Mean negative log-likelihood per window, and (parameters, gradients) of every part."""
        e = self.emissions(x, keep=True).astype(np.float64)
        trans, begin = self.p["trans"], self.p["begin"]
        steps, n, _ = e.shape
        y = y.T
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = begin + e[0]
        for t in range(1, steps):
            alpha[t] = _logsum(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsum(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        norm = _logsum(alpha[-1], 1)
        rows = np.arange(n)
        gold = begin[y[0]] + e[0][rows, y[0]]
        de = np.exp(alpha + beta - norm[None, :, None])
        dbegin = de[0].sum(axis=0) - np.bincount(y[0], minlength=LABELS)
        dtrans = np.zeros_like(trans)
        for t in range(1, steps):
            gold = gold + trans[y[t - 1], y[t]] + e[t][rows, y[t]]
            pair = alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - norm[:, None, None]
            dtrans += np.exp(pair).sum(axis=0)
            np.add.at(dtrans, (y[t - 1], y[t]), -1)
        for t in range(steps):
            de[t][rows, y[t]] -= 1
        de /= n
        dboth = de @ self.p["v"].T
        grads = {
            "v": np.einsum("tnh,tnl->hl", self.both, de),
            "d": de.sum(axis=(0, 1)),
            "trans": dtrans / n,
            "begin": dbegin / n,
        }
        turned = x.T
        left = self.left.backward(turned, dboth[:, :, :HIDDEN])
        right = self.right.backward(turned[::-1], dboth[::-1, :, HIDDEN:])
        return float((norm - gold).mean()), [(self.p, grads), (self.left.p, left), (self.right.p, right)]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> Tagger:
        """Adam with a rate that falls to nothing."""
        rng = np.random.default_rng(SEED)
        moments: dict[tuple[int, str], list[np.ndarray]] = {}
        steps = epochs * -(-len(x) // BATCH)
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                some = order[i : i + BATCH]
                _, parts = self.loss(x[some], y[some])
                step += 1
                rate = RATE * (1 - (step - 1) / steps)
                for number, (params, grads) in enumerate(parts):
                    for name, grad in grads.items():
                        m = moments.setdefault((number, name), [np.zeros_like(grad), np.zeros_like(grad)])
                        m[0] = 0.9 * m[0] + 0.1 * grad
                        m[1] = 0.99 * m[1] + 0.01 * grad**2
                        params[name] -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best label sequence of each window: (batch, LENGTH)."""
        e = self.emissions(x)
        trans = self.p["trans"].astype(np.float32)
        steps, n, _ = e.shape
        back = np.empty((steps, n, LABELS), np.int8)
        best = e[0] + self.p["begin"].astype(np.float32)
        for t in range(1, steps):
            options = best[:, :, None] + trans
            back[t] = options.argmax(axis=1)
            best = options.max(axis=1) + e[t]
        out = np.empty((n, steps), np.int8)
        out[:, -1] = best.argmax(axis=1)
        rows = np.arange(n)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[t][rows, out[:, t]]
        return out

    def weights(self) -> list[dict]:
        return [self.p, self.left.p, self.right.p]

    @classmethod
    def of(cls, weights: list[dict]) -> Tagger:
        tagger = cls()
        tagger.p, tagger.left.p, tagger.right.p = weights
        return tagger


def train(docs: DataFrame) -> list[dict] | None:
    """Weights learned from the spans that the patterns find in a sample of ``docs``; None without any."""
    x, y = sampled_windows(docs)
    return Tagger().fit(x, y).weights() if y.any() else None


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an @."""
    found: dict[int, None] = {}
    at = 0
    while m := MARKED.search(text, at):
        last = m.start() // STRIDE
        for k in range(max(0, last - LENGTH // STRIDE + 1), last + 1):
            found[k * STRIDE] = None
        # the rest of this stretch has the same windows
        at = (last + 1) * STRIDE
    return list(found)


def reconcile(n: int, starts: list[int], labels: np.ndarray) -> np.ndarray:
    """One label per character: that of the window in which it is farthest from an edge."""
    out, depth = np.zeros(n, np.int8), np.full(n, -1, np.int64)
    inside = np.minimum(np.arange(LENGTH), np.arange(LENGTH)[::-1])
    for start, found in zip(starts, labels):
        stop = min(n, start + LENGTH)
        own = inside[: stop - start].copy()
        if start == 0:
            own[: LENGTH // 2] = LENGTH
        better = own > depth[start:stop]
        out[start:stop][better] = found[: stop - start][better]
        depth[start:stop][better] = own[better]
    return out


def added_spans(text: str, labels: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of a label without blanks at their ends; those with a digit or @ that overlap no base span."""
    edges = np.flatnonzero(np.diff(labels, prepend=0, append=0))
    found, taken = [], Taken([(a, b) for _, a, b in base])
    for start, end in zip(edges.tolist(), edges[1:].tolist()):
        if not labels[start]:
            continue
        body = text[start:end]
        first = start + len(body) - len(body.lstrip())
        last = end - len(body) + len(body.rstrip())
        if MARKED.search(text, first, last) and taken.free(first, last):
            found.append((int(labels[start]) - 1, first, last))
    return found


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


def scan(docs: DataFrame, weights: list[dict] | None) -> DataFrame:
    """Per row the number of pattern spans of each kind, their digest, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = ["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger.of(shared.value) if shared.value else None
        for batch in text_chunks(batches, limit=4 << 20):
            texts = plain_texts(batch)
            base = [base_spans(text) for text in texts]
            spans = [list(b) for b in base]
            starts = [window_starts(text) if tagger else [] for text in texts]
            some = [i for i, s in enumerate(starts) if s]
            if some:
                windows = []
                for i in some:
                    whole = np.concatenate([codes(texts[i]), np.full(LENGTH, PAD, np.uint8)])
                    windows += [whole[s : s + LENGTH] for s in starts[i]]
                found = np.concatenate(
                    [tagger.decode(np.array(windows[k : k + 4096])) for k in range(0, len(windows), 4096)]
                )
                ends = np.cumsum([len(starts[i]) for i in some])
                for i, part in zip(some, np.split(found, ends[:-1])):
                    spans[i] += added_spans(texts[i], reconcile(len(texts[i]), starts[i], part), base[i])
            counts = [[sum(s[0] == kind for s in b) for b in base] for kind in range(len(KINDS))]
            digests = [hashlib.sha256(listed(b).encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array(digests, pa.string()),
                    pa.array([listed(sorted(s)) for s in spans], pa.string()),
                ],
                names,
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    counts = ", ".join(f"n_{kind} bigint" for kind in KINDS)
    return rows.mapInArrow(run, f"doc_id bigint, {counts}, base_sha256 string, spans string")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scan(docs, train(docs))
