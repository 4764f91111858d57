"""Toxicity: a linear-chain conditional random field tags toxic tokens.

Labels are given by document. Tokens get theirs in two rounds: the log-odds of words and of their first letters
between toxic and other documents, counted again with only what best explains each toxic document. The field has two states and sees each
token's evidence class. Forward-backward marginals give offending offsets and, aggregated, the document's score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.shared import annotate, saved, trimmed

WORD = re.compile(r"\w+")
#: Upper edges of the evidence classes, in log-odds; class 0 holds all words without an entry.
EDGES = np.array([-1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0])
CLASSES = len(EDGES) + 1
NEUTRAL = int(np.searchsorted(EDGES, 0.0))
#: At most so many tokens are in work at once, besides one text.
MOST_TOKENS = 250_000
#: And where all of a token's weights are in work.
MOST_TRAINED = 250_000
MOST_WORDS = 40_000
#: Sequences left below which a step is not worth an array's operations.
FEW = 32


def lowered(text: bytes | None) -> str:
    """Lower case, each character in its place: only U+0130 would become two."""
    return (text or b"").decode().replace("\u0130", "i").lower()


def tokens(text: bytes | None) -> list[str]:
    return WORD.findall(lowered(text))


def units(word: str) -> list[str]:
    """What a word is known by: itself and its first four, five and six letters."""
    return [word, *(f"^{word[:k]}" for k in (4, 5, 6) if len(word) > k)]


class Evidence(dict):
    """The evidence class of a word, the strongest of its units'; remembered, at most MOST_WORDS."""

    def __init__(self, classes: dict[str, int]):
        super().__init__()
        self.classes = classes

    def __missing__(self, word: str) -> int:
        c = max((self.classes.get(u, NEUTRAL) for u in units(word)), default=NEUTRAL)
        if len(self) >= MOST_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = c
        return c


@dataclass
class Model:
    classes: dict[str, int]  # evidence class of each unit that isn't neutral
    emission: np.ndarray  # CLASSES: log-odds of the toxic state
    change: np.ndarray  # 2 x 2: from state, to state
    start: float
    weights: np.ndarray  # of the document's features, intercept first

    def score(self, features: np.ndarray) -> np.ndarray:
        x = np.c_[np.ones(len(features)), features] @ self.weights
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def batches_by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest first: order, starts in the flat array, and how many sequences are longer than t, for each t."""
    order = np.argsort(-lengths, kind="stable")
    starts = np.r_[0, np.cumsum(lengths)[:-1]][order] if len(lengths) else np.empty(0, np.int64)
    alive = np.searchsorted(-lengths[order], -np.arange(lengths.max() if len(lengths) else 0), side="left")
    return order, starts, alive


def forward_backward(classes: np.ndarray, lengths: np.ndarray, emission: np.ndarray, change: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log marginal odds of the toxic state of every token, and the ratios forward and backward.

    With two states one ratio (toxic to other) holds all that a step passes on. Sequences run side by side.
    """
    e, a = np.exp(emission)[classes], np.exp(change)
    fwd, bwd = np.empty(len(classes)), np.empty(len(classes))
    order, starts, alive = batches_by_length(lengths)
    tiny, huge = 1e-200, 1e200
    # Steps that few sequences are left for are taken one sequence at a time: an array's step costs as much as that of FEW.
    lead = int(np.searchsorted(-alive, -FEW, side="right"))
    left = int(alive[lead]) if lead < len(alive) else 0
    ends = starts[:left] + lengths[order[:left]]
    (a00, a01), (a10, a11) = a.tolist()
    r = np.full(len(starts), np.exp(start))
    for t, k in enumerate(alive[:lead].tolist()):
        at = starts[:k] + t
        r = r[:k]
        if t:
            r = (a01 + a11 * r) / (a00 + a10 * r)
        r = np.clip(r * e[at], tiny, huge)
        fwd[at] = r
    q = np.empty(len(starts))
    for j, (head, end) in enumerate(zip((starts[:left] + lead).tolist(), ends.tolist())):
        own, x, out = e[head:end].tolist(), float(r[j]), []
        for t, y in enumerate(own, lead):
            if t:
                x = (a01 + a11 * x) / (a00 + a10 * x)
            x = min(max(x * y, tiny), huge)
            out.append(x)
        fwd[head:end] = out
        x, out = 1.0, [1.0]
        for y in reversed(own[1:]):
            y = min(max(x * y, tiny), huge)
            x = (a10 + a11 * y) / (a00 + a01 * y)
            out.append(x)
        bwd[head:end] = out[::-1]
        q[j] = x
    for t in range(lead - 1, -1, -1):
        k = alive[t]
        after = alive[t + 1] if t + 1 < len(alive) else 0
        if after:
            nxt = np.clip(q[:after] * e[starts[:after] + t + 1], tiny, huge)
            q[:after] = (a10 + a11 * nxt) / (a00 + a01 * nxt)
        q[after:k] = 1.0
        bwd[starts[:k] + t] = q[:k]
    return np.log(fwd) + np.log(bwd), fwd, bwd


def features(odds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Largest log-odds, log of the expected toxic tokens, and their share, of each document; neutral if it has none."""
    out = np.zeros((len(lengths), 3))
    some = np.flatnonzero(lengths)
    out[:, 0] = -15.0
    if len(some):
        first = np.r_[0, np.cumsum(lengths)[:-1]][some]
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        total = np.add.reduceat(p, first)
        out[some, 0] = np.clip(np.maximum.reduceat(odds, first), -15, 15)
        out[some, 1] = np.log(total + 1e-3)
        out[some, 2] = total / lengths[some]
    out[lengths == 0, 1] = np.log(1e-3)
    return out / np.array([5.0, 3.0, 0.1])


def tagged(texts: list[bytes | None], model: Model) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(numbers of texts, their lengths in tokens, log-odds of all their tokens), some texts at a time."""
    of = Evidence(model.classes).__getitem__
    held, flat, lengths = [], [], []
    for i, t in enumerate(texts):
        own = tokens(t)
        held.append(i)
        lengths.append(len(own))
        flat.append(np.fromiter(map(of, own), np.int64, len(own)))
        if sum(lengths) >= MOST_TOKENS or i + 1 == len(texts):
            n = np.array(lengths)
            yield held, n, forward_backward(np.concatenate(flat), n, model.emission, model.change, model.start)[0]
            held, flat, lengths = [], [], []


def chunked(batch: pa.RecordBatch, most: int) -> Iterator[tuple[list[np.ndarray], list[int]]]:
    """Evidence classes and labels of a batch's texts, as many texts at a time as have about `most` tokens."""
    held, ys, n = [], [], 0
    for c, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        held.append(np.frombuffer(c, np.uint8).astype(np.int64))
        ys.append(y)
        n += len(c)
        if n >= most:
            yield held, ys
            held, ys, n = [], [], 0
    if held:
        yield held, ys


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 20_000, rounds: int = 12, partitions: int = 24) -> Model:
    """Trains on at most most_rows labelled rows, those with the smallest hashes of their ids; give no held-out rows.

    Equal texts count once. Without labels of both kinds the model scores every text by the labels' rate.
    """
    spark = docs.sparkSession
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
        .groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most_rows)
    )
    sample = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    sample = saved(sample.groupBy(F.md5("text").alias("d")).agg(F.first("text").alias("text"), F.max("y").alias("y")).repartition(partitions), "toxicity-sample")
    size = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = size.get(1, 0), size.get(0, 0)
    neutral = Model({}, np.zeros(CLASSES), np.zeros((2, 2)), 0.0, np.array([np.log((n_toxic + 0.5) / (n_other + 1.0)), 0, 0, 0]))
    if not n_toxic or not n_other:
        return neutral

    def counted(label: int, pick) -> DataFrame:
        """(u, n): in how many documents of a label pick(units) holds a unit; at most most_rows texts' units."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got: Counter = Counter()
            for b in batches:
                for t in b.column(0).cast(pa.binary()).to_pylist():
                    got.update(pick({u for w in set(tokens(t)) for u in units(w)}))
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], names=["u", "n"])

        return sample.filter(F.col("y") == label).select("text").mapInArrow(trimmed(run), "u string, n long").groupBy("u").agg(F.sum("n").alias("n"))

    def collected(df: DataFrame) -> dict[str, int]:
        return {r.u: r.n for r in df.collect()}

    def log_odds(toxic: dict[str, int], other: dict[str, int]) -> dict[str, float]:
        return {u: float(np.log((n + 0.5) / (n_toxic + 1)) - np.log((other.get(u, 0) + 0.5) / (n_other + 1))) for u, n in toxic.items()}

    def best(own: set[str]) -> list[str]:
        odds = sent.value
        top = max((odds.get(u, 0.0) for u in own), default=0.0)
        return [u for u in own if odds.get(u, 0.0) >= max(1.0, top - 0.7)]

    # Units that three of at most most_rows toxic texts hold: what is sent is bounded by the sample.
    toxic = collected(counted(1, lambda own: own).filter("n >= 3"))
    met = spark.sparkContext.broadcast(frozenset(toxic))
    other = collected(counted(0, lambda own: own & met.value))
    sent = spark.sparkContext.broadcast(log_odds(toxic, other))
    explaining = log_odds(collected(counted(1, best).filter("n >= 3")), other)
    classes = {u: int(np.searchsorted(EDGES, x)) for u, x in explaining.items() if x > 1}
    top = int(np.searchsorted(EDGES, 3.0))

    strong = spark.sparkContext.broadcast(classes)

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's evidence classes, a byte each."""
        of = Evidence(strong.value).__getitem__
        for b in batches:
            c = [bytes(map(of, tokens(t))) for t in b.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), b.column(1)], names=["c", "y"])

    seen_classes = saved(sample.select("text", "y").mapInArrow(trimmed(sequences), "c binary, y int"), "toxicity-sequences")

    def gradients(emission, change, start):
        """Sums over a partition: observed less expected counts, for all weights."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = np.zeros(CLASSES + 5)
            for flat, ys in (x for b in batches for x in chunked(b, MOST_TRAINED)):
                flat, ys = [c for c in flat if len(c)], [y for c, y in zip(flat, ys) if len(c)]
                if not flat:
                    continue
                n, c = np.array([len(f) for f in flat]), np.concatenate(flat)
                seen = ((c >= top) & np.repeat(np.array(ys) == 1, n)).astype(float)
                odds, fwd, bwd = forward_backward(c, n, emission, change, start)
                p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
                head = np.r_[0, np.cumsum(n)[:-1]]
                g[:CLASSES] += np.bincount(c, seen - p, CLASSES)
                later = np.ones(len(c), bool)
                later[head] = False
                at = np.flatnonzero(later)
                e, a = np.exp(emission)[c[at]], np.exp(change)
                r, q = fwd[at - 1], np.clip(e * bwd[at], 1e-200, 1e200)
                joint = np.stack([np.broadcast_to(a[0, 0], len(at)), a[0, 1] * q, a[1, 0] * r, a[1, 1] * r * q])
                joint = joint / joint.sum(axis=0)
                x, y = seen[at - 1], seen[at]
                told = np.stack([(1 - x) * (1 - y), (1 - x) * y, x * (1 - y), x * y])
                g[CLASSES : CLASSES + 4] += (told - joint).sum(axis=1)
                g[-1] += (seen[head] - p[head]).sum()
            yield pa.RecordBatch.from_arrays([pa.array([g.tolist()], pa.list_(pa.float64()))], names=["g"])

        got = seen_classes.mapInArrow(trimmed(run), "g array<double>").collect()  # a row a partition
        return np.sum([r.g for r in got], axis=0)

    theta = np.r_[np.clip(np.r_[EDGES, EDGES[-1] + 1] - 3.0, -4, 4), [0.0, -2.0, -1.0, 0.0], -3.0]
    speed, mean, square = 0.5, np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):  # Adam: the weights are few and of very different scales
        g = gradients(theta[:CLASSES], theta[CLASSES : CLASSES + 4].reshape(2, 2), theta[-1]) - 0.01 * theta
        mean, square = 0.8 * mean + 0.2 * g, 0.95 * square + 0.05 * g * g
        theta = theta + speed * (mean / (1 - 0.8**k)) / (np.sqrt(square / (1 - 0.95**k)) + 1e-9)
    model = Model(classes, theta[:CLASSES], theta[CLASSES : CLASSES + 4].reshape(2, 2), theta[-1], np.zeros(4))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, ys in (x for b in batches for x in chunked(b, MOST_TOKENS)):
            n = np.array([len(c) for c in flat])
            odds = forward_backward(np.concatenate(flat), n, model.emission, model.change, model.start)[0]
            yield pa.RecordBatch.from_arrays([pa.array(features(odds, n).tolist(), pa.list_(pa.float64())), pa.array(ys, pa.int32())], names=["f", "y"])

    rows = seen_classes.mapInArrow(trimmed(scored), "f array<double>, y int").collect()  # at most most_rows rows of four numbers
    x, y = np.array([[1.0, *r.f] for r in rows]), np.array([r.y for r in rows], float)
    w = np.zeros(4)
    for _ in range(25):  # Newton's method, ridge 0.1
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4), x.T @ (y - p) - 0.1 * w)
    model.weights = w
    return model


def score_toxicity(docs: DataFrame, model: Model, *, text_col: str = "text", spans: bool = True, into: str = "toxicity") -> DataFrame:
    """docs with the struct `into`: score double (0 to 1), predicted int (score >= 0.5), spans array<struct(start, end, p)>.

    spans are the tokens whose marginal is over one half, in code points, end exclusive (none unless asked for). Only
    the text is an input. Null and empty texts have no tokens and get the score of a text without evidence; repeated
    rows get the same score. A column named `into` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value

        def of(texts: list[bytes | None], _: pa.RecordBatch) -> list[tuple]:
            out = []
            for held, n, odds in tagged(texts, m):
                scores, at = m.score(features(odds, n)).tolist(), np.r_[0, np.cumsum(n)]
                for j, i in enumerate(held):
                    own = np.flatnonzero(odds[at[j] : at[j + 1]] > 0) if spans else ()
                    found = []
                    if len(own):
                        places = [x.span() for x in WORD.finditer(lowered(texts[i]))]
                        found = [{"start": places[k][0], "end": places[k][1], "p": float(1 / (1 + np.exp(-odds[at[j] + k])))} for k in own.tolist()]
                    out.append((scores[j], int(scores[j] >= 0.5), found))
            return out

        return of

    return annotate(docs, text_col, into, "score double, predicted int, spans array<struct<start:int,end:int,p:double>>", make)
