"""Toxicity: a convolutional text classifier in numpy.

A word is the sum of hashed embeddings of itself and of its beginnings. Filters over one, two and
three words, max pooling over the whole text and a logistic layer give a logit. It is trained in small batches on all labelled
rows: tasks go through their shares block by block, and what they learn is averaged. Every fifth row or so isn't trained on; these
calibrate the score, and thresholds by language.
"""

from __future__ import annotations

import copy
import pickle
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.shared import drop, table

WIDTHS = (1, 2, 3)
#: Letters of a word's beginning that get an embedding of their own.
STEMS = (3, 4, 5, 6)
#: Words remembered by a Python worker, and words scored at once.
MEMO, STEP = 200_000, 1 << 15
#: Texts whose new words are learnt at once, at most.
GROUP = 64
#: Labels that are broadcast; more are joined by a shuffle of both sides.
BROADCAST = 200_000
#: Epochs between two averages, blocks that a task goes through at least where there are more than cores, pieces of a model that are averaged apart, and steps of a standard deviation by which held rows are counted.
MERGED, SHARE, CHUNKS, FINE = 2, 4, 16, 256
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 or c == 39 else 32 for c in range(256))


@dataclass(frozen=True)
class Setup:
    """max_rows, max_words: the bounds of a block, what a task holds of the rows that it learns from (one text at least). The rest shapes the net."""

    max_rows: int = 6000
    max_words: int = 2_000_000
    batch: int = 8
    buckets: int = 1 << 16
    dims: int = 12
    filters: int = 8
    epochs: int = 6
    rate: float = 0.15
    seed: int = 5


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_FOLD).split()


def _states() -> np.ndarray:
    """What a byte does to the state of a CRC-32."""
    at = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        at = np.where(at & 1, (at >> 1) ^ np.uint32(0xEDB88320), at >> 1)
    return at


_STATES = _states()


def _ids_of(some: list[bytes], buckets: int) -> np.ndarray:
    """(words, ids): `_ids` of each. ASCII words of up to 32 letters go through the CRC side by side."""
    out = np.full((len(some), 1 + len(STEMS)), buckets, np.int32)
    plain = np.array([w.isascii() and len(w) <= 32 for w in some], bool)
    for i in np.flatnonzero(~plain):
        out[i] = _ids(some[i], buckets)
    if not plain.any():
        return out
    at = np.flatnonzero(plain)
    size = np.array([len(some[i]) for i in at])
    order = np.argsort(-size, kind="stable")
    at, size = at[order], size[order]
    letters = np.array([some[i] for i in at], f"S{max(size[0], 1)}").view(np.uint8).reshape(len(at), -1).T.copy()
    for k, (mark, most) in enumerate([(b"w", len(letters)), *((b"%d" % n, n) for n in STEMS)]):
        many = len(at) if not k else int(np.searchsorted(-size, -most, "right"))  # those long enough
        state = np.full(many, zlib.crc32(mark) ^ 0xFFFFFFFF, np.uint32)
        for j in range(min(most, len(letters))):
            long = many if k else int(np.searchsorted(-size, -j))
            state[:long] = _STATES[(state[:long] ^ letters[j, :long]) & 255] ^ (state[:long] >> np.uint32(8))
        out[at[:many], k] = (state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)
    return out


def _ids(word: bytes, buckets: int) -> list[int]:
    letters = word.decode(errors="ignore")
    marks = [b"w" + word, *(b"%d" % n + letters[:n].encode() for n in STEMS if len(letters) >= n)]
    ids = [zlib.crc32(x) % buckets for x in marks]
    return ids + [buckets] * (1 + len(STEMS) - len(ids))  # the last row of the embedding stays zero


@dataclass
class Model:
    setup: Setup
    embed: np.ndarray  # buckets + 1, dims
    conv: list[np.ndarray]  # width, dims, filters for each width
    bias: list[np.ndarray]
    out: np.ndarray
    const: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None  # the score of every text, where there was nothing to learn

    def projected(self, ids: np.ndarray) -> np.ndarray:
        """(words, ids) -> what each word adds to each filter at each of its places."""
        v = self.embed[ids].sum(axis=1)
        return np.concatenate([v @ part for w in self.conv for part in w], axis=1)


def _pooled(model: Model, x: np.ndarray) -> np.ndarray:
    """x: projected words, with 2 zero rows behind. Max over places of each filter."""
    f, at, out = model.setup.filters, 0, []
    n = len(x) - max(WIDTHS) + 1
    for w, bias in zip(WIDTHS, model.bias, strict=True):
        y = x[:n, at : at + f]
        for k in range(1, w):
            y = y + x[k : n + k, at + k * f : at + (k + 1) * f]
        at += w * f
        out.append(y.max(axis=0) + bias)
    return np.maximum(np.concatenate(out), 0)


class Scorer:
    """Scores texts; remembers what words give."""

    def __init__(self, model: Model):
        self.model, self.width = model, sum(WIDTHS) * model.setup.filters
        self._reset()

    def _reset(self) -> None:
        self.row: dict[bytes, int] = {}
        self.table = np.zeros((1024, self.width), np.float32)  # row 0: no word

    def _learn(self, new: list[bytes]) -> None:
        if len(self.row) + len(new) > MEMO:
            raise MemoryError
        x = self.model.projected(_ids_of(new, self.model.setup.buckets))
        at = len(self.row) + 1
        if at + len(new) > len(self.table):
            bigger = np.zeros((max(2 * len(self.table), at + len(new)), self.width), np.float32)
            bigger[:at] = self.table[:at]
            self.table = bigger
        self.table[at : at + len(new)] = x
        self.row.update(zip(new, range(at, at + len(new)), strict=True))

    def _know(self, some: set[bytes]) -> None:
        new = [x for x in some if x not in self.row]
        if new:
            if len(self.row) + len(new) > MEMO:
                self._reset()
                new = list(some)
            self._learn(new)

    def logit(self, text: str | None) -> float:
        return self._logit(words(text))

    def _logit(self, w: list[bytes]) -> float:
        best = None
        for a in range(0, max(1, len(w)), STEP):
            some = w[a : a + STEP + max(WIDTHS) - 1]
            try:
                rows = np.fromiter(map(self.row.__getitem__, some), np.int64, len(some))
            except KeyError:
                self._know(set(some))
                rows = np.fromiter(map(self.row.__getitem__, some), np.int64, len(some))
            end = min(len(some), STEP) if a + STEP < len(w) else len(some)
            pad = np.zeros(max(0, end + max(WIDTHS) - 1 - len(some)) + (not len(some)), np.int64)
            y = _pooled(self.model, self.table[np.concatenate([rows, pad])])
            best = y if best is None else np.maximum(best, y)
        return float(best @ self.model.out + self.model.const)

    def logits(self, texts: Iterable[str | None]) -> Iterator[float]:
        """`logit` of each; new words of a few texts are learnt at once."""
        held, some = [], set()
        for text in texts:
            held.append(words(text))
            some.update(held[-1])
            if len(held) == GROUP or len(some) > STEP:
                yield from self._flushed(held, some)
                held, some = [], set()
        yield from self._flushed(held, some)

    def _flushed(self, held: list[list[bytes]], some: set[bytes]) -> Iterator[float]:
        if len(some) <= MEMO:
            self._know(some)
        return map(self._logit, held)

    def score(self, text: str | None) -> float:
        return next(self.scores([text]))

    def scores(self, texts: Iterable[str | None]) -> Iterator[float]:
        m = self.model
        if m.constant is not None:
            return (m.constant for _ in texts)
        return (float(1 / (1 + np.exp(-np.clip(m.scale * x + m.shift, -30, 30)))) for x in self.logits(texts))


def hashed(text: str | None, setup: Setup) -> np.ndarray:
    """(words, ids) of a text."""
    some = words(text)
    of = {w: i for i, w in enumerate(set(some))}
    return _ids_of(list(of), setup.buckets)[np.fromiter(map(of.__getitem__, some), np.int64, len(some))]


@dataclass
class Words:
    """Texts as places in a table of distinct words: `ids` has their ids, row 0 none; each text ends with 2 places of row 0, an empty one has a third."""

    ids: np.ndarray
    texts: list[np.ndarray]

    @staticmethod
    def of(texts: list[np.ndarray], buckets: int) -> Words:
        every = np.concatenate(texts) if texts else np.zeros((0, 1 + len(STEMS)), np.int32)
        weight = np.array([3**k * (1 << 12 * k) + 1 for k in range(every.shape[1])], np.int64)
        mark = np.concatenate([t.astype(np.int64) @ weight for t in texts] or [np.zeros(0, np.int64)])  # 64 bits for a word's ids
        _, one, at = np.unique(mark, return_index=True, return_inverse=True)
        distinct, at, pad = every[one], at + 1, max(WIDTHS) - 1
        cut = np.cumsum([0] + [len(t) for t in texts])
        out = [np.append(at[x:y], np.zeros(pad + (x == y), np.int64)) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        return Words(np.concatenate([np.full((1, distinct.shape[1]), buckets, np.int32), distinct]), out)


def blocks(batches: Iterator[pa.RecordBatch], setup: Setup) -> Iterator[tuple[Words, np.ndarray]]:
    """Texts and their labels (text, toxic), as many at a time as `setup` and MEMO allow, one at least."""
    pad = max(WIDTHS) - 1
    row: dict[bytes, int] = {}
    texts, toxic, total = [], [], 0

    def block() -> tuple[Words, np.ndarray]:
        none = np.full((1, 1 + len(STEMS)), setup.buckets, np.int32)
        return Words(np.concatenate([none, _ids_of(list(row), setup.buckets)]), texts), np.array(toxic)

    for rb in batches:
        for text, y in zip(rb.column("text"), rb.column("toxic").to_pylist(), strict=True):
            w = words(text.as_py())
            if texts and (len(texts) >= setup.max_rows or total + len(w) > setup.max_words or len(row) > MEMO):
                yield block()
                row, texts, toxic, total = {}, [], [], 0
            for x in set(w):
                row.setdefault(x, len(row) + 1)
            places = np.zeros(len(w) + pad + (not w), np.int32)
            places[: len(w)] = np.fromiter(map(row.__getitem__, w), np.int32, len(w))
            texts.append(places)
            toxic.append(y)
            total += len(w)
    if texts:
        yield block()


def gradients(model: Model, of: Words, pick: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, dict]:
    """Logits of the texts `pick`, and the gradients of their summed logistic loss: out, const, bias, conv, and embed as (rows, values)."""
    f, pad, lanes = model.setup.filters, max(WIDTHS) - 1, np.arange(model.setup.filters * len(WIDTHS))
    every = np.concatenate([of.texts[i] for i in pick])
    end = np.cumsum([len(of.texts[i]) for i in pick])
    used = np.zeros(len(of.ids), bool)
    used[every] = True
    used = np.flatnonzero(used)
    at = np.empty(len(of.ids), np.int64)
    at[used] = np.arange(len(used))
    word, ids = at[every], of.ids[used]
    v = model.embed[ids[:, 0]]
    for k in range(1, ids.shape[1]):
        v = v + model.embed[ids[:, k]]
    adds = np.ascontiguousarray((v @ np.concatenate([part for w in model.conv for part in w], axis=1)).T)  # to each filter at each of its places
    top, places = np.zeros((len(lanes), len(pick)), adds.dtype), np.zeros((len(lanes), len(pick)), np.int64)
    for d, begin in enumerate(end - [len(of.texts[i]) for i in pick]):
        for a in range(begin, end[d] - pad, STEP):
            n = min(STEP, end[d] - pad - a)
            x, c = adds.take(word[a : a + n + pad], axis=1), 0
            g = np.empty((len(lanes), n), adds.dtype)
            for w, width in enumerate(WIDTHS):
                mine = g[w * f : (w + 1) * f]
                mine[:] = x[c : c + f, :n]
                for k in range(1, width):
                    mine += x[c + k * f : c + (k + 1) * f, k : n + k]
                c += width * f
            spot = g.argmax(axis=1)  # the first place of each maximum
            most = g[lanes, spot]
            more = lanes if a == begin else np.flatnonzero(most > top[:, d])
            top[more, d], places[more, d] = most[more], spot[more] + a
    z = top.T + np.concatenate(model.bias)
    act = np.maximum(z, 0)
    logit = act @ model.out + model.const
    wrong = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y
    back = wrong[:, None] * model.out * (z > 0)
    convs, hits, dv = [], [], []
    for w, conv in enumerate(model.conv):
        gz, d = back[:, w * f : (w + 1) * f], np.zeros_like(conv)
        for k in range(WIDTHS[w]):
            hit = word[places[w * f : (w + 1) * f].T + k]
            d[k] = np.einsum("nfd,nf->df", v[hit], gz)
            hits.append(hit.ravel())
            dv.append((gz[:, :, None] * conv[k].T).reshape(hit.size, -1))
        convs.append(d)
    dv = np.concatenate(dv).astype(v.dtype)
    on = np.flatnonzero(dv.any(axis=1))
    rows, at = np.unique(ids[np.concatenate(hits)[on]], return_inverse=True)
    values = np.zeros((len(rows), v.shape[1]), v.dtype)
    order = np.argsort(at.ravel(), kind="stable")
    if len(order):
        values[:] = np.add.reduceat(dv[on[order // ids.shape[1]]], np.searchsorted(at.ravel()[order], np.arange(len(rows))), axis=0)
    values[rows == model.setup.buckets] = 0  # the row of no id stays zero
    return logit, {"out": act.T @ wrong, "const": wrong.sum(), "bias": [back[:, w * f : (w + 1) * f].sum(axis=0) for w in range(len(WIDTHS))], "conv": convs, "embed": (rows, values)}


class Learner:
    """A model and the squares of the gradients that it has met (AdaGrad)."""

    def __init__(self, setup: Setup, rng: np.random.Generator):
        f, d = setup.filters, setup.dims
        self.model = Model(setup, (rng.standard_normal((setup.buckets + 1, d)) * 0.1).astype(np.float32), [(rng.standard_normal((w, d, f)) / np.sqrt(w * d)).astype(np.float32) for w in WIDTHS], [np.zeros(f, np.float32) for _ in WIDTHS], np.full(f * len(WIDTHS), 0.5, np.float32) * np.tile([1, -1], f * len(WIDTHS) // 2).astype(np.float32), 0.0)
        self.model.embed[-1] = 0
        self.embed, self.small = np.full_like(self.model.embed, 1e-2), [np.full_like(x, 1e-2) for x in (*self.model.conv, *self.model.bias, self.model.out)]
        self.const = 1e-2

    def learn(self, of: Words, toxic: np.ndarray, train: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
        """Goes through the rows `train` of `of` in small batches."""
        m, rate = self.model, self.model.setup.rate
        for _ in range(epochs):
            turn = rng.permutation(train)
            for at in range(0, len(turn), m.setup.batch):
                pick = turn[at : at + m.setup.batch]
                _, g = gradients(m, of, pick, toxic[pick])
                self.const += g["const"] ** 2
                m.const -= float(rate * g["const"] / np.sqrt(self.const))
                steps = [*g["conv"], *g["bias"], g["out"].astype(np.float32) + 1e-4 * m.out]
                for x, square, step in zip((*m.conv, *m.bias, m.out), self.small, steps, strict=True):
                    step = step.astype(np.float32)
                    square += step * step
                    x -= rate * step / np.sqrt(square)
                r, values = g["embed"]
                self.embed[r] += values * values
                m.embed[r] -= rate * values / np.sqrt(self.embed[r])

    def _small(self) -> np.ndarray:
        """All numbers but the embeddings', and their squares."""
        m = self.model
        return np.array([np.concatenate([*(x.ravel() for x in (*m.conv, *m.bias, m.out)), [m.const]]), np.concatenate([*(x.ravel() for x in self.small), [self.const]])])

    def change(self, start: Learner) -> Iterator[tuple[int, np.ndarray]]:
        """(piece, numbers): what differs from `start`, with a last column that counts who says so. Squares travel as roots, embeddings in 16 bits."""
        piece = np.append(self._small() - start._small(), np.ones((1, start._small().shape[1])), axis=0)
        yield -1, piece.T
        moved, met = self.model.embed - start.model.embed, np.sqrt(self.embed - start.embed)
        whole = np.concatenate([moved, met, met.any(axis=1)[:, None]], axis=1)
        yield from enumerate(np.array_split(whole, CHUNKS))

    def changed(self, sums: dict[int, np.ndarray]) -> Learner:
        """With the mean of changes, an embedding's of those that met it."""
        out = copy.deepcopy(self)
        m, d = out.model, self.model.setup.dims
        whole = np.concatenate([sums[k] for k in range(CHUNKS)])
        n = np.maximum(whole[:, -1:], 1)
        m.embed += (whole[:, :d] / n).astype(np.float32)
        out.embed += (whole[:, d:-1] / n).astype(np.float32)
        value, square = self._small() + (sums[-1][:, :2] / sums[-1][:, 2:]).T
        at = 0
        for x, y in zip((*m.conv, *m.bias, m.out), out.small, strict=True):
            x[:], y[:] = value[at : at + x.size].reshape(x.shape), square[at : at + x.size].reshape(x.shape)
            at += x.size
        m.const, out.const = float(value[-1]), float(square[-1])
        return out


def fit(rows: list[tuple[np.ndarray, int, str | None]], setup: Setup = Setup()) -> Model:
    """rows: (hashed words, toxic, lang), a block at most. lang only chooses thresholds. Every fifth row calibrates, the others train."""
    rng = np.random.default_rng(setup.seed)
    learner = Learner(setup, rng)
    model = learner.model
    toxic = np.array([y for _, y, _ in rows])
    if not len(rows) or toxic.min() == toxic.max():
        model.constant = float(toxic.mean()) if len(rows) else 0.0
        return model
    of = Words.of([x for x, _, _ in rows], setup.buckets)
    held = np.array([i for i in range(len(rows)) if not i % 5], np.int64)
    learner.learn(of, toxic, np.array([i for i in range(len(rows)) if i % 5], np.int64), setup.epochs, rng)
    x = np.concatenate([gradients(model, of, held[at : at + 256], toxic[held[at : at + 256]])[0] for at in range(0, len(held), 256)])
    y, n = toxic[held].astype(float), np.ones(len(held))
    _calibrate(model, x, y, n)
    for lang in {rows[i][2] for i in held}:
        mine = np.array([rows[i][2] == lang for i in held])
        model.thresholds[lang] = _threshold(_scores(model, x[mine]), y[mine], n[mine])
    return model


def _scores(model: Model, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.scale * x + model.shift, -30, 30)))


def _calibrate(model: Model, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
    """Scale and shift of the logit that fit `y` best, n rows of each, with one row of each class added so that they stay finite."""
    mean = (n * x).sum() / max(n.sum(), 1)
    spread = np.sqrt((n * (x - mean) ** 2).sum() / max(n.sum(), 1)) or 1.0
    x = np.append((x - mean) / spread, [2.0, -2.0])
    y, n = np.append(y, [1.0, 0.0]), np.append(n, [1.0, 1.0])
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        grad = np.array([(n * (p - y) * x).sum() + 0.05 * a, (n * (p - y)).sum()])
        hess = np.array([[(w * x * x).sum() + 0.05, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    a = max(a, 1e-3)
    model.scale, model.shift = float(a / spread), float(b - a * mean / spread)


def _threshold(score: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Of the thresholds with the fewest wrong rows the one nearest to 0.5, n rows of each; 0.5 for fewer than 20 rows of a class."""
    if min((n * y).sum(), (n * (1 - y)).sum()) < 20:
        return 0.5
    cuts = np.unique(np.concatenate([[0.5], (np.unique(score)[1:] + np.unique(score)[:-1]) / 2]))
    wrong = np.array([n[(score >= c) != (y == 1)].sum() for c in cuts])
    best = cuts[wrong == wrong.min()]
    return float(best[np.abs(best - 0.5).argmin()])


def remainder(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, setup: Setup = Setup()) -> Model:
    """Fits on all labelled rows of which none has remainder 0.

    Of several labels of a doc_id the greatest counts; rows without doc_id or label aren't used. What is one block is fitted in one task. More rows are dealt by doc_id
    to tasks, one a core or one for SHARE blocks if these are more; each goes through its share block by block, MERGED epochs each, then the mean of what they have learnt is where all go on.
    """
    y = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    y = y.where(remainder(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.where(remainder(F.col("doc_id")) != 0).select("doc_id", "text", lang.alias("lang"))
    rows = rows.join(F.broadcast(y), "doc_id").repartition("doc_id") if y.count() <= BROADCAST else rows.join(y.hint("merge"), "doc_id")
    rows = table(rows, "labelled")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            n = sum(len(words(t.as_py())) for t in rb.column("text"))
            yield pa.RecordBatch.from_pydict({"rows": [rb.num_rows], "toxic": [sum(rb.column("toxic").to_pylist())], "n": [n]})

    size = rows.select("text", "toxic").mapInArrow(sizes, "rows long, toxic long, n long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "toxic", "n")]).first()
    if size.toxic in (0, size.rows):
        model = fit([(hashed("", setup), int(size.toxic > 0), None)] if size.rows else [], setup)  # nothing to learn
    elif size.rows <= setup.max_rows and size.n <= setup.max_words:
        model = _fitted(rows, setup)
    else:
        tasks = max(docs.sparkSession.sparkContext.defaultParallelism, round(max(size.rows / setup.max_rows, size.n / setup.max_words) / SHARE))
        model = _merged(rows.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0), setup, tasks)
    drop(rows)
    return model


def _fitted(rows: DataFrame, setup: Setup) -> Model:
    """Of a block: its rows meet in one task, the driver gets no more than the model."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = []
        for rb in batches:
            some += zip((hashed(t.as_py(), setup) for t in rb.column("text")), rb.column("toxic").to_pylist(), rb.column("lang").to_pylist(), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(some, setup))], pa.binary())], ["model"])

    models = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).select("text", "toxic", "lang").coalesce(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(models[0].model) if models else fit([], setup)


def _merged(rows: DataFrame, setup: Setup, tasks: int) -> Model:
    """Of more than a block (doc_id, text, toxic, lang, held)."""
    learner = Learner(setup, np.random.default_rng(setup.seed))
    train = rows.where("NOT held").select("text", "toxic").coalesce(tasks)
    for turn in range(0, setup.epochs, MERGED):
        learner = _turn(train, learner, turn)
    return _calibrated(rows.where("held"), learner.model)


def _turn(train: DataFrame, start: Learner, turn: int) -> Learner:
    """Epochs from `turn` on: each task learns from its rows alone, then the changes are averaged by pieces."""
    setup = start.model.setup
    shared = train.sparkSession.sparkContext.broadcast(start)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rng, seen = copy.deepcopy(shared.value), np.random.default_rng([setup.seed, turn, TaskContext.get().partitionId()]), False
        for of, toxic in blocks(batches, setup):
            own.learn(of, toxic, np.arange(len(toxic)), min(MERGED, setup.epochs - turn), rng)
            seen = True
        for piece, x in own.change(shared.value) if seen else ():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([x.astype(np.float64 if piece < 0 else np.float16).tobytes()], pa.binary())], ["piece", "change"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for rb in batches:
            for piece, change in zip(rb.column("piece").to_pylist(), rb.column("change"), strict=True):
                x = np.frombuffer(change.as_buffer(), np.float64 if piece < 0 else np.float16).reshape(-1, 3 if piece < 0 else 2 * setup.dims + 1).astype(np.float64)
                if piece >= 0:
                    x[:, setup.dims : -1] **= 2
                sums[piece] = sums[piece] + x if piece in sums else x
        for piece, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], ["piece", "change"])

    kind = "piece int, change binary"
    sums = {r.piece: np.frombuffer(r.change, np.float32).reshape(-1, 3 if r.piece < 0 else 2 * setup.dims + 1) for r in train.mapInArrow(learn, kind).repartition("piece").mapInArrow(add, kind).collect()}
    shared.destroy()
    return start.changed(sums) if sums else start


def _calibrated(held: DataFrame, model: Model) -> Model:
    """Scale, shift and thresholds by language, from all of `held` (text, toxic, lang). Logits are counted in steps of 1 / FINE of their deviation, up to 8 of these from the mean."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for rb in batches:
            x = pa.array(list(scorer.logits(t.as_py() for t in rb.column("text"))), pa.float64())
            yield pa.RecordBatch.from_arrays([x, rb.column("toxic"), rb.column("lang")], ["x", "toxic", "lang"])

    logits = table(held.select("text", "toxic", "lang").mapInArrow(run, "x double, toxic int, lang string"), "logits")
    mean, spread = logits.agg(F.coalesce(F.avg("x"), F.lit(0.0)), F.coalesce(F.nullif(F.stddev_pop("x"), F.lit(0.0)), F.lit(1.0))).first()
    step = F.round((F.col("x") - mean) / spread * FINE).cast("long")
    binned = logits.select("toxic", "lang", F.greatest(F.lit(-8 * FINE), F.least(F.lit(8 * FINE), step)).alias("bin"))
    counts = lambda some: (np.array([mean + r.bin * spread / FINE for r in some]), np.array([float(r.toxic) for r in some]), np.array([float(r.n) for r in some]))
    _calibrate(model, *counts(binned.groupBy("bin", "toxic").agg(F.count("*").alias("n")).orderBy("bin", "toxic").collect()))
    # languages of too few rows keep 0.5
    many = binned.groupBy(F.col("lang").alias("of_lang")).agg(F.sum("toxic").alias("ones"), F.count("*").alias("every")).where("ones >= 20 AND every - ones >= 20")
    by: dict[str | None, list] = {}
    for r in binned.join(many, F.col("lang").eqNullSafe(F.col("of_lang"))).groupBy("lang", "bin", "toxic").agg(F.count("*").alias("n")).orderBy("bin", "toxic").collect():
        by.setdefault(r.lang, []).append(r)
    for lang, some in by.items():
        x, y, n = counts(some)
        model.thresholds[lang] = _threshold(_scores(model, x), y, n)
    shared.destroy()
    drop(logits)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` with toxicity_score and toxicity_flag (score >= the threshold of the row's lang, else 0.5).

    The score is made from the text alone; a null text is empty. Without a column lang all rows are of none. Columns of
    `docs` of these names are replaced.
    """
    docs = docs.drop("toxicity_score", "toxicity_flag")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # setup.buckets rows of setup.dims numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        thresholds = shared.value.thresholds
        for rb in batches:
            s = list(scorer.scores(t.as_py() for t in rb.column("text")))
            langs = rb.column("lang").to_pylist() if "lang" in rb.schema.names else [None] * rb.num_rows
            flag = [x >= thresholds.get(lang, 0.5) for x, lang in zip(s, langs, strict=True)]
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(s, pa.float64()), pa.array(flag, pa.bool_())], [*rb.schema.names, "toxicity_score", "toxicity_flag"])

    out = T.StructType([*docs.schema.fields, T.StructField("toxicity_score", T.DoubleType()), T.StructField("toxicity_flag", T.BooleanType())])
    return docs.mapInArrow(run, out)


def digest(docs: DataFrame, labels: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """doc_id, held_out, score, predicted, a row for each row of `docs`. A row without doc_id isn't held out."""
    s = score(docs.select("doc_id", "text", *(c for c in docs.columns if c == "lang")), train(docs, labels, setup))
    return s.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """The rows of `docs` that aren't flagged."""
    return score(docs, train(docs, labels, setup)).where(~F.col("toxicity_flag")).select(*docs.columns)
