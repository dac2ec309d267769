"""Operator 9: toxicity by a bidirectional gated recurrent network with attention.

A text's words (letters and digits, lower-cased) are read in overlapping windows of
``WINDOW`` words, one every ``STEP``. A word enters as its own hashed vector beside
the mean vector of its character 3- to 5-grams, so unseen words still have a
spelling. Gated recurrent units run over the window in both directions, attention
pools their states, and one logit comes out. A document's score is that of its
highest window, all windows counted; the network is trained the same way (each
labelled document teaches through its highest window), in numpy, on at most
``max_documents`` labelled rows chosen by a hash of their id.

Vectors start from smoothed log-odds of words and n-grams in the training rows.

Edge cases: null and empty texts have one window of no words and get its score (a
number from 0 to 1); documents without a label are scored but teach nothing;
labels that repeat, conflict or are null: each pair of row and label teaches, nulls
do not; with labels of one class only the score is that of an untrained output; an
empty table gives no rows; all columns of the input pass through under their names; a
row without an id is scored and teaches nothing.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlake.llm.common import raw, slices
from runlake.llm.decontam import words

WINDOW, STEP = 32, 8
WORD_ROWS = GRAM_ROWS = 1 << 15
WORD_DIM = GRAM_DIM = 8
HIDDEN, ATTENTION = 12, 8
MAX_DOCUMENTS, MAX_CHARS = 3000, 40_000
EPOCHS = 5
#: Gradient steps of an epoch, at least: few labels are passed over more often.
LEAST_STEPS = 90


def sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Words:
    """Distinct words of a batch: hashed rows and their n-gram rows."""

    def __init__(self, distinct: list[bytes]):
        self.rows = np.fromiter(map(zlib.crc32, distinct), np.int64, len(distinct)) % (WORD_ROWS - 1) + 1
        data = np.frombuffer(b"".join([b"^" + w + b"$" for w in distinct]), np.uint8).astype(np.uint64)
        size = np.fromiter(map(len, distinct), np.int64, len(distinct)) + 2
        owner = np.repeat(np.arange(len(distinct)), size)
        grams, owners = [], []
        for n in (3, 4, 5):
            if len(data) < n:
                continue
            h = np.full(len(data) - n + 1, n, np.uint64)
            for i in range(n):
                h = h * np.uint64(1_000_003) + data[i:len(data) - n + 1 + i]
            inside = owner[:len(data) - n + 1] == owner[n - 1:]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            grams.append(((h >> np.uint64(40)) % np.uint64(GRAM_ROWS)).astype(np.int32)[inside])
            owners.append(owner[:len(data) - n + 1][inside].astype(np.int32))
        self.grams = np.concatenate(grams) if grams else np.zeros(0, np.int32)
        owners = np.concatenate(owners) if owners else np.zeros(0, np.int32)
        order = np.argsort(owners, kind="stable")
        self.grams = self.grams[order]
        self.count = np.bincount(owners, minlength=len(distinct))
        self.at = np.cumsum(self.count) - self.count

    def gram_mean(self, rows: np.ndarray) -> np.ndarray:
        """Mean of the n-gram vectors of each word (every word has at least one 3-gram)."""
        out = np.zeros((len(self.rows), rows.shape[1]), np.float32)
        for lo in range(0, len(self.rows), 50_000):
            hi = min(len(self.rows), lo + 50_000)
            a, b = self.at[lo], self.at[hi - 1] + self.count[hi - 1]
            out[lo:hi] = np.add.reduceat(rows[self.grams[a:b]], self.at[lo:hi] - a) / self.count[lo:hi, None]
        return out


def window_starts(n: int) -> np.ndarray:
    """Every ``STEP`` words, and the last full window."""
    return np.append(np.arange(0, max(n - WINDOW, 0), STEP), max(n - WINDOW, 0))


class Batch:
    """Word numbers of some texts, and their windows as (window, word) indices; 0 is no word."""

    def __init__(self, texts: list[bytes]):
        per = [words(t) for t in texts]
        flat = [w for ws in per for w in ws]
        number = {w: i + 1 for i, w in enumerate(dict.fromkeys(flat))}
        ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        self.distinct = list(number)
        n = np.array([len(p) for p in per], np.int64)
        base = np.cumsum(n) - n
        starts = [window_starts(k) for k in n.tolist()]
        self.doc = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        begin = np.concatenate([s + b for s, b in zip(starts, base)]) if len(texts) else np.zeros(0, np.int64)
        end = (base + n)[self.doc]
        at = begin[:, None] + np.arange(WINDOW)
        ids = np.append(ids, 0)
        self.windows = np.where(at < end[:, None], ids[np.minimum(at, len(ids) - 1)], 0).astype(np.int32)


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + GRAM_DIM, HIDDEN
        draw = lambda *s: (r.normal(0, 1 / np.sqrt(s[0]), s)).astype(np.float32)
        self.p = {"word": draw(WORD_ROWS, WORD_DIM) * 0.1, "gram": draw(GRAM_ROWS, GRAM_DIM) * 0.1,
                  "Wf": draw(d, 3 * h), "Uf": draw(h, 3 * h), "bf": np.zeros(3 * h, np.float32),
                  "Wb": draw(d, 3 * h), "Ub": draw(h, 3 * h), "bb": np.zeros(3 * h, np.float32),
                  "A": draw(2 * h, ATTENTION), "v": draw(ATTENTION), "o": draw(2 * h), "c": np.zeros(1, np.float32)}

    # forward -----------------------------------------------------------------
    def vectors(self, ws: Words) -> np.ndarray:
        return np.concatenate([self.p["word"][ws.rows], ws.gram_mean(self.p["gram"])], axis=1)

    def _run(self, project: np.ndarray, U: np.ndarray, index: np.ndarray, keep: list | None) -> np.ndarray:
        """States (step, window, hidden) over ``index`` (step, window); row 0 of ``project``
        is no word and leaves the state as it was."""
        h, (steps, n) = HIDDEN, index.shape
        out, state = np.empty((steps, n, h), np.float32), np.zeros((n, h), np.float32)
        whole = bool((index > 0).all())
        for t in range(steps):
            x, u = project[index[t]], state @ U
            g = sigmoid(x[:, :2 * h] + u[:, :2 * h])
            z, r = g[:, :h], g[:, h:]
            c = np.tanh(x[:, 2 * h:] + r * u[:, 2 * h:])
            new = c + z * (state - c)
            if not whole:
                new = np.where(index[t][:, None] > 0, new, state)
            if keep is not None:
                keep.append((state, z, r, c, u[:, 2 * h:]))
            out[t] = state = new
        return out

    @staticmethod
    def _gates(m: np.ndarray) -> list[np.ndarray]:
        """The columns of each gate apart, times what ``_states`` puts into exp: -x of a sigmoid, 2 x of a tanh."""
        return [np.ascontiguousarray(m[:, i * HIDDEN:(i + 1) * HIDDEN]) * np.float32(s) for i, s in enumerate((-1, -1, 2))]

    def _states(self, project: list[np.ndarray], U: np.ndarray, index: np.ndarray) -> np.ndarray:
        """The states of ``_run`` but for rounding, for scoring: each gate apart (``project`` by ``_gates``)
        and in place, so that every pass goes over one whole array; by exp, which takes half of tanh's time."""
        h, (steps, n), Us, index = HIDDEN, index.shape, self._gates(U), index.astype(np.intp)
        out, state = np.empty((steps, n, h), np.float32), np.zeros((n, h), np.float32)
        z, r, c, x = (np.empty((n, h), np.float32) for _ in range(4))
        whole, one, two = bool((index > 0).all()), np.float32(1), np.float32(2)
        with np.errstate(over="ignore"):  # exp of a large number: the gate is 0 (or the state 1) there
            for t in range(steps):
                for i, gate in enumerate((z, r)):
                    np.take(project[i], index[t], axis=0, out=x, mode="clip")
                    np.matmul(state, Us[i], out=gate)
                    gate += x
                    np.exp(gate, out=gate)
                    gate += one
                    np.divide(one, gate, out=gate)
                np.take(project[2], index[t], axis=0, out=x, mode="clip")
                np.matmul(state, Us[2], out=c)
                c *= r
                c += x
                np.exp(c, out=c)
                c += one
                np.divide(two, c, out=c)
                np.subtract(one, c, out=c)
                new = np.subtract(state, c, out=out[t])
                new *= z
                new += c
                if not whole:
                    np.copyto(new, state, where=index[t][:, None] == 0)
                state = new
        return out

    def projections(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What the distinct words (vectors ``x``, number 1 on) send into the gates of either direction."""
        none = np.zeros((1, 3 * HIDDEN), np.float32)
        return {d: np.concatenate([none, x @ self.p["W" + d] + self.p["b" + d]]) for d in "fb"}

    def logits(self, project: dict[str, np.ndarray], windows: np.ndarray, cache: dict | None = None) -> np.ndarray:
        p, index = self.p, np.ascontiguousarray(windows.T)
        states = []
        for d, i in (("f", index), ("b", index[::-1])):
            keep = [] if cache is not None else None
            s = (self._states if isinstance(project[d], list) else partial(self._run, keep=keep))(project[d], p["U" + d], i)
            states.append(s if d == "f" else s[::-1])
            if cache is not None:
                cache["steps" + d] = keep
        both = np.concatenate(states, axis=2)
        e = np.tanh(both @ p["A"])
        a = e @ p["v"]
        a = np.where(index > 0, a, -1e9)
        a = np.exp(a - a.max(axis=0))
        a = np.where(index > 0, a, 0)
        a /= np.maximum(a.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", a, both)
        if cache is not None:
            cache.update(both=both, e=e, a=a, pooled=pooled, index=index)
        return pooled @ p["o"] + p["c"][0]

    def score(self, batch: Batch, ws: Words | None = None, block: int = 2048, apart: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Logit of every window; highest logit of every text. ``apart``: by ``_states``, else by ``_run``."""
        x = self.vectors(ws or Words(batch.distinct)) if batch.distinct else np.zeros((0, WORD_DIM + GRAM_DIM), np.float32)
        project, out = self.projections(x), np.zeros(len(batch.windows), np.float32)
        if apart:
            project = {d: self._gates(m) for d, m in project.items()}
        order = np.argsort(batch.windows[:, -1] == 0, kind="stable")  # full windows need no masks
        for i in range(0, len(order), block):
            out[order[i:i + block]] = self.logits(project, batch.windows[order[i:i + block]])
        first = np.flatnonzero(np.diff(batch.doc, prepend=-1))
        return out, np.maximum.reduceat(out, first) if len(out) else out

    # training ----------------------------------------------------------------
    def gradients(self, ws: Words, windows: np.ndarray, wanted: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, h, cache = self.p, HIDDEN, {}
        x = self.vectors(ws)
        logit = self.logits(self.projections(x), windows, cache)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d = ((sigmoid(logit) - wanted) * weight / len(wanted)).astype(np.float32)
        both, e, a, pooled, index = (cache[k] for k in ("both", "e", "a", "pooled", "index"))
        g["o"], g["c"] = pooled.T @ d, np.array([d.sum()], np.float32)
        dpooled = d[:, None] * p["o"]
        da = np.einsum("nh,tnh->tn", dpooled, both)
        ds = a * (da - (a * da).sum(axis=0))
        de = ds[:, :, None] * p["v"] * (1 - e * e)
        g["v"] = np.einsum("tn,tna->a", ds, e)
        g["A"] = np.einsum("tnh,tna->ha", both, de)
        dboth = a[:, :, None] * dpooled + de @ p["A"].T
        dx = np.zeros((len(x) + 1, x.shape[1]), np.float32)
        x0 = np.concatenate([np.zeros((1, x.shape[1]), np.float32), x])
        for name, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            i, dh = (index, dboth[:, :, part]) if name == "f" else (index[::-1], dboth[::-1, :, part])
            U, W, back = p["U" + name], p["W" + name], np.zeros((i.shape[1], h), np.float32)
            for t in range(len(i) - 1, -1, -1):
                state, z, r, c, un = cache["steps" + name][t]
                live = (i[t] > 0)[:, None]
                total = dh[t] + back
                new = np.where(live, total, 0)
                dc = new * (1 - z) * (1 - c * c)
                dz = new * (state - c) * z * (1 - z)
                dr = dc * un * r * (1 - r)
                dp = np.concatenate([dz, dr, dc], axis=1)
                du = np.concatenate([dz, dr, dc * r], axis=1)
                g["U" + name] += state.T @ du
                back = np.where(live, new * z + du @ U.T, total)
                g["b" + name] += dp.sum(axis=0)
                g["W" + name] += x0[i[t]].T @ dp
                np.add.at(dx, i[t], dp @ W.T)
        dx = dx[1:]
        np.add.at(g["word"], ws.rows, dx[:, :WORD_DIM])
        spread = np.repeat(dx[:, WORD_DIM:] / ws.count[:, None], ws.count, axis=0)
        g["gram"] = np.stack([np.bincount(ws.grams, spread[:, j], GRAM_ROWS) for j in range(GRAM_DIM)], axis=1).astype(np.float32)
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 7) -> None:
        batch, labels = Batch(texts), labels.astype(np.float32)
        toxic = labels.sum()
        if not len(texts) or toxic in (0, len(labels)):
            return
        ws = Words(batch.distinct)
        # in how many texts of either label a word, or an n-gram, occurs
        base = float(toxic / len(labels))
        seen = {"word": np.zeros((2, WORD_ROWS)), "gram": np.zeros((2, GRAM_ROWS))}
        for lo in range(0, len(texts), 100):
            a, b = np.searchsorted(batch.doc, [lo, lo + 100])
            both = np.unique(np.repeat(batch.doc[a:b], WINDOW) * (len(ws.rows) + 1) + batch.windows[a:b].ravel())
            doc, word = both // (len(ws.rows) + 1), both % (len(ws.rows) + 1) - 1
            doc, word = doc[word >= 0], word[word >= 0]
            n = ws.count[word]
            take = np.repeat(ws.at[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            for name, rows, docs, size in (("word", ws.rows[word], doc, WORD_ROWS),
                                           ("gram", ws.grams[take].astype(np.int64), np.repeat(doc, n), GRAM_ROWS)):
                once = np.unique(docs * size + rows)
                for y in (0, 1):
                    seen[name][y] += np.bincount((once % size)[labels[once // size] == y], minlength=size)
        for name, (clean, bad) in seen.items():
            self.p[name][:, 0] = np.log((bad + 20 * base) / (clean + 20 * (1 - base)) * (1 - base) / base)
        prior = np.append(np.float32(0), self.p["word"][ws.rows, 0] + ws.gram_mean(self.p["gram"][:, :1])[:, 0])
        rank = np.sort(prior[batch.windows], axis=1)[:, -3:].sum(axis=1)
        weight = np.where(labels > 0, np.sqrt(len(labels) / (2 * toxic)), 1).astype(np.float32)
        first = np.flatnonzero(np.diff(batch.doc, prepend=-1))
        ends = np.append(first[1:], len(batch.doc))
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        rng, step = np.random.default_rng(seed), 0
        for epoch in range(epochs):
            if epoch:
                rank = self.score(batch, ws, 4096, apart=False)[0]  # rounded as its gradients are
            chosen = np.array([a + int(np.argmax(rank[a:b])) for a, b in zip(first, ends)])
            for _ in range(max(2, -(-LEAST_STEPS * 64 // len(chosen)))):
                order = rng.permutation(len(chosen))
                for lo in range(0, len(order), 64):
                    docs = order[lo:lo + 64]
                    used, inverse = np.unique(batch.windows[chosen[docs]], return_inverse=True)
                    inverse = inverse.reshape(len(docs), WINDOW)
                    if used[0] == 0:
                        used = used[1:]
                    else:
                        inverse = inverse + 1
                    if not len(used):
                        continue
                    g = self.gradients(Words([batch.distinct[u - 1] for u in used]), inverse, labels[docs], weight[docs])
                    step += 1
                    now = rate * (0.5 ** (epoch / 2))
                    for k, v in g.items():
                        m, s = moment[k]
                        m *= 0.9
                        m += 0.1 * v
                        s *= 0.999
                        s += 0.001 * v * v
                        self.p[k] -= now * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-7)


def training_rows(docs: DataFrame, labels: DataFrame, max_documents: int = MAX_DOCUMENTS, max_chars: int = MAX_CHARS,
                  label_col: str = "toxic") -> DataFrame:
    """The bounded sample (text, label): of the labelled rows outside the held-out
    fold, as many of each class as ``max_documents / 2``, the first by a hash of the id.
    Only texts of up to ``max_chars`` teach; every text is scored."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    hashed = (labels.select(labels["doc_id"], labels[label_col].cast("int").alias("label"))
              .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold != 0))
              .withColumn("pick", F.xxhash64(F.col("doc_id").cast("string"))))
    chosen = None
    for y in (0, 1):
        one = hashed.filter(F.col("label") == y).orderBy("pick").limit(max_documents)
        chosen = one if chosen is None else chosen.unionByName(one)
    found = (docs.select(docs["doc_id"], docs["text"]).filter(F.char_length("text") <= max_chars)
             .join(F.broadcast(chosen), "doc_id"))  # at most 2 * max_documents rows
    one = [found.filter(F.col("label") == y).orderBy("pick", "text").limit(max_documents // 2) for y in (0, 1)]
    return one[0].unionByName(one[1]).select("text", "label", "pick")


def train(docs: DataFrame, labels: DataFrame, max_documents: int = MAX_DOCUMENTS, label_col: str = "toxic",
          epochs: int = EPOCHS) -> Network:
    """The network, fitted in one task over the bounded sample; only its weights come back."""

    def fit(batches):
        rows = [r for b in batches for r in zip(b.column(2).to_pylist(), raw(b.column(0)), b.column(1).to_pylist())]
        rows.sort()
        network = Network()
        network.fit([t for _, t, _ in rows], np.array([y for _, _, y in rows], np.int64), epochs)
        names = list(network.p)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([network.p[k].tobytes() for k in names], pa.binary())], ["name", "weights"])

    rows = training_rows(docs, labels, max_documents, label_col=label_col)
    network = Network()
    for name, weights in rows.coalesce(1).mapInArrow(fit, "name string, weights binary").collect():  # about 2 MB
        network.p[name] = np.frombuffer(bytes(weights), np.float32).reshape(network.p[name].shape).copy()
    return network


def score_documents(docs: DataFrame, network: Network, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score."""
    shared = docs.sparkSession.sparkContext.broadcast(network)  # about 2 MB, fixed by the dimensions
    docs_columns = list(docs.columns)
    at = docs_columns.index(text_col)

    def score(batches):
        net = shared.value
        for batch in batches:
            named = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part in slices(iter([named]), f"c{at}", 4 << 20):
                best = net.score(Batch(raw(part.column(at))))[1]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sigmoid(best.astype(np.float64)))],
                                                 [*docs_columns, score_col])

    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    return docs.mapInArrow(score, schema)
