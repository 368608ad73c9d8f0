"""Language of a text: a two-way gated recurrent network over bytes.

Every text is read whole, in windows of ``WINDOW`` bytes that together cover it. Both directions have states of
``STATES`` numbers; from the two states at a position the network gives that position's language
probabilities, and a text's probabilities are the mean over its positions. Gates and states use x / (1 + |x|)
for the usual curves, which numpy computes several times faster. Training is by backpropagation through time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import batch_of, col, concat, keyed_text, text_chunks

WINDOW = 96
STATES = 8
#: Byte values and one symbol for what lies behind the end of a text.
SYMBOLS, PAD = 257, 256
#: Windows that one step computes together, so that its arrays stay in cache.
TOGETHER = 1024
UNDETERMINED = "und"
OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def curve(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def slope(y: np.ndarray) -> np.ndarray:
    """Derivative of ``curve`` from its value."""
    return np.square(1 - np.abs(y))


@dataclass
class Network:
    languages: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, languages: list[str], seed: int) -> "Network":
        rng = np.random.default_rng(seed)
        shape = {"out": (2 * STATES, len(languages)), "out_bias": (len(languages),)}
        for way in "fb":
            shape |= {f"in_{way}": (SYMBOLS, 3 * STATES), f"state_{way}": (STATES, 3 * STATES)}
        return cls(languages, {k: (rng.standard_normal(s) * (0 if "bias" in k else 0.4)).astype(np.float32)
                               for k, s in shape.items()})

    def read(self, way: str, symbols: np.ndarray, keep: bool = False):
        """States after each symbol of windows (time, window); with ``keep`` also what training needs."""
        table, inner = self.weights[f"in_{way}"], self.weights[f"state_{way}"]
        n, h = STATES, np.zeros((symbols.shape[1], STATES), np.float32)
        states, kept = np.empty((*symbols.shape, n), np.float32), []
        times = range(len(symbols)) if way == "f" else range(len(symbols) - 1, -1, -1)
        for t in times:
            own = table.take(symbols[t], axis=0)
            fed = h @ inner
            gates = own[:, :2 * n] + fed[:, :2 * n]
            size = np.abs(gates)
            size += 1
            gates /= size
            gates *= 0.5
            gates += 0.5
            hold, reset = gates[:, :n], gates[:, n:]
            new = reset * fed[:, 2 * n:]
            new += own[:, 2 * n:]
            size = np.abs(new)
            size += 1
            new /= size
            if keep:
                kept.append((t, h, hold, reset, new, fed[:, 2 * n:]))
            h = h - new
            h *= hold
            h += new
            states[t] = h
        return states, kept

    def positions(self, symbols: np.ndarray) -> np.ndarray:
        """Language probabilities of every position of windows (time, window)."""
        out = self.weights["out"]
        z = self.read("f", symbols)[0] @ out[:STATES]
        z += self.read("b", symbols)[0] @ out[STATES:]
        z += self.weights["out_bias"]
        z -= z.max(axis=2, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=2, keepdims=True)
        return z

    def gradients(self, symbols: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over positions, and its gradients, by backpropagation through time."""
        w, n, g = self.weights, STATES, {k: np.zeros_like(v) for k, v in self.weights.items()}
        real = (symbols != PAD).astype(np.float32)
        both = {way: self.read(way, symbols, keep=True) for way in "fb"}
        states = np.concatenate([both["f"][0], both["b"][0]], axis=2)
        z = states @ w["out"] + w["out_bias"]
        z = np.exp(z - z.max(axis=2, keepdims=True))
        z /= z.sum(axis=2, keepdims=True)
        own = np.take_along_axis(z, np.broadcast_to(label[None, :, None], (*symbols.shape, 1)), 2)[:, :, 0]
        loss = float(-(np.log(own + 1e-9) * real).sum() / real.sum())
        z[:, np.arange(len(label)), label] -= 1
        z *= (real / real.sum())[:, :, None]
        g["out"] = states.reshape(-1, 2 * n).T @ z.reshape(-1, z.shape[2])
        g["out_bias"] = z.sum(axis=(0, 1))
        back = z @ w["out"].T
        for way, part in (("f", back[:, :, :n]), ("b", back[:, :, n:])):
            inner, carry, down = w[f"state_{way}"], np.zeros(part.shape[1:], np.float32), []
            for t, h, hold, reset, new, fed in reversed(both[way][1]):
                d = carry + part[t]
                d_new = d * (1 - hold) * slope(new)
                d_gates = np.concatenate([d * (h - new), d_new * fed], 1)
                d_gates *= 0.5 * slope(2 * np.concatenate([hold, reset], 1) - 1)
                d_fed = np.concatenate([d_gates, d_new * reset], 1)
                g[f"state_{way}"] += h.T @ d_fed
                carry = d * hold + d_fed @ inner.T
                down.append((t, np.concatenate([d_gates, d_new], 1)))
            order, deltas = zip(*down)
            np.add.at(g[f"in_{way}"], symbols[list(order)].ravel(), np.concatenate(deltas))
        return loss, g

    def train(self, windows: np.ndarray, labels: np.ndarray, steps: int = 200, together: int = 64, rate: float = 0.02,
              seed: int = 0) -> list[float]:
        """Adam over batches from shuffled rounds of the windows; returns the loss of each step."""
        rng, losses, order = np.random.default_rng(seed), [], np.zeros(0, int)
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, steps + 1):
            if len(order) < together:
                order = np.concatenate([order, rng.permutation(len(labels))])
            own, order = order[:together], order[together:]
            loss, g = self.gradients(windows[own].T, labels[own])
            losses.append(loss)
            for k, v in self.weights.items():
                mean[k] += 0.1 * (g[k] - mean[k])
                square[k] += 0.01 * (np.square(g[k]) - square[k])
                v -= rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-6)
        return losses

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over the positions of each text; zeros for an empty one."""
        data, starts = concat(texts)
        data = np.concatenate([data.astype(np.int16), np.full(WINDOW, PAD, np.int16)])
        size = np.diff(starts)
        count = -(-size // WINDOW)
        of = np.repeat(np.arange(len(texts)), count)
        begin = (np.arange(len(of)) - (np.cumsum(count) - count)[of]) * WINDOW
        shift = np.maximum(np.minimum(begin, size[of] - WINDOW), 0)  # the last window reaches back instead of over the end
        seen, stop = begin - shift, np.minimum(size[of] - shift, WINDOW)
        first, step = starts[of] + shift, np.arange(WINDOW)[:, None]
        total = np.zeros((len(texts), len(self.languages)))
        for a in range(0, len(of), TOGETHER):
            b = slice(a, a + TOGETHER)
            symbols = np.where(step < stop[None, b], data[first[None, b] + step], PAD)
            p = self.positions(symbols)
            p *= ((step >= seen[None, b]) & (step < stop[None, b]))[:, :, None]
            np.add.at(total, of[b], p.sum(axis=0))
        return total / np.maximum(size, 1)[:, None]


def sample(docs: DataFrame, lang_col: str, text_col: str, per_language: int, windows: int) -> DataFrame:
    """A bounded training sample: ``per_language`` labelled texts of each language, ``windows`` pieces of each,
    both picked by hashes of the text."""
    text = col(text_col)
    rows = docs.filter(col(lang_col).isNotNull() & text.rlike(r"\p{L}")).select(
        col(lang_col).alias("lang"), F.xxhash64(text).alias("lot"), F.array(*[
            F.substring(text, (F.pmod(F.xxhash64(text, F.lit(i)), F.greatest(F.length(text) - WINDOW + 1, F.lit(1))) + 1
                               ).cast("int"), F.lit(WINDOW)) for i in range(windows)]).alias("pieces"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("lot", "pieces")))
    return ranked.filter(F.col("rank") <= per_language).orderBy("lang", "rank").select("lang", "pieces")


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", per_language: int = 256, windows: int = 2,
        steps: int = 200, seed: int = 7) -> Network:
    """Train on a bounded sample of the labelled rows; rows without label or letters are passed over."""
    rows = sample(docs, lang_col, text_col, per_language, windows).collect()
    net = Network.new(sorted({r["lang"] for r in rows}), seed)
    pieces = [(r["lang"], p.encode()[:WINDOW]) for r in rows for p in r["pieces"] if p]
    if pieces:
        symbols = np.full((len(pieces), WINDOW), PAD, np.int16)
        for i, (_, p) in enumerate(pieces):
            symbols[i, :len(p)] = np.frombuffer(p, np.uint8)
        net.train(symbols, np.array([net.languages.index(lang) for lang, _ in pieces]), steps, seed=seed)
    return net


def identify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (the probability of that language).

    Null texts, texts without a letter, and all texts if no language was learned, get ``und`` and 0. Ties go to
    the language that sorts first. Only the text is read; equal texts get equal answers, null ids stay null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = shared.value
        for rows, texts in text_chunks(batches):
            if net.languages:
                p = net.pooled(texts)
                best, score = p.argmax(axis=1), p.max(axis=1)
            langs, scores = [], []
            for i, text in enumerate(texts):
                known = bool(net.languages) and any(map(str.isalpha, text.decode()))
                langs.append(net.languages[best[i]] if known else UNDETERMINED)
                scores.append(min(1.0, float(score[i])) if known else 0.0)
            yield batch_of(OUT, doc_id=rows.column("id"), lang_pred=langs, score=scores)

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def remainder(id_col: str, of: int) -> Column:
    """crc32 of the id's text, modulo ``of``; -1 for a null id."""
    return F.coalesce(F.crc32(col(id_col).cast("string")) % of, F.lit(-1))
