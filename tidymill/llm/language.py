"""Language of documents by a bidirectional gated recurrent network over bytes.

Two recurrences read the bytes of a text (in lower case; digits, punctuation and white space too) from left and from right; at every
byte both states give probabilities of the languages. A document's probabilities are the mean over all its bytes, whole text; the
most likely language is predicted with that mean as its score (ties: the first in order of the names).

A text is read in stretches of STRETCH bytes, whatever its length. Each is read with CONTEXT bytes before and behind it, over which both states
run in and which it does not label, so stretches overlap, are independent of each other, and many are read at a time: what a task holds is bounded.

The network is trained with numpy by backpropagation through time (Adam) on stretches of a bounded sample of documents per language.

Defined results: a text that is null or has no letter gives `und` with score 0, as does every text if nothing can be learned; null languages and held-out documents
are not learned from; repeated rows are predicted each, and an id that is repeated is learned from once; an empty table gives no
rows; columns other than those named are not read.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import of_text, pick, remembered, whole_text
from .learning import bounded_sample, held_out, texts_of

UNKNOWN = "und"
#: Documents per language that the network learns from at most, and bytes of one of them.
PER_LANGUAGE, BYTES_PER_TEXT = 400, 20_000
HIDDEN, BATCH, STEPS, RATE = 10, 128, 400, 0.01
#: Bytes of a stretch to learn from; bytes that a stretch labels, and those around it; stretches that are read at a time.
LEARNED, STRETCH, CONTEXT, TOGETHER = 48, 512, 24, 256
LETTER = regex.compile(r"\p{L}")
PAD = 0


def as_bytes(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes by stretch and place, padded behind, and the lengths."""
    lengths = np.array([len(e) for e in found])
    out = np.full((len(found), lengths.max()), PAD, dtype=np.uint8)
    for i, e in enumerate(found):
        out[i, :len(e)] = np.frombuffer(e, dtype=np.uint8)
    return out, lengths


def stretches(data: bytes) -> list[tuple[bytes, int, int]]:
    """Bytes that are read together, and from where to where they are labelled."""
    found = []
    for at in range(0, len(data), STRETCH):
        low, end = max(0, at - CONTEXT), min(len(data), at + STRETCH)
        found.append((data[low:end + CONTEXT], at - low, end - low))
    return found


def opened(x, out=None):
    """A gate: a sigmoid of three straight pieces."""
    return np.clip(x * 0.25 + 0.5, 0, 1, out=out)


class Recurrence:
    """One gated recurrence over bytes: states for every place, and its gradients. Sigmoids and hyperbolic tangents are of three straight pieces."""

    def __init__(self, tables, recurrent):
        self.tables, self.recurrent = tables, recurrent      # (256, 3H) by byte, (H, 3H)

    def states(self, x, mask, keep=False):
        n, t = x.shape
        hidden, kind = self.recurrent.shape[0], self.recurrent.dtype
        h, out, kept = np.zeros((n, hidden), dtype=kind), np.empty((t, n, hidden), dtype=kind), []
        for k in range(t):
            given, back = self.tables[x[:, k]], h @ self.recurrent
            gates = opened(given[:, :2 * hidden] + back[:, :2 * hidden])
            reset, update = gates[:, :hidden], gates[:, hidden:]
            candidate = np.clip(given[:, 2 * hidden:] + reset * back[:, 2 * hidden:], -1, 1)
            step = update * mask[:, k, None]
            new = h + step * (candidate - h)
            if keep:
                kept.append((h, back, reset, update, candidate))
            h = out[k] = new
        return (out, kept) if keep else out

    def gradients(self, x, mask, kept, d_out):
        hidden = self.recurrent.shape[0]
        d_tables, d_recurrent, d_h = np.zeros_like(self.tables), np.zeros_like(self.recurrent), np.zeros_like(d_out[0])
        slope = lambda gate: 0.25 * ((gate > 0) & (gate < 1))
        for k in range(x.shape[1] - 1, -1, -1):
            h, back, reset, update, candidate = kept[k]
            d_h = d_h + d_out[k]
            m = mask[:, k, None]
            d_candidate = d_h * update * m * (np.abs(candidate) < 1)
            d_update = d_h * (candidate - h) * m * slope(update)
            d_reset = d_candidate * back[:, 2 * hidden:] * slope(reset)
            d_given = np.concatenate([d_reset, d_update, d_candidate], axis=1)
            d_back = np.concatenate([d_reset, d_update, d_candidate * reset], axis=1)
            np.add.at(d_tables, x[:, k], d_given)
            d_recurrent += h.T @ d_back
            d_h = d_h * (1 - update * m) + d_back @ self.recurrent.T
        return d_tables, d_recurrent


@dataclass
class Network:
    languages: list[str]
    weights: list[np.ndarray]       # forward tables and recurrent, backward tables and recurrent, output, bias

    def probabilities(self, found: list[bytes]) -> np.ndarray:
        """By place, stretch and language. Both recurrences run at once; places behind the end of a stretch mean nothing."""
        x, lengths = as_bytes(found)
        n, t = x.shape
        a, b, c, d, out, bias = self.weights
        hidden = b.shape[0]
        # Where each place stands when a stretch is read from its own end.
        place = np.arange(t)[:, None]
        turned = np.where(place < lengths, lengths - 1 - place, place) * n + np.arange(n)
        ahead = np.ascontiguousarray(x.T).astype(np.int64)
        codes = np.stack([ahead, ahead.ravel()[turned] + 256], axis=1)
        # The slope and middle of a gate are part of its weights.
        tables, recurrent = np.concatenate([a, c]), np.stack([b, d])
        gate_table, gate_weights = np.ascontiguousarray(tables[:, :2 * hidden]) * np.float32(0.25) + np.float32(0.5), np.ascontiguousarray(recurrent[:, :, :2 * hidden]) * np.float32(0.25)
        new_table, new_weights = np.ascontiguousarray(tables[:, 2 * hidden:]), np.ascontiguousarray(recurrent[:, :, 2 * hidden:])
        h, states = np.zeros((2, n, hidden), dtype=np.float32), np.empty((t, 2, n, hidden), dtype=np.float32)
        gates, back_gates = np.empty((2, n, 2 * hidden), dtype=np.float32), np.empty((2, n, 2 * hidden), dtype=np.float32)
        new, back_new = np.empty((2, n, hidden), dtype=np.float32), np.empty((2, n, hidden), dtype=np.float32)
        for k in range(t):
            np.take(gate_table, codes[k], axis=0, out=gates, mode="clip")
            gates += np.matmul(h, gate_weights, out=back_gates)
            np.clip(gates, 0, 1, out=gates)
            np.take(new_table, codes[k], axis=0, out=new, mode="clip")
            np.matmul(h, new_weights, out=back_new)
            back_new *= gates[:, :, :hidden]
            new += back_new
            np.clip(new, -1, 1, out=new)
            new -= h
            new *= gates[:, :, hidden:]
            h = np.add(h, new, out=states[k])
        scores = states[:, 0] @ out[:hidden]
        scores += (states[:, 1] @ out[hidden:]).reshape(t * n, -1)[turned]
        scores += bias
        np.exp(scores, out=scores)
        scores /= scores @ np.ones((scores.shape[2], 1), dtype=np.float32)
        return scores

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """For each text the sum over its bytes of the languages' probabilities."""
        parts = [(s, low, high, i) for i, text in enumerate(texts) for s, low, high in stretches(text)]
        parts.sort(key=lambda p: len(p[0]))
        out = np.zeros((len(texts), len(self.languages)))
        for at in range(0, len(parts), TOGETHER):
            chosen = parts[at:at + TOGETHER]
            p = self.probabilities([c[0] for c in chosen])
            low, high, text = (np.array([c[k] for c in chosen]) for k in (1, 2, 3))
            place = np.arange(p.shape[0])[:, None]
            labelled = ((place >= low) & (place < high)).astype(np.float32)
            np.add.at(out, text, np.einsum("tnl,tn->nl", p, labelled))
        return out

    def loss_and_gradients(self, found: list[bytes], labels: np.ndarray):
        x, lengths = as_bytes(found)
        mask = (np.arange(x.shape[1])[None, :] < lengths[:, None]).astype(np.float32)
        a, b, c, d, out, bias = self.weights
        forward, backward = Recurrence(a, b), Recurrence(c, d)
        ahead, kept_ahead = forward.states(x, mask, keep=True)
        turned = np.ascontiguousarray(x[:, ::-1]), np.ascontiguousarray(mask[:, ::-1])
        behind, kept_behind = backward.states(*turned, keep=True)
        both = np.concatenate([ahead, behind[::-1]], axis=2)
        scores = both @ out + bias
        scores -= scores.max(axis=2, keepdims=True)
        p = np.exp(scores)
        p /= p.sum(axis=2, keepdims=True)
        weight = mask.T / mask.sum()
        loss = -(np.log(np.take_along_axis(p, labels[None, :, None], axis=2)[:, :, 0] + 1e-12) * weight).sum()
        d_scores = p
        np.put_along_axis(d_scores, labels[None, :, None], np.take_along_axis(d_scores, labels[None, :, None], axis=2) - 1, axis=2)
        d_scores = (d_scores * weight[:, :, None]).astype(np.float32)
        hidden = b.shape[0]
        d_both = d_scores @ out.T
        d_out = np.einsum("tnh,tnl->hl", both, d_scores)
        return loss, [*forward.gradients(x, mask, kept_ahead, d_both[:, :, :hidden]),
                      *backward.gradients(*turned, kept_behind, d_both[::-1, :, hidden:]), d_out, d_scores.sum(axis=(0, 1))]


def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = 0) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    weights = []
    for _ in range(2):
        weights += [draw(256, 3 * hidden, scale=0.5), draw(hidden, 3 * hidden, scale=hidden ** -0.5)]
    return Network(languages, [*weights, draw(2 * hidden, len(languages), scale=hidden ** -0.5), np.zeros(len(languages), dtype=np.float32)])


def fit(rows: list[tuple[str, str]], steps: int = STEPS) -> Network | None:
    """rows: (text, language) of a bounded sample. The languages are drawn evenly, whatever their number of documents; within one, every byte alike."""
    pools: dict[str, list[bytes]] = {}
    for text, language in sorted(rows, key=lambda r: r[1]):
        if LETTER.search(text):
            pools.setdefault(language, []).append(text.lower().encode()[:BYTES_PER_TEXT])
    if not pools:
        return None
    rng = np.random.default_rng(1)
    joined = [np.frombuffer(b" ".join(texts), dtype=np.uint8) for texts in pools.values()]
    network = fresh(list(pools))
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in network.weights]
    for step in range(1, steps + 1):
        labels = np.arange(BATCH) % len(joined)
        drawn = [joined[k][(at := int(rng.integers(max(1, len(joined[k]) - LEARNED)))):at + LEARNED].tobytes() for k in labels]
        _, gradients = network.loss_and_gradients(drawn, labels)
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for w, g, (first, second) in zip(network.weights, gradients, moments, strict=True):
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            w -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return network


def languages_of(network: Network, texts: list[str]) -> list[tuple[str, float]]:
    data = [t.lower().encode() if LETTER.search(t) else b"" for t in texts]
    out = []
    for text, total in zip(data, network.sums(data), strict=True):
        best = int(total.argmax())
        out.append((network.languages[best], float(min(1.0, total[best] / len(text)))) if text else (UNKNOWN, 0.0))
    return out


def _network(languages: tuple[str, ...], weights: tuple[tuple[bytes, tuple[int, ...]], ...]) -> Network:
    return remembered(("network", languages, weights), lambda: Network(list(languages), [np.frombuffer(b, dtype=np.float32).reshape(s) for b, s in weights]))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Network | None:
    known = pick(docs, "doc_id", "text", "lang").select("doc_id", whole_text().alias("text"), F.col("lang").cast("string").alias("label"))
    learnable = known.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    return fit(texts_of(known.drop("label"), bounded_sample(learnable.select("doc_id", "label"), per_language)))


def predict(docs: DataFrame, network: Network | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, held_out, lang_pred, score."""
    packed = network and (tuple(network.languages), tuple((np.ascontiguousarray(w).tobytes(), w.shape) for w in network.weights))

    def run(texts):
        return languages_of(_network(*packed), texts) if packed else [(UNKNOWN, 0.0)] * len(texts)

    source = pick(docs, *dict.fromkeys((*keep, "doc_id", "text")))
    found = source.select(*keep, held_out(F.col("doc_id")).alias("held_out"), of_text(whole_text(), run, "lang_pred string, score double", rows=256).alias("_found"))
    return found.select(*keep, "held_out", "_found.lang_pred", "_found.score")
