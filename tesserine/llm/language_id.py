"""Operator 10: language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded
sample, labels every byte position of every text, and pools the positions'
probabilities into the document's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import packed

UNDETERMINED = "und"


@dataclass
class Network:
    """Two gated recurrent layers (one per direction) of ``size`` units and a shared output layer.

    ``weights``: for each direction the inputs' table (256, 3 size), whose rows are
    the bytes' contributions to update gate, reset gate and candidate, and the
    recurrent matrix (size, 3 size); then the output matrix and bias.
    """

    labels: list[str]
    size: int
    weights: list[np.ndarray]

    @staticmethod
    def new(labels: list[str], size: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        shapes = [(256, 3 * size), (size, 3 * size), (256, 3 * size), (size, 3 * size), (2 * size, len(labels)), (len(labels),)]
        scales = [0.3, size**-0.5, 0.3, size**-0.5, (2 * size) ** -0.5, 0.0]
        return Network(labels, size, [(rng.standard_normal(s) * k).astype(np.float32) for s, k in zip(shapes, scales, strict=True)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Through tanh, which numpy vectorises."""
    x = np.tanh(x * np.float32(0.5))
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


def _layer(codes: np.ndarray, table: np.ndarray, loop: np.ndarray, keep: list | None = None) -> list[np.ndarray]:
    """States of one direction over ``codes`` (steps, rows); ``keep`` collects what the backward pass needs."""
    size = loop.shape[0]
    state = np.zeros((codes.shape[1], size), np.float32)
    out = []
    for step in codes:
        given, turned = table[step], state @ loop
        gates = _sigmoid(given[:, : 2 * size] + turned[:, : 2 * size])
        update, reset = gates[:, :size], gates[:, size:]
        candidate = np.tanh(given[:, 2 * size :] + reset * turned[:, 2 * size :])
        if keep is not None:
            keep.append((step, state, update, reset, candidate, turned[:, 2 * size :]))
        state = candidate + update * (state - candidate)
        out.append(state)
    return out


def _through_time(kept: list, up: list[np.ndarray], loop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of a direction's table and recurrent matrix from the states' gradients."""
    size = loop.shape[0]
    table_grad, loop_grad = np.zeros((256, 3 * size), np.float32), np.zeros_like(loop)
    later = np.zeros_like(up[0])
    for (step, state, update, reset, candidate, turned), here in zip(reversed(kept), reversed(up), strict=True):
        grad = here + later
        d_cand = grad * (1 - update) * (1 - candidate**2)
        d_update = grad * (state - candidate) * update * (1 - update)
        d_reset = d_cand * turned * reset * (1 - reset)
        given = np.concatenate([d_update, d_reset, d_cand], axis=1)
        inner = np.concatenate([d_update, d_reset, d_cand * reset], axis=1)
        np.add.at(table_grad, step, given)
        loop_grad += state.T @ inner
        later = grad * update + inner @ loop.T
    return table_grad, loop_grad


def gradients(net: Network, codes: np.ndarray, gold: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of all positions, and the gradients of all weights."""
    table_f, loop_f, table_b, loop_b, matrix, bias = net.weights
    kept_f, kept_b = [], []
    ahead = _layer(codes, table_f, loop_f, kept_f)
    back = _layer(codes[::-1], table_b, loop_b, kept_b)[::-1]
    both = np.concatenate([np.stack(ahead), np.stack(back)], axis=2)
    logits = both @ matrix + bias
    logits -= logits.max(axis=2, keepdims=True)
    chance = np.exp(logits)
    chance /= chance.sum(axis=2, keepdims=True)
    rows = np.arange(codes.shape[1])
    loss = -np.log(np.maximum(chance[:, rows, gold], 1e-12)).mean()
    grad = chance
    grad[:, rows, gold] -= 1
    grad /= codes.size
    flat = grad.reshape(-1, grad.shape[2])
    d_both = grad @ matrix.T
    g_tf, g_lf = _through_time(kept_f, list(d_both[:, :, : net.size]), loop_f)
    g_tb, g_lb = _through_time(kept_b, list(d_both[::-1, :, net.size :]), loop_b)
    return float(loss), [g_tf, g_lf, g_tb, g_lb, both.reshape(-1, both.shape[2]).T @ flat, flat.sum(0)]


def train(texts: list[bytes], gold: list[str], size: int = 8, steps: int = 220, window: int = 48, rows: int = 128, rate: float = 0.03, seed: int = 11) -> Network:
    """Adam on random windows of the sampled texts; labels are drawn evenly."""
    labels = sorted(set(gold))
    net = Network.new(labels, size, seed)
    rng = np.random.default_rng(seed)
    by_label = [[np.frombuffer(t, np.uint8) for t, g in zip(texts, gold, strict=True) if g == label and t] for label in labels]
    drawn = [k for k, own in enumerate(by_label) if own]
    first, second = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    for step in range(1, steps + 1 if len(labels) > 1 and drawn else 1):
        classes = rng.choice(drawn, rows)
        codes = np.empty((window, rows), np.uint8)
        for r, k in enumerate(classes):
            text = by_label[k][rng.integers(len(by_label[k]))]
            at = rng.integers(max(len(text) - window, 0) + 1)
            codes[:, r] = np.resize(text[at : at + window], window)  # a short text repeats
        _, grads = gradients(net, codes, classes)
        speed = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(net.weights, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _states(codes: np.ndarray, table: np.ndarray, loop: np.ndarray) -> np.ndarray:
    """The states of :func:`_layer` as (steps, rows, size), with the sigmoids' halves folded into the weights and all work in place."""
    size = loop.shape[0]
    half = np.float32(0.5)
    u_in, r_in, c_in = (np.ascontiguousarray(table[:, k * size : (k + 1) * size]) for k in range(3))
    u_loop, r_loop, c_loop = (np.ascontiguousarray(loop[:, k * size : (k + 1) * size]) * half for k in range(3))
    u_in, r_in = u_in * half, r_in * half
    rows = codes.shape[1]
    out = np.empty((len(codes), rows, size), np.float32)
    state = np.zeros((rows, size), np.float32)
    update, reset, turned, given = (np.empty((rows, size), np.float32) for _ in range(4))
    for t, step in enumerate(codes):
        np.matmul(state, u_loop, out=update)
        update += np.take(u_in, step, axis=0, out=given, mode="clip")
        np.tanh(update, out=update)
        np.matmul(state, r_loop, out=reset)
        reset += np.take(r_in, step, axis=0, out=given, mode="clip")
        np.tanh(reset, out=reset)
        reset += 1
        reset *= np.matmul(state, c_loop, out=turned)
        reset += np.take(c_in, step, axis=0, out=given, mode="clip")
        candidate = np.tanh(reset, out=reset)
        update += 1
        update *= half
        np.subtract(state, candidate, out=turned)
        turned *= update
        state = np.add(candidate, turned, out=out[t])
    return out


def position_chances(net: Network, codes: np.ndarray, turned: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Label probabilities of every position, (steps, rows, labels).

    ``codes`` and ``turned`` (steps, rows) hold each row's bytes forwards and
    backwards from its first step on; what follows a row's ``sizes`` is padding, which
    neither direction reads before the row's own bytes.
    """
    table_f, loop_f, table_b, loop_b, matrix, bias = net.weights
    out = _states(codes.astype(np.intp), table_f, loop_f) @ matrix[: net.size]
    back = _states(turned.astype(np.intp), table_b, loop_b) @ matrix[net.size :]
    place = np.maximum(sizes[None, :] - 1 - np.arange(len(codes))[:, None], 0)
    out += back[place, np.arange(codes.shape[1])[None, :]]
    out += bias
    out -= out.max(axis=2, keepdims=True)
    np.exp(out, out=out)
    out /= out.sum(axis=2, keepdims=True)
    return out


def document_chances(net: Network, data: np.ndarray, offsets: np.ndarray, segment: int = 128, block: int = 2048) -> np.ndarray:
    """Mean of the positions' probabilities of every row; whole texts, in segments that run side by side.

    The network starts anew in each segment, as it did in training, whose windows
    are shorter still; so a text costs its length and not its longest chain of steps.

    Segments of one row may differ by one byte in length, so none is much shorter
    than the others.  Shorter ones are padded at the end of either direction's run, so a
    row's result depends on no other row, and the padding is left out.
    """
    sizes = np.diff(offsets)
    pieces = -(-sizes // segment)
    row, place = packed.within(pieces)
    starts = offsets[:-1][row] + place * sizes[row] // np.maximum(pieces[row], 1)
    ends = offsets[:-1][row] + (place + 1) * sizes[row] // np.maximum(pieces[row], 1)
    totals = np.zeros((len(sizes), len(net.labels)))
    order = np.argsort(ends - starts, kind="stable")
    for at in range(0, len(order), block):
        own = order[at : at + block]
        size = ends[own] - starts[own]
        steps = int(size.max())
        step = np.arange(steps)[:, None]
        live = step < size[None, :]
        ahead = data[np.where(live, starts[own][None, :] + step, starts[own][None, :])]
        behind = data[np.where(live, ends[own][None, :] - 1 - step, starts[own][None, :])]
        chances = position_chances(net, ahead, behind, size)
        chances *= live[:, :, None]
        np.add.at(totals, row[own], chances.sum(axis=0))
    return totals / np.maximum(sizes, 1)[:, None]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_label: int = 400, sample_chars: int = 160, **options) -> Network | None:
    """Train on at most ``sample_per_label`` texts of each label, one piece of ``sample_chars`` each, both chosen by hash.

    The rows are those given; the caller leaves held-out rows away.  Rows with a
    null text or label are not learned from.  None if there is no row to learn from.
    """
    usable = docs.filter(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    key = F.xxhash64(F.col("_id").cast("string"), F.lit("sample"))
    chosen = _first_of_each(usable.select("_id", "_lang", key.alias("_key")), sample_per_label)
    at = F.lit(1) + F.pmod(key, F.greatest(F.length("_text") - sample_chars, F.lit(1))).cast("int")
    rows = usable.join(F.broadcast(chosen), ["_id", "_lang"]).select("_id", "_lang", F.substring("_text", at, F.lit(sample_chars)).alias("_piece"))
    pieces = rows.orderBy("_lang", "_id", "_piece").collect()
    return train([r["_piece"].encode() for r in pieces], [r["_lang"] for r in pieces], **options) if pieces else None


def _first_of_each(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` ids of each label by key: bounded before the shuffle by the window's group limit."""
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_key", "_id"))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).select("_id", "_lang").distinct()


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` (the pooled probability of that label) for every row.

    A null text, or one without any letter, is ``und`` with score 0; so is every
    row if nothing was learned.  Repeated rows give repeated results; other columns
    are ignored.  Work is per row, without a shuffle; the network is a few
    kilobytes in the tasks' closure.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in packed.slices(batch.column(1), 250_000):
                part = batch.slice(at, to - at)
                data, offsets = packed.buffers(part.column(1))
                chances = document_chances(net, data, offsets)
                best = chances.argmax(axis=1)
                score = chances[np.arange(len(best)), best]
                letters = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                labels = pa.array(np.where(letters, np.array(net.labels, dtype=object)[best], UNDETERMINED), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), labels, pa.array(np.where(letters, np.clip(score, 0, 1), 0.0), pa.float64())], ["_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    if net is None:
        return docs.select(F.col(id_col), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), lettered.alias("_lettered"))
    return rows.mapInArrow(run, f"_id {kind}, lang_pred string, score double").withColumnRenamed("_id", id_col)


def fold(id_col: str, parts: int) -> Column:
    """Remainder of the crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 3, held_out: int = 1, **options) -> DataFrame:
    """Learn from the rows whose fold is not ``held_out``, predict all: ``id_col, held_out, lang_pred, score``."""
    net = learn(docs.filter(fold(id_col, parts) != held_out), id_col, text_col, lang_col, **options)
    out = predict(docs, net, id_col, text_col)
    return out.select(id_col, (fold(id_col, parts) == held_out).alias("held_out"), "lang_pred", "score")
