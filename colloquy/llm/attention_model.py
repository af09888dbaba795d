"""A small causal self-attention model over words spelt in subword ids, in numpy: training and scoring.

Ids of a public tokenizer are units: the commonest ids have a unit each, the others share tail units by
bands of frequency, within which an id's probability is its share of the corpus counts. A word's vector is
the sum of its ids' embeddings. One attention layer reads a window of WINDOW words and gives a state for the
word after each of the last STRIDE of them; windows overlap in the CONTEXT words before these. The state
gives the number of the next word's ids, and, with the id before, each of its ids in turn: a unit's
probability is that of its cluster times that within the cluster. So a distribution over all spellings sums to one.

Training is one pass of adaptive gradient steps (each weight's step falls with its past gradients).
"""

from __future__ import annotations

import math

import numpy as np

WINDOW, STRIDE = 48, 32
CONTEXT = WINDOW - STRIDE
CLUSTERS, IN_CLUSTER = 16, 32
UNITS = CLUSTERS * IN_CLUSTER
TAIL_UNITS = 16
#: Width of all vectors. The last number of a hidden state is always 1, so that its weights are biases.
WIDTH = 16
#: A word's vector is the sum of those of its first, second and last id, as far as it has them.
PLACES = 3
NO_ID = PLACES * UNITS
#: Numbers of ids of a word that have a probability of their own; the last one is that many or more.
SIZES = 8
#: Attention scores and output weights are cut off here, so that exponentials stay within single precision without a search for the largest.
MOST = 60.0
MOST_WEIGHT = 4.0
#: Windows of one gradient step, and of one scoring batch.
BATCH, SCORE_BATCH = 40, 192
RATE = 0.2
#: Ids of a word that are worked on together over all words of a batch; longer words' further ids go by themselves.
COMMON_IDS = 12

#: 1 where a word may be read. Masked weights are multiplied out after the exponential.
CAUSAL = (np.arange(WINDOW)[None, :] <= CONTEXT + np.arange(STRIDE)[:, None]).astype(np.float32)


class Scratch:
    """Arrays that are used again in each batch: fresh ones cost more than what is computed in them."""

    def __init__(self, kind: type = np.float32) -> None:
        self.kind = kind
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        n = math.prod(shape)
        held = self.held.get(name)
        if held is None or held.size < n:
            held = self.held[name] = np.empty(n + n // 4, self.kind)
        return held[:n].reshape(shape)


def units_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the corpus counts of all ids: unit by id, log share of its unit by id, log share by unit."""
    order = np.argsort(-counts, kind="stable")
    smooth = counts + 0.1
    unit = np.empty(len(counts), np.int32)
    own = min(UNITS - TAIL_UNITS, len(counts))
    unit[order[:own]] = np.arange(own)
    tail = order[own:]
    if len(tail):
        mass = np.cumsum(smooth[tail])
        unit[tail] = UNITS - TAIL_UNITS + np.minimum(TAIL_UNITS - 1, (mass / mass[-1] * TAIL_UNITS).astype(np.int32))
    total = np.bincount(unit, weights=smooth, minlength=UNITS)
    inside = np.log(smooth / total[unit])
    return unit, inside, np.log(np.maximum(total, 1e-3) / np.maximum(total, 1e-3).sum())


class Texts:
    """Texts one after another: units of all ids, ids a word, words a text; each text's end is its last word."""

    def __init__(self, units: np.ndarray, sizes: np.ndarray, words: np.ndarray):
        self.units, self.sizes = units, sizes
        self.starts = np.cumsum(sizes) - sizes
        self.texts = np.concatenate([[0], np.cumsum(words)])
        #: The rows of embeddings that a word is read by.
        self.read = np.full((len(sizes), PLACES), NO_ID)
        self.read[:, 0] = units[self.starts]
        two, three = np.flatnonzero(sizes > 1), np.flatnonzero(sizes > 2)
        self.read[two, 1] = units[self.starts[two] + 1] + UNITS
        self.read[three, 2] = units[self.starts[three] + sizes[three] - 1] + 2 * UNITS

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The text's first word and the window's first target, by window; every word is a target once."""
        number = -(-np.diff(self.texts) // STRIDE)
        text = np.repeat(np.arange(len(number)), number)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
        return np.stack([self.texts[text], self.texts[text] + nth * STRIDE, np.minimum(self.texts[text + 1], self.texts[text] + (nth + 1) * STRIDE)], axis=1)


def start_weights(log_share: np.ndarray, sizes: np.ndarray | None = None, seed: int = 11) -> dict[str, np.ndarray]:
    """Small random weights; the biases make the model begin as the shares of units, and of sizes, in the corpus."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[-1])).astype(np.float32)
    by = log_share.reshape(CLUSTERS, IN_CLUSTER)
    cluster = np.log(np.exp(by).sum(axis=1))
    sizes = np.ones(SIZES) if sizes is None else sizes + 1.0

    def choices(bias: np.ndarray) -> np.ndarray:
        out = 0.1 * draw(*bias.shape, WIDTH)
        out[..., -1] = bias
        return out

    embed = draw(NO_ID + 1, WIDTH)
    embed[NO_ID] = 0
    return {
        "embed": embed, "place": 0.1 * draw(WINDOW, WIDTH), "q": draw(WIDTH, WIDTH), "kv": draw(WIDTH, 2 * WIDTH), "out": draw(WIDTH, WIDTH), "stay": draw(WIDTH, WIDTH), "bias": np.zeros(WIDTH, np.float32),
        "before": draw(UNITS + 1, WIDTH), "size": choices(np.log(sizes / sizes.sum())), "cluster": choices(cluster), "unit": choices(by - cluster[:, None]),
    }


def pack(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def runs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of runs one after another, and each run's first place among them."""
    to = np.cumsum(sizes) - sizes
    return np.repeat(starts - to, sizes) + np.arange(int(sizes.sum())), to


class Batch:
    """What a batch of windows reads and predicts, as indexes."""

    def __init__(self, texts: Texts, windows: np.ndarray, end_unit: int):
        at = windows[:, 1:2] + np.arange(-CONTEXT - 1, STRIDE - 1)
        self.none = (at < windows[:, :1] - 1) | (at >= windows[:, 2:3] - 1)
        before = at == windows[:, :1] - 1  # the word before a text is an end
        word = np.clip(at, 0, len(texts.sizes) - 1)
        self.spelt = np.take(texts.read, word, axis=0)
        self.spelt[before] = end_unit, NO_ID, NO_ID
        # Targets by falling size, so that those that have an id at a place are the first ones.
        count = windows[:, 2] - windows[:, 1]
        target, row = runs(windows[:, 1], count)[0], runs(np.arange(len(windows)) * STRIDE, count)[0]
        order = np.argsort(255 - np.minimum(texts.sizes[target], 255).astype(np.uint8), kind="stable")
        self.target, self.row = target[order], row[order]
        self.size = texts.sizes[self.target]
        start = texts.starts[self.target]
        having = np.searchsorted(-self.size, -np.arange(1, COMMON_IDS + 1), side="right")
        self.having = having[having > 0]
        long = self.size > COMMON_IDS
        rest, self.rest_first = runs(start[long] + COMMON_IDS, self.size[long] - COMMON_IDS)
        self.rest_of = np.flatnonzero(long)
        self.of = np.concatenate([*(np.arange(n) for n in self.having), np.repeat(self.rest_of, self.size[long] - COMMON_IDS)])
        ids = np.concatenate([*(start[:n] + k for k, n in enumerate(self.having)), rest])
        self.unit = texts.units[ids]
        self.before = texts.units[np.maximum(ids - 1, 0)]
        self.before[: len(start)] = UNITS

    def by_word(self, rows: np.ndarray) -> np.ndarray:
        """Sums of the rows of ids by target word."""
        out = rows[: len(self.target)].copy()
        at = len(out)
        for n in self.having[1:]:
            out[:n] += rows[at : at + n]
            at += n
        if len(self.rest_of):
            out[self.rest_of] += np.add.reduceat(rows[at:], self.rest_first, axis=0)
        return out


def turned(x: np.ndarray, room: Scratch) -> np.ndarray:
    """Each window's matrix transposed, as a copy: products of many small matrices take twice as long on a view."""
    out = room("turned", len(x), x.shape[2], x.shape[1])
    out[:] = x.transpose(0, 2, 1)
    return out


def attend(w: dict, b: Batch, room: Scratch) -> dict:
    """States before the activation, (windows * STRIDE, WIDTH), and what the gradients need."""
    n = len(b.spelt)
    spelt = np.take(w["embed"], b.spelt, axis=0, out=room("spelt", n, WINDOW, PLACES, WIDTH), mode="clip")
    x = np.add(spelt[:, :, 0], spelt[:, :, 1], out=room("x", n, WINDOW, WIDTH))
    x += spelt[:, :, 2]
    x += w["place"]
    last = room("last", n, STRIDE, WIDTH)
    last[:] = x[:, CONTEXT:]
    rows = lambda a: a.reshape(-1, WIDTH)  # noqa: E731  one product of all rows, not one for each window
    q = np.matmul(rows(last), w["q"] * np.float32(WIDTH**-0.5), out=room("q", n * STRIDE, WIDTH)).reshape(last.shape)
    kv = np.matmul(rows(x), w["kv"], out=room("kv", n * WINDOW, 2 * WIDTH)).reshape(n, WINDOW, 2 * WIDTH)
    k, v = kv[..., :WIDTH], kv[..., WIDTH:]
    share = np.matmul(q, turned(k, room), out=room("share", n, STRIDE, WINDOW))
    np.minimum(share, MOST, out=share)
    np.exp(share, out=share)
    share *= CAUSAL
    some = np.flatnonzero(b.none.any(axis=1))
    share[some] *= ~b.none[some, None, :]
    total = np.matmul(share.reshape(-1, WINDOW), np.ones(WINDOW, share.dtype)).reshape(n, STRIDE, 1) + np.float32(1e-20)
    read = np.matmul(share, v, out=room("read", n, STRIDE, WIDTH))
    read /= total  # after the product, which has fewer numbers
    state = np.matmul(rows(read), w["out"], out=room("state", n * STRIDE, WIDTH))
    state += np.matmul(rows(last), w["stay"], out=room("stay", n * STRIDE, WIDTH))
    state += w["bias"]
    return {"x": x, "last": last, "q": q, "k": k, "v": v, "share": share, "total": total, "read": read, "state": state}


def picked_logs(logit: np.ndarray, picked: np.ndarray, learning: bool) -> np.ndarray:
    """Log probabilities of the picked one of each row of logits, in whose place stand the logs' gradients if learning."""
    n, width = logit.shape
    at = np.arange(0, n * width, width)
    at += picked
    flat = logit.reshape(-1)
    own = flat[at]
    np.exp(logit, out=logit)
    total = logit @ np.ones(width, logit.dtype)
    if learning:
        logit *= (-1 / total)[:, None]
        flat[at] += 1
    return own - np.log(total)


def choice(hidden: np.ndarray, weight: np.ndarray, picked: np.ndarray, grad: np.ndarray | None, room: Scratch, back: np.ndarray | None) -> np.ndarray:
    """Log probabilities of picked rows of a softmax; with grad their sum's gradients are added to it, and those of hidden written to back."""
    logit = np.matmul(hidden, weight.T, out=room("logit", len(hidden), len(weight)))
    logs = picked_logs(logit, picked, grad is not None)
    if grad is not None:
        grad += logit.T @ hidden
        np.matmul(logit, weight, out=back)
    return logs


def unit_logs(w: dict, hidden: np.ndarray, units: np.ndarray, grad: dict | None, room: Scratch) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probabilities of units after rows of hidden, as of their clusters and within these; and the gradients of hidden."""
    cluster = units // IN_CLUSTER
    order = np.argsort(cluster.astype(np.uint8), kind="stable")
    to = np.empty(len(order), np.int64)
    to[order] = np.arange(len(order))
    units = units[order]
    dealt = np.take(hidden, order, axis=0, out=room("dealt", *hidden.shape), mode="clip")
    back = None if grad is None else room("back-cluster", *hidden.shape)
    logs = choice(dealt, w["cluster"], units // IN_CLUSTER, None if grad is None else grad["cluster"], room, back)
    # All clusters' rows are worked on together but for the products.
    ends = np.cumsum(np.bincount(cluster, minlength=CLUSTERS)).tolist()
    runs_of = [(c, slice(a, b)) for c, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if a < b]
    logit = room("inner", len(order), IN_CLUSTER)
    for c, some in runs_of:
        np.matmul(dealt[some], w["unit"][c].T, out=logit[some])
    logs += picked_logs(logit, units % IN_CLUSTER, grad is not None)
    if grad is None:
        return logs[to], None
    more = room("back-unit", *hidden.shape)
    for c, some in runs_of:
        grad["unit"][c] += logit[some].T @ dealt[some]
        np.matmul(logit[some], w["unit"][c], out=more[some])
    back += more
    return logs[to], np.take(back, to, axis=0, out=more, mode="clip")


def spell(w: dict, b: Batch, state: np.ndarray, grad: dict | None, room: Scratch) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probabilities of the target words (units and number of ids), and the gradients of their states."""
    state = np.take(state, b.row, axis=0, out=room("targets", len(b.row), WIDTH), mode="clip")
    first = np.tanh(state, out=room("tanh", len(b.row), WIDTH))
    first[:, -1] = 1
    back_size = None if grad is None else room("back-size", *first.shape)
    logs_size = choice(first, w["size"], np.minimum(b.size, SIZES) - 1, None if grad is None else grad["size"], room, back_size)
    hidden = np.take(state, b.of, axis=0, out=room("hidden", len(b.of), WIDTH), mode="clip")
    hidden += np.take(w["before"], b.before, axis=0, out=room("before", len(b.of), WIDTH), mode="clip")
    np.tanh(hidden, out=hidden)
    hidden[:, -1] = 1
    logs, back = unit_logs(w, hidden, b.unit, grad, room)
    words = logs_size + b.by_word(logs)
    if grad is None:
        return words, None
    hidden *= hidden
    np.subtract(1, hidden, out=hidden)
    back *= hidden
    add_rows(grad["before"], b.before, back)
    first *= first
    back_size *= 1 - first
    back_size += b.by_word(back)
    return words, back_size


def add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray, of: np.ndarray | None = None) -> None:
    """to[at] += rows (or rows[of]), with repeated places, which are below 65,536, summed."""
    if len(at):
        order = np.argsort(at.astype(np.uint16), kind="stable")
        at = at[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        to[at[first]] += np.add.reduceat(np.take(rows, order if of is None else of[order], axis=0), first, axis=0)


def gradients(w: dict, b: Batch, room: Scratch) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log probability of a batch's target words, and its gradients."""
    grad = {name: np.zeros_like(x) for name, x in w.items()}
    a = attend(w, b, room)
    logs, back_rows = spell(w, b, a["state"], grad, room)
    n = len(b.spelt)
    flat = room("back", n * STRIDE, WIDTH)
    flat[:] = 0
    flat[b.row] = back_rows
    rows = lambda m: m.reshape(-1, WIDTH)
    share, x, last = a["share"], a["x"], a["last"]
    share /= a["total"]
    grad["bias"] += flat.sum(axis=0)
    grad["out"] += rows(a["read"]).T @ flat
    grad["stay"] += rows(last).T @ flat
    d_read = np.matmul(flat, w["out"].T, out=room("d_read", n * STRIDE, WIDTH)).reshape(n, STRIDE, WIDTH)
    d_last = np.matmul(flat, w["stay"].T, out=room("d_last", n * STRIDE, WIDTH))
    d_kv = room("d_kv", n, WINDOW, 2 * WIDTH)
    d_kv[..., WIDTH:] = np.matmul(share.transpose(0, 2, 1), d_read, out=room("d_v", n, WINDOW, WIDTH))
    d_share = np.matmul(d_read, turned(a["v"], room), out=room("d_share", n, STRIDE, WINDOW))
    # The mean of d_share by share is that of d_read by what was read.
    d_read *= a["read"]
    d_share -= d_read.sum(axis=2, keepdims=True)
    d_share *= share
    d_q = np.matmul(d_share, a["k"], out=room("d_q", n, STRIDE, WIDTH))
    d_q *= np.float32(WIDTH**-0.5)
    d_kv[..., :WIDTH] = np.matmul(d_share.transpose(0, 2, 1), a["q"], out=room("d_v", n, WINDOW, WIDTH))
    grad["q"] += rows(last).T @ rows(d_q)
    grad["kv"] += rows(x).T @ d_kv.reshape(-1, 2 * WIDTH)
    d_x = np.matmul(d_kv.reshape(-1, 2 * WIDTH), w["kv"].T, out=room("d_x", n * WINDOW, WIDTH)).reshape(n, WINDOW, WIDTH)
    d_last += np.matmul(rows(d_q), w["q"].T, out=room("d_lq", n * STRIDE, WIDTH))
    d_x[:, CONTEXT:] += d_last.reshape(n, STRIDE, WIDTH)
    d_x[b.none] = 0
    grad["place"] += d_x.sum(axis=0)
    spelt = b.spelt.ravel()
    some = np.flatnonzero(spelt != NO_ID)
    add_rows(grad["embed"], spelt[some], rows(d_x), some // PLACES)
    m = np.float32(max(1, len(logs)))
    for g in grad.values():
        g /= m
    return float(logs.mean()) if len(logs) else 0.0, grad


def step(w: dict, squares: dict, b: Batch, room: Scratch) -> float:
    """One step of gradient ascent, in place; squares: sums of past squared gradients."""
    mean, grad = gradients(w, b, room)
    for name, g in grad.items():
        s = squares[name]
        s += g * g
        g *= RATE
        g /= np.sqrt(s + np.float32(1e-10))
        w[name] += g
        if name in ("size", "cluster", "unit"):
            np.clip(w[name][..., :-1], -MOST_WEIGHT, MOST_WEIGHT, out=w[name][..., :-1])
    return mean


def score_words(w: dict, texts: Texts, end_unit: int, room: Scratch) -> np.ndarray:
    """Natural log probability of every word of the texts, ends among them; each is scored once."""
    out = np.zeros(len(texts.sizes))
    windows = texts.windows()
    for start in range(0, len(windows), SCORE_BATCH):
        b = Batch(texts, windows[start : start + SCORE_BATCH], end_unit)
        out[b.target] = spell(w, b, attend(w, b, room)["state"], None, room)[0]
    return out
