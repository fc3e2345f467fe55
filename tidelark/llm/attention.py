"""A causal self-attention model in numpy: one layer of one head over subword ids, trained by Adam."""

from __future__ import annotations

import numpy as np

from .blas import keep_memory, one_thread


def windows(n: int, length: int, context: int) -> np.ndarray:
    """Starts of the windows over n tokens. Each after the first repeats `context` tokens, whose scores it leaves out."""
    step = length - context
    return np.arange(0, max(1, 1 + -(-(n - length) // step)), dtype=np.int64) * step if n > length else np.zeros(1, np.int64)


def rows_sum(t: np.ndarray) -> np.ndarray:
    """The sums of the rows of a matrix, by a product, which is faster than a reduction of short rows."""
    return t @ np.ones(t.shape[1], t.dtype)


def exponentials(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exponentials of a matrix, made in its place where none can overflow or vanish, and the sums of its rows.

    Only from rows whose exponents would overflow or vanish the greatest is taken off, so that a row's result doesn't
    depend on the others.
    """
    top = t.max() if t.size else 0
    if top < 60 and t.size and t.min() > -40:
        np.exp(t, out=t)
        return t, rows_sum(t)
    if top > 60:
        top = t.max(-1, keepdims=True)
        t -= np.where(top > 60, top, 0)
    p = np.exp(t)
    total = rows_sum(p)
    if len(total) and total.min() < 1e-20:
        low = np.flatnonzero(total < 1e-20)
        t[low] -= t[low].max(-1, keepdims=True)
        p[low] = np.exp(t[low])
        total[low] = p[low].sum(-1)
    return p, total


def groups_of(size: int, head: int) -> list[tuple[int, int]]:
    """The ids from head on in groups, of head ids or, farther on, a quarter of those before."""
    out, a = [], head
    while a < size:
        out.append((a, min(size, a + max(head, a // 4))))
        a = out[-1][1]
    return out


class Attention:
    """P(id | the ids before it in the window): embeddings, masked attention, and a softmax over the ids.

    begin: the id that stands before the first token of a text; ids are below `size`. With `head`, ids should be less frequent
    the higher they are: those from head on are in groups, a place's softmax is over the ids below head and the groups, and that of an
    id in a group is multiplied by a softmax over the group. The product is a distribution over all ids, each of which has
    its own weights, but a group is evaluated only where one of its ids occurs.
    """

    def __init__(self, size: int, width: int = 16, length: int = 32, context: int = 8, seed: int = 7, head: int | None = None):
        r = np.random.default_rng(seed)
        self.size, self.width, self.length, self.context, self.begin = size, width, length, context, size
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {"e": (r.standard_normal((size + 1, width)) * 0.3).astype(np.float32), "p": (r.standard_normal((length, width)) * 0.05).astype(np.float32)}
        self.w |= {"q": g(width, width), "k": g(width, width), "v": g(width, width), "o": g(width, width), "u": g(width, size), "b": np.zeros(size, np.float32)}
        self.head = min(size, head or size)
        self.groups = groups_of(size, self.head)
        self.first = np.r_[np.arange(self.head), np.repeat(self.head + np.arange(len(self.groups)), [z - a for a, z in self.groups])].astype(np.int64)  # of each id, its place in the first softmax
        if self.groups:
            self.w |= {"c": g(width, len(self.groups)), "d": np.zeros(len(self.groups), np.float32)}
        self.mask = np.where(np.tril(np.ones((length, length), bool)), 0, -1e9).astype(np.float32)

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        """The product of the weights of queries and keys, scaled, and that of values and outputs: attention needs no more of them."""
        w = self.w
        return (w["q"] / np.sqrt(w["q"].dtype.type(self.width))) @ w["k"].T, w["v"] @ w["o"]

    def start_from(self, share: np.ndarray) -> None:
        """Sets the biases so that, without context, ids have these shares."""
        self.w["b"][:] = np.log(share)
        if self.groups:
            self.w["d"][:] = np.log([share[a:b].sum() for a, b in self.groups])

    def _head(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights and biases of the ids of the head and of the groups."""
        w = self.w
        if not self.groups:
            return w["u"], w["b"]
        return np.concatenate([w["u"][:, : self.head], w["c"]], 1), np.concatenate([w["b"][: self.head], w["d"]])

    def _places(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
        """An order of the rows by groups, those of the head first; the place of each id, in this order, in the first softmax; and the groups that have rows: their ids, and where their rows begin and end in this order."""
        first = self.first.take(y)
        if not self.groups:
            return np.arange(len(y)), first, []
        group = np.maximum(first, self.head - 1).astype(np.uint16)
        ends = np.cumsum(np.bincount(group, minlength=self.head + len(self.groups))).tolist()[self.head - 1 :]
        order = np.argsort(group, kind="stable")
        return order, first.take(order), [(*g, i, j) for g, i, j in zip(self.groups, ends, ends[1:]) if j > i]

    def log_probabilities(self, x: np.ndarray, y: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
        """Natural log-probabilities of y after the inputs x, both windows x places; of the marked places alone, in their order, if these are given.

        Most windows leave out their first `context` places, whose attention is then not evaluated.
        """
        w, n, c = self.w, x.shape[1], min(self.context, x.shape[1])
        h = w["e"].take(x.ravel(), 0).reshape(*x.shape, self.width)
        h += w["p"][:n]
        qk, vo = self._merged()
        begun = np.arange(len(x)) if places is None else np.flatnonzero(places[:, :c].any(1))
        z = h.copy()
        for rows, low, high in ((slice(None), c, n), (begun, 0, c)):
            if high > low and (rows is not begun or len(begun)):
                own, keys = h[rows, low:high], h[rows, :high]
                a = (own.reshape(-1, self.width) @ qk).reshape(own.shape) @ keys.transpose(0, 2, 1)
                a += self.mask[low:high, :high]
                p, total = exponentials(a.reshape(-1, high))
                m = (p.reshape(a.shape) @ keys).reshape(-1, self.width)
                m /= total[:, None]
                z[rows, low:high] += (m @ vo).reshape(own.shape)
        z, shape, y = z.reshape(-1, self.width), x.shape, y.ravel()
        if places is not None:
            at = np.flatnonzero(places)
            z, y, shape = z.take(at, 0), y.take(at), at.shape
        u, b = self._head()
        order, first, some = self._places(y)
        z, y, out = z.take(order, 0), y.take(order), np.empty(len(y), z.dtype)
        found = self._log_softmax(z, u, b, first)
        for low, high, i, j in some:
            found[i:j] += self._log_softmax(z[i:j], w["u"][:, low:high], w["b"][low:high], y[i:j] - low)
        out[order] = found
        return out.reshape(shape)

    @staticmethod
    def _log_softmax(z: np.ndarray, u: np.ndarray, b: np.ndarray, y: np.ndarray) -> np.ndarray:
        t = z @ u
        t += b
        at = np.arange(0, t.size, t.shape[1]) + y
        own = t.ravel().take(at)
        p, total = exponentials(t)
        if p is not t:  # rows may have lost their greatest
            own = t.ravel().take(at)
        return own - np.log(total)

    def train(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray, passes: int = 1, batch: int = 64, rate: float = 0.01, least: float = 0.0, seed: int = 11) -> None:
        """Adam, each pass over all windows in another order; the rate falls from `rate` to `least` on the way. A step moves the embeddings of its windows' ids, and no group above those they hold."""
        r = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.w.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        order = np.concatenate([r.permutation(len(x)) for _ in range(passes)])
        steps = -(-len(order) // batch)
        keep_memory()
        with one_thread():
            for t in range(1, steps + 1):
                i = order[(t - 1) * batch : t * batch]
                lr = min(1, t / 20) * (least + (rate - least) * (0.5 + 0.5 * np.cos(np.pi * t / steps)))
                far = np.sqrt(1 - 0.99**t)
                for k, at, d in self._parts(x[i], y[i], valid[i]):
                    a, b = m1[k][at], m2[k][at]
                    a *= 0.9
                    a += 0.1 * d
                    d *= d
                    d *= 0.01
                    b *= 0.99
                    b += d
                    m1[k][at], m2[k][at] = a, b
                    b = np.sqrt(b)
                    b += 1e-8 * far
                    np.divide(a, b, out=b)
                    b *= lr * far / (1 - 0.9**t)
                    self.w[k][at] -= b

    def _gradients(self, x, y, valid) -> dict[str, np.ndarray]:
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        for k, at, d in self._parts(x, y, valid):
            g[k][at] += d
        return g

    def _parts(self, x, y, valid) -> list[tuple]:
        """(name, where, gradient) of all weights that the windows move, each place of a weight once."""
        w, n, width = self.w, x.shape[1], self.width
        own = np.argsort(x.ravel().astype(np.uint16 if self.size < 1 << 16 else np.int64), kind="stable")
        h = w["e"].take(x.ravel(), 0).reshape(*x.shape, width)
        h += w["p"][:n]
        flat = h.reshape(-1, width)
        qk, vo = self._merged()
        hq = (flat @ qk).reshape(h.shape)
        a = hq @ h.transpose(0, 2, 1)
        a += self.mask[:n, :n]
        a, total = exponentials(a.reshape(-1, n))
        a, total = a.reshape(*x.shape, n), total[:, None]
        m = (a @ h).reshape(-1, width)
        m /= total
        z = m @ vo
        z += flat
        y, weight, out = y.ravel(), (valid.ravel() / max(1, valid.sum())).astype(valid.dtype), []

        def errors(z, u, b, y, weight):
            d = z @ u
            d += b
            d, total = exponentials(d)
            d *= (weight / total)[:, None]
            d.ravel()[np.arange(0, d.size, d.shape[1]) + y] -= weight
            return d

        (u, b), (order, first, some) = self._head(), self._places(y)
        z, y, weight, ones = z.take(order, 0), y.take(order), weight.take(order), np.ones(len(y), z.dtype)
        d = errors(z, u, b, first, weight)
        dzs, gu, gb, head = d @ u.T, z.T @ d, ones @ d, self.head
        if self.groups:
            out += [("c", slice(None), gu[:, head:]), ("d", slice(None), gb[head:])]
            top = some[-1][1] if some else head
            gu, gb = (np.concatenate([t[..., :head], np.zeros((*t.shape[:-1], top - head), t.dtype)], -1) for t in (gu, gb))
            for low, high, i, j in some:
                u = w["u"][:, low:high]
                d = errors(z[i:j], u, w["b"][low:high], y[i:j] - low, weight[i:j])
                dzs[i:j] += d @ u.T
                gu[:, low:high], gb[low:high] = z[i:j].T @ d, ones[i:j] @ d
        dz = np.empty_like(dzs)
        dz[order] = dzs
        out += [("u", (slice(None), slice(0, gu.shape[1])), gu), ("b", slice(0, gu.shape[1]), gb)]
        dm = dz @ vo.T
        dm /= total
        gvo, less = m.T @ dz, rows_sum(dm * m)
        dm = dm.reshape(h.shape)
        ds = dm @ h.transpose(0, 2, 1)
        ds -= less.reshape(*x.shape, 1)
        ds *= a
        dhq = (ds @ h).reshape(-1, width)
        gqk = flat.T @ dhq
        scale = qk.dtype.type(1 / np.sqrt(width))
        out += [("q", slice(None), gqk @ w["k"] * scale), ("k", slice(None), gqk.T @ w["q"] * scale), ("v", slice(None), gvo @ w["o"].T), ("o", slice(None), w["v"].T @ gvo)]
        dh = a.transpose(0, 2, 1) @ dm
        dh += ds.transpose(0, 2, 1) @ hq
        dhf = dh.reshape(-1, width)
        dhf += dz
        dhf += dhq @ qk.T
        ids = x.ravel().take(own)
        begin = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        out += [("e", ids[begin], np.add.reduceat(dhf.take(own, 0), begin, 0)), ("p", slice(0, n), dh.sum(0))]
        return out

    def cut(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows over texts whose ids stand one after the other: inputs, targets, which places to score, and the text of each window.

        ends: where each text ends in ids. Every token is scored in one window.
        """
        sizes = np.diff(np.r_[0, ends])
        per = [windows(int(n), self.length, self.context) for n in sizes]
        text = np.repeat(np.arange(len(sizes)), [len(p) for p in per])
        start = np.concatenate(per) if per else np.empty(0, np.int64)
        place = start[:, None] + np.arange(self.length)  # of the target in its text
        inside = place < sizes[text][:, None]
        score = inside & ((np.arange(self.length) >= self.context) | (start == 0)[:, None])
        at = np.minimum(place, sizes[text][:, None] - 1) + (ends - sizes)[text][:, None]
        y = ids[at]
        x = np.where(place == 0, self.begin, ids[np.maximum(at - 1, 0)])
        return x, y, score, text

    def blocks(self, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows to train on: inputs, targets, and which places count. A piece is a stretch of ids after the one that stands before it; each id is a target once."""
        sizes = np.array([len(p) - 1 for p in pieces])
        every, per = np.concatenate(pieces), -(-sizes // self.length)
        piece = np.repeat(np.arange(len(pieces)), per)
        start = (np.arange(len(piece)) - np.repeat(np.cumsum(per) - per, per)) * self.length
        place = start[:, None] + np.arange(self.length)
        at = np.minimum(place, sizes[piece][:, None] - 1) + (np.cumsum(sizes + 1) - sizes - 1)[piece][:, None]
        return every[at], every[at + 1], (place < sizes[piece][:, None]).astype(np.float32)

    def scores(self, ids: np.ndarray, ends: np.ndarray, block: int = 256) -> np.ndarray:
        """The natural log-probability of every token, in the order of ids."""
        x, y, score, _ = self.cut(ids, ends)
        keep_memory()
        with one_thread():
            out = [self.log_probabilities(x[i : i + block], y[i : i + block], score[i : i + block]) for i in range(0, len(x), block)]
        return np.concatenate(out) if out else np.empty(0)
