"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, and scoring in lanes.

Words are numbers below the vocabulary's size; the end of a text is one of them and also what precedes its first word. A word's
probability is its class's, by a softmax over classes, times its own in the class, by a softmax over that class. A text's state starts at zero and is carried from
window to window to its end, so its score is the log-likelihood of the whole text.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np

HIDDEN = 32


def classes_of(counts: np.ndarray, n: int) -> np.ndarray:
    """The class of each word, words sorted by falling count: about equal shares of the square roots of counts."""
    share = np.sqrt(np.maximum(counts, 1).astype(float))
    c = np.minimum((np.cumsum(share) - share) / share.sum() * n, n - 1).astype(np.int64)
    return np.unique(c, return_inverse=True)[1]


def lanes(lengths: np.ndarray, n: int) -> list[list[int]]:
    """Texts dealt to n lanes, longest first, always to the shortest lane; lanes by falling length."""
    out, heap = [[] for _ in range(n)], [(0, k) for k in range(n)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        total, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (total + int(lengths[i]), k))
    return [out[k] for _, k in sorted(heap, key=lambda x: (-x[0], x[1])) if out[k]]


def windows(texts: list[np.ndarray], n_lanes: int, size: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word before, word, text) for each step and lane of each window; text -1: none. A lane's texts follow one another.

    Lanes that are over come last and are left out, so a long text alone costs no more than its own steps.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    dealt = lanes(lengths, min(n_lanes, max(1, len(texts))))
    flat = [np.concatenate([texts[i] for i in lane]).astype(np.int32) for lane in dealt]
    owner = [np.repeat(np.array(lane, np.int32), lengths[lane]) for lane in dealt]
    first = [np.cumsum(lengths[lane]) - lengths[lane] for lane in dealt]
    before = [np.concatenate([[end], x[:-1]]).astype(np.int32) for x in flat]
    for x, at in zip(before, first, strict=True):
        x[at] = end  # every text has its end at least
    active, piece = len(flat), 16 * size  # several windows are laid out at once
    for a in range(0, len(flat[0]), piece):
        while len(flat[active - 1]) <= a:
            active -= 1
        w, p, d = np.zeros((active, piece), np.int32), np.zeros((active, piece), np.int32), np.full((active, piece), -1, np.int32)
        for k in range(active):
            n = len(flat[k][a : a + piece])
            w[k, :n], p[k, :n], d[k, :n] = flat[k][a : a + n], before[k][a : a + n], owner[k][a : a + n]
        for b in range(0, min(piece, len(flat[0]) - a), size):
            while len(flat[active - 1]) <= a + b:
                active -= 1
            yield tuple(np.ascontiguousarray(x[:active, b : b + size].T) for x in (p, w, d))


def _wide(h: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """States (..., hidden) as rows with a 1 at the end, so that biases are one more row of weights."""
    out = np.empty((*h.shape[:-1], h.shape[-1] + 1), h.dtype) if out is None else out
    out[..., :-1], out[..., -1] = h, 1
    return out.reshape(-1, h.shape[-1] + 1)


def _going(text: np.ndarray, last: np.ndarray | None) -> np.ndarray:
    """0 where a text begins in a window, else 1; last: the texts of the step before."""
    out = np.empty(text.shape, np.float32)
    np.equal(text[1:], text[:-1], out=out[1:], casting="unsafe")
    out[0] = 0 if last is None else text[0] == last[: text.shape[1]]
    return out


class _Room:
    """What the way back needs of windows of the same shape: arrays of steps x windows x values x lanes, each step's values of a window in one piece.

    Values lie in rows and lanes in columns, so that parts of a step, such as its gates, are whole rows.
    """

    def __init__(self, steps: int, most: int, lanes: int, dtype: np.dtype):
        n = HIDDEN
        self.before, self.new, self.out, self.by_out = (np.empty((steps, most, n, lanes), dtype) for _ in range(4))
        self.part, self.gates = np.empty((steps, most, 3 * n, lanes), dtype), np.empty((steps, most, 2 * n, lanes), dtype)
        self.by_sums = np.empty((steps, most, 4 * n, lanes), dtype)  # gradients: of the recurrent part of the new value, of z, of r, and of the new value's sum
        self.most, self.windows = most, []

    def views(self, k: int) -> list[tuple[np.ndarray, ...]]:
        """For each step of window k: states before, the recurrent part and its parts for gates and new values, gates, z, r, new values."""
        n, part, gates = HIDDEN, self.part[:, k], self.gates[:, k]
        return list(zip(self.before[:, k], part, part[:, : 2 * n], part[:, 2 * n :], gates, gates[:, :n], gates[:, n:], self.new[:, k], strict=True))


class Gru:
    """Parameters by name in ``p``; ``cls`` is each word's class."""

    def __init__(self, counts: np.ndarray, n_classes: int, end: int, seed: int = 0):
        """counts: of each word, falling; they set the biases, so the model starts as the unigram model of the whole corpus."""
        rng, h, v = np.random.default_rng(seed), HIDDEN, len(counts)
        self.end, self.cls = end, classes_of(counts, n_classes)
        self.n_classes = int(self.cls.max()) + 1
        mass = np.maximum(counts, 0.5).astype(float)
        per = np.bincount(self.cls, mass)
        g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {
            "embed": (rng.standard_normal((v, h)) * 0.3).astype(np.float32), "wx": g(h, 3 * h), "bx": np.zeros(3 * h, np.float32), "u": g(h, 3 * h),
            "wc": np.zeros((h, self.n_classes), np.float32), "bc": np.log(per / per.sum()).astype(np.float32),
            "ww": np.zeros((v, h), np.float32), "bw": np.log(mass / per[self.cls]).astype(np.float32),
        }
        self._group()
        self.spaces: dict[str, np.ndarray] = {}

    def _space(self, name: str, *shape: int) -> np.ndarray:
        """An array for passing values, whose memory serves every step: new memory costs more than what is done in it."""
        n, dtype, have = math.prod(shape), self.p["u"].dtype, self.spaces.get(name)
        if have is None or have.size < n or have.dtype != dtype:
            have = self.spaces[name] = np.empty(n, dtype)
        return have[:n].reshape(shape)

    def _group(self) -> None:
        """first[c]:first[c + 1] are the words of class c."""
        self.first = np.searchsorted(self.cls, np.arange(self.n_classes + 1))
        self.width = np.diff(self.first)

    def vector(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def load(self, x: np.ndarray) -> None:
        self.p = self._views(x.astype(np.float32))

    def _views(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Parts of a vector as parameters."""
        out, at = {}, 0
        for k in sorted(self.p):
            n = self.p[k].size
            out[k] = x[at : at + n].reshape(self.p[k].shape)
            at += n
        return out

    def _weights(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For ``_steps``: embeddings with a 1 at the end, input weights with biases, and recurrent weights; those of gates are halved."""
        half = np.repeat(np.array([0.5, 0.5, 1], self.p["u"].dtype), HIDDEN)
        return _wide(self.p["embed"]), (np.vstack([self.p["wx"], self.p["bx"]]) * half).T, np.ascontiguousarray((self.p["u"] * half).T)

    def _steps(self, weights: tuple, embedded: np.ndarray, going: np.ndarray, h: np.ndarray, views: list, out: np.ndarray) -> np.ndarray:
        """States after each step of a window into ``out`` (steps x hidden x lanes); the last ones are returned.

        embedded: of the words before, steps x lanes; going: 0 where a text begins, else 1; views: of a room, each step's.
        """
        n, half, (_, wx, u) = HIDDEN, weights[0].dtype.type(0.5), weights
        x = np.empty((3 * n, embedded.shape[1]), embedded.dtype)
        xg, xv = x[: 2 * n], x[2 * n :]
        for e, k, (before, part, pg, pv, gates, z, r, v), after in zip(embedded.transpose(0, 2, 1), going, views, out, strict=True):
            np.matmul(wx, e, out=x)
            np.multiply(h, k, out=before)
            np.matmul(u, before, out=part)
            np.add(xg, pg, out=gates)
            np.tanh(gates, out=gates)  # 1 / (1 + exp(-x)) is (1 + tanh(x / 2)) / 2
            np.multiply(gates, half, out=gates)
            np.add(gates, half, out=gates)
            np.multiply(r, pv, out=v)
            np.add(v, xv, out=v)
            np.tanh(v, out=v)
            np.subtract(before, v, out=after)
            np.multiply(after, z, out=after)
            h = np.add(after, v, out=after)
        return h

    def _bounded(self) -> bool:
        """Whether sums of exponentials stay far from overflow and underflow, as states lie in -1..1."""
        p = self.p
        return max(float((np.abs(p["wc"]).sum(axis=0) + np.abs(p["bc"])).max()), float((np.abs(p["ww"]).sum(axis=1) + np.abs(p["bw"])).max())) < 40

    def _log_probs(self, h: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        return self._logs(_wide(h), words)

    def _logs(self, rows: np.ndarray, words: np.ndarray, grads: dict | None = None, bounded: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural logs of the words' probabilities after states (``rows``: as by ``_wide``), and the gradient of their negative mean by states.

        Softmaxes are left undivided: a row's division is that of its state or gradient, which is shorter.
        """
        p, n, d, cls = self.p, len(words), HIDDEN, self.cls.take(words)
        wc, out, dh = np.vstack([p["wc"], p["bc"]]), np.empty(n, rows.dtype), None
        ones = np.ones(max(self.n_classes, int(self.width.max())), rows.dtype)
        if grads is not None:
            dh, wct, gc = self._space("dh", n, d), np.ascontiguousarray(p["wc"].T), np.zeros_like(wc)
        block, starts = self._space("block", min(n, 1024), self.n_classes), np.arange(min(n, 1024)) * self.n_classes
        for lo in range(0, n, 1024):  # on what fits the cache
            x = rows[lo : lo + 1024]
            a, few = block[: len(x)], (-1, 128) if len(x) % 128 == 0 else (1, len(x))  # products of few rows are fast
            np.matmul(x.reshape(*few, d + 1), wc, out=a.reshape(*few, self.n_classes))
            if not bounded:
                a -= a.max(axis=1, keepdims=True)
            flat, at = a.reshape(-1), starts[: len(x)] + cls[lo : lo + 1024]
            mine = flat.take(at)
            np.exp(a, out=a)
            total = a @ ones[: self.n_classes]
            np.subtract(mine, np.log(total), out=out[lo : lo + 1024])
            if grads is not None:
                flat[at] -= total
                share = (1 / (total * n))[:, None]
                gc += np.matmul((x * share).reshape(*few, d + 1).transpose(0, 2, 1), a.reshape(*few, self.n_classes)).sum(axis=0)
                dx = dh[lo : lo + 1024]
                np.matmul(a.reshape(*few, self.n_classes), wct, out=dx.reshape(*few, d))
                dx *= share
        if grads is not None:
            grads["wc"] += gc[:-1]
            grads["bc"] += gc[-1]
        # words of classes of several words, by class; the classes' softmaxes lie one after another in one array
        many = np.flatnonzero(self.width.take(cls) > 1)
        order = many[np.argsort(cls[many].astype(np.int16), kind="stable")]
        own = cls[order]
        cut, width = np.searchsorted(own, np.arange(self.n_classes + 1)).tolist(), self.width.take(own)
        ends = np.cumsum(width)
        flat, total = self._space("flat", int(ends[-1]) if len(ends) else 0), np.empty(len(order), rows.dtype)
        x, ww, blocks, at = self._space("x", len(order), d + 1), self._space("ww", len(self.cls), d + 1), [], 0
        rows.take(order, axis=0, out=x, mode="clip")  # without a copy to check places
        ww[:, :-1] = p["ww"]
        ww[:, -1] = p["bw"]
        for i, j, lo, hi in zip(cut[:-1], cut[1:], self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            if i < j:
                b = flat[at : at + (j - i) * (hi - lo)].reshape(j - i, hi - lo)
                at += b.size
                np.matmul(x[i:j], ww[lo:hi].T, out=b)
                if not bounded:
                    b -= b.max(axis=1, keepdims=True)
                blocks.append((i, j, lo, hi, b))
        place = ends - width + words[order] - self.first[own]
        mine = flat.take(place)
        np.exp(flat, out=flat)
        for i, j, lo, hi, b in blocks:
            np.matmul(b, ones[: hi - lo], out=total[i:j])
        out[order] += mine - np.log(total)
        if grads is not None:
            flat[place] -= total
            share = (1 / (total * n))[:, None]
            x *= share
            gw, dx, plain = self._space("gw", *ww.shape), self._space("dx", len(order), d), p["ww"]
            gw.fill(0)
            for i, j, lo, hi, b in blocks:
                np.matmul(b.T, x[i:j], out=gw[lo:hi])
                np.matmul(b, plain[lo:hi], out=dx[i:j])
            dx *= share
            dh[order] += dx
            grads["ww"] += gw[:, :-1]
            grads["bw"] += gw[:, -1]
        return out, dh

    def score(self, texts: list[np.ndarray], n_lanes: int = 256, size: int = 64) -> np.ndarray:
        """log10 of each text's probability; texts are arrays of words that end with the end."""
        out = np.zeros(len(texts))
        if not texts:
            return out
        weights, bounded, last, room, state = self._weights(), self._bounded(), None, None, None
        held: list[tuple] = []  # positions of several windows, so that windows of few lanes share the softmax's fixed costs

        def flush() -> None:
            nonlocal out
            rows, words, text = held[0] if len(held) == 1 else (np.concatenate(x) for x in zip(*held, strict=True))
            logs, _ = self._logs(rows, words, bounded=bounded)
            out += np.bincount(text, logs, minlength=len(texts))
            held.clear()

        for before, words, text in windows(texts, n_lanes, size, self.end):
            n = words.shape[1]
            if room is None or room.before.shape[-1] != n:
                room = _Room(1, 1, n, weights[0].dtype)
                views = room.views(0)
            state = np.zeros((HIDDEN, n), weights[0].dtype) if state is None else state[:, :n]
            states = np.empty((len(words), HIDDEN, n), weights[0].dtype)
            state = self._steps(weights, weights[0].take(before, axis=0), _going(text, last), state, views * len(words), states)
            last, rows = text[-1], _wide(states.transpose(0, 2, 1))
            words, text = words.ravel(), text.ravel()
            if (on := text >= 0).all():
                held.append((rows, words, text))
            else:
                held.append((rows[on], words[on], text[on]))
            if sum(len(x[1]) for x in held) >= 16384:
                flush()
        if held:
            flush()
        self.spaces.clear()
        return out / np.log(10)

    def _back(self, room: _Room, before: np.ndarray, embedded: list[np.ndarray], going: np.ndarray, dstates: np.ndarray, g: dict) -> None:
        """Adds the gradients of a room's windows, given those of their states, to ``g``. All are steps x windows x ..., embeddings are by window."""
        n, (steps, most, _, lanes) = HIDDEN, dstates.shape
        z, r = room.gates[:, :most, :n], room.gates[:, :most, n:]
        u = np.ascontiguousarray(np.roll(self.p["u"], n, axis=1))  # of the new value, z, r
        d = room.by_sums[:, :most]
        by_part, by_z, by_r, by_new = (d[:, :, a : a + n] for a in range(0, 4 * n, n))
        du, dx, dh, y = d[:, :, : 3 * n], d[:, :, n:], np.zeros_like(dstates[0]), np.empty_like(dstates[0])
        new_of, z_of, r_of, left = self._space("factors", 4, 4, most, n, lanes)  # a few steps' factors at once, on what fits the cache
        for end in range(steps, 0, -4):
            a = max(0, end - 4)
            at, k = slice(a, end), end - a
            rest, new, x, w, c = np.subtract(1, z[at], out=left[:k]), room.new[at, :most], new_of[:k], z_of[:k], r_of[:k]
            np.multiply(new, new, out=x)
            np.subtract(1, x, out=x)
            x *= rest
            np.subtract(room.before[at, :most], new, out=w)
            w *= rest
            w *= z[at]
            np.subtract(1, r[at], out=c)
            c *= r[at]
            c *= room.part[at, :most, 2 * n :]
            for t in range(end - 1, a - 1, -1):
                dh += dstates[t]
                v = np.multiply(x[t - a], dh, out=by_new[t])
                np.multiply(v, r[t], out=by_part[t])
                np.multiply(v, c[t - a], out=by_r[t])
                np.multiply(w[t - a], dh, out=by_z[t])
                dh *= z[t]
                dh += np.matmul(u, du[t], out=y)
                dh *= going[t]
        h = self._space("before", steps, most, lanes, n)
        h[...] = room.before[:, :most].transpose(0, 1, 3, 2)
        g["u"] += np.roll(np.matmul(du, h, out=self._space("by", steps, most, 3 * n, n)).sum(axis=(0, 1)).T, -n, axis=1)
        by_input = sum(np.matmul(dx[:, k], e, out=self._space("by", steps, 3 * n, n + 1)).sum(axis=0) for k, e in enumerate(embedded))
        g["wx"] += by_input[:, :-1].T
        g["bx"] += by_input[:, -1]
        words, by_word = before.ravel(), self._space("by_word", n, steps, most, lanes)
        by_word[...] = np.matmul(self.p["wx"], dx, out=h.reshape(steps, most, n, lanes)).transpose(2, 0, 1, 3)
        for x, to in zip(by_word.reshape(n, -1), g["embed"].T, strict=True):
            to += np.bincount(words, x, minlength=len(to))

    def train(self, texts: list[np.ndarray], epochs: int = 1, rate: float = 0.004, n_lanes: int = 32, size: int = 32, seed: int = 0, batch: int = 1) -> int:
        """Truncated backpropagation over windows, states carried between them; returns the tokens seen.

        A step is taken after windows of ``batch`` tokens together, so that windows of few lanes share its fixed costs.
        """
        rng, step, seen = np.random.default_rng(seed), 0, 0
        rooms: list[_Room] = []
        spare: list[_Room] = []
        flat = self.vector()
        first, second, d = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat)
        self.p, g = self._views(flat), self._views(d)

        def update() -> int:
            nonlocal step
            step += 1
            d.fill(0)
            parts = []
            for room in rooms:
                *stacked, embedded = zip(*room.windows, strict=True)
                before, going, words, on = (np.stack(x, axis=1) for x in stacked)
                states, whole = room.out[:, : len(room.windows)].transpose(0, 1, 3, 2), bool(on.all())
                rows = _wide(states, self._space("rows", *states.shape[:-1], HIDDEN + 1) if len(rooms) == 1 else None)
                parts.append((room, before, embedded, going[:, :, None], on, whole, rows if whole else rows[on.ravel()], words[on]))
            rows, words = parts[0][-2:] if len(parts) == 1 else (np.concatenate(x) for x in zip(*[p[-2:] for p in parts], strict=True))
            _, dout = self._logs(rows, words, g, bounded=self._bounded())
            at = 0
            for room, before, embedded, going, on, whole, _, words in parts:
                dstates = room.by_out[:, : on.shape[1]]
                by_token, own = dstates.transpose(0, 1, 3, 2), dout[at : at + len(words)]
                if whole:
                    by_token[...] = own.reshape(by_token.shape)
                else:
                    dstates.fill(0)
                    by_token[on] = own
                at += len(words)
                self._back(room, before, embedded, going, dstates, g)
            # running sums of gradients and their squares, not means: constants take up the difference
            scale = np.sqrt(0.01 / (1 - 0.99**step))
            change, least = flat.dtype.type(rate * 0.1 / (1 - 0.9**step) / scale), flat.dtype.type(1e-7 / scale)
            for a in range(0, len(flat), 1 << 15):
                m, s, x, p = (v[a : a + (1 << 15)] for v in (first, second, d, flat))
                m *= 0.9
                m += x
                x *= x
                s *= 0.99
                s += x
                np.sqrt(s, out=x)
                x += least
                np.divide(m, x, out=x)
                x *= change
                p -= x
            spare[:] = rooms  # their memory serves the next step
            rooms.clear()
            return at

        for _ in range(epochs if texts else 0):
            order = rng.permutation(len(texts))
            h = last = None
            waiting, weights = 0, self._weights()
            for before, words, text in windows([texts[i] for i in order], n_lanes, size, self.end):
                steps, n = words.shape
                on = text >= 0
                h = np.zeros((HIDDEN, n), flat.dtype) if h is None else h[:, :n]
                if not rooms or len(rooms[-1].windows) == rooms[-1].most or rooms[-1].out.shape[::3] != (steps, n):
                    while spare and spare[-1].out.shape[::3] != (steps, n):
                        spare.pop()
                    rooms.append(spare.pop() if spare else _Room(steps, max(1, batch // (steps * n)), n, flat.dtype))
                    rooms[-1].windows.clear()
                room, k = rooms[-1], len(rooms[-1].windows)
                going, embedded = _going(text, last).astype(flat.dtype), weights[0].take(before, axis=0)
                h = self._steps(weights, embedded, going, h, room.views(k), room.out[:, k])
                room.windows.append((before, going, words, on, embedded))
                last, waiting = text[-1], waiting + int(on.sum())
                if waiting >= batch:
                    seen += update()
                    waiting, weights = 0, self._weights()
            if rooms:
                seen += update()
        self.spaces.clear()
        return seen
