"""A character-level bidirectional LSTM with CRF transitions in numpy: training, batch decoding.

Tags: 0 outside; 2k + 1 and 2k + 2 begin and continue kind k. Characters are mapped to CLASSES: letters without case,
one class for digits, single marks, and one each for other marks, white space and everything beyond ASCII.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 2 * len(KINDS) + 1
MARKS = "@.+-()[]_%:/#"
CLASSES = 26 + 1 + len(MARKS) + 4


def _table() -> np.ndarray:
    t = np.full(128, 26 + 1 + len(MARKS), np.uint8)  # other marks
    for c in range(26):
        t[97 + c] = t[65 + c] = c
    t[48:58] = 26
    for i, m in enumerate(MARKS):
        t[ord(m)] = 27 + i
    t[32], t[[9, 10, 13]] = CLASSES - 3, CLASSES - 2
    return t


TABLE = _table()


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, TABLE[np.minimum(points, 127)], CLASSES - 1).astype(np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    def __init__(self, hidden: int = 12, seed: int = 3):
        rng = np.random.default_rng(seed)
        f = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
        self.h = hidden
        self.p = {"out": f(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32), "move": f(TAGS, TAGS)}
        for d in "fb":
            self.p |= {f"x{d}": f(CLASSES, 4 * hidden), f"h{d}": f(hidden, 4 * hidden)}
            self.p[f"x{d}"][:, hidden : 2 * hidden] += 1  # forget gates start open

    def _direction(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states (steps, n, h) for codes (n, steps), with the tape that the gradients need."""
        n, steps = x.shape
        wx, wh, k = self.p[f"x{d}"], self.p[f"h{d}"], self.h
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out, tape = np.empty((steps, n, k), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = wx[x[:, t]] + h @ wh
            s = _sigmoid(z[:, : 3 * k])
            g = np.tanh(z[:, 3 * k :])
            i, f, o = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :]
            before = (h, c)
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            tape.append((t, before, i, f, o, g, tc))
        return out, tape

    def _hidden(self, x: np.ndarray, d: str) -> np.ndarray:
        """The same hidden states without a tape. Gates are 0.5 + 0.5 tanh(z / 2), so that one tanh serves all four.

        Each gate is a block of its own, so that all arithmetic runs over contiguous memory.
        """
        n, steps, k = *x.shape, self.h
        half = np.array([0.5, 0.5, 0.5, 1], np.float32)[:, None, None]
        wx, wh = (np.ascontiguousarray(self.p[f"{m}{d}"].astype(np.float32).reshape(-1, 4, k).transpose(1, 0, 2) * half) for m in "xh")
        z, wide, c, tmp, h = np.empty((4, n, k), np.float32), np.empty((4, n, k), np.float32), np.zeros((n, k), np.float32), np.empty((n, k), np.float32), np.zeros((n, k), np.float32)
        out, at = np.empty((steps, n, k), np.float32), x.T.astype(np.intp)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(wx, at[t], axis=1, out=z, mode="clip")
            np.matmul(h, wh, out=wide)
            z += wide
            np.tanh(z, out=z)
            i, f, o, g = z
            z[:3] *= np.float32(0.5)
            z[:3] += np.float32(0.5)
            c *= f
            c += np.multiply(i, g, out=tmp)
            h = np.multiply(o, np.tanh(c, out=tmp), out=out[t])
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores of the tags (steps, n, tags)."""
        k = self.h
        return self._hidden(x, "f") @ self.p["out"][:k] + self._hidden(x, "b") @ self.p["out"][k:] + self.p["bias"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi paths (n, steps). Best scores of all steps are kept; the path back asks only for the tag it is in.

        Tags are taken in the order outside, begins, continuations: a continuation has two tags before it, the others any.
        """
        n, steps = x.shape
        order = np.array([0, *range(1, TAGS, 2), *range(2, TAGS, 2)])
        k = len(KINDS)
        e = np.ascontiguousarray(self.emissions(x).transpose(0, 2, 1)[:, order])
        move = (self.p["move"] + BARRED).astype(np.float32)[np.ix_(order, order)]
        free, begun, held = move[:, : k + 1, None], np.diagonal(move[1 : k + 1, k + 1 :])[:, None], np.diagonal(move[k + 1 :, k + 1 :])[:, None]
        best, into = np.empty((steps, TAGS, n), np.float32), np.empty((TAGS, k + 1, n), np.float32)
        best[0] = e[0] + BARRED[0][order][:, None]
        for t in range(1, steps):
            v = best[t - 1]
            np.max(np.add(v[:, None, :], free, out=into), axis=0, out=best[t, : k + 1])
            np.maximum(v[1 : k + 1] + begun, v[k + 1 :] + held, out=best[t, k + 1 :])
            best[t] += e[t]
        path = np.empty((steps, n), np.int8)
        path[-1] = best[-1].argmax(axis=0)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = (best[t - 1] + move[:, path[t]]).argmax(axis=0)
        return order.astype(np.int8)[path].T

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood and its gradients."""
        n, steps = x.shape
        (hf, tf), (hb, tb) = self._direction(x, "f"), self._direction(x, "b")
        both = np.concatenate([hf, hb], axis=2)
        e = both @ self.p["out"] + self.p["bias"]
        move = self.p["move"]
        a, b = np.empty_like(e), np.zeros_like(e)
        a[0] = e[0]
        for t in range(1, steps):
            m = a[t - 1][:, :, None] + move
            top = m.max(axis=1)
            a[t] = np.log(np.exp(m - top[:, None]).sum(axis=1)) + top + e[t]
        for t in range(steps - 2, -1, -1):
            m = move + (e[t + 1] + b[t + 1])[:, None, :]
            top = m.max(axis=2)
            b[t] = np.log(np.exp(m - top[:, :, None]).sum(axis=2)) + top
        top = a[-1].max(axis=1)
        z = np.log(np.exp(a[-1] - top[:, None]).sum(axis=1)) + top
        de = np.exp(a + b - z[None, :, None])
        rows = np.arange(n)
        score = e[0][rows, y[:, 0]].astype(np.float64)
        g = {k: np.zeros_like(w) for k, w in self.p.items()}
        for t in range(steps):
            de[t][rows, y[:, t]] -= 1
            if t:
                score += e[t][rows, y[:, t]] + move[y[:, t - 1], y[:, t]]
                joint = np.exp(a[t - 1][:, :, None] + move + (e[t] + b[t])[:, None, :] - z[:, None, None])
                g["move"] += joint.sum(axis=0)
                np.subtract.at(g["move"], (y[:, t - 1], y[:, t]), 1)
        g["out"], g["bias"] = np.einsum("tnh,tnk->hk", both, de), de.sum(axis=(0, 1))
        dh_all = de @ self.p["out"].T
        k = self.h
        for d, tape, dh_out in (("f", tf, dh_all[:, :, :k]), ("b", tb, dh_all[:, :, k:])):
            dh, dc = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
            for t, (h0, c0), i, f, o, gg, tc in reversed(tape):
                dh = dh + dh_out[t]
                dc = dc + dh * o * (1 - tc**2)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg**2)], axis=1)
                np.add.at(g[f"x{d}"], x[:, t], dz)
                g[f"h{d}"] += h0.T @ dz
                dh, dc = dz @ self.p[f"h{d}"].T, dc * f
        return float((z - score).mean()), {key: v / n for key, v in g.items()}

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 1) -> list[float]:
        """Adam over shuffled batches; returns the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        m, v, t, losses = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2)), None, 0, []
        m, v = m
        for epoch in range(epochs):
            order, total = rng.permutation(len(x)), []
            for s in range(0, len(order), batch):
                loss, g = self.step(x[order[s : s + batch]], y[order[s : s + batch]])
                total.append(loss)
                t += 1
                lr = rate * (0.5 if epoch >= epochs * 2 // 3 else 1)
                norm = np.sqrt(sum(float((w**2).sum()) for w in g.values()))
                for k, w in g.items():
                    w = w * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * w
                    v[k] = 0.999 * v[k] + 0.001 * w**2
                    self.p[k] -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(total)))
        return losses


def _barred() -> np.ndarray:
    """A continuation follows only the beginning or continuation of its kind; row 0 also bars it at the start."""
    out = np.zeros((TAGS, TAGS), np.float32)
    for kind in range(len(KINDS)):
        into = 2 * kind + 2
        out[:, into] = -1e4
        out[[2 * kind + 1, into], into] = 0
    return out


BARRED = _barred()


# --- labelled spans ------------------------------------------------------------------------


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _luhn(r: random.Random, n: int) -> str:
    body = _digits(r, n - 1)
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(body))))
    return body + str(-total % 10)


def example(r: random.Random, kind: str) -> str:
    """One span of a kind, in the plain forms and in looser ones."""
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 8)))
    if kind == "email":
        name = r.choice([word(), f"{word()}.{_digits(r, 2)}", f"{word()}_{word()}", f"{word()}.{word()}"])
        at, dot = r.choice([("@", ".")] * 5 + [(" @ ", "."), ("[@]", "."), (" @ ", " . ")])
        return f"{name}{at}{word()}{r.choice(['', _digits(r, 1)])}{dot}{r.choice(['example.com', 'com', 'org', 'net'])}"
    if kind == "ip":
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        return r.choice([".", ".", ".", " . ", "[.]"]).join(parts)
    if kind == "card":
        n = r.choice([16, 16, 16, 15, 13, 19])
        d = _luhn(r, n)
        sep = r.choice(["", "", " ", "-", ".", "  "])
        return sep.join(d[i : i + 4] for i in range(0, n, 4))
    area, a, b = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return r.choice([f"+1 ({area}) {a}-{b}", f"+{_digits(r, 2)} {area} {a} {b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"+1-{area}-{a}-{b}", f"+1/{area}/{a}/{b}"])


def distractor(r: random.Random) -> str:
    hexa = "".join(r.choice("0123456789abcdef") for _ in range(r.randint(8, 40)))
    return r.choice([hexa, f'token = "{hexa}"', f"{r.randint(1, 9)}.{r.randint(0, 9)}", str(r.randint(1, 2099)), f"{r.randint(1, 99)}%", f"v{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}", f"{r.randint(1900, 2030)}-{r.randint(1, 12)}-{r.randint(1, 28)}", f"#{_digits(r, 5)}", _digits(r, r.choice([5, 6, 20, 22])), f"{r.randint(1, 999)},{_digits(r, 3)}"])


def labelled_windows(backgrounds: list[str], n: int, size: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows with labelled spans: examples and distractors set into pieces of the backgrounds."""
    r = random.Random(seed)
    x, y = np.zeros((n, size), np.uint8), np.zeros((n, size), np.int64)
    for w in range(n):
        text, tags = "", []
        while len(text) < size + 20:
            b = r.choice(backgrounds)
            a = r.randrange(max(1, len(b) - 30))
            text += b[a : a + r.randint(4, 30)]
            tags += [0] * (len(text) - len(tags))
            around = r.choice([" ", " ", " ", "\n", ": ", " (", ", ", '"', "### "])
            text += around
            tags += [0] * len(around)
            if r.random() < 0.35:
                text += distractor(r)
                tags += [0] * (len(text) - len(tags))
            else:
                k = r.randrange(len(KINDS))
                span = example(r, KINDS[k])
                text += span
                tags += [2 * k + 1] + [2 * k + 2] * (len(span) - 1)
            after = r.choice([" ", " ", ". ", ", ", ")", "$$$ ", "\n"])
            text += after
            tags += [0] * len(after)
        cut = r.randrange(0, 20)
        x[w], y[w] = codes(text[cut : cut + size]), tags[cut : cut + size]
        if y[w, 0] and y[w, 0] % 2 == 0:
            y[w, 0] -= 1  # a window may open within a span
    return x, y


@lru_cache(maxsize=4)
def trained(backgrounds: tuple[str, ...], windows: int, size: int, hidden: int, epochs: int) -> Tagger:
    x, y = labelled_windows(list(backgrounds), windows, size)
    t = Tagger(hidden)
    t.train(x, y, epochs)
    return t
