"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, carried state.

Units (words, buckets of rare words, the end) are numbered by frequency; 64 of them make
a class. A step reads the unit before, and the hidden state gives the probability of the
next unit's class and of the unit within it.
"""

from __future__ import annotations

import numpy as np

CLASS, HIDDEN, EMBED, STEPS = 64, 16, 16, 16
#: Texts are read in so many lanes at most, and in so few that a pass has UPDATES updates if the text allows it.
LANES, UPDATES = 1024, 60
#: Rows whose logits are made at a time, so that they stay in the processor's cache.
BLOCK = 2048


def shapes(classes: int) -> dict[str, tuple[int, ...]]:
    return {
        "embed": (classes * CLASS, EMBED),
        "gates": (EMBED, 3 * HIDDEN),
        "gates_bias": (3 * HIDDEN,),
        "recur": (HIDDEN, 2 * HIDDEN),
        "recur_new": (HIDDEN, HIDDEN),
        "to_class": (HIDDEN, classes),
        "class_bias": (classes,),
        "to_unit": (classes, HIDDEN, CLASS),
        "unit_bias": (classes, CLASS),
    }


def unpack(flat: np.ndarray, classes: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(classes).items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def initial(counts: np.ndarray, seed: int = 11) -> np.ndarray:
    """Weights that give the smoothed unit frequencies in every context; counts has a multiple of CLASS units."""
    classes = len(counts) // CLASS
    rng = np.random.default_rng(seed)
    flat = np.concatenate([rng.normal(0, 0.05, int(np.prod(s))).astype(np.float32) for s in shapes(classes).values()])
    w = unpack(flat, classes)
    mass = (counts + 0.5).reshape(classes, CLASS)
    w["gates"] *= 4
    w["recur"] *= 3
    w["recur_new"] *= 3
    w["to_class"] *= 0.1
    w["to_unit"] *= 0.1
    w["gates_bias"][:] = 0
    w["class_bias"][:] = np.log(mass.sum(axis=1) / mass.sum())
    w["unit_bias"][:] = np.log(mass / mass.sum(axis=1, keepdims=True))
    return flat


def _bordered(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The weights with the bias as their last row, for states whose last column is 1."""
    return np.concatenate([weights, bias[..., None, :]], axis=-2)


def _gates(w: dict[str, np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What each unit adds to the gates z, r and to the new state, and the weights of the state before; z and r negated, as _advance takes them."""
    parts = [(slice(0, HIDDEN), -1), (slice(HIDDEN, 2 * HIDDEN), -1), (slice(2 * HIDDEN, 3 * HIDDEN), 1)]
    tables = [w["embed"] @ (sign * w["gates"][:, part]) + sign * w["gates_bias"][part] for part, sign in parts]
    return tables, [*(-w["recur"][:, part] for part, _ in parts[:2]), w["recur_new"]]


def _gate(h: np.ndarray, recur: np.ndarray, pre: np.ndarray) -> np.ndarray:
    """sigmoid(x) is 1 / (1 + exp(-x)); recur and pre are negated."""
    out = h @ recur
    out += pre
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


def _advance(h: np.ndarray, pre: list[np.ndarray], recur: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """The next state of each row; the gates z and r, what r lets pass, and the new state that z mixes in."""
    z, r = _gate(h, recur[0], pre[0]), _gate(h, recur[1], pre[1])
    passed = r * h
    n = passed @ recur[2]
    n += pre[2]
    np.tanh(n, out=n)
    out = h - n
    out *= z
    out += n
    return out, z, r, passed, n


def _less_target(logits: np.ndarray, target: np.ndarray, scale: np.ndarray, safe: bool) -> np.ndarray:
    """scale times (softmax less one at the target) of each row; overwrites logits. safe: exp() needs no shift."""
    if not safe:
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits *= (scale / (logits @ np.ones(logits.shape[1], logits.dtype)))[:, None]
    logits[np.arange(len(logits)), target] -= scale
    return logits


def _output(h: np.ndarray, target: np.ndarray, scale: np.ndarray, weights: np.ndarray, to_weights: np.ndarray, to_bias: np.ndarray, safe: bool) -> np.ndarray:
    """The rows' gradient; that of the bordered weights goes to to_weights and to_bias."""
    dh, of_weights = np.empty((len(h), HIDDEN), h.dtype), 0
    for a in range(0, len(h), BLOCK):
        b = a + BLOCK
        d = _less_target(h[a:b] @ weights, target[a:b], scale[a:b], safe)
        of_weights = of_weights + d.T @ h[a:b]
        np.matmul(d, weights[:HIDDEN].T, out=dh[a:b])
    to_weights[:], to_bias[:] = of_weights[:, :HIDDEN].T, of_weights[:, HIDDEN]
    return dh


def _safe(w: dict[str, np.ndarray]) -> bool:
    """Hidden states lie within [-1, 1], so the logits have bounds; whether exp() of these needs no shift."""
    bounds = [np.abs(w["to_class"]).sum(axis=0) + np.abs(w["class_bias"]), np.abs(w["to_unit"]).sum(axis=1) + np.abs(w["unit_bias"])]
    return max(float(b.max()) for b in bounds) < 80


def _by_class(classes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    order = np.argsort(classes.astype(np.uint16), kind="stable")
    found, first = np.unique(classes[order], return_index=True)
    return order, list(zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]))


def fresh(flat: np.ndarray) -> np.ndarray:
    """The state of training: the weights, Adam's two moments, and the updates so far."""
    return np.concatenate([flat, np.zeros(2 * len(flat) + 1, flat.dtype)])


def weights(state: np.ndarray) -> np.ndarray:
    return state[: len(state) // 3]


def _summed(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places and the sums of the rows at each."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    placed = at[order]
    first = np.flatnonzero(np.concatenate([[True], placed[1:] != placed[:-1]]))
    return placed[first], np.add.reduceat(rows.take(order, axis=0), first, axis=0)


def train(state: np.ndarray, classes: int, documents: list[np.ndarray], bos: int, rate: float = 0.01) -> tuple[np.ndarray, int]:
    """One pass of truncated backpropagation (Adam); documents are arrays of units. Returns the new state and the units read.

    Documents follow one another in lanes. The hidden state is carried from window to
    window and set to zero where a document begins; gradients stop at the window.
    """
    state = state.copy()
    size = len(state) // 3
    flat, m, v, tick = state[:size], state[size : 2 * size], state[2 * size : 3 * size], int(state[-1])
    w = unpack(flat, classes)
    total = sum(map(len, documents))
    if not total:
        return state, 0
    units = np.concatenate(documents).astype(np.int64)
    before = np.empty_like(units)
    before[0], before[1:] = bos, units[:-1]
    begins = np.zeros(total, bool)
    begins[np.concatenate([[0], np.cumsum([len(d) for d in documents])[:-1]])] = True
    before[begins] = bos
    lanes = max(1, min(LANES, total, max(8, total // (STEPS * UPDATES))))
    length = -(-total // lanes)  # the last lanes can be shorter
    grid = np.arange(lanes) * length
    grad, work = np.empty_like(flat), np.empty_like(flat)
    g = unpack(grad, classes)
    h = np.zeros((lanes, HIDDEN), flat.dtype)
    for t0 in range(0, length, STEPS):
        steps = min(STEPS, length - t0)
        at = grid[None, :] + np.arange(t0, t0 + steps)[:, None]
        counts = (at < total).ravel()
        at = np.minimum(at, total - 1)
        x, y, starts = before[at], units[at], [np.flatnonzero(b) for b in begins[at]]
        tables, recur = _gates(w)
        tape, hs = [], np.ones((steps, lanes, HIDDEN + 1), flat.dtype)
        for t in range(steps):
            if len(starts[t]):
                h = h.copy()
                h[starts[t]] = 0
            after, *kept = _advance(h, [table.take(x[t], axis=0) for table in tables], recur)
            tape.append((h, *kept))
            h = hs[t, :, :HIDDEN] = after
        flat_h, target = hs.reshape(-1, HIDDEN + 1), y.ravel()
        cls, inside = target // CLASS, target % CLASS
        scale, safe = (counts / counts.sum()).astype(flat.dtype), _safe(w)
        grad[:] = 0
        dh_out = _output(flat_h, cls, scale, _bordered(w["to_class"], w["class_bias"]), g["to_class"], g["class_bias"], safe)
        order, parts = _by_class(cls)
        sorted_h, sorted_in, scale = flat_h.take(order, axis=0), inside[order], scale[order]
        sorted_dh, to_unit = np.empty_like(dh_out), _bordered(w["to_unit"], w["unit_bias"])
        for c, a, b in parts:
            sorted_dh[a:b] = _output(sorted_h[a:b], sorted_in[a:b], scale[a:b], to_unit[c], g["to_unit"][c], g["unit_bias"][c], safe)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        dh_out += sorted_dh.take(place, axis=0)
        dh_out = dh_out.reshape(steps, lanes, HIDDEN)
        d_gates = np.empty((3, steps, lanes, HIDDEN), flat.dtype)
        back = [np.ascontiguousarray(part.T) for part in (w["recur"][:, :HIDDEN], w["recur"][:, HIDDEN:], w["recur_new"])]
        dh = np.zeros((lanes, HIDDEN), flat.dtype)
        for t in range(steps - 1, -1, -1):
            (h0, z, r, passed, n), (dz, dr, dn) = tape[t], d_gates[:, t]
            dh += dh_out[t]
            np.subtract(1, z, out=dn)
            dn *= dh
            np.subtract(h0, n, out=dz)
            dz *= z
            dz *= dn
            dn *= 1 - n * n
            d_passed = dn @ back[2]
            np.subtract(1, r, out=dr)
            dr *= passed
            dr *= d_passed
            d_passed *= r
            dh *= z
            dh += d_passed
            dh += dz @ back[0]
            dh += dr @ back[1]
            dh[starts[t]] = 0
        h0, passed = (np.concatenate([kept[i] for kept in tape]) for i in (0, 3))
        d, x = np.concatenate(d_gates.reshape(3, -1, HIDDEN), axis=1), x.ravel()
        g["recur"][:] = (d[:, : 2 * HIDDEN].T @ h0).T
        g["recur_new"][:] = (d_gates[2].reshape(-1, HIDDEN).T @ passed).T
        g["gates"][:] = (d.T @ w["embed"].take(x, axis=0)).T
        g["gates_bias"][:] = np.ones(len(d), flat.dtype) @ d
        found, sums = _summed(d @ w["gates"].T, x)
        g["embed"][found] = sums
        norm = float(np.sqrt(np.dot(grad, grad)))
        if norm > 1:
            grad /= norm
        tick += 1
        m *= 0.9
        np.multiply(grad, 0.1, out=work)
        m += work
        v *= 0.99
        np.multiply(grad, grad, out=work)
        work *= 0.01
        v += work
        np.divide(v, 1 - 0.99**tick, out=work)
        np.sqrt(work, out=work)
        work += 1e-6
        np.divide(m, work, out=work)
        work *= rate / (1 - 0.9**tick)
        flat -= work
    state[-1] = tick
    return state, total


class Scorer:
    """log10 probabilities of whole documents; the state goes from each document's first unit to its last."""

    def __init__(self, flat: np.ndarray, classes: int, bos: int):
        w, self.bos = unpack(flat, classes), bos
        self.tables, self.recur = _gates(w)
        self.to_class, self.to_unit = _bordered(w["to_class"], w["class_bias"]), _bordered(w["to_unit"], w["unit_bias"])
        self.safe, self.type = _safe(w), flat.dtype

    def score(self, units: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """units: of all documents one after another; sizes: units of each. All documents advance together, longest first."""
        out = np.zeros(len(sizes))
        order = np.argsort(-sizes, kind="stable")
        length, start = sizes[order], (np.cumsum(sizes) - sizes)[order]
        h = np.zeros((len(sizes), HIDDEN), self.type)
        last = np.full(len(sizes), self.bos, np.int64)
        t, longest, room = 0, int(length.max(initial=0)), 1 << 15
        hs, target = np.ones((room + len(sizes), HIDDEN + 1), self.type), np.empty(room + len(sizes), np.int64)
        while t < longest:
            who, end = [], 0
            while t < longest and end < room:
                n = int(np.searchsorted(-length, -t, side="left"))
                last = last[:n]
                h = _advance(h[:n], [table.take(last, axis=0) for table in self.tables], self.recur)[0]
                last = units.take(start[:n] + t)
                hs[end : end + n, :HIDDEN], target[end : end + n] = h, last
                who.append(n)
                end += n
                t += 1
            logs = self._logs(hs[:end], target[:end])
            at = 0
            for n in who:
                out[:n] += logs[at : at + n]
                at += n
        result = np.empty(len(sizes))
        result[order] = out / np.log(10)
        return result

    def _logs(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        cls, inside = target // CLASS, target % CLASS
        logs = self._log_shares(h, cls, self.to_class)
        order, parts = _by_class(cls)
        h, inside, of_unit = h.take(order, axis=0), inside[order], np.empty(len(h))
        for c, a, b in parts:
            of_unit[a:b] = self._log_shares(h[a:b], inside[a:b], self.to_unit[c])
        logs[order] += of_unit
        return logs

    def _log_shares(self, h: np.ndarray, target: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """log of each row's softmax at its target."""
        size = weights.shape[1]
        picked, sums, ones, rows = np.empty(len(h)), np.empty(len(h), self.type), np.ones(size, self.type), np.arange(min(BLOCK, len(h)))
        logits = np.empty((len(rows), size), self.type)
        for a in range(0, len(h), BLOCK):
            b = min(a + BLOCK, len(h))
            z = np.matmul(h[a:b], weights, out=logits[: b - a])
            if not self.safe:
                z -= z.max(axis=1, keepdims=True)
            picked[a:b] = z[rows[: b - a], target[a:b]]
            np.exp(z, out=z)
            np.matmul(z, ones, out=sums[a:b])
        return picked - np.log(sums)
