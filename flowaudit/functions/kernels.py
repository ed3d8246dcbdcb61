"""NumPy attribution kernels for one batch of rows (small helpers called inside tasks)."""

from __future__ import annotations

from math import factorial

import numpy as np


def quadrature(steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre weights and nodes on [0, 1]."""
    nodes, weights = np.polynomial.legendre.leggauss(steps)
    return 0.5 * weights, 0.5 * (1.0 + nodes)


def path_gradient(scorer, x, start, target, steps, softmax=True):
    """Average gradient of the target class along the line from start to x."""
    weights, nodes = quadrature(steps)
    if hasattr(scorer, "slope_along"):  # the gradient only changes in length along the line
        slope = scorer.slope_along(x, start, target, zip(weights, nodes), softmax)
        if slope is not None:
            return slope
    g = np.zeros_like(x)
    for w, a in zip(weights, nodes):
        g += w * scorer.gradient(start + a * (x - start), target, softmax)
    return g


def _outputs(scorer, x, target, softmax):
    z = scorer.predict(x) if softmax else scorer.predict_logits(x)
    return z[np.arange(len(x)), target]


def integrated_gradients(scorer, x, base, target, steps=50, softmax=True):
    attrs = path_gradient(scorer, x, base, target, steps, softmax) * (x - base)
    delta = attrs.sum(1) - (_outputs(scorer, x, target, softmax) - _outputs(scorer, base, target, softmax))
    return attrs, delta


def sequential_gradients(scorer, x, base, target, discrete, steps=50, softmax=True):
    """Continuous features along the path first, then the jump of the discrete ones.

    The jump is shared equally by the discrete features that differ, so the
    attributions sum to the change of the output.
    """
    disc = np.zeros(x.shape[1], dtype=bool)
    disc[list(discrete)] = True
    mixed = np.where(disc, base, x)
    attrs = path_gradient(scorer, mixed, base, target, steps, softmax) * (mixed - base)
    f_in, f_mixed = _outputs(scorer, x, target, softmax), _outputs(scorer, mixed, target, softmax)
    changed = disc & (x != base)
    n = changed.sum(1)
    attrs = attrs + np.where(changed, ((f_in - f_mixed) / np.maximum(n, 1))[:, None], 0.0)
    delta = attrs.sum(1) - (f_in - _outputs(scorer, base, target, softmax))
    return attrs, delta


def rescale_multipliers(scorer, x, base, target, softmax=False, tiny=1e-6):
    """Rescale-rule contributions of a feed-forward net relative to one base per row."""
    ins, pre = scorer.activations(x)
    ins0, pre0 = scorer.activations(base)
    rows, out = np.arange(len(x)), pre[-1].shape[1]
    m = np.zeros((len(x), out))
    m[rows, target] = 1.0
    if softmax:
        d_in = pre[-1] - pre0[-1]
        p, p0 = scorer.predict(x), scorer.predict(base)
        near = np.abs(d_in) < tiny
        slope = np.where(near, p * (1 - p), (p - p0) / np.where(near, 1.0, d_in))
        m = m * slope
        m = m - m.mean(axis=1, keepdims=True)
    for n in range(len(scorer.layers) - 1, -1, -1):
        m = m @ scorer.layers[n][0].T
        if n:
            d_in, d_out = pre[n - 1] - pre0[n - 1], ins[n] - ins0[n]
            near = np.abs(d_in) < tiny
            m = m * np.where(near, ins[n] * (1 - ins[n]), d_out / np.where(near, 1.0, d_in))
    return m * (x - base)


def deep_shap(scorer, x, background, target, softmax=False):
    """Rescale contributions averaged over background rows; also the mean background output."""
    attrs = np.zeros_like(x)
    for b in background:
        attrs += rescale_multipliers(scorer, x, np.broadcast_to(b, x.shape), target, softmax)
    z = scorer.predict(background) if softmax else scorer.predict_logits(background)
    return attrs / len(background), z.mean(0)[target]


class LeafTable:
    """The leaves of a forest against a background, for exact interventional Shapley values.

    A row meets or misses each feature of a leaf's path; the misses are a bit mask, found level by level for all leaves of a tree. For
    paths of at most PLACES features the values of all masks are tabled, a block of leaves at a time: sums over the background rows that meet
    what the row misses are subset sums, and the factorial weights are integrals that a few quadrature nodes give exactly. A row then looks
    its values up. Longer paths go through the distinct masks of rows and background. Memory is bounded by CELLS and ROWS, whatever the
    number of rows and leaves.
    """

    CELLS, PLACES, ROWS = 1 << 20, 12, 2048

    def __init__(self, trees, weights, background: np.ndarray):
        self.outputs, self.size = trees[0].value.shape[1], len(background)
        self.trees = [_Paths(t, w, background) for t, w in zip(trees, weights)]

    def shapley(self, x: np.ndarray, target: np.ndarray | None = None) -> np.ndarray:
        """Interventional Shapley values averaged over the background: (rows, features, outputs), or (rows, features) of each row's output ``target``."""
        if target is None:
            return np.stack([self.shapley(x, np.full(len(x), o)) for o in range(self.outputs)], axis=-1)
        phi = np.zeros((x.shape[1], len(x)))
        self._add(x, target, phi, _shares, self._deep_shares, lambda k, f: f)
        return np.ascontiguousarray(phi.T)

    def interactions(self, x: np.ndarray, target: np.ndarray | None = None) -> np.ndarray:
        """Shapley interaction values (rows, features, features, outputs), or of each row's output ``target``; rows sum to the Shapley values."""
        if target is None:
            return np.stack([self.interactions(x, np.full(len(x), o)) for o in range(self.outputs)], axis=-1)
        n, d = x.shape
        cells = np.zeros((d * d, n))

        def place(k, f):  # both features of every pair, the smaller first
            i, j = np.triu_indices(k, 1)
            return np.minimum(f[:, i], f[:, j]) * d + np.maximum(f[:, i], f[:, j])

        self._add(x, target, cells, _pair_shares, self._deep_pair_shares, place)
        half = cells.T.reshape(n, d, d)
        out = np.add(half, half.transpose(0, 2, 1), order="C")
        idx = np.arange(d)
        out[:, idx, idx] = self.shapley(x, target) - out.sum(axis=2)
        return out

    def _add(self, x, target, total, table, deep, place):
        """Adds every leaf's share to ``total`` (cells, rows)."""
        for tree in self.trees:
            masks = tree.masks(x, self.ROWS)
            for k, at, value, feature, back in tree.groups:
                if not np.any(value[:, target]):
                    continue
                cells, many = place(k, feature), len(place(k, feature[:1])[0])
                if not many:
                    continue
                step = max(1, self.CELLS // (many << k)) if k <= self.PLACES else 1
                for a in range(0, len(at), step):
                    own = masks[at[a : a + step]]
                    if k <= self.PLACES:
                        shares, of = table(k, back[a : a + step], self.size), own
                    else:
                        shares, of = deep(k, own, back[a : a + step])
                    self._look_up(total, shares, of, value[a : a + step], target, cells[a : a + step].tolist())

    def _look_up(self, total, shares, of, value, target, cells):
        """Row by row of blocks that stay in the cache: ``shares`` (leaf, case, cell) at the rows' cases ``of`` (leaf, row), times the leaf's value."""
        for s in range(0, len(target), self.ROWS):
            part = slice(s, s + self.ROWS)
            own = value[:, target[part]]
            for leaf, places in enumerate(cells):
                if own[leaf].any():
                    got = np.take(shares[leaf], of[leaf, part], axis=0, mode="clip")
                    got *= own[leaf][:, None]
                    for cell, v in zip(places, got.T):
                        total[cell, part] += v

    def _pairs(self, own: np.ndarray, back: np.ndarray):
        """Of one long path: masks of rows and background that play together, the row case of each and its weight, in parts."""
        cases, of = np.unique(own[0], return_inverse=True)
        others, times = np.unique(back[0], return_counts=True)
        parts = []
        step = max(1, self.CELLS // len(others))
        for a in range(0, len(cases), step):
            left, right = np.nonzero((cases[a : a + step, None] & others) == 0)
            parts.append((left + a, others[right], cases[a + left], times[right] / self.size))
        return parts, of[None], len(cases)

    def _deep_shares(self, k, own, back):
        parts, of, cases = self._pairs(own, back)
        share = np.zeros((1, cases, k))
        for left, only_x, only_z, times in parts:
            a, b = np.bitwise_count(only_x), np.bitwise_count(only_z)
            up, down = times * _weights(k, a, b, _gain), times * _weights(k, a, b, _loss)
            for j in range(k):
                bit = np.uint64(1 << j)
                share[0, :, j] += np.bincount(left, np.where(only_x & bit, up, 0.0) - np.where(only_z & bit, down, 0.0), cases)
        return share, of

    def _deep_pair_shares(self, k, own, back):
        parts, of, cases = self._pairs(own, back)
        share = np.zeros((1, cases, k * (k - 1) // 2))
        for left, only_x, only_z, times in parts:
            a, b = np.bitwise_count(only_x), np.bitwise_count(only_z)
            both_x, both_z, mixed = (0.5 * times * _weights(k, a, b, rule) for rule in (_both_x, _both_z, _mixed))
            for p, (i, j) in enumerate(zip(*np.triu_indices(k, 1))):
                xi, xj, zi, zj = ((m & np.uint64(1 << int(f))) > 0 for m in (only_x, only_z) for f in (i, j))
                v = np.where(xi & xj, both_x, 0.0) + np.where(zi & zj, both_z, 0.0) - np.where((xi & zj) | (zi & xj), mixed, 0.0)
                share[0, :, p] += np.bincount(left, v, cases)
        return share, of


class _Paths:
    """One tree: which bit of a mask each split decides, and its leaves by number of features with their background masks."""

    def __init__(self, tree, weight, background: np.ndarray):
        self.tree, self.levels = tree, []
        slots, now, longest = {0: {}}, [0], 0
        while now:
            now = [n for n in now if tree.left[n] >= 0]
            bits, below = [], []
            for n in now:
                own, f = slots.pop(n), int(tree.feature[n])
                if f not in own:
                    own = {**own, f: len(own)}
                bits.append(own[f])
                for child in (int(tree.left[n]), int(tree.right[n])):
                    slots[child] = own
                    below.append(child)
            if now:
                longest = max(longest, max(bits) + 1)
                self.levels.append((np.array(now), np.array(bits)))
            now = below
        if longest > 64:
            raise ValueError("a path has more than 64 different features")
        self.kind = np.uint16 if longest <= 16 else np.uint64
        found: dict[int, list] = {}
        for leaf, own in slots.items():
            if own and np.any(tree.value[leaf]):
                found.setdefault(len(own), []).append((leaf, list(own)))
        back = self.masks(background, len(background))
        self.groups = []
        for k, leaves in sorted(found.items()):
            at = np.array([leaf for leaf, _ in leaves])
            self.groups.append((k, at, weight * tree.value[at], np.array([f for _, f in leaves]), back[at].astype(np.uint64)))

    def masks(self, x: np.ndarray, rows: int) -> np.ndarray:
        """(node, row) masks of the path features that a row doesn't meet."""
        t = self.tree
        out = np.zeros((len(t.feature), len(x)), self.kind)
        for s in range(0, len(x), max(1, rows)):
            part = slice(s, s + rows)
            columns = np.ascontiguousarray(x[part].T)
            for nodes, bits in self.levels:
                v, cut = columns[t.feature[nodes]], t.threshold[nodes][:, None]
                at, bit = out[nodes, part], (np.uint64(1) << bits.astype(np.uint64)).astype(self.kind)[:, None]
                out[t.left[nodes], part] = at | np.where(v <= cut, self.kind(0), bit)
                out[t.right[nodes], part] = at | np.where(v > cut, self.kind(0), bit)
        return out


def _integrals(k: int, back: np.ndarray, size: int, degree: int, kinds) -> list[np.ndarray]:
    """(mask, leaf) integrals over t of t^-p (1 - t)^(misses - q) times the subset sums, for every (p, q) of ``kinds``.

    The subset sum of a mask adds t^|misses| over the background rows that meet all the masked row misses.
    """
    leaves = len(back)
    cell = back.astype(np.int64) * leaves + np.arange(leaves)[:, None]
    plain = (np.bincount(cell.ravel(), minlength=leaves << k) / size).reshape(1 << k, leaves)
    misses = np.bitwise_count(np.arange(1 << k))[:, None].astype(float)
    out = [np.zeros(plain.shape) for _ in kinds]
    for w, t in zip(*quadrature(degree // 2 + 1)):
        u = plain * t**misses
        for j in range(k):
            v = u.reshape(1 << (k - 1 - j), 2, -1)
            v[:, 1] += v[:, 0]
        u = u[::-1]  # the complement of a mask counts from the other end
        for total, (p, q) in zip(out, kinds):
            total += u * (w * t**-p * (1 - t) ** (misses - q))
    return out


def _shares(k: int, back: np.ndarray, size: int) -> np.ndarray:
    """(leaf, mask, feature): what each path feature gives to a row with that mask, for a leaf value of 1."""
    out = np.empty((k, 1 << k, len(back)))
    met, without, lost = _integrals(k, back, size, k - 1, ((1, 0), (1, 1), (0, 1)))
    for j in range(k):
        o, a, b, c = (m.reshape(1 << (k - 1 - j), 2, -1) for m in (out[j], met, without, lost))
        np.subtract(a[:, 0], b[:, 1], out=o[:, 0])
        np.negative(c[:, 1], out=o[:, 1])
    return np.ascontiguousarray(out.transpose(2, 1, 0))


def _pair_shares(k: int, back: np.ndarray, size: int) -> np.ndarray:
    """(leaf, mask, pair of features): half of what each pair gives to a row with that mask, for a leaf value of 1."""
    first, second = np.triu_indices(k, 1)
    out = np.empty((len(first), 1 << k, len(back)))
    made = _integrals(k, back, size, max(0, k - 2), ((2, 0), (2, 1), (2, 2), (1, 1), (1, 2), (0, 2)))
    for p, (i, j) in enumerate(zip(first.tolist(), second.tolist())):
        shape = (1 << (k - 1 - j), 2, 1 << (j - i - 1), 2, (1 << i) * len(back))
        o, none, one, two, mixed, less, both = (m.reshape(shape) for m in (out[p], *made))
        o[:, 0, :, 0] = none[:, 0, :, 0] - one[:, 0, :, 1] - one[:, 1, :, 0] + two[:, 1, :, 1]
        np.subtract(less[:, 1, :, 1], mixed[:, 0, :, 1], out=o[:, 0, :, 1])
        np.subtract(less[:, 1, :, 1], mixed[:, 1, :, 0], out=o[:, 1, :, 0])
        o[:, 1, :, 1] = both[:, 1, :, 1]
    out *= 0.5
    return np.ascontiguousarray(out.transpose(2, 1, 0))


def _gain(p, q):
    return factorial(p - 1) * factorial(q) / factorial(p + q) if p else 0.0


def _loss(p, q):
    return factorial(p) * factorial(q - 1) / factorial(p + q) if q else 0.0


def _both_x(p, q):
    return factorial(p - 2) * factorial(q) / factorial(p + q - 1) if p > 1 else 0.0


def _both_z(p, q):
    return factorial(p) * factorial(q - 2) / factorial(p + q - 1) if q > 1 else 0.0


def _mixed(p, q):
    return factorial(p - 1) * factorial(q - 1) / factorial(p + q - 1) if p and q else 0.0


def _weights(k: int, a: np.ndarray, b: np.ndarray, rule) -> np.ndarray:
    """``rule`` of the counts (a, b) of features that only one side meets."""
    t = np.array([[rule(p, q) if p + q <= k else 0.0 for q in range(k + 1)] for p in range(k + 1)])
    return t[a, b]


def tree_shap(trees, weights, x, z):
    """Interventional Shapley values: (rows, features, outputs), averaged over background z."""
    return LeafTable(trees, weights, np.asarray(z, float)).shapley(np.asarray(x, float))


def tree_interactions(trees, weights, x, z):
    """Shapley interaction values (rows, features, features, outputs)."""
    return LeafTable(trees, weights, np.asarray(z, float)).interactions(np.asarray(x, float))


def weighted_ridge(x, y, w, alpha=1.0):
    """Ridge with an unpenalised intercept: coefficients, intercept and weighted r2."""
    total = w.sum()
    mx, my = (w @ x) / total, (w @ y) / total
    xc, yc = x - mx, y - my
    wx = xc * w[:, None]
    coef = np.linalg.solve(xc.T @ wx + alpha * np.eye(x.shape[1]), wx.T @ yc)
    rest, spread = w @ (yc - xc @ coef) ** 2, w @ yc**2
    r2 = 1.0 - rest / spread if spread > 0 else (1.0 if rest == 0 else 0.0)
    return coef, my - mx @ coef, r2


def coalition_design(width: int, samples: int, seed: int = 42):
    """Feature subsets and the matrix that turns their values into Shapley estimates.

    Small widths enumerate all proper subsets; larger ones draw complementary
    pairs by size.  With y the subset values, ``phi = P @ (y - f0) + q * (fx - f0)``.
    """
    from math import comb

    if 2**width - 2 <= samples:
        codes = np.arange(1, 2**width - 1)
        masks = (codes[:, None] >> np.arange(width)) & 1
        size = masks.sum(1)
        w = np.array([(width - 1) / (comb(width, int(s)) * s * (width - s)) for s in size])
    else:
        rng = np.random.default_rng(seed)
        sizes = np.arange(1, width)
        p = 1.0 / (sizes * (width - sizes))
        rows = []
        for s in rng.choice(sizes, samples // 2, p=p / p.sum()):
            m = np.zeros(width, dtype=int)
            m[rng.permutation(width)[:s]] = 1
            rows += [m, 1 - m]
        masks, w = np.unique(np.array(rows), axis=0, return_counts=True)
        w = w.astype(float)
    z = masks.astype(float)
    left = z[:, :-1] - z[:, -1:]
    gram = np.linalg.pinv(left.T @ (left * w[:, None])) @ (left * w[:, None]).T
    p_matrix = np.vstack([gram, -gram.sum(0)])
    # y - f0 enters minus z_last * (fx - f0)
    q = -p_matrix @ z[:, -1]
    q[-1] += 1.0
    return masks, p_matrix, q
