"""What one task does with its trees: growing them level by level, following rows down, explaining predictions.

A tree is five arrays: ``feature`` (-1 in a leaf), ``cut`` (values up to it go left), ``left`` (place of the left child, the
right one follows it), ``value`` and ``cover`` (weight of the training rows). Every random choice is a hash of the seed, the
number of the tree and the node's place in it, so a tree does not depend on where it grows or on how deep it may get: a tree of
less depth, or with a larger least node, is the same tree cut back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CACHED = 12_000  # values of a few features that are worked on at a time
PLACE = 22  # bits of a row's place and of a value's rank in a sort key


def uniform(*keys) -> np.ndarray:
    """Numbers in [0, 1) from whole-number keys, spread by a multiply-and-shift hash."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in keys:
            h = (np.asarray(k).astype(np.uint64) + h) * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h = h ^ (h >> np.uint64(32))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def resample(seed: int, tree: int, rows: np.ndarray) -> np.ndarray:
    """How often each row is drawn into a tree, Poisson with mean 1."""
    chance = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))
    return np.searchsorted(chance, uniform(seed, tree, rows, 7), side="right")


def ranks(x: np.ndarray) -> np.ndarray:
    """(feature, row): rank of the row's value among the distinct values of the feature, shifted to its place in a sort key."""
    return np.stack([np.unique(c, return_inverse=True)[1] for c in x.T]).astype(np.int64) << PLACE


@dataclass
class Tree:
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    rows: np.ndarray  # training rows by node, without weights


def offered(share: float, varies: np.ndarray, seed: int, tree: int, node: np.ndarray) -> np.ndarray:
    """(node, feature): the features a node may split on, drawn from those that vary in it."""
    most = max(1, int(share * varies.shape[1]))
    if most >= varies.shape[1]:
        return varies
    drawn = np.where(varies, uniform(seed, tree[:, None], node[:, None], np.arange(varies.shape[1]), 3), 2.0)
    return varies & (drawn <= np.partition(drawn, most - 1, axis=1)[:, most - 1, None])


def nearly(top):
    """Scores that differ in their last digits only are ties; the first feature and the lowest cut win."""
    return top - 1e-9 * np.where(np.isfinite(top), np.abs(top), 0.0)


def random_cuts(x, w, gap, count, node, leaf, share, seed, tree):
    """One cut per node and feature, uniform between the least and the greatest value; the best of those drawn.

    Rows come by node and are all of weight 1. ``gap`` is what a row lies above its node's mean, so the squared error
    falls with the square of a side's sum over the product of both sides' weights.
    """
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    low, high = np.minimum.reduceat(x, begin, axis=0), np.maximum.reduceat(x, begin, axis=0)
    cut = low + uniform(seed, tree[:, None], node[:, None], np.arange(x.shape[1]), 5) * (high - low)
    goes = (x <= np.repeat(cut, count, axis=0)).astype(float)
    left = np.add.reduceat(goes, begin, axis=0)
    goes *= gap[:, None]
    fall, right = np.add.reduceat(goes, begin, axis=0), count[:, None] - left
    fine = offered(share, high > low, seed, tree, node) & (left >= leaf) & (right >= leaf)
    gain = np.where(fine, fall * fall / np.maximum(left * right, 1.0), 0.0)
    top = gain.max(axis=1)
    best = (gain >= nearly(top)[:, None]).argmax(axis=1)
    return np.where(top > 0, best, -1), cut[np.arange(len(node)), best]


def best_cuts(x, key, w, gap, count, node, leaf, share, seed, tree):
    """The best of all cuts of the features offered; a cut lies halfway between neighbouring values of the node. Rows come by node.

    A few features are searched at a time, so that what is worked on stays in the processor's cache.
    """
    n, f = x.shape
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    of = np.repeat(np.arange(len(count)), count)
    inside = np.arange(1, n + 1) - begin[of]
    at = np.flatnonzero((inside >= leaf) & (count[of] - inside >= leaf))  # where a node may be parted
    parted = of[at]
    starts = np.flatnonzero(np.diff(parted, prepend=-1))
    total, plain = np.add.reduceat(w, begin), bool((w == 1.0).all())
    left, whole, base = inside[at].astype(float), total[parted], (of << 2 * PLACE) + np.arange(n)
    falls, places = np.empty((f, len(at))), np.empty((f, n), np.int32)
    tops, varies = np.zeros((f, len(count))), np.empty((f, len(count)), bool)
    step = max(1, CACHED // n)
    for c in range(0, f, step):
        some = slice(c, min(c + step, f))
        part = key[some] + base
        part.sort(axis=1)
        place = part & ((1 << PLACE) - 1)
        part >>= PLACE
        run = gap[place]
        sums = np.cumsum(run, axis=1, out=run).take(at, axis=1)  # a node's gaps add up to nothing
        if not plain:
            run = w[place]
            run[:, begin[1:]] -= total[:-1]
            left = np.cumsum(run, axis=1, out=run).take(at, axis=1)
        sums *= sums
        sums /= left * (whole - left)
        sums *= part.take(at, axis=1) != part.take(at + 1, axis=1)
        tops[some, parted[starts]] = np.maximum.reduceat(sums, starts, axis=1)
        varies[some] = part[:, begin + count - 1] != part[:, begin]
        falls[some], places[some] = sums, place
    tops *= offered(share, varies.T, seed, tree, node).T
    top = tops.max(axis=0)
    best = (tops >= nearly(top)).argmax(axis=0)
    hit = np.flatnonzero(falls[best[parted], np.arange(len(at))] >= nearly(top)[parted])
    first = at[hit[np.minimum(np.searchsorted(parted[hit], np.arange(len(count))), len(hit) - 1)]]
    here, after = x[places[best, first], best], x[places[best, np.minimum(first + 1, n - 1)], best]
    middle = here + (after - here) / 2
    return np.where(top > 0, best, -1), np.where(middle < after, middle, here)


def grow(x, y, weights, kind, depth, leaf, split, share, seed, numbers, rank=None) -> list[Tree]:
    """Trees on the rows of positive weight, one per row of ``weights`` and numbered by ``numbers``, level by level side by side.

    ``kind`` "extra" draws cuts, any other kind searches for the best ones. A tree does not depend on its neighbours.
    """
    own, rows = np.nonzero(np.asarray(weights) > 0)
    w = np.asarray(weights)[own, rows].astype(float)
    wy = w * y[rows]
    of, numbers = np.arange(len(weights)), np.asarray(numbers)  # the tree of each open node
    at = own  # place of each open row's node among the open nodes
    node = np.ones(len(weights), np.int64)  # path of each open node: 1, then doubled, plus 1 to the right
    parts, made = [], len(weights)
    for level in range(depth + 1):
        order = np.argsort(at, kind="stable")
        rows, at, w, wy = rows[order], at[order], w[order], wy[order]
        count = np.bincount(at, minlength=len(node))
        begin = np.concatenate([[0], np.cumsum(count)[:-1]])
        total, spread = np.add.reduceat(w, begin), np.add.reduceat(wy, begin)
        ys = y[rows]
        mixed = np.maximum.reduceat(ys, begin) > np.minimum.reduceat(ys, begin)
        feature, cut = np.full(len(node), -1), np.zeros(len(node))
        may = mixed & (count >= max(split, 2 * leaf)) & (level < depth)
        if may.any():
            keep = may[at]
            gap = (wy - w * (spread / total)[at])[keep]
            some = (w[keep], gap, count[may], node[may], leaf, share, seed, numbers[of[may]])
            if kind == "extra":
                feature[may], cut[may] = random_cuts(x[rows[keep]], *some)
            else:
                feature[may], cut[may] = best_cuts(x[rows[keep]], rank.take(rows[keep], axis=1), *some)
        splits = feature >= 0
        left = np.where(splits, made + 2 * (np.cumsum(splits) - 1), -1)
        parts.append((of, feature, cut, left, spread / total, total, count))
        made += 2 * int(splits.sum())
        if not splits.any():
            break
        keep = splits[at]
        rows, at, w, wy = rows[keep], at[keep], w[keep], wy[keep]
        right = x[rows, feature[at]] > cut[at]
        at = 2 * (np.cumsum(splits) - 1)[at] + right
        node = np.stack([2 * node[splits], 2 * node[splits] + 1], axis=1).ravel()
        of = np.repeat(of[splits], 2)
    of, *columns = (np.concatenate(p) for p in zip(*parts))
    place, out = np.zeros(len(of), np.int64), []
    for i in range(len(weights)):
        mine = np.flatnonzero(of == i)
        place[mine] = np.arange(len(mine))
        feature, cut, left, value, cover, size = (c[mine] for c in columns)
        out.append(Tree(feature, cut, np.where(left < 0, -1, place[left]), value, cover, size))
    return out


def walk(tree: Tree, x: np.ndarray, depth: int = 64, split: int = 0) -> np.ndarray:
    """Place of the node each row ends in, in the tree cut back to ``depth`` and to nodes of at least ``split`` rows."""
    at = np.zeros(len(x), np.int64)
    for _ in range(depth):
        feature = tree.feature[at]
        go = (feature >= 0) & (tree.rows[at] >= split)
        if not go.any():
            break
        right = x[np.arange(len(x)), np.maximum(feature, 0)] > tree.cut[at]
        at = np.where(go, tree.left[at] + right, at)
    return at


def huber_step(gap: np.ndarray, delta: float, leaf_of: np.ndarray, leaves: int) -> np.ndarray:
    """Median of the gaps in every leaf plus the mean of what remains, clipped to ``delta``."""
    order = np.lexsort((gap, leaf_of))
    count = np.bincount(leaf_of, minlength=leaves)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    ordered = gap[order]
    middle = np.zeros(leaves)
    some = count > 0
    middle[some] = (ordered[begin[some] + (count[some] - 1) // 2] + ordered[begin[some] + count[some] // 2]) / 2
    rest = np.clip(gap - middle[leaf_of], -delta, delta)
    return middle + np.bincount(leaf_of, rest, leaves) / np.maximum(count, 1)


def lower_quantile(values: np.ndarray, share: float) -> float:
    """The least value with at least ``share`` of all values up to it."""
    ordered = np.sort(values)
    return float(ordered[max(0, int(np.ceil(share * len(ordered))) - 1)])


def boost(x, y, keys, rounds, depth, leaf, rate, sample, loss, seed, each=None, alpha=0.9) -> tuple[float, list[Tree]]:
    """Base and trees, their values already times ``rate``; ``each`` (round, base, tree) sees every tree as it is made."""
    rank = ranks(x)
    base = float(np.median(y)) if loss == "huber" else float(y.mean())
    now, trees = np.full(len(y), base), []
    for r in range(rounds):
        gap = y - now
        delta = lower_quantile(np.abs(gap), alpha) if loss == "huber" else np.inf
        drawn = (uniform(seed, r, keys, 11) < sample).astype(float)
        if not drawn.any():
            drawn[:] = 1.0
        tree, = grow(x, np.clip(gap, -delta, delta), drawn[None], "best", depth, leaf, 2, 1.0, seed, [r], rank)
        end = walk(tree, x)
        if loss == "huber":
            used = drawn > 0
            step = huber_step(gap[used], delta, end[used], len(tree.value))
            tree.value = np.where(tree.feature < 0, step, tree.value)
        tree.value = tree.value * rate
        now = now + tree.value[end]
        trees.append(tree)
        if each is not None:
            each(r, base, tree)
    return base, trees


def explain(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Path-dependent Shapley values of each row for one tree.

    A leaf pays out the product, over the features on its path, of "x is inside" (1 or 0) where a feature is known and of
    the share of training rows where it is not. With t the chance of being known, each factor is linear in t, and averaging
    over all orders is integrating over t, which a few points do exactly. Going down, a child's product is its parent's with one
    factor changed, so leaves share their paths; coming up, the leaves below an edge are added up, and the edge's feature
    is paid once for all of them. A second edge of the same feature takes its leaves out of the first one's account.
    """
    n, inner = len(x), tree.feature >= 0
    phi = np.zeros(x.shape)
    if not inner.any():
        return phi
    depth = np.zeros(len(tree.feature), int)
    for i in np.flatnonzero(inner):
        depth[tree.left[i]] = depth[tree.left[i] + 1] = depth[i] + 1
    points, weights = np.polynomial.legendre.leggauss(min(int(depth.max()), x.shape[1]) // 2 + 1)
    t, half = ((points + 1) / 2)[None, :], weights / 2

    def below(i: int, product: np.ndarray, known: dict) -> np.ndarray:
        """Sum over the leaves below node i of value times product."""
        f = tree.feature[i]
        if f < 0:
            return tree.value[i] * product
        out = np.zeros_like(product)
        goes_left = x[:, f] <= tree.cut[i]
        inside0, share0, factor0 = known.get(f, (np.ones(n), 1.0, None))
        for child, goes in ((tree.left[i], goes_left), (tree.left[i] + 1, ~goes_left)):
            inside, share = inside0 * goes, share0 * tree.cover[child] / tree.cover[i]
            factor = inside[:, None] * t + share * (1 - t)
            changed = product * factor if factor0 is None else product * (factor / factor0)
            part = below(child, changed, {**known, f: (inside, share, factor)})
            phi[:, f] += (inside - share) * ((part / factor) @ half)
            if factor0 is not None:
                phi[:, f] -= (inside0 - share0) * ((part / factor0) @ half)
            out += part
        return out

    below(0, np.ones((n, t.shape[1])), {})
    return phi
