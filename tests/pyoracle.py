"""Independent scalar definitions of the metrics (from the formulas), for tests only."""

import difflib
import math
import re
import string
from fractions import Fraction

import numpy as np

_P = set(string.punctuation)


def norm(s):
    s = "" if s is None else str(s)
    s = "".join(ch for ch in s.strip().lower() if ch not in _P)
    s = re.sub(r"\s+", " ", s).strip()
    return " ".join(t for t in s.split() if t not in ("a", "an", "the"))


def toks(s):
    n = norm(s)
    return n.split() if n else []


def em(p, g):
    return 1.0 if norm(p) == norm(g) else 0.0


def _vectors(p, g):
    """Token counts of both sides over their joint vocabulary, as arrays."""
    a, b = toks(p), toks(g)
    vocab = sorted({*a, *b})
    return np.array([a.count(t) for t in vocab], float), np.array([b.count(t) for t in vocab], float)


def f1(p, g):
    """Twice the multiset intersection over both lengths, as a fraction."""
    x, y = _vectors(p, g)
    total = int(x.sum() + y.sum())
    return float(Fraction(2 * int(np.minimum(x, y).sum()), total)) if x.any() and y.any() else float(total == 0)


def jaccard(p, g):
    x, y = _vectors(p, g)
    if not x.any() or not y.any():
        return float(len(x) == 0)
    return float(np.mean((x > 0) & (y > 0)))


def lev(p, g):
    a, b = norm(p), norm(g)
    if not a and not b:
        return 1.0
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return 1.0 - prev[-1] / max(1, len(a), len(b))


def tfidf(p, g):
    """Cosine of the count vectors scaled by ln(3 / (1 + number of sides that have the term)) + 1;
    term frequencies only rescale a vector."""
    x, y = _vectors(p, g)
    if not len(x):
        return 1.0
    w = np.log(3 / (1 + (x > 0) + (y > 0))) + 1
    norm = np.linalg.norm(x * w) * np.linalg.norm(y * w)
    return float((x * w) @ (y * w) / norm) if norm else 0.0


def jsd(p, g):
    """H(m) - (H(p) + H(q)) / 2 in nats."""
    x, y = _vectors(p, g)
    if not x.any() or not y.any():
        return float(len(x) > 0)
    entropy = lambda v: -sum(t * math.log(t) for t in v if t > 0)
    x, y = x / x.sum(), y / y.sum()
    return entropy((x + y) / 2) - (entropy(x) + entropy(y)) / 2


def lcs_dp(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            dp[i][j] = dp[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(dp[i - 1][j], dp[i][j - 1])
    return dp[-1][-1]


def rouge_l(p, g):
    """Weighted harmonic mean of LCS precision and recall: beta^2 parts recall, one part precision."""
    a, b = toks(p), toks(g)
    common = lcs_dp(a, b)
    if not common:
        return 0.0
    beta2 = Fraction(144, 100)
    return float((1 + beta2) / (Fraction(len(a), common) + beta2 * Fraction(len(b), common)))


def seqmatch(p, g):
    return difflib.SequenceMatcher(None, norm(p), norm(g)).ratio()
