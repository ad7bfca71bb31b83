"""Causal discovery baselines.

The distributed part is one pass of moment sums over the data (a lagged
moment matrix for Granger, a correlation matrix for PC); the tests then run
on the small (variables x variables) matrices on the driver, as the matrices
are bounded by the variable count, not the row count.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinlake.plans.halo import bucket_window, drop_halo, with_halo
from clinlake.plans.prefix import row_index


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, qab, qap, qam = 1e-300, a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < 1e-15:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def f_sf(f: float, d1: float, d2: float) -> float:
    """Survival function of the F distribution."""
    if f <= 0:
        return 1.0
    return betainc_reg(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def lagged_moments(df: DataFrame, order: Sequence[str], variables: Sequence[str], maxlag: int) -> dict:
    """One pass: for every lag L <= maxlag, the moment matrix of
    [1, v_t, v_(t-1), ..., v_(t-maxlag) for all v] over rows with L lags available.

    Lags come from the halo plan over the global order, so no task holds the
    whole series.  Returns {L: (names, matrix, n)} (bounded by the variables)."""
    pos = row_index(df, [], list(order), "_pos")
    h = with_halo(pos, [], list(order), behind=maxlag)
    w = bucket_window([], list(order))
    cols = {}
    for v in variables:
        cols[f"{v}@0"] = F.col(v).cast("double")
        for k in range(1, maxlag + 1):
            cols[f"{v}@{k}"] = F.lag(F.col(v).cast("double"), k).over(w)
    lagged = drop_halo(h.select("_pos", "_halo", "_bkt", *[c.alias(n) for n, c in cols.items()]))
    names = ["1"] + list(cols)
    exprs = {n: (F.lit(1.0) if n == "1" else F.col(f"`{n}`")) for n in names}
    aggs = []
    for L in range(1, maxlag + 1):
        ok = F.col("_pos") > L
        aggs.append(F.count_if(ok).alias(f"n{L}"))
        for i, a in enumerate(names):
            for b in names[i:]:
                aggs.append(F.sum(F.when(ok, exprs[a] * exprs[b])).alias(f"m{L}|{a}|{b}"))
    row = lagged.agg(*aggs).collect()[0].asDict()  # one row of bounded size
    out = {}
    for L in range(1, maxlag + 1):
        m = np.zeros((len(names), len(names)))
        for i, a in enumerate(names):
            for j, b in enumerate(names[i:], start=i):
                m[i, j] = m[j, i] = row[f"m{L}|{a}|{b}"] or 0.0
        out[L] = (names, m, int(row[f"n{L}"]))
    return out


def _rss(m: np.ndarray, names: list[str], y: str, xs: list[str]) -> float:
    idx = [names.index(x) for x in xs]
    iy = names.index(y)
    xtx = m[np.ix_(idx, idx)]
    xty = m[idx, iy]
    beta = np.linalg.lstsq(xtx, xty, rcond=None)[0]
    return float(m[iy, iy] - beta @ xty)


def granger_pairs(df: DataFrame, order: Sequence[str], variables: Sequence[str], maxlag: int = 2,
                  alpha: float = 0.05, min_rows: int = 20) -> DataFrame:
    """Pairwise Granger F-tests (sum-of-squares form): for every ordered pair
    (cause x, effect y) and lag L, y_t on its own L lags vs. also x's L lags;
    p = min over L of the F-test p-value.  Pairs with fewer than ``min_rows``
    rows are skipped."""
    mom = lagged_moments(df, order, variables, maxlag)
    rows = []
    for y in variables:
        for x in variables:
            if x == y:
                continue
            ps = []
            for L in range(1, maxlag + 1):
                names, m, n = mom[L]
                if n + L < min_rows:
                    continue
                own = ["1"] + [f"{y}@{k}" for k in range(1, L + 1)]
                full = own + [f"{x}@{k}" for k in range(1, L + 1)]
                rss_r, rss_u = _rss(m, names, f"{y}@0", own), _rss(m, names, f"{y}@0", full)
                dfd = n - 2 * L - 1
                if dfd <= 0 or rss_u <= 0:
                    continue
                fstat = ((rss_r - rss_u) / L) / (rss_u / dfd)
                ps.append(f_sf(fstat, L, dfd))
            if ps:
                p = min(ps)
                rows.append((x, y, float(p), bool(p < alpha)))
    return df.sparkSession.createDataFrame(rows, "cause string, effect string, p_value double, significant boolean")


def pc_skeleton(corr: np.ndarray, n: int, names: Sequence[str], alpha: float = 0.05) -> list[tuple[str, str]]:
    """Stable PC skeleton with Fisher-z partial-correlation tests on a
    correlation matrix (small, variables x variables).  Returns adjacent pairs
    in both directions (the reference lists every non-zero graph entry)."""
    k = len(names)
    adj = {i: set(range(k)) - {i} for i in range(k)}
    level = 0
    while any(len(adj[i]) - 1 >= level for i in range(k)):
        snapshot = {i: set(a) for i, a in adj.items()}
        for i, j in itertools.combinations(range(k), 2):
            if j not in adj[i]:
                continue
            removed = False
            for base in (snapshot[i] - {j}, snapshot[j] - {i}):
                if len(base) < level:
                    continue
                for cond in itertools.combinations(sorted(base), level):
                    if _fisher_p(corr, n, i, j, list(cond)) > alpha:
                        adj[i].discard(j)
                        adj[j].discard(i)
                        removed = True
                        break
                if removed:
                    break
        level += 1
    return [(names[i], names[j]) for i in range(k) for j in sorted(adj[i])]


def _fisher_p(corr: np.ndarray, n: int, i: int, j: int, cond: list[int]) -> float:
    idx = [i, j] + cond
    sub = corr[np.ix_(idx, idx)]
    prec = np.linalg.pinv(sub)
    r = -prec[0, 1] / math.sqrt(prec[0, 0] * prec[1, 1])
    r = max(min(r, 1 - 1e-12), -1 + 1e-12)
    z = 0.5 * math.log((1 + r) / (1 - r)) * math.sqrt(max(n - len(cond) - 3, 1))
    return math.erfc(abs(z) / math.sqrt(2))


def pc_edges(df: DataFrame, variables: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """PC skeleton edges of the numeric ``variables`` (rows with nulls dropped):
    correlation matrix by MLlib in one pass, tests on the driver-side matrix."""
    from pyspark.ml.stat import Correlation
    from pyspark.ml.feature import VectorAssembler
    d = df.select(*variables).dropna()
    n = d.count()
    vec = VectorAssembler(inputCols=list(variables), outputCol="_v").transform(d)
    corr = Correlation.corr(vec, "_v", "pearson").head()[0].toArray()
    edges = pc_skeleton(corr, n, variables, alpha)
    return df.sparkSession.createDataFrame(edges, "source string, target string")
