"""Distinct counts with logarithmic-base set registers.

A set is held in M registers. An item chooses a register and a level by its
hash: level k or more with probability BASE ** (1 - k). A register keeps the
largest level it met, so sets are merged by taking the maximum of each
register, over days, groups or loads, in any order and any number of times. A
smaller base costs larger numbers in the registers and makes joint estimates of
two sets sharper.

Registers are rows (group, register, level): a group takes at most M rows and
only as many as it has items, a maximum is combined map-side, and the rows of a
hot group spread over the cluster by register. Everything up to the estimate
stays in built-in Spark operators.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.operators import skew
from quadlake.session import ship

#: Registers of a set, and the base of their levels.
M, BASE = 2048, 1.1
#: Standard errors of the stated bounds (95 %).
Z = 1.96
_SEED = 7919


def standard_error(m: int = M, base: float = BASE) -> float:
    """Relative standard error of an estimate."""
    return math.sqrt(((base + 1) / (base - 1) * math.log(base) - 1) / m)


def register_columns(item: Column, m: int = M, base: float = BASE) -> tuple[Column, Column]:
    """Register (below m) and level (from 1) of an item."""
    unit = (F.shiftrightunsigned(F.xxhash64(item, F.lit(_SEED)), 11) + 1) / F.lit(float(1 << 53))
    return F.pmod(F.xxhash64(item), F.lit(m)).cast("int"), F.floor(1 - F.log(unit) / F.lit(math.log(base))).cast("int")


def sketch(df: DataFrame, groups: Sequence[str], item: str, m: int = M, base: float = BASE) -> DataFrame:
    """Registers of every group: groups, reg, level. Null items are no items;
    a null in a group column is a group of its own."""
    reg, level = register_columns(F.col(item), m, base)
    rows = df.where(F.col(item).isNotNull()).select(*groups, reg.alias("reg"), level.alias("level"))
    return rows.groupBy(*groups, "reg").agg(F.max("level").alias("level"))


def merge(registers: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The registers of the unions by fewer group columns."""
    return registers.groupBy(*groups, "reg").agg(F.max("level").alias("level"))


def _sigma(x: np.ndarray, base: float) -> np.ndarray:
    """x + (base - 1) * sum of base^(k-1) * x^(base^k), k = 1, 2, ...; its share
    of the estimate is what empty registers tell. x is below 1."""
    out, power = x.copy(), 1.0
    with np.errstate(under="ignore"):
        while True:
            term = (base - 1) * power * x ** (power * base)
            out += term
            power *= base
            if not len(x) or (power > 1e3 * base and (term < 1e-12 * out).all()) or power > 1e9:
                return out


def estimates(used: np.ndarray, inverse: np.ndarray, m: int = M, base: float = BASE) -> np.ndarray:
    """Number of items from the number of used registers and their sum of
    base ** -level."""
    used, inverse = used.astype(float), inverse.astype(float)
    below = np.where(used > 0, 1 - used / m, 0.0)
    sums = m * _sigma(below, base) + inverse
    with np.errstate(divide="ignore"):
        found = m * m * (1 - 1 / base) / (math.log(base) * sums)
    return np.where(used > 0, found, 0.0)


def _estimate(m: int, base: float) -> Column:
    @F.pandas_udf("double")
    def found(used: pd.Series, inverse: pd.Series) -> pd.Series:
        return pd.Series(estimates(used.to_numpy(), inverse.to_numpy(), m, base))

    return found(F.col("_used"), F.col("_inverse"))


def count_groups(registers: DataFrame, groups: Sequence[str], m: int = M, base: float = BASE) -> DataFrame:
    """groups, estimate, rel_error (standard error), low and high (95 % bounds).

    A group without items has no registers and no row.
    """
    ship(registers.sparkSession)
    rows = registers.groupBy(*groups).agg(F.count(F.lit(1)).alias("_used"), F.sum(F.pow(F.lit(base), -F.col("level"))).alias("_inverse"))
    error = F.lit(standard_error(m, base))
    rows = rows.withColumn("estimate", _estimate(m, base)).drop("_used", "_inverse").withColumn("rel_error", error)
    return rows.withColumn("low", F.col("estimate") * (1 - Z * error)).withColumn("high", F.col("estimate") * (1 + Z * error))


def cube(df: DataFrame, groups: Sequence[str], item: str, m: int = M, base: float = BASE) -> DataFrame:
    """Distinct items of every combination of the group columns, of each of
    them and over all: level (names of the group columns used, joined by '+'),
    groups (null where not used), estimate, rel_error, low, high.

    The items are read once. Registers of the finest groups are merged upwards,
    each set of columns from one that has one column more. Empty input gives no
    rows.
    """
    groups = list(groups)
    kinds = dict(sketch(df, groups, item, m, base).dtypes)
    at: dict[tuple[str, ...], DataFrame] = {tuple(groups): sketch(df, groups, item, m, base)}
    for size in range(len(groups) - 1, -1, -1):
        for keep in combinations(groups, size):
            wider = next(k for k in at if len(k) == size + 1 and set(keep) < set(k))
            at[keep] = merge(at[wider], keep)
    out = None
    for keep, registers in at.items():
        columns = [F.col(g) if g in keep else F.lit(None).cast(kinds[g]).alias(g) for g in groups]
        rows = registers.select(F.lit("+".join(keep)).alias("level_of"), *columns, "reg", "level")
        out = rows if out is None else out.unionByName(rows)
    return count_groups(out, ["level_of", *groups], m, base)


# ------------------------------------------------------------- pairs of sets
def _log_likelihood(theta: np.ndarray, i: np.ndarray, j: np.ndarray, weight: np.ndarray, m: int, base: float) -> float:
    """Of register pairs (i, j), each weight times, if only the first set has
    exp(theta[0]) items, only the second exp(theta[1]) and both exp(theta[2])."""
    a, b, c = np.exp(theta) / m

    def below(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        p = np.exp(-a * base ** -x.astype(float) - b * base ** -y.astype(float) - c * base ** -np.minimum(x, y).astype(float))
        return np.where((x < 0) | (y < 0), 0.0, p)

    p = below(i, j) - below(i - 1, j) - below(i, j - 1) + below(i - 1, j - 1)
    return float((weight * np.log(np.maximum(p, 1e-300))).sum())


def joint_estimate(i: np.ndarray, j: np.ndarray, m: int = M, base: float = BASE) -> dict[str, float]:
    """Union, intersection and Jaccard of two sets from the levels of their
    registers (0 for an unused one), by maximum likelihood over the numbers of
    items only in the first, only in the second and in both.

    The errors are standard errors from the curvature of the likelihood at its
    maximum. Two empty sets have union 0 and Jaccard 1.
    """
    i, j = np.asarray(i, np.int64), np.asarray(j, np.int64)
    n = [float(estimates(np.array([(x > 0).sum()]), np.array([(float(base) ** -x[x > 0]).sum()]), m, base)[0]) for x in (i, j)]
    if not (i.any() or j.any()):
        return {"union": 0.0, "union_error": 0.0, "intersection": 0.0, "intersection_error": 0.0, "jaccard": 1.0, "jaccard_error": 0.0}
    pairs, weight = np.unique(np.stack([i, j]), axis=1, return_counts=True)
    floor = math.log(1e-3)

    def value(t: np.ndarray) -> float:
        return _log_likelihood(t, pairs[0], pairs[1], weight, m, base)

    def start(share: float) -> np.ndarray:
        both = share * min(n)
        return np.maximum(np.log([max(n[0] - both, 1e-3), max(n[1] - both, 1e-3), max(both, 1e-3)]), floor)

    theta = max((start(s) for s in (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)), key=value)
    step, best = np.full(3, 0.5), value(theta)
    while step.max() > 1e-5:  # coordinate search with growing and shrinking steps
        for k in range(3):
            for sign in (1, -1):
                t = theta.copy()
                t[k] = max(floor, t[k] + sign * step[k])
                if (v := value(t)) > best:
                    theta, best, step[k] = t, v, min(step[k] * 1.6, 2.0)
                    break
            else:
                step[k] /= 2
    x = np.exp(theta)
    x[x <= 2e-3] = 0.0
    union, both = x.sum(), x[2]
    covariance = _covariance(value, theta)
    scale = np.exp(theta)
    by_union, by_both = scale, np.array([0, 0, scale[2]])
    by_jaccard = (by_both * union - both * by_union) / union**2

    def error(g: np.ndarray) -> float:
        return float(math.sqrt(max(0.0, g @ covariance @ g)))

    return {
        "union": float(union), "union_error": error(by_union), "intersection": float(both), "intersection_error": error(by_both),
        "jaccard": float(both / union), "jaccard_error": error(by_jaccard),
    }


def _covariance(value, theta: np.ndarray, h: float = 1e-3) -> np.ndarray:
    """Inverse of the observed information of the parts that are not zero."""
    free = [k for k in range(3) if theta[k] > math.log(1e-2)]
    info = np.zeros((len(free), len(free)))
    for a, p in enumerate(free):
        for b, q in enumerate(free):
            d, e = np.zeros(3), np.zeros(3)
            d[p], e[q] = h, h
            info[a, b] = -(value(theta + d + e) - value(theta + d - e) - value(theta - d + e) + value(theta - d - e)) / (4 * h * h)
    out = np.zeros((3, 3))
    if free:
        out[np.ix_(free, free)] = np.linalg.pinv(info)
    return out


_JOINT = ["union", "union_error", "intersection", "intersection_error", "jaccard", "jaccard_error"]
#: A register and its level in one number: reg * LEVELS + level.
_LEVELS = 1 << 16


def packed_sets(registers: DataFrame, key: str) -> DataFrame:
    """key and _set: all registers of a set in one array of at most m numbers,
    whatever the size of the set; a set without registers has no row."""
    one = F.col("reg").cast("bigint") * _LEVELS + F.col("level")
    return registers.groupBy(key).agg(F.collect_list(one).alias("_set"))


def _levels(packed: np.ndarray | None, m: int) -> np.ndarray:
    out = np.zeros(m, np.int64)
    if packed is not None and len(packed):
        x = np.asarray(packed, np.int64)
        out[x // _LEVELS] = x % _LEVELS
    return out


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Small rows but much work each: dealt out to all tasks, by an expression
    the planner does not hold to be met already."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, F.xxhash64(*keys))


def joint_pairs(registers: DataFrame, key: str, pairs: DataFrame, m: int = M, base: float = BASE) -> DataFrame:
    """Joint estimates of the pairs of sets asked for: first, second, union,
    intersection, jaccard and their standard errors.

    pairs: first and second, keys of sets, one row a pair. A set is one row
    with an array of at most m numbers, joined once for each side of a pair; no
    set is held against all others. A set that many pairs ask for is spread over
    salts (for one set against all, see joint_with). A key without registers is
    an empty set; a pair of two such keys, or with a null, gives no row.
    """
    ship(registers.sparkSession)
    asked = pairs.select("first", "second").where("first is not null and second is not null").distinct()
    sets, n = packed_sets(registers, key), asked.count()
    rows = asked
    for side, name in (("first", "_i"), ("second", "_j")):
        own = sets.select(F.col(key).alias(side), F.col("_set").alias(name))
        hot = skew.hot_keys(asked, side, n)
        rows = skew.spread(rows, hot, side, F.struct("first", "second")).join(skew.replicate(own, hot, side), [side, "_salt"], "left").drop("_salt")
    rows = rows.where("_i is not null or _j is not null")

    @F.pandas_udf(", ".join(f"`{x}` double" for x in _JOINT))
    def joint(i: pd.Series, j: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([joint_estimate(_levels(x, m), _levels(y, m), m, base) for x, y in zip(i, j)], columns=_JOINT)

    return _dealt(rows, "first", "second").select("first", "second", joint("_i", "_j").alias("_e")).select("first", "second", "_e.*")


def joint_with(registers: DataFrame, key: str, common: object, m: int = M, base: float = BASE) -> DataFrame:
    """Joint estimates of every other set with one common set: key and the
    columns of joint_pairs.

    The common set is at most m registers, which go to the tasks as a constant,
    so nothing is joined. Null keys have no row; a common set without registers
    is empty.
    """
    ship(registers.sparkSession)
    known = registers.where(F.col(key) == F.lit(common)).select((F.col("reg").cast("bigint") * _LEVELS + F.col("level")).alias("x")).limit(m).collect()
    against = _levels(np.array([r.x for r in known], np.int64), m)
    others = packed_sets(registers.where(F.col(key) != F.lit(common)), key)

    @F.pandas_udf(", ".join(f"`{x}` double" for x in _JOINT))
    def joint(own: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([joint_estimate(_levels(x, m), against, m, base) for x in own], columns=_JOINT)

    return _dealt(others, key).select(key, joint("_set").alias("_e")).select(key, "_e.*")


def neighbours(registers: DataFrame, key: str, m: int = M, base: float = BASE) -> DataFrame:
    """Joint estimates of each key's set and the set of the key before it: key,
    previous, and the columns of joint_pairs.

    Every key but the first gives one row; a null key has no place in the
    order. Only the keys (days) are read to the driver, at most MAX_KEYS.
    """
    keys = [r[0] for r in registers.where(F.col(key).isNotNull()).select(key).distinct().orderBy(key).limit(MAX_KEYS + 1).collect()]
    if len(keys) > MAX_KEYS:
        raise ValueError(f"more than {MAX_KEYS} keys in one order")
    kind = registers.schema[key].dataType.simpleString()
    pairs = registers.sparkSession.createDataFrame(list(zip(keys, keys[1:], strict=False)), f"first {kind}, second {kind}")
    return joint_pairs(registers, key, pairs, m, base).withColumnsRenamed({"first": "previous", "second": key})


#: Keys in one order (days: 270 years).
MAX_KEYS = 100_000
