"""Mixing sources to target weights: soft membership and nonnegative document rates.

The domains are those of the labelled table: `good` (quality 1, not toxic), `low` (quality 0) and `toxic`. A classifier
learnt from it (one FTRL-proximal model a domain, see toxicity.py) gives every document its posteriors p, which are
nonnegative and add up to one, so that a document belongs to each domain in part. With n tokens (words between white
space), a document's expected tokens in domain d are n * p[d]; the domains' totals are to be `targets` x `budget` x all tokens.

Rates start at one. Projected gradient steps lessen the squared misses of the domains' totals, weighed by the inverse of
M = sum(n p p')/sum(n) over the documents whose rate can still move; after each step the rates are projected on [0, most], and
a step that does not lessen the misses is halved. A rate follows from p and the steps' short vectors alone: each step is one
aggregation over the posteriors to a few sums, and neither rates nor posteriors ever reach the driver.

Nulls, ties, empties: null and empty texts have no tokens but a rate, from the intercepts; a null or repeated id is
a row like others; with no labels the posteriors are equal and the rates stay as near one as the targets let them; an empty table gives
no rows; other columns are ignored by rates() and kept by mixed_rows().
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import toxicity
from tallyforge.llm.shared import SOLID, buffers, slices, stored, text_or_empty, unused, words_of

#: Shares of the tokens by domain; steps at most, and the largest miss, as a share of all tokens, at which they end.
TARGETS = {"good": 0.86, "low": 0.10, "toxic": 0.04}
STEPS, CLOSE = 30, 1e-6


def domains(names: list[str]) -> list[Column]:
    """0/1 columns of the labelled table."""
    toxic, low = F.col("toxic") == 1, F.col("quality") == 0
    return [{"good": ~toxic & ~low, "low": low & ~toxic, "toxic": toxic}[name].cast("int") for name in names]


def posteriors(docs: DataFrame, labels: DataFrame, names: list[str]):
    """text column -> struct of tokens and p (an array in the order of names)."""
    shared = docs.sparkSession.sparkContext.broadcast(toxicity.trained(docs, labels, domains(names)))

    def score(texts: pa.Array) -> pa.Array:
        p = 1 / (1 + np.exp(-toxicity.margins(texts, shared.value)))
        p /= p.sum(1, keepdims=True)
        data, offsets = buffers(texts)
        n = [np.diff(words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SOLID)[2]) for i, j in slices(offsets, 1 << 20)]
        tokens = pa.array(np.concatenate([*n, np.zeros(0, np.int64)]), pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * len(names), pa.int32()), pa.array(p.reshape(-1)))
        return pa.StructArray.from_arrays([tokens, lists], ["tokens", "p"])

    return F.arrow_udf(score, "struct<tokens: bigint, p: array<double>>")


def rate(p: list[Column], steps: list[np.ndarray], most: float | None) -> Column:
    """The rate after the steps, for columns of posteriors."""
    out = F.lit(1.0)
    for g in steps:
        for x, step in zip(p, g, strict=True):
            out = out - x * float(step)
        out = F.greatest(F.lit(0.0), out)
        out = out if most is None else F.least(F.lit(float(most)), out)
    return out


def fitted(rows: DataFrame, targets: dict[str, float], budget: float | None = 1.0, most: float | None = None, spared: bool = False) -> tuple[list[np.ndarray], float]:
    """The steps' vectors, and the largest miss left by them as a share of all tokens, from rows with tokens and p. budget None: as
    many tokens as the targets allow without repeats. spared: a domain with fewer tokens than its goal is to keep all that it
    has, and shrinks no other."""
    names, k = list(targets), len(targets)
    share = np.array([targets[n] for n in names], float) / sum(targets.values())
    n, p = F.col("tokens").cast("double"), [F.col("p")[i] for i in range(k)]
    first = rows.agg(F.sum(n).alias("n"), *[F.sum(n * p[i]).alias(f"s{i}") for i in range(k)], *[F.sum(n * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
    if not first["n"]:
        return [], 0.0
    have = np.array([first[f"s{i}"] for i in range(k)]) / first["n"]
    m = np.array([[first[f"m{i}_{j}"] for j in range(k)] for i in range(k)]) / first["n"]
    if budget is None:
        budget = min(h / t for h, t in zip(have, share, strict=True) if t)
    goal, steps, scale = share * budget, [], 1.0
    if spared:
        goal = np.minimum(goal, have)
    direction = np.linalg.pinv(m, rcond=1e-9) @ (have - goal)
    for _ in range(STEPS):
        if np.abs(have - goal).max() <= CLOSE:
            break
        r = rate(p, [*steps, scale * direction], most)
        free = F.when((r > 0) & (r < most) if most is not None else r > 0, n).otherwise(0.0)  # rows that a small step moves
        got = rows.agg(*[F.sum(n * r * p[i]).alias(f"s{i}") for i in range(k)], *[F.sum(free * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
        now = np.array([got[f"s{i}"] for i in range(k)]) / first["n"]
        if np.linalg.norm(now - goal) >= np.linalg.norm(have - goal):
            scale /= 2
            continue
        steps.append(scale * direction)
        have, scale = now, 1.0
        m = np.array([[got[f"m{i}_{j}"] for j in range(k)] for i in range(k)]) / first["n"]
        direction = np.linalg.pinv(m, rcond=1e-6) @ (have - goal)
    return steps, float(np.abs(have - goal).max())


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = 1.0, most: float | None = None) -> DataFrame:
    """One row per document: doc_id, tokens, a posterior p_<domain> for each domain, rate, missed (the largest miss of a domain's
    total that the rates leave, as a share of all tokens: the same in each row)."""
    names = list(targets)
    rows = docs.select("doc_id", posteriors(docs, labels, names)(text_or_empty()).alias("x")).select("doc_id", "x.tokens", "x.p")
    rows = stored(rows, "mix-posteriors")
    steps, missed = fitted(rows, targets, budget, most)
    p = [F.col("p")[i] for i in range(len(names))]
    return rows.select("doc_id", "tokens", *[x.alias(f"p_{n}") for x, n in zip(p, names, strict=True)], rate(p, steps, most).alias("rate"), F.lit(missed).alias("missed"))


def mixed_rows(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = 1.0, most: float | None = 1.0, spared: bool = True) -> DataFrame:
    """The rows of docs, all columns, as often as their rates say: the whole part, and once more where a hash of the id and the
    text falls below the rest. By default no row is repeated, each domain is cut to its share of all tokens, and one that has fewer
    is kept and shrinks no other. A miss that the steps leave is warned of."""
    names = list(targets)
    x, times = unused(docs, "mix"), unused(docs, "times")
    scored = stored(docs.withColumn(x, posteriors(docs, labels, names)(text_or_empty())), "mix-scored")
    steps, missed = fitted(scored.select(f"{x}.tokens", f"{x}.p"), targets, budget, most, spared)
    if missed > 0.001:
        warnings.warn(f"mixing leaves a domain {missed:.4f} of all tokens from its target", stacklevel=2)
    r = rate([F.col(f"{x}.p")[i] for i in range(len(names))], steps, most)
    chance = F.pmod(F.xxhash64(F.lit(9), "doc_id", text_or_empty()), F.lit(1 << 30)) / F.lit(float(1 << 30))
    kept = scored.withColumn(times, F.floor(r + chance).cast("int")).filter(F.col(times) > 0)
    return (kept if most is not None and most <= 1 else kept.withColumn(times, F.explode(F.sequence(F.lit(1), times)))).select(*docs.columns)
