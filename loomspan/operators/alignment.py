"""Alignment of caption lists in order, one to one, at the greatest sum of token overlaps.

Two captions are alike by the F1 of their token multisets. Of alignments with the same
sum the one is taken that, going back from the ends, matches where it can, else leaves
out a predicted caption, else a target one. A plan has two levels: its actions are
aligned, then the segments of the actions that were matched.

Both lists of a row are aligned in an Arrow batch: the overlaps of a caption with all
targets come from the targets' tokens, a row of the table of sums is one running
maximum, and only the choices of a pair of lists are kept, a byte for each cell.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCEPTED = 0.5
#: Cells of a table of sums up to which it is filled cell by cell.
_SHORT = 400
_TOKEN = re.compile("[a-z0-9]+")
_MATCH, _LEAVE_PREDICTED, _LEAVE_TARGET = 2, 1, 0


@lru_cache(1 << 14)
def _bag(caption: str) -> Counter:
    return Counter(_TOKEN.findall(caption.casefold()))


@lru_cache(1 << 16)
def _overlap(left: str, right: str) -> float:
    a, b = _bag(left), _bag(right)
    if not a or not b:
        return float(not a and not b)
    shared = sum(min(n, b[t]) for t, n in a.items() if t in b)
    if not shared:
        return 0.0
    precision, recall = shared / a.total(), shared / b.total()
    return 2 * precision * recall / (precision + recall)


def overlaps(predicted: list[str], target: list[str]) -> np.ndarray:
    """F1 of the tokens of each predicted caption with each target one: 1 if both have none, 0 if one has."""
    bags = [_bag(t) for t in target]
    sizes = np.array([b.total() for b in bags], np.float64)
    holders: dict[str, tuple[list[int], list[int]]] = {}
    for j, bag in enumerate(bags):
        for token, n in bag.items():
            places, counts = holders.setdefault(token, ([], []))
            places.append(j)
            counts.append(n)
    out = np.zeros((len(predicted), len(target)))
    for i, caption in enumerate(predicted):
        bag = _bag(caption)
        if not bag:
            out[i] = sizes == 0
            continue
        shared = np.zeros(len(target))
        for token, n in bag.items():
            if token in holders:
                places, counts = holders[token]
                shared[places] += np.minimum(counts, n)
        some = shared > 0
        precision, recall = shared[some] / bag.total(), shared[some] / sizes[some]
        out[i, some] = 2 * precision * recall / (precision + recall)
    return out


def align(predicted: list[str], target: list[str]) -> tuple[float, list[tuple[int, int, float]]]:
    """The greatest sum, and the matches (place in predicted, place in target, overlap)."""
    if len(predicted) * len(target) <= _SHORT:
        return _align_short(predicted, target)
    alike = overlaps(predicted, target)
    sums = np.zeros(len(target) + 1)
    choices = np.empty(alike.shape, np.int8)
    for i, row in enumerate(alike):
        matched = np.where(row > 0, sums[:-1] + row, -1.0)
        best = np.maximum.accumulate(np.maximum(matched, sums[1:]))
        choices[i] = np.where(matched == best, _MATCH, np.where(sums[1:] == best, _LEAVE_PREDICTED, _LEAVE_TARGET))
        sums = np.append(0.0, best)
    matches = []
    i, j = len(predicted), len(target)
    while i and j:
        choice = choices[i - 1, j - 1]
        if choice == _MATCH:
            matches.append((i - 1, j - 1, float(alike[i - 1, j - 1])))
        i, j = i - (choice != _LEAVE_TARGET), j - (choice != _LEAVE_PREDICTED)
    return float(sums[-1]), matches[::-1]


def _align_short(predicted: list[str], target: list[str]) -> tuple[float, list[tuple[int, int, float]]]:
    """As align, cell by cell: arrays of a few cells cost more to make than to fill."""
    alike = [[_overlap(a, b) for b in target] for a in predicted]
    sums, choices = [0.0] * (len(target) + 1), []
    for row in alike:
        best, new, chosen = 0.0, [0.0], []
        for j, one in enumerate(row):
            matched = sums[j] + one if one > 0 else -1.0
            best = max(best, matched, sums[j + 1])
            chosen.append(_MATCH if matched == best else _LEAVE_PREDICTED if sums[j + 1] == best else _LEAVE_TARGET)
            new.append(best)
        choices.append(chosen)
        sums = new
    matches = []
    i, j = len(predicted), len(target)
    while i and j:
        choice = choices[i - 1][j - 1]
        if choice == _MATCH:
            matches.append((i - 1, j - 1, alike[i - 1][j - 1]))
        i, j = i - (choice != _LEAVE_TARGET), j - (choice != _LEAVE_PREDICTED)
    return sums[-1], matches[::-1]


_MATCHES = "matches array<struct<predicted:int,target:int,overlap:double>>"
_LISTS = f"n_predicted int, n_target int, total double, {_MATCHES}"


def _texts(values: Iterable | None) -> list[str]:
    return ["" if v is None else v for v in values] if values is not None else []


def _aligned(predicted: pd.Series, target: pd.Series) -> pd.DataFrame:
    rows = []
    for left, right in zip(predicted, target, strict=True):
        left, right = _texts(left), _texts(right)
        total, matches = align(left, right)
        rows.append((len(left), len(right), total, [{"predicted": i, "target": j, "overlap": s} for i, j, s in matches]))
    return pd.DataFrame(rows, columns=["n_predicted", "n_target", "total", "matches"])


_PLANS = f"{_LISTS}, segments array<string>, n_target_segments int, segment_score double, segment_coverage double"


def _aligned_plans(predicted: pd.Series, target: pd.Series) -> pd.DataFrame:
    rows = []
    for left, right in zip(predicted, target, strict=True):
        left, right = (list(plan) if plan is not None else [] for plan in (left, right))
        total, matches = align(_texts(a["caption"] for a in left), _texts(a["caption"] for a in right))
        said, wanted, scores, coverages = [], 0, [], []
        for i, j, _ in matches:
            own, true = _texts(left[i]["segments"]), _texts(right[j]["segments"])
            inner, pairs = align(own, true)
            said, wanted = said + own, wanted + len(true)
            scores.append(inner / max(len(own), len(true), 1))
            coverages.append(sum(s >= ACCEPTED for _, _, s in pairs) / max(len(true), 1))
        mean = lambda x: sum(x) / len(x) if x else 0.0
        rows.append((len(left), len(right), total, [{"predicted": i, "target": j, "overlap": s} for i, j, s in matches], said, wanted, mean(scores), mean(coverages)))
    return pd.DataFrame(rows, columns=["n_predicted", "n_target", "total", "matches", "segments", "n_target_segments", "segment_score", "segment_coverage"])


def _scores(a: str) -> dict[str, Column]:
    """Shares of an aligned pair of lists; a list without captions counts as one of one caption."""
    accepted = F.size(F.filter(f"{a}.matches", lambda m: m["overlap"] >= ACCEPTED))
    left, right = F.greatest(F.col(f"{a}.n_predicted"), F.lit(1)), F.greatest(F.col(f"{a}.n_target"), F.lit(1))
    return {"score": F.col(f"{a}.total") / F.greatest(left, right), "coverage": accepted / right, "extra": (F.col(f"{a}.n_predicted") - accepted) / left}


def caption_alignment(df: DataFrame, predicted: str, target: str) -> DataFrame:
    """df and ``alignment``: counts, total, matches, score (by the longer list), coverage of the target and extra predicted captions at an overlap of 0.5.

    predicted and target are arrays of captions; null arrays are empty, null captions are
    the empty text. Two captions without tokens are alike.
    """
    found = df.withColumn("__aligned", F.pandas_udf(_aligned, _LISTS)(predicted, target))
    own = F.struct("__aligned.*", *(c.alias(name) for name, c in _scores("__aligned").items()))
    return found.withColumn("alignment", own).drop("__aligned")


def _repeated(captions: Column) -> Column:
    """Share of the captions that repeat another one but for case and white space."""
    alike = F.transform(captions, lambda c: F.regexp_replace(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"\s+", " "))
    return (F.size(alike) - F.size(F.array_distinct(alike))) / F.greatest(F.size(alike), F.lit(1))


def plan_alignment(df: DataFrame, predicted: str, target: str, valid: str) -> DataFrame:
    """df and ``plan``: the alignment of two plans' actions, and of the segments of matched actions.

    predicted and target are array<struct<caption string, segments array<string>>>; null
    arrays are empty. The strict score is 0 where valid is not true; all others count an
    invalid prediction's captions as they are. Means over no matched action are 0.
    """
    sure = F.coalesce(F.col(valid), F.lit(False))
    own = df.withColumn("__plan", F.pandas_udf(_aligned_plans, _PLANS)(predicted, target))
    captions = F.transform(F.coalesce(F.col(predicted), F.array()), lambda a: a["caption"])
    shares = _scores("__plan")
    plan = F.struct(
        sure.alias("valid"),
        *(F.col(f"__plan.{c}") for c in ("n_predicted", "n_target", "total", "matches")),
        *(c.alias(name) for name, c in shares.items()),
        _repeated(captions).alias("repeated_actions"),
        F.size("__plan.segments").alias("n_segments"),
        F.col("__plan.n_target_segments"),
        _repeated(F.col("__plan.segments")).alias("repeated_segments"),
        F.col("__plan.segment_score"),
        F.col("__plan.segment_coverage"),
        F.when(sure, shares["score"]).otherwise(0.0).alias("strict_score"),
    )
    return own.withColumn("plan", plan).drop("__plan")
