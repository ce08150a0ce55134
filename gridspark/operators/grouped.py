"""Whole groups out of sorted Arrow batches, without a Python call per group from the JVM side."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd


def group_starts(pdf: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Row numbers at which a new group begins; rows of a group are adjacent, NULL keys are equal."""
    new = np.zeros(len(pdf), bool)
    if len(pdf):
        new[0] = True
    for k in keys:
        x = pdf[k]
        gone = x.isna().to_numpy()
        v = x.to_numpy()
        same = np.asarray(v[1:] == v[:-1], bool)
        new[1:] |= ~(same | (gone[1:] & gone[:-1]))
    return np.nonzero(new)[0]


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str], at_once: int = 512) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows of up to ``at_once`` whole groups, row at which each begins); only the last group of a batch waits."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        if rest and not len(group_starts(pd.concat([rest[0].iloc[:1], pdf.iloc[[-1]]]), keys)[1:]):
            rest.append(pdf)  # sorted rows: all of it belongs to the group that waits
            continue
        if rest:
            pdf = pd.concat([*rest, pdf], ignore_index=True)
        start = group_starts(pdf, keys)
        for i in range(0, len(start) - 1, at_once):
            j = min(i + at_once, len(start) - 1)
            yield pdf.iloc[start[i]: start[j]].reset_index(drop=True), start[i:j] - start[i]
        rest = [pdf.iloc[start[-1]:].reset_index(drop=True)]
    if rest:
        yield pd.concat(rest, ignore_index=True) if len(rest) > 1 else rest[0], np.array([0])
