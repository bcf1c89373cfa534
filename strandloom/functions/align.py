"""Semiglobal alignment of pairs of texts, batched in numpy behind an Arrow function.

All pairs of an Arrow batch advance through the dynamic programme together: one
numpy operation per cell position serves the whole batch, so Python's cost is
per position, not per pair. Pairs are grouped by rounded lengths to limit
padding.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.seq import IUPAC

RESULT = "struct<ref_start:int,ref_end:int,query_start:int,query_end:int,matches:int,errors:int>"
#: Ends at which what hangs over costs nothing: all four of them in a semiglobal alignment.
SEMIGLOBAL = ("ref_start", "ref_end", "query_start", "query_end")
_FIELDS = ["ref_start", "ref_end", "query_start", "query_end", "matches", "errors"]
_BITS = {"A": 1, "C": 2, "G": 4, "T": 8}
_BATCH = 2048


def _coded(texts: list[str], width: int, wild: bool, side: int) -> np.ndarray:
    out = np.zeros((len(texts), width), np.int32)
    if wild:
        table = {**_BITS, **{k: sum(_BITS[b] for b in v) for k, v in IUPAC.items()}}
        for i, t in enumerate(texts):
            out[i, : len(t)] = [table.get(c.upper(), 0) for c in t]
    else:
        for i, t in enumerate(texts):
            out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int32) + 1
        out[out == 0] = -side  # padding equals nothing
    return out


def locate_batch(refs: list[str], queries: list[str], max_error: float, *, wildcards: bool = False, min_overlap: int = 1, free: Sequence[str] = SEMIGLOBAL) -> list[tuple[int, ...] | None]:
    """For each pair the best overlap as (ref_start, ref_end, query_start, query_end, matches, errors), or None.

    ``free`` names the ends where an overhang costs nothing; elsewhere the
    alignment must reach the end of the text. A match always takes the diagonal; otherwise a
    mismatch is preferred to an insertion, and that to a deletion. Best is more
    matches, then fewer errors, then the first found: along the last row by
    query place, then down the last column. Errors must stay within
    ``max_error`` of the aligned stretch of the reference.
    """
    count = len(refs)
    m, n = np.array([len(r) for r in refs]), np.array([len(q) for q in queries])
    height, width = int(m.max(initial=0)), int(n.max(initial=0))
    ref, query = _coded(refs, height, wildcards, 1), _coded(queries, width, wildcards, 2)
    limit = (max_error * m).astype(np.int64)
    rows = np.arange(height + 1)
    if unknown := set(free) - set(SEMIGLOBAL):
        raise ValueError(f"no end is named {', '.join(sorted(unknown))}")
    # Whatever the reference has before the alignment is skipped for nothing or deleted base by base.
    before = np.repeat(rows[:, None], count, axis=1).astype(np.int64)
    cost, origin = (np.zeros_like(before), -before) if "ref_start" in free else (before, np.zeros_like(before))
    hits = np.zeros((height + 1, count), np.int64)
    best = {"matches": np.zeros(count, np.int64), "cost": m + n, "origin": np.zeros(count, np.int64), "ref_end": m.copy(), "query_end": n.copy()}
    exact = np.zeros(count, bool)
    pick = np.arange(count)

    def consider(at: np.ndarray | int, ref_end: np.ndarray, query_end: np.ndarray | int, alive: np.ndarray) -> np.ndarray:
        c, h, o = cost[at, pick], hits[at, pick], origin[at, pick]
        length = ref_end + np.minimum(o, 0)
        good = alive & (length >= min_overlap) & (c <= length * max_error) & ((h > best["matches"]) | ((h == best["matches"]) & (c < best["cost"])))
        for key, value in (("matches", h), ("cost", c), ("origin", o), ("ref_end", ref_end), ("query_end", np.broadcast_to(query_end, count))):
            best[key] = np.where(good, value, best[key])
        return good & (c == 0) & (h == m)

    for j in range(1, width + 1):
        inside = (j <= n) & ~exact
        diag_cost, diag_hits, diag_origin = cost[0].copy(), hits[0].copy(), origin[0].copy()
        top = origin if "query_start" in free else cost
        top[0] = np.where(inside, j, top[0])
        letter = query[:, j - 1]
        for i in range(1, height + 1):
            old_cost, old_hits, old_origin = cost[i].copy(), hits[i].copy(), origin[i].copy()
            equal = (ref[:, i - 1] & letter) != 0 if wildcards else ref[:, i - 1] == letter
            mismatch, insertion, deletion = diag_cost + 1, cost[i - 1] + 1, old_cost + 1
            take_diag = equal | ((mismatch <= deletion) & (mismatch <= insertion))
            take_up = ~take_diag & (insertion <= deletion)
            new_cost = np.where(equal, diag_cost, np.where(take_diag, mismatch, np.where(take_up, insertion, deletion)))
            new_hits = np.where(take_diag, diag_hits + equal, np.where(take_up, hits[i - 1], old_hits))
            new_origin = np.where(take_diag, diag_origin, np.where(take_up, origin[i - 1], old_origin))
            cost[i] = np.where(inside, new_cost, old_cost)
            hits[i] = np.where(inside, new_hits, old_hits)
            origin[i] = np.where(inside, new_origin, old_origin)
            diag_cost, diag_hits, diag_origin = old_cost, old_hits, old_origin
        # A last-row match counts once the whole reference is within the error limit.
        if "query_end" in free:
            exact |= consider(m, m, j, inside & (cost[m, pick] <= limit))
    for i in range(height + 1):
        ends = (i <= m) if "ref_end" in free else (i == m)
        consider(np.minimum(i, m), np.full(count, i), n, ends & ~exact)
    found = best["cost"] != m + n
    start = best["origin"]
    out = np.stack([np.maximum(-start, 0), best["ref_end"], np.maximum(start, 0), best["query_end"], best["matches"], best["cost"]], axis=1)
    return [tuple(int(x) for x in row) if ok else None for row, ok in zip(out, found)]


def locate_many(refs: list[str | None], queries: list[str | None], max_error: float, **options: object) -> list[tuple[int, ...] | None]:
    """:func:`locate_batch` over any pairs, in groups of like lengths; None where either text is null or empty."""
    out: list[tuple[int, ...] | None] = [None] * len(refs)
    order = sorted((i for i in range(len(refs)) if refs[i] and queries[i]), key=lambda i: (len(refs[i]), len(queries[i])))
    for a in range(0, len(order), _BATCH):
        group = order[a : a + _BATCH]
        for i, result in zip(group, locate_batch([refs[i] for i in group], [queries[i] for i in group], max_error, **options)):
            out[i] = result
    return out


def locate(reference: Column, query: Column, max_error: float = 0.1, *, wildcards: bool = False, min_overlap: int = 1, free: Sequence[str] = SEMIGLOBAL) -> Column:
    """The best overlap of two text columns as a struct of places, matches and errors; null without one. Options as for :func:`locate_batch`."""

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([(f, pa.int32()) for f in _FIELDS])
        for refs, queries in batches:
            found = locate_many(refs.to_pylist(), queries.to_pylist(), max_error, wildcards=wildcards, min_overlap=min_overlap, free=free)
            yield pa.array([dict(zip(_FIELDS, x)) if x else None for x in found], kind)

    return run(reference, query)
