"""Token-sequence matching: exact window, edit distance, LCS, best window, alignment, highlighting.

Cheap tests come first: an exact window by array functions, then, for what is
left, windows by token overlap, by LCS and, of the best tenths, by edit distance.
Matching is between a row's own two sequences, so it runs inside the row or in
Arrow batches and shuffles nothing."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.runtime import ship

GAP = "-"


def find_exact(ref: Column, query: Column) -> Column:
    """First place at which ``query`` stands in ``ref`` as a run, or -1."""
    n = F.size(query)
    starts = F.when(F.size(ref) >= n, F.sequence(F.lit(0), F.size(ref) - n)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(F.filter(starts, lambda i: F.get(ref, i) == F.get(query, F.lit(0))), lambda i: F.slice(ref, i + 1, n) == query)
    return F.when(n > 0, F.coalesce(F.get(hits, F.lit(0)), F.lit(-1))).otherwise(-1)


def window_size(n: Column, ref_len: Column) -> Column:
    return F.least(n + 8, F.floor(n * 1.3).cast("int"), ref_len)


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two token lists, a row of the table at a time."""
    code: dict = {}
    x, y = (np.array([code.setdefault(t, len(code)) for t in s], np.int64) for s in (a, b))
    row = np.arange(len(y) + 1)
    place = np.arange(len(y) + 1)
    for i, c in enumerate(x):
        best = np.minimum(row[1:] + 1, row[:-1] + (y != c))
        row = np.minimum.accumulate(np.concatenate([[i + 1], best]) - place) + place  # insertions run along the row
    return int(row[-1])


def lcs_length(a: list, b: list) -> int:
    code: dict = {}
    x, y = (np.array([code.setdefault(t, len(code)) for t in s], np.int64) for s in (a, b))
    row = np.zeros(len(y) + 1, np.int64)
    for c in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == c)))
    return int(row[-1])


def align(a: list, b: list, sub: int = 1, dele: int = 1, ins: int = 1) -> tuple[int, list[tuple[int | None, int | None]]]:
    """Cost and the pairs of places of a least-cost alignment; None is a gap. On ties substitution before deletion before insertion; equal tokens always pair."""
    n, m = len(a), len(b)
    cost = np.zeros((n + 1, m + 1), np.int64)
    cost[:, 0], cost[0, :] = np.arange(n + 1) * dele, np.arange(m + 1) * ins
    move = np.zeros((n + 1, m + 1), np.int8)  # 0 pair, 1 deletion, 2 insertion
    move[1:, 0], move[0, 1:] = 1, 2
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if a[i - 1] == b[j - 1]:
                cost[i, j] = cost[i - 1, j - 1]
                continue
            ways = (cost[i - 1, j - 1] + sub, cost[i - 1, j] + dele, cost[i, j - 1] + ins)
            move[i, j] = ways.index(min(ways))
            cost[i, j] = min(ways)
    i, j, out = n, m, []
    while i or j:
        k = move[i, j]
        out.append((i - 1 if k != 2 else None, j - 1 if k != 1 else None))
        i, j = i - (k != 2), j - (k != 1)
    return int(cost[n, m]), out[::-1]


def best_window(query: list, ref: list, coverage: float = 0.3) -> tuple[int, int, int] | None:
    """(edit distance, start, end) of the best window of ``ref``.

    Windows that share too few tokens go; the rest is ranked by n + w - 2 LCS, and the
    best 30 per cent (ten at least) are compared by edit distance, the first of equals."""
    n = len(query)
    w = min(n + 8, int(1.3 * n), len(ref))
    if not n or not w:
        return None
    want, have, near = Counter(query), Counter(ref[:w]), []
    for s in range(len(ref) - w + 1):
        if s:
            have[ref[s - 1]] -= 1
            have[ref[s + w - 1]] += 1
        if sum(min(c, have[t]) for t, c in want.items()) / n >= coverage:
            near.append((n + w - 2 * lcs_length(query, ref[s : s + w]), s))
    near.sort()
    best = None
    for _, s in near[: max(10, int(0.3 * len(near)))]:
        d = edit_distance(query, ref[s : s + w])
        if best is None or d < best[0]:
            best = (d, s, s + w)
        if not d:
            break
    return best


def match(query: list, ref: list, ref_text: list) -> dict:
    """The stretch of the reference that the query stands for: exact, else the window tokens that align with a query token."""
    none = {"found": False, "exact": False, "start": -1, "end": -1, "distance": -1, "tokens": [], "text": [], "reason": ""}
    if not query or not ref:
        return none | {"reason": "empty input" if not query else "empty reference"}
    for s in range(len(ref) - len(query) + 1):
        if ref[s] == query[0] and ref[s : s + len(query)] == query:
            e = s + len(query)
            return none | {"found": True, "exact": True, "start": s, "end": e, "distance": 0, "tokens": ref[s:e], "text": ref_text[s:e]}
    if (best := best_window(query, ref)) is None:
        return none | {"reason": "no window shares enough tokens"}
    d, s, e = best
    kept = [s + j for i, j in align(query, ref[s:e])[1] if i is not None and j is not None]
    note = "input longer than reference" if len(query) > len(ref) else ""
    return none | {"found": bool(kept), "start": s, "end": e, "distance": d, "tokens": [ref[k] for k in kept], "text": [ref_text[k] for k in kept], "reason": note}


def highlight(query: list, ref: list, text: list) -> tuple[str, str, str, int]:
    """Query, reference and text with differing tokens in parentheses, and the edit distance. Gaps are places, not tokens, so a literal ``-`` is no gap."""
    if not ref:
        return " ".join(f"({t})" for t in query), "", "", len(query)
    distance, pairs = align(query, ref)
    q, r, x = [], [], []
    for i, j in pairs:
        same = i is not None and j is not None and query[i] == ref[j]
        mark = "{}" if same else "({})"
        if i is not None:
            q.append(mark.format(query[i]))
        if j is not None:
            r.append(mark.format(ref[j]))
            if j < len(text):
                x.append(mark.format(text[j]))
    return " ".join(q), " ".join(r), " ".join(x), distance


MATCH_SQL = "found boolean, exact boolean, start int, end int, distance int, tokens array<string>, text array<string>, reason string"


def match_rows(rows: DataFrame, query: str, ref: str, text: str, *keep: str) -> DataFrame:
    """``keep`` columns and the result of ``match`` for each row (arrays of tokens)."""
    ship(rows.sparkSession)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", " + MATCH_SQL

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [match(list(q), list(r), list(t)) for q, r, t in zip(b["_q"], b["_r"], b["_t"], strict=True)]
            yield pd.concat([b[list(keep)].reset_index(drop=True), pd.DataFrame(got, columns=["found", "exact", "start", "end", "distance", "tokens", "text", "reason"])], axis=1)

    return rows.select(*keep, F.col(query).alias("_q"), F.col(ref).alias("_r"), F.col(text).alias("_t")).mapInPandas(run, schema)


def match_counters(matched: DataFrame, limit: int = 5) -> DataFrame:
    """Rows, rows found, rows that differ in more than ``limit`` tokens, rows without a match."""
    return matched.agg(F.count("*").alias("n"), F.sum(F.col("found").cast("int")).alias("found"), F.sum((F.col("distance") > limit).cast("int")).alias("differ"), F.sum((~F.col("found")).cast("int")).alias("no_match"))


def edit_counts(pred: list[tuple[float, str]], target: list[tuple[float, str]], near: float = 1.0, far: float = 2.0) -> tuple[int, int]:
    """Least cost of turning predicted boundaries (time, mark) into the target ones, over the common length, and twice that length.

    A deletion costs 1; an insertion 1, and 1 more where the target's mark differs from the one before; keeping a
    boundary costs 1 for another mark and 1 for a shift of at least ``near`` and less than ``far``. In front of all
    predicted ones every insertion costs 2. Insertions run along a row, so a row is one running minimum."""
    n = min(len(pred), len(target))
    if not n:
        return 0, 0
    code: dict = {}
    p, q = (np.array([code.setdefault(m, len(code)) for _, m in x[:n]], np.int64) for x in (pred, target))
    at, goal = (np.array([t for t, _ in x[:n]], float) for x in (pred, target))
    insert = np.concatenate([[0], np.cumsum(1 + np.concatenate([[1], q[1:] != q[:-1]]))])
    row = 2 * np.arange(n + 1)
    for i in range(n):
        shift = np.abs(at[i] - goal)
        keep = row[:-1] + (q != p[i]) + ((shift >= near) & (shift < far))
        row = np.minimum.accumulate(np.concatenate([[i + 1], np.minimum(row[1:] + 1, keep)]) - insert) + insert
    return int(row[-1]), 2 * n


def edit_count_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, edits and most (the bound for a ratio) for rows with ``pred`` and ``target``: arrays of (t, mark) in order."""
    ship(rows.sparkSession)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tier = lambda x: [(r["t"], r["mark"]) for r in x]
            got = [edit_counts(tier(p), tier(q)) for p, q in zip(b["pred"], b["target"], strict=True)]
            yield pd.concat([b[list(keep)].reset_index(drop=True), pd.DataFrame(got, columns=["edits", "most"])], axis=1)

    return rows.select(*keep, "pred", "target").mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", edits bigint, most bigint")


def matched_pair_rows(rows: DataFrame, a: str, b: str, *keep: str) -> DataFrame:
    """``keep`` columns with i and j: a row for each matched pair of places of two token arrays."""
    ship(rows.sparkSession)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            got = [(*k, i, j) for p, q, *k in zip(x["_a"], x["_b"], *(x[c] for c in keep), strict=True) for i, j in matched_pairs(list(p), list(q))]
            yield pd.DataFrame(got, columns=[*keep, "i", "j"])

    return rows.select(*keep, F.col(a).alias("_a"), F.col(b).alias("_b")).mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", i int, j int")


def matched_pairs(pred: list[str], target: list[str]) -> list[tuple[int, int]]:
    """Places of an LCS of two mark lists; going back, a row is left only if the cell above is strictly better."""
    n, m = len(pred), len(target)
    code: dict = {}
    p, q = (np.array([code.setdefault(t, len(code)) for t in x], np.int64) for x in (pred, target))
    best = np.zeros((n + 1, m + 1), np.int64)
    for i in range(n):
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + (q == p[i])))
    out, i, j = [], n, m
    while i and j:
        if pred[i - 1] == target[j - 1]:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i - 1, j] > best[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]
