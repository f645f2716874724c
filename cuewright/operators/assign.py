"""One-to-one assignment at the least total cost."""

from __future__ import annotations

import numpy as np

#: Farther than any column.
FAR = 1 << 61


def assign(costs: list[list[int]]) -> list[int]:
    """Column of each row, -1 if there are more rows than columns; ties go to the
    lower column. Shortest augmenting paths over potentials, n^2 m steps."""
    rows, columns = len(costs), len(costs[0]) if costs else 0
    if not columns:
        return [-1] * rows
    if rows > columns:
        back = assign([list(c) for c in zip(*costs, strict=True)])
        out = [-1] * rows
        for column, row in enumerate(back):
            out[row] = column
        return out
    u, v, owner = [0] * rows, [0] * columns, [-1] * columns
    for row in range(rows):
        dist, prev, done = [float("inf")] * columns, [-1] * columns, [False] * columns
        at, column, base = row, -1, 0
        while at >= 0:
            for j in range(columns):
                if not done[j] and (d := base + costs[at][j] - u[at] - v[j]) < dist[j]:
                    dist[j], prev[j] = d, column
            column = min((j for j in range(columns) if not done[j]), key=dist.__getitem__)
            base, done[column] = dist[column], True
            at = owner[column]
        for j in range(columns):
            if done[j] and j != column:
                u[owner[j]] += base - dist[j]
                v[j] -= base - dist[j]
        u[row] += base
        while column >= 0:
            before = prev[column]
            owner[column] = row if before < 0 else owner[before]
            column = before
    out = [-1] * rows
    for column, row in enumerate(owner):
        if row >= 0:
            out[row] = column
    return out


def assign_all(costs: np.ndarray) -> np.ndarray:
    """assign() of many tables of one shape: (table, row, column) to (table, row), by
    the same steps and ties, each taken by all tables that are still at it."""
    n, rows, columns = costs.shape
    out = np.full((n, rows), -1)
    if not columns:
        return out
    if rows > columns:
        back = assign_all(costs.transpose(0, 2, 1))
        np.put_along_axis(out, back, np.arange(columns)[None].repeat(n, 0), 1)
        return out
    u, v, owner = np.zeros((n, rows), np.int64), np.zeros((n, columns), np.int64), np.full((n, columns), -1)
    every = np.arange(n)
    for row in range(rows):
        dist, prev, done = np.full((n, columns), FAR), np.full((n, columns), -1), np.zeros((n, columns), bool)
        at, column, base, live = np.full(n, row), np.full(n, -1), np.zeros(n, np.int64), every
        while len(live):
            own, known = at[live], dist[live]
            d = costs[live, own] - v[live] + (base[live] - u[live, own])[:, None]
            better = ~done[live] & (d < known)
            known = np.where(better, d, known)
            dist[live], prev[live] = known, np.where(better, column[live][:, None], prev[live])
            found = np.where(done[live], FAR, known).argmin(1)
            column[live], base[live], done[live, found] = found, known[np.arange(len(live)), found], True
            at[live] = owner[live, found]
            live = live[at[live] >= 0]
        done[every, column] = False
        moved = np.where(done, base[:, None] - dist, 0)
        table, j = np.nonzero(moved)
        u[table, owner[table, j]] += moved[table, j]
        v -= moved
        u[:, row] += base
        live = every
        while len(live):
            own = column[live]
            before = prev[live, own]
            owner[live, own] = np.where(before < 0, row, owner[live, before])
            column[live] = before
            live = live[before >= 0]
    table, j = np.nonzero(owner >= 0)
    out[table, owner[table, j]] = j
    return out
