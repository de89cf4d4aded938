"""Alignments of two strings or lists, in plain Python."""

from __future__ import annotations


def edit_ops(ref: str, hyp: str) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of a shortest alignment; on ties substitutions before deletions before insertions."""
    n, m = len(ref), len(hyp)
    cost = [list(range(m + 1))]
    for i in range(1, n + 1):
        row, last = [i], cost[-1]
        for j in range(1, m + 1):
            row.append(min(last[j - 1] + (ref[i - 1] != hyp[j - 1]), last[j] + 1, row[j - 1] + 1))
        cost.append(row)
    s = d = k = 0
    i, j = n, m
    while i or j:
        here = cost[i][j]
        if i and j and here == cost[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]):
            s += ref[i - 1] != hyp[j - 1]
            i, j = i - 1, j - 1
        elif i and here == cost[i - 1][j] + 1:
            d, i = d + 1, i - 1
        else:
            k, j = k + 1, j - 1
    return s, d, k


def local_alignment(ref: str, text: str) -> tuple[int, int, int]:
    """Edits, start and end of the stretch of text closest to ref: fewest edits, then nearest in length, then leftmost."""
    m = len(text)
    row = [(0, j) for j in range(m + 1)]
    for i, a in enumerate(ref, 1):
        new = [(i, 0)]
        for j, b in enumerate(text, 1):
            new.append(min((row[j - 1][0] + (a != b), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[j - 1][0] + 1, new[j - 1][1])))
        row = new
    edits, _, start, end = min((e, abs(j - s - len(ref)), s, j) for j, (e, s) in enumerate(row))
    return edits, start, end
