"""Chains by walking from line to line, for tests: it knows nothing of darts and doubling."""

from collections import defaultdict


def walked_chains(lines, turn=True):
    """{name: nodes} of lines {name: nodes}: ends at one node are paired in order of names, and each chain is walked from its first line."""
    ends = defaultdict(list)
    for name in sorted(lines):
        for side in (0, 1):
            ends[lines[name][-side]].append((name, side))
    partner = {}
    for met in ends.values():
        if turn:
            pairs = zip(met[::2], met[1::2], strict=False)
        else:
            pairs = zip([e for e in met if e[1] == 1], [e for e in met if e[1] == 0], strict=False)
        for a, b in pairs:
            partner[a], partner[b] = b, a
    left, out = set(lines), {}
    for first in sorted(lines):
        if first not in left:
            continue
        left.discard(first)
        runs = [[(first, False)], []]
        for side, run in ((1, runs[0]), (0, runs[1])):  # from the tail, then from the head
            at = (first, side)
            while (at := partner.get(at)) is not None and at[0] in left:
                name, entered = at
                left.discard(name)
                run.append((name, entered == side))
                at = (name, 1 - entered)
        parts = [*((n, t) for n, t in reversed(runs[1])), *runs[0]]
        nodes = []
        for name, turned in parts:
            own = lines[name][::-1] if turned else list(lines[name])
            nodes += own[1:] if nodes else own
        out[first] = nodes
    return out
