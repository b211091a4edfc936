"""One deterministic automaton for many byte regexes.

Rules are parsed, laid out as one nondeterministic automaton that may start at any byte, made deterministic by
subset construction over byte classes, and minimised by partition refinement. The result is a transition array.
The same is made of the reversed rules, which read from right to left tells where matches start, and of rules that
may only start at the first byte.
scan() runs it over many pieces of text in step, so that each byte of the input is looked at once for all rules."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

try:
    from re import _constants as C
    from re import _parser as P
except ImportError:  # older interpreters
    import sre_constants as C
    import sre_parse as P

#: Bytes of a piece, about; pieces end at bytes that stop every rule.
PIECE = 2048
#: Up to so many pieces are finished one after the other.
FEW = 8


class _Nfa:
    def __init__(self) -> None:
        self.free: list[set[int]] = []
        self.on: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.free.append(set())
        self.on.append([])
        return len(self.free) - 1

    def add(self, tree, at: int, fold: bool) -> int:
        for op, arg in tree:
            at = self.one(op, arg, at, fold)
        return at

    def one(self, op, arg, at: int, fold: bool) -> int:
        if op in (C.LITERAL, C.NOT_LITERAL, C.ANY, C.IN):
            to = self.state()
            self.on[at].append((frozenset(_bytes(op, arg, fold)), to))
            return to
        if op is C.SUBPATTERN:
            _, plus, minus, tree = arg
            return self.add(tree, at, (fold or bool(plus & re.IGNORECASE)) and not minus & re.IGNORECASE)
        if op is C.BRANCH:
            to = self.state()
            for tree in arg[1]:
                start = self.state()
                self.free[at].add(start)
                self.free[self.add(tree, start, fold)].add(to)
            return to
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, tree = arg
            for _ in range(least):
                at = self.add(tree, at, fold)
            if most is C.MAXREPEAT:
                loop = self.state()
                self.free[at].add(loop)
                self.free[self.add(tree, loop, fold)].add(loop)
                return loop
            ends = [at]
            for _ in range(most - least):
                ends.append(at := self.add(tree, at, fold))
            to = self.state()
            for end in ends:
                self.free[end].add(to)
            return to
        raise ValueError(f"a rule may not use {op}")


def _bytes(op, arg, fold: bool) -> set[int]:
    if op is C.ANY:
        return set(range(256)) - {10}
    if op is C.LITERAL:
        found = {arg}
    elif op is C.NOT_LITERAL:
        return set(range(256)) - _bytes(C.LITERAL, arg, fold)
    else:
        found, turn = set(), False
        for kind, x in arg:
            if kind is C.NEGATE:
                turn = True
            elif kind is C.LITERAL:
                found.add(x)
            elif kind is C.RANGE:
                found |= set(range(x[0], x[1] + 1))
            else:
                raise ValueError(f"a class may not use {kind}")
        if turn:
            return set(range(256)) - found
    if fold:
        found |= {ord(c) for x in found for c in (chr(x).lower(), chr(x).upper()) if x < 128}
    return found


@dataclass(frozen=True)
class Automaton:
    """step[s * n_classes + class_of[b]] is the state after byte b in state s; hits[s] has a bit for each rule that ends there."""

    class_of: np.ndarray
    step: np.ndarray
    n_classes: int
    hits: np.ndarray
    first_hit: int  # states from here on end some rule
    stops: np.ndarray  # bytes after which every state is the start: no match holds them


def compile_rules(patterns: list[bytes], back: bool = False, anchored: bool = False) -> Automaton:
    """back: of the rules read from right to left. anchored: they start at the first byte only."""
    nfa = _Nfa()
    root = nfa.state()
    ends: dict[int, int] = {}
    rims = []
    for k, pattern in enumerate(patterns):
        start = nfa.state()
        rims.append((start, nfa.add(P.parse(pattern), start, False)))
    if back:
        free, on = nfa.free, nfa.on
        nfa.free, nfa.on = [set() for _ in free], [[] for _ in on]
        for s in range(len(free)):
            for t in free[s]:
                nfa.free[t].add(s)
            for x, t in on[s]:
                nfa.on[t].append((x, s))
        rims = [(b, a) for a, b in rims]
    for k, (start, end) in enumerate(rims):
        nfa.free[root].add(start)
        ends[end] = ends.get(end, 0) | 1 << k

    sets = {x for row in nfa.on for x, _ in row}
    kinds: dict[tuple, int] = {}
    ordered = sorted(sets, key=sorted)
    class_of = np.array([kinds.setdefault(tuple(b in x for x in ordered), len(kinds)) for b in range(256)], np.uint8)
    example = {int(c): b for b, c in reversed(list(enumerate(class_of)))}

    def closed(state: int) -> int:
        """The states reached from one without reading, as bits."""
        seen, todo = {state}, [state]
        while todo:
            for x in nfa.free[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        return sum(1 << x for x in seen)

    closure = [closed(s) for s in range(len(nfa.free))]
    moves = [[0] * len(kinds) for _ in nfa.free]
    for s, row in enumerate(nfa.on):
        for x, t in row:
            for c in range(len(kinds)):
                if example[c] in x:
                    moves[s][c] |= closure[t]

    begin = closure[root]
    names, todo, rows, hits = {begin: 0}, [begin], [], []
    while len(rows) < len(todo):
        left, to, hit = todo[len(rows)], [0 if anchored else begin] * len(kinds), 0
        while left:
            low = left & -left
            s = low.bit_length() - 1
            left ^= low
            hit |= ends.get(s, 0)
            if nfa.on[s]:
                to = [x | y for x, y in zip(to, moves[s])]
        for x in to:
            if x not in names:
                names[x] = len(names)
                todo.append(x)
        rows.append([names[x] for x in to])
        hits.append(hit)
    step, hits = np.array(rows), np.array(hits, np.int64)

    part = np.unique(hits, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    one = np.unique(part, return_index=True)[1]  # a member of each part
    order = sorted(range(len(one)), key=lambda p: (hits[one[p]] != 0, part[0] != p))  # start first, ends last
    number = np.empty(len(one), np.int64)
    number[order] = np.arange(len(one))
    small = number[part[step[one[order]]]]
    small_hits = hits[one[order]]
    dead = (small == 0).all(axis=0)
    return Automaton(class_of, small.astype(np.int32).ravel(), len(kinds), small_hits, int((small_hits == 0).sum()), dead[class_of])


def scan(a: Automaton, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where rules end: positions in buf (of the last byte of a match) and their rule bits, by position.

    Texts are buf[offs[i]:offs[i + 1]]; no match crosses from one to the next."""
    base, end = int(offs[0]), int(offs[-1])
    if end == base:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stops = np.flatnonzero(a.stops[buf[base:end]]) + base + 1
    cuts = [offs[:-1][np.diff(offs) > 0]]
    long = np.flatnonzero(np.diff(offs) > PIECE)
    for i in long:  # the first stop after each multiple of PIECE
        at = np.searchsorted(stops, np.arange(offs[i] + PIECE, offs[i + 1], PIECE))
        at = np.unique(stops[at[at < len(stops)]])
        cuts.append(at[at < offs[i + 1]])
    starts = np.unique(np.concatenate(cuts))
    lengths = np.diff(np.append(starts, end))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")  # pieces longer than t
    state = np.zeros(len(starts), np.int32)
    where, bits = [], []
    cls = a.class_of
    for t, n in enumerate(active):
        if n <= FEW:  # pieces without a stop for long: one by one
            break
        now = a.step[state[:n] * a.n_classes + cls[buf[starts[:n] + t]]]
        state[:n] = now
        if now.max() >= a.first_hit:
            k = np.flatnonzero(now >= a.first_hit)
            where.append(starts[k] + t)
            bits.append(a.hits[now[k]])
    else:
        n = 0
    if n:
        to, kinds = a.step.tolist(), cls.tolist()
        for s, length, now in zip(starts[:n].tolist(), lengths[:n].tolist(), state[:n].tolist()):
            at = []
            for i, byte in enumerate(buf[s + t : s + length].tobytes(), s + t):
                now = to[now * a.n_classes + kinds[byte]]
                if now >= a.first_hit:
                    at.append((i, a.hits[now]))
            if at:
                found = np.array(at)
                where.append(found[:, 0])
                bits.append(found[:, 1])
    if not where:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where, bits = np.concatenate(where), np.concatenate(bits)
    order = np.argsort(where, kind="stable")
    return where[order], bits[order]
