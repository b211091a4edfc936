"""Secret scans with one combined automaton.

All rules are compiled into one minimal deterministic automaton and every text is scanned once, byte by byte,
for all of them. Where a rule ends, the stretch between the nearest bytes that no match can hold is read from right to
left by the automaton of the reversed rules, which tells for all rules at once where matches start. From the leftmost
start, and then from the first one after each match, a third automaton, of rules that start where it does, runs as far as
the match can go; so rules' repeats are greedy. Matches whose key part is too short are dropped after that, as they use up their text.

Defined results: a null text counts as empty and has no spans; spans count code points, ends exclusive; repeated
rows give repeated results; columns other than doc_id and text are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import Automaton, compile_rules, scan
from .common import bytes_of, cols, slices


@dataclass(frozen=True)
class Rule:
    """kind; the expression; its group that must have at least this many bytes; whether those bytes count in the
    automaton too, which is worth its states where most matches are too short."""

    kind: str
    pattern: bytes
    group: int = 0
    least: int = 0
    counted: bool = False

    def scanned(self) -> bytes:
        return self.pattern.removesuffix(b"+") + b"{%d}" % self.least if self.counted else self.pattern

    def strict(self) -> bytes:
        """The rule with a last group that is long enough."""
        return self.pattern.removesuffix(b"+)") + b"{%d,})" % self.least if self.group else self.pattern


# The base rules and well-known shapes of keys.
BASE = (
    Rule("assign", rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", rb"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", rb"[0-9a-f]+", 0, 24, counted=True),
)
MORE = (
    Rule("key_block", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", rb"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = BASE + MORE) -> None:
        self.rules = rules
        self.automaton: Automaton = compile_rules([r.scanned() for r in rules])
        self.back: Automaton = compile_rules([r.pattern for r in rules], back=True)
        self.run: Automaton = compile_rules([r.pattern for r in rules] + [r.strict() for r in rules], anchored=True)
        self._to, self._kinds, self._hits = self.run.step.tolist(), self.run.class_of.tolist(), self.run.hits.tolist()
        n = self.run.n_classes
        self._dead = next((k for k, h in enumerate(self._hits) if not h and set(self._to[k * n : k * n + n]) == {k}), -1)

    def _end(self, part: bytes, at: int, i: int) -> tuple[int, bool]:
        """Where the longest match of a rule from this place ends, and whether its key part is long enough."""
        to, kinds, hits, n, dead = self._to, self._kinds, self._hits, self.run.n_classes, self._dead
        now, end, good, both = 0, at, False, len(self.rules)
        for k in range(at, len(part)):
            now = to[now * n + kinds[part[k]]]
            if now == dead:
                break
            if hits[now] >> i & 1:
                end, good = k + 1, bool(hits[now] >> (i + both) & 1)
        rule = self.rules[i]
        return end, good and (bool(rule.group) or end - at >= rule.least)

    def spans(self, buf: np.ndarray, offs: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """For each text that has any: (start, rule, end) in code points, sorted."""
        where, bits = scan(self.automaton, buf, offs)
        found: dict[int, list[tuple[int, int, int]]] = {}
        if not len(where):
            return found
        stops = np.flatnonzero(self.automaton.stops[buf[offs[0] : offs[-1]]]) + offs[0]
        doc = np.searchsorted(offs, where, "right") - 1
        k = np.searchsorted(stops, where)
        left = np.maximum(np.where(k > 0, stops[np.maximum(k - 1, 0)] + 1, 0) if len(stops) else 0, offs[doc])
        right = np.minimum(np.where(k < len(stops), stops[np.minimum(k, len(stops) - 1)], offs[-1]) if len(stops) else offs[-1], offs[doc + 1])
        todo: dict[tuple[int, int, int], int] = {}
        for d, lo, hi, b in zip(doc.tolist(), left.tolist(), right.tolist(), bits.tolist()):
            todo[d, lo, hi] = todo.get((d, lo, hi), 0) | b
        # Where matches start, for all these stretches at once.
        flat = np.concatenate([buf[lo:hi][::-1] for _, lo, hi in todo])
        edge = np.concatenate([[0], np.cumsum([hi - lo for _, lo, hi in todo])])
        from_right, starting = scan(self.back, flat, edge)
        first = np.searchsorted(from_right, edge)
        for k, ((d, lo, hi), b) in enumerate(todo.items()):
            part = buf[lo:hi].tobytes()
            starts = hi - lo - 1 - (from_right[first[k] : first[k + 1]][::-1] - edge[k])
            of = starting[first[k] : first[k + 1]][::-1]
            before = int(np.count_nonzero((buf[offs[d] : lo] & 0xC0) != 0x80))
            points = None
            for i in range(len(self.rules)):
                if b >> i & 1:
                    end = 0
                    for at in starts[(of >> i & 1) > 0].tolist():
                        if at < end:
                            continue
                        end, good = self._end(part, at, i)
                        if good:
                            if points is None:
                                points = np.concatenate([[0], np.cumsum((buf[lo:hi] & 0xC0) != 0x80)])
                            found.setdefault(d, []).append((before + int(points[at]), i, before + int(points[end])))
        for x in found.values():
            x.sort()
        return found


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, base: int = len(BASE)) -> DataFrame:
    """doc_id; n_<kind> for the first `base` rules; base_sha256 of their spans; spans: kind:start:end of all rules, comma-joined."""
    scanner = Scanner(rules)
    names = [r.kind for r in rules]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            buf, offs = bytes_of(batch.column("text"))
            for lo, hi in slices(offs, 4 << 20):
                found = scanner.spans(buf, offs[lo : hi + 1])
                n = np.zeros((base, hi - lo), np.int64)
                sums, spans = [none] * (hi - lo), [""] * (hi - lo)
                for d, x in found.items():
                    said = [f"{names[i]}:{s}:{e}" for s, i, e in x]
                    spans[d] = ",".join(said)
                    kept = [t for t, (_, i, _) in zip(said, x) if i < base]
                    sums[d] = hashlib.sha256(",".join(kept).encode()).hexdigest()
                    for _, i, _ in x:
                        if i < base:
                            n[i, d] += 1
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(lo, hi - lo)} | {f"n_{names[i]}": pa.array(n[i]) for i in range(base)} | {"base_sha256": pa.array(sums, pa.string()), "spans": pa.array(spans, pa.string())})

    kind = dict(docs.dtypes)["doc_id"]
    counts = "".join(f"n_{k} bigint, " for k in names[:base])
    return cols(docs, "doc_id", "text").mapInArrow(work, f"doc_id {kind}, {counts}base_sha256 string, spans string")
