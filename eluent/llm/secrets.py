"""Secret scans: all rules in one combined deterministic automaton.

The rule expressions become one non-deterministic automaton, then by subset construction and minimisation one transition array
over byte classes. A text is read once, byte by byte, for all rules; numpy steps many stretches of a batch at a time. A stretch
begins after a byte that occurs in no rule, where no match can go on. In a stretch where the automaton accepts, the rule's automaton of the reversed
expression reads once from the end and marks where matches start; from each such place the rule's anchored automaton gives the leftmost longest
match, which is also the greedy one for these rules. The next match is looked for behind it, so that a stretch is read a fixed
number of times, however long it is, if an automaton that has accepted only goes on accepting or ends (as for all rules here).

``spans`` returns, for each document, every span (kind, start, end in code points, end exclusive). Null or empty texts have none. Repeated
rows are scanned each for itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


class Rule(NamedTuple):
    kind: str
    pattern: str
    ignore_case: bool = False
    #: The group that must have so many bytes, else the match is dropped.
    group: int = 0
    least: int = 1


# The base rules. Runs of 16 or more hex digits are asked for right away, so that not every word makes the automaton
# accept: the leftmost match of a run reaches to its end, so those that would be dropped hide no other match.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# What the scan adds, by the published forms of these tokens.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=36),
    Rule("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)


class Parser:
    """Rule expressions as nested tuples: ("set", bytes), ("seq", parts), ("alt", parts) and ("rep", least, most or None, part).

    Characters are ASCII; there are literals, ``\\`` before punctuation, ``\\xhh``, classes with ranges, groups, ``|`` and the greedy ``? * + {n} {n,} {n,m}``.
    """

    def __init__(self, pattern: str, ignore_case: bool):
        self.text, self.at, self.ignore_case = pattern, 0, ignore_case
        self.tree = self.ways()
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} at {self.at} of {pattern!r}")

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        if self.at > len(self.text):
            raise ValueError(f"{self.text!r} ends too early")
        return self.text[self.at - 1]

    def ways(self) -> tuple:
        found = [self.sequence()]
        while self.peek() == "|":
            self.take()
            found.append(self.sequence())
        return ("alt", found) if len(found) > 1 else found[0]

    def sequence(self) -> tuple:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.single()))
        return ("seq", parts)

    def repeated(self, part: tuple) -> tuple:
        least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(self.peek(), (1, 1))
        if self.peek() in ("?", "*", "+"):
            self.take()
        elif self.peek() == "{":
            first, comma, last = self.text[self.at + 1 : self.text.index("}", self.at)].partition(",")
            self.at = self.text.index("}", self.at) + 1
            least, most = int(first), (int(last) if last else None) if comma else int(first)
        return part if (least, most) == (1, 1) else ("rep", least, most, part)

    def single(self) -> tuple:
        c = self.take()
        if c == "(":
            inner = self.ways()
            if self.take() != ")":
                raise ValueError(f"{self.text!r} lacks a )")
            return inner
        if c == "[":
            return self.of(self.members())
        if c in "]{}?*+^$.":
            raise ValueError(f"rules have no {c}")
        return self.of({self.escaped() if c == "\\" else ord(c)})

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            return int(self.take() + self.take(), 16)
        if c.isalnum():
            raise ValueError(f"rules have no escape {c}")
        return ord(c)

    def members(self) -> set[int]:
        found: set[int] = set()
        if self.peek() == "^":
            raise ValueError("rules have no negated classes")
        while (c := self.take()) != "]":
            low = high = self.escaped() if c == "\\" else ord(c)
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                c = self.take()
                high = self.escaped() if c == "\\" else ord(c)
            found.update(range(low, high + 1))
        return found

    def of(self, members: set[int]) -> tuple:
        if self.ignore_case:
            members = members | {ord(f(chr(x))) for x in members if chr(x).isalpha() for f in (str.lower, str.upper)}
        if max(members) > 127:
            raise ValueError("rules are of ASCII characters")
        return ("set", frozenset(members))


class Nfa:
    """Thompson's construction; ``backwards`` for the reversed expression."""

    def __init__(self, backwards: bool = False):
        self.backwards = backwards
        self.byte: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.byte.append([])
        self.empty.append([])
        return len(self.byte) - 1

    def add(self, tree: tuple, at: int) -> int:
        kind, *rest = tree
        if kind == "set":
            to = self.state()
            self.byte[at].append((rest[0], to))
            return to
        if kind == "seq":
            for part in reversed(rest[0]) if self.backwards else rest[0]:
                at = self.add(part, at)
            return at
        to = self.state()
        if kind == "alt":
            for way in rest[0]:
                self.empty[self.add(way, at)].append(to)
            return to
        least, most, part = rest
        for _ in range(least):
            at = self.add(part, at)
        if most is None:
            self.empty[at].append(to)
            self.empty[self.add(part, to)].append(to)
            return to
        self.empty[at].append(to)
        for _ in range(most - least):
            at = self.add(part, at)
            self.empty[at].append(to)
        return to

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Dfa:
    """Transition arrays of ``rules``; ``anywhere``: a match may begin at any byte. State 0 is the initial one; ``accepts`` has a bit for each rule."""

    def __init__(self, rules: tuple[Rule, ...], anywhere: bool, backwards: bool = False):
        nfa = Nfa(backwards)
        start, finals = nfa.state(), {}
        for i, r in enumerate(rules):
            at = nfa.state()
            nfa.empty[start].append(at)
            finals[nfa.add(Parser(r.pattern, r.ignore_case).tree, at)] = 1 << i
        used = sorted(set().union(*(c for out in nfa.byte for c, _ in out)))
        # bytes that every transition treats alike form a class; class 0: bytes in no rule
        alike: dict[tuple, int] = {}
        self.classes = np.zeros(256, np.uint8)
        members = [-1]
        for b in used:
            key = tuple(b in c for out in nfa.byte for c, _ in out)
            if key not in alike:
                alike[key] = len(members)
                members.append(b)
            self.classes[b] = alike[key]
        self.resets = np.ones(256, bool)
        self.resets[used] = False

        first = nfa.closure([start])
        number, rows, todo = {first: 0}, [], [first]
        for states in todo:
            row = []
            for b in members:
                to = nfa.closure({t for s in states for c, t in nfa.byte[s] if b in c} | ({start} if anywhere else set()))
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            rows.append(row)
        table = np.array(rows, np.int64)
        accepts = np.array([sum({finals[s] for s in x if s in finals}) for x in todo], np.int64)

        # minimisation: split blocks of states until all of a block go to the same blocks
        block = np.unique(accepts, return_inverse=True)[1]
        while True:
            finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].reshape(-1)
            if finer.max() == block.max():
                break
            block = finer
        renumber = {int(block[0]): 0}
        for b in block.tolist():
            renumber.setdefault(b, len(renumber))
        block = np.array([renumber[b] for b in block.tolist()])
        of = np.unique(block, return_index=True)[1]
        self.table, self.accepts = block[table[of]].astype(np.int32), accepts[of].astype(np.int32)
        self.width = len(members)
        self.dead = next((i for i in range(len(of)) if not self.accepts[i] and (self.table[i] == i).all()), -1)


class Scanner:
    LANES, SHORT = 4096, 16

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.all = Dfa(rules, True)
        self.each = [Dfa((r,), False) for r in rules]
        self.back = [Dfa((r,), True, backwards=True) for r in rules]
        self.steps = [(d.table.tolist(), d.classes.tolist(), d.accepts.tolist(), d.dead) for d in self.each]
        self.starts = [(d.table.tolist(), d.classes.tolist(), d.accepts.tolist()) for d in self.back]
        self.checks = [re.compile(r.pattern.encode(), re.IGNORECASE if r.ignore_case else 0) for r in rules]
        self.flat = (self.all.table * self.all.width).ravel()  # a state stands for the place of its row
        self.hit = np.repeat(self.all.accepts, self.all.width)

    def accepted(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last bytes of matches in ``text`` and the rules' bits, by one pass over its bytes."""
        n = len(text)
        resets = np.flatnonzero(self.all.resets[text])
        lanes = min(self.LANES, n // 256 + 1)
        i = np.searchsorted(resets, np.arange(1, lanes) * (n // lanes))
        starts = np.unique(np.concatenate([[0], resets[i[i < len(resets)]] + 1]))
        starts = starts[starts < n]
        sizes = np.diff(np.append(starts, n))
        order = np.argsort(-sizes, kind="stable")
        at, left = starts[order], sizes[order]
        classes = self.all.classes[text]
        state = np.zeros(len(at), np.int32)
        active, t, found = len(at), 0, []
        while active > self.SHORT:
            state = self.flat.take(state[:active] + classes.take(at[:active] + t))
            bits = self.hit.take(state)
            if bits.any():
                k = np.flatnonzero(bits)
                found.append((at[k] + t, bits[k]))
            t += 1
            active = int(np.searchsorted(-left[:active], -t, "left"))  # stretches longer than t
        flat, hit = self.flat, self.hit
        for k in range(active):
            s, a = int(state[k]) if t else 0, int(at[k])
            for p, c in enumerate(classes[a + t : a + int(left[k])].tolist(), a + t):
                s = int(flat[s + c])
                if hit[s]:
                    found.append((np.array([p]), hit[s : s + 1]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def matches(self, text: bytes, rule: int, start: int, end: int) -> Iterator[tuple[int, int]]:
        """Leftmost longest matches of one rule in ``text[start:end]``, not overlapping; those that fail its length are dropped."""
        table, classes, accepts = self.starts[rule]
        s, begins = 0, []
        for i in range(end - 1, start - 1, -1):
            s = table[s][classes[text[i]]]
            if accepts[s]:
                begins.append(i)
        table, classes, accepts, dead = self.steps[rule]
        check, r, last = self.checks[rule], self.rules[rule], start
        for i in reversed(begins):
            if i < last:
                continue
            s = 0
            for j in range(i, end):
                s = table[s][classes[text[j]]]
                if s == dead:
                    break
                if accepts[s]:
                    last = j + 1
            if (len(check.fullmatch(text[i:last])[r.group]) if r.group else last - i) >= r.least:
                yield i, last

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) in bytes of each text, sorted."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        whole = b"\n".join(texts)
        if not whole:
            return found
        buf = np.frombuffer(whole, np.uint8)
        begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
        where, bits = self.accepted(buf)
        resets = np.flatnonzero(self.all.resets[buf])
        after = np.searchsorted(resets, where)  # a match lies between two bytes that are in no rule
        for k, rule in sorted({(k, r) for r in range(len(self.rules)) for k in after[bits >> r & 1 == 1].tolist()}):
            a, e = int(resets[k - 1]) + 1 if k else 0, int(resets[k]) if k < len(resets) else len(buf)
            doc = int(np.searchsorted(begins, a, "right")) - 1
            found[doc] += [(x - int(begins[doc]), rule, y - int(begins[doc])) for x, y in self.matches(whole, rule, a, e)]
        for x in found:
            x.sort()
        return found


def code_points(text: bytes) -> np.ndarray:
    """Code points before each byte of ``text``, and before its end."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)])


@cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) sorted by start, then by the order of ``rules``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in common.batches(it, 1_000):
            texts, out = common.text_bytes(b.column(1)), []
            for text, got in zip(texts, scan.spans(texts), strict=True):
                place = code_points(text) if got and not text.isascii() else None
                out.append([{"kind": rules[r].kind, "start": int(place[x]) if place is not None else x, "end": int(place[y]) if place is not None else y} for x, r, y in got])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as text."""
    base = [r.kind for r in BASE]
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(kinds))
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(of(base)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by Python's ``re``, for tests."""
    loose = {"hex": r"[0-9a-f]+"}
    found = []
    for i, r in enumerate(BASE):
        for m in re.finditer(loose.get(r.kind, r.pattern), text, (re.IGNORECASE | re.ASCII) if r.ignore_case else 0):
            if len(m[r.group]) >= {"assign": 12, "access": 18, "hex": 16}[r.kind]:
                found.append((m.start(), i, r.kind, m.end()))
    return [(k, a, e) for a, _, k, e in sorted(found)]


def base_digest(text: str | None) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{e}" for k, a, e in base_spans(text or "")).encode()).hexdigest()
