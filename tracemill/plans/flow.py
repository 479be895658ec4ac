"""The flow language of declared processes, compiled to a position automaton.

    flow  := part ('|' part)*
    part  := step ('->' step)*
    step  := (name | 'any' | '(' flow ')') ('*' | '+' | '?')?

A state is the occurrence of a name in the expression; state 0 is the start.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field

ANY = "any"
INFINITE = 1 << 20


class ConfigError(ValueError):
    """A declaration that cannot be used."""


_TOKEN = re.compile(r"\s*(->|[|()*+?]|[^\s|()*+?>-](?:[^\s|()*+?>-]|-(?!>))*)")


@dataclass
class _Part:
    empty: bool
    first: frozenset
    last: frozenset


@dataclass
class Flow:
    """``symbols[q]`` is the name of state q; ``follow[q]`` the states after it."""

    symbols: list = field(default_factory=lambda: [None])
    follow: list = field(default_factory=lambda: [set()])
    accept: set = field(default_factory=set)

    def names(self) -> set[str]:
        return {s for s in self.symbols[1:] if s != ANY}

    def distances(self) -> list[list[int]]:
        """Fewest steps from each state to each other."""
        out = []
        for q in range(len(self.symbols)):
            row = [INFINITE] * len(self.symbols)
            row[q] = 0
            todo = deque([q])
            while todo:
                x = todo.popleft()
                for r in sorted(self.follow[x]):
                    if row[r] == INFINITE:
                        row[r] = row[x] + 1
                        todo.append(r)
            out.append(row)
        return out

    def shortest_run(self) -> int:
        return min(self.distances()[0][q] for q in self.accept)

    def expected(self, q: int, shown: int = 4) -> str:
        """What may come after a state: the first of its names and how many more, or the end."""
        names = sorted({"any step" if self.symbols[r] == ANY else self.symbols[r] for r in self.follow[q]})
        if not names:
            return "end of process"
        return " | ".join(names[:shown]) + (f" … +{len(names) - shown} more" if len(names) > shown else "")


def parse_flow(text: str) -> Flow:
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ConfigError(f"cannot read the flow at {text[at:at + 20]!r}")
        tokens.append(m[1])
        at = m.end()
        while at < len(text) and text[at].isspace():
            at += 1
    flow, pos = Flow(), 0

    def peek() -> str | None:
        return tokens[pos] if pos < len(tokens) else None

    def step() -> _Part:
        nonlocal pos
        t = peek()
        if t is None or t in ("->", "|", ")", "*", "+", "?"):
            raise ConfigError(f"a step is missing before {t or 'the end'!r}")
        pos += 1
        if t == "(":
            part = choice()
            if peek() != ")":
                raise ConfigError("a ')' is missing")
            pos += 1
        else:
            q = len(flow.symbols)
            flow.symbols.append(t)
            flow.follow.append(set())
            part = _Part(False, frozenset([q]), frozenset([q]))
        while peek() in ("*", "+", "?"):
            op = tokens[pos]
            pos += 1
            if op in "*+":
                for q in part.last:
                    flow.follow[q] |= part.first
            part = _Part(part.empty or op in "*?", part.first, part.last)
        return part

    def chain() -> _Part:
        nonlocal pos
        part = step()
        while peek() == "->":
            pos += 1
            nxt = step()
            for q in part.last:
                flow.follow[q] |= nxt.first
            part = _Part(part.empty and nxt.empty, part.first | (nxt.first if part.empty else frozenset()), nxt.last | (part.last if nxt.empty else frozenset()))
        return part

    def choice() -> _Part:
        nonlocal pos
        part = chain()
        while peek() == "|":
            pos += 1
            other = chain()
            part = _Part(part.empty or other.empty, part.first | other.first, part.last | other.last)
        return part

    whole = choice()
    if pos != len(tokens):
        raise ConfigError(f"{tokens[pos]!r} is not expected here")
    flow.follow[0] = set(whole.first)
    flow.accept = set(whole.last) | ({0} if whole.empty else set())
    return flow


def align(flow: Flow, seq: list[str]) -> tuple[int, list[tuple[str, str, int]]]:
    """Least number of edits to a run of the flow, and the moves ``(kind, activity, index)``.

    Of several best alignments the one is taken whose moves, read from the end, prefer sync, then log,
    then model, then the lower state.
    """
    n_states = len(flow.symbols)
    before = [[q for q in range(n_states) if r in flow.follow[q]] for r in range(n_states)]
    rows, backs = [], []
    for i in range(len(seq) + 1):
        row, back = [INFINITE] * n_states, [None] * n_states
        if i == 0:
            row[0] = 0
        else:
            for r in range(n_states):
                if flow.symbols[r] in (seq[i - 1], ANY):
                    for q in before[r]:
                        if rows[i - 1][q] < row[r]:
                            row[r], back[r] = rows[i - 1][q], ("sync", q)
                if rows[i - 1][r] + 1 < row[r]:
                    row[r], back[r] = rows[i - 1][r] + 1, ("log", r)
        changed = True
        while changed:
            changed = False
            for r in range(n_states):
                for q in before[r]:
                    if row[q] + 1 < row[r]:
                        row[r], back[r], changed = row[q] + 1, ("model", q), True
        rows.append(row)
        backs.append(back)
    q = min(sorted(flow.accept), key=lambda x: rows[-1][x])
    cost, i, moves = rows[-1][q], len(seq), []
    while backs[i][q] is not None:
        kind, p = backs[i][q]
        if kind == "model":
            moves.append((kind, flow.expected(p), i))
        else:
            moves.append((kind, seq[i - 1], i - 1))
            i -= 1
        q = p
    return cost, moves[::-1]
