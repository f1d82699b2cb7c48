"""The role grammar of a conversation and its generalised LR repair.

Grammar: an optional system turn, then user and assistant turns in turn, or nothing at all (GRAMMAR). Its SLR tables are made from the
rules. A stack is a chain of (state, rest) nodes; equal nodes are one object, so stacks share their tails. All stacks that one prefix of
turns can lead to are kept side by side, each reached by edits of least (cost, audit); where two edits lead to equal stack tops the lesser stays.

Turns come as one symbol each: the role's initial s, u or a (o: any other), in upper case if its text is cut off, x if the turn must go.
Edits: K keep, R rerole to user or assistant, D delete, I insert a user or assistant turn; inserted turns may stand anywhere. The audit is the
string of edits in order.

A run of turns is summed up by what each stack at its start can lead to (`summary`), so runs can be worked on apart and joined in order (`join`).
Comparing by (cost, audit) run by run is exact: two edits of one run with equal cost that lead somewhere differ before either ends, since each turn gives one
letter, an insert costs and none ends a run.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

#: The rules, and the price of each edit.
GRAMMAR = (("S", ()), ("S", ("H", "P")), ("H", ()), ("H", ("s",)), ("P", ("T",)), ("P", ("P", "T")), ("T", ("u", "a")))
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
FREE = ("u", "a")  # roles that a rerole or an insert may give
ROLES = {"u": "user", "a": "assistant"}
END = "$"

Way = tuple[int, str]  # cost, audit


def _closure(items: Iterable[tuple[int, int]]) -> frozenset:
    seen, todo = set(items), list(items)
    while todo:
        rule, dot = todo.pop()
        body = RULES[rule][1]
        for other, (head, _) in enumerate(RULES):
            if dot < len(body) and body[dot] == head and (other, 0) not in seen:
                seen.add((other, 0))
                todo.append((other, 0))
    return frozenset(seen)


RULES = (("start", ("S",)), *GRAMMAR)


def _follow() -> dict[str, set]:
    heads = {h for h, _ in RULES}
    empty, first = set(), {h: set() for h in heads}
    follow = {h: set() for h in heads}
    follow["start"].add(END)
    for _ in range(len(RULES) * len(RULES)):
        for head, body in RULES:
            for symbol in body:
                first[head] |= first[symbol] if symbol in heads else {symbol}
                if symbol not in empty:
                    break
            else:
                empty.add(head)
            after = set(follow[head])
            for symbol in reversed(body):
                if symbol in heads:
                    follow[symbol] |= after
                    after = first[symbol] | (after if symbol in empty else set())
                else:
                    after = {symbol}
    return follow


class Tables:
    """SLR actions by (state, terminal): a state to go to, or the number of a rule to reduce by."""

    def __init__(self):
        states = [_closure([(0, 0)])]
        self.go: dict[tuple[int, str], int] = {}
        self.reduce: dict[tuple[int, str], int] = {}
        self.at_once: dict[int, int] = {}  # states that can do nothing but reduce
        follow = _follow()
        for i, items in enumerate(states):  # the list grows while it is read
            for symbol in sorted({RULES[r][1][d] for r, d in items if d < len(RULES[r][1])}):
                to = _closure([(r, d + 1) for r, d in items if RULES[r][1][d : d + 1] == (symbol,)])
                if to not in states:
                    states.append(to)
                self.go[i, symbol] = states.index(to)
            for r, d in items:
                if d == len(RULES[r][1]):
                    for terminal in follow[RULES[r][0]]:
                        assert self.reduce.setdefault((i, terminal), r) == r, "the grammar is not SLR"
                    if len(items) == 1 and r:
                        self.at_once[i] = r


class Stacks:
    """Stacks as shared chains, by number; 0 is the empty one."""

    def __init__(self):
        self.tables = Tables()
        self.nodes: list[tuple[int, int]] = [(0, -1)]
        self.known = {(0, -1): 0}

    def push(self, top: int, state: int) -> int:
        node = (state, top)
        if node not in self.known:
            self.known[node] = len(self.nodes)
            self.nodes.append(node)
        return self.known[node]

    def _reduced(self, top: int, rule: int) -> int:
        head, body = RULES[rule]
        for _ in body:
            top = self.nodes[top][1]
        return self.push(top, self.tables.go[self.nodes[top][0], head])

    def _ready(self, top: int, terminal: str) -> int:
        while (rule := self.tables.reduce.get((self.nodes[top][0], terminal))) is not None and rule:
            top = self._reduced(top, rule)
        return top

    def shift(self, top: int, terminal: str) -> int | None:
        top = self._ready(top, terminal)
        to = self.tables.go.get((self.nodes[top][0], terminal))
        if to is None:
            return None
        top = self.push(top, to)
        while (rule := self.tables.at_once.get(self.nodes[top][0])) is not None:
            top = self._reduced(top, rule)
        return top

    def accepts(self, top: int) -> bool:
        return (self.nodes[self._ready(top, END)][0], END) in self.tables.reduce


def _better(ways: dict[int, Way], top: int, way: Way) -> bool:
    if top in ways and ways[top] <= way:
        return False
    ways[top] = way
    return True


class Repair:
    def __init__(self):
        self.stacks = Stacks()
        self.tops = [0]
        for top in self.tops:  # every stack that some row of turns leads to
            for terminal in ("s", *FREE):
                to = self.stacks.shift(top, terminal)
                if to is not None and to not in self.tops:
                    self.tops.append(to)
            assert len(self.tops) < 64, "the grammar has too many stacks"
            assert sum(self.stacks.shift(top, t) is not None for t in FREE) < 2, "the audit must tell the role that an edit gives"
        self.padded = {top: self._inserts(top) for top in self.tops}
        self.edges = {(x, top): self._edges(x, top) for x in "suaoSUAOx" for top in self.tops}

    def _inserts(self, top: int) -> dict[int, Way]:
        """Where inserted turns alone can lead."""
        ways, todo = {top: (0, "")}, [top]
        while todo:
            at = todo.pop(0)
            for terminal in FREE:
                to = self.stacks.shift(at, terminal)
                if to is not None and _better(ways, to, (ways[at][0] + INSERT, ways[at][1] + "I")):
                    todo.append(to)
        return ways

    def _edges(self, symbol: str, top: int) -> list[tuple[int, int, str]]:
        """Where a turn, with inserts before it, can lead: (top, cost, letters)."""
        ways: dict[int, Way] = {}
        for at, (cost, letters) in self.padded[top].items():
            _better(ways, at, (cost + DELETE, letters + "D"))
            if symbol == "x":
                continue
            cut = CUT if symbol.isupper() else 0
            kept = self.stacks.shift(at, symbol.lower())
            if kept is not None:
                _better(ways, kept, (cost + KEEP + cut, letters + "K"))
            for role in FREE:
                to = self.stacks.shift(at, role)
                if to is not None and role != symbol.lower():
                    _better(ways, to, (cost + REROLE + cut, letters + "R"))
        return [(to, *way) for to, way in ways.items()]

    def parse(self, symbols: str, top: int) -> dict[int, Way]:
        ways: dict[int, Way] = {top: (0, "")}
        for symbol in symbols:
            after: dict[int, Way] = {}
            for at, (cost, audit) in ways.items():
                for to, more, letters in self.edges[symbol, at]:
                    _better(after, to, (cost + more, audit + letters))
            ways = after
        return ways

    def summary(self, symbols: str) -> str:
        """What a run of turns does to each stack: ``from,to,cost,audit`` joined by ``;``."""
        return ";".join(f"{top},{to},{cost},{audit}" for top in self.tops for to, (cost, audit) in self.parse(symbols, top).items())

    def join(self, summaries: Iterable[str]) -> Way:
        """The least (cost, audit) of the runs one after the other."""
        ways: dict[int, Way] = {0: (0, "")}
        for text in summaries:
            after: dict[int, Way] = {}
            for part in text.split(";"):
                top, to, cost, audit = part.split(",")
                if int(top) in ways:
                    before = ways[int(top)]
                    _better(after, int(to), (before[0] + int(cost), before[1] + audit))
            ways = after
        last: dict[int, Way] = {}
        for at, (cost, audit) in ways.items():
            for to, (more, letters) in self.padded[at].items():
                if self.stacks.accepts(to):
                    _better(last, 0, (cost + more, audit + letters))
        return last[0]

    def steps(self, symbols: str, audit: str) -> list[str]:
        """The edits of an audit with the roles they give, cut behind the last letter of each run of ``symbols`` (one run a line): K, D, u and a
        for reroles, U and A for inserts."""
        top, at, out = 0, 0, []
        runs = symbols.split("\n")
        for number, run in enumerate(runs):
            said, left = [], iter(run)
            need = len(run)
            while at < len(audit) and (need or number == len(runs) - 1):
                letter, at = audit[at], at + 1
                need -= letter != "I"
                symbol = next(left) if letter != "I" else ""
                if letter == "D":
                    said.append("D")
                    continue
                role = symbol.lower() if letter == "K" else next(r for r in FREE if self.stacks.shift(top, r) is not None)
                top = self.stacks.shift(top, role)
                said.append("K" if letter == "K" else role if letter == "R" else role.upper())
            out.append("".join(said))
        return out


@lru_cache(1)
def repairer() -> Repair:
    """One set of tables for each Python worker."""
    return Repair()


@lru_cache(1 << 16)
def summary(symbols: str) -> str:
    return repairer().summary(symbols)
