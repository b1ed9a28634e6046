"""Weighted finite-state transducers over words, their composition, and its determinization as it is needed.

The alphabet of a machine is sets of tags: what a word is. A transducer reads the tags of a word and writes further tags
at the word that ends a match of one of its rules; the next transducer of the composition reads both. The last one
writes weights. Every transducer has finitely many states (how far which rules have got and how many words may still lie
between), hence so has the composition: it is determinized state by state, when a state and a symbol first meet, and from
then on a word costs one look-up, however many rules there are.

Two context machines run beside: one for negation, kept in the states of the rules (how many words ago a negation stood
between the words of a match), and one for reported speech, whose state when a match begins decides whether the match is
what others say.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

#: How far before the last word of a match a negation counts.
NEGATION_REACH = 3
#: What is left of the weight of a match that is reported.
REPORTED = 0.4
#: States that are kept; beyond, the machine is forgotten and built anew.
MOST_STATES = 200_000


@dataclass(frozen=True)
class Element:
    """A word with one of ``names`` among its tags, or any word with none of ``other`` if there are no names, after at most
    ``gap`` words without any of ``bars``."""

    gap: int
    bars: frozenset
    names: frozenset
    other: frozenset = frozenset()

    def meets(self, tags: frozenset) -> bool:
        return bool(tags & self.names) if self.names else not tags & self.other


@dataclass(frozen=True)
class Rule:
    elements: tuple[Element, ...]
    mark: str | None = None
    weight: float = 0.0
    negatable: bool = False


def parse(line: str, fold: Callable[[str], str], longest: dict[str, int]) -> Rule:
    """A rule as text: ``mark or weight: element ...``. An element is tags in capitals, words or signs joined by ``|``;
    ``*^A|B`` is any word, or the end, without these tags. ``<n`` before an element lets up to n words lie between,
    ``<n^A|B`` none of them of these tags. ``!`` at the end: a negation
    inside takes the weight away. ``longest`` are the lengths of the phrases behind a tag: since a phrase is known at its
    last word, the gap before it is that much wider."""
    head, body = line.split(":", 1)
    parts = body.split()
    negatable = parts[-1] == "!"
    elements, gap, bars = [], 0, frozenset()
    for part in parts[:-1] if negatable else parts:
        if part[0] == "<" and len(part) > 1:
            n, _, barred = part[1:].partition("^")
            gap, bars = int(n), frozenset(barred.split("|")) if barred else frozenset()
            continue
        if part[0] == "*":
            elements.append(Element(gap, bars, frozenset(), frozenset(part[2:].split("|"))))
            gap, bars = 0, frozenset()
            continue
        names = frozenset(x if x.isupper() or not x.isalpha() else fold(x) for x in part.split("|"))
        wider = max((longest.get(x, 1) - 1 for x in names), default=0) if elements else 0
        elements.append(Element(gap + wider, bars, names))
        gap, bars = 0, frozenset()
    head = head.strip()
    number = head.replace(".", "").isdigit()
    return Rule(tuple(elements), None if number else head, float(head) if number else 0.0, negatable)


#: Where a rule has got: rule, next element, words that may still lie between, words since a negation (0: none), reported.
Item = tuple[int, int, int, int, bool]


class Transducer:
    """Rules that are matched side by side, from every word on."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = list(rules)
        self.starts: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            for name in r.elements[0].names:
                self.starts.setdefault(name, []).append(i)

    def words(self) -> set[str]:
        """The words that rules name themselves."""
        return {x for r in self.rules for e in r.elements for x in e.names if not x.isupper() and x.isalpha()}

    def step(self, items: frozenset, tags: frozenset, reported: bool) -> tuple[frozenset, set[str], float]:
        """The next state, the tags written, and the greatest weight written."""
        best: dict[tuple, int] = {}
        marks, weight = set(), 0.0
        negation, asked = "NOT" in tags, "ASKED" in tags

        def go(rule: int, k: int, age: int, told: bool) -> None:
            nonlocal weight
            r = self.rules[rule]
            if k == len(r.elements):
                if not (r.negatable and 0 < age <= NEGATION_REACH):
                    if r.mark:
                        marks.add(r.mark)
                    weight = max(weight, r.weight * (REPORTED if told else 1))
                return
            state = rule, k, age, told
            best[state] = max(best.get(state, -1), r.elements[k].gap)

        for rule, k, left, age, told in items:
            e = self.rules[rule].elements[k]
            later = age + 1 if 0 < age <= NEGATION_REACH else 0
            if e.meets(tags):
                go(rule, k + 1, later, told)
            if left and not tags & e.bars:
                fresh = asked and k == 1 and left == e.gap  # the target is those who were asked
                state = rule, k, 1 if negation else later, told or fresh
                best[state] = max(best.get(state, -1), left - 1)
        for tag in tags & self.starts.keys():
            for rule in self.starts[tag]:
                go(rule, 1, 0, reported)
        return frozenset((r, k, left, age, told) for (r, k, age, told), left in best.items()), marks, weight


#: State of the report machine: a telling word was seen, someone else says something, right now, words since the link to
#: what is said, the word before was the writer, or someone who was asked.
Telling = tuple[bool, bool, bool, int, bool, bool]
SILENT: Telling = (False, False, False, 0, False, False)


def telling(state: Telling, tags: frozenset) -> tuple[Telling, bool]:
    """The next state, and whether a match that begins at this word is what others say. Quoted words are reported if the
    clause has a telling word outside (tag REPORTED, found beforehand, as it may come later)."""
    seen, said, now, link, writer, asked = state
    reported = "REPORTED" in tags or (seen and said and (now or link > 0)) or (asked and bool(tags & {"GROUP", "ROLE"}) and "YOU" not in tags)
    seen = seen or "TOLD" in tags
    if tags & {";", "but"}:
        said = False
    if "SAY" in tags and not writer:
        said, now, link = True, True, 0
    else:
        now = False
        link = 3 if said and tags & {"LINK", ":"} else max(link - 1, 0)
    return (seen, said, now, link, "I" in tags, "ASKED" in tags), reported


class Composition:
    """Transducers one after another, and the report machine, as one machine that writes weights."""

    def __init__(self, layers: list[Transducer]):
        self.layers = layers
        self.symbols: list[frozenset] = []
        self.numbers: dict[frozenset, int] = {}
        self.reset()

    def reset(self) -> None:
        start = (SILENT, *(frozenset() for _ in self.layers))
        self.states, self.known = [start], {start: 0}
        self.arcs: dict[tuple[int, int], tuple[int, float]] = {}

    def pivots(self, common: frozenset) -> frozenset:
        """Tags without one of which no clause has a weight. Of each rule of the last transducer the element that is met least
        often is taken, ``common`` names being met most; if it names what an earlier transducer writes, then the pivots of
        the rules that write it."""
        found: set[str] = set()
        done: set[tuple[int, Rule]] = set()

        def add(layer: int, rule: Rule) -> None:
            if (layer, rule) in done:
                return
            done.add((layer, rule))
            best = min((e for e in rule.elements if e.names), key=lambda e: (bool(e.names & common), len(e.names), -max(map(len, e.names))))
            for name in best.names:
                found.add(name)
                for below in range(layer):
                    for r in self.layers[below].rules:
                        if r.mark == name:
                            add(below, r)

        for rule in self.layers[-1].rules:
            add(len(self.layers) - 1, rule)
        return frozenset(found)

    def symbol(self, tags: frozenset) -> int:
        """The number of a set of tags."""
        if tags not in self.numbers:
            self.numbers[tags] = len(self.symbols)
            self.symbols.append(tags)
        return self.numbers[tags]

    def _arc(self, state: int, symbol: int) -> tuple[int, float]:
        tags, (tell, *inner) = self.symbols[symbol], self.states[state]
        tell, reported = telling(tell, tags)
        weight, after = 0.0, []
        for layer, items in zip(self.layers, inner, strict=True):
            items, marks, w = layer.step(items, tags, reported)
            after.append(items)
            tags, weight = tags | marks, max(weight, w)
        new = (tell, *after)
        if new not in self.known:
            self.known[new] = len(self.states)
            self.states.append(new)
        arc = self.arcs[state, symbol] = self.known[new], weight
        return arc

    def score(self, symbols: Iterable[int]) -> float:
        """The greatest weight written over a clause."""
        if len(self.states) > MOST_STATES:
            self.reset()
        state, best, arcs = 0, 0.0, self.arcs
        for s in symbols:
            arc = arcs.get((state, s)) or self._arc(state, s)
            state = arc[0]
            if arc[1] > best:
                best = arc[1]
        return best
