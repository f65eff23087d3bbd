"""Boolean trigram queries derived from regular expressions (after Cox's indexed regex search)."""

from __future__ import annotations

from re import _constants as sre
from re import _parser

# A class of at most so many characters is spelled out; beyond so many alternatives a run of characters is given up.
SPELLED_CLASS, MOST_STATES = 6, 256

State = tuple[str, frozenset]


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of lower-case trigrams: every match's lower-cased text holds all of one alternative.

    An empty list means that some match needs no trigram, so the pattern has to be tried on every text.
    """
    alternatives = {grams for _, grams in _sequence(_parser.parse(pattern), {("", frozenset())})}
    if frozenset() in alternatives:
        return []
    least = [a for a in alternatives if not any(b < a for b in alternatives)]
    return sorted(least, key=sorted)


def _broken(states: set[State]) -> set[State]:
    return {("", grams) for _, grams in states}


def _joined(states: set[State], characters: list[str]) -> set[State]:
    out = set()
    for tail, grams in states:
        for c in characters:
            run = tail + c
            out.add((run[-2:], grams | {run} if len(run) == 3 else grams))
    return out if len(out) <= MOST_STATES else _broken(out)


def _class_characters(items) -> list[str] | None:
    found = set()
    for kind, value in items:
        if kind is sre.LITERAL:
            found.add(chr(value).lower())
        elif kind is sre.RANGE and value[1] - value[0] < SPELLED_CLASS:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return sorted(found) if len(found) <= SPELLED_CLASS else None


def _sequence(parsed, states: set[State]) -> set[State]:
    for kind, value in parsed:
        if kind is sre.LITERAL:
            states = _joined(states, [chr(value).lower()])
        elif kind is sre.IN:
            characters = _class_characters(value)
            states = _joined(states, characters) if characters else _broken(states)
        elif kind is sre.SUBPATTERN:
            states = _sequence(value[3], states)
        elif kind is sre.BRANCH:
            states = set().union(*(_sequence(branch, states) for branch in value[1]))
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = value
            once = states
            for _ in range(min(least, 3)):
                once = _sequence(inner, once)
            if least == 0 and most == 1:
                states = states | _sequence(inner, states)
            else:
                states = once if least == most <= 3 else _broken(once)
        elif kind is not sre.AT:
            states = _broken(states)
    return states
