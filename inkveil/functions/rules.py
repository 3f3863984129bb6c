"""Ordered redaction rules, compiled to one Spark expression.

A pack is a list of rules whose order is its meaning: each rule sees what the rules before it left. Compiled packs are nested
``regexp_replace`` calls, which stay inside whole-stage code generation and need no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What a rule did to a text: the lengths of the texts between its matches (one more than matches), of the matches, and of what stands in their place.
TRACE = "struct<gaps:array<int>,sizes:array<int>,news:array<int>>"


@dataclass(frozen=True)
class Rule:
    """`pattern` is a Java regular expression; `replacement` may hold $1 … and is literal if `literal`."""

    rule_id: str
    category: str
    pattern: str
    replacement: str
    ignore_case: bool = False
    literal: bool = False

    @property
    def compiled(self) -> str:
        """With line feed as the only line end, as texts from many systems need, and with Unicode classes where the pattern has any (they are slower)."""
        classes = self.ignore_case or re.search(r"\\[bBdDsSwW]", self.pattern)
        return f"(?{'U' if classes else ''}d{'i' if self.ignore_case else ''}){self.pattern}"

    def apply(self, text: Column) -> Column:
        if self.literal:
            return F.replace(text, F.lit(self.pattern), F.lit(self.replacement))
        return F.regexp_replace(text, F.lit(self.compiled), F.lit(self.replacement))

    def count(self, text: Column) -> Column:
        """Matches in a text; null for a null text."""
        if self.literal:
            return ((F.length(text) - F.length(F.replace(text, F.lit(self.pattern), F.lit("")))) / len(self.pattern)).cast("int")
        return F.regexp_count(text, F.lit(self.compiled))

    def matches(self, text: Column) -> Column:
        return text.contains(self.pattern) if self.literal else text.rlike(self.compiled)

    def trace(self, text: Column) -> Column:
        """TRACE of this rule over a text: split and the extraction of groups walk the same matches as the replacement does."""
        lengths = lambda texts: F.transform(texts, lambda x: F.coalesce(F.length(x), F.lit(0)))
        groups = [] if self.literal else [int(n) for n in re.findall(r"\$(\d+)", self.replacement)]
        fixed = len(self.replacement if self.literal else re.sub(r"\$\d+", "", self.replacement))
        found = [between(text, f"\\Q{self.pattern}\\E" if self.literal else self.compiled).alias("pieces")]
        if not self.literal:
            found += [F.regexp_extract_all(text, F.lit(self.compiled), F.lit(n)).alias(f"g{n}") for n in sorted({0, *groups})]

        def traced(v: Column) -> Column:
            same = lambda n: F.array_repeat(F.lit(n), F.size(v["pieces"]) - 1)
            news = same(fixed)
            for n in groups:
                news = F.zip_with(news, lengths(v[f"g{n}"]), lambda a, b: a + b)
            sizes = same(len(self.pattern)) if self.literal else lengths(v["g0"])
            return F.struct(lengths(v["pieces"]).alias("gaps"), sizes.alias("sizes"), news.alias("news"))

        return let(F.struct(*found), traced)


@dataclass(frozen=True)
class RulePack:
    """An ordered pack: phrases protected before the rules, the rules, and literal or regex repairs after them."""

    name: str
    rules: tuple[Rule, ...]
    protected: tuple[tuple[str, str], ...] = ()
    repairs: tuple[Rule, ...] = ()

    @property
    def steps(self) -> list[Rule]:
        """All that the pack does, in order: protection, rules, restoration, repairs."""
        swap = lambda k, a, b: Rule(f"protect_{k}", "PROTECT", a, b, literal=True)
        there = [swap(k, phrase, token) for k, (phrase, token) in enumerate(self.protected)]
        back = [swap(k, token, phrase) for k, (phrase, token) in reversed(list(enumerate(self.protected)))]
        return [*there, *self.rules, *back, *self.repairs]

    def apply(self, text: Column) -> Column:
        """The redacted text; null stays null and empty stays empty."""
        for step in self.steps:
            text = step.apply(text)
        return text

    def apply_if_matched(self, text: Column) -> Column:
        """As apply(), but texts without a match of any rule skip the chain."""
        return F.when(self.any_match(text), self.apply(text)).otherwise(text)

    def any_match(self, text: Column) -> Column:
        found = F.lit(False)
        for rule in self.rules:
            found = found | rule.matches(text)
        return found

    def counts(self, text: Column) -> Column:
        """Array of struct(rule_id, category, n): matches of every rule in the unchanged text."""
        return F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.category).alias("category"), r.count(text).cast("long").alias("n")) for r in self.rules])

    def only(self, *rule_ids: str) -> RulePack:
        return replace(self, name=f"{self.name}:{'+'.join(rule_ids)}", rules=tuple(r for r in self.rules if r.rule_id in rule_ids), repairs=())

    def without(self, *rule_ids: str) -> RulePack:
        return replace(self, rules=tuple(r for r in self.rules if r.rule_id not in rule_ids))

    def with_literal(self, old: str, new: str, position: int = -1) -> RulePack:
        """A rule for a literal text, before the rule at `position` (-1: the last); earlier additions stay."""
        rules = list(self.rules)
        rules.insert(position, Rule(f"custom_{old}", "CUSTOM", old, new, literal=True))
        return replace(self, rules=tuple(rules))

    def mapping(self) -> list[tuple[str, str]]:
        return [(r.pattern, r.replacement) for r in self.rules]


def quoted(word: str) -> str:
    return "".join(f"\\{c}" if c in "\\.^$|?*+()[]{}-&" else c for c in word)


def char_class(chars: Iterable[str], fan: int = 6) -> str:
    """A class of many characters, as a tree of ranges: a test then takes some 20 comparisons instead of one for each character, and one outside the range of all of them."""
    chars = sorted(set(chars))
    if len(chars) <= fan:
        return f"[{''.join(map(quoted, chars))}]"
    size = -(-len(chars) // fan)
    parts = [chars[k : k + size] for k in range(0, len(chars), size)]
    return f"[{_range(chars)}&&[{''.join(f'[{_range(x)}&&{_narrow(x, fan)}]' for x in parts)}]]"


def _range(chars: Sequence[str]) -> str:
    return f"{quoted(chars[0])}-{quoted(chars[-1])}"


def _narrow(chars: Sequence[str], fan: int) -> str:
    """char_class of sorted characters whose range has been tested."""
    if len(chars) <= fan:
        return f"[{''.join(map(quoted, chars))}]"
    size = -(-len(chars) // fan)
    parts = [chars[k : k + size] for k in range(0, len(chars), size)]
    return f"[{''.join(f'[{_range(x)}&&{_narrow(x, fan)}]' for x in parts)}]"


def starts(words: Iterable[str]) -> str:
    """Looks ahead for the first character of one of the words."""
    return f"(?={char_class(w[0] for w in words)})"


def alternation(words: Sequence[str]) -> str:
    """Alternatives of literal words, the longest first, so that a long name wins over its beginning.

    Many words become a tree of their beginnings behind a test of the first character, so that most places of a text are passed over at once.
    """
    words = list(dict.fromkeys(w for w in words if w))
    if len(words) <= 8:
        return "|".join(map(quoted, sorted(words, key=len, reverse=True)))
    return f"(?={char_class(w[0] for w in words)})(?:{_tree(words)})"


def _tree(words: Sequence[str]) -> str:
    """Alternatives by first character; within one the longer words come before those that end there."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])
    branches = []
    for c, rest in heads.items():
        longer = [r for r in rest if r]
        inner = "" if not longer else quoted(longer[0]) if len(longer) == 1 else f"(?:{_tree(longer)})"
        branches.append(quoted(c) + (f"(?:{inner})?" if longer and len(longer) < len(rest) else inner))
    return "|".join(branches)


#: A character of private use, which marks matches.
MARK = "\ue0ff"


def between(text: Column, pattern: str) -> Column:
    """The texts between the matches of a pattern, as split() gives them.

    split() compiles its pattern anew for every row, which takes longer than the search where a pattern holds word lists; replacing compiles it once. Texts that hold the mark are split.
    """
    return F.when(text.contains(MARK), F.split(text, pattern, -1)).otherwise(F.split(F.regexp_replace(text, F.lit(pattern), F.lit(MARK)), MARK, -1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once, however often the body (or a lambda in it) uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))
