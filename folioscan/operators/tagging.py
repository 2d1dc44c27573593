"""Rule tags and makers of chunks."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.functions import rules
from folioscan.functions.text import col, empty, let


def needed(pattern: str) -> list[str]:
    """Lower-case strings of which any match of the pattern holds one, whatever its case; empty if none are known."""
    kinds = re._constants

    def of(parts) -> list[str]:
        found, run = [], ""
        for kind, value in [*parts, (None, None)]:
            if kind is kinds.LITERAL and value < 128:
                run += chr(value).lower()
                continue
            found, run = [*found, [run]], ""
            if kind is kinds.SUBPATTERN:
                found.append(of(value[3]))
            elif kind is kinds.BRANCH:
                branches = [of(branch) for branch in value[1]]
                found.append([x for branch in branches for x in branch] if all(branches) else [])
            elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[0] > 0:
                found.append(of(value[2]))
        return max(found, key=lambda xs: min(map(len, xs), default=0))

    held = of(re._parser.parse(pattern))
    return list(dict.fromkeys(held)) if min(map(len, held), default=0) > 1 else []


def _has(text: Column, low: Column, pattern: str) -> Column:
    """text.rlike(pattern), looked for only in a text that holds a string which its matches need; low: the text in lower case."""
    held = needed(pattern)
    hit = text.rlike(pattern)
    return reduce(or_, (F.contains(low, F.lit(x)) for x in held)) & hit if held else hit


def alternatives(pattern: str) -> list[str]:
    """The pattern's outermost alternatives, each with the flags that it begins with: a text has the pattern if it has one of them."""
    flags = re.match(r"(?:\(\?[a-z]+\))?", pattern)[0]
    found, depth, listed = [""], 0, False
    for part in re.findall(r"\\.|.", pattern[len(flags) :], re.DOTALL):
        if part == "|" and not depth and not listed:
            found.append("")
            continue
        listed = part == "[" or (listed and part != "]")
        depth += 0 if listed else (part == "(") - (part == ")")
        found[-1] += part
    return [flags + x for x in found]


def heads(pattern: str) -> list[str]:
    """Lower-case beginnings of words of which any match of the pattern begins with one, whatever its case; empty if none are known."""
    kinds = re._constants

    def of(parts) -> list[str]:
        found = [""]
        for kind, value in parts:
            if kind is kinds.LITERAL and value < 128 and (chr(value).isalnum() or value == ord("_")):
                found = [x + chr(value).lower() for x in found]
                continue
            inner = [y for branch in value[1] for y in of(branch)] if kind is kinds.BRANCH else of(value[3]) if kind is kinds.SUBPATTERN else [""]
            return [x + y for x in found for y in inner]
        return found

    first, *rest = re._parser.parse(pattern)
    held = of(rest) if first == (kinds.AT, kinds.AT_BOUNDARY) else []
    return list(dict.fromkeys(held)) if min(map(len, held), default=0) > 1 else []


class _Begun:
    """Which of the beginnings of words that some patterns need a text has, found in one pass over its words; only patterns that can hit are searched.

    A beginning that begins with another one counts as that one, so a word has one at most. Words are
    runs of ASCII letters, digits and _: no word bound of a match lies inside one.
    """

    def __init__(self, patterns: Iterable[str]):
        known = sorted({x for p in patterns for part in alternatives(p) for x in heads(part)})
        self._as = {x: next(y for y in known if x.startswith(y)) for x in known}
        tails: dict[str, list[str]] = {}
        for x in sorted(set(self._as.values())):
            tails.setdefault(x[0], []).append(x[1:])
        self._word = f"(?i)(?:({'|'.join(f'{c}(?:{"|".join(xs)})' for c, xs in tails.items())})|[a-z0-9_])[a-z0-9_]*+"

    def of(self, text: Column | str) -> Column:
        """Beginnings of the text's words and the text, both in lower case."""
        found = F.lower(F.array_join(F.array_distinct(F.regexp_extract_all(empty(text), F.lit(self._word), F.lit(1))), "|")) if self._as else F.lit("")
        return F.struct(F.concat(F.lit("|"), found, F.lit("|")).alias("begun"), F.lower(empty(text)).alias("low"))

    def has(self, seen: Column, text: Column | str, pattern: str) -> Column:
        """empty(text).rlike(pattern); seen: of(text)."""
        parts = alternatives(pattern)
        hits = [_has(empty(text), seen["low"], x) for x in parts if not heads(x)]
        for part in filter(heads, parts):
            begun = dict.fromkeys(self._as[x] for x in heads(part))
            hits.append(reduce(or_, (F.contains(seen["begun"], F.lit(f"|{x}|")) for x in begun)) & empty(text).rlike(part))
        return reduce(or_, hits)


def rule_tags(text: Column | str, section: Column | str, table: tuple = rules.TAG_RULES, most: int = rules.MAX_RULE_TAGS) -> Column:
    """The first `most` tags, in the rules' order, whose text or section pattern hits."""
    in_text, in_section = (_Begun(filter(None, patterns)) for patterns in list(zip(*table, strict=True))[1:])

    def hit(seen: Column, t: str | None, s: str | None) -> Column:
        found = F.lit(False)
        if t:
            found |= in_text.has(seen["text"], text, t)
        if s:
            found |= in_section.has(seen["section"], section, s)
        return found

    seen = F.struct(in_text.of(text).alias("text"), in_section.of(section).alias("section"))
    return let(seen, lambda x: F.slice(F.filter(F.array(*(F.when(hit(x, t, s), F.lit(tag)) for tag, t, s in table)), lambda tag: tag.isNotNull()), 1, most))


def dominant_maker(text: Column | str, makers: dict[str, str]) -> Column:
    """The maker with the most hits, the first of equals; null without any."""

    def count(low: Column, p: str) -> Column:
        return F.when(_has(empty(text), low, p), F.regexp_count(empty(text), F.lit(p))).otherwise(0)

    counts = let(F.lower(empty(text)), lambda low: F.array(*(F.struct(count(low, p).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, p) in enumerate(makers.items()))))
    return let(F.array_max(counts), lambda best: F.when(best["n"] > 0, best["name"]))


def chunk_maker(text: Column | str, system: Column | str, default: Column | str) -> Column:
    system = empty(system)
    by = F.when(system == "WSP", dominant_maker(text, rules.MAKERS["WSP"])).when(system == "VB", dominant_maker(text, rules.MAKERS["VB"])).otherwise(dominant_maker(text, rules.MAKERS[""]))
    return F.coalesce(by, F.nullif(empty(default), F.lit("")))


def tags(text: Column | str, section: Column | str, system: Column | str, maker: Column | str) -> Column:
    """All tags of a chunk: the system's in front, then the rules', then the maker while there is room.

    The fire system's tags come from the text or title, FSDS if neither stands there.
    """
    system = empty(system)
    both = F.concat(empty(text), F.lit(" "), empty(section))
    named = F.filter(F.array(F.when(both.rlike(r"\bFDSS\b"), F.lit("FDSS")), F.when(both.rlike(r"\bFSDS\b"), F.lit("FSDS"))), lambda x: x.isNotNull())
    fire = F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("FSDS")))
    none = F.array().cast("array<string>")
    front = F.when(system == "FSDS", fire)
    for name, own in rules.SYSTEM_TAGS.items():
        front = front.when(system == name, F.array(*map(F.lit, own)))

    def all_of(led: Column, maker: Column) -> Column:
        more = F.when(maker.isNotNull() & ~F.array_contains(led, maker) & (F.size(led) < rules.MAX_TAGS), F.array(maker)).otherwise(none)
        return F.slice(F.concat(led, more), 1, rules.MAX_TAGS)

    led = let(rule_tags(text, section), lambda base: F.concat(F.filter(front.otherwise(none), lambda x: ~F.array_contains(base, x)), base))
    return let(led, lambda tags_: let(col(maker), lambda m: all_of(tags_, m)))
