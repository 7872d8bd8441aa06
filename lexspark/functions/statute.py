"""Parsers of references in statutes and cases, batch by batch in Python.

A sentence is cut into tokens, and a table of what each kind of token does to the state
reads them once, so that column expressions needn't say it.
"""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# How an article is cited, the words and places that may stand between members of one enumeration, the ends of words that name another law, the words that after "이" name this one, and how a law's replacement is noted.
ARTICLE = re.compile(r"제(\d+)조(?:의(\d+))?")
JOINS = r"[,ㆍ·]|및|또는|와|과|부터|까지|제\d+(?:항|호)|의\d+|[가-하]목|본문|단서|전단|후단|같은 조|같은 항|각 호 외의 부분|\([^()]*\)"
LAW_ENDS = ("법", "영", "시행령", "규칙")
OWN_LAWS = ("법", "영", "규칙")
REPLACED = re.compile(r"전[부문]\s*개정")
RANGE = "부터"
MOST_EXPANDED = 10

TOKEN = re.compile(rf"(?P<article>{ARTICLE.pattern})|(?P<space>\s+)|(?P<quoted>」(?:\s*\(이하[^()]*\))?)|(?P<join>{JOINS})|(?P<word>(?:(?!제\d+조)[^\s(」])+|\()")


def _key(number: str, branch: str | None) -> str:
    return f"{number}의{branch}" if branch else number


@dataclass
class Reading:
    """What is known at a place of a sentence: whether an enumeration is open and whose it is, whether a range was begun in it, its last article's number, what was just read, and the articles of the same law so far."""

    open: bool = False
    ours: bool = True
    ranged: bool = False
    last: int | None = None
    foreign: bool = False
    word: str = ""
    found: list[str] | None = None

    def article(self, m: re.Match) -> None:
        number, branch = int(m[2]), m[3]
        if not self.open:
            self.open, self.ours = True, not self.foreign
        elif self.ours and self.ranged and self.last is not None and not branch and number - self.last <= MOST_EXPANDED:
            self.found += [str(n) for n in range(self.last + 1, number)]
        if self.ours:
            self.found.append(_key(m[2], branch))
        self.last, self.ranged, self.foreign, self.word = None if branch else number, False, False, ""

    def join(self, m: re.Match) -> None:
        self.ranged |= m[0] == RANGE
        self.foreign, self.word = False, ""

    def quoted(self, m: re.Match) -> None:
        self.open, self.foreign, self.word = False, True, ""

    def word_(self, m: re.Match) -> None:
        own = m[0] in OWN_LAWS and self.word.endswith("이")
        self.open, self.ranged, self.foreign, self.word = False, False, m[0].endswith(LAW_ENDS) and not own, m[0]


#: What a token of each kind does; white space does nothing.
STEPS = {"article": Reading.article, "join": Reading.join, "quoted": Reading.quoted, "word": Reading.word_}


def own_references(sentence: str) -> list[str]:
    """Keys of the articles of the same law that a sentence refers to, in order; repeated ones stay. An enumeration belongs to the law that the word right before its first article names, and to this law if none does; a range of plain numbers stands for all of them if it is short."""
    at = Reading(found=[])
    for m in TOKEN.finditer(sentence):
        if step := STEPS.get(m.lastgroup):
            step(at, m)
    return at.found


def _unbracketed(text: str) -> list[tuple[str, bool]]:
    """The parts of a reference string between commas and slashes, brackets and parentheses taken out, each with whether a note in it says that the law was wholly replaced."""
    text = re.sub(r"\[[^\]]*\]", " ", text).replace("·", "ㆍ")
    closes: dict[int, int] = {}
    open_at: list[int] = []
    for i, c in enumerate(text):
        if c == "(":
            open_at.append(i)
        elif c == ")" and open_at:
            closes[open_at.pop()] = i
    parts, part, replaced, i = [], [], False, 0
    while i < len(text):
        if i in closes:
            inner, j = [], i + 1
            while j < closes[i]:  # a note's own words, without notes inside it
                if j in closes:
                    j = closes[j]
                else:
                    inner.append(text[j])
                j += 1
            part.append("\0" if REPLACED.search("".join(inner)) else " ")
            i = closes[i]
        elif text[i] in ",/":
            parts.append("".join(part))
            part = []
        else:
            part.append(text[i])
        i += 1
    parts.append("".join(part))
    return [(p, "\0" in p) for p in parts]


def _named(part: str) -> tuple[str | None, str] | None:
    """(the law named, article key) of a part that cites an article: None for no name, an empty name for a law that was wholly replaced."""
    ref = ARTICLE.search(part)
    if ref is None:
        return None
    words = part[: ref.start()].split()
    if words and words[0].startswith("구"):  # "the former"
        words[0] = words[0][1:]
    name = "".join(words)
    return ("" if "\0" in name else name) if part[: ref.start()].strip() else None, _key(ref[1], ref[2])


def case_references(text: str | None) -> list[tuple[str, str]]:
    """(law without spaces, article key) pairs of a case's references; a law's name holds for the parts after it until the next name. Articles of replaced laws are left out."""
    cited = [c for part, _ in _unbracketed(text or "") if (c := _named(part))]
    laws = accumulate((law for law, _ in cited), lambda held, law: held if law is None else law)
    return [(law, key) for law, (_, key) in zip(laws, cited, strict=True) if law]


def changed_places(old: list[str], new: list[str]) -> list[int]:
    """Places in `new` that a sequence alignment does not find unchanged in `old`."""
    steps = difflib.SequenceMatcher(a=old, b=new).get_opcodes()
    return [j for step, _, _, first, last in steps if step != "equal" for j in range(first, last)]


def same_law_references(c: Column) -> Column:
    @F.arrow_udf("array<string>")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([own_references(x.as_py() or "") for x in col], pa.list_(pa.string()))

    return run(c)


def cited_articles(c: Column) -> Column:
    @F.arrow_udf("array<struct<law: string, key: string>>")
    def run(col: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("law", pa.string()), ("key", pa.string())]))
        return pa.array([[{"law": a, "key": b} for a, b in case_references(x.as_py())] for x in col], kind)

    return run(c)


def changed(old: Column, new: Column) -> Column:
    @F.arrow_udf("array<int>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([changed_places(x.as_py() or [], y.as_py() or []) for x, y in zip(a, b, strict=True)], pa.list_(pa.int32()))

    return run(old, new)
