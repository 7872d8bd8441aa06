"""Text functions as Column expressions.

Spark's `\\w` and `\\s` are ASCII, so words are written as letters, numbers and underscore,
and white space as `(?U)\\s`, which takes in the ideographic space.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
WORD_CHAR, NO_WORD = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]+"
# Marks of amendment in statute texts, and the circled paragraph numbers.
AMENDMENT = r"[<\[](?:개정|신설|전문개정|본조신설)\s+([\d.,\s]+)[>\]]"
DATE = r"(\d{4})\.\s*(\d{1,2})\.\s*(\d{1,2})"
HEADING = r"^제\d+조(의\d+)?(\([^)]*\))?\s*"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
# Cues of a reference, strongest first.
CUES = (
    ("exception", r"적용하지\s*(아니|않)|에도\s*불구하고|제외(한|하)|예외로\s*한다"),
    ("mutatis", r"준용(한다|하며|하고|된다)"),
)
CUE_RANK = {"exception": 0, "mutatis": 1, "plain": 2}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: Column | str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(WORD), F.lit(0))


def bigrams(c: Column | str) -> Column:
    """Character bigrams of each word in order; a one-character word stays whole."""
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))
    return F.flatten(F.transform(words(c), lambda w: F.when(F.length(w) == 1, F.array(w)).otherwise(pairs(w))))


def squeezed(c: Column | str) -> Column:
    """The text without any white space."""
    return F.regexp_replace(_col(c), r"(?U)\s+", "")


def bigram_set(c: Column | str) -> Column:
    """Distinct character bigrams of the text without white space."""
    s = squeezed(c)
    return F.when(F.length(s) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


#: The characters of Unicode's property White_Space, as `(?U)\\s` has them.
_WHITE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def shared_bigrams(lines: Column | str, said: Column | str) -> Column:
    """For each of an array of lines how many distinct bigrams (without white space) it shares with a text; the text's are made once."""

    def grams(s: str | None) -> set[str]:
        t = _WHITE.sub("", s or "")
        return {t[i : i + 2] for i in range(len(t) - 1)}

    @F.arrow_udf("array<int>")
    def run(lines: pa.Array, said: pa.Array) -> pa.Array:
        out = []
        for own, text in zip(lines.to_pylist(), said.to_pylist(), strict=True):
            asked = grams(text)
            out.append(None if own is None else [len(asked & grams(x)) for x in own])
        return pa.array(out, pa.list_(pa.int32()))

    return run(_col(lines), _col(said))


def strip(c: Column | str) -> Column:
    """Without white space at either end; null becomes empty."""
    return F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)^\s+|\s+$", "")


def clean_markup(c: Column | str) -> Column:
    """Break tags to newlines, runs of blanks (also ideographic) to one, blank lines away."""
    s = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"<br\s*/?>", "\n")
    s = F.regexp_replace(s, "[ \t　]+", " ")
    return strip(F.regexp_replace(s, r"(?U)\n\s*\n+", "\n"))


def iso_date(c: Column | str) -> Column:
    """yyyymmdd as yyyy-mm-dd; anything else as it is."""
    return F.regexp_replace(_col(c), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")


def dates(c: Column | str) -> Column:
    """All dates written `Y. M. D.`, as ISO text in order of appearance."""
    part = lambda k: F.regexp_extract_all(_col(c), F.lit(DATE), F.lit(k))
    return F.transform(
        F.arrays_zip(part(1).alias("y"), part(2).alias("m"), part(3).alias("d")),
        lambda x: F.concat_ws("-", x["y"], F.lpad(x["m"], 2, "0"), F.lpad(x["d"], 2, "0")),
    )


def amendment_dates(c: Column | str) -> Column:
    """Distinct dates inside amendment marks, in order of time."""
    marks = F.regexp_extract_all(_col(c), F.lit(AMENDMENT), F.lit(1))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(marks, dates))))


def any_date_after(c: Column | str, day: Column | str) -> Column:
    return F.exists(dates(c), lambda d: d > _col(day))


def without_heading(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), HEADING, "")


def sentences(c: Column | str) -> Column:
    """Parts that end in the statutes' sentence ending."""
    return F.split(_col(c), r"(?U)(?<=다\.)\s+")


def cue(c: Column | str) -> Column:
    """The strongest cue of a sentence."""
    out = None
    for name, pattern in CUES:
        hit = _col(c).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("plain")


def cue_rank(c: Column | str) -> Column:
    return F.create_map(*[F.lit(x) for pair in CUE_RANK.items() for x in pair])[_col(c)]


def issues(c: Column | str, least: int = 15) -> Column:
    """Issues of a case: cut at ` / ` and newlines, leading numbers dropped, short ones left out."""
    parts = F.transform(F.split(_col(c), r" / |\n"), lambda x: strip(F.regexp_replace(strip(x), r"^\[\d+\]\s*", "")))
    return F.filter(parts, lambda x: F.length(x) >= least)


def level(name: Column | str) -> Column:
    """The rank of a statute by the end of its name."""
    n = _col(name)
    return F.when(n.endswith("시행규칙"), "시행규칙").when(n.endswith("시행령"), "시행령").otherwise("법률")


# What laws with long names are called for short; other laws of this list keep their names.
SHORT_LAWS = {
    "근로기준법": "근로기준법", "최저임금법": "최저임금법", "근로자퇴직급여 보장법": "퇴직급여법", "남녀고용평등과 일ㆍ가정 양립 지원에 관한 법률": "남녀고용평등법",
    "기간제 및 단시간근로자 보호 등에 관한 법률": "기간제법", "파견근로자 보호 등에 관한 법률": "파견법", "근로자참여 및 협력증진에 관한 법률": "근로자참여법", "임금채권보장법": "임금채권보장법",
}


def short_law(article_id: Column | str, names: dict[str, str] = SHORT_LAWS) -> Column:
    """An article's law by its short name, with what tells a decree or rule from its act; null for a law without one."""
    law = F.regexp_extract(_col(article_id), "^([^#]*)", 1)
    suffix = F.regexp_extract(law, "( 시행규칙| 시행령)$", 1)
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.concat(known[F.regexp_replace(law, "( 시행규칙| 시행령)$", "")], suffix)


def numbered(key: Column | str) -> Column:
    """`43의2` as `제43조의2`."""
    k = _col(key)
    branch = F.regexp_extract(k, "의(.*)$", 1)
    return F.concat(F.lit("제"), F.regexp_extract(k, "^([^의]*)", 1), F.lit("조"), F.when(branch != "", F.concat(F.lit("의"), branch)).otherwise(""))


def label(key: Column | str, title: Column | str) -> Column:
    t = F.coalesce(_col(title), F.lit(""))
    return F.concat(numbered(key), F.when(t != "", F.concat(F.lit("("), t, F.lit(")"))).otherwise(""))


def article_id(law: Column | str, key: Column | str) -> Column:
    return F.concat(_col(law), F.lit("#"), _col(key))


def rendered(head: Column, paragraphs: Column | str) -> Column:
    """Header, then each paragraph with its items indented by two."""
    lines = F.flatten(F.transform(_col(paragraphs), lambda p: F.concat(F.array(p["text"]), F.transform(p["items"], lambda i: F.concat(F.lit("  "), i)))))
    return F.array_join(F.concat(F.array(head), lines), "\n")


def body(paragraphs: Column | str) -> Column:
    """What two versions of an article are compared by: each paragraph's text with its items."""
    return F.transform(_col(paragraphs), lambda p: F.concat(p["text"], F.array_join(p["items"], "")))


def truncated(c: Column | str, limit: int = 3000, mark: str = " …(이하 생략)") -> Column:
    """At most `limit` characters, cut after the last whole sentence, with a mark."""
    s = _col(c)
    head = F.left(s, F.lit(limit))
    whole = F.regexp_extract(head, r"(?s)^(.+다\.)", 1)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.when(whole != "", whole).otherwise(head), F.lit(mark)))


def url_part(c: Column | str) -> Column:
    """Percent-encoded as in a path: spaces as %20, slashes kept."""
    return F.replace(F.replace(F.replace(F.url_encode(_col(c)), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))


def json_object(c: Column | str) -> Column:
    """The outermost braces of a text that may say more."""
    return F.nullif(F.regexp_extract(_col(c), r"(?s)\{.*\}", 0), F.lit(""))


def aligned(found: Column, n: Column) -> Column:
    """Booleans for 1..n from a map of index to boolean; a missing index is false."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.coalesce(found[i], F.lit(False)))).otherwise(F.array().cast("array<boolean>"))


def holds_groups(c: Column | str, groups: Column) -> Column:
    """Whether the text, white space aside, holds an alternative of every group."""
    s = squeezed(c)
    return F.forall(groups, lambda g: F.exists(g, lambda a: F.contains(s, squeezed(a))))


def request_hash(*parts: Column) -> Column:
    """SHA-256 of the request as JSON with its keys in order of name."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def circled(n: Column | str) -> Column:
    return F.substring(F.lit(CIRCLED), _col(n).cast("int"), F.lit(1))
