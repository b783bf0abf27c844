"""Chains read by a grammar, as a Python table function for lateral joins.

    chain    = [opening] segment { connector segment }
    segment  = group | father | relay | name
    name     = word { word | honorific }

Fixed phrases are looked up by their first word, longest first, so "a number of our companions" is one group. Words that belong to no phrase are names; a comma
or a lone "and" parts two segments. Phrases are compared in their canonical forms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

# Phrases of the grammar in canonical form, by kind.
PHRASES = {
    "connector": (
        "عن", "من", "منهم", "حدثني", "حدثنا", "اخبرني", "اخبرنا", "سمعت", "سمعته", "روى", "رواه", "باسناده", "بسنده",
        "باسناده عن", "بسنده عن", "ورواه عن", "وروى عن", "و بهذا", "وبهذا الاسناد", "قال حدثني", "قال اخبرني", "قال سمعت",
    ),
    "group": ("عدة من اصحابنا", "جماعة من اصحابنا", "غير واحد من اصحابنا", "بعض اصحابنا", "بعض اصحابه", "غير واحد", "جماعة", "غيره", "وغيره", "احدهما"),
    "father": ("ابيه", "ابوه"),
    "relay": ("عنه", "عنها", "وعنه", "وعنها", "عمن رواه", "عمن ذكره"),
}
PARTED = ("،", ",", "و")
HONORIFIC = r"\( ?(?:(?:عليه|عليها|عليهما|عليهم) (?:السلام|السلم)|[عصج]{1,3}) ?\)|عليهم? السلام|صلوات الله عليه"
OPENINGS = (r"^[0-9٠-٩]+[-\s]\s*(?:-\s*)?", r"^(?:اخبرنا|حدثنا)\s+ابو جعفر محمد بن يعقوب\s*(?:الكليني\s*)?قال حدثني\s+", r"^(?:اخبرنا|حدثنا|قال حدثنا|روى|وحدثني|وحدثنا)\s+")

_TOKEN = re.compile(rf"(?P<honorific>{HONORIFIC})|[،,]|[^\s،,]+")
_BY_WORD: dict[str, list[tuple[tuple[str, ...], str]]] = {}
for _kind, _phrases in PHRASES.items():
    for _p in _phrases:
        _BY_WORD.setdefault(_p.split()[0], []).append((tuple(_p.split()), _kind))
for _found in _BY_WORD.values():
    _found.sort(key=lambda x: -len(x[0]))


class Reader:
    """One pass over the tokens of a text in canonical form, by the rules above."""

    def __init__(self, text: str):
        for opening in OPENINGS:
            text = re.sub(opening, "", text)
        found = list(_TOKEN.finditer(text))
        self.words = [m[0] for m in found]
        self.honorific = [m["honorific"] is not None for m in found]
        self.at = 0

    def phrase(self) -> tuple[str, int] | None:
        """(kind, number of words) of the longest phrase that stands here."""
        if self.at >= len(self.words) or self.honorific[self.at]:
            return None
        word = self.words[self.at]
        for words, kind in _BY_WORD.get(word, ()):
            if tuple(self.words[self.at : self.at + len(words)]) == words:
                return kind, len(words)
        if (word.lstrip("و"),) in [w for w, k in _BY_WORD.get(word.lstrip("و"), ()) if k == "connector"]:
            return "connector", 1  # joined to an "and"
        return None

    def segment(self) -> tuple[str, str] | None:
        found = self.phrase()
        if found and found[0] != "connector":
            start, self.at = self.at, self.at + found[1]
            return found[0], " ".join(self.words[start : self.at])
        start = self.at
        while self.at < len(self.words) and self.words[self.at] not in PARTED and not self.phrase():
            if self.at == start and self.honorific[start]:
                break  # of nobody
            self.at += 1
        return ("name", " ".join(self.words[start : self.at])) if self.at > start else None

    def chain(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.words):
            found = self.segment()
            if found:
                yield found
            elif (joint := self.phrase()) is not None:
                self.at += joint[1]
            else:
                self.at += 1  # a comma, an "and", an honorific of nobody


class ChainSegments:
    """(pos, kind, segment) of one text; none of a null or empty one."""

    def eval(self, text: str):
        for pos, (kind, segment) in enumerate(Reader(text or "").chain()):
            yield pos, kind, segment


chain_segments = F.udtf(ChainSegments, returnType="pos int, kind string, segment string")


def register(spark: SparkSession) -> None:
    """``chain_segments`` for SQL; its argument is a text in canonical form."""
    spark.udtf.register("chain_segments", chain_segments)


def segments(chains: DataFrame, chain_id: str, text: Column) -> DataFrame:
    """(chain_id, pos, kind, segment) of all chains, by a lateral join."""
    rows = chains.select(F.col(chain_id), tx.normalize(text).alias("__text"))
    return rows.lateralJoin(chain_segments(F.col("__text").outer())).drop("__text")
