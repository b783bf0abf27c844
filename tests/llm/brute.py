"""Plain-Python versions of the operators. They share no function with the modules but the hash of a word, which decides where long sentences are cut."""

import re
from collections import defaultdict
from functools import lru_cache

from rivulet.llm import substring_dedup

STOP = re.compile(r"[.!?]+[\"'”’)\]]*(?=\s|$)|[。！？]+|\n")


@lru_cache(100_000)
def word_hash(word: str) -> int:
    return int(substring_dedup.cut(word)[0][0])


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the sentences: cut at stops, and where they have over 20 words also by winnowing over 8 words."""
    ends = sorted({m.end() for m in STOP.finditer(text)} | {len(text)})
    whole, at = [], 0
    for e in ends:
        words = [(m.start() + at, m.group()) for m in re.finditer(r"\S+", text[at:e])]
        if words:
            whole.append(words)
        at = e
    pieces = []
    for words in whole:
        if len(words) <= 20:
            pieces.append(words)
            continue
        marks = {len(words) - 1}
        for i in range(len(words) - 7):
            codes = [word_hash(w.lower()) >> 32 for _, w in words[i : i + 8]]
            marks.add(i + max(j for j in range(8) if codes[j] == min(codes)))
        last = 0
        for m in sorted(marks):
            pieces.append(words[last : m + 1])
            last = m + 1
    starts = [0, *(p[0][0] for p in pieces[1:]), len(text)]
    return [(a, b, [w.lower() for _, w in p]) for a, b, p in zip(starts, starts[1:], pieces, strict=False)]


def runs(text: str, span: int, least: int) -> list[tuple[int, int, tuple[str, ...]]]:
    """(first sentence, number of sentences, words) of every span."""
    parts, out = sentences(text), []
    for i in range(len(parts)):
        j, words = i, []
        while j < len(parts) and (j - i < span or len(words) < least):
            words = words + parts[j][2]
            j += 1
        if j - i >= span and len(words) >= least:
            out.append((i, j - i, tuple(words)))
    return out


def deduplicated(rows: list[tuple], span: int, least: int) -> list[str | None]:
    owner = {}
    spans = [runs(t or "", span, least) for _, t in rows]
    for (i, _), found in zip(rows, spans, strict=True):
        for _, _, words in found:
            if i is not None:
                owner[words] = min(owner.get(words, i), i)
    out = []
    for (i, t), found in zip(rows, spans, strict=True):
        gone, seen = set(), set()
        for first, n, words in found:
            if words in seen or (i is not None and owner[words] < i):
                gone.update(range(first, first + n))
            seen.add(words)
        out.append(t if t is None or not gone else "".join(t[a:b] for k, (a, b, _) in enumerate(sentences(t)) if k not in gone))
    return out


NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half third quarter".split()
UNITS = "% $ € £ ¥ ° mm cm km kg mg ml kb mb gb tb hz khz mhz ghz kw kwh mph kph meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees celsius fahrenheit volt volts watt watts joule joules newton newtons".split()


def template(text: str | None) -> list[tuple[str, str]]:
    """(kind or "", lower-cased token) of every token."""
    out, opens = [], True
    for token in re.findall(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+|[%$€£¥°]|[.!?\n]", text or ""):
        if token in ".!?\n":
            opens = True
            continue
        low = token.lower()
        if token[0].isdigit() or low in NUMBERS:
            kind = "number"
        elif low in UNITS:
            kind = "unit"
        else:
            kind = "name" if not opens and token[0].isupper() and not (len(token) > 1 and token.isupper()) else ""
        out.append((kind, low))
        opens = False
    return out


def contaminated(docs: list[tuple], items: list[tuple], window: int = 8, slots: int = 4, coverage: float = 0.5, run: int = 20) -> dict[tuple, tuple[str, float]]:
    """{(id, item): (kind, coverage)}; every pair of a document and an item, and every alignment of both, is tried."""
    once, out = {}, {}
    for item, text in items:
        if text is not None:
            once[text] = min(once.get(text, item), item)
    parsed = [(i, template(t)) for i, t in docs]
    for text, item in once.items():
        own = template(text)
        size = window if len(own) >= window else len(own)
        if size < 4:
            continue
        most = min(slots, size // 2)
        for i, theirs in parsed:
            found, same, longest = set(), True, 0
            lines = defaultdict(list)
            for at in range(len(own) - size + 1):
                for p in range(len(theirs) - size + 1):
                    mine, yours = own[at : at + size], theirs[p : p + size]
                    if sum(bool(k) for k, _ in mine) > most:
                        if [t for _, t in mine] == [t for _, t in yours] and sum(bool(k) for k, _ in yours) > most:
                            lines[p - at].append((at, size, p))
                        n = size
                        while size == window and at + n <= len(own) and sum(not k for k, _ in own[at : at + n]) < size - most:
                            n += 1
                        if size < window or at + n > len(own):
                            continue
                    else:
                        n = size
                    mine, yours = own[at : at + n], theirs[p : p + n]
                    if len(yours) == n and all(a == b and (a or x == y) for (a, x), (b, y) in zip(mine, yours, strict=True)):
                        lines[p - at].append((at, n, p))
            for met in lines.values():
                parts, part, known = [], [], {}
                for at, n, p in sorted(met):
                    pairs = [((k, x), (k2, y)) for (k, x), (k2, y) in zip(own[at : at + n], theirs[p : p + n], strict=True) if k]
                    clash = len(set(pairs)) > len({a for a, _ in pairs})
                    if part and (clash or any(known.get(a, b) != b for a, b in pairs)):
                        parts.append((part, known))
                        part, known = [], {}
                    if not clash:
                        part, known = [*part, (at, n)], known | dict(pairs)
                if part:
                    parts.append((part, known))
                whole = len(parts) == 1 and len(parts[0][0]) == len(met)
                for part, known in parts:
                    equal, tokens = all(a == b for a, b in known.items()), max(at + n for at, n in part) - part[0][0]
                    if whole or equal or tokens >= run:
                        found |= {at for at, _ in part}
                        same, longest = same and equal, max(longest, tokens)
            share = len(found) / (len(own) - size + 1)
            if found and (share >= coverage or longest >= run):
                out[i, item] = ("verbatim" if same else "reparameterised", share)
    return out
