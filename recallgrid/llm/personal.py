"""Problem 1: personal information inside free text.

Bootstrapped contextual extraction.  One pass over the texts collects candidates of every kind: seeds, which nothing else
looks like (name@host.tld, +44 20 ..., a number after "passport number", a street with its full English word, a title
with a surname), and others that only might be personal data (bare and foreign number formats, any word with a code
after it, numbers before capitalised words, spelled-out addresses, two capitalised words).  Each candidate is an
instance in a left and a right lexical pattern and, other than names, in a shape.  Spark scores the graph of patterns and
instances in rounds of growing strictness: a pattern is worth the share of its occurrences that hold a believed
instance, an instance the mean of its patterns; contexts alone begin, shapes follow.  The result is a set of patterns and
a lexicon of name parts, with which a second pass decides all candidates but the seeds, settles overlaps, numbers the
items and can put typed placeholders in their place.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.operators.skew import shared_checkpoint
from recallgrid.sources.tables import table

KINDS = ("email", "phone", "id", "address", "name")
#: The share of the seeds' mean score that an instance needs to be believed, by round.
ROUNDS = (0.15, 0.3, 0.5, 0.5)
#: The score of a pattern that no believed instance stands in, and the one from which a pattern is believed.
FLOOR, SURE = 0.005, 0.5
#: The score from which a shape needs no believed context.
CERTAIN = 0.65
#: The most patterns or name parts that are handed to the workers, 8 bytes each.
MOST_ENTRIES = 1 << 24
#: Values kept in a worker's memory of what it has looked up.
REMEMBERED = 200_000

# Shapes --------------------------------------------------------------------------------------------------------------

_DOT = r"(?:\s?[(\[{]\s?(?:dot|punkt|punto|point)\s?[)\]}]\s?|\.)"
_AT = r"(?:\s?[(\[{]\s?(?:at|ät|arroba)\s?[)\]}]\s?|\s?@\s?)"
EMAIL = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9])", re.I)
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]* at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+(?![A-Za-z0-9])", re.I)

#: Words that make the code after them a seed; further ones ("DNI", "SSN") are for the graph to find.
_ID_WORD = r"(?:national insurance|social security|passport|identity card|driving licence)"
_CODE = r"(?:[A-Z]{1,3}[ -]?)?\d[0-9A-Z]*(?:[ .-][0-9A-Z]*\d[0-9A-Z]*)*(?:[ -]?[A-Z](?![\w]))?(?!\w)"
ID = re.compile(rf"(?<!\w){_ID_WORD}(?: number| no\.?)?(?:\s*[:#=])?\s*(?P<code>{_CODE})", re.I)
#: Any run of digits and capitals in groups, and the one or two words before it.
CODE = re.compile(r"(?<![\w.,/+:=@#(-])(?<![^\W\d_] [A-Z] )[0-9A-Z]++(?!\w)(?:[ .-][0-9A-Z]++(?!\w))*+(?![/@:])")
_LABEL = re.compile(r"(?<![\w-])(?:([^\W\d_]+(?:-[^\W\d_]+)*) )?([^\W\d_]+(?:-[^\W\d_]+)*\.?)(?:\s*[:#=])?\s*$")
CODE_DIGITS, CODE_CHARS = 6, 20

_EXT = r"(?:\s?(?:ext\.?|extension|x|Durchwahl|poste)\s?\d{1,5})?"
PHONE = re.compile(
    r"(?<![\w.+/-])(?<!\d[ ,])(?:tel:\s?)?(?:"
    r"(?:\+|00(?=[1-9]))\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\(?\d{1,5}\)?(?:[ ./-]?\d{2,5}){1,5}"
    r"|(?:1[ .-])?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}"
    r"|1[ .-][2-9]\d{2}[ .-]\d{3}[ .-]\d{4}"
    r"|[2-9]\d{2}([.-])\d{3}\1\d{4}"
    r"|0\d{2} \d{4} \d{4}|0\d{3} \d{3} \d{4}|0\d{4} \d{6}"
    r"|0\d(?:[ .]\d{2}){4}"
    r"|0\d{2,4}/\d{5,8}"
    rf"){_EXT}(?![\w/])(?![.,-]\d)(?! \d)", re.I)
BARE_PHONE = re.compile(rf"(?<![\w.+/:=@#-])(?<!\d[ ,])[2-9]\d{{2}}[2-9]\d{{6}}{_EXT}(?![\w/:-])(?![.,]\d)(?! \d)")

_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’.-]*"
_TOWN_WORD = r"[A-ZÀ-ÖØ-Þ](?:[^\W\d_]|['’-])+(?!\w)"
_TOWN_WORDS = rf"{_TOWN_WORD}(?:[ -](?:(?:del|de|la|am|an|der|sur|le|les|upon|on|in)[ -])*{_TOWN_WORD}){{0,3}}"
_POST = r"(?:[A-Z]{1,2}\d{1,2}[A-Z]? ?\d[A-Z]{2}|[A-Z]{2} \d{5}(?:-\d{4})?(?!\d)|\d{5}(?!\d))"
#: After a comma a town, with a postcode before or after it or none; on the next line only one with a postcode.
_TOWN = rf"(?:,\s*\n?\s*(?!Tel|Phone|Fax|Mail)(?:\d{{4,5}} )?{_TOWN_WORDS}(?:,? {_POST})?|\s*\n\s*(?:\d{{4,5}} {_TOWN_WORDS}|{_TOWN_WORDS},? {_POST}))?"
_EN = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Close|Cl|Boulevard|Blvd|Way|Place|Pl|Square|Sq|Terrace|Crescent|Row|Parade|Highway|Hwy|Mews|Gardens|Grove|Walk)\b\.?"
ADDRESS = re.compile(
    r"(?<![\w-])(?P<street>"
    rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Floor) ?\w{{1,4}}, )?\d{{1,5}}[A-Za-z]? (?:[A-ZÀ-Þ][\w'’-]+ ){{1,3}}?(?P<en>{_EN})(?:,? (?:Flat|Apt\.?|Apartment|Unit|Suite) ?\w{{1,4}})?"
    r"|(?:(?P<am>Am|An der|Im|Zum|Zur|Auf dem|In der) [A-ZÄÖÜ][\wäöüß-]+|[A-ZÄÖÜ][\wäöüß-]*(?P<de>straße|strasse|str\.|gasse|weg|platz|allee|ring|damm|ufer))[ ]\d{1,4} ?[a-zA-Z]?\b"
    r"|(?P<es>Calle|Avenida|Avda\.?|Plaza|Paseo|Camino|Carrera|C/) ?(?:(?:de|del|la|las|los|el) )*[\w'’-]+(?: (?:(?:de|del|la|las|los) )*[A-ZÁÉÍÓÚÑ][\w'’-]+){0,3},? \d{1,4}(?:, ?\d{1,2}\.?[ºª°o]?(?: ?[A-Z]\b)?)?"
    r"|\d{1,4}(?: bis| ter)?,? (?P<fr>rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours|route) (?:(?:de la|des|du|de|le|la|les) |de l['’]|d['’]|l['’])?[A-ZÀ-Þ][\w'’-]+(?:[ -][A-ZÀ-Þ][\w'’-]+){0,3}"
    r"|(?P<box>P\. ?O\. ?Box|PO Box|Post Office Box|Postfach|Apartado(?: de Correos)?|Boîte postale|B\. ?P\.) ?\d{1,7}(?:[ -]\d{2,4})*"
    rf"){_TOWN}")
_TYPES = ("en", "am", "de", "es", "fr", "box")
#: Words that make a street a seed; the others are for the graph to find.
SEED_STREETS = frozenset(("street", "road", "avenue", "lane", "drive", "court", "close", "p.o. box"))
#: A house number before capitalised words, whatever the last of them.
PLACE = re.compile(r"(?<![\w.,/:#-])(?<![^\W\d_] )\d{1,5}[A-Za-z]? (?:[A-ZÀ-Þ][\w'’-]+ ){1,2}([A-ZÀ-Þ][\w'’-]+)(?!\w)")

#: Titles; each in three letter cases, which is faster to search than ignoring case.
_TITLES = ("Mrs", "Mr", "Ms", "Mx", "Miss", "Dr", "Professor", "Prof", "Sir", "Dame", "Herr", "Frau", "Señora", "Señor", "Sra", "Sr", "Doña", "Don", "Mme", "Mlle", "Monsieur", "Madame")
_TITLE = "(?:" + "|".join(x for t in _TITLES for x in (t, t.upper(), *([t.lower()] if len(t) < 5 and t not in ("Don", "Sir", "Miss", "Frau", "Dame", "Herr") else []))) + ")"
_PART = r"(?:(?:van der|van den|van|von|de la|de los|de|del|della|di|da|dos|du|la|le|ter|ten|bin|ibn|al|el|ní|nic|ó|mac|st\.?)\s)"
_N = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_UP = r"[A-ZÀ-ÖØ-ÞŁŻŹŚŠŽČĆĐŐŰĞİ][^\W\d_]*(?:['’-][^\W\d_]+)*"
TITLED = re.compile(rf"(?<![\w@.+-])({_TITLE})\.?[ \t]+((?:{_UP}[ \t]+|[A-Z]\.[ \t]*)*?)((?:(?i:{_PART}))*{_UP})(?![\w@])")
PAIR = re.compile(rf"(?<![\w@.+'’-])(?=({_UP})[ \t]+(?:[A-Z]\.[ \t]*)?((?:(?i:{_PART}))*{_UP})(?![\w@]))")
INITIAL = re.compile(rf"(?<![\w@.+'’-])([A-Z]\.)[ \t]?(?:[A-Z]\.[ \t]?)?((?:(?i:{_PART}))*{_UP})(?![\w@])")
#: What a text must hold for the three before to have a match; without a look behind, which makes them fast to refuse.
_TITLED_HINT = re.compile(rf"{_TITLE}\.?[ \t]+(?:[A-ZÀ-ÖØ-ÞŁŻŹŚŠŽČĆĐŐŰĞİ]|(?i:{_PART}))")
_INITIAL_HINT = re.compile(r"[A-Z]\.[ \t]?[^\W\d_]")
_PAIR_HINT = re.compile(rf"{_UP}[ \t]+(?:[A-Z]\.[ \t]*)?(?:(?i:{_PART}))*[A-ZÀ-ÖØ-ÞŁŻŹŚŠŽČĆĐŐŰĞİ]")
_COMMA = re.compile(rf",[ \t]+({_UP})(?![\w@])")
_BEFORE_COMMA = re.compile(rf"(?<![\w@.+'’-])((?:(?i:{_PART}))*{_UP})$")


#: An initial and a surname right after one of these on the same line ("Reporter: O. Nakamere") is a seed.
_OPENERS = re.compile(r"[,:;(<=][ \t]*$")


class _Reversed:
    """Surname, Given: found from the comma, since commas before a capital are rare."""

    @staticmethod
    def finditer(text: str) -> Iterator[tuple[int, int, str, str]]:
        for m in _COMMA.finditer(text):
            lo = max(0, m.start() - 48)
            if before := _BEFORE_COMMA.search(text, lo, m.start()):
                yield before.start(1), m.end(1), before.group(1), m.group(1)


_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|\n")
_ENDS = frozenset(".!?:\n。")


def _context(text: str, a: int, b: int) -> list[str]:
    """The tokens of text[a:b]: numbers as 0, capitalised words within a sentence as Aa, other words in lower case."""
    out = []
    before = text[max(0, a - 2) : a].rstrip(" ")[-1:] or "\n"
    for m in _TOKEN.finditer(text, a, b):
        t = m.group()
        out.append("0" if t.isdigit() else "Aa" if t[0].isupper() and before not in _ENDS else t.lower())
        before = t
    return out


def _left(text: str, at: int) -> str:
    """The pattern to the left of a candidate; all starts of sentences are one pattern, starts of lines know the line before."""
    toks = _context(text, max(0, at - 40), at)
    if toks and toks[-1] == "\n":
        words = [t for t in toks if t != "\n"]
        return "L|" + " ".join(words[-2:]) + " \\n" if len(words) > 1 and words[-1].isalpha() else "L|^"
    for i in range(len(toks) - 1, -1, -1):
        if toks[i] in "!?\n。" or toks[i] == "." and (i == 0 or len(toks[i - 1]) > 1):
            toks = ["^", *toks[i + 1 :]]
            break
    else:
        if at <= 40:
            toks = ["^", *toks]
    return "L|" + " ".join(toks[-2:])


def _right(text: str, at: int) -> str:
    toks = _context(text, at, at + 40)
    if not toks or toks[0] in ".!?\n。":
        return "R|$"
    return "R|" + " ".join(toks[:2])


_PARTICLES = frozenset(("van", "von", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "ter", "ten", "bin", "ibn", "al", "el", "ní", "nic", "ó", "mac", "st", "los", "der", "den"))


def parts(surname: str) -> str:
    return " ".join(surname.lower().replace("’", "'").split())


class Spans:
    """Disjoint spans of a text, in order."""

    def __init__(self, spans: list[tuple[int, int]] | None = None):
        self.spans = sorted(spans or [])

    def free(self, a: int, b: int) -> bool:
        """Whether no span overlaps [a, b)."""
        i = bisect_left(self.spans, (b, -1))  # the first that begins at b or later
        return i == 0 or self.spans[i - 1][1] <= a

    def add(self, a: int, b: int) -> None:
        insort(self.spans, (a, b))


@dataclass(slots=True)
class Shaped:
    kind: str
    start: int
    end: int
    seed: bool
    typed: bool  # by an expression of its kind; else a loose candidate
    shape: str
    core: int = -1  # of an address the end of the street, before the town


_UPPER, _LOWER, _DIGIT = re.compile(r"[A-ZÀ-Þ]"), re.compile(r"[a-zß-ÿ]+"), re.compile(r"\d")
_AT_HINT = re.compile(r"[aä]t ?[\])}]")
_ID_HINT = re.compile("insurance|security|passport|identity|licence")
_CAPITALS = re.compile(r"[A-Z]{3,} ")


def shape_of(value: str) -> str:
    """Digits as 0, capitals as A, runs of small letters as a."""
    return _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub("A", value)))


def _email_shape(value: str) -> str:
    """What joins the parts of an address; words spelled like ``dot`` stay."""
    joints = re.findall(r"[^\w.%+-]+(?:at|ät|arroba|dot|punkt|punto|point)?[^\w.%+-]*|[@]| at | dot ", value.lower())
    return " ".join(sorted(set("".join(j.split()) for j in joints)))


def shaped(text: str) -> list[Shaped]:
    """The candidates other than names, from strong to loose; those of one kind don't overlap, nor does any overlap a seed."""
    low = text.lower()
    digits, spelled = _DIGIT.search(text) is not None, " dot " in low
    signs = "@" in text or "arroba" in low or (("(" in text or "[" in text or "{" in text) and _AT_HINT.search(low) is not None)
    out: list[Shaped] = []
    if not (digits or spelled or signs):
        return out
    seeds, taken = Spans(), defaultdict(Spans)

    def take(kind: str, a: int, b: int, seed: bool, typed: bool, shape: str, core: int = -1) -> None:
        if taken[kind].free(a, b) and seeds.free(a, b):
            taken[kind].add(a, b)
            if seed:
                seeds.add(a, b)
            out.append(Shaped(kind, a, b, seed, typed, "S|" + shape, b if core < 0 else core))

    if signs:
        for m in EMAIL.finditer(text):
            plain = "@" in m.group() and not any(c in m.group() for c in " ([{")
            take("email", *m.span(), plain, True, _email_shape(m.group()))
    if spelled:
        for m in SPELLED.finditer(text):
            take("email", *m.span(), False, True, _email_shape(m.group()))
    if digits:
        if _ID_HINT.search(low):
            for m in ID.finditer(text):
                take("id", *m.span(), True, True, " ".join(low[m.start() : m.start("code")].strip(" :#=").split()) + " " + shape_of(m.group("code")))
        runs = [m.start() for m in _RUN.finditer(text)]
        for m in _phones(text, low, runs):
            v = m.group()
            take("phone", *m.span(), v.startswith(("+", "(")), True, shape_of(v))
        for m in ADDRESS.finditer(text):
            kind = next(m.group(t) for t in _TYPES if m.group(t)).lower()
            take("address", *m.span(), kind in SEED_STREETS, True, kind.rstrip("."), m.end("street"))
        for m in _at(BARE_PHONE, text, runs):
            take("phone", *m.span(), False, True, shape_of(m.group()))
        for m in _at(PLACE, text, runs):
            take("address", *m.span(), False, False, "place " + m.group(1).lower())
        _codes(text, low, take)
    return out


_RUN = re.compile(r"\d+")


def _at(pattern: re.Pattern, text: str, starts: list[int]) -> Iterator[re.Match]:
    """The matches of a pattern that can only begin at one of ``starts``, without overlaps."""
    end = 0
    for i in starts:
        if i >= end and (m := pattern.match(text, i)):
            end = m.end()
            yield m


def _phones(text: str, low: str, runs: list[int]) -> Iterator[re.Match]:
    """``PHONE`` where it can begin: at a run of digits, at the sign or bracket before it, or at "tel:" before those."""
    end = 0
    for i in runs:
        if i < end:
            continue
        a = i - 1 if i > end and text[i - 1] in "+(" else i
        tel = a - 4 if low.startswith("tel:", max(0, a - 4), a) else a - 5 if a >= 5 and low.startswith("tel:", a - 5) and text[a - 1].isspace() else a
        for begin in sorted({max(tel, end), a, i}):
            if m := PHONE.match(text, begin):
                end = m.end()
                yield m
                break


def _codes(text: str, low: str, take) -> None:
    """Loose candidates for identity numbers, each with one or two words before it, and for telephone numbers."""
    for m in CODE.finditer(text):
        a, v = m.start(), m.group()
        if len(v) < CODE_DIGITS:
            continue
        while (word := _CAPITALS.match(v)):  # a word in capitals
            a, v = a + word.end(), v[word.end() :]
        digits = len(_DIGIT.findall(v))
        if digits < CODE_DIGITS or len(v) > 2 * CODE_CHARS or sum(c.isalnum() for c in v) > CODE_CHARS:
            continue
        groups = re.split("[ .-]", v)
        if any(not any(c.isdigit() for c in g) for g in groups[1:-1]):
            continue
        end = m.end()
        if len(groups) > 1 and not any(c.isdigit() for c in groups[-1]) and len(groups[-1]) > 1:
            end -= len(groups[-1]) + 1
        elif len(groups) > 1 and len(groups[-1]) == 1 and groups[-1].isalpha() and groups[-2][-1].isalpha():  # "I" after a code that ends in a letter
            end -= 2
        v = text[a:end]
        lead = _LABEL.search(text, max(0, a - 40), a)
        if lead:
            # a label of one word; of two where the second only says that a number follows
            two = lead.group(1) and low[lead.start(2) : lead.end(2)].rstrip(".") in ("no", "nr", "number", "id", "nº", "número", "nummer", "card")
            at = lead.start(1) if two else lead.start(2)
            take("id", at, end, False, False, " ".join(low[at:a].strip(" :#=").split()) + " " + shape_of(v))
        elif v[0].isdigit() and 7 <= digits <= 15 and not any(c.isalpha() for c in v):
            take("phone", a, end, False, False, shape_of(v))


def name_candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, bool, tuple[str, ...]]]:
    """(start, end, strong, name parts) of capitalised names; parts are tagged 'g ' (given) or 's ' (surname)."""

    held, titled = Spans(taken), Spans()
    for m in TITLED.finditer(text) if _TITLED_HINT.search(text) else ():
        if held.free(m.start(), m.end()):
            titled.add(*m.span())
            yield m.start(), m.end(), True, ("s " + parts(m.group(3)), *("g " + g.lower() for g in m.group(2).split() if len(g) > 2))
    inside = lambda a, b: held.free(a, b) and titled.free(a, b)
    for m in INITIAL.finditer(text) if _INITIAL_HINT.search(text) else ():
        if inside(*m.span()):
            yield m.start(), m.end(), _OPENERS.search(text, max(0, m.start() - 3), m.start()) is not None, ("s " + parts(m.group(2)),)
    for m in PAIR.finditer(text) if _PAIR_HINT.search(text) else ():
        a, b = m.start(1), m.end(2)
        if m.group(1).lower() not in _PARTICLES and inside(a, b):
            yield a, b, False, ("g " + parts(m.group(1)), "s " + parts(m.group(2)))
    for a, b, surname, given in _Reversed.finditer(text):
        if given.lower() not in _PARTICLES and inside(a, b):
            yield a, b, False, ("s " + parts(surname), "g " + parts(given))


# First pass and graph ------------------------------------------------------------------------------------------------


def owner_words(text: str, found: list[Shaped]) -> set[str]:
    """The words of the e-mail addresses' local parts: a name that holds one of them belongs to the address."""
    return {w for s in found if s.kind == "email" and s.seed for w in re.split(r"[\W\d_]+", text[s.start : s.end].split("@")[0].lower()) if len(w) > 3}


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (kind, instance, strong, pattern): combined here, before anything is shuffled."""
    seen: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(seen)
        cols = list(zip(*keys, strict=True)) or [(), (), (), ()]
        out = pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.string()), pa.array([seen[k] for k in keys], pa.int64())],
            names=["kind", "inst", "strong", "pat", "n"],
        )
        seen.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            found = shaped(text)
            taken = [(s.start, s.end) for s in found if s.typed]
            owners = owner_words(text, found)
            for s in found:
                inst = re.sub(r"\W+", "", text[s.start : s.end].lower())
                for p in (_left(text, s.start), _right(text, s.end), s.shape):
                    seen[s.kind, inst, s.seed, p] += 1
            for a, b, strong, names in name_candidates(text, taken):
                strong = strong or any(n[2:] in owners for n in names)
                for p in (_left(text, a), _right(text, b)):
                    for part in names:
                        seen["name", part, strong, p] += 1
        if len(seen) > 200_000:
            yield flush()
    yield flush()


def pattern_graph(texts: DataFrame) -> DataFrame:
    """(kind, inst, pat, strong, n) of the candidates of ``texts`` (column text)."""
    edges = texts.select("text").where(F.length("text") > 0).mapInArrow(_collect, "kind string, inst string, strong boolean, pat string, n long")
    return edges.groupBy("kind", "inst", "pat").agg(F.max("strong").alias("strong"), F.sum("n").alias("n"))


def score_graph(edges: DataFrame, rounds: tuple[float, ...] = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(patterns, instances) after the last round: (kind, pat, p) and (kind, inst) of the believed instances.

    A pattern's score is the share of its occurrences that hold a believed instance; an instance's score is the
    geometric mean over the patterns that it stands in, so that a few places where anything may stand don't carry it.
    In the first round shapes don't count: contexts bring the first instances of a shape.  Seeds are believed
    throughout, others as long as their score reaches the round's share of the seeds' mean.
    """
    edges = shared_checkpoint(edges)
    believed = edges.where("strong").select("kind", "inst").distinct().withColumn("ok", F.lit(1.0))
    patterns = None
    for number, share in enumerate(rounds):
        marked = edges.join(believed, ["kind", "inst"], "left")
        patterns = marked.groupBy("kind", "pat").agg((F.sum(F.col("n") * F.coalesce("ok", F.lit(0.0))) / (F.sum("n") + 0.5)).alias("p"))
        log = F.log(F.greatest(F.col("p"), F.lit(FLOOR)))
        counted = edges.where(~F.col("pat").startswith("S|")) if number == 0 else edges
        scored = counted.join(patterns, ["kind", "pat"]).groupBy("kind", "inst").agg(F.exp(F.sum(F.col("n") * log) / F.sum("n")).alias("i"), F.max("strong").alias("seed"))
        least = scored.where("seed").groupBy("kind").agg((F.avg("i") * share).alias("least"))  # one row per kind
        near = scored.join(F.broadcast(least), "kind")
        believed = shared_checkpoint(near.where((F.col("i") >= F.col("least")) | F.col("seed")).select("kind", "inst", F.lit(1.0).alias("ok")))
    return patterns, believed.drop("ok")


class Hashed:
    """A set of strings as sorted 64-bit hashes: 8 bytes an entry, whatever their number."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(np.asarray(hashes, np.uint64))
        self.seen: dict[str, bool] = {}

    def __contains__(self, x: str) -> bool:
        got = self.seen.get(x)
        if got is None:
            import xxhash

            h = np.uint64(xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42))  # as Spark's xxhash64
            at = int(self.hashes.searchsorted(h))
            got = at < len(self.hashes) and self.hashes[at] == h
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[x] = got
        return got

    def __getstate__(self):
        return {"hashes": self.hashes, "seen": {}}


def membership(df: DataFrame, col: str) -> Hashed:
    """The values of ``col`` as something to ask 'in'; more than ``MOST_ENTRIES`` of them are an error."""
    got = df.select(F.xxhash64(col).alias("h")).distinct().limit(MOST_ENTRIES + 1).toArrow()
    if got.num_rows > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} entries for a broadcast: raise MOST_ENTRIES")
    return Hashed(got.column(0).to_numpy().view(np.uint64))


@dataclass
class Knowledge:
    """What the graph has taught: believed patterns ('name L|...', 'phone S!|...') and name parts ('g zofka', 's ilvantane')."""

    patterns: Hashed
    parts: Hashed
    _asked: set = field(default_factory=set)
    _given: set = field(default_factory=set)

    def may_hold_given(self, low: str) -> bool:
        """Whether a known given name stands somewhere in the lower-case text; what was asked before is remembered."""
        tokens = set(low.split())
        new = tokens - self._asked
        if len(self._asked) + len(new) > REMEMBERED:
            self._asked.clear()
            self._given.clear()
            new = tokens
        for t in new:
            if any("g " + w in self.parts for w in t.translate(_TO_BLANK).split()):
                self._given.add(t)
        self._asked |= new
        return not self._given.isdisjoint(tokens)

    def __getstate__(self):
        return {"patterns": self.patterns, "parts": self.parts, "_asked": set(), "_given": set()}

    def believes(self, text: str, s: Shaped) -> bool:
        """Whether a candidate other than a name is personal data: a seed, of a certain shape, or of a believed one in a believed context."""
        if s.seed or f"{s.kind} !{s.shape}" in self.patterns:
            return True
        return f"{s.kind} {s.shape}" in self.patterns and (f"{s.kind} {_left(text, s.start)}" in self.patterns or f"{s.kind} {_right(text, s.end)}" in self.patterns)


def learn(texts: DataFrame) -> Knowledge:
    scored, instances = score_graph(pattern_graph(texts))
    scored = shared_checkpoint(scored.where(F.col("p") >= SURE))
    certain = scored.where(F.col("pat").startswith("S|") & (F.col("p") >= CERTAIN)).select(F.concat("kind", F.lit(" !"), "pat").alias("p"))
    pats = membership(scored.select(F.concat_ws(" ", "kind", "pat").alias("p")).unionByName(certain), "p")
    names = membership(instances.where((F.col("kind") == "name") & (F.length("inst") > 3)).select(F.col("inst")), "inst")
    return Knowledge(pats, names)


# Second pass ---------------------------------------------------------------------------------------------------------

_TO_BLANK = {ord(c): " " for c in "\"'`=()[]{}<>,;:.!?*#|/\\"}
_LOW = "[a-zà-öø-ÿłżźśšžčćđőűğ]"
_LOWER_PAIRS = re.compile(
    rf"(?<![\w@.+'’-])(?=({_LOW}{{2,}})[ \t]+(?:[A-Za-z]\.[ \t]*)?((?:(?:van|von|de la|de|del|di|da|al|ní|ó|mac)[ \t])*(?:{_LOW}+(?:['’-]{_LOW}+)+|{_LOW}{{2,}}))(?![\w@]))"
)


def _names(text: str, know: Knowledge, taken: list[tuple[int, int]], towns: Spans) -> list[tuple[int, int]]:
    """Spans of names: the believable of the capitalised candidates, and pairs of known parts in any letter case.

    Where an address may have taken the next words for its town, a name must be known in all its parts.
    """
    cands: list[tuple[float, int, int]] = []
    ok = know.parts
    pat = lambda a, b: f"name {_left(text, a)}" in know.patterns or f"name {_right(text, b)}" in know.patterns

    for a, b, strong, names in name_candidates(text, taken):
        if strong:
            cands.append((5 if len(names) > 1 or text[a + 1] != "." else 2, a, b))  # a given name may stand before an initial
            continue
        known = sum(n in ok for n in names)
        in_order = names[0].startswith("g ")
        if known == len(names):
            cands.append((3, a, b))
        elif not towns.free(a, b):
            continue
        elif in_order and names[0] in ok and pat(a, b):
            cands.append((2.5, a, b))
        elif (known or len(names) == 1) and pat(a, b):  # part of it known, or an initial with a surname
            cands.append((2, a, b))
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for m in _LOWER_PAIRS.finditer(text) if know.may_hold_given(low) else ():  # lower case: only with a known given name
        g = low[m.start(1) : m.end(1)]
        if "g " + g in ok:
            a, b = m.start(1), m.end(2)
            if "s " + parts(m.group(2)) in ok or pat(a, b) and towns.free(a, b):
                cands.append((3, a, b))
    out, held = Spans(), Spans(taken)
    for _, a, b in sorted(cands, key=lambda c: (-c[0], c[1] - c[2], c[1])):
        if out.free(a, b) and held.free(a, b):
            out.add(a, b)
    return out.spans


def items(text: str | None, know: Knowledge) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the personal data in ``text``, in order."""
    if not text:
        return []
    found, held = [], Spans()
    for s in shaped(text):
        if held.free(s.start, s.end) and know.believes(text, s):
            held.add(s.start, s.end)
            found.append(s)
    names = _names(text, know, [(s.start, s.core) for s in found], Spans([(s.core, s.end) for s in found if s.core < s.end]))
    held = Spans(names)
    out = [("name", a, b) for a, b in names]
    for s in found:
        end = s.end
        if s.core < s.end and not held.free(s.core, s.end):  # what looked like a town is a name
            end = s.core
        out.append((s.kind, s.start, end))
    return sorted(out, key=lambda x: x[1:])


def annotate(texts: DataFrame, know: Knowledge) -> DataFrame:
    """(tab, row_id, kind, item_no, start, end) of each item; item_no counts from 1 per text and kind."""
    shared = texts.sparkSession.sparkContext.broadcast(know)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for tab, row_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen: Counter = Counter()
                for kind, a, b in items(text, shared.value):
                    seen[kind] += 1
                    rows.append((tab, row_id, kind, seen[kind], a, b))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["tab", "row_id", "kind", "item_no", "start", "end"])

    return texts.select("tab", "row_id", "text").mapInArrow(run, "tab string, row_id long, kind string, item_no int, start int, end int")


def redact(texts: DataFrame, know: Knowledge) -> DataFrame:
    """(tab, row_id, text): the texts with [EMAIL], [PHONE], [ID], [ADDRESS] or [NAME] for each item and the rest untouched."""
    shared = texts.sparkSession.sparkContext.broadcast(know)

    def one(text: str | None) -> str | None:
        for kind, a, b in reversed(items(text, shared.value)):
            text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
        return text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(one, batch.column(2).to_pylist()), pa.string())], names=["tab", "row_id", "text"])

    return texts.select("tab", "row_id", "text").mapInArrow(run, "tab string, row_id long, text string")


def all_texts(memories: DataFrame, turns: DataFrame) -> DataFrame:
    """(tab, row_id, text) of both tables.  Null, empty and blank texts have no items; repeated rows count each."""
    return memories.select(F.lit("memories").alias("tab"), F.col("id").alias("row_id"), F.col("content").alias("text")).unionByName(
        turns.select(F.lit("turns").alias("tab"), F.col("turn_id").alias("row_id"), F.col("content").alias("text"))
    )


def _texts(spark: SparkSession, root: str) -> DataFrame:
    return all_texts(table(spark, root, "memories"), table(spark, root, "turns"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    texts = _texts(spark, root)
    return annotate(texts, learn(texts)).select("tab", "row_id", "kind", "item_no")


def p1_redacted(spark: SparkSession, root: str) -> DataFrame:
    texts = _texts(spark, root)
    return redact(texts, learn(texts))


ORACLE: dict = {}
QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted}
