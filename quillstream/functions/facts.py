"""Typed values in text, by a small grammar over the words of a text.

A word has a shape, read off its characters alone: a link, a path, a quad of numbers, a name with a port, a date, a time of
day, an amount of memory, a release number, a plain number, a code of letters and digits, or a compound name. What a shape
means can depend on cue words near it in the same sentence: `port` before a number, `host` before a name, a noun such as
`gpu` near a code, a link such as `is` before a compound name or, with a noun before it, before a number (a measure). The
shapes of a word come before cues, and a word is taken once. A number without a cue is never a value.

The long form (slot, value, literal) is what joins work on. Null and empty texts have no values; repeated rows and null
keys keep rows of their own; long texts are read whole."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream import session
from quillstream.functions import dates

# Nouns that make a code of letters and digits a value, and units of memory.
NOUNS = ("gpu", "cpu", "model", "driver", "kernel", "image", "branch", "container", "chip", "card", "accelerator", "tag", "release", "distro", "os")
UNITS = ("kb", "mb", "gb", "tb", "pb", "kib", "mib", "gib", "tib", "pib")

GLUE = frozenset("is are of to at on now = : no nr number".split())
SERVING = ("listen", "run", "serv")
LINKS = frozenset("is are was were be at of to = : equals costs beträgt ist sind war liegt kostet".split())
NAMING = frozenset("is are was called named as = heißt lautet ist".split())
LEFT = frozenset("from von vom ab statt".split())
VAGUE = frozenset("a an the this that it its there here we you they i he she our your their my and or but with for in on by has have had does do will would can could should not no than then so if about around some any each every all only just also more most less least the der die das ein eine es und oder mit für in auf zu wir ihr sie ich er".split())

_SPACE = re.compile(r"\S+")
_CALL = re.compile(r"\S*[0-9/=_]\S*|\S+[.\-]\S+|\b(?:" + "|".join(n for names in dates.DAYS for n in names) + r")s?\b|\b(?:host|hostname)\b", re.I)
_OPEN, _CLOSE = "\"'`([{<*_„“”‘’«", "\"'`)]}>*,;:!?“”‘’»"
_MONTHS = {n: k for k, names in enumerate(dates.MONTHS, 1) for n in names}
_DAYS = {n for names in dates.DAYS for n in names}


@dataclass(frozen=True)
class Value:
    """A value: its slot, its normal form, how the text writes it and where, and whether the text moves away from it."""

    slot: str
    value: str
    literal: str
    start: int
    left: bool = False


class Words:
    """The words of a text without the signs about them, and where sentences end."""

    def __init__(self, text: str):
        self.text = text
        self.spans: list[tuple[int, int]] = []
        self.ends: list[bool] = []
        for m in _SPACE.finditer(text):
            a, b = m.span()
            while a < b and text[a] in _OPEN:
                a += 1
            stop = False
            while b > a and (text[b - 1] in _CLOSE or text[b - 1] == "."):
                stop |= text[b - 1] in ".;!?"
                b -= 1
            if a == b:  # signs only, such as a lone = or -
                a, b = m.span()
            self.spans.append((a, b))
            self.ends.append(stop)

    def __len__(self) -> int:
        return len(self.spans)

    def word(self, k: int) -> str:
        a, b = self.spans[k]
        return self.text[a:b]

    def low(self, k: int) -> str:
        return self.word(k).lower()

    def before(self, k: int, most: int) -> list[int]:
        """Up to `most` words before k in its sentence, the nearest first."""
        out = []
        while len(out) < most and k > 0 and not self.ends[k - 1]:
            k -= 1
            out.append(k)
        return out

    def after(self, k: int, most: int) -> list[int]:
        out = []
        while len(out) < most and k + 1 < len(self.spans) and not self.ends[k]:
            k += 1
            out.append(k)
        return out


def number(word: str) -> str | None:
    """A plain number in one form: 4.210,50 and 4,210.50 are 4210.50; None for all else."""
    if not word or not word[0].isdigit() or word.strip("0123456789.,") or not word[-1].isdigit():
        return None
    marks = [c for c in word if c in ".,"]
    if not marks:
        return word
    head, _, tail = word.rpartition(marks[-1])
    groups = re.split("[.,]", word)
    if len(set(marks)) == 1 and all(len(g) == 3 for g in groups[1:]) and (len(marks) > 1 or marks[0] == ","):
        return "".join(groups)
    if len(set(marks[:-1])) > 1 or (marks[:-1] and marks[-1] in marks[:-1]):
        return None
    return re.sub("[.,]", "", head) + "." + tail


def _quad(word: str) -> bool:
    parts = word.split(".")
    return len(parts) == 4 and all(p.isdigit() and len(p) <= 3 for p in parts)


def _name(word: str) -> bool:
    """A host's or program's name: letters, digits, inner dots and dashes, from a letter on."""
    return bool(word) and word[0].isalpha() and word.isascii() and all(p and p.replace("-", "a").isalnum() for p in word.split("."))


def _release(word: str) -> str | None:
    bare = word[1:] if word[:1] in "vV" else word
    core = re.split("[-+]", bare, maxsplit=1)[0].split(".")
    return bare if len(core) > 1 and all(p.isdigit() for p in core) else None


def _compound(word: str) -> bool:
    """A name made of parts (a-b, a_b, a.b), or one that goes on in digits, from a letter on."""
    parts = re.split(r"[-_.]", word)
    return word[:1].isalpha() and all(p.isalnum() for p in parts) and (len(parts) > 1 or any(c.isdigit() for c in word))


def _shape(word: str) -> list[tuple[str, str, int]] | None:
    """(slot, literal, offset) of a word whose characters alone tell what it is."""
    low = word.lower()
    if low.startswith(("http://", "https://")):
        return [("url", word.rstrip(".,;/"), 0)]
    name, colon, port = word.rpartition(":")
    if colon and port.isdigit() and 2 <= len(port) <= 5:
        if _quad(name):
            return [("ip", name, 0), ("port", port, len(name) + 1)]
        if _name(name) and name.lower() not in ("port", "ports"):
            return [("host", name, 0), ("port", port, len(name) + 1)][name.lower() == "localhost" :]
    if _quad(word):
        return [("ip", word, 0)]
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", word):
        return [("date", word, 0)]
    if colon and len(port) == 2 and port.isdigit() and name.isdigit() and len(name) <= 2:
        return [("time", word, 0)]
    if "/" in word and (word[0] == "/" or word.startswith(("~/", "./", "../"))) and any(c.isalpha() for c in word.rstrip("/").rpartition("/")[2]) and not re.search(r"[^\w.@+/~-]", word):
        return [("path", word.rstrip("/"), 0)]
    digits = len(word) - len(word.lstrip("0123456789.,"))
    if digits and low[digits:] in UNITS:
        return [("size", word, 0)]
    bare = _release(word)
    return [("version", bare, len(word) - len(bare))] if bare else None


def _stem(word: str) -> str:
    return word[:-1] if len(word) > 3 and word[-1] == "s" and word[-2] != "s" else word


def attribute(words: Words, k: int) -> list[str]:
    """Up to three nouns that a number at k is the measure of, the nearest last: those before a link to it."""
    back = words.before(k, 9)
    if back and words.word(back[0]).isupper() and words.word(back[0]).isalpha() and len(words.word(back[0])) <= 3:
        back = back[1:]  # a code before the number, as on plates
        linked = bool(back)
    else:
        linked = bool(back) and words.low(back[0]) in LINKS
        back = back[1:] if linked else back
    out: list[str] = []
    for i in back if linked else ():
        w = words.low(i)
        if w in VAGUE or w in LINKS or not w.replace("-", "").isalpha():
            if out:
                break
            continue
        out.append(_stem(w))
        if len(out) == 3:
            break
    return out[::-1]


def typed(text: str | None) -> list[Value]:
    """The values of a text, by their place."""
    text = text or ""
    if not _CALL.search(text):
        return []
    words = Words(text)
    starts = [a for a, _ in words.spans]
    calls = sorted({min(max(0, bisect.bisect_right(starts, m.end() - 1) - 1), len(words) - 1) for m in _CALL.finditer(text)})
    out: list[Value] = []
    taken: set[int] = set()

    def take(k: int, slot: str, literal: str, offset: int = 0, value: str | None = None) -> None:
        taken.add(k)
        near = [words.low(i) for i in words.before(k, 2)]
        away = bool(near) and (near[0] in LEFT or len(near) > 1 and near[1] in LEFT and near[0].isalpha())
        out.append(Value(slot, re.sub(r"\s+", "", (value or literal).lower()), literal, starts[k] + offset, away))

    def port(k: int) -> bool:
        back = [words.low(i) for i in words.before(k, 4)]
        glued = next((w for w in back if w not in GLUE), "")
        if glued in ("port", "ports") and 2 <= len(words.word(k)) <= 5:
            return True
        return len(words.word(k)) in (4, 5) and back[:1] == ["on"] and any(w.startswith(SERVING) for w in back[1:3])

    for k in calls:
        word, low = words.word(k), words.low(k)
        if k in taken:
            continue
        if low in ("host", "hostname"):
            for i in words.after(k, 3):
                w = words.low(i)
                if w in NAMING or w == ":":
                    continue
                if _name(words.word(i)) and w not in VAGUE | LINKS and w not in ("port", "which"):
                    take(i, "host", words.word(i))
                break
        elif low.rstrip("s") in _DAYS or low in _DAYS:
            take(k, "day", word if low in _DAYS else word[:-1])
    for k in calls:
        word = words.word(k)
        if k in taken:
            continue
        if found := _shape(word):
            for slot, literal, offset in found:
                take(k, slot, literal, offset)
        elif "=" in word.strip("=") and _compound(word.partition("=")[2]):
            take(k, "name", word.partition("=")[2], word.index("=") + 1)
    for k in calls:
        word, bare = words.word(k), words.word(k).rstrip("stndrh.")
        back, ahead = words.before(k, 4), words.after(k, 2)
        if k in taken:
            continue
        month = next((i for i in (*back[:1], *ahead[:1]) if words.low(i).rstrip(".") in _MONTHS), None)
        if bare.isdigit() and len(bare) <= 2 and month is not None:
            run = sorted((k, month))
            if (year := run[1] + 1) in (*ahead, *words.after(run[1], 1)) and re.fullmatch(r"\d{4}", words.word(year)):
                run.append(year)
            taken.update(run)
            a, b = words.spans[run[0]][0], words.spans[run[-1]][1]
            out.append(Value("date", re.sub(r"\s+", "", text[a:b].lower()), text[a:b], a))
        elif word.isdigit() and port(k):
            take(k, "port", word)
        elif number(word) and ahead and words.low(ahead[0]) in UNITS:
            taken.add(ahead[0])
            literal = text[words.spans[k][0] : words.spans[ahead[0]][1]]
            take(k, "size", literal)
        elif number(word) and (of := attribute(words, k)):
            take(k, "measure:" + "-".join(of), word, 0, number(word))
        elif not word.isdigit() and _compound(word) and any(c.isdigit() for c in word) or re.fullmatch(r"\d+[A-Za-z][\w-]*", word):
            noun = next((n for i in (*back, *ahead) for n in (words.low(i), words.low(i).rstrip("s")) if n in NOUNS), None)
            if noun:
                take(k, f"id:{noun}", word)
            elif back and words.low(back[0]) in NAMING:
                take(k, "name", word)
        elif _compound(word) and back and words.low(back[0]) in NAMING:
            take(k, "name", word)
    return sorted(out, key=lambda v: v.start)


def values(text: str | None) -> list[tuple[str, str, str]]:
    """(slot, value, literal) of a text; values are lower case without spaces."""
    return [(v.slot, v.value, v.literal) for v in typed(text)]


def slots(text: str | None, current: bool = False) -> dict[str, dict[str, str]]:
    """Literals by slot and value; current leaves out values that the text moves away from."""
    out: dict[str, dict[str, str]] = {}
    for v in typed(text):
        if not (current and v.left):
            out.setdefault(v.slot, {})[v.value] = v.literal
    return out


def same_attribute(a: str, b: str) -> bool:
    """Whether two measure slots measure the same: the same noun at the end, and no qualifiers that differ."""
    if a == b:
        return True
    one, two = (x.removeprefix("measure:").split("-") for x in (a, b))
    return a.startswith("measure:") and b.startswith("measure:") and one[-1] == two[-1] and (set(one) <= set(two) or set(two) <= set(one))


def aligned(new: dict[str, dict[str, str]], old: dict[str, dict[str, str]]) -> dict[str, dict[str, str]]:
    """The new slots under the names that the old ones have, where they measure the same."""
    return {next((o for o in old if same_attribute(n, o)), n): v for n, v in new.items()}


# -- what a sentence is about ---------------------------------------------------------------------------------------

_VERBS = frozenset("is are was were has have had runs run running lives live sits uses use listens listening serves holds keeps moved moves needs gets costs ist sind war hat haben läuft liegt nutzt braucht".split())
_MOVES = frozenset("moved migrated switched changed renamed upgraded replaced set put".split())
_STOPS = frozenset("for of in on at with to from by as which that für von in auf mit".split())
_BARE = frozenset("it this that they there he she we i you these those machine box host system computer server es sie das wir ich".split())
_ARTICLES = frozenset("the a an our my your his her their its this these user's users der die das ein eine unser unsere mein meine".split())


def lead_in(sentence: str) -> tuple[str, str]:
    """A note of up to four words before a colon (`FYI:`), and the rest."""
    head, colon, rest = sentence.partition(": ")
    return (head, rest.strip()) if colon and len(head.split()) <= 4 and not typed(head) else ("", sentence.strip())


def subject_of(sentence: str | None) -> str:
    """The noun phrase that a statement is about, '' for questions and for statements about nothing named."""
    _, text = lead_in(sentence or "")
    if not text or text.rstrip().endswith("?"):
        return ""
    words = [w.strip("*`\"'.,;:!") for w in text.split()]
    low = [w.lower() for w in words]
    verb = next((k for k, w in enumerate(low) if w in _VERBS or w in _MOVES), None)
    if verb is None:
        return ""
    if low[verb] in _MOVES and all(w in _BARE | {"have", "just"} for w in low[:verb]):
        phrase = words[verb + 1 :]
    else:
        phrase = words[:verb]
    while phrase and phrase[0].lower() in _ARTICLES:
        phrase = phrase[1:]
    end = next((k for k, w in enumerate(phrase) if w.lower() in _STOPS), len(phrase))
    phrase = phrase[:end]
    if not phrase or phrase[-1].lower() in _BARE and len(phrase) == 1:
        noun = next((v.slot.partition(":")[2] for v in typed(text) if v.slot.startswith("id:")), "")
        return noun.upper() if noun in ("gpu", "cpu", "os") else noun.capitalize()
    return display(" ".join(phrase))


def display(subject: str) -> str:
    """A subject as a title: a lower-case word at its start gets a capital."""
    subject = " ".join(subject.split())
    return subject[:1].upper() + subject[1:] if subject.split(" ")[0].islower() and len(subject.split(" ")) == 1 else subject


def subject_key(subject: str | None) -> str:
    """What two writings of one subject share: lower-case words without articles, in order."""
    return " ".join(w for w in re.findall(r"\w+", (subject or "").lower()) if w not in _ARTICLES)


def subject_tags(subject: str | None) -> list[str]:
    """The words of a subject that tell it apart: not those that name a kind of thing."""
    kinds = _BARE | {"instance", "service", "project", "application", "app", "cluster", "database"}
    return [w for w in dict.fromkeys(re.findall(r"[a-z0-9][a-z0-9.-]*", (subject or "").lower())) if w not in kinds and w not in _ARTICLES]


def qualified_subject(a: str, b: str) -> bool:
    """Whether two subjects can be one: the same last word, and the words before it nested."""
    one, two = subject_key(a).split(), subject_key(b).split()
    return bool(one and two) and one[-1] == two[-1] and (set(one) <= set(two) or set(two) <= set(one))


def proper_names(text: str | None) -> set[str]:
    """Capitalised words that do not begin a sentence."""
    words = Words(text or "")
    return {words.word(k) for k in range(1, len(words)) if not words.ends[k - 1] and words.word(k)[:1].isupper() and words.low(k) not in VAGUE}


def known_numbers(text: str, *sources: str) -> bool:
    """Whether every number of a text stands in a source."""
    have = {x for s in sources for x in re.findall(r"\d+", s)}
    return set(re.findall(r"\d+", text)) <= have


_OUT = pa.schema([("id", pa.int64()), ("slot", pa.string()), ("value", pa.string()), ("literal", pa.string())])


def _long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, *v) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for v in dict.fromkeys(values(t))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.types)], schema=_OUT)


def typed_values(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, slot, value, literal: one row per distinct typed value of a text."""
    session.ship(rows.sparkSession)
    long = rows.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(_long, "id long, slot string, value string, literal string")
    return long.withColumnRenamed("id", key)
