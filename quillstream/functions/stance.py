"""Who a statement is about, and whether it is meant: a small grammar of clauses in English and German.

A message falls into sentences (a bracket is one of its own), a sentence into clauses. Words belong to classes; a clause's
opening words give its subject. `refusal` finds the sentence a claim was taken from and says why it is no fact of the user's."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillstream.functions import dates

_set = lambda words: frozenset(words.split())
#: Classes of words, lower-cased.
FAMILY = _set("mother father mom mum dad parent parents son daughter kid kids child wife husband partner brother sister grandma grandpa aunt uncle cousin nephew niece mutter vater mama papa eltern sohn tochter kind frau mann bruder schwester oma opa tante onkel cousine neffe nichte")
OTHERS = _set("friend friends colleague colleagues coworker neighbour neighbor neighbours neighbors boss manager client customer teammate roommate flatmate doctor landlord trainer coach teacher freund freundin kollege kollegin kollegen nachbar nachbarin chef chefin kunde kundin arzt ärztin vermieter vermieterin mitbewohner lehrer lehrerin")
OWNING = _set("my our the a his her their user's mein meine meinem meinen meiner unser unsere unserem der die das des ein eine")
SELF = _set("i i'm i've i'll i'd we we're we've we'll my mine our ours me us ich wir mein meine meinem meinen meiner mich mir unser unsere unserem unseren uns")
ACTING = _set("i i'm i've i'll we we're we've we'll ich wir")
OPINION = _set("think guess feel believe suppose reckon find mean hope wonder denke glaube finde meine hoffe vermute")
PRONOUNS = _set("he she they er sie")
SAYING = _set("said says told mentioned claims claimed thinks sagt sagte meint meinte erzählt erzählte")
IMPOSING = _set("wants requires requested demands mandated mandates insists expects asked verlangt fordert will möchte")
MODAL = _set("could should would might may must can will shall könnte könnten sollte sollten würde würden")
UNSURE = _set("maybe perhaps probably possibly hypothetically supposedly apparently vielleicht wahrscheinlich vermutlich hypothetisch angeblich might would bräuchten bräuchte wäre")
CONDITION = _set("if wenn falls unless suppose imagine assuming angenommen")
SOMEDAY = _set("someday eventually irgendwann")
FILLER = _set("by the way also btw and but so oh well übrigens und aber fyi heads-up since because because now")
VALUE_OF_TIME = ("one day", "at some point", "i'd love", "i'd like", "would love", "would like", "i wish", "ich möchte", "ich würde gern", "wir möchten")
UNDECIDED = ("nothing is decided", "nothing's decided", "nothing decided", "nothing is planned", "nothing's planned", "not decided yet", "only asking", "just asking", "thinking out loud", "nichts entschieden", "nichts geplant")
JEST = ("oh sure", "oh great", "oh lovely", "oh wonderful", "oh joy", "yeah, because", "yeah right", "as if ", "ha, ", "haha", "na klar,", "ja klar,")
JEST_END = re.compile(r"(?:,\s*(?:ha|haha|lol)|just what i needed|\(not\))[.!]*$")
NOT_OURS = ("not ours", "not mine", "not my ", "not our ", "none of my", "none of our", "nicht unser", "nicht mein", "nicht bei uns")
SURE = _set("always never only all immer nie nur")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*['’]?")
_BREAK = re.compile(r";\s+|,\s+(?=(?:and|but|so|which|whom?|since|because|und|aber|weil|der|die|das)\b|(?:i|we|ich|wir)(?:['’]\w+)?\s)|,\s+(?=(?:can|could|would|does|do|is|are)\s+\w+\b[^,]*\?)|\s+[—–]\s+", re.I)


@dataclass(frozen=True)
class Clause:
    """A part of a sentence, its words, and whether the sentence asks."""

    text: str
    words: tuple[str, ...]
    asks: bool

    def opening(self) -> list[str]:
        k = 0
        while k < len(self.words) and self.words[k] in FILLER - OWNING:
            k += 1
        return list(self.words[k:])


def _words(text: str) -> tuple[str, ...]:
    return tuple(w.replace("’", "'").lower() for w in _WORD.findall(text))


def sentences(message: str | None) -> list[str]:
    """Sentences of a message without its statement of the date; what stands in brackets is apart, after the others."""
    text = dates.strip_statement(message or "")
    inner = re.findall(r"\(([^()]{12,})\)", text)
    outer = re.sub(r"\([^()]{12,}\)", " ", text)
    return [s.strip() for t in [outer, *inner] for s in re.split(r"(?<=[.!?])\s+", t) if s.strip()]


def clauses(sentence: str) -> list[Clause]:
    parts = [p for p in _BREAK.split(sentence) if p and p.strip()]
    asks = sentence.rstrip().endswith("?")
    return [Clause(p, _words(p), asks) for p in parts]


def _root(word: str) -> str:
    word = re.sub(r"['’]s?$", "", word)
    return word[:5] if len(word) > 5 and not any(c.isdigit() for c in word) else word


def _telling(words: tuple[str, ...]) -> set[str]:
    """Beginnings of the words that tell a statement apart: no owners, no single letters."""
    return {_root(w) for w in words if w not in OWNING | SELF and (len(w) > 2 or w.isdigit())}


def _acts(words: tuple[str, ...]) -> bool:
    """Whether the user does something in it: a first person that is not followed by a mere opinion."""
    return any(w in ACTING and not set(words[k + 1 : k + 3]) & OPINION for k, w in enumerate(words))


def _person(words: list[str]) -> int:
    """Where a person is named as the owner or subject in the opening words, or -1."""
    for k, w in enumerate(words[:5]):
        bare = re.sub(r"['’]s?$", "", w)
        kin = bare.split("-in-law")[0]
        if (kin in FAMILY | OTHERS) and (k == 0 or words[k - 1] in OWNING or (k > 1 and words[k - 2] in OWNING)):
            return k
    return -1


def belongs_to_other(sentence: str, within: Clause | None = None) -> bool:
    """Whether a sentence (or a clause in it) states another person's own thing: another person is its subject or owner, or
    only says it. What others demand of the user, say about them, or do together with them is the user's; so is what
    happens to family where the user acts on it in the same sentence."""
    low = sentence.lower()
    if any(x in low for x in NOT_OURS):
        return True
    clause = within or Clause(sentence, _words(sentence), False)
    words = clause.opening()
    every = _words(sentence)
    k = _person(words)
    if k < 0:
        speaker = next((i for i, w in enumerate(words[:4]) if w in SAYING), -1)
        if speaker > 0:
            name = re.search(r"[^\W_]+(?=\s+" + re.escape(words[speaker]) + r"\b)", clause.text)
            who = words[speaker - 1]
            named = who in PRONOUNS or (name is not None and name[0][:1].isupper() and len(words[:speaker]) == 1 and who not in OWNING)
            return named and not set(words[speaker + 1 :]) & SELF
        return False
    after = words[k + 1 :]
    if after[:2] in (["and", "i"], ["und", "ich"]):
        return False
    if set(after) & SELF and set(after[:5]) & (IMPOSING | SAYING):
        return False
    kin = re.sub(r"['’]s?$", "", words[k]).split("-in-law")[0]
    if kin in FAMILY and "-in-law" not in words[k] and _acts(every):
        return False
    return True


def mood(sentence: str, clause: Clause | None = None, message: str = "") -> str:
    """stated, question, hypothetical, wish or jest: how a clause of a sentence is meant."""
    low, text = sentence.lower().replace("’", "'"), (message or sentence).lower().replace("’", "'")
    clause = clause or Clause(sentence, _words(sentence), sentence.rstrip().endswith("?"))
    words = clause.opening()
    if low.startswith(JEST) or JEST_END.search(low):
        return "jest"
    if clause.asks:
        own = words[:1] and words[0] in ACTING and not set(words[1:4]) & (OPINION | MODAL) and not clause.text.rstrip().endswith("?")
        relative = words[:1] and words[0] in {"which", "who", "whom"} and words[1:2] and words[1] in ACTING
        if not (own or relative):
            return "question"
    part = clause.text.lower().replace("’", "'")
    if any(x in text for x in UNDECIDED):
        return "hypothetical"
    if any(w in SOMEDAY for w in words) or any(x in part for x in VALUE_OF_TIME):
        return "wish"
    lead = list(_words(sentence))[:6]
    if set(lead[:4]) & CONDITION or set(words) & UNSURE or words[:2] == ["what", "if"]:
        return "hypothetical"
    if len(words) > 1 and words[0] in {"we", "wir"} and words[1] in MODAL and not set(words[2:4]) & SURE:
        return "hypothetical"
    return "stated"


def source(claim: str, message: str) -> tuple[str, Clause] | None:
    """The sentence and clause of a message that share most with a claim, the first of equals; None where none shares any."""
    want, best = _telling(_words(claim)), (0.0, None)
    if not want:
        return None
    for s in sentences(message):
        parts = clauses(s)
        have = [{_root(w) for w in c.words} for c in parts]
        whole = len(want & set().union(*have))
        for c, h in zip(parts, have):
            score = len(want & h) + whole / 8
            if score > best[0]:
                best = (score, (s, c))
    return best[1]


def refusal(claim: str | None, message: str | None) -> str:
    """Why a claim that a message is said to state is no fact of its author: third party, question, hypothetical, wish,
    jest; empty where it is one, or where the message has nothing of it (which grounding decides)."""
    found = source(claim or "", message or "")
    if found is None:
        return ""
    sentence, clause = found
    if belongs_to_other(sentence, clause):
        return "third party"
    how = mood(sentence, clause, message or "")
    return "" if how == "stated" else how


@F.pandas_udf(StringType())
def refusals(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for claims, messages in rows:
        yield pd.Series([refusal(c, m) for c, m in zip(claims, messages)], dtype=object)
