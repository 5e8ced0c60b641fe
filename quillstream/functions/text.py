"""Text functions as Columns: tokens, stems, query terms, overlap, excerpts, redaction, labels. All run in the JVM, but for
TokenSets, which is for whole tables of texts."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in claims, and in queries.
STOPWORDS = tuple("""
a an and are as at be been being but by can could did do does doing for from had has have having he her
here hers him his how i if in into is it its itself just me my no nor not of on once only or other our
ours out over own same she should so some such than that the their theirs them then there these they
this those through to too under until up very was we were what when where which while who whom why will
with would you your yours also about above after again all am any because before below between both
down during each few further more most off per via yes ok okay
t s d ll re ve m don doesn didn isn aren wasn weren won wouldn shouldn couldn hasn haven hadn
""".split())
QUERY_STOPWORDS = tuple("""
a an and are as at be but by can could did do does for from had has have how i if in into is it its
me my no not of on or our should so than that the their them then there these they this to us was
we were what when where which who why will with would you your please pls thanks thank hi hello
about above after again all also am any because been before being both each few just more most
other over same some such too very here now only own up out off tell show give know like want get
let lets one
answer answers reply respond sentence briefly short remember recall without exactly currently
""".split())
#: Letters with marks, and the letters that they are without them, by Unicode decomposition.
_MARKED = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(unicodedata.normalize("NFKD", chr(c))) > 1 and unicodedata.normalize("NFKD", chr(c))[0].isascii() and unicodedata.normalize("NFKD", chr(c))[0].isalpha()]
_FROM, _TO = ("".join(x[k] for x in _MARKED) for k in (0, 1))
LABEL = r"^(?:assistant reported:|\(inferred\)|\(observed\))\s*"
#: Kinds of secrets in order of their tests, as Java patterns without look-around.
SECRETS = (
    ("api_key", r"\b(?:AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{20,})\b"),
    ("url_credentials", r"\b[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@"),
    ("bearer", r"\b[Bb]earer [A-Za-z0-9._~+/-]{16,}=*"),
    ("credential", r"\b(?:(?:password|passwd|token|api_key)\s*[=:]|secret\s*=)\s*\"?[A-Za-z0-9_./+-]{8,}\"?"),
)


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def stem(token: Column) -> Column:
    """A light stem: short words and words with digits stay; ies, ing, ed, es, s go where three letters remain."""
    n = F.length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    ends = lambda c, s: F.endswith(c, F.lit(s))
    base = (
        F.when(ends(token, "ies") & (n >= 6), F.concat(cut(3), F.lit("i")))
        .when(ends(token, "ing") & (n >= 6), cut(3))
        .when(ends(token, "ed") & (n >= 5), cut(2))
        .when(ends(token, "es") & (n >= 5), cut(2))
        .when(ends(token, "s") & (n >= 4), cut(1))
        .otherwise(token)
    )
    trimmed = F.when(ends(base, "e") & (F.length(base) > 4), F.substring(base, F.lit(1), F.length(base) - 1)).otherwise(base)
    digits = F.length(F.translate(token, "0123456789", "")) < n
    return F.when((n <= 4) | digits, token).otherwise(trimmed)


def plain_words(text: Column) -> Column:
    """The ASCII words of a text that are no stopwords."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda w: ~w.isin(*STOPWORDS))


def tokens(text: Column) -> Column:
    """Stems of the ASCII words of a text that are no stopwords."""
    return F.transform(plain_words(text), stem)


class TokenSets:
    """The set of tokens() of a text, for Python workers: every different word is stemmed once while it is kept."""

    def __init__(self, most: int = 200_000):
        self.most, self.known = most, dict.fromkeys((w.encode() for w in STOPWORDS), "")

    def of(self, lowered: bytes) -> set[str]:
        """The tokens of a text (UTF-8, in lower case)."""
        if len(self.known) > self.most:
            self.__init__(self.most)
        out = set()
        for w in set(_PLAIN(lowered)):
            token = self.known.get(w)
            if token is None:
                token = _stemmed(w.decode())
                if len(w) <= 64:
                    self.known[w] = token
            out.add(token)
        out.discard("")
        return out


_PLAIN = re.compile(rb"[a-z0-9]+").findall
_DIGIT = re.compile("[0-9]").search


def _stemmed(w: str) -> str:
    """stem() of a word."""
    n = len(w)
    if n <= 4 or _DIGIT(w):
        return w
    if w.endswith("ies") and n >= 6:
        base = w[:-3] + "i"
    elif w.endswith("ing") and n >= 6:
        base = w[:-3]
    elif w.endswith(("ed", "es")):
        base = w[:-2]
    else:
        base = w.removesuffix("s")
    return base[:-1] if base.endswith("e") and len(base) > 4 else base


def query_terms(query: Column, most: int = 24) -> Column:
    """Distinct words of a query, cut to 64 characters, without stopwords and short numbers unless nothing else is left."""
    every = F.transform(words(query), lambda w: F.substring(w, 1, 64))
    kept = F.filter(every, lambda w: ~w.isin(*QUERY_STOPWORDS) & ~w.rlike("^[0-9]{1,2}$"))
    return F.slice(F.array_distinct(F.when(F.size(kept) > 0, kept).otherwise(every)), 1, most)


def overlap(claim: Column, text: Column) -> Column:
    """Share of the claim's distinct tokens that the text has; 0 for a claim without tokens."""
    a = F.array_distinct(claim)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, text)) / F.size(a))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def shorten(text: Column, n: int) -> Column:
    """Cut at a word's end, with an ellipsis, if longer than n."""
    head = F.regexp_extract(text, rf"^(.{{0,{n - 1}}})(?:\s|$)", 1)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.when(F.length(head) > 0, head).otherwise(F.substring(text, 1, n - 1)), F.lit("…")))


def _inside(data: Column, n: int) -> Column:
    """How many of the first n bytes of UTF-8 are whole characters; data goes at least a byte beyond, or ends there."""
    part = F.hex(F.substring(data, n - 2, 4))  # the bytes about the cut: at n - 3, n - 2, n - 1 and n
    inner = lambda k: F.substring(part, 2 * k + 1, 1).isin("8", "9", "A", "B")
    return F.when(~inner(3), n).when(~inner(2), n - 1).when(~inner(1), n - 2).otherwise(n - 3)


def excerpt(text: Column, n: int) -> Column:
    """At most n bytes of UTF-8 (n >= 4), whole characters, and a mark of the bytes left out."""
    data = F.encode(text, "UTF-8")
    cut = F.decode(F.substr(data, F.lit(1), _inside(data, n)), "UTF-8")
    return F.when(F.octet_length(text) <= n, text).otherwise(F.concat(cut, F.lit("…[+"), (F.octet_length(text) - n).cast("string"), F.lit(" bytes]")))


def head_tail(text: Column, n: int) -> Column:
    """The first and last n/2 bytes of a longer text, whole characters, with a mark of how many are left out."""
    half, size, data = n // 2, F.octet_length(text), F.encode(text, "UTF-8")
    end = F.hex(F.substr(data, size - half + 1, F.lit(4)))
    inner = lambda k: F.substring(end, 2 * k + 1, 1).isin("8", "9", "A", "B")
    skip = F.when(~inner(0), 0).when(~inner(1), 1).when(~inner(2), 2).otherwise(3)
    tail = F.decode(F.substr(data, size - half + 1 + skip, F.lit(half) - skip), "UTF-8")
    head = F.decode(F.substr(data, F.lit(1), _inside(data, half)), "UTF-8")
    mark = F.concat(F.lit("…["), (size - 2 * half).cast("string"), F.lit(" bytes omitted]…"))
    return F.when(size <= n, text).otherwise(F.concat(head, mark, tail))


def unlabel(text: Column) -> Column:
    return F.regexp_replace(text, f"(?i){LABEL}", "")


def slugify(text: Column, n: int = 64) -> Column:
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "äöüàáâçèéêëìíîïñòóôùúû", "aouaaaceeeeiiiinooouuu")
    return F.btrim(F.substring(F.btrim(F.regexp_replace(F.replace(plain, F.lit("ß"), F.lit("ss")), "[^a-z0-9]+", "-"), F.lit("-")), 1, n), F.lit("-"))


def redact(text: Column) -> Column:
    """Secrets become [secret:kind]; a placeholder is never inside another."""
    for kind, pattern in SECRETS:
        text = F.regexp_replace(text, pattern, f"[secret:{kind}]")
    return text


def secret_kinds(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in SECRETS]))


def normalize(text: Column) -> Column:
    """Lower case, letters without their marks, other characters than ASCII gone, marks of Markdown as spaces, single
    spaces."""
    plain = F.lower(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _FROM, _TO), r"[^\x00-\x7F]+", ""))
    return F.btrim(F.regexp_replace(F.regexp_replace(plain, r"[`*_>#|]", " "), r"\s+", " "))


def sentences(text: Column) -> Column:
    """Parts between line ends, or after . ! ? before white space."""
    cut = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])[ \t\n\r]+", "$1\n"), "\n")
    return F.filter(F.transform(cut, lambda s: F.btrim(s)), lambda s: s != "")


def parse_ts(text: Column) -> Column:
    """ISO time as epoch seconds, 0.0 where it can't be read; without a zone it is UTC."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(text)) / 1e6, F.lit(0.0))


def contains_all(text: Column, needed: Column) -> Column:
    return F.size(F.array_except(needed, text)) == 0


def clip(text: Column, n: int) -> Column:
    """The first two thirds and the last third of n characters of a longer text, with a mark between."""
    head = n * 2 // 3
    mark = F.lit(" … ")
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, head)), mark, F.ltrim(F.right(text, F.lit(n - head)))))


def compact_slug(text: Column, words_most: int = 6, n: int = 48) -> Column:
    """A slug of the first content words of a text, without a trailing statement of its day."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*\(stated \d{4}-\d{2}-\d{2}\)\s*$", "")
    every = F.filter(F.split(slugify(bare, 4096), "-"), lambda w: w != "")
    kept = F.filter(every, lambda w: ~w.isin(*STOPWORDS))
    return F.btrim(F.substring(F.array_join(F.slice(F.when(F.size(kept) > 0, kept).otherwise(every), 1, words_most), "-"), 1, n), F.lit("-"))


def to_text(parts: Column) -> Column:
    """Message parts array<struct<type, text>> as lines; a part that is no text is its type in brackets."""
    return F.array_join(F.transform(parts, lambda p: F.when(p["type"] == "text", F.coalesce(p["text"], F.lit(""))).otherwise(F.concat(F.lit("["), F.coalesce(p["type"], F.lit("part")), F.lit("]")))), "\n")
