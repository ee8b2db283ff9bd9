"""Text kernel: pure Column expressions, all inside the JVM."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop-words and verbs.
STOP_WORDS = tuple(
    "a an the and or but in on at to for of with by from up about into through during before after above below is are was were "
    "be been being have has had do does did will would should could may might must shall can it its this that these those i you "
    "he she we they what which who whom when where why how all each every both few more most other some such no nor not only own "
    "same so than too very just also now here there".split()
)
LANGUAGE_WORDS = {"en": ("the", "and", "for", "with"), "es": ("el", "la", "los", "y", "para"), "fr": ("le", "la", "les", "et", "pour"), "de": ("der", "die", "das", "und", "für")}
DESTRUCTIVE = ("delete", "remove", "cancel subscription", "unsubscribe", "pay", "checkout", "submit order", "confirm")
TYPES = ("section", "action", "field", "link", "file", "media", "structured")
TYPE_LABELS = {"section": "Section", "action": "Action", "field": "Field", "link": "Link", "file": "File", "media": "Media", "structured": "Answer"}
SOUNDEX = {"1": "BFPV", "2": "CGJKQSXZ", "3": "DT", "4": "L", "5": "MN", "6": "R"}

SPACES = r"\s+"


MARKS = "[\u0300-\u036f]"


def _accents() -> dict[str, str]:
    """Letters whose canonical decomposition is one character and marks, and that character."""
    pairs = {}
    for i in (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)):
        c = chr(i)
        if unicodedata.decomposition(c) and len(d := re.sub(MARKS, "", unicodedata.normalize("NFD", c))) == 1 and d != c:
            pairs[c] = d
    return pairs


_FOLDED = _accents()
_FROM, _TO = "".join(_FOLDED), "".join(_FOLDED.values())
_TABLE = str.maketrans(_FOLDED)


def fold(c: Column) -> Column:
    """Drop accents, composed or not; pure ASCII text is passed through untouched."""
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(F.regexp_replace(F.translate(c, _FROM, _TO), MARKS, ""))


def fold_text(s: str) -> str:
    """The same of a query: what neither side takes apart, such as Hangul, stays alike on both."""
    return re.sub(MARKS, "", s.translate(_TABLE))


def words(c: Column) -> Column:
    """Lower-case words between white space, none of them empty."""
    return F.filter(F.split(F.lower(c), SPACES), lambda w: w != "")


def stem(token: Column) -> Column:
    """Light suffix stripping: ing, ed, es, s; short tokens stay."""
    n = F.length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    return (
        F.when(n <= 2, token)
        .when(token.endswith("ing"), cut(3))
        .when(token.endswith("ed"), cut(2))
        .when(token.endswith("es") & (n > 3), cut(2))
        .when(token.endswith("s") & (n > 3), cut(1))
        .otherwise(token)
    )


def tokenize(c: Column, stop: Sequence[str] = STOP_WORDS, stemmed: bool = True) -> Column:
    """Opt-in pipeline: ASCII word tokens in lower case, without stop-words, stemmed."""
    tokens = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(*stop))
    return F.transform(tokens, stem) if stemmed else tokens


def without(stop: Sequence[str] = STOP_WORDS):
    """A token filter that drops stop-words."""
    return lambda t: F.when(~t.isin(*stop), t)


def filtered_tokens(c: Column, filters: Sequence[Callable[[Column], Column]], split: str = r"[^\p{L}\p{N}]+") -> Column:
    """Lower-case tokens through a caller's filters in turn: each maps a token to a token, or to null, which drops it.

    ``without()``, ``fold`` and ``stem`` are the common ones.
    """
    tokens = F.filter(F.split(F.lower(c), split), lambda t: t != "")
    for f in filters:
        tokens = F.filter(F.transform(tokens, f), lambda t: t.isNotNull() & (t != ""))
    return tokens


def strip_tags(c: Column) -> Column:
    """Drop tags (an unclosed one takes the rest), collapse white space; entities stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*(>|$)", ""), SPACES, " "))


def clean_html(c: Column) -> Column:
    """Blank out scripts, styles, noscript blocks and comments."""
    for pattern in ("(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?is)<noscript[^>]*>.*?</noscript>", "(?s)<!--.*?-->"):
        c = F.regexp_replace(c, pattern, " ")
    return c


def length_norm(c: Column) -> Column:
    """Grows with the length of a field towards 1."""
    return length_share(F.length(c))


def length_share(n: Column) -> Column:
    return F.lit(1.0) - F.exp(-n / F.lit(50.0))


def term_count(c: Column, term: str) -> Column:
    """How many white-space tokens of a text equal a term; the split only runs where the term occurs at all."""
    low = F.lower(c)
    return F.when(low.contains(term), F.size(F.filter(F.split(low, SPACES), lambda t: t == term))).otherwise(0)


def has_phrase(tokens: Column, phrase: Sequence[str]) -> Column:
    """Whether the phrase stands in the tokens as one run."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(" " + " ".join(phrase) + " ")


def least_distance(tokens: Column, a: str, b: str) -> Column:
    """Least distance between the places of two words, null if one is missing: one pass that keeps the last place of each."""
    if a == b:
        return F.when(F.array_contains(tokens, a), F.lit(0))
    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("i"), none.alias("a"), none.alias("b"), none.alias("best"))

    def step(s: Column, x: Column) -> Column:
        gap = F.when(x == a, s["i"] - s["b"]).when(x == b, s["i"] - s["a"])
        return F.struct((s["i"] + 1).alias("i"), F.when(x == a, s["i"]).otherwise(s["a"]).alias("a"), F.when(x == b, s["i"]).otherwise(s["b"]).alias("b"), F.least(s["best"], gap).alias("best"))

    return F.aggregate(tokens, start, step)["best"]


def least_gap(a: Column, b: Column) -> Column:
    """Least distance between two arrays of places, null if one is empty: one pass over both in order."""
    none = F.lit(None).cast("int")
    marks = F.sort_array(F.concat(F.transform(a, lambda p: F.struct(p.alias("p"), F.lit(0).alias("of"))), F.transform(b, lambda p: F.struct(p.alias("p"), F.lit(1).alias("of")))))

    def step(s: Column, x: Column) -> Column:
        first = x["of"] == 0
        gap = F.when(first, x["p"] - s["b"]).otherwise(x["p"] - s["a"])
        return F.struct(F.when(first, x["p"]).otherwise(s["a"]).alias("a"), F.when(first, s["b"]).otherwise(x["p"]).alias("b"), F.least(s["best"], gap).alias("best"))

    return F.aggregate(marks, F.struct(none.alias("a"), none.alias("b"), none.alias("best")), step)["best"]


def closeness(distances: Sequence[Column]) -> Column:
    """Mean of 2 minus a tenth of each distance that is known, each at least 1; 1 if none is."""
    gain = lambda d: F.when(d.isNotNull(), F.greatest(F.lit(1.0), F.lit(2.0) - d * 0.1))
    known = F.filter(F.array(*map(gain, distances)), lambda g: g.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, g: s + g) / F.size(known)).otherwise(F.lit(1.0))


def proximity(tokens: Column, terms: Sequence[str]) -> Column:
    """Closeness of the pairs of terms by their least distance in the tokens."""
    return closeness([least_distance(tokens, terms[i], terms[j]) for i in range(len(terms)) for j in range(i + 1, len(terms))])


def snippet(text: Column, start: Column, end: Column, context: int = 60) -> Column:
    """Excerpt around a 0-based span with the span in ``<mark>``, and dots where text is cut off."""
    n = F.length(text)
    first = F.greatest(F.lit(0), start - context)
    last = F.when(first == 0, F.least(n, end + 2 * context)).otherwise(F.least(n, end + context))
    first = F.when(last == n, F.greatest(F.lit(0), start - 2 * context)).otherwise(first)
    piece = lambda a, b: F.substring(text, a + 1, F.greatest(F.lit(0), b - a))
    dots = lambda there: F.when(there, F.lit("...")).otherwise(F.lit(""))
    return F.concat(dots(first > 0), piece(first, start), F.lit("<mark>"), piece(start, end), F.lit("</mark>"), piece(end, last), dots(last < n))


def escape_html(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def highlight(text: Column, query: str) -> Column:
    """Escaped text with the first occurrence of the query marked."""
    at, n = F.instr(F.lower(text), query.lower()), len(query)
    part = lambda a, k: escape_html(F.substring(text, a, k))
    marked = F.concat(part(F.lit(1), at - 1), F.lit("<mark>"), part(at, F.lit(n)), F.lit("</mark>"), part(at + n, F.length(text)))
    return F.when((F.lit(query.strip()) == "") | (at == 0), escape_html(text)).otherwise(marked)


def short_snippet(text: Column, query: str) -> Column:
    """30 characters before and 40 after the first occurrence, or the first 90 characters."""
    at = F.instr(F.lower(text), query.lower()) - 1
    first, last = F.greatest(F.lit(0), at - 30), F.least(F.length(text), at + len(query) + 40)
    dots = lambda there: F.when(there, F.lit("…")).otherwise(F.lit(""))
    found = F.concat(dots(first > 0), F.substring(text, first + 1, last - first), dots(last < F.length(text)))
    return F.when((at < 0) | (F.lit(query.strip()) == ""), F.concat(F.substring(text, 1, 90), F.lit("…"))).otherwise(found)


def soundex(c: Column) -> Column:
    """Phonetic code in which vowels, H and W also part two letters of one class (unlike the built-in)."""
    word = F.regexp_replace(F.upper(c), "[^A-Z]", "")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    digits = "".join(next((d for d, group in SOUNDEX.items() if a in group), "0") for a in letters)
    codes = F.split(F.translate(word, letters, digits), "")
    kept = F.filter(codes, lambda d, i: (i > 0) & (d != "0") & (d != F.element_at(codes, i)))
    return F.when(word == "", F.lit("")).otherwise(F.rpad(F.substring(F.concat(F.substring(word, 1, 1), F.array_join(kept, "")), 1, 4), 4, "0"))


def poly_hash(c: Column, first: int | None = None) -> Column:
    """Polynomial hash by 31 in wrapping 32 bits, absolute, in base 36, of a whole text, or of its ``first`` characters."""
    if first is not None:
        c = F.substring(c, 1, first)
    two32, two31 = F.lit(1 << 32), F.lit(1 << 31)
    step = lambda h, ch: F.pmod(h * 31 + F.ascii(ch) + two31, two32) - two31
    h = F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0).cast("long"), step)
    return F.lower(F.conv(F.abs(h).cast("string"), 10, 36))


def detect_language(c: Column, lists: Mapping[str, Sequence[str]] = LANGUAGE_WORDS) -> Column:
    """Language with the most distinct stop-words in a text; earlier ones win ties, the first is the default.

    A stop-word stands between ends or other characters than ASCII letters, digits and underscores. The text is
    split once for all words of such characters; any other word is looked for only where the text contains it.
    """
    low = F.lower(c)
    plain = {k: [w for w in ws if re.fullmatch("[a-z0-9_]+", w)] for k, ws in lists.items()}
    edge = lambda w: f"(^|[^A-Za-z0-9_]){w}([^A-Za-z0-9_]|$)"
    rare = {k: [(low.contains(w) & low.rlike(edge(w))).cast("int") for w in ws if w not in plain[k]] for k, ws in lists.items()}

    def best(tokens: Column) -> Column:
        n = {k: sum(rare[k], F.size(F.array_intersect(F.array(*map(F.lit, ws)), tokens)) if ws else F.lit(0)) for k, ws in plain.items()}
        top = F.greatest(*n.values()) if len(n) > 1 else next(iter(n.values()))
        out = F.lit(next(iter(lists)))
        for k in reversed(list(lists)):
            out = F.when((n[k] == top) & (top > 0), F.lit(k)).otherwise(out)
        return out

    every = F.array(*[F.lit(w) for w in dict.fromkeys(w for ws in plain.values() for w in ws)])
    # Bound once, for each language to meet only the stop-words that the text has.
    held = F.array_intersect(every, F.split(low, "[^a-z0-9_]+"))
    return F.when(c.isNotNull(), F.transform(F.array(held), best)[0])


def tokenize_language(c: Column, lang: Column) -> Column:
    """Letter and digit runs of two or more characters, without the stop-words of the text's language."""
    stop = F.lit(None).cast("array<string>")
    for k, ws in LANGUAGE_WORDS.items():
        stop = F.when(lang == k, F.array(*map(F.lit, ws))).otherwise(stop)
    stop = F.coalesce(stop, F.array(*map(F.lit, LANGUAGE_WORDS["en"])))
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def is_destructive(label: Column) -> Column:
    return F.lower(label).rlike("|".join(DESTRUCTIVE))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")


def type_label(c: Column) -> Column:
    out = F.lit("Section")
    for k, v in TYPE_LABELS.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors over their common length; 0 if one is zero."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    product = lambda x, y: total(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")))
    norm = F.sqrt(product(a, a) * product(b, b))
    return F.when(norm > 0, product(a, b) / norm).otherwise(F.lit(0.0))


def quantize(v: Column) -> Column:
    """Components over the largest magnitude (at least 1) times 127, halves rounded up."""
    top = F.greatest(F.lit(1.0), F.array_max(F.transform(v, lambda x: F.abs(x).cast("double"))))
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x.cast("double") / top * 127 + 0.5))).cast("int"))
