"""Column functions on transcripts: normalisation, tags, words, and tagged text as words and events."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from murmura.functions.arrays import bound

#: The bracket grammar of tags, and the Unicode classes that count as punctuation and white space.
TAG = r"\[[^\[\]]*\]|[^\s\[\]]+"
BRACKETED = r"\[[^\[\]]*\]"
MARKS = r"[\p{P}\p{S}]"
BLANKS = r"[\s\p{Z}]+"
#: What a token that begins a word starts with.
WORD_START = "[ ▁]"


@F.arrow_udf(StringType())
def composed(text: pa.Array) -> pa.Array:
    """Unicode normal form C, which Spark has no function for; a few texts are Python objects at once."""
    parts = [text.slice(at, 100) for at in range(0, len(text), 100)]
    made = [p if p.null_count == len(p) else pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in p.to_pylist()], pa.string()) for p in parts]
    return pa.concat_arrays(made).cast(pa.string()) if made else text


@lru_cache(1)
def unsettled() -> str:
    """A pattern of the characters without which a text is in normal form C for sure: all but long stretches of characters that neither change nor move.

    Few stretches, as a pattern tries one after the other; what lies between them is merely looked at.
    """
    own = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3), *range(0xD800, 0xE000)}
    for i in (*range(0x300, 0xD800), *range(0xE000, 0x20000)):
        c = chr(i)
        pair = unicodedata.decomposition(c)
        if pair and not pair.startswith("<"):
            own.update(int(x, 16) for x in pair.split()[1:])
            if unicodedata.normalize("NFC", c) != c:
                own.add(i)
        elif unicodedata.combining(c) or unicodedata.category(c) == "Cn":
            own.add(i)
    ends = [-1, *sorted(own), 0x20000]
    settled = [(x + 1, y - 1) for x, y in zip(ends, ends[1:], strict=False) if y - x > 80 and x < 0xFFFF]
    return r"[\x{300}-\x{10FFFF}&&" + ranges(set(), settled).replace("[", "[^", 1) + "]"  # Latin letters are settled by one comparison each


def ranges(characters: set[int], more: list[tuple[int, int]] = []) -> str:  # noqa: B006
    """A character class of these code points and further ranges."""
    runs = zip(sorted(x for x in characters if x - 1 not in characters), sorted(x for x in characters if x + 1 not in characters), strict=True)
    return "[" + "".join(rf"\x{{{i:X}}}-\x{{{j:X}}}" for i, j in (*runs, *more)) + "]"


def nfc(text: Column) -> Column:
    """Normal form C; only texts that may not be in it yet are sent to Python."""
    return F.coalesce(composed(F.when(text.rlike(unsettled()), text)), text)


def normalized(text: Column, lower: bool = True, marks: bool = True) -> Column:
    """Lower case, punctuation and symbols as blanks, white space collapsed. For composed text, apply nfc() first."""
    out = F.lower(text) if lower else text
    out = F.regexp_replace(out, MARKS, " ") if marks else out
    return F.trim(F.regexp_replace(out, BLANKS, " "))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[!-~[^\s\p{Z}]]+"), F.lit(0))


#: Separators of words beyond ASCII, which are all of three bytes but U+00A0.
BLANK = np.array([0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def pooled(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, a line end after each, and where each one's line end is; null is empty."""
    texts = texts.fill_null("").cast(pa.binary())
    cuts = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    ends = np.cumsum(np.diff(cuts) + 1) - 1
    raw = np.full(int(ends[-1]) + 1 if len(ends) else 0, 10, np.uint8)
    inside = np.ones(len(raw), bool)
    inside[ends] = False
    raw[inside] = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
    return raw, ends


def stretches(batches, column: str, most: int = 500_000):
    """Batches in parts whose texts have so many bytes together (or one text), so that arrays with a number a byte stay small; a batch without rows has no part."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def separators(raw: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to no word, as words() has them."""
    out = (raw == 32) | ((raw >= 9) & (raw <= 13))
    at = np.flatnonzero(raw == 0xC2)
    at = at[raw[at + 1] == 0xA0]
    out[at] = out[at + 1] = True
    at = np.flatnonzero((raw[:-2] >= 0xE1) & (raw[:-2] <= 0xE3))
    code = (raw[at].astype(np.int64) & 15) << 12 | (raw[at + 1].astype(np.int64) & 63) << 6 | raw[at + 2] & 63
    at = at[np.isin(code, BLANK)]
    out[at] = out[at + 1] = out[at + 2] = True
    return out


def cut(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The texts between places of bytes."""
    size = stops - starts
    keep = np.repeat(starts, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(raw[keep])])


def word_sizes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The text and the number of characters of each word, as words() has them, of texts in order; no word is copied."""
    raw, ends = pooled(texts)
    word = ~separators(raw)
    first = np.flatnonzero(word & ~np.r_[False, word[:-1]])
    stop = np.flatnonzero(word & ~np.r_[word[1:], False]) + 1
    characters = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return np.searchsorted(ends, first), characters[stop] - characters[first]


def normalized_words(text: Column) -> Column:
    """words(normalized(text)) in one pass: what stands between blanks and marks."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z[^\s\p{Z}\p{P}\p{S}]]+"), F.lit(0))  # most letters by one comparison each


def tokens(tagged: Column) -> Column:
    """Words and [tags] in order; a tag always ends a word."""
    return F.regexp_extract_all(tagged, F.lit(TAG), F.lit(0))


def tag_name(token: Column) -> Column:
    """The lower-cased name inside a tag; null for a word."""
    return F.when(token.startswith("["), F.lower(F.regexp_replace(token, r"^\[[\s\p{Z}]*|[\s\p{Z}]*\]$", "")))


def unbalanced(tagged: Column) -> Column:
    """Does a bracket remain once all tags are gone."""
    return F.regexp_replace(tagged, BRACKETED, " ").rlike(r"[\[\]]")


def tolerant(tagged: Column) -> Column:
    """struct<words, events: array<struct<e, type, gap>>> of a tagged text that may be torn: what is no whole tag stays a word, brackets included."""
    tags = F.regexp_extract_all(tagged, F.lit(BRACKETED), F.lit(0))

    def of(between):
        sizes = F.transform(between, F.size)
        before = F.aggregate(sizes, F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
        events = bound(before, lambda b: F.transform(tags, lambda t, e: F.struct(e.alias("e"), tag_name(t).alias("type"), F.get(b, e + 1).alias("gap"))))
        return F.struct(F.flatten(between).alias("words"), events.alias("events"))

    return bound(F.transform(F.split(tagged, BRACKETED, -1), words), of)


def placed(tagged: Column) -> Column:
    """struct<n_words, events: array<struct<e, type, gap>>> of a tagged text, as parsed() has them; no events where a bracket has no pair.

    Words are counted, not kept: tokens are looked at once, for the places of tags among them.
    """

    def of(t, all_):
        at = F.filter(F.transform(all_, lambda x, i: F.when(x.startswith("["), i)), lambda i: i.isNotNull())
        return bound(at, lambda at: shaped(t, all_, at))

    def shaped(t, all_, at):
        brackets = F.octet_length(t) - F.octet_length(F.replace(F.replace(t, F.lit("[")), F.lit("]")))
        events = F.transform(at, lambda i, e: F.struct(e.alias("e"), tag_name(F.get(all_, i)).alias("type"), (i - e).alias("gap")))
        return F.struct((F.size(all_) - F.size(at)).alias("n_words"), F.when(brackets == 2 * F.size(at), events).alias("events"))

    return bound(tagged, lambda t: bound(tokens(t), lambda all_: of(t, all_)))


#: Letters of some languages beside a to z.
LETTERS = {
    "en": "", "de": "äöüß", "fr": "àâæçéèêëîïôœùûüÿ", "es": "áéíñóúü",
    "vi": "àáảãạăằắẳẵặâầấẩẫậđèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ",
}


def alphabet(language: str) -> str:
    """The letters of one of LETTERS' languages, or, of any other text, the letters that it holds."""
    return "abcdefghijklmnopqrstuvwxyz" + LETTERS.get(language, language)


def foreign(text: Column, language: str, most: int = 10) -> Column:
    """The first letters, in order, that aren't the language's."""
    letters = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}"), F.lit(0)))
    return F.slice(F.array_sort(F.array_except(letters, F.array(*map(F.lit, alphabet(language))))), 1, most)


@lru_cache(1)
def digit() -> str:
    """A pattern of digits: the decimal ones, and those of Unicode's other numbers that are single digits (raised, lowered, circled).

    As ranges, since engines know different versions of Unicode.
    """
    return ranges({i for i in range(0x110000) if chr(i).isdigit()})


def parsed(tagged: Column, known: list[str] | None = None, unknown: str = "keep") -> Column:
    """struct<words, events: array<struct<e, type, gap>>, unknown, error> of a tagged text; gap is the number of words before.

    An event's gap is its place among the tokens less the number of tags before it, so nothing is counted token by token.
    Tags that known doesn't list (an empty one is never known) are kept as events, dropped, or an error, as unknown says.
    A text with brackets that don't pair up is an error; errors have neither words nor events. To use several fields, take
    them by inline(array(parsed(...))): a field of a struct evaluates it once each.
    """
    if unknown not in ("keep", "drop", "error"):
        raise ValueError(f"no such policy for unknown tags: {unknown}")

    def of(tagged, all_):
        tags = F.filter(F.transform(all_, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"].startswith("["))
        events = F.transform(tags, lambda x, e: F.struct(tag_name(x["t"]).alias("type"), (x["i"] - e).alias("gap")))
        return bound(events, lambda ev: shaped(tagged, F.filter(all_, lambda t: ~t.startswith("[")), ev))

    def is_known(x):
        return F.lit(True) if known is None else (x["type"] != "") & x["type"].isin(known)

    def shaped(tagged, own, events):
        strange = F.transform(F.filter(events, lambda x: ~is_known(x)), lambda x: x["type"])
        kept = F.filter(events, is_known) if unknown == "drop" else events
        error = F.when(unbalanced(tagged), "unbalanced bracket")
        if unknown == "error":
            error = error.when(F.size(strange) > 0, F.concat(F.lit("unknown tag: "), F.get(strange, 0)))
        error = error.otherwise(F.lit(None).cast("string"))
        numbered = F.transform(kept, lambda x, e: F.struct(e.alias("e"), x["type"].alias("type"), x["gap"].alias("gap")))

        def row(error):
            clean = lambda x: F.when(error.isNull(), x)
            return F.struct(clean(own).alias("words"), clean(numbered).alias("events"), strange.alias("unknown"), error.alias("error"))

        return bound(error, row)

    return bound(tagged, lambda t: bound(tokens(t), lambda all_: of(t, all_)))


def rendered(words: Column, events: Column) -> Column:
    """The tagged text of words and events: the inverse of parsed, but for white space and capitals in tags."""
    own = F.transform(words, lambda w, i: F.struct(i.alias("gap"), F.lit(1).alias("k"), F.lit(0).alias("e"), w.alias("s")))
    tags = F.transform(events, lambda x: F.struct(x["gap"].alias("gap"), F.lit(0).alias("k"), x["e"].alias("e"), F.concat(F.lit("["), x["type"], F.lit("]")).alias("s")))
    return F.array_join(F.transform(F.array_sort(F.concat(own, tags)), lambda x: x["s"]), " ")


#: Punctuation beside which a tag is flagged: ASCII but for brackets, and the common blocks of others.
BESIDE = r"""[!"#%&'()*,\-./:;?@\\_{}$+<=>^`|~\x{A1}-\x{BF}\x{2010}-\x{2027}]"""
#: Quality flags of a tagged transcript, as patterns; the ninth, decomposed, is a comparison with nfc().
FLAGS = {
    "upper": r"\p{Lu}", "digit": r"\p{Nd}", "punct": MARKS, "white": r"[\s\p{Z}]{2}|^[\s\p{Z}]|[\s\p{Z}]\z", "wide": r"[^\x00-\x7F]", "bracket": r"[\[\]]",
    "glued": r"[^\s\[]\[[^\[\]]*\]|\[[^\[\]]*\][^\s\]]", "beside_punct": BESIDE + r"\s*\[[^\[\]]*\]|\[[^\[\]]*\]\s*" + BESIDE,
}
