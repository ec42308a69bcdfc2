"""Text expressions: Column to Column."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The characters that count as white space, beside ASCII's the Unicode spaces, line and paragraph separators and the mark of byte order.
WHITE = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def norm(c: Column) -> Column:
    """Null as empty, lower case, trimmed."""
    return F.lower(trimmed(F.coalesce(c, F.lit(""))))


def collapse_spaces(c: Column) -> Column:
    return trimmed(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{WHITE}]+", " "))


def tokens(c: Column, stop: Sequence[str] = (), least: int = 2) -> Column:
    """Distinct words of letters and digits with at least ``least`` characters that are no stop word."""
    words = F.split(trimmed(F.regexp_replace(norm(c), r"[^\p{L}\p{N}]+", " ")), " ")
    kept = F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(list(stop)) if stop else F.length(w) >= least)
    return F.array_distinct(kept)


def slug(c: Column, most: int = 48) -> Column:
    """Letters and digits of any script joined by hyphens, trimmed, then cut."""
    return F.left(F.regexp_replace(F.regexp_replace(norm(c), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", ""), F.lit(most))


def page_slug(c: Column, post_id: Column, most: int = 24) -> Column:
    """Hangul, ASCII letters and digits, cut, then trimmed, with the last five digits of an id."""
    words = F.regexp_replace(trimmed(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^가-힣a-zA-Z0-9\s]", " ")), r"\s+", "-")
    base = F.regexp_replace(F.left(words, F.lit(most)), r"^-+|-+$", "")
    digits = F.right(F.regexp_replace(post_id.cast("string"), r"\D", ""), F.lit(5))
    return F.concat(F.when(base == "", F.lit("post-")).otherwise(F.concat(base, F.lit("-"))), F.when(digits == "", F.lit("0")).otherwise(digits))


def ascii_slug(c: Column, most: int = 40) -> Column:
    """ASCII letters and digits in their case, trimmed of one hyphen a side, then cut."""
    return F.left(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]+", "-"), "^-|-$", ""), F.lit(most))


def contact_id(name: Column, at: Column) -> Column:
    """``oc_``, a slug of 24 characters and the 14 digits of a time."""
    base = F.coalesce(F.nullif(slug(name, 24), F.lit("")), F.lit("c"))
    return F.concat(F.lit("oc_"), base, F.lit("_"), F.left(F.regexp_replace(at, "[^0-9]", ""), F.lit(14)))


def latin_lead(c: Column) -> Column:
    """The first Latin letter in upper case, else ``#``."""
    return F.coalesce(F.nullif(F.upper(F.regexp_extract(c, "[A-Za-z]", 0)), F.lit("")), F.lit("#"))


def phone_digits(c: Column) -> Column:
    """Digits only; the country prefix 82 becomes 0."""
    return F.regexp_replace(F.regexp_replace(c, "[^0-9]", ""), "^82", "0")


def section(c: Column, marker: str, markers: Sequence[str]) -> Column:
    """The text from a marker up to the nearest other marker behind it, trimmed; empty without the marker."""
    others = "|".join(re.escape(m) for m in markers if m != marker)
    return F.regexp_replace(F.regexp_extract(c, rf"(?s){re.escape(marker)}(.*?)(?:{others}|$)", 1), r"^\s+|\s+$", "")


def synonym(c: Column, known: dict[str, str]) -> Column:
    """The value of a term, found without spaces and case; the term itself if there is none."""
    pairs = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, F.regexp_replace(F.lower(c), r"\s+", "")), c)


def stars(level: Column, most: int = 3) -> Column:
    """Full stars, then empty ones."""
    return F.concat(F.repeat(F.lit("★"), level), F.repeat(F.lit("☆"), F.lit(most) - level))


def imprint_tokens(c: Column, most: int = 6) -> Column:
    """The first different runs of two or more ASCII capitals and digits, joined by spaces."""
    runs = F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit("[A-Z0-9]{2,}"), F.lit(0)))
    return F.array_join(F.slice(runs, 1, most), " ")


def mentions(c: Column, name: Column) -> Column:
    """Whether a text names it, whatever the case; null without a name."""
    return F.when(trimmed(name) != "", F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(trimmed(name))))


def strip_tags(c: Column) -> Column:
    """Without markup, with six character references decoded one after the other, and with single spaces."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", "")
    for name, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return collapse_spaces(plain)


def escape_html(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def percent_encode(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def first_int(c: Column) -> Column:
    """The integer at the start of a text, else 0."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0))


def volume(c: Column) -> Column:
    """A search volume: below ten counts as 5, else its digits."""
    return F.when(c.rlike(r"<\s*10"), F.lit(5).cast("bigint")).otherwise(F.coalesce(F.regexp_replace(c, r"[^0-9]", "").try_cast("bigint"), F.lit(0)))


def trim_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(collapse_spaces(c), " "), 1, n), " ")


def contains_any(c: Column, phrases: Sequence[str]) -> Column:
    """Those phrases that the text holds, whatever the case, in list order."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p.lower())), F.lit(p)) for p in phrases]))


def substitute(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Phrases replaced in list order, whatever the case."""
    return reduce(lambda x, rule: F.regexp_replace(x, "(?i)" + re.escape(rule[0]), rule[1]), rules, c)


#: Request forms and interrogative markers that make a keyword a question.
REQUESTS = "주세요|주실|알려|궁금"
QUESTIONS = r"[?？]|까요|ㄹ까요|을까요|나요\b|가요\?|인가요|은가요|던가요|어떻게|어떤|얼마|언제|어디|무엇|뭐예|뭔가|왜\s|되나요|하나요|있나요|없나요|알려\s*주|추천\s*해\s*주|좋을까|할까요|되는지|무슨"


def is_question(c: Column) -> Column:
    """A request or one of the fixed interrogative markers."""
    return F.coalesce(c, F.lit("")).rlike(f"{REQUESTS}|{QUESTIONS}")


def looks_like_question(c: Column, markers: Sequence[str]) -> Column:
    """A question mark, or one of the marker words of a language."""
    return F.coalesce(c, F.lit("")).rlike(r"\?|(?i)(^|[^\p{L}])(" + "|".join(markers) + r")([^\p{L}]|$)")


def language_ratio(c: Column) -> Column:
    """Part of Hangul among Hangul and Latin letters, without markup; 0 if there are none."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", "")
    ours, latin = F.regexp_count(plain, F.lit(r"[\x{AC00}-\x{D7A3}]")), F.regexp_count(plain, F.lit("[A-Za-z]"))
    return F.coalesce(F.try_divide(ours, ours + latin), F.lit(0.0))


def initial_consonant(c: Column) -> Column:
    """The lead consonant of a Hangul syllable, doubled ones as single; else empty."""
    # fixed values: the 19 lead consonants in code order, doubled ones folded
    leads = "ㄱ ㄱ ㄴ ㄷ ㄷ ㄹ ㅁ ㅂ ㅂ ㅅ ㅅ ㅇ ㅈ ㅈ ㅊ ㅋ ㅌ ㅍ ㅎ".split()
    code = F.ascii(F.left(c, F.lit(1))) - 0xAC00
    return F.when((code >= 0) & (code < 11172), F.element_at(F.array(*map(F.lit, leads)), (F.floor(code / 588) + 1).cast("int"))).otherwise(F.lit(""))


def code_units(c: Column) -> Column:
    """The UTF-16 code units of a text as numbers."""
    digits = F.hex(F.encode(F.coalesce(c, F.lit("")), "UTF-16BE"))
    whole = F.sequence(F.lit(1), F.floor(F.length(digits) / 4).cast("int"))
    return F.when(digits == "", F.array().cast("array<bigint>")).otherwise(F.transform(whole, lambda i: F.conv(F.substring(digits, i * 4 - 3, F.lit(4)), 16, 10).cast("bigint")))


def fnv1a(c: Column) -> Column:
    """FNV-1a of the code units in 32 bits."""
    return F.aggregate(code_units(c), F.lit(2166136261).cast("bigint"), lambda h, x: h.bitwiseXOR(x) * 16777619 % 4294967296)


def poly31(c: Column) -> Column:
    """The 31-polynomial hash of the code units as a signed 32-bit number, made positive."""
    h = F.aggregate(code_units(c), F.lit(0).cast("bigint"), lambda h, x: (h * 31 + x) % 4294967296)
    return F.abs(F.when(h >= 2147483648, h - 4294967296).otherwise(h))


def djb2(c: Column) -> Column:
    """The hash h * 33 + unit from 5381 on, in 32 bits without a sign."""
    return F.aggregate(code_units(c), F.lit(5381).cast("bigint"), lambda h, x: (h * 33 + x) % 4294967296)


def mixed_radix(seed: Column, lists: Sequence[Sequence[str]], divisors: Sequence[int]) -> list[Column]:
    """One entry of each list by the digits of a seed."""
    return [F.element_at(F.array(*map(F.lit, some)), (F.floor(seed / by) % len(some) + 1).cast("int")) for some, by in zip(lists, divisors, strict=True)]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _imul(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of numbers below 2^32."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)), F.shiftright(a, 16)
    return (low * b + F.shiftleft((high * b).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def mulberry32(seed: Column, i: Column) -> Column:
    """The i-th number (from 1) in [0, 1) of the generator mulberry32."""
    u32 = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    first = lambda a: _imul(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1).cast("bigint")))
    second = lambda t: u32(t + _imul(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61).cast("bigint")))).bitwiseXOR(t)
    last = lambda t: t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0)
    return let(u32(seed + i.cast("bigint") * F.lit(0x6D2B79F5)), lambda a: let(first(a), lambda t: let(second(t), last)))
