"""Text primitives with ECMAScript's idea of white space, word edges and length.

Java's \\s, \\b and length differ from it outside ASCII, so the classes are spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, without the brackets of a class (fixed values).
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: An edge between an ASCII word character and anything else.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: Pictographic characters: ranges of the Unicode property Extended_Pictographic (fixed values).
_PICTOGRAPHIC = """
A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0
25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 2642
2648-2653 265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB
26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705
2708-270D 270F 2712 2714 2716 271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797
27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299
1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1AF-1F1E5 1F201-1F20F 1F21A 1F22F 1F232-1F23A 1F23C-1F23F
1F249-1F25F 1F266-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F3FA 1F400-1F4FD
1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8
1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5
1F6CB-1F6D2 1F6D5-1F6E5 1F6E9 1F6EB-1F6F0 1F6F3-1F6FF 1F7DC-1F7F0 1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA6E-1FAFF
"""
EMOJI = "[" + "".join("-".join(rf"\x{{{x}}}" for x in r.split("-")) for r in _PICTOGRAPHIC.split()) + "]"
WORD = r"[\p{L}\p{N}][\p{L}\p{N}'+#.-]*"


def let(value: Column, f) -> Column:
    """f(value), with value worked out once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def trim(s: Column) -> Column:
    return F.regexp_replace(s, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def _ascii(s: Column) -> Column:
    return F.octet_length(s) == F.length(s)


def length(s: Column) -> Column:
    """Length in UTF-16 units. Where all characters are single bytes, none takes two units."""
    more = F.length(F.regexp_replace(s, r"[^\x{10000}-\x{10FFFF}]", ""))
    return F.length(s) + F.when(_ascii(s), F.lit(0)).otherwise(more)


def collapse(s: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(s, rf"[{SPACE}]+", " ")


def word_count(s: Column) -> Column:
    return F.size(F.regexp_extract_all(s, F.lit(WORD), 0))


def emoji_count(s: Column) -> Column:
    return F.when(_ascii(s), F.lit(0)).otherwise(F.size(F.regexp_extract_all(s, F.lit(EMOJI), 0)))


def alnum_length(s: Column) -> Column:
    return length(F.regexp_replace(s, r"[^\p{L}\p{N}]", ""))


def shorter(s: Column, n: int) -> Column:
    """Whether the length in UTF-16 units is less than n; a text of n characters and more isn't measured."""
    return F.when(F.length(s) >= n, False).otherwise(length(s) < n)


def at_least_words(s: Column, n: int) -> Column:
    """Whether word_count is n or more, without a look at later words."""
    return s.rlike(rf"\A[^\p{{L}}\p{{N}}]*+(?:{WORD}+[^\p{{L}}\p{{N}}]*+){{{n}}}")


def at_least_alnum(s: Column, n: int) -> Column:
    """Whether there are n letters and digits or more."""
    return s.rlike(rf"\A(?:[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}]){{{n}}}")


def query_terms(s: Column) -> Column:
    """Lower-cased letter and digit runs of more than one character, repeats included."""
    return F.filter(F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}]+"), 0), lambda t: length(t) > 1)


def entropy(s: Column) -> Column:
    """Shannon entropy, bits per character."""
    def bits(s: Column) -> Column:
        n = F.length(s)
        share = F.transform(F.array_distinct(F.split(s, "")), lambda c: (n - F.length(F.replace(s, c))) / n)
        return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(F.filter(share, lambda p: p > 0), F.lit(0.0), lambda h, p: h - p * F.log2(p)))

    return let(s, bits)


def estimated_tokens(s: Column) -> Column:
    return F.ceil(length(s) / 4).cast("int")
