"""Column builders for keyed, two-language text. All are built-in expressions; none runs Python on rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, DEFAULTS, GUIDE_PREFIX, OTHER_LABEL, Settings

# The patterns of placeholders, tags and units.
PRINTF = r"%[+\-]?\d*\.?\d*[dsf]"
POSITIONAL = r"%\d+\$[dsf]"
PERCENT_NAME = r"%[A-Za-z_][A-Za-z0-9_]*%"
BRACE_NAME = r"\{(\d+|[a-zA-Z_](?U:\w)*)\}"
COLOR = "§[0-9a-fA-Fk-oK-OrR]"
ALT_COLOR = "&[0-9a-fA-F]"
ACTION = r"\$\((?:l:[^)]*|[a-zA-Z_](?U:\w)*)\)"
TAG = r"</?[a-zA-Z_](?U:\w)*(?:(?U:\s)[^>]*)?/?>"
BREAK = r"(?i)<br(?U:\s)*/?>"
NEWLINE = r"\\n|\n"
UNIT = r"(?<![A-Za-z0-9_])(FE|RF|MB|EU|AE|kJ|kW|kRF)(?![A-Za-z0-9_])"
HAN = "[\u4e00-\u9fff\u3400-\u4dbf]"
TELLRAW = r'^(?U:\s)*\{[^}]*"text"(?U:\s)*:'
# Seven forms of codes, numbers and lone placeholders in one pattern, which is one pass over a text.
CODE_LIKE = r"(?U)^\s*(?:§[0-9a-fA-F]|(?:[A-Z_]+|[0-9]+|[A-Za-z0-9_.-]+|%[a-zA-Z0-9_.$]*|\{[^{}]*\}|%[A-Za-z_]\w*%)\s*$)"
KEYBOARD = r"(?iU)\b(Shift|Ctrl|Alt|Tab)\b"
MOUSE = (
    r"(?iU)\b(?:left\s*click|right\s*click|left[- ]?mouse|right[- ]?mouse|mouse\s*button|scroll\s*wheel|drag|double[-\s]?click|"
    r"middle\s*click|mouse\s*over|hover)\b|(?:左键|右键|鼠标|单击|双击|点击|拖拽|滚轮)"
)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def strip(text: Column) -> Column:
    """Without white space of any script at both ends. A run inside the text is entered once, not at each of its places."""
    return F.regexp_replace(text, r"(?U)^\s+|(?<!\s)\s++$", "")


def right_strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(?<!\s)\s++$", "")


def has_han(text: Column) -> Column:
    return text.rlike(HAN)


def code_like(text: Column) -> Column:
    """Whether a text is code, a number, a lone placeholder or one ASCII word, and so needs no translation."""
    return text.rlike(CODE_LIKE)


def music_disc(key: Column) -> Column:
    return key.contains("music_disc") & key.endswith(".desc")


def printf_items(text: Column) -> Column:
    """printf placeholders, then positional ones, which count as their plain form."""
    plain = all_matches(text, PRINTF)
    return F.concat(plain, F.transform(all_matches(text, POSITIONAL), lambda p: F.concat(F.lit("%"), F.right(p, F.lit(1)))))


def more_often(a: Column, b: Column) -> Column:
    """The distinct items, in order of first occurrence, that are more often in a than in b."""
    # most pairs are equal, and then nothing is counted
    found = F.filter(F.array_distinct(a), lambda x: F.size(F.filter(a, lambda y: y == x)) > F.size(F.filter(b, lambda y: y == x)))
    return F.when(same_items(a, b), F.array().cast("array<string>")).otherwise(found)


def same_items(a: Column, b: Column) -> Column:
    """Whether both hold the same items equally often."""
    return F.sort_array(a) == F.sort_array(b)


def tokens(text: Column) -> Column:
    """Lower-case words of two characters or more, without tags, colour codes and placeholders."""
    t = F.regexp_replace(text, "<[^>]*>", " ")
    t = F.regexp_replace(t, COLOR, " ")
    t = F.regexp_replace(t, r"%[+-]?\d*\.?\d*[dsf]", " ")
    return all_matches(F.lower(t), "[a-zA-Z][a-zA-Z0-9_]+")


def ngrams(words: Column, n: int) -> Column:
    """The word n-grams as texts; an empty array for fewer words."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))


def valid_term(term: Column, settings: Settings = DEFAULTS) -> Column:
    t = F.lower(strip(term))
    stop = F.array(*[F.lit(w) for w in settings.stop_words])
    return (F.length(t) > 2) & ~t.rlike(r"(?U)\d") & ~t.rlike("^[0-9._-]+$") & ~F.arrays_overlap(F.split(t, r"(?U)\s+"), stop)


def similarity(a: Column, b: Column) -> Column:
    """100 * (1 - edit distance / longer length), to two places (ties to even); 0 if either is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(F.bround(100.0 * (1.0 - F.levenshtein(a, b) / longer), 2))


def key_prefix(key: Column, settings: Settings = DEFAULTS) -> Column:
    """The longest configured prefix of a key, or the default."""
    out = F.lit(DEFAULT)
    for p in sorted(settings.key_prefixes, key=len):
        out = F.when(key.startswith(p), p).otherwise(out)
    return out


def prefix_label(prefix: Column, settings: Settings = DEFAULTS) -> Column:
    out = F.lit(OTHER_LABEL)
    for p, (label, _) in settings.key_prefixes.items():
        out = F.when(prefix == p, label).otherwise(out)
    return out


def has_any(text: Column, parts: tuple[str, ...]) -> Column:
    return any_of([text.contains(p) for p in parts])


def needs_review(key: Column, en: Column, settings: Settings = DEFAULTS) -> Column:
    required = [p for p, (_, need) in settings.key_prefixes.items() if need]
    return key_prefix(key, settings).isin(required) | has_any(key, (*settings.description_parts, ".title")) | (F.length(en) > settings.long_text)


def is_guide(key: Column) -> Column:
    return key.startswith(GUIDE_PREFIX)


def fuzzy_trigger(key: Column, settings: Settings = DEFAULTS) -> Column:
    return has_any(key, settings.fuzzy_triggers)


def word_pattern(variants: Column) -> Column:
    """A pattern that finds any of the variants as whole words, in any case."""
    quoted = F.transform(variants, lambda v: F.concat(F.lit(r"\Q"), F.replace(F.lower(v), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.concat(F.lit(r"(?iU)\b(?:"), F.array_join(quoted, "|"), F.lit(r")\b"))


def proper_subset(a: Column, b: Column) -> Column:
    """Whether the words of one text are a proper subset of the other's."""
    x, y = F.array_distinct(F.split(a, r"\s+")), F.array_distinct(F.split(b, r"\s+"))
    return ((F.size(F.array_except(x, y)) == 0) & (F.size(x) < F.size(y))) | ((F.size(F.array_except(y, x)) == 0) & (F.size(y) < F.size(x)))


def version_parts(version: Column) -> Column:
    """A dotted version as an array of numbers, which orders as versions do."""
    return F.transform(F.split(version, r"\."), lambda x: x.cast("int"))


def cache_key(key: Column, verdict: Column, zh: Column, reason: Column) -> Column:
    """The identity of a verdict for the filter cache."""
    return F.md5(F.concat_ws(":", F.coalesce(key, F.lit("")), F.coalesce(verdict, F.lit("")), F.substring(F.coalesce(zh, F.lit("")), 1, 150), F.substring(F.coalesce(reason, F.lit("")), 1, 200)))


def truncated_json(text: Column) -> Column:
    """Whether brackets or braces of a response don't balance."""
    t = strip(text)
    return (F.length(t) > 0) & ((F.regexp_count(t, F.lit(r"\{")) != F.regexp_count(t, F.lit(r"\}"))) | (F.regexp_count(t, F.lit(r"\[")) != F.regexp_count(t, F.lit(r"\]"))))


def multipart_base(key: Column) -> Column:
    """What precedes the part number of keys such as base.3 and base[3]; empty for others."""
    return F.regexp_extract(key, r"(?s)^(.*?)(?:\.|\[)(\d+)\]?$", 1)


def multipart_number(key: Column) -> Column:
    return F.regexp_extract(key, r"(?s)^(.*?)(?:\.|\[)(\d+)\]?$", 2)


def quoted(text: str) -> str:
    """A pattern that is just this text."""
    return re.escape(text)
