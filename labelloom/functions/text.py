"""Text expressions: all on the JVM side unless said otherwise."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_CLASS = r"[\p{L}\p{N}_]"


def mismatch_allowance(token: Column) -> Column:
    """Edit errors allowed for a token: floor(log2(length)) - 1, at least 0."""
    return F.greatest(F.floor(F.log2(F.length(token))).cast("int") - 1, F.lit(0))


@functools.cache
def accent_map(limit: int = 0x2500) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """From, to: characters with one-to-one decompositions; then those that become several.

    Made from the Unicode tables: compatibility decomposition without nonspacing marks.
    """
    source, target, longer = [], [], []
    for i in range(0x80, limit):
        c = chr(i)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) != "Mn")
        if plain != c and len(plain) == 1:
            source.append(c)
            target.append(plain)
        elif plain and plain != c:
            longer.append((c, plain))
    return "".join(source), "".join(target), tuple(longer)


def strip_accents(s: Column) -> Column:
    """Compatibility forms without nonspacing marks (one-to-one forms below U+2500 and the common ligatures).

    ASCII stays as it is, so only runs of other characters are looked up.
    """
    source, target, _ = accent_map()

    def plain(run: Column) -> Column:
        out = F.regexp_replace(F.translate(run, source, target), r"\p{Mn}+", "")
        for ligature in "ﬀﬁﬂﬃﬄﬅﬆ":
            out = F.replace(out, F.lit(ligature), F.lit(unicodedata.normalize("NFKD", ligature)))
        return out

    def ascii_only(c: Column) -> Column:
        return F.length(c) == F.octet_length(c)

    runs = F.split(s, r"(?<=[\x00-\x7F])(?=[^\x00-\x7F])|(?<=[^\x00-\x7F])(?=[\x00-\x7F])")
    return F.when(ascii_only(s), s).otherwise(F.array_join(F.transform(runs, lambda r: F.when(ascii_only(r), r).otherwise(plain(r))), ""))


def strip_accents_exact(s: Column) -> Column:
    """The same for every character, in Arrow batches of Python."""
    @F.pandas_udf("string")
    def exact(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFKD", v) if unicodedata.category(c) != "Mn"))

    return exact(s)


def smoothen_spaces(s: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def simplify(s: Column) -> Column:
    return F.lower(strip_accents(smoothen_spaces(s)))


def tokenize(s: Column, min_len: int = 1, method: str = "words") -> Column:
    """Lower-cased tokens: ``words`` (runs of letters, digits, underscore), ``all`` (by white space) or ``standard`` (words and punctuation marks apart)."""
    if method == "words":
        out = F.regexp_extract_all(s, F.lit(f"({WORD_CLASS}{{{min_len},}})"), 1)
    elif method == "all":
        out = F.filter(F.split(s, r"(?U)\s+"), lambda t: F.length(t) >= max(1, min_len))
    elif method == "standard":
        out = F.filter(F.regexp_extract_all(s, F.lit(r"((?:[\p{L}\p{N}_]+(?=n't)|n't|'[\p{L}]+|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]))"), 1), lambda t: F.length(t) >= min_len)
    else:
        raise ValueError(f"unknown method: {method}")
    return F.transform(out, F.lower)


def index_tokens(s: Column, min_len: int = 1) -> Column:
    """Tokens of the index and of queries: lower case, no accents, words; duplicates kept."""
    return F.regexp_extract_all(strip_accents(F.lower(s)), F.lit(f"({WORD_CLASS}{{{min_len},}})"), 1)


def ngrams(tokens: Column, n: int, ordered: bool = True, mode: str = "reference") -> Column:
    """N-grams of a token array.

    Unordered ones are sorted and distinct; in ``reference`` mode the last n-gram
    is left out of them, as existing results have it.
    """
    count = F.size(tokens) - n + 1
    if not ordered and mode == "reference":
        count = count - 1
    grams = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.slice(tokens, i, n))).otherwise(F.array().cast("array<array<string>>"))
    return grams if ordered else F.array_sort(F.array_distinct(F.transform(grams, lambda g: F.array_sort(g))))


def norm_levenshtein(a: Column, b: Column, simplified: bool = True) -> Column:
    """Edit distance over the longer length; 0 for two empty texts."""
    if simplified:
        a, b = simplify(a), simplify(b)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longer)


def clear_ranges(s: Column, ranges: list[tuple[int, int]] | Column, inclusive: bool = True, blank: str = " ") -> Column:
    """Blank character ranges (from 0).  ``inclusive``: the end is blanked too."""
    extra = 1 if inclusive else 0
    if isinstance(ranges, Column):
        return F.aggregate(ranges, s, lambda acc, r: _blank(acc, r["start"], r["end"] + extra, blank))
    for a, b in ranges:
        s = _blank(s, F.lit(a), F.lit(b + extra), blank)
    return s


def _blank(s: Column, a: Column, b: Column, blank: str) -> Column:
    n = F.greatest(F.least(b, F.length(s)) - a, F.lit(0))
    return F.concat(F.substring(s, F.lit(1), a), F.repeat(F.lit(blank), n), F.substring(s, a + n + 1, F.length(s)))


def write_ranges(ranges: Column) -> Column:
    """``array<struct<start,end>>`` as "a-b, c"."""
    return F.array_join(F.transform(ranges, lambda r: F.when(r["start"] == r["end"], r["start"].cast("string")).otherwise(F.concat_ws("-", r["start"], r["end"]))), ", ")


def find_pattern(s: Column, pattern: str) -> Column:
    """First match and its [start, end) span; null without one."""
    at = F.regexp_instr(s, F.lit(f"({pattern})"))
    found = F.regexp_substr(s, F.lit(pattern))
    return F.when(at > 0, F.struct(found.alias("match"), (at - 1).alias("start"), (at - 1 + F.length(found)).alias("end")))


def text_segments(s: Column, cuts: Column) -> Column:
    """Pieces of a text between cut offsets."""
    edges = F.concat(F.array(F.lit(0)), cuts, F.array(F.length(s)))
    return F.transform(F.sequence(F.lit(0), F.size(edges) - 2), lambda i: F.substring(s, F.get(edges, i) + 1, F.get(edges, i + 1) - F.get(edges, i)))


def clean_str(s: Column) -> Column:
    """Without matching outer quotes; ``\\n`` and ``\\t`` escapes decoded."""
    t = F.trim(s)
    bare = F.when((F.length(t) >= 2) & (F.left(t, F.lit(1)) == F.right(t, F.lit(1))) & F.left(t, F.lit(1)).isin('"', "'"), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    return F.replace(F.replace(bare, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))


def id_formatter(spec, number: Column) -> Column:
    """``prefix:width`` and a number: the prefix and the zero-padded number.  A function of the number may stand for the spec."""
    if callable(spec):
        return spec(number)
    prefix, _, width = spec.rpartition(":")
    return F.concat(F.lit(prefix), F.format_string(f"%0{int(width)}d", number.cast("long")))


def abbreviate_name(s: Column, dots: bool = False) -> Column:
    """Initials in capitals; a space or a dash between parts stays."""
    mark = "." if dots else ""
    parts = F.regexp_extract_all(F.trim(s), F.lit(r"([^\s-]|^)[^\s-]*(\s+|-|$)"), 1)
    ends = F.regexp_extract_all(F.trim(s), F.lit(r"([^\s-]|^)[^\s-]*(\s+|-|$)"), 2)
    return F.array_join(F.transform(F.arrays_zip(parts.alias("a"), ends.alias("b")), lambda p: F.when(p["a"] == "", "").otherwise(F.concat(F.upper(p["a"]), F.lit(mark), F.when(p["b"] == "-", "-").when(p["b"] == "", "").otherwise(" ")))), "")


def roman_to_int(s: Column) -> Column:
    """Greedy sum of Roman pairs and digits, without a check of validity."""
    pairs = {"IV": 4, "IX": 9, "XL": 40, "XC": 90, "CD": 400, "CM": 900}
    digits = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
    units = F.regexp_extract_all(F.upper(s), F.lit("(I[VX]|X[LC]|C[DM]|[IVXLCDM])"), 1)
    value = F.create_map(*[F.lit(x) for kv in {**pairs, **digits}.items() for x in kv])
    return F.aggregate(units, F.lit(0), lambda a, u: a + F.element_at(value, u))


def is_float(s: Column) -> Column:
    return s.try_cast("double").isNotNull()


def is_range(start: Column, end: Column) -> Column:
    """Whether two places differ, so that they span more than one."""
    return start != end


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether two closed intervals share a point."""
    return F.least(a1, b1) >= F.greatest(a0, b0)


def fullname_match(abbreviation: Column, target: Column) -> Column:
    """Whether the abbreviation, without its dots, starts the target."""
    bare = F.regexp_replace(abbreviation, r"\.+$", "")
    return (bare != "") & target.startswith(bare)


def abbreviation_search(abbreviations: Column, tokens: Column) -> Column:
    """First place (from 0) at which every abbreviation in turn starts the token there; -1 if none."""
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens) - F.size(abbreviations), F.lit(0))), lambda i: F.forall(F.transform(abbreviations, lambda a, j: fullname_match(a, F.coalesce(F.get(tokens, i + j), F.lit("")))), lambda ok: ok))
    return F.when(F.size(abbreviations) == 0, F.lit(-1)).otherwise(F.coalesce(F.get(places, F.lit(0)), F.lit(-1)))


def mask(s: Column, pattern: str | None) -> Column:
    """Without the matches of a pattern."""
    return s if not pattern else F.regexp_replace(s, pattern, "")


def clean_text(s: Column, expressions: list[str]) -> Column:
    """All patterns deleted, one after the other."""
    for e in expressions:
        s = F.regexp_replace(s, e, "")
    return s


def corpus(df, keys: list[str], masks: dict[str, str] | None = None, join: str = "\n") -> Column:
    """Selected fields after masks, joined."""
    return F.concat_ws(join, *[mask(F.coalesce(F.col(k), F.lit("")), (masks or {}).get(k)) for k in keys])


def rotation_distance(a: Column, b: Column) -> Column:
    """Smallest normalised distance between a token list (array) in any rotation and a text."""
    turns = F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0))), lambda i: norm_levenshtein(F.array_join(F.concat(F.slice(a, i + 1, F.size(a)), F.slice(a, F.lit(1), i)), " "), b, False))
    return F.array_min(turns)


def range_reader(spec: str) -> list[int]:
    """ "1,3-5" as places from 0: [0, 2, 3, 4]; a falling range gives its ends as existing results have it (5-3: 5, 4, 3)."""
    out: list[int] = []
    for part in spec.split(","):
        ends = [int(x) for x in re.findall(r"\d+", part)]
        if len(ends) == 1:
            out.append(ends[0] - 1)
        elif ends[0] <= ends[1]:
            out.extend(range(ends[0] - 1, ends[1]))
        else:
            out.extend(range(ends[0], ends[1] - 1, -1))
    return out


def ngram_search(tokens: Column, ngrams_: Column, allowance=mismatch_allowance) -> Column:
    """The n-grams (arrays of tokens) in which every token has a near one, with their distance in the best rotation, nearest first."""

    def near(t: Column, g: Column) -> Column:
        return F.exists(g, lambda x: F.levenshtein(t, x) <= allowance(t))

    fits = F.filter(ngrams_, lambda g: F.forall(tokens, lambda t: near(t, g)))
    return F.array_sort(F.transform(fits, lambda g: F.struct(rotation_distance(tokens, F.array_join(g, " ")).alias("distance"), g.alias("ngram"))))


SPECIAL = "<>=\\-\\s~"


def mask_special_chars(s: Column) -> Column:
    """``struct<masked, originals>``: characters that mean something to aligners become ~ and are remembered."""
    return F.struct(F.regexp_replace(s, f"[{SPECIAL}]", "~").alias("masked"), F.regexp_extract_all(s, F.lit(f"([{SPECIAL}])"), 1).alias("originals"))


def unmask_special_chars(masked: Column, originals: Column) -> Column:
    """The text before ``mask_special_chars``."""
    return F.array_join(F.zip_with(F.split(masked, "~", -1), originals, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
