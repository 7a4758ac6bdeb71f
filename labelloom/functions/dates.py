"""Partial dates and date ranges: finding them in texts, and expressions on them.

A date is a struct ``(year, month, day, precision, century_known)``: precision 0 is
a year, 1 a month, 2 a day.  A two-digit year has an unknown century and stores
``year % 100``.  A range is a struct ``(start, end)``; a single date is a range with
equal ends.
"""

from __future__ import annotations

import calendar
import functools
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom.storage import ready

DATE_TYPE = "struct<year:int,month:int,day:int,precision:int,century_known:boolean>"
FOUND_TYPE = f"struct<start:{DATE_TYPE},end:{DATE_TYPE},span_start:int,span_end:int,verbatim:string>"

# The layouts of dates, in order of the catalogue.  D, M, Y: fields;
# ".": separator; "?": optional separator; "-": dash of a range.
LAYOUTS = "Y M.Y D.M.Y M.D.Y Y-Y M?-M.Y D?-D.M.Y M.D?-D.Y D.M?-D.M.Y M.D?-M.D.Y D.M.Y-D.M.Y".split()
MONTH_FORMS = {"digit": r"1[0-2]|0?[0-9]", "roman": r"[iIvVxX]{1,2}[iI]*", "literal": r"[^\W\d_]+"}
YEAR_FORMS = {"two-digit": r"[0-9]{2}", "four-digit": r"[12][0-9]{3}"}
DAY_FORM = r"[0-3]?[0-9]"
#: A mark with at most one space beside it, or one or two spaces; spaces are its cost.
SEPARATOR = r"(?:[:|/.,]\s?|\s[:|/.,]|\s\s?)"

# Month names by language (English, German, French, Spanish, Italian,
# Portuguese, Latin), January to December; four letters or more may stand for a name.
MONTH_NAMES = """
january february march april may june july august september october november december
januar februar märz april mai juni juli august september oktober november dezember
janvier février mars avril mai juin juillet août septembre octobre novembre décembre
enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre
gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre
janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro
ianuarius februarius martius aprilis maius iunius iulius augustus september october november december
"""
# Three-letter short forms, January to December.
SHORT_NAMES = "jan feb mar apr may jun jul aug sep oct nov dec / jan feb mär apr mai jun jul aug sep okt nov dez / ene feb mar abr may jun jul ago sep oct nov dic"


@functools.cache
def months() -> dict[str, int]:
    """Number of each month name and unambiguous short form, lower case, with and without accents."""
    from unicodedata import normalize

    out: dict[str, int] = {}
    names = [line.split() for line in MONTH_NAMES.strip().splitlines()] + [p.split() for p in SHORT_NAMES.split("/")]
    for line in names:
        for i, name in enumerate(line, 1):
            for n in range(min(4, len(name)), len(name) + 1):
                for form in (name[:n], normalize("NFKD", name[:n]).encode("ascii", "ignore").decode()):
                    out.setdefault(form, i)
    out["sept"] = 9
    return out


class Pattern(NamedTuple):
    regex: re.Pattern
    fields: tuple[str, ...]
    precision: int
    month_form: str
    year_form: str
    is_range: bool
    is_us: bool


@functools.cache
def catalogue() -> tuple[Pattern, ...]:
    out = []
    for layout in LAYOUTS:
        for month_form, month in MONTH_FORMS.items():
            for year_form, year in YEAR_FORMS.items():
                seen: dict[str, int] = {}
                parts, fields = [], []
                for c in layout:
                    if c in "DMY":
                        seen[c] = seen.get(c, 0) + 1
                        fields.append(f"{c}{seen[c]}")
                        parts.append(f"(?P<{fields[-1]}>{ {'D': DAY_FORM, 'M': month, 'Y': year}[c]})")
                    else:
                        parts.append({".": SEPARATOR, "?": f"(?:{SEPARATOR})?", "-": "-"}[c])
                precision = 2 if "D" in layout else 1 if "M" in layout else 0
                out.append(Pattern(re.compile(rf"(?=(?P<all>\b{''.join(parts)}\b))"), tuple(fields), precision, month_form, year_form, len(fields) > len(set(layout) & set("DMY")), "M1" in fields and "D1" in fields and fields.index("M1") < fields.index("D1")))
    return tuple(out)


def patterns(fields: set[str] | None = None, min_precision: int = 0, **tags) -> list[Pattern]:
    """Patterns with all the fields, at least the precision, and equal other tags."""
    return [p for p in catalogue() if (not fields or fields <= set(p.fields)) and p.precision >= min_precision and all(getattr(p, k) == v for k, v in tags.items())]


def _date(year: str, month: str | None, day: str | None, form: str) -> tuple | None:
    """A checked date, or None."""
    known = len(year) == 4
    y = int(year)
    m = d = None
    if month is not None:
        m = _roman(month) if form == "roman" else int(month) if form == "digit" else months().get(month.lower())
        if m is None or not 1 <= m <= 12:
            return None
    if day is not None:
        d = int(day)
        if not 1 <= d <= calendar.monthrange(y if known else 1900 + y, m)[1]:
            return None
    return (y, m, d, 2 if d is not None else 1 if m is not None else 0, known)


def _roman(s: str) -> int:
    values, total = {"i": 1, "v": 5, "x": 10}, 0
    s = s.lower()
    i = 0
    while i < len(s):
        pair = {"iv": 4, "ix": 9}.get(s[i : i + 2])
        total += pair or values[s[i]]
        i += 2 if pair else 1
    return total


def _ranks(chosen: tuple[Pattern, ...]) -> list[list[Pattern]]:
    """Patterns by precision and kind of month, highest rank first; each group in order of the catalogue."""
    groups: dict[tuple[int, int], list[Pattern]] = {}
    for p in chosen:
        groups.setdefault((p.precision, int(p.month_form != "literal" or p.precision < 1)), []).append(p)
    return [groups[k] for k in sorted(groups, reverse=True)]


def hits(text: str, chosen: list[Pattern]) -> list[tuple[int, Pattern, re.Match]]:
    """Best match of each pattern of one rank (least white space in separators, then leftmost), most characters in the fields first."""
    out = []
    for p in chosen:
        if p.is_range and "-" not in text:
            continue
        best = None
        for m in p.regex.finditer(text):
            spaces = sum(c.isspace() for c in m["all"])
            if best is None or spaces < best[0]:
                best = (spaces, m)
                if not spaces:
                    break
        if best:
            out.append((sum(len(best[1][f]) for f in p.fields), p, best[1]))
    out.sort(key=lambda h: h[0], reverse=True)
    return out


_ALL_RANKS = _ranks(catalogue())


def find(text: str | None, ranks: list[list[Pattern]] | None = None) -> tuple | None:
    """(start, end, span start, span end, verbatim) of the first valid hit."""
    if not text or not re.search(r"[0-9]{2}", text):
        return None
    for group in _ALL_RANKS if ranks is None else ranks:
        for _, p, m in hits(text, group):
            g = m.groupdict()
            y1, m1, d1 = g["Y1"], g.get("M1"), g.get("D1")
            first = _date(y1, m1, d1, p.month_form)
            last = _date(g.get("Y2") or y1, g.get("M2") or m1, g.get("D2") or d1, p.month_form)
            if first and last:
                # a range runs forward
                swap = first[4] == last[4] and tuple(-1 if v is None else v for v in first[:3]) > tuple(-1 if v is None else v for v in last[:3])
                a, b = (last, first) if swap else (first, last)
                return (a, b, m.start(), m.start() + len(m["all"]), m["all"])
    return None


class _Known:
    """``find`` with its last answers, so many as fit in a few megabytes."""

    def __init__(self, ranks: list[list[Pattern]] | None, limit: int = 20_000):
        self.ranks, self.limit, self.found = ranks, limit, {}

    def __call__(self, text: str) -> tuple | None:
        if text in self.found:
            return self.found[text]
        got = find(text, self.ranks)
        if len(text) <= 200:
            if len(self.found) >= self.limit:
                self.found.clear()
            self.found[text] = got
        return got


def find_date(text: Column, **tags) -> Column:
    """The best date of a text as ``FOUND_TYPE`` (null if none), in Arrow batches."""
    ready()
    ranks = _ranks(tuple(patterns(**tags))) if tags else None
    names = ["year", "month", "day", "precision", "century_known"]
    known = _Known(ranks)

    @F.pandas_udf(FOUND_TYPE)
    def found(texts: pd.Series) -> pd.DataFrame:
        places, distinct = pd.factorize(texts)  # equal texts are read once a batch, and once a task while they are remembered
        rows = [None if f is None else (dict(zip(names, f[0], strict=True)), dict(zip(names, f[1], strict=True)), *f[2:]) for f in (known(t) for t in distinct)]
        rows.append(None)  # place -1: no text
        columns = zip(*[(None,) * 5 if r is None else r for r in rows], strict=True)
        out = pd.DataFrame(dict(zip(["start", "end", "span_start", "span_end", "verbatim"], map(list, columns), strict=True)), dtype=object)
        return out.iloc[places].reset_index(drop=True).astype({"span_start": "Int32", "span_end": "Int32"})

    out = found(F.when(text.rlike("[0-9]{2}"), text))  # only texts that can hold a year leave the JVM
    return F.when(out["start"].isNotNull(), out)


def date(year: Column, month: Column, day: Column, century_known: Column) -> Column:
    precision = F.when(day.isNotNull(), 2).when(month.isNotNull(), 1).otherwise(0)
    return F.struct(year.cast("int").alias("year"), month.cast("int").alias("month"), day.cast("int").alias("day"), precision.alias("precision"), century_known.alias("century_known"))


def iso(d: Column) -> Column:
    """Year-month-day without padding; an unknown century gives -yy."""
    year = F.when(d["century_known"], d["year"].cast("string")).otherwise(F.concat(F.lit("-"), d["year"].cast("string")))
    return F.when(d["year"].isNotNull(), F.concat_ws("-", year, d["month"].cast("string"), d["day"].cast("string")))


def iso_range(r: Column) -> Column:
    a, b = iso(r["start"]), iso(r["end"])
    return F.when(a == b, a).when(a.isNotNull(), F.concat_ws("/", a, b))


def century(d: Column) -> Column:
    return F.when(d["century_known"], F.floor(d["year"] / 100).cast("int"))


def set_century(d: Column, value: Column) -> Column:
    return date((value * 100 + d["year"] % 100), d["month"], d["day"], F.lit(True))


def overlaps(a: Column, b: Column, assume_same_century: bool = False, mode: str = "reference") -> Column:
    """Whether two ranges overlap.

    ``reference``: by years alone, as existing results have it; two unknown
    centuries never overlap.  ``calendar``: by days, partial dates spanning their
    whole month or year.
    """
    ka, kb = a["start"]["century_known"], b["start"]["century_known"]

    def years(r: Column, known: Column, other: Column) -> tuple[Column, Column]:
        shift = F.floor(other["start"]["year"] / 100) * 100
        return tuple(F.when(known, r[e]["year"]).otherwise(shift + r[e]["year"] % 100) for e in ("start", "end"))

    (a0, a1), (b0, b1) = years(a, ka, b), years(b, kb, a)
    if mode == "reference":
        out = F.least(a1, b1) >= F.greatest(a0, b0)
    else:
        def low(y, d):
            return y * 10000 + F.coalesce(d["month"], F.lit(0)) * 100 + F.coalesce(d["day"], F.lit(0))

        def high(y, d):
            return y * 10000 + F.coalesce(d["month"], F.lit(99)) * 100 + F.coalesce(d["day"], F.lit(99))

        out = F.least(high(a1, a["end"]), high(b1, b["end"])) >= F.greatest(low(a0, a["start"]), low(b0, b["start"]))
    comparable = (ka & kb) | ((ka | kb) if assume_same_century else F.lit(False))
    if assume_same_century and mode != "reference":
        comparable = F.lit(True)
    return F.coalesce(comparable & out, F.lit(False))


def is_in(d: Column, r: Column, assume_same_century: bool = False) -> Column:
    """Whether a date lies in a range, field by field; never if it is less precise than the range."""
    known = d["century_known"] & r["start"]["century_known"]
    century_of = F.floor(r["start"]["year"] / 100) * 100
    year = F.when(d["century_known"] | ~r["start"]["century_known"], d["year"]).otherwise(century_of + d["year"] % 100) if assume_same_century else d["year"]
    out = year.between(r["start"]["year"], r["end"]["year"])
    for f in ("month", "day"):
        out = out & (r["start"][f].isNull() | d[f].between(r["start"][f], r["end"][f]))
    return F.coalesce((d["precision"] >= r["start"]["precision"]) & out & (F.lit(True) if assume_same_century else known), F.lit(False))


def before(a: Column, b: Column) -> Column:
    """Calendar order of dates of one precision."""
    key = [F.struct(x["year"], F.coalesce(x["month"], F.lit(0)), F.coalesce(x["day"], F.lit(0))) for x in (a, b)]
    return key[0] < key[1]


def same(a: Column, b: Column) -> Column:
    """Whether two dates agree in all fields, absent ones included."""
    return F.forall(F.array(*[a[f].eqNullSafe(b[f]) for f in ("year", "month", "day", "precision", "century_known")]), lambda x: x)


def date_range(a: Column, b: Column) -> Column:
    """The range from the earlier to the later of two dates; an error if one is empty, or precision or century differ in kind."""
    bad = F.when(is_empty(a) | is_empty(b), "empty date in a range").when(a["precision"] != b["precision"], "dates of different precision in a range").when(a["century_known"] != b["century_known"], "known and unknown century in a range")
    out = F.struct(F.when(before(b, a), b).otherwise(a).alias("start"), F.when(before(b, a), a).otherwise(b).alias("end"))
    return F.when(bad.isNotNull(), F.raise_error(bad).cast(f"struct<start:{DATE_TYPE},end:{DATE_TYPE}>")).otherwise(out)


def is_empty(d: Column) -> Column:
    return d.isNull() | d["year"].isNull()


def is_one_date(r: Column) -> Column:
    """Whether a range is a single date."""
    return same(r["start"], r["end"])


def date_json(d: Column) -> Column:
    """A date as JSON; absent fields are left out."""
    return F.to_json(F.struct(*[d[f].alias(f) for f in ("year", "month", "day")], (~d["century_known"]).alias("century_unknown")))
