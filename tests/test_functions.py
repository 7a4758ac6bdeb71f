"""Expressions against golden values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelloom.functions import dates as D
from labelloom.functions import geo as G
from labelloom.functions import text as T
from labelloom.operators import cluster as C


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first().v


def test_mismatch_allowance(spark):
    rows = spark.createDataFrame([("a" * n,) for n in (1, 3, 4, 7, 8, 15, 16, 31, 32, 63)], "t string").select(T.mismatch_allowance(F.col("t")).alias("k")).collect()
    assert [r.k for r in rows] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


@pytest.mark.parametrize(("text", "plain"), [("Ärger Œuvre", "Arger Œuvre"), ("ﬁn ½ x²", "fin 1⁄2 x2"), ("été", "ete"), ("", "")])
def test_strip_accents(spark, text, plain):
    got = one(spark, F.struct(T.strip_accents(F.col("t")).alias("a"), T.strip_accents_exact(F.col("t")).alias("b")), t=text)
    assert got.b == plain
    if "½" not in text:
        assert got.a == plain


def test_text_functions(spark):
    assert one(spark, T.smoothen_spaces(F.col("t")), t=" a \n\t b c ") == "a b c"
    assert one(spark, T.tokenize(F.col("t"), 3), t="The cat, x2_b 12 Äöü") == ["the", "cat", "x2_b", "äöü"]
    assert one(spark, T.tokenize(F.col("t"), 1, "standard"), t="I don't.") == ["i", "do", "n't", "."]
    assert one(spark, T.ngrams(F.col("t"), 2), t=["c", "b", "a"]) == [["c", "b"], ["b", "a"]]
    assert one(spark, T.ngrams(F.col("t"), 2, False), t=["c", "b", "a"]) == [["b", "c"]]
    assert one(spark, T.ngrams(F.col("t"), 2, False, "intended"), t=["c", "b", "a"]) == [["a", "b"], ["b", "c"]]
    assert one(spark, T.ngrams(F.col("t"), 5), t=["a"]) == []
    assert one(spark, T.norm_levenshtein(F.col("a"), F.col("b")), a="", b="") == 0.0
    assert one(spark, T.clear_ranges(F.col("t"), [(1, 2)]), t="abcdef") == "a  def"
    assert one(spark, T.clear_ranges(F.col("t"), [(4, 9)]), t="abcdef") == "abcd  "
    assert one(spark, T.id_formatter("label:5", F.lit(7))) == "label00007"
    assert one(spark, T.id_formatter("l:2", F.lit(12345))) == "l12345"
    assert one(spark, T.clean_str(F.col("t")), t='"a\\nb"') == "a\nb"
    assert one(spark, T.clean_str(F.col("t")), t="") == ""
    assert one(spark, T.abbreviate_name(F.col("t")), t="anna Maria-luise") == "A M-L"
    assert one(spark, T.abbreviate_name(F.col("t"), True), t="A J") == "A. J."
    assert one(spark, T.roman_to_int(F.col("t")), t="XIV") == 14
    assert one(spark, T.roman_to_int(F.col("t")), t="IIX") == 10
    assert one(spark, T.find_pattern(F.col("t"), "b+"), t="abbc").asDict() == {"match": "bb", "start": 1, "end": 3}
    assert one(spark, T.text_segments(F.col("t"), F.array(F.lit(1), F.lit(3))), t="abcde") == ["a", "bc", "de"]
    assert one(spark, T.fullname_match(F.col("a"), F.col("b")), a="Mus.", b="Museum") is True
    assert one(spark, T.abbreviation_search(F.col("a"), F.col("b")), a=["m.", "b"], b=["x", "museum", "berlin"]) == 1
    assert one(spark, T.is_float(F.col("t")), t="1e3") is True
    assert one(spark, T.rotation_distance(F.col("a"), F.col("b")), a=["b", "a"], b="a b") == 0.0
    assert T.range_reader("1,3-5") == [0, 2, 3, 4] and T.range_reader("5-3") == [5, 4, 3]
    with pytest.raises(ValueError):
        T.tokenize(F.col("t"), 1, "none")


FOUND = [
    ("Argentina Buen. Aires 15. 12. 05 Frank", (5, 12, 15, 2, False), None, (22, 32)),
    ("15.XII.1905", (1905, 12, 15, 2, True), None, None),
    ("15. Dez. 1905", (1905, 12, 15, 2, True), None, None),
    ("Dec. 15, 1905", (1905, 12, 15, 2, True), None, None),
    ("5/13/1936", (1936, 5, 13, 2, True), None, None),
    ("12.-15.6.1936", (1936, 6, 12, 2, True), (1936, 6, 15, 2, True), None),
    ("28.5.-3.6.1936", (1936, 5, 28, 2, True), (1936, 6, 3, 2, True), None),
    ("28.5.1936-3.6.1937", (1936, 5, 28, 2, True), (1937, 6, 3, 2, True), None),
    ("XII.1905", (1905, 12, None, 1, True), None, None),
    ("1905-1907", (1905, None, None, 0, True), (1907, None, None, 0, True), None),
    ("1905-12-15", (1905, None, None, 0, True), None, None),
    ("Abessinien Dire Daoua 3.-6.1936 Uhlenhuth", (1936, 3, None, 1, True), (1936, 6, None, 1, True), None),
    ("Dire Daoua 1936", (1936, None, None, 0, True), None, None),
    ("alt. 1250 m 1936", (1250, None, None, 0, True), None, None),
]


@pytest.mark.parametrize(("text", "start", "end", "span"), FOUND)
def test_find_date(text, start, end, span):
    got = D.find(text)
    assert got[0] == start and got[1] == (end or start)
    assert span is None or got[2:4] == span


def test_dates_in_columns(spark):
    assert len(D.catalogue()) == 66
    assert D.find("no date here") is None and D.find(None) is None
    for text, whole in (("15 .12.1905", True), ("15  12 1905", True), ("15,12:1905", True), ("15.  12.1905", False), ("15..12.1905", False)):
        assert (D.find(text)[0][:3] == (1905, 12, 15)) == whole
    rows = spark.createDataFrame([("5.3.1936",), ("15. 12. 05",), ("3.-6.1936",), (None,)], "t string").select(D.find_date(F.col("t")).alias("f")).select(D.iso_range(F.col("f")).alias("iso"), "f").collect()
    assert [r.iso for r in rows] == ["1936-3-5", "-5-12-15", "1936-3/1936-6", None]


def _range(a, b=None):
    def lit(d):
        return D.date(*[F.lit(x).cast("int") for x in d[:3]], F.lit(d[3]))

    return F.struct(lit(a).alias("start"), lit(b or a).alias("end"))


def test_overlap(spark):
    a, b = _range((1936, 1, 3, True)), _range((1936, 12, 20, True))
    old, short = _range((1935, 12, 31, True)), _range((36, None, None, False))
    get = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert get(D.overlaps(a, b)) and not get(D.overlaps(a, b, mode="calendar"))
    assert not get(D.overlaps(old, a))
    year = _range((1936, None, None, True))
    assert not get(D.overlaps(short, year)) and get(D.overlaps(short, year, True))
    assert not get(D.overlaps(short, short)) and not get(D.overlaps(short, short, True))
    assert get(D.is_in(a["start"], _range((1935, None, None, True), (1936, None, None, True))))
    assert not get(D.is_in(year["start"], a))
    assert get(D.before(old["start"], a["start"]))
    assert get(D.set_century(short["start"], F.lit(19))["year"]) == 1936 and get(D.century(a["start"])) == 19


def test_geo(spark):
    assert one(spark, G.distance_metres(F.col("t")), t="at 12 km") == 12000.0
    assert abs(one(spark, G.distance_metres(F.col("t")), t="300FT") - 91.44) < 1e-9
    assert one(spark, G.distance_metres(F.col("t")), t="none") is None
    got = one(spark, G.latlng(F.col("t")), t="Berg, 10°30'30\" S, 20°15' W")
    assert abs(got.lat + 10.508333) < 1e-5 and abs(got.lng + 20.25) < 1e-9
    assert one(spark, G.latlng(F.col("t")), t="no place") is None
    assert one(spark, G.dms(F.lit(10.9999999999))).asDict() == {"deg": 11, "min": 0, "sec": 0.0}
    assert one(spark, G.feature_rank(F.lit("P"))) == 1 and one(spark, G.cardinal(F.lit("Ю"))) == "S"


@settings(max_examples=60, deadline=None)
@given(st.text("abé", max_size=9), st.text("abé", max_size=9))
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    assert C.edit_distance(a, b) == row[-1]


def test_knee_and_split():
    assert C.knee([10, 4, 1, 0.9, 0.8, 0.7]) in (1, 2) and C.knee([1, 1, 1]) is None
    lines = ["alpha one", "alpha onE", "alpha on", "alpha ones", "zzzz qqqq 1", "zzzz qqqq 2", "zzzz qqqq 3", "zzzz qqqq 4"]
    parts = C.split(lines)
    assert len({tuple(parts[:4]), tuple(parts[4:])}) <= 2 and C.split(lines[:5]) == [0] * 5
    assert C.aligned_consensus(["abcd", "abxd", "abcd", "bcd"]) == "abcd"


def test_ranges_and_predicates_of_dates(spark):
    lit = lambda y, m=None, d=None, known=True: D.date(F.lit(y), F.lit(m), F.lit(d), F.lit(known))
    a, b = lit(1936, 3, 5), lit(1935, 12, 1)
    row = spark.range(1).select(D.date_range(a, b).alias("r"), D.same(a, a).alias("same"), D.same(a, b).alias("other"), D.is_empty(lit(None)).alias("empty"), D.is_one_date(F.struct(a.alias("start"), a.alias("end"))).alias("one"), D.date_json(a).alias("j")).first()
    assert (row.r.start.year, row.r.end.year) == (1935, 1936) and row.same and not row.other and row.empty and row.one
    assert row.j == '{"year":1936,"month":3,"day":5,"century_unknown":false}'
    for bad in (lit(1936), lit(36, 1, 1, False), lit(None)):
        with pytest.raises(Exception, match="range"):
            spark.range(1).select(D.date_range(a, bad).alias("r")).collect()


def test_ngram_search_and_masks(spark):
    df = spark.createDataFrame([(["dire", "daoua"], [["daoua", "dire"], ["dira", "daoua"], ["other", "place"]], "a<b -c~")], "t array<string>, g array<array<string>>, s string")
    m = T.mask_special_chars(F.col("s"))
    row = df.select(T.ngram_search(F.col("t"), F.col("g")).alias("n"), m["masked"].alias("m"), T.unmask_special_chars(m["masked"], m["originals"]).alias("s"), T.is_range(F.lit(1), F.lit(2)).alias("r")).first()
    assert [x.ngram for x in row.n] == [["daoua", "dire"], ["dira", "daoua"]] and row.n[0].distance == 0.0
    assert row.m == "a~b~~c~" and row.s == "a<b -c~" and row.r
    assert df.select(T.id_formatter(lambda n: F.concat(F.lit("x"), n), F.lit(3)).alias("v")).first().v == "x3"


def test_equal_texts_are_searched_for_dates_once(spark, monkeypatch):
    calls = []
    real = D.find
    monkeypatch.setattr(D, "find", lambda *a: calls.append(a[0]) or real(*a))
    known = D._Known(None, 2)
    texts = ["leg. 3.4.1998", "none 9", "leg. 3.4.1998", "none 9", "x" * 300 + " 1998"]
    assert [known(t) for t in texts] == [real(t) for t in texts] and len(calls) == 3
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").repartition(1).select("i", D.find_date(F.col("t")).alias("f")).collect()
    assert {r.i: r.f and (r.f.start.year, r.f.start.precision, r.f.verbatim) for r in rows} == {0: (1998, 2, "3.4.1998"), 1: None, 2: (1998, 2, "3.4.1998"), 3: None, 4: (1998, 0, "1998"), 5: None}
