"""Names of persons and other collectors in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions import text as T

from .search import token_pairs


def variants(collectors: DataFrame, simplified: bool = True) -> DataFrame:
    """ID, format, variant: a name alone, or with initials, dotted initials or first name before and after it."""
    def form(c: str) -> Column:
        return T.simplify(F.col(c)) if simplified else T.smoothen_spaces(F.col(c))

    df = collectors.select("ID", form("name").alias("N"), F.coalesce(form("firstname"), F.lit("")).alias("F"))
    f, q = T.abbreviate_name(F.col("F")), T.abbreviate_name(F.col("F"), dots=True)
    pairs = [("{N}", F.col("N"))]
    for key, first in (("f", f), ("q", q), ("F", F.col("F"))):
        pairs += [(f"{{{key}}} {{N}}", F.concat_ws(" ", first, F.col("N"))), (f"{{N}} {{{key}}}", F.concat_ws(" ", F.col("N"), first))]
    options = F.array(*[F.struct(F.lit(k).alias("format"), v.alias("variant")) for k, v in pairs])
    rows = df.select("ID", F.explode(F.when(F.col("F") == "", F.slice(options, F.lit(1), F.lit(1))).otherwise(options)).alias("v"))
    return rows.select("ID", "v.format", "v.variant")


def _quoted(s: Column) -> Column:
    return F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), F.regexp_replace(s, r"([\\.^$|?*+()\[\]{}])", r"\\$1"), F.lit(r"(?![\p{L}\p{N}_])"))


def find_names(texts: DataFrame, collectors: DataFrame, mode: str = "reference", fuzzy: bool = False) -> DataFrame:
    """ID, collector_id, start, end, score of all name hits in ``texts`` (ID, text).

    A hit is a whole word match without accents and case; of a collector's variants
    the longest counts, the score is its length.  In ``reference`` mode initials
    match nothing, as existing results have it; ``intended`` matches them too.
    ``fuzzy`` allows errors by the length of the variant, over a run of as many words; the score is the
    length less the errors.

    Texts and names meet on the rarest word of a variant in the texts, not on one that
    all names share; candidates are gathered by text, so each text moves once.
    """
    v = variants(collectors).withColumn("variant", F.lower("variant")).filter("variant <> ''")
    if mode == "reference":
        v = v.filter(F.col("format").isin("{N}", "{F} {N}", "{N} {F}"))
    v = v.select(F.col("ID").alias("collector_id"), "variant").distinct()
    flat = texts.select("ID", T.strip_accents(F.lower(F.coalesce(F.col("text"), F.lit("")))).alias("flat"))
    near = _fuzzy_runs(flat, v) if fuzzy else _with_rarest_word(flat, v)
    found = near.groupBy("ID").agg(F.collect_list(F.struct("collector_id", "variant", "run", "errors")).alias("n")).join(flat, "ID")
    hits = found.select("ID", "flat", F.explode("n").alias("n")).select("ID", "n.*", (F.regexp_instr("flat", _quoted(F.col("n.run"))) - 1).alias("start")).filter("start >= 0")
    best = hits.groupBy("ID", "collector_id").agg(F.max(F.struct((F.length("variant") - F.col("errors")).alias("score"), (-F.col("start")).alias("s"), F.length("run").alias("n"), "variant")).alias("b"))
    return best.select("ID", "collector_id", (-F.col("b.s")).alias("start"), (-F.col("b.s") + F.col("b.n")).alias("end"), F.col("b.score").alias("score"))


def _words(s: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(s, F.lit(f"({T.WORD_CLASS}+)"), 1))


def _with_rarest_word(flat: DataFrame, v: DataFrame) -> DataFrame:
    """ID, collector_id, variant, run, errors: variants of which a text has the word that fewest texts have."""
    words = flat.select("ID", F.explode(_words(F.col("flat"))).alias("word"))
    parts = v.select("collector_id", "variant", F.explode(_words(F.col("variant"))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("df"))
    keyed = parts.join(counts, "word", "left").groupBy("collector_id", "variant").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("k"))
    keyed = keyed.filter("k.df > 0").select("collector_id", "variant", F.col("k.word").alias("word"))
    return words.join(keyed, "word").select("ID", "collector_id", "variant", F.col("variant").alias("run"), F.lit(0).alias("errors"))


def _fuzzy_runs(flat: DataFrame, v: DataFrame) -> DataFrame:
    """The same for runs of words of a text that are within the allowance of a variant of as many words."""
    count = F.size(F.regexp_extract_all("variant", F.lit(f"({T.WORD_CLASS}+)"), 1))
    sizes = sorted(r["n"] for r in v.select(count.alias("n")).distinct().collect() if r["n"])  # words of a name
    pieces = F.regexp_extract_all("flat", F.lit(f"({T.WORD_CLASS}+|(?:(?!{T.WORD_CLASS}).)+)"), 1)

    def of(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size("p")), lambda i: (i + (2 * n - 2) <= F.size("p")) & F.get(F.col("p"), i - 1).rlike(f"^{T.WORD_CLASS}"))
        return F.when(F.size("p") > 0, F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("p", i, 2 * n - 1), "").alias("run"))))

    runs = flat.select("ID", F.regexp_replace("flat", r"[\r\n]", " ").alias("flat")).select("ID", pieces.alias("p"))
    empty = F.array().cast("array<struct<n:int,run:string>>")
    runs = runs.select("ID", F.explode(F.array_distinct(F.flatten(F.array(*[F.coalesce(of(n), empty) for n in sizes] or [empty])))).alias("r")).select("ID", "r.*")
    pairs = token_pairs(v.select(F.col("variant").alias("q")).distinct(), runs.select(F.col("run").alias("token")).distinct(), "blocked")
    errors = F.round((1 - F.col("identity")) * F.greatest(F.length("q"), F.length("token"))).cast("int")
    found = pairs.select(F.col("q").alias("variant"), F.col("token").alias("run"), errors.alias("errors")).join(v, "variant")
    return runs.select("ID", "run").distinct().join(found, "run").select("ID", "collector_id", "variant", "run", "errors")


def merged(hits: DataFrame, mode: str = "reference") -> DataFrame:
    """ID, names: hits of a text in order; one that overlaps the last kept one and scores higher replaces it.

    Overlapping hits of lower score stay in ``reference`` mode and go in
    ``intended`` mode.
    """
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", "collector_id", "score")))
    rows = hits.groupBy("ID").agg(ordered.alias("h"))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        touches = F.least(last["end"], x["end"]) >= F.greatest(last["start"], x["start"])
        lower = F.concat(acc, F.array(x)) if mode == "reference" else acc
        return F.when(F.size(acc) == 0, F.array(x)).when(touches & (x["score"] > last["score"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(x))).when(touches, lower).otherwise(F.concat(acc, F.array(x)))

    empty = F.slice(F.col("h"), F.lit(1), F.lit(0))
    return rows.select("ID", F.aggregate("h", empty, step).alias("names"))


def find_collectors(texts: DataFrame, collectors: DataFrame, mode: str = "reference", fuzzy: bool = False, search_rule=None) -> DataFrame:
    """Names found in each text.  ``search_rule`` (collectors -> Column) says who is searched for by name; all, if it is not given."""
    persons = collectors if search_rule is None else collectors.filter(search_rule(collectors))
    return merged(find_names(texts, persons, mode, fuzzy), mode)


def find_entities(texts: DataFrame, collectors: DataFrame) -> DataFrame:
    """ID, collector_id, place: names whose words stand abbreviated in a row in the text (for institutions)."""
    words = T.tokenize(T.simplify(F.col("text")), 1, "all")
    t = texts.select("ID", words.alias("t"))
    c = collectors.select(F.col("ID").alias("collector_id"), T.tokenize(T.simplify(F.col("name")), 1, "all").alias("c"))
    # both meet on a word, without its dots, that starts the name's first word
    left = t.select("ID", "t", F.explode(F.array_distinct(F.transform("t", lambda w: F.regexp_replace(w, r"\.+$", "")))).alias("l")).filter("l <> ''")
    first = F.get("c", F.lit(0))
    right = c.filter("size(c) > 0").withColumn("l", F.explode(F.transform(F.sequence(F.lit(1), F.length(first)), lambda i: F.left(first, i))))
    place = F.filter(F.sequence(F.lit(0), F.greatest(F.size("t") - F.size("c"), F.lit(0))), lambda i: F.forall(F.transform("c", lambda w, j: T.fullname_match(F.coalesce(F.get("t", i + j), F.lit("")), w)), lambda ok: ok))
    return left.join(right, "l").withColumn("place", F.get(place, F.lit(0))).filter("place is not null").select("ID", "collector_id", "place").distinct()
