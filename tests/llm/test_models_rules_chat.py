"""Classifiers by held-out accuracy, rules, HTML and chat formatting by brute force, and edge cases."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import html_text, language, quality_model, quality_rules, tool_calls, toxicity
from labelloom.llm.common import words_column
from tests.llm.test_near_mixing_sharding import EDGES, SCHEMA, vocabulary

DIR = "/root/testdata/sf0.01"


def auc(scores, labels):
    s, y = np.array(scores), np.array(labels)
    p, n = s[y == 1], s[y == 0]
    return ((p[:, None] > n[None]).sum() + 0.5 * (p[:, None] == n[None]).sum()) / (len(p) * len(n))


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels", "pages", "conversations")}


def held(rows, labels, column):
    known = {r.doc_id: r[column] for r in labels.collect()}
    return zip(*[(r.score, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known], strict=True)


def test_quality_classifier_ranks_held_out_rows(spark, tables):
    rows = quality_model.scored(spark, tables["documents"], tables["labels"]).collect()
    assert len(rows) == tables["documents"].count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert auc(*held(rows, tables["labels"], "quality")) > 0.95


def test_toxicity_ranks_held_out_rows(spark, tables):
    rows = toxicity.scored(spark, tables["documents"], tables["labels"]).collect()
    assert auc(*held(rows, tables["labels"], "toxic")) > 0.8


def test_models_handle_odd_rows(spark):
    docs = spark.createDataFrame(EDGES, SCHEMA).withColumn("score", F.lit(3)).withColumn("y", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (5, 0, 0), (None, 1, 1), (2, None, None)], none.schema)
    for labels in (none, some):
        for f in (quality_model.scored, toxicity.scored):
            got = f(spark, docs, labels).collect()
            assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert quality_model.scored(spark, docs.limit(0), some).count() == 0
    got = language.identified(spark, docs).collect()
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert language.identified(spark, docs.limit(0)).count() == 0


def test_folding_and_exceptions():
    assert toxicity.fold("1D10T ïdiоt id​iot $tup!d") == "idiot idiot idiot stupid"
    lex = toxicity.Lexicon({toxicity.fold("loser"): 2.0, "moron": 3.0}, {toxicity.fold("sore loser")})
    hits = [m[2] for m in lex.matches(toxicity.fold("A L0ser, a sore loser, MORON!! losers"))]
    assert hits == [toxicity.fold("loser"), "moron"]
    # many phrases in a long text, overlapping ones included
    phrases = toxicity.Lexicon({"bad": 1.0, "news": 1.0}, {"bad news", "news bad", "so bad news"})
    assert [m[:2] for m in phrases.matches("so bad news bad x bad news " * 20_000 + "x bad")] == [(540_002, 540_005)]
    assert lex.measure(None) == (0.0, 0.0)
    assert lex.measure("moron")[1] > lex.measure("moron and many more words here")[1]


def test_toxic_words_of_a_small_language_are_learned(spark):
    r = random.Random(5)
    common = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    # a tenth is toxic; the small language has five toxic training rows
    rows = [(" ".join([*r.sample(common, 20), *((["cabron"] if i < 50 else ["moron"]) if i % 10 == 0 else [])]), int(i % 10 == 0)) for i in range(1000)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "text string, y int"))
    assert set(lexicon.weights) == {toxicity.fold("moron"), toxicity.fold("cabron")}
    assert lexicon.measure("eres un cabrón")[0] > 0 and lexicon.measure(" ".join(common)) == (0.0, 0.0)
    # words by chance alone make no lexicon
    assert not toxicity.learn(spark.createDataFrame([(" ".join(r.sample(common, 20)), int(i % 10 == 0)) for i in range(1000)], "text string, y int")).weights


def test_phrases_reach_to_the_ends_of_words():
    long = "x" * 5000
    lexicon = toxicity.Lexicon({"bad": 1.0})
    assert toxicity._phrases(lexicon, f"{long} bad {long}y, bad") == {f"{long} bad", f"bad {long}y"}
    assert toxicity._phrases(lexicon, "one  bad\ttwo; not bad!") == {"not bad"}


def brute_lexicon(rows):
    """The entries by plain counting: every cut tried, every word that passes taken."""
    p, q = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    words = {}
    for t, y in rows:
        for w in set(re.findall(r"[^\W_]+", toxicity.fold(t))):
            if len(w) > 2:
                words.setdefault(w, [0, 0])[1 - y] += 1

    def ratio(a, b):
        r = (a + b) / (p + q)
        return 2 * sum((k * math.log(k / (n * r)) if k else 0) + ((n - k) * math.log((n - k) / (n * (1 - r))) if n - k else 0) for k, n in ((a, p), (b, q)))

    found = {w: (ratio(a, b), math.log((a + 0.5) / (p + 1)) - math.log((b + 0.5) / (q + 1)), ratio(min(a + b, p), a + b - min(a + b, p)), a) for w, (a, b) in words.items()}
    for cut in (c / 4 for c in range(1, 241)):
        tested = sum(top >= cut for _, _, top, _ in found.values())
        taken = {w for w, (r, weight, _, _) in found.items() if r >= cut and weight > 1.5}
        if taken and tested * math.erfc(math.sqrt(cut / 2)) <= 0.05 * len(taken):
            break
    else:
        return {}
    alone = dict.fromkeys(taken, 0)
    for t, y in rows:
        own = taken & set(re.findall(r"[^\W_]+", toxicity.fold(t)))
        top = max((found[w][0] for w in own), default=0)
        for w in own:
            alone[w] += y * (found[w][0] >= 0.5 * top)
    return {w: found[w][1] for w in taken if 2 * alone[w] >= found[w][3]}


def test_lexicon_equals_plain_counts(spark):
    r = random.Random(15)
    common = vocabulary(r, 60)
    bad = [f"bad{chr(97 + i)}" for i in range(12)]
    rows = []
    for i in range(600):
        t = [r.choice(common) for _ in range(r.randint(0, 25))]
        y = int(i % 6 == 0)
        if r.random() < (0.9 if y else 0.02):
            t.insert(r.randint(0, len(t)), r.choice(bad))
        rows.append((" ".join(t) if i % 50 else None, y))
    got, want = toxicity.learn(spark.createDataFrame(rows, "text string, y int")).weights, brute_lexicon([(t or "", y) for t, y in rows])
    assert set(got) == set(want) and len(want) > 5 and all(abs(got[w] - want[w]) < 1e-9 for w in want)


def test_toxicity_scores_equal_plain_ones(spark, tables):
    """Every row's score is the logistic function of what its own lexicon finds in its whole text."""
    labels = quality_model.labelled(tables["labels"], "toxic", rows=toxicity.TRAIN_ROWS).collect()
    texts = {x.doc_id: x.text for x in tables["documents"].select("doc_id", "text").collect()}
    sample = [(texts[x.doc_id], x.y) for x in labels if x.doc_id in texts]
    lexicon = toxicity.learn(spark.createDataFrame(sample, "text string, y int"))

    def find(t):  # word by word and phrase by phrase instead of by automaton
        folded = toxicity.fold(t or "")
        places = [m.span() for m in re.finditer(r"(?<![^\W_])[^\W_]+(?![^\W_])", folded)]
        covered = [(a, a + len(e)) for e in lexicon.exceptions for a in [m.start() for m in re.finditer(rf"(?<![^\W_])(?={re.escape(e)}(?![^\W_]))", folded)]]
        total = sum(lexicon.weights.get(folded[a:b], 0.0) for a, b in places if not any(x <= a and b <= z for x, z in covered))
        return (math.log1p(total), math.log1p(100 * total / max(1, len(folded.split())))) if total else (0.0, 0.0)

    x = np.array([[1.0, *find(t)] for t, _ in sample])
    w = toxicity._logistic(x, np.array([y for _, y in sample], float))
    got = {r.doc_id: r.score for r in toxicity.scored(spark, tables["documents"], tables["labels"]).collect()}
    want = {i: 1 / (1 + math.exp(-float(w @ np.array([1.0, *find(t)])))) for i, t in texts.items()}
    assert max(abs(got[i] - want[i]) for i in texts) < 1e-6


def test_ftrl_equals_a_plain_loop():
    r = random.Random(2)
    rows = [(np.array(sorted(r.sample(range(50), 6))), np.array([r.random() for _ in range(6)]), r.randint(0, 1)) for _ in range(40)]
    z, n = [0.0] * 50, [0.0] * 50

    def weight(i):
        if abs(z[i]) <= quality_model.L1:
            return 0.0
        return -(z[i] - math.copysign(quality_model.L1, z[i])) / ((quality_model.BETA + math.sqrt(n[i])) / quality_model.ALPHA + quality_model.L2)

    order = np.random.default_rng(7)
    for _ in range(quality_model.EPOCHS):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            w = [weight(i) for i in at]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
            for i, v, a in zip(at, x, w, strict=True):
                g = (p - y) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality_model.ALPHA
                z[i] += g - sigma * a
                n[i] += g * g
    got = quality_model.train(rows)
    assert np.allclose(got[:50], [weight(i) for i in range(50)], atol=1e-6) and not got[50:].any()


def test_quality_scores_equal_plain_ones(spark, tables):
    """Every row's score is the logistic function of its own text's vector and the weights of the sample."""
    texts = {x.doc_id: x.text for x in tables["documents"].select("doc_id", "text").collect()}
    sample = [(x.doc_id, *quality_model.features(texts[x.doc_id]), x.y) for x in quality_model.labelled(tables["labels"], "quality").collect() if x.doc_id in texts]
    sample.sort(key=lambda x: x[0])
    w = quality_model.train([(a.astype(np.int64), x.astype(np.float64), y) for _, a, x, y in sample])
    got = {r.doc_id: r.score for r in quality_model.scored(spark, tables["documents"], tables["labels"]).collect()}
    for i, t in texts.items():
        a, x = quality_model.features(t)
        assert abs(got[i] - 1 / (1 + math.exp(-float(w[a] @ x)))) < 1e-9


def test_models_with_repeated_and_long_rows(spark):
    docs = spark.createDataFrame([(1, "aa bb cc", "en", "a", 0)] * 4 + [(1, "other text here", "en", "a", 0), (2, "dd ee ff " * 40_000, "de", "a", 0), (None, "aa bb", "en", "a", 0)], SCHEMA).withColumn("y", F.lit(5)).withColumn("h", F.lit(5)).withColumn("r", F.lit("x"))
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for f in (quality_model.scored, toxicity.scored):
        got = f(spark, docs, labels).collect()
        assert len(got) == 7 and len({r.score for r in got if r.doc_id == 1}) <= 2
        assert f(spark, docs.limit(0), labels).count() == 0
    got = language.identified(spark, docs).collect()
    assert len(got) == 7 and {r.lang_pred for r in got if r.doc_id == 2} <= {"de", "en", "und"}


def test_ftrl_learns_and_stays_sparse():
    r = random.Random(1)
    words = vocabulary(r)
    rows = [(*quality_model.features(" ".join(r.choice(words) + ("!!" if y else "") for _ in range(40))), y) for y in [0, 1] * 60]
    w = quality_model.train([(a.astype(np.int64), x.astype(float), y) for a, x, y in rows])
    assert auc([float(w[a] @ x) for a, x, _ in rows], [y for *_, y in rows]) == 1.0
    assert (w != 0).mean() < 0.05


def test_language_model_follows_switches():
    r = random.Random(3)
    forms = {"aa": "abcde", "bb": "vwxyz"}
    texts = [(x, " ".join("".join(r.choice(forms[x]) for _ in range(5)) for _ in range(60))) for x in list(forms) * 30]
    model = language.train([t for _, t in texts], [x for x, _ in texts])
    assert language.predict(model, [texts[0][1], texts[1][1], None, "12 !?", ""])[0] == ["aa", "bb", "und", "und", "und"]
    mixed = "abcde bcdea cdeab vwxyz wxyzv xyzvw yzvwx zvwxy"
    words = language.Words([mixed])
    gamma = model.marginals(model.emissions(words), np.array([True] + [False] * 7))
    assert gamma.argmax(axis=1).tolist() == [0, 0, 0, 1, 1, 1, 1, 1]


def test_forward_backward_equals_plain_recursion():
    r = np.random.default_rng(5)
    model = language.Model(["a", "b", "c"])
    model.trans, model.first = r.normal(size=(3, 3)), r.normal(size=3)
    n = 700
    e = r.normal(size=(n, 3)) * 2
    breaks = r.random(n) < 0.01
    breaks[0] = True
    got, joint = model.marginals(e, breaks, pairs=True)
    t, f = np.exp(model.trans), np.exp(model.first)
    a, b = np.zeros((n, 3)), np.ones((n, 3))
    for i in range(n):
        a[i] = (f if breaks[i] else a[i - 1] @ t) * np.exp(e[i])
        a[i] /= a[i].sum()
    for i in range(n - 2, -1, -1):
        b[i] = np.ones(3) if breaks[i + 1] else t @ (np.exp(e[i + 1]) * b[i + 1])
        b[i] /= b[i].sum()
    want = a * b
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(got, want, atol=1e-8)
    pairs = sum((x := a[i - 1][:, None] * t * (np.exp(e[i]) * b[i])[None]) / x.sum() for i in range(1, n) if not breaks[i])
    assert np.allclose(joint, pairs, atol=1e-6)


def test_language_accuracy(spark, tables):
    rows = language.identified(spark, tables["documents"]).collect()
    known = {r.doc_id: r.lang for r in tables["documents"].select("doc_id", "lang").collect()}
    out = [r.lang_pred == known[r.doc_id] for r in rows if r.held_out]
    assert sum(out) / len(out) > 0.97


def brute_stats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice)


def test_statistics_equal_brute_force(spark):
    r = random.Random(6)
    texts = [None, "", "  ", "a", "\n\na\n\na\n b\n b", " ".join("ab" for _ in range(30)), "é😀 ñ\xa0x #|", "x\x0by\x0cz"]
    for _ in range(40):
        texts.append(" ".join(r.choice(["a", "b", "c#", "d\n", "e"]) for _ in range(r.randint(0, 90))))
    texts.append("1 2 3 4 5 6 7 8 9 10 1 2 3 4 5 6 7 8 9 10 z 2 3 4 5 6 7 8 9")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in quality_rules.statistics(df).collect():
        assert tuple(row[c] for c in quality_rules.STATISTICS) == brute_stats(texts[row.doc_id]), texts[row.doc_id]
    assert df.select(F.size(words_column(F.col("text")))).count() == len(texts)


def test_rules_reject_outliers_and_keep_clean(spark):
    r = random.Random(7)
    words = vocabulary(r)
    rows = []
    for i in range(400):
        t = " ".join(r.choice(words) for _ in range(r.randint(30, 300)))
        rows.append((i, t if i % 8 else re.sub(" ", "*** ", t), "en", "hot" if i % 3 else None, 0))
    got = {x.doc_id: x for x in quality_rules.judged(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].kept == bool(i % 8) for i in got)


def chi_cdf(x, dim):
    """Chi-square distribution for odd degrees of freedom, in closed form."""
    out, term = math.erf(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, dim - 1, 2):
        out -= term
        term *= x / (k + 2)
    return out


def chi_inverse(share, dim):
    low, high = 0.0, 100.0
    while high - low > 1e-12:
        mid = (low + high) / 2
        low, high = (mid, high) if chi_cdf(mid, dim) < share else (low, mid)
    return high


def brute_mcd(x, ridge, starts=150, seed=3):
    """Squared distances by random subsets and concentration steps, with constants of its own."""
    n, p = x.shape
    r = np.random.default_rng(seed)
    half = chi_inverse(0.5, p)
    scale = 0.5 / chi_cdf(half, p + 2)

    def d2(m, cov):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)

    best = None
    for _ in range(starts):
        part = x[r.choice(n, p + 1, replace=False)]
        last = math.inf
        while True:
            m, cov = part.mean(axis=0), scale * np.cov(part.T, bias=True) + ridge
            d = d2(m, cov)
            det = np.linalg.slogdet(cov)[1]
            if len(part) > p + 1 and last - det <= 1e-3:
                break
            last = det if len(part) > p + 1 else math.inf
            part = x[d <= np.sort(d)[(n + 1) // 2 - 1]]
        if best is None or det < best[0]:
            best = (det, d)
    det, d = best
    cut = chi_inverse(0.975, p)
    part = x[d * half / max(np.sort(d)[(n + 1) // 2 - 1], half) <= cut]
    return det, d2(part.mean(axis=0), 0.975 / chi_cdf(cut, p + 2) * np.cov(part.T, bias=True) + ridge)


def vectors(got, texts):
    n = np.array([g.n_words for g in got], float)
    chars, symbols, repeats, dup = (np.array([g[c] for g in got], float) for c in ("word_chars", "n_symbols", "n_repeat_words", "n_dup_lines"))
    lines = np.array([sum(bool(x.strip()) for x in texts[g.doc_id].split("\n")) for g in got], float)
    return np.stack([np.log1p(n), np.log(chars / n), np.log1p(100 * symbols / chars), np.log1p(100 * repeats / n), np.log1p(100 * dup / (lines + 6))], axis=1)


def test_chi_square_constants():
    assert abs(quality_rules.chi_quantile(0.5, 5) - chi_inverse(0.5, 5)) < 1e-8 and abs(quality_rules.chi_share(9.0, 7) - chi_cdf(9.0, 7)) < 1e-12
    z = np.random.default_rng(1).normal(size=(400_000, 5))
    d = (z**2).sum(axis=1)
    # the covariance of the central half, times the factor, is that of the whole
    assert abs(z[d <= np.median(d)].var() * quality_rules.FACTOR_HALF - 1) < 0.01
    assert abs(z[d <= np.quantile(d, 0.975)].var() * quality_rules.FACTOR_REWEIGHT - 1) < 0.01


def test_distances_equal_brute_force(spark):
    r = random.Random(12)
    words = vocabulary(r)
    texts = []
    for i in range(201):
        bad = i % 5 == 0  # a fifth is of another kind: the plain moments alone would follow it
        lines = [" ".join(r.choice(words) + (r.choice(["#", "*&", "%"]) if bad else r.choice(["", "", "", "#"])) for _ in range(r.randint(3, 12))) for _ in range(r.randint(5, 14))]
        texts.append("\n".join(lines + lines[:3] * bad))
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    got = sorted(quality_rules.judged(spark, spark.createDataFrame(rows, SCHEMA)).collect())
    good = [g for g in got if not g.base_failed]
    assert len(good) > 150 and all((g.d2 is None) == g.base_failed for g in got)
    _, want = brute_mcd(vectors(good, texts), np.diag(np.square([0.8, 0.15, 0.3, 1.0, 0.6])))
    found = np.array([g.d2 for g in good])
    assert np.corrcoef(found, want)[0, 1] > 0.99 and np.median(np.abs(found - want) / (want + 1)) < 0.1
    assert all(g.kept == (g.d2 <= chi_inverse(0.99999, 5)) for g in good)


def test_small_groups_are_held_against_larger_ones(spark):
    r = random.Random(13)
    words = vocabulary(r)

    def text(mark=""):
        return " ".join(r.choice(words) + mark for _ in range(r.randint(30, 120)))

    # one source of its own size, five rows a source in the same language, single rows of other languages
    rows = [(i, text(), "en", "big", 0) for i in range(60)] + [(100 + i, text("***" if i == 7 else ""), "en", f"s{i // 5}", 0) for i in range(20)] + [(200 + i, text("***" if i == 3 else ""), f"l{i}", None, 0) for i in range(6)]
    got = {x.doc_id: x for x in quality_rules.judged(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(x.d2 is not None for x in got.values())
    assert {i for i, x in got.items() if not x.kept} == {107, 203}
    # fewer rows than any group needs: the whole table's estimate
    few = quality_rules.judged(spark, spark.createDataFrame(rows[:3], SCHEMA)).collect()
    assert len(few) == 3 and all(x.d2 is not None and x.kept for x in few)


def test_rules_repeated_lines_and_long_texts(spark):
    r = random.Random(14)
    words = vocabulary(r)

    def lines(n, width):
        return [" ".join(r.choice(words) for _ in range(width)) for _ in range(n)]

    rows = [(i, "\n".join(lines(20, 10)), "en", "a", 0) for i in range(80)]
    page = [x for pair in zip(lines(40, 5), ["read more here"] * 40, strict=True) for x in pair]
    rows += [(100, "\n".join(page), "en", "a", 0), (101, "\n".join(lines(40_000, 5)), "en", "a", 0)]
    got = {x.doc_id: x for x in quality_rules.judged(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got[100].base_failed and not got[100].kept and got[100].n_dup_lines == 39
    assert got[101].n_words == 200_000 and all(got[i].kept for i in range(80))


def test_rules_edge_cases(spark):
    docs = spark.createDataFrame(EDGES, SCHEMA).withColumn("kept", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("_row", F.lit(1))
    got = quality_rules.judged(spark, docs).collect()
    assert len(got) == len(EDGES) and all(r.base_failed and not r.kept for r in got)
    assert quality_rules.kept_rows(spark, docs).columns == docs.columns
    assert quality_rules.judged(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_html_on_pages_and_layouts(spark, tables):
    rows = html_text.extracted(spark, tables["pages"]).collect()
    source = {r.page_id: r.html for r in tables["pages"].collect()}
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        want = " ".join(__import__("html").unescape(re.sub(r"<[^>]*>", "\n", re.sub(r"</?b>", "", body))).split())
        assert r.text == want and r.n_chars == len(want)
    model = html_text.default_model()
    wrong = total = 0
    for page in html_text.labelled_pages(60, seed=99):
        order = html_text.flatten(html_text._with_truth(page))
        for x in order:
            x.features = html_text.describe(x)
        for x, p in zip(order, model.marginals(order), strict=True):
            if x.tag == "#text" and x.text.strip():
                total += 1
                wrong += (p > 0.5) != x.truth
    assert wrong < 0.02 * total


def test_messages_equal_enumeration():
    model = html_text.Model()
    model.w = {"t:p": 0.7, "t:div": -0.4, "t:#text": 0.2, "bias": 0.1}
    model.pair = {"text": [[0.3, -0.2], [0.1, 0.9]], "block": [[0.0, 0.4], [-0.3, 0.2]], "section": [[0.5, 0.1], [0.2, 0.6]], "inline": [[0, 0], [0, 0]]}
    order = html_text.flatten(html_text.parse("<div>a<p>b</p></div>c"))
    for x in order:
        x.features = html_text.describe(x)
    total, mass = 0.0, np.zeros(len(order))
    for bits in range(1 << len(order)):
        y = [bits >> i & 1 for i in range(len(order))]
        e = sum(model.own(x) * y[x.index] for x in order) + sum(model.pair[html_text.kind(x)][y[x.parent.index]][y[x.index]] for x in order if x.parent is not None)
        total += np.exp(e)
        mass += np.exp(e) * np.array(y)
    assert np.allclose(model.marginals(order), mass / total)


def test_html_edge_cases(spark):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "plain"), (4, "u", "<p>open <b>bold <p>next &amp; last"), (5, "u", "<a href=\"x>y\">" + "<div>" * 3000), (6, "u", "</p></div><!-- x"), (6, "u", "<article><p>one&nbsp;\n two</p><script>var x='</p>';</script><p>three</p></article>")]
    got = {}
    for r in html_text.extracted(spark, spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[1] == [""] and got[2] == [""] and got[5] == [""]
    assert "one two three" in got[6]


def test_html_keeps_text_around_odd_tags():
    model = html_text.default_model()

    def text(inside):
        return html_text.main_text(model, f"<article><p>One two three four five.</p>{inside}<p>Four five six seven.</p></article>")

    assert text("<svg/>") == text("<iframe/>") == text("<title>") == text("<textarea class=x>") == "One two three four five. Four five six seven."
    assert text("<p title=it's>it is one more of these</p>").endswith("it is one more of these Four five six seven.")
    assert "Four" in text("<p title=it's>it</p><p>it's three and more words</p>") and "it's three" in text("<p title=it's>it</p><p>it's three and more words</p>")
    for tag in ("svg", "math", "object", "xmp"):
        assert "some words of the text inside" in text(f"<p>before it <{tag}>some words of the text inside</{tag}> and after it.</p>")
    assert text("<script>var x = '<p>no</p>';</script ><style>p{}</style>") == text("")
    assert text("<a href=/>") == text("")
    assert html_text.main_text(model, "<article><p>One two three four.</p><p>five <script>var x = 1") == "One two three four. five"
    assert html_text.main_text(model, "<article><p>One two three four.</p><p class=") == "One two three four."
    # a row or cell ends the open one, inside its own table only
    root = html_text.parse("<table><tr><td>a<table><tr><td>b</table><td>c<tr><td>d</table>")
    rows = [x for x in html_text.flatten(root) if x.tag == "tr"]
    assert [x.parent.tag for x in rows] == ["table"] * 3 and [len([c for c in x.children if c.tag == "td"]) for x in rows] == [2, 1, 1]


def test_html_reads_broken_pages_in_linear_time():
    import time

    def took(page):
        began = time.process_time()
        html_text.parse(page)
        return time.process_time() - began

    for piece in ("<div>", "<div></p>", "<p><b>", "<title>", "<li>", "<a t=\">\"", "<a x=\"", "<!", "<b>x", "<svg>", "</x>", "<tr><td>"):
        small, large = (min(took(piece * n) for _ in range(2)) for n in (5_000, 50_000))
        assert large < 30 * small + 0.3, (piece, small, large)
    deep = "<article><p>one two three</p>" + "<div>" * 50_000 + "<p>four five six"
    assert [x.text for x in html_text.flatten(html_text.parse(deep)) if x.tag == "#text"] == ["one two three", "four five six"]
    assert isinstance(html_text.main_text(html_text.default_model(), deep), str)


def test_html_empty_table(spark):
    got = html_text.extracted(spark, spark.createDataFrame([], "page_id long, url string, html string"))
    assert got.count() == 0 and got.columns == ["page_id", "url", "text", "n_chars"]


def test_tool_calls(spark):
    tools = {"add": {"required": {"a": "integer", "b": "integer"}, "optional": {"note": "string"}}}
    calls = [("c1", 1, "add", '{"b": 2, "a": 1}', []), ("c2", 2, "add", '{"a": 1}', ["c1"]), ("c3", 3, "add", '{"a": "x", "b": 1, "z": 0}', ["c2", "c1", "none"]), ("c4", 4, "other", "{}", ["c5"]), ("c5", 5, "add", "broken", ["c4"]), ("c1", 9, "add", "{}", []), (None, 1, "add", "{}", [])]
    results = [("c1", 2, "3"), ("c3", 4, 'say "é"\n'), ("zz", 7, None)]
    got = {r.id: r for r in tool_calls.linked(spark, spark.createDataFrame(calls, "id string, place long, name string, arguments string, needs array<string>"), spark.createDataFrame(results, "id string, place long, content string"), tools).collect()}
    assert {k: r.level for k, r in got.items()} == {"c1": 0, "c2": 1, "c3": 2, "c4": None, "c5": None, "zz": None}
    assert {k: r.linked for k, r in got.items()} == {"c1": True, "c2": False, "c3": True, "c4": False, "c5": False, "zz": False}
    assert got["c1"].valid and got["c1"].json == '{"arguments":{"a":1,"b":2},"id":"c1","name":"add","result":"3"}'
    assert got["c2"].problems == "missing b" and got["c3"].problems == "unknown z,type of a" and got["c4"].problems == "unknown tool" and got["c5"].problems == "no object"
    assert json.loads(got["c3"].json)["result"] == 'say "é"\n' and got["zz"].name is None


def plain_levels(needs):
    """Longest path to a call without needs; calls in or behind a cycle have none."""
    out = {}
    while True:
        ready = {i: 1 + max((out[x] for x in n if x in needs), default=-1) for i, n in needs.items() if i not in out and all(x in out for x in n if x in needs)}
        if not ready:
            return {i: out.get(i) for i in needs}
        out |= ready


def test_levels_equal_longest_paths(spark):
    from labelloom.llm.common import Space

    r = random.Random(17)
    needs = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(300)}  # one long chain
    needs |= {f"d{i}": sorted({f"d{r.randrange(i)}" for _ in range(r.choice([1, 1, 1, 2, 3]))} if i else set()) for i in range(60)}
    needs |= {"r0": ["r2"], "r1": ["r0"], "r2": ["r1"], "s": ["r1"], "t": ["s", "c5"], "u": ["u"], "v": ["gone", "c299"]}
    calls = spark.createDataFrame([(i,) for i in needs], "id string")
    edges = spark.createDataFrame([(i, x) for i, n in needs.items() for x in n if x in needs], "id string, needs string")
    got = {x.id: x.level for x in tool_calls.levels(calls, edges, Space(spark, "levels")).collect()}
    assert got == {i: v for i, v in plain_levels(needs).items() if v is not None}


def test_chat_equals_its_sql(spark, tmp_path):
    import duckdb

    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, 2, "assistant", "x"), (1, 2, "assistant", "y"), (1, 3, "user", 'q"\\'), (1, 5, "user", None), (1, 9, "user", "far"), (1, 4, "tool", "{}"), (1, 3, None, None), (None, 1, "user", "lost"), (2, None, "system", ""), (2, 1, "assistant", "é"), (2, 8, "assistant", None), (2, 8, "assistant", "z"), (3, 0, "user", "long " * 50_000)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit(1)).withColumn("kind", F.lit("x"))
    talk.write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    found = con.execute(tool_calls.ORACLE_SQL)
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=str)
    got = tool_calls.every_turn(spark, talk)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == want


def test_conversations_edge_cases(spark):
    talk = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, "assistant", "lone"), (None, 0, "user", "x"), (3, 2, "user", 'q"\\'), (3, 2, "user", 'q"\\'), (3, 4, "user", "later")], "conv_id long, turn long, role string, text string").withColumn("id", F.lit(1))
    got = {r.id: r for r in tool_calls.formatted(spark, talk).collect()}
    assert set(got) == {"1-0", "2--1", "3-2", "3-4"}
    assert not got["1-0"].valid and got["1-0"].linked and got["3-4"].level == 1
    assert json.loads(got["3-2"].json)["arguments"]["prompt"] == 'q"\\'
    assert tool_calls.formatted(spark, talk.limit(0)).count() == 0


def test_every_turn_carries_every_row(spark, tables):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, 1, "user", None), (1, 2, "assistant", "x"), (1, 2, "assistant", "y"), (1, 3, "tool", "{}"), (1, 3, None, None), (None, 1, "user", "lost"), (2, None, "system", ""), (2, None, "system", "")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = tool_calls.every_turn(spark, talk).collect()
    assert len({r.id for r in got}) == len(got)
    texts = [(r.kind, json.loads(r.json)) for r in got]
    assert sorted((k, str(x["content"])) for k, x in texts if k not in ("call", "result")) == sorted([("system", "be kind"), ("user", "b"), ("user", "a"), ("user", "None"), ("assistant", "y"), ("tool", "{}"), ("none", "None"), ("user", "lost"), ("system", ""), ("system", "")])
    assert [(x["arguments"], x["result"]) for k, x in texts if k == "call"] == [({"prompt": "a"}, "x")]
    # a linked row stands for two rows of the table, all others for one
    whole = tool_calls.every_turn(spark, tables["conversations"]).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("linked").cast("int")).alias("m")).collect()
    assert sum(r.n + r.m for r in whole) == tables["conversations"].count()
    assert {r.kind: r.n for r in whole}["system"] == tables["conversations"].filter("role = 'system'").count()
