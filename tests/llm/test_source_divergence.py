"""The audit against a plain version in Python integers."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import source_divergence as sd

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least=30, top=50):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = TERM.findall((text or "").translate(LOWER))
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = sorted(s for x, s in groups if x == lang)
        share = lambda n, total: 1 + 1_000_000_000 * (n + 5) // (total + 5 * len(kept))  # noqa: B023, E731
        total = {s: sum(count[lang, s][t] for t in kept) for s in mine}
        p = {s: {t: share(count[lang, s][t], total[s]) for t in kept} for s in mine}
        q = {t: share(sum(count[lang, s][t] for s in mine), sum(total.values())) for t in kept}
        for s in mine:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in mine if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def texts(n=900):
    r = random.Random(13)
    words = ["".join(r.choice("abcXYZéß日") for _ in range(r.randint(1, 4))) for _ in range(300)]
    rows = []
    for i in range(n):
        lang = r.choice(["en", "en", "en", "de", None, ""])
        source = r.choice(["hot", "hot", None, "", *[f"s{k}" for k in range(12)]])
        k = 1 + len(f"{source}{lang}") % 3
        text = " ".join(words[int(r.random() ** k * 300)] + r.choice(["", ".", "-", "'", "\x00", "1"]) for _ in range(r.randint(0, 40)))
        rows.append((r.choice([text] * 9 + [None]), lang, source))
    rows += [("", "en", "bare"), (None, "xx", "a"), ("rare words", "xx", "b"), ("", "yy", "only"), ("Ab " * 50_000, "en", "hot")]
    return rows + rows[:20]


def rows_of(df):
    return sorted(tuple(x) for x in df.collect())


@pytest.mark.parametrize(("groups", "terms"), [(64, 4096), (3, 20), (1, 7), (5, 1000)])
def test_equals_a_plain_version(spark, groups, terms):
    rows = texts()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit("clash") for c in ("g", "h", "term", "count", "V", "block", "rank")})
    got = sd.audit(docs, groups=groups, terms=terms)
    assert rows_of(got) == by_hand(rows)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_other_bounds_and_ties(spark):
    rows = texts(300)
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert rows_of(sd.audit(docs, least=1, top=3, groups=2, terms=50)) == by_hand(rows, 1, 3)
    same = [(f"{c} common", "en", c) for c in "abcd"] * 40  # all sources alike but for a term of their own
    assert rows_of(sd.audit(spark.createDataFrame(same, docs.schema))) == by_hand(same)
    assert sd.audit(docs.limit(0)).count() == 0


def test_a_language_without_kept_terms_has_pairs_of_nothing(spark):
    docs = spark.createDataFrame([("a b", "en", "x"), (None, "en", "y"), ("c", "en", None), ("d", "de", "x")], "text string, lang string, source string")
    assert {(x["source"], x["item"], x["value"], x["part"]) for x in sd.audit(docs).collect()} == {(a, b, 0, "pair") for a in ("x", "y", "") for b in ("x", "y", "") if a != b}


def test_counts_are_handed_on_in_bounded_tables(spark):
    rows = texts(200)
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert rows_of(sd.term_counts(docs, held=5).fillna("", "term")) == rows_of(sd.term_counts(docs).fillna("", "term"))


def test_shares_of_counts_beyond_a_long_times_a_billion(spark):
    n, total, v = 3_000_000_000_000, 7_000_000_000_001, 5_000_000
    got = spark.range(1).select(sd.share(F.lit(n), F.lit(total), F.lit(v))).first()[0]
    assert got == 1 + 1_000_000_000 * (n + 5) // (total + 5 * v)
