"""Fill-in-middle against a plain version, over all units, block lengths and odd texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import fill_middle as fim


def plain_cuts(text, unit):
    """Where each unit begins, by hand; the end is the last."""
    if unit == "char":
        return list(range(len(text) + 1))
    if unit == "line":
        return [i for i in range(len(text)) if i == 0 or text[i - 1] == "\n"] + [len(text)]
    space = " \t\n\x0b\x0c\r"
    found = [i for i in range(len(text)) if text[i] not in space and (i == 0 or text[i - 1] in space)]
    return found + [len(text)]


def by_hand(doc_id, text, unit="char", seed="1"):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    cuts = plain_cuts(text, unit)
    n = len(cuts) - 1
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (0 if k == 0 else cuts[k] for k in (a, b))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


ODD = [None, "", " ", "\n", "x", "<", "<P", "a<P>b", "<S>", "x<M>y", "S>P>M>", "<<", "<P<S<M", "é", "日本語" * 900, "🙂" * 3000, "a\nb\n\nc", "  lead  and trail  ", "\n\nx\n", "\x00\x01", "A" * 300_000, "word " * 40_000, "é" * 5000 + "\n" + "z" * 3000]


@pytest.mark.parametrize("unit", fim.UNITS)
def test_equals_a_plain_version(spark, unit):
    r = random.Random(12)
    texts = ODD + ["".join(r.choice("ab é日🙂\n<>PSM") for _ in range(r.randint(0, 4000))) for _ in range(60)]
    rows = [*enumerate(texts), (None, "no id"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "n", "form", "h0", "output", "restored")})
    made = fim.restore(fim.fill_in_middle(docs, unit)).collect()
    assert sorted((str(x["doc_id"]), x["n"], x["form"], x["prefix_chars"] or 0, x["middle_chars"] or 0, x["output"]) for x in made) == sorted((str(i), n, f, a or 0, b or 0, o) for i, t in rows for n, f, a, b, o in [by_hand(i, t, unit)])
    assert sorted(x["restored"] for x in made) == sorted(t or "" for _, t in rows)
    assert {x["form"] for x in made} == {"plain", "psm", "spm"}
    assert all((x["prefix_chars"] is None) == (x["form"] == "plain") for x in made)
    assert fim.summary(fim.fill_in_middle(docs.limit(0), unit)).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_descent_finds_every_boundary(block):
    r = random.Random(block)
    for unit in fim.UNITS:
        for n in (*range(20), 63, 64, 65, 500):
            text = "".join(r.choice("ab é日🙂\n") for _ in range(n))
            raw = text.encode()
            tree, cuts = fim.BlockTree(raw, unit, block), plain_cuts(text, unit)
            assert tree.before(tree.n) == (len(cuts) - 1, len(text))
            for k, at in enumerate(cuts):
                chars = 0 if k == 0 else at
                assert tree.boundary(k) == (len(text[:chars].encode()), chars)
            for p in range(tree.n + 1):
                assert tree.before(p) == (int(tree.starts[: p * block].sum()), int(tree.chars[: p * block].sum()))


def test_other_draws(spark):
    docs = spark.createDataFrame([(i, "some text") for i in range(50)], "doc_id long, text string")
    assert {x["form"] for x in fim.fill_in_middle(docs, plain=0).collect()} == {"plain"}
    assert {x["form"] for x in fim.fill_in_middle(docs, plain=100, spm=100).collect()} == {"spm"}
    assert fim.fill_in_middle(docs, seed="2").collect() != fim.fill_in_middle(docs).collect() == fim.fill_in_middle(docs).collect()
    with pytest.raises(ValueError, match="unit"):
        fim.fill_in_middle(docs, unit="page")
