"""Collocations against counting every phrase."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import collocations

SCHEMA = "doc_id long, text string, lang string, source string, n long, phrase string"


def counted(rows, longest=5):
    n, f = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    return n, f


def expected(rows, support, top):
    n, f = counted(rows)
    out = []
    for lang in n:
        mine = {p: c for (x, p), c in f.items() if x == lang and len(p) > 1 and c >= support}
        kept = []
        for p, a in mine.items():
            inside = any(len(q) > len(p) and 100 * c >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in mine.items())
            if not inside:
                score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def rows(seed=1):
    rng = random.Random(seed)
    words = ["of", "The", "the", "É", "é", "x\x1cy", "über", "a-b", "9", "z", "\U00010400", "￮"]
    out = [(0, None, "en", "s", 1, "clash"), (1, "", None, "s", 1, "clash"), (2, " \t. ,\n", "fr", "s", 1, "clash"), (None, "one", None, "s", 1, "clash")]
    out += [(5, "in the very same line of text, again", "de", "s", 1, "clash")] * 40
    for i in range(300):
        n = rng.choice([1, 5, 30, 400 if i == 7 else 20])
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ". ", "!", "\r"]) for _ in range(n))
        out.append((i, text + ("new york city hall" if i % 3 else " york city"), rng.choice(["en", "en", "de", None]), "s", 1, "clash"))
    return out


@pytest.mark.parametrize("support,top,words,bits,local", [(20, 2000, 4_000_000, 1 << 27, 2), (20, 7, 50, 1 << 27, 2), (20, 2000, 900, 1 << 20, 99), (5, 2000, 300, 1 << 15, 2), (1, 30, 500, 1 << 20, 1)])
def test_equal_to_counting_everything(spark, support, top, words, bits, local, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 60 if words < 1000 else 1_000_000)
    given = rows()
    df = spark.createDataFrame(given, SCHEMA).repartition(5)
    got = collocations.collocations(df, support, top=top, shard_words=words, bits=bits, local=local).collect()
    assert sorted(tuple(r) for r in got) == expected(given, support, top)


def test_counts_and_totals(spark):
    given = rows(2)
    n, f = counted(given)
    got = {(r.lang, r.phrase): r.f for r in collocations.frequent_phrases(spark.createDataFrame(given, SCHEMA), 10, shard_words=200).where("f > 0").collect()}
    assert got == {(x, " ".join(p)): c for (x, p), c in f.items() if c >= 10} | {(x, None): c for x, c in n.items() if c}


def test_products_beyond_64_bits(spark):
    big = spark.createDataFrame([(4 * 10**14, 9 * 10**15, 4 * 10**14, 5 * 10**14)], "a long, n long, l long, r long")
    cast = "cast({} as decimal(19, 0))".format
    assert big.select(F.expr(f"(1000 * ({cast('a')} * {cast('n')})) div ({cast('l')} * {cast('r')})")).first()[0] == 18000


def test_marks():
    marked = np.zeros(1 << 12, np.uint8)
    hashes = np.array([5, 9 + (1 << 40), 32767], np.uint64)
    for h in hashes.tolist():
        marked[(h & 32767) >> 3] |= 1 << (h & 7)
    assert collocations.is_marked(marked, hashes).all() and not collocations.is_marked(marked, hashes + np.uint64(1)).any()


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
