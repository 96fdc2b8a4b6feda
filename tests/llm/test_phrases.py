import random
import re
from collections import Counter

import numpy as np
import pytest
from busloom.llm import phrases as module
from busloom.llm.common import Bloom, bloom
from busloom.llm.phrases import Read, Slots, mine

from .cases import SCHEMA, documents, nothing, rows


def slow(rows, least=10, top=2000, cover=50):
    """Plain counting in Python."""
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            totals[lang or "und" if lang != "" else ""] += len(w)
            for k in (1, 2, 3):
                counts.update((lang if lang is not None else "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= least:
            cuts = [(10**6 * a * a // (counts[lang, p[:j]] * counts[lang, p[j:]]), j) for j in range(1, len(p))]
            score, j = min(cuts)
            found[lang, p] = (score, a, counts[lang, p[:j]], counts[lang, p[j:]])
    out = []
    for lang in {x for x, _ in found}:
        mine = {p: v for (x, p), v in found.items() if x == lang}
        left = [(p, v) for p, v in mine.items() if not any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b[1] >= cover * v[1] for q, b in mine.items())]
        left.sort(key=lambda x: (-x[1][0], -x[1][1], " ".join(x[0]).encode()))
        out += [(lang, i + 1, " ".join(p), a, l, r, totals[lang], s) for i, (p, (s, a, l, r)) in enumerate(left[:top])]
    return sorted(out, key=repr)


def got(df, **options):
    return sorted((tuple(r) for r in mine(df, **options).collect()), key=repr)


def crowd(seed, n=300):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(9)] + ["Ä", "ß", "x\u0085y", " ", "İ", "K"]
    fixed = ["New  York City", "new york\tpost", "of the", "Of The Day", "a a a a", "ÄÖ ü"]

    def text():
        return "".join(r.choice([r.choice(fixed), *r.choices(vocabulary, k=6)]) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(r.randrange(60)))

    return [(i, r.choice([None, "", text(), text(), text()]), r.choice(["en", "en", "en", None, "de", "und"]), None, None) for i in range(n)]


@pytest.mark.parametrize("slots", [1 << 21, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_counting(spark, seed, slots):
    """Counted by slots, and as it goes where candidates are too many for them."""
    own = crowd(seed)
    want = slow(own)
    assert len(want) > 15 and got(spark.createDataFrame(own, SCHEMA).repartition(5), slots=slots) == want


def test_the_first_of_each_language(spark):
    own = crowd(3)
    assert got(spark.createDataFrame(own, SCHEMA), top=7, least=5, cover_percent=90) == slow(own, 5, 7, 90)


def test_awkward_rows(spark):
    own = rows() * 3
    assert got(documents(spark, clash=True).unionAll(documents(spark, clash=True)).unionAll(documents(spark, clash=True))) == slow(own)
    assert got(nothing(spark)) == []
    assert got(spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, None)], SCHEMA)) == []


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_slots_are_minimal_perfect_and_verified(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    slots = Slots(keys)
    assert sorted(slots.of(keys).tolist()) == list(range(len(keys)))
    other = np.random.default_rng(n + 1).integers(1 << 63, 1 << 64, 2000, dtype=np.uint64)
    assert (slots.of(other) == -1).all()


def test_a_bloom_filter_loses_nothing(spark):
    h = np.random.default_rng(5).integers(-(1 << 63), 1 << 63, 4000)
    df = spark.createDataFrame([(int(x),) for x in h], "h long")
    f = bloom(df, "h", 4000)
    assert f.has(h.view(np.uint64)).all()
    assert f.has(np.random.default_rng(6).integers(0, 1 << 64, 20_000, dtype=np.uint64)).mean() < 0.05
    full = Bloom(np.full(16, 0xFFFFFFFFFFFFFFFF, np.uint64), 10)
    assert int(h.view(np.uint64)[0]) in full


def sent(monkeypatch):
    """The tables of slots that tasks write from now on."""
    tables, write = [], module.written

    def noted(df):
        out = write(df)
        if {"chunk", "phrase"} <= set(out.columns):
            tables.append(out)
        return out

    monkeypatch.setattr(module, "written", noted)
    return tables


def in_tasks(spark, own, n):
    return spark.createDataFrame(spark.sparkContext.parallelize(own, n), SCHEMA)


def test_the_text_of_a_slot_is_sent_by_one_task(spark, monkeypatch):
    """Not by each that meets it: that grows with the tasks times the candidates."""
    own = crowd(4, 60) * 8  # all tasks meet the same phrases
    tables = sent(monkeypatch)
    assert got(in_tasks(spark, own, 8)) == slow(own)
    texts = [r for t in tables for r in t.filter("slot >= 0").select("slot", "phrase").collect()]
    assert len(texts) > 100 and len(texts) == len(set(texts))


def test_slots_whose_lane_does_not_meet_them_are_named_all_the_same(spark, monkeypatch):
    own = crowd(5)
    tables = sent(monkeypatch)
    make = Slots.__init__
    monkeypatch.setattr(Slots, "__init__", lambda own, keys, lanes=None: make(own, keys, None if lanes is None else np.where(np.arange(len(keys)) % 3, 61, lanes)))
    assert got(in_tasks(spark, own, 5)) == slow(own)
    assert len(tables) == 2


def test_phrases_of_one_hash_are_noticed(spark, monkeypatch):
    class Clashing(Read):
        def keys(self, at, k):
            x = super().keys(at, k)
            return x >> np.uint64(54) << np.uint64(54) if self.seed == 11 else x

    own, found, by_slots = crowd(6), [], module._by_slots
    monkeypatch.setattr(module, "Read", Clashing)
    monkeypatch.setattr(module, "_by_slots", lambda *a: found.append(by_slots(*a)) or found[-1])
    assert got(in_tasks(spark, own, 3)) == slow(own)
    assert [f is None for f in found] == [True, False]
