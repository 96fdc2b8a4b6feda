import os
import random

import numpy as np
import pyarrow.dataset as ds
import pytest
from busloom.llm import common, jaccard
from busloom.llm.jaccard import components_of, linked, prefix_length, shingles

from .cases import EXTRA, SCHEMA, documents, nothing, prose


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    out = [""]
    for c in low:
        if c in " \t\n\x0b\x0c\r":
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def slow(rows, percent=80, width=5):
    """All pairs, on the words themselves."""
    sets = []
    for _, text, *_ in rows:
        w = words(text)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (k, *_) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(s), least.get(find(i)) if s else k) for i, ((k, *_), s) in enumerate(zip(rows, sets))), key=repr)


def got(df, **options):
    return sorted((tuple(r) for r in components_of(df, **options).collect()), key=repr)


def changed(text, r, n):
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def crowd(seed):
    """Near copies of a few texts at all distances, a passage that many hold, groups of copies, short texts."""
    r = random.Random(seed)
    passage = prose(seed + 900, 60)
    rows = []
    for g in range(4):
        base = prose(seed + g, r.choice([40, 90, 200]))
        rows += [(changed(base, r, r.choice([0, 1, 1, 2, 3, 5])) + (" " + passage if g == 2 else "")) for _ in range(25)]
    rows += [passage + " " + prose(seed + 50 + i, r.choice([1, 5, 12, 40])) for i in range(40)]
    rows += [" ".join(prose(seed + 5, 90).split(" ")[: 90 - i]) for i in range(0, 60, 3)]  # a chain in which neighbours link
    rows += [prose(i % 7, 1 + i % 5) for i in range(30)] + [r.choice(rows) for _ in range(20)]
    r.shuffle(rows)
    return [(i * 3 - 40, t, None, None, None) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed):
    rows = crowd(seed)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == slow(rows)


@pytest.mark.parametrize("percent", [60, 95])
def test_other_similarities(spark, percent):
    rows = crowd(11)
    assert got(spark.createDataFrame(rows, SCHEMA), percent=percent, width=3) == slow(rows, percent, 3)


def test_texts_are_shuffled_where_the_ways_are_many(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW_WAYS", 0)
    rows = crowd(5)
    assert got(spark.createDataFrame(rows, SCHEMA)) == slow(rows)


def test_awkward_rows(spark):
    from .cases import rows

    plain = rows()
    want = slow(plain)
    assert got(documents(spark)) == want
    assert got(documents(spark, clash=True)) == want and "fp" in EXTRA
    assert got(nothing(spark)) == []
    assert got(spark.createDataFrame([(None, None, None, None, None)] * 3, SCHEMA)) == [(None, 0, None)] * 3


def test_one_shingle_is_shared_by_all(spark, monkeypatch):
    """More pairs of one pivot than a task takes."""
    monkeypatch.setattr(jaccard, "PAIRS", 8)
    r = random.Random(3)
    base = prose(1, 80)
    rows = [(i, changed(base, r, 1 + i % 3), None, None, None) for i in range(150)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == slow(rows)


@pytest.mark.parametrize("percent", [50, 80, 99, 100])
def test_prefixes_meet(percent):
    """The prefixes of sets that link share an element, in any common order."""
    r = random.Random(percent)
    for _ in range(3000):
        n = r.randrange(1, 40)
        a = r.sample(range(60), n)
        b = [x for x in a if r.random() < 0.9] + r.sample(range(60, 70), r.randrange(0, 4))
        if b and linked(len(set(a) & set(b)), len(a), len(b), percent):
            first = [set(sorted(s)[: prefix_length(len(s), percent)]) for s in (a, b)]
            assert first[0] & first[1]


def test_shingles_of_a_batch_are_those_of_each_text():
    texts = [None, "", "a", "A  b\tc", "a b c d e f a b c d e", "x" * 99, prose(3, 500)]
    one = [shingles([t])[0] for t in texts]
    assert all((a == b).all() for a, b in zip(shingles(texts), one, strict=True))
    assert [len(x) for x in one[:5]] == [0, 0, 1, 1, 6] and len(set(np.concatenate(one))) == sum(map(len, one))


def test_what_no_step_reads_again_is_gone(spark, tmp_path, monkeypatch):
    """Prefixes and entries, the largest tables, stand no longer than they are needed; sets don't travel as hashes, which no codec makes smaller."""
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    found = got(spark.createDataFrame(crowd(2), SCHEMA))
    tables = [ds.dataset(os.path.join(tmp_path, t), format="parquet").schema.names for t in os.listdir(tmp_path) if t.startswith("table-")]
    assert found and tables and not any("prefix" in t or "tokens" in t for t in tables)
    assert sum(t == ["token", "g", "n", "pos", "place"] for t in tables) == 1  # the index, and not the entries it came from
