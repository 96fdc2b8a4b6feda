import hashlib
import re

import pytest
from busloom.llm import decontaminate as D

from . import cases

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def brute(docs, items, size=10):
    wins = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        k = min(size, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[j : j + k]), set()).add(i)
    out = []
    for doc, t in docs:
        w, hit, ids = WORD.findall(lower(t)), set(), set()
        for k in {len(x) for x in wins}:
            for j in range(len(w) - k + 1):
                if found := wins.get(tuple(w[j : j + k])):
                    hit.update(range(j, j + k))
                    ids |= found
        ids -= {None}
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def benchmark(spark):
    long = cases.prose(2, 300).split()
    items = [(1, " ".join(long[20:50])), (2, "a b c"), (2, "a b c"), (3, None), (4, ""), (None, "emoji"), (10, " ".join(long[40:55]).upper()), (9, "no such thing at all"), (77, cases.prose(77, 40_000)[5000:6000])]
    return items, spark.createDataFrame(items, "item_id long, text string")


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_scan(spark, benchmark, most):
    docs = cases.documents(spark, clash=True)
    got = sorted(map(tuple, D.scan(docs, benchmark[1], max_broadcast_bytes=most).select(*COLUMNS).collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in cases.rows()], benchmark[0])
    assert any(r[2] for r in got)
    assert D.scan(docs, benchmark[1].limit(0), max_broadcast_bytes=most).filter("contaminated or n_items > 0").count() == 0
    assert D.scan(cases.nothing(spark), benchmark[1], max_broadcast_bytes=most).count() == 0


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_removal(spark, benchmark, most):
    """Above the bound of the broadcast the same rows go, and the same spans."""
    docs = cases.documents(spark, clash=True)
    bad = {r[0] for r in brute([(r[0], r[1]) for r in cases.rows()], benchmark[0]) if r[5]}
    kept = D.decontaminate(docs, benchmark[1], max_broadcast_bytes=most)
    assert kept.columns == docs.columns and cases.same_rows(kept, docs.filter(~docs.doc_id.isin([b for b in bad if b is not None]) | docs.doc_id.isNull()))
    cut = D.decontaminate(docs, benchmark[1], remove="spans", max_broadcast_bytes=most)
    assert cut.columns == docs.columns and cases.same_rows(cut, D.decontaminate(docs, benchmark[1], remove="spans"))
    assert cut.count() == docs.count() and D.scan(cut.filter("doc_id = 5"), benchmark[1]).filter("contaminated").count() == 0
    assert D.decontaminate(cases.nothing(spark), benchmark[1], remove="spans", max_broadcast_bytes=most).count() == 0
    assert D.cut_spans("Ä, one! two? (three) end", [{"first": 1, "last": 2}]) == "Ä, ? (three) end"
    with pytest.raises(ValueError):
        D.decontaminate(docs, benchmark[1], remove="words")


def test_a_full_filter_loses_nothing(spark):
    """With 64 bits nearly all windows pass, and a passage of most documents is a hot key; the join decides the same."""
    common = cases.prose(500, 30)
    docs = [(i, f"{cases.prose(i, 20)} {common if i % 3 else ''} {cases.prose(1000 + i, 20)}") for i in range(300)]
    items = [(1, common), (2, " ".join(common.split()[:10])), (3, docs[0][1])]
    d, b = spark.createDataFrame(docs, "k long, t string"), spark.createDataFrame(items, "i long, t string")
    got = D._scan_by_join(d, b, 10, bits=64).selectExpr("k", "n_words", "n_hit", "n_items", "items_sha256", "n_hit > 0").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_windows_of_one_hash(monkeypatch):
    """Windows are told apart by their words, not by their hash."""
    monkeypatch.setattr(D, "rolling", lambda h, k: __import__("numpy").zeros(len(h) - k + 1, "uint64"))
    w = D.Windows([(1, "a b"), (2, "c d"), (3, "a b"), (None, "c d")], 2)
    texts = [D.words_of(t) for t in ("x a b", "c d a b", "b a")]
    found = w.scan(texts)
    assert [sorted(x[:2] for x in f) for f in found] == [[(1, 3)], [(0, 2), (2, 4)], []]
    assert [w.items(f) for f in found] == [{1, 3}, {1, 2, 3}, set()]
