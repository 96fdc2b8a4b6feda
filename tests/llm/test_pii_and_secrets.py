import hashlib
import math
import random
import re

import pytest
from busloom.llm import pii, secrets
from pyspark.sql import functions as F

from . import cases

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
SECRETS = (("assign", r"""(?ia:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"))


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def base(text, patterns, ok):
    found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p) in enumerate(patterns) for m in re.finditer(p, text or "") if ok(kind, m)]
    return ",".join(x[2] for x in sorted(found))


def personal(kind, m):
    digits = re.sub("[^0-9]", "", m[0])
    return kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15


def secret(kind, m):
    return kind == "assign" and len(m[2]) >= 6 or kind == "access" and len(m[0]) >= 20 or kind == "hex" and len(m[0]) >= 24


TEXTS = [
    "a@b.c_x@d.e +1 (234) 555-6789 4111 1111 1111 1111 1.2.3.4.5.6.7.8 000255.1.1.256 é1@x.y.z.. 🙂 9.9.9.9", "+1-+12 (3456789012345) .-", "+1 2", "+12", "1.1.1.1 " * 20 + "+12345678 9(", "4111-1111-1111-1111-", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
    "a.b@c", "@x.y", "x@y.z@w.v", "%+-@a-.b-", "1..2.3.4.5", "256.1.1.1 255.255.255.255", None, "", "+1" + "2" * 13, "+" + "1" * 16, "4111111111111112",
    "password = 'hunter22', PASSWORD:x, apiKey=\"abc123def\" api_key : zzzzzz tokentoken=abcdef ſecret=abcdef secret==xyz123", "AKIA" + "A" * 16 + " AKIASHORT AKIAAKIA" + "0" * 14, "f" * 24 + "g" + "0a" * 11 + "z" + "DEADBEEF" * 4, "token = \"" + "0123456789abcdef" * 3 + "\"",
]


def test_base_spans(spark):
    texts = TEXTS + [r[1] for r in cases.rows() if r[1] is None or len(r[1]) < 5000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, TEXTS[0]), (None, None)], "doc_id long, text string").selectExpr("*", "'c' as base", "'c' as spans", "'c' as `all`", "'c' as told")
    want = {i: base(t, PATTERNS, personal) for i, t in enumerate(texts)}
    for r in pii.report(df).collect():
        if r.doc_id is not None:
            assert r.base_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest() and r.spans == want[r.doc_id], (texts[r.doc_id], r.spans, want[r.doc_id])
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want[r.doc_id].count(f"{k}:") for k in pii.KINDS]
    want = {i: base(t, SECRETS, secret) for i, t in enumerate(texts)}
    got = secrets.scan(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None:
            assert r.base_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest(), (texts[r.doc_id], r.spans, want[r.doc_id])
            assert set(want[r.doc_id].split(",")) <= set(r.spans.split(","))
    assert pii.report(cases.nothing(spark)).count() == secrets.scan(cases.nothing(spark)).count() == 0


def test_long_texts_run_in_linear_time(spark):
    hard = ["x" * 300_000, "1" * 300_000, "a." * 150_000, "1." * 150_000, "+1" * 150_000, "a@b.co " * 2_000, "1.1.1.1 " * 1_000]
    df = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    assert got[5].n_email == 2_000 and got[6].n_ip == 1_000
    assert secrets.scan(df).count() == len(hard)


def test_disclosing_terms(spark):
    """A codename that only stands beside an address is told by it; words that stand everywhere are not."""
    own = lambda i: " ".join(f"{w}{random.Random(f'{i}{k}').randrange(500)}" if k % 2 else w for k, w in enumerate(cases.prose(i, 60).split()))
    rows = [(i, f"{own(i)} zanzibar wrote anna@corp.example.com {own(50 + i)}") for i in range(14)]
    rows += [(100 + i, f"{own(100 + i)} wrote bob{i}@x.example.org") for i in range(60)]
    near = own(900)  # near copies of one text are no proof that its words tell anything
    rows += [(200 + i, f"{near} quux{i} liliput 10.0.0.7") for i in range(6)]
    rows += [(i, rows[0][1]) for i in (500, 501)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    for i in (*range(14), 500, 501):
        text = dict(rows)[i]
        at = text.index("zanzibar")
        assert f"term:{at}:{at + 8}" in got[i].spans and got[i].n_terms == 1, got[i]
    assert all(got[100 + i].n_terms == 0 for i in range(60)) and all(got[200 + i].n_terms == 0 for i in range(6))
    clean = {r.doc_id: r.sanitized for r in pii.sanitize(df).collect()}
    assert "zanzibar" not in clean[0] and "anna@" not in clean[0] and "[EMAIL]" in clean[0] and clean[100].startswith(own(100))


def shared_words(i, common=120, own=40):
    """Texts of many common words and some of their own: a Jaccard similarity of 0.6."""
    words = [f"common{k}" for k in range(common)] + [f"own{i}x{k}" for k in range(own)]
    random.Random(i).shuffle(words)
    return " ".join(words)


def test_long_texts_with_common_words_are_different(spark):
    rows = [(i, f"{shared_words(i)} zanzibar anna@corp.example.com") for i in range(5)]
    rows += [(100 + i, shared_words(100 + i)) for i in range(200)]
    near = shared_words(900)
    rows += [(400 + i, f"{near} quux{i} liliput 10.0.0.7") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    for i in range(5):
        at = rows[i][1].index("zanzibar")
        assert got[i].n_terms == 1 and f"term:{at}:{at + 8}" in got[i].spans, got[i]
    assert all(r.n_terms == 0 for k, r in got.items() if k >= 10)


def test_words_inside_spans_are_no_terms(spark):
    """A name that stands outside addresses only beside its own is told by it, whoever else has it in an address."""
    rows = [(i, f"{shared_words(i)} anna wrote anna@corp.example.com") for i in range(8)]
    rows += [(100 + i, f"{shared_words(100 + i)} wrote anna@other{i}.example.org or 10.0.0.{i} or +49 30 1234{i:04} or 4111111111111111") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = {r.h: r.n_t for r in pii.term_counts(df).collect()}
    hashes = spark.range(1).selectExpr("xxhash64('anna') a", "xxhash64('corp') c", "xxhash64('wrote') w").first()
    assert counts[hashes.a] == 8 and hashes.c not in counts and counts[hashes.w] == 68
    got = {r.doc_id: r for r in pii.report(df).collect()}
    for i in range(8):
        at = rows[i][1].index("anna")
        assert got[i].n_terms == 1 and f"term:{at}:{at + 4}" in got[i].spans, got[i]


def test_terms_in_few_of_the_documents(spark):
    """A codename in 8 of an address's 20 documents, and one in all 3 texts of an IP, are told; words that stand once are not."""
    rows = [(i, f"{shared_words(i, 20, 4)} {'zanzibar ' * (i < 8)}anna@corp.example.com") for i in range(20)]
    rows += [(50 + i, f"{shared_words(50 + i, 20, 4)} liliput 10.0.0.7") for i in range(3)]
    rows += [(100 + i, shared_words(100 + i, 20, 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    for i, t in rows:
        at, word = next(((t.index(w), w) for w in ("zanzibar", "liliput") if w in t), (0, ""))
        assert got[i].n_terms == bool(word) and (not word or f"term:{at}:{at + len(word)}" in got[i].spans), got[i]


def slow_disclosures(docs, chance=pii.CHANCE, least_ratio=pii.DISCLOSURE):
    """entity, term and ratio from plain sets of documents; all texts are different."""
    entity = re.compile(r"[a-z0-9.]+@[a-z0-9.]+[a-z]|[0-9]+(?:\.[0-9]+){3}")
    holds, terms = {}, {}
    for i, t in docs:
        for e in set(entity.findall(t)):
            holds.setdefault(e, set()).add(i)
        for w in set(re.findall(r"[0-9a-zé]+", entity.sub(" ", t))):
            terms.setdefault(w, set()).add(i)
    n, least, out = len(docs), math.log(len(terms) / chance), {}
    for e, of in holds.items():
        rate = len(of) / n
        for w, where in terms.items():
            a, m = len(of & where), len(where)
            if not a:
                continue
            surprise = a * math.log(a / (m * rate)) + ((m - a) * math.log((m - a) / (m * (1 - rate))) if m > a else 0.0) if a > m * rate else 0.0
            ratio = math.log(n * a / (len(of) * m)) / math.log(n / len(of))
            if surprise > least and ratio >= least_ratio:
                out[e, w] = ratio
    return out


def test_disclosures_against_brute_force(spark):
    """Random documents with entities, words that go with one, some that go with two and some with none; two addresses always together."""
    r = random.Random(4)
    names = [f"u{k}@h{k % 3}.example" for k in range(12)] + [f"10.0.0.{k}" for k in range(6)]
    docs = []
    for i in range(700):
        words = [f"w{r.randrange(400)}" for _ in range(40)] + [f"own{i}x{j}" for j in range(40)]
        k = r.randrange(40)
        if k < len(names):
            words += [names[k], f"code{k}"] + [f"half{k}"] * (r.random() < 0.6) + [f"pair{k // 2}"]
            words += ["both@h9.example", "both2@h9.example"] * (k == 3)
        if r.random() < 0.01:
            words.append(f"code{r.randrange(18)}")
        r.shuffle(words)
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = pii.base(df).filter("size(base) > 0").withColumn("__digest", F.md5("__text"))
    got = {(x.entity, x.term): x.ratio for x in pii.disclosures(rows, df, "text").collect()}
    want = slow_disclosures(docs)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {"code3", "code17"} <= {w for _, w in got} and ("both@h9.example", "code3") in got and ("both2@h9.example", "code3") in got
    spans = {x.doc_id: x for x in pii.report(df).collect()}
    for i, t in docs:
        told = {w for (e, w) in want if e in t}
        assert spans[i].n_terms == sum(w in told for w in re.findall(r"[0-9a-z]+", re.sub(r"\S+@\S+|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", " ", t)))


def test_sanitize_awkward_rows(spark):
    docs = cases.documents(spark, clash=True)
    got = pii.sanitize(docs)
    assert got.count() == docs.count() and got.columns == ["doc_id", "sanitized"]
    assert {(r.doc_id, r.sanitized) for r in got.collect()} >= {(0, None), (1, ""), (3, "a")}
    assert pii.sanitize(cases.nothing(spark)).count() == 0


def test_linked_parts():
    key = "Zx9Kq2Lm7Rt4Vb8Nw3Ps6Yd1"
    text = f"user_id: deploy-bot key {key} host = db.internal.example"
    kinds = sorted(k for k, *_ in secrets.linked_spans(text, secrets.base_spans(text)))
    assert kinds == ["endpoint", "identifier", "opaque"]
    for alone in (f"key {key}", "user_id: deploy-bot", "host = db.internal.example", f"user_id: deploy-bot\n\n{key}", "user_id: deploy-bot" + " word" * 100 + f" {key}", f"{key} host = a.b", "me@a.example 10.0.0.1"):
        assert secrets.linked_spans(alone, secrets.base_spans(alone)) == []
    for text, want in (("token=abcdef12 of me@a.example at 10.0.0.1:80 or 10.0.0.256", "assign:0:14,identifier:18:30,endpoint:34:45"), (f"AKIA{'Q' * 16} {key}", f"access:0:20,opaque:21:{21 + len(key)}")):
        base = secrets.base_spans(text)
        assert secrets.listed(base + secrets.linked_spans(text, base)) == want
    assert secrets.redact("a token=abcdef b", secrets.base_spans("a token=abcdef b")) == "a [ASSIGN] b"


def test_parts_have_no_longest_size():
    key = "Zx9Kq2Lm7Rt4Vb8Nw3Ps6Yd1"
    wide, name = " " * 40, "n" * 5000
    text = f"user_id{wide}:{wide}{name} {key}{'=' * 9} host{wide}={wide}{'h.' * 400}x:123456 jdbc:{'z' * 90}://{'u' * 3000}"
    got = {k: text[a:b] for k, a, b in secrets.linked_spans(text, secrets.base_spans(text), 10_000) if not text[a:b].startswith("jdbc")}
    assert got == {"identifier": name, "opaque": key + "=" * 9, "endpoint": "h." * 400 + "x:123456"}


def slow_links(text, scope):
    """Every part against every other, character by character."""
    base = secrets.base_spans(text)
    ids, opaque, ends = secrets.parts_of(text, base)
    strong, access = [s for s in base if s[0] != "access"], [s for s in base if s[0] == "access"]

    def near(s, t):
        lo, hi = min(s[2], t[2]), max(s[1], t[1])
        return lo <= hi and hi - lo <= scope and not re.search(r"\n[ \t\r]*\n", text[lo:hi])

    some = lambda s, others: any(near(s, t) for t in others)
    weak = [s for s in opaque if some(s, ids + access)]
    return sorted([s for s in ids if some(s, strong + opaque)] + weak + [s for s in ends if some(s, strong + weak)])


@pytest.mark.parametrize("seed", range(30))
def test_links_against_brute_force(seed):
    r = random.Random(seed)
    opaque = lambda: "Aa0" + "".join(r.choice("abcDEF0123456789+/") for _ in range(r.choice([13, 20, 400])))
    make = [lambda: f"user={r.choice('abc') * r.choice([3, 9, 300])}", lambda: f"me{r.randrange(9)}@a.example", opaque, lambda: f"https://h{r.randrange(9)}.example/x", lambda: f"host: h{r.randrange(99)}", lambda: f"10.0.0.{r.randrange(300)}", lambda: "token=" + "s" * 9, lambda: "AKIA" + "Q" * 16, lambda: "0a" * 15, lambda: "\n \n", lambda: "client_id=" + opaque()]
    text = " ".join(r.choice(make)() if r.random() < 0.3 else "word" * r.randrange(1, 9) for _ in range(120))
    for scope in (5, 40, 160):
        assert sorted(secrets.linked_spans(text, secrets.base_spans(text), scope)) == slow_links(text, scope)


def test_links_take_linear_time():
    import time

    def took(n):
        text = "A0b1" * n + " " + " ".join(f"user=bob{i} 0a{'f' * 30} x@y.example" for i in range(n // 8))
        began = time.perf_counter()
        secrets.linked_spans(text, secrets.base_spans(text))
        return time.perf_counter() - began

    took(4000)
    assert min(took(64_000) for _ in range(2)) < 10 * min(took(16_000) for _ in range(2))


def test_redacted_awkward_rows(spark):
    rows = {(r.doc_id, r.redacted) for r in secrets.scan(cases.documents(spark, clash=True), redacted=True).select("doc_id", "redacted").collect()}
    assert (0, None) in rows and (1, "") in rows and (3, "a") in rows
    assert secrets.scan(cases.nothing(spark), redacted=True).count() == 0
