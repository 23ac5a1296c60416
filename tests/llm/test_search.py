"""Lexical search, personal data and hard negatives against plain Python."""
import hashlib
import math
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from helpers import SCHEMA, corpus, lower_ascii  # noqa: E402

from fieldmark.llm import lexical, negatives, pii  # noqa: E402

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ---------------------------------------------------------------- lexical search
def brute_search(docs, items, k):
    read = [(d, Counter(TERM.findall(lower_ascii(t or "")))) for d, t in docs]
    read = [(d, c) for d, c in read if c]
    n, total = len(read), sum(sum(c.values()) for _, c in read)
    df = Counter(t for _, c in read for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in read:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                        for t in TERM.findall(lower_ascii(text or "")) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return Counter(out)


ITEMS = [(1, "w1 w2 w3 w250"), (2, "W1, w1; w1 w17!"), (3, None), (4, ""), (5, "nowhere else"), (6, "w5 " * 400), (7, "café ΣΣ one Two"),
         (8, "line one ok x"), (1, "w1 w2 w3 w250"), (None, "w7 a b c d e")]


@pytest.mark.parametrize("seeds, chars, k", [(100_000, 1 << 24, 10), (5, 300, 10), (5, 1 << 24, 3)])
def test_lexical_search(spark, monkeypatch, seeds, chars, k):
    """Ties by copies, repeated rows and queries, null ids and texts, blocks of queries, floors from some documents."""
    monkeypatch.setattr(lexical, "SEED_DOCUMENTS", seeds)
    monkeypatch.setattr(lexical, "BLOCK_CHARS", chars)
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    docs = docs.withColumn("n", docs.doc_id).withColumn("item", docs.text).withColumn("score", docs.doc_id)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumnsRenamed({}).selectExpr("*", "item_id AS no", "text AS rank")
    got = lexical.rank(docs, items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute_search([r[:2] for r in rows], ITEMS, k)


def test_lexical_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame(corpus(), SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.rank(docs.limit(0), items).count() == 0
    assert lexical.rank(docs, items.limit(0)).count() == 0
    assert lexical.rank(docs.where("text IS NULL"), items.where("text IS NULL")).count() == 0


def test_sketch_bounds_hold():
    """No exact score lies above its bound, whatever falls into one bucket."""
    import pyarrow as pa
    rng = np.random.default_rng(5)
    vocabulary = 4000
    lists = [rng.choice(vocabulary, rng.integers(1, 900), replace=False) for _ in range(80)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(80), pa.int64()), pa.array([2 * len(x) for x in lists], pa.int64()), pa.array(lists, pa.list_(pa.int32())),
         pa.array([rng.integers(1, 9, len(x)) for x in lists], pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "times"])
    weights, buckets = rng.integers(0, 9000, vocabulary), rng.integers(0, lexical.BUCKETS, vocabulary)
    chunk = lexical.Chunk(batch, weights, buckets, 80, sum(2 * len(x) for x in lists))
    for _ in range(30):
        held, times = rng.choice(vocabulary, 60, replace=False), rng.integers(1, 4, 60)
        wanted = np.zeros(vocabulary, np.int64)
        wanted[held] = times
        assert (chunk.bounds(buckets[held], times) >= chunk.exact(np.arange(80), wanted)).all()


# ---------------------------------------------------------------- personal data
def brute_base(text):
    def luhn(s):
        d = [int(c) for c in s if c.isdigit()][::-1]
        return sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(d)) % 10 == 0

    def digits(s):
        return sum(c in "0123456789" for c in s)
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= digits(s) <= 19 and luhn(s)),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= digits(s) <= 15)]
    found = [(m.start(), i, m.end(), kind) for i, (kind, rule, ok) in enumerate(rules) for m in re.finditer(rule, text) if ok(m.group())]
    return [(s, e, k) for s, _, e, k in sorted(found)]


PLANTED = ["a@b.com@c.org", "a@b@c.com", "x.y+z%w@h-1.co.uk.", "@a.b", "a@b", "a@b.", "a@b.c.d@e.f", "1.2.3.4.5.6.7.8", "1.2.3.4.5", "256.1.1.1 1.1.1.1",
           "001.002.003.255", "1.2.3.4444", "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111--1111 1111 1111 1111", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "41111111111111114111 1111",
           "+1 (017) 555-7713", "++1 017 555 7713 8", "+1-", "+12", "+123", "+1 (2) 3 4 5 6 7 8 9 0 -.", "+1234567890123456", "é4111111111111111é", "😀+49 170 1234567😀a@ü.de"]


def test_base_spans_are_those_of_the_patterns():
    rng, anchors = random.Random(8), pii.automaton()
    texts = [*PLANTED, " ".join(PLANTED), ""]
    texts += ["".join(rng.choice("a1@.+- é(9") for _ in range(rng.randint(1, 60))) for _ in range(6000)]
    texts += ["".join(rng.choice(["4111111111111111", "@", "a.b", " ", "-", "+1", ".", "25", "6", "x"]) for _ in range(rng.randint(1, 25))) for _ in range(4000)]
    for text in texts:
        got = [s for s in pii.spans(text, anchors) if s[2] in pii.BASE]
        assert got == brute_base(text), text


def test_added_spans():
    anchors = pii.automaton()

    def found(text):
        return [(text[s:e], k) for s, e, k in pii.spans(text, anchors)]
    assert found("IBAN: DE89 3704 0044 0532 0130 00, iban GB82WEST12345698765432") == [("DE89 3704 0044 0532 0130 00", "iban"), ("GB82WEST12345698765432", "iban")]
    assert found("IBAN: DE89 3704 0044 0532 0130 01") == []
    assert found("Account no. 12-345-678 and account 12345") == [("12-345-678", "account")]
    assert found("SSN 123-45-6789, SSN 000-45-6789, ssn: 666-45-6789") == [("123-45-6789", "ssn")]
    assert found("Tel: 030 1234567; hotel 0301234567; phone number 555-123-4567") == [("030 1234567", "tel"), ("555-123-4567", "tel")]
    assert found("https://user:pass@host.example/x https://host.example/y") == [("user:pass@host.example", "login"), ("pass@host.example", "email")]
    assert found("josé@exämple.fr") == [("josé@exämple.fr", "email_intl")]
    assert found("account 4111 1111 1111 1111") == [("4111 1111 1111 1111", "card")]
    assert found("an account of 12 phones at the hotel: see tel, phone or account.") == []


def test_personal_data_tables(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice([*PLANTED, "word", "12", "a.b"]) for _ in range(40_000))
    rows = [(i, t) for i, t in enumerate([*PLANTED, None, "", long, "9" * 300_000, "a." * 100_000 + "@b", "@" * 50_000])] + [(3, PLANTED[3]), (None, "a@b.com")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS spans", "doc_id AS id")
    got = Counter(map(tuple, pii.digest(pii.find(docs)).collect()))
    anchors, want = pii.automaton(), Counter()
    for doc, text in rows:
        base = brute_base(text or "") if text is None or len(text) < 10 ** 5 or text is long else [s for s in pii.spans(text, anchors) if s[2] in pii.BASE]
        kinds = Counter(k for _, _, k in base)
        told = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        every = ",".join(f"{k}:{s}:{e}" for s, e, k in (pii.spans(text, anchors) if text else []))
        want[(doc, *[kinds[k] for k in pii.BASE], hashlib.sha256(told.encode()).hexdigest(), every)] += 1
    assert got == want
    assert pii.find(docs.limit(0)).count() == 0
    clean = {r["id"]: r["text"] for r in pii.redact(docs.where("doc_id IN (0, 12, 25) OR text IS NULL")).collect()}
    assert clean == {0: "[email]@c.org", 12: "[card]", 25: "😀[phone]😀[email_intl]", len(PLANTED): None}


# ---------------------------------------------------------------- hard negatives
def brute_negatives(rows, every=100):
    use = []
    for i, (vec, label, v) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            use.append((i, vec, (label + 1) % 10 if vec is not None and vec % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = Counter()

    def key(vec):
        return (vec is None, vec or 0)
    for i, vec, label, v in use:
        if vec is None or vec % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), o, l) for j, o, l, w in use if j != i and len(w) == len(v)]
        scored.sort(key=lambda x: (-x[0], key(x[1])))
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p][:10]
            for rank, (n, negative, _) in enumerate(fits, 1):
                out[(vec, positive, rank, negative, p, n)] += 1
    return out


def vectors(seed, n, dim=12, scale=0.3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, scale) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, rng.randrange(4) if rng.random() < 0.95 else None, [round(x + rng.gauss(0, scale), 2) for x in c]))
    rows += [(100, 1, rows[100][2]), (200, 2, rows[0][2]), (300, None, rows[1][2]), (400, 1, None), (500, 1, []), (None, 1, rows[3][2]), (None, 2, rows[4][2]),
             (600, 0, [0.0] * dim), (700, 0, [None] + [0.5] * (dim - 1)), (701, 0, [math.nan] + [0.5] * (dim - 1)), (800, 3, [math.inf] * dim),
             (900, 1, [0.5, 0.25]), (901, 1, [0.5, 0.5]), (902, 2, [0.25, 0.25]), (903, 2, [0.5, 0.0]), (-100, 2, rows[7][2]), (-7, -3, rows[8][2])]
    return rows


@pytest.mark.parametrize("block, n, scale", [(2048, 700, 0.3), (2, 700, 0.3), (2048, 300, 900.0)])
def test_hard_negatives(spark, monkeypatch, block, n, scale):
    """Ties, repeated ids, nulls, several lengths, scores beyond one prime and beyond float32; several blocks."""
    monkeypatch.setattr(negatives, "BLOCK", block)
    rows = vectors(1, n, scale=scale)
    told = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5).selectExpr("*", "vec_id AS rid", "label AS v", "vec_id AS score")
    got = negatives.mine(told, label=negatives.relabelled())
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 100


def test_hard_negatives_of_empty_tables(spark):
    told = spark.createDataFrame(vectors(1, 120), "vec_id long, label int, embedding array<double>")
    assert negatives.mine(told.limit(0)).count() == 0
    assert negatives.mine(told.where("label IS NULL")).count() == 0
    assert negatives.mine(told.where("vec_id % 100 <> 0")).count() == 0


@pytest.mark.parametrize("dim, largest", [(1, 3), (64, 256), (200, 40_000), (1500, 1 << 25)])
def test_residue_products_are_exact(dim, largest):
    rng = np.random.default_rng(dim)
    a, b = rng.integers(-largest, largest + 1, (7, dim)), rng.integers(-largest, largest + 1, (9, dim))
    a[0], b[0], b[1] = largest, largest, -largest
    assert (negatives.scores(a, b, negatives.primes(dim * largest * largest)) == a @ b.T).all()


def test_windows_ask_for_no_vector_twice(spark):
    rows = vectors(3, 400)
    got = negatives.mine(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    ranks = defaultdict(list)
    for r in got:
        assert 30 * r["positive_score"] <= 100 * r["negative_score"] <= 90 * r["positive_score"]
        ranks[r["anchor_id"], r["positive_id"], r["positive_score"]].append(r["rank"])
    assert all(set(x) == set(range(1, max(x) + 1)) for x in ranks.values())
