"""Near-duplicates, vectors, packing, suffix tree, licenses and fixity against plain Python."""
import hashlib
import math
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from helpers import SCHEMA, corpus, lower_ascii, prose, reach, tokens  # noqa: E402

from fieldmark.llm import fixity, graph, licenses, near, packing, suffix_model, vectors  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def shingle_set(text, size):
    w = tokens(lower_ascii(text or ""))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_components(rows, size, percent):
    sets = [shingle_set(t, size) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label, least = reach(range(len(rows)), links), defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[label[i]].append(doc)
    return [(doc, len(sets[i]), min(least[label[i]], default=None)) for i, (doc, _) in enumerate(rows)]


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_minhash_near_duplicates(docs, size, percent):
    want = brute_components([r[:2] for r in corpus()], size, percent)
    got = near.near_duplicates(docs.withColumn("n", docs.doc_id).withColumn("key", docs.text), size, percent).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(want)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["component_id"] is not None)


def test_one_document_of_each_group_stays(docs):
    rows = corpus()
    want = brute_components([r[:2] for r in rows], 5, 80)
    kept = {r["doc_id"] for r in near.one_of_each(docs).collect()}
    assert kept - {None} == {w[2] for w in want if w[0] is not None}
    out = near.one_of_each(docs.withColumn("th", docs.text).withColumn("component_id", docs.doc_id))
    ids = Counter(r["doc_id"] for r in out.where("doc_id IS NOT NULL").collect())
    assert set(ids.values()) == {1} and out.columns == [*docs.columns, "th", "component_id"]


def test_near_duplicates_in_a_crowded_group(spark, monkeypatch):
    """Copies of one text with few and with many changes, over several blocks: as brute force says."""
    import random
    monkeypatch.setattr(near, "BLOCK", 16)
    rng, base = random.Random(4), prose(random.Random(9), 120).split()
    rows = []
    for i in range(90):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 4, 5, 6, 9])):
            copy[rng.randrange(len(copy))] = f"y{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(copy)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.near_duplicates(table, 3, 85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_components(rows, 3, 85))


def test_multi_index_finds_all_pairs_within_the_bound():
    rng, bound = np.random.default_rng(1), near.distance_bound(85)
    chunks = near.chunks_for(bound)
    a = rng.integers(0, 1 << 16, (300, near.SYMBOLS), dtype=np.uint16)
    b = a.copy()
    for i in range(len(a)):
        b[i, rng.choice(near.SYMBOLS, bound, replace=False)] += 1
    assert ((near.chunk_keys(a, chunks) == near.chunk_keys(b, chunks)).any(axis=1)).all()
    assert not (near.chunk_keys(a[:-1], chunks) == near.chunk_keys(a[1:], chunks)).any()


def test_hot_keys_are_dealt_by_salt(spark, monkeypatch):
    monkeypatch.setattr(near, "SALTED", 16)
    rows = spark.createDataFrame([(1, i) for i in range(1000)] + [(i, i) for i in range(2, 40)] + [(99, 5), (None, 6)], "k long, v long")
    side = spark.createDataFrame([(i, f"s{i}") for i in range(60)] + [(None, "none")], "k long, w string")
    got = near._spread(rows, side, "k", "v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(side, "k").collect()))
    empty = near._spread(rows.limit(0), side, "k", "v")
    assert empty.count() == 0 and empty.columns == got.columns == ["k", "v", "w"]


def test_near_duplicates_of_hot_hubs_in_small_blocks(spark, monkeypatch):
    """Several large families around shared passages: hubs with many parts, dealt by salt and in small blocks."""
    import random
    monkeypatch.setattr(near, "SALTED", 4)
    monkeypatch.setattr(near, "BLOCK", 8)
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 600)
    rng = random.Random(5)
    common, texts = [f"c{i}" for i in range(60)], []
    for family in range(4):
        own = [f"f{family}w{i}" for i in range(10)]
        for _ in range(30):
            words = common + own
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
            texts.append(" ".join(words))
    rows = list(enumerate(texts))
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_components(rows, 3, 85))


def test_near_duplicates_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert near.near_duplicates(none).count() == 0 and near.one_of_each(none).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(200, 300)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1200, (120, 2))]
    ids = {i for x in links if x[0] != x[1] for i in x}
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == reach(ids, [x for x in links if x[0] != x[1]])
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embedding_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 32)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16))
    noise = [1e-3, 0.02, 0.05, 0.06, 0.07]
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)]
    rows += [(1000 + k, [float(v) for v in x[k % 40] + rng.normal(size=16) * noise[k % 5]]) for k in range(300)]
    rows += [(2000, rows[3][1]), (2001, [2 * v for v in rows[3][1]]), (3, rows[3][1])]
    odd = [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] + [1.0] * 15), (3004, [None] + [1.0] * 15), (3005, [float("inf")] + [1.0] * 15), (3006, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, "l") for r in rows + odd], "vec_id long, embedding array<double>, gid string")
    unit = np.array([e for _, e in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= vectors.COSINE
    label = reach(range(len(rows)), [(a, b) for a, b in zip(*np.nonzero(linked)) if a != b])
    least = defaultdict(lambda: 10 ** 9)
    for i, (doc, _) in enumerate(rows):
        least[label[i]] = min(least[label[i]], doc)
    want = Counter((doc, int(linked[i].sum()) - 1, least[label[i]]) for i, (doc, _) in enumerate(rows)) + Counter((i, 0, i) for i, _ in odd)
    got = vectors.near_duplicates(table).collect()
    found = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got)
    assert len(got) == len(rows) + len(odd) and sum(r["n_links"] for r in got) >= 0.99 * (linked.sum() - len(rows))
    assert sum((found & want).values()) >= 0.99 * len(got)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert vectors.near_duplicates(table.limit(0)).count() == 0 and vectors.near_duplicates(table.where("vec_id > 2999")).count() == len(odd)


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows, limit = [(i, t) for i, t, *_ in corpus()] + [(900, "it's 123 <|endoftext|> a b é \x1c x'll"), (901, "İ ΣΑΣ ǅ")], 64
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, offset int")
    want = Counter()
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END_ID], "<u4")
        for k, at in enumerate(range(0, len(ids), limit)):
            want[(i, k, at, len(ids[at:at + limit]), zlib.crc32(ids[at:at + limit].tobytes()))] += 1
    packed = packing.pack(table, limit=limit)
    got = packed.collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        assert sum(n for _, n in parts) <= limit
        assert [a for a, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
    assert len(by) <= math.ceil(sum(r["length"] for r in got) / limit) + 1
    whole = packing.sequences(table, packed, limit=limit).collect()
    assert len(whole) == len(by) and all(len(r["ids"]) == 4 * r["n_tokens"] for r in whole)
    assert packing.pack(table.limit(0)).count() == 0


def test_packing_plan_uses_every_length_once():
    rng = np.random.default_rng(3)
    for counts in (rng.integers(0, 4, 65), rng.integers(0, 500, 65), np.bincount([64] * 5 + [1] * 7, minlength=65), np.bincount([33] * 9, minlength=65), np.zeros(65, int)):
        counts = np.array(counts)
        counts[0] = 0
        used = Counter()
        sequences = 0
        for pattern, times in packing.plan(counts, 64):
            assert sum(pattern) <= 64 and times > 0
            sequences += times
            for n in pattern:
                used[n] += times
        assert used == Counter({n: int(c) for n, c in enumerate(counts) if c})
        assert sequences <= max(math.ceil((counts * np.arange(65)).sum() / 64) * 1.05 + 1, counts[33:].sum())


def test_word_ids_do_not_depend_on_what_is_remembered(monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT", 40)
    monkeypatch.setattr(packing, "REMEMBER", 5)
    words = packing._word_ids(None)
    text = prose(np.random.default_rng(0) and __import__("random").Random(2), 300) + " don't STOP-it 42% \n\t x"
    for ids, t in zip(words.encode([text, "", "one", text]), [text, "", "one", text]):
        assert np.frombuffer(ids, "<u4").tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids


def test_word_ids_take_little_memory():
    """1.2 million different words, each met twice, in a process of its own."""
    code = """if True:
        import resource
        from fieldmark.llm import packing
        words, mb = packing._word_ids(None), lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
        letters, before, n = "abcdefghijklmnopqrst", mb(), 0
        for at in range(0, 1_200_000, 100_000):
            text = " ".join(letters[k % 20] + letters[k // 20 % 20] + letters[k // 400 % 20] + letters[k // 8000 % 20] + letters[k // 160000] for k in range(at, at + 100_000))
            n += sum(len(ids) // 4 for ids in words.encode([text, text]))
        print(n, mb() - before)
    """
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=300)
    n, grown = out.stdout.split()
    assert int(n) >= 2_400_000 and float(grown) < 170


def test_packing_hands_out_small_batches(spark, monkeypatch):
    key, seen, stored = "spark.sql.execution.arrow.maxBytesPerBatch", [], packing.saved
    table = spark.createDataFrame([(k, "word " * 100) for k in range(60)], "doc_id long, text string").coalesce(1)

    def recorded(df, name, *more):
        if name == "pieces":  # what a worker gets at this time
            sizes = table.mapInArrow(lambda got: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in got), "n long")
            seen.append(max(r["n"] for r in sizes.collect()))
        return stored(df, name, *more)

    before = spark.conf.get(key)
    monkeypatch.setattr(packing, "saved", recorded)
    monkeypatch.setattr(packing, "SEGMENT", 2000)
    assert packing.pack(table).count() == 60 and seen and seen[0] < 20
    assert spark.conf.get(key) == before



def brute_tree(streams, depth, gain, discount, least):
    """Log10 probability of a byte after a context, from the definitions, with dictionaries."""
    counts = Counter(s[i - k:i + 1] for s in streams for i in range(1, len(s)) for k in range(min(depth, i) + 1))
    symbols = sum(n for s, n in counts.items() if len(s) == 1)
    seen = {s: n for s, n in counts.items() if n >= least or len(s) == 1}
    states = {}

    def p(context, x):
        while context and context not in states:
            context = context[1:]
        if not context:
            return (seen.get(bytes([x]), 0) + 1) / (symbols + 256)
        own, share = states[context]
        return own[x] if x in own else share * p(context[1:], x)

    by = defaultdict(dict)
    for s, n in seen.items():
        if len(s) > 1:
            by[s[:-1]][s[-1]] = n
    for context in sorted(by, key=len):
        total, nexts = seen[context], by[context]
        own = {x: (n - discount) / total for x, n in nexts.items()}
        below = {x: p(context[1:], x) for x in nexts}
        rest = 1 - sum(own.values())
        share = rest / max(1 - sum(below.values()), 1e-9)
        better = sum(n * math.log(own[x] / below[x]) for x, n in nexts.items()) + total * rest * math.log(share)
        if better >= gain * len(nexts):
            by[context]["keep"] = (own, share)
        states.update({c: v["keep"] for c, v in by.items() if "keep" in v and len(c) == len(context)})
    return p


def test_suffix_tree(spark, docs):
    rows, depth = corpus(), 2
    held = {r: zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 7 == 2 for r in rows}
    words = {r: tokens(lower_ascii(r[1] or "")) for r in rows}
    streams = {r: b"\n" + " ".join(words[r]).replace("\x00", "\x01").encode() + b"\n" for r in rows}
    train = [r for r in rows if not held[r]]
    p = brute_tree([streams[r] for r in train], depth, suffix_model.GAIN, suffix_model.DISCOUNT, 2)
    c = Counter(w for r in train for w in [*words[r], "\n"])
    n, v = c.total(), len(c)
    got = suffix_model.score(docs.withColumn("row", docs.text), depth=depth, heavy=0.002).collect()
    assert len(got) == len(rows)
    told = defaultdict(list)
    for r in got:
        told[r["doc_id"]].append(r)
    for r in rows:
        s = streams[r]
        score = sum(math.log10(p(s[max(0, i - depth):i], s[i])) for i in range(1, len(s)))
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words[r], "\n"])
        known = sum(c[w] > 0 for w in [*words[r], "\n"])
        assert any(x["held_out"] == held[r] and (x["n_tokens"], x["n_known"], x["train_tokens"]) == (len(words[r]) + 1, known, n)
                   and x["base_score"] == pytest.approx(base) and x["score"] == pytest.approx(score) for x in told[r[0]]), r[0]


def test_suffix_tree_keeps_rare_contexts(spark, docs):
    """What the tree holds does not depend on the share of a context, nor on what is broadcast."""
    rows, depth = [r for r in corpus() if r[0] is not None], 3
    streams = {r[0]: b"\n" + " ".join(tokens(lower_ascii(r[1] or ""))).replace("\x00", "\x01").encode() + b"\n" for r in rows}
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    p = brute_tree([streams[r[0]] for r in train], depth, suffix_model.GAIN, suffix_model.DISCOUNT, 2)
    got = suffix_model.score(docs.where("doc_id IS NOT NULL"), depth=depth, p_min=0.01).collect()
    assert len(got) == len(rows)
    for r in got:
        s = streams[r["doc_id"]]
        assert r["score"] == pytest.approx(sum(math.log10(p(s[max(0, i - depth):i], s[i])) for i in range(1, len(s)))), r["doc_id"]


def test_suffix_tree_distributions_sum_to_one(spark, docs):
    tree = suffix_model.fit(docs.select(suffix_model.stream(docs.text).alias("stream")), depth=4)
    for context in (b"\n", b" w1 ", b"w12", b"\xc3", b"zzzz", b" a b"):
        before = sum(x << 8 * (k + 1) for k, x in enumerate(reversed(context[-4:])))
        assert (10 ** tree.log10(np.arange(256) | before, 4)).sum() == pytest.approx(1)
    none = spark.createDataFrame([], SCHEMA)
    assert suffix_model.score(none).count() == 0
    assert suffix_model.score(spark.createDataFrame([(None, None)], "doc_id long, text string")).first()["n_tokens"] == 1


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"]
    texts = [(1, "x " + mit + " y"), (2, mit.upper().replace("RESTRICTION", "limits AND bounds")), (3, "Licensed under CC BY-NC 4.0. " * 3),
             (4, "permission is granted to nobody, free of charge"), (5, None), (6, ""), (None, "Released under the MIT License."),
             (7, "word " * 5000 + "Licensed under the Apache License, Version 2.0."), (1, "x " + mit + " y"), (8, "é😀 Released under the MIT License. é")]
    table = spark.createDataFrame([(*t, "c") for t in texts], "doc_id long, text string, start string")
    got = licenses.scan(table).collect()
    assert Counter((r["doc_id"], r["license"]) for r in got) == Counter(
        {(1, "MIT"): 2, (2, "MIT"): 1, (3, "CC-BY-NC-4.0-statement"): 3, (None, "MIT-statement"): 1, (7, "Apache-2.0-statement"): 1, (8, "MIT-statement"): 1})
    by = {r["doc_id"]: r for r in got}
    assert texts[-1][1][by[8]["start"]:by[8]["end"]] == "Released under the MIT License" and by[1]["coverage"] == 1.0 and 0.95 < by[2]["coverage"] < 1
    assert licenses.scan(table.limit(0)).count() == 0


def test_banded_alignment_against_the_full_table():
    import random
    rng = random.Random(1)
    for _ in range(40):
        template = [rng.randrange(1, 9) for _ in range(12)]
        doc = [rng.randrange(0, 9) for _ in range(6)] + [x for x in template if rng.random() > 0.15] + [rng.randrange(0, 9) for _ in range(6)]
        table, best = [[0] * (len(doc) + 1) for _ in range(len(template) + 1)], 0
        for p in range(1, len(template) + 1):
            for i in range(1, len(doc) + 1):
                table[p][i] = max(0, table[p - 1][i - 1] + (2 if doc[i - 1] == template[p - 1] else -1), table[p - 1][i] - 1, table[p][i - 1] - 1)
                best = max(best, table[p][i])
        matched, a, b = licenses.align(doc, template, 0, 0, 40)
        assert 2 * matched >= best and (not matched or (doc[a] in template and doc[b - 1] in template))


def test_winnowing_keeps_one_of_every_window():
    import random
    rng = random.Random(0)
    hashes = [rng.randrange(50) for _ in range(200)]
    kept = set(licenses.winnow(hashes, 5))
    assert all(kept & set(range(i, i + 5)) for i in range(196))


def test_fixity_audit(spark):
    rows = [(a, o, f"{a}-{o}") for a in (1, 2, 3, None) for o in range(0, 40 * fixity.RANGE * fixity.FANOUT, 17 * fixity.RANGE)]
    rows += [(1, None, "no offset"), (2, 5, "one"), (2, 5, "other"), (3, 7, None)]

    def table(data):
        return spark.createDataFrame([(*r, "x") for r in data], "archive long, offset long, payload string, node string") \
            .select("archive", "offset", "node", fixity.digest(fixity.F.col("payload")).alias("digest"))

    damaged = [(a, o, "changed" if (a, o) == (1, 34 * fixity.RANGE) else p) for a, o, p in rows if (a, o) != (2, 0)]
    damaged = [(a, o, "" if (a, o) == (3, 7) else p) for a, o, p in damaged] + [(2, 5, "one"), (None, 1, "extra")]
    records, levels = fixity.audit(table(rows), table(damaged))
    got = sorted((str(r["archive"]), r["offset"], r["status"]) for r in records.collect())
    assert got == sorted([("1", 34 * fixity.RANGE, "changed"), ("2", 0, "missing"), ("2", 5, "changed"), ("3", 7, "changed"), ("None", 1, "extra")])
    assert [x.count() for x in levels] == [4] * len(levels)  # of each archive one branch, not its 40 x 16 ranges
    same, nothing = fixity.audit(table(rows), table(rows[::-1]))
    assert same.count() == 0 and nothing[0].count() == 0
    none = table(rows).limit(0)
    assert fixity.audit(none, none)[0].count() == 0 and fixity.audit(table(rows), none)[0].count() == len({r[:2] for r in rows})


def test_fixity_tree_is_the_plain_one(spark):
    rows = [(1, o, f"p{o}") for o in range(0, 30 * fixity.RANGE, fixity.RANGE // 3)]
    held = fixity.marks(spark.createDataFrame(rows, "archive long, offset long, payload string").select("archive", "offset", fixity.digest(fixity.F.col("payload")).alias("digest")))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = defaultdict(list)
    for _, o, p in rows:
        level[o // fixity.RANGE].append(f"{o}:{sha(p)}")
    level = {n: sha("\n".join(x)) for n, x in level.items()}
    for nodes in fixity.tree(held, 3):
        assert {r["node"]: r["hash"] for r in nodes.collect()} == level
        above = defaultdict(list)
        for n in sorted(level):
            above[n // fixity.FANOUT].append(f"{n}:{level[n]}")
        level = {n: sha("\n".join(x)) for n, x in above.items()}
