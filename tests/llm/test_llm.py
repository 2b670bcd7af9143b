"""The corpus operators against brute force, exact round trips and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gneiss.llm import bpe, components, exact_dedup, minhash, mixing, neighbours, pii, registry, sharding, substrings, tiles, token_files, tokenizer, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns that clash with the operators' own."""
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "q r s", "y"), (None, "ab c", None), (3, None, "z"), (4, "", "z"), (5, " \t\n", "z"), (6, "w " * 30000, "x"), (7, "D d", None), (8, "mail x@y.com, +1 (555) 555-1234", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return frame.withColumns({c: F.lit(0) for c in ("id", "shard", "digest", "group_size", "size", "copies", "key", "n", "rank", "ids", "score", "component", "row", "kind", "toxic", "words")})


def test_sql_of_the_registry(spark, sf_dir, duck):
    from same import assert_same

    for name, sql in registry.ORACLE_SQL.items():
        assert_same(registry.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(sql).df())


# Personal data


def luhn(digits):
    return sum(x - 9 if x > 9 else x for x in (int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits)))) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v, d: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v, d: all(int(x) <= 255 for x in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v, d: 16 <= len(d) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v, d: 8 <= len(d) <= 15),
]


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, text or "") if ok(m.group(), re.sub("[^0-9]", "", m.group()))]


@pytest.fixture(scope="module")
def trees(spark):
    return pii.train(spark)


def test_pii_base_spans(spark, texts, odd, trees, monkeypatch):
    random.seed(2)
    parts = ["1", "2", "25", "255", "256", ".", ".", "-", " ", "@", "a", "b.c", "_", "+", "(", ")", "%", "4242424242424242", "\U0001f600", "é", "0", "00", "\n", " at ", "dot"]
    rows = list(texts.items()) + [(10_000 + i, "".join(random.choice(parts) for _ in range(random.randint(0, 80)))) for i in range(1500)]
    rows += [(20_000, None), (20_001, ""), (20_002, "1 " * 2000), (20_003, "a@" + "b." * 20_000 + "c"), (20_004, "1.2.3.4 " * 500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(pii, "read_table", lambda *_: frame)
    monkeypatch.setattr(pii, "train", lambda *_: trees)
    found = {r["doc_id"]: r for r in pii.op1_pii(spark, "").collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        spans = base_spans(text)
        joined = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert [found[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert found[i]["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(found[i]["spans"].split(",")) or not joined
    assert pii.find_spans(odd, trees).filter("kind is not null").count() == 2
    assert pii.find_spans(odd.limit(0), trees).count() == 0


def test_pii_overlaps_of_loose_spans(spark, trees, monkeypatch):
    # Spans of 0-10, 8-14 and 12-20: the second goes for the first, and the third, which only meets the second, stays.
    found = [pii.Generator("a", "phone", "A.{9}", ""), pii.Generator("b", "phone", "B.{5}", ""), pii.Generator("c", "phone", "C.{7}", ""), pii.Generator("d", "email", "D.{7}", "")]
    monkeypatch.setattr(pii, "GENERATORS", found)
    monkeypatch.setattr(pii, "valid", lambda: F.lit(False))
    monkeypatch.setattr(pii, "feature_columns", lambda: {"x": F.lit(1)})
    frame = spark.createDataFrame([(1, "A1234567B123C1234567"), (2, "D123AbcdB123456789012"), (3, "")], "doc_id long, text string")
    model = pii.Trees(1.0, [], dict.fromkeys(pii.KINDS, 0.5))
    spans = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["spans"]] for r in pii.span_lists(frame, model).collect()}
    assert spans == {1: [("phone", 0, 10), ("phone", 12, 20)], 2: [("email", 0, 8), ("phone", 4, 14)], 3: []}


def test_pii_trees_on_forms_of_no_template(spark, trees):
    right = ["please ring (415) 555-2671 tonight", "her number is 415.555.2671 or later", "my cell 312-555-0188, evenings", "fax: (212) 736-5000", "dial 0049 301 234 5678 from abroad",
             "mail joe.smith (at) uni-bonn (dot) de today", "reach me: anna [at] posteo [dot] net", "to: karl92 @ gmx. net",
             "login from 192[.]168[.]1[.]77 failed", "the host 10(.)0(.)0(.)12 is down", "server 2001:0db8:85a3:0000:0000:8a2e:0370:7334 answered",
             "visa 4539.1488.0343.6467 exp 09/27", "paid by card 4485/2757/4230/8327"]
    wrong = ["invoice 000-123-4567 was paid", "order (001) 234-5678 has shipped", "section 300(.)400(.)500(.)600 applies", "see us at noon.then leave", "serial 0047.123.456 expired", "part 9999/8888/7777/6661 is out",
             "12 apples @ noon. Sharp knives", "they met at dawn dot everyone left", "isbn 012-345-6789 sold out", "ref 012.345.6789% up"]
    frame = spark.createDataFrame(list(enumerate(right + wrong)), "doc_id long, text string")
    hit = {r["doc_id"] for r in pii.find_spans(frame, trees).filter("kind is not null").collect()}
    found = {i for i in hit if i < len(right)}
    assert len(found) >= 0.75 * len(right), [right[i] for i in set(range(len(right))) - found]
    assert len(hit) - len(found) <= 1, [wrong[i - len(right)] for i in hit - found]


# Sharding


def jump(key, n):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 40, 41, 1000, 100_000])
def test_jump_hash(spark, n):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 987654321012345, *range(500, 560)]
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    assert [r[0] for r in frame.select(sharding.jump_hash(F.col("k"), n)).collect()] == [jump(k, n) for k in keys]


def test_shards(spark, sf_dir, texts, odd):
    rows = sharding.op2_sharding(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["shard"]) == (len(raw) + 16, zlib.crc32(raw), jump(r["doc_id"], 40))
        assert r["grown_shard"] in (r["shard"], 40)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    rows = sharding.shard_documents(odd, 2).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (3, 4)) == [(16, 0), (16, 0)]
    assert len(rows) == 10 and sharding.shard_documents(odd.limit(0)).count() == 0
    one = spark.createDataFrame([(7 if i % 3 else None, "same") for i in range(500)], "doc_id long, text string")
    rows = sharding.shard_documents(one, 5, rows_per_task=10).collect()
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))


# Toxicity


def test_toxicity_on_held_out_rows(spark, sf_dir, odd):
    random.seed(1)
    labels, rows = [], []
    for i in range(600):
        toxic = i % 4 == 0
        body = [f"word{random.randint(0, 300)}" for _ in range(40)] + (["women"] if random.random() < (0.6 if toxic else 0.2) else [])
        if toxic:
            body[random.randrange(40)] = random.choice(["nastyish", "nastyly", "vileword"])
        rows.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    frame, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(frame, known)
    found = toxicity.toxicity_scores(frame, model).join(known, "doc_id").filter("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert sum((r["score"] >= 0.7) == bool(r["toxic"]) for r in found) >= 0.97 * len(found)
    # A neutral mention doesn't reject, and swapping the group changes little.
    a, b = (model.score(f"word1 word2 {t} word3".encode()) for t in ("women", "men"))
    assert max(a, b) < 0.5 and abs(a - b) < 0.1
    assert toxicity.toxicity_scores(odd, model).count() == 10 and toxicity.toxicity_scores(odd.limit(0), model).count() == 0
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns and kept.count() == 10
    assert toxicity.fit([], np.array([])).score(b"x") < 0.5


def test_long_labelled_texts_are_learnt_whole(spark):
    # The one toxic word has the largest hash of over 20,000 in each text.
    filler = [f"w{i}" for i in range(21_000)]
    bad = max((f"vile{i}" for i in range(200_000)), key=lambda w: zlib.crc32(w.encode()))
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sum(zlib.crc32(w.encode()) < zlib.crc32(bad.encode()) for w in filler) > 20_000
    frame = spark.createDataFrame([(i, " ".join([*filler, bad] if i % 2 else filler)) for i in ids], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    model = toxicity.train(frame, known)
    whole = " ".join(filler)
    assert model.score(f"{whole} {bad}".encode()) >= toxicity.THRESHOLD > model.score(whole.encode())


def toxic_rows(n=300):
    random.seed(3)
    rows = [sorted({f"w{random.randint(0, 50)}".encode() for _ in range(12)} | ({b"bad"} if t and random.random() < 0.6 else set()) | ({b"women"} if random.random() < (0.9 if t else 0.3) else set())) for t in (i % 2 for i in range(n))]
    return rows, np.array([i % 2 for i in range(n)])


def test_penalty_ties_swapped_terms():
    rows, toxic = toxic_rows()
    free, tied = (toxicity.fit(rows, toxic, penalty=p) for p in (0.0, 10.0))
    for other in (b"men", b"girls", b"boys"):
        change = [abs(m.score(b"w1 women w2") - m.score(b"w1 " + other + b" w2")) for m in (free, tied)]
        assert change[1] < 0.1 * change[0]
    assert tied.weights[0][b"bad"] > 1
    # A mention added to neutral rows changes their scores little, in any language.
    neutral = [b" ".join(r) for r, t in zip(rows, toxic, strict=True) if not t and b"women" not in r]
    for term in (b"women", "männer".encode(), b"juifs", b"mujeres"):
        change = [np.mean([abs(m.score(r + b" " + term) - m.score(r)) for r in neutral]) for m in (free, tied)]
        assert change[1] < 0.05 and (term != b"women" or change[1] < 0.3 * change[0])


@pytest.mark.parametrize("penalty", [0.0, 1.0])
def test_fit_against_a_dense_one(penalty):
    rows, toxic = toxic_rows(200)
    l1 = 5e-4
    model = toxicity.fit(rows, toxic, penalty=penalty, l1=l1, steps=1500)
    features = lambda r: {(k, w[:k] if k else w) for w in r for k in toxicity.KINDS}
    names = sorted({f for r in rows for f in features(r)} | features(toxicity._TERMS))
    dense = lambda every: np.array([[f in features(r) for f in names] for r in every], float)
    x = dense(rows)
    z = toxicity._evidence([np.flatnonzero(r) for r in x], toxic, np.ones(len(rows)), len(names))
    used = (z >= toxicity.MIN_Z) | np.isin(np.arange(len(names)), [names.index(f) for f in features(toxicity._TERMS)])
    others = [dense([toxicity.counterfactual(r, v) for r in rows]) for v in range(toxicity.VARIANTS)]
    share = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (1 - toxic).sum())
    sigmoid = lambda t: 1 / (1 + np.exp(-t))

    def loss(w, b):
        s = sigmoid(x @ w + b)
        change = np.mean([np.mean((s - sigmoid(o @ w + b)) ** 2) for o in others])
        return -(share * np.where(toxic == 1, np.log(s), np.log(1 - s))).sum() + penalty * change + l1 * np.abs(w).sum()

    w, b = np.zeros(len(names)), 0.0
    for _ in range(6000):  # plain proximal gradient
        s = sigmoid(x @ w + b)
        g, gb = x.T @ (share * (s - toxic)), (share * (s - toxic)).sum()
        for o in others:
            c = sigmoid(o @ w + b)
            d = 2 * penalty * (s - c) / len(rows) / len(others)
            g += x.T @ (d * s * (1 - s)) - o.T @ (d * c * (1 - c))
            gb += (d * s * (1 - s) - d * c * (1 - c)).sum()
        w = (w - 0.3 * g) * used
        w, b = np.sign(w) * np.maximum(np.abs(w) - 0.3 * l1, 0), b - 0.3 * gb
    found = np.array([model.weights[k].get(f, 0.0) for k, f in names])
    best = min((loss(found, t) for t in np.linspace(b - 1, b + 1, 201)))
    assert best <= loss(w, b) + 1e-3
    assert np.abs(x @ found - x @ w - (x @ found - x @ w).mean()).max() < 0.2


def test_scores_do_not_depend_on_doc_ids(spark):
    random.seed(2)
    rows = [(i, " ".join([f"word{random.randint(0, 90)}" for _ in range(30)] + ["nasty"] * (i % 3 == 0))) for i in range(300)]
    trained = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    moved = [i for i in range(1000, 3000) if zlib.crc32(str(i).encode()) % 3 != 1]
    text = dict(rows)
    models = []
    for ids in (trained, moved[: len(trained)], moved[: len(trained)][::-1]):
        frame = spark.createDataFrame([(i, text[j]) for i, j in zip(ids, trained, strict=True)] * 2, "doc_id long, text string")
        known = spark.createDataFrame([(i, int(j % 3 == 0)) for i, j in zip(ids, trained, strict=True)], "doc_id long, toxic int")
        models.append(toxicity.train(frame, known, sample=60))
    assert models[0] == models[1] == models[2] and models[0].weights[0]


# Neighbours


def near(rows, every, k):
    """Brute force over rows (vec_id, vector), all but each query's own; shorter vectors are filled up with 0."""
    used = [(i, v) for i, v in rows if v is not None and all(a is not None and np.isfinite(a) for a in v) and any(v)]
    width, out = max(len(v) for _, v in used), []
    x = np.array([[*v, *[0.0] * (width - len(v))] for _, v in used], np.float64)
    for n, (i, _) in enumerate(used):
        if i is not None and i % every == 0:
            scores = neighbours.inner_products(np.repeat(x[n : n + 1], len(x), axis=0), x)
            order = sorted((m for m in range(len(x)) if m != n), key=lambda m: (-scores[m], used[m][0] is None, used[m][0] or 0))[:k]
            out += [(i, rank, used[m][0], scores[m]) for rank, m in enumerate(order, 1)]
    return sorted(out, key=str)


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[100:400] = x[0]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] * 16), (1080, [1.0]), (None, [1.0] * 16), (0, [99.0] * 16), *[(20, [2.0] * 16)] * 3, *[(None, [1.0] * 16)] * 30]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"row": F.lit(1), "column": F.lit(2), "v": F.lit(3), "times": F.lit(4)})
    assert sorted(map(tuple, neighbours.nearest(frame, lambda i: i % 20 == 0, block=128).collect()), key=str) == near(rows, 20, 20)
    assert neighbours.nearest(frame.limit(0), lambda i: i % 20 == 0).count() == 0
    few = [(0, [0.0, 1.0]), (1, [0.5, 0.5]), (1, [1.0, 2.0])]  # one id, two vectors
    frame = spark.createDataFrame(few, "vec_id long, embedding array<float>")
    assert [tuple(r) for r in neighbours.nearest(frame, lambda i: i % 20 == 0).orderBy("rank").collect()] == [(0, 1, 1, 2.0), (0, 2, 1, 0.5)]


@pytest.mark.parametrize("dim, size", [(3, 1.0), (40, 1e-80), (40, 1e80), (2000, 1.0)])
def test_blocks_stream_past_queries(dim, size):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(500, dim)) * size * rng.choice([1.0, 1e-3, 1e3], size=(500, 1))
    x[50:120] = x[7]
    queries = np.arange(0, 500, 9)
    side = tiles.Side(np.arange(500) * 3, np.zeros(500, bool), x, np.ones(500, int))
    found = defaultdict(list)
    for q, j, score, copies in neighbours.tile_neighbours(side.part(queries), side, 11, block=64):
        found[queries[q]].append((j, score))
        assert copies == 1
    for q in queries:
        scores = neighbours.inner_products(np.repeat(x[q : q + 1], 500, axis=0), x)
        order = sorted((j for j in range(500) if j != q), key=lambda j: (-scores[j], j))[:11]
        assert found[q] == [(j, scores[j]) for j in order]


@pytest.mark.parametrize("size", [1.0, 1e60, 1e-60])
def test_neighbours_of_doubles(spark, size):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[100:] = x[0] * (1 + 1e-12 * rng.permutation(200)[:, None])  # equal as floats
    x *= size
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in neighbours.nearest(frame, lambda i: i % 20 == 0, block=128).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 300, 20))
    for q in found:
        scores = neighbours.inner_products(np.repeat(x[q : q + 1], 300, axis=0), x)
        assert found[q] == [(j, scores[j]) for j in sorted((j for j in range(300) if j != q), key=lambda j: (-scores[j], j))[:20]]


# Near duplicates


def linked_rows(rows, n=2, percent=80):
    """(doc_id, set size, smallest doc_id of the group, number of the group) of each row, ids repeated or not."""
    numbered = {k: LAST if i is None else i for k, (i, _) in enumerate(rows)}
    found = linked([(k, t) for k, (_, t) in enumerate(rows)], n, percent)
    low = {}
    for k, (_, c) in found.items():
        low[c] = min(low.get(c, LAST), numbered[k])
    plain = lambda i: None if i == LAST else i
    return [(plain(numbered[k]), size, plain(low[c]), c) for k, (size, c) in found.items()]


def linked(rows, n=2, percent=80):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(fold))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent, index = {i: i for i in sets}, defaultdict(set)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in index[s])
        for s in sets[i]:
            index[s].add(i)
        for j, k in shared.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k) and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def variants(groups=3, copies=50):
    random.seed(5)
    words, rows = [f"w{i}" for i in range(400)], []
    for _ in range(groups):
        base = [random.choice(words) for _ in range(90)]
        for _ in range(copies):
            w = list(base)
            for _ in range(random.randint(0, 14)):
                w[random.randrange(len(w))] = random.choice(words)
            rows.append(" ".join(w))
    random.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("tiles", [(512, 1024), (8, 16)])
def test_near_duplicates(spark, texts, monkeypatch, tiles):
    monkeypatch.setattr(minhash, "FEW", tiles[0])
    monkeypatch.setattr(minhash, "MANY", tiles[1])
    rows = [(i + 100_000, t) for i, t in variants()] + (list(texts.items()) if tiles[0] == 512 else [])
    expected = linked(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame, shingle=2).collect()}
    assert found == expected


def test_near_duplicates_of_odd_rows(spark, odd):
    found = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd, shingle=2).collect()]
    assert len(found) == 10 and (3, 0, 3, True) in found and (5, 0, 5, True) in found and (7, 1, 7, True) in found
    assert minhash.near_duplicates(odd.limit(0)).count() == 0
    # Of the row that stands twice one stays.
    kept = minhash.keep_representatives(odd)
    assert kept.columns == odd.columns and kept.count() == 9


def repeated_ids(seed=9):
    random.seed(seed)
    word = lambda: f"w{random.randint(0, 300)}"
    bases = [[word() for _ in range(60)] for _ in range(12)]
    rows = []
    for k in range(120):
        w = list(random.choice(bases))
        for _ in range(random.choice([0, 0, 1, 2, 30])):
            w[random.randrange(60)] = word()
        rows.append((random.choice([None, 1, 2, 3, 7, 100 + k, 100 + k, 100 + k]), " ".join(w)))
    return [*rows, *rows[:15], (None, ""), (7, None), (7, " "), (1, "a"), (None, "a")]


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a, near, other = "a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s x", "some other words that no other row has"
    rows = [(1, a), (None, near), (None, other), (4, a), (4, other + " but longer by far than that"), (4, a)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter(tuple(r)[:4] for r in minhash.near_duplicates(frame, shingle=2).select("doc_id", "component_id", "kept", "n_shingles").collect())
    assert found == Counter({(1, 1, True, 19): 1, (None, 1, False, 19): 1, (None, None, True, 7): 1, (4, 1, False, 19): 2, (4, 4, True, 13): 1})
    kept = minhash.keep_representatives(frame, shingle=2).collect()
    assert sorted(r["text"] for r in kept) == sorted([a, other, rows[4][1]])
    rows = repeated_ids()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1))
    expected = linked_rows(rows)
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame, shingle=2).collect())
    assert found == Counter(e[:3] for e in expected)
    kept = minhash.keep_representatives(frame, shingle=2)
    assert kept.columns == frame.columns and kept.count() == len({e[3] for e in expected if e[1]}) + sum(not e[1] for e in expected)


def test_joins_beyond_the_broadcast_bounds(spark, monkeypatch):
    from gneiss.llm import shared

    rows = repeated_ids(10) + [(500 + i, t) for i, t in variants(2, 30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    results = lambda: [sorted(map(str, df.collect())) for df in (minhash.near_duplicates(frame, shingle=2), exact_dedup.exact_dedup(frame), substrings.remove_repeats(frame), mixing.mix_sources(frame.withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 5))))]
    expected = results()
    for module, name, value in ((minhash, "BROADCAST_IDS", 0), (substrings, "BROADCAST_IDS", 0), (exact_dedup, "BROADCAST_HITS", 0), (mixing, "BROADCAST_SOURCES", 0), (shared, "HOT_ROWS", 2), (shared, "HOT_SHARE", 10**6)):
        monkeypatch.setattr(module, name, value)
    assert results() == expected


def test_signature_estimates():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 600).astype(np.uint64)
    for share in (0.5, 0.8, 0.95):
        other = np.concatenate([base[: int(600 * share)], rng.integers(0, 2**63, 600 - int(600 * share)).astype(np.uint64)])
        a, b = minhash.packed(minhash.minima([np.unique(base), np.unique(other)])).view(np.uint64)
        x = a ^ b
        equal = 1 - np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum() / minhash.HASHES
        exact = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
        assert abs((equal - 0.25) / 0.75 - exact) < 0.2


def test_components(spark):
    random.seed(4)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    parent = {i: i for e in edges for i in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    expected = {i: root(i) for e in edges for i in e if e[0] != e[1]}
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r["id"]: r["component"] for r in components.components(frame).collect()} == expected


# Exact duplicates


def test_exact_dedup_of_odd_rows(spark, odd):
    found = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(odd).collect())
    assert found == Counter({(1, 1, 3, True): 2, (None, 1, 3, False): 1, (1, 1, 1, True): 1, (3, 5, 3, False): 1, (4, 5, 3, False): 1, (5, 5, 3, True): 1, (6, 6, 1, True): 1, (7, 7, 1, True): 1, (8, 8, 1, True): 1})
    kept = exact_dedup.keep_first_copies(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 5, 6, 7, 8]
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0 and exact_dedup.keep_first_copies(odd.limit(0)).count() == 0
    rows = spark.createDataFrame([(1, "a b"), (1, "a    b"), (1, "ab"), (None, "c d"), (None, "cd"), (2, "c d"), (2, "c d")], "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.keep_first_copies(rows).collect())) == [(1, "a    b"), (2, "c d")]


def test_full_bytes_part_equal_digests(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, "a b"), (3, "cd"), (4, "c d"), (5, "xyz")], "doc_id long, text string")
    weak = lambda norm: F.sha2(F.octet_length(norm).cast("string"), 256)
    found = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(rows, digest=weak).collect()}
    assert found == {1: (2, 2), 2: (2, 2), 3: (4, 2), 4: (4, 2), 5: (5, 1)}


@pytest.mark.parametrize("weak", [False, True])
def test_state_outlives_a_run(spark, tmp_path, weak):
    digest = (lambda norm: F.sha2(F.octet_length(norm).cast("string"), 256)) if weak else exact_dedup.sha256_digest
    state, source = str(tmp_path / "state"), str(tmp_path / "source")
    run = lambda rows, **o: {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest, state, **o).collect()}
    assert run([(1, "ab"), (2, " a b"), (3, "xyz")]) == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True)}
    # The second run's rows meet holders of the first one, whose bytes are read through the locator; under the weak digest cd is no ab.
    second = [(4, "a   b"), (5, "ab"), (6, "cd"), (7, "xyz")]
    spark.createDataFrame(second, "doc_id long, text string").write.parquet(source)
    assert run(second, source=source) == {4: (4, 4, True), 5: (4, 4, False), 6: (6, 1, True), 7: (3, 2, False)}
    assert run([(8, "c d"), (9, "ab"), (10, "xy z"), (11, None)]) == {8: (8, 2, True), 9: (4, 5, False), 10: (10, 3, True), 11: (11, 1, True)}
    assert run([]) == {}


def test_a_stopped_run_is_repeated(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ab"), (2, "a b")], "doc_id long, text string")
    state = exact_dedup.State(spark, str(tmp_path / "state"))
    state.write_log(rows, exact_dedup.sha256_digest, 0)
    state.stream()  # stops here
    found = exact_dedup.exact_dedup(rows, state_dir=str(tmp_path / "state")).collect()
    assert {r["group_size"] for r in found} == {2}


# Encoding

PIECES = ["a", "B", "the ", "é", "é", " ", "  ", "\n", "\t", " ", "　", "\x85", "\x1c", "\x0b", "1", "23", "'s", "don't", "!", "...", "<|endoftext|>", "<|startoftext|>", "Σ", "ς ", "日本", "\U0001f600", "-", " ", "İ", "x" * 70, "ﬁ", "́", "The.\nNew"]


def strange(seed=1, n=600):
    random.seed(seed)
    out = ["".join(random.choice(PIECES) for _ in range(random.randint(0, 200))) for _ in range(n)]
    base = "".join(random.choice(PIECES) for _ in range(2500))
    return [*out, *(base[: random.randint(0, 2500)] + "x" + base[random.randint(0, 2500) :] for _ in range(40)), "", " ", "x" * 20000, "ab " * 5000]


def per_text(found):
    ids, counts = found
    return np.split(ids, np.cumsum(counts)[:-1])


def test_bpe_as_the_library(texts):
    library, encoder = tokenizer.load("word_bpe_49k.json"), bpe.ChunkEncoder()
    for own in (strange(), list(texts.values()), strange()):
        for text, ids in zip(own, per_text(encoder.encode(pa.array(own))), strict=True):
            expected = library.encode(text, add_special_tokens=False).ids
            assert ids.tolist() == expected
            assert encoder.decode(ids).decode() == library.decode(expected, skip_special_tokens=False)
    assert encoder.figures["reused"] and not encoder.figures["whole"]


MARKS = ["a", "B", "I", "E", "=", "<", " ", "  ", "\n", ",", "'S", "'s", "é", "\u0307", "\u0338", "\u0301", "İ", "Σ", "ﬁ", "ᄀ", "ᅡ", "가", "²", "\u3000", "\x85", "\x1c", "\u180e", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>"]


@pytest.mark.parametrize("most", [5, 300])
def test_marks_case_and_special_tokens_as_the_library(most):
    # Small stores drop rows all the time; most: pieces in a text.
    random.seed(most)
    words, blanks = bpe.ChunkEncoder(chunks=200, pieces=1000, stretches=200), tokenizer.BlankEncoder("byte_bpe_50k.json", most=1000)
    libraries = [tokenizer.load(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")]
    for _ in range(10):
        own = ["".join(random.choice(MARKS) for _ in range(random.randint(0, most))) for _ in range(6000 // most)]
        for encoder, library in zip((words, blanks), libraries, strict=True):
            expected = [e.ids for e in library.encode_batch(own, add_special_tokens=False)]
            assert [x.tolist() for x in per_text(encoder.encode(pa.array(own)))] == expected
    assert not words.figures["whole"]


def test_joins_that_do_not_agree_are_encoded_whole(texts):
    # A tokenizer that keeps white space: words of chunks, encoded apart, don't agree with the stretches.
    library, encoder = tokenizer.load("byte_bpe_50k.json"), bpe.ChunkEncoder("byte_bpe_50k.json")
    own = [t for t in texts.values() if len(t) > 200]
    assert [x.tolist() for x in per_text(encoder.encode(pa.array(own)))] == [library.encode(t, add_special_tokens=False).ids for t in own]
    assert encoder.figures["whole"] == len(own)


def test_chunks_are_shared():
    random.seed(7)
    passage = " ".join(f"word{random.randint(0, 9999)}" for _ in range(1500)).encode()
    texts = [b"one two three " * 9 + passage, b"other beginning of text " * 7 + passage, b""]
    data, borders = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    raw, (a, b, none) = data.tobytes(), bpe.cut_points(data, borders)
    assert [x[0] for x in (a, b, none)] == borders[:-1].tolist() and [x[-1] for x in (a, b, none)] == borders[1:].tolist()
    a, b = ({raw[x:y] for x, y in zip(cuts, cuts[1:], strict=False)} for cuts in (a, b))
    assert len(a & b) >= 0.7 * len(a)


def test_bpe_rows(spark, odd):
    library = tokenizer.load("word_bpe_49k.json")
    rows = {(r["doc_id"], tuple(r["ids"])) for r in bpe.encode_documents(odd).collect()}
    assert {(r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect()} == rows
    assert bpe.encode_digests(odd.limit(0)).count() == 0


def test_token_files(spark, sf_dir, texts, odd):
    library, base = tokenizer.load("byte_bpe_50k.json"), 0
    for r in token_files.op9_token_files(spark, sf_dir).orderBy("doc_id").collect():
        ids = np.array([*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r)[1:] == (base, len(ids), zlib.crc32(ids.tobytes()))
        base += len(ids)
    rows = token_files.read_token_files(spark, token_files.write_token_files(odd)).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 1, 1, 3, 4, 5, 6, 7, 8] and rows[4]["ids"] == [2]
    assert token_files.read_token_files(spark, token_files.write_token_files(odd.limit(0))).count() == 0


def test_byte_pieces_as_the_library():
    library, encoder = tokenizer.load("byte_bpe_50k.json"), tokenizer.BlankEncoder("byte_bpe_50k.json")
    own = strange(3)
    for text, ids in zip(own, per_text(encoder.encode(pa.array(own))), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert [x.tolist() for x in per_text(encoder.encode(pa.array(["a", ""]), 2))] == [[64, 2], [2]]


def test_token_files_of_one_doc_id(spark):
    rows = [(7, f"text {i} of many") for i in range(400)] + [(3, "first"), (9, "last")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    folder = token_files.write_token_files(frame)
    found = token_files.read_token_files(spark, folder).orderBy("start").collect()
    library = tokenizer.load("byte_bpe_50k.json")
    assert [r["doc_id"] for r in found] == [3] + [7] * 400 + [9]
    assert sorted(tuple(r["ids"][:-1]) for r in found) == sorted(tuple(library.encode(t, add_special_tokens=False).ids) for _, t in rows)


# Mixing


def test_targets(spark):
    random.seed(6)
    for case in range(4):
        sizes = {f"s{i:02}" if i else None: random.choice([0, 1, 50, 1000, 10**6]) for i in range(1 + 6 * case)}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
        target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
        while open_:
            whole = sum(weights[s] for s in open_)
            over = {s for s in open_ if left * weights[s] / whole > 2 * sizes[s]}
            if not over:
                target.update({s: left * weights[s] / whole for s in open_})
                break
            target.update({s: 2.0 * sizes[s] for s in over})
            left -= sum(2 * sizes[s] for s in over)
            open_ -= over
        assert found == pytest.approx(target)


def test_mix(spark, odd):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == 10 and all(0 <= r["copies"] <= 2 for r in rows)
    assert {r["doc_id"]: r["size"] for r in rows}[3] == 0
    emitted = mixing.emit_mix(odd)
    assert emitted.columns == odd.columns and emitted.count() == sum(r["copies"] for r in rows)
    assert mixing.mix_sources(odd.limit(0)).count() == 0


# Repeated passages


def without_repeats(rows, n=13):
    first, words = {}, []
    for i, t in rows:
        w = WORD.findall(t or "")
        words.append((LAST if i is None else i, w))
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            first[g] = min(first.get(g, LAST), words[-1][0])
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((None if i == LAST else i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_repeats(spark, sf_dir, texts):
    found = sorted(map(tuple, substrings.op10_substrings(spark, sf_dir).collect()), key=str)
    assert found == without_repeats(texts.items())


def test_repeats_in_crowded_texts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_WORDS", 500)
    random.seed(3)
    rows = [(i if i % 17 else None, " ".join(random.choice("ab") if random.random() < 0.5 else random.choice("abcde") for _ in range(random.randint(0, 60)))) for i in range(300)]
    base = " ".join(random.choice("abcdefgh") for _ in range(40))
    rows += [(5000, None), (5001, ""), (5002, "a" * 100_000), (7000, "x " * 100), (6003, base + " zz"), *((6000 + i, base) for i in range(20))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "anchors", "starts", "key", "sha")})
    assert sorted(map(tuple, substrings.remove_repeats(frame).collect()), key=str) == without_repeats(rows)
    full = substrings.remove_repeats(frame, texts=True).collect()
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in full)
    assert substrings.remove_repeats(frame.limit(0)).count() == 0


def test_repeats_under_one_id(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(13))
    unique = " ".join(f"u{i}" for i in range(20))
    rows = [(1, base + " tail"), (5, base + " other end"), (5, unique), (None, base + " x"), (None, unique + " y"), (None, unique + " z"), (7, unique), (7, "  " + unique), (7, unique + " z"), (9, unique)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substrings.remove_repeats(frame).collect()), key=str) == without_repeats(rows)
    random.seed(11)
    passages = [" ".join(random.choice("abcdefgh") for _ in range(25)) for _ in range(6)]
    rows = [(random.choice([None, 1, 2, 3, 50 + k, 60 + k]), " ".join(random.choice(passages) if random.random() < 0.5 else random.choice("abcdxyz") for _ in range(random.randint(0, 9)))) for k in range(150)]
    rows += rows[:20]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for words in (100_000, 50):  # with few words a shard, crowded anchors are cut into windows
        monkeypatch.setattr(substrings, "SHARD_WORDS", words)
        assert sorted(map(tuple, substrings.remove_repeats(frame).collect()), key=str) == without_repeats(rows)
    full = substrings.remove_repeats(frame, texts=True).collect()
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in full)
    assert sorted(map(tuple, (r[:4] for r in full)), key=str) == without_repeats(rows)


def test_suffix_automaton():
    random.seed(8)
    passages = [[random.randrange(3) for _ in range(random.randint(3, 25))] for _ in range(60)]
    automaton = substrings.SuffixAutomaton()
    for owner, p in enumerate(passages):
        automaton.add(p, owner)
    automaton.close()
    for p in passages:
        windows = [tuple(p[k : k + 3]) for k in range(len(p) - 2)]
        expected = [next(o for o, q in enumerate(passages) if w in zip(q, q[1:], q[2:], strict=False)) for w in windows]
        assert automaton.least_owners(p, 3) == expected


# Pipeline


def test_pipeline_of_odd_rows(spark, sf_dir, odd, monkeypatch):
    """Nulls in any column, repeated and null ids, empty tables, and extra columns with the operators' own names."""
    import corpus_pipeline

    model = toxicity.Model(-2.0, {0: {b"vile": 9.0}})
    monkeypatch.setattr(toxicity, "train", lambda *_: model)
    more = odd.limit(1).withColumns({"doc_id": F.lit(50).cast("long"), "text": F.lit("a vile text")})
    for frame in (odd.unionByName(more), odd.limit(0)):
        now = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf_dir)
            assert now.columns == frame.columns
        rows = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
        assert rows.columns == ["doc_id", "n_tokens", "ids"]
        assert {r["doc_id"] for r in rows.collect()} <= {1, 5, 6, 7, 8}


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline

    now = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf_dir)
        assert out.columns == docs.columns, name
        out.cache()
        kept.append({r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()})
        if name == "exact_dedup":
            assert len({re.sub(r"[\x20\x09-\x0D]", "", t) for t in kept[-1].values()}) == len(kept[-1])
        if name == "minhash_near_dedup":
            before = linked(kept[-2].items(), n=5)
            assert set(kept[-1]) == {i for i, (_, c) in before.items() if c == i}
        now = out
    library = tokenizer.load("word_bpe_49k.json")
    rows = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).collect()
    assert len(rows) == now.count()
    assert all(list(r["ids"]) == library.encode(kept[-1][r["doc_id"]], add_special_tokens=False).ids for r in rows)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(r["doc_id"] for r in rows)


# Shared folder, draws of repeated rows


def test_folder_of_a_session_without_setting(spark, monkeypatch):
    from gneiss.llm import shared

    class Bare:
        conf = type("Conf", (), {"get": staticmethod(lambda key, other=None: other)})
        sparkContext = type("Context", (), {"master": "local[2]", "applicationId": "one"})

    a, b = shared.shared_dir(Bare()), shared.shared_dir(Bare())
    assert a == b and a.startswith("file:///")
    Bare.sparkContext.master = "spark://host:7077"
    with pytest.raises(RuntimeError):
        shared.shared_dir(Bare())
    # The operators take the folder from there.
    monkeypatch.setattr(shared, "shared_dir", lambda _: a)
    assert shared.written(spark.range(5).groupBy("id").count(), "x").count() == 5


@pytest.mark.parametrize("same_text", [False, True])
def test_draws_of_null_and_repeated_ids(spark, monkeypatch, same_text):
    rows = [(None, "one two three four" if same_text else f"one two three {i}", f"s{i % 4}") for i in range(1000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for broadcast in (50_000, 0):
        monkeypatch.setattr(mixing, "BROADCAST_KEYS", broadcast)
        found = mixing.mix_sources(frame).groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.count(F.lit(1)).alias("n")).collect()
        assert len(found) == 4
        for r in found:
            assert r["n"] == 250 and abs(r["taken"] - r["target"]) <= 0.1 * r["target"]
    assert mixing.mix_sources(frame).select("copies").collect() == mixing.mix_sources(frame).select("copies").collect()


def test_sources_in_many_tasks(spark):
    rows = [(f"s{i:05}" if i else None, i % 97) for i in range(3000)]
    frame = spark.createDataFrame(rows, "source string, source_size long").repartition(7)
    found = {r["source"]: r for r in mixing._weighed(frame).collect()}
    for n, name in enumerate(sorted((s for s, _ in rows if s), key=str)):
        assert (found[name]["number"], found[name]["weight"]) == (n, (3, 1, 2)[n % 3])
    assert found[None]["number"] == 2999


def test_hot_bucket_of_many_groups_is_tiled(spark, monkeypatch):
    """Members of one bucket that no hub draws together are compared in tiles of bounded size."""
    monkeypatch.setattr(minhash, "FEW", 4)
    monkeypatch.setattr(minhash, "MANY", 8)
    rows = spark.createDataFrame([(1, n, n // 3, 0, 40, 60) for n in range(60)], "key long, node long, component long, major long, few long, many long")
    few, many = minhash._tiled(rows, ["key", "node", "component"])
    pairs = few.alias("x").join(many.alias("y"), [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "row", "column")])
    assert pairs.count() == 57 * 60 == pairs.select("x.node", "y.node").distinct().count()
    assert pairs.groupBy("x.row", "x.column").count().agg(F.max("count")).first()[0] < 57 * 60 / 10
