"""Vectors, spelling variants and the conversation trie against brute force, and their odd rows."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import embeddings, spelling, trie

VECTORS = "vec_id bigint, embedding array<float>, label int, node string, cell int"
TURNS = "conv_id bigint, turn bigint, role string, text string, depth int, k1 string"


# vectors -----------------------------------------------------------------------------------------------------------------------
def close(seed: int, base: np.ndarray, cos: float) -> np.ndarray:
    u = np.random.default_rng(seed).normal(size=len(base))
    base = base / np.linalg.norm(base)
    u -= (u @ base) * base
    return cos * base + math.sqrt(1 - cos * cos) * u / np.linalg.norm(u)


def brute_vectors(rows, least=0.9):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)
    unit = []
    for r in rows:
        if not usable(r[1]):
            unit.append(None)
            continue
        x = np.array(r[1], np.float32).astype(np.float64)
        x /= np.abs(x).max()
        unit.append(x / np.linalg.norm(x))
    link = [[j for j, y in enumerate(unit) if i != j and x is not None and y is not None and len(x) == len(y) and x @ y >= least] for i, x in enumerate(unit)]
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((r[0], len(link[i]), c, r[0] is not None and r[0] == c))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(160):
        rows.append((i, rng.normal(size=16).tolist()))
    for i in range(60):                                         # near copies, some of copies
        rows.append((1000 + i, close(i, np.array(rows[i % 20][1]), 0.93).tolist()))
    rows += [(2000 + i, rows[0][1]) for i in range(30)]          # exact copies
    rows += [(3000, [x * 1e-30 for x in rows[1][1]]), (3001, [x * 1e30 for x in rows[1][1]]), (3002, None), (3003, []), (3004, [0.0] * 16), (3005, [float("nan")] + [1.0] * 15),
             (3006, [float("inf")] * 16), (3007, [None] + [1.0] * 15), (3008, [1.0, 2.0]), (3009, [2.0, 4.0]), (3010, [-1.0, -2.0]), (None, rows[2][1]), (None, [5.0, -3.0]), (3011, rows[3][1]), (3011, rows[3][1]),
             (3012, rows[4][1] + [0.0])]
    return [(a, v, 1, "x", 2) for a, v in rows]


def test_vectors_equal_brute_force(spark, vector_rows):
    df = spark.createDataFrame(vector_rows, VECTORS).repartition(4)
    want = brute_vectors(vector_rows)
    assert found(embeddings.near_vectors(df)) == want
    # many small cells with the slack that proves completeness
    assert found(embeddings.near_vectors(df, slack=math.sqrt(0.2) + 1e-9, cell=20)) == want
    stay = {r.vec_id for r in embeddings.drop_near_vectors(df).collect()}
    assert stay == {r[0] for r in want if r[3] or r[0] is None}
    assert embeddings.drop_near_vectors(df).columns == df.columns


def test_vectors_recall_of_the_default(spark):
    """Isolated pairs of cosine 0.90 to 0.92 among vectors without any structure: the hardest case for cells."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000 + i, close(i, v, rng.uniform(0.901, 0.92)).tolist()) for i, v in enumerate(x)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), cell=60)
    n = got.where("n_links = 1").count()
    assert n >= 0.99 * len(rows) and got.where("n_links > 1").isEmpty()
    assert n == 2 * got.where("component_id < 10000 and vec_id >= 10000").count()     # a found link counts at both ends


def test_blocks_of_one_cell(spark, vector_rows):
    """A cell cut into blocks gives what one block gives."""
    d = spark.createDataFrame([(i, 1 + i % 3, r[1]) for i, r in enumerate(vector_rows[:250])], "node bigint, copies bigint, v array<float>")
    def run(block):
        f = embeddings.links(d, 0.9, 0.1, cell=50, block=block)
        return {(r.a, r.n) for r in f.where("n is not null").groupBy("a").agg(F.sum("n").alias("n")).collect()}
    assert run(2048) == run(7) != set()


def test_no_vectors(spark):
    assert found(embeddings.near_vectors(spark.createDataFrame([], VECTORS))) == []
    odd = spark.createDataFrame([(1, None, 0, "", 0), (None, None, 0, "", 0)], VECTORS)
    assert found(embeddings.near_vectors(odd)) == sorted([(1, 0, 1, True), (None, 0, None, False)], key=repr)


# spelling ----------------------------------------------------------------------------------------------------------------------
def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute_groups(v: dict[str, int]):
    near = {w: [x for x in v if one_edit(w, x)] for w in v}
    best = {w: min(n, key=lambda x: (-v[x], x)) for w, n in near.items() if n}
    form = {w: b for w, b in best.items() if v[b] >= 5 * v[w]}
    out = set()
    for w in v:
        r = w
        while r in form:
            r = form[r]
        out.add((w, form.get(w), r, v[w], len(near[w]), v[form[w]] if w in form else None))
    return out


def test_neighbourhood_is_complete_and_without_repeats():
    r = random.Random(3)
    for _ in range(60):
        n = r.randint(0, 9)
        w = [r.randint(1, 3) for _ in range(n)]
        sym = np.array([w], np.uint64).reshape(1, n)
        parts = [spelling.neighbours(sym, lo, lo + 2)[0] for lo in range(0, n + 1, 2)]
        got = np.concatenate(parts).tolist()
        every = {tuple(w[:i] + w[i + 1:]) for i in range(n)} | {tuple(w[:i] + [s] + w[i + 1:]) for i in range(n) for s in range(1, 7)} | {tuple(w[:i] + [s] + w[i:]) for i in range(n + 1) for s in range(1, 7)}
        every.discard(tuple(w))
        assert sorted(got) == sorted(int(spelling.names(np.array([e], np.uint64).reshape(1, -1))[0]) for e in every)


def test_groups_equal_brute_force(spark):
    r = random.Random(11)
    v = {}
    for _ in range(120):
        w = "".join(r.choice("abcdeéß") for _ in range(r.randint(6, 9)))
        v[w] = r.choice([5, 6, 30, 31, 200, 1200])
        for _ in range(r.randint(0, 5)):
            i = r.randrange(len(w))
            v[r.choice([w[:i] + w[i + 1:], w[:i] + r.choice("abxyÿ") + w[i + 1:], w[:i] + r.choice("abxy") + w[i:]])] = r.choice([5, 5, 6, 30, 150])
    v |= {"q" * 4000: 7, "q" * 4001: 90, "": 9, "a": 9, "中文": 8, "中文\U0001F600": 50}
    rows = [*v.items(), (None, 3)]
    got = spelling.variant_groups(spark.createDataFrame(rows, "word string, n bigint").repartition(3))
    assert {tuple(x) for x in got.collect()} == brute_groups(v)
    twice = spark.createDataFrame([("abcdef", 2), ("abcdef", 3), ("abcdefg", 25)], "word string, n bigint")
    assert {tuple(x) for x in spelling.variant_groups(twice).collect()} == {("abcdef", "abcdefg", "abcdefg", 5, 1, 25), ("abcdefg", None, "abcdefg", 25, 1, None)}
    with pytest.raises(ValueError):
        spelling.variant_groups(twice, dominance=1)


def test_long_chain_of_forms(spark):
    v = {"abcdef" + "x" * i: 5 ** (i + 1) for i in range(12)}
    got = spelling.variant_groups(spark.createDataFrame(list(v.items()), "word string, n bigint"))
    assert {r.root for r in got.collect()} == {"abcdef" + "x" * 11}


def test_vocabulary_of_odd_rows(spark, odd, odd_rows, nothing):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    extra = [(500 + i, "ÄRGER Straße ärger ÄRGER naïve-Café×x " * 9) for i in range(40)]
    rows = [(r[0], r[1]) for r in odd_rows] + extra
    want = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            want[w] += 1
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string"))
    got = spelling.vocabulary(docs, spelling.misspelt())
    assert {(r.word, r.n) for r in got.collect()} == {(w, n) for w, n in want.items() if len(w) >= 6 and n >= 5}
    assert spelling.variant_groups(spelling.vocabulary(nothing)).collect() == []


# conversations -----------------------------------------------------------------------------------------------------------------
def brute_trie(rows):
    conv = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))
    conv = {c: [x[2:] for x in sorted(v)] for c, v in conv.items()}
    made = {}
    for c in conv:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = conv.get(c - c % 5, [])[:h] + conv[c][h:]
    member, kids, total, out = defaultdict(list), defaultdict(list), {}, []
    for c, v in made.items():
        for d in range(len(v) + 1):
            member[tuple(v[:d])].append(c)
    for n in member:
        if n:
            kids[n[:-1]].append(n)
    for n in sorted(member, key=len, reverse=True):
        own = (len(member[n]) - 1) * len(n[-1][1].encode()) if n else 0
        total[n] = (sum(total[k][0] for k in kids[n]) or 1, own + sum(total[k][1] for k in kids[n]))
        ends = ",".join(str(c) for c in sorted(member[n]) if len(made[c]) == len(n))
        out.append((min(member[n]), len(n), min(member[n[:-1]]) if n else None, len(member[n]), len(kids[n]), *total[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def turn_rows():
    r = random.Random(2)
    rows = []
    for c in [*range(60), *range(100, 130, 3)]:
        for t in range(r.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, t, r.choice(["user", "bot"]), r.choice(["Hi", "größe", "", "one two"])))
    rows += [(200, None, "user", "null turn"), (200, 0, None, None), (200, 0, None, None), (200, 3, "", ""), (201, None, None, "x"), (None, 0, "user", "lost"), (202, 5, "b", "tie"), (202, 5, "a", "tie"), (202, 5, "a", "sit")]
    rows += [(205, i, "user", "long") for i in range(150)] + [(206, i, "user", "y" * 50_000) for i in range(12)]
    return [(*x, 1, "x") for x in rows]


@pytest.mark.parametrize("heavy, queue", [(10_000, 200_000), (6, 2), (1, 1)])
def test_trie_equals_brute_force(spark, turn_rows, heavy, queue):
    turns = trie.ordered_turns(spark.createDataFrame(turn_rows, TURNS).repartition(5))
    members = turns.select("conv_id").distinct()
    got = trie.prefix_trie(trie.rebuilt(turns, members), members, heavy, queue)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute_trie(turn_rows)


def test_spilling_queue_gives_back_in_order():
    r = random.Random(1)
    q, want = trie.SpillingQueue(3), defaultdict(list)
    for k in range(20):
        for _ in range(r.randint(0, 9)):
            m = ((r.randint(k + 1, 22),), r.randint(0, 5))
            want[m[0]].append(m)
            q.put(m)
        assert sorted(q.take((k,))) == sorted(want.pop((k,), []))
    q.close()


def test_trie_without_turns(spark):
    nobody = spark.createDataFrame([], TURNS)
    turns = trie.ordered_turns(nobody)
    assert trie.prefix_trie(turns, turns.select("conv_id").distinct()).collect() == []
    bare = spark.createDataFrame([(7,), (3,)], "conv_id bigint")
    assert [tuple(x) for x in trie.prefix_trie(turns, bare).collect()] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,7").hexdigest())]
