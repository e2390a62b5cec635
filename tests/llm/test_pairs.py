"""Similarity joins, line dedup, vectors, segmentations and the pipeline against brute force."""

import bisect
import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulseloom.llm import components, hnsw, line_dedup, mixing, ngram_join, quality, segments, vector_dedup
from pulseloom.llm import textvec as tv

SF = "/root/testdata/sf0.001"
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 40_000), (5, "a few words"), (5, "a few words"), (6, "a few words"), (7, "A FEW words"), (8, "two words")]


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_join(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    parent = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * (x := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - x):
                ra, rb = find(parent, a), find(parent, b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(parent, i)) for i in ids}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_join(spark, n, percent):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(400)]
    rows = list(EDGES)
    for base in range(25):  # chains of ever farther copies, around the threshold
        words = list(rng.choice(vocab, int(rng.integers(5, 400))))
        for copy in range(12):
            rows.append((100 + base * 20 + copy, " ".join(words)))
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(0, len(words)))] = str(rng.choice(vocab))
    rows += [(r["doc_id"] + 10_000, r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, id string, n int, key string")
    got = ngram_join.join(df, n=n, percent=percent).collect()
    assert len(got) == len(rows)
    want = brute_join(rows, n, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert ngram_join.join(df.limit(0), n=n, percent=percent).count() == 0


def test_parts_exceed_differences():
    for percent in (80, 90):
        for high in ngram_join.bands(percent)[:60]:
            m, d = ngram_join.parts(high, percent), ngram_join.differences(high, percent)
            assert d < m <= 4 * (d + 1) if d else m == 0
            assert high < 100 or m < 1.4 * (d + 1)


def built_pair(rng, common, one, two, m, filled):
    """Two sets with `common` elements in both and others in one only, all in `filled` of m parts, of
    which as many as there are others are unequal."""
    def of_part(p, n):
        low, high = -(-(p << 32) // m), -(-((p + 1) << 32) // m)
        return [(rng.randrange(low, high) << 32) | rng.getrandbits(32) for _ in range(n)]

    places = rng.sample(range(m), filled)
    both = [h for i in range(common) for h in of_part(places[i % filled], 1)]
    others = [of_part(places[i % filled], 1)[0] for i in range(one + two)]
    return (np.unique(np.array(both + o, np.uint64)) for o in (others[:one], others[one:]))


def test_no_link_is_missed_where_equal_parts_are_empty():
    """Pairs right at the threshold, of which every part that is not empty is unequal."""
    rng, alone = random.Random(6), 0
    for percent in (80, 90):
        edges = ngram_join.bands(percent)
        for union in [*range(10, 120), 150, 200, 333, 500, 1000, 1999]:
            most = union - -(-union * percent // 100)  # differences of a linked pair with this union
            for one in {0, most // 2, most}:
                sizes = sorted((union - most + one, union - one))
                m = ngram_join.parts(edges[bisect.bisect_left(edges, sizes[1])], percent)
                if not most or not m:
                    continue
                x, y = built_pair(rng, union - most, one, most - one, m, min(most, m))
                assert 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y))
                keys = [set(ngram_join.tile_keys(s, percent, edges).tolist()) for s in (x, y)]
                assert keys[0] & keys[1], (percent, union, one)
                alone += all(len(s) for s in keys)
    assert alone > 300


def test_few_sets_name_tiles_for_empty_parts():
    rng = np.random.default_rng(3)
    for percent, n in ((80, 60), (80, 200), (90, 60), (90, 400)):
        edges, more = ngram_join.bands(percent), 0
        for _ in range(400):
            s = np.sort(hashes(rng, n))
            m = ngram_join.parts(edges[bisect.bisect_left(edges, n)], percent)
            part = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            more += len(np.unique(part)) <= min(ngram_join.differences(edges[bisect.bisect_left(edges, n)], percent), n * (100 - percent) // percent)
        assert more <= 1


def hashes(rng, n):
    return tv.mix(rng.integers(0, 2**63, n).astype(np.uint64))


def test_members_are_exact():
    """Bounds never rule a link out, and links are those of the sets."""
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(60):
        both = hashes(rng, 60)
        sets += [np.concatenate([both, hashes(rng, int(rng.integers(0, 20)))]), np.concatenate([both, both[:5], hashes(rng, int(rng.integers(0, 30)))])]
    sets += [np.zeros(0, np.uint64), hashes(rng, 3000)]
    m = ngram_join.Members(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), 80)
    p, q = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    plain = [set(s.tolist()) for s in sets]
    want = np.array([len(plain[a] & plain[b]) > 0 and 100 * len(plain[a] & plain[b]) >= 80 * len(plain[a] | plain[b]) for a, b in zip(p, q, strict=True)])
    assert (m.linked(p, q) == want).all() and (m.possible(p, q)[want] >= 0).all() and 60 < want.sum()
    assert m.n.tolist() == [len(s) for s in plain]


def test_join_at_the_threshold(spark):
    """Sets of some 2,000 shingles right at, and right below, the threshold."""
    rng = np.random.default_rng(8)
    rows = []
    for group in range(12):
        words = [f"{group}x{i}" for i in range(2002)]
        rows.append((group * 10, " ".join(words)))
        for j, changes in enumerate((35, 36)):  # 3 shingles each: 1895 of 2105 (0.9002), 1892 of 2108 (0.8975)
            other = list(words)
            for k in rng.choice(np.arange(10, 1990, 4), changes, replace=False):
                other[k] = f"{group}y{k}"
            rows.append((group * 10 + 1 + 4 * j, " ".join(other)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_join(rows, 3, 90)
    assert sum(i != c for i, (_, c) in want.items()) >= 12
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, n=3, percent=90).collect()} == want


def brute_rows(rows, n, percent):
    """As brute_join, each row a document of its own; (id, n_shingles, component_id) of each."""
    found = brute_join(list(enumerate(t for _, t in rows)), n, percent)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            c = found[k][1]
            least[c] = min(i, least.get(c, i))
    return [(i, found[k][0], least.get(found[k][1])) for k, (i, _) in enumerate(rows)]


def near_copies(rng, n, size, changes):
    words = [f"v{i}" for i in range(size)]
    out = []
    for _ in range(n):
        w = list(words)
        for k in rng.choice(size, changes, replace=False):
            w[k] = f"r{rng.integers(0, 10**9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("bounds", [{"BLOCK": 6, "HOT_ROWS": 5, "MAX_BROADCAST_ROWS": 0}, {"BLOCK_BYTES": 3000, "FEW": 2, "MAX_BROADCAST_ROWS": 0}])
def test_join_rows(spark, monkeypatch, bounds):
    """Null ids, ids with several texts, large tiles, hot keys, and no broadcasts."""
    for k, v in bounds.items():
        monkeypatch.setattr(ngram_join, k, v)
    rng = np.random.default_rng(9)
    rows = [(i, t) for i, t in enumerate(near_copies(rng, 60, 80, 2))] + [(200 + i, t) for i, t in enumerate(near_copies(rng, 40, 40, 1))]
    rows += [(None, "all alone here with no copy"), (None, rows[5][1]), (7, rows[70][1]), (7, "short"), (7, "short"), (8, "short"), (None, None), (None, ""), (None, "two rows without id"), (None, "two rows without id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.join(df, n=3, percent=80).collect()
    want = brute_rows(rows, 3, 80)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(want, key=key)
    assert sum(r["kept"] for r in got) == len({c for _, c in brute_join(list(enumerate(t for _, t in rows)), 3, 80).values()})


def test_tile_of_many_near_copies(spark):
    """A tile of 5,000 distinct near copies loses no link and gives no more rows than members."""
    rng = np.random.default_rng(10)
    texts = near_copies(rng, 5000, 60, 1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = ngram_join.join(df, n=3, percent=80).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1
    h = np.concatenate([np.concatenate([np.arange(50), 1000 + 10 * i + np.arange(3)]) for i in range(300)]).astype(np.uint64)
    rows = spark.createDataFrame([(1, 0, 1, i, i, i % 2, h[53 * i : 53 * i + 53].tobytes()) for i in range(300)], "key long, i int, j int, id long, component long, own int, s binary")
    links = ngram_join.forest(rows, ["key", "i", "j"], 80, ngram_join.as_hashes)
    assert 0 < links.count() < 300


def test_components(spark, monkeypatch):
    monkeypatch.setattr(components, "CHUNK_EDGES", 50)
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 900, (600, 2))] + [(i, i + 1) for i in range(2000, 2150)] + [(5000, 5000 + i) for i in range(1, 300)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        ra, rb = find(parent, a), find(parent, b)
        parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["component"] for r in components.components(df).collect()} == {x: find(parent, x) for x in parent}
    assert components.components(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark, monkeypatch):
    """Rounds grow with the logarithm of the chunks."""
    monkeypatch.setattr(components, "CHUNK_EDGES", 400)
    n, log = 20_000, []
    got = components.components(spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), log=log)
    assert got.count() == n + 1 and got.filter("component <> 0").isEmpty()
    assert len(log) < 15 and all(b <= 0.75 * a for a, b in zip(log[1:], log[2:], strict=False))


def test_words_and_ngrams():
    import pyarrow as pa

    texts = ["a b  c", None, "", "X\x0bx\x1cy z", "é b c"]
    for _, _, data, off in tv.chunks(pa.array(texts)):
        starts, ends, edges = tv.tokens(data, off)
        got = [[data[a:b].tobytes() for a, b in zip(starts[edges[i] : edges[i + 1]], ends[edges[i] : edges[i + 1]], strict=True)] for i in range(len(texts))]
        assert got == [(t or "").encode().split() for t in texts]
        h = tv.hash_spans(tv.prefix_sums(data), starts, ends)
        assert [int(b - a) for a, b in zip(tv.ngrams(h, edges, 3)[1][:-1], tv.ngrams(h, edges, 3)[1][1:], strict=True)] == [1, 0, 0, 1, 1]


def brute_lines(rows, k, percent, least):
    first = {}
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        for p, line in enumerate(t.split("\n")):
            if len(line.split()) >= least:
                first.setdefault(line.strip(" \t\r\v\f"), []).append((i, p))
    lines = list(first)
    sets = [{x.lower()[j : j + k] for j in range(max(1, len(x) - k + 1))} for x in lines]
    parent = dict(enumerate(range(len(lines))))
    for a in range(len(lines)):
        for b in range(a):
            x = len(sets[a] & sets[b])
            if 100 * x >= percent * (len(sets[a]) + len(sets[b]) - x):
                ra, rb = find(parent, a), find(parent, b)
                parent[max(ra, rb)] = min(ra, rb)
    groups = collections.defaultdict(set)
    for a, x in enumerate(lines):
        groups[find(parent, a)] |= set(first[x])
    return {p for g in groups.values() for p in g if p != min(g)}


def test_lines(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(1000 + i, f"{'common header line of the site'}\nunique words number {i} {i * 7}\n\n") for i in range(40)] + [(2000, None), (2001, ""), (2002, "ab\nab\nab")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, n_lines string, keys string")
    want = brute_lines(rows, line_dedup.SHINGLE, line_dedup.PERCENT, line_dedup.MIN_WORDS)
    texts, lost, missed = dict(rows), 0, 0
    got = line_dedup.dedup(df).collect()
    assert len(got) == len(rows)
    for r in got:
        t = texts[r["doc_id"]]
        if t is None:
            assert r["text"] is None
            continue
        gone = {p for i, p in want if i == r["doc_id"]}
        lost += len(gone)
        left = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)
        missed += len(gone) - r["n_dropped"] if r["text"] != left else 0
        assert set(r["text"].split("\n")) - {""} <= set(t.split("\n"))
    assert lost > 100 and missed <= 0.02 * lost  # banding is a high-recall filter
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_repeated_line_stays_once(spark):
    df = spark.createDataFrame([(i, "one and the same line here") for i in (5, 3, 9, 3)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"] != "") for r in line_dedup.dedup(df).collect()) == [(3, True), (3, True), (5, False), (9, False)]


def test_lines_of_rows(spark, monkeypatch):
    """Null ids, ids with several texts, very long lines, and no broadcasts: no unique line goes."""
    same = "the very same shared line here"
    rows = [(1, same), (2, same), (2, "unique content nobody else has written"), (None, same), (None, "a line of a row without an id"), (None, None), (3, "x" * 300_000 + "\n" + same), (4, "x" * 300_001), (5, same), (5, same)]
    df = spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, k string")
    want = collections.Counter([(1, same), (2, ""), (2, rows[2][1]), (None, ""), (None, rows[4][1]), (None, None), (3, "x" * 300_000), (4, ""), (5, ""), (5, "")])
    for bound in (line_dedup.MAX_BROADCAST_ROWS, 0):
        monkeypatch.setattr(line_dedup, "MAX_BROADCAST_ROWS", bound)
        monkeypatch.setattr(line_dedup, "MAX_BROADCAST_PLACES", bound)
        got = collections.Counter((r["doc_id"], r["text"]) for r in line_dedup.dedup(df).collect())
        assert got == want


def test_short_and_unspaced_lines(spark):
    """Lines of one or two words, of any length, are removed like others."""
    unspaced = "同じ文章が何度も繰り返されるので一つだけ残す必要がある長い行です"
    url = "https://example.org/a/long/path/without/any/space/index.html?id=4711"
    texts = ["Of.\nAnd ornd.\nkept one here", f"of.\n{unspaced}\nkept two there", f"And ornd.\n{unspaced}。\n{url}", f"{url}&\n \nx\naaaaaaaa", "x\n\naaaaaaaaaaaa\nOf."]
    rows = list(enumerate(texts))
    want = brute_lines(rows, line_dedup.SHINGLE, line_dedup.PERCENT, 1)
    assert want == {(1, 0), (2, 0), (2, 1), (3, 0), (4, 0), (4, 2), (4, 3)}
    left = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in want) for i, t in rows}
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == left
    assert {r["doc_id"]: r["n_dropped"] for r in got} == {0: 0, 1: 1, 2: 2, 3: 1, 4: 3}


BAD = [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [float("inf")] * 8), (904, [None] + [1.0] * 7), (905, [])]


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 8)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + BAD + [(3, x[3].tolist())]
    df = spark.createDataFrame([(i, v, "q") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = collections.defaultdict(list)
    for r in hnsw.nearest(df, df.filter("vec_id % 20 = 0"), k=20, shard_rows=200).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 600, 20):
        s = x.astype(float) @ x[q].astype(float)
        order = [int(i) for i in np.lexsort([np.arange(600), -s]) if i != q][:20]
        assert [r[0] for r in got[q]] == list(range(1, 21)) and all(abs(sc - s[i]) < 1e-9 for _, i, sc in got[q])
        assert got[q] == sorted(got[q], key=lambda r: (-r[2], r[1]))
        hits += len(set(order) & {i for _, i, _ in got[q]})
    assert set(got) == set(range(0, 600, 20)) and hits >= 0.95 * 600
    few = df.filter("vec_id < 5 or vec_id >= 900")
    assert hnsw.nearest(few, few.filter("vec_id = 0"), k=20).count() == 4
    assert hnsw.nearest(df.limit(0), df.limit(0)).count() == 0


def test_recall_on_small_table(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = hnsw.nearest(v, v.filter("vec_id % 20 = 0"), k=20, shard_rows=700).groupBy("query_id").agg(F.collect_set("vec_id").alias("s")).collect()
    rows = v.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    at = {int(i): k for k, i in enumerate(ids)}
    hits = 0
    for r in got:
        s = x @ x[at[r["query_id"]]]
        s[at[r["query_id"]]] = -9
        hits += len(set(ids[np.lexsort([ids, -s])[:20]].tolist()) & set(r["s"]))
    assert hits >= 0.9 * 20 * len(got)


def test_vector_dedup(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 8))
    x[100:200] = x[0] + 0.05 * rng.standard_normal((100, 8))  # a cluster larger than the first lists
    x[200:220] = x[5]
    label = rng.integers(0, 2, 300)
    rows = [(int(i), [float(np.float32(c)) for c in v], int(b)) for i, (v, b) in enumerate(zip(x, label, strict=True))]
    rows += [(i, v, 0) for i, v in BAD] + [(950, rows[0][1], None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<float>, label int, component string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.dedup(df, cell=64).collect()}
    u = np.array([r[1] for r in rows[:300]])
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = (u @ u.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    parent = {r[0]: r[0] for r in rows}
    for a, b in zip(*np.nonzero(link), strict=True):
        ra, rb = find(parent, int(a)), find(parent, int(b))
        parent[max(ra, rb)] = min(ra, rb)
    want = {r[0]: (int(link[r[0]].sum()) if r[0] < 300 else 0, find(parent, r[0]), find(parent, r[0]) == r[0]) for r in rows}
    assert got == want
    assert vector_dedup.dedup(df.limit(0)).count() == 0


def brute_vectors(x, label, cosine=0.93):
    """(links, component) of each row."""
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = (u @ u.T >= cosine) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    parent = {i: i for i in range(len(x))}
    for a, b in zip(*np.nonzero(link), strict=True):
        ra, rb = find(parent, int(a)), find(parent, int(b))
        parent[max(ra, rb)] = min(ra, rb)
    return {i: (int(link[i].sum()), find(parent, i)) for i in parent}


def vectors_frame(spark, x, label):
    return spark.createDataFrame([(i, [float(c) for c in v], int(b)) for i, (v, b) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")


def test_vector_lobes_are_joined(spark):
    """Two lobes whose cross links are in no vector's 64 best."""
    rng = np.random.default_rng(6)
    e = np.eye(64)
    x = np.concatenate([c + 0.0125 * rng.standard_normal((300, 64)) for c in (e[0], 0.95 * e[0] + (1 - 0.95**2) ** 0.5 * e[1])])
    label = np.zeros(600, int)
    want = brute_vectors(x, label)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    best = np.argsort(-(u @ u.T), axis=1)[:, 1:65]
    assert ((best < 300) == (np.arange(600) < 300)[:, None]).all() and sum((u[:300] @ u[300:].T >= 0.93).ravel()) > 50_000
    got = vector_dedup.dedup(vectors_frame(spark, x, label), cell=50, block=100).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want and sum(r["kept"] for r in got) == 1


def test_rare_vector_links_are_all_found(spark):
    """Few pairs right above the threshold among many rows; results do not depend on seed or cells."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(40):  # partners at cosine 0.932
        d = rng.standard_normal(64)
        d -= (d @ x[i]) * x[i]
        x[2000 + i] = 0.932 * x[i] + (1 - 0.932**2) ** 0.5 * d / np.linalg.norm(d)
    label = np.zeros(3000, int)
    want = brute_vectors(x, label)
    assert sum(n for n, _ in want.values()) == 80
    df = vectors_frame(spark, x, label)
    got = vector_dedup.dedup(df, cell=8, seed=5).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want


def split(vocab, text, keys, k):
    data = np.frombuffer((b" " + text.encode()) * len(keys), np.uint8)
    off = np.arange(len(keys) + 1) * (len(text.encode()) + 1)
    got = segments.sample_texts(vocab, data, off, keys, k)
    return [(t, s, logp, g, inc, tuple(vocab.pieces[i] for i in segments.ids_of(vocab, lat, e))) for t, s, logp, g, inc, e, lat in got]


def all_segmentations(vocab, text):
    pieces = {p: i for i, p in enumerate(vocab.pieces) if p and vocab.byte_ids[p[0]] != i and b" " not in p.lstrip(b" ")}
    done = []

    def go(rest, path, w):
        if not rest:
            done.append((path, w))
        for n in range(1, len(rest) + 1):
            if rest[:n] in pieces and not (b" " in rest[1:n]):
                go(rest[n:], (*path, rest[:n]), w + vocab.weight[pieces[rest[:n]]])

    go(b" " + text.encode(), (), 0.0)
    total = np.logaddexp.reduce([w for _, w in done])
    return {p: w - total for p, w in done}


def test_segmentation_distribution():
    vocab = segments.Vocabulary.load(segments.MODEL)
    want = all_segmentations(vocab, "the cat")
    n, k = 3000, 3
    got = split(vocab, "the cat", np.arange(n, dtype=np.uint64), k)
    assert all(abs(want[p] - logp) < 1e-5 for _, _, logp, _, _, p in got)
    first = collections.Counter(p for _, s, *_, p in got if s == 1)
    for p, logp in want.items():
        assert abs(first[p] / n - np.exp(logp)) < 5 * np.sqrt(0.25 / n)
    by = collections.defaultdict(list)
    for g in got:
        by[g[0]].append(g)
    assert all(len({g[5] for g in v}) == k and [g[3] for g in v] == sorted((g[3] for g in v), reverse=True) for v in by.values())
    # inclusion scores make sums over samples unbiased
    for p in sorted(want, key=want.get)[-3:]:
        est = np.mean([sum(np.exp(g[2]) / g[4] for g in v if g[5] == p) for v in by.values()])
        assert abs(est - np.exp(want[p])) < 0.02


def test_segmentation_is_exhausted():
    vocab = segments.Vocabulary.load(segments.MODEL)
    want = all_segmentations(vocab, "ab c")
    got = split(vocab, "ab c", np.arange(3, dtype=np.uint64), len(want) + 5)
    for t in range(3):
        mine = [g for g in got if g[0] == t]
        assert {g[5] for g in mine} == set(want) and len(mine) == len(want) and all(g[4] == 1.0 for g in mine)


def test_encode_and_decode(spark):
    texts = [None, "", " ", "é😀 \n\t x", "a  b   c", "▁literal", "x" * 3000, "word " * 20_000, "同じ 文字", "\x00\x7f"]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, ids string, sample string")
    enc = segments.encode(df, samples=3)
    got = segments.decode(enc).collect()
    assert all(r["text"] == texts[r["doc_id"]] for r in got)
    n = collections.Counter(r["doc_id"] for r in got)
    assert n[0] == n[1] == 0 and all(n[i] >= 1 for i in range(2, len(texts))) and n[7] == 3
    again = segments.encode(df.repartition(5), samples=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, enc.collect()))
    assert segments.encode(df.limit(0)).count() == 0


def test_lattices_of_words_that_come_again_are_kept(monkeypatch):
    """A task's later texts find the lattices of earlier words, with the same samples as without."""
    vocab = segments.Vocabulary.load(segments.MODEL)
    plain, built = segments.Lattice._add, []
    monkeypatch.setattr(segments.Lattice, "_add", lambda self, text, starts, size: built.append(int(size.sum())) or plain(self, text, starts, size))
    first = " the cat and the dog sat on the mat of the house near the long road"
    texts = [first, first, first + " with a bird", " одни другие слова ü😀", " one", first + first, " " + "x" * 300, first]

    def sampled(lat):
        out, bytes_ = [], []
        for n, text in enumerate(texts):
            built.clear()
            data = np.frombuffer(text.encode(), np.uint8)
            got = segments.sample_texts(vocab, data, np.array([0, len(data)]), np.array([n], np.uint64), 4, lat and lat())
            out.append([(*g[1:5], segments.ids_of(vocab, g[6], g[5]).tolist()) for g in got])
            bytes_.append(sum(built))
        return out, bytes_

    want, every = sampled(None)
    assert all(len(g) == 4 for g in want) and min(every) > 0
    for keep in (0, 30, 1 << 20):
        lat = segments.Lattice(vocab, keep)
        got, new = sampled(lambda lat=lat: lat)
        assert got == want and lat.stay[0] <= keep
        if keep == 0:
            assert new == every
        elif keep == 30:
            assert 0 < new[1] < every[1] and lat.bytes > keep
        else:  # all words are known, then two are not, then all are of another text
            assert new[:4] == [every[0], 0, len(" with a bird"), every[3]]


def test_segmentations_do_not_depend_on_chunks(spark):
    words = [f"{a}{b}" for a in ("under", "over", "Ü", "x9") for b in ("stand", "look", "\n", "ü", "s")]
    texts = [" ".join(words[(i * j) % len(words)] for j in range(1, 3 + i % 40)) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = sorted(map(str, segments.encode(df, samples=3).collect()))
    assert len(want) == 180
    for chunk, kept in ((1, 50), (700, 0), (700, 120), (1 << 20, 10)):
        assert sorted(map(str, segments.encode(df, samples=3, chunk=chunk, kept=kept).collect())) == want


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        seen.append(docs.count())
        if name != names[-1]:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert 0 < seen[2] <= seen[1] <= seen[0] <= 200
    assert corpus_pipeline.run(spark, SF).count() == seen[-1]


ODD = [
    (1, None, "en", None, None), (1, None, "en", None, None), (2, "", None, "s", 0), (3, "some words of text " * 9, "en", "s", 1), (None, "a text without an id " * 5, "en", "s", 2),
    (None, "another text without an id, longer by some words, that nobody repeats", "en", None, 3), (4, "a text that repeats as a whole row and so is there once", "en", "s", 4), (4, "a text that repeats as a whole row and so is there once", "en", "s", 4),
    (4, "quite another text under an id that has been used before, and longer", "de", "t", 5), (5, "z" * 200_000 + " " + "long words go on and on " * 9_000, "en", "t", 6),
]


def test_pipeline_stages_by_row(spark):
    """Null and repeated ids, very long texts and empty tables, stage by stage."""
    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda d: collections.Counter(tuple(r) for r in d.collect())
    assert rows(stages["quality"](spark, odd, SF)) <= collections.Counter(ODD)
    lines = rows(stages["lines"](spark, odd, SF))
    assert sum(lines.values()) == len(ODD) and {(i, t) for i, t, *_ in lines} == {(i, t) for i, t, *_ in ODD}
    assert rows(stages["near_duplicates"](spark, odd, SF)) == collections.Counter(ODD) - collections.Counter([ODD[6]])
    mixed = rows(stages["mix"](spark, odd, SF))
    assert set(mixed) <= set(ODD) and not any(t in (None, "") for _, t, *_ in mixed) and sum(mixed.values()) > 5
    assert mixed == rows(stages["mix"](spark, odd.repartition(3), SF)) and mixed[ODD[6]] <= 4
    assert stages["pieces"](spark, odd, SF).select("doc_id").distinct().count() == 4  # 3, null, 4 and 5 have texts
    none = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0


def test_pipeline_decisions(spark):
    """Each stage does what its operator says, row by row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.filter("doc_id % 9 = 0").withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") + 1))).cache()
    stages = dict(corpus_pipeline.STAGES)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = brute_join(list(enumerate(t for _, t in texts)), corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILARITY)
    groups = collections.defaultdict(list)
    for k, (n, c) in found.items():
        groups[c if n else (c, k)].append(texts[k])
    first = lambda g: min(g, key=lambda r: (r[0] is None, r[0] or 0))
    want = collections.Counter(first(g)[0] for g in groups.values())
    got = stages["near_duplicates"](spark, docs, SF).collect()
    assert collections.Counter(r["doc_id"] for r in got) == want
    judged = quality.resample(docs, spark.read.parquet(f"{SF}/labels.parquet"), key=corpus_pipeline._key()).filter("kept")
    assert stages["quality"](spark, docs, SF).count() == judged.count() < len(texts)
    mixed = stages["mix"](spark, docs, SF)
    size = mixed.select(mixing.n_words(F.col("text")).alias("n"), "source").groupBy("source").agg(F.sum("n").alias("n"))
    goal = {r["source"]: r["target"] for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    assert all(abs(r["n"] - goal[r["source"]]) < 0.35 * goal[r["source"]] for r in size.collect())


def test_descent_finds_links(spark):
    """NN-descent by itself finds nearly all links of clusters that its lists can hold, and says so."""
    rng = np.random.default_rng(11)
    centre = rng.standard_normal((60, 24))
    x = np.concatenate([c + 0.12 * rng.standard_normal((10, 24)) for c in centre])
    label = np.zeros(len(x), int)
    df = vectors_frame(spark, x, label).select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    lists, log = vector_dedup.descent(vector_dedup.as_units(df), k=4, cell=32)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero((u @ u.T >= 0.93) & ~np.eye(len(x), dtype=bool)), strict=True)}
    got = {(r["a"], r["b"]) for r in lists.filter("s >= 0.93").collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and log[-1]["list"] > 4 and log[-1]["recall"] >= 0.9


def test_vectors_of_unequal_lengths(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0, 0.0], 0), (3, [2.0, 0.0], 0), (4, [1.0, 0.0], 1), (3, [0.0, 1.0], 0), (None, [1.0, 0.0], 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (0, 4, True), None: (0, None, True)}  # of id 3 the least vector counts


def test_tile_keys_go_before_sets_come(spark, monkeypatch):
    """The table of keys, as large as the input, and the tables of sets do not lie on disk at once."""
    import os

    there = lambda: {d.rsplit("-", 1)[0] for d in os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))}
    before, seen, real = there(), [], ngram_join.links

    def spy(*a, **k):
        seen.append(there())
        return real(*a, **k)

    monkeypatch.setattr(ngram_join, "links", spy)
    base = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(1, base), (2, base + " x"), (3, "a b c d e f g"), (4, base + " x")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.join(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}
    assert seen and "arrays" in seen[0] and "sets" not in seen[0] - before


@pytest.mark.parametrize("most", [500_000, 0])
def test_few_pairs_move_their_own_sets_only(spark, monkeypatch, most):
    """Sets that no pair names are not shuffled, if pairs are few; links are the same either way."""
    monkeypatch.setattr(ngram_join, "MAX_BROADCAST_ROWS", most)
    sets = [list(range(10)), list(range(9)), list(range(100, 110)), *([k] for k in range(1000, 3000))]
    have = spark.createDataFrame([(i, bytearray(np.array(s, np.uint64).tobytes())) for i, s in enumerate(sets)], "id long, s binary")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 2)], "a long, b long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ngram_join.verified(pairs, have, 80, ngram_join.as_hashes)
        assert [tuple(r) for r in got.collect()] == [(0, 1)]
        plan = got._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("strategy=broadcast") == (2 if most else 0)


def shuffled_rows(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    jvm = sc._jvm
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))


@pytest.mark.parametrize("bounds", [{}, {"DEALT_ROWS": 700, "HELD_ROWS": 5000}, {"HOT_ROWS": 30}])
def test_tile_keys_are_shuffled_many_in_a_row(spark, monkeypatch, bounds):
    """Members of tiles are those of a plain grouping, and keys do not make a row of a shuffle each."""
    for k, v in bounds.items():
        monkeypatch.setattr(ngram_join, k, v)
    rng = np.random.default_rng(21)
    few = tv.mix(np.arange(300))  # keys of several ids, one of them of very many
    rows = [(i, np.concatenate([tv.mix(np.arange(15) + 1000 * (i + 1)), few[rng.integers(300, size=1)], few[:1] if i % 20 == 0 else few[:0]])) for i in range(2000)]
    rows += rows[:50]  # rows that repeat count once
    want = collections.defaultdict(set)
    for i, keys in rows:
        for k in keys.view(np.int64).tolist():
            want[k].add(i)
    keyed = spark.createDataFrame([(i, bytearray(k.tobytes())) for i, k in rows] + [(9999, bytearray()), (9998, None)], "id long, keys binary").coalesce(4).cache()
    assert keyed.count() == len(rows) + 2
    before = shuffled_rows(spark)
    got = sorted(map(tuple, ngram_join.tiles(keyed).collect()))
    written = shuffled_rows(spark) - before
    assert got == sorted((k, i, min(v)) for k, v in want.items() if len(v) > 1 for i in v)
    if "HOT_ROWS" not in bounds:
        # beside counts by bucket
        assert written < 4 * ngram_join.KEY_BUCKETS + 4 * 50 < len(rows) * 16


def test_ranks():
    """Equal numbers for equal hashes only, also where unequal ones have all their high bits in common."""
    rng = np.random.default_rng(22)
    for h in (np.zeros(0, np.uint64), tv.mix(np.arange(5000) % 700), tv.mix(np.arange(50))[rng.integers(50, size=900)] & ~np.uint64(1) | rng.integers(2, size=900).astype(np.uint64), np.array([7] * 9, np.uint64)):
        r = ngram_join.ranks(h)
        assert len(set(zip(h.tolist(), r.tolist(), strict=True))) == len(set(h.tolist())) == len(set(r.tolist()))
        assert not len(h) or 0 <= r.min() <= r.max() < len(h)
