import numpy as np
import pytest

from graphstrata.llm import jaccard, mixing, neighbours
from graphstrata.llm.skew import join_counted

# ---------------------------------------------------------------- jaccard


def brute_components(docs):
    sets = []
    for _, t in docs:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\n", " ").split(" ") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (d, _) in enumerate(docs):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(s), low[root(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True)))


def near_copies(seed, groups, copies, words, edits):
    rng, docs = np.random.default_rng(seed), []
    for _ in range(groups):
        base = [f"w{rng.integers(0, 500)}" for _ in range(int(rng.integers(8, words)))]
        for _ in range(copies):
            t = list(base)
            for _ in range(int(rng.integers(0, edits))):
                t[int(rng.integers(0, len(t)))] = f"e{rng.integers(0, 10**6)}"
            docs.append((int(rng.integers(0, 10**9)), " ".join(t)))
    return docs


@pytest.mark.parametrize(("seed", "groups", "copies", "words", "edits"), [(1, 12, 6, 120, 5), (2, 1, 60, 300, 12), (3, 20, 3, 12, 2)])
def test_near_duplicates(spark, seed, groups, copies, words, edits):
    docs = near_copies(seed, groups, copies, words, edits)
    passage = " ".join(f"p{i}" for i in range(60))
    docs += [(10**9 + i, f"{passage} " + " ".join(f"own{i}x{j}" for j in range(90))) for i in range(20)]
    docs += [(5, None), (6, ""), (6, ""), (7, "two words"), (8, "Two  WORDS\n"), (9, "a b c d e"), (9, "a b c d e"), (9, "quite another text of more than five words"), (3, "a b c d e")]
    got = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(docs)


@pytest.mark.parametrize("how", ["blocks", "filter", "components"])
def test_every_way_gives_the_same(spark, monkeypatch, how):
    """Small parts and blocks with many visitors and slices; the Bloom filter instead of a broadcast; components by rounds."""
    for name, value in {"blocks": {"_TILE_ROWS": 8, "_BLOCK_ROWS": 4, "_BLOCK_SHINGLES": 600, "_ROW_WEIGHT": 50}, "filter": {"_BROADCAST_IDS": 0}, "components": {"_ONE_TASK_LINKS": 0}}[how].items():
        monkeypatch.setattr(jaccard, name, value)
    docs = near_copies(4, 4, 25, 80, 9)
    passage = " ".join(f"p{i}" for i in range(60))
    docs += [(10**9 + i, f"{passage} " + " ".join(f"own{i}x{j}" for j in range(int(12 + i % 3)))) for i in range(40)]
    got = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(docs)


def test_a_large_group_of_near_copies(spark):
    rng, base = np.random.default_rng(21), [f"w{i}" for i in range(120)]
    docs = []
    for i in range(5000):
        t = list(base)
        for _ in range(2):
            t[int(rng.integers(0, 120))] = f"e{i}x{rng.integers(0, 10**6)}"
        docs.append((i, " ".join(t)))
    got = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    # two edits change ten shingles of 116 at most, so any two have 96 of 136 in common at least, and all link with those that share an edit's place
    assert len(got) == 5000 and {r["component_id"] for r in got} == {0}


def test_a_large_group_of_templates_that_do_not_link(spark):
    # 78 shingles of a common text and 11 of their own: 78 / 100 between any two
    shared = " ".join(f"t{i}" for i in range(82))
    docs = [(i, shared + " " + " ".join(f"o{i}x{j}" for j in range(11))) for i in range(5000)]
    got = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r["component_id"] == r["doc_id"] and r["n_shingles"] == 89 for r in got) and len(got) == 5000


def test_very_long_texts(spark):
    words = [f"w{i}" for i in range(70_000)]
    part = lambda k: " ".join(words[:k] + [f"x{k}y{i}" for i in range(70_000 - k)])
    # with the first: 61996 of 78000 shingles, just under four fifths, and 62996 of 77000, just over
    docs = [(3, " ".join(words)), (2, part(62_000)), (1, part(63_000)), (4, "short")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {3: (69_996, 1), 2: (69_996, 2), 1: (69_996, 1), 4: (1, 4)}


def test_keep_one(spark):
    docs = spark.createDataFrame([(2, "a b c d e f", 1), (1, "a b c d e f", 2), (3, "x", 3), (4, None, 4), (5, None, 5)], "doc_id long, text string, cls long")
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4, 5]
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_keep_one_tells_rows_apart_that_share_an_id(spark):
    a, b, c, d = "one two three four five six", "sun moon star sky rain snow", "red green blue grey pink teal", "cat dog fox hen cow pig"
    near = " ".join(f"w{i}" for i in range(60))
    rows = [
        (3, b), (5, b), (5, a),  # 5 is a copy of 3 in one row only
        (1, c), (1, c), (None, c), (None, d), (None, d),  # exact repeats, and null ids with and without a smaller one
        (7, near), (7, near + " end"), (8, near),  # near copies of one id
        (9, None), (9, None), (None, ""),
    ]
    out = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert [r for r in got if r[0] != 7] == sorted([(3, b), (5, a), (1, c), (None, d), (9, None), (9, None), (None, "")], key=str)
    assert len([r for r in got if r[0] == 7]) == 1


def test_bitmaps_never_hide_an_overlap():
    rng = np.random.default_rng(5)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, int(rng.integers(1, 700)))) for _ in range(2))
        bits = jaccard.bits_of(min(len(a), len(b)))
        x, y = (np.frombuffer(jaccard.bitmap_of(s, bits), np.uint8) for s in (a, b))
        assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - int(np.bitwise_count(x ^ y).sum())) // 2
        wide = np.frombuffer(jaccard.bitmap_of(a, 2 * bits), np.uint8)
        assert (wide[: len(wide) // 2] ^ wide[len(wide) // 2 :]).tobytes() == x.tobytes()


def test_prefix_meets_every_link():
    rng = np.random.default_rng(6)
    common = np.sort(rng.integers(0, 1 << 63, 50, dtype=np.uint64))
    for _ in range(300):
        own = np.unique(np.concatenate([rng.integers(0, 1 << 63, int(rng.integers(1, 80)), dtype=np.uint64), rng.choice(common, 20)]))
        other = np.unique(np.concatenate([rng.permutation(own)[: int(len(own) * rng.uniform(0.8, 1))], rng.integers(0, 1 << 63, int(rng.integers(0, 8)), dtype=np.uint64)]))
        both = len(np.intersect1d(own, other))
        if 100 * both >= 80 * (len(own) + len(other) - both):
            assert len(np.intersect1d(jaccard.prefix_of(own, common), jaccard.prefix_of(other, common)))


# ---------------------------------------------------------------- mixing


def corpus(spark, n=2000):
    rng = np.random.default_rng(8)
    rows = [(int(i), " ".join(["word"] * int(rng.integers(1, 200))) + (" 1 2 3 4 5 6 7 8 9" * 9 if rng.random() < 0.2 else ""), str(rng.choice(["en", "de"], p=[0.8, 0.2])), f"s{min(int(rng.exponential(2)), 5)}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("cells", [20_000, 2])
def test_margins_are_met(spark, monkeypatch, cells):
    monkeypatch.setattr(mixing, "_COLLECTED_CELLS", cells)
    targets = {"lang": {"en": 0.5, "de": 0.5}}
    rows = mixing.mix(corpus(spark), targets, budget=0.2).toPandas()
    total = rows["weight"].sum()
    assert total == pytest.approx(1)
    assert rows.groupby("lang")["weight"].sum().to_dict() == pytest.approx({"en": 0.5, "de": 0.5}, abs=1e-5)
    assert rows["probability"].between(0, 1).all()
    assert (rows["probability"] * rows["tokens"]).sum() == pytest.approx(0.2 * rows["tokens"].sum(), rel=1e-6)
    kept = rows[rows["kept"]]
    assert kept["tokens"].sum() == pytest.approx(0.2 * rows["tokens"].sum(), rel=0.15)
    assert kept[kept["lang"] == "de"]["tokens"].sum() / kept["tokens"].sum() == pytest.approx(0.5, abs=0.08)


def test_weights_against_plain_raking(spark):
    docs = corpus(spark, 600).toPandas()
    docs["tokens"] = [len(t.split()) for t in docs["text"]]
    rows = mixing.mix(spark.createDataFrame(docs)).toPandas().set_index("doc_id").loc[docs["doc_id"]]
    assert (rows["tokens"].to_numpy() == docs["tokens"].to_numpy()).all()
    cells = rows.reset_index().groupby(["source", "lang", "topic"])["tokens"].sum()
    joint = cells**mixing.TEMPER
    joint, w = joint / joint.sum(), cells / cells.sum()
    for _ in range(2000):
        for d in ("source", "lang", "topic"):
            w = w * (joint.groupby(d).sum() / w.groupby(d).sum()).reindex(w.index.get_level_values(d)).to_numpy()
    key = list(zip(rows["source"], rows["lang"], rows["topic"], strict=True))
    assert np.allclose(rows["weight"], [w[k] * t / cells[k] for k, t in zip(key, rows["tokens"], strict=True)], atol=1e-6)
    assert rows["raking_error"].max() <= mixing.TOLERANCE
    share, lo, hi = cells / cells.sum(), 0.0, 1e6
    for _ in range(200):  # the factor that spends the budget
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.minimum(share, mid * w).sum() < mixing.BUDGET else (lo, mid)
    assert np.allclose(rows["probability"], [min(1.0, lo * w[k] / share[k]) for k in key], atol=1e-4)
    drawn = rows["probability"].to_numpy()
    assert abs(rows["kept"].mean() - drawn.mean()) < 0.08


def test_sources_of_one_language_each(spark):
    docs = spark.createDataFrame([(i, "some words here " * (i % 9 + 1), ["en", "de", "fr"][i % 3], ["a", "b", "c"][i % 3]) for i in range(300)], "doc_id long, text string, lang string, source string")
    assert mixing.mix(docs).agg({"raking_error": "max"}).first()[0] <= mixing.TOLERANCE
    apart = {"source": {"a": 0.2, "b": 0.4, "c": 0.4}, "lang": {"en": 0.6, "de": 0.2, "fr": 0.2}}
    assert mixing.mix(docs, apart).agg({"raking_error": "max"}).first()[0] > 0.1


def test_both_ways_to_rake_agree(spark, monkeypatch):
    docs = corpus(spark, 500)
    a = mixing.mix(docs).toPandas().sort_values("doc_id")
    monkeypatch.setattr(mixing, "_COLLECTED_CELLS", 2)
    b = mixing.mix(docs).toPandas().sort_values("doc_id")
    assert np.allclose(a["probability"], b["probability"]) and (a["kept"].to_numpy() == b["kept"].to_numpy()).all()


def test_odd_documents_are_mixed(spark):
    docs = spark.createDataFrame([(1, None, None, None, 5.0), (None, "", "en", "a", 1.0), (2, "some words here", "en", "a", 2.0), (2, "some words here", "en", "a", 2.0)], "doc_id long, text string, lang string, source string, weight double")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 4 and len({r["kept"] for r in rows if r["doc_id"] == 2}) == 1
    assert mixing.sample(docs).columns == docs.columns
    assert mixing.sample(docs, budget=1.0).filter("doc_id = 2").count() == 2
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.sample(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- neighbours


def brute_neighbours(ids, m, every, k):
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = unit @ unit[i]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(9)
    m = rng.standard_normal((1500, 32)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    got, hits = {}, 0
    for r in neighbours.nearest(frame).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute_neighbours(np.arange(1500), m.astype(float), 50, 5)
    assert set(got) == set(want)
    for q, best in want.items():
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        hits += len({v for v, _ in got[q].values()} & {v for v, _ in best})
        for v, s in got[q].values():
            assert s == pytest.approx(float(m[v].astype(float) @ m[q].astype(float) / np.linalg.norm(m[v].astype(float)) / np.linalg.norm(m[q].astype(float))), abs=1e-12)
    assert hits >= 0.9 * 5 * len(want)


def test_copies_ties_and_useless_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(100)] + [(100, [0.0, 1.0]), (101, [0.0, 0.0]), (102, None), (103, [float("nan"), 1.0]), (104, [float("inf"), 1.0]), (105, [None, 1.0]), (None, [1.0, 0.0]), (150, [1e300, 1e-300]), (0, [1.0, 0.0]), (200, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(frame).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4]
    assert got[150] == [0, 1, 2, 3, 4] and got[100] == [0, 1, 2, 3, 4]
    assert 200 not in got
    assert neighbours.nearest(frame.limit(0)).count() == 0


def test_fewer_are_visited_of_more(spark):
    rng, shares = np.random.default_rng(22), []
    unit = neighbours._unit(rng.standard_normal((60_000, 24)))
    for n in (1_000, 8_000, 60_000):
        q = np.arange(0, n, n // 40)
        cos = unit[q] @ unit[:n].T
        cos[np.arange(len(q)), q] = -2
        top = np.argsort(-cos, axis=1)[:, :5]
        _, met, share = neighbours.fit(unit[q], unit[top.ravel()], np.repeat(np.arange(len(q)), 5), unit[: min(n, 4096)], n)
        assert met >= 0.9
        shares.append(share)
    assert shares[0] > shares[1] > shares[2]


def test_codes_are_within_their_bounds():
    rng = np.random.default_rng(23)
    unit = neighbours._unit(rng.standard_normal((300, 48)) * rng.exponential(1, (300, 48)))
    (coded,) = neighbours._decoded(neighbours.codes(unit))
    wide = neighbours._off(coded.off[:, None], coded.off[None, :])
    assert (np.abs(coded.m @ coded.m.T - unit @ unit.T) <= wide).all() and wide.max() < 0.2


def test_one_large_bucket_and_clashing_columns(spark, monkeypatch):
    rng = np.random.default_rng(24)
    near = rng.standard_normal(16) + 0.01 * rng.standard_normal((700, 16))
    m = np.concatenate([near, rng.standard_normal((300, 16))])
    frame = spark.createDataFrame([(i, v.tolist(), "x", 1, b"c") for i, v in enumerate(m)], "vec_id long, embedding array<double>, bucket string, id int, code binary")
    monkeypatch.setattr(neighbours, "_HOT_BUCKET", 20)
    got = {}
    for r in neighbours.nearest(frame).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = {q: {v for v, _ in best} for q, best in brute_neighbours(np.arange(1000), m, 50, 5).items()}
    assert sum(len(got[q] & want[q]) for q in want) >= 0.9 * 5 * len(want)


def test_perturbations_come_by_estimated_success():
    place = np.array([0.1, 0.6, 0.45])
    sets = neighbours.perturbations(place, 27)
    cost = [sum((place[d] if s < 0 else 1 - place[d]) ** 2 for d, s in p) for p in sets]
    assert sets[0] == [] and cost == sorted(cost) and len({tuple(sorted(p)) for p in sets}) == len(sets) == 27


# ---------------------------------------------------------------- joins


@pytest.mark.parametrize("limit", [100, 1])
def test_join_counted(spark, limit):
    left = spark.range(100).selectExpr("id as doc_id", "if(id < 90, 'hot', 'cold') as host")
    right = spark.createDataFrame([("hot", 1), ("other", 2)], "host string, n int")
    out = join_counted(left, right, "host", "doc_id", limit=limit)
    assert out.count() == 100 and out.filter("n = 1").count() == 90
