import hashlib
import os

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from graphstrata.llm import bpe, jaccard, lines, mixing, quality
from tests.llm.test_text_ops import brute_measures

SMALL = "/root/testdata/sf0.001"


def test_every_query_is_registered_once():
    found = __spark_entry__.queries()
    for n in range(1, 11):
        assert len([q for q in found if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in found and set(__spark_entry__.oracle_sql()) <= set(found)


@pytest.mark.parametrize("name", ["op3_host_rules", "op5_near_duplicates", "op10_lines"])
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, SMALL).toPandas()[list(want.columns)]
    order = list(want.columns)
    assert (want.sort_values(order).to_numpy() == got.sort_values(order).to_numpy()).all()


def plain_quality(docs):
    """The doc_ids kept, by measures counted in plain Python and the prior by its formula."""
    failed = {}
    for d, t in zip(docs["doc_id"], docs["text"], strict=True):
        m = brute_measures(t)
        failed[d] = m[0] < 20 or 100 * m[4] > 30 * m[0]
    hosts = {}
    for d, h in zip(docs["doc_id"], docs["source"], strict=True):
        if h is not None:
            hosts.setdefault(h, []).append(failed[d])
    rate, n = np.array([np.mean(f) for f in hosts.values()]), np.array([len(f) for f in hosts.values()])
    mean = rate.mean()
    beyond = rate.var() - mean * (1 - mean) * np.mean(1 / n)
    weight = max(mean * (1 - mean) / beyond - 1, 0) if beyond > 1e-9 else quality.NO_SPREAD
    bad = {h for h, f in hosts.items() if (sum(f) + mean * weight) / (len(f) + weight) > quality.HOST_LIMIT}
    return sorted(d for d, h in zip(docs["doc_id"], docs["source"], strict=True) if not failed[d] and h not in bad)


def plain_probabilities(docs):
    """Each document's probability: tempered cells raked by numpy, then scaled to the budget by bisection."""
    import re

    def topic(t):
        size = max(len(t), 1)
        for name, chars in (("table", r"[|\t;]"), ("markup", r"[#*$%&<>{}=_]"), ("figures", "[0-9]")):
            if len(re.findall(chars, t)) * 50 > size:
                return name
        return "note" if size < 600 else "prose"

    key = [(s or "", x or "", topic(t or "")) for s, x, t in zip(docs["source"], docs["lang"], docs["text"], strict=True)]
    tokens = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in docs["text"]]
    cells = sorted({k for k, n in zip(key, tokens, strict=True) if n})
    share = np.array([sum(n for k, n in zip(key, tokens, strict=True) if k == c) for c in cells], float)
    joint = share**mixing.TEMPER / (share**mixing.TEMPER).sum()
    share /= share.sum()
    w = share.copy()
    for _ in range(3000):
        for d in range(3):
            for v in {c[d] for c in cells}:
                mine = np.array([c[d] == v for c in cells])
                w[mine] *= joint[mine].sum() / w[mine].sum()
    lo, hi = 0.0, 1e9
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.minimum(share, mid * w).sum() < mixing.BUDGET else (lo, mid)
    rated = {c: min(1.0, lo * w[i] / share[i]) for i, c in enumerate(cells)}
    return {d: rated.get(k, mixing.BUDGET) for d, k in zip(docs["doc_id"], key, strict=True)}


def test_stages_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        if name != corpus_pipeline.STAGES[-1][0]:
            assert stage(spark, docs.limit(0), SMALL).columns == docs.columns
        before, docs = docs, stage(spark, docs, SMALL)
        docs.write.parquet(str(tmp_path / name.split()[0]))
        docs = spark.read.parquet(str(tmp_path / name.split()[0]))
        out[name] = (before.toPandas(), docs.toPandas())
    first, second, third, fourth, last = (n for n, _ in corpus_pipeline.STAGES)
    before, after = out[first]
    assert sorted(after["doc_id"]) == plain_quality(before)
    before, after = out[second]
    count = {}
    for t in before["text"]:
        for k in {k for k in lines.line_keys(t) if k}:
            count[k] = count.get(k, 0) + 1
    want = {d: "\n".join(x for x, k in zip(t.split("\n"), lines.line_keys(t), strict=True) if count.get(k, 0) < 10) for d, t in zip(before["doc_id"], before["text"], strict=True)}
    assert dict(zip(after["doc_id"], after["text"], strict=True)) == want
    before, after = out[third]
    sets = {d: frozenset(s.tolist()) for d, s in zip(before["doc_id"], jaccard.shingle_sets(before["text"].tolist()), strict=True)}
    gone = {x for x in sets for y in sets if y < x and len(sets[x] & sets[y]) * 100 >= 80 * len(sets[x] | sets[y]) > 0}
    assert set(before["doc_id"]) - set(after["doc_id"]) == gone
    before, after = out[fourth]
    drawn = {r["doc_id"]: r["u"] for r in spark.createDataFrame(before[["doc_id"]]).select("doc_id", mixing._drawn().alias("u")).collect()}
    probability = plain_probabilities(before)
    sure = [d for d in before["doc_id"] if abs(drawn[d] - probability[d]) > 1e-4]
    assert {d for d in sure if drawn[d] < probability[d]} == set(after["doc_id"]) & set(sure) and 0 < len(after) < len(before)
    before, after = out[last]
    assert sorted(after["doc_id"]) == sorted(before["doc_id"])
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    want = {d: hashlib.sha256(np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for d, t in zip(before["doc_id"], before["text"], strict=True)}
    assert dict(zip(after["doc_id"], after["ids_sha256"], strict=True)) == want
    run = corpus_pipeline.run(spark, SMALL).toPandas()
    assert sorted(run["doc_id"]) == sorted(after["doc_id"])


def test_odd_rows_pass_every_stage(spark, tmp_path):
    """Nulls in every column, empty texts, rows that repeat, and a column whose name clashes with one made on the way."""
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(None, None, None, None, None, "x"), (1, "", "en", "a", 0, "x"), (2, long, None, None, 1, None), (2, long, None, None, 1, None), (None, long + " more", "en", "a", 2, "y"), (3, "some " * 30, "de", "b", 3, "z")]
    rows += [(10 + i, " ".join(f"own{i}x{j}" for j in range(60)), "en", f"s{i % 3}", 5, "k") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _host string")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
        if i == 2:
            assert sum(long in r["text"] for r in docs.collect()) == 1 and docs.count() == 31
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_a_stage_deletes_what_the_one_before_left(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    corpus_pipeline.STAGES[0][1](spark, docs, SMALL).write.parquet(str(tmp_path / "kept"))
    left = list(corpus_pipeline._left)
    assert left and all(os.path.isdir(p) for p in left)
    corpus_pipeline.STAGES[1][1](spark, spark.read.parquet(str(tmp_path / "kept")), SMALL)
    assert not any(os.path.isdir(p) for p in left)
