import hashlib
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from graphstrata.llm import bpe, chunks, html, lines, pii, quality, sharding
from graphstrata.llm.hashing import Sums, blocks

ODD_DOCS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "one\n\ntwo words", None, None), (None, "null id", "en", "b"), (4, "same", "en", "a"), (4, "same", "en", "a"), (4, "other text", "en", "a"), (5, "x " * 40_000, "de", "b"), (6, "é日本 " * 9, "fr", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeats, a long text, and extra columns whose names clash with those made on the way."""
    rows = [(*r, 7, "mine") for r in ODD_DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, row_key string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


# ---------------------------------------------------------------- html


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("just text &amp; more", "just text & more"), ("<p>a<p>b", "a\nb"),
        ("<body><nav><a href=x>menu</a></nav><article><h1>T</h1><p>one  <b>two</b>\n three<br>four</p></article><footer>f</footer>", "T\none two three\nfour"),
        ("<div class=ad>buy</div><main><p>kept &eacute; text</p><aside>no</aside><form>f<input></form><script>x='</p>'</script></main>", "kept é text"),
        ("<article><header><h1>Head</h1></header><p>Body text here</p><div id='comments'><p>first!</p></div></article>", "Head\nBody text here"),
        ("<article><p>cut off in a t", "cut off in a t"), ("<article><p>cut off <b", "cut off"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_density_chooses_the_story_without_hints():
    story = "".join(f"<p>Sentence number {i} of a story that goes on for a good while, with words enough.</p>" for i in range(8))
    page = f"<body><div><ul>{''.join(f'<li><a href=/{i}>link {i}</a></li>' for i in range(30))}</ul></div><div><div>{story}</div></div></body>"
    assert html.main_text(page).split("\n") == re.findall(r"<p>(.*?)</p>", story)


STORY = "".join(f"<p>Sentence number {i} of a story that goes on for a good while, with words enough.</p>" for i in range(8))


@pytest.mark.parametrize("hint", ["class='content has-sidebar'", "class=no-sidebar", "class='with-sidebar'", "class='comments-open'", "class='post social-story'", "id='page-with-nav'", "class=ad-free", "class=skip-target", "class=sidebar", "class='social'"])
@pytest.mark.parametrize("story", [STORY, f"<article>{STORY}</article>"])
def test_names_alone_drop_no_story(hint, story):
    links = "".join(f"<li><a href=/{i}>link {i}</a></li>" for i in range(30))
    page = f"<body><div class=related><ul>{links}</ul></div><div {hint}><div>{story}</div></div><div class='ad banner'><p>buy this thing now</p></div></body>"
    assert html.main_text(page).split("\n") == re.findall(r"<p>(.*?)</p>", STORY)


@pytest.mark.parametrize("hint", ["class=comments", "id=share", "class='newsletter signup'", "class='site-sidebar'", "class=reader-comments", "class='js-ad x2'", "id=cookieNotice", "class='related posts'"])
def test_small_named_parts_of_an_article_are_dropped(hint):
    page = f"<article>{STORY}<div {hint}><p>Sign up here and <a href=x>share</a> with friends</p></div></article>"
    assert html.main_text(page).split("\n") == re.findall(r"<p>(.*?)</p>", STORY)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p title='it's'>hello</p><p>more don't stop</p><p>end</p>", "hello\nmore don't stop\nend"), ('<p class=a">hello one</p><p>two</p>', "hello one\ntwo"),
        ("<p title='the hidden > truth'>seen</p>", "seen"), ("<p hidden>gone</p><p>seen</p>", "seen"), ("<p style='display: none'>gone</p><p>seen</p>", "seen"),
    ],
)
def test_attributes_are_read_as_html_reads_them(page, text):
    assert html.main_text(page) == text


def test_density_without_article_or_main():
    told = re.findall(r"<p>(.*?)</p>", STORY)
    assert html.main_text(f"<form id=aspnetForm><div>{STORY}</div><input><label>x</label></form>").split("\n") == told
    assert html.main_text(f"<p>tiny</p><div class='has-sidebar'>{STORY}</div>").split("\n")[-8:] == told
    assert html.main_text(f"<div><h1>Title</h1><div>{STORY}</div></div>").split("\n") == ["Title", *told]
    thread = "".join(f"<div class=comment><p>Reader {i} has a good deal to say about this, and says it at some length here.</p></div>" for i in range(20))
    assert html.main_text(f"<article><h1>Title</h1>{STORY}<section id='comments'>{thread}</section></article>").split("\n") == ["Title", *told]
    assert html.main_text(f"<div>{STORY}<p class='related-work'>Related work is told here.</p></div>").split("\n") == [*told, "Related work is told here."]
    assert html.main_text("<div class=ad>buy this</div><nav><a href=x>menu</a></nav>") == ""


def plain_density(node, ratio):
    """Link-adjusted characters per tag of a well-formed element, counted anew for each."""
    import math

    chars = lambda e: sum(len("".join(t.split())) for t in e.itertext())
    links = [e for e in node.iter("a")]
    c, tags = chars(node), sum(1 for _ in node.iter()) - 1
    link_chars, link_tags = sum(map(chars, links)), len(links) - (node.tag == "a") + (node.tag == "a")
    plain = max(c - link_chars, 1)
    base = math.log(c / plain * link_chars + ratio * c + math.e)
    return c / max(tags, 1) * math.log(c / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1) + 1) / math.log(base + 1) if c else 0.0


def test_scores_against_an_independent_count():
    import xml.etree.ElementTree as ET

    rng = np.random.default_rng(11)

    def some(depth):
        inner = "".join(some(depth - 1) for _ in range(int(rng.integers(0, 4)))) if depth else ""
        words = " ".join(["word"] * int(rng.integers(0, 9)))
        tag = ["div", "section", "span", "b"][int(rng.integers(0, 4))]
        return f"<{tag}>{words}{inner}</{tag}>" if rng.random() < 0.8 else f"<a href='x'>{words}</a>"

    for _ in range(60):
        page = "<div>" + "".join(some(4) for _ in range(3)) + "</div>"
        root = html.parse(page)
        nodes = html.score(root)
        tree = ET.fromstring(f"<body>{page}</body>")
        chars = lambda e: sum(len("".join(t.split())) for t in e.itertext())
        ratio = sum(chars(a) for a in tree.iter("a")) / max(chars(tree), 1)
        mine = [n for n in html._in_page_order(root)]
        assert [n.tag for n in mine] == [e.tag for e in tree.iter()] and len(nodes) == len(mine)
        for n, e in zip(mine, tree.iter(), strict=True):
            assert n.density == pytest.approx(plain_density(e, ratio))
            assert n.score == pytest.approx(sum(plain_density(x, ratio) for x in e))


def test_deep_and_broken_pages_are_linear():
    for page in ("<div>" * 20_000 + "x", "<b>" * 20_000 + "x", "<" * 100_000, "<a b='" * 20_000, "<li>x" * 20_000):
        html.main_text(page)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a", "mine"), (1, "u", "<p>a", "mine"), (2, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted(tuple(r) for r in html.extract_text(pages).fillna("").collect()) == [(1, "u", "a", 1), (1, "u", "a", 1), (2, "", "", 0)]
    assert html.extract_text(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- sharding


def one_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=50), st.integers(1, 60))
@settings(max_examples=50, deadline=None)
def test_jump_hash(keys, n):
    now, grown = sharding.jump_hash(np.array(keys, np.uint64), n, n + 1)
    assert now.tolist() == [one_jump(k, n) for k in keys]
    assert grown.tolist() == [one_jump(k, n + 1) for k in keys]
    assert all(g in (a, n) for a, g in zip(now, grown, strict=True))


def test_shards(spark, odd, empty):
    rows = sharding.assign_shards(odd, 3).collect()
    assert len(rows) == len(ODD_DOCS)
    for s in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sorted(r["size"] for r in rows) == sorted(16 + len((t or "").encode()) for _, t, _, _ in ODD_DOCS)
    assert {r["text_crc32"] for r in rows if r["doc_id"] == 2} == {0}
    assert all(r["text_crc32"] == zlib.crc32(b"same") for r in rows if r["size"] == 20)
    assert len({r["shard"] for r in rows if r["doc_id"] == 4}) == 1
    assert sharding.assign_shards(empty).count() == 0


def test_slots_of_many_rows(spark):
    rows = sharding.assign_shards(spark.range(5000).selectExpr("id % 3000 as doc_id", "'t' as text"), 40, buckets=4).collect()
    assert len({(r["shard"], r["slot"]) for r in rows}) == 5000
    assert all(max(r["slot"] for r in rows if r["shard"] == s) + 1 == sum(r["shard"] == s for r in rows) for s in range(40))


# ---------------------------------------------------------------- quality


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    held = {}
    for i in range(len(words) - 7):
        held.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for at in held.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    solid = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(solid) - len(set(solid)), len(covered)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "#", "\n", "é$", "cc"]), max_size=60), min_size=1, max_size=30))
def test_measures(spark, texts):
    docs = [(i, " ".join(t), "s") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    for i, t, _ in docs:
        want = brute_measures(t)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_odd_documents_are_judged(odd, empty):
    rows = quality.judge(odd).collect()
    assert len(rows) == len(ODD_DOCS) and not any(r["kept"] and r["base_failed"] for r in rows)
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0
    assert quality.keep_good(odd).columns == odd.columns


def test_the_prior_leaves_out_chance(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rng = np.random.default_rng(16)
    hosts = {f"one{i}": [bool(rng.random() < 0.2)] for i in range(300)} | {"worst": [True] * 45 + [False] * 5, "best": [False] * 50}
    docs = [(k, bad if f else good, h) for k, (h, f) in enumerate((h, f) for h, fails in hosts.items() for f in fails)]
    rate = np.array([np.mean(f) for f in hosts.values()])
    n = np.array([len(f) for f in hosts.values()])
    m = rate.mean()
    beyond = rate.var() - m * (1 - m) * np.mean(1 / n)
    weight = max(m * (1 - m) / beyond - 1, 0) if beyond > 1e-9 else quality.NO_SPREAD
    gone = {h for (h, f) in hosts.items() if (sum(f) + m * weight) / (len(f) + weight) > 0.5}
    rows = quality.judge(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert {r["doc_id"] for r in rows if r["kept"]} == {k for k, t, h in docs if t == good and h not in gone}


def test_bad_hosts_take_their_documents_along(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    docs = [(i, bad if i % 10 else good, "bad") for i in range(100)] + [(1000 + i, bad if i % 10 == 0 else good, f"h{i % 5}") for i in range(100)] + [(5000, good, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in quality.judge(frame).filter("kept").collect()}
    assert kept == {d for d, t, s in docs if t == good and s != "bad"}
    assert {r["doc_id"] for r in quality.keep_good(frame).collect()} == kept


# ---------------------------------------------------------------- lines


def brute_lines(docs, least):
    keys = [lines.line_keys(t) for _, t in docs]
    count = {}
    for k in keys:
        for x in set(k):
            count[x] = count.get(x, 0) + 1
    out = []
    for (d, t), k in zip(docs, keys, strict=True):
        kept = [x for x, y in zip((t or "").split("\n"), k, strict=True) if not y or count[y] < least]
        out.append((d, len(k), len(k) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("least", [2, 10])
def test_lines(spark, least):
    rng = np.random.default_rng(4)
    docs = [(int(i), "\n".join(f"{'  ' * (j % 2)}Line {rng.integers(0, 40)}" if rng.random() < 0.7 else f"own {i} {j}" for j in range(rng.integers(0, 30)))) for i in range(200)]
    docs += [(900, None), (900, ""), (901, "Line 1"), (901, "Line 1")]
    got = lines.line_summaries(spark.createDataFrame(docs, "doc_id long, text string"), least)
    assert sorted(tuple(r) for r in got.collect()) == brute_lines(docs, least)


@pytest.mark.parametrize("mode", [10, None])
def test_one_row_repeated_many_times(spark, mode):
    hot = spark.range(100_000).selectExpr("cast(7 as long) as doc_id", "'same\nagain\nsame' as text")
    few = spark.createDataFrame([(None, "same"), (8, "own")], "doc_id long, text string")
    kept = {(r["doc_id"], r["text"]): r["n"] for r in lines.drop_lines(hot.union(few), mode).groupBy("doc_id", "text").count().withColumnRenamed("count", "n").collect()}
    assert kept == ({(7, ""): 100_000, (None, ""): 1, (8, "own"): 1} if mode else {(7, "again"): 100_000, (None, "same"): 1, (8, "own"): 1})


def test_bitmaps_beyond_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"shared line\nown {i}") for i in range(50)], "doc_id long, text string")
    before = sorted(map(tuple, lines.line_summaries(docs).collect()))
    monkeypatch.setattr(lines, "_BROADCAST_BYTES", 0)
    frame = lines.line_summaries(docs)
    assert "SortMergeJoin" in frame._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, frame.collect())) == before


def test_first_occurrences_stay(spark):
    docs = [(i, "\n".join(f"line {j % 7}" for j in range(i, i + 10))) for i in range(300)] + [(999, "new\nnew\nline 3")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    seen, want = set(), {}
    for d, t in sorted(docs):
        kept = []
        for x in t.split("\n"):
            if x not in seen:
                kept.append(x)
            seen.add(x)
        want[d] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in lines.drop_lines(frame, None).collect()} == want


def test_odd_documents_keep_their_columns(odd, empty):
    out = lines.drop_lines(odd, 2)
    assert out.columns == odd.columns and out.count() == len(ODD_DOCS)
    assert sorted(r["text"] for r in out.filter("doc_id = 4").collect()) == ["", "", "other text"]
    assert lines.line_summaries(empty).count() == 0 and lines.drop_lines(empty).count() == 0


# ---------------------------------------------------------------- bpe


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs", "Cn"]), st.sampled_from("abcthe' \n12!éΣİ")), max_size=60))
@settings(max_examples=400, deadline=None)
def test_ids_are_the_library_s(tokenizer, text):
    mine = bpe.load(bpe.vocabulary_path())
    ids = mine.encode(text)
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids
    assert mine.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a<|endoftext|>B<|startoftext|>", "x" * 5000, "thereand" * 900, "é" * 400, "ＡＢ ﬁ ½ ΑΣ"])
def test_special_and_long_words(tokenizer, text):
    assert bpe.load(bpe.vocabulary_path()).encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_scan_and_heap_agree():
    mine = bpe.load(bpe.vocabulary_path())
    rng = np.random.default_rng(1)
    for _ in range(300):
        ids = [mine.inner[b] for b in bytes(rng.choice(list(b"therandio"), rng.integers(1, 60)).tolist())]
        assert mine._scan(list(ids)) == mine._heap(list(ids))


def test_digests(spark, odd, empty, tokenizer):
    rows = bpe.digest_documents(odd, bpe.vocabulary_path()).collect()
    for r, (d, t, _, _) in zip(rows, ODD_DOCS, strict=True):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert (r["doc_id"], r["n_tokens"]) == (d, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digest_documents(empty, bpe.vocabulary_path()).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(odd, bpe.vocabulary_path()), bpe.vocabulary_path())
    assert back.filter("doc_id = 2").first()["text"] == ""


# ---------------------------------------------------------------- pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}
            if fine[kind]:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


@given(st.text(alphabet="ab@.-+ 0125()é", max_size=40))
@settings(max_examples=2000, deadline=None)
def test_plain_spans(text):
    assert pii.plain_spans(text) == brute_spans(text)


@pytest.mark.parametrize(
    ("text", "found", "kind"),
    [
        ("mail john [at] example [dot] com now", "john [at] example [dot] com", "email"), ("j dot doe at mail dot example dot org ok", "j dot doe at mail dot example dot org", "email"),
        ("call plus four nine one seven one two three four five six seven now", "plus four nine one seven one two three four five six seven", "phone"), ("x jоhn@example.com", "jоhn@example.com", "email"),
        ("john＠example．com", "john＠example．com", "email"), ("ip one nine two dot one six eight dot zero dot one", "one nine two dot one six eight dot zero dot one", "ip"),
        ("４１１１ １１１１ １１１１ １１１１", "４１１１ １１１１ １１１１ １１１１", "card"), ("é 日 a(at)b.co", "a(at)b.co", "email"),
    ],
)
def test_disguises(text, found, kind):
    spans = pii.hidden_spans(text, pii.plain_spans(text))
    assert (kind, found) in [(k, text[b:e]) for b, e, k in spans]


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        *((f"jane at firma {end}", "email") for end in ("dot it", "punkt at", "dot se", "dot be", "dot us", "dot me", "dot in", "dot museum")),
        ("jane [at] firma dot it", "email"), ("jane [at] firma dot intranet", "email"), ("jane\nat\tfirma  dot\nde", "email"),
        ("192 dot 168 dot 1 dot 20", "ip"), ("10.0.zero.one", "ip"), ("+49 one five one 2345678", "phone"), ("+49 151 two 345678", "phone"),
    ],
)
def test_disguises_with_few_signs(text, kind):
    assert pii.hidden_spans(f"so {text} ok", pii.plain_spans(text)) == [(3, 3 + len(text), kind)]


@pytest.mark.parametrize("text", ["look at this point in time", "look at the dot in the middle", "at that point it was two", "we met at noon dot dot dot", "at some point people say", "between 2 point 5 and one, 3 or four"])
def test_prose_with_dots_and_numbers_is_clean(text):
    assert pii.hidden_spans(text, pii.plain_spans(text)) == []


@pytest.mark.parametrize("text", ["look at the dot on the map", "one two three go", "meet at example.com today", "plain text", "Ночь и день"])
def test_clean_texts_have_no_spans(text):
    assert pii.plain_spans(text) == [] and pii.hidden_spans(text, []) == []


def test_written_addresses_in_linear_time():
    import time

    for text in ("a dot " * 100_000 + " at ", "a at " * 100_000, "a at b dot " * 50_000, " " * 300_000, "x" + " " * 200_000 + "at y", "1 dot " * 50_000):
        began = time.monotonic()
        pii.hidden_spans(text, pii.plain_spans(text))
        assert time.monotonic() - began < 2


@pytest.mark.parametrize("address", ["anna at mail dot example dot it", "anna at example dot se", "john at firma dot at", "o dot n at x.y dot org", "jo at a-b dot co dot uk"])
def test_addresses_by_their_form(address):
    assert pii.hidden_spans(f"to {address}, please", []) == [(3, 3 + len(address), "email")]


@pytest.mark.parametrize("text", ["version 2.0 at the point where", "he looked at red dot sights", "we are at home dot dot", "met at ten point of no return", "look at a dot or two"])
def test_prose_is_no_address(text):
    assert pii.hidden_spans(text, []) == []


def test_every_column_against_brute_force(spark):
    rng = np.random.default_rng(12)
    bits = ["jo@ex.org", "jo at ex dot org", "jo [at] ex [dot] org", "192.168.1.20", "300.1.1.1", "192 dot 168 dot 1 dot 20", "4111 1111 1111 1111", "4111 1111 1111 1112", "+49 151 2345678", "plus four nine one five one two three four five six seven", "jоhn@ex.org", "word", "é日", "the dot", "\n"]
    docs = [(i, " so ".join(rng.choice(bits, int(rng.integers(0, 12))))) for i in range(300)]
    rows = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    hidden = {"jo at ex dot org": "email", "jo [at] ex [dot] org": "email", "192 dot 168 dot 1 dot 20": "ip", "plus four nine one five one two three four five six seven": "phone", "jоhn@ex.org": "email"}
    for i, text in docs:
        base, r = brute_spans(text), rows[i]
        told = lambda spans: ",".join(f"{k}:{b}:{e}" for b, e, k in spans)
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[2] == k for s in base) for k in PATTERNS]
        assert r["base_sha256"] == hashlib.sha256(told(base).encode()).hexdigest()
        spans = [(int(b), int(e), k) for k, b, e in (x.split(":") for x in r["spans"].split(",") if x)]
        order = list(PATTERNS)
        assert spans == sorted(spans, key=lambda s: (s[0], order.index(s[2]))) and len(spans) == r["n_spans"] and r["has_pii"] == bool(spans)
        assert set(base) <= set(spans)
        for disguise, kind in hidden.items():
            for m in re.finditer(rf"(?<!\S){re.escape(disguise)}(?!\S)", text):
                assert any(k == kind and b <= m.start() and m.end() <= e or k == kind and m.start() <= b < m.end() for b, e, k in spans), (text, disguise)


def test_pii_rows(odd, empty):
    rows = pii.find_pii(odd).collect()
    assert len(rows) == len(ODD_DOCS) and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)
    assert pii.find_pii(empty).count() == 0


# ---------------------------------------------------------------- chunks


@given(st.lists(st.binary(max_size=300), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_stretch_hashes(parts):
    texts = [p.decode("latin-1") for p in parts]
    for block in blocks(texts, b"\0"):
        hashes = Sums(block.data).hashes(block.begin, block.end)
        raw = [bytes(block.data[b:e]) for b, e in zip(block.begin, block.end, strict=True)]
        assert len(set(zip(raw, hashes.tolist(), strict=True))) == len(set(raw)) == len(set(hashes.tolist()))


def test_chunks_cover_texts_and_resist_shifts():
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(600))
    texts = [text, "inserted in front " + text, "", "a" * 3000]
    for block in blocks(texts, b"\0"):
        own, begin, end, digest = chunks.block_chunks(block)
        for i, t in enumerate(texts):
            mine = own == i
            assert b"".join(bytes(block.data[b:e]) for b, e in zip(begin[mine], end[mine], strict=True)).decode() == t
        a, b = set(digest[own == 0].tolist()), set(digest[own == 1].tolist())
        assert len(a & b) >= len(a) - 2
        assert (end - begin).max() <= chunks.MOST


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(2000)]
    text = lambda n: " ".join(rng.choice(words, n))
    passages, docs = [text(52) for _ in range(30)], []
    for i in range(300):
        t = text(int(rng.integers(30, 300)))
        k = int(rng.integers(0, len(t)))
        docs.append((i, f"é{t[:k]} {passages[i % 30]} {t[k:]}" if i < 90 else t))
    docs += [(300, None), (301, "")]
    rows = chunks.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in rows} == set(range(90))
    for r in rows:
        assert docs[r["doc_id"]][1][r["span_begin"] : r["span_end"]].strip() in f" {passages[r['doc_id'] % 30]} "


def test_chunks_against_a_byte_at_a_time():
    rng = np.random.default_rng(13)
    texts = ["".join(rng.choice(list("abcdefgh ij"), int(rng.integers(0, 3000)))) for _ in range(12)] + ["ab" * 1500, "word " * 700, "", "x"]
    for block in blocks(texts, b"\0"):
        own, begin, end, _ = chunks.block_chunks(block)
        for i in range(len(block.begin)):
            data = bytes(block.data[block.begin[i] - chunks.REACH : block.end[i]])  # with the padding that the first hashes see
            mine = own == i
            got = [(int(b - block.begin[i]), int(e - block.begin[i])) for b, e in zip(begin[mine], end[mine], strict=True)]
            padded = plain_after(data)
            assert got == padded


def plain_after(data):
    """As plain_chunks, of a text that stands behind REACH bytes of padding."""
    pad, text = data[: chunks.REACH], data[chunks.REACH :]
    hashes = []
    whole = pad + text
    for i in range(chunks.REACH, len(whole)):
        h = sum(int(chunks._GEAR[whole[i - k]]) << k for k in range(chunks.REACH)) & 0xFFFFFFFF
        hashes.append(h ^ h >> 15)
    out, last = [], 0
    while last < len(text):
        stop = next((i + 1 for i in range(last + chunks.LEAST - 1, min(last + chunks.MOST, len(text))) if hashes[i] < int(chunks._BELOW)), None)
        if stop is None and len(text) - last > chunks.MOST:
            near = hashes[last + chunks.LEAST - 1 : last + chunks.MOST]
            stop = last + chunks.LEAST + max(j for j, h in enumerate(near) if h == min(near))
        out.append((last, stop or len(text)))
        last = out[-1][1]
    return out


def test_periodic_passages_are_found(spark):
    rng = np.random.default_rng(14)
    words = ["".join(rng.choice(list("klmnopqrst"), 6)) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words, n))
    docs = [(i, f"{text(20 + 7 * i)} {'the same phrase again ' * 150}{text(30)}") for i in range(6)] + [(100 + i, text(200)) for i in range(6)]
    rows = chunks.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in rows} == set(range(6))


def test_a_repeated_row_repeats_its_text(spark):
    rng = np.random.default_rng(15)
    text = " ".join("".join(rng.choice(list("abcdef"), 5)) for _ in range(60))
    docs = spark.range(50_000).selectExpr("cast(null as long) as doc_id", f"'{text}' as text", "1 as copies").union(spark.createDataFrame([(1, "alone here", 2)], "doc_id long, text string, copies int"))
    assert [tuple(r) for r in chunks.repeated_spans(docs).select("doc_id", "span_begin", "span_end").collect()] == [(None, 0, len(text))]


def test_one_row_is_no_repeat(spark):
    assert chunks.repeated_spans(spark.createDataFrame([Row(doc_id=1, text="ab " * 500)])).count() == 0


def held_by_another(docs, rows):
    """Every reported span is the text of one other document, word for word."""
    for r in rows:
        part = docs[r["doc_id"]][r["span_begin"] : r["span_end"]]
        assert len(part) >= chunks.LEAST_SPAN and any(part in t for i, t in docs.items() if i != r["doc_id"])


def test_overlapping_stretches_of_many_documents_are_no_passage(spark):
    rng = np.random.default_rng(21)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(4000)]
    base = [words[i] for i in rng.permutation(4000)[:400]]
    docs = {0: " ".join(base)}
    for k in range(78):
        other = [words[i] for i in rng.integers(0, 4000, 60)]
        docs[1 + k] = " ".join(other[:30] + base[5 * k : 5 * k + 15] + other[30:])
    rows = chunks.repeated_spans(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    held_by_another(docs, rows)
    assert all(r["span_end"] - r["span_begin"] <= max(len(" ".join(base[i : i + 15])) for i in range(386)) + 2 for r in rows)


def test_passages_against_plain_search(spark, monkeypatch):
    """Chained, nested and repeated passages: what is told is held by one other document, and what several hold is told up to the ends."""
    rng = np.random.default_rng(22)
    words = ["".join(rng.choice(list("abcdefghijklmnopé"), rng.integers(2, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words, n))
    shared = [text(int(n)) for n in rng.integers(40, 160, 12)]
    docs, has = {}, {}
    for i in range(60):
        own = [int(x) for x in rng.permutation(12)[: int(rng.integers(0, 4))]]
        docs[i] = " ".join([text(int(rng.integers(5, 60))), *(f"{shared[p]} {text(int(rng.integers(0, 20)))}" for p in own)])
        has[i] = own
    docs[60] = shared[0] + " " + shared[1]  # next to one another here only
    has[60] = [0, 1]
    found = {}
    rows = chunks.repeated_spans(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(7)).collect()
    held_by_another(docs, rows)
    for r in rows:
        found.setdefault(r["doc_id"], []).append((r["span_begin"], r["span_end"]))
    assert set(found) == {i for i, own in has.items() if own}
    met = whole = 0
    for i, own in has.items():
        for p in own:
            if sum(p in x for x in has.values()) > 1:
                at = docs[i].index(shared[p])
                covered = set().union(*(range(a, b) for a, b in found[i])) & set(range(at, at + len(shared[p])))
                met, whole = met + len(covered), whole + len(shared[p])
                assert len(covered) >= len(shared[p]) - 200  # a chunk at the end may be long
    assert met > 0.8 * whole
    spans = sorted((i, *s) for i, x in found.items() for s in x)
    assert not any(a[0] == b[0] and a != b and a[1] <= b[1] and b[2] <= a[2] for a in spans for b in spans)


def test_passages_of_no_and_of_very_long_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, copies string, h1 string")
    assert chunks.repeated_spans(empty).collect() == []
    rng = np.random.default_rng(23)
    long = " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(150_000))
    docs = {1: long, 2: "x" * 50 + long[400_000:700_000], 3: "nothing of it"}
    rows = chunks.repeated_spans(spark.createDataFrame([(i, t, "mine", "mine") for i, t in docs.items()], "doc_id long, text string, copies string, h1 string")).collect()
    held_by_another(docs, rows)
    assert {r["doc_id"] for r in rows} == {1, 2} and all(r["span_end"] - r["span_begin"] > 299_000 for r in rows)


@pytest.mark.parametrize("name", ["related-work", "notice-board", "comment-on-law", "menu-of-the-day", "promotion-history"])
@pytest.mark.parametrize("frame", ["<p class={0}>{1}</p>", "<div class={0}><p>{1}</p></div>"])
def test_compounds_that_name_something_else_drop_nothing(name, frame):
    more = "This paragraph belongs to the story and has words enough to be told with all the others."
    assert more in html.main_text(f"<body><div>{STORY}{frame.format(name, more)}</div></body>").split("\n")


@pytest.mark.parametrize("name", ["comments", "comment-list", "sidebar", "cookie-notice", "td-footer-bar", "related-posts", "advert-box"])
def test_names_of_boilerplate_still_drop_it(name):
    other = "".join(f"<p>Words of somebody else, number {i}, which are no part of it at all.</p>" for i in range(3))
    assert "somebody" not in html.main_text(f"<body><div>{STORY}<div class={name}>{other}</div></div></body>")


def test_buttons_and_labels_of_a_sentence_stay():
    page = f"<article>{STORY}<p>Press <button>Enter</button> or <label>this</label> now.</p><button>Buy</button><label>Name</label></article>"
    assert html.main_text(page).split("\n")[-1] == "Press Enter or this now."


@pytest.mark.parametrize("shape", ["<span>{0}</b>{1}", "<i>{0}<p>a{1}", "<li>a{0}<li>b{1}", "<div>{0}</i>{1}", "<ul><li>{0}<td>x{1}"])
def test_open_elements_are_never_climbed(shape):
    first, second = re.fullmatch(r"(.*)\{0\}(.*)\{1\}", shape).groups()
    took = []
    for n in (5_000, 40_000):
        began = time.perf_counter()
        html.main_text(first * n + second * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0] + 0.5


def test_bpe_of_every_code_point():
    """Characters newer than the installed tables are lowered, composed and split as by the library."""
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    own, library = bpe.WordBPE(path), Tokenizer.from_file(path)
    for lo in [*range(0, 0xD800, 0x800), *range(0xE000, 0x110000, 0x800)]:
        text = " ".join([f"a{chr(c)}b 1{chr(c)}2" for c in range(lo, lo + 0x800)])
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(lo)


@pytest.mark.parametrize(
    "text, many",
    [
        ("Nothing at all dot the end", 0), ("meet me at school dot it was fun", 0), ("We arrived at hotel dot com last year", 0), ("she works at company dot in the city", 0),
        ("maria arroba correo punto es", 1), ("jean arobase free point fr", 1), ("post klammeraffe firma punkt de", 1), ("anna at example dot com", 1), ("jo at firma punkt at", 1), ("j dot doe at shop dot example", 1),
    ],
)
def test_pii_of_prose_and_of_other_words_for_at(text, many):
    assert len(pii.hidden_spans(text, pii.plain_spans(text))) == many
