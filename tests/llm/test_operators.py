import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kaivo.llm import html, langid, licenses, mixing, neardup, packing, passages, quality, queries, sharding, texts, vectors

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, grp long, rep long, w double"


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and names that clash with the operators' own."""
    long = " ".join(f"w{i % 977}é" for i in range(60_000))
    rows = [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, "one two", "en", "a"), (5, "one two", "en", "b"), (6, long, "en", "b"), (6, long, "en", "b"), (7, long, None, None),
        (None, "no id at all here", "en", "a"), (8, "x" * 200_000, "fr", "a"), (9, " " * 50_000, "de", "b"), (10, "1 2 3 4 !!", None, "b"), (11, None, None, None),
    ]
    return spark.createDataFrame([(*r, None, "k", 1, 2, 3, 0.5) for r in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r for r in docs.collect()}


def encoder():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def check_packing(found, want):
    """want: list of id lists; found: piece rows."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in found:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
        assert 0 < p.length <= 1024
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and {p.sequence_tokens for p in ps} == {at}
    for key, lists in want.items():
        have = Counter((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in by_doc[key])
        assert sum(n * k[1] for k, n in have.items()) == sum(map(len, lists))
        for (start, length, crc, total), _ in have.items():
            assert any(len(ids) == total and zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes()) == crc for ids in lists)
    assert set(by_doc) == set(want)
    return by_seq


def test_packing_round_trip(spark, docs, rows):
    enc = encoder()
    found = packing.pack(docs).collect()
    by_seq = check_packing(found, {k: [[*enc(r.text or ""), 0]] for k, r in rows.items()})
    assert sum(p.length for p in found) / (1024 * len(by_seq)) > 0.99


def test_packing_of_odd_documents(spark):
    enc = encoder()
    odd = odd_documents(spark)
    want = defaultdict(list)
    for r in odd.collect():
        want[r.doc_id].append([*enc(r.text or ""), 0])
    check_packing(packing.pack(odd).collect(), want)
    assert packing.pack(odd.limit(0)).count() == 0


def test_fast_tokenizer_gives_the_ids_of_the_other():
    fast, slow = packing.tokenizer(), encoder()
    for t in ("<|endoftext|> it's 12,5 € \n\n  x", "a" * 3000, "é ü 漢字 🙂", "\n" * 2000 + " a", "word " * 40_000, "ab  cd\t\tef " * 20_000):
        assert fast(t) == slow(t)


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header>Site head</header><nav><ul><li>Menu</ul></nav><div class="sidebar">Side</div>
<div id="cookie-notice">We use cookies</div><article><h1>Title {0}</h1><p>First &amp; para {0}<br>goes   on<p>Second {0} para</p><form><p>Sign up</p></form><p>Read more on our site</p></article>
<section class="comments"><p>Nice post {0}</p></section><aside>Ads</aside><footer>&copy; us</footer></body></html>"""


def test_html_extraction(spark):
    got = html.extract_group([PAGE.format(i) for i in range(8)])
    assert got[3] == "Title 3\n\nFirst & para 3 goes on\n\nSecond 3 para"  # the repeated line belongs to the template
    assert html.extract_group([PAGE.format(1)]) == ["Title 1\n\nFirst & para 1 goes on\n\nSecond 1 para\n\nRead more on our site"]
    plain = "<div id=nav>Menu</div><div><p>Only text here, long enough<p>and more of it</div><div class=ad>Buy</div>"
    assert html.extract_group([plain]) == ["Only text here, long enough\n\nand more of it"]
    odd = spark.createDataFrame([(1, None, None), (2, "http://h/x", ""), (2, "http://h/x", ""), (None, "not a url", "<p>a<b>b</b> &#x41;"), (3, "http://h/y", "<" * 50_000), (4, "http://h/z", "x" * 300_000)], "page_id long, url string, html string")
    out = html.extract(odd.withColumn("host", F.lit("clash")))
    assert out.count() == 6 and {r.text for r in out.where("page_id is null").collect()} == {"ab A"}
    assert html.extract(odd.limit(0)).count() == 0


def test_copies_of_an_article_are_not_its_hosts_template():
    text = "Title {0}\n\nFirst & para {0} goes on\n\nSecond {0} para"
    assert html.extract_group([PAGE.format(1)] * 6) == [text.format(1) + "\n\nRead more on our site"] * 6
    copies = [PAGE.format("copied" * 20).replace("Sign up", f"Sign up {i}").replace("<p>Read", f"<p>Seen {i} times</p><p>Read") for i in range(14)]
    got = html.extract_group(copies + [PAGE.format(i) for i in range(6)])
    assert got[:14] == [text.format("copied" * 20) + f"\n\nSeen {i} times" for i in range(14)]
    assert got[14:] == [text.format(i) for i in range(6)]
    only = [f"<article><p>All there is</p></article><p>Beside {i}</p>" for i in range(8)]
    assert html.extract_group(only) == ["All there is"] * 8


def test_all_unmarked_text_of_the_slots_is_kept():
    def one(page):
        return html.extract_group([page])[0].split("\n\n")

    assert one("<div>Out</div><main><h1>Title</h1><p>Lede</p><article><p>Long text of it</article><div class=sidebar>Side</div></main>") == ["Title", "Lede", "Long text of it"]
    assert one("<article><p>The longer part</p></article><article><p>Part</p></article>") == ["The longer part", "Part"]
    assert one("<body><h1>Title</h1><div class=content><p>Text that is long<p>and goes on</div><div><p>More</div>") == ["Title", "Text that is long", "and goes on", "More"]
    assert one(f"<h1>Title</h1><p>Before</p><pre>{'code ' * 50}</pre><p>After</p>") == ["Title", "Before", ("code " * 50).strip(), "After"]
    assert one("<h1 class='post tags'>T</h1><div class='ad-free related-work'><p id=search>A</p></div><p data-id=nav title='so hidden'>B <span class=notice>C</span></p>") == ["T", "A", "B C"]
    assert one("<article><section id=discussion><p>A</section><div class=notice>B</div><div class='x social-share'>C</div></article>") == ["A", "B"]
    assert one("<p>A</p><div id=cookie-notice>B</div><div class='x comments'>C</div><p hidden>D</p><div role=navigation>E</div>") == ["A"]


def test_texts_depend_on_neither_partitions_nor_page_size(spark):
    rows = [(i, f"http://h{i % 5}/{i}", PAGE.format(i)) for i in range(30)] + [(i, f"http://big/{i}", PAGE.format(i)) for i in range(100, 400)]
    rows += rows[:1] * 20
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = Counter((i, f"Title {i}\n\nFirst & para {i} goes on\n\nSecond {i} para") for i, _, _ in rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (3, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert Counter((r.page_id, r.text) for r in html.extract(df.repartition(n), group=16).collect()) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    long = spark.range(6).selectExpr("id AS page_id", "'http://l/' || id AS url", "'<article><p>Own ' || id || '<p>' || repeat(id || ' ', 4500000) || '<p>Read more on our site</article>' AS html")
    assert html.extract(long).where("text like 'Own%' and text not like '%Read more%' and n_chars > 9000000").count() == 6


def test_template_classes_are_ordered_and_nested():
    pages = [["a", "b", f"x{i}", "c", "d"] for i in range(6)]
    assert html.template(pages) == {"a", "b", "c", "d"}
    assert html.template(pages[:3]) == set()
    assert not {"b", "c"} <= html.template([["a", "b", "c"], ["a", "c", "b"]] * 3)


def brute_template(pages):
    """Classes of equal occurrence vectors, those in one order on each page, without those that cross one that counts before."""
    least, n = max(html.SUPPORT, html.SHARE * len(pages)), len(pages)
    vectors = {t: tuple(p.count(t) for p in pages) for p in pages for t in p}
    classes = defaultdict(set)
    for t, v in vectors.items():
        if sum(c > 0 for c in v) >= least and len(set(v) - {0}) == 1:
            classes[v].add(t)
    kept = []
    for v, own in sorted(classes.items(), key=lambda x: (-sum(c > 0 for c in x[0]), -len(x[1]))):
        seen = [[t for t in p if t in own] for p in pages]
        unit = next(s for s in seen if s)[: len(own)]
        if any(s and s != unit * max(v) for s in seen):
            continue
        crossing = False
        for other in kept:
            for p in pages:
                a, b = ([i for i, t in enumerate(p) if t in c] for c in (own, other))
                gaps = lambda x, y: len({sum(j < i for j in y) for i in x})
                crossing |= bool(a and b and gaps(a, b) > 1 and gaps(b, a) > 1)
        if not crossing:
            kept.append(own)
    return set().union(*kept)


def test_template_and_slots_against_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(150):
        base = [str(x) for x in rng.integers(0, 9, 8)]
        pages = []
        for k in range(int(rng.integers(4, 9))):
            page = [t for t in base if rng.random() > 0.1]
            for at in sorted(rng.integers(0, len(page) + 1, 3), reverse=True):
                page.insert(at, f"own {k} {at}")
            pages.append(page)
        # classes of as many pages and tokens have no order among them, so such pages are left out
        sizes = Counter((sum(t in p for p in pages), 0) for t in {t for p in pages for t in p})
        found = html.template(pages)
        assert found <= {t for t in base}
        if len(sizes) == len({tuple(p.count(t) for p in pages) for p in pages for t in p}):
            assert found == brute_template(pages)
        for p in pages:
            code = {t: i for i, t in enumerate(sorted(set(p)))}
            slot = html.slots(np.array([code[t] for t in p]), np.array(sorted(code[t] for t in found if t in code), dtype=np.int64))
            for i, t in enumerate(p):
                assert slot[i] == (-1 if t in found else sum(x in found for x in p[:i]))


def test_classes_that_cross_are_left_out():
    assert html.template([["a", "x", "b", f"{k}"] for k in range(5)] + [["a", "b"], ["a", "b"]]) == {"a", "x", "b"}
    assert html.template([["a", "x", "b", "y"]] * 5 + [["a", "b"]] * 2) == {"a", "b"}  # x and y cross a and b
    assert html.nested([1, 5], [2, 3]) and html.nested([2, 3], [1, 5]) and html.nested([1, 2], [3, 4]) and not html.nested([1, 3], [2, 4])


@pytest.mark.parametrize("page", ["<a " * 350_000, "<a " * 350_000 + ">", '<a "' * 250_000 + ">", "<a '>\" " * 150_000, "<div>" * 100_000, "<p><ul>" * 70_000, "<script>" + "</script " * 100_000, "<!--" * 200_000, "</div>" * 150_000, "<" * 1_000_000])
def test_hostile_pages_take_time_in_proportion(page):
    began = time.perf_counter()
    html.extract_group([page])
    assert time.perf_counter() - began < 4


def test_scanner():
    got = [x for x in html.scan("a<b c='>'>d<!-- <p> -->e</B >f<script>x<p></script>g<h 1 < 2") if x != ("text", "", "")]
    assert got == [("text", "a", ""), ("open", "b", " c='>'"), ("text", "d", ""), ("text", "e", ""), ("close", "b", ""), ("text", "f", ""), ("text", "g<h 1 < 2", "")]


def test_quality_features_and_cascade(spark, docs, rows):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for k, r in rows.items():
        w = WORD.findall(r.text or "")
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many = {g for g, n in Counter(tri).items() if n > 1}
        hit = {i + j for i, g in enumerate(tri) if g in many for j in range(3)}
        g = got[k]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), len(hit))
        assert g.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (g.kept and g.base_failed)
    assert sum(g.kept for g in got.values()) > 0.6 * len(got)
    odd = odd_documents(spark)
    assert quality.judge(odd).count() == odd.count() and quality.judge(odd.limit(0)).count() == 0


def test_the_order_of_rules_changes_no_verdict(docs):
    some = [r.text for r in docs.limit(150).collect()]
    raw = [x.encode() for x in some]
    t = texts.Texts(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    f = quality.features(t)
    alive = np.ones(t.n, dtype=bool)
    one, other = (quality.cascade(t, f, order, alive) < 0 for order in (quality.RULES, quality.RULES[::-1]))
    assert (one == other).all() and set(quality.ordered(some)) == set(quality.RULES)


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:10] + rng.normal(0, 0.25, (10, 16)), base[:5] * 3.0, base[:1].repeat(30, 0)]).astype(np.float32)
    made = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    extra = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] + [1.0] * 15), (1004, []), (1005, [1.0, 2.0]), (None, made[0][1]), (1006, [1e-30] * 16), (1007, [3e37] * 16)]
    df = spark.createDataFrame(made + extra, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vectors.join(df.withColumns({"rep": F.lit(1), "m": F.lit(2)}), block=32).collect()}
    y = np.concatenate([x.astype(np.float64), np.ones((2, 16)), x[:1].astype(np.float64)])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    ids = [*range(len(x)), 1006, 1007, None]
    near = (y @ y.T >= 0.9) & ~np.eye(len(y), dtype=bool)
    label = np.arange(len(y))
    for _ in range(len(y)):
        label = np.minimum(label, np.where(near, label[None, :], len(y)).min(axis=1))
    for i, k in enumerate(ids):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (near[i].sum(), ids[label[i]], ids[label[i]] == k)
    assert all(got[k].n_links == 0 and got[k].kept for k in range(1000, 1006))
    assert vectors.join(df.limit(0)).count() == 0


def test_quantisation_bound_holds():
    x = np.random.default_rng(1).normal(size=(200, 33)) ** 3
    q, s, e = vectors.quantise(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    off = np.abs(u @ u.T - (q * s[:, None]) @ (q * s[:, None]).T)
    assert (off <= e[:, None] + (1 + e[:, None]) * e[None, :] + 1e-12).all()


def oracle(name, folder=SMALL):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet{'/*.parquet' if folder != SMALL else ''}'")
    return con.execute(queries.ORACLE[name])


def repeated_ids(spark, tmp_path):
    """The small tables, with rows of other texts and vectors under ids that are there already."""
    docs, vecs = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "embeddings"))
    docs.unionByName(docs.where("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 1)).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    vecs.unionByName(vecs.where("vec_id % 3 = 0").withColumn("vec_id", F.col("vec_id") + 1)).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["op4_embedding_neardup", "op5_ngram_jaccard_join", "op6_suffix_array_dedup", "op10_mixing", "op3_quality_rules"])
@pytest.mark.parametrize("repeated", [False, True])
def test_against_sql(spark, tmp_path, name, repeated):
    folder = repeated_ids(spark, tmp_path) if repeated else SMALL
    want = oracle(name, folder)
    cols = [c[0] for c in want.description]
    got = queries.queries()[name](spark, folder).select(*cols)
    close = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert Counter(close(r) for r in got.collect()) == Counter(close(r) for r in want.fetchall())


def test_links_of_documents_longer_than_a_block_count_once(spark):
    words = [f"w{i}" for i in range(300)]
    for k in (0, 7):  # two or three copies with another last word, dealt to as many blocks, of which one is empty
        made = [(100 * k + i, " ".join([*words, f"x{i}"])) for i in range(2 + k % 3)]
        got = neardup.join(spark.createDataFrame(made, "doc_id long, text string"), block=300).collect()
        assert [(r.n_links, r.component_id) for r in got] == [(len(made) - 1, 100 * k)] * len(made)


def test_near_duplicates_of_odd_documents(spark):
    odd = odd_documents(spark)
    got = neardup.join(odd)
    assert got.count() == odd.count()
    by = {r.doc_id: r for r in got.collect()}
    assert (by[4].n_links, by[5].component_id, by[5].kept) == (1, 4, False) and by[7].component_id == 6 and by[6].n_links == 2
    assert by[1].n_links == 0 and by[1].kept and by[None].kept
    rest = neardup.one_of_each(odd)
    assert rest.columns == odd.columns and Counter(r.doc_id for r in rest.collect()) == Counter([1, 2, 3, 4, 6, None, 8, 9, 10, 11])
    assert neardup.join(odd.limit(0)).count() == 0


def test_large_group_in_many_blocks(spark):
    """Links counted over many small blocks are those of one block."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    made = [(d, " ".join("x" + str(rng.integers(9)) if rng.random() < 0.012 else w for w in base)) for d in range(80)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(116)} for _, t in made]
    want = [sum(1 for j, b in enumerate(sets) if j != i and len(a & b) / len(a | b) >= 0.8) for i, a in enumerate(sets)]
    for block in (1 << 18, 900):
        assert [r.n_links for r in neardup.join(df, block=block).orderBy("doc_id").collect()] == want


def test_depth_shortens_until_the_recall():
    assert neardup.depth_for(0.8, 40, 16, 0.9999) == 7 and neardup.depth_for(0.8, 1, 16, 0.99) == 1
    assert neardup.least_similarity(3, 0.8) is None and neardup.least_similarity(4, 0.8) == 0.8 and neardup.least_similarity(7, 0.8) == 6 / 7
    need = neardup.depths(0.8, 40, 16, 0.9999)
    assert list(need[:4]) == [0] * 4 and need[4] == 7 and need[7] > 7 and need[-1] == 7


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_forest_finds_pairs_at_each_similarity(similarity):
    rng = np.random.default_rng(int(100 * similarity))
    n, pairs = 180, 1500
    common = round(2 * n * similarity / (1 + similarity))
    need = neardup.depths(0.8, 40, 16, 0.9999)
    found = 0
    for _ in range(pairs):
        x = rng.integers(0, 1 << 48, 2 * n - common, dtype=np.uint64)
        m = neardup.minima(np.concatenate([x[:n], x[n - common :]]), np.array([n, n]), 40 * int(need.max())).reshape(2, 40, -1)
        found += bool((m[0, :, : need[-1]] == m[1, :, : need[-1]]).all(axis=1).any())
    assert found >= 0.998 * pairs


def test_final_nodes_against_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(30):
        n = 60
        tree, label, need = rng.integers(0, 2, n).astype(np.int32), rng.integers(0, 2, (n, 5)).astype(np.uint8), rng.integers(2, 6, n).astype(np.int32)
        order = np.lexsort((*label.T[::-1], tree))
        tree, label, need = tree[order], label[order], need[order]

        def of(k):  # the node at which a member's prefix is short enough
            for d in range(2, 6):
                own = [j for j in range(n) if tree[j] == tree[k] and (label[j, :d] == label[k, :d]).all()]
                if min(need[own]) <= d:
                    return own
            return [k]

        node = neardup.final_nodes(tree, label, need, 2)
        for k in range(n):
            assert [j for j in range(n) if node[k] and node[j] == node[k]] == (of(k) if len(of(k)) > 1 else [])


def test_long_nodes_stay_whole_and_equal(spark):
    rows = [(t, bytes([t, 1, k % 3]), 2 if k else 3, k) for t in range(3) for k in range(40)] + [(0, bytes([9, 9, 9]), 2, 99)]
    df = spark.createDataFrame(rows, "tree int, label binary, need int, rep long").repartition(1).sortWithinPartitions("tree", "label", "rep")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        one, other = ({(r.node, r.tree, r.rep) for r in neardup._nodes(df, 2, held).collect()} for held in (1000, 5))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert one == other and len(one) == 120 and len({n for n, *_ in one}) == 3


def test_rows_that_share_an_id_keep_their_own_links(spark):
    a, b = "a b c d e f g h i j", "q w e r t y u i o p"
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " y"), (None, b + " y"), (None, "alone here")], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_links, r.component_id) for r in neardup.join(df).collect())
    assert got == Counter([(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (None, 2, 1), (None, 0, None)])
    assert Counter((r.doc_id, r.text) for r in neardup.one_of_each(df).collect()) == Counter([(1, a), (1, b), (None, "alone here")])
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0])], "vec_id long, embedding array<float>")
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in vectors.join(vec).collect()) == Counter([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)])


def test_passages_of_rows_that_share_an_id(spark):
    long, passage = " ".join(f"l{i}" for i in range(3000)), " ".join(f"p{i}" for i in range(60))
    other, clean = " ".join(f"o{i}" for i in range(60)), " ".join(f"u{i}" for i in range(3500))
    df = spark.createDataFrame([(6, f"{long} {passage}"), (6, other), (7, passage)], "doc_id long, text string")
    assert {(r.doc_id, r.start_word, r.n_words, r.duplicate) for r in passages.spans(df).collect()} == {(6, 3000, 60, False), (7, 0, 60, True)}
    df = spark.createDataFrame([(5, passage), (6, f"{long} {passage}"), (6, clean), (6, clean), (8, passage), (8, passage)], "doc_id long, text string").withColumn("version", F.lit(3))
    assert Counter((r.doc_id, r.text) for r in passages.without_repeats(df).collect()) == Counter([(5, passage), (6, long), (6, clean), (6, clean)])


def test_word_keys_that_collide_cut_nothing_wrong(spark, monkeypatch):
    """With few bits of the suffixes' keys and of the windows' hash, the proof still tells windows apart."""
    rng = np.random.default_rng(4)
    clean = [(k, " ".join(f"w{x}" for x in rng.integers(0, 400, 300))) for k in range(40)]
    df = spark.createDataFrame(clean, "doc_id long, text string")
    shared = " ".join(f"s{i}" for i in range(70))
    both = spark.createDataFrame([*clean, (100, shared), (101, f"x {shared}")], "doc_id long, text string")
    plain = passages._windows

    def weak(*args):
        return plain(*args).withColumn("hash", F.col("hash") % 8)

    monkeypatch.setattr(passages, "_windows", weak)
    assert passages.spans(df).count() == 0
    assert {(r.doc_id, r.start_word, r.n_words, r.first_doc_id) for r in passages.spans(both).collect()} == {(100, 0, 70, 100), (101, 1, 70, 100)}


def test_passages_are_cut_and_clean_text_stays(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    short = " ".join(f"t{i}" for i in range(49))
    a, b, c, d = f"a1 a2\n{shared} a3", f"b1  {shared}\n b2", f"c1 {short} c2", f"d1 {short} d2"
    df = spark.createDataFrame([(1, a), (2, b), (3, c), (4, d), (5, shared)], "doc_id long, text string").withColumn("own_spans", F.lit(1))
    got = {(r.doc_id, r.start_word, r.n_words, r.duplicate, r.first_doc_id) for r in passages.spans(df).collect()}
    assert got == {(1, 2, 60, False, 1), (2, 1, 60, True, 1), (5, 0, 60, True, 1)}
    rest = {r.doc_id: r.text for r in passages.without_repeats(df).collect()}
    assert rest == {1: a, 2: "b1  b2", 3: c, 4: d}
    odd = odd_documents(spark)
    assert passages.without_repeats(odd).columns == odd.columns and passages.spans(odd.limit(0)).count() == 0
    assert {r.doc_id for r in passages.spans(odd).collect()} == {6, 7}


def test_sharding(spark, docs):
    for df in (docs, odd_documents(spark)):
        got, n = sharding.shard(df).collect(), df.count()
        assert len(got) == n
        for s in range(8):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    sizes = Counter()
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in sharding.shard(docs).collect():
        sizes[r.shard] += r["size"]
        assert r["size"] == len(rows[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(rows[r.doc_id].encode())
    assert max(sizes.values()) - min(sizes.values()) <= max(len(t.encode()) + 1 for t in rows.values())
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    counts = Counter(r.shard for r in sharding.shard(hot).collect())
    assert len(counts) == 8 and max(counts.values()) < 1.3 * min(counts.values())
    assert sharding.shard(docs.limit(0)).count() == 0


def test_equal_texts_stay_together_and_null_ids_are_dealt(spark, docs):
    found = sharding.shard(docs).join(docs.select("doc_id", "text"), "doc_id")
    assert found.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    hot = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.col("id").alias("grp"), F.lit(1).alias("row"), F.lit(2).alias("part"))
    counts = Counter(r.shard for r in sharding.shard(hot).collect())
    assert len(counts) == 8 and max(counts.values()) < 1.3 * min(counts.values())


def test_shard_law_against_brute_force(spark):
    """Bytes are within the largest item of each other, as greedy placement in descending size gives at worst."""
    rng = np.random.default_rng(2)
    made = [(k, "w " * int(rng.pareto(1.2) * 20 + 1)) for k in range(1500)]
    made += [(2000 + k, "copied text of a group " * 30) for k in range(40)]
    got = sharding.shard(spark.createDataFrame(made, "doc_id long, text string")).collect()
    sums = Counter()
    for r in got:
        sums[r.shard] += r["size"]
    groups = Counter()
    for k, t in made:
        groups[t] += len(t) + 1
    assert max(sums.values()) - min(sums.values()) <= max(max(len(t) for _, t in made) + 1, max(v for v in groups.values() if v <= sum(groups.values()) / 16))
    assert Counter((r.doc_id, r["size"], r.tokens) for r in got) == Counter((k, len(t) + 1, len(t.split())) for k, t in made)


def test_mixing_with_very_uneven_weights(spark):
    """Many documents of low weight: sums and cut against a plain sort of the keys."""
    rng = np.random.default_rng(6)
    made = [(k, ("# " * 9 if k % 3 else "word ") * int(rng.integers(1, 20)), "ab"[k % 7 == 0]) for k in range(4000)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    keys = {r.doc_id: r for r in mixing.keyed(df).collect()}
    goals = {r.source: r for r in mixing.targets(mixing.keyed(df)).collect()}
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    for source, goal in goals.items():
        own = sorted((r for r in keys.values() if r.source == source), key=lambda r: r.key)
        epochs = int(goal.target / goal.source_size + 1e-12)
        left = round(goal.target - epochs * goal.source_size)
        for r in own:
            some = min(r["size"], max(0, left))
            assert got[r.doc_id].taken == epochs * r["size"] + some
            left -= some


def test_padding_does_not_grow_with_partitions(spark, docs):
    found = packing.pack(docs.repartition(150)).agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("s")).first()
    assert found.n / 1024 / found.s > 0.99


def test_written_tables_are_deleted(spark):
    from kaivo.llm import scratch

    before = scratch.RUN
    scratch.RUN = "kaivo-test"
    try:
        table = scratch.written(spark.range(5), "x")
        assert table.count() == 5
        scratch.clean_up(spark)
        with pytest.raises(Exception):  # noqa: B017
            spark.read.parquet(table.inputFiles()[0])
    finally:
        scratch.RUN = before


def test_small_tables_are_few_files_however_many_the_partitions(spark):
    from kaivo.llm import scratch

    keys = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        counts = spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n"))
        table = scratch.written(counts, "small")
        assert len(table.inputFiles()) == 1  # each file is a task attempt and processes of its own
        assert {tuple(r) for r in table.collect()} == {(k, 5) for k in range(1000)}
        assert len(scratch.written(counts, "apart", gather=False).inputFiles()) > 32
        large = spark.range(1 << 40)  # 8 TB by estimate: its partitions stay
        assert scratch.gathered(large) is large
        # ids by position are given once, and rows shuffled no further
        nodes = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit(f"w{k}x"), (F.col("id") % 100).cast("string")) for k in range(12))).alias("text"))
        found = neardup.join(nodes)
        assert found.count() == 300 and found.where("kept").count() == 100 and found.where("n_links = 2").count() == 300
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_licenses_against_brute_force(spark, docs):
    made = [(1, "Licensed under CC BY-NC 4.0."), (2, "cc by cc-by CC/BY"), (3, "All rights, reserved. all rights  RESERVED"), (4, "Released under the MIT License."), (5, "general public licenses"), (6, None), (7, ""), (7, ""), (None, "cc by"), (8, "Éacc by"), (9, "the apache tribe; a license")]
    df = spark.createDataFrame(made, "doc_id long, text string").withColumn("w", F.lit("clash"))
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    base = {label: p.split() for label, p in licenses.BASE}
    for table in (df, docs.select("doc_id", "text")):
        want = Counter()
        for r in table.collect():
            w = pattern.findall((r.text or "").translate(lower))
            places = [(i, label) for label, p in base.items() for i in range(len(w)) if w[i : i + len(p)] == p]
            want[r.doc_id, len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))] += 1
        got = licenses.scan(table).collect()
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    labels = {r.doc_id: r.labels for r in licenses.scan(df).collect()}
    assert labels[1] == "cc-by,cc-by-nc" and labels[4] == "mit" and labels[5] == "" and labels[9] == ""
    assert licenses.scan(df.limit(0)).count() == 0


def brute_labels(texts):
    """Labels and scores by trying every template at every place of every text."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    files = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower)) for t in texts]
    idf = {w: np.log((len(files) + 1) / (sum(w in f for f in files) + 0.5)) for _, t, ps in licenses.TEMPLATES for x in (t, *ps) for w in x.split()}
    has = lambda f, p: any(f[i : i + len(p)] == p for i in range(len(f)))
    out = []
    for f in files:
        base = {label for label, p in licenses.BASE if has(f, p.split())}
        found = {}
        for label, t, ps in licenses.TEMPLATES:
            t = t.split()
            rare = sorted(set(t), key=lambda w: (-idf[w], w))[: licenses.RARE]
            spots = [(i, w) for i, w in enumerate(t) if w in rare]
            best = max((sum(idf[w] for i, w in spots if 0 <= at + i < len(f) and f[at + i] == w) for at in range(-len(t), len(f))), default=0) / sum(idf[w] for _, w in spots)
            if best >= licenses.MATCH - 1e-9 and all(has(f, p.split()) for p in ps):
                found[label] = max(found.get(label, 0), best)
        out.append((",".join(sorted(base | set(found))), round(1.0 if base else min(1.0, max(found.values(), default=0)), 9)))
    return out


def test_license_labels_against_brute_force(spark, rows):
    made = [f"{'x ' * (k % 7)}{t}{' y' * (k % 3)}" for k, (_, t, _) in enumerate(licenses.TEMPLATES)]
    made += [" ".join(w for i, w in enumerate(t.split()) if i % 9 != k % 9) for k, (_, t, _) in enumerate(licenses.TEMPLATES)]
    made += ["Apache-2.0 SPDX-License-Identifier: MIT", "SPDX-License-Identifier: GPL-3.0-or-later", None, "", "license " * 50, "the MIT license is one; permission is asked"]
    made += [r.text for r in rows.values() if r.text and len(r.text) < 3000 and re.search("licen|reserved|CC", r.text)][:60]
    want = brute_labels(made)
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in licenses.scan(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(made))] == want
    at = 2 * len(licenses.TEMPLATES)
    assert got[at][0] == "mit" and got[at + 1][0] == "gpl" and all(got[k][0] for k in range(len(licenses.TEMPLATES)))


def test_language_id_on_held_out_documents(spark):
    found = queries.op9_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    right, n, rejected = found.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*"), F.sum(F.col("rejected").cast("int"))).first()
    assert n > 200 and right > 0.97 and rejected <= 0.02 * n


def test_language_id_of_odd_documents(spark):
    odd = odd_documents(spark)
    got = langid.identify(odd, langid.fit(odd)).collect()
    assert len(got) == odd.count() and all((r.lang_pred == "und" and r.rejected) for r in got if r.doc_id in (1, 2, 3, 9, 11))
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"} and langid.fit(odd.limit(0)) is None


def test_mixing_targets(spark, docs):
    got = queries.op10_mixing(spark, SMALL).join(docs.select("doc_id", "source"), "doc_id")
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect():
        assert abs(r.taken - r.target) <= 1 and r.target <= 3 * r["size"] + 1e-6
    assert got.where("taken > 3 * size").count() == 0
    total, size = got.agg(F.sum("taken"), F.sum("size")).first()
    assert abs(total - size) <= 20
    odd = odd_documents(spark)
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(odd.limit(0)).count() == 0
    words = mixing.mixed(docs).select(F.sum(mixing.size(F.col("text")))).first()[0]
    assert words == total and mixing.mixed(odd).columns == odd.columns


def test_pipeline_keeps_columns_and_clean_documents(spark, docs):
    import corpus_pipeline

    now = odd_documents(spark).unionByName(docs.withColumns({c: F.lit(None) for c in ("key", "size", "grp", "rep", "w")}))
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SMALL).cache()
        if name != "packed":
            assert now.columns == columns, name
        assert now.count() > 100
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_repeats_move_only_texts_that_hold_anchors_and_keep_no_hashes(spark, monkeypatch):
    """What op6 keeps on disks: texts without an anchor stay where they are read; hashes are kept for the ends of ranges alone."""
    shared = " ".join(f"s{k}" for k in range(80))
    texts_ = [f"{shared} x{i}" if i % 100 == 0 else " ".join(f"w{i}x{k}" for k in range(60)) for i in range(1000)]
    docs = spark.createDataFrame([*enumerate(texts_), (None, shared), (5000, None)], "doc_id long, text string")
    seen, tables = [], {}
    moved, stored = passages._windows, passages.written

    def windows(anchored, *args):
        plan = anchored._jdf.queryExecution().optimizedPlan().toString()
        seen.append((anchored.count(), "LeftSemi" in plan))
        return moved(anchored, *args)

    def written(df, name, **kwargs):
        tables[name] = stored(df, name, **kwargs)
        return tables[name]

    monkeypatch.setattr(passages, "_windows", windows)
    monkeypatch.setattr(passages, "written", written)
    found = passages.spans(docs).collect()
    assert {(r.doc_id, r.start_word, r.n_words, r.duplicate, r.first_doc_id) for r in found} == {(i, 0, 80, i > 0, 0) for i in range(0, 1000, 100)}
    assert seen[0][0] >= 10 and seen[0][1]  # filtered before the shuffle
    met = tables["met"]
    assert met.where("run = 0").count() > 0 and met.where("run = 0 and (hash is not null or proof is not null)").isEmpty()
    assert met.where("run > 0 and (hash is null or proof is null)").isEmpty()


@pytest.mark.parametrize("most", [1 << 27, 1 << 15, 64])
def test_no_key_is_lost_by_the_bitmap(spark, most):
    """Every key passes at any size of the bitmap; with enough bits few others do."""
    docs = spark.range(20_000).select((F.col("id") * 7919 - 5000).alias("doc_id"), (F.col("id") % 3 - 1).alias("version"), F.col("id").cast("string").alias("text"))
    keys = docs.where("text % 10 = 3").select("doc_id", "version")
    found = passages._among(docs, keys, keys.count(), most)
    assert found.columns == docs.columns
    assert keys.exceptAll(found.select("doc_id", "version")).isEmpty()
    if most == 1 << 27:
        assert found.count() < 3000
    assert passages._among(docs, keys.limit(0), 0, most).isEmpty()


def test_own_tables_and_stages_are_few_plain_files(spark, tmp_path):
    """Each file written to a local file system starts processes that count an executor's memory twice."""
    import os

    import corpus_pipeline
    from kaivo.llm import graph, scratch

    table = scratch.written(spark.range(100), "plain", gather=False)
    folder = os.path.dirname(table.inputFiles()[0].removeprefix("file://"))
    assert table.count() == 100 and all(x.endswith(".parquet") for x in os.listdir(folder))  # no checksums, no mark
    wide = spark.range(0, 5000, 1, 64)
    assert wide.rdd.getNumPartitions() == 64
    assert len(scratch.written(wide, "counted", rows=5000).inputFiles()) == 1
    assert scratch.gathered(spark.range(0, 1 << 40, 1, 64), rows=1 << 40).rdd.getNumPartitions() == 64
    edges = wide.select(F.col("id").alias("a"), (F.col("id") % 10).alias("b"))
    found = graph.components(edges, 5000)
    assert found.count() == 5000 and found.where("component = node % 10").count() == 5000
    # small partitions of a stage's input are read together, large ones stay
    spark.createDataFrame([(k, f"the {k} of the and a house {k}", "en", "s") for k in range(64)], "doc_id long, text string, lang string, source string").repartition(64).write.parquet(str(tmp_path / "docs"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "128m")
        docs = spark.read.parquet(str(tmp_path / "docs"))
        assert docs.rdd.getNumPartitions() > 32
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert len(scratch.written(stage(spark, docs, ""), "stage", gather=False).inputFiles()) <= 2
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    large = spark.range(0, 1 << 40, 1, 64)
    assert scratch.together(large).rdd.getNumPartitions() == 64


@pytest.mark.parametrize("k", [3, 5, 6, 16, 25, 50])
def test_hashes_of_grams_tell_any_two_words_in_place(k):
    """Words that change places make another gram; a window of 50 with two neighbours exchanged was once taken for equal."""
    words = [f"w{i}" for i in range(k)]
    rows = [words] + [[words[j] if x == i else words[i] if x == j else w for x, w in enumerate(words)] for i in range(k) for j in range(i + 1, k)]
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(r) for r in rows])], names=["text"])
    for _, t in texts.slices(iter([batch])):
        t.hashed_words()
        assert len(np.unique(t.grams(k)[1])) == len(rows) == t.n
