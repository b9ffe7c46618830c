"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on awkward rows."""

import hashlib
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidewatch.llm import byte_cnn, components, decontaminate, dom, jaccard, licenses, pieces, pii, quality_rules, sharding, site_tree, warc
from tidewatch.llm.common import Scratch
from tidewatch.llm.components import connected_components

WORD = re.compile("[^\x20\x09-\x0d]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{k % 977}x{k}" for k in range(20_000))
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three four"), (6, "one two three four"), (6, "one two three four"),
    (7, LONG), (8, LONG + " tail"), (9, "é ü 漢字 \U0001f600 ▁x  y   z "), (10, "a\x0bb\x0cc\rd"), (None, "no id at all here"), (11, "x" * 5000),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with names that operators also use."""
    rows = [(i, t, "en", None, 0, "clash", 1, 2, "k") for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int, shard int, size string").repartition(3)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")


def test_quality_rules_match_sql(spark, docs):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/sf0.001/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(names)} FROM ({quality_rules.ORACLE_SQL}) ORDER BY 1").fetchall()
    got = quality_rules.quality_rules(docs).select(names).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_quality_rules_awkward(awkward, empty):
    out = {(r.doc_id, r.text): r for r in quality_rules.quality_rules(awkward).collect()}
    for (i, t), r in out.items():
        words = WORD.findall(t or "")
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {p for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for p in range(k, k + 5)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
    assert quality_rules.quality_rules(awkward).count() == len(AWKWARD) and quality_rules.quality_rules(empty).count() == 0


def test_a_filter_on_the_verdict_stays_linear(awkward):
    # the optimizer moves the filter below the projections; words must not be split anew for every window
    assert {r.doc_id for r in quality_rules.quality_rules(awkward).filter("kept").collect()} == {7, 8}


def test_repeats_overlap(spark):
    df = spark.createDataFrame([(1, "a b c d e f a b c d e f x"), (2, "a a a a a a a"), (3, "a b c d e")], "doc_id long, text string")
    assert [r.n_repeat_words for r in quality_rules.quality_rules(df).orderBy("doc_id").collect()] == [12, 7, 0]


def test_lines_go_first(spark):
    text = "A plain sentence with enough words to stay as it is.\n| home | about | contact |\nclick here\n" + "$$$ %%% &&& ###"
    (row,) = quality_rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.clean_text == "A plain sentence with enough words to stay as it is." and row.kept


def test_furniture_in_four_languages(spark):
    good = "Un texte simple avec assez de mots pour rester tel quel dans le corpus. "
    lines = ["Accept cookies", "Weiterlesen", "Mentions légales", "Leer más", "Haz clic para ver"]
    rows = [(k, good * 3 + "\n" + line) for k, line in enumerate(lines)] + [(9, good * 3 + "\n" + "Er las weiter und erfuhr mehr")]
    out = {r.doc_id: r.clean_text for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("\n" not in out[k].strip() for k in range(len(lines))) and "Er las weiter" in out[9]


def check_shards(rows, n):
    by_text = defaultdict(set)
    slots, loads = defaultdict(list), Counter()
    for r, t in rows:
        raw = (t or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n
        by_text[t or ""].add(r.shard)
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [loads[k] for k in range(n)]


def test_sharding(spark, docs, awkward, empty):
    texts = {r.doc_id: r.text for r in docs.collect()}
    sizes = check_shards([(r, texts[r.doc_id]) for r in sharding.shard_by_bytes(docs).collect()], 16)
    largest = max(len((t or "").encode()) + 1 for t in texts.values())
    assert max(sizes) - min(sizes) <= 2 * max(largest, sum(sizes) / 16 / 4)
    known = dict(AWKWARD)
    check_shards([(r, known[r.doc_id]) for r in sharding.shard_by_bytes(awkward, 4).collect()], 4)
    assert sharding.shard_by_bytes(empty).count() == 0


def test_sharding_with_a_hot_text(spark):
    rows = [(k, "hot text " * 20) for k in range(3000)] + [(k, f"text {k} " * (k % 30)) for k in range(3000, 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = dict(rows)
    sizes = sorted(check_shards([(r, texts[r.doc_id]) for r in sharding.shard_by_bytes(df).collect()], 16))
    assert sizes[-2] - sizes[0] <= 0.01 * sum(sizes)  # all but the hot text's own shard are near equal


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(n_bases, n_copies, seed=3):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for b in range(n_bases):
        base = [f"w{b}_{x}" for x in rng.integers(0, 4000, int(rng.integers(6, 120)))]
        for _ in range(int(rng.integers(1, n_copies))):
            words = list(base)
            for p in rng.integers(0, len(words), int(rng.integers(0, max(1, len(words) // 25) + 1))):
                words[p] = f"new{rng.integers(1 << 40)}"
            cut = int(rng.integers(0, max(1, len(words) // 6)))
            rows.append((k, " ".join(words[cut:])))
            k += 1
    return rows


@pytest.mark.parametrize("tile, light, flush, fan, told", [(1024, 5, 400_000, 512, 400_000), (16, 2, 400_000, 512, 0), (1024, 3, 300, 4, 400_000)])
def test_jaccard_join(spark, monkeypatch, tile, light, flush, fan, told):
    for name, value in {"TILE": tile, "ANCHORS": 3, "LIGHT": light, "FLUSH_KEYS": flush, "FAN": fan, "BROADCAST_DOCS": told}.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies(12, 40) + [(10_000 + i, t) for i, t in AWKWARD if i is not None and i != 6]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("tile, weight", [(1024, 250_000), (12, 1500)])
def test_jaccard_join_with_a_passage_that_many_share(spark, monkeypatch, tile, weight):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "TILE_SHINGLES", weight)
    rng = np.random.default_rng(9)
    passage = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join(passage + [f"u{k}_{j}" for j in range(int(rng.integers(8, 90)))])) for k in range(150)]
    rows += [(200 + k, " ".join(passage + [f"c{j}" for j in range(40 + k % 7)] + [f"z{k}"])) for k in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("flush, fan", [(400_000, 512), (4, 2)])
def test_jaccard_join_where_parts_have_only_common_keys(spark, monkeypatch, flush, fan):
    monkeypatch.setattr(jaccard, "FLUSH_KEYS", flush)
    monkeypatch.setattr(jaccard, "FAN", fan)
    rows = [(i, f"alpha beta gamma delta epsilon {'word' * (i % 9)}{i // 18}") for i in range(36)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == brute_components(rows)


def test_jaccard_memberships_of_many_flushes_go_to_many_partitions():
    flush = lambda k: jaccard._chunks(np.full(10, 7, np.uint64), np.arange(10 * k, 10 * k + 10), np.ones(10, np.int32), np.empty(0, np.uint64), None, 100, 0)
    assert len({r["part"] for k in range(60) for r in flush(k).to_pylist() if r["members"]}) > 20


def test_jaccard_awkward(awkward, empty):
    out = jaccard.jaccard_components(awkward).collect()
    assert len(out) == len(AWKWARD)
    assert {(r.doc_id, r.component_id) for r in out if r.doc_id in (1, 2, 3, 5, 6, 7, 8)} == {(1, 1), (2, 2), (3, 3), (5, 5), (6, 5), (7, 7), (8, 7)}
    assert jaccard.jaccard_components(empty).count() == 0


def test_bound_never_loses_a_link():
    rng = np.random.default_rng(5)
    for _ in range(30):
        base = rng.integers(0, 1 << 62, 200).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(200) < 0.93], rng.integers(0, 1 << 62, 8).astype(np.uint64)])) for _ in range(12)]
        root = list(range(12))
        for a, b in jaccard.link_sets(sets):
            old, new = root[b], root[a]
            root = [new if r == old else r for r in root]
        for a in range(12):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    assert root[a] == root[b]


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(components, "TASK_LINKS", most)
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1040)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()}
    assert got == {x: find(x) for x in root}


def test_pieces_with_small_tables_and_slices(spark, docs, monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 50)
    table, texts = pieces.ChunkTable(open(MODEL, "rb").read()), [r.text or "" for r in docs.collect()]
    for k in range(0, len(texts), 7):
        assert [(list(i), back) for i, back in table.rows(texts[k : k + 7])] == [(sp.encode(t), sp.decode(sp.encode(t))) for t in texts[k : k + 7]]


def test_pieces_match_the_library(spark, docs, awkward, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    odd = ["", " ", "  ", "a", " a", "a ", "a  b   c", "x▁y ▁ z", "tab\tand\nline \n\n next", "<s> </s> <unk> <0x0A>", "\x00a\x01", "漢字かな \U0001f600‍", "a b", "ﬁ １ é", "x" * 3000]
    table = pieces.ChunkTable(open(MODEL, "rb").read())
    for t, (ids, back) in zip(odd, table.rows(odd)):
        assert list(ids) == sp.encode(t) and back == sp.decode(sp.encode(t))
    for r in pieces.encode_pieces(docs, MODEL, keep=("doc_id", "text"), digests=True).collect():
        ids = sp.encode(r.text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    out = pieces.encode_pieces(awkward, MODEL, keep=("doc_id", "size")).collect()
    assert len(out) == len(AWKWARD) and all(r.ids == sp.encode(dict(AWKWARD)[r.doc_id] or "") for r in out)
    assert pieces.encode_pieces(empty, MODEL).count() == 0


PAGE = """<html><head><title>T &amp; U</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><nav><ul><li><a href="/a">home</a></ul></nav>
<!-- <p>hidden</p> --><div class="ad">buy</div><article><h1>Head</h1><p>One &eacute; &lt;b&gt;<br>two <b>bold<p>Next&nbsp;one<div id="comments"><p>reader</p></div><form><p>mail</p></form>
<ul><li>x<li>y</ul></article><aside>side</aside><footer>&copy; foot</footer></body></html>"""


def test_main_text():
    assert site_tree.main_text(PAGE) == "Head\n\nOne é <b> two bold\n\nNext one\n\nx\n\ny"
    assert site_tree.main_text(None) == "" and site_tree.main_text("") == "" and site_tree.main_text("<p 'q>z</p>") == "z"
    assert dom.read(PAGE)[1] == "T & U" and dom.read(PAGE)[2] == [("/a", "home")]


def test_extraction_of_all_pages(spark):
    pages = spark.read.parquet(f"{DATA}/sf0.001/pages.parquet")
    got = {r.page_id: r for r in site_tree.extract_main_text(pages).collect()}
    import html

    for r in pages.collect():
        body = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", s))).split()) for s in re.split("</?(?:p|h1)>", body)]
        assert got[r.page_id].text == "\n\n".join(p for p in parts if p) and got[r.page_id].n_chars == len(got[r.page_id].text)


def story(k, j=0):
    return f"Story {k} tells of the {k * 7 + j}th day and of things that happened {'again ' * (k % 5)}then"


def crawl(n, host="h.example"):
    """Pages of a host whose names say nothing: a repeated head, a link list, the story, a repeated line in it, a repeated end."""
    pages = []
    for k in range(n):
        body = "".join(f"<p>{story(k, j)}</p>" for j in range(1 + k % 4)) + f"<ul><li>point {k}</li></ul>" * (k % 3)
        links = "".join(f"<a href='/{k}{j}'>link {k}{j}</a> " for j in range(3))
        pages.append((k, f"http://{host}/{k}", f"<body><div class='x1'><p>Welcome to our site</p></div><div class='x2'>{links}</div>"
                      f"<div class='x3'>{body}<div class='q9'>Tell your friends about us</div></div><div class='x4'>All of this is ours</div></body>"))
    return pages


def expected(k):
    return "\n\n".join([story(k, j) for j in range(1 + k % 4)] + [f"point {k}"] * (k % 3))


PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("told", [100_000, 0])
def test_site_tree_decides_where_names_say_nothing(spark, monkeypatch, told):
    monkeypatch.setattr(site_tree, "BROADCAST_PATHS", told)
    pages = crawl(40) + [(99, None, None), (98, "http://other.example/", "<p>alone</p>"), (98, "http://other.example/", "<p>alone</p>"), (97, None, "<div class='x1'><p>y</p></div>")]
    df = spark.createDataFrame(pages, PAGES).withColumns({c: F.lit("clash") for c in ("host", "path", "row", "text", "stays")}).repartition(3)
    got = {r.page_id: r.text for r in site_tree.extract_main_text(df).collect()}
    assert [got[k] for k in range(40)] == [expected(k) for k in range(40)] and got[99] == "" and got[98] == "alone" and got[97] == "y"
    assert site_tree.extract_main_text(df).count() == 44 and site_tree.extract_main_text(df.limit(0)).count() == 0
    tree = {r.path: r.importance for r in site_tree.style_tree(df).collect()}
    least = site_tree.LEAST_IMPORTANCE
    assert {p for p, v in tree.items() if v < least} == {"body/div.x1", "body/div.x2", "body/div.x3/div.q9", "body/div.x4"} and tree["body/div.x3"] > 0.9


def test_site_tree_of_a_host_of_copies(spark):
    one = crawl(1)[0]
    pages = [(k, one[1] + str(k), one[2]) for k in range(500)] + [(1000 + k, *p[1:]) for k, p in enumerate(crawl(3))]
    got = {r.page_id: r.text for r in site_tree.extract_main_text(spark.createDataFrame(pages, PAGES)).collect()}
    assert all(story(0) in got[k] for k in range(500)) and all(story(k) in got[1000 + k] for k in range(3))


def test_site_tree_and_names(spark):
    page = lambda k: (f"<div class='notice-board'><p>{story(k)}</p>{'<p>More</p>' * (k % 2)}</div><div class='ad-box'>Buy {k * 31}</div><footer>&copy; {k}</footer>")
    both = lambda k: (f"<nav>n{k}</nav><article><header><h1>Title {k}</h1><p>by {k}</p></header><p>{story(k)}</p><div class='comments'><p>I say {k}</p></div></article><div class='ad'>Buy {k}</div>")
    pages = [(k, f"http://a.example/{k}", page(k)) for k in range(12)] + [(100 + k, f"http://b.example/{k}", both(k)) for k in range(12)]
    pages += [(200, "http://c.example/", page(1)), (201, "http://d.example/", both(1)), (202, "http://e.example/", "<article></article><div class='ad'>Buy</div><footer>f</footer>")]
    long = "<article>" + "".join(f"<p>{story(k)}</p>" for k in range(60_000)) + "</article><footer>f</footer>"
    got = {r.page_id: r.text for r in site_tree.extract_main_text(spark.createDataFrame([*pages, (300, "http://f.example/", long)], PAGES)).collect()}
    for k in (*range(12), 200):
        n = 1 if k == 200 else k
        assert got[k] == story(n) + "\n\nMore" * (n % 2)
    assert all(got[100 + k] == f"Title {k}\n\n{story(k)}" for k in range(12)) and got[201] == f"Title 1\n\n{story(1)}" and got[202] == ""
    assert got[300] == "\n\n".join(story(k) for k in range(60_000))


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = byte_cnn.classify_quality(docs, labels).join(labels, "doc_id").collect()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in out if r.held_out]
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_classifier_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    assert byte_cnn.classify_quality(awkward, labels).count() == len(AWKWARD)
    assert byte_cnn.classify_quality(awkward, labels.limit(0)).count() == len(AWKWARD) and byte_cnn.classify_quality(empty, labels).count() == 0


def test_chunks_cover_all_bytes():
    for n in (0, 1, 447, 448, 512, 513, 960, 961, 5000):
        tokens, starts, counts = byte_cnn.chunks(["a" * n, "b"])
        assert counts[0] * byte_cnn.STRIDE + byte_cnn.CHUNK - byte_cnn.STRIDE >= n and (tokens[starts[-1]] & 255) == ord("b")


def test_classifier_scores_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    net = byte_cnn.fit(["good words here " * 9, "x" * 200, "fine prose too " * 7, "yyyy " * 50], [1, 0, 1, 0])
    for n in (0, 5, 511, 512, 513, 448 * 7, 448 * 8 + 64, 448 * 8 + 65, 448 * 33 + 7):
        text = bytes(rng.integers(97, 100, n).astype(np.uint8))
        tokens, starts, counts = byte_cnn.chunks([(0, text)])
        monkeypatch.setattr(byte_cnn, "AT_ONCE", 8)
        pieces = list(byte_cnn.long_pieces(text))
        rest = [byte_cnn.window(*byte_cnn.chunks([p])[:2]) for p in pieces]
        assert np.array_equal(np.concatenate(rest), byte_cnn.window(tokens, starts))
        few = net.score([text])
        monkeypatch.setattr(byte_cnn, "AT_ONCE", 512)
        assert len(rest) == -(-counts[0] // 8) and net.score([text]) == pytest.approx(few, rel=1e-5)


def luhn(s):
    return sum(sum(divmod(int(ch) * (1 + i % 2), 10)) for i, ch in enumerate(reversed(s))) % 10 == 0


PRIVATE = {
    "mail": "anna.meier42@mail7.example.com", "phone": "+1 (017) 555-7713", "ip": "97.51.17.173", "card": "4111 1111 1111 1111",
    "ssn": "123-45-6789", "date": "1987-06-05", "european": "05.06.1987", "token": "04dbebab91ab85687d33eeaaf9ac699e1188f962",
}


def test_pseudonyms_keep_formats_and_link_values(spark):
    texts = [(k, f"before {v}, after {v}.") for k, v in PRIVATE.items()] + [("plain", "No 1234567890123456, 99.999.1.2 or 2023-02-31 here; v1.2.3.4.5")]
    rows = {r.k: r for r in pii.pseudonymize(spark.createDataFrame(texts, "k string, text string"), "secret").collect()}
    assert rows["plain"].text == dict(texts)["plain"] and rows["plain"].n_pii == 0
    for k, v in PRIVATE.items():
        new = re.fullmatch(r"before (.*), after (.*)\.", rows[k].text, re.S)
        assert new[1] == new[2] != v and rows[k].n_pii == 2
        assert re.fullmatch(pii.PATTERNS[{"mail": "email", "token": "hex", "european": "date"}.get(k, k)].replace("++", "+"), new[1])
        if k == "card":
            assert luhn(new[1].replace(" ", "")) and new[1][4] == " "


def test_pseudonyms_are_permutations(spark):
    days = spark.range(pii.DATE_A * pii.DATE_B).select("id", pii.permute_day(F.col("id"), "k").alias("d"))
    row = days.agg(F.countDistinct("d"), F.min("d"), F.max("d"), F.sum((F.col("id") == F.col("d")).cast("int"))).first()
    assert row[0] == pii.DATE_A * pii.DATE_B and row[1] == 0 and row[2] == row[0] - 1 and row[3] < 10
    digits = spark.range(1000).select(pii.feistel(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("d"))
    assert digits.distinct().count() == 1000
    ssn = spark.range(1, 600).select(pii._ssn(F.concat(F.lpad(F.col("id").cast("string"), 3, "0"), F.lit("-45-6789")), "k").alias("s"))
    assert ssn.distinct().count() == 599 and ssn.filter(~F.col("s").rlike(pii.PATTERNS["ssn"])).count() == 0


def test_hint_is_in_every_value(spark):
    hint = re.compile(pii.HINT)
    values = [*PRIVATE.values(), "a.b@c.de", "abcdef" * 6, "FEDCBA" * 6, "+1 234 567 8901", "(234) 567-8901", "1.2.3.4"]
    assert all(hint.search(v) for v in values) and not hint.search("no value in this text, beef cafe")
    (row,) = pii.pseudonymize(spark.createDataFrame([("only letters " + "abcdef" * 6 + " here",)], "text string"), "secret").collect()
    assert row.n_pii == 1 and "abcdefabcdef" not in row.text


def test_secrets_in_capitals(spark):
    tokens = ["9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "9233a8ECF7c5b09fe5949719B6b82bc439e9329b", "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"]
    texts = [(k, f"THE DOCUMENT IS IN CAPITALS. TOKEN = \"{v}\" AND {v}.") for k, v in enumerate(tokens)]
    new = set()
    for r in pii.pseudonymize(spark.createDataFrame(texts, "k int, text string"), "secret").collect():
        one, two = re.findall(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{40}(?![A-Za-z0-9])", r.text)
        assert one == two != tokens[r.k] and r.n_pii == 2
        assert r.k == 2 or [c.isupper() for c in one] == [c.isupper() for c in tokens[r.k]]
        new.add(one)
    assert len(new) == 3 and sum(t == t.lower() for t in new) == 1


def test_cards_beside_other_digits(spark):
    card, spaced = "4111111111111111", "4111 1111 1111 1111"
    texts = [f"{card} 12/27", f"{spaced} 123", f"room 12 {card}", f"1234 {spaced} 99", f"{card}-12", f"{spaced} {spaced} 7", f"{card} 12.5", f"7 {card} 8 {spaced} 9 " + "1 " * 3000]
    for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "secret").collect():
        assert card not in r.text and spaced not in r.text and r.n_pii >= 1, r.text[:99]
        assert re.sub(r"\d", "0", r.text) == re.sub(r"\d", "0", texts[r.k])
    rest = pii.pseudonymize(spark.createDataFrame([("123456 2023-05-01, 1234567 123-45-6789",)], "text string"), "secret").first()
    assert "2023-05-01" not in rest.text and "123-45-6789" not in rest.text and rest.n_pii == 2


def test_pii_of_all_documents(spark, docs, awkward, empty):
    before = {r.doc_id: r.text for r in docs.collect()}
    pattern = re.compile(pii.ANY)
    for r in pii.pseudonymize(docs, "secret").collect():
        found = [m[0] for m in pattern.finditer(before[r.doc_id])]
        private = [v for v in found if not re.fullmatch(r"\d(?:[ -]?\d){12,18}", v) or luhn(re.sub(r"\D", "", v))]
        assert r.n_pii == len(private) and not any(v in r.text for v in private)
        if not private:
            assert r.text == before[r.doc_id]
    out = {(r.doc_id, r.text) for r in pii.pseudonymize(awkward, "secret").collect()}
    assert out == set(AWKWARD) and pii.pseudonymize(empty, "secret").count() == 0


def brute_alignment(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for k, y in enumerate(b):
            row.append(max(0, above[k] + (2 if x == y else -1), above[k + 1] - 1, row[k] - 1))
        best, above = max(best, *row), row
    return best


def test_smith_waterman_matches_brute_force():
    rng = np.random.default_rng(4)
    items, passages, sizes = np.ones((40, 25), np.uint64), np.zeros((40, 60), np.uint64), rng.integers(1, 26, 40)
    for k in range(40):
        items[k, : sizes[k]] = rng.integers(2, 12, sizes[k])
        passages[k, : rng.integers(1, 61)] = 5
        passages[k] = np.where(passages[k] > 0, rng.integers(2, 12, 60), 0)
    score, _ = decontaminate.smith_waterman(items, sizes, passages)
    assert list(score) == [brute_alignment(items[k, : sizes[k]].tolist(), passages[k].tolist()) for k in range(40)]


def test_decontamination_finds_copies_and_edits(spark, awkward, empty):
    rng = np.random.default_rng(6)
    vocabulary = [f"v{k}" for k in range(3000)]
    items = [[str(w) for w in rng.choice(vocabulary, 40)] for _ in range(10)]
    filler = lambda n: [str(w) for w in rng.choice(vocabulary, n)]
    rows = []
    for k, item in enumerate(items):
        edited = list(item)
        for p in rng.integers(0, 40, 5):
            edited[p] = "changed"
        del edited[20]
        rows += [(3 * k, " ".join(filler(100) + item + filler(50))), (3 * k + 1, " ".join(filler(30) + edited + filler(80)).upper()), (3 * k + 2, " ".join(filler(200)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(100, None), (101, ""), (102, "two words")], "item_id long, text string")
    found = decontaminate.find_contamination(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(3 * k + j, k) for k in range(10) for j in (0, 1)}  # the item of two words is in none
    assert all((r.score == 1) == (r.doc_id % 3 == 0) for r in found)
    assert all(r.first_word == 100 for r in found if r.score == 1)
    assert decontaminate.find_contamination(awkward, benchmark).count() == 0
    assert decontaminate.find_contamination(empty, benchmark).count() == 0 and decontaminate.find_contamination(docs, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("n_words", [1, 2, 3, 5, 8, 12, 13, 16, 20, 40])
def test_decontamination_recall(n_words):
    """Against a Smith-Waterman join of all pairs: everything up to SHORT words, at least 0.9 of longer items."""
    rng = np.random.default_rng(n_words)
    vocabulary = [f"v{k}" for k in range(400)]
    items = [[str(w) for w in rng.choice(vocabulary, n_words)] for _ in range(20)]
    texts = []
    for item in items:
        for rate in (0.0, 0.1, 0.2, 0.3, 0.4):
            edited = []
            for w in item:
                kind = rng.random()
                edited += [w] if kind > rate else [] if kind < rate / 3 else ["changed"] if kind < 2 * rate / 3 else [w, "added"]
            texts.append([str(w) for w in rng.choice(vocabulary, 30)] + edited + [str(w) for w in rng.choice(vocabulary, 20)])
    block = decontaminate.Items.of(list(range(20)), [" ".join(i) for i in items])
    hashes, _, _, counts = decontaminate.word_hashes([" ".join(t) for t in texts], plain=True)
    got = {(t, i): s for t, i, s, _, _ in decontaminate.align(hashes, counts, block)}
    scores = {(t, i): brute_alignment(item, text) / (2 * n_words) for t, text in enumerate(texts) for i, item in enumerate(items)}
    want = {k: s for k, s in scores.items() if s >= (1 if n_words < 3 else 0.5)}
    assert len(want) >= 20 and all(want[k] == s for k, s in got.items())
    assert len(got) >= (1 if n_words <= decontaminate.SHORT else 0.9) * len(want)


@pytest.mark.parametrize("verbatim", [2, 60])
def test_decontamination_of_edits_beside_many_copies(spark, verbatim):
    rng = np.random.default_rng(8)
    text = lambda n: [f"v{k}" for k in rng.integers(0, 3000, n)]
    item = [f"item{k}" for k in range(40)]
    edited = [w if k % 5 else f"new{k}" for k, w in enumerate(item)]
    rows = [(k, text(50) + item + text(30)) for k in range(verbatim)] + [(1000, text(20) + edited + text(20))] + [(2000 + k, text(40)) for k in range(900)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = {r.doc_id: r.score for r in decontaminate.find_contamination(docs, benchmark).collect()}
    assert found.keys() == {*range(verbatim), 1000} and found[1000] == brute_alignment(item, edited) / 80


def test_decontamination_in_blocks(spark, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {tuple(r)[:3] for r in decontaminate.find_contamination(docs, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 500)
    assert {tuple(r)[:3] for r in decontaminate.find_contamination(docs, benchmark).collect()} == whole
    plain = lambda t: " ".join(re.sub(r"[!-/:-@\[-`{-~]", "", (t or "").lower()).split())
    exact = {(d.doc_id, b.item_id) for d in docs.collect() for b in benchmark.collect() if plain(b.text) and plain(b.text) in plain(d.text)}
    assert exact <= {(d, i) for d, i, _ in whole}


def test_license_notices(spark, awkward, empty):
    scan = licenses.Scanner().scan
    for name, forms in licenses.TEMPLATES.items():
        for form in forms:
            assert [f.license for f in scan(f"Some prose.\n{form}\nMore prose.")] == [name]
    assert [f.license for f in scan("Licensed under CC BY-ND 4.0.")] == ["CC-BY-ND-4.0"]
    assert scan("This work is licensed under the GNU General Public License, version 7.") == [] and scan("the license of the car") == [] and scan(None) == []
    changed = licenses.TEMPLATES["MIT"][2].replace("SOFTWARE", "WORK", 1)
    assert [(f.license, f.n_missing, f.n_extra) for f in scan(changed)] == [("MIT", 1, 1)]
    assert licenses.scan_licenses(awkward).count() == 0 and licenses.scan_licenses(empty).count() == 0


def test_wrapped_and_numbered_license_texts():
    scan = licenses.Scanner().scan
    forms = licenses.TEMPLATES
    texts = {"MIT": forms["MIT"][2], "GPL-3.0": forms["GPL-3.0"][1], "BSD-3-Clause": forms["BSD-3-Clause"][1], "Apache-2.0": forms["Apache-2.0"][1]}
    texts["BSD-3-Clause"] = re.sub(r" (Redistributions of|Redistributions in|Neither the name)", lambda m, n=iter("123"): f"\n\n{next(n)}. {m[1]}", texts["BSD-3-Clause"])
    for name, text in texts.items():
        for width in (60, 80):
            wrapped = "\n".join(textwrap.fill(p, width) for p in re.sub(r" (The above|THE SOFTWARE IS)", r"\n\n\1", text).split("\n"))
            found = scan(f"Some prose before.\n\n{wrapped}\n\nSome prose after it.")
            assert [(f.license, f.first_line, f.last_line, f.n_missing, f.n_extra) for f in found] == [(name, 2, 2 + wrapped.count("\n"), 0, 0)]


@pytest.mark.parametrize("width, prefix", [(72, ""), (78, "# "), (60, " * "), (72, "// ")])
def test_all_templates_wrapped(width, prefix):
    """Every template as it stands in files, with a heading and a copyright line before it."""
    scan = licenses.Scanner().scan
    seeds = licenses.seed_hashes()
    for name, forms in licenses.TEMPLATES.items():
        for form in forms:
            text = "A heading\n\nCopyright (c) 2020 Somebody\n\n" + textwrap.fill(form, width, initial_indent=prefix, subsequent_indent=prefix) + "\n\nint main() { return 0; }"
            assert [(f.license, f.n_missing, f.n_extra) for f in scan(text)] == [(name, 0, 0)], (name, form[:60])
            hashes = licenses.word_hashes([text], plain=True)[0]
            assert np.isin(licenses.ngram_hashes(hashes, 3), seeds).any()


def test_license_seeds_miss_no_edited_notice():
    rng = np.random.default_rng(7)
    scanner = licenses.Scanner()
    for name, words in scanner.templates:
        for _ in range(20):
            edited, n = list(words), len(words)
            for p in rng.permutation(n)[: n // 10]:
                edited[p] = "edited"
            runs = {tuple(edited[k : k + 3]) for k in range(n - 2)}
            assert runs & scanner.seeds, name


def test_license_lines_within_legal_prose():
    scan = licenses.Scanner().scan
    terms = "By using this service you accept that it is provided without warranties of any kind and that in no event shall the authors be liable for any claim or damages arising from the use of the service, subject to the following conditions and to applicable law; " * 2
    for form, name in (("All rights reserved.", "LicenseRef-All-Rights-Reserved"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Released under the MIT License.", "MIT")):
        assert [f.license for f in scan(terms + form)] == [name]
    assert [f.license for f in scan("Released under the MIT License. Licensed under CC BY 4.0. All rights reserved.")] == ["MIT", "CC-BY-4.0", "LicenseRef-All-Rights-Reserved"]


def test_license_lines_of_all_documents(spark, docs):
    lines = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "All rights reserved.": "LicenseRef-All-Rights-Reserved"}
    want = {(r.doc_id, lines[s]) for r in docs.collect() for s in r.text.split("\n") if s in lines}
    assert want <= {(r.doc_id, r.license) for r in licenses.scan_licenses(docs).filter("exact").collect()}


def test_warc_derivatives(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x", PAGE), (2, None, None), (3, "http://a.example/x", ""), (1, "http://a.example/x", PAGE)], "page_id long, url string, html string")
    out = warc.build_derivatives(warc.page_responses(pages, "2024-01-01T00:00:00Z")).collect()
    assert len(out) == 8
    for r in out:
        source = warc.response(*{1: ("http://a.example/x", PAGE), 2: (None, None), 3: ("http://a.example/x", "")}[r.source_id], "2024-01-01T00:00:00Z", r.source_id)
        assert r.refers_to == source.headers["WARC-Record-ID"] and r.source_payload_digest == source.headers["WARC-Payload-Digest"] and r.date == "2024-01-01T00:00:00Z"
        assert r.block_digest == warc.digest(r.block.encode()) and r.content_length == len(r.block.encode())
    text = next(r for r in out if r.source_id == 1 and r.record_type == "conversion").block
    assert "Head" in text and "foot" in text and "var t" not in text
    assert warc.build_derivatives(warc.page_responses(pages.limit(0), "2024-01-01T00:00:00Z")).count() == 0


def test_warc_of_awkward_pages(spark):
    rows = [(1, "http://a.example/", "<p>" + "long text " * 300_000, "x"), (None, "http://b.example/", "<p>no id", "y"), (2, None, None, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record string").withColumns({"source_id": F.lit("clash"), "block": F.lit(1)})
    out = warc.build_derivatives(warc.page_responses(pages, "2024-01-01T00:00:00Z")).filter("record_type = 'conversion'").collect()
    assert sorted((r.source_id or 0, len(r.block)) for r in out) == [(0, 5), (1, 10 * 300_000 - 1), (2, 0)]


def http(body, *headers):
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", *headers]
    return warc.Record({"WARC-Type": "response", "WARC-Record-ID": warc.record_id(body), "WARC-Date": "2024-01-01T00:00:00Z"}, "\r\n".join(lines).encode() + b"\r\n\r\n" + body)


def test_warc_bodies_are_decoded():
    import gzip
    import zlib

    page = "<p>gepackt: \u00e4</p>".encode()
    chunked = b"5\r\n" + page[:5] + b"\r\n" + hex(len(page) - 5)[2:].encode() + b";x=1\r\n" + page[5:] + b"\r\n0\r\n\r\n"
    gz = gzip.compress(page)
    in_chunks = hex(len(gz))[2:].encode() + b"\r\n" + gz + b"\r\n0\r\n\r\n"
    cases = [http(page), http(chunked, "Transfer-Encoding: chunked"), http(gz, "Content-Encoding: gzip"), http(zlib.compress(page), "Content-Encoding: deflate"),
             http(in_chunks, "Transfer-Encoding: chunked", "Content-Encoding: gzip")]
    for source in cases:
        meta, text = warc.derivatives(source)
        assert text.block.decode() == "gepackt: \u00e4" and meta.headers["WARC-Refers-To"] == source.headers["WARC-Record-ID"]
    for source in (http(b"??", "Content-Encoding: br"), http(b"no gzip", "Content-Encoding: gzip")):
        (meta,) = warc.derivatives(source)
        assert b"undecoded" in meta.block
    image = warc.Record(http(b"x").headers, b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG\xff")
    assert [r.headers["WARC-Type"] for r in warc.derivatives(image)] == ["metadata"]
    latin = warc.Record(http(b"x").headers, b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<meta charset=latin-1><p>\xe4</p>")
    assert warc.derivatives(latin)[1].block.decode() == "\u00e4"


def test_warc_files_are_read(spark, tmp_path):
    import gzip

    inner = b"<pre>text\r\n\r\nWARC/1.1\r\nWARC-Type: response</pre>"
    records = [warc.response("http://a.example/1", "<p>one</p>", "2024-01-01T00:00:00Z", 1), warc.Record({"WARC-Type": "request"}, b"GET /"), warc.Record({"WARC-Type": "request"}, b""),
               http(inner), warc.response("http://a.example/2", "<p>zwei</p>", "2024-01-01T00:00:00Z", 2)]
    (tmp_path / "a.warc").write_bytes(b"".join(map(warc.to_bytes, records)))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc.to_bytes(r)) for r in records))
    (tmp_path / "c.warc").write_bytes(b"junk \xff" + warc.BOUNDARY + b"1\r\nno length\r\n\r\n" + warc.BOUNDARY + warc.to_bytes(records[0])[7:] + warc.to_bytes(records[4])[:-12])
    (tmp_path / "d.warc").write_bytes(b"")
    found = warc.read_warc(spark, str(tmp_path)).cache()
    out = warc.build_derivatives(found)
    texts = sorted(r.block for r in out.filter("record_type = 'conversion'").collect())
    assert texts == sorted(2 * ["one", "zwei", "text WARC/1.1 WARC-Type: response"] + ["one"])
    errors = sorted(r.error for r in found.filter("error is not null").collect())
    assert len(errors) == 3 and sum("breaks off" in e for e in errors) == 1 and found.select("source_id").distinct().count() == found.count()
    assert sorted(r.error for r in warc.record_errors(found).collect()) == errors


def test_warc_reader_is_linear(spark, tmp_path):
    one = warc.to_bytes(warc.response("http://a.example/1", "<p>" + "text " * 200 + "</p>", "2024-01-01T00:00:00Z", 1))
    (tmp_path / "a.warc").write_bytes(one * 20_000)
    assert warc.read_warc(spark, str(tmp_path)).filter("error is null").count() == 20_000
