import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeseek.functions import html
from lodeseek.functions import text as T
from lodeseek.functions.stemming import english_tokens, stem
from lodeseek.operators import bm25, chunking, crawl, embedders


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "url, want",
    [("https://a.b/c/", "https://a.b/c"), ("https://a.b/", "https://a.b"), ("https://a.b/c//", "https://a.b/c"), ("https://a.b/c?q=1", "https://a.b/c?q=1"), ("a/", "a/")],
)
def test_normalize_url(spark, url, want):
    assert one(spark, T.normalize_url(F.lit(url))) == want


@pytest.mark.parametrize(
    "url, inside",
    [("https://a.b/docs/x", True), ("https://a.b:443/docs/y", True), ("http://a.b/docs/x", False), ("https://c.b/docs/x", False), ("https://a.b/other", False)],
)
def test_scope(spark, url, inside):
    assert one(spark, T.in_scope(F.lit(url), F.lit("https://a.b/docs/index.html"))) is inside


def test_small_functions(spark):
    assert one(spark, T.snippet(F.lit("  hello brave new world "), 12)) == "hello brave..."[:11] + "..."
    assert one(spark, T.format_bytes(F.lit(None).cast("long"))) == "-"
    assert one(spark, T.format_bytes(F.lit(1_500_000).cast("long"))) == "1.5 MB"
    assert one(spark, T.chunk_number(F.lit("a.txt (chunk 12)"))) == 12
    assert one(spark, T.code_language(F.lit("x/y.HPP"))) == "cpp"
    assert one(spark, T.script_leak(F.lit("var x = document.body"), list(html.SCRIPT_MARKS))) is True
    assert one(spark, T.progress(F.lit(0), F.lit(10), F.lit(5)))["eta_ms"] is None
    assert one(spark, T.progress(F.lit(5), F.lit(10), F.lit(100)))["eta_ms"] == 100
    assert one(spark, T.alibi_bytes(F.lit(8), F.lit(2048))) == 134217728
    assert one(spark, T.is_binary(F.lit(bytearray(b"a\0b")))) is True and one(spark, T.is_binary(F.lit(bytearray(b"ab")))) is False


@pytest.mark.parametrize(
    "page, text, links",
    [
        ("<html><head><title>t</title></head><body><p> Hi <b>you</b></p></body></html>", "Hi\nyou", []),
        ("<p>no body</p>", "no body", []),
        ("<body><script>var a;</script><style>x{}</style><noscript>n</noscript>ok</body>", "ok", []),
        ("<body>var x = document.y<p>fine</p></body>", "fine", []),
        ("<body>function() { const x = 1; }<p>window.addEventListener('click', fn)</p><p>document.querySelector('.foo')</p>typeof x !== undefined</body>", "", []),
        ("<body>{display:none;opacity:0}<p>srcSet=x data-y</p><p>Use the function( carefully</p></body>", "Use the function( carefully", []),
        ("<body><p>5 &gt; 3 &amp; 2 &lt; 4</p><svg><text>in</text></svg><iframe>f</iframe>日本語 🎉</body>", "5 > 3 & 2 < 4\n日本語 🎉", []),
        ("<body><span>Hello</span> <span>World</span></body>", "Hello\nWorld", []),
        ('<a href="page.html">p</a><a href="../other">o</a><a href="tel:+1">t</a><a href="/s?q=1&amp;p=2">s</a><a href="/p#f">f</a><a href="https://k.l">k</a>', "p\no\nt\ns\nf\nk", ["https://h.i/j/page.html", "https://h.i/other", "https://h.i/s?q=1&p=2", "https://h.i/p#f", "https://k.l"]),
        ('<a href="/x">a</a><a href="#f">b</a><a href="javascript:void(0)">c</a><a href="">d</a><a href="mailto:m@n">e</a><a href="/x">f</a>', "a\nb\nc\nd\ne\nf", ["https://h.i/x"]),
        ("", "", []),
    ],
)
def test_html(page, text, links):
    assert html.parse(page, "https://h.i/j/") == (text, links)


def test_the_marks_of_leaked_script_are_the_eighteen():
    """Each tells of script with any other, none alone."""
    assert len(html.SCRIPT_MARKS) == len(set(html.SCRIPT_MARKS)) == 18
    for mark in html.SCRIPT_MARKS:
        assert not html.leaks(f"before {mark} behind") and html.leaks(f"{mark} and " + ("=>" if mark != "=>" else "!=="))


def test_blank_is_any_white_space(spark):
    texts = [("", False), (" \n\t\r", False), ("\u00a0\u3000\u2003", False), (" x ", True), (None, False)]
    for text, want in texts:
        assert one(spark, T.has_text(F.lit(text).cast("string"))) is want
    assert one(spark, T.trimmed(F.lit("\u3000\n a b \t"))) == "a b"


def test_crawl_depth_pages_and_scope(spark):
    edges = spark.createDataFrame([("https://s/a", "https://s/b"), ("https://s/b", "https://s/c"), ("https://s/c", "https://s/a"), ("https://s/a", "https://x/z")], "url string, target string")
    depths = lambda **k: {r.url: r.depth for r in crawl.crawl(edges, ["https://s/a"], **k).collect()}
    assert depths(max_depth=1) == {"https://s/a": 0, "https://s/b": 1, "https://x/z": 1}
    assert depths(max_depth=9, scope="https://s/") == {"https://s/a": 0, "https://s/b": 1, "https://s/c": 2}
    assert len(depths(max_depth=9, max_pages=2)) == 2


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n#`é日", max_size=300), st.integers(1, 12), st.sampled_from([("text", None), ("markdown", None), ("code", "python")]))
def test_chunks_are_trimmed_ordered_bounded_and_whole(text, most, kind):
    spans = chunking.split(text, chunking.levels_for(*kind), most)
    covered, at = "", 0
    for a, b in spans:
        piece = text[a:b]
        assert a >= at and piece == piece.strip() and piece
        assert chunking.count_words(piece) <= most or len(piece) == 1
        covered, at = covered + piece, b
    assert "".join(covered.split()) == "".join(text.split())


def test_chunk_offsets_are_bytes(spark):
    docs = spark.createDataFrame([(1, "a.md", "# é\n\nbody text here. more text here."), (2, None, " "), (3, "b.txt", None)], "id long, path string, text string")
    rows = chunking.chunks(docs, 4).orderBy("chunk_index").collect()
    data = "# é\n\nbody text here. more text here.".encode()
    assert rows and all(data[r.start_byte : r.end_byte].decode() == r.text for r in rows) and {r.id for r in rows} == {1}


def test_hash_embedder_is_unit_and_alone():
    embed = embedders.hash_embedder(16)
    both, one = embed(["some words here", ""]), embed(["some words here"])
    assert (both[0] == one[0]).all() and abs((one[0] ** 2).sum() - 1) < 1e-9 and not both[1].any()


def test_stems():
    """Words and stems as the published algorithm gives them."""
    want = {
        "caresses": "caress", "ponies": "poni", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "agreed": "agre",
        "feed": "feed", "hopping": "hop", "hoping": "hope", "luxuriated": "luxuri", "falling": "fall", "sky": "sky", "dying": "die", "happy": "happi", "say": "say", "by": "by",
        "relational": "relat", "rationalization": "ration", "hopefulness": "hope", "generously": "generous", "generate": "generat", "communication": "communic",
        "consistency": "consist", "knightly": "knight", "replacement": "replac", "adoption": "adopt", "controlling": "control", "rolling": "roll", "news": "news",
        "proceeded": "proceed", "inning": "inning", "dog's": "dog", "youth": "youth", "boy": "boy", "electricity": "electr", "is": "is",
    }
    assert {w: stem(w) for w in want} == want


def test_stemmed_search_finds_inflected_forms(spark):
    docs = spark.createDataFrame([(1, "The dogs were running"), (2, "a cat sleeps"), (3, "Runs of a dog")], "id long, text string")
    asked = spark.createDataFrame([(0, "dog runs")], "query_id long, text string")
    found = lambda **k: {r.id for r in bm25.search(docs, asked, 5, **k).collect()}
    assert found(analyze=english_tokens) == {1, 3} and found() == {3}


def test_pooled_embedder(spark):
    """The mean of the tokens' vectors, at unit length; each text for itself, cut at the length."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    table = np.random.default_rng(0).normal(size=(tokenizer.get_vocab_size(), 8))
    embed = embedders.pooled_embedder(tokenizer, lambda ids: table[ids], 4)
    texts = ["some words here and more of them", "one"]
    for text, got in zip(texts, embed(texts)):
        mean = table[tokenizer.encode(text).ids[:4]].mean(axis=0)
        assert np.allclose(got, mean / np.linalg.norm(mean))
    assert np.allclose(embedders.pooled_embedder(tokenizer, lambda ids: table[ids], 4, False)(["one"])[0], table[tokenizer.encode("one").ids].mean(axis=0))
    with pytest.raises(ValueError):
        embed([""])


def test_models_are_loaded_once_a_process():
    loads = []
    load = embedders.once("a test's model", lambda: loads.append(1) or embedders.hash_embedder(4))
    assert load() is load() and loads == [1]
    embedders.unload("a test's model")
    with pytest.raises(KeyError):
        embedders.unload("a test's model")


def test_python_is_cut_at_its_statements():
    code = "import os\n\n\n@wraps(f)\ndef one(a):\n    x = 1\n\n    return x\n\n\nclass Two:\n    def method(self):\n        return 'def not one'\n\n    y = 2\n"
    spans = chunking.split(code, chunking.levels_for("code", "python", code), 14)
    pieces = [code[a:b] for a, b in spans]
    assert pieces[0] == "import os" and pieces[1].startswith("@wraps(f)\ndef one") and any(p.startswith("class Two:") for p in pieces)
    assert "".join("".join(pieces).split()) == "".join(code.split())
    assert chunking.levels_for("code", "python", "def (") == chunking.levels_for("code", "python")  # not Python: by pattern
    big = chunking.split(code, chunking.levels_for("code", "python", code), 1000)
    assert [code[a:b] for a, b in big] == [code.strip()]
