import itertools

import numpy as np
import pytest

from riftsplit.llm import html_text as ht

SCHEMA = "page_id bigint, url string, html string, text string, n_blocks int"
PAGE = """<!DOCTYPE html><html><head><title>A day out</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=1>Home</a></li></ul></nav>
<div class="ad">Buy now and save a lot of money today.</div><article><h1>A day out</h1><p><b>First  line&nbsp;here &amp; there.<br><p>Second
 line &lt;with&gt; marks.</p></article><footer>&copy; all of us</footer></body></html>"""
WANT = "A day out\nFirst line here & there.\nSecond line <with> marks."


def make(spark, rows):
    return spark.createDataFrame([(i, f"u{i}", h, "clash", 1) for i, h in rows], SCHEMA)


@pytest.fixture(scope="module")
def field(spark):
    return ht.learn_field(make(spark, [(i, PAGE.replace("line", f"line{i}")) for i in range(40)]))


def test_extraction_and_edge_pages(spark, field):
    rows = [(1, PAGE), (1, PAGE), (2, None), (3, ""), (4, "<p>"), (None, PAGE), (5, "<article>" + "<p>One sentence of text stands here.</p>" * 3000 + "</article>")]
    got = ht.extract_text(make(spark, rows), field).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == text[None] == WANT and text[2] == text[3] == text[4] == ""
    assert text[5].count("\n") == 2999
    assert ht.extract_text(make(spark, []), field).count() == 0


def test_pages_without_an_article_mark(field):
    page = PAGE.replace("<article>", "<div>").replace("</article>", "</div>").replace("</p></div>", '</p><div class="comments"><p>Nice one, thank you.</p></div></div>')
    blocks, title = ht.page_blocks(page)
    kept = [b.text for b, y in zip(blocks, field.decode(ht.block_features(blocks, title))) if y]
    assert "\n".join(kept) == WANT


def test_hand_labelled_pages_are_learned(field):
    for page in ht.EXAMPLES:
        blocks, title = ht.page_blocks(page)
        assert field.decode(ht.block_features(blocks, title)) == [int(b.labelled) for b in blocks]


def test_viterbi_and_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    field = ht.Field()
    field.w, field.move, field.ends = rng.normal(size=len(ht.FEATURES)), rng.normal(size=(2, 2)), rng.normal(size=(2, 2))
    x = (rng.random((6, len(ht.FEATURES))) < 0.3).astype(float)
    unary = x @ field.w

    def value(y):
        inner = sum(field.move[a, b] for a, b in zip(y, y[1:]))
        return sum(u for u, k in zip(unary, y) if k) + inner + field.ends[0, y[0]] + field.ends[1, y[-1]]

    paths = list(itertools.product((0, 1), repeat=6))
    assert field.decode(x) == list(max(paths, key=value))
    weights = np.exp([value(y) for y in paths])
    weights /= weights.sum()
    want = np.array([sum(w for w, y in zip(weights, paths) if y[k]) for k in range(6)])
    # padded to eight places
    padded = np.zeros((1, 8))
    padded[0, :6] = unary
    p, pair = ht._marginals(padded, field.move, field.ends, np.arange(8)[None] < 6, np.array([6]))
    assert np.allclose(p[0, :6, 1], want)
    assert np.allclose(pair[1, 1], sum(w * sum(a & b for a, b in zip(y, y[1:])) for w, y in zip(weights, paths)))


def test_training_without_marked_pages(spark):
    field = ht.learn_field(make(spark, [(1, None), (2, "<p>x</p>")]))
    blocks, title = ht.page_blocks(ht.EXAMPLES[0])
    assert field.decode(ht.block_features(blocks, title)) == [int(b.labelled) for b in blocks]


def blocks_of(html):
    parser = ht.BlockParser()
    parser.feed(html)
    parser.close()
    parser.flush()
    return [b.text for b in parser.blocks]


def test_visible_elements_and_open_heads():
    assert blocks_of("<article><p>Energy is <math><mi>E</mi></math> always.</p><p>An <svg><text>axis</text></svg>.</p></article>") == ["Energy is E always.", "An axis."]
    assert blocks_of("<head><title>T</title><meta charset=x><p>First.<p>Second.") == ["First.", "Second."]
    assert blocks_of("<html><head><style>a</style><article>Text</article>") == ["Text"]


def test_unclosed_tags_take_linear_time():
    import time

    start = time.time()
    assert len(blocks_of("".join(f"<div class='c{i % 7}'>t{i}" for i in range(20_000)))) == 20_000
    assert time.time() - start < 20
