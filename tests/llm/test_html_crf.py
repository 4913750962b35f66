"""The field against enumeration; odd, broken, long and unmarked pages."""

import itertools
import random
import time

import numpy as np
import pytest

from riskframe.llm import html_crf as H


def _field(seed=2):
    rng = np.random.default_rng(seed)
    f = H.Field()
    f.trans, f.start = rng.normal(size=(2, 2)), rng.normal(size=2)
    return f


def _scores(f, e):
    """Score of every labelling."""
    return {y: f.start[y[0]] + sum(e[i, y[i]] for i in range(len(e))) + sum(f.trans[a, b] for a, b in zip(y, y[1:]))
            for y in itertools.product((0, 1), repeat=len(e))}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10])
def test_viterbi_and_marginals_equal_enumeration(n):
    f = _field(n)
    e = np.random.default_rng(n + 50).normal(size=(n, 2))
    scores = _scores(f, e)
    assert tuple(f.viterbi(e)) == max(scores, key=scores.get)
    top = max(scores.values())
    p = {y: np.exp(s - top) for y, s in scores.items()}
    z = sum(p.values())
    node, pair = f.marginals(e)
    for i in range(n):
        assert node[i, 1] == pytest.approx(sum(v for y, v in p.items() if y[i]) / z, abs=1e-12)
    for i, a, b in itertools.product(range(n - 1), (0, 1), (0, 1)):
        assert pair[i, a, b] == pytest.approx(sum(v for y, v in p.items() if y[i:i + 2] == (a, b)) / z, abs=1e-12)


def test_first_training_step_follows_the_gradient():
    """AdaGrad's first step has the sign of the gradient of the likelihood."""
    page = "<nav><p>Home, now</p></nav><article><p>One two three.</p><p>Four five.</p></article><footer>x</footer>"
    blocks, labels = H.leaf_blocks(page), [0, 1, 1, 0]

    def likelihood(f):
        e = f.emissions(blocks)
        scores = _scores(f, e)
        top = max(scores.values())
        return scores[tuple(labels)] - top - np.log(sum(np.exp(s - top) for s in scores.values()))

    zero = H.Field().train([(blocks, labels)], 0, 1)
    one = H.Field().train([(blocks, labels)], 1, 1)
    for name in zero.w:
        for k in (0, 1):
            near = H.Field().train([(blocks, labels)], 0, 1)
            near.w[name][k] += 1e-6
            slope = (likelihood(near) - likelihood(zero)) / 1e-6
            assert abs(slope) < 1e-6 or np.sign(one.w[name][k]) == np.sign(slope), name
    assert likelihood(one) > likelihood(zero)


@pytest.mark.parametrize("name, page, blocks", [
    ("unclosed tags", "<a " * 400_000, 1), ("unclosed quotes", "<a \"'" * 250_000, 1), ("declarations", "<!" * 600_000, 1),
    ("names", "<a" * 600_000, 1), ("nested", "<div>x" * 150_000, 150_000), ("unclosed comment", "a<!--" * 200_000, 1),
    ("cells", "<section>" * 50_000 + "<td></td>x" * 50_000, 50_000), ("skipped", "<svg>" * 200_000, 0),
    ("spaces", "</svg" + " " * 1_000_000, 1), ("one word", "x" * 5_000_000, 1)], ids=lambda v: v if isinstance(v, str) and len(v) < 20 else "")
def test_broken_pages_take_linear_time(name, page, blocks):
    start = time.time()
    assert len(H.leaf_blocks(page)) == blocks
    assert time.time() - start < 20


def test_tags_of_broken_pages():
    text = lambda page: [t for _, t, _ in H.leaf_blocks(page)]
    assert text('<p title="a>b">x</p>') == ["x"]
    assert text("<p title='a<b'>x") == ["x"]
    assert text('<p "a<b>c') == ['<p "ac']
    assert text("a < b <3 <p>c") == ["a < b <3", "c"]
    assert text("<!doctype html><!-- <p>x --><p>y<!-- z") == ["y"]
    assert text("<script>if (a<b) '</p>'</script>t<style>unclosed <p>u") == ["t"]
    assert text("&#" + "0" * 5000 + "65; &#" + "9" * 5000 + ";&#x41;") == ["A �A"]


def test_long_paths_keep_their_features():
    rng = random.Random(4)
    names = ["div", "section", "ul", "li", "@nav", "@body", "article", "aside", "p", "body", "html"]
    for _ in range(300):
        path = tuple(rng.choice(names) for _ in range(rng.randint(1, 200)))
        assert sorted(H.path_features(H.short(path))) == sorted(H.path_features(path))
        assert len(H.short(path)) <= 64


def test_pages_without_marks_and_empty_tables(spark):
    def page(i):
        body = "".join(f"<p>Sentence {k} of story {i} tells what happened, in some length.</p>" for k in range(6))
        menu = "".join(f'<li><a href="/{k}">Menu {k}</a></li>' for k in range(5))
        return f"<html><body><ul>{menu}</ul><div>{body}</div><p>© 2020 All rights reserved.</p></body></html>"

    rows = [(i, "u", page(i)) for i in range(8)] + [(8, "u", page(0)), (8, "u", page(0)), (None, None, None)]
    schema = "page_id long, url string, html string"
    pages = spark.createDataFrame(rows, schema)
    marked = [(i, "u", page(i).replace("<div>", "<article>").replace("</div>", "</article>")) for i in range(20, 28)]
    # pages without any mark, read by a field that saw some pages with one
    got = H.main_text(pages, H.fit(pages.unionByName(spark.createDataFrame(marked, schema)))).collect()
    assert len(got) == 11
    for r in got:
        if r.page_id is None:
            assert r.text == "" and r.n_chars == 0
        else:
            i = r.page_id % 8
            assert r.text == " ".join(f"Sentence {k} of story {i} tells what happened, in some length." for k in range(6))
    none = H.main_text(pages.limit(0), H.fit(pages.limit(0)))
    assert none.count() == 0 and none.columns == ["page_id", "url", "text", "n_chars"]


def test_fit_takes_each_page_once_and_long_ones_not(spark):
    pages = spark.createDataFrame([("<article><p>Some text here.</p></article>",)] * 50 + [("<p>Other.</p>" * 20_000,)], "html string")
    seen = []
    real = H.labelled_pages
    try:
        H.labelled_pages = lambda p, rules: (seen.append(p), real(p, rules))[1]
        H.fit(pages)
    finally:
        H.labelled_pages = real
    assert [len(p) for p in seen] == [1] and seen[0][0].startswith("<article>")
