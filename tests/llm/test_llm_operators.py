"""Each corpus operator on small tables: brute force, round trips, edge cases
(NULLs, empty texts, repeated rows, empty tables, extra columns)."""

import hashlib
import os
import random
import re
import sys
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import public_tokenizers  # noqa: E402

from riskframe.llm import (bpe_codec, circulant_minhash, cover_tree, html_crf, language_id,  # noqa: E402
                           line_templates, mixing, quality_rules, reply_trees, token_counts)
from riskframe.llm.components import connected_components  # noqa: E402

DOCS = "doc_id long, text string, source string, lang string, n_chars long, key string"
BPE = public_tokenizers.path("byte_bpe_50k.json")
WS = re.compile(r"[\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", 1, "x") for i, t, s in rows], DOCS)


def words(t):
    return [w for w in WS.split(t or "") if w]


def test_quality_base_rules_match_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \t", "a b c d e " * 8, "one two three\n\none two three\nfour # $ five", "é ü 日本 # x"]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(
        docs(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        w, t = words(t), t or ""
        seen = defaultdict(list)
        for k in range(len(w) - 4):
            seen[tuple(w[k:k + 5])].append(k)
        covered = {k + j for ks in seen.values() if len(ks) > 1 for k in ks for j in range(5)}
        lines = [x for x in t.split("\n") if words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered)), t
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))


def unique_line(rng, n=12):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_frequent_lines_go_but_near_copies_stay(spark):
    rng = random.Random(2)
    rows = [(i, "Share this page with your friends\n" + unique_line(rng, 15), "h") for i in range(30)]
    rows.append((100, "Share this page with your friends 2020", "h"))       # other normal form
    rows.append((101, "Share  this page\twith your friends", "h"))          # nothing else: depleted
    body = [unique_line(rng) for _ in range(8)]
    for i in range(200, 230):                                               # near copies on one host
        rows.append((i, "\n".join(body[:7] + [unique_line(rng)]), "h"))
    d = docs(spark, rows + rows[:2])
    v = {r.doc_id: r for r in quality_rules.quality_rules(d).collect()}
    assert all(v[i].n_removed_lines == 1 and v[i].kept for i in range(30))
    assert not v[101].kept and all(v[i].kept and v[i].n_removed_lines == 0 for i in range(200, 230))
    out = quality_rules.apply_quality_rules(d)
    assert out.columns == d.columns
    left = {r.doc_id: r.text for r in out.collect()}
    assert 101 not in left and left[5] == rows[5][1].split("\n")[1] and left[200] == rows[32][1]
    assert out.filter("doc_id = 0").count() == 2


def test_boilerplate_of_several_lines_is_counted(spark):
    for shared, own in ((2, 2), (5, 8), (12, 4)):
        rng = random.Random(shared)
        head = [unique_line(rng, 18) for _ in range(shared)]
        rows = [(i, "\n".join(head + [unique_line(rng, 18) for _ in range(own)]), "h") for i in range(60)]
        d = docs(spark, rows)
        v = quality_rules.quality_rules(d).collect()
        assert len(v) == 60 and {r.n_removed_lines for r in v} == {shared}
        left = {r.doc_id: r.text for r in line_templates.drop_templates(d).collect()}
        assert all(left[i].split("\n") == t.split("\n")[shared:] for i, t, _ in rows)


def test_near_copies_do_not_save_a_frequent_line(spark):
    rng = random.Random(12)
    line, body = unique_line(rng, 18), [unique_line(rng, 18) for _ in range(8)]
    rows = [(i, "\n".join([line, unique_line(rng, 18), unique_line(rng, 18)]), "h") for i in range(40)]
    rows += [(100 + i, "\n".join([line] + body + [unique_line(rng, 18)]), "h") for i in range(100)]
    d = docs(spark, rows)
    assert {r.n_removed_lines for r in quality_rules.quality_rules(d).collect()} == {1}
    left = {r.doc_id: r.text for r in line_templates.drop_templates(d).collect()}
    assert all(left[i] == t.split("\n", 1)[1] for i, t, _ in rows)


def test_recurring_templates_are_dropped(spark):
    rng = random.Random(3)
    passage = unique_line(rng, 55)
    rows = [(i, f"{unique_line(rng)}\nOrder number {i} was shipped on day {i * 7} by our local store\n{unique_line(rng)}", "a")
            for i in range(15)]
    rows += [(50 + i, unique_line(rng) + "\n" + passage, "b") for i in range(4)]
    rows += [(70 + i, f"Dear reader of the page called {'abcdefghijklm'[i]}x welcome to it again\n" + unique_line(rng), "c")
             for i in range(12)]
    body = [unique_line(rng) for _ in range(8)]
    rows += [(90 + i, "\n".join(body[:7] + [unique_line(rng)]), "d") for i in range(5)]
    rows += [(99, None, None), (98, "", None)]
    d = docs(spark, rows)
    out = line_templates.drop_templates(d)
    assert out.columns == d.columns and out.count() == len(rows)
    got, was = {r.doc_id: r.text for r in out.collect()}, {i: t for i, t, _ in rows}
    for i in range(15):
        assert got[i] == "\n".join(was[i].split("\n")[::2])
    for i in range(4):
        assert got[50 + i] == was[50 + i].split("\n")[0]
    for i in range(12):
        assert got[70 + i] == was[70 + i].split("\n")[1]
    assert all(got[90 + i] == was[90 + i] for i in range(5)) and got[99] is None and got[98] == ""


def test_templates_with_word_fields_anywhere(spark):
    rng = random.Random(13)
    w = lambda: "".join(rng.choice("klmnopqrst") for _ in range(6))
    forms = ["User {} logged in from the web", "Posted by {} on the site in {} today at noon",
             "Article written by {} for the section named {} of our paper",
             "{} shared this page with all their friends today here"]
    rows = [(100 * k + i, f.format(w(), w()) + "\n" + unique_line(rng), "h") for k, f in enumerate(forms) for i in range(12)]
    got = {r.doc_id: r.text for r in line_templates.drop_templates(docs(spark, rows)).collect()}
    assert all(got[i] == t.split("\n")[1] for i, t, _ in rows)


def test_a_stray_line_does_not_reject_a_template(spark):
    rng = random.Random(14)
    a, b = unique_line(rng, 12), unique_line(rng, 5)
    rows = [(i, f"{a} {unique_line(rng, 1)} {b}\n{unique_line(rng)}", "h") for i in range(20)]
    rows += [(50, f"{a[:59]} {unique_line(rng, 8)}\n{unique_line(rng)}", "h")]
    got = {r.doc_id: r.text for r in line_templates.drop_templates(docs(spark, rows)).collect()}
    assert all(got[i] == t.split("\n")[1] for i, t, _ in rows[:20]) and got[50] == rows[20][1]


def test_reply_trees_paths_scores_and_round_trip(spark):
    x = "</s>[INST] ok [/INST] [\\INST] <<SYS>> <</SYS>> <\\\\s> \\"
    rows = [(1, 1, None, 0.0, "system", "be kind"), (1, 2, 1, 1.0, "user", x), (1, 3, 2, 0.0, "assistant", x),
            (1, 4, 2, 5.0, "assistant", None), (1, 5, 4, 1.0, "tool [a]%", " y "), (1, 6, 3, 9.0, None, "z"),
            (2, 1, 99, 0.0, "user", "orphan"), (3, 1, 2, 0.0, "user", "cycle"), (3, 2, 1, 0.0, "user", "cycle")]
    m = spark.createDataFrame(rows, "conv long, id long, parent long, score double, role string, text string")
    best = reply_trees.format_paths(m, top=1)
    turns = {r.conv: [tuple(t) for t in r.turns] for r in best.select(
        "conv", reply_trees.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert turns == {1: [("system", "be kind"), ("user", x), ("assistant", x), ("", "z")], 2: [("user", "orphan")]}
    assert x not in best.filter("conv = 1").first().formatted
    both = reply_trees.format_paths(m, top=None).filter("conv = 1")
    assert sorted(r.leaf for r in both.collect()) == [5, 6]
    d = {r.conv: r for r in reply_trees.conversation_digests(both).collect()}
    other = [t for t in both.filter("leaf = 5").select(reply_trees.read_turns(F.col("formatted")).alias("t")).first().t]
    assert [tuple(t) for t in other][-1] == ("tool [a]%", " y ") and d[1].loss_chars in (0, len(x))
    chain = spark.createDataFrame([(7, t, "user", f"t{t}") for t in range(40)] + [(7, 3, "user", "t3")],
                                  "conv_id long, turn int, role string, text string")
    done = reply_trees.conversation_digests(reply_trees.format_paths(reply_trees.linear_messages(chain))).collect()
    assert len(done) == 1 and done[0].n_turns == 41
    assert reply_trees.format_paths(reply_trees.linear_messages(chain.limit(0))).count() == 0


def test_language_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba", "▁", "▁a"]
    table = language_id.PieceTable(pieces)
    rng = np.random.default_rng(1)
    prob = rng.random((len(pieces), 2))
    word = "▁ababa"
    got = language_id.forward(table.matches(language_id._codes([word])), language_id._rows(prob))[0, -1]

    def total(s, k):
        if not s:
            return 1.0
        out = sum(prob[pieces.index(s[:n]), k] * total(s[n:], k) for n in range(1, len(s) + 1) if s[:n] in pieces)
        return out + (language_id.UNKNOWN * total(s[1:], k) if s[0] not in pieces else 0.0)
    want = [total(word, k) * language_id.SCALE ** len(word) for k in (0, 1)]
    assert np.allclose(got, want)


def test_language_prediction_held_out(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    vocab = public_tokenizers.path("piece_bpe_32k.model")
    model = language_id.fit(t.filter(~held), vocab, language_id.LanguageRules(fit_docs=60, fit_words=3000))
    out = language_id.predict(t.filter(held), model, keep=("doc_id", "lang")).toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.95 and out.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "x" * 5000)], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred in model.languages
    none = language_id.fit(t.limit(0), vocab)
    assert language_id.predict(odd, none).filter("lang_pred = 'und' AND score = 0").count() == 4


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 40))), rng.choice(["a", "a", "a", "b", "c", None, "d"]))
            for i in range(600)] + [(900, None, "a"), (901, "", "e")]
    d = docs(spark, rows)
    got = mixing.mix(d).toPandas()
    size = defaultdict(int)
    for i, t, s in rows:
        size[s] += len(words(t))
    names = sorted((s for s in size if s is not None)) + [None]
    want = dict(zip(names, mixing.water_fill([size[n] for n in names], [(5, 2, 1)[k % 3] for k in range(len(names))],
                                             1.5 * sum(size.values()), 2)))
    src = {i: s for i, t, s in rows}
    taken = defaultdict(int)
    for r in got.itertuples():
        assert r.target == pytest.approx(want[src[r.doc_id]]) and r.source_size == size[src[r.doc_id]]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[src[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 3 for s in names)
    again = mixing.mix(d.repartition(7)).toPandas()
    key = ["doc_id", "taken"]
    assert got.sort_values(key)[key].values.tolist() == again.sort_values(key)[key].values.tolist()
    out = mixing.apply_mix(d)
    assert out.columns == d.columns and out.count() == int(got.times.sum())
    assert mixing.mix(d.limit(0)).count() == 0


def test_flow_routes_overlap_and_prefers_first_copies():
    # p0 only in source 0, p1 in both: p1 must serve source 1 and leave source 0 to p0
    used = mixing.route([((0,), 10), ((0, 1), 10)], [10.0, 10.0], 2)
    assert used == [10.0, 10.0]
    # first copies of both come before a second copy of either
    assert mixing.route([((0,), 10), ((0,), 10)], [25.0], 2) == [15.0, 10.0]
    # pushing: p0 fills source 0 first, then must move to source 1 for p1
    assert mixing.route([((0, 1), 10), ((0,), 10)], [10.0, 10.0], 1) == [10.0, 10.0]


def test_mix_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a", "b"] if i % 2 else ["a"]) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = mixing.mix(d).toPandas()
    assert got.taken.sum() == pytest.approx(1.5 * 2000, abs=20) and (got.taken <= 20).all()


def brute_components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_cover_tree_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 16))
    v[:150] = v[0] + rng.normal(size=(150, 16)) * 0.22 * np.linalg.norm(v[0]) / 4
    v[150:200] = v[150] + rng.normal(size=(50, 16)) * 0.02
    v[390:] = v[0]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    m = u @ u.T >= 0.9
    np.fill_diagonal(m, False)
    comp = brute_components(400, list(zip(*np.nonzero(np.triu(m)))))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [None] * 16), (1003, [float("nan")] * 16), (1004, [float("inf")] * 16)]
    t = spark.createDataFrame([(i, x, 3) for i, x in rows], "vec_id long, embedding array<double>, fp int")
    for rules in (cover_tree.CoverRules(centres=40, block=32), cover_tree.CoverRules()):
        got = cover_tree.near_duplicates(t, rules).toPandas().set_index("vec_id")
        assert got.loc[range(400)].n_links.tolist() == m.sum(axis=1).tolist()
        assert got.loc[range(400)].component_id.tolist() == comp
        assert (got.loc[[1000, 1001, 1002, 1003, 1004]].n_links == 0).all() and got.loc[range(1000, 1005)].kept.all()
    assert cover_tree.near_duplicates(t.limit(0)).count() == 0


def test_cover_tree_sends_vectors_by_side(spark, monkeypatch):
    """Vectors in no clusters are compared with all blocks: each is sent once per
    side, in frames of bounded size, not once per block."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 12))
    x[::7] = x[1::7][:len(x[::7])] + 0.02 * rng.normal(size=(len(x[::7]), 12))
    t = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    plans = []
    init = cover_tree.Plan.__init__
    monkeypatch.setattr(cover_tree.Plan, "__init__", lambda self, *a: (init(self, *a), plans.append(self))[0])
    got = cover_tree.near_duplicates(t, cover_tree.CoverRules(centres=20, block=10)).toPandas().set_index("vec_id")
    plan = plans[0]
    assert plan.n_blocks > 100 and plan.n_sides <= cover_tree.SIDES
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    assert (got.n_links.loc[range(len(x))].to_numpy() == link.sum(axis=1)).all()



def test_html_blocks_and_layouts():
    page = ('<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">Home'
            '</a><li><a>b</a></ul></nav><!-- ad > x --><article><h1>A &amp; B</h1><p>one\n two<br>three<p><b>fo</b>ur &lt;x&gt;'
            '</article><footer>&copy; x</footer>')
    assert [t for _, t, _ in html_crf.leaf_blocks(page)] == ["Home", "b", "A & B", "one two three", "four <x>", "© x"]
    assert html_crf.leaf_blocks("") == [] and html_crf.leaf_blocks("<<p <") != []
    rng = random.Random(6)
    train = html_crf.labelled_pages([page], html_crf.ExtractionRules(variants=40))
    field = html_crf.Field().train(train, 6, 1)
    texts = [f"Sentence number {i} tells a part of the story, and then it ends." for i in range(9)]
    good = total = 0
    for _ in range(60):
        made, labels = html_crf.layout(rng, texts, ["Other things", "Click here now"])
        blocks = html_crf.leaf_blocks(made)
        got = field.viterbi(field.emissions(blocks))
        total += len(labels)
        good += sum(a == b for a, b in zip(got, labels))
    assert good / total > 0.97


def test_html_extraction_on_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in html_crf.main_text(pages, html_crf.fit(pages)).collect()}
    import html
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = WS.sub(" ", html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body)))).strip(" ")
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)
    odd = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, "u", "plain")], "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html_crf.main_text(odd, html_crf.fit(odd.limit(0))).collect()}
    assert out[1] == "" and out[2] == "" and 3 in out


def odd_texts():
    rng = random.Random(7)
    out = [None, "", " ", "  a", "a  b", "a \n b", "<|endoftext|>", "x<|endoftext|> y <|endoftext", "it's we'll I'D 'sa",
           "a" * 300, "\n\n \n", "ab" * 400, "日本語 テスト 🙂 éàü", "x" * 2000 + " " + "word " * 3000]
    al = "abcdeth nosri  \n\t.,'s'll 0123 éñ日🙂<|endoftext|>ABZ_-"
    out += ["".join(rng.choice(al) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    return out + ["".join(rng.choice(["the", "tion", "ing", "ab", "re", " ", "in", "ou"]) for _ in range(30)) for _ in range(500)]


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer
    tok, texts = Tokenizer.from_file(BPE), odd_texts()
    ids = [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    n = {r.doc_id: r for r in token_counts.token_counts(d, BPE).collect()}
    c = {r.doc_id: r for r in bpe_codec.encode_decode(d, BPE, with_ids=True).collect()}
    for i, t in enumerate(texts):
        assert n[i].n_tokens == len(ids[i]) and n[i].n_bytes == len((t or "").encode())
        assert c[i].ids == ids[i] and c[i].decoded == (t or "") == tok.decode(ids[i], skip_special_tokens=False)
        assert c[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids[i])).encode()).hexdigest()
    assert token_counts.token_counts(d.limit(0), BPE).count() == bpe_codec.encode_decode(d.limit(0), BPE).count() == 0


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocab) for _ in range(80)]
    texts = []
    for _ in range(120):
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(80)] = rng.choice(vocab)
        texts.append(" ".join(t))
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30))) for _ in range(80)]
    texts += [None, "", texts[3].upper() + "  ", "one", "One", "one two"]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i]
             and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    comp = brute_components(len(texts), links)
    d = spark.createDataFrame([(i, t, b"z") for i, t in enumerate(texts)], "doc_id long, text string, fp binary")
    rules = circulant_minhash.NearDupRules(words=k)
    got = {r.doc_id: r for r in circulant_minhash.near_duplicates(d, rules).collect()}
    assert [got[i].component_id for i in range(len(texts))] == comp
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    kept = circulant_minhash.keep_one(d, rules)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(comp))
    assert circulant_minhash.near_duplicates(d.limit(0), rules).count() == 0


def test_differences_from_a_centre_bound_the_intersection():
    rng = np.random.default_rng(4)
    for size in (60, 700, 3000):
        centre = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
        pair = []
        for _ in range(2):
            other = rng.integers(0, 40 * size, size // 2).astype(np.uint64)
            pair.append(np.unique(np.concatenate([centre[rng.random(len(centre)) < 0.6], other])))
        rows = [r for f in circulant_minhash._offsets([pd.DataFrame({
            "fp": [b"x", b"y"], "top": [b"t", b"t"], "items": [x.tobytes() for x in pair],
            "centre": [centre.tobytes()] * 2})]) for r in f.to_dict("records")]
        most = rows[0]["held"] + rows[1]["held"] - len(centre)
        for part in ("lost", "more"):
            most += sum(bin(int(v) & (1 << 64) - 1).count("1") for v in rows[0][part] & rows[1][part])
            most += min(rows[0][part + "_over"], rows[1][part + "_over"])
        assert most >= len(np.intersect1d(*pair))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(300, 301), (301, 300), (305, 305)]
    links = [tuple(rng.sample(x, 2)) for x in links]
    e = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.comp for r in connected_components(e).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(80))
    assert got[301] == 300 and 305 not in got


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "source_mix", "bpe_codec"]
    rng = random.Random(10)
    rows = [(i, "\n".join(unique_line(rng) for _ in range(3)), "ab"[i % 2]) for i in range(40)]
    rows += [(100 + i, rows[0][1], "a") for i in range(3)] + [(200, "too short", "a"), (201, None, None)]
    pd.DataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows],
                 columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(tmp_path / "documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    took = set(out.doc_id)
    assert not took & {100, 101, 102, 200, 201} and took <= set(range(40)) and out.groupby("doc_id").size().max() <= 2
    text = {i: t for i, t, _ in rows}
    for r in out.itertuples():
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


CLASHES = ["_id", "_doc", "_th", "_at", "_n", "_times", "row", "doc", "th", "at", "host", "ls", "times", "bad", "eid",
           "stays", "counts", "left_over", "pattern", "key"]


def test_no_column_name_clashes(spark):
    rng = random.Random(21)
    rows = [(i, "Share this page with your friends\n" + unique_line(rng, 15), "h") for i in range(25)]
    rows += [(40, rows[3][1], "h"), (41, None, None), (42, "", None)]
    d = docs(spark, rows).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in CLASHES})
    for fn in (quality_rules.apply_quality_rules, line_templates.drop_templates, mixing.apply_mix,
               lambda x: circulant_minhash.keep_one(x, circulant_minhash.NearDupRules(words=5))):
        out = fn(d)
        assert out.columns == d.columns
        got = out.collect()
        assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in CLASHES)
        assert fn(d.limit(0)).count() == 0


def test_keep_one_tells_documents_apart_by_id_and_text(spark):
    rng = random.Random(22)
    a, b, c = (unique_line(rng, 40) for _ in range(3))
    near = a + " tail"
    rows = [(3, a, "s"), (5, b, "s"), (5, near, "s"),            # id 5: a clean text and a copy of 3's
            (None, near, "s"), (None, c, "s"),                   # NULL ids: a copy and a clean text
            (7, c + " x", "s"), (3, a, "t"), (3, a, "s"),        # the kept row of 3 repeats
            (9, None, "s"), (9, "", "s"), (10, "  ", "s"), (11, None, "s"), (11, None, "s")]
    out = circulant_minhash.keep_one(docs(spark, rows))
    got = sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=str)
    assert got == sorted([(3, a, "s"), (5, b, "s"), (7, c + " x", "s"), (9, None, "s"), (9, "", "s"), (10, "  ", "s"),
                          (11, None, "s"), (11, None, "s")], key=str)


def test_quality_rules_applied_equal_the_verdicts(spark):
    rng = random.Random(23)
    line = "Share this page with your friends"
    rows = [(i, f"{line} {i}\n{unique_line(rng, rng.choice([3, 15]))}\n\n{line} {i}", rng.choice(["h", None])) for i in range(60)]
    rows += [(i, unique_line(rng, 12) + "\n\n", "h") for i in range(100, 110)] + [(200, None, "h"), (201, "x", None)]
    rows += [(300, "word " * 30_000 + "\n" + line, "h"), (301, line + "\n" + unique_line(rng, 20_000), "h")]
    d = docs(spark, rows + rows[:3])
    v = {r.doc_id: r for r in quality_rules.quality_rules(d).collect()}
    out = quality_rules.apply_quality_rules(d).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows + rows[:3] if v[r[0]].kept)
    was = {i: t for i, t, _ in rows}
    assert 30 < sum(x.n_removed_lines == 2 for x in v.values()) and not v[300].kept and v[301].kept
    for r in out:
        gone = v[r.doc_id].n_removed_lines           # (301 holds the line once, the others twice)
        lines = [x for x in was[r.doc_id].split("\n") if not (gone and x.startswith(line))]
        assert r.text == ("\n".join(lines) if gone else was[r.doc_id])
    assert quality_rules.quality_rules(d.limit(0)).count() == 0 == line_templates.drop_templates(d.limit(0)).count()


def test_quality_rules_equal_their_sql_on_boilerplate_and_copies(spark):
    """Documents of 0 to 95 % boilerplate, near copies, hosts, spread over them."""
    import duckdb
    rng = random.Random(24)
    rows, n = [], 0
    for host, shared, own, count in (("h50", 4, 4, 30), ("h60", 6, 4, 30), ("h75", 9, 3, 30), ("h85", 11, 2, 30),
                                     ("h95", 19, 1, 30), ("few", 4, 4, 9), (None, 3, 4, 20)):
        head = [unique_line(rng, 18) for _ in range(shared)]
        for _ in range(count):
            rows.append((n, "\n".join(head + [unique_line(rng, 18) for _ in range(own)]), host))
            n += 1
    body, line = [unique_line(rng, 12) for _ in range(9)], unique_line(rng, 7)
    rows += [(n + i, "\n".join(body[:8] + [unique_line(rng, 12)]), "h50") for i in range(25)]
    rows += [(n + 100 + i, line + " 12\n" + unique_line(rng, 30), "h50") for i in range(9 + 4)]
    rows += [(n + 200, None, "h50"), (n + 201, "", None), (n + 202, " \t\n", "few")]
    d = docs(spark, rows)
    got = quality_rules.quality_rules(d).drop("th").toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(i, t, s) for i, t, s in rows], columns=["doc_id", "text", "source"]))
    want = con.execute(quality_rules.ORACLE_SQL).df()
    key = list(want.columns)
    assert sorted(got.columns) == sorted(key)
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, want.values.tolist()))
    removed = {s: {r.n_removed_lines for r in got.itertuples() if dict((i, h) for i, _, h in rows)[r.doc_id] == s}
               for s in ("h60", "few", None)}
    assert removed["h60"] == {6} and removed["few"] == {0} and removed[None] == {0, 3}
