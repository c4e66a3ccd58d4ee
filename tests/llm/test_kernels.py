"""Kernels against plain versions."""

import random

import numpy as np
import pytest

from tessera.llm import decontamination, fingerprints, html_text, ngram_join, repeats, token_counts, toxicity
from tessera.llm.common import grams


def test_contexts_of_symbols_are_sound():
    rng = random.Random(1)
    shared = np.array([rng.randrange(6) for _ in range(40)], np.uint64)
    parsed = []
    for seed in (2, 3):
        r = random.Random(seed)
        pad = np.array([r.randrange(6) for _ in range(20)], np.uint64)
        words = np.concatenate([pad, shared, pad])
        x, lo, hi, *_ = repeats.recompress(words, np.zeros(len(words), np.int64))
        inside = (lo >= 20) & (hi <= 60)
        parsed.append(list(zip(x[inside], lo[inside], hi[inside], strict=True)))
    assert parsed[0] and parsed[0] == parsed[1]


def test_tree_search_finds_all_that_may_link():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 9, (300, ngram_join.GROUPS))
    points[::3] = points[0] + rng.integers(0, 2, (100, ngram_join.GROUPS))
    sizes = points.sum(axis=1)
    tree = ngram_join.CountTree(points, sizes)
    for i in range(0, 300, 7):
        want = np.flatnonzero(ngram_join.may_link(points, sizes, points[i], sizes[i], 90))
        assert sorted(tree.search(points[i], sizes[i], 90, np.ones(300, bool))) == sorted(want)


def test_sizes_that_may_link_share_a_band():
    for p in (50, 80, 90, 100):
        for n in range(1, 400):
            for m in range(n, n * 100 // p + 1):
                assert set(ngram_join.size_bands(n, p)) & set(ngram_join.size_bands(m, p))


def test_tiling_marks_reordered_passages():
    item = "one two three four five six seven eight nine ten eleven twelve"
    text = "x y Seven, eight nine ten eleven twelve z q one two three four five six!"
    index = decontamination.Items([5], [item], 4)
    assert index.best([text, None, "", "one two three"], 0.5) == [(5, 1.0, 2, 1), (None, 0.0, 0, 0), (None, 0.0, 0, 0), (None, 0.0, 0, 0)]


def test_phrases_and_likeness():
    t = "abababababab"
    _, known, ends = fingerprints.parse(t)
    cuts = [t[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    assert cuts == ["a", "b", "ab", "aba", "ba", "bab"][: len(cuts)] and set(cuts) == known
    a, b = fingerprints.sketch(t, ends), fingerprints.sketch("", [])
    assert fingerprints.likeness(a, a) == 1 and fingerprints.likeness(b, b) == 1 and fingerprints.likeness(a, b) == 0


def test_tokens_go_to_sections_by_rule():
    ends, borders = np.array([2, 5, 9]), np.array([3, 9])
    assert list(token_counts.attribute(ends, borders, "first")) == [2, 1]
    assert list(token_counts.attribute(ends, borders, "most")) == [1, 2]


def test_tokens_add_up():
    with open(token_counts.VOCABULARY, "rb") as f:
        own = token_counts.Tokenizer(f.read(), token_counts.PATTERN)
    for text in ("", "a\n\nb", "naïve 日本語\n text", "\n"):
        _, borders = token_counts.sections([text], "lines")
        spans = own.spans(text) if text else np.zeros(0, np.int64)
        assert (spans[-1] if len(spans) else 0) == len(text.encode())
        if len(spans):
            assert token_counts.attribute(spans, borders, "first").sum() == len(spans)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>a<p>b", "a\n\nb"),
        ("<title>t</title><p>x <b>y</b>  z<script>1</script>", "x y z"),
        ("<ul><li>a<li>b<ol start=3><li>c</ol></ul>", "- a\n- b\n  3. c"),
        ("<table><tr><th>k<th>v<tr><td>long<td>1</table>", "k     v\nlong  1"),
        ("<div hidden>x</div><div style='display: none'>y</div>z", "z"),
        ("a &amp; b<br>c", "a & b\nc"),
        ("<pre>a\n  b</pre>", "a\n  b"),
        ("1 < 2 </nothing> ok", "1 < 2 ok"),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_pages(page, text):
    assert html_text.render(page) == text


def test_classifier_learns():
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    texts = [" ".join(rng.choices(words, k=30)) + (" nasty" if i % 2 else "") for i in range(60)]
    y = np.array([i % 2 for i in range(60)])
    model = toxicity.fit([toxicity.features(t) for t in texts], y)
    keep = model.weights != 0
    z = [model.bias + model.weights[toxicity.features(t, keep)].sum() for t in ("beta gamma nasty delta", "beta gamma delta")]
    assert z[0] > 0 > z[1]
    assert toxicity.fit([toxicity.features("a")], np.array([1])).bias > 0


def test_grams_of_short_texts_are_empty():
    assert len(grams(np.zeros(2, np.uint64), 3)) == 0


def test_text_of_formulas_and_drawings():
    assert html_text.render('<p>a <span aria-hidden="true">b</span> c') == "a b c"
    formula = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></semantics></math>"
    assert html_text.render(f"<p>so {formula}.") == "so x=2."
    assert html_text.render("<p>a<svg><title>t</title>z<defs><text>no</text></defs><g><path/><text>one <tspan>two</tspan></text></g><text>three</text></svg>b") == "a one two three b"


@pytest.mark.parametrize("depth", [250, 20_000])
def test_deep_pages(depth):
    assert html_text.render("<div>" * depth + "<div hidden>no</div>yes") == "yes"
    nested = ["<ul><li>" + "<span>" * n + "<b>a<ul><li>b</ul>c</b>" + "</span>" * n + "</ul>d" for n in (0, depth)]
    assert html_text.render(nested[0]) == html_text.render(nested[1]) != ""
    assert html_text.render("<table><tr><td>" * depth + "x") == "x"


def test_coverage_below_the_threshold():
    item = [f"i{k}" for k in range(20)]
    own = decontamination.Items([7, 3, 9], [" ".join(item), " ".join(item[:5] + [f"j{k}" for k in range(35)]), "k0 k1 k2 k3"], 4)
    got = own.best(["x " + " ".join(item[:5]) + " y", " ".join(item[5:9]), "none at all of it", " ".join(item)], 0.5)
    assert got == [(7, 0.25, 1, 0), (7, 0.2, 1, 0), (None, 0.0, 0, 0), (7, 1.0, 1, 1)]


def test_features_of_a_long_text_are_those_of_its_pieces(monkeypatch):
    text = "Straße, ΣΑΣ and 𝒳 words that go on " * 30
    whole = toxicity.features(text)
    keep = np.zeros(1 << toxicity.BITS, bool)
    keep[whole[::3]] = True
    for piece in (1, 4, 7, 64):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert toxicity.features(text).tolist() == whole.tolist()
        assert toxicity.features(text, keep).tolist() == whole[::3].tolist()
