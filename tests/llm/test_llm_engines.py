"""Numpy parts against brute force."""

import random
import re

import numpy as np
import pytest

from tabloom.llm import arrays, fm_dedup, html_blocks, nce_lm, quality_rules, repeats, signature_join, suffix_repeats
from tabloom.llm.arrays import WHITE, Words, byte_hasher, covered, ranges
from tabloom.llm.repeats import Symbols, Segments, Unit, expand, expand_sorted, sliding_min, squeeze, squeeze_sorted


def joined(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def random_texts(rng, n, alphabet="ab \n"):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_words_of_many_documents():
    rng = random.Random(2)
    for _ in range(50):
        texts = random_texts(rng, 6, "aé \t\n\x0b")
        data, offsets = joined(texts)
        words = Words(data, offsets, WHITE)
        got = [[data[s:e].tobytes().decode() for s, e in zip(words.starts[a:b], words.ends[a:b])] for a, b in zip(words.cuts, words.cuts[1:])]
        assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]


def test_span_hashes_depend_on_content_alone():
    data, _ = joined(["xabcabcy", "abc"])
    hasher = byte_hasher(data)
    h = hasher.spans(np.array([1, 4, 8, 0]), np.array([4, 7, 11, 3]))
    assert h[0] == h[1] == h[2] != h[3]
    assert hasher.windows(3)[1] == h[0]


def test_small_helpers():
    assert ranges(np.array([3, 9]), np.array([2, 3])).tolist() == [3, 4, 9, 10, 11]
    assert covered(np.array([1, 2]), np.array([3, 4]), 6).tolist() == [False, True, True, True, False, False]
    values = np.array([5, 3, 8, 1, 9], np.uint64)
    assert sliding_min(values, 3).tolist() == [3, 1, 1]
    assert expand(squeeze(values), np.uint64).tolist() == values.tolist()
    keys = np.sort(values)
    assert expand_sorted(squeeze_sorted(keys)).tolist() == keys.tolist()


def test_segments_hold_every_window_once_and_equal_windows_share_their_key():
    rng = random.Random(5)
    unit = Unit("byte", width=12, gram=5, longest=20)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(8)] + ["a" * 90]
    data, offsets = joined(texts)
    found = Segments(Symbols(unit, data, offsets))
    starts = ranges(found.first, found.count)
    expected = [o + i for o, t in zip(offsets.tolist(), texts) for i in range(len(t) - 11)]
    assert sorted(starts.tolist()) == expected
    key_of = {}
    for s, k in zip(starts.tolist(), np.repeat(found.key, found.count).tolist()):
        assert key_of.setdefault(data[s : s + 12].tobytes(), k) == k
    assert (found.count <= 9).all()


@pytest.mark.parametrize("seed", range(40))
def test_suffix_tree_and_fm_index_mark_the_same_symbols_as_brute_force(seed):
    rng = random.Random(seed)
    width, pieces = rng.choice([3, 5, 8]), rng.randint(1, 8)
    segments = [bytes(rng.choice(b"ab" if rng.random() < 0.9 else b"abxyz") for _ in range(rng.randint(0, 40))) for _ in range(pieces)]
    documents = np.array([rng.randint(0, 5) for _ in segments])
    data = np.frombuffer(b"".join(segments), np.uint8)
    cuts = np.concatenate([[0], np.cumsum([len(s) for s in segments])]).astype(np.int64)
    expected = np.zeros(len(data), bool)
    for i, s in enumerate(segments):
        for p in range(len(s) - width + 1):
            window = s[p : p + width]
            if any(documents[j] < documents[i] and window in t for j, t in enumerate(segments)):
                expected[cuts[i] + p : cuts[i] + p + width] = True
    assert suffix_repeats.earlier_bytes(data, cuts, documents, width).tolist() == expected.tolist()
    assert fm_dedup.earlier_words(data.astype(np.uint64), cuts, documents, width).tolist() == expected.tolist()


def test_maximal_repeats_list_all_occurrences():
    data, cuts = joined(["xabcdy", "zabcdw", "qabcd"])
    length, count, at, piece = suffix_repeats.maximal_repeats(data, cuts, 3)
    assert length.tolist() == [4] and count.tolist() == [3]
    assert sorted(zip(piece.tolist(), at.tolist())) == [(0, 1), (1, 7), (2, 13)]


def test_fm_index_counts():
    text = np.array([1, 2, 1, 2, 1, 3, 0], np.int32)
    index = fm_dedup.FMIndex(text, 4)
    low, high = np.zeros(1, np.int64), np.full(1, len(text))
    for symbol in (1, 2, 1):
        low, high = index.extend_left(np.array([symbol]), low, high)
    assert int(high[0] - low[0]) == 2


def test_signature_trees_link_what_all_pairs_link():
    rng = np.random.default_rng(4)
    for trial in range(15):
        base = [rng.integers(0, 1 << 40, rng.integers(5, 60), dtype=np.uint64) for _ in range(6)]
        sets = []
        for _ in range(40):
            chosen = base[rng.integers(len(base))]
            keep = rng.random(len(chosen)) > 0.08
            sets.append(np.unique(np.concatenate([chosen[keep], rng.integers(0, 1 << 40, rng.integers(0, 3), dtype=np.uint64)])))
        sets = [s for s in sets if len(s)]
        tokens, cuts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        node = np.arange(len(sets))
        group = rng.integers(0, 2, len(sets)) if trial % 2 else np.zeros(len(sets), int)
        starts = [(0, 0)] if not group.any() else [(0, 0), (1, 1), (0, 1)]
        links = signature_join.similar_sets(tokens, cuts, group, node, starts, 80)
        parent = list(range(len(sets)))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        other = list(range(len(sets)))
        for a, b in links:
            assert 180 * len(np.intersect1d(sets[a], sets[b])) >= 80 * (len(sets[a]) + len(sets[b]))
            parent[max(root(a), root(b))] = min(root(a), root(b))
        for a in range(len(sets)):
            for b in range(a):
                if 180 * len(np.intersect1d(sets[a], sets[b])) >= 80 * (len(sets[a]) + len(sets[b])):
                    x, y = root(a, other), root(b, other)
                    other[max(x, y)] = min(x, y)
        assert [root(x) for x in range(len(sets))] == [root(x, other) for x in range(len(sets))]


def test_document_statistics():
    texts = ["a b c\na b c\n\n x # $\n", "", "one two three four five six seven eight one two three four five six seven eight", "\n\n"]
    got = quality_rules.statistics(*joined(texts))
    assert got["n_words"].tolist() == [9, 0, 16, 0]
    assert got["n_dup_lines"].tolist() == [1, 0, 0, 0]
    assert got["n_symbols"].tolist() == [2, 0, 0, 0]
    assert got["n_repeat_words"].tolist() == [0, 0, 16, 0]
    assert quality_rules.statistics(*joined(["é ü"]))["word_chars"].tolist() == [2]


def test_document_statistics_against_plain_code():
    rng = random.Random(9)
    texts = random_texts(rng, 30, "ab c\n#|")
    texts += [" ".join(rng.choice("ab") for _ in range(60)) for _ in range(10)]
    got = quality_rules.statistics(*joined(texts))
    for d, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
        lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
        assert got["n_words"][d] == len(words) and got["n_repeat_words"][d] == len(hit)
        assert got["n_dup_lines"][d] == len(lines) - len(set(lines))
        assert got["n_symbols"][d] == sum(c in "#*$%&|<>" for c in text)
        assert got["word_chars"][d] == sum(map(len, words))


def test_trees_are_monotonic_where_asked():
    rng = np.random.default_rng(0)
    x = rng.random((800, 2))
    y = ((x[:, 0] + 0.3 * rng.random(800) < 0.6) ^ (rng.random(800) < 0.1)).astype(float)
    trees = quality_rules.train_trees(x, y, np.array([-1, 0]), rounds=20)
    grid = np.linspace(0, 1, 101)
    for other in (0.1, 0.5, 0.9):
        assert (np.diff(trees.margins(np.stack([grid, np.full(101, other)], axis=1))) <= 1e-12).all()
    assert ((trees.margins(x) > 0) == (y > 0)).mean() > 0.8


def test_normalisers_and_words_sum_to_one():
    model = nce_lm.LogBilinear.initial(np.arange(nce_lm.SYMBOLS) + 1)
    context = np.array([3 * nce_lm.SYMBOLS + 5, nce_lm.END * nce_lm.SYMBOLS + nce_lm.END])
    scores = model.predicted(context) @ model.outputs.T + model.biases - model.normalisers()[context][:, None]
    assert np.allclose(np.exp(scores).sum(axis=1), 1, atol=1e-4)


def test_row_sums_do_not_depend_on_other_rows():
    out = np.zeros((3, 2), np.float32)
    nce_lm.add_rows(out, np.array([2, 0, 2, 0]), np.array([[1, 2], [1e20, -1e20], [3, 4], [0, 1]], np.float32))
    assert out.tolist() == [[np.float32(1e20), np.float32(-1e20)], [0, 0], [4, 6]]
    nce_lm.add_rows(out, np.zeros(0, np.int64), np.zeros((0, 2), np.float32))
    assert out[2].tolist() == [4, 6]


def test_a_step_follows_the_gradient_of_every_pair():
    """Against a loop over the tokens with the noise of the step."""
    rng, n, size = np.random.default_rng(5), nce_lm.SYMBOLS, nce_lm.SIZE
    counts = rng.integers(1, 50, n)
    noise = counts / counts.sum()
    context, target = rng.integers(0, 3, 60) * n + rng.integers(0, 3, 60), rng.integers(0, 4, 60)
    model = nce_lm.LogBilinear.initial(counts)
    old = nce_lm.LogBilinear(model.flat.astype(np.float64))
    want = nce_lm.LogBilinear(np.zeros_like(old.flat))
    drawn = np.random.default_rng(9).choice(n, nce_lm.DRAWN, p=noise)
    for c, t in zip(context, target):
        a, b = divmod(c, n)
        h = old.inputs[a] @ old.matrices[0] + old.inputs[b] @ old.matrices[1]
        back = np.zeros(size)
        for w, observed in [(t, True), *((d, False) for d in drawn)]:
            odds = np.exp(h @ old.outputs[w] + old.biases[w] - np.log(nce_lm.NOISE * noise[w]))
            g = (1 / (1 + odds) if observed else -nce_lm.NOISE / nce_lm.DRAWN * odds / (1 + odds)) / len(context)
            want.outputs[w] += g * h
            want.biases[w] += g
            back += g * old.outputs[w]
        for j, s in enumerate((a, b)):
            want.matrices[j] += np.outer(old.inputs[s], back)
            want.inputs[s] += old.matrices[j] @ back
    seen = np.zeros_like(model.flat)
    model.learn(context, target, noise, seen, np.random.default_rng(9))
    assert np.allclose(seen, want.flat**2, rtol=1e-3, atol=1e-10)
    sure = np.abs(want.flat) > 1e-4
    assert np.allclose((model.flat - old.flat)[sure], (nce_lm.RATE * want.flat / np.sqrt(want.flat**2 + 1e-10))[sure], rtol=1e-3)


def test_contexts_begin_anew_with_each_document():
    symbols, cuts = nce_lm.with_ends(np.array([7, 8, 9]), np.array([0, 2, 2, 3]))
    assert symbols.tolist() == [7, 8, nce_lm.END, nce_lm.END, 9, nce_lm.END]
    e, s = nce_lm.END, nce_lm.SYMBOLS
    assert nce_lm.contexts(symbols, cuts).tolist() == [e * s + e, 7 * s + e, 8 * s + 7, e * s + e, e * s + e, 9 * s + e]


PAGES = {
    "<article><h1>T</h1><p>One &amp; two\n  three</p><p>x</p></article><footer>no</footer>": "T One & two three x",
    '<div class="menu"><a href="/">Home</a></div><div id="content"><p>' + "Long text here. " * 20 + "</p><p>End.</p></div>": ("Long text here. " * 20 + "End.").strip(),
    "<body><nav>menu</nav><main><p>Body text<script>var a='</p>';</script> goes on</p><form>Name <input></form><div class='comments'><p>nice!</p></div></main></body>": "Body text goes on",
    "plain words only": "plain words only",
    "<!-- c --><style>p{}</style>": "",
    "": "",
    "<article><p>a<p>b<ul><li>c</li></ul><aside>no</aside>d<br>e</article>": "a b c d e",
    '<article><div class="cookie-notice">We use cookies</div><p>Kept &lt;b&gt; text</p></article>': "Kept <b> text",
}


@pytest.mark.parametrize("html", list(PAGES))
def test_main_text(html):
    assert html_blocks.main_text(html) == PAGES[html]


def test_a_page_without_article_element_keeps_the_text_between_surge_and_dive():
    body = "".join(f"<div><p>{'word ' * 30}{i}.</p></div>" for i in range(6))
    links = "".join(f'<div><a href="/{i}">Link {i}</a></div>' for i in range(8))
    text = html_blocks.main_text(f"<body>{links}<div><h2>Title</h2></div>{body}{links}</body>")
    assert text == "Title " + " ".join("word " * 30 + f"{i}." for i in range(6))


STORY = [f"Paragraph {i} of the story. " + "word " * 50 + "end." for i in range(5)]
STORY_HTML = "".join(f"<p>{p}</p>" for p in STORY)
CARD = '<article><h3><a href="/x">Another piece</a></h3><p>What it is about.</p></article>'


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div>{STORY_HTML}</div>{CARD}</body>",
        f"<body><article><h3>Other</h3><p>A card without link.</p></article><div>{STORY_HTML}</div></body>",
        f"<body><main><div>{STORY_HTML}</div>{CARD * 4}</main></body>",
        f"<body><article>{STORY_HTML}</article>{CARD * 4}<div>About this site</div></body>",
        f"<body><main><article>{STORY_HTML}{CARD}</article></main></body>",
        f'<body><main>{STORY_HTML}<article class="comment"><p>{"I liked it a lot. " * 5}</p></article></main></body>',
        f'<body><article>{STORY_HTML}<article id="comment-7"><p>{"So did I. " * 30}</p></article></article></body>',
        f"<body><article>{STORY_HTML}" + "<ul>" + '<li><a href="/y">Read this next</a></li>' * 5 + "</ul></article></body>",
    ],
)
def test_cards_comments_and_link_lists_are_not_the_story(page):
    assert html_blocks.main_text(page) == " ".join(STORY)


def test_article_elements_of_one_story_are_kept():
    entries = [f"Entry {i} of the day." for i in range(6)]
    html = f'<main><h1>Live</h1><article>{STORY_HTML}</article>' + "".join(f"<article><h2>At {i}</h2><p>{e}</p></article>" for i, e in enumerate(entries)) + "</main>"
    assert html_blocks.main_text(html) == "Live " + " ".join(STORY) + " " + " ".join(f"At {i} {e}" for i, e in enumerate(entries))
    posts = "".join(f'<article><h2><a href="/{i}">Post {i}</a></h2><p>{p}</p></article>' for i, p in enumerate([STORY[0], "Short.", STORY[1]]))
    assert html_blocks.main_text(f"<body>{posts}</body>") == f"Post 0 {STORY[0]} Post 1 Short. Post 2 {STORY[1]}"
    assert html_blocks.main_text(f"<article>Lead of it. {'lead ' * 50}</article><div>{STORY_HTML}</div>") == f"Lead of it. {('lead ' * 50).strip()} " + " ".join(STORY)


@pytest.mark.parametrize(
    "between",
    [
        '<div class="advert"><p>Buy</p><p>this</p><p>now</p></div>',
        "<ul>" + '<li><a href="/z">Related piece</a></li>' * 4 + "</ul>",
        "<form><p>Your name</p><p>Your mail</p><p>Send</p></form>",
    ],
)
@pytest.mark.parametrize("tag", ["div", "article"])
def test_a_short_end_of_a_parted_story_is_kept(between, tag):
    short = "<p>A short end.</p>"
    whole = " ".join(STORY)
    assert html_blocks.main_text(f"<body><{tag}>{STORY_HTML}{between}{short}</{tag}></body>") == f"{whole} A short end."
    assert html_blocks.main_text(f"<body><{tag}>{short}{between}{STORY_HTML}</{tag}></body>") == f"A short end. {whole}"


def test_a_region_of_links_is_not_text():
    listing = "".join(f'<li><a href="/{i}">A rather long headline of number {i}</a></li><li>{i} min</li>' for i in range(9))
    gap = '<p><a href="/q">q</a></p>' * 3
    assert html_blocks.main_text(f"<body><div>{STORY_HTML}</div>{gap}<ul>{listing}</ul></body>") == " ".join(STORY)


@pytest.mark.parametrize("attribute", ['class="has-sidebar"', "class=no-sidebar", 'class="page overflow-hidden"', 'id="content-side"', 'class="comments-open"', 'class="sidebar-layout"', 'role="form"'])
@pytest.mark.parametrize("tag", ["div", "article"])
def test_a_wrapper_is_not_set_apart(attribute, tag):
    side = f'<div class="sidebar"><p>{"Side text. " * 9}</p></div><div class="comments"><p>{"Nice one. " * 9}</p></div>'
    assert html_blocks.main_text(f"<body><div {attribute}><{tag}>{STORY_HTML}</{tag}>{side}</div></body>") == " ".join(STORY)
    assert html_blocks.main_text(f"<body><{tag} {attribute}>{STORY_HTML}</{tag}>{side}</body>") == " ".join(STORY)


@pytest.mark.parametrize("named", ["sidebar", "comment-list", "comments", "widget_area", "ad", "site-footer", "main-menu"])
def test_named_parts_are_set_apart(named):
    assert html_blocks.main_text(f'<body><div>{STORY_HTML}</div><div class="{named}"><p>{"Other text. " * 30}</p></div></body>') == " ".join(STORY)


def test_comments_and_consent_longer_than_the_story_are_set_apart():
    for named in ("comments", "cookie-consent"):
        assert html_blocks.main_text(f'<body><div>{STORY_HTML}</div><div class="{named}"><p>{"Other text. " * 500}</p></div></body>') == " ".join(STORY)


def test_an_advert_longer_than_a_tiny_article_is_set_apart():
    for named in ("ad", "sidebar"):
        assert html_blocks.main_text(f'<body><div class="{named}">Some words to sell things.</div><article><h1>T.</h1><p>T.</article></body>') == "T. T."


@pytest.mark.parametrize("raw", ["<svg/>", '<svg viewBox="0 0 1 1" />', '<iframe src="a/b"/>', "<script src='x.js'/>", "<svg-icon></svg-icon>", "<svg><title>no</title></svg>", "<script src=//x/>no</script>"])
def test_raw_elements_end_where_they_end(raw):
    assert html_blocks.main_text(f"<body><div>{raw}{STORY_HTML}</div><p>{raw}End.</p><svg><text>no</text></svg></body>") == " ".join(STORY) + " End."


def test_null_html():
    assert html_blocks.main_text(None) == ""


SENTENCES = [f"Sentence number {w} of the story tells what happened on that day in the town." for w in "one two three four five six seven".split()]


@pytest.mark.parametrize("named", ["related-work", "social-history", "search-methods", "share-prices", "copyright", "side"])
def test_sections_of_a_story_may_have_such_names(named):
    parts = [f"<p>{s}</p>" for s in SENTENCES]
    html = f"<article>{''.join(parts[:2])}<section class='{named}'>{''.join(parts[2:4])}</section>{''.join(parts[4:])}</article>"
    assert html_blocks.main_text(html) == " ".join(SENTENCES)


@pytest.mark.parametrize("named", ["related-posts", "social-share", "share-buttons", "menu-item-12", "newsletter signup", "copyright", "cookie-law-info-bar", "wp-block-search"])
def test_parts_that_are_no_story_go(named):
    parts = "".join(f"<p>{s}</p>" for s in SENTENCES)
    links = "<a href=x>More of it</a> <a href=y>Other news</a>"
    assert html_blocks.main_text(f"<article>{parts}<div class='{named}'>{links}</div></article>") == " ".join(SENTENCES)


def test_linked_sentences_inside_a_story_stay():
    parts = [f"<p>{s}</p>" for s in SENTENCES[:2]] + [f"<p><a href=x>{s}</a></p>" for s in SENTENCES[2:6]] + [f"<p>{SENTENCES[6]}</p>"]
    assert html_blocks.main_text(f"<body><article>{''.join(parts)}</article></body>") == " ".join(SENTENCES)
    listing = "".join(f"<li><a href=x>Another title {i}</a></li>" for i in range(9))
    assert html_blocks.main_text(f"<body><article><p>{SENTENCES[0]}</p><ul>{listing}</ul><p>{SENTENCES[1]}</p></article></body>") == " ".join(SENTENCES[:2])


@pytest.mark.parametrize("attribute", ["data-x=it's", "title=\"a > b\" data-y='c > d'", "data-q=\"it's\"", "data-z=a=b'"])
def test_quotes_in_attributes(attribute):
    html = f"<article><p {attribute}>{SENTENCES[0]}</p><p>It's {SENTENCES[1]}</p></article>"
    assert html_blocks.main_text(html) == f"{SENTENCES[0]} It's {SENTENCES[1]}"


def test_key_lists_and_segments_over_tiles(monkeypatch):
    """Window names are made a tile at a time; keys are counted once a document, with owners that have none between."""
    monkeypatch.setattr(arrays, "TILE", 7)
    monkeypatch.setattr(repeats, "TILE", 7)
    rng = random.Random(3)
    unit = Unit("byte", width=12, gram=5, longest=20)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (40, 3, 0, 33, 12, 11, 60, 40)] + ["b" * 50]
    symbols = Symbols(unit, *joined(texts))
    plain = sliding_min(symbols.hasher.windows(5), 8)
    assert repeats.window_names(symbols).tolist() == plain.tolist()
    assert byte_hasher(symbols.data).windows(5).tolist() == arrays.SpanHasher(arrays._BYTE_VALUES[symbols.data]).windows(5).tolist()
    found = Segments(symbols)
    assert set(found.owner.tolist()) == {0, 3, 4, 6, 7, 8}
    documents = {}
    for key, owner in zip(found.key.tolist(), found.owner.tolist()):
        documents.setdefault(key, set()).add(owner)
    got = {}
    for shard, chunk, kind, blob in repeats.key_lists(4, found.key, found.owner, 3, 0):
        keys, count = repeats.split_parts(blob)
        keys = expand_sorted(keys)
        assert (chunk, kind) == (4, 0) and (repeats.shard_of(keys, 3) == shard).all()
        got |= dict(zip(keys.tolist(), expand(count, np.uint8).tolist()))
    assert got == {k: len(v) for k, v in documents.items()}
    assert list(repeats.key_lists(4, found.key[:0], found.owner[:0], 3, 0)) == []
