"""The training-data operators against brute force, the libraries, and odd rows."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tesserine.llm import components, decontaminate, html_extract, induced_sort, language_id, near_dedup, packed, piece_bpe, sentencepiece_codec, substring_dedup, suffix_dedup, token_counts, toxicity, vector_dedup

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\t ", "a", "b b b b b b", "word " * 3000, "\x00\x01 x", "日本語 テスト 한국어", "é́ ﬁ 😀😀", "<s> </s> <unk> <0x0A>", "▁x▁▁y", "a" * 3000, "x²,y a.b!c"]


def documents(spark, texts, ids=None):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "x", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, kept int")


def corpus(n=60, seed=0):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    made = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 120))) for _ in range(n)]
    passage = " ".join(rnd.choice(words) for _ in range(45))
    made += [f"{made[k]} {passage} {made[k + 1]}" for k in range(0, 20, 2)] + made[:6] + [m.replace(" ", "  ", 3) for m in made[6:9]]
    for base in made[10:16]:
        own = base.split()
        if len(own) > 40:
            own[20] = "changed"
            made.append(" ".join(own))
    return made + ODD


def test_encoding_equals_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = corpus()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentencepiece_codec.digest(sentencepiece_codec.encode_decode(documents(spark, texts), MODEL)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, text in enumerate(texts):
        ids = library.encode(text or "") + [library.eos_id()]
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    counts = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(documents(spark, texts), MODEL).collect()}
    assert counts == {i: (len((t or "").encode()), len(library.encode(t or ""))) for i, t in enumerate(texts)}


def test_backtracking_and_decoding_of_random_input():
    library, model, rnd = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_bpe.PieceModel(MODEL), random.Random(3)
    for _ in range(800):
        text = "".join(rnd.choice("ab the  ▁\n.é日😀in,!?²-_'") for _ in range(rnd.randint(1, 70)))
        assert model.encode(text) == library.encode(text)
        ids = [rnd.choice([rnd.randrange(300), rnd.randrange(32000)]) for _ in range(rnd.randint(0, 9))]
        assert model.decode(ids) == library.decode(ids)


def brute_windows(texts, width, across):
    """(covered units, pieces) by looking every window up in a dictionary; ``across`` counts only smaller documents."""
    first = {}
    for d, units in enumerate(texts):
        for i in range(len(units) - width + 1):
            first.setdefault(units[i : i + width], (d, i))
    out = []
    for d, units in enumerate(texts):
        cover = [False] * len(units)
        for i in range(len(units) - width + 1):
            f = first[units[i : i + width]]
            if (f[0] < d) if across else (f < (d, i)):
                cover[i : i + width] = [True] * width
        out.append(cover)
    return out


def test_substring_dedup_equals_brute_force(spark):
    texts = corpus()
    split = [tuple((t or "").encode().split()) for t in texts]
    got = {r.doc_id: r for r in substring_dedup.dedup(documents(spark, texts), width=20, carry=("ids",)).collect()}
    for d, cover in enumerate(brute_windows(split, 20, False)):
        kept = b" ".join(w for w, c in zip(split[d], cover, strict=True) if not c).decode()
        assert (got[d].n_words, got[d].n_removed, got[d].kept, got[d].ids) == (len(split[d]), sum(cover), kept, "x")
        assert got[d].text_after == (kept if any(cover) else texts[d])
    assert substring_dedup.dedup(documents(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("hot_runs", [500_000, 3])
def test_suffix_dedup_equals_brute_force(spark, hot_runs):
    """Every second run goes window by window with ``hot_runs`` 3; queues spill all the time."""
    texts = corpus(40)
    raw = [(t or "").encode() for t in texts]
    found = suffix_dedup.dedup(documents(spark, texts), memory_items=500, hot_runs=hot_runs)
    got = {r.doc_id: r for r in found.collect()}
    short = {r.doc_id: r for r in suffix_dedup.digest(found).collect()}
    for d, cover in enumerate(brute_windows(raw, 50, True)):
        kept = bytes(b for b, c in zip(raw[d], cover, strict=True) if not c)
        assert (got[d].n_bytes, got[d].n_removed, bytes(got[d].kept)) == (len(raw[d]), sum(cover), kept)
        edges = np.flatnonzero(np.diff(np.r_[0, np.array(cover, int), 0])).reshape(-1, 2).tolist()
        assert [[s.start, s.end] for s in got[d].spans] == edges
        assert (short[d].n_spans, short[d].kept_sha256) == (len(edges), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("depth", [3, 9, 20])
def test_induced_order(depth):
    rng = np.random.default_rng(depth)
    for memory in (5, 10**6):
        parts = [bytes(rng.integers(97, 97 + k % 4 + 1, 30).astype(np.uint8)) for k in range(25)]
        text = np.frombuffer(b"\x01" + b"\x01".join(bytes(b + 2 for b in p) for p in parts + parts[:9]) + b"\x01\x00", np.uint8)
        found = np.concatenate([p for p, _ in reversed(list(induced_sort.equal_windows(text, depth, memory)))])
        assert sorted(found.tolist()) == list(range(len(text)))
        starts = [bytes(text[p : p + depth]) for p in found]
        assert starts == sorted(starts)
        wanted = np.flatnonzero(rng.random(len(text) - 1) < 0.3)
        some = list(induced_sort.equal_windows(text, depth, memory, wanted))[::-1]
        places = np.concatenate([p for p, _ in some])
        starts = [bytes(text[p : p + depth]) for p in places]
        assert set(wanted) <= set(places.tolist()) and starts == sorted(starts)
        same = np.concatenate([e for _, e in some])
        assert all(e == (a == b and len(a) == depth) for a, b, e in zip(starts[:-1], starts[1:], same[1:], strict=True))


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(low[i : i + 5]) for i in range(len(low) - 4)} if len(low) >= 5 else {tuple(low)} - {()}


def test_near_duplicates_equal_brute_force(spark):
    texts = corpus()
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}
    nulls = documents(spark, ["same text of five words here", "same text of five words here", None], [None, 4, 5])
    rows = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_dedup.near_duplicates(nulls).collect())
    assert rows == [(-1, None, True), (4, 4, True), (5, 5, True)]


def test_sketches_merge_and_estimate():
    rng, sketch = np.random.default_rng(1), near_dedup.Sketch()
    base, other = (np.sort(rng.integers(0, 2**63, 500).astype(np.uint64)) for _ in range(2))
    mixed = np.unique(np.r_[base[:400], other[:100]])
    regs = near_dedup.registers(np.r_[base, other, mixed, np.union1d(base, other)], np.array([500, 500, 500, 1000]), sketch)
    assert (near_dedup.merge_registers(regs[0], regs[1]) == regs[3]).all()
    estimate = near_dedup.likely_similarity(regs[:1], regs[2:3], np.array([500.0]), np.array([500.0]), sketch)[0]
    assert abs(estimate - 400 / 600) < 0.12


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(links, "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_decontamination_tolerates_substitutions(spark):
    rnd = random.Random(2)
    items = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(30)) for _ in range(3)] + ["tiny item", None, ""]
    one = items[0].split()
    for k in (3, 11, 19, 27):
        one[k] = "other"
    texts = ["clean " * 50 + items[1].split()[0], "lead in " + items[0].upper() + " tail", " ".join(one), ", ".join(items[2].split()), " ".join(items[1].split()[:8]), None, "", "word " * 5000 + items[1]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(documents(spark, texts), bench).collect()}
    assert got == {(1, 0), (2, 0), (3, 2), (7, 1)}
    assert decontaminate.overlaps(documents(spark, texts), bench.limit(0)).count() == 0
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(documents(spark, texts), bench, broadcast_rows=0).collect()} == got


def test_templates_go_and_articles_stay(spark):
    page = lambda k, host: (k, f"https://{host}/p{k}", f"<html><head><title>t</title><script>x</script></head><body><div class='top'><a>Home</a> <a>About</a></div><div><p>Story {k} &amp; more<br>line<p>Next&nbsp;{k}</div><div>Site wide words</div><div class='comments'>hey {k}</div>")
    rows = [page(k, "a.example") for k in range(6)] + [page(9, "b.example"), (20, None, None), (21, "nonsense", "<<< < a"), (None, "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for rows in (500_000, 0):
        got = {r.page_id: r.text for r in html_extract.extract(pages, broadcast_rows=rows).collect()}
        assert got[0] == "Story 0 & more line\nNext 0"
        assert got[9] == "Home About\nStory 9 & more line\nNext 9\nSite wide words"
        assert got[20] == "" and got[None] == "" and len(got) == 10


def test_articles_and_copied_pages_are_no_template(spark):
    table = lambda k: f"<div><article><div><h1>Item {k}</h1><table><tr><th>Feature<td>Yes</table><ul><li>fast</ul></div></article></div><div>Legal words</div>"
    rows = [(k, "https://a.example/", table(k)) for k in range(5)]
    rows += [(10 + k, "https://b.example/", "<div><h1>Copied</h1><p>One story</div>") for k in range(3)]
    rows += [(20 + k, "https://c.example/", f"<div><p>Story {k}</div><div>Rare box</div>" if k < 3 else f"<p>Story {k}") for k in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got[2] == "Item 2\nFeature\nYes\nfast"
    assert got[11] == "Copied\nOne story"
    assert got[20] == "Story 0\nRare box"
    got = {r.page_id: r.text for r in html_extract.extract(pages, enough_pages=3).collect()}
    assert got[20] == "Story 0"


def test_furniture_words_never_take_an_article_or_a_heading():
    text = html_extract.main_text
    assert text("<div class='layout has-sidebar'><article><p>one</article></div>") == "one"
    assert text("<div class='sidebar'><article><p>one</article></div>") == "one"
    assert text("<div id='content-sidebar-wrap'><p>one</div><div class='sidebar'>two</div>") == "one"
    assert text("<article class='post comments-open related'><h1 class='post-header header'>Title</h1><p>one</article>") == "Title\none"
    assert text("<div class='header-and-content'><p>one</div><div class='ad-slot'>two</div><div role='banner'>three</div>") == "one"
    assert text("<div hidden><article>one</article></div><p>two") == "two"


def test_parser_survives_broken_markup():
    assert html_extract.main_text("<article><p>in <b>bold<p>next<ul><li>1<li>2</ul></article><footer>no</footer>") == "in bold\nnext\n1\n2"
    assert html_extract.main_text("<div>" * 3000 + "deep") == "deep"
    assert html_extract.main_text("text <!-- open comment") == "text"
    assert html_extract.main_text("<p>a &lt; b</p><style>p{}") == "a < b"


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_levenshtein_automaton_equals_distance():
    terms = {"moron": False, "worthless": False, "lowei": True, "scum": False}
    trie, rnd = toxicity.Trie.of(terms), random.Random(8)
    scanner = toxicity.Finder(terms, frozenset())
    words = ["moron", "m0ron", "mooorn", "wrthless", "loweixyz", "lweiabc", "lowiexx", "scum", "scun", "other", ""]
    for term in terms:
        for _ in range(150):
            letters = list(term + rnd.choice(["", "ab", "n"]))
            for _ in range(rnd.randint(0, 2)):
                at = rnd.randrange(len(letters) + 1)
                letters[at : at + rnd.randint(0, 1)] = rnd.choice(["", "m", "e", "o"])
            words.append("".join(letters))
    for word in words:
        near = []
        for term, stem in terms.items():
            distance = min(edit_distance(term, word[:n]) for n in range(len(word) + 1)) if stem else edit_distance(term, word)
            if distance <= toxicity.allowed_edits(term):
                near.append((distance, term))
        expect = min(near)[::-1] if near else None
        assert toxicity.matches(trie, word) == scanner.find(word) == expect, word
    assert toxicity.matches(trie, "moro", frozenset({"moro"})) is None


def test_toxicity_learns_only_from_other_folds(spark):
    rnd = random.Random(4)
    clean = ["".join(rnd.choice("aeiourstln") for _ in range(5)) for _ in range(200)]
    texts = [" ".join(rnd.choice(clean) for _ in range(30)) + (" you zorgblat" if k % 4 == 0 else "") for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    docs = documents(spark, [*texts, None, "", "some zorgblatt"])
    model = toxicity.learn(docs, labels)
    assert "zorgblat" in model.terms
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[k].predicted == int(k % 4 == 0) for k in range(400))
    assert got[400].predicted == got[401].predicted == 0 and got[402].score > got[401].score
    assert toxicity.learn(docs, labels.limit(0)) is None


def test_gradients_and_network(spark):
    net = language_id.Network.new(["a", "b", "c"], 3, 0)
    net.weights = [w.astype(np.float64) for w in net.weights]
    codes, gold = np.random.default_rng(0).integers(0, 9, (6, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, grads = language_id.gradients(net, codes, gold)
    for w, g in zip(net.weights, grads, strict=True):
        for at in list(np.ndindex(w.shape))[:12]:
            was = w[at]
            w[at] = was + 1e-4
            up, _ = language_id.gradients(net, codes, gold)
            w[at] = was - 1e-4
            down, _ = language_id.gradients(net, codes, gold)
            w[at] = was
            assert abs((up - down) / 2e-4 - g[at]) < 1e-6
    net = language_id.Network.new(["a", "b"], 8, 1)
    states = language_id._states(codes.astype(np.intp), net.weights[0], net.weights[1])
    assert np.allclose(states, np.stack(language_id._layer(codes, net.weights[0], net.weights[1])), atol=1e-5)


def test_language_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(1, None, "en"), (2, "123 !?", None), (3, "", "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.predict(odd, language_id.Network.new(["en"], 8, 0)).collect()} == {"und"}
    assert {r.lang_pred for r in language_id.identify(odd).collect()} == {"und"}


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i] + 0.08 * rng.standard_normal(16)).tolist(), i % 3) for i in range(20)]
    rows += [(200 + i, (3 * base[i]).tolist(), i % 3) for i in range(10)] + [(300 + i, base[0].tolist(), 0) for i in range(5)]
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, [None] + [1.0] * 15, 0), (404, base[0].tolist(), None), (405, [1.0, 2.0], 0), (None, base[0].tolist(), 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    ok = [(i, np.array(v), label) for i, v, label in rows if i is not None and i < 400]
    links = {i: {j for j, w, m in ok if j != i and m == label and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93} for i, v, label in ok}
    found = sum(min(got[i][0], len(own)) for i, own in links.items())
    assert found >= 0.9 * sum(map(len, links.values()))
    assert all(got[i][0] <= len(own) for i, own in links.items())
    assert got[0][0] >= 6 and got[300][1] == 0
    assert all(got[i] == (0, i, True) for i in (400, 401, 402, 403, 404, 405)) and got[None] == (0, None, True)


@pytest.mark.parametrize("common", [0.0, 0.5, 0.7])
def test_vector_recall_with_a_common_mean(spark, common):
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(np.sqrt(common) * unit(np.ones(64)) + np.sqrt(1 - common) * unit(rng.standard_normal((1000, 64))))
    away = rng.standard_normal(x.shape)
    away = unit(away - (away * x).sum(1, keepdims=True) * x)
    y = 0.9305 * x + np.sqrt(1 - 0.9305**2) * away
    ids = np.r_[50 * np.arange(1000), 50 * np.arange(1000) + 1]
    every = np.r_[x, y]
    rows = [(int(i), 0, v.tolist()) for i, v in zip(ids, every, strict=True)]
    vectors = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    got = {(r.x, r.y) for r in vector_dedup.links(vectors)[2].collect()}
    near = np.argwhere(x @ every.T >= 0.93)
    want = {tuple(sorted((int(ids[q]), int(ids[p])))) for q, p in near if ids[q] != ids[p]}  # queries: ids divisible by 50
    print("recall", common, len(want & got) / len(want))
    assert len(want & got) >= 0.995 * len(want) and len(want) >= 1000


def test_words_and_hashes_do_not_cross_rows():
    import pyarrow as pa

    column = pa.array(["ab cd", None, "", "cd\x0bé", "  x "])
    data, offsets = packed.buffers(column)
    starts, ends, counts = packed.words(data, offsets)
    assert counts.tolist() == [2, 0, 0, 2, 1]
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == ["ab", "cd", "cd", "é", "x"]
    codes = packed.span_hashes(data, starts, ends)
    assert codes[1] == codes[2] and len(set(codes.tolist())) == 4


def test_furniture_is_told_by_words_size_and_links():
    text, body = html_extract.main_text, "<p>" + "a sentence of the text. " * 6 + "</p>"
    prose = ("a sentence of the text. " * 6).strip()
    for mark in ("class='comment-list'", "id='comments-area'", "class='user-comment'", "class='site-footer'", "id=leftSidebar", "class='top_nav'", "class='menu-wrap'", "role=search", "class='cookie-bar'"):
        assert text(f"<body><article>{body}</article><div {mark}>other words</div>") == prose
        assert text(f"<body><article>short</article><div {mark}>{body}{body}</div>") == "short"  # beside an article whatever its size
        assert text(f"<body><div>{body}</div><div {mark}>other words</div>") == prose  # the smaller part of a page without article
    for mark in ("class='related'", "class='widget'", "class='post share'", "class='promo-free article-body'", "class='has-sidebar'", "class='no-comments open'", "id='header'"):
        assert text(f"<body><div {mark}>{body}</div>") == prose
    assert text("<body><div class='menu-items'>" + "<a href=x>link text</a> " * 20 + "</div><div>short</div>") == "short"  # most of the page, but links
    assert text(f"<article>{body}<div class='share'>tweet</div><div class='comments'><p>me too</p></div></article>") == prose
    assert text(f"<article><header class='post-header'><h1>Title</h1></header>{body}</article><header><h1>Site</h1></header>") == f"Title\n{prose}"
    assert text(f"<div class='comments sidebar'><article>{body}</article></div>") == prose


def test_neutral_furniture_goes_by_recurrence_alone(spark):
    box = "<div><p>Call us on working days</p><p>Imprint and terms</p></div>"
    rows = [(i, f"http://a.example/{i}", f"<body>{box}<div><p>page {i} says {'word ' * (i + 3)}</p></div>{box}", "x", 1) for i in range(6)]
    rows += [(9, "http://b.example/9", f"<body>{box}<div><p>alone</p></div>", "x", 1), rows[0], (10, None, None, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, _host int")
    got = sorted((r.page_id, r.text) for r in html_extract.extract(frame).collect())
    want = [(i, f"page {i} says {('word ' * (i + 3)).strip()}") for i in range(6)] + [(0, "page 0 says word word word"), (9, "Call us on working days\nImprint and terms\nalone"), (10, "")]
    assert got == sorted(want)


def test_html_raw_text_and_deep_pages():
    text = html_extract.main_text
    assert text("<p>one</p><script>for(i=0;i<n;i++){}</script><p>main text</p>") == "one\nmain text"
    assert text("<script>var a='<!--';</script><p>main text</p>") == "main text"
    assert text('<SCRIPT>if(a<b && c=="x"){d()}</Script ><p>body</p>') == "body"
    assert text("<title>a <b> c<p>text</p>") == "a c\ntext"
    assert text("<p>kept</p><script>never closed <p>no</p>") == "kept"
    assert text("<div>" * 300 + "<p>alpha</p><p>beta</p>") == "alpha\nbeta"
    assert text("<b>" * 20_000 + "<p>alpha</p></i>" * 2000 + "x") == "\n".join(["alpha"] * 2000 + ["x"])
    assert text("<div class='post-with-comments'><p>main text</p></div>") == "main text"
    assert text("<article><p>short teaser</p></article><div class=content>the real body of the page</div>") == "short teaser\nthe real body of the page"
    assert text("<div>side</div><article><p>the real body of the page</p></article>") == "the real body of the page"


def brute_pages(pages, least_pages=3, least_share=0.02, enough=100):
    """Main texts by comparing every subtree of a host's pages with every other one, structure by structure."""

    def shape(node):
        return (node.tag, node.marks, tuple(" ".join(c.split()) if isinstance(c, str) else shape(c) for c in node.children))

    def parts(node, inside=False):
        inside = inside or node.tag in ("article", "main")
        for child in node.children:
            if not isinstance(child, str):
                if child.tag in html_extract.BLOCK - {"html", "body", "head"} and not inside and not child.core and child.tag not in ("article", "main"):
                    yield child
                yield from parts(child, inside)

    by_host = {}
    for key, url, page in pages:
        by_host.setdefault((url or "").split("/")[2] if "//" in (url or "") else "", []).append((key, html_extract.parse(page or "")))
    out = {}
    for own in by_host.values():
        texts = {html_extract._read(root) for _, root in own}
        seen = [(html_extract._read(root), [shape(n) for n in parts(root)]) for _, root in own]
        for key, root in own:
            for node in list(parts(root)):
                mine = shape(node)
                n = len({text for text, shapes in seen if any(s == mine for s in shapes)})
                if n >= least_pages and (n >= enough or n >= least_share * len(texts)):
                    node.drop = True
            out[key] = html_extract._read(root)
    return out


def test_html_templates_equal_brute_force(spark):
    """Furniture without tell-tale tags or classes goes only because it recurs on its host."""
    rnd = random.Random(5)
    words = lambda n: " ".join("".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 6))) for _ in range(n))
    pages = []
    for host in range(4):
        bar, foot = f"<div><ul><li>{words(2)}<li>{words(1)}</ul></div>", f"<div class=x{host}><p>{words(6)}</p><p>{words(3)}</p></div>"
        for k in range(12):
            own = "".join(f"<p>{words(rnd.randint(1, 9))}</p>" for _ in range(rnd.randint(1, 4)))
            body = rnd.choice([f"<div>{own}</div>", f"<article>{own}<p>said on all</p></article>", own])
            pages.append((len(pages), f"http://h{host}.example/{k}", rnd.choice([bar, ""]) + body + rnd.choice([foot, foot, f"<div>{words(3)}</div>"])))
        pages.append((len(pages), f"http://h{host}.example/copy", pages[-1][2]))
    pages += [(len(pages), None, None), (len(pages) + 1, "http://h0.example/e", ""), (len(pages) + 2, "nohost", "<p>alone</p>")]
    wanted = brute_pages(pages)
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(frame).collect()}
    assert got == wanted
    assert any(html_extract.main_text(page) != wanted[key] for key, _, page in pages)
    assert html_extract.extract(frame.limit(0)).count() == 0


def test_operators_on_empty_tables_null_ids_and_repeated_rows(spark):
    """An empty table gives an empty result; rows with a null id and repeated rows keep their number."""
    texts = ["one two three four five six seven", None, "", "one two three four five six seven", "x " * 60]
    docs = documents(spark, texts + texts[:1], [1, 2, 3, None, 5, 1])
    bench = spark.createDataFrame([(1, "some item of the test set here")], "item_id long, text string")
    runs = {
        "op3": lambda d: sentencepiece_codec.digest(sentencepiece_codec.encode_decode(d, MODEL)), "op4": lambda d: substring_dedup.digest(substring_dedup.dedup(d)), "op5": near_dedup.near_duplicates,
        "op6": lambda d: token_counts.count_tokens(d, MODEL), "op7": lambda d: toxicity.score(d, None), "op8": lambda d: suffix_dedup.digest(suffix_dedup.dedup(d)), "op10": lambda d: language_id.predict(d, None),
    }
    for name, run in runs.items():
        assert run(docs).count() == 6, name
        assert run(docs.limit(0)).count() == 0, name
    assert decontaminate.overlaps(docs.limit(0), bench).count() == 0
    assert decontaminate.overlaps(docs, bench).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 1, "x"), (1, [1.0, 0.0], 1, "x"), (None, [1.0, 0.0], 1, "x"), (2, None, 1, "x"), (3, [1.0, 0.01], 1, "x")], "vec_id long, embedding array<double>, label int, kept string")
    got = vector_dedup.near_duplicates(vectors)
    assert sorted((r.vec_id or -1, r.n_links, r.component_id) for r in got.collect()) == [(-1, 0, None), (1, 1, 1), (1, 1, 1), (2, 0, 2), (3, 1, 1)]
    assert vector_dedup.near_duplicates(vectors.limit(0)).count() == 0
    kept = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert (1, 1, True) in kept and (None, None, True) in kept


def test_pipeline_stages_equal_brute_force(spark, small, tmp_path):
    """Each stage against a plain version of its decision, over its own input, with null, empty and repeated rows."""
    import corpus_pipeline as p

    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    texts = corpus(40) + ["lead in " + items[0] + " tail", items[1]]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1), (None, "no id here", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(p.STAGES)

    def ran(name, given):
        out = stage[name](spark, given, small)
        assert stage[name](spark, given.limit(0), small).count() == 0
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    toxic = ran("toxicity", docs)
    assert toxic.columns == p.COLUMNS
    judged = {r.doc_id for r in toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{small}/labels.parquet"))).filter("predicted = 1").collect()}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in toxic.collect()) == sorted((r[0] is None, r[0] or 0) for r in rows if r[0] is None or r[0] not in judged)

    near = ran("near_dedup", toxic)
    own = [(r.doc_id, r.text) for r in toxic.collect()]
    sets = {i: shingles(t) for i, t in own if i is not None}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[i]] == root[i] for i in root):
            break
    assert {r.doc_id for r in near.collect()} == {i for i, _ in own if i is None or root[i] == i}

    rest = ran("substring_dedup", near)
    order = sorted({(r.doc_id is None, r.doc_id or 0): r.text for r in near.collect()}.items())
    split = [tuple((t or "").encode().split()) for _, t in order]
    left = {}
    for ((no_id, i), t), words, cover in zip(order, split, brute_windows(split, 20, False), strict=True):
        after = b" ".join(w for w, c in zip(words, cover, strict=True) if not c).decode()
        if not any(cover) or after:
            left[None if no_id else i] = after if any(cover) else t
    assert {r.doc_id: r.text for r in rest.collect()} == left

    clean = ran("decontamination", rest)
    gone = {r.doc_id for r in rest.collect()} - {r.doc_id for r in clean.collect()}
    assert {len(texts) - 2, len(texts) - 1} & {r.doc_id for r in rest.collect()} == gone and gone

    coded = ran("sentencepiece", clean)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in coded.join(clean.select("doc_id", "text"), "doc_id").collect():
        ids = library.encode(r.text or "") + [library.eos_id()]
        assert (r.ids, r.n_tokens, r.decoded) == (" ".join(map(str, ids)), len(ids), library.decode(ids))
    assert coded.count() == clean.count()
