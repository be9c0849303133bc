"""Toxicity and language identification against plain loops over the same definitions."""

import math
import random
from collections import Counter

import numpy as np

from tesserine.llm import language_id, toxicity

SCHEMA = "doc_id long, text string, score double, features int, toxic int, lang string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row


def plain_match(terms, word, clean):
    best = None
    for term, stem in terms.items():
        row = edits(term, word)
        distance = min(row) if stem else row[-1]
        if distance <= (0 if word in clean else toxicity.allowed_edits(term)) and (best is None or (distance, term) < best):
            best = (distance, term)
    return best and (best[1], best[0])


def plain_features(text, terms, clean, window=6):
    folded = text.lower()
    found = [(m.group(), m.start(), m.end()) for m in toxicity._WORD.finditer(folded)]
    words = [f[0] for f in found]
    hits = [(i, *plain_match(terms, w, clean)) for i, w in enumerate(words) if plain_match(terms, w, clean)]
    if not hits:
        return [0.0] * 6
    exact = misspelled = quoted = addressed = 0
    for i, _, distance in hits:
        near = [words[k] for k in range(max(i - window, 0), min(i + window, len(words) - 1) + 1) if k != i]
        left, right = folded[found[max(i - window, 0)][1] : found[i][1]], folded[found[i][2] : found[min(i + window, len(words) - 1)][2] + 1]
        between = any(q in left for q in toxicity._QUOTES) and any(q in right for q in toxicity._QUOTES)
        if between or any(w in toxicity.REPORTING for w in words[max(i - window, 0) : i]):
            quoted += 1
        elif distance:
            misspelled += 1
        else:
            exact += 1
        addressed += any(w in toxicity.ADDRESSING for w in near)
    return [min(exact, 3), min(misspelled, 3), min(quoted, 3), min(addressed, 3), math.log(len(hits)), len(hits) / math.sqrt(len(words))]


def plain_lexicon(rows, least_share=0.9):
    """Words and stems by the evidence of their document counts, from all pairs of a word and a row."""
    share = sum(t for _, t in rows) / len(rows)
    counts = {}
    for text, toxic in rows:
        for word in set(toxicity._WORD.findall(text.lower())):
            counts.setdefault(word, [0, 0])[1 - toxic] += 1
    stems = {}
    for word, (pos, neg) in counts.items():
        for n in toxicity._STEM_LENGTHS:
            if len(word) > n:
                own = stems.setdefault(word[:n], [0, 0, 0])
                stems[word[:n]] = [own[0] + pos, own[1] + neg, own[2] + 1]

    def gain(pos, neg):
        total = pos + neg
        return sum(x * math.log(x / (total * p)) for x, p in ((pos, share), (neg, 1 - share)) if x)

    strong = lambda w, pos, neg: pos >= least_share * (pos + neg) and len(w) >= 3 and gain(pos, neg) >= math.log(1e6) + 2
    whole = {w: gain(p, n) for w, (p, n) in counts.items() if strong(w, p, n)}
    terms = {}
    for stem in sorted((s for s, (p, n, forms) in stems.items() if forms >= 3 and strong(s, p, n)), key=lambda s: (len(s), s)):
        inside = max((g for w, g in whole.items() if w.startswith(stem)), default=0.0)
        if gain(*stems[stem][:2]) > 1.3 * inside and not any(stem.startswith(t) for t in terms):
            terms[stem] = True
    return terms | {w: False for w in whole if not any(w.startswith(t) for t in terms)}, {w for w, (p, n) in counts.items() if p < least_share * (p + n)}


def toxic_corpus(n=500, seed=2):
    rnd = random.Random(seed)
    clean = ["".join(rnd.choice("aeiourstln") for _ in range(rnd.randint(2, 7))) for _ in range(150)] + ["you", "said", "zorgblot"]
    rows = []
    for k in range(n):
        words = [rnd.choice(clean) for _ in range(rnd.randint(5, 40))]
        if k % 3 == 0:
            words.insert(rnd.randrange(len(words)), rnd.choice(["zorgblat", "vexnip", "vexnips", "vexniper", "vexnipping", "zorgblt", "grumf"]))
        if k % 17 == 0:
            words.insert(0, "“zorgblat”")
        rows.append((" ".join(words) if k % 50 else words[0], int(k % 3 == 0)))
    return rows


def test_toxicity_equals_plain_loops(spark):
    rows = toxic_corpus()
    texts = [t for t, _ in rows] + ["", None, "Zorgblat! zorg", "you zorgbla1t vexnipz " * 400, "he said zorgblat and “vexnips”.", "zorgblot zorgblat"]
    docs = spark.createDataFrame([(k, t, 0.5, 1, 9, "x") for k, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(k, toxic) for k, (_, toxic) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, parts=1, held_out=-1)
    terms, clean = plain_lexicon(rows)
    assert model.terms == terms and len(terms) >= 3
    near = {w for w in clean if any(edits(t, w)[-1] <= 1 or (s and min(edits(t, w)) <= 1) for t, s in terms.items())}
    assert near <= model.clean <= clean and "zorgblot" in near
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for k, text in enumerate(texts):
        want = plain_features(text or "", terms, clean)
        assert np.allclose(got[k].features, want)
        z = sum((f - c) / s * w for f, c, s, w in zip(want, model.centre, model.scale, model.weights, strict=True)) + model.bias
        assert abs(got[k].score - 1 / (1 + math.exp(-z))) < 1e-9 and got[k].predicted == int(got[k].score >= 0.5)
    known = Counter(tuple(plain_features(t, terms, clean)) + (y,) for t, y in rows)
    x, y = np.array([k[:-1] for k in known for _ in range(known[k])], float), np.array([k[-1] for k in known for _ in range(known[k])], float)
    w, b = np.zeros(6), 0.0
    scaled = (x - x.mean(0)) / np.maximum(x.std(0), 1e-6)
    for _ in range(60_000):  # plain gradient steps to the same optimum
        p = 1 / (1 + np.exp(-(scaled @ w + b)))
        w, b = w - 2e-3 * (scaled.T @ (p - y) + w), b - 2e-3 * ((p - y).sum() + 1e-3 * b)
    assert np.allclose(w, model.weights, atol=1e-3) and abs(b - model.bias) < 1e-3


def test_empty_tables_and_long_texts(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.learn(none, labels) is None and toxicity.score(none, None).collect() == []
    assert language_id.identify(none).collect() == []
    long = spark.createDataFrame([(k, ("der hund und die katze " if k % 2 else "the dog and the cat ") * (30_000 if k == 6 else 3), 0.1, 1, 1, "de" if k % 2 else "en") for k in range(40)], SCHEMA)
    rows = {r.doc_id: r for r in language_id.identify(long).collect()}
    assert rows[6].lang_pred == "en" and 0.5 < rows[6].score <= 1


def plain_direction(codes, table, loop):
    """One row's states, position by position, gate by gate."""
    size, state, out = loop.shape[0], np.zeros(loop.shape[0]), []
    gate = lambda x: 1 / (1 + np.exp(-x))
    for c in codes:
        u = gate(table[c][:size] + state @ loop[:, :size])
        r = gate(table[c][size : 2 * size] + state @ loop[:, size : 2 * size])
        candidate = np.tanh(table[c][2 * size :] + r * (state @ loop[:, 2 * size :]))
        state = u * state + (1 - u) * candidate
        out.append(state)
    return np.array(out)


def test_document_chances_equal_plain_loops():
    net = language_id.Network.new(["a", "b", "c"], 8, 5)
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, 255, n).astype(np.uint8) for n in (1, 7, 64, 128, 129, 300, 513)] + [np.zeros(0, np.uint8)]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    got = language_id.document_chances(net, np.concatenate(texts), offsets, segment=128, block=3)
    table_f, loop_f, table_b, loop_b, matrix, bias = (w.astype(np.float64) for w in net.weights)
    for k, text in enumerate(texts):
        pieces = -(-len(text) // 128)
        total = np.zeros(3)
        for p in range(pieces):
            codes = text[p * len(text) // pieces : (p + 1) * len(text) // pieces].astype(int)
            both = np.c_[plain_direction(codes, table_f, loop_f), plain_direction(codes[::-1], table_b, loop_b)[::-1]]
            z = both @ matrix + bias
            chances = np.exp(z - z.max(1, keepdims=True))
            total += (chances / chances.sum(1, keepdims=True)).sum(0)
        assert np.allclose(got[k], total / max(len(text), 1), atol=1e-4)
