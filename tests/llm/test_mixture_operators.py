"""Source divergence, source mixing and target resampling against plain Python, and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tesserine.llm import divergence, mixing, resampling
from tesserine.operators import ranges

TERM, WORD, SPACED = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\t ", "a", "B b B b 12 b", "word " * 3000, "\x00\x01 x", "日本語 テスト 한국어 Àé", "é́ ﬁ 😀😀", "a" * 3000, "x²,y a.b!c"]
SCHEMA = "doc_id long, text string, lang string, source string, n long, size long, rank int, value string, _id int"


def ascii_lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def corpus(n=240, seed=1):
    """Documents of four sources and three langs with nulls, odd texts and repeated rows; extra columns clash with the operators' own."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéXY") for _ in range(rnd.randint(1, 4))) for _ in range(90)]
    rows = []
    for i in range(n):
        text = rnd.choice(ODD) if i % 11 == 0 else " ".join(rnd.choice(words[: rnd.choice([12, 90])]) for _ in range(rnd.randint(0, 60)))
        rows.append((None if i == 7 else i, text, rnd.choice(["en", "de", None]), rnd.choice(["web", "books", "s²", None, "web", "web"]), 1, 2, 3, "v", 4))
    rows += rows[:9]
    return rows


def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def plain_audit(rows, least_docs, k):
    held = [(r[2] or "", r[3] or "", TERM.findall(ascii_lower(r[1] or ""))) for r in rows]
    out = []
    for lang in {h[0] for h in held}:
        mine = [h for h in held if h[0] == lang]
        docs = Counter(t for h in mine for t in set(h[2]))
        kept = sorted(t for t, n in docs.items() if n >= least_docs)
        v, counts = len(kept), defaultdict(Counter)
        for _, source, terms in mine:
            counts[source].update(t for t in terms if docs[t] >= least_docs)
        whole = sum(counts.values(), Counter())

        def share(c, t, v=v):
            return 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v)

        for source, own in counts.items():
            pairs = [(-sum((share(own, t) - share(o, t)) ** 2 // (share(own, t) + share(o, t)) for t in kept), other.encode()) for other, o in counts.items() if other != source]
            marks = [(-((share(own, t) - share(whole, t)) ** 2 // (share(own, t) + share(whole, t))), t.encode()) for t in kept if own[t] > 0 and share(own, t) > share(whole, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(marks)[:k])):
                out += [(lang, source, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("least_docs", "k"), [(10, 10), (2, 3), (1000, 10)])
def test_audit_equals_plain_counts(spark, least_docs, k):
    rows = corpus()
    got = divergence.audit(documents(spark, rows), least_docs=least_docs, k=k, few=100_000 if k == 10 else 0)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, least_docs, k)


def test_audit_of_few_or_no_rows(spark):
    assert divergence.audit(documents(spark, []), least_docs=1).collect() == []
    alone = divergence.audit(documents(spark, [(1, "Aa aa b", "x", "s", 1, 1, 1, "", 1)]), least_docs=1)
    assert alone.collect() == []  # no other source, and no term with a larger share than in the lang
    two = [(1, "zz", "x", "s", 1, 1, 1, "", 1), (2, None, "x", None, 1, 1, 1, "", 1)]
    assert sorted(tuple(r) for r in divergence.audit(documents(spark, two), least_docs=1).collect()) == plain_audit(two, 1, 10)


def test_terms_are_never_cut_by_slices():
    text = ("ab" * 40 + " ") * 20 + "é" * 300
    assert Counter(t for part in divergence._slices(text.encode(), 64) for t in part) == Counter({b"ab" * 40: 20, ("é" * 300).encode(): 1})


def test_tasks_that_hand_on_early_count_the_same(spark):
    rows = documents(spark, corpus()).selectExpr("coalesce(lang, '') as lang", "coalesce(source, '') as source", "coalesce(text, '') as text")
    flat = lambda most: divergence.term_counts(rows, most).select("lang", "term", "n_docs", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", "term", "c.sources").agg(F.sum("c.counts")).collect()
    assert set(flat(20)) == set(flat(500_000)) and len(flat(20)) > 100


def test_leading_rows_equal_a_sort(spark):
    rnd = random.Random(4)
    rows = []
    for g in range(6):
        items = {"".join(rnd.choice("abé") for _ in range(rnd.randint(0, 7))) for _ in range(80)} | {"a" * n for n in range(12)} | {"long" * 60 + x for x in ("", "a", "b", "é", "日")}
        rows += [(f"g{g}", i, rnd.choice([0, 5, 5, 5, 1 << 20, (1 << 30) - 1, rnd.randrange(1 << 30)]) if g else 7) for i in items]
    df = spark.createDataFrame(rows, "g string, item string, value long")
    for k, broadcast in ((1, True), (10, True), (25, False), (1000, True)):
        want = set()
        for g in {r[0] for r in rows}:
            ordered = sorted((-v, i.encode()) for h, i, v in rows if h == g)[:k]
            want |= {(g, i.decode(), -v, n) for n, (v, i) in enumerate(ordered, 1)}
        assert {(r.g, r.item, r.value, r["rank"]) for r in divergence.leading(df, ["g"], "value", "item", k, broadcast=broadcast).collect()} == want


def test_shares_stay_exact_for_large_counts(spark):
    big = [(0, 1, 1), (3 * 10**12, 7 * 10**12, 10**9), (8 * 10**14, 8 * 10**14, 3), (5, 10**15, 10**6)]
    got = spark.createDataFrame(big, "c long, n long, v long").select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 2) // (r.n + 2 * r.v) for r in got)


def test_running_totals_equal_a_loop(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot", "hot", "hot", "b", None]), i, rnd.randint(0, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(7)
    for few in (100_000, 0):
        got = {(r.i, r.t) for r in ranges.running(df, ["g"], [F.desc("i")], "v", "t", few).collect()}
        sums, want = Counter(), set()
        for g, i, v in sorted(rows, key=lambda r: -r[1]):
            want.add((i, sums[g]))
            sums[g] += v
        assert got == want
    assert {(r.i, r.t) for r in ranges.running(df, [], [F.asc("i")], None, "t").collect()} == {(i, i) for i in range(3000)}
    assert ranges.running(df.limit(0), ["g"], [F.asc("i")], "v", "t").collect() == []


def plain_mix(rows, quality, most=3, weights=(5, 2, 1)):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(SPACED.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    share = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped, budget = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        level = (budget - sum(most * sizes[s] for s in capped)) / max(1, sum(share[s] for s in free))
        over = {s for s in free if most * sizes[s] < level * share[s]}
        if not over:
            break
        capped |= over
    target = {s: float(most * sizes[s]) if s in capped else level * share[s] for s in order}
    out = []
    for s in order:
        def key(r):
            own = "" if r[0] is None else str(r[0])
            u = (int(hashlib.sha256(f"2024:{own}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            return (-math.log(u) / quality.get(r[0], 2.0), r[0] is not None, r[0] or 0, len(SPACED.findall(r[1] or "")))

        whole = math.floor(target[s] + 0.5)
        rounds, rest = divmod(whole, sizes[s]) if sizes[s] else (0, 0)
        for r in sorted((r for r in rows if r[3] == s), key=key):
            n = len(SPACED.findall(r[1] or ""))
            out.append((r[0], s, n, sizes[s], round(target[s], 6), rounds * n + min(n, rest)))
            rest -= min(n, rest)
    return sorted(out, key=str)


def test_mix_equals_a_plain_loop(spark):
    rows = corpus(300, 5) + [(9000 + i, "rare words here " * (1 + i % 3), "en", f"small{i}", 1, 1, 1, "", 1) for i in range(5)] + [(9900, None, "en", "blank", 1, 1, 1, "", 1)]
    labels = [(i, i % 3 % 2) for i in range(0, 200, 2)] + [(4, 0), (None, 1), (6, None)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int")
    sums = defaultdict(list)
    for i, q in labels:
        if i is not None and q is not None:
            sums[i].append(q)
    weights = {i: 1 + 3 * sum(q) / len(q) for i, q in sums.items()}
    got = mixing.mix(documents(spark, rows), mixing.label_weights(frame))
    found = [(r.doc_id, r.source, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got.collect()]
    assert sorted(found, key=str) == plain_mix(rows, weights)
    taken = defaultdict(int)
    for r in got.collect():
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source, r.target] += r.taken
    assert all(abs(n - target) <= 0.5 for (_, target), n in taken.items())
    plain = mixing.mix(documents(spark, rows), few=0)
    assert sorted([(r.doc_id, r.source, r["size"], r.source_size, round(r.target, 6), r.taken) for r in plain.collect()], key=str) == plain_mix(rows, {})
    assert mixing.mix(documents(spark, [])).collect() == []
    assert [r.taken for r in mixing.mix(documents(spark, [(1, None, None, None, 1, 1, 1, "", 1)])).collect()] == [0]


def test_heavier_documents_are_taken_more_often(spark):
    rows = [(i, "ten words " * 5, "en", "a" if i % 2 else "b", 1, 1, 1, "", 1) for i in range(4000)]
    quality = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 < 2, 4.0).otherwise(1.0).alias("weight"))
    got = mixing.mix(documents(spark, rows), quality).filter("source = 'b'").select((F.col("doc_id") % 4 < 2).alias("good"), "taken").groupBy("good").sum("taken").collect()
    taken = {r.good: r["sum(taken)"] for r in got}
    assert taken[True] > 1.5 * taken[False]


def plain_resample(rows, target, longest, buckets=10_000, percent=10, least=20):
    def features(text):
        words = WORD.findall(ascii_lower(text or ""))
        return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    s, t = Counter(), Counter()
    for r in rows:
        s.update(features(r[1])[1])
    for x in target:
        t.update(features(x)[1])
    total, wanted = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in range(buckets)]
    scored = []
    for r in rows:
        words, found = features(r[1])
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        scored.append((r[0], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((x for x in scored if x[4] >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0, x[1], x[2]))
    drawn = len(able) * percent // 100
    out = [(*x[:4], k if k <= drawn else None) for k, x in enumerate(able, 1)]
    return sorted([*out, *[(*x[:4], None) for x in scored if x[4] < least]], key=str)


@pytest.mark.parametrize(("longest", "chunk"), [(1, 262_144), (1, 50), (3, 40), (2, 262_144)])
def test_resampling_equals_whole_texts(spark, longest, chunk):
    rows, target = corpus(200, 8), ["ab aX 12 x² y", None, "", "word word word", "éa b"] * 3
    frame = spark.createDataFrame([(str(i), x) for i, x in enumerate(target)], "item_id string, text string")
    got = resampling.resample(documents(spark, rows), frame, longest=longest, chunk_bytes=chunk)
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_resample(rows, target, longest)


def test_resampling_of_empty_tables(spark):
    nothing = spark.createDataFrame([], "text string")
    assert resampling.resample(documents(spark, []), nothing).collect() == []
    rows = corpus(60, 3)
    assert sorted([tuple(r) for r in resampling.resample(documents(spark, rows), nothing).collect()], key=str) == plain_resample(rows, [], 1)


def test_chunks_own_every_word_once():
    text = ("one two, three²! " * 30 + "x" * 200 + " end").encode()
    for longest, size in ((1, 10), (3, 25), (4, 10_000)):
        whole = resampling._WORD.findall(text)
        parts = list(resampling.chunks(text, longest, size))
        assert sum(owned for owned, _ in parts) == len(whole)
        found = Counter(h for owned, part in parts for h in resampling.hashes(resampling._WORD.findall(part), owned, longest, 997))
        assert found == Counter(resampling.hashes(whole, len(whole), longest, 997))
