"""Operator 7: toxicity by Levenshtein automata over a lexicon trie, and scores of the hits' contexts."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, held, release, small_batches
from .piece_bpe import Memo

_WORD = re.compile(r"[^\W_]+(?:[*@$!][^\W_]+)*")
_QUOTES = "\"“”„«»‹›‘’"
# Words that report or address, by language.
REPORTING = frozenset("said says called wrote word words term quote quoted quotes slur insult sagte nannte wort zitat begriff dit appelle mot terme citation dijo llama palabra termino cita".split())
ADDRESSING = frozenset("you your youre yourself du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes vosotros".split())
#: Features of a document, in this order.
FEATURES = ("exact", "misspelled", "quoted", "addressed", "repeated", "dense")
_MEMO = 100_000
_STEM_LENGTHS = range(4, 9)


@dataclass
class Trie:
    """Lexicon terms; a stem accepts any ending."""

    next: dict[str, Trie] = field(default_factory=dict)
    term: str = ""
    stem: bool = False

    @staticmethod
    def of(terms: dict[str, bool]) -> Trie:
        root = Trie()
        for term, stem in terms.items():
            node = root
            for c in term:
                node = node.next.setdefault(c, Trie())
            node.term, node.stem = term, stem
        return root


def allowed_edits(term: str) -> int:
    """Short terms must match exactly, others may have one letter more, less or changed."""
    return 1 if len(term) >= 5 else 0


def matches(trie: Trie, word: str, clean: frozenset[str] = frozenset()) -> tuple[str, int] | None:
    """The lexicon term nearest to ``word`` within its allowed edits, and the distance.

    Runs the word's Levenshtein automaton and the trie side by side.  The automaton's
    states are kept as two sets of places in the word, those reached without and
    with one edit, as bits of two numbers; a trie path whose sets are empty is left.
    Words of ``clean`` match exactly only.
    """
    n, fuzzy = len(word), word not in clean
    at: dict[str, int] = {}
    for i, c in enumerate(word):
        at[c] = at.get(c, 0) | 1 << i
    best: tuple[int, str] | None = None
    stack = [(trie, 1, 0)]
    while stack:
        node, none, one = stack.pop()
        if node.term:
            if node.stem:
                distance = 0 if none else 1
            else:
                distance = 0 if none >> n & 1 else 1 if (one >> n | none << 1 >> n) & 1 else 2
            if distance <= (allowed_edits(node.term) if fuzzy else 0) and (best is None or (distance, node.term) < best):
                best = distance, node.term
        for c, child in node.next.items():
            here = at.get(c, 0)
            read = (none & here) << 1
            if fuzzy:  # one edit more: a letter is missing in the word, is another one, or is one too many
                edited = (one & here) << 1 | none | (none << 1) & ((2 << n) - 1) | (none << 1 & here) << 1
                if read or edited:
                    stack.append((child, read, edited))
            elif read:
                stack.append((child, read, 0))
    return (best[1], best[0]) if best else None


class Finder:
    """The nearest term of a word: a cheap necessary test, then the automaton.

    With one edit, one half of the term is intact: the word starts with the first
    half, or has the second within one place of where it belongs.
    """

    def __init__(self, terms: dict[str, bool], clean: frozenset[str]):
        self.trie, self.clean = Trie.of(terms), clean
        heads, tails, inner = {}, {}, set()
        for term, stem in terms.items():
            half = len(term) // 2
            heads.setdefault(half, set()).add(term[:half])
            if stem:
                inner.update((at, at + len(term) - half, term[half:]) for at in (half - 1, half, half + 1))
            else:
                tails.setdefault(len(term) - half, set()).add(term[half:])
        self.heads, self.tails = sorted(heads.items()), sorted(tails.items())
        places: dict[tuple[int, int], set[str]] = {}
        for at, to, piece in inner:
            places.setdefault((at, to), set()).add(piece)
        self.places = sorted((at, to, pieces) for (at, to), pieces in places.items())

    def find(self, word: str) -> tuple[str, int] | None:
        for n, pieces in self.heads:
            if word[:n] in pieces:
                return matches(self.trie, word, self.clean)
        for n, pieces in self.tails:
            if word[-n:] in pieces:
                return matches(self.trie, word, self.clean)
        for at, to, pieces in self.places:
            if word[at:to] in pieces:
                return matches(self.trie, word, self.clean)
        return None


class Scanner:
    """The features of texts; what was found for a word is remembered in bounded space, which goes with the scanner."""

    def __init__(self, terms: dict[str, bool], clean: frozenset[str]):
        find = Finder(terms, clean).find
        self.memo = Memo(lambda word: find(word) or False, _MEMO)  # False: looked up, none found

    def features(self, text: str, window: int = 6) -> list[float]:
        """The features of a whole text; hits are judged by the ``window`` words on either side."""
        folded = text.lower()
        words = _WORD.findall(folded)
        look = self.memo
        hits = [i for i, word in enumerate(words) if look[word]]
        look.trim()
        if not hits:
            return [0.0] * len(FEATURES)
        spans = [m.span() for m in _WORD.finditer(folded)]
        exact = misspelled = quoted = addressed = 0
        kinds = set()
        for i in hits:
            term, distance = look[words[i]]
            kinds.add(term)
            around = words[max(i - window, 0) : i] + words[i + 1 : i + 1 + window]
            left = folded[spans[max(i - window, 0)][0] : spans[i][0]]
            right = folded[spans[i][1] : spans[min(i + window, len(spans) - 1)][1] + 1]
            enclosed = any(q in left for q in _QUOTES) and any(q in right for q in _QUOTES)
            if enclosed or any(w in REPORTING for w in around[: min(i, window)]):
                quoted += 1
            elif distance:
                misspelled += 1
            else:
                exact += 1
            addressed += any(w in ADDRESSING for w in around)
        return [min(exact, 3), min(misspelled, 3), min(quoted, 3), min(addressed, 3), math.log(len(hits)), len(hits) / math.sqrt(len(words))]


@dataclass
class Model:
    terms: dict[str, bool]
    clean: frozenset[str]
    weights: np.ndarray
    bias: float
    centre: np.ndarray
    scale: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        z = ((features - self.centre) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fold(id_col: str, parts: int) -> Column:
    """Remainder of the crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def _lexicon(rows: DataFrame, n_toxic: int, n_clean: int, least_share: float) -> tuple[dict[str, bool], list[str]]:
    """Words and word beginnings that go with the label, from document counts made in Spark.

    A candidate's evidence is its count times the divergence of its label share from
    the overall share; it must exceed what the best of all candidates would reach by
    chance.  Candidates with the same beginning are covered by the shortest stem.
    """

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = [sorted(set(_WORD.findall(t.lower()))) for t in batch.column(1).to_pylist()]
            take = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([pa.array([w for f in found for w in f], pa.string()), batch.column(0).take(take)], ["word", "toxic"])

    words = rows.select("_toxic", "_text").mapInArrow(distinct, "word string, toxic int")
    counts = cut(words.groupBy("word").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")))
    stems = F.array(*[F.when(F.length("word") > n, F.substring("word", 1, n)) for n in _STEM_LENGTHS])
    by_stem = counts.select(F.explode(stems).alias("word"), "pos", "neg").filter(F.col("word").isNotNull()).groupBy("word")
    both = counts.select("word", F.lit(False).alias("stem"), "pos", "neg", F.lit(1).alias("forms")).union(
        by_stem.agg(F.sum("pos"), F.sum("neg"), F.count("*")).selectExpr("word", "true", "`sum(pos)`", "`sum(neg)`", "int(`count(1)`)")
    )
    share = n_toxic / (n_toxic + n_clean)
    total = F.col("pos") + F.col("neg")
    part = lambda x, p: F.when(x > 0, x * F.log(x / (total * F.lit(p)))).otherwise(0.0)
    likely = both.withColumn("gain", part(F.col("pos"), share) + part(F.col("neg"), 1 - share))
    strong = likely.filter((F.col("pos") >= least_share * total) & (F.length("word") >= 3) & (F.col("gain") >= math.log(1e6) + 2) & (~F.col("stem") | (F.col("forms") >= 3)))
    found = strong.orderBy(F.desc("gain"), "word", "stem").collect()  # the sample bounds them
    terms: dict[str, bool] = {}
    whole = {r["word"]: r["gain"] for r in found if not r["stem"]}
    for r in sorted((r for r in found if r["stem"]), key=lambda r: (len(r["word"]), r["word"])):
        inside = max((g for w, g in whole.items() if w.startswith(r["word"])), default=0.0)
        if r["gain"] > 1.3 * inside and not any(r["word"].startswith(t) for t in terms):
            terms[r["word"]] = True
    for word in whole:
        if not any(word.startswith(t) for t in terms):
            terms[word] = False
    if not terms:
        return terms, []
    near = sorted({piece for t in terms for piece in (t[: len(t) // 2], t[len(t) // 2 :])})  # a word one edit away holds one of them
    clean = counts.filter(F.col("pos") < least_share * (F.col("pos") + F.col("neg"))).filter(F.col("word").rlike("|".join(map(re.escape, near))))
    return terms, [r["word"] for r in clean.orderBy("word").collect()]  # words of the sample, which bounds them


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps."""
    design = np.c_[x, np.ones(len(x))]
    w = np.zeros(design.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + penalty
        step = np.linalg.solve(hessian, design.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", parts: int = 5, held_out: int = 0,
    sample_rows: int = 20_000, least_share: float = 0.9,
) -> Model | None:
    """Lexicon and weights from at most ``sample_rows`` labelled rows outside the held-out fold, chosen by hash.

    The lexicon has all words and stems of the sample with enough evidence, of which
    toxic rows have at least ``least_share``; the sample bounds them.  Words of the
    sample that are mostly clean match exactly only.

    Only the text is an input of the score.  Rows with a null id, text or label are
    left out; an id with several labels counts as toxic if one says so.  None if
    the sample has not both labels.
    """
    small_batches(docs.sparkSession)
    given = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).filter(fold(id_col, parts) != held_out)
    one = given.groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("_toxic"))
    chosen = one.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    rows = cut(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull()).join(F.broadcast(chosen), "_id"))
    sizes = {r["_toxic"]: r["count"] for r in rows.groupBy("_toxic").count().collect()}
    if len(sizes) < 2:
        return None
    terms, clean = _lexicon(rows, sizes[1], sizes[0], least_share)
    known = frozenset(clean)
    scanner = None

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal scanner
        scanner = scanner or Scanner(terms, known)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scanner.features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], ["toxic", "features"])

    measured = rows.select("_toxic", "_text").mapInArrow(measure, "toxic int, features array<double>")
    grouped = measured.groupBy("toxic", "features").count().collect()  # few different ones; the sample bounds them
    x = np.array([r["features"] for r in grouped for _ in range(r["count"])])
    y = np.array([r["toxic"] for r in grouped for _ in range(r["count"])], float)
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    order = np.lexsort((*x.T, y))
    weights, bias = fit_logistic(((x - centre) / scale)[order], y[order])
    return Model(terms, known, weights, bias, centre, scale)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score``, ``predicted``, ``features`` for every row.

    A null text is the empty text.  Without a model the score is 0.  Repeated rows
    give repeated results; other columns are ignored.  Work is per row, without a
    shuffle; the broadcast model is bounded by the lexicon's limits.
    """
    if model is None:
        return docs.select(F.col(id_col), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.array().cast("array<double>").alias("features"))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = ("toxicity", uuid.uuid4().hex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scanner = held(name, lambda: Scanner(model.terms, model.clean))  # for all of a worker's tasks
        for batch in batches:
            features = [scanner.features(t or "") for t in batch.column(1).to_pylist()]
            scores = model.score(np.array(features).reshape(len(features), len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(features, pa.list_(pa.float64()))], ["_id", "score", "predicted", "features"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, score double, predicted int, features array<double>").withColumnRenamed("_id", id_col)
