"""Text expressions: keywords, entities, tokens, scores, intents, sentences, chunks' metadata."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no search meaning.
STOP_WORDS = (
    "how does what is the a an in of to for and or are with from by on at this that it its be can do which when where why has have "
    "will would should could about into describe explain tell me show list give provide all each every any"
).split()
# Suffixes the stemmer removes, first match wins.
SUFFIXES = ("ations", "ation", "ional", "ment", "ness", "ting", "ing", "ions", "ion", "ous", "ive", "ies", "es", "ed", "ly", "al", "er", "s")
# Phrases that ask for a complete list.
LIST_PATTERNS = (
    "list all", "list the", "list every", "what are the", "what are all", "how many", "count of", "count the", "total number", "which functions", "which test",
    "which config", "which requirement", "which dependenc", "for each one", "for each function", "for each param", "for each test", "for each requirement",
    "all the ", "every ", "enumerate", "show all", "find all", "get all", "give me all", "return all", "complete list", "full list", "exhaustive",
    "all .* functions", "all .* parameters", "all .* test", "all .* requirement", "all .* dependenc", "all .* decision",
)
# Names with underscores, camel case of two humps, requirement ids.
ENTITY_PATTERNS = (r"\b([A-Z][a-zA-Z0-9]*(?:_[A-Za-z0-9]+)+)\b", r"\b([A-Z][a-z]+(?:[A-Z][a-z]*)+)\b", r"\b((?:[A-Z0-9]+-)?PRQ-[0-9]+)\b")
# What makes a question complex, by points.
REGISTER_WORDS = ("register", "sfr", "bit field", "bit mask", "offset", "base address")
SAFETY_WORDS = ("asil", "safety", "iso 26262", "functional safety", "fmea")
COMPARE_WORDS = ("compare", "difference", "versus", "vs", "trade-off", "pros and cons")
MODULES = "ADC CAN SPI UART ETH FLS GPT ICU MCU PWM WDG DIO I2C DMA EEP LIN FR CRC CXPI SENT".split()
# Named things in a question, and what asks for structure or for meaning.
NAMED_PATTERNS = (
    r"\b[A-Z][a-z]+_(?:Init|DeInit|Read|Write|GetStatus)\b", r"\b(?:ADC|CAN|SPI|UART|ETH|FLS|GPT|ICU|MCU|PWM|WDG|DIO)_\w+\b", r"\b[A-Z]{2,}_REQ_\d+\b", r"\bSWUD_\w+\b",
)
STRUCTURE_PATTERNS = (
    r"\bwhat\s+calls\b", r"\bcalled\s+by\b", r"\bdepend(?:s|encies|ency)\b", r"\btraceability\b", r"\brequirement.*(?:implement|trace|link|map)", r"\bimplement(?:s|ed|ation)\b.*requirement",
    r"\binit(?:ialization)?\s+(?:order|sequence|chain)\b", r"\bstruct(?:ure)?\s+(?:of|fields|members)\b", r"\brelationship(?:s)?\b", r"\bneighbor(?:s)?\b", r"\bparent(?:s)?\b", r"\bchild(?:ren)?\b",
    r"\bcoverage\s+gap", r"\bmissing\s+(?:test|requirement|link)", r"\bhow\s+many\b", r"\blist\s+all\b", r"\benumerate\b", r"\bcount\b.*\b(?:function|api|test|requirement)s?\b",
)
MEANING_PATTERNS = (
    r"\bhow\s+(?:to|do|does|can)\b", r"\bexplain\b", r"\bdescribe\b", r"\bwhat\s+is\b", r"\bwhy\b", r"\bbest\s+practice", r"\bexample\b", r"\btutorial\b", r"\bguide\b",
    r"\bconfigure\s+(?:the|a)?\s*(?:baud|clock|timer|interrupt)",
)
# Abbreviations whose dot ends no sentence, and what makes a sentence worth keeping.
ABBREVIATIONS = "e.g|i.e|etc|vs|Dr|Mr|Mrs|Ms|Sr|Jr".replace(".", r"\.")
SENTENCE_BONUS = ((r"(?i)\b(?:function|register|struct|enum|typedef|macro)\b", 0.5), (r"\b(?:ASIL|ISO|MISRA|AUTOSAR)\b", 0.3), (r"[{};()]|^\s*#", 0.7))
# Token budgets by complexity, and the slots' shares of the medium one.
BUDGETS = {"simple": 4000, "medium": 8000, "complex": 12000}
SLOTS = {"requirements": 3000, "api_functions": 5000, "tests": 3000, "dependencies": 2500, "relationships": 1500, "code_examples": 4000, "safety": 1200, "registers": 3000, "conversation": 300, "custom": 1000}
_EDGE = "[?.,!:;\"']+"


def words(text: Column, least: int = 3) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: F.length(w) >= least)


def _identifier(w: Column) -> Column:
    return w.contains("_") | F.substring(w, 2, 1_000_000).rlike("[A-Z]") | w.rlike("[0-9]") | (F.length(w) > 12)


def keywords(text: Column, most: int = 7) -> Column:
    """Identifiers of the text, then its other words, once each whatever their case, then a phrase of the first three others; ``most`` of all that."""
    bare = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, f"^{_EDGE}|{_EDGE}$", ""))
    generic = F.filter(bare, lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS) & ~_identifier(w))
    named = F.filter(F.regexp_extract_all(text, F.lit("([A-Za-z][A-Za-z0-9_]{5,})"), F.lit(1)), lambda w: ~F.lower(w).isin(STOP_WORDS) & _identifier(w))
    phrase = F.when(F.size(generic) > 1, F.array(F.array_join(F.slice(generic, 1, 3), " "))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.concat(distinct_by_case(F.concat(named, generic), most), phrase), 1, most)


def distinct_by_case(items: Column, most: int) -> Column:
    """The first ``most`` distinct items whatever their case, each as it first appears."""
    low = F.transform(items, F.lower)
    return F.transform(F.slice(F.array_distinct(low), 1, most), lambda k: F.element_at(items, F.array_position(low, k).cast("int")))


def entities(text: Column) -> Column:
    """Names by pattern: those with underscores, then camel case of five letters or more, then requirement ids."""
    by = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in ENTITY_PATTERNS]
    return F.concat(by[0], F.filter(by[1], lambda x: F.length(x) >= 5), by[2])


def prefixed(names: Column, module: str) -> Column:
    """The names, and those with the module's name in front that are not among them."""
    added = F.transform(names, lambda x: F.concat(F.lit(module.capitalize() + "_"), x))
    return F.concat(names, F.filter(added, lambda x: ~F.array_contains(F.transform(names, F.lower), F.lower(x))))


def is_list_question(text: Column) -> Column:
    return F.lower(text).rlike("|".join(LIST_PATTERNS))


def identifier_parts(name: Column) -> Column:
    """Distinct parts of an identifier at underscores, spaces and camel humps, two letters or more, in lower case."""
    spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "_", " "), "([a-z])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(spaced), r"\s+"), lambda w: F.length(w) >= 2))


def stem(word: Column) -> Column:
    """Remove the first matching suffix if more than three letters stay."""
    w = F.lower(word)
    whens = [(w.endswith(s) & (F.length(w) > len(s) + 3), F.substring(w, F.lit(1), F.length(w) - len(s))) for s in SUFFIXES]
    return reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest), reversed(whens), w)


def stems(text: Column) -> Column:
    """Distinct stems of the text's runs of three letters or more."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{3,})"), F.lit(1)), stem))


def match_score(keyword: Column, name: Column, description: Column) -> Column:
    """2.0 equal, 1.0 in the name, 0.6 in the description, else 0.3 + 0.05 for each word shared with the name, or 0.2."""
    k, n, d = F.lower(keyword), F.lower(name), F.lower(description)
    shared = F.size(F.array_intersect(F.filter(F.split(k, r"\s+"), lambda w: w != ""), F.split(n, r"\s+")))
    return F.when(k == n, 2.0).when(n.contains(k), 1.0).when(d.contains(k), 0.6).when(shared > 0, F.round(0.3 + 0.05 * shared, 6)).otherwise(0.2)


def hits(text: Column, patterns: tuple[str, ...], flags: str = "(?i)") -> Column:
    """How many of the patterns occur."""
    return reduce(lambda a, b: a + b, [text.rlike(flags + p).cast("int") for p in patterns])


def named_things(text: Column, more: tuple[str, ...] = ()) -> Column:
    """Distinct names of functions, requirements and design items in a question, by pattern; ``more`` adds a vendor's own."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)) for p in (*more, *NAMED_PATTERNS))))


def complexity(text: Column) -> Column:
    """Points for length, names, modules, registers, safety, several questions and comparisons; 4 is complex, 2 medium."""
    low, n = F.lower(text), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    among = lambda phrases: reduce(lambda a, b: a | b, [low.contains(p) for p in phrases]).cast("int")
    names = F.size(named_things(text))
    modules = hits(F.upper(text), tuple(rf"\b{m}\b" for m in MODULES), "")
    questions = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    return (
        F.when(n > 20, 2).when(n > 10, 1).otherwise(0) + F.when(names >= 3, 2).when(names >= 1, 1).otherwise(0) + F.when(modules >= 2, 2).otherwise(0)
        + among(REGISTER_WORDS) + among(SAFETY_WORDS) + ((questions > 1) | low.contains(" and ")).cast("int") + 2 * among(COMPARE_WORDS)
    )


def complexity_class(score: Column) -> Column:
    return F.when(score >= 4, "complex").when(score >= 2, "medium").otherwise("simple")


def strategy(text: Column) -> Column:
    """Ordered rules to a retrieval strategy and its graph share."""
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    names, structure, meaning = F.size(named_things(text)), hits(text, STRUCTURE_PATTERNS), hits(text, MEANING_PATTERNS)
    rule = lambda name, alpha: F.struct(F.lit(name).alias("strategy"), F.lit(alpha).alias("alpha"))
    return (
        F.when((names >= 1) & (n <= 5), rule("exact", 1.0)).when(structure >= 2, rule("graph_heavy", 0.85)).when((meaning >= 2) & (names == 0), rule("vector_heavy", 0.3))
        .when((structure >= 1) & (names >= 1), rule("graph_heavy", 0.75)).when(meaning >= 1, rule("vector_heavy", 0.4)).otherwise(rule("hybrid", 0.6))
    )


def token_budget(kind: Column, custom: Column | None = None) -> Column:
    """Total budget of a complexity class (or a custom one), and each slot's share of it, rounded down."""
    total = reduce(lambda rest, x: F.when(kind == x[0], x[1]).otherwise(rest), BUDGETS.items(), F.lit(BUDGETS["medium"]))
    total = total if custom is None else F.coalesce(custom, total)
    return F.struct(total.alias("total"), *(F.floor(size * total / BUDGETS["medium"]).cast("long").alias(slot) for slot, size in SLOTS.items()))


def expanded(text: Column, synonyms: dict[str, list[str]], most: int = 5) -> Column:
    """Terms to add to a question: the shortest alias of each term in it, or the term whose alias (over three letters) is in it."""
    low = F.lower(text)
    found = []
    for term, aliases in synonyms.items():
        short = min(aliases, key=len)
        other = reduce(lambda a, b: a | b, [low.contains(a.lower()) for a in aliases if len(a) > 3], F.lit(False))
        whole = low.rlike(rf"\b{re.escape(term)}\b")
        found.append(F.when(whole & ~low.contains(short.lower()), short).when(~whole & other & ~low.contains(term), term))
    return F.slice(F.array_compact(F.array(*found)), 1, most)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least 1; 0 for an empty or null text."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def sentences(text: Column) -> Column:
    """Sentences end at ``.``, ``!`` or ``?`` before white space; the dots of abbreviations don't end one."""
    held = F.regexp_replace(text, rf"\b({ABBREVIATIONS})\.", "$1\u0001")
    parts = F.split(F.regexp_replace(held, r"([.!?])\s+", "$1\u0002"), "\u0002")
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")


def sentence_score(sentence: Column, terms: tuple[str, ...] = ()) -> Column:
    """A point for each query term, a bonus for a fair length and for technical content, a malus for very short ones."""
    n = F.size(F.filter(F.split(sentence, r"\s+"), lambda w: w != ""))
    low = F.lower(sentence)
    score = F.when(n.between(10, 40), 0.5).when(n < 5, -0.3).otherwise(0.0)
    for term in terms:
        score = score + F.when(low.contains(term), 1.0).otherwise(0.0)
    for pattern, bonus in SENTENCE_BONUS:
        score = score + F.when(sentence.rlike(pattern), bonus).otherwise(0.0)
    return F.round(score, 6)


def mask_secrets(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?i)(password|token|secret|api_key)\s*[=:]\s*\S+", "$1=***"), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>")


def strip_html(page: Column) -> Column:
    """Text without tags, scripts and styles; five named references decoded; white space collapsed."""
    bare = F.regexp_replace(page, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r]+", " "))


def chunk_id(path: Column, text: Column) -> Column:
    """A readable id with the first ten digits of the text's hash."""
    return F.concat(F.regexp_replace(F.lower(path), "[^a-z0-9]+", "_"), F.lit("_"), F.substring(F.md5(text), 1, 10))
