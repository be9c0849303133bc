"""Queries over texts: questions, chunks, pages, JSON and conversations."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.chunking import overlap_chunks, sections
from ..operators.text_index import TextIndex
from ..checkpoints import shared_folder
from ..registry import register
from ..sources.snapshots import fingerprint
from ..tables import table

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda w: length(w) >= 3)"

#: Questions made from the parts' names and numbers, with named things, modules and phrases of each kind; the same text for Spark and the oracles.
QUESTIONS = """select p_partkey as id, case p_partkey % 9
    when 0 then 'What calls Mod_' || cast(p_partkey as string) || '_Init and which register offset does it depend on? Is it ASIL relevant?'
    when 1 then 'Explain how to configure the clock for the ' || p_name || ' unit, with an example'
    when 2 then 'List all requirements and functions of the ADC and SPI modules that implement PRQ-' || cast(p_partkey as string) || ' or compare ADC_Read with Spi_Init'
    when 3 then 'Adc_Init ' || p_name
    when 4 then 'describe the ' || p_name || ' relationships, parents and children of Adc_DeInit versus Can_Write in the safety concept, and explain why the interrupt handler polls the status register at all?'
    when 5 then 'How many ' || p_name || ' orders are there per customer and supplier?'
    when 6 then 'SteelWidgetConfig' || cast(p_partkey as string) || ' initialization order for ' || p_type || ' parts'
    when 7 then p_name
    else 'Which functional tests ship the ordered parts: "' || p_name || '", to all nations and regions?' end as text from {part}"""
_Q = "with q as (" + QUESTIONS.format(part="part") + ") "


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, text``"""
    return spark.sql(QUESTIONS, part=table(spark, sf_dir, "part"))


_IDENT = "(contains(w, '_') or regexp_matches(substr(w, 2), '[A-Z]') or regexp_matches(w, '[0-9]') or length(w) > 12)"
_STRIP = "^[?.,!:;\"'']+|[?.,!:;\"'']+$"


@register(
    "keyword_extract",
    _Q + rf"""select id, array_to_string(list_concat(list_filter(b, lambda x, i: list_position(list_transform(b, lambda y: lower(y)), lower(x)) = i), case when len(g) > 1 then [array_to_string(g[1:3], ' ')] else [] end)[1:7], '; ') as keywords
    from (select id, g, list_concat(n, g) as b from (select id,
    list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda w: regexp_replace(w, '{_STRIP}', '', 'g')), lambda w: length(w) >= 3 and w not in ({_STOP}) and not {_IDENT}) as g,
    list_filter(regexp_extract_all(text, '([A-Za-z][A-Za-z0-9_]{{5,}})', 1), lambda w: lower(w) not in ({_STOP}) and {_IDENT}) as n from q))""",
)
def keyword_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("id", F.array_join(T.keywords(F.col("text")), "; ").alias("keywords"))


@register(
    "entity_extract",
    _Q + f"""select id, len(d) as n_entities, array_to_string(d[1:5], ' ') as first_entities from (select id, list_filter(e, lambda x, i: list_position(list_transform(e, lambda y: lower(y)), lower(x)) = i) as d
    from (select id, list_concat(list_concat(regexp_extract_all(text, '{T.ENTITY_PATTERNS[0]}', 1), list_filter(regexp_extract_all(text, '{T.ENTITY_PATTERNS[1]}', 1), lambda x: length(x) >= 5)), regexp_extract_all(text, '{T.ENTITY_PATTERNS[2]}', 1)) as e from q))""",
)
def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = questions(spark, sf_dir).select("id", T.entities(F.col("text")).alias("_e"))
    n = F.size(F.array_distinct(F.transform("_e", F.lower))).cast("long")
    return found.select("id", n.alias("n_entities"), F.array_join(T.distinct_by_case(F.col("_e"), 5), " ").alias("first_entities"))


@register("aggregation_intent", _Q + f"select id, regexp_matches(lower(text), '{'|'.join(T.LIST_PATTERNS)}') as wants_list from q")
def aggregation_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("id", T.is_list_question(F.col("text")).alias("wants_list"))


@register(
    "identifier_tokens",
    r"""select p_partkey, array_to_string(list_filter(t, lambda w, i: list_position(t, w) = i), ' ') as tokens from (select p_partkey, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(replace(n, '_', ' '), '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), '\s+'), lambda w: length(w) >= 2) as t
    from (select p_partkey, p_name || '_' || p_type || 'Item_ADCChannel' || p_brand as n from part))""",
)
def identifier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit("_"), "p_type", F.lit("Item_ADCChannel"), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.identifier_parts(name), " ").alias("tokens"))


def _stem_sql(w: str) -> str:
    return "case " + " ".join(f"when ends_with({w}, '{s}') and length({w}) > {len(s) + 3} then substr({w}, 1, length({w}) - {len(s)})" for s in T.SUFFIXES) + f" else {w} end"


def _stems_sql(text: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all(lower({text}), '[a-z]{{3,}}'), lambda w: {_stem_sql('w')}))"


@register("stemmed_words", f"with w as (select unnest({_WORDS}) as w from benchmark) select {_stem_sql('w')} as stem, count(*) as n from w group by 1")
def stemmed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "benchmark").select(F.explode(T.words(F.col("text"))).alias("w"))
    return each.groupBy(T.stem(F.col("w")).alias("stem")).agg(F.count("*").alias("n"))


_TOKEN_SEARCH = f"""with q as (select item_id, unnest(list_distinct({_WORDS})) as w from benchmark where item_id % 50 = 0), n as (select item_id, count(*) as k from q group by 1),
    d as (select doc_id, unnest(list_distinct({_WORDS})) as w from documents), h as (select item_id, doc_id, count(*) as hits from q join d using (w) group by 1, 2)
    select item_id, doc_id, round(hits / k, 6) as score from h join n using (item_id) qualify row_number() over (partition by item_id order by hits / k desc, doc_id) <= 10"""


def documents_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The index of the documents' words, labelled by source, in the shared folder; built when the table's files are new or changed, kept for later searches."""
    path = f"{sf_dir}/documents.parquet"
    index = TextIndex(spark, f"{shared_folder(spark)}/text-index-{fingerprint(spark, path)}")
    if not index.exists():
        docs = table(spark, sf_dir, "documents")
        index.build(docs.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("label")), T.words(F.col("text")))
    return index


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").filter(F.col("item_id") % 50 == 0).select(F.col("item_id").alias("query"), T.words(F.col("text")).alias("words"))


@register("token_index_search", _TOKEN_SEARCH)
def token_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the query's words found in each document, ten best for every item whose id is divisible by 50, from the kept index."""
    found = documents_index(spark, sf_dir).search(_asked(spark, sf_dir), k=10, share=True)
    return found.select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), "score")


#: Sources whose hits count less in the ranked search.
LOW_SOURCES = {"src8": 0.3, "src9": 0.3}


@register(
    "fulltext_index_search",
    f"""with q as (select item_id, unnest(list_distinct({_WORDS})) as w from benchmark where item_id % 50 = 0), d as (select doc_id, source, unnest({_WORDS}) as w from documents),
    f as (select w, doc_id, any_value(source) as source, floor(1000 * (1 + ln(count(*))))::bigint as impact from d group by 1, 2), n as (select w, floor(1000 * ln(1 + (select count(*) from documents)::double / count(*)))::bigint as weight from f group by 1)
    select item_id, doc_id, sum(impact * weight) * (case when any_value(source) in ('src8', 'src9') then 0.3 else 1.0 end)::double / 1000000 as score from q join f using (w) join n using (w) group by 1, 2 qualify row_number() over (partition by item_id order by score desc, doc_id) <= 20""",
)
def fulltext_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by term frequency and rarity of the query's words, those of low-value sources at 0.3 of their score; twenty best for every item whose id is divisible by 50."""
    found = documents_index(spark, sf_dir).search(_asked(spark, sf_dir), k=20, factors=LOW_SOURCES)
    return found.select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), "score")


@register(
    "score_node",
    """select p_partkey, case when n = k then 2.0 when contains(n, k) then 1.0 when contains(d, k) then 0.6 when o > 0 then round(0.3 + 0.05 * o, 6) else 0.2 end::double as score
    from (select p_partkey, lower(p_name) as n, lower(p_type) as d, k, len(list_intersect(string_split(k, ' '), string_split(lower(p_name), ' '))) as o
    from (select *, case p_partkey % 4 when 0 then 'cold widget' when 1 then 'widget' when 2 then 'small' else 'old small gizmo' end as k from part))""",
)
def score_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % 4
    asked = F.when(kind == 0, "cold widget").when(kind == 1, "widget").when(kind == 2, "small").otherwise("old small gizmo")
    return table(spark, sf_dir, "part").select("p_partkey", T.match_score(asked, F.col("p_name"), F.col("p_type")).alias("score"))


#: What each label is about; the first three are defaults.
LABELS = {
    "Requirement": "what the product must implement, by customer", "Function": "callable operations that are implemented in modules", "Module": "a unit with functions and its configuration",
    "TestCase": "functional tests, which verify requirements", "Register": "hardware register with offset and fields", "Order": "ordered parts, per customer and supplier",
    "Part": "shipped things by brand, size and type", "Supplier": "ships parts to nations", "Nation": "nations and their regions", "ConfigParam": "configured parameter values such as clocks",
}
_LABEL_ROWS = ", ".join(f"({k}, '{label}', '{about}')" for k, (label, about) in enumerate(LABELS.items()))


@register(
    "infer_labels",
    _Q + f""", l as (select k, label, (select list_distinct(list_transform(list_filter(regexp_split_to_array(lower(regexp_replace(label, '([a-z])([A-Z])', '\\1 \\2', 'g')), ' '), lambda w: length(w) >= 2), lambda w: {_stem_sql('w')}))) as names, {_stems_sql('about')} as about from (values {_LABEL_ROWS}) v(k, label, about)),
    s as (select id, k, label, case when contains(lower(text), lower(label)) then 5 else 0 end + 2 * len(list_intersect({_stems_sql('text')}, names)) + 0.5 * len(list_intersect({_stems_sql('text')}, about)) as score from q, l),
    r as (select *, row_number() over (partition by id order by score desc, label) as place from s), t as (select id, label, 0 as late, place, k from r where score > 0 and place <= 7 union all select id, label, 1, 0, k from r where k < 3 and not (score > 0 and place <= 7))
    select id, array_to_string((list(label order by late, place, k))[1:10], ' ') as labels from t group by 1""",
)
def infer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven best labels of each question, then those of the first three that are not among them; the catalogue is one row."""
    catalogue = spark.sql(f"select * from values {_LABEL_ROWS} as t(k, label, about)")
    known = catalogue.select(F.struct("k", "label", F.array_distinct(F.transform(T.identifier_parts(F.col("label")), T.stem)).alias("names"), T.stems(F.col("about")).alias("about")).alias("l"))
    rows = questions(spark, sf_dir).crossJoin(F.broadcast(known.agg(F.array_sort(F.collect_list("l")).alias("_l")))).withColumn("_q", T.stems(F.col("text")))
    score = lambda x: F.when(F.contains(F.lower("text"), F.lower(x["label"])), 5.0).otherwise(0.0) + 2.0 * F.size(F.array_intersect("_q", x["names"])) + 0.5 * F.size(F.array_intersect("_q", x["about"]))
    scored = F.filter(F.transform("_l", lambda x: F.struct((-score(x)).alias("minus"), x["label"].alias("label"))), lambda x: x["minus"] < 0)
    best = F.transform(F.slice(F.array_sort(scored), 1, 7), lambda x: x["label"])
    defaults = F.transform(F.slice("_l", 1, 3), lambda x: x["label"])
    return rows.select("id", F.array_join(F.slice(F.concat(best, F.array_except(defaults, best)), 1, 10), " ").alias("labels"))


def _any_sql(column: str, phrases: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({column}, '{p}')" for p in phrases) + ")::int"


def _hits_sql(column: str, patterns: tuple[str, ...], flags: str = "(?i)") -> str:
    return "(" + " + ".join(f"regexp_matches({column}, '{flags}{p}')::int" for p in patterns) + ")"


_COUNTED = f"""c as (select id, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as n, len(list_distinct(list_concat({', '.join(f"regexp_extract_all(text, '{p}')" for p in T.NAMED_PATTERNS)}))) as names,
    {_hits_sql('upper(text)', tuple(rf"\b{m}\b" for m in T.MODULES), '')} as modules, {_hits_sql('text', T.STRUCTURE_PATTERNS)} as structure, {_hits_sql('text', T.MEANING_PATTERNS)} as meaning from q),
    p as (select *, case when n > 20 then 2 when n > 10 then 1 else 0 end + case when names >= 3 then 2 when names >= 1 then 1 else 0 end + case when modules >= 2 then 2 else 0 end + {_any_sql('lower(text)', T.REGISTER_WORDS)}
    + {_any_sql('lower(text)', T.SAFETY_WORDS)} + (length(text) - length(replace(text, '?', '')) > 1 or contains(lower(text), ' and '))::int + 2 * {_any_sql('lower(text)', T.COMPARE_WORDS)} as points from c)"""
_CLASS = "case when points >= 4 then 'complex' when points >= 2 then 'medium' else 'simple' end"
_STRATEGY = """case when names >= 1 and n <= 5 then ('exact', 1.0) when structure >= 2 then ('graph_heavy', 0.85) when meaning >= 2 and names = 0 then ('vector_heavy', 0.3)
    when structure >= 1 and names >= 1 then ('graph_heavy', 0.75) when meaning >= 1 then ('vector_heavy', 0.4) else ('hybrid', 0.6) end"""


@register("query_complexity", _Q + f", {_COUNTED} select id, points, {_CLASS} as complexity from p")
def query_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = T.complexity(F.col("text"))
    return questions(spark, sf_dir).select("id", points.alias("points"), T.complexity_class(points).alias("complexity"))


@register("query_strategy", _Q + f", {_COUNTED} select id, s[1] as strategy, s[2]::double as alpha from (select id, {_STRATEGY} as s from p)")
def query_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("id", T.strategy(F.col("text")).alias("_s")).select("id", "_s.strategy", "_s.alpha")


#: A sample of a domain's terms and their aliases; callers bring their own.
SYNONYMS = {"adc": ["analog to digital converter", "adc driver"], "spi": ["serial peripheral interface", "spi driver", "qspi"], "init": ["initialization", "startup"], "isr": ["interrupt service routine", "interrupt handler", "irq"], "polling": ["status polling", "poll", "busy wait"], "asil": ["safety level", "safety rating"]}
_TERMS = ", ".join(
    f"case when regexp_matches(lower(text), '\\b{t}\\b') then case when not contains(lower(text), '{min(a, key=len)}') then '{min(a, key=len)}' end"
    f" when {_any_sql('lower(text)', tuple(x for x in a if len(x) > 3))} = 1 and not contains(lower(text), '{t}') then '{t}' end" for t, a in SYNONYMS.items()
)


@register("synonym_expansion", _Q + f"select id, array_to_string((list_filter([{_TERMS}], lambda x: x is not null))[1:5], ', ') as added from q")
def synonym_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("id", F.array_join(T.expanded(F.col("text"), SYNONYMS), ", ").alias("added"))


_BUDGET = "case " + _CLASS + " when 'simple' then 4000 when 'medium' then 8000 else 12000 end"


@register(
    "query_enhancement",
    _Q + f", {_COUNTED} select id, {_CLASS} as complexity, s[1] as strategy, s[2]::double as alpha, names::bigint as n_entities, modules::bigint as n_modules, {_BUDGET} as total_budget, (5000 * {_BUDGET} // 8000)::bigint as api_functions from (select *, {_STRATEGY} as s from p)",
)
def query_enhancement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, modules, complexity, strategy and budgets of every question in one pass."""
    text = F.col("text")
    kind = T.complexity_class(T.complexity(text))
    modules = T.hits(F.upper(text), tuple(rf"\b{m}\b" for m in T.MODULES), "")
    rows = questions(spark, sf_dir).select("id", kind.alias("complexity"), T.strategy(text).alias("_s"), F.size(T.named_things(text)).cast("long").alias("n_entities"), modules.cast("long").alias("n_modules"), T.token_budget(kind).alias("_b"))
    return rows.select("id", "complexity", "_s.strategy", "_s.alpha", "n_entities", "n_modules", F.col("_b.total").alias("total_budget"), "_b.api_functions")


@register("token_estimate", "select doc_id, case when coalesce(length(text), 0) = 0 then 0 else greatest(1, length(text) // 4) end as tokens from documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@register("content_hash", "select doc_id, sha256(text) as hash, doc_id::varchar || '_' || substr(md5(text), 1, 10) as chunk_id from documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), T.chunk_id(F.col("doc_id").cast("string"), F.col("text")).alias("chunk_id"))


@register("duplicate_content", "select md5(text) as hash, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter(F.col("n") > 1)


@register(
    "html_strip",
    r"""with a as (select page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') as t from pages)
    select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) as text from a""",
)
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@register(
    "metadata_extract",
    r"""select doc_id, len(string_split(text, chr(10))) as n_lines, regexp_matches(text, '(?i)license') as has_license, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') as has_email,
    len(regexp_extract_all(text, '[0-9]+')) as n_numbers from documents""",
)
def metadata_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(F.split(text, "\n")).cast("long").alias("n_lines"), text.rlike("(?i)license").alias("has_license"),
        text.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("has_email"), F.regexp_count(text, F.lit("[0-9]+")).cast("long").alias("n_numbers"),
    )


@register(
    "mask_secrets",
    r"""select doc_id, md5(regexp_replace(regexp_replace(text, '(?i)(password|token|secret|api_key)\s*[=:]\s*\S+', '\1=***', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<email>', 'g')) as masked_md5 from documents""",
)
def mask_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.mask_secrets(F.col("text"))).alias("masked_md5"))


_SENTENCES = rf"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\b({T.ABBREVIATIONS})\.', '\1' || chr(1), 'g'), '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)), lambda x: trim(replace(x, chr(1), '.'))), lambda x: x <> '')"""
_SENTENCE_SCORE = "round(case when n between 10 and 40 then 0.5 when n < 5 then -0.3 else 0.0 end + case when contains(lower(sentence), 'the') then 1.0 else 0.0 end" + "".join(f" + case when regexp_matches(sentence, '{p}') then {bonus} else 0.0 end" for p, bonus in T.SENTENCE_BONUS) + ", 6)"


@register(
    "sentence_top",
    rf"""with s as (select doc_id, {_SENTENCES} as l from documents), u as (select doc_id, unnest(l) as sentence, generate_subscripts(l, 1) as place from s),
    c as (select doc_id, place, sentence, len(list_filter(regexp_split_to_array(sentence, '\s+'), lambda w: w <> '')) as n from u)
    select doc_id, place, {_SENTENCE_SCORE}::double as score from c qualify row_number() over (partition by doc_id order by {_SENTENCE_SCORE} desc, place) <= 3""",
)
def sentence_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best sentences of every document by query terms, length and technical content; abbreviations end no sentence.

    A document's sentences are ranked inside its own array, so nothing is shuffled.
    """
    rated = F.transform(T.sentences(F.col("text")), lambda s, i: F.struct((-T.sentence_score(s, ("the",))).alias("minus"), (i + 1).alias("place")))
    best = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.slice(F.array_sort(rated), 1, 3)).alias("_s"))
    return best.select("doc_id", F.col("_s.place").cast("long").alias("place"), (-F.col("_s.minus")).alias("score"))


@register(
    "chunk_overlap",
)
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy paragraph chunks of at most 2000 characters with a tail of 200 carried over."""
    return overlap_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 2000, 200)


@register("chunk_headings")
def chunk_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as numbered sections: each line that ends with a period alone opens one, as a stand-in for headings."""
    return sections(table(spark, sf_dir, "documents"), "doc_id", "text", r"^\S+( \S+)?\.$")


@register("json_props", """select event_type, (props::json->>'$.k')::bigint % 10 as bucket, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = (F.get_json_object("props", "$.k").cast("long") % 10).alias("bucket")
    return table(spark, sf_dir, "events").groupBy("event_type", bucket).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@register(
    "conversation_context_filter",
    "select conv_id, count(*) as n_turns, count(*) filter (role = 'user') as n_user, sum(length(text)) as n_chars, arg_max(role, turn) as last_role from conversations group by 1",
)
def conversation_context_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").groupBy("conv_id")
    return own.agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.sum(F.length("text")).alias("n_chars"), F.max_by("role", "turn").alias("last_role"))


@register("render_turns", "select conv_id, md5(string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) order by turn nulls first, role nulls first, text nulls first)) as rendered_md5 from conversations group by 1")
def render_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as lines; a missing role or text is empty."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_t"))
    return turns.select("conv_id", F.md5(F.array_join(F.transform("_t", lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit(": "), F.coalesce(x["text"], F.lit("")))), "\n")).alias("rendered_md5"))
