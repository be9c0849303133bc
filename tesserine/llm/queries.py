"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, html_extract, language_id, mixing, near_dedup, resampling, sentencepiece_codec, substring_dedup, suffix_dedup, token_counts, toxicity, vector_dedup
from .common import table

PIECE_MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest(sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL)))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.dedup(table(spark, sf_dir, "documents")))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), parts=5, held_out=0))
    return scored.select("doc_id", (toxicity.fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup(table(spark, sf_dir, "documents")))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), parts=3, held_out=1)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.label_weights(table(spark, sf_dir, "labels")))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_decontamination": op2_decontamination,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_near_dedup": op5_near_dedup,
        "op6_token_counts": op6_token_counts,
        "op7_toxicity": op7_toxicity,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_vector_dedup": op9_vector_dedup,
        "op10_language_id": op10_language_id,
        "op11_source_divergence": op11_source_divergence,
        "op12_source_mixing": op12_source_mixing,
        "op13_target_resampling": op13_target_resampling,
        "pipeline": pipeline,
    }


def _decontamination_sql() -> str:
    """The same decision without hashes: seeds as token lists, every aligned token compared, windows by frames."""
    split = decontaminate._SPLIT.replace("'", "''")
    tokens = f"list_filter(regexp_split_to_array(lower(text), '{split}'), lambda x: x <> '')"
    raw = f"regexp_split_to_array(lower(text), '{split}')"
    picks = [[i for i, bit in enumerate(mask) if bit == "1"] for mask in decontaminate.MASKS]
    shortest = min(map(len, decontaminate.MASKS))

    def seeds(rows: str, key: str) -> str:
        each = [f"select {key}, p, {k} as mask, list_transform({own}, lambda i: c[p + 1 + i]) as seed from {rows} where p + {len(decontaminate.MASKS[k])} <= len(c)" for k, own in enumerate(picks)]
        return " union all ".join(each)

    return f"""with d as (select distinct doc_id, {raw} as c from documents where text is not null), i as (select distinct item_id, {tokens} as c from benchmark where text is not null),
    dp as (select doc_id, c, unnest(range(len(c) - {shortest} + 1)) as p from d), ip as (select item_id, c, unnest(range(len(c) - {shortest} + 1)) as p from i),
    ds as ({seeds("dp", "doc_id")}), s as ({seeds("ip", "item_id")}),
    hits as (select distinct doc_id, item_id, ds.p - s.p as f from ds join s on ds.mask = s.mask and ds.seed = s.seed),
    k as (select doc_id, item_id, f, len(i.c) as n, least(len(i.c), {decontaminate.WINDOW}) as w, unnest(range(len(i.c))) as j, i.c as test, d.c as own from hits join d using (doc_id) join i using (item_id)),
    e as (select doc_id, item_id, f, n, w, j, case when f + j >= 0 and own[f + j + 1] = test[j + 1] then 1 else 0 end as same from k),
    r as (select doc_id, item_id, f, w, j, sum(same) over (partition by doc_id, item_id, f order by j rows between {decontaminate.WINDOW - 1} preceding and current row) as equal from e),
    b as (select doc_id, item_id, f, w, max(equal) as equal from r where j + 1 >= w group by all)
    select doc_id, item_id, max(equal)::bigint as n_equal, max(w)::bigint as n_window, count(*) as n_places from b where equal >= ceil(w * {decontaminate.AGREEMENT}) group by 1, 2"""


def _divergence_sql() -> str:
    """Every kept term of every group, absent ones too, without baselines or bits."""
    return """with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
    g as (select distinct lang, source from d), u as (select id, lang, source, unnest(w) as term from d),
    k as (select lang, term from u group by all having count(distinct id) >= 10), v as (select lang, count(*) as v from k group by 1),
    c as (select lang, source, term, count(*) as n from u join k using (lang, term) group by all),
    gt as (select lang, source, sum(n) as total from c group by all), lt as (select lang, sum(n) as total from c group by 1), lc as (select lang, term, sum(n) as n from c group by all),
    p as (select lang, source, term, coalesce(n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n, 0) + 2)) // (coalesce(total, 0) + 2 * v) as p from g join k using (lang) join v using (lang) left join c using (lang, source, term) left join gt using (lang, source)),
    q as (select lang, term, 1 + (1000000000::hugeint * (n + 2)) // (total + 2 * v) as q from lc join lt using (lang) join v using (lang)),
    s as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
    e as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
    union all select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from p join q using (lang, term) where n > 0 and p > q),
    r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from e) select * from r where part = 'pair' or rank <= 10"""


def _mixing_sql() -> str:
    """The level from sources sorted by cap and weight, documents from one sort of each source."""
    return """with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::bigint as size from documents),
    s as (select source, sum(size)::bigint as source_size from d group by 1),
    r as (select source, source_size, 3 * source_size as cap, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as share from s),
    t as (select *, row_number() over o as place, ((sum(source_size) over ()) - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))::double / (sum(share) over (o rows between current row and unbounded following))::double as level from r window o as (order by cap::double / share, source nulls last)),
    l as (select arg_min(level, place) as level from t where cap::double >= level * share),
    m as (select source, source_size, least(cap::double, level * share) as target from r, l),
    q as (select doc_id, 1 + 3 * avg(quality) as weight from labels where quality is not null and doc_id is not null group by 1),
    k as (select d.doc_id, d.source, size, source_size, target, round(target)::bigint as whole, -ln((('0x' || substr(sha256('2024:' || coalesce(d.doc_id::varchar, '')), 1, 12))::bigint + 0.5) / 281474976710656.0::double) / coalesce(weight, 2.0) as key from d join m on d.source is not distinct from m.source left join q on d.doc_id = q.doc_id),
    f as (select *, coalesce(sum(size) over (partition by source order by key, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as ahead, case when source_size > 0 then whole // source_size else 0 end as rounds from k)
    select doc_id, source, size, source_size, target, (rounds * size + greatest(0, least(size, whole - rounds * source_size - ahead)))::bigint as taken from f"""


def _resampling_sql() -> str:
    """Checksums byte by byte from the polynomial, whole texts without chunks, one sort of all documents."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""with tab as (select list(c order by i) as t from (select i, list_reduce(list_concat([i], range(8)), lambda a, x: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end) as c from (select unnest(range(256)) as i))),
    d as (select row_number() over () as id, doc_id, {words} as w from documents), b as (select unnest({words}) as word from benchmark),
    u as (select id, unnest(w) as word from d), h as (select word, hex(encode(word)) as h from (select word from u union select word from b)),
    x as (select word, xor(list_reduce(list_concat([4294967295], list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) % 10000 as bucket from h, tab),
    s as (select bucket, count(*) as s from u join x using (word) group by 1), t as (select bucket, count(*) as t from b join x using (word) group by 1),
    n as (select (select count(*) from u) as s, (select count(*) from b) as t),
    g as (select z.bucket, floor(1000 * ln((coalesce(t.t, 0) + 1)::double * (n.s + 10000)::double / ((coalesce(s.s, 0) + 1)::double * (n.t + 10000)::double)))::bigint as gain from (select unnest(range(10000)) as bucket) z left join s using (bucket) left join t using (bucket), n),
    m as (select id, count(*) as n, sum(gain) as total from u join x using (word) join g using (bucket) group by 1),
    e as (select d.doc_id, len(w) as n_words, coalesce(m.n, 0)::bigint as n_features, case when m.n > 0 then ((total - ((total % m.n) + m.n) % m.n) // m.n) else 0 end::bigint as weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from d left join m using (id)),
    f as (select doc_id, n_words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5)::double / 4294967296.0::double)))::bigint as score from e),
    o as (select *, case when n_words >= 20 then row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls first, n_features, weight) end as place, count(*) filter (n_words >= 20) over () * 10 // 100 as drawn from f)
    select doc_id, n_features, weight, score, (case when place <= drawn then place end)::bigint as rank from o"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can say what an operator does; the others are tested against brute force in ``tests/llm``."""
    words = "string_split_regex(trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g'), ' '), ' ')"
    return {
        "op2_decontamination": _decontamination_sql(),
        "op11_source_divergence": _divergence_sql(),
        "op12_source_mixing": _mixing_sql(),
        "op13_target_resampling": _resampling_sql(),
        "op4_substring_dedup": f"""with d as (select doc_id, case when coalesce(text, '') = '' or trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g'), ' ') = '' then [] else {words} end as w from documents),
    p as (select doc_id, w, unnest(range(len(w) - 19)) as s from d), x as (select doc_id, s, row_number() over (partition by md5(array_to_string(w[s + 1 : s + 20], ' ')) order by doc_id, s) > 1 as late from p),
    c as (select distinct doc_id, unnest(range(s, s + 20)) as k from x where late), g as (select doc_id, list(k) as gone from c group by 1),
    o as (select doc_id, w, coalesce(gone, []) as gone from d left join g using (doc_id))
    select doc_id, len(w)::bigint as n_words, len(gone)::bigint as n_removed, sha256(array_to_string(case when len(gone) = 0 then w else list_filter(w, lambda v, i: not list_contains(gone, i - 1)) end, ' ')) as kept_sha256 from o""",
        "op9_vector_dedup": """with recursive e as (select vec_id, label, embedding::double[] as v from embeddings where embedding is not null and label is not null), l as (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id
    where list_cosine_similarity(a.v, b.v) >= 0.93), n as (select a, count(*) as k from l group by 1), r as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from r join l on l.a = r.b)
    select vec_id, coalesce(k, 0) as n_links, m.c as component_id, vec_id = m.c as kept from embeddings left join n on n.a = vec_id join (select a, min(b) as c from r group by 1) m on m.a = vec_id""",
    }
