"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import ann, bpe, chat, clustering, embedding_dedup, html_text, line_dedup, mixing, packing, prefix_trie, quality, simhash, toxicity
from corpusloom.tables import table


def op1_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.build_conversations(table(spark, sf_dir, "conversations"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_ann_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def op5_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op6_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op7_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), line_dedup.ALL_LINES).select("doc_id", "text", "n_lines", "n_removed")


def op10_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.in_fold().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op11_pack_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_quotes, op2_byte_bpe, op3_embedding_dedup, op4_ann_posting_lists, op5_weak_quality, op6_html_density, op7_simhash_trie, op8_mix_sources, op9_line_dedup, op10_toxicity_gru,
        op11_pack_two_fit, op12_prefix_trie, op13_annulus_clusters,
    )
}

OP3_SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
), g as (
  select vec_id, label, e from v
  where e is not null and label is not null and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(e, lambda x: x <> 0)) > 0
), l as (
  select a.vec_id as a, b.vec_id as b from g a join g b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.93
), r(id, c) as (
  select vec_id, vec_id from embeddings
  union
  select l.b, r.c from r join l on l.a = r.id
), n as (select a, count(*) as n from l group by a)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, c.c as component_id, e.vec_id = c.c as kept
from embeddings e join (select id, min(c) as c from r group by id) c on c.id = e.vec_id left join n on n.a = e.vec_id
"""

SIZED_SQL = r"""
sized as (
  select doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from {docs}
), w as (
  select *, greatest(0.25, 1.0::double - abs(length(coalesce(text, ''))::double / greatest(size, 1)::double - 6.5::double) / 20.0::double) as quality from sized
), per as (
  select source, sum(size)::bigint as source_size, count(*) as n_rows from w group by source
), ordered as (
  select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end::bigint as weight from per
), shares as (
  select *, sum(weight) over f_from as open_weight,
    (sum(source_size) over () * 150)::bigint - coalesce(sum(source_size) over f_before, 0)::bigint * 200 as rest
  from ordered
  window f_from as (order by source_size::double / weight::double, source nulls last rows between current row and unbounded following),
    f_before as (order by source_size::double / weight::double, source nulls last rows between unbounded preceding and 1 preceding)
), capped as (
  select *, weight * rest >= source_size * 200 * open_weight as is_full from shares
), plan as (
  select source, source_size, n_rows, case when is_full then (source_size * 2)::double else
    (weight * ((sum(source_size) over () * 150)::bigint - coalesce(sum(source_size) filter (where is_full) over (), 0)::bigint * 200))::double
      / (coalesce(sum(weight) filter (where not is_full) over (), 1) * 100)::double end as target
  from capped
), keyed as (
  select w.doc_id, w.source, w.size, w.quality, w.text, p.source_size, p.target,
    -ln(((('0x' || substr(md5('mix:' || coalesce(w.doc_id::varchar, 'null:' || w.size::varchar)), 1, 12))::bigint)::double + 0.5::double) / 281474976710656.0::double) / w.quality as key,
    case when p.source_size > 0 then floor(p.target / p.source_size)::bigint else 0 end as epochs
  from w join plan p on w.source is not distinct from p.source
), summed as (
  select *, sum(size) over (partition by source order by key, doc_id, size, quality rows between unbounded preceding and current row) as upto from keyed
), mixed as (
  select doc_id, source, size, source_size, target, text,
    epochs + case when upto::double - size::double / 2.0::double <= target - (epochs * source_size)::double then 1 else 0 end as copies
  from summed
)
"""

OP12_SQL = """
with h as (
  select conv_id, conv_id - conv_id % 100 as base, xor(list_reduce([4294967295::bigint] || flatten(list_transform(string_split(conv_id::varchar, ''),
      lambda s: [(256 + ascii(s))::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, e: case when e >= 256 then xor(a, e - 256) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end), 4294967295) % 6 as h
  from (select distinct conv_id from conversations where conv_id is not null)
), t as (
  select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as x from conversations where conv_id is not null
), l as (
  select conv_id, list({'r': r, 'x': x} order by turn nulls first, sha256(length(r)::varchar || ':' || r || x)) as turns from t group by conv_id
), b as (
  select h.conv_id, list_concat(coalesce(f.turns[1:h.h], []), l.turns[h.h + 1:]) as turns from h join l on l.conv_id = h.conv_id left join l f on f.conv_id = h.base
), p as (
  select conv_id, turns, unnest(range(len(turns) + 1)) as depth from b
), n as (
  select depth, turns[1:depth] as path, min(conv_id) as conv_id, count(*) as n_convs,
    coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where len(turns) = depth), '') as ends
  from p group by depth, turns[1:depth]
), c as (
  select depth - 1 as depth, path[1:depth - 1] as path, count(*) as n_children from n where depth > 0 group by all
), m as (
  select n.*, coalesce(c.n_children, 0) as n_children from n left join c on c.depth = n.depth and c.path = n.path
), u as (
  select *, unnest(range(depth + 1)) as up from m
), s as (
  select up as depth, path[1:up] as path, count(*) filter (where n_children = 0) as n_leaves, coalesce(sum((n_convs - 1) * length(path[depth].x)), 0) as saved from u group by up, path[1:up]
)
select m.conv_id, m.depth, q.conv_id as parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved::bigint as saved_tokens, sha256(m.ends) as ends_sha256
from m join s on s.depth = m.depth and s.path = m.path left join n q on q.depth = m.depth - 1 and q.path = m.path[1:m.depth - 1]
"""


def clustering_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """One assignment and one centroid table a round, in exact integers."""
    with_ = [
        f"v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)",
        f"c0 as (select row_number() over (order by sha256('2:' || vec_id::varchar), v) - 1 as c, v from v qualify row_number() over (order by sha256('2:' || vec_id::varchar), v) <= {k})",
    ]
    for r in range(rounds + 1):
        with_.append(f"d{r} as (select v.vec_id, v.v, c.c, list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::hugeint as d from v cross join c{r} c)")
        with_.append(f"a{r} as (select vec_id, v, (min(d * 1000 + c) % 1000)::integer as c, min(d) as d from d{r} group by vec_id, v)")
        if r < rounds:
            with_.append(f"u{r} as (select c, i, (s - ((s % n) + n) % n) // n as x from (select c, i, sum(v[i])::hugeint as s, count(*) as n from (select c, v, unnest(range(1, {dims + 1})) as i from a{r}) group by c, i))")
            with_.append(f"c{r + 1} as (select c.c, coalesce(m.v, c.v) as v from c{r} c left join (select c, list(x::bigint order by i) as v from u{r} group by c) m on m.c = c.c)")
    return (
        "with " + ",\n".join(with_) + f" select a.vec_id, a.c as cluster, a.d::bigint as distance, (sum(a.d) over (partition by a.c))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia, "
        f"sha256(array_to_string(c.v, ',')) as centroid_sha256 from a{rounds} a join c{rounds} c on c.c = a.c"
    )


ORACLES: dict[str, str] = {
    "op12_prefix_trie": OP12_SQL,
    "op13_annulus_clusters": clustering_sql(),
    "op3_embedding_dedup": OP3_SQL,
    "op8_mix_sources": "with " + SIZED_SQL.format(docs="documents") + "select doc_id, size, source_size, target, (copies * size)::bigint as taken from mixed",
}
