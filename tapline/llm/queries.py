"""Registered queries of the operators (opN_<name>) and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_snapshots, containment, embedding_graph, fst_tokens, heap_clusters, language_mixture, license_rules, lsh_forest, packing, secret_formats, token_links, toxic_segments, url_trie
from .scratch import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}



def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; the files are never copied."""
    return public_tokenizers.path(name)


def _register(fn):
    QUERIES[fn.__name__] = fn
    return fn


# -- 1: embedding near-dedup ------------------------------------------------

@_register
def op1_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept vectors at a cosine of 0.93."""
    return embedding_graph.near_duplicates(documents(spark, sf_dir, "embeddings"))


SQL["op1_embedding_graph"] = """
with recursive g as (select vec_id, label, list_transform(embedding, lambda x: x::double) v from embeddings where label is not null and embedding is not null),
u as (select * from g where len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
l as (select a.vec_id a, b.vec_id b from u a join u b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id
      where list_cosine_similarity(a.v, b.v) >= 0.93),
r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
c as (select a vec_id, min(b) low from r group by a),
k as (select a vec_id, count(*) n from l group by a)
select vec_id, coalesce(n, 0)::bigint n_links, least(vec_id, coalesce(low, vec_id))::bigint component_id,
  vec_id = least(vec_id, coalesce(low, vec_id)) kept from embeddings left join c using (vec_id) left join k using (vec_id)"""


# -- 2: benchmark decontamination ------------------------------------------

@_register
def op2_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, item) with at least three quarters of the item's shingles in the document."""
    return containment.leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_SHINGLES = """list_distinct(case when len({w}) >= 5 then list_transform(range(1, len({w}) - 3), lambda i: array_to_string({w}[i:i + 4], ' '))
      when len({w}) > 0 then [array_to_string({w}, ' ')] else [] end)"""

SQL["op2_benchmark_containment"] = f"""
with d as (select doc_id, unnest({_SHINGLES.format(w='w')}) s from (select doc_id, {_WORDS.format(text='text')} w from documents)),
i as (select item_id, {_SHINGLES.format(w='w')} ss from (select item_id, {_WORDS.format(text='text')} w from benchmark)),
u as (select item_id, len(ss) n_item, unnest(ss) s from i)
select doc_id, item_id, count(*)::bigint n_shared, any_value(n_item)::bigint n_item
from d join u using (s) group by doc_id, item_id having 100 * count(*) >= 75 * any_value(n_item)"""


# -- 3: MinHash near-dedup --------------------------------------------------

@_register
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return lsh_forest.near_duplicates(documents(spark, sf_dir))


SQL["op3_minhash_near_dedup"] = f"""
with recursive t as (select doc_id, {_SHINGLES.format(w='w')} ss from (select doc_id, {_WORDS.format(text='text')} w from documents)),
s as (select doc_id, len(ss) n, unnest(ss) s from t),
l as (select a.doc_id a, b.doc_id b from s a join s b on a.s = b.s and a.doc_id <> b.doc_id
      group by all having 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
c as (select a doc_id, min(b) low from r group by a)
select doc_id, len(ss)::bigint n_shingles, least(doc_id, coalesce(low, doc_id))::bigint component_id,
  doc_id = least(doc_id, coalesce(low, doc_id)) kept from t left join c using (doc_id)"""


# -- 4: token counts --------------------------------------------------------

@_register
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the compiled transducers of byte_bpe_50k."""
    return fst_tokens.token_counts(documents(spark, sf_dir), vocabulary())


# -- 5: chat formatting -----------------------------------------------------

@_register
def op5_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal conversations, as digests of their rendered texts."""
    return chat_snapshots.digest(documents(spark, sf_dir, "conversations"))


SQL["op5_chat_snapshots"] = """
with t as (select distinct conv_id, turn, coalesce(role, 'unknown') role, coalesce(text, '') text from conversations where conv_id is not null),
h as (select *, md5(role || chr(31) || text) h from t),
p as (select *, row_number() over w pos, count(*) over (partition by conv_id) n from h window w as (partition by conv_id order by turn nulls first, h)),
r as (select *, string_agg(h, '') over (partition by conv_id order by pos rows unbounded preceding) k from p),
m as (select n, k, min(conv_id) conv_id, count(*) n_copies from r where pos = n group by n, k),
x as (select * from m where not exists (select 1 from r where r.pos < r.n and r.pos = m.n and r.k = m.k)),
s as (select conv_id, pos, '<' || role || '>' || chr(10) || text || chr(10) segment from p)
select conv_id, any_value(n)::bigint n_turns, any_value(n_copies)::bigint n_copies, sum(length(segment))::bigint n_chars,
  sum(('0x' || substr(md5(pos::varchar || chr(31) || segment), 1, 8))::bigint)::bigint text_sum
from x join s using (conv_id) group by conv_id"""


# -- 6: toxicity ------------------------------------------------------------

@_register
def op6_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; folds other than 0 teach."""
    docs = documents(spark, sf_dir)
    model = toxic_segments.train(docs, documents(spark, sf_dir, "labels"))
    scored = toxic_segments.score(docs, model)
    return scored.select("doc_id", (language_mixture.fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted",
                         F.size("passages").alias("n_passages"))


# -- 7: license scans -------------------------------------------------------

@_register
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License detections of every document, base phrases apart."""
    return license_rules.scan(documents(spark, sf_dir))


def _license_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({q(a)}, {n}, {p}, {q(label)}, {q(x)})" for a, n, p, label, x in license_rules.rules())
    base = ",\n".join(f"({q(p)}, {q(label)})" for p, label in license_rules.BASE)
    return f"""
with rules(anchor, no, priority, label, pattern) as (values {values}),
base(phrase, label) as (values {base}),
d as (select row_number() over () rid, doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{license_rules.UPPER}', '{license_rules.SMALL}'),
      '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')) norm from documents),
w as (select rid, doc_id, norm, case when norm = '' then [] else string_split(norm, ' ') end ws from d),
pos as (select rid, ws, unnest(range(len(ws))) i from w),
b as (select rid, i, label from pos join base on array_to_string(ws[i + 1:i + len(string_split(phrase, ' '))], ' ') = phrase),
bs as (select rid, count(*) n_base, min(i) first_word, max(i) last_word, list(distinct label) labels from b group by rid),
m as (select rid, i s, no, priority, label, regexp_extract(array_to_string(ws[i + 1:i + {license_rules.WINDOW}], ' ') || ' ', pattern, 0) hit
      from pos join rules on ws[i + 1] = anchor),
h as (select rid, s, s + len(string_split(trim(hit), ' ')) e, priority, no, label, len(string_split(trim(hit), ' ')) n from m where hit <> ''),
kept as (select * from h a where not exists (select 1 from h b where b.rid = a.rid and b.s <= a.s and b.e >= a.e and b.priority > {license_rules.EXPRESSION}
         and (b.priority > a.priority or b.priority = a.priority and (b.n > a.n or b.n = a.n and b.no < a.no)))),
ks as (select rid, max(priority) best, list(distinct label) labels from kept group by rid)
select doc_id, len(ws)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word,
  coalesce(array_to_string(list_sort(bs.labels), ','), '') base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bs.labels, []), coalesce(ks.labels, [])))), ','), '') labels,
  greatest(coalesce(best, 0) / 100.0, case when n_base > 0 then 0.6 else 0.0 end)::double score
from w left join bs using (rid) left join ks using (rid)"""


SQL["op7_license_scan"] = _license_sql()


# -- 8: URL filters ---------------------------------------------------------

@_register
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page by the fixed rule set."""
    return url_trie.judge(documents(spark, sf_dir, "pages"))


def _url_sql() -> str:
    longest = sorted(url_trie.RULES, key=lambda r: (-r[1].count("."), -len(r[2])))
    fits = "\n".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{{{i}}}'"
                     for i, (_, h, p) in enumerate(longest))
    rule = fits.format(*[h + p for _, h, p in longest])
    verdict = fits.format(*[v for v, _, _ in longest])
    return f"""
with r as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{license_rules.UPPER}', '{license_rules.SMALL}') host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from r)
select page_id, host, path, case {rule} end rule, case {verdict}
  when regexp_matches(host, '(^|[.-])({'|'.join(sorted(url_trie.BLOCK_WORDS))})($|[.-])') then 'block' else 'allow' end verdict
from p"""


SQL["op8_url_filter"] = _url_sql()


# -- 9: language ID ---------------------------------------------------------

def _held_language(docs: DataFrame):
    return language_mixture.fold_of(docs["doc_id"], 4) == 2


@_register
def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; fold 2 of 4 teaches nothing."""
    docs = documents(spark, sf_dir)
    model = language_mixture.train(docs.where(~_held_language(docs)))
    found = language_mixture.predict(docs, model)
    return found.select("doc_id", _held_language(found).alias("held_out"), "lang_pred", "score")


# -- 10: best-fit packing ---------------------------------------------------

@_register
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 1024 tokens."""
    return packing.pack_documents(documents(spark, sf_dir), vocabulary())


# -- 12: centroid clustering ------------------------------------------------

@_register
def op12_heap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all usable vectors after ten rounds."""
    return heap_clusters.clusters(documents(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, seed="3")


def _clusters_sql(k: int = 8, rounds: int = 10, dim: int = 64, seed: str = "3") -> str:
    steps = [f"""c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id), x) - 1 no, v from g where vec_id is not null
  qualify row_number() over (order by sha256('{seed}:' || vec_id), x) <= {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} as materialized (select rid, min({{'d': list_sum(list_transform(list_zip(g.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'no': no}}) b
  from g, c{i} group by rid)""")
        if i < rounds:
            steps.append(f"""s{i} as (select no, pos, sum(x) s, count(*) n from (select b.no no, unnest(v) x, unnest(range({dim})) pos from a{i} join g using (rid)) group by no, pos),
c{i + 1} as materialized (select no, coalesce(m, v) v from c{i} left join (select no, list(((s - ((s % n) + n) % n) // n)::bigint order by pos) m from s{i} group by no) using (no))""")
    return f"""
with f as (select row_number() over () rid, vec_id, list_transform(embedding, lambda x: x::double) x from embeddings where len(embedding) = {dim}
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
g as materialized (select rid, vec_id, x, list_transform(x, lambda y: greatest(least(floor({heap_clusters.SCALE} * y), {heap_clusters.BOUND}), -{heap_clusters.BOUND})::bigint) v from f),
{",".join(steps)},
t as (select rid, b.no no, b.d d, sum(b.d) over (partition by b.no) own, sum(b.d) over () whole from a{rounds})
select vec_id, no::int cluster, d::bigint distance, own::bigint cluster_inertia, whole::bigint inertia, sha256(array_to_string(c{rounds}.v, ',')) centroid_sha256
from t join g using (rid) join c{rounds} using (no)"""


SQL["op12_heap_clusters"] = _clusters_sql()


# -- 13: cross-tokenizer alignment ------------------------------------------

@_register
def op13_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens of byte_bpe_50k and piece_bpe_32k in every document, with corpus-wide pair counts."""
    return token_links.links(documents(spark, sf_dir), vocabulary(), vocabulary("piece_bpe_32k.model"))


# -- 11: secret scans -------------------------------------------------------

@_register
def op11_secret_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base secrets of every document, and candidates in the inferred formats."""
    docs = documents(spark, sf_dir)
    return secret_formats.scan(docs, secret_formats.train(docs))
