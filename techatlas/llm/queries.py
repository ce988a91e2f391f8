"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from techatlas.llm import (
    align,
    chat,
    dualtree,
    embeddings,
    exact,
    kdtree,
    language,
    lm,
    minhash,
    packing,
    spaced,
    spans,
    toxicity,
)
from techatlas.llm.shared import UPPER, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_path() -> str:
    """The public tokenizer that packing uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the perspective of each of its speakers."""
    return chat.rotate(table(spark, sf_dir, "conversations"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by a factorization machine."""
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query
def op3_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every text by a trigram automaton."""
    return lm.score(table(spark, sf_dir, "documents"))


@query
def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap with benchmark items: one row per document and item."""
    found = spaced.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "at", "seeds")


@query
def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lose repeated sentences: which, where these came first, and what is left."""
    found = spans.changed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "removed", "first_doc_ids", "text")


@query
def op6_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings of one label."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text by byte context trees."""
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op8_powers_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in pieces of binary lengths, each a sequence of its own."""
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()))


@query
def op9_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal bytes."""
    found = kdtree.shard(table(spark, sf_dir, "documents"), shards=8)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates on 2-word shingles, similarity 0.8 or more."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates by 128-bit hash and bytes; the smallest id stays."""
    return exact.duplicates(table(spark, sf_dir, "documents"))


@query
def op12_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return dualtree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


@query
def op13_lockstep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers aligned over all texts."""
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align.alignment(table(spark, sf_dir, "documents"), a, b)


ORACLE["op1_perspectives"] = r"""with m as (
  select conv_id, turn, role speaker, coalesce(text, '') body from conversations),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, speaker nulls first, md5(body)) - 1 as n from m),
p as (select distinct conv_id conv, speaker perspective from m where speaker is not null and speaker <> 'system'),
x as (select o.*, perspective, case when speaker = perspective then 'assistant' when speaker = 'system' then 'system' else 'user' end as part
  from o join p on o.conv_id is not distinct from p.conv),
y as (select *, '<|im_start|>' || part || case when part = 'user' and speaker is not null then ' name=' || speaker else '' end || chr(10) head from x),
z as (select *, head || body || '<|im_end|>' || chr(10) full_ from y),
s as (select *, coalesce(sum(length(full_)) over (partition by conv_id, perspective order by n
  rows between unbounded preceding and 1 preceding), 0)::bigint begins from z)
select conv_id, perspective, n::bigint as position, part as role, case when part = 'user' then speaker end as name, full_ as rendered, begins as start,
  part = 'assistant' as trained, case when part = 'assistant' then begins + length(head) end mask_start,
  (case when part = 'assistant' then length(body) + 10 else 0 end)::bigint mask_length from s"""

ORACLE["op6_int8_tiles"] = """with recursive v as (
  select vec_id, embedding::double[] e, label from embeddings where label is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0),
link as (select a.vec_id x, b.vec_id y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  and list_cosine_similarity(a.e, b.e) >= 0.93),
reach(id, to_) as (select vec_id, vec_id from embeddings union select reach.id, link.y from reach join link on link.x = reach.to_),
comp as (select id, min(to_) component_id from reach group by 1),
n as (select x, count(*) n_links from link group by 1)
select vec_id, coalesce(n_links, 0) n_links, component_id, vec_id = component_id kept
from embeddings join comp on comp.id = vec_id left join n on n.x = vec_id"""

ORACLE["op10_minhash"] = f"""with recursive t as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') w from documents),
sh as (select distinct doc_id, case when len(w) = 1 then w[1] else w[i] || ' ' || w[i + 1] end s
  from (select doc_id, w, unnest(range(1, greatest(len(w), 2))) i from t where len(w) > 0)),
n as (select doc_id, count(*) n from sh group by 1),
both_ as (select a.doc_id x, b.doc_id y, count(*) c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (select x, y from both_ join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)),
edge as (select x, y from link union all select y, x from link),
reach(id, to_) as (select doc_id, doc_id from documents union select reach.id, edge.y from reach join edge on edge.x = reach.to_),
comp as (select id, min(to_) component_id from reach group by 1)
select d.doc_id, coalesce(n, 0) n_shingles, component_id, d.doc_id = component_id kept
from documents d join comp on comp.id = d.doc_id left join n on n.doc_id = d.doc_id"""

ORACLE["op11_exact"] = r"""with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') s from documents),
g as (select s, min(doc_id) keep_id, count(*) group_size from t group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(s) as text_sha256 from t join g using (s)"""

ORACLE["op12_dual_tree"] = f"""with d as (
  select doc_id, regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') w from documents),
i as (select distinct item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'),
  '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) t from benchmark),
c as (select count(*) n_all, sum(len(w))::bigint l_all from d where len(w) > 0),
tf as (select doc_id, len(w) n, unnest(w) t from d),
v as (select doc_id, n, t, count(*) tf from tf where t in (select t from i) group by all),
df as (select t, floor(1000 * ln((2 * n_all + 2)::double / (2 * count(*) + 1)::double))::bigint w from v, c group by t, n_all),
s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_all) // l_all))))::bigint score
  from i join v using (t) join df using (t), c group by all)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from s where score > 0 qualify rank <= 50"""
