"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, codec, decontaminate, jaccard, langid, neardup, packing, quality, ranked, sharding, substrings, trie, wordlm


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _share(divisor: int) -> F.Column:
    """crc32 of doc_id as text, modulo a divisor."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents whose label says good quality; background: all documents."""
    docs = read(spark, sf_dir, "documents")
    return wordlm.score(docs, read(spark, sf_dir, "labels").where("quality = 1"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_hash")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), shards=16)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.round_trip(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), every=20, k=20)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net = quality.train(docs, read(spark, sf_dir, "labels").where(_share(5) != 0))
    got = quality.classify(docs, net, threshold=0.3)
    return got.select("doc_id", (_share(5) == 0).alias("held_out"), "score", "predicted")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(read(spark, sf_dir, "documents"), window=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs.where(_share(4) != 2))
    return langid.identify(docs, model).select("doc_id", (_share(4) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_copies")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_sets(read(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(trie.ordered(read(spark, sf_dir, "conversations")), every=5, most=8))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_lm_scoring, op3_decontamination, op4_sharding, op5_token_files, op6_nearest, op7_quality, op8_substring_dedup, op9_language_id, op10_near_dedup, op11_ranked_search, op12_jaccard_join, op13_prefix_trie, pipeline)}

_OP3 = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(len(w), 10) as n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') as g
       from b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as t(i) where len(w) > 0),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as g from d, sizes, unnest(range(1, len(w) - n + 2)) as t(i) where len(w) >= n),
hit as (select doc_id, i, dw.n, item_id from dw join bw on dw.n = bw.n and dw.g = bw.g),
covered as (select doc_id, count(distinct p) as n_hit from hit, unnest(range(i, i + n)) as t(p) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct doc_id, item_id::varchar as s from hit) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join items using (doc_id)
"""

_OP8 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') as g from d, unnest(range(1, len(w) - 18)) as t(i) where len(w) >= 20),
again as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as k from win) where k > 1),
gone as (select distinct doc_id, p from again, unnest(range(i, i + 20)) as t(p)),
flat as (select doc_id, p, w[p] as word from d, unnest(range(1, len(w) + 1)) as t(p)),
kept as (select doc_id, string_agg(word, ' ' order by p) as k, count(*) as n from flat anti join gone using (doc_id, p) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, (len(d.w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(k, '')) as kept_sha256
from d left join kept using (doc_id)
"""

_OP10 = r"""
with recursive d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
keyed as (select doc_id, w, case when len(w) > 0 then 'w ' || array_to_string(w, ' ') else 't ' || text end as c from d),
node as (select c, min(doc_id) as node, count(*) as n_copies, any_value(w) as w from keyed group by c),
sh as (select node, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') as g, count(*) as n
       from node, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as t(i) where len(w) > 0 group by all),
size as (select node, sum(n) as total from sh group by node),
pair as (select a.node as u, b.node as v, sum(least(a.n, b.n)) as shared from sh a join sh b on a.g = b.g and a.node > b.node group by all),
link as (select u, v from pair join size x on x.node = u join size y on y.node = v where shared >= 0.8 * (x.total + y.total - shared) - 1e-9),
edge as (select u, v from link union select v, u from link),
reach as (select node as s, node as t from node union select r.s, e.v from reach r join edge e on e.u = r.t),
class as (select s as node, min(t) as class_id from reach group by s)
select doc_id, class_id, n_copies from keyed join node using (c) join class using (node)
"""

_OP11 = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
total as (select count(*) filter (where len(w) > 0) as n_docs, sum(len(w))::bigint as n_words from d),
item as (select item_id, term, count(*) as q from (select item_id, unnest(w) as term from b) group by all),
tf as (select r, term, count(*) as tf from (select r, unnest(w) as term from d) semi join item using (term) group by all),
weight as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint as w from (select term, count(*) as df from tf group by term), total),
size as (select r, doc_id, 100 - 75 + ((75 * len(w)::bigint * n_docs) // n_words) as m from d, total),
impact as (select r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * m)) as impact from tf join weight using (term) join size using (r)),
score as (select item_id, r, doc_id, sum(q * impact)::bigint as score from item join impact using (term) group by all having sum(q * impact) > 0),
best as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from score)
select item_id, rank::int as rank, doc_id, score from best where rank <= 10
"""

_OP12 = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (select distinct doc_id, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') as g from d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as t(i) where len(w) > 0),
size as (select doc_id, count(*) as n from sh group by doc_id),
pair as (select a.doc_id as u, b.doc_id as v, count(*) as shared from sh a join sh b on a.g = b.g and a.doc_id > b.doc_id group by all),
link as (select u, v from pair join size x on x.doc_id = u join size y on y.doc_id = v where 100 * shared >= 80 * (x.n + y.n - shared)),
edge as (select u, v from link union select v, u from link),
reach as (select doc_id as s, doc_id as t from d union select r.s, e.v from reach r join edge e on e.u = r.t),
whole as (select s as doc_id, min(t) as component_id from reach group by s),
copies as (select w, count(*) as n_copies from d where len(w) > 0 group by w)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, coalesce(n_copies, 1)::bigint as n_copies
from d join whole using (doc_id) left join size using (doc_id) left join copies on copies.w = d.w
"""

_OP13 = r"""
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos, md5(coalesce(role, '')) || md5(coalesce(text, '')) as turn_key, strlen(coalesce(text, '')) as bytes from conversations where conv_id is not null),
size as (select conv_id, count(*) as n, conv_id - conv_id % 5 as base, xor(4294967295, list_reduce([4294967295::bigint] || list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::bigint),
         lambda c, x: list_reduce([xor(c, x)] || range(8), lambda k, i: case when k % 2 = 1 then xor(k // 2, 3988292384) else k // 2 end))) % 9 as h from t group by conv_id),
built as (select size.conv_id, pos as depth, turn_key, bytes from size join t on t.conv_id = size.base and pos <= h
          union all select t.conv_id, least(size.h, coalesce(b.n, 0)) + pos - size.h, turn_key, bytes from t join size using (conv_id) left join size b on b.conv_id = size.base where pos > size.h),
p as (select conv_id, depth, md5(string_agg(turn_key, '') over (partition by conv_id order by depth)) as k, bytes from built union all select conv_id, 0, '', 0 from size),
node as (select depth, k, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes from p group by all),
up as (select distinct p.depth, p.k, q.k as pk from p join p q on q.conv_id = p.conv_id and q.depth = p.depth - 1),
kids as (select depth - 1 as depth, pk as k, count(*) as n from up group by all),
subtree as (select a.depth, a.k, sum((n.n_convs - 1) * n.bytes) as saved, count(*) filter (where kids.n is null) as leaves
            from node n left join kids on kids.depth = n.depth and kids.k = n.k join p a on a.conv_id = n.conv_id and a.depth <= n.depth group by all),
stop as (select conv_id, max(depth) as depth from p group by conv_id),
ends as (select depth, k, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as sha from p join stop using (conv_id, depth) group by all)
select n.conv_id, n.depth, parent.conv_id as parent_conv_id, n.n_convs, coalesce(kids.n, 0) as n_children, leaves as n_leaves, saved::bigint as saved_tokens, coalesce(sha, sha256('')) as ends_sha256
from node n join subtree s on s.depth = n.depth and s.k = n.k left join kids on kids.depth = n.depth and kids.k = n.k left join ends e on e.depth = n.depth and e.k = n.k
left join up on up.depth = n.depth and up.k = n.k left join node parent on parent.depth = n.depth - 1 and parent.k = up.pk
"""

ORACLE_SQL: dict[str, str] = {"op3_decontamination": _OP3, "op8_substring_dedup": _OP8, "op10_near_dedup": _OP10, "op11_ranked_search": _OP11, "op12_jaccard_join": _OP12, "op13_prefix_trie": _OP13}
