"""The queries of the training-data operators, with SQL for those that SQL can express over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, clustering, decontaminate, html_extract, jaccard, mixing, phrases, pii, secrets, sharding, simhash, token_shards, toxicity
from .common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, model)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.components_of(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.records(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.first_positions(mixing.mix(table(spark, sf_dir, "documents")))
    return got.select("doc_id", "size", "source_size", "target", "taken", "source", "first_due", "first_position", "n_passes")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op11_phrase_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components_of(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_extraction, op2_benchmark_decontamination, op3_pii, op4_secret_scan, op5_toxicity, op6_simhash_dedup, op7_token_shards, op8_mixing, op9_sharding, op10_nearest_neighbours, op11_phrase_collocation, op12_centroid_clustering, op13_ngram_jaccard_join)
}


def _cluster_sql(rounds: int = clustering.ROUNDS) -> str:
    """Rounds of assigning and averaging, written out one after the other."""
    hashed = f"sha256('{clustering.SEED}:' || cast(vec_id as varchar)) nulls last, v"
    ctes = [
        f"v as materialized (select row_number() over () rid, vec_id, list_transform(embedding, lambda x: cast(floor({clustering.SCALE} * cast(x as double)) as bigint)) v from embeddings where len(embedding) = {clustering.DIMS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"c0 as materialized (select cast(row_number() over (order by {hashed}) - 1 as integer) c, v cv from v order by {hashed} limit {clustering.CLUSTERS})",
    ]
    for i in range(rounds + 1):
        ctes.append(f"a{i} as materialized (select rid, vec_id, v, c, d from (select rid, vec_id, v, c, d, row_number() over (partition by rid order by d, c) r from (select rid, vec_id, v, c, cast(list_sum(list_transform(list_zip(v, cv), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) d from v, c{i})) where r = 1)")
        if i < rounds:
            ctes.append(f"s{i} as (select c, p, sum(x) s, count(*) n from (select c, unnest(v) x, unnest(range(1, len(v) + 1)) p from a{i}) group by c, p)")
            ctes.append(f"m{i} as (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by p) cv from s{i} group by c)")
            ctes.append(f"c{i + 1} as materialized (select o.c, coalesce(m.cv, o.cv) cv from c{i} o left join m{i} m using (c))")
    last = rounds
    return "with " + ",\n".join(ctes) + f"""
select vec_id, c as cluster, d as distance, cast(sum(d) over (partition by c) as bigint) cluster_inertia, cast(sum(d) over () as bigint) inertia, sha256(array_to_string(cv, ',')) centroid_sha256 from a{last} join c{last} using (c)"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "coalesce(regexp_extract_all(" + _LOWER + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"

SQL: dict[str, str] = {
    "op2_benchmark_decontamination": f"""
with d as (select row_number() over () rid, doc_id, {_WORDS.format('text')} w from documents),
b as (select item_id, {_WORDS.format('text')} w from benchmark),
win as (select distinct item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') g from (select item_id, w, least(10, len(w)) n, unnest(range(1, len(w) - least(10, len(w)) + 2)) p from b where len(w) > 0)),
lens as (select distinct n from win),
dw as (select rid, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') g from (select rid, w, n, unnest(range(1, len(w) - n + 2)) p from d, lens where len(w) >= n)),
hit as (select rid, item_id, p, win.n from dw join win using (n, g)),
hw as (select rid, count(distinct q) n_hit from (select rid, unnest(range(p, p + n)) q from hit) group by rid),
hi as (select rid, count(*) n_items, string_agg(i, ',' order by i) ids from (select distinct rid, cast(item_id as varchar) i from hit where item_id is not null) group by rid)
select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hw using (rid) left join hi using (rid)""",
    "op8_mixing": """
with s as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint size, ('0x' || substr(md5(concat_ws('|', '8', cast(doc_id as varchar), text)), 1, 15))::bigint hash from documents),
z as (select source, sum(size)::bigint source_size from s group by source),
t1 as (select *, (row_number() over (order by source nulls last) - 1) % 3 turn, (sum(source_size) over ())::double total, source_size * 3::double cap from z),
t2 as (select *, (case turn when 0 then 5 when 1 then 2 else 1 end)::double w, (case turn when 0 then 0.5 when 1 then 0.0 else -0.5 end)::double slope from t1),
t3 as (select *, (total - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0::double)) / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) own from t2),
t4 as (select *, max(case when own <= cap / w then own end) over () lev from t3),
t5 as (select source src, source_size, coalesce(least(cap, lev * w), cap) target, slope from t4),
t6 as (select *, sum(target) over () all_targets, sum(target * slope) over () all_slopes from t5),
o as (select doc_id, source, size, source_size, target, slope, all_targets, all_slopes, round(target)::bigint quota, coalesce(sum(size) over (partition by source order by hash, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint start from s join t6 on s.source is not distinct from t6.src),
k as (select *, (least(greatest(quota - start, 0), size) + least(greatest(quota - start - source_size, 0), size) + least(greatest(quota - start - 2 * source_size, 0), size))::bigint taken, least(coalesce(start::double / nullif(target, 0::double), 0::double), 1::double) y from o),
u as (select *, case when taken > 0 then coalesce((slope - 1 + sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * y, 0::double))) / (2 * nullif(slope, 0::double)), y) end first_due from k)
select doc_id, size, source_size, target, taken, source, first_due, round(all_targets * first_due + all_slopes * (first_due * first_due - first_due))::bigint first_position,
  case when size = 0 then 0 else (quota > start)::int + (quota > start + source_size)::int + (quota > start + 2 * source_size)::int end n_passes from u""",
    "op10_nearest_neighbours": """
with e as (select row_number() over () rid, vec_id, cast(embedding as double[]) v, len(embedding) d from embeddings where vec_id is not null and embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.rid q, a.vec_id query_id, b.rid, b.vec_id, list_dot_product(a.v, b.v) score from e a join e b on a.d = b.d where a.vec_id % 20 = 0 and a.rid <> b.rid),
r as (select *, row_number() over (partition by q order by score desc, vec_id) rank from p)
select query_id, cast(rank as integer) rank, vec_id, score from r where rank <= 20""",
    "op11_phrase_collocation": f"""
with w as materialized (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') w from (select coalesce(lang, 'und') lang, unnest(string_split_regex({_LOWER.format('text')}, '[.,;:!?\\x0A-\\x0D]')) piece from documents)),
t as (select lang, cast(sum(len(w)) as bigint) n from w group by lang),
g as materialized (select lang, k, p, count(*) a from (select lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') p from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from w, (values (1), (2), (3)) ks(k) where len(w) >= k)) group by lang, k, p having count(*) >= 10),
c as (select lang, k, p, a, string_split(p, ' ') w from g where k > 1),
x as (select lang, k, p, a, w, j, array_to_string(list_slice(w, 1, j), ' ') lp, array_to_string(list_slice(w, j + 1, k), ' ') rp from c, (values (1), (2)) js(j) where j < k),
s as (select x.lang, x.k, x.p, x.a, j, gl.a l, gr.a r, (1000000::hugeint * x.a * x.a) // (gl.a::hugeint * gr.a) score from x join g gl on gl.lang = x.lang and gl.p = lp and gl.k = j join g gr on gr.lang = x.lang and gr.p = rp and gr.k = x.k - j),
b as (select * from (select *, row_number() over (partition by lang, p order by score, j) q from s) where q = 1),
o as (select lang, p, max(a) a from (select lang, a, unnest([array_to_string(list_slice(w, 1, 2), ' '), array_to_string(list_slice(w, 2, 3), ' ')]) p from c where k = 3) group by lang, p),
f as (select b.* from b left join o on o.lang = b.lang and o.p = b.p where o.a is null or b.k = 3 or 100 * o.a < 50 * b.a),
r as (select *, row_number() over (partition by lang order by score desc, a desc, p) rank from f)
select lang, cast(rank as integer) rank, p as phrase, a, l, r.r as r, n, cast(score as bigint) score from r join t using (lang) where rank <= 2000""",
    "op12_centroid_clustering": _cluster_sql(),
    "op13_ngram_jaccard_join": f"""
with recursive d as materialized (select row_number() over () rid, doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+'), []) w from documents),
sh as materialized (select distinct rid, array_to_string(list_slice(w, p, p + k - 1), ' ') g from (select rid, w, least(5, len(w)) k, unnest(range(1, len(w) - least(5, len(w)) + 2)) p from d where len(w) > 0)),
z as materialized (select rid, count(*) n from sh group by rid),
b as materialized (select a.rid x, c.rid y, count(*) same from sh a join sh c using (g) where a.rid <> c.rid group by all),
l as materialized (select x, y from b join z za on za.rid = x join z zc on zc.rid = y where 100 * same >= 80 * (za.n + zc.n - same)),
r as (select rid x, rid y from z union select r.x, l.y from r join l on l.x = r.y),
c as (select x, min(doc_id) component from r join d on d.rid = r.y group by x)
select doc_id, coalesce(n, 0) n_shingles, case when n is null then doc_id else component end component_id from d left join z using (rid) left join c on c.x = d.rid""",
}
