"""The SQL that the registered queries must equal, where SQL can state the result."""

from __future__ import annotations

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _level(child: str, parent: str, by: str, keys: str) -> str:
    """One level of shrinkage: rate of each child under its parent's posterior."""
    return f"""
      select {keys}, rate, a, b from (
        select c.*, (parent_rate * strength + good) as a, ((1 - parent_rate) * strength + n - good) as b, a / (a + b) as rate
        from (
          select x.*, coalesce(least(greatest(case when noise > 0 and between_ > 0 then noise / between_ - 1
                                                   else 1000.0 end, 1.0), 1000.0), 1000.0) as strength
          from (select ch.*, p.rate as parent_rate from {child} ch left join {parent} p using ({by})) x
          left join (
            select {by}, m * (1 - m) as noise, (spread - children * (m * (1 - m))) / total as between_
            from (select {by}, sum(n::double) as total, count(*) as children, max(p.rate) as m,
                         sum(n::double * (good::double / n - p.rate) * (good::double / n - p.rate)) as spread
                  from {child} ch left join {parent} p using ({by}) where n > 0 group by {by})
          ) s using ({by})
        ) c)"""


_WIDE = "('co.uk','org.uk','ac.uk','gov.uk','com.au','net.au','org.au','co.jp','or.jp','ne.jp','com.br','com.cn','co.in','co.nz','co.za')"

OP2 = f"""
with urls as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
named as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_LETTERS}) as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from urls),
cut as (
  select *, string_split(host, '.') as parts from named),
two as (
  select *, array_to_string(parts[greatest(1, len(parts) - 1):], '.') as last2,
         array_to_string(parts[greatest(1, len(parts) - 2):], '.') as last3, parts[len(parts)] as last1 from cut),
full_names as (
  select page_id, host, path, case when last2 in {_WIDE} then last3 else last2 end as domain,
         case when last2 in {_WIDE} then last2 else last1 end as suffix from two),
known as (select doc_id as page_id, count(*) as n, sum(quality) as good from labels where quality in (0, 1) group by 1),
hosts as (
  select host, domain, suffix, coalesce(sum(n), 0) as n, coalesce(sum(good), 0) as good
  from full_names left join known using (page_id) group by 1, 2, 3),
domains as (select domain, suffix, sum(n) as n, sum(good) as good from hosts group by 1, 2),
suffixes as (select suffix, 1 as one, sum(n) as n, sum(good) as good from domains group by 1),
top as (select 1 as one, (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) as rate from suffixes),
by_suffix as ({_level("suffixes", "top", "one", "suffix")}),
by_domain as ({_level("domains", "by_suffix", "suffix", "domain, suffix")}),
by_host as ({_level("hosts", "by_domain", "domain, suffix", "host")}),
bounds as (select host, rate, rate - 1.645 * sqrt(rate * (1 - rate) / (a + b + 1)) as bound from by_host),
ruled as (
  select page_id, host, path, case
    when (host = 'example.net' or suffix(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or suffix(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or suffix(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or suffix(host, '.net')) and starts_with(path, '/') then 'net/' end as rule
  from named)
select page_id, host, path, rule,
       case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
            when bound >= 0.5 then 'allow' else 'block' end as verdict,
       round(rate, 6) as good_rate, round(bound, 6) as bound
from ruled left join bounds using (host)"""

OP4 = """
with rows as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         ('0x' || substr(md5('17|' || coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')), 1, 13))::bigint as drawn
  from documents),
valued as (select *, length(bin(size)) + 7 as value from rows),
sources as (select source, sum(size) as source_size from rows group by 1),
weighted as (
  select *, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight from sources),
leveled as (
  select *, (1.5 * sum(source_size) over ()
             - coalesce(sum(2 * source_size) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following) as level,
         row_number() over (order by source_size / weight, source nulls last) as seq
  from weighted),
targets as (
  select source, source_size,
         least(2.0 * source_size, weight * (select arg_min(level, seq) from leveled where level * weight <= 2 * source_size))::double as target
  from leveled),
classes as (select source, value, sum(size) as words from valued group by 1, 2),
fitted as (
  select c.*, t.target,
         case when sum(words * value) over tail > 0
              then (t.target - 2 * coalesce(sum(words) over head, 0)) / sum(words * value) over tail else 0 end as c
  from classes c join targets t on c.source is not distinct from t.source
  window head as (partition by c.source order by value desc rows between unbounded preceding and 1 preceding),
         tail as (partition by c.source order by value desc rows between current row and unbounded following)),
ends as (select source, max(value) as end_value, arg_max(c, value) as end_c from fitted where c * value < 2 group by 1),
due as (
  select f.source, f.value, case when e.end_value is null or f.value > e.end_value then 2.0
                                 else greatest(0.0, e.end_c * f.value) end as due
  from fitted f left join ends e on f.source is not distinct from e.source),
placed as (
  select v.*, floor(d.due) as whole, d.due - floor(d.due) as part, (v.drawn + 0.5) / 4503599627370496.0 as u
  from valued v join due d on v.source is not distinct from d.source and v.value = d.value),
ranked as (
  select *, case when part > 0 and size > 0 then (u / (1 - u)) * ((1 - part) / part) end as odds from placed),
certain as (select source, sum(whole * size) as certain from placed group by 1),
run as (
  select r.doc_id, r.source, r.drawn, r.size, r.whole, r.odds, t.source_size, t.target, t.target - c.certain as room,
         sum(case when r.odds is not null then r.size end) over (partition by r.source order by r.odds nulls last, r.drawn, r.doc_id rows between unbounded preceding and current row) as upto
  from ranked r join targets t on r.source is not distinct from t.source join certain c on r.source is not distinct from c.source)
select doc_id, size, source_size::bigint as source_size, target,
       case when size > 0 then ((whole + case when odds is not null and upto - size / 2 <= room then 1 else 0 end) * size)::bigint else 0 end as taken
from run"""

OP6 = """
with keyed as (
  select doc_id, coalesce(octet_length(encode(text)), 0)::bigint as bytes,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as bits from documents),
prefixes as (
  select d.depth, k.bits >> (60 - d.depth) as shard_bits, sum(bytes) as shard_bytes, min(bits) = max(bits) as single
  from keyed k, (select unnest(range(0, 61)) as depth) d group by 1, 2),
found as (
  select k.doc_id, k.bytes, min(p.depth) as depth
  from keyed k join prefixes p on p.shard_bits = k.bits >> (60 - p.depth)
  where p.shard_bytes <= 4194304 or p.single group by 1, 2)
select f.doc_id, f.bytes, case when f.depth = 0 then '' else lpad(bin(p.shard_bits), f.depth::int, '0') end as shard,
       f.depth, p.shard_bytes::bigint as shard_bytes, p.shard_bytes > 4194304 as oversized
from found f join keyed k using (doc_id)
join prefixes p on p.depth = f.depth and p.shard_bits = k.bits >> (60 - f.depth)"""

OP9 = """
with v as (
  select vec_id, [floor(1024 * x::double) for x in embedding] as parts from embeddings
  where embedding is not null and vec_id is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.parts, c.parts)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 10"""

# Fixed value: the polynomial of CRC-32, bits reversed.
OP12 = """
with recursive crc_table as (
  select list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)
              order by b) as t from (select range::bigint as b from range(256))),
checked as (
  select d.*, xor(list_reduce(list_concat([4294967295::bigint], [ascii(c)::bigint for c in string_split(doc_id::varchar, '')]),
                              lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295) % 7 = 0 as chosen
  from documents d, crc_table),
told as (
  select doc_id, case when lang is null then '' else '=' || lang end as tree, chosen,
         coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') as head,
         n_chars, coalesce(strlen(text) || ':' || text, '-') as tail from checked),
leaves as (
  select doc_id, tree, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as digest,
         case when chosen then sha256(head || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || tail) end as bad from told),
placed as (
  select *, row_number() over (partition by tree order by doc_id nulls first, digest) - 1 as idx, count(*) over (partition by tree) as size
  from leaves),
nodes as (
  select 0 as level, tree, idx, size, digest from placed
  union all
  select level + 1, tree, idx // 2, any_value((size + 1) // 2), sha256(string_agg(digest, '' order by idx))
  from nodes where size > 1 group by level, tree, idx // 2),
subroots as (
  select tree, digest as subroot, row_number() over (order by tree) - 1 as idx, count(*) over () as size from nodes where size = 1),
tops as (
  select 0 as level, idx, size, subroot as digest from subroots
  union all
  select level + 1, idx // 2, any_value((size + 1) // 2), sha256(string_agg(digest, '' order by idx))
  from tops where size > 1 group by level, idx // 2),
others as (
  select p.doc_id, p.idx as place, n.level, n.digest from placed p
  join nodes n on n.tree = p.tree and n.size > 1 and n.idx = xor(p.idx >> n.level, 1)
  union all
  select p.doc_id, p.idx, 1000 + t.level, t.digest from placed p join subroots s using (tree)
  join tops t on t.size > 1 and t.idx = xor(s.idx >> t.level, 1)),
proofs as (select doc_id, place, sha256(string_agg(digest, '' order by level)) as proof_sha256 from others group by 1, 2),
inner_fold as (
  select doc_id, tree, idx as place, 0 as level, idx, size, coalesce(bad, digest) as digest from placed
  union all
  select f.doc_id, f.tree, f.place, f.level + 1, f.idx // 2, (f.size + 1) // 2,
         sha256(case when f.idx % 2 = 0 then f.digest || coalesce(o.digest, '') else o.digest || f.digest end)
  from inner_fold f left join nodes o on o.tree = f.tree and o.level = f.level and o.idx = xor(f.idx, 1) where f.size > 1),
fold as (
  select i.doc_id, i.place, i.tree, 0 as level, s.idx, s.size, i.digest from inner_fold i join subroots s using (tree) where i.size = 1
  union all
  select f.doc_id, f.place, f.tree, f.level + 1, f.idx // 2, (f.size + 1) // 2,
         sha256(case when f.idx % 2 = 0 then f.digest || coalesce(o.digest, '') else o.digest || f.digest end)
  from fold f left join tops o on o.level = f.level and o.idx = xor(f.idx, 1) where f.size > 1)
select p.doc_id, p.digest as leaf, s.subroot, r.digest as root, coalesce(q.proof_sha256, sha256('')) as proof_sha256,
       f.digest as folded_root, f.digest = r.digest as verified
from placed p join subroots s using (tree) join fold f on f.size = 1 and f.tree = p.tree and f.place = p.idx
join tops r on r.size = 1
left join proofs q on q.doc_id is not distinct from p.doc_id and q.place = p.idx"""

OP13 = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         [floor(256 * x::double) for x in embedding] as parts from embeddings
  where embedding is not null and vec_id is not null and label is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scored as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_dot_product(a.parts, c.parts)::bigint as score
  from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 50 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id,
       row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id)::int as rank,
       vec_id as negative_id, positive_score, score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not same
  and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3"""

S = {
    "op2_url_reputation": OP2,
    "op4_order_sampling": OP4,
    "op6_extendible_sharding": OP6,
    "op9_segment_topk": OP9,
    "op12_merkle_manifest": OP12,
    "op13_bond_negatives": OP13,
}
