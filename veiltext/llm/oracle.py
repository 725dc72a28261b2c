"""DuckDB SQL for those queries that SQL can express."""

# crc32, bit by bit: the bits of all bytes, lowest first, through the polynomial.
_CRC = """
xor(list_reduce(
  [4294967295::bigint] || flatten(list_transform(
    regexp_extract_all(hex({blob}), '..'),
    lambda h: list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda k: (('0x' || h)::bigint >> k) & 1)
  )),
  lambda c, b: case when (c & 1) <> b then xor(c >> 1, 3988292384::bigint) else c >> 1 end
), 4294967295::bigint)
"""

SHARDING = f"""
with sized as (
  select doc_id, coalesce(text, '') as body,
    (octet_length(encode(coalesce(text, ''))) + 1)::bigint as size
  from documents
),
grouped as (select body, min(doc_id) as first from sized group by body),
placed as (
  select s.doc_id, s.size, s.body, g.first,
    (sum(s.size) over before - s.size)::bigint as start,
    row_number() over before - 1 as no,
    (sum(s.size) over ())::bigint as total
  from sized s join grouped g on s.body = g.body
  window before as (order by g.first, s.doc_id rows unbounded preceding)
),
cut as (select *, least(7, (8 * (2 * start + size)) // (2 * total)) as side from placed),
whole as (
  select first, least(7, (8 * (2 * min(start) + sum(size)::bigint)) // (2 * any_value(total))) as moved
  from cut group by first
  having min(side) < max(side) and sum(size)::bigint * 8 * 32 <= any_value(total)
),
dealt as (
  select c.*, coalesce(w.moved, c.side) as shard from cut c left join whole w on c.first = w.first
)
select doc_id, size, {_CRC.format(blob="encode(body)")} as text_crc32, 'bytes' as law,
  shard::integer as shard, (no - min(no) over (partition by shard))::bigint as slot, start,
  null::integer as grown_shard
from dealt
"""

# Targets: with sources in the order of limit per weight, the level is that of the first one which
# leaves the next source under its limit. Taken: the words of the twice-repeated, shuffled stream of
# the source that lie before the target.
MIXING = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5('mix:' || doc_id::varchar) as shuffled
  from documents
),
sources as (
  select source, sum(size)::bigint as source_size, 2 * sum(size)::bigint as cap,
    [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
  from sized group by source
),
steps as (
  select *, (sum(source_size) over ())::bigint as total,
    coalesce((sum(cap) over low), 0)::bigint as held, (sum(weight) over rest)::bigint as left_weight
  from sources
  window low as (order by cap / weight, cap, source rows between unbounded preceding and 1 preceding),
    rest as (order by cap / weight, cap, source rows between current row and unbounded following)
),
level as (
  select min_by((3 * total - 2 * held) / (2 * left_weight), cap / weight) as level
  from steps where (3 * total - 2 * held) / (2 * left_weight) < cap / weight
),
targets as (
  select source, source_size,
    case when cap <= coalesce(level, cap) * weight then cap::double else level * weight end as target
  from sources, level
),
stream as (
  select s.*, t.source_size, t.target, floor(t.target + 0.5)::bigint as goal,
    (sum(s.size) over (partition by s.source order by s.shuffled, s.doc_id rows unbounded preceding)
      - s.size)::bigint as since
  from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  (greatest(0, least(since + size, goal) - since)
    + greatest(0, least(since + size + source_size, goal) - since - source_size))::bigint as taken
from stream
"""

WARC = """
with described as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes,
    sha256(coalesce(html, '')) as payload_digest
  from pages
),
firsts as (
  select *, min(page_id) over (partition by payload_digest) as first from described
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from firsts
"""

TOP_K = """
with able as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from able q, able c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id
)
select query_id, rank::integer as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
) where rank <= 20
"""

JACCARD = r"""
with recursive worded as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w
  from documents
),
shingles as (
  select distinct doc_id, md5(unnest(case
    when len(w) = 0 then []
    when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
  end)) as s
  from worded
),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as o
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
),
linked as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * o >= 85 * (x.n + y.n - o)
),
both_ways as (select a, b from linked union all select b, a from linked),
reached as (
  select doc_id, doc_id as other from documents
  union
  select r.doc_id, e.b from reached r join both_ways e on r.other = e.a
)
select d.doc_id, coalesce(any_value(z.n), 0)::bigint as n_shingles, min(r.other) as component_id
from documents d left join sizes z on z.doc_id = d.doc_id join reached r on r.doc_id = d.doc_id
group by d.doc_id
"""

# Pairs of equal words on a diagonal, gathered to rows of matches; a row whose stretch lies in that of
# a divisor of its lag repeats a smaller period.
PERIODS = rf"""
with split as (
  select row_number() over () as no, doc_id, {_CRC.format(blob="encode(doc_id::varchar)")} as h,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
  from documents
),
cut as (select *, len(words) as n, h // 10 as g from split),
chosen as (select *, case when h % 10 = 0 and n > 0 then g % n end as a from cut),
dealt as (
  select no, doc_id, n, case when a is null then words else list_transform(
    range(n), lambda i: words[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]
  ) end as words
  from chosen
),
placed as (
  select no, n, unnest(words) as word, unnest(range(n)) as i from dealt
),
matches as (
  select x.no, y.i - x.i as q, x.i
  from placed x join placed y on x.no = y.no and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= x.n
),
rows_of as (select *, i - row_number() over (partition by no, q order by i) as place from matches),
stretches as (
  select no, q, min(i) as start, count(*) + q as length from rows_of group by no, q, place
  having count(*) + q >= greatest(6, 4 * q)
),
runs as (
  select * from stretches s where not exists (
    select 1 from stretches t where t.no = s.no and t.q < s.q and s.q % t.q = 0
      and t.start <= s.start and t.start + t.length >= s.start + s.length
  )
),
per_doc as (
  select no, count(*) as n_runs, first({{'s': start, 'l': length, 'q': q}} order by length desc, start, q) as best,
    string_agg(start::varchar || ',' || length || ',' || q || chr(10), '' order by start, q) as listed
  from runs group by no
),
dropped as (
  select distinct no, unnest(range(start + q, start + length)) as i from runs
),
short as (
  select p.no, string_agg(p.word, ' ' order by p.i) as body
  from placed p anti join dropped d on p.no = d.no and p.i = d.i group by p.no
)
select d.doc_id, coalesce(r.n_runs, 0)::bigint as n_runs, r.best.s::bigint as start, r.best.l::bigint as length,
  r.best.q::bigint as period, (1000 * r.best.l // r.best.q)::bigint as exponent_milli,
  sha256(coalesce(r.listed, '')) as runs_sha256, sha256(coalesce(s.body, '')) as collapsed_sha256
from dealt d left join per_doc r on d.no = r.no left join short s on d.no = s.no
"""

MIDDLE = r"""
with drawn as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::varchar, '')) as hex from documents
),
cut as (
  select *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as units,
    list_transform([0, 1, 2, 3], lambda k: ('0x' || hex[1 + 8 * k:8 + 8 * k])::bigint) as h
  from drawn
),
formed as (
  select doc_id, text, units, len(units) as n,
    least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) as low,
    greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) as high,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain'
      when h[4] % 100 < 50 then 'spm' else 'psm' end as form
  from cut
),
parts as (
  select doc_id, text, n, form, coalesce(array_to_string(units[1:low], ''), '') as prefix,
    coalesce(array_to_string(units[low + 1:high], ''), '') as middle,
    coalesce(array_to_string(units[high + 1:n], ''), '') as suffix
  from formed
)
select doc_id, n::bigint as n, form,
  case when form <> 'plain' then length(prefix) end::bigint as prefix_chars,
  case when form <> 'plain' then length(middle) end::bigint as middle_chars,
  sha256(case form when 'plain' then text
    when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""

ORACLE: dict[str, str] = {
    "op1_sharding": SHARDING,
    "op4_mixing": MIXING,
    "op7_warc": WARC,
    "op8_top_k": TOP_K,
    "op9_jaccard": JACCARD,
    "op12_periodic_runs": PERIODS,
    "op13_fill_middle": MIDDLE,
}
