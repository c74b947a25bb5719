"""One query per operator, with production parameters, over its whole table; SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fundloom.llm import mixing
from fundloom.llm.shared import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fundloom.llm.simhash import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fundloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fundloom.llm.sketch import fingerprint

    return fingerprint(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fundloom.llm.warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fundloom.llm.chat import format_chats

    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return format_chats(rows.unionByName(own))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fundloom.llm.media import media_features

    return media_features(table(spark, sf_dir, "documents"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fundloom.llm.substring import span_dedup

    return span_dedup(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fundloom.llm.quality import select_quality

    return select_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fundloom.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fundloom.llm.suffixtree import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fundloom.llm.repair import repair_damaged

    return repair_damaged(table(spark, sf_dir, "conversations"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fundloom.llm.trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_packing": op2_packing,
    "op3_sketch": op3_sketch,
    "op4_warc": op4_warc,
    "op5_mixing": op5_mixing,
    "op6_chat": op6_chat,
    "op7_media": op7_media,
    "op8_substring": op8_substring,
    "op9_quality": op9_quality,
    "op10_licenses": op10_licenses,
    "op11_score": op11_score,
    "op12_repair": op12_repair,
    "op13_trie": op13_trie,
}

#: Of payloads of 1,000 bytes or more that are equal, the largest page_id is the response.
_OP4 = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
sized as (select page_id, cast(octet_length(payload) as bigint) as payload_bytes, sha1(payload) as payload_digest from p),
marked as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest, payload_bytes) end as top from sized)
select page_id, payload_bytes, payload_digest, case when top <> page_id then 'revisit' else 'response' end as record_type, case when top <> page_id then top end as refers_to from marked"""

_ESCAPED = r"""regexp_replace(regexp_replace({}, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g')"""
_OP6 = f"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, t, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(t, r)),
told as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, role, text) as turns,
    coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls last, role, text), '') as loss,
    cast(sum(length('<s>[INST] ' || {_ESCAPED.format("role")} || ' [/INST]' || {_ESCAPED.format("text")} || '</s>')) as bigint) as formatted_chars
  from said group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, formatted_chars from told"""

#: A word goes if it is in a window of 50 words that also starts in a document with a smaller id.
_OP8 = r"""
with lists as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as l from documents),
words as (select doc_id, unnest(l) as word, unnest(range(len(l))) as p from lists),
windows as (
  select doc_id, p, md5(string_agg(word, ' ') over f) as k, count(*) over f as n
  from words window f as (partition by doc_id order by p rows between current row and 49 following)),
first as (select k, min(doc_id) as first_id from windows where n = 50 group by k),
gone as (select distinct doc_id, unnest(range(p, p + 50)) as p from windows join first using (k) where n = 50 and first_id < doc_id),
left_over as (
  select words.doc_id, count(gone.p) as n_removed, string_agg(word, ' ' order by words.p) filter (where gone.p is null) as kept
  from words left join gone on gone.doc_id = words.doc_id and gone.p = words.p group by words.doc_id)
select lists.doc_id, cast(len(l) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from lists left join left_over on left_over.doc_id = lists.doc_id"""

#: The CRC-32 of a short text, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda c: ascii(c)::bigint)),
    lambda crc, c: list_reduce(list_prepend(xor(crc, c), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, z: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint)"""

#: The cheapest repairs of the first k rows for each state (0 nothing, 1 system, 2 user, 3 assistant), one row further each time; up to two turns are put in before it.
_OP12 = rf"""
with recursive given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
hit as (select *, {_CRC.format("k")} % 20 as h from given),
damaged as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role, case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from hit, unnest(case when h = 3 then [0, 1] else [0] end) c(copy) where h <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as nth from damaged),
said as (
  select *, row_number() over (partition by conv_id, role, text order by nth) as times, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare,
    lag(left(role, 1)) over (partition by conv_id order by nth) as initial_before from placed),
told as (
  select *, left(role, 1) as initial, case when ltrim(bare, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' then 1 when times > 1 then 2 when right(bare, 1) not in ('.', '!', '?') then 3 else 0 end as fault from said),
edges(before, letters, behind, paid, made) as (
  values (0, '', 0, 0, ''), (1, '', 1, 0, ''), (2, '', 2, 0, ''), (3, '', 3, 0, ''),
    (0, 'I', 2, 2, chr(10) || 'user:'), (1, 'I', 2, 2, chr(10) || 'user:'), (2, 'I', 3, 2, chr(10) || 'assistant:'), (3, 'I', 2, 2, chr(10) || 'user:'),
    (0, 'II', 3, 4, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 'II', 3, 4, chr(10) || 'user:' || chr(10) || 'assistant:')),
best as (
  select conv_id, 0::bigint as nth, 0 as state, {{'cost': 0::bigint, 'audit': '', 'made': ''}} as r from (select distinct conv_id from damaged)
  union all
  select conv_id, nth, state, min(r) as r from (
    select b.conv_id, t.nth, o.state, {{'cost': b.r.cost + e.paid + o.paid, 'audit': b.r.audit || e.letters || o.letter, 'made': b.r.made || e.made || o.made}} as r
    from best b join told t on t.conv_id is not distinct from b.conv_id and t.nth = b.nth + 1 join edges e on e.before = b.state,
      lateral (
        select 'D' as letter, e.behind as state, 3 as paid, '' as made
        union all select 'K', case t.initial when 's' then 1 when 'u' then 2 else 3 end, cast(t.fault = 3 as int), chr(10) || t.role || ':' || t.text
          where t.fault not in (1, 2) and ((t.initial = 's' and e.behind = 0) or (t.initial = 'u' and e.behind <> 2) or (t.initial = 'a' and e.behind = 2))
        union all select 'R', case e.behind when 2 then 3 else 2 end, 2 + cast(t.fault = 3 as int), chr(10) || case e.behind when 2 then 'assistant:' else 'user:' end || t.text where t.fault not in (1, 2)) o) x
  group by conv_id, nth, state),
sizes as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 1) as blank, count(*) filter (where fault = 2) as duplicate, count(*) filter (where fault = 3) as truncated,
    count(*) filter (where nth > 1 and initial_before || initial not in ('su', 'ua', 'au')) as illegal from told group by conv_id),
final as (
  select b.conv_id, min({{'cost': b.r.cost + e.paid, 'audit': b.r.audit || e.letters, 'made': b.r.made || e.made}}) as r
  from best b join sizes s on s.conv_id is not distinct from b.conv_id and s.n = b.nth join edges e on e.before = b.state where e.behind in (0, 3) group by b.conv_id)
select g.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(f.r.cost, 0) as cost, coalesce(f.r.audit, '') as audit, sha256(coalesce(substr(f.r.made, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) g left join sizes s on s.conv_id is not distinct from g.conv_id left join final f on f.conv_id is not distinct from g.conv_id"""

#: Every node by the digests of its turns, as a text; what is below it by its beginning.
_OP13 = rf"""
with turns as (
  select conv_id, sha256(coalesce(role, '') || chr(0) || coalesce(text, '')) as d, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as w,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as nth from conversations where conv_id is not null),
convs as (select conv_id, conv_id - conv_id % 20 as base, {_CRC.format("cast(conv_id as varchar)")} % 4 as h from (select distinct conv_id from conversations where conv_id is not null)),
made as (
  select c.conv_id, t.nth, 0 as own, d, w from convs c join turns t on t.conv_id = c.base and t.nth <= c.h
  union all select c.conv_id, t.nth, 1, d, w from convs c join turns t on t.conv_id = c.conv_id and t.nth > c.h),
lists as (select conv_id, list(d order by own, nth) as ds, list(w order by own, nth) as ws from made group by conv_id),
whole as (select convs.conv_id, coalesce(ds, []) as ds, coalesce(ws, []) as ws from convs left join lists on lists.conv_id = convs.conv_id),
stops as (select conv_id, k as depth, array_to_string(ds[1:k], '') as p, array_to_string(ds[1 : k - 1], '') as up, case when k = 0 then 0 else ws[k] end as w, len(ds) = k as ends from whole, unnest(range(len(ds) + 1)) r(k)),
nodes as (
  select p, depth, case when depth > 0 then any_value(up) end as up, min(conv_id) as conv_id, count(*) as n_convs, any_value(w) as w, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from stops group by p, depth),
below as (select up, count(*) as n_children from nodes where up is not null group by up),
known as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join below b on b.up = n.p),
sums as (
  select a.p, sum(cast(z.n_children = 0 as bigint))::bigint as n_leaves, sum((z.n_convs - 1) * z.w)::bigint as saved_tokens
  from (select distinct s.p, array_to_string(w.ds[1:k], '') as top from stops s join whole w using (conv_id), unnest(range(s.depth + 1)) r(k)) x join known z on z.p = x.p join known a on a.p = x.top group by a.p)
select k.conv_id, cast(k.depth as bigint) as depth, u.conv_id as parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, k.ends_sha256
from known k join sums using (p) left join known u on u.p = k.up"""

SQL: dict[str, str] = {"op4_warc": _OP4, "op5_mixing": mixing.SQL, "op6_chat": _OP6, "op8_substring": _OP8, "op12_repair": _OP12, "op13_trie": _OP13}
