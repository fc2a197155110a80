"""DuckDB SQL of the corpus operators that SQL can express."""

#: crc32 of an ASCII string, bit by bit.
_CRC = (
    "xor(list_reduce(list_transform(range(1, length({0}) + 1), lambda i: cast(ascii(substr({0}, i, 1)) as bigint)), "
    "lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295), 4294967295)"
)


def _best(*ways: str) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda x: x is not null))"


def _way(frm: str, cost: str, letter: str, turn: str, when: str = "true") -> str:
    added = f"list_append({frm}.t, {turn})" if turn else f"{frm}.t"
    return f"case when {when} and {frm} is not null then struct_pack(c := cast({frm}.c + {cost} as bigint), l := {frm}.l || '{letter}', t := {added}) end"


_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_EXTRA = "if(fault = 3, 3, 0)"
_KEPT = "fault in (0, 3)"
_TURN = "role || ':' || text"


def _reached(state: str, initial: str, role: str | None, sources: str) -> str:
    ways = [_way(state, "4", "D", "")]
    for x in sources:
        ways.append(_way(x, _EXTRA, "K", _TURN, f"{_KEPT} and substr(role, 1, 1) = '{initial}'"))
        if role:
            ways.append(_way(x, f"3 + {_EXTRA}", "R", f"'{role}:' || text", _KEPT))
    return _best(*ways)


OP11 = f"""
with recursive named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name from conversations),
hits as (select conv_id, turn, role, text, {_CRC.format("name")} % 20 as hit from named),
damaged as (
  select conv_id, turn, case when hit = 4 then 'user' else role end as role, case when hit = 1 then '' when hit = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, copy
  from hits, unnest(case when hit = 3 then [0, 1] else [0] end) as c(copy) where hit <> 0),
placed as (
  select *, row_number() over w as k, lag(role) over w as earlier, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth, rtrim(text, {_SPACE}) as bare
  from damaged window w as (partition by conv_id order by turn nulls first, role, text, copy)),
marked as (select *, case when bare = '' then 1 when nth > 1 then 2 when right(bare, 1) not in ('.', '!', '?') then 3 else 0 end as fault from placed),
counts as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
    count(*) filter (earlier is not null and substr(earlier, 1, 1) || substr(role, 1, 1) not in ('su', 'ua', 'au')) as illegal
  from marked group by conv_id),
tops as (
  select conv_id, cast(0 as bigint) as k, struct_pack(c := cast(0 as bigint), l := '', t := cast([] as varchar[])) as b, cast(null as struct(c bigint, l varchar, t varchar[])) as s,
    struct_pack(c := cast(3 as bigint), l := 'I', t := ['user:']) as u, struct_pack(c := cast(6 as bigint), l := 'II', t := ['user:', 'assistant:']) as a
  from counts
  union all
  select conv_id, k, b, s, u, {_best("a", _way("u", "3", "I", "'assistant:'"))} as a from (
    select conv_id, k, b, s, a, {_best("u", *(_way(x, "3", "I", "'user:'") for x in "bsa"))} as u from (
      select p.conv_id, m.k, {_way("b", "4", "D", "")} as b, {_reached("s", "s", None, "b")} as s, {_reached("u", "u", "user", "bsa")} as u, {_reached("a", "a", "assistant", "u")} as a
      from tops p join marked m on m.conv_id is not distinct from p.conv_id and m.k = p.k + 1))),
ended as (select p.conv_id, list_min([b, a]) as best from tops p join counts n on n.conv_id is not distinct from p.conv_id and n.n = p.k)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(best.c, 0) as cost, coalesce(best.l, '') as audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts n on n.conv_id is not distinct from o.conv_id left join ended e on e.conv_id is not distinct from o.conv_id
"""


def _encoded(value: str) -> str:
    return f"coalesce(octet_length(encode(cast({value} as varchar))) || ':' || cast({value} as varchar), '-')"


_HEAD = " || ".join(_encoded(c) for c in ("doc_id", "source", "lang", "n_chars"))

OP12 = f"""
with recursive hashed as (
  select doc_id, source, sha256({_HEAD} || {_encoded("text")}) as leaf,
    case when {_CRC.format("cast(doc_id as varchar)")} % 2 = 0 then sha256({_HEAD} || {_encoded("replace(text, chr(10), '')")}) end as tampered
  from documents),
leaves as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, dense_rank() over (order by source nulls first) - 1 as g from hashed),
nodes as (
  select cast(0 as bigint) as level, g, i, leaf as h, count(*) over (partition by g) as n from leaves
  union all
  select level + 1, g, i // 3, sha256(string_agg(h, '' order by i)), (any_value(n) + 2) // 3 from nodes where n > 1 group by level, g, i // 3),
subroots as (select g, h from nodes where n = 1),
upper as (
  select cast(0 as bigint) as level, g as i, h, count(*) over () as n from subroots
  union all
  select level + 1, i // 3, sha256(string_agg(h, '' order by i)), (any_value(n) + 2) // 3 from upper where n > 1 group by level, i // 3),
roots as (select h from upper where n = 1),
lower_steps as (
  select l.g, l.i, n.level, coalesce(string_agg(n.h, '' order by n.i) filter (n.i < l.i // cast(3 ** n.level as bigint)), '') as before, coalesce(string_agg(n.h, '' order by n.i) filter (n.i > l.i // cast(3 ** n.level as bigint)), '') as behind
  from leaves l join nodes n on n.g = l.g and n.n > 1 and n.i // 3 = l.i // cast(3 ** (n.level + 1) as bigint) group by l.g, l.i, n.level),
upper_steps as (
  select s.g, n.level, coalesce(string_agg(n.h, '' order by n.i) filter (n.i < s.g // cast(3 ** n.level as bigint)), '') as before, coalesce(string_agg(n.h, '' order by n.i) filter (n.i > s.g // cast(3 ** n.level as bigint)), '') as behind
  from subroots s join upper n on n.n > 1 and n.i // 3 = s.g // cast(3 ** (n.level + 1) as bigint) group by s.g, n.level),
steps as (
  select g, i, before, behind, row_number() over (partition by g, i order by level) as k from (
    select g, i, level, before, behind from lower_steps union all select l.g, l.i, 1000 + u.level, u.before, u.behind from leaves l join upper_steps u on u.g = l.g)),
proofs as (select g, i, max(k) as last, sha256(string_agg(before || behind, '' order by k)) as proof from steps group by g, i),
fold as (
  select g, i, cast(0 as bigint) as k, coalesce(tampered, leaf) as h from leaves
  union all
  select f.g, f.i, s.k, sha256(s.before || f.h || s.behind) from fold f join steps s on s.g = f.g and s.i = f.i and s.k = f.k + 1)
select l.doc_id, l.leaf, s.h as subroot, r.h as root, coalesce(p.proof, sha256('')) as proof_sha256, f.h as folded_root, f.h = r.h as verified
from leaves l join subroots s on s.g = l.g cross join roots r left join proofs p on p.g = l.g and p.i = l.i join fold f on f.g = l.g and f.i = l.i and f.k = coalesce(p.last, 0)
"""

OP13 = """
with hashed as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
firsts as (select *, min(page_id) over (partition by payload_digest) as original from hashed)
select page_id, payload_bytes, payload_digest, case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to, true as whole
from (select *, case when payload_bytes >= 100 and original is not null and page_id is distinct from original then original end as refers_to from firsts)
"""

#: Runs of bytes other than ASCII white space; in DuckDB's pattern language.
_WORDS = r"regexp_extract_all({0}, '[^ \t\n\x0b\f\r]+')"

OP2 = f"""
with listed as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents where doc_id is not null),
words as (select doc_id, unnest(w) as word, unnest(range(len(w))) as pos from listed),
windows as (select doc_id, unnest(range(greatest(len(w) - 49, 0))) as pos, w from listed),
hashed as (select doc_id, pos, md5_number(array_to_string(w[pos + 1 : pos + 50], ' ')) as h from windows),
firsts as (select h, min(doc_id) as source from hashed group by h),
places as (select h, f.source, min(pos) as place from firsts f join hashed using (h) where doc_id = f.source group by h, f.source),
hits as (select doc_id, pos, source, place from hashed join places using (h) where source < doc_id),
factors as (
  select doc_id, count(*) as n_factors from (select *, lag(pos) over w as p, lag(source) over w as s, lag(place) over w as q from hits window w as (partition by doc_id order by pos))
  where p is null or pos <> p + 1 or source <> s or place <> q + 1 group by doc_id),
marked as (
  select doc_id, word, pos, coalesce(max(hit) over (partition by doc_id order by pos rows between 49 preceding and current row), 0) as gone
  from (select w.*, case when h.pos is not null then 1 end as hit from words w left join hits h on h.doc_id = w.doc_id and h.pos = w.pos)),
kept as (select doc_id, count(*) as n_words, cast(sum(gone) as bigint) as n_removed, sha256(coalesce(string_agg(word, ' ' order by pos) filter (gone = 0), '')) as kept_sha256 from marked group by doc_id)
select l.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, coalesce(kept_sha256, sha256('')) as kept_sha256, coalesce(n_factors, 0) as n_factors
from listed l left join kept using (doc_id) left join factors using (doc_id)
"""

OP5 = f"""
with recursive listed as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents where doc_id is not null),
shingles as (
  select distinct doc_id, array_to_string(w[i + 1 : i + 3], ' ') as s from (select doc_id, w, unnest(case when len(w) = 0 then cast([] as bigint[]) else range(greatest(len(w) - 2, 1)) end) as i from listed)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from shared s join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * s.n >= 90 * (a.n + b.n - s.n)),
both_ways as (select x, y from links union all select y, x from links),
reach as (select doc_id as x, doc_id as y from listed union select r.x, b.y from reach r join both_ways b on b.x = r.y)
select l.doc_id, coalesce(n, 0) as n_shingles, c.component_id from listed l left join sizes using (doc_id) join (select x as doc_id, min(y) as component_id from reach group by x) c using (doc_id)
"""

ORACLE_SQL = {"op2_substring_dedup": OP2, "op5_ngram_jaccard": OP5, "op11_conversation_repair": OP11, "op12_merkle_manifest": OP12, "op13_warc": OP13}
