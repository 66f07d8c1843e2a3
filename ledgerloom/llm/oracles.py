"""DuckDB SQL for the queries that SQL can express.

The others have a trained model, a numerical fit, disguised identifiers or a tokenizer in them; they are tested against
brute force or a library instead.
"""

_WORD = r"[^\x20\x09-\x0D]+"

_OP2 = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') w from documents),
s as (select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) end s from w),
n as (select doc_id, cast(len(s) as bigint) n from s),
x as (select doc_id, unnest(s) g from s),
p as (select a.doc_id a, b.doc_id b, count(*) c from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n m on m.doc_id = a join n o on o.doc_id = b where 100 * c >= 75 * (m.n + o.n - c)),
u as (select a, b from l union all select b, a from l),
r(d, m) as (select doc_id, doc_id from n union select r.d, u.b from r join u on u.a = r.m)
select doc_id, n n_shingles, m component_id from n join (select d, min(m) m from r group by 1) y on d = doc_id
"""

_OP3 = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') w from documents),
v as (select doc_id, s, array_to_string(w[s:s + 34], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 33)) s from w where len(w) >= 35) z),
d as (select g from v group by 1 having count(*) > 1),
c as (select distinct doc_id, unnest(range(s, s + 35)) j from v semi join d using (g)),
t as (select doc_id, unnest(range(1, len(w) + 1)) j, unnest(w) word from w),
k as (select t.doc_id, count(*) n_words, count(c.j) n_removed, coalesce(string_agg(word, ' ' order by t.j) filter (c.j is null), '') kept from t left join c on c.doc_id = t.doc_id and c.j = t.j group by 1)
select w.doc_id, coalesce(n_words, 0) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from w left join k using (doc_id)
"""

# the marks around a user's, an assistant's and any other text, and one backslash for each control string inside
_OP4 = r"""
with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
b as (select *, replace(t, '\', '') p, replace(r, '\', '') q from c),
e as (select *, length(t) + length(p) - length(regexp_replace(p, '<+', '<', 'g')) + length(p) - length(regexp_replace(p, '>+', '>', 'g')) + len(regexp_extract_all(p, '</?s>')) + len(regexp_extract_all(p, '\[/?INST\]')) body,
  length(r) + length(q) - length(regexp_replace(q, '<+', '<', 'g')) + length(q) - length(regexp_replace(q, '>+', '>', 'g')) + len(regexp_extract_all(q, '</?s>')) + len(regexp_extract_all(q, '\[/?INST\]')) head from b)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) turns_sha256, cast(coalesce(sum(length(t)) filter (r = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (r = 'assistant'), '')) loss_sha256, cast(sum(body + case r when 'user' then 18 when 'assistant' then 6 else head + 11 end) as bigint) formatted_chars
from e group by 1
"""

def _way(state: str, cost: str, letter: str) -> str:
    """A way (nine digits of cost, then the edits) and one more edit; null stays null, and least leaves it out."""
    return f"(lpad(cast(cast(left({state}, 9) as integer) + {cost} as varchar), 9, '0') || substr({state}, 10) || '{letter}')"


# crc32 from its polynomial; then the states of one row after the other, with insertions as in the operator (J and S edit to assistant)
_OP11 = rf"""
with recursive z as (select list(list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), i) order by i) z from range(256) q(i)),
k as (select conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') t, xor(list_reduce(list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda c: cast(ord(c) as bigint)), lambda c, b: xor(c >> 8, z[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 k from conversations, z),
d as (select conv_id, turn, case k when 4 then 'user' else r end r, case k when 1 then '' when 2 then regexp_replace(t, '[.!?]', '', 'g') else t end t, unnest(range(case k when 3 then 2 else 1 end)) from k where k <> 0),
h as (select conv_id, turn, r, t, row_number() over (partition by conv_id, r, t order by turn nulls first) again from d),
f as (select conv_id, turn, r, t, left(r, 1) i, row_number() over (partition by conv_id order by turn nulls first, r, t, again) n, case when not regexp_matches(t, '[^\x20\x09-\x0D]') then 'blank' when again > 1 then 'duplicate'
  when not regexp_matches(regexp_extract(t, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1), '[.!?]') then 'truncated' else '' end f from h),
g as (select *, coalesce(lag(i) over (partition by conv_id order by n) || i not in ('su', 'ua', 'au'), false) illegal from f),
c as (select conv_id, count(*) n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (f = 'blank') blank, count(*) filter (f = 'duplicate') duplicate, count(*) filter (f = 'truncated') truncated, count(*) filter (illegal) illegal from g group by 1),
w(conv_id, n, e, s, u, a) as (
  select distinct conv_id, cast(0 as bigint), '000000000', cast(null as varchar), '000000002I', '000000004IJ' from conversations
  union all
  select conv_id, n, e, s, v, least(a, {_way("v", "2", "J")}) from (select *, least(u, {_way("e", "2", "I")}, {_way("s", "2", "I")}, {_way("a", "2", "I")}) v from (
    select w.conv_id, f.n, {_way("e", "3", "D")} e, least({_way("s", "3", "D")}, case when ok and i = 's' then {_way("e", "x", "K")} end) s,
      least({_way("u", "3", "D")}, case when ok and i = 'u' then least({_way("e", "x", "K")}, {_way("s", "x", "K")}, {_way("a", "x", "K")}) end, case when ok then least({_way("e", "2 + x", "R")}, {_way("s", "2 + x", "R")}, {_way("a", "2 + x", "R")}) end) u,
      least({_way("a", "3", "D")}, case when ok and i = 'a' then {_way("u", "x", "K")} end, case when ok then {_way("u", "2 + x", "S")} end) a
    from w join (select *, f not in ('blank', 'duplicate') ok, case f when 'truncated' then 1 else 0 end x from f) f on f.conv_id is not distinct from w.conv_id and f.n = w.n + 1) y) y),
b as (select w.conv_id, least(e, a) b, gaps, blank, duplicate, truncated, illegal from w left join c on c.conv_id is not distinct from w.conv_id where w.n = coalesce(c.n, 0)),
m as (select conv_id, unnest(m) m, unnest(range(1, len(m) + 1)) n from (select conv_id, regexp_extract_all(substr(b, 10), '[IJ]*[DKRS]') m from b) y),
o as (select m.conv_id, m.n, replace(replace(left(m, length(m) - 1), 'I', 'user:' || chr(10)), 'J', 'assistant:' || chr(10)) || case right(m, 1) when 'K' then r || ':' || t || chr(10) when 'R' then 'user:' || t || chr(10) when 'S' then 'assistant:' || t || chr(10) else '' end o from m join f on f.conv_id is not distinct from m.conv_id and f.n = m.n),
j as (select conv_id, string_agg(o, '' order by n) j from o group by 1)
select b.conv_id, cast(coalesce(gaps, 0) as bigint) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, cast(left(b, 9) as bigint) cost, translate(substr(b, 10), 'JS', 'IR') audit,
  sha256(regexp_replace(coalesce(j, '') || replace(replace(regexp_extract(b, '[IJ]*$'), 'I', 'user:' || chr(10)), 'J', 'assistant:' || chr(10)), '\n\z', '')) repaired_sha256
from b left join j on j.conv_id is not distinct from b.conv_id
"""

_OP13 = """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id a, b.vec_id b, a.label = b.label same, cast(list_inner_product(a.v, b.v) as bigint) s from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select a, b p, s ps from (select *, row_number() over (partition by a order by s desc, b) k from s where same) y where k <= 5),
n as (select p.a, p, b, ps, s, row_number() over (partition by p.a, p order by s desc, b) k from p join s on s.a = p.a and not same and 30 * ps <= 100 * s and 100 * s <= 90 * ps)
select a anchor_id, p positive_id, cast(k as integer) rank, b negative_id, ps positive_score, s negative_score from n where k <= 10
"""

ORACLES: dict[str, str] = {"op2_ngram_jaccard": _OP2, "op3_substring_dedup": _OP3, "op4_chat_tree": _OP4, "op11_conversation_repair": _OP11, "op13_hard_negatives": _OP13}
