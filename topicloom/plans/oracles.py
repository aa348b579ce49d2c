"""DuckDB SQL for the queries that SQL can express, written independently of the Spark plans."""

from __future__ import annotations

from ..functions.words import DEFAULT, SUFFIXES
from . import queries as q


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _values(rows, name: str) -> str:
    return f"(select * from (values {', '.join(f'({i}, ' + chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) + ')' for i, v in enumerate(rows))}) t(id, {name}))"


STOP = f"[{_list(DEFAULT.stop)}]"
ITEMS = """items as (select item_id, conv_id, turn, prompt, response from (
  select conv_id * 100000 + turn as item_id, conv_id, turn, role, text as prompt,
    case when lead(role) over (partition by conv_id order by turn) = 'assistant' then lead(text) over (partition by conv_id order by turn) end as response
  from conversations) where role = 'user'),
N as (select count(*) as n from items)"""
IC = ITEMS + """,
ic as (select item_id, concept, max(p) as in_prompt from (
  select item_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(prompt, '')), '[a-z]{2,}'))) as concept, 1 as p from items
  union all select item_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(response, '')), '[a-z]{2,}'))), 0 from items) group by item_id, concept)"""


def _reason(c: str, is_prompt: str) -> str:
    x = f"trim(lower({c}))"
    w = f"string_split({x}, ' ')"
    return f"""case when len({x}) < 3 or len(replace({x}, ' ', '')) < 2 then 'short'
  when regexp_matches(regexp_replace({x}, '[ .-]', '', 'g'), '^[0-9]+$') then 'number'
  when len({w}) = 1 and {x} in ({_list(DEFAULT.names)}) then 'person_name'
  when len({w}) = 2 and {w}[1] in ({_list(DEFAULT.names)}) and {w}[2] not in ({_list(DEFAULT.names)}) and len({w}[2]) <= 10 and not regexp_matches({w}[2], '({'|'.join(SUFFIXES)})$') then 'person_name'
  when {x} in ({_list(DEFAULT.filler)}) then 'llm_filler'
  when {' or '.join(f"regexp_matches({x}, '{p}')" for p in DEFAULT.filler_patterns)} then 'llm_filler'
  when len({w}) = 1 and {x} in ({_list(DEFAULT.noise)}) then 'noise'
  when not {is_prompt} and len({w}) = 1 and {x} in ({_list(DEFAULT.geo)}) then 'geo_noise' end"""


def _reason_strict(c: str, is_prompt: str) -> str:
    x = f"trim(lower({c}))"
    w = f"string_split({x}, ' ')"
    return f"""case when len({w}) <= 2 and {w}[1] in ({_list(DEFAULT.names)}) then 'person_name'
  when len({w}) = 1 and {x} in ({_list(DEFAULT.fiction)}) then 'fiction'
  when {x} in ({_list(DEFAULT.filler)}) or {' or '.join(f"regexp_matches({x}, '{p}')" for p in DEFAULT.strict_patterns)} then 'llm_filler'
  when not {is_prompt} and len({w}) = 1 and {x} in ({_list(DEFAULT.geo)}) then 'geo_noise'
  when len({x}) < 3 or regexp_matches(regexp_replace({x}, '[ .-]', '', 'g'), '^[0-9]+$') or (len({w}) = 1 and {x} in ({_list(DEFAULT.noise)})) then 'low_quality' end"""


def _kept(strict: bool = False) -> str:
    return f"f as (select * from ic where ({(_reason_strict if strict else _reason)('concept', '(in_prompt = 1)')}) is null)"


def _weights(max_df_pct: float = 0.08) -> str:
    return f"""{IC}, {_kept()},
idf as (select concept, count(*) as df, ln(cast((select n from N) as double) / count(*)) as idf from f group by concept),
ok as (select * from idf where df >= 3 and df <= floor((select n from N) * cast({max_df_pct} as double)) and idf >= cast(0.5 as double)),
sc as (select item_id, concept, in_prompt, idf * (case when in_prompt = 1 then 3.0::double else 1.0::double end) as score from f join ok using (concept)),
tk as (select * from (select *, row_number() over (partition by item_id order by score desc, concept) as r from sc) where r <= 30),
w as (select item_id, concept, in_prompt, round(score / sum(score) over (partition by item_id), 6) as weight from tk)"""


def _assoc(top: int, floor: str, min_freq: int, log: str) -> str:
    return f"""fr as (select concept, count(*) as f from w group by concept),
co as (select x.concept, y.concept as associate, count(*) as n from w x join w y using (item_id) where x.concept <> y.concept group by x.concept, y.concept),
pm as (select co.concept, co.associate, {log}(co.n * cast((select n from N) as double) / (a.f * b.f) + 1e-10::double) as pmi
  from co join fr a on co.concept = a.concept join fr b on co.associate = b.concept where a.f >= {min_freq}),
aso as (select * from (select *, cast(row_number() over (partition by concept order by round(pmi, 9) desc, associate) as int) as rank from pm where pmi {floor}) where rank <= {top})"""


TFIDF = f"""wd as (select item_id, list_filter(regexp_extract_all(lower(coalesce(prompt, '')), '[a-z]{{2,}}'), lambda x: not list_contains({STOP}, x)) as w from items),
tm as (select item_id, unnest(w) as term from wd union all
  select item_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from wd),
tf as (select item_id, term, count(*) as tf from tm group by item_id, term),
vc as (select * from (select term, count(*) as df, sum(tf) as total from tf group by term) where df >= 3 and df <= floor((select n from N) * cast(0.08 as double)) order by total desc, term limit 5000),
tr as (select item_id, term as dim, (1 + ln(cast(tf as double))) * (ln((1.0::double + (select n from N)) / (1 + df)) + 1) as v from tf join vc using (term)),
tv as (select item_id, dim, v / sqrt(sum(v * v) over (partition by item_id)) as v from tr)"""
CV = "cv as (select item_id, concept as dim, weight / sqrt(sum(weight * weight) over (partition by item_id)) as v from w)"
EMB = "em as (select vec_id as item_id, cast(embedding as double[]) as v from embeddings)"
LONG = EMB + ", lg as (select item_id, unnest(range(0, len(v)))::varchar as dim, unnest(v) as v from em)"
TRUTH = "truth as (select vec_id as item_id, cast(label as varchar) as label from embeddings)"
LAB = "lab as (select vec_id as item_id, vec_id % 7 as cluster_id from embeddings)"
START = "st as (select vec_id as item_id, cast(case when vec_id % 3 = 0 then label else vec_id + 100 end as bigint) as cluster_id from embeddings)"


def _knn(k: int) -> str:
    return f"""{EMB}, kn as (select * from (select a.item_id as i, b.item_id as j, list_inner_product(a.v, b.v) as sim,
  cast(row_number() over (partition by a.item_id order by list_inner_product(a.v, b.v) desc, b.item_id) as int) as rank
  from em a join em b on a.item_id <> b.item_id) where rank <= {k})"""


def _edges(sigma: float = q.SIGMA, k: int = 10) -> str:
    return f"{_knn(k)}, ed as (select least(i, j) as src, greatest(i, j) as dst, sum(sim) as weight from kn where sim >= cast({sigma} as double) group by 1, 2), sy as (select src, dst, weight from ed union all select dst, src, weight from ed)"


def _round(n: int, before: str, threshold: float) -> str:
    """CTEs of one cascade round: from labels ``before`` to labels ``l<n>``."""
    return f"""
z{n} as (select cluster_id, count(*) as size from {before} group by cluster_id),
m{n} as (select cluster_id, dim, sum(v) / max(size) as v from lg join {before} using (item_id) join z{n} using (cluster_id) where size > 1 group by cluster_id, dim),
c{n} as (select cluster_id, dim, v / (case when sum(v * v) over (partition by cluster_id) > 0 then sqrt(sum(v * v) over (partition by cluster_id)) else 1 end) as v from m{n}),
s{n} as (select item_id, c.cluster_id as t, round(sum(lg.v * c.v), 9) as sim from lg join {before} b using (item_id) join z{n} z on b.cluster_id = z.cluster_id and z.size = 1 join c{n} c using (dim) group by item_id, c.cluster_id),
b{n} as (select item_id, t from (select *, row_number() over (partition by item_id order by sim desc, t) as r from s{n}) where r = 1 and sim >= cast({threshold} as double)),
l{n} as (select item_id, coalesce(t, cluster_id) as cluster_id from {before} left join b{n} using (item_id))"""


def _cascade() -> str:
    from ..operators.cascade import THRESHOLDS

    return ",".join(_round(n, "st" if n == 1 else f"l{n - 1}", t) for n, t in enumerate(THRESHOLDS, 1))


def _metrics(labels: str) -> str:
    return f"""select cast(sum(size) as bigint) as n, count(*) as k, count(*) filter (where size > 1) as n_real, count(*) filter (where size = 1) as singletons,
  round(1 - count(*) filter (where size = 1) / cast(sum(size) as double), 6) as coverage, round(max(size) / cast(sum(size) as double), 6) as largest_pct,
  round(exp(-sum(p * ln(p + 1e-12::double))), 4) as effective_k
  from (select size, size / cast(sum(size) over () as double) as p from (select count(*) as size from {labels} group by cluster_id))"""


def _nmi(labels: str, truth: str, least: int = 10) -> str:
    return f"""nt as (select cluster_id, label, cast(count(*) as double) as n from {labels} join {truth} using (item_id) group by all),
na as (select cluster_id, sum(n) as a from nt group by 1), nb as (select label, sum(n) as b from nt group by 1), nn as (select sum(n) as t from nt),
ag as (select (select sum(n / t * ln(t * n / (a * b))) from nt join na using (cluster_id) join nb using (label), nn) as mi,
  (select -sum(a / t * ln(a / t)) from na, nn) as ha, (select -sum(b / t * ln(b / t)) from nb, nn) as hb,
  (select sum(n * (n - 1) / 2) from nt) as bth, (select sum(a * (a - 1) / 2) from na) as pa, (select sum(b * (b - 1) / 2) from nb) as pb, (select t from nn) as t),
nm as (select cast(t as bigint) as matched, case when t >= {least} then round(mi / ((ha + hb) / 2), 4) end as nmi,
  case when t >= {least} then round((bth - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 4) end as ari from ag)"""


RATERS = "ra as (select cast(quality as int) as a, cast(1 - toxic as int) as b from labels)"
SCORES = """sco as (select source as method, avg(len(text)) as x, avg(cast(len(string_split(text, chr(10))) as double)) as y,
  case when substr(source, len(source), 1) in ('0', '2', '4', '6', '8') then 'even' else 'odd' end as type from documents group by source)"""
ITEM_LAB = "il as (select item_id, conv_id % 5 as cluster_id from items)"
CONCEPT_LAB = "cl as (select distinct concept, case when substr(concept, 1, 1) < 'm' then 'a:' || substr(concept, 1, 1) when substr(concept, 1, 1) < 'x' then 'm:' || substr(concept, 1, 1) else 'unknown' end as label from w)"
RUNS = "ru as (select 'a' as run, vec_id as item_id, label::bigint as cluster_id from embeddings union all select 'b', vec_id, vec_id % 4 from embeddings union all select 'c', vec_id, vec_id % 6 from embeddings)"
RESULTS = "rs as (select 'r' || o_orderkey as run, o_orderpriority as family, o_orderstatus as algorithm, round(o_totalprice, 2) as bal from orders)"


def _sample(seed: int, col: str) -> str:
    return f"md5('{seed}:' || {col})"


def _drawn(seed: int, col: str) -> str:
    return f"cast('0x' || substr({_sample(seed, col)}, 1, 8) as bigint)"


KAPPA = """, o as (select count(*) as n, avg((a = b)::int::double) as po from ra), e as (select sum(x.n * y.n) / cast((select n * n from o) as double) as pe from (select a as k, count(*) as n from ra group by 1) x join (select b as k, count(*) as n from ra group by 1) y using (k)), k as (select n, po, case when pe >= 1 then 1.0 else (po - pe) / (1 - pe) end as kappa from o, e) select n, round(po, 6) as accuracy, round(kappa, 6) as kappa, case when kappa >= 0.81 then 'almost perfect' when kappa >= 0.61 then 'substantial' when kappa >= 0.41 then 'moderate' when kappa >= 0.21 then 'fair' else 'slight' end as band from k"""


def _turned(values, by: str) -> str:
    return f"[{_list(values)}][cast({by} % {len(values)} as int) + 1]"


TURNS = "(select conv_id * 100000 + turn as id, coalesce(text, '') as text from conversations) u"
ANSWERS = f"select id, {_turned(q.HEADS, 'id')} || {_turned(q.SPELLINGS, '(id // 3)')} || {_turned(q.TAILS, '(id // 7)')} || text as answer from {TURNS} union all select -1 - id, answer from {_values(q.ANSWERS, 'answer')} y"
VERDICTS = f"select id, {_turned(q.VERDICTS, 'id')} || ' ' || {_turned(q.SPELLINGS, '(id // 3)')} || chr(10) || text as answer from {TURNS} union all select -1 - id, answer from {_values(q.VERDICTS, 'answer')} y"
JSONS = f"""select vec_id as id, '"v' || vec_id || '": "' || {_turned(q.CATEGORIES, 'vec_id')} || '" "also": "music"' as answer from embeddings union all select -1 - id, answer from {_values(q.JSONS, 'answer')} y"""


def _rule(concept: str) -> str:
    return f"[{_list(q.CATEGORIES)}][cast(list_sum(list_transform(string_split({concept}, ''), lambda c: unicode(c))) % {len(q.CATEGORIES)} as int) + 1]"


def _poisson(seed: int, *columns: str) -> str:
    """A Poisson variable of mean 1 from a hashed uniform."""
    from ..operators.evaluate import POISSON

    key = " || ':' || ".join(columns)
    u = f"cast('0x' || substr(md5('{seed}:' || {key}), 1, 8) as bigint) / 4294967296.0::double"
    return f"list_sum(list_transform([{', '.join(f'{p!r}::double' for p in POISSON)}], lambda p: ({u} >= p)::int))"


def oracle_sql() -> dict[str, str]:
    w, d = _weights(), {}
    d["items_build"] = f"with {ITEMS} select item_id, conv_id, turn, cast(len(prompt) as int) as prompt_chars, cast(len(response) as int) as response_chars from items"
    d["concept_drop_reason"] = f"with {ITEMS}, {TFIDF}, cc as (select term as concept from tm union select concept from {_values(q.CASES, 'concept')} x) select concept, is_prompt, {_reason('concept', 'is_prompt')} as relaxed, {_reason_strict('concept', 'is_prompt')} as strict from cc, (values (true), (false)) b(is_prompt)"
    d["drop_reason_counts"] = f"with {IC} select coalesce({_reason('concept', '(in_prompt = 1)')}, 'kept') as drop_reason, count(*) as n from ic group by 1"
    d["prompt_words"] = f"with {ITEMS} select item_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(coalesce(prompt, '')), '[a-z]{{2,}}')), lambda x: not list_contains({STOP}, x))), ' ') as words from items"
    d["concept_df_idf"] = f"with {IC}, {_kept()} select concept, count(*) as df, round(ln(cast((select n from N) as double) / count(*)), 6) as idf from f group by concept"
    d["concept_weights"] = f"with {w} select item_id, concept, in_prompt, weight from w"
    words = f"pw as (select item_id, unnest(list_filter(list_distinct(regexp_extract_all(lower(coalesce(prompt, '')), '[a-z]{{2,}}')), lambda x: not list_contains({STOP}, x))) as word from items)"

    def ppmi(joint: int) -> str:
        return f"""{IC}, {_kept(True)}, {words}, cw as (select word, count(*) as cw from pw group by 1), rc as (select item_id, concept from f where in_prompt = 0), cc as (select concept, count(*) as cc from rc group by 1),
jt as (select word, concept, count(*) as joint from pw join rc using (item_id) group by 1, 2 having count(*) >= {joint}),
pp as (select * from (select word, concept, joint, log2(joint * cast((select n from N) as double) / (cw * cc)) as ppmi from jt join cw using (word) join cc using (concept)) where ppmi > 0)"""

    d["ppmi_prompt_response"] = f"with {ppmi(3)} select word, concept, joint, round(ppmi, 6) as ppmi from pp"
    d["concept_weights_strict"] = f"""with {ppmi(1)},
idf as (select concept, count(*) as df, ln(cast((select n from N) as double) / count(*)) as idf from f group by concept),
ok as (select * from idf where df >= 3 and df <= floor((select n from N) * cast(0.03 as double)) and idf >= cast(1.5 as double)),
bs as (select item_id, concept, max(ppmi) as pmi from pw join pp using (word) group by 1, 2),
sc as (select f.item_id, f.concept, f.in_prompt, case when f.in_prompt = 1 then idf * 3.0::double
  when pw.word is not null then greatest(coalesce(pmi, 0.0::double), 0.5::double) * idf * 2 when coalesce(pmi, 0.0::double) > 0 then pmi * idf end as score
  from f join ok using (concept) left join bs on f.item_id = bs.item_id and f.concept = bs.concept left join pw on f.item_id = pw.item_id and f.concept = pw.word),
tk as (select * from (select *, row_number() over (partition by item_id order by score desc, concept) as r from sc where score is not null) where r <= 15)
select item_id, concept, in_prompt, round(score / sum(score) over (partition by item_id), 6) as weight from tk"""

    def donor(w: str) -> str:
        return f"""{w}, nc as (select item_id, conv_id, coalesce(n, 0) as n from items left join (select item_id, count(*) as n from w group by 1) using (item_id)),
dn as (select conv_id, item_id as donor_id, n from (select *, row_number() over (partition by conv_id order by n desc, item_id) as r, count(*) over (partition by conv_id) as z from nc) where r = 1 and z >= 2 and n >= 3)"""

    d["conv_donor"] = f"with {donor(w)} select conv_id, donor_id, n from dn"
    d["conv_propagate"] = f"""with {donor(_weights(0.02))}, po as (select item_id, donor_id from nc join dn using (conv_id) where item_id <> donor_id and nc.n < 3),
nw as (select po.item_id, g.concept, round(g.weight * 0.5::double + 1e-9::double, 6) as weight from po join w g on g.item_id = po.donor_id where not exists (select 1 from w o where o.item_id = po.item_id and o.concept = g.concept)),
al as (select item_id, concept, weight from w where item_id in (select item_id from nw) union all select * from nw),
tp as (select * from (select *, row_number() over (partition by item_id order by weight desc, concept) as r2 from al) where r2 <= 30)
select item_id, concept, weight from w where item_id not in (select item_id from nw) union all select item_id, concept, round(weight / sum(weight) over (partition by item_id), 6) from tp"""
    d["cooccurrence"] = f"with {w} select x.concept as a, y.concept as b, count(*) as n from w x join w y using (item_id) where x.concept < y.concept group by 1, 2 having count(*) >= 2"
    d["pmi_topk"] = f"with {w}, {_assoc(20, '>= 1', 3, 'ln')} select concept, associate, round(pmi, 6) as pmi, rank from aso"
    d["pmi_densify"] = f"""with {w}, {_assoc(20, '>= 1', 3, 'ln')}, nw as (select w.item_id, associate as concept, max(round(weight * 0.3::double * least(pmi / 3, 1.0::double) + 1e-9::double, 6)) as weight from w join aso using (concept) group by 1, 2),
nx as (select * from (select *, row_number() over (partition by item_id order by weight desc, concept) as r from nw where not exists (select 1 from w o where o.item_id = nw.item_id and o.concept = nw.concept)) where r <= 20),
al as (select item_id, concept, weight from w union all select item_id, concept, weight from nx) select item_id, concept, round(weight / sum(weight) over (partition by item_id), 6) as weight from al"""
    d["pmi_ablation"] = f"""with {w}, {_assoc(35, '> 0', 1, 'log2')} select item_id, concept, round(max(weight), 6) as weight from (select item_id, concept, weight from w
union all select item_id, associate, weight * 0.3::double * pmi / 10 from w join aso using (concept)) group by 1, 2"""
    d["concept_vectors_l2"] = f"with {w}, {CV} select item_id, dim, round(v, 6) as v from cv"
    d["tfidf_vectors"] = f"with {ITEMS}, {TFIDF} select item_id, dim, round(v, 6) as v from tv"
    d["bow_counts"] = f"""with {ITEMS}, tf as (select item_id, term, count(*) as tf from (select item_id, unnest(list_filter(regexp_extract_all(lower(coalesce(prompt, '')), '[a-z]{{2,}}'), lambda x: not list_contains({STOP}, x))) as term from items) group by 1, 2),
vc as (select term from (select term, count(*) as df, sum(tf) as total from tf group by term) where df >= 3 and df <= floor((select n from N) * cast(0.1 as double)) order by total desc, term limit 20000) select item_id, term, tf from tf join vc using (term)"""
    d["hybrid_vectors"] = f"with {w}, {CV}, {TFIDF}, hy as (select item_id, 'c:' || dim as dim, v * 0.8::double as v from cv union all select item_id, 't:' || dim, v * (1 - 0.8::double) from tv) select item_id, dim, round(v / sqrt(sum(v * v) over (partition by item_id)), 6) as v from hy"
    d["knn_dense"] = f"with {_knn(30)} select i, j, round(sim, 6) as sim, rank from kn"
    d["knn_sparse"] = f"""with {w}, {CV}, vr as (select item_id, dim, round(v, 6) as v from cv), sm as (select a.item_id as i, b.item_id as j, sum(a.v * b.v) as sim from vr a join vr b using (dim) where a.item_id <> b.item_id group by 1, 2),
tp as (select i, round(sim, 6) as sim from (select *, row_number() over (partition by i order by sim desc, j) as r from sm) where r <= 10) select i, count(*) as n, round(sum(sim), 3) as total, round(max(sim), 5) as best from tp group by i"""
    d["knn_edges"] = f"with {_edges()} select src, dst, round(weight, 6) as weight from ed"
    d["knn_min_shared"] = f"with {w}, {CV} select a.item_id as src, b.item_id as dst, count(*) as shared, round(sum(a.v * b.v), 5) as weight from cv a join cv b on a.dim = b.dim and a.item_id < b.item_id group by 1, 2 having sum(a.v * b.v) >= 0.05::double and count(*) >= 2"
    d["isolated_nodes"] = f"with {_edges(0.33)} select item_id from em where item_id not in (select src from sy)"
    d["graph_degrees"] = f"with {_edges()} select src as item_id, count(*) as degree, round(sum(weight), 5) as strength from sy group by 1"
    d["components"] = f"with recursive {_edges(0.3)}, rc as (select item_id, item_id as r from em union select rc.item_id, sy.dst from rc join sy on rc.r = sy.src) select item_id, min(r) as cluster_id from rc group by 1"
    votes = lambda n, b: f"v{n} as (select src, cluster_id, round(sum(weight), 9) as w from sy join {b} on sy.dst = {b}.item_id group by 1, 2), p{n} as (select {b}.item_id, coalesce(x.c, {b}.cluster_id) as cluster_id from {b} left join (select src, cluster_id as c from (select *, row_number() over (partition by src order by w desc, cluster_id) as r from v{n}) where r = 1) x on x.src = {b}.item_id)"
    d["label_propagation"] = f"with {_edges()}, p0 as (select item_id, item_id as cluster_id from em), {votes(1, 'p0')}, {votes(2, 'p1')}, {votes(3, 'p2')} select item_id, cluster_id from p3"
    d["modularity_of_labels"] = f"with {_edges()}, {LAB}, i as (select sum(case when a.cluster_id = b.cluster_id then weight else 0 end) as wi, sum(weight) as m2 from sy join lab a on a.item_id = src join lab b on b.item_id = dst), k as (select sum(k * k) as k2 from (select sum(weight) as k from sy join lab a on a.item_id = src group by a.cluster_id)) select round(wi / m2 - k2 / (m2 * m2), 6) as modularity from i, k"
    d["centroids"] = f"with {LONG}, {LAB}, m as (select cluster_id, dim, avg(v) as v from lg join lab using (item_id) group by 1, 2) select cluster_id, dim, round(v / sqrt(sum(v * v) over (partition by cluster_id)), 6) as v from m"
    d["assign_singletons"] = f"with {LONG}, {START}, {_round(1, 'st', 0.15)} select item_id, cluster_id from l1"
    d["cascade_labels"] = f"with {LONG}, {START}, {_cascade()} select item_id, cluster_id from l6"
    from ..operators.cascade import THRESHOLDS

    logged = " union all ".join(f"select {n} as stage, {'null' if t is None else t}::double as threshold, count(*) as n_clusters, count(*) filter (where z = 1) as singletons, round((sum(z) - count(*) filter (where z = 1)) / cast(sum(z) as double), 6) as coverage from (select count(*) as z from {l} group by {l}.cluster_id)" for n, t, l in [(0, None, "st"), *[(i, t, f"l{i}") for i, t in enumerate(THRESHOLDS, 1)]])
    d["cascade_rounds"] = f"with {LONG}, {START}, {_cascade()}, lo as ({logged}), a as (select *, coalesce(lag(singletons) over (order by stage) - singletons, 0) as assigned from lo) select *, cast(sum(assigned) over (order by stage) as bigint) as cumulative from a"
    d["cluster_metrics"] = f"with {START} {_metrics('st')}"
    d["nmi_ari"] = f"with {LAB}, {TRUTH}, {_nmi('lab', 'truth')} select * from nm"
    d["balanced_score"] = f"with {START}, {TRUTH}, {_nmi('st', 'truth')}, me as ({_metrics('st')}) select nmi, coverage, round(coalesce(nmi, 0) * coverage, 4) as bal from nm, me"
    d["nmi_subset"] = f"with {LAB}, {TRUTH}, sub as (select * from truth where item_id % 5 = 0), {_nmi('lab', 'sub', 20)} select * from nm"
    d["purity"] = f"with {LAB}, {TRUTH}, t as (select cluster_id, label, count(*) as n from lab join truth using (item_id) group by 1, 2) select cluster_id, cast(sum(n) as bigint) as size, first(label order by n desc, label) as dominant, round(max(n) / cast(sum(n) as double), 6) as purity from t group by 1"
    d["kappa"] = f"with {RATERS}" + KAPPA
    d["confusion"] = f"with {RATERS} select a, b, count(*) as n from ra group by 1, 2"
    d["kendall_tau"] = f"with {SCORES} select round(avg(case when (a.x > b.x) = (a.y > b.y) then 1.0::double else -1.0::double end), 6) as tau from sco a join sco b on a.method < b.method"
    d["bias_ratio"] = f"with {SCORES}, r as (select type, round(avg(x / y), 4) as mean_ratio from sco group by 1), g as (select round((max(mean_ratio) / min(mean_ratio) - 1) * 100, 1) as diff_pct from r) select type, mean_ratio, diff_pct, abs(diff_pct) > 10 as biased from r, g"
    ent = f"{_knn(20)}, {LAB}, nr as (select i as q, j as item_id from kn union all select item_id, item_id from lab), ct as (select q, cluster_id, cast(count(*) as double) as n from nr join lab using (item_id) group by 1, 2), en as (select q as item_id, round(-sum(n / t * ln(n / t + 1e-10::double)), 6) as entropy from (select *, sum(n) over (partition by q) as t from ct) group by 1)"
    d["neighbor_entropy"] = f"with {ent} select item_id, entropy from en"
    d["uncertain_anchors"] = f"with {ent} select item_id from en where entropy >= (select quantile_cont(entropy, 0.6) from en)"
    d["cluster_profile_concepts"] = f"with {w}, {ITEM_LAB}, z as (select cluster_id, count(*) as size from il group by 1), s as (select cluster_id, concept, round(sum(weight) / max(size) * (count(*) / cast(max(size) as double)), 6) as score from il join w using (item_id) join z using (cluster_id) group by 1, 2) select * from (select *, cast(row_number() over (partition by cluster_id order by score desc, concept) as int) as rank from s) where rank <= 10"
    d["cluster_profile_labels"] = f"with {LAB}, {TRUTH}, t as (select cluster_id, label, count(*) as n from lab join truth using (item_id) group by 1, 2), s as (select *, round(n / cast(sum(n) over (partition by cluster_id) as double), 6) as share, cast(row_number() over (partition by cluster_id order by n desc, label) as int) as rank from t) select * from s where rank <= 5"
    d["cluster_size_summary"] = f"with {START}, z as (select count(*) as size from st group by cluster_id) select round(avg(size), 6) as mean_size, quantile_cont(cast(size as double), 0.5) as median_size, min(size) as min_size, max(size) as max_size from z"
    d["gt_propagate"] = f"with {w}, {CONCEPT_LAB}, v as (select item_id, label, round(sum(weight), 6) as s, min(concept) as c from w join cl using (concept) where label <> 'unknown' group by 1, 2) select item_id, label from (select *, row_number() over (partition by item_id order by s desc, c, label) as r from v) where r = 1"
    d["category_merge"] = f"with {w}, {CONCEPT_LAB}, k as (select label from (select label, count(*) as n from cl group by 1) order by n desc, label limit 6) select concept, case when label in (select label from k) then label when split_part(label, ':', 1) in (select label from k) then split_part(label, ':', 1) else 'other' end as label from cl"
    d["concept_frequency"] = f"with {w} select concept, count(*) as n from w group by 1 order by n desc, concept limit 50"
    d["label_batches"] = f"with {w}, cn as (select concept, count(*) as freq from w group by 1) select concept, cast(floor((row_number() over (order by freq desc, concept) - 1) / 50) as bigint) as batch from cn"
    d["verdict_stats"] = "with v as (select case when toxic = 1 then 'reject' when quality = 1 then 'accept' else 'borderline' end as v from labels) select count(*) as n, count(*) filter (where v = 'accept') as accepted, count(*) filter (where v = 'borderline') as borderline, count(*) filter (where v = 'reject') as rejected, round(count(*) filter (where v = 'accept') / cast(count(*) as double), 6) as accept_rate, round(count(*) filter (where v <> 'reject') / cast(count(*) as double), 6) as acceptable_rate from v"
    known = f"[{_list(q.CATEGORIES)}]"
    x = "trim(regexp_replace(regexp_replace(regexp_replace(lower(string_split(regexp_replace(answer, '^\\s+|\\s+$', '', 'g'), chr(10))[1]), '[\"''`]', '', 'g'), '^[-*•\\s]+', ''), '^category:\\s*', ''))"
    flat = lambda c: f"regexp_replace({c}, '[ _/-]', '', 'g')"
    d["label_kept"] = d["rule_labels"] = f"with {w} select distinct concept, {_rule('concept')} as label from w"
    d["label_dry_run"] = f"with {w}, o as (select count(distinct concept) as n_values, cast(sum(len(concept)) as bigint) as n_chars from w) select n_values, cast(ceil(n_values / 200.0) as bigint) as n_batches, n_chars, cast(ceil(n_chars / 4.0) as bigint) as est_tokens, round(ceil(n_chars / 4.0) / 1000000.0::double, 6) as est_usd from o"
    claims = f"{w}, cl as (select distinct concept, case when regexp_matches(concept, '^[aeiou]') then 'science' else {_rule('concept')} end as label, {_rule('concept')} as own from w)"
    d["judge_verdicts"] = f"with {claims} select concept, label, case when label = own then 'accept' else 'reject' end as verdict, case when label <> own then own end as better from cl"
    d["judge_agreement"] = "with " + claims + ", ra as (select label as a, own as b from cl)" + KAPPA
    d["kappa_bootstrap"] = f"""with {RATERS}, ce as (select cast(a as varchar) as a, cast(b as varchar) as b, count(*) as n from ra where a is not null and b is not null group by 1, 2),
ea as (select a, b, r, i from (select a, b, unnest(range(n)) as i from ce) x, range(200) t(r)),
t as (select r, a, b, cast(sum({_poisson(42, 'r', 'a', 'b', 'i')}) as double) as w from ea group by 1, 2, 3),
e as (select x.r, sum(x.s * y.s) as e from (select r, a as k, sum(w) as s from t group by 1, 2) x join (select r, b as k, sum(w) as s from t group by 1, 2) y using (r, k) group by 1),
o as (select r, sum(w) as w, sum(case when a = b then w else 0 end) as o from t group by 1),
k as (select case when coalesce(e, 0) / (w * w) >= 1 then 1.0::double else (o / w - coalesce(e, 0) / (w * w)) / (1 - coalesce(e, 0) / (w * w)) end as k from o left join e using (r) where w > 0)
select case when (select sum(n) from ce) < 10 then 0.0 else round(quantile_cont(k, 0.025), 6) end as lo, case when (select sum(n) from ce) < 10 then 1.0 else round(quantile_cont(k, 0.975), 6) end as hi from k"""
    d["density_clusters"] = f"""with recursive {_knn(10)}, cr as (select i, 1 - sim as c from kn where rank = 5),
rx as (select distinct least(kn.i, kn.j) as src, greatest(kn.i, kn.j) as dst, round(greatest(1 - kn.sim, x.c, y.c), 9) as d from kn join cr x on x.i = kn.i join cr y on y.i = kn.j),
le as (select src, dst from rx where d <= (select quantile_cont(d, 0.3) from rx)), sy as (select src, dst from le union select dst, src from le),
rc as (select item_id, item_id as r from em union select rc.item_id, sy.dst from rc join sy on rc.r = sy.src), cp as (select item_id, min(r) as c from rc group by 1), z as (select c, count(*) as n from cp group by 1)
select item_id, case when n >= 5 then c else -item_id - 2 end as cluster_id from cp join z using (c)"""
    d["label_normalize"] = f"with c as (select id, case when {x} = 'economics' then 'finance' else {x} end as c from ({ANSWERS}) t) select id, case when c <> '' then coalesce(list_filter({known}, lambda k: k = c)[1], list_filter({known}, lambda k: {flat('k')} = {flat('c')})[1], list_filter({known}, lambda k: contains(c, k))[1]) end as label from c"
    d["verdict_parse"] = f"with v as (select id, lower(answer) as a, case when lower(answer) like '%borderline%' then 'borderline' when regexp_matches(lower(answer), 'reject|incorrect|wrong') then 'reject' when regexp_matches(lower(answer), 'accept|correct|agree') then 'accept' end as verdict from ({VERDICTS}) t) select id, verdict, case when verdict = 'reject' and contains(a, chr(10)) then list_filter({known}, lambda k: contains(substr(a, position(chr(10) in a)), k))[1] end as better from v"
    d["json_label_parse"] = f"select id, regexp_extract(p, '\"([^\"]+)\"\\s*:\\s*\"([^\"]+)\"', 1) as concept, regexp_extract(p, '\"([^\"]+)\"\\s*:\\s*\"([^\"]+)\"', 2) as label from (select id, unnest(regexp_extract_all(answer, '\"[^\"]+\"\\s*:\\s*\"[^\"]+\"')) as p from ({JSONS}) t)"
    d["ground_truth_layouts"] = "select vec_id as item_id, 'l' || label as label from embeddings where label is not null"
    d["stratified_sample"] = f"with z as (select lang, count(*) as size, sum(count(*)) over () as total from documents group by lang), qt as (select lang, cast(least(size, greatest(2, round(50.0::double * size / total))) as int) as quota from z), r as (select doc_id, lang, row_number() over (partition by lang order by {_sample(42, 'doc_id')}, doc_id) as r from documents) select doc_id, lang from r join qt using (lang) where r <= quota order by {_sample(43, 'doc_id')}, doc_id limit 50"
    d["capped_sample"] = f"with z as (select source, count(*) as size from documents group by source), b as (select *, least(size, greatest(1, least(5, floor(70.0 / count(*) over ())))) as base from z), o as (select *, 70 - sum(base) over () as rest, row_number() over (order by size desc, source) as o from b), qt as (select source, least(size, base + case when o <= rest then 1 else 0 end) as quota from o), r as (select doc_id, source, row_number() over (partition by source order by {_sample(42, 'doc_id')}, doc_id) as r from documents) select doc_id, source from r join qt using (source) where r <= quota order by {_sample(43, 'doc_id')}, doc_id limit 70"
    d["uniform_sample"] = f"select doc_id, lang from documents order by {_sample(42, 'doc_id')}, doc_id limit 25"
    d["triplets"] = f"""with {LAB}, m as (select *, cast(row_number() over (partition by cluster_id order by {_sample(42, 'item_id')}, item_id) as bigint) - 1 as pos, count(*) over (partition by cluster_id) as size from lab),
c as (select cluster_id, size, cast(row_number() over (order by cluster_id) as bigint) - 1 as place from m where pos = 0), k as (select count(*) as k from c),
a as (select item_id as anchor, m.cluster_id, (pos + 1) % m.size as nxt, (place + 1 + {_drawn(43, 'item_id')} % greatest(1, k.k - 1)) % k.k as other, place from m join c using (cluster_id), k where m.size > 1),
t as (select a.anchor, a.cluster_id, a.nxt, c.cluster_id as dest, {_drawn(44, 'anchor')} % c.size as spot from a join c on a.other = c.place where a.other <> a.place)
select anchor, p.item_id as positive, g.item_id as negative from t join m p on p.cluster_id = t.cluster_id and p.pos = t.nxt join m g on g.cluster_id = t.dest and g.pos = t.spot"""
    d["cluster_profiles"] = f"""with {w}, {ITEM_LAB}, z as (select cluster_id, count(*) as size from il group by 1), s as (select cluster_id, concept, round(sum(weight) / max(size) * (count(*) / cast(max(size) as double)), 6) as score from il join w using (item_id) join z using (cluster_id) group by 1, 2),
r as (select *, row_number() over (partition by cluster_id order by score desc, concept) as rank from s), t as (select cluster_id, list(concept order by rank) as concepts from r where rank <= 10 group by 1),
nc as (select item_id, count(*) as n from w group by 1), p as (select il.cluster_id, il.item_id, prompt, row_number() over (partition by il.cluster_id order by coalesce(n, 0) desc, il.item_id) as rank from il join items using (item_id) left join nc on nc.item_id = il.item_id where len(trim(prompt)) > 10),
e as (select cluster_id, list(substr(prompt, 1, 300) order by rank) as prompts from p where rank <= 3 group by 1)
select cluster_id, size, concepts, prompts from z left join t using (cluster_id) left join e using (cluster_id) order by size desc, cluster_id limit 30"""
    d["rejection_by_category"] = "select lang as category, count(*) as n, count(*) filter (where toxic = 1) as rejected, round(count(*) filter (where toxic = 1) / cast(count(*) as double), 6) as rate from labels join documents using (doc_id) group by 1"
    d["corrections"] = "select source as correction, count(*) as n from labels join documents using (doc_id) where quality is distinct from 1 and source is not null group by 1 order by n desc, source limit 10"
    d["disagreements"] = f"with {RATERS} select a, b, count(*) as n from ra where a <> b group by 1, 2 order by n desc, a, b limit 20"
    d["bias_deltas"] = f"with {SCORES} select method, type, round(x, 4) as x, round(y, 4) as y, round(x - y, 4) as delta, case when y > 0 then round(x / y, 4) end as ratio from sco where x is not null and y is not null"
    d["rank_vectors"] = f"with {SCORES} select method, cast(row_number() over (order by x desc, method) as int) as rank_x, cast(row_number() over (order by y desc, method) as int) as rank_y from sco"
    d["head_to_head"] = f"with {SCORES}, o as (select * from sco where method = 'src0'), r as (select s.* from sco s, o where s.type <> o.type order by s.x desc, s.method limit 1), g as (select o.method, r.method as rival, o.x - r.x as gx, o.y - r.y as gy from o, r) select method, rival, round(gx, 4) as gap_x, round(gy, 4) as gap_y, case when gx > 0 and gy > 0 then round((1 - gy / gx) * 100, 4) end as shrinkage_pct from g"
    d["cluster_summary"] = f"with {LAB}, {TRUTH}, z as (select cast(count(*) as double) as x from lab group by cluster_id), t as (select cluster_id, label, count(*) as n from lab join truth using (item_id) group by 1, 2), p as (select round(max(n) / cast(sum(n) as double), 6) as x from t group by cluster_id), u as (select 'size' as what, x from z union all select 'purity', x from p) select what, round(avg(x), 6) as mean, quantile_cont(x, 0.5) as median, min(x) as least, max(x) as most from u group by 1"
    d["tagged_samples"] = "select doc_id as id, lang, cast(null as varchar) as url, 'documents' as dataset from documents union all select page_id, null, url, 'pages' from pages"
    d["ensemble_members"] = f"with {RESULTS} select run from rs order by bal desc, run limit 8"
    d["coassociation_edges"] = f"with {_knn(10)}, {RUNS} select i as src, j as dst, round(sum((a.cluster_id = b.cluster_id)::int) / 3.0::double, 6) as weight from kn join ru a on a.item_id = i join ru b on b.item_id = j and a.run = b.run where j > i group by 1, 2 having sum((a.cluster_id = b.cluster_id)::int) > 0"
    d["best_per_family"] = f"with {RESULTS} select family, run, bal from (select *, row_number() over (partition by family order by bal desc, run) as r from rs) where r = 1"
    d["top_results"] = f"with {RESULTS} select run, bal from rs order by bal desc, run limit 30"
    d["ablation_matrix"] = f"with {RESULTS} select family as representation, max(bal) filter (where algorithm = 'F') as F, max(bal) filter (where algorithm = 'O') as O, max(bal) filter (where algorithm = 'P') as P from rs group by 1"
    d["class_terms"] = f"with {ITEMS}, {ITEM_LAB}, t as (select item_id, unnest(list_filter(regexp_extract_all(lower(coalesce(prompt, '')), '[a-z]{{2,}}'), lambda x: not list_contains({STOP}, x))) as term from items), tf as (select cluster_id, term, count(*) as tf from t join il using (item_id) group by 1, 2), z as (select cluster_id, sum(tf) as n from tf group by 1), f as (select term, sum(tf) as f from tf group by 1), s as (select cluster_id, term, round(tf / cast(n as double) * ln(1 + (select avg(n) from z) / f), 6) as score from tf join z using (cluster_id) join f using (term)) select * from (select *, cast(row_number() over (partition by cluster_id order by score desc, term) as int) as rank from s) where rank <= 10"
    d["flag_filter"] = "select doc_id, toxic from labels where quality = 1"
    d["valid_sorted_sample"] = "select o_orderkey, round(o_totalprice, 2) as price from orders where o_orderstatus = 'F' order by o_totalprice, o_orderkey limit 40"
    d["null_issues"] = "select doc_id, lang from documents left join labels using (doc_id) where quality is null or toxic is null"
    d["quality_report"] = "select 'positive quantity' as rule, count(*) filter (where not coalesce(l_quantity > 0, false)) as failures, count(*) as rows from lineitem union all select 'discount under 5 %', count(*) filter (where not coalesce(l_discount < 0.05::double, false)), count(*) from lineitem union all select 'flag known', count(*) filter (where not coalesce(l_returnflag in ('A', 'N'), false)), count(*) from lineitem"
    d["root_causes"] = "select event_type, count(*) as n, round(avg(value), 6) as mean_value from events group by 1"
    d["comparison_table"] = "select o_orderpriority, round(sum(o_totalprice) filter (where o_orderstatus = 'F'), 2) as F, round(sum(o_totalprice) filter (where o_orderstatus = 'O'), 2) as O, round(sum(o_totalprice) filter (where o_orderstatus = 'P'), 2) as P from orders group by 1"
    d["contract_report"] = f"with {ITEMS} select count(*) as n_rows, count(*) filter (where trim(coalesce(prompt, '')) = '') as n_no_prompt, count(*) filter (where item_id % 3 = 0) as n_labels, count(distinct case when item_id % 3 = 0 then conv_id % 4 end) as n_categories, count(*) filter (where item_id % 3 <> 0) as n_unlabelled from items"
    d["event_windows"] = "select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2"
    d["concept_idf_plus_one"] = f"with {IC}, {_kept()} select concept, count(*) as df, round(ln(cast((select n from N) as double) / (count(*) + 1)), 6) as idf from f group by concept"
    d["concepts_any_script"] = "with " + IC.replace("[a-z]{2,}", r"[\p{L}\p{M}]{2,}") + " select concept, count(*) as df from ic group by concept"
    d["concept_vectors_default"] = f"with {w}, p as (select f.item_id, f.concept as dim, coalesce(weight, 0.1::double) as v from f left join w on w.item_id = f.item_id and w.concept = f.concept) select item_id, dim, round(v / sqrt(sum(v * v) over (partition by item_id)), 6) as v from p"
    d["hashed_vectors"] = f"with {ITEMS}, h as (select item_id, md5(unnest(regexp_extract_all(lower(coalesce(prompt, '')), '[a-z]{{2,}}'))) as h from items), x as (select item_id, cast('0x' || substr(h, 1, 8) as bigint) % 64 as d, cast(sum(case when substr(h, 9, 1) < '8' then 1 else -1 end) as double) as x from h group by 1, 2) select item_id, cast(d as varchar) as dim, round(x / sqrt(sum(x * x) over (partition by item_id)), 6) as v from x where x <> 0"
    clean = r"len(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'))"
    d["usable_texts"] = f"select doc_id, {clean} >= 10 as judged, {clean} > 10 as profiled, {clean} < 5 as short, substr(text, 1, 100) as first_100, substr(text, 1, 800) as first_800 from documents"
    d["label_consolidation"] = f"with {w}, {CONCEPT_LAB}, m as (select * from (values {', '.join(str(x) for x in q.CANONICAL)}) t(label, canonical)) select concept, coalesce(canonical, cl.label) as label from cl left join m on m.label = cl.label"
    d["annotation_rows"] = f"with s as (select doc_id from documents order by {_sample(42, 'doc_id')}, doc_id limit 25) select doc_id as item_id, text as prompt, cast(quality as varchar) as label from s join documents using (doc_id) join labels using (doc_id)"
    d["cluster_preview"] = d["cluster_profiles"].replace("rank <= 10", "rank <= 4").replace("> 10)", "> 0)").replace("1, 300", "1, 100").replace("limit 30", "limit 20")
    rounds, before = "", "lab"
    for n in (1, 2, 3):
        rounds += f""", m{n} as (select cluster_id, dim, avg(v) as v from lu join {before} using (item_id) group by 1, 2), c{n} as (select cluster_id, dim, v / sqrt(sum(v * v) over (partition by cluster_id)) as v from m{n}),
s{n} as (select item_id, c.cluster_id, round(sum(lu.v * c.v), 9) as sim from lu join c{n} c using (dim) group by 1, 2), l{n} as (select item_id, cluster_id from (select *, row_number() over (partition by item_id order by sim desc, cluster_id) as r from s{n}) where r = 1)"""
        before = f"l{n}"
    d["spherical_refit"] = f"with {LONG}, {LAB}, lu as (select item_id, dim, v / sqrt(sum(v * v) over (partition by item_id)) as v from lg){rounds} select item_id, cluster_id from {before}"
    d["knn_connectivity"] = f"with {_knn(10)} select least(i, j) as src, greatest(i, j) as dst, count(*) * 0.5::double as weight from kn group by 1, 2"
    terms = d["class_terms"].replace("rank <= 10", "rank <= 200")
    d["topic_pairs"] = f"with ct as ({terms}), u as (select cluster_id, term, score / sqrt(sum(score * score) over (partition by cluster_id)) as v from ct) select a.cluster_id as i, b.cluster_id as j, round(sum(a.v * b.v), 4) as sim from u a join u b using (term) where a.cluster_id < b.cluster_id group by 1, 2 having sum(a.v * b.v) >= 0.05::double"
    d["anomalies"] = "with s as (select event_type, avg(value) as m, stddev_pop(value) as s from events group by 1), f as (select event_type, round((value - m) / nullif(s, 0), 6) as d from events join s using (event_type)) select event_type, case when d > 0 then 'high' else 'low' end as side, count(*) as n, round(avg(abs(d)) - 2.0::double, 4) as mean_excess from f where abs(d) > 2 group by 1, 2"
    d["date_range"] = "select o_orderkey, o_custkey from orders where cast(o_orderdate as date) between date '1995-01-01' and date '1995-12-31'"
    d["category_samples"] = f"with {w}, {CONCEPT_LAB}, r as (select *, row_number() over (partition by label order by concept) as r from cl) select label, count(*) as n, list(concept order by r) filter (where r <= 3) as concepts from r group by label"
    d["cluster_profiles_truth"] = f"with {ITEMS}, {ITEM_LAB}, t as (select cluster_id, cast(conv_id % 4 as varchar) as label, count(*) as n from il join (select item_id, conv_id from items) using (item_id) group by 1, 2), r as (select *, row_number() over (partition by cluster_id order by n desc, label) as r, sum(n) over (partition by cluster_id) as size from t) select cluster_id, cast(size as bigint) as size, label as dominant, round(n / cast(size as double), 6) as purity from r where r = 1"
    other = "truth as (select vec_id as item_id, cast(vec_id % 5 as varchar) as label from embeddings)"
    bal = lambda name, labels, truth: f"(with {labels}, {truth}, {_nmi(name, 'truth')}, me as ({_metrics(name)}) select round(coalesce(nmi, 0) * coverage, 4) from nm, me)"
    d["bias_runs"] = f"select 'sevenths' as method, 'fixed' as type, {bal('lab', LAB, TRUTH)} as x, {bal('lab', LAB, other)} as y union all select 'third', 'embedding', {bal('st', START, TRUTH)}, {bal('st', START, other)} union all select 'broken', 'fixed', null, null"
    return d
