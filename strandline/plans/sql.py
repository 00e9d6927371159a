"""DuckDB SQL that must give the same rows as the engine's queries. Its matrices are the engine's own values, so it checks the
recurrence and not these; the fingerprints in the tests do."""

from __future__ import annotations

from strandline.functions.alphabet import LETTERS
from strandline.functions.matrices import NAMES, matrix


def _letters(text: str) -> str:
    return f"upper(regexp_replace({text}, '[^A-Za-z]', '', 'g'))"


def _codes(residues: str) -> str:
    return f"list_transform(string_split({residues}, ''), lambda c: case when instr('{LETTERS}', c) = 0 then 23 else (instr('{LETTERS}', c) - 1)::int end)"


def sequences(table: str, key: str, text: str) -> str:
    """Common tables s (key, letters) and db (with len and db_pos)."""
    return f"""s as (select {key}::bigint id, {_letters(text)} x from {table} where length({_letters(text)}) > 0),
db as (select id, x, length(x)::int len, (row_number() over (order by length(x), id) - 1)::bigint db_pos from s)"""


def _values(*names: str) -> str:
    rows = ",".join(f"('{n}',{i},{j},'{a}','{b}',{matrix(n)[i, j]})" for n in names for i, a in enumerate(LETTERS) for j, b in enumerate(LETTERS))
    return f"(values {rows}) m(matrix, i, j, res_i, res_j, score)"


def pair_scores(name: str = "blosum62", gap_open: int = 10, gap_extend: int = 2) -> str:
    """Common tables ending in p (query_id, db_pos, score): every region name against every part name, one recursion a query residue."""
    oe, e = gap_open + gap_extend, gap_extend
    flat = ",".join(str(x) for x in matrix(name).reshape(-1))
    return f"""with recursive {sequences("part", "p_partkey", "p_name")},
q as (select r_regionkey::bigint query_id, {_codes(_letters("r_name"))} a from region where length({_letters("r_name")}) > 0),
m as (select [{flat}] m),
qb as (select query_id, db_pos, a, {_codes("x")} b from q, db),
r(query_id, db_pos, a, b, i, s, best) as (
  select query_id, db_pos, a, b, 0, {{'h': list_transform(b, lambda x: 0), 'f': list_transform(b, lambda x: 0), 'e': 0}}, 0 from qb
  union all
  select query_id, db_pos, a, b, i + 1, s, greatest(best, list_max(s.h)) from (
    select query_id, db_pos, a, b, i, best, list_reduce(list_transform(range(1, len(b) + 1), lambda j: {{'h': [j::int], 'f': [0], 'e': 0}}), lambda acc, x:
      {{'h': list_append(acc.h, greatest(0, case when x.h[1] > 1 then s.h[x.h[1] - 1] else 0 end + m[a[i + 1] * 24 + b[x.h[1]] + 1], acc.e, s.f[x.h[1]])),
        'f': list_append(acc.f, greatest(s.f[x.h[1]] - {e}, greatest(0, case when x.h[1] > 1 then s.h[x.h[1] - 1] else 0 end + m[a[i + 1] * 24 + b[x.h[1]] + 1], acc.e, s.f[x.h[1]]) - {oe})),
        'e': greatest(acc.e - {e}, greatest(0, case when x.h[1] > 1 then s.h[x.h[1] - 1] else 0 end + m[a[i + 1] * 24 + b[x.h[1]] + 1], acc.e, s.f[x.h[1]]) - {oe})}},
      {{'h': []::int[], 'f': []::int[], 'e': 0}}) s
    from r, m where i < len(a))),
p as (select query_id, db_pos, max(best)::int score from r group by query_id, db_pos)"""


_DOCUMENTS = f"with {sequences('documents', 'doc_id', 'text')}"
_QUERIES = f"{sequences('benchmark', 'item_id', 'text').replace('s as', 'bs as').replace('from s)', 'from bs)').replace('db as', 'q as')}"
_GROUPS = "g as (select db_pos // 16 vector_group, count(*) sequences, max(len)::int max_len, ceil(max(len) / 28.0)::bigint blocks, max(len)::bigint * 16 padded from db group by 1)"
_TOP = "t as (select query_id, db_pos, score, row_number() over (partition by query_id order by score desc, db_pos desc)::int rank from p)"

SQL = {
    "seq_ingest": f"{_DOCUMENTS} select id seq_ordinal, x residues, len from db",
    "residue_composition": f"""{_DOCUMENTS}, c as (select unnest({_codes('x')}) code from s)
select code::int code, case when code < 23 then '{LETTERS}'[code + 1] end residue, count(*) n from c group by code""",
    "db_stats": f"{_DOCUMENTS} select count(*) sequences_count, sum(len)::bigint residues, max(len)::int max_len, max(length(id::varchar))::int max_title_len from db",
    "query_stats": f"with {sequences('benchmark', 'item_id', 'text')} select count(*) queries_count, sum(len)::bigint residues from db",
    "query_displacements": f"""with {sequences('benchmark', 'item_id', 'text')}
select id query_id, len, coalesce(sum(len) over (order by id rows between unbounded preceding and 1 preceding), 0)::bigint disp from db""",
    "db_length_order": f"{_DOCUMENTS} select db_pos, id seq_ordinal, len from db",
    "fasta_database": f"{_DOCUMENTS} select db_pos, id seq_ordinal, id::varchar title, len from db",
    "fasta_files": f"select doc_id, coalesce({_letters('text')}, '') residues, true placed from documents",
    "vector_groups": f"{_DOCUMENTS}, {_GROUPS} select * from g",
    "chunk_assembly": f"""{_DOCUMENTS}, {_GROUPS},
c as (select *, floor(coalesce(sum(padded) over (order by vector_group rows between unbounded preceding and 1 preceding), 0) / 134217728.0)::bigint chunk from g),
k as (select chunk, count(*) "groups", sum(sequences)::bigint sequences, sum(padded)::bigint padded, min(vector_group) first_group from c group by chunk)
select *, coalesce(sum("groups") over (order by chunk rows between unbounded preceding and 1 preceding), 0)::bigint groups_before from k""",
    "group_slice": f"{_DOCUMENTS}, {_GROUPS} select * from g where vector_group >= 10 and vector_group < 40",
    "sample_prefix": f"{_DOCUMENTS} select db_pos, id seq_ordinal, len from db where db_pos < (select ceil(count(*) * 0.01) from db)",
    "sample_fair": f"""{_DOCUMENTS}, h as (select *, length(bin(len))::int stratum, md5(id::varchar) h from db),
k as (select *, row_number() over (partition by stratum order by h, id) r, count(*) over (partition by stratum) n from h)
select db_pos, id seq_ordinal, len, stratum from k where r <= ceil(n * 0.01)""",
    "ungapped_diagonals": f"""with {sequences('part', 'p_partkey', 'p_name')},
q as (select r_regionkey::bigint query_id, {_codes(_letters('r_name'))} a from region where length({_letters('r_name')}) > 0),
m as (select [{','.join(str(x) for x in matrix('blosum62').reshape(-1))}] m),
a as (select query_id, unnest(a) i, unnest(range(0, len(a))) p from q),
b as (select db_pos, unnest({_codes('x')}) j, unnest(range(0, len)) q from db),
w as (select query_id, db_pos, p, (b.q - p)::int diagonal, m[i * 24 + j + 1] score from a, b, m),
u as (select *, sum(score) over (partition by query_id, db_pos, diagonal order by p) upto from w),
g as (select *, upto - least(0, coalesce(min(upto) over (partition by query_id, db_pos, diagonal order by p rows between unbounded preceding and 1 preceding), 0)) gain from u),
r as (select query_id, db_pos, diagonal, gain, row_number() over (partition by query_id, db_pos order by gain desc, diagonal) r from g where gain > 0)
select query_id, db_pos, diagonal, gain::int score from r where r = 1""",
    "submat_lookup": f"""{_DOCUMENTS}, c as (select unnest({_codes('x')}) j from s), n as (select j, count(*) n from c where j < 23 group by j)
select matrix, j, res_j, sum(score * n)::bigint total, max(score)::int best from n join {_values(*NAMES)} using (j) group by matrix, j, res_j""",
    "score_profile": f"""with {sequences('part', 'p_partkey', 'p_name')}, c as (select db_pos, unnest({_codes('x')}) j, unnest(range(0, len)) place from db)
select db_pos, place::int place, i, score from c join {_values('blosum62')} using (j)""",
    "sw_scores": f"{pair_scores()} select * from p",
    "sw_topk": f"{pair_scores()}, {_TOP} select * from t where rank <= 10",
    "hit_titles": f"{pair_scores()}, {_TOP} select query_id, db_pos, id seq_ordinal, id::varchar title, score, rank from t join db using (db_pos) where rank <= 10",
    "sw_overflow_stats": f"{pair_scores('pam250', 0, 0)} select query_id, count(*) pairs, sum((score >= 40)::int)::bigint \"over\", sum(least(score, 40))::bigint capped_sum from p group by query_id",
    "cells": f"{_DOCUMENTS}, {_QUERIES} select q.id query_id, (q.len * (select sum(len) from db))::bigint cells from q",
}
SQL["fasta_search"] = f"{pair_scores('pam250', 3, 1)}, {_TOP} select query_id, db_pos, id seq_ordinal, score, rank from t join db using (db_pos) where rank <= 7"
SQL["sw_scores_tiles"] = SQL["sw_score_fold"] = SQL["sw_scores"]
SQL["hit_titles_pieces"] = f"{pair_scores('blosum62', 255, 127)}, {_TOP} select query_id, db_pos, id seq_ordinal, id::varchar title, score, rank from t join db using (db_pos) where rank <= 10"
SQL["sw_score_sql"] = f"""select query_id, db_pos, x.score, y.score pam250_score from ({pair_scores()} select * from p) x
join ({pair_scores('pam250', 3, 1)} select * from p) y using (query_id, db_pos)"""
SQL |= {f"sw_scores_{name}": f"{pair_scores(name)} select * from p" for name in NAMES}
SQL |= {f"sw_scores_gaps_{o}_{e}": f"{pair_scores('blosum62', o, e)} select * from p" for o, e in ((0, 0), (3, 1), (255, 127))}
