"""SQL counterparts of ``comparisons`` and of queries that combine several others."""

from __future__ import annotations

from wordloom.functions.text import SCRIPTS
from wordloom.plans.oracle import COVER, IGNORED, LANG_VALUES, LINES, PAIRS, POINTS, QUAL, RANKED, SCRIPT, SCRIPT_NAMES, SEG, WORDS, CLEAN

_SCRIPT = SCRIPT  # needs LINES, which IGNORED brings
ALL_IGNORED = f"""{IGNORED}, {_SCRIPT},
of_main as (select s.lang, s.file, m.script as main, sum(case when s.script = m.script then s.pct else 0 end) as pct,
    max(case when s.place = 1 then s.script end) as own, max(case when s.place = 1 then s.pct end) as own_pct
  from shares s join lang_scripts m on m.lang = s.lang and m.place = 1 group by s.lang, s.file, m.script),
all_ignored as (select file, reason, row_number() over (partition by file order by priority, reason) as nth from (
  select file, reason, 0 as priority from overlap_ignored
  union all select file, case when own = main then 'lang script ' || main || ' only ' || printf('%.1f', pct) || '% in file (need >= 75.0%)'
    else 'file is ' || printf('%.1f', own_pct) || '% ' || own || ', but lang script is ' || main || ' (only ' || printf('%.1f', pct) || '% in file, need >= 75.0%)' end, 1
  from of_main where pct < 75)),
ignored as (select file, reason from all_ignored where nth = 1)"""
MEASURES = ("foreign_script_pct", "long_outlier_pct", "punct_char_pct", "program_pct", "corrupted_pct", "total_types")
FILES = "files as (select distinct file, substr(file, 1, 3) as lang, split_part(file, '_', 2) as kind from raw_freq where file is not null)"
_RSS = "(regr_syy({y}, {x}) - coalesce(regr_sxy({y}, {x}) * regr_sxy({y}, {x}) / nullif(regr_sxx({y}, {x}), 0), 0))"
_ELBOW = f"""splits as (select p.lang, p.x, {_RSS.format(y="case when q.x <= p.x then q.y end", x="q.x")} + {_RSS.format(y="case when q.x >= p.x then q.y end", x="q.x")} as sse
  from points p join points q on q.lang = p.lang group by p.lang, p.x
  having count(*) filter (where q.x <= p.x) >= 2 and count(*) filter (where q.x >= p.x) >= 2),
elbow as (select lang, x, round(sse, 6) as sse from (select *, row_number() over (partition by lang order by round(sse, 6), x) as nth from splits) where nth = 1)"""


def _short(n: str) -> str:
    steps = "".join(f"when {n} >= {unit} then printf('%.1f', round({n} / {unit}::double, 1)) || '{sign}' " for unit, sign in ((10**9, "B"), (10**6, "M"), (1000, "K")))
    return f"case {steps}else {n}::varchar end"


ORACLE: dict[str, str] = {
    "e4_ignored": f"with {ALL_IGNORED} select file, reason from ignored",
    "j2_without_ignored": f"with {ALL_IGNORED} select lang, count(distinct file)::bigint as files, count(*)::bigint as lines from lines where file not in (select file from ignored) group by lang",
    "w17_elbow": f"with {POINTS}, {_ELBOW} select lang, x, round(sse, 3) as sse from elbow",
    "k13_latex": rf"""with {WORDS}, {SEG}, t as (select lang, count(*)::bigint as types, sum(frequency)::bigint as tokens from words group by lang),
      m as (select substr(file, 1, 3) as lang, round(avg(n), 5) as avg_morphs from feats where regexp_extract(file, '^.{{3}}_([^-]+)-', 1) = 'Morfo' group by file)
      select lang, concat_ws(' & ', replace(replace(replace(lang, '&', '\&'), '%', '\%'), '_', '\_'),
        coalesce(replace(replace(replace(name, '&', '\&'), '%', '\%'), '_', '\_'), '--'), {_short("types")}, {_short("tokens")}, printf('%.3f', round(avg_morphs, 3))) || ' \\' as line
      from t join m using (lang) left join languages on iso_code = lang""",
    "w9_tie_band": f"""with {COVER}, c as (select lang, k from cover where level = 94), l as (select r.lang, r.frequency as last, c.k from ranked r join c on c.lang = r.lang and r.rank = c.k)
      select l.lang, l.last, count(*) filter (where r.rank <= l.k)::bigint as needed, count(*)::bigint as tied from l join ranked r on r.lang = l.lang and r.frequency = l.last group by l.lang, l.last""",
    "a36_cut_share": f"with {COVER} select lang, max(k) filter (where level = 94)::bigint as kept, round(max(k) filter (where level = 94) * 100.0 / (max(k) filter (where level = 100))::double, 4) as kept_pct from cover group by lang",
    "w14_interpolated": f"""with {RANKED}, s as (select * from (values (0.125::double), (1 / 3::double)) t(share)),
      g as (select lang, share, greatest(1.0::double, share * max(types)) as r from ranked, s group by lang, share)
      select g.lang, round(share, 3) as share, round(max(case when rank <= r then tokens_upto end)::double + coalesce((r - floor(r)) * max(case when rank = floor(r) + 1 then frequency end), 0), 3) as tokens_upto
      from g join ranked k on k.lang = g.lang and k.rank <= g.r + 1 group by g.lang, share, r""",
    "w5_new_words": f"""with {LINES}, {CLEAN}, f as (select lang, word, min(file) as file from cleaned group by lang, word), n as (select file, count(*)::bigint as new_types from f group by file),
      a as (select distinct lang, file from lines) select lang, file, coalesce(new_types, 0) as new_types,
      (sum(coalesce(new_types, 0)) over (partition by lang order by file rows unbounded preceding))::bigint as known from a left join n using (file)""",
    "a39_longest_list": f"""with {LINES}, {CLEAN}, t as (select lang, file, count(distinct word)::bigint as types from cleaned group by lang, file)
      select lang, file, types from (select *, row_number() over (partition by lang order by types desc, file) as nth from t) where nth = 1""",
    "a40_merged_kinds": f"with {LINES}, {CLEAN} select lang, split_part(file, '_', 2) as kind, count(distinct word)::bigint as types, sum(frequency)::bigint as tokens from cleaned group by 1, 2",
    "a65_key_values": f"""with {LINES}, {CLEAN}, k as (select lang, word, sum(frequency) as f, count(*) as c from cleaned group by lang, word)
      select lang, word, round(f / (sum(f) over (partition by lang))::double, 9) as probability, round(f / c::double, 6) as mean from k""",
    "a66_sample_characters": f"with {LINES}, c as (select distinct lang, unnest(string_split(word, '')) as ch from lines where ord % 5 = 0 and ord < 50000) select lang, count(*)::bigint as characters from c where ch <> '' group by lang",
    "a41_most_shared": f"with {PAIRS} select file, max(share) as most from (select file_a as file, share_a_pct as share from pairs union all select file_b, share_b_pct from pairs) group by file",
    "j21_pairs_kept": f"with {IGNORED} select file_a, file_b, overlap from pairs where file_a not in (select file from overlap_ignored) and file_b not in (select file from overlap_ignored)",
    "a44_whiskers": f"""with {QUAL}, b as (select lang, quantile_cont(program_pct, 0.25) as q1, quantile_cont(program_pct, 0.75) as q3, avg(program_pct) as mean from q where program_pct is not null group by lang),
      v as (select lang, q1, q3, mean, program_pct as v, program_pct between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside from q join b using (lang) where program_pct is not null)
      select lang, round(q1, 9) as q1, round(q3, 9) as q3, round(mean, 9) as mean, round(min(v) filter (where inside), 9) as low, round(max(v) filter (where inside), 9) as high,
      count(*) filter (where not inside) as outside from v group by lang, v.q1, v.q3, v.mean""",
    "a47_usual_script": f"""with {QUAL}, c as (select lang, script, count(*)::bigint as n from q where script is not null group by lang, script)
      select lang, script, n, row_number() over (partition by lang order by n desc, script) = 1 as usual from c""",
    "a50_quality_score": f"""with {QUAL}, m as (select lang, avg(foreign_script_pct) as a, avg(long_outlier_pct) as b, avg(punct_char_pct) as c, avg(program_pct) as d from q group by lang)
      select lang, round(""" + " + ".join(f"coalesce({x} / nullif(max({x}) over (), 0), 0)" for x in "abcd") + ", 8) as score from m",
    "a51_causes": f"""with {QUAL}, c as (select file, corrupted_pct, coalesce(foreign_script_pct, 0) as a, coalesce(long_outlier_pct, 0) as b, coalesce(program_pct, 0) as c from q),
      w as (select *, case when a + b + c = 0 then 1.0::double else a + b + c end as whole from c)
      select file, round(a / whole * corrupted_pct, 9) as foreign, round(b / whole * corrupted_pct, 9) as long, round(c / whole * corrupted_pct, 9) as program from w""".replace(" as foreign,", ' as "foreign",'),
    "a54_group_score": f"with {LANG_VALUES}, "
    + ", ".join(
        f"u_{g} as (select {g} as g, (value - min(value) over ()) / (max(value) over () - min(value) over ()) as unit from vals where {g} is not null), "
        f"d_{g} as (select 2 * (count(*) * sum(unit * unit) - sum(unit) * sum(unit)) / (count(*) * (count(*) - 1)) as distance from u_{g} group by g having count(*) > 1)"
        for g in ("family", "genus")
    )
    + " select round(avg(score), 5) as score, count(score)::bigint as groupings from (select 1 - avg(distance) as score from d_family union all select 1 - avg(distance) from d_genus)",
    "a55_family_means": f"with {LANG_VALUES} select family, min(genus) as genus, round(avg(value), 6) as value, count(*)::bigint as languages from vals where family is not null group by family",
    "a60_break_test": f"""with {POINTS}, {_ELBOW}, one as (select lang, count(*)::bigint as n, {_RSS.format(y="y", x="x")} as rss from points group by lang),
      f as (select lang, e.x, n, rss, case when n > 4 and sse > 0 then (rss - sse) / 2 * (n - 4) / sse end as f from elbow e join one using (lang))
      select lang, x, n, round(rss, 2) as rss, round(f, 2) as f, pow(1 + 2 * f / (n - 4), -(n - 4) / 2.0::double) < 0.001 as broken from f""",
    "a69_extremes": f"""with {QUAL}, r as (select lang, file, row_number() over (partition by lang order by corrupted_pct, file) as a, row_number() over (partition by lang order by corrupted_pct desc, file) as b
      from q where corrupted_pct is not null) select lang, max(file) filter (where a = 1) as least, max(file) filter (where b = 1) as most from r group by lang""",
    "r6_several_files": f"with {FILES} select * from (select file, lang, count(*) over (partition by lang)::bigint as files from files) where files >= 2",
    "r14_labels": """select iso_code, case family when 'Indo-European' then case when genus <> '' then genus || ' (IE)' else '(IE)' end
      when 'Altaic' then case when genus <> '' then genus || ' (Alt)' else '(Alt)' end else coalesce(family, '') end as label,
      coalesce(substr(typology, 1, 3), '') as short, coalesce(name, iso_code) || case when iso_code in ('deu', 'rus') then ' (Morfo)' else '' end as shown from languages""",
    "k13_thousands": f"""with {WORDS} select lang, printf('%.1f', count(*) / 1000.0) as types from words group by lang""",
    "w8_renumbered": f"""with {QUAL}, m as (select lang, avg(foreign_script_pct) as a, avg(long_outlier_pct) as b, avg(punct_char_pct) as c, avg(program_pct) as d from q group by lang),
      r as (select lang, unnest([row_number() over (order by round(a, 8), lang), row_number() over (order by round(b, 8), lang), row_number() over (order by round(c, 8), lang), row_number() over (order by round(d, 8), lang)]) as pos from m),
      g as (select lang, avg(pos) as mean_place, min(pos)::int as best_place from r group by lang)
      select *, row_number() over (order by mean_place, best_place, lang)::int as place from g""",
    "a56_matrix": f"""with {QUAL}, v as (select """ + ", ".join(f"{n}::double as {n}" for n in MEASURES) + " from q) "
    + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as pearson from v" for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]),
    "r20_script_groups": f"""with {QUAL} select case when script = 'Latn' then 'Latin' when script = 'Cyrl' then 'Cyrillic' when script in ('Grek', 'Armn', 'Geor') then 'Other Alphabet'
      else 'Other' end as grp, count(*)::bigint as files from q where script is not null group by 1""",
    "x41_sizes": f"""with {LINES}, t as (select lang, log10(greatest(sum(frequency), 1)::double) as v from lines group by lang)
      select lang, round(5 + (v - min(v) over ()) / (max(v) over () - min(v) over ()) * 395, 4) as size from t""",
    "r19_source_groups": f"""with {LINES}, t as (select file, sum(frequency)::bigint as tokens from lines group by file)
      select case when k in ('news', 'radio', 'letters') then 'press' when k in ('wiki', 'law', 'school') then 'reference' when k in ('web', 'forum') then 'web' else 'other' end as grp,
      count(*)::bigint as files, sum(tokens)::bigint as tokens from (select *, split_part(file, '_', 2) as k from t) group by 1""",
    "r23_log_points": f"with {QUAL} select file, round(log10(total_types), 9) as x, round(log10(total_frequency), 9) as y from q where total_types > 0 and total_frequency > 0",
    "j10_named_totals": f"""with {WORDS}, t as (select lang, count(*)::bigint as types, sum(frequency)::bigint as tokens from words group by lang)
      select lang, types, tokens, coalesce(nullif(trim(name), ''), lang) as name, family from t left join languages on iso_code = lang""",
    "j14_inner_results": f"""with {WORDS}, {QUAL}, {SEG} select * from (select lang, count(*)::bigint as types from words group by lang)
      join (select lang, round(avg(punct_char_pct), 8) as punct from q group by lang) using (lang) join (select substr(file, 1, 3) as lang, count(distinct word)::bigint as segmented from seg group by 1) using (lang)""",
    "j22_script_names": f"with {QUAL} select file, case script {SCRIPT_NAMES} else script end as script from q",
    "k4_script_table": f"with {LINES}, {SCRIPT} select lang, "
    + ", ".join(f"round(coalesce(sum(letters) filter (where script = '{n}'), 0) * 100.0 / sum(letters)::double, 4) as {n.lower()}" for n in (*SCRIPTS, "Other"))
    + " from per_script group by lang",
    "k19_output_names": f"""with {FILES}, f as (select *, replace(file, '.csv', '') as stem, count(*) over (partition by lang, kind) as n from files)
      select file, lang || '-' || kind || case when n = 1 then '' else '-' || split_part(stem, '_', 3) || '-' || split_part(stem, '_', 4) end || '.csv' as name from f""",
    "x18_file_parts": rf"""with {FILES}, p as (select file, regexp_extract(file, '^(.{{3}})_([^_]+)_(\d+)_(\d+)\.csv$', ['a', 'b', 'c', 'd']) as p from files)
      select file, p.a as lang, p.b as kind, try_cast(p.c as bigint) as year, try_cast(p.d as bigint) as number from p""",
    "x44_numbers_in_lines": r"""with v as (select file, trim(split_part(regexp_replace(line, '[|;,\t]', '|', 'g'), '|', 2), ' ') as x from raw_lines where line is not null and file is not null),
      n as (select file, case when regexp_matches(x, '^[0-9]+$') then try_cast(x as bigint) end as v from v)
      select file, count(*)::bigint as lines, count(v)::bigint as numbers, coalesce(sum(v), 0)::bigint as total from n group by file""",
    "x45_endings": f"with {WORDS} select lang, right(word, 2) as ending, count(*)::bigint as words, sum(frequency)::bigint as tokens from words group by 1, 2",
}
