"""SQL counterparts of the registered queries."""

from __future__ import annotations

from wordloom.functions.text import ENGLISH_WORDS, SCRIPT_CODES, SCRIPTS, STRIP_CHARS, TEXT_STRIP_CHARS
from wordloom.operators.frequency import LEVELS

_STRIP = STRIP_CHARS.replace("'", "''")


def _lower(expr: str) -> str:
    """lower() with the final sigma that DuckDB's does not make."""
    return rf"rtrim(lower(regexp_replace({expr} || chr(1), '(\p{{L}}\p{{M}}*)Σ([^\p{{L}}\p{{M}}])', '\1ς\2', 'g')), chr(1))"


def _clean(expr: str) -> str:
    return _lower(f"trim({expr}, '{_STRIP}')")


LINES = """lines as (
  select distinct substr(file, 1, 3) as lang, file, ord, word, frequency from raw_freq
  where word is not null and file is not null and frequency >= 1)"""
CLEAN = rf"""cleaned0 as (select lang, file, ord, frequency, {_clean("word")} as word from lines),
cleaned as (select * from cleaned0 where regexp_matches(word, '[\p{{L}}\p{{Nl}}\p{{No}}]'))"""
WORDS = f"""{LINES}, {CLEAN},
words as (select lang, word, sum(frequency)::bigint as frequency from cleaned group by lang, word)"""
SPEC = f"""{WORDS},
spec0 as (select lang, frequency, count(*)::bigint as n from words group by lang, frequency),
spec as (select *, sum(n) over w as types_upto, sum(n * frequency) over w as tokens_upto,
  sum(n) over (partition by lang) as types, sum(n * frequency) over (partition by lang) as tokens
  from spec0 window w as (partition by lang order by frequency desc))"""
RANKED = f"""{WORDS},
ranked as (select lang, word, frequency, row_number() over w as rank, sum(frequency) over w as tokens_upto,
  sum(frequency) over (partition by lang) as tokens, count(*) over (partition by lang) as types
  from words window w as (partition by lang order by frequency desc, word rows unbounded preceding))"""
_LEVEL_LIST = ", ".join(f"({p}::double)" for p in LEVELS)
COVER = f"""{RANKED}, levels as (select * from (values {_LEVEL_LIST}) t(level)),
cover as (select lang, level, least(count(*) filter (where tokens_upto < tokens * level / 100) + 1, max(types)) as k
  from ranked, levels group by lang, level),
coverage as (select c.lang, c.level, c.k::bigint as types, sum(r.frequency)::bigint as tokens
  from cover c join ranked r on r.lang = c.lang and r.rank <= c.k group by c.lang, c.level, c.k)"""
POINTS = f"""{COVER},
points as (select lang, level as x, types * 100.0 / max(types) filter (where level = 100) over (partition by lang) as y0,
  types / (max(case when level = 100 then types end) over (partition by lang))::double * 100 as y from coverage)"""
HAPAX = rf"""{LINES},
hapax as (select distinct lang, file, word from lines where frequency = 1 and regexp_matches(word, '[\p{{L}}\p{{Nl}}\p{{No}}]')),
sizes as (select file, count(*)::bigint as hapaxes from hapax group by file)"""
PAIRS = f"""{HAPAX},
pairs0 as (select a.lang, a.file as file_a, b.file as file_b, count(*)::bigint as overlap
  from hapax a join hapax b on a.lang = b.lang and a.word = b.word and a.file < b.file group by a.lang, a.file, b.file),
pairs as (select p.*, sa.hapaxes as hapaxes_a, sb.hapaxes as hapaxes_b,
  round(overlap * 100.0::double / sa.hapaxes, 2) as share_a_pct, round(overlap * 100.0::double / sb.hapaxes, 2) as share_b_pct
  from pairs0 p join sizes sa on sa.file = file_a join sizes sb on sb.file = file_b),
placed as (select *, row_number() over (partition by lang order by greatest(share_a_pct, share_b_pct) desc, file_a, file_b) as place from pairs),
top as (select * from placed where place <= 16)"""
IGNORED = f"""{PAIRS},
steps as (select lang, list({{'v': case when share_a_pct >= share_b_pct then file_a else file_b end,
    'o': case when share_a_pct >= share_b_pct then file_b else file_a end,
    'p': greatest(share_a_pct, share_b_pct), 'ig': []::varchar[], 're': []::varchar[]}} order by place) as s
  from top where greatest(share_a_pct, share_b_pct) > 6.0 group by lang),
folded as (select lang, list_reduce(s, lambda a, e: case when list_contains(a.ig, e.v) or list_contains(a.ig, e.o) then a
    else {{'v': a.v, 'o': a.o, 'p': a.p, 'ig': list_append(a.ig, e.v), 're': list_append(a.re, printf('%.1f', e.p) || '% hapax overlap with ' || e.o)}} end,
  {{'v': '', 'o': '', 'p': 0.0::double, 'ig': []::varchar[], 're': []::varchar[]}}) as f from steps),
overlap_ignored as (select lang, unnest(f.ig) as file, unnest(f.re) as reason from folded)"""
SCRIPT_NAMES = " ".join(f"when '{code}' then '{name}'" for code, name in SCRIPT_CODES.items())
_SCRIPT_CASE = "case " + " ".join(rf"when regexp_matches(ch, '\p{{{name}}}') then '{name}'" for name in SCRIPTS) + " else 'Other' end"
SCRIPT = rf"""letters0 as (select lang, file, ord, list_filter(string_split(word, ''), lambda c: regexp_matches(c, '\p{{L}}')) as l
  from lines where ord % 5 = 0 and ord < 50000),
letters as (select lang, file, ord, unnest(list_filter(l, lambda c, i: (i - 1) % 3 = 0)) as ch from letters0),
per_script as (select lang, file, {_SCRIPT_CASE} as script, count(*)::bigint as letters, min(ord) as first_ord from letters group by 1, 2, 3),
shares as (select *, sum(letters) over (partition by file)::bigint as total_letters,
  round(letters * 100.0::double / sum(letters) over (partition by file), 2) as pct,
  row_number() over (partition by file order by letters desc, first_ord, script) as place from per_script),
lang_weight as (select lang, script, sum(total_letters * pct / 100) as weight from shares group by lang, script),
lang_scripts as (select lang, script, round(weight * 100 / sum(weight) over (partition by lang), 2) as share_pct,
  row_number() over (partition by lang order by weight desc, script) as place from lang_weight)"""
QUAL = """q as (select *, substr(file, 1, 3) as lang from (select *, row_number() over (partition by file order by checked_at desc nulls last,
  corrupted_freq_pct, corrupted_pct, eng_stopwords, foreign_script_pct, language, long_outlier_pct, long_threshold, program_pct, punct_char_pct,
  script, top20_long_pct, top20_threshold, total_frequency, total_types) as place from quality where file is not null) where place = 1)"""
SEG = r"""seg as (select distinct file, word, frequency, segmentation, annotation from segmented
  where word is not null and segmentation is not null and annotation is not null and frequency > 0),
parts as (select file, word, frequency, string_split(segmentation, '+') as morphs, string_split(annotation, '+') as ann from seg),
places as (select *, list_filter(list_transform(ann, lambda a, i: case when a = 'R' then i end), lambda i: i is not null) as rs from parts),
feat as (select file, word, frequency, morphs, ann, len(morphs)::double as n, len(rs)::double as roots,
  len(list_filter(ann, lambda a: a = 'A'))::double as affixes,
  list_transform(ann, lambda a, i: case when a = 'R' then 'root' when len(rs) > 0 and i < list_min(rs) then 'prefix'
    when len(rs) > 0 and i > list_max(rs) then 'suffix' else 'interfix' end) as roles, rs from places),
feats as (select *, len(list_filter(roles, lambda r: r = 'prefix'))::double as prefixes,
  len(list_filter(roles, lambda r: r = 'suffix'))::double as suffixes from feat)"""
_ENTROPY = "log2(sum({0})) - sum({0} * log2({0})) / sum({0})"
LANG_VALUES = f"""{LINES},
per_lang as (select lang, avg(length(word)) as value, sum(frequency)::bigint as tokens, count(*)::bigint as lines from lines group by lang),
vals as (select p.*, l.family, l.genus, l.typology from per_lang p join languages l on l.iso_code = p.lang)"""
_PARTS = ("morphs", "roots", "affixes", "prefixes", "suffixes")
_AVG = ", ".join(f"round(avg({'n' if p == 'morphs' else p}), 6) as avg_{p}, round(sum({'n' if p == 'morphs' else p} * frequency) / sum(frequency), 6) as weighted_{p}" for p in _PARTS)
_FLAGS = rf"""{LINES},
sc as (select substr(file, 1, 3) as lang, min(case regexp_extract(file, '_([A-Z][a-z]{{3}})\.tsv$', 1) {SCRIPT_NAMES} end) as script
  from segmented where file is not null group by 1),
sized as (select *, length(word) as size, length(word) - length(regexp_replace(word, '[".,?!;:/\\@#$%^&*~`<>|+=_()\[\]{{}}]', '', 'g')) as puncts from lines),
signs as (select word, unnest(string_split(word, '')) as ch, unnest(range(length(word))) as pos from (select distinct word from lines)),
told as (select word, script, count(*) as n, min(pos) as first from (select word, pos, {_SCRIPT_CASE} as script from signs where regexp_matches(ch, '\p{{L}}'))
  where script <> 'Other' group by 1, 2),
doms as (select word, script as dom from (select *, row_number() over (partition by word order by n desc, first) as place from told) where place = 1),
domi as (select s.*, coalesce(d.dom, 'Common') as dom from sized s left join doms d using (word)),
lim as (select file, quantile_cont(size, 0.75) + 3.0 * (quantile_cont(size, 0.75) - quantile_cont(size, 0.25)) as long_threshold from sized group by file),
flags as (select d.*, l.long_threshold, size > l.long_threshold as is_long, coalesce(dom <> sc.script and dom <> 'Common', false) as is_foreign,
  regexp_matches(lower(word), 'www|http') or regexp_matches(word, '[{{}}\\@]') or length(word) - length(replace(word, '.', '')) > 1
  or length(word) - length(replace(word, ',', '')) > 1 as is_program
  from domi d join lim l using (file) left join sc using (lang)),
best as (select * from (select file, size, row_number() over (partition by file order by frequency desc, ord, word) as place from sized) where place <= 20),
lim20 as (select file, quantile_cont(size, 0.75) + 1.5 * (quantile_cont(size, 0.75) - quantile_cont(size, 0.25)) as t from best group by file),
top20 as (select file, t, 100.0::double * count(*) filter (where size > t) / count(*) as pct from best join lim20 using (file) group by file, t)"""
_ENG = ", ".join(f"'{w}'" for w in ENGLISH_WORDS)

_KINDS = ("forum", "law", "letters", "news", "radio", "school", "web", "wiki")

ORACLE: dict[str, str] = {
    "s1_lists": f"with {LINES}, per as (select file, word, count(*) as n, sum(frequency) as f from lines group by file, word) "
    "select file, sum(n)::bigint as lines, count(*)::bigint as types, sum(f)::bigint as tokens from per group by file",
    "s10_sampled": f"with {LINES} select file, count(*)::bigint as sampled, sum(length(word))::bigint as characters from lines where ord % 5 = 0 and ord < 50000 group by file",
    "s21_text_words": rf"with t as (select lang, unnest(regexp_split_to_array(text, '\s+')) as w from documents where text is not null and lang is not null), "
    rf"c as (select lang, {_clean('w')} as word from t) select lang, word, count(*)::bigint as frequency from c where regexp_matches(word, '[\p{{L}}\p{{Nl}}\p{{No}}]') group by lang, word",
    "x11_text_words": rf"with t as (select lang, unnest(regexp_split_to_array(text, '\s+')) as w from documents where text is not null and lang is not null), "
    rf"c as (select lang, {_lower("trim(w, '" + TEXT_STRIP_CHARS.replace("'", "''") + "')")} as word from t) select lang, word, count(*)::bigint as frequency from c where regexp_matches(word, '[\p{{L}}\p{{Nl}}\p{{No}}]') group by lang, word",
    "s28_characters": f"with {WORDS} select distinct unnest(string_split(word, '')) as ch from words",
    "x1_clean_words": rf"with {LINES}, w as (select distinct word from lines), c as (select word, {_clean('word')} as k from w) "
    r"select word, case when regexp_matches(k, '[\p{L}\p{Nl}\p{No}]') then k end as clean, regexp_matches(word, '[\p{L}\p{Nl}\p{No}]') as has_letter from c",
    "x8_word_signs": rf"""with {LINES}, w as (select distinct word from lines) select word, length(word)::int as size,
      (length(word) - length(regexp_replace(word, '[".,?!;:/\\@#$%^&*~`<>|+=_()\[\]{{}}]', '', 'g')))::int as puncts,
      regexp_matches(lower(word), 'www|http') or regexp_matches(word, '[{{}}\\@]') or length(word) - length(replace(word, '.', '')) > 1
      or length(word) - length(replace(word, ',', '')) > 1 as program from w""",
    "x6_dominant_script": f"with {_FLAGS} select lang, dom as script, count(distinct word)::bigint as words from domi group by lang, dom",
    "x12_morph_roles": f"with {SEG} select distinct file, word, array_to_string(ann, '+') as labels, array_to_string(roles, ' ') as roles from feats",
    "x13_inline_words": rf"with {SEG}, i as (select distinct file, array_to_string(list_transform(morphs, lambda m, i: case when ann[i] = 'R' then '@' || m else m end), ' ') as inline from feats where len(morphs) = len(ann)) "
    r"select file, inline, array_to_string(list_transform(regexp_split_to_array(inline, '\s+'), lambda m: case when regexp_matches(m, '^@.') then substr(m, 2) else m end), '') as joined from i",
    "a1_merged": f"with {WORDS} select * from words",
    "a3_merge_report": rf"""with {LINES}, {CLEAN},
      k as (select *, {_clean("word")} as c, length(trim(word, '{_STRIP}')) as left_over from lines),
      per as (select lang, file, sum(frequency)::bigint as tokens_raw,
        coalesce(sum(frequency) filter (where regexp_matches(c, '[\p{{L}}\p{{Nl}}\p{{No}}]')), 0)::bigint as tokens_clean,
        count(distinct word)::bigint as types_raw, round(sum(case when left_over > 0 then frequency * (length(word) - left_over) else 0 end)::double / sum(frequency), 4) as avg_stripped from k group by lang, file),
      prs as (select distinct lang, file, word from cleaned),
      fst as (select lang, word, min(file) as file from prs group by lang, word)
      select per.*, coalesce(t.types, 0) as types, coalesce(f.new_types, 0) as new_types, types_raw - coalesce(t.types, 0) as ignored
      from per left join (select file, count(*)::bigint as types from prs group by file) t using (file)
      left join (select file, count(*)::bigint as new_types from fst group by file) f using (file)""",
    "a4_totals": f"""with {WORDS} select lang, count(*)::bigint as types, sum(frequency)::bigint as tokens, min(frequency) as least,
      count(*) filter (where frequency >= 100) as freq100_types, coalesce(sum(frequency) filter (where frequency >= 100), 0)::bigint as freq100_tokens,
      count(*) filter (where frequency >= 10) as freq10_types, coalesce(sum(frequency) filter (where frequency >= 10), 0)::bigint as freq10_tokens
      from words group by lang""",
    "a6_top_share": f"""with {RANKED}, s as (select * from (values (5), (30)) t(share_pct))
      select lang, share_pct, count(*)::bigint as types, sum(frequency)::bigint as tokens from ranked, s
      where rank <= greatest(1, floor(types * share_pct / 100.0::double)) group by lang, share_pct""",
    "w1_ranked": f"with {RANKED} select lang, word, frequency, rank, tokens_upto::bigint as tokens_upto from ranked",
    "w3_coverage": f"with {COVER} select * from coverage",
    "k7_wide_coverage": f"with {COVER} select lang, "
    + ", ".join(f"max({w}) filter (where level = {p}) as cov_{n}_{w}" for p, n in ((level, f"{level:g}".replace(".", "_")) for level in LEVELS) for w in ("types", "tokens"))
    + " from coverage group by lang",
    "w4_shares": f"with {SPEC} select lang, frequency, n, round(frequency / tokens::double, 6) as share, round(tokens_upto / tokens::double, 6) as covered from spec",
    "t2_truncated": f"with {COVER} select r.lang, word, frequency, round(frequency / tokens::double * 1e6, 3) as ppm from ranked r join cover c on c.lang = r.lang and level = 94 and rank <= k",
    "w10_truncated_by_chance": f"""with {COVER}, drawn as (select *, row_number() over (partition by lang order by frequency desc, md5(word || ':42'), word) as place from ranked)
      select r.lang, word, frequency, round(frequency / tokens::double * 1e6, 3) as ppm from drawn r join cover c on c.lang = r.lang and level = 94 and place <= k""",
    "t3_top_languages": f"with {WORDS} select lang, sum(frequency)::bigint as tokens from words group by lang order by tokens desc, lang limit 5",
    "r4_chosen_languages": f"with {WORDS} select lang, sum(frequency)::bigint as tokens from words where lang in ('nan', 'dei', 'rai') group by lang",
    "a7_hapaxes": f"with {HAPAX} select * from sizes",
    "j1_hapax_overlap": f"with {PAIRS} select * from pairs",
    "t4_top_pairs": f"with {PAIRS} select * replace (place::int as place) from top",
    "e8_overlap_ignored": f"with {IGNORED} select * from overlap_ignored",
    "a9_script_letters": f"with {LINES}, {SCRIPT} select file, script, letters from per_script",
    "a10_file_scripts": f"with {LINES}, {SCRIPT} select file, script, total_letters, pct from shares where place = 1",
    "a11_language_scripts": f"with {LINES}, {SCRIPT} select lang, script, share_pct, place::int as place from lang_scripts where place <= 2",
    "a12_quality": f"""with {_FLAGS} select f.file, round(100.0::double * count(*) filter (where is_foreign) / count(*), 4) as foreign_script_pct,
      round(100.0::double * count(*) filter (where is_long) / count(*), 4) as long_outlier_pct,
      round(100.0::double * sum(puncts * frequency) / sum(size * frequency), 4) as punct_char_pct,
      round(100.0::double * count(*) filter (where is_program) / count(*), 4) as program_pct,
      round(100.0::double * count(*) filter (where is_long or is_foreign or is_program) / count(*), 4) as corrupted_pct,
      round(100.0::double * coalesce(sum(frequency) filter (where is_long or is_foreign or is_program), 0) / sum(frequency), 4) as corrupted_freq_pct,
      (case when any_value(lang) = 'eng' then 0 else count(distinct lower(word)) filter (where lower(word) in ({_ENG})) end)::int as eng_stopwords,
      round(any_value(long_threshold), 4) as long_threshold, count(*)::bigint as total_types, sum(frequency)::bigint as total_frequency,
      round(any_value(t.t), 4) as top20_threshold, round(any_value(t.pct), 4) as top20_long_pct
      from flags f join top20 t using (file) group by f.file""",
    "a19_quality_of_all_files": f"""with {_FLAGS}, p as (select file, round(100.0::double * count(*) filter (where is_program) / count(*), 4) as program_pct, count(*)::bigint as total_types
      from flags group by file) select r.file, coalesce(program_pct, 0) as program_pct, coalesce(total_types, 0) as total_types
      from (select distinct file from raw_freq where file is not null) r left join p using (file)""",
    "a21_lexical_metrics": f"""with {RANKED} select lang, count(*)::bigint as types, sum(frequency)::bigint as tokens, round(count(*) / sum(frequency)::double, 4) as ttr,
      count(*) filter (where frequency = 1) as freq_hapax_count, round(count(*) filter (where frequency = 1) / count(*)::double, 4) as freq_hapax_ratio,
      round(avg(length(word)), 4) as mean_type_length, round(sum(length(word) * frequency) / sum(frequency)::double, 4) as mean_token_length,
      round({_ENTROPY.format("frequency::double")}, 4) as entropy, round(pow(2.0, {_ENTROPY.format("frequency::double")}), 4) as perplexity,
      round(case when count(*) > 1 then regr_slope(ln(frequency::double), ln(rank::double)) end, 4) as zipf_slope from ranked group by lang""",
    "a25_record_metrics": f"""with {LINES}, k as (select lang, word, sum(frequency)::double as f, count(*)::double as c from lines group by lang, word)
      select lang, count(*)::bigint as types, sum(f)::bigint as tokens, round(count(*) / sum(f), 4) as ttr, count(*) filter (where c = 1) as hapax_count,
      round(count(*) filter (where c = 1) / count(*)::double, 4) as hapax_ratio, count(*) filter (where f = 1) as freq_hapax_count,
      round(count(*) filter (where f = 1) / count(*)::double, 4) as freq_hapax_ratio, round(avg(length(word)), 4) as mean_type_length,
      round(sum(length(word) * f) / sum(f), 4) as mean_token_length, round({_ENTROPY.format("f")}, 4) as entropy, round(pow(2.0, {_ENTROPY.format("f")}), 4) as perplexity,
      round({_ENTROPY.format("c")}, 4) as type_entropy, round(pow(2.0, {_ENTROPY.format("c")}), 4) as type_perplexity from k group by lang""",
    "a32_morph_metrics": f"""with {SEG}, m as (select *, case when n > 0 then roots / n else 0 end as ci,
      case when least(prefixes, suffixes) > 0 then (suffixes - prefixes) / least(prefixes, suffixes) end as dev from feats)
      select file, count(*)::bigint as words, round(sum(frequency), 6) as word_tokens, round(sum(n * frequency), 6) as morph_tokens, {_AVG},
      round(avg(ci), 6) as compounding_index, round(sum(ci * frequency) / sum(frequency), 6) as weighted_compounding_index,
      round(avg(dev), 6) as affix_deviation, round(sum(dev * frequency) / sum(frequency) filter (where dev is not null), 6) as weighted_affix_deviation
      from m group by file""",
    "a35_role_metrics": f"""with {SEG}, e as (select file, frequency, unnest(morphs) as morph, unnest(ann) as a, unnest(roles) as r from feats),
      k as (select file, frequency, morph, 'root' as role from e where a = 'R' union all select file, frequency, morph, 'affix' from e where a = 'A'
        union all select file, frequency, morph, r from e where r in ('prefix', 'suffix')),
      g as (select file, role, morph, sum(frequency) as f, count(*)::double as c from k where morph is not null group by file, role, morph)
      select file, role, count(*)::bigint as morphs, round({_ENTROPY.format("f")}, 4) as entropy, round({_ENTROPY.format("c")}, 4) as type_entropy from g group by file, role""",
    "a31_inline_metrics": f"""with {SEG}, m as (select file, frequency, case when roots = 0 then 1 else roots end as r, case when roots = 0 then 0 else list_min(rs) - 1 end::double as p,
      case when roots = 0 then 0 else n - list_max(rs) end::double as s, case when roots = 0 then 0 else list_max(rs) - list_min(rs) + 1 - roots end::double as i from feats where len(morphs) = len(ann))
      select file, """
    + ", ".join(f"round(avg({c}), 6) as avg_{n}, round(sum({c} * frequency) / sum(frequency), 6) as weighted_{n}" for c, n in (("r", "roots"), ("p", "prefixes"), ("s", "suffixes"), ("i", "interfixes")))
    + " from m group by file",
    "w12_latest_quality": f"with {QUAL} select file, language, corrupted_pct, total_types from q",
    "a42_described": f"""with {QUAL} select lang, count(corrupted_pct)::bigint as count, round(avg(corrupted_pct), 10) as mean, round(stddev_samp(corrupted_pct), 10) as std,
      round(min(corrupted_pct), 10) as min, round(quantile_cont(corrupted_pct, 0.25), 10) as q1, round(quantile_cont(corrupted_pct, 0.5), 10) as median,
      round(quantile_cont(corrupted_pct, 0.75), 10) as q3, round(max(corrupted_pct), 10) as max from q group by lang""",
    "a43_histogram": f"with {QUAL} select least(floor(corrupted_pct / 5.0), 19)::int as bin, count(*)::bigint as n, least(floor(corrupted_pct / 5.0), 19) * 5.0::double as low from q where corrupted_pct between 0 and 100 group by 1, 3",
    "a45_grouped": f"""with {QUAL} select lang, count(program_pct)::bigint as n, round(avg(program_pct), 10) as mean, round(median(program_pct), 10) as median,
      round(stddev_samp(program_pct), 10) as std, count(distinct script)::bigint as scripts from q group by lang""",
    "a48_pivot": f"with {LINES} select lang, "
    + ", ".join(f"count(*) filter (where split_part(file, '_', 2) = '{k}') as {k}" for k in _KINDS)
    + f", count(*) filter (where split_part(file, '_', 2) not in {_KINDS}) as other from lines group by lang",
    "a49_row_shares": f"""with {LINES}, t as (select lang, split_part(file, '_', 2) as kind, sum(frequency)::bigint as tokens from lines group by 1, 2)
      select *, round(tokens / (sum(tokens) over (partition by lang))::double, 6) as share from t""",
    "a52_normalised": f"""with {QUAL}, m as (select lang, avg(punct_char_pct) as value from q group by lang)
      select lang, round(value, 5) as value, round((value - avg(value) over ()) / stddev_pop(value) over (), 5) as z,
      round((value - min(value) over ()) / (max(value) over () - min(value) over ()), 5) as unit from m""",
    "a53_clustering": f"with {LANG_VALUES}, "
    + ", ".join(
        f"u_{g} as (select {g} as g, (value - min(value) over ()) / (max(value) over () - min(value) over ()) as unit from vals where {g} is not null), "
        f"d_{g} as (select g, count(*) as n, 2 * (count(*) * sum(unit * unit) - sum(unit) * sum(unit)) / (count(*) * (count(*) - 1)) as distance from u_{g} group by g having count(*) > 1)"
        for g in ("family", "genus", "typology")
    )
    + " "
    + " union all ".join(
        f"select round(1 - avg(distance), 5) as score, count(*)::bigint as groups, sum(n * (n - 1) // 2)::bigint as pairs, '{g}' as grouping from d_{g}" for g in ("family", "genus", "typology")
    ),
    "a56_pearson": f"with {QUAL} select round(corr(corrupted_pct, corrupted_freq_pct), 6) as corrupted, round(corr(total_types, total_frequency), 6) as sizes from q",
    "a57_spearman": f"""with {QUAL}, v as (select lang, corrupted_pct as x, corrupted_freq_pct as y from q where corrupted_pct is not null and corrupted_freq_pct is not null),
      r as (select lang, rank() over (partition by lang order by x) + (count(*) over (partition by lang, x) - 1) / 2.0 as rx,
        rank() over (partition by lang order by y) + (count(*) over (partition by lang, y) - 1) / 2.0 as ry from v)
      select lang, count(*)::bigint as n, round(case when count(*) >= 3 and min(rx) < max(rx) and min(ry) < max(ry) then corr(rx::double, ry::double) end, 6) as spearman from r group by lang""",
    "a58_kendall": f"""with {LANG_VALUES} select count(*)::bigint as pairs, round(sum(sign(a.value - b.value) * sign(a.lines - b.lines))
      / sqrt(sum(abs(sign(a.value - b.value))) * sum(abs(sign(a.lines - b.lines)))), 6) as tau from vals a join vals b on a.lang < b.lang""",
    "a59_regression": f"""with {QUAL} select lang, round(regr_slope(log10(total_types), log10(total_frequency)), 6) as slope,
      round(regr_intercept(log10(total_types), log10(total_frequency)), 6) as intercept from q where total_types > 0 and total_frequency > 0 group by lang""",
    "a62_least_at_level": f"""with {POINTS}, r as (select x, lang, y, row_number() over (partition by x order by round(y, 6), lang) as p from points)
      select x as level, max(lang) filter (where p = 1) as lang, round(min(y), 6) as least, round(median(y), 6) as median from r group by x""",
    "w13_crossing": f"""with {POINTS}, l as (select lang, x, y, lead(x) over w as x2, lead(y) over w as y2 from points window w as (partition by lang order by x))
      select lang, round(min(x + (10.0 - y) / (y2 - y) * (x2 - x)), 4) as at from l where y < 10 and y2 >= 10 group by lang""",
    "w16_suffix_slopes": f"""with {QUAL}, pts as (select file, lang, round(log10(total_frequency), 3) as x, log10(total_types) as y from q where total_types > 0 and total_frequency > 0)
      select a.file, round((select case when count(*) * sum(b.x * b.x) - sum(b.x) * sum(b.x) <> 0 then regr_slope(b.y, b.x) end from pts b where b.lang = a.lang and b.x > a.x), 3) as slope_after from pts a""",
    "w15_sign_changes": f"""with {POINTS}, m as (select x, median(y) as m from points group by x),
      v as (select lang, x, round(y - m, 9) as v from points join m using (x)),
      l as (select *, lag(v) over (partition by lang order by x) as b from v) select lang, x as level from l where b * v < 0""",
    "w18_nearest": f"""with {QUAL}, r as (select lang, file, round(abs(corrupted_pct - 2.0), 6) as gap, row_number() over (partition by lang order by round(abs(corrupted_pct - 2.0), 6), file) as p
      from q where corrupted_pct is not null) select lang, file, gap from r where p = 1""",
    "w7_ranking": f"""with {LANG_VALUES}, v as (select lang, round(value, 2) as value from vals)
      select lang, value, rank() over (order by value desc)::int as min_rank, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0::double as avg_rank,
      row_number() over (order by value desc, lang)::int as place from v""",
    "a68_deviating": """with c as (select family, typology, count(*) as n from languages where family is not null and typology is not null group by 1, 2),
      m as (select family, typology as usual from (select *, row_number() over (partition by family order by n desc, typology) as p from c) where p = 1)
      select iso_code, family, typology, usual from languages join m using (family) where typology <> usual""",
    "a63_differences": """with b as (select file, max(corrupted_pct) - min(corrupted_pct) as diff from quality where file is not null and corrupted_pct is not null group by file having count(*) > 1)
      select count(*)::bigint as files, round(avg(diff), 10) as mean, round(median(diff), 10) as median, round(max(diff), 10) as most, count(*) filter (where diff > 1) as over from b""",
    "j3_results": f"""with {WORDS}, {QUAL}, {SEG}, t as (select lang, count(*)::bigint as types, sum(frequency)::bigint as tokens from words group by lang),
      s as (select lang, avg(corrupted_pct) as corrupted_pct, count(*)::bigint as files from q group by lang),
      m as (select substr(file, 1, 3) as lang, regexp_extract(file, '^.{{3}}_([^-]+)-', 1) as segmentor, avg(n) as avg_morphs, avg(roots / n) as compounding_index from feats group by file)
      select t.lang, types, tokens, round(corrupted_pct, 5) as corrupted_pct, files, name, family, segmentor, round(avg_morphs, 5) as avg_morphs, round(compounding_index, 5) as compounding_index
      from t left join s using (lang) left join languages l on l.iso_code = t.lang left join m on m.lang = t.lang""",
    "j18_code_of_names": """select entry_id, coalesce(code, iso_code) as code from lepzig_shortcuts join languages on language = name""",
    "e1_code_sets": """with l as (select distinct iso_code as code from languages), u as (select distinct substr(file, 1, 3) as code from raw_freq where file is not null)
      select code, 'both' as kind from l where code in (select code from u) union all select code, 'only_listed' from l where code not in (select code from u)
      union all select code, 'only_used' from u where code not in (select code from l) union all select code, 'either' from (select code from l union select code from u)""",
    "t5_largest": f"""with {LINES}, t as (select lang, file, sum(frequency)::bigint as tokens from lines group by lang, file)
      select * from (select *, row_number() over (partition by lang order by tokens desc, file)::int as place from t) where place <= 5""",
    "u4_segmented_by_two": rf"""with {WORDS}, p as (select lang, frequency, unnest(case when length(word) > 1 then list_filter(list_transform(range(0, (length(word) + 1) // 2), lambda i: substr(word, (2 * i + 1)::bigint, 2)), lambda x: trim(x) <> '') else [word] end) as part from words),
      c as (select lang, frequency, {_clean("part")} as word from p) select lang, word, sum(frequency)::bigint as frequency from c where regexp_matches(word, '[\p{{L}}\p{{Nl}}\p{{No}}]') group by lang, word""",
}
