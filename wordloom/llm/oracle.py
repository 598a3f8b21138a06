"""SQL counterparts of the problems' queries, where SQL can express them."""

from __future__ import annotations

P1 = """
with file_lang as (
  select file, max_by(language, {'t': checked_at, 'l': language}) as language
  from quality where language is not null and file is not null group by file),
lines as (
  select file, ord, max(frequency) as frequency from raw_freq
  where frequency >= 1 and file is not null group by file, ord),
spec as (
  select language, frequency, count(*) as n from lines join file_lang using (file) group by language, frequency),
run as (
  select language, frequency,
    sum(n) over (partition by language order by frequency desc) as kept,
    sum(n) over (partition by language) as total
  from spec),
goal as (select language, max(target_pct) as pct from keep_targets group by language)
select run.language, max(frequency) as cutoff, min(kept)::bigint as kept
from run join goal using (language)
where kept * 100 >= total * pct
group by run.language
"""

# DuckDB's lower() has no final sigma; a capital sigma after a letter and before no letter is one.
_TERMS = r"""
with lines as (
  select distinct file, ord, word, frequency from raw_freq
  where word is not null and file is not null and frequency >= 1 and regexp_matches(word, '\p{L}')),
bare as (
  select file, ord, frequency,
    regexp_replace(regexp_replace(word, '^[^\p{L}\p{M}\p{N}]+', ''), '[^\p{L}\p{M}\p{N}]+$', '') as w
  from lines),
named as (
  select distinct file, ord, frequency,
    rtrim(lower(regexp_replace(w || chr(1), '(\p{L}\p{M}*)Σ([^\p{L}\p{M}])', '\1ς\2', 'g')), chr(1)) as term
  from bare),
per_file as (select substr(file, 1, 3) as lang, file, term, sum(frequency) as total from named group by file, term),
lang_files as (select lang, count(distinct file) as lang_files from per_file group by lang),
counted as (select lang, term, sum(total)::bigint as total, count(*)::bigint as files from per_file group by lang, term),
marked as (
  select c.*, case when files = 1 and total <= 2 then 'rare'
    when files >= 2 and files * 100 >= lang_files * 60 then 'common' end as mark
  from counted c join lang_files using (lang))
"""

ORACLE = {
    "p1_found": P1,
    "p5_found": _TERMS + "select lang, term, mark from marked where mark is not null",
    "p5_counts": _TERMS + "select lang, term, total, files, mark from marked",
}
