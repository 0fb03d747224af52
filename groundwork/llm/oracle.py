"""SQL for the registered queries that SQL can express."""

from groundwork.llm import lines, mixing, urls

WORD = r"[^\x20\x09-\x0D]+"

#: Runs of one up to MIN_LINES lines, each with its words; a run counts if it has all the lines, or the words.
LINES = f"""with d as (select distinct doc_id, text from documents where text is not null), l as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from d),
 n as (select *, len(regexp_extract_all(line, '{WORD}')) as words from l),
 w as ({" union all ".join(f"select doc_id, text, i, {k} as lines, [{', '.join(f'lead(line, {j}) over p' for j in range(k))}] as run, {' + '.join(f'lead(words, {j}) over p' for j in range(k))} as words from n window p as (partition by doc_id, text order by i)" for k in range(1, lines.MIN_LINES + 1))}),
 f as (select *, min((coalesce(doc_id, 9223372036854775807), i)) over (partition by run) as first from w where words is not null and (lines = {lines.MIN_LINES} or words >= {lines.MIN_WORDS})),
 gone as (select distinct doc_id, text, unnest(range(i, i + lines)) as i from f where (coalesce(doc_id, 9223372036854775807), i) > first),
 edge as (select *, i - row_number() over (partition by doc_id, text order by i) as run from gone),
 kept as (select l.doc_id, l.text, string_agg(line, chr(10) order by l.i) filter (g.i is null) as kept, count(*) as n_lines, count(g.i) as n_removed from l left join gone g on g.doc_id is not distinct from l.doc_id and g.text = l.text and g.i = l.i group by all),
 runs as (select doc_id, text, count(distinct run) as n_runs from edge group by all)
 select x.doc_id, case when x.text is not null then coalesce(k.kept, '') end as text, coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_removed, 0) as n_removed, coalesce(r.n_runs, 0) as n_runs
 from documents x left join kept k on k.doc_id is not distinct from x.doc_id and k.text = x.text left join runs r on r.doc_id is not distinct from x.doc_id and r.text = x.text"""


def _urls() -> str:
    longest = urls.in_order(urls.RULES)
    fits = [(f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')", v, h + p) for v, h, p in longest]
    case = lambda i: "case " + " ".join(f"when {f[0]} then '{f[i]}'" for f in fits) + " end"
    tag = "regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*[\"'']?canonical\\b[^>]*>')"
    return f"""with recursive a as (select page_id, html, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}'), '') as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) as rest from pages),
 n as (select *, case when host <> '' then host || case when rest = '' then '/' else rest end end as node from a),
 t as (select node, host, unnest(list_filter([regexp_extract({tag}, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1), regexp_extract(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1)], lambda x: x <> '')) as target from n where html is not null),
 u as (select node, case when starts_with(target, '//') then 'http:' || target when starts_with(target, '/') then 'http://' || host || target else target end as target from t),
 e as (select node as x, translate(regexp_extract(target, '(?s)^.*?://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') as h, regexp_extract(target, '(?s)^.*?://[^/?#]*([^#]*)', 1) as rest from u),
 g as (select x, h || case when rest = '' then '/' else rest end as y from e where h <> '' and x is not null), pair as (select x, y from g union select y, x from g),
 reach as (select x as node, x as other from pair union select r.node, b.y from reach r join pair b on b.x = r.other),
 m as (select node, regexp_extract(other, '(?s)^([^/?#]*)', 1) as host, regexp_extract(other, '(?s)^[^/?#]*([^?]*)', 1) as path from reach),
 spread as (select node, min({case(2)}) as blocked_by from m where {case(1)} = 'block' group by node)
 select page_id, host, path, {case(2)} as rule, coalesce({case(1)}, case when blocked_by is not null then 'block' end, 'allow') as verdict, case when {case(2)} is null then blocked_by end as blocked_by from n left join spread using (node)"""


MIX = f"""with recursive d as (select doc_id, source, case when source is null then '1' else '0' || source end as k, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) as size from documents),
 s as (select k, sum(size) as n, [{", ".join(map(str, mixing.WEIGHTS))}][1 + (row_number() over (order by k) - 1) % {len(mixing.WEIGHTS)}] as w from d group by k),
 r as (select 0 as turn, k, n, w, false as capped, {mixing.SHARE} * (select sum(n) from s) as whole, 0.0::double as rate from s union all
  select turn + 1, k, n, w, capped or w * level > {mixing.MOST} * n, whole, level from (select *, (whole - sum(case when capped then {mixing.MOST} * n else 0 end) over ()) / sum(case when capped then 0 else w end) over () as level from r where turn < 200) where level is distinct from rate),
 e as (select k, n, case when capped then {mixing.MOST} * n::double else w * rate end as target from r where turn = (select max(turn) from r))
 select doc_id, source, size, n::bigint as source_size, round(target, 3) as target from d join e using (k)"""

QUALITY = f"""with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) as l from documents),
 b as (select row_number() over () as r, *, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) as v from t),
 e as (select r, unnest(v) as v, generate_subscripts(v, 1) as i from b), often as (select r, i from (select *, count(*) over (partition by r, v) as n from e) where n > 1),
 rep as (select r, count(distinct i + k) as n from often, (select unnest([0, 1, 2]) as k) group by r),
 m as (select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines from b left join rep using (r)),
 f as (select *, n_words < 50 as few, 100 * n_repeat_words > 50 * n_words as often, 10 * n_symbols > n_words as symbols, n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines as dup, word_chars < 2 * n_words or word_chars > 15 * n_words as odd from m)
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, (few::int + 2 * often::int + 4 * symbols::int + 8 * dup::int + 16 * odd::int)::bigint as failed_mask, few or often as base_failed, not (few or often or symbols or dup or odd) as kept from f"""

ABLATIONS = f"""with q as ({QUALITY}), r as (select unnest(['few_words', 'repeated_words', 'many_symbols', 'repeated_lines', 'word_length']) as rule, unnest([1, 2, 4, 8, 16]) as bit)
 select rule, count(*) filter (failed_mask & bit <> 0) as n_failed, count(*) filter (failed_mask = bit) as n_kept_without from r, q group by rule"""

ORACLE = {"quality_ablations": ABLATIONS, "op3_line_dedup": LINES, "op6_url_filter": _urls(), "mixing_targets": MIX, "op9_quality": QUALITY}
