"""SQL for DuckDB, written apart from the Spark code; keys as in ``queries``."""

from __future__ import annotations

from checks.views import with_views

NAME = r"regexp_extract({p}, '([^/]*)$', 1)"


def base(p="source_path"):
    return f"regexp_extract({p}, '([^/]*)$', 1)"


def ext(p="source_path"):
    return f"regexp_extract({p}, '([.][^./]*)$', 1)"


def stem(p="source_path"):
    return f"regexp_replace({base(p)}, '[.][^.]*$', '')"


def rel():
    return "substr(source_path, length(root_dir) + 2)"


def quarantine(sha="sha256"):
    return (
        f"concat(root_dir, '/duplicates/', {stem()}, '_', {sha}[1:8], '_', "
        f"sha1(source_path)[1:6], {ext()})"
    )


QUARANTINED = f"source_path = concat(root_dir, '/duplicates/', {base()})"

ORACLES: dict[str, str] = {}


def oracle(key: str, body: str) -> None:
    ORACLES[key] = with_views(body)


# --- duplicates -----------------------------------------------------------

oracle(
    "dedupe_plan",
    f"""
with h as (select root_dir, source_path, size, sha256(text) sha256 from v_docs),
r as (select *, row_number() over (partition by sha256 order by split(source_path, '/')) rn from h)
select root_dir, source_path, size, 'dedupe' op_type, {quarantine()} dest_path from r where rn > 1""",
)
oracle(
    "dedupe_full_plan",
    f"""
with h as (select root_dir, source_path, size, sha256(text) sha256, {QUARANTINED} q from v_mix),
r as (select *, row_number() over (partition by sha256, q order by split(source_path, '/')) rn from h)
select root_dir, source_path, size,
  case when not q and rn > 1 then 'dedupe' else 'skip' end op_type,
  case when not q and rn > 1 then {quarantine()} end dest_path from r""",
)
oracle(
    "hash_partial",
    "select source_path, sha256(encode(text)[1:4096]) partial_sha256 from v_docs",
)
oracle("hash_full", "select source_path, size, sha256(html) sha256 from v_pages")
oracle(
    "size_groups",
    "select size, count(*) n_files, cast(sum(size) as bigint) total_bytes from v_line group by size",
)
oracle(
    "partial_groups",
    """select size, sha256(encode(text)[1:4096]) partial_sha256, count(*) n_files,
  cast(sum(size) as bigint) total_bytes from v_docs group by all""",
)
oracle(
    "dup_groups",
    """select sha256(text) sha256, count(*) n_files, cast(sum(size) as bigint) total_bytes,
  arg_min(source_path, split(source_path, '/')) keeper
from v_docs group by 1 having count(*) > 1""",
)
oracle(
    "dup_candidates",
    """
with h as (select source_path, size, sha256(encode(text)[1:4096]) partial_sha256 from v_docs)
select * from h where (size, partial_sha256) in
  (select (size, partial_sha256) from h group by size, partial_sha256 having count(*) > 1)""",
)
oracle(
    "hash_missing",
    """select root_dir, source_path, size from v_docs
where doc_id not in (select doc_id from labels)""",
)

# --- rules and classification ---------------------------------------------

SP = r"[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def trimmed(x):
    return f"regexp_replace(regexp_replace({x}, '^{SP}+', ''), '{SP}+$', '')"


def lines_of(source, key="file_key"):
    """(key, line_no, line) of whole texts."""
    return f"""(select {key}, i line_no, regexp_replace(ls[i], '\\r$', '') line
  from (select {key}, string_split(text, chr(10)) ls from {source}),
  lateral (select unnest(range(1, len(ls) + 1)) i))"""


def rule_ctes(files):
    return f"""
l as (select file_key, cast(line_no as int) line_no, line, strpos(line, '=') eq,
  starts_with(line, '#') or starts_with(line, '//') or {trimmed('line')} = '' comment,
  starts_with(line, '!') bang from {lines_of(files)}),
r as (select file_key, line_no, {trimmed('line[1:eq-1]')} folder, string_split(line[eq+1:], ',') ks
  from l where not comment and not bang and eq > 0 and {trimmed('line[1:eq-1]')} <> ''),
m as (select file_key, line_no, folder, cast(i-1 as int) matcher_idx, {trimmed('ks[i]')} k
  from r, lateral (select unnest(range(1, len(ks)+1)) i)),
c as (select *, starts_with(k, 'regex(') o, ends_with(k, ')') e from m),
v as (select file_key, line_no, matcher_idx, case when o then k[7:len(k)-1] else k end raw, o is_regex
  from c where k <> '' and (not o or e))"""


oracle(
    "rules_load",
    f"""with {rule_ctes('v_rulefiles')}
select r.file_key, r.line_no rule_idx, matcher_idx, folder, raw, coalesce(is_regex, false) is_regex
from r left join v using (file_key, line_no)""",
)
oracle(
    "rules_list",
    f"""with {rule_ctes('v_rulefiles')}
select r.file_key, r.line_no rule_idx, folder,
  coalesce(string_agg(case when is_regex then 'regex(' || raw || ')' else raw end, ', ' order by matcher_idx), '') matchers
from r left join v using (file_key, line_no) group by all""",
)
oracle(
    "rules_ignores",
    f"""with {rule_ctes('v_rulefiles')}
select file_key, line_no, {trimmed('line[2:]')} pattern from l where bang""",
)
# The wording of warnings, and of error classes further down.
oracle(
    "rules_warnings",
    f"""with src as (select file_key, text from v_rulefiles union all select -doc_id-1, text from documents),
{rule_ctes('src')}
select file_key, line_no, -1 matcher_idx, concat('line ', line_no, ' ignored: missing ''=''') message
  from l where not comment and not bang and eq = 0
union all select file_key, line_no, -1, concat('line ', line_no, ' ignored: empty folder name')
  from l where not comment and not bang and eq > 0 and {trimmed('line[1:eq-1]')} = ''
union all select file_key, line_no, matcher_idx, concat('line ', line_no, ': ',
    case when k = '' then concat('empty matcher in folder "', folder, '"')
      else concat('malformed regex matcher "', replace(replace(k, '\\', '\\\\'), '"', '\\"'), '"') end)
  from c where k = '' or (o and not e)""",
)
ORACLES["rules_inline"] = """
with k as (select p_partkey, p_type folder, list_concat(string_split(p_name, ' '), ['']) ws, p_brand from part),
m as (select p_partkey, folder, cast(2*(i-1) as int) matcher_idx, ws[i] raw, false is_regex
  from k, lateral (select unnest(range(1, len(ws))) i)
  union all select p_partkey, folder, cast(2*(len(ws)-2)+1 as int), '^' || p_brand || '$', true from k)
select p_partkey, 0 rule_idx, matcher_idx, folder, raw, is_regex from m"""

CLASSIFIED = f"""
with f as (select *, {base()} name from v_part),
d as (select *, case when contains(name,'ring') or contains(name,'rod') then 'Pipes'
  when regexp_matches(name,'^cold.*[.]pdf$') then 'Papers' when contains(name,'*') then 'Misc'
  when contains(name,'hot') then 'Hot' else 'Rest' end folder from f)
select root_dir, source_path, size, 'move' op_type, concat(root_dir,'/',folder,'/',name) dest_path from d"""
oracle("classify_case", CLASSIFIED)
oracle("classify_join", CLASSIFIED)
oracle(
    "classify_table",
    f"""
with f as (select *, {base()} name from v_part),
n as (select distinct name from f),
hit as (select name, min(struct_pack(a := rule_idx, b := matcher_idx, c := folder)) h from n, v_partrules
  where case when is_regex then regexp_matches(name, raw) else contains(name, raw) end group by name),
s as (select max(struct_pack(a := rule_idx, b := matcher_idx, c := folder)) h from v_partrules where raw = '*'),
d as (select f.*, coalesce(hit.h.c, (select h.c from s)) folder from f left join hit using (name))
select root_dir, source_path, size, case when folder is null then 'skip' else 'move' end op_type,
  case when folder is not null then concat(root_dir,'/',folder,'/',name) end dest_path from d""",
)


def in_both_forms(key):
    return f"select * from (select unnest(['auto', 'join']) form), ({ORACLES[key]})"


ORACLES["classify_auto_large"] = in_both_forms("classify_table")
oracle(
    "classify_auto",
    f"""
with f as (select *, {base()} name, case root_dir when '/' then '' when '/data/' then '/data' else root_dir end r,
  case root_dir when '/' then '' when '/data/' then '' else 's3://bkt' end up from v_roots),
d as (select *, case when contains(name, '_1') then r || '/a/b/' || name when contains(name, '7.t') then up || '/up/' || name
  when regexp_matches(name, '[13579][.]txt$') then r || '/odd/' || name end dest from f)
select root_dir, source_path, size, case when dest is null then 'skip' else 'move' end op_type, dest dest_path, form
from d, (select unnest(['auto', 'join']) form)""",
)

# --- filters and ignore rules ---------------------------------------------

oracle(
    "filter_hidden",
    f"""select root_dir, source_path, size from v_mix
where len(list_filter(string_split({rel()}, '/'), lambda s: starts_with(s, '.'))) = 0""",
)
oracle(
    "filter_depth",
    f"select root_dir, source_path, size from v_mix where len(string_split({rel()}, '/')) - 1 <= 2",
)
oracle(
    "filter_quarantine",
    f"select root_dir, source_path, size from v_mix where not ({QUARANTINED})",
)
oracle(
    "filter_ignore",
    f"""select root_dir, source_path, size from v_line
where not starts_with({rel()}, 'A/F/') and not regexp_matches({rel()}, '^R/[^/]*/li_1[^/]*[.]dat(/|$)')""",
)
RULE_PARTS = """select ord, pattern, source, regexp_replace(pattern, '^/', '') lit,
  starts_with(pattern, '/') or contains(pattern, '/') is_path,
  concat('^', replace(replace(replace(regexp_replace(pattern, '^/', ''), '.', '[.]'), '*', '[^/]*'), '?', '[^/]'), '$') rx from v_mixrules"""
RULE_HIT = """case when is_path then regexp_matches(rel, rx) or (is_dir and (rel = lit or starts_with(rel, lit || '/')))
    else regexp_matches(name, rx) or (is_dir and starts_with(name, lit)) end"""

oracle(
    "filter_ignore_join",
    f"""
with f as (select root_dir, source_path, size, string_split({rel()}, '/') ps from v_mix),
e as (select source_path, array_to_string(ps[1:i], '/') rel, ps[i] name, i < len(ps) is_dir
  from f, lateral (select unnest(range(1, len(ps) + 1)) i)),
d as (select distinct rel, name, is_dir from e),
p as (select distinct lit, is_path, rx from ({RULE_PARTS})),
hit as (select distinct rel, is_dir from d, p where {RULE_HIT}),
hidden as (select distinct source_path from e join hit using (rel, is_dir))
select root_dir, source_path, size from f where source_path not in (select source_path from hidden)""",
)
oracle(
    "ignore_explain_table",
    f"""
with f as (select source_path, string_split({rel()}, '/') ps from v_mix),
e as (select distinct array_to_string(ps[1:i], '/') rel, ps[i] name, i < len(ps) is_dir
  from f, lateral (select unnest(range(1, len(ps) + 1)) i)),
p as ({RULE_PARTS}),
hit as (select rel, is_dir, arg_min(pattern, ord) pattern, arg_min(source, ord) source from e, p where {RULE_HIT} group by all)
select '/data' root_dir, '/data/' || rel source_path, is_dir, pattern, source from e left join hit using (rel, is_dir)""",
)
ORACLES["ignore_auto"] = in_both_forms("filter_ignore_join")
oracle(
    "roots_quarantine",
    "select root_dir, source_path, size from v_roots where doc_id % 7 <> 2",
)
oracle(
    "roots_rename",
    f"""
with f as (select *, {base()} name, row_number() over (partition by new_name order by string_split(source_path, '/')) n from v_roots),
d as (select *, case n when 1 then new_name else replace(new_name, '.txt', '_v' || (n - 1) || '.txt') end final from f)
select root_dir, source_path, size, 'rename' op_type, left(source_path, len(source_path) - len(name)) || final dest_path from d""",
)
oracle(
    "ignore_explain",
    f"""
with e as (select root_dir, source_path, size from v_mix union all select root_dir, source_path, size from v_part),
x as (select *, {rel()} rel, {base()} name from e),
r as (select *, case when ends_with(name, '.tmp') then '*.tmp' when name = 'promo' then 'promo'
  when rel = 'src1' then '/src1' when regexp_matches(rel, '^src2/[^/]*[.]txt$') then 'src2/*.txt'
  when regexp_matches(name, '^doc_1.[.]txt$') then 'doc_1?.txt' when name = 'build' then 'build'
  when regexp_matches(rel, '^s[^/]*/e[^/]/[^/]*$') then 's*/e?/*' end pattern from x)
select root_dir, source_path, size, pattern, case when pattern is not null then 'config' end source from r""",
)


def ignore_lines():
    return f"""
d as (select file_ord, line_no, regexp_replace({trimmed('line')}, '/$', '') pattern, source
  from (select doc_id file_ord, source, cast(line_no as int) line_no, line
    from {lines_of('documents', 'doc_id')} join documents using (doc_id))
  where {trimmed('line')} <> '' and not starts_with({trimmed('line')}, '#') and not starts_with({trimmed('line')}, '//'))"""


FIRST = "select min(cast(file_ord as bigint) * 4294967296 + line_no) ord, pattern, source from {src} group by all"

oracle(
    "ignore_load",
    f"""with {rule_ctes('v_rulefiles')}, {ignore_lines()},
a as (select 0 file_ord, line_no, regexp_replace({trimmed('line[2:]')}, '/$', '') pattern, 'config' source
  from l where bang and {trimmed('line[2:]')} <> '' union all select * from d)
{FIRST.format(src='a')}""",
)
oracle(
    "ignore_sources",
    f"""with {rule_ctes('v_rulefiles')},
g as (select ord, pattern, lang from v_mixrules join documents on doc_id = ord),
i as (select *, sum(case when ord % 7 = 0 and ord % 13 <> 0 then 2 else 1 end) over (partition by lang order by ord)
    - case when ord % 7 = 0 and ord % 13 <> 0 then 1 else 0 end line_no, dense_rank() over (order by lang) + 1 file_ord from g),
a as (select 0 file_ord, line_no, regexp_replace({trimmed('line[2:]')}, '/$', '') pattern, 'config' source
  from l where bang and {trimmed('line[2:]')} <> ''
  union all select file_ord, line_no, pattern, 'lang=' || lang from i where ord % 13 <> 0)
{FIRST.format(src='a')}""",
)
ORACLES["ignore_dedupe"] = f"with {ignore_lines()} {FIRST.format(src='d')}"

# --- plans and catalogs ---------------------------------------------------

PART_MOVED = f"""p as (select root_dir, source_path, size,
    case when {base()} like '%ring%' or {base()} like '%rod%' then concat('/data/Pipes/', {base()})
      when regexp_matches({base()}, '^cold.*[.]pdf$') then concat('/data/Papers/', {base()}) end dest_path
  from v_part)"""

LINE_MOVED = f"""c as (select *, {base()} name, replace({rel()}, '/', '_') own from v_line),
m as (select *, case when contains(name, '_1.dat') then '/data/ones/' || own
  when regexp_matches(name, '_[357][.]dat$') then '/data/odd/deep/' || own
  when contains(name, 'li_12') then '/data/' || own end dest from c),
p as (select root_dir, source_path, size,
  case when dest is null then 'skip' when size < 2000000 then 'delete' else 'move' end op_type,
  case when size >= 2000000 then dest end dest_path from m)"""

oracle(
    "plan_effective",
    f"""
with p as (select root_dir, source_path, size, 'move' op_type,
    concat(case when {base()} like '%ring%' then '/data/promo/' when {base()} like '%bolt%' then '/data/economy/'
      when {base()} like '%gear%' then '/out/' end, {base()}) dest_path, {base()} name from v_part)
select root_dir, source_path, size, op_type, dest_path from p
where dest_path <> name and dest_path <> source_path""",
)
oracle(
    "plan_summary",
    f"""with {LINE_MOVED}
select op_type, count(*) n_ops from p group by 1 union all select 'total', count(*) from p""",
)
oracle(
    "apply_summary",
    f"""with {LINE_MOVED}
select count(*) filter (op_type = 'move' and dest_path <> source_path) moved, cast(0 as bigint) renamed,
  cast(0 as bigint) deduped, count(*) filter (op_type = 'delete') deleted,
  count(*) filter (op_type = 'skip') skipped from p""",
)
oracle(
    "plan_ordered",
    f"""with {PART_MOVED}
select root_dir, source_path, size, case when dest_path is null then 'skip' else 'move' end op_type, dest_path,
  row_number() over (order by source_path, coalesce(dest_path, '.'), case when dest_path is null then 4 else 0 end, size) op_seq
from p""",
)
oracle(
    "plan_planners",
    f"""
with f as (select *, {rel()} rel, {base()} name from v_mix)
select root_dir, source_path, size, 'move' op_type, concat('/data/Rest/', name) dest_path from f
where not regexp_matches(rel, '(^|/)[.]') and not regexp_matches(rel, '(^|/)build[^/]*/')
  and not starts_with(rel, 'src1/') and not regexp_matches(rel, '^src2/[^/]*[.]txt$')""",
)
ORACLES["sort_files"] = ORACLES["plan_planners"]
oracle(
    "plan_pipeline",
    f"""
with f as (select *, {rel()} rel, {base()} name from v_mix),
k as (select 1 from f where not regexp_matches(rel, '(^|/)[.]') and not regexp_matches(rel, '(^|/)build[^/]*/')
  and not starts_with(rel, 'src1/') and not regexp_matches(rel, '^src2/[^/]*[.]txt$'))
select 'move' op_type, count(*) n_ops from k union all select 'total', count(*) from k""",
)
oracle(
    "plan_apply",
    f"""with {LINE_MOVED}
select root_dir, coalesce(dest_path, source_path) source_path, size from p where op_type <> 'delete'""",
)

MIX_AFTER = f"""h as (select root_dir, source_path, size, sha256(text) sha256, {QUARANTINED} q from v_mix),
r as (select *, row_number() over (partition by sha256, q order by split(source_path, '/')) rn from h),
a as (select root_dir, case when not q and rn > 1 then {quarantine()} else source_path end source_path, size from r)"""

oracle(
    "dup_purge",
    f"""with {MIX_AFTER}
select root_dir, source_path, size from a where not starts_with(source_path, '/data/duplicates/')""",
)
oracle(
    "dup_purge_count",
    f"""with {MIX_AFTER}
select root_dir, count(distinct split_part(source_path, '/', 4)) n_entries from a
where starts_with(source_path, '/data/duplicates/') group by 1""",
)


oracle(
    "apply_summary_purged",
    f"""with {MIX_AFTER}
select cast(0 as bigint) moved, cast(0 as bigint) renamed, (select count(*) from r where not q and rn > 1) deduped,
  count(distinct split_part(source_path, '/', 4)) filter (starts_with(source_path, '/data/duplicates/')) deleted,
  (select count(*) from r where q or rn = 1) skipped from a""",
)


def dirs_of(source):
    return f"""(select distinct root_dir, root_dir || '/' || array_to_string(ps[1:i], '/') dir
  from (select root_dir, string_split({rel()}, '/') ps from {source}),
  lateral (select unnest(range(1, len(ps))) i))"""


oracle(
    "dirs_emptied",
    f"""
with b as (select root_dir, source_path from v_conv union all select root_dir, source_path from v_pages),
a as (select root_dir, case when regexp_matches({base()}, '^[0-3]_|^page_[0-9]*[0-4][.]html$') then '/data/moved/x'
  else source_path end source_path from b)
select * from {dirs_of('b')} except select * from {dirs_of('a')}""",
)

# --- reports --------------------------------------------------------------


def human(n):
    steps = "".join(
        f" when {n} < {1024 ** (i + 2)} then printf('%.1f {u}B', {n} / {float(1024 ** (i + 1))})"
        for i, u in enumerate("KMGTP")
    )
    return f"case when {n} < 1024 then {n} || ' B'{steps} end"


oracle(
    "top_largest",
    f"""select {rel()} rel_path, size, {human('size')} human_size from v_line
order by size desc, source_path limit 5""",
)
oracle(
    "human_sizes",
    f"""
with f as (select source_path, size from v_line union all select source_path, size from v_docs),
s as (select source_path, case when size % 3 = 0 then size * 1000003 else size end n from f)
select source_path, {human('n')} human_size from s""",
)
oracle(
    "walk_order",
    "select *, row_number() over (order by split(source_path, '/')) walk_seq from v_line",
)
oracle(
    "path_parts",
    f"""
with f as (select source_path, root_dir from v_part union all select source_path, root_dir from v_pages)
select source_path, {base()} base, regexp_replace(source_path, '/[^/]*$', '') parent, {ext()} ext, {stem()} stem,
  cast(len(string_split({rel()}, '/')) - 1 as int) depth,
  concat(regexp_replace(source_path, '/[^/]*$', ''), '/', {stem()}, '/x') cleaned from f""",
)
oracle(
    "error_breakdown",
    """
with e as (select *, case when msg like '%permission denied%' then 'permission' when lower(msg) like '%file exists%' then 'collision'
  when msg like '%no such file%' then 'not_found' when msg like '%directory not empty%' then 'dir_not_empty'
  when msg like '%invalid%' then 'invalid' else 'other' end category from v_err)
select category, count(*) n_errors, arg_min(msg, seq) example from e group by 1""",
)

# --- history --------------------------------------------------------------

oracle("txn_append", "select * from v_log")
oracle(
    "txn_read",
    """select txn_seq, id, ttype, irreversible, cast(0 as bigint) op_seq, 'move' op_type, root_dir, source_path,
  txn_seq * 10 size, dest_path from v_txn""",
)
oracle(
    "txn_nested",
    """select * replace (row_number() over (partition by txn_seq order by op_seq, root_dir, source_path, size, dest_path) - 1 as op_seq)
from v_log""",
)
oracle(
    "txn_import",
    """select row_number() over (order by txn_seq) - 1
    + count(*) filter (txn_seq % 5 = 0) over (order by txn_seq rows between unbounded preceding and 1 preceding) txn_seq,
  id, ttype, irreversible, cast(0 as bigint) op_seq, 'move' op_type, root_dir, source_path, txn_seq * 10 size, dest_path from v_txn""",
)
oracle(
    "txn_commit",
    f"""with {PART_MOVED}
select cast(case when dest_path is null then 0 else 1 end as bigint) txn_seq, case when dest_path is null then 'first' else 'second' end id,
  0 ttype, dest_path is not null irreversible,
  row_number() over (order by source_path, coalesce(dest_path, '.'), case when dest_path is null then 4 else 0 end, size) op_seq,
  case when dest_path is null then 'skip' else 'move' end op_type, root_dir, source_path, size, dest_path from p""",
)
oracle(
    "history_nested",
    """select txn_seq, id, replace(id, ' ', '_') compact_id, case when ttype = 1 then 'undo' else 'action' end type,
  count(*) n_operations, min(root_dir) root_dir from v_log group by all""",
)
oracle(
    "history_flat",
    """select txn_seq, id, replace(id, ' ', '_') compact_id, case when ttype = 1 then 'undo' else 'action' end type,
  count(*) n_operations, min(root_dir) root_dir from v_log group by all""",
)
oracle(
    "history_list",
    """select txn_seq, id, id compact_id, case when ttype = 1 then 'undo' else 'action' end type,
  cast(1 as bigint) n_operations, root_dir from v_txn""",
)
LAST = """t as (select distinct txn_seq, id, ttype, irreversible, root_dir, count(*) over (partition by txn_seq) n_operations from v_log),
lt as (select root_dir, txn_seq, id, ttype, irreversible, n_operations,
  case when ttype = 1 then 'already_undone' when irreversible then 'irreversible' else 'undoable' end status
  from t where (root_dir, txn_seq) in (select (root_dir, max(txn_seq)) from t group by root_dir))"""
oracle("last_txn", f"with {LAST} select * from lt")
oracle(
    "undo_plan",
    f"""with {LAST}
select txn_seq, op_seq, op_type, root_dir, dest_path source_path, size, source_path dest_path
from v_log where txn_seq in (select txn_seq from lt where status = 'undoable')""",
)
oracle(
    "undo_log",
    f"""with {LAST},
n as (select txn_seq old, (select max(txn_seq) from v_log) + row_number() over (order by txn_seq) new from lt where status = 'undoable')
select new txn_seq, id, 1 ttype, irreversible, op_seq, op_type, root_dir, source_path, size, dest_path
from v_log join n on txn_seq = old""",
)

# --- renames --------------------------------------------------------------

oracle(
    "rename_map",
    f"select root_dir, source_path, size, case when trim(new_name, ' \t') = '' then {base()} else new_name end new_name from v_chats",
)
oracle(
    "rename_collisions",
    f"""
with r as (select *, row_number() over (partition by {base()} order by split(source_path, '/')) - 1 k from v_conv)
select root_dir, source_path, size, 'rename' op_type, concat(regexp_replace(source_path, '/[^/]*$', ''), '/',
  case when k = 0 then {base()} else concat({stem()}, '_v', k, {ext()}) end) dest_path from r""",
)

oracle(
    "rename_versions",
    # Step i settles the i-th file of every name family; families never meet.
    """
with recursive f as (select *, regexp_extract(new_name, '([.][^.]*)$', 1) e, regexp_replace(new_name, '[.][^.]*$', '') s from v_versions),
g as (select *, row_number() over (partition by fam order by split(source_path, '/')) i
  from (select *, regexp_replace(s, '(_v[1-9][0-9]*)+$', '') || e fam from f)),
w as (
  select fam, cast(0 as bigint) i, cast([] as varchar[]) seen, '' source_path, '' nn from (select distinct fam from g)
  union all
  select fam, i, list_append(seen, nn), source_path, nn from (
    select g.fam, g.i, w.seen, g.source_path, case when not list_contains(w.seen, new_name) then new_name else
      list_filter(list_transform(range(1, len(w.seen) + 2), lambda k: s || '_v' || k || e), lambda x: not list_contains(w.seen, x))[1] end nn
    from w join g on g.fam = w.fam and g.i = w.i + 1))
select root_dir, source_path, size, 'rename' op_type, concat(regexp_replace(source_path, '/[^/]*$', ''), '/', nn) dest_path
from v_versions join w using (source_path)""",
)


def replaced(x, *steps):
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


# Words, abbreviations and patterns of the naming rules, here and below.
TOKENS = replaced(
    "stem",
    (r"(\p{Ll})(\p{Lu})", r"\1_\2"),
    (r"(\p{Lu}+)(\p{Lu}\p{Ll})", r"\1_\2"),
    (r"(?i)[(]([0-9]+|copy)[)]", ""),
    (r"(?i)(^|[_ .-])fall[_ ]?s(?:em)?[_ ]?(?:20)?([0-9]{2})-(?:20)?([0-9]{2})", r"\1F\2~~\3"),
    (r"(?i)(^|[_ .-])winter[_ ]?s(?:em)?[_ ]?(?:20)?([0-9]{2})-(?:20)?([0-9]{2})", r"\1W\2~~\3"),
    (r"(?i)(^|[_ .-])sem(?:ester)?[_ .-]*0*([0-9]+)", r"\1S\2"),
    (r"(^|[^0-9])((?:19|20)[0-9]{2})-(?:19|20)([0-9]{2})($|[^0-9])", r"\1\2_\3\4"),
    (r"[ \t\n._-]+", "_"),
    (r"(?i)(^|_)copy_of(_|$)", "_"),
    (r"(?i)^_?microsoft_word(_|$)", "_"),
    (r"(?i)(^|_)question_paper(_|$)", r"\1QP\2"),
)
oracle(
    "normalize_names",
    f"""
with a as (select p_partkey, name, regexp_extract(name, '([.][^.]*)$', 1) ext, regexp_replace(name, '[.][^.]*$', '') stem from v_names),
t as (select *, list_filter(string_split({TOKENS}, '_'), lambda x: x <> '') ts from a),
g as (select *, list_position(list_transform(ts, lambda x: lower(x) not in ('department','university','institute',
  'college','school','faculty','part','chapter','section','introduction')), true) pos from t),
d as (select *, case when len(ts) > 6 and pos > 1 then ts[pos:] else ts end us from g),
c as (select *, list_filter(us, lambda x: lower(x) not in ('copy','final','draft','new','document','file','download','backup')
  and (not regexp_matches(x, '^[0-9]{{6,}}$') or regexp_matches(x, '^(19|20)[0-9]{{2}}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])$'))) vs from d),
w as (select *, list_transform(vs, lambda x: case when regexp_matches(x, '^([FW][0-9]{{2}}~~[0-9]{{2}}|S[0-9]+|QP|v[0-9]+)$') then x
  when lower(x) = 'assignment' then 'Asn' when lower(x) = 'experiment' then 'Exp' when lower(x) = 'laboratory' then 'Lab'
  when lower(x) in ('semester', 'sem') then 'S' when lower(x) = 'project' then 'Proj' when lower(x) = 'syllabus' then 'Syl'
  when lower(x) = 'introduction' then 'Intro' when upper(x) in ('OS','DSA','TCP','AI','DBMS','LAB','ID','API','JSON') then upper(x)
  else upper(x[1]) || lower(x[2:]) end) ws from c),
j as (select *, replace(array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i), '_'), '~~', '-') new from w)
select p_partkey, name, case when new = '' then name else new || ext end new_name from j""",
)

# --- hash cache -----------------------------------------------------------

ORACLES["dedupe_incremental"] = ORACLES["dedupe_plan"]
oracle(
    "dedupe_stats",
    """
with h as (select size, sha256(encode(text)[1:4096]) p, sha256(text) s,
    doc_id in (select doc_id from labels where toxic = 0) hit from v_docs),
a as (select *, count(*) over (partition by size) ns, count(*) over (partition by size, p) np,
  row_number() over (partition by s) rn from h)
select count(*) files_seen, count(*) filter (ns > 1) partial_hashed,
  count(*) filter (np > 1 and not hit) full_hashed, count(*) filter (np > 1 and hit) cache_hits,
  count(*) filter (np > 1 and not hit) cache_misses,
  cast(coalesce(sum(size) filter (np > 1 and not hit), 0) as bigint) bytes_hashed,
  count(*) filter (rn > 1) dedupes from a""",
)
oracle(
    "cache_upsert",
    """
select source_path, size, doc_id * 1000000 mtime_us, sha256(documents.text) sha256
from v_docs join documents using (doc_id) where lang = 'en'
union all
select source_path, size, (doc_id - 60 * toxic) * 1000000,
  case when toxic = 0 then sha256(documents.text) else 'stale' end
from v_docs join documents using (doc_id) join labels using (doc_id) where lang <> 'en'""",
)

oracle(
    "cache_deltas",
    """
with o as (select doc_id, toxic from labels),
d as (select source_path, size, doc_id, sha256(text) sha256, toxic,
    case when doc_id % 10 = 0 or (doc_id % 3 = 0 and doc_id % 5 <> 0) then 'fresh'
      when doc_id % 5 <> 0 and toxic is not null then 'old' end kind from v_docs left join o using (doc_id))
select source_path, size, case kind when 'fresh' then doc_id else doc_id - 60 * toxic end * 1000000 mtime_us,
  case when kind = 'fresh' or toxic = 0 then sha256 else 'stale' end sha256 from d where kind is not null""",
)

# --- files ----------------------------------------------------------------

SCANNED = """select concat('source=', source, '/lang=', lang) folder, cast(sum(strlen(text) + 1) as bigint) n_bytes
from documents where not starts_with(source, 'src1') and not (source = 'src2' and lang = 'en') group by 1"""
ORACLES["manifest_scan"] = SCANNED
ORACLES["manifest_scan_tree"] = SCANNED
ORACLES["manifest_scan_filters"] = """
with f as (select concat('plain/source=', source, '/lang=', lang) folder, 3 depth, false hidden, text from documents
  union all select concat('.cache/source=', source), 2, true, text from documents
  union all select concat('place/lang=', lang, '/source=', source, '/kind=', doc_id % 3), 4, false, text from documents),
g as (select folder, cast(depth as bigint) depth, hidden, cast(sum(strlen(text) + 1) as bigint) n_bytes from f group by all)
select *, 'whole' form from g union all select *, 'some' from g where depth = 3"""
FOLDER = "concat('source=', source, '/lang=', lang, '/doc_id=', doc_id)"
ORACLES["hash_files"] = f"""
select {FOLDER} folder, strlen(text) + 1 size, sha256(encode(text || chr(10))[1:4096]) partial_sha256,
  sha256(text || chr(10)) sha256 from documents"""
ORACLES["dedupe_files"] = f"""
with r as (select *, row_number() over (partition by text order by split({FOLDER}, '/')) rn from documents)
select {FOLDER} folder, strlen(text) + 1 size, 'dedupe' op_type, true all_cached from r where rn > 1"""
