"""Manifest views over the test tables, in SQL both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "v_docs": """select '/data' root_dir,
  concat('/data/',source,'/',lang,'/doc_',doc_id,'.txt') source_path,
  cast({L}(text) as bigint) size, doc_id, text
from documents""",
    "v_conv": """select '/data' root_dir,
  concat('/data/conv_',conv_id,'/',turn,'_',role,'.txt') source_path,
  cast({L}(text) as bigint) size, conv_id, text
from conversations""",
    "v_line": """select '/data' root_dir,
  concat('/data/',l_returnflag,'/',l_linestatus,'/li_',l_orderkey,'_',l_partkey,'_',l_suppkey,'_',l_linenumber,'.dat') source_path,
  cast(round(l_extendedprice*100) as bigint) size
from lineitem""",
    "v_part": """select '/data' root_dir,
  concat('/data/',lower(p_type),'/',replace(p_name,' ','_'),'_',p_partkey,
    case p_size%4 when 0 then '.pdf' when 1 then '.tmp' when 2 then '.tar.gz' else '' end) source_path,
  cast(p_size as bigint) size
from part""",
    "v_pages": """select '/data' root_dir,
  concat('/data/',regexp_extract(url,'^https?://([^/?#]+)',1),
    regexp_replace(regexp_extract(url,'^https?://[^/?#]+([^?#]*)',1),'/$',''),'/page_',page_id,'.html') source_path,
  cast({L}(html) as bigint) size, html
from pages""",
    "v_mix": """select '/data' root_dir,
  concat('/data/',
    case doc_id%10 when 3 then '.cache/' when 5 then 'duplicates/' when 7 then 'build-out/x/y/' else '' end,
    case when doc_id%20=5 then '' else concat(source,'/') end,
    case doc_id%9 when 4 then '.' else '' end,'doc_',doc_id,'.txt') source_path,
  cast({L}(text) as bigint) size, doc_id, text
from documents""",
    "v_txn": """select event_id txn_seq, cast(event_id as string) id, concat('/u/',user_id) root_dir,
  case when event_type='signup' then 1 else 0 end ttype, event_type='error' irreversible,
  concat('/u/',user_id,'/in/',event_id) source_path, concat('/u/',user_id,'/out/',event_id) dest_path
from events""",
    "v_err": """select event_id seq,
  case event_id%6 when 0 then 'open a: permission denied' when 1 then 'rename b: File exists'
    when 2 then 'stat c: no such file or directory' when 3 then 'rmdir d: directory not empty'
    when 4 then 'invalid name e' else 'disk on fire' end msg
from events where event_type='error'""",
    # One small rule file per part, covering every kind of line.
    "v_rulefiles": """select p_partkey file_key,
  concat('# rules for ',p_brand,chr(10),
    '!',replace(p_name,' ','_'),'*.tmp ',chr(10),
    lower(p_type),' = ',replace(p_name,' ',' , '),chr(10),chr(10),
    '// old',chr(10),
    ' # note ',p_brand,chr(10),
    '=',p_name,chr(10),
    p_brand,'=regex(^',replace(p_name,' ','.*'),'[.]pdf$),,regex(',p_type,chr(10),
    'Size',p_size,'=',p_size,'=kept, * ',chr(10),
    '! build/ ') text
from part""",
    # Rule table from data: a keyword per part, a pattern per large size, fallbacks.
    "v_partrules": """select p_partkey+1000 rule_idx, 0 matcher_idx, concat('by_type/',lower(p_type)) folder,
  concat(replace(p_name,' ','_'),'_',p_partkey%7) raw, false is_regex
from part
union all select distinct cast(p_size as bigint), 0, concat('by_size/',p_size), concat('_[0-9]*',p_size,'[.]pdf$'), true
from part
union all select p_partkey+1000000000000, 0, concat('rest/',lower(p_type)), '*', false
from part""",
    # Ignore rules from data: every document gives one, of six kinds that can match.
    "v_mixrules": """select doc_id ord, concat(source,'-',lang) source, case doc_id%6 when 0 then concat('/',source,'/doc_',doc_id%89,'?.txt')
    when 1 then concat(source,'/doc_',doc_id,'.txt') when 2 then concat('doc_',doc_id,'.txt')
    when 3 then concat('build-out/?/y/',source,'/*',doc_id%83,'.txt') when 4 then concat('doc_',doc_id%97,'?.t*')
    else case doc_id%7 when 0 then concat('/build-out/x/y/',source) when 1 then concat('buil',doc_id%5) when 2 then 'build-' else concat('doc_?',doc_id,'*') end end pattern
from documents""",
    # Roots with a scheme, with a slash at the end, and the root of all.
    "v_roots": """select case doc_id%3 when 0 then '/data/' when 1 then 's3://bkt/data' else '/' end root_dir,
  concat(case doc_id%3 when 0 then '/data/' when 1 then 's3://bkt/data/' else '/' end,
    case when doc_id%7=2 then 'duplicates/' when doc_id%7=3 then concat('duplicates/',lang,'/') else concat(source,'/') end,
    'doc_',doc_id,'.txt') source_path,
  cast({L}(text) as bigint) size, doc_id, concat(lang,doc_id%50,'.txt') new_name
from documents""",
    # Flat log: an order is a transaction, its lines are the operations.
    "v_log": """select l_orderkey txn_seq, concat('txn ',l_orderkey) id,
  case when l_orderkey%11=3 then 1 else 0 end ttype, l_orderkey%13=5 irreversible,
  cast(l_linenumber as bigint) op_seq, 'move' op_type, concat('/u/',l_orderkey%997) root_dir,
  concat('/u/',l_orderkey%997,'/in/',l_orderkey,'_',l_partkey,'_',l_suppkey,'_',l_linenumber) source_path,
  cast(l_quantity as bigint) size,
  concat('/u/',l_orderkey%997,'/out/',l_orderkey,'_',l_partkey,'_',l_suppkey,'_',l_linenumber) dest_path
from lineitem""",
    "v_chats": """select '/data' root_dir,
  concat('/data/conv_',conv_id,'/',turn,'_',role,'.txt') source_path,
  cast({L}(text) as bigint) size,
  case when role='user' then concat(' ',chr(9)) else concat(role,' ',conv_id,'-',turn,'.md') end new_name
from conversations""",
    "v_versions": """select '/data' root_dir,
  concat('/data/',source,'/',lang,'/doc_',doc_id,'.txt') source_path,
  cast({L}(text) as bigint) size,
  concat(lang,case when doc_id%3=0 then '' when doc_id%3=1 then concat('_v',n_chars%40)
    else concat('_v',n_chars%5,'_v',n_chars%7) end,'.txt') new_name
from documents""",
    "v_names": """select p_partkey, case p_partkey%10
    when 0 then concat('Copy of ',p_name,' Sem ',p_size,' Final Notes (2).pdf')
    when 1 then concat(replace(p_name,' ','-'),'_assignment_',p_size,'_FINAL_v',p_size%4,'.docx')
    when 2 then concat('Department_',lower(p_type),'_Introduction_to_',replace(p_name,' ','_'),'_Lab_Manual_v2.tar.gz')
    when 3 then concat('dataStructures',p_brand,'QuestionPaper.',p_size,'.txt')
    when 4 then concat('scan_',p_partkey*7919,'_2024-2025_',p_name,'.pdf')
    when 5 then concat('FALLSEM20',24+p_size%3,'-',25+p_size%3,'_',p_brand,'_syllabus')
    when 6 then concat('Microsoft Word - ',p_name,' ',20240100+p_size,' api json.doc')
    when 7 then concat('Winter_s',20+p_size%5,'-',21+p_size%5,' ',p_name,' ',p_name,' laboratory experiment new.txt')
    when 8 then concat('invoice ',2000+p_size,'-12-01 paid (copy) os ',p_name)
    else concat('chapter section part ',p_type,' ID',p_size,' XMLFile Draft document ',p_name,'.') end name
from part""",
}

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name].replace("{L}", "octet_length")
    source = next(t for t in TABLES if f"from {t}" in sql)
    return spark.sql(sql.replace(f"from {source}", "from {src}"), src=table(spark, sf_dir, source))


def manifest(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Manifest columns only; a content column is not read unless needed for sizes."""
    return view(spark, sf_dir, name).select("root_dir", "source_path", "size")


def with_content(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Manifest with the whole text as binary ``content``."""
    df = view(spark, sf_dir, name)
    text = "html" if "html" in df.columns else "text"
    return df.select(
        "root_dir", "source_path", "size", F.col(text).cast("binary").alias("content")
    )


def with_views(body: str) -> str:
    """DuckDB statement with the views that ``body`` names (as plain words) in front."""
    used = [v for v in VIEWS if v in body]
    clauses = [f"{v} as ({VIEWS[v].replace('{L}', 'strlen')})" for v in used]
    body = body.strip()
    if body.lower().startswith("with recursive "):
        return "with recursive " + ",\n".join(clauses) + ",\n" + body[15:]
    if body.lower().startswith("with "):
        return "with " + ",\n".join(clauses) + ",\n" + body[5:]
    return "with " + ",\n".join(clauses) + "\n" + body
