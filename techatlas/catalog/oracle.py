"""The same results as plain SQL over the test tables, for side-by-side checks."""

from __future__ import annotations

from techatlas.catalog.queries import ALL_TERMS, KEYWORDS, PREFIXES, TYPED
from techatlas.functions.labels import STOPWORDS
from techatlas.functions.names import LEGAL_FORMS
from techatlas.functions.text import WORD_PATTERN
from techatlas.operators import growth as gr
from techatlas.sources.tables import TERMS


def norm(x: str) -> str:
    # folding by the database's own rule, not by the library's table
    return f"trim(regexp_replace(strip_accents(lower({x})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def values(rows) -> str:
    def lit(v):
        return "null::int" if v is None else (f"'{v}'" if isinstance(v, str) else str(v))

    return "(values " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ") v(tech, query, start_year, end_year)"


def has_phrase(x: str, q: str = "t.query") -> str:
    return f"coalesce(contains(' ' || {norm(x)} || ' ', ' ' || {norm(q)} || ' '), false)"


def actor_name(x: str) -> str:
    forms = "|".join(sorted((" " + f for f in LEGAL_FORMS), key=len, reverse=True))
    return f"trim(regexp_replace(regexp_replace(translate(trim(upper({x})), '.,', ''), '({forms})$', ''), '\\s+', ' ', 'g'))"


def code4(x: str, level: int = 4) -> str:
    return f"substr(replace(trim({x}), ' ', ''), 1, {level})"


WINDOW = "(t.start_year is null or {y} >= t.start_year) and (t.end_year is null or {y} <= t.end_year)"
CODE = "concat(substr(p_type,1,1), lpad(replace(p_brand,'Brand#',''),2,'0'), upper(substr(p_name,1,1)), ' ', p_size, '/00')"
NATION = "concat('N', chr(65 + {k}::int))"

#: Canonical tables and search results; unused parts are not computed.
BASE = f"""with
terms as (select tech, query, start_year::int start_year, end_year::int end_year from {values(TERMS)}),
order_text as (
  select l_orderkey, string_agg(distinct p_name, ', ' order by p_name) title,
    string_agg(distinct p_brand, ', ' order by p_brand) keywords,
    string_agg(distinct {CODE}, ', ' order by {CODE}) codes
  from lineitem join part on l_partkey = p_partkey group by 1),
records as (
  select o_orderkey record_id, concat('EP', o_orderkey, 'A1') publication_number,
    {NATION.format(k='c_nationkey')} country, title, strftime(o_orderdate, '%Y-%m-%d') pub_date,
    year(o_orderdate)::int pub_year, o_custkey::varchar family_id,
    concat(c_name, case o_orderstatus when 'F' then ' GmbH' when 'O' then ' Corp.' else ' & Co. KG' end,
      ', ', c_mktsegment, ' AG, ', n_name, ' Institute') applicant_names,
    concat({NATION.format(k='c_nationkey')}, ', ', case when o_orderstatus = 'F' then {NATION.format(k='c_nationkey')}
      else {NATION.format(k='n_regionkey')} end, ', x1y') applicant_countries, codes
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    left join order_text on o_orderkey = l_orderkey),
record_actor as (
  select distinct l_orderkey record_id, s_suppkey actor_id,
    concat(s_name, case s_suppkey % 4 when 0 then ' GmbH' when 1 then ' Co., Ltd.' when 2 then ' AG' else '' end) raw_name,
    {NATION.format(k='s_nationkey')} actor_country
  from lineitem join supplier on l_suppkey = s_suppkey),
code_lists as (
  select record_id, pub_year, list_sort(list_distinct([{code4('x')} for x in string_split(codes, ',') if trim(x) <> ''])) cs
  from records where pub_year is not null),
record_code as (select record_id, unnest(cs) code, pub_year from code_lists where len(cs) >= 2),
projects as (
  select o_orderkey project_id,
    case substr(o_orderpriority,1,1) when '1' then 'FP7' when '2' then 'H2020' when '5' then 'H2020' when '3' then 'HORIZON' end framework,
    concat('PRJ', o_orderkey) acronym, title, concat('Work for the ', lower(c_mktsegment), ' sector') objective, keywords, strftime(o_orderdate, '%Y-%m-%d') start_date,
    year(o_orderdate)::int start_year, o_orderstatus status, o_totalprice total_cost,
    case when o_orderstatus <> 'P' then o_totalprice end ec_max_contribution, c_mktsegment funding_scheme
  from orders join customer on o_custkey = c_custkey left join order_text on o_orderkey = l_orderkey),
organizations as (
  select l_orderkey project_id, s_name as name, {NATION.format(k='s_nationkey')} country,
    concat(r_name, '-', s_suppkey % 10) city,
    case when min(l_linenumber) = 1 then 'coordinator' else 'participant' end as role,
    case when s_acctbal < 2000 then 'YES' else 'no' end sme
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
    join region on n_regionkey = r_regionkey
  group by l_orderkey, s_suppkey, s_name, s_nationkey, r_name, s_acctbal),
papers as (
  select p_partkey paper_id, p_name title, case when p_size > 2 then p_brand end venue, p_brand, p_type, p_size, p_name,
    year, citations, influential
  from part left join (select l_partkey, min(year(l_shipdate))::int as year, count(*) citations,
    count(*) filter (l_returnflag = 'R') influential from lineitem group by 1) on p_partkey = l_partkey),
publications as (select doc_id publication_id, text title, (1995 + doc_id % 7)::int as year from documents),
rm as (select t.tech, r.* from records r join terms t on ({has_phrase('r.title')} or {has_phrase('r.codes')})
  where {WINDOW.format(y='r.pub_year')}),
pm as (select t.tech, p.* from projects p join terms t on ({has_phrase('p.title')} or {has_phrase('p.objective')} or {has_phrase('p.keywords')})
  where {WINDOW.format(y='p.start_year')}),
ra as (select rm.tech, rm.record_id, rm.pub_year, a.actor_id, a.raw_name, {actor_name('a.raw_name')} actor
  from rm join record_actor a using (record_id)),
po as (select pm.tech, pm.project_id, pm.start_year, pm.framework, o.name, o.country, o.city, o.role, o.sme
  from pm join organizations o using (project_id)),
cl as (select rm.tech, c.* from rm join record_code c using (record_id)),
pubs as (select t.tech, p.publication_id, p.year from publications p join terms t on {has_phrase('p.title')}
  where {WINDOW.format(y='p.year')}),
pap as (select * from (select t.tech, p.* replace (coalesce(citations, 0) as citations),
    from papers p join terms t on {has_phrase('p.title')} where {WINDOW.format(y='p.year')})),
lfy as (select case when substr(d,6,2)::int >= 11 then substr(d,1,4)::int else substr(d,1,4)::int - 1 end y
  from (select max(pub_date) d from records)),
spine as (select tech, unnest(generate_series(start_year, end_year))::int as year from terms),
fam as (select tech, pub_year as year, count(distinct family_id) n from rm group by 1, 2),
fser as (select s.tech, s.year, coalesce(n, 0) n from spine s left join fam using (tech, year)),
cum as (select tech, year, n, sum(n) over (partition by tech order by year)::bigint cumulative from fser),
fitp as (select * from cum where year <= (select y from lfy)),
ta as (select tech, actor, count(distinct record_id) n from ra group by 1, 2),
oc as (select tech, name, country, count(distinct project_id) n, bool_or(upper(sme) = 'YES') is_sme,
    bool_or(role = 'coordinator') is_coordinator from po group by 1, 2, 3),
ma as (select tech, name, sum(records)::bigint records, sum(projects)::bigint projects, max(country) country,
    bool_or(is_sme) is_sme, bool_or(is_coordinator) is_coordinator, sum(records + projects)::bigint total
  from (select tech, upper(trim(actor)) as name, n records, 0 projects, null::varchar country, false is_sme, false is_coordinator from ta
    union all select tech, upper(trim(name)), 0, n, country, is_sme, is_coordinator from oc) group by 1, 2),
rbc as (select tech, country, count(*) n from rm group by 1, 2),
pbc as (select tech, country, count(distinct project_id) n from po group by 1, 2),
mc as (select coalesce(a.tech, b.tech) tech, coalesce(a.country, b.country) country, coalesce(a.n, 0) records,
    coalesce(b.n, 0) projects, coalesce(a.n, 0) + coalesce(b.n, 0) total
  from rbc a full outer join pbc b on a.tech = b.tech and a.country = b.country),
rby as (select tech, pub_year as year, count(*) n from rm group by 1, 2),
pby as (select tech, start_year as year, count(*) n from pm group by 1, 2),
pubby as (select tech, year, count(*) n from pubs group by 1, 2),
ms as (select s.tech, s.year, coalesce(a.n, 0) records, coalesce(b.n, 0) projects, coalesce(c.n, 0) publications
  from spine s left join rby a using (tech, year) left join pby b using (tech, year) left join pubby c using (tech, year)),
fy as (select tech, start_year as year, round(sum(ec_max_contribution), 2) funding, count(*) n from pm
  where ec_max_contribution is not null group by 1, 2),
fp as (select tech, coalesce(framework, 'UNKNOWN') programme, round(sum(ec_max_contribution), 2) funding, count(*) n from pm
  where ec_max_contribution is not null group by 1, 2),
fyp as (select tech, start_year as year, coalesce(framework, 'UNKNOWN') programme, round(sum(ec_max_contribution), 2) funding, count(*) n
  from pm where ec_max_contribution is not null group by 1, 2, 3),
fi as (select tech, funding_scheme scheme, start_year as year, count(*) n, round(sum(coalesce(ec_max_contribution, 0)), 2) funding
  from pm group by 1, 2, 3),
ay as (select tech, actor, year, sum(n)::bigint n from (
    select tech, upper(trim(actor)) actor, pub_year as year, count(distinct record_id) n from ra group by 1, 2, 3
    union all select tech, upper(trim(name)), start_year, count(distinct project_id) from po group by 1, 2, 3) group by 1, 2, 3),
cr as (select tech, code, count(distinct record_id) n from cl group by 1, 2),
tc as (select * from cr qualify row_number() over (partition by tech order by n desc, code) <= 15),
pc as (select x.tech, x.code a, y.code b, count(distinct x.record_id) n from cl x join cl y
    on x.tech = y.tech and x.record_id = y.record_id and x.code < y.code
  where (x.tech, x.code) in (select tech, code from tc) and (y.tech, y.code) in (select tech, code from tc) group by 1, 2, 3),
jac as (select pc.tech, pc.a code_a, pc.b code_b, pc.n, ca.n + cb.n - pc.n union_n, round(pc.n / (ca.n + cb.n - pc.n), 4) jaccard
  from pc join tc ca on pc.tech = ca.tech and pc.a = ca.code join tc cb on pc.tech = cb.tech and pc.b = cb.code),
py as (select x.tech, x.pub_year, x.code a, y.code b, count(distinct x.record_id) n from cl x join cl y
    on x.tech = y.tech and x.record_id = y.record_id and x.code < y.code group by 1, 2, 3, 4),
cy as (select tech, code, pub_year, count(distinct record_id) n from cl group by 1, 2, 3),
tb as (select tech, pub_year as year, count(distinct substr(trim(x), 1, 1)) sections,
    count(distinct case when length(trim(x)) >= 4 then substr(trim(x), 1, 4) end) subclasses
  from (select tech, pub_year, unnest(string_split(codes, ',')) x from rm) where trim(x) <> '' group by 1, 2),
pairs_a as (select x.tech, x.actor a, y.actor b, count(distinct x.record_id) n from ra x join ra y
    on x.tech = y.tech and x.record_id = y.record_id and x.actor < y.actor group by 1, 2, 3
  qualify row_number() over (partition by x.tech order by n desc, a, b) <= 200),
pairs_o as (select x.tech, x.name a, y.name b, count(distinct x.project_id) n from po x join po y
    on x.tech = y.tech and x.project_id = y.project_id and x.name < y.name group by 1, 2, 3
  qualify row_number() over (partition by x.tech order by n desc, a, b) <= 200),
named as (select distinct tech, 'r' kind, record_id id, upper(trim(actor)) as name from ra
  union all select distinct tech, 'p', project_id, upper(trim(name)) from po),
edges_all as (select x.tech, x.name source, y.name target, count(*) weight from named x join named y
    on x.tech = y.tech and x.kind = y.kind and x.id = y.id and x.name < y.name group by 1, 2, 3),
strong as (select tech, name from ma qualify row_number() over (partition by tech order by total desc, name) <= 40),
edges as (select * from edges_all where (tech, source) in (select tech, name from strong)
    and (tech, target) in (select tech, name from strong)
  qualify row_number() over (partition by tech order by weight desc, source, target) <= 100),
dim_country as (select {NATION.format(k='n_nationkey')} country, n_name as label, r_name = 'EUROPE' is_european, n_nationkey = 24 is_office
  from nation join region on n_regionkey = r_regionkey),
dim_code as (
  select substr(p_type,1,1) code, max(p_type) description from part group by 1
  union all select concat(substr(p_type,1,1), lpad(replace(p_brand,'Brand#',''),2,'0')), max(concat_ws(' ', p_type, p_brand))
    from part where p_size > 48 group by 1
  union all select concat(substr(p_type,1,1), lpad(replace(p_brand,'Brand#',''),2,'0'), upper(substr(p_name,1,1))), max(concat_ws(' ', p_type, p_brand, p_name))
    from part where p_size = 50 group by 1),
lei as (
  select s_name raw_name, case when s_acctbal >= 0 then concat('LEI', lpad(s_suppkey::varchar, 12, '0')) end lei,
    case when s_acctbal >= 0 then concat(s_name, ' Group') end legal_name,
    case when s_acctbal >= 0 then {NATION.format(k='s_nationkey')} end country,
    date '2001-08-01' - (s_suppkey % 120)::int resolved_at from supplier
  union all select s_name, concat('LEI', lpad(s_suppkey::varchar, 12, '0'), '-OLD'), concat(s_name, ' Group'),
    {NATION.format(k='s_nationkey')}, date '2001-08-01' - (s_suppkey % 120)::int - 30 from supplier)
"""

ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str, base: str = BASE) -> None:
    ORACLE[name] = base + sql


def ctes(text: str) -> str:
    """BASE plus further common table expressions."""
    return BASE.rstrip() + ",\n" + text + "\n"


def top(n: int, by: str, ties: str) -> str:
    return f"qualify row_number() over (partition by tech order by {by} desc, {ties}) <= {n}"


# --- normalisation and whole tables --------------------------------------------------
oracle("sanitize_entities", """select page_id, md5(replace(regexp_replace(regexp_replace(html,
  '&(amp|lt|gt|apos|quot);', chr(1) || '\\1;', 'g'), '&[a-zA-Z][a-zA-Z0-9]*;', '', 'g'), chr(1), '&')) clean_md5 from pages""", "")
oracle("framework_from_filename", """select o_orderkey, case o_orderpriority when '1-URGENT' then 'FP7' when '2-HIGH' then 'H2020'
  when '3-MEDIUM' then 'HORIZON' else 'UNKNOWN' end framework from orders""", "")
oracle("safe_float", "select p_partkey, case when p_size >= 10 and p_size < 45 then p_retailprice end as value from part", "")
LINES = "l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice"
oracle("dedupe_first_wins", f"""select {LINES} from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber
  order by l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1""", "")
oracle("upsert_last_wins", f"""select {LINES} from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber
  order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc) = 1""", "")
oracle("normalize_actors_table", f"""select distinct record_id, trim(x) raw_name, {actor_name('trim(x)')} as name
  from (select record_id, unnest(string_split(applicant_names, ',')) x from records) where trim(x) <> ''""")
oracle("normalize_codes_table", "select record_id, code, pub_year from record_code")
oracle("normalized_table_stats", """select count(*) "rows", count(distinct code) codes, count(distinct record_id) records,
  min(pub_year) min_year, max(pub_year) max_year from record_code""")
oracle("link_coverage_audit", """select count(*) missing from records r where trim(applicant_names) <> ''
  and not exists (select 1 from record_actor a where a.record_id = r.record_id)""")
ALL_MATCH = f"""am as (select t.tech, r.record_id from records r join (select * from {values(ALL_TERMS)}) t
  on list_has_all(string_split(coalesce({norm('r.title')}, '') || ' ' || coalesce({norm('r.codes')}, ''), ' '), string_split({norm('t.query')}, ' ')))"""
oracle("term_subset_export", """select r.record_id, r.title, a.actor_id, a.raw_name from records r join record_actor a using (record_id)
  where r.record_id in (select record_id from am)""", ctes(ALL_MATCH))
oracle("bulk_counts", """select 'records' table_name, (select count(*) from records) "rows" union all select 'projects', (select count(*) from projects)
  union all select 'organizations', (select count(*) from organizations) union all select 'publications', (select count(*) from publications)""")

# --- search --------------------------------------------------------------------------
oracle("match_phrase", "select tech, record_id from rm")
oracle("match_prefix", f"""select t.tech, r.record_id, r.title from records r join (select * from {values(PREFIXES)}) t
  on contains(' ' || {norm('r.title')}, ' ' || {norm('t.query')}) where {WINDOW.format(y='r.pub_year')}""")
oracle("match_all_terms", "select tech, record_id from am", ctes(ALL_MATCH))
oracle("search_records", f"""select tech, record_id, publication_number, country, title, pub_date, applicant_names, applicant_countries, codes, family_id
  from rm""")
oracle("search_project_keywords", "select tech, project_id, keywords from pm", BASE.replace(values(TERMS), values(KEYWORDS)))
oracle("search_projects", """select tech, project_id, framework, acronym, title, objective, keywords, start_date, status, total_cost, ec_max_contribution, funding_scheme
  from pm""")
oracle("records_codes", "select tech, record_id, codes from rm where trim(codes) <> ''")
oracle("records_codes_years", "select tech, record_id, codes, pub_year as year from rm where trim(codes) <> '' and pub_year is not null")
oracle("table_filter_sort", """select tech, name, country, total from ma where contains(lower(name), '000000001') or contains(lower(country), '000000001')
  order by total desc, name""")

# --- joins ---------------------------------------------------------------------------
oracle("join_match_records", "select tech, record_id, country, pub_year, title from rm")
oracle("join_projects_orgs", "select tech, project_id, name, country, city, role, sme from po")
oracle("join_record_actor", "select tech, record_id, pub_year, actor_id, raw_name, actor from ra")
oracle("pairs_actors", "select tech, a, b, n from pairs_a")
oracle("pairs_orgs", "select tech, a, b, n from pairs_o")
oracle("pairs_countries", f"""select x.tech tech, x.country a, y.country b, count(distinct x.project_id) n from po x join po y
  on x.tech = y.tech and x.project_id = y.project_id and x.country < y.country group by 1, 2, 3
  qualify row_number() over (partition by x.tech order by n desc, a, b) <= 30""")
oracle("pairs_codes", "select tech, a, b, n from pc")
oracle("pairs_codes_year", "select tech, pub_year, a, b, n from py")
oracle("merge_series_full_outer", "select * from ms")
oracle("merge_countries_full_outer", "select * from mc")
oracle("merge_actors_full_outer", "select tech, name, records, projects, total, is_sme, is_coordinator from ma")
oracle("spine_left_join", "select tech, year, n from fser")
oracle("resolve_entities", """select tech, ma.name, total, coalesce(ma.country, e.country) country, lei, legal_name
  from ma left join (select upper(trim(raw_name)) as name, lei, legal_name, country from lei
    where resolved_at <= date '2001-08-01' and resolved_at >= date '2001-08-01' - 90
    qualify row_number() over (partition by upper(trim(raw_name)) order by resolved_at desc, coalesce(lei, '') desc) = 1) e on ma.name = e.name""")


def _refreshed(step: int, day: str, names: str) -> str:
    """The legal-entity table r<step> from that before it, after the names were asked on a day."""
    return f"""q{step} as (select distinct upper(trim(name)) raw_name from ({names}) where trim(name) <> '' and upper(trim(name)) not in
    (select raw_name from r{step - 1} where resolved_at between date '{day}' - 90 and date '{day}')),
r{step} as (select * from (select * from r{step - 1} union all
    select raw_name, lei, legal_name, country, date '{day}' from q{step} left join registry using (raw_name))
  qualify row_number() over (partition by raw_name order by resolved_at desc, coalesce(lei, '') desc) = 1)"""


oracle(
    "refresh_entities",
    "select raw_name, lei, legal_name, country, resolved_at from r2",
    ctes(
        """r0 as (select upper(trim(raw_name)) raw_name, lei, legal_name, country, resolved_at from lei where raw_name not like '%5'),
registry as (select upper(trim(s_name)) raw_name, concat('NEW', lpad(s_suppkey::varchar, 12, '0')) lei, concat(s_name, ' Holding') legal_name,
  null::varchar country from supplier where s_suppkey % 4 <> 0),
"""
        + _refreshed(1, "2001-08-01", "select raw_name as name from record_actor")
        + ",\n"
        + _refreshed(2, "2001-09-30", "select raw_name as name from record_actor union all select name from organizations")
    ),
)
oracle("describe_code", """select c.code, coalesce(d4.description, d3.description, d1.description, '') description
  from (select code, case when length(code) >= 4 then substr(code, 1, 4) end c4, case when length(code) >= 3 then substr(code, 1, 3) end c3,
    substr(code, 1, 1) c1 from (select distinct code from record_code)) c
  left join dim_code d4 on d4.code = c.c4 left join dim_code d3 on d3.code = c.c3 left join dim_code d1 on d1.code = c.c1""")
oracle("country_labels", """select tech, country, label, is_european, total from mc left join dim_country using (country)
  where not coalesce(is_office, false)""")

# --- aggregations --------------------------------------------------------------------
oracle("records_by_year", "select * from rby")
oracle("projects_by_year", "select * from pby")
oracle("families_by_year", "select * from fam")
oracle("records_by_country", f"select * from rbc {top(20, 'n', 'country')}")
oracle("projects_by_country", f"select * from pbc {top(20, 'n', 'country')}")
oracle("records_by_actor_country", f"""select tech, upper(trim(x)) country, count(*) n
  from (select tech, unnest(string_split(applicant_countries, ',')) x from rm) where length(trim(x)) = 2 group by 1, 2 {top(30, 'n', 'country')}""")
oracle("top_actors", f"select tech, actor, n from ta {top(20, 'n', 'actor')}")
oracle("top_actor_strings", f"""select tech, applicant_names, count(*) n from rm where trim(applicant_names) <> '' group by 1, 2
  {top(20, 'n', 'applicant_names')}""")
oracle("actors_by_year", f"""select tech, upper(trim(actor)) actor, pub_year as year, count(distinct record_id) n from ra group by 1, 2, 3
  qualify row_number() over (partition by tech order by n desc, upper(trim(actor)), pub_year) <= 200""")
oracle("actor_code_strings", """select tech, applicant_names, codes, count(*) n from rm where trim(applicant_names) <> '' and trim(codes) <> ''
  group by 1, 2, 3""")
oracle("top_orgs", f"select tech, name, count(distinct project_id) n from po group by 1, 2 {top(20, 'n', 'name')}")
oracle("orgs_with_flags", f"select * from oc {top(50, 'n', 'name, country')}")
oracle("orgs_by_city", f"select tech, city, country, count(distinct project_id) n from po group by 1, 2, 3 {top(50, 'n', 'city, country')}")
oracle("orgs_by_year", f"select tech, name, start_year as year, count(distinct project_id) n from po group by 1, 2, 3 {top(200, 'n', 'name, start_year')}")
oracle("orgs_by_programme", f"""select tech, name, framework, count(distinct project_id) n from po where framework is not null group by 1, 2, 3
  {top(500, 'n', 'name, framework')}""")
oracle("funding_by_year", "select * from fy")
oracle("funding_by_programme", "select * from fp")
oracle("funding_by_year_programme", "select * from fyp")
oracle("funding_by_instrument", "select * from fi")
CROSS = """(select t.tech, total, coalesce(cross_border, 0) cross_border, round(coalesce(cross_border, 0) / total, 4) cross_border_share
  from (select tech, count(distinct project_id) total from pm group by 1) t left join (
    select tech, count(*) cross_border from (select tech, project_id from po group by 1, 2 having count(distinct country) >= 3) group by 1) x using (tech))"""
oracle("cross_border_share", f"select * from {CROSS}")
oracle("last_full_year", "select y last_full_year from lfy")
oracle("effective_end_year", """select tech, query, start_year, least(end_year, y) end_year,
  case when y < end_year then 'record data is complete up to ' || y || ' only' end warning from terms, lfy""")
oracle("top_codes", "select * from tc")
oracle("code_ranking", "select * from cr")
oracle("codes_by_year", "select * from cy")
oracle("citation_trend", "select tech, year, sum(citations)::bigint citations, count(*) papers from pap where year is not null group by 1, 2")
oracle("venue_distribution", f"""select tech, venue, n, round(n / total, 4) share from (select tech, venue, count(*) n,
  sum(count(*)) over (partition by tech) total from pap where trim(venue) <> '' group by 1, 2) {top(8, 'n', 'venue')}""")
oracle("publication_types", """select tech, x as type, count(*) n from (select tech, unnest(case when p_size > 25 then [p_type, 'Review'] else [p_type] end) x from pap)
  group by 1, 2""")
oracle("impact_totals", """select tech, count(*) papers, sum(citations)::bigint citations, round(sum(citations) / count(*), 1) avg_citations,
  round(coalesce(sum(influential) / nullif(sum(citations), 0), 0), 4) influential_ratio from pap group by 1""")
oracle("programme_evolution", "select tech, year, scheme, sum(n)::bigint n from fi group by 1, 2, 3")
oracle("programme_pivot_funding", "select tech, year, programme, round(funding / 1e6, 1) funding_millions from fyp")
oracle("programme_shares", "select tech, programme, funding, round(funding / sum(funding) over (partition by tech) * 100, 1) pct from fp")
INSTR = "(select tech, scheme, sum(n)::bigint n from fi group by 1, 2)"
oracle("top_instruments", f"select * from {INSTR} {top(3, 'n', 'scheme')}")
oracle("dominant_programme", f"select * from {INSTR} {top(1, 'n', 'scheme')}")
oracle("technology_breadth", "select * from tb")
oracle("funding_totals", """select tech, round(sum(funding), 2) total_funding, sum(n)::bigint projects,
  round(round(sum(funding), 2) / sum(n), 2) avg_project_size from fy group by 1""")

# --- series and windows --------------------------------------------------------------
oracle("yoy_growth", "select *, " + ", ".join(
    f"round(({v} - lag({v}) over w) / nullif(lag({v}) over w, 0) * 100, 1) {v}_growth" for v in ("records", "projects", "publications")
) + " from ms window w as (partition by tech order by year)")
oracle("cumulative_series", "select * from cum")


def cagr_sql(source: str, value: str, limit: str) -> str:
    return f"""select tech, first_year, last_year, round(case when last_year > first_year then (pow(v1 / v0, 1.0 / (last_year - first_year)) - 1) * 100 else 0 end, 2) cagr,
  case when last_year > first_year then first_year || '-' || last_year else '' end period
  from (select tech, min(year) first_year, max(year) last_year, arg_min({value}, year) v0, arg_max({value}, year) v1 from {source}
    where {value} > 0 {limit} group by 1)"""


oracle("cagr_records", cagr_sql("fser", "n", "and year <= (select y from lfy)"))
oracle("cagr_funding", cagr_sql("fy", "funding", "and year <= (select y from lfy)"))
RANKED = """(select tech, row_number() over (partition by tech order by total desc, name) as rank, name, records, projects, total,
  round(total / sum(total) over (partition by tech), 4) share from ma)"""
oracle("actor_rank_share", f"select * from {RANKED} where rank <= 100")
TOP3 = f"""(select t.tech, round(x / s, 4) top3_share from (select tech, sum(total) s from ma group by 1) t
  join (select tech, sum(total) x from {RANKED} where rank <= 3 group by 1) using (tech))"""
oracle("top_share", f"select * from {TOP3}")
oracle("actor_dynamics", """select c.tech, c.year, total_actors, total_actors - persisting entrants, persisting,
  case when p is null then 1.0 else round((total_actors - persisting) / total_actors, 4) end new_entrant_rate,
  case when p is null then 0.0 else round(persisting / prev_actors, 4) end persistence_rate
  from (select y.tech, y.year, y.p, y.total_actors, q.total_actors prev_actors,
      (select count(*) from ay u where u.tech = y.tech and u.year = y.year and exists (
        select 1 from ay v where v.tech = u.tech and v.actor = u.actor and v.year = y.p)) persisting
    from yrs y left join yrs q on q.tech = y.tech and q.year = y.p) c""",
    ctes("""yrs as (select tech, year, count(*) total_actors, lag(year) over (partition by tech order by year) p from ay group by 1, 2)"""))
oracle("actor_timeline", f"""select tech, actor, sum(n)::bigint total, string_agg(distinct year::varchar, ' ' order by year::varchar) years_active
  from ay group by 1, 2 {top(10, 'total', 'actor')}""")
oracle("h_index", """select tech, count(*) filter (citations >= r) h_index from (select tech, citations,
  row_number() over (partition by tech order by citations desc) r from pap) group by 1""")
FEATURES = """rk as (select tech, year, n v, row_number() over (partition by tech order by year) rn, count(*) over (partition by tech) len from fser),
fe as (select tech, count(*) as years, sum(v)::bigint total, avg(case when rn <= greatest(len // 2, 1) then v end) a1,
  avg(case when rn > len // 2 then v end) a2, stddev_pop(case when rn > len // 2 then v end) sd,
  max(case when rn = greatest(len - 2, 1) then v end) r0, max(case when rn = len then v end) r1 from rk group by 1),
ft as (select tech, years, total, a1 avg_first, a2 avg_second, case when years >= 2 and r0 > 0 then (r1 - r0) / r0 else 0 end recent_growth,
  case when a1 > 0 then (a2 - a1) / a1 when a2 > 0 then 1.0 else 0.0 end overall_growth, case when a2 > 0 then sd / a2 else 1.0 end variation from fe)"""
oracle("recent_trend_features", "select tech, years, total, " + ", ".join(
    f"round({x}, 6) {x}" for x in ("avg_first", "avg_second", "recent_growth", "overall_growth", "variation")) + " from ft", ctes(FEATURES))
STOP_LIST = repr(STOPWORDS)
STOP = "(select unnest(" + repr(STOPWORDS) + "))"
WORDS = "regexp_extract_all({t}, '" + WORD_PATTERN.replace("{", "{{").replace("}", "}}") + "')"
TERMS_SQL = f"""typed as (select tech, query from {values(TYPED)}),
tit as (select t.tech, t.query, x.title from (select title from records union all select title from projects) x
  join typed t on contains(' ' || {norm('x.title')}, ' ' || {norm('t.query')})),
wrd as (select tech, query, {WORDS.format(t='title')} w from tit),
grm as (select tech, query, unnest(list_concat([array_to_string(w[i:i+1], ' ') for i in range(1, len(w))],
    [array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)])) form from wrd),
cnt as (select tech, lower(form) as norm, form, count(*) n from grm where contains(lower(form), lower(trim(query)))
  and split_part(lower(form), ' ', 1) not in {STOP} and split_part(lower(form), ' ', -1) not in {STOP}
  and not regexp_matches(split_part(lower(form), ' ', 1), '^\\p{{L}}$') and not regexp_matches(split_part(lower(form), ' ', -1), '^\\p{{L}}$') group by 1, 2, 3),
bst as (select tech, norm, arg_min(form, (-n, form)) form, sum(n)::bigint n from cnt group by 1, 2)"""
oracle("best_surface_form", "select * from bst", ctes(TERMS_SQL))


def cap(w: str) -> str:
    return f"upper(substr({w}, 1, 1)) || lower(substr({w}, 2))"


def smart(t: str) -> str:
    return f"""case when {t} = upper({t}) or {t} = lower({t}) then array_to_string([case when w = upper(w) and w <> lower(w) and length(w) <= 4
  and not list_contains({STOP_LIST}, lower(w)) and not regexp_matches(w, '^\\p{{L}}$') then w else {cap('w')} end for w in string_split({t}, ' ')], ' ') else {t} end"""


oracle("suggest_terms", f"select tech, norm, {smart('form')} term, n from bst {top(30, 'n', 'norm')}", ctes(TERMS_SQL))
oracle("jaccard_top_pairs", f"select tech, code_a, code_b, jaccard from jac where jaccard > 0 {top(8, 'jaccard', 'code_a, code_b')}")
SUMMARY = "(select tech, max(jaccard) max_jaccard, round(sum(jaccard::decimal(20,4))::double / count(*), 4) mean_jaccard from jac where jaccard > 0 group by 1)"
oracle("jaccard_summary", f"select * from {SUMMARY}")

# --- order, top-k, sets --------------------------------------------------------------
oracle("topk", "select tech, code, n, row_number() over (partition by tech order by n desc, code) as rank from cr qualify rank <= 30")
oracle("europe_first_order", f"""select tech, row_number() over (partition by tech order by is_european desc, total desc, country) as position, country, label, is_european, total
  from (select tech, country, coalesce(label, country) as label, coalesce(is_european, false) is_european, total from mc left join dim_country using (country)
    where not coalesce(is_office, false) {top(15, 'total', 'country')})""")
oracle("top_papers", """select tech, row_number() over (partition by tech order by citations desc, paper_id) as position, paper_id, title, venue, year, citations,
  array_to_string(([p_brand, p_type, 'Author ' || p_size, p_name])[1:least(3, p_size % 4 + 1)], ', ') || case when p_size % 4 = 3 then ' et al.' else '' end authors_short
  from pap qualify position <= 10""")
oracle("union_years", """select tech, year from spine union select r.tech, year from rby r join terms using (tech) where year between start_year and end_year
  union select r.tech, year from pby r join terms using (tech) where year between start_year and end_year""")
YEAR_BEFORE = """yb as (select tech, year, lag(year) over (partition by tech order by year) p from (select distinct tech, year from ay)),
now_ as (select a.tech, a.year, a.actor from ay a join yb using (tech, year) where p is not null),
then_ as (select yb.tech, yb.year, a.actor from yb join ay a on a.tech = yb.tech and a.year = yb.p)"""
oracle("entrants_except", "select * from now_ except select * from then_", ctes(YEAR_BEFORE))
oracle("persisting_intersect", "select * from now_ intersect select * from then_", ctes(YEAR_BEFORE))
oracle("union_term_matches", "select distinct record_id from rm")
oracle("jaccard_set_union", """select j.tech, j.code_a, j.code_b, count(distinct record_id) union_n from jac j
  join cl on cl.tech = j.tech and cl.code in (j.code_a, j.code_b) group by 1, 2, 3""")
oracle("dedupe_ordered", "select tech, country, min(record_id) first_position from rm group by 1, 2")

# --- scalar functions ----------------------------------------------------------------
oracle("normalize_actor_name", f"""select c_custkey, {actor_name('raw')} as name from (select c_custkey, concat('  ', c_name, case
  when c_nationkey < 5 then ' Co. Ltd.' when c_nationkey < 10 then '  & Co. KG' when c_nationkey < 15 then ' Corporation'
  when c_nationkey < 20 then ', Inc.' else ' Holding AG Ltd ' end) raw from customer)""", "")
oracle("normalize_code", f"""select l_orderkey, trim(x) code, {code4('x')} code4, {code4('x', 3)} code3
  from (select l_orderkey, unnest(string_split(codes, ',')) x from order_text)""")
oracle("code_sets", "select record_id l_orderkey, array_to_string(cs, ' ') code_set from code_lists where len(cs) >= 2")
oracle("parse_pub_date", """select o_orderkey, case when o_orderstatus = 'P' then strftime(o_orderdate, '%Y%m') else strftime(o_orderdate, '%Y-%m-%d') end pub_date
  from orders""", "")
oracle("section_bucket", """select case when substr(code,1,1) in ('A','B','C','D','E','F','G','H','Y') then substr(code,1,1) else 'other' end section, count(*) n
  from record_code group by 1""")
oracle("title_case_smart", f"""select p_partkey, {smart('t')} term from (select p_partkey, case when p_size < 20 then upper(p_name) when p_size < 35 then
  array_to_string([{cap('w')} for w in string_split(p_name, ' ')], ' ') else p_name end t from part)""", "")
oracle("title_case", f"""select p_partkey, {cap('p_type')} || '-' || array_to_string([{cap('w')} for w in string_split(p_name, ' ')], ' ') term from part""", "")
oracle("format_int_de", "select doc_id, replace(format('{:,}', n_chars * 1234567), ',', '.') as text from documents", "")


def fixed(x: str, d: int) -> str:
    return f"round({x}, {d})::decimal(38,{d})::varchar"


oracle("format_pct_de", f"""select l_orderkey, replace({fixed('p', 1)}, '.', ',') || '%' as text from (select l_orderkey,
  sum(l_discount::decimal(10,2))::double / count(*) * 100 p from lineitem group by 1)""", "")
oracle("format_eur", f"""select o_orderkey, case when v >= 1e9 then replace({fixed('v / 1e9', 1)}, '.', ',') || ' Mrd. EUR'
  when v >= 1e6 then replace({fixed('v / 1e6', 1)}, '.', ',') || ' Mio. EUR' when v >= 1e3 then {fixed('v / 1e3', 0)} || ' Tsd. EUR'
  else {fixed('v', 0)} || ' EUR' end as text
  from (select o_orderkey, o_totalprice * case o_orderstatus when 'P' then 100000.0::double when 'F' then 100.0::double else 0.01::double end v from orders)""", "")
oracle("trend_word", f"""select tech, case when cagr > 15 then 'very strong growth' when cagr > 5 then 'solid growth' when cagr > 0 then 'slight growth'
  when cagr > -5 then 'stagnation' else 'decline' end trend from ({cagr_sql('fy', 'funding', '')})""")
HHI = """(select tech, round(sum(total * total)::double / (sum(total)::double * sum(total)::double) * 10000, 1) hhi from ma group by 1)"""
BAND = "case when hhi < 1500 then 'Low' when hhi < 2500 then 'Moderate' else 'High' end concentration"
oracle("hhi", f"select tech, hhi, {BAND} from {HHI}")
oracle("hhi_band", f"select tech, {BAND} from {HHI}")
oracle("r2_band", """select case when v >= 0.9 then 'excellent' when v >= 0.7 then 'good' when v >= 0.5 then 'acceptable' else 'weak' end band, count(*) n
  from (select l_discount * 10 v from lineitem) group by 1""", "")
oracle("top3_band", f"""select tech, case when top3_share * 100 > 50 then 'dominant' when top3_share * 100 > 30 then 'moderate' else 'fragmented' end band from {TOP3}""")
oracle("connectivity_band", f"""select tech, case when mean_jaccard > 0.3 then 'high' when mean_jaccard > 0.1 then 'moderate' else 'low' end band from {SUMMARY}""")
oracle("breadth_trend", """select tech, case when a > 0 and z > 0 then case when z > a then 'broader' when z < a then 'narrower' else 'stable' end end trend
  from (select tech, arg_min(subclasses, year) a, arg_max(subclasses, year) z from tb group by 1)""")
oracle("eu_share_top10", f"""select tech, count(*) filter (is_european) european, count(*) listed
  from (select * from mc {top(10, 'total', 'country')}) left join dim_country using (country) group by 1""")

# --- domain analytics ----------------------------------------------------------------
oracle("code_jaccard", "select * from jac")
oracle("code_jaccard_by_year", """select py.tech, py.pub_year, a, b, py.n, ca.n n_a, cb.n n_b from py
  join cy ca on ca.tech = py.tech and ca.pub_year = py.pub_year and ca.code = a join cy cb on cb.tech = py.tech and cb.pub_year = py.pub_year and cb.code = b""")
oracle("code_jaccard_window", """select p.tech, p.a code_a, p.b code_b, p.n, ca.n + cb.n - p.n union_n, round(p.n / (ca.n + cb.n - p.n), 4) jaccard
  from wp p join wt ca on ca.tech = p.tech and ca.code = p.a join wt cb on cb.tech = p.tech and cb.code = p.b""", ctes(
    """wl as (select * from cl where pub_year between 1997 and 1999),
wt as (select tech, code, count(distinct record_id) n from wl group by 1, 2 qualify row_number() over (partition by tech order by n desc, code) <= 10),
wp as (select x.tech, x.code a, y.code b, count(distinct x.record_id) n from wl x join wl y on x.tech = y.tech and x.record_id = y.record_id and x.code < y.code group by 1, 2, 3)"""))
ORACLE["code_cube_pairs"] = ORACLE["pairs_codes_year"]
ORACLE["code_cube_window"] = ORACLE["code_jaccard_window"]
oracle("code_cube_maps", """select x.tech, x.pub_year as year, concat(x.code, '|', y.code) pair, count(distinct x.record_id) n
  from (select * from cl semi join tc using (tech, code)) x join (select * from cl semi join tc using (tech, code)) y
    on x.tech = y.tech and x.record_id = y.record_id and x.code < y.code group by all""")
oracle("code_jaccard_matrix", """select a.tech, a.code code_a, b.code code_b, coalesce(max(j), 0.0) jaccard from
  (select tech, code_a code from mj union select tech, code_b from mj) a join (select tech, code_a code from mj union select tech, code_b from mj) b using (tech)
  left join mj on mj.tech = a.tech and mj.code_a = least(a.code, b.code) and mj.code_b = greatest(a.code, b.code) group by 1, 2, 3""", ctes(
    """ml as (select distinct tech, record_id, substr(code, 1, 1) code from (select rm.tech, rm.record_id, unnest(cs) code from rm join code_lists using (record_id))),
mk as (select * from ml where (tech, record_id) in (select tech, record_id from ml group by 1, 2 having count(*) >= 2)),
mn as (select tech, code, count(*) n from mk group by 1, 2),
mp as (select x.tech, x.code a, y.code b, count(*) n from mk x join mk y on x.tech = y.tech and x.record_id = y.record_id and x.code < y.code group by 1, 2, 3),
mj as (select mp.tech, a code_a, b code_b, round(mp.n / (p.n + q.n - mp.n), 4) j from mp join mn p on p.tech = mp.tech and p.code = a join mn q on q.tech = mp.tech and q.code = b)"""))
oracle("connections", "select tech, count(*) pairs, count(*) filter (jaccard > 0) visible_pairs from jac group by 1")


def sample_ctes(source: str, target: int) -> str:
    return f"""sr as ({source}),
st as (select tech, year, count(*) pop from sr group by 1, 2),
s1 as (select *, coalesce(sum(pop) filter (pop <= 5) over (partition by tech), 0)::bigint census, sum(pop) over (partition by tech)::bigint population from st),
s2 as (select *, {target} - census room, population - census rest from s1),
s3 as (select *, case when pop > 5 and room > 0 then (room * pop) // rest end share, case when pop > 5 and room > 0 then (room * pop) % rest end remd from s2),
s4 as (select *, room - sum(share) over (partition by tech) lo, row_number() over (partition by tech order by remd desc nulls last, year) od from s3),
al as (select tech, year, pop, population, (case when population <= {target} or pop <= 5 then pop when room <= 0 then 0
  else share + case when od <= lo then 1 else 0 end end)::bigint take from s4),
pk as (select tech, year, unnest([floor(pop / take / 2.0 + j * (pop / take))::bigint for j in range(0, take)]) idx from al where take < pop and take > 0),
sx as (select sr.*, row_number() over (partition by tech, year order by record_id) - 1 idx from sr),
sm as (select sx.tech, sx.year, record_id from sx join al using (tech, year) where take >= pop
  union all select sx.tech, sx.year, record_id from sx join pk using (tech, year, idx))"""


ROWS = "select tech, pub_year as year, record_id from rm"
oracle("stratified_sample", "select * from sm", ctes(sample_ctes(ROWS, 500)))
oracle("strata_report", """select tech, year, pop, take, take >= pop is_census, round(sum(take) over (partition by tech) / population, 4) sampling_fraction from al""",
       ctes(sample_ctes(ROWS, 500)))
oracle("jaccard_confidence", """select tech, code_a, code_b, round(p, 6) jaccard, round(se, 6) standard_error, round(se * 1.96, 6) margin,
  round(greatest(0.0, p - se * 1.96), 6) ci_lower, round(least(1.0, p + se * 1.96), 6) ci_upper, union_n effective_n
  from (select *, n / union_n p, case when ss >= ps or union_n <= 1 then 0.0 else sqrt((n / union_n) * (1 - n / union_n) / (union_n - 1)) * sqrt(greatest(0.0, 1 - ss / ps)) end se
    from (select x.tech, x.a code_a, x.b code_b, x.n, p.n + q.n - x.n union_n, ss, ps from xp x join xt p on p.tech = x.tech and p.code = a
      join xt q on q.tech = x.tech and q.code = b join (select tech, count(*) ps from sr group by 1) u on u.tech = x.tech
      join (select tech, count(*) ss from sm group by 1) w on w.tech = x.tech))""",
       ctes(sample_ctes("select distinct tech, pub_year as year, record_id from cl", 200) + """,
xl as (select * from cl where (tech, record_id) in (select tech, record_id from sm)),
xt as (select tech, code, count(distinct record_id) n from xl group by 1, 2 qualify row_number() over (partition by tech order by n desc, code) <= 15),
xp as (select x.tech, x.code a, y.code b, count(distinct x.record_id) n from xl x join xl y on x.tech = y.tech and x.record_id = y.record_id and x.code < y.code
  where (x.tech, x.code) in (select tech, code from xt) and (y.tech, y.code) in (select tech, code from xt) group by 1, 2, 3)"""))


def fit_ctes() -> str:
    """The grid search of the growth fit, one common table expression per round."""
    g, z = gr.GRID, gr.ZOOM
    out = [
        f"""fs as materialized (select tech, model, min(year)::double fx, max(year)::double lx, arg_max(cumulative, year)::double ly, sum(cumulative::double * cumulative) yy,
  avg(cumulative) my, list({{'x': year::double, 'y': cumulative::double}} order by year) pts, count(*) np
  from fitp, (values ('Logistic'), ('Gompertz')) m(model) group by 1, 2 having count(*) >= 3 and arg_max(cumulative, year) > 0)"""
    ]
    prev = None
    lk_step, u_step = (gr.LN_K_MAX - gr.LN_K_MIN) / (g - 1), 1.0 / (g - 1)
    for r in range(gr.ROUNDS):
        if prev is None:
            lk, u, src = f"({gr.LN_K_MIN!r})::double", "0.0::double", "fs"
        else:
            lk, u = f"(b.lk - {z * prev[0]!r}::double)", f"(b.u - {z * prev[1]!r}::double)"
            src = f"fs join f{r - 1} b using (tech, model)"
        out.append(f"""f{r} as materialized (select tech, model, lk, u, k, x0, sat, sse from (
  select *, list_sum([(h.y - sat * h.g) * (h.y - sat * h.g) for h in hs]) sse from (
  select *, least(greatest(coalesce(list_sum([h.y * h.g for h in hs]) / nullif(list_sum([h.g * h.g for h in hs]), 0), 0), ly * {gr.L_MIN}), ly * {gr.L_MAX}) sat from (
  select *, [{{'y': q.y, 'g': case when model = 'Logistic' then 1.0::double / (1.0::double + exp(-k * (q.x - x0))) else exp(-exp(-k * (q.x - x0))) end}} for q in pts] hs from (
  select *, (fx - {gr.X0_MARGIN}::double + gz * ({gr.LN_B_MIN!r}::double / k)) + u * ((lx + {gr.X0_MARGIN}::double + gz * ({gr.LN_B_MAX!r}::double / k)) - (fx - {gr.X0_MARGIN}::double + gz * ({gr.LN_B_MIN!r}::double / k))) x0 from (
  select *, exp(lk) k, case when model = 'Gompertz' then 1.0::double else 0.0::double end gz from (
  select fs.tech, fs.model, fx, lx, ly, yy, pts, least(greatest({lk} + (c // {g}) * {lk_step!r}::double, {gr.LN_K_MIN!r}::double), {gr.LN_K_MAX!r}::double) lk,
    least(greatest({u} + (c % {g}) * {u_step!r}::double, 0.0::double), 1.0::double) u from {src}, range({g * g}) t(c)))))))
  qualify row_number() over (partition by tech, model order by round(sse / yy, 12), lk, u) = 1)""")
        prev = (lk_step, u_step)
        lk_step, u_step = 2 * z * lk_step / (g - 1), 2 * z * u_step / (g - 1)
    out.append(f"""fit as materialized (select tech, model, round(sat, 2) sat, round(k, 6) k, round(x0, 2) x0,
  round(coalesce(1.0 - sse / nullif(list_sum([(q.y - my) * (q.y - my) for q in pts]), 0), 0), 4) r2,
  round(least(100.0, ly / sat * 100), 2) maturity_percent, sat rs, k rk_, x0 rx, np, ly from fs join f{gr.ROUNDS - 1} using (tech, model)),
best as (select * from fit qualify row_number() over (partition by tech order by r2 desc, model desc) = 1)""")
    return ",\n".join(out)


FIT = ctes(fit_ctes())
oracle("growth_curve_fit", "select tech, model, sat, k, x0, r2, maturity_percent from fit", FIT)
oracle("growth_model_select", "select tech, model, sat, k, x0, r2, maturity_percent from best", FIT)
oracle("join_fitted_values", """select c.tech, c.year, c.n, c.cumulative, case when f.tech is not null then round(b.rs * case when b.model = 'Logistic'
  then 1.0 / (1.0 + exp(-b.rk_ * (c.year - b.rx))) else exp(-exp(-b.rk_ * (c.year - b.rx))) end, 1) end fitted
  from cum c left join fitp f on f.tech = c.tech and f.year = c.year left join best b on b.tech = c.tech""", FIT)
oracle("maturity_phase", """select tech, case when maturity_percent < 10 then 'Emerging' when maturity_percent < 50 then 'Growing' when maturity_percent < 90 then 'Mature'
  else 'Saturation' end phase, round(least(0.95, coalesce(nullif(r2, 0), 0.5)), 2) confidence from best""", FIT)
oracle("fit_confidence", """select tech, round(least(0.95, greatest(0.1, r2 * 0.6::double + least(1.0, np / 15.0) * 0.2::double + least(1.0, ly / 200.0) * 0.2::double)), 2) confidence from best""", FIT)
oracle("maturity_phase_heuristic", """select tech, case when years < 3 or total = 0 then 'Unknown' when o > 0.5 and r > 0.1 then 'Emerging' when o > 0.1 and r > -0.1 then 'Growing'
  when abs(o) <= 0.2 and cv < 0.4 then 'Mature' when o < -0.1 or r < -0.2 then 'Declining' else 'Growing' end phase,
  case when years < 3 or total = 0 then 0.0 when o > 0.5 and r > 0.1 then round(least(0.9, 0.5 + o * 0.3), 2)
  when o > 0.1 and r > -0.1 then round(least(0.9, 0.5 + (1 - cv) * 0.3), 2) when abs(o) <= 0.2 and cv < 0.4 then round(least(0.9, 0.6 + (1 - cv) * 0.3), 2)
  when o < -0.1 or r < -0.2 then round(least(0.9, 0.5 + abs(o) * 0.3), 2) else 0.4 end confidence
  from (select *, overall_growth o, recent_growth r, variation cv from ft)""", ctes(FEATURES))
oracle("collab_network", "select tech, source, target, weight from edges")
oracle("collab_network_nodes", """select m.tech, m.name, total n, case when records > 0 and projects > 0 then 'both' when records > 0 then 'patent' else 'cordis' end as type
  from ma m where (m.tech, m.name) in (select tech, source from edges union select tech, target from edges)""")
oracle("publications_by_year", "select * from pubby")
oracle("papers_top_n", f"select tech, paper_id, title, venue, year, citations from pap {top(200, 'citations', 'paper_id')}")
oracle("source_failure_scan", """select distinct 'user-' || user_id tech, s source, s || ': no data' message from (
  select user_id, case event_type when 'error' then 'publications' when 'click' then 'legal entities' end s from events) where s is not null""", "")
