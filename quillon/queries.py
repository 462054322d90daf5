"""Queries over tables, one or more for each operator, with equivalent DuckDB SQL.

``$self`` is a row, the class is the table's name, ``key()`` looks rows up in another table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import catalog, documents, findings, rules, schema
from .operators.index import last_wins, table_entries
from .plans.compiler import Compiler
from .plans.parser import parse
from .plans.rules import Key, Rule
from .sources import corpus, frontmatter
from .sources.config import Catalog, MarkerRule, Route, SectionRule, Side, Vocabulary
from .streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return put


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _fails(df: DataFrame, rule: Rule, cls: str, file, indexes=None) -> DataFrame:
    return rules.evaluated(df, [rule], cls, F.col(file) if isinstance(file, str) else file, indexes)


def _value(df: DataFrame, expr: str):
    return Compiler(rules._names(df, F.lit(""))).compile(parse(expr)).col


# rules


@query("select 'segment' as rule_id, c_custkey::varchar as file from customer where c_mktsegment is null or c_mktsegment not in ('BUILDING', 'MACHINERY')")
def q_rule_in(spark, d):
    r = Rule.of("segment", '$self.c_mktsegment in ["BUILDING", "MACHINERY"]')
    return _fails(_t(spark, d, "customer"), r, "customer", "c_custkey").select("rule_id", "file")


@query("select 'not-in' as rule_id, o_orderkey::varchar as file from orders where o_orderstatus in ('F') and not (o_orderpriority = '1-URGENT' or o_orderpriority = '2-HIGH')")
def q_rule_logic(spark, d):
    r = Rule.of("not-in", '$self.o_orderstatus not_in ["F"] or ($self.o_orderpriority == "1-URGENT" or not ($self.o_orderpriority != "2-HIGH"))')
    return _fails(_t(spark, d, "orders"), r, "orders", "o_orderkey").select("rule_id", "file")


@query("select a.n_nationkey::varchar as file from nation a left join nation b on a.n_nationkey = b.n_nationkey and b.n_regionkey = 1 where a.n_name is distinct from b.n_name")
def q_rule_eq_null(spark, d):
    n = _t(spark, d, "nation")
    other = n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("other"))
    both = n.join(other, F.col("n_nationkey") == F.col("k"), "left")
    return _fails(both, Rule.of("same", "$self.n_name == $self.other"), "nation", "n_nationkey").select("file")


@query("select c_custkey::varchar as file from customer where c_mktsegment <> 'BUILDING' and c_nationkey <> 7")
def q_rule_type_mismatch(spark, d):
    """Values of different types are never equal, and comparing them is no error."""
    r = Rule.of("typed", '$self.c_nationkey == "7" or $self.c_mktsegment == "BUILDING" or $self.c_nationkey == 7 or $self.c_mktsegment == 1')
    return _fails(_t(spark, d, "customer"), r, "customer", "c_custkey").select("file")


@query("select o_orderkey::varchar as file, case when o_orderstatus = 'O' and o_orderkey % 3 = 0 then 'expected bool, got null' end as error from orders where o_orderstatus = 'O' and (o_orderkey % 3 = 0 or o_orderkey % 3 = 1)")
def q_rule_errors(spark, d):
    """An operand that isn't a boolean is an error, unless the operator's left side has decided."""
    o = _t(spark, d, "orders").withColumn("flag", F.when(F.col("o_orderkey") % 3 == 1, False).when(F.col("o_orderkey") % 3 == 2, True))
    return _fails(o, Rule.of("late", '$self.o_orderstatus != "O" or $self.flag'), "orders", "o_orderkey").select("file", "error")


@query("select o_orderkey::varchar as file from orders where (o_orderstatus || '/' || o_orderpriority) not in ('O/1-URGENT', 'F/2-HIGH', 'P/5-LOW')")
def q_let_chain(spark, d):
    r = Rule.of("pair", '$both in ["O/1-URGENT", "F/2-HIGH", "P/5-LOW"]', let={"start": 'concat($self.o_orderstatus, "/")', "both": "concat($start, $self.o_orderpriority)"})
    return _fails(_t(spark, d, "orders"), r, "orders", "o_orderkey").select("file")


@query("select c_name as file from customer where c_name like '%7' and c_mktsegment <> 'BUILDING'")
def q_context_glob(spark, d):
    r = Rule.of("glob", '$self.c_mktsegment == "BUILDING"', context={"schema_class": "customer", "path": "Customer*7"})
    other = Rule.of("other", "false", context="supplier")
    return rules.evaluated(_t(spark, d, "customer"), [r, other], "customer", F.col("c_name")).select("file")


@query("""select c_custkey::varchar as file, 'segment [see: c_mktsegment] in nation [see: c_nationkey], again [see: c_mktsegment [2]]' as message,
 'c_mktsegment=' || c_mktsegment || ';c_nationkey=' || c_nationkey || ';c_mktsegment [2]=' || c_mktsegment as quoted from customer where c_mktsegment <> 'FURNITURE'""")
def q_message(spark, d):
    r = Rule.of("m", '$self.c_mktsegment == "FURNITURE"', "segment {{$self.c_mktsegment}} in nation {{ $self.c_nationkey }}, again {{$self.c_mktsegment}}")
    x = _fails(_t(spark, d, "customer"), r, "customer", "c_custkey")
    return x.select("file", "message", F.array_join(F.transform("quoted", lambda q: F.concat(q.label, F.lit("="), q.content)), ";").alias("quoted"))


def _orders_with_lines(spark, d) -> DataFrame:
    li = _t(spark, d, "lineitem").where("l_orderkey is not null")
    made = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")))
    x = li.groupBy("l_orderkey").agg(made.alias("lines"))
    return x.select("l_orderkey", "lines", F.array_sort(F.col("lines.l_returnflag")).alias("flags"), F.array_sort(F.col("lines.l_linestatus")).alias("states"))


@query("select l_orderkey::varchar as file from lineitem group by l_orderkey having not bool_and(l_returnflag in ('N', 'A'))")
def q_every(spark, d):
    return _fails(_orders_with_lines(spark, d), Rule.of("every", 'every(x in $self.lines, x.l_returnflag in ["N", "A"])'), "order", "l_orderkey").select("file")


@query("select l_orderkey::varchar as file from lineitem group by l_orderkey having not bool_or(l_returnflag = 'R' and l_linestatus = 'O')")
def q_some(spark, d):
    return _fails(_orders_with_lines(spark, d), Rule.of("some", 'some(x in $self.lines, x.l_returnflag == "R" and x.l_linestatus == "O")'), "order", "l_orderkey").select("file")


@query("select l_orderkey::varchar as file from lineitem group by l_orderkey having count(*) filter (l_returnflag = 'R') <> 1")
def q_filter_count(spark, d):
    return _fails(_orders_with_lines(spark, d), Rule.of("arity", 'count(filter(x in $self.lines, x.l_returnflag == "R")) == 1'), "order", "l_orderkey").select("file")


@query("select vec_id::varchar as file from embeddings where len(embedding) <> 64 or embedding is null or len(list_filter(embedding, lambda x: x is null)) > 0 or label % 2 = 1")
def q_every_embedding(spark, d):
    e = _t(spark, d, "embeddings").withColumn("odd", F.col("label") % 2 == 1)
    return _fails(e, Rule.of("e", "count($self.embedding) == 64 and every(x in $self.embedding, defined(x) and not $self.odd)"), "embeddings", "vec_id").select("file")


_ARRAYS = "(select l_orderkey, list_sort(list(l_returnflag)) as a, list_sort(list(l_linestatus)) as b0, list_sort(list_concat(list(l_linestatus), list(l_returnflag) filter (l_linenumber <= 2))) as b from lineitem group by l_orderkey)"


def _arrays(spark, d) -> DataFrame:
    x = _orders_with_lines(spark, d)
    early = F.transform(F.filter("lines", lambda v: v.l_linenumber <= 2), lambda v: v.l_returnflag)
    return x.select("l_orderkey", F.col("flags").alias("a"), F.array_sort(F.concat("states", early)).alias("b"))


@query(f"select l_orderkey, array_to_string(list_concat(a, list_filter(list_sort(list_distinct(b)), lambda x: not list_contains(a, x))), ',') as v from {_ARRAYS}")
def q_union(spark, d):
    x = _arrays(spark, d)
    return x.select("l_orderkey", _value(x, 'join(union($self.a, $self.b), ",")').alias("v"))


@query(f"select l_orderkey, array_to_string(list_filter(a, lambda x: list_contains(b, x)), ',') as v from {_ARRAYS}")
def q_intersect(spark, d):
    x = _arrays(spark, d)
    return x.select("l_orderkey", _value(x, 'join(intersect($self.a, $self.b), ",")').alias("v"))


@query(f"select l_orderkey, array_to_string(list_filter(a, lambda x: not list_contains(b, x)), ',') as v from {_ARRAYS}")
def q_difference(spark, d):
    x = _arrays(spark, d)
    return x.select("l_orderkey", _value(x, 'join(difference($self.a, $self.b), ",")').alias("v"))


@query("select p_partkey, length(p_name) as n, p_brand || p_type as both, 'Int(' || p_size || ')+Int(' || p_partkey || ')' as joined from part")
def q_len_join_concat(spark, d):
    x = _t(spark, d, "part").withColumn("nums", F.array(F.col("p_size").cast("long"), "p_partkey"))
    return x.select("p_partkey", _value(x, "len($self.p_name)").alias("n"), _value(x, "concat($self.p_brand, $self.p_type)").alias("both"), _value(x, 'join($self.nums, "+")').alias("joined"))


@query("select p_partkey::varchar as file from part where not (contains(p_name, 'ring') and length(p_name) > 0 and p_brand is not null)")
def q_substring(spark, d):
    return _fails(_t(spark, d, "part"), Rule.of("s", '"ring" in $self.p_name and defined($self.p_brand)'), "part", "p_partkey").select("file")


# indexes


def _nation_index(spark, d) -> DataFrame:
    n = _t(spark, d, "nation")
    return n.select(F.col("n_nationkey").cast("string").alias("key"), F.struct("n_name", F.col("n_regionkey").cast("string").alias("region")).alias("value"))


@query("""select c_custkey::varchar as file, r_name as region from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey
 where r_name is distinct from 'ASIA'""")
def q_key_lookup(spark, d):
    region = _t(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("value"))
    c = _t(spark, d, "customer").withColumn("nation", F.col("c_nationkey").cast("string"))
    r = Rule.of("asia", '$region == "ASIA"', "{{$region}}", let={"nation": 'key("nation", $self.nation)', "region": 'key("region", $nation.region)'})
    return _fails(c, r, "customer", "c_custkey", {"nation": _nation_index(spark, d), "region": region}).select("file", F.col("quoted")[0].content.alias("region"))


@query("select o_orderkey, c_mktsegment as segment from orders left join customer on o_custkey = c_custkey and c_acctbal > 0")
def q_key_join(spark, d):
    index = _t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("value"))
    return rules.lookup(_t(spark, d, "orders"), index, F.col("o_custkey"), "segment").select("o_orderkey", "segment")


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where not exists (select 1 from part where p_partkey = l_partkey and p_size <= 40)")
def q_ref_integrity(spark, d):
    known = _t(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("key"))
    return rules.unresolved(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), known, F.col("l_partkey"))


@query("""select l_orderkey::varchar as file from lineitem left join part on l_partkey = p_partkey and p_size <= 40 group by l_orderkey having count(*) <> count(p_partkey)""")
def q_ref_integrity_rule(spark, d):
    """The same as a rule over each order's parts, against an index that is put beside the row."""
    index = _t(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_brand").alias("value"))
    o = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("parts"))
    return _fails(o, Rule.of("known", 'every(p in $self.parts, defined(key("part", p)))'), "order", "l_orderkey", {"part": index}).select("file")


@query("select user_id::varchar as key, arg_max(event_type, row(ts, event_id)) as value from events where user_id is not null group by user_id")
def q_index_last_wins(spark, d):
    e = _t(spark, d, "events").where("user_id is not null")
    return last_wins(e, F.col("user_id"), F.col("event_type"), F.struct("ts", "event_id"))


@query("select event_id, json_extract(props, '$.k')::int as k from events where json_extract(props, '$.k')::int >= 50")
def q_variant_field(spark, d):
    e = _t(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))
    return e.where("k >= 50")


# routes, names, pins


_ROUTES = [Route("Customer*[0-4]", "a.md"), Route("Customer*[3-7]", "b.md", naming=r"Customer#0000[0-9]*[02468]"), Route("Customer#00000000?", "c.md")]
_CLAIMED = """(select c_name as path, list_filter([case when regexp_matches(c_name, '^Customer.*[0-4]$') then 'Customer*[0-4]' end, case when regexp_matches(c_name, '^Customer.*[3-7]$') then 'Customer*[3-7]' end,
 case when regexp_matches(c_name, '^Customer#00000000.$') then 'Customer#00000000?' end], lambda x: x is not null) as globs from customer)"""


def _customer_files(spark, d) -> DataFrame:
    return _t(spark, d, "customer").select(F.col("c_name").alias("path"))


@query(f"select path, len(globs) as n_routes, array_to_string(globs, ', ') as globs from {_CLAIMED}")
def q_route_claims(spark, d):
    return documents.claims(_customer_files(spark, d), _ROUTES).select("path", "n_routes", F.array_join("globs", ", ").alias("globs"))


@query(f"select path as file from {_CLAIMED} where len(globs) > 1")
def q_route_conflict(spark, d):
    return documents.route_findings(_customer_files(spark, d), _ROUTES).where("code = 'E0032'").select("file")


@query(f"select path as file from {_CLAIMED} where len(globs) = 0")
def q_unrouted(spark, d):
    return documents.route_findings(_customer_files(spark, d), _ROUTES).where("code = 'E0030'").select("file")


@query(f"select path as file from {_CLAIMED} where globs = ['Customer*[3-7]'] and not regexp_full_match(path, 'Customer#0000[0-9]*[02468]')")
def q_naming_grammar(spark, d):
    return documents.route_findings(_customer_files(spark, d), _ROUTES).where("code = 'W0041'").select("file")


@query("select 'no-such.md' as governed_by, 'x/*' as route")
def q_governing_absent(spark, d):
    made = documents.governing_findings(_customer_files(spark, d), [Route("x/*", "no-such.md"), Route("y/*", "Customer#000000001")])
    return made.select(F.col("quoted")[0].content.alias("governed_by"), F.col("quoted")[1].content.alias("route"))


# text


@query("select doc_id, case when text = '' then 0 else length(text) - length(replace(text, chr(10), '')) + (case when text like '%' || chr(10) then 0 else 1 end) end as n_lines from documents")
def q_line_count(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.line_count(F.col("text")).alias("n_lines"))


_HREF = """(select page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from pages)"""


def _hrefs(spark, d) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


@query(f"select href as target, regexp_matches(href, '^(//|[A-Za-z][A-Za-z0-9+.-]*:)') as external from {_HREF} union all select url, true from pages")
def q_external_links(spark, d):
    t = _hrefs(spark, d).select(F.col("href").alias("target")).unionByName(_t(spark, d, "pages").select(F.col("url").alias("target")))
    return t.select("target", X.external(F.col("target")).alias("external"))


@query("select p_partkey, replace(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9_ -]', '', 'g'), ' ', '-') as slug from part")
def q_slug(spark, d):
    return _t(spark, d, "part").select("p_partkey", X.slug(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))


@query("""select p_partkey, s || case when n > 0 then '-' || n else '' end as slug from (select p_partkey, replace(p_name, ' ', '-') as s,
 row_number() over (partition by p_brand, replace(p_name, ' ', '-') order by p_partkey) - 1 as n from part)""")
def q_slug_numbers(spark, d):
    h = _t(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("line_no"), F.col("p_name").alias("title"))
    return documents.slug_numbers(h).select(F.col("line_no").alias("p_partkey"), "slug")


@query("select p_partkey, case when p_size % 5 = 0 then null when p_size % 5 = 1 then p_brand || '/x' when p_size % 5 = 2 then 'x' when p_size % 5 = 3 then null else 'docs/' || p_brand || '/x' end as path, case when p_size % 5 = 0 then 'E0011' when p_size % 5 = 3 then 'E0010' end as problem from part")
def q_path_resolve(spark, d):
    m = F.col("p_size") % 5
    target = F.when(m == 0, "../../../x").when(m == 1, F.concat(F.lit("../"), "p_brand", F.lit("/./x"))).when(m == 2, "../y/../x").when(m == 3, "/x").otherwise(F.concat("p_brand", F.lit("//x")))
    r = _t(spark, d, "part").select("p_partkey", X.resolved(F.lit("docs/a.md"), target).alias("r"))
    return r.select("p_partkey", "r.path", "r.problem")


@query("select p_partkey, case when p_size % 3 = 0 then p_name || '+' when p_size % 3 = 1 then replace(p_name, ' ', '%2g') else p_name || '#' end as decoded, case when p_size % 3 = 2 then 'top' end as fragment from part")
def q_percent_decode(spark, d):
    m = F.col("p_size") % 3
    target = F.when(m == 0, F.concat(F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("+"))).when(m == 1, F.replace("p_name", F.lit(" "), F.lit("%2g"))).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("%23#top")))
    return _t(spark, d, "part").select("p_partkey", X.percent_decoded(X.without_fragment(target)).alias("decoded"), X.fragment(target).alias("fragment"))


@query("select p_partkey, case when p_size % 3 = 0 then 'E0010' when p_size % 3 = 1 then 'E0011' end as problem, case when p_size % 3 = 2 then 'a/' || p_brand else null end as path from part")
def q_confinement(spark, d):
    m = F.col("p_size") % 3
    p = F.when(m == 0, F.concat(F.lit("/"), "p_brand")).when(m == 1, F.concat("p_brand", F.lit("/../x"))).otherwise(F.concat(F.lit("./a//"), "p_brand"))
    problem = X.confinement(p)
    return _t(spark, d, "part").select("p_partkey", problem.alias("problem"), F.when(problem.isNull(), X.normal_path(p)).alias("path"))


@query("""select doc_id, trim(unnest(list_filter(list_transform(p, lambda x, i: case when i % 2 = 0 and i < len(p) and x <> '' and strlen(x) <= 60 and not contains(x, chr(10)) then x end), lambda x: x is not null)), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as term
 from (select doc_id, string_split(text, '**') as p from documents)""")
def q_bold_spans(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(X.bold_spans(F.col("text"))).alias("term"))


@query("""select p_partkey, label from (select p_partkey, unnest(regexp_extract_all('see AB-' || p_size || ', Q' || p_partkey || ' and ' || p_type || p_size || ' or X-' || p_size || 'y', '\\b[A-Z]{1,7}(?:-[A-Z]{0,7})?[0-9]{1,4}\\b')) as label from part)
 where not regexp_matches(label, '^AB-[0-9]+$')""")
def q_label_clusters(spark, d):
    t = F.concat(F.lit("see AB-"), "p_size", F.lit(", Q"), "p_partkey", F.lit(" and "), "p_type", "p_size", F.lit(" or X-"), "p_size", F.lit("y"))
    x = _t(spark, d, "part").select("p_partkey", F.explode(X.labels(t)).alias("label"))
    return x.where(~F.col("label").rlike("^AB-[0-9]+$"))


_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty"]


@query(f"""select p_partkey, case when p_size <= 20 then p_size else p_partkey % 7 end::bigint as claim from part where case when p_size <= 20 then p_size else p_partkey % 7 end <> 10""")
def q_numeric_claim(spark, d):
    """A sentence that spells a number up to twenty, or has digits and a later number out of reach, against the value 10."""
    words = F.array(*map(F.lit, _WORDS))
    said = F.when(F.col("p_size") <= 20, F.concat(F.lit("There are 99 of all those and just "), F.element_at(words, F.col("p_size") + 1), F.lit(" core_parts, 3"))).otherwise(F.concat(F.lit("(about "), F.col("p_partkey") % 7, F.lit(") of the core_parts")))
    return _t(spark, d, "part").select("p_partkey", X.claimed_number(said, F.lit("core_parts")).alias("claim")).where("claim <> 10")


# dependencies


def _edges(spark, d) -> DataFrame:
    return incremental.shared_key_edges(_t(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h")), "h", "doc_id")


_EDGES = "(select low as a, doc_id as b from (select doc_id, min(doc_id) over (partition by text) as low from documents where text is not null) where doc_id <> low)"


@query(f"select a, b from {_EDGES}")
def q_shared_key_edges(spark, d):
    return _edges(spark, d)


@query(f"""with recursive e as (select a, b from {_EDGES} union select b, a from {_EDGES}), r as (select min(a) as node from e union select e.b from r join e on e.a = r.node) select node from r""")
def q_dep_closure(spark, d):
    e = _edges(spark, d)
    return incremental.closure(e, e.agg(F.min(F.least("a", "b")).alias("node")))


@query(f"""with recursive e as (select a, b from {_EDGES} union select b, a from {_EDGES}), r as (select min(a) as node from e union select e.b from r join e on e.a = r.node)
 select doc_id::varchar as file from documents where lang <> 'xx' and doc_id in (select node from r)""")
def q_incremental_scope(spark, d):
    e = _edges(spark, d)
    scope = incremental.closure(e, e.agg(F.min(F.least("a", "b")).alias("node")))
    mine = incremental.scoped(_t(spark, d, "documents").select("doc_id", "lang"), scope, "doc_id")
    return rules.check(mine, [Rule.of("lang", '$self.lang == "xx"')], "documents", F.col("doc_id")).select("file")


# schema


def _schema(spark, d, name: str, file: str, s: dict) -> DataFrame:
    t = _t(spark, d, name)
    return schema.table_findings(t, s, F.col(file)).select("file", F.col("quoted")[0].content.alias("pointer"), "message")


@query("select n_nationkey::varchar as file, '' as pointer, 'required: n_comment is missing' as message from nation")
def q_schema_required(spark, d):
    return _schema(spark, d, "nation", "n_nationkey", {"required": ["n_name", "n_comment"]})


@query("""select c_custkey::varchar as file, '/c_mktsegment' as pointer, 'enum: not one of ["BUILDING", "MACHINERY"]' as message from customer where c_mktsegment not in ('BUILDING', 'MACHINERY')""")
def q_schema_enum(spark, d):
    return _schema(spark, d, "customer", "c_custkey", {"properties": {"c_mktsegment": {"enum": ["BUILDING", "MACHINERY"]}}})


@query("""select p_partkey::varchar as file, '/p_size' as pointer, 'maximum: maximum is 40' as message from part where p_size > 40 union all
 select p_partkey::varchar, '/p_retailprice', 'exclusiveMinimum: exclusiveMinimum is 950' from part where p_retailprice <= 950""")
def q_schema_bounds(spark, d):
    return _schema(spark, d, "part", "p_partkey", {"properties": {"p_size": {"type": "integer", "minimum": 1, "maximum": 40}, "p_retailprice": {"type": "number", "exclusiveMinimum": 950}}})


@query("""select p_partkey::varchar as file, '/p_brand' as pointer, 'pattern: doesn''t match ^Brand#[1-9]$' as message from part where not regexp_matches(p_brand, '^Brand#[1-9]$') union all
 select p_partkey::varchar, '/p_name', 'minLength: shorter than 10' from part where length(p_name) < 10""")
def q_schema_pattern(spark, d):
    return _schema(spark, d, "part", "p_partkey", {"properties": {"p_brand": {"pattern": "^Brand#[1-9]$", "type": "string"}, "p_name": {"minLength": 10, "maxLength": 100}}})


@query("select r_regionkey::varchar as file, '/r_name' as pointer, 'additionalProperties: r_name isn''t allowed' as message from region")
def q_schema_closed(spark, d):
    return _schema(spark, d, "region", "r_regionkey", {"properties": {"r_regionkey": {}}, "additionalProperties": False})


# documents: files whose places are known by arithmetic, written from every row of the table


def _files(spark, d) -> DataFrame:
    """``(path, text)`` of a markdown file for each document: front-matter, a link, a citation, bold terms, a fence, two sections."""
    k = F.col("doc_id")
    s = lambda *parts: F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))
    m, nxt = k % 3, k + 1
    head = F.array(
        F.lit("---"), s("schema_class: ", F.element_at(F.array(*map(F.lit, ("note", "memo", "lost"))), (m + 1).cast("int"))), s("members: ", k % 4), F.lit("---"), s("# Doc ", k), s("See docs/", F.col("lang"), "/d", nxt, ".md:", k % 30 + 1, " for more."),
        s("[next](d", nxt, ".md#part-a) [own](#part-", F.when(k % 2 == 0, "a").otherwise("z"), ") [web](https://x.y/z) [up](../../../x.md)"), s("**Term", k % 5, "** and ****gone**** and `ZZ-Z9` AB-", k % 50),
        F.lit("```"), F.lit("**Fenced** Q-999"), F.lit("```"), F.lit("## Part A"), s("We have ", k % 6, " members now."),
    )
    steps = F.transform(F.when(m > 0, F.sequence(F.lit(1).cast("long"), m)).otherwise(F.array().cast("array<bigint>")), lambda i: s("### P", i, " step"))
    tail = F.array(F.lit("## Part B"), s("- **P", k % 4, "** done"), s("Provenance: Name", k % 9, "."), s("See Q-", k % 11, " and xQ-5."), F.lit(""))
    return _t(spark, d, "documents").select(s("docs/", F.col("lang"), "/d", k, ".md").alias("path"), F.array_join(F.concat(head, steps, tail), "\n").alias("text"))


def _docs(spark, d) -> DataFrame:
    return frontmatter.documents(_files(spark, d))


def _spread(t: DataFrame, key: str) -> DataFrame:
    """Rows of a few narrow columns on every core, whatever row groups their file has; the texts are written after that."""
    return t.repartition(4 * t.sparkSession.sparkContext.defaultParallelism, key)


_D = "(select doc_id as k, doc_id % 3 as m, lang, 'docs/' || lang || '/d' || doc_id || '.md' as path from documents)"
_PART_B = "'## Part B' || chr(10) || '- **P' || k % 4 || '** done' || chr(10) || 'Provenance: Name' || k % 9 || '.' || chr(10) || 'See Q-' || k % 11 || ' and xQ-5.' || chr(10)"


@query(f"""select path, 5 as line_no, 1 as level, 'Doc ' || k as title, null as bullet, false as fenced from {_D} union all select path, unnest([9, 10, 11]), 0, null, null, true from {_D}
 union all select path, 12, 2, 'Part A', null, false from {_D} union all select path, 13 + i, 3, 'P' || i || ' step', null, false from (select path, unnest(range(1, m + 1)) as i from {_D})
 union all select path, 14 + m, 2, 'Part B', null, false from {_D} union all select path, 15 + m, 0, null, 'P' || k % 4, false from {_D}""")
def q_line_structure(spark, d):
    """Headings, fences and bullet leads, by line."""
    x = documents.lines(_docs(spark, d)).where("level > 0 or fenced or bullet is not null")
    return x.select("path", "line_no", "level", "title", "bullet", "fenced")


@query(f"""select path, 5 as line_no, 18 + m as last from {_D} union all select path, 12, 13 + m from {_D} union all select path, 13 + i, 13 + i from (select path, unnest(range(1, m + 1)) as i from {_D})
 union all select path, 14 + m, 18 + m from {_D}""")
def q_section_spans(spark, d):
    return documents.sections(documents.lines(_docs(spark, d))).select("path", "line_no", "last")


@query(f"select path, unnest(list_concat(['doc-' || k, 'part-a', 'part-b'], list_transform(range(1, m + 1), lambda i: 'p' || i || '-step'))) as slug from {_D}")
def q_heading_slugs(spark, d):
    return documents.heading_slugs(_docs(spark, d))


@query(f"select path, 7 as line_no, unnest(['d' || (k + 1) || '.md#part-a', case when k % 2 = 0 then '#part-a' else '#part-z' end, 'https://x.y/z', '../../../x.md']) as target from {_D}")
def q_link_targets(spark, d):
    return documents.links(_docs(spark, d))


@query(f"select path, 6 as line_no, 'docs/' || lang || '/d' || (k + 1) || '.md' as cited, k % 30 + 1 as first from {_D}")
def q_citations(spark, d):
    return documents.citations(_docs(spark, d)).select("path", "line_no", "cited", "first")


@query(f"""select case when n.path is null then 'E0100' else 'E0101' end as code, a.path as file, 6 as line, 'docs/' || a.lang || '/d' || (a.k + 1) || '.md:' || (a.k % 30 + 1) as citation
 from {_D} a left join {_D} n on n.k = a.k + 1 and n.lang = a.lang where n.path is null or a.k % 30 + 1 > 17 + n.m""")
def q_citation_range(spark, d):
    """Cited files that aren't there, and lines beyond a file's end."""
    f = documents.citation_findings(_docs(spark, d), _files(spark, d))
    return f.select("code", "file", "line", F.col("quoted")[0].content.alias("citation"))


@query(f"""select 'E0110' as code, a.path as file, 'd' || (a.k + 1) || '.md#part-a' as link from {_D} a where not exists (select 1 from documents n where n.doc_id = a.k + 1 and n.lang = a.lang)
 union all select 'E0111', path, '#part-z' from {_D} where k % 2 = 1 union all select 'E0011', path, '../../../x.md' from {_D}""")
def q_dead_links(spark, d):
    """Links to absent files and headings, and out of the root."""
    return documents.link_findings(_docs(spark, d), _files(spark, d)).select("code", "file", F.col("quoted")[0].content.alias("link"))


@query(f"select path as file, 16 + m as line, 'Name' || k % 9 || '.' as name from {_D} where k % 9 not between 1 and 6")
def q_markers(spark, d):
    """Names that the team's section doesn't list; a name outside the section doesn't count."""
    team = "# People\n## Team\n" + "".join(f"- **Name{i}.** x\n" for i in range(1, 7)) + "## Others\n- **Name7** x\n"
    files = _files(spark, d).unionByName(spark.createDataFrame([("people.md", team)], "path string, text string"))
    rule = MarkerRule("Provenance: (.*)", "list-item-bold-name", "people.md", "## Team")
    f = documents.marker_findings(_docs(spark, d), files, [Route("docs/*.md", "people.md", marker_rules=(rule,))])
    return f.select("file", "line", F.col("quoted")[0].content.alias("name"))


@query(f"select path as file, 17 + m as line, 'Q-' || k % 11 as code from {_D} where k % 11 > 7")
def q_orphan_codes(spark, d):
    f = documents.catalog_findings(_docs(spark, d), [Catalog("Q-", True, tuple(f"Q-{i}" for i in range(8))), Catalog("R-", False)])
    return f.select("file", "line", F.col("quoted")[0].content.alias("code"))


_VOCABULARY = Vocabulary(
    terms=(("Term0", "registered", ""), ("Term1", "draft", ""), ("Term2", "registered", ""), ("Term2", "draft", ""), ("Fenced", "registered", ""), ("P2", "reserved", "")),
    labels=("^P[0-9]+$", "^Q-[0-9]+$"), anti_patterns=(("have [0-9]+", "plain"),), numeric=("members",),
)


def _vocabulary(spark, d, *codes: str) -> DataFrame:
    f = documents.vocabulary_findings(_docs(spark, d), _VOCABULARY)
    return f.where(F.col("code").isin(*codes)).select("code", "file", "line", F.col("quoted")[0].content.alias("found"))


@query(f"""select 'E0090' as code, path as file, 8 as line, 'Term' || k % 5 as found from {_D} where k % 5 > 2 union all select 'E0090', path, 15 + m, 'P' || k % 4 from {_D} where k % 4 <> 2
 union all select 'W0044', 'vocabulary.yaml', 1, 'Term2'""")
def q_coinage(spark, d):
    """Bold terms without an entry; a term with two states."""
    return _vocabulary(spark, d, "E0090", "W0044")


@query(f"select 'E0091' as code, path as file, 8 as line, 'AB-' || k % 50 as found from {_D}")
def q_label_schemes(spark, d):
    """Labels of no allowed scheme; code isn't prose."""
    return _vocabulary(spark, d, "E0091")


@query(f"select 'E0092' as code, path as file, case when m = 2 then 15 else 15 + m end as line, 'P2' as found from {_D} where m = 2 or k % 4 = 2")
def q_reserved_term(spark, d):
    """The first whole word of a reserved term in each file."""
    return _vocabulary(spark, d, "E0092")


@query(f"select 'E0093' as code, path as file, 13 as line, 'have ' || k % 6 as found from {_D}")
def q_anti_pattern(spark, d):
    return _vocabulary(spark, d, "E0093")


@query(f"select 'E0094' as code, path as file, 13 as line, 'We have ' || k % 6 || ' members now.' as found from {_D} where k % 6 <> k % 4")
def q_numeric_drift(spark, d):
    """Numbers in prose that differ from the field they speak of."""
    return _vocabulary(spark, d, "E0094")


def _pins(spark, d) -> DataFrame:
    """For each file, in turn: its right hash, a wrong one, a section's, an absent section, and a file that isn't there."""
    n = F.xxhash64("path")
    k = F.regexp_extract("path", "d([0-9]+)", 1).cast("long")
    kind = k % 5
    file = F.when(kind == 4, F.concat("path", F.lit(".gone"))).otherwise(F.col("path"))
    section = F.when(kind == 2, "## Part B").when(kind == 3, "## Part C")
    return _files(spark, d).select(n.alias("pin"), F.lit("rules.md").alias("governing"), file.alias("file"), section.alias("section"), F.when(kind == 0, F.sha2("text", 256)).otherwise(F.lit("0" * 64)).alias("sha256"))


@query(f"""select case k % 5 when 4 then 'E0062' when 3 then 'E0063' else 'E0061' end as code, case k % 5 when 4 then 'pins.yaml' else path end as file, case k % 5 when 4 then path || '.gone' else path end as pinned from {_D} where k % 5 > 0""")
def q_pin_stale(spark, d):
    """Pins whose content changed, or is absent."""
    return documents.pin_findings(_docs(spark, d), _pins(spark, d)).select("code", "file", F.col("quoted")[0].content.alias("pinned"))


@query(f"""select path as file, '## Part B' as section, sha256({_PART_B}) as actual from {_D} where k % 5 = 2""")
def q_pin_section_hash(spark, d):
    """What an update of stale section pins would record."""
    return documents.pin_updates(_docs(spark, d), _pins(spark, d)).where("section is not null").select("file", "section", "actual")


@query("select 'd' || doc_id as file, sha256(text) as actual from documents where text is not null")
def q_pin_hash(spark, d):
    """The same for pins of whole texts."""
    files = _t(spark, d, "documents").where("text is not null").select(F.concat(F.lit("d"), "doc_id").alias("path"), "text")
    pins = files.select(F.xxhash64("path").alias("pin"), F.lit("g").alias("governing"), F.col("path").alias("file"), F.lit(None).cast("string").alias("section"), F.lit("").alias("sha256"))
    return documents.pin_updates(files.withColumn("body_from", F.lit(1)), pins).select("file", "actual")


def _sections(spark, d, rule: SectionRule) -> DataFrame:
    return documents.section_findings(_docs(spark, d), [Route("docs/*.md", "g.md", section_rules=(rule,))])


@query(f"select path as file, 'found ' || m || ', wanted >= 2' as message from {_D} where m < 2")
def q_section_count(spark, d):
    return _sections(spark, d, SectionRule("## Part A", "h3", "^P[0-9]", ">= 2")).select("file", "message")


@query(f"select path as file, 'P' || k % 4 as ids from {_D} where k % 4 between 1 and m")
def q_section_disjoint(spark, d):
    sides = (Side("## Part A", "h3-heading", "^(P[0-9]+)"), Side("## Part B", "bullet-lead", "^(P[0-9]+)"))
    return _sections(spark, d, SectionRule(disjoint=sides)).select("file", F.col("quoted")[0].content.alias("ids"))


@query(f"""select path as file, 3 as line, '/members' as pointer, 'maximum: maximum is 2' as message from {_D} where m = 0 and k % 4 = 3 union all select path, 1, '', 'required: title is missing' from {_D} where m = 1""")
def q_schema_dispatch(spark, d):
    """Front-matter by its class's schema, at the line of what is wrong."""
    schemas = {"note": {"properties": {"members": {"type": "integer", "maximum": 2}}}, "memo": {"required": ["title"]}}
    return schema.document_findings(_docs(spark, d), schemas).select("file", "line", F.col("quoted")[0].content.alias("pointer"), "message")


@query(f"select path as file, 'lost' as class from {_D} where m = 2")
def q_unrouted_class(spark, d):
    from .engine import unrouted_classes

    return unrouted_classes(_docs(spark, d), {"note": {}}, [Rule.of("r", "true", context="memo")]).select("file", F.col("quoted")[0].content.alias("class"))


@query("""select case when p_size % 4 = 1 then 'W0040' else 'E0001' end as code, 'p' || p_partkey || '.md' as file from part where p_size % 4 > 0""")
def q_front_matter(spark, d):
    """Front-matter that is missing, broken, or has a key twice; such a file is parsed no further."""
    kind = F.col("p_size") % 4
    text = F.when(kind == 0, "---\na: 1\n---\nx\n").when(kind == 1, "---\nnever closed\n").when(kind == 2, "---\na: [1\n---\n").otherwise("---\na: 1\na: 2\n---\n")
    docs = frontmatter.documents(_spread(_t(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select(F.concat(F.lit("p"), "p_partkey", F.lit(".md")).alias("path"), text.alias("text")))
    return frontmatter.problems(docs, ["*.md"]).select("code", "file")


@query("""select 'E0003' as code, 'p' || p_partkey as file, case p_size % 4 when 1 then 'state: too_large' else 'state: not_utf8' end as message from part where p_size % 4 in (1, 2) and p_partkey > 9
 union all select 'E0012', 'p' || p_partkey, 'a file is a symbolic link, which isn''t followed' from part where p_partkey <= 9""")
def q_capture_states(spark, d):
    """Files too large, not UTF-8, or links; names p0 to p9 are links, whatever they hold."""
    kind, p = F.col("p_size") % 4, _t(spark, d, "part")
    raw = p.where("p_partkey > 9").select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.when(kind == 1, F.lit(corpus.FILE_BYTES + 1)).otherwise(F.lit(2)).cast("long").alias("size"), F.when(kind == 2, F.unhex(F.lit("FFFE"))).otherwise(F.encode("p_name", "utf-8")).alias("content"))
    raw = raw.unionByName(p.where("p_partkey <= 9").select(F.concat(F.lit("p"), "p_partkey", F.lit("/inside")).alias("path"), F.lit(2).cast("long").alias("size"), F.encode("p_name", "utf-8").alias("content")))
    return corpus.unreadable(corpus.captured(raw, [f"p{i}" for i in range(10)])).select("code", "file", "message")


@query("""select 'd' || lpad(doc_id::varchar, 12, '0') as path, case when lang <> 'en' and sum(case when lang <> 'en' then strlen(text) else 0 end) over (order by doc_id) > (select sum(strlen(text)) // 3 from documents where lang <> 'en') then 'too_large' else 'ok' end as state from documents""")
def q_byte_budget(spark, d):
    """Governed files (English) are all read; the others as far as a third of their bytes goes."""
    t = _t(spark, d, "documents").select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), F.octet_length("text").cast("long").alias("size"), F.lit("ok").alias("state"), "text", "lang")
    own, rest = t.agg(F.sum(F.when(F.col("lang") == "en", F.col("size")).otherwise(0)), F.floor(F.sum(F.when(F.col("lang") != "en", F.col("size")).otherwise(0)) / 3)).first()
    named = t.withColumn("path", F.concat(F.when(F.col("lang") == "en", "en/").otherwise("x/"), "path")).drop("lang")
    return corpus.within_budget(named, F.startswith("path", F.lit("en/")), own + rest).select(F.substring_index("path", "/", -1).alias("path"), "state")


@query("select g as glob from (values ('docs/*.md'), ('docs/xx/**/*.md')) t(g) union all select 'docs/en/d7.md' where not exists (select 1 from documents where doc_id = 7 and lang = 'en') union all select '**/d3.md' where not exists (select 1 from documents where doc_id = 3)")
def q_dead_globs(spark, d):
    """Globs that choose no file: a star stays within a folder."""
    globs = ["docs/*.md", "docs/*/*.md", "docs/xx/**/*.md", "docs/en/d7.md", "**/d3.md", "**/*.md", "docs/[a-z]?/d*.md"]
    return corpus.dead_globs(_files(spark, d), globs).select(F.col("quoted")[0].content.alias("glob"))


@query("select 'R' || n_regionkey as key, '{\"id\": \"R' || n_regionkey || '\", \"n\": ' || max(n_nationkey) || '}' as value from nation group by n_regionkey union all select 'all', '{\"id\": \"all\", \"n\": ' || max(n_nationkey) || '}' from nation")
def q_index_entries(spark, d):
    """An index over the entries of many YAML and JSON sources; the last in order of paths and places wins."""
    k = F.col("n_nationkey")
    name = F.concat(F.lit("reg/"), F.lpad(k.cast("string"), 3, "0"))
    yaml_ = F.concat(F.lit("list:\n- {id: R"), "n_regionkey", F.lit(", n: "), k, F.lit("}\n- {id: all, n: "), k, F.lit("}\n"))
    json_ = F.concat(F.lit('{"list": [{"id": "R'), "n_regionkey", F.lit('", "n": '), k, F.lit('}, {"id": "all", "n": '), k, F.lit("}]}"))
    even = k % 2 == 0
    sources = _t(spark, d, "nation").select(F.concat(name, F.when(even, ".yaml").otherwise(".json")).alias("path"), F.when(even, yaml_).otherwise(json_).alias("text"))
    e = table_entries(sources, Key("x", "reg/*", "$.list", "$.id"))
    return last_wins(e, F.col("key"), F.col("value"), F.struct("path", "place"))


@query(f"select path as a, 'docs/' || lang || '/d1.md' as b from {_D} where k <> 1 union all select path, 'registry.yaml' from {_D} where m = 0")
def q_governance_edges(spark, d):
    """Edges to governing documents and to the sources of the indexes that rules read."""
    docs = _docs(spark, d).select("path", "schema_class")
    lead = F.concat(F.regexp_extract("path", "^(docs/[^/]+/)", 1), F.lit("d1.md"))
    governed = incremental.governance_edges(_files(spark, d).select("path", lead.alias("governed_by")))
    mine = docs.where(rules.applies(Rule.of("r", "true", context="note"), F.col("schema_class"), F.col("path"))).select(F.lit("r").alias("rule"), "path")
    return governed.unionByName(incremental.rule_edges(mine, spark.createDataFrame([("r", "registry.yaml")], "rule string, source string")))


@query(f"""select path, case when path like '%1.md' then 2 else 1 end as n_routes, true as citations, path like '%1.md' as links from {_D}""")
def q_route_flags(spark, d):
    c = documents.claims(_files(spark, d), [Route("docs/**/*.md", "a.md", citations=True), Route("*1.md", "b.md", links=True)])
    return c.select("path", "n_routes", "citations", "links")


# reports


def _mixed(spark, d) -> DataFrame:
    c, n = _t(spark, d, "customer"), _t(spark, d, "nation")
    seg = rules.check(c, [Rule.of("segment", '$self.c_mktsegment in ["BUILDING", "MACHINERY"]')], "customer", F.col("c_custkey"))
    routed = documents.route_findings(_customer_files(spark, d), _ROUTES)
    enum = schema.table_findings(n, {"properties": {"n_regionkey": {"maximum": 2}}}, F.col("n_nationkey"))
    lift = findings.finding(n.where("n_regionkey = 0"), "L0001", "pin", "lifted", F.lit("lifted"), F.col("n_name"))
    gone = documents.governing_findings(_customer_files(spark, d), _ROUTES)
    return rules.union([seg, routed, enum, lift, gone])


ORACLE_SUMMARY = f"""select (select count(*) from customer where c_mktsegment not in ('BUILDING', 'MACHINERY')) + (select count(*) from {_CLAIMED} where len(globs) <> 1) + (select count(*) from nation where n_regionkey > 2) + 3 as errors,
 (select count(*) from {_CLAIMED} where globs = ['Customer*[3-7]'] and not regexp_full_match(path, 'Customer#0000[0-9]*[02468]')) as warnings, (select count(*) from nation where n_regionkey = 0) as lints"""


@query(ORACLE_SUMMARY)
def q_summary(spark, d):
    return findings.summary(_mixed(spark, d))


@query(f"""select '1.0.0' as version, 'findings' as status, errors, warnings, lints, 7 as files_checked, errors + warnings + lints as listed, 'active' as routes from ({ORACLE_SUMMARY})""")
def q_envelope(spark, d):
    """The report as one document, read back."""
    r = findings.envelope(_mixed(spark, d), 7, {"routes": "active"})
    part = lambda p, t="long": F.get_json_object("report", p).cast(t)
    n = F.json_array_length(F.get_json_object("report", "$.findings")).cast("long").alias("listed")
    return r.select(part("$.version", "string").alias("version"), part("$.status", "string").alias("status"), *(part(f"$.summary.{k}").alias(k) for k in ("errors", "warnings", "lints")), part("$.summary.files_checked").alias("files_checked"), n, part("$.families.routes", "string").alias("routes"))


_TOO_BIG = "(select p_partkey from part where p_size > 40)"


@query(f"""select p_partkey::varchar as file, 'error[E0050]: schema violation' || chr(10) || '  --> ' || p_partkey || ':1:0' || chr(10) || '  note: maximum: maximum is 40' || chr(10) || '  pointer:' || chr(10) || '    | /p_size' || chr(10) || '  see: explain E0050' as report from {_TOO_BIG}""")
def q_report_text(spark, d):
    f = schema.table_findings(_t(spark, d, "part"), {"properties": {"p_size": {"maximum": 40}}}, F.col("p_partkey"))
    return findings.report_lines(f).select("file", "report")


@query(f"""select p_partkey::varchar as file, p_partkey || ':1 E0050 pointer=/p_size maximum: maximum is 40' as report from {_TOO_BIG}""")
def q_report_compact(spark, d):
    f = schema.table_findings(_t(spark, d, "part"), {"properties": {"p_size": {"maximum": 40}}}, F.col("p_partkey"))
    return findings.report_lines(f, "compact").select("file", "report")


@query(f"""select p_partkey::varchar as file, 'uniqueItems' as keyword from part where p_size % 2 = 0 union all select p_partkey::varchar, 'anyOf' from part where p_size % 3 <> 0 and p_brand <> 'Brand#1'""")
def q_schema_rows(spark, d):
    """Keywords that have no column are judged row by row."""
    p = _t(spark, d, "part").withColumn("pair", F.array(F.col("p_size") % 2, F.lit(0)))
    s = {"properties": {"pair": {"uniqueItems": True}}, "anyOf": [{"properties": {"p_size": {"multipleOf": 3}}}, {"properties": {"p_brand": {"const": "Brand#1"}}}]}
    return schema.table_findings(p, s, F.col("p_partkey")).select("file", F.substring_index("message", ":", 1).alias("keyword"))


@query(f"""select code, title, n from (select 'E0030' as code, 'no route claims a file' as title, (select count(*) from {_CLAIMED} where len(globs) = 0) as n union all
 select 'E0032', 'several routes claim a file', (select count(*) from {_CLAIMED} where len(globs) > 1) union all
 select 'E0050', 'front-matter breaks its schema', (select count(*) from nation where n_regionkey > 2) union all select 'E0031', 'a governing document is absent', 3 union all
 select 'W0041', 'a name breaks its grammar', (select count(*) from {_CLAIMED} where globs = ['Customer*[3-7]'] and not regexp_full_match(path, 'Customer#0000[0-9]*[02468]')) union all
 select 'L0001', 'a pin was lifted', (select count(*) from nation where n_regionkey = 0)) where n > 0""")
def q_explain_catalog(spark, d):
    f = findings.known_refs(_mixed(spark, d), catalog.table(spark))
    return f.where("explain_ref is not null").groupBy("code").agg(F.count("*").alias("n")).join(catalog.table(spark), "code").select("code", "title", "n")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Findings of five families, in their order."""
    return findings.ordered(_mixed(spark, d))
