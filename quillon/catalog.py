"""Registry of the library's queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import names as N
from .functions import sequences as S
from .functions import text as X
from .operators import assets, history, incremental, joins, matching, monitor, navigation, packages, passages, prefabs, scopes, search, tracing
from .operators import graph as G
from .plans.compile import Corpus, plan, run
from .plans.language import parse
from .sources import model as M

Q = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Q] = {}
_SQL: dict[str, str] = {}
WORD = "the"
MIDNIGHT = 1_707_000_000_000

# SQL pieces: documents as files, pages as files, places as declarations, events as records.
FILES = "(select doc_id as file_key, source || '/' || lang || '/' || doc_id || '.txt' as path, source as project, lang as language, text as content from documents)"
PAGES = "(select page_id as file_key, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as path, html as content from pages)"
PLACES = """(select 'namespace' kind, r_regionkey::bigint as key, r_name as name, r_name as qualified, '' as owner, '' as namespace from region
 union all select 'module', n_nationkey::bigint, n_name, r_name || '.' || n_name, r_name, r_name from nation join region on n_regionkey = r_regionkey
 union all select 'class', c_custkey, c_name, r_name || '.' || n_name || '.' || c_name, r_name || '.' || n_name, r_name || '.' || n_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
RECORDS = """(select event_id::varchar id, event_type kind, user_id::varchar repository, (epoch_us(ts) // 1000) start_ms, (epoch_us(ts) // 1000) + floor(coalesce(value, 0))::bigint end_ms,
 case when event_type = 'purchase' then 'success' else 'noop' end status, coalesce(try_cast(json_extract_string(props, '$.k') as bigint) > 90, false) detailed from events)"""
LINES = f"(select file_key, path, language, i as line, string_split(content, chr(10))[i] as source from {FILES}, unnest(range(1, len(string_split(content, chr(10))) + 1)) t(i))"


def query(sql: str | None = None) -> Callable[[Q], Q]:
    def add(f: Q) -> Q:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _lines(needle: str, where: str = "true", low: bool = False) -> str:
    t, n = ("lower(source)", needle.lower()) if low else ("source", needle)
    return f"select path, line::bigint as line, trim(source, ' ') as source from {LINES} where contains({t}, '{n}') and {where}"


# ---- text and files


@query(_lines(WORD))
def text_lines(spark, sf):
    return search.text_search(M.files(spark, sf), None, parse(f"text:{WORD}")).select("path", "line", "source")


@query(_lines("THE", low=True))
def text_loose(spark, sf):
    return search.text_search(M.files(spark, sf), None, parse('text:"THE" match:loose')).select("path", "line", "source")


@query(_lines(WORD, "language = 'en'") + " order by path, line limit 20")
def text_topk(spark, sf):
    return run(Corpus(M.files(spark, sf)), f"text:{WORD} lang:en limit:20").select("path", "line", "source")


@query(f"""with h as (select path, line::bigint as line, content, source, instr(source, 'ou')::bigint as "column", list_sum(list_transform(string_split(content, chr(10))[1:line-1], lambda x: strlen(x) + 1)) as before from {LINES} join {FILES} using (path, file_key, language) where contains(source, 'ou'))
select path, line, "column", (coalesce(before, 0) + strlen(substr(source, 1, ("column" - 1)::int)))::bigint as at from h""")
def text_offsets(spark, sf):
    return search.text_matches(M.files(spark, sf), "ou").select("path", "line", "column", "at")


@query(f"""with l as (select file_key, n, line, sum(length(line) + 1) over (partition by file_key order by n) - length(line) - 1 as start from (select file_key, i as n, string_split(content, chr(10))[i] as line from {FILES}, unnest(range(1, len(string_split(content, chr(10))) + 1)) t(i))),
 i as (select *, sum((trim(line, ' ') = '')::int) over (partition by file_key order by n) as island from l),
 p as (select file_key, min(n)::bigint first_line, max(n)::bigint last_line, min(start)::bigint s, max(start + length(line))::bigint e, island from i where trim(line, ' ') <> '' group by file_key, island)
select file_key, (row_number() over (partition by file_key order by island))::bigint as number, first_line, last_line, s::bigint as "start", e::bigint as "end" from p""")
def text_paragraphs(spark, sf):
    return history.paragraphs(M.files(spark, sf)).select("file_key", "number", "first_line", "last_line", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(f"select path from {PAGES} where regexp_matches(split_part(path, '/', -1), '^[^/]*4[^/]*$') group by path")
def file_glob(spark, sf):
    return search.file_search(M.pages(spark, sf), parse("file:*4*")).select("path")


@query(f"select distinct path from {PAGES} where regexp_matches(path, '^[^/]*example\\.com/en/[^/]*$')")
def file_glob_path(spark, sf):
    return search.file_search(M.pages(spark, sf), parse("file:*example.com/en/*")).select("path")


@query(f"select path from {FILES} where language = 'de'")
def lang_filter(spark, sf):
    return search.file_search(M.files(spark, sf), parse("file:* lang:de")).select("path")


@query(f"select path from {FILES} where language <> 'en' and project <> 'src3'")
def lang_negated(spark, sf):
    return search.file_search(M.files(spark, sf), parse("file:* -lang:en -project:src3")).select("path")


@query(f"select path from {FILES} where path like 'src1/%'")
def path_prefix(spark, sf):
    return search.file_search(M.files(spark, sf), parse("file:* path:src1")).select("path")


# ---- names


@query("select p_partkey, p_name from part where p_name = (select min(p_name) from part)")
def name_exact(spark, sf):
    p = M.read(spark, sf, "part")
    return p.join(F.broadcast(p.agg(F.min("p_name").alias("least"))), F.col("p_name") == F.col("least")).select("p_partkey", "p_name")


@query("select c_custkey, c_name from customer where c_name like 'Customer%1'")
def name_wildcard(spark, sf):
    return M.read(spark, sf, "customer").where(N.wildcard("Customer*1", "c_name")).select("c_custkey", "c_name")


@query("""select * from (select c_custkey, c_name, case when c_name = 'CUSTOMER' or lower(c_name) = 'customer' then 1 when starts_with(lower(c_name), 'customer') then 2 when contains(lower(c_name), 'customer') then 4 end as rank from customer) where rank is not null""")
def name_rank_loose(spark, sf):
    return M.read(spark, sf, "customer").select("c_custkey", "c_name", N.name_rank("CUSTOMER", "c_name", True).alias("rank")).where("rank is not null")


@query(f"select kind, qualified, case when qualified = 'ASIA.NATION_2' then 0 else 1 end as rank from {PLACES} where qualified = 'ASIA.NATION_2' or suffix(qualified, '.ASIA.NATION_2')")
def qualified_suffix(spark, sf):
    return search.declarations(_decls(spark, sf), parse("symbol:ASIA.NATION_2")).select("kind", "qualified", "rank")


@query("""with c as (select c_custkey, r_name as r, n_name as n, c_name as c, case when c_custkey % 2 = 0 then '<int, a::b<c>>' else '' end as t from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
select c_custkey, r || ' :: ' || n || t || '::' || c as name, greatest(1, case when n = 'nation_2' then 0 when lower(n) = 'nation_2' then 1 when starts_with(lower(n), 'nation_2') then 2 end, case when contains(lower(c), 'customer') then 2 end) as rank
 from c where starts_with(lower(n), 'nation_2') and starts_with(lower(c), 'customer')""")
def native_ranks(spark, sf):
    """Native names with template arguments and parts before the pattern's, matched loosely from the end."""
    p = M.read(spark, sf, "customer").join(M.read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(M.read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.concat("r_name", F.lit(" :: "), "n_name", F.when(F.col("c_custkey") % 2 == 0, "<int, a::b<c>>").otherwise(""), F.lit("::"), "c_name")
    return p.select("c_custkey", name.alias("name"), N.native_name_rank("nation_2::customer", name, loose=True).alias("rank")).where("rank is not null")


@query(f"select distinct kind || ':' || qualified as other from {PLACES} where name = 'NATION_2' order by 1 limit 4")
def kind_other_hint(spark, sf):
    return search.other_kinds(_decls(spark, sf), parse("class:NATION_2"))


@query(f"select kind, qualified from {PLACES} where namespace = 'ASIA' or starts_with(namespace, 'ASIA.')")
def namespace_prefix(spark, sf):
    return search.declarations(_decls(spark, sf), parse("symbol:* namespace:ASIA")).select("kind", "qualified")


@query(f"select kind, name, qualified from {PLACES} where kind in ('class') and starts_with(name, 'Customer') order by qualified, name limit 50")
def symbol_search(spark, sf):
    d = _decls(spark, sf).withColumn("path", F.col("qualified"))
    return search.ordered(search.declarations(d, parse("type:Customer* limit:50")), 50).select("kind", "name", "qualified")


def _decls(spark, sf):
    p = M.places(spark, sf)
    return p.select("*", F.col("key").alias("file_key"), F.concat_ws("/", F.lit("places"), "kind").alias("path"), F.lit("places").alias("project"), F.lit("text").alias("language"), F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("end"))


# ---- navigation


@query(f"""with p as (select strlen(content) as b, string_split(path, '/') as parts from {PAGES})
select directory, count(*)::bigint as files, sum(b)::bigint as bytes from (select b, unnest(list_transform(range(0, len(parts)), lambda k: array_to_string(parts[1:k], '/'))) as directory from p) group by directory""")
def browse_rollup(spark, sf):
    return navigation.roll_up(M.pages(spark, sf))


@query(f"select line::bigint as line, source as text from {LINES} where file_key = 1 and line between 1 and 3 and not (source = '' and line > 1 and line = (select max(line) from {LINES} where file_key = 1))")
def view_slice(spark, sf):
    f = M.files(spark, sf).where("file_key = 1")
    return navigation.view(f.withColumn("path", F.lit("p")), "p", 1, 3)


@query(f"""with t as (select distinct path, case when path = '42' then 0 when suffix(path, '/42') then 1 when lower(path) = '42' or suffix(lower(path), '/42') then 2 when contains(lower(path), '42') then 3 end as tier, case when not suffix(path, '/42') then strlen(lower(path)) - 2 else 0 end as distance from {PAGES})
select path, tier, distance::int as distance from t where tier = (select min(tier) from t)""")
def path_tiers(spark, sf):
    return navigation.tiers(M.pages(spark, sf), "42", fuzzy=True)


@query()
def path_fuzzy(spark, sf):
    return navigation.tiers(M.pages(spark, sf), "thther.exmaple.org/en/414", fuzzy=True)


@query(f"select count(distinct project)::bigint as n_projects, count(*)::bigint as n_files, array_to_string(list_sort(list(distinct language)), ',') as languages from {FILES}")
def summary_table(spark, sf):
    return navigation.summary(M.files(spark, sf))


# ---- index and relationships


@query(f"select distinct file_key, unnest(string_split(content, ' ')) as term, 'word' as space from {FILES}")
def postings_build(spark, sf):
    return joins.postings(M.files(spark, sf), F.split("content", " ", -1), "word")


@query(f"select path from {FILES} where list_contains(string_split(content, ' '), 'the')")
def postings_semi(spark, sf):
    f = M.files(spark, sf)
    return f.join(joins.candidates(joins.postings(f, F.split("content", " ", -1), "word"), "the"), "file_key", "left_semi").select("path")


@query("select l_partkey as target, l_suppkey as path, array_to_string(list_sort(list(distinct l_orderkey * 10 + l_linenumber)), ',') as places, count(distinct l_orderkey * 10 + l_linenumber)::bigint as n from lineitem group by 1, 2")
def uses_group(spark, sf):
    l = M.read(spark, sf, "lineitem")  # noqa: E741
    sites = l.select(F.col("l_suppkey").alias("path"), F.lit(0).alias("line"), F.lit("").alias("symbol"), F.col("l_partkey").alias("target"), F.lit(False).alias("possible_write"), F.lit(False).alias("uncertain"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return search.grouped(sites).select("target", "path", F.array_join("places", ",").alias("places"), F.size("places").cast("long").alias("n"))


@query("select o_orderkey, coalesce(c_name, 'unresolved:' || o_custkey) as target, c_name is null as uncertain from orders left join (select * from customer where c_custkey % 3 <> 0) on o_custkey = c_custkey")
def calls_outgoing(spark, sf):
    o = M.read(spark, sf, "orders").select(F.lit("p").alias("project"), F.col("o_orderkey").alias("file_key"), F.col("o_custkey").cast("string").alias("name"), F.lit(0).alias("at"), F.lit(True).alias("call"))
    c = M.read(spark, sf, "customer").where("c_custkey % 3 <> 0")
    decls = c.select(F.lit("p").alias("project"), F.col("c_custkey").alias("file_key"), F.col("c_custkey").cast("string").alias("name"), F.col("c_name").alias("qualified"), F.lit("method").alias("kind"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(False).alias("metadata"))
    return search.relationship(o, decls, parse("calls:*")).select(F.col("file_key").alias("o_orderkey"), "target", "uncertain")


@query("select l_orderkey, l_linenumber, case l_returnflag when 'R' then 'ref' when 'A' then 'direct' else 'none' end as write, l_returnflag = 'R' as possible_write, s_name as target from lineitem join supplier on l_suppkey = s_suppkey where l_returnflag in ('R', 'A')")
def writes_flag(spark, sf):
    w = F.when(F.col("l_returnflag") == "R", "ref").when(F.col("l_returnflag") == "A", "direct").otherwise("none")
    sites = M.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lit("p").alias("project"), F.col("l_orderkey").alias("file_key"), F.col("l_suppkey").cast("string").alias("name"), F.col("l_linenumber").alias("at"), w.alias("write"))
    decls = _named(M.read(spark, sf, "supplier"), "s_suppkey", "s_name", "field")
    return search.relationship(sites, decls, parse("writes:*")).select("l_orderkey", "l_linenumber", "write", "possible_write", "target")


def _named(rows, key, name, kind):
    """Rows as declarations of one project, spelt by their key and qualified by their name."""
    return rows.select(F.lit("p").alias("project"), F.col(key).alias("file_key"), F.col(key).cast("string").alias("name"), F.col(name).alias("qualified"), F.lit(kind).alias("kind"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(False).alias("metadata"))


@query("select o_orderkey, c_name as target from orders join customer on o_custkey = c_custkey where suffix(c_name, '7')")
def uses_sites(spark, sf):
    sites = M.read(spark, sf, "orders").select("o_orderkey", F.lit("p").alias("project"), F.col("o_orderkey").alias("file_key"), F.col("o_custkey").cast("string").alias("name"), F.lit(0).alias("at"))
    return search.relationship(sites, _named(M.read(spark, sf, "customer"), "c_custkey", "c_name", "class"), parse("uses:*7")).select("o_orderkey", "target")


@query("""with n as (select n_nationkey, n_name, n_regionkey from nation)
select o_orderkey, n.n_name as target, count(*) over (partition by o_orderkey) > 1 as uncertain from orders join customer on o_custkey = c_custkey join n h on c_nationkey = h.n_nationkey join n on n.n_regionkey in (h.n_regionkey, (h.n_regionkey + 1) % 5) and n.n_nationkey % 5 = o_orderkey % 5""")
def uses_visible(spark, sf):
    """A name that several declarations have, of which a project sees its own and those of the next one."""
    n = M.read(spark, sf, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("project"))
    home = M.read(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "project")
    sites = M.read(spark, sf, "orders").join(home, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "project", F.col("o_orderkey").alias("file_key"), (F.col("o_orderkey") % 5).cast("string").alias("name"), F.lit(0).alias("at"))
    decls = n.select("project", F.col("n_nationkey").alias("file_key"), (F.col("n_nationkey") % 5).cast("string").alias("name"), F.col("n_name").alias("qualified"), F.lit("type").alias("kind"), F.lit(0).alias("start"), F.lit(1).alias("end"))
    sees = n.select("project").distinct().select("project", F.explode(F.array("project", (F.col("project") + 1) % 5)).alias("sees"))
    return search.relationship(sites, decls, parse("uses:*"), sees).select("o_orderkey", "target", "uncertain")


@query(f"select qualified from {PLACES} where starts_with(qualified, 'EUROPE.') or starts_with(qualified, 'ASIA.NATION_2.')")
def contained_places(spark, sf):
    """Declarations within others, by their owners; each is a file of its own here, so spans hold nothing else."""
    d = _decls(spark, sf).withColumn("file_key", F.concat_ws(":", "kind", "key"))
    within = lambda name: search.declarations(d, parse(f"symbol:* in:{name}")).select("qualified")
    return within("EUROPE").where("qualified <> 'EUROPE'").unionByName(within("ASIA.NATION_2").where("qualified <> 'ASIA.NATION_2'")).distinct()


@query(f"""with recursive e as (select owner src, qualified dst from {PLACES} where owner <> ''), c(node, depth) as (select dst, 1 from e where src = 'ASIA' union all select dst, depth + 1 from c join e on node = src)
select 'ASIA' as root, node as name, depth from c""")
def derived_types(spark, sf):
    """`derived:` through the query language: places as types, owners as bases."""
    p = M.places(spark, sf)
    bases = p.where("owner <> ''").select(F.col("qualified").alias("type"), F.col("owner").alias("base"))
    decls = p.select(F.col("qualified").alias("name"), F.lit("class").alias("kind"))
    return plan(Corpus(M.files(spark, sf), declarations=decls, bases=bases), parse("impl:ASIA"))


# orders as types in seven namespaces, of which some have an inner one; a base is written in full, by its own name, or by an alias of an alias
TYPES = """(select o_orderkey k, 'p' || o_custkey % 3 as project, case when o_orderkey % 4 = 0 then 'interface' else 'class' end as kind, 'N' || o_custkey % 7 || case when o_orderkey % 5 = 0 then '.M' else '' end as owner, 'T' || o_orderkey % 500 as name,
 case when o_orderkey % 3 = 1 then 'T' || (o_orderkey // 2) % 500 else 'N' || o_orderkey % 7 || '.T' || (o_orderkey // 2) % 500 end as w, 'N' || (o_orderkey + 1) % 7 as open from orders)"""


def _types(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    o = M.read(spark, sf, "orders")
    owner = text("N", c % 7, F.when(k % 5 == 0, ".M").otherwise(""))
    base = text("T", F.expr("(o_orderkey div 2) % 500"))
    written = F.when(k % 3 == 0, text("N", k % 7, ".", base)).when(k % 3 == 1, base).otherwise("B")
    decls = o.select(text("p", c % 3).alias("project"), k.alias("file_key"), F.when(k % 4 == 0, "interface").otherwise("class").alias("kind"), text("T", k % 500).alias("name"), text(owner, ".T", k % 500).alias("qualified"), owner.alias("owner"), F.array(written).alias("bases"))
    row = lambda pos, path, alias: F.struct(F.lit(pos).alias("pos"), path.alias("path"), F.lit(alias).alias("alias"))
    imports = o.select(k.alias("file_key"), F.inline(F.array(row(0, text("N", (k + 1) % 7), ""), row(1, text("C.", base), "B"), row(2, text("N", k % 7), "C"))))
    sees = spark.range(3).select(text("p", F.col("id")).alias("project"), F.explode(F.array(text("p", F.col("id")), text("p", (F.col("id") + 1) % 3))).alias("sees"))
    return decls, imports, sees


@query(f"""with recursive t as (select *, owner || '.' || name as qualified from {TYPES}),
 c as (select k, project, owner || '.' || w as f, 0 as d from t union all select k, project, split_part(owner, '.', 1) || '.' || w, 2 from t where contains(owner, '.') union all select k, project, w, 100 from t union all select k, project, open || '.' || w, 200 from t),
 s as (select distinct project as p, qualified as q from t),
 h as (select k, d, p, q, min(d) over (partition by k) as least from c join s on f = q and p in (c.project, 'p' || (right(c.project, 1)::int + 1) % 3)),
 e as (select distinct p as tp, q as tq, t.project, t.qualified from h join t using (k) where d = least),
 r as (select p, q from s where split_part(q, '.', -1) = 'T1' union select e.project, e.qualified from r join e on tp = p and tq = q),
 n as (select project, qualified, min(kind) as kind from t group by 1, 2)
select project, qualified from n join r on p = project and q = qualified where kind = 'class' and split_part(q, '.', -1) <> 'T1'""")
def derived_scoped(spark, sf):
    """`impl:T1`: bases are resolved in their scopes, and many types share a name. A type is one row, in however many parts it is declared."""
    decls, imports, sees = _types(spark, sf)
    c = Corpus(M.files(spark, sf), declarations=decls, imports=imports, visibility=sees)
    return plan(c, parse("impl:T1")).select("project", "qualified").distinct()


SITES = """(select l_orderkey, l_linenumber, 'k::n' || case l_linenumber % 4 when 0 then l_partkey % 25 when 1 then l_orderkey % 25 when 2 then l_suppkey % 25 else 7 end || '::S' || l_suppkey % 20 as w from lineitem)"""


@query(f"""with d as (select distinct 'k::n' || s_nationkey || '::S' || s_suppkey % 20 as q from supplier)
select l_orderkey, l_linenumber, q as target, q is null as uncertain from {SITES} left join d on w = q""")
def uses_aliased(spark, sf):
    """Names as modules see them: suppliers declared in a module by nation, used by name, `super::`, an alias, and `crate::`."""
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    s = M.read(spark, sf, "supplier")
    plain = s.select(F.col("s_suppkey").alias("file_key"), text("S", F.col("s_suppkey") % 20).alias("name"), text("S", F.col("s_suppkey") % 20).alias("qualified"), F.lit("").alias("owner"), F.lit("").alias("namespace"), F.lit("struct").alias("kind"))
    decls = scopes.contextual(plain, s.select(F.col("s_suppkey").alias("file_key"), F.lit("r").alias("project"), text("k::n", F.col("s_nationkey")).alias("module")))
    l = M.read(spark, sf, "lineitem")  # noqa: E741
    n, own = F.col("l_linenumber") % 4, text("S", F.col("l_suppkey") % 20)
    written = F.when(n == 0, own).when(n == 1, text("super::n", F.col("l_orderkey") % 25, "::", own)).when(n == 2, text("A::", own)).otherwise(text("crate::n7::", own))
    file = text(F.col("l_orderkey"), "/", F.col("l_linenumber"), "/", F.col("l_suppkey"))
    sites = l.select("l_orderkey", "l_linenumber", F.lit("r").alias("project"), file.alias("file_key"), text("k::n", F.col("l_partkey") % 25).alias("module"), written.alias("written"))
    imports = l.where(n == 2).select(file.alias("file_key"), F.lit(0).alias("pos"), text("crate::n", F.col("l_suppkey") % 25).alias("path"), F.lit("A").alias("alias"))
    return scopes.bound_in_scope(sites, decls, imports).select("l_orderkey", "l_linenumber", "target", "uncertain")


@query("select s_suppkey, s_name from supplier join nation n on s_nationkey = n.n_nationkey where n.n_regionkey = 1 or n.n_regionkey = 2")
def visibility_semi(spark, sf):
    r = M.read(spark, sf, "region").select(F.col("r_regionkey").alias("project"))
    refs = spark.createDataFrame([(1, 2, []), (1, 3, ["Other"]), (2, 4, [])], "project int, target int, aliases array<string>")
    n = M.read(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("project"))
    rows = M.read(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return joins.visible(rows, joins.visibility(r, refs), 1).select("s_suppkey", "s_name")


@query("with d as (select doc_id, md5(text) as h, source <> 'src0' as metadata from documents) select doc_id from d where not metadata or h not in (select h from d where not metadata)")
def prefer_source_anti(spark, sf):
    d = M.read(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"), (F.col("source") != "src0").alias("metadata"))
    return joins.prefer_source(d, ["h"]).select("doc_id")


@query("""with o as (select o_custkey, o_orderkey as label, o_orderkey * 7 % 9000 as s, o_orderkey * 7 % 9000 + 1 + o_orderkey % 5000 as e from orders where o_orderstatus <> 'P'),
 p as (select o_custkey, o_orderkey as id, o_orderkey * 13 % 9000 as pos from orders where o_orderstatus = 'P')
select p.o_custkey as c, p.id, arg_min(label::varchar, (e - s, -s, label::varchar)) as label from p left join o on p.o_custkey = o.o_custkey and s <= pos and pos < e group by 1, 2""")
def innermost_owner(spark, sf):
    o = M.read(spark, sf, "orders").select(F.col("o_custkey").alias("c"), "o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey")
    spans = o.where("o_orderstatus <> 'P'").select("c", (k * 7 % 9000).alias("start"), (k * 7 % 9000 + 1 + k % 5000).alias("end"), k.cast("string").alias("label"))
    points = o.where("o_orderstatus = 'P'").select("c", k.alias("id"), (k * 13 % 9000).alias("at"))
    return joins.innermost(spans, points, ["c"], ["at"]).select("c", "id", "label")


@query("with u as (select md5(text) as guid, min(doc_id) as doc_id from documents group by 1 having count(distinct doc_id) = 1) select guid, doc_id from u")
def unique_guid_resolve(spark, sf):
    return joins.unique(M.read(spark, sf, "documents").select(F.md5("text").alias("guid"), "doc_id"), ["guid"], "doc_id")


# ---- graphs and assets


@query(f"""with recursive e as (select owner src, qualified dst from {PLACES} where owner <> ''),
 c(root, node, depth) as (select qualified, qualified, 0 from {PLACES} where kind = 'namespace' union all select root, dst, depth + 1 from c join e on node = src)
select root, node, depth from c""")
def hierarchy_closure(spark, sf):
    seeds = M.places(spark, sf).where("kind = 'namespace'").select(F.col("qualified").alias("root"), F.col("qualified").alias("node"))
    return G.closure(M.edges(spark, sf), seeds)


@query(f"select qualified as root, unnest([qualified, owner, split_part(owner, '.', 1)]) as node, unnest([0, 1, 2]) as depth from {PLACES} where kind = 'class'")
def ancestors(spark, sf):
    seeds = M.places(spark, sf).where("kind = 'class'").select(F.col("qualified").alias("root"), F.col("qualified").alias("node"))
    return G.ancestors(M.edges(spark, sf), seeds)


@query("select doc_id, 'quality' as property, coalesce(quality::varchar, 'unset') as value from documents left join (select doc_id, max(quality) as quality from labels group by 1) using (doc_id)")
def override_last_wins(spark, sf):
    base = M.read(spark, sf, "documents").select("doc_id", F.lit("quality").alias("property"), F.lit("unset").alias("value"))
    over = M.read(spark, sf, "labels").select("doc_id", F.lit("quality").alias("property"), F.col("quality").alias("pos"), F.col("quality").cast("string").alias("value"))
    return assets.last_override(base, over, ["doc_id"])


@query(f"select qualified as id from {PLACES} where qualified = 'ASIA.NATION_2' or owner = 'ASIA.NATION_2' or qualified = 'EUROPE' or starts_with(owner, 'EUROPE')")
def removal_cascade(spark, sf):
    p = M.places(spark, sf)
    gone = p.where(F.col("qualified").isin("ASIA.NATION_2", "EUROPE")).select(F.col("qualified").alias("id"))
    return G.removal_cascade(p.where("owner <> ''").select(F.col("qualified").alias("id"), F.col("owner").alias("parent")), gone)


@query("select l_orderkey, l_linenumber from lineitem where l_suppkey = 7")
def edges_references(spark, sf):
    e = M.read(spark, sf, "lineitem").withColumn("to", F.col("l_suppkey").cast("string")).withColumn("asset", F.col("l_partkey").cast("string"))
    return assets.incoming(e, "7").select("l_orderkey", "l_linenumber")


@query("select l_suppkey from lineitem where l_partkey = 7")
def edges_dependencies(spark, sf):
    e = M.read(spark, sf, "lineitem").withColumn("to", F.col("l_suppkey").cast("string")).withColumn("asset", F.col("l_partkey").cast("string"))
    return assets.outgoing(e, "7").select("l_suppkey")


@query("select 'unity@' || rtrim(replace(replace(to_base64(('source/' || doc_id)::blob), '+', '-'), '/', '_'), '=') || '#' || doc_id as handle from documents")
def object_handle(spark, sf):
    return M.read(spark, sf, "documents").select(assets.handle(F.concat(F.lit("source/"), F.col("doc_id").cast("string")), F.col("doc_id")).alias("handle"))


_WANTED = "(select p_partkey as k, p_name as path, md5(p_partkey::varchar) as guid, unnest([p_name, md5(p_partkey::varchar), 'unity@' || rtrim(replace(replace(to_base64(('a/' || p_partkey % 3000)::blob), '+', '-'), '/', '_'), '=') || '#' || p_partkey, 'x' || p_partkey]) as text from part)"


@query(f"""with w as (select distinct text from {_WANTED}), a as (select 'a/' || p_partkey as asset, p_name as path, md5(p_partkey::varchar) as guid from part),
 n as (select text, count(distinct asset) as n, min(asset) as asset from (select path as text, asset from a union all select guid, asset from a) group by 1),
 h as (select distinct text, 'a/' || k % 3000 as asset, k::varchar as object from {_WANTED} where starts_with(text, 'unity@'))
select text, a.asset, case when a.asset is not null then object end as object, case when a.asset is null then 'other workspace' end as problem from h left join a using (asset)
union all select text, case when n = 1 then asset end, null, case when n is null then 'not found' when n > 1 then 'ambiguous' end from w left join n using (text) where not starts_with(text, 'unity@')""")
def asset_targets(spark, sf):
    """Parts as assets, each asked for by path, guid, handle, and a name that none has."""
    p = M.read(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    a = p.select(F.concat(F.lit("a/"), key).alias("asset"), F.col("p_name").alias("path"), F.md5(key).alias("guid"))
    of = F.concat(F.lit("a/"), (F.col("p_partkey") % 3000).cast("string"))
    wanted = p.select(F.explode(F.array("p_name", F.md5(key), assets.handle(of, F.col("p_partkey")), F.concat(F.lit("x"), key))).alias("text"))
    return assets.targets(wanted, a)


# parts as packages: 400 names, with as many versions as there are parts; each asks for two others
_PACKAGES = """(select 'p' || p_partkey % 400 as name, (p_partkey // 400 + 1)::bigint as version, 'p' || unnest([(p_partkey * 7 + 3) % 400, (p_partkey * 3 + p_partkey // 400) % 400]) as dependency, unnest([p_partkey % 5 + 1, (p_partkey // 7) % 5 + 1])::bigint as least from part)"""


@query(f"""with recursive p as (select * from {_PACKAGES}), r(name, version) as (select distinct name, 1::bigint from p where name in ('p1', 'p2') union select dependency, least from r join p using (name, version)),
 b as (select name, max(version) as version from r group by 1), k as (select name, dependency from p join b using (name, version)),
 n(name) as (select distinct name from p where name in ('p1', 'p2') union select dependency from n join k using (name))
select name, version || '.0' as version, (name, version) in (select (name, version) from p) as available from b where name in (select name from n)""")
def package_closure(spark, sf):
    """What two packages need: one version a name, the greatest asked for, and nothing that only passed versions need."""
    p, k = M.read(spark, sf, "part"), F.col("p_partkey")
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    ask = lambda d, v: F.struct(text("p", d).alias("dependency"), text(v, ".0").alias("least"))
    of = F.expr("p_partkey div 400")
    rows = p.select(text("p", k % 400).alias("name"), text(of + 1, ".0").alias("version"), F.inline(F.array(ask((k * 7 + 3) % 400, k % 5 + 1), ask((k * 3 + of) % 400, F.expr("(p_partkey div 7) % 5 + 1")))))
    return packages.selected(rows, rows.where("name in ('p1', 'p2')").select("name", F.lit("1.0").alias("version")).distinct())


# suppliers placed in nations, nations in regions: a supplier's second object points at its first one and at the nation's
_PLACED = "(select s_suppkey s, n_nationkey n, n_regionkey r from supplier join nation on s_nationkey = n_nationkey)"


@query(f"""select 'S' || s as asset, '2' as path, unnest(['mine', 'home']) as field, unnest(['S' || s, 'N' || n]) as "to", unnest(['1', '7']) as object from {_PLACED}
union all select 'N' || n, 1000 + s || '/2', unnest(['mine', 'home']), 'N' || n, unnest([1000 + s || '/1', '7']) from {_PLACED}
union all select 'R' || r, 100 + n || '/' || 1000 + s || '/2', 'mine', 'R' || r, case when s % 2 = 0 then '9' else 100 + n || '/' || 1000 + s || '/1' end from {_PLACED}
union all select 'R' || r, 100 + n || '/' || 1000 + s || '/2', 'home', 'R' || r, 100 + n || '/7' from {_PLACED}
union all select 'R' || r, 100 + n || '/' || 1000 + s || '/1', 'added', 'N' || n, '7' from {_PLACED} where s % 3 = 0""")
def prefab_references(spark, sf):
    """Pointers of assets composed over three levels: re-rooted at each, and overridden from the outermost."""
    s, n = M.read(spark, sf, "supplier"), M.read(spark, sf, "nation")
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    sk, nk, rk = F.col("s_suppkey"), F.col("n_nationkey"), F.col("n_regionkey")
    at = s.join(n, F.col("s_nationkey") == nk)
    obj = lambda df, kind, key, ids: df.select(text(kind, key).alias("asset"), text("g", kind, key).alias("guid"), F.explode(F.array(*(F.lit(i).cast("long") for i in ids))).alias("id"), F.lit(1).alias("class"), F.lit(False).alias("stripped"), F.lit("o").alias("name"))
    objects = obj(s, "S", sk, (1, 2)).unionByName(obj(n, "N", nk, (7,))).unionByName(obj(n.select("n_regionkey").distinct(), "R", rk, (9,)))
    ref = lambda field, guid, target: at.select(text("S", sk).alias("asset"), F.lit(2).cast("long").alias("id"), F.lit(field).alias("field"), guid.alias("guid"), F.lit(target).cast("long").alias("target"))
    refs = ref("mine", F.lit(""), 1).unionByName(ref("home", text("gN", nk), 7))
    place = lambda df, asset, id_, guid: df.select(asset.alias("asset"), id_.cast("long").alias("id"), guid.alias("source_guid"), F.lit("").alias("parent_guid"), F.lit(0).cast("long").alias("parent_id"))
    placements = place(at, text("N", nk), sk + 1000, text("gS", sk)).unionByName(place(n, text("R", rk), nk + 100, text("gN", nk)))
    over = lambda df, id_, prop, guid, to: df.select(text("R", rk).alias("asset"), (nk + 100).cast("long").alias("placement"), (sk * 2 + id_).cast("int").alias("pos"), text("gS", sk).alias("guid"), F.lit(id_).cast("long").alias("id"), F.lit(prop).alias("property"), F.lit(None).cast("string").alias("value"), guid.alias("ref_guid"), F.lit(to).cast("long").alias("ref_id"))
    overrides = over(at.where(sk % 2 == 0), 2, "mine", F.lit(""), 9).unionByName(over(at.where(sk % 3 == 0), 1, "added", text("gN", nk), 7))
    composed = assets.compose(objects, placements, overrides, spark.createDataFrame([], "asset string, placement long, guid string, id long"))
    known = prefabs.aliases(objects, spark.createDataFrame([], "asset string, id long, placement long, guid string, target long"), placements, composed)
    return prefabs.references(objects, refs, placements, overrides, composed, known)


# ---- history and similarity


@query("select sha256('v1' || chr(0) || lang || chr(0) || source || chr(0) || sha256(text)) as id, count(*)::bigint as n, min(doc_id) as first from documents group by 1")
def content_identity(spark, sf):
    id_ = incremental.content_identity("v1", F.col("lang"), F.col("text"), F.col("source"))
    return M.read(spark, sf, "documents").groupBy(id_.alias("id")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def _words(t: str) -> str:
    return f"regexp_extract_all({t}, '" + X.TOKEN.replace("'", "''") + "', 1)"


def _grams(w: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({w}) - 1, 1)), lambda k: array_to_string({w}[k:k + 2], chr(1))))"


@query(f"""with d as (select doc_id, {_words("text")} as w, lead({_words("text")}) over (order by doc_id) as v from documents),
 g as (select doc_id, w, v, {_grams("w")} as a, {_grams("v")} as b from d where v is not null)
select doc_id, (case when w = v then 100 when len(a) = 0 or len(b) = 0 then 0 else (200 * len(list_intersect(a, b))) // (len(a) + len(b)) end)::int as similarity from g""")
def trigram_similarity(spark, sf):
    """Each document against the next one, whole texts."""
    d = M.read(spark, sf, "documents").where("text is not null").select("doc_id", X.tokens("text").alias("w"))
    # the next document stands in the same range of ids, or first in the next one that holds any
    d = d.withColumn("range", F.coalesce(F.expr("doc_id div 1024"), F.lit(-(1 << 62))))
    ranges = d.groupBy("range").agg(F.min_by("w", F.coalesce("doc_id", F.lit(-(1 << 62)))).alias("first"))
    before = ranges.select("range").withColumn("before", F.lag("range").over(Window.orderBy("range")))
    follow = before.join(ranges, "range").select(F.col("before").alias("range"), "first")
    d = d.withColumn("v", F.lead("w").over(Window.partitionBy("range").orderBy("doc_id"))).join(follow, "range", "left")
    d = d.withColumn("v", F.coalesce("v", "first")).where("v is not null")
    return d.select("doc_id", X.similarity(F.col("w"), F.col("v")).alias("similarity"))


@query()
def benchmark_similarity(spark, sf):
    """Whole texts of all documents against those of the benchmark."""
    key = lambda name, id_: M.read(spark, sf, name).select(F.col(id_).alias("key"), "text")
    return history.similar(key("documents", "doc_id"), key("benchmark", "item_id")).select(F.col("old").alias("doc_id"), F.col("new").alias("item_id"), "similarity")


@query("select item_id, count(*)::bigint as n from benchmark join documents on contains(documents.text, benchmark.text) group by 1")
def passage_occurrence(spark, sf):
    """Exact passages: words inside the passage, which are whole ones in any text that holds it, block the join; the whole is then looked for."""
    plain = lambda t: F.regexp_extract_all(F.col(t), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    b = M.read(spark, sf, "benchmark").select("item_id", F.col("text").alias("p"), plain("text").alias("w")).where("p is not null")
    b = b.withColumn("w", F.slice("w", F.lit(2), F.least(F.greatest(F.size("w") - 2, F.lit(0)), F.lit(4))))
    b = b.select("item_id", "p", F.size("w").alias("n"), F.array_join("w", " ").alias("k"))
    d = M.read(spark, sf, "documents").select("text")
    found = d.join(F.broadcast(b.where("n = 0")), F.contains("text", "p")).select("item_id")  # no word to go by
    for n in sorted(r[0] for r in b.where("n > 0").select("n").distinct().collect()):
        keys = d.select("text", F.explode(F.array_distinct(X.runs(plain("text"), n, " "))).alias("k"))
        found = found.unionByName(keys.join(b.where(F.col("n") == n), "k").where(F.contains("text", "p")).select("item_id"))
    return found.groupBy("item_id").agg(F.count("*").alias("n"))


@query(f"""with d as (select doc_id, text, {_words("text")} as w from documents), b as (select item_id, {_words("text")} as p from benchmark),
 s as (select item_id, p, len(p) as m, p[1] as first from b where len(p) > 0), k as (select doc_id, w, text, unnest(range(1, len(w) + 1)) as pos from d),
 h as (select item_id, doc_id, text, w, m, pos from k join s on w[pos] = first and w[pos:pos + m - 1] = p),
 o as (select item_id, doc_id, coalesce(list_sum(list_transform(string_split_regex(text, '{X.TOKEN.replace("'", "''")}')[1:pos], lambda x: length(x))), 0) as g, coalesce(list_sum(list_transform(w[1:pos - 1], lambda x: length(x))), 0) as t,
   list_sum(list_transform(w[pos:pos + m - 1], lambda x: length(x))) + coalesce(list_sum(list_transform(string_split_regex(text, '{X.TOKEN.replace("'", "''")}')[pos + 1:pos + m - 1], lambda x: length(x))), 0) as n from h)
select item_id as passage, doc_id as key, (row_number() over (partition by item_id, doc_id order by g + t))::bigint as number, (g + t)::bigint as start, (g + t + n)::bigint as "end" from o""")
def passage_places(spark, sf):
    """Where the texts of the benchmark stand in documents."""
    return passages.occurrences(M.read(spark, sf, "documents").select(F.col("doc_id").alias("key"), "text"), M.read(spark, sf, "benchmark").select(F.col("item_id").alias("passage"), "text"))


@query()
def mutual_best_match(spark, sf):
    d = M.read(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("text"), "source")
    return history.renames(d.where("source = 'src1'").drop("source"), d.where("source = 'src2'").drop("source"))


@query("""with o as (select conv_id || '/' || role as path, md5(string_agg(text, '|' order by turn)) as blob from conversations where turn < 3 group by 1), n as (select conv_id || '/' || role as path, md5(string_agg(text, '|' order by turn)) as blob from conversations where turn >= 2 group by 1)
select path, case when o.blob is null then 'added' when n.blob is null then 'removed' else 'modified' end as status from o full join n using (path) where o.blob is distinct from n.blob""")
def snapshot_diff(spark, sf):
    c = M.read(spark, sf, "conversations").withColumn("path", F.concat(F.col("conv_id").cast("string"), F.lit("/"), "role"))
    snap = lambda df: df.groupBy("path").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "|")).alias("blob"), F.lit(0).alias("mode"))
    return history.change_set(snap(c.where("turn < 3")), snap(c.where("turn >= 2"))).select("path", "status")


@query()
def diff_counts(spark, sf):
    c = M.read(spark, sf, "conversations")
    prev = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    words = lambda x: F.replace(x, F.lit(" "), F.lit("\n"))
    return c.withColumn("prev", prev).where("prev is not null").select("conv_id", "turn", S.diff_counts(words(F.col("prev")), words(F.col("text"))).alias("d")).select("conv_id", "turn", "d.added", "d.removed")


@query("""with c as (select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) as prev, row_number() over (partition by conv_id order by turn) as n from conversations)
select conv_id, turn, case when n = 1 then 'added' else 'modified' end as status, (row_number() over (partition by conv_id order by turn desc))::bigint as position from c where n = 1 or prev is distinct from role""")
def log_chain(spark, sf):
    return history.log(M.read(spark, sf, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "status", "position")


# a customer's orders as a repository: each follows the one before, every third merges the one three before, every seventh branches off two before
COMMITS = """(select o_custkey::varchar as repo, o_orderkey::varchar as id, n, unnest(case when n = 1 then [] when n % 3 = 0 and n > 3 then [n - 1, n - 3] when n % 7 = 0 then [n - 2] else [n - 1] end) as up from (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from orders))"""
_NUMBERED = "(select o_custkey::varchar as repo, o_orderkey::varchar as id, row_number() over (partition by o_custkey order by o_orderkey) as n from orders)"
_PARENTS = f"(select c.repo, c.id, p.id as parent from {COMMITS} c join {_NUMBERED} p on p.repo = c.repo and p.n = c.up)"
_TIPS = f"(select repo, arg_max(id, n) as root from {_NUMBERED} group by 1)"


def _history(spark, sf):
    """(parents, tips): see COMMITS; tips has each repository's last commit, and the one two before."""
    at = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    ago = lambda k: F.lag("id", k).over(at)
    o = M.read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").cast("string").alias("id"))
    o = o.withColumn("n", F.row_number().over(at)).withColumn("last", F.lead("id").over(at).isNull()).withColumn("a", ago(1)).withColumn("b", ago(2)).withColumn("c", ago(3))
    n = F.col("n")
    ups = F.when((n % 3 == 0) & (n > 3), F.array("a", "c")).when(n % 7 == 0, F.array("b")).otherwise(F.array("a"))
    return o.select("id", F.posexplode(ups).alias("pos", "parent")), o.where("last").select(F.col("o_custkey").cast("string").alias("repo"), F.col("id").alias("root"), F.col("b").alias("other"))


@query(f"""with recursive p as (select distinct id, parent from {_PARENTS}), r(root, id, far) as (select root, root, 0::bigint from {_TIPS} union select root, parent, far + 1 from r join p using (id))
select root, id, max(far) as far from r group by 1, 2""")
def commit_ancestors(spark, sf):
    """What the last commit of each repository reaches, with the longest way."""
    parents, tips = _history(spark, sf)
    return G.Commits(parents, tips).ancestors()


@query(f"""with recursive p as (select distinct id, parent from {_PARENTS}), w(root, id, way) as (select root, root, [root] from {_TIPS} union all select root, parent, list_append(way, parent) from w join p using (id)),
 done as (select root, way from w where id not in (select id from p)), n as (select root, count(*) as ways from done group by 1),
 v as (select root, id, count(*) as ways, max(k) as far from (select root, unnest(way) as id, unnest(range(len(way))) as k from done) group by 1, 2)
select root, arg_min(id, far) as id from v join n using (root, ways) where id <> root group by 1""")
def commit_cut(spark, sf):
    """Where all ways from the last commit of each repository meet first."""
    parents, tips = _history(spark, sf)
    return G.Commits(parents, tips).cut(together=False)


@query(f"""with recursive p as (select distinct id, parent from {_PARENTS}), t as (select repo, id as root from {_NUMBERED} x join (select repo, max(n) as last from {_NUMBERED} group by 1) using (repo) where n = last or n = last - 2),
 r(repo, root, id) as (select repo, root, root from t union select repo, root, parent from r join p using (id)), s as (select repo, count(*) as size from t group by 1),
 c as (select repo, id from r join s using (repo) group by repo, id, size having count(*) = size)
select repo as "group", id from c where not exists (select 1 from p join c d on d.id = p.id where p.parent = c.id and d.repo = c.repo)""")
def commit_bases(spark, sf):
    """Merge bases of the last commit of each repository and the one two before it."""
    parents, tips = _history(spark, sf)
    groups = tips.select(F.col("repo").alias("group"), F.explode(F.array_compact(F.array("root", "other"))).alias("root"))
    return G.Commits(parents, groups).bases(groups)


# each commit of COMMITS has three regions, which move every five commits and are edited every three, so that some share a text
_REGIONS = f"(select id as c, 'g' || r as region, 'd' || r || '/' || (n // 5) % 2 as path, (n + 2 * r) // 3 as blob from {_NUMBERED}, unnest([0, 1, 2]) t(r))"


def _links_sql(a: str, b: str) -> str:
    """CTEs up to l(a, b, here, there, relation, uncertain): what becomes of each region on each edge from one end to the other."""
    return f"""e as (select distinct {a} as a, {b} as b from {_PARENTS}),
 q as (select a, b, x.region as here, y.region as there, x.blob = y.blob as sb, x.path = y.path as sp, x.region = y.region as sn from e join {_REGIONS} x on x.c = a join {_REGIONS} y on y.c = b),
 u as (select *, bool_or(sb and sp and sn) over (partition by a, b, here) or bool_or(sb and sp and sn) over (partition by a, b, there) as kept from q where sb or sp or sn),
 s as (select a, b, here, there, sp, sn, case when sb then 100 else 60 end as m, case when sb then 50 + 24 else 30 end + 8 * sp::int + 18 + 12 * sn::int as v from u where not kept),
 o as (select *, row_number() over (partition by a, b, there order by v desc, here) as i, row_number() over (partition by a, b, here order by v desc, there) as j from s where v >= 45),
 f as (select a, b, there, max(case when i = 1 then here end) as h1, max(case when i = 1 then v end) as v1, max(case when i = 1 then m end) as m1, max(case when i = 2 then v end) as v2 from o group by 1, 2, 3),
 w as (select a, b, here as h1, max(case when j = 1 then there end) as t1, max(case when j = 1 then v end) as w1, max(case when j = 2 then v end) as w2 from o group by 1, 2, 3),
 k as (select o.*, case when h1 = here then case when coalesce(v2 >= 60 and v2 + 6 >= v, false) then 'uncertain' else 'none' end
   when v1 < 60 then 'none' when m1 < 70 or v1 <= v + 6 or coalesce(v2 + 6 >= v1, false) then 'uncertain'
   when coalesce(case when t1 = there then w2 else w1 end, -1000) > v1 + 6 then 'none' when coalesce(case when t1 = there then w2 else w1 end, -1000) + 6 >= v1 then 'uncertain' else 'stronger' end as rival
  from o join f using (a, b, there) left join w using (a, b, h1)),
 d as (select *, max(v) over (partition by a, b, here) as best from k where v >= 60 and rival <> 'stronger'),
 l as (select a, b, here, there, case when not sp then 'move' when not sn then 'rename' else 'continue' end as relation, count(*) over (partition by a, b, here) > 1 or rival = 'uncertain' as uncertain from d where v + 6 >= best
  union all select a, b, here, there, 'continue', false from q where sb and sp and sn)"""


def _regions(spark, sf):
    at = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = M.read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("repo"), F.col("o_orderkey").cast("string").alias("commit"), F.row_number().over(at).alias("n"))
    o = o.withColumn("r", F.explode(F.array(*map(F.lit, range(3)))))
    name = F.concat(F.lit("g"), F.col("r").cast("string"))
    path = F.concat(F.lit("d"), F.col("r").cast("string"), F.lit("/"), F.expr("cast((n div 5) % 2 as string)"))
    return o.select("repo", "n", "commit", name.alias("region"), path.alias("path"), name.alias("name"), F.lit("o").alias("owner"), F.expr("cast((n + 2 * r) div 3 as string)").alias("blob"))


def _mapped(spark, sf, forward=False):
    parents, tips = _history(spark, sf)
    e = parents.where("parent is not null")
    e = e.select(F.col("parent").alias("at"), F.col("id").alias("to")) if forward else e.select(F.col("id").alias("at"), F.col("parent").alias("to"))
    return matching.mapping(e, _regions(spark, sf).drop("repo", "n"), forward=forward)


@query(f"""with {_links_sql("id", "parent")} select a as at, b as "to", here, there, relation, uncertain from l""")
def region_links(spark, sf):
    """What each region of each commit was in its parents: unchanged, moved, renamed or edited, with rivals."""
    return _mapped(spark, sf).select("at", "to", "here", "there", "relation", "uncertain")


@query(f"""with recursive {_links_sql("id", "parent")}, r(target, c, region, far) as (select repo, root, 'g0', 0::bigint from {_TIPS} union select target, b, there, far + 1 from r join l on a = c and here = region)
select target, c as commit, region, max(far) as far from r group by 1, 2, 3""")
def trace_backward(spark, sf):
    """Where one region of each repository's last commit comes from, through all its history."""
    tips = _history(spark, sf)[1]
    return tracing.backwards(_mapped(spark, sf), tips.select(F.col("repo").alias("target"), F.col("root").alias("commit"), F.lit("g0").alias("region")))


@query(f"""with recursive {_links_sql("parent", "id")}, p as (select distinct id, parent from {_PARENTS}), i(target, c) as (select repo, root from {_TIPS} union select target, parent from i join p on id = c),
 r(target, c, region) as (select repo, id, 'g1' from {_NUMBERED} where n = 1 union select r.target, b, there from r join l on a = r.c and here = region join i on i.target = r.target and i.c = b)
select target, c as commit, region from r where (target, c) not in (select (repo, id) from {_NUMBERED} where n = 1)""")
def trace_forward(spark, sf):
    """What one region of each repository's first commit became in the commits below the last one."""
    parents, tips = _history(spark, sf)
    inside = G.Commits(parents, tips).ancestors().join(tips.select("root", "repo"), "root").select(F.col("repo").alias("target"), F.col("id").alias("commit"))
    first = _regions(spark, sf).where("n = 1 and region = 'g1'").select(F.col("repo").alias("target"), "commit", "region")
    return tracing.forwards(_mapped(spark, sf, forward=True), first, inside)


# the events of users of one remainder as two sides of a commit: paths by user, names by type, texts by amount
_SIDES = "(select (user_id % 40)::varchar as c, event_id as key, (user_id // 40)::varchar as path, event_type as name, (floor(coalesce(value, 0)) % 5)::bigint::varchar as blob, event_id % 2 as side from events)"


def _pairs_sql() -> str:
    """Groups of columns in order of what they count; in each, the n-th of what is left goes with the n-th."""
    out, left, right = [], f"(select * from {_SIDES} where side = 0)", f"(select * from {_SIDES} where side = 1)"
    for k, keys in enumerate(("path, name, blob", "path, name", "path, blob", "path", "name, blob", "name", "blob")):
        nth = f"row_number() over (partition by c, {keys} order by key) as n"
        out.append(f"h{k} as materialized (select c, a.key as o, b.key as w from (select *, {nth} from {left}) a join (select *, {nth} from {right}) b using (c, {keys}, n))")
        left, right = f"(select * from {left} where key not in (select o from h{k}))", f"(select * from {right} where key not in (select w from h{k}))"
    both = " union all ".join(f"select c, o, w from h{k}" for k in range(7))
    return f"with {', '.join(out)} select c as commit, o as old, w as new from ({both} union all select c, key, null from {left} union all select c, null, key from {right})"


@query(_pairs_sql())
def region_pairs(spark, sf):
    """Regions of two sides, one to one, best pairs first."""
    e = M.read(spark, sf, "events")
    text = lambda x: F.expr(f"cast({x} as string)")
    r = e.select(text("user_id % 40").alias("commit"), F.col("event_id").alias("key"), text("user_id div 40").alias("path"), F.col("event_type").alias("name"), text("cast(floor(coalesce(value, 0)) % 5 as bigint)").alias("blob"), (F.col("event_id") % 2).alias("side"))
    return matching.paired(r.where("side = 0").drop("side"), r.where("side = 1").drop("side"))


# ---- monitoring and caches


@query(f"select floor(start_ms / 86400000)::bigint as day, kind, repository, count(*)::bigint as count, sum(greatest(end_ms - start_ms, 0))::bigint as total_duration_ms from {RECORDS} where status = 'noop' and not detailed group by 1, 2, 3")
def journal_daily(spark, sf):
    return monitor.daily(M.records(spark, sf))


@query(f"""with r as (select *, floor(start_ms / 86400000)::bigint as day from {RECORDS}), t as (select *, day < 20120 - 365 and status = 'success' and not detailed as old from r)
select day, kind, repository, count(*)::bigint as count, sum(greatest(end_ms - start_ms, 0))::bigint as total_duration_ms, 'summary' as fact from t where old group by 1, 2, 3
union all select day, kind, repository, 1, end_ms - start_ms, 'record' from t where not old""")
def journal_compact(spark, sf):
    none = spark.createDataFrame([], "day long, kind string, repository string, count long, total_duration_ms long")
    kept, sums = monitor.compacted(M.records(spark, sf), none, 20120)
    rest = kept.select(monitor.day(F.col("start_ms")).alias("day"), "kind", "repository", F.lit(1).cast("long").alias("count"), (F.col("end_ms") - F.col("start_ms")).alias("total_duration_ms"), F.lit("record").alias("fact"))
    return sums.withColumn("fact", F.lit("summary")).unionByName(rest)


@query(f"select repository, round(pow(2.0::double, -greatest({MIDNIGHT} - max(start_ms), 0)::double / 86400000.0::double), 9) as heat from {RECORDS} group by 1")
def heat_priority(spark, sf):
    last = M.records(spark, sf).groupBy("repository").agg(F.max("start_ms").alias("at"))
    return last.select("repository", F.round(monitor.heat(F.lit(1.0), F.col("at"), F.lit(MIDNIGHT)), 9).alias("heat"))


@query()
def heat_fold(spark, sf):
    return monitor.usage(M.records(spark, sf).select(F.col("repository").alias("owner"), F.col("start_ms").alias("ms")))


_OWNERS = f"(select repository as owner, 1.0::double as heat, max(start_ms) as used, max(start_ms) as last_use, count(*)::bigint * 1000 as bytes from {RECORDS} group by 1)"


@query(f"select owner, bytes, (row_number() over (order by ({MIDNIGHT} - last_use < 900000)::int, pow(2.0::double, -greatest({MIDNIGHT} - used, 0)::double / 86400000.0::double), bytes desc, last_use, owner))::bigint as position from {_OWNERS}")
def eviction_order(spark, sf):
    return monitor.eviction(_owners(spark, sf), MIDNIGHT).select("owner", "bytes", F.col("position").cast("long").alias("position"))


@query(f"select owner, (sum(bytes) over (order by ({MIDNIGHT} - last_use < 900000)::int, pow(2.0::double, -greatest({MIDNIGHT} - used, 0)::double / 86400000.0::double), bytes desc, last_use, owner rows unbounded preceding))::bigint as freed from {_OWNERS}")
def reclaim_running(spark, sf):
    return monitor.eviction(_owners(spark, sf), MIDNIGHT).select("owner", "freed")


def _owners(spark, sf):
    return M.records(spark, sf).groupBy(F.col("repository").alias("owner")).agg(F.lit(1.0).alias("heat"), F.max("start_ms").alias("at"), F.max("start_ms").alias("last_use"), (F.count("*") * 1000).alias("bytes"))


@query("select l_suppkey as owner, round(sum(share), 6) as bytes from (select l_suppkey, l_partkey, l_partkey % 1000 / count(*) over (partition by l_partkey) as share from (select distinct l_suppkey, l_partkey from lineitem)) group by 1")
def cost_attribution(spark, sf):
    c = M.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("inode"), (F.col("l_partkey") % 1000).alias("bytes"))
    return monitor.attributed(c).select("owner", F.round("bytes", 6).alias("bytes"))


@query("select o_orderkey, round(15 - 1785 * (exp(-(o_orderkey % 100) / 28.74) - 1), 6) as seconds from orders")
def refresh_backoff(spark, sf):
    return M.read(spark, sf, "orders").select("o_orderkey", F.round(monitor.refresh_delay(F.col("o_orderkey") % 100), 6).alias("seconds"))


@query("select coalesce(a.doc_id, b.doc_id) as file_key, case when a.doc_id is null then 'added' when b.doc_id is null then 'removed' else 'changed' end as change from (select doc_id, md5(text) h from documents where doc_id % 3 <> 0) a full join (select doc_id, case when doc_id % 5 = 0 then 'x' else md5(text) end h from documents where doc_id % 3 <> 1) b using (doc_id) where a.h is distinct from b.h")
def stamps_incremental(spark, sf):
    d = M.read(spark, sf, "documents")
    old = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("file_key"), F.md5("text").alias("stamp"))
    new = d.where("doc_id % 3 <> 1").select(F.col("doc_id").alias("file_key"), F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.md5("text")).alias("stamp"))
    return incremental.stamp_changes(old, new)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of English documents that hold a literal."""
    return run(Corpus(M.files(spark, sf_dir)), f'text:"{WORD}" lang:en limit:20').select("path", "line", "column", "source")


def queries() -> dict[str, Q]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
