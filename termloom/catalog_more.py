"""Further registered queries of the core: readers and writers, commands, query trees, typed keys, algebra, pages."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom import catalog as C
from termloom.functions import normalize as N
from termloom.functions import similarity as S
from termloom.functions import text as T
from termloom.operators import analysis, crawl, html, occurrences, ranking
from termloom.operators.context_types import TYPES, ContextSchema, register_type
from termloom.operators.engine import Engine
from termloom.plans import query as Q
from termloom.plans.compiler import Compiler, QueryError
from termloom.plans.parser import parse
from termloom.runtime import read_table, shared_path
from termloom.sources import commands, documents
from termloom.sources.mapdata import read_nodes
from termloom.sources.store import GenerationStore

QUERIES: dict[str, C.Run] = {}
SQL: dict[str, str] = {}


def _register(name: str, run: C.Run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


# ---------------------------------------------------------------- readers and writers


def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON lines and read again."""
    path = shared_path(spark, "json")
    records = C.raw_records(spark, sf_dir)
    empty = F.create_map().cast("map<string,string>")
    documents.write_json(records.select("uri", F.coalesce("index", empty).alias("index"), F.coalesce("description", empty).alias("description"), "weight"), path)
    again = documents.read_json(spark, path)
    return again.select("uri", F.round("weight", 4).alias("weight"), F.explode("index").alias("context", "text")).where("text is not null")


_register("json_documents", json_documents, """select ad_uri as uri, round(case when ad_wght > 0 and ad_wght <> 1 then ad_wght::double end, 4) as weight, e.key as context, e.value as text
from (select ad_uri, ad_wght, unnest(map_entries(ad_index)) as e from api_documents where ad_uri is not null) where e.value is not null""")  # fmt: skip


def csv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "csv")
    read_table(spark, sf_dir, "customer").write.csv(path, header=True)
    made = documents.read_csv(spark, path, "c_custkey", ["c_name", "c_mktsegment"], ["c_nationkey"], "c_nationkey")
    return made.select("uri", "weight", F.col("index")["c_name"].alias("name"), F.col("index")["c_mktsegment"].alias("segment"), F.col("description")["c_nationkey"].alias("nation"))


_register("csv_documents", csv_documents, """select c_custkey::varchar as uri, c_nationkey::double as weight, c_name as name, c_mktsegment as segment, '"' || c_nationkey || '"' as nation from customer""")


def map_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map data made of the suppliers, read as records."""
    path, key = shared_path(spark, "map"), F.col("s_suppkey")
    tag = lambda k, v, held: F.when(held, F.struct(F.lit(k).alias("_k"), v.alias("_v")))
    tags = F.array_compact(F.array(tag("name", F.col("s_name"), key % 5 != 0), tag("amenity", F.lit("cafe"), key % 3 == 0), tag("shop", F.lit("yes"), key % 3 != 0), tag("closed", F.lit("1"), key % 7 == 0)))
    lat, lon = F.concat((F.pmod(key * 7, F.lit(170)) - 85).cast("string"), F.lit(".25")), F.concat((F.pmod(key * 13, F.lit(340)) - 170).cast("string"), F.lit(".5"))
    nodes = read_table(spark, sf_dir, "supplier").select(key.alias("_id"), lat.alias("_lat"), lon.alias("_lon"), tags.alias("tag"))
    nodes.write.format("xml").option("rootTag", "osm").option("rowTag", "node").save(path)
    made = read_nodes(spark, path, ["amenity"], ("closed",))
    return made.select("uri", F.col("index")["name"].alias("name"), F.col("index")["kind"].alias("kind"), F.col("index")["position"].alias("position"))


_register("map_nodes", map_nodes, """select 'osm://' || s_suppkey as uri, s_name as name, 'amenity' as kind,
printf('%.5f-%.5f', ((s_suppkey * 7) % 170 - 85 || '.25')::double, ((s_suppkey * 13) % 340 - 170 || '.5')::double) as position from supplier
where s_suppkey % 3 = 0 and s_suppkey % 5 <> 0 and s_suppkey % 7 <> 0""")  # fmt: skip


def table_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any table as records."""
    made = documents.from_table(read_table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_type"], ["p_brand"])
    return made.select("uri", F.explode("index").alias("context", "text"), F.col("description")["p_brand"].alias("brand"))


_register("table_documents", table_documents, """select p_partkey::varchar as uri, 'p_name' as context, p_name as text, '"' || p_brand || '"' as brand from part where p_name is not null
union all select p_partkey::varchar, 'p_type', p_type, '"' || p_brand || '"' from part where p_type is not null""")


def _command(cmd: str, query: str | None, uri: str | None, offset, most, weight) -> dict | list:
    number = lambda x, default: default if x is None or x != x else int(x)
    match cmd:
        case "search":
            return commands.search(query or "", number(offset, 0), number(most, -1), bool(weight))
        case "completion":
            return commands.completion(query or "", number(most, -1))
        case "select":
            return commands.select(query or "")
        case "insert":
            return commands.insert(commands.document(uri or "", {"subject": "x"}))
        case "update":
            return commands.update(commands.document(uri or ""))
        case "delete":
            return commands.delete(uri or "")
        case "delete-by-query":
            return commands.delete_by_query(query or "")
        case "status":
            return commands.status("gc")
    return commands.noop()


def command_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command log as command files: built, written one a line, read and checked again."""

    @F.pandas_udf("string")
    def build(cmd: pd.Series, query: pd.Series, uri: pd.Series, offset: pd.Series, most: pd.Series, weight: pd.Series) -> pd.Series:
        return pd.Series([commands.dumps(_command(*r)) for r in zip(cmd, query, uri, offset, most, weight)], dtype=object)

    @F.pandas_udf("string")
    def name(lines: pd.Series) -> pd.Series:
        return lines.map(lambda t: commands.loads(t)["cmd"])

    path = shared_path(spark, "commands")
    log = read_table(spark, sf_dir, "commands")
    log.select(build("cmd", "ic_query", "ic_uri", "ic_offset", "ic_max", "ic_weight")).write.text(path)
    return spark.read.text(path).select(name("value").alias("cmd"), F.col("value").contains('"weight": true').alias("weighted")).groupBy("cmd").agg(F.count("*").alias("n"), F.sum(F.col("weighted").cast("long")).alias("weighted"))


_register("command_json", command_json, "select cmd, count(*) as n, sum(case when cmd = 'search' and ic_weight then 1 else 0 end)::bigint as weighted from commands group by cmd")


def query_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of every kind of node: to JSON, back, and to JSON again."""

    @F.pandas_udf("string")
    def of(name: pd.Series, brand: pd.Series) -> pd.Series:
        def one(n: str, b: str) -> str:
            q = Q.boosted(2.5, Q.in_contexts(["a", "b"], Q.ors([Q.full_word(n), Q.word_nocase(b), Q.range_of(n, b)])))
            q = Q.Binary(Q.Op("near", 3), q, Q.Phrase(n, Q.FUZZY))
            return json.dumps(Q.to_json(Q.from_json(json.loads(json.dumps(Q.to_json(q))))))

        return pd.Series([one(*r) for r in zip(name, brand)], dtype=object)

    return read_table(spark, sf_dir, "part").select("p_partkey", of("p_name", "p_brand").alias("json"))


_register("query_json", query_json, """select p_partkey, '{"type": "near 3", "query1": {"type": "boost", "weight": 2.5, "query": {"type": "context", "contexts": ["a", "b"], "query": {"type": "seq", "op": "or", "args": [{"type": "fullword", "op": "case", "word": "'
|| p_name || '"}, {"type": "word", "op": "nocase", "word": "' || p_brand || '"}, {"type": "range", "lower": "' || p_name || '", "upper": "' || p_brand || '"}]}}}, "query2": {"type": "phrase", "op": "fuzzy", "phrase": "' || p_name || '"}}' as json from part""")  # fmt: skip


def query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed queries, whether they parse to the tree they were printed from, their words, a check and a completion."""

    @F.pandas_udf("text string, same boolean, words string, long boolean, completed string, kept string")
    def of(name: pd.Series, brand: pd.Series) -> pd.DataFrame:
        rows = []
        for n, b in zip(name, brand):
            q = Q.ands([Q.full_word_nocase(n), Q.ors([Q.word(b), Q.no_case(Q.word(b))])])
            completed = Q.complete_queries(q, [n + "ed"])[0]
            rows.append((Q.show(q), Q.normal_form(parse(Q.show(q))) == Q.normal_form(Q.ands([Q.Phrase(n), q.args[1]])), ",".join(Q.terms(q)), Q.check_with(lambda w: len(w) > 7, q), Q.terms(completed)[-1], Q.show(Q.fuzzy(Q.word(b)))))
        return pd.DataFrame(rows, columns=["text", "same", "words", "long", "completed", "kept"])

    return read_table(spark, sf_dir, "part").select("p_partkey", of("p_name", "p_brand").alias("q")).select("p_partkey", "q.*")


_register("query_text", query_text, """select p_partkey, '("' || p_name || '" AND (!' || p_brand || ' OR ' || p_brand || '))' as text, true as same, p_name || ',' || p_brand || ',' || p_brand as words,
length(p_name) > 7 and length(p_brand) > 7 as long, p_name || 'ed' as completed, '~' || p_brand as kept from part""")  # fmt: skip

# ---------------------------------------------------------------- stored indexes


def store_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generations; each can be opened, and what was opened from the older one can't be stored over the newer."""
    path = shared_path(spark, "generations")
    e = C.engine(spark, sf_dir)
    e.store(path)
    e.delete(read_table(spark, sf_dir, "commands").where("cmd = 'delete' and ic_uri is not null").select(F.col("ic_uri").alias("uri")))
    e.store(path)
    old, new = Engine(spark), Engine(spark)
    old.load(path, 1)
    new.load(path)
    try:
        old.store(path)
        code = 0
    except QueryError as err:
        code = err.code
    rows = [old.docs.agg(F.lit("1").alias("what"), F.count("*").alias("n")), new.docs.agg(F.lit("newest").alias("what"), F.count("*").alias("n"))]
    return rows[0].unionByName(rows[1]).unionByName(spark.createDataFrame([("store of the older", code)], "what string, n long"))


_register("store_generations", store_generations, """select '1' as what, count(distinct ad_uri) as n from api_documents
union all select 'newest', count(distinct ad_uri) from api_documents where ad_uri not in (select ic_uri from commands where cmd = 'delete' and ic_uri is not null)
union all select 'store of the older', 409""")


def store_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same index behind every codec."""
    e, out = C.engine(spark, sf_dir), None
    for codec in ("uncompressed", "snappy", "gzip", "zstd"):
        store = GenerationStore(spark, shared_path(spark, codec), codec)
        store.write(e.docs, e.postings, e.schemas)
        docs, posts, _, _ = store.read()
        rows = posts.join(docs, "doc_id").groupBy("context").agg(F.count("*").alias("n")).withColumn("codec", F.lit(codec))
        out = rows if out is None else out.unionByName(rows)
    return out.where(F.col("context").isin(*C._TEXT))


_register("store_codecs", store_codecs, f"""with {C._POSTINGS}, {C._FIRST}, n as (select context, count(*) as n from p where doc_id in (select record_id from f) group by context)
select context, n, codec from n, (select unnest(['uncompressed', 'snappy', 'gzip', 'zstd']) as codec)""")


def store_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of all types come back from a stored index with their keys."""
    path, e = shared_path(spark, "typed"), C.engine(spark, sf_dir)
    e.store(path)
    again = Engine(spark, config=C.UNLIMITED)
    again.load(path)
    return again.select("publish_date:[2005-02-01 TO 2009-06-30] OR legs:59").select("uri")


_register("store_typed", store_typed, f"""with dates as ({C.SQL['range_date']}), ints as ({C.SQL['word_int']}), {C._FIRST}
select ad_uri as uri from f where record_id in (select doc_id from dates union select doc_id from ints)""")


def insert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First deliveries through the checks of ``insert``, then a search that shows weights."""
    e = Engine(spark, C.schemas(spark, sf_dir), C.UNLIMITED)
    e.insert(C.first_deliveries(spark, sf_dir))
    return e.weight("harbour").select("uri", F.round("score", 6).alias("score"), F.round("weight", 6).alias("weight"), F.size("description").alias("fields"))


_register("insert_search", insert_search, f"""with {C._POSTINGS}, {C._FIRST} select ad_uri as uri, round(score * case when ad_wght > 0 then ad_wght::double else 1.0 end, 6) as score,
round(case when ad_wght > 0 then ad_wght::double else 1.0 end, 6) as weight, 0 as fields from ({C._h('harbour')}) s join f on f.record_id = s.doc_id""")  # fmt: skip


def update_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of updates in which URIs come again, without an order, is refused, and nothing is changed by it."""
    e = C.engine(spark, sf_dir)
    try:
        e.update(C.raw_records(spark, sf_dir).drop("record_id"))
        code = 0
    except QueryError as err:
        code = err.code
    return e.docs.agg(F.lit(code).alias("code"), F.count("*").alias("docs"))


_register("update_repeated", update_repeated, "select 409 as code, count(distinct ad_uri) as docs from api_documents")


def command_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as documents of a sequence of JSON commands: contexts, batched inserts, updates, deletes, a search."""
    rows = read_table(spark, sf_dir, "nation").collect()
    doc = lambda r, text: commands.document(f"n:{r['n_nationkey']}", {"name": text, "region": str(r["n_regionkey"])}, {"key": r["n_nationkey"]})
    e = Engine(spark, config=C.UNLIMITED)
    steps = [commands.noop(), commands.insert_context("name", ContextSchema()), commands.insert_context("region", ContextSchema("int", default=False))]
    steps += [commands.insert(doc(r, f"land of {r['n_name']}")) for r in rows]
    steps += [commands.update(commands.document("n:1", {"name": "again"}, {"more": [1]})), commands.delete("n:2"), commands.delete("n:3"), commands.delete("n:404"), commands.delete_by_query("region:4")]
    e.execute(commands.loads(commands.dumps(commands.sequence(steps))))
    found = e.execute(commands.search("land OR again", fields=["more"]))
    return found["result"].select("uri", F.round("score", 6).alias("score"), F.size("description").alias("fields"), F.lit(found["count"]).cast("long").alias("hits"))


_register("command_sequence", command_sequence, """with k as (select * from nation where n_nationkey not in (2, 3) and n_regionkey <> 4)
select 'n:' || n_nationkey as uri, 1.0::double as score, case when n_nationkey = 1 then 1 else 0 end as fields, (select count(*) from k) as hits from k""")


def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a server answers to commands that fail."""
    e = Engine(spark, {"c": ContextSchema()})
    e.insert([{"uri": "a:1", "index": {"c": "one two"}}])
    other = Engine(spark, {"c": ContextSchema()})
    other.insert([{"uri": "a:1", "index": {"c": "one"}}])
    cases = {
        "context of a query": commands.search("none:x"),
        "query that doesn't parse": commands.search("(a"),
        "context there": commands.insert_context("c", ContextSchema()),
        "type": {"cmd": "insert-context", "context": "d", "schema": {"type": "colour"}},
        "normalizer": {"cmd": "insert-context", "context": "d", "schema": {"type": "text", "normalizers": ["Shout"]}},
        "context of a document": commands.insert(commands.document("a:2", {"d": "x"})),
        "document there": commands.insert(commands.document("a:1", {"c": "x"})),
        "document twice": {"cmd": "insert", "document": [commands.document("a:3"), commands.document("a:3")]},
        "document not there": commands.update(commands.document("a:9", {"c": "x"})),
        "status": commands.status("weather"),
        "context of a status": {"cmd": "status", "status": ["context", "none"]},
        "command": {"cmd": "dance"},
        "no index": commands.load(shared_path(spark, "none")),
        "unknown document deleted": commands.delete("a:77"),
        "search": commands.search("one"),
    }
    rows = [(name, e.answer(c)["code"]) for name, c in cases.items()]
    try:
        e.unite(other)
        rows.append(("united with a document of both", 0))
    except QueryError as err:
        rows.append(("united with a document of both", err.code))
    return spark.createDataFrame(rows, "what string, code int")


_register("error_codes", error_codes, """select * from (values ('context of a query', 404), ('query that doesn''t parse', 400), ('context there', 409), ('type', 410), ('normalizer', 410),
('context of a document', 409), ('document there', 409), ('document twice', 409), ('document not there', 409), ('status', 400), ('context of a status', 404), ('command', 400), ('no index', 404),
('unknown document deleted', 0), ('search', 0), ('united with a document of both', 409)) t(what, code)""")  # fmt: skip


def description_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field set, one deleted, another restricted to, and a round trip through pairs."""
    docs = C.corpus(spark, sf_dir)
    more = ranking.insert_field(F.col("description"), "seen", F.lit("1"))
    pairs = ranking.description_list("description")
    return docs.select(
        "doc_id", ranking.description_size(more).cast("long").alias("n"), ranking.description_size(ranking.delete_field(more, "seen")).cast("long").alias("less"),
        ranking.description_size(ranking.restrict(more, ["seen"])).cast("long").alias("one"), ranking.lookup_text(more, "seen").alias("seen"),
        (F.size(ranking.description_of(pairs)) == F.size("description")).alias("same"),
    )


_register("description_fields", description_fields, """with f as (select record_id, len(list_filter(map_entries(ad_descr), lambda e: e.value is not null and trim(e.value) <> 'null' and e.key <> 'seen')) as n from api_documents)
select record_id as doc_id, coalesce(n, 0)::bigint + 1 as n, coalesce(n, 0)::bigint as less, 1::bigint as one, '1' as seen, true as same from f""")


def statistics_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.result_statistics_by_kind(C.compiler(spark, sf_dir, parse("har"), C.UNLIMITED).raw(parse("har")))
    return found.select("doc_hits", "word_hits", F.round("max_doc_score", 6).alias("max_doc_score"), F.round("max_word_score", 6).alias("max_word_score"))


_register("statistics_by_kind", statistics_by_kind, f"""with {C._POSTINGS}, h as ({C._hits(C.PREFIX, 'har')}), d as (select doc_id, sum(sim) as total from h group by doc_id)
select (select count(*) from d) as doc_hits, count(distinct word) as word_hits, round((select max(total) from d), 6) as max_doc_score, round(max(sim), 6) as max_word_score from h""")

# ---------------------------------------------------------------- typed keys


def date_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shape of a date, with and without a zone, as a key in UTC; offsets as text."""
    at = F.col("o_orderdate")
    texts = {
        "dateTime": F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:30")), "date": F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit("-05:00")), "gYearMonth": F.concat(F.date_format(at, "yyyy-MM"), F.lit("Z")),
        "gYear": F.date_format(at, "yyyy"), "gMonthDay": F.concat(F.lit("--"), F.date_format(at, "MM-dd")), "gMonth": F.concat(F.lit("--"), F.date_format(at, "MM")), "gDay": F.concat(F.lit("---"), F.date_format(at, "dd")),
    }
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", *[t.alias(n) for n, t in texts.items()])
    long = rows.select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(n).alias("written"), F.col(n).alias("text")) for n in texts])).alias("t")).select("o_orderkey", "t.*")
    offset = (F.col("o_orderkey") % 1681 - 840).cast("int")
    return long.select("o_orderkey", "written", N.date_shape(F.col("text")).alias("shape"), N.date_normal(F.col("text")).alias("normal"), N.show_time_zone(offset).alias("zone"))


_register("date_zones", date_zones, """with t as (select o_orderkey, o_orderdate as d, (o_orderkey % 1681 - 840)::int as z from orders),
l as (select o_orderkey, z, unnest([{'w': 'dateTime', 'n': strftime(d - interval 150 minute, '%Y%m%d%H%M%S')}, {'w': 'date', 'n': strftime(date_trunc('day', d) + interval 5 hour, '%Y%m%d%H%M%S')},
{'w': 'gYearMonth', 'n': strftime(d, '%Y%m') || '01000000'}, {'w': 'gYear', 'n': strftime(d, '%Y') || '0101000000'}, {'w': 'gMonthDay', 'n': '0001' || strftime(least(make_date(1, month(d), 1) + (day(d) - 1)::int, last_day(make_date(1, month(d), 1))), '%m%d') || '000000'},
{'w': 'gMonth', 'n': '0001' || strftime(d, '%m') || '01000000'}, {'w': 'gDay', 'n': '000101' || strftime(d, '%d') || '000000'}]) as x from t)
select o_orderkey, x.w as written, x.w as shape, x.n as normal, case when z = 0 then 'Z' else printf('%s%02d:%02d', case when z < 0 then '-' else '+' end, (abs(z) // 60)::int, (abs(z) % 60)::int) end as zone from l""")  # fmt: skip


def position_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in and out of bounds."""
    key = F.col("c_custkey").cast("int")
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", F.format_string("%d.5-%d", F.pmod(key, F.lit(220)) - 110, F.pmod(key * 7, F.lit(440)) - 220).alias("t"))
    return rows.select("c_custkey", N.is_position(F.col("t")).alias("valid"), N.position_denormal(N.position_normal(F.col("t"))).alias("shown"))


_register("position_bounds", position_bounds, """with t as (select c_custkey, ((c_custkey % 220 - 110) || '.5')::double as lat, ((c_custkey * 7) % 440 - 220)::double as lon from customer)
select c_custkey, abs(lat) < 90 and abs(lon) < 180 as valid, case when abs(lat) < 90 and abs(lon) < 180 then printf('%.7f-%.7f', lat, lon) end as shown from t""")


def word_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position as a word, in both types of positions; words that are none find nothing."""
    own = C.schemas(spark, sf_dir)
    posts = analysis.postings(C.corpus(spark, sf_dir), {"location": own["location"]})
    wanted = posts.agg(F.min("word")).first()[0] or "0-0"
    out = None
    for kind in ("position", "position-rtree"):
        typed = own | {"location": own["location"].with_(type=kind)}
        q = Q.in_contexts(["location"], Q.ors([Q.full_word(wanted), Q.full_word("nowhere")]))
        rows = Compiler(posts, typed, C.UNLIMITED).scored(q).select(F.lit(kind).alias("kind"), "doc_id", "score")
        out = rows if out is None else out.unionByName(rows)
    return out


_register("word_position", word_position, C._GEO + """, m as (select min(t) as t from v where regexp_full_match(t, '(-?[0-9]+(\\.[0-9]*)?)-(-?[0-9]+(\\.[0-9]*)?)') and t in (select t from v)),
w as (select round(regexp_extract(t, '^(-?[0-9]+(\\.[0-9]*)?)-(-?[0-9]+(\\.[0-9]*)?)$', 1)::double, 7) as lat, round(regexp_extract(t, '^(-?[0-9]+(\\.[0-9]*)?)-(-?[0-9]+(\\.[0-9]*)?)$', 3)::double, 7) as lon from m)
select distinct unnest(['position', 'position-rtree']) as kind, doc_id, 1.0::double as score from h join w using (lat, lon)""")


def word_not_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word that the context's type doesn't take finds nothing there."""
    return C._search("legs:(fiftynine OR 59)")(spark, sf_dir)


_register("word_not_valid", word_not_valid, C.SQL["word_int"])


def score_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_discount").cast("double") - 0.05
    mean = S.mean_score(F.array(F.col("l_discount").cast("double"), F.col("l_tax").cast("double")))
    row = [F.round(S.make_score(d), 6).alias("made"), F.round(S.to_default_score(S.make_score(d)), 6).alias("default"), F.round(S.from_default_score(S.to_default_score(S.make_score(d))), 6).alias("back"), F.round(mean, 6).alias("mean")]
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *row)


_register("score_scale", score_scale, """select l_orderkey, l_linenumber, l_partkey, round(greatest(l_discount - 0.05, 0.0), 6) as made, round(case when greatest(l_discount - 0.05, 0.0) = 0 then 1.0 else greatest(l_discount - 0.05, 0.0) end, 6) as default,
round(greatest(l_discount - 0.05, 0.0), 6) as back, round((l_discount + l_tax) / 2, 6) as mean from lineitem""")  # fmt: skip


def custom_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered type of codes and a registered normalizer, which the words of queries go through as well."""
    N.register_normalizer("Backwards", F.reverse)
    register_type(TYPES["text-small"].__class__("code", "[A-Z]+#[0-9]+", lambda w: w.rlike("#[0-9]+$"), False))
    parts = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.create_map(F.lit("brand"), F.concat(F.upper(F.regexp_replace("p_brand", "#", "#1")), F.lit(" x")), F.lit("name"), F.col("p_name")).alias("index"))
    own = {"brand": ContextSchema("code", normalizers=("Backwards",)), "name": ContextSchema(normalizers=("Backwards",))}
    return Compiler(analysis.postings(parts, own), own, C.UNLIMITED).unscored(Q.ors([Q.full_word("BRAND#12"), Q.full_word("ring")]))


_register("custom_type", custom_type, "select p_partkey as doc_id from part where upper(p_brand) = 'BRAND#2' or list_contains(string_split(p_name, ' '), 'ring')")

# ---------------------------------------------------------------- postings and occurrences


def boring_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = {n: s for n, s in C.schemas(spark, sf_dir).items() if n in ("subject", "content")}
    p = analysis.postings(C.corpus(spark, sf_dir), own, boring=["the", "and"])
    return p.groupBy("context").agg(F.count("*").alias("postings"), F.sum("tf").alias("occurrences"), F.count_distinct("word").alias("words"))


_register("boring_words", boring_words, f"with {C._POSTINGS} select context, count(*) as postings, sum(tf)::bigint as occurrences, count(distinct word) as words from p where context in ('subject', 'content') and word_lc not in ('the', 'and') group by context")


def mapped_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even positions only; postings without any go."""
    p = analysis.postings(C.corpus(spark, sf_dir), {"subject": C.schemas(spark, sf_dir)["subject"]})
    even = analysis.mapped(p, lambda x: F.filter(x, lambda i: i % 2 == 0))
    return even.select("word", "doc_id", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"), F.col("tf").cast("bigint").alias("tf"))


_register("mapped_postings", mapped_postings, f"""with {C._POSTINGS}, even as (select word, doc_id, list_filter(positions, lambda x: x % 2 = 0) as q from p where context = 'subject')
select word, doc_id, array_to_string(q, ' ') as positions, len(q)::bigint as tf from even where len(q) > 0""")


def occurrence_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of returned and of finished items, by order."""
    items = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("n"), "l_returnflag", "l_linestatus")
    collected = lambda d: d.groupBy("doc_id").agg(occurrences.positions(F.collect_list("n")).alias("positions"))
    a, b = collected(items.where("l_returnflag = 'A'")), collected(items.where("l_linestatus = 'F'"))
    parts = {"merge": occurrences.merge(a, b), "difference": occurrences.difference(a, b), "subtract": occurrences.subtract(a, b), "intersect": occurrences.intersect(a, b)}
    out = None
    for name, rows in parts.items():
        shown = rows.select(F.lit(name).alias("op"), "doc_id", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"), F.size("positions").cast("long").alias("n"), occurrences.has_position(F.col("positions"), 1).alias("first"))
        out = shown if out is None else out.unionByName(shown)
    return out


_register("occurrence_algebra", occurrence_algebra, """with a as (select l_orderkey as doc_id, list(distinct l_linenumber::int order by l_linenumber::int) as x from lineitem where l_returnflag = 'A' group by 1),
b as (select l_orderkey as doc_id, list(distinct l_linenumber::int order by l_linenumber::int) as y from lineitem where l_linestatus = 'F' group by 1),
r as (select 'merge' as op, doc_id, list_sort(list_distinct(coalesce(x, []) || coalesce(y, []))) as q from a full join b using (doc_id)
union all select 'difference', doc_id, x from a anti join b using (doc_id)
union all select 'subtract', doc_id, list_filter(x, lambda v: not list_contains(coalesce(y, []), v)) from a left join b using (doc_id)
union all select 'intersect', doc_id, list_filter(x, lambda v: list_contains(y, v)) from a join b using (doc_id))
select op, doc_id, array_to_string(q, ' ') as positions, len(q) as n, list_contains(q, 1) as first from r where len(q) > 0""")  # fmt: skip

_AB = "('content', 'subject')"


def _raw_phrase(combine) -> C.Run:
    """A phrase whose first part is a boolean query over positions, in two of the contexts."""
    first, second, third = Q.full_word_nocase("the"), Q.full_word_nocase("and"), Q.full_word_nocase("harbour")
    return C._search(Q.in_contexts(["content", "subject"], Q.nexts([combine([first, second]), third])))


def _raw_sql(left: str) -> str:
    return f"""with {C._POSTINGS}, h0 as ({C._hits(C.FULL, 'the', _AB)}), h1 as ({C._hits(C.FULL, 'and', _AB)}), h2 as ({C._hits(C.FULL, 'harbour', _AB)}),
l as ({left}), c as (select l.context, l.doc_id, l.sim + h2.sim as sim, list_filter(l.positions, lambda x: list_contains(h2.positions, x + 1)) as kept from l join h2 on l.context = h2.context and l.doc_id = h2.doc_id where h2.sim > 0)
select doc_id, round(max(wt * sim * len(kept)), 6) as score from c join cx using (context) where len(kept) > 0 group by doc_id"""


_register("phrase_of_and", _raw_phrase(Q.ands), _raw_sql("select h0.context, h0.doc_id, h0.sim + h1.sim as sim, list_distinct(h0.positions || h1.positions) as positions from h0 join h1 on h0.context = h1.context and h0.doc_id = h1.doc_id where h0.sim > 0 and h1.sim > 0"))
_register("phrase_of_or", _raw_phrase(Q.ors), _raw_sql("select context, doc_id, sim, positions from h0 where sim > 0 union all select context, doc_id, sim, positions from h1 where sim > 0"))
_register("phrase_of_andnot", _raw_phrase(Q.and_nots), _raw_sql("select context, doc_id, sim, positions from h0 where sim > 0 and (context, doc_id) not in (select (context, doc_id) from h1 where sim > 0)"))
_register(
    "phrase_in_context",
    C._search(Q.nexts([Q.full_word_nocase("the"), Q.in_contexts(["content"], Q.full_word_nocase("harbour"))])),
    C._positional(["the", "harbour"], C.FULL, "y = x + {k}").replace("h0.context = h1.context", "h0.context = h1.context and h0.context = 'content'"),
)

# ---------------------------------------------------------------- pages and crawl

ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /d/12\nDisallow: /d/1 # most\nDisallow:\n"


def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("pages.example", n, yes, path) for n, yes, path in crawl.parse_robots(ROBOTS, "termloom")]
    return crawl.allowed(C.html_pages(spark, sf_dir).select(F.col("url").alias("uri")), spark.createDataFrame(rules, "host string, rule_no int, allow boolean, path string")).select("uri")


_register("robots_rules", robots_rules, "select 'http://pages.example/d/' || record_id || '.html' as uri from api_documents where record_id::varchar like '12%' or record_id::varchar not like '1%'")


def page_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links below a base URI, and names of pages without a title, shortened."""
    rid = F.col("record_id").cast("string")
    base = F.when(F.col("record_id") % 2 == 0, '<base href="http://other.example/x/">').otherwise("")
    page = F.concat(F.lit("<html><head>"), base, F.lit('</head><body><a href="../y/'), rid, F.lit('.html#a">z</a><a href="//h.example/q">w</a></body></html>'))
    pages = read_table(spark, sf_dir, "api_documents").select(F.concat(F.lit("http://pages.example/some/page-"), rid, F.lit(".html?x=1")).alias("url"), page.alias("html"))
    parsed = html.parse_pages(pages)
    return parsed.select("url", F.array_join("links", " ").alias("links"), T.limit_length(html.title_or_name(), 12).alias("name"))


_register("page_bases", page_bases, """select 'http://pages.example/some/page-' || record_id || '.html?x=1' as url, case when record_id % 2 = 0 then 'http://other.example/y/' else 'http://pages.example/y/' end || record_id || '.html http://h.example/q' as links,
case when length('page-' || record_id || '.html') > 12 then substr('page-' || record_id || '.html', 1, 9) || '...' else 'page-' || record_id || '.html' end as name from api_documents""")  # fmt: skip


def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return read_table(spark, sf_dir, "part").select(
        "p_partkey", T.matches(name, r"\w+ r\w*").alias("matches"), T.substitute(name, r"\W+", "_").alias("joined"), F.size(T.split_text(name, r"\W")).cast("long").alias("words"), T.normalise_blanks(F.concat(F.lit("  "), name, F.lit("\t"))).alias("blanks"),
    )


_register("text_helpers", text_helpers, "select p_partkey, regexp_full_match(p_name, '[^ ]+ r[^ ]*') as matches, replace(p_name, ' ', '_') as joined, len(string_split(p_name, ' ')) as words, p_name as blanks from part")


def crawl_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl stopped after some documents, saved, loaded and finished reaches what one in a row reaches."""
    seeds = spark.createDataFrame([("d1",)], "uri string")
    links, path = C._record_links(spark, sf_dir), shared_path(spark, "crawl")
    crawl.save_state(crawl.crawl(seeds, links, crawl.CrawlConfig(max_level=6, max_docs=9, per_round=4)), path)
    return crawl.crawl(seeds, links, crawl.CrawlConfig(max_level=6), state=crawl.load_state(spark, path)).select("uri", "level", "done")


_register("crawl_resumed", crawl_resumed, C.SQL["crawl_levels"])


def cli_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file through the command line to JSON records."""
    from termloom.cli import main

    source, out = shared_path(spark, "cli-csv"), shared_path(spark, "cli-json")
    read_table(spark, sf_dir, "supplier").write.csv(source, header=True)
    main(["-", "from-csv", source, "--out", out, "--uri", "s_suppkey", "--index", "s_name", "--description", "s_nationkey"])
    made = documents.read_json(spark, out)
    return made.select("uri", F.col("index")["s_name"].alias("name"), F.col("description")["s_nationkey"].alias("nation"))


_register("cli_documents", cli_documents, """select s_suppkey::varchar as uri, s_name as name, '"' || s_nationkey || '"' as nation from supplier""")
