"""Registered queries of the core over the test tables, each with its SQL.

The corpus is ``api_documents`` in the contexts of the table ``contexts``; a record is a document (doc_id = record_id).
Commands that need unique URIs run over the first delivery of every URI.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom import drift_queries
from termloom.functions import normalize as N
from termloom.functions import similarity as S
from termloom.operators import analysis, crawl, html, ranking
from termloom.operators.context_types import ContextSchema, schemas_from_rows
from termloom.operators.engine import Engine
from termloom.plans import query as Q
from termloom.plans.compiler import Compiler, ProcessConfig
from termloom.plans.parser import ParseError, parse
from termloom.runtime import read_table, shared_path, spread

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {**drift_queries.QUERIES}
SQL: dict[str, str] = {**drift_queries.SQL}
UNLIMITED = ProcessConfig(doc_limit=0)


def schemas(spark: SparkSession, sf_dir: str) -> dict[str, ContextSchema]:
    return schemas_from_rows(read_table(spark, sf_dir, "contexts").collect())


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["record_id", F.col("ad_uri").alias("uri"), F.col("ad_index").alias("index"), F.col("ad_descr").alias("description"), F.col("ad_wght").alias("weight")]
    return read_table(spark, sf_dir, "api_documents").select(*columns)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.documents(spread(raw_records(spark, sf_dir)), F.col("record_id"))


def compiler(spark: SparkSession, sf_dir: str, q: Q.Query, config: ProcessConfig = ProcessConfig()) -> Compiler:
    """Over postings of the contexts that the query can touch: the default and the named ones."""
    own = schemas(spark, sf_dir)
    named = Q.mentioned_contexts(q)
    used = {n: s for n, s in own.items() if n in named or (s.default and not isinstance(q, Q.InContexts))}
    return Compiler(analysis.postings(corpus(spark, sf_dir), used), own, config)


def first_deliveries(spark: SparkSession, sf_dir: str, nth: int = 1) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("uri").orderBy("record_id")
    return raw_records(spark, sf_dir).withColumn("n", F.row_number().over(order)).where(F.col("n") == nth).drop("n", "record_id")


def engine(spark: SparkSession, sf_dir: str, config: ProcessConfig = UNLIMITED) -> Engine:
    """First deliveries, loaded without the checks of ``insert``."""
    e = Engine(spark, schemas(spark, sf_dir), config)
    docs = analysis.documents(first_deliveries(spark, sf_dir))
    e.docs, e.postings = docs.drop("index"), analysis.postings(docs, e.schemas)
    return e


# ---------------------------------------------------------------- SQL building blocks

_TEXT = ("subject", "content", "who", "name", "kind")
_POSTINGS = r"""e as (select record_id as doc_id, unnest(map_entries(ad_index)) as e from api_documents),
w0 as (select doc_id, e.key as context, regexp_extract_all(e.value, '[^\p{P}\p{Z}\p{C}]+') as l from e
       where e.key in ('subject', 'content', 'who', 'name', 'kind') and e.value is not null),
w1 as (select doc_id, context, unnest(l) as raw, generate_subscripts(l, 1) as pos from w0),
w2 as (select doc_id, context, pos, case context when 'subject' then lower(raw) when 'who' then upper(raw) else raw end as word from w1),
p as (select context, word, lower(word) as word_lc, doc_id,
        case when context in ('name', 'kind') then null else list(distinct pos order by pos) end as positions,
        case when context in ('name', 'kind') then 1 else count(distinct pos) end as tf
      from w2 group by context, word, doc_id),
cx as (select cx_name as context, cx_weight::double as wt from contexts)"""
_DEFAULTS = "('subject', 'content', 'who', 'name', 'kind')"


def _sim(word: str, column: str = "word") -> str:
    n = len(word)
    return f"case when {column} = '{word}' then 1.0::double when length({column}) = {n} then 0.75::double when length({column}) > {n} then {0.5 * n}::double / length({column}) else 0.0::double end"


def _hits(predicate: str, word: str | None, contexts: str = _DEFAULTS, limit: int = 0, key_order: bool = False, exact_case: dict[str, str] | None = None) -> str:
    """context, word, doc_id, positions, tf, sim of one lookup. The searched word goes through the context's
    normalizers first, hence the case on who and subject."""
    if word is None:
        sim = "1.0::double"
        where = predicate
    else:
        forms = {"subject": word.lower(), "who": word.upper()}
        sim = "case context " + " ".join(f"when '{c}' then {_sim(f)}" for c, f in forms.items()) + f" else {_sim(word)} end"
        where = "case context " + " ".join(f"when '{c}' then {predicate.replace('$', f)}" for c, f in forms.items()) + f" else {predicate.replace('$', word)} end"
    base = f"select context, word, doc_id, positions, tf, {sim} as sim from p where context in {contexts} and ({where})"
    if not limit:
        return base
    order = "word" if key_order else "length(word), word"
    return f"""select h.* from ({base}) h join (select context, word, sum(df) over (partition by context order by {order}
      rows between unbounded preceding and 1 preceding) as before from (select context, word, count(*) as df from ({base}) group by context, word)) k
      on h.context = k.context and h.word = k.word and coalesce(k.before, 0) < {limit}"""


def _scored(hits: str) -> str:
    return f"select doc_id, max(wt * sim * tf) as score from ({hits}) join cx using (context) group by doc_id"


def _final(scored: str) -> str:
    return f"with {_POSTINGS} select doc_id, round(score, 6) as score from ({scored})"


PREFIX, FULL = "starts_with(word_lc, lower('$'))", "word_lc = lower('$')"
PREFIX_CASE, FULL_CASE = "starts_with(word, '$')", "word = '$'"


def _both(parts: list[str]) -> str:
    union = " union all ".join(parts)
    return f"select doc_id, sum(score) as score from ({union}) group by doc_id having count(*) = {len(parts)}"


def _either(parts: list[str]) -> str:
    union = " union all ".join(parts)
    return f"select doc_id, max(score) as score from ({union}) group by doc_id"


# ---------------------------------------------------------------- scored searches


def _search(text: str | Q.Query, config: ProcessConfig = UNLIMITED) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = parse(text) if isinstance(text, str) else text
        return compiler(spark, sf_dir, q, config).scored(q).select("doc_id", F.round("score", 6).alias("score"))

    return run


def _unscored(text: str) -> Run:
    return lambda spark, sf_dir: compiler(spark, sf_dir, parse(text), UNLIMITED).unscored(parse(text))


def _ids(parts: str) -> str:
    return f"with {_POSTINGS} {parts}"


def _register(name: str, run: Run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


_h = lambda word, predicate=PREFIX, contexts=_DEFAULTS, **k: _scored(_hits(predicate, word, contexts, **k))

_register("word_case", _search(Q.FullWord("Harbour", Q.CASE)), _final(_h("Harbour", FULL_CASE)))
_register("word_nocase", _search('"harbour"'), _final(_h("harbour", FULL)))
_register("prefix_case", _search("!Har"), _final(_h("Har", PREFIX_CASE)))
_register("prefix_nocase", _search("har"), _final(_h("har")))
_register("fuzzy_as_nocase", _search("~harbour"), _final(_h("harbour")))
_register(
    "fuzzy_expanded",
    _search(Q.FullWord("leter", Q.FUZZY), ProcessConfig(doc_limit=0, expand_fuzzy=True)),
    # the cheap respellings of the word
    _final(_h("leter", "word_lc in (lower('$'), 'letter', 'leterr', 'leteer', 'lletter', 'leeter', 'lleter', 'letterr', 'letre', 'lleterr', 'lleteer', 'leterrr', 'lettterr', 'leteerr', 'lettter', 'letteer')")),
)
_register("range_text", _search("content:[hammer TO harbour]"), _final(_h(None, "word between 'hammer' and 'harbour'", "('content')")))
_register("doclimit_500", _search("the", ProcessConfig(doc_limit=500)), _final(_h("the", limit=500)))
_register("range_doclimit", _search("content:[a TO c]", ProcessConfig(doc_limit=500)), _final(_h(None, "word between 'a' and 'c'", "('content')", limit=500, key_order=True)))
_register("and_sum", _search("harbour kitchen"), _final(_both([_h("harbour"), _h("kitchen")])))
_register("or_max", _search("harbour OR kitchen OR gard"), _final(_either([_h("harbour"), _h("kitchen"), _h("gard")])))
_register("andnot", _search("harbour AND NOT kitchen AND NOT garden"), _final(f"select * from ({_h('harbour')}) where doc_id not in (select doc_id from ({_h('kitchen')})) and doc_id not in (select doc_id from ({_h('garden')}))"))
_register("seq_nary", _search("(harbour OR kitchen) AND (the OR garden) AND w"), _final(_both([_either([_h("harbour"), _h("kitchen")]), _either([_h("the"), _h("garden")]), _h("w")])))
_register("unscored_and", _unscored("harbour AND kitchen"), _ids(f"select doc_id from ({_both([_h('harbour'), _h('kitchen')])})"))
_register("unscored_or", _unscored("harbour OR kitchen"), _ids(f"select doc_id from ({_either([_h('harbour'), _h('kitchen')])})"))
_register("unscored_andnot", _unscored("harbour AND NOT kitchen"), _ids(f"select distinct doc_id from ({_h('harbour')}) where doc_id not in (select doc_id from ({_h('kitchen')}))"))
_register("boost", _search("harbour^2.5 OR kitchen"), _final(_either([f"select doc_id, 2.5::double * score as score from ({_h('harbour')})", _h("kitchen")])))
_register("context_restrict", _search("subject,who:(har OR tu)"), _final(_either([_h("har", PREFIX, "('subject', 'who')"), _h("tu", PREFIX, "('subject', 'who')")])))
_register("default_contexts", _search("t"), _final(_h("t")))
_register("optimized_prefixes", _search(Q.subsume_prefixes(Q.Binary(Q.Op(Q.AND), Q.Word("har"), Q.Word("harb")))), _final(_h("harb")))

# ---------------------------------------------------------------- positional operators


def _positional(words: list[str], predicate: str, condition: str, boost: float | None = None) -> str:
    """Combinations of words in one context and document; ``condition`` between first positions x and k-th positions y."""
    names = [f"h{k}" for k in range(len(words))]
    ctes = ", ".join(f"{n} as ({_hits(predicate, w)})" for n, w in zip(names, words))
    keep = "h0.positions"
    for k, n in enumerate(names[1:], 1):
        keep = f"list_filter({keep}, lambda x: len(list_filter({n}.positions, lambda y: {condition.format(k=k)})) > 0)"
    sims = [f"{n}.sim" for n in names]
    if boost is not None:
        sims[0] = f"greatest(h0.sim, {boost}::double)"
    joins = "h0 " + " ".join(f"join {n} on h0.context = {n}.context and h0.doc_id = {n}.doc_id" for n in names[1:])
    sims_ok = " and ".join(f"{n}.sim > 0" for n in names)
    return f"""with {_POSTINGS}, {ctes},
c as (select h0.context, h0.doc_id, {' + '.join(sims)} as sim, {keep} as kept, h0.positions is null as bare from {joins} where {sims_ok})
select doc_id, round(max(wt * sim * case when bare then 1 else len(kept) end), 6) as score from c join cx using (context)
where bare or len(kept) > 0 group by doc_id"""


_register("phrase2", _search('"the harbour"'), _positional(["the", "harbour"], FULL, "y = x + {k}"))
_register("phrase3", _search('"and then collected"'), _positional(["and", "then", "collected"], FULL, "y = x + {k}"))
_register("prefix_phrase", _search("the ++ har"), _positional(["the", "har"], PREFIX, "y = x + {k}"))
_register("follow", _search("every FOLLOW 4 col"), _positional(["every", "col"], PREFIX, "y - x between 1 and {k} * 4"))
_register("near", _search("harbour NEAR 3 the"), _positional(["harbour", "the"], PREFIX, "y - x between -3 * {k} and 3 * {k}"))
_register("boost_in_phrase", _search(Q.nexts([Q.Boost(3.0, Q.FullWord("the")), Q.FullWord("harbour")])), _positional(["the", "harbour"], FULL, "y = x + {k}", boost=3.0))
_register("phrase_no_positions", _search("kind,name:(ra ++ rab)"), f"""with {_POSTINGS}, a as ({_hits(PREFIX, 'ra', "('kind', 'name')")}), b as ({_hits(PREFIX, 'rab', "('kind', 'name')")})
select a.doc_id, round(max(wt * (a.sim + b.sim)), 6) as score from a join b on a.context = b.context and a.doc_id = b.doc_id join cx on cx.context = a.context group by a.doc_id""")  # fmt: skip

# ---------------------------------------------------------------- typed contexts

_INT = r"""with v as (select record_id as doc_id, unnest(regexp_extract_all(ad_index['legs'], '[-]?[0-9]*')) as t from api_documents),
i as (select doc_id, try_cast(t as bigint) as k from v where regexp_full_match(t, '[-]?[0-9]+') and try_cast(t as bigint) is not null)"""
_DATE_RE = "(19|20)?[0-9]{2}-((0[1-9])|(1[0-2]))-((0[1-9])|([12][0-9])|(3[01]))"
_DATES = r"""with v as (select record_id as doc_id, unnest(regexp_extract_all(ad_index['publish_date'], '[0-9]{4}-((0[1-9])|(1[0-2]))-((0[1-9])|([12][0-9])|(3[01]))')) as t from api_documents),
d as (select doc_id, least(make_date(left(t, 4)::int, substr(t, 6, 2)::int, 1) + (substr(t, 9, 2)::int - 1), last_day(make_date(left(t, 4)::int, substr(t, 6, 2)::int, 1))) as k from v where left(t, 4)::int > 0)"""
_GEO = r"""with v as (select record_id as doc_id, unnest(regexp_extract_all(ad_index['location'], '-?(90(\.0*)?|[1-8]?[0-9](\.[0-9]*)?)--?((180(\.0*)?)|(1[0-7][0-9])|([1-9]?[0-9]))(\.[0-9]*)?')) as t from api_documents),
g as (select doc_id, round(regexp_extract(t, '^(-?[0-9]+(\.[0-9]*)?)-(-?[0-9]+(\.[0-9]*)?)$', 1)::double, 7) as lat,
      round(regexp_extract(t, '^(-?[0-9]+(\.[0-9]*)?)-(-?[0-9]+(\.[0-9]*)?)$', 3)::double, 7) as lon from v
      where regexp_full_match(t, '(-?[0-9]+(\.[0-9]*)?)-(-?[0-9]+(\.[0-9]*)?)')),
h as (select * from g where abs(lat) < 90 and abs(lon) < 180)"""

_register("range_int", _search("legs:[-10 TO 400]"), _INT + " select doc_id, round(max(exp(-pow(k - 195.0, 2) / (2 * pow(19.5, 2)))), 6) as score from i where k between -10 and 400 group by doc_id")
_register("word_int", _search("legs:59"), _INT + " select doc_id, 1.0::double as score from i where k = 59 group by doc_id")
_register("range_date", _search("publish_date:[2005-02-01 TO 2009-06-30]"), _DATES + " select distinct doc_id, 1.0::double as score from d where k between date '2005-02-01' and date '2009-06-30'")
_register("range_position", _search("location:[-40.5--100 TO 60-120.25]"), _GEO + " select distinct doc_id, 1.0::double as score from h where lat between -40.5 and 60 and lon between -100 and 120.25")


def range_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = schemas(spark, sf_dir)
    own["location"] = own["location"].with_(type="position-rtree")
    found = Compiler(analysis.postings(corpus(spark, sf_dir), own), own, UNLIMITED).scored(parse("location:[60-120.25 TO -40.5--100]"))
    return found.select("doc_id", F.round("score", 6).alias("score"))


_register("range_rtree", range_rtree, SQL["range_position"])


def int_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return read_table(spark, sf_dir, "part").select(
        "p_partkey", F.round(S.similar_int(20, size), 6).alias("around"), F.round(S.similar_range_int(10, 40, size), 6).alias("within")
    )


_register("int_similarity", int_similarity, "select p_partkey, round(exp(-pow(p_size - 20.0, 2) / 8.0), 6) as around, round(exp(-pow(p_size - 25.0, 2) / 12.5), 6) as within from part")


def norm_zerofill(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("c_acctbal").cast("bigint").cast("string")
    return read_table(spark, sf_dir, "customer").select("c_custkey", N.zero_fill(value).alias("filled"), N.zero_fill_value(N.zero_fill(value)).alias("value"))


_register("norm_zerofill", norm_zerofill, """select c_custkey, case when v < 0 then '0' else '1' end || lpad(abs(v)::varchar, 20, '0') as filled, v::varchar as value
from (select c_custkey, trunc(c_acctbal)::bigint as v from customer)""")  # fmt: skip


def norm_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("ad_index")["publish_date"]
    rows = read_table(spark, sf_dir, "api_documents").where(text.isNotNull()).select("record_id", text.alias("t"))
    key = N.date_normal(F.col("t"))
    return rows.select("record_id", N.date_shape(F.col("t")).alias("shape"), key.alias("normal"), N.date_denormal(key).alias("shown"))


_D = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"
_register("norm_date", norm_date, rf"""with v as (select record_id, ad_index['publish_date'] as t from api_documents where ad_index['publish_date'] is not null),
d as (select record_id, t, case when regexp_matches(t, '{_D}') then
  least(make_date(left(t, 4)::int, substr(t, 6, 2)::int, 1) + (substr(t, 9, 2)::int - 1), last_day(make_date(left(t, 4)::int, substr(t, 6, 2)::int, 1))) end as k from v)
select record_id, case when k is not null then 'date' when regexp_matches(t, '^[0-9]{{4}}-(0[1-9]|1[0-2])$') then 'gYearMonth' when regexp_matches(t, '^[0-9]{{4}}$') then 'gYear' end as shape,
coalesce(strftime(k, '%Y%m%d'), case when regexp_matches(t, '^[0-9]{{4}}-(0[1-9]|1[0-2])$') then replace(t, '-', '') || '01' when regexp_matches(t, '^[0-9]{{4}}$') then t || '0101' end) || '000000' as normal,
coalesce(strftime(k, '%Y-%m-%d'), case when regexp_matches(t, '^[0-9]{{4}}-(0[1-9]|1[0-2])$') then t || '-01' when regexp_matches(t, '^[0-9]{{4}}$') then t || '-01-01' end) || ' 00:00:00' as shown from d""")  # fmt: skip


def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    parts = [N.show_date_part(F.col("o_orderdate"), shape).alias(shape) for shape in N.DATE_PRINTERS]
    return orders.select("o_orderkey", *parts)


_register("date_parts", date_parts, """select o_orderkey, strftime(o_orderdate, '%Y-%m') as gYearMonth, strftime(o_orderdate, '%Y') as gYear, strftime(o_orderdate, '--%m-%d') as gMonthDay,
strftime(o_orderdate, '--%m') as gMonth, strftime(o_orderdate, '---%d') as gDay, strftime(o_orderdate, '%Y-%m-%d') as date, strftime(o_orderdate, '%H:%M:%S') as time,
strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as dateTime from orders""")  # fmt: skip


def norm_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = F.pmod(F.col("c_custkey") * 37, F.lit(17900)) / 100 - 89.5, F.pmod(F.col("c_custkey") * 91, F.lit(35900)) / 100 - 179.5
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", F.format_string("%.2f-%.2f", lat, lon).alias("t"))
    return rows.select("c_custkey", N.is_position(F.col("t")).alias("valid"), N.position_denormal(N.position_normal(F.col("t"))).alias("shown"))


_register("norm_position", norm_position, """select c_custkey, true as valid,
printf('%.7f-%.7f', ((c_custkey * 37) % 17900) / 100.0::double - 89.5, ((c_custkey * 91) % 35900) / 100.0::double - 179.5) as shown from customer""")  # fmt: skip

# ---------------------------------------------------------------- analysis and index tables


def postings_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = {n: s for n, s in schemas(spark, sf_dir).items() if n in _TEXT}
    p = analysis.postings(corpus(spark, sf_dir), own)
    return p.select("context", "word", "doc_id", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"), F.col("tf").cast("bigint").alias("tf"))


_register("postings_text", postings_text, f"with {_POSTINGS} select context, word, doc_id, array_to_string(positions, ' ') as positions, tf from p")
_register("tokens_text", lambda s, d: analysis.tokens(corpus(s, d), {n: x for n, x in schemas(s, d).items() if n in _TEXT}).select("context", "doc_id", "pos", "word"), f"with {_POSTINGS} select context, doc_id, pos, word from w2")
_register("vocab_df", lambda s, d: analysis.vocabulary(analysis.postings(corpus(s, d), {n: x for n, x in schemas(s, d).items() if n in _TEXT})), f"with {_POSTINGS} select context, word, word_lc, count(*) as df from p group by all")

# ---------------------------------------------------------------- ranking, paging, projection

_RANKED = f"""with {_POSTINGS}, r as (select record_id as doc_id, ad_uri as uri, score * case when ad_wght > 0 then ad_wght::double else 1.0 end as score
from ({_h('harbour')}) s join api_documents on record_id = s.doc_id)"""


def _page(offset: int, most: int) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = compiler(spark, sf_dir, parse("harbour"), UNLIMITED).scored(parse("harbour"))
        return ranking.page(ranking.weighted(found, corpus(spark, sf_dir)), offset, most).select("doc_id", "uri", F.round("score", 6).alias("score"))

    return run


_register("page_topk", _page(0, 10), _RANKED + " select doc_id, uri, round(score, 6) as score from r order by r.score desc, uri, doc_id limit 10")
_register("page_offset", _page(20, 15), _RANKED + " select doc_id, uri, round(score, 6) as score from r order by r.score desc, uri, doc_id limit 15 offset 20")
_register("doc_weight_rank", _page(0, -1), _RANKED + " select doc_id, uri, round(score, 6) as score from r")
_register("hit_count", lambda s, d: compiler(s, d, parse("harbour"), UNLIMITED).scored(parse("harbour")).agg(F.count("*").alias("n")), _RANKED + " select count(*) as n from r")


def result_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.result_statistics(compiler(spark, sf_dir, parse("har"), UNLIMITED).raw(parse("har")))


_register("result_statistics", result_statistics, f"with {_POSTINGS} select count(distinct doc_id) as doc_hits, count(distinct word) as word_hits, max(sim) as max_score from ({_hits(PREFIX, 'har')})")


def select_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.with_documents(compiler(spark, sf_dir, parse("kitchen"), UNLIMITED).scored(parse("kitchen")), corpus(spark, sf_dir))
    shown = ranking.projected(found, ["kind", "year", "Year"])
    return shown.select("doc_id", "weight", F.explode("description").alias("field", "value"))


_register("select_fields", select_fields, f"""with {_POSTINGS}, f as (select record_id as doc_id, unnest(map_entries(ad_descr)) as d from api_documents where record_id in (select doc_id from ({_h('kitchen')})))
select doc_id, 1.0::double as weight, d.key as field, d.value as value from f where d.key in ('kind', 'year', 'Year') and d.value is not null and trim(d.value) <> 'null'""")  # fmt: skip

# ---------------------------------------------------------------- completion


def _complete(q: str | Q.Query) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tree = parse(q) if isinstance(q, str) else q
        words = compiler(spark, sf_dir, tree, UNLIMITED).completions(tree)
        return ranking.top_words(words.withColumn("score", F.round("score", 6)), 20)

    return run


def _completed(hits: str) -> str:
    return f"""select word, round(max(wt * s), 6) as score from (select context, word, greatest(1.0, max(sim * tf)) as s from ({hits}) where sim > 0 group by context, word)
join cx using (context) group by word order by score desc, word limit 20"""


_register("complete_prefix", _complete("har"), f"with {_POSTINGS} " + _completed(_hits(PREFIX, "har")))
_register("complete_and", _complete("kitchen AND har"), f"with {_POSTINGS} " + _completed(f"select * from ({_hits(PREFIX, 'har')}) where doc_id in (select doc_id from ({_h('kitchen')}))"))
_register("complete_or", _complete("kitchen OR gar"), f"with {_POSTINGS} " + _completed(_hits(PREFIX, "gar")))
_register("complete_phrase", _complete(Q.Phrase("the har")), f"""with {_POSTINGS}, a as ({_hits(FULL, 'the')}), b as ({_hits(PREFIX, 'har')}),
c as (select a.context, a.word as w1, b.word as word, a.sim + b.sim as s, len(list_filter(a.positions, lambda x: list_contains(b.positions, x + 1))) as n,
  a.positions is null as bare from a join b on a.context = b.context and a.doc_id = b.doc_id where a.sim > 0 and b.sim > 0),
g as (select context, w1, word, greatest(1.0, max(s * case when bare then 1 else n end)) as s from c where bare or n > 0 group by all),
k as (select context, word, sum(s) as s from g group by all)
select word, round(max(wt * s), 6) as score from k join cx using (context) group by word order by score desc, word limit 20""")  # fmt: skip

# ---------------------------------------------------------------- commands

_FIRST = "f as (select * from api_documents qualify row_number() over (partition by ad_uri order by record_id) = 1)"


def select_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).select("harbour AND kitchen").select("uri")


_register("select_docs", select_docs, f"with {_POSTINGS}, {_FIRST} select ad_uri as uri from f where record_id in (select doc_id from ({_both([_h('harbour'), _h('kitchen')])}))")


def delete_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.delete(read_table(spark, sf_dir, "commands").where("cmd = 'delete' and ic_uri is not null").select(F.col("ic_uri").alias("uri")))
    return e.docs.select("uri")


_register("delete_docs", delete_docs, f"with {_FIRST} select ad_uri as uri from f where ad_uri not in (select ic_uri from commands where cmd = 'delete' and ic_uri is not null)")


def delete_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.delete_by_query("subject:the OR content:harbour")
    return e.docs.select("uri")


_SUBJECT, _CONTENT = "('subject')", "('content')"
_register("delete_by_query", delete_by_query, f"with {_POSTINGS}, {_FIRST} select ad_uri as uri from f where record_id not in (select doc_id from ({_either([_h('the', PREFIX, _SUBJECT), _h('harbour', PREFIX, _CONTENT)])}))")


def update_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.update(first_deliveries(spark, sf_dir, 2))
    return e.docs.select("uri", F.round("weight", 6).alias("weight"), F.explode_outer("description").alias("field", "value"))


_register("update_merge", update_merge, """with n as (select *, row_number() over (partition by ad_uri order by record_id) as n from api_documents),
a as (select ad_uri as uri, map_entries(ad_descr) as d, ad_wght from n where n = 1), b as (select ad_uri as uri, map_entries(ad_descr) as d, ad_wght from n where n = 2),
o as (select uri, unnest(d) as x from a), w as (select uri, unnest(d) as x from b),
m as (select uri, x.key as field, x.value as value from o where (uri, x.key) not in (select (uri, x.key) from w) union all select uri, x.key, x.value from w),
k as (select * from m where value is not null and trim(value) <> 'null'),
t as (select a.uri, round(case when b.ad_wght > 0 then b.ad_wght::double when a.ad_wght > 0 then a.ad_wght::double else 1.0 end, 6) as weight from a left join b on a.uri = b.uri)
select t.uri, weight, field, value from t left join k on t.uri = k.uri""")  # fmt: skip


def update_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old words stay after an update: documents of the harbour, found by either delivery."""
    e = engine(spark, sf_dir)
    e.update(first_deliveries(spark, sf_dir, 2))
    return e.select('subject:"harbour"').select("uri")


_register("update_postings", update_postings, f"""with {_POSTINGS}, n as (select *, row_number() over (partition by ad_uri order by record_id) as n from api_documents)
select distinct ad_uri as uri from n where n <= 2 and record_id in (select doc_id from ({_h('harbour', FULL, _SUBJECT)}))""")  # fmt: skip


def later_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All deliveries of a URI but its first, with their record_id."""
    from pyspark.sql import Window

    order = Window.partitionBy("uri").orderBy("record_id")
    return raw_records(spark, sf_dir).withColumn("n", F.row_number().over(order)).where("n > 1").drop("n")


def update_merge_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivery applied; ``update_merge`` applies the second alone, as its SQL says."""
    e = engine(spark, sf_dir)
    e.update(later_deliveries(spark, sf_dir), "record_id")
    return e.docs.select("uri", F.round("weight", 6).alias("weight"), F.explode_outer("description").alias("field", "value"))


_register("update_merge_all", update_merge_all, """with d as (select ad_uri as uri, record_id, unnest(map_entries(ad_descr)) as x from api_documents),
m as (select uri, x.key as field, x.value as value from d qualify row_number() over (partition by uri, x.key order by record_id desc) = 1),
k as (select * from m where value is not null and trim(value) <> 'null'),
t as (select ad_uri as uri, round(coalesce(arg_max(ad_wght, record_id) filter (where ad_wght > 0)::double, 1.0), 6) as weight from api_documents group by ad_uri)
select t.uri, weight, field, value from t left join k on t.uri = k.uri""")  # fmt: skip


def update_postings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the harbour, found by any delivery."""
    e = engine(spark, sf_dir)
    e.update(later_deliveries(spark, sf_dir), "record_id")
    return e.select('subject:"harbour"').select("uri")


_register("update_postings_all", update_postings_all, f"""with {_POSTINGS}
select distinct ad_uri as uri from api_documents where record_id in (select doc_id from ({_h('harbour', FULL, _SUBJECT)}))""")  # fmt: skip


def insert_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine.duplicate_uris(raw_records(spark, sf_dir))


_register("insert_conflicts", insert_conflicts, "select ad_uri as uri, count(*) as n from api_documents group by ad_uri having count(*) > 1")


def store_load_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, path = engine(spark, sf_dir), shared_path(spark, "index")
    e.store(path)
    again = Engine(spark, config=UNLIMITED)
    again.load(path)
    return again.results("harbour").select("uri", F.round("score", 6).alias("score"))


_FIRST_RANKED = f"""with {_POSTINGS}, {_FIRST} select ad_uri as uri, round(score * case when ad_wght > 0 then ad_wght::double else 1.0 end, 6) as score
from ({_h('harbour')}) s join f on f.record_id = s.doc_id"""
_register("store_load_roundtrip", store_load_roundtrip, _FIRST_RANKED)


def context_add_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.delete_context("content")
    e.insert_context("extra", ContextSchema())
    return e.results("harbour").select("uri", F.round("score", 6).alias("score"))


_REST = "('subject', 'who', 'name', 'kind')"
_register("context_add_drop", context_add_drop, f"""with {_POSTINGS}, {_FIRST} select ad_uri as uri, round(score * case when ad_wght > 0 then ad_wght::double else 1.0 end, 6) as score
from ({_h('harbour', PREFIX, _REST)}) s join f on f.record_id = s.doc_id""")  # fmt: skip


def index_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two indexes over the two halves of every record's contexts, united, are the index of all."""
    from termloom.operators.engine import merge_postings

    own = {n: s for n, s in schemas(spark, sf_dir).items() if n in _TEXT}
    docs = corpus(spark, sf_dir)
    left, right = (analysis.postings(docs.where(F.col("doc_id") % 2 == k), own) for k in (0, 1))
    return merge_postings(left, right).select("context", "word", "doc_id", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"), F.col("tf").cast("bigint").alias("tf"))


_register("index_union", index_union, SQL["postings_text"])
_register("status_doctable", lambda s, d: engine(s, d).status("doctable").select("uri", F.round("weight", 6).alias("weight")), f"with {_FIRST} select ad_uri as uri, round(case when ad_wght > 0 then ad_wght::double else 1.0 end, 6) as weight from f")
_register("status_context", lambda s, d: engine(s, d).status("context", "who").select("word", "df"), f"with {_POSTINGS}, {_FIRST} select word, count(*) as df from p where context = 'who' and doc_id in (select record_id from f) group by word")


def command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the queries of the log ask for: every distinct query text parsed once, by an Arrow-batched call."""

    @F.pandas_udf("string")
    def kind(texts: pd.Series) -> pd.Series:
        def of(t: str) -> str:
            try:
                q = parse(t)
            except ParseError:
                return "error"
            return str(q.op) if isinstance(q, (Q.Seq, Q.Binary)) else type(q).__name__.lower()

        return texts.map(of)

    asked = read_table(spark, sf_dir, "commands").where("cmd = 'search' and ic_query is not null").groupBy("ic_query").agg(F.count("*").alias("n"))
    return asked.withColumn("kind", kind("ic_query")).groupBy("kind").agg(F.sum("n").alias("commands"), F.count("*").alias("queries"))


_register("command_log", command_log)
_register(
    "parsed_query_end_to_end",
    _search('(content:"and then collected"^2 OR harbour) AND NOT subject:garden'),
    None,
)
SQL["parsed_query_end_to_end"] = f"""with {_POSTINGS}, ph as (select doc_id, 2 * score as score from ({_positional(["and", "then", "collected"], FULL, "y = x + {k}")})), hb as ({_h('harbour')})
select doc_id, round(max(score), 6) as score from (select * from ph union all select * from hb) where doc_id not in (select doc_id from ({_h('garden', PREFIX, _SUBJECT)})) group by doc_id"""

# ---------------------------------------------------------------- pages and crawl


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made of the records: the subject as title and headline, the content as body, links to two other records."""
    docs = read_table(spark, sf_dir, "api_documents")
    escaped = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    subject, content = escaped(F.col("ad_index")["subject"]), escaped(F.col("ad_index")["content"])
    rid = F.col("record_id").cast("bigint")
    link = lambda n: F.concat(F.lit('<a href="'), n.cast("string"), F.lit('.html#top">x</a>'))
    robots = F.when(rid % 10 == 3, '<meta name="Robots" content="noindex, nofollow">').otherwise("")
    page = F.concat(F.lit("<html><head><title>"), subject, F.lit("</title>"), robots, F.lit("<script>var a = '<b>';</script></head><body><h1>"), subject, F.lit("</h1><p>"), content, F.lit("</p>"), link(rid * 2), link(rid * 2 + 1), F.lit("</body></html>"))
    return docs.select("record_id", F.concat(F.lit("http://pages.example/d/"), rid.cast("string"), F.lit(".html")).alias("url"), page.alias("html"))


def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = html.parse_pages(html_pages(spark, sf_dir), keep=("record_id",))
    return html.indexable(parsed).select("record_id", "title", F.array_join("headlines", "|").alias("headlines"))


_CLEAN = "trim(regexp_replace(coalesce(ad_index['subject'], ''), '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'))"
_register("html_titles", html_titles, f"select record_id, {_CLEAN} as title, {_CLEAN} as headlines from api_documents where record_id % 10 <> 3")


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.followed_links(html.parse_pages(html_pages(spark, sf_dir)))


_register("html_links", html_links, """with l as (select record_id as r, unnest([record_id * 2, record_id * 2 + 1]) as t from api_documents where record_id % 10 <> 3)
select 'http://pages.example/d/' || r || '.html' as url, 'http://pages.example/d/' || t || '.html' as link from l""")  # fmt: skip


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = html.page_documents(html.indexable(html.parse_pages(html_pages(spark, sf_dir))))
    return made.select("uri", F.explode("index").alias("context", "text")).where("context = 'title'").select("uri", "text")


_register("page_documents", page_documents, r"""with t as (select record_id, trim(regexp_replace(coalesce(ad_index['subject'], ''), '[^\p{L}\p{N}]+', ' ', 'g')) as text from api_documents where record_id % 10 <> 3)
select 'http://pages.example/d/' || record_id || '.html' as uri, text from t where text <> ''""")  # fmt: skip


def _record_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read_table(spark, sf_dir, "api_documents").select(F.col("record_id").alias("r"))
    links = ids.select(F.concat(F.lit("d"), F.col("r").cast("string")).alias("url"), F.explode(F.array(F.col("r") * 3, F.col("r") * 3 + 1, F.floor(F.col("r") / 2))).alias("t"))
    return links.select("url", F.concat(F.lit("d"), F.col("t").cast("string")).alias("link"))


def crawl_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six levels only, as its SQL says; ``crawl_all`` has no bound."""
    seeds = spark.createDataFrame([("d1",)], "uri string")
    return crawl.crawl(seeds, _record_links(spark, sf_dir), crawl.CrawlConfig(max_level=6)).select("uri", "level", "done")


_register("crawl_levels", crawl_levels, """with recursive e as (select record_id as r, unnest([record_id * 3, record_id * 3 + 1, record_id // 2]) as t from api_documents),
w as (select 1::bigint as r, 0 as level union select e.t, w.level + 1 from w join e on e.r = w.r where w.level < 6)
select 'd' || r as uri, min(level)::int as level, true as done from w group by r""")  # fmt: skip


def crawl_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything reached from every hundredth record, without a bound on levels. No SQL: its recursion would go through
    every path; the tests have a brute-force crawl."""
    seeds = read_table(spark, sf_dir, "api_documents").where("record_id % 100 = 1").select(F.concat(F.lit("d"), F.col("record_id").cast("string")).alias("uri"))
    return crawl.crawl(seeds, _record_links(spark, sf_dir)).select("uri", "level", "done")


_register("crawl_all", crawl_all)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix search in the default contexts, ranked, first page."""
    q = parse("har")
    found = compiler(spark, sf_dir, q).scored(q)
    docs = corpus(spark, sf_dir)
    return ranking.projected(ranking.described_page(ranking.weighted(found, docs), docs, 0, 10)).select("doc_id", "uri", "score", "weight")
