"""The queries of the engine over the driver's tables, and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import actions, names, spans
from larkspur.functions.shared import dealt
from larkspur.operators import backends, tokens, vault
from larkspur.operators.languages import resolve_languages
from larkspur.operators.rehydrate import rehydrate, rehydrate_chunks
from larkspur.operators.reversible import apply_operators, deanonymize
from larkspur.operators.table_function import register_detect_entities
from larkspur.plans import analytics
from larkspur.plans.firewall import CONTEXT, Firewall, mock_model
from larkspur.sources.catalog import Catalog, Pattern, validate_catalog, validate_pattern
from larkspur.sources.languages import LOCALES, Router
from larkspur.sources.profiles import Disposition, preset, preset_names

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_CATALOG = Catalog.default()
_NAMED = {p.description: p for p in _CATALOG.all()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that gives the same rows."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _duck(name: str) -> str:
    p = _NAMED[name]
    return sql_text(("(?i)" if p.ignore_case else "") + p.regex)


def _matches_sql(name: str, more: str = "") -> str:
    """DuckDB SQL for the matches of a pattern in documents, with offsets from the gaps between them."""
    rx = _duck(name)
    return f"""with found as (select doc_id, text, regexp_extract_all(text, {rx}) as m, string_split_regex(text, {rx}) as g from documents),
cuts as (select doc_id, text as whole, m, g, unnest(range(len(m))) as i from found where len(m) > 0),
spans as (select doc_id, whole, m[i + 1] as text,
  cast(list_sum(list_transform(g[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) as int) as start from cuts),
placed as (select doc_id, whole, start, cast(start + length(text) as int) as "end", text from spans){more}"""


def _detector(short: str, pattern: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return analytics.pattern_matches(table(spark, sf_dir, "documents"), _NAMED[pattern]).select("doc_id", "start", "end", "text")

    run.__name__ = short
    query(_matches_sql(pattern) + '\nselect doc_id, start, "end", text from placed')(run)


for _short, _pattern in (("detect_email", "GLOBAL_EMAIL"), ("detect_ipv4", "GLOBAL_IP_V4"), ("detect_credit_card", "GLOBAL_CREDIT_CARD"), ("detect_us_phone", "US_PHONE")):
    _detector(_short, _pattern)


def _boosted(name: str) -> str:
    near = " or ".join(f"contains(around, {sql_text(w)})" for w in _NAMED[name].context_words)
    return f"""{_matches_sql(name)},
near as (select *, substring(lower(whole), greatest(start - 100, 0) + 1, "end" + 100 - greatest(start - 100, 0)) as around from placed)
select doc_id, start, "end", text, case when {near} then least(1e0, {_NAMED[name].confidence}e0 + 0.25e0) else {_NAMED[name].confidence}e0 end as confidence from near"""


@query(_boosted("GLOBAL_CREDIT_CARD"))
def context_boost_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.pattern_matches(table(spark, sf_dir, "documents"), _NAMED["GLOBAL_CREDIT_CARD"])


@query(f"""{_matches_sql("GLOBAL_CREDIT_CARD", ",")}
{_matches_sql("US_ACCOUNT_NUMBER").replace("with found", "found2").replace("from found ", "from found2 ").replace("cuts as (", "cuts2 as (").replace("from cuts)", "from cuts2)").replace("spans as (", "spans2 as (").replace("from spans)", "from spans2)").replace("placed as (", "placed2 as (")}
select a.doc_id, a.start as a_start, a."end" as a_end, b.start as b_start, b."end" as b_end
from placed a join placed2 b on a.doc_id = b.doc_id and a.start < b."end" and b.start < a."end\"""")
def span_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return analytics.overlapping(analytics.pattern_matches(docs, _NAMED["GLOBAL_CREDIT_CARD"]), analytics.pattern_matches(docs, _NAMED["US_ACCOUNT_NUMBER"]))


_COUNTED = [p for p in _CATALOG.for_locale("GLOBAL")] + [_NAMED[n] for n in ("US_PHONE", "US_SSN", "ES_DNI", "FR_IBAN", "DE_DATE_DOTTED", "IT_VAT", "PT_CPF")]
_COUNTS_SQL = " union all ".join(f"select lang, '{p.entity_type}' as entity_type, len(regexp_extract_all(coalesce(text, ''), {_duck(p.description)})) as n from documents" for p in _COUNTED)


@query(f"with c as ({_COUNTS_SQL}) select lang, entity_type, cast(sum(n) as bigint) as n_matches from c where n > 0 group by all")
def entity_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.type_counts(table(spark, sf_dir, "documents"), _COUNTED, "lang")


@query(f"with c as ({_COUNTS_SQL}) select lang, entity_type, cast(sum(n) as bigint) as n_matches from c where n > 0 group by rollup(lang, entity_type)")
def entity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = analytics.type_counts(table(spark, sf_dir, "documents"), _COUNTED, "lang")
    return counts.rollup("lang", "entity_type").agg(F.sum("n_matches").alias("n_matches"))


def _messages(docs: DataFrame) -> DataFrame:
    """Documents as messages: a source is a tenant, a document a case and a thread of its own."""
    doc = F.col("doc_id").cast("string")
    return docs.select(F.col("source").alias("tenant_id"), doc.alias("case_id"), doc.alias("thread_id"), F.col("doc_id").alias("msg_seq"), "lang", "text")


@query()
def span_dedupe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All patterns of each document's locale, overlaps resolved: spans by language, type and source."""
    found = Firewall.create().with_spans(_messages(table(spark, sf_dir, "documents")), filtered=False)
    kinds = F.transform("spans", lambda s: F.struct(s["entity_type"], s["source"], s["confidence"]))  # not the column itself: its size would be tested first, by detecting again
    return found.select("locale", F.explode(kinds).alias("s")).groupBy("locale", "s.entity_type", "s.source").agg(F.count(F.lit(1)).alias("n_spans"), F.avg("s.confidence").alias("mean_confidence"))


_RANKS_SQL = """select * from (values ('PHONE_NUMBER', 100), ('EMAIL', 100), ('SSN', 100), ('IBAN', 100), ('CREDIT_CARD', 100), ('IP_ADDRESS', 100), ('URL', 100), ('SECRET', 100), ('DOI', 100), ('PMID', 100),
('NATIONAL_ID', 80), ('MEDICAL_RECORD', 80), ('PASSPORT', 80), ('DRIVERS_LICENSE', 80), ('TAX_ID', 80), ('ACCOUNT_NUMBER', 80), ('DATE_TIME', 60), ('DATE', 60), ('PERSON', 40), ('LOCATION', 30), ('ADDRESS', 30), ('POSTAL_CODE', 30),
('AGE', 10), ('MAC_ADDRESS', 10), ('ROUTING_NUMBER', 10), ('LICENSE_PLATE', 10)) t(entity_type, rank)"""
_TYPES = """PHONE_NUMBER EMAIL SSN IBAN CREDIT_CARD IP_ADDRESS URL SECRET DOI PMID NATIONAL_ID MEDICAL_RECORD PASSPORT DRIVERS_LICENSE TAX_ID ACCOUNT_NUMBER DATE_TIME DATE PERSON LOCATION ADDRESS POSTAL_CODE
AGE MAC_ADDRESS ROUTING_NUMBER LICENSE_PLATE""".split()


@query(_RANKS_SQL)
def specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in _TYPES], "entity_type string").withColumn("rank", F.expr(spans.rank_sql("entity_type")))


_LOCALE_CASE = " ".join(f"when '{k}' then '{v}'" for k, v in LOCALES.items())


@query(f"select case coalesce(lang, 'en') {_LOCALE_CASE} else 'GLOBAL' end as locale, count(*) as n_docs from documents group by 1")
def locale_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.expr(Router().locale_sql()).alias("locale")).agg(F.count(F.lit(1)).alias("n_docs"))


_DIRTY = " or ".join(f"regexp_matches(text, {sql_text(rx)})" for rx, _ in actions.RESIDUAL)


@query(f"select doc_id, coalesce({_DIRTY}, false) as dirty from documents")
def has_residual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(f"coalesce({actions.has_residual_sql('text')}, false)").alias("dirty"))


def _residual_oracle() -> str:
    out = "text"
    for _ in range(actions.PASSES):
        for rx, name in actions.RESIDUAL:
            out = f"regexp_replace({out}, {sql_text(rx)}, '[{name}]', 'g')"
    return f"select doc_id, md5({out}) as cleaned_md5 from documents"


@query(_residual_oracle())
def residual_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.expr(actions.residual_sql("text")).cast("binary")).alias("cleaned_md5"))


# rewriting of columns of the star schema

_CARD = "concat('4', lpad(cast(c_custkey as varchar), 15, '0'))"


@query(f"select c_custkey, {_CARD} as card, concat(repeat('*', 12), right({_CARD}, 4)) as masked, concat(left(c_name, 4), repeat('#', length(c_name) - 4)) as masked_name from customer")
def act_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("card", F.concat(F.lit("4"), F.lpad(F.col("c_custkey").cast("string"), 15, "0")))
    return rows.select("c_custkey", "card", F.expr(actions.mask_sql("card")).alias("masked"), F.expr(actions.mask_sql("c_name", 4, 0, "#")).alias("masked_name"))


@query("select s_suppkey, concat('[SSN_HASH_', substring(sha256(concat(s_name, 'pepper')), 1, 16), ']') as hashed from supplier")
def act_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(actions.hash_sql("s_name", "'SSN'", salt="pepper")).alias("hashed"))


@query("select p_partkey, case when (p_size * 7) % 200 <= 130 then concat(cast(((p_size * 7) % 200) // 10 * 10 as varchar), '-', cast(((p_size * 7) % 200) // 10 * 10 + 9 as varchar)) else '[AGE]' end as age from part")
def act_generalize_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "concat('about ', cast((p_size * 7) % 200 as string), ' years old')"
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(actions.age_sql(text)).alias("age"))


@query("select o_orderkey, strftime(o_orderdate, '%Y') as year from orders")
def act_generalize_date_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "concat('on ', date_format(o_orderdate, 'dd.MM.yyyy'))"
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(actions.date_sql(text)).alias("year"))


@query("select o_orderkey, strftime(o_orderdate, '%b %Y') as iso, strftime(o_orderdate, '%b %Y') as european, strftime(o_orderdate, '%b %Y') as spelled from orders")
def act_generalize_date_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = {"iso": "date_format(o_orderdate, 'yyyy-MM-dd')", "european": "date_format(o_orderdate, 'dd/MM/yyyy')", "spelled": "date_format(o_orderdate, 'd MMMM yyyy')"}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[F.expr(actions.date_sql(t, "month")).alias(n) for n, t in forms.items()])


@query("select c_custkey, '' as redacted, '[LOCATION]' as location, c_name as kept from customer")
def act_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = {n: F.expr(actions.action_sql(Disposition(t, a), "c_name")).alias(n) for n, t, a in (("redacted", "PERSON", "redact"), ("location", "LOCATION", "generalize"), ("kept", "PERSON", "keep"))}
    return table(spark, sf_dir, "customer").select("c_custkey", *done.values())


@query(f"""{_matches_sql("GLOBAL_EMAIL")}
select doc_id, md5(regexp_replace(text, {_duck("GLOBAL_EMAIL")}, '<mail>', 'g')) as spliced_md5 from documents where doc_id in (select doc_id from placed)""")
def splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parts = f"transform({spans.pattern_spans(_NAMED['GLOBAL_EMAIL'], 0, lowered='text')}, x -> named_struct('start', x.start, 'end', x.end, 'to', '<mail>'))"
    rows = docs.withColumn("parts", F.expr(parts)).where("size(parts) > 0")
    return rows.select("doc_id", F.md5(F.expr(actions.splice_sql("text", "parts")).cast("binary")).alias("spliced_md5"))


# profiles

_PRESETS = [preset(n) for n in preset_names()]
_DISPOSITIONS = ", ".join(f"({sql_text(n)}, {sql_text(t)}, {sql_text(a)}, {c}e0)" for p in _PRESETS for n, t, a, c, _ in p.rows())


@query("""select * from (values ('generic', 'pseudonymize', 22, 0.35e0, 0.75e0), ('generic', 'generalize', 4, 0.55e0, 0.75e0), ('generic', 'mask', 1, 0.75e0, 0.75e0),
('healthcare', 'pseudonymize', 19, 0.35e0, 0.8e0), ('healthcare', 'keep', 8, 0.75e0, 0.75e0), ('healthcare', 'generalize', 4, 0.55e0, 0.75e0),
('finance', 'pseudonymize', 22, 0.35e0, 0.75e0), ('finance', 'generalize', 3, 0.75e0, 0.75e0), ('finance', 'keep', 2, 0.75e0, 0.75e0), ('finance', 'mask', 1, 0.75e0, 0.75e0),
('legal', 'pseudonymize', 23, 0.35e0, 0.85e0), ('legal', 'generalize', 4, 0.55e0, 0.75e0), ('legal', 'keep', 1, 0.75e0, 0.75e0)) p(profile, action, n_types, least, most)""")
def profile_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.dispositions(spark, _PRESETS)
    return rows.groupBy("profile", "action").agg(F.count(F.lit(1)).alias("n_types"), F.min("confidence_threshold").cast("double").alias("least"), F.max("confidence_threshold").alias("most"))


_SCORED_TYPES = ["EMAIL", "PHONE_NUMBER", "DATE_TIME", "DATE", "LICENSE_PLATE", "DIAGNOSIS", "PERSON", "DOI"]
_SCORED = f"select o_orderkey, list_value({', '.join(map(sql_text, _SCORED_TYPES))})[cast(o_orderkey % {len(_SCORED_TYPES)} as int) + 1] as entity_type, (o_orderkey % 20) / 20e0 as confidence from orders"


@query(f"""with scored as ({_SCORED}), d(profile, entity_type, action, confidence_threshold) as (values {_DISPOSITIONS})
select d.profile, s.entity_type, d.action, count(*) as n_kept from scored s join d on d.entity_type = s.entity_type and s.confidence >= d.confidence_threshold group by all""")
def profile_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, _SCORED_TYPES))
    scored = table(spark, sf_dir, "orders").select(F.get(kinds, (F.col("o_orderkey") % len(_SCORED_TYPES)).cast("int")).alias("entity_type"), ((F.col("o_orderkey") % 20) / F.lit(20.0)).alias("confidence"))
    dims = F.broadcast(analytics.dispositions(spark, _PRESETS))  # as many rows as the presets have types
    return scored.join(dims, "entity_type").where("confidence >= confidence_threshold").groupBy("profile", "entity_type", "action").agg(F.count(F.lit(1)).alias("n_kept"))


@query("select * from (values ('GLOBAL', 11, 8), ('ES', 11, 9), ('US', 12, 10), ('FR', 5, 5), ('DE', 6, 5), ('IT', 5, 5), ('PT', 7, 5)) p(locale, n_patterns, n_types)")
def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.patterns_table(spark, _CATALOG).groupBy("locale").agg(F.count(F.lit(1)).alias("n_patterns"), F.countDistinct("entity_type").alias("n_types"))


_FAULTY = {"good": Pattern("A", "GLOBAL", r"\d{4}", 0.5), "open": Pattern("B", "GLOBAL", "("), "sure": Pattern("C", "GLOBAL", "a", 2.0), "nested": Pattern("D", "GLOBAL", "(ab*)*c"), "wide": Pattern("E", "GLOBAL", ".*"), "blank": Pattern("F", "GLOBAL", "ab", 1.0, False, ("ok", " ")), "twice": Pattern("G", "GLOBAL", "a.*.*b")}


@query("""select * from (values ('open', 'error'), ('sure', 'error'), ('nested', 'warning'), ('wide', 'error'), ('wide', 'warning'), ('blank', 'warning'), ('twice', 'warning')) p(pattern, severity)""")
def catalog_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checks say about a small catalogue with known faults; the built-in one must have none."""
    if validate_catalog(_CATALOG):
        raise ValueError("the built-in catalogue breaks a rule")
    return spark.createDataFrame([(n, i.severity) for n, p in _FAULTY.items() for i in validate_pattern(p)], "pattern string, severity string")


# tokens and vault

_MAILS = f"""{_matches_sql("GLOBAL_EMAIL", ",")}
mentions as (select p.doc_id, d.source, p.start, p.text, lower(trim(p.text)) as canonical from placed p join documents d on d.doc_id = p.doc_id)"""


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.pattern_matches(table(spark, sf_dir, "documents"), _NAMED["GLOBAL_EMAIL"], "doc_id", "source")
    doc = F.col("doc_id").cast("string")
    return found.select(F.col("source").alias("tenant_id"), doc.alias("case_id"), doc.alias("thread_id"), F.col("doc_id").alias("msg_seq"), "start", F.lit("EMAIL").alias("entity_type"), "text")


@query(f"""{_MAILS},
firsts as (select source, canonical, min(struct_pack(a := doc_id, b := -start)) as f from mentions group by all),
ranked as (select *, row_number() over (partition by source order by f.a, f.b, canonical) as ordinal from firsts)
select source as tenant_id, 'tenant:*' as scope, 'EMAIL' as entity_type, printf('[EMAIL_%03d]', ordinal) as token, canonical, ordinal from ranked""")
def token_resolve_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.resolve_exact(_mentions(spark, sf_dir))


@query(f"""{_MAILS},
firsts as (select source, doc_id, canonical, min(-start) as b from mentions group by all),
ranked as (select *, row_number() over (partition by source, doc_id order by b, canonical) as ordinal from firsts)
select source as tenant_id, concat('thread:', doc_id) as scope, 'EMAIL' as entity_type, printf('[EMAIL_%03d]', ordinal) as token, canonical, ordinal from ranked""")
def token_scope_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.resolve_exact(_mentions(spark, sf_dir), "thread")


@query(f"""{_MAILS},
firsts as (select source, canonical, min(doc_id) as a from mentions group by all),
early as (select source, canonical, min(struct_pack(a := doc_id, b := -start)) as f from mentions where doc_id < 500 group by all),
old as (select *, row_number() over (partition by source order by f.a, f.b, canonical) as ordinal from early),
late as (select m.source, m.canonical, min(struct_pack(a := m.doc_id, b := -m.start)) as f from mentions m where not exists (select 1 from old o where o.source = m.source and o.canonical = m.canonical) group by all),
tops as (select source, max(ordinal) as top from old group by 1),
new as (select l.source, l.canonical, row_number() over (partition by l.source order by f.a, f.b, l.canonical) + coalesce(top, 0) as ordinal from late l left join tops t on t.source = l.source)
select source as tenant_id, printf('[EMAIL_%03d]', ordinal) as token, canonical from (select source, canonical, ordinal from old union all select source, canonical, ordinal from new)""")
def token_registry_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry made from the first documents, then carried on over all of them."""
    mentions = _mentions(spark, sf_dir)
    old = tokens.resolve_exact(mentions.where("msg_seq < 500"))
    return tokens.resolve_exact(mentions, registry=old).select("tenant_id", "token", "canonical")


_LOG = """select concat('t', o_custkey % 5) as tenant_id, concat('c', o_custkey % 50) as case_id, concat('h', o_custkey) as thread_id, printf('[EMAIL_%03d]', o_orderkey % 3 + 1) as token,
concat('user', o_orderkey, '@x.org') as original, case when o_orderkey % 4 = 0 then null else 1000 + o_orderkey % 1000 end as expires_at, o_orderkey as seq from orders"""
_LATEST = f"with log as ({_LOG}), last as (select tenant_id, case_id, thread_id, token, max(struct_pack(seq := seq, original := original, expires_at := expires_at)) as l from log group by all), v as (select tenant_id, case_id, thread_id, token, l.original as original, l.expires_at as expires_at from last)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    ttl = F.when(key % 4 == 0, F.lit(0)).otherwise(key % 1000)
    return rows.select(
        F.concat(F.lit("t"), cust % 5).alias("tenant_id"), F.concat(F.lit("c"), cust % 50).alias("case_id"), F.concat(F.lit("h"), cust).alias("thread_id"), F.format_string("[EMAIL_%03d]", key % 3 + 1).alias("token"),
        F.concat(F.lit("user"), key, F.lit("@x.org")).alias("original"), F.when(ttl > 0, F.lit(1000) + ttl).when(key % 4 != 0, F.lit(1000)).cast("long").alias("expires_at"), key.alias("seq"),
    )


@query(f"{_LATEST} select * from v")
def vault_put_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.latest(_log(spark, sf_dir))


@query(f"{_LATEST} select tenant_id, case_id, thread_id, string_agg(concat(token, '=', original), ';' order by token) as mapping from v where expires_at is null or expires_at > 1500 group by all")
def vault_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vault.mapping(vault.latest(_log(spark, sf_dir)), 1500)
    return made.select(*CONTEXT, F.array_join(F.array_sort(F.transform(F.map_entries("mapping"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("mapping"))


@query(f"{_LATEST} select * from v where not (tenant_id = 't1' and case_id = 'c1')")
def vault_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vault.latest(_log(spark, sf_dir))
    return vault.forget(rows, rows.where("tenant_id = 't1' and case_id = 'c1'"))[0]


@query(f"{_LATEST} select count(*) as purged from v where expires_at <= 1500")
def vault_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.purge(vault.latest(_log(spark, sf_dir)), 1500)[1]


@query(f"{_LATEST} select tenant_id, case_id, thread_id, concat('write to ', string_agg(original, ' and ' order by token)) as final_text from v group by all")
def rehydrate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vault.latest(_log(spark, sf_dir))
    texts = rows.groupBy(*CONTEXT).agg(F.concat(F.lit("write to "), F.array_join(F.array_sort(F.collect_list("token")), " and ")).alias("text"))
    return rehydrate(texts, vault.mapping(rows)).select(*CONTEXT, "final_text")


@query(f"{_LATEST} select tenant_id, case_id, thread_id, concat('dear ', original, '.') as final_text from v where token = '[EMAIL_001]'")
def rehydrate_stream_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of three characters, put together by thread and restored."""
    rows = vault.latest(_log(spark, sf_dir))
    texts = rows.where("token = '[EMAIL_001]'").select(*CONTEXT, F.concat(F.lit("dear "), "token", F.lit(".")).alias("text"))
    chunks = texts.select(*CONTEXT, F.posexplode(F.transform(F.sequence(F.lit(1), F.length("text"), F.lit(3)), lambda i: F.col("text").substr(i, F.lit(3)))).alias("chunk_seq", "chunk"))
    return rehydrate_chunks(chunks, vault.mapping(rows))


@query()
def anonymize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over all documents."""
    made = Firewall.create().anonymize(_messages(table(spark, sf_dir, "documents")))
    return made.messages.select(F.col("msg_seq").alias("doc_id"), "sanitized_text", F.size("trace.detected_entities").alias("n_entities"))


@query()
def secure_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrite, call the stand-in model, restore, over all documents."""
    made = Firewall.create().secure_call(_messages(table(spark, sf_dir, "documents")), mock_model)
    return made.select("msg_seq", "sanitized_text", "final_text")


# names

_PEOPLE = "concat(case when c_custkey % 3 = 0 then 'Dr. ' else '' end, case c_custkey % 4 when 0 then 'Anna' when 1 then 'Bernard' when 2 then 'B.' else 'Carla' end, ' ', case c_custkey % 5 when 0 then 'Smith' when 1 then 'Smyth' when 2 then 'S.' when 3 then 'Müller' else 'Jones' end)"


@query("select a.s_suppkey as a_key, b.s_suppkey as b_key, levenshtein(a.s_name, b.s_name) as distance from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey")
def name_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.name_distances(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", "s_name")


@query(f"select c_custkey, lower(array_to_string(list_transform(string_split({_PEOPLE}, ' '), lambda w: w[1]), '')) as initials from customer")
def name_initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", names.initials_of(F.expr(_PEOPLE.replace("varchar", "string"))).alias("initials"))


@query()
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names compared with those whose last word starts alike."""
    people = table(spark, sf_dir, "customer").select(F.expr(_PEOPLE).alias("name")).distinct().withColumn("block", F.lower(F.substring(F.element_at(F.split("name", " "), -1), 1, 1)))
    a, b = people.alias("a"), people.alias("b")
    pairs = a.join(b, "block").where(F.col("a.name") < F.col("b.name"))
    return pairs.select(F.col("a.name").alias("a_name"), F.col("b.name").alias("b_name"), F.round(names.similarity_of(F.col("a.name"), F.col("b.name")), 6).alias("score"))


@query()
def token_resolve_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("tenant_id"), F.lit("c").alias("case_id"), F.lit("h").alias("thread_id"), F.col("c_custkey").alias("msg_seq"), F.lit(0).alias("start"), F.lit("PERSON").alias("entity_type"), F.expr(_PEOPLE).alias("text"))
    return tokens.resolve_persons(rows)


_ODD_NAMES = "case c_custkey % 6 when 0 then 'anna smith' when 1 then 'Al' when 2 then 'Bob' when 3 then 'Li Wu' when 4 then 'Ünal' else '  x  ' end"


@query(f"select c_custkey, {_ODD_NAMES} as name from customer where c_custkey % 6 in (2, 3, 4)")
def heuristic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of names: small first letters go, and single words of under three characters."""
    rows = table(spark, sf_dir, "customer").withColumn("name", F.expr(_ODD_NAMES))
    made = rows.withColumn("spans", F.expr(f"cast(array(named_struct('start', 0, 'ord', 0, 'end', length(name), 'text', name, 'entity_type', 'PERSON', 'confidence', 0.9D, 'source', 'x')) as {spans.SPANS_SQL})"))
    return made.select("c_custkey", F.explode(spans.heuristic_filter()).alias("s")).select("c_custkey", F.col("s.text").alias("name"))


@query("select c_custkey, concat(c_name, '-', c_mktsegment) as merged from customer")
def person_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("text", F.concat("c_name", F.lit("-"), "c_mktsegment"))
    made = rows.withColumn("spans", F.expr(f"cast(array(named_struct('start', 0, 'ord', 0, 'end', length(c_name), 'text', c_name, 'entity_type', 'PERSON', 'confidence', 0.9D, 'source', 'x'), named_struct('start', length(c_name) + 1, 'ord', 1, 'end', length(text), 'text', c_mktsegment, 'entity_type', 'PERSON', 'confidence', 0.8D, 'source', 'y')) as {spans.SPANS_SQL})"))
    return made.select("c_custkey", F.explode(spans.merge_persons()).alias("s")).select("c_custkey", F.col("s.text").alias("merged"))


# models, payloads, reports

_LABEL_VALUES = """('opf', 'private_person', 'PERSON'), ('opf', ' Secret ', 'SECRET'), ('opf', 'nothing', null), ('gliner', 'first name', 'PERSON'), ('gliner', 'routing number', 'ROUTING_NUMBER'), ('gliner', 'location zip', 'POSTAL_CODE'), ('gliner', 'Email Address', null),
('nemotron', 'mac_address', 'MAC_ADDRESS'), ('nemotron', 'private_url', 'URL'), ('nemotron', 'PIN', 'SECRET'), ('nemotron', 'employee_id', 'NATIONAL_ID'), ('conll', 'per', 'PERSON'), ('conll', 'ORG', 'COMPANY_NAME'), ('conll', 'GPE', 'LOCATION'), ('conll', 'misc', 'MISC'),
('medical', 'Disease_disorder', 'DIAGNOSIS'), ('medical', 'medication', 'DRUG'), ('medical', 'Age', null), ('medical', 'Outcome', null), ('medical', 'Biological_structure', 'ANATOMICAL_SITE'), ('medical', 'odd', 'ODD')"""
_LABEL_ROWS = [("opf", "private_person"), ("opf", " Secret "), ("opf", "nothing"), ("gliner", "first name"), ("gliner", "routing number"), ("gliner", "location zip"), ("gliner", "Email Address"), ("nemotron", "mac_address"), ("nemotron", "private_url"), ("nemotron", "PIN"), ("nemotron", "employee_id"), ("conll", "per"), ("conll", "ORG"), ("conll", "GPE"), ("conll", "misc"), ("medical", "Disease_disorder"), ("medical", "medication"), ("medical", "Age"), ("medical", "Outcome"), ("medical", "Biological_structure"), ("medical", "odd")]


@query(f"select * from (values {_LABEL_VALUES}) t(backend, label, entity_type)")
def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_LABEL_ROWS, "backend string, label string")
    mapped = F.coalesce(*[F.when(F.col("backend") == b, backends.map_label(F.col("label"), b)) for b in backends.LABELS])
    return rows.withColumn("entity_type", mapped)


@query("select o_orderkey, 'EMAIL' as entity_type, 5 as start, 5 + length(concat('u', o_orderkey, '@x.org')) as \"end\", concat('u', o_orderkey, '@x.org') as text, 0.5e0 as confidence from orders")
def remote_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a remote model in its three shapes."""
    rows = table(spark, sf_dir, "orders").withColumn("text", F.concat(F.lit("mail u"), "o_orderkey", F.lit("@x.org now")))
    item = "to_json(array(named_struct('entity_group', 'EMAIL', 'start', 5, 'end', length(text) - 4, 'score', 0.5D)))"
    shaped = rows.withColumn("answer", F.expr(f"case o_orderkey % 3 when 0 then {item} when 1 then concat('{{\"predictions\":', {item}, '}}') else concat('{{\"results\":', {item}, '}}') end"))
    found = shaped.select("o_orderkey", F.explode(backends.remote_spans(F.col("answer"), F.col("text"))).alias("s"))
    return found.select("o_orderkey", "s.entity_type", "s.start", "s.end", "s.text", "s.confidence")


def _recognizer_counts(language: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))
        rows = orders.select(F.concat(F.lit("Ana G. llamó el "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" al +34"), F.lit(600000000) + F.col("o_orderkey"), F.lit(", DNI "), F.lpad(F.col("o_orderkey").cast("string"), 8, "1"), F.lit("Z")).alias("text"), F.lit("GLOBAL").alias("locale"))
        # explode gets an expression: of a column Spark would first test the size, and so detect three times over
        types = F.transform(F.expr(spans.dedupe_sql(spans.detect_sql(backends.recognizers(language), locales=[]))), lambda s: s["entity_type"])
        return rows.select(F.explode(types).alias("entity_type")).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n_spans"))

    return run


for _language, _name in (("en", "universal_recognizers"), ("es", "spanish_recognizers")):
    _run = _recognizer_counts(_language)
    _run.__name__ = _name
    query(f"select entity_type, n as n_spans from (select count(*) as n from orders), (values ('PERSON'), ('DATE_TIME'), ('PHONE_NUMBER'){', (' + sql_text('NATIONAL_ID') + ')' if _language == 'es' else ''}) t(entity_type)")(_run)


@query("""select c_custkey, '[EMAIL_002] or [EMAIL_001]' as mail, '[EMAIL_001]' as note, concat('card ************', right(lpad(cast(c_custkey as varchar), 15, '0'), 4)) as card, c_name as name, c_acctbal as balance from customer""")
def anonymize_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested payload of each customer: all its strings are rewritten; numbers and names of fields stay."""
    key = F.col("c_custkey").cast("string")
    first, second = F.concat(F.lit("u"), key, F.lit("@x.org")), F.concat(F.lit("v"), key, F.lit("@y.org"))
    card = F.concat(F.lit("card 4"), F.lpad(key, 15, "0"))
    payload = F.struct(F.struct(F.concat(second, F.lit(" or "), first).alias("mail"), F.col("c_acctbal").alias("balance")).alias("to"), F.array(first, card).alias("notes"), F.create_map(F.lit("k"), F.col("c_name")).alias("by"))
    rows = table(spark, sf_dir, "customer").select(F.lit("t").alias("tenant_id"), F.lit("c").alias("case_id"), key.alias("thread_id"), F.col("c_custkey").alias("msg_seq"), payload.alias("payload"))
    done, _ = Firewall.create(language="en", token_scope="thread").anonymize_payload(rows, "payload")
    return done.select(F.col("msg_seq").alias("c_custkey"), F.col("payload.to.mail").alias("mail"), F.get("payload.notes", F.lit(0)).alias("note"), F.get("payload.notes", F.lit(1)).alias("card"), F.col("payload.by")["k"].alias("name"), F.col("payload.to.balance").alias("balance"))


@query("""with rows as (select cast(c_custkey as varchar) as k from customer)
select k as thread_id, '[EMAIL_001]' as token, concat('u', k, '@x.org') as original, 1060 as expires_at from rows
union all select k, '[IP_ADDRESS_001]', '10.0.0.1', 87400 from rows union all select k, '[URL_001]', 'https://x.org/a', null from rows""")
def vault_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals in the vault expire by the disposition of their type; a time to live of 0 is for ever."""
    profile = preset("generic")
    profile.add(Disposition("EMAIL", parameters={"ttl_seconds": 60}))
    profile.add(Disposition("URL", parameters={"ttl_seconds": 0}))
    key = F.col("c_custkey").cast("string")
    rows = table(spark, sf_dir, "customer").select(F.lit("t").alias("tenant_id"), F.lit("c").alias("case_id"), key.alias("thread_id"), F.lit(1).alias("msg_seq"), F.concat(F.lit("u"), key, F.lit("@x.org at 10.0.0.1 saw https://x.org/a today")).alias("text"))
    made = Firewall.create(profile=profile, language="en", token_scope="thread").anonymize(rows, now=1000)
    return made.vault.select("thread_id", "token", "original", "expires_at")


@query("select c_custkey, concat('mail u', c_custkey, '@x.org now') as restored, true as hidden, 5 as at from customer")
def encrypt_deanonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans encrypted in the text, and restored from the record of what went where."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("mail u"), "c_custkey", F.lit("@x.org now")).alias("text"))
    spanned = rows.withColumn("spans", F.expr(spans.detect_sql(_CATALOG, locales=[])))
    made = apply_operators(spanned, {"EMAIL": ("encrypt", {"key": "0123456789abcdef"})})
    return made.select("c_custkey", deanonymize(F.col("anonymized"), F.col("items"), "0123456789abcdef").alias("restored"), (~F.contains("anonymized", F.lit("@"))).alias("hidden"), F.get("items", F.lit(0))["start"].alias("at"))


_TOLD = "select conv_id, turn, case when turn % 5 = 4 then 'de' end as lang, case (turn * 7 + length(text)) % 3 when 0 then 'en' when 1 then 'es' else 'fr' end as detected, (length(text) % 10) / 10e0 as confidence from conversations"


@query(f"""with told as ({_TOLD}),
auto as (select conv_id, turn, first_value(detected) over w as first_one, last_value(case when confidence >= 0.7e0 then detected end ignore nulls) over w as sure from told where lang is null
  window w as (partition by conv_id order by turn rows between unbounded preceding and current row))
select t.conv_id, t.turn, coalesce(t.lang, a.sure, a.first_one) as language from told t left join auto a on a.conv_id = t.conv_id and a.turn = t.turn""")
def language_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each turn: set by hand, or what the thread has until a detector is sure of another."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", *[F.expr(e) for e in ("case when turn % 5 = 4 then 'de' end as lang", "case (turn * 7 + length(text)) % 3 when 0 then 'en' when 1 then 'es' else 'fr' end as detected", "(length(text) % 10) / 10D as confidence")])
    return resolve_languages(rows, ["conv_id"], ["turn"]).select("conv_id", "turn", "language")


@query("select o_orderkey, 'EMAIL' as entity_type, 5 as start, concat('u', o_orderkey, '@x.org') as text from orders")
def detect_entities_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_detect_entities(spark)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("mail u"), "o_orderkey", F.lit("@x.org now")).alias("whole"))
    return spark.sql("select o_orderkey, e.entity_type, e.start, e.text from {rows}, lateral detect_entities(whole, 'US') e", rows=rows)


@query("""with words as (select distinct conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]{12,}')) as token from conversations)
select conv_id, token, string_agg(cast(turn as varchar), ',' order by turn) as turns, count(*) as n_turns, count(*) > 1 as continued from words group by conv_id, token""")
def continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long words stand in for tokens: the conversations hold no personal data."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{12,})"), 1)).alias("token"))
    return analytics.continuity(rows).withColumn("turns", F.array_join(F.col("turns").cast("array<string>"), ","))


@query()
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By language: documents with structured personal data, and those of which the pipeline leaves none."""
    made = Firewall.create().anonymize(_messages(table(spark, sf_dir, "documents")))
    return analytics.audit(made.messages)
