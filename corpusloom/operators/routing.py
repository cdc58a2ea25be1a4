"""Profiles of knowledge bases, and the routing of queries to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.patterns import contained
from corpusloom.operators.retrieval import ranked

# Words too common to be keywords, domain words, greetings.
STOP_WORDS = ("管理", "系统", "平台", "操作", "手册", "文档", "进行", "支持", "功能")
DOMAINS = (("医工", "医工|医疗设备|设备维修|外协|台账|无人值守|故障|报错"), ("后勤", "后勤|保洁|运送|医废|巡检|能耗|报修|食堂|物业"))
OTHER = "其他"
GREETING = r"(?i)^\s*(你好|您好|hello|hi|谢谢|thanks)[！!。.\s]*$"
KEYWORDS, SAMPLES, SAMPLE_CHARS, SUMMARY_CHARS, TITLES, TERMS = 40, 16, 300, 1200, 12, 12


def profiles(kbs: DataFrame, documents: DataFrame, parents: DataFrame) -> DataFrame:
    """kbs (kb_id, name, description), documents (kb_id, document_id, title, department, doc_type), parents (kb_id,
    document_id, parent_index, content) -> kb_id, document_count, departments, doc_types, titles, sample, summary.

    A knowledge base's first titles and parents are picked by rank, so only those are gathered.
    """
    named = ranked(documents, ["kb_id"], [F.col("document_id")], "_n", TITLES)
    titles = named.groupBy("kb_id").agg(F.sort_array(F.collect_list(F.struct("_n", "title"))).alias("t"))
    facts = documents.groupBy("kb_id").agg(
        F.count("*").alias("document_count"),
        F.sort_array(F.collect_set(F.when(F.col("department") != "", F.col("department")))).alias("departments"),
        F.sort_array(F.collect_set(F.when(F.col("doc_type") != "", F.col("doc_type")))).alias("doc_types"),
    )
    first = ranked(parents, ["kb_id"], [F.col("document_id"), F.col("parent_index")], "_n", SAMPLES)
    samples = first.groupBy("kb_id").agg(F.sort_array(F.collect_list(F.struct("_n", F.substring("content", 1, SAMPLE_CHARS).alias("c")))).alias("s"))
    return assemble(kbs, facts, titles, samples)


def assemble(kbs: DataFrame, facts: DataFrame, titles: DataFrame, samples: DataFrame) -> DataFrame:
    """The profiles of kbs from facts (kb_id, document_count, departments, doc_types), titles (kb_id, t: structs with title, in order)
    and samples (kb_id, s: structs with c, a parent's beginning, in order)."""
    out = kbs.join(facts, "kb_id", "left").join(titles, "kb_id", "left").join(samples, "kb_id", "left")
    empty = F.array().cast("array<string>")
    out = out.select(
        "kb_id", "name", "description", F.coalesce("document_count", F.lit(0)).cast("long").alias("document_count"), F.coalesce("departments", empty).alias("departments"),
        F.coalesce("doc_types", empty).alias("doc_types"), F.coalesce(F.col("t.title"), empty).alias("titles"), F.coalesce(F.array_join(F.col("s.c"), "\n"), F.lit("")).alias("sample"),
    )
    listed = lambda c, sep, none: F.when(F.size(c) > 0, F.array_join(c, sep)).otherwise(none)
    summary = F.concat_ws(
        "\n", F.concat(F.lit("知识库名称："), "name"), F.concat(F.lit("描述："), X.truthy(F.col("description"), F.lit("无"))),
        F.concat(F.lit("文档数："), F.col("document_count").cast("string")), F.concat(F.lit("部门："), listed("departments", "、", "未标注")),
        F.concat(F.lit("文档类型："), listed("doc_types", "、", "未标注")), F.concat(F.lit("代表文档："), listed("titles", "；", "暂无文档")),
        F.when(F.col("sample") != "", F.concat(F.lit("抽样内容："), F.substring("sample", 1, SUMMARY_CHARS))),
    )
    return out.withColumn("summary", summary)


def keywords(texts: DataFrame, key: str, text: str, limit: int = KEYWORDS, by_frequency: bool = False) -> DataFrame:
    """(key, keyword, n, rank) of the limit first tokens by falling count, then by token. Tokens are distinct before they
    are counted, so that the order is that of the tokens alone, unless by_frequency."""
    tokens = X.profile_tokens(F.col(text))
    rows = texts.select(key, F.explode(tokens).alias("keyword"), text)
    rows = rows.filter(~F.col("keyword").isin(*STOP_WORDS) & (F.length("keyword") >= 2))
    n = X.count_of(F.lower(F.col(text)), F.col("keyword")) if by_frequency else F.lit(1).cast("long")
    return ranked(rows.select(key, "keyword", n.alias("n")), [key], [F.col("n").desc(), F.col("keyword")], "rank", limit)


def profile_text(profiles_: DataFrame, keywords_: DataFrame) -> DataFrame:
    """(kb_id, profile): name, description, summary and keywords in one text."""
    listed = F.sort_array(F.collect_list(F.struct("rank", "keyword")))
    words = keywords_.groupBy("kb_id").agg(F.array_join(F.transform(listed, lambda s: s["keyword"]), " ").alias("words"))
    joined = profiles_.join(words, "kb_id", "left")
    return joined.select("kb_id", F.concat_ws(" ", "name", F.coalesce("description", F.lit("")), "summary", F.coalesce("words", F.lit(""))).alias("profile"))


def match_profiles(queries: DataFrame, texts: DataFrame, top_k: int = 3) -> DataFrame:
    """(query_id, query) and (kb_id, profile) -> query_id, kb_id, score (part of the query's tokens in the profile, to four
    places), matched_terms (the first in order), rank; ties by kb_id. Joined on tokens."""
    asked = queries.select("query_id", X.profile_tokens(F.col("query")).alias("tokens"))
    asked = asked.select("query_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    offered = texts.select("kb_id", F.explode(X.profile_tokens(F.col("profile"))).alias("token"))
    both = asked.join(offered, "token").groupBy("query_id", "kb_id", "n").agg(F.sort_array(F.collect_list("token")).alias("terms"))
    both = both.select("query_id", "kb_id", (F.size("terms") / F.col("n")).alias("exact"), F.slice("terms", 1, TERMS).alias("matched_terms"))
    both = ranked(both, ["query_id"], [F.col("exact").desc(), F.col("kb_id")], "rank", top_k)
    return both.select("query_id", "kb_id", F.round("exact", 4).alias("score"), "matched_terms", "rank")


def domains(query: Column) -> Column:
    found = F.filter(F.array(*[F.when(query.rlike(p), F.lit(d)) for d, p in DOMAINS]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(OTHER)))


def intent(query: Column) -> Column:
    return F.when(query.rlike(GREETING), "chitchat").otherwise("retrieval")


def route(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """Each query's knowledge base: the one with most of its tokens, the first by id if none has any; with its intent and
    domains."""
    best = match_profiles(queries, texts, 1).select("query_id", F.col("kb_id").alias("best"))
    first = texts.agg(F.min("kb_id").alias("first"))
    out = queries.join(best, "query_id", "left").crossJoin(F.broadcast(first))  # one row
    return out.select("query_id", F.coalesce("best", "first").alias("kb_id"), intent(F.col("query")).alias("intent"), domains(F.col("query")).alias("domain"))


def merge_candidates(routed: Column, profiled: Column, allowed: Column) -> Column:
    """Routed, then profiled ids among the allowed, without repeats; all the allowed if there is none."""
    both = F.filter(F.array_distinct(F.concat(routed, profiled)), lambda x: F.array_contains(allowed, x))
    return F.when(F.size(both) > 0, both).otherwise(allowed)


def resolve_names(names: DataFrame, kbs: DataFrame) -> DataFrame:
    """(name) -> (name, kb_id): by a knowledge base's exact name, by kb_<n>, or by a name that it contains."""
    exact = kbs.select(F.col("name").alias("n"), F.col("kb_id").alias("exact_id"))
    number = F.regexp_extract("name", r"(?i)kb[_-]?(\d+)", 1)
    rows = names.join(exact, F.col("name") == F.col("n"), "left").withColumn("number", F.nullif(number, F.lit("")).cast("int"))
    known = rows.filter("exact_id is not null or number is not null").select("name", F.coalesce("exact_id", "number").alias("kb_id"))
    rest = rows.filter("exact_id is null and number is null").select("name")
    inside = contained(rest.filter("name is not null").distinct(), "name", "name", kbs, "name").join(kbs.select(F.col("name").alias("pattern"), "kb_id"), "pattern")
    inside = inside.groupBy(F.col("name").alias("n")).agg(F.min("kb_id").alias("kb_id"))
    return known.unionByName(rest.distinct().join(inside, F.col("name") == F.col("n"), "left").select("name", "kb_id"))


def parse_route(answer: Column) -> Column:
    """A model's routing answer as struct(intent, domain, rewritten_query, candidate_kbs): a single domain is a list, an unknown
    intent is retrieval, repeats go."""
    body = X.json_object(answer)
    one = F.get_json_object(body, "$.domain")
    many = F.from_json(one, "array<string>")
    kind = F.get_json_object(body, "$.intent")
    return F.struct(
        F.when(kind.isin("retrieval", "chitchat"), kind).otherwise("retrieval").alias("intent"),
        F.when(F.startswith(one, F.lit("[")), many).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>")).alias("domain"),
        F.get_json_object(body, "$.rewritten_query").alias("rewritten_query"),
        F.array_distinct(F.coalesce(F.from_json(F.get_json_object(body, "$.candidate_kbs"), "array<string>"), F.array().cast("array<string>"))).alias("candidate_kbs"),
    )
