"""DuckDB SQL for the catalogue's queries that SQL can express."""

from __future__ import annotations

from corpusloom.functions import metadata
from corpusloom.functions import text as X
from corpusloom.operators import routing
from corpusloom.plans.catalog import _NAMES
from corpusloom.schemas import ABLATION

QUERY_TERM, PROFILE_TERM = X.QUERY_TERM, X.PROFILE_TERM

#: The mapping of the test tables, as the catalogue has it.
DOCS = """docs as (
    select cast(substr(source, 4) as integer) kb_id, doc_id document_id, 'doc_' || doc_id || '.txt' file_name, 'doc_' || doc_id title, lang department, source doc_type, text, n_chars
    from documents)"""


def distinct_terms(text: str, pattern: str, lower: bool = False) -> str:
    """The first occurrence of each term, in order."""
    found = f"regexp_extract_all({text}, '{pattern}')"
    found = f"list_transform({found}, lambda t: lower(t))" if lower else found
    return f"list_filter({found}, lambda t, i: list_position({found}, t) = i)"


def count_of(text: str, token: str) -> str:
    return f"((length({text}) - length(replace({text}, {token}, ''))) // length({token}))"


LEXICAL = f"""tokens as (
    select item_id query_id, unnest({distinct_terms("text", QUERY_TERM)}) token from benchmark),
lexical as (
    select query_id, doc_id::varchar chunk_id, sum({count_of("text", "token")})::bigint lexical_score
    from tokens join documents on contains(text, token) group by all)"""


def lexical_top(k: int) -> str:
    order = "order by lexical_score desc, chunk_id"
    return LEXICAL + f", lexical_top as (select *, row_number() over (partition by query_id {order}) lexical_rank from lexical qualify lexical_rank <= {k})"


BM25 = f"""terms as (
    select doc_id::varchar chunk_id, unnest(regexp_extract_all(lower(text), '{QUERY_TERM}')) term from documents),
postings as (select chunk_id, term, count(*) tf from terms group by all),
sizes as (select chunk_id, sum(tf) size from postings group by all),
whole as (select count(*) n, avg(size) mean_size from sizes),
asked as (select distinct query_id, term from (select item_id query_id, unnest(regexp_extract_all(lower(text), '{QUERY_TERM}')) term from benchmark)),
freq as (select term, count(*) df from postings group by all),
bm25 as (
    select query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / mean_size))), 9) sparse_score
    from asked join postings using (term) join freq using (term) join sizes using (chunk_id), whole group by all),
bm25_ranked as (select *, row_number() over (partition by query_id order by sparse_score desc, chunk_id) sparse_rank from bm25)"""

EMBED = f"""
    cells as (
        select id, idx, sum(s)::double raw from (
            select id, ('0x' || substr(sha256(token), 1, 8))::bigint % 384 idx, case when ('0x' || substr(sha256(token), 9, 2))::int % 2 = 0 then 1 else -1 end s from (
                select id, unnest(regexp_extract_all(lower(body), '{QUERY_TERM}')) token from bodies)
        ) group by all having sum(s) <> 0),
    units as (select id, idx, raw / sqrt(sum(raw * raw) over (partition by id)) weight from cells)"""

COSINE = """list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: p[1]::double * p[2]::double))
    / (sqrt(list_sum(list_transform(q.embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(v.embedding, lambda x: x::double * x::double))))"""


def dense(where: str = "true", k: int = 5) -> str:
    return f"""scored as (
        select q.vec_id query_id, v.label kb_id, lpad(v.vec_id::varchar, 12, '0') chunk_id, round({COSINE}, 12) dense_score
        from embeddings q join embeddings v on q.vec_id % 100 = 0 and ({where})),
    nearest as (select *, row_number() over (partition by query_id, kb_id order by dense_score desc, chunk_id) dense_rank from scored qualify dense_rank <= {k})"""


LINES = f"""lines as (
    select document_id, file_name, kb_id, title section_path, unnest(ls) as text, unnest(range(len(ls))) seg_no from (
        select *, list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda t: trim(t, ' ' || chr(9) || chr(160))), lambda t: t <> '') ls from docs))"""

CLAUSE_SQL = "^\\s*(第[一二三四五六七八九十百千万0-9]+条|\\d+(\\.\\d+){1,4})"

VERSIONS = f"""{LINES},
    old as (select document_id, seg_no index, sha256(text) content_hash, document_id || '-' || seg_no uuid from lines),
    new as (select document_id, seg_no index, sha256(case when seg_no % 7 = 3 then 'new ' || text else text end) content_hash from lines where seg_no % 5 <> 4)"""



def parents(size: int) -> str:
    """The fold of lines into parents of at most size characters, a step for each line."""
    full = f"f.size + length(l.text) > {size} and not regexp_matches(l.text, '{CLAUSE_SQL}')"
    return f"""{LINES},
        folded as (
            select document_id, kb_id, section_path, seg_no, 0 parent_index, length(text) size, text from lines where seg_no = 0
            union all
            select l.document_id, l.kb_id, l.section_path, l.seg_no, f.parent_index + case when {full} then 1 else 0 end,
                   case when {full} then length(l.text) else f.size + length(l.text) end, l.text
            from folded f join lines l on l.document_id = f.document_id and l.seg_no = f.seg_no + 1),
        grouped as (select document_id, kb_id, section_path, parent_index, string_agg(text, chr(10) || chr(10) order by seg_no) content from folded group by all),
        parents as (select *, sha256('parent::' || kb_id || '::' || document_id || '::' || parent_index || '::' || content) parent_id from grouped)"""


def children(size: int, overlap: int) -> str:
    """The fold of a parent's paragraphs into children, a step for each paragraph."""
    return f"""walk as (
            select document_id, parent_index, parent_id, list_filter(list_transform(regexp_split_to_array(content, '\n{{2,}}|\r\n'), lambda t: trim(t)), lambda t: t <> '') ps,
                   0 i, '' held, 0::bigint used, []::varchar[] kids from parents
            union all
            select document_id, parent_index, parent_id, ps, i + 1, case when big then '' when h <> '' then h || chr(10) || chr(10) || p else p end, case when big then 0 else u + length(p) end,
                   case when big then list_concat(case when h <> '' then list_append(o, h) else o end,
                        list_transform(range((length(p) + {size - 1}) // {size}), lambda k: substr(p, (k * {size} + 1)::int, {size}))) else o end
            from (
                select *, length(p) > 1.5 * {size} big, case when over then right(held, {overlap}) else held end h, case when over then length(right(held, {overlap})) else used end u,
                       case when over then list_append(kids, held) else kids end o
                from (select *, ps[i + 1] p, held <> '' and used + length(ps[i + 1]) > {size} as over from walk where i < len(ps)))),
        packed as (select document_id, parent_index, parent_id, list_filter(case when held <> '' then list_append(kids, held) else kids end, lambda c: trim(c) <> '') kids from walk where i = len(ps)),
        children as (select document_id, parent_index, parent_id, unnest(kids) content, unnest(range(len(kids))) child_index from packed)"""


PROFILES = f"""facts as (
        select kb_id, count(*) document_count, list_sort(list(distinct department)) departments, list_sort(list(distinct doc_type)) doc_types from docs group by all),
    firsts as (select *, row_number() over (partition by kb_id order by document_id) n from docs),
    heads as (
        select kb_id, list(title order by n) filter (n <= 12) titles, string_agg(substr(text, 1, 300), chr(10) order by n) filter (n <= 16) sample from firsts group by all),
    profiles as (
        select kb_id, 'src' || kb_id as name, document_count, departments, titles, sample,
               '知识库名称：src' || kb_id || chr(10) || '描述：无' || chr(10) || '文档数：' || document_count || chr(10) || '部门：' || array_to_string(departments, '、') || chr(10)
               || '文档类型：' || array_to_string(doc_types, '、') || chr(10) || '代表文档：' || array_to_string(titles, '；') || chr(10) || '抽样内容：' || substr(sample, 1, 1200) summary
        from facts join heads using (kb_id)),
    bodies as (select kb_id, name || ' ' || array_to_string(titles, ' ') || ' ' || sample body from profiles),
    words as (select distinct kb_id, body, lower(w) keyword from (select kb_id, body, unnest(regexp_extract_all(body, '{PROFILE_TERM}')) w from bodies)),
    keywords as (select kb_id, keyword, 1::bigint n, row_number() over (partition by kb_id order by keyword) rank from words qualify rank <= 40),
    keyword_texts as (select kb_id, string_agg(keyword, ' ' order by rank) kw from keywords group by all),
    profile_texts as (select kb_id, name || '  ' || summary || ' ' || kw profile from profiles join keyword_texts using (kb_id)),
    offered as (select distinct kb_id, lower(w) token from (select kb_id, unnest(regexp_extract_all(profile, '{PROFILE_TERM}')) w from profile_texts)),
    wanted as (select distinct query_id, token from (select item_id query_id, lower(unnest(regexp_extract_all(text, '{PROFILE_TERM}'))) token from benchmark)),
    matches as (
        select query_id, kb_id, count(*)::double / any_value(n) exact, list_sort(list(token)) terms
        from wanted join offered using (token) join (select query_id, count(*) n from wanted group by all) using (query_id) group by all),
    ranked as (select *, row_number() over (partition by query_id order by exact desc, kb_id) rank from matches)"""

#: DOCS after the changes that the catalogue makes to kept profiles.
CHANGED = DOCS.replace("lang department", "case when doc_id % 3 = 0 then 'confirmed' else lang end department").replace(
    " text, n_chars", " case when doc_id % 3 = 0 then 'Again ' || text else text end as text, n_chars").replace("from documents)", "from documents where doc_id % 10 <> 7 and doc_id % 11 <> 7)")

JUDGED = lexical_top(10) + """, want as (select item_id query_id, list(distinct d.doc_id::varchar) relevant from benchmark b join documents d on contains(d.text, b.text) group by all),
    judged as (
        select b.item_id query_id, coalesce(relevant, []) relevant, coalesce(r.retrieved, []) retrieved from benchmark b
        left join want w on w.query_id = b.item_id left join (select query_id, list(chunk_id order by lexical_rank) retrieved from lexical_top group by all) r on r.query_id = b.item_id)"""

SUPPORT = lexical_top(10) + f""", contexts as (
        select query_id, string_agg(text, chr(10) order by lexical_rank) filter (lexical_rank <= 3) ctx from lexical_top join documents on chunk_id = doc_id::varchar group by all),
    supported as (
        select item_id query_id, text query, ctx is not null has_context, case when ctx is null or len(ts) = 0 then 0.0 else len(list_filter(ts, lambda t: contains(ctx, t)))::double / len(ts) end support
        from (select *, {distinct_terms("text", QUERY_TERM)} ts from benchmark) b left join contexts on query_id = item_id)"""


def _rules(text: str, rules: tuple, otherwise: str) -> str:
    cases = " ".join("when " + " or ".join(f"contains({text}, '{w}')" for w in words) + f" then '{name}'" for name, words in rules)
    return f"case {cases} else {otherwise} end"


_META = "(file_name || chr(10) || substr(text, 1, 3000))"
_LOW = lambda c: f"greatest(0.0, least(1.0, {c}))"

def corpus(where: str = "true") -> str:
    """Chunks of the documents, and each query's scores of all of them."""
    return f"""all_{DOCS}, docs as (select * from all_docs where {where}), {parents(1000)}, {children(500, 120)},
        chunks as (select document_id, kb_id, parent_id, c.content, sha256('child::' || parent_id || '::' || child_index || '::' || c.content) chunk_id
            from children c join (select document_id, kb_id, parent_id from parents) using (document_id, parent_id)),
        bodies as (select 'q' || item_id id, text body from benchmark union all select chunk_id, content from chunks), {EMBED},
        dots as (select q.id q, d.id d, sum(q.weight * d.weight) s from units q join units d using (idx) where q.id[1] = 'q' and d.id[1] <> 'q' group by all),
        ids as (select distinct id from units),
        cosines as (select substr(q.id, 2)::bigint query_id, d.id chunk_id, round(coalesce(s, 0), 12) + 0.0 dense_score
            from ids q join ids d on q.id[1] = 'q' and d.id[1] <> 'q' left join dots on dots.q = q.id and dots.d = d.id),
        tokens as (select item_id query_id, unnest({distinct_terms("text", QUERY_TERM)}) token from benchmark),
        lexical as (select query_id, kb_id, chunk_id, sum({count_of("content", "token")}) score from tokens join chunks on contains(content, token) group by all),
        routes as (with {PROFILES} select item_id query_id, coalesce(kb_id, (select min(kb_id) from profiles)) kb_id from benchmark left join ranked on query_id = item_id and rank = 1)"""


#: Scores of all chunks of corpus() by BM25, and by learned sparse vectors of one and the logarithm of a term's count.
CHUNK_BM25 = f"""terms as (select kb_id, chunk_id, unnest(regexp_extract_all(lower(content), '{QUERY_TERM}')) term from chunks),
    postings as (select kb_id, chunk_id, term, count(*) tf from terms group by all),
    sizes as (select chunk_id, sum(tf) size from postings group by all),
    whole as (select count(*) n, avg(size) mean_size from sizes),
    asked as (select distinct item_id query_id, unnest(regexp_extract_all(lower(text), '{QUERY_TERM}')) term from benchmark),
    freq as (select term, count(*) df from postings group by all),
    bm25 as (
        select query_id, kb_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / mean_size))), 9) score
        from asked join postings using (term) join freq using (term) join sizes using (chunk_id), whole group by all)"""
CHUNK_LEARNED = f"""counted as (
        select id, term, 1 + ln(count(*)) weight from (
            select 'q' || item_id id, unnest(regexp_extract_all(lower(text), '{QUERY_TERM}')) term from benchmark
            union all select chunk_id, unnest(regexp_extract_all(lower(content), '{QUERY_TERM}')) from chunks) group by all),
    learned as (
        select substr(q.id, 2)::bigint query_id, kb_id, chunk_id, round(sum(q.weight * d.weight), 9) score
        from counted q join counted d on q.term = d.term and q.id[1] = 'q' join chunks on d.id = chunk_id group by all)"""


def results(p: str, hybrid: bool, rerank: bool, router: bool, candidates: int, words: str = "lexical") -> str:
    """{p}_out: what one configuration retrieves for each query from corpus(); words: where the scores that are fused are."""
    sparse = "coalesce(sparse_score, 0)" if words != "lexical" else "0"
    mine = "join routes using (query_id, kb_id)" if router else ""
    return f"""{p}_near as (
            select *, row_number() over (partition by query_id order by kb_id, dense_rank) pos from (
                select query_id, kb_id, chunk_id, dense_score, row_number() over (partition by query_id, kb_id order by dense_score desc, chunk_id) dense_rank
                from cosines join chunks using (chunk_id) qualify dense_rank <= {candidates}) {mine}),
        {p}_words as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) pos, score sparse_score from {words} {mine} qualify pos <= {candidates}),
        {p}_lists as (select query_id, chunk_id, pos, 0 list_no from {p}_near union all select query_id, chunk_id, pos, 1 from {p}_words where {hybrid}),
        {p}_fused as (select query_id, chunk_id, round(sum(1.0::double / (60 + pos)), 12) rrf, min(list_no * 1000000 + pos) first from {p}_lists group by all),
        {p}_rows as (
            select f.query_id, chunk_id, case when {hybrid} then rrf end rrf, dense_score, w.score sparse_score, content, parent_id, document_id,
                   row_number() over (partition by f.query_id order by case when {hybrid} then rrf end desc, first, chunk_id) in_rank, count(*) over (partition by f.query_id) n,
                   {distinct_terms("text", QUERY_TERM, True)} ts, lower(content) || chr(10) body
            from {p}_fused f left join {p}_near using (query_id, chunk_id) left join (select query_id, chunk_id, score from {words}) w using (query_id, chunk_id) join chunks using (chunk_id) join benchmark on item_id = f.query_id),
        {p}_scored as (
            select *, case when {rerank} and len(ts) > 0 then round(len(list_filter(ts, lambda t: contains(body, t))) * 2.0::double
                + least(coalesce(list_sum(list_transform(ts, lambda t: {count_of('body', 't')})), 0), 20) * 0.1::double + (coalesce(rrf, 0) * 20.0::double + coalesce(dense_score, 0) + {sparse}), 9) end s from {p}_rows),
        {p}_ranked as (
            select *, case when n > 1 then s end rerank, row_number() over (partition by query_id order by s desc nulls last, in_rank) rank from {p}_scored qualify not {rerank} or rank <= {max(candidates, 5)}),
        {p}_parents as (
            select query_id, parent_id, min(rank) best, arg_min(document_id, rank) document_id, arg_min(coalesce(rerank, -1), rank) rerank, arg_min(coalesce(rrf, -1), rank) rrf, arg_min(coalesce(dense_score, -9), rank) dense,
                   row_number() over (partition by query_id order by min(rank), parent_id) parent_rank from {p}_ranked group by query_id, parent_id qualify parent_rank <= 5),
        {p}_found as (
            select query_id, list(parent_id order by parent_rank) parent_ids, list(document_id order by parent_rank) docs, string_agg(content, chr(10) order by parent_rank) filter (parent_rank <= 3) ctx,
                   arg_min(rerank, parent_rank) rerank, arg_min(rrf, parent_rank) rrf, arg_min(dense, parent_rank) dense from {p}_parents join (select parent_id, content from parents) using (parent_id) group by 1),
        {p}_out as (
            select item_id query_id, coalesce(array_to_string(parent_ids, ','), '') parent_ids, coalesce(list_filter(docs, lambda d, i: list_position(docs, d) = i), []) document_ids,
                   case when parent_ids is null then 0.0 when rerank <> -1 then {_LOW('rerank')} when rrf <> -1 then {_LOW('rrf * 60')}
                        when dense <> -9 then {_LOW('case when dense between 0 and 1 then dense else 1.0::double / (1.0 + greatest(dense, 0.0)) end')} else 0.0 end confidence,
                   case when ctx is null or len(ts) = 0 then 0.0 else len(list_filter(ts, lambda t: contains(ctx, t)))::double / len(ts) end support
            from (select *, {distinct_terms("text", QUERY_TERM)} ts from benchmark) b left join {p}_found f on f.query_id = item_id)"""


REASON = """case when parent_ids = '' then 'no_parent_context' when confidence < 0.2 then format('confidence_below_threshold:{:.4f}<0.2000', confidence::double)
    when support < 0.18 then format('query_support_below_threshold:{:.4f}<0.1800', support::double) end"""

_CONFIGS = {c.name: results(c.name, c.retriever != "dense", c.rerank, c.router, c.candidates) for c in ABLATION}
_METRICS = f"""want as (select item_id query_id, list(distinct d.doc_id) relevant from benchmark b join documents d on contains(d.text, b.text) group by all),
    answers as ({" union all ".join(f"select '{c.name}' config, query_id, document_ids got, {REASON if c.refusal else 'null'} reason from {c.name}_out" for c in ABLATION)}),
    judged as (
        select config, relevant is not null good, reason is not null refused,
               case when relevant is null then 0.0 else len(list_intersect(got[1:5], relevant))::double / len(relevant) end recall,
               coalesce(1.0::double / list_min(list_filter(list_transform(got, lambda x, i: case when list_contains(relevant, x) then i end), lambda x: x is not null)), 0.0) rr,
               case when relevant is null then 0.0 else coalesce(list_sum(list_transform(got[1:10], lambda x, i: case when list_contains(relevant, x) then 1.0::double / log2(i + 1) else 0.0 end)), 0.0)
                   / list_sum(list_transform(range(1, least(len(relevant), 10) + 1), lambda i: 1.0::double / log2(i + 1))) end ndcg
        from answers left join want using (query_id))"""

ORACLE: dict[str, str] = {
    "retrieval_pipeline": f"""with recursive {corpus()}, {_CONFIGS["routed"]}
        select query_id, 'retrieval' intent, parent_ids, round(confidence, 6) confidence, round(support, 6) support, {REASON} refusal_reason from routed_out""",
    "trial_retrieval": f"""with recursive {corpus("kb_id = 3")}, {results("trial", True, True, False, 20)} select query_id, parent_ids, round(confidence, 6) confidence from trial_out""",
    "retrieval_bm25": f"""with recursive {corpus()}, {CHUNK_BM25}, {results("b", True, True, False, 10, "bm25")}
        select query_id, parent_ids, round(confidence, 6) confidence, round(support, 6) support from b_out""",
    "retrieval_learned": f"""with recursive {corpus()}, {CHUNK_LEARNED}, {results("s", True, False, False, 10, "learned")}
        select query_id, parent_ids, round(confidence, 6) confidence, round(support, 6) support from s_out""",
    "ablation_report": f"""with recursive {corpus()}, {", ".join(_CONFIGS.values())}, {_METRICS}
        select config, round(coalesce(avg(recall) filter (good), 0), 6) recall_at_5, round(coalesce(avg(rr) filter (good), 0), 6) mrr, round(coalesce(avg(ndcg) filter (good), 0), 6) ndcg_at_10,
               round(coalesce(avg(refused::int) filter (not good), 0), 6) negative_refusal_rate, round(coalesce(avg(refused::int) filter (good), 0), 6) false_refusal_rate from judged group by config""",
    "filter_pushdown": "select doc_id, lang from documents where lang in ('de', 'it''s') and n_chars >= 500 and n_chars < 5000",
    "bm25_analyzer": "with " + BM25.replace(QUERY_TERM, "[a-z0-9]+") + """
        select query_id, cast(substr(source, 4) as integer) kb_id, chunk_id, round(sparse_score, 6) sparse_score from bm25 join documents on chunk_id = doc_id::varchar
        qualify row_number() over (partition by query_id, kb_id order by bm25.sparse_score desc, chunk_id) <= 5""",
    "chunk_preview": f"""with {DOCS}, {LINES},
        d as (select document_id, any_value(file_name) file_name, substr(string_agg(text, chr(10) order by seg_no), 1, 6000) as text from lines group by 1)
        select document_id, text as sample, {_rules(_META, metadata.DOC_TYPES, f"'{metadata.OTHER}'")} doc_type, 'doc_' || document_id title from d""",
    "trace_payload": """select doc_id document_id, '1998-01-02T03:04:05' created_at,
        to_json({'file_name': 'doc_' || doc_id || '.txt', 'parts': [{'body': substr(text, 1, 2000), 'tags': [source, lang]}]})::varchar payload from documents""",
    "scalar_variables": """with v as (select c_custkey as owner from customer order by c_acctbal desc, c_custkey limit 1)
        select o_orderkey, o_custkey, owner from orders, v where o_custkey <= owner""",
    "first_lookup": "select n_nationkey, n_name from nation where n_regionkey = 1 order by n_name limit 1",
    "dashboard_counts": """select 'kbs' as name, count(distinct source) n from documents union all select 'documents', count(*) from documents
        union all select 'questions', count(*) from benchmark union all select 'chats', count(distinct coalesce(conv_id, -99)) from conversations""",
    "task_states": """select l_orderkey, count(*) n_tasks, bool_and(l_linestatus = 'F') all_done, bool_or(l_linestatus = 'O') any_failed from lineitem group by 1""",
    "task_uploads": """select o_orderkey task_id, o_orderstatus status, case when c_custkey % 2 = 0 then c_name end file_name from orders left join customer on o_custkey = c_custkey""",
    "score_format": """select o_orderkey, printf('%.3f', round((o_orderkey % 97) / 97.0::double, 3)) score, printf('%.1f', round((o_orderkey % 97) / 97.0::double * 100, 1)) || '%' share,
        printf('%.2f', round(o_orderkey * 1000 / 1048576.0::double, 2)) || ' MB' size from orders""",
    "iso_times": """select event_id, case when event_id % 5 <> 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when microsecond(ts) % 1000000 = 0 then '' else '.' || strftime(ts, '%f') end end as at
        from events""",
    "scan_filter_scalar": f"with {DOCS} select document_id, file_name from docs where department = 'fr' and kb_id = 3",
    "filter_membership_null": f"with {DOCS} select document_id, nullif(department, 'en') department from docs where department in ('de', 'en')",
    "filter_range_ops": f"with {DOCS} select document_id, n_chars from docs where n_chars >= 500 and n_chars < 1500 and n_chars <> 700",
    "permission_filter": f"with {DOCS} select document_id, department from docs where department in ('es', 'de')",
    "superuser_bypass": f"with {DOCS} select 'superuser' who, document_id from docs where department = 'fr'",
    "ttl_filter": "select o_orderkey from orders where o_orderdate < timestamp '1997-12-31 00:00:00'",
    "tokenize_query": f"select item_id query_id, array_to_string({distinct_terms('text', QUERY_TERM)}, ' ') tokens from benchmark",
    "tokenize_profile": f"select item_id query_id, array_to_string({distinct_terms('text', PROFILE_TERM, True)}, ' ') tokens from benchmark",
    "tokenize_rerank": f"select item_id query_id, array_to_string({distinct_terms('text', QUERY_TERM, True)}, ' ') tokens from benchmark",
    "segment_lines": f"with {DOCS}, {LINES} select document_id, seg_no, text, section_path from lines",
    "child_hard_split": """select doc_id document_id, k piece_no, substr(text, (k * 350 + 1)::int, 350) piece
        from (select doc_id, text, unnest(range((length(text) + 349) // 350)) k from documents)""",
    "stable_ids": f"""with {DOCS} select document_id, sha256('parent::' || kb_id || '::' || document_id || '::0::' || text) stable_id,
        sha256(kb_id || ':' || file_name || ':' || sha256(text)) chunk_key from docs""",
    "content_hash": f"with {DOCS} select document_id, sha256(text) content_hash from docs",
    "file_names": f"with {DOCS} select document_id, title stem, 'txt' extension, 'text/plain' mime, 'ab' || file_name clean from docs",
    "clause_starts": """with t as (select doc_id document_id, (doc_id % 7) || case when doc_id % 3 = 0 then '.' else ' ' end || doc_id || ' ' || text s from documents)
        select document_id, nullif(regexp_extract(s, '^\\s*(\\d+(?:\\.\\d+){1,4})', 1), '') clause,
        'a > b' || coalesce(' > ' || nullif(regexp_extract(s, '^\\s*(\\d+(?:\\.\\d+){1,4})', 1), ''), '') section_path from t""",
    "parent_chunks": f"with recursive {DOCS}, {parents(1200)} select document_id, parent_index, content, section_path, parent_id from parents",
    "child_chunks": f"""with recursive {DOCS}, {parents(1000)}, {children(500, 120)} select document_id, parent_index, child_index, content,
        sha256('child::' || parent_id || '::' || child_index || '::' || content) chunk_id from children""",
    "preview_chunks": f"""with recursive {DOCS}, {parents(1200).replace("'parent::' || kb_id || '::' || document_id || '::'", "'parent::0::0::'")}, {children(350, 60)}
        select document_id upload, 0::bigint document_id, parent_index, child_index::int child_index, sha256(content) content_hash, sha256('child::' || parent_id || '::' || child_index || '::' || content) chunk_id from children""",
    "heading_paths": f"""with recursive {DOCS}, {LINES},
        walk as (
            select document_id, -1 seg_no, any_value(section_path) title, [any_value(section_path)] stack, ''::varchar as text from lines group by 1
            union all
            select w.document_id, l.seg_no, title, case when l.seg_no % 3 = 0 then list_append(stack[1:(length(l.text) % 6 + 1)], l.text) else stack end, l.text
            from walk w join lines l on l.document_id = w.document_id and l.seg_no = w.seg_no + 1)
        select document_id, seg_no::int seg_no, concat_ws(' > ', array_to_string(stack, ' > '), nullif(regexp_extract(text, '{CLAUSE_SQL}', 1), '')) section_path from walk where seg_no >= 0""",
    "chunk_diff_banded": f"""with recursive {DOCS}, {VERSIONS},
        olds as (select document_id, content_hash, list(struct_pack(i := index, u := uuid) order by index) os from old group by all),
        news as (select document_id, content_hash, list(index order by index) ns from new group by all),
        walk as (
            select document_id, content_hash, coalesce(os, []) os, coalesce(ns, []) ns, 1 i, 1 j, null::varchar as action, null::varchar uuid, null::bigint as index
            from olds full join news using (document_id, content_hash)
            union all
            select document_id, content_hash, os, ns, i + (step <> 'create')::int, j + (step <> 'delete')::int, step, case when step <> 'create' then os[i].u end, case when step <> 'delete' then ns[j] end
            from (select *, case when i <= len(os) and j <= len(ns) and abs(os[i].i - ns[j]) <= 10 then 'update'
                                 when j > len(ns) or (i <= len(os) and os[i].i < ns[j]) then 'delete' else 'create' end step from walk where i <= len(os) or j <= len(ns)))
        select action, uuid, coalesce(index, -1) as index, document_id, content_hash from walk where action is not null""",
    "page_text": """with b as (select *, regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g') bare from pages)
        select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g')) title,
               trim(regexp_replace(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) heading,
               trim(regexp_replace(regexp_replace(bare, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as text from b""",
    "chunk_diff_add": f"with {DOCS}, {VERSIONS} select * from new where not exists (select 1 from old where old.document_id = new.document_id and old.content_hash = new.content_hash)",
    "chunk_diff_delete": f"with {DOCS}, {VERSIONS} select * from old where not exists (select 1 from new where old.document_id = new.document_id and old.content_hash = new.content_hash)",
    "dup_probe": """with d as (select doc_id, source, 'doc_' || doc_id || '.txt' file_name, sha256(text) h from documents),
        u as (select *, case when doc_id % 3 = 0 then 'copy_' || file_name else file_name end up from d)
        select doc_id document_id, up file_name from u where not exists (select 1 from d where d.doc_id % 2 = 0 and d.source = u.source and d.h = u.h and d.file_name = u.up)""",
    "exact_dup_groups": "select sha256(text) content_hash, count(*) n, min(doc_id) first_id from documents group by text having count(*) > 1",
    "upsert_documents": "select doc_id document_id, 'doc_' || doc_id || '.txt' file_name, case when doc_id % 8 = 0 then 3 when doc_id % 4 = 0 then 2 else 1 end as version from documents",
    "insert_not_exists": "select n_nationkey, n_name from nation",
    "delete_in": "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)",
    "update_where": "select c_custkey, case when c_acctbal < 0 then 'OVERDUE' else c_mktsegment end c_mktsegment, case when c_acctbal < 0 then 0.0 else c_acctbal end::double c_acctbal from customer",
    "hash_embedding": f"with bodies as (select item_id id, text body from benchmark), {EMBED} select id query_id, idx, round(weight, 6) weight from units",
    "hash_cosine_topk": f"""with bodies as (select 'q' || item_id id, text body from benchmark union all select 'd' || doc_id, text from documents), {EMBED},
        dots as (select q.id q, d.id d, sum(q.weight * d.weight) s from units q join units d using (idx) where q.id[1] = 'q' and d.id[1] = 'd' group by all),
        ids as (select distinct id from units),
        scored as (select substr(q.id, 2)::bigint query_id, substr(d.id, 2) chunk_id, round(coalesce(s, 0), 12) + 0.0 dense_score
            from ids q join ids d on q.id[1] = 'q' and d.id[1] = 'd' left join dots on dots.q = q.id and dots.d = d.id),
        placed as (select query_id, cast(substr(source, 4) as integer) kb_id, chunk_id, dense_score from scored join documents on chunk_id = doc_id::varchar)
        select * replace (round(dense_score, 6) as dense_score), row_number() over (partition by query_id, kb_id order by placed.dense_score desc, chunk_id) dense_rank from placed qualify dense_rank <= 3""",
    "direct_kb_query": f"""with bodies as (select 'q' || item_id id, text body from benchmark union all select 'd' || doc_id, text from documents where source = 'src3'), {EMBED},
        dots as (select q.id q, d.id d, sum(q.weight * d.weight) s from units q join units d using (idx) where q.id[1] = 'q' and d.id[1] = 'd' group by all),
        ids as (select distinct id from units),
        scored as (select substr(q.id, 2)::bigint query_id, substr(d.id, 2) chunk_id, round(coalesce(s, 0), 12) + 0.0 dense_score
            from ids q join ids d on q.id[1] = 'q' and d.id[1] = 'd' left join dots on dots.q = q.id and dots.d = d.id)
        select * replace (round(dense_score, 6) as dense_score), row_number() over (partition by query_id order by scored.dense_score desc, chunk_id) dense_rank from scored qualify dense_rank <= 3""",
    "citation_lookup": f"with {DOCS} select kb_id, document_id, 'src' || kb_id kb_name, file_name from docs where document_id % 3 <> 0",
    "metadata_confirm": f"with {DOCS}, {LINES} select l.document_id, seg_no, case when l.document_id % 4 = 2 then '后勤' else department end department from lines l join docs using (document_id)",
    "reindex_documents": f"with {DOCS}, {LINES} select document_id, seg_no, text from lines where document_id % 2 = 1 or seg_no = 0",
    "dense_topk_per_kb": f"with {dense()} select * replace (round(dense_score, 6) as dense_score), row_number() over (partition by query_id order by kb_id, dense_rank) pos from nearest",
    "vector_index_topk": f"with {dense()} select * replace (round(dense_score, 6) as dense_score) from nearest",
    "vector_index_filtered": """with v as (
            select c_custkey, lpad(c_custkey::varchar, 12, '0') chunk_id, c_mktsegment segment, [(c_acctbal / 1000)::double, (c_nationkey - 12)::double, (c_custkey % 97 - 48)::double] e from customer),
        s as (
            select q.c_custkey query_id, 1 kb_id, v.chunk_id, round(list_inner_product(q.e, v.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e))), 12) dense_score
            from v q join v on q.c_custkey % 100 = 0 and v.c_custkey % 10 <> 3 and v.segment in ('BUILDING', 'AUTOMOBILE'))
        select * replace (round(dense_score, 6) as dense_score), row_number() over (partition by query_id order by s.dense_score desc, chunk_id) dense_rank from s qualify dense_rank <= 4""",
    "store_changes": """select label kb_id, lpad(vec_id::varchar, 12, '0') chunk_id, case when vec_id % 3 = 0 then 'second' else 'first' end as content
        from embeddings where vec_id % 7 <> 0 and not (label = 2 and vec_id % 3 <> 0)""",
    "ingested_parents": f"""with recursive all_docs as (select * from documents where doc_id % 10 <> 7 or doc_id % 4 = 0),
        {DOCS.replace('from documents', 'from (select * replace (case when doc_id % 4 = 0 then \'Again. \' || substr(text, 1, 600) else text end as text) from all_docs)')}, {parents(1200)}
        select document_id, parent_index, content, parent_id, true has_children from parents""",
    "ingestion_states": """with e as (
            select user_id document_id, case event_type when 'signup' then 'submitted' when 'view' then 'parsing' when 'click' then 'chunking' when 'purchase' then 'indexed' else 'error' end stage,
                   ts "at", props message, event_id o from events),
        firsts as (select document_id, coalesce(max(("at", o)) filter (stage = 'submitted'), min(("at", o))) since from e group by 1),
        rows as (select e.* from e join firsts using (document_id) where ("at", o) >= since),
        l as (
            select document_id, arg_max(stage, ("at", o)) stage, max("at") "at", count(*) filter (stage = 'error') errors, count(*) filter (stage = 'indexed') indexed,
                   arg_max(stage, ("at", o)) filter (stage <> 'error') reached, arg_max(message, ("at", o)) filter (stage = 'error') said from rows group by 1),
        t as (select *, case when indexed > 0 then 'indexed' when errors > 1 or "at" < (select max(ts) from events) - interval 36 hours then 'failed'
                             when stage = 'error' then 'retrying' else stage end state from l)
        select document_id, state, errors::int errors, "at",
               (case when state = 'indexed' then 100 when state = 'retrying' then 0 else case reached when 'parsing' then 30 when 'chunking' then 45 when 'indexed' then 100 else 0 end end)::int progress,
               case when state in ('failed', 'retrying') then case when errors > 1 or state = 'retrying' then said else 'stuck in ' || stage end end message
        from t""",
    "dense_topk_filtered": f"with {dense('v.vec_id >= 100 and v.label in (1, 2, 3)')} select * replace (round(dense_score, 6) as dense_score) from nearest",
    "dense_postfilter": f"with {dense()} select * replace (round(dense_score, 6) as dense_score) from nearest where chunk_id::bigint >= 100",
    "lexical_topk": f"with {lexical_top(20)} select * from lexical_top",
    "bm25_topk": f"with {BM25} select query_id, chunk_id, round(sparse_score, 6) sparse_score from bm25_ranked where sparse_rank <= 20",
    "learned_sparse": """with cells as (select vec_id, unnest(embedding)::double weight, unnest(range(64)) term from embeddings)
        , scores as (select q.vec_id query_id, lpad(c.vec_id::varchar, 12, '0') chunk_id, round(sum(q.weight * c.weight), 9) sparse_score from cells q join cells c using (term)
        where q.vec_id % 100 = 0 and q.weight > 0 and c.weight > 0 group by all)
        select * replace (round(sparse_score, 6) as sparse_score), row_number() over (partition by query_id order by scores.sparse_score desc, chunk_id) sparse_rank from scores qualify sparse_rank <= 20""",
    "rrf_fusion": f"""with {lexical_top(10)}, {BM25},
        lists as (select query_id, chunk_id, lexical_rank pos, 0 list_no from lexical_top union all select query_id, chunk_id, sparse_rank, 1 from bm25_ranked where sparse_rank <= 10),
        fused as (select query_id, chunk_id, round(sum(1.0::double / (60 + pos)), 12) s, min((list_no, pos)) first from lists group by all)
        select query_id, chunk_id, round(s, 9) rrf_score, row_number() over (partition by query_id order by s desc, first, chunk_id) rrf_rank from fused""",
    "rerank_local": f"""with {lexical_top(10)},
        rows as (select query_id, chunk_id, lexical_rank, lower(d.text) || chr(10) body, {distinct_terms('b.text', QUERY_TERM, True)} ts
            from lexical_top join documents d on chunk_id = d.doc_id::varchar join benchmark b on query_id = b.item_id),
        scored as (select *, round(len(list_filter(ts, lambda t: contains(body, t))) * 2.0::double
            + least(list_sum(list_transform(ts, lambda t: {count_of('body', 't')})), 20) * 0.1::double + 20.0::double / (60 + lexical_rank), 9) s from rows)
        select query_id, chunk_id, round(s, 6) rerank_score, row_number() over (partition by query_id order by s desc, lexical_rank) rerank_rank from scored qualify rerank_rank <= 4""",
    "parent_dedup": f"""with {lexical_top(10)},
        g as (select query_id, 'p' || (chunk_id::bigint // 10) parent_id, min(lexical_rank) best_rank, list(chunk_id order by lexical_rank) kids,
                     arg_min(text, lexical_rank) child, arg_min(lexical_score, lexical_rank) score
              from lexical_top join documents on chunk_id = doc_id::varchar group by all),
        r as (select *, row_number() over (partition by query_id order by best_rank, parent_id) parent_rank from g qualify parent_rank <= 5),
        stored as (select 'p' || (doc_id // 10) parent_id, 'stored doc_' || doc_id || '.txt' content from documents where doc_id % 20 = 0)
        select query_id, parent_id, parent_rank, best_rank, score, array_to_string(kids, ',') child_ids, array_to_string(kids[1:5], ',') matched_children, coalesce(content, child) content
        from r left join stored using (parent_id)""",
    "confidence": f"""select event_id, round(case when event_id % 11 = 0 then 0.0
            when event_id % 6 = 0 then {_LOW('value / 25.0::double')} when event_id % 6 = 1 then {_LOW('(value / 25.0::double) / 60.0::double * 60')}
            when event_id % 6 in (2, 3) then {_LOW('0.35::double + least(value / 25.0::double, 5.0) / 10.0::double')}
            when event_id % 6 = 4 then {_LOW('case when value / 25.0::double between 0 and 1 then value / 25.0::double else 1.0::double / (1.0 + greatest(value / 25.0::double, 0.0)) end')}
            else 0.0 end, 6) confidence from events""",
    "query_support": f"with {SUPPORT} select query_id, round(support, 6) support from supported",
    "refusal_reason": f"""with {SUPPORT} select query_id, case when not has_context then 'no_parent_context'
        when query_id % 10 < 2 then format('confidence_below_threshold:{{:.4f}}<0.2000', (query_id % 10) / 10.0::double)
        when query_id % 4 = 0 then 'explicit_refusal_trigger'
        when round(support, 6) < 0.9 then format('query_support_below_threshold:{{:.4f}}<0.9000', round(support, 6)::double) end reason from supported""",
    "kb_profile": f"with {DOCS}, {PROFILES} select kb_id, document_count, array_to_string(departments, ',') departments, array_to_string(titles, ',') titles, summary from profiles",
    "kb_keywords": f"with {DOCS}, {PROFILES} select * from keywords",
    "kb_keywords_by_frequency": f"""with {DOCS}, {PROFILES} select kb_id, keyword, {count_of('lower(body)', 'keyword')} n,
        row_number() over (partition by kb_id order by {count_of('lower(body)', 'keyword')} desc, keyword) rank from words qualify rank <= 40""",
    "kept_profile": f"""with {CHANGED}, {PROFILES} select kb_id, document_count, array_to_string(departments, ',') departments, array_to_string(titles, ',') titles, summary from profiles
        union all select distinct cast(substr(source, 4) as integer) kb_id, 0, '', '', '知识库名称：' || source || chr(10) || '描述：无' || chr(10) || '文档数：0' || chr(10) || '部门：未标注' || chr(10)
            || '文档类型：未标注' || chr(10) || '代表文档：暂无文档' from documents where cast(substr(source, 4) as integer) not in (select kb_id from docs)""",
    "kept_keywords": f"""with {CHANGED}, bodies as (select kb_id, title body from docs union all select kb_id, text from docs),
        words as (select kb_id, unnest(list_distinct(list_transform(regexp_extract_all(body, '{PROFILE_TERM}'), lambda w: lower(w)))) keyword from bodies)
        select kb_id, keyword, count(*) n, row_number() over (partition by kb_id order by count(*) desc, keyword) rank
        from words where length(keyword) >= 2 group by kb_id, keyword qualify rank <= 40""",
    "profile_match": f"with {DOCS}, {PROFILES} select query_id, kb_id, round(exact, 4) score, array_to_string(terms[1:12], ',') matched_terms, rank from ranked where rank <= 3",
    "route_heuristic": f"""with {DOCS}, {PROFILES} select item_id query_id, coalesce(kb_id, (select min(kb_id) from profiles)) kb_id,
        'retrieval' intent, '{routing.OTHER}' as domain from benchmark left join ranked on query_id = item_id and rank = 1""",
    "merge_candidates": """with m as (select item_id query_id, list_filter([item_id % 7, item_id % 5, item_id % 5, item_id % 3], lambda x: x in (1, 2, 3)) xs from benchmark)
        select query_id, array_to_string(case when len(xs) = 0 then [1, 2, 3] else list_filter(xs, lambda x, i: list_position(xs, x) = i) end, ',') kb_ids from m""",
    "resolve_names": """with n as (select ['src', 'kb_', 'about src'][(id % 3 + 1)::int] || id as name, id from range(30) t(id)),
        k as (select distinct source, cast(substr(source, 4) as integer) kb_id from documents)
        select name, coalesce((select kb_id from k where source = name), nullif(regexp_extract(name, 'kb_(\\d+)', 1), '')::int, (select min(kb_id) from k where contains(name, source))) kb_id from n""",
    "relevance": "select item_id, doc_id document_id from benchmark b join documents d on contains(d.text, b.text)",
    "recall_at_5": f"with {JUDGED} select query_id, round(case when len(relevant) = 0 then 0.0 else len(list_intersect(retrieved[1:5], relevant))::double / len(relevant) end, 6) recall from judged",
    "mrr": f"""with {JUDGED} select query_id, round(coalesce(1.0::double / list_min(list_filter(list_transform(retrieved, lambda x, i: case when list_contains(relevant, x) then i end),
        lambda x: x is not null)), 0.0), 6) rr from judged""",
    "ndcg_at_10": f"""with {JUDGED} select query_id, round(case when len(relevant) = 0 then 0.0 else
        coalesce(list_sum(list_transform(retrieved[1:10], lambda x, i: case when list_contains(relevant, x) then 1.0::double / log2(i + 1) else 0.0 end)), 0.0)
        / list_sum(list_transform(range(1, least(len(relevant), 10) + 1), lambda i: 1.0::double / log2(i + 1))) end, 6) ndcg from judged""",
    "p95_latency": "select event_type config, quantile_disc(value, 0.95) p95_latency_ms, count(*) n from events group by all",
    "exact_percentiles": " union all ".join(f"select event_type, quantile_disc(value, {p}) as value, count(*) n, {p}::double p from events group by event_type" for p in (0.05, 0.5, 0.95))
    + " union all select l_returnflag, quantile_disc(l_quantity::double, 0.9), count(*), 0.9::double from lineitem group by 1",
    "page_zoned": "select o_orderdate, o_orderkey, o_custkey from orders order by o_orderdate, o_orderkey limit 40 offset 1000",
    "evaluation_report": """with e as (select event_type config, event_id % 3 > 0 a, event_id % 3 > 0 and event_id % 5 > 0 g, user_id u, value from events)
        select config, round(coalesce(avg((u % 4) / 4.0::double) filter (g), 0), 6) recall_at_5, round(coalesce(avg((u % 8) / 8.0::double) filter (g), 0), 6) mrr,
               round(coalesce(avg((u % 16) / 16.0::double) filter (g), 0), 6) ndcg_at_10, quantile_disc(value, 0.95) p95_latency_ms,
               round(coalesce(avg((u % 2 = 0)::int) filter (not a), 0), 6) negative_refusal_rate, round(coalesce(avg((u % 2 = 0)::int) filter (g), 0), 6) false_refusal_rate
        from e group by all""",
    "dataset_summary": """with m as (select item_id % 4 <> 0 a, item_id % 4 = 0 or (item_id % 5 <> 0 and item_id % 6 <> 0) l from benchmark)
        select count(*) query_count, count_if(a)::bigint answerable_query_count, count_if(not a)::bigint negative_query_count, count_if(l)::bigint labeled_query_count,
               count_if(not l)::bigint unlabeled_query_count, count_if(a and l)::bigint labeled_answerable_query_count, count_if(l) / count(*) label_coverage, count_if(a and l) / count_if(a) answerable_label_coverage from m""",
    "label_counts": "select quality as value, count(*) n, round(count(*)::double / sum(count(*)) over (), 6) as share from labels group by all",
    "trace_latest": "select event_id, event_type, value from events where user_id = 7 order by event_id desc limit 50",
    "trace_snapshot": f"with {lexical_top(10)} select query_id, chunk_id, lexical_rank rank, lexical_score, substr(text, 1, 240) preview from lexical_top join documents on chunk_id = doc_id::varchar",
    "trace_truncated": "select doc_id document_id, substr(text, 1, 2000) cut, least(80, len(string_split(text, ' '))) n_items from documents",
    "page_offset": "select doc_id document_id, 'doc_' || doc_id || '.txt' file_name from documents order by doc_id limit 25 offset 20",
    "chat_history_last6": """select conv_id, string_agg(concat_ws(': ', role, text), chr(10) order by turn) turns from (
        select *, row_number() over (partition by conv_id order by turn desc) r from conversations) where r <= 6 group by all""",
    "doc_kb_join": "select doc_id document_id, source as name from documents where cast(substr(source, 4) as integer) % 2 = 0",
    "kb_docs_left": f"""with {DOCS}, k as (select distinct kb_id from docs union all select 999)
        select k.kb_id, coalesce(string_agg(document_id::varchar, ',' order by document_id), '') docs from k left join docs d on d.kb_id = k.kb_id group by all""",
    "kb_semi": f"with {DOCS} select distinct kb_id from docs where department = 'de'",
    "chat_kb_bridge": """select c_custkey, n_name, n_suppliers from customer join nation on c_nationkey = n_nationkey
        join (select s_nationkey, count(*) n_suppliers from supplier group by all) on s_nationkey = n_nationkey""",
    "metadata_suggest": f"""with d as (select doc_id document_id, [{', '.join(f"'{n}'" for n in _NAMES)}][(doc_id % 4 + 1)::int] file_name, text from documents)
        select document_id, regexp_replace(file_name, '\\.[^.]*$', '') title, {_rules(_META, metadata.DOC_TYPES, f"'{metadata.OTHER}'")} doc_type,
               {_rules(_META, metadata.DEPARTMENTS, 'null')} department, nullif(replace(regexp_extract({_META}, '{metadata.MODEL}', 1), ' ', ''), '') equipment_model,
               case when regexp_matches({_META}, '{metadata.DATE}') then regexp_extract({_META}, '{metadata.DATE}', 1) || '-' || lpad(regexp_extract({_META}, '{metadata.DATE}', 2), 2, '0') || '-'
                    || lpad(coalesce(nullif(regexp_extract({_META}, '{metadata.DATE}', 3), ''), '01'), 2, '0') end effective_date from d""",
    "metadata_merge": "select doc_id document_id, case when doc_id % 3 = 1 then 'confirmed' else lang end department from documents",
    "envelope_roundtrip": f"""with m as (select conv_id, turn, '{{"conv_id":' || conv_id || ',"turn":' || turn || '}}' context, text from conversations)
        select conv_id, turn, length(base64(encode(context))) + {len(X.SEPARATOR)} + length(text) size, context, text answer from m""",
    "citation_rewrite": "select doc_id, text || ' [citation](' || doc_id || ') ## 💭 深度思考' || chr(10) || '```thinkx```' as text from documents",
    "router_json": """select item_id query_id, case when item_id % 3 = 0 then 'chitchat' else 'retrieval' end intent,
        case when item_id % 2 = 0 then '医工' else '医工,后勤' end as domain, 'q' || item_id rewritten_query, 'a,b' kbs from benchmark""",
    "tumbling_latency": """select date_trunc('hour', ts) window_start, event_type, count(*) n, round(avg(value), 6) mean_value, max(value) max_value from events group by all""",
    "session_events": """with g as (select *, case when ts - lag(ts) over w >= interval 30 minutes or lag(ts) over w is null then 1 else 0 end opens from events window w as (partition by user_id order by ts)),
        s as (select *, sum(opens) over (partition by user_id order by ts) k from g)
        select user_id, min(ts) session_start, count(*) n from s group by user_id, k""",
}

# What an index finds is what a scan finds.
ORACLE |= {"bm25_index_topk": ORACLE["bm25_topk"], "bm25_index_analyzer": ORACLE["bm25_analyzer"], "sparse_index_topk": ORACLE["learned_sparse"], "parent_chunks_scanned": ORACLE["parent_chunks"]}
