"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import chat, cover_tree, curriculum, dart_minhash, digest_index, divergence, pii_crf, piece_sampling, quality, suffix_tree, toxicity, url_filter, whitening
from corpusloom.llm.common import fold, new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_held_out(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each sample's ids, and whether decoding them gives the whole text again."""
    pieces = piece_sampling.load(spark)
    rows = piece_sampling.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), pieces, check=True)
    return rows.select(
        "doc_id", "sample", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "perturbed", "inclusion", F.col("exact").alias("round_trip")
    )


#: Both turns of conversation -1.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"),
    )
    read = chat.read_windows(chat.format_windows(rows.unionByName(more)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digests = read.select("conv_id", "window", F.size("turns").cast("long").alias("n"), said.alias("said"), "loss", F.length("formatted").cast("long").alias("chars"))
    whole = digests.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.count("*").alias("n_windows"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("w"),
    )
    loss = F.array_join(F.col("w.loss"), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.col("w.said"), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )


def op5_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    units, entries = curriculum.plan(docs)
    first = entries.groupBy("doc_id", "key").agg(F.min("position").alias("first_position"))
    return units.join(first, ["doc_id", "key"], "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "first_position"
    )


#: The list of op4: pages 0 to 999, in each language, of these sites' hosts. It is made from these constants, not from pages.
LISTED_SITES, LISTED_SUBDOMAINS = ("tionsh", "thther", "ththan", "ththth", "ththon", "ththed", "ththly", "therin"), ("", "m.", "blog.")
LISTED_DOMAINS, LISTED_LANGS, LISTED_PAGES = ("example.com", "example.net", "example.org"), ("de", "en", "es", "fr"), 1000
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def listed_urls(spark: SparkSession) -> DataFrame:
    """Column url: the canonical URLs of op4's list."""
    each = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    rows = spark.range(LISTED_PAGES).select("id", each(LISTED_SITES).alias("site")).select("*", each(LISTED_SUBDOMAINS).alias("sub"))
    rows = rows.select("*", each(LISTED_DOMAINS).alias("domain")).select("*", each(LISTED_LANGS).alias("lang"))
    return rows.select(url_filter.canonical(F.concat("sub", "site", F.lit("."), "domain"), F.concat(F.lit("/"), "lang", F.lit("/"), F.col("id").cast("string"))).alias("url"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), listed_urls(spark), URL_RULES)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality"))
    rows = quality.scored(docs, model).select("doc_id", (fold(F.col("doc_id")) % 5 == 0).alias("held_out"), "score")
    return rows.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, the larger ids first: the second is held against an index that has the first."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    index = digest_index.DigestIndex(spark, new_path(spark, "digest_index"))
    verdicts = digest_index.in_batches(docs, index, [] if low is None else [(low + high) // 2], "documents")
    return verdicts.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii_crf.detect(docs, pii_crf.fit(docs))
    spelled = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n_of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [n_of(k).alias(f"n_{k}") for k in pii_crf.KINDS]
    return found.select("doc_id", *counts, F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("spans").alias("spans"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    rows = toxicity.scored(docs, model).select("doc_id", (fold(F.col("doc_id")) % 3 == 1).alias("held_out"), "score")
    return rows.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_piece_sampling": op2_piece_sampling,
    "op3_chat_format": op3_chat_format,
    "op4_url_filter": op4_url_filter,
    "op5_curriculum": op5_curriculum,
    "op6_quality": op6_quality,
    "op7_dart_minhash": op7_dart_minhash,
    "op8_cover_tree": op8_cover_tree,
    "op9_digest_index": op9_digest_index,
    "op10_skip_chain_crf": op10_skip_chain_crf,
    "op11_source_divergence": op11_source_divergence,
    "op12_whitening": op12_whitening,
    "op13_toxicity": op13_toxicity,
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPLIT_URL = rf"""
    with rest as (
        select page_id, coalesce(case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end, '') r from pages
    ), cut as (
        select page_id, translate(regexp_extract(r, '^[^/?#]*'), '{_UPPER}', '{_UPPER.lower()}') host,
               regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') path from rest
    ), named as (
        select *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') canon from cut
    )"""

_WORDS = r"len(regexp_extract_all({}, '[^\x20\x09-\x0D]+'))"


def _escaped(text: str) -> str:
    return rf"replace(replace({text}, '\', '\\'), '<|', '<\|')"


def _training_time(y: str, knots: tuple) -> str:
    area = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        area.append(area[-1] + (t1 - t0) * (w0 + w1) / 2)
    cases = ""
    for (t0, w0), (t1, w1), a0, a1 in zip(knots, knots[1:], area, area[1:], strict=False):
        over, slope = f"({y} * {area[-1]!r}::double - {a0!r}::double)", 2 * (w1 - w0) / (t1 - t0)
        step = f"2.0::double * {over} / ({w0!r}::double + sqrt(greatest({w0 * w0!r}::double + {slope!r}::double * {over}, 0.0::double)))"
        cases += f" when {y} * {area[-1]!r}::double <= {a1!r}::double then {t0!r}::double + case when {over} > 0 then {step} else 0.0::double end"
    return f"case {cases} else 1.0::double end"


def _shuffled(salt: str) -> str:
    return f"('0x' || substr(md5('{salt}' || coalesce(doc_id::varchar, 'null')), 1, 15))::bigint"


_MIX = f"""
    with sized as (select doc_id, source, {_WORDS.format("coalesce(text, '')")}::bigint size from documents),
    sources as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 rank from sized group by source),
    weighed as (select *, rank % 3 class, (case rank % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end)::double weight, source_size * 2.0::double most from sources),
    levels as (
        select *, most / weight ratio,
               ((sum(source_size) over ()) * 1.5::double - coalesce(sum(most) over (order by most / weight, rank rows between unbounded preceding and 1 preceding), 0))
               / sum(weight) over (order by most / weight, rank rows between current row and unbounded following) as lev from weighed
    ),
    goals as (
        select *, least(most, coalesce((select arg_min(lev, (ratio, rank)) from levels where lev <= ratio) * weight, most)) target from levels
    ),
    ordered as (
        select doc_id, sized.source, size, source_size, target, class, {_shuffled("take")} h,
               case when size >= greatest(1.0, source_size * 0.01::double) then -size else 0 end first
        from sized join goals on sized.source is not distinct from goals.source
    ),
    summed as (
        select *, coalesce(sum(size) over (partition by source order by first, h, doc_id rows between unbounded preceding and 1 preceding), 0) before,
               case when target >= source_size then 1 else 0 end whole from ordered
    ),
    mixed as (select *, whole + case when before + size / 2.0::double <= target - whole * source_size then 1 else 0 end copies from summed),
    entries as (
        select *, {_shuffled("place")} p, sum(size * copies) over (partition by source) / copies_all source_taken from (
            select *, 1 copies_all from mixed
        )
    ),
    passes as (select *, unnest(range(1, copies + 1)) pass from entries where copies > 0),
    placed as (
        select *, coalesce((coalesce(sum(size) over (partition by source order by pass, p, doc_id rows between unbounded preceding and 1 preceding), 0)
                  + size / 2.0::double) / nullif(source_taken, 0), 0.0) y from passes
    ),
    firsts as (
        select doc_id, min(case class when 0 then {_training_time("y", curriculum.SCHEDULES[0])} when 1 then {_training_time("y", curriculum.SCHEDULES[1])}
               else {_training_time("y", curriculum.SCHEDULES[2])} end) first_position from placed group by doc_id
    )
    select doc_id, size, source_size, target, (size * copies)::bigint taken, first_position from mixed left join firsts using (doc_id)"""

_CHAT = rf"""
    with rows as (
        select conv_id, turn, coalesce(role, '') role, coalesce(text, '') as text from conversations
        union all values (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}')
    ),
    sized as (
        select *, {_WORDS.format("text")} + {chat.MARKS} tokens, 24 + length({_escaped("text")}) + length(replace({_escaped("role")}, chr(10), '
')) chars,
               row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 pos from rows
    ),
    placed as (select *, sum(tokens) over (partition by conv_id order by pos) - tokens as start from sized),
    cut as (select *, start // {chat.STRIDE} win, pos = 0 and role = 'system' is_system from placed),
    heads as (select conv_id, win, min(start) head from cut group by all),
    extra as (
        select c.conv_id, chars from cut c join heads h on c.conv_id is not distinct from h.conv_id and h.win = c.win + 1
        where not is_system and c.start >= h.head - {chat.HISTORY}
        union all select c.conv_id, chars from cut c join heads h on c.conv_id is not distinct from h.conv_id and h.win > 0 where is_system
    ),
    more as (select conv_id, sum(chars) chars from extra group by 1),
    whole as (
        select conv_id, count(*) n_turns, sum(chars) chars, count(distinct win) n_windows,
               string_agg(role || chr(10) || text || chr(10), '' order by pos) said,
               coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '') loss from cut group by 1
    )
    select w.conv_id, n_turns, sha256(said) turns_sha256, length(loss) loss_chars, sha256(loss) loss_sha256,
           (w.chars + coalesce(m.chars, 0))::bigint formatted_chars, n_windows
    from whole w left join more m on w.conv_id is not distinct from m.conv_id"""

ORACLE: dict[str, str] = {
    "op3_chat_format": _CHAT,
    "op5_curriculum": _MIX,
    "op4_url_filter": _SPLIT_URL
    + rf""", listed as (
        select sub || site || '.' || domain || '/' || lang || '/' || n canon
        from (select unnest({list(LISTED_SITES)}) site), (select unnest({list(LISTED_SUBDOMAINS)}) sub), (select unnest({list(LISTED_DOMAINS)}) domain),
             (select unnest({list(LISTED_LANGS)}) lang), range({LISTED_PAGES}) t(n)
    ),
    rules(rule, says) as (values {', '.join(f"('{r}', '{v}')" for r, v in URL_RULES)}),
    fits as (
        select page_id, max_by(rule, length(rule)) rule, max_by(says, length(rule)) says from named, rules
        where (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1)))
          and starts_with(path, substr(rule, strpos(rule, '/'))) group by page_id
    )
    select n.page_id, n.host, n.path, f.rule, l.canon is not null and f.says is null as listed,
           coalesce(f.says, case when l.canon is not null then 'block' else 'allow' end) verdict
    from named n left join fits f using (page_id) left join listed l on n.canon = l.canon""",
    "op8_cover_tree": """
    with recursive fit as (
        select vec_id, label, embedding::double[] e from embeddings
        where label is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
          and list_sum(list_transform(embedding, lambda x: x::double * x::double)) > 0
    ),
    links as (select a.vec_id x, b.vec_id y from fit a join fit b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93),
    reach(x, y) as (select vec_id, vec_id from embeddings union select r.x, l.y from reach r join links l on r.y = l.x),
    counts as (select x, count(*) n from links group by x)
    select vec_id, coalesce(any_value(n), 0) n_links, min(y) component_id, vec_id = min(y) kept from embeddings join reach on vec_id = reach.x left join counts on vec_id = counts.x group by vec_id""",
    "op9_digest_index": """
    select doc_id, max(doc_id) over w keep_id, count(*) over w group_size, doc_id = max(doc_id) over w kept,
           sha256(coalesce(text, '')) text_sha256
    from documents window w as (partition by coalesce(text, ''))""",
    "op11_source_divergence": r"""
    with docs as (
        select row_number() over () d, coalesce(lang, '') lang, coalesce(source, '') source,
               regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') terms from documents
    ),
    grps as (select distinct lang, source from docs),
    said as (select d, lang, source, unnest(terms) term from docs),
    known as (select lang, term from said group by all having count(distinct d) >= 3),
    counts as (select lang, source, term, count(*) n from said semi join known using (lang, term) group by all),
    sizes as (select lang, count(*) v from known group by 1),
    totals as (select lang, source, coalesce(sum(n), 0)::hugeint total from grps left join counts using (lang, source) group by all),
    p as (
        select lang, source, term, coalesce(n, 0) n, (1 + 1000000000::hugeint * (coalesce(n, 0) + 1) // (total + v)) p
        from totals join known using (lang) join sizes using (lang) left join counts using (lang, source, term)
    ),
    whole as (
        select lang, term, 1 + 1000000000::hugeint * (w.n + 1) // (t.total + v) q
        from (select lang, term, sum(n)::hugeint n from counts group by all) w join (select lang, sum(total)::hugeint total from totals group by 1) t using (lang) join sizes using (lang)
    ),
    pairs as (
        select g.lang, g.source, 'pair' part, h.source item, coalesce(s.value, 0)::bigint as value from grps g join grps h on g.lang = h.lang and g.source <> h.source
        left join (
            select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
        ) s on s.lang = g.lang and s.source = g.source and s.item = h.source
    ),
    terms as (
        select p.lang, p.source, 'term' part, p.term item, ((p - q) * (p - q) // q)::bigint as value from p join whole using (lang, term) where n > 0 and p > q
    )
    select *, (row_number() over (partition by lang, source order by value desc, item))::int as rank from pairs
    union all select *, (row_number() over (partition by lang, source order by value desc, item))::int as rank from terms qualify rank <= 200""".replace("{upper}", _UPPER).replace("{lower}", _UPPER.lower()),
}
