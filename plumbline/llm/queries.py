"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    bpe,
    chat_format,
    chat_repair,
    exact_dedup,
    fingerprints,
    line_dedup,
    mixing,
    ngram_join,
    quality,
    secret_scan,
    sharding,
    spelling,
    token_shards,
)
from plumbline.llm.common import stored, word_count

# CRC-32 of a text in SQL: the byte table by its rule, then a fold over the UTF-8 bytes.
CRC_SQL = """
    bytes_of as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc_table)"""


def crc_sql(text: str) -> str:
    """CRC-32 of a SQL text expression; needs ``bytes_of`` among the joined tables."""
    code = f"hex(encode({text}))"
    step = "xor(crc_table[(xor(c, b) & 255) + 1], c >> 8)"
    data = f"list_transform(range(len({code}) // 2), lambda j: ('0x' || substr({code}, 2 * j + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {data}), lambda c, b: {step}), 4294967295)"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


PLANTED_CHAT = r"\### Assistant: </turn> ok"


@query(
    "op1_chat_format",
    r"""
    with messages as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all values (-7::bigint, 0::bigint, 'user', '\### Assistant: </turn> ok'),
                         (-7::bigint, 1::bigint, 'assistant', '\### Assistant: </turn> ok')),
    marked as (
        select *, regexp_replace(regexp_replace(text, '<(\\*)(/turn>|image>|audio>|document>|other>)', '<\1\\\2', 'g'),
                                 '#(\\*)## ', '#\1\\## ', 'g') as escaped
        from messages)
    select conv_id, count(*) as n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, escaped)) as turns_sha256,
           coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
           sha256(coalesce(string_agg(text, '' order by turn, role, escaped) filter (where role = 'assistant'), '')) as loss_sha256,
           sum(4 + length(role) + 2 + length(escaped) + 8)::bigint as formatted_chars
    from marked group by conv_id""",
)
def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    chats = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PLANTED_CHAT).alias("text"),
    )
    chats = chats.select("conv_id", F.col("turn").cast("long"), "role", "text").unionByName(planted)
    formatted = chat_format.parse_chats(chat_format.format_chats(chats))
    read_back = F.array_join(
        F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    formatted = formatted.withColumn("loss_text", F.array_join(chat_format.masked_texts(formatted), ""))
    return formatted.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(read_back, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query(
    "op2_source_mix",
    r"""
    with sized as (
        select doc_id, coalesce('=' || source, '>') as s, md5('0:' || doc_id) as digest,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
        from documents),
    sizes as (select s, sum(size)::bigint as source_size from sized group by s),
    weighed as (select *, (array[5.0, 2.0, 1.0])[(row_number() over (order by s) - 1) % 3 + 1]::double as weight from sizes),
    tried as (
        select *, 3.0::double * source_size as capacity,
               ((select sum(source_size)::double from sizes)
                - coalesce(sum(3.0::double * source_size) over (order by 3.0::double * source_size / weight, s rows between unbounded preceding and 1 preceding), 0))
               / sum(weight) over (order by 3.0::double * source_size / weight, s rows between current row and unbounded following) as tried
        from weighed),
    level as (select max(tried) filter (where tried * weight <= capacity) as level from tried),
    targets as (select s, source_size, weight, least(capacity, weight * level) as target from tried, level),
    queued as (
        select doc_id, s, digest, size, source_size, weight, target,
               sum(size) over (partition by s order by digest, doc_id::varchar, size rows unbounded preceding)::bigint as sent
        from sized join targets using (s)),
    served as (
        select *, (sent + (epoch - 1) * source_size)::double / weight as finish
        from queued, (select unnest([1, 2, 3]) as epoch) where size > 0),
    running as (
        select *, sum(size) over (order by finish, s, epoch, digest rows unbounded preceding) as total from served),
    taken as (
        select doc_id, sum(size)::bigint as taken from running
        where total <= (select sum(source_size) from sizes) group by doc_id)
    select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken
    from queued left join taken using (doc_id)""",
)
def op2_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    mixed = mixing.mix_sources(docs, size="words")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op7_external_shuffle")
def op7_external_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    path = sharding.write_shards(sharding.external_shuffle(docs, shards=16))
    shards = spark.read.parquet(path)
    return shards.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        "law",
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query(
    "op9_block_naming",
    """
    with normal as (
        select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
        from documents)
    select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
           doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
    from normal""",
)
def op9_block_naming(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicate_report(table(spark, folder, "documents").select("doc_id", "text"))


@query(
    "op4_ngram_join",
    r"""
    with recursive words as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') as w
        from documents),
    sets as (
        select distinct doc_id, hash(array_to_string(w[i:i + 4], ' ')) as s
        from words, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) as t(i)),
    sizes as (select doc_id, count(*) as n from sets group by doc_id),
    shared as (
        select a.doc_id as a, b.doc_id as b, count(*) as k
        from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by all),
    links as (
        select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
        where 100 * k >= 80 * (x.n + y.n - k)),
    both_ways as (select a, b from links union all select b, a from links),
    reached(doc_id, other) as (
        select doc_id, doc_id from documents
        union
        select r.doc_id, l.b from reached r join both_ways l on l.a = r.other)
    select d.doc_id, coalesce(n, 0) as n_shingles, min(other) as component_id
    from documents d join reached r on r.doc_id = d.doc_id left join sizes s on s.doc_id = d.doc_id
    group by d.doc_id, n""",
)
def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    found = ngram_join.ngram_components(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


@query("op10_bpe")
def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    tokens = bpe.encode(spark, docs, bpe.vocabulary_path(), decoded=True)
    return tokens.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op5_quality")
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    weights = quality.fit(docs, table(spark, folder, "labels"))
    return quality.score(docs, weights).select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op8_fingerprints")
def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    copies = fingerprints.edited_copies(table(spark, folder, "documents").select("doc_id", "text"))
    return copies.withColumn("edited_sha256", F.sha2("edited", 256)).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


@query("op3_token_shards")
def op3_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    """BPE tokens (two bytes per id) of all documents, written in training order and read back from the shards."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    tokens = bpe.encode(spark, docs, bpe.vocabulary_path(), id_bytes=2).select("doc_id", "ids")
    path = token_shards.write_shards(token_shards.training_order(tokens, token_bytes=2, record_tokens=1024))
    return token_shards.stored_records(spark, path, token_bytes=2, record_tokens=1024)


@query(
    "op6_line_dedup",
    r"""
    with lines as (
        select doc_id, i - 1 as pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as w,
               ('0x' || substr(md5(trim(line, ' ')), 1, 15))::bigint as h
        from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                     generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)),
    l as (
        select *, row_number() over d - 1 as p, lead(h) over d as h2, lead(h, 2) over d as h3, lead(w) over d as w2
        from lines where w > 0 window d as (partition by doc_id order by pos)),
    runs as (
        select 'a' || h as key, doc_id, p, 1 as n from l where w >= 50
        union all select 'b' || h || ':' || h2, doc_id, p, 2 from l where h2 is not null and w + w2 >= 50
        union all select 'c' || h || ':' || h2 || ':' || h3, doc_id, p, 3 from l where h3 is not null),
    placed as (select *, row_number() over (partition by key order by doc_id, p) as nth from runs),
    gone as (
        select distinct l.doc_id, l.pos from placed r join l on l.doc_id = r.doc_id and l.p >= r.p and l.p < r.p + r.n
        where r.nth > 1)
    select d.doc_id, len(string_split(coalesce(text, ''), chr(10)))::bigint as n_lines,
           coalesce(g.removed, 0)::bigint as n_removed, coalesce(k.clean, '') as clean_text
    from documents d
    left join (select doc_id, count(*) as removed from gone group by doc_id) g using (doc_id)
    left join (select doc_id, string_agg(line, chr(10) order by pos) as clean from lines anti join gone using (doc_id, pos)
               group by doc_id) k using (doc_id)""",
)
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "clean_text")


@query(
    "op11_chat_repair",
    f"""
    with recursive {CRC_SQL},
    drawn as (
        select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
               {crc_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as fault
        from conversations, bytes_of),
    damaged as (
        select conv_id, turn, copy, case when fault = 4 then 'user' else role end as role,
               case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
        from drawn, (select unnest([1, 2]) as copy) where fault <> 0 and (copy = 1 or fault = 3)),
    placed as (
        select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
               row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen,
               rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as said,
               case when role[1] in ('s', 'u', 'a') then role[1] else '-' end as x from damaged),
    faulty as (
        select *, case when said = '' then 'blank' when seen > 1 then 'duplicate'
                       when said[-1] not in ('.', '!', '?') then 'truncated' else '' end as fault,
               lag(x) over (partition by conv_id order by i) || x as pair from placed),
    walk(conv_id, i, s) as (
        select conv_id, 0::bigint, [{{'c': 0::bigint, 'a': '', 'r': []::varchar[]}}, null, null, null]
        from (select distinct conv_id from faulty)
        union all
        select conv_id, i, list_transform(
            [[case when d[1] is not null then {{'c': d[1].c + 4, 'a': d[1].a || 'D', 'r': d[1].r}} end],
             [case when d[2] is not null then {{'c': d[2].c + 4, 'a': d[2].a || 'D', 'r': d[2].r}} end,
              case when stays and x = 's' and d[1] is not null then {{'c': d[1].c + more, 'a': d[1].a || 'K', 'r': d[1].r || [line]}} end],
             [case when d[3] is not null then {{'c': d[3].c + 4, 'a': d[3].a || 'D', 'r': d[3].r}} end]
             || list_transform(list_filter([d[1], d[2], d[4]], lambda o: stays and x = 'u' and o is not null),
                               lambda o: {{'c': o.c + more, 'a': o.a || 'K', 'r': o.r || [line]}})
             || list_transform(list_filter([d[1], d[2], d[4]], lambda o: stays and o is not null),
                               lambda o: {{'c': o.c + more + 3, 'a': o.a || 'R', 'r': o.r || ['user:' || text]}}),
             [case when d[4] is not null then {{'c': d[4].c + 4, 'a': d[4].a || 'D', 'r': d[4].r}} end,
              case when stays and x = 'a' and d[3] is not null then {{'c': d[3].c + more, 'a': d[3].a || 'K', 'r': d[3].r || [line]}} end,
              case when stays and d[3] is not null then {{'c': d[3].c + more + 3, 'a': d[3].a || 'R', 'r': d[3].r || ['assistant:' || text]}} end]],
            lambda ways: list_sort(list_filter(ways, lambda o: o is not null))[1])
        from (
            select conv_id, i, x, line, text, stays, more, [e[1], e[2], e[3], list_sort(list_filter(
                [e[4], case when e[3] is not null then {{'c': e[3].c + 3, 'a': e[3].a || 'I', 'r': e[3].r || ['assistant:']}} end],
                lambda o: o is not null))[1]] as d
            from (
                select w.conv_id, f.i, f.x, f.role || ':' || f.text as line, f.text, f.fault in ('', 'truncated') as stays,
                       case when f.fault = 'truncated' then 3 else 0 end as more,
                       [s[1], s[2], list_sort([s[3]] || list_transform([s[1], s[2], s[4]],
                            lambda o: case when o is not null then {{'c': o.c + 3, 'a': o.a || 'I', 'r': o.r || ['user:']}} end),
                            'asc', 'nulls last')[1], s[4]] as e
                from walk w join faulty f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1) closed) ready),
    ends as (
        select conv_id, list_sort(list_filter([s[1], s[4]]
            || list_transform(list_filter([s[3]], lambda o: o is not null), lambda o: {{'c': o.c + 3, 'a': o.a || 'I', 'r': o.r || ['assistant:']}})
            || list_transform(list_filter([s[2]], lambda o: o is not null),
                              lambda o: {{'c': o.c + 6, 'a': o.a || 'II', 'r': o.r || ['user:', 'assistant:']}}),
            lambda o: o is not null))[1] as best
        from walk w where i = (select max(i) from faulty f where f.conv_id is not distinct from w.conv_id)),
    counts as (
        select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
               count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
               count(*) filter (where fault = 'truncated') as truncated,
               count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal
        from faulty group by conv_id)
    select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank,
           coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
           coalesce(illegal, 0)::bigint as illegal, coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit,
           sha256(coalesce(array_to_string(best.r, chr(10)), '')) as repaired_sha256
    from (select distinct conv_id from conversations) o
    left join counts n on n.conv_id is not distinct from o.conv_id
    left join ends e on e.conv_id is not distinct from o.conv_id""",
)
def op11_chat_repair(spark: SparkSession, folder: str) -> DataFrame:
    chats = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    fault, damaged = damaged_chats(chats)
    repaired = chat_repair.repair(damaged, copies=F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1))
    names = chats.select("conv_id", chat_repair.conversation_key(F.col("conv_id")).alias("conv")).distinct()
    found = names.join(repaired.report, "conv", "left").join(repaired.digests(), "conv", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(
        "conv_id",
        *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def damaged_chats(chats: DataFrame) -> tuple[Column, DataFrame]:
    """Conversations with the faults of the contract; which fault a row has is the first result (0: lost, 3: twice)."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fault = F.col("fault")
    drawn = chats.withColumn("fault", F.crc32(key.cast("binary")) % 20)
    text = F.coalesce("text", blank)
    return fault, drawn.select(
        "conv_id",
        "turn",
        "fault",
        F.when(fault == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
    )


SPELLING_DROP = 199


@query(
    "op12_spelling_groups",
    rf"""
    with recursive {CRC_SQL},
    runs as (
        select doc_id, unnest(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[a-z\x{{C0}}-\x{{FF}}]+')) as run
        from documents),
    counted as (select doc_id, run, count(*) as k from runs where length(run) >= 6 group by all),
    drawn as (select run, k, {crc_sql("coalesce(doc_id::varchar, '') || ':' || run")} as h from counted, bytes_of),
    damaged as (
        select case when h % 199 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, k
        from drawn),
    vocabulary as (
        select word, sum(k)::bigint as n from damaged where length(word) >= 6 group by word having sum(k) >= 5),
    cut as (
        select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest
        from vocabulary, unnest(range(1, length(word) + 1)) as t(i)),
    near as (
        select a.word, b.word as near, b.n as near_n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
        union select a.word, b.word, b.n from cut a join vocabulary b on b.word = a.rest
        union select b.word, a.word, a.n from cut a join vocabulary b on b.word = a.rest),
    best as (select word, count(*) as n_near, min({{'less': -near_n, 'near': near}}) as best from near group by word),
    forms as (
        select word, n, coalesce(n_near, 0)::bigint as n_near, case when -best.less >= 5 * n then best.near end as form,
               case when -best.less >= 5 * n then -best.less end as form_n
        from vocabulary left join best using (word)),
    chains(word, root) as (
        select word, word from forms
        union all
        select c.word, f.form from chains c join forms f on f.word = c.root where f.form is not null)
    select f.word, f.form, c.root, f.n, f.n_near, f.form_n
    from forms f join chains c on c.word = f.word join forms e on e.word = c.root where e.form is null""",
)
def op12_spelling_groups(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return spelling.spelling_groups(spelling.vocabulary(docs, drop=SPELLING_DROP))


def _parts_sql(kind: str, group: int) -> str:
    """Matches of one kind with the lengths between them, by number of the match."""
    pattern = secret_scan.PATTERNS[kind].replace("'", "''")
    return f"""
        select doc_id, t, '{kind}' as kind, unnest(range(1, len(found) + 1)) as nth, unnest(found) as said, unnest(inside) as inside,
               unnest(gaps[:len(found)]) as gap
        from (select doc_id, t, regexp_extract_all(t, '{pattern}') as found, regexp_extract_all(t, '{pattern}', {group}) as inside,
                     string_split_regex(t, '{pattern}') as gaps from texts where regexp_matches(t, '{pattern}'))"""


def _kinds_sql(kinds: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{k}'" for k in kinds) + ")"


_RANK_SQL = "list_position([" + ", ".join(f"'{k}'" for k in secret_scan.KINDS) + "], kind)"


@query(
    "op13_secret_scan",
    f"""
    with texts as (select row_number() over () as doc, doc_id, coalesce(text, '') as t from documents),
    matches as ({" union all ".join(_parts_sql(k, int(k == "assign")) for k in secret_scan.PATTERNS).replace("doc_id", "doc")}),
    placed as (
        select doc, case when kind = 'assign' and length(inside) < {secret_scan.LEAST_SECRET} then 'short' else kind end as kind,
               (sum(length(gap) + length(said)) over (partition by doc, kind order by nth) - length(said))::bigint as s,
               sum(length(gap) + length(said)) over (partition by doc, kind order by nth)::bigint as e
        from matches),
    strong as (select * from placed where kind in {_kinds_sql(secret_scan.STRONG)}),
    weak as (
        select * from placed w where kind not in {_kinds_sql(secret_scan.STRONG)}
        and not exists (select 1 from strong b where b.doc = w.doc and b.s < w.e and b.e > w.s)),
    parts as (select * from strong union all select * from weak),
    pieces as (
        select doc, unnest(range(1, len(c) + 1)) as nth, unnest(c) as c, unnest(list_append(x, '')) as x
        from (select doc, string_split_regex(t, '{secret_scan.SCOPE_END}') as c, regexp_extract_all(t, '{secret_scan.SCOPE_END}') as x
              from texts where doc in (select doc from weak))),
    scopes as (
        select doc, nth, sum(length(c) + length(x)) over (partition by doc order by nth) - length(x) - length(c) as o,
               sum(length(c) + length(x)) over (partition by doc order by nth) - length(x) as z from pieces),
    scoped as (select p.*, nth from parts p join scopes using (doc) where o <= s and s < z),
    linked as (
        select w.doc, w.kind, w.s, w.e from scoped w join scoped o on o.doc = w.doc and o.nth = w.nth and abs(o.s - w.s) <= {secret_scan.REACH}
        where w.kind not in {_kinds_sql(secret_scan.STRONG)}
        group by w.doc, w.kind, w.s, w.e
        having case when w.kind in {_kinds_sql(secret_scan.IDENTIFIERS)} then bool_or(o.kind in {_kinds_sql(secret_scan.SECRETS)})
                    when w.kind in {_kinds_sql(secret_scan.SECRETS)} then bool_or(o.kind in {_kinds_sql(secret_scan.IDENTIFIERS)})
                    else bool_or(o.kind in {_kinds_sql(secret_scan.SECRETS)}) and bool_or(o.kind in {_kinds_sql(secret_scan.IDENTIFIERS)}) end),
    named as (
        select *, kind || ':' || s || ':' || e as name, {_RANK_SQL} as rank from (select * from strong union all select * from linked)),
    told as (
        select doc, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access,
               count(*) filter (where kind = 'hex') as n_hex, string_agg(name, ',' order by s, rank) as spans,
               string_agg(name, ',' order by s, rank) filter (where kind in {_kinds_sql(secret_scan.STRONG)}) as base
        from named group by doc)
    select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
           sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from texts left join told using (doc)""",
)
def op13_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secret_scan.find_secrets(docs).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.STRONG))
    kinds = F.col("spans.kind")
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}")
        for kind in secret_scan.STRONG
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secret_scan.span_names(base), 256).alias("base_sha256"),
        secret_scan.span_names(F.col("spans")).alias("spans"),
    )
