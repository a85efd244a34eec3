"""The queries of the training-data operators: op<N>_<name> over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docproof.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents: all are inserted, exact copies deleted, the rest revised to include an end token, and the
    first batch is delivered once more, which changes nothing."""
    from docproof.llm.common import save, shared_dir
    from docproof.llm.exact_dedup import text_hash, with_groups
    from docproof.llm.token_counts import Rollup, count_tokens, deletes, inserts, revisions

    docs = count_tokens(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"))
    rows = save(docs.select(F.col("doc_id").alias("id"), text_hash().alias("sha"), "source", "lang", F.lit("byte_bpe_50k").alias("tokenizer"), "tokens"), "counted")
    grouped = save(with_groups(rows), "grouped")
    stays = F.col("id").eqNullSafe(F.col("keep"))
    copies, rest = grouped.where(~stays), grouped.where(stays)
    rollup = Rollup(spark, f"{shared_dir(spark)}/docproof/rollup-{uuid.uuid4().hex}")
    rollup.apply("all", inserts(rows))
    rollup.apply("copies", deletes(copies))
    rollup.apply("ends", revisions(rest.withColumn("now", F.col("tokens") + 1), "tokens", "now"))
    rollup.apply("all", inserts(rows))
    rollup.compact()
    return rollup.read()


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docproof.llm.toxicity import score_toxicity, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docproof.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docproof.llm.language_id import page_languages, train

    return page_languages(table(spark, sf_dir, "pages"), train(table(spark, sf_dir, "documents")))


def op5_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docproof.llm.graph_search import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docproof.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json")).drop("ids")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docproof.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the texts that are left."""
    from docproof.llm.line_dedup import remove_repeated_lines

    found = remove_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docproof.llm.warc import archive_folder, read_archives, write_archives

    found = read_archives(write_archives(table(spark, sf_dir, "pages"), archive_folder(spark)))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the operator's ids, of the text that they decode to, and of the pieces' spans in the source."""
    from docproof.llm.pieces import encode_pieces

    found = encode_pieces(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), decoded=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.xxhash64("first", "end").alias("spans_xxh64"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docproof.llm.alignment import NUMBERS, align_documents

    found = align_documents(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))
    return found.select("doc_id", *NUMBERS, F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))


def op12_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docproof.llm.slack_packing import pack_by_slack

    return pack_by_slack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docproof.llm.filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


ORACLE = {
    "op13_filter_audit": r"""
        with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
                          min(doc_id) over (partition by coalesce(text, '')) as least from documents),
        l as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id),
        f as (select part, coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as bad,
                     (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
                     + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::int
                     + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(d.doc_id > least, false)::int as mask
              from d left join l on d.doc_id = l.doc_id),
        m as (select part, mask, count(*) as n, count(*) filter (where good) as good, count(*) filter (where bad) as bad from f group by part, mask),
        letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
        orders as (select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
                   where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        steps as (select filter_order, s as step, filter_order[s] as letter, (1 << (strpos('ABCDE', filter_order[s]) - 1)) as own,
                         coalesce(list_sum([1 << (strpos('ABCDE', filter_order[i]) - 1) for i in range(1, s)]), 0)::int as prior
                  from orders, (select unnest([1, 2, 3, 4, 5])::int as s)),
        r as (select part, filter_order, step, letter, sum(if((mask & (prior | own)) = 0, n, 0))::bigint as kept,
                     sum(if((mask & prior) = 0 and (mask & own) <> 0, n, 0))::bigint as removed, sum(if((mask & prior) <> 0 and (mask & own) <> 0, n, 0))::bigint as redundant,
                     sum(if(mask = own, n, 0))::bigint as unique_fails, sum(if((mask & prior) = 0 and (mask & own) <> 0, good, 0))::bigint as good_lost,
                     sum(if((mask & prior) = 0 and (mask & own) <> 0, bad, 0))::bigint as toxic_lost
              from m, steps group by part, filter_order, step, letter)
        select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley from r""",
    "op3_exact_dedup": r"""
        with h as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
        select doc_id, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
               doc_id = min(doc_id) over (partition by text_sha256) as kept, text_sha256
        from h""",
    "op8_line_dedup": r"""
        with d as (select distinct doc_id, coalesce(text, '') as text, substr(md5(coalesce(text, '')), 1, 15) as print from documents),
        l as (select doc_id, print, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from d where text <> ''),
        w as (select doc_id, print, pos, line as a, lead(line, 1) over d as b, lead(line, 2) over d as c, lead(pos, 2) over d as p
              from l window d as (partition by doc_id, print order by pos)),
        o as (select *, row_number() over (partition by a, b, c order by doc_id nulls last, print, pos) as turn
              from w where p is not null and regexp_matches(a || b || c, '[^\x20\x09-\x0D]')),
        r as (select distinct doc_id, print, pos + i.i as pos from o cross join (select unnest([0, 1, 2]) as i) i where turn > 1),
        k as (select l.doc_id, l.print, count(*) as n_lines, count(r.pos) as n_removed, coalesce(string_agg(l.line, chr(10) order by l.pos) filter (where r.pos is null), '') as text
              from l left join r on l.doc_id is not distinct from r.doc_id and l.print = r.print and l.pos = r.pos group by l.doc_id, l.print)
        select t.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(coalesce(k.text, '')) as text_sha256
        from documents t left join k on t.doc_id is not distinct from k.doc_id and substr(md5(coalesce(t.text, '')), 1, 15) = k.print""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
