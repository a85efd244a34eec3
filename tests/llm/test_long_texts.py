"""A document of hundreds of thousands of words, and one without a space, through every operator on documents."""

import hashlib

import pytest
from pyspark.sql import functions as F

from docproof.llm import queries
from docproof.llm.exact_dedup import exact_dedup
from docproof.llm.filter_audit import mask_counts
from docproof.llm.language_id import keep_known_languages
from docproof.llm.language_id import train as train_languages
from docproof.llm.line_dedup import remove_repeated_lines
from docproof.llm.packing import pack
from docproof.llm.pieces import encode_pieces
from docproof.llm.similar import drop_similar
from docproof.llm.simhash import near_duplicates
from docproof.llm.token_counts import count_tokens

LONG = "\n".join(f"the line number {i} of a long text" for i in range(30_000))
SOLID = "x" * 300_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "en", "a"), (2, LONG + " ", "en", "a"), (3, SOLID, "en", "b"), (4, "short one", "en", "b"), (5, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2).cache()


def test_counts_and_packing(docs):
    path = queries._tokenizer("word_bpe_49k.json")
    counted = {r["doc_id"]: r["tokens"] for r in count_tokens(docs, queries._tokenizer("byte_bpe_50k.tiktoken")).select("doc_id", "tokens").collect()}
    assert counted[1] > 200_000 and counted[3] > 1_000 and counted[5] == 0
    sums = {r["doc_id"]: (r["n"], r["total"]) for r in pack(docs, path).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("total")).collect()}
    assert all(n == total for n, total in sums.values()) and sums[1][0] > 200_000


def test_copies_and_lines(docs):
    kept = {r["doc_id"]: r["keep_id"] for r in exact_dedup(docs).collect()}
    assert kept == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert sorted(r["doc_id"] for r in drop_similar(docs).select("doc_id").collect()) == [1, 3, 4, 5]
    cut = {r["doc_id"]: (r["n_removed"], len(r["text"])) for r in remove_repeated_lines(docs).collect()}
    assert cut[1] == (0, len(LONG)) and cut[2][0] == 29_999 and cut[3] == (0, len(SOLID))


def test_languages_pieces_and_audit(docs):
    assert keep_known_languages(docs, train_languages(docs)).where("doc_id < 3").count() == 2
    pieces = {r["doc_id"]: (r["n"], r["same"]) for r in encode_pieces(docs, queries._tokenizer("piece_bpe_32k.model"), decoded=True).join(docs.select(F.col("doc_id").alias("id"), "text"), F.col("doc_id") == F.col("id")).select("doc_id", F.size("ids").alias("n"), (F.sha2("decoded", 256) == F.sha2(F.coalesce("text", F.lit("")), 256)).alias("same")).collect()}
    assert pieces[1][0] > 200_000 and all(same for _, same in pieces.values())
    labels = docs.sparkSession.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {(r["part"], r["mask"]): r["n"] for r in mask_counts(docs, labels).where("n > 0").collect()} == {("en", 2): 2, ("en", 1): 2, ("", 1): 1}
    assert hashlib.sha256(SOLID.encode()).hexdigest() in {r["text_sha256"] for r in exact_dedup(docs).collect()}
