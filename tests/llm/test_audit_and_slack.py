"""Filter audit and minimum bin slack packing against brute force, and their edge cases."""

import random
import re
import zlib
from itertools import permutations, product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docproof.llm import filter_audit as audit
from docproof.llm import queries, slack_packing
from docproof.llm.common import table

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(rows):
    """(part, set of letters, good, toxic) of (doc_id, text, lang, good, toxic) by the words of the contract."""
    for doc, text, lang, good, toxic in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        found = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc is not None and any(o[0] is not None and o[0] < doc and (o[1] or "") == text for o in rows),
        }
        yield lang or "", {x for x, y in found.items() if y}, good, toxic


def by_simulation(rows):
    """Every order applied filter by filter to the rows themselves."""
    docs, out = list(fails(rows)), []
    for part in {d[0] for d in docs}:
        mine, total = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                total[x] += len(gone)
                out.append([part, order, step, len(left), len(gone), sum(x in d[1] for d in mine) - len(gone), sum(d[1] == {x} for d in mine), sum(d[2] == 1 for d in gone), sum(d[3] == 1 for d in gone)])
        for row in out:
            if row[0] == part:
                row.append(total[row[1][row[2] - 1]])
    return sorted(map(tuple, out))


def tables(spark, rows, extra_labels=()):
    docs = spark.createDataFrame([(*r[:3], "x", 1) for r in rows], "doc_id long, text string, lang string, part string, mask int")
    labels = spark.createDataFrame([(r[0], r[3], r[4], 9) for r in rows if r[3] is not None] + list(extra_labels), "doc_id long, quality int, toxic int, n int")
    return docs, labels


def made_rows():
    dice = random.Random(5)
    long = " ".join(f"w{i}" for i in range(250))
    texts = ["", None, long, long + " #", "a " * 300, "A" * 50 + long, "AB|", "ÄÖ " * 150, long.upper(), "a\x0bb\x0cc d", "é" * 97 + "ABC", "é" * 97 + "ABCD", "x" * 200_000]
    return [(i, dice.choice(texts), dice.choice(["en", "de", None, ""]), dice.choice([0, 1, None]), dice.choice([0, 1, None])) for i in dice.sample(range(1000), 120)]


def test_audit_by_simulation(spark):
    rows = [r if r[3] is not None else (*r[:3], None, None) for r in made_rows()]
    got = sorted(map(tuple, audit.filter_audit(*tables(spark, rows)).select(COLUMNS).collect()))
    assert got == by_simulation(rows)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_audit_edges(spark):
    """Null ids fail no repeat filter, rows that share the smallest id do not either; labels of several rows: the largest."""
    rows = [(None, "a", "en", None, None), (None, "a", "en", None, None), (3, "a", "en", 0, 0), (3, "a", "en", 0, 0), (4, "a", "en", 1, 0), (5, None, None, 0, 1), (6, "", "", 0, 1)]
    docs, labels = tables(spark, rows, [(4, 0, 1, 9), (None, 1, 1, 9)])
    counts = {(r["part"], r["mask"]): (r["n"], r["good"], r["toxic"]) for r in audit.mask_counts(docs, labels).where("n > 0").collect()}
    assert counts == {("en", 1): (4, 0, 0), ("en", 17): (1, 1, 1), ("", 1): (1, 0, 1), ("", 17): (1, 0, 1)}
    assert audit.filter_audit(docs.limit(0), labels).count() == 0
    assert audit.filter_audit(docs, labels.limit(0)).agg(F.max("good_lost")).first()[0] == 0


def test_audit_hot_text(spark):
    """A third of all rows are one text, in two languages."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("lang"))
    found = audit.mask_counts(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("mask >= 16").groupBy("part").agg(F.sum("n")).collect()
    assert {tuple(r) for r in found} == {("en", 499), ("fr", 500)}


def test_polynomial_by_hand():
    dice = random.Random(2)
    counts = {m: dice.randrange(9) for m in range(8)}
    poly = audit.coefficients(counts, 3)
    for chosen in range(8):
        assert audit.corner(poly, chosen) == sum(n for m, n in counts.items() if m & chosen)
    for i in range(3):
        assert audit.shapley(poly, i) == sum(audit.Fraction(n, m.bit_count()) for m, n in counts.items() if m >> i & 1)


def test_audit_query_against_sql(spark, sf_dir):
    got = sorted(map(tuple, queries.op13_filter_audit(spark, sf_dir).select(COLUMNS).collect()))
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.execute(f"create view {name} as from '{sf_dir}/{name}.parquet'")
    assert got == sorted(db.execute(f"select {', '.join(COLUMNS)} from ({queries.ORACLE['op13_filter_audit']})").fetchall())


def test_fullest_by_brute_force():
    dice = random.Random(4)
    for _ in range(200):
        counts = {dice.randrange(1, 30): dice.randrange(1, 4) for _ in range(dice.randrange(1, 6))}
        capacity = dice.randrange(max(counts), 60)
        best = max(s for ks in product(*(range(n + 1) for n in counts.values())) if (s := sum(k * x for k, x in zip(ks, counts, strict=True))) <= capacity)
        found = slack_packing.fullest(counts, capacity)
        assert sum(k * x for x, k in found.items()) == best and all(0 < k <= counts[x] for x, k in found.items())


def test_plan_is_what_bin_by_bin_gives():
    """Repeated combinations leave every bin as full as a search for each bin alone would."""
    dice = random.Random(6)
    for _ in range(40):
        counts = {dice.randrange(1, 64): dice.randrange(1, 40) for _ in range(8)}
        plan, left = slack_packing.plan_bins(counts, 64), dict(counts)
        for bins, chosen in plan:
            for _ in range(bins):
                best = slack_packing.fullest({x: n for x, n in left.items() if n}, 64)
                assert sum(x * k for x, k in best.items()) == sum(x * k for x, k in chosen.items())
                for x, k in chosen.items():
                    left[x] -= k
        assert not any(left.values()) and len(plan) <= 4 * 64


def check_bins(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_slack_query_by_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries._tokenizer("word_bpe_49k.json"))
    got = queries.op12_slack_packing(spark, sf_dir).collect()
    expected = []
    for r in table(spark, sf_dir, "documents").collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            expected.append((r["doc_id"], piece, start, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    assert sorted(tuple(r)[:5] for r in got) == sorted(expected)
    least = max(-(-sum(x[3] for x in expected) // 4096), sum(x[3] > 2048 for x in expected))
    assert check_bins(got, 4096) <= least + 1


@pytest.mark.parametrize("with_ids", [False, True])
def test_slack_edges(spark, with_ids):
    rows = [(1, None, "x"), (1, None, "x"), (None, "", "y"), (2, "word " * 9000, "z"), (3, "a b c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    path = queries._tokenizer("word_bpe_49k.json")
    got = slack_packing.pack_by_slack(docs, path, with_ids=with_ids).collect()
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"]) for r in got) == [(-1, 0, 0, 1), (1, 0, 0, 1), (1, 0, 0, 1), (2, 0, 0, 4096), (2, 1, 4096, 4096), (2, 2, 8192, 809), (3, 0, 0, 4)]
    assert check_bins(got, 4096) == 3
    assert not with_ids or all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)
    assert slack_packing.pack_by_slack(docs.limit(0), path, with_ids=with_ids).count() == 0


def test_slack_hot_length(spark):
    """Most rows have one length and lie in many tasks; the others fill the bins that these leave."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 > 0, F.lit("a " * 9)).otherwise(F.lit("a " * 5)).alias("text")).repartition(7)
    got = slack_packing.pack_by_slack(docs, queries._tokenizer("word_bpe_49k.json"), capacity=16).collect()
    assert check_bins(got, 16) == 1500 and len({(r["sequence_id"], r["offset"]) for r in got}) == 2000
