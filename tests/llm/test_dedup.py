"""Exact, near and line deduplication against brute force, and their edge cases."""

import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from docproof.llm import similar, simhash
from docproof.llm.common import table
from docproof.llm.exact_dedup import drop_exact_copies, exact_dedup
from docproof.llm.line_dedup import remove_repeated_lines

ROWS = [(5, "a  b", "x"), (3, "a\tb", "y"), (9, None, None), (8, "", "z"), (7, " ", "q"), (7, " ", "q"), (None, "lone", "n"), (1, "a b ", "w")]
SCHEMA = "doc_id long, text string, keep_id string"


def test_exact_edge_cases(spark):
    got = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert (got[5, sha("a b")]["keep_id"], got[5, sha("a b")]["group_size"], got[5, sha("a b")]["kept"]) == (3, 2, False)
    assert (got[9, sha("")]["keep_id"], got[9, sha("")]["kept"], got[8, sha("")]["kept"]) == (8, False, True)
    assert got[7, sha(" ")]["group_size"] == 2 and got[7, sha(" ")]["kept"]
    assert got[None, sha("lone")]["kept"] and got[1, sha("a b ")]["kept"]
    kept = drop_exact_copies(spark.createDataFrame(ROWS, SCHEMA))
    assert kept.columns == ["doc_id", "text", "keep_id"]
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 3, 7, 7, 8]


def test_exact_empty(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert drop_exact_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_all_copies(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    assert [tuple(r) for r in exact_dedup(docs).groupBy("keep_id", "group_size", "kept").count().orderBy("kept").collect()] == [(0, 3000, False, 2999), (0, 3000, True, 1)]


def test_repeated_filter_by_hand(spark, monkeypatch):
    from docproof.llm import exact_dedup as ed

    monkeypatch.setattr(ed, "HELD", 500)
    rows = [(f"h{min(i, 900)}",) for i in range(1000)] + [(f"h{i}",) for i in range(0, 900, 7)]
    hashes = spark.createDataFrame(rows, "sha string").repartition(5)
    packed = ed.repeated_filter(hashes, "sha", len(rows))
    places = [tuple(r) for r in hashes.select("sha", *ed._positions("sha", len(packed) * 64)).collect()]
    hits = np.bincount([p for _, *at in places for p in at], minlength=len(packed) * 64)
    assert np.array_equal(np.unpackbits(packed.view(np.uint8), bitorder="little"), hits > 1)
    flagged = {r["sha"] for r in ed.mark_possible(hashes, "sha", packed, "again").where("again").collect()}
    assert flagged >= {f"h{i}" for i in range(0, 901, 7)} | {"h900"} and len(flagged) < 400


def slow_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, sf_dir):
    texts = [r["text"] for r in table(spark, sf_dir, "documents").limit(60).collect()] + ["", " \n", "One", "Ünder Ä b c d E", "a b c d a b c d a b c d"]
    assert [simhash.fingerprint_of(t) for t in texts] == [slow_print(t) for t in texts]


def test_golay_code():
    index, near = simhash.golay_tables()
    assert len(set(index.tolist())) <= 4096
    dice = np.random.default_rng(1)
    word = dice.integers(0, 1 << 16, 500)
    for bit in range(16):
        other = word ^ (1 << bit)
        assert all(index[a] in near[b] for a, b in zip(word, other, strict=True))


def test_links_and_components_by_brute_force(spark):
    dice = np.random.default_rng(3)
    base = dice.integers(0, 1 << 63, 40)
    prints = [int(b) ^ sum(1 << int(x) for x in dice.choice(63, dice.integers(0, 6), replace=False)) for b in base for _ in range(12)]
    prints = sorted(set(prints) | {int(b) for b in base} | {0, -1, -2})
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    close = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
    want = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if close(a, b)}
    assert got == want and len(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()) == len(want)


def test_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}
    assert simhash.components(edges.where("a < 0")).count() == 0


def test_near_edge_cases(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(4, text, "c"), (2, text, "c"), (9, None, None), (6, "", "x"), (None, text, "y"), (4, text, "c"), (7, "quite another text of six words", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = simhash.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"] or -1), r["component_id"]) for r in got) == [(-1, 2), (2, 2), (4, 2), (4, 2), (6, 6), (7, 7), (9, 6)]
    assert sorted((r["doc_id"] or -1) for r in simhash.drop_near_copies(docs).collect()) == [-1, 2, 6, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_unique_texts_stay_where_ids_repeat(spark):
    text, other = (" ".join(f"{w}{i}" for i in range(80)) for w in ("word", "thing"))
    docs = spark.createDataFrame([(1, text), (5, text), (5, other), (5, other), (None, "lone")], "doc_id long, text string")
    for drop in (simhash.drop_near_copies, similar.drop_similar):
        assert sorted(((r["doc_id"] or 0), r["text"]) for r in drop(docs).collect()) == sorted([(1, text), (5, other), (5, other), (0, "lone")])


def test_near_duplicates_by_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    rows += [(1000 + i, " ".join([*t.split()[: 40 + i], *(["edit"] if i % 2 else [])])) for i, (_, t) in enumerate(rows[:60])] + [(2000, ""), (2001, None)]
    prints = [slow_print(t or "") for _, t in rows]
    label = [i for i, _ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    for _ in rows:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (f"{f:016x}", x) for (i, _), f, x in zip(rows, prints, label, strict=True)} and len(set(label)) < len(label)


def test_one_error_in_each_segment(spark):
    prints = [0, *(1 << a | 1 << 16 + b | 1 << 32 + c | 1 << 48 + d for a in (0, 9) for b in (7, 8) for c in (3, 15) for d in (2, 14))]
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    assert {(0, p) for p in prints[1:]} <= got


def similar_by_hand(rows):
    sets = []
    for _, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)})
    label = [i for i, _ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * (k := len(sets[i] & sets[j])) >= 4 * (len(sets[i]) + len(sets[j]) - k)]
    for _ in rows:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return {i: x for (i, _), x in zip(rows, label, strict=True)}


def test_similar_by_brute_force(spark, sf_dir):
    dice = np.random.default_rng(5)
    base = [f"w{x}" for x in dice.integers(0, 5000, 120)]
    rows = [(r["doc_id"] + 1000, r["text"]) for r in table(spark, sf_dir, "documents").collect()] + [(1, ""), (2, " \n"), (3, None), (4, "One two"), (5, "one  TWO"), (6, "two one")]
    for i in range(60):  # from a word to six edited
        words = list(base)
        for at in dice.choice(len(words), i % 6 + 1, replace=False):
            words[at] = "new" + str(i)
        rows.append((100 + i, " ".join(words)))
    far = [w if i % 20 else "far" for i, w in enumerate(base)]  # too far from the base, near to one another
    rows += [(200 + i, " ".join(far[: 3 + 9 * i] + [f"odd{i}"] + far[4 + 9 * i :])) for i in range(12)]
    got = {r["doc_id"]: r["component_id"] for r in similar.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == similar_by_hand(rows)


def test_near_stage_drops_an_edited_copy(spark, sf_dir):
    import corpus_pipeline

    words = [f"word{i}" for i in range(100)]
    edited = [" ".join([*words[:at], "other", *words[at + 1 :]]) for at in (20, 50, 80)]
    docs = spark.createDataFrame([(1, " ".join(words), "c"), *((i + 2, t, "c") for i, t in enumerate(edited)), (None, edited[0], "c"), (9, None, "c")], "doc_id long, text string, component_id string")
    kept = corpus_pipeline.near_copies(spark, docs, sf_dir)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 9]
    assert corpus_pipeline.near_copies(spark, docs.limit(0), sf_dir).count() == 0


def test_near_copies_meet_by_fingerprints(spark, monkeypatch):
    """Without minimum hashes in common, edited copies still meet through the Golay keys of their fingerprints."""
    sketches = similar._sketches
    monkeypatch.setattr(similar, "_sketches", lambda texts: sketches(texts).withColumn("bands", F.array("node")))
    words = [f"word{i}" for i in range(150)]
    edited = [" ".join([*words[:at], "other", *words[at + 1 :]]) for at in (20, 50, 80)]
    rows = [(1, " ".join(words)), *((i + 2, t) for i, t in enumerate(edited)), (9, " ".join(reversed(words))), (10, None)]
    got = {r["doc_id"]: r["component_id"] for r in similar.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9, 10: 10}


def test_alike_but_no_near_copies(spark, monkeypatch):
    """Texts within a few bits of one another that are no near copies are compared with few, not each with all."""
    asked, differences = [], similar._differences
    monkeypatch.setattr(similar, "_differences", lambda pairs, texts: asked.append(pairs.count()) or differences(pairs, texts))
    dice = np.random.default_rng(7)
    rows = []
    for i in range(500):
        words = [f"word{x}" for x in range(150)]
        for at in dice.choice(150, 3, replace=False):
            words[at] = f"new{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(text.split()[:140])) for i, text in rows[:20]]
    prints = [similar.prints_of(text) for _, text in rows]
    close = sum(any(int(x ^ y).bit_count() <= 4 for x, y in zip(a, b, strict=True)) for i, a in enumerate(prints) for b in prints[:i])
    got = {r["doc_id"]: r["component_id"] for r in similar.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == similar_by_hand(rows) and sum(asked) < 50 * len(rows) < close


def test_links_between_groups(spark):
    prints = [(0b1111, 1), (0, 1), (0, 2), (0b111, 3), (-1, 4)]
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame(prints, "fp long, group int")).collect()}
    assert got == {(0, 0), (0, 0b1111), (0, 0b111), (0b111, 0b1111)}


def lines_by_hand(rows):
    first, texts = {}, {i: t.split("\n") if t else [] for i, t in sorted(rows)}
    gone = {i: set() for i in texts}
    for i, lines in sorted(texts.items()):
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if any(x.strip(" ") for x in w) and first.setdefault(w, (i, p)) != (i, p):
                gone[i] |= {p, p + 1, p + 2}
    return {i: "\n".join(x for p, x in enumerate(t) if p not in gone[i]) for i, t in texts.items()}


def test_lines_by_hand(spark, sf_dir):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\nd\ny"), (3, ""), (4, "a\nb\nc\nd\ne"), (5, "z\nz\nz\nz\nz"), (6, "\n\n\n\n"), (7, "\n\n\n\nq"), (8, "a\nb")]
    rows += [(r["doc_id"] + 100, r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    got = {r["doc_id"]: r["text"] for r in remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == lines_by_hand(rows)


def rows_by_hand(rows):
    """(id, text) -> what is left, of rows that may share ids or have none; equal rows are one."""
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()[:15])
    ranked = sorted(set(rows), key=order)
    left = lines_by_hand(list(enumerate(t for _, t in ranked)))
    return {r: left[i] for i, r in enumerate(ranked)}


def test_lines_of_repeated_and_missing_ids(spark, tmp_path):
    import duckdb

    from docproof.llm.queries import ORACLE, op8_line_dedup

    rows = [(7, "a\nb\nc"), (7, "k\nl\nm"), (7, "a\nb\nc"), (3, "a\nb\nc\nz"), (None, "p\nq\nr\ns"), (None, "x\na\nb\nc"), (None, "u\nv"), (2**63 - 1, "p\nq\nr\nt"), (0, "a\nb"), (7, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = rows_by_hand(rows)
    assert want[7, "k\nl\nm"] == "k\nl\nm" and want[None, "p\nq\nr\ns"] == "s" and want[7, "a\nb\nc"] == ""
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((key(r) for r in op8_line_dedup(spark, str(tmp_path)).collect()))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((i, d) for i, _, _, d in got) == sorted((str(i), digest(want[i, t])) for i, t in rows)
    base = duckdb.connect()
    base.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(key(r) for r in base.execute(ORACLE["op8_line_dedup"]).fetchall()) == got


def test_lines_edge_cases(spark):
    docs = spark.createDataFrame([(None, "a\nb\nc", 1), (3, "a\nb\nc", 2), (4, None, 3), (3, "a\nb\nc", 2)], "doc_id long, text string, n_lines int")
    got = sorted(((r["doc_id"] or 0), r["n_lines"], r["n_removed"], r["text"]) for r in remove_repeated_lines(docs).collect())
    assert got == [(0, 3, 3, ""), (3, 3, 0, "a\nb\nc"), (3, 3, 0, "a\nb\nc"), (4, 0, 0, "")]
    assert remove_repeated_lines(docs.limit(0)).count() == 0
    plan = remove_repeated_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_blank_lines_of_any_kind(spark):
    """Three blank lines in a row, of carriage returns or tabs, are no passage."""
    texts = ["a one\r\n\r\n\r\n\r\nb", "c two\r\n\r\n\r\n\r\nd", "x\n\t\n \t\n\x0b\ny", "z\n\t\n \t\n\x0b\nw", "long " * 50_000 + "\n1\n2\n3", "tail\n1\n2\n3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in remove_repeated_lines(docs).collect()}
    assert [got[i] for i in range(5)] == texts[:5] and got[5] == "tail"


def test_keys_of_fingerprints_are_never_broadcast(spark):
    """Some sixty keys a fingerprint, of tables that look small."""
    from docproof.llm import simhash

    prints = spark.range(50).selectExpr("xxhash64(id) as fp")
    assert "Broadcast" not in simhash.links(prints)._jdf.queryExecution().executedPlan().toString()
