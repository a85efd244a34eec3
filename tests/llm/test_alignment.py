"""Cross-tokenizer alignment against brute force over whole texts, and its edge cases."""

import hashlib
import random
from collections import Counter

import pytest

from docproof.llm import alignment, queries
from docproof.llm.common import table
from docproof.llm.encoders import byte_letters


@pytest.fixture(scope="module")
def paths():
    return queries._tokenizer("byte_bpe_50k.json"), queries._tokenizer("piece_bpe_32k.model")


def slow_tokens(paths):
    """text -> both sides' (id, bytes), by the libraries on the whole text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    letters = {x: i for i, x in byte_letters().items()}

    def piece(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:-1], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        left = [(i, bytes(letters[x] for x in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, piece(i)) for i in b.encode(text)]
        joined = [b"".join(x for _, x in side) for side in (left, right)]
        return (left, right) if joined[0] == joined[1] == (" " + text).encode() else ([], [])

    return tokens


def slow(paths, rows):
    """The contract's rows for (doc_id, text), document by document."""
    tokens, found, docs = slow_tokens(paths), [], Counter()
    for doc, text in rows:
        sides = []
        for side in tokens(text):
            at, ends = 0, []
            for i, data in side:
                at += len(data)
                ends.append((i, at))
            sides.append(ends)
        cuts = sorted({e for _, e in sides[0]} & {e for _, e in sides[1]})
        groups = [([i for i, e in sides[0] if last < e <= cut], [i for i, e in sides[1] if last < e <= cut]) for last, cut in zip([0, *cuts], cuts)] if len(cuts) < 300 else None
        if groups is None:
            groups, at = [], [0, 0]
            for cut in cuts:
                group = []
                for k in (0, 1):
                    start = at[k]
                    while at[k] < len(sides[k]) and sides[k][at[k]][1] <= cut:
                        at[k] += 1
                    group.append([i for i, _ in sides[k][start : at[k]]])
                groups.append(tuple(group))
        linked = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        docs.update(linked.keys())
        found.append((doc, sides, groups, linked))
    best = {}
    for (x, _), n in docs.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for doc, sides, groups, linked in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n_best = sum(n for p, n in linked.items() if docs[p] == best[p[0]])
        total = sum(n * docs[p] for p, n in linked.items())
        out.append((doc, len(sides[0]), len(sides[1]), len(groups), sum(linked.values()), n_best, total, hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=str)


COLUMNS = ["doc_id", *alignment.NUMBERS, "groups_sha256"]
ODD = [None, "", " ", "\n", "\n\n", "word", " word", "two  spaces", "a\n\nb", "a \n\nNext", "end \n", "it's 's '", "don't!!'s", "x\r\ny\t z", "<|endoftext|> <s></s><unk> <0x41>", "▁mark", "naïve œuvre ñandú straße", "数据 データ", "🙂🙂 é", "aaaaaaaaaaaaaaaaaaaaaaaa", "=" * 200, "1234567 89.5%", "A B C", ".\n-\nx", "a\x0bb\x00c", "#" * 7 + "\n" + "{\r\n}", "ЖЖ жж", "ﷺ" * 5, "a" * 3000 + "b!?" * 999]


def test_query_by_brute_force(spark, sf_dir, paths):
    expected = slow(paths, [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()])
    assert order(queries.op11_alignment(spark, sf_dir).select(COLUMNS).collect()) == order(expected)


def test_odd_texts_ids_and_clashing_names(spark, paths):
    """Every case of ``ODD``, repeated rows and ids, rows without an id, over blocks of a few texts."""
    rows = [*enumerate(ODD), (0, "word"), (0, "word"), (None, "two words"), (None, None), (7, "word " * 9000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, groups int, passage string").repartition(3)
    from pyspark.sql import functions as F

    got = alignment.align_documents(docs, *paths, block=60)
    assert got.columns == ["doc_id", *alignment.NUMBERS, "groups"]
    got = got.select("doc_id", *alignment.NUMBERS, F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")).collect()
    assert order(got) == order(slow(paths, rows))
    assert alignment.align_documents(docs.limit(0), *paths).count() == 0
    assert [tuple(r) for r in alignment.align_documents(docs.where("text is null"), *paths).distinct().collect() if r["doc_id"] == 0] == [(0, 0, 0, 0, 0, 0, 0, "")]


def test_passages_are_where_both_cut(paths):
    """Random mixtures of signs that meet at borders: tokens of the passages are those of the whole text."""
    both, tokens, dice = alignment.load_both(*paths), slow_tokens(paths), random.Random(11)
    signs = ["a", "the", "Öl", "œ", "ß", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", ".", ",", "'s", "'", "12", "%%%", "(", "é", "日本", " ", "🙂", "_", "<s>", "{"]
    for _ in range(3000):
        text = "".join(dice.choices(signs, k=dice.randrange(1, 14)))
        parts = both.passages(" " + text)
        assert "".join(parts) == " " + text
        a, b = both.encode(parts)
        found = [[i for side in sides for i in side] for sides in (a, b)]
        assert found == [[i for i, _ in side] for side in tokens(text)], text
        assert all(both.exact(*x) for x in zip(parts, a, b, strict=True))


def test_links_of_wide_groups(spark):
    aligned = spark.createDataFrame([("x", [([1, 1, 2], [7, 8, 7]), ([1], [7])])], "passage string, groups array<struct<a: array<int>, b: array<int>>>")
    for pairs in (alignment.Pairs(50_000, 100), alignment.Pairs(1 << 20, 1 << 20)):
        found = alignment.links(aligned, pairs)
        got = {(r["a"], r["pair"] % pairs.size_b): r["n"] for r in found.groupBy("pair", pairs.a("pair").alias("a")).sum("times").withColumnRenamed("sum(times)", "n").collect()}
        assert got == {(1, 7): 5, (1, 8): 2, (2, 7): 2, (2, 8): 1}


def test_blocks_are_gathered_in_slices(monkeypatch):
    """A block's documents, over slices of a few passages: sums, groups and the documents that hold each pair; one with a
    passage that has no row has nothing."""
    import pyarrow as pa

    monkeypatch.setattr(alignment, "GATHER", 3)
    docs = [[0, 1, 0, 2], [], [1, 3], [2, 2, 2, 2, 2], [0], [1]]
    block = pa.table({"block": [5], "doc_id": [[10, 11, 12, None, 14, 14]], "docs": pa.array([docs], pa.list_(pa.list_(pa.int32())))})
    numbers = {x: [100 + i, 10, 1] for i, x in enumerate(alignment.NUMBERS)}  # of passages 2, 0 and 1; 3 has no tokens
    rows = pa.table({"pos": pa.array([2, 0, 1], pa.int32()), "groups": ["c|c", "a|a", "b|b"], **numbers})
    got = alignment._gathered(block, rows).to_pydict()
    assert got["doc_id"] == [10, 11, 12, None, 14, 14]
    assert got["groups"] == ["a|a;b|b;a|a;c|c", "", "", "c|c;c|c;c|c;c|c;c|c", "a|a", "b|b"]
    for i, x in enumerate(alignment.NUMBERS):
        assert got[x] == [121 + i, 0, 0, 500 + 5 * i, 10, 1]
    pairs = pa.array([[7, 9], [7], [8, 7]], pa.list_(pa.int32()))
    values, held = alignment._held(block, pa.table({"pos": pa.array([2, 0, 1], pa.int32()), "pairs": pairs}))
    assert dict(zip(values.tolist(), held.tolist(), strict=True)) == {7: 4, 8: 2, 9: 2}
    none = alignment._gathered(block, rows.slice(0, 0)).to_pydict()
    assert none["groups"] == [""] * 6 and none["n_a"] == [0] * 6


def test_splitting_loads_no_tokenizers(spark, paths, tmp_path):
    """Tasks that split texts need no vocabulary: its files are gone when they start."""
    import os
    import shutil

    own = [shutil.copy(x, tmp_path) for x in paths]
    alignment.load_both(*own)
    for x in own:
        os.remove(x)
    blocks = alignment.split(spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string").coalesce(1), *own).collect()
    assert [(r["doc_id"], r["passages"], r["docs"]) for r in blocks] == [([1, 2], [" one", " two"], [[0, 1], []])]


def test_gathering_holds_no_tokenizers(spark, paths):
    """Five blocks over four buckets: one task at least gathers after another block's function has loaded them."""
    blocks = spark.createDataFrame([(i, [i], [[0]]) for i in range(5)], "block long, doc_id array<long>, docs array<array<int>>")
    where = spark.createDataFrame([("a", i, 0) for i in range(5)], "passage string, block long, pos int")

    def held(block, rows):
        import pyarrow as pa

        found = alignment.load_both.cache_info().currsize
        alignment.load_both(*paths)
        return pa.table({"held": [found], "rows": [rows.num_rows]})

    got = alignment._by_block(blocks, where, spark.createDataFrame([("a", 1)], "passage string, n int"), held, "held long, rows long")
    assert [tuple(r) for r in got.collect()] == [(0, 1)] * 5


def test_settings_stay(spark, paths):
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", None)
    alignment.align_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), *paths)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", None) == before
